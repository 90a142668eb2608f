"""Plain forms of texts."""

from __future__ import annotations

import unicodedata

#: All format characters: they lie in the first two planes and at the start of the fifteenth.
_FORMAT = frozenset(chr(c) for c in [*range(0x20000), *range(0xE0000, 0xE0100)] if unicodedata.category(chr(c)) == "Cf")


def compatible(text: str) -> str:
    """Without format characters, compatibility forms as the plain ones."""
    if text.isascii():
        return text
    # the different characters tell what there is to do, most often nothing
    for c in _FORMAT.intersection(text):
        text = text.replace(c, "")
    return text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)
