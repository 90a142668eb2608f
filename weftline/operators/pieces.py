"""Pieces of texts that may be replacement rules, where the rules are too many to send.

Rules become bits of a filter of fixed size: each whole, and its first 1, 2, 4, 8, ... bytes. A batch of texts is
hashed by sums over its bytes, so any piece costs one subtraction. Pieces whose first bytes pass are tried in the lengths that
rules have; what passes is looked up in the table of rules. Hashes that meet by chance cost a look-up and change no result.
Pieces are bytes of UTF-8, which stand in a text where the characters do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Bits of the filter at most, a power of two, and for a rule. A full filter lets more pieces pass and changes no result.
FILTER_BITS, RULE_BITS = 1 << 27, 32
#: Bits of a part of the filter, as ``bitmap_or_agg`` has them.
PART_BITS = 32_768
#: Bytes of texts that are hashed at once.
SEGMENT = 1 << 20

_ALL = (1 << 64) - 1
_BASE = 0x9E6C63D0876A9A47
_INVERSE = pow(_BASE, -1, 1 << 64)
_SIZE, _HEAD, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53

RULES = "array<struct<a: string, b: string>>"
STATE = f"id bigint, origin string, text string, a string, b string, asked array<string>, rules {RULES}, asks array<string>"
_RULES = pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())]))
_STATE = pa.schema([("id", pa.int64()), *((c, pa.string()) for c in ("origin", "text", "a", "b")), ("asked", pa.list_(pa.string())), ("rules", _RULES), ("asks", pa.list_(pa.string()))])
_FOUND = pa.schema([("origin", pa.string()), ("asks", pa.list_(pa.string()))])
_MARKS = pa.schema([("part", pa.int64()), ("bits", pa.binary())])


def filter_bits(rules: int) -> int:
    """The filter's size for so many rules."""
    return min(FILTER_BITS, max(PART_BITS, 1 << (rules * RULE_BITS).bit_length()))


class Hashed:
    """Hashes of all pieces of a run of bytes."""

    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        if n > len(Hashed._powers[0]):
            Hashed._powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(2 * n, SEGMENT), x, np.uint64)])) for x in (_BASE, _INVERSE))
        self.up = Hashed._powers[0]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Hashed._powers[1][:n], out=self.sums[1:])

    def places(self, starts: np.ndarray, sizes: np.ndarray | int, head: bool, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The two bits of each piece."""
        h = (self.sums[starts + sizes] - self.sums[starts]) * self.up[starts]
        salt = (np.asarray(sizes).astype(np.uint64).reshape(-1) * np.uint64(_SIZE)) ^ np.uint64(_HEAD if head else 0)
        h = h ^ salt
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX1)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX2)
        h = h ^ (h >> np.uint64(32))
        mask = np.uint64(bits - 1)
        return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def _runs(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, where texts end) of runs of texts of about ``SEGMENT`` bytes, or of one longer text."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_string())
    _, offsets, held = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(held, np.uint8) if held else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SEGMENT, "right")) - 1)
        yield at, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def marks(bits: int):  # noqa: ANN201
    """(part, bits): the parts of the filter that the rules of a task set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for _, data, ends in _runs(batch.column(0)):
                hashed, starts, sizes = Hashed(data), ends[:-1], np.diff(ends)
                heads = 1 << (np.frexp(sizes)[1].astype(np.int64) - 1)
                for places in (*hashed.places(starts, sizes, False, bits), *hashed.places(starts, heads, True, bits)):
                    for bit in range(8):
                        held[places[(places & 7) == bit] >> 3] |= 1 << bit
        parts = held.reshape(-1, PART_BITS // 8)
        for i in np.flatnonzero(parts.any(axis=1)).reshape(-1):
            yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int64()), pa.array([parts[i].tobytes()], pa.binary())], schema=_MARKS)

    return run


class Filter:
    """What no rule begins with or is, with few exceptions."""

    def __init__(self, parts: dict[int, bytes], bits: int, sizes: Sequence[int]) -> None:
        empty = bytes(PART_BITS // 8)
        self.held, self.bits = b"".join(parts.get(i, empty) for i in range(bits // PART_BITS)), bits
        self.longest = max(sizes, default=1)
        self.sizes: dict[int, list[int]] = {}
        for n in sorted(sizes):
            self.sizes.setdefault(1 << (n.bit_length() - 1), []).append(n)

    def _has(self, hashed: Hashed, starts: np.ndarray, size: int, head: bool) -> np.ndarray:
        held = np.frombuffer(self.held, np.uint8)
        one, two = hashed.places(starts, size, head, self.bits)
        return ((held[one >> 3] >> (one & 7)) & (held[two >> 3] >> (two & 7)) & 1).astype(bool)

    def pieces(self, texts: Sequence[str] | pa.Array) -> list[set[str]]:
        """Of every text the pieces that may be rules; all that are among them."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        found: list[set[str]] = [set() for _ in range(len(texts))]
        for first, data, ends in _runs(texts):
            for at in range(0, len(data), SEGMENT):
                part = data[at : at + SEGMENT + self.longest - 1]
                hashed, starts = Hashed(part), np.arange(min(SEGMENT, len(data) - at))
                of = np.searchsorted(ends, starts + at, "right") - 1
                room = ends[of + 1] - at - starts
                starts = starts[(part[: len(starts)] & 0xC0) != 0x80]
                for head, sizes in self.sizes.items():
                    begun = starts[room[starts] >= sizes[0]]
                    begun = begun[self._has(hashed, begun, head, True)]
                    for size in sizes:
                        here = begun[room[begun] >= size]
                        for i in here[self._has(hashed, here, size, False)].tolist():
                            found[first + of[i]].add(part[i : i + size].tobytes().decode(errors="replace"))
        return found


def find(sent):  # noqa: ANN001, ANN201
    """(origin, asks): the different texts of a batch with pieces that may be rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            different = batch.column(0).unique()
            for first, _, ends in _runs(different):
                texts = different.slice(first, len(ends) - 1)
                found = sent.value.pieces(texts)
                some = [i for i, x in enumerate(found) if x]
                if some:
                    yield pa.RecordBatch.from_arrays([texts.take(pa.array(some, pa.int64())).cast(pa.string()), pa.array([sorted(found[i]) for i in some], _FOUND.field("asks").type)], schema=_FOUND)

    return run


def order(a: str) -> tuple[int, str]:
    """Rules go by this, then by what they put in."""
    return -len(a), a


def replaced(sent):  # noqa: ANN001, ANN201
    """Rows of ``STATE`` as far as the rules that were looked up go: of a finished text nothing is asked.

    A text goes on with the next rule that occurs, unless a piece that was not looked up yet comes before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(first, len(ends) - 1) for batch in batches for first, _, ends in _runs(batch.column(2))):
            rows = part.to_pylist()
            for r in rows:
                r["known"], r["new"] = set(r["asked"]), set()
                last = None if r["a"] is None else (order(r["a"]), r["b"])
                r["left"] = iter([x for x in sorted((order(x["a"]), x["b"]) for x in r["rules"]) if last is None or x > last])
            live = rows
            while live:
                changed = []
                for r in live:
                    least = min(map(order, r["new"]), default=None)
                    for (n, a), b in r["left"]:
                        if least is not None and (n, a) > least:
                            break
                        if a in r["text"]:
                            r["text"], r["a"], r["b"] = r["text"].replace(a, b), a, b
                            changed.append(r)
                            break
                for r, found in zip(changed, sent.value.pieces([r["text"] for r in changed]), strict=True):
                    r["new"] |= {x for x in found - r["known"] if order(x) > order(r["a"])}
                live = changed
            for r in rows:
                r["asks"] = sorted(r["new"])
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in _STATE.names} for r in rows], schema=_STATE)

    return run
