"""Spam by form and by pairs in windows of fixed length."""

import random

from weftline.llm.spam import Counts, Hashes, Limits, spam_share


def share(text):
    """Without a corpus, so without mutual information."""
    return spam_share(text, Counts(), Hashes(), Limits())[0]


PHRASES = [f"{a} {b}" for a, b in zip("rain wool oak iron salt corn flax jade clay mint pine reed sand teal rust lime moss silk tar wax zinc plum kelp hemp dusk".split(), "coat sock desk gate mill cake seed ring pot tea cone mat box paint bolt juice bed scarf pan seal bar jam soup rope lamp".split(), strict=True)]


def test_list_of_phrases_named_once():
    assert share(", ".join(PHRASES)) > 0.5
    assert share("\n".join(PHRASES)) > 0.5
    # a short list of fields is none
    assert share("Fields used: " + ", ".join(PHRASES[:12])) <= 0.5


def test_run_goes_on_behind_links_and_records():
    stuffed = ["buy cheap coat online now", "cheap coat buy online best"] * 12
    between = "\n".join(f"{x}\n2024-01-0{i % 9 + 1} 10:00:00 | ok" for i, x in enumerate(stuffed))
    assert share("\n".join(stuffed)) == 1.0
    assert 0.4 < share(between) and share("\n".join(f"{x}\nhttps://a.example/{i}" for i, x in enumerate(stuffed))) == 1.0


def test_long_prose_of_an_unknown_language():
    draw = random.Random(3)
    words = ["".join(draw.choice("ptkmnsl") + draw.choice("aeiou") for _ in range(draw.randint(1, 4))) for _ in range(400)]
    prose = draw.choices(words, [1 / (i + 8) for i in range(400)], k=1500)
    text = ". ".join(" ".join(prose[i : i + 15]) for i in range(0, 1500, 15))
    assert len(set(prose)) / len(prose) < 0.36 and share(text) == 0.0
