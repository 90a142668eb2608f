"""Keyword-stuffed pages, search-phrase lists, link lists and tag lists.

Two passes over the corpus. The first counts in how many texts every word and every pair of neighbouring words occurs:
the tasks emit combined counters and a JVM aggregate with map-side combine adds them up exactly. The second measures
every text around each of its words: the mean pointwise mutual information of the neighbouring words there, and the
share of collocations that are repeated nearby. Words that do not go together are word salad. Collocations that come
again and again are stuffing, unless they are as coherent as ordinary sentences of the corpus: the more they repeat, the
more coherent they must be. Coherence is relative to the mean over the corpus, so that the limits do not depend on its
size. Lists of links, tags and short items are recognised by form, as are logs, field tables, configurations and expressions,
which are none of these. A text's share is the part of its characters in what is flagged.

Scale: the counters are spilled and shuffled by the JVM, one row per different word or pair and task. The workers get the
words and pairs that make up at least ``FLOOR`` of all: 1 / FLOOR of each kind at most, whatever the corpus. A rarer pair
counts as not occurring, which moves its value by log 2 at most, as the floor is also what counts are smoothed by.
Texts are never shuffled.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.text import compatible
from weftline.session import cut, ship

#: Words and pairs below this share of all are not sent to the workers.
FLOOR = 5e-7
#: Documents measured at once.
DOCS = 500
#: Counters a task holds before it sends them on.
HELD = 1 << 20
WORD, PAIR, TEXT = 0, 1, 2

# Cyrillic letters that look like Latin ones, and those.
_CYRILLIC, _LATIN = "аеорсхуіјԁһкмтвнАЕОРСХУІЈКМТВН", "aeopcxyijdhkmtbhAEOPCXYIJKMTBH"
_LOOKALIKES, _OTHER_SCRIPT = str.maketrans(_CYRILLIC, _LATIN), frozenset(_CYRILLIC)

_LINE = re.compile(r"[^\r\n]+")
# scripts without spaces are divided where the script changes
_HIRAGANA, _KATAKANA, _HAN = "ぁ-ゟ", "゠-ヿ", "㐀-鿿"
_WORD = re.compile(f"[{_HIRAGANA}]+|[{_KATAKANA}]+|[{_HAN}]+|[^\\W_{_HIRAGANA}{_KATAKANA}{_HAN}]+")
_ASCII_WORD = re.compile("[a-z0-9]+")
_DIGIT = re.compile(r"\d")
_LINK = re.compile(r"<a\s[^>]*>.*?</a\s*>|!?\[[^\]\n]*\]\(\s*(?:https?://|www\.)[^)\s]*\)|(?:https?://|www\.)[^\s<>\"|,;]+", re.I)
_TAG = re.compile(r"#\w+")
_LETTERS = re.compile(r"[^\W\d_]+")
_STAMP = re.compile(r"[\[(]?\d{4}-\d\d-\d\d(?:[ T]\d\d:\d\d(?::\d\d)?(?:[.,]\d+)?Z?)?[\])]?[ \t]")
# The usual levels of log entries.
_LOGGED = re.compile(r"\b(?:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|FATAL)\b|\w=\S")
_RULE = re.compile(r"\|?(?:\s*:?-{3,}:?\s*\|)+(?:\s*:?-{3,}:?\s*)?$")
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|<[!?][^<>]*>")
_SIGN = re.compile(r"[\[\]=<>(){}]")
_BRANCH = re.compile(r"\b(?:IF|THEN|ELSE)\b")
_SEPARATOR = re.compile("[,;|•·、，]\\s*(?=\\S)")


def plain(text: str) -> str:
    """Without format characters, compatibility forms and letters of another script that stand for Latin ones."""
    text = compatible(text)
    return text if text.isascii() or _OTHER_SCRIPT.isdisjoint(text) else text.translate(_LOOKALIKES)


def tokens(line: str) -> list[str]:
    """Lower-case words."""
    return (_ASCII_WORD if line.isascii() else _WORD).findall(line.lower())


class Hashes(dict):
    """Stable 32-bit hashes of words, never 0; numbers and codes of digits for the most part have one. So few words share a hash with a frequent one that
    they don't matter, and the key of a pair holds both."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        made = self[word] = NUMBER if 2 * len(_DIGIT.findall(word)) >= len(word) else zlib.crc32(word.encode("utf-8", "replace")) or 1
        return made


NUMBER = zlib.crc32(b"0")


def pair_keys(hashed: np.ndarray) -> np.ndarray:
    """A key of every word and the next."""
    return hashed[:-1] << np.uint64(32) | hashed[1:]


def text_key(text: str) -> int:
    raw = text.encode("utf-8", "replace")
    return zlib.crc32(raw) | zlib.crc32(raw, 0x9E3779B9) << 32


# --- forms ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Limits:
    #: Fewer words than this in a text are not judged.
    least_words: int = 12
    #: Words around a word that are measured with it.
    window: int = 40
    #: A collocation is repeated if it comes again within so many words.
    near: int = 60
    #: So many pairs in a row that come again in the same order are a passage and no stuffing, but for a short one in many tellings.
    passage: int = 8
    short_passage: int = 16
    tellings: int = 4
    #: Flagged: a coherence, relative to the corpus, of at most ``salad + per_repeat`` times the share of repeated collocations.
    salad: float = 0.45
    per_repeat: float = 0.8
    #: Pairs with evidence that a window needs, as a share of its pairs; else repetition alone decides, from this share on.
    evidence: float = 0.3
    repeats_alone: float = 0.6
    #: Lists by form: at least so many items, of so many words each on average, at most so coherent.
    items: int = 15
    item_words: tuple[float, float] = (1.5, 4.0)
    item_coherence: float = 0.9
    #: Fewer links or tags than this are no list.
    links: int = 3
    tags: int = 8


@dataclass
class Page:
    """A text by form: its words with their line's size, and what needs no judgement."""

    words: list[str] = field(default_factory=list)
    #: (words, characters) of every line of words.
    lines: list[tuple[int, int]] = field(default_factory=list)
    #: (first word, word behind, items) of runs of short items.
    lists: list[tuple[int, int, int]] = field(default_factory=list)
    total: int = 0
    links: int = 0
    link_chars: int = 0
    tags: int = 0
    tag_chars: int = 0


def page(text: str | None, limits: Limits) -> Page:
    """Lines of links, of tags, of records and of words."""
    out = Page()
    if not text:
        return out
    lines = [s for s in map(str.strip, _LINE.findall(plain(text))) if s]
    first = items = listed = 0
    table = False
    for i, s in enumerate(lines):
        out.total += len(s)
        if "://" in s or "www." in s or "WWW." in s:
            links = _LINK.findall(s)
            if links and sum(map(len, _LETTERS.findall(_LINK.sub(" ", s)))) <= 0.3 * len(s):
                out.links, out.link_chars = out.links + len(links), out.link_chars + len(s)
                continue
        if "#" in s:
            tags = _TAG.findall(s)
            if tags and sum(map(len, tags)) >= 0.6 * len(s):
                out.tags, out.tag_chars = out.tags + len(tags), out.tag_chars + len(s)
                continue
        # rows of a table with a rule under its head
        bar = s[0] == "|" and s[-1] == "|"
        table = bar and (table or (i + 1 < len(lines) and _RULE.match(lines[i + 1]) is not None))
        if table:
            continue
        judged = s
        if s[0] in "[(0123456789" and (stamp := _STAMP.match(s)) is not None:
            # an entry of a log: a level, a value by name, or hardly anything behind the time
            judged = s[stamp.end() :]
            if _LOGGED.search(judged) or len(tokens(judged)) < 3:
                continue
        if "<" in s and ">" in s:
            judged = _MARKUP.sub(" ", judged)
            if len(judged) <= 0.8 * len(s) and not s.lower().startswith(("<p", "<b", "<i", "<li", "<span", "<div", "<h")):
                continue
        words = tokens(judged)
        operators = len(_SIGN.findall(judged))
        if "IF" in judged or "THEN" in judged or "ELSE" in judged:
            operators += len(_BRANCH.findall(judged))
        if not words or (operators >= 2 and operators >= 0.2 * len(words)):
            continue
        # a comma or two make no list; short lines are items of one
        n, parts = len(words), len(_SEPARATOR.findall(judged)) + 1
        parts = parts if parts > 2 and n <= limits.item_words[1] * parts else 1 if parts == 1 and n <= limits.item_words[1] and judged[-1] not in ".:!?" else 0
        if parts:
            first = first if items else len(out.words)
            items, listed = items + parts, listed + n
        if items and (not parts or i == len(lines) - 1):
            if items >= limits.items and limits.item_words[0] * items <= listed <= limits.item_words[1] * items:
                out.lists.append((first, first + listed, items))
            items = listed = 0
        out.words += words
        out.lines.append((n, len(s)))
    if items >= limits.items and limits.item_words[0] * items <= listed <= limits.item_words[1] * items:
        out.lists.append((first, first + listed, items))
    return out


@dataclass
class Stream:
    """The words of several pages in one array."""

    hashed: np.ndarray
    owner: np.ndarray
    starts: np.ndarray
    pairs: np.ndarray
    within: np.ndarray

    @classmethod
    def of(cls, pages: list[Page], hashes: Hashes) -> Stream:
        hashed = np.array([h for p in pages for h in map(hashes.__getitem__, p.words)], np.uint64)
        starts = np.cumsum([0, *(len(p.words) for p in pages)])
        owner = np.repeat(np.arange(len(pages)), np.diff(starts))
        return cls(hashed, owner, starts, pair_keys(hashed), owner[:-1] == owner[1:])


# --- counts -----------------------------------------------------------------------------------------

_COUNTS = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])


def _summed(kinds: list[np.ndarray], keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind, key, n = np.concatenate(kinds), np.concatenate(keys), np.concatenate(counts)
    order = np.lexsort((key, kind))
    kind, key, n = kind[order], key[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])])) if len(key) else np.zeros(0, np.int64)
    return kind[new], key[new], np.add.reduceat(n, new) if len(new) else n


def _once(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The keys of every owner, each once."""
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    return keys[np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])] if len(keys) else keys


def _counter(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        kinds: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kinds[0]), pa.array(keys[0]), pa.array(counts[0])], schema=_COUNTS)

        for arrived in batches:
            for at in range(0, len(arrived), DOCS):
                texts = [t for t in arrived.column(0).slice(at, DOCS).to_pylist() if t]
                s = Stream.of([page(t, limits) for t in texts], hashes)
                for kind, found in ((WORD, _once(s.owner, s.hashed)), (PAIR, _once(s.owner[:-1][s.within], s.pairs[s.within])), (TEXT, np.array([text_key(t) for t in texts], np.uint64))):
                    kinds.append(np.full(len(found), kind, np.int8))
                    keys.append(found.view(np.int64))
                    counts.append(np.ones(len(found), np.int64))
                if sum(map(len, keys)) > HELD:
                    kinds[:], keys[:], counts[:] = ([x] for x in _summed(kinds, keys, counts))
                    if len(keys[0]) > HELD // 2:
                        yield batch()
                        kinds, keys, counts = [], [], []
        if keys:
            kinds[:], keys[:], counts[:] = ([x] for x in _summed(kinds, keys, counts))
            yield batch()

    return run


@dataclass
class Counts:
    """Texts with each frequent word and pair, and all there are: sorted keys and their counts."""

    words: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    pairs: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    texts: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    all_words: int = 0
    all_pairs: int = 0
    floor: float = FLOOR
    #: Mean over the corpus, nan without evidence.
    mean: float = math.nan

    @staticmethod
    def look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        known, counts = table
        if not len(known):
            return np.zeros(len(keys), np.int64)
        at = np.searchsorted(known, keys).clip(max=len(known) - 1)
        return np.where(known[at] == keys, counts[at], 0)

    def mutual(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pointwise mutual information from counts, and whether there is evidence for it: the pair occurs elsewhere, or should."""
        least = max(self.floor * self.all_pairs, 1.0)
        expected = a.astype(np.float64) * b * (self.all_pairs / max(self.all_words, 1) ** 2)
        return np.log((both + least) / (expected + least)), (both > 0) | (expected >= least)

    def corpus_mean(self) -> float:
        """The mean over all pairs that are found in other texts too."""
        keys, both = self.pairs
        a, b = (np.maximum(self.look_up(self.words, k) - 1, 0) for k in (keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)))
        value, sure = self.mutual(both - 1, a, b)
        weight = np.where(sure, both, 0)
        return float((value * weight).sum() / weight.sum()) if weight.sum() else math.nan

    def of_stream(self, s: Stream, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of all pairs of a stream. A text is no evidence for itself, nor are its copies."""
        own = copies[s.owner]
        alone = np.maximum(self.look_up(self.words, s.hashed) - own, 0)
        both = np.maximum(self.look_up(self.pairs, s.pairs) - own[:-1], 0)
        return self.mutual(both, alone[:-1], alone[1:])


def corpus_counts(docs: DataFrame, text: str, *, floor: float = FLOOR, limits: Limits | None = None) -> Counts:
    """Counts of all texts. The frame of all counters is written once, as what is frequent depends on their sum."""
    ship(docs.sparkSession)
    limits = limits or Limits()
    parts = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(_counter(limits), "kind tinyint, key bigint, n bigint")
    counters = cut(parts.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    totals = {r["kind"]: r["n"] for r in counters.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    out = Counts(all_words=totals.get(WORD, 0), all_pairs=totals.get(PAIR, 0), floor=floor)
    enough = F.when(F.col("kind") == WORD, floor * out.all_words).when(F.col("kind") == PAIR, floor * out.all_pairs).otherwise(F.greatest(F.lit(floor * out.all_pairs), F.lit(2)))
    # at most 1 / floor words, as many pairs, and fewer texts
    kept = counters.where(F.col("n") >= enough).toArrow()
    kind, key, n = (kept.column(c).to_numpy() for c in ("kind", "key", "n"))
    key = key.view(np.uint64)
    tables = []
    for k in (WORD, PAIR, TEXT):
        mine = np.flatnonzero(kind == k)
        mine = mine[np.argsort(key[mine])]
        tables.append((key[mine], n[mine]))
    out.words, out.pairs, out.texts = tables
    out.mean = out.corpus_mean()
    return out


# --- judgement --------------------------------------------------------------------------------------


def repeats(s: Stream, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pair comes again nearby in its text, and whether it came before. Two numbers are no collocation, and a
    whole passage that is told again is none either."""
    number = np.uint64(NUMBER)
    at = np.flatnonzero(s.within & ~((s.hashed[:-1] == number) & (s.hashed[1:] == number)))
    again, before = np.zeros(len(s.pairs), bool), np.zeros(len(s.pairs), bool)
    if not len(at):
        return again, before
    order = at[np.lexsort((at, s.pairs[at], s.owner[at]))]
    one, two = order[:-1], order[1:]
    alike = (s.pairs[one] == s.pairs[two]) & (s.owner[one] == s.owner[two])
    group = np.concatenate([[0], np.cumsum(~alike)])
    often = np.bincount(group)[group][1:] > limits.tellings
    # passages: neighbouring pairs that were last seen equally far back
    back = np.zeros(len(s.pairs) + 1, np.int64)
    back[two[alike]] = (two - one)[alike]
    edges = np.flatnonzero(np.concatenate([[True], back[1:] != back[:-1]]))
    passage = np.repeat(np.diff(np.concatenate([edges, [len(back)]])) >= limits.passage, np.diff(np.concatenate([edges, [len(back)]])))
    same = alike & (two - one <= limits.near)
    told = passage[two] & (back[two] >= limits.passage) & ~(often & (back[two] < limits.short_passage))
    before[two[same]] = True
    again[two[same & ~told]] = again[one[same & ~told]] = True
    return again, before


def spam_shares(texts: list[str | None], counts: Counts, hashes: Hashes, limits: Limits) -> list[tuple[float, float]]:
    """(share of the characters that are flagged, mean pointwise mutual information of all neighbours with evidence, else nan)."""
    pages = [page(t, limits) for t in texts]
    s = Stream.of(pages, hashes)
    n = len(s.hashed)
    copies = np.maximum(counts.look_up(counts.texts, np.array([text_key(t or "") for t in texts], np.uint64)), 1)
    value, sure = counts.of_stream(s, copies) if n else (np.zeros(0), np.zeros(0, bool))
    again, before = repeats(s, limits)
    fresh = s.within & ~before
    sure = sure & fresh
    upto = lambda x: np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    values, sures, freshes, agains, pairs = (upto(x) for x in (value * sure, sure, fresh, again, s.within))

    def measured(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Coherence relative to the corpus, share of pairs with evidence, share of repeated ones, pairs; of the words from lo to hi."""
        hi = np.maximum(hi - 1, lo)
        within = pairs[hi] - pairs[lo]
        some = np.maximum(sures[hi] - sures[lo], 1.0)
        coherent = (values[hi] - values[lo]) / some / (counts.mean if counts.mean > 0 else math.nan)
        return coherent, (sures[hi] - sures[lo]) / np.maximum(freshes[hi] - freshes[lo], 1.0), (agains[hi] - agains[lo]) / np.maximum(within, 1.0), within

    flagged = np.zeros(n, bool)
    if n:
        first, behind = s.starts[:-1][s.owner], s.starts[1:][s.owner]
        lo = np.maximum(np.minimum(np.arange(n) - limits.window // 2, behind - limits.window), first)
        coherent, evidence, repeated, within = measured(lo, np.minimum(lo + limits.window, behind))
        # few words tell little about salad
        limit = limits.salad * np.minimum(within / (limits.window - 1), 1.0) + limits.per_repeat * repeated
        known = (evidence >= limits.evidence) & ~np.isnan(coherent)
        flagged = np.where(known, coherent <= limit, repeated >= limits.repeats_alone) & (behind - first >= limits.least_words)
    out: list[tuple[float, float]] = []
    for p, start, end in zip(pages, s.starts[:-1], s.starts[1:], strict=True):
        spam = (p.link_chars if p.links >= limits.links else 0) + (p.tag_chars if p.tags >= limits.tags else 0)
        if end > start:
            marks = flagged[start:end].copy()
            for a, b, _ in p.lists:
                coherent, evidence, _, _ = measured(np.array([start + a]), np.array([start + b]))
                if evidence[0] < limits.evidence or not coherent[0] > limits.item_coherence:
                    marks[a:b] = True
            if marks.any():
                lengths = [k for k, _ in p.lines]
                spam += float((marks * np.repeat([size / k for k, size in p.lines], lengths)).sum())
        seen = sures[end - 1] - sures[start] if end > start else 0.0
        out.append((min(spam / p.total, 1.0) if p.total else 0.0, (values[end - 1] - values[start]) / seen if seen else math.nan))
    return out


def spam_share(text: str | None, counts: Counts, hashes: Hashes, limits: Limits) -> tuple[float, float]:
    return spam_shares([text], counts, hashes, limits)[0]


def score_pages(docs: DataFrame, *, doc_id: str, text: str, counts: Counts | None = None, limits: Limits | None = None) -> DataFrame:
    """(<doc_id>, spam_share, mean_pmi) of every row. Null, empty and blank texts have share 0; mean_pmi is null where no
    pair of words has evidence. Repeated rows are scored again; copies of a text are no evidence for it."""
    ship(docs.sparkSession)
    limits = limits or Limits()
    counts = counts if counts is not None else corpus_counts(docs, text, limits=limits)
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    out = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("spam_share", T.DoubleType()), T.StructField("mean_pmi", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes = sent.value, Hashes()
        for batch in batches:
            for at in range(0, len(batch), DOCS):
                part = batch.slice(at, DOCS)
                scores = spam_shares(part.column(1).to_pylist(), known, hashes, limits)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s for s, _ in scores], pa.float64()), pa.array([None if math.isnan(p) else p for _, p in scores], pa.float64())], names=[f.name for f in out])

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, out)


def find_spam(docs: DataFrame, *, doc_id: str, text: str, more_than: float = 0.5, limits: Limits | None = None) -> DataFrame:
    """The rows of ``score_pages`` with a share above ``more_than``."""
    return score_pages(docs, doc_id=doc_id, text=text, limits=limits).where(F.col("spam_share") > more_than)
