"""Passages of evaluation items inside a corpus, found with errors allowed.

Pigeonhole: a passage of ``passage_words`` words with at most ``error_budget`` edited words leaves one of its
error_budget + 1 pieces intact. The pieces of all passages of all items are hashed once; a document's word
windows of a piece's length are hashed by a rolling sum over the whole Arrow batch and looked up. Every hit is
verified with Myers' bit-parallel edit distance over words, which also rules out chance hits of the hash.

Scale: the corpus is read once, whatever the number of items. Items measured to have at most ``ITEM_BYTES`` are
sent to the workers as one index, and nothing is shuffled. More items stay a frame of pieces: what is sent is a
filter of their hashes of at most ``FILTER_BITS``, and only the windows of documents that pass it, with the words
around them, are joined with the pieces and verified.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.text import compatible
from weftline.session import cut, ship

#: Prompts that are sent to the workers.
ITEM_BYTES = 8 << 20
#: Bits of the filter of more prompts, a power of two. A full one lets more windows pass and changes no result.
FILTER_BITS = 1 << 28
#: Documents hashed at once.
DOCS = 2_000
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Runs of letters and digits, compatibility forms plain, upper as lower case, format characters absent."""
    text = compatible(text)
    if not text.isascii():
        # the dotted capital would leave a loose dot, and a final sigma is the same letter
        text = text.replace("İ", "i").lower().replace("ς", "σ")
        return _WORD.findall(compatible(text))
    return _WORD.findall(text.lower())


def myers(pattern: Sequence[int], text: Sequence[int]) -> int:
    """The least edit distance of ``pattern`` to any stretch of ``text``, by Myers' bit vectors."""
    m = len(pattern)
    places: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        places[w] |= 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for w in text:
        eq = places.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = (minus | ~(xh | plus)) & full
        mh = plus & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        plus = (mh | ~(xv | ph)) & full
        minus = ph & xv
        best = min(best, score)
    return best


class Index:
    """Pieces of the passages of some items."""

    def __init__(self, items: Sequence[tuple[object, list[str]]], passage_words: int, error_budget: int) -> None:
        self.size, self.budget = passage_words, error_budget
        self.piece = passage_words // (error_budget + 1)
        if self.piece < 1:
            raise ValueError("the error budget leaves no word to a piece")
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        owners: dict[tuple[int, ...], set] = {}
        for item, found in items:
            ids = [number(w, len(self.vocabulary) + 1) for w in found]
            for i in range(len(ids) - passage_words + 1):
                owners.setdefault(tuple(ids[i : i + passage_words]), set()).add(item)
        self.passages = list(owners)
        self.owners = [tuple(x) for x in owners.values()]
        # piece -> (passage, place of the piece in it)
        pieces: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for k, passage in enumerate(self.passages):
            for at in range(0, self.piece * (error_budget + 1), self.piece):
                pieces[passage[at : at + self.piece]].append((k, at))
        keys = list(pieces)
        hashes = np.zeros(len(keys), np.uint64)
        if keys:
            grid = np.array(keys, np.uint64)
            for j in range(self.piece):
                hashes = hashes * _BASE + grid[:, j]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.pieces = hashes[order], [(keys[i], pieces[keys[i]]) for i in order]

    def search(self, docs: list[list[int]]) -> Iterator[tuple[int, object, int]]:
        """(document, item, distance) with the least distance, at most the budget, of each pair."""
        if not len(self.hashes):
            return
        gap = self.piece
        lengths = np.array([len(d) + gap for d in docs], np.int64)
        starts = np.cumsum(lengths) - lengths
        stream = np.zeros(int(lengths.sum()), np.uint64)
        for s, d in zip(starts.tolist(), docs, strict=True):
            stream[s : s + len(d)] = d
        n = len(stream) - self.piece + 1
        if n <= 0:
            return
        rolled = np.zeros(n, np.uint64)
        known = np.ones(n, bool)
        for j in range(self.piece):
            window = stream[j : j + n]
            rolled = rolled * _BASE + window
            known &= window > 0
        spots = np.flatnonzero(known)
        slot = np.minimum(np.searchsorted(self.hashes, rolled[spots]), len(self.hashes) - 1)
        right = self.hashes[slot] == rolled[spots]
        spots, slot = spots[right], slot[right]
        owner_doc = np.searchsorted(starts, spots, side="right") - 1
        best: dict[tuple[int, object], int] = {}
        tried: set[tuple[int, int, int]] = set()
        for spot, k, doc in zip(spots.tolist(), slot.tolist(), owner_doc.tolist(), strict=True):
            key, uses = self.pieces[k]
            at = spot - int(starts[doc])
            own = docs[doc]
            if tuple(own[at : at + self.piece]) != key:
                continue
            for passage, place in uses:
                begin = at - place
                if (doc, passage, begin) in tried:
                    continue
                tried.add((doc, passage, begin))
                owners = self.owners[passage]
                if all(best.get((doc, o), self.budget + 1) == 0 for o in owners):
                    continue
                stretch = own[max(0, begin - self.budget) : max(0, begin + self.size + self.budget)]
                d = myers(self.passages[passage], stretch)
                if d <= self.budget:
                    for o in owners:
                        if d < best.get((doc, o), self.budget + 1):
                            best[doc, o] = d
        yield from ((doc, item, d) for (doc, item), d in best.items())


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str, text: str, item_id: str, prompt: str, passage_words: int = 12, error_budget: int = 1, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(<doc_id>, <item_id>, distance): every document with every item of which it holds a passage of
    ``passage_words`` consecutive words with at most ``error_budget`` words edited; the least number of edits.

    Null and empty texts and prompts match nothing, nor do prompts shorter than a passage. A repeated item counts
    once, a repeated document row gives its rows again. Without items there are no rows.
    """
    ship(docs.sparkSession)
    listed = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{prompt}`").alias("prompt")).where("prompt is not null").distinct()
    out = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField(item_id, items.schema[item_id].dataType), T.StructField("distance", T.IntegerType())])
    size = listed.agg(F.coalesce(F.sum(F.octet_length("prompt")), F.lit(0)).alias("n")).first()["n"]
    picked = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    if size > item_bytes:
        return _joined(picked, listed, passage_words, error_budget, out)
    block = [(r["item"], words(r["prompt"])) for r in listed.collect()]
    return picked.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(block), passage_words, error_budget, doc_id, item_id, out), out)


# --- more items than are sent -----------------------------------------------------------------------


class Hashes(dict):
    """Stable 64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        raw = word.encode("utf-8", "replace")
        made = self[word] = zlib.crc32(raw) | zlib.crc32(raw, 0x9E3779B9) << 32
        return made


def _rolled(hashed: np.ndarray, piece: int) -> np.ndarray:
    """A hash of every window of so many words."""
    n = max(len(hashed) - piece + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for j in range(piece):
        rolled = rolled * _BASE + hashed[j : j + n]
    return rolled ^ (rolled >> np.uint64(32))


def _pieces_of_items(size: int, budget: int, item_type: pa.DataType):  # noqa: ANN202
    piece = size // (budget + 1)
    schema = pa.schema([("piece", pa.int64()), ("place", pa.int32()), ("passage", pa.list_(pa.int64())), ("item", item_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for item, prompt in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                hashed = np.array([hashes[w] for w in words(prompt)], np.uint64)
                n = len(hashed) - size + 1
                if n <= 0:
                    continue
                rolled, signed = _rolled(hashed, piece).view(np.int64), hashed.view(np.int64)
                passages = np.lib.stride_tricks.sliding_window_view(signed, size)
                for place in range(0, piece * (budget + 1), piece):
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, size), pa.int32()), pa.array(passages.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(rolled[place : place + n]), pa.array(np.full(n, place), pa.int32()), lists, pa.array([item.as_py()] * n, item_type)], schema=schema)

    return run


_HITS = pa.schema([("piece", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("around", pa.list_(pa.int64()))])


def _windows(bits, mask: int, size: int, budget: int, doc_type: pa.DataType):  # noqa: ANN001, ANN202
    """Windows of documents that may be pieces, with the words that a passage around them may have."""
    piece = size // (budget + 1)
    schema = pa.schema([("row", pa.int64()), ("doc", doc_type), *_HITS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes = bits.value, Hashes()
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                hashed = np.array([hashes[w] for w in words(text)], np.uint64) if text else np.zeros(0, np.uint64)
                rolled = _rolled(hashed, piece)
                spot = rolled & np.uint64(mask)
                passed = np.flatnonzero(known[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1))
                for at in passed.tolist():
                    first = max(0, at - piece * budget - budget)
                    rows.append((i, int(rolled[at : at + 1].view(np.int64)[0]), at, first, hashed[first : at + size + budget].view(np.int64)))
            for a in range(0, len(rows), 10_000):
                index, *columns = zip(*rows[a : a + 10_000], strict=True)
                taken = pa.array(index, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken).cast(doc_type), *(pa.array(c, f.type) for c, f in zip(columns, _HITS, strict=True))], schema=schema)

    return run


def _verifier(size: int, budget: int, schema: pa.Schema):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, distances = [], []
            for i, (at, first, around, place, passage) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("at", "first", "around", "place", "passage")), strict=True)):
                begin = at - place
                stretch = around[max(0, begin - budget) - first : max(0, begin + size + budget) - first]
                d = myers(passage, stretch)
                if d <= budget:
                    index.append(i)
                    distances.append(d)
            taken = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(taken).cast(schema.field(k).type) for k in ("row", "doc", "item")), pa.array(distances, pa.int32())], schema=schema)

    return run


def _joined(docs: DataFrame, listed: DataFrame, size: int, budget: int, out: T.StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    if size // (budget + 1) < 1:
        raise ValueError("the error budget leaves no word to a piece")
    doc_type, item_type = out[0].dataType, out[1].dataType
    spark = docs.sparkSession
    pieces = listed.mapInArrow(_pieces_of_items(size, budget, to_arrow_type(item_type)), T.StructType([T.StructField("piece", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("passage", T.ArrayType(T.LongType())), T.StructField("item", item_type)]))
    pieces = cut(pieces)
    spot = F.col("piece").bitwiseAND(F.lit(FILTER_BITS - 1))
    set_bits = pieces.select(F.shiftright(spot, 6).alias("w"), F.expr(f"shiftleft(1L, cast((piece & {FILTER_BITS - 1}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS >> 6, np.uint64)
    bits[set_bits.column("w").to_numpy()] = set_bits.column("b").to_numpy().view(np.uint64)
    hits_schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc", doc_type), T.StructField("piece", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("around", T.ArrayType(T.LongType()))])
    hits = docs.toDF("doc", "text").select(F.monotonically_increasing_id().alias("row"), "doc", "text").mapInArrow(_windows(spark.sparkContext.broadcast(bits), FILTER_BITS - 1, size, budget, to_arrow_type(doc_type)), hits_schema)
    found = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc", doc_type), T.StructField("item", item_type), T.StructField("distance", T.IntegerType())])
    arrow = pa.schema([("row", pa.int64()), ("doc", to_arrow_type(doc_type)), ("item", to_arrow_type(item_type)), ("distance", pa.int32())])
    checked = hits.join(pieces, "piece").mapInArrow(_verifier(size, budget, arrow), found)
    best = checked.groupBy("row", "doc", "item").agg(F.min("distance").alias("distance"))
    return best.select(F.col("doc").alias(out[0].name), F.col("item").alias(out[1].name), "distance")


# --- items that are sent ----------------------------------------------------------------------------

_INDEXES: dict[str, Index] = {}


def index_of(key: str, make: Callable[[], Index]) -> Index:
    """The index of a block of items, made once per worker process; only the latest is kept."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = make()
    return _INDEXES[key]


def _searcher(block, passage_words: int, error_budget: int, doc_id: str, item_id: str, out: T.StructType):  # noqa: ANN001
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, key = to_arrow_schema(out), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(key, lambda: Index(block.value, passage_words, error_budget))
        number = index.vocabulary.get
        for batch in batches:
            for at in range(0, len(batch), DOCS):
                part = batch.slice(at, DOCS)
                ids = [[number(w, 0) for w in words(t)] if t else [] for t in part.column(1).to_pylist()]
                found = list(index.search(ids))
                if found:
                    rows, items, distances = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)).cast(schema.field(0).type), pa.array(items, schema.field(1).type), pa.array(distances, pa.int32())], schema=schema)

    return run
