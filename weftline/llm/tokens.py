"""Encoding of a corpus with a public byte-level BPE tokenizer.

Texts are cut at safe boundaries before they reach the tokenizer: a place between a character that is no
white space and one that is begins a new piece under the splitting pattern, whatever stands around it. So does
a place where letters or digits end, which cuts texts without white space too; what is letters only throughout is
one piece for the pattern itself.
Long runs of white space, on which the pattern's look-ahead would backtrack, are encoded as the single
piece the pattern makes of them. So long texts cost time in proportion to their length and give the same ids.

Scale: one pass without shuffle. The rank file, about a megabyte, is sent to the workers, which parse it once.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import ship

# The splitting pattern of the byte-level vocabularies, and Unicode's White_Space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: A text longer than this is cut.
CHUNK = 32_768
#: A run of white space longer than this is encoded as one piece.
RUN = 1_000
_LONG_RUN = re.compile(f"[{WHITE}]{{{RUN + 1},}}")
# scripts and marks that all versions of Unicode class alike; a mark before letters may begin a contraction, so nothing is cut there
_MARKS = "!-/:-@\\[-`{-~、。"
_BOUNDARY = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[A-Za-zぁ-ゖァ-ヺ一-鿿])(?=[0-9{_MARKS}])|(?<=[0-9])(?=[A-Za-zぁ-ゖァ-ヺ一-鿿{_MARKS}])")


def default_ranks() -> str:
    """The place of byte_bpe_50k in the installed collection of public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Tokenizer:
    def __init__(self, rank_lines: bytes) -> None:
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, rank_lines.splitlines())))}
        self.words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.piece = tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})
        self.bytes = {v: k for k, v in self.ranks.items()}

    def encode(self, text: str) -> list[int]:
        return self.words.encode_ordinary(text) if len(text) <= RUN else list(itertools.chain.from_iterable(self._parts(text)))

    def _parts(self, text: str) -> Iterator[list[int]]:
        start = 0
        for run in _LONG_RUN.finditer(text):
            # the last white space of a run goes with what follows, if anything does
            end = run.end() if run.end() == len(text) else run.end() - 1
            yield from map(self.words.encode_ordinary, self._pieces(text, start, run.start()))
            yield self.piece.encode_ordinary(text[run.start() : end])
            start = end
        yield from map(self.words.encode_ordinary, self._pieces(text, start, len(text)))

    def _pieces(self, text: str, start: int = 0, end: int | None = None) -> Iterator[str]:
        end = len(text) if end is None else end
        while end - start > CHUNK:
            cut = _BOUNDARY.search(text, start + CHUNK, end)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        if start < end:
            yield text[start:end]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The raw bytes of the ids: exact, even where an id ends within a character."""
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def tokenizer(rank_file: str) -> Tokenizer:
    """One per process and rank file."""
    return Tokenizer(Path(rank_file).read_bytes())


_SENT: dict[str, Tokenizer] = {}


def _sender(spark, rank_file: str):  # noqa: ANN001, ANN202
    """What gives the workers their tokenizer: executors need not have the file."""
    raw = Path(rank_file).read_bytes()
    name, sent = hashlib.sha1(raw).hexdigest(), spark.sparkContext.broadcast(raw)

    def made() -> Tokenizer:
        if name not in _SENT:
            _SENT[name] = Tokenizer(sent.value)
        return _SENT[name]

    return made


def _lists(ids: list[list[int]]) -> pa.ListArray:
    offsets = pa.array(itertools.accumulate(map(len, ids), initial=0), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(itertools.chain.from_iterable(ids), pa.int32()))


def encode_texts(df: DataFrame, key: str, text: str, *, rank_file: str | None = None, out: str = "ids") -> DataFrame:
    """(<key>, <out> array<int>): the ids of every text, one row per row. Empty and null texts give an empty list;
    strings that look like special tokens are ordinary text. ``rank_file`` is read on the driver."""
    ship(df.sparkSession)
    tokens = _sender(df.sparkSession, rank_file or default_ranks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens().encode
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                ids = [encode(t) if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids)], names=[key, out])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(out, T.ArrayType(T.IntegerType()))])
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def decode_ids(df: DataFrame, key: str, ids: str, *, rank_file: str | None = None, out: str = "text") -> DataFrame:
    """(<key>, <out> string): the text of every list of ids through its raw bytes; null for null, '' for an empty list."""
    ship(df.sparkSession)
    tokens = _sender(df.sparkSession, rank_file or default_ranks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = tokens().decode
        for batch in batches:
            texts = [None if x is None else decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, out])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(out, T.StringType())])
    return df.select(F.col(f"`{key}`"), F.col(f"`{ids}`")).mapInArrow(run, schema)
