"""Frequency of every distinct value, counted with burst tries.

Each worker accumulates the values of its partition in a burst trie per field: inner nodes branch by
character behind what all their terms share, leaves are small dictionaries that burst into inner nodes when
they grow. A finished trie, or one that has grown to its limit, is written as compact subtrees (prefix, sorted
suffixes, occurrence and record counters). Subtrees of all workers are routed by adaptive prefixes: a prefix
that holds too many entries over all workers is extended by a character until what it holds fits one task.
What prefixes cannot divide, as terms that share a very long one, is divided by the hash of the term.
Matching subtrees meet under one route and are merged with Arrow kernels.

Scale: the rows are first reduced to distinct (field, term, record) with map-side combine, hashed over
all three columns, so a hot term or a hot record is spread over all tasks and every reduced row adds
exactly one to a term's record counter wherever it is counted. The set of extended prefixes has at most
``ROUTES`` members per character of depth, whatever the data's size.
"""

from __future__ import annotations

import os.path
import zlib
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, ship

#: Entries of a leaf before it bursts.
BURST = 512
#: Terms of a trie before it is written.
PLANT = 1_000_000
#: Entries of a route, on average where it is divided by hash.
ROUTE_ENTRIES = 100_000
#: Prefixes with less than this part of all entries are not extended.
ROUTES = 4_096
#: Routes follow prefixes no further than this many characters.
MAX_PREFIX = 64

_SUBTREE = "field string, prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>"
_ROUTED = "field string, route string, suffixes array<string>, occurrences array<bigint>, records array<bigint>"
_COUNTED = "field string, term string, occurrences bigint, records bigint"
_SUBTREE_ARROW = pa.schema([("field", pa.string()), ("prefix", pa.string()), ("suffixes", pa.list_(pa.string())), ("occurrences", pa.list_(pa.int64())), ("records", pa.list_(pa.int64()))])
_ROUTED_ARROW = pa.schema([("field", pa.string()), ("route", pa.string()), *list(_SUBTREE_ARROW)[2:]])
_COUNTED_ARROW = pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def term(c: Column | str) -> Column:
    """A value as a term: lower case, without spaces, tabs and line breaks at its ends; null if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.trim(c.cast("string"), F.lit(" \t\r\n"))), F.lit(""))


class BurstTrie:
    """Term counters in a trie whose leaves are dictionaries that burst beyond a limit. A node skips what all its terms share."""

    __slots__ = ("burst", "here", "kids", "root", "skip")

    def __init__(self, burst: int = BURST) -> None:
        self.burst = burst
        #: Suffixes of a leaf; None in an inner node.
        self.root: dict[str, list[int]] | None = {}
        self.skip = ""
        self.kids: dict[str, BurstTrie] = {}
        self.here: list[int] | None = None

    def add(self, text: str, occurrences: int, records: int) -> bool:
        """Whether the term is new."""
        node, depth = self, 0
        while node.root is None:
            if node.skip and not text.startswith(node.skip, depth):
                node._part(text[depth : depth + len(node.skip)])
            depth += len(node.skip)
            if depth == len(text):
                new = node.here is None
                if new:
                    node.here = [0, 0]
                node.here[0] += occurrences
                node.here[1] += records
                return new
            kid = node.kids.get(text[depth])
            if kid is None:
                kid = node.kids[text[depth]] = BurstTrie(self.burst)
            node, depth = kid, depth + 1
        suffix = text[depth:]
        entry = node.root.get(suffix)
        if entry is None:
            node.root[suffix] = [occurrences, records]
            if len(node.root) > self.burst:
                node._split()
            return True
        entry[0] += occurrences
        entry[1] += records
        return False

    def _split(self) -> None:
        held, self.root = self.root, None
        self.skip = os.path.commonprefix([min(held), max(held)])
        at = len(self.skip)
        for suffix, entry in held.items():
            if len(suffix) == at:
                self.here = entry
                continue
            kid = self.kids.get(suffix[at])
            if kid is None:
                kid = self.kids[suffix[at]] = BurstTrie(self.burst)
            kid.root[suffix[at + 1 :]] = entry

    def _part(self, text: str) -> None:
        """Put a node above this one, as ``text`` shares only a part of what is skipped."""
        shared = len(os.path.commonprefix([self.skip, text]))
        below = BurstTrie(self.burst)
        below.root, below.skip, below.kids, below.here = None, self.skip[shared + 1 :], self.kids, self.here
        self.kids, self.here, self.skip = {self.skip[shared]: below}, None, self.skip[:shared]

    def subtrees(self) -> Iterator[tuple[str, list[str], list[int], list[int]]]:
        """(prefix, sorted suffixes, occurrences, records) of every leaf."""
        stack: list[tuple[str, BurstTrie]] = [("", self)]
        while stack:
            prefix, node = stack.pop()
            prefix += node.skip
            if node.here is not None:
                yield prefix, [""], [node.here[0]], [node.here[1]]
            if node.root:
                keys = sorted(node.root)
                yield prefix, keys, [node.root[k][0] for k in keys], [node.root[k][1] for k in keys]
            stack.extend((prefix + ch, kid) for ch, kid in node.kids.items())


def _rows(batches: Iterable, schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Tuples to record batches."""
    held: list[tuple] = []
    for row in batches:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _summed(table: pa.Table, keys: list[str]) -> pa.Table:
    out = table.group_by(keys, use_threads=False).aggregate([("occurrences", "sum"), ("records", "sum")])
    return out.rename_columns([{"occurrences_sum": "occurrences", "records_sum": "records"}.get(c, c) for c in out.column_names])


def _plant(burst: int, plant: int):
    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        tries: dict[str, BurstTrie] = {}
        held = 0
        for batch in batches:
            part = _summed(pa.Table.from_batches([batch]), ["field", "term"])
            for field, text, occ, rec in zip(*(part.column(c).to_pylist() for c in ("field", "term", "occurrences", "records")), strict=True):
                trie = tries.get(field)
                if trie is None:
                    trie = tries[field] = BurstTrie(burst)
                held += trie.add(text, occ, rec)
            if held >= plant:
                yield from ((field, *sub) for field, trie in tries.items() for sub in trie.subtrees())
                tries, held = {}, 0
        yield from ((field, *sub) for field, trie in tries.items() for sub in trie.subtrees())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(planted(batches), _SUBTREE_ARROW)

    return run


class Routes:
    """Where a term's entries meet: its first prefix that is not extended, and a bucket by the hash of the whole term."""

    def __init__(self, extended: Mapping[tuple[str, str], int], usual: int, entries: int) -> None:
        self.extended, self.usual, self.entries = extended, usual, entries

    def of(self, field: str, text: str) -> tuple[str, int]:
        """(prefix, buckets)."""
        depth = 0
        while (field, text[:depth]) in self.extended:
            if depth == MAX_PREFIX:
                return text[:depth], -(-self.extended[field, text[:depth]] // self.entries)
            if depth == len(text):
                return text + "\x00", 1
            depth += 1
        return text[:depth], self.usual


def _send(sent):  # noqa: ANN001
    """Give every subtree its route; what belongs to several is divided."""

    def divided(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        routes: Routes = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                field, prefix = row["field"], row["prefix"]
                if (field, prefix[:MAX_PREFIX]) not in routes.extended:
                    route, buckets = routes.of(field, prefix)
                    if buckets == 1:
                        yield field, route, [prefix + s for s in row["suffixes"]], row["occurrences"], row["records"]
                        continue
                parts: dict[str, tuple[list, list, list]] = {}
                for s, o, r in zip(row["suffixes"], row["occurrences"], row["records"], strict=True):
                    text = prefix + s
                    route, buckets = routes.of(field, text)
                    if buckets > 1:
                        route = f"{route}\x01{zlib.crc32(text.encode('utf-8', 'replace')) % buckets}"
                    part = parts.setdefault(route, ([], [], []))
                    part[0].append(text)
                    part[1].append(o)
                    part[2].append(r)
                for route, part in parts.items():
                    yield field, route, *part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(divided(batches), _ROUTED_ARROW)

    return run


def _merge(table: pa.Table) -> pa.Table:
    parents = pc.list_parent_indices(table.column("suffixes").combine_chunks())
    flat = pa.table({
        "field": pc.take(table.column("field"), parents),
        "term": pc.list_flatten(table.column("suffixes").combine_chunks()),
        "occurrences": pc.list_flatten(table.column("occurrences").combine_chunks()),
        "records": pc.list_flatten(table.column("records").combine_chunks()),
    })
    return _summed(flat, ["field", "term"]).select(_COUNTED_ARROW.names).cast(_COUNTED_ARROW)


def count_terms(
    sources: Sequence[tuple[DataFrame, str, Mapping[str, str]]],
    *,
    burst: int = BURST,
    route_entries: int = ROUTE_ENTRIES,
    routes: int = ROUTES,
    plant: int = PLANT,
) -> DataFrame:
    """Rows and different records of every term: (field, term, occurrences, records).

    ``sources`` lists (frame, record column, {field name: column}). Nulls and blanks are no terms; a row
    without a record key counts as an occurrence in no record. A repeated row counts as an occurrence again.
    No rows give no rows. Other columns are never read.
    """
    ship(sources[0][0].sparkSession)
    parts = []
    for df, record, fields in sources:
        each = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), term(df[c]).alias("term")) for name, c in fields.items()]))
        parts.append(df.select(df[record].cast("string").alias("record"), each.alias("x")).select("record", "x.field", "x.term").where("term is not null"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    reduced = rows.groupBy("field", "term", "record").agg(F.count(F.lit(1)).alias("occurrences"))
    reduced = reduced.select("field", "term", "occurrences", F.col("record").isNotNull().cast("bigint").alias("records"))
    subtrees = cut(reduced.mapInArrow(_plant(burst, plant), _SUBTREE))

    # Entries under every prefix, over all workers; only prefixes above the limit reach the driver.
    level = subtrees.select("field", F.substring("prefix", 1, MAX_PREFIX).alias("prefix"), F.size("suffixes").alias("n")).groupBy("field", "prefix").agg(F.sum("n").alias("n"))
    above = F.explode(F.sequence(F.lit(0), F.length("prefix"))).alias("d")
    level = level.select("field", "prefix", "n", above).groupBy("field", F.expr("substring(prefix, 1, d)").alias("prefix")).agg(F.sum("n").alias("n"))
    total = level.where("prefix = ''").agg(F.sum("n").alias("n")).first()["n"] or 0
    limit = max(route_entries, total // routes)
    extended = {(r["field"], r["prefix"]): r["n"] for r in level.where(F.col("n") > limit).collect()} if total > limit else {}
    sent = subtrees.sparkSession.sparkContext.broadcast(Routes(extended, -(-limit // route_entries), route_entries))
    routed = subtrees.mapInArrow(_send(sent), _ROUTED)
    return routed.groupBy("field", "route").applyInArrow(_merge, _COUNTED)


def mark_terms(counts: DataFrame, all_records: DataFrame, *, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
    """Add ``mark``: ``rare`` below ``rare_below`` records, ``common`` above that share of the different
    non-null keys in the one column of ``all_records``, else null. Both at once is ``rare``."""
    key = all_records.columns[0]
    # one number as a scalar subquery: nothing is joined
    total = all_records.agg(F.count_distinct(F.col(key)).alias("n")).scalar()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * total, "common")
    return counts.withColumn("mark", mark)
