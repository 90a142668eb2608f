"""Schemas that drift between files: one consistent table and a log of every change.

Headers (the names and value types a file or a record declares) are read in parallel on the executors,
folded through a promotion lattice, and compared in order. Files are cast to the union schema by their
header, one scan per different header.

Scale: of a record only a fingerprint of its header travels with its keys; each different header is carried
once per task. Everything after that is as small as the number of different headers.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.lattice import Seen, conform
from weftline.operators.terms import term
from weftline.session import cut, ship

# Bits of the value types a text fits; the types of several values are the bits they share.
INTEGER, DECIMAL, BOOLEAN = 1, 2, 4
_INTEGER = re.compile(r"[+-]?[0-9]+\Z")
_DECIMAL = re.compile(r"[+-]?[0-9]+\.[0-9]+\Z")
#: Headers remembered as sent by a task before it starts anew; sending one twice does no harm.
REMEMBERED = 100_000


def fits(text: str) -> int:
    """The value types that a trimmed text fits, as bits."""
    if _INTEGER.match(text):
        return INTEGER | DECIMAL
    if _DECIMAL.match(text):
        return DECIMAL
    return BOOLEAN if text.lower() in ("true", "false") else 0


def type_name(mask: Column) -> Column:
    """The narrowest type of the lattice integer < decimal < text, boolean < text."""
    return F.when(mask.bitwiseAND(INTEGER) > 0, "integer").when(mask.bitwiseAND(DECIMAL) > 0, "decimal").when(mask.bitwiseAND(BOOLEAN) > 0, "boolean").otherwise("text")


class HeaderReader:
    """Field paths of an XML text with the types of their values."""

    def __init__(self) -> None:
        self.types: dict[str, int] = {}

    def fit(self, text: str) -> int:
        mask = self.types.get(text)
        if mask is None:
            if len(self.types) > 50_000:
                self.types.clear()
            mask = fits(text)
            if len(text) < 64:
                self.types[text] = mask
        return mask

    def read(self, text: str) -> dict[str, int] | None:
        """{field path: bits}, None if the text isn't well-formed. Paths leave out the root and places."""
        found: dict[str, int] = {}
        paths: list[str] = []
        texts: list[list[str]] = []
        fit = self.fit

        def start(name: str, attrs: list[str]) -> None:
            path = f"{paths[-1]}/{name}" if len(paths) > 1 else name if paths else ""
            paths.append(path)
            texts.append([])
            lead = f"{path}/@" if path else "@"
            for i in range(0, len(attrs), 2):
                value = attrs[i + 1].strip()
                if value:
                    field = lead + attrs[i]
                    found[field] = found.get(field, 7) & fit(value)

        def end(_name: str) -> None:
            path, value = paths.pop(), "".join(texts.pop()).strip()
            if value and path:
                found[path] = found.get(path, 7) & fit(value)

        parser = expat.ParserCreate()
        parser.ordered_attributes = True
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler = start, end
        parser.CharacterDataHandler = lambda data: texts[-1].append(data)
        try:
            parser.Parse(text, True)
        except (expat.ExpatError, UnicodeEncodeError):
            return None
        return found


_HEADERS = pa.schema([("owner", pa.int64()), ("kind", pa.string()), ("mark", pa.binary()), ("paths", pa.list_(pa.string())), ("masks", pa.list_(pa.int32()))])


def _read_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, sent = HeaderReader(), set()
    for batch in batches:
        rows: dict[tuple, tuple] = {}
        for owner, kind, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = reader.read(text) if text else None
            if found is None:
                continue
            paths = sorted(found)
            masks = [found[p] for p in paths]
            mark = hashlib.blake2b(repr((paths, masks)).encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if mark in sent:
                rows.setdefault((owner, kind, mark), (None, None))
            else:
                if len(sent) > REMEMBERED:
                    sent.clear()
                sent.add(mark)
                rows[owner, kind, mark] = (paths, masks)
        if rows:
            columns = [*zip(*rows, strict=True), *zip(*rows.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HEADERS, strict=True)], schema=_HEADERS)


def headers(df: DataFrame, owner: str, kind: str, text: str) -> DataFrame:
    """(owner, kind, mark, paths, masks) of the different headers of XML records; kind is a term. The lists are
    null where a task has sent the header of that mark before."""
    ship(df.sparkSession)
    picked = df.select(df[owner].cast("bigint").alias("owner"), term(df[kind]).alias("kind"), df[text].alias("text")).where("kind is not null and owner is not null and text is not null")
    return picked.mapInArrow(_read_headers, "owner bigint, kind string, mark binary, paths array<string>, masks array<int>")


def with_release(df: DataFrame, version: str) -> DataFrame:
    """Add major and minor of the first two numbers in ``version`` (digits, point, digits)."""
    pattern = F.lit(r"([0-9]+)\.([0-9]+)")
    number = lambda i: F.regexp_extract(df[version], r"([0-9]+)\.([0-9]+)", i).try_cast("decimal(38,0)")
    return df.where(F.coalesce(F.regexp_like(df[version], pattern), F.lit(False))).withColumns({"major": number(1), "minor": number(2)})


def drift_of_records(records: DataFrame, versions: DataFrame, *, owner: str, kind: str, text: str, version_owner: str, version: str) -> DataFrame:
    """Every change of the fields of a kind between the releases it occurs in:
    (kind, since_release, change_kind, field_path, new_field_path), see ``changes``.

    A record's release is that of its owner; one whose owner has several releases counts for each. Records
    without kind, owner, release or a well-formed text are left out; repeated ones change nothing.
    """
    per_record = headers(records, owner, kind, text)
    release = with_release(versions.select(versions[version_owner].cast("bigint").alias("owner"), versions[version].alias("version")), "version").select("owner", "major", "minor").distinct()
    # owners without a release stay until their headers have been taken: another record may refer to them
    joined = per_record.join(release, "owner", "left").groupBy("kind", "major", "minor", "mark").agg(F.max(F.struct("paths", "masks")).alias("header"))
    joined = cut(joined)
    full = joined.where("header.paths is not null").groupBy("mark").agg(F.max("header").alias("full"))
    known = joined.where("major is not null").select("kind", "major", "minor", "mark").join(full, "mark")
    fields = known.select("kind", "major", "minor", F.explode_outer(F.arrays_zip("full.paths", "full.masks")).alias("f"))
    folded = fields.groupBy("kind", "major", "minor", F.col("f.paths").alias("path")).agg(F.bit_and("f.masks").alias("mask"))
    return changes(cut(folded))


def changes(folded: DataFrame) -> DataFrame:
    """Ordered differences of schemas (kind, major, minor, path, mask); a null path only says that the kind occurs.

    (kind, since_release, change_kind, field_path, new_field_path): each release of a kind against the one before.
    ``added``, ``removed``, ``retyped``; a gone and a new field that are the only ones of one parent path and value
    type make one ``renamed`` row with both paths. new_field_path is empty for the others.
    """
    release = F.struct("major", "minor")
    kinds = folded.groupBy("kind").agg(F.array_sort(F.collect_set(release)).alias("releases"))
    at = F.array_position("releases", release).cast("int")
    fields = folded.where("path is not null").join(kinds, "kind").select("kind", "path", type_name(F.col("mask")).alias("type"), "releases", at.alias("at"))
    # a field's releases in order: where one is missing in between, it went and came back
    by_field = Window.partitionBy("kind", "path").orderBy("at")
    fields = fields.withColumns({"was_at": F.lag("at").over(by_field), "was": F.lag("type").over(by_field), "next_at": F.lead("at").over(by_field)})
    stays = F.coalesce(F.col("was_at") == F.col("at") - 1, F.lit(False))
    goes = (F.col("at") < F.size("releases")) & F.coalesce(F.col("next_at") > F.col("at") + 1, F.lit(True))
    event = lambda when, kind, r: F.when(when, F.struct(F.lit(kind).alias("what"), F.col("releases")[r].alias("since")))
    events = F.array_compact(F.array(
        event((F.col("at") > 1) & ~stays, "added", F.col("at") - 1), event(goes, "removed", F.col("at")), event(stays & (F.col("was") != F.col("type")), "retyped", F.col("at") - 1),
    ))
    events = fields.select("kind", "path", "type", F.explode(events).alias("e")).select("kind", "path", "type", "e.what", "e.since")
    # gone and new fields of one place and type meet; retyped ones stay by themselves
    above = F.when(F.col("what") == "retyped", F.col("path")).otherwise(F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    of = lambda what: F.collect_list(F.when(F.col("what") == what, F.col("path")))
    groups = events.groupBy("kind", "since", above.alias("above"), "type", (F.col("what") == "retyped").alias("stays")).agg(of("removed").alias("gone"), of("added").alias("new"), of("retyped").alias("other"))
    row = lambda kind, old, new: F.struct(F.lit(kind).alias("change_kind"), old.alias("field_path"), new.alias("new_field_path"))
    each = lambda kind, c: F.transform(c, lambda x: row(kind, x, F.lit("")))
    one_each = (F.size("gone") == 1) & (F.size("new") == 1)
    rows = F.when(one_each, F.array(row("renamed", F.col("gone")[0], F.col("new")[0]))).otherwise(F.concat(each("removed", "gone"), each("added", "new"), each("retyped", "other")))
    since = F.concat_ws(".", F.col("since.major").cast("string"), F.col("since.minor").cast("string")).alias("since_release")
    return groups.select("kind", since, F.explode(rows).alias("r")).select("kind", "since_release", "r.*")


# --- files ------------------------------------------------------------------------------------------

_SCHEMAS = "seq bigint, path string, schema string"
_CHANGES = "change_kind string, field string, old_type string, new_type string"


def _arrow_schema(kind: pa.Schema) -> T.StructType:
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(kind, prefer_timestamp_ntz=True)


def file_schemas(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(seq, path, schema) of Parquet files from their footers, read by the executors. seq is their order, schema JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            schemas = []
            for path in batch.column(1).to_pylist():
                files, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
                schemas.append(_arrow_schema(pq.read_schema(inner, filesystem=files)).json())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(schemas, pa.string())], names=["seq", "path", "schema"])

    ship(spark)
    frame = spark.createDataFrame([*enumerate(paths)], "seq bigint, path string").repartition(min(len(paths), 256) or 1)
    return frame.mapInArrow(run, _SCHEMAS)


def schema_changes(old: T.StructType, new: T.StructType) -> list[tuple[str, str, str | None, str | None]]:
    """(change_kind, field, old_type, new_type): ``added``, ``removed``, ``retyped``, ``renamed`` (one gone and one new field of
    equal type, as ``old -> new``)."""
    was, now = ({f.name: f.dataType for f in s} for s in (old, new))
    gone, fresh = [n for n in was if n not in now], [n for n in now if n not in was]
    text = lambda t: t.simpleString()
    if len(gone) == len(fresh) == 1 and was[gone[0]] == now[fresh[0]]:
        out = [("renamed", f"{gone[0]} -> {fresh[0]}", text(was[gone[0]]), text(now[fresh[0]]))]
    else:
        out = [("removed", n, text(was[n]), None) for n in gone] + [("added", n, None, text(now[n])) for n in fresh]
    return out + [("retyped", n, text(was[n]), text(now[n])) for n in was if n in now and not Seen.of(was[n]).same(Seen.of(now[n]))]


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parsed = lru_cache(maxsize=1024)(T._parse_datatype_json_string)
    for batch in batches:
        rows = [(seq, path, *c) for seq, path, old, new in zip(*(x.to_pylist() for x in batch.columns), strict=True) for c in schema_changes(parsed(old), parsed(new))]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = [pa.int64(), *[pa.string()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["seq", "path", "change_kind", "field", "old_type", "new_type"])


def read_drifting(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """All Parquet files as one table and the log of their changes.

    The table has every column of any file in the order of first appearance, each cast to the least type that holds the
    values of all files (see ``lattice``), nested fields too; a column that a file lacks is null. A repeated path is read
    again. The log has (seq, path, change_kind, field, old_type, new_type) against the file before, see
    ``schema_changes``. No paths give two empty frames. Footers are read and compared by the executors; the different
    schemas reach the driver, and of each file the number of its own. Files of equal schema share one scan.
    """
    log_schema = f"seq bigint, path string, {_CHANGES}"
    if not paths:
        return spark.createDataFrame([], T.StructType([])), spark.createDataFrame([], log_schema)
    found = cut(file_schemas(spark, paths))
    kinds = {r["schema"]: (r["first"], T._parse_datatype_json_string(r["schema"])) for r in found.groupBy("schema").agg(F.min("seq").alias("first")).collect()}
    in_order = sorted(kinds.values(), key=lambda x: x[0])
    union = reduce(Seen.__or__, (Seen.of(schema) for _, schema in in_order)).type()
    number = {first: [] for first, _ in in_order}
    firsts = found.groupBy("schema").agg(F.min("seq").alias("first"))
    for r in found.join(firsts, "schema").select("seq", "first").toLocalIterator():
        number[r["first"]].append(paths[r["seq"]])
    out = None
    for first, schema in in_order:
        own = {f.name: f.dataType for f in schema}
        # a path read twice gives its rows twice
        rounds = [[p for p, n in Counter(number[first]).items() if n > k] for k in range(max(Counter(number[first]).values()))]
        for files in rounds:
            df = spark.read.schema(schema).parquet(*files)
            df = df.select(*[(conform(F.col(f"`{f.name}`"), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in union])
            out = df if out is None else out.unionByName(df)
    before = found.select((F.col("seq") + 1).alias("seq"), F.col("schema").alias("old"))
    pairs = found.join(before, "seq").where("schema <> old").select("seq", "path", "old", F.col("schema").alias("new"))
    return out, pairs.mapInArrow(_differences, log_schema)
