"""Readers and writers by file format."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import columns as C
from weftline.sources import excel

# Format codes of documents, and formats by extension.
_CODES = {"0": "csv", "19": "xlsx", "25": "yxdb"}
_EXTENSIONS = {"csv": "csv", "tsv": "csv", "txt": "csv", "xlsx": "xlsx", "xls": "xlsx", "xlsm": "xlsx", "json": "json", "parquet": "parquet", "orc": "orc", "yxdb": "yxdb"}

# Quotes in a csv value are doubled (RFC 4180), as pandas reads and writes them.
_QUOTES = {"quote": '"', "escape": '"'}
# What is written is all that is there, blanks at the ends too.
_WHOLE = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


class MissingDependency(RuntimeError):
    """A format that is not read."""


@dataclass(frozen=True)
class Location:
    path: str
    format: str
    sheet: str | None = None
    unc: bool = False


def locate(text: str, code: str | None = None) -> Location:
    """Path, sheet and format of a document's file entry. ``path|||sheet$`` names a sheet; a known extension decides before
    the format code, csv is the fallback; back slashes become slashes unless the path is a network share."""
    path, _, sheet = text.strip().partition("|||")
    sheet = sheet.strip("`$'\" ") or None
    unc = path.startswith("\\\\")
    if not unc:
        path = path.replace("\\", "/")
    extension = path.rsplit(".", 1)[-1].lower() if "." in os.path.basename(path.replace("\\", "/")) else ""
    return Location(path, _EXTENSIONS.get(extension) or _CODES.get(str(code), "csv"), sheet, unc)


def _json_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line is an object of its own; else the file is one document."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    try:
        return first is not None and isinstance(json.loads(first[0]), dict)
    except ValueError:
        return False


def clean(df: DataFrame) -> DataFrame:
    """NaN is null everywhere behind a scan."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(C.name(c), F.lit(None).cast(df.schema[c].dataType)) for c in floats}) if floats else df


def _found(spark: SparkSession, path: str) -> str | None:
    """``file`` or ``folder``, where the session looks for files and not only on the driver's disk."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return None if not files.exists(at) else "folder" if files.getFileStatus(at).isDirectory() else "file"


def read(spark: SparkSession, at: Location, *, schema: T.StructType | str | None = None, limit: int | None = None, delimiter: str = ",", header: bool = True, base: str = "", splittable: bool = False) -> DataFrame:
    """A lazy frame of the file. Csv types are inferred unless a schema is given; a limit of 0 or None is none. yxdb files are
    read from the parquet or csv file next to them, or from the folder that ``write`` makes. A csv file is read by one task, as quoted values may have line breaks;
    ``splittable`` divides it where there are none."""
    path = at.path if not base or "://" in at.path or os.path.isabs(at.path) else os.path.join(base, at.path)
    kind = at.format
    if kind == "yxdb":
        stem = path.rsplit(".", 1)[0]
        # a folder is what ``write`` has made of one; the format itself is not read
        kind, path = ("parquet", path) if _found(spark, path) == "folder" else ("parquet", f"{stem}.parquet") if _found(spark, f"{stem}.parquet") else ("csv", f"{stem}.csv")
    if kind == "csv":
        reader = spark.read.option("header", header).option("sep", delimiter).options(**_QUOTES, multiLine=not splittable)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    elif kind == "json":
        reader = spark.read.option("multiLine", not _json_lines(spark, path))
        df = (reader.schema(schema) if schema else reader).json(path)
    elif kind == "xlsx":
        if path.lower().endswith(".xls"):
            raise MissingDependency("the old binary format of Excel is not read")
        df = excel.read(spark, path, at.sheet)
    else:
        df = spark.read.format(kind).load(path)
    df = clean(df)
    return df.limit(limit) if limit else df


def text_input(spark: SparkSession, fields: Sequence[str], rows: Sequence[Sequence[str | None]]) -> DataFrame:
    """An inline table of texts; short rows are filled with nulls."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return spark.createDataFrame([tuple([*r, *[None] * len(fields)][: len(fields)]) for r in rows], schema)


def date_time_now(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.localtimestamp().alias("DateTimeNow"))


def directory(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(FullPath, FileName, Size, LastWriteTime) of the files, without reading them."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return reader.load(path).select(F.col("path").alias("FullPath"), F.element_at(F.split("path", "/"), -1).alias("FileName"), F.col("length").alias("Size"), F.col("modificationTime").alias("LastWriteTime"))


def dynamic_input(df: DataFrame, field: str, fmt: str = "parquet", block: int = 10_000) -> DataFrame:
    """The files named in a field as one frame with their names; a file that is named twice is read twice. The names go to the
    driver, which plans the scans, in scans of ``block`` files; their rows don't."""
    named = df.select(C.name(field).cast("string").alias("path")).where("path is not null").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    reader = df.sparkSession.read.option("header", True).option("inferSchema", True).options(**_QUOTES, multiLine=True) if fmt == "csv" else df.sparkSession.read
    rounds: dict[int, list[str]] = {}
    for r in named.toLocalIterator():
        for k in range(r["n"]):
            rounds.setdefault(k, []).append(r["path"])
    out = None
    for _, paths in sorted(rounds.items()):
        paths.sort()
        for at in range(0, len(paths), block):
            one = reader.format(fmt).load(paths[at : at + block]).withColumn("FileName", F.col("_metadata.file_path"))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no file is named")
    return out


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database; filters and projections on it are pushed down. Needs the driver's jar."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write(df: DataFrame, at: Location, *, mode: str = "overwrite", limit: int | None = None, single_file: bool = False, json_array: bool = False, partition_by: Sequence[str] = (), base: str = "") -> None:
    """Write the frame: a folder of part files, or one part with ``single_file``. yxdb becomes parquet."""
    path = at.path if not base or "://" in at.path or os.path.isabs(at.path) else os.path.join(base, at.path)
    df = df.limit(limit) if limit else df
    if at.format == "xlsx":
        excel.write(df, path, at.sheet)
        return
    if at.format == "json" and json_array:
        from weftline.operators.parse import json_build

        json_build(df).coalesce(1).write.mode(mode).text(path)
        return
    out = (df.coalesce(1) if single_file else df).write.mode(mode)
    if partition_by:
        out = out.partitionBy(*partition_by)
    if at.format == "csv":
        out.option("header", True).options(**_QUOTES, **_WHOLE).csv(path)
    else:
        out.format({"yxdb": "parquet"}.get(at.format, at.format)).save(path)
