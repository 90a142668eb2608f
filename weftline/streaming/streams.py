"""Streams through the same operators.

Row-by-row tools (select, filter, formula, cleansing, parsing, union) take a streaming frame as it is; a workflow
compiles over one when its source is replaced by it. Windows of events with late rows are the one stateful form.
Checkpoints lie in the folder the cluster names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weftline.functions import columns as C
from weftline.session import ensure_checkpoint_dir


def read_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_trigger).load(path)


def windowed(df: DataFrame, at: str, size: str, aggregates: Sequence, keys: Sequence[str] = (), *, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates per window and keys; rows later than ``late`` behind the newest are left out, as the state is let go."""
    stamped = df.withColumn("__at", C.name(at).cast("timestamp")).withWatermark("__at", late)
    window = F.window("__at", size, slide) if slide else F.window("__at", size)
    out = stamped.groupBy(window, *[C.name(k) for k in keys]).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def sessions(df: DataFrame, at: str, gap: str, aggregates: Sequence, keys: Sequence[str] = (), *, late: str = "10 minutes") -> DataFrame:
    """Aggregates per session of the keys: rows no further apart than ``gap``; rows later than ``late`` are left out."""
    stamped = df.withColumn("__at", C.name(at).cast("timestamp")).withWatermark("__at", late)
    out = stamped.groupBy(F.session_window("__at", gap).alias("window"), *[C.name(k) for k in keys]).agg(*aggregates)
    return out.select(F.col("window.start").alias("session_start"), F.col("window.end").alias("session_end"), *[c for c in out.columns if c != "window"])


def run(df: DataFrame, sink: Callable[[DataFrame, int], None], name: str, *, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """Each micro-batch to a function. With ``available_now`` the query ends when it has taken all there is."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/stream-{name}"
    writer = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", folder).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
