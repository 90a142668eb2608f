"""Streams give what the same operators give on a whole frame."""

import datetime as dt

from pyspark.sql import functions as F

from weftline.operators.prepare import filter_rows, formula
from weftline.plans.compiler import compile_workflow
from weftline.plans.document import load
from weftline.streaming.streams import read_files, run, windowed


def test_row_tools_and_windows(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), float(i)) for i in range(30)]
    whole = spark.createDataFrame(rows, "id int, at timestamp, v double")
    for part in range(3):
        whole.where(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_files(spark, str(tmp_path / "in"), whole.schema, per_trigger=1)
    got = []
    out = formula(filter_rows(stream, "[v] > 10")["True"], [("w", "[v] * 2")])
    run(out, lambda df, _: got.extend(map(tuple, df.collect())), "rows").awaitTermination(120)
    assert sorted(got) == sorted(tuple(r) for r in formula(filter_rows(whole, "[v] > 10")["True"], [("w", "[v] * 2")]).collect())
    counts = {}
    run(windowed(stream, "at", "10 minutes", [F.count(F.lit(1)).alias("n")], late="1 hour"), lambda df, _: counts.update({r["window_start"]: r["n"] for r in df.collect()}), "counts", mode="update").awaitTermination(120)
    assert sorted(counts.values()) == [10, 10, 10]


def test_workflow_over_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string").coalesce(1).write.parquet(str(tmp_path / "in"))
    xml = '<Doc><Nodes><Node ToolID="1"><GuiSettings Plugin="X.DbFileInput"/></Node><Node ToolID="2"><GuiSettings Plugin="X.Filter"/><Properties><Configuration><Expression>[s] = "b"</Expression></Configuration></Properties></Node></Nodes><Connections><Connection><Origin ToolID="1" Connection="Output"/><Destination ToolID="2" Connection="Input"/></Connection></Connections></Doc>'
    stream = read_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    done = compile_workflow(load(xml.encode()), spark, inputs={1: stream})
    got = []
    run(done.frame(2, "True"), lambda df, _: got.extend(map(tuple, df.collect())), "flow").awaitTermination(120)
    assert got == [(2, "b")]
