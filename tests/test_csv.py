"""Csv with quotes and line breaks in values."""

from weftline.sources import files


def test_csv_round_trip(spark, tmp_path):
    texts = ['two\nlines', 'he said "no", twice', '"', 'back\\slash', 'ends in \\', '\n', ' blanks ', 'a,b', 'x\r\ny', '""\n"']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").repartition(2)
    at = files.locate(str(tmp_path / "t.csv"))
    files.write(df, at)
    assert [r["s"] for r in files.read(spark, at).orderBy("i").collect()] == texts
    (tmp_path / "p.csv").write_text('i,s\n1,"a ""quoted"" word\nand a line"\n2,plain\n')
    want = [(1, 'a "quoted" word\nand a line'), (2, "plain")]
    assert [tuple(r) for r in files.read(spark, files.locate(str(tmp_path / "p.csv"))).collect()] == want
    named = spark.createDataFrame([(str(tmp_path / "p.csv"),)], "path string")
    assert [tuple(r)[:2] for r in files.dynamic_input(named, "path", "csv").collect()] == want
    (tmp_path / "q.csv").write_text("i,s\n1,a\n2,b\n")
    assert files.read(spark, files.locate(str(tmp_path / "q.csv")), splittable=True).count() == 2
