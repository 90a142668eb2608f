"""Tool operators on small frames full of nulls, ties and repeats, and on none."""

import pickle
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.operators import joins, ordered, parse, pieces, prepare, spatial, transform
from weftline.operators.prepare import Choice
from weftline.operators.transform import Action
from weftline.sources import files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame([(1, "a", 10.0), (2, None, 20.0), (3, "a", None), (4, "b", 5.0), (5, None, None), (4, "b", 5.0)], "id int, k string, v double").repartition(3).sortWithinPartitions("id")


def test_select(few):
    say = []
    out = prepare.select(few, [Choice("v", rename="x", type="Int32"), Choice("*Unknown"), Choice("nope"), Choice("k", selected=False), Choice("id", type="V_String")], diagnostics=say)
    assert out.dtypes == [("x", "int"), ("id", "string")] and say == [("unresolved_field", "there is no field nope")]
    assert prepare.select(few, [Choice("k", selected=False)]).columns == few.columns and prepare.select(few, [Choice("id")], unknown=True).columns == ["id", "k", "v"]
    assert prepare.spark_type("FixedDecimal", 19, 2) == "decimal(19,2)" and prepare.spark_type("SpatialObj") == "string"


def test_summaries(few, spark):
    acts = [Action("v", "Sum"), Action("k", "GroupBy"), Action("id", "CountDistinct", "n"), Action("v", "First"), Action("v", "Last", "l"), Action("v", "CountNull", "e"), Action("k", "Nope"), Action("z", "Sum")]
    say = []
    out = transform.summarize(few, acts, [("id", True)], diagnostics=say)
    assert out.columns == ["Sum_v", "k", "n", "First_v", "l", "e"] and [c for c, _ in say] == ["unknown_action", "unresolved_field"]
    assert rows(out) == [(10.0, "a", 2, 10.0, 10.0, 1), (10.0, "b", 1, 5.0, 5.0, 0)]
    assert len(rows(transform.summarize(few, acts[:4], keep_null_keys=True))) == 3
    assert rows(transform.summarize(few, [Action("k", "GroupBy")])) == [("a",), ("b",), (None,)]
    assert rows(transform.summarize(few.where("id > 2 and v is null"), [Action("v", "Sum")])) == [(0.0,)]
    assert rows(transform.summarize(few.limit(0), [Action("v", "Sum"), Action("v", "Avg"), Action("id", "CountDistinct"), Action("v", "Median")])) == [(0.0, None, 0, None)]
    assert transform.summarize(few.limit(0), acts).count() == 0 and rows(transform.count_records(few)) == [(6,)]
    assert transform.summarize(few, []).columns == few.columns


def test_cross_tab_and_transpose(spark):
    df = spark.createDataFrame([("g", "x", 1.0), ("g", "x", 2.0), ("g", "y", None), ("h", "y", 4.0), (None, "x", 9.0), ("h", None, 9.0)], "g string, h string, d double")
    assert rows(transform.cross_tab(df, ["g"], "h", "d")) == [("g", 3.0, 0.0), ("h", None, 4.0)]
    assert rows(transform.cross_tab(df, ["g"], "h", "d", "Count")) == [("g", 2, 0), ("h", None, 1)]
    assert transform.cross_tab(df.dropna(subset=["g"]), [], "h", "d", "Max").collect()[0].asDict() == {"index": "d", "x": 2.0, "y": 4.0}
    assert rows(transform.cross_tab(df, ["g"], "h", "d", "concat")) == [("g", "1.0, 2.0", None), ("h", None, "4.0")]
    assert transform.cross_tab(df.limit(0), ["g"], "h", "d").count() == 0
    text = df.withColumn("d", F.col("d").cast("string"))
    say = []
    assert rows(transform.cross_tab(text, ["g"], "h", "d", diagnostics=say)) == [("g", 3.0, 0.0), ("h", None, 4.0)] and say
    with pytest.raises(ValueError):
        transform.cross_tab(df, ["g"], "h", "d", limit=1)
    assert rows(transform.transpose(df.limit(0), ["g"])) == []
    mixed = spark.createDataFrame([(1, "x", 2.5, None)], "k int, a string, b double, c int")
    assert rows(transform.transpose(mixed, ["k"])) == [(1, "a", "x"), (1, "b", "2.5"), (1, "c", None)]
    assert rows(transform.transpose(mixed, ["k"], ["b", "c", "gone"])) == [(1, "b", 2.5), (1, "c", None)]


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n"), (2, "y"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (3, "r")], "k int, v string")
    out = joins.join(a, b, [("k", "k")])
    assert out["Join"].columns == ["k", "v", "v_right"] and rows(out["Join"]) == [(1, "x", "p"), (None, "n", "q")]
    assert rows(out["Left"]) == [(2, "y"), (2, "y")] and rows(out["Right"]) == [(3, "r")]
    other = b.toDF("j", "w")
    assert joins.join(a, other, [("k", "j")])["Join"].columns == ["k", "v", "j", "w"]
    cross = joins.join(a, b, [])
    assert cross["Join"].count() == 12 and cross["Join"].columns == ["k", "v", "k_right", "v_right"] and cross["Left"].count() == 0
    text = a.withColumn("k", F.col("k").cast("string"))
    assert joins.join(text, b, [("k", "k")])["Join"].count() == 2
    empty = joins.join(a.limit(0), b, [("k", "k")])
    assert (empty["Join"].count(), empty["Left"].count(), empty["Right"].count()) == (0, 0, 3)
    side = joins.join_by_position(a, b, [("v", True)], [("v", True)])
    assert side["Join"].count() == 4 and side["Left"].count() == 1 and side["Right"].count() == 0
    assert rows(joins.join_multiple([a.distinct(), b.withColumnRenamed("v", "w"), spark.createDataFrame([(9, 1)], "k int, z int")])) == sorted([(1, "x", "p", None), (None, "n", "q", None), (2, "y", None, None), (3, None, "r", None), (9, None, None, 1)], key=str)
    with pytest.raises(ValueError):
        joins.join_multiple([a, other])
    assert joins.append_fields(a, b).columns == ["k_x", "v_x", "k_y", "v_y"]


def test_unions(spark):
    a, b = spark.createDataFrame([(1, "East")], "id int, region string"), spark.createDataFrame([("West", 5.5)], "region string, score double")
    assert joins.union([]) is None and joins.union([a]) is a
    assert joins.union([a, b]).columns == ["id", "region", "score"] and rows(joins.union([a, b])) == [(1, "East", None), (None, "West", 5.5)]
    assert rows(joins.union([a, b.select("region")], by_name=False)) == [("1", "East"), ("West", None)]
    with pytest.raises(ValueError):
        joins.union([b.select("region"), a], by_name=False)
    say = []
    assert rows(joins.union([a, a.withColumn("id", F.lit("z"))], diagnostics=say)) == [("1", "East"), ("z", "East")] and say


def test_find_replace_fuzzy_and_groups(spark):
    t = spark.createDataFrame([("cat",), ("concat",), (None,)], "s string")
    table = spark.createDataFrame([("cat", "DOG"), ("cat", "EEL"), (None, "x"), ("con", None)], "f string, r string")
    assert rows(joins.find_replace(t, table, "s", "f", "r")) == [("DOG",), ("concat",), (None,)]
    assert rows(joins.find_replace(t, table.where("r <> 'EEL'"), "s", "f", "r", mode="part")) == [("DOG",), ("conDOG",), (None,)]
    assert rows(joins.find_replace(t, table, "s", "f", append=["r"])) == [("cat", "DOG"), ("concat", None), (None, None)]
    names = ["john smith", "jon smith", "john smyth", "jane doe", "jane d", "x", "", None, "JOHN SMITH ", "y"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, n string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    texts = {}
    for i, n in enumerate(names):
        if n and n.strip():
            texts.setdefault(n.strip().lower(), i)
    for threshold in (0.6, 0.8, 0.9):
        want = {tuple(sorted((i, j))) for a, i in texts.items() for b, j in texts.items() if i < j and 1 - distance(a, b) / max(len(a), len(b)) >= threshold - 1e-12}
        assert {(r["id_left"], r["id_right"]) for r in joins.fuzzy_match(df, "id", "n", threshold=threshold).collect()} == want
    assert joins.fuzzy_match(df.limit(0), "id", "n").count() == 0
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (3, 3), (None, 4), (20, 20), *((i, i + 1) for i in range(100, 130)), (1, 2)], "a int, b int")
    groups = {r["member"]: r["group"] for r in joins.make_group(edges, "a", "b").collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 20: 20, **{i: 100 for i in range(100, 131)}}
    assert joins.make_group(edges.limit(0), "a", "b").count() == 0


def test_replacing_by_many_rules_is_the_same_as_one_after_the_other(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abc", k=rng.randrange(1, n)))
    rules = [(word(5), word(4) if rng.random() < 0.9 else None) for _ in range(120)] + [("", "x"), (None, "y")]
    texts = [word(20) for _ in range(200)] + [None, "", "zzz"]
    want = []
    for t in texts:
        for a, b in sorted({(a, b or "") for a, b in rules if a}, key=lambda r: (-len(r[0]), r)):
            t = t and t.replace(a, b)
        want.append(t)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string").repartition(3)
    table = spark.createDataFrame(rules, "f string, r string")
    for size in (joins.AUTOMATON_BYTES, 40):  # one block, and many
        monkeypatch.setattr(joins, "AUTOMATON_BYTES", size)
        assert [r["s"] for r in joins.find_replace(df, table, "s", "f", "r", mode="part").orderBy("id").collect()] == want
    # tens of thousands of rules
    many = spark.range(20_000).selectExpr("concat('key', id, ';') as f", "concat('<', id, '>') as r")
    assert joins.find_replace(spark.createDataFrame([("key7;key19999;key20000;",)], "s string"), many, "s", "f", "r", mode="part").first()[0] == "<7><19999>key20000;"


def test_rules_that_are_too_many_to_send_are_looked_up(spark, monkeypatch):
    # of two million rules of 90 MB neither the driver nor a task gets more than the filter, and the texts are the same
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(len(pickle.dumps(x))) or send(x))
    many = spark.range(2_000_000).selectExpr("concat('rule number ', id, ' of a large table;') as f", "concat('<', id, '>') as r").union(spark.createDataFrame([("<7>", "7;"), ("7;7", None), ("é", "e")], "f string, r string"))
    df = spark.createDataFrame([("é rule number 7 of a large table;7 rule number 1999999 of a large table;",), ("rule number 2000000 of a large table;",), (None,), ("",)], "s string")
    assert rows(joins.find_replace(df, many, "s", "f", "r", mode="part")) == [("",), ("e 7;7 <1999999>",), ("rule number 2000000 of a large table;",), (None,)]
    assert sent and sum(sent) < 20 << 20
    # rules that bring about others, and letters of several bytes
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("aé€😀", k=rng.randrange(1, n)))
    rules = [(word(7), word(4) if rng.random() < 0.9 else None) for _ in range(150)] + [("", "x"), (None, "y")]
    texts = [word(25) for _ in range(200)] + [None, "", "zzz"]
    want = []
    for t in texts:
        for a, b in sorted({(a, b or "") for a, b in rules if a}, key=lambda r: (-len(r[0]), r)):
            t = t and t.replace(a, b)
        want.append(t)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string").repartition(3)
    monkeypatch.setattr(joins, "SENT_BYTES", -1)
    assert [r["s"] for r in joins.find_replace(df, spark.createDataFrame(rules, "f string, r string"), "s", "f", "r", mode="part").orderBy("id").collect()] == want
    assert rows(joins.find_replace(df.where("s = 'zzz'"), spark.createDataFrame(rules, "f string, r string"), "s", "f", "r", mode="part").select("s")) == [("zzz",)]
    # no piece is lost where texts are cut into segments
    monkeypatch.setattr(pieces, "SEGMENT", 32)
    finds, texts = sorted({a for a, _ in rules if a}), [t or "" for t in texts]
    marks = pieces.marks(1 << 16)(iter([pa.RecordBatch.from_pydict({"a": finds})]))
    held = pieces.Filter({r["part"]: r["bits"] for b in marks for r in b.to_pylist()}, 1 << 16, {len(a.encode()) for a in finds})
    assert all({a for a in finds if a in t} <= found for t, found in zip(texts, held.pieces(texts), strict=True))


def test_fuzzy_rows_grow_with_the_length(spark):
    """Rows of a text in proportion to its length, and no pair lost at any threshold."""
    for threshold in (0.5, 0.6, 0.75, 0.8, 0.9, 0.97):
        for n in (20, 80, 160, 640):
            texts = spark.createDataFrame([(1, "ab" * (n // 2), n)], "id bigint, t string, n int")
            short, long = joins._pieces(texts, threshold)
            assert short.count() <= n * (1 - threshold) / threshold * 1.5 + 2 and long.count() <= 9 * n, (threshold, n, long.count())
    rng = random.Random(12)
    names = ["".join(rng.choices("ab", k=rng.randrange(1, 13))) for _ in range(70)]
    df = spark.createDataFrame(list(enumerate(names)), "id int, n string")
    texts = {t: min(i for i, x in enumerate(names) if x == t) for t in names}
    for threshold in (0.5, 0.67, 0.8, 0.9):
        want = {tuple(sorted((texts[a], texts[b]))) for a in texts for b in texts if a < b and 1 - _edits(a, b) / max(len(a), len(b)) >= threshold}
        assert {(r["id_left"], r["id_right"]) for r in joins.fuzzy_match(df, "id", "n", threshold=threshold).collect()} == want, threshold


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("order", [[("v", True), ("id", True)], [("v", False), ("id", False)]])
def test_large_groups_are_spread(spark, monkeypatch, order):
    """The same rows whether a group is one task or many."""
    rng = random.Random(13)
    data = [(i, rng.choice([None, "hot", "hot", "hot", "a", "b"]), rng.choice([None, *range(9)])) for i in range(300)]
    df = spark.createDataFrame(data, "id int, k string, v int").repartition(6)
    monkeypatch.setattr(ordered, "HOT_ROWS", 10**9)
    tools = {
        "total": lambda: ordered.running_total(df, "v", ["k"], order), "rank": lambda: ordered.rank(df, "v", ["k"], "rank", order[0][1]), "dense": lambda: ordered.rank(df, "v", ["k"], "dense", order[0][1]),
        "shift": lambda: ordered.multi_row_formula(df, "w", "[Row-2:id] * 1000 + [Row+1:id]", ["k"], order), "tile": lambda: ordered.tile(df, "id", 7, ["k"]), "sum": lambda: ordered.tile(df, "id", 5, ["k"], "equal_sum"),
        **{m: (lambda m=m: ordered.sample(df, m, 7, 30, ["k"], order)) for m in ("first", "last", "skip", "one_in", "first_pct")},
    }
    want = {name: (make().columns, rows(make())) for name, make in tools.items()}
    monkeypatch.setattr(ordered, "HOT_ROWS", 60)
    for name, make in tools.items():
        made = make()
        assert (made.columns, rows(made)) == want[name], name
    plan = ordered.running_total(df, "v", ["k"], order)._jdf.queryExecution().toString()
    assert "__part" in plan


def test_many_first_and_last_rows_come_by_number(spark, monkeypatch):
    """The same rows as by a top-k, and no plan that brings all rows into one task."""
    df = spark.range(0, 500, 1, 7).selectExpr("(id * 37) % 500 as v", "id")
    order = [("v", False)]
    want = {m: rows(ordered.sample(df, m, 40, order=order)) for m in ("first", "last")}
    assert want["first"][0][0] and len(want["last"]) == 40
    monkeypatch.setattr(ordered, "TOP_ROWS", 10)
    assert {m: rows(ordered.sample(df, m, 40, order=order)) for m in want} == want
    assert [r["v"] for r in ordered.sample(df, "skip", 490, order=order).collect()] == list(range(9, -1, -1))
    assert sorted(r["id"] for r in ordered.sample(df, "last", 12).collect()) == list(range(488, 500))
    drawn = ordered.sample(df, "random_pct", pct=30)
    assert drawn.count() == 150 == drawn.distinct().count() and drawn.join(df, ["v", "id"]).count() == 150
    for mode in ("first", "skip"):
        assert "SinglePartition" not in ordered.sample(df, mode, 40, order=order)._jdf.queryExecution().toString().split("Window")[0]


def test_rows_beyond_the_partition(spark):
    """Shifts over several partitions, empty ones among them, with and without an order."""
    n = 60
    df = spark.range(0, n, 1, 12).selectExpr("id", "id * id as q").where("id < 5 or id > 40")
    ids = [i for i in range(n) if i < 5 or i > 40]
    for order in ((), [("id", True)], [("id", False)]):
        seen = ids if not order or order[0][1] else ids[::-1]
        made = ordered.multi_row_formula(df, "w", "IIF(IsNull([Row-7:q]), 0 - 1, [Row-7:q])", (), order).withColumn("x", F.lit(1))
        assert {r["id"]: r["w"] for r in made.collect()} == {x: (seen[i - 7] ** 2 if i >= 7 else -1) for i, x in enumerate(seen)}
        after = ordered.multi_row_formula(df, "w", "[Row+1:id] - [Row-1:id]", (), order)
        assert {r["id"]: r["w"] for r in after.collect()} == {x: (seen[i + 1] - seen[i - 1] if 0 < i < len(seen) - 1 else None) for i, x in enumerate(seen)}


def test_own_results_of_many_rows(spark):
    """Folded in pieces: the same whatever the length."""
    df = spark.range(0, 2000, 1, 4).selectExpr("id", "id % 2 as k")
    made = ordered.multi_row_formula(df, "t", "IIF(IsNull([Row-1:t]), 0, [Row-1:t]) + [id] % 7", ["k"], [("id", True)])
    total, want = {0: 0, 1: 0}, {}
    for i in range(2000):
        total[i % 2] += i % 7
        want[i] = total[i % 2]
    assert {r["id"]: r["t"] for r in made.collect()} == want


def test_sides_are_measured_before_they_are_sent(spark):
    wide = spark.range(100).selectExpr("id", "repeat('x', 200000) as t")
    assert joins.small(spark.range(100).toDF("a")) and not joins.small(wide) and not joins.small(spark.range(11).toDF("a"), rows=10) and joins.small(wide.limit(0))


def test_order_dependent(few, spark):
    up = [("v", True), ("id", True)]
    assert [r["id"] for r in ordered.sort(few, [("v", False), ("id", True)]).collect()][:2] == [2, 1]
    numbered = ordered.record_id(few, order=up)
    assert numbered.columns[0] == "RecordID" and sorted(r[0] for r in numbered.collect()) == [1, 2, 3, 4, 5, 6]
    assert ordered.record_id(few.limit(0)).count() == 0
    assert rows(ordered.rank(few.select("id", "v"), "v").where("id in (4, 2, 5)")) == [(2, 20.0, 3), (4, 5.0, 1), (4, 5.0, 1), (5, None, 4)]
    assert {r["id"]: r["Rank"] for r in ordered.rank(few, "v", kind="rank").collect()} == {4: 1, 1: 3, 2: 4, 3: 5, 5: 5}
    total = {(r["id"]): r["RunningTotal"] for r in ordered.running_total(few, "v", order=up).collect()}
    assert total[1] == 20.0 and total[2] == 40.0 and total[3] is None and total[4] in (5.0, 10.0)
    assert {r["id"]: r["RunningTotal"] for r in ordered.running_total(few, "v", ["k"], up).collect()}[1] == 10.0
    parts = ordered.unique(few, ["k"], [("id", True)])
    assert rows(parts["Unique"].select("id", "k")) == [(1, "a"), (2, None), (4, "b")] and rows(parts["Duplicates"].select("id")) == [(3,), (4,), (5,)]
    back = ordered.unique(few, ["k"], [("id", False)])
    assert rows(back["Unique"].select("id")) == [(3,), (4,), (5,)] and back["Duplicates"].count() == 3
    everything = ordered.unique(few)
    assert everything["Unique"].count() == 5 and everything["Duplicates"].count() == 1
    assert [ordered.unique(few.limit(0), ["k"])[a].count() for a in ("Unique", "Duplicates")] == [0, 0]
    assert [r["id"] for r in ordered.sample(few, "last", 2, order=[("id", True)]).collect()] == [4, 5]
    assert ordered.sample(few, "random_n", 4).count() == 4 and ordered.sample(few, "random_pct", pct=50).count() == 3
    assert ordered.sample(few, "first_pct", pct=50, order=up).count() == 3 and ordered.sample(few, "first", 1, group=["k"], order=up).count() == 3
    assert rows(ordered.sample(few, "random_n", 1, group=["k"]).select("k")) == [("a",), ("b",), (None,)]
    assert ordered.sample(few, "skip", 4, order=up).count() == 2 and ordered.sample(few, "one_in", 4, order=up).count() == 2
    assert [r["id"] for r in ordered.select_records(few.select("id"), "1,5+", [("id", True)]).orderBy("id").collect()] == [1, 4, 5]
    pieces = ordered.create_samples(few)
    assert sum(p.count() for p in pieces.values()) == 6
    assert {r["id"]: r["Tile_Num"] for r in ordered.tile(few.where("v is not null").distinct(), "v", 2).collect()} == {4: 1, 1: 1, 2: 2}
    assert {r["Tile_Num"] for r in ordered.tile(few, "v", 2, method="width").collect()} == {1, 2, None}
    assert ordered.tile(few.limit(0), "v", 3).count() == 0


def test_multi_row(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(1, 5)] + [("b", 1, None), ("b", 2, 7.0)], "g string, n int, v double").repartition(3)
    by = [("n", True)]
    assert {(r["g"], r["n"]): r["d"] for r in ordered.multi_row_formula(df, "d", "[v] - [Row-1:v]", ["g"], by).collect()} == {("a", 1): None, ("a", 2): 1.0, ("a", 3): 1.0, ("a", 4): 1.0, ("b", 1): None, ("b", 2): None}
    running = ordered.multi_row_formula(df, "t", "IIF(IsNull([Row-1:t]), 0, [Row-1:t]) + IIF(IsNull([v]), 0, [v])", ["g"], by)
    assert {(r["g"], r["n"]): r["t"] for r in running.collect()} == {("a", 1): 1.0, ("a", 2): 3.0, ("a", 3): 6.0, ("a", 4): 10.0, ("b", 1): 0.0, ("b", 2): 7.0}
    whole = ordered.multi_row_formula(df.where("g = 'a'"), "x", "[Row+2:n]", (), by)
    assert {r["n"]: r["x"] for r in whole.collect()} == {1: 3, 2: 4, 3: None, 4: None}
    assert prepare.filter_rows(df.where("g = 'a'"), "[v] > [Row-1:v]", by)["True"].count() == 3


def test_cleansing_and_typing(spark):
    df = spark.createDataFrame([("  x y ", "1", 1.0), (None, "2", None), ("it's", "z", 3.0)], "s string, n string, v double")
    assert rows(prepare.cleanse(df, ["s"], remove_whitespace=True, case="upper")) == sorted([("XY", "1", 1.0), (None, "2", None), ("IT'S", "z", 3.0)], key=str)
    assert prepare.cleanse(df).count() == 2 and prepare.cleanse(df, ["s", "v"], replace_null=True).where("s = '' and v = 0").count() == 1
    assert rows(prepare.cleanse(df, ["s"], remove="punctuation", case="title").select("s")) == [("Its",), ("X Y",), (None,)]
    typed = prepare.auto_field(df.select(F.col("v").cast("string").alias("d"), "s", F.lit("7").alias("i"), F.lit("true").alias("b"), F.lit("2024-01-02").alias("t"), F.lit(None).cast("string").alias("none")))
    assert [k for _, k in typed.dtypes] == ["double", "string", "bigint", "boolean", "date", "string"]
    assert prepare.dynamic_select(df, ["num"]).columns == ["v"] and prepare.dynamic_select(df, pattern="[sn]").columns == ["s", "n"]
    assert prepare.dynamic_rename(df.toDF(" s", "n ", "v"), prefix="p_", names={"v": "w"}).columns == ["p_s", "p_n", "p_w"]
    assert rows(prepare.field_info(df))[0] == ("n", "string")
    assert rows(prepare.generate_rows(spark, "i", 5, 1, -2)) == [(1,), (3,), (5,)]
    assert prepare.binning(df, ["v"], 2, "equal_records").where("v is null and v_Tile_Num is null").count() == 1
    assert rows(prepare.multi_field_formula(df.select("s", "n"), ["s", "n"], "Length([_CurrentField_])", prefix="len_").select("len_s", "len_n")) == sorted([(6, 1), (None, 1), (4, 1)], key=str)
    assert rows(prepare.arrange(df.limit(1), ["v"], {"o": ["s", "n"], "p": ["n"]})) == sorted([(1.0, "  x y ", "1"), (1.0, "1", None)], key=str)


def test_parsing(spark):
    df = spark.createDataFrame([(1, "a,b", "2024-02-30", '{"k": {"x": [1, null]}, "s": "t"}', "<r><c n='1'>u</c><c>v<b>w</b></c></r>"), (2, None, None, None, None), (3, "", "x", "{bad", "<r>"), (4, "c", "2024-02-03", "[]", "<r/>")], "id int, s string, d string, j string, x string")
    assert rows(parse.text_to_columns(df.select("id", "s"), "s", ",")) == sorted([(1, "a,b", "a", "b"), (2, None, None, None), (3, "", "", None), (4, "c", "c", None)], key=str)
    assert rows(parse.text_to_columns(df.select("id", "s"), "s", "[,c]", 2).where("id in (1, 4)").select("s_0", "s_1")) == [("", ""), ("a", "b")]
    assert parse.text_to_columns(df.select("id", "s"), "s", ",", to_rows=True).count() == 5
    assert [str(r[0]) for r in parse.date_time(df.orderBy("id"), "d").select("d_Out").collect()] == ["None", "None", "None", "2024-02-03 00:00:00"]
    assert rows(parse.json_parse(df.select("id", "j"), "j", name="n", value="v")) == sorted([(1, "k.x.0", "1"), (1, "k.x.1", None), (1, "s", "t")], key=str)
    assert rows(parse.regex(df.select("s"), "s", r"(?P<first>\w),(\w)")) == sorted([("a,b", "a", "b"), (None, None, None), ("", None, None), ("c", None, None)], key=str)
    assert rows(parse.regex(df.select("s"), "s", "A", "match", ignore_case=True).select("s_Matched")) == [(False,), (False,), (False,), (True,)]
    assert rows(parse.regex(df.select("s"), "s", "[ab]", "tokenize").select("s_0", "s_1"))[-1] == (None, None)
    assert rows(parse.xml_parse(df.select("id", "x"), "x", {"c": "c", "n": "c/@n"}).select("id", "c", "n")) == sorted([(1, "u", "1"), (2, None, None), (3, None, None), (4, None, None)], key=str)
    assert rows(parse.xml_parse(df.select("id", "x"), "x", {"t": ""}, rows="c").select("id", "t")) == [(1, "u"), (1, "vw")]
    built = parse.json_build(df.select("id", "s").where("id < 3")).first()[0]
    assert '"s":null' in built and built.startswith("[")


def test_spatial(spark):
    df = spatial.create_points(spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 179.99, 10.0), (4, None, 1.0), (5, 100.0, 89.0)], "id int, x double, y double"), "x", "y", "p")
    assert df.where("p is null").count() == 1
    d = spatial.distance(df.where("id = 1").withColumn("q", F.struct(F.lit(0.0).alias("lon"), F.lit(1.0).alias("lat"))), "p", "q").first()["Distance"]
    assert abs(d - 111.195) < 0.01
    near = spatial.find_nearest(df, df.where("id <> 1").withColumnRenamed("id", "o"), "id", "p", "o", "p", 150)
    assert {(r["id"], r["nearest_o"]) for r in near["Matched"].collect()} == {(1, 2), (2, 2), (3, 3), (5, 5)} and rows(near["Unmatched"].select("id")) == [(4,)]
    assert spatial.make_grid(df.where("id < 3"), "p", 0.5).count() == 3 and spatial.make_grid(df.limit(0), "p", 1.0).count() == 0


def test_files(spark, tmp_path):
    assert files.locate(r"C:\d\x.xlsx|||Sheet1$", "0") == files.Location("C:/d/x.xlsx", "xlsx", "Sheet1")
    assert files.locate(r"\\srv\d\x.csv").unc and files.locate("x.unknown", "25").format == "yxdb" and files.locate("x").format == "csv"
    df = spark.createDataFrame([(1, "a", float("nan")), (2, "b", 2.0)], "i int, s string, v double")
    for name in ("t.csv", "t.json", "t.parquet", "t.orc"):
        at = files.locate(str(tmp_path / name))
        files.write(df.fillna(0.0), at, single_file=True)
        assert files.read(spark, at).count() == 2, name
    files.write(df, files.locate(str(tmp_path / "n.parquet")))
    assert files.read(spark, files.locate(str(tmp_path / "n.parquet"))).where("v is null").count() == 1
    files.write(df, files.locate(str(tmp_path / "y.yxdb")), limit=1)
    assert spark.read.parquet(str(tmp_path / "y.yxdb")).count() == 1
    files.write(df.select("i"), files.locate(str(tmp_path / "a.json")), json_array=True)
    assert files.read(spark, files.locate(str(tmp_path / "a.json"))).count() == 2
    files.write(df, files.locate(str(tmp_path / "part.parquet")), partition_by=["s"])
    assert files.read(spark, files.locate(str(tmp_path / "part.parquet"))).where("s = 'a'").count() == 1
    assert files.read(spark, files.locate(str(tmp_path / "t.csv")), limit=1).count() == 1 and files.directory(spark, str(tmp_path / "t.csv")).count() >= 1
    assert rows(files.text_input(spark, ["a", "b"], [["1"], ["2", ""]])) == [("1", None), ("2", "")]
    with pytest.raises(files.MissingDependency):  # workbooks of today are in test_excel
        files.read(spark, files.locate("x.xls"))
