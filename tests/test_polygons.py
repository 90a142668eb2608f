"""Polygons on small frames with nulls, repeats and none, and against brute force."""

import math
import random

from pyspark.sql import functions as F

from weftline.operators import polygons as P
from weftline.plans.compiler import compile_workflow
from weftline.plans.document import load

POINT = "struct<lon: double, lat: double>"
SQUARE = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]]  # with a hole


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def crosses(x, y, ring):
    n = len(ring)
    return sum((ring[i][1] > y) != (ring[(i + 1) % n][1] > y) and x < (ring[(i + 1) % n][0] - ring[i][0]) * (y - ring[i][1]) / (ring[(i + 1) % n][1] - ring[i][1]) + ring[i][0] for i in range(n))


def test_match_against_brute_force(spark):
    rng = random.Random(21)
    shapes = [(i, [[(rng.uniform(-20, 20) + rng.uniform(0, s), rng.uniform(-20, 20) + rng.uniform(0, s)) for _ in range(rng.randrange(3, 8))] for s in (0.1, 5.0)][: rng.randrange(1, 3)]) for i in range(25)]
    shapes += [(100, SQUARE), (101, None), (102, []), (103, [[(1.0, 1.0), (2.0, 2.0)]])]
    points = [(i, (rng.uniform(-25, 25), rng.uniform(-25, 25))) for i in range(400)] + [(900, (1.5, 1.5)), (901, (3.0, 3.0)), (901, (3.0, 3.0)), (902, None)]
    t = spark.createDataFrame(points, f"id int, p {POINT}").repartition(4)
    u = spark.createDataFrame(shapes, f"id int, area {P.POLYGON}")
    made = P.spatial_match(t, u, "p", "area")
    want = sorted(((i, k) for i, p in points if p for k, rings in shapes if rings and sum(len(r) for r in rings) > 2 and sum(crosses(*p, r) for r in rings) % 2), key=str)
    assert rows(made["Matched"].select("id", "id_right")) == want and (900, 100) not in want and want.count((901, 100)) == 2
    assert rows(made["Unmatched"].select("id")) == sorted(((i,) for i, p in points if i not in {a for a, _ in want}), key=str)
    assert P.spatial_match(t, u.limit(0), "p", "area")["Matched"].count() == 0 and P.spatial_match(t.limit(0), u, "p", "area")["Unmatched"].count() == 0


def test_shapes_of_points(spark):
    t = spark.createDataFrame([(1, (10.0, 50.0)), (2, None)], f"id int, p {POINT}")
    made = P.buffer(t, "p", 100, corners=8).orderBy("id").collect()
    assert len(made[0]["Buffer"][0]) == 8 and made[1]["Buffer"] is None and made[0]["Buffer"][0][0]["lat"] > 50.8
    areas = P.trade_area(t, "p", [5, 1, 5])
    assert rows(areas.select("id", "Radius", F.size("TradeArea"))) == sorted([(1, 1.0, 1), (1, 5.0, 2), (2, 1.0, -1), (2, 5.0, -1)], key=str) or rows(areas.select("id", "Radius", F.size("TradeArea"))) == sorted([(1, 1.0, 1), (1, 5.0, 2), (2, 1.0, None), (2, 5.0, None)], key=str)
    s = spark.createDataFrame([("a", 3, (0.0, 1.0)), ("a", 1, (0.0, 0.0)), ("a", 2, (1.0, 0.0)), ("a", 4, None), ("b", 1, (0.0, 0.0)), (None, 1, (0.0, 0.0))], f"k string, n int, p {POINT}").repartition(3)
    built = P.poly_build(s, "p", ["k"], [("n", True)])
    assert {r["k"]: r["Polygon"] and [tuple(p) for p in r["Polygon"][0]] for r in built.collect()} == {"a": [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], "b": None, None: None}
    assert P.poly_split(built, "Polygon").count() == 3


def test_measures_and_outlines(spark):
    df = spark.createDataFrame([(1, SQUARE), (2, None)], f"id int, g {P.POLYGON}")
    info = P.spatial_info(df, "g").orderBy("id").collect()
    degree = math.radians(1) * 6371.0088
    assert abs(info[0]["AreaKm2"] - 15 * degree**2) < 0.002 * 15 * degree**2 and info[0]["Points"] == 8 and tuple(info[0]["Center"]) == (2.0, 2.0) and info[1]["AreaKm2"] is None
    smooth = P.smooth(df, "g", 2).orderBy("id").collect()
    assert len(smooth[0]["g"][0]) == 16 and smooth[1]["g"] is None
    wavy = [[(i / 100, 0.001 * (i % 2)) for i in range(100)] + [(1.0, 1.0), (0.0, 1.0)]]
    simple = P.generalize(spark.createDataFrame([(1, wavy), (2, None)], f"id int, g {P.POLYGON}"), "g", 0.01).orderBy("id").collect()
    assert len(simple[0]["g"][0]) <= 6 and simple[1]["g"] is None
    two = df.withColumn("h", F.transform("g", lambda r: F.transform(r, lambda q: F.struct((q["lon"] + 3).alias("lon"), q["lat"]))))
    both = P.spatial_process(two, "g", "h", "intersect").orderBy("id").collect()
    assert sorted(map(tuple, both[0]["Processed"][0])) == [(3.0, 0.0), (3.0, 4.0), (4.0, 0.0), (4.0, 4.0)] and both[1]["Processed"] is None
    assert [len(r["Processed"]) for r in P.spatial_process(two, "g", "h").orderBy("id").collect()] == [4, 0]


def test_tools_of_a_document(spark):
    node = lambda i, kind, config="": f'<Node ToolID="{i}"><GuiSettings Plugin="X.{kind}.{kind}"/><Properties><Configuration>{config}</Configuration></Properties></Node>'
    wire = lambda a, b, x="", y="": f'<Connection><Origin ToolID="{a}" Connection="{x}"/><Destination ToolID="{b}" Connection="{y}"/></Connection>'
    nodes = [node(1, "TextInput"), node(2, "CreatePoints", "<FieldX>x</FieldX><FieldY>y</FieldY>"), node(3, "Buffer", "<SpatialField>Centroid</SpatialField><Distance>300</Distance>"), node(4, "SpatialMatch", "<TargetField>Centroid</TargetField><UniverseField>Buffer</UniverseField>"), node(5, "SpatialInfo", "<SpatialField>Buffer</SpatialField>")]
    flow = load(f'<Doc yxmdVer="1"><Nodes>{"".join(nodes)}</Nodes><Connections>{wire(1, 2)}{wire(2, 3)}{wire(2, 4, "", "Targets")}{wire(3, 4, "", "Universe")}{wire(3, 5)}</Connections></Doc>'.encode())
    done = compile_workflow(flow, spark, inputs={1: spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 90.0, 0.0)], "id int, x double, y double")})
    assert not done.blocked
    assert rows(done.frame(4, "Matched").select("id", "id_right")) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)] and done.frame(4, "Unmatched").count() == 0
    assert all(abs(r[0] / (math.pi * 300**2) - 1) < 0.02 for r in done.frame(5).select("AreaKm2").collect())
