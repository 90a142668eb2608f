"""Nearest points over the date line and the poles, against all pairs."""

import math
import random

from weftline.operators import spatial


def km(a, b):
    (x, y), (u, v) = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
    return 2 * spatial.EARTH_KM * math.asin(min(1, math.sqrt(h)))


def test_nearest_over_the_date_line_and_poles(spark):
    draw = random.Random(1)
    place = lambda: draw.choice([(draw.choice([-180, 180, draw.uniform(178, 180), draw.uniform(-180, -178)]), draw.uniform(-2, 2)), (draw.uniform(-180, 180), draw.choice([-1, 1]) * draw.uniform(88.5, 90)), (draw.uniform(-2, 2), draw.uniform(-2, 2))])
    a, b = ([place() for _ in range(n)] for n in (60, 80))
    a.append((179.95, 10.0))
    b.append((-179.95, 10.0))
    frame = lambda points, key: spatial.create_points(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], f"{key} int, x double, y double"), "x", "y", "p").select(key, "p")
    for most in (30, 5000):
        made = spatial.find_nearest(frame(a, "i"), frame(b, "j"), "i", "p", "j", "p", most)
        got = {r["i"]: round(r["DistanceKm"], 6) for r in made["Matched"].collect()}
        want = {i: round(d, 6) for i, p in enumerate(a) if (d := min(km(p, q) for q in b)) <= most}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want) and 60 in want
        assert {r["i"] for r in made["Unmatched"].collect()} == set(range(len(a))) - want.keys()
