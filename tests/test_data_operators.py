"""Terms, flattening, references, hierarchies and drift against brute force, and their edge cases."""

import itertools
import json
import math
import random
import re
import xml.etree.ElementTree as ET
from collections import Counter, defaultdict
from datetime import date, datetime
from functools import reduce

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.drift import HeaderReader, drift_of_records, fits, read_drifting
from weftline.operators.flatten import explode_arrays, flatten_texts
from weftline.operators.hierarchy import container_links, descendants, resolve_forest
from weftline.operators.lattice import Seen
from weftline.operators.references import Parents, References, find_orphans, orphan_report
from weftline.operators.terms import BurstTrie, count_terms, mark_terms


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- terms ------------------------------------------------------------------------------------------


def brute_terms(data):
    occ, rec = Counter(), defaultdict(set)
    for key, value in data:
        if value is None:
            continue
        t = value.strip(" \t\r\n").lower()
        if t:
            occ[t] += 1
            if key is not None:
                rec[t].add(key)
    return sorted(((t, n, len(rec[t])) for t, n in occ.items()), key=str)


def test_burst_trie_counts_whatever_bursts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abä数") for _ in range(rng.randrange(0, 9))) for _ in range(3000)]
    trie = BurstTrie(burst=4)
    for t in texts:
        trie.add(t, 1, 2)
    found = Counter()
    for prefix, suffixes, occ, rec in trie.subtrees():
        assert suffixes == sorted(suffixes)
        for s, o, r in zip(suffixes, occ, rec, strict=True):
            assert r == 2 * o
            found[prefix + s] += o
    assert found == Counter(texts)


def test_burst_trie_of_long_shared_prefixes():
    rng = random.Random(5)
    shared = "https://www.example.test/" + "very/long/path/" * 40
    texts = [shared + str(rng.randrange(900)) for _ in range(4000)] + [shared[: rng.randrange(len(shared))] for _ in range(300)] + ["", shared]
    trie = BurstTrie(burst=8)
    new = sum(trie.add(t, 1, 1) for t in texts)
    found = Counter()
    for prefix, suffixes, occ, _ in trie.subtrees():
        for s, o in zip(suffixes, occ, strict=True):
            found[prefix + s] += o
    assert found == Counter(texts) and new == len(found)


def test_terms_that_share_a_long_prefix_are_divided(spark):
    """No route takes them all, though no prefix of 64 characters tells them apart."""
    from weftline.operators import terms as m

    shared = "x" * 100
    data = [(i % 7, shared + str(i % 500)) for i in range(3000)]
    df = spark.createDataFrame(data, "w int, v string").repartition(4)
    counts = count_terms([(df, "w", {"a": "v"})], route_entries=50, routes=1000, plant=200)
    found = {r["term"]: (r["occurrences"], r["records"]) for r in counts.collect()}
    assert found == {shared + str(i): (6, len({k % 7 for k in range(i, 3000, 500)})) for i in range(500)}
    routes = m.Routes({("a", "x" * d): 500 for d in range(m.MAX_PREFIX + 1)}, 1, 50)
    assert routes.of("a", shared) == ("x" * m.MAX_PREFIX, 10) and routes.of("a", "xy") == ("xy", 1) and routes.of("a", "x") == ("x\x00", 1)


@pytest.mark.parametrize("limits", [{}, {"burst": 2, "route_entries": 5, "routes": 1000}, {"burst": 3, "route_entries": 4, "routes": 2, "plant": 20}])
def test_terms_against_brute_force(spark, limits):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(60)] + ["hot"] * 60
    data = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, "", "  ", *words, " Abc\t", "ABC\n", "x" * 5000])) for _ in range(900)]
    df = spark.createDataFrame(data, "w int, v string").withColumn("field", F.lit("clash")).withColumn("term", F.lit("clash")).repartition(5)
    counted = count_terms([(df, "w", {"v": "v"})], **limits)
    assert rows(counted.select("term", "occurrences", "records")) == brute_terms(data)


def test_term_marks_and_empty_tables(spark):
    df = spark.createDataFrame([(i, v) for i in range(10) for v in (["all"] + (["few"] if i < 2 else []) + (["mid"] if i in (3, 4, 5) else []))] + [(0, "few")], "w int, v string")
    all_w = spark.createDataFrame([(i % 15,) for i in range(40)] + [(None,)], "w int")
    marks = {r["term"]: r["mark"] for r in mark_terms(count_terms([(df, "w", {"v": "v"})]), all_w).collect()}
    assert marks == {"all": "common", "few": "rare", "mid": None}
    assert count_terms([(df.limit(0), "w", {"v": "v"})]).count() == 0


# --- flattening -------------------------------------------------------------------------------------


def brute_xml(text):
    try:
        root = ET.fromstring(text)
    except (ET.ParseError, TypeError):
        return []
    out = []

    def walk(e, path, up):
        out.append((path, up))
        seen = Counter()
        for c in e:
            seen[c.tag] += 1
            walk(c, f"{path}/{c.tag}[{seen[c.tag]}]", path)

    walk(root, f"/{root.tag}", "")
    return out


def brute_json(text):
    try:
        value = json.loads(text)
        while isinstance(value, str):
            value = json.loads(value)
    except (ValueError, TypeError):
        return []
    out = []

    def walk(v, path, up):
        if isinstance(v, dict):
            out.append((path, up))
            for k, x in v.items():
                walk(x, f"{path}.{k}", path)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", up)

    walk(value, "$", "")
    return out


XMLS = [
    None, "", "  ", "<a/>", "<a><b/><c/><b><b/></b></a>", "<a>", "text", "<a><!-- <x/> --><![CDATA[<y/>]]></a>", '<?xml version="1.0"?><a b="1">t<c/>u<c/></a>',
    " <a/>", "<a/> ", "<a/><b/>", "<a>&amp;&#65;</a>", "<a>&nope;</a>", "<a b='1' b='2'/>", "<ä><数/></ä>", "<a>" + "<b>" * 300 + "</b>" * 300 + "</a>", "<a>" + "<b/>" * 3000 + "</a>",
]
JSONS = [
    None, "", " ", "null", "5", '"x"', "[]", "{}", '{"a": {}}', '{"a": [{"b": {}}, [{}], 3, null]}', '[{"x": 1}, [{"y": [{}]}]]', json.dumps(json.dumps({"a": [{}]})), '{"a": ', '{"a": NaN}',
    '{"k.1": {"": {}}}', '{"a": "[5]", "b": "{broken"}', ' {"a": {}} ', '{"a": {}} x', "[" * 200 + "{}" + "]" * 200, '{"é": {"数": {}}}',
]


def test_flatten_against_brute_force(spark):
    data = [(i, x, j) for i, (x, j) in enumerate(zip((XMLS * 2)[: len(JSONS)], JSONS, strict=True))] + [(None, "<a/>", "{}"), (3, "<a/>", "{}")]
    df = spark.createDataFrame(data, "k bigint, x string, j string").withColumn("origin", F.lit("clash")).withColumn("node_path", F.lit(1))
    want = [(k, "xml", p, u) for k, x, _ in data for p, u in brute_xml(x)] + [(k, "json", p, u) for k, _, j in data for p, u in ([] if j and "NaN" in j else brute_json(j))]
    found = flatten_texts(df, "k", {"xml": ("x", "xml"), "json": ("j", "json")})
    assert rows(found) == sorted(want, key=str)
    assert flatten_texts(df.limit(0), "k", {"xml": ("x", "xml")}).count() == 0


def test_deep_json():
    from weftline.operators.flatten import _decode_deep, load_json

    for good in JSONS[3:] + ['[1, -2.5e3, "a\\n\\u00e9", true, false, null, {"a": []}]', ' { "a" : [ 1 , 2 ] , "b" : { } } ']:
        try:
            want = json.loads(good, parse_int=str, parse_float=str, parse_constant=lambda c: 1 / 0)
        except (ValueError, ZeroDivisionError):
            with pytest.raises(ValueError):
                _decode_deep(good)
        else:
            assert _decode_deep(good) == want
    for bad in ("", "[", "[1,]", '{"a"}', '{"a":1,}', "{1:2}", "[1 2]", "tru", "01", '"a', "[]]"):
        with pytest.raises(ValueError):
            _decode_deep(bad)
    deep = 60_000
    value = load_json("[" * deep + "{}" + "]" * deep)
    depth = 0
    while isinstance(value, list):
        value, depth = value[0], depth + 1
    assert depth == deep and value == {}


def test_explode_arrays(spark):
    df = spark.createDataFrame([(1, [("a", 1), ("b", None)]), (2, []), (3, None), (4, [None, ("c", 2)]), (1, [("a", 1)])], "k int, v array<struct<name:string,k:int>>")
    assert rows(explode_arrays(df, "k", "v")) == sorted([(1, 0, "a", 1), (1, 1, "b", None), (4, 0, None, None), (4, 1, "c", 2), (1, 0, "a", 1)], key=str)
    assert explode_arrays(df, "k", "v").columns == ["k", "place", "name", "v_k"]
    plain = spark.createDataFrame([(1, [3, None])], "k int, v array<int>")
    assert rows(explode_arrays(plain, "k", "v")) == [(1, 0, 3), (1, 1, None)]


# --- references -------------------------------------------------------------------------------------


def t(day):
    return None if day is None else datetime(2024, 1, day)


def test_orphans(spark):
    refs = [(1, 1, 10, t(5)), (1, 1, 10, t(3)), (2, 1, 11, t(5)), (3, 1, 12, t(5)), (4, 1, 99, t(5)), (5, None, 10, t(5)), (6, 1, None, t(5)), (7, 2, 10, t(5)), (8, 1, -1, t(9)), (9, 1, 11, None), (10, 1, 13, t(2))]
    held = [(1, 10, t(4), None), (1, 10, t(8), None), (1, 11, t(1), t(5)), (1, 11, t(1), t(9)), (1, 12, t(1), t(6)), (None, 10, t(1), None), (1, 13, None, None), (1, None, t(1), None)]
    r = spark.createDataFrame(refs, "id int, w int, k bigint, at timestamp_ntz").withColumn("reason", F.lit("clash"))
    p = spark.createDataFrame(held, "w int, k bigint, at timestamp_ntz, gone timestamp_ntz")
    found = find_orphans([References("t", r, "id", "w", ("k",), "at")], Parents(p, "w", "k", "at", "gone"))
    assert rows(found.select("ref_id", "reason")) == [(1, "late"), (2, "deleted"), (4, "missing"), (5, "missing"), (7, "missing"), (8, "missing")]
    report = {tuple(x)[2:] for x in orphan_report(found).collect()}
    assert report == {("missing", "2024-01", 4, 4), ("late", "2024-01", 1, 1), ("deleted", "2024-01", 1, 1)}
    none = find_orphans([References("t", r, "id", "w", ("k",), "at")], Parents(p.limit(0), "w", "k", "at"))
    assert {x["reason"] for x in none.collect()} == {"missing"} and none.count() == 9
    assert find_orphans([References("t", r.limit(0), "id", "w", ("k",), "at")], Parents(p, "w", "k", "at")).count() == 0


def test_parts_of_flattened_texts(spark, monkeypatch):
    """The same rows in parts of any size; a record whose paths are long together comes in many."""
    from weftline.operators import flatten as m

    deep = "<r>" + "<abcdefgh>" * 1500 + "</abcdefgh>" * 1500 + "</r>"
    texts = ["<a><b/><b><c/></b></a>", None, "", "<a>", deep, "<a/>"] * 2
    want = []
    for size in (m.DECODED, 30):
        monkeypatch.setattr(m, "DECODED", size)
        monkeypatch.setattr(m, "SENT", size)
        column = pa.array(texts)
        made, parts = [], 0
        for first, behind in m._together(column):
            nodes = m.Nodes()
            m.read_xml(column.slice(first, behind - first).to_pylist(), nodes)
            if len(nodes):
                for path, up, record in m._in_parts(m.paths_of(nodes, xml=True)):
                    parts += 1
                    made += zip((record + first).tolist(), path.to_pylist(), up.to_pylist(), strict=True)
        want.append(sorted(made))
        assert parts > 1000 if size == 30 else parts < 6
    assert want[0] == want[1] and len(want[0]) == 2 * (4 + 1501 + 1)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id bigint, x string").repartition(2)
    assert flatten_texts(df, "id", {"xml": ("x", "xml")}).count() == 3012


# --- hierarchies ------------------------------------------------------------------------------------


def brute_forest(links):
    up = {(s, n): p for s, n, p in links}
    up = {k: (None if p is None or (k[0], p) not in up else p) for k, p in up.items()}
    out = {}
    for s, n in up:
        path, at, seen = [n], n, {n}
        state = "tree"
        while up[s, at] is not None:
            at = up[s, at]
            if at in seen:
                state = "cycle" if at == n else "under_cycle"
                break
            seen.add(at)
            path.append(at)
        out[s, n] = (state, path[::-1])
    below = Counter((s, a) for (s, n), (state, path) in out.items() if state == "tree" for a in path[:-1])
    return sorted(((s, n, p[0], len(p) - 1, "/".join(map(str, p)), below[s, n], st) if st == "tree" else (s, n, -1, -1, "", -1, st) for (s, n), (st, p) in out.items()), key=str)


@pytest.mark.parametrize("fragment", [100_000, 6])
def test_forest_against_brute_force(spark, fragment):
    rng = random.Random(3)
    links = []
    for scope, n in ((1, 60), (2, 3), (3, 25)):
        for i in range(n):
            links.append((scope, i, rng.choice([None, 999, *range(i)] if rng.random() < 0.9 else [*range(n)]) if i else None))
    links += [(4, i, (i + 1) % 20) for i in range(20)] + [(4, 100 + i, i if i < 5 else 100 + i - 1) for i in range(12)]  # a loop of 20 with chains below
    links += [(5, 1, 1), (5, 2, 1), *((6, i, i - 1 if i else None) for i in range(40))]
    df = spark.createDataFrame(links, "scope bigint, node bigint, parent bigint").withColumn("state", F.lit("clash"))
    found = resolve_forest(df, fragment=fragment)
    assert rows(found) == brute_forest(links)


def _chain(n):
    return [(i, i - 1 if i else None) for i in range(n)]


SHAPES = {
    "chain": _chain,
    "loop": lambda n: [(i, (i + 1) % n) for i in range(n)],
    # a spine with a tooth on every node
    "comb": lambda n: [(i, i - 2 if i > 1 else None) if i % 2 == 0 else (i, i - 1) for i in range(n)],
    "star of pairs": lambda n: [(0, None), *((i, 0 if i % 2 else i - 1) for i in range(1, n))],
    "binary": lambda n: [(i, (i - 1) // 2 if i else None) for i in range(n)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_levels_grow_with_the_logarithm(spark, shape):
    """One scope of 50 fragments, its ids in no order; every level leaves about half of the nodes at most."""
    fragment, n = 16, 800
    rng = random.Random(11)
    name = rng.sample(range(10 * n), n)
    links = [(7, name[i], None if p is None else name[p]) for i, p in SHAPES[shape](n)]
    rng.shuffle(links)
    levels = []
    found = resolve_forest(spark.createDataFrame(links, "scope bigint, node bigint, parent bigint"), fragment=fragment, levels=levels)
    assert rows(found) == brute_forest(links)
    assert levels[0] == n and len(levels) <= math.ceil(math.log2(n / fragment)) + 2, levels
    assert all(b <= 0.6 * a for a, b in zip(levels, levels[1:])), levels


def test_forest_of_nothing_and_descendants(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2)], "scope bigint, node bigint, parent bigint")
    assert resolve_forest(df.limit(0)).count() == 0
    assert rows(descendants(resolve_forest(df))) == [(1, 1, 2, 1), (1, 1, 3, 2), (1, 2, 3, 1)]


def test_container_links(spark):
    data = [
        (1, 10, None, [11, 12, 12, None], t(1)), (1, 11, 10, None, t(1)), (1, 11, 99, [13], t(2)), (1, 12, None, [], t(1)), (1, 20, 20, None, t(1)), (1, 30, None, [13], t(3)),
        (2, 10, 11, None, t(1)), (2, 10, 11, None, t(1)), (None, 5, None, [6], t(1)), (3, None, None, [6], t(1)), (4, 1, None, [1], t(1)),
    ]
    df = spark.createDataFrame(data, "w bigint, id bigint, parent bigint, kids array<bigint>, at timestamp_ntz")
    links = container_links(df, scope="w", key="id", parent="parent", children="kids", seen_at="at")
    assert rows(links) == sorted([(1, 10, None), (1, 11, None), (1, 12, 10), (1, 13, 11), (1, 20, 20), (1, 30, None), (2, 10, None), (4, 1, 1)], key=str)
    assert container_links(df.limit(0), scope="w", key="id", parent="parent", children="kids", seen_at="at").count() == 0


# --- drift ------------------------------------------------------------------------------------------


def value_type(values):
    v = [x.strip() for x in values]
    if all(re.fullmatch(r"[+-]?[0-9]+", x) for x in v):
        return "integer"
    if all(re.fullmatch(r"[+-]?[0-9]+(\.[0-9]+)?", x) for x in v):
        return "decimal"
    return "boolean" if all(x.lower() in ("true", "false") for x in v) else "text"


def brute_drift(records, versions):
    release = defaultdict(set)
    for w, v in versions:
        m = re.search(r"(\d+)\.(\d+)", v or "")
        if m:
            release[w].add((int(m[1]), int(m[2])))
    fields = defaultdict(lambda: defaultdict(list))
    for w, kind, text in records:
        kind = (kind or "").strip(" \t\r\n").lower()
        try:
            root = ET.fromstring(text or "")
        except ET.ParseError:
            continue
        if not kind:
            continue
        found = []

        def walk(e, path, found=found):
            own = (e.text or "") + "".join(c.tail or "" for c in e)
            if path and own.strip():
                found.append((path, own))
            found += [(f"{path}/@{k}" if path else f"@{k}", v) for k, v in e.attrib.items() if v.strip()]
            for c in e:
                walk(c, f"{path}/{c.tag}" if path else c.tag)

        walk(root, "")
        for r in release[w]:
            for path, v in found:
                fields[kind, r][path].append(v)
            fields[kind, r]  # noqa: B018
    out = []
    for kind in {k for k, _ in fields}:
        order = sorted(r for k, r in fields if k == kind)
        for before, now in zip(order, order[1:], strict=False):
            a = {p: value_type(v) for p, v in fields[kind, before].items()}
            b = {p: value_type(v) for p, v in fields[kind, now].items()}
            name = f"{now[0]}.{now[1]}"
            gone, new = {p: t_ for p, t_ in a.items() if p not in b}, {p: t_ for p, t_ in b.items() if p not in a}
            group = lambda p, t_: (p.rpartition("/")[0], t_)
            for p in [p for p in a if p in b and a[p] != b[p]]:
                out.append((kind, name, "retyped", p, ""))
            for g in {group(p, t_) for p, t_ in [*gone.items(), *new.items()]}:
                x, y = [p for p, t_ in gone.items() if group(p, t_) == g], [p for p, t_ in new.items() if group(p, t_) == g]
                if len(x) == len(y) == 1:
                    out.append((kind, name, "renamed", x[0], y[0]))
                else:
                    out += [(kind, name, "removed", p, "") for p in x] + [(kind, name, "added", p, "") for p in y]
    return sorted(out, key=str)


def test_drift_against_brute_force(spark):
    rng = random.Random(5)
    values = ["1", "-2", "3.5", "true", "False", "x", " 7 ", " "]
    records = []
    for _ in range(250):
        parts = "".join(f"<{n}{' c=' + repr(rng.choice(values)) if rng.random() < 0.3 else ''}>{rng.choice(values)}{'<S>9</S>' if rng.random() < 0.2 else ''}</{n}>" for n in "ABCD" if rng.random() < 0.4)
        records.append((rng.randrange(8), rng.choice(["Sort", " sort\n", "Join", "", None]), rng.choice([f"<R z='{rng.choice(values)}'>{parts}</R>"] * 8 + ["<R>", "", None])))
    versions = [(0, "2023.1"), (0, "2023.1.77"), (1, "v2023.2"), (2, " 2023.10 "), (3, "9.5"), (4, None), (5, "n/a"), (6, "10.6 (x64)"), (7, "2023.2"), (None, "1.1")]
    r = spark.createDataFrame(records, "w bigint, kind string, text string").withColumn("version", F.lit("clash")).repartition(4)
    v = spark.createDataFrame(versions, "w bigint, version string")
    found = drift_of_records(r, v, owner="w", kind="kind", text="text", version_owner="w", version="version")
    assert rows(found) == brute_drift(records, versions)
    assert drift_of_records(r.limit(0), v, owner="w", kind="kind", text="text", version_owner="w", version="version").count() == 0
    assert drift_of_records(r, v.limit(0), owner="w", kind="kind", text="text", version_owner="w", version="version").count() == 0


def test_header_reader():
    read = HeaderReader().read
    assert read("<R a='1' b=' '>own<X>5<Y/> </X><X>7.5</X><Z> </Z><W><![CDATA[true]]></W></R>") == {"@a": 3, "X": 2, "W": 4}
    assert read("<R><X>1<!-- c -->2</X></R>") == {"X": 3} and read("<R>") is None
    assert [fits(x) for x in ("1", "+1.5", ".5", "TRUE", "", "١")] == [3, 2, 0, 4, 0, 0]


def test_files_of_drifting_schemas(spark, tmp_path):
    frames = [
        spark.createDataFrame([(1, "a")], "id int, name string"), spark.createDataFrame([(2, 2.5, "b")], "id bigint, score double, name string"), spark.createDataFrame([("x", 3.5, "c")], "id string, score double, title string"),
    ]
    paths = []
    for i, f in enumerate(frames):
        f.coalesce(1).write.parquet(str(tmp_path / f"f{i}"))
        paths.append(str(next((tmp_path / f"f{i}").glob("*.parquet"))))
    table, log = read_drifting(spark, paths)
    assert table.dtypes == [("id", "string"), ("name", "string"), ("score", "double"), ("title", "string")]
    assert rows(table) == sorted([("1", "a", None, None), ("2", "b", 2.5, None), ("x", None, 3.5, "c")], key=str)
    assert [tuple(r)[0:1] + tuple(r)[2:4] for r in log.orderBy("seq", "change_kind", "field").collect()] == [(1, "added", "score"), (1, "retyped", "id"), (2, "renamed", "name -> title"), (2, "retyped", "id")]
    assert read_drifting(spark, [])[0].columns == []
    twice = read_drifting(spark, [paths[0], paths[1], paths[0]])[0]
    assert sorted(r["id"] for r in twice.collect()) == sorted([r["id"] for p in (0, 1, 0) for r in spark.read.parquet(paths[p]).collect()])


TYPES = [
    T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.DecimalType(10, 2), T.DecimalType(38, 0), T.DecimalType(12, 11), T.DateType(), T.TimestampType(), T.TimestampNTZType(),
    T.BooleanType(), T.StringType(), T.BinaryType(), T.NullType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.DecimalType(5, 1)), T.MapType(T.StringType(), T.FloatType()), T.MapType(T.StringType(), T.LongType()),
    T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())]), T.StructType([T.StructField("b", T.DateType()), T.StructField("a", T.DoubleType())]),
]


def _sorted_fields(kind):
    if isinstance(kind, T.StructType):
        return T.StructType(sorted((T.StructField(f.name, _sorted_fields(f.dataType)) for f in kind), key=lambda f: f.name))
    return kind


def test_least_type_does_not_depend_on_the_order_of_files():
    for three in itertools.combinations_with_replacement(TYPES, 3):
        made = set()
        for a, b, c in set(itertools.permutations(three)):
            made.add(_sorted_fields(((Seen.of(a) | Seen.of(b)) | Seen.of(c)).type()).json())
            made.add(_sorted_fields((Seen.of(a) | (Seen.of(b) | Seen.of(c))).type()).json())
        assert len(made) == 1, three


def test_least_types():
    of = lambda *kinds: reduce(Seen.__or__, map(Seen.of, kinds)).type()
    assert of(T.IntegerType(), T.FloatType(), T.DoubleType()) == T.DoubleType() and of(T.ShortType(), T.FloatType()) == T.FloatType()
    assert of(T.LongType(), T.DecimalType(10, 2)) == T.DecimalType(21, 2) and of(T.DecimalType(38, 0), T.DecimalType(12, 11)) == T.DoubleType()
    assert of(T.DateType(), T.TimestampNTZType()) == T.TimestampNTZType() and of(T.BooleanType(), T.ByteType()) == T.StringType() and of(T.NullType()) == T.StringType()
    assert of(T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())) == T.ArrayType(T.LongType()) and of(T.NullType(), T.DateType()) == T.DateType()


def test_nested_fields_drift_too(spark, tmp_path):
    frames = [
        spark.sql("select 1 as id, named_struct('x', 1, 'y', 'p') as s, array(1, 2) as l, map('k', 1) as m"),
        spark.sql("select 2L as id, named_struct('y', 'q', 'x', 2.5D, 'z', date'2024-01-01') as s, array(1.5BD) as l, map('k', 2L) as m"),
        spark.sql("select 3 as id, cast(null as struct<x: int, y: string>) as s, 'none' as l, map('k', 3) as m"),
    ]
    paths = []
    for i, f in enumerate(frames):
        f.coalesce(1).write.parquet(str(tmp_path / f"f{i}"))
        paths.append(str(next((tmp_path / f"f{i}").glob("*.parquet"))))
    table, log = read_drifting(spark, paths)
    assert table.dtypes == [("id", "bigint"), ("s", "struct<x:double,y:string,z:date>"), ("l", "string"), ("m", "map<string,bigint>")]
    found = {r["id"]: (r["s"] and tuple(r["s"]), r["l"], r["m"]) for r in table.collect()}
    assert found == {1: ((1.0, "p", None), "[1,2]", {"k": 1}), 2: ((2.5, "q", date(2024, 1, 1)), "[1.5]", {"k": 2}), 3: (None, "none", {"k": 3})}
    assert {(r["seq"], r["change_kind"], r["field"]) for r in log.collect()} == {(i, "retyped", f) for i in (1, 2) for f in ("id", "s", "l", "m")}
