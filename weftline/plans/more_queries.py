"""Queries of sources, sinks, functions and tools that ``tool_queries`` doesn't have, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import joins, parse, prepare, transform
from weftline.operators.prepare import Choice
from weftline.operators.transform import Action
from weftline.plans.compiler import Compiled, compile_workflow
from weftline.plans.document import load
from weftline.plans.workflow_queries import _document, _line
from weftline.session import ensure_checkpoint_dir
from weftline.session import table as T
from weftline.sources import files
from weftline.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _folder(s: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(s)}/{name}-{uuid.uuid4().hex}"


def _run(s: SparkSession, d: str, nodes: list, links: list, **inputs: DataFrame) -> Compiled:
    return compile_workflow(load(_document(nodes, links)), s, base=d, inputs={int(k[1:]): v for k, v in inputs.items()})


# --- sinks and what reads them back -----------------------------------------------------------------

_PROFILES = "cust_id string, name string, status string, revenue double"


def _profiles(s: SparkSession, d: str) -> DataFrame:
    """With quotes, separators and line breaks in a text."""
    odd = F.concat("name", F.lit('; "a, b"\n'), "status")
    return T(s, d, "customer_profiles").select("cust_id", F.coalesce(odd, "name").alias("name"), "status", "revenue")


_PROFILES_SQL = "select cust_id, coalesce(name || '; \"a, b\"' || chr(10) || status, name) as name, status, revenue from customer_profiles"


def _round_trip(s: SparkSession, df: DataFrame, name: str, schema: str | None = None, **options) -> DataFrame:  # noqa: ANN003
    at = files.locate(f"{_folder(s, 'sink')}/{name}")
    files.write(df, at, **options)
    return files.read(s, at, schema=schema)


@query(_PROFILES_SQL)
def sink_csv(s: SparkSession, d: str) -> DataFrame:
    return _round_trip(s, _profiles(s, d), "out.csv", _PROFILES)


@query(_PROFILES_SQL)
def sink_json(s: SparkSession, d: str) -> DataFrame:
    return _round_trip(s, _profiles(s, d), "out.json", _PROFILES).select("cust_id", "name", "status", "revenue")


@query(_PROFILES_SQL + " union all select null, null, null, 1.0")
def sink_xlsx(s: SparkSession, d: str) -> DataFrame:
    """A sheet by its name; a row of nulls but one, and whole numbers among the others."""
    one = s.createDataFrame([(None, None, None, 1.0)], _PROFILES)
    return _round_trip(s, _profiles(s, d).unionByName(one), "out.xlsx|||Profiles$")


@query(_PROFILES_SQL)
def sink_parquet(s: SparkSession, d: str) -> DataFrame:
    return _round_trip(s, _profiles(s, d), "out.parquet")


@query(_PROFILES_SQL)
def sink_yxdb(s: SparkSession, d: str) -> DataFrame:
    """The format that is not built becomes parquet."""
    folder = _folder(s, "sink")
    files.write(_profiles(s, d), files.locate(f"{folder}/out.yxdb"))
    return files.read(s, files.locate(f"{folder}/out.yxdb"))


@query("select 100::bigint as n, true as known")
def sink_max_records(s: SparkSession, d: str) -> DataFrame:
    got = _round_trip(s, T(s, d, "orders"), "out.parquet", limit=100)
    whole = T(s, d, "orders").select("o_orderkey").distinct()
    return got.join(whole, "o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.lit(True).alias("known"))


@query("select o_orderstatus, count(*)::bigint as n, min(o_orderkey) as least from orders group by 1")
def output_data(s: SparkSession, d: str) -> DataFrame:
    """A compiled workflow that reads, sums up and writes csv."""
    folder = _folder(s, "flow")
    done = _run(
        s, d,
        [(1, "DbFileInput", "<File>orders.parquet</File>"), (2, "Summarize", '<SummarizeFields><SummarizeField field="o_orderstatus" action="GroupBy"/><SummarizeField field="o_orderkey" action="Count" rename="n"/><SummarizeField field="o_orderkey" action="Min" rename="least"/></SummarizeFields>'), (3, "DbFileOutput", f"<File>{folder}/made.csv</File>")],
        _line(1, 2, 3),
    )
    done.write()
    return files.read(s, files.locate(f"{folder}/made.csv"), schema="o_orderstatus string, n long, least long")


@query("select * from (values ('orders.parquet', 'parquet', true), ('gone.csv', 'csv', false)) t(path, format, resolved)")
def dependencies(s: SparkSession, d: str) -> DataFrame:
    return _run(s, d, [(1, "DbFileInput", "<File>orders.parquet</File>"), (2, "DbFileInput", "<File>gone.csv</File>")], []).dependencies_frame().select("path", "format", "resolved")


@query("""select * from (values ('a/b.csv', 'csv', null), ('C:\\x\\t.TXT', 'csv', null), ('book.xlsx|||Sheet2$', 'xlsx', 'Sheet2'), ('old.yxdb', 'yxdb', null), ('d.json', 'json', null), ('t.tsv', 'csv', null)) t(asked, format, sheet)""")
def locations(s: SparkSession, d: str) -> DataFrame:
    asked = ["a/b.csv", "C:\\x\\t.TXT", "book.xlsx|||Sheet2$", "old.yxdb", "d.json", "t.tsv"]
    return s.createDataFrame([(a, at.format, at.sheet) for a in asked for at in [files.locate(a)]], "asked string, format string, sheet string")


@query("select * from (values ('customer.parquet'), ('lineitem.parquet'), ('nation.parquet'), ('orders.parquet'), ('region.parquet'), ('supplier.parquet')) t(FileName)")
def directory_files(s: SparkSession, d: str) -> DataFrame:
    """Names without reading the files; the tables of the star schema but for part."""
    return files.directory(s, d, "{customer,lineitem,nation,orders,region,supplier}.parquet").select("FileName")


@query("select true as now, true as today")
def clocks(s: SparkSession, d: str) -> DataFrame:
    made = prepare.formula(files.date_time_now(s), [("t", "DateTimeToday()"), ("n", "DateTimeNow()")])
    near = lambda c: F.abs(F.unix_timestamp(F.col(c).cast("timestamp")) - F.unix_timestamp(F.current_timestamp())) < 3600
    return made.select((near("DateTimeNow") & near("n")).alias("now"), (F.col("t") == F.current_date()).alias("today"))


# --- functions --------------------------------------------------------------------------------------


@query("""select p_partkey, '  ' || p_name as l, p_name || '  ' as r, p_name || '  ' as lt, '  ' || p_name as rt, p_partkey::varchar as s, floor(p_retailprice)::bigint as i, round(sqrt(p_retailprice), 6) as q, true as yes, false as no, null::varchar as none, split_part(p_name, ' ', 1) as w, 2::int as words,
upper(left(split_part(p_name, ' ', 1), 1)) || substring(split_part(p_name, ' ', 1), 2) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || substring(split_part(p_name, ' ', 2), 2) as title, regexp_replace(p_name, '[aeiou]', '#', 'g') as vowels, len(regexp_extract_all(p_name, '[aeiou]'))::int as n_vowels, regexp_full_match(p_brand, 'Brand#1\\d*') as one, rpad(p_brand, 12, '.') as pad from part""")
def more_functions(s: SparkSession, d: str) -> DataFrame:
    df = T(s, d, "part").withColumn("blank", F.concat(F.lit("  "), "p_name", F.lit("  ")))
    made = [
        ("l", "TrimRight([blank])"), ("r", "TrimLeft([blank])"), ("lt", "LTrim([blank])"), ("rt", "RTrim([blank])"), ("s", "ToString([p_partkey])"), ("i", "ToInteger(Floor([p_retailprice]))"), ("q", "Sqrt([p_retailprice])"), ("yes", "TRUE"), ("no", "FALSE"), ("none", "NULL()"), ("w", "GetWord([p_name], 0)"),
        ("words", "CountWords([p_name])"), ("title", "TitleCase([p_name])"), ("vowels", "Regex_Replace([p_name], '[aeiou]', '#')"), ("n_vowels", "Regex_CountMatches([p_name], '[aeiou]')"), ("one", "Regex_Match([p_brand], 'Brand#1\\d*')"), ("pad", "PadRight([p_brand], 12, '.')"),
    ]
    out = prepare.formula(df, made)
    return out.select("p_partkey", *[F.round("q", 6).alias("q") if n == "q" else F.col(n).cast("string").alias(n) if n == "none" else F.col(n) for n, _ in made])


@query("select p_partkey, null::varchar as odd, true as said from part")
def unknown_function(s: SparkSession, d: str) -> DataFrame:
    """Null and a diagnostic, and the rest goes on."""
    say: list = []
    out = prepare.formula(T(s, d, "part").select("p_partkey"), [("odd", "Frobnicate([p_partkey])")], (), say)
    return out.select("p_partkey", F.col("odd").cast("string").alias("odd"), F.lit(any(c == "unsupported_function" for c, _ in say)).alias("said"))


# --- tools ------------------------------------------------------------------------------------------


@query("select o_orderkey as \"order\", o_custkey, o_orderstatus, o_totalprice, o_orderdate from orders")
def select_unknown(s: SparkSession, d: str) -> DataFrame:
    """``*Unknown`` keeps what is not listed."""
    return prepare.select(T(s, d, "orders"), [Choice("o_orderkey", rename="order"), Choice("o_orderpriority", False), Choice("*Unknown")], unknown=True)


@query("select r.r_regionkey, n.n_name from region r, nation n")
def join_without_keys(s: SparkSession, d: str) -> DataFrame:
    return joins.join(T(s, d, "region").select("r_regionkey"), T(s, d, "nation").select("n_name"), [])["Join"]


@query("select o_orderstatus, count(o_orderkey)::bigint as n, count(*) filter (where o_totalprice > 100000)::bigint as above, count(*) filter (where o_totalprice <= 100000)::bigint as nulls, mode(o_orderpriority order by o_orderpriority) as usual from orders group by 1")
def summarize_counts(s: SparkSession, d: str) -> DataFrame:
    df = T(s, d, "orders").withColumn("big", F.expr("if(o_totalprice > 100000, o_totalprice, null)"))
    return transform.summarize(df, [Action("o_orderstatus", "GroupBy"), Action("o_orderkey", "Count", "n"), Action("big", "CountNonNull", "above"), Action("big", "CountNull", "nulls"), Action("o_orderpriority", "Mode", "usual")])


@query("select * from region")
def summarize_nothing(s: SparkSession, d: str) -> DataFrame:
    return transform.summarize(T(s, d, "region"), [])


@query("select r_regionkey::varchar as k, r_name as name from region union all select n_name, null from nation")
def union_mixed_types(s: SparkSession, d: str) -> DataFrame:
    return joins.union([T(s, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), T(s, d, "nation").select(F.col("n_name").alias("k"))])


@query("select r_regionkey, true as nothing from region")
def union_of_one(s: SparkSession, d: str) -> DataFrame:
    return joins.union([T(s, d, "region").select("r_regionkey")]).withColumn("nothing", F.lit(joins.union([]) is None))


@query("""select '[' || string_agg('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}', ',' order by r_regionkey desc) || ']' as JSON from region""")
def json_build_ordered(s: SparkSession, d: str) -> DataFrame:
    return parse.json_build(T(s, d, "region").select("r_regionkey", "r_name"), order=[("r_regionkey", False)])


@query("""select n_regionkey, '[' || string_agg('{"n_nationkey":' || n_nationkey || ',"label":' || case when n_nationkey % 4 = 0 then 'null' else '"' || n_name || '"' end || '}', ',' order by n_name) || ']' as JSON from nation group by 1""")
def json_build_grouped(s: SparkSession, d: str) -> DataFrame:
    df = T(s, d, "nation").select("n_regionkey", "n_nationkey", F.expr("if(n_nationkey % 4 = 0, null, n_name)").alias("label"), "n_name")
    return parse.json_build(df.drop("n_name").join(df.select("n_nationkey", "n_name"), "n_nationkey").select("n_regionkey", "n_nationkey", "label", "n_name"), group=["n_regionkey"], order=[("n_name", True)]).select("n_regionkey", F.regexp_replace("JSON", r',"n_name":"[^"]*"', "").alias("JSON"))


_XML = "concat('<o id=\"', o_orderkey, '\"><state>', o_orderstatus, '</state><who><key>', o_custkey, '</key></who><price/></o>')"


@query("select o_orderkey, o_orderkey::varchar as id, o_orderstatus as state, o_custkey::varchar as customer, '' as price, null::varchar as none from orders")
def xml_parse_paths(s: SparkSession, d: str) -> DataFrame:
    df = T(s, d, "orders").select("o_orderkey", F.expr(_XML).alias("x"))
    return parse.xml_parse(df, "x", {"id": "@id", "state": "state", "customer": "who/key", "price": "price", "none": "gone/deep"}).drop("x")


@query("select c_nationkey::varchar as nation, c_custkey::varchar as id, c_mktsegment as segment from customer")
def xml_parse_rows(s: SparkSession, d: str) -> DataFrame:
    """A document for every nation, a row for every customer in it."""
    one = F.expr("concat('<c id=\"', c_custkey, '\"><s>', c_mktsegment, '</s></c>')")
    texts = T(s, d, "customer").groupBy("c_nationkey").agg(F.concat(F.lit("<all>"), F.array_join(F.collect_list(one), ""), F.lit("</all>")).alias("x"))
    return parse.xml_parse(texts.select(F.col("c_nationkey").cast("string").alias("nation"), "x"), "x", {"id": "@id", "segment": "s"}, rows="c").select("nation", "id", "segment")


_TREE = """to_json(named_struct('key', o_orderkey, 'who', named_struct('id', o_custkey, 'tags', array(o_orderstatus, null)), 'none', array(), 'deep', array(array(1), array(2, 3))))"""


@query("""select o_orderkey, 'key' as JSON_Name, o_orderkey::varchar as JSON_ValueString from orders union all select o_orderkey, 'who.id', o_custkey::varchar from orders union all select o_orderkey, 'who.tags.0', o_orderstatus from orders
union all select o_orderkey, 'who.tags.1', null from orders union all select o_orderkey, n, v from orders, (values ('deep.0.0', '1'), ('deep.1.0', '2'), ('deep.1.1', '3')) t(n, v)""")
def json_parse_leaves(s: SparkSession, d: str) -> DataFrame:
    return parse.json_parse(T(s, d, "orders").select("o_orderkey", F.expr(_TREE).alias("j")), "j")


# --- tools of documents -----------------------------------------------------------------------------


@query("select c_custkey, c_mktsegment from customer where c_mktsegment = 'BUILDING'")
def flow_simple_filter(s: SparkSession, d: str) -> DataFrame:
    """A filter that is set by field, operator and operand."""
    nodes = [(1, "DbFileInput", "<File>customer.parquet</File>"), (2, "Filter", "<Mode>Simple</Mode><Simple><Operator>=</Operator><Field>c_mktsegment</Field><Operands><Operand>BUILDING</Operand></Operands></Simple>"), (3, "BrowseV2", "")]
    return _run(s, d, nodes, [*_line(1, 2), (2, "True", 3, "Input")]).frame(2, "True").select("c_custkey", "c_mktsegment")


@query("select n_nationkey, n_regionkey, upper(n_name) as n_name, 'kept' as way from nation where n_regionkey = 1")
def flow_control(s: SparkSession, d: str) -> DataFrame:
    """Block until done, browse, message and both ends of a detour pass the rows on."""
    nodes = [
        (1, "DbFileInput", "<File>nation.parquet</File>"), (2, "BlockUntilDone", ""), (3, "Message", "<Message>on the way</Message>"), (4, "Detour", '<DetourRight value="False"/>'),
        (5, "Formula", '<FormulaFields><FormulaField field="way" expression="&quot;kept&quot;" type="String"/></FormulaFields>'), (6, "Formula", '<FormulaFields><FormulaField field="way" expression="&quot;around&quot;" type="String"/></FormulaFields>'), (7, "DetourEnd", ""),
        (8, "DataCleansePro", '<ModifyCase>Upper</ModifyCase><Fields><Field field="n_name"/></Fields>'), (9, "Filter", "<Expression>[n_regionkey] = 1</Expression>"), (10, "BrowseV2", ""),
    ]
    links = [(1, "Output", 2, "Input"), (2, "Output1", 3, "Input"), *_line(3, 4), (4, "Left", 5, "Input"), (4, "Right", 6, "Input"), (5, "Output", 7, "Left"), (6, "Output", 7, "Right"), *_line(7, 8, 9), (9, "True", 10, "Input")]
    return _run(s, d, nodes, links).frame(9, "True").select("n_nationkey", "n_regionkey", "n_name", "way")


@query("select o_orderkey, case when o_totalprice > 200000 then 'large' when o_orderstatus = 'F' then 'done' else o_orderpriority end as o_orderpriority from orders")
def flow_dynamic_replace(s: SparkSession, d: str) -> DataFrame:
    rules = s.createDataFrame([("o_orderpriority", "[o_totalprice] > 200000", "large"), ("o_orderpriority", "[o_orderstatus] = 'F'", "done"), ("o_orderpriority", "[o_totalprice] > 250000", "never")], "f string, c string, v string")
    nodes = [(1, "DbFileInput", "<File>orders.parquet</File>"), (2, "TextInput", ""), (3, "DynamicReplace", ""), (4, "BrowseV2", "")]
    return _run(s, d, nodes, [(1, "Output", 3, "Targets"), (2, "Output", 3, "Expressions"), *_line(3, 4)], t2=rules).frame(3).select("o_orderkey", "o_orderpriority")


@query("select c_custkey, upper(c_mktsegment) as segment, n_name from customer join nation on c_nationkey = n_nationkey where c_acctbal > 0")
def flow_in_database(s: SparkSession, d: str) -> DataFrame:
    """Connect, filter, formula, join, select and stream out over tables of the catalogue."""
    for name in ("customer", "nation"):
        T(s, d, name).createOrReplaceTempView(f"weftline_db_{name}")
    nodes = [
        (1, "LockInInput", "<Table>weftline_db_customer</Table>"), (2, "LockInFilter", "<Expression>[c_acctbal] &gt; 0</Expression>"), (3, "LockInFormula", '<FormulaFields><FormulaField field="segment" expression="Uppercase([c_mktsegment])" type="String"/></FormulaFields>'),
        (4, "LockInInput", "<Table>weftline_db_nation</Table>"), (5, "LockInJoin", '<JoinInfo connection="Left"><Field field="c_nationkey"/></JoinInfo><JoinInfo connection="Right"><Field field="n_nationkey"/></JoinInfo>'),
        (6, "LockInSelect", '<SelectFields><SelectField field="c_custkey" selected="True"/><SelectField field="segment" selected="True"/><SelectField field="n_name" selected="True"/></SelectFields>'), (7, "LockInStreamOut", ""),
    ]
    links = [*_line(1, 2), (2, "True", 3, "Input"), (3, "Output", 5, "Left"), (4, "Output", 5, "Right"), (5, "Join", 6, "Input"), *_line(6, 7)]
    return _run(s, d, nodes, links).frame(7)


@query("select n_regionkey, count(*)::bigint as n from nation where n_nationkey % 2 = 0 group by 1")
def flow_sql(s: SparkSession, d: str) -> DataFrame:
    """SQL over the anchors of a workflow."""
    done = _run(s, d, [(1, "DbFileInput", "<File>nation.parquet</File>"), (2, "Filter", "<Expression>[n_nationkey] % 2 = 0</Expression>"), (3, "BrowseV2", "")], [*_line(1, 2), (2, "True", 3, "Input")])
    done.register_views("weftline_flow")
    return s.sql("select n_regionkey, count(*) as n from weftline_flow_2_true group by 1")


@query("select * from (values (1, 2, 'Output', 'Input'), (2, 3, 'True', 'Left'), (2, 4, 'False', 'Input'), (4, 3, 'Output', 'Right')) t(origin, destination, origin_anchor, destination_anchor)")
def flow_edges(s: SparkSession, d: str) -> DataFrame:
    flow = load(_document([(i, "Filter", "") for i in (1, 2, 3, 4)], [(1, "Output", 2, "Input"), (2, "True", 3, "Left"), (2, "False", 4, "Input"), (4, "Output", 3, "Right")]))
    return s.createDataFrame([(c.origin, c.destination, c.origin_anchor, c.destination_anchor) for c in flow.connections], "origin int, destination int, origin_anchor string, destination_anchor string")


@query("select event_type, count(*)::bigint as n, round(sum(value), 2) as total from events group by 1")
def stream_of_events(s: SparkSession, d: str) -> DataFrame:
    """The rows of a stream, taken in micro-batches, come to the same sums as a table."""
    out = f"{_folder(s, 'stream')}/rows.parquet"
    rows = streams.read_files(s, f"{d}/events.parquet*", T(s, d, "events").schema)
    done = streams.run(rows.where("event_id is not null"), lambda batch, _: batch.write.mode("append").parquet(out), f"events-{uuid.uuid4().hex}")
    done.awaitTermination()
    return s.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""with n as (select user_id, ts, case when ts - lag(ts) over w >= interval 6 hour or lag(ts) over w is null then 1 else 0 end as first from events window w as (partition by user_id order by ts)),
k as (select user_id, ts, sum(first) over (partition by user_id order by ts rows unbounded preceding) as s from n)
select user_id, min(ts) as session_start, max(ts) + interval 6 hour as session_end, count(*)::bigint as n from k group by user_id, s""")
def sessions_of_events(s: SparkSession, d: str) -> DataFrame:
    """Sessions end after six hours without an event of the user."""
    made = streams.sessions(T(s, d, "events"), "ts", "6 hours", [F.count(F.lit(1)).alias("n")], ["user_id"])
    return made.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n")


@query("select time_bucket(interval 1 day, ts) as window_start, time_bucket(interval 1 day, ts) + interval 1 day as window_end, event_type, count(*)::bigint as n from events group by all")
def windows_of_events(s: SparkSession, d: str) -> DataFrame:
    made = streams.windowed(T(s, d, "events"), "ts", "1 day", [F.count(F.lit(1)).alias("n")], ["event_type"])
    return made.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")], "event_type", "n")
