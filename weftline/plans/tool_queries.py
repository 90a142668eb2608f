"""A query per operator over the star-schema tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import joins, ordered, parse, polygons, prepare, spatial, transform
from weftline.operators.prepare import Choice
from weftline.operators.transform import Action
from weftline.session import table as T
from weftline.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINE = [("l_orderkey", True), ("l_linenumber", True), ("l_partkey", True), ("l_suppkey", True), ("l_shipdate", True)]
LINE_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- filter, formula, select ------------------------------------------------------------------------


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 4) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(l_orderkey)::bigint as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def flagship(s: SparkSession, d: str) -> DataFrame:
    """Filter, formula, summarize and sort."""
    kept = prepare.filter_rows(T(s, d, "lineitem"), "[l_shipdate] <= '1998-09-02'")["True"]
    priced = prepare.formula(kept, [("revenue", "[l_extendedprice] * (1 - [l_discount])")])
    out = transform.summarize(priced, [Action("l_returnflag", "GroupBy"), Action("l_linestatus", "GroupBy"), Action("l_quantity", "Sum", "sum_qty"), Action("revenue", "Sum", "revenue"), Action("l_discount", "Avg", "avg_disc"), Action("l_orderkey", "Count", "n")])
    out = out.withColumns({"sum_qty": F.round("sum_qty", 4), "revenue": F.round("revenue", 2), "avg_disc": F.round("avg_disc", 6)})
    return ordered.sort(out, [("l_returnflag", True), ("l_linestatus", True)])


_BRANCH = "[l_quantity] > 25 AND [l_discount] < 0.05"


@query(f"select {LINE_SQL}, l_quantity from lineitem where coalesce(l_quantity > 25 and l_discount < 0.05, false)")
def filter_true(s: SparkSession, d: str) -> DataFrame:
    return prepare.filter_rows(T(s, d, "lineitem"), _BRANCH)["True"].select(*[c for c, _ in LINE], "l_quantity")


@query(f"select {LINE_SQL}, l_quantity from lineitem where not coalesce(l_quantity > 25 and l_discount < 0.05, false)")
def filter_false(s: SparkSession, d: str) -> DataFrame:
    return prepare.filter_rows(T(s, d, "lineitem"), _BRANCH)["False"].select(*[c for c, _ in LINE], "l_quantity")


def _nulled(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("nullif(l_returnflag, 'N')").alias("flag"), F.expr("if(l_quantity > 40, null, l_quantity)").alias("qty"))


_NULLED_SQL = "(select l_orderkey, l_linenumber, nullif(l_returnflag, 'N') as flag, case when l_quantity > 40 then null else l_quantity end as qty from lineitem)"


@query(f"select * from {_NULLED_SQL} where coalesce(flag <> 'A', true)")
def filter_null_neq(s: SparkSession, d: str) -> DataFrame:
    return prepare.filter_rows(_nulled(s, d), "[flag] <> 'A'")["True"]


@query(f"select * from {_NULLED_SQL} where not coalesce(qty > 5, false)")
def filter_not_gt_null(s: SparkSession, d: str) -> DataFrame:
    return prepare.filter_rows(_nulled(s, d), "NOT ([qty] > 5)")["True"]


@query(f"select * from {_NULLED_SQL} where coalesce(flag in ('A', 'X'), false) or qty is null")
def filter_in_or_null(s: SparkSession, d: str) -> DataFrame:
    return prepare.filter_rows(_nulled(s, d), "[flag] IN ('A', 'X') || IsNull([qty])")["True"]


@query("""select o_orderkey, round(o_totalprice * 1.1, 4) as gross, round(o_totalprice * 1.1 - 100, 4) as net, case when o_totalprice * 1.1 - 100 > 150000 then 'high' when o_totalprice * 1.1 - 100 > 50000 then 'mid' else 'low' end as band from orders""")
def formula_chain(s: SparkSession, d: str) -> DataFrame:
    out = prepare.formula(T(s, d, "orders"), [("gross", "[o_totalprice] * 1.1"), ("net", "[gross] - 100"), ("band", "IF [net] > 150000 THEN 'high' ELSEIF [net] > 50000 THEN 'mid' ELSE 'low' ENDIF")])
    return _r(out.select("o_orderkey", "gross", "net", "band"), "gross", "net")


@query("""select o_orderkey, ((o_orderkey % 7) - 3 - (-2) * floor(((o_orderkey % 7) - 3)::double / (-2)))::double as m, case when o_orderkey % 5 = 0 then null else round(o_totalprice / (o_orderkey % 5), 6) end as q, o_orderstatus || '-' || o_orderpriority as tag from orders""")
def formula_arithmetic(s: SparkSession, d: str) -> DataFrame:
    rows = T(s, d, "orders").withColumn("k", F.expr("o_orderkey % 7 - 3")).withColumn("z", F.expr("o_orderkey % 5"))
    out = prepare.formula(rows, [("m", "[k] % (-2)"), ("q", "[o_totalprice] / [z]"), ("tag", "[o_orderstatus] + '-' + [o_orderpriority]")])
    return out.select("o_orderkey", F.col("m").cast("double").alias("m"), F.round("q", 6).alias("q"), "tag")


@query("""select p_partkey, trim(p_name) as t, length(p_name)::int as n, upper(p_name) as u, left(p_name, 3) as l3, right(p_name, 4) as r4, substring(p_name, 2, 3) as mid, replace(p_name, 'a', 'A') as rep, (position('a' in p_name) - 1)::int as found, regexp_matches(p_name, 'a.e') as has, starts_with(p_name, 'b') as st, suffix(p_type, 'R') as en, lpad(p_brand, 12, '*') as pad, reverse(p_brand) as rev from part""")
def string_functions(s: SparkSession, d: str) -> DataFrame:
    out = prepare.formula(
        T(s, d, "part"),
        [("t", "Trim([p_name])"), ("n", "Length([p_name])"), ("u", "Uppercase([p_name])"), ("l3", "Left([p_name], 3)"), ("r4", "Right([p_name], 4)"), ("mid", "Substring([p_name], 2, 3)"), ("rep", "Replace([p_name], 'a', 'A')"), ("found", "FindString([p_name], 'a')"), ("has", "Contains([p_name], 'a.e')"), ("st", "StartsWith([p_name], 'b')"), ("en", "EndsWith([p_type], 'R')"), ("pad", "PadLeft([p_brand], 12, '*')"), ("rev", "ReverseString([p_brand])")],
    )
    return out.select("p_partkey", "t", "n", "u", "l3", "r4", "mid", "rep", "found", "has", "st", "en", "pad", "rev")


@query("""select o_orderkey, abs(o_totalprice - 100000) as a, round_even(o_totalprice / 1000, 1)::double as r, ceil(o_totalprice)::double as c, floor(o_totalprice)::double as f, round(pow(o_totalprice, 0.5), 6) as p, round(ln(o_totalprice), 6) as l, round(log10(o_totalprice), 6) as l10, least(o_totalprice, 1000.5) as mn, greatest(o_orderkey, 500)::bigint as mx from orders""")
def math_functions(s: SparkSession, d: str) -> DataFrame:
    out = prepare.formula(
        T(s, d, "orders"),
        [("a", "Abs([o_totalprice] - 100000)"), ("r", "Round([o_totalprice] / 1000, 1)"), ("c", "Ceil([o_totalprice])"), ("f", "Floor([o_totalprice])"), ("p", "Pow([o_totalprice], 0.5)"), ("l", "Log([o_totalprice])"), ("l10", "Log10([o_totalprice])"), ("mn", "Min([o_totalprice], 1000.5)"), ("mx", "Max([o_orderkey], 500)")],
    )
    return _r(out.select("o_orderkey", "a", "r", "c", "f", "p", "l", "l10", "mn", "mx"), "p", "l", "l10", digits=6)


@query("""select o_orderkey, floor(date_diff('microsecond', timestamp '1997-01-01', o_orderdate) / 86400e6) as days, date_diff('microsecond', timestamp '1997-01-01', o_orderdate) / 3600e6 as hours, o_orderdate + interval 3 day as plus3, o_orderdate + interval 1 month as nextm, strftime(o_orderdate, '%Y/%m') as ym, year(o_orderdate)::int as y from orders""")
def date_functions(s: SparkSession, d: str) -> DataFrame:
    out = prepare.formula(
        T(s, d, "orders"),
        [("days", "DateTimeDiff([o_orderdate], '1997-01-01', 'days')"), ("hours", "DateTimeDiff([o_orderdate], '1997-01-01', 'hours')"), ("plus3", "DateTimeAdd([o_orderdate], 3, 'days')"), ("nextm", "DateTimeAdd([o_orderdate], 1, 'months')"), ("ym", "DateTimeFormat([o_orderdate], '%Y/%m')"), ("y", "DateTimeYear([o_orderdate])")],
    )
    return out.select("o_orderkey", "days", "hours", "plus3", "nextm", "ym", "y")


@query("""select cust_id, coalesce(name, status, 'none') as best, revenue is null as missing, coalesce(status = '', false) as empty, case when coalesce(revenue > 1000, false) then 'big' else 'small' end as size, try_cast(status as double) as num from customer_profiles""")
def null_functions(s: SparkSession, d: str) -> DataFrame:
    out = prepare.formula(T(s, d, "customer_profiles"), [("best", "Coalesce([name], [status], 'none')"), ("missing", "IsNull([revenue])"), ("empty", "IsEmpty([status])"), ("size", "IIF([revenue] > 1000, 'big', 'small')"), ("num", "ToNumber([status])")])
    return out.select("cust_id", "best", "missing", "empty", "size", "num")


@query("select txn_id, cust_id as customer, try_cast(raw_amount as double) as amount, channel from primary_transactions")
def select_rename_cast(s: SparkSession, d: str) -> DataFrame:
    return prepare.select(T(s, d, "primary_transactions"), [Choice("txn_id"), Choice("cust_id", rename="customer"), Choice("raw_amount", rename="amount", type="Double"), Choice("channel"), Choice("booked_at", selected=False)])


@query("select c_custkey, round(c_acctbal * 2, 4) as c_acctbal, (c_nationkey * 2)::int as c_nationkey from customer")
def multi_field_formula(s: SparkSession, d: str) -> DataFrame:
    out = prepare.multi_field_formula(T(s, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"], "[_CurrentField_] * 2")
    return _r(out, "c_acctbal").withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@query(f"select {LINE_SQL}, l_quantity - lag(l_quantity) over (partition by l_suppkey order by {LINE_SQL}) as step from lineitem")
def multi_row_lag(s: SparkSession, d: str) -> DataFrame:
    out = ordered.multi_row_formula(T(s, d, "lineitem"), "step", "[l_quantity] - [Row-1:l_quantity]", ["l_suppkey"], LINE)
    return out.select(*[c for c, _ in LINE], "step")


@query("select o_orderkey, round(o_totalprice - lag(o_totalprice) over (order by o_orderkey), 4) as step, lead(o_orderstatus) over (order by o_orderkey) as next_status from orders")
def multi_row_global(s: SparkSession, d: str) -> DataFrame:
    out = ordered.multi_row_formula(T(s, d, "orders"), "step", "[o_totalprice] - [Row-1:o_totalprice]", (), [("o_orderkey", True)])
    out = ordered.multi_row_formula(out, "next_status", "[Row+1:o_orderstatus]", (), [("o_orderkey", True)])
    return _r(out.select("o_orderkey", "step", "next_status"), "step")


@query("""with recursive o as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey) as n from orders),
f as (select *, o_totalprice as balance from o where n = 1 union all select o.*, f.balance * 0.5 + o.o_totalprice from o join f on o.o_custkey = f.o_custkey and o.n = f.n + 1)
select o_custkey, o_orderkey, balance from f""")
def multi_row_recursive(s: SparkSession, d: str) -> DataFrame:
    out = ordered.multi_row_formula(T(s, d, "orders"), "balance", "IIF(IsNull([Row-1:balance]), [o_totalprice], [Row-1:balance] * 0.5 + [o_totalprice])", ["o_custkey"], [("o_orderkey", True)])
    return out.select("o_custkey", "o_orderkey", "balance")


@query("select i as RowCount from range(1, 11) t(i)")
def generate_rows(s: SparkSession, d: str) -> DataFrame:
    return prepare.generate_rows(s)


@query("select p_partkey, unnest(range(1, least(p_size, 5) + 1)) as i from part")
def generate_rows_per_row(s: SparkSession, d: str) -> DataFrame:
    return prepare.generate_rows_of(T(s, d, "part").select("p_partkey", "p_size"), "i", "1", "Min([p_size], 5)").select("p_partkey", "i")


@query(r"""select cust_id, upper(regexp_replace(name, '^\s+|\s+$', '', 'g')) as name, upper(regexp_replace(status, '^\s+|\s+$', '', 'g')) as status from customer_profiles where name is not null and status is not null""")
def data_cleansing(s: SparkSession, d: str) -> DataFrame:
    return prepare.cleanse(T(s, d, "customer_profiles").select("cust_id", "name", "status"), ["name", "status"], case="upper", remove_null=True)


@query("select l_orderkey, l_linenumber, l_quantity from lineitem")
def auto_field(s: SparkSession, d: str) -> DataFrame:
    texts = T(s, d, "lineitem").select(*[F.col(c).cast("string").alias(c) for c in ("l_orderkey", "l_linenumber", "l_quantity")])
    return prepare.auto_field(texts).withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def dynamic_select(s: SparkSession, d: str) -> DataFrame:
    return prepare.dynamic_select(T(s, d, "orders"))


@query("select r_regionkey as x_r_regionkey, r_name as x_r_name from region")
def dynamic_rename(s: SparkSession, d: str) -> DataFrame:
    return prepare.dynamic_rename(T(s, d, "region").withColumnRenamed("r_name", " r_name "), prefix="x_")


@query("select * from (values ('l_orderkey', 'bigint'), ('l_partkey', 'bigint'), ('l_suppkey', 'bigint'), ('l_linenumber', 'int'), ('l_quantity', 'double'), ('l_extendedprice', 'double'), ('l_discount', 'double'), ('l_tax', 'double'), ('l_returnflag', 'string'), ('l_linestatus', 'string'), ('l_shipdate', 'timestamp_ntz')) t(Name, Type)")
def field_info(s: SparkSession, d: str) -> DataFrame:
    return prepare.field_info(T(s, d, "lineitem"))


@query("select n_nationkey, n_name as label, 'n_name' as source from nation union all select n_nationkey, n_regionkey::varchar, 'n_regionkey' from nation")
def arrange(s: SparkSession, d: str) -> DataFrame:
    return prepare.arrange(T(s, d, "nation"), ["n_nationkey"], {"label": ["n_name", "n_regionkey"]}, "source")


@query("with n as (select *, row_number() over (order by n_nationkey) - 1 as i from nation) select max(case when i % 3 = 0 then n_name end) as n_name_1, max(case when i % 3 = 1 then n_name end) as n_name_2, max(case when i % 3 = 2 then n_name end) as n_name_3 from n group by i // 3")
def make_columns(s: SparkSession, d: str) -> DataFrame:
    return prepare.make_columns(T(s, d, "nation").select("n_nationkey", "n_name"), 3, [("n_nationkey", True)]).drop("n_nationkey_1", "n_nationkey_2", "n_nationkey_3")


# --- order ------------------------------------------------------------------------------------------


@query("select * from orders order by o_totalprice desc, o_orderkey limit 50")
def sort_top(s: SparkSession, d: str) -> DataFrame:
    return ordered.sample(T(s, d, "orders"), "first", 50, order=[("o_totalprice", False), ("o_orderkey", True)])


@query("select * from (select * from orders order by o_orderkey desc limit 30)")
def sample_last(s: SparkSession, d: str) -> DataFrame:
    return ordered.sample(T(s, d, "orders"), "last", 30, order=[("o_orderkey", True)])


@query("select * from orders order by o_orderkey offset 200")
def sample_skip(s: SparkSession, d: str) -> DataFrame:
    return ordered.sample(T(s, d, "orders"), "skip", 200, order=[("o_orderkey", True)])


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) as n from orders) where (n - 1) % 10 = 0")
def sample_one_in_n(s: SparkSession, d: str) -> DataFrame:
    return ordered.sample(T(s, d, "orders").select("o_orderkey"), "one_in", 10, order=[("o_orderkey", True)])


@query("select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) where n <= 2")
def sample_grouped(s: SparkSession, d: str) -> DataFrame:
    return ordered.sample(T(s, d, "orders").select("o_custkey", "o_orderkey"), "first", 2, group=["o_custkey"], order=[("o_orderkey", True)])


@query("select round(count(*) * 0.1)::bigint as n, round(count(*) * 0.1)::bigint as keys, round(count(*) * 0.1)::bigint as same from orders")
def sample_random_percent(s: SparkSession, d: str) -> DataFrame:
    """The size is exact, no row comes twice, and all are rows of the table; which come is up to the seed."""
    return _drawn(s, d, ordered.sample(T(s, d, "orders"), "random_pct", pct=10))


def _drawn(s: SparkSession, d: str, drawn: DataFrame) -> DataFrame:
    whole = T(s, d, "orders")
    rows = drawn.withColumn("drawn", F.lit(1)).join(whole, whole.columns, "inner")
    return drawn.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys")).crossJoin(rows.agg(F.sum("drawn").alias("same")))


@query("select true as as_many, true as different, true as same")
def random_percent(s: SparkSession, d: str) -> DataFrame:
    """Every row with a chance of 10 %: as many as six standard deviations allow, none twice, all of the table."""
    n = T(s, d, "orders").count()
    c = F.col("n").between(n * 0.1 - 6 * (n * 0.09) ** 0.5, n * 0.1 + 6 * (n * 0.09) ** 0.5)
    return _drawn(s, d, ordered.random_percent(T(s, d, "orders"))).select(c.alias("as_many"), (F.col("keys") == F.col("n")).alias("different"), (F.col("same") == F.col("n")).alias("same"))


@query("select *, true as as_large from (select o_orderkey, o_totalprice from orders)")
def create_samples(s: SparkSession, d: str) -> DataFrame:
    """The three parts are disjoint, make up the whole, and are about as large as asked."""
    parts = ordered.create_samples(T(s, d, "orders").select("o_orderkey", "o_totalprice"))
    whole = joins.union([df.withColumn("part", F.lit(k)) for k, df in parts.items()])
    asked = F.create_map(*[F.lit(x) for kv in (("Estimation", 0.6), ("Validation", 0.2), ("Holdout", 0.2)) for x in kv])
    n = T(s, d, "orders").count()
    sizes = whole.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.bool_and(F.abs(F.col("n") / n - asked[F.col("part")]) < 3 / n**0.5).alias("as_large"))
    return whole.drop("part").crossJoin(sizes)


@query("select (row_number() over (order by o_orderkey) + 99)::bigint as id, o_orderkey from orders")
def record_id(s: SparkSession, d: str) -> DataFrame:
    return ordered.record_id(T(s, d, "orders").select("o_orderkey"), "id", 100, [("o_orderkey", True)])


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, dense_rank() over (order by l_quantity)::int as Rank from lineitem")
def rank_dense(s: SparkSession, d: str) -> DataFrame:
    return ordered.rank(T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_quantity")


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity, rank() over (partition by l_suppkey order by l_quantity desc)::int as Rank from lineitem")
def rank_grouped(s: SparkSession, d: str) -> DataFrame:
    rows = T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey")
    return ordered.rank(rows, "l_quantity", ["l_suppkey"], "rank", False).drop("l_suppkey")


@query("select o_orderkey, round(sum(o_totalprice) over (order by o_orderkey), 2) as RunningTotal from orders")
def running_total(s: SparkSession, d: str) -> DataFrame:
    return _r(ordered.running_total(T(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", (), [("o_orderkey", True)]).drop("o_totalprice"), "RunningTotal", digits=2)


@query("select o_orderkey, case when o_orderstatus <> 'F' then round(sum(case when o_orderstatus <> 'F' then o_totalprice end) over (partition by o_custkey order by o_orderkey), 2) end as RunningTotal from orders")
def running_total_grouped(s: SparkSession, d: str) -> DataFrame:
    rows = T(s, d, "orders").select("o_orderkey", "o_custkey", F.expr("if(o_orderstatus <> 'F', o_totalprice, null)").alias("v"))
    return _r(ordered.running_total(rows, "v", ["o_custkey"], [("o_orderkey", True)]).select("o_orderkey", "RunningTotal"), "RunningTotal", digits=2)


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) as n from orders) where n <= 3 or n between 10 and 12 or n >= 1490")
def select_records(s: SparkSession, d: str) -> DataFrame:
    return ordered.select_records(T(s, d, "orders").select("o_orderkey"), "-3,10-12,1490+", [("o_orderkey", True)])


@query("select c_custkey, ntile(7) over (order by c_acctbal, c_custkey)::int as Tile_Num from customer")
def tile(s: SparkSession, d: str) -> DataFrame:
    rows = T(s, d, "customer").select("c_custkey", F.struct("c_acctbal", "c_custkey").alias("by"))
    return ordered.tile(rows, "by", 7).drop("by")


@query("select c_custkey, least(floor((c_acctbal - (select min(c_acctbal) from customer)) / (((select max(c_acctbal) from customer) - (select min(c_acctbal) from customer)) / 5)) + 1, 5)::int as c_acctbal_Tile_Num from customer")
def multi_field_binning(s: SparkSession, d: str) -> DataFrame:
    return prepare.binning(T(s, d, "customer"), ["c_acctbal"], 5).select("c_custkey", "c_acctbal_Tile_Num")


@query("select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) as n from lineitem) where n = 1")
def unique(s: SparkSession, d: str) -> DataFrame:
    return ordered.unique(T(s, d, "lineitem"), ["l_suppkey"], LINE)["Unique"].select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity")


@query("select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_shipdate from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) as n from lineitem) where n > 1")
def duplicates(s: SparkSession, d: str) -> DataFrame:
    return ordered.unique(T(s, d, "lineitem"), ["l_suppkey"], LINE)["Duplicates"].select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


# --- joins and unions -------------------------------------------------------------------------------


def _orders(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query("select c_custkey, c_name, o_orderkey, o_custkey, o_totalprice from customer join orders on c_custkey = o_custkey")
def join_inner(s: SparkSession, d: str) -> DataFrame:
    return joins.join(T(s, d, "customer").select("c_custkey", "c_name"), _orders(s, d), [("c_custkey", "o_custkey")])["Join"]


@query("select cust_id, name from customer_profiles where cust_id is null or cust_id not in (select cust_id from primary_transactions where cust_id is not null)")
def join_left_only(s: SparkSession, d: str) -> DataFrame:
    """Nulls match nulls: those of the left are left over only if the right has none."""
    right = T(s, d, "primary_transactions").where("cust_id is not null")
    return joins.join(T(s, d, "customer_profiles").select("cust_id", "name"), right, [("cust_id", "cust_id")])["Left"]


@query("select txn_id, cust_id from primary_transactions t where not exists (select 1 from customer_profiles p where p.cust_id is not distinct from t.cust_id)")
def join_right_only(s: SparkSession, d: str) -> DataFrame:
    return joins.join(T(s, d, "customer_profiles"), T(s, d, "primary_transactions").select("txn_id", "cust_id"), [("cust_id", "cust_id")])["Right"]


@query("""with a as (select channel as k, count(*)::bigint as n from primary_transactions group by 1), b as (select channel as k, max(txn_id) as n from primary_transactions group by 1)
select a.k, a.n, b.n as n_right from a join b on a.k is not distinct from b.k""")
def join_null_keys(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d, "primary_transactions")
    a = t.groupBy(F.col("channel").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = t.groupBy(F.col("channel").alias("k")).agg(F.max("txn_id").alias("n"))
    return joins.join(a, b, [("k", "k")])["Join"]


@query("""with a as (select s_suppkey, row_number() over (order by s_suppkey) as i from supplier), b as (select n_name, row_number() over (order by n_nationkey) as i from nation)
select s_suppkey, n_name from a full join b using (i)""")
def join_by_position(s: SparkSession, d: str) -> DataFrame:
    return joins.join_by_position(T(s, d, "supplier").select("s_suppkey"), T(s, d, "nation").select("n_nationkey", "n_name"), [("s_suppkey", True)], [("n_nationkey", True)])["Join"].drop("n_nationkey")


@query("""select coalesce(a.k, b.k, c.k) as k, a.n_customers, b.n_suppliers, c.n_name from (select c_nationkey as k, count(*)::bigint as n_customers from customer group by 1) a
full join (select s_nationkey * 2 as k, count(*)::bigint as n_suppliers from supplier group by 1) b on a.k = b.k
full join (select n_nationkey as k, n_name from nation) c on coalesce(a.k, b.k) = c.k""")
def join_multiple(s: SparkSession, d: str) -> DataFrame:
    a = T(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_customers"))
    b = T(s, d, "supplier").groupBy((F.col("s_nationkey") * 2).alias("k")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    c = T(s, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return joins.join_multiple([a, b, c])


@query("select n_nationkey, n_name, r_name from nation cross join region")
def append_fields(s: SparkSession, d: str) -> DataFrame:
    return joins.append_fields(T(s, d, "nation").select("n_nationkey", "n_name"), T(s, d, "region").select("r_name"))


@query("select p_partkey, coalesce(n_name, p_brand) as p_brand from part left join (select 'Brand#' || (n_nationkey + 10) as b, n_name from nation) on b = p_brand")
def find_replace(s: SparkSession, d: str) -> DataFrame:
    lookup = T(s, d, "nation").select(F.concat(F.lit("Brand#"), F.col("n_nationkey") + 10).alias("b"), "n_name")
    return joins.find_replace(T(s, d, "part").select("p_partkey", "p_brand"), lookup, "p_brand", "b", "n_name")


@query("select p_partkey, replace(replace(p_type, 'STANDARD', 'S'), 'SMALL', 'L') as p_type from part")
def find_replace_part(s: SparkSession, d: str) -> DataFrame:
    lookup = s.createDataFrame([("STANDARD", "S"), ("SMALL", "L")], "f string, r string")
    return joins.find_replace(T(s, d, "part").select("p_partkey", "p_type"), lookup, "p_type", "f", "r", mode="part")


@query("select p_partkey, replace(p_name, split_part(p_name, ' ', 2), '(' || split_part(p_name, ' ', 2) || ')') as p_name from part where p_name like '% %' union all select p_partkey, p_name from part where p_name not like '% %'")
def find_replace_many(s: SparkSession, d: str) -> DataFrame:
    """A rule for every different last word and thousands that find nothing: the way with automata."""
    words = T(s, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("f")).where("f <> ''").distinct().select("f", F.concat(F.lit("("), "f", F.lit(")")).alias("r"))
    others = T(s, d, "orders").select(F.concat(F.lit("order "), "o_orderkey").alias("f"), F.lit("?").alias("r"))
    return joins.find_replace(T(s, d, "part").select("p_partkey", "p_name"), words.union(others), "p_name", "f", "r", mode="part")


@query("""with t as (select lower(trim(name)) as t, min(cust_id) as k from customer_profiles where trim(name) <> '' group by 1)
select least(a.k, b.k) as id_left, greatest(a.k, b.k) as id_right, round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 6) as score from t a join t b on a.k < b.k
where 1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)) >= 0.9""")
def fuzzy_match(s: SparkSession, d: str) -> DataFrame:
    return _r(joins.fuzzy_match(T(s, d, "customer_profiles"), "cust_id", "name", threshold=0.9), "score", digits=6)


_MEMBERS = "m as (select distinct cust_id as k, lower(trim(name)) as t from customer_profiles where trim(name) <> '')"
_SCORE = "1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t))"


@query(f"""with {_MEMBERS}
select a.k as id_left, b.k as id_right, round(max({_SCORE}), 6) as score from m a join m b on a.k < b.k where {_SCORE} >= 0.8 group by 1, 2""")
def fuzzy_match_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs of rows, equal texts too, at the operator's own threshold."""
    return _r(joins.fuzzy_pairs(T(s, d, "customer_profiles"), "cust_id", "name"), "score", digits=6)


@query(f"""with {_MEMBERS}, c as (select t, min(k) as representative, count(*)::bigint as members from m group by 1),
l as (select a.t, count(*)::bigint as links from c a join c b on a.t <> b.t where {_SCORE} >= 0.8 group by 1)
select k as member, representative, members, coalesce(links, 0)::bigint as links from m join c using (t) left join l using (t)""")
def fuzzy_match_members(s: SparkSession, d: str) -> DataFrame:
    """Every row with the class of its text."""
    return joins.fuzzy_members(T(s, d, "customer_profiles"), "cust_id", "name")


@query("""with recursive e as (select distinct workflow_id * 1000 + tool_id as u, workflow_id * 1000 + parent_container_id as v from containers where parent_container_id is not null),
b as (select u, v from e union select v, u from e),
w as (select u as member, u as m from b union select w.member, b.v from w join b on w.m = b.u)
select member, min(m) as "group" from w group by 1""")
def make_group(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "containers").select(F.expr("workflow_id * 1000 + tool_id").alias("u"), F.expr("workflow_id * 1000 + parent_container_id").alias("v"))
    return joins.make_group(e, "u", "v")


@query("select c_custkey as k, c_name as name, c_acctbal as bal, null::varchar as extra from customer union all select s_suppkey, s_name, null, 'supplier' from supplier")
def union_by_name(s: SparkSession, d: str) -> DataFrame:
    a = T(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    b = T(s, d, "supplier").select(F.lit("supplier").alias("extra"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))
    return joins.union([a, b])


@query("select c_custkey, c_name from customer union all select s_suppkey, s_name from supplier")
def union_by_position(s: SparkSession, d: str) -> DataFrame:
    return joins.union([T(s, d, "customer").select("c_custkey", "c_name"), T(s, d, "supplier").select("s_suppkey", "s_name")], by_name=False)


# --- summaries --------------------------------------------------------------------------------------


@query("""select l_suppkey, round(sum(l_quantity), 4) as sum_qty, count(l_tax)::bigint as n, count(distinct l_partkey)::bigint as parts, min(l_discount) as lo, max(l_discount) as hi, round(avg(l_extendedprice), 4) as mean, round(stddev_samp(l_quantity), 6) as sd, round(var_samp(l_quantity), 6) as var, arg_min(l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate)) as first_qty, arg_max(l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate)) as last_qty, median(l_quantity) as med from lineitem group by 1""")
def summarize_actions(s: SparkSession, d: str) -> DataFrame:
    acts = [Action("l_suppkey", "GroupBy"), Action("l_quantity", "Sum", "sum_qty"), Action("l_tax", "Count", "n"), Action("l_partkey", "CountDistinct", "parts"), Action("l_discount", "Min", "lo"), Action("l_discount", "Max", "hi"), Action("l_extendedprice", "Avg", "mean"), Action("l_quantity", "StdDev", "sd"), Action("l_quantity", "Variance", "var"), Action("l_quantity", "First", "first_qty"), Action("l_quantity", "Last", "last_qty"), Action("l_quantity", "Median", "med")]
    out = transform.summarize(T(s, d, "lineitem"), acts, LINE)
    return out.withColumns({"sum_qty": F.round("sum_qty", 4), "mean": F.round("mean", 4), "sd": F.round("sd", 6), "var": F.round("var", 6)})


@query(f"select flag, coalesce(sum(qty), 0) as total, count(qty)::bigint as n from {_NULLED_SQL} where flag is not null group by 1")
def summarize_null_keys(s: SparkSession, d: str) -> DataFrame:
    return transform.summarize(_nulled(s, d), [Action("flag", "GroupBy"), Action("qty", "Sum", "total"), Action("qty", "Count", "n")])


@query("select distinct o_orderstatus, o_orderpriority from orders")
def summarize_distinct(s: SparkSession, d: str) -> DataFrame:
    return transform.summarize(T(s, d, "orders"), [Action("o_orderstatus", "GroupBy"), Action("o_orderpriority", "GroupBy")])


@query("select round(sum(o_totalprice), 2) as total, count(o_orderkey)::bigint as n, string_agg(distinct_status, ',' order by o_orderkey) as all_status from (select o_totalprice, o_orderkey, case when o_orderkey in (select min(o_orderkey) from orders group by o_orderstatus) then o_orderstatus end as distinct_status from orders)")
def summarize_global(s: SparkSession, d: str) -> DataFrame:
    o = T(s, d, "orders")
    first = o.groupBy("o_orderstatus").agg(F.min("o_orderkey").alias("o_orderkey")).select("o_orderkey", F.col("o_orderstatus").alias("st"))
    out = transform.summarize(o.join(first, "o_orderkey", "left"), [Action("o_totalprice", "Sum", "total"), Action("o_orderkey", "Count", "n"), Action("st", "Concat", "all_status")], [("o_orderkey", True)])
    return _r(out, "total", digits=2)


@query("select count(*)::bigint as Count from lineitem")
def count_records(s: SparkSession, d: str) -> DataFrame:
    return transform.count_records(T(s, d, "lineitem"))


@query("""select l_linestatus, round(sum(l_quantity) filter (where l_returnflag = 'A'), 4) as A, round(sum(l_quantity) filter (where l_returnflag = 'N'), 4) as N, round(sum(l_quantity) filter (where l_returnflag = 'R'), 4) as R from lineitem group by 1""")
def crosstab_sum(s: SparkSession, d: str) -> DataFrame:
    return _r(transform.cross_tab(T(s, d, "lineitem"), ["l_linestatus"], "l_returnflag", "l_quantity"), "A", "N", "R")


@query("select c_nationkey, " + ", ".join(f"nullif(count(c_acctbal) filter (where c_mktsegment = '{x}'), 0)::bigint as {x}" for x in SEGMENTS) + " from customer group by 1")
def crosstab_count(s: SparkSession, d: str) -> DataFrame:
    return transform.cross_tab(T(s, d, "customer"), ["c_nationkey"], "c_mktsegment", "c_acctbal", "count")


_DESCENDING = "o_orderdate desc, o_orderpriority, o_orderkey desc"


@query(f"""select o_custkey, arg_min(o_totalprice, r)::double as first_price, arg_max(o_totalprice, r)::double as last_price, arg_min(o_orderstatus, r) as first_status, string_agg(o_orderkey::varchar, ',' order by r) as keys
from (select *, row_number() over (order by {_DESCENDING}) as r from orders) group by 1""")
def summarize_descending(s: SparkSession, d: str) -> DataFrame:
    """First, Last and Concat after a sort in both directions."""
    acts = [Action("o_custkey", "GroupBy"), Action("o_totalprice", "First", "first_price"), Action("o_totalprice", "Last", "last_price"), Action("o_orderstatus", "First", "first_status"), Action("o_orderkey", "Concat", "keys")]
    return transform.summarize(T(s, d, "orders"), acts, [("o_orderdate", False), ("o_orderpriority", True), ("o_orderkey", False)])


@query("""select raised_level, arg_min(diagnostic_id, r)::bigint as first_id, arg_max(diagnostic_id, r)::bigint as last_id
from (select diagnostic_id, coalesce(level, '-') as raised_level, row_number() over (order by tool_id nulls last, category desc nulls last, diagnostic_id, ingested_at) as r from diagnostics) group by 1""")
def summarize_null_order(s: SparkSession, d: str) -> DataFrame:
    """Null sort keys come last in both directions."""
    rows = T(s, d, "diagnostics").withColumn("raised_level", F.coalesce("level", F.lit("-")))
    acts = [Action("raised_level", "GroupBy"), Action("diagnostic_id", "First", "first_id"), Action("diagnostic_id", "Last", "last_id")]
    return transform.summarize(rows, acts, [("tool_id", True), ("category", False), ("diagnostic_id", True), ("ingested_at", True)])


_PICKED = "select *, row_number() over (order by o_totalprice desc, o_orderkey) as r from orders"


@query(f"select o_custkey, " + ", ".join(f"arg_min(o_orderkey, r) filter (where o_orderstatus = '{x}')::bigint as {x}" for x in "FOP") + f" from ({_PICKED}) group by 1")
def crosstab_first(s: SparkSession, d: str) -> DataFrame:
    return transform.cross_tab(T(s, d, "orders"), ["o_custkey"], "o_orderstatus", "o_orderkey", "first", order=[("o_totalprice", False), ("o_orderkey", True)])


@query(f"select o_custkey, " + ", ".join(f"string_agg(o_orderkey::varchar, ', ' order by r) filter (where o_orderstatus = '{x}') as {x}" for x in "FOP") + f" from ({_PICKED}) group by 1")
def crosstab_concat(s: SparkSession, d: str) -> DataFrame:
    return transform.cross_tab(T(s, d, "orders"), ["o_custkey"], "o_orderstatus", "o_orderkey", "concat", order=[("o_totalprice", False), ("o_orderkey", True)])


@query("from (select s_suppkey, s_nationkey::double as s_nationkey, s_acctbal from supplier) unpivot include nulls (Value for Name in (s_nationkey, s_acctbal))")
def transpose(s: SparkSession, d: str) -> DataFrame:
    return transform.transpose(T(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_suppkey"])


# --- parse ------------------------------------------------------------------------------------------


@query("select p_partkey, p_name, split_part(p_name, ' ', 1) as p_name_0, nullif(split_part(p_name, ' ', 2), '') as p_name_1 from part")
def text_to_columns(s: SparkSession, d: str) -> DataFrame:
    out = parse.text_to_columns(T(s, d, "part").select("p_partkey", "p_name"), "p_name", " ")
    return out.select("p_partkey", "p_name", "p_name_0", "p_name_1")


@query("select p_partkey, unnest(string_split(p_name, ' ')) as p_name from part")
def text_to_rows(s: SparkSession, d: str) -> DataFrame:
    return parse.text_to_columns(T(s, d, "part").select("p_partkey", "p_name"), "p_name", " ", to_rows=True)


@query("select c_custkey, nullif(regexp_extract(c_name, '#0*(\\d+)', 1), '') as c_name_regex from customer")
def regex_parse(s: SparkSession, d: str) -> DataFrame:
    return parse.regex(T(s, d, "customer").select("c_custkey", "c_name"), "c_name", r"#0*(\d+)").drop("c_name")


@query("select c_custkey, regexp_replace(c_name, '[0-9]+', 'N', 'g') as c_name from customer")
def regex_replace(s: SparkSession, d: str) -> DataFrame:
    return parse.regex(T(s, d, "customer").select("c_custkey", "c_name"), "c_name", "[0-9]+", "replace", replacement="N")


@query("select p_partkey, unnest(regexp_extract_all(p_name, '[aeiou]')) as v from part")
def regex_tokenize(s: SparkSession, d: str) -> DataFrame:
    return parse.regex(T(s, d, "part").select("p_partkey", "p_name"), "p_name", "[aeiou]", "tokenize", split_rows=True, out=["v"]).drop("p_name")


@query("select o_orderkey, strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y')::timestamp as parsed from orders")
def datetime_parse(s: SparkSession, d: str) -> DataFrame:
    texts = T(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("t"))
    return parse.date_time(texts, "t", "parsed", "%d.%m.%Y").drop("t")


@query("select event_id, json_extract_string(props, '$.k') as value from events")
def json_parse(s: SparkSession, d: str) -> DataFrame:
    out = parse.json_parse(T(s, d, "events").select("event_id", "props"), "props", name="name", value="value")
    return out.where("name = 'k'").select("event_id", "value")


@query()
def xml_parse(s: SparkSession, d: str) -> DataFrame:
    return parse.xml_parse(T(s, d, "tools").select("record_id", "raw_xml"), "raw_xml", {"expression": "Expression", "mode": "Mode"}).select("record_id", "expression", "mode")


# --- spatial ----------------------------------------------------------------------------------------


def _points(s: SparkSession, d: str, name: str, key: str) -> DataFrame:
    df = T(s, d, name).select(key, F.expr(f"({key} * 37 % 3600) / 10.0 - 180").alias("x"), F.expr(f"({key} * 53 % 1600) / 10.0 - 80").alias("y"))
    return spatial.create_points(df, "x", "y", "p").select(key, "p")


_HAVERSINE = "2 * 6371.0088 * asin(sqrt(least(1, pow(sin((radians(b.y) - radians(a.y)) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))))"


@query(f"""with p as (select s_suppkey as k, (s_suppkey * 37 % 3600) / 10.0 - 180 as x, (s_suppkey * 53 % 1600) / 10.0 - 80 as y from supplier)
select a.k as s_suppkey, round({_HAVERSINE}, 4) as Distance from p a, (select 0 as x, 0 as y) b""")
def distance(s: SparkSession, d: str) -> DataFrame:
    df = _points(s, d, "supplier", "s_suppkey").withColumn("o", F.struct(F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat")))
    return _r(spatial.distance(df, "p", "o").select("s_suppkey", "Distance"), "Distance")


@query(f"""with a as (select s_suppkey, (s_suppkey * 37 % 3600) / 10.0 - 180 as x, (s_suppkey * 53 % 1600) / 10.0 - 80 as y from supplier), b as (select c_custkey, (c_custkey * 37 % 3600) / 10.0 - 180 as x, (c_custkey * 53 % 1600) / 10.0 - 80 as y from customer),
d as (select s_suppkey, c_custkey, {_HAVERSINE} as km, abs(a.x - b.x) as dx from a, b)
select s_suppkey, arg_min(c_custkey, (km, c_custkey)) as nearest_c_custkey, round(min(km), 4) as "DistanceKm" from d where km <= 200 and dx < 180 group by 1""")
def find_nearest(s: SparkSession, d: str) -> DataFrame:
    out = spatial.find_nearest(_points(s, d, "supplier", "s_suppkey"), _points(s, d, "customer", "c_custkey"), "s_suppkey", "p", "c_custkey", "p", 200)["Matched"]
    return _r(out.drop("p"), "DistanceKm")


# both sides around the date line, at no common place
_APART = {"supplier": ("s_suppkey", "({k} * 37 % 4000) / 100.0 + 160", "({k} * 53 % 1600) / 10.0 - 80"), "customer": ("c_custkey", "({k} * 71 % 4000) / 100.0 + 160.005", "({k} * 29 % 1600) / 10.0 - 79.97")}


def _apart_sql(name: str) -> str:
    k, x, y = _APART[name]
    return f"(select {k}, case when x >= 180 then x - 360 else x end as x, y from (select {k}, {x.format(k=k)} as x, {y.format(k=k)} as y from {name}))"


def _apart(s: SparkSession, d: str, name: str) -> DataFrame:
    k, x, y = _APART[name]
    df = T(s, d, name).select(k, F.expr(x.format(k=k)).cast("double").alias("x"), F.expr(y.format(k=k)).cast("double").alias("y"))
    return spatial.create_points(df.withColumn("x", F.expr("case when x >= 180 then x - 360 else x end")), "x", "y", "p").select(k, "p")


@query(f"""with a as {_apart_sql("supplier")}, b as {_apart_sql("customer")}, d as (select s_suppkey, c_custkey, {_HAVERSINE} as km from a, b)
select s_suppkey, arg_min(c_custkey, (km, c_custkey)) as nearest_c_custkey, round(min(km), 4) as "DistanceKm" from d where km <= 200 group by 1""")
def find_nearest_apart(s: SparkSession, d: str) -> DataFrame:
    """Points that don't coincide, on both sides of the date line."""
    out = spatial.find_nearest(_apart(s, d, "supplier"), _apart(s, d, "customer"), "s_suppkey", "p", "c_custkey", "p", 200)["Matched"]
    return _r(out.drop("p"), "DistanceKm")


@query("""with p as (select (s_suppkey * 37 % 3600) / 10.0 - 180 as x, (s_suppkey * 53 % 1600) / 10.0 - 80 as y from supplier)
select floor(x / 7.5)::bigint as cell_x, floor(y / 7.5)::bigint as cell_y, count(*)::bigint as n from p group by 1, 2""")
def heat_map(s: SparkSession, d: str) -> DataFrame:
    return spatial.heat_map(_points(s, d, "supplier", "s_suppkey"), "p", 7.5)


@query("""with p as (select (s_suppkey * 37 % 3600) / 10.0 - 180 as x, (s_suppkey * 53 % 1600) / 10.0 - 80 as y from supplier),
e as (select floor(min(x) / 7.5)::bigint as x0, floor(max(x) / 7.5)::bigint as x1, floor(min(y) / 7.5)::bigint as y0, floor(max(y) / 7.5)::bigint as y1 from p),
xs as (select unnest(range(x0, x1 + 1)) as cell_x from e), ys as (select unnest(range(y0, y1 + 1)) as cell_y from e)
select cell_x, cell_y, (cell_x * 7.5)::double as lon, (cell_y * 7.5)::double as lat from xs, ys""")
def make_grid(s: SparkSession, d: str) -> DataFrame:
    return spatial.make_grid(_points(s, d, "supplier", "s_suppkey"), "p", 7.5)


@query("select s_suppkey, 36 as corners, 25.0::double as least, 25.0::double as most from supplier")
def buffer(s: SparkSession, d: str) -> DataFrame:
    """All corners of the polygon are as far away as asked."""
    df = polygons.buffer(_points(s, d, "supplier", "s_suppkey"), "p", 25)
    far = F.transform(F.col("Buffer")[0], lambda q: F.round(spatial.haversine(F.col("p"), q), 6))
    return df.select("s_suppkey", F.size(far).alias("corners"), F.array_min(far).alias("least"), F.array_max(far).alias("most"))


# sines of the sphere's caps: an area between two circles is as large as the difference of its caps, less what 720 corners cut off
@query("""select s_suppkey, r as "Radius", (case when r = 10.0 then 1 else 2 end)::int as rings, round(2 * pi() * pow(6371.0088, 2) * (cos(coalesce(q, 0) / 6371.0088) - cos(r / 6371.0088)), 0) as km2
from supplier, (values (10.0::double, null::double), (30.0, 10.0), (45.0, 30.0)) t(r, q)""")
def trade_area(s: SparkSession, d: str) -> DataFrame:
    df = polygons.trade_area(_points(s, d, "supplier", "s_suppkey").withColumn("p", F.struct(F.col("p.lon"), (F.col("p.lat") / 2).alias("lat"))), "p", [30, 10, 45], corners=720)
    return df.select("s_suppkey", "Radius", F.size("TradeArea").alias("rings"), F.round(polygons.area(F.col("TradeArea")), 0).alias("km2"))


_DIAMOND = "(select s_suppkey, (s_suppkey * 37 % 3600) / 10.0 - 180 + 0.0123 as x, (s_suppkey * 53 % 1400) / 10.0 - 70 + 0.0171 as y, 0.3 + s_suppkey % 7 * s_suppkey % 11 as r from supplier)"


def _diamonds(s: SparkSession, d: str) -> DataFrame:
    df = T(s, d, "supplier").select("s_suppkey", F.expr("(s_suppkey * 37 % 3600) / 10.0 - 180 + 0.0123").alias("x"), F.expr("(s_suppkey * 53 % 1400) / 10.0 - 70 + 0.0171").alias("y"), F.expr("0.3 + s_suppkey % 7 * s_suppkey % 11").alias("r"))
    corner = lambda dx, dy: F.struct((F.col("x") + dx * F.col("r")).cast("double").alias("lon"), (F.col("y") + dy * F.col("r")).cast("double").alias("lat"))
    return df.select("s_suppkey", F.array(F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1))).alias("area"))


@query(f"select c_custkey, s_suppkey from (select c_custkey, (c_custkey * 37 % 3600) / 10.0 - 180 as px, (c_custkey * 53 % 1600) / 10.0 - 80 as py from customer), {_DIAMOND} where abs(px - x) + abs(py - y) < r")
def spatial_match(s: SparkSession, d: str) -> DataFrame:
    """Points in polygons from a third of a degree to more than ten in size."""
    return polygons.spatial_match(_points(s, d, "customer", "c_custkey"), _diamonds(s, d), "p", "area")["Matched"].select("c_custkey", "s_suppkey")


@query(f"select c_custkey from (select c_custkey, (c_custkey * 37 % 3600) / 10.0 - 180 as px, (c_custkey * 53 % 1600) / 10.0 - 80 as py from customer) where not exists (select 1 from {_DIAMOND} where abs(px - x) + abs(py - y) < r)")
def spatial_match_none(s: SparkSession, d: str) -> DataFrame:
    return polygons.spatial_match(_points(s, d, "customer", "c_custkey"), _diamonds(s, d), "p", "area")["Unmatched"].select("c_custkey")


# boxes along parallels and meridians, whose areas are known exactly
@query("""select s_suppkey, round(pow(6371.0088, 2) * radians(w) * (sin(radians(y + h)) - sin(radians(y))), 3) as "AreaKm2", round(x, 6)::double as "MinLon", round(y + h, 6)::double as "MaxLat", round(x + w / 2, 6)::double as lon, round(y + h / 2, 6)::double as lat, 4 as "Points"
from (select s_suppkey, ((s_suppkey * 37 % 3000) / 10.0 - 170)::double as x, ((s_suppkey * 53 % 1400) / 10.0 - 80)::double as y, (1 + s_suppkey % 5)::double as w, (1 + s_suppkey % 3)::double as h from supplier)""")
def spatial_info(s: SparkSession, d: str) -> DataFrame:
    df = T(s, d, "supplier").select("s_suppkey", F.expr("(s_suppkey * 37 % 3000) / 10.0 - 170").alias("x"), F.expr("(s_suppkey * 53 % 1400) / 10.0 - 80").alias("y"), F.expr("1 + s_suppkey % 5").alias("w"), F.expr("1 + s_suppkey % 3").alias("h"))
    corner = lambda a, b: F.struct((F.col("x") + a * F.col("w")).cast("double").alias("lon"), (F.col("y") + b * F.col("h")).cast("double").alias("lat"))
    made = polygons.spatial_info(df.withColumn("box", F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)))), "box")
    return made.select("s_suppkey", F.round("AreaKm2", 3).alias("AreaKm2"), F.round("MinLon", 6).alias("MinLon"), F.round("MaxLat", 6).alias("MaxLat"), F.round("Center.lon", 6).alias("lon"), F.round("Center.lat", 6).alias("lat"), "Points")


_STOPS = "(select o_custkey, (o_orderkey % 360 - 180)::double as x, (o_orderkey * 7 % 170 - 85)::double as y, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as i, count(*) over (partition by o_custkey) as n from orders)"


def _tours(s: SparkSession, d: str) -> DataFrame:
    df = spatial.create_points(T(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.expr("o_orderkey % 360 - 180").alias("x"), F.expr("o_orderkey * 7 % 170 - 85").alias("y")), "x", "y", "p")
    return polygons.poly_build(df, "p", ["o_custkey"], [("o_orderdate", False), ("o_orderkey", True)])


@query(f"select o_custkey, i::int as \"Place\", x as lon, y as lat from {_STOPS} where n > 2")
def poly_build(s: SparkSession, d: str) -> DataFrame:
    """Points to polygons in the order of dates, and apart again."""
    return polygons.poly_split(_tours(s, d), "Polygon").select("o_custkey", "Place", "Point.lon", "Point.lat")


@query(f"""with e as (select o_custkey, i, x, y, coalesce(lead(x) over w, first_value(x) over w) as x1, coalesce(lead(y) over w, first_value(y) over w) as y1 from {_STOPS} where n > 2 window w as (partition by o_custkey order by i))
select o_custkey, (2 * i - 1)::int as "Place", x * 0.75 + x1 * 0.25 as lon, y * 0.75 + y1 * 0.25 as lat from e union all select o_custkey, (2 * i)::int, x * 0.25 + x1 * 0.75, y * 0.25 + y1 * 0.75 from e""")
def smooth(s: SparkSession, d: str) -> DataFrame:
    return polygons.poly_split(polygons.smooth(_tours(s, d), "Polygon", 1), "Polygon").select("o_custkey", "Place", "Point.lon", "Point.lat")


@query(f"select s_suppkey, k::int as \"Place\", round(x + dx * r, 6)::double as lon, round(y + dy * r, 6)::double as lat from {_DIAMOND}, (values (1, 1, 0), (2, 0, 1), (3, -1, 0), (4, 0, -1)) t(k, dx, dy)")
def generalize(s: SparkSession, d: str) -> DataFrame:
    """Points on the edges are left out again, the corners are kept."""
    middle = lambda e: F.struct(*[((e["a"][k] + e["b"][k]) / 2).alias(k) for k in ("lon", "lat")])
    more = F.transform("area", lambda ring: F.flatten(F.transform(polygons._next(ring), lambda e: F.array(e["a"], middle(e)))))
    out = polygons.poly_split(polygons.generalize(_diamonds(s, d).withColumn("area", more), "area", 1e-6), "area")
    return out.select("s_suppkey", "Place", F.round("Point.lon", 6).alias("lon"), F.round("Point.lat", 6).alias("lat"))


@query("""select s_suppkey, case when a < 1 then round((1 - a) * (1 - b), 9) end as common from (select s_suppkey, s_suppkey % 13 / 8.0 as a, s_suppkey % 7 / 8.0 as b from supplier)""")
def spatial_process(s: SparkSession, d: str) -> DataFrame:
    """Unit squares, one of them moved: what they have in common, in square degrees."""
    df = T(s, d, "supplier").select("s_suppkey", F.expr("s_suppkey % 13 / 8.0D").alias("a"), F.expr("s_suppkey % 7 / 8.0D").alias("b"))
    square = lambda x, y: F.array(F.array(*[F.struct((x + i).alias("lon"), (y + j).alias("lat")) for i, j in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]))
    made = polygons.spatial_process(df.withColumn("one", square(F.lit(0.0), F.lit(0.0))).withColumn("two", square(F.col("a"), F.col("b"))), "one", "two", "intersect")
    plane = F.aggregate(polygons._next(F.col("Processed")[0]), F.lit(0.0), lambda t, e: t + e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]) / 2
    return made.select("s_suppkey", F.round(plane, 9).alias("common"))


# --- sources and sinks ------------------------------------------------------------------------------


@query("select 'a' as id, '1' as v union all select 'b', null")
def text_input(s: SparkSession, d: str) -> DataFrame:
    return files.text_input(s, ["id", "v"], [["a", "1"], ["b"]])


@query("select * from region order by r_regionkey limit 3")
def input_limit(s: SparkSession, d: str) -> DataFrame:
    return files.read(s, files.locate(f"{d}/region.parquet"), limit=3)


@query("select r_regionkey, r_name from region union all select r_regionkey, r_name from region")
def dynamic_input(s: SparkSession, d: str) -> DataFrame:
    paths = s.createDataFrame([(f"{d}/region.parquet",), (f"{d}/region.parquet",)], "path string")
    return files.dynamic_input(paths, "path").select("r_regionkey", "r_name")
