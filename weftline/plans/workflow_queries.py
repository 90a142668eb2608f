"""Whole documents over the tables: read, compiled and run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.compiler import Compiled, compile_workflow
from weftline.plans.document import load


def _document(nodes: list[tuple[int, str, str]], links: list[tuple[int, str, int, str]]) -> bytes:
    made = "".join(f'<Node ToolID="{i}"><GuiSettings Plugin="{kind}"/><Properties><Configuration>{config}</Configuration><Annotation><Name>step {i}</Name></Annotation></Properties></Node>' for i, kind, config in nodes)
    wires = "".join(f'<Connection><Origin ToolID="{a}" Connection="{x}"/><Destination ToolID="{b}" Connection="{y}"/></Connection>' for a, x, b, y in links)
    return f'<?xml version="1.0"?><Document yxmdVer="2024.1"><Nodes>{made}</Nodes><Connections>{wires}</Connections></Document>'.encode()


def _line(*steps: int) -> list[tuple[int, str, int, str]]:
    return [(a, "Output", b, "Input") for a, b in zip(steps, steps[1:], strict=False)]


# both outputs of a filter are summed up and joined again
BRANCHES = _document(
    [
        (10, "DbFileInput", "<File>lineitem.parquet</File>"), (12, "Formula", '<FormulaFields><FormulaField field="gross" expression="[l_extendedprice] * (1 - [l_discount])" type="Double"/></FormulaFields>'),
        (14, "Filter", "<Expression>[l_returnflag] == 'R'</Expression>"),
        (16, "Summarize", '<SummarizeFields><SummarizeField field="l_suppkey" action="GroupBy"/><SummarizeField field="gross" action="Sum" rename="returned"/></SummarizeFields>'),
        (18, "Summarize", '<SummarizeFields><SummarizeField field="l_suppkey" action="GroupBy"/><SummarizeField field="gross" action="Sum" rename="kept"/><SummarizeField field="l_orderkey" action="CountDistinct" rename="n_orders"/></SummarizeFields>'),
        (20, "Join", '<JoinInfo connection="Left"><Field field="l_suppkey"/></JoinInfo><JoinInfo connection="Right"><Field field="l_suppkey"/></JoinInfo>'),
        (22, "Formula", '<FormulaFields><FormulaField field="share" expression="[returned] / ([returned] + [kept])" type="Double"/></FormulaFields>'), (24, "BrowseV2", ""),
    ],
    [*_line(10, 12, 14), (14, "True", 16, "Input"), (14, "False", 18, "Input"), (16, "Output", 20, "Left"), (18, "Output", 20, "Right"), (20, "J", 22, "Input"), *_line(22, 24)],
)
# numbers and the row above behind a sort
RANKED = _document(
    [
        (1, "DbFileInput", "<File>orders.parquet</File>"), (2, "Sort", '<SortInfo><Field field="o_totalprice" order="Descending"/><Field field="o_orderkey" order="Ascending"/></SortInfo>'),
        (3, "RecordID", "<FieldName>position</FieldName><StartValue>1</StartValue>"),
        (4, "MultiRowFormula", "<UpdateField_Name>gap</UpdateField_Name><CreateField_Name>gap</CreateField_Name><Expression>[Row-1:o_totalprice] - [o_totalprice]</Expression>"),
        (5, "DbFileInput", "<File>customer.parquet</File>"), (6, "Join", '<JoinInfo connection="Left"><Field field="o_custkey"/></JoinInfo><JoinInfo connection="Right"><Field field="c_custkey"/></JoinInfo>'),
        (7, "Select", '<SelectFields><SelectField field="position" selected="True"/><SelectField field="o_orderkey" selected="True" rename="order"/><SelectField field="gap" selected="True"/><SelectField field="c_mktsegment" selected="True" rename="segment"/><SelectField field="*Unknown" selected="False"/></SelectFields>'), (8, "BrowseV2", ""),
    ],
    [*_line(1, 2, 3, 4), (4, "Output", 6, "Left"), (5, "Output", 6, "Right"), (6, "J", 7, "Input"), *_line(7, 8)],
)
# first and later deliveries, counted apart and brought together; what has no later one stays
REDELIVERED = _document(
    [
        (31, "DbFileInput", "<File>connections.parquet</File>"), (32, "Sort", '<SortInfo><Field field="ingested_at" order="Ascending"/></SortInfo>'), (33, "Unique", '<UniqueFields><Field field="connection_id"/></UniqueFields>'),
        (34, "Summarize", '<SummarizeFields><SummarizeField field="workspace_id" action="GroupBy"/><SummarizeField field="connection_id" action="Count" rename="firsts"/><SummarizeField field="ingested_at" action="Min" rename="since"/></SummarizeFields>'),
        (35, "Summarize", '<SummarizeFields><SummarizeField field="workspace_id" action="GroupBy"/><SummarizeField field="connection_id" action="Count" rename="repeats"/></SummarizeFields>'),
        (36, "Join", '<JoinInfo connection="Left"><Field field="workspace_id"/></JoinInfo><JoinInfo connection="Right"><Field field="workspace_id"/></JoinInfo>'),
        (37, "Union", "<Mode>ByName</Mode>"), (38, "BrowseV2", ""),
    ],
    [*_line(31, 32, 33), (33, "Unique", 34, "Input"), (33, "Duplicates", 35, "Input"), (34, "Output", 36, "Left"), (35, "Output", 36, "Right"), (36, "J", 37, "#1"), (36, "L", 37, "#2"), *_line(37, 38)],
)
# names in words, the words across, and back
PARTS = _document(
    [
        (101, "DbFileInput", "<File>part.parquet</File>"), (102, "TextToColumns", "<Field>p_name</Field><Delimeters> </Delimeters><NumFields>2</NumFields>"),
        (103, "CrossTab", '<GroupFields><Field field="p_brand"/></GroupFields><HeaderField>p_name_1</HeaderField><DataField>p_retailprice</DataField><Method>Max</Method>'),
        (104, "Transpose", '<KeyFields><Field field="p_brand"/></KeyFields>'), (105, "Filter", "<Expression>!IsNull([Value])</Expression>"), (106, "BrowseV2", ""),
    ],
    [*_line(101, 102, 103, 104, 105), (105, "True", 106, "Input")],
)
# an unknown tool, an unknown field and a file that is not there
BROKEN = _document(
    [(1, "DbFileInput", "<File>region.parquet</File>"), (2, "Wormhole", ""), (3, "BrowseV2", ""), (4, "Summarize", '<SummarizeFields><SummarizeField field="r_climate" action="Max"/><SummarizeField field="r_name" action="Count" rename="n"/></SummarizeFields>'), (5, "BrowseV2", ""), (6, "DbFileInput", "<File>gone.parquet</File>")],
    [*_line(1, 2, 3), *_line(1, 4, 5)],
)


def _compiled(document: bytes, spark: SparkSession, d: str) -> Compiled:
    return compile_workflow(load(document), spark, base=d)


def flow_branches(spark: SparkSession, d: str) -> DataFrame:
    df = _compiled(BRANCHES, spark, d).frame(22)
    return df.select("l_suppkey", F.round("returned", 2).alias("returned"), F.round("kept", 2).alias("kept"), "n_orders", F.round("share", 6).alias("share"))


def flow_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _compiled(RANKED, spark, d).frame(7).withColumn("gap", F.round("gap", 2))


def flow_redelivered(spark: SparkSession, d: str) -> DataFrame:
    return _compiled(REDELIVERED, spark, d).frame(37).select("workspace_id", "firsts", "since", "repeats")


def flow_parts(spark: SparkSession, d: str) -> DataFrame:
    return _compiled(PARTS, spark, d).frame(105, "True")


def flow_part_words(spark: SparkSession, d: str) -> DataFrame:
    return _compiled(PARTS, spark, d).frame(102).select("p_partkey", "p_name_0", "p_name_1")


def flow_lineage(spark: SparkSession, d: str) -> DataFrame:
    return _compiled(BRANCHES, spark, d).lineage_frame()


def flow_tools(spark: SparkSession, d: str) -> DataFrame:
    return _compiled(REDELIVERED, spark, d).tools_frame().select("tool_id", "tool", "is_blocked")


def flow_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return _compiled(BROKEN, spark, d).diagnostics_frame().select("level", "category", "tool_id")


_FLOWS = (flow_branches, flow_ranked, flow_redelivered, flow_parts, flow_part_words, flow_lineage, flow_tools, flow_diagnostics)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _FLOWS}

ORACLES: dict[str, str] = {
    "flow_branches": """
with t as (select l_suppkey, l_orderkey, l_returnflag, l_extendedprice * (1 - l_discount) as gross from lineitem)
select l_suppkey, round(sum(gross) filter (where l_returnflag = 'R'), 2) as returned, round(sum(gross) filter (where l_returnflag <> 'R'), 2) as kept,
  count(distinct l_orderkey) filter (where l_returnflag <> 'R')::bigint as n_orders, round(sum(gross) filter (where l_returnflag = 'R') / sum(gross), 6) as share
from t group by 1 having count(*) filter (where l_returnflag = 'R') > 0 and count(*) filter (where l_returnflag <> 'R') > 0""",
    "flow_ranked": """
select position::bigint as position, o_orderkey as "order", round(gap, 2) as gap, c_mktsegment as segment from (
  select *, row_number() over w as position, lag(o_totalprice) over w - o_totalprice as gap from orders window w as (order by o_totalprice desc, o_orderkey)) o
join customer on o_custkey = c_custkey""",
    "flow_redelivered": """
with n as (select *, row_number() over (partition by connection_id order by ingested_at) as r from connections)
select workspace_id, count(*) filter (where r = 1)::bigint as firsts, min(ingested_at) filter (where r = 1) as since, nullif(count(*) filter (where r > 1), 0)::bigint as repeats
from n where workspace_id is not null group by 1 having count(*) filter (where r = 1) > 0""",
    "flow_parts": "select p_brand, split_part(p_name, ' ', 2) as Name, max(p_retailprice) as Value from part group by 1, 2",
    "flow_lineage": """
select * from (values
  ('step 10', 'l_suppkey', 'step 24', 'l_suppkey', 'Aggregation'), ('step 10', 'l_extendedprice', 'step 24', 'returned', 'Aggregation'), ('step 10', 'l_discount', 'step 24', 'returned', 'Aggregation'),
  ('step 10', 'l_extendedprice', 'step 24', 'kept', 'Aggregation'), ('step 10', 'l_discount', 'step 24', 'kept', 'Aggregation'), ('step 10', 'l_orderkey', 'step 24', 'n_orders', 'Aggregation'),
  ('step 10', 'l_extendedprice', 'step 24', 'share', 'Derived Calculation'), ('step 10', 'l_discount', 'step 24', 'share', 'Derived Calculation')
) t(source_table, source_field, target_table, target_field, kind)""",
    "flow_tools": "select * from (values (31, 'Input Data', false), (32, 'Sort', false), (33, 'Unique', false), (34, 'Summarize', false), (35, 'Summarize', false), (36, 'Join', false), (37, 'Union', false), (38, 'Browse', false)) t(tool_id, tool, is_blocked)",
    "flow_diagnostics": "select * from (values ('ERROR', 'unsupported_tool', 2), ('WARNING', 'unresolved_field', 4), ('INFO', 'external_dependency', 6), ('ERROR', 'build_error', 6)) t(level, category, tool_id)",
    "flow_part_words": "select p_partkey, split_part(p_name, ' ', 1) as p_name_0, nullif(split_part(p_name, ' ', 2), '') as p_name_1 from part",
}
