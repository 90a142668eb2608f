"""Queries p1 to p5 over the tables of TESTDATA.md."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.drift import drift_of_records, read_drifting
from weftline.operators.flatten import explode_arrays, flatten_texts
from weftline.operators.hierarchy import FRAGMENT, container_links, resolve_forest
from weftline.operators.references import Parents, References, find_orphans, orphan_report
from weftline.operators.terms import count_terms, mark_terms
from weftline.session import ensure_checkpoint_dir, table


def _term_counts(spark: SparkSession, d: str) -> DataFrame:
    tools, diagnostics = table(spark, d, "tools"), table(spark, d, "diagnostics")
    return count_terms([(tools, "workflow_id", {"tool_type": "tool_type", "plugin": "plugin"}), (diagnostics, "workflow_id", {"category": "category"})])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    marked = mark_terms(_term_counts(spark, d), table(spark, d, "workflows").select("workflow_id"))
    return marked.where("mark is not null").select(F.col("field").alias("field_name"), "term", "mark")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return _term_counts(spark, d).select(F.col("field").alias("field_name"), "term", "occurrences", "records")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten_texts(table(spark, d, "tools"), "record_id", {"xml": ("raw_xml", "xml"), "json": ("parsed", "json")})


def p2_json(spark: SparkSession, d: str) -> DataFrame:
    """The objects alone, by the same operator: what SQL can walk through too."""
    return flatten_texts(table(spark, d, "tools"), "record_id", {"json": ("parsed", "json")})


def p2_output_fields(spark: SparkSession, d: str) -> DataFrame:
    return explode_arrays(table(spark, d, "tools"), "record_id", "output_fields")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return find_orphans(
        [
            References("connections", table(spark, d, "connections"), "connection_id", "workflow_id", ("origin_tool_id", "destination_tool_id"), "ingested_at"),
            References("diagnostics", table(spark, d, "diagnostics"), "diagnostic_id", "workflow_id", ("tool_id",), "ingested_at"),
        ],
        Parents(table(spark, d, "tools"), "workflow_id", "tool_id", "ingested_at", "deleted_at"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_id", "ref_field", "reason", F.date_format("seen_at", "yyyy-MM").alias("ref_month"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchies(spark, d, FRAGMENT)


def p4_quotients(spark: SparkSession, d: str) -> DataFrame:
    """The same rows by way of fragments of 4 nodes, so that most hierarchies are contracted, solved as quotients and expanded."""
    return _hierarchies(spark, d, 4)


def _hierarchies(spark: SparkSession, d: str, fragment: int) -> DataFrame:
    links = container_links(table(spark, d, "containers"), scope="workflow_id", key="tool_id", parent="parent_container_id", children="child_tool_ids", seen_at="ingested_at")
    return resolve_forest(links, fragment=fragment).select(
        F.col("scope").alias("workflow_id"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").alias("node_depth"),
        F.col("path").alias("node_path"), F.col("state").alias("node_state"), "n_descendants",
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    drift = drift_of_records(table(spark, d, "tools"), table(spark, d, "workflows"), owner="workflow_id", kind="tool_type", text="raw_xml", version_owner="workflow_id", version="version")
    return drift.select(F.col("kind").alias("tool_type"), "since_release", "change_kind", "field_path", "new_field_path")


def _drifting_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The tools as three writers with different schemas would have left them, read as one: rows saved before 2024, in 2024
    and later or at no time."""
    tools = table(spark, d, "tools")
    year = F.year("modified_at")
    versions = [
        tools.where(year < 2024).select("record_id", F.col("pos_x").cast("int").alias("at_x"), F.col("pos_y").cast("smallint").alias("at_y"), "name", F.struct("workflow_id", "tool_id").alias("ref")),
        tools.where(year == 2024).select("record_id", F.col("pos_x").cast("decimal(12,2)").alias("at_x"), F.col("pos_y").cast("float").alias("at_y"), F.col("name").alias("label"), F.struct("tool_id", "workflow_id", "container_id").alias("ref")),
        tools.where((year > 2024) | year.isNull()).select("record_id", F.col("pos_x").cast("bigint").alias("at_x"), F.col("pos_y").cast("int").alias("at_y"), F.col("name").alias("label"), F.to_date("modified_at").alias("day")),
    ]
    folder = f"{ensure_checkpoint_dir(spark)}/drift-{uuid.uuid4().hex}"
    paths: list[str] = []
    for i, v in enumerate(versions):
        v.write.parquet(f"{folder}/{i}")
        paths += sorted(spark.read.parquet(f"{folder}/{i}").inputFiles())
    return read_drifting(spark, [p.replace("file:///", "/") for p in paths])


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    """One table of files whose columns are added, renamed, removed and retyped, nested ones too."""
    files, _ = _drifting_files(spark, d)
    return files.select("record_id", F.col("at_x").cast("double").alias("at_x"), F.col("at_y").cast("double").alias("at_y"), "name", "label", "ref.workflow_id", "ref.tool_id", "ref.container_id", "day")


def p5_file_changes(spark: SparkSession, d: str) -> DataFrame:
    """What has changed between them."""
    _, log = _drifting_files(spark, d)
    return log.select("change_kind", "field", "old_type", "new_type")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p2_found": p2_found,
    "p2_json": p2_json,
    "p2_output_fields": p2_output_fields,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_quotients": p4_quotients,
    "p5_found": p5_found,
    "p5_files": p5_files,
    "p5_file_changes": p5_file_changes,
}

_TERMS = """
with rows as (
  select 'tool_type' as field_name, tool_type as v, workflow_id from tools
  union all select 'plugin', plugin, workflow_id from tools
  union all select 'category', category, workflow_id from diagnostics),
terms as (
  select field_name, lower(trim(v, chr(32) || chr(9) || chr(10) || chr(13))) as term, workflow_id from rows),
counts as (
  select field_name, term, count(*)::bigint as occurrences, count(distinct workflow_id)::bigint as records
  from terms where term <> '' group by 1, 2)
"""

_ORPHANS = """
with raw as (
  select 'connections' as ref_table, connection_id as ref_id, 'origin_tool_id' as ref_field, workflow_id, origin_tool_id as k, ingested_at from connections
  union all select 'connections', connection_id, 'destination_tool_id', workflow_id, destination_tool_id, ingested_at from connections
  union all select 'diagnostics', diagnostic_id, 'tool_id', workflow_id, tool_id, ingested_at from diagnostics),
refs as (
  select ref_table, ref_id, ref_field, workflow_id, k, min(ingested_at) as seen from raw where k is not null group by all),
held as (
  select workflow_id, tool_id, min(ingested_at) as first_seen, min(deleted_at) as first_deleted, true as held from tools group by 1, 2),
judged as (
  select r.*, case when held is null then 'missing' when seen < first_seen then 'late' when first_deleted <= seen then 'deleted' end as reason
  from refs r left join held h on r.workflow_id = h.workflow_id and r.k = h.tool_id)
"""

ORACLES: dict[str, str] = {
    "p1_found": _TERMS
    + """select field_name, term, mark from (
  select *, case when records < 3 then 'rare' when records > 0.2 * (select count(distinct workflow_id) from workflows) then 'common' end as mark from counts)
where mark is not null""",
    "p1_counts": _TERMS + "select field_name, term, occurrences, records from counts",
    "p2_output_fields": """
select record_id, (i - 1)::bigint as place, output_fields[i].name as name, output_fields[i].type as type, output_fields[i].size as size, output_fields[i].scale as scale
from (select record_id, output_fields, unnest(range(1, len(output_fields) + 1)) as i from tools)""",
    "p3_found": _ORPHANS + "select ref_table, ref_id, ref_field, reason, strftime(seen, '%Y-%m') as ref_month from judged where reason is not null",
    "p3_report": _ORPHANS
    + """select ref_table, ref_field, reason, strftime(seen, '%Y-%m') as ref_month, count(*)::bigint as n_references, count(distinct (workflow_id, k))::bigint as n_keys
from judged where reason is not null group by all""",
    "p4_found": """
with recursive latest as (
  select workflow_id, tool_id, arg_max(parent, ingested_at) as parent, arg_max(kids, ingested_at) as kids from (
    select workflow_id, tool_id, ingested_at, {'v': parent_container_id} as parent, {'v': child_tool_ids} as kids from containers) group by 1, 2),
listed as (
  select workflow_id, c as node, min(tool_id) as lister from (select workflow_id, tool_id, unnest(kids.v) as c from latest) where c is not null group by 1, 2),
nodes as (
  select workflow_id, tool_id as node from latest union select workflow_id, node from listed),
named as (
  select n.workflow_id, n.node, case when l.parent.v is not null then p.tool_id else k.lister end as parent
  from nodes n left join latest l on l.workflow_id = n.workflow_id and l.tool_id = n.node
  left join latest p on p.workflow_id = n.workflow_id and p.tool_id = l.parent.v
  left join listed k on k.workflow_id = n.workflow_id and k.node = n.node),
down as (
  select workflow_id, node, node as root, 0::bigint as depth, node::varchar as path from named where parent is null
  union all
  select n.workflow_id, n.node, d.root, d.depth + 1, d.path || '/' || n.node from named n join down d on n.workflow_id = d.workflow_id and n.parent = d.node),
loose as (
  select n.* from named n anti join down d on n.workflow_id = d.workflow_id and n.node = d.node),
walk as (
  select workflow_id, node as start, parent as here from loose
  union
  select w.workflow_id, w.start, l.parent from walk w join loose l on w.workflow_id = l.workflow_id and w.here = l.node),
looped as (select distinct workflow_id, start as node from walk where start = here),
below as (
  select workflow_id, a as node, count(*) - 1 as n from (select workflow_id, unnest(string_split(path, '/')) as a from down) group by 1, 2)
select d.workflow_id, d.node as node_id, d.root as root_id, d.depth as node_depth, d.path as node_path, 'tree' as node_state, b.n::bigint as n_descendants
from down d join below b on b.workflow_id = d.workflow_id and b.node = d.node::varchar
union all
select l.workflow_id, l.node, -1, -1, '', case when c.node is null then 'under_cycle' else 'cycle' end, -1
from loose l left join looped c on l.workflow_id = c.workflow_id and l.node = c.node""",
}
ORACLES["p4_quotients"] = ORACLES["p4_found"]
ORACLES["p5_files"] = """
select record_id, pos_x::double as at_x, case when old then pos_y::smallint else pos_y end::double as at_y, case when old then name end as name, case when not old then name end as label,
  case when new then null else workflow_id end as workflow_id, case when new then null else tool_id end as tool_id, case when not old and not new then container_id end as container_id, case when new then modified_at::date end as day
from (select *, coalesce(year(modified_at) < 2024, false) as old, coalesce(year(modified_at) > 2024, true) as new from tools)"""
ORACLES["p5_file_changes"] = """
select * from (values ('retyped', 'at_x', 'int', 'decimal(12,2)'), ('retyped', 'at_y', 'smallint', 'float'), ('renamed', 'name -> label', 'string', 'string'),
  ('retyped', 'ref', 'struct<workflow_id:bigint,tool_id:bigint>', 'struct<tool_id:bigint,workflow_id:bigint,container_id:bigint>'), ('retyped', 'at_x', 'decimal(12,2)', 'bigint'), ('retyped', 'at_y', 'float', 'int'),
  ('removed', 'ref', 'struct<tool_id:bigint,workflow_id:bigint,container_id:bigint>', null), ('added', 'day', null, 'date')) t(change_kind, field, old_type, new_type)"""
# a text that holds JSON is walked through in its place; keys are written without quotes; the object above is what is left of a
# path without its last key and the places behind it
ORACLES["p2_json"] = r"""
with recursive texts as (
  select record_id, '$' as lead, parsed as j from tools where json_valid(parsed)
  union all
  select record_id, lead || regexp_replace(substring(fullkey, 2), '\."([^"]*)"', '.\1', 'g'), json_extract_string(value, '$') from (
    select t.record_id, t.lead, e.fullkey, e.value from texts t, lateral (select fullkey, value from json_tree(t.j) where type = 'VARCHAR') e)
  where regexp_matches(json_extract_string(value, '$'), '^\s*[\[{"]') and json_valid(json_extract_string(value, '$'))),
objects as (
  select t.record_id, t.lead || regexp_replace(substring(e.fullkey, 2), '\."([^"]*)"', '.\1', 'g') as node_path
  from texts t, lateral (select fullkey from json_tree(t.j) where type = 'OBJECT') e)
select record_id, 'json' as origin, node_path,
  case when regexp_full_match(node_path, '\$(\[\d+\])*') then '' else regexp_replace(node_path, '(\.[^.\[\]]+)(\[\d+\])*$', '') end as parent_path
from objects"""
