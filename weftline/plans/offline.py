"""Fields of a source whose file is not there, from the document alone.

Declared fields come first. Else the fields that tools further down refer to, along the branch up to a join, where the
keys of the source's side are the last; else one placeholder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftline.functions import expression as X
from weftline.operators.prepare import spark_type
from weftline.plans.document import Tool, Workflow
from weftline.plans.graph import Graph

PLACEHOLDER = "Record_Data"
_STOPS = {"Join", "Join Multiple", "Append Fields", "Union", "Find Replace"}


def _expression_fields(text: str | None) -> list[str]:
    try:
        return X.fields(X.parse(text or ""))
    except X.ExpressionError:
        return []


def referenced(tool: Tool) -> tuple[list[str], set[str]]:
    """(fields a tool needs from its input, fields it makes)."""
    c, kind = tool.config, tool.definition.name
    if kind == "Select":
        chosen = [x for x in c.each("SelectField") if not x.get("field", "").startswith("*")]
        return [x["field"] for x in chosen if x.get("field")], {x["rename"] for x in chosen if x.get("rename")}
    if kind == "Formula":
        need: list[str] = []
        made: set[str] = set()
        for x in c.each("FormulaField"):
            need += [f for f in _expression_fields(x.get("expression")) if f not in made]
            made.add(x.get("field", ""))
        return need, made
    if kind == "Filter":
        return _expression_fields(c.raw("Expression")), set()
    if kind == "Summarize":
        acts = c.each("SummarizeField")
        return [x["field"] for x in acts if x.get("field")], {x.get("rename") or f"{x.get('action')}_{x.get('field')}" for x in acts}
    if kind == "Cross Tab":
        names = [x.get("field") for x in c.each("GroupFields/Field")] + [c.text("HeaderField"), c.text("DataField")]
        return [n for n in names if n], {"*"}
    named = [x.get("field") or x.get("name") for p in ("SortInfo/Field", "UniqueFields/Field", "KeyFields/Field", "DataFields/Field") for x in c.each(p)]
    single = c.text("Field", "InputFieldName") if kind in ("RegEx", "Text To Columns", "DateTime", "XML Parse", "JSON Parse") else None
    made = {c.text("OutputFieldName") or f"{single}_Out"} if kind == "DateTime" else {c.text("FieldName") or "RecordID"} if kind == "Record ID" else set()
    return [n for n in [*named, single] if n], made


def infer_fields(flow: Workflow, graph: Graph, source: int) -> list[tuple[str, str]]:
    """(name, Spark type) of a source's fields."""
    tool = flow.tools[source]
    if tool.fields:
        return list({f.name: (f.name, spark_type(f.type, f.size, f.scale)) for f in tool.fields}.values())
    found: dict[str, None] = {}
    queue: list[tuple[int, str, frozenset[str]]] = [(c.destination, c.destination_anchor, frozenset()) for c in graph.out[source]]
    seen = set()
    while queue:
        at, anchor, made = queue.pop(0)
        if (at, anchor) in seen:
            continue
        seen.add((at, anchor))
        step = flow.tools[at]
        if step.definition.name == "Join":
            left = anchor.lower() not in ("right", "r", "#2")
            for x in step.config.each("JoinInfo/Field"):
                key = x.get("left" if left else "right") or (x.get("field") if not x.get("left") else None)
                if key:
                    found.setdefault(key)
        if step.definition.name in _STOPS:
            continue
        need, makes = referenced(step)
        found.update(dict.fromkeys(n for n in need if n not in made))
        if "*" in makes or step.definition.name == "Summarize":
            continue
        queue += [(c.destination, c.destination_anchor, made | makes) for c in graph.out[at]]
    return [(n, "string") for n in found] or [(PLACEHOLDER, "string")]


def empty_source(spark: SparkSession, flow: Workflow, graph: Graph, source: int) -> DataFrame:
    fields = infer_fields(flow, graph, source)
    return spark.createDataFrame([], T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in fields]))
