"""Workflows to lazy frames: one for every output anchor of every tool.

Tools are built in topological order; nothing runs until a frame is asked for or ``Compiled.write`` is called. A
tool that cannot be built is reported and blocks what lies behind it, never the other branches. Every stream
carries the order of its rows as far as it is known, for the tools that depend on it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from weftline.functions import columns as C
from weftline.functions import expression as X
from weftline.operators import joins, ordered, parse, polygons, prepare, spatial, transform
from weftline.operators.ordered import Order
from weftline.operators.prepare import Choice
from weftline.operators.transform import Action
from weftline.plans import lineage as L
from weftline.plans import registry
from weftline.plans.document import Config, Tool, Workflow
from weftline.plans.graph import Graph
from weftline.plans.offline import empty_source
from weftline.sources import files


@dataclass
class Stream:
    df: DataFrame
    order: Order = ()
    origins: L.Origins = field(default_factory=dict)


@dataclass(frozen=True)
class Diagnostic:
    level: str
    category: str
    tool_id: int
    message: str


@dataclass
class Pending:
    """A write that waits to be run."""

    tool_id: int
    df: DataFrame
    at: files.Location
    limit: int | None


_SOURCES = {"Input Data", "Connect In-DB", "Directory", "Dynamic Input"}
# Spellings of anchors.
_SPELLINGS = {"t": "true", "f": "false", "j": "join", "l": "left", "r": "right", "u": "unique", "d": "duplicates", "": "output"}
_LEFT = {"left", "find", "targets", "f", "#1", "target"}
_RIGHT = {"right", "replace", "source", "r", "s", "#2", "expressions", "universe"}
_ERRORS = {"expression_error", "unsupported_function", "external_execution", "unsupported_tool", "partial_support", "build_error"}


@dataclass
class Task:
    """What a builder works with."""

    spark: SparkSession
    tool: Tool
    inputs: list[Stream]
    base: str
    say: list[tuple[str, str]]
    pending: list[Pending]
    dependencies: list[tuple[int, str, str, bool]]
    consumed: set[str]

    @property
    def config(self) -> Config:
        return self.tool.config

    @property
    def one(self) -> Stream:
        return self.inputs[0]


@dataclass
class Compiled:
    flow: Workflow
    streams: dict[tuple[int, str], Stream]
    diagnostics: list[Diagnostic]
    blocked: set[int]
    pending: list[Pending]
    dependencies: list[tuple[int, str, str, bool]]
    spark: SparkSession

    def frame(self, tool_id: int, anchor: str = "Output") -> DataFrame:
        return resolve(self.streams, tool_id, anchor).df

    def write(self, base: str = "") -> None:
        for p in self.pending:
            files.write(p.df, p.at, limit=p.limit, base=base)

    def diagnostics_frame(self) -> DataFrame:
        rows = [(d.level, d.category, d.tool_id, d.message) for d in self.diagnostics]
        return self.spark.createDataFrame(rows, "level string, category string, tool_id int, message string")

    def dependencies_frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.dependencies, "tool_id int, path string, format string, resolved boolean")

    def lineage_frame(self) -> DataFrame:
        """Where the fields of every sink come from, and how."""
        graph = Graph(self.flow)
        rows = []
        for sink in graph.sinks():
            for c in graph.into[sink]:
                try:
                    stream = resolve(self.streams, c.origin, c.origin_anchor)
                except KeyError:
                    continue
                target = self.flow.tools[sink].name or f"tool_{sink}"
                rows += [(o.table, o.field, target, name, o.kind) for name, origins in stream.origins.items() for o in origins]
        return self.spark.createDataFrame(sorted(set(rows), key=lambda r: (r[2], r[3], r[0], r[1])), "source_table string, source_field string, target_table string, target_field string, kind string")

    def describe(self, tool_id: int, anchor: str = "Output") -> str:
        """Spark's plan of an anchor."""
        return self.frame(tool_id, anchor)._jdf.queryExecution().toString()

    def register_views(self, prefix: str = "tool") -> list[str]:
        """Every anchor as a temporary view for SQL: ``tool_5_true`` and so on."""
        made = []
        for (tool_id, anchor), s in self.streams.items():
            made.append(f"{prefix}_{tool_id}_{anchor.lower()}")
            s.df.createOrReplaceTempView(made[-1])
        return made

    def tools_frame(self) -> DataFrame:
        rows = [(t.tool_id, t.definition.name, t.definition.category, t.definition.support, t.definition.blocking, t.tool_id in self.blocked) for t in self.flow.tools.values()]
        return self.spark.createDataFrame(rows, "tool_id int, tool string, category string, support string, is_blocking boolean, is_blocked boolean")


def resolve(streams: Mapping[tuple[int, str], Stream], tool_id: int, anchor: str) -> Stream:
    """Exact anchor, its other spelling, or the tool's one output. Case doesn't count."""
    own = {a.lower(): s for (t, a), s in streams.items() if t == tool_id}
    a = anchor.lower()
    for key in (a, _SPELLINGS.get(a, a), "output"):
        if key in own:
            return own[key]
    if len(own) == 1:
        return next(iter(own.values()))
    raise KeyError((tool_id, anchor))


def _inputs(graph: Graph, tool_id: int, streams: Mapping[tuple[int, str], Stream]) -> list[Stream]:
    """By destination anchor: left ones, others in the order of the document, right ones."""
    side = lambda c: 0 if c.destination_anchor.lower() in _LEFT else 2 if c.destination_anchor.lower() in _RIGHT else 1
    return [resolve(streams, c.origin, c.origin_anchor) for c in sorted(graph.into[tool_id], key=side)]


def compile_workflow(
    flow: Workflow, spark: SparkSession, *, base: str = "", inputs: Mapping[int, DataFrame] | None = None, persist: bool = False, offline: bool = False,
    hooks: Mapping[int, Callable[[list[DataFrame]], Mapping[str, DataFrame]]] | None = None,
) -> Compiled:
    """``inputs`` replaces the frames of sources by tool id. ``persist`` keeps streams that several tools read. ``offline``
    gives sources that can't be read an empty frame of the fields the document tells of them. ``hooks`` stand in for tools
    that run foreign code: functions from input frames to frames by anchor; embedded code itself is never run."""
    graph = Graph(flow)
    out = Compiled(flow, {}, [], set(), [], [], spark)
    for tool_id in graph.order():
        tool = flow.tools[tool_id]
        say: list[tuple[str, str]] = []
        if any(c.origin in out.blocked for c in graph.into[tool_id]):
            out.blocked.add(tool_id)
            continue
        try:
            if hooks and tool_id in hooks:
                given = _inputs(graph, tool_id, out.streams)
                made = {a: Stream(df, (), L.carried(df.columns, [i.origins for i in given])) for a, df in hooks[tool_id]([i.df for i in given]).items()}
            else:
                made = _build(tool, graph, out, spark, base, dict(inputs or {}), say)
        except (KeyError, ValueError, files.MissingDependency, X.ExpressionError, NotImplementedError) as e:
            say.append((e.args[0] if isinstance(e, NotImplementedError) else "build_error", str(e.args[-1] if e.args else e)))
            made = None
            if offline and not graph.into[tool_id] and tool.definition.outputs and tool.definition.name in _SOURCES:
                df = empty_source(spark, flow, graph, tool_id)
                made = {"Output": Stream(df, (), L.direct(df.columns, tool.name or f"tool_{tool_id}"))}
                say[:] = [x for x in say if x[0] != "build_error"]
        except Exception as e:  # what Spark refuses to analyse
            say.append(("build_error", str(e).splitlines()[0]))
            made = None
        out.diagnostics += [Diagnostic("ERROR" if c in _ERRORS else "INFO" if c in ("external_dependency", "message") else "WARNING", c, tool_id, m) for c, m in say]
        if made is None:
            out.blocked.add(tool_id)
            continue
        readers = len(graph.out[tool_id])
        for anchor, stream in made.items():
            if persist and readers > 1 and tool.definition.blocking:
                stream = Stream(stream.df.persist(StorageLevel.MEMORY_AND_DISK), stream.order, stream.origins)
            out.streams[tool_id, anchor] = stream
    return out


def _build(tool: Tool, graph: Graph, out: Compiled, spark: SparkSession, base: str, given: dict[int, DataFrame], say: list) -> dict[str, Stream]:
    if tool.tool_id in given:
        df = given[tool.tool_id]
        return {"Output": Stream(df, (), L.direct(df.columns, tool.name or f"tool_{tool.tool_id}"))}
    d = tool.definition
    if d is registry.UNKNOWN:
        raise NotImplementedError("unsupported_tool", f"{registry.type_of(tool.plugin)} is not known")
    build = BUILDERS.get(d.name)
    if build is None:
        if d.support == registry.DOCUMENTATION:
            return {"Output": s for s in _inputs(graph, tool.tool_id, out.streams)[:1]}
        raise NotImplementedError("partial_support" if d.support == registry.PARTIAL else "external_execution", f"{d.name} is not executed")
    inputs = _inputs(graph, tool.tool_id, out.streams)
    if d.inputs and not inputs and d.name != "Generate Rows":
        raise ValueError("the tool has no input")
    task = Task(spark, tool, inputs, base, say, out.pending, out.dependencies, {_SPELLINGS.get(a.lower(), a.lower()) for a in graph.consumed(tool.tool_id)})
    made = build(task)
    result = {}
    for anchor, s in made.items():
        s = s if isinstance(s, Stream) else Stream(s)
        if not s.origins:
            s.origins = L.carried(s.df.columns, [i.origins for i in inputs])
        result[anchor] = s
    return result


# --- builders ---------------------------------------------------------------------------------------

BUILDERS: dict[str, Callable[[Task], dict]] = {}


def builds(*names: str) -> Callable:
    def add(f: Callable[[Task], dict]) -> Callable:
        for n in names:
            BUILDERS[n] = f
        return f

    return add


def _order(config: Config) -> list[tuple[str, bool]]:
    found = [(x.get("field", ""), not x.get("order", "").strip().lower().startswith("desc")) for x in config.each("SortInfo/Field")]
    if not found:
        text = config.text("SortInfo", "SortFields") or ""
        for item in filter(None, (i.strip() for i in text.split(";"))):
            name, _, how = item.rpartition(" ")
            found.append((name, how.lower() != "descending") if name and how.lower() in ("ascending", "descending") else (item, True))
    return [(f, up) for f, up in found if f]


def _groups(config: Config) -> list[str]:
    return [x.get("field") or x.get("name") for x in config.each("GroupFields/Field") + config.each("GroupByFields/Field")] or [g.strip() for g in (config.text("GroupField") or "").split(";") if g.strip()]


def _known(s: Stream, names: list[str], t: Task) -> list[str]:
    for n in names:
        if n not in s.df.columns:
            t.say.append(("unresolved_field", f"there is no field {n}"))
    return [n for n in names if n in s.df.columns]


@builds("Connect In-DB")
def _database(t: Task) -> dict:
    """A table of the session's catalogue, or of a database by JDBC where an address is given; filters on it are pushed down."""
    name, url = t.config.text("Table", "Query"), t.config.text("Url", "Connection")
    if not name:
        raise ValueError("the tool names no table")
    df = files.jdbc(t.spark, url, name) if url and url.startswith("jdbc:") else t.spark.table(name)
    return {"Output": Stream(df, (), L.direct(df.columns, name))}


@builds("Input Data")
def _input(t: Task) -> dict:
    path = t.config.text("File", "Table")
    if not path:
        raise ValueError("the tool names no file")
    entry = next(iter(t.config.each("File")), {})
    at = files.locate(path, entry.get("FileFormat"))
    limit = entry.get("RecordLimit", "")
    delimiter = (t.config.text("Delimeter", "FieldDelimiter") or ",").replace("\\t", "\t")
    try:
        df = files.read(t.spark, at, limit=int(limit) if limit.isdigit() else None, delimiter=delimiter, header=t.config.flag("HeaderRow", True), base=t.base)
    except files.MissingDependency:
        raise
    except Exception as e:
        t.dependencies.append((t.tool.tool_id, at.path, at.format, False))
        t.say.append(("external_dependency", f"{at.path} cannot be read"))
        raise ValueError(str(e).splitlines()[0]) from e
    t.dependencies.append((t.tool.tool_id, at.path, at.format, True))
    if at.format == "yxdb":
        t.say.append(("format_assumption", "yxdb is read from the file next to it"))
    return {"Output": Stream(df, (), L.direct(df.columns, t.tool.name or at.path))}


@builds("Text Input")
def _text_input(t: Task) -> dict:
    rows = [[c.text or "" for c in r.findall("c")] for r in t.config.element.findall(".//Data/r")]
    df = files.text_input(t.spark, [x.get("name", "") for x in t.config.each("Fields/Field")], rows)
    return {"Output": Stream(df, (), L.direct(df.columns, t.tool.name or f"tool_{t.tool.tool_id}"))}


@builds("Date Time Now")
def _now(t: Task) -> dict:
    return {"Output": files.date_time_now(t.spark)}


@builds("Directory")
def _directory(t: Task) -> dict:
    return {"Output": files.directory(t.spark, t.config.text("Directory", "Path"), t.config.text("FileSpec", default="*"), t.config.flag("IncludeSubDirs"))}


@builds("Dynamic Input")
def _dynamic_input(t: Task) -> dict:
    name = t.config.text("Field", "InputField")
    return {"Output": files.dynamic_input(t.one.df, name, files.locate(t.config.text("File", default="x.csv")).format)}


@builds("Output Data")
def _output(t: Task) -> dict:
    entry = next(iter(t.config.each("File")), {})
    at = files.locate(t.config.text("File") or "output.csv", entry.get("FileFormat"))
    limit = entry.get("MaxRecords", "")
    df = ordered.sort(t.one.df, t.one.order) if t.one.order else t.one.df
    t.pending.append(Pending(t.tool.tool_id, df, at, int(limit) if limit.isdigit() and int(limit) else None))
    return {}


@builds("Detour End")
def _detour_end(t: Task) -> dict:
    """Whichever way the rows came: both ways united by name, the one not taken being empty."""
    if len(t.inputs) < 2:
        return {"Output": t.one}
    return {"Output": Stream(joins.union([s.df for s in t.inputs], by_name=True), t.one.order, L.carried(t.one.df.columns, [s.origins for s in t.inputs]))}


@builds("Browse", "Message", "Data Stream Out", "Data Stream In")
def _pass(t: Task) -> dict:
    if t.tool.definition.name == "Message":
        t.say.append(("message", t.config.text("Message", "Text") or ""))
    return {"Output": t.one}


@builds("Block Until Done")
def _block(t: Task) -> dict:
    return dict.fromkeys(("Output", "Output1", "Output2", "Output3"), t.one)


@builds("Detour")
def _detour(t: Task) -> dict:
    right = t.config.flag("DetourRight") or (t.config.text("Direction") or "").lower() == "right"
    nothing = Stream(t.one.df.where(F.lit(False)), t.one.order, t.one.origins)
    return {"Left": nothing if right else t.one, "Right": t.one if right else nothing}


@builds("Select", "Select In-DB")
def _select(t: Task) -> dict:
    whole = lambda v: int(v) if v and v.isdigit() else None
    chosen = [Choice(x.get("field", ""), x.get("selected", "True") == "True", x.get("rename") or None, x.get("type") or None, whole(x.get("size")), whole(x.get("scale"))) for x in t.config.each("SelectField")]
    if not chosen:
        for item in filter(None, (i.strip() for i in (t.config.text("SelectFields") or "").split(";"))):
            a, _, b = item.partition(":")
            chosen.append(Choice(a.strip(), rename=b.strip() or None))
    unknown = any(c.field == "*Unknown" and c.selected for c in chosen) and t.config.flag("KeepUnknown")
    df = prepare.select(t.one.df, chosen, unknown=unknown, diagnostics=t.say)
    kept = {c.rename or c.field: c.field for c in chosen if c.selected and not c.field.startswith("*")}
    order = [(new, up) for f, up in t.one.order for new, old in kept.items() if old == f]
    return {"Output": Stream(df, order if len(order) == len(t.one.order) else (), L.renamed(df.columns, kept, t.one.origins))}


@builds("Filter", "Filter In-DB")
def _filter(t: Task) -> dict:
    text = t.config.raw("Expression")
    if not text and (field_name := t.config.text("Field")):
        operand = next((e.text for e in t.config.element.iter("Operand") if e.text), "")
        text = f"[{field_name}] {t.config.text('Operator', default='=')} '{operand}'"
    made = prepare.filter_rows(t.one.df, text, t.one.order, t.say)
    return {k: Stream(v, t.one.order, t.one.origins) for k, v in made.items()}


@builds("Formula", "Formula In-DB")
def _formula(t: Task) -> dict:
    found = [(x.get("field", ""), x.get("expression") or x.get("formula") or "", x.get("type")) for x in t.config.each("FormulaField")]
    if not found:
        for chunk in re.split(r";(?=[\w\s]+=)", (t.config.text("FormulaFields") or "").strip()):
            name, eq, text = chunk.partition("=")
            if eq:
                found.append((name.strip(), text.strip(), None))
    # declared types are not enforced, as results have the types of their expressions
    df = prepare.formula(t.one.df, [(f, e) for f, e, _ in found], t.one.order, t.say)
    origins = dict(t.one.origins)
    for f, e, _ in found:
        try:
            refs = X.fields(X.parse(e))
        except X.ExpressionError:
            refs = []
        origins[f] = L.derived(refs, origins, f)
    order = [] if {f for f, _, _ in found} & {c for c, _ in t.one.order} else t.one.order
    return {"Output": Stream(df, order, origins)}


@builds("Multi-Field Formula")
def _multi_field(t: Task) -> dict:
    names = [x.get("name") or x.get("field") for x in t.config.each("Fields/Field") if x.get("selected", "True") == "True"]
    text = t.config.raw("Expression")
    return {"Output": prepare.multi_field_formula(t.one.df, _known(t.one, names, t), text, prefix=t.config.text("NewFieldAddOn", default="")) if text and names else t.one}


@builds("Multi-Row Formula")
def _multi_row(t: Task) -> dict:
    text, name = t.config.raw("Expression"), t.config.text("UpdateField_Name", "CreateField_Name", "Field")
    if text and name:
        return {"Output": ordered.multi_row_formula(t.one.df, name, text, _known(t.one, _groups(t.config), t), t.one.order)}
    first = t.one.df.columns[0]
    return {"Output": ordered.multi_row_formula(t.one.df, "Lag_Value", f"[Row-1:{first}]", (), t.one.order)}


def _constant(node: X.Node) -> float | None:
    if isinstance(node, X.Unary) and node.op == "-":
        value = _constant(node.operand)
        return None if value is None else -value
    return node.value if isinstance(node, X.Literal) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool) else None


def _loop(name: str, condition: str | None, loop: str | None) -> tuple[X.Node, float, bool]:
    """(end, step, whether the end is left out) of a loop that counts a field up or down; ValueError for all others."""
    own = X.Field(name)
    step: float | None = 1
    if loop:
        match X.parse(loop):
            case X.Binary("+", left, right) if own in (left, right):
                step = _constant(right if left == own else left)
            case X.Binary("-", left, right) if left == own:
                step = _constant(X.Unary("-", right))
            case _:
                step = None
    if not step:
        raise ValueError(f"the loop {loop} cannot be read: a constant step is expected")
    if not condition:
        return X.Literal(10), step, False
    match X.parse(condition):
        case X.Binary(("<" | "<=" | ">" | ">=") as op, left, right) if (left == own) != (right == own):
            end = right if left == own else left
            up = (op[0] == "<") == (left == own)
        case _:
            raise ValueError(f"the condition {condition} cannot be read: [{name}] compared with its end is expected")
    if own in list(X.walk(end)):
        raise ValueError(f"the condition {condition} cannot be read: its end depends on [{name}]")
    if up != (step > 0):
        raise ValueError(f"the loop {loop or '+ 1'} never ends the condition {condition}")
    return end, step, len(op) == 1


@builds("Generate Rows")
def _generate(t: Task) -> dict:
    """The rows of the loop for every row of the input, or once without one; without configuration 1 to 10."""
    name = t.config.text("CreateField_Name", "UpdateField_Name", "FieldName", default="RowCount")
    start = X.parse(t.config.text("Expression_Init", "StartValue", default="1"))
    end, step, strict = _loop(name, t.config.text("Expression_Cond"), t.config.text("Expression_Loop"))
    known = t.one.df.columns if t.inputs else []
    if missing := [f for x in (start, end) for f in X.fields(x) if f not in known]:
        raise ValueError(f"there is no field {missing[0]}")
    if t.inputs:
        return {"Output": Stream(prepare.generate_rows_of(t.one.df, name, start, end, step, strict=strict), (), t.one.origins | {name: L.derived(X.fields(start) + X.fields(end), t.one.origins, name)})}
    a, b = _constant(start), _constant(end)
    if all(isinstance(x, int) for x in (a, b, step)):
        return {"Output": prepare.generate_rows(t.spark, name, a, b - strict * (1 if step > 0 else -1), step)}
    return {"Output": prepare.generate_rows_of(t.spark.range(1), name, start, end, step, strict=strict).select(C.name(name))}


@builds("Data Cleansing", "Data Cleanse Pro")
def _cleanse(t: Task) -> dict:
    names = _known(t.one, [x.get("field") or x.get("name") for x in t.config.each("Fields/Field")], t)
    case = (t.config.text("ModifyCase") or "").lower()
    df = prepare.cleanse(t.one.df, names, trim=t.config.flag("TrimWhitespace", True), remove_whitespace=t.config.flag("RemoveWhitespace"), case=case if case in ("upper", "lower", "title") else None, remove_null=t.config.flag("RemoveNull"), replace_null=t.config.flag("ReplaceNulls"))
    return {"Output": Stream(df, t.one.order, t.one.origins)}


@builds("Auto Field")
def _auto(t: Task) -> dict:
    return {"Output": Stream(prepare.auto_field(t.one.df), t.one.order, t.one.origins)}


@builds("Dynamic Select")
def _dynamic_select(t: Task) -> dict:
    return {"Output": prepare.dynamic_select(t.one.df, pattern=t.config.text("Pattern"))}


@builds("Dynamic Rename")
def _dynamic_rename(t: Task) -> dict:
    df = prepare.dynamic_rename(t.one.df, prefix=t.config.text("Prefix", default=""), suffix=t.config.text("Suffix", default=""))
    return {"Output": Stream(df, (), {new: t.one.origins.get(old, ()) for old, new in zip(t.one.df.columns, df.columns, strict=True)})}


@builds("Dynamic Replace")
def _dynamic_replace(t: Task) -> dict:
    """Rules (field, condition, value), first match first; a rule that can't be read goes to Errors. The rules are read in
    blocks; one of a later block applies where none before did, its condition too is about the row as it came."""
    rules = t.inputs[1].df.select([C.name(c).cast("string") for c in t.inputs[1].df.columns[:3]])
    ctx, df, bad, fields = C.context(t.one.df.schema), t.one.df, [], []
    made: dict[str, list[tuple[Column, Column]]] = {}

    def applied() -> DataFrame:
        new = {}
        for name, found in made.items():
            i = fields.index(name) if name in fields else len(fields)
            before, done = (F.col(f"__new{i}"), F.col(f"__done{i}")) if name in fields else (C.name(name), F.lit(False))
            if name not in fields:
                fields.append(name)
            value = F.when(done, before)
            for test, v in found:
                value = value.when(test, v)
            new |= {f"__new{i}": value.otherwise(before), f"__done{i}": reduce(Column.__or__, [test for test, _ in found], done)}
        made.clear()
        return df.withColumns(new)

    for k, (name, condition, value) in enumerate(rules.toLocalIterator(), 1):
        try:
            pair = C.truth(C.compile_text(condition, ctx)), F.lit(value).try_cast(t.one.df.schema[name].dataType)
            made.setdefault(name, []).append(pair)
        except (X.ExpressionError, KeyError, TypeError) as e:
            bad.append((name, condition, str(e)))
        if k % 200 == 0:
            df = applied()
    df = applied() if made else df
    df = df.select(*[F.col(f"__new{fields.index(c)}").alias(c) if c in fields else C.name(c) for c in t.one.df.columns])
    return {"Output": df, "Errors": t.spark.createDataFrame(bad, "field string, condition string, error string")}


@builds("Field Info")
def _field_info(t: Task) -> dict:
    return {"Output": prepare.field_info(t.one.df)}


@builds("Select Records")
def _select_records(t: Task) -> dict:
    return {"Output": Stream(ordered.select_records(t.one.df, t.config.text("Ranges", "RecordRanges", default="1-100"), t.one.order), t.one.order, t.one.origins)}


@builds("Record ID")
def _record_id(t: Task) -> dict:
    name = t.config.text("FieldName", default="RecordID")
    df = ordered.record_id(t.one.df, name, int(t.config.number("StartValue", default=1)), t.one.order)
    return {"Output": Stream(df, [(name, True)], t.one.origins | {name: ()})}


@builds("Sample")
def _sample(t: Task) -> dict:
    mode = (t.config.text("Mode") or "first").lower()
    n, pct = int(t.config.number("N", default=100)), t.config.number("Pct")
    kind = "last" if "last" in mode else "skip" if "skip" in mode else "one_in" if "1" in mode or "every" in mode else ("random_pct" if pct else "random_n") if "random" in mode or "percent" in mode else "first"
    return {"Output": Stream(ordered.sample(t.one.df, kind, n, pct, _known(t.one, _groups(t.config), t), t.one.order), t.one.order, t.one.origins)}


@builds("Random % Sample")
def _random(t: Task) -> dict:
    return {"Output": Stream(ordered.random_percent(t.one.df, t.config.number("Pct", "Percent", default=10)), t.one.order, t.one.origins)}


@builds("Create Samples")
def _samples(t: Task) -> dict:
    made = ordered.create_samples(t.one.df, t.config.number("Estimation", default=60), t.config.number("Validation", default=20))
    return made | {"Output": made["Estimation"]}


@builds("Sort")
def _sort(t: Task) -> dict:
    order = [(f, up) for f, up in _order(t.config) if f in _known(t.one, [f], t)]
    # the order is kept with the stream too, for tools behind it; a sink that sorts again replaces this sort in the plan
    return {"Output": Stream(ordered.sort(t.one.df, order), order or t.one.order, t.one.origins)}


@builds("Unique")
def _unique(t: Task) -> dict:
    names = [x.get("field") or x.get("name") for x in t.config.each("UniqueFields/Field")]
    return {k: Stream(v, t.one.order, t.one.origins) for k, v in ordered.unique(t.one.df, _known(t.one, names, t), t.one.order).items()}


@builds("Rank")
def _rank(t: Task) -> dict:
    return {"Output": ordered.rank(t.one.df, t.config.text("Field", default=t.one.df.columns[0]), _known(t.one, _groups(t.config), t))}


@builds("Tile")
def _tile(t: Task) -> dict:
    return {"Output": ordered.tile(t.one.df, t.config.text("Field", default=t.one.df.columns[0]), int(t.config.number("NumTiles", "Tiles", default=4)), _known(t.one, _groups(t.config), t))}


@builds("Multi-Field Binning")
def _binning(t: Task) -> dict:
    names = [x.get("field") or x.get("name") for x in t.config.each("Fields/Field")] or [f.name for f in t.one.df.schema if C.kind_of(f.dataType) == C.NUM]
    return {"Output": prepare.binning(t.one.df, _known(t.one, names, t), int(t.config.number("Bins", "NumTiles", default=4)))}


@builds("Join", "Join In-DB")
def _join(t: Task) -> dict:
    left, right = t.inputs[0], t.inputs[1]
    if t.config.flag("JoinByRecordPos"):
        made = joins.join_by_position(left.df, right.df, left.order, right.order)
        return {k: Stream(v, (), L.carried(v.columns, [left.origins, right.origins])) for k, v in made.items()}
    sides = {side: [x.get("field") for x in t.config.each(f"JoinInfo[@connection='{side}']/Field") if x.get("field")] for side in ("Left", "Right")}
    keys = list(zip(sides["Left"], sides["Right"], strict=False)) or [(x["left"], x["right"]) for x in t.config.each("JoinInfo/Field") if x.get("left") and x.get("right")]
    if not keys and (a := t.config.text("LeftField")) and (b := t.config.text("RightField")):
        keys = [(a, b)]
    good = [(a, b) for a, b in keys if _known(left, [a], t) and _known(right, [b], t)]
    made = joins.join(left.df, right.df, good)
    return {
        "Join": Stream(made["Join"], (), L.joined(made["Join"].columns, left.origins, right.origins)),
        "Left": Stream(made["Left"], left.order, left.origins),
        "Right": Stream(made["Right"], right.order, right.origins),
    }


@builds("Join Multiple")
def _join_multiple(t: Task) -> dict:
    return {"Output": joins.join_multiple([s.df for s in t.inputs], [x.get("field") for x in t.config.each("JoinFields/Field")] or None, t.config.flag("JoinByRecordPos"))}


@builds("Append Fields")
def _append(t: Task) -> dict:
    df = joins.append_fields(t.inputs[0].df, t.inputs[1].df)
    return {"Output": Stream(df, (), L.joined(df.columns, t.inputs[0].origins, t.inputs[1].origins))}


@builds("Find Replace")
def _find_replace(t: Task) -> dict:
    name, find, replace = t.config.text("FieldFind"), t.config.text("FieldSearch"), t.config.text("ReplaceFoundField")
    if not (name and find and replace):
        t.say.append(("missing_configuration", "the fields to find and replace are not set"))
        return {"Output": t.one}
    return {"Output": joins.find_replace(t.inputs[0].df, t.inputs[1].df, name, find, replace, mode="exact" if (t.config.text("FindMode") or "").lower() in ("", "findwhole", "exact") else "part")}


@builds("Fuzzy Match")
def _fuzzy(t: Task) -> dict:
    key, name, threshold = t.config.text("KeyField", "RecordID"), t.config.text("MatchField", "Field"), t.config.number("Threshold", default=80) / 100
    return {"Output": joins.fuzzy_pairs(t.one.df, key, name, threshold=threshold), "Members": joins.fuzzy_members(t.one.df, key, name, threshold=threshold)}


@builds("Make Group")
def _make_group(t: Task) -> dict:
    return {"Output": joins.make_group(t.one.df, t.config.text("Key1", "Field1", default=t.one.df.columns[0]), t.config.text("Key2", "Field2", default=t.one.df.columns[1]))}


@builds("Union")
def _union(t: Task) -> dict:
    how = (t.config.text("ByName_or_ByPos", "ByNameOrPos", "ByName_or_Pos", "Mode") or "ByName").lower()
    return {"Output": joins.union([s.df for s in t.inputs], "pos" not in how, t.say)}


@builds("DateTime")
def _date_time(t: Task) -> dict:
    name = t.config.text("InputFieldName")
    out, to_text = t.config.text("OutputFieldName"), t.config.flag("IsInputDate") or t.config.flag("IsFrom")
    fmt = t.config.text("OutputFormat" if to_text else "InputFormat", default="%Y-%m-%d")
    if not name or not _known(t.one, [name], t):
        return {"Output": t.one}
    df = parse.date_time(t.one.df, name, out, fmt, to_text=to_text)
    return {"Output": Stream(df, t.one.order, t.one.origins | {out or f"{name}_Out": L.derived([name], t.one.origins, name)})}


@builds("RegEx")
def _regex(t: Task) -> dict:
    name, pattern = t.config.text("Field"), t.config.raw("RegExExpression") or (next(iter(t.config.each("RegExExpression")), {}) or {}).get("value")
    if not name or not pattern or not _known(t.one, [name], t):
        return {"Output": t.one}
    method = (t.config.text("Method") or "parse").lower()
    method = next((m for m in ("match", "replace", "tokenize") if m in method), "parse")
    return {"Output": parse.regex(t.one.df, name, pattern, method, ignore_case=t.config.flag("CaseInsensitve"), replacement=t.config.text("ReplaceString", default=""))}


@builds("Text To Columns")
def _columns(t: Task) -> dict:
    name = t.config.text("Field")
    if not name or not _known(t.one, [name], t):
        return {"Output": t.one}
    width = t.config.number("NumFields")
    delimiter = t.config.raw("Delimeters") or (next(iter(t.config.each("Delimeters")), {}) or {}).get("value") or ","
    return {"Output": parse.text_to_columns(t.one.df, name, delimiter, int(width) if width else None, to_rows=width == 0)}


@builds("JSON Parse")
def _json_parse(t: Task) -> dict:
    name = t.config.text("JSONField", "Field")
    return {"Output": parse.json_parse(t.one.df, name) if name and _known(t.one, [name], t) else t.one}


@builds("JSON Build")
def _json_build(t: Task) -> dict:
    return {"Output": parse.json_build(t.one.df, group=_known(t.one, _groups(t.config), t), order=t.one.order)}


@builds("XML Parse")
def _xml_parse(t: Task) -> dict:
    name = t.config.text("Field", "XmlField")
    paths = {x.get("name") or x.get("path"): x.get("path") for x in t.config.each("Paths/Path") if x.get("path")}
    return {"Output": parse.xml_parse(t.one.df, name, paths, rows=t.config.text("RowPath"))}


@builds("Summarize")
def _summarize(t: Task) -> dict:
    acts = [Action(x.get("field", ""), x.get("action") or x.get("operation") or "GroupBy", x.get("rename") or None) for x in t.config.each("SummarizeField")]
    if not acts:
        for item in filter(None, (i.strip() for i in (t.config.text("SummarizeFields") or "").split(";"))):
            f, a, r = (*item.split(":"), "", "")[:3]
            acts.append(Action(f.strip(), a.strip() or "GroupBy", r.strip() or None))
    df = transform.summarize(t.one.df, acts, t.one.order, diagnostics=t.say)
    return {"Output": Stream(df, (), L.summarized(df.columns, {a.out: (a.field, a.action.lower() == "groupby") for a in acts}, t.one.origins))}


@builds("Count Records")
def _count(t: Task) -> dict:
    return {"Output": transform.count_records(t.one.df)}


@builds("Running Total")
def _running(t: Task) -> dict:
    names = [x.get("field") or x.get("name") for x in t.config.each("RunningTotalFields/Field")] or [t.config.text("Field", default=t.one.df.columns[0])]
    df = t.one.df
    for i, n in enumerate(_known(t.one, names, t)):
        df = ordered.running_total(df, n, _known(t.one, _groups(t.config), t), t.one.order, "RunningTotal" if not i else f"RunningTotal_{n}")
    return {"Output": Stream(df, t.one.order)}


@builds("Cross Tab")
def _cross_tab(t: Task) -> dict:
    method = next((x.get("method") for x in t.config.each("Method") + t.config.each("Methods/Method") if x.get("method")), None) or t.config.text("Method") or "Sum"
    header, data = t.config.text("HeaderField"), t.config.text("DataField")
    group = _known(t.one, _groups(t.config), t)
    # what an earlier run saw: an order of fields, not the list of values
    declared = [f.name for f in t.tool.fields if f.name not in (group or ["index"])]
    df = transform.cross_tab(t.one.df, group, header, data, method, diagnostics=t.say, declared=declared, order=t.one.order)
    return {"Output": Stream(df, (), L.pivoted(df.columns, group, [data, header], t.one.origins))}


@builds("Transpose")
def _transpose(t: Task) -> dict:
    keys = _known(t.one, [x.get("field") or x.get("name") for x in t.config.each("KeyFields/Field")], t)
    data = _known(t.one, [x.get("field") or x.get("name") for x in t.config.each("DataFields/Field") if x.get("selected", "True") == "True"], t)
    df = transform.transpose(t.one.df, keys, data, t.say)
    return {"Output": Stream(df, (), L.pivoted(df.columns, keys, data or [c for c in t.one.df.columns if c not in keys], t.one.origins))}


@builds("Arrange")
def _arrange(t: Task) -> dict:
    keys = [x.get("field") for x in t.config.each("KeyFields/Field")]
    outputs = {o.get("name"): [f.get("field") for f in o.findall("Field")] for o in t.config.element.findall(".//OutputFields/Output")}
    return {"Output": prepare.arrange(t.one.df, _known(t.one, keys, t), outputs, t.config.text("DescriptionField")) if outputs else t.one}


@builds("Make Columns")
def _make_columns(t: Task) -> dict:
    width = t.config.number("NumColumns", "Columns")
    return {"Output": prepare.make_columns(t.one.df, int(width), t.one.order, _known(t.one, _groups(t.config), t)) if width else t.one}


@builds("Create Points")
def _points(t: Task) -> dict:
    return {"Output": spatial.create_points(t.one.df, t.config.text("FieldX", "XField"), t.config.text("FieldY", "YField"))}


@builds("Distance")
def _distance(t: Task) -> dict:
    return {"Output": spatial.distance(t.one.df, t.config.text("SourceField", "Source"), t.config.text("DestinationField", "Destination"))}


@builds("Heat Map")
def _heat_map(t: Task) -> dict:
    return {"Output": spatial.heat_map(t.one.df, t.config.text("SpatialField", "Field"), t.config.number("GridSize", default=1.0))}


@builds("Make Grid")
def _grid(t: Task) -> dict:
    return {"Output": spatial.make_grid(t.one.df, t.config.text("SpatialField", "Field"), t.config.number("GridSize", default=1.0))}


@builds("Find Nearest")
def _nearest(t: Task) -> dict:
    c = t.config
    return spatial.find_nearest(t.inputs[0].df, t.inputs[1].df, c.text("TargetKey"), c.text("TargetField"), c.text("UniverseKey"), c.text("UniverseField"), c.number("MaxDistance", default=100))


@builds("Buffer")
def _buffer(t: Task) -> dict:
    return {"Output": polygons.buffer(t.one.df, t.config.text("SpatialField", "Field"), t.config.number("Distance", "BufferSize", default=1.0))}


@builds("Trade Area")
def _trade_area(t: Task) -> dict:
    radii = [float(r) for r in re.findall(r"[0-9.]+", t.config.text("Radii", "Radius", default="1"))]
    return {"Output": polygons.trade_area(t.one.df, t.config.text("SpatialField", "Field"), radii)}


@builds("Poly-Build")
def _poly_build(t: Task) -> dict:
    order = [(n, True) for n in _known(t.one, [t.config.text("SequenceField")], t)] if t.config.text("SequenceField") else t.one.order
    return {"Output": polygons.poly_build(t.one.df, t.config.text("SpatialField", "SourceField", "Field"), _known(t.one, _groups(t.config), t), order)}


@builds("Poly-Split")
def _poly_split(t: Task) -> dict:
    return {"Output": polygons.poly_split(t.one.df, t.config.text("SpatialField", "Field"))}


@builds("Smooth")
def _smooth(t: Task) -> dict:
    return {"Output": Stream(polygons.smooth(t.one.df, t.config.text("SpatialField", "Field"), int(t.config.number("Iterations", default=2))), t.one.order, t.one.origins)}


@builds("Generalize")
def _generalize(t: Task) -> dict:
    return {"Output": Stream(polygons.generalize(t.one.df, t.config.text("SpatialField", "Field"), t.config.number("Threshold", "Tolerance", default=0.01)), t.one.order, t.one.origins)}


@builds("Spatial Info")
def _spatial_info(t: Task) -> dict:
    return {"Output": polygons.spatial_info(t.one.df, t.config.text("SpatialField", "Field"))}


@builds("Spatial Match")
def _spatial_match(t: Task) -> dict:
    return polygons.spatial_match(t.inputs[0].df, t.inputs[1].df, t.config.text("TargetField"), t.config.text("UniverseField"))


@builds("Spatial Process")
def _spatial_process(t: Task) -> dict:
    return {"Output": polygons.spatial_process(t.one.df, t.config.text("SpatialField1", "Field1"), t.config.text("SpatialField2", "Field2"), (t.config.text("Action", default="combine")).lower())}


def register(name: str, build: Callable[[Task], dict], *, category: str = "Extension", inputs: tuple[str, ...] = ("Input",), outputs: tuple[str, ...] = ("Output",), aliases: tuple[str, ...] = (), prefix: str | None = None) -> None:
    """Add a tool, or replace one: ``build`` takes a ``Task`` and gives frames or streams by anchor. It is found by its name and
    aliases, as by the last part of a plugin's name, and with ``prefix`` by any plugin name that starts so and is not known."""
    registry.add(registry.ToolDefinition(category, name, registry.FULL, inputs, outputs, False, tuple(map(registry.plain, (name, *aliases)))), prefix)
    BUILDERS[name] = build
