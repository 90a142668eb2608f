"""Row-by-row preparation: select, filter, formula, cleansing, typing and naming of fields."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import columns as C
from weftline.functions import expression as X
from weftline.operators import ordered as O

Diagnostics = list[tuple[str, str]]

# Field types of documents and what they become.
_TYPES = {
    "string": "string", "v_string": "string", "wstring": "string", "v_wstring": "string", "byte": "smallint", "int16": "smallint", "int32": "int",
    "int64": "bigint", "float": "float", "double": "double", "bool": "boolean", "date": "date", "time": "string", "datetime": "timestamp_ntz",
    "blob": "binary", "spatialobj": "string",
}


def spark_type(kind: str, size: int | None = None, scale: int | None = None) -> str:
    """A document's type as a Spark type; unknown ones are text."""
    key = kind.strip().lower()
    if key == "fixeddecimal":
        return f"decimal({min(size or 38, 38)},{min(scale if scale is not None else 6, 38)})"
    return _TYPES.get(key, "string")


def cast(c: Column, have: T.DataType, want: str) -> Column:
    """A cast that gives null where it fails."""
    return c if have.simpleString() == want else c.cast("string") if want == "string" else c.try_cast(want)


@dataclass(frozen=True)
class Choice:
    field: str
    selected: bool = True
    rename: str | None = None
    type: str | None = None
    size: int | None = None
    scale: int | None = None


def select(df: DataFrame, choices: Sequence[Choice], *, unknown: bool = False, diagnostics: Diagnostics | None = None) -> DataFrame:
    """Chosen fields in the listed order, renamed and cast. None listed: as it is; all deselected: all fields.
    ``unknown`` keeps fields that are not listed, behind the others."""
    listed = [c for c in choices if not c.field.startswith("*")]
    if not listed or not any(c.selected for c in listed):
        return df
    fields = {f.name: f for f in df.schema}
    out: list[Column] = []
    for c in listed:
        if not c.selected:
            continue
        if c.field not in fields:
            if diagnostics is not None:
                diagnostics.append(("unresolved_field", f"there is no field {c.field}"))
            continue
        col = C.name(c.field)
        if c.type:
            col = cast(col, fields[c.field].dataType, spark_type(c.type, c.size, c.scale))
        out.append(col.alias(c.rename or c.field))
    if unknown:
        known = {c.field for c in listed}
        out += [C.name(f) for f in fields if f not in known]
    return df.select(*out)


def filter_rows(df: DataFrame, text: str | None, order: O.Order = (), diagnostics: Diagnostics | None = None) -> dict[str, DataFrame]:
    """``True`` and ``False``: an exact partition of the rows; a null condition is false. Without an expression, or with one
    that can't be read, all rows are true."""
    say = diagnostics if diagnostics is not None else []
    if not text or not text.strip():
        say.append(("missing_configuration", "the filter has no expression"))
        return {"True": df, "False": df.where(F.lit(False))}
    try:
        node = X.parse(text)
        if any(isinstance(n, X.Field) and n.row for n in X.walk(node)):
            marked = O.with_rows(df, {"__keep": node}, (), order)
            keep = F.coalesce(F.col("__keep"), F.lit(False))
            return {"True": marked.where(keep).drop("__keep"), "False": marked.where(~keep).drop("__keep")}
        exact, where, found = C.predicate(text, df.schema)
    except X.ExpressionError as e:
        say.append(("expression_error", str(e)))
        return {"True": df, "False": df.where(F.lit(False))}
    say.extend(found)
    return {"True": df.where(where), "False": df.where(~exact)}


def formula(df: DataFrame, formulas: Sequence[tuple[str, str]] | Sequence[tuple[str, str, str | None]], order: O.Order = (), diagnostics: Diagnostics | None = None) -> DataFrame:
    """Fields from expressions, one after the other: later ones see earlier results, a field may be overwritten. One that
    can't be read gives null. Expressions that don't refer to each other share a projection."""
    say = diagnostics if diagnostics is not None else []
    batch: dict[str, Column] = {}

    def flush(frame: DataFrame) -> DataFrame:
        done = frame.withColumns(batch) if batch else frame
        batch.clear()
        return done

    for field, text, *more in formulas:
        if not field or not text:
            say.append(("incomplete_formula", f"the formula of {field or 'no field'} is incomplete"))
            continue
        try:
            node = X.parse(text)
        except X.ExpressionError as e:
            say.append(("expression_error", f"{field}: {e}"))
            df = flush(df)
            batch[field] = F.lit(None).cast("string")
            continue
        if set(X.fields(node)) & set(batch) or field in batch:
            df = flush(df)
        if any(isinstance(n, X.Field) and n.row for n in X.walk(node)):
            df = O.with_rows(flush(df), {field: node}, (), order)
            continue
        ctx = C.context(df.schema)
        try:
            value = C.compile_node(node, ctx)
        except X.ExpressionError as e:
            say.append(("expression_error", f"{field}: {e}"))
            value = C.Value(F.lit(None), C.NULL)
        say.extend(ctx.diagnostics)
        col = value.col.cast("string") if value.kind == C.NULL else value.col
        if more and more[0]:
            want = spark_type(more[0])
            col = col.cast("string") if want == "string" else col if value.kind == C.NUM and want == "double" else col.try_cast(want) if value.kind != C.DATE or want in ("date", "timestamp_ntz") else col
            if want == "double":
                col = col.cast("double") if value.kind == C.NUM else col
        batch[field] = col
    return flush(df)


def multi_field_formula(df: DataFrame, fields: Sequence[str], text: str, *, prefix: str = "", suffix: str = "") -> DataFrame:
    """One expression for several fields; ``[_CurrentField_]`` is the field at hand. With a prefix or suffix the results are new fields."""
    made = {}
    for f in fields:
        ctx = C.context(df.schema, current=f)
        made[f"{prefix}{f}{suffix}"] = C.compile_text(text, ctx).col
    return df.withColumns(made) if made else df


def generate_rows(spark: SparkSession, field: str = "RowCount", start: int = 1, stop: int = 10, step: int = 1) -> DataFrame:
    """Numbers from start to stop, stop included, made by all tasks."""
    return spark.range(start, stop + (1 if step > 0 else -1), step).select(F.col("id").alias(field))


def generate_rows_of(df: DataFrame, field: str, start: str | X.Node, stop: str | X.Node, step: float = 1, *, strict: bool = False) -> DataFrame:
    """For every row the numbers between two expressions, without the second where ``strict``; none where the first is beyond
    the second. Whole numbers unless the first or the step is none."""
    ctx = C.context(df.schema)
    a, b = ((C.compile_text(x, ctx) if isinstance(x, str) else C.compile_node(x, ctx)).col for x in (start, stop))
    kind = df.select(a.alias("a")).schema["a"].dataType
    if float(step).is_integer() and isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.NullType)):
        a, b = a.cast("bigint"), b if isinstance(df.select(b.alias("b")).schema["b"].dataType, T.IntegralType) else b.cast("double")
        last = F.ceil(b) - 1 if strict and step > 0 else F.floor(b) + 1 if strict else F.floor(b) if step > 0 else F.ceil(b)
        last = last.cast("bigint")
        within = a <= last if step > 0 else a >= last
        return df.where(within).withColumn(field, F.explode(F.sequence(a, last, F.lit(int(step)).cast("bigint"))))
    a, b = a.cast("double"), b.cast("double")
    steps = (b - a) / F.lit(float(step))
    steps = (F.ceil(steps - 1e-9) - 1 if strict else F.floor(steps + 1e-9)).cast("bigint")
    return df.where(steps >= 0).withColumn(field, F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), steps), lambda i: a + i * F.lit(float(step)))))


def cleanse(df: DataFrame, fields: Sequence[str] = (), *, trim: bool = True, remove_whitespace: bool = False, case: str | None = None, remove_null: bool = False, replace_null: bool = False, remove: str | None = None) -> DataFrame:
    """Text fields: trim, drop all white space, change case (upper, lower, title); then drop rows with a null in the fields.

    No fields: all text fields are trimmed and rows with any null dropped. ``replace_null`` puts '' and 0 for nulls,
    ``remove`` drops characters of a set: letters, numbers or punctuation."""
    if not fields:
        fields, remove_null = df.columns, True
    kinds = {f.name: C.kind_of(f.dataType) for f in df.schema}
    made: dict[str, Column] = {}
    for f in fields:
        if f not in kinds:
            continue
        c = C.name(f)
        if kinds[f] == C.STR:
            if trim:
                c = C.strip(c)
            if remove_whitespace:
                c = F.regexp_replace(c, r"(?U)\s+", "")
            if remove:
                c = F.regexp_replace(c, {"letters": r"\p{L}+", "numbers": r"\p{N}+", "punctuation": r"\p{P}+"}[remove], "")
            if case:
                c = {"upper": F.upper, "lower": F.lower, "title": C.title}[case.lower()](c)
            if replace_null:
                c = F.coalesce(c, F.lit(""))
        elif replace_null and kinds[f] == C.NUM:
            c = F.coalesce(c, F.lit(0))
        made[f] = c
    out = df.withColumns(made) if made else df
    return out.dropna(subset=[f for f in fields if f in kinds]) if remove_null else out


def auto_field(df: DataFrame) -> DataFrame:
    """Text fields as the narrowest type that holds all their values, found by one aggregate over all rows."""
    tests = ("bigint", "double", "boolean", "date", "timestamp_ntz")
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    aggs = [F.count(F.when(C.name(c).isNotNull() & C.name(c).try_cast(t).isNull(), 1)).alias(f"{i}_{t}") for i, c in enumerate(texts) for t in tests]
    bad = df.agg(*aggs, *[F.count(C.name(c)).alias(f"{i}_n") for i, c in enumerate(texts)]).first()
    casts = {}
    for i, c in enumerate(texts):
        fit = next((t for t in tests if bad[f"{i}_n"] and not bad[f"{i}_{t}"]), None)
        if fit:
            casts[c] = C.name(c).try_cast(fit)
    return df.withColumns(casts) if casts else df


def dynamic_select(df: DataFrame, kinds: Sequence[str] = ("num", "str"), pattern: str | None = None) -> DataFrame:
    """Fields by kind (num, str, bool, date) and, if given, by a regular expression for the whole name."""
    keep = [f.name for f in df.schema if C.kind_of(f.dataType) in kinds and (pattern is None or re.fullmatch(pattern, f.name))]
    return df.select(*[C.name(c) for c in keep])


def dynamic_rename(df: DataFrame, *, prefix: str = "", suffix: str = "", names: Mapping[str, str] | None = None, pattern: str | None = None, replacement: str = "") -> DataFrame:
    """Names without spaces at their ends; then replaced by a table or a pattern, then with prefix and suffix."""
    out = []
    for c in df.columns:
        n = c.strip()
        n = (names or {}).get(n, n)
        if pattern:
            n = re.sub(pattern, replacement, n)
        out.append(f"{prefix}{n}{suffix}")
    return df.toDF(*out)


def field_info(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([*map(tuple, df.dtypes)], "Name string, Type string")


def arrange(df: DataFrame, keys: Sequence[str], outputs: Mapping[str, Sequence[str]], description: str | None = None) -> DataFrame:
    """Several input fields under each other in output fields: row i of a record takes the i-th input of every output.
    ``description`` is filled with the name of the first output's input."""
    height = max((len(v) for v in outputs.values()), default=0)
    kinds = {f.name: f.dataType for f in df.schema}
    widest = {o: next(iter({kinds[c].simpleString() for c in v})) if len({kinds[c].simpleString() for c in v}) == 1 else "string" for o, v in outputs.items()}
    rows = []
    for i in range(height):
        cells = [(C.name(v[i]).cast(widest[o]) if i < len(v) else F.lit(None).cast(widest[o])).alias(o) for o, v in outputs.items()]
        if description:
            first = next(iter(outputs.values()))
            cells.append(F.lit(first[i] if i < len(first) else None).cast("string").alias(description))
        rows.append(F.struct(*cells))
    return df.select(*[C.name(k) for k in keys], F.inline(F.array(*rows)))


def make_columns(df: DataFrame, width: int, order: O.Order = (), group: Sequence[str] = ()) -> DataFrame:
    """Consecutive rows side by side: ``width`` rows make one, fields named ``Field_1``, ``Field_2`` and so on."""
    fields = [c for c in df.columns if c not in group]
    if group:
        rows = O.placed(df) if not order else df
        numbered = rows.withColumn("__n", F.row_number().over(C.ordered(order or [("__place", True)], group)) - 1)
    else:
        numbered = O.numbered(df, "__n", order, 0)
    cells = [F.max(F.when(F.col("__n") % width == i, C.name(c))).alias(f"{c}_{i + 1}") for i in range(width) for c in fields]
    return numbered.groupBy(*[C.name(g) for g in group], F.floor(F.col("__n") / width).alias("__line")).agg(*cells).drop("__line")


def binning(df: DataFrame, fields: Sequence[str], bins: int, method: str = "equal_width", suffix: str = "_Tile_Num", accuracy: float = 0.001) -> DataFrame:
    """Bins from 1 of several fields at once: ``equal_width`` from one min/max aggregate, ``equal_records`` from approximate quantiles."""
    made: dict[str, Column] = {}
    if method == "equal_width":
        ends = df.agg(*[x for i, f in enumerate(fields) for x in (F.min(C.name(f)).alias(f"lo{i}"), F.max(C.name(f)).alias(f"hi{i}"))]).first()
        for i, f in enumerate(fields):
            lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
            step = (hi - lo) / bins if lo is not None and hi != lo else 1
            made[f + suffix] = F.when(C.name(f).isNotNull(), F.least(F.floor((C.name(f) - F.lit(lo)) / F.lit(step)) + 1, F.lit(bins))).cast("int")
    else:
        cuts = df.approxQuantile(list(fields), [i / bins for i in range(1, bins)], accuracy)
        for f, edges in zip(fields, cuts, strict=True):
            number = F.lit(1)
            for e in edges:
                number = number + F.when(C.name(f) > e, 1).otherwise(0)
            made[f + suffix] = F.when(C.name(f).isNotNull(), number).cast("int")
    return df.withColumns(made) if made else df
