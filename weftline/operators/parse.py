"""Operators that take texts apart and put them together."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.operators import ordered as O
from weftline.session import ship


def date_time(df: DataFrame, field: str, out: str | None = None, fmt: str = "%Y-%m-%d", *, to_text: bool = False) -> DataFrame:
    """A text as a timestamp by a strftime format, bad texts null; or, with ``to_text``, a date as text."""
    pattern = C.java_pattern(fmt or "%Y-%m-%d")
    if to_text:
        c = F.date_format(C.name(field), pattern)
    else:
        c = F.try_to_timestamp(C.name(field).cast("string"), F.lit(pattern)).cast("timestamp_ntz")
    return df.withColumn(out or f"{field}_Out", c)


def java_regex(pattern: str) -> str:
    """Named groups and ends of texts in Java's spelling."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)).replace(r"\Z", r"\z")


def groups_of(pattern: str) -> int:
    return re.compile(re.sub(r"\(\?<(\w+)>", r"(?P<\1>", pattern).replace(r"\z", r"\Z")).groups


def _group(c: Column, pattern: str, i: int) -> Column:
    return F.when(F.rlike(c, F.lit(pattern)), F.regexp_extract(c, pattern, i))


def regex(df: DataFrame, field: str, pattern: str, method: str = "parse", *, ignore_case: bool = False, replacement: str = "", split_rows: bool = False, out: Sequence[str] = ()) -> DataFrame:
    """``parse``: capture groups as fields, ``<field>_regex`` or with numbers where there are several; no match is null.
    ``match``: whether it matches. ``replace``: every match. ``tokenize``: all matches as fields or, with ``split_rows``, rows."""
    p = ("(?i)" if ignore_case else "") + java_regex(pattern)
    c = C.name(field).cast("string")
    method = method.lower()
    if method == "match":
        return df.withColumn(out[0] if out else f"{field}_Matched", F.coalesce(F.rlike(c, F.lit(p)), F.lit(False)))
    if method == "replace":
        return df.withColumn(field, F.regexp_replace(c, p, replacement))
    n = groups_of(p)
    if method == "tokenize":
        found = F.regexp_extract_all(c, F.lit(p), F.lit(1 if n else 0))
        if split_rows:
            return df.withColumn(out[0] if out else f"{field}_token", F.explode(found))
        width = len(out) or (df.agg(F.max(F.size(found)).alias("n")).first()["n"] or 0)
        return df.withColumns({(out[i] if i < len(out) else f"{field}_{i}"): F.get(found, F.lit(i)) for i in range(width)})
    if n <= 1:
        return df.withColumn(out[0] if out else f"{field}_regex", _group(c, p, n))
    return df.withColumns({(out[i] if i < len(out) else f"{field}_regex{i + 1}"): _group(c, p, i + 1) for i in range(n)})


def text_to_columns(df: DataFrame, field: str, delimiter: str = ",", width: int | None = None, *, to_rows: bool = False) -> DataFrame:
    """Parts as ``<field>_0``, ``<field>_1`` and so on, missing ones null, or as rows. A delimiter of one character is
    literal, a longer one a regular expression. Without a width one aggregate finds it; with one the last field takes the rest."""
    p = re.escape(delimiter) if len(delimiter) == 1 else java_regex(delimiter)
    if len(delimiter) == 1:
        p = rf"\Q{delimiter}\E"
    c = C.name(field).cast("string")
    if to_rows:
        return df.withColumn(field, F.explode_outer(F.split(c, p)))
    parts = F.split(c, p, width) if width else F.split(c, p)
    n = width or df.agg(F.max(F.size(parts)).alias("n")).first()["n"] or 0
    return df.withColumns({f"{field}_{i}": F.get(parts, F.lit(i)) for i in range(max(n, 0))})


def _leaves(texts: pa.Array) -> pa.Array:
    """Of every JSON text its leaves as (name, value), null for null and bad texts."""
    from weftline.operators.flatten import load_json

    offsets, names, values = [0], [], []
    for text in texts.to_pylist():
        try:
            stack = [("", load_json(text))] if text else []
        except ValueError:
            stack = []
        while stack:
            path, v = stack.pop()
            lead = path + "." if path else ""
            if isinstance(v, dict):
                stack.extend((lead + k, x) for k, x in reversed(v.items()))
            elif isinstance(v, list):
                stack.extend((lead + str(k), x) for k, x in reversed([*enumerate(v)]))
            else:
                names.append(path)
                values.append(None if v is None else v if isinstance(v, str) else json.dumps(v))
        offsets.append(len(names))
    leaves = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], ["name", "value"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), leaves)


def json_parse(df: DataFrame, field: str, *, name: str = "JSON_Name", value: str = "JSON_ValueString") -> DataFrame:
    """A row per leaf of the JSON text: its path, steps joined by ``.``, and its text. Bad and null texts give no rows. Only the
    texts go to Python; the other columns meet the leaves in the JVM."""
    ship(df.sparkSession)
    leaves = F.arrow_udf(_leaves, "array<struct<name: string, value: string>>")
    kept = [C.name(c) for c in df.columns if c != field]
    found = df.withColumn("__leaves", leaves(C.name(field).cast("string"))).select(*kept, F.inline("__leaves").alias("__name", "__value"))
    return found.select(*kept, F.col("__name").alias(name), F.col("__value").alias(value))


def json_build(df: DataFrame, out: str = "JSON", group: Sequence[str] = (), order: O.Order = ()) -> DataFrame:
    """The rows, or those of each group, as one JSON array of records in their order, nulls kept. One text is made by one task,
    as it is one value."""
    from weftline.operators.transform import row_order

    fields = [c for c in df.columns if c not in group]
    rows, by = row_order(df, order)
    items = F.sort_array(F.collect_list(F.struct(by.alias("by"), F.struct(*[C.name(c) for c in fields]).alias("record"))))
    made = F.to_json(F.transform(items, lambda x: x["record"]), {"ignoreNullFields": "false"}).alias(out)
    return rows.groupBy(*[C.name(g) for g in group]).agg(made) if group else rows.agg(made)


def xml_parse(df: DataFrame, field: str, paths: dict[str, str], *, rows: str | None = None) -> DataFrame:
    """Texts at paths below the root (``A/B``, ``A/B/@c``) as fields. With ``rows``, a path to a repeated element, there is a
    row for each and the paths start there. Texts that are null or not well-formed give nulls, or no rows."""
    steps = list(paths.values())

    def value(node, path: str) -> str | None:  # noqa: ANN001
        step, _, attribute = path.partition("@")
        step = step.strip("/")
        found = node.find(step) if step else node
        if found is None:
            return None
        return found.get(attribute) if attribute else "".join(found.itertext())

    def found(texts: pa.Array) -> pa.Array:
        offsets, values = [0], []
        for text in texts.to_pylist():
            try:
                root = ET.fromstring(text) if text else None
            except ET.ParseError:
                root = None
            nodes = [root] if rows is None else [] if root is None else root.findall(rows)
            values += [[None if node is None else value(node, p) for p in steps] for node in nodes]
            offsets.append(len(values))
        columns = [pa.array(c, pa.string()) for c in zip(*values, strict=True)] if values else [pa.array([], pa.string()) for _ in steps]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, [f"v{i}" for i in range(len(steps))]))

    ship(df.sparkSession)
    kind = f"array<struct<{', '.join(f'v{i}: string' for i in range(len(steps)))}>>"
    # only the texts go to Python
    made = df.withColumn("__xml", F.arrow_udf(found, kind)(C.name(field).cast("string"))).select(*[C.name(c) for c in df.columns], F.inline("__xml"))
    return made.select(*[C.name(c) for c in df.columns], *[F.col(f"v{i}").alias(n) for i, n in enumerate(paths)])
