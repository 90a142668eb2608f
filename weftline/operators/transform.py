"""Summaries, cross tabs and unpivots."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.operators import ordered as O


@dataclass(frozen=True)
class Action:
    field: str
    action: str
    rename: str | None = None

    @property
    def out(self) -> str:
        return self.rename or (self.field if self.action.lower() == "groupby" else f"{self.action}_{self.field}")


def _first_last(c: Column, by: Column, last: bool) -> Column:
    pick = F.max_by if last else F.min_by
    return pick(c, F.when(c.isNotNull(), by))


def _joined(c: Column, by: Column, separator: str) -> Column:
    """All values in the order of the rows, without nulls."""
    item = F.when(c.isNotNull(), F.struct(by.alias("by"), c.cast("string").alias("text")))
    return F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["text"]), separator)


# what every action makes of a column and, for First and Last, the rows' order
_ACTIONS: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda c, by: F.coalesce(F.sum(c), F.lit(0)),
    "count": lambda c, by: F.count(c),
    "countnonnull": lambda c, by: F.count(c),
    "countnull": lambda c, by: F.count(F.when(c.isNull(), 1)),
    "countdistinct": lambda c, by: F.count_distinct(c),
    "min": lambda c, by: F.min(c),
    "max": lambda c, by: F.max(c),
    "avg": lambda c, by: F.avg(c),
    "mean": lambda c, by: F.avg(c),
    "first": lambda c, by: _first_last(c, by, False),
    "last": lambda c, by: _first_last(c, by, True),
    "stddev": lambda c, by: F.stddev_samp(c),
    "variance": lambda c, by: F.var_samp(c),
    "median": lambda c, by: F.median(c),
    "mode": lambda c, by: F.mode(c, True),
    "concat": lambda c, by: _joined(c, by, ","),
}


#: Actions that depend on the order of the rows.
_ORDERED = frozenset(("first", "last", "concat"))


def row_order(df: DataFrame, order: O.Order) -> tuple[DataFrame, Column]:
    """Rows with their place in the source, and the column that orders them by ``order`` and then by that."""
    order = [(c, up) for c, up in order if c in df.columns]
    df = df.withColumn("__at", F.monotonically_increasing_id())
    by = O.sort_key(df, order, F.col("__at"))
    if by is None:  # a type that cannot be turned round: by numbers of the sorted rows
        df = O.numbered(df.drop("__at"), "__at", order)
        by = F.struct(F.col("__at"))
    return df, by


def _with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a null key, told so that the scan can leave them out."""
    return df.where(reduce(Column.__and__, [C.name(k).isNotNull() for k in keys])) if keys else df


def _passes(actions: Sequence[Action]) -> list[list[tuple[int, Action]]]:
    """Actions that are aggregated together. Distinct counts make Spark group by their fields first, which would build the
    large buffers of medians, modes, lists and ordered picks for each of their values: they go apart from those."""
    numbered = list(enumerate(actions))
    distinct = [(i, a) for i, a in numbered if a.action.lower() == "countdistinct"]
    heavy = any(a.action.lower() in ("median", "mode", "concat", "first", "last") for a in actions)
    if not distinct or not heavy:
        return [numbered]
    return [[x for x in numbered if x not in distinct], distinct]


def summarize(df: DataFrame, actions: Sequence[Action], order: O.Order = (), *, keep_null_keys: bool = False, diagnostics: list | None = None) -> DataFrame:
    """Groups and aggregates in the listed order of fields. Rows with a null key are left out, unless only keys are asked for
    or ``keep_null_keys``; without keys there is one row; without actions the frame as it is. The sum of nothing is 0. First
    and Last skip nulls, they and Concat follow ``order``, nulls last, else the source. An unknown action is reported and left out."""
    say = diagnostics if diagnostics is not None else []
    known = []
    for a in actions:
        if a.field not in df.columns:
            say.append(("unresolved_field", f"there is no field {a.field}"))
        elif a.action.lower() != "groupby" and a.action.lower() not in _ACTIONS:
            say.append(("unknown_action", f"{a.action} of {a.field}"))
        else:
            known.append(a)
    keys = [a for a in known if a.action.lower() == "groupby"]
    rest = [a for a in known if a.action.lower() != "groupby"]
    if not known:
        return df
    if not rest:
        return df.select(*[C.name(k.field).alias(k.out) for k in keys]).distinct()
    if keys and not keep_null_keys:
        df = _with_keys(df, [k.field for k in keys])
    by = F.lit(0)
    if any(a.action.lower() in _ORDERED for a in rest):
        df, by = row_order(df, order)
    by_key = [C.name(k.field).alias(f"__k{i}") for i, k in enumerate(keys)]
    made = None
    for part in _passes(rest):
        aggs = [_ACTIONS[a.action.lower()](C.name(a.field), by).alias(f"__{i}") for i, a in part]
        one = df.groupBy(*by_key).agg(*aggs)
        if made is None:
            made = one
        elif not keys:
            made = made.withColumns({f"__{i}": one.select(f"__{i}").scalar() for i, _ in part})
        else:
            names = [f"__k{i}" for i in range(len(keys))]
            if not keep_null_keys:
                made = made.join(one, names)
            else:
                other = one.toDF(*[f"__o{c}" if c in names else c for c in one.columns])
                made = made.join(other, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__o{c}")) for c in names]))
    place = {id(a): f"__{i}" for i, a in enumerate(rest)} | {id(k): f"__k{i}" for i, k in enumerate(keys)}
    return made.select(*[F.col(place[id(a)]).alias(a.out) for a in known])


def count_records(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("Count"))


def running_total(df: DataFrame, field: str, group: Sequence[str] = (), order: O.Order = ()) -> DataFrame:
    return O.running_total(df, field, group, order)


_CROSS: dict[str, str] = {"sum": "sum", "avg": "avg", "mean": "avg", "count": "count", "countdistinct": "countdistinct", "min": "min", "max": "max", "first": "first", "last": "last", "concat": "concat"}


def _placed(values: Sequence[str], declared: Sequence[str], header: str, diagnostics: list) -> list[str]:
    """All values, those that are declared first."""
    left = dict.fromkeys(values)
    out: list[str] = []
    for name in declared:
        same = [name] if name in left else [v for v in left if v not in declared and re.sub(r"\W", "_", v) == name]
        if not same and name not in out:
            diagnostics.append(("header_values", f"{header} has no value {name}: the field is empty"))
        out += [v for v in same or [name] if v not in out]
        for v in same:
            del left[v]
    if left:
        diagnostics.append(("header_values", f"{header} has {len(left)} values that the document does not know"))
    return [*out, *left]


def cross_tab(df: DataFrame, group: Sequence[str], header: str, data: str, method: str = "sum", values: Sequence[str] | None = None, diagnostics: list | None = None, limit: int = 10_000, declared: Sequence[str] = (), order: O.Order = ()) -> DataFrame:
    """One field per value of the header, sorted; empty cells are null. Rows with a null group or header are left out. Without
    group fields there is one row, named by the data field. Text is summed and averaged as numbers. Known ``values`` save the
    job that collects them; more than ``limit`` headers are an error. ``declared`` names come first, in their order: a header in the
    place of its name, as it is or with other characters than letters and digits as underscores, else an empty field. First, Last and Concat follow ``order``, nulls last, else the source."""
    how = _CROSS.get(method.lower(), "sum")
    c = C.name(data)
    if how in ("sum", "avg") and C.kind_of(df.schema[data].dataType) == C.STR:
        c = c.try_cast("double")
        if diagnostics is not None:
            diagnostics.append(("type_mismatch", f"{data} is text and is summed as numbers"))
    by = F.lit(0)
    df = _with_keys(df, [*group, header])
    if how in _ORDERED:
        df, by = row_order(df, order)
    rows = df.select(*[C.name(g) for g in group], C.name(header).cast("string").alias("__h"), c.alias("__d"), by.alias("__by"))
    by = F.col("__by")
    if values is None:
        values = sorted(r[0] for r in rows.select("__h").distinct().limit(limit + 1).collect())
        if len(values) > limit:
            raise ValueError(f"{header} has more than {limit} values")
        if declared:
            values = _placed(values, declared, header, diagnostics if diagnostics is not None else [])
    if how == "concat":
        agg = F.when(F.count("__d") > 0, _joined(F.col("__d"), by, ", "))
    else:
        agg = {"sum": F.sum("__d"), "avg": F.avg("__d"), "count": F.count("__d"), "countdistinct": F.count_distinct("__d"), "min": F.min("__d"), "max": F.max("__d"), "first": _first_last(F.col("__d"), by, False), "last": _first_last(F.col("__d"), by, True)}[how]
        if how == "sum":  # a cell of nulls only sums to 0
            agg = F.coalesce(agg, F.lit(0))
    if not group:
        rows = rows.withColumn("index", F.lit(data))
        return rows.groupBy("index").pivot("__h", list(values)).agg(agg)
    return rows.groupBy(*[C.name(g) for g in group]).pivot("__h", list(values)).agg(agg)


def transpose(df: DataFrame, keys: Sequence[str], fields: Sequence[str] = (), diagnostics: list | None = None) -> DataFrame:
    """(keys, Name, Value) for every data field, by default all others; nulls stay. Mixed types become text, numbers double."""
    data = list(fields) or [c for c in df.columns if c not in keys]
    kinds = {f.name: f.dataType for f in df.schema}
    data = [c for c in data if c in kinds]
    types = {kinds[c].simpleString() for c in data}
    cast = None if len(types) == 1 else "double" if all(C.kind_of(kinds[c]) == C.NUM for c in data) else "string"
    if cast:
        df = df.select(*[C.name(k) for k in keys], *[C.name(c).cast(cast).alias(c) for c in data])
    return df.unpivot([C.name(k) for k in keys], [C.name(c) for c in data], "Name", "Value")
