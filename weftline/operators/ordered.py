"""Operators that depend on the order of rows.

Order is a list of (column, ascending); nulls come last either way. Without one the order of the source counts.
A window over all rows would put them into one task, so global numbers come in two phases: rows are range
partitioned and sorted once, every partition is summed up, and the partitions' offsets, one row each, are added.

Groups are windows of their own, one task each, as long as they are counted to have at most ``HOT_ROWS`` rows.
Larger ones are range partitioned by their order like a whole frame, so the rows of one group are spread over
tasks; what a partition needs of the ones before is one row for its first group (``_spread``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.functions import columns as C
from weftline.functions import expression as X
from weftline.session import cut

Order = Sequence[tuple[str, bool]]
_PLACE, _PART, _AT = "__place", "__part", "__at"
_MASK = (1 << 33) - 1
#: Rows of a group that one task takes.
HOT_ROWS = 2_000_000
#: Rows that a top-k may bring into one task.
TOP_ROWS = 100_000


def sort_columns(order: Order) -> list[Column]:
    return [(C.name(c).asc_nulls_last() if up else C.name(c).desc_nulls_last()) for c, up in order]


def sort(df: DataFrame, order: Order) -> DataFrame:
    """Nulls last in both directions. No fields: as it is."""
    return df.orderBy(*sort_columns(order)) if order else df


# Digits of hexadecimal numbers, and those they are counted down to.
_UP, _DOWN = "0123456789ABCDEF", "FEDCBA9876543210"


def _descending(c: Column, kind: T.DataType) -> Column | None:
    """A value that sorts upwards as ``c`` sorts downwards; None for types without one."""
    if isinstance(kind, T.NumericType):
        # the least integer has no positive counterpart
        return -c.cast("decimal(20,0)") if isinstance(kind, T.IntegralType) else -c
    if isinstance(kind, T.BooleanType):
        return ~c
    if isinstance(kind, T.DateType):
        return -F.unix_date(c)
    if isinstance(kind, T.TimestampType):
        return -F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return -F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        # complemented digits, and an end behind all of them: a prefix comes last
        return F.concat(F.translate(F.hex(c), _UP, _DOWN), F.lit("G"))
    return None


def sort_key(df: DataFrame, order: Order, place: Column | None = None) -> Column | None:
    """One column that sorts upwards as the rows are ordered, nulls last, rows that are equal by their place: what aggregates
    can pick and sort by. None if a type cannot be turned round."""
    parts = []
    for c, up in order:
        value = C.name(c) if up else _descending(C.name(c), df.schema[c].dataType)
        if value is None or isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)):
            return None
        parts += [C.name(c).isNull(), value]
    return F.struct(*[x.alias(f"k{i}") for i, x in enumerate([*parts, *([] if place is None else [place])])])


def placed(df: DataFrame, order: Order = ()) -> DataFrame:
    """Add partition and place within it, in the order of the rows over all partitions."""
    if order:
        # the source's place as the last key: equal rows keep their order, and a frequent key is divided among partitions
        keys = [*sort_columns(order), F.col(_PLACE)]
        df = cut(df.withColumn(_PLACE, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(_PLACE))
    at = F.monotonically_increasing_id()
    return df.withColumn(_PLACE, at).withColumns({_PART: F.shiftright(F.col(_PLACE), 33), _AT: F.col(_PLACE).bitwiseAND(_MASK)})


def _offsets(parts: DataFrame, value: str) -> DataFrame:
    """Sums of the partitions before; one row per partition."""
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(_PART, F.coalesce(F.sum(value).over(before), F.lit(0)).alias("__before"))


def numbered(df: DataFrame, column: str, order: Order = (), start: int = 1) -> DataFrame:
    """Consecutive numbers in the order of the rows, without a window over all rows."""
    rows = placed(df, order)
    parts = rows.groupBy(_PART).agg(F.count(F.lit(1)).alias("n"))
    # as many rows as partitions: bounded by the plan, not by the data
    out = rows.join(F.broadcast(_offsets(parts, "n")), _PART)
    return out.withColumn(column, (F.col("__before") + F.col(_AT) + start).cast("bigint")).drop("__before", _PLACE, _PART, _AT)


def record_id(df: DataFrame, column: str = "RecordID", start: int = 1, order: Order = (), last: bool = False) -> DataFrame:
    out = numbered(df, column, order, start)
    rest = [C.name(c) for c in df.columns if c != column]
    return out.select(*rest, C.name(column)) if last else out.select(C.name(column), *rest)


def _split(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of groups that fit a task, rows of larger ones); None where there are none of the kind."""
    sizes = df.groupBy(*[C.name(g).alias(f"__g{i}") for i, g in enumerate(group)]).agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.where(F.col("n") > HOT_ROWS).drop("n")
    if hot.isEmpty():
        return df, None
    on = reduce(Column.__and__, [C.name(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)])
    return df.join(hot, on, "left_anti"), df.join(hot, on, "left_semi")


def _spread(df: DataFrame, group: Sequence[str], order: Order, sums: dict[str, Column] | None = None) -> DataFrame:
    """Add ``__n``, the number of the row in its group, and the sums up to the row, nulls not counted. The rows of a group may lie
    in many partitions; of the groups that do, one row for each of their partitions says what came before."""
    sums = sums or {}
    keys = [(g, True) for g in group]
    rows = placed(df, [*keys, *order]).withColumn("__group", F.struct(*[C.name(g) for g in group])).withColumns({f"__v{i}": c for i, c in enumerate(sums.values())})
    upto = Window.partitionBy(_PART, "__group").orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
    names = {f"__v{i}": name for i, name in enumerate(sums)}
    # the first and the last group of every partition: the only ones that others may have rows of
    ends = rows.groupBy(_PART).agg(F.array_distinct(F.array(F.min_by("__group", _AT), F.max_by("__group", _AT))).alias("e")).select(F.col(_PART).alias("__p"), F.explode("e").alias("__e"))
    of_end = (F.col(_PART) == F.col("__p")) & F.col("__group").eqNullSafe(F.col("__e"))
    parts = rows.join(F.broadcast(ends), of_end).groupBy("__p", "__e").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(v) for v in names])
    before = Window.partitionBy("__e").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__p", "__e", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__b{v}") for v in ("n", *names)])
    out = rows.withColumns({"__n": F.row_number().over(upto)} | {name: F.sum(v).over(upto) for v, name in names.items()})
    out = out.join(F.broadcast(parts), of_end, "left")
    out = out.withColumns({"__n": F.col("__n") + F.coalesce("__bn", F.lit(0))} | {name: F.coalesce(name, F.lit(0)) + F.coalesce(f"__b{v}", F.lit(0)) for v, name in names.items()})
    return out.drop("__group", "__p", "__e", "__bn", *names, *[f"__b{v}" for v in names], _PLACE, _PART, _AT)


def _by_group(df: DataFrame, group: Sequence[str], plain: Callable[[DataFrame], DataFrame], spread: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Groups that fit a task one way, larger ones the other; the same rows either way."""
    usual, hot = _split(df, group)
    return plain(usual) if hot is None else plain(usual).unionByName(spread(hot))


def running_total(df: DataFrame, field: str, group: Sequence[str] = (), order: Order = (), out: str = "RunningTotal") -> DataFrame:
    """Sum of the field up to the row; null where the field is null."""
    value = C.name(field)
    if group:
        rows = df if order else placed(df)
        w = C.ordered(order or [(_PLACE, True)], group).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        plain = lambda x: x.withColumn(out, F.when(value.isNotNull(), F.sum(value).over(w))).drop(_PLACE, _PART, _AT)
        spread = lambda x: _spread(x.drop(_PLACE, _PART, _AT), group, order, {"__upto": value}).withColumn(out, F.when(value.isNotNull(), F.col("__upto"))).drop("__upto", "__n")
        return _by_group(rows, group, plain, spread)
    rows = placed(df, order)
    parts = rows.groupBy(_PART).agg(F.sum(value).alias("n"))
    w = Window.partitionBy(_PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(F.broadcast(_offsets(parts, "n")), _PART)
    return joined.withColumn(out, F.when(value.isNotNull(), F.sum(value).over(w) + F.col("__before"))).drop("__before", _PLACE, _PART, _AT)


def rank(df: DataFrame, field: str, group: Sequence[str] = (), kind: str = "dense", ascending: bool = True, out: str = "Rank") -> DataFrame:
    """``dense``, ``rank`` or ``row`` number by the field; nulls come last."""
    made = {"dense": F.dense_rank, "rank": F.rank, "row": F.row_number}[kind]
    if group:
        window = C.ordered([(field, ascending)], group)
        return _by_group(df, group, lambda x: x.withColumn(out, made().over(window)), lambda x: _ranked(x, field, group, kind, ascending, out))
    if kind == "row":
        return numbered(df, out, [(field, ascending)]).withColumn(out, C.name(out).cast("int"))
    return _ranked(df, field, (), kind, ascending, out)


def _ranked(df: DataFrame, field: str, group: Sequence[str], kind: str, ascending: bool, out: str) -> DataFrame:
    """Ranks of the different values, joined back: a frequent value is one row while ranking."""
    if kind == "row":
        return _spread(df, group, [(field, ascending)]).withColumn(out, F.col("__n").cast("int")).drop("__n")
    keys = {f"__g{i}": C.name(g) for i, g in enumerate(group)} | {"__v": C.name(field)}
    sizes = df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count(F.lit(1)).alias("__size"))
    order, own = [("__v", ascending)], list(keys)[:-1]
    if group:
        ranked = _spread(sizes, own, order, {"__upto": F.col("__size")})
        ranked = ranked.withColumn("__rank", F.col("__n") if kind == "dense" else F.col("__upto") - F.col("__size") + 1)
    elif kind == "dense":
        ranked = numbered(sizes, "__rank", order)
    else:
        ranked = running_total(sizes, "__size", (), order, "__upto").withColumn("__rank", F.col("__upto") - F.col("__size") + 1)
    ranked = ranked.select(*keys, F.col("__rank").cast("int").alias("__r"))
    on = reduce(Column.__and__, [c.eqNullSafe(F.col(k)) for k, c in keys.items()])
    return df.join(ranked, on).withColumn(out, F.col("__r")).drop(*keys, "__r")


def multi_row_formula(df: DataFrame, field: str, text: str, group: Sequence[str] = (), order: Order = (), type_: str | None = None) -> DataFrame:
    """A field from an expression that may refer to other rows, as in ``[Row-1:Total]``.

    Rows beyond the ends of a group are null. An expression that refers to the computed field in the row above is
    evaluated row by row within the group; it then needs a group or takes all rows as one.
    """
    node = X.parse(text)
    if any(isinstance(n, X.Field) and n.row < 0 and n.name == field for n in X.walk(node)):
        return _recursive(df, field, node, group, order)
    return with_rows(df, {field: node}, group, order)


def with_rows(df: DataFrame, made: dict[str, X.Node], group: Sequence[str], order: Order) -> DataFrame:
    shifts = sorted({n.row for node in made.values() for n in X.walk(node) if isinstance(n, X.Field) and n.row})
    if not shifts:
        ctx = C.context(df.schema)
        return df.withColumns({f: C.compile_node(node, ctx).col for f, node in made.items()})
    if not group:
        return _neighbours(df, made, shifts, (), order)
    rows = df if order else placed(df)
    ctx = C.context(df.schema, window=C.ordered(order or [(_PLACE, True)], group))
    plain = lambda x: x.withColumns({f: C.compile_node(node, ctx).col for f, node in made.items()}).drop(_PLACE, _PART, _AT)
    return _by_group(rows, group, plain, lambda x: _neighbours(x.drop(_PLACE, _PART, _AT), made, shifts, group, order))


def _neighbours(df: DataFrame, made: dict[str, X.Node], shifts: Sequence[int], group: Sequence[str], order: Order) -> DataFrame:
    """Other rows by window within a partition; beyond its ends from the first and last rows of the partitions, which are as
    many as the shifts reach, so they are sent to all tasks. Of a group only rows of the same group are neighbours."""
    fields = list(dict.fromkeys(n.name for node in made.values() for n in X.walk(node) if isinstance(n, X.Field) and n.row and n.name in df.columns))
    rows = placed(df, [*((g, True) for g in group), *order] if group else order)
    if not group and not order:  # else they are kept already; places must not change between the sides
        rows = cut(rows)
    parts = rows.groupBy(_PART).agg(F.count(F.lit(1)).alias("__size"))
    parts = F.broadcast(_offsets(parts.withColumnRenamed("__size", "n"), "n").join(parts, _PART))
    rows = rows.join(parts, _PART).withColumn("__row", F.col("__before") + F.col(_AT)).withColumn("__f", F.struct(*[C.name(c) for c in dict.fromkeys([*fields, *group])]))
    reach = max(map(abs, shifts))
    edges = rows.where((F.col(_AT) < reach) | (F.col(_AT) >= F.col("__size") - reach)).select(F.col("__row").alias("__r"), F.col("__f").alias("__e"))
    within = Window.partitionBy(_PART).orderBy(_AT)
    out = rows.withColumns({f"__w{i}": F.lag("__f", -s).over(within) for i, s in enumerate(shifts)})
    for i, s in enumerate(shifts):
        out = out.join(F.broadcast(edges.toDF("__r", f"__e{i}")), F.col("__row") + s == F.col("__r"), "left").drop("__r")
        inside = (F.col(_AT) + s).between(F.lit(0), F.col("__size") - 1)
        other = F.when(inside, F.col(f"__w{i}")).otherwise(F.col(f"__e{i}"))
        same = reduce(Column.__and__, [other[g].eqNullSafe(C.name(g)) for g in group], F.lit(True))
        out = out.withColumn(f"__o{i}", F.when(same, other)).drop(f"__w{i}", f"__e{i}")
    ctx = C.context(df.schema, shifted=lambda c, s: F.col(f"__o{shifts.index(s)}")[c])
    return out.withColumns({f: C.compile_node(node, ctx).col for f, node in made.items()}).select(*[C.name(c) for c in dict.fromkeys([*df.columns, *made])])


#: Rows of a group that are folded before they are put to the rest.
FOLDED = 256


def _recursive(df: DataFrame, field: str, node: X.Node, group: Sequence[str], order: Order) -> DataFrame:
    """A fold over the ordered array of a group, in the JVM, in pieces, so that it costs time in proportion to the rows. The result
    is a number; a group must fit a task, as every row needs the one above."""
    rows = df if order else placed(df)
    keys = order or [(_PLACE, True)]
    window = C.ordered(keys, group)
    need = [n.name for n in X.walk(node) if isinstance(n, X.Field) and not n.row and n.name in df.columns]
    need = list(dict.fromkeys(need))
    numbered_rows = rows.withColumn("__n", F.row_number().over(window))
    item = F.struct(F.col("__n"), *[C.name(c).alias(f"f{i}") for i, c in enumerate(need)])
    groups = numbered_rows.groupBy(*[C.name(g) for g in group]).agg(F.sort_array(F.collect_list(item)).alias("__items"))
    kinds = {f.name: C.kind_of(f.dataType) for f in df.schema} | {field: C.NUM}

    def step(done: Column, at: Column) -> Column:
        refs = {c: at[f"f{i}"] for i, c in enumerate(need)}
        before = F.element_at(done, -1)
        ctx = C.Context(kinds, shifted=lambda c, s: before if (c, s) == (field, -1) else F.lit(None).cast("double"), lookup=refs.__getitem__)
        return F.concat(done, F.array(C.compile_node(node, ctx).col.cast("double")))

    def piece(done: Column, begin: Column) -> Column:
        # a piece starts with the last value before it, which is left out again
        last = F.array(F.when(F.size(done) > 0, F.element_at(F.element_at(done, -1), -1)).cast("double"))
        folded = F.aggregate(F.slice("__items", begin, FOLDED), last, step)
        return F.concat(done, F.array(F.slice(folded, F.lit(2), F.size(folded))))

    pieces = F.aggregate(F.sequence(F.lit(1), F.size("__items"), F.lit(FOLDED)), F.array().cast("array<array<double>>"), piece)
    folded = groups.withColumn("__values", F.flatten(pieces))
    pairs = folded.select(*[C.name(g) for g in group], F.explode(F.arrays_zip(F.col("__items.__n").alias("n"), F.col("__values").alias("v"))).alias("p"))
    pairs = pairs.select(*[C.name(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("p.n").alias("__m"), F.col("p.v").alias("__made"))
    on = F.col("__n") == F.col("__m")
    for i, g in enumerate(group):
        on &= C.name(g).eqNullSafe(F.col(f"__g{i}"))
    joined = numbered_rows.join(pairs, on)
    return joined.withColumn(field, F.col("__made")).select(*[C.name(c) for c in dict.fromkeys([*df.columns, field])])


def select_records(df: DataFrame, ranges: str = "1-100", order: Order = ()) -> DataFrame:
    """Rows by number: ``5``, ``2-4``, ``-10`` (up to) and ``90+`` (from), separated by commas or lines."""
    wanted = F.lit(False)
    at = F.col("__row")
    for part in [p.strip() for p in ranges.replace("\n", ",").split(",") if p.strip()]:
        if part.endswith("+"):
            wanted |= at >= int(part[:-1])
        elif part.startswith("-"):
            wanted |= at <= int(part[1:])
        elif "-" in part:
            lo, hi = part.split("-")
            wanted |= at.between(int(lo), int(hi))
        else:
            wanted |= at == int(part)
    return numbered(df, "__row", order).where(wanted).drop("__row")


def sample(df: DataFrame, mode: str = "first", n: int = 100, pct: float | None = None, group: Sequence[str] = (), order: Order = (), seed: int = 42) -> DataFrame:
    """``first``, ``last``, ``skip`` n, ``one_in`` n, ``random_n``, ``random_pct`` and ``first_pct``, per group if any.

    Random modes are exact in size: rows are ordered by a seeded random number. few first and last rows of an
    ordered frame plan as a top-k, not as a full sort.
    """
    mode = mode.lower()
    keys = sort_columns(order)
    if mode in ("random_n", "random_pct"):
        df = df.withColumn("__r", F.rand(seed))
        count = n if mode == "random_n" else None
        if not group:
            if count is None:
                df = cut(df)
                count = round(df.count() * (pct or 0) / 100)
            return df.orderBy("__r").limit(count).drop("__r")
        order, keys, mode = [("__r", True)], [F.col("__r")], "first" if mode == "random_n" else "first_pct"
    if not group and mode in ("first", "last", "skip"):
        if mode == "first":
            return _first(df, order, n)
        if mode == "skip":  # an offset would bring all rows into one task
            return numbered(df, "__n", order).where(F.col("__n") > n).drop("__n")
        if keys and n <= TOP_ROWS:
            back = [(C.name(c).desc_nulls_first() if up else C.name(c).asc_nulls_first()) for c, up in order]
            return df.orderBy(*back).limit(n).orderBy(*keys)
        df = cut(df) if not keys else df
        return numbered(df, "__n", order).where(F.col("__n") > df.count() - n).drop("__n")
    if not group:
        rows = numbered(df, "__n", order)
        if mode == "one_in":
            return rows.where((F.col("__n") - 1) % n == 0).drop("__n")
        total = df.count()
        return rows.where(F.col("__n") <= F.ceil(F.lit(total) * (pct or 0) / 100)).drop("__n", "__r")
    rows = df if order else placed(df)
    test = {
        "first": lambda: F.col("__n") <= n,
        "last": lambda: F.col("__n") > F.col("__all") - n,
        "skip": lambda: F.col("__n") > n,
        "one_in": lambda: (F.col("__n") - 1) % n == 0,
        "first_pct": lambda: F.col("__n") <= F.ceil(F.col("__all") * (pct or 0) / 100),
    }[mode]()
    needs_size = mode in ("last", "first_pct")

    def plain(x: DataFrame) -> DataFrame:
        x = x.withColumn("__n", F.row_number().over(C.ordered(order or [(_PLACE, True)], group)))
        return x.withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy(*[C.name(g) for g in group]))) if needs_size else x

    def spread(x: DataFrame) -> DataFrame:
        x = _spread(x.drop(_PLACE, _PART, _AT), group, order)
        return _with_totals(x, group, {"__all": F.count(F.lit(1))}) if needs_size else x

    def picked(make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        return lambda x: make(x).where(test).drop("__n", "__all", "__r", _PLACE, _PART, _AT)

    return _by_group(rows, group, picked(plain), picked(spread))


def _with_totals(df: DataFrame, group: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Add aggregates of the row's group, combined before they are shuffled."""
    sums = df.groupBy(*[C.name(g).alias(f"__g{i}") for i, g in enumerate(group)]).agg(*[c.alias(k) for k, c in totals.items()])
    on = reduce(Column.__and__, [C.name(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)])
    return df.join(sums, on).drop(*[f"__g{i}" for i in range(len(group))])


def _first(df: DataFrame, order: Order, n: int) -> DataFrame:
    """The first rows: as a top-k, which one task merges, as long as they are few, else by number."""
    if order and n > TOP_ROWS:
        return numbered(df, "__n", order).where(F.col("__n") <= n).drop("__n")
    return (df.orderBy(*sort_columns(order)) if order else df).limit(n)


def unique(df: DataFrame, fields: Sequence[str] = (), order: Order = ()) -> dict[str, DataFrame]:
    """``Unique``: the first row of every key, ``Duplicates``: the others; nulls are equal. No fields: all fields.

    The first rows come from an aggregate with map-side combine, whatever one key holds."""
    keys = [C.name(f) for f in (fields or df.columns)]
    rows = placed(df)
    by = sort_key(rows, order, F.col(_PLACE))
    if by is not None and all(not isinstance(f.dataType, (T.MapType, T.VariantType)) for f in df.schema):
        first = rows.groupBy(*keys).agg(F.min_by(F.struct(*[C.name(c) for c in df.columns], F.col(_PLACE)), by).alias("__first"))
        unique_rows = first.select("__first.*").drop(_PLACE)
        names = list(fields or df.columns)
        by_place = Window.partitionBy(*keys).orderBy(*sort_columns(order), F.col(_PLACE))
        # numbered in one pass: places are not compared between two readings of the rows, which may come in another order
        plain = lambda x: x.withColumn("__n", F.row_number().over(by_place)).drop(_PLACE, _PART, _AT)
        numbers = _by_group(rows, names, plain, lambda x: _spread(x.drop(_PLACE, _PART, _AT), names, order))
        return {"Unique": unique_rows, "Duplicates": numbers.where("__n > 1").drop("__n")}
    w = Window.partitionBy(*keys).orderBy(*sort_columns(order), F.col(_PLACE))
    ranked = rows.withColumn("__n", F.row_number().over(w))
    drop = ("__n", _PLACE, _PART, _AT)
    return {"Unique": ranked.where("__n = 1").drop(*drop), "Duplicates": ranked.where("__n > 1").drop(*drop)}


def create_samples(df: DataFrame, estimation: float = 60, validation: float = 20, seed: int = 42) -> dict[str, DataFrame]:
    """Three disjoint parts that make up the whole, by a seeded hash of the row's place: nothing is shuffled."""
    rows = placed(df).withColumn("__b", F.pmod(F.xxhash64(F.col(_PLACE), F.lit(seed)), F.lit(10_000)) / 100.0)
    clean = lambda x: x.drop("__b", _PLACE, _PART, _AT)
    return {
        "Estimation": clean(rows.where(F.col("__b") < estimation)),
        "Validation": clean(rows.where((F.col("__b") >= estimation) & (F.col("__b") < estimation + validation))),
        "Holdout": clean(rows.where(F.col("__b") >= estimation + validation)),
    }


def random_percent(df: DataFrame, pct: float = 10, seed: int = 42) -> DataFrame:
    """Every row with the same chance, in one pass."""
    return df.sample(fraction=pct / 100, seed=seed)


def tile(df: DataFrame, field: str, tiles: int = 4, group: Sequence[str] = (), method: str = "equal_records", out: str = "Tile_Num") -> DataFrame:
    """``equal_records`` (sizes differ by one at most), ``equal_sum``, ``unique_value`` or ``width`` tiles from 1."""
    if method == "unique_value":
        return rank(df, field, group, "dense", True, out)
    value = C.name(field)
    if method == "width":
        ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
        if ends["lo"] is None:
            return df.withColumn(out, F.lit(None).cast("int"))
        step = (ends["hi"] - ends["lo"]) / tiles or 1
        return df.withColumn(out, F.when(value.isNotNull(), F.least(F.floor((value - ends["lo"]) / step) + 1, F.lit(tiles))).cast("int"))
    if group:
        by_value = C.ordered([(field, True)], group)
        order = [(field, True)]
        whole = Window.partitionBy(*[C.name(g) for g in group])
        if method == "equal_sum":
            tile_of = lambda upto, total: F.least(F.greatest(F.ceil(upto * tiles / total), F.lit(1)), F.lit(tiles)).cast("int")
            plain = lambda x: x.withColumn(out, tile_of(F.sum(value).over(by_value.rowsBetween(Window.unboundedPreceding, 0)), F.sum(value).over(whole)))
            spread = lambda x: _with_totals(_spread(x, group, order, {"__upto": value}), group, {"__sum": F.sum(value)}).withColumn(out, tile_of(F.col("__upto"), F.col("__sum"))).drop("__upto", "__sum", "__n")
            return _by_group(df, group, plain, spread)

        def by_number(x: DataFrame) -> DataFrame:
            x = _with_totals(_spread(x, group, order), group, {"__all": F.count(F.lit(1))})
            size, more, at = F.floor(F.col("__all") / tiles), F.col("__all") % tiles, F.col("__n") - 1
            number = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1))))
            return x.withColumn(out, (number + 1).cast("int")).drop("__all", "__n")

        return _by_group(df, group, lambda x: x.withColumn(out, F.ntile(tiles).over(by_value)), by_number)
    if method == "equal_sum":
        total = df.agg(F.sum(value).alias("s")).first()["s"] or 1
        rows = running_total(df, field, (), [(field, True)], "__upto")
        return rows.withColumn(out, F.least(F.greatest(F.ceil(F.col("__upto") * tiles / total), F.lit(1)), F.lit(tiles)).cast("int")).drop("__upto")
    n = df.count()
    size, more = divmod(n, tiles)
    at = F.col("__n") - 1
    number = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / max(size, 1)))
    return numbered(df, "__n", [(field, True)]).withColumn(out, (number + 1).cast("int")).drop("__n")
