"""Expressions to Spark columns.

Logic has two values: a comparison with a null is false, ``<>`` with a null is true, so NOT and the false
output of a filter are exact complements. Nulls propagate through arithmetic and text functions. Nothing
throws for bad data: casts, divisions and dates that fail give null. All columns are built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from weftline.functions import expression as X

NUM, STR, BOOL, DATE, NULL, OTHER = "num", "str", "bool", "date", "null", "other"


def name(column: str) -> Column:
    """A column by its exact name."""
    return F.col("`" + column.replace("`", "``") + "`")


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return NUM
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return STR
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    return NULL if isinstance(t, T.NullType) else OTHER


@dataclass(frozen=True)
class Value:
    col: Column
    kind: str
    literal: object = None


@dataclass
class Context:
    """What an expression is compiled against: the kinds of the fields, and the rows' order for references to other rows."""

    kinds: dict[str, str]
    window: WindowSpec | None = None
    diagnostics: list[tuple[str, str]] = field(default_factory=list)
    current: str | None = None  # what [_CurrentField_] stands for
    where: bool = False  # leave plain comparisons: only for use in a WHERE without negation
    shifted: Callable[[str, int], Column] | None = None  # fields of other rows
    lookup: Callable[[str], Column] = lambda column: name(column)  # fields of the row itself

    def say(self, category: str, message: str) -> None:
        if (category, message) not in self.diagnostics:
            self.diagnostics.append((category, message))


def context(schema: T.StructType, **more: object) -> Context:
    return Context({f.name: kind_of(f.dataType) for f in schema}, **more)


# --- text helpers shared with operators -------------------------------------------------------------


def strip(c: Column) -> Column:
    """Without any Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def title(c: Column) -> Column:
    """A capital after every character that is no letter, the rest small."""
    parts = F.split(F.regexp_replace(F.lower(c), r"(?U)(?<=\p{L})(?!\p{L})|(?<!\p{L})(?=\p{L})", "\x00"), "\x00")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


# Strftime codes and their patterns.
_STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "B": "MMMM", "b": "MMM",
    "A": "EEEE", "a": "EEE", "j": "DDD", "f": "SSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "e": "d",
}


def java_pattern(strftime: str) -> str:
    """A strftime format as a Spark date pattern; texts without ``%`` are taken as patterns already."""
    if "%" not in strftime:
        return strftime
    out = ""
    for m in re.finditer(r"%(-?.)|([^%]+)", strftime):
        code, text = m.groups()
        if code:
            out += "%" if code == "%" else _STRFTIME.get(code.lstrip("-"), "")
        else:
            out += re.sub(r"[A-Za-z]+", lambda x: f"'{x.group()}'", text.replace("'", "''"))
    return out


def to_timestamp(v: Value) -> Column:
    return v.col.cast("timestamp_ntz") if v.kind == DATE else F.expr("null").cast("timestamp_ntz") if v.kind == NULL else v.col.cast("string").try_cast("timestamp_ntz")


# --- compiler ---------------------------------------------------------------------------------------


def compile_text(text: str, ctx: Context) -> Value:
    """ExpressionError if the text cannot be read."""
    return compile_node(X.parse(text), ctx)


def compile_node(node: X.Node, ctx: Context) -> Value:
    match node:
        case X.Literal(value):
            if value is None:
                return Value(F.lit(None), NULL)
            return Value(F.lit(value), BOOL if isinstance(value, bool) else STR if isinstance(value, str) else NUM, value)
        case X.Field(column, row):
            column = ctx.current if column == "_CurrentField_" and ctx.current else column
            if column not in ctx.kinds:
                ctx.say("unresolved_field", f"there is no field {column}")
                return Value(F.lit(None), NULL)
            return Value(_shifted(column, row, ctx) if row else ctx.lookup(column), ctx.kinds[column])
        case X.Unary("-", operand):
            return Value(-_number(compile_node(operand, ctx)), NUM)
        case X.Unary("not", operand):
            return Value(~truth(compile_node(operand, ctx)), BOOL)
        case X.Binary(("and" | "or") as op, a, b):
            x, y = truth(compile_node(a, ctx)), truth(compile_node(b, ctx))
            return Value(x & y if op == "and" else x | y, BOOL)
        case X.Binary(("+" | "-" | "*" | "/" | "%") as op, a, b):
            return _arithmetic(op, compile_node(a, ctx), compile_node(b, ctx), ctx)
        case X.Binary(op, a, b):
            return _comparison(op, compile_node(a, ctx), compile_node(b, ctx), ctx)
        case X.In(value, options):
            v = compile_node(value, ctx)
            hits = [_comparison("=", v, compile_node(o, ctx), ctx).col for o in options]
            if v.kind in (NUM, STR) and options and all(isinstance(o, X.Literal) and compile_node(o, ctx).kind == v.kind for o in options):
                plain = v.col.isin([o.value for o in options])
                return Value(plain if ctx.where else F.coalesce(plain, F.lit(False)), BOOL)
            out = F.lit(False)
            for h in hits:
                out = out | h
            return Value(out, BOOL)
        case X.If(branches, otherwise):
            return _choice([(truth(compile_node(c, ctx)), compile_node(v, ctx)) for c, v in branches], compile_node(otherwise, ctx), ctx)
        case X.Call(function, args):
            made = _FUNCTIONS.get(function)
            if made is None:
                ctx.say("unsupported_function", f"there is no function {function}")
                return Value(F.lit(None), NULL)
            least, most, build = made
            if not least <= len(args) <= most:
                raise X.ExpressionError(f"{function} takes {least} to {most} arguments, not {len(args)}")
            return build(ctx, *[compile_node(a, ctx) for a in args])
    raise X.ExpressionError(f"unknown node {node}")


def truth(v: Value) -> Column:
    """A condition without nulls; only a true boolean is true."""
    if v.kind == NULL:
        return F.lit(False)
    if v.kind == NUM:
        return F.coalesce(v.col != 0, F.lit(False))
    return F.coalesce(v.col if v.kind == BOOL else v.col.cast("string").try_cast("boolean"), F.lit(False))


def _shifted(column: str, row: int, ctx: Context) -> Column:
    if ctx.shifted is not None:
        return ctx.shifted(column, row)
    if ctx.window is None:
        raise X.ExpressionError("a reference to another row needs an order of rows")
    return F.lag(name(column), -row).over(ctx.window) if row < 0 else F.lead(name(column), row).over(ctx.window)


def _number(v: Value) -> Column:
    if v.kind in (NUM, NULL):
        return v.col if v.kind == NUM else F.lit(None).cast("double")
    return v.col.cast("int") if v.kind == BOOL else v.col.try_cast("double")


def _text(v: Value) -> Column:
    return v.col if v.kind == STR else v.col.cast("string")


def _arithmetic(op: str, a: Value, b: Value, ctx: Context) -> Value:
    if op == "+" and STR in (a.kind, b.kind):
        return Value(F.concat(_text(a), _text(b)), STR)
    x, y = _number(a), _number(b)
    if op == "/":
        return Value(F.try_divide(x.cast("double"), y.cast("double")), NUM)
    if op == "%":  # the sign of the divisor
        return Value(x - y * F.floor(F.try_divide(x.cast("double"), y.cast("double"))), NUM)
    return Value(x + y if op == "+" else x - y if op == "-" else x * y, NUM)


def _comparison(op: str, a: Value, b: Value, ctx: Context) -> Value:
    if NULL in (a.kind, b.kind):
        return Value(F.lit(op == "<>"), BOOL)
    x, y = a.col, b.col
    if a.kind != b.kind:
        kinds = {a.kind, b.kind}
        if DATE in kinds and STR in kinds:
            x, y = to_timestamp(a), to_timestamp(b)
        elif kinds == {NUM, STR}:
            ctx.say("type_mismatch", "a number is compared with a text")
            x, y = _number(a), _number(b)
        else:
            x, y = _text(a), _text(b)
    made = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    if ctx.where and op != "<>":
        return Value(made, BOOL)
    return Value(F.coalesce(made, F.lit(op == "<>")), BOOL)


def _unified(values: Sequence[Value], ctx: Context) -> tuple[list[Column], str]:
    kinds = {v.kind for v in values} - {NULL}
    if len(kinds) <= 1:
        return [v.col for v in values], next(iter(kinds), NULL)
    ctx.say("type_mismatch", "branches of different types become text")
    return [_text(v) for v in values], STR


def _choice(branches: list[tuple[Column, Value]], otherwise: Value, ctx: Context) -> Value:
    cols, kind = _unified([*(v for _, v in branches), otherwise], ctx)
    out = None
    for (condition, _), c in zip(branches, cols, strict=False):
        out = F.when(condition, c) if out is None else out.when(condition, c)
    return Value(out.otherwise(cols[-1]), kind)


def _is_null(v: Value) -> Column:
    return v.col.isNull() | F.isnan(v.col.cast("double")) if v.kind == NUM else v.col.isNull()


def _side(ctx: Context, s: Value, n: Value, *, left: bool) -> Value:
    text, k = _text(s), _number(n).cast("int")
    size = F.length(text)
    if left:  # negative counts leave off the end
        return Value(F.substring(text, F.lit(1), F.when(k >= 0, k).otherwise(F.greatest(size + k, F.lit(0)))), STR)
    # right with 0 is the whole text, a negative count leaves off the start
    start = F.when(k > 0, F.greatest(size - k + 1, F.lit(1))).otherwise(-k + 1)
    return Value(F.substring(text, start, F.lit(1 << 30)), STR)


def _substring(ctx: Context, s: Value, start: Value, length: Value | None = None) -> Value:
    return Value(F.substring(_text(s), _number(start).cast("int"), _number(length).cast("int") if length else F.lit(1 << 30)), STR)


def _literal_replace(ctx: Context, s: Value, old: Value, new: Value) -> Value:
    return Value(F.replace(_text(s), _text(old), _text(new)), STR)


def _extreme(best: Callable[..., Column]) -> Callable[..., Value]:
    def build(ctx: Context, a: Value, b: Value, *_: Value) -> Value:
        x, y = (_text(a), _text(b)) if STR in (a.kind, b.kind) else (a.col, b.col)
        return Value(F.when(x.isNotNull() & y.isNotNull(), best(x, y)), STR if STR in (a.kind, b.kind) else a.kind)

    return build


def _round(ctx: Context, x: Value, digits: Value | None = None) -> Value:
    if digits is None:
        return Value(F.bround(_number(x)), NUM)
    return Value(F.bround(_number(x), digits.col), NUM)


# Units of date functions; what isn't here counts as days in differences.
_DIFF = {
    "days": 86_400e6, "day": 86_400e6, "d": 86_400e6, "hours": 3_600e6, "hour": 3_600e6, "h": 3_600e6, "minutes": 60e6, "minute": 60e6, "m": 60e6,
    "seconds": 1e6, "second": 1e6, "s": 1e6, "years": 365.25 * 86_400e6, "year": 365.25 * 86_400e6, "y": 365.25 * 86_400e6,
    "months": 30.4375 * 86_400e6, "month": 30.4375 * 86_400e6,
}
_ADD = {"days": "DAY", "hours": "HOUR", "minutes": "MINUTE", "seconds": "SECOND", "months": "MONTH", "years": "YEAR", "weeks": "WEEK"}


def _unit(unit: Value | None) -> str:
    return str(unit.literal).strip().lower() if unit is not None else "days"


def _date_diff(ctx: Context, a: Value, b: Value, unit: Value | None = None) -> Value:
    u = _unit(unit)
    micros = F.timestamp_diff("MICROSECOND", to_timestamp(b), to_timestamp(a)).cast("double")
    size = _DIFF.get(u, _DIFF["days"])
    return Value(F.floor(micros / size).cast("double") if size == _DIFF["days"] else micros / size, NUM)


def _date_add(ctx: Context, d: Value, n: Value, unit: Value | None = None) -> Value:
    u = _unit(unit)
    step = _ADD.get(u) or _ADD.get(u + "s")
    if step is None:
        ctx.say("unknown_unit", f"{u} counts as days")
    return Value(F.timestamp_add(step or "DAY", _number(n).cast("int"), to_timestamp(d)), DATE)


def _date_format(ctx: Context, d: Value, fmt: Value) -> Value:
    return Value(F.date_format(to_timestamp(d), java_pattern(str(fmt.literal))), STR)


def _to_integer(ctx: Context, s: Value) -> Value:
    x = _number(s).cast("double")
    return Value(F.when(x == F.floor(x), x.try_cast("bigint")), NUM)


def _text_fn(f: Callable[[Column], Column]) -> tuple:
    return 1, 1, lambda ctx, s: Value(f(_text(s)), STR)


def _num_fn(f: Callable[[Column], Column]) -> tuple:
    return 1, 1, lambda ctx, x: Value(F.nanvl(f(_number(x)).cast("double"), F.lit(None).cast("double")), NUM)


_TRUE_OR_FALSE = lambda c: F.coalesce(c, F.lit(False))

_FUNCTIONS: dict[str, tuple[int, int, Callable[..., Value]]] = {
    # null and conditional
    "null": (0, 0, lambda ctx: Value(F.lit(None), NULL)),
    "isnull": (1, 1, lambda ctx, v: Value(_is_null(v), BOOL)),
    "isnotnull": (1, 1, lambda ctx, v: Value(~_is_null(v), BOOL)),
    "isempty": (1, 1, lambda ctx, v: Value(_TRUE_OR_FALSE(_text(v) == ""), BOOL)),
    "iif": (2, 3, lambda ctx, c, a, b=None: _choice([(truth(c), a)], b or Value(F.lit(None), NULL), ctx)),
    "coalesce": (1, 99, lambda ctx, *vs: (lambda u: Value(F.coalesce(*u[0]), u[1]))(_unified(vs, ctx))),
    "ifnull": (2, 99, lambda ctx, *vs: (lambda u: Value(F.coalesce(*u[0]), u[1]))(_unified(vs, ctx))),
    # text
    "trim": _text_fn(strip),
    "trimleft": _text_fn(lambda c: F.regexp_replace(c, r"(?U)^\s+", "")),
    "ltrim": _text_fn(lambda c: F.regexp_replace(c, r"(?U)^\s+", "")),
    "trimright": _text_fn(lambda c: F.regexp_replace(c, r"(?U)\s+$", "")),
    "rtrim": _text_fn(lambda c: F.regexp_replace(c, r"(?U)\s+$", "")),
    "length": (1, 1, lambda ctx, s: Value(F.length(_text(s)), NUM)),
    "uppercase": _text_fn(F.upper),
    "lowercase": _text_fn(F.lower),
    "titlecase": _text_fn(title),
    "reversestring": _text_fn(F.reverse),
    "contains": (2, 2, lambda ctx, s, p: Value(_TRUE_OR_FALSE(F.rlike(_text(s), _text(p))), BOOL)),
    "startswith": (2, 2, lambda ctx, s, p: Value(_TRUE_OR_FALSE(F.startswith(_text(s), _text(p))), BOOL)),
    "endswith": (2, 2, lambda ctx, s, p: Value(_TRUE_OR_FALSE(F.endswith(_text(s), _text(p))), BOOL)),
    "left": (2, 2, lambda ctx, s, n: _side(ctx, s, n, left=True)),
    "right": (2, 2, lambda ctx, s, n: _side(ctx, s, n, left=False)),
    "substring": (2, 3, _substring),
    "mid": (2, 3, _substring),
    "replace": (3, 3, _literal_replace),
    "replacefirst": (3, 3, _literal_replace),
    "findstring": (2, 2, lambda ctx, s, t: Value(F.position(_text(t), _text(s)) - 1, NUM)),
    "padleft": (3, 3, lambda ctx, s, n, p: Value(F.call_function("lpad", _text(s), _number(n).cast("int"), _text(p)), STR)),
    "padright": (3, 3, lambda ctx, s, n, p: Value(F.call_function("rpad", _text(s), _number(n).cast("int"), _text(p)), STR)),
    "regex_match": (2, 2, lambda ctx, s, p: Value(_TRUE_OR_FALSE(F.rlike(_text(s), F.concat(F.lit("^(?:"), _text(p), F.lit(")$")))), BOOL)),
    "regex_replace": (3, 3, lambda ctx, s, p, r: Value(F.regexp_replace(_text(s), _text(p), _text(r)), STR)),
    "regex_countmatches": (2, 2, lambda ctx, s, p: Value(F.regexp_count(_text(s), _text(p)), NUM)),
    "getword": (2, 2, lambda ctx, s, n: Value(F.get(F.split(_text(s), " "), _number(n).cast("int")), STR)),
    "countwords": (1, 1, lambda ctx, s: Value(F.size(F.filter(F.split(_text(s), r"\s+"), lambda w: w != "")), NUM)),
    "tostring": (1, 1, lambda ctx, v: Value(_text(v), STR)),
    "tonumber": (1, 1, lambda ctx, v: Value(v.col.cast("double") if v.kind in (NUM, BOOL, NULL) else v.col.try_cast("double"), NUM)),
    "tointeger": (1, 1, _to_integer),
    # numbers
    "abs": (1, 1, lambda ctx, x: Value(F.abs(_number(x)), NUM)),
    "round": (1, 2, _round),
    "ceil": _num_fn(F.ceil),
    "floor": _num_fn(F.floor),
    "pow": (2, 2, lambda ctx, a, b: Value(F.pow(_number(a), _number(b)), NUM)),
    "log": _num_fn(F.ln),
    "log10": _num_fn(F.log10),
    "exp": _num_fn(F.exp),
    "sqrt": _num_fn(F.sqrt),
    "mod": (2, 2, lambda ctx, a, b: _arithmetic("%", a, b, ctx)),
    "min": (2, 99, _extreme(F.least)),
    "max": (2, 99, _extreme(F.greatest)),
    # dates
    "datetimetoday": (0, 0, lambda ctx: Value(F.current_date(), DATE)),
    "datetimenow": (0, 0, lambda ctx: Value(F.localtimestamp(), DATE)),
    "datetimediff": (2, 3, _date_diff),
    "datetimeadd": (2, 3, _date_add),
    "datetimeformat": (2, 2, _date_format),
    "datetimeyear": (1, 1, lambda ctx, d: Value(F.year(to_timestamp(d)), NUM)),
    "datetimemonth": (1, 1, lambda ctx, d: Value(F.month(to_timestamp(d)), NUM)),
    "datetimeday": (1, 1, lambda ctx, d: Value(F.dayofmonth(to_timestamp(d)), NUM)),
}


def functions() -> list[str]:
    return sorted(_FUNCTIONS)


def predicate(text: str, schema: T.StructType, window: WindowSpec | None = None) -> tuple[Column, Column, list[tuple[str, str]]]:
    """(condition without nulls, an equal one for a WHERE, diagnostics). The second leaves comparisons plain where no
    negation needs them whole, so that they reach the scan."""
    node = X.parse(text)
    ctx = context(schema, window=window)
    exact = truth(compile_node(node, ctx))
    negated = any(isinstance(n, X.If | X.Call) or (isinstance(n, X.Unary) and n.op == "not") or (isinstance(n, X.Binary) and n.op == "<>") for n in X.walk(node))
    boolean = isinstance(node, X.In) or isinstance(node, X.Binary) and node.op not in ("+", "-", "*", "/", "%")
    if negated or not boolean:
        return exact, exact, ctx.diagnostics
    return exact, _plain(node, context(schema, window=window, where=True)), ctx.diagnostics


def _plain(node: X.Node, ctx: Context) -> Column:
    if isinstance(node, X.Binary) and node.op in ("and", "or"):
        a, b = _plain(node.left, ctx), _plain(node.right, ctx)
        return a & b if node.op == "and" else a | b
    v = compile_node(node, ctx)
    return v.col if v.kind == BOOL else truth(v)


def ordered(order: Sequence[tuple[str, bool]], group: Sequence[str] = ()) -> WindowSpec:
    spec = Window.partitionBy(*[name(g) for g in group])
    return spec.orderBy(*[(name(c).asc_nulls_last() if up else name(c).desc_nulls_last()) for c, up in order])
