"""Types that drift, folded to one that holds all their values.

A ``Seen`` is what has been met of a field: exact numbers by digits before and behind the point, floats by their
bits, dates and times, arrays, maps and structs by what has been met inside. Two of them are folded part by
part, by greatest value or union, so the result does not depend on the order or the grouping of the files; only
the order of fields does, which is that of their first appearance. The type is made of what was met in the end.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
_WHOLE = ((3, T.ByteType), (5, T.ShortType), (10, T.IntegerType), (19, T.LongType))
_TIMES = {T.DateType: 1, T.TimestampType: 2, T.TimestampNTZType: 4}
#: Most digits of a decimal; beyond them numbers become doubles, as do decimals and long integers that meet floats.
MOST_DIGITS = 38


@dataclass(frozen=True)
class Seen:
    #: Digits before and behind the point of exact numbers, and whether any was a decimal.
    before: int = 0
    behind: int = 0
    decimal: bool = False
    #: Bits of the widest float.
    bits: int = 0
    times: int = 0
    plain: frozenset[str] = frozenset()
    items: Seen | None = None
    keys: Seen | None = None
    values: Seen | None = None
    fields: dict[str, Seen] | None = field(default=None, hash=False)

    @classmethod
    def of(cls, kind: T.DataType) -> Seen:
        if isinstance(kind, T.NullType):
            return cls()
        if type(kind) in _DIGITS:
            return cls(before=_DIGITS[type(kind)])
        if isinstance(kind, T.DecimalType):
            return cls(before=kind.precision - kind.scale, behind=kind.scale, decimal=True)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return cls(bits=24 if isinstance(kind, T.FloatType) else 53)
        if type(kind) in _TIMES:
            return cls(times=_TIMES[type(kind)])
        if isinstance(kind, T.ArrayType):
            return cls(items=cls.of(kind.elementType))
        if isinstance(kind, T.MapType):
            return cls(keys=cls.of(kind.keyType), values=cls.of(kind.valueType))
        if isinstance(kind, T.StructType):
            return cls(fields={f.name: cls.of(f.dataType) for f in kind})
        if isinstance(kind, T.StringType):
            kind = T.StringType()
        return cls(plain=frozenset([kind.json()]))

    def __or__(self, other: Seen) -> Seen:
        inner = lambda a, b: b if a is None else a if b is None else a | b
        fields = None
        if self.fields is not None or other.fields is not None:
            mine, theirs = self.fields or {}, other.fields or {}
            fields = {n: inner(mine.get(n), theirs.get(n)) for n in [*mine, *(n for n in theirs if n not in mine)]}
        return Seen(
            max(self.before, other.before), max(self.behind, other.behind), self.decimal or other.decimal, max(self.bits, other.bits), self.times | other.times,
            self.plain | other.plain, inner(self.items, other.items), inner(self.keys, other.keys), inner(self.values, other.values), fields,
        )

    def _number(self) -> T.DataType:
        if self.bits:
            # a float holds integers of five digits, a double is what holds the rest best
            small = self.bits == 24 and not self.decimal and self.before <= 5
            return T.FloatType() if small else T.DoubleType()
        if not self.decimal:
            return next(kind() for digits, kind in _WHOLE if self.before <= digits)
        total = self.before + self.behind
        return T.DecimalType(total, self.behind) if total <= MOST_DIGITS else T.DoubleType()

    def type(self) -> T.DataType:
        """The least type for all: text where kinds are mixed or nothing was met."""
        made: list[T.DataType] = []
        if self.before or self.behind or self.bits or self.decimal:
            made.append(self._number())
        if self.times:
            made.append(T.DateType() if self.times == 1 else T.TimestampType() if self.times & 2 else T.TimestampNTZType())
        made += [T._parse_datatype_json_string(p) for p in sorted(self.plain)]
        if self.items is not None:
            made.append(T.ArrayType(self.items.type()))
        if self.keys is not None:
            made.append(T.MapType(self.keys.type(), self.values.type()))
        if self.fields is not None:
            made.append(T.StructType([T.StructField(n, s.type()) for n, s in self.fields.items()]))
        return made[0] if len(made) == 1 else T.StringType()

    def same(self, other: Seen) -> bool:
        """Equal but for the order of fields."""
        return replace(self, fields=None) == replace(other, fields=None) and dict(self.fields or {}) == dict(other.fields or {})


def conform(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value of one type as one of a type that was folded from it; fields go by name, nested values become JSON as text."""
    if have == want:
        return c
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        own = {f.name: f.dataType for f in have}
        made = F.struct(*[(conform(c.getField(f.name), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])
        return F.when(c.isNotNull(), made)
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(c, lambda x: conform(x, have.elementType, want.elementType))
    if isinstance(want, T.MapType) and isinstance(have, T.MapType):
        return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(conform(e["key"], have.keyType, want.keyType), conform(e["value"], have.valueType, want.valueType))))
    if isinstance(want, T.StringType) and isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast(want)
