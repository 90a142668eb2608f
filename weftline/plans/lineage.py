"""Field lineage: for every field of a stream, the source fields it comes from and how."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

DIRECT, RENAME, JOIN, DERIVED, AGGREGATION, PIVOT = "Direct", "Rename", "Join", "Derived Calculation", "Aggregation", "Pivot / Reshape"


@dataclass(frozen=True)
class Origin:
    table: str
    field: str
    kind: str = DIRECT


Origins = dict[str, tuple[Origin, ...]]


def _merged(groups: Iterable[Sequence[Origin]]) -> tuple[Origin, ...]:
    """Each source field once, as it is first met."""
    found: dict[tuple[str, str], Origin] = {}
    for o in (o for g in groups for o in g):
        found.setdefault((o.table, o.field), o)
    return tuple(found.values())


def direct(columns: Iterable[str], table: str) -> Origins:
    return {c: (Origin(table, c),) for c in columns}


def carried(columns: Iterable[str], inputs: Sequence[Origins]) -> Origins:
    """By name, merged over all inputs."""
    return {c: _merged(i.get(c, ()) for i in inputs) for c in columns}


def renamed(columns: Iterable[str], old_by_new: Mapping[str, str], origins: Origins) -> Origins:
    out = {}
    for c in columns:
        old = old_by_new.get(c, c)
        out[c] = tuple(replace(o, kind=RENAME) if old != c and o.kind == DIRECT else o for o in origins.get(old, ()))
    return out


def derived(fields: Sequence[str], origins: Origins, name: str) -> tuple[Origin, ...]:
    return tuple(replace(o, kind=DERIVED) for o in _merged(origins.get(f, ()) for f in fields))


def joined(columns: Iterable[str], left: Origins, right: Origins) -> Origins:
    out = {}
    for c in columns:
        if c in left:
            out[c] = left[c]
        else:
            base = c if c in right else c.removesuffix("_right")
            out[c] = tuple(replace(o, kind=JOIN) if o.kind == DIRECT else o for o in right.get(base, ()))
    return out


def summarized(columns: Iterable[str], fields: Mapping[str, tuple[str, bool]], origins: Origins) -> Origins:
    out = {}
    for c in columns:
        field, is_key = fields.get(c, (c, True))
        out[c] = tuple(o if is_key and o.kind == DERIVED else replace(o, kind=AGGREGATION) for o in origins.get(field, ()))
    return out


def pivoted(columns: Iterable[str], keys: Sequence[str], from_fields: Sequence[str], origins: Origins) -> Origins:
    made = tuple(replace(o, kind=PIVOT) for o in _merged(origins.get(f, ()) for f in from_fields))
    return {c: origins.get(c, ()) if c in keys else made for c in columns}
