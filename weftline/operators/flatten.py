"""Nested documents as flat tables that keep parent-child links.

A column of XML or JSON texts is decoded batch by batch into flat node buffers (record offsets, parent
index, tag code, place) and from there on handled column-wise: sibling places by a ranking kernel over
(parent, tag), paths level by level by taking the parents' paths through the parent index, keys by one
take through the record index. ``explode_arrays`` does the same for columns that are nested already,
straight from Arrow's list offsets.

Scale: one pass over the scan without any shuffle. Texts are decoded and rows are sent in parts of bounded size, and of
the paths of a part one level is kept, so the memory follows the longest text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.parsers import expat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import ship

_LOOKS_NESTED = re.compile(r'\s*[\[{"]')
_NO_CONSTANT = json.JSONDecoder(parse_constant=lambda s: (_ for _ in ()).throw(ValueError(s)))


class Nodes:
    """Node buffers of a batch. ``place`` is -1 where it is still to be ranked."""

    def __init__(self) -> None:
        self.record: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.label: list[str] = []

    def __len__(self) -> int:
        return len(self.parent)

    def cut_to(self, n: int) -> None:
        del self.record[n:], self.parent[n:], self.depth[n:], self.label[n:]


def read_xml(texts: list[str | None], nodes: Nodes) -> None:
    """Append the elements of every well-formed text; a text that isn't leaves nothing."""
    parent, depth, label, record = nodes.parent, nodes.depth, nodes.label, nodes.record
    open_nodes: list[int] = []
    at = 0

    def start(name: str, _attrs: list) -> None:
        level = len(open_nodes)
        parent.append(open_nodes[-1] if level else -1)
        depth.append(level)
        label.append(name)
        record.append(at)
        open_nodes.append(len(parent) - 1)

    def end(_name: str) -> None:
        open_nodes.pop()

    for at, text in enumerate(texts):
        if not text:
            continue
        before = len(parent)
        parser = expat.ParserCreate()
        parser.ordered_attributes = True
        parser.StartElementHandler, parser.EndElementHandler = start, end
        try:
            parser.Parse(text, True)
        except (expat.ExpatError, UnicodeEncodeError):
            nodes.cut_to(before)
        open_nodes.clear()


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_LITERALS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def decode(text: str) -> object:
    """The value of a JSON text; ValueError if it isn't valid."""
    try:
        return _NO_CONSTANT.decode(text)
    except RecursionError:
        return _decode_deep(text)


def _decode_deep(s: str) -> object:
    """The same without recursion, for texts nested deeper than the C parser goes."""
    open_: list[tuple[dict | list, str | None]] = []

    def skip(i: int) -> int:
        return _SPACE.match(s, i).end()

    def member(i: int) -> tuple[str, int]:
        """Key and place of its value."""
        i = skip(i)
        if s[i : i + 1] != '"':
            raise ValueError("a key is missing")
        key, i = json.decoder.scanstring(s, i + 1, True)
        i = skip(i)
        if s[i : i + 1] != ":":
            raise ValueError("a colon is missing")
        return key, skip(i + 1)

    i = skip(0)
    while True:
        c = s[i : i + 1]
        if c in ("{", "["):
            inner = skip(i + 1)
            value: object = {} if c == "{" else []
            if s[inner : inner + 1] != ("}" if c == "{" else "]"):
                key, i = member(inner) if c == "{" else (None, inner)
                open_.append((value, key))
                continue
            i = inner + 1
        elif c == '"':
            value, i = json.decoder.scanstring(s, i + 1, True)
        elif c in _LITERALS and s.startswith(_LITERALS[c][0], i):
            value, i = _LITERALS[c][1], i + len(_LITERALS[c][0])
        elif number := _NUMBER.match(s, i):
            value, i = number.group(), number.end()
        else:
            raise ValueError("a value is missing")
        while True:
            i = skip(i)
            if not open_:
                if i != len(s):
                    raise ValueError("something follows the value")
                return value
            holder, key = open_[-1]
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            c = s[i : i + 1]
            if c == ",":
                if isinstance(holder, dict):
                    key, i = member(i + 1)
                    open_[-1] = (holder, key)
                else:
                    i = skip(i + 1)
                break
            if c != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError("a bracket is missing")
            value, i = holder, i + 1
            open_.pop()


def load_json(text: str) -> object:
    """The value of a JSON text. A string that holds JSON counts as its content. ValueError if it isn't valid."""
    value = decode(text)
    return unwrap(value) if isinstance(value, str) else value


def unwrap(value: str) -> object:
    while isinstance(value, str) and _LOOKS_NESTED.match(value):
        try:
            value = decode(value)
        except ValueError:
            break
    return value


def read_json(texts: list[str | None], nodes: Nodes) -> None:
    """Append the objects of every valid text. The label is the path from the object above, arrays included."""
    parent, depth, label, record = nodes.parent, nodes.depth, nodes.label, nodes.record
    for at, text in enumerate(texts):
        if not text:
            continue
        try:
            value = load_json(text)
        except ValueError:
            continue
        if not isinstance(value, (dict, list)):
            continue
        # (value, object above, path from there)
        stack: list[tuple[object, int, str]] = [(value, -1, "$")]
        while stack:
            value, above, path = stack.pop()
            if isinstance(value, dict):
                here = len(parent)
                parent.append(above)
                depth.append(depth[above] + 1 if above >= 0 else 0)
                label.append(path)
                record.append(at)
                path = ""
                inner = [(f".{k}", v) for k, v in value.items() if isinstance(v, (dict, list, str))]
            else:
                here = above
                inner = [(f"{path}[{i}]", v) for i, v in enumerate(value) if isinstance(v, (dict, list, str))]
            for step, v in reversed(inner):
                if isinstance(v, str):
                    v = unwrap(v)
                    if not isinstance(v, (dict, list)):
                        continue
                stack.append((v, here, step))


def sibling_places(parent: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Place from 1 among the earlier rows of the same parent and label."""
    n = len(parent)
    if not n:
        return np.zeros(0, np.int64)
    key = parent.astype(np.int64) * (int(label.max()) + 1) + label
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    starts = np.flatnonzero(first)
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n))) + 1
    out = np.empty(n, np.int64)
    out[order] = place
    return out


#: Characters of the texts that are decoded together, and bytes of the paths that are sent together.
DECODED, SENT = 8 << 20, 16 << 20


def paths_of(nodes: Nodes, *, xml: bool) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(path, parent path, record index) of the levels from the top. Every level takes its parents' paths by index, and only
    one level is kept: the paths of deep records together are as long as the square of their depth."""
    parent = np.asarray(nodes.parent, np.int64)
    depth = np.asarray(nodes.depth, np.int64)
    records = np.asarray(nodes.record, np.int64)
    order = np.argsort(depth, kind="stable")
    labels = pa.array(nodes.label, pa.large_string())
    if xml:
        coded = labels.dictionary_encode()
        places = sibling_places(parent + 1, np.asarray(coded.indices, np.int64))
        roots = pc.binary_join_element_wise(pa.scalar("/", pa.large_string()), labels, pa.scalar("", pa.large_string()))
        text = lambda x: pa.scalar(x, pa.large_string())
        labels = pc.binary_join_element_wise(text("/"), labels, text("["), pc.cast(pa.array(places), pa.large_string()), text("]"), text(""))
        labels = pc.if_else(pa.array(parent < 0), roots, labels)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    bounds = np.searchsorted(depth[order], np.arange(int(depth.max()) + 2))
    before: pa.Array | None = None
    for level in range(len(bounds) - 1):
        ids = order[bounds[level] : bounds[level + 1]]
        own = pc.take(labels, pa.array(ids))
        if before is None:
            up, path = pa.array([""] * len(ids), pa.large_string()), own
        else:
            up = pc.take(before, pa.array(rank[parent[ids]] - bounds[level - 1]))
            path = pc.binary_join_element_wise(up, own, pa.scalar("", pa.large_string()))
        before = path
        yield path, up, records[ids]


def _in_parts(levels: Iterator[tuple[pa.Array, pa.Array, np.ndarray]]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Small levels together, large ones divided, so that what is sent has a like size."""
    held: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
    size = 0

    def joined() -> tuple[pa.Array, pa.Array, np.ndarray]:
        path, up, record = zip(*held, strict=True)
        return pa.concat_arrays(path).cast(pa.string()), pa.concat_arrays(up).cast(pa.string()), np.concatenate(record)

    for path, up, record in levels:
        rows = max(1, len(path) * SENT // max(path.nbytes, 1))
        for at in range(0, len(path), rows):
            part = path.slice(at, rows), up.slice(at, rows), record[at : at + rows]
            held.append(part)
            size += int(path.nbytes * len(part[0]) / len(path)) + 1
            if size >= SENT:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _together(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, behind) of runs of texts that are decoded together."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first = held = 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > DECODED:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(lengths):
        yield first, len(lengths)


def flatten_texts(df: DataFrame, key: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per element or object: (<key>, origin, node_path, parent_path).

    ``columns`` maps an origin to (column, ``xml`` or ``json``). Null, blank and damaged texts give no rows; a
    repeated key gives its rows again; a null key stays null. Of a name that occurs twice in a JSON object the
    last member counts. Two columns of the frame may have the same name as an output column; only the key and
    the named columns are read.
    """
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), *[T.StructField(c, T.StringType()) for c in ("origin", "node_path", "parent_path")]])
    names = {origin: (f"_text{i}", how) for i, (origin, (_, how)) in enumerate(columns.items())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for origin, (name, how) in names.items():
                for first, behind in _together(batch.column(name)):
                    nodes = Nodes()
                    (read_xml if how == "xml" else read_json)(batch.column(name).slice(first, behind - first).to_pylist(), nodes)
                    if not len(nodes):
                        continue
                    for path, up, record in _in_parts(paths_of(nodes, xml=how == "xml")):
                        yield pa.RecordBatch.from_arrays([pc.take(keys, pa.array(record + first)), pa.array([origin] * len(path), pa.string()), path, up], names=[key, "origin", "node_path", "parent_path"])

    ship(df.sparkSession)
    picked = df.select(F.col(f"`{key}`").alias("_key"), *[F.col(f"`{c}`").alias(f"_text{i}") for i, (c, _) in enumerate(columns.values())])
    return picked.mapInArrow(run, out)


def explode_arrays(df: DataFrame, key: str, column: str) -> DataFrame:
    """A child table of an array column: (<key>, place, <fields of a struct or value>), place from 0.

    The child arrays are Arrow's own list values; keys come by one take through the parent index, places from
    the list offsets. Null and empty arrays give no rows, null members a row of nulls.
    """
    item = df.schema[column].dataType.elementType
    fields = item.fields if isinstance(item, T.StructType) else [T.StructField("value", item)]
    if clash := {f.name for f in fields} & {key, "place"}:
        fields = [T.StructField(f"{column}_{f.name}" if f.name in clash else f.name, f.dataType) for f in fields]
    out = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("place", T.LongType()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            parents = pc.list_parent_indices(lists)
            values = pc.list_flatten(lists)
            if not len(values):
                continue
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(sizes) - sizes
            place = np.arange(len(values)) - np.repeat(first, sizes)
            members = [pc.struct_field(values, [i]) for i in range(len(fields))] if pa.types.is_struct(values.type) else [values]
            yield pa.RecordBatch.from_arrays([pc.take(batch.column(0), parents), pa.array(place, pa.int64()), *members], names=[f.name for f in out])

    ship(df.sparkSession)
    return df.select(F.col(f"`{key}`"), F.col(f"`{column}`")).mapInArrow(run, out)
