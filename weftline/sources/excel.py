"""Sheets of Excel workbooks (xlsx, xlsm) without other libraries.

A sheet has at most ``ROWS`` rows, so it is read by one task and written by the driver row by row.
"""

from __future__ import annotations

import datetime
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftline.session import ship

# The most rows of a sheet, name spaces and built-in formats of dates, the first day.
ROWS = 1_048_576
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
_EPOCH = datetime.datetime(1899, 12, 30)


def _number_of(reference: str) -> int:
    """The number of a cell's column, from 0."""
    n = 0
    for ch in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _dated_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")) for f in root.iter(f"{_MAIN}numFmt")}
    formats = root.find(f"{_MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in formats] if formats is not None else []
    return {i for i, n in enumerate(ids) if n in _DATE_FORMATS or re.search("[ymdhs]", own.get(n, ""), re.I)}


def _sheet_path(book: zipfile.ZipFile, name: str | None) -> str:
    sheets = {s.get("name"): s.get(_LINK) for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
    if name is not None and name not in sheets:
        raise ValueError(f"there is no sheet {name}")
    wanted = sheets[name] if name is not None else next(iter(sheets.values()))
    target = next(r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == wanted)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def cells(raw: bytes, sheet: str | None = None) -> Iterator[list]:
    """The rows of a sheet, the first one if none is named: texts, numbers, booleans, times and None."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dated = _dated_styles(book)
        with book.open(_sheet_path(book, sheet)) as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                out: list = []
                for i, c in enumerate(row.iter(f"{_MAIN}c")):
                    at = _number_of(c.get("r")) if c.get("r") else i
                    out += [None] * (at + 1 - len(out))
                    out[at] = _value(c, shared, dated)
                row.clear()
                yield out


def _value(c: ET.Element, shared: list[str], dated: set[int]):  # noqa: ANN202
    kind, v = c.get("t", "n"), c.findtext(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
    if v is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(v)]
    if kind in ("str", "d"):
        return v
    if kind == "b":
        return v == "1"
    if int(c.get("s", 0)) in dated:
        return _EPOCH + datetime.timedelta(seconds=round(float(v) * 86400, 3))
    return float(v) if re.search("[.eE]", v) else int(v)


_KINDS = ((bool, "boolean"), (int, "bigint"), (float, "double"), (datetime.datetime, "timestamp_ntz"))


def _kind(values: set[str]) -> str:
    return next(iter(values)) if len(values) == 1 else "double" if values == {"bigint", "double"} else "string"


def _described(sheet: str | None):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows = cells(raw, sheet)
                names = [str(x) if x is not None else f"Field_{i + 1}" for i, x in enumerate(next(rows, []))]
                kinds: list[set[str]] = [set() for _ in names]
                for row in rows:
                    for k, v in zip(kinds, row, strict=False):
                        if v is not None:
                            k.add(next((name for kind, name in _KINDS if type(v) is kind), "string"))
                found = json.dumps([names, [_kind(k) if k else "string" for k in kinds]])
                yield pa.RecordBatch.from_arrays([pa.array([found])], names=["found"])

    return run


def _as_text(v) -> str | None:  # noqa: ANN001
    return v if v is None or isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def read(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A frame of a sheet: the first row has the names, a column's type is that of all its cells, else text. The file is opened
    by a task, once for the types and once for the rows; an empty sheet gives no columns."""
    ship(spark)
    raw = spark.read.format("binaryFile").load(path).select("content")
    described = raw.mapInArrow(_described(sheet), "found string").first()
    names, kinds = json.loads(described["found"]) if described else ([], [])
    seen: dict[str, int] = {}
    for i, n in enumerate(names):  # a name that comes again gets a number
        seen[n] = seen.get(n, 0) + 1
        names[i] = n if seen[n] == 1 else f"{n}{seen[n]}"
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names, kinds, strict=True)])
    if not names:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, text = to_arrow_schema(schema), [k == "string" for k in kinds]

        def made(held: list[list]) -> pa.RecordBatch:
            columns = [[_as_text(v) for v in c] if t else c for c, t in zip(zip(*held, strict=True), text, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for raw_bytes in batch.column(0).to_pylist():
                rows, held = cells(raw_bytes, sheet), []
                next(rows, None)
                for row in rows:
                    held.append((row + [None] * len(names))[: len(names)])
                    if len(held) == 10_000:
                        yield made(held)
                        held = []
                if held:
                    yield made(held)

    return raw.mapInArrow(run, schema)


def _cell(v) -> str:  # noqa: ANN001
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, datetime.datetime):
        return f'<c s="1"><v>{(v.replace(tzinfo=None) - _EPOCH) / datetime.timedelta(days=1)!r}</v></c>'
    if isinstance(v, datetime.date):
        return f'<c s="2"><v>{(v - _EPOCH.date()).days}</v></c>'
    if isinstance(v, (int, float)):
        return f"<c><v>{v!r}</v></c>"
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="1"><font/></fonts><fills count="2"><fill/><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


def write(df: DataFrame, path: str, sheet: str | None = None) -> None:
    """One workbook with one sheet, row by row from the frame; nulls are empty cells. More rows than a sheet has are an error."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in _PARTS.items():
            book.writestr(name, text)
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_LINK[1:].split("}")[0]}"><sheets><sheet name={quoteattr((sheet or "Sheet1")[:31])} sheetId="1" r:id="rId1"/></sheets></workbook>')
        with book.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
            f.write(("<row>" + "".join(map(_cell, df.columns)) + "</row>").encode())
            for i, row in enumerate(df.toLocalIterator(), 2):
                if i > ROWS:
                    raise ValueError("too many rows for a sheet")
                f.write(("<row>" + "".join(map(_cell, row)) + "</row>").encode())
            f.write(b"</sheetData></worksheet>")
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(buffer.getvalue()))
    finally:
        out.close()
