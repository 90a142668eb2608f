"""Workbooks: what is written is read back, and what other programs write."""

import datetime
import io
import zipfile

import pytest

from weftline.sources import excel, files


def test_round_trip(spark, tmp_path):
    data = [(1, "a <b> & \"c\"\n d ", 1.5, True, datetime.datetime(2024, 2, 29, 13, 45, 10)), (2, None, None, None, None), (None, "", -3.0, False, datetime.datetime(1999, 12, 31))]
    df = spark.createDataFrame(data, "i long, s string, d double, b boolean, t timestamp_ntz")
    at = files.locate(f"{tmp_path}/x.xlsx|||My sheet$")
    files.write(df, at)
    back = files.read(spark, at)
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect()), key=str) == sorted(data, key=str)
    files.write(df.limit(0), at)
    assert files.read(spark, at).count() == 0 and files.read(spark, at).columns == df.columns
    with pytest.raises(Exception, match="no sheet"):
        files.read(spark, files.Location(at.path, "xlsx", "Other"))
    with pytest.raises(files.MissingDependency):
        files.read(spark, files.locate("old.xls"))


def test_sheets_of_other_programs(spark, tmp_path):
    """Shared texts with runs, gaps between cells, own date formats, errors, mixed columns and names that come again."""
    parts = dict(excel._PARTS)
    parts["xl/workbook.xml"] = f'<workbook xmlns="{excel._MAIN[1:-1]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>'
    parts["xl/styles.xml"] = f'<styleSheet xmlns="{excel._MAIN[1:-1]}"><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/><numFmt numFmtId="165" formatCode="&quot;day&quot; 0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{excel._MAIN[1:-1]}"><si><t>name</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>'
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>0</v></c><c r="D1" t="str"><v>when</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c><c r="D2" s="1"><v>45351</v></c></row><row r="3"><c r="A3"><v>5</v></c><c r="B3" t="e"><v>#N/A</v></c><c r="C3" s="2"><v>2.5</v></c></row>'
    parts["xl/worksheets/sheet1.xml"] = f'<worksheet xmlns="{excel._MAIN[1:-1]}"><sheetData>{rows}</sheetData></worksheet>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    (tmp_path / "o.xlsx").write_bytes(buffer.getvalue())
    df = files.read(spark, files.locate(str(tmp_path / "o.xlsx")))
    assert df.dtypes == [("name", "string"), ("name2", "string"), ("Field_3", "double"), ("when", "timestamp_ntz")]
    assert [tuple(r) for r in df.collect()] == [("two runs", None, 7.0, datetime.datetime(2024, 2, 29)), ("5", None, 2.5, None)]
