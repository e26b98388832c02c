"""Workbooks, fetched files, catalogs, and compressed lines."""

import io
import lzma
import zipfile

import pyarrow as pa
import pyarrow.csv
import pyarrow.parquet as pq
import pytest

from loomquery.errors import NotAllowed, QueryError
from loomquery.plans.session import Session
from loomquery.sources import files

SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>flag</t></is></c></row>
<row r="2"><c r="A2"><v>1</v></c><c r="B2"><v>2.5</v></c><c r="D2" t="b"><v>1</v></c></row>
<row r="3"><c r="A3"><v>2</v></c><c r="D3" t="b"><v>0</v></c></row></sheetData></worksheet>"""
STRINGS = """<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>id</t></si><si><r><t>si</t></r><r><t>ze</t></r></si></sst>"""


def workbook() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", SHEET)
        z.writestr("xl/worksheets/sheet2.xml", "<worksheet/>")
        z.writestr("xl/sharedStrings.xml", STRINGS)
    return out.getvalue()


def test_first_sheet_of_a_workbook(spark, tmp_path):
    (tmp_path / "book.xlsx").write_bytes(workbook())
    rows = Session(spark, str(tmp_path)).sql("SELECT id, size, flag FROM book.xlsx ORDER BY id").collect()
    assert [tuple(r) for r in rows] == [(1, 2.5, True), (2, None, False)]
    assert files._sheet(workbook()).schema.field("id").type == pa.int64()


def test_http_reads_what_the_session_fetches(spark, tmp_path):
    t = pa.table({"k": [1, 2], "s": ["x", None]})
    parquet, csv = io.BytesIO(), io.BytesIO()
    pq.write_table(t, parquet)
    pyarrow.csv.write_csv(t, csv)
    store = {"https://a.example/t.parquet": parquet.getvalue(), "http://a.example/t.csv?x=1": csv.getvalue(), "http://a.example/t.jsonl": b'{"k": 1, "s": "x"}\n{"k": 2}\n', "http://a.example/b.xlsx": workbook()}
    s = Session(spark, str(tmp_path), fetch=store.__getitem__)
    for url in list(store)[:3]:
        assert s.sql(f"SELECT SUM(k) AS k FROM HTTP('{url}') AS h").collect() == [(3,)]
    assert s.sql("SELECT COUNT(*) AS n FROM HTTP('http://a.example/b.xlsx') AS h WHERE flag").collect() == [(1,)]
    with pytest.raises(QueryError):
        s.sql("SELECT * FROM HTTP('file:///etc/passwd') AS h")
    with pytest.raises(NotAllowed):
        Session(spark, str(tmp_path)).sql("SELECT * FROM HTTP('http://a.example/t.csv') AS h")


def test_tables_of_a_catalog(spark, tmp_path):
    spark.range(3).write.mode("overwrite").saveAsTable("kept_here")
    s = Session(spark, str(tmp_path))
    s.catalog("lake", "spark_catalog.default")
    assert s.sql("SELECT COUNT(*) AS n FROM lake.kept_here").collect() == [(3,)]
    spark.sql("DROP TABLE kept_here")


def test_compressed_lines(spark, tmp_path):
    (tmp_path / "rows").mkdir()
    (tmp_path / "rows" / "a.jsonl.xz").write_bytes(lzma.compress(b'{"a": 1, "b": {"c": 2}}\n\n{"a": 2}\n'))
    (tmp_path / "rows" / "b.jsonl.xz").write_bytes(lzma.compress(b'{"a": 3, "d": "x"}\n'))
    rows = Session(spark, str(tmp_path)).sql("SELECT a, b, d FROM rows ORDER BY a").collect()
    assert [tuple(r) for r in rows] == [(1, '{"c":2}', None), (2, None, None), (3, None, "x")]


def test_a_file_that_changed_is_looked_at_again(spark, tmp_path):
    s = Session(spark, str(tmp_path))
    for n in (1, 2):
        pq.write_table(pa.table({f"c{k}": [k, k] for k in range(n)}), tmp_path / "t.parquet")
        for _ in range(2):
            assert s.sql("SELECT * FROM t").columns == [f"c{k}" for k in range(n)] and s.sql("SELECT * FROM t").count() == 2
