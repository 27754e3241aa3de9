"""Workbooks: as other programs write them, our own, broken ones, and a job that fails."""

import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import sheets, sinks

BOOK = ('<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
        '<sheets><sheet name="Libro 1" sheetId="1" r:id="rId1"/><sheet name="Otro" sheetId="2" r:id="rId2"/></sheets></workbook>')
LINKS = ('<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
         '<Relationship Id="rId1" Type="x" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="x" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
STRINGS = ('<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Fécha  de Carga</t></si><si><t>Monto</t></si>'
           '<si><r><t>par</t></r><r><t>tes &amp; más</t></r></si></sst>')
STYLES = ('<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy hh:mm"/>'
          '<numFmt numFmtId="171" formatCode="0.00&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
SHEET1 = ('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
          '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>Texto</t></is></c></row>'
          '<row r="2"><c r="A2" s="1"><v>45658</v></c><c r="B2"><v>1234.56</v></c><c r="D2" t="s"><v>2</v></c></row>'
          '<row r="5"><c r="A5" s="2"><v>45658.75</v></c><c r="B5" t="str"><f>A1</f><v>formula</v></c><c r="C5"><v>9</v></c><c r="D5" t="b"><v>1</v></c></row>'
          '<row r="6"><c r="B6" s="3"><v>7</v></c><c r="D6" t="e"><v>#N/A</v></c></row></sheetData></worksheet>')
SHEET2 = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData/></worksheet>'


def foreign(folder, spark):
    """A workbook with shared strings, dates, gaps and an empty sheet."""
    sinks.write_bytes(spark, f"{folder}/empty.txt", b"")
    with zipfile.ZipFile(f"{folder.removeprefix('file:')}/foreign.XLSX", "w") as z:
        for name, text in (("xl/workbook.xml", BOOK), ("xl/_rels/workbook.xml.rels", LINKS), ("xl/sharedStrings.xml", STRINGS), ("xl/styles.xml", STYLES),
                           ("xl/worksheets/sheet1.xml", SHEET1), ("xl/worksheets/sheet2.xml", SHEET2)):
            z.writestr(name, text)


@pytest.fixture
def folder(spark):
    return sinks.scratch_path(spark, "test", uuid.uuid4().hex)


def test_a_foreign_workbook(spark, folder):
    foreign(folder, spark)
    rows, rejects = sheets.read_sheets(spark, folder, {"fecha de carga": "carga", "monto": "monto", "texto": "texto", "absent": "absent"})
    got = [tuple(r)[2:] for r in rows.orderBy("row").collect()]
    assert got == [(2, "2025-01-01 00:00:00", "1234.56", "partes & más", None), (5, "2025-01-01 18:00:00", "formula", "true", None), (6, None, "7", None, None)]
    assert {(r.source_file, r.sheet) for r in rows.collect()} == {("foreign.XLSX", "Libro 1")} and rejects.count() == 0
    assert sheets.read_sheets(spark, folder, {"monto": "m"}, sheet="Otro")[0].count() == 0


def test_round_trip(spark, folder):
    odd = [("a", 1, "1.10", "x<&>\"' ñ日\n line"), ("a", None, None, None), ("b", -5, "99999999999999.99", " "), ("b", 2**40, "0.00", "")]
    df = spark.createDataFrame(odd * 40, "file string, n bigint, money string, t string").withColumn("money", F.col("money").cast("decimal(18,2)"))
    sheets.write_sheets(df.repartition(3).sortWithinPartitions("file"), folder, "file", sheet_rows=7)
    rows, _ = sheets.read_sheets(spark, folder, {c: c for c in ("n", "money", "t")})
    back = rows.select(F.substring("source_file", 1, 1).alias("file"), F.col("n").cast("bigint").alias("n"), F.col("money").cast("decimal(18,2)").alias("money"), "t")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert rows.select("sheet").distinct().count() > 1
    sheets.write_sheets(df.limit(1), folder, "file", mode="overwrite")
    assert sheets.read_sheets(spark, folder, {"n": "n"})[0].count() == 1


def test_unreadable_files_are_rejects(spark, folder):
    spark.createDataFrame([("x",)] * 5, "v string").coalesce(1).transform(lambda d: sheets.write_sheets(d, folder) or d)
    sinks.write_bytes(spark, f"{folder}/broken.xlsx", b"no zip")
    sinks.write_bytes(spark, f"{folder}/~lock.txt", b"")
    rows, rejects = sheets.read_sheets(spark, folder, {"v": "v"})
    assert rows.count() == 5 and [r.source_file for r in rejects.collect()] == ["broken.xlsx"]
    assert sheets.read_sheets(spark, f"{folder}/nothing", {"v": "v"})[0].count() == 0


def test_a_failed_job_leaves_nothing(spark, folder):
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 70, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception):
        sheets.write_sheets(bad, folder)
    assert sheets.read_sheets(spark, folder, {"v": "v"})[0].count() == 0
    fs, path, _ = sinks._fs(spark, folder)
    assert not fs.exists(path) or not [s for s in fs.listStatus(path) if s.getPath().getName().startswith("_temporary")]
