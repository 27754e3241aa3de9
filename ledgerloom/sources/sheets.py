"""Workbooks (.xlsx) in and out, as a Python data source.

Reading: one partition a file, its sheets read one after the other, rows
streamed from the zipped XML in Arrow batches. A row is (source_file, sheet,
row, cells): the first row of a sheet gives the headers, ``cells`` maps each
header to the cell's text. Numbers keep their digits, cells with a date format
become ISO text, formulas give their stored value. A file that cannot be read
gives one row with ``error`` set, and no other.

Writing: each task streams its rows into workbooks of its own, a new one
wherever the file column changes, a new sheet after ``SHEET_ROWS`` rows. They
lie in a temporary folder until the job commits; a failed or repeated task
leaves nothing behind. A file's rows may be spread over tasks: its workbooks
are ``<name>-<task>.xlsx``.

Files are reached through Arrow's file systems (local and mounted folders,
HDFS, object stores).
"""

from __future__ import annotations

import datetime as dt
import posixpath
import re
import sys
import unicodedata
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "source_file string, sheet string, row bigint, cells map<string,string>, error string"
BATCH_ROWS = 2_000
#: Rows of a sheet, headers not counted; the format's own limit.
SHEET_ROWS = 1_048_575

# Fixed values of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATE_FORMATS = {14, 15, 16, 17, 22, 27, 30, 36, 50, 57}
FIRST_DAY = dt.datetime(1899, 12, 30)
TYPES = ('<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
         '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
         '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" '
         'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{sheets}</Types>')
SHEET_TYPE = ('<Override PartName="/xl/worksheets/sheet{n}.xml" '
              'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
RELATIONS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'
RELATION = '<Relationship Id="rId{n}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/>'
WORKBOOK = ('<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
            'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>')
SHEET_HEAD = '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
SHEET_TAIL = "</sheetData></worksheet>"
NO_XML = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]"


def file_system(path: str):
    """The Arrow file system of a path, and the path on it."""
    from pyarrow import fs
    if re.match(r"^[a-z0-9]+:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)


def column_number(reference: str) -> int:
    """0 for A1, 27 for AB7."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def text_of(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


class Workbook:
    """The sheets of an open workbook."""

    def __init__(self, stream):
        self.zip = zipfile.ZipFile(stream)
        names = set(self.zip.namelist())
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        self.sheets = [(s.get("name"), posixpath.normpath(posixpath.join("/xl", links[s.get(f"{LINK}id")])).lstrip("/")) for s in book.iter(f"{MAIN}sheet")]
        self.shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with self.zip.open("xl/sharedStrings.xml") as f:
                for _, node in ET.iterparse(f):
                    if node.tag == f"{MAIN}si":
                        self.shared.append(text_of(node))
                        node.clear()
        self.dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ET.fromstring(self.zip.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iter(f"{MAIN}numFmt")
                   if re.search(r"[ymdYMD]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or ""))}
            formats = styles.find(f"{MAIN}cellXfs")
            self.dates = {k for k, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId") or 0) in DATE_FORMATS | own}

    def value(self, cell) -> str | None:
        kind, node = cell.get("t"), cell.find(f"{MAIN}v")
        if kind == "inlineStr":
            return text_of(cell)
        if node is None or node.text is None or kind == "e":
            return None
        if kind == "s":
            return self.shared[int(node.text)]
        if kind == "b":
            return "true" if node.text == "1" else "false"
        if kind in (None, "n") and int(cell.get("s") or 0) in self.dates:
            day = FIRST_DAY + dt.timedelta(microseconds=round(float(node.text) * 86_400_000_000))
            return day.isoformat(" ")
        return node.text

    def rows(self, part: str) -> Iterator[tuple[int, dict[int, str]]]:
        """(row number, {column: text}) of a sheet, streamed."""
        with self.zip.open(part) as f:
            at, sheet = 0, None
            for event, node in ET.iterparse(f, ("start", "end")):
                if event == "start":
                    sheet = node if node.tag == f"{MAIN}sheetData" else sheet
                elif node.tag == f"{MAIN}row":
                    at = int(node.get("r") or at + 1)
                    cells, next_column = {}, 0
                    for c in node.iter(f"{MAIN}c"):
                        k = column_number(c.get("r")) if c.get("r") else next_column
                        next_column = k + 1
                        if (v := self.value(c)) is not None:
                            cells[k] = v
                    yield at, cells
                    if sheet is not None:
                        sheet.clear()


@dataclass
class SheetFile(InputPartition):
    path: str


def fold(header: str) -> str:
    """A header without accents, in lower case, with single spaces (``readers.fold_header``, for workers without the package)."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", header) if not unicodedata.combining(c))
    return " ".join(plain.split()).lower()


class SheetReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sheet = options["path"], options.get("sheet")
        self.fold = options.get("fold", "false").lower() == "true"

    def partitions(self) -> list[SheetFile]:
        from pyarrow import fs
        system, path = file_system(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return [SheetFile(f.path) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".xlsx")
                and not any(p.startswith(("_", ".")) for p in f.path[len(path):].split("/"))] or [SheetFile("")]

    def read(self, partition: SheetFile) -> Iterator[pa.RecordBatch]:
        names = ["source_file", "sheet", "row", "cells", "error"]
        types = [pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], names)

        if not partition.path:
            return
        name, rows = posixpath.basename(partition.path), []
        try:
            system, _ = file_system(self.path)
            with system.open_input_file(partition.path) as stream:
                book = Workbook(stream)
                for sheet, part in book.sheets:
                    if self.sheet is not None and sheet != self.sheet:
                        continue
                    headers = None
                    for at, cells in book.rows(part):
                        if headers is None:
                            # of columns with one header the first stands
                            named = {(fold(h) if self.fold else h): k for k, h in sorted(cells.items(), reverse=True)}
                            headers = {k: h for h, k in named.items()}
                            continue
                        rows.append((name, sheet, at, [(h, cells[k]) for k, h in headers.items() if k in cells], None))
                        if len(rows) >= BATCH_ROWS:
                            yield batch(rows)
                            rows = []
        except (zipfile.BadZipFile, KeyError, IndexError, ET.ParseError, ValueError, OSError) as e:
            rows.append((name, None, 0, None, f"{type(e).__name__}: {e}"))
        yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    files: list


def row_xml(columns: list[pa.Array], numeric: list[bool]) -> pa.Array:
    """The XML of each row of text columns, made column by column in Arrow."""
    cells = []
    for c, n in zip(columns, numeric):
        if n:
            c = pc.binary_join_element_wise("<c><v>", c, "</v></c>", "")
        else:
            c = pc.replace_substring_regex(c, NO_XML, "")
            for plain, escaped in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
                c = pc.replace_substring(c, plain, escaped)
            c = pc.binary_join_element_wise('<c t="inlineStr"><is><t xml:space="preserve">', c, "</t></is></c>", "")
        cells.append(pc.fill_null(c, "<c/>"))
    return pc.binary_join_element_wise("<row>", *cells, "</row>", "")


class WorkbookWriter:
    """One workbook, streamed to a file."""

    def __init__(self, stream, headers: list[str], sheet_rows: int):
        self.zip, self.headers, self.sheet_rows = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=1), headers, sheet_rows
        self.sheets, self.left, self.out = 0, 0, None

    def add(self, rows: pa.Array) -> None:
        """Rows as ``row_xml`` gives them."""
        while len(rows):
            if not self.left:
                self._end_sheet()
                self.sheets += 1
                self.out = self.zip.open(f"xl/worksheets/sheet{self.sheets}.xml", "w", force_zip64=True)
                self.out.write((SHEET_HEAD + row_xml([pa.array([h], pa.string()) for h in self.headers], [False] * len(self.headers))[0].as_py()).encode())
                self.left = self.sheet_rows
            now, rows = rows[:self.left], rows[self.left:]
            self.out.write("".join(now.to_pylist()).encode())
            self.left -= len(now)

    def _end_sheet(self) -> None:
        if self.out is not None:
            self.out.write(SHEET_TAIL.encode())
            self.out.close()

    def close(self) -> None:
        self._end_sheet()
        k = range(1, self.sheets + 1)
        self.zip.writestr("xl/workbook.xml", WORKBOOK.format(sheets="".join(f'<sheet name="Sheet{n}" sheetId="{n}" r:id="rId{n}"/>' for n in k)))
        self.zip.writestr("xl/_rels/workbook.xml.rels", RELATIONS.format(
            links="".join(RELATION.format(n=n, kind="worksheet", target=f"worksheets/sheet{n}.xml") for n in k)))
        self.zip.writestr("_rels/.rels", RELATIONS.format(links=RELATION.format(n=1, kind="officeDocument", target="xl/workbook.xml")))
        self.zip.writestr("[Content_Types].xml", TYPES.format(sheets="".join(SHEET_TYPE.format(n=n) for n in k)))
        self.zip.close()


class SheetWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.column, self.overwrite = options["path"], options.get("filecolumn"), overwrite
        self.headers = [f.name for f in schema.fields if f.name != self.column]
        self.sheet_rows = int(options.get("sheetrows", SHEET_ROWS))
        self.folder = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext
        system, root = file_system(self.path)
        task = TaskContext.get()
        place = f"{root.rstrip('/')}/{self.folder}/{task.taskAttemptId()}"
        system.create_dir(place, recursive=True)
        files, book, stream, current = [], None, None, None
        for b in iterator:
            if not b.num_rows:
                continue
            named = b.column(b.schema.get_field_index(self.column)).to_pylist() if self.column else ["part"] * b.num_rows
            fields = [b.schema.field(h) for h in self.headers]
            numeric = [pa.types.is_integer(f.type) or pa.types.is_decimal(f.type) for f in fields]
            xml = row_xml([b.column(b.schema.get_field_index(h)).cast(pa.string()) for h in self.headers], numeric)
            starts = [k for k in range(len(named)) if not k or named[k] != named[k - 1]]
            for at, end in zip(starts, [*starts[1:], len(named)]):
                name = named[at]
                if book is None or name != current:
                    if book is not None:
                        book.close()
                        stream.close()
                    current = name
                    files.append(f"{name}-{task.partitionId()}-{len(files)}.xlsx")
                    stream = system.open_output_stream(f"{place}/{files[-1]}")
                    book = WorkbookWriter(stream, self.headers, self.sheet_rows)
                book.add(xml[at:end])
        if book is not None:
            book.close()
            stream.close()
        return Written([f"{place}/{f}" for f in files])

    def commit(self, messages) -> None:
        from pyarrow import fs
        system, root = file_system(self.path)
        old = [f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.File] if self.overwrite else []
        job = self.folder.rsplit("-", 1)[1][:8]
        for m in messages:
            for f in m.files if m else ():
                system.move(f, f"{root.rstrip('/')}/{posixpath.basename(f)[:-5]}-{job}.xlsx")
        for f in old:
            system.delete_file(f)
        self.abort(messages)

    def abort(self, messages) -> None:
        system, root = file_system(self.path)
        from pyarrow import fs
        if system.get_file_info(f"{root.rstrip('/')}/{self.folder}").type == fs.FileType.Directory:
            system.delete_dir(f"{root.rstrip('/')}/{self.folder}")


class SheetSource(DataSource):
    """``format("sheets")``; options ``path``, ``sheet`` (reading), ``filecolumn`` and ``sheetrows`` (writing)."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SheetReader:
        return SheetReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> SheetWriter:
        return SheetWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(SheetSource)


def read_sheets(spark: SparkSession, path: str, columns: dict[str, str], sheet: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of the workbooks under ``path``.

    ``columns`` maps the folded header of a sheet to a column's name, all as
    text; sheets may differ in order, letter case and accents of their
    headers. Rejects: source_file and error of files that cannot be read; such
    a file's rows before the error are left out with it.
    """
    from ledgerloom.operators.sequence import materialise  # not at the top: workers may not have the package
    register(spark)
    r = spark.read.format("sheets").option("path", path).option("fold", "true")
    raw = (r.option("sheet", sheet) if sheet is not None else r).load()
    # a workbook is parsed once, for its rows and for its error
    raw = materialise(raw.select("source_file", "sheet", "row", "error", *[F.col("cells")[h].alias(f"_{k}") for k, h in enumerate(columns)]))
    rejects = raw.where("error IS NOT NULL").select("source_file", "error")
    rows = raw.where("error IS NULL").select("source_file", "sheet", "row", *[F.col(f"_{k}").alias(c) for k, c in enumerate(columns.values())])
    return rows.join(rejects.select("source_file"), "source_file", "left_anti"), rejects


def write_sheets(df: DataFrame, path: str, file_column: str | None = None, mode: str = "append", sheet_rows: int = SHEET_ROWS) -> None:
    """Write ``df`` as workbooks; ``file_column`` names each row's file. Rows of a file should lie together (sort first)."""
    register(df.sparkSession)
    w = df.write.format("sheets").mode(mode).option("path", path).option("sheetrows", sheet_rows)
    (w.option("filecolumn", file_column) if file_column else w).save()
