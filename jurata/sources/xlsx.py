"""Workbooks as a Spark data source: cells in, sheets out, with the standard library's zip and XML readers.

spark.dataSource.register(XlsxDataSource); spark.read.format("xlsx").load(path) gives one row per cell:
(file, sheet, visible, row, col, kind, value, cached, cached_kind), kind n(umber), s(tring), b(oolean), d(ate or time, by
the cell's number format, as ISO text), e(rror) or f(ormula, whose formula is value and whose stored result is cached, of
cached_kind). Numbers are texts: integers digit by digit, others by the shortest digits of their double. Option
mode=catalog gives only (file, sheet, visible). With option pushdown=true, where spark.sql.python.filterPushdown.enabled is
set, filters on sheet, row and col reach the file. Several comma-separated paths are read in parallel, one partition per
sheet. Guards run before cells are read: size of the unpacked archive, number of visible sheets, cells of a sheet.

df.write.format("xlsx").mode("append").option("sheet", name).save(path) writes one workbook per partition (order the rows
and use one partition for one file): bold header row, frozen, no formulas, at most MAX_ROWS rows, written as they come. A
second attempt of a task doesn't meet the first one's file, and nothing has its name before the whole job is done. Streams
are written the same way, one set of files a micro-batch.

Both read and write paths that every machine has: in a cluster they need option shared=true (a mounted folder).
stored_cells() reads workbooks from any file system that Spark reads.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from itertools import chain, islice
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from .files import contents

# Names of the workbook format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_SCHEMA = "file string, sheet string, visible boolean, row int, col int, kind string, value string, cached string, cached_kind string"
_CATALOG = "file string, sheet string, visible boolean"

# Limits of a workbook.
MAX_UPLOAD, UNZIP_FACTOR, MAX_SHEETS, MAX_CELLS = 50 << 20, 8, 50, 500_000
#: Data rows that a sheet holds below its header, by the format.
MAX_ROWS = (1 << 20) - 1
# Numbers of the format's own date and time formats, those of them that are durations, and the day 0.
_DATES, _DURATIONS, _DAY0, _DAY0_1904 = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)]), frozenset([46]), datetime(1899, 12, 30), datetime(1904, 1, 1)


class WorkbookTooLarge(ValueError):
    """A size guard: raised before anything is materialised."""


@dataclass(frozen=True)
class Sheet:
    name: str
    visible: bool
    part: str


def sheets(book: zipfile.ZipFile) -> list[Sheet]:
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = []
    for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = links[s.get(_REL)]
        found.append(Sheet(s.get("name"), s.get("state", "visible") == "visible", target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return found


def guarded(path: str | io.BytesIO, max_upload: int = MAX_UPLOAD) -> zipfile.ZipFile:
    """The opened workbook, within the limits on its size and sheets."""
    if (os.path.getsize(path) if isinstance(path, str) else path.getbuffer().nbytes) > max_upload:
        raise WorkbookTooLarge(f"file is larger than {max_upload} bytes")
    book = zipfile.ZipFile(path)
    if sum(i.file_size for i in book.infolist()) > UNZIP_FACTOR * max_upload:
        raise WorkbookTooLarge("unpacked workbook is too large")
    if sum(s.visible for s in sheets(book)) > MAX_SHEETS:
        raise WorkbookTooLarge(f"more than {MAX_SHEETS} visible sheets")
    return book


@dataclass(frozen=True)
class Dates:
    """Which cell formats show dates, and the day that serial number 0 stands for."""

    dates: frozenset[int] = frozenset()
    durations: frozenset[int] = frozenset()
    day0: datetime = _DAY0

    @staticmethod
    def of(book: zipfile.ZipFile) -> Dates:
        flag = next(ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}workbookPr"), None)
        day0 = _DAY0_1904 if flag is not None and flag.get("date1904") in ("1", "true") else _DAY0
        if "xl/styles.xml" not in book.namelist():
            return Dates(day0=day0)
        styles = ET.fromstring(book.read("xl/styles.xml"))
        codes = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
        formats = styles.find(f"{_MAIN}cellXfs")
        ids = [int(x.get("numFmtId", 0)) for x in formats] if formats is not None else []
        return Dates(frozenset(i for i, n in enumerate(ids) if _shows_date(n, codes)), frozenset(i for i, n in enumerate(ids) if _shows_duration(n, codes)), day0)

    def text(self, number: str, style: int) -> str | None:
        """The date, time or duration of a serial number as ISO text, null if it stands for none."""
        days = float(number)
        try:
            if style in self.durations:
                return str(timedelta(milliseconds=round(days * 86_400_000)))
            whole, part = divmod(days, 1)
            inside = timedelta(milliseconds=round(part * 86_400_000))
            if 0 <= days < 1 and not inside.days:
                return (datetime.min + inside).time().isoformat()
            whole += 0 < days < 60 and self.day0 == _DAY0  # the format counts a day that 1900 didn't have
            return str(self.day0 + timedelta(days=whole) + inside)
        except (OverflowError, ValueError):
            return None


def _plain(code: str) -> str:
    """The first section of a format without quoted texts, escaped characters and what stands in brackets, durations aside."""
    return re.sub(r'"[^"]*"|\\.|\[(?!(?:h+|m+|s+)\])[^\]]*\]', "", code.split(";")[0], flags=re.I)


def _shows_date(number: int, codes: dict[int, str]) -> bool:
    return bool(re.search("[dmhys]", _plain(codes[number]), re.I)) if number in codes else number in _DATES


def _shows_duration(number: int, codes: dict[int, str]) -> bool:
    return bool(re.search(r"\[(?:h+|m+|s+)\]", _plain(codes[number]), re.I)) if number in codes else number in _DURATIONS


def number_text(number: str) -> str:
    """A stored number as text: an integer as it is, others by the shortest digits of their double, whole ones without a fraction."""
    if not re.search("[.eE]", number):
        return str(int(number))
    x = float(number)
    return str(int(x)) if x.is_integer() else str(x)


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]


def cells(book: zipfile.ZipFile, sheet: Sheet, strings: list[str], max_cells: int = MAX_CELLS, rows_wanted: tuple[float, float] = (1, float("inf"))) -> Iterator[tuple]:
    """(row, col, kind, value, cached, cached_kind) of the cells with a value, streamed; the cells of rows behind the last one wanted aren't read."""
    kinds = {"n": "n", "s": "s", "str": "s", "inlineStr": "s", "b": "b", "e": "e", "d": "d"}
    dates = Dates.of(book)
    row = rows = cols = 0
    with book.open(sheet.part) as f:
        for _, e in ET.iterparse(f):
            if e.tag != f"{_MAIN}row":
                continue
            row = int(e.get("r", row + 1))
            if row > rows_wanted[1]:
                e.clear()
                continue
            col = 0
            for c in e.iter(f"{_MAIN}c"):
                col = _column(c.get("r")) if c.get("r") else col + 1
                kind, v, formula = c.get("t", "n"), c.find(f"{_MAIN}v"), c.find(f"{_MAIN}f")
                text = v.text if v is not None else None
                if kind == "s" and text is not None:
                    text = strings[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                rows, cols = max(rows, row), max(cols, col)
                if rows * cols > max_cells:
                    raise WorkbookTooLarge(f"sheet {sheet.name} has more than {max_cells} cells")
                kind = kinds.get(kind, "s")
                if kind == "n" and text is not None:
                    style = int(c.get("s", 0))
                    date = dates.text(text, style) if style in dates.dates else None
                    kind, text = ("d", date) if date is not None else ("n", number_text(text))
                if formula is not None:
                    yield row, col, "f", "=" + (formula.text or ""), text, kind if text is not None else None
                elif text is not None:
                    yield row, col, kind, text, None, None
            e.clear()


class _File(InputPartition):
    def __init__(self, path: str, sheet: str | None = None):
        super().__init__(path)
        self.path, self.sheet = path, sheet


def _rows_of(book: zipfile.ZipFile, name: str, catalog: bool, wanted: Wanted) -> Iterator[tuple]:
    strings = None if catalog else _shared(book)
    for s in sheets(book):
        if catalog:
            yield name, s.name, s.visible
        elif wanted.sheets is None or s.name in wanted.sheets:
            for cell in cells(book, s, strings, rows_wanted=wanted.rows):
                if wanted.rows[0] <= cell[0] and wanted.cols[0] <= cell[1] <= wanted.cols[1]:
                    yield (name, s.name, s.visible, *cell)


def stored_cells(spark: SparkSession, *paths: str, catalog: bool = False, sheet: str | None = None, max_upload: int = MAX_UPLOAD) -> DataFrame:
    """The same rows for workbooks on any file system that Spark reads, a task per file or several small ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in (_CATALOG if catalog else _SCHEMA).split(", ")]
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                with guarded(io.BytesIO(content), max_upload) as book:
                    found = pd.DataFrame(list(_rows_of(book, file, catalog, Wanted(frozenset([sheet]) if sheet else None))), columns=names)
                    yield found.astype({c: "Int32" for c in ("row", "col") if c in names})

    return contents(spark, *paths).mapInPandas(run, _CATALOG if catalog else _SCHEMA)


def _mounted(options: dict, path: str) -> str:
    """A plain path, which all machines must have."""
    spark = SparkSession.getActiveSession()
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: use stored_cells() to read from another file system, and files.put() to write to it")
    if spark is not None and not spark.sparkContext.master.startswith("local") and options.get("shared", "").lower() != "true":
        raise ValueError(f"{path}: set option shared=true if all machines have this folder")
    return path.removeprefix("file://")


@dataclass(frozen=True)
class Wanted:
    """Which sheets, rows and columns of a workbook are asked for."""

    sheets: frozenset[str] | None = None
    rows: tuple[float, float] = (1, float("inf"))
    cols: tuple[float, float] = (1, float("inf"))

    def narrowed(self, f: Filter) -> Wanted | None:
        """With a filter on sheet, row or col; null if it says something else."""
        name, value = (f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None), getattr(f, "value", None)
        if name == "sheet" and isinstance(f, (EqualTo, In)):
            asked = frozenset([value] if isinstance(f, EqualTo) else value)
            return replace(self, sheets=asked if self.sheets is None else self.sheets & asked)
        if name not in ("row", "col"):
            return None
        low, high = own = self.rows if name == "row" else self.cols
        if isinstance(f, In):  # the range of the values alone: the filter itself is left to Spark
            own = (max(low, min(value)), min(high, max(value)))
        elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            own = (max(low, value + isinstance(f, GreaterThan)) if not isinstance(f, (LessThan, LessThanOrEqual)) else low, min(high, value - isinstance(f, LessThan)) if not isinstance(f, (GreaterThan, GreaterThanOrEqual)) else high)
        else:
            return None
        return replace(self, rows=own) if name == "row" else replace(self, cols=own)


#: Cells of an Arrow batch.
BATCH_CELLS = 8192
_TYPES = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    names, types = zip(*[(n, _TYPES[t]) for n, t in (f.split() for f in schema.split(", "))], strict=True)
    rows = iter(rows)
    while some := list(islice(rows, BATCH_CELLS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], list(names))


class XlsxReader(DataSourceReader):
    """A partition for each sheet that is asked for; a reader of the catalogue opens no sheet."""

    def __init__(self, options: dict):
        self.paths = [_mounted(options, p.strip()) for p in options["path"].split(",")]
        self.catalog = options.get("mode") == "catalog"
        self.wanted = Wanted(frozenset([options["sheet"]]) if options.get("sheet") else None)
        self.max_upload = int(options.get("maxbytes", options.get("maxBytes", MAX_UPLOAD)))

    def partitions(self) -> list[_File]:
        if self.catalog:
            return [_File(p) for p in self.paths]
        out = []
        for p in self.paths:
            with guarded(p, self.max_upload) as book:  # names of sheets alone
                out += [_File(p, s.name) for s in sheets(book) if self.wanted.sheets is None or s.name in self.wanted.sheets]
        return out

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        with guarded(partition.path, self.max_upload) as book:
            yield from _batches(_rows_of(book, partition.path, self.catalog, replace(self.wanted, sheets=frozenset([partition.sheet]))), _CATALOG if self.catalog else _SCHEMA)


class FilteredXlsxReader(XlsxReader):
    """The same with filters: other sheets aren't opened, the cells of rows behind the last one asked for aren't read."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - name of the interface
        for f in filters:
            narrowed = self.wanted.narrowed(f)
            self.wanted = narrowed or self.wanted
            if narrowed is None or isinstance(f, In):
                yield f


def sheet_xml(columns: list[str], rows: Iterator[tuple], write: Callable[[str], object], max_rows: int = MAX_ROWS) -> int:
    """Writes a worksheet piece by piece and returns its number of rows; texts are inline, numbers are numbers, nulls are absent; a formula is an error."""

    def cell(v) -> str:
        if v is None or v == "":
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v}</v></c>"
        if str(v).startswith("="):
            raise ValueError("a cell must not start a formula; encode it first")
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    first = list(islice(rows, 200))  # the widths come from these
    widths = [max(map(_wide, values)) for values in zip(columns, *first, strict=True)]
    cols = "".join(f'<col min="{i}" max="{i}" width="{min(max(w + 2, 10), 60)}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    head = "<row>" + "".join(f'<c t="inlineStr" s="1"><is><t>{escape(c)}</t></is></c>' for c in columns) + "</row>"
    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}">{view}<cols>{cols}</cols><sheetData>{head}')
    n = 0
    for n, r in enumerate(chain(first, rows), 1):
        if n > max_rows:
            raise WorkbookTooLarge(f"more than {max_rows} rows in a sheet")
        write("<row>" + "".join(map(cell, r)) + "</row>")
    write("</sheetData></worksheet>")
    return n


def _wide(v) -> int:
    return max((sum(2 if ord(c) > 0x2E7F else 1 for c in line) for line in str(v if v is not None else "").split("\n")), default=0)


def write_workbook(path: str, tables: dict[str, tuple[list[str], Iterator[tuple]]]) -> int:
    """Writes sheets in order to a hidden part file that is renamed at the end; returns the rows."""
    part = f"{os.path.dirname(path)}/.{os.path.basename(path)}.part"
    total = _write(part, tables)
    os.replace(part, path)
    return total


def workbook_bytes(tables: dict[str, tuple[list[str], Iterator[tuple]]]) -> bytes:
    out = io.BytesIO()
    _write(out, tables)
    return out.getvalue()


def _write(target: str | io.BytesIO, tables: dict[str, tuple[list[str], Iterator[tuple]]]) -> int:
    total, names = 0, list(tables)
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for i, name in enumerate(names, 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f, io.TextIOWrapper(f, "utf-8", newline="") as text:
                total += sheet_xml(*tables[name], text.write)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>")
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{pkg}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="s{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{pkg}/relationships">' + "".join(f'<Relationship Id="s{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + f'<Relationship Id="st" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0"?><styleSheet xmlns="{_MAIN[1:-1]}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
    return total


@dataclass
class _Written(WriterCommitMessage):
    path: str | None
    part: int
    rows: int


class _Parts:
    """Workbooks of a job: every attempt of a task writes a hidden file of its own, what is committed gets its name at the end, all others go."""

    def __init__(self, schema: StructType, options: dict):
        self.columns, self.folder, self.sheet = schema.names, _mounted(options, options["path"]), options.get("sheet", "Sheet1")
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        rows = map(tuple, rows)
        first = list(islice(rows, 1))
        if not first and task.partitionId():
            return _Written(None, task.partitionId(), 0)
        os.makedirs(self.folder, exist_ok=True)
        path = f"{self.folder}/.{self.job}-{task.partitionId():05d}-{task.taskAttemptId()}.xlsx"
        return _Written(path, task.partitionId(), _write(path, {self.sheet: (self.columns, chain(first, rows))}))

    def _publish(self, messages: list, name: str) -> None:
        for m in messages:
            if m and m.path:
                os.replace(m.path, f"{self.folder}/{name.format(m.part)}")
        self._clear()

    def _clear(self) -> None:
        for f in os.listdir(self.folder) if os.path.isdir(self.folder) else ():
            if f.startswith(f".{self.job}-"):
                os.remove(f"{self.folder}/{f}")


class XlsxWriter(_Parts, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self._publish(messages, "part-{:05d}.xlsx")
        with open(f"{self.folder}/_SUCCESS", "w"):
            pass

    def abort(self, messages: list) -> None:
        self._clear()


class XlsxStreamWriter(_Parts, DataSourceStreamWriter):
    """The same for a stream: the files of a micro-batch are named by its number, so one that is repeated replaces its own."""

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803 - name of the interface
        self._publish(messages, f"batch-{batchId:05d}-part-{{:05d}}.xlsx")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._clear()


class XlsxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return _CATALOG if self.options.get("mode") == "catalog" else _SCHEMA

    def reader(self, schema: StructType) -> XlsxReader:
        filtered = self.options.get("pushdown", "").lower() == "true" and self.options.get("mode") != "catalog"
        return (FilteredXlsxReader if filtered else XlsxReader)(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(schema, dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> XlsxStreamWriter:  # noqa: N802 - name of the interface
        return XlsxStreamWriter(schema, dict(self.options))
