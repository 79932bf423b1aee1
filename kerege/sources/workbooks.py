"""Cells of spreadsheet files, and a Spark data source for them.

`spark.read.format("xlsx_cells").load(folder)` has a row for each filled cell: path, sheet, r, c, v, error. Files are opened where they lie by the tasks that read them (Arrow's
file systems: local or mounted, HDFS, S3, Google, Azure), so that no file passes through the JVM; of an archive only its directory and the wanted sheet are read, row by row.
Filters on path and sheet are taken over: they decide which files and sheets are opened; those on r and c are applied as cells are read. The same source can be read as a stream.
"""

from __future__ import annotations

import fnmatch
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from kerege.shipping import ship_package

SCHEMA = "path string, sheet string, r int, c int, v string, error string"
_ARROW = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("r", pa.int32()), ("c", pa.int32()), ("v", pa.string()), ("error", pa.string())])
#: Bytes of files that a task takes, files at most, and cells that it hands on at once.
SHARE = 64 << 20
FILES = 500
CELLS = 10_000

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Numbers of built-in number formats that show dates.
_DATE_FORMATS = {14, 15, 16, 17, 22, 27, 30, 36, 50, 57}


class Workbook:
    """A spreadsheet file: its sheets' names, the active one, and their cells."""

    def __init__(self, source: IO[bytes]):
        self.archive = zipfile.ZipFile(source)
        book, links = self._parsed("xl/workbook.xml"), self._parsed("xl/_rels/workbook.xml.rels")
        targets = {x.get("Id"): x.get("Target") for x in links}
        sheets = list(book.find(f"{_MAIN}sheets"))
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = {x.get("name", str(k)): place(targets[x.get(f"{_REL}id")]) for k, x in enumerate(sheets)}
        view = book.find(f"{_MAIN}bookViews/{_MAIN}workbookView")
        active = int(view.get("activeTab", 0)) if view is not None else 0
        self.active = list(self.sheets)[min(active, len(sheets) - 1)]
        strings = self._parsed("xl/sharedStrings.xml")
        self.shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in strings] if strings is not None else []
        self.dated = self._dated_styles()

    def _parsed(self, name: str) -> ElementTree.Element | None:
        return ElementTree.fromstring(self.archive.read(name)) if name in self.archive.namelist() else None

    def _dated_styles(self) -> list[bool]:
        """For each cell style: does it show a date?"""
        styles = self._parsed("xl/styles.xml")
        if styles is None:
            return []
        own = {int(x.get("numFmtId", 0)): x.get("formatCode", "") for x in styles.iter(f"{_MAIN}numFmt")}
        shown = lambda k: k in _DATE_FORMATS or bool(re.search(r"[yd]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(k, "")).lower()))
        cells = styles.find(f"{_MAIN}cellXfs")
        return [shown(int(x.get("numFmtId", 0))) for x in cells] if cells is not None else []

    def cells(self, sheet: str | None = None) -> Iterator[tuple[int, int, str]]:
        """(row, column, text) of a sheet's filled cells (the active one's by default) in their order, from 1; formulas give their stored values, dates their ISO form.

        Rows and cells that don't say their place follow the one before. A row is forgotten once it has been read.
        """
        with self.archive.open(self.sheets[sheet or self.active]) as part:
            row = column = 0
            for event, x in ElementTree.iterparse(part, ("start", "end")):
                if x.tag == f"{_MAIN}row":
                    if event == "start":
                        row, column = int(x.get("r", row + 1)), 0
                    else:
                        x.clear()
                elif x.tag == f"{_MAIN}c" and event == "end":
                    row, column = _place(x.get("r"), row, column + 1)
                    text = self._text(x)
                    if text is not None:
                        yield row, column, text

    def _text(self, cell: ElementTree.Element) -> str | None:
        kind, value = cell.get("t", "n"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
        if value is None or value.text is None:
            return None
        text, style = self.shared[int(value.text)] if kind == "s" else value.text, int(cell.get("s", 0))
        if kind == "n" and style < len(self.dated) and self.dated[style]:
            text = (datetime(1899, 12, 30) + timedelta(days=float(text))).strftime("%Y-%m-%d")
        return text


def _place(named: str | None, row: int, column: int) -> tuple[int, int]:
    if not named:
        return row, column
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", named).groups()
    column = 0
    for letter in letters:
        column = column * 26 + ord(letter) - 64
    return int(digits), column


class Share(D.InputPartition):
    """Files that one task reads, each with its sheets' wanted names (None: the active one)."""

    def __init__(self, paths: list[str]):
        self.paths = paths


def _system(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path on it, and what makes a path on it a URI again."""
    path = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/(?!/)", "file:///", path))
    if not re.match(r"[a-z0-9]+://", path):
        return fs.LocalFileSystem(), path, "file://"
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: path.index(inner)] if inner in path else ""


def _listed(options: dict) -> list[tuple[str, int, int]]:
    """(URI, bytes, time of change) of the files below the path, in order of their URIs."""
    system, path, prefix = _system(options["path"])
    told = system.get_file_info(path)
    found = [told] if told.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
    pattern = options.get("pattern", "*.xlsx").lower()
    return sorted((f"{prefix}{f.path}", f.size, f.mtime_ns or 0) for f in found if f.is_file and fnmatch.fnmatch(f.base_name.lower(), pattern))


def _shares(found: list[tuple[str, int, int]]) -> list[Share]:
    out, paths, size = [], [], 0
    for path, length, _ in found:
        if paths and (size + length > SHARE or len(paths) >= FILES):
            out.append(Share(paths))
            paths, size = [], 0
        paths.append(path)
        size += length
    return [*out, Share(paths)] if paths else out


class _Cells:
    """Reading files to batches, and the filters that were taken over."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.tests: dict[str, list] = {"path": [], "sheet": [], "r": [], "c": []}

    def passes(self, column: str, value) -> bool:
        return all(_holds(f, value) for f in self.tests[column])

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for path in partition.paths:
            try:
                for row in self._file(path):
                    rows.append(row)
                    if len(rows) >= CELLS:
                        yield _batch(rows)
                        rows = []
            except Exception as told:  # whatever is wrong with one file is said of it, and the others go on
                rows.append((path, None, None, None, None, f"{type(told).__name__}: {told}"))
        if rows:
            yield _batch(rows)

    def _file(self, path: str) -> Iterator[tuple]:
        system, inner, _ = _system(path)
        with system.open_input_file(inner) as source:
            book = Workbook(source)
            told = self.options.get("sheet", "")
            names = [book.active] if not told else list(book.sheets) if told == "*" else [n for n in book.sheets if n == told]
            for name in names:
                if self.passes("sheet", name):
                    for r, c, v in book.cells(name):
                        if self.passes("r", r) and self.passes("c", c):
                            yield path, name, r, c, v, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


_COMPARED = {D.EqualTo: lambda a, b: a == b, D.In: lambda a, b: a in b, D.GreaterThan: lambda a, b: a > b, D.GreaterThanOrEqual: lambda a, b: a >= b, D.LessThan: lambda a, b: a < b, D.LessThanOrEqual: lambda a, b: a <= b, D.StringStartsWith: str.startswith, D.StringEndsWith: str.endswith, D.StringContains: lambda a, b: b in a}


def _holds(test: D.Filter, value) -> bool:
    return _COMPARED[type(test)](value, test.value)


class CellReader(_Cells, D.DataSourceReader):
    """The cells of all files as they are when the plan is made."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:  # noqa: N802
        """Filters on path, sheet, r and c are applied here; as a file that can't be read has no cell, those on its other columns are Spark's too."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in _COMPARED and column in self.tests:
                self.tests[column].append(f)
                if column == "path":
                    continue
            yield f

    def partitions(self) -> list[Share]:
        return _shares([x for x in _listed(self.options) if self.passes("path", x[0])])


class CellStream(_Cells, D.DataSourceStreamReader):
    """The cells of files as they arrive, each once.

    An offset is the latest time of change so far and the files that have it: later files come next, also others of the same time. A file that arrives with an
    older time of change than one that was read is not seen.
    """

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": -1, "names": []}

    def latestOffset(self) -> dict:  # noqa: N802
        found = _listed(self.options)
        at = max((t for _, _, t in found), default=-1)
        return {"at": at, "names": [p for p, _, t in found if t == at]}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        new = lambda p, t: (t > start["at"] or (t == start["at"] and p not in start["names"])) and (t < end["at"] or (t == end["at"] and p in end["names"]))
        return _shares([x for x in _listed(self.options) if new(x[0], x[2])])


class XlsxCells(D.DataSource):
    """Options: path (a file or folder), pattern (of file names, *.xlsx), sheet (a name, or * for all; the active one without it)."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CellReader:
        return CellReader(self.options)

    def streamReader(self, schema: StructType) -> CellStream:  # noqa: N802
        return CellStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters handed to it."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(XlsxCells)
