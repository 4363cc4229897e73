"""Spreadsheet sources: workbooks read in parts through Spark's file systems, and the checks before that.

A workbook is a zip of XML parts.  Records come as row_number, sheet_name, values map<string, string> and
value_types map<string, string>; the first row names the columns (blank: `Unnamed: N`; of equal names the
last value stays), rows whose every cell is empty are skipped and reported as warnings.

A compressed part can only be inflated from its start, which is quick; making records of it is what takes
time.  So `sheet_parts` inflates each workbook once, in a task of its own, and cuts the sheet's XML after
whole rows into parts of about PART_BYTES, each with what it needs by itself: the header's names, the number of the row
before it, the namespaces, the shared strings that its cells name, the styles that are dates.  The
parts are then dealt out and parsed, `spark.read.format("xlsx")` reads a local file in one partition.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from dossier.functions.cut import checkpointed

SCHEMA = "row_number int, sheet_name string, values map<string,string>, value_types map<string,string>"
#: Bytes of a sheet's XML in a part.
PART_BYTES = 4 << 20
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATES = {*range(14, 23), *range(45, 48)}


class ImportFailure(ValueError):
    """Anything that stops an import before its first row."""


class FileMissing(ImportFailure):
    pass


class UnsupportedFile(ImportFailure):
    pass


class CorruptedSource(ImportFailure):
    pass


class SheetUnknown(ImportFailure):
    pass


class EmptySource(ImportFailure):
    pass


class Workbook:
    """The sheets of a file; formulas as their last computed values.  data: the file's bytes, where it is not local."""

    def __init__(self, path: str, data: bytes | None = None):
        path = re.sub("^file:(//)?", "", path)
        if data is None and not os.path.exists(path):
            raise FileMissing(path)
        supported(path)
        try:
            self.zip = zipfile.ZipFile(path if data is None else io.BytesIO(data))
            book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
            links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
            self.parts = {s.get("name"): self._part(links[s.get(_REL)]) for s in book.iter(f"{_NS}sheet")}
            names = self.zip.namelist()
            shared = ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else []
            self.shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in shared]
            self.dates = self._date_styles() if "xl/styles.xml" in names else set()
        except Exception as e:
            raise CorruptedSource(f"{path}: {e}") from e

    @staticmethod
    def _part(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def _date_styles(self) -> set[int]:
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")) for f in root.iter(f"{_NS}numFmt") if re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
        cells = root.find(f"{_NS}cellXfs")
        return {k for k, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in _DATES | own}

    def _value(self, cell) -> Any:
        return _cell(cell, self.shared.__getitem__, self.dates)

    def rows(self, sheet: str) -> Iterator[tuple[int, list[Any]]]:
        """Row number (from 1) and cells, gaps as None."""
        if sheet not in self.parts:
            raise SheetUnknown(sheet)
        with self.zip.open(self.parts[sheet]) as f:
            yield from _rows(f, 0, self._value)

    def parts_of(self, sheet: str, size: int) -> Iterator[tuple[int, int, bytes]]:
        """The number of the row before each part of a sheet, how many rows it has, and its XML: a whole document of whole rows."""
        if sheet not in self.parts:
            raise SheetUnknown(sheet)
        with self.zip.open(self.parts[sheet]) as f:
            raw = b""
            while not (head := re.search(rb"<((?:\w+:)?)sheetData\b[^>]*>", raw)):
                more = f.read(1 << 16)
                if not more:
                    return
                raw += more
            prefix, root = head[1], re.search(rb"<(?:\w+:)?worksheet\b[^>]*>", raw)
            if head[0].endswith(b"/>"):
                return
            start, end = (root[0] if root else b"<worksheet>"), b"</" + prefix + b"worksheet>"
            close, over = b"</" + prefix + b"row>", b"</" + prefix + b"sheetData>"
            raw, before, ended = raw[head.end() :], 0, False
            while True:
                while len(raw) < size and not ended:
                    more = f.read(size)
                    raw, ended = raw + more, not more
                stop = raw.find(over)
                limit = stop if stop >= 0 else len(raw)
                # After the last whole row of the part's size; a longer row is a part of its own.
                at = raw.rfind(close, 0, min(limit, size))
                at = at if at >= 0 else raw.find(close, 0, limit)
                last = stop >= 0 and raw.find(close, at + 1, stop) < 0
                if at < 0 and stop < 0:
                    more = f.read(size)
                    if not more:
                        raise CorruptedSource(f"sheet {sheet} has no end")
                    raw += more
                    continue
                cut = stop if last else at + len(close)
                part, raw = raw[:cut], raw[cut:]
                tags = re.findall(rb"<(?:\w+:)?row\b([^>]*)>", part)
                if tags:
                    at = before
                    for tag in tags:
                        own = re.search(rb"\br=[\"'](\d+)", tag)
                        at = int(own[1]) if own else at + 1
                    yield before, len(tags), start + part + end
                    before = at
                if last:
                    return

    def summary(self, sheet: str) -> tuple[int, int]:
        """Data rows (below the header) and columns."""
        last, width = 0, 0
        for at, cells in self.rows(sheet):
            last, width = at, max(width, len(cells))
        return max(last - 1, 0), width

    def _fits(self, sheet: str) -> bool:
        """Whether it has 3 columns and a data row; no more is read than says so."""
        width = 0
        for at, cells in self.rows(sheet):
            width = max(width, len(cells))
            if at > 1 and width >= 3:
                return True
        return False

    def select(self, sheet: str | None = None) -> tuple[str, list[tuple[str, str]]]:
        """The sheet to read and warnings: the one asked for, the only one, or the only one with 3 columns and a row."""
        if sheet is not None:
            if sheet not in self.parts:
                raise SheetUnknown(f"{sheet}; there are {', '.join(self.parts)}")
            return sheet, []
        if len(self.parts) == 1:
            return next(iter(self.parts)), []
        fit = [s for s in self.parts if self._fits(s)]
        if len(fit) != 1:
            raise SheetUnknown(f"name one of {', '.join(self.parts)}")
        return fit[0], [("SHEET_AUTO_SELECTED", f"Sheet '{fit[0]}' was selected.")]


def supported(path: str) -> None:
    if os.path.splitext(path)[1].lower() not in (".xlsx", ".xlsm"):
        raise UnsupportedFile(path)


def _cell(cell, shared, dates) -> Any:
    """A cell's value.  shared: the text of a shared string's number."""
    kind, v = cell.get("t", "n"), cell.find(f"{_NS}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared(int(v.text))
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "e", "d"):
        return v.text
    number = float(v.text)
    if int(cell.get("s", 0)) in dates:
        return datetime(1899, 12, 30) + timedelta(days=number)
    return int(number) if number.is_integer() and not re.search("[.eE]", v.text) else number


def _rows(xml, at: int, value) -> Iterator[tuple[int, list[Any]]]:
    """Row numbers and cells (gaps as None) of a stream of XML whose rows follow row `at`."""
    for _, e in ElementTree.iterparse(xml):
        if e.tag != f"{_NS}row":
            continue
        at = int(e.get("r", at + 1))
        cells: list[Any] = []
        for c in e.iter(f"{_NS}c"):
            letters = re.match("[A-Z]*", c.get("r", ""))[0]
            k = len(cells)
            if letters:
                k = 0
                for x in letters:
                    k = k * 26 + ord(x) - 64
                k -= 1
            cells += [None] * (k + 1 - len(cells))
            cells[k] = value(c)
        yield at, cells
        e.clear()


def headers(cells: list[Any]) -> list[str]:
    return [str(c).strip() if c is not None and str(c).strip() else f"Unnamed: {k}" for k, c in enumerate(cells)]


def _records(path: str, sheet: str | None) -> Iterator[tuple[int, str, list[str], list[Any]]]:
    book = Workbook(path)
    sheet, _ = book.select(sheet)
    names: list[str] | None = None
    for at, cells in book.rows(sheet):
        if names is None:
            names = headers(cells)
        else:
            yield at, sheet, names, cells + [None] * (len(names) - len(cells))


class XlsxSource(DataSource):
    """Options: path, sheet."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return XlsxReader(self.options)


class XlsxReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.sheet = options.get("path"), options.get("sheet")

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        for at, sheet, names, cells in _records(self.path, self.sheet):
            if all(c is None for c in cells):
                continue
            values = dict(zip(names, cells))
            yield at, sheet, {k: None if v is None else str(v) for k, v in values.items()}, {k: type(v).__name__ for k, v in values.items() if v is not None}


_PART = "path string, sheet string, part int, before int, rows int, names array<string>, strings map<int,string>, dates array<int>, xml binary, sheets array<string>, selected string, problem string, kind string"
_NAMED = re.compile(rb"""\bt=["']s["'][^>]*>(?:<(?:\w+:)?f\b[^>]*/>|<(?:\w+:)?f\b[^>]*>.*?</(?:\w+:)?f>)?\s*<(?:\w+:)?v>(\d+)<""", re.S)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "map<int,string>": pa.map_(pa.int32(), pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string()), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([pa.field(n, kinds[k]) for n, k in (x.split(" ") for x in schema.split(", "))])


def sheet_parts(files: DataFrame, sheet: str | None = None, size: int | None = None) -> DataFrame:
    """files (path, content) as the parts of their sheets, one line each, and a line of part -1 for each file: its sheets, a
    warning (selected) or what stops the import (problem, kind)."""
    size = size or PART_BYTES

    def lines(path: str, data: bytes) -> Iterator[dict]:
        own = {"path": path, "part": -1, "before": 0, "rows": 0}
        try:
            book = Workbook(path, data)
            chosen, said = book.select(sheet)
        except ImportFailure as problem:
            yield own | {"problem": str(problem), "kind": type(problem).__name__}
            return
        yield own | {"sheet": chosen, "sheets": list(book.parts), "selected": said[0][1] if said else None}
        names, dates = None, sorted(book.dates)
        try:
            for k, (before, rows, xml) in enumerate(book.parts_of(chosen, size)):
                if names is None:
                    names = headers(next(_rows(io.BytesIO(xml), before, book._value))[1])
                used = {int(x) for x in set(_NAMED.findall(xml))}
                yield own | {"sheet": chosen, "part": k, "before": before, "rows": rows, "names": names, "strings": [(i, book.shared[i]) for i in sorted(used)], "dates": dates, "xml": xml}
        except Exception as problem:  # noqa: BLE001 - the file is broken past its directory
            yield own | {"problem": f"{path}: {problem}", "kind": "CorruptedSource"}

    schema = _arrow(_PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                for line in lines(row["path"], row["content"]):
                    yield pa.RecordBatch.from_pylist([line], schema=schema)

    return files.select("path", "content").mapInArrow(run, _PART)


_PARSED = "row_number int, sheet_name string, values map<string,string>, value_types map<string,string>, path string, blank boolean"


def parsed_rows(parts: DataFrame) -> DataFrame:
    """Records of parts, the blank ones marked; the header row is none."""
    schema = _arrow(_PARSED)

    def records(p: dict) -> Iterator[dict]:
        shared, names, dates = dict(p["strings"] or []), p["names"], set(p["dates"] or [])
        for k, (at, cells) in enumerate(_rows(io.BytesIO(p["xml"]), p["before"], lambda c: _cell(c, shared.__getitem__, dates))):
            if p["part"] == 0 and k == 0:
                continue
            cells = cells + [None] * (len(names) - len(cells))
            values, blank = dict(zip(names, cells)), all(c is None for c in cells)
            yield {"row_number": at, "sheet_name": p["sheet"], "values": None if blank else [(n, None if v is None else str(v)) for n, v in values.items()], "value_types": None if blank else [(n, type(v).__name__) for n, v in values.items() if v is not None], "path": p["path"], "blank": blank}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held = []
                for r in records(batch.slice(k, 1).to_pylist()[0]):
                    held.append(r)
                    if len(held) == 2000:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return parts.mapInArrow(run, _PARSED)


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None, size: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records of all workbooks at a path (a file, folder or pattern of any file system that Spark reads), with the path of
    each; import warnings; and a line a workbook: path, sheets, sheet, names, row_count, problem, kind.

    A workbook that cannot be read is a line with a problem and stops no other."""
    try:
        files = spark.read.format("binaryFile").load(path)
    except AnalysisException as problem:
        raise FileMissing(path) from problem
    # Inflated once; every part is read by one task.
    parts = checkpointed(sheet_parts(files, sheet, size))
    n = parts.where("part >= 0").count()
    rows = checkpointed(parsed_rows(parts.where("part >= 0").repartition(max(1, n), "path", "part")))
    book = parts.groupBy("path").agg(
        F.first("sheets", True).alias("sheets"), F.first("sheet", True).alias("sheet"), F.first("names", True).alias("names"), F.first("selected", True).alias("selected"),
        F.first("problem", True).alias("problem"), F.first("kind", True).alias("kind"),
    )
    counts = rows.groupBy("path").agg(F.count_if(~F.col("blank")).alias("row_count"))
    books = book.join(counts, "path", "left").na.fill(0, ["row_count"])
    line = lambda code, message, at, column: F.struct(F.lit(code).alias("code"), message.alias("message"), at.alias("row_number"), column.alias("column_name"))
    none = F.lit(None)
    chosen = books.where("selected is not null").select("path", line("SHEET_AUTO_SELECTED", F.col("selected"), none.cast("int"), none.cast("string")).alias("w"))
    twice = books.select("path", F.explode(F.filter(F.array_distinct("names"), lambda x: F.size(F.filter("names", lambda y: y == x)) > 1)).alias("n")).select("path", line("DUPLICATE_COLUMN", F.concat(F.lit("Column '"), F.col("n"), F.lit("' stands more than once; the last value is kept.")), none.cast("int"), F.col("n")).alias("w"))
    blank = rows.where("blank").select("path", line("SKIPPED_BLANK_ROW", F.concat(F.lit("Row "), F.col("row_number").cast("string"), F.lit(" is blank.")), F.col("row_number"), none.cast("string")).alias("w"))
    warnings = chosen.unionByName(twice).unionByName(blank).select("path", "w.*")
    return rows.where("not blank").drop("blank"), warnings, books.drop("selected")


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Records of one workbook, import warnings (code, message, row_number, column_name), and metadata.  Raises where the
    workbook cannot be read or holds no records."""
    supported(path)
    rows, warnings, books = read_workbooks(spark, path, sheet)
    book = books.first()
    if book["problem"]:
        raise {c.__name__: c for c in (FileMissing, UnsupportedFile, CorruptedSource, SheetUnknown, EmptySource)}[book["kind"]](book["problem"])
    if not book["row_count"]:
        raise EmptySource(path)
    meta = {"source_path": path, "source_type": "excel", "sheet_name": book["sheet"], "available_sheets": book["sheets"], "column_names": book["names"], "row_count": book["row_count"]}
    return rows.drop("path"), warnings.drop("path"), meta


def discover(pattern: str) -> str:
    """The first file that fits a pattern, by name."""
    import glob

    found = sorted(glob.glob(pattern))
    if not found:
        raise FileMissing(pattern)
    return found[0]
