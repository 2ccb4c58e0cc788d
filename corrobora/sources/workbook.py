"""Spreadsheet files as rows of cells, and the outcome catalogue from one of them."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: The framework's categories, and how many outcomes they have.
CATEGORIES = "GV.OC GV.RM GV.RR GV.PO GV.OV GV.SC ID.AM ID.RA ID.IM PR.AA PR.AT PR.DS PR.PS PR.IR DE.CM DE.AE RS.MA RS.AN RS.CO RS.MI RC.RP RC.CO".split()
OUTCOMES = 106
#: How a catalogue sheet's cells begin a function, begin a category, and hold an outcome.
FUNCTION = r"^([A-Z][A-Za-z]+) \(([A-Z]{2})\):"
CATEGORY = r"^(.+?) \(([A-Z]{2}\.[A-Z]{2})\):"
OUTCOME = r"(?s)^([A-Z]{2}\.[A-Z]{2}-\d{2}):\s*(.+)$"
WITHDRAWN = r"(?i)^\[withdrawn"

CELLS = "path string, sheet int, row int, col string, value string"
_CELLS = pa.schema([("path", pa.string()), ("sheet", pa.int32()), ("row", pa.int32()), ("col", pa.string()), ("value", pa.string())])


class WorkbookError(ValueError):
    """A workbook that cannot be read, or does not hold the catalogue."""


def _text(node) -> str:
    """A string's runs one after another, without what is only said about how it is read aloud."""
    return "".join(t.text or "" for r in node if r.tag in (f"{MAIN}t", f"{MAIN}r") for t in ([r] if r.tag == f"{MAIN}t" else r.iter(f"{MAIN}t")))


def sheets(content: bytes) -> Iterator[tuple[int, int, str, str]]:
    """(sheet, row, column, value) of all cells that have a value; sheets are numbered from 1 as the workbook lists them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for number, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"), 1):
            target = targets.get(sheet.get(RELATION), "")
            name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if name not in names:
                continue
            row = 0
            with z.open(name) as part:
                for _, node in ElementTree.iterparse(part):
                    if node.tag != f"{MAIN}row":
                        continue
                    row = int(node.get("r", row + 1))
                    column = 0
                    for cell in node.iter(f"{MAIN}c"):
                        letters = re.match("[A-Z]*", cell.get("r", ""))[0]
                        column = _number(letters) if letters else column + 1
                        held = cell.find(f"{MAIN}v")
                        if cell.get("t") == "inlineStr":
                            value = _text(cell.find(f"{MAIN}is")) if cell.find(f"{MAIN}is") is not None else None
                        else:
                            value = held.text if held is not None else None
                            if value is not None and cell.get("t") == "s":
                                value = shared[int(value)]
                        if value is not None:
                            yield number, row, _letters(column), value
                    node.clear()


def _number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def _letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                rows = [(path, *cell) for cell in sheets(content or b"")]
            except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError) as error:
                raise WorkbookError(f"{path}: {error}") from error
            for a in range(0, len(rows), 4096):
                yield pa.record_batch([list(c) for c in zip(*rows[a : a + 4096], strict=True)], schema=_CELLS)


def cells(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, sheet, row, col, value) of (path, content) rows; a file that is no workbook is an error."""
    return files.select(F.col(path).cast("string"), F.col(content).cast("binary")).mapInArrow(_read, CELLS)


def catalogue(found: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """(path, row, id, function_id, function, category_id, category, outcome) of one catalogue sheet per path.

    A cell ``NAME (ID): ...`` in column A begins a function, ``Name (ID.CAT): ...`` in B a category, ``ID.CAT-nn: text``
    in C is an outcome of both. Withdrawn outcomes and those of other categories are left out. A sheet has about a
    million rows at most, which one window takes in order.
    """
    cell = lambda c: F.max(F.when(F.col("col") == c, F.col("value"))).alias(c)
    rows = found.groupBy("path", "row").agg(cell("A"), cell("B"), cell("C"))
    part = lambda c, pattern, k: F.when(F.col(c).rlike(pattern), F.regexp_extract(c, pattern, k))
    before = Window.partitionBy("path").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    named = rows.select("path", "row", last(part("A", FUNCTION, 1)).alias("function"), last(part("A", FUNCTION, 2)).alias("function_id"), last(part("B", CATEGORY, 1)).alias("category_name"), last(part("B", CATEGORY, 2)).alias("category_id"), part("C", OUTCOME, 1).alias("id"), F.regexp_replace(part("C", OUTCOME, 2), r"^\s+|\s+$", "").alias("outcome"))
    kept = named.where(F.col("id").isNotNull() & F.col("category_id").isin(CATEGORIES if categories is None else categories) & ~F.col("outcome").rlike(WITHDRAWN))
    return kept.select("path", "row", "id", "function_id", "function", "category_id", F.concat("category_name", F.lit(" ("), "category_id", F.lit(")")).alias("category"), "outcome")


def build(spark: SparkSession, workbook: str, out: str, sheet: int = 2, categories: list[str] | None = None, expected: int | None = OUTCOMES, version: str = "CSF 2.0") -> int:
    """Writes the catalogue file that ``sources.catalogue.load`` reads; returns the number of outcomes.

    Another number than ``expected`` is an error, as the workbook then has another form than is known here.
    """
    files = spark.read.format("binaryFile").load(workbook).select("path", "content")
    rows = catalogue(cells(files).where(F.col("sheet") == sheet), categories).orderBy("row").collect()  # a catalogue's rows
    if expected is not None and len(rows) != expected:
        raise WorkbookError(f"{workbook}: {len(rows)} outcomes instead of {expected}")
    functions = [{"id": k, "name": v} for k, v in dict((r.function_id, r.function) for r in rows).items()]
    made = {"frameworkVersion": version, "source": workbook, "sample": False, "functions": functions, "subcategories": [{"function": r.function, "category": r.category, "id": r.id, "outcome": r.outcome} for r in rows]}
    with open(out, "w", encoding="utf-8") as f:
        f.write(json.dumps(made, indent=2, ensure_ascii=False) + "\n")
    return len(rows)
