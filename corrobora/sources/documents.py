"""Documents as segments: discovery, readers by format, and a report per file.

A reader turns bytes into (segments, warnings, status, reason); a file that cannot be read is a row with
status ``failed``, not an error of the job.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrobora.functions import text as T
from corrobora.operators.ordering import with_position
from corrobora.sources.pdf import read_pdf

SEGMENTS = "array<struct<text:string,page:int>>"
PARSED = f"path string, file string, format string, segments {SEGMENTS}, warnings array<string>, status string, reason string"
_SCHEMA = pa.schema([
    ("path", pa.string()), ("file", pa.string()), ("format", pa.string()),
    ("segments", pa.list_(pa.struct([("text", pa.string()), ("page", pa.int32())]))), ("warnings", pa.list_(pa.string())),
    ("status", pa.string()), ("reason", pa.string()),
])
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def supported(path: Column | str) -> Column:
    """A known extension, and no hidden or ignored part on the way."""
    c = F.col(path) if isinstance(path, str) else path
    hidden = c.rlike(r"(^|/)(\.[^/]|node_modules/|\.git/)")
    return T.extension(c).isin(*T.EXTENSIONS) & ~hidden


def discover(paths: DataFrame, column: str = "path") -> DataFrame:
    """(path, pos): the supported paths by base name, then path, in the locale's order, numbered from 0."""
    kept = paths.select(F.col(column).alias("path")).where(supported("path"))
    return with_position(kept, "pos", F.collate(T.basename("path"), "UNICODE"), F.collate("path", "UNICODE"), F.col("path"))


def read_text(content: bytes) -> tuple[list, list]:
    return [(content.decode("utf-8", "replace").removeprefix("\ufeff"), None)], []


def read_docx(content: bytes) -> tuple[list, list]:
    """Raw text of the body: paragraphs end in an empty line, tabs and breaks are kept."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    kinds = {f"{WORD}t": None, f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}
    paragraphs = ["".join((e.text or "") if kinds[e.tag] is None else kinds[e.tag] for e in p.iter() if e.tag in kinds) for p in root.iter(f"{WORD}p")]
    return [("".join(p + "\n\n" for p in paragraphs), None)], []


READERS = {".txt": ("text", read_text), ".md": ("markdown", read_text), ".markdown": ("markdown", read_text), ".docx": ("docx", read_docx), ".pdf": ("pdf", read_pdf)}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            name = path.rsplit("/", 1)[-1]
            kind = READERS.get(("." + name.rsplit(".", 1)[-1]).lower()) if "." in name else None
            if kind is None:
                rows.append((path, name, None, [], [], "failed", "unsupported file type"))
                continue
            try:
                segments, warnings = kind[1](content or b"")
            except Exception as error:  # noqa: BLE001  one file's failure is its own row
                rows.append((path, name, kind[0], [], [], "failed", str(error) or type(error).__name__))
                continue
            some = any((t or "").strip() for t, _ in segments)
            rows.append((path, name, kind[0], [{"text": t, "page": p} for t, p in segments], warnings, "parsed" if some else "skipped", None if some else "no text"))
        yield pa.record_batch([list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in _SCHEMA], schema=_SCHEMA)


def parse(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One parsed document per (path, content) row; see PARSED."""
    return files.select(F.col(path).cast("string"), F.col(content).cast("binary")).mapInArrow(_parse, PARSED)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed documents of a folder that Spark can list; unsupported and hidden files are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return parse(files.where(supported(F.replace("path", F.lit(folder), F.lit("")))))


def report(parsed: DataFrame) -> DataFrame:
    """(status, n) over parsed, skipped and failed files."""
    return parsed.groupBy("status").agg(F.count("*").alias("n"))


def text_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of a text table as one-segment documents: (doc_id, page, text) with a leading byte order mark cut."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.lit(None).cast("int").alias("page"), F.when(text.startswith("\ufeff"), F.substring(text, 2, 2**31 - 1)).otherwise(text).alias("text"))


def ordinals(segments: DataFrame, key: str, *order: str) -> DataFrame:
    """Numbers a document's rows from 0 in order."""
    return segments.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
