"""Workbooks made of texts: input for the query and tests of the reader."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa

NAMES = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
#: Characters that XML cannot hold.
BARRED = dict.fromkeys([*range(9), 11, 12, *range(14, 32), 0xFFFE, 0xFFFF])


def made(*sheets: list[list[str | None]], inline: bool = False) -> bytes:
    """A workbook of sheets of rows of cells; strings are shared, or else with their cells."""
    shared: dict[str, int] = {}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, rows in enumerate(sheets, 1):
            body = []
            for r, row in enumerate(rows, 1):
                line = []
                for c, value in enumerate(row):
                    if value is None:
                        continue
                    place = f"{chr(65 + c)}{r}"
                    if inline:
                        line.append(f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>')
                    else:
                        line.append(f'<c r="{place}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>')
                body.append(f'<row r="{r}">{"".join(line)}</row>')
            z.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {NAMES}><sheetData>{''.join(body)}</sheetData></worksheet>")
        if not inline:
            z.writestr("xl/sharedStrings.xml", f"<sst {NAMES}>{''.join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in shared)}</sst>")
        links = "".join(f'<sheet name="S{n}" sheetId="{n}" r:id="rId{n}"/>' for n in range(1, len(sheets) + 1))
        z.writestr("xl/workbook.xml", f'<workbook {NAMES} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{links}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{n}" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1)) + "</Relationships>")
    return out.getvalue()


def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (path, content): the lines in column C of the second sheet, each with its language beside it."""
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            rows = list(zip(*(c.slice(a, 64).to_pylist() for c in batch.columns), strict=True))
            made_of = lambda k, t, lang: made([["Introduction"]], [[None, lang, line.translate(BARRED)] for line in (t or "").split("\n")], inline=(k or 0) % 2 == 0)
            yield pa.record_batch([pa.array([f"{k}.xlsx" for k, *_ in rows]), pa.array([made_of(*r) for r in rows], pa.binary())], names=["path", "content"])
