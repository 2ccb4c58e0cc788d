"""PDF files made of texts, in the ways in which real ones keep them: input for the query and tests of the reader."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words on a page and characters on a line.
PAGE, LINE = 300, 80


def lzw(data: bytes) -> bytes:
    """Nine-bit codes only: the table is cleared before it needs ten."""
    codes = np.array([c for k in range(0, len(data), 250) for c in (256, *data[k : k + 250])] + [257])
    return np.packbits((codes[:, None] >> np.arange(8, -1, -1) & 1).astype(np.uint8)).tobytes()


def up(data: bytes, columns: int = 7) -> bytes:
    """Rows less those above them, as PNG's filter does it, compressed."""
    rows = np.frombuffer(data.ljust(-(-len(data) // columns) * columns, b" "), np.uint8).reshape(-1, columns)
    less = rows - np.r_[np.zeros((1, columns), np.uint8), rows[:-1]]
    return zlib.compress(np.c_[np.full(len(rows), 2, np.uint8), less].tobytes())


def run_lengths(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 128]) - 1]) + data[k : k + 128] for k in range(0, len(data), 128)) + b"\x80"


def stream(data: bytes, more: str = "") -> bytes:
    return f"<< /Length {len(data)} {more} >> stream\n".encode() + data + b"\nendstream"


def literal(raw: bytes) -> bytes:
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def lines(words: list[str]) -> Iterator[list[str]]:
    line: list[str] = []
    for word in words:
        if line and sum(map(len, line)) + len(line) + len(word) > LINE:
            yield line
            line = []
        line.append(word)
    if line:
        yield line


def made(text: str | None, how: int) -> bytes:
    """``text`` as pages of PAGE words each. ``how``, modulo 5: a plain font with kerning; a form, LZW and ASCII85; glyph
    names and predicted rows; character numbers, each word at a place of its own; a predefined code map, run lengths
    in hexadecimal digits. Texts that a plain font cannot spell get character numbers."""
    words, how = (text or "").split(), how % 5
    try:
        plain = how < 3 and bool("".join(words).encode("cp1252"))
    except UnicodeEncodeError:
        plain = False
    if how < 3 and not plain:
        how = 3
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b""]
    if how < 2:
        objects[2] = b"<< /Type /Font /Subtype /TrueType /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
    elif how == 2:
        # Every character has another code than its own.
        used = sorted({c for w in words for c in w} | {" "})
        code = {c: k + 5 for k, c in enumerate(used)} if len(used) < 250 else {}
        objects[2] = f"<< /Type /Font /Subtype /Type1 /FirstChar 5 /Widths [{' 500' * len(code)} ] /Encoding << /Differences [5 {' '.join(f'/uni{ord(c):04X}' for c in used)}] >> >>".encode()
    elif how == 3:
        used = sorted({c for w in words for c in w})
        number = {c: k + 1 for k, c in enumerate(used)}
        digits = {c: f"{k:04X}" for c, k in number.items()}
        pairs = " ".join(f"<{k:04X}> <{c.encode('utf-16-be', 'replace').hex()}>" for c, k in number.items())
        objects += [stream(f"1 begincodespacerange <0000> <FFFF> endcodespacerange {len(used)} beginbfchar {pairs} endbfchar".encode())]
        objects[2] = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 4 0 R /DescendantFonts [<< /DW 600 >>] >>"
    else:
        objects[2] = b"<< /Type /Font /Subtype /Type0 /Encoding /UniJIS-UTF16-H /DescendantFonts [<< /DW 1000 >>] >>"
    kids = []
    for a in range(0, len(words), PAGE):
        body = b"BT /F1 10 Tf 12 TL 50 700 Td "
        for row, line in enumerate(lines(words[a : a + PAGE]), 1):
            whole = " ".join(line)
            if how < 2:
                raw = whole.encode("cp1252")
                cut = len(raw) // 2
                body += b"[" + literal(raw[:cut]) + b" 40 " + literal(raw[cut:]) + b"] TJ T* "
            elif how == 2:
                body += literal(bytes(code[c] for c in whole)) + b" Tj T* "
            elif how == 3:
                body += f"1 0 0 1 50 {700 - 12 * row} Tm ".encode()
                for word in line:
                    half = -(-len(word) // 2)
                    body += b"".join(f"<{''.join(map(digits.__getitem__, part))}> Tj ".encode() for part in (word[:half], word[half:]) if part)
                    # Characters are six units wide, and the next word begins three units on.
                    body += f"{len(word) * 6 + 3} 0 Td ".encode()
            else:
                body += b"<" + whole.encode("utf-16-be", "replace").hex().encode() + b"> Tj T* "
        body += b"ET"
        n = len(objects)
        resources = b"/Resources << /Font << /F1 3 0 R >> >>"
        if how == 1:
            form = base64.a85encode(lzw(body)) + b"~>"
            objects += [stream(form, "/Type /XObject /Subtype /Form /BBox [0 0 600 800] /Resources << /Font << /F1 3 0 R >> >> /Filter [/A85 /LZW]"), stream(b"q 1 0 0 1 5 5 cm /X1 Do Q")]
            resources = f"/Resources << /XObject << /X1 {n + 1} 0 R >> >>".encode()
        elif how == 2:
            objects.append(stream(up(body), "/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >>"))
        elif how == 4:
            objects.append(stream(run_lengths(body).hex().encode() + b">", "/Filter [/AHx /RL]"))
        else:
            objects.append(stream(zlib.compress(body), "/Filter /FlateDecode"))
        objects.append(b"<< /Type /Page /Parent 2 0 R " + resources + f" /Contents {len(objects)} 0 R >>".encode())
        kids.append(f"{len(objects)} 0 R")
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode()
    return b"%PDF-1.7\n" + b"".join(f"{k} 0 obj\n".encode() + o + b"\nendobj\n" for k, o in enumerate(objects, 1)) + b"%%EOF\n"


def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (path, content)."""
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            rows = list(zip(batch.column(0).slice(a, 64).to_pylist(), batch.column(1).slice(a, 64).to_pylist(), strict=True))
            yield pa.record_batch([pa.array([f"{k}.pdf" for k, _ in rows]), pa.array([made(t, k or 0) for k, t in rows], pa.binary())], names=["path", "content"])
