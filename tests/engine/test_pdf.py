"""PDF pages against known text: filters, fonts and code maps, matrices, forms, and broken files."""

import base64
import random
import zlib

import numpy as np
import pytest

from corrobora.plans import made_pdf
from corrobora.sources import pdf_filters as filters
from corrobora.sources.pdf import read_pdf
from corrobora.sources.pdf_text import glyph


def page(content, font="<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", more=(), resources="", head=""):
    """One page; ``more`` are objects from number 6 on."""
    content = content.encode("latin-1") if isinstance(content, str) else content
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", f"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> {resources} >> >>".encode(), made_pdf.stream(content, head), font.encode(), *more]
    return b"%PDF-1.7\n" + b"".join(f"{k} 0 obj\n".encode() + o + b"\nendobj\n" for k, o in enumerate(objects, 1))


def shown(*args, **kw):
    return " | ".join(t for t, _ in read_pdf(page(*args, **kw))[0])


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ("BT /F1 10 Tf (Hel) Tj (lo) Tj ET", "Hello"),
        ("BT /F1 10 Tf (Hel) Tj 14.5 0 Td (lo) Tj ET", "Hello"),
        ("BT /F1 10 Tf (one) Tj 22 0 Td (two) Tj ET", "one two"),
        ("BT /F1 10 Tf (one) Tj 0 -12 Td (two) Tj ET", "one two"),
        ("BT /F1 10 Tf (one) Tj 0 -12 Td () Tj [() 40 (two)] TJ ET", "one two"),
        ("BT /F1 10 Tf 12 TL (one) Tj T* (two) Tj (three) ' 1 2 (four) \" ET", "one two three four"),
        ("BT /F1 10 Tf [(ker) 30 (ning) -250 (gap) 80 (s)] TJ ET", "kerning gaps"),
        ("BT /F1 10 Tf 1 0 0 1 100 100 Tm (a) Tj 1 0 0 1 50 100 Tm (b) Tj ET", "a b"),
        ("BT /F1 1 Tf 10 0 0 10 5 5 Tm (big) Tj 1.5 0 Td (ger) Tj ET", "big ger"),
        ("BT /F1 1 Tf 10 0 0 10 5 5 Tm (big) Tj 1.34 0 Td (ger) Tj ET", "bigger"),
        ("BT /F1 10 Tf 0 1 -1 0 0 0 Tm (up) Tj 11.12 0 Td (ward) Tj ET", "upward"),
        ("q 2 0 0 2 0 0 cm BT /F1 10 Tf (tw) Tj ET Q BT /F1 20 Tf 20.02 0 Td (ice) Tj ET", "twice"),
        ("BT /F1 10 Tf (E = mc) Tj 4 Ts /F1 6 Tf (2) Tj ET", "E = mc 2"),
        ("BT /F1 10 Tf 50 Tz (half) Tj 8.9 0 Td (wide) Tj ET", "halfwide"),
        ("BT /F1 10 Tf 2 Tc (sp) Tj 14.6 0 Td (aced) Tj ET", "spaced"),
        ("BT /F1 10 Tf q 12 TL Q (a) Tj ET BT 300 0 Td (b) Tj ET", "a b"),
        ("BT /F1 10 Tf (a\\\nb\\101\\t) Tj <4a 4> Tj % (no) Tj\n ET", "abA J@"),
        ("BI /W 1 /H 1 ID (in) Tj x EI BT /F1 10 Tf (after) Tj ET", "after"),
        ("BT /F1 10 Tf 3 Tr (unseen) Tj ET", "unseen"),
        ("Q Q BT (no font) Tj 1 Td () Tj TJ /x Do ET", "no font"),
    ],
)
def test_places_make_words(content, want):
    assert shown(content) == want


def test_forms_are_drawn_where_they_are_called():
    form = lambda body, more="": made_pdf.stream(body.encode(), f"/Subtype /Form {more}")
    own = "/Resources << /Font << /F1 5 0 R >> /XObject << /B 7 0 R /A 6 0 R >> >>"
    more = [form("BT /F1 10 Tf (in) Tj ET /B Do /A Do", own), form("BT /F1 10 Tf 0 -20 Td (deep) Tj ET"), made_pdf.stream(b"(image)", "/Subtype /Image /Filter /DCTDecode")]
    assert shown("BT /F1 10 Tf (before) Tj ET /A Do BT /F1 10 Tf 0 -90 Td (end) Tj ET /C Do", more=more, resources="/XObject << /A 6 0 R /C 8 0 R >>") == "before in deep end"
    moved = form("BT /F1 10 Tf (b) Tj ET", "/Matrix [1 0 0 1 5.56 0]")
    assert shown("BT /F1 10 Tf (a) Tj ET /A Do", more=[moved], resources="/XObject << /A 6 0 R >>") == "ab"


@pytest.mark.parametrize(
    ("font", "raw", "want"),
    [
        ("/Subtype /Type1 /Encoding /WinAnsiEncoding", "\x93na\xefve\x94 \x80", "“naïve” €"),
        ("/Subtype /TrueType /Encoding /MacRomanEncoding", "caf\x8e \xd2x\xd3", "café “x”"),
        ("/Subtype /Type1", "it's \xaeve \xe9\xfb", "it’s ﬁve Øß"),
        ("/Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /A /eacute /fi /uni20AC 65 /Zcaron /alpha /Omega /g.alt /f_l /u1F600 /nothing200] >>", "\x01\x02\x03\x04ABCDEFGH", "AéfiۼαΩgfl😀H".replace("ۼ", "€Ž")),
        ("/Subtype /Type1 /FontDescriptor << /Flags 4 >>", "a\xe4", "aä"),
    ],
)
def test_simple_encodings(font, raw, want):
    assert shown(f"BT /F1 10 Tf ({raw}) Tj ET", f"<< /Type /Font {font} >>") == want


@pytest.mark.parametrize(
    ("name", "codec", "text"),
    [("UniGB-UCS2-H", "utf-16-be", "汉字 test"), ("UniJIS-UTF16-H", "utf-16-be", "日本😀"), ("UniCNS-UTF32-H", "utf-32-be", "漢字"), ("UniKS-UTF8-H", "utf-8", "한글 x"), ("GBK-EUC-H", "gbk", "汉字ab"), ("90ms-RKSJ-H", "cp932", "日本語abｱ"), ("ETen-B5-V", "big5", "漢字"), ("KSCms-UHC-H", "cp949", "한글"), ("EUC-H", "euc_jp", "日本")],
)
def test_predefined_code_maps(name, codec, text):
    raw = text.encode(codec).hex()
    assert shown(f"BT /F1 10 Tf <{raw}> Tj ET", f"<< /Type /Font /Subtype /Type0 /Encoding /{name} /DescendantFonts [<< /DW 1000 >>] >>") == text


def test_code_maps_of_a_file():
    cmap = b"2 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange 1 begincidrange <8000> <80FF> 100 endcidrange 1 begincidchar <20> 1 endcidchar"
    unicode = b"2 beginbfchar <41> <0058> <8001> <D83DDE00> endbfchar 2 beginbfrange <61> <63> [<0031> <0032> <0033>] <8010> <8012> <4E00> endbfrange"
    font = "<< /Type /Font /Subtype /Type0 /Encoding 6 0 R /ToUnicode 7 0 R /DescendantFonts [8 0 R] >>"
    more = [made_pdf.stream(cmap), made_pdf.stream(unicode), b"<< /DW 1000 /W [1 [250] 100 255 500] >>"]
    assert shown("BT /F1 10 Tf <418001616263> Tj 30 0 Td <80108012> Tj 10 0 Td <41> Tj 12 0 Td <41> Tj ET", font, more) == "X😀123 一丂X X".replace("丂", chr(0x4E02))


def test_widths_of_a_font_decide():
    font = "<< /Type /Font /Subtype /TrueType /FirstChar 97 /Widths [1000 200] /FontDescriptor << /MissingWidth 500 >> >>"
    assert shown("BT /F1 10 Tf (ab) Tj 12 0 Td (c) Tj 5 0 Td (b) Tj 4 0 Td (a) Tj ET", font) == "abcb a"
    third = "<< /Type /Font /Subtype /Type3 /FontMatrix [0.01 0 0 0.01 0 0] /FirstChar 97 /Widths [100] /Encoding << /Differences [97 /x] >> >>"
    assert shown("BT /F1 10 Tf (a) Tj 10 0 Td (a) Tj ET", third) == "xx"


def grown(data):
    """LZW with codes that grow, as writers make it."""
    table, out, width, last = {bytes([k]): k for k in range(256)}, f"{256:09b}", 9, b""
    size = 258
    for k in range(len(data)):
        now = last + data[k : k + 1]
        if now in table:
            last = now
            continue
        out += f"{table[last]:0{width}b}"
        table[now], size, last = size, size + 1, data[k : k + 1]
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4095:
            out += f"{table[last]:0{width}b}{256:0{width}b}"
            table, size, width, last = {bytes([k]): k for k in range(256)}, 258, 9, b""
    out += (f"{table[last]:0{width}b}" if last else "") + f"{257:0{width}b}"
    out = out.ljust(-(-len(out) // 8) * 8, "0")
    return int(out, 2).to_bytes(len(out) // 8, "big")


def test_filters_give_back_what_was_put_in():
    rng = random.Random(2)
    for n in (0, 1, 100, 3000, 40_000):
        data = bytes(rng.choice(b"abcab ") if n % 2 == 0 else rng.randrange(256) for _ in range(n))
        if data:
            assert filters.lzw(grown(data), {}) == data
            assert filters.lzw(made_pdf.lzw(data), {}) == data
        assert filters.ascii_85(b" ".join([base64.a85encode(data), b"~>"]), {}) == data
        assert filters.ascii_hex(data.hex().encode() + b">x", {}) == data
        assert filters.run_length(made_pdf.run_lengths(data) + b"more", {}) == data
        assert filters.flate(zlib.compress(data), {}) == data
    assert filters.run_length(bytes([254, 65, 128]), {}) == b"AAA"
    assert filters.flate(zlib.compress(b"x" * 5000)[:-3], {}).startswith(b"xxx")


def test_predictors():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 256, (10, 12), dtype=np.uint8)
    paeth = lambda a, b, c: min((a, b, c), key=lambda x: abs(a + b - c - x))
    made = bytearray()
    for i, row in enumerate(rows.tolist()):
        kind, above = i % 5, rows[i - 1].tolist() if i else [0] * 12
        made.append(kind)
        for k, v in enumerate(row):
            a, b, c = row[k - 3] if k >= 3 else 0, above[k], above[k - 3] if k >= 3 else 0
            made.append((v - [0, a, b, (a + b) // 2, paeth(a, b, c)][kind]) & 255)
    assert filters.flate(zlib.compress(bytes(made)), {"/Predictor": 15.0, "/Colors": 3.0, "/Columns": 4.0}) == rows.tobytes()
    less = np.diff(rows.reshape(10, 4, 3), axis=1, prepend=np.zeros((10, 1, 3), np.uint8)).astype(np.uint8)
    assert filters.lzw(grown(less.tobytes()), {"/Predictor": 2.0, "/Colors": 3.0, "/Columns": 4.0}) == rows.tobytes()
    with pytest.raises(ValueError):
        filters.flate(zlib.compress(b"x"), {"/Predictor": 2.0, "/BitsPerComponent": 4.0})


def test_streams_of_several_filters():
    data = b"BT /F1 10 Tf (through it all) Tj ET"
    assert shown(base64.a85encode(zlib.compress(made_pdf.up(data))) + b"~>", head="/Filter [/ASCII85Decode /FlateDecode /FlateDecode] /DecodeParms [null null << /Predictor 12 /Columns 7 >>]") == "through it all"
    assert shown(made_pdf.lzw(data), head="/Filter /LZWDecode") == "through it all"
    with pytest.raises(ValueError, match="JBIG2"):
        shown(data, head="/Filter /JBIG2Decode")


def test_texts_come_back_from_every_kind_of_file():
    rng = random.Random(5)
    for k in range(60):
        words = ["".join(rng.choice("abcXYZäß(\\)é€”" if k % 2 else "ab日本ж😀)") for _ in range(rng.randint(1, 12))) for _ in range(rng.choice([0, 1, 299, 301, 700]))]
        want = [(" ".join(words[a : a + made_pdf.PAGE]), a // made_pdf.PAGE + 1) for a in range(0, len(words), made_pdf.PAGE)]
        for how in range(5):
            assert read_pdf(made_pdf.made(" \n".join(words), how)) == (want, [] if want else ["no text layer"]), how


def test_broken_files_end_in_errors_or_text():
    rng = random.Random(6)
    for k in range(150):
        whole = bytearray(made_pdf.made("Some words (with brackets) and more of them " * 5, k))
        for _ in range(rng.randint(1, 30)):
            whole[rng.randrange(len(whole))] = rng.randrange(256)
        try:
            read_pdf(bytes(whole[: rng.randint(20, len(whole))]))
        except Exception as error:  # noqa: BLE001  a file's failure is its row
            assert not isinstance(error, MemoryError)


def test_glyph_names():
    names = {"A": "A", "Aring": "Å", "scaron": "š", "gamma": "γ", "Delta": "Δ", "uni00410042": "AB", "u0041": "A", "a.sc": "a", "T_h": "Th", "space": " ", "foo": "", "ogonek": "", "uniD800": "", "ffi": "ffi", ".notdef": ""}
    assert {n: glyph(n) for n in names} == names
