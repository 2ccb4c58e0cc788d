"""What a PDF page shows as text: fonts' codes, and the content streams' operators with their matrices."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from math import hypot

# The widths of the standard fonts' characters from the space on, in thousandths of an em.
HELVETICA = [278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
             1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
             333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584]
TIMES = [250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 278, 278, 564, 564, 564, 444,
         921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500,
         333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541]
#: The codes of the standard encoding that are not those of ASCII.
STANDARD = {0x27: "’", 0x60: "‘"} | dict(zip([*range(0xA1, 0xB0), *range(0xB1, 0xB5), *range(0xB6, 0xBE), 0xBF, *range(0xC1, 0xC9), 0xCA, 0xCB, *range(0xCD, 0xD1), 0xE1, 0xE3, *range(0xE8, 0xEC), 0xF1, 0xF5, *range(0xF8, 0xFC)], "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ–†‡·¶•‚„”»…‰¿`´ˆ˜¯˘˙¨˚¸˝˛ˇ—ÆªŁØŒºæıłøœß", strict=True))
#: Glyph names that are neither a letter, an accented one, a Greek one nor a number of a code point.
GLYPHS = dict(zip(
    "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at "
    "bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde bullet endash emdash quoteleft quoteright quotedblleft quotedblright quotesinglbase quotedblbase ellipsis dagger daggerdbl trademark "
    "copyright registered section paragraph germandbls ae oe AE OE oslash Oslash lslash Lslash dotlessi degree plusminus mu multiply divide onehalf onequarter threequarters Euro sterling yen cent currency guillemotleft guillemotright "
    "guilsinglleft guilsinglright perthousand minus fraction periodcentered exclamdown questiondown eth thorn Eth Thorn ordfeminine ordmasculine logicalnot brokenbar florin nbspace sfthyphen acute dieresis circumflex tilde cedilla caron".split(),
    " !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~•–—‘’“”‚„…†‡™©®§¶ßæœÆŒøØłŁı°±µ×÷½¼¾€£¥¢¤«»‹›‰−⁄·¡¿ðþÐÞªº¬¦ƒ ­´¨ˆ˜¸ˇ", strict=True,
)) | {"fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", ".notdef": ""}
ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "ring": "̊", "caron": "̌", "cedilla": "̧", "ogonek": "̨", "macron": "̄", "breve": "̆", "dotaccent": "̇", "hungarumlaut": "̋"}
#: How the predefined code maps spell text, by parts of their names; the first that fits counts.
CODECS = (("UTF16", "utf-16-be"), ("UCS2", "utf-16-be"), ("UTF32", "utf-32-be"), ("UTF8", "utf-8"), ("GBK", "gb18030"), ("GB-EUC", "gb2312"), ("RKSJ", "cp932"), ("HKscs", "big5hkscs"), ("B5", "big5"), ("UHC", "cp949"), ("KSC", "euc_kr"), ("CNS-EUC", "euc_tw"), ("EUC-", "euc_jp"))
#: Gaps to the right and to the left, and to another line, in ems, from which on two pieces of text are not one word.
GAP, BACK, LINE = 0.1, 0.5, 0.3
#: Forms within forms.
DEEPEST = 16
#: Shown strings that a font keeps the text and advance of.
KEPT = 20_000

Matrix = tuple[float, float, float, float, float, float]
ONE: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def glyph(name: str) -> str:
    """A glyph name's text; parts after a full stop are variants, and underscores join several."""
    if name in GLYPHS:
        return GLYPHS[name]
    base = name.partition(".")[0]
    if "_" in base:
        return "".join(map(glyph, base.split("_")))
    if base in GLYPHS or len(base) == 1:
        return GLYPHS.get(base, base)
    if found := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", base):
        points = [int(found[1][k : k + 4], 16) for k in range(0, len(found[1]), 4)] if found[1] else [int(found[2], 16)]
        return "".join(chr(p) for p in points if p < 0x110000 and not 0xD800 <= p < 0xE000)
    if (mark := ACCENTS.get(base[1:])) is not None:
        return unicodedata.normalize("NFC", base[0] + mark)
    try:
        return unicodedata.lookup(f"GREEK {'CAPITAL' if base[0].isupper() else 'SMALL'} LETTER {base.upper()}")
    except KeyError:
        return ""


@lru_cache(256)
def named(encoding: str | None, symbolic: bool) -> tuple[str, ...]:
    """The characters of the 256 codes of a simple font's named encoding."""
    if encoding == "/MacRomanEncoding":
        return tuple(bytes(range(256)).decode("mac_roman"))
    latin = tuple(bytes([k]).decode("cp1252", "replace") for k in range(256))
    if encoding in ("/WinAnsiEncoding", "/PDFDocEncoding") or symbolic:
        return latin
    return tuple(STANDARD.get(k, latin[k] if k < 0x80 else "") for k in range(256))


class CodeMap:
    """Codes of one to four bytes by the ranges they are in, and what each stands for."""

    def __init__(self) -> None:
        self.ranges: list[tuple[bytes, bytes]] = []
        self.text: dict[bytes, str] = {}
        self.cid: list[tuple[bytes, bytes, int]] = []

    def split(self, raw: bytes, otherwise: int) -> Iterator[bytes]:
        sizes = sorted({len(a) for a, _ in self.ranges}) or [otherwise]
        if len(sizes) == 1:
            yield from (raw[k : k + sizes[0]] for k in range(0, len(raw), sizes[0]))
            return
        at = 0
        while at < len(raw):
            n = next((k for k in sizes if at + k <= len(raw) and any(len(a) == k and all(x <= c <= y for x, c, y in zip(a, raw[at : at + k], b, strict=True)) for a, b in self.ranges)), sizes[0])
            yield raw[at : at + n]
            at += n

    def number(self, code: bytes) -> int | None:
        value = int.from_bytes(code, "big")
        return next((to + value - int.from_bytes(a, "big") for a, b, to in self.cid if len(a) == len(code) and a <= code <= b), None)


def code_map(tokens: Iterator) -> CodeMap:
    """The sections of a CMap: codespace ranges, texts of characters and ranges, character numbers."""
    made, held = CodeMap(), []
    wide = lambda b: b.decode("utf-16-be", "replace")
    for token in tokens:
        if not isinstance(token, str) or token.startswith("/"):
            held.append(token)
            continue
        if token == "endcodespacerange":
            made.ranges += [(a, b) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes) and len(a) == len(b) > 0]
        elif token == "endbfchar":
            made.text.update((a, wide(b) if isinstance(b, bytes) else glyph(b[1:])) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes | str))
        elif token == "endbfrange":
            for low, high, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                first, last = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                for k in range(min(last - first, 0xFFFF) + 1):
                    if isinstance(to, list):
                        target = to[k] if k < len(to) else b""
                    else:
                        target = to[:-2] + ((int.from_bytes(to[-2:], "big") + k) & 0xFFFF).to_bytes(min(2, len(to)), "big")
                    made.text[(first + k).to_bytes(len(low), "big")] = wide(target) if isinstance(target, bytes) else ""
        elif token == "endcidrange":
            made.cid += [(a, b, int(to)) for a, b, to in zip(held[::3], held[1::3], held[2::3], strict=False) if isinstance(a, bytes) and isinstance(to, float)]
        elif token == "endcidchar":
            made.cid += [(a, a, int(to)) for a, to in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(to, float)]
        held = []
    return made


class Font:
    """Codes of a shown string to (text, width in ems, is it the one-byte code of the space)."""

    def __init__(self, file, font: dict, values: Callable):
        of = file.of
        self.known: dict[bytes, tuple[str, float]] = {}
        self.pieces: dict[tuple, tuple[str, float]] = {}
        self.steps: dict[tuple, tuple[list[str], list[float]]] = {}
        unicode = of(font.get("/ToUnicode"))
        self.to_text = code_map(values(file.decoded(unicode))) if hasattr(unicode, "raw") else CodeMap()
        encoding = of(font.get("/Encoding"))
        self.wide = font.get("/Subtype") == "/Type0"
        self.scale = 0.001
        if self.wide:
            below = of((of(font.get("/DescendantFonts")) or [{}])[0]) or {}
            self.codec = next((codec for part, codec in CODECS if isinstance(encoding, str) and part in encoding), None)
            self.map = code_map(values(file.decoded(encoding))) if hasattr(encoding, "raw") else CodeMap()
            self.usual = float(of(below.get("/DW", 1000.0)) or 0)
            self.widths = {}
            items = [of(x) for x in of(below.get("/W")) or []]
            while len(items) >= 2:
                if isinstance(items[1], list):
                    self.widths.update((int(items[0]) + k, float(of(w))) for k, w in enumerate(items[1]))
                    items = items[2:]
                else:
                    self.widths.update((k, float(items[2])) for k in range(int(items[0]), min(int(items[1]), 0xFFFF) + 1)) if len(items) > 2 else None
                    items = items[3:]
            return
        about = of(font.get("/FontDescriptor")) or {}
        base, changed = (of(encoding.get("/BaseEncoding")), of(encoding.get("/Differences")) or []) if isinstance(encoding, dict) else (encoding, [])
        self.table = list(named(base, bool(int(of(about.get("/Flags", 0)) or 0) & 4)))
        at = 0
        for item in map(of, changed):
            if isinstance(item, float):
                at = int(item)
            elif isinstance(item, str):
                if 0 <= at < 256:
                    self.table[at] = glyph(item[1:])
                at += 1
        given, first = of(font.get("/Widths")), int(of(font.get("/FirstChar", 0)) or 0)
        self.usual = float(of(about.get("/MissingWidth", 0)) or 0)
        if isinstance(given, list):
            self.widths = {first + k: float(w) for k, w in enumerate(map(of, given)) if isinstance(w, float)}
            if font.get("/Subtype") == "/Type3":
                self.scale = abs((of(font.get("/FontMatrix")) or [0.001])[0])
        else:
            name = str(of(font.get("/BaseFont")) or "")
            fixed = "Courier" in name
            widths = TIMES if re.search("Times|Serif|Roman|Georgia|Garamond", name) else HELVETICA
            self.usual = 600.0 if fixed else 556.0
            self.widths = {} if fixed else {k: float(widths[ord(c) - 32]) for k, c in enumerate(self.table) if len(c) == 1 and 32 <= ord(c) < 127}

    def codes(self, raw: bytes) -> Iterator[bytes]:
        if not self.wide:
            yield from (raw[k : k + 1] for k in range(len(raw)))
        elif self.codec and not self.codec.startswith("utf-16"):
            yield from (c.encode(self.codec, "replace") for c in raw.decode(self.codec, "replace"))
        else:
            yield from self.map.split(raw, 2) if self.map.ranges else self.to_text.split(raw, 2) if not self.codec and any(len(a) > 1 for a, _ in self.to_text.ranges) else (raw[k : k + 2] for k in range(0, len(raw), 2))

    def one(self, code: bytes) -> tuple[str, float]:
        text = self.to_text.text.get(code)
        if not self.wide:
            return (self.table[code[0]] if text is None else text), self.widths.get(code[0], self.usual) * self.scale
        if text is None:
            text = code.decode(self.codec or "utf-16-be", "ignore") if self.codec or not self.to_text.text else ""
        number = self.map.number(code) if self.map.cid else int.from_bytes(code, "big") if not self.codec else None
        # Halves of a surrogate pair, and the narrow codes of Asian maps, whose numbers are not known here.
        usual = self.usual / 2 if self.codec and len(code) == 1 else self.usual
        return text, self.widths.get(number, usual) * self.scale

    def shown(self, raw: bytes) -> Iterator[tuple[str, float, bool]]:
        if self.wide and self.codec == "utf-16-be" and not self.to_text.text:
            # Pairs of surrogates are one character.
            yield raw.decode("utf-16-be", "ignore"), self.usual * self.scale * (len(raw) // 2), False
            return
        for code in self.codes(raw):
            if (got := self.known.get(code)) is None:
                got = self.known[code] = self.one(code)
            yield *got, code == b" "


    @cached_property
    def length(self) -> int | None:
        """The bytes of each code, where all have the same."""
        if self.codec:
            return None
        ranges = self.map.ranges or self.to_text.ranges
        sizes = {len(a) for a, _ in ranges} if self.map.ranges or any(len(a) > 1 for a, _ in ranges) else {2}
        return sizes.pop() if len(sizes) == 1 else None

    def even(self, raw: bytes, n: int) -> list[tuple[str, float, bool]]:
        """As ``shown``, of codes of ``n`` bytes."""
        found = []
        for k in range(0, len(raw), n):
            code = raw[k : k + n]
            if (got := self.known.get(code)) is None:
                got = self.known[code] = self.one(code)
            found.append((*got, code == b" "))
        return found

    def piece(self, raw: bytes, size: float, char: float, word: float, stretch: float) -> tuple[str, float]:
        """A shown string's text, and how far it advances with these text parameters."""
        if (got := self.pieces.get(key := (raw, size, char, word, stretch))) is not None:
            return got
        advance = 0.0
        if not self.wide:
            if (got := self.steps.get(key[1:])) is None:
                codes = [(*self.one(bytes([k])), k == 32) for k in range(256)]
                if len(self.steps) >= 256:
                    self.steps.clear()
                got = self.steps[key[1:]] = [t for t, _, _ in codes], [(width * size + char + word * space) * stretch for _, width, space in codes]
            text = "".join(map(got[0].__getitem__, raw))
            for step in map(got[1].__getitem__, raw):
                advance += step
        else:
            texts, n = [], self.length
            for t, width, space in self.shown(raw) if n is None else self.even(raw, n):
                texts.append(t)
                advance += (width * size + char + word * space) * stretch
            text = "".join(texts)
        if len(raw) <= 64:
            if len(self.pieces) >= KEPT:
                self.pieces.clear()
            self.pieces[key] = text, advance
        return text, advance


def times(a: Matrix, b: Matrix) -> Matrix:
    """First ``a``, then ``b``."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


class Writing:
    """The text of a page so far, and where in it the last piece ended."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.end: tuple[float, float] | None = None

    def add(self, text: str, at: Matrix, size: float, advance: float) -> None:
        """Text that starts at a matrix's origin and runs ``advance`` along its first axis; no text is no place either."""
        if not text:
            return
        length = hypot(at[0], at[1]) or 1.0
        em = abs(size) * length or 1.0
        if self.end is not None:
            x, y = at[4] - self.end[0], at[5] - self.end[1]
            along, across = (x * at[0] + y * at[1]) / length, (y * at[0] - x * at[1]) / length
            if along > GAP * em or along < -BACK * em or abs(across) > LINE * em:
                self.pieces.append(" ")
        self.pieces.append(text)
        self.end = at[4] + advance * at[0], at[5] + advance * at[1]


class State:
    """What ``q`` saves: the matrix, and the text parameters."""

    __slots__ = ("ctm", "font", "size", "char", "word", "stretch", "leading", "rise")

    def __init__(self, ctm: Matrix):
        self.ctm, self.font, self.size, self.char, self.word, self.stretch, self.leading, self.rise = ctm, None, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0

    def copy(self) -> State:
        other = State(self.ctm)
        for name in State.__slots__:
            setattr(other, name, getattr(self, name))
        return other


def numbers(operands: list, n: int) -> list[float]:
    """The last ``n`` operands as numbers; what is missing or none counts as 0."""
    found = [x if isinstance(x, float) else 0.0 for x in operands[-n:]]
    return [0.0] * (n - len(found)) + found


def interpret(file, data: bytes, resources: dict, operators: Callable, values: Callable, out: Writing, ctm: Matrix = ONE, fonts: dict | None = None, within: tuple = ()) -> None:
    """Runs a content stream: text goes to ``out`` in the order in which it is shown, that of form XObjects too.

    ``operators`` gives a stream's operands and operators, ``values`` the plain tokens of a CMap. ``fonts`` keeps fonts
    of the same file, ``within`` the forms that are open.
    """
    fonts = {} if fonts is None else fonts
    state, saved = State(ctm), []
    matrix = line = ONE
    own = file.of(resources.get("/Font")) or {}
    forms = file.of(resources.get("/XObject")) or {}

    def font(name: str, ref=None):
        ref = own.get(name) if ref is None else ref
        found = file.of(ref)
        if not isinstance(found, dict):
            return None
        if id(found) not in fonts:
            fonts[id(found)] = Font(file, found, values), found
        return fonts[id(found)][0]

    def show(raw: bytes) -> None:
        nonlocal matrix
        text, advance = (state.font or default()).piece(raw, state.size, state.char, state.word, state.stretch)
        at = matrix if state.ctm == ONE else times(matrix, state.ctm)
        out.add(text, times((1.0, 0.0, 0.0, 1.0, 0.0, state.rise), at) if state.rise else at, state.size, advance)
        along(advance)

    def move(x: float, y: float) -> None:
        nonlocal matrix, line
        a, b, c, d, e, f = line
        matrix = line = a, b, c, d, x * a + y * c + e, x * b + y * d + f

    def along(x: float) -> None:
        nonlocal matrix
        a, b, c, d, e, f = matrix
        matrix = a, b, c, d, x * a + e, x * b + f

    @lru_cache(1)
    def default() -> Font:
        return Font(file, {}, values)

    for operator, operands in operators(data):
        if operator in ("Tj", "'", '"'):
            if operator == '"':
                state.word, state.char = numbers(operands[:-1], 2)
            if operator != "Tj":
                move(0.0, -state.leading)
            if operands and isinstance(operands[-1], bytes):
                show(operands[-1])
        elif operator == "TJ":
            for item in operands[-1] if operands and isinstance(operands[-1], list) else ():
                if isinstance(item, bytes):
                    show(item)
                elif isinstance(item, float):
                    along(-item / 1000 * state.size * state.stretch)
        elif operator in ("Td", "TD"):
            x, y = numbers(operands, 2)
            if operator == "TD":
                state.leading = -y
            move(x, y)
        elif operator == "T*":
            move(0.0, -state.leading)
        elif operator == "Tm":
            matrix = line = tuple(numbers(operands, 6))
        elif operator == "BT":
            matrix = line = ONE
        elif operator == "Tf" and len(operands) >= 2:
            state.font, state.size = font(operands[-2]), numbers(operands, 1)[0]
        elif operator == "Tc":
            state.char = numbers(operands, 1)[0]
        elif operator == "Tw":
            state.word = numbers(operands, 1)[0]
        elif operator == "Tz":
            state.stretch = numbers(operands, 1)[0] / 100
        elif operator == "TL":
            state.leading = numbers(operands, 1)[0]
        elif operator == "Ts":
            state.rise = numbers(operands, 1)[0]
        elif operator == "cm":
            state.ctm = times(tuple(numbers(operands, 6)), state.ctm)
        elif operator == "q":
            saved.append(state.copy())
        elif operator == "Q" and saved:
            state = saved.pop()
        elif operator == "gs" and operands:
            given = file.of((file.of((file.of(resources.get("/ExtGState")) or {}).get(operands[-1])) or {}).get("/Font"))
            if isinstance(given, list) and len(given) == 2:
                state.font, state.size = font("", given[0]), given[1]
        elif operator == "Do" and operands:
            form = file.of(forms.get(operands[-1]))
            if hasattr(form, "raw") and form.head.get("/Subtype") == "/Form" and id(form) not in within and len(within) < DEEPEST:
                place = file.of(form.head.get("/Matrix"))
                place = tuple(numbers(place, 6)) if isinstance(place, list) and len(place) == 6 else ONE
                interpret(file, file.decoded(form), file.of(form.head.get("/Resources")) or resources, operators, values, out, times(place, state.ctm), fonts, (*within, id(form)))
