"""The text layer of PDF files: objects and object streams, the page tree, and each page's text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from corrobora.sources.pdf_filters import FILTERS
from corrobora.sources.pdf_text import Writing, interpret

SPACE = b"\0\t\n\f\r "
TOKEN = re.compile(rb"[\0\t\n\f\r ]*(?:%[^\r\n]*[\0\t\n\f\r ]*)*(<<|>>|[\[\](<{}]|/[^\0\t\n\f\r ()<>\[\]{}/%]*|[^\0\t\n\f\r ()<>\[\]{}/%]+|[>)])?")
REFERENCE = re.compile(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
#: The tokens that most streams are made of, each whole: a number, digits of a string, a string without brackets or escapes,
#: a word, a name.
PLAIN = re.compile(rb"[\0\t\n\f\r ]*(?:([+-]?(?:\d+\.?\d*|\.\d+))(?![^\0\t\n\f\r ()<>\[\]{}/%])|<([0-9A-Fa-f]*)>|\(([^()\\]*)\)|([^\0\t\n\f\r ()<>\[\]{}/%]+)|(/[^\0\t\n\f\r ()<>\[\]{}/%]*))")
_SPACE, _END, _NUMBER = rb"[\0\t\n\f\r ]", rb"(?![^\0\t\n\f\r ()<>\[\]{}/%])", rb"([+-]?(?:\d+\.?\d*|\.\d+))"
#: The operators that most streams are made of, with their operands: a string shown, a move.
COMMON = re.compile(_SPACE + rb"*(?:(?:<([0-9A-Fa-f]*)>|\(([^()\\]*)\))" + _SPACE + rb"*Tj|" + _NUMBER + _SPACE + rb"+" + _NUMBER + _SPACE + rb"+Td)" + _END)
SPECIAL = re.compile(rb"[()\\]")
OCTAL = re.compile(rb"[0-7]{1,3}")
OBJECT = re.compile(rb"(?<!\d)(\d+)[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+obj\b")


class Ref(NamedTuple):
    number: int


class Name(str):
    """A name, or in a content stream an operator, which starts with no slash."""


@lru_cache(4096)
def name(word: bytes) -> Name:
    return Name(word.decode("latin-1"))


class Stream(NamedTuple):
    head: dict
    raw: bytes


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose opening bracket is before ``at``, and the place after its closing one."""
    out, depth = bytearray(), 1
    plain = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}
    while at < len(data):
        special = SPECIAL.search(data, at)
        out += data[at : special.start() if special else len(data)]
        if not special:
            return bytes(out), len(data)
        c, at = data[special.start()], special.end()
        if c == 92 and at < len(data):
            octal = OCTAL.match(data, at)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
            elif data[at] in b"\r\n":
                at += 2 if data[at : at + 2] == b"\r\n" else 1
            else:
                out.append(plain.get(data[at], data[at]))
                at += 1
            continue
        depth += (c == 40) - (c == 41)
        if not depth:
            break
        out.append(c)
    return bytes(out), at


def value(data: bytes, at: int = 0, refs: bool = True):
    """The value at a place and the place after it; the end and closing brackets come as None and as they are."""
    if plain := PLAIN.match(data, at):
        kind = plain.lastindex
        word, at = plain[kind], plain.end()
        if kind == 1:
            if refs and word.isdigit() and (more := REFERENCE.match(data, at)):
                return Ref(int(word)), more.end()
            return float(word), at
        if kind == 2:
            return bytes.fromhex((word + b"0" * (len(word) % 2)).decode()), at
        return word if kind == 3 else name(word), at
    token = TOKEN.match(data, at)
    word, at = token[1], token.end()
    if word is None:
        return None, len(data)
    if word == b"(":
        return literal(data, at)
    if word == b"<":
        end = data.find(b">", at)
        end = len(data) if end < 0 else end
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at:end])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
    if word in (b"[", b"<<"):
        close, items = (b"]" if word == b"[" else b">>"), []
        while True:
            item, at = value(data, at, refs)
            if item is None or (isinstance(item, Name) and item == close.decode()):
                break
            items.append(item)
        return (items if word == b"[" else dict(zip(items[::2], items[1::2], strict=False))), at
    if NUMBER.match(word):
        if refs and word.isdigit() and (more := REFERENCE.match(data, at)):
            return Ref(int(word)), more.end()
        return float(word), at
    return name(word), at


class File:
    """The objects of one file by number; a later definition of a number replaces an earlier one."""

    def __init__(self, content: bytes):
        if b"%PDF" not in content[:1024]:
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+R", content):
            raise ValueError("the file is encrypted")
        self.objects: dict[int, object] = {}
        at = 0
        while found := OBJECT.search(content, at):
            got, at = value(content, found.end())
            if isinstance(got, dict) and (start := re.compile(rb"[\0\t\n\f\r ]*stream\r?\n?").match(content, at)):
                size = got.get("/Length")
                end = start.end() + int(size) if isinstance(size, float) else -1
                if end < 0 or not re.compile(rb"[\0\t\n\f\r ]*endstream").match(content, end):
                    end = content.find(b"endstream", start.end())
                    end = len(content) if end < 0 else end
                got, at = Stream(got, content[start.end() : end]), end
            self.objects[int(found[1])] = got
        for packed in [s for s in self.objects.values() if isinstance(s, Stream) and s.head.get("/Type") == "/ObjStm"]:
            data, first = self.decoded(packed), int(self.of(packed.head["/First"]))
            places = [int(n) for n in data[:first].split()]
            for number, place in zip(places[::2], places[1::2], strict=False):
                self.objects.setdefault(number, value(data, first + place)[0])

    def of(self, x):
        for _ in range(16):
            if not isinstance(x, Ref):
                break
            x = self.objects.get(x.number)
        return x

    def decoded(self, stream: Stream) -> bytes:
        """A stream's bytes, through its filters in order."""
        names, parms = (self.of(stream.head.get(long) or stream.head.get(short)) for long, short in (("/Filter", "/F"), ("/DecodeParms", "/DP")))
        names = names if isinstance(names, list) else [names] if names else []
        parms = parms if isinstance(parms, list) else [parms] * len(names)
        data = stream.raw
        for k, name in enumerate(map(self.of, names)):
            if name not in FILTERS:
                raise ValueError(f"streams with {name} are not read")
            given = self.of(parms[k]) if k < len(parms) else None
            data = FILTERS[name](data, {key: self.of(x) for key, x in given.items()} if isinstance(given, dict) else {})
        return data

    def pages(self) -> Iterator[dict]:
        """The pages in the tree's order, with inherited resources; in file order where there is no tree."""
        root = next((o for o in self.objects.values() if isinstance(o, dict) and o.get("/Type") == "/Catalog"), {})
        top = self.of(root.get("/Pages"))
        if not isinstance(top, dict):
            yield from (o for o in self.objects.values() if isinstance(o, dict) and o.get("/Type") == "/Page")
            return
        stack, seen = [(top, {})], set()
        while stack:
            node, resources = stack.pop()
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            resources = self.of(node.get("/Resources")) or resources
            if "/Kids" in node:
                stack.extend((self.of(kid), resources) for kid in reversed(self.of(node["/Kids"]) or []))
            else:
                yield node | {"/Resources": resources}

    def content(self, page: dict) -> bytes:
        """A page's content streams one after another; one that is not there is an error, not an empty page."""
        parts = self.of(page.get("/Contents"))
        if not isinstance(parts, list):
            parts = [parts] if page.get("/Contents") is not None else []
        streams = [self.of(p) for p in parts]
        if not all(isinstance(s, Stream) for s in streams):
            raise ValueError("a page's content is missing")
        return b"\n".join(self.decoded(s) for s in streams)


def values(data: bytes) -> Iterator:
    at = 0
    while at < len(data):
        got, at = value(data, at, refs=False)
        if got is not None:
            yield got


IMAGE_END = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|\Z)")


def operators(data: bytes) -> Iterator[tuple[str, list]]:
    """A content stream's operators with their operands; inline images are passed over."""
    operands, at = [], 0
    while at < len(data):
        if not operands and (common := COMMON.match(data, at)):
            digits, text, x, y = common.groups()
            at = common.end()
            if x is not None:
                yield "Td", [float(x), float(y)]
            else:
                yield "Tj", [text if digits is None else bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())]
            continue
        if (plain := PLAIN.match(data, at)) and plain[4] != b"ID":
            kind = plain.lastindex
            word, at = plain[kind], plain.end()
            if kind == 4:
                yield name(word), operands
                operands = []
                continue
            operands.append(float(word) if kind == 1 else bytes.fromhex((word + b"0" * (len(word) % 2)).decode()) if kind == 2 else word if kind == 3 else name(word))
            continue
        token, at = value(data, at, refs=False)
        if token is None:
            break
        if not isinstance(token, Name) or token.startswith("/"):
            operands.append(token)
            continue
        if token == "ID":
            end = IMAGE_END.search(data, at)
            at = end.end() if end else len(data)
        yield token, operands
        operands = []


def read_pdf(content: bytes) -> tuple[list, list]:
    """(text, page number) of each page with text, pages counted from 1 in the page tree's order; no OCR.

    Text comes in the order in which it is shown, that of form XObjects where they are drawn. Pieces that go on where
    the last one ended are one word; after a gap or on another line comes a space. White space is collapsed.
    """
    file = File(content)
    segments, fonts = [], {}
    for number, page in enumerate(file.pages(), 1):
        out = Writing()
        interpret(file, file.content(page), file.of(page.get("/Resources")) or {}, operators, values, out, fonts=fonts)
        text = " ".join("".join(out.pieces).split())
        if text:
            segments.append((text, number))
    return segments, [] if segments else ["no text layer"]
