"""Text of PDF files page by page, for files whose fonts use a simple encoding: objects, streams and text operators only."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

MAX_STREAM_BYTES = 64 << 20
TRAILER_BYTES = 4096
PAGE_NUMBER_CHARS = 8
WORD_GAP = -200.0

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^()\\]|\((?:\\.|[^()\\])*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|[\[\]]|/[^\s/\[\]<>()]+|[-+]?\d*\.?\d+|[A-Za-z][A-Za-z*]*|['\"]", re.S)
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r?\n)|(.))", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _inflated(data: bytes) -> bytes:
    tool = zlib.decompressobj()
    out = tool.decompress(data, MAX_STREAM_BYTES)
    if tool.unconsumed_tail:
        raise ValueError("stream too large")
    return out


def _stream(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    head = body[: found.start()]
    if b"/FlateDecode" in head:
        return _inflated(found.group(1))
    return b"" if b"/Filter" in head else found.group(1)


def _objects(content: bytes) -> dict[int, bytes]:
    """The objects of a file by number, those packed in object streams too; of repeated numbers the last counts."""
    found = {int(m.group(1)): m.group(2) for m in _OBJECT.finditer(content)}
    for body in list(found.values()):
        if b"/ObjStm" in body:
            data, first = _stream(body), int(re.search(rb"/First\s+(\d+)", body).group(1))
            pairs = [int(x) for x in data[:first].split()]
            starts = pairs[1::2] + [len(data) - first]
            for number, low, high in zip(pairs[::2], starts, starts[1:]):
                found.setdefault(number, data[first + low : first + high])
    return found


def _pages(objects: dict[int, bytes]) -> Iterator[bytes]:
    """Page objects in the order of the page tree."""
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog", b)), None)
    at = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", root) if root else None
    stack, seen = [int(at.group(1))] if at else [], set()
    while stack:
        number = stack.pop()
        body = objects.get(number, b"")
        if number in seen:
            continue
        seen.add(number)
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids:
            stack += [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", kids.group(1))][::-1]
        elif re.search(rb"/Type\s*/Page\b", body):
            yield body


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = _ESCAPE.sub(lambda m: bytes([int(m.group(1), 8) & 255]) if m.group(1) else b"" if m.group(2) else _NAMED.get(m.group(3), m.group(3)), token[1:-1])
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _lines(stream: bytes) -> list[str]:
    """The lines that text operators write, in the order of the stream; a move down begins a new one."""
    lines, line, operands = [], "", []
    for token in _TOKEN.findall(stream):
        if token[:1] in b"(<[]/-+.0123456789" and token not in (b"<<", b">>"):
            operands.append(token)
            continue
        texts = [t for t in operands if t[:1] in b"(<"]
        if token in (b"Tj", b"'", b'"', b"TJ"):
            if token in (b"'", b'"') and line:
                lines, line = [*lines, line], ""
            for t in operands:
                if t in texts:
                    line += _string(t)
                elif token == b"TJ" and t[:1] in b"-" and float(t) < WORD_GAP:
                    line += " "
        elif token in (b"T*", b"Tm", b"ET") or token in (b"Td", b"TD") and len(operands) > 1 and float(operands[-1]) != 0:
            if line:
                lines, line = [*lines, line], ""
        operands = []
    return [x for x in (*lines, line) if x.strip()]


def pdf_text(content: bytes) -> tuple[str, list[tuple[int, int, str]], str | None]:
    """Pages as units. A page's number in its first or last line is left out; files that are encrypted or cut short are refused."""
    if b"%%EOF" not in content[-TRAILER_BYTES:]:
        raise ValueError("no trailer")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
        raise PermissionError("encrypted")
    objects = _objects(content)
    text, units = "", []
    for number, page in enumerate(_pages(objects), 1):
        held = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        refs = re.findall(rb"(\d+)\s+\d+\s+R", held.group(1)) if held else []
        lines = _lines(b"\n".join(_stream(objects.get(int(r), b"")) for r in refs))
        for end in (0, -1):
            if lines and len(lines[end].strip()) <= PAGE_NUMBER_CHARS and lines[end].strip(" -–—").isdigit():
                lines.pop(end)
        units.append((number, len(text), f"page {number}"))
        text += "\n".join(lines) + "\n"
    return text.rstrip("\n"), units, None
