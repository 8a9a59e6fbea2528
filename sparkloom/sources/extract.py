"""Text out of files: decoding, HTML, office and book archives, chat transcripts.

An extractor takes bytes and gives (text, units, title); it never raises: what cannot be read comes back as an
error class, so that one bad file fails alone. Offsets count code points.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.pdf import pdf_text

MAX_TAGS = 1_000_000
MAX_PART_BYTES = 64 << 20
#: All parts of an archive together, and how deep elements may lie in one another.
MAX_ARCHIVE_BYTES, MAX_NESTING = 512 << 20, 500
EXTRACTOR_VERSION = 6

# fixed values: elements that end a line, elements whose content is no text
_BLOCKS = frozenset((
    "p", "div", "section", "article", "aside", "h1", "h2", "h3", "h4", "h5", "h6", "header", "footer", "main", "nav", "ul", "ol", "li", "dl", "dt",
    "dd", "blockquote", "pre", "figure", "figcaption", "hr", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "form", "fieldset", "address",
    "body",
))
_SILENT = frozenset((
    "script", "style", "noscript", "template", "head",
))


def decode_text(content: Column) -> Column:
    """UTF-8 without its mark, else Latin-1."""
    bare = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 2_147_483_647)).otherwise(content)
    return F.when(F.is_valid_utf8(bare.cast("string")), bare.cast("string")).otherwise(F.decode(bare, "ISO-8859-1"))


SNIFFED_CHARS, SNIFFED_LINES = 65_536, 20


def is_chat_log(text: Column) -> Column:
    """Whether a text is a chat log by its content: one of its first lines is a record of a user's or assistant's message."""
    lines = F.slice(F.filter(F.split(F.substring(text, 1, SNIFFED_CHARS), "\n", -1), lambda x: F.length(F.trim(x)) > 0), 1, SNIFFED_LINES)
    record = lambda x: F.coalesce(F.get_json_object(x, "$.type"), F.lit("")).isin("user", "assistant") & F.get_json_object(x, "$.message").isNotNull()
    return F.coalesce(F.exists(lines, record), F.lit(False))


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.line = ""
        self.silent = self.pre = self.tags = 0
        self.title, self.in_title = "", False

    def end_line(self) -> None:
        if self.line.strip():
            self.lines.append(self.line.rstrip())
        self.line = ""

    def handle_starttag(self, tag, attrs) -> None:
        self.tags += 1
        if self.tags > MAX_TAGS:
            raise ValueError("too many tags")
        if tag == "title":
            self.in_title = True
        if tag in _SILENT:
            self.silent += 1
        elif tag in _BLOCKS or tag == "br":
            self.end_line()
        self.pre += tag == "pre"

    def handle_endtag(self, tag) -> None:
        if tag == "title":
            self.in_title = False
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in _BLOCKS:
            self.end_line()
        if tag == "pre":
            self.pre = max(0, self.pre - 1)

    def handle_data(self, data) -> None:
        if self.in_title:
            self.title += data
        if self.silent:
            return
        if self.pre:
            first, *rest = data.split("\n")
            self.line += first
            for part in rest:
                self.end_line()
                self.line = part
        else:
            words = re.sub(r"\s+", " ", data)
            self.line += words.lstrip() if not self.line or self.line.endswith(" ") else words


def html_text(page: str) -> tuple[str, str | None]:
    """(text, title): one line per block, white space collapsed outside preformatted text."""
    parser = _Page()
    parser.feed(page)
    parser.close()
    parser.end_line()
    return "\n".join(parser.lines).strip(), parser.title.strip() or None


def _parts(content: bytes, pattern: str) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        if sum(part.file_size for part in archive.infolist()) > MAX_ARCHIVE_BYTES:
            raise ValueError("archive too large")
        for name in sorted(archive.namelist(), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]):
            if re.fullmatch(pattern, name):
                if archive.getinfo(name).file_size > MAX_PART_BYTES:
                    raise ValueError("part too large")
                yield name, archive.read(name)


def _refuse_deep(xml: bytes) -> None:
    """Stop before a tree is built whose elements lie deeper than any document's do."""
    depth = 0
    for event, element in ElementTree.iterparse(io.BytesIO(xml), events=("start", "end")):
        depth += 1 if event == "start" else -1
        if depth > MAX_NESTING:
            raise ValueError("nested too deeply")
        if event == "end":
            element.clear()


def _joined(xml: bytes, paragraph: str) -> str:
    _refuse_deep(xml)
    root = ElementTree.fromstring(xml)
    texts = ("".join(t.text or "" for t in p.iter() if t.tag.rsplit("}", 1)[-1] == "t") for p in root.iter() if p.tag.rsplit("}", 1)[-1] == paragraph)
    return "\n".join(t for t in texts if t.strip())


def docx_text(content: bytes) -> tuple[str, list[tuple[int, int, str]], str | None]:
    return next((_joined(xml, "p") for _, xml in _parts(content, r"word/document\.xml")), ""), [], None


def pptx_text(content: bytes) -> tuple[str, list[tuple[int, int, str]], str | None]:
    """Slides as units, notes after their slide."""
    notes = {re.search(r"\d+", n).group(): _joined(x, "p") for n, x in _parts(content, r"ppt/notesSlides/notesSlide\d+\.xml")}
    text, units = "", []
    for number, (name, xml) in enumerate(_parts(content, r"ppt/slides/slide\d+\.xml"), 1):
        units.append((number, len(text), f"slide {number}"))
        own = re.search(r"(\d+)\.xml", name).group(1)
        text += _joined(xml, "p") + (f"\n[notes]\n{notes[own]}" if notes.get(own) else "") + "\n"
    return text.rstrip("\n"), units, None


def epub_text(content: bytes) -> tuple[str, list[tuple[int, int, str]], str | None]:
    """Chapters as units in the order of the manifest's spine, else of the archive; encrypted books are refused."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        if "META-INF/encryption.xml" in names:
            raise PermissionError("encrypted")
        pages = dict(_parts(content, r".*\.x?html?"))
        order, title = sorted(pages), None
        package = next((n for n in names if n.endswith(".opf")), None)
        if package:
            root = ElementTree.fromstring(archive.read(package))
            tag = lambda e: e.tag.rsplit("}", 1)[-1]
            items = {e.get("id"): e.get("href") for e in root.iter() if tag(e) == "item"}
            base = package.rsplit("/", 1)[0] + "/" if "/" in package else ""
            spine = [base + items[e.get("idref")] for e in root.iter() if tag(e) == "itemref" and e.get("idref") in items]
            order = [n for n in spine if n in pages] or order
            title = next((e.text for e in root.iter() if tag(e) == "title" and e.text), None)
    text, units = "", []
    for number, name in enumerate(order, 1):
        units.append((number, len(text), f"chapter {number}"))
        text += html_text(pages[name].decode("utf-8", "replace"))[0] + "\n"
    return text.rstrip("\n"), units, title


_INJECTED = re.compile(r"(?s)<(system-reminder|local-command-stdout|local-command-stderr|command-message|ide_selection|ide_opened_file)>.*?</\1>")
_COMMAND = re.compile(r"(?s)<command-name>(.*?)</command-name>(?:.*?<command-args>(.*?)</command-args>)?.*")
# fixed values: where a tool's one telling argument is looked for, and the texts that are no message
_ARGUMENTS = ("file_path", "path", "notebook_path", "command", "pattern", "query", "url", "skill", "description", "prompt", "name")
_NO_MESSAGE = ("<task-notification", "[Request interrupted")
TOOL_CHARS, SECTION_MINUTES = 160, 10


def transcript_text(lines: str) -> tuple[str, list[tuple[int, int, str]], str | None]:
    """A chat log of one JSON record per line as a conversation: sections by speaker, or ten minutes from a section's start."""
    from datetime import datetime

    said: list[tuple[str, datetime | None, str]] = []
    title = None
    for line in lines.splitlines():
        try:
            record = json.loads(line)
        except ValueError:
            continue
        if not isinstance(record, dict):
            continue
        kind = record.get("type")
        if kind in ("ai-title", "custom-title"):
            title = record.get("title") if kind == "custom-title" or not title else title
            continue
        if kind not in ("user", "assistant") or record.get("isMeta") or record.get("isCompactSummary") or record.get("isApiErrorMessage"):
            continue
        message = record.get("message") or {}
        content = message.get("content") if isinstance(message, dict) else None
        blocks = [{"type": "text", "text": content}] if isinstance(content, str) else content if isinstance(content, list) else []
        parts = []
        for block in blocks:
            if not isinstance(block, dict):
                continue
            if block.get("type") == "text" and isinstance(block.get("text"), str):
                text = block["text"]
                command = _COMMAND.fullmatch(text.strip()) if "<command-name>" in text else None
                text = " ".join(g.strip() for g in command.groups() if g) if command else _INJECTED.sub("", text).strip()
                if text and not text.startswith(_NO_MESSAGE):
                    parts.append(text)
            elif block.get("type") == "tool_use" and kind == "assistant":
                given = block.get("input") if isinstance(block.get("input"), dict) else {}
                argument = next((str(given[a]) for a in _ARGUMENTS if str(given.get(a) or "").strip()), "")
                argument = re.sub(r"^cd \S+\s*(?:&&|;)\s*", "", re.sub(r"\s+", " ", argument).strip())[:TOOL_CHARS]
                parts.append(f"tool: {block.get('name') or ''} {argument}".rstrip())
        if parts:
            try:
                at = datetime.fromisoformat(str(record.get("timestamp")).replace("Z", "+00:00"))
            except ValueError:
                at = None
            said.append((kind, at, re.sub(r"\n{3,}", "\n\n", "\n".join(parts))))
    text, units, speaker, since = "", [], None, None
    for who, at, words in said:
        late = bool(at and since and (at - since).total_seconds() >= SECTION_MINUTES * 60)
        if who != speaker or late:
            stamp = at.strftime("%Y-%m-%d %H:%MZ ") if at else ""
            text += ("\n\n" if text else "") + f"[{stamp}{who}]\n"
            units.append((len(units) + 1, len(text), who))
            speaker, since = who, at
        else:
            text += "\n"
        text += words
    return text, units, title


def _extract(kind: str, content: bytes) -> tuple[str | None, list, str | None, str | None]:
    try:
        if kind in ("docx", "pptx", "epub", "pdf"):
            text, units, title = {"docx": docx_text, "pptx": pptx_text, "epub": epub_text, "pdf": pdf_text}[kind](content)
        else:
            try:
                plain = content.removeprefix(b"\xef\xbb\xbf").decode("utf-8")
            except UnicodeDecodeError:
                plain = content.decode("latin-1")
            if kind in ("html", "htm"):
                text, title = html_text(plain)
                units = []
            elif kind == "jsonl":
                text, units, title = transcript_text(plain)
            else:
                text, units, title = plain, [], None
    except (PermissionError, zipfile.BadZipFile, KeyError) as e:
        return None, [], None, f"unreadable: {type(e).__name__}"
    except Exception as e:  # noqa: BLE001 - a file must fail alone
        return None, [], None, f"failed: {type(e).__name__}"
    if "\0" in text:
        ends = [(n, o - text.count("\0", 0, o), label) for n, o, label in units]
        text, units = text.replace("\0", ""), ends
    return text, units, title, None


def extract(files: DataFrame) -> DataFrame:
    """(path, text, units, title, error) of files (path, content), by the ending of the path."""
    unit = pa.struct([("unit_no", pa.int32()), ("start_offset", pa.int32()), ("unit_label", pa.string())])
    schema = pa.schema([("path", pa.string()), ("text", pa.string()), ("units", pa.list_(unit)), ("title", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text, units, title, error = _extract(path.rsplit(".", 1)[-1].lower(), content or b"")
                named = [{"unit_no": n, "start_offset": o, "unit_label": label} for n, o, label in units]
                for column, value in zip(out, (path, text, named, title, error)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    kinds = "path string, text string, units array<struct<unit_no:int,start_offset:int,unit_label:string>>, title string, error string"
    return files.select("path", "content").mapInArrow(run, kinds)
