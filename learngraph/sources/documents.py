"""Scans of HTML, PPTX and PDF files into sections, one row each, over Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learngraph.sources import pdf

SCHEMA = "id string, seq long, page int, source string, content string"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LEFT_OUT = frozenset(["script", "style", "nav", "footer"])
_OPENING = frozenset(["h1", "h2", "h3"])
_READ = _OPENING | {"h4", "p", "pre", "code", "li", "table"}


class _Node:
    __slots__ = ("children", "name")

    def __init__(self, name: str) -> None:
        self.name, self.children = name, []

    def strings(self) -> Iterator[str]:
        """Texts below, stripped, without the empty ones."""
        todo = [iter(self.children)]
        while todo:
            for child in todo[-1]:
                if isinstance(child, str):
                    if bare := child.strip():
                        yield bare
                elif child.name not in _LEFT_OUT:
                    todo.append(iter(child.children))
                    break
            else:
                todo.pop()

    def elements(self) -> Iterator[_Node]:
        """Elements below, in document order."""
        todo = [iter(self.children)]
        while todo:
            for child in todo[-1]:
                if not isinstance(child, str) and child.name not in _LEFT_OUT:
                    yield child
                    todo.append(iter(child.children))
                    break
            else:
                todo.pop()


class _Tree(HTMLParser):
    """An element ends where its own end tag or that of one around it stands; nothing is closed by implication."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag)
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(_Node(tag))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def html_sections(page: str | None, separator: str = "") -> list[str]:
    """Texts of the sections of a page: each h1 to h3 begins one, h4 doesn't.

    Inline pieces are joined by ``separator``; elements inside one another (p in li) each add their text.
    """
    tree = _Tree()
    tree.feed(page or "")
    tree.close()
    out, held = [], []
    for node in tree.root.elements():
        if node.name not in _READ:
            continue
        text = separator.join(node.strings())
        if node.name in _OPENING:
            out.append(" ".join(held).strip())
            held = [text]
        elif text:
            held.append(text)
    out.append(" ".join(held).strip())
    return [t for t in out if t]


def pptx_sections(data: bytes) -> list[tuple[int, str]]:
    """(slide from 1, text): paragraphs of text frames, table rows joined by `` | ``, notes in brackets; slides without text are left out."""
    a, p = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    out = []

    def paragraphs(node) -> list[str]:
        found = ("".join(t.text or "" for t in para.iter(f"{a}t")).strip() for para in node.iter(f"{a}p"))
        return [t for t in found if t]

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())

        def targets(part: str) -> dict[str, tuple[str, str]]:
            folder, _, file = part.rpartition("/")
            rels = f"{folder}/_rels/{file}.rels"
            if rels not in names:
                return {}
            found = {}
            for r in ElementTree.fromstring(z.read(rels)):
                steps = (folder + "/" + r.get("Target", "")).split("/") if not r.get("Target", "").startswith("/") else r.get("Target")[1:].split("/")
                clean: list[str] = []
                for s in steps:
                    clean = clean[:-1] if s == ".." else [*clean, s]
                found[r.get("Id")] = (r.get("Type", ""), "/".join(clean))
            return found

        show = targets("ppt/presentation.xml")
        order = [show[s.get(f"{rel}id")][1] for s in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter(f"{p}sldId") if s.get(f"{rel}id") in show]
        for number, part in enumerate(order, 1):
            slide, lines = ElementTree.fromstring(z.read(part)), []
            for shape in slide.iter():
                if shape.tag == f"{p}sp":
                    lines += paragraphs(shape)
                elif shape.tag == f"{a}tr":
                    cells = [" ".join(paragraphs(c)) for c in shape.iter(f"{a}tc")]
                    if any(cells):
                        lines.append(" | ".join(c for c in cells if c))
            for kind, notes in targets(part).values():
                if kind.endswith("/notesSlide") and notes in names:
                    told = [t for s in ElementTree.fromstring(z.read(notes)).iter(f"{p}sp") if any(h.get("type") == "body" for h in s.iter(f"{p}ph")) for t in paragraphs(s)]
                    if told:
                        lines.append(f"[Notes: {' '.join(told)}]")
            if lines:
                out.append((number, "\n".join(lines)))
    return out


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|T[Jj*dDm]|'|\"|BT|ET", re.S)
_ESCAPES = {b"n": "\n", b"r": "\r", b"t": "\t", b"b": "\b", b"f": "\f"}


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    out, at = [], 1
    while at < len(raw) - 1:
        c = raw[at : at + 1]
        if c == b"\\":
            octal = re.match(rb"[0-7]{1,3}", raw[at + 1 : at + 4])
            if octal:
                out.append(chr(int(octal[0], 8) & 255))
                at += 1 + len(octal[0])
                continue
            out.append(_ESCAPES.get(raw[at + 1 : at + 2], raw[at + 1 : at + 2].decode("latin-1")))
            at += 2
            continue
        out.append(c.decode("latin-1"))
        at += 1
    return "".join(out)


def pdf_pages(data: bytes) -> list[tuple[int, str]]:
    """(page from 1, text) of the pages that show text, in the order of the page tree.

    Of a file without a page tree, the content streams that show text count as pages, in file order and with simple encodings. Encrypted files
    can't be read; for them give ``scan`` a reader of your own.
    """
    if (found := pdf.pages(data)) is not None:
        return found
    out = []
    for m in _STREAM.finditer(data):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        if b"BT" not in body or b"ET" not in body:
            continue
        text, pending = [], []
        for token in _SHOWN.findall(body):
            if token[:1] in b"(<" and token not in (b"'", b'"'):
                pending.append(_pdf_string(token))
                continue
            if token in (b"Tj", b"TJ", b"'", b'"'):
                text += pending
            elif token in (b"T*", b"Td", b"TD", b"Tm", b"ET") and text and not text[-1].endswith("\n"):
                text.append("\n")
            pending = []
        out.append("".join(text).strip())
    return [(k, t) for k, t in enumerate(out, 1) if t]


READERS: dict[str, Callable[[bytes], list[tuple[int, str]]]] = {
    "html": lambda data: list(enumerate(html_sections(data.decode("utf-8", "replace")), 1)),
    "pptx": pptx_sections,
    "pdf": pdf_pages,
}


def scan(files: DataFrame, *, id_col: str = "path", format_col: str = "format", content_col: str = "content", title_col: str | None = None, readers: dict[str, Callable] | None = None) -> DataFrame:
    """id, seq, page, source and content of every section of files with a known format.

    ``source`` is the title, or else the file's name. A file that can't be read fails the job with its
    id; null content has no section.
    """
    known = {**READERS, **(readers or {})}
    title = F.col(title_col) if title_col else F.regexp_extract(F.col(id_col).cast("string"), r"([^/]+)$", 1)

    def run(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for name, kind, data, source in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if data is None:
                    continue
                try:
                    found = known[kind](data)
                except Exception as e:
                    raise ValueError(f"cannot read {name} as {kind}") from e
                for seq, (page, text) in enumerate(found):
                    for c, v in zip(columns, (name, seq, page, source, text), strict=True):
                        c.append(v)
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "seq", "page", "source", "content"])

    return files.select(F.col(id_col).cast("string"), F.col(format_col), F.col(content_col).cast("binary"), title.cast("string")).mapInArrow(run, SCHEMA)
