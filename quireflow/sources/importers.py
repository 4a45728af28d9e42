"""Rich documents (HTML, DOCX, ODT, RTF, web archives) to paragraphs with font sizes and lists.

Sizes stand for the usual style of each kind of paragraph: body 12, headings of levels 1 to 3 at 24, 18 and 16, further
ones bold. A paragraph has the formats of the lists that it is in, from the outside in.
"""

from __future__ import annotations

import plistlib
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from io import BytesIO
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

BODY, HEADINGS = 12.0, {1: 24.0, 2: 18.0, 3: 16.0, 4: 12.0, 5: 12.0, 6: 12.0}


class Paragraph(NamedTuple):
    text: str
    max_size: float | None
    bold: bool
    list_path: list[str]


class _Html(HTMLParser):
    BLOCKS = set("p div article section header footer main nav aside ul ol li table tr td th h1 h2 h3 h4 h5 h6 pre blockquote form dl dt dd body hr figure figcaption address center".split())
    HIDDEN = {"script", "style", "head", "template", "noscript"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[Paragraph] = []
        self.parts: list[str] = []
        self.size, self.bold = 0.0, False
        self.hidden = self.strong = 0
        self.heading: int | None = None
        self.lists: list[str] = []

    def flush(self) -> None:
        text = "".join(self.parts)
        if text.strip():
            self.done.append(Paragraph(text, self.size or BODY, self.bold, list(self.lists)))
        self.parts, self.size, self.bold = [], 0.0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.HIDDEN:
            self.hidden += 1
        if tag == "body":
            self.hidden = 0
        if tag in self.BLOCKS:
            self.flush()
        if tag in ("ul", "ol"):
            kind = dict(attrs).get("type") or ""
            self.lists.append("{disc}" if tag == "ul" else {"a": "{lower-alpha}", "A": "{upper-alpha}", "i": "{lower-roman}", "I": "{upper-roman}"}.get(kind, "{decimal}"))
        elif tag in ("b", "strong"):
            self.strong += 1
        elif tag == "br":
            self.parts.append("\n")
        elif re.fullmatch("h[1-6]", tag):
            self.heading = int(tag[1])

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in self.BLOCKS:
            self.flush()
            self.strong = 0  # an unclosed mark ends with its block
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag in ("b", "strong"):
            self.strong = max(0, self.strong - 1)
        elif re.fullmatch("h[1-6]", tag):
            self.heading = None

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        self.parts.append(re.sub(r"[ \t\r\n\f]+", " ", data))
        if data.strip():
            self.size = max(self.size, HEADINGS[self.heading] if self.heading else BODY)
            self.bold |= bool(self.strong or self.heading)


def html(content: str | bytes) -> list[Paragraph]:
    if isinstance(content, bytes):
        named = re.search(rb"charset=[\"']?([\w-]+)", content[:2048])
        try:
            content = content.decode(named[1].decode() if named else "utf-8")
        except (UnicodeDecodeError, LookupError):
            content = content.decode("latin-1")
    parser = _Html()
    parser.feed(content)
    parser.close()
    parser.flush()
    return parser.done


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx(content: bytes) -> list[Paragraph]:
    with zipfile.ZipFile(BytesIO(content)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
        names = set(z.namelist())
        numbering = ET.fromstring(z.read("word/numbering.xml")) if "word/numbering.xml" in names else None
        styles = ET.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in names else None
    formats: dict[str, dict[str, str]] = {}
    if numbering is not None:
        abstract = {a.get(f"{_W}abstractNumId"): {lv.get(f"{_W}ilvl"): (lv.find(f"{_W}numFmt").get(f"{_W}val") if lv.find(f"{_W}numFmt") is not None else "bullet") for lv in a.iter(f"{_W}lvl")} for a in numbering.iter(f"{_W}abstractNum")}
        for n in numbering.iter(f"{_W}num"):
            ref = n.find(f"{_W}abstractNumId")
            formats[n.get(f"{_W}numId")] = abstract.get(ref.get(f"{_W}val"), {}) if ref is not None else {}
    sizes: dict[str, tuple[float | None, bool]] = {}
    for s in styles.iter(f"{_W}style") if styles is not None else ():
        run = s.find(f"{_W}rPr")
        size = run.find(f"{_W}sz") if run is not None else None
        sizes[s.get(f"{_W}styleId")] = (float(size.get(f"{_W}val")) / 2 if size is not None else None, run is not None and _on(run.find(f"{_W}b")))
    out = []
    for p in root.iter(f"{_W}p"):
        props, style, path = p.find(f"{_W}pPr"), None, []
        if props is not None:
            if (found := props.find(f"{_W}pStyle")) is not None:
                style = found.get(f"{_W}val")
            if (numbered := props.find(f"{_W}numPr")) is not None:
                level, num = numbered.find(f"{_W}ilvl"), numbered.find(f"{_W}numId")
                depth = int(level.get(f"{_W}val")) if level is not None else 0
                if num is not None and num.get(f"{_W}val") != "0":
                    kinds = formats.get(num.get(f"{_W}val"), {})
                    path = [_format(kinds.get(str(d), "bullet")) for d in range(depth + 1)]
        size, bold = sizes.get(style, (None, False))
        if size is None and style and (heading := re.fullmatch(r"(?i)heading ?([1-6])", style)):
            size, bold = HEADINGS[int(heading[1])], True
        elif size is None and style and style.lower() == "title":
            size = 24.0
        text, biggest, strong = [], 0.0, False
        for r in p.iter(f"{_W}r"):
            run = r.find(f"{_W}rPr")
            own = run.find(f"{_W}sz") if run is not None else None
            b = run.find(f"{_W}b") if run is not None else None
            piece = "".join({f"{_W}t": e.text or "", f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}.get(e.tag, "") for e in r)
            text.append(piece)
            if piece:
                biggest = max(biggest, float(own.get(f"{_W}val")) / 2 if own is not None else size or BODY)
                strong |= _on(b) if b is not None else bold
        out.append(Paragraph("".join(text), biggest or size, strong, path))
    return out


def _on(mark: ET.Element | None) -> bool:
    return mark is not None and mark.get(f"{_W}val", "true") not in ("0", "false", "off")


def _format(word: str) -> str:
    return {"decimal": "{decimal}", "lowerLetter": "{lower-alpha}", "upperLetter": "{upper-alpha}", "lowerRoman": "{lower-roman}", "upperRoman": "{upper-roman}"}.get(word, "{disc}")


_T = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_ST = "{urn:oasis:names:tc:opendocument:xmlns:style:1.0}"
_FO = "{urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0}"


def odt(content: bytes) -> list[Paragraph]:
    with zipfile.ZipFile(BytesIO(content)) as z:
        root = ET.fromstring(z.read("content.xml"))
    fonts: dict[str, tuple[float | None, bool]] = {}
    for style in root.iter(f"{_ST}style"):
        props = style.find(f"{_ST}text-properties")
        if props is not None:
            size = re.fullmatch(r"([\d.]+)pt", props.get(f"{_FO}font-size", ""))
            fonts[style.get(f"{_ST}name")] = (float(size[1]) if size else None, props.get(f"{_FO}font-weight") == "bold")
    kinds = {s.get(f"{_ST}name"): ["{decimal}" if lv.tag.endswith("number") else "{disc}" for lv in s] for s in root.iter(f"{_T}list-style")}
    out: list[Paragraph] = []

    def walk(node: ET.Element, path: list[str], style: str | None) -> None:
        for child in node:
            if child.tag in (f"{_T}p", f"{_T}h"):
                size, bold = fonts.get(child.get(f"{_T}style-name"), (None, False))
                if child.tag == f"{_T}h" and size is None:
                    size, bold = HEADINGS[min(6, max(1, int(child.get(f"{_T}outline-level", "1"))))], True
                spans = [fonts.get(s.get(f"{_T}style-name"), (None, False)) for s in child.iter(f"{_T}span") if "".join(s.itertext()).strip()]
                sizes = [s for s, _ in spans if s]
                out.append(Paragraph("".join(_odt_text(child)), max([size or BODY, *sizes]), bold or any(b for _, b in spans), path))
            elif child.tag == f"{_T}list":
                name = child.get(f"{_T}style-name") or style
                levels = kinds.get(name, [])
                walk(child, [*path, levels[len(path)] if len(path) < len(levels) else "{disc}"], name)
            else:
                walk(child, path, style)

    walk(root, [], None)
    return out


def _odt_text(node: ET.Element) -> Iterator[str]:
    yield node.text or ""
    for child in node:
        if child.tag == f"{_T}s":
            yield " " * int(child.get(f"{_T}c", "1"))
        elif child.tag in (f"{_T}tab", f"{_T}line-break"):
            yield "\t" if child.tag == f"{_T}tab" else "\n"
        elif child.tag != f"{_T}note":
            yield from _odt_text(child)
        yield child.tail or ""


_RTF = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z'])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
_RTF_SKIP = {b"fonttbl", b"colortbl", b"stylesheet", b"info", b"pict", b"header", b"footer", b"listtable", b"listoverridetable", b"generator", b"xmlnstbl", b"themedata", b"object", b"fldinst"}
_RTF_TEXT = {b"tab": "\t", b"line": "\n", b"bullet": "•", b"emdash": "—", b"endash": "–", b"lquote": "‘", b"rquote": "’", b"ldblquote": "“", b"rdblquote": "”", b"cell": "\t"}


def rtf(content: bytes) -> list[Paragraph]:
    if not content.lstrip().startswith(b"{\\rtf"):
        raise ValueError("not RTF")
    page = re.search(rb"\\ansicpg(\d+)", content)
    encoding = f"cp{page[1].decode()}" if page else "cp1252"
    out: list[Paragraph] = []
    text: list[str] = []
    biggest, strong = 0.0, False
    state: dict = dict(size=BODY, bold=False, skip=False, uc=1)
    stack: list[dict] = []
    ignore = 0

    def end() -> None:
        nonlocal text, biggest, strong
        out.append(Paragraph("".join(text), biggest or None, strong, []))
        text, biggest, strong = [], 0.0, False

    def add(piece: str) -> None:
        nonlocal biggest, strong
        if piece and not state["skip"]:
            text.append(piece)
            if piece.strip():
                biggest, strong = max(biggest, state["size"]), strong or state["bold"]

    for m in _RTF.finditer(content):
        word, number, code, symbol, brace, plain = m.groups()
        if brace == b"{":
            stack.append(dict(state))
        elif brace == b"}":
            state = stack.pop() if stack else state
        elif symbol is not None:
            if symbol == b"*":
                state["skip"] = True
            else:
                add({b"~": "\xa0", b"_": "-", b"\n": "\n"}.get(symbol, symbol.decode("latin-1") if symbol in b"\\{}" else ""))
        elif code is not None:
            if ignore:
                ignore -= 1
            else:
                add(bytes.fromhex(code.decode()).decode(encoding, "replace"))
        elif word is not None:
            if word in _RTF_SKIP:
                state["skip"] = True
            elif word in (b"par", b"sect", b"page", b"row"):
                if not state["skip"]:
                    end()
            elif word == b"plain":
                state |= dict(size=BODY, bold=False)
            elif word == b"b":
                state["bold"] = number != b"0"
            elif word == b"fs" and number:
                state["size"] = int(number) / 2
            elif word == b"uc" and number:
                state["uc"] = int(number)
            elif word == b"u" and number:
                add(chr(int(number) % 65536))
                ignore = state["uc"]
            elif word in _RTF_TEXT:
                add(_RTF_TEXT[word])
        elif plain is not None:
            piece = plain.decode(encoding, "replace")
            piece, ignore = piece[ignore:], max(0, ignore - len(piece))
            add(piece)
    if text:
        end()
    return out


def webarchive(content: bytes) -> list[Paragraph]:
    main = plistlib.loads(content)["WebMainResource"]
    data = main["WebResourceData"]
    return html(data.decode(main.get("WebResourceTextEncodingName") or "utf-8", "replace"))


IMPORTERS: dict[str, Callable[[bytes], list[Paragraph]]] = {"html": html, "htm": html, "docx": docx, "odt": odt, "rtf": rtf, "rtfd": rtf, "webarchive": webarchive}


def paragraphs(docs: DataFrame, key: str = "doc_id", content: str = "content", extension: str | None = None, only: str | None = None) -> DataFrame:
    """key, para, text, max_size, bold, list_path and error, a row for each paragraph of content (binary or text), by the
    document's extension or all as ``only``. A document that can't be read has one row with an error; an empty one none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("ext").to_pylist() if extension else [only] * batch.num_rows
            for k, kind in enumerate(kinds):
                value, rows, error = batch.column("content")[k].as_py(), [], None
                try:
                    if value is not None:
                        if kind not in IMPORTERS:
                            raise ValueError(f"no importer for {kind}")
                        rows = IMPORTERS[kind](value)
                except Exception as e:  # noqa: BLE001 - whatever a file makes a parser raise is that document's error
                    rows, error = [], f"{type(e).__name__}: {e}"
                n = max(len(rows), bool(error))
                if n:
                    listed = rows or [Paragraph("", None, False, [])]
                    columns = [pa.array([p[i] for p in listed], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.string())))]
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array([k] * n)), pa.array(range(1, n + 1), pa.int32()), *columns, pa.array([error] * n, pa.string())], names=["key", "para", "text", "max_size", "bold", "list_path", "error"])

    kind = docs.schema[key].dataType.simpleString()
    chosen = docs.selectExpr(f"`{key}` AS key", f"`{content}` AS content", *([f"`{extension}` AS ext"] if extension else []))
    return chosen.mapInArrow(run, f"key {kind}, para int, text string, max_size double, bold boolean, list_path array<string>, error string").withColumnRenamed("key", key)
