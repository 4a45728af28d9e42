"""A folder of files of every family, end to end, and the names of outputs."""

from __future__ import annotations

import io
import json
import os
import plistlib
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quireflow.operators import render as R
from quireflow.operators import values as V
from quireflow.plans import convert
from quireflow.sources import importers, outputs
from quireflow.streaming import drop

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*paragraphs: tuple[str, str]) -> bytes:
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>' for style, text in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


FILES: dict[str, bytes] = {
    "Minutes.md": b"# Minutes\n\nWe met- \nings were kept short and\nnobody spoke twice.\n\n- tea\n- cake\n  and more cake\n",
    "minutes.CSV": b"Name,Rank\r\nAda|x,1\r\n\"Grace \"\"G\"\"\",2\r\n",
    "data.json": b'{"b": [1, {"c": null}], "a": 12345678901234567890.5}',
    "bad.json": b'{"a":1} x',
    "tree.xml": b"<r><x>1</x><x>2</x></r>",
    "list.plist": plistlib.dumps({"on": True, "n": 3}),
    ".env": b"KEY='v'\n",
    "tool.py": b"print('`````')\n",
    "latin.ini": b"name = caf\xe9\n",
    "latin.txt": b"caf\xe9\n",
    "page.html": b"<h1>Big</h1><p>Some <b>text</b> that goes on.</p><ol><li>one</li></ol>",
    "memo.docx": docx(("Title", "Memo Title"), ("Normal", "Plain words."), ("Normal", "and more of them.")),
    "memo.rtf": rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\fs48 Loud\par\fs24 quiet caf\'e9\par more\par more\par}",
    "scan.png": b"\x89PNG",
    "paper.pdf": b"%PDF",
    "_plain.txt": b"only words here\n",
    ".hidden": b"",
    "noext": b"",
    "odd.xyz": b"",
    "empty.csv": b"",
}


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, content in FILES.items():
        (folder / name).write_bytes(content)
    (folder / "sub.txt").mkdir()
    return folder


def test_folder_to_markdown(spark, source, tmp_path):
    target = tmp_path / "out"
    using = convert.converters(ocr=lambda b: "seen text", pdf=lambda b: ["top line 1\n\nfirst and", "top line 2\n\n", "top line 3\n\nlast"])
    report = {r.name: r for r in convert.convert_folder(spark, str(source), str(target), using=using).collect()}
    assert set(report) == {*FILES, "sub.txt"}
    read = lambda name: open(report[name].output_path).read()
    assert read("Minutes.md") == "# Minutes\n\nWe metings were kept short and nobody spoke twice.\n\n- tea\n- cake and more cake\n"
    assert read("minutes.CSV") == "# Minutes\n\n| Name      | Rank |\n| --------- | ---- |\n| Ada\\|x    | 1    |\n| Grace \"G\" | 2    |\n"
    assert os.path.basename(report["minutes.CSV"].output_path) == "minutes-csv.md" or os.path.basename(report["Minutes.md"].output_path) == "Minutes-md.md"
    assert read("data.json") == "# Data\n\n- a: 12345678901234567890.5\n- b:\n  - 1\n  - Item 2:\n    - c: null\n"
    assert read("tree.xml") == "# Tree\n\n- r:\n  - x:\n    - 1\n    - 2\n"
    assert read("list.plist") == "# List\n\n- n: 3\n- on: true\n"
    assert read(".env") == "# .env\n\n- KEY: v\n"
    assert read("tool.py") == "# Tool\n\n``````\nprint('`````')\n``````\n"
    assert read("latin.ini") == "# Latin\n\n- name: café\n"
    assert read("page.html") == "# Big\n\nSome text that goes on.\n\n1. one\n"
    assert read("memo.docx") == "# Memo Title\n\nPlain words.\n\nand more of them.\n"
    assert read("memo.rtf") == "# Loud\n\nquiet café\n\nmore\n\nmore\n"
    assert read("scan.png") == "# Scan\n\nseen text\n"
    assert read("paper.pdf") == "# Paper\n\n## Page 1\n\nfirst and\n\n## Page 2\n\n_No extractable text on this page._\n\n## Page 3\n\nlast\n"
    assert read("_plain.txt") == "# Plain\n\nonly words here\n"
    assert read("empty.csv") == "# Empty\n"
    assert {n: r.message for n, r in report.items() if r.status == "skipped"} == {".hidden": "Hidden file.", "noext": "Unsupported file type (no file extension).", "odd.xyz": "Unsupported file type (.xyz).", "sub.txt": "Directory."}
    assert {n for n, r in report.items() if r.status == "failed"} == {"bad.json", "latin.txt"}


def test_folder_to_json_never_replaces(spark, source, tmp_path):
    target = tmp_path / "out"
    target.mkdir()
    (target / "data.json").write_text("kept")
    report = {r.name: r for r in convert.convert_folder(spark, str(source), str(target), "json", "2024-05-06T07:08:09Z").collect()}
    assert (target / "data.json").read_text() == "kept"
    assert report["data.json"].message == "Saved as data-json.json to avoid overwriting another file."
    made = json.loads((target / "data-json.json").read_text())
    assert made["source"] == {"convertedAt": "2024-05-06T07:08:09Z", "fileExtension": "json", "fileName": "data.json"}
    assert made["content"] == {"data": {"a": 12345678901234567890.5, "b": [1, {"c": None}]}} and made["summary"] == {"blockCount": 0, "dataPresent": True}
    table = json.loads(open(report["minutes.CSV"].output_path).read())
    assert table["content"]["data"] == [{"Name": "Ada|x", "Rank": "1"}, {"Name": 'Grace "G"', "Rank": "2"}] and table["summary"]["tableCount"] == 1
    assert report["scan.png"].status == report["paper.pdf"].status == "failed"


@pytest.mark.parametrize("source,existing,reserved,want", [
    ("/s/report.pdf", (), (), ("/t/report.md", False)),
    ("/s/report.pdf", ("/t/report.md",), (), ("/t/report-pdf.md", True)),
    ("/t/notes.md", (), (), ("/t/notes-md.md", True)),
    ("/s/data.csv", (), ("/t/DATA.md",), ("/t/data-csv.md", True)),
    ("/s/data.csv", ("/t/data.md", "/t/data-csv.md"), (), ("/t/data-csv-2.md", True)),
    ("/s/.env", (), (), ("/t/env.md", False)),
    ("/s/plain", ("/t/plain.md",), (), ("/t/plain-2.md", True)),
])
def test_names(source, existing, reserved, want):
    assert outputs.plan([source], "/t", "md", set(existing).__contains__, reserved) == [(source, *want)]


def test_a_stream_of_files(spark, source, tmp_path):
    done = drop.convert_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state"))
    done.awaitTermination()
    names = set(os.listdir(tmp_path / "out"))
    assert {"data.md", "tree.md", "tool.md"} <= names
    report = {os.path.basename(r.path): r for r in spark.read.parquet(str(tmp_path / "state" / "report")).collect()}
    assert report["bad.json"].status == report["scan.png"].status == "failed" and report["data.json"].status == "converted"
    before = len(names)
    drop.convert_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert len(os.listdir(tmp_path / "out")) == before


@pytest.mark.parametrize("text,want", [("[]", "[]"), ("null", "null"), ("1e400", '"1e400"'), ("1.50", "1.5"), ("-0", "0"), ('{"a":1,"a":2}', '{"a":2}'), ("1" * 50, f'"{"1" * 50}"')])
def test_canonical_json(text, want):
    assert V.canonical(V.from_json(text)) == want


@pytest.mark.parametrize("text", ["", "{", "NaN", "[1] 2", "'a'"])
def test_json_that_cant_be_read(text):
    with pytest.raises(ValueError):
        V.from_json(text)


def test_odt_and_webarchive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", '<o xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><text:h text:outline-level="1">Top</text:h><text:p>a<text:s/>b</text:p></o>')
    assert [(p.text, p.max_size) for p in importers.odt(out.getvalue())] == [("Top", 24.0), ("a b", 12.0)]
    packed = plistlib.dumps({"WebMainResource": {"WebResourceData": b"<p>hi</p>", "WebResourceTextEncodingName": "utf-8"}})
    assert [p.text for p in importers.webarchive(packed)] == ["hi"]


def test_files_that_parsers_choke_on_are_rows_of_the_report(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    good = docx(("Title", "Memo"), ("Normal", "words " * 200))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<a>" + "text " * 500 + "</a>")
    damaged = bytearray(packed.getvalue())
    damaged[60:90] = b"\xff" * 30
    locked = bytearray(good)
    locked[6] |= 1
    locked[bytes(locked).rindex(b"PK\x01\x02") + 8] |= 1
    for name, content in (("good.docx", good), ("damaged.docx", bytes(damaged)), ("locked.docx", bytes(locked)), ("broken.webarchive", b"<?xml version='1.0'?><plist><dict><key>"), ("deep.html", b"<p>fine</p>")):
        (folder / name).write_bytes(content)
    report = convert.convert_folder(spark, str(folder), str(tmp_path / "out"))
    assert {r.name: r.status for r in report.collect()} == {"good.docx": "converted", "deep.html": "converted", "damaged.docx": "failed", "locked.docx": "failed", "broken.webarchive": "failed"}
    told = outputs.summary(report).first()
    assert (told.total, told.converted, told.failed) == (5, 2, 3) and told.duration > 0 and told.started_at <= told.finished_at


def test_a_long_table_takes_time_in_proportion(spark):
    rows = [[str(i), "x|y", None] if i % 2 else [str(i)] for i in range(20_000)]
    df = spark.createDataFrame([(["a", "b", "c"], rows)], "c array<string>, r array<array<string>>")
    started = time.perf_counter()
    text = df.select(R.table_document(F.lit("T"), F.col("c"), F.col("r")).alias("t")).first().t
    assert time.perf_counter() - started < 15 and text.count("\n") == 20_004 and "| 19999 | x\\|y |   |" in text
