"""The block parser and the merge of wrapped lines against models that go line by line."""

from __future__ import annotations

import random
import re

from quireflow.operators import blocks as B
from quireflow.operators import pages as P

_S = " \t\n\x0b\f\r\x85\xa0"
_LIST = re.compile(r"^([ \t\xa0]*)([-*]|\d+[.)]|[A-Za-z][.)])[ \t\xa0]+(.+)$")
_ATX = re.compile(r"^(#{1,6})[ \t\xa0]+(.+)$")


def collapse(t: str) -> str:
    return " ".join(re.split(f"[{_S}]+", t)).strip(" ")


def looks_like_heading(t: str) -> bool:
    flat = collapse(t)
    words = flat.split(" ") if flat else []
    letters = [c for c in flat if c.isalpha()]
    if len(t) > 80 or flat.endswith(".") or not 1 <= len(words) <= 10 or len(letters) < 3:
        return False
    return all(c.isupper() for c in letters) or sum(w[0].isupper() for w in words) >= max(1, len(words) - 1)


def join(lines: list[str]) -> str:
    out = ""
    for line in map(collapse, lines):
        if not line:
            continue
        out = line if not out else out[:-1] + line if out.endswith("-") and line[0].isalpha() else f"{out} {line}"
    return out


def width(space: str) -> int:
    return len(space) + 3 * space.count("\t")


def model(text: str) -> list[tuple]:
    """(type, text, level, style, depth, index) of each block."""
    lines = re.split(r"[\n\x0b\f\r\x85]", re.sub("\r\n?", "\n", text).replace("•", "- "))
    out: list[tuple] = []
    para: list[str] = []
    item: list | None = None

    def flush() -> None:
        nonlocal item
        if para:
            out.append(("paragraph", join(para), None, None, None, None))
            para.clear()
        if item:
            out.append(("listItem", join(item[0]), None, *item[1:4]))
            item = None

    i = 0
    while i < len(lines):
        raw, t = lines[i], lines[i].strip(_S)
        after = lines[i + 1].strip(_S) if i + 1 < len(lines) else ""
        i += 1
        if not t:
            flush()
        elif m := _ATX.match(t):
            flush()
            out.append(("heading", collapse(m[2]), len(m[1]), None, None, None))
        elif re.fullmatch("={3,}|-{3,}", after):
            flush()
            out.append(("heading", collapse(t), 1 if after[0] == "=" else 2, None, None, None))
            i += 1
        elif m := _LIST.match(raw):
            flush()
            number = re.match("[0-9]+", m[2])
            item = [[m[3]], "ordered" if number or m[2][0].isalpha() else "unordered", width(m[1]) // 2, int(number[0]) if number else None, width(m[1])]
        elif item and width(re.match("[ \t]*", raw)[0]) > item[4]:
            item[0].append(t)
        elif not after and looks_like_heading(t):
            flush()
            out.append(("heading", collapse(t), 1, None, None, None))
        else:
            if item:
                flush()
            para.append(t)
    flush()
    return [b for b in out if b[1]]


SHAPES = ["", " ", "words that go on", "Some Title", "SHOUTED", "===", "---", "====", "- item", "  * inner", "\t1. tabbed", "A. letter", "12) twelve", "   deeper", "      far deeper", "# head", "####### seven", "cut-", "hyphen- ated", "• dot • dot", "ends here.", "x\xa0y  z"]


def test_blocks_match_the_model(spark):
    rng = random.Random(11)
    texts = ["\n".join(rng.choice(SHAPES) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, "")], "doc_id long, text string")
    got: dict[int, list] = {}
    for r in sorted(B.blocks(docs).collect(), key=lambda r: (r.doc_id, r.order)):
        got.setdefault(r.doc_id, []).append((r.type, r.text, r.heading_level, r.list_style, r.list_depth, r.list_index))
    assert -1 not in got and -2 not in got
    for i, t in enumerate(texts):
        assert got.get(i, []) == model(t), t


def test_blocks_take_one_shuffle(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = B.blocks(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_merge_matches_the_model(spark):
    rng = random.Random(5)
    kinds = [("paragraph", "goes on"), ("paragraph", "Ends."), ("paragraph", "starts low, ends;"), ("listItem", "item"), ("listItem", "item."), ("heading", "Head"), ("paragraph", "Up"), ("paragraph", "cut-")]
    rows, want = [], {}
    for doc in range(800):
        merged: list[list] = []
        last = ""
        for k in range(rng.randint(1, 12)):
            kind, text = rng.choice(kinds)
            rows.append((doc, 1, k + 1, kind, text, None, None, None, None))
            ends, begins = last[-1:] in tuple(".!?:;"), text[0].isupper()
            if kind == "paragraph" and merged and (merged[-1][0] == "paragraph" and not (ends and begins) or merged[-1][0] == "listItem" and not ends):
                merged[-1][1].append(text)
            else:
                merged.append([kind, [text]])
            last = text
        want[doc] = [(kind, join(texts)) for kind, texts in merged]
    df = spark.createDataFrame(rows, "doc_id long, page int, `order` int, type string, text string, heading_level int, list_style string, list_depth int, list_index long")
    got: dict[int, list] = {}
    for r in sorted(P.merge_wrapped(df).collect(), key=lambda r: (r.doc_id, r.order)):
        got.setdefault(r.doc_id, []).append((r.type, r.text))
    assert got == want
