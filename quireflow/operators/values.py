"""JSON, XML, property lists and INI texts as one value tree, written as canonical JSON: sorted keys, exact decimals.

Parsers give a struct of value and error: a document that can't be read is a row with an error, not a failed job.
"""

from __future__ import annotations

import base64
import json
import plistlib
import re
import xml.parsers.expat
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quireflow.functions import text as T
from quireflow.operators.delimited import quoted

INVALID = "Invalid or unreadable document."
_RESULT = StructType([StructField("value", StringType()), StructField("error", StringType())])
_SPACES = " \t\n\x0b\f\r\x85\xa0                　"


class _Number(str):
    """The text of a number."""


def number_text(text: str) -> str | None:
    """A decimal of at most 38 digits without exponent and trailing zeros; None where it doesn't fit one."""
    value = Decimal(text)
    _, digits, exponent = value.as_tuple()
    if len("".join(map(str, digits)).strip("0")) > 38 or not isinstance(exponent, int) or not -128 <= exponent <= 127 or value.adjusted() > 164:
        return None
    plain = format(value, "f")
    plain = plain.rstrip("0").rstrip(".") if "." in plain else plain
    return "0" if plain in ("-0", "") else plain


_PLAIN = re.compile(r"0|-?[1-9][0-9]{0,37}").fullmatch
#: As json.dumps without ensure_ascii, which makes an encoder each time.
_string = json.JSONEncoder(ensure_ascii=False).encode


def canonical(value: Any) -> str:
    kind = type(value)
    if kind is str:
        return _string(value)
    if kind is _Number and _PLAIN(value):
        return str(value)
    if kind is dict:
        return "{" + ",".join([f"{_string(k)}:{canonical(value[k])}" for k in sorted(value)]) + "}"
    if kind is list:
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, _Number):
        fits = number_text(value)
        return json.dumps(str(value)) if fits is None else fits
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float, Decimal)):
        return canonical(_Number(repr(value) if isinstance(value, float) else str(value)))
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    return "[" + ",".join(map(canonical, value)) + "]"


def _refuse(text: str) -> Any:
    raise ValueError(text)


#: One for all texts: ``json.loads`` with hooks makes a decoder each time.
_DECODER = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_refuse)


def loads(text: str) -> Any:
    """Strict JSON, numbers as their text."""
    if text.startswith("\ufeff"):
        raise ValueError("byte order mark")
    return _DECODER.decode(text)


def from_json(text: str) -> Any:
    return loads(text.removeprefix("﻿"))


def from_xml(content: str) -> Any:
    """The root's name and value: a leaf is its text, attributes are @name, equal children an array, other text #text."""
    parser = xml.parsers.expat.ParserCreate()
    parser.buffer_text = True
    stack: list[list] = [[None, {}, [], []]]

    def start(name: str, attributes: dict) -> None:
        stack.append([name, attributes, [], []])

    def end(_: str) -> None:
        name, attributes, children, texts = stack.pop()
        text = "".join(texts).strip(_SPACES)
        value: Any = text
        if children or attributes:
            grouped: dict[str, list] = {}
            for child, v in children:
                grouped.setdefault(child, []).append(v)
            value = {f"@{k}": v for k, v in attributes.items()} | {k: v[0] if len(v) == 1 else v for k, v in grouped.items()}
            if text:
                value["#text"] = text
        stack[-1][2].append((name, value))

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: stack[-1][3].append(data)
    parser.Parse(content if isinstance(content, (bytes, bytearray)) else content.encode(), True)
    return dict([stack[0][2][0]])


def from_plist(content: bytes) -> Any:
    """XML and binary property lists: dates as ISO 8601 in UTC, data as base64."""

    def plain(value: Any) -> Any:
        if isinstance(value, dict):
            return {k: plain(v) for k, v in value.items()}
        if isinstance(value, list):
            return [plain(v) for v in value]
        if isinstance(value, datetime):
            return (value if value.tzinfo else value.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        if isinstance(value, bytes):
            return base64.b64encode(value).decode()
        if isinstance(value, plistlib.UID):
            return value.data
        return value

    return plain(plistlib.loads(content if isinstance(content, (bytes, bytearray)) else content.encode()))


def from_ini(text: str) -> Any:
    """Keys before a section are the root's; a section of the same name takes a key's place. Values are strings."""
    root: dict[str, Any] = {}
    sections: dict[str, dict] = {}
    current = root
    for raw in re.split("\r\n|\r|\n", text):
        line = raw.strip(" \t ")
        if not line or line[0] in ";#":
            continue
        if line[0] == "[" and line[-1] == "]":
            name = line[1:-1].strip()
            if name:
                current = sections.setdefault(name, {})
            continue
        found = re.match(r"([^=:]*)[=:](.*)$", line, re.S)
        if found and found[1].strip():
            value = found[2].strip()
            if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            current[found[1].strip()] = value
    return root | sections


def _column(parser: Callable[[Any], Any], content: Column | str) -> Column:
    @F.pandas_udf(_RESULT)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            values, errors = [], []
            for content in part:
                value, error = None, None
                try:
                    value = None if content is None else canonical(parser(content))
                except (ValueError, KeyError, IndexError, RecursionError, OverflowError, xml.parsers.expat.ExpatError, plistlib.InvalidFileException):
                    error = INVALID
                values.append(value)
                errors.append(error)
            yield pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object)})

    return run(F.col(content) if isinstance(content, str) else content)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by their keys over four tasks for each core, or a quarter of the shuffle partitions if those are more: a
    table of few bytes is one split of a file, so one task, and parsing its rows takes long."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 4, 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def json_value(text: Column | str) -> Column:
    return _column(from_json, text)


def xml_value(content: Column | str) -> Column:
    return _column(from_xml, content)


def plist_value(content: Column | str) -> Column:
    return _column(from_plist, content)


def ini_value(text: Column | str) -> Column:
    return _column(from_ini, text)


def ini_entries(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, section (null for the root), key and value, a row for each entry that counts, without Python: the form for
    many or large files."""
    order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = "[ \t\\xA0]"
    cut = lambda c: F.regexp_replace(c, f"^{edge}+|{edge}+$", "")
    listed = docs.select(*keys, F.posexplode(F.split(T.line_feeds(text), "\n", -1)).alias("pos", "raw")).withColumn("t", cut(F.col("raw"))).where(~F.col("t").rlike("^([;#]|$)"))
    is_section = F.col("t").rlike(r"^\[.*\]$")
    name = F.when(is_section, cut(F.regexp_extract("t", r"^\[(.*)\]$", 1)))
    marked = listed.withColumns({"section": F.last(F.when(name != "", name), True).over(order), "is_section": is_section})
    value = cut(F.regexp_extract("t", r"(?s)^[^=:]*[=:](.*)$", 1))
    pairs = marked.where(~F.col("is_section") & F.col("t").rlike("^[^=:]*[=:]")).select(*keys, "pos", "section", cut(F.regexp_extract("t", "^([^=:]*)[=:]", 1)).alias("key"), F.regexp_replace(value, r"(?s)^([\"'])(.*)\1$", "$2").alias("value")).where("key <> ''")
    return pairs.groupBy(*keys, "section", "key").agg(F.max_by("value", "pos").alias("value"))


def ini_json(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys and value, canonical JSON from the entries; documents without entries have {}. Sections without entries show
    in ``ini_value`` only."""
    pair = lambda k, v: F.struct(k.alias("k"), F.concat(quoted(k), F.lit(":"), v).alias("p"))
    joined = lambda c: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["p"]), ","), F.lit("}"))
    entries = ini_entries(docs, keys, text)
    inner = entries.where("section IS NOT NULL").groupBy(*keys, "section").agg(joined(pair(F.col("key"), quoted(F.col("value")))).alias("v")).select(*keys, F.col("section").alias("key"), "v", F.lit(1).alias("rank"))
    outer = entries.where("section IS NULL").select(*keys, "key", quoted(F.col("value")).alias("v"), F.lit(0).alias("rank"))
    top = outer.unionByName(inner).groupBy(*keys, "key").agg(F.max_by("v", "rank").alias("v"))
    made = top.groupBy(*keys).agg(joined(pair(F.col("key"), F.col("v"))).alias("value"))
    return docs.select(*keys).join(made, list(keys), "left").select(*keys, F.coalesce("value", F.lit("{}")).alias("value"))


_RUNS = re.compile(f"[{_SPACES}]+")


def _collapsed(text: str) -> str:
    if text.isprintable():  # no white space but the space
        return " ".join(text.split())
    return _RUNS.sub(" ", text).strip(" ")


def value_items(value: str) -> list[tuple[int, int, str]]:
    """(order, depth, text) of the list items that a value in JSON reads as."""
    out: list[tuple[int, int, str]] = []
    # a stack in place of recursion: values may be deep
    todo: list[tuple[Any, str | None, int]] = [(loads(value), None, 0)]
    while todo:
        v, key, depth = todo.pop()
        kind = type(v)
        if kind is dict or kind is list:
            if key is not None:
                out.append((len(out) + 1, depth, _collapsed(f"{key}:")))
            inner = depth + (key is not None)
            if kind is dict:
                todo += [(v[k], k, inner) for k in sorted(v, reverse=True)]
                continue
            for i in range(len(v) - 1, -1, -1):
                if type(v[i]) in (dict, list):
                    todo += [(v[i], None, inner + 1), (f"Item {i + 1}:", None, inner)]
                else:
                    todo.append((v[i], None, inner))
            continue
        text = v if isinstance(v, str) else json.dumps(v)
        out.append((len(out) + 1, depth, _collapsed(text if key is None else f"{key}: {text}")))
    return out


def value_blocks(values: DataFrame, keys: Sequence[str] = ("doc_id",), value: str = "value") -> DataFrame:
    """Blocks of the list items of values in canonical JSON."""

    @F.pandas_udf("array<struct<order:int,list_depth:int,text:string>>")
    def items(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([None if v is None else [{"order": o, "list_depth": d, "text": t} for o, d, t in value_items(v)] for v in part], dtype=object)

    found = values.select(*keys, F.explode(items(F.col(value))).alias("i"))
    return found.select(*keys, "i.order", F.lit("listItem").alias("type"), "i.text", F.lit(None).cast("int").alias("heading_level"), F.lit("unordered").alias("list_style"), "i.list_depth", F.lit(None).cast("bigint").alias("list_index"))
