"""Delimited text to tables: a tolerant parser, header detection, rows as objects."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quireflow.functions import text as T

_ROWS = ArrayType(ArrayType(StringType()))


def parse(text: str, delimiter: str = ",") -> list[list[str]]:
    """Rows of cells. A quote opens and closes a quoted part anywhere in a cell, two of them inside one are a quote; line
    breaks in it stay. A row ends at LF, CR or CRLF. Cells lose white space at their ends, rows without any text go, and
    the first cell a byte order mark."""
    rows: list[list[str]] = []
    row: list[str] = []
    cell: list[str] = []
    at, quoted = 0, False
    marks = re.compile(f'["\r\n{re.escape(delimiter)}]')
    while at < len(text):
        if quoted:
            end = text.find('"', at)
            if end < 0:
                cell.append(text[at:])
                break
            cell.append(text[at:end])
            at, quoted = end + 1, False
            if text[at : at + 1] == '"':
                cell.append('"')
                at, quoted = at + 1, True
            continue
        mark = marks.search(text, at)
        if not mark:
            cell.append(text[at:])
            break
        cell.append(text[at : mark.start()])
        at = mark.end()
        if mark[0] == '"':
            quoted = True
            continue
        row.append("".join(cell))
        cell = []
        if mark[0] != delimiter:
            rows.append(row)
            row = []
            if mark[0] == "\r" and text[at : at + 1] == "\n":
                at += 1
    rows.append([*row, "".join(cell)])
    rows = [trimmed for r in rows if any(trimmed := [c.strip() for c in r])]
    if rows:
        rows[0][0] = rows[0][0].removeprefix("﻿")
    return rows


def rows(text: Column | str, delimiter: Column | str = ",") -> Column:
    """The rows of a delimited text, an array of arrays of strings."""

    @F.pandas_udf(_ROWS)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, delimiters in parts:
            yield pd.Series([None if t is None else parse(t, d) for t, d in zip(texts, delimiters)], dtype=object)

    return run(F.col(text) if isinstance(text, str) else text, F.lit(delimiter) if isinstance(delimiter, str) else delimiter)


def has_header(cells: Column) -> Column:
    """Whether the first row is a header: as many cells with a letter as plain numbers, at least one."""
    first = F.transform(F.coalesce(F.get(cells, F.lit(0)), F.array().cast("array<string>")), T.trim)
    alpha = F.size(F.filter(first, lambda c: c.rlike(r"\p{L}|\p{M}")))
    numeric = F.size(F.filter(first, lambda c: ~c.rlike(r"\p{L}|\p{M}") & c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$")))
    return (alpha > 0) & (alpha >= numeric)


def column_names(cells: Column) -> Column:
    """The header, or Column 1 to n for the n cells of the first row."""
    first = F.coalesce(F.get(cells, F.lit(0)), F.array().cast("array<string>"))
    numbered = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(first))), lambda i: F.concat(F.lit("Column "), i.cast("string")))
    return F.when(has_header(cells), first).otherwise(numbered)


def data_rows(cells: Column) -> Column:
    return F.when(has_header(cells), F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))).otherwise(cells)


def quoted(c: Column) -> Column:
    """A text as a JSON string."""
    json = F.to_json(F.array(c))
    return F.substring(json, F.lit(2), F.length(json) - 2)


def objects(cells: Column) -> Column:
    """The rows as canonical JSON: under a header an object for each, where short rows have empty values, more cells are
    left out and of equal names the last counts; else arrays."""
    names = column_names(cells)
    last = lambda names: F.filter(F.array_sort(F.array_distinct(names)), lambda n: n.isNotNull())
    place = lambda n: F.array_max(F.filter(F.transform(names, lambda x, i: F.when(x == n, i)), lambda i: i.isNotNull()))
    as_object = lambda r: F.concat(F.lit("{"), F.array_join(F.transform(last(names), lambda n: F.concat(quoted(n), F.lit(":"), quoted(F.coalesce(F.get(r, place(n)), F.lit(""))))), ","), F.lit("}"))
    as_array = lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, quoted), ","), F.lit("]"))
    shown = F.when(has_header(cells), F.transform(data_rows(cells), as_object)).otherwise(F.transform(cells, as_array))
    return F.concat(F.lit("["), F.array_join(shown, ","), F.lit("]"))
