"""Column functions for text: white space, headings, line joins, wrapping, Markdown escapes, titles."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, for a character class.
SPACE = r"\t\n\x0B\f\r \x85\xA0  -     　"
_WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space that isn't one space between words; printable ASCII, most of a text, is told by two comparisons.
_OTHER = f"[[^ -~]&&[{SPACE}]]"
_SPARE = f" [{SPACE}]+|{_OTHER}[{SPACE}]*"
#: Characters that end a line.
BREAK = r"[\n\x0B\f\r\x85  ]"
_RARE_BREAKS = ("\x0b", "\f", "\x85", "\u2028", "\u2029")
WRAP = 90
_JOINT = "\u0001"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    return F.trim(_col(c), F.lit(_WHITE))


def collapse(c: Column | str) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), _SPARE, " "))


def collapsed(name: str) -> Column:
    """A column collapsed; as most need only a look, it is read several times, so not for an expression."""
    c = F.col(name)
    return F.trim(F.when(c.contains("  ") | c.rlike(_OTHER), F.regexp_replace(c, _SPARE, " ")).otherwise(c))


def line_feeds(c: Column | str) -> Column:
    """CRLF and CR as LF."""
    return F.when(_col(c).contains("\r"), F.regexp_replace(_col(c), "\r\n?", "\n")).otherwise(_col(c))


def split_lines(c: Column | str) -> Column:
    """The lines of a text without CR. Few texts have other breaks than line feeds: the pattern is for those."""
    rare = functools.reduce(Column.__or__, (_col(c).contains(x) for x in _RARE_BREAKS))
    return F.when(rare, F.split(_col(c), BREAK, -1)).otherwise(F.split(_col(c), "\n", -1))


def looks_like_heading(c: Column | str, flat: Column | None = None) -> Column:
    """At most 80 characters and 10 words, three letters, no full stop at the end, and all capitals or at most one word
    without a capital first. flat: the text collapsed, where a column has it, as it is looked at several times."""
    t = collapse(c) if flat is None else flat
    spaces = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    letters = t.rlike(r"^(?:\P{IsAlphabetic}*+\p{IsAlphabetic}){3}")
    small = t.rlike(r"[\p{IsAlphabetic}&&\P{IsUppercase}]")
    titled = F.regexp_count(t, F.lit(r"(?:^| )\p{IsUppercase}"))
    look = ~t.endswith(".") & (t != "") & (spaces <= 9) & letters & (~small | (titled >= F.greatest(F.lit(1), spaces)))
    # by cases, as what a conjunction uses twice is found for all rows
    return F.when(F.length(_col(c)) <= 80, look).when(F.length(_col(c)) > 80, False)


def join_lines(lines: Column | str) -> Column:
    """An array of lines without white space to spare as one text: a hyphen before a line that begins with a letter goes."""
    joined = F.array_join(_col(lines), _JOINT)
    return F.when(joined.contains(_JOINT), F.replace(F.regexp_replace(joined, rf"-{_JOINT}(?=\p{{IsAlphabetic}})", ""), F.lit(_JOINT), F.lit(" "))).otherwise(joined)


def indent_width(space: Column | str) -> Column:
    """Characters of white space, a tab counting four."""
    return F.length(_col(space)) + 3 * F.length(F.regexp_replace(_col(space), "[^\t]", ""))


def wrap(text: Column | str, indent: Column | int = 0) -> Column:
    """Lines of at most 90 characters with the indent, or 10 without it; longer words stay whole. The text has no white
    space to spare."""
    indent = F.lit(indent) if isinstance(indent, int) else indent
    width = F.greatest(F.lit(WRAP) - indent, F.lit(10))
    c, least, most = _col(text), (width + 1).cast("string"), width.cast("string")
    line = F.concat(F.lit("([^ ]{"), least, F.lit(",}|.{1,"), most, F.lit("})"))
    # what is left after the last break fits, or is one word: each match ends with a space that becomes a break
    broken = F.regexp_replace(c, F.concat(F.lit(r"\G(?=.{"), least, F.lit("})"), line, F.lit(" ")), F.lit("$1\n"))
    # joined lines have a space to spare where one ended with the character that joins them
    spare = c.startswith(" ") | c.endswith(" ") | c.contains("  ")
    loose = F.rtrim(F.regexp_replace(c, F.concat(line, F.lit("( |$)")), F.lit("$1\n")), F.lit("\n"))
    # most texts fit: the pattern, which is another one for each width, is for the rest
    return F.when(F.length(c) <= width, c).when(spare, loose).otherwise(broken)


def fence(text: Column | str) -> Column:
    """Backticks for a fence around the text: more than it has in a row, at least three."""
    runs = F.transform(F.regexp_extract_all(_col(text), F.lit("(`+)")), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def escape_cell(c: Column | str) -> Column:
    """A table cell: backslash and bar escaped, line breaks as <br>."""
    escaped = F.replace(F.replace(line_feeds(c), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.replace(escaped, F.lit("\n"), F.lit("<br>"))


def pad(c: Column, width: Column) -> Column:
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(width - F.length(c), F.lit(0))))


def _capitalised(word: Column) -> Column:
    keep = word.rlike(r"^\p{IsUppercase}{2,}$")
    return F.when(keep, word).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30))))


def stem(name: Column | str) -> Column:
    """A file name without its extension; a leading dot doesn't begin one."""
    return F.regexp_replace(_col(name), r"(?<=.)\.[^. ]+$", "")


def title(name: Column | str) -> Column:
    """A file name as a title: words apart, each with a capital first, all-capital words as they are."""
    base = stem(name)
    words = F.filter(F.split(F.translate(base, "_-", "  "), " "), lambda w: w != "")
    return F.when(F.size(words) == 0, base).otherwise(F.array_join(F.transform(words, _capitalised), " "))


def running_form(c: Column | str) -> Column:
    """A line for comparison between pages: each run of digits is 0."""
    return F.regexp_replace(collapse(c), r"\p{N}+", "0")


def ends_sentence(c: Column | str) -> Column:
    return _col(c).rlike(rf"[.!?:;][{SPACE}]*$")


def starts_sentence(c: Column | str) -> Column:
    return _col(c).rlike(rf"^[{SPACE}]*[\p{{IsUppercase}}\p{{N}}]")
