"""Quality rule: repetition inside a document, by suffix array.

The words of each document are ordered by suffix; prefixes are doubled and only suffixes whose rank is still shared are
ranked again. The longest common prefixes of neighbours form intervals: a run of suffixes that all share so many words.
An interval whose suffixes don't all follow the same word is a maximal repeat. Each suffix counts for the longest one
that it is in; the union of the spans of those of at least ``min_words`` words is the covered part. A document stays if that
part is at most ``max_covered`` of its words and no repeat is longer than ``max_longest`` words.

Words are runs of characters other than ASCII white space; a character of a script without spaces is a word by itself
(``words.UNSPACED``). Null and empty texts have no words, no repeat, and stay. Every input row gives one row, repeated rows and
null ids included; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quireflow.llm import shared
from quireflow.llm import words as W

MIN_WORDS, MAX_COVERED, MAX_LONGEST = 10, 0.3, 100


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and a number for each word, equal for equal words."""
    offsets, words = W.split(texts)
    return offsets, words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)


def suffixes(offsets: np.ndarray, codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring suffixes of the suffix array that share at least ``least`` words of one document: the places of
    all suffixes in order, and the words that each shares with the one before it (0 where fewer than ``least``)."""
    n = len(codes)
    owner = W.owners(offsets)
    end = offsets[1:][owner]
    key = owner * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], np.diff(key[order]) != 0])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start  # the place of a rank's first suffix, so that splitting one leaves the others alone
    levels, h = [rank.copy()], 1
    shared = np.bincount(start, minlength=n)[start] > 1
    at = np.flatnonzero(shared)  # places in the order that aren't unique yet
    while len(at):
        places = order[at]
        first = rank[places]
        ahead = places + h
        second = np.where(ahead < end[places], rank[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((second, first))
        places, first, second = places[by], first[by], second[by]
        order[at] = places
        new = np.concatenate([[True], (np.diff(first) != 0) | (np.diff(second) != 0)])
        start = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[places] = start
        h *= 2
        levels.append(rank.copy())
        sizes = np.diff(np.append(np.flatnonzero(new), len(at)))
        at = at[np.repeat(sizes, sizes) > 1]
    # the words that two neighbours share: the largest powers of two first
    common = np.zeros(n, np.int64)
    step = least.bit_length() - 1
    if step >= len(levels):
        return order, common
    near = np.flatnonzero(levels[step][order[1:]] == levels[step][order[:-1]]) + 1
    a, b = order[near], order[near - 1]
    length = np.zeros(len(near), np.int64)
    for level in reversed(range(len(levels))):
        i, j = a + length, b + length
        inside = (i < end[a]) & (j < end[b])
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        fits = inside & (levels[level][i] == levels[level][j]) & (i + (1 << level) <= end[a]) & (j + (1 << level) <= end[b])
        length += fits * (1 << level)
    common[near] = np.where(length >= least, length, 0)
    return order, common


_MIXED = -2


def intervals(order: np.ndarray, common: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, list[int]]]:
    """The maximal repeats, inner intervals first, as (length, first of its suffixes in the order, one past the last, and
    those of them, by place in the text, that no inner one has)."""
    begins = np.zeros(len(codes) + 1, bool)
    begins[offsets] = True
    before = np.where(begins[:-1], -1 - np.arange(len(codes)), np.roll(codes, 1))  # a text's first word follows nothing
    at = np.flatnonzero(common)
    if not len(at):
        return
    breaks = np.flatnonzero(np.diff(at) > 1) + 1
    for run in np.split(at, breaks):
        lo, hi = int(run[0]) - 1, int(run[-1])
        places, depths = order[lo : hi + 1].tolist(), common[lo + 1 : hi + 1].tolist() + [0]
        lefts = before[order[lo : hi + 1]].tolist()
        stack: list[list] = []  # depth, first suffix, the word before all of its suffixes or _MIXED, suffixes not counted yet
        for k, depth in enumerate(depths):
            first, left, own = k, lefts[k], [places[k]]
            if stack and stack[-1][0] >= depth or not stack and not depth:
                # the suffix ends the intervals that are deeper than what it shares with the next
                while stack and stack[-1][0] > depth:
                    d, f, word, rest = stack.pop()
                    if left != word:
                        left = _MIXED
                    if len(own) > len(rest):
                        rest, own = own, rest
                    rest += own
                    first, own = f, rest
                    if left == _MIXED:
                        yield d, lo + f, lo + k + 1, own
                        own = []
                if stack and stack[-1][0] == depth:
                    top = stack[-1]
                    if top[2] != left:
                        top[2] = _MIXED
                    if len(own) > len(top[3]):
                        own, top[3] = top[3], own
                    top[3] += own
                    continue
            if depth:
                stack.append([depth, first, left, own])


def measure(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its words, the words that repeats cover, and the words of the longest repeat."""
    offsets, codes = tokens(texts)
    count = np.diff(offsets)
    covered, longest = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
    if len(codes):
        order, common = suffixes(offsets, codes, least)
        reach = np.zeros(len(codes), np.int64)
        lengths, sizes, places = [], [], []
        for depth, _, _, own in intervals(order, common, codes, offsets):
            lengths.append(depth)
            sizes.append(len(own))
            places += own
        reach[np.array(places, np.int64)] = np.repeat(np.array(lengths, np.int64), sizes)
        some = np.flatnonzero(reach)
        edges = np.bincount(some, minlength=len(codes) + 1) - np.bincount(some + reach[some], minlength=len(codes) + 1)
        owner = W.owners(offsets)
        covered = np.bincount(owner[np.cumsum(edges)[:-1] > 0], minlength=len(count))
        np.maximum.at(longest, owner[some], reach[some])
    return count, covered, longest


def repetition(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """doc_id, n_words, covered_words, longest_repeat, covered_fraction (0 without words) and keep, a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                count, covered, longest = measure(W.flat(part.column("text")), min_words)
                fraction = covered / np.maximum(count, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (count, covered, longest)), pa.array(fraction), pa.array((fraction <= max_covered) & (longest <= max_longest))],
                    names=["doc_id", "n_words", "covered_words", "longest_repeat", "covered_fraction", "keep"],
                )

    shared.small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, covered_words bigint, longest_repeat bigint, covered_fraction double, keep boolean")


def op1_repetition(spark, sf_dir: str) -> DataFrame:
    return repetition(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH w AS (
  SELECT doc_id, {W.SQL_WORDS} AS words
  FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(words[i : i + {MIN_WORDS - 1}], ' ') AS gram
  FROM w, unnest(range(1, len(words) - {MIN_WORDS - 2})) AS t(i)),
r AS (SELECT doc_id, i, gram FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
cover AS (
  SELECT doc_id, count(DISTINCT i + j) AS covered FROM r, unnest(range({MIN_WORDS})) AS t(j) GROUP BY doc_id),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS apart FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.i < b.i),
runs AS (SELECT doc_id, apart, i - row_number() OVER (PARTITION BY doc_id, apart ORDER BY i) AS run FROM pairs),
longest AS (
  SELECT doc_id, max(n) + {MIN_WORDS - 1} AS longest FROM (SELECT doc_id, apart, run, count(*) AS n FROM runs GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(covered, 0)::BIGINT AS covered_words, coalesce(longest, 0)::BIGINT AS longest_repeat,
       coalesce(covered, 0) / greatest(len(words), 1)::DOUBLE AS covered_fraction,
       coalesce(covered, 0) / greatest(len(words), 1)::DOUBLE <= {MAX_COVERED} AND coalesce(longest, 0) <= {MAX_LONGEST} AS keep
FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
