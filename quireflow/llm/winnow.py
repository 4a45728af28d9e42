"""Benchmark decontamination by winnowing.

The words of a text, in lower case and without anything but letters and digits, are hashed in groups of ``k``. Of every
``window`` groups that follow each other the one with the least hash is a fingerprint (all of them, where several tie).
Two texts that share ``window + k - 1`` words in a row therefore share a fingerprint there. Fingerprints of documents
and benchmark items are joined and each hit is extended over equal words to both sides; shared spans of at least
``window + k - 1`` words are the result, all of them and no others.

The fingerprints of the benchmark go to every executor if the benchmark has at most ``most_bytes`` of text; else both
sides are shuffled by fingerprint. Words without letters or digits aren't counted. Null and empty texts, and items or
documents of fewer words, share nothing. Repeated rows give a span once. Null ids stay null and count as one document.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm import words as W

K, WINDOW, MOST_BYTES = 6, 8, 32 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Texts(NamedTuple):
    offsets: np.ndarray  #: into the words that count
    words: np.ndarray  #: their hashes
    places: np.ndarray  #: the place of each among the words of its text


def read(column: pa.Array) -> Texts:
    offsets, words = W.split(W.flat(column))
    hashed = W.hashes(words, plainly=True)
    places = np.arange(len(hashed)) - offsets[:-1][W.owners(offsets)]
    full = hashed != 0  # of no letters or digits
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        hashed, places = hashed[full], places[full]
    return Texts(offsets, hashed, places)


def fingerprints(texts: Texts, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the fingerprints are among the words, and their hashes."""
    groups = W.grams(texts.words, k)
    inside = W.within(texts.offsets, k, len(texts.words))
    groups[~inside] = _NONE
    n = len(groups) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, width = groups, 1
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    # a group is a fingerprint if it is the least of a window that has it: if the greatest of their least is its hash
    most = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    width = 1
    while width < window:
        step = min(width, window - width)
        most = np.maximum(most[: len(most) - step], most[step:])
        width += step
    at = np.flatnonzero((most == groups) & inside)
    return at, groups[at]


class Benchmark(NamedTuple):
    texts: Texts
    items: np.ndarray  #: the item of each text
    hashes: np.ndarray  #: fingerprints in order
    places: np.ndarray  #: where each is among the words

    @staticmethod
    def of(items: list, column: pa.Array, k: int, window: int) -> Benchmark:
        texts = read(column)
        at, hashed = fingerprints(texts, k, window)
        order = np.argsort(hashed, kind="stable")
        return Benchmark(texts, np.array(items, object), hashed[order], at[order])


def extend(a: Texts, b: Texts, hits: Iterator[tuple[int, int]], least: int) -> set[tuple[int, int, int, int, int]]:
    """(text of a, text of b, first word, one past the last word, words) of the shared spans, by hits of one word in each.
    The first and last word are places in the text of a."""
    found, reach = set(), {}
    for p, q in sorted(hits):
        if p < reach.get(p - q, -1):
            continue
        i, j = int(np.searchsorted(a.offsets, p, "right")) - 1, int(np.searchsorted(b.offsets, q, "right")) - 1
        n = int(min(a.offsets[i + 1] - p, b.offsets[j + 1] - q))
        other = np.flatnonzero(a.words[p : p + n] != b.words[q : q + n])
        after = int(other[0]) if len(other) else n
        m = int(min(p - a.offsets[i], q - b.offsets[j]))
        other = np.flatnonzero(a.words[p - m : p] != b.words[q - m : q])
        before = m - 1 - int(other[-1]) if len(other) else m
        reach[p - q] = p + after
        if before + after >= least:
            found.add((i, j, int(a.places[p - before]), int(a.places[p + after - 1]) + 1, before + after))
    return found


def _hits(texts: Texts, bench: Benchmark, k: int, window: int) -> list[tuple[int, int]]:
    at, hashed = fingerprints(texts, k, window)
    lo, hi = np.searchsorted(bench.hashes, hashed, "left"), np.searchsorted(bench.hashes, hashed, "right")
    return [(int(at[x]), int(bench.places[y])) for x in np.flatnonzero(hi > lo) for y in range(lo[x], hi[x])]


def _fits(benchmark: DataFrame, most_bytes: int) -> bool:
    size = benchmark.select(F.sum(F.octet_length("text") + 16)).first()[0]
    return (size or 0) <= most_bytes


def _collected(benchmark: DataFrame, k: int, window: int):
    rows = benchmark.select("item_id", "text").collect()
    return benchmark.sparkSession.sparkContext.broadcast(Benchmark.of([r[0] for r in rows], pa.array([r[1] for r in rows], pa.string()), k, window))


def shared(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, item_id, span_start, span_end (places of words in the document) and n_words (that count), a row for each shared span."""
    least = window + k - 1
    ids, items = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {ids}, item_id {items}, span_start int, span_end int, n_words int"
    names = ["doc_id", "item_id", "span_start", "span_end", "n_words"]
    if _fits(benchmark, most_bytes):
        held = _collected(benchmark, k, window)
        item_type = pa.int64() if items == "bigint" else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = held.value
            for batch in batches:
                for part in W.slices(batch, "text"):
                    texts = read(part.column("text"))
                    rows = sorted(extend(texts, bench.texts, _hits(texts, bench, k, window), least))
                    if rows:
                        i, j, a, b, n = zip(*rows)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(i)), pa.array([bench.items[x] for x in j], item_type), *(pa.array(x, pa.int32()) for x in (a, b, n))], names=names)

        return docs.select("doc_id", "text").mapInArrow(run, schema).distinct()

    def prints(key: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in W.slices(batch, "text"):
                    texts = read(part.column("text"))
                    at, hashed = fingerprints(texts, k, window)
                    i = W.owners(texts.offsets)[at]
                    yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(i)), pa.array((at - texts.offsets[i]).astype(np.int32)), pa.array(hashed.view(np.int64))], names=[key, "at", "print"])

        return run

    left = docs.select("doc_id", "text").mapInArrow(prints("doc_id"), f"doc_id {ids}, at int, print bigint")
    right = benchmark.select("item_id", "text").mapInArrow(prints("item_id"), f"item_id {items}, at int, print bigint")
    hits = left.withColumnRenamed("at", "p").join(right.withColumnRenamed("at", "q"), "print").groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("p", "q")).alias("hits"))
    texts = docs.select(F.col("doc_id").alias("d"), F.col("text").alias("doc_text")).distinct()
    paired = hits.join(texts, F.col("doc_id").eqNullSafe(F.col("d"))).drop("d")
    paired = paired.join(benchmark.select(F.col("item_id").alias("i"), F.col("text").alias("item_text")).distinct(), F.col("item_id").eqNullSafe(F.col("i"))).drop("i")

    def lengthen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = read(pa.array([row["doc_text"]], pa.string())), read(pa.array([row["item_text"]], pa.string()))
                pairs = [(h["p"], h["q"]) for h in row["hits"] if h["p"] < len(a.words) and h["q"] < len(b.words) and a.words[h["p"]] == b.words[h["q"]]]
                rows = sorted(extend(a, b, pairs, least))
                if rows:
                    _, _, s, e, n = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]] * len(rows), batch.schema.field("doc_id").type), pa.array([row["item_id"]] * len(rows), batch.schema.field("item_id").type), *(pa.array(x, pa.int32()) for x in (s, e, n))], names=names)

    return paired.mapInArrow(lengthen, schema).distinct()


def decontaminated(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows and columns of the documents that share no span with the benchmark."""
    if not _fits(benchmark, most_bytes):
        # what a row shares depends on its text alone: ids may be null or repeated
        texts = docs.select(F.sha2("text", 256).alias("doc_id"), "text")
        bad = shared(texts, benchmark, k, window, most_bytes).select(F.col("doc_id").alias("__bad_id")).distinct()
        return docs.join(bad, F.sha2(docs["text"], 256) == bad["__bad_id"], "left_anti")
    held = _collected(benchmark, k, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = held.value
        for batch in batches:
            for part in W.slices(batch, "text"):
                texts = read(part.column("text"))
                clean = np.ones(part.num_rows, bool)
                clean[[i for i, *_ in extend(texts, bench.texts, _hits(texts, bench, k, window), window + k - 1)]] = False
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def op9_winnowing(spark, sf_dir: str) -> DataFrame:
    return shared(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql_words(table: str, key: str) -> str:
    return f"""SELECT {key}, place, word, row_number() OVER (PARTITION BY {key} ORDER BY place) AS j FROM (
    SELECT {key}, t.i - 1 AS place, lower(regexp_replace(ws[t.i], '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS word
    FROM (SELECT {key}, {W.SQL_WORDS} AS ws FROM {table}), unnest(range(1, len(ws) + 1)) AS t(i))
  WHERE word <> ''"""


def _sql_grams(source: str, key: str) -> str:
    n = K + WINDOW - 1
    return f"""SELECT {key}, j, place, lead(place, {n - 1}) OVER w AS last, {" || ' ' || ".join(f"lead(word, {x}) OVER w" for x in range(n))} AS gram
  FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY j)"""


SQL = f"""
WITH dw AS ({_sql_words("documents", "doc_id")}),
bw AS ({_sql_words("benchmark", "item_id")}),
dg AS ({_sql_grams("dw", "doc_id")}),
bg AS ({_sql_grams("bw", "item_id")}),
hits AS (SELECT doc_id, item_id, dg.j, dg.place, dg.last, dg.j - bg.j AS apart FROM dg JOIN bg ON dg.gram = bg.gram),
runs AS (SELECT *, j - row_number() OVER (PARTITION BY doc_id, item_id, apart ORDER BY j) AS run FROM hits)
SELECT DISTINCT doc_id, item_id, min(place)::INTEGER AS span_start, (max(last) + 1)::INTEGER AS span_end, (count(*) + {K + WINDOW - 2})::INTEGER AS n_words
FROM runs GROUP BY doc_id, item_id, apart, run
"""
