"""Repeated passages across documents: suffix array by distributed prefix doubling.

The suffixes of all documents are ranked by their first h words for growing h. A rank pair (rank at a place, rank h words
on) ranks twice as many words: Spark sorts the pairs, equal neighbours get one new rank, and places whose pair is unique
are dropped, as no longer prefix of theirs repeats. Ranks go back to their documents, where those h words apart meet, for
the next round. It ends when h reaches the threshold of ``LEAST`` words (the last round pairs ranks that overlap); what is
left are the passages of that many words that occur at least twice.

The first ranks, of ``START`` words, are hashes, made where the text is: two of 32 bits make a pair. Most places are unique at
that length already, and needn't be sorted to know it. In every ``LEAST`` words, the group of ``ANCHOR`` words with the least
hash is an anchor, chosen alike wherever the passage stands; only anchors are shuffled at first, and only places whose
anchor occurs twice go into the doubling. And of documents with the same text only the two with the least ids take part: what
the second one repeats is its whole text, and so it is for the others. Neither changes the result, which is that of sorting
all places, up to collisions of the hashes.

Which anchors and texts occur again goes to every executor while these are few (``MOST_SENT``): anchors as a bitmap of a fixed
size, whose wrong positives the doubling drops. Beyond, documents are joined with their own.

Words are runs of characters other than ASCII white space, compared as they are; characters of scripts without spaces are
words by themselves (``words.UNSPACED``). A passage may repeat within one document. Null ids can't be named and are left out;
a document's id is its identity, so repeated rows count once, and of an id with several texts the one of the least hash
counts. Null, empty and shorter texts have no passages. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm import shared
from quireflow.llm import words as W
from quireflow.llm.winnow import Texts, fingerprints

LEAST, START, ANCHOR = 50, 13, 16
MOST_SENT, MARKS = 1 << 22, 28  #: MARKS: log2 of the bits of the bitmap of anchors


def _read(column: pa.Array) -> Texts:
    offsets, words = W.split(W.flat(column))
    return Texts(offsets, W.hashes(words), np.zeros(0, np.int64))


def whole(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows that are sorted by the first ``keys`` columns, in parts that don't separate equal keys."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(rows[0]):
            continue
        held.append(rows)
        if len(held) > 1 and all(rows[k][-1] == held[0][k][-1] for k in range(keys)):
            continue
        rows = [np.concatenate(x) for x in zip(*held)] if len(held) > 1 else rows
        differs = np.zeros(len(rows[0]), bool)
        for k in range(keys):
            differs |= rows[k] != rows[k][-1]
        last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        held = [[x[last:] for x in rows]]
        if last:
            yield [x[:last] for x in rows]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _repeated(keys: list[np.ndarray], doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows that are left, by keys, doc and place, and whether each starts a group: groups with one
    (doc, place) are dropped, and of rows that agree in all one is left."""
    new = _starts(*keys)
    sizes = np.diff(np.append(np.flatnonzero(new), len(doc)))
    at = np.flatnonzero(np.repeat(sizes > 1, sizes))
    group = np.cumsum(new)[at]
    at = at[np.lexsort((place[at], doc[at], group))]
    group = np.cumsum(new)[at]
    once = _starts(group, doc[at], place[at])
    at, group = at[once], group[once]
    new = _starts(group) if len(group) else np.zeros(0, bool)
    sizes = np.diff(np.append(np.flatnonzero(new), len(at)))
    some = np.repeat(sizes > 1, sizes)
    return at[some], new[some]


def _survivors(docs: DataFrame, id_type: str, anchor: int, window: int) -> DataFrame:
    """doc_id and the hashes of its anchors that occur twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                texts = _read(part.column("text"))
                at, hashed = fingerprints(texts, anchor, window)
                owner = W.owners(texts.offsets)[at]
                long = np.diff(texts.offsets)[owner] >= anchor + window - 1
                at, hashed, owner = at[long], hashed[long], owner[long]
                yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), part.column("doc_id").take(pa.array(owner)), pa.array((at - texts.offsets[owner]).astype(np.int32))], names=["h", "doc_id", "place"])

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, doc, place in whole(batches, 1):
            at, _ = _repeated([h], doc, place)
            yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(h[at])], names=["doc_id", "h"])

    anchors = docs.mapInArrow(run, f"h bigint, doc_id {id_type}, place int")
    return anchors.repartition("h").sortWithinPartitions("h").mapInArrow(twice, f"doc_id {id_type}, h bigint")


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, the least and the greatest hash of its texts, and the same for another hash."""
    hashed = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"))
    return hashed.groupBy("doc_id").agg(F.min("a").alias("a"), F.max("a").alias("x"), F.min("b").alias("b"), F.max("b").alias("y"))


def _copies(hashed: DataFrame) -> DataFrame:
    """doc_id and whole, the second least id of those that have the same text, for all further ones of these. An id with
    several texts is no copy."""
    one = hashed.where("a = x AND b = y").select("doc_id", "a", "b")
    # the least of all, then of the rest: no list of all copies of a text is made
    least = one.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 2").drop("n")
    later = one.join(least, ["a", "b"]).where("doc_id <> least")
    second = later.groupBy("a", "b").agg(F.min("doc_id").alias("whole"))
    return later.join(second, ["a", "b"]).where("doc_id <> whole").select("doc_id", "whole")


def _ranked(rows: DataFrame, id_type: str) -> DataFrame:
    """doc_id, place, r1, r2 to doc_id, place, rank and first: pairs in order, without unique ones. first: of the places
    of a rank the one of the least doc_id and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for r1, r2, doc, place in whole(batches, 2):
            at, new = _repeated([r1, r2], doc, place)
            if len(at):
                rank = base + np.cumsum(new) - 1
                base = int(rank[-1]) + 1
                yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(place[at]), pa.array(rank), pa.array(new)], names=["doc_id", "place", "rank", "first"])

    return rows.select("r1", "r2", "doc_id", "place").repartition("r1", "r2").sortWithinPartitions("r1", "r2").mapInArrow(run, f"doc_id {id_type}, place int, rank bigint, first boolean")


def _ahead(ranked: DataFrame, id_type: str, step: int) -> DataFrame:
    """The pairs of the next round: the rank at each place and the one ``step`` words on, where there are both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, place, rank in whole(batches, 1):
            at = np.cumsum(_starts(doc)) << 32 | place
            next_ = np.minimum(np.searchsorted(at, at + step), len(at) - 1)
            both = np.flatnonzero(at[next_] == at + step)
            yield pa.RecordBatch.from_arrays([pa.array(rank[both]), pa.array(rank[next_[both]]), pa.array(doc[both]), pa.array(place[both])], names=["r1", "r2", "doc_id", "place"])

    return ranked.select("doc_id", "place", "rank").repartition("doc_id").sortWithinPartitions("doc_id", "place").mapInArrow(run, f"r1 bigint, r2 bigint, doc_id {id_type}, place int")


def _bitmap(found: DataFrame) -> np.ndarray:
    """A bit for each anchor that occurs twice; at most MOST_SENT marks come to the driver."""
    marks = found.select(F.shiftrightunsigned("h", 64 - MARKS).cast("int").alias("m")).distinct().toArrow()["m"].to_numpy()
    bits = np.zeros(1 << (MARKS - 3), np.uint8)
    np.bitwise_or.at(bits, marks >> 3, (1 << (marks & 7)).astype(np.uint8))
    return bits


def _places(docs: DataFrame, least: int, start: int, anchor: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, place, r1 and r2 of the places to sort, and the copies that are left out."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    spark, window = docs.sparkSession, least - anchor + 1
    found, hashed = shared.cut(_survivors(docs, id_type, anchor, window)), shared.cut(_hashed(docs))
    copies, several = shared.cut(_copies(hashed)), shared.cut(hashed.where("a <> x").select("doc_id", F.col("a").alias("own")))
    few = max(found.select("h").distinct().count(), copies.count(), several.count()) <= MOST_SENT
    ids = lambda df: df.toArrow().combine_chunks()
    held = spark.sparkContext.broadcast((_bitmap(found), ids(copies.select("doc_id")), ids(several)) if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if held.value is not None:
                _, left_out, several = held.value
                own = several["own"].take(pc.index_in(batch.column("doc_id"), several["doc_id"]))
                wrong = pc.fill_null(pc.not_equal(own, batch.column("a")), False)
                batch = batch.filter(pc.invert(pc.or_(pc.is_in(batch.column("doc_id"), left_out["doc_id"]), wrong)))
            for part in W.slices(batch, "text"):
                texts = _read(part.column("text"))
                n = len(texts.words)
                groups = W.grams(texts.words, anchor)
                groups[~W.within(texts.offsets, anchor, n)] = np.uint64(0xFFFFFFFFFFFFFFFF)
                lowest, width = groups, 1
                while width < window:
                    step = min(width, window - width)
                    lowest = np.minimum(lowest[: max(0, len(lowest) - step)], lowest[step:])
                    width += step
                if held.value is not None:
                    mark = lowest >> np.uint64(64 - MARKS)
                    fits = (held.value[0][mark >> np.uint64(3)] >> (mark & np.uint64(7)).astype(np.uint8)) & 1 > 0
                else:
                    fits = np.isin(lowest.view(np.int64), np.unique(part.column("anchors").flatten().to_numpy()))
                fits &= W.within(texts.offsets, least, n)[: len(lowest)]
                # the ranks of later rounds are looked up further on
                edges = np.zeros(n + 1, np.int64)
                at = np.flatnonzero(fits)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + least - 2 * start + 1, -1)
                at = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
                ranks = (W.grams(texts.words, start) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                owner = W.owners(texts.offsets)[at]
                yield pa.RecordBatch.from_arrays([pa.array(ranks[at]), pa.array(ranks[at + start]), part.column("doc_id").take(pa.array(owner)), pa.array((at - texts.offsets[owner]).astype(np.int32))], names=["r1", "r2", "doc_id", "place"])

    docs = docs.withColumn("a", F.xxhash64("text"))
    if not few:
        docs = docs.join(several, "doc_id", "left").where("own IS NULL OR own = a").drop("own")
        docs = docs.join(found.join(copies, "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_set("h").alias("anchors")), "doc_id")
    return docs.mapInArrow(run, f"r1 int, r2 int, doc_id {id_type}, place int"), copies


def _doubled(rows: DataFrame, id_type: str, least: int, start: int) -> DataFrame:
    ranked, h = _ranked(rows, id_type), 2 * start
    while h < least:
        step = min(h, least - h)
        ranked, h = _ranked(_ahead(ranked, id_type, step), id_type), h + step
    return ranked


def _prepared(docs: DataFrame, least: int, start: int) -> tuple[DataFrame, str]:
    if not 1 <= start <= least // 2:
        raise ValueError("1 <= start <= least / 2 must hold")
    shared.small_batches(docs.sparkSession)
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), docs.schema["doc_id"].dataType.simpleString()


def passages(docs: DataFrame, least: int = LEAST, start: int = START, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, span_start, span_end (places of words), n_words and later_words (those of them in passages that occur
    before, by doc_id and place), a row for each span of repeated passages that overlap or touch. start: words of the first
    ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, place, first in whole(batches, 1):
            new = _starts(doc)
            new[1:] |= place[1:] - place[:-1] > least
            starts = np.flatnonzero(new)
            last = np.append(starts[1:], len(doc)) - 1
            a, b = place[starts], place[last] + least
            later = np.flatnonzero(~first)
            reach = np.full(len(later), least, np.int64)
            if len(later):
                same = doc[later][1:] == doc[later][:-1]
                reach[:-1] = np.where(same, np.minimum(place[later][1:] - place[later][:-1], least), least)
            words = np.bincount((np.cumsum(new) - 1)[later], reach, minlength=len(starts))
            yield pa.RecordBatch.from_arrays([pa.array(doc[starts]), *(pa.array(x.astype(np.int32)) for x in (a, b, b - a, words))], names=["doc_id", "span_start", "span_end", "n_words", "later_words"])

    docs, id_type = _prepared(docs, least, start)
    places, copies = _places(docs, least, start, anchor)
    ranked = _doubled(places, id_type, least, start).select("doc_id", "place", "first")
    spans = shared.cut(ranked.repartition("doc_id").sortWithinPartitions("doc_id", "place").mapInArrow(run, f"doc_id {id_type}, span_start int, span_end int, n_words int, later_words int"))
    # copies repeat all that the second of their text does, and none of it first
    again = copies.join(spans.select(F.col("doc_id").alias("whole"), "span_start", "span_end", "n_words"), "whole")
    return spans.unionByName(again.select("doc_id", "span_start", "span_end", "n_words", F.col("n_words").alias("later_words")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH w AS (SELECT doc_id, {W.SQL_WORDS} AS words FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, i - 1 AS place, md5(array_to_string(words[i : i + {LEAST - 1}], ' ')) AS gram FROM w, unnest(range(1, len(words) - {LEAST - 2})) AS t(i)),
r AS (SELECT doc_id, place, row_number() OVER (PARTITION BY gram ORDER BY doc_id, place) = 1 AS first FROM g QUALIFY count(*) OVER (PARTITION BY gram) > 1),
s AS (SELECT *, coalesce(place - lag(place) OVER (PARTITION BY doc_id ORDER BY place) > {LEAST}, true) AS new,
        CASE WHEN NOT first THEN coalesce(least({LEAST}, lead(place) OVER (PARTITION BY doc_id, first ORDER BY place) - place), {LEAST}) ELSE 0 END AS later
      FROM r),
t AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS span FROM s)
SELECT doc_id, min(place)::INTEGER AS span_start, (max(place) + {LEAST})::INTEGER AS span_end, (max(place) - min(place) + {LEAST})::INTEGER AS n_words, sum(later)::INTEGER AS later_words
FROM t GROUP BY doc_id, span
"""
