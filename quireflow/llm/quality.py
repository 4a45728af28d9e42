"""Quality classifier by positive-unlabelled learning.

Documents that are labelled good (and not toxic) are trusted positives; documents without a label are an unlabelled
mixture. A linear scorer is fitted by minimising the non-negative unbiased risk of Kiryo et al. (2017) with the
sigmoid loss: pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)). The class prior pi is estimated from a
first scorer that tells positives from unlabelled rows, by the best bin of Garg et al. (2021): the least, over
thresholds, of the share of held-out unlabelled rows above one to that of held-out positives, each with its error bound.
A document stays if its score is at least the one that ``KEEP`` of the held-out positives reach.

Features are shares of kinds of characters and of repeated words, which words occur (in ``BINS`` hash bins), the log odds of
the word that most speaks against a text, and by how much that goes beyond ``TELLING``. Log odds compare how many positives
have a word with how many documents of the whole table have it; the prior is estimated from the scores of all documents. Only
the gradient steps read a sample: at most ``SAMPLE`` positives and as many unlabelled documents, those whose id hashes
lowest. Every document is scored, over its whole text.

A null text is read as an empty one. Every input row gives one row, repeated rows and null ids included. Where there
are no positives or no unlabelled documents nothing can be learnt: the score is 0 and every document stays. An id
whose rows in labels disagree counts as labelled but not as good. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm import shared
from quireflow.llm import words as W

SAMPLE, BINS, KEEP, EPOCHS, SEED, SMOOTH = 20_000, 1 << 16, 0.99, 24, 7, 3.0
TELLING, STEP = -2.0, 1e-3  #: STEP: width of the bins that scores of all documents are counted in
_PARTS = 16  #: in which counts of bins are sent
_CLASSES = np.zeros(256, np.uint8)  # 0 letters and bytes above 127, 1 capitals, 2 digits, 3 white space, 4 common marks, 5 other marks
for _bytes, _k in ((range(65, 91), 1), (range(48, 58), 2), ((9, 10, 11, 12, 13, 32), 3), (b".,;:'\"-?()", 4)):
    _CLASSES[list(_bytes)] = _k
for _b in range(128):
    if not (chr(_b).isalnum() or _CLASSES[_b]):
        _CLASSES[_b] = 5
DENSE = 11


class Features(NamedTuple):
    dense: np.ndarray  #: a row of DENSE for each text
    counts: np.ndarray  #: bins of each text
    bins: np.ndarray


def features(texts: pa.Array) -> Features:
    """Of texts without nulls."""
    n = len(texts)
    dense = np.zeros((n, DENSE), np.float32)
    raw = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    size = np.diff(raw)
    if size.sum():
        kinds = _CLASSES[np.frombuffer(texts.buffers()[2], np.uint8, raw[-1] - raw[0], raw[0])]
        raw = raw - raw[0]
        for k in range(1, 6):
            upto = np.concatenate([[0], np.cumsum(kinds == k)])
            dense[:, k - 1] = np.diff(upto[raw]) / np.maximum(size, 1)
    offsets, words = W.split(texts)
    count, owner = np.diff(offsets), W.owners(offsets)
    hashed = W.hashes(words, plainly=True)
    twins = np.zeros(len(hashed), bool)
    twins[1:] = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
    order = W.ordered(owner, hashed)
    new = np.ones(len(order), bool)
    new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=n)
    # of two words in a row, how many have been read before
    pairs = W.mix(hashed[:-1] * np.uint64(W.BASE) + hashed[1:]) if len(hashed) > 1 else np.zeros(0, np.uint64)
    pairs, of = pairs[owner[:-1] == owner[1:]], owner[:-1][owner[:-1] == owner[1:]] if len(hashed) > 1 else np.zeros(0, np.int64)
    by = W.ordered(of, pairs)
    again = np.zeros(len(by), bool)
    again[1:] = (pairs[by][1:] == pairs[by][:-1]) & (of[by][1:] == of[by][:-1])
    some = np.maximum(count, 1)
    dense[:, 5] = np.log1p(count) / 10
    dense[:, 6] = (size / some).clip(0, 50) / 10
    dense[:, 7] = np.bincount(owner[twins], minlength=n) / some
    dense[:, 8] = np.bincount(of[by][again], minlength=n) / some
    dense[:, 9] = distinct / some
    dense[:, 10] = np.bincount(owner[hashed == 0], minlength=n) / some  # words without letters and digits
    bins, of = (hashed[order][new] % np.uint64(BINS)).astype(np.uint16), owner[order][new]
    return Features(dense, np.bincount(of, minlength=n), bins)


def document_counts(f: Features) -> np.ndarray:
    """How many texts have each bin; two words of a text in one bin count twice."""
    return np.bincount(f.bins, minlength=BINS)


def odds(positives: np.ndarray, n: int, everything: np.ndarray, total: int) -> np.ndarray:
    """For each bin the smoothed log odds of a positive document having it to any document, from document counts."""
    return np.log((positives + SMOOTH) / (everything * (n / max(1, total)) + SMOOTH))


def widened(f: Features, log_odds: np.ndarray) -> np.ndarray:
    """The dense features, the least log odds of any word of each text, and what of it is beyond TELLING, so that a few
    telling words in a long text count."""
    least = np.zeros(len(f.counts))
    for a, b, lo, hi in _spans(f.counts):
        full = f.counts[a:b] > 0
        if full.any():
            least[a:b][full] = np.minimum.reduceat(log_odds[f.bins[lo:hi]], (np.cumsum(f.counts[a:b]) - f.counts[a:b])[full])
    least = np.minimum(least, 0.0)
    return np.column_stack([f.dense, least, np.clip(least - TELLING, -2.0, 0.0)])


def _spans(counts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Rows and bins in runs of about a million bins."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    edges = np.unique(np.append(np.searchsorted(ends[1:], np.arange(0, ends[-1], 1 << 20)), [0, len(counts)]))
    return ((int(a), int(b), int(ends[a]), int(ends[b])) for a, b in zip(edges[:-1], edges[1:]))


WIDE = DENSE + 2


class Model(NamedTuple):
    log_odds: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    dense: np.ndarray
    bins: np.ndarray
    bias: float
    threshold: float
    prior: float

    def score(self, f: Features) -> np.ndarray:
        out = ((widened(f, self.log_odds) - self.shift) / self.scale).clip(-8, 8) @ self.dense + self.bias
        for a, b, lo, hi in _spans(f.counts):
            upto = np.concatenate([[0.0], np.cumsum(self.bins[f.bins[lo:hi]], dtype=np.float64)])
            out[a:b] += np.diff(upto[np.concatenate([[0], np.cumsum(f.counts[a:b])])]) / np.sqrt(np.maximum(f.counts[a:b], 1))
        return np.round(out, 6)


NOTHING = Model(np.zeros(BINS), np.zeros(WIDE), np.ones(WIDE), np.zeros(WIDE), np.zeros(BINS), 0.0, 0.0, 1.0)


def _rows(f: Features, rows: np.ndarray) -> Features:
    starts = np.cumsum(f.counts) - f.counts
    count = f.counts[rows]
    return Features(f.dense[rows], count, f.bins[np.repeat(starts[rows] - (np.cumsum(count) - count), count) + np.arange(count.sum())])


def risk(scores: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative unbiased risk with the sigmoid loss, and the gradient by the scores that a step follows: where
    the risk of the negatives is below 0, the one that brings it back up."""
    s = 1 / (1 + np.exp(-scores.clip(-30, 30)))  # the loss of calling a row positive that isn't; 1 - s the other way
    slope, p = s * (1 - s), positive
    negative = s[~p].mean() - prior * s[p].mean()
    grad = np.zeros(len(scores))
    if negative >= 0:
        grad[p] = (-prior - prior) * slope[p] / p.sum()
        grad[~p] = slope[~p] / (~p).sum()
    else:
        grad[p] = prior * slope[p] / p.sum()
        grad[~p] = -slope[~p] / (~p).sum()
    return prior * (1 - s[p]).mean() + max(0.0, negative), grad


def _fit(f: Features, positive: np.ndarray, log_odds: np.ndarray, prior: float | None, epochs: int = EPOCHS) -> Model:
    """By non-negative risk with the given prior; without one, positives against the rest by the plain sigmoid risk."""
    rng = np.random.default_rng(SEED)
    f = f._replace(dense=widened(f, log_odds).astype(np.float32))
    shift, scale = f.dense.mean(0), np.maximum(f.dense.std(0), 1e-3)
    w, v, b = np.zeros(WIDE), np.zeros(BINS), 0.0
    moments = [[np.zeros(WIDE), np.zeros(WIDE)], [np.zeros(BINS), np.zeros(BINS)], [0.0, 0.0]]
    step, n = 0, len(positive)
    size = max(32, min(1024, n // 8))
    share = positive.mean()
    for epoch in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, size):
            rows = order[a : a + size]
            part, p = _rows(f, rows), positive[rows]
            if p.all() or not p.any():
                continue
            x = ((part.dense - shift) / scale).clip(-8, 8)
            each = 1 / np.sqrt(np.maximum(part.counts, 1))
            sums = np.diff(np.concatenate([[0.0], np.cumsum(v[part.bins])])[np.concatenate([[0], np.cumsum(part.counts)])])
            z = x @ w + sums * each + b
            if prior is None:
                s = 1 / (1 + np.exp(-z.clip(-30, 30)))
                grad = np.where(p, -s * (1 - s) * 0.5 / p.sum(), s * (1 - s) * 0.5 / (~p).sum())
            else:
                grad = risk(z, p, prior)[1]
            grads = [x.T @ grad + 1e-4 * w, np.bincount(part.bins, np.repeat(grad * each, part.counts), minlength=BINS) + 2e-6 * v, grad.sum()]
            step += 1
            rate = 0.02 * (1 - epoch / epochs)
            for k, g in enumerate(grads):
                m, q = moments[k]
                m, q = 0.9 * m + 0.1 * g, 0.99 * q + 0.01 * g * g
                moments[k] = [m, q]
                change = rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-7)
                if k == 0:
                    w = w - change
                elif k == 1:
                    v = v - change
                else:
                    b = b - float(change)
    return Model(log_odds, shift, scale, w, v, b, 0.0, prior if prior is not None else float(share))


def best_bin(positives: np.ndarray, marks: np.ndarray, counts: np.ndarray) -> float:
    """The class prior by scores of held-out positives, and of all documents, as how many (counts) have each mark."""
    by = np.argsort(marks)
    marks, upto = marks[by], np.concatenate([[0], np.cumsum(counts[by])])
    p, total = np.sort(positives), upto[-1]
    at = np.unique(p)
    above_p, above_u = 1 - np.searchsorted(p, at) / len(p), 1 - upto[np.searchsorted(marks, at)] / total
    bound = np.sqrt(np.log(4 / 0.1) / 2 / total) + np.sqrt(np.log(4 / 0.1) / 2 / len(p))
    least = int(np.argmin((above_u + bound) / above_p))
    return float(np.clip(above_u[least] / above_p[least], 0.05, 0.99))


def _all_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Document counts of all bins, and the number of documents. Each task adds up its own; what it sends is as large for
    any number of documents, and is added up in ``_PARTS`` tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(BINS, np.int64), 0
        for batch in batches:
            for part in W.slices(batch, "text"):
                counts += document_counts(features(W.flat(part.column("text"))))
                rows += part.num_rows
        if rows:
            yield _parts(counts, rows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for part, rows, data in zip(*(batch.column(c).to_pylist() for c in ("part", "rows", "data"))):
                held = sums.setdefault(part, [0, np.zeros(BINS // _PARTS, np.int64)])
                held[0] += rows
                held[1] += np.frombuffer(data, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([r for r, _ in sums.values()], pa.int64()), pa.array([c.tobytes() for _, c in sums.values()], pa.binary())], names=["part", "rows", "data"])

    schema = "part int, rows bigint, data binary"
    found = docs.select("text").mapInArrow(run, schema).repartition(_PARTS, "part").mapInArrow(add, schema).collect()  # _PARTS rows
    counts = np.zeros((_PARTS, BINS // _PARTS), np.int64)
    for r in found:
        counts[r.part] = np.frombuffer(r.data, np.int64)
    return counts.ravel(), max((r.rows for r in found), default=0)


def _parts(counts: np.ndarray, rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([rows] * _PARTS, pa.int64()), pa.array([c.tobytes() for c in np.split(counts, _PARTS)], pa.binary())], names=["part", "rows", "data"])


def _all_scores(docs: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The scores of all documents, in bins: marks and counts."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    reach = 50_000  # marks on either side; scores beyond count as the last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                marks, n = np.unique(np.floor(_scored(part, held.value) / STEP).clip(-reach, reach).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(marks), pa.array(n)], names=["mark", "n"])

    found = docs.select("text").mapInArrow(run, "mark bigint, n bigint").groupBy("mark").agg({"n": "sum"}).toArrow()  # at most 2 * reach + 1 rows
    held.unpersist()
    return found[0].to_numpy() * STEP, found[1].to_numpy()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fitted on the driver, on at most ``sample`` rows of either sort."""
    shared.small_batches(docs.sparkSession)
    ids = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("good"))
    order = (F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id"))
    good = ids.where("good").orderBy(*order).limit(sample).select("doc_id", F.lit(True).alias("good"))
    rest = docs.select("doc_id").where(F.col("doc_id").isNotNull()).join(ids, "doc_id", "left_anti").distinct().orderBy(*order).limit(sample).select("doc_id", F.lit(False).alias("good"))
    chosen = docs.sparkSession.createDataFrame(good.unionByName(rest).toArrow())  # bounded by sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                f = features(W.flat(part.column("text")))
                packed = [f.bins[b - n : b].tobytes() for n, b in zip(f.counts.tolist(), np.cumsum(f.counts).tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("good"), pa.array([d.tobytes() for d in f.dense], pa.binary()), pa.array(packed, pa.binary())], names=["doc_id", "good", "dense", "bins"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(run, f"doc_id {kind}, good boolean, dense binary, bins binary").toArrow()
    order_ = pc.sort_indices(read, [("doc_id", "ascending")]).to_numpy()  # whichever order tasks end in
    positive = read["good"].to_numpy()[order_]
    if not positive.any() or positive.all():
        return NOTHING
    held = np.random.default_rng(SEED).random(len(positive)) < 0.25
    train, test = np.flatnonzero(~held), np.flatnonzero(held)
    if len(np.unique(positive[train])) < 2 or len(np.unique(positive[test])) < 2:
        train = test = np.arange(len(positive))
    fitted, kept_back = (_taken(read, order_[rows]) for rows in (train, test))
    del read
    everything, total = _all_counts(docs)
    log_odds = odds(document_counts(_rows(fitted, np.flatnonzero(positive[train]))), int(positive[train].sum()), everything, total)
    first = _fit(fitted, positive[train], log_odds, None, 8)
    own = first.score(kept_back)[positive[test]]
    prior = best_bin(np.floor(own / STEP) * STEP, *_all_scores(docs, first))
    model = _fit(fitted, positive[train], log_odds, prior)
    scores = np.sort(model.score(kept_back)[positive[test]])
    return model._replace(threshold=float(scores[int(len(scores) * (1 - KEEP))]))


def _taken(read: pa.Table, rows: np.ndarray) -> Features:
    dense, bins = read["dense"].take(pa.array(rows)), read["bins"].take(pa.array(rows))
    return Features(np.frombuffer(b"".join(dense.to_pylist()), np.float32).reshape(-1, DENSE), pc.binary_length(bins).to_numpy().astype(np.int64) // 2, np.frombuffer(b"".join(bins.to_pylist()), np.uint16))


def _scored(batch: pa.RecordBatch, model: Model) -> np.ndarray:
    return model.score(features(W.flat(batch.column("text"))))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score, keep, a row for each document."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                score = _scored(part, held.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(score >= held.value.threshold)], names=["doc_id", "score", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, keep boolean")


def kept(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows and columns of the documents that stay."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                yield part.filter(pa.array(_scored(part, held.value) >= held.value.threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_pu_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
