"""Content-addressed store of token ids.

A rolling hash over ``WINDOW`` ids cuts each id stream where its low bits are zero, so that equal passages give equal
chunks wherever they stand; chunks have ``LEAST`` to ``MOST`` ids (the last of a document may have fewer). A chunk is
named by the SHA-256 of its ids. The store has three tables in one folder: ``chunks`` (digest, n_ids, data; each once),
``recipes`` (recipe, a number of its own, doc_id, n_ids, digests in order, where each begins, Merkle root, a polynomial of
the whole stream of ids) and ``manifest`` (level, node, n_docs and root: a Merkle tree over all recipes. Its leaves, at level
0, are buckets of about ``IN_BUCKET`` recipes, by their roots and ids in order; each further node has up to ``FANOUT`` below it,
until one is left). ``verify`` recomputes every chunk's digest from its data, looks up every digest of every recipe, and
recomputes the roots, those of the manifest if it is given, and the polynomials; ``rebuild`` gives the ids back.

Null ids of tokens give a recipe without chunks and with a null n_ids; an empty stream one with n_ids 0. The root of no
chunks is the SHA-256 of nothing. Every input row gives one recipe, repeated rows and null doc_ids included. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm import bpe, shared
from quireflow.llm import words as W

WINDOW, BITS, LEAST, MOST, IN_BUCKET, FANOUT = 16, 7, 32, 1024, 4096, 256


def edges(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the chunks of all streams, and how many chunks each stream has."""
    rolled = W.grams(W.mix(ids.astype(np.uint64) + np.uint64(1)), WINDOW)
    marks = np.flatnonzero((rolled & np.uint64((1 << BITS) - 1)) == 0) + WINDOW  # a cut comes after the window
    lo, hi = np.searchsorted(marks, offsets[:-1], "right"), np.searchsorted(marks, offsets[1:], "left")
    ends: list[int] = []
    counts = np.zeros(len(offsets) - 1, np.int64)
    for k in np.flatnonzero(np.diff(offsets)):
        at, end, before = int(offsets[k]), int(offsets[k + 1]), len(ends)
        for mark in marks[lo[k] : hi[k]].tolist():
            if mark - at < LEAST:
                continue
            while mark - at > MOST:
                at += MOST
                ends.append(at)
            if mark - at >= LEAST:
                at = mark
                ends.append(at)
        while end - at > MOST:
            at += MOST
            ends.append(at)
        if end > at:
            ends.append(end)
        counts[k] = len(ends) - before
    return np.array(ends, np.int64), counts


def merkle(digests: list[bytes]) -> bytes:
    """The root: pairs are hashed, a last one without a partner moves up as it is."""
    level = list(digests)
    if not level:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\0" + d).digest() for d in level]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _powers(most: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(most, W.BASE, np.uint64), dtype=np.uint64)])


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])[ends]
    return upto[1:] - upto[:-1]


def streams(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial of each stream of ids: that of a stream is the sum of its pieces', each times the power of where it begins."""
    at = np.arange(len(ids)) - np.repeat(offsets[:-1], np.diff(offsets))
    return _sums(W.mix(ids.astype(np.uint64) + np.uint64(1)) * _powers(int(at.max(initial=0)))[at], offsets)


def _pieces(encoded: DataFrame, width: int) -> DataFrame:
    """Two rows for each document: its recipe, and the data of its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                lists = part.column("token_ids")
                offsets = lists.offsets.to_numpy().astype(np.int64)
                ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                offsets = offsets - offsets[0]
                ends, counts = edges(ids, offsets)
                numbers = np.arange(part.num_rows) + (TaskContext.get().partitionId() << 40) + row
                row += part.num_rows
                data = ids.astype(f"<u{width}").tobytes()
                begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                first = begins.tolist()
                chunks = [data[width * s : width * e] for s, e in zip(first, ends.tolist())]
                digests = [hashlib.sha256(c).digest() for c in chunks]
                upto = np.concatenate([[0], np.cumsum(counts)]).tolist()
                roots = [merkle(digests[s:e]) for s, e in zip(upto, upto[1:])]
                none = lists.is_null().to_numpy(zero_copy_only=False)
                listed = lambda v: pa.ListArray.from_arrays(pa.array(upto, pa.int32()), v)
                starts = pa.array((begins - np.repeat(offsets[:-1], counts)).astype(np.int32))
                own = [pa.array(numbers), part.column("doc_id"), pa.array(np.diff(offsets), pa.int64(), mask=none), listed(pa.array(digests, pa.binary())), listed(starts), pa.array(roots, pa.binary()), pa.array(streams(ids, offsets).view(np.int64))]
                held = listed(pa.array(chunks, pa.binary()))
                for kind, columns, data in (("recipes", own, pa.nulls(len(numbers), held.type)), ("data", [pa.nulls(len(numbers), c.type) for c in own], held)):
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(numbers)), *columns, data], names=["kind", "recipe", "doc_id", "n_ids", "digests", "starts", "root", "stream", "data"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, f"kind string, {_recipe(encoded)}, data array<binary>")


def _recipe(encoded: DataFrame) -> str:
    return f"recipe bigint, doc_id {encoded.schema['doc_id'].dataType.simpleString()}, n_ids bigint, digests array<binary>, starts array<int>, root binary, stream bigint"


def write(encoded: DataFrame, path: str, width: int = 4) -> None:
    """doc_id and token_ids (array of int) as a store in the folder ``path``, with ``width`` bytes for an id.

    Recipes and the data of their chunks are written in one go, so that ids are made and cut once; chunks come from the
    latter, which then goes.
    """
    spark = encoded.sparkSession
    dense = {"compression": "zstd", "parquet.enable.dictionary": "false"}  # digests and chunks don't recur in a column
    spark.createDataFrame([], f"{_recipe(encoded)}, data array<binary>").write.mode("overwrite").parquet(f"{path}/recipes")
    spark.createDataFrame([], "data array<binary>").write.parquet(f"{path}/pieces/kind=data")
    _pieces(encoded, width).write.mode("append").options(**dense).partitionBy("kind").parquet(f"{path}/pieces")
    shared.move(spark, f"{path}/pieces/kind=recipes", f"{path}/recipes")
    # each chunk once; its name follows from its data
    chunks = spark.read.parquet(f"{path}/pieces/kind=data").select(F.explode("data").alias("data")).distinct()
    chunks.select(F.unhex(F.sha2("data", 256)).alias("digest"), (F.octet_length("data") / width).cast("int").alias("n_ids"), "data").write.options(**dense).parquet(f"{path}/chunks")
    shared.remove(spark, f"{path}/pieces")
    manifest(_recipes(spark, path)).write.parquet(f"{path}/manifest")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/recipes").drop("data")


def _buckets(recipes: int) -> int:
    """How many for so many recipes: a power of two."""
    return 1 << max(0, (recipes // IN_BUCKET).bit_length())


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("bigint")


def _leaves(recipes: DataFrame, buckets: int) -> DataFrame:
    """node, n_docs and root of each bucket."""
    leaf = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit("/").cast("binary"), F.col("root")), 256)
    return recipes.select(_bucket(buckets).alias("node"), leaf.alias("leaf")).groupBy("node").agg(F.count("*").alias("n_docs"), F.sha2(F.array_join(F.array_sort(F.collect_list("leaf")), "").cast("binary"), 256).alias("root"))


def _tree(leaves: DataFrame, buckets: int) -> DataFrame:
    """level, node, n_docs and root of the leaves and of all nodes above them."""
    level, nodes = 0, buckets
    at = leaves.select(F.lit(0).alias("level"), "node", "n_docs", "root")
    out = at
    while nodes > 1:
        level, nodes = level + 1, -(-nodes // FANOUT)
        below = F.transform(F.array_sort(F.collect_list(F.struct("node", "root"))), lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["root"]))
        at = at.select("node", F.floor(F.col("node") / FANOUT).alias("above"), "n_docs", "root").groupBy("above").agg(F.sum("n_docs").alias("n_docs"), F.sha2(F.array_join(below, ",").cast("binary"), 256).alias("root"))
        at = at.select(F.lit(level).alias("level"), F.col("above").alias("node"), "n_docs", "root")
        out = out.unionByName(at)
    return out


def manifest(recipes: DataFrame) -> DataFrame:
    """level, node, n_docs, root and buckets (how many leaves there may be), a row for each node of the tree over the recipes."""
    buckets = _buckets(recipes.count())
    return _tree(shared.cut(_leaves(recipes, buckets)), buckets).withColumn("buckets", F.lit(buckets).cast("bigint"))


def root(manifest: DataFrame) -> str | None:
    """The root of the whole store; none if it is empty."""
    top = manifest.orderBy(F.desc("level")).select("root").first()
    return top and top[0]


def verify(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """doc_id, n_ids, n_chunks, root (in hexadecimal) and verified for each recipe of a store.

    Verified: every chunk is there, its data has the digest that names it, the chunks have n_ids ids together, follow each
    other and give the polynomial of the whole stream of ids, the root is that of the digests, and, with a manifest, so is
    the root of the recipe's bucket, and those of the nodes above it. A bucket of the manifest without recipes is a row without an id that isn't verified.
    """
    recipes, chunks = _recipes(spark, path), spark.read.parquet(f"{path}/chunks")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("data")
            n = np.maximum(batch.column("n_ids").fill_null(0).to_numpy(zero_copy_only=False), 1).astype(np.int64)
            for width in (2, 4):
                at = np.flatnonzero(pc.binary_length(data).to_numpy(zero_copy_only=False) == width * n)
                if not len(at):
                    continue
                own = data.take(pa.array(at)) if len(at) < len(n) else data
                edges_ = np.frombuffer(own.buffers()[1], np.int32, len(own) + 1, own.offset * 4)
                ids = np.frombuffer(own.buffers()[2], f"<u{width}", (int(edges_[-1]) - int(edges_[0])) // width, int(edges_[0]))
                made = streams(ids, np.concatenate([[0], np.cumsum(n[at])]))
                yield pa.RecordBatch.from_arrays([batch.column("digest").take(pa.array(at)), pa.array(n[at]), pa.array(made.view(np.int64))], names=["d", "n", "h"])

    sound = chunks.where(F.unhex(F.sha2("data", 256)) == F.col("digest")).select("digest", "n_ids", "data").mapInArrow(hashed, "d binary, n bigint, h bigint")

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each chunk's part of the stream's polynomial, in halves, so that sums don't overflow
        powers = _powers(MOST)
        for batch in batches:
            start = batch.column("start").to_numpy().astype(np.int64)
            if len(start) and start.max() >= len(powers):
                powers = _powers(2 * int(start.max()))
            part = batch.column("h").to_numpy().view(np.uint64) * powers[start]
            yield pa.RecordBatch.from_arrays([batch.column("recipe"), batch.column("n"), pa.array((part >> np.uint64(32)).view(np.int64)), pa.array((part & np.uint64(0xFFFFFFFF)).view(np.int64))], names=["recipe", "n", "high", "low"])

    named = recipes.select("recipe", F.explode(F.arrays_zip("digests", "starts")).alias("c")).select("recipe", F.col("c.starts").alias("start"), F.col("c.digests").alias("d"))
    found = named.join(sound, "d").select("recipe", "start", "n", "h").mapInArrow(moved, "recipe bigint, n bigint, high bigint, low bigint")
    found = found.groupBy("recipe").agg(F.count("*").alias("found"), F.sum("n").alias("ids"), F.sum("high").alias("high"), F.sum("low").alias("low"))

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [merkle(d) == r for d, r in zip(batch.column("digests").to_pylist(), batch.column("root").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("recipe", "doc_id", "n_ids", "root", "stream")), pa.array([len(d) for d in batch.column("digests").to_pylist()], pa.int32()), pa.array(good, pa.bool_())], names=["recipe", "doc_id", "n_ids", "root", "stream", "n_chunks", "rooted"])

    kind = recipes.schema["doc_id"].dataType.simpleString()
    own = recipes.select("recipe", "doc_id", "n_ids", "root", "stream", "digests").mapInArrow(rooted, f"recipe bigint, doc_id {kind}, n_ids bigint, root binary, stream bigint, n_chunks int, rooted boolean")
    both = own.join(found, "recipe", "left")
    of = lambda c: F.coalesce(F.col(c), F.lit(0))
    high = (of("high") + F.shiftright(of("low"), 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    same = (F.shiftrightunsigned("stream", 32) == high) & (F.col("stream").bitwiseAND(F.lit(0xFFFFFFFF)) == of("low").bitwiseAND(F.lit(0xFFFFFFFF)))
    rows = both.select("doc_id", "n_ids", "n_chunks", F.hex("root").alias("root"), (F.col("rooted") & (of("found") == F.col("n_chunks")) & (of("ids") == of("n_ids")) & same).alias("verified"))
    if manifest is None:
        return rows
    given = manifest.select("buckets").first()
    if given is None:
        return rows.withColumn("verified", F.lit(False))
    buckets = given[0]
    now = _tree(shared.cut(_leaves(recipes, buckets)), buckets).select("level", "node", F.col("n_docs").alias("docs_now"), F.col("root").alias("root_now"))
    both = shared.cut(manifest.drop("buckets").join(now, ["level", "node"], "full").select("level", "node", "root_now", F.coalesce((F.col("root") == F.col("root_now")) & (F.col("n_docs") == F.col("docs_now")), F.lit(False)).alias("same")))
    # a bucket's own root tells which recipes are whole; the nodes above must follow from the leaves that the manifest has
    leaves = manifest.where("level = 0").select("node", "n_docs", "root")
    told = _tree(leaves, buckets).join(manifest.select("level", "node", F.col("root").alias("given")), ["level", "node"], "left")
    sound_tree = told.where("given IS NULL OR given <> root").isEmpty()
    kept = both.where("level = 0 AND root_now IS NOT NULL").select("node", (F.col("same") & F.lit(sound_tree)).alias("same"))
    checked = rows.withColumn("node", _bucket(buckets)).join(kept, "node", "left").select("doc_id", "n_ids", "n_chunks", "root", (F.col("verified") & F.coalesce("same", F.lit(False))).alias("verified"))
    lost = both.where("level = 0 AND root_now IS NULL").selectExpr(f"CAST(NULL AS {kind}) AS doc_id", "CAST(NULL AS bigint) AS n_ids", "CAST(NULL AS int) AS n_chunks", "CAST(NULL AS string) AS root", "false AS verified")
    return checked.unionByName(lost)


def rebuild(spark: SparkSession, path: str, width: int = 4) -> DataFrame:
    """doc_id and token_ids from a store; a row for each recipe."""
    recipes, chunks = _recipes(spark, path), spark.read.parquet(f"{path}/chunks")
    parts = recipes.select("recipe", "doc_id", "n_ids", F.posexplode_outer("digests").alias("at", "digest")).join(chunks.select("digest", "data"), "digest", "left")
    whole = parts.groupBy("recipe", "doc_id", "n_ids").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "data"))), lambda x: x["data"]).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [None if n is None else np.frombuffer(b"".join(x for x in d if x), f"<u{width}").astype(np.int32) for n, d in zip(batch.column("n_ids").to_pylist(), batch.column("data").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "token_ids"])

    kind = recipes.schema["doc_id"].dataType.simpleString()
    return whole.select("doc_id", "n_ids", "data").mapInArrow(run, f"doc_id {kind}, token_ids array<int>")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.fresh(spark, "store")
    write(bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), check=False), path, width=2)  # the vocabulary has fewer than 65,536 ids
    return verify(spark, path, spark.read.parquet(f"{path}/manifest"))
