"""Byte-pair encoding with forced boundaries, and decoding.

A pair of neighbouring bytes that occurs inside no token of the vocabulary is never merged over, so a token always
ends between the two. Texts are cut at such pairs in numpy, the distinct fragments of a batch are encoded once each,
and the ids are put together again. A cut is left out where the pattern that splits text before merging would read
the fragment otherwise than in its place: after white space (the pattern looks ahead of a run of it), after a
character that might be one, inside a character, and before an apostrophe that doesn't follow a letter or digit.
So the ids are those of the whole text, with the strings of special tokens read as ordinary text.

A null text gives nulls, an empty one an empty list. Every input row gives one row, repeated rows and null ids
included; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame

from quireflow.llm import shared
from quireflow.llm import words as W

RANKS = os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fragments whose ids a worker remembers between batches; it forgets all when there are more.
REMEMBERED = 50_000


class Encoder:
    def __init__(self, path: str = RANKS) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        inside = np.zeros((256, 256), bool)
        for token in self.ranks:
            b = np.frombuffer(token, np.uint8)
            inside[b[:-1], b[1:]] = True
        a, b = np.arange(256)[:, None], np.arange(256)[None, :]
        space = (a == 32) | ((a >= 9) & (a <= 13))
        alnum = ((a >= 48) & (a <= 57)) | ((a >= 65) & (a <= 90)) | ((a >= 97) & (a <= 122))
        #: Pairs that mark a cut, for a left byte below 128, and for one that ends a character of two bytes.
        self.forced = ~inside & ~space & ((b & 0xC0) != 0x80) & ((b != 39) | alnum)
        self.known: dict[bytes, list[int]] = {}
        self.size = max(self.ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places in the bytes of texts before which a token certainly starts."""
        a, b = data[:-1], data[1:]
        cut = self.forced[a, b]
        wide = np.flatnonzero(cut & (a >= 128))
        lead = data[np.maximum(wide - 1, 0)]
        cut[wide] &= (wide > 0) & (lead >= 0xC3) & (lead <= 0xDF)
        return np.flatnonzero(cut) + 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) one after the other, and how many each has."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        if offsets[-1] == offsets[0]:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0])
        offsets = offsets - offsets[0]
        starts = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            starts[self.cuts(data)] = True
        starts[offsets] = True
        starts = np.flatnonzero(starts).astype(np.int32)  # the last is the end
        fragments = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        which, known, pieces = fragments.indices.to_numpy(), self.known, []
        for piece in fragments.dictionary.to_pylist():
            ids = known.get(piece)
            if ids is None:
                ids = self.encoding.encode_ordinary(piece.decode("utf-8", "replace"))
                known[piece] = ids
            pieces.append(ids)
        if len(known) > REMEMBERED:
            known.clear()
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = take(np.fromiter((i for p in pieces for i in p), np.int32, int(length.sum())), np.cumsum(length) - length, length, which)
        upto = np.concatenate([[0], np.cumsum(length[which])])
        return ids, np.diff(upto[np.searchsorted(starts, offsets)])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        return take(self.token_bytes, self.token_starts[:-1], np.diff(self.token_starts), ids)


def take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of values that ``which`` names, one after the other."""
    length = lengths[which]
    total = int(length.sum())
    if not total:
        return values[:0]
    return values[np.repeat(starts[which] - (np.cumsum(length) - length), length) + np.arange(total)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, ranks: str = RANKS, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, token_ids and exact (whether decoding gives the text back), a row for each document."""
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks)
        for batch in batches:
            for part in W.slices(batch, "text"):
                texts = W.flat(part.column("text"))
                ids, count = bpe.encode(texts)
                lost = part.column("text").is_null().to_numpy(zero_copy_only=False)
                exact = np.ones(len(texts), bool)
                if check:
                    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
                    data = np.frombuffer(texts.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0]) if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
                    got = bpe.decode(ids)
                    size = np.concatenate([[0], np.cumsum(np.diff(bpe.token_starts)[ids])])
                    ends = np.concatenate([[0], np.cumsum(count)])
                    exact = np.diff(size[ends]) == np.diff(offsets)
                    if exact.all() and len(data):
                        wrong = np.concatenate([[0], np.cumsum(got != data)])
                        exact = np.diff(wrong[offsets - offsets[0]]) == 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(lost))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count.astype(np.int32), mask=lost), lists, pa.array(exact, mask=lost)], names=["doc_id", "n_tokens", "token_ids", "exact"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens int, token_ids array<int>, exact boolean")


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id and text from doc_id and token_ids; null ids give a null text, bytes that aren't UTF-8 a replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks)
        for batch in batches:
            lists = batch.column("token_ids")
            texts = [None if ids is None else bpe.decode(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace") for ids in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "token_ids").mapInArrow(run, f"doc_id {kind}, text string")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
