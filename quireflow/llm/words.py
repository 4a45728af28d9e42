"""Words of Arrow text columns as numpy arrays.

A word is a maximal run of characters other than ASCII white space; a character of a script that is written without
spaces (``UNSPACED``) is a word of its own, wherever it stands. A null text has no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A multiplier for rolling hashes: odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_BASE = np.uint64(BASE)
_INVERSE = np.uint64(pow(BASE, -1, 1 << 64))
#: Text bytes that are held as words at a time; a longer text is still handled whole.
SLICE_BYTES = 2 << 20
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
#: The words of the column text as a list, in DuckDB.
SQL_WORDS = rf"regexp_extract_all(regexp_replace(coalesce(text, ''), '({UNSPACED})', ' \1 ', 'g'), '[^ \t\n\x0B\f\r]+')"


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of strings without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pc.fill_null(column.cast(pa.string()), "")


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy() -> None:
    """Gives freed memory back to the system: a worker lives on from stage to stage, beside others."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``most`` bytes together."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    tidy()


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets (one more than there are texts) into the words of all texts, and the words."""
    if pc.any(pc.match_substring_regex(texts, UNSPACED)).as_py():
        texts = pc.replace_substring_regex(texts, f"({UNSPACED})", r" \1 ")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    words, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        offsets, words = before[offsets], words.filter(pa.array(full))
    return offsets, words


def plain(words: pa.Array) -> pa.Array:
    """The words in lower case, without anything but letters and digits."""
    words = pc.utf8_lower(words)
    marked = pc.invert(pc.utf8_is_alnum(words))
    return pc.replace_with_mask(words, marked, pc.replace_substring_regex(words.filter(marked), "[^\\p{L}\\p{N}]+", ""))


_BYTES = np.random.default_rng(0xB17E5).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def hash64(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string (no nulls), the same everywhere; that of the empty string is 0."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1, strings.offset * 4).astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(len(strings), np.uint64)
    data = np.frombuffer(strings.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0])
    offsets = offsets - offsets[0]
    up, down = np.full(len(data), _BASE), np.full(len(data) + 1, _INVERSE)
    up[0] = down[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * np.cumprod(up), dtype=np.uint64)])
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) * np.cumprod(down)[offsets[:-1]])


def hashes(words: pa.Array, plainly: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, the same in every batch. plainly: of its plain form."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    return hash64(plain(coded.dictionary) if plainly else coded.dictionary)[coded.indices.to_numpy()]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit hashes, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words that start at each place; places too near the end are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 8:
        out = words[:n].copy()
        for j in range(1, k):
            out *= _BASE
            out += words[j : j + n]
        return mix(out)
    up, down = np.full(len(words), _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(up), dtype=np.uint64)])
    return mix((sums[k:] - sums[:n]) * np.cumprod(down))


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def within(offsets: np.ndarray, k: int, total: int) -> np.ndarray:
    """Whether the k words from each place of ``grams`` belong to one text."""
    n = max(0, total - k + 1)
    owner = owners(offsets)
    return owner[:n] == owner[k - 1 : k - 1 + n]


def ragged(values: np.ndarray, counts: np.ndarray, type_: pa.DataType) -> pa.ListArray:
    """Lists of the given lengths over the values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, type_))


def ordered(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The order by owner, then by value."""
    by = np.argsort(values)
    small = len(owner) and int(owner.max()) < 1 << 16  # numpy sorts those by radix
    return by[np.argsort(owner[by].astype(np.uint16) if small else owner[by], kind="stable")]
