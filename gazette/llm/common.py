"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that one block of work holds, unless a single text is longer.
BLOCK_BYTES = 4 << 20
LONG_WORD = 48
_FNV_OFFSET, _FNV_PRIME = np.uint64(14695981039346656037), np.uint64(1099511628211)
_MIX = tuple(map(np.uint64, (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def text_blocks(batches, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[list, object]]:
    """(texts as UTF-8 bytes with null as empty, the Arrow rows) in runs of at most limit bytes, at least one row each."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text)).cast("binary")
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield [v or b"" for v in col.slice(at, to - at).to_pylist()], batch.slice(at, to - at)
            at = to


_HELD: dict = {}


def held(key, make: Callable):
    """make(), kept in this Python worker until another key is asked for: workers outlive a stage, and models of several together would fill them."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(33))
    h *= _MIX[0]
    h ^= h >> np.uint64(33)
    h *= _MIX[1]
    return h ^ (h >> np.uint64(33))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, and words per text."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gaps = _IS_SPACE[joined]
    inner = ~gaps
    edge = np.flatnonzero(inner[1:] != inner[:-1]) + 1
    if len(inner) and inner[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    low = _LOWER[joined]
    out = hash_spans(low, starts, ends)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, text_ends)
    return out, np.diff(upto, prepend=0)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """FNV-1a with a finaliser over data[start:end], a column of bytes at a time; long spans by BLAKE2."""
    length = ends - starts
    order = np.argsort(-np.minimum(length, LONG_WORD + 1), kind="stable")
    st, le = starts[order], length[order]
    n_long = int(np.searchsorted(-le, -LONG_WORD, "left"))
    h = np.full(len(st), _FNV_OFFSET, np.uint64)
    neg = -le
    for k in range(int(le[n_long]) if n_long < len(le) else 0):
        m = int(np.searchsorted(neg, -k, "left"))
        part = h[n_long:m]
        part ^= data[st[n_long:m] + k]
        part *= _FNV_PRIME
    h = mix(h)
    for i in range(n_long):
        h[i] = int.from_bytes(hashlib.blake2b(data[st[i] : st[i] + le[i]].tobytes(), digest_size=8).digest(), "little")
    out = np.empty_like(h)
    out[order] = h
    return out
