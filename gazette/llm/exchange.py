"""Blocks of texts, and what they learn of keys that other blocks hold too.

Texts are written in blocks. Each block sends its distinct keys (64-bit hashes, sorted) to slices of
the key space, one row per slice it has keys for; a slice's task unites them and answers every block;
a block's text then meets its answers. A key that a third of all texts hold is one number per block, so
no task grows with it, and nothing is broadcast. Slices are as many as keep a slice's share of the
text at SLICE_BYTES. However many slices there are, there are never more rows than blocks have
distinct keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import hash_spans, mix, text_blocks
from gazette.llm.lm_scoring import _columns as columns
from gazette.llm.lm_scoring import _packed as packed
from gazette.llm.lm_scoring import _parts as parts
from gazette.llm.lm_scoring import _squeezed as squeezed
from gazette.llm.lm_scoring import _unpacked as unpacked
from gazette.llm.lm_scoring import _unsqueezed as unsqueezed
from gazette.sources.tables import Workspace

SLICE_BYTES, BLOCK_BYTES = 8 << 20, 5 << 20
REQUESTS = "slice int, block long, n int, base long, keys binary, first binary, second binary"
ANSWERS = "slice int, block long, n int, base long, flags binary, first binary, second binary"
_A = np.uint64(0x9E3779B97F4A7C15)


def slices(docs: DataFrame, size: int = SLICE_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // size))


def blocks(docs: DataFrame, tag: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """block, and the texts of its rows with the column tag of each."""
    kind = docs.schema[tag].dataType.simpleString()
    arrow = pa.list_(pa.int64() if kind == "bigint" else pa.string())

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        made = TaskContext.get().partitionId() << 32
        for values, rows in text_blocks(batches, limit=limit):
            yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([rows.column(0).to_pylist()], arrow), pa.array([list(map(len, values))], pa.list_(pa.int32())), pa.array([pack.compress(b"".join(values))], pa.binary())], ["block", "tags", "sizes", "texts"])
            made += 1

    return docs.select(tag, "text").mapInArrow(run, f"block long, tags array<{kind}>, sizes array<int>, texts binary")


def texts(row: dict) -> list[bytes]:
    data, at, out = zstandard.ZstdDecompressor().decompress(row["texts"]) if row["texts"] else b"", 0, []
    for n in row["sizes"]:
        out.append(data[at : at + n])
        at += n
    return out


class Codes(dict):
    """word -> its number, in the order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words, by number."""
        length = np.fromiter(map(len, self), np.int64, len(self))
        ends = np.cumsum(length)
        return hash_spans(np.frombuffer(b"".join(self), np.uint8), ends - length, ends)


def run_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that start at each place but the last n - 1."""
    run = mix(word + np.uint64(7))
    for k in range(1, n):
        run = mix(run[:-1] * _A + word[k:] + np.uint64(k)) if len(run) else run
    return run


def requests(row: dict, keys: np.ndarray, n_slices: int, base: int, first: np.ndarray, second: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows by which a block sends sorted distinct keys with two numbers each."""
    out = [(s, row["block"], hi - lo, base, squeezed(keys[lo:hi]), packed(first[lo:hi]), packed(second[lo:hi])) for s, lo, hi in parts(keys, n_slices)]
    yield from columns(out, REQUESTS).to_batches()


def united(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of some requests, and where among them each request's keys are, one request after the other."""
    return np.unique(np.concatenate([unsqueezed(r["keys"], r["n"]) for r in rows]), return_inverse=True)


def numbers(rows: list[dict], column: str) -> np.ndarray:
    return np.concatenate([unpacked(r[column], r["n"]).astype(np.int64) for r in rows])


def answered(requested: DataFrame, answer: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """ANSWERS to every request; answer gets all requests of a slice."""
    return requested.groupBy("slice").applyInArrow(lambda key, table: columns(answer(table.to_pylist()), ANSWERS), ANSWERS)


def met(stored: DataFrame, answers: DataFrame, work: Callable[[dict, list[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What work makes of every block and its answers, which come in the order of the slices."""
    rows = stored.withColumn("slice", F.lit(-1)).unionByName(answers, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "slice")

    def run(batches):
        each = (row for batch in batches for part in range(0, batch.num_rows, 64) for row in batch.slice(part, 64).to_pylist())
        for _, own in groupby(each, lambda r: r["block"]):
            row = next(own)
            yield from work(row, list(own))

    return rows.mapInArrow(run, schema)


def flags(rows: list[dict]) -> np.ndarray:
    """The flags of a block's answers, by key."""
    return np.concatenate([np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=r["n"]) for r in rows]).astype(bool) if rows else np.zeros(0, bool)


def written(docs: DataFrame, tag: str, tables: Workspace, limit: int = BLOCK_BYTES) -> DataFrame:
    return tables.write(blocks(docs, tag, limit), "blocks")
