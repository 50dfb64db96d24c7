"""Operator 5: byte-level BPE encoding and decoding by merge replay.

encode() returns one row per document with its ids, query() the digests of the contract.
Nulls count as the empty text, which has no ids; repeated rows are encoded each on its own; a text
longer than a block is a block of its own; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.bpe import Encoder, Merges
from gazette.llm.common import documents, held, text_blocks

TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Text whose distinct words are replayed together.
GROUP_BYTES = 8 << 20
_JOINT = regex.compile(r"\s ")


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = dict(zip(ranks.values(), ranks, strict=True))
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    pairs[a, b] = (rank, rank)
        self.find = regex.compile(pattern).findall
        size = max(self.token) + 1
        lengths = np.array([len(self.token.get(i, b"")) for i in range(size)], np.int64)
        self.ends = np.cumsum(lengths)
        self.lengths = lengths
        self.bytes = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(size)), np.uint8)
        self.encoder = Encoder(Merges(pairs), self._chunks, self.find, [ranks.get(bytes([b]), -1) for b in range(256)])

    def _chunks(self, text: str) -> list[str]:
        """Cut before single spaces: no match of the pattern goes on past a space that follows a non-space."""
        if not text:
            return []
        if _JOINT.search(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        at = np.repeat(self.ends[ids] - n - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.bytes[at]


def _loaded(path: str, pattern: str) -> ByteBpe:
    return held(("byte_bpe", path, pattern), lambda: ByteBpe(path, pattern))


def _encoded(batches, path: str, pattern: str):
    bpe = _loaded(path, pattern)
    for values, rows in text_blocks(batches, limit=GROUP_BYTES):
        ids, sizes = bpe.encoder.encode([v.decode("utf-8", "replace") for v in values])
        yield bpe, rows, ids, sizes


def encode(docs: DataFrame, path: str = TOKENIZER, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids: array of int, in the order of the text."""

    def run(batches):
        for _, rows, ids, sizes in _encoded(batches, path, pattern):
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(0), column], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = TOKENIZER, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and text of what encode() returned; byte sequences that are no UTF-8 become U+FFFD."""

    def run(batches):
        bpe = _loaded(path, pattern)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str = TOKENIZER, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per document the number of ids, and SHA-256 of the ids and of the bytes they decode to."""

    def run(batches):
        for bpe, rows, ids, sizes in _encoded(batches, path, pattern):
            to, n, a, b = np.cumsum(sizes), [], [], []
            for lo, hi in zip((to - sizes).tolist(), to.tolist(), strict=True):
                own = ids[lo:hi]
                n.append(hi - lo)
                a.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(own).tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit(""))))
