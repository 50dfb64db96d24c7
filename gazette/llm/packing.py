"""Operator 1: cost-balanced packing of token sequences.

A sequence's cost is linear * n + quadratic * n^2 summed over its pieces (attention stays
within a document). Documents go in descending length to the lowest-cost sequence that has
token capacity left; what doesn't fit goes on in the next such sequence. A task packs its
rows in groups of bounded text: as many sequences as the group's tokens fill, so that no
token is padding; what is left joins the next group, and at the task's end it fills
sequences of power-of-two sizes, which need no padding either.

Null texts count as empty: one piece with the closing id alone. Repeated rows are packed
each on its own; of equally long documents the earlier row goes first. A text longer than a group
is a group of its own, cut into sequences like others. An empty table gives no pieces; other
columns aren't looked at.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from gazette.llm.bpe import Encoder, Merges
from gazette.llm.common import documents, held, text_blocks

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CAPACITY, CLOSING_ID = 2048, 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
GROUP_BYTES = 8 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, piece_cost double"


class WordBpe:
    """The ids that the tokenizers library gives for the file, by replaying its merges over distinct words.

    The file asks for NFC, lower case, a split by a pattern and bytes as letters; a word's last
    letter carries the end mark. Texts for which a cut at spaces would not do (special tokens'
    strings, no NFC, capital sigma) are encoded by the library itself.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pre = spec["pre_tokenizer"]["pretokenizers"][0]
        self.find = regex.compile(pre["pattern"]["Regex"]).findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        first, final = [vocab[letter[b]] for b in range(256)], [vocab[letter[b] + end] for b in range(256)]
        self.encoder = Encoder(Merges(pairs), self._chunks, self.find, first, final)

    def _chunks(self, text: str) -> list[str]:
        return text.lower().replace("\n", " ").split(" ")

    def _plain(self, text: str) -> bool:
        return text.isascii() or ("Σ" not in text and unicodedata.is_normalized("NFC", text))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = [not any(s in t for s in self.special) and self._plain(t) for t in texts]
        ids, sizes = self.encoder.encode([t if ok else "" for t, ok in zip(texts, own, strict=True)])
        if all(own):
            return ids, sizes
        to = np.cumsum(sizes)
        rows = [ids[hi - n : hi] if ok else np.array(self.library.encode(t, add_special_tokens=False).ids, np.int32) for t, ok, hi, n in zip(texts, own, to, sizes, strict=True)]
        return np.concatenate(rows), np.array([len(r) for r in rows])


def assign(lengths: list[int], capacities: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Cost-balanced packing of items into sequences.

    Returns the pieces (item, start in the item, length, sequence) in the order of placing and
    the rests (item, start) for which no capacity was left.
    """
    heap = [(0.0, s) for s in range(len(capacities))]
    room = list(capacities)
    pieces, rests = [], []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, rest = 0, lengths[item]
        while rest and heap:
            cost, s = heap[0]
            n = min(rest, room[s])
            pieces.append((item, start, n, s))
            room[s] -= n
            if room[s]:
                heapq.heapreplace(heap, (cost + linear * n + quadratic * n * n, s))
            else:
                heapq.heappop(heap)
            start, rest = start + n, rest - n
        if rest:
            rests.append((item, start))
    return pieces, rests


def pack(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY, closing_id: int = CLOSING_ID, linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = False) -> DataFrame:
    """One row per piece (SCHEMA): its document, place in the document, sequence and place there.

    with_ids adds the piece's ids (array of int), for writing training sequences.
    """

    def run(batches):
        bpe = held(("packing", path), lambda: WordBpe(path))
        part = TaskContext.get().partitionId() << 36
        made = 0
        left: list[tuple] = []  # (doc_id, start, doc_tokens, ids)

        def placed(items, capacities, made):
            pieces, rests = assign([len(x[3]) for x in items], capacities, linear, quadratic)
            used = [0] * len(capacities)
            cols = [[] for _ in range(9 + with_ids)]
            for item, start, n, s in pieces:
                doc, base, total, ids = items[item]
                own = ids[start : start + n]
                row = (doc, base + start, n, zlib.crc32(own.tobytes()), total, part + made + s, used[s], capacities[s], linear * n + quadratic * n * n)
                for col, x in zip(cols, row + ((own,) if with_ids else ()), strict=True):
                    col.append(x)
                used[s] += n
            arrays = [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 8 + [pa.float64()] + [pa.list_(pa.int32())] * with_ids, strict=True)]
            names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
            return pa.RecordBatch.from_arrays(arrays, names), [(items[i][0], items[i][1] + a, items[i][2], items[i][3][a:].copy()) for i, a in rests]

        for values, rows in text_blocks(batches, limit=GROUP_BYTES):
            ids, sizes = bpe.encode([v.decode("utf-8", "replace") for v in values])
            to = np.cumsum(sizes)
            items = left
            for doc, hi, n in zip(rows.column(0).to_pylist(), to.tolist(), sizes.tolist(), strict=True):
                own = np.empty(n + 1, "<u4")
                own[:n] = ids[hi - n : hi]
                own[n] = closing_id
                items.append((doc, 0, n + 1, own))
            full = sum(len(x[3]) for x in items) // capacity
            if full:
                batch, left = placed(items, [capacity] * full, made)
                made += full
                yield batch
            else:
                left = items
        rest = sum(len(x[3]) for x in left)
        if rest:
            yield placed(left, [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1], made)[0]

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
