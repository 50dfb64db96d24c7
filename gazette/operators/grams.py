"""Runs of one to three characters (grams) of blocks of texts, with NumPy inside tasks.

A gram is a number while it is worked on: 21 bits a character, each the code point plus one.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text of a block, unless a single text is longer; rows of a block of a scan.
BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 1 << 14
_BITS = np.uint64(21)
_SPREAD, _TABLE = np.uint64(0x9E3779B97F4A7C15), 20


def number(gram: str) -> int:
    out = 0
    for c in gram:
        out = out << 21 | ord(c) + 1
    return out


def gram(value: int) -> str:
    out = ""
    while value:
        out, value = chr((value & 0x1FFFFF) - 1) + out, value >> 21
    return out


def blocks(batches, apart: Callable | None = None, limit: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator[tuple[list[str], pa.RecordBatch]]:
    """(search_text, null as empty; the Arrow rows) in runs of at most limit bytes, one row at least; apart(batch): where a row can't follow the one before."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("search_text")).cast("binary")
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(apart(batch)) if apart else np.empty(0, np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, before + limit, "right"))), at + rows)
            beyond = np.searchsorted(cuts, at, "right")
            to = min(to, int(cuts[beyond])) if beyond < len(cuts) else to
            yield [(v or b"").decode("utf-8", "replace") for v in col.slice(at, to - at).to_pylist()], batch.slice(at, to - at)
            at = to


def numbers(texts: list[str], sizes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, its text's place) for every run of each size within a text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    place = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    for n in sizes:
        m = len(points) - n + 1
        if m <= 0:
            continue
        value = points[:m]
        for k in range(1, n):
            value = value << _BITS | points[k : k + m]
        if n == 1:
            yield value, place
        else:
            inner = place[:m] == place[n - 1 :]
            yield value[inner], place[:m][inner]


class Wanted:
    """Occurrences of given grams in blocks."""

    def __init__(self, grams: list[str]):
        self.values, self.place = np.unique(np.array([number(g) for g in grams], np.uint64), return_inverse=True)
        self.sizes = sorted({len(g) for g in grams})
        self.table = np.zeros(1 << _TABLE, bool)
        self.table[self._slot(self.values)] = True

    def _slot(self, values: np.ndarray) -> np.ndarray:
        return values * _SPREAD >> np.uint64(64 - _TABLE)

    def found(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in values, place of the text) of each occurrence."""
        for value, place in numbers(texts, self.sizes):
            likely = self.table[self._slot(value)]
            value, place = value[likely], place[likely]
            at = np.minimum(np.searchsorted(self.values, value), len(self.values) - 1)
            same = self.values[at] == value
            yield at[same], place[same]


def counter(grams: list[str]) -> Callable:
    """For mapInArrow over search_text: gram and n, its occurrences in a task's rows."""

    def count(batches):
        wanted = Wanted(grams)
        total = np.zeros(len(wanted.values), np.int64)
        for texts, _ in blocks(batches):
            for at, _ in wanted.found(texts):
                total += np.bincount(at, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": pa.array([gram(int(v)) for v in wanted.values[some]], pa.string()), "n": total[some]})

    return count


def matcher(sets: list[tuple[int, list[str], str]], k: int, stored: tuple[str, ...]) -> Callable:
    """For mapInArrow over stored: for each of the sets (number, tokens, a gram of all rows that have the tokens) the first k rows of a task.

    A gram is no more looked at in rows beyond the k rows that all of its sets have, so rows that come in order cost little.
    """
    last = np.iinfo(np.int64).max

    def match(batches):
        wanted = Wanted([g for _, _, g in sets])
        of = defaultdict(list)
        for (i, toks, _), at in zip(sets, wanted.place, strict=True):
            of[int(at)].append((i, toks))
        best: dict[int, list] = {i: [] for i, _, _ in sets}  # heaps, the last of the k rows first
        bound = np.full((2, len(wanted.values)), last)
        taken = 0
        for texts, rows in blocks(batches):
            order = [rows.column(rows.schema.get_field_index(c)).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False) for c in ("type_pos", "item_pos")]
            pairs = []
            for at, place in wanted.found(texts):
                near = (order[0][place] < bound[0][at]) | (order[0][place] == bound[0][at]) & (order[1][place] < bound[1][at])
                pairs.append(place[near].astype(np.int64) * len(wanted.values) + at[near])
            touched = set()
            for pair in np.unique(np.concatenate(pairs or [np.empty(0, np.int64)])).tolist():
                row, at = divmod(pair, len(wanted.values))
                key = (-int(order[0][row]), -int(order[1][row]))
                for i, toks in of[at]:
                    heap = best[i]
                    if len(heap) == k and key <= heap[0][0]:
                        continue
                    if all(t in texts[row] for t in toks):
                        taken += 1
                        (heapq.heappushpop if len(heap) == k else heapq.heappush)(heap, (key, taken, rows.slice(row, 1)))
                        touched.add(at)
            for at in touched:
                if all(len(best[i]) == k for i, _ in of[at]):
                    worst = min(best[i][0][0] for i, _ in of[at])
                    bound[:, at] = -worst[0], -worst[1]
            for i in {i for at in touched for i, _ in of[at]}:  # rows of their own, so that no block stays for the sake of one
                best[i] = [(key, n, row if isinstance(row, tuple) else tuple(row.column(row.schema.get_field_index(c))[0].as_py() for c in stored)) for key, n, row in best[i]]
        hits = [(i, *row) for i, heap in best.items() for _, _, row in heap]
        for start in range(0, len(hits), 10_000):
            columns = list(zip(*hits[start : start + 10_000], strict=True))
            types = [pa.int64(), *(pa.int64() if c.endswith("_pos") else pa.string() for c in stored)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["set", *stored])

    return match


def postings(block_rows: int, sizes: tuple[int, ...]) -> Callable:
    """For mapInArrow over at and search_text in order: gram, block (the first at of a run of rows), rows (places after it), n."""

    def apart(batch):
        at = batch.column(batch.schema.get_field_index("at")).to_numpy(zero_copy_only=False)
        return np.concatenate(([True], np.diff(at) != 1)) | (at % block_rows == 0)

    def pieces(texts: list[str], first: int, n: int) -> Iterator[pa.RecordBatch]:
        for value, place in numbers(texts, (n,)):
            # A character is its place in the block's alphabet, so that a gram and its text are one number to sort.
            char = lambda j: value >> np.uint64(21 * j) & np.uint64(0x1FFFFF)  # noqa: E731, B023
            letters = np.unique(np.concatenate([np.unique(char(j)) for j in range(n)]))
            width, low = max(1, (len(letters) - 1).bit_length()), (len(texts) - 1).bit_length()
            if n * width + low > 64:  # too many characters for so many texts: halves; all characters have room with a single text
                half = len(texts) // 2
                yield from pieces(texts[:half], first, n)
                yield from pieces(texts[half:], first + half, n)
                return
            if not len(value):
                return
            packed = np.zeros(len(value), np.uint64)
            for j in reversed(range(n)):
                packed = packed << np.uint64(width) | np.searchsorted(letters, char(j)).astype(np.uint64)
            packed = np.sort(packed << np.uint64(low) | place.astype(np.uint64))
            packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))]
            own = packed >> np.uint64(low)
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            heads = own[starts]
            chars = np.stack([letters[(heads >> np.uint64(width * j) & np.uint64((1 << width) - 1)).astype(np.int64)] for j in reversed(range(n))], axis=1)
            joined = (chars - np.uint64(1)).astype(np.uint32).tobytes().decode("utf-32-le")
            ends = np.append(starts, len(packed))
            rows = (packed & np.uint64((1 << low) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "gram": pa.array([joined[i * n : i * n + n] for i in range(len(starts))], pa.string()), "block": np.full(len(starts), first, np.int64),
                "rows": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows, pa.int32())), "n": np.diff(ends).astype(np.int64),
            })

    def run(batches):
        for texts, rows in blocks(batches, apart, rows=block_rows):
            for n in sizes:
                yield from pieces(texts, rows.column(rows.schema.get_field_index("at"))[0].as_py(), n)

    return run
