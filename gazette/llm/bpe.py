"""Merge replay: byte-pair encoding of many words at once.

The distinct words of a block of text are laid out as one array of symbols. An
inverted index leads from a merge rank to the positions where its pair stands.
Ranks are taken in ascending order; each merge is applied at all its positions and
only the pairs left and right of them are looked up again.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable
from itertools import count, islice

import numpy as np

NONE = np.int32(2**31 - 1)
#: From so many positions on, a merge is applied with array operations.
FEW = 10
#: Chunks, and their code points together, beyond which what is known of them is forgotten.
LIMIT, LIMIT_CHARS = 250_000, 8 << 20


class Merges:
    """pairs: (left id, right id) -> (rank, id of the merged symbol)."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        codes = np.array([(a << 32) | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        order = np.argsort(codes)
        self.codes = np.concatenate((codes[order], [np.iinfo(np.int64).max]))
        self.ranks = np.concatenate((values[order, 0], [NONE])).astype(np.int32)
        self.of = dict(zip(codes.tolist(), values[:, 0].tolist(), strict=True))
        self.merged = dict(zip(values[:, 0].tolist(), values[:, 1].tolist(), strict=True))
        sides: dict[int, tuple[set, set]] = defaultdict(lambda: (set(), set()))
        for (a, b), (rank, _) in pairs.items():
            sides[rank][0].add(a)
            sides[rank][1].add(b)
        #: Ranks whose pair can overlap itself, as in "aaa".
        self.overlapping = {rank for rank, (a, b) in sides.items() if a & b}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, self.ranks[at], NONE)

    def plain(self, symbols: list[int]) -> list[int]:
        """One word at a time: the definition, for words that the replay can't order."""
        symbols = list(symbols)
        while len(symbols) > 1:
            ranks = [self.of.get((a << 32) | b, NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            symbols[i : i + 2] = [self.merged[least]]
        return symbols

    def replay(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words one after the other and symbols per word (1 at least): the same once encoded."""
        n = len(symbols)
        if not n:
            return symbols.astype(np.int32), lengths
        sym = np.concatenate((symbols, [-1])).astype(np.int32)
        nxt = np.arange(1, n + 2, dtype=np.int32)
        prv = np.arange(-1, n, dtype=np.int32)
        last = np.cumsum(lengths) - 1
        nxt[last] = nxt[n] = n
        prv[last[:-1] + 1] = n
        prv[0] = n
        rank = np.concatenate((self.lookup(sym[:n], sym[nxt[:n]]), [NONE])).astype(np.int32)
        rank[n] = NONE
        alive = np.ones(n + 1, bool)
        order = np.argsort(rank[:n], kind="stable").astype(np.int32)
        order = order[: int(np.searchsorted(rank[order], NONE))]
        first, at = np.unique(rank[order], return_index=True)
        index = dict(zip(first.tolist(), np.split(order, at[1:]), strict=True)) if len(order) else {}
        later: dict[int, list[int]] = {}
        heap = first.tolist()
        odd: set[int] = set()
        of, merged = self.of, self.merged
        while heap:
            r = heapq.heappop(heap)
            pos = index.pop(r, None)
            more = later.pop(r, None)
            if more is not None:
                extra = np.array(more, np.int32)
                pos = extra if pos is None else np.concatenate((pos, extra))
            if pos is None:
                continue
            pos = pos[rank[pos] == r]
            if not len(pos):
                continue
            new = merged[r]
            if more is not None and len(pos) > 1:
                pos = np.sort(pos)
                pos = pos[np.concatenate(([True], pos[1:] != pos[:-1]))]
            if r in self.overlapping and len(pos) > 1:
                starts = np.concatenate(([True], nxt[pos[:-1]] != pos[1:]))
                ids = np.arange(len(pos))
                pos = pos[(ids - np.maximum.accumulate(np.where(starts, ids, 0))) % 2 == 0]
            if len(pos) <= FEW:
                for i in pos.tolist():
                    j = int(nxt[i])
                    k = int(nxt[j])
                    q = int(prv[i])
                    sym[i] = new
                    nxt[i] = k
                    prv[k] = i
                    rank[j] = NONE
                    alive[j] = False
                    for p, code in ((q, (int(sym[q]) << 32) | new), (i, (new << 32) | int(sym[k]))):
                        if p != n:
                            x = of.get(code, NONE) if p == q or k != n else NONE
                            rank[p] = x
                            if x != NONE:
                                if x <= r:
                                    odd.add(p)
                                if x in later:
                                    later[x].append(p)
                                else:
                                    later[x] = [p]
                                    heapq.heappush(heap, x)
                continue
            j = nxt[pos]
            k = nxt[j]
            sym[pos] = new
            nxt[pos] = k
            prv[k] = pos
            rank[j] = NONE
            alive[j] = False
            q = prv[pos]
            touched = np.concatenate((q, pos))
            ranks = self.lookup(sym[touched], sym[nxt[touched]])
            ranks[touched == n] = NONE
            rank[touched] = ranks
            rank[n] = NONE
            valid = ranks != NONE
            for p, x in zip(touched[valid].tolist(), ranks[valid].tolist(), strict=True):
                if x <= r:
                    odd.add(p)
                if x in later:
                    later[x].append(p)
                else:
                    later[x] = [p]
                    heapq.heappush(heap, x)
        alive = alive[:n]
        out = sym[:n][alive]
        ends = np.cumsum(alive)[last]
        sizes = np.diff(ends, prepend=0)
        if odd:  # a pair came up below the rank in hand: encode its word by the definition
            words = np.unique(np.searchsorted(last, np.array(sorted(odd))))
            begins = last - lengths + 1
            parts, done = [], 0
            for w in words.tolist():
                lo = int(ends[w] - sizes[w])
                own = self.plain(symbols[begins[w] : last[w] + 1].tolist())
                parts += [out[done:lo], np.array(own, np.int32)]
                done = int(ends[w])
                sizes[w] = len(own)
            out = np.concatenate([*parts, out[done:]])
        return out, sizes


class Encoder:
    """Encodes texts by the distinct chunks they are cut into.

    chunks(text) cuts a text where no token can cross, words(chunk) gives the strings within
    which merges go on. A word's bytes become symbols by the table first, its last byte by the
    table final. Chunks once encoded are kept until they are limit or hold LIMIT_CHARS code points.
    """

    def __init__(self, merges: Merges, chunks: Callable[[str], list[str]], words: Callable[[str], list[str]], first: list[int], final: list[int] | None = None, limit: int = LIMIT):
        self.merges, self.chunks, self.words, self.limit = merges, chunks, words, limit
        self.first, self.final = np.array(first, np.int32), None if final is None else np.array(final, np.int32)
        self._forget()

    def _forget(self) -> None:
        self.known: defaultdict[str, int] = defaultdict(count().__next__)
        self.flat, self.start, self.size, self.chars = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one text after the other, and ids per text."""
        if len(self.known) > self.limit or self.chars > LIMIT_CHARS:
            self._forget()
        get, rows = self.known.__getitem__, []
        for text in texts:
            parts = self.chunks(text)
            rows.append(np.fromiter(map(get, parts), np.int32, len(parts)))
        if len(self.known) > len(self.size):
            self._learn(list(islice(self.known, len(self.size), None)))
        at = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        sizes = self.size[at]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        per_text = np.diff(upto[np.cumsum([0, *map(len, rows)])])
        shift = np.repeat((self.start[at] - upto[:-1]).astype(np.int32), sizes)
        shift += np.arange(len(shift), dtype=np.int32)
        return self.flat[shift], per_text

    def _learn(self, new: list[str]) -> None:
        self.chars += sum(map(len, new))
        words: defaultdict[str, int] = defaultdict(count().__next__)
        get, uses, per_chunk = words.__getitem__, [], []
        for own in map(self.words, new):
            uses.extend(map(get, own))
            per_chunk.append(len(own))
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.first[data]
        if self.final is not None and len(data):
            last = np.cumsum(lengths) - 1
            symbols[last] = self.final[data[last]]
        flat, sizes = self.merges.replay(symbols, lengths)
        starts = np.cumsum(sizes) - sizes
        use = np.array(uses, np.int64)
        s = sizes[use]
        upto = np.concatenate(([0], np.cumsum(s)))
        ids = flat[np.repeat(starts[use] - upto[:-1], s) + np.arange(int(upto[-1]))]
        bounds = upto[np.cumsum([0, *per_chunk])]
        self.start = np.concatenate((self.start, bounds[:-1] + len(self.flat)))
        self.size = np.concatenate((self.size, np.diff(bounds)))
        self.flat = np.concatenate((self.flat, ids))
