"""Operator 10: language-model scores by deleted interpolation.

P(w | h) = a2(b) * c(h, w) / c(h) + a1(b) * c(w) / N + a0(b) / (V + 1), where b is the bucket of
how often the context h occurred. The mixture weights are learned by expectation-maximisation:
counts come from the training documents without a held-out fold of them, likelihoods from
that fold. Scores then use the counts of all training documents.

Texts are cut into blocks; a block asks for the counts of its distinct words and word pairs
(64-bit hashes) and contributes its own, one row per slice of the hash space. A slice's task adds
them up and answers every block that asked. A frequent word is one number per block, so no task
grows with a word's frequency, and no table is broadcast. Slices are as many as keep a slice's
share of the text at SLICE_BYTES; blocks grow with the square root of the text, up to MOST_BYTES,
so that the rows between blocks and slices stay few.

More than FANOUT slices (64 GB of text) are too many to ask each: a block then asks the square
root of their number of coarse slices, groups of as many blocks add up what they ask of a coarse
slice, and the group asks its fine slices once for all of them. So the rows grow as the text to
the power 1.5 at any size, and the results are the same.

Every occurrence of all training documents is counted, by hash: two of n words or pairs are taken
for one with odds of n^2 / 2^65, one in fifty for a billion of them; of 10^13, one in two
million shares its count with another one.

Null texts count as empty: one token, the end. Repeated rows count as often as they occur. A text
longer than a block is a block of its own. Without training documents every token is unknown; an
empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import BLOCK_BYTES, documents, hashed_words, mix, text_blocks
from gazette.sources.tables import Workspace, materialise

FOLDS, HELD_OUT, TUNING = 7, 2, 3
BUCKETS = 24
STEP = 8  # likelihoods are grouped by eighths of a power of two for the EM
ROUNDS = 60
#: Bytes of text of which a slice counts the words, and the most that a block holds.
SLICE_BYTES, MOST_BYTES = 16 << 20, 16 << 20
#: Slices that blocks ask directly; more are asked by groups of blocks.
FANOUT = 4096
END, START = np.uint64(0x51ED270B27B5A0F1), np.uint64(0xC2B2AE3D27D4EB4F)
REQUESTS = "part int, block long, n int, keys binary, counts binary, tuning binary"
REPLIES = "part int, block long, n int, counts binary, tuning binary, n_distinct long, n_tokens long, n_tuning long"
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _role(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def _sizes(docs: DataFrame) -> tuple[int, int, int, int]:
    """Slices that a block asks, finer ones in each of these, groups of blocks, and bytes of a block."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SLICE_BYTES))
    limit = min(MOST_BYTES, max(BLOCK_BYTES, 32 * math.isqrt(total)))
    if slices <= FANOUT:
        return slices, 1, 1, limit
    fine = math.isqrt(slices - 1) + 1
    slices = -(-slices // fine)
    return slices, fine, max(1, -(-total // (limit * slices))), limit


def _blocks(docs: DataFrame, limit: int) -> DataFrame:
    """Texts in blocks, those of the tuning fold in blocks of their own with odd ids."""
    schema = "block long, doc_ids array<long>, sizes array<int>, texts binary"

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        made = TaskContext.get().partitionId() << 32
        for values, rows in text_blocks(batches, limit=limit):
            ids = rows.column(0).to_pylist()
            for odd in (0, 1):
                own = [i for i, x in enumerate(ids) if (_role(x) == TUNING) == odd]
                if own:
                    texts = [values[i] for i in own]
                    made += 1
                    yield pa.RecordBatch.from_arrays([pa.array([made * 2 + odd]), pa.array([[ids[i] for i in own]], pa.list_(pa.int64())), pa.array([list(map(len, texts))], pa.list_(pa.int32())), pa.array([pack.compress(b"".join(texts))], pa.binary())], ["block", "doc_ids", "sizes", "texts"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _tokens(row: dict) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: document ids, token hashes with an end per document, the tokens before them, tokens per document."""
    data, at, texts = zstandard.ZstdDecompressor().decompress(row["texts"]) if row["texts"] else b"", 0, []
    for n in row["sizes"]:
        texts.append(data[at : at + n])
        at += n
    words, per = hashed_words(texts)
    per = per + 1
    ends = np.cumsum(per) - 1
    token = np.full(int(per.sum()), END, np.uint64)
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner] = words
    before = np.concatenate(([START], token[:-1]))
    before[ends[:-1] + 1] = START
    return row["doc_ids"], token, before, per


def _pairs(token: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + token)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the width that takes least room; those it can't hold follow in eight bytes each. Nothing if all are 0."""
    x = x.astype("<u8")
    if not x.any():
        return b""
    most = lambda w: np.uint64(256**w - 1)
    width = min(range(1, 9), key=lambda w: len(x) * w + (8 * np.count_nonzero(x >= most(w)) if w < 8 else 0))
    beyond = x[x >= most(width)] if width < 8 else x[:0]
    return bytes([width]) + np.minimum(x, most(width)).view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + beyond.tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    if not raw:
        return np.zeros(n, np.uint64)
    width = raw[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, 1).reshape(n, width)
    out = out.reshape(-1).view("<u8")
    if width < 8:
        out[out == np.uint64(256**width - 1)] = np.frombuffer(raw, "<u8", offset=1 + n * width)
    return out


def _squeezed(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as their differences."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unsqueezed(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpacked(raw, n), dtype=np.uint64)


def _distinct(row: dict):
    """Distinct words (and the start as a context) and pairs of a block, with each occurrence's place among them."""
    ids, token, before, per = _tokens(row)
    n = len(ids)
    words, word_at = np.unique(np.concatenate((token, np.full(n, START, np.uint64))), return_inverse=True)
    pairs, pair_at = np.unique(_pairs(token, before), return_inverse=True)
    return ids, token, before, per, words, word_at, pairs, pair_at


def _columns(rows: list[tuple], schema: str) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], types[k]) for i, k in enumerate(kinds)], names=list(names))


def _parts(keys: np.ndarray, slices: int, first: int = 0, n: int | None = None):
    """(slice, from, to) of sorted keys for the slices from first, n of them, that hold any."""
    n = slices - first if n is None else n
    bounds = np.array([(first + k) * (1 << 64) // slices for k in range(1, n)], np.uint64)
    cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    return [(first + k, cuts[k], cuts[k + 1]) for k in range(n) if cuts[k + 1] > cuts[k]]


def _requests(blocks: DataFrame, slices: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, _, per, words, word_at, pairs, pair_at = _distinct(row)
                trains = np.array([_role(x) != HELD_OUT for x in ids], float)
                odd = row["block"] % 2
                weight = np.repeat(trains, per)
                out = []
                for kind, keys, at, w in ((0, words, word_at, np.concatenate((weight, trains))), (1, pairs, pair_at, weight)):
                    counts = np.bincount(at, w, len(keys)).astype(np.int64)
                    for s, lo, hi in _parts(keys, slices):
                        own = _packed(counts[lo:hi])
                        out.append((kind * slices + s, row["block"], hi - lo, _squeezed(keys[lo:hi]), b"" if odd else own, own if odd else b""))
                yield from _columns(out, REQUESTS).to_batches()

    return blocks.mapInArrow(run, REQUESTS)


def _united(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of some requests, and where among them each request's keys are, one request after the other."""
    return np.unique(np.concatenate([_unsqueezed(r["keys"], r["n"]) for r in rows]), return_inverse=True)


def _added(rows: list[dict], at: np.ndarray, n: int) -> list[np.ndarray]:
    """Sums of the requests' counts without and within the tuning fold, by key."""
    return [np.bincount(at, np.concatenate([_unpacked(r[c], r["n"]).astype(np.int64) for r in rows]), n).astype(np.int64) for c in ("counts", "tuning")]


def _answers(rows: list[dict], at: np.ndarray, sums: list[np.ndarray], stats: tuple[int, int, int] = (0, 0, 0)) -> pa.Table:
    """A reply to each of the requests; stats stand in the first."""
    out, begin = [], 0
    for i, r in enumerate(rows):
        own = at[begin : begin + r["n"]]
        begin += r["n"]
        out.append((r["part"], r["block"], r["n"], _packed(sums[0][own]), _packed(sums[1][own]), *(stats if i == 0 else (0, 0, 0))))
    return _columns(out, REPLIES)


def _replies(requests: DataFrame, slices: int) -> DataFrame:
    """For every request the counts of its keys without and within the tuning fold; distinct and all tokens once per slice."""

    def run(key, table):
        rows = table.to_pylist()
        keys, at = _united(rows)
        sums = _added(rows, at, len(keys))
        stats = (0, 0, 0)
        if rows[0]["part"] < slices:
            real = keys != START
            stats = (int(((sums[0] + sums[1]) > 0)[real].sum()), int(sums[0][real].sum()), int(sums[1][real].sum()))
        return _answers(rows, at, sums, stats)

    return requests.groupBy("part").applyInArrow(run, REPLIES)


def _merged(asked: DataFrame, slices: int, fine: int) -> DataFrame:
    """Requests of groups ("mid") of blocks, each for its own coarse slice, to the fine slices in that."""

    def run(key, table):
        rows = table.to_pylist()
        keys, at = _united(rows)
        without, within = _added(rows, at, len(keys))
        kind, coarse = divmod(rows[0]["part"], slices)
        parts = _parts(keys, slices * fine, coarse * fine, fine)
        out = [(kind * slices * fine + s, rows[0]["mid"], hi - lo, _squeezed(keys[lo:hi]), _packed(without[lo:hi]), _packed(within[lo:hi])) for s, lo, hi in parts]
        return _columns(out, REQUESTS)

    return asked.groupBy("mid").applyInArrow(run, REQUESTS)


def _handed_back(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """The replies to the groups' requests, as replies to the blocks' own."""

    def run(key, own, answered):
        rows, found = own.to_pylist(), sorted(answered.to_pylist(), key=lambda r: r["part"])
        _, at = _united(rows)
        return _answers(rows, at, [np.concatenate([_unpacked(r[c], r["n"]) for r in found]) for c in ("counts", "tuning")])

    return asked.groupBy("mid").cogroup(answers.groupBy("block")).applyInArrow(run, REPLIES)


def _counts_of(replies: list[dict], slices: int, words: int, pairs: int) -> list[np.ndarray]:
    """Counts of a block's words and pairs in the order of its keys: words, pairs without the tuning fold, then within."""
    out = []
    for column in ("counts", "tuning"):
        for kind, n in ((0, words), (1, pairs)):
            own = [_unpacked(r[column], r["n"]).astype(np.int64) for r in replies if (r["part"] >= slices) == kind]
            own = np.concatenate(own) if own else np.zeros(0, np.int64)
            if len(own) != n:
                raise ValueError(f"{len(own)} counts for {n} keys")
            out.append(own)
    return out


def _looked_up(block, replies, slices: int):
    row = block.to_pylist()[0]
    ids, token, before, per, words, word_at, pairs, pair_at = _distinct(row)
    order = sorted(replies.to_pylist(), key=lambda r: r["part"])
    counts = _counts_of(order, slices, len(words), len(pairs))
    start = int(np.searchsorted(words, START))
    first = np.cumsum(per) - per
    context_at = np.concatenate(([start], word_at[: len(token)][:-1]))
    context_at[first] = start
    return ids, per, counts, word_at[: len(token)], context_at, pair_at


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + floor(log2(count)), up to BUCKETS - 1."""
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def _grouped(step: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Likelihoods by eighths of a power of two: 1 + a place below 1.0, or 0 for none."""
    return np.where(x > 0, 1 + np.minimum(np.round(-np.log2(np.maximum(x, 1e-300)) * step), 998), 0).astype(np.int64)


def _histogram(blocks: DataFrame, replies: DataFrame, slices: int, total: int) -> DataFrame:
    """How many tokens of the tuning fold have which bucket and likelihoods: at most BUCKETS * 1000 * 1000 rows, few thousands in fact."""

    def run(key, block, answers):
        _, per, (words, pairs, _, _), at, context_at, pair_at = _looked_up(block, answers, slices)
        context = words[context_at]
        one, two = words[at] / max(total, 1), np.where(context > 0, pairs[pair_at] / np.maximum(context, 1), 0)
        code, n = np.unique((bucket(context) * 1000 + _grouped(STEP, one)) * 1000 + _grouped(STEP, two), return_counts=True)
        return pa.table({"code": pa.array(code, pa.int64()), "n": pa.array(n, pa.int64())})

    tuning, own = blocks.where("block % 2 = 1"), replies.where("block % 2 = 1")
    return tuning.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def mixture(code: np.ndarray, n: np.ndarray, unknown: float, rounds: int = ROUNDS) -> np.ndarray:
    """Per bucket the weights of uniform, word and pair likelihoods, by expectation-maximisation; thin buckets lean on the mean."""
    value = lambda q: np.where(q > 0, 2.0 ** (-(q - 1) / STEP), 0)
    b = code // 1_000_000
    x = np.stack([np.full(len(code), unknown), value(code // 1000 % 1000), value(code % 1000)], 1)

    def learn(x, n, lean, strength):
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            part = w * x
            part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
            w = (part * n[:, None]).sum(0) + lean * strength
            w /= max(w.sum(), 1e-300)
        return w

    mean = learn(x, n, np.full(3, 1 / 3), 1.0)
    out = np.tile(mean, (BUCKETS, 1))
    for k in range(BUCKETS):
        if (own := b == k).any():
            out[k] = learn(x[own], n[own], mean, 20.0)
    out[0, 2] = 0  # an unseen context has no pairs
    return out / out.sum(1, keepdims=True)


def score(docs: DataFrame) -> DataFrame:
    """One row per document (SCORE_SCHEMA)."""
    with Workspace(docs.sparkSession, "lm") as tables:
        slices, fine, groups, limit = _sizes(docs)
        blocks = tables.write(_blocks(docs, limit), "blocks")
        requests = _requests(blocks, slices)
        if fine == 1:
            replies = answers = tables.write(_replies(requests, slices), "counts")
        else:
            mid = F.col("part").cast("long") * groups + F.pmod(F.xxhash64("block"), F.lit(groups))
            asked = tables.write(requests.withColumn("mid", mid), "asked")
            answers = tables.write(_replies(_merged(asked, slices, fine), slices * fine), "answers")
            replies = tables.write(_handed_back(asked, answers), "counts")
            tables.drop("asked")
        stats = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_distinct", "n_tokens", "n_tuning")]).first()
        distinct, counted, tuning = map(int, stats)
        rows = _histogram(blocks, replies, slices, counted).toArrow()
        code, n = rows["code"].to_numpy(), rows["n"].to_numpy().astype(float)
        order = np.argsort(code)
        weights = mixture(code[order], n[order], 1 / (distinct + 1))
        return materialise(_scored(blocks, replies, slices, distinct, counted + tuning, weights), "lm-scores")


def _scored(blocks: DataFrame, replies: DataFrame, slices: int, distinct: int, total: int, weights: np.ndarray) -> DataFrame:
    def run(key, block, answers):
        ids, per, (w0, p0, w1, p1), at, context_at, pair_at = _looked_up(block, answers, slices)
        words, pairs = w0 + w1, p0 + p1
        c, context = words[at], words[context_at]
        a = weights[bucket(context)]
        p = a[:, 0] / (distinct + 1) + a[:, 1] * c / max(total, 1) + np.where(context > 0, a[:, 2] * pairs[pair_at] / np.maximum(context, 1), 0)
        first = np.cumsum(per) - per
        summed = lambda x: np.add.reduceat(x, first)
        base = summed(np.log10((c + 1) / (total + distinct + 1)))
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array([_role(x) == HELD_OUT for x in ids]), pa.array(per, pa.int64()), pa.array(summed((c > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(ids), total), pa.int64()), pa.array(base), pa.array(summed(np.log10(p)))], names=[x.split()[0] for x in SCORE_SCHEMA.split(", ")])

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, SCORE_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
