"""Operator 3: toxicity by class-conditional Kneser-Ney models.

Two character models of words share one backoff: the counts of the highest order are kept per
class, all lower orders are continuation counts over both, so that a rare expression is as
likely under either and only what a class is known to prefer sets them apart. A word's ratio
is its log-likelihood under the toxic model less that under the ordinary one. A document is
described by the sum of ratios over the length, of the whole text and of its most toxic
passage, and by the three largest ratios; a logistic curve, fitted on labelled rows that the counts did not
use, turns them into a score from 0 to 1.

The classifier is fitted on at most max_rows labelled rows and max_chars code points of each class,
those whose ids have the least hashes; every text, however long, is scored as a whole. Grams are
known by 64-bit hashes, computed and counted on Spark; a model holds some hundred thousand, of
which two are taken for one with odds below one in a hundred million.

Labels repeated for an id count once (toxic if any says so). Null and empty texts have no words
and get the curve's value for all-zero features. With labels of one kind only there is nothing to
learn: every score is the smoothed share of toxic rows and model.language is None. Repeated rows
get equal scores; an empty table gives no rows; a column of the score's name is replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gazette.llm.common import documents, fold, held, mix, text_blocks

MAX_ROWS = 5000  # labelled rows of a class
MAX_CHARS = 32_000_000  # of their texts together; one text of a class may be longer
ORDER, SHARED_ORDER = 8, 5
DISCOUNT = 0.75
TOP_DISCOUNT = 2.0  # an expression seen once or twice in a class says nothing of the class
THRESHOLD = 0.7
PASSAGE = 24  # chunks between spaces
CALIBRATION = 3  # every third labelled row fits the curve, the others the counts
LIMIT, LIMIT_CHARS = 200_000, 8 << 20
FEATURES = 5
_words = regex.compile(r"[^\W\d_]+").findall
_START, _END = 2, 3
CLASSES = ("ordinary", "toxic")


def _codes(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each after order - 1 start marks and with an end mark, and each one's word (-1: start mark)."""
    pad = chr(_START) * (order - 1)
    points = np.frombuffer("".join(pad + w + chr(_END) for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + order
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return points, np.where(at < order - 1, -1, owner)


def _grams(points: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to order, a hash of the n code points that end at each position."""
    out = [mix(points.astype(np.uint64) + np.uint64(1))]
    for n in range(2, order + 1):
        before = np.concatenate(([np.uint64(0)], out[-1][:-1]))
        out.append(mix(before * np.uint64(0x9E3779B97F4A7C15) + points + np.uint64(n)))
    return out


class Table:
    """Hash -> row of numbers, 0 for what isn't there. The first bits of a hash lead to a place at or just before its own."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys = np.concatenate((keys[order], [np.uint64(2**64 - 1)]))
        self.values = np.concatenate((values[order], np.zeros((1, values.shape[1]))))
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.start[(keys >> self.shift).astype(np.int64)]
        short = np.flatnonzero(self.keys[at] < keys)
        while len(short):
            at[short] += 1
            short = short[self.keys[at[short]] < keys[short]]
        return self.values[np.where(self.keys[at] == keys, at, len(self.keys) - 1)]


def _sums(keys: np.ndarray, values: np.ndarray) -> Table:
    unique, inverse = np.unique(keys, return_inverse=True)
    return Table(unique, np.stack([np.bincount(inverse, v, len(unique)) for v in values.T], 1))


@dataclass
class Counts:
    """What the model needs of the grams of the highest order, each with a count per class; grams are known by their hashes.

    top: the grams that some class has more often than the discount takes off; contexts: what
    stands before those, with its occurrences per class and what the discounts set free per
    class; lower: the suffixes of the shared order (and for n = shared order to 2, each one's
    context of n - 1 and suffix of n - 1 code points) with the number of grams that end so.
    All other contexts hand their whole mass to the backoff and needn't be kept.
    """

    top: tuple[np.ndarray, np.ndarray]
    contexts: tuple[np.ndarray, np.ndarray]
    lower: tuple[np.ndarray, np.ndarray]


class KneserNey:
    def __init__(self, counts: Counts, order: int = ORDER, shared_order: int = SHARED_ORDER, discount: float = DISCOUNT, top_discount: float = TOP_DISCOUNT):
        self.order, self.shared, self.discount, self.top_discount = order, shared_order, discount, top_discount
        self.top = Table(counts.top[0], counts.top[1].astype(float))
        self.top_context = Table(counts.contexts[0], counts.contexts[1].astype(float))
        self.classes = counts.top[1].shape[1]
        hashes, kinds = counts.lower  # columns: gram, then context and suffix by descending order
        self.lower: list[tuple] = [()]  # by order: continuations of a gram, and of its context with its types
        for n in range(shared_order, 0, -1):
            value = kinds[:, None].astype(float)
            context = _sums(hashes[:, 1], np.concatenate((value, np.ones_like(value)), 1)) if n > 1 else (float(value.sum()), len(value))
            self.lower.insert(1, (Table(hashes[:, 0], value), context))
            if n > 1:
                _, first, kinds = np.unique(hashes[:, 2], return_index=True, return_counts=True)
                hashes = hashes[first, 2:]

    def ratios(self, words: list[str], at_once: int = 20_000) -> np.ndarray:
        """Per word, the log-likelihood under class 1 less that under class 0."""
        return np.concatenate([self._ratios(words[i : i + at_once]) for i in range(0, len(words), at_once)] or [np.zeros(0)])

    def _ratios(self, words: list[str]) -> np.ndarray:
        points, owner = _codes(words, self.order)
        grams, d = _grams(points, self.order), self.discount
        total, kinds = self.lower[1][1]
        p = (np.maximum(self.lower[1][0](grams[0])[:, 0] - d, 0) + d * kinds / 65536) / total
        before = lambda n: np.concatenate(([np.uint64(0)], grams[n - 2][:-1]))  # noqa: E731  contexts of the grams of order n
        for n in range(2, self.shared + 1):
            gram, context = self.lower[n]
            c = context(before(n))
            seen = c[:, 0] > 0
            p = np.where(seen, (np.maximum(gram(grams[n - 1])[:, 0] - d, 0) + d * c[:, 1] * p) / np.maximum(c[:, 0], 1), p)
        c, own, k = self.top_context(before(self.order)), self.top(grams[-1]), self.classes
        logs = [np.log(np.where(c[:, i] > 0, (np.maximum(own[:, i] - self.top_discount, 0) + c[:, k + i] * p) / np.maximum(c[:, i], 1), p)) for i in range(k)]
        keep = owner >= 0
        return np.bincount(owner[keep], (logs[1] - logs[0])[keep], len(words))


@dataclass
class Model:
    language: KneserNey | None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    prior: float = 0.5
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


class Scorer:
    """Features of texts; what it knows of a chunk between spaces is kept until the chunks are LIMIT or hold LIMIT_CHARS."""

    def __init__(self, language: KneserNey):
        self.language = language
        self._forget()

    def _forget(self) -> None:
        self.known: defaultdict[str, int] = defaultdict(count().__next__)
        self.values = np.zeros((0, 2))  # log-likelihood ratio, length
        self.chars = 0

    def features(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > LIMIT or self.chars > LIMIT_CHARS:
            self._forget()
        get, rows = self.known.__getitem__, []
        for text in texts:
            parts = text.lower().replace("\n", " ").split(" ")
            rows.append(np.fromiter(map(get, parts), np.int64, len(parts)))
        if (old := len(self.values)) < len(self.known):
            chunks = list(islice(self.known, old, None))
            self.chars += sum(map(len, chunks))
            words: defaultdict[str, int] = defaultdict(count().__next__)
            owner, use = [], []
            for i, chunk in enumerate(chunks):
                for w in _words(chunk):
                    owner.append(i)
                    use.append(words[w])
            new = np.zeros((len(chunks), 2))
            if words:
                ratio, length = self.language.ratios(list(words)), np.fromiter(map(len, words), float, len(words)) + 1
                new[:, 0] = np.bincount(owner, ratio[use], len(chunks))
                new[:, 1] = np.bincount(owner, length[use], len(chunks))
            self.values = np.concatenate((self.values, new))
        out = np.zeros((len(texts), FEATURES))
        for i, row in enumerate(rows):
            v = self.values[row]
            v = v[v[:, 1] > 0]
            if not len(v):
                continue
            upto = np.concatenate((np.zeros((1, 2)), np.cumsum(v, 0)))
            span = min(PASSAGE, len(v))
            windows = upto[span:] - upto[:-span]
            best = np.partition(v[:, 0], len(v) - 3)[-3:] if len(v) > 3 else v[:, 0]
            best = np.sort(best)[::-1]
            out[i] = upto[-1, 0] / upto[-1, 1], (windows[:, 0] / windows[:, 1]).max(), best[0], best[min(1, len(best) - 1)], best[-1]
        return out


def _with_features(df: DataFrame, model, into: list[str]) -> DataFrame:
    """df with the columns into, in place of any of these names: features (two or more names), or the score (one name)."""
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in into}]
    names = kept if "text" in kept else [*kept, "text"]
    out = StructType([f for f in df.schema.fields if f.name in kept] + [StructField(n, DoubleType()) for n in into])

    def run(batches) -> Iterator[pa.RecordBatch]:
        scorer = held(("toxicity", model.value.name), lambda: Scorer(model.value.language))
        for values, rows in text_blocks(batches):
            x = scorer.features([v.decode("utf-8", "replace") for v in values])
            if len(into) == 1:
                w = model.value.weights
                x = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -35, 35)))[:, None]
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], *[pa.array(c) for c in x.T]], names=[*kept, *into])

    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, out)


def _word_counts(df: DataFrame) -> DataFrame:
    """word, ordinary, toxic: occurrences of words, by class."""

    def run(batches):
        for values, rows in text_blocks(batches):
            counts = (Counter(), Counter())
            for text, toxic in zip(values, rows.column(1).to_pylist(), strict=True):
                counts[toxic].update(_words(text.decode("utf-8", "replace").lower()))
            for toxic, own in enumerate(counts):
                yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), pa.array([toxic] * len(own), pa.int32()), pa.array(own.values(), pa.int64())], ["word", "toxic", "n"])

    total = lambda t: F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0))
    return df.select("text", "toxic").mapInArrow(run, "word string, toxic int, n long").groupBy("word").agg(total(0).alias(CLASSES[0]), total(1).alias(CLASSES[1]))


def _gram_counts(words: DataFrame, order: int, shared_order: int) -> DataFrame:
    """gram, context, ending, ordinary, toxic: hashes of grams of the highest order, of what stands before their last code point and of their last shared_order ones.

    Words have start marks before and an end mark behind them.
    """
    hashes = ["gram", "context", "ending"]

    def run(batches):
        for batch in batches:
            points, owner = _codes(batch.column(0).to_pylist(), order)
            grams, ends = _grams(points, order), np.flatnonzero(owner >= 0)
            gram, first, at = np.unique(grams[order - 1][ends], return_index=True, return_inverse=True)
            columns = [gram, grams[order - 2][ends[first] - 1], grams[shared_order - 1][ends[first]]]
            counts = [np.bincount(at, batch.column(i).to_numpy(zero_copy_only=False)[owner[ends]], len(gram)) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns] + [pa.array(c.astype(np.int64)) for c in counts], [*hashes, *CLASSES])

    rows = words.select("word", *CLASSES).mapInArrow(run, ", ".join(f"{h} long" for h in [*hashes, *CLASSES]))
    return rows.groupBy("gram").agg(*[F.sum(c).alias(c) for c in CLASSES], *[F.first(h).alias(h) for h in hashes[1:]])


def _lower_grams(words: DataFrame, order: int, shared_order: int) -> DataFrame:
    """The distinct grams of the shared order, ending, and by descending order n the hashes of their contexts, cN, and suffixes, gN-1, of n - 1 code points."""
    names = ["ending", *[c for n in range(shared_order, 1, -1) for c in (f"c{n}", f"g{n - 1}")]]

    def run(batches):
        for batch in batches:
            points, owner = _codes(batch.column(0).to_pylist(), order)
            grams, ends = _grams(points, shared_order), np.flatnonzero(owner >= 0)
            gram, first = np.unique(grams[shared_order - 1][ends], return_index=True)
            ends, columns = ends[first], [gram]
            for n in range(shared_order, 1, -1):
                columns += [grams[n - 2][ends - 1], grams[n - 2][ends]]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names)

    return words.select("word").mapInArrow(run, ", ".join(f"{n} long" for n in names)).dropDuplicates(["ending"])


def _numbers(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A table of longs on the driver, by Arrow: its columns of hashes and, of the names that don't begin with n_, the counts."""
    table = df.toArrow()
    of = lambda counts: np.stack([table[c].to_numpy() for c in table.column_names if c.startswith("n_") == counts] or [np.zeros(0)], 1)
    return of(False).astype(np.int64).view(np.uint64), of(True)


def _counts(df: DataFrame, order: int, shared_order: int, top_discount: float) -> Counts | None:
    """The collected numbers are bounded as the fitted rows are, in number (max_rows) and in text (MAX_CHARS)."""
    words = _word_counts(df).persist()
    grams = _gram_counts(words, order, shared_order).persist()
    try:
        kinds = grams.groupBy("ending").agg(F.count("*").alias("n_kinds"))
        lower = _numbers(_lower_grams(words, order, shared_order).join(kinds, "ending"))
        much = F.greatest(*CLASSES)
        top = _numbers(grams.where(much > top_discount).select("gram", *[F.col(c).alias(f"n_{c}") for c in CLASSES]))
        freed = [F.sum(F.least(c, F.lit(top_discount))).alias(f"n_free_{c}") for c in CLASSES]
        by_context = grams.groupBy("context").agg(*[F.sum(c).alias(f"n_{c}") for c in CLASSES], *freed, F.max(much).alias("much"))
        contexts = _numbers(by_context.where(F.col("much") > top_discount).drop("much"))
    finally:
        grams.unpersist()
        words.unpersist()
    return Counts((top[0][:, 0], top[1]), (contexts[0][:, 0], contexts[1]), (lower[0], lower[1][:, 0])) if len(top[0]) else None


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.02, steps: int = 40) -> np.ndarray:
    """Weights and intercept by Newton's method on balanced classes; the features are scaled for the penalty."""
    scale = np.maximum(x.std(0), 1e-9)
    a = np.concatenate((x / scale, np.ones((len(x), 1))), 1)
    row = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    ridge = np.append(np.full(x.shape[1], penalty / 10), 1e-9)
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        w += np.linalg.solve((a * (row * p * (1 - p) + 1e-12)[:, None]).T @ a + np.diag(ridge), a.T @ (row * (y - p)) - ridge * w)
    return np.append(w[:-1] / scale, w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, held_out_fold: int = 1, folds: int = 3, order: int = ORDER, max_chars: int = MAX_CHARS) -> Model:
    """Learns from labelled rows outside the held-out fold only."""
    spark = docs.sparkSession
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id"), folds) != held_out_fold)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("at", F.xxhash64("doc_id"))
    chosen = [usable.where(F.col("toxic") == t).orderBy("at", "doc_id").limit(max_rows) for t in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).collect()  # 2 * max_rows ids at most
    toxic = sum(r.toxic for r in ids)
    if not 0 < toxic < len(ids):
        return Model(None, prior=(toxic + 1) / (len(ids) + 2))
    wanted = F.broadcast(spark.createDataFrame([(r.doc_id,) for r in ids], "doc_id long"))
    labelled = docs.select("doc_id", "text").join(wanted, "doc_id").persist()
    length = {r.doc_id: r.n or 0 for r in labelled.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n")).collect()}
    bounded, used = [], Counter()
    for i, r in enumerate(sorted(ids, key=lambda r: (r.toxic, r.at, r.doc_id))):
        n = length.get(r.doc_id, 0)
        if not used[r.toxic] or used[r.toxic] + n <= max_chars:
            bounded.append((r.doc_id, r.toxic, i % CALIBRATION == 0))
            used[r.toxic] += n
    toxic = sum(r[1] for r in bounded)
    prior = (toxic + 1) / (len(bounded) + 2)
    chosen = F.broadcast(spark.createDataFrame(bounded, "doc_id long, toxic int, calibrates boolean"))
    rows = labelled.join(chosen, "doc_id").select("text", "toxic", "calibrates")
    try:
        counts = _counts(rows.where("not calibrates"), order, SHARED_ORDER, TOP_DISCOUNT)
        if counts is None:
            return Model(None, prior=prior)
        model = Model(KneserNey(counts, order), prior=prior)
        shared = spark.sparkContext.broadcast(model)
        names = [f"x{i}" for i in range(FEATURES)]
        found = _with_features(rows.where("calibrates").select("text", "toxic"), shared, names).drop("text").toArrow()
        shared.destroy()
    finally:
        labelled.unpersist()
    x, y = np.stack([found[n].to_numpy() for n in names], 1), found["toxic"].to_numpy().astype(float)
    order = np.lexsort((y, *x.T))
    if len(set(y.tolist())) == 2:
        model.weights = logistic(x[order], y[order])
    return model


def score(df: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """df with the score of its column text, in place of a column of that name if there is one."""
    if model.language is None:
        return df.withColumn(into, F.lit(model.prior))
    return _with_features(df, df.sparkSession.sparkContext.broadcast(model), [into])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model).withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
