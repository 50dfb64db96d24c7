"""Operator 13: phrases whose words stand together more often than apart, from sorted count streams.

Texts are cut into pieces at punctuation and line ends, pieces into words; A-Z count as lower case.
Counting: blocks of texts send their distinct phrases of up to three words, as sorted 64-bit keys with counts, to slices of
the key space, which add them up. A phrase found LEAST times or more is told to the first block that has it, with its count;
that block gives its words. A part of a phrase is at least as frequent as the phrase, so all that scores need is there. Two of n
phrases have the same key with odds of n^2 / 2^65: one in a thousand for 200 million; of 10^13, one in two million shares its
count with another one.

Estimation: the counts are laid out as two streams, sorted by language and then by a phrase's words
from the first on (prefix order) and from the last on (suffix order). In prefix order a phrase follows the phrases that it
begins with: one pass over the stream has the counts of its first and first two words at hand,
and of every pair the count of its most frequent extension to the right. The suffix stream gives the same for last
words and extensions to the left. The sorted results of both are merged by phrase. Nothing is looked up by hashing,
and a stream may be cut anywhere, within the phrases of a common word too: a part's first phrases lack the counts of the
words that stand in an earlier part, which are filled in by one row per part.

Cutting a phrase scores floor(SCALE * a^2 / (l * r)), in exact decimals (counts up to 10^15); the
lowest-scoring cut counts. Pairs within a phrase of three words that is at least half as frequent go.

Defined results: null and empty texts have no pieces; a null lang is UNKNOWN; repeated rows count as often as
they occur; equal scores go by count and then by phrase, so that ranks are unique. Languages without
phrases have no rows, an empty table none. Long texts are taken whole. Other columns aren't looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.llm import exchange
from gazette.llm.common import documents, mix
from gazette.sources.tables import Workspace, materialise

# Where pieces end; the name of no language.
ENDS, UNKNOWN = b".,;:!?\n\x0b\x0c\r", "und"
LEAST, TOP, SCALE, SHARE = 10, 2000, 1_000_000, 50
#: Parts of a language from which the best TOP phrases are taken before the whole's.
SALTS = 16
_CUT = bytes.maketrans(ENDS, b"\n" * len(ENDS))
#: Stands between pieces; no UTF-8 text holds it.
_GAP = b"\xff"
_A = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "lang string, w1 string, w2 string, w3 string, f long"
STREAM = "part int, lang string, w1 string, w2 string, w3 string, f long, one long, two long, extension long"


def _coded(row: dict) -> list[tuple]:
    """Of each language in a block: its name, the words' numbers one after the other with 0 between pieces, and the numbering."""
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in zip(row["tags"], exchange.texts(row), strict=True):
        by_lang.setdefault(UNKNOWN if lang is None else lang, []).append(text)
    out = []
    for lang, texts in sorted(by_lang.items()):
        tokens = b"\n".join([b"", *texts, b""]).lower().translate(_CUT).replace(b"\n", b" " + _GAP + b" ").split()
        codes = exchange.Codes({_GAP: 0})
        out.append((lang, np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens)), codes))
    return out


class _Phrases:
    """The distinct phrases of one to three words of one language in a block: keys, counts, and the numbers of their words."""

    def __init__(self, lang: str, code: np.ndarray, codes: exchange.Codes):
        self.lang, self.codes, self.total = lang, codes, int(np.count_nonzero(code))
        many = np.int64(len(codes))
        # Not the same mixing for both: a language's name is a word of another one whose name is a word of it.
        word = mix(codes.hashes() + mix(exchange.Codes({lang.encode(): 0}).hashes() * _A)[0])
        real = (code[:-1] > 0) & (code[1:] > 0)
        pairs, at, n_pairs = np.unique((code[:-1] * many + code[1:])[real], return_inverse=True, return_counts=True)
        place = np.full(len(code), -1, np.int64)
        place[:-1][real] = at
        both = np.flatnonzero(real[:-1] & real[1:])
        triples, n_triples = np.unique(place[both] * many + code[both + 2], return_counts=True)
        key = mix(word[pairs // many] * _A + word[pairs % many])
        self.keys = np.concatenate((word[1:], key, mix(key[triples // many] * _A + word[triples % many] + _A)))
        self.counts = np.concatenate((np.bincount(code, minlength=len(codes))[1:], n_pairs, n_triples))
        one, none = np.arange(1, len(codes)), np.zeros(len(codes) - 1, np.int64)
        first = pairs // many
        self.words = [
            np.concatenate((one, first, first[triples // many])),
            np.concatenate((none, pairs % many, (pairs % many)[triples // many])),
            np.concatenate((none, np.zeros(len(pairs), np.int64), triples % many)),
        ]


def _phrases(row: dict) -> tuple[list[_Phrases], np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: its languages' phrases; sorted distinct keys of them all, the place of each among them, and their counts."""
    each = [_Phrases(*x) for x in _coded(row)]
    keys, first, at = np.unique(np.concatenate([x.keys for x in each]), return_index=True, return_inverse=True)
    return each, keys, first, np.bincount(at, np.concatenate([x.counts for x in each]), len(keys)).astype(np.int64)


def _requested(stored: DataFrame, n_slices: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, keys, _, counts = _phrases(row)
                if len(keys):
                    yield from exchange.requests(row, keys, n_slices, 0, counts - 1, np.zeros(len(keys), np.int64))

    return stored.mapInArrow(run, exchange.REQUESTS)


def _frequent(rows: list[dict], least: int) -> list[tuple]:
    """Of a slice's requests the answers: each frequent key's count, to the first block that has it."""
    keys = np.concatenate([exchange.unsqueezed(r["keys"], r["n"]) for r in rows])
    _, first, at = np.unique(keys, return_index=True, return_inverse=True)
    sums = np.bincount(at, exchange.numbers(rows, "first") + 1, len(first)).astype(np.int64)
    often = sums >= least
    told = np.zeros(len(keys), np.int64)
    told[first[often]] = sums[often]
    out, ends = [], np.cumsum([r["n"] for r in rows]).tolist()
    for r, to in zip(rows, ends, strict=True):
        own = told[to - r["n"] : to]
        out.append((r["slice"], r["block"], r["n"], 0, np.packbits(own > 0).tobytes(), exchange.packed(own[own > 0]), b""))
    return out


def _named(row: dict, answers: list[dict]):
    """COUNTS of the phrases that a block has been told the count of; no words at all are a language's words in the block."""
    each, keys, first, _ = _phrases(row)
    told = exchange.flags(answers)
    if len(told) != len(keys):
        raise ValueError(f"{len(told)} answers for {len(keys)} keys")
    hits = [(int(exchange.flags([r]).sum()), r) for r in answers]
    place = first[told]
    total = np.concatenate([exchange.unpacked(r["first"], n).astype(np.int64) for n, r in hits] or [np.zeros(0, np.int64)])
    begin = 0
    for x in each:
        own = (place >= begin) & (place < begin + len(x.keys))
        at, n = place[own] - begin, np.concatenate((total[own], [x.total]))
        begin += len(x.keys)
        words = pa.array(["", *[w.decode("utf-8", "replace") for w in x.codes][1:]])
        columns = [words.take(pa.array(np.concatenate((w[at], [0])))) for w in x.words]
        yield pa.RecordBatch.from_arrays([pa.array([x.lang] * len(n), pa.string()), *columns, pa.array(n, pa.int64())], ["lang", "w1", "w2", "w3", "f"])


def phrase_counts(docs: DataFrame, tables: Workspace, least: int = LEAST) -> DataFrame:
    """COUNTS of all phrases of one to three words with least or more occurrences; rows without words have a language's number of words."""
    stored = exchange.written(docs.select("lang", "text"), "lang", tables)
    n_slices = exchange.slices(docs)
    answers = tables.write(exchange.answered(_requested(stored, n_slices), lambda rows: _frequent(rows, least)), "answers")
    sent = tables.write(exchange.met(stored, answers, _named, COUNTS), "sent")
    tables.drop("blocks", "answers")
    total = sent.where("w1 = ''").groupBy("lang", "w1", "w2", "w3").agg(F.sum("f").alias("f"))
    return sent.where("w1 <> ''").unionByName(total)


def _streamed(counts: DataFrame, order: list[str], tables: Workspace, name: str) -> DataFrame:
    """One pass over the counts in an order of their words (w1 to w3 are those in that order): STREAM.

    one and two are the counts of a phrase's first and first two words; a row without f says how frequent
    the extensions of its two words are at most. A part is a range of the sort.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        at: tuple = (None, None, None)
        one = two = most = None
        for batch in batches:
            out = []
            for lang, a, b, c, f in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if (lang, a) != at[:2]:
                    if most:
                        out.append((part, *at, "", None, None, None, most))
                    at, one, two, most = (lang, a, ""), None, None, None
                if b != at[2]:
                    if most:
                        out.append((part, *at, "", None, None, None, most))
                    at, two, most = (lang, a, b), None, None
                if c:
                    most = max(most or 0, f)
                elif b:
                    two = f
                else:
                    one = f
                out.append((part, lang, a, b, c, f, one, two if b else None, None))
            yield rows_of(out)
        if most:
            yield rows_of([(part, *at, "", None, None, None, most)])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), *[pa.string()] * 4, *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], [c.split()[0] for c in STREAM.split(", ")])

    keys = ["lang", *order]
    laid = counts.repartitionByRange(*keys).sortWithinPartitions(*keys).select("lang", *[F.col(c).alias(f"w{i}") for i, c in enumerate(order, 1)], "f")
    rows = tables.write(laid.mapInArrow(run, STREAM), name)
    # What a part lacks is the same in all its rows: one word and one pair a part.
    lacks = rows.where("f is not null and (one is null or (w3 <> '' and two is null))").select("part", "lang", "w1", F.when((F.col("w3") != "") & F.col("two").isNull(), F.col("w2")).otherwise("").alias("w2"), F.col("one").isNull().alias("no_one"))
    known = rows.where("f is not null and w3 = ''").select("lang", "w1", "w2", F.col("f").alias("g"))
    first = lacks.where("no_one").select("part", "lang", "w1").distinct().withColumn("w2", F.lit(""))
    second = lacks.where("w2 <> ''").select("part", "lang", "w1", "w2").distinct()
    filled = first.unionByName(second).join(known, ["lang", "w1", "w2"]).groupBy("part").agg(F.max(F.when(F.col("w2") == "", F.col("g"))).alias("_one"), F.max(F.when(F.col("w2") != "", F.col("g"))).alias("_two"))
    whole = rows.join(F.broadcast(tables.write(filled, f"{name}-heads")), "part", "left")  # a row per part
    has = lambda c: F.col("f").isNotNull() & (F.col(c) != "")
    return whole.select("lang", "w1", "w2", "w3", "f", F.when(has("w1"), F.coalesce("one", "_one")).alias("one"), F.when(has("w3"), F.coalesce("two", "_two")).alias("two"), "extension")


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a^2 / (left * right)), exactly."""
    exact = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"({exact(a)} * {exact(a)} * cast({SCALE} as decimal(7,0))) div ({exact(left)} * {exact(right)})")


def candidates(counts: DataFrame, tables: Workspace) -> DataFrame:
    """lang, w1, w2, w3, a, l, r, score, extension of the phrases of two and three words in counts."""
    ahead = _streamed(counts.where("w1 <> ''"), ["w1", "w2", "w3"], tables, "prefix")
    # In suffix order the last word comes first: of two words the second, of one the only one.
    last = F.when(F.col("w3") != "", F.col("w3")).when(F.col("w2") != "", F.col("w2")).otherwise(F.col("w1"))
    before = F.when(F.col("w3") != "", F.col("w2")).when(F.col("w2") != "", F.col("w1")).otherwise("")
    behind = _streamed(counts.where("w1 <> ''").select("lang", last.alias("z1"), before.alias("z2"), F.when(F.col("w3") != "", F.col("w1")).otherwise("").alias("z3"), "f"), ["z1", "z2", "z3"], tables, "suffix")
    turned = [F.when(F.col("w3") != "", F.col("w3")).otherwise(F.col("w2")).alias("w1"), F.when(F.col("w3") != "", F.col("w2")).otherwise(F.col("w1")).alias("w2"), F.when(F.col("w3") != "", F.col("w1")).otherwise("").alias("w3")]
    none = F.lit(None).cast("long")
    left = ahead.where("w2 <> ''").select("lang", "w1", "w2", "w3", "f", F.col("one").alias("l1"), F.col("two").alias("l2"), none.alias("r1"), none.alias("r2"), "extension")
    right = behind.where("w2 <> ''").select("lang", *turned, none.alias("f"), none.alias("l1"), none.alias("l2"), F.col("one").alias("r1"), F.col("two").alias("r2"), "extension")
    each = left.unionByName(right).groupBy("lang", "w1", "w2", "w3").agg(*[F.max(c).alias(c) for c in ("f", "l1", "l2", "r1", "r2", "extension")])
    triple = F.col("w3") != ""
    each = each.withColumns({"r": F.when(triple, F.col("r2")).otherwise(F.col("r1"))})
    scored = each.select("lang", "w1", "w2", "w3", F.col("f").alias("a"), "l1", "r", F.when(triple, F.col("l2")).alias("l2"), "r1", "extension", _score("f", "l1", "r").alias("s1"), F.when(triple, _score("f", "l2", "r1")).alias("s2"))
    later = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    pick = lambda a, b, name: F.when(later, F.col(b)).otherwise(F.col(a)).alias(name)
    return scored.select("lang", "w1", "w2", "w3", "a", pick("l1", "l2", "l"), pick("r", "r1", "r"), pick("s1", "s2", "score"), "extension")


def _best(rows: DataFrame, group: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first top phrases."""
    with Workspace(docs.sparkSession, "collocations") as tables:
        counts = phrase_counts(docs, tables, least)
        found = candidates(counts, tables).where(F.col("extension").isNull() | (100 * F.col("extension") < share * F.col("a")))
        phrase = F.concat_ws(" ", *[F.nullif(F.col(w), F.lit("")) for w in ("w1", "w2", "w3")])
        rows = found.select("lang", phrase.alias("phrase"), "a", "l", "r", "score")
        part = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        ranked = _best(_best(part, ["lang", "part"], top).drop("part", "rank"), ["lang"], top)
        total = counts.where("w1 = ''").select("lang", F.col("f").alias("n"))
        return materialise(ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH piece AS (
  SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(part, '[\x20\x09]+'), lambda x: x <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents)
), spot AS (
  SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM piece
), f AS (
  SELECT lang, ws[i : i + k - 1] AS ph, count(*) AS f FROM spot, (VALUES (1), (2), (3)) v(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(ph) = 1 GROUP BY lang
), c AS (
  SELECT lang, ph, f AS a, unnest(generate_series(1, len(ph) - 1)) AS k FROM f WHERE len(ph) > 1 AND f >= 10
), s AS (
  SELECT c.*, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.ph = c.ph[1 : k] JOIN f y ON y.lang = c.lang AND y.ph = c.ph[k + 1 : len(c.ph)]
), cut AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1
), longer AS (
  SELECT lang, part AS ph, max(f) AS most FROM (SELECT lang, unnest([ph[1:2], ph[2:3]]) AS part, f FROM f WHERE len(ph) = 3 AND f >= 10) GROUP BY ALL
), kept AS (
  SELECT cut.* FROM cut LEFT JOIN longer USING (lang, ph) WHERE most IS NULL OR 100 * most < 50 * a
), named AS (
  SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, score FROM kept
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
