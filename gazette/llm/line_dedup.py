"""Operator 9: cross-site boilerplate lines.

A line's spread is the number of distinct sites (column source) it stands on. Lines seen on two
sites or more get a HyperLogLog sketch each, merged by aggregation; lines whose estimate is near
the threshold get an exact distinct count. Lines that reach the threshold are boilerplate and
go from the documents, whatever their share of a text. Only copies stay whole, for near-duplicate
removal to judge: texts that stand on several rows, texts all of whose lines are shared, and, of
the documents that have the same COPY_LINES or more distinct shared lines, the one with the
least id, so that the body of near copies isn't lost from all of them.

Lines and texts are compared by 64-bit hashes, lines without white space around them. Two of n
lines have the same hash with odds of n^2 / 2^65: one in a hundred thousand for 20 million
lines, certain for some of the lines of 100 TB, where about one line in ten million shares its
hash with another one.

Blank lines never go. Null texts stay null with no lines; a null source is no site; repeated rows
are copies; an empty table gives no rows; a text is taken line by line, so its length needs no
rule. The result's columns replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import documents
from gazette.sources.tables import Workspace, fresh, join_counted, materialise

MIN_SITES = 8
LG_K = 12
#: Estimates within this share of the threshold are counted exactly: several standard errors of a sketch with LG_K.
MARGIN = 0.25
#: Distinct shared lines from which an equal set of them on several documents may be a copied body.
COPY_LINES = 5


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def _split(text: Column) -> Column:
    return F.split(text, "\n")


def spread_lines(lines: DataFrame, tables: Workspace, min_sites: int = MIN_SITES) -> DataFrame:
    """line and n, its occurrences: the hashes of lines (line, site) on at least min_sites distinct sites."""
    sited = lines.where("site is not null")
    several = tables.write(sited.groupBy("line").agg(F.min("site").alias("low"), F.max("site").alias("high"), F.count("*").alias("n")).where("low < high").select("line", "n"), "several")
    seen = join_counted(sited, several, ["line"], "n", "left_semi")
    estimate = seen.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.count("*").alias("n"))
    sketched = tables.write(estimate.where(F.col("sites") >= min_sites * (1 - MARGIN)), "sketched")
    near = F.col("sites") <= min_sites * (1 + MARGIN)
    doubtful = join_counted(sited, sketched.where(near).select("line", "n"), ["line"], "n", "left_semi")
    exact = doubtful.groupBy("line").agg(F.countDistinct("site").alias("sites"), F.count("*").alias("n")).where(F.col("sites") >= min_sites)
    return sketched.where(~near).select("line", "n").unionByName(exact.select("line", "n"))


def _copies(bad: DataFrame, texts: DataFrame, tables: Workspace) -> DataFrame:
    """bad (row, doc_id, hash, bad) with copy: the text is on several rows, or the first with these shared lines."""
    repeated = tables.write(texts.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    body = tables.write(bad.withColumn("body", F.when(F.size("bad") >= COPY_LINES, F.xxhash64(F.array_sort("bad")))), "bodies")
    first = tables.write(body.where("body is not null").groupBy("body").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    known = join_counted(body, repeated.withColumn("many", F.lit(True)), ["hash"], "n", "left")
    known = join_counted(known, first, ["body"], "n", "left")
    return known.select("doc_id", "hash", "bad", (F.col("many").isNotNull() | F.coalesce(F.col("doc_id") == F.col("first"), F.lit(False))).alias("copy"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, names: tuple[str, str, str, str] = ("_lines", "_spread", "_removed", "_clean")) -> DataFrame:
    """docs with four columns: lines, lines of boilerplate, lines removed, and the text without boilerplate."""
    docs = docs.drop(*names)
    hash_, bad_, copy_ = fresh(docs, "hash", "bad", "copy")
    with Workspace(docs.sparkSession, "line_dedup") as tables:
        keyed = docs.select("doc_id", F.xxhash64("text").alias("hash"), "source", "text").where("text is not null")
        each = keyed.select("doc_id", "hash", F.when(F.col("source").isNotNull(), F.xxhash64("source")).alias("site"), F.explode(_split(F.col("text"))).alias("line"))
        each = each.withColumn("line", _stripped(F.col("line"))).where("line <> ''")
        lines = tables.write(each.select("doc_id", "hash", "site", F.xxhash64("line").alias("line")), "lines")
        spread = tables.write(spread_lines(lines.select("line", "site"), tables, min_sites), "boilerplate")
        found = join_counted(lines, spread, ["line"], "n", "left_semi").groupBy("doc_id", "hash").agg(F.collect_set("line").alias("bad"))
        bad = materialise(_copies(found, keyed.select("hash"), tables), "line_dedup-bad").select("doc_id", F.col("hash").alias(hash_), F.col("bad").alias(bad_), F.col("copy").alias(copy_))
    rows = docs.withColumn(hash_, F.xxhash64("text"))
    joined = rows.alias("k").join(bad.alias("b"), F.col("k.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col(f"k.{hash_}") == F.col(f"b.{hash_}")), "left").select("k.*", bad_, copy_)
    is_bad = lambda line: F.array_contains(bad_, F.xxhash64(_stripped(line)))
    lines, spread, removed, clean = names
    has = F.col(bad_).isNotNull()
    out = joined.withColumn(clean, F.when(has, F.array_join(F.filter(_split(F.col("text")), lambda x: ~is_bad(x)), "\n")))
    goes = has & ~F.col(copy_) & F.col(clean).rlike(r"[^ \t\r\x0b\x0c\n]")
    out = out.withColumns({lines: F.coalesce(F.size(_split(F.col("text"))), F.lit(0)), spread: F.when(has, F.size(F.filter(_split(F.col("text")), is_bad))).otherwise(0)})
    out = out.withColumns({removed: F.when(goes, F.col(spread)).otherwise(0), clean: F.when(goes, F.col(clean)).otherwise(F.col("text"))})
    return out.select(*[f"`{c}`" for c in docs.columns], *[f"`{c}`" for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_boilerplate(documents(spark, sf_dir).select("doc_id", "source", "text"))
    long = lambda c: F.col(c).cast("long")
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(long("_lines")).alias("n_lines"), long("_spread").alias("n_spread"), long("_removed").alias("n_removed"), F.length("_clean").cast("long").alias("clean_chars"), F.md5(F.col("_clean").cast("binary")).alias("clean_md5"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), s AS (
  SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l
), spread AS (
  SELECT line FROM s WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 8
), d AS (
  SELECT s.doc_id, count(*) AS n_lines, count(spread.line) AS n_spread, list_sort(list(DISTINCT spread.line) FILTER (WHERE spread.line IS NOT NULL)) AS body,
    coalesce(string_agg(s.raw, chr(10) ORDER BY s.pos) FILTER (WHERE spread.line IS NULL), '') AS short, count(*) FILTER (WHERE spread.line IS NULL AND s.line <> '') AS own
  FROM s LEFT JOIN spread USING (line) GROUP BY s.doc_id
), j AS (
  SELECT doc_id, text, coalesce(n_lines, 0) AS n_lines, coalesce(n_spread, 0) AS n_spread, short,
    n_spread > 0 AND own > 0 AND count(*) OVER (PARTITION BY text) = 1
      AND NOT (len(body) >= 5 AND count(*) OVER (PARTITION BY body) > 1 AND doc_id = min(doc_id) OVER (PARTITION BY body)) AS goes
  FROM documents LEFT JOIN d USING (doc_id)
)
SELECT doc_id, n_lines, n_spread, CASE WHEN goes THEN n_spread ELSE 0 END AS n_removed,
  length(CASE WHEN goes THEN short ELSE text END) AS clean_chars, md5(CASE WHEN goes THEN short ELSE text END) AS clean_md5
FROM j
"""
