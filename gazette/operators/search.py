"""One index over all feeds, and batches of queries against it.

A search index is a folder of tables, in segments: the rows in index order, and for every run of one to
three characters (gram) the rows that hold it, in pieces of the order, so that a gram of all rows is as many
pieces as there are blocks of rows. append() adds a segment; nothing is read again for it.

A query looks for the rarest gram of its tokens: of tokens of three characters or more their trigrams,
of shorter ones the token itself. Its rows come in rounds, in index order: the first AT_FIRST times k of each set of tokens, then
FURTHER times as many for the sets that still lack k rows in a segment. So a query for a word that every row holds
looks at AT_FIRST times k texts. Equal sets of tokens are looked for once.

search() asks rows a single batch of queries. Up to SCANNED sets of tokens need no index: one pass counts the grams of the
tokens, a second compares each row with the sets whose rarest gram it holds, and every task keeps k rows of a set at most.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.functions import scalars as X
from gazette.operators import grams as G
from gazette.sources.tables import Workspace, join_counted, materialise, shared_folder, shuffles_freed

TOP = 30
FOUND = ("pos", "type", "title", "url", "type_pos", "item_pos")
GRAM = 3
#: Times k rows that a set of tokens looks at in the first round, and times as many in each further one.
AT_FIRST, FURTHER = 4, 4
#: Rows of the order, as a power of two, that a piece of a gram's rows comes from.
BLOCK_BITS = 12
#: Candidates that are sent to the rows instead of meeting them in a shuffle: a few tokens and two numbers each.
SENT = 200_000
#: Rows of answers of a task, about.
DEALT = 500_000
#: Sets of tokens, and characters of theirs, that every task of a scan gets; more than these need an index.
SCANNED, SCANNED_CHARS = 1 << 14, 1 << 22
STORED = ("type", "title", "url", "search_text", "type_pos", "item_pos")
COLUMNS = ("type", "title", "sub", "url", "external", "search_text", "type_pos", "item_pos")


def _part(df: DataFrame, pos: int, kind: str, title: Column, sub: Column, url: Column, text: list[Column], external: Column | None = None) -> DataFrame:
    outside = F.lit(False) if external is None else external
    return df.select(F.lit(kind).alias("type"), title.alias("title"), sub.alias("sub"), url.alias("url"), outside.alias("external"), X.search_text(*text).alias("search_text"), F.lit(pos).cast("long").alias("type_pos"), F.col("row_id").alias("item_pos"))


def build_search_index(feeds: dict[str, DataFrame], pages: DataFrame | None = None) -> DataFrame:
    """feeds: normalised events, officers, committees, districts, resources, meetings; pages: (row_id, title, url, keywords)."""
    c, at = F.col, lambda path, key: F.concat(F.lit(path), X.percent_encode(key))
    parts = []
    if pages is not None:
        parts.append(_part(pages, 0, "page", c("title"), F.lit(""), c("url"), [c("title"), c("keywords")]))
    e, o, k, d, r, m = (feeds[n] for n in ("events", "officers", "committees", "districts", "resources", "meetings"))
    parts += [
        _part(e, 1, "event", c("title"), F.concat(c("start_date"), X.after(c("location"), " · ")), at("#/events/", c("id")), [c("title"), c("description"), c("location"), c("district")]),
        _part(o.where("name <> ''"), 2, "person", c("name"), F.concat(c("position"), X.after(c("district"), " · District ")), F.when(X.present(c("email")), F.concat(F.lit("mailto:"), c("email"))).otherwise("#/officers"), [c("name"), c("position"), c("district")]),
        _part(k, 3, "committee", c("name"), c("purpose"), F.lit("#/service"), [c("name"), c("purpose"), c("chair")]),
        _part(d, 4, "district", F.concat(F.lit("District "), c("number"), X.after(c("name"), " — ")), c("area"), F.lit("#/districts"), [F.lit("district"), c("number"), c("name"), c("area"), c("dcm")]),
        _part(r, 5, "resource", c("title"), c("category"), c("url"), [c("title"), c("description"), c("category")], X.external(c("url"))),
        _part(m, 6, "meeting", c("name"), F.concat(c("day"), F.lit(" "), c("time"), F.lit(" · "), X.default(c("city"), c("address"))), F.lit("#/meetings"), [c("name"), c("day"), c("time"), c("city"), c("address"), F.array_join("types", " ")]),
    ]
    return reduce(DataFrame.unionByName, parts)


def tokens(q: Column) -> Column:
    """without duplicates, which change nothing."""
    return F.array_distinct(F.filter(F.split(F.lower(q), f"{X.SPACE}+"), lambda t: t != ""))


def all_in(text: Column, toks: Column) -> Column:
    return (F.size(toks) > 0) & F.forall(toks, lambda t: F.contains(text, t))


def _first(hits: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("type_pos", "item_pos")
    return hits.withColumn("pos", F.row_number().over(order).cast("long")).where(F.col("pos") <= k)


def scan_search(index: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """Every query against every row of the index: for a few queries."""
    asked = queries.select("query_id", tokens(F.col("q")).alias("toks"))
    return _first(index.join(asked, all_in(F.col("search_text"), F.col("toks"))), k, "query_id").select("query_id", *FOUND)


def _runs(c: Column, n: int) -> Column:
    """Distinct runs of n characters of texts that have as many, as gazette.operators.grams has them."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, F.lit(n))))


def _grams(toks: Column) -> Column:
    """The grams that a row with all the tokens holds."""
    return F.array_distinct(F.flatten(F.transform(toks, lambda t: F.when(F.length(t) >= GRAM, _runs(t, GRAM)).otherwise(F.array(t)))))


def token_sets(queries: DataFrame) -> DataFrame:
    """query_id and toks, the tokens in order; queries without any are left out."""
    return queries.select("query_id", F.array_sort(tokens(F.col("q"))).alias("toks")).where(F.size("toks") > 0)


class SearchIndex:
    """The index in a folder that all executors share; see the top of the file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, rows: DataFrame, path: str, grams: DataFrame | None = None) -> SearchIndex:
        """The rows as segment 0 of a new index; with grams (gram) for these alone, as for a single batch."""
        index = cls(rows.sparkSession, path)
        index._add(rows, 0, grams)
        return index

    def append(self, rows: DataFrame) -> None:
        """More rows, as a segment of their own; a row has its place in the index order wherever it stands."""
        self._add(rows, max(self.segments()) + 1)

    def segments(self) -> list[int]:
        """Those whose tables are all written: what a failed append leaves isn't read."""
        return [r.segment for r in self.spark.read.parquet(f"{self.path}/segments").collect()]  # a row per append

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("segment").isin(self.segments()))

    def _add(self, rows: DataFrame, segment: int, grams: DataFrame | None = None) -> None:
        def write(df: DataFrame, name: str) -> DataFrame:
            to = f"{self.path}/{name}/segment={segment}"
            with shuffles_freed(self.spark):
                df.write.mode("overwrite").parquet(to)
            return self.spark.read.schema(df.schema).parquet(to)

        placed = rows.select(*STORED).repartitionByRange("type_pos", "item_pos").sortWithinPartitions("type_pos", "item_pos").withColumn("at", F.monotonically_increasing_id())
        stored = write(placed, "rows")
        of = G.postings(1 << BLOCK_BITS, tuple(range(1, GRAM + 1)))
        pieces = stored.select("at", "search_text").mapInArrow(of, "gram string, block long, rows array<int>, n long")
        pieces = pieces if grams is None else pieces.join(grams, "gram", "left_semi")
        pieces = write(pieces, "postings")
        write(pieces.groupBy("gram").agg(F.sum("n").alias("n")), "counts")
        write(self.spark.range(1).select(F.lit(0).alias("written")), "segments")

    def search(self, queries: DataFrame, k: int = TOP) -> DataFrame:
        """query_id, pos and the first k rows of the index that hold all of a query's tokens."""
        with Workspace(self.spark, "search") as tables:
            asked = tables.write(token_sets(queries), "asked")
            wanted = tables.write(asked.select("toks").distinct().select("toks", F.explode(_grams(F.col("toks"))).alias("gram")), "wanted")
            often = self.table("counts").join(wanted.select("gram").distinct(), "gram").groupBy("gram").agg(F.sum("n").alias("n"))
            rarest = wanted.join(often, "gram", "left").groupBy("toks").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
            sets = tables.write(rarest.where("r.n > 0").select("toks", F.col("r.gram").alias("gram")), "sets")
            return _answers(asked, _rounds(self, sets, k, tables), k, tables)


def _answers(asked: DataFrame, hits: DataFrame, k: int, tables: Workspace) -> DataFrame:
    """The first k of the hits of its tokens for each of asked; sets of tokens that many queries share are broadcast.

    A small table of queries is one file, but a task writes DEALT rows, not the answers to a file of them.
    """
    first = _first(hits, k, "toks").groupBy("toks").agg(F.collect_list(F.struct(*FOUND)).alias("hits"))
    shared = asked.groupBy("toks").agg(F.count("*").alias("n"))
    dealt = asked.repartition(asked.count() * k // DEALT + 1, "query_id")
    found = join_counted(dealt, tables.write(shared.join(first, "toks"), "first"), ["toks"], "n")
    return materialise(found.select("query_id", F.inline("hits")).select("query_id", *FOUND), "search-hits")


def _rounds(index: SearchIndex, sets: DataFrame, k: int, tables: Workspace) -> DataFrame:
    """toks and the first rows of the index for each of the sets (toks, gram): k of each segment, if there are so many."""
    per_gram = sets.groupBy("gram").agg(F.count("*").alias("sets"))
    before = Window.partitionBy("segment", "gram").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = index.table("postings").select("segment", "gram", "block", "n").join(per_gram, "gram").withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    places = tables.write(places, "places")
    totals = tables.write(places.groupBy("segment", "gram").agg(F.sum("n").alias("total")), "totals")
    pending = tables.write(sets.join(totals, "gram").select("toks", "segment", "gram", "total"), "pending-0")
    pieces = index.table("postings").drop("n")
    rows, found, low, high, turn = index.table("rows"), None, 0, AT_FIRST * k, 0
    while not pending.isEmpty():
        turn += 1
        if turn == 2:  # the pieces of what is left, so that further rounds don't read the others
            pieces = tables.write(pieces.join(pending.select("segment", "gram").distinct(), ["segment", "gram"], "left_semi"), "pieces")
        here = tables.write(places.where((F.col("first") < high) & (F.col("first") + F.col("n") > low)).join(pending.select("segment", "gram").distinct(), ["segment", "gram"], "left_semi"), f"here-{turn}")
        part = pieces.join(F.broadcast(here) if here.count() <= SENT else here, ["segment", "gram", "block"])
        skip = F.greatest(F.lit(low) - F.col("first"), F.lit(0))
        part = part.withColumn("rows", F.slice("rows", (skip + 1).cast("int"), (F.lit(high) - F.col("first") - skip).cast("int")))
        part = part.select("segment", "gram", "sets", F.transform("rows", lambda at: F.col("block") + at).alias("rows"))
        # The pieces of a gram in this round are one row, of at most high - low rows.
        part = part.groupBy("segment", "gram").agg(F.first("sets").alias("sets"), F.flatten(F.collect_list("rows")).alias("rows"))
        asked = join_counted(pending.select("toks", "segment", "gram"), tables.write(part, f"part-{turn}"), ["segment", "gram"], "sets")
        candidates = tables.write(asked.select("toks", "segment", F.explode("rows").alias("at")), f"candidates-{turn}")
        needed = tables.write(candidates.select("segment", "at").distinct(), f"needed-{turn}")
        texts = (rows.join(F.broadcast(needed), ["segment", "at"], "left_semi") if needed.count() <= SENT else rows).join(candidates, ["segment", "at"])
        new = tables.write(texts.where(all_in(F.col("search_text"), F.col("toks"))).select("toks", "segment", *FOUND[1:]), f"hits-{turn}")
        found = new if found is None else found.unionByName(new)
        enough = found.groupBy("toks", "segment").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        pending = tables.write(pending.where(F.col("total") > high).join(enough, ["toks", "segment"], "left_anti"), f"pending-{turn}")
        low, high = high, high * FURTHER
    empty = "toks array<string>, segment int, type string, title string, url string, type_pos long, item_pos long"
    return index.spark.createDataFrame([], empty) if found is None else found


def _scanned(rows: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """toks and a few times the first k rows for each of the sets (toks), SCANNED at most, in two passes over rows."""
    spark, wanted = rows.sparkSession, [(r.toks, r.grams) for r in sets.select("toks", _grams(F.col("toks")).alias("grams")).collect()]
    every = sorted({g for _, of in wanted for g in of})
    counted = rows.select("search_text").mapInArrow(G.counter(every), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")) if every else None
    often = {r.gram: r.n for r in counted.collect()} if every else {}
    chosen = [(i, toks, min(of, key=lambda g: (often[g], g))) for i, (toks, of) in enumerate(wanted) if all(g in often for g in of)]
    if not chosen:
        return spark.createDataFrame([], "toks array<string>, type string, title string, url string, type_pos long, item_pos long")
    hits = rows.select(*STORED).mapInArrow(G.matcher(chosen, k, FOUND[1:]), "set long, type string, title string, url string, type_pos long, item_pos long")
    numbered = spark.createDataFrame([(i, toks) for i, toks, _ in chosen], "set long, toks array<string>")
    return hits.join(F.broadcast(numbered), "set").drop("set")


def search(rows: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """SearchIndex.search() against rows that are asked this once and are read two or three times: no index of few sets of tokens, of more an index for their grams alone."""
    spark = rows.sparkSession
    with Workspace(spark, "search-once") as tables:
        asked = tables.write(token_sets(queries), "asked")
        sets = tables.write(asked.select("toks").distinct(), "sets")
        n, size = sets.agg(F.count("*"), F.coalesce(F.sum(F.length(F.array_join("toks", ""))), F.lit(0))).first()
        if n <= SCANNED and size <= SCANNED_CHARS:
            return _answers(asked, _scanned(rows, sets, k), k, tables)
        grams = tables.write(sets.select(F.explode(_grams(F.col("toks"))).alias("gram")).distinct(), "grams")
        path = f"{shared_folder(spark)}/search-once-{uuid.uuid4().hex}"
        tables.paths["index"] = path
        return SearchIndex.build(rows, path, grams).search(queries, k)
