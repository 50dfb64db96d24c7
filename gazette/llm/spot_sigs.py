"""Operator 6: SpotSigs fingerprints, with DataFrame functions alone.

Wherever a common word (anchor) stands, the next CHAIN content words after it, other anchors
left out, form a signature. A text's fingerprint is the set of its signatures; texts without
one have a single signature of all their words, so no fingerprint is empty. Likeness is the
Jaccard coefficient of two sets; sets whose sizes alone keep it below a bound needn't be
intersected (likeness(..., at_least)).

near_pairs() finds all similar texts: rows of equal sets are one class, and classes meet only if
their set lengths fall in the same or neighbouring length partitions and they share one of the
rarest signatures of each, at places that leave enough to share; what is left is compared in full.
Where many classes share a rare signature, blocks of their sets meet in tiles, so that a set moves
once a block and not once a pair; all pairs of a crowd are still looked at, since each may be a link.

Null texts count as empty. The next document is the next row by ascending doc_id (nulls first,
equal ids by a hash of the text or, where there are few, by the text), after the last the first;
a single row is its own next. Repeated rows are documents like others. Very long texts are taken
whole; ids may be as sparse as they like. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.llm.common import documents
from gazette.sources.tables import Workspace, join_counted, materialise

# Common words of English, French, German and Spanish that serve as anchors.
ANCHORS = (
    "the of and to in a is that it for on was be with as by this at are from "
    "de la le les et des en que un une der die und das den von zu el y los"
).split()
CHAIN = 2
#: Words after an anchor among which its chain is sought.
REACH = 8
#: About so many documents are put in order together, unless there are more than RANGES such ranges.
WIDTH, RANGES = 256, 1 << 14
NULL_ID = -(2**62)
#: More than FEW sets that meet by one signature do so in tiles of about BLOCK by BLOCK, unless they have more than about TILED signatures.
FEW, BLOCK, TILED = 64, 1024, 512
#: Pairs of sets in tiles that a task looks at, about, unless that makes more than MOST_TASKS tasks.
TASK_PAIRS, MOST_TASKS = 2_000_000, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def signatures(text: Column, chain: int = CHAIN, reach: int = REACH) -> Column:
    """Sorted distinct signature hashes."""

    def of(ws: Column) -> Column:
        content = lambda i: F.slice(F.filter(F.slice(ws, i + 2, reach), lambda w: ~w.isin(ANCHORS)), 1, chain)
        signature = lambda w, c: F.when(F.size(c) == chain, F.xxhash64(w, c))
        spots = F.transform(ws, lambda w, i: F.when(w.isin(ANCHORS), let(content(i), lambda c: signature(w, c))))
        return let(F.array_distinct(F.array_compact(spots)), lambda s: F.when(F.size(s) > 0, F.array_sort(s)).otherwise(F.array(F.xxhash64(ws))))

    return let(words(text), of)


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard coefficient; 0 where the sizes alone keep it below at_least."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    exact = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(low < at_least * high, F.lit(0.0)).otherwise(exact)


def digest(s: Column) -> Column:
    """A set's size and the MD5 of its members in order."""
    return F.concat(F.hex(F.size(s)), F.lit("-"), F.md5(F.array_join(s.cast("array<string>"), ",").cast("binary")))


def _ranges(docs: DataFrame) -> DataFrame:
    """docs with _id, _tie and _range: ranges of about WIDTH rows (RANGES at most) in the order of _id, _tie.

    The bounds are approximate quantiles of the ids, so it doesn't matter how dense they are. An
    id (or no id) that is several quantiles gets as many ranges, by a hash of the text.
    """
    ids = docs.withColumn("_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    n = max(1, min(RANGES, ids.count() // WIDTH))
    cuts = ids.agg(F.percentile_approx("_id", [k / n for k in range(1, n)], max(10_000, 4 * n))).first()[0] if n > 1 else []
    parts: dict[float, tuple[int, int]] = {}  # by what a double tells apart: quantiles at the bound, the bound
    for bound, often in Counter(cuts).items():
        parts[float(bound)] = max(parts.get(float(bound), (0, 0)), (often, bound))
    zero = F.lit(0).cast("long")
    if not parts:
        return ids.withColumns({"_tie": zero, "_range": zero})
    # A place has the ids below the next bound: those under its own bound, those at it in as many parts as it is quantiles, those beyond it.
    rows, base = [(0.0, NULL_ID, 1, 0)], 3
    for place, (_, (often, bound)) in enumerate(sorted(parts.items()), 1):
        rows.append((float(place), bound, often, base))
        base += often + 2
    places = F.broadcast(docs.sparkSession.createDataFrame(rows, "_place double, _bound long, _parts int, _base long"))  # RANGES rows at most
    bucketizer = Bucketizer(splits=[-math.inf, *sorted(parts), math.inf], inputCol="_double", outputCol="_place")
    placed = bucketizer.transform(ids.withColumn("_double", F.col("_id").cast("double"))).join(places, "_place")
    tie = part = zero
    if max(often for often, _ in parts.values()) > 1:
        several = (F.col("_parts") > 1) & (F.col("_id") == F.col("_bound"))
        tie = F.when(several, F.xxhash64("text")).otherwise(0)
        high = F.shiftrightunsigned(F.xxhash64("text").bitwiseXOR(F.lit(-(2**63))), 33)  # 31 bits, in the order of the hash
        part = F.when(several, F.floor(high * F.col("_parts") / F.lit(2.0**31))).otherwise(0)
    where = F.when(F.col("_id") < F.col("_bound"), 0).when(F.col("_id") == F.col("_bound"), part + 1).otherwise(F.col("_parts") + 1)
    return placed.withColumns({"_tie": tie, "_range": (F.col("_base") + where).cast("long")}).drop("_place", "_bound", "_parts", "_base", "_double")


def with_next(docs: DataFrame, add: dict[str, Column]) -> DataFrame:
    """docs with _next_text and, for every column in add, that column and _next_ of it; columns of docs of these names are replaced, _id, _tie, _range, _head and _to dropped.

    Ranges of ids are ordered each for itself; the first row of a range is also copied to the
    range before it. Of each range one key and one text are looked at beyond it.
    """
    rows = _ranges(docs)
    key = F.struct("_id", "_tie")
    heads = sorted((r._range, r.head._id, r.head._tie) for r in rows.groupBy("_range").agg(F.min(key).alias("head")).collect())  # 4 * RANGES rows at most
    if not heads:
        return rows.withColumns(add).withColumns({f"_next_{c}": F.col(c) for c in ("text", *add)}).drop("_id", "_tie", "_range")
    before = docs.sparkSession.createDataFrame([(i, t, heads[k - 1][0]) for k, (_, i, t) in enumerate(heads)], "_id long, _tie long, _to long")
    first = rows.select("_id", "_tie", "text").join(F.broadcast(before), ["_id", "_tie"]).groupBy("_id", "_tie", "_to").agg(F.min("text").alias("text"))
    first = first.select(F.col("_to").alias("_range"), "_id", "_tie", "text", F.lit(True).alias("_head"))
    both = rows.withColumn("_head", F.lit(False)).unionByName(first, allowMissingColumns=True).repartition("_range").withColumns(add)
    order = Window.partitionBy("_range").orderBy("_head", "_id", "_tie", "text")
    return both.withColumns({f"_next_{c}": F.lead(c).over(order) for c in ("text", *add)}).where("not _head").drop("_id", "_tie", "_range", "_head")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and signatures (array of long) of each row."""
    return docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("signatures"))


def _written(df: DataFrame, name: str, tables: Workspace | None) -> DataFrame:
    """A table that goes with tables, or stays for the caller's lazy result."""
    return materialise(df, f"spot-{name}") if tables is None else tables.write(df, name)


def _rows(docs: DataFrame, tables: Workspace | None) -> DataFrame:
    """doc_id, signatures, fingerprint of each row: written, so that texts are read once."""
    return _written(fingerprints(docs).withColumn("fingerprint", digest(F.col("signatures"))), "rows", tables)


def _sets(rows: DataFrame, tables: Workspace | None) -> DataFrame:
    """key, fingerprint, class_id, n (rows), signatures of each class: written, so that keys stay."""
    sets = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"), F.any_value("signatures").alias("signatures"))
    return _written(sets.withColumn("key", F.monotonically_increasing_id()), "classes", tables)


def class_members(docs: DataFrame, tables: Workspace | None = None) -> DataFrame:
    """doc_id, fingerprint (equal for equal sets), class_id (the least doc_id of that fingerprint), signatures.

    A class of null ids alone has a null class_id.
    """
    rows = _rows(docs, tables)
    least = _written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "least", tables)
    return join_counted(rows, least, ["fingerprint"], "n").select("doc_id", "fingerprint", "class_id", "signatures")


def _near(sets: DataFrame, at_least: float, tables: Workspace | None) -> DataFrame:
    """a, b, likeness: the keys of near classes, once a pair; a has the smaller set or, with as many signatures, the lesser key."""
    held = sets.select("key", F.size("signatures").alias("size"), F.explode("signatures").alias("signature"))
    # What one class alone has is shared with none: it takes the first places, and its number says enough.
    known = held.join(held.groupBy("signature").agg(F.count("*").alias("rows")).where("rows > 1"), "signature")
    known = known.groupBy("key", "size").agg(F.array_sort(F.collect_list(F.struct("rows", "signature"))).alias("_all"))
    # Sets with this likeness share one of their rarest size - ceil(at_least * size) + 1 signatures.
    # Partition p + 1 starts where the sets of p's start become too short to be similar.
    partition = lambda size: F.floor(F.log(size) / -math.log(at_least) + 1e-9)
    enough = (F.col("size") - F.ceil(F.col("size") * at_least - 1e-9) + 1).cast("int")
    known = known.select("key", "size", partition("size").alias("part"), F.expr("size - size(_all)").alias("alone"), F.col("_all.signature").alias("set"), enough.alias("enough"))
    known = _written(known.where("enough > alone"), "known", tables)
    index = known.select("key", "size", "alone", "part", F.posexplode(F.expr("slice(set, 1, enough - alone)")).alias("at", "signature"))
    index = index.select("key", "size", "at", F.expr("at + alone").alias("place"), "signature", F.col("part").alias("own"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    met = index.groupBy("signature", "part").agg(F.count("*").alias("shorter"), F.count_if(F.expr("own = part")).alias("longer"))
    index = _written(index.join(met.where("shorter > 1 and longer > 0"), ["signature", "part"]), "index", tables)
    crowd = (F.col("shorter") > FEW) & (F.col("part") <= partition(F.lit(TILED)))

    def sides(rows: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
        of = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("size", "place", *more)]
        return rows.select("part", "signature", F.col("key").alias("a"), *of("a")), rows.where("own = part").select("part", "signature", F.col("key").alias("b"), *of("b"))

    shared = F.least(F.expr("a_size - a_place"), F.expr("b_size - b_place"))
    may_be = F.expr("a_size < b_size or (a_size = b_size and a < b)") & (F.col("a_size") >= at_least * F.col("b_size") - 1e-9) & (shared * (1 + at_least) >= at_least * F.expr("a_size + b_size") - 1e-9)

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select("a", "b", "a_size", "b_size", F.explode(F.array(F.size(F.array_intersect("a_set", "b_set")))).alias("n"))  # as a generator: once a pair
        return pairs.select("a", "b", F.expr("n / (a_size + b_size - n)").alias("likeness")).where(F.col("likeness") >= at_least)

    short, long = sides(index.where(~crowd))
    pairs = short.join(long, ["signature", "part"]).where(may_be).select("a", "b").distinct()
    side = lambda x: known.select(F.col("key").alias(x), F.col("size").alias(f"{x}_size"), F.col("set").alias(f"{x}_set"))
    found = compared(pairs.join(side("a"), "a").join(side("b"), "b"))
    # In a crowd nothing is written down by pair: blocks of sets meet in tiles, and a pair counts where it first meets.
    many = index.where(crowd)
    work = many.where("own = part").agg(F.sum("shorter")).first()[0]
    if not work:
        return found
    blocks = F.ceil(F.col("shorter") / BLOCK).cast("int")
    many = many.join(known.select("key", "set"), "key").withColumns({"mine": F.pmod(F.xxhash64("key"), blocks), "others": F.sequence(F.lit(0), blocks - 1)})
    short, long = sides(many, "at", "set", "mine", "others")
    tasks, tile = min(MOST_TASKS, 2 + work // TASK_PAIRS), ["signature", "part", "i", "j"]
    short = short.withColumns({"i": F.col("a_mine").cast("int"), "j": F.explode("a_others")}).drop("a_mine", "a_others").repartition(tasks, *tile)
    long = long.withColumns({"j": F.col("b_mine").cast("int"), "i": F.explode("b_others")}).drop("b_mine", "b_others").repartition(tasks, *tile)
    first = ~F.arrays_overlap(F.slice("a_set", F.lit(1), F.col("a_at")), F.slice("b_set", F.lit(1), F.col("b_at")))
    return found.unionByName(compared(short.join(long, tile).where(may_be & first))).distinct()


def near_pairs(docs: DataFrame, at_least: float = 0.8, tables: Workspace | None = None) -> DataFrame:
    """a, b, likeness, a_fingerprint, b_fingerprint: classes (by class_id) with a likeness of at_least (over 0, below 1) or more.

    a has the smaller set; with as many signatures, the lesser fingerprint. Copies are not
    expanded: class_members() has them. An empty table gives no rows.
    """
    with Workspace(docs.sparkSession, "spot") as brief:
        sets = _sets(_rows(docs, brief), tables)
    side = lambda x: sets.select(F.col("key").alias(x), F.struct(F.size("signatures").alias("size"), "fingerprint", "class_id").alias(f"_{x}"))
    pairs = _near(sets, at_least, tables).join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.select("likeness", F.array_sort(F.array("_a", "_b")).alias("_"))
    return pairs.select(F.expr("_[0].class_id").alias("a"), F.expr("_[1].class_id").alias("b"), "likeness", F.expr("_[0].fingerprint").alias("a_fingerprint"), F.expr("_[1].fingerprint").alias("b_fingerprint"))


def links(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """doc_id, fingerprint, class_id and n_links, the classes near its own, for each row of docs."""
    with Workspace(docs.sparkSession, "spot") as tables:
        rows = _rows(docs, tables)
        sets = _sets(rows, tables)
        each = _near(sets, at_least, tables).select(F.explode(F.array("a", "b")).alias("key"))
        counts = sets.select("key", "fingerprint", "class_id", "n").join(each.groupBy("key").agg(F.count("*").alias("n_links")), "key", "left").drop("key")
        found = join_counted(rows.drop("signatures"), tables.write(counts, "counts"), ["fingerprint"], "n")
        return materialise(found.select("doc_id", "fingerprint", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "spot-links")


def links_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a likeness of 0.8 or more, by length partitions and pruned Jaccard: each one's class and number of links."""
    return links(documents(spark, sf_dir))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, {"signatures": signatures(F.col("text"))})
    n = F.length("text")
    half = F.expr("length(text) div 2").cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("_next_text", F.lit(1), half)))
    rows = rows.withColumn("_edited_signatures", signatures(F.col("_edited")))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("signatures")).alias("fingerprint"), digest(F.col("_edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("_edited_signatures")).alias("near_edited"), likeness(F.col("signatures"), F.col("_next_signatures")).alias("near_next"),
        F.size("signatures").alias("n_signatures"),
    )
