"""Operator 2: near-duplicate documents by one-permutation MinHash.

A document's set is its distinct five-word shingles (64-bit hashes), or its whole word sequence
if it has fewer words. One pass hashes every shingle once; a bin keeps the least hash of its
share of the hash space, and empty bins borrow from bins that a fixed sequence of universal
hashes points to (optimal densification). Bands of bins are bucket keys.

Documents with equal sets are one class. Classes that share a bucket are compared with one
member of it, the star's centre, which differs from bucket to bucket, so the pairs are at most
classes times bands. First each class is compared with the centre it shares most buckets with;
then only pairs whose components still differ.

What is left are buckets whose members, without the centre that has met them all, are still in
several components. In each, those outside its commonest component are compared with all members
of other components, in tiles of at most TILE by TILE sets; no pairs are emitted. Members of
buckets larger than LARGE (texts that share a common passage and little else, or a large group of
loose copies) are compared in smaller groups instead: those that share one of the rarest shingles
of each, of which similar sets share at least one. So every link of documents that share a bucket
is found, whatever the bucket's size; at a similarity of 0.85, 3 pairs in ten million share none.
Unlike texts that share a passage cost no comparison, as their rarest shingles are their own;
members of one group that are near, but not near enough to be linked, cost one each.
Every link is confirmed on the full sets.

Hashes: two of n different shingles are taken for one with odds of n^2 / 2^65. Sets of documents
hold some thousand each, and a single such pair moves a similarity by a thousandth.

Defined results: null texts and texts without words have size 0, are their own component and
kept; rows that repeat a doc_id are one document and link what they are linked with; repeated
rows have equal results; a null doc_id has a null component and is kept; ties need no rule, as
the component is the least doc_id. An empty table gives no rows. Long texts are taken whole, one
in a block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import documents, hashed_words, mix, text_blocks
from gazette.sources.tables import Workspace, join_counted, materialise

WORDS, PERCENT = 5, 85
BANDS, BINS_PER_BAND = 32, 6
ATTEMPTS = 512
#: Sets on either side of a tile, and their shingles together.
TILE, TILE_SHINGLES = 256, 1 << 19
#: Members of a mixed bucket beyond which they are grouped by rare shingles.
LARGE = 64
#: Slots by which shingles are counted to tell rare ones: 4 MB that every task gets.
SLOTS = 1 << 20
#: Members that are compared with one copy of their centre.
MEMBERS = 64
_A = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    word, per = hashed_words(texts)
    run = mix(word + np.uint64(7))
    runs = [run]
    for k in range(1, words):
        run = mix(runs[-1][:-1] * _A + word[k:] + np.uint64(k)) if len(runs[-1]) else runs[-1]
        runs.append(run)
    out, at = [], 0
    for n in per.tolist():
        if n >= words:
            out.append(np.unique(runs[-1][at : at + n - words + 1]))
        else:
            out.append(runs[n - 1][at : at + 1] if n else np.zeros(0, np.uint64))
        at += n
    return out


def _donors(bins: int) -> np.ndarray:
    """attempt x bin -> the bin to borrow from."""
    i, j = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(ATTEMPTS, dtype=np.uint64))
    return (mix(i * _A + mix(j + np.uint64(1))) % np.uint64(bins)).astype(np.int64)


def signatures(sets: list[np.ndarray], bands: int = BANDS, per_band: int = BINS_PER_BAND, donors: np.ndarray | None = None) -> np.ndarray:
    """Band keys (int64) of non-empty sets, one row each."""
    bins = bands * per_band
    donors = _donors(bins) if donors is None else donors
    least = np.zeros((len(sets), bins), np.uint64)
    for row, own in zip(least, sets, strict=True):
        place = ((own >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))  # sorted hashes: the least of a bin comes first
        full = np.zeros(bins, bool)
        full[place[first]] = True
        row[place[first]] = own[first]
        empty = np.flatnonzero(~full)
        for donor in donors:
            if not len(empty):
                break
            from_bin = donor[empty]
            found = full[from_bin]
            row[empty[found]] = row[from_bin[found]]
            empty = empty[~found]
        if len(empty):
            row[empty] = own[0]
    keys = np.tile(np.arange(bands, dtype=np.uint64), (len(sets), 1))
    for k in range(per_band):
        keys = mix(keys * _A + least.reshape(len(sets), bands, per_band)[:, :, k])
    return keys.view(np.int64)


def _described(docs: DataFrame, n_bands: int, per_band: int) -> DataFrame:
    """doc_id, set size, 128-bit set digest and band keys of each row."""

    def run(batches):
        donors = _donors(n_bands * per_band)
        for values, rows in text_blocks(batches):
            sets = shingle_sets(values)
            keys = iter(signatures([s for s in sets if len(s)], n_bands, per_band, donors))
            bands = [next(keys) if len(s) else np.zeros(0, np.int64) for s in sets]
            digest = lambda c: pa.array(np.array([mix(s ^ np.uint64(c)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), digest(0x1234567), digest(0xABCDEF0123456789), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, tables: Workspace) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough.

    The texts of up to MEMBERS members meet one copy of their centre's, in sorted order, so a task
    holds the sets of one centre and one block of texts.
    """
    sizes = tables.write(pairs.groupBy("a").agg(F.count("*").alias("n"), F.ceil(F.count("*") / MEMBERS).alias("parts")), "parts")
    salted = join_counted(pairs, sizes, ["a"], "n").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    members = salted.join(texts, salted["b"] == texts["doc_id"]).select("a", "part", "b", "text")
    centres = salted.select("a", "part").distinct().join(texts, F.col("a") == F.col("doc_id")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    together = centres.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        centre, sets = None, []
        for values, rows in text_blocks(batches, "text"):
            a_col, p_col, b_col = (rows.column(i).to_pylist() for i in range(3))
            linked = []
            for a, part, b, own in zip(a_col, p_col, b_col, shingle_sets(values), strict=True):
                if (a, part) != centre:
                    centre, sets = (a, part), []
                if b is None:
                    sets.append(own)
                    continue
                for other in sets:
                    low, high = sorted((len(own), len(other)))
                    if 100 * low < percent * high:
                        continue
                    same = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * same >= percent * (low + high - same):
                        linked.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in linked], pa.int64()) for i in (0, 1)], ["a", "b"])

    return together.mapInArrow(run, "a long, b long")


def components(links: DataFrame, tables: Workspace | None = None) -> DataFrame:
    """node -> label, the least node reachable over the links (a, b), for nodes with links.

    Labels sink to the least of the neighbours' and then to their label's label, until none changes.
    """
    if tables is None:
        with Workspace(links.sparkSession, "components") as own:
            return materialise(components(links, own), "components")
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    edges = tables.write(both, "edges")
    moved = tables.write(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("next")).withColumnRenamed("a", "node"), "sinking")
    while True:
        labels = moved.select("node", F.col("next").alias("label"))
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("further"))
        moved = tables.write(lower.join(jump, "next").select("node", "label", F.least("next", "further").alias("next")), "sinking")
        if moved.where("label <> next").isEmpty():
            return moved.select("node", "label")


def _labelled(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs with la and lb, their components so far; only those that differ."""
    if labels is None:
        return pairs.withColumns({"la": F.col("a"), "lb": F.col("b")})
    for side in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"_{side}")), side, "left").withColumn(f"l{side}", F.coalesce(f"_{side}", side)).drop(f"_{side}")
    return pairs.where("la <> lb")


def _merged(labels: DataFrame | None, links: DataFrame, tables: Workspace) -> DataFrame:
    """Labels after more links: components of the components."""
    over = components(_labelled(links, labels).select(F.col("la").alias("a"), F.col("lb").alias("b")), tables)
    if labels is None:
        return tables.write(over, "labels")
    both = labels.join(over.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    alone = over.join(labels.select("node"), "node", "left_anti")
    return tables.write(both.unionByName(alone), "labels")


def _mixed(members: DataFrame, labels: DataFrame, tables: Workspace, name: str) -> DataFrame:
    """The members (key, rep, size) with their labels and their key's number of members, of keys whose members have several labels."""
    known = members.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    keys = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high")
    keys = tables.write(keys.select("key", "n", F.col("n").alias("members")), f"{name}-keys")
    return tables.write(join_counted(known, keys, ["key"], "n").select("key", "rep", "size", "label", "members"), name)


def _by_rare_shingles(sets: DataFrame, texts: DataFrame, percent: int, tables: Workspace) -> DataFrame:
    """The sets (rep, size) under each of their rarest shingles (key), so many that similar sets share one at least.

    Any order of all shingles would do, as sets with a similarity of percent share one of the
    first size - ceil(size * percent / 100) + 1; this one goes by how many shingles of all these
    sets fall in the same of SLOTS slots, then by hash. A passage in g sets comes last once g
    stands out among the shingles per slot, which is beyond a few times their square root.
    """
    chosen = texts.join(sets.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    slot = lambda own: (own >> np.uint64(20) & np.uint64(SLOTS - 1)).astype(np.int64)

    def every(batches):
        for values, _ in text_blocks(batches):
            slots, n = np.unique(slot(np.concatenate(shingle_sets(values))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(n.astype(np.int64))], ["slot", "n"])

    found = chosen.select("text").mapInArrow(every, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    counts = np.zeros(SLOTS, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))

    def rarest(batches):
        for values, rows in text_blocks(batches):
            keys, of, sizes = [], [], []
            for rep, own in zip(rows.column(0).to_pylist(), shingle_sets(values), strict=True):
                first = own[np.lexsort((own, shared.value[slot(own)]))][: len(own) - -(-len(own) * percent // 100) + 1]
                keys.append(first)
                of += [rep] * len(first)
                sizes += [len(own)] * len(first)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(of, pa.int64()), pa.array(sizes, pa.int64())], ["key", "rep", "size"])

    out = tables.write(chosen.mapInArrow(rarest, "key long, rep long, size long"), "rarest")
    shared.destroy()
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """left x right -> intersection sizes of sorted sets without repeats."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    sides = []
    for sets in (left, right):
        row, flat = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        known = np.isin(flat, common)
        sides.append((row[known], np.searchsorted(common, flat[known])))
    for at in range(0, len(common), columns):
        a, b = (np.zeros((len(x), min(columns, len(common) - at)), np.float32) for x in (left, right))
        for dense, (row, col) in ((a, sides[0]), (b, sides[1])):
            here = (col >= at) & (col < at + columns)
            dense[row[here], col[here] - at] = 1
        out += a @ b.T
    return out


def _tile_links(tile: list[tuple], percent: int) -> list[tuple[int, int]]:
    """(query, member) of one tile's rows (rep, label, is_query, set), if of different labels and similar enough."""
    asked, others = [x for x in tile if x[2]], [x for x in tile if not x[2]]
    if not asked or not others:
        return []
    same = overlaps([x[3] for x in asked], [x[3] for x in others])
    union = np.array([len(x[3]) for x in asked])[:, None] + np.array([len(x[3]) for x in others]) - same
    differ = np.array([x[1] for x in asked])[:, None] != np.array([x[1] for x in others])
    return [(asked[i][0], others[j][0]) for i, j in zip(*np.nonzero(differ & (100 * same >= percent * union)), strict=True)]


def _tiled(members: DataFrame, texts: DataFrame, percent: int, tables: Workspace) -> DataFrame:
    """Links (a, b) between members (key, rep, size, label) of a key that have different labels.

    A key's members outside its commonest label meet all its members, tile by tile. Tiles are
    dealt out on their own, so no task holds a large key.
    """
    labels = members.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    parts = lambda n, shingles: F.ceil(F.greatest(n / TILE, shingles / TILE_SHINGLES)).cast("int")
    keys = labels.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("commonest"), F.max(F.struct("n", "label", "shingles")).alias("most"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"))
    keys = keys.where(F.col("most.n") < F.col("n")).select("key", "commonest", parts(F.col("n") - F.col("most.n"), F.col("shingles") - F.col("most.shingles")).alias("asked_parts"), parts(F.col("n"), F.col("shingles")).alias("parts"), "n")
    placed = join_counted(members, tables.write(keys, "tiles"), ["key"], "n")
    own = lambda n: F.pmod(F.xxhash64("rep", "key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = placed.where("label <> commonest").select("key", own("asked_parts").alias("i"), every("parts").alias("j"), "rep", "label", F.lit(True).alias("asks"))
    others = placed.select("key", every("asked_parts").alias("i"), own("parts").alias("j"), "rep", "label", F.lit(False).alias("asks"))
    rows = asked.unionByName(others).join(texts.withColumnRenamed("doc_id", "rep"), "rep").select("key", "i", "j", "rep", "label", "asks", "text")
    tiles = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        at, tile = None, []
        for values, rows in text_blocks(batches):
            key, i, j, rep, label, asks = (rows.column(c).to_pylist() for c in range(6))
            linked = []
            for place, *row in zip(zip(key, i, j, strict=True), rep, label, asks, shingle_sets(values), strict=True):
                if place != at:
                    linked += _tile_links(tile, percent)
                    at, tile = place, []
                tile.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in linked], pa.int64()) for c in (0, 1)], ["a", "b"])
        linked = _tile_links(tile, percent)
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in linked], pa.int64()) for c in (0, 1)], ["a", "b"])

    return tiles.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, per_band: int = BINS_PER_BAND) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    with Workspace(docs.sparkSession, "near_dedup") as tables:
        rows = tables.write(_described(docs, bands, per_band), "signatures")
        real = rows.where("doc_id is not null and n_shingles > 0")
        classes = tables.write(real.groupBy("n_shingles", "d1", "d2").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
        labels = _linked_classes(docs, classes, percent, tables)
        named = classes.select("n_shingles", "d1", "d2", "rep", "copies").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep")).drop("rep")
        out = join_counted(rows.drop("bands"), tables.write(named, "named"), ["n_shingles", "d1", "d2"], "copies", "left")
        # Rows with one id are one document.
        named_ids = out.where("label is not null and doc_id is not null").select("doc_id", "label")
        ids = tables.write(named_ids.groupBy("doc_id").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n")).where("a < b").select("doc_id", "a", "n"), "repeated")
        if not ids.isEmpty():
            same = join_counted(named_ids, ids, ["doc_id"], "n").where("a < label").select("a", F.col("label").alias("b"))
            over = components(same, tables)
            out = out.join(over.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").withColumn("label", F.coalesce("new", "label"))
        component = F.when(F.col("n_shingles") > 0, F.coalesce("label", "doc_id")).otherwise(F.col("doc_id"))
        out = out.select("doc_id", "n_shingles", component.alias("component_id"))
        return materialise(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near_dedup")


def _linked_classes(docs: DataFrame, classes: DataFrame, percent: int, tables: Workspace) -> DataFrame:
    """node -> label over the links between classes, by their reps."""
    banded = classes.select("rep", F.col("n_shingles").alias("size"), F.explode("bands").alias("key"))
    # XOR with the key orders each bucket's members differently and gives the centre back from the least.
    place = F.col("rep").bitwiseXOR(F.xxhash64("key").bitwiseAND(F.lit(2**62 - 1)))
    centre = F.min(F.struct(place.alias("place"), F.col("rep").alias("centre"), F.col("size").alias("centre_size")))
    buckets = tables.write(banded.groupBy("key").agg(F.count("*").alias("n"), centre.alias("c")).where("n > 1").select("key", "n", "c.centre", "c.centre_size"), "buckets")
    members = tables.write(join_counted(banded, buckets, ["key"], "n"), "members")
    tables.drop("buckets")
    # Sets whose sizes alone keep them apart needn't be compared.
    fit = f"100 * least(size, centre_size) >= {percent} * greatest(size, centre_size)"
    pairs = tables.write(members.where("rep <> centre").where(fit).groupBy(F.col("centre").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("shared")), "pairs")
    best = pairs.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    tested = tables.write(best, "tested")
    # The ids grow with the data, so they are merged, not broadcast; the texts are shuffled this once.
    texts = tables.write(docs.select("doc_id", "text").join(members.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "candidates")
    labels = _merged(None, tables.write(_confirmed(tested, texts, percent, tables), "links"), tables)
    fresh = tables.write(_labelled(pairs.select("a", "b"), labels).select("a", "b").join(tested, ["a", "b"], "left_anti"), "fresh")
    labels = _merged(labels, tables.write(_confirmed(fresh, texts, percent, tables), "links"), tables)
    mixed = _mixed(members.where("rep <> centre").select("key", "rep", "size"), labels, tables, "mixed")
    tables.drop("members", "pairs", "tested", "fresh")
    small, large = mixed.where(F.col("members") <= LARGE), mixed.where(F.col("members") > LARGE)
    if not small.isEmpty():
        labels = _merged(labels, tables.write(_tiled(small, texts, percent, tables), "links"), tables)
    if not large.isEmpty():
        rare = _mixed(_by_rare_shingles(large.select("rep", "size").distinct(), texts, percent, tables), labels, tables, "rare")
        if not rare.isEmpty():
            labels = _merged(labels, tables.write(_tiled(rare, texts, percent, tables), "links"), tables)
    return labels


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
