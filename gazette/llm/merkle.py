"""Operator 11: a Merkle manifest of a dataset, with a witness for every row.

A row's leaf is the SHA-256 of its fields. Per source the leaves, by ascending doc_id, are the
lowest level of a tree of fan-out FANOUT: runs of FANOUT nodes (the last may be shorter) become
their hash until one node is left, the source's subroot; the subroots, by source, become the root
likewise. A witness holds a leaf's siblings, level by level.

Leaves are appended as a stream to an Appender, which keeps one open run per level. A leaf begins
with an empty partial witness; when a run is complete (or the stream ends), every witness under it
is extended by the run's siblings and the run's hash is appended to the level above. Aligned
blocks of FANOUT^HEIGHT leaves are streams of their own, wherever they run: their roots are nodes of the
same tree, and are appended like leaves in the next round, a block's size times fewer each time. Witnesses of
the rounds join from the top down, one row per block. No task holds more than a block and the
witness above it, and the driver holds no node.

Positions come from one range sort of digests (no texts) and prefix sums over the ranges.

Defined results: a null field is a "-"; null sources are a source of their own, the first; null
ids come first and are tampered with like the empty text (its crc32 is 0); rows with equal ids go
by their leaves, equal rows have equal leaves at places of their own. Texts are hashed whole. Other
columns aren't looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.llm.common import documents, fold
from gazette.sources.tables import Workspace, join_counted, materialise

FANOUT = 16
#: Levels of a block, which has FANOUT to that power leaves.
HEIGHT = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def sha256(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Appender:
    """An append-only tree: nodes in order, each with its witness so far as [left, right, left, ...] of every finished level."""

    def __init__(self):
        self.witnesses: list[list[str]] = []
        self.open: list[list[tuple[str, int, int]]] = [[]]  # per level: hash, and the first and last leaf below
        self.many = [False]  # per level: whether a run of it is complete

    def append(self, node: str) -> None:
        n = len(self.witnesses)
        self.witnesses.append([])
        self._add(0, (node, n, n + 1))

    def _add(self, level: int, node: tuple[str, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
            self.many.append(False)
        self.open[level].append(node)
        if len(self.open[level]) == FANOUT:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level], self.many[level] = self.open[level], [], True
        digests = [x[0] for x in run]
        for i, (_, low, high) in enumerate(run):
            around = "".join(digests[:i]), "".join(digests[i + 1 :])
            for witness in self.witnesses[low:high]:
                witness.extend(around)
        self._add(level + 1, (sha256(*digests), run[0][1], run[-1][2]))

    def close(self, height: int | None) -> str:
        """Complete what is open, to that height or until one node is left; the root."""
        level = 0
        while level < height if height is not None else self.many[level] or len(self.open[level]) > 1:
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0][0]


def leaf(columns: dict[str, Column]) -> Column:
    """The hash of the fields, each with its length before it."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, columns.values())).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """grp (the source in a form that keeps its order, null first), doc_id, leaf and, where tampering changes it, the tampered leaf."""
    own = {c: F.col(c) for c in FIELDS}
    changed = F.when(fold(F.col("doc_id"), TAMPERED) == 0, F.translate("text", UPPER, UPPER.lower()))
    other = F.when((fold(F.col("doc_id"), TAMPERED) == 0) & (changed != F.col("text")), leaf(own | {"text": changed}))
    group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(group.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf(own).alias("node"), other.alias("tampered"))


def placed(rows: DataFrame, order: list[str], tables: Workspace, name: str) -> DataFrame:
    """rows with pos, the place in the group by order, and n, the group's size: a range sort, then prefix sums of the ranges' counts."""
    keys = ["grp", *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = tables.write(ranged.withColumn("_range", F.shiftright("_at", 33)), f"{name}-sorted")
    parts = ranged.groupBy("_range", "grp").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    inside = Window.partitionBy("grp")
    before = F.coalesce(F.sum("_n").over(inside.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_range", "grp", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(inside).alias("n"))
    return ranged.join(parts, ["_range", "grp"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    at, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["grp"], row["block"]) != at:
                if rows:
                    yield at, rows
                at, rows = (row["grp"], row["block"]), []
            rows.append(row)
    if rows:
        yield at, rows


def _appended(nodes: list[str], n: int, height: int) -> tuple[str, list[list[str]]]:
    """Root and witnesses of a block in a group of n nodes: blocks among others have a fixed height."""
    tree = Appender()
    for node in nodes:
        tree.append(node)
    return tree.close(height if n > FANOUT**height else None), tree.witnesses


def _flushed(out: list[tuple], schema: pa.Schema, every: int = 1) -> Iterator[pa.RecordBatch]:
    if len(out) >= every:
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], schema.types[i]) for i in range(len(schema))], schema=schema)
        out.clear()


def _gathered(rows: DataFrame, height: int) -> DataFrame:
    """A row per aligned block: grp, block, n, its nodes in order, ids, tampered nodes and its root."""
    schema = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("root", pa.string()), ("nodes", pa.list_(pa.string())), ("ids", pa.list_(pa.int64())), ("tampered", pa.list_(pa.string()))])

    def run(batches):
        out: list[tuple] = []
        for (group, block), own in _by_block(batches):
            nodes = [r["node"] for r in own]
            root, _ = _appended(nodes, own[0]["n"], height)
            out.append((group, block, own[0]["n"], root, nodes, [r["doc_id"] for r in own], [r["tampered"] for r in own]))
            yield from _flushed(out, schema, 64)
        yield from _flushed(out, schema)

    dealt = rows.withColumn("block", F.expr(f"pos div {FANOUT**height}")).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    return dealt.select("grp", "block", "n", "node", "doc_id", "tampered").mapInArrow(run, "grp string, block long, n long, root string, nodes array<string>, ids array<long>, tampered array<string>")


def _witnessed(rows: DataFrame, height: int, tables: Workspace, name: str, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """finish(blocks) of the blocks of rows (grp, pos, n, node, doc_id, tampered), each with steps, the witness above it, and top, its group's root."""
    size, nodes = FANOUT**height, lambda x: _node_witnesses(x, height)
    blocks = tables.write(_gathered(rows, height), f"{name}-blocks")
    alone = blocks.where(F.col("n") <= size).withColumns({"steps": F.array().cast("array<string>"), "top": F.col("root")})
    several = blocks.where(F.col("n") > size)
    if several.isEmpty():
        return finish(alone)
    nothing = {"doc_id": F.lit(None).cast("long"), "tampered": F.lit(None).cast("string")}
    further = several.select("grp", F.col("block").alias("pos"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("root").alias("node")).withColumns(nothing)
    above = _witnessed(further, height, tables, f"{name}-up", nodes).withColumnRenamed("pos", "block")
    return finish(alone.unionByName(several.join(above, ["grp", "block"])))


def _node_witnesses(blocks: DataFrame, height: int) -> DataFrame:
    """grp, pos, steps and top of every node."""
    schema = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("steps", pa.list_(pa.string())), ("top", pa.string())])

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                _, witnesses = _appended(r["nodes"], r["n"], height)
                out += [(r["grp"], r["block"] * FANOUT**height + i, w + r["steps"], r["top"]) for i, w in enumerate(witnesses)]
            yield from _flushed(out, schema)

    return blocks.mapInArrow(run, "grp string, pos long, steps array<string>, top string")


def folded(node: str, steps: list[str]) -> str:
    """The root that a node and its siblings lead to."""
    for left, right in zip(steps[::2], steps[1::2], strict=True):
        node = sha256(left, node, right)
    return node


def _verified(blocks: DataFrame, height: int) -> DataFrame:
    """RESULT for the leaves of blocks with steps, top, and those of their source: upper and root."""
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                _, witnesses = _appended(r["nodes"], r["n"], height)
                above = r["steps"] + r["upper"]
                for doc_id, node, tampered, witness in zip(r["ids"], r["nodes"], r["tampered"], witnesses, strict=True):
                    found = folded(tampered or node, witness + above)
                    out.append((doc_id, node, r["top"], r["whole"], sha256(*witness, *above), found, found == r["whole"]))
            yield from _flushed(out, schema)

    return blocks.mapInArrow(run, RESULT)


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """RESULT: a row per document with its leaf, subroot, root, the hash of its witness, and whether its tampered form still leads to the root."""
    with Workspace(docs.sparkSession, "merkle") as tables:
        rows = placed(tables.write(leaves(docs), "leaves"), ["doc_id", "node"], tables, "leaves")
        blocks = tables.write(_witnessed(rows, height, tables, "leaves", lambda x: x), "witnessed")
        sources = tables.write(blocks.groupBy("grp").agg(F.first("top").alias("node"), F.count("*").alias("doc_id")), "sources")
        order = placed(sources.select(F.lit("").alias("grp"), F.col("grp").alias("tampered"), "node", "doc_id"), ["tampered"], tables, "sources")
        order = tables.write(order, "order")
        above = _witnessed(order, height, tables, "sources", lambda x: _node_witnesses(x, height)).select("pos", F.col("steps").alias("upper"), F.col("top").alias("whole"))
        named = order.select("pos", F.col("tampered").alias("grp"), F.col("doc_id").alias("n_blocks")).join(above, "pos").drop("pos")
        return materialise(_verified(join_counted(blocks, tables.write(named, "roots"), ["grp"], "n_blocks"), height), "merkle")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))
