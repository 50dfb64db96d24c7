"""Operator 4: placement by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: slot
(offset + k * skip) mod size for k = 0, 1, ... In turns, each shard claims the first slot of
its order that is still free, until none is. A key goes to the shard that holds slot
hash(key) mod size: constant time, even shares (slots per shard differ by one at most), and
few keys move when a shard comes or goes. Weighted shards take several turns a round.

The table's size is a parameter, so the broadcast is bounded whatever the data.
A null key is placed as the empty text; equal keys land together, so repeated rows do; keys of any
length are hashed whole; an empty table gives no rows; columns named slot or shard are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import documents
from gazette.sources.tables import fresh

TABLE_SIZE = 65537
SHARDS = 256


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> list[int]:
    """Slot -> index of its shard."""
    if not is_prime(size) or not 0 < len(shards) <= size:
        raise ValueError("the size must be a prime not below the number of shards")
    if weights is not None and (len(weights) != len(shards) or min(weights) < 0 or not any(weights)):
        raise ValueError("a weight per shard, none below 0 and one above it")
    starts = []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        starts.append((int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:], "big") % (size - 1) + 1))
    table, taken, asked = [-1] * size, 0, [0] * len(shards)
    weights = weights or [1] * len(shards)
    while True:
        for i, (offset, skip) in enumerate(starts):
            for _ in range(weights[i]):
                while table[slot := (offset + asked[i] * skip) % size] >= 0:
                    asked[i] += 1
                table[slot] = i
                asked[i] += 1
                taken += 1
                if taken == size:
                    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The first 60 bits of the key's MD5, modulo the size."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(head, 16, 10).cast("long") % size


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> DataFrame:
    """df with slot and shard (index into shards), in place of columns of these names."""
    table = lookup_table(shards, size, weights)
    rows = df.sparkSession.createDataFrame(list(enumerate(table)), "slot long, shard int")
    (at,) = fresh(df, "at")
    placed = df.withColumn(at, slot_of(F.col(f"`{key}`"), size)).drop("slot", "shard").withColumnRenamed(at, "slot")
    return placed.join(F.broadcast(rows), "slot", "left")


def write_sharded(df: DataFrame, key: str, shards: list[str], path: str, files_per_shard: int = 1, size: int = TABLE_SIZE) -> None:
    """One folder shard=N per shard; files_per_shard spreads each over as many tasks."""
    placed = place(df, key, shards, size)
    (file,) = fresh(placed, "file")
    placed = placed.withColumn(file, F.col("slot") % files_per_shard)
    placed.repartition(len(shards) * files_per_shard, "shard", file).drop("slot", file).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot, its shard, its shard without the last one, and whether that moves it."""
    names = [f"shard-{i:04d}" for i in range(SHARDS)]
    table, less = lookup_table(names), lookup_table(names[:-1])
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(table, less, strict=True))], "slot long, shard int, shard_without_last int")
    docs = documents(spark, sf_dir).select("doc_id", "source", F.length("text").cast("long").alias("n_code_points"), slot_of(F.col("doc_id")).alias("slot"))
    return docs.join(F.broadcast(rows), "slot", "left").select("doc_id", "source", "n_code_points", "slot", "shard", "shard_without_last", (F.col("shard") != F.col("shard_without_last")).alias("moved"))
