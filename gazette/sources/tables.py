"""Intermediate tables in the folder that all executors share, and joins that hot keys don't stop."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if more than one row in so many has it; there can't be more hot keys than this.
HOT_KEYS = 4096
#: Spark's own setting by which a query's shuffle files go when it ends.
FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session without one (tests) gets a temporary folder; a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a table's job go once the table is written, instead of when the driver next collects garbage."""
    before = spark.conf.get(FREES_SHUFFLES, "false")
    spark.conf.set(FREES_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREES_SHUFFLES, before)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again. The table stays there for the caller."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """Tables that a job needs only while it runs: with Workspace(spark, "job") as w: t = w.write(df, "name")."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.what, self.paths = spark, what, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table of its own, which goes with the workspace or when the name is written again."""
        path = f"{shared_folder(self.spark)}/{self.what}-{name}-{uuid.uuid4().hex}"
        self.paths[path] = path  # so that what a failed job leaves goes too
        with shuffles_freed(self.spark):
            df.write.parquet(path)
        self.drop(name)
        self.paths[name] = self.paths.pop(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                gone = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*list(self.paths))


def join_counted(rows: DataFrame, table: DataFrame, key: list[str], n: str, how: str = "inner") -> DataFrame:
    """rows joined (inner, left_semi or left) on key with table: a row per key, in column n how many of the rows have it.

    Hot keys, HOT_KEYS of them at most whatever the data, are broadcast, so that their rows stay
    where they are; the other keys merge. n itself isn't part of the result. table is read three
    times: it should be a written one.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    is_hot: Column = F.col(n) * HOT_KEYS > total
    hot, cold = table.where(is_hot).drop(n), table.where(~is_hot).drop(n)
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key, "left_semi" if how == "left_semi" else "inner").unionByName(rest.join(cold, key, how))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as keep it apart from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
