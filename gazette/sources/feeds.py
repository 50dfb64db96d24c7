"""Named string feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions.scalars import headers, trim
from gazette.sources import csv_ranges

# The columns of the feeds.
FEEDS = {
    "events": "id title category start_date start_time end_date end_time location address district url flyer_url description contact featured",
    "meetings": "name day time address city district types notes",
    "officers": "name position type district email bio sort",
    "committees": "name purpose chair email meeting_schedule icon",
    "districts": "number name area dcm email website meeting_info",
    "resources": "title category url description updated",
    "announcements": "id title body url starts ends priority",
}


def tidy(raw: DataFrame) -> DataFrame:
    """Normalised headers, trimmed strings, no row without a value; row_id, if there, as it is."""
    own = [c for c in raw.columns if c != "row_id"]
    out = raw.toDF(*(f"c{i}" if c in own else c for i, c in enumerate(raw.columns)))
    cells = [c for c in out.columns if c != "row_id"]
    rows = out.select(*[trim(F.col(c).cast("string")).alias(c) for c in cells], *(["row_id"] if len(own) < len(raw.columns) else []))
    rows = rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")) != "" for c in cells], F.lit(False)))
    return rows.toDF(*headers(own), *rows.columns[len(cells) :])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """S1, in as many tasks as the files have ranges; row_id is the place among the records of all files, these by name."""
    return tidy(csv_ranges.read(spark, path))


class FeedCatalog:
    """Feed name -> path. Paths that end in .parquet are read as such, others as CSV."""

    def __init__(self, paths: dict[str, str], on_missing: str = "error"):
        if on_missing not in ("error", "empty"):
            raise ValueError(f"on_missing: {on_missing}")
        self.paths, self.on_missing = dict(paths), on_missing

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.paths:
            raise ValueError(f"no feed {name!r}; there are {sorted(self.paths)}")
        path = self.paths[name]
        try:
            return tidy(spark.read.parquet(path)).withColumn("row_id", F.monotonically_increasing_id()) if path.endswith(".parquet") else read_csv(spark, path)
        except AnalysisException as error:
            if self.on_missing == "error" or error.getCondition() != "PATH_NOT_FOUND":
                raise
            columns = ", ".join(f"{c} string" for c in FEEDS.get(name, "id").split())
            return spark.createDataFrame([], columns + ", row_id long")
