"""The corpus pipeline: toxic documents go, boilerplate lines go, one document of each group of
near duplicates stays, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result
as Parquet in the shared folder, rereads it and deletes it once the next one is written. SQL can't
express the stages, so ORACLE_SQL is None.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import line_dedup, near_dedup, packing, toxicity
from gazette.llm.common import documents
from gazette.sources.tables import Workspace, fresh, materialise

#: Similarity, in per cent, from which the pipeline takes documents for near copies (op2 has its own bound).
NEAR_PERCENT = 80
#: At that similarity 5 links in a billion share no band, 1.3 in ten million fewer than two.
NEAR_BANDS, NEAR_BINS_PER_BAND = 48, 5


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose score reaches the threshold.

    Null texts stay; all documents do if the labels are of one kind only, as nothing can be learned from them.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model.language is None:
        return docs
    (score,) = fresh(docs, "toxicity")
    scored = toxicity.score(docs, model, score)
    return scored.where(F.col("text").isNull() | (F.col(score) < toxicity.THRESHOLD)).select(docs.columns)


def boilerplate_lines_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate, whatever its share unless they are copies; n_chars counted anew."""
    names = fresh(docs, "lines", "spread", "removed", "clean")
    out = line_dedup.remove_boilerplate(docs, names=names).withColumn("text", F.col(names[-1]))
    out = out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
    return out.select(docs.columns)


def one_of_each_group_stays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have a near duplicate with a lesser id; a null id stays.

    Of rows that repeat an id and a text one stays, whichever; texts that differ under one id are one document, and stay or go together.
    """
    gone = near_dedup.near_duplicates(docs, NEAR_PERCENT, NEAR_BANDS, NEAR_BINS_PER_BAND).where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id")
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(left.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("line_dedup", boilerplate_lines_go),
    ("near_dedup", one_of_each_group_stays),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    with Workspace(spark, "pipeline") as tables:
        for k, (name, stage) in enumerate(STAGES[:-1]):
            docs = tables.write(stage(spark, docs, sf_dir), name)
            if k:
                tables.drop(STAGES[k - 1][0])
        name, stage = STAGES[-1]
        return materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
