"""A corpus pipeline of tobflow.llm operators: each stage reads the Parquet table that the one before it wrote.

Part of the llm subpackage, kept at the top for its callers. Stages work on all that their predecessor kept. Rows are
known by doc_id and a hash of their text, so null and repeated ids are told apart by their texts; rows equal in both
share every decision. Null texts count as empty; texts are taken whole, however long; an empty table passes every
stage; further columns are carried by all but the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tobflow.llm.common import documents, table, without
from tobflow.llm.decontam import contaminated
from tobflow.llm.line_dedup import dedup_lines
from tobflow.llm.near_dup import near_duplicates
from tobflow.llm.packing import pack
from tobflow.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject: all of a score below 0.5, null and empty texts among them."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that line dedup drops; n_chars, where there is one, follows the text.

    A document without dropped lines keeps its text as it is, a null text included.
    """
    out = dedup_lines(docs, carry=True)
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(~F.col("blank"), F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more. Texts without words stay."""
    return without(docs, near_duplicates(docs, shingle=5, percent=80, with_hash=True).where("NOT kept"))


def decontam(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, at its own values or others; texts without words stay."""
    return without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences; a null or empty text is its end id alone."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontam", decontam), ("packing", packing)]

#: SQL cannot express the toxicity and packing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
