"""From raw documents to a training mixture: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, mixing, pii, toxicity
from leafmill.llm.common import materialize, table
from leafmill.llm.ngram_join import JaccardJoin

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity below one half; the model learns from the labels of those at hand."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, keep=list(COLUMNS)).where("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that shingle similarity connects, the one of the smallest id (a null id last).

    Rows get a key of their own, so those of a null or repeated id are judged like any other: repeated rows are copies,
    rows of one id and different texts are different documents. Texts without words link with nothing and stay.
    """
    keyed = materialize(docs.select(*COLUMNS).withColumn("key", F.monotonically_increasing_id()), "keyed")
    groups = JaccardJoin(keyed.select(F.col("key").alias("doc_id"), "text")).documents().select(F.col("doc_id").alias("key"), "component_id")
    grouped = materialize(groups.join(keyed.select("key", "doc_id"), "key"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key"))["key"]
    kept = grouped.groupBy("component_id").agg(first.alias("stays"))
    gone = grouped.select("key").join(kept.select(F.col("stays").alias("key")), "key", "left_anti")
    return keyed.join(gone, "key", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item leaks into."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by the kind's name and n_chars counted again."""
    found = pii.find_pii(docs, keep=["doc_id", "lang", "source"], redacted="clean")
    return found.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.length("clean").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the copies of each that the mixture takes."""
    return mixing.mix_sources(docs, keep=list(COLUMNS), share=mixing.LONGER)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_leaks), ("pii", redact_pii), ("mixing", mix)]

#: No stage but the masks of PII could be said in SQL: tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
