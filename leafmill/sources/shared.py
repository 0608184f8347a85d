"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder only where that is unset and there is one process, as in tests."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    d = d or spark.conf.get("leafmill.shared.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("leafmill.shared.dir", d)  # spark.checkpoint.dir cannot be set in a running session
    return d


#: With it Spark removes the shuffle files of an execution when that ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: df written once as Parquet in the shared folder and read again with the same schema. What was
    shuffled for it is removed at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def sorted_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left.join(right, on, how), never by a broadcast. Spark tells sizes by the files, which hold numbers and repeated
    texts in a tenth of their room and arrays before they are exploded, so it would bring far larger sides to the driver."""
    return left.join(right.hint("merge"), on, how)


def dealt(df: DataFrame, key: str, rows: int = 200_000) -> DataFrame:
    """df dealt by its key to as many parts as leave each about so many rows, whatever its size: sorts and windows by the
    key then take no more memory in a task of a larger table. Adaptive execution would join small parts again."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, df.count() // rows + 1), key)
