"""Incremental ingest as a stream of files: each batch appends the chunks that are new or changed.

State is a table of (key, hash, tokens, batch); a replayed batch writes the same folder again, so results are the same
after a failure. The latest batch of a key is its current state.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import content_hash, tokens
from ..sources.shared import shared_dir


def current(spark: SparkSession, state: str) -> DataFrame:
    rows = spark.read.schema("doc_id bigint, hash string, tokens bigint, batch bigint").parquet(f"{state}/batch=*")
    w = Window.partitionBy("doc_id").orderBy(F.desc("batch"))
    return rows.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def ingest(source: DataFrame, state: str, checkpoint: str):
    """A streaming query over source (doc_id, text): per batch, an anti-join on id and hash, then one folder written."""
    spark = source.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("doc_id", content_hash(F.col("text")).alias("hash"), tokens(F.col("text")).alias("tokens"))
        if number:
            known = current(spark, state).where(F.col("batch") < number)
            rows = rows.join(known.select("doc_id", "hash"), ["doc_id", "hash"], "left_anti")
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """All files of the table that are there now, in batches; the state after them."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/{table}*.parquet")
    state = f"{shared_dir(spark)}/leafmill/stream-{uuid.uuid4().hex}"
    ingest(source, f"{state}/rows", f"{state}/checkpoint").awaitTermination()
    return current(spark, f"{state}/rows").select("doc_id", "hash", "tokens")


def sliding_counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    """Counts and sums by event type over sliding windows of event time; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


#: Groups that the documents of a stream are dealt to; a checkpoint belongs to one number of them.
GROUPS = 1 << 12

CHANGES = "doc_id long, version long, chunk_id string, hash string, status string"


def chunk_changes(chunks: DataFrame, groups: int = GROUPS) -> DataFrame:
    """A stream (doc_id, version, chunk_id, hash) of documents, each version as all of its chunks, as a stream of what
    changes: (doc_id, version, chunk_id, hash, status), status new, changed or removed.

    The state of a document is its version and the hashes of its chunks, so no batch reads what others wrote. Documents
    are dealt to groups whose states are kept together, as Python is called once a group: a batch reads and writes the
    states of the groups it touches. Chunks that a version lacks are removed; a version whose only row has a null chunk_id
    removes the document. Versions that are no newer than the state's change nothing, so a version that is sent again is
    harmless; of several in one batch each is compared with the one before. All rows of a version come in one batch.
    """

    def diff(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        docs: dict[int | None, tuple[int, dict[str, str]]] = {}
        if state.exists:
            ids, versions, sizes, held, hashes = state.get
            pairs = zip(held, hashes)
            for doc, at, size in zip(ids, versions, sizes):
                docs[doc] = at, dict(islice(pairs, size))
        came: dict[tuple[int | None, int], list[tuple[str, str]]] = {}
        for f in frames:
            for doc, null, version, chunk, value in zip(*(f[c].tolist() for c in ("doc_id", "unnamed", "version", "chunk_id", "hash"))):
                own = came.setdefault((None if null else doc, version), [])
                if isinstance(chunk, str):
                    own.append((chunk, value))
        out = []
        for (doc, version), own in sorted(came.items(), key=lambda x: x[0][1]):
            at, known = docs.get(doc, (-1, {}))
            if version <= at:
                continue
            now = dict(sorted(own, key=str))
            out += [(doc, version, c, h, "changed" if c in known else "new") for c, h in now.items() if known.get(c) != h]
            out += [(doc, version, c, None, "removed") for c in known if c not in now]
            docs[doc] = version, now
        chunks = [x for _, x in docs.values()]
        state.update((list(docs), [v for v, _ in docs.values()], [len(x) for x in chunks], [c for x in chunks for c in x], [h for x in chunks for h in x.values()]))
        found = dict(zip((c.split()[0] for c in CHANGES.split(", ")), map(list, zip(*out))))
        if found:  # a list of ids with a null among them would become floats
            yield pd.DataFrame(found | {"doc_id": pd.array(found["doc_id"], "Int64")})

    keyed = chunks.where("version is not null").withColumn("group", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    keyed = keyed.select("group", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("unnamed"), "version", "chunk_id", "hash")
    kept = "ids array<long>, versions array<long>, sizes array<int>, chunks array<string>, hashes array<string>"
    return keyed.groupBy("group").applyInPandasWithState(diff, CHANGES, kept, "append", GroupStateTimeout.NoTimeout)


def follow(chunks: DataFrame, folder: str, checkpoint: str, groups: int = GROUPS):
    """A streaming query that writes the changes of each batch to a folder of its own, replaced when a batch is replayed."""
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
    return chunk_changes(chunks, groups).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, version, chunk_id, hash): the chunks there are after all changes; the last change of each tells."""
    rows = spark.read.schema(CHANGES).parquet(f"{folder}/batch=*")
    last = F.max_by(F.struct("version", "hash", "status"), "version")
    now = rows.groupBy("doc_id", "chunk_id").agg(last.alias("l")).where("l.status != 'removed'")
    return now.select("doc_id", "l.version", "chunk_id", "l.hash")


def compact(spark: SparkSession, folder: str, into: str) -> DataFrame:
    """The chunks there are, written as the first batch of another folder, where later batches may follow: what has been
    removed or replaced takes no room there."""
    latest(spark, folder).withColumn("status", F.lit("new")).select(*(c.split()[0] for c in CHANGES.split(", "))).write.mode("overwrite").parquet(f"{into}/batch=-1")
    return latest(spark, into)
