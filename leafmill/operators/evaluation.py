"""Evaluation of several retrievers over one set of questions, vectors reused by content, providers, measured actions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .retrieval import metrics

#: What embedding models of a family want before a document and before a question (fixed values), by a part of the
#: model's name in lower case; the first that fits counts.
PREFIXES = (
    ("nomic", "search_document: ", "search_query: "),
    ("bge", "", "Represent this sentence for searching relevant passages: "),
    ("e5", "passage: ", "query: "),
)


def prefixed(text: Column, model: str, kind: str) -> Column:
    """text as the model wants it; kind: document or query."""
    found = next((p for p in PREFIXES if p[0] in model.lower()), None)
    return F.concat(F.lit(found[1 if kind == "document" else 2]), text) if found else text


def embed_cached(rows: DataFrame, cache: DataFrame, provider, model: str, kind: str = "document", key: str = "chunk_id", text: str = "text", batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """(vectors, fresh): (key, vector) of all rows, and the (model, hash, vector) that the cache lacked, to be added to it.

    A vector belongs to a model and the SHA-256 of what the model is shown, prefix included. Equal texts are shown once;
    provider maps a list of texts to a list of vectors, `batch` at a time, where the rows are. Write fresh before both
    are read, or it is worked out twice. A null text is an empty one.
    """
    shown = prefixed(F.coalesce(F.col(text), F.lit("")), model, kind)
    asked = rows.select(key, shown.alias("_shown")).withColumn("hash", F.sha2("_shown", 256))
    known = cache.where(F.col("model") == model).select("hash", "vector")
    missing = asked.groupBy("hash").agg(F.first("_shown").alias("_shown")).join(known.select("hash"), "hash", "left_anti")

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                some = pdf.iloc[i : i + batch]
                yield pd.DataFrame({"model": model, "hash": some["hash"], "vector": list(provider(some["_shown"].tolist()))})

    fresh = missing.mapInPandas(run, "model string, hash string, vector array<float>")
    return asked.select(key, "hash").join(known.unionByName(fresh.select("hash", "vector")), "hash").select(key, "vector"), fresh


def evaluate(results: dict[str, DataFrame], questions: DataFrame, chunks: DataFrame, hit: Column, query_key: str = "item_id", key: str = "chunk_id", by: str = "type", tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """(scores, per_question) of retrievers, each a frame (query_key, rank, key).

    scores: by retriever and type of question, and over all types (null): n, recalls, mean reciprocal rank, the mean
    tokens read through the hit and of the five best. per_question: rank of the first hit (0: none), tokens_to_hit,
    context_5 and top1, the key of the best result (null: none). hit is a condition over a question's and a chunk's
    columns. All retrievers are joined and grouped in one plan; a question without a result counts as a miss.
    """
    every = None
    for name, r in results.items():
        own = r.select(F.lit(name).alias("retriever"), query_key, "rank", key)
        every = own if every is None else every.unionByName(own)
    asked = questions.crossJoin(F.broadcast(questions.sparkSession.createDataFrame([(n,) for n in results], "retriever string")))  # a row a retriever
    found = every.join(questions, query_key).join(chunks, key).withColumn("_hit", F.coalesce(hit, F.lit(False)))
    read = F.sum(tokens).over(Window.partitionBy("retriever", query_key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    first = F.min(F.when(F.col("_hit"), F.struct("rank", "read")))
    per = found.withColumn("read", read).groupBy("retriever", query_key).agg(
        first.alias("at"), F.sum(F.when(F.col("rank") <= 5, F.col(tokens))).alias("context_5"), F.min_by(key, "rank").alias("top1")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    per = asked.select("retriever", query_key, by).join(per, ["retriever", query_key], "left").select(
        "retriever", query_key, by, zero(F.col("at.rank")).cast("int").alias("rank"), zero(F.col("at.read")).alias("tokens_to_hit"), zero(F.col("context_5")).alias("context_5"), "top1"
    )
    costs = per.rollup("retriever", by).agg(F.round(F.avg(F.when(F.col("rank") > 0, F.col("tokens_to_hit"))), 6).alias("tokens_to_hit"), F.round(F.avg("context_5"), 6).alias("context_5"))
    scores = metrics(per, ["retriever", by])
    both = scores.join(costs, scores["retriever"].eqNullSafe(costs["retriever"]) & scores[by].eqNullSafe(costs[by])).where(scores["retriever"].isNotNull())
    return both.select(scores["retriever"], scores[by], *(c for c in scores.columns if c not in ("retriever", by)), costs["tokens_to_hit"], costs["context_5"]), per


def measured(df: DataFrame, tokens: str = "tokens", name: str = "measured") -> tuple[DataFrame, Observation]:
    """df, and an observation of its rows and tokens that is there once an action on it has run: no pass of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens")), seen


#: Callables that tell something of bytes, by what they tell: captions, recognised text, transcripts, extracted trees.
PROVIDERS: dict[str, Callable[[list[bytes]], list[str | None]]] = {}


def provider(kind: str):
    """Registers a callable that maps a list of bytes to as many texts."""

    def add(f):
        PROVIDERS[kind] = f
        return f

    return add


def provided(rows: DataFrame, kind: str, content: str = "content", batch: int = 16, tries: int = 2) -> DataFrame:
    """rows with told (what the provider of that kind says of their bytes) and error (why it says nothing).

    Equal bytes are shown once, by their SHA-256, whatever rows hold them. A batch that fails is tried again; then its
    members are shown one by one, so that only those that fail have an error. Null bytes have neither.
    """
    tell = PROVIDERS[kind]

    def one(f, some: list[bytes]) -> list[tuple[str | None, str | None]]:
        for left in range(tries - 1, -1, -1):
            try:
                out = f(some)
                if len(out) != len(some):
                    raise ValueError(f"{len(out)} answers to {len(some)} questions")
                return [(x, None) for x in out]
            except Exception as e:  # noqa: BLE001, whatever a provider raises is told in its rows
                if not left:
                    return [pair for x in some for pair in one(f, [x])] if len(some) > 1 else [(None, f"{type(e).__name__}: {e}")]
        return []

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                some = pdf.iloc[i : i + batch]
                told = one(tell, [bytes(x) for x in some["_c"]])
                yield pd.DataFrame({"_h": some["_h"], "told": [t for t, _ in told], "error": [e for _, e in told]})

    hashed = rows.withColumn("_h", F.sha2(F.col(content), 256))
    once = hashed.where(F.col(content).isNotNull()).groupBy("_h").agg(F.first(content).alias("_c"))
    return hashed.join(once.mapInPandas(run, "_h string, told string, error string"), "_h", "left").drop("_h")
