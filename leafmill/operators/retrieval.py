"""Lexical and dense retrieval, their evaluation, incremental re-indexing and the cost model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(term, key, tf, len): counts are made in a map-side combine before they move."""
    t = chunks.select(key, terms(F.col(text)).alias("t"))
    rows = t.select(key, F.size("t").alias("len"), F.explode("t").alias("term"))
    return rows.groupBy("term", key).agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def term_stats(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25(queries: DataFrame, chunks: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, query_key: str = "item_id", key: str = "chunk_id", text: str = "text", query_block: int = 4096) -> DataFrame:
    """(query_key, rank, key, score): the k best chunks, ties by key; chunks without any term fill up by key at 0.

    Query terms are a set. Chunks stay where they are: query_block queries at a time, a first pass counts in how many
    chunks each of their terms stands, a second adds up the scores of a thousand chunks for all queries of the block in
    a matrix and keeps k of them a query, so what moves is k rows a query and batch. Of chunks without a match the k
    smallest keys are enough to fill any query's list. Scores are rounded to 1e-9 before ranking. A driver and a task hold
    one block of queries' terms.
    """
    spark, parts, own = chunks.sparkSession, [], []
    read = chunks.select(key, terms(F.col(text)).alias("_t"))
    kind, asked_kind = dict(chunks.dtypes)[key], dict(queries.dtypes)[query_key]

    def search(block: list) -> DataFrame:
        words = pa.array(sorted({w for _, ws in block for w in ws}), pa.string())
        place = {w: i for i, w in enumerate(words.to_pylist())}
        pairs = np.array(sorted((place[w], i) for i, (_, ws) in enumerate(block) for w in set(ws)), np.int64).reshape(-1, 2)
        askers = np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, len(words))))
        ids = [q for q, _ in block]

        def found(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Of some chunks their lengths, and (chunk, word, times) of the words that the block asks for, by word."""
            sizes = np.diff(lists.offsets.to_numpy())
            code = pc.index_in(lists.flatten(), words).to_numpy(zero_copy_only=False).astype(float)
            row = np.repeat(np.arange(len(lists)), np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0))
            known = ~np.isnan(code)
            pair, times = np.unique(code[known].astype(np.int64) * len(lists) + row[known], return_counts=True)
            return sizes, pair % max(len(lists), 1), pair // max(len(lists), 1), times

        def count(batches):
            total = np.zeros(len(words) + 3, np.int64)
            for batch in batches:
                sizes, _, word, _ = found(batch.column(1))
                total[: len(words)] += np.bincount(word, minlength=len(words))
                total[len(words) :] += (batch.num_rows, batch.num_rows - batch.column(1).null_count, sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "n"])

        total = np.zeros(len(words) + 3)
        for r in read.mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row a word of the block
            total[r.at] = r.n
        n, some, length = total[len(words) :]
        idf = np.log(1.0 + (n - total[: len(words)] + 0.5) / (total[: len(words)] + 0.5))
        mean = length / some if some else 1.0
        shared = spark.sparkContext.broadcast((askers, idf))

        def score(batches):
            askers, idf = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    sizes, row, word, times = found(batch.column(1))
                    gain = idf[word] * (times * (k1 + 1.0)) / (times + k1 * (1.0 - b + b * sizes[row] / (mean or 1.0)))
                    total = np.zeros((len(ids), batch.num_rows))
                    ends = np.searchsorted(word, np.arange(len(words) + 1))
                    for w in np.flatnonzero(np.diff(ends)):
                        mine = slice(ends[w], ends[w + 1])
                        total[np.ix_(askers[w], row[mine])] += gain[mine]
                    total = np.round(total, 9)
                    order = np.argsort(np.array(batch.column(0).to_pylist(), object), kind="stable")  # by key, so that of equals the first stays
                    total = total[:, order]
                    best = [hits[np.argsort(-t[hits], kind="stable")[:k]] for t in total for hits in (np.flatnonzero(t),)]
                    who, at_ = np.repeat(np.arange(len(ids)), [len(x) for x in best]), np.concatenate([np.zeros(0, np.int64), *best])
                    yield pa.RecordBatch.from_arrays([pa.array(ids, asks).take(pa.array(who)), batch.column(0).take(pa.array(order[at_])), pa.array(total[who, at_])], [query_key, key, "score"])

        asks = pa.int64() if asked_kind in ("bigint", "int", "smallint", "tinyint") else pa.string()
        return read.mapInArrow(score, f"`{query_key}` {'bigint' if asks == pa.int64() else 'string'}, `{key}` {kind}, score double")

    for row in queries.select(query_key, terms(F.coalesce(F.col("text"), F.lit(""))).alias("t")).toLocalIterator():
        own.append((row[0], row[1]))
        if len(own) == query_block:
            parts, own = [*parts, search(own)], []
    parts += [search(own)] if own or not parts else []
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    fill = queries.select(query_key).join(chunks.select(key).orderBy(key).limit(k)).withColumn("score", F.lit(0.0))
    filled = scored.unionByName(fill).groupBy(query_key, key).agg(F.max("score").alias("score"))
    return top(filled.withColumn(query_key, F.col(query_key).cast(asked_kind)), query_key, key, k)


def top(scored: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Rows and queries of one matrix of scores in dense: 4 MB.
ROWS, QUERIES = 2048, 256


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, query_block: int = 4096, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): the k nearest of vectors for each query by cosine in doubles, itself left out.

    A stated set of queries against all rows: ROWS rows at a time and QUERIES queries of a block are one matrix product
    that keeps k rows a query before anything moves. Queries are taken query_block at a time, which bounds the broadcast.
    """
    import pandas as pd

    spark, parts, own = vectors.sparkSession, [], []

    def search(block: list) -> DataFrame:
        ids = np.array([r[0] for r in block])
        q = np.array([r[1] for r in block], float)
        shared = spark.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))

        def run(batches):
            qi, qv = shared.value
            for pdf in batches:
                pdf = pdf[pdf[vector].notna()]
                for at in range(0, len(pdf), ROWS):  # ROWS x QUERIES scores at a time, whatever a batch and a block hold
                    some = pdf.iloc[at : at + ROWS]
                    x = np.array(some[vector].tolist(), float)
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                    vid = some[key].to_numpy()
                    for q in range(0, len(qi), QUERIES):
                        yield nearest(qi[q : q + QUERIES], qv[q : q + QUERIES], vid, x)

        def nearest(ids: np.ndarray, q: np.ndarray, vid: np.ndarray, x: np.ndarray) -> pd.DataFrame:
            s = np.round(q @ x.T, 9)
            s[ids[:, None] == vid[None, :]] = -9
            n = min(k, s.shape[1])
            best = [np.lexsort((vid, -row))[:n] for row in s]
            place, score = np.concatenate(best), np.concatenate([row[b] for row, b in zip(s, best)])
            fine = score > -9
            return pd.DataFrame({"query_id": np.repeat(ids, n)[fine], key: vid[place][fine], "score": score[fine]})

        return vectors.select(key, vector).mapInPandas(run, f"query_id bigint, `{key}` bigint, score double")

    for row in queries.where(F.col(vector).isNotNull()).select(key, vector).toLocalIterator():
        own.append(row)
        if len(own) == query_block:
            parts, own = [*parts, search(own)], []
    parts += [search(own)] if own or not parts else []
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top(out, "query_id", key, k)


def metrics(ranks: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Recall at ks and mean reciprocal rank by each column of by, and over all (null keys); rank 0 or null is a miss."""
    r = F.coalesce("rank", F.lit(0))
    aggs = [F.round(F.avg((r.between(1, k)).cast("double")), 6).alias(f"recall_{k}") for k in ks]
    return ranks.rollup(*by).agg(F.count("*").alias("n"), *aggs, F.round(F.avg(F.when(r > 0, 1.0 / r).otherwise(0.0)), 6).alias("mrr"))


def first_hits(results: DataFrame, query_key: str, hit: Column, tokens: str = "tokens") -> DataFrame:
    """Per query: the rank of the first hit (0: none), the tokens read through it, and those of the five best."""
    w = Window.partitionBy(query_key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    r = results.withColumn("read", F.sum(tokens).over(w)).withColumn("hit", hit)
    first = F.min(F.when(F.col("hit"), F.struct("rank", "read")))
    return r.groupBy(query_key).agg(F.coalesce(first["rank"], F.lit(0)).alias("rank"), F.coalesce(first["read"], F.lit(0)).cast("long").alias("tokens_to_hit"), F.coalesce(F.sum(F.when(F.col("rank") <= 5, F.col(tokens))), F.lit(0)).cast("long").alias("context_5"))


def changed(before: DataFrame, after: DataFrame, key: str = "chunk_id", digest: str = "hash") -> DataFrame:
    """after with status: same, changed or new; and the removed of before."""
    b = before.select(F.col(key).alias("_k"), F.col(digest).alias("_h"))
    out = after.join(b, after[key] == b["_k"], "full_outer")
    status = F.when(F.col(key).isNull(), "removed").when(F.col("_k").isNull(), "new").when(F.col(digest).eqNullSafe(F.col("_h")), "same").otherwise("changed")
    return out.withColumn("status", status).withColumn(key, F.coalesce(key, "_k")).drop("_k", "_h")


def to_embed(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Chunks without a cached vector of this model under the same id and hash."""
    return chunks.join(cache.where(F.col("model") == model).select("chunk_id", "hash"), ["chunk_id", "hash"], "left_anti")


def embed(chunks: DataFrame, provider, dims: int, model: str, text: str = "text", batch: int = 96) -> DataFrame:
    """(chunk_id, hash, model, vector): provider maps a list of texts to a list of vectors, batch at a time."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            vectors = [v for i in range(0, len(pdf), batch) for v in provider(pdf[text].iloc[i : i + batch].tolist())]
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "hash": pdf["hash"], "model": model, "vector": vectors})

    return chunks.select("chunk_id", "hash", text).mapInPandas(run, f"chunk_id {dict(chunks.dtypes)['chunk_id']}, hash string, model string, vector array<float>")


def hashing_provider(dims: int = 64):
    """A deterministic local embedder for tests and offline use: signed word hashes, unit length."""
    import hashlib
    import re

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dims
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dims] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return run


def cost_model(totals: DataFrame, prices: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Every total under every price; prices is a list of a few rows."""
    return totals.join(F.broadcast(prices)).withColumn("usd", F.round(F.col(tokens) * F.col("usd_per_1m_tokens") / 1e6, 6))


def questions(docs: DataFrame, per_doc: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, sentence, answer, word): sentences with a number that is no year, evenly sampled, and their longest
    plain word (the first of equals) as the key of the question."""
    s = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "sentence"))
    s = s.withColumn("answer", F.regexp_extract("sentence", "[0-9]+([.,][0-9]+)*", 0))
    s = s.withColumn("word", F.array_max(F.transform(F.regexp_extract_all("sentence", F.lit("([A-Za-z]{4,})"), F.lit(1)), lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))["w"])
    s = s.where((F.col("answer") != "") & ~F.col("answer").rlike("^(19|20)[0-9]{2}$") & F.col("word").isNotNull())
    w = Window.partitionBy(key)
    s = s.withColumn("i", F.row_number().over(w.orderBy("at")) - 1).withColumn("m", F.count("*").over(w))
    picked = F.transform(F.sequence(F.lit(0), F.least(F.lit(per_doc), F.col("m").cast("int")) - 1), lambda j: F.floor(j * F.col("m") / F.least(F.lit(float(per_doc)), F.col("m"))))
    return s.where(F.array_contains(picked, F.col("i").cast("bigint"))).select(key, F.col("i").cast("int").alias("n"), "sentence", "answer", "word")


#: Numbers of questions, the words that key them, what a number may label, and words that are no key (fixed values).
NUMBER = r"(?<![\w.])(?>(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+|\d{2,})\s?%?)"
KEY_WORD = r"(?<![A-Za-z-])([A-Za-z]{5,9})(?![A-Za-z-])"
LABELS = r"(?i)(?:Figure|Fig\.|Table|Section|Sec\.|Chapter|Appendix|Eq\.|Equation|pages?|pp\.|arXiv:|vol\.|no\.)\s*$"
NO_KEYS = (
    "which", "there", "these", "those", "their", "about", "would", "could", "should", "where", "while", "between", "during", "through", "under", "after", "before", "table", "figure",
    "section", "using", "based", "model", "models", "results", "result", "other", "first", "second", "shows", "shown", "however", "because", "within",
)


def blanked_questions(docs: DataFrame, per_doc: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, question, answer, word): sentences of 8 to 45 words whose first number that is a fact is blanked.

    No facts are years, numbers that a figure, section, page or the like bears, ordinals, numbers that begin a sentence
    and citations in brackets. word is the sentence's longest plain word of 5 to 9 letters, the first of equals, which
    the answer does not hold. Of more than per_doc, per_doc evenly spread ones stay; n is their place among all.
    """
    flat = F.regexp_replace(text, r"\s+", " ")
    s = docs.select(key, F.posexplode(F.split(flat, r"(?<=[.!?])\s+(?=[A-Z(]|\d+(?:\.\d+)*\s+[A-Z])")).alias("at", "s"))
    s = s.where(F.size(F.filter(F.split("s", r"\s+"), lambda w: w != "")).between(8, 45) & ~F.contains(F.col("s"), F.lit("....")) & F.col("s").rlike(r"\d\d|\d\.\d"))
    pair = F.lit(f"((?s).*?)({NUMBER})")
    # Each number with the text between it and the one before; places are the sums of both.
    parts = F.arrays_zip(F.regexp_extract_all("s", pair, F.lit(1)).alias("gap"), F.regexp_extract_all("s", pair, F.lit(2)).alias("num"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<lo:int,hi:int>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        lo = a["end"] + F.length(p["gap"])
        hi = lo + F.length(p["num"])
        return F.struct(hi.alias("end"), F.array_append(a["out"], F.struct(lo.alias("lo"), hi.alias("hi"))).alias("out"))

    def is_fact(p: Column) -> Column:
        head, num, tail = F.substring("s", F.lit(1), p["lo"]), F.substring("s", p["lo"] + 1, p["hi"] - p["lo"]), F.substring("s", p["hi"] + 1, F.length("s"))
        cited = F.rtrim(head).endswith("[") & F.ltrim(tail).startswith("]")
        return ~num.rlike(r"^(19|20)\d\d\s?%?$") & ~head.rlike(LABELS) & ~tail.rlike(r"^\s*(?:th|st|nd|rd)\b") & (F.trim(head) != "") & ~cited

    s = s.withColumn("p", F.get(F.filter(F.aggregate(parts, start, step, lambda a: a["out"]), is_fact), F.lit(0))).where("p is not null")
    s = s.withColumn("answer", F.trim(F.substring("s", F.col("p.lo") + 1, F.col("p.hi") - F.col("p.lo"))))
    words = F.filter(F.regexp_extract_all("s", F.lit(KEY_WORD), F.lit(1)), lambda w: ~F.lower(w).isin(*NO_KEYS) & ~F.contains(F.lower("answer"), F.lower(w)))
    s = s.withColumn("word", F.array_max(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))["w"]).where("word is not null")
    question = F.concat(F.lit("Fill in the blank: "), F.trim(F.concat(F.substring("s", F.lit(1), F.col("p.lo")), F.lit("____"), F.substring("s", F.col("p.hi") + 1, F.length("s")))))
    w = Window.partitionBy(key)
    s = s.withColumn("i", F.row_number().over(w.orderBy("at")) - 1).withColumn("m", F.count("*").over(w).cast("int"))
    kept = F.least(F.lit(per_doc), F.col("m"))
    picked = F.transform(F.sequence(F.lit(0), kept - 1), lambda j: F.floor(j * (F.col("m") / kept)))
    return s.where(F.array_contains(picked, F.col("i").cast("long"))).select(key, F.col("i").cast("int").alias("n"), question.alias("question"), "answer", "word")


def repeated_lines(pages: DataFrame, by: str, page: str, text: str = "text", least: int = 3) -> DataFrame:
    """(by, line, pages): running lines, which stand on at least `least` pages of a group."""
    lines = pages.select(by, page, F.explode(F.split(text, "\n")).alias("line")).where("line <> ''").distinct()
    return lines.groupBy(by, "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)


def without_repeated(pages: DataFrame, by: str, page: str, text: str = "text", least: int = 3) -> DataFrame:
    """pages with running lines and bare page numbers taken out of text."""
    lines = pages.select(by, page, F.posexplode(F.split(text, "\n")).alias("at", "line")).where(~F.col("line").rlike(r"^\s*[0-9]+\s*$"))
    kept = lines.join(repeated_lines(pages, by, page, text, least), [by, "line"], "left_anti")
    joined = kept.groupBy(by, page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda r: r["line"]), "\n").alias(text))
    return pages.drop(text).join(joined, [by, page], "left").withColumn(text, F.coalesce(text, F.lit("")))


def best(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The row of the largest value of each group (of all rows where by is empty), the first by order on ties. Nulls lose."""
    rest = F.struct(*(c for c in rows.columns if c not in by))
    top = rows.groupBy(*by).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(order)).alias("o"), rest.alias("r")))["r"].alias("r"))
    return top.where("r is not null").select(*by, "r.*")


def leaders(rows: DataFrame, tool: str, value: str, order: str, most: int = 3) -> DataFrame:
    """The best configuration of each tool, and of these the `most` best with their rank; ties by order."""
    top = best(rows, [tool], value, order).orderBy(F.desc(value), order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), order)))  # `most` rows


def headline(rows: DataFrame, retriever: str, value: str, order: str, baseline: str = "bm25") -> DataFrame:
    """(retriever, mean): the retriever of the largest mean over all pipelines but the baseline; ties by its first order."""
    mean = rows.where(F.col(retriever) != baseline).groupBy(retriever).agg(F.avg(value).alias("mean"), F.min(order).alias("o"))
    return best(mean, [], "mean", "o").select(retriever, "mean")


def verify(published: DataFrame, fresh: DataFrame, key: str = "pipeline", retriever: str = "retriever", metric: str = "metric", value: str = "value", tolerance: Column | None = None) -> DataFrame:
    """Published figures with this run's and status: ok, differs, skipped (the pipeline ran without that figure) or
    missing (it did not run). tolerance, over the columns of published: 0.0005 for bm25 and 0.02 for all else."""
    tolerance = F.when(F.col(retriever) == "bm25", 0.0005).otherwise(0.02) if tolerance is None else tolerance
    ran = fresh.select(key).distinct().withColumn("_ran", F.lit(True))
    now = fresh.select(key, retriever, metric, F.col(value).alias("fresh"))
    both = published.withColumn("_most", tolerance).join(now, [key, retriever, metric], "left").join(ran, key, "left")
    status = F.when(F.col("_ran").isNull(), "missing").when(F.col("fresh").isNull() | F.col(value).isNull(), "skipped").when(F.abs(F.col(value) - F.col("fresh")) > F.col("_most"), "differs").otherwise("ok")
    return both.withColumn("status", status).drop("_ran", "_most")
