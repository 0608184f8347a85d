"""What each of five filters removes, in every order in which they can be applied.

Identical texts are found by partition refinement: rows fall into classes by the number of code points, then by the hash
of one block of the text after another; classes of one row are dropped at each step. The full texts of what survives
are compared. Every row then has a mask of the filters that it fails, and all counts come from the numbers of rows of
each mask: a document is still there before a filter if its mask shares no bit with the filters applied earlier.
Spark expressions only.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

FILTERS = "ABCDE"
GAP = r"[\x20\x09-\x0D]+"
#: Blocks of code points (first, length) that split a class one after another; together they are the whole text.
BLOCKS = ((1, 64), (65, 2048), (2113, 2**31 - 1))
#: Classes of more than 1 / HEAVY of all rows, so fewer than HEAVY, are dealt over DEALS tasks.
HEAVY, DEALS = 1000, 64


def failures(text: Column) -> Column:
    """The bits of filters A to D that a text fails."""
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < 50, 100 * distinct < 65 * n, 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike("[#$%&*|]"))
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))


def _signature(text: Column, seed: int) -> list[Column]:
    """What the steps of the refinement look at, in their order: the length, then the hash of each block."""
    return [F.length(text).alias("s0"), *(F.xxhash64(F.substring(text, *b), F.lit(seed)).alias(f"s{i + 1}") for i, b in enumerate(BLOCKS))]


SIGNATURE = [f"s{i}" for i in range(len(BLOCKS) + 1)]


def _refine(rows: DataFrame) -> DataFrame:
    """(signature, n) of the classes of two rows and more that are left after the last block. rows: with the signature."""
    alive = materialize(rows.groupBy(*SIGNATURE).agg(F.count("*").alias("n")), "signatures")
    for step in range(1, len(SIGNATURE) + 1):
        of = SIGNATURE[:step]
        several = alive.groupBy(*of).agg(F.sum("n").alias("rows")).where("rows > 1").select(*of)
        old, alive = alive, materialize(alive.join(several, of, "left_semi"), f"refined{step}")
        release(old)
    return alive


def _dealt(df: DataFrame, heavy: DataFrame, by: str) -> DataFrame:
    """df with deal, by which the rows of a heavy class fall into DEALS parts."""
    marked = df.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), SIGNATURE, "left")
    return marked.withColumn("deal", F.when(F.col("heavy"), F.pmod(F.xxhash64(by), F.lit(DEALS))).otherwise(F.lit(0).cast("long"))).drop("heavy")


def _everywhere(classes: DataFrame, heavy: DataFrame) -> DataFrame:
    """classes with one row for each deal that rows of it may have."""
    marked = classes.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), SIGNATURE, "left")
    return marked.withColumn("deal", F.explode(F.when(F.col("heavy"), F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))).drop("heavy")


def failing(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, mask, *keep): a row a row of docs, mask the bits of the filters A to E that it fails.

    E: some row of a smaller id has the same text. A null id is neither smaller nor larger than any; rows of one id do
    not fail each other. A null text is empty. Classes that hold one row are never compared. If two different texts
    should agree in length and in all hashes, the refinement is done again with another seed, so the result is exact.
    """
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *(F.col(c).alias(f"k_{c}") for c in keep))
    for seed in itertools.count():
        signed = whole.select("*", *_signature(F.col("_text"), seed))
        rows = materialize(signed.select("doc_id", *(f"k_{c}" for c in keep), failures(F.col("_text")).alias("mask"), *SIGNATURE), "failures")
        classes = _refine(rows)
        total = rows.count()
        heavy = materialize(classes.where(F.col("n") > total / HEAVY).select(*SIGNATURE), "heavy")
        left = _dealt(signed.select("doc_id", "_text", *SIGNATURE), heavy, "doc_id").join(_everywhere(classes.select(*SIGNATURE), heavy), [*SIGNATURE, "deal"], "left_semi")
        texts = left.groupBy(*SIGNATURE, "_text").agg(F.min("doc_id").alias("first"))
        firsts = materialize(texts.groupBy(*SIGNATURE).agg(F.min("first").alias("first"), F.count("*").alias("texts")), "firsts")
        mixed = firsts.where("texts > 1").limit(1).count()
        release(classes)
        if not mixed:
            break
        release(rows, heavy, firsts)
    found = _dealt(rows, heavy, "doc_id").join(_everywhere(firsts.drop("texts"), heavy), [*SIGNATURE, "deal"], "left")
    return found.select("doc_id", (F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).alias("mask"), *(F.col(f"k_{c}").alias(c) for c in keep))


def _steps() -> Column:
    """The steps of all orders: (filter_order, step, bit, before), before the bits of the filters applied earlier."""
    steps = []
    for order in itertools.permutations(range(len(FILTERS))):
        for i, f in enumerate(order):
            steps.append({"filter_order": "".join(FILTERS[x] for x in order), "step": i + 1, "bit": 1 << f, "before": sum(1 << x for x in order[:i])})
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row a part, order and step: what the filter at that step keeps and removes among the documents of the part.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley). A null part is
    the empty string. Identical texts count over the whole table. A document is good (toxic) if any row of labels with
    its id has quality (toxic) 1; null and unknown ids have no label. Repeated rows count each. No rows: an empty result.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = failing(docs.select("doc_id", "text", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")), keep=("part",))
    rows = rows.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    masks = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    every = (1 << len(FILTERS)) - 1

    def clear(what: str) -> Column:
        """By set of filters: how many documents fail none of them."""
        return F.transform(F.sequence(F.lit(0), F.lit(every)), lambda s: F.aggregate(F.filter("masks", lambda m: m["mask"].bitwiseAND(s) == 0), F.lit(0).cast("long"), lambda a, m: a + m[what]))

    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    parts = parts.select("part", *(clear(w).alias(w) for w in ("n", "good", "toxic")))
    rows = parts.select("part", "n", "good", "toxic", F.explode(_steps()).alias("s")).select("part", "n", "good", "toxic", "s.*")
    after = F.col("before") + F.col("bit")
    lost = lambda of: F.get(of, F.col("before")) - F.get(of, after)
    # Filters before one in a random order: each set of i of the other four comes in i! * (4 - i)! of the 120 orders.
    others = F.filter(F.sequence(F.lit(0), F.lit(every)), lambda s: s.bitwiseAND(F.col("bit")) == 0)
    orders = lambda s: F.element_at(F.array(*(F.lit(x).cast("long") for x in (24, 6, 4, 6, 24))), F.bit_count(s) + 1)
    shapley = F.aggregate(others, F.lit(0).cast("long"), lambda a, s: a + orders(s) * (F.get("n", s) - F.get("n", s + F.col("bit"))))
    return rows.select(
        "part", "filter_order", "step", F.get("n", after).alias("kept"), lost("n").alias("removed"), (F.get("n", F.lit(0)) - F.get("n", F.col("bit")) - lost("n")).alias("redundant"),
        (F.get("n", F.lit(every) - F.col("bit")) - F.get("n", F.lit(every))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )
