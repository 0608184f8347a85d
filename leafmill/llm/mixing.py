"""Mixing sources to target weights: certain whole copies, then Pareto order sampling of the remainder.

Everything is a Spark expression. A document of inclusion odds p / (1 - p) has rank (u / (1 - u)) / (p / (1 - p)),
u a hash of the document; the smallest ranks are taken until their words fill what the whole copies leave of the
target. Rows never move: what a row needs to know of its source is a few numbers and the documents taken in one bin of
ranks, and that is joined to the rows as a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source in one bin of ranks, on average: the largest set that one row ever gathers.
BIN_ROWS = 1000
#: Sources whose rows are broadcast; more are joined by a shuffle.
FEW_SOURCES = 1000
#: The weight of a document within its source, of its size: one more each time the size doubles.
LONGER = "1 + floor(log2(size + 1))"


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size, ...) with weight and target (doubles) added.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes; a target stops at cap
    times its source's size and the excess is shared again by weight. In order of cap / weight the sources that stop
    are a prefix, so the common level is found in one window over the sources, which are few: a row a source.
    """
    every, ranked = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights))) + 1)
    s = sources.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    up = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    left = F.sum("source_size").over(every) - (F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))
    s = s.withColumn("level", left / F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("nth", F.row_number().over(up))  # of sources that stop at one level, only the first tells it
    s = s.withColumn("level", F.min(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.struct("nth", "level"))).over(every)["level"])
    return s.withColumn("target", F.least(F.col("most"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))).drop("most", "level", "nth")


def _levels(classes: DataFrame, cap: float) -> DataFrame:
    """(source, level): the copies due to a document are level times its share, cap at most, and fill the target.

    classes: a row a source and share, with its words. From the largest share down, shares that reach cap are a prefix.
    """
    down = Window.partitionBy("source").orderBy(F.desc("share"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = classes.where("share > 0 and words > 0").withColumn("left", F.greatest(F.col("target") - F.lit(cap) * above, F.lit(0.0)))
    c = c.withColumn("level", F.col("left") / F.sum(F.col("words") * F.col("share")).over(down.rowsBetween(0, Window.unboundedFollowing)))
    fits = F.min(F.when(F.col("level") * F.col("share") <= cap * (1 + 1e-12), F.struct((-F.col("share")).alias("by"), "level")))["level"]
    return c.groupBy("source").agg(F.coalesce(fits, F.max(F.lit(cap) / F.col("share"))).alias("level"))


def mix_sources(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", keep: list[str] | None = None, share: str | Column = "1",
    weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 7,
) -> DataFrame:
    """The columns keep of docs (all by default) with size, source_size, target, copies and taken added.

    size: words of the text (null and empty: 0). share: a Spark expression of what a document weighs within its source,
    of the columns of docs and size, with few distinct values a source (null or below 0: 0); alike by default. A
    document is due copies in proportion to its share, cap at most, such that the source's words come to its target;
    the whole part is certain and the fraction is the probability of one more, drawn in Pareto order: a prefix of the
    ranks up to the first document that does not fit, whose room goes to the next ones that do. taken = copies * size.

    Reruns agree: ranks come from hashes of id and text. Null sources are a source of their own, last. Repeated rows are
    documents of their own, alike to one another. A source without words takes none, and so does one whose documents
    all weigh 0. Columns of the added names in docs go. Empty tables give none.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in (keep or docs.columns) if c not in added]
    hashed = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    of = F.expr(share) if isinstance(share, str) else share
    rows = docs.select(*(c for c in docs.columns if c != "size"), size.alias("size"))
    rows = rows.select(F.struct(*kept).alias("row"), F.col(source).alias("source"), "size", F.greatest(F.coalesce(of.cast("double"), F.lit(0.0)), F.lit(0.0)).alias("share"), hashed.alias("tie"))
    rows = materialize(rows.withColumn("key", F.monotonically_increasing_id()), "mix")

    classes = rows.groupBy("source", "share").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    src = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("rows")), weights, cap)
    per = classes.join(src.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s")))
    level = _levels(per, float(cap)).withColumnRenamed("source", "s")
    src = materialize(src.join(level, src["source"].eqNullSafe(level["s"]), "left").select("source", "source_size", "rows", "target", F.coalesce("level", F.lit(0.0)).alias("level")), "mix-sources")
    few = src.count() <= FEW_SOURCES

    def told(left: DataFrame, right: DataFrame) -> DataFrame:
        """left with the columns of the source's row of right."""
        right = right.withColumnRenamed("source", "of_source")
        return left.join(F.broadcast(right) if few else right, left["source"].eqNullSafe(right["of_source"]), "left").drop("of_source")

    u = (F.pmod("tie", F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    due = F.least(F.lit(float(cap)), F.col("level") * F.col("share"))

    def ranked(left: DataFrame) -> DataFrame:
        d = told(left, src).withColumn("whole", F.floor(due + 1e-12)).withColumn("p", F.greatest(due - F.col("whole"), F.lit(0.0)))
        d = d.withColumn("rank", F.when((F.col("p") > 1e-12) & (F.col("size") > 0), (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
        return d.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * F.ceil(F.col("rows") / BIN_ROWS)))

    # Words by bin of ranks, summed before they move; then the bin in which the remainder of the target ends.
    small = ranked(rows.select("source", "size", "share", "tie", "key"))
    bins = small.groupBy("source", "bin").agg(F.first("target").alias("target"), F.sum(F.when(F.col("bin").isNotNull(), F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"))
    own = Window.partitionBy("source")
    bins = bins.withColumn("rest", F.col("target") - F.sum("certain").over(own)).withColumn("upto", F.sum("words").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    edge = bins.groupBy("source").agg(F.min(F.when(F.col("bin").isNotNull() & (F.col("upto") > F.col("rest")), F.struct("bin", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("gap")))).alias("edge"))
    edge = edge.select("source", F.col("edge.bin").alias("edge_bin"), F.col("edge.gap").alias("gap"))

    # In that bin, in order of rank, each document is taken that still fits: a fold over about BIN_ROWS sizes. Repeated
    # rows are one entry, as many of them are taken as fit, those of the smallest keys.
    inside = told(small, edge).where("bin = edge_bin").groupBy("source", "edge_bin", "rank", "tie", "size").agg(F.count("*").alias("n"), F.first("gap").alias("gap"))
    start = F.struct(F.first("gap").cast("double").alias("left"), F.array().cast("array<struct<tie:bigint,n:bigint,some:bigint>>").alias("got"))

    def take(a: Column, x: Column) -> Column:
        some = F.least(x["n"], F.floor(a["left"] / x["size"])).cast("long")
        return F.struct((a["left"] - some * x["size"]).alias("left"), F.array_append(a["got"], F.struct(x["tie"].alias("tie"), x["n"].alias("n"), some.alias("some"))).alias("got"))

    fold = F.aggregate(F.array_sort(F.collect_list(F.struct("rank", "tie", "size", "n"))), start, take, lambda a: F.filter(a["got"], lambda g: g["some"] > 0))
    got = materialize(inside.groupBy("source", "edge_bin").agg(fold.alias("got")), "mix-taken")
    edge = got.select("source", "edge_bin", F.transform("got", lambda g: g["tie"]).alias("ties"))
    # Of repeated rows of which some are taken, those up to a key: a sort of their keys alone.
    some = got.select(F.col("source").alias("of_source"), F.explode("got").alias("g")).where("g.some < g.n").select("of_source", F.col("g.tie").alias("of_tie"), F.col("g.some").alias("some"))
    if some.isEmpty():
        out, upto = told(ranked(rows), edge), F.col("key")
    else:
        keys = rows.select("source", "tie", "key").join(some, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("tie") == F.col("of_tie")))
        keys = keys.withColumn("nth", F.row_number().over(Window.partitionBy("source", "tie").orderBy("key"))).where("nth = some").groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("tie", "key"))).alias("upto"))
        out, upto = told(told(ranked(rows), edge), keys), F.coalesce(F.try_element_at("upto", F.col("tie")), F.col("key"))
    chosen = F.array_contains("ties", F.col("tie")) & (upto >= F.col("key"))
    more = F.when(F.col("bin").isNull(), 0).when(F.col("edge_bin").isNull() | (F.col("bin") < F.col("edge_bin")), 1).when((F.col("bin") == F.col("edge_bin")) & chosen, 1).otherwise(0)
    out = out.withColumn("copies", (F.col("whole") + more).cast("long"))
    return out.select(*(F.col("row")[c].alias(c) for c in kept), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
