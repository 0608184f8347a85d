"""Folds that build long lists take time in proportion to their length."""

import time

from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.functions.folds import BLOCK, fold_items
from leafmill.operators import chunking, documents, layout


def test_fold_gives_an_item_each(spark):
    for n in (0, 1, BLOCK, BLOCK + 1, 3 * BLOCK):
        xs = F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")
        got = fold_items(xs, F.struct(F.lit(0).alias("sum")), "int", lambda a, x: (F.struct((a["sum"] + x).alias("sum")), a["sum"] + x))
        r = spark.range(1).select(got.alias("r")).first()["r"]
        assert r.state["sum"] == n * (n + 1) // 2 and list(r["items"]) == [i * (i + 1) // 2 for i in range(1, n + 1)]


def test_long_lists(spark):
    def took(n, query):
        began = time.time()
        spark.range(1).select(query(n)).write.format("noop").mode("overwrite").save()
        return time.time() - began

    ints = lambda n: F.sequence(F.lit(1), F.lit(n))
    text = lambda n: F.repeat(F.lit("ab "), F.lit(n))
    segment = lambda i: F.struct(i.cast("double").alias("t0"), (i + 1).cast("double").alias("t1"), F.lit("x").alias("text"), F.lit("c").alias("chapter"))
    queries = {
        "greedy": lambda n: chunking.greedy(ints(n), F.lit(5)), "windows": lambda n: chunking.windows(F.transform(ints(n), segment), 0.5, 9),
        "occurrences": lambda n: documents.occurrences(text(n), "ab"), "wrap": lambda n: tx.wrap(text(n), 5),
    }
    for name, query in queries.items():
        took(1000, query)
        short, long = min(took(20_000, query) for _ in range(2)), took(80_000, query)
        assert long < 7 * short + 1, (name, short, long)
    rows = spark.range(80_000).select(F.lit(1).alias("page"), "id", (F.col("id") * 2.0).alias("y"), F.lit(1.0).alias("x"), F.lit(10.0).alias("font_size"))
    assert layout.text_rows(rows, ["page"], "id").agg(F.max("row")).first()[0] == 79_999
