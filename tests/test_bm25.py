"""BM25 against adding up scores by hand: blocks of queries, ties, null texts, text keys, no chunks."""

import math
import random
import re

from leafmill.operators import retrieval


def by_hand(queries, chunks, k):
    words = {c: re.findall("[a-z0-9]+", (t or "").lower()) for c, t in chunks}
    some = [c for c, t in chunks if t is not None]
    mean = sum(len(words[c]) for c in some) / max(1, len(some)) or 1.0
    out = set()
    for q, text in queries:
        asked = set(re.findall("[a-z0-9]+", (text or "").lower()))
        rated = []
        for c in words:
            score = 0.0
            for w in asked & set(words[c]):
                df, tf = sum(w in x for x in words.values()), words[c].count(w)
                score += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words[c]) / mean))
            rated.append((-round(score, 9), c))
        out |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(rated)[:k])}
    return out


def test_bm25(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("ab bc cd de ef fg gh hi").strip() + rng.choice(["", "1", "!"]) for _ in range(n))
    chunks = [(f"c{i:03}", text(rng.randint(0, 30))) for i in range(150)] + [("none", None), ("blank", "")]
    queries = [(i, text(rng.randint(0, 5))) for i in range(23)] + [(90, None), (91, "unknown")]
    df = spark.createDataFrame(chunks, "chunk_id string, text string").repartition(3)
    got = retrieval.bm25(spark.createDataFrame(queries, "item_id long, text string"), df, 7, query_block=5).collect()
    near = lambda rows: {(q, r, c, round(s, 6)) for q, r, c, s in rows}
    assert near((r.item_id, r["rank"], r.chunk_id, r.score) for r in got) == near(by_hand(queries, chunks, 7))
    assert retrieval.bm25(spark.createDataFrame(queries, "item_id long, text string"), df.limit(0)).count() == 0
    assert retrieval.bm25(spark.createDataFrame([], "item_id long, text string"), df).count() == 0
