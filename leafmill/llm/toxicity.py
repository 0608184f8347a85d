"""Toxicity: maximum-scoring segments over token log-odds, calibrated as extreme values.

Words get the log-odds of toxic against other texts under an informative Dirichlet prior (the pooled word counts);
a linear-time scan finds every maximal segment of positive sum in a whole text; the expected number of such segments
by chance in a text of that length, K n exp(-lambda S), tells the significant ones, and a logistic curve over the
most significant and their number is the score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_ANY_CASE, Words, as_long, carry, materialize, mix, schema_with, slices, training_labels

#: Words in the model at most, those of the largest z.
MAX_WORDS = 20_000
#: The prior's weight as a share of all counts; the least z of a word with a score; what any other word costs.
PRIOR, LEAST_Z, COST = 0.1, 3.0, 0.5
#: Segments expected by chance less often than this are significant. The most that one counts for.
SIGNIFICANT, TOP = 0.05, 30.0


#: A word also has the log-odds of its first so many bytes, for stems with many endings; the one of the largest z counts.
STEMS = (5, 6, 7)


@dataclass
class Toxicity:
    words: np.ndarray  # sorted hashes (uint64)
    scores: np.ndarray
    weights: np.ndarray  # absolute z
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, float, float] = (0.0, 1.0, 0.0)  # of 1, -ln E of the best segment, log1p(significant ones)

    def score(self, best: np.ndarray, n_words: np.ndarray, n_significant: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-(a + b * self.surprise(best, n_words) + c * np.log1p(n_significant))))

    def surprise(self, best: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """-ln of the expected number by chance, within 0 and TOP."""
        return np.clip(np.where(best > 0, self.lam * best - np.log(self.k * np.maximum(n_words, 1)), 0.0), 0.0, TOP)


def segments(at: list[int], scores: list[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, sum) of a sequence with scores at places at and -cost elsewhere.

    The stack scan of Ruzzo and Tompa, with a link from each candidate to the last one of a smaller left sum, so that
    each is passed once: linear time.
    """
    stack: list[list] = []  # left sum, right sum, start, end, link
    total, last = 0.0, -1
    for p, s in zip(at, scores):
        total -= cost * (p - last - 1)
        last = p
        left, total = total, total + s
        if s <= 0:
            continue
        cand = [left, total, p, p + 1, -1]
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= cand[0]:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= cand[1]:
                cand[4] = j
                stack.append(cand)
                break
            cand[0], cand[2] = stack[j][0], stack[j][2]
            nxt = stack[j][4]
            del stack[j:]
            j = nxt
    return [(a, z, r - x) for x, r, a, z, _ in stack]


def _scan(arr: pa.StringArray, words: np.ndarray, scores: np.ndarray, weights: np.ndarray):
    """(Words, for each text its segments): texts without a scored word have none."""
    w = Words(arr, ALNUM_ANY_CASE)
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(arr))]
    if len(words) and len(w):
        most, of = np.zeros(len(w)), np.zeros(len(w))
        for k in (0, *STEMS):
            some = np.flatnonzero(w.end - w.start >= k)
            h = w.hashes(most=k)[some]
            place = np.minimum(np.searchsorted(words, h), len(words) - 1)
            hit = np.flatnonzero(words[place] == h)
            at, place = some[hit], place[hit]
            better = weights[place] > most[at]
            most[at[better]], of[at[better]] = weights[place[better]], scores[place[better]]
        hit = np.flatnonzero(most)
        bounds = np.searchsorted(hit, w.doc_at)
        value = of[hit]
        for d in np.flatnonzero(np.diff(bounds)).tolist():
            a, z = bounds[d], bounds[d + 1]
            out[d] = segments((hit[a:z] - w.doc_at[d]).tolist(), value[a:z].tolist(), COST)
    return w, out


def _summary(found, n_words: np.ndarray, model: Toxicity):
    best = np.array([max((s for _, _, s in x), default=0.0) for x in found])
    bar = (np.log(model.k * np.maximum(n_words, 1)) - math.log(SIGNIFICANT)) / model.lam
    return best, np.array([sum(s >= b for _, _, s in x) for x, b in zip(found, bar)], np.int64)


def _logistic(rows: DataFrame, x: list[str], y: str, ridge: float = 1e-2) -> np.ndarray:
    """Newton's steps of a logistic regression of y on the columns x, each step's sums over all rows; at most 50 steps."""
    b, n = np.zeros(len(x)), len(x)
    for _ in range(50):
        at = sum((F.col(c) * float(w) for c, w in zip(x, b)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.least(F.greatest(at, F.lit(-30.0)), F.lit(30.0))))
        one = rows.select(*x, y, p.alias("_p"))
        miss, spread = F.col(y) - F.col("_p"), F.col("_p") * (1 - F.col("_p"))
        got = one.agg(*(F.sum(F.col(c) * miss) for c in x), *(F.sum(F.col(c) * F.col(d) * spread) for c in x for d in x)).first()
        step = np.linalg.solve(np.array(got[n:]).reshape(n, n) + ridge * np.eye(n), np.array(got[:n]) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", max_words: int = MAX_WORDS) -> Toxicity:
    """Fits on all labelled rows outside the held-out fold; only sums and the model's words reach the driver.

    Of texts of one label whose words are the same in the same order (copies, whatever their case and punctuation) one
    is used, so that a group of copies does not make its words look telling; all others are. Of rows that repeat an id
    the least text is used. Without rows of both labels the model finds nothing and every score is about the share of toxic
    labels, 0 where there are none.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(training_labels(labels, label), "doc_id")
    rows, text = materialize(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "labelled"), "text"

    def keys(batches):
        for batch in batches:
            for part, arr in slices(batch, text):
                w = Words(arr, ALNUM_ANY_CASE)
                same = np.zeros((2, len(arr)), np.uint64)
                some = w.counts() > 0
                if some.any():
                    h, nth = w.hashes(), (np.arange(len(w)) - w.doc_at[w.doc()]).astype(np.uint64)
                    for i in range(2):  # two sums of words mixed with their places: 128 bits
                        same[i, some] = np.add.reduceat(mix(h + mix(2 * nth + np.uint64(i + 1))), w.doc_at[:-1][some])
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("label")), *(pa.array(as_long(x), pa.int64()) for x in same)], ["doc_id", "label", "same", "too"])

    first = rows.mapInArrow(keys, "doc_id bigint, label int, same bigint, too bigint").groupBy("label", "same", "too").agg(F.min("doc_id").alias("doc_id"))
    rows = materialize(rows.join(first.select("doc_id"), "doc_id", "left_semi").select("label", text), "distinct")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = toxic / n if n else 0.0
    flat = Toxicity(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), curve=(math.log((share + 0.01) / (1.01 - share)), 0.0, 0.0))
    if toxic in (0, n):
        return flat
    spark = docs.sparkSession

    def count(batches):
        for batch in batches:
            for part, arr in slices(batch, text):
                toxic = part.column(part.schema.get_field_index("label")).to_numpy()
                w = Words(arr, ALNUM_ANY_CASE)
                d = w.doc()
                stems = [(w.hashes(most=k)[long], d[long]) for k in STEMS for long in (w.end - w.start >= k,)]
                h, d = (np.concatenate(x) for x in zip((w.hashes(), d), *stems))
                order = np.lexsort((h, d))
                h, d = h[order], d[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                h, t = h[new], toxic[d[new]].astype(np.int64)
                u, back = np.unique(h, return_inverse=True)
                n = np.bincount(back, minlength=len(u))
                t = np.bincount(back, weights=t, minlength=len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(u), pa.int64()), pa.array(t, pa.int64()), pa.array(n - t, pa.int64())], ["word", "t", "c"])

    counts = materialize(rows.mapInArrow(count, "word bigint, t bigint, c bigint").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "word-counts")
    total = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    nt, nc = float(total["t"] or 0), float(total["c"] or 0)
    if not nt or not nc:
        return flat
    a0 = PRIOR * (nt + nc)
    aw = F.lit(PRIOR) * (F.col("t") + F.col("c"))
    odds = lambda y, n: F.log((F.col(y) + aw) / (F.lit(n + a0) - F.col(y) - aw))
    # Equal prior weight pulls both classes to the pooled share; what is left without evidence is taken off.
    neutral = math.log((nt / (nt + nc) + PRIOR) / (nt + a0)) - math.log((nc / (nt + nc) + PRIOR) / (nc + a0))
    scored = counts.withColumn("delta", odds("t", nt) - odds("c", nc) - F.lit(neutral)).withColumn("z", F.col("delta") / F.sqrt(1 / (F.col("t") + aw) + 1 / (F.col("c") + aw)))
    words = scored.where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "word").limit(max_words).toPandas()
    if not (words["delta"] > 0).any():
        return flat
    h = words["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    s = words["delta"].to_numpy(float)[order]
    c = words["c"].to_numpy(float)[order] + 0.5
    model = Toxicity(h[order], s, np.abs(words["z"].to_numpy(float)[order]))
    # lambda: the positive root of sum p exp(lambda s) = 1 over the words of other texts.
    p = c / (nc + len(c) * 0.5)
    rest = max(1e-9, 1 - p.sum())
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (p * np.exp(np.minimum(mid * s, 300))).sum() + rest * math.exp(-mid * COST) > 1 else (mid, hi)
    model.lam = lo
    shared = spark.sparkContext.broadcast((model.words, model.scores, model.weights))

    def trial(batches):
        for batch in batches:
            for part, arr in slices(batch, text):
                w, found = _scan(arr, *shared.value)
                sums = [[s for _, _, s in x] for x in found]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("label")), pa.array(w.counts(), pa.int64()), pa.array([max(x, default=0.0) for x in sums], pa.float64()), pa.array(sums, pa.list_(pa.float64()))], ["label", "n", "best", "sums"])

    trials = materialize(rows.mapInArrow(trial, "label int, n bigint, best double, sums array<double>"), "trials")
    low = max(trials.where("best > 0").agg(F.min("best")).first()[0] or 1.0, 0.5)
    many, length = trials.where("label = 0").agg(F.count_if(F.col("best") >= low), F.coalesce(F.sum("n"), F.lit(0))).first()
    model.k = float((many + 0.5) / max(1.0, length * math.exp(-model.lam * low)))
    by_chance = F.log(F.lit(model.k) * F.greatest("n", F.lit(1)))
    surprise = F.when(F.col("best") > 0, F.greatest(F.lit(0.0), F.least(F.lit(TOP), F.lit(model.lam) * F.col("best") - by_chance))).otherwise(0.0)
    bar = (by_chance - math.log(SIGNIFICANT)) / model.lam
    tried = trials.select(F.lit(1.0).alias("one"), surprise.alias("surprise"), F.log1p(F.size(F.filter("sums", lambda s: s >= bar))).alias("many"), F.col("label").cast("double").alias("y"))
    # Rounded, as sums of parts that come in any order differ in their last digits.
    model.curve = tuple(round(float(v), 9) for v in _logistic(materialize(tried, "tried"), ["one", "surprise", "many"], "y"))
    return model


SEGMENTS = "array<struct<start:bigint,end:bigint,sum:double,expected:double>>"
_SEGMENT = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("sum", pa.float64()), ("expected", pa.float64())]))


def score_toxicity(docs: DataFrame, model: Toxicity, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all by default) with score (0 to 1) and passages added.

    passages: the significant segments of the whole text (code points, end exclusive) with their sum and the number
    expected by chance. Null and empty texts have the score of a text without any scored word. Repeated rows score
    alike. Columns of the added names go.
    """
    added = ["score", "passages"]
    kept = [c for c in (keep or docs.columns) if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part, arr in slices(batch, text):
                w, found = _scan(arr, m.words, m.scores, m.weights)
                n = w.counts()
                best, many = _summary(found, n, m)
                passages: list[list[dict]] = [[] for _ in range(len(arr))]
                for d in np.flatnonzero(many).tolist():
                    at, seen = w.off[d], 0
                    for a, z, s in found[d]:
                        e = m.k * max(n[d], 1) * math.exp(-m.lam * s)
                        if e <= SIGNIFICANT:
                            lo, hi = w.start[w.doc_at[d] + a], w.end[w.doc_at[d] + z - 1]
                            start = seen + int(((w.data[at:lo] & 0xC0) != 0x80).sum())
                            at, seen = hi, start + int(((w.data[lo:hi] & 0xC0) != 0x80).sum())
                            passages[d].append({"start": start, "end": seen, "sum": s, "expected": e})
                yield carry(part, kept, added, [pa.array(m.score(best, n, many), pa.float64()), pa.array(passages, _SEGMENT)])

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema_with(docs, kept, f"score double, passages {SEGMENTS}"))
