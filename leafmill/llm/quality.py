"""Quality: a sparse rule ensemble over text statistics, compiled into one Spark expression.

Boosted shallow trees propose their paths as conjunctive rules, a lasso logistic fit keeps few of them, and the kept
rules become `when` terms under a logistic curve. Statistics are of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Words, carry, schema_with, slices, training_sample

#: The bound of the labelled rows that are fitted on.
MAX_ROWS = 20_000
STATS = ("log_bytes", "log_words", "word_bytes", "distinct", "repeated", "top_word", "symbols", "bars", "digits", "capitals", "stops", "commas", "log_line_words", "lone_words")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_SYMBOLS, _BARS, _DIGITS, _STOPS, _COMMAS, _LINES = (_class(x) for x in ("#$%&*~^<>{}=_@\\+[]`", "|", "0123456789", ".!?", ",;", "\n"))
_CAPITALS = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def statistics(arr: pa.StringArray) -> np.ndarray:
    """One row of STATS for each text."""
    w = Words(arr, NOT_SPACE)
    n, size = w.counts().astype(float), np.diff(w.off).astype(float)
    docs = len(arr)

    def per_doc(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[w.data])])
        return (sums[w.off[1:]] - sums[w.off[:-1]]).astype(float)

    d = w.doc()
    h = w.hashes()
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    key = (d.astype(np.uint64) << np.uint64(42)) | (h >> np.uint64(22))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(key)))
    of = (key[at] >> np.uint64(42)).astype(np.int64)
    distinct = np.bincount(of, minlength=docs).astype(float)
    top, lone = np.zeros(docs), np.bincount(of[run == 1], minlength=docs).astype(float)
    np.maximum.at(top, of, run.astype(float))
    words, some = np.maximum(n, 1), np.maximum(size, 1)
    lengths = np.concatenate([[0], np.cumsum(w.end - w.start)])
    inside = (lengths[w.doc_at[1:]] - lengths[w.doc_at[:-1]]).astype(float)
    lines = per_doc(_LINES) + 1
    return np.column_stack([
        np.log1p(size), np.log1p(n), inside / words, distinct / words, np.bincount(d[same], minlength=docs) / words, top / words, per_doc(_SYMBOLS) / some,
        per_doc(_BARS) / words, per_doc(_DIGITS) / some, per_doc(_CAPITALS) / words, per_doc(_STOPS) / words, per_doc(_COMMAS) / words, np.log1p(n / lines), lone / words,
    ])


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all by default) with STATS (doubles) added; null and empty texts have the zero text's."""
    kept = [c for c in (keep or docs.columns) if c not in STATS]

    def run(batches):
        for batch in batches:
            for part, arr in slices(batch, text):
                x = statistics(arr)
                yield carry(part, kept, list(STATS), [pa.array(np.ascontiguousarray(x[:, j]), pa.float64()) for j in range(len(STATS))])

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema_with(docs, kept, ", ".join(f"{s} double" for s in STATS)))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold), all of which hold


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def column(self) -> Column:
        """The score as an expression over the columns of STATS."""

        def holds(rule: Rule) -> Column:
            return reduce(lambda a, b: a & b, [F.col(STATS[j]) > F.lit(t) if above else F.col(STATS[j]) <= F.lit(t) for j, above, t in rule])

        terms = [F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in zip(self.rules, self.weights)]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + _holds(self.rules, x) @ np.array(self.weights))))


def _holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for i, rule in enumerate(rules):
        for j, above, t in rule:
            out[:, i] *= (x[:, j] > t) if above else (x[:, j] <= t)
    return out


def propose(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 20, seed: int = 5) -> list[Rule]:
    """Paths to every inner node and leaf of boosted trees on halves of the rows, each rule once."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    f = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        half = rng.random(len(y)) < 0.5

        def grow(rows: np.ndarray, all_rows: np.ndarray, rule: Rule) -> None:
            best = None
            if len(rule) < depth and len(rows) >= 2 * least:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    k = code[rows, j]
                    gl = np.cumsum(np.bincount(k, weights=g[rows], minlength=len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(k, weights=h[rows], minlength=len(c) + 1))[:-1]
                    nl = np.cumsum(np.bincount(k, minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    at = int(gain.argmax())
                    if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
                        best = (gain[at], j, at)
            if rule:
                found.setdefault(rule)
            if best is None:
                f[all_rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
                return
            _, j, at = best
            t = float(cuts[j][at])
            for above in (False, True):
                pick = lambda r: r[(code[r, j] > at) == above]  # noqa: E731, B023
                grow(pick(rows), pick(all_rows), (*rule, (j, above, t)))

        grow(np.flatnonzero(half), np.arange(len(y)), ())
    return list(found)


def lasso(z: np.ndarray, y: np.ndarray, strength: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an absolute-value penalty on all but the intercept, by accelerated proximal steps."""
    n, m = z.shape
    rate = 4.0 / max(1e-9, np.linalg.norm(z, 2) ** 2 / n + 1)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ vw + vb))) - y
        nw, nb = vw - rate * (z.T @ r) / n, vb - rate * r.mean()
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * strength, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit_arrays(x: np.ndarray, y: np.ndarray, strength: float = 1e-3) -> RuleEnsemble:
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return RuleEnsemble([], [], float(np.log((share + 0.01) / (1.01 - share))))
    rules = propose(x, y.astype(float))
    if not rules:
        return RuleEnsemble([], [], float(np.log(y.mean() / (1 - y.mean()))))
    w, b = lasso(_holds(rules, x).astype(float), y.astype(float), strength)
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleEnsemble([rules[i] for i in kept], [float(w[i]) for i in kept], b)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> RuleEnsemble:
    """Fits on labelled rows outside the held-out fold, max_rows at most (by id hash); on one class or none, a constant.

    Of rows that repeat an id the least statistics are used, so the driver gets a row an id.
    """
    rows = docs.select("doc_id", text).join(F.broadcast(training_sample(labels, label, max_rows)), "doc_id")
    got = with_statistics(rows, text, keep=["doc_id", "label"])
    got = got.groupBy("doc_id", "label").agg(F.min(F.struct(*STATS)).alias("s")).select("doc_id", "label", "s.*").toPandas().sort_values("doc_id")
    return fit_arrays(got[list(STATS)].to_numpy(float), got["label"].to_numpy(float))


def score_quality(docs: DataFrame, model: RuleEnsemble, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all by default), STATS and score (0 to 1). Null and empty texts are scored as empty."""
    kept = [c for c in (keep or docs.columns) if c != "score"]
    return with_statistics(docs, text, kept).withColumn("score", model.column())
