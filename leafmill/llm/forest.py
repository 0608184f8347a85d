"""Embedding near-duplicates: a forest of random-projection trees with spill, compared within leaves and verified.

Equal vectors form a class and its smallest vec_id stands for it. Each node of a tree splits on a random direction at
a random place near the median of the sample; vectors within the margin of the split go both ways. Trees are added
until pairs planted at the threshold meet in a leaf as often as asked. The forest is fitted on a bounded sample and
every vector is indexed. Leaves are compared by matrix products in double precision; a leaf of more than BLOCK vectors
is cut in blocks and every pair of blocks is compared, so no leaf is capped. A pair is counted in the first leaf it
shares only, told by the leaves each vector carries, so pairs are never written out; the links of a leaf reach the
union step as a spanning forest.

Dense balls, whose members all link with each other by the triangle inequality of angles, are found in the sample.
Their inner pairs are counted without a comparison, so a group of near copies costs what its vectors cost against
those around it, not the square of its size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

#: Sampled vectors the trees are fitted on (the bound of what the driver holds); those of them that balls are sought in,
#: and how many must lie in one; vectors of a leaf, by the sample's estimate; vectors of a block.
SAMPLE, BALL_SAMPLE, BALL_LEAST, LEAF, BLOCK = 20_000, 2048, 8, 1024, 2048
#: Share of the planted pairs that must meet; trees at most, which no data tried has come near.
MEET, TREES = 0.95, 256
#: Half the width of the spill, in standard deviations of the projected difference of two vectors at the threshold.
SPILL = 0.2
#: Directions tried for a split; the one with the fewest vectors in its margin is taken.
DIRECTIONS = 4
#: A split must leave at most this share of a node's vectors on either side, or the node stays a leaf.
LARGEST_CHILD = 0.85


@dataclass
class Node:
    direction: np.ndarray | None = None
    place: float = 0.0
    left: int = -1
    right: int = -1
    leaf: int = -1


@dataclass
class Forest:
    """Trees and balls of vectors of one length; leaves are numbered through, from base on."""

    base: int = 0
    trees: list[list[Node]] = field(default_factory=list)
    leaves: int = 0
    margin: float = 0.0
    centers: np.ndarray | None = None
    within: float = 2.0  # the cosine to its center that a member of a ball has
    met: float = 0.0  # share of the planted pairs that meet

    def place(self, nodes: list[Node], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf of one tree that each unit vector falls in."""
        rows, leaves, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            at, own = todo.pop()
            if not len(own):
                continue
            n = nodes[at]
            if n.direction is None:
                rows.append(own)
                leaves.append(np.full(len(own), n.leaf))
                continue
            p = x[own] @ n.direction - n.place
            todo += [(n.left, own[p <= self.margin]), (n.right, own[p >= -self.margin])]
        return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(leaves) if leaves else np.zeros(0, np.int64)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) over all trees, sorted by row and leaf."""
        found = [self.place(nodes, x) for nodes in self.trees]
        r, f = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        order = np.lexsort((f, r))
        return r[order], f[order]

    def ball(self, x: np.ndarray) -> np.ndarray:
        """The first ball each unit vector lies in, or -1."""
        if self.centers is None or not len(self.centers):
            return np.full(len(x), -1)
        inside = x @ self.centers.T >= self.within
        return np.where(inside.any(1), inside.argmax(1), -1)

    def find_balls(self, sample: np.ndarray, threshold: float) -> None:
        """Greedy: the center with most vectors of the sample that are in no ball yet, while there are BALL_LEAST.

        Two vectors within half the threshold's angle of a center are within the whole of it of each other. The angle
        is 1e-6 short, so that rounding cannot put a pair below the threshold.
        """
        self.within = math.cos(max(0.0, math.acos(threshold) / 2 - 1e-6))
        some = sample[:BALL_SAMPLE]
        near, free, centers = some @ some.T >= self.within, np.ones(len(some), bool), []
        while len(some):
            n = near @ free.astype(np.float32)
            best = int(n.argmax())
            if n[best] < BALL_LEAST:
                break
            centers.append(best)
            free &= ~near[best]
        self.centers = some[centers]


def fit(sample: np.ndarray, total: int, threshold: float, leaf: int = LEAF, meet: float = MEET, base: int = 0, seed: int = 11) -> Forest:
    """A forest on unit vectors drawn from total ones; nodes stop when their share of total is within leaf.

    Of a ball only the center takes part in the splits: its members need not be told apart.
    """
    rng = np.random.default_rng(seed)
    forest = Forest(base, margin=SPILL * math.sqrt(max(0.0, 2 - 2 * threshold)) / math.sqrt(sample.shape[1]))
    forest.find_balls(sample, threshold)
    ball = forest.ball(sample)
    rest = np.concatenate([sample[ball < 0], forest.centers])
    least = max(8.0, leaf * len(sample) / max(total, 1))
    probes = sample[rng.permutation(len(sample))[:4000]]
    noise = rng.standard_normal(probes.shape)
    noise -= (noise * probes).sum(1, keepdims=True) * probes
    size = np.linalg.norm(noise, axis=1, keepdims=True)
    partners = threshold * probes + math.sqrt(max(0.0, 1 - threshold**2)) * noise / np.maximum(size, 1e-300)
    met = (size[:, 0] <= 1e-9) | ((forest.ball(probes) >= 0) & (forest.ball(probes) == forest.ball(partners)))
    while len(forest.trees) < TREES:
        nodes, todo = [Node()], [(0, np.arange(len(rest)))]
        while todo:
            at, own = todo.pop()
            best = None
            if len(own) > least:
                for _try in range(DIRECTIONS):
                    d = rng.standard_normal(sample.shape[1])
                    d /= np.linalg.norm(d)
                    p = rest[own] @ d
                    place = float(np.quantile(p, rng.uniform(0.4, 0.6)))
                    left, right = p <= place + forest.margin, p >= place - forest.margin
                    if best is None or (left & right).sum() < best[0]:
                        best = ((left & right).sum(), d, place, own[left], own[right])
            if best is None or max(len(best[3]), len(best[4])) > LARGEST_CHILD * len(own):
                nodes[at].leaf = base + forest.leaves
                forest.leaves += 1
                continue
            _, nodes[at].direction, nodes[at].place, left, right = best
            nodes[at].left, nodes[at].right = len(nodes), len(nodes) + 1
            nodes += [Node(), Node()]
            todo += [(nodes[at].left, left), (nodes[at].right, right)]
        forest.trees.append(nodes)
        (ra, la), (rb, lb) = forest.place(nodes, probes), forest.place(nodes, partners)
        width = base + forest.leaves
        met[np.intersect1d(ra * width + la, rb * width + lb) // width] = True
        forest.met = float(met.mean()) if len(met) else 1.0
        if forest.met >= meet:
            break
    return forest


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows or vanishes."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0.0) if x.size else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(e):
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(e, lambda v: v != 0)


def _incidence(leaves: list, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of the leaves before this one."""
    each = [np.frombuffer(b, "<i4") for b in leaves]
    row, all_ = np.repeat(np.arange(len(each)), [len(e) for e in each]), np.concatenate(each)
    some = all_ < leaf
    return row[some], all_[some]


def _compare(pdf, threshold: float):
    """Links of one leaf's block, or between two of its blocks: (vec_id, n_links counted here, smallest vec_id reached here)."""
    import pandas as pd

    leaf, lo, hi = (int(pdf[c].iloc[0]) for c in ("leaf", "lo", "hi"))
    ids, weight, part = (pdf[c].to_numpy(np.int64) for c in ("vec_id", "m", "part"))
    raw = b"".join(pdf["vector"])
    x = unit(np.frombuffer(raw, "<f8").reshape(len(ids), -1))
    a, b = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
    one = lo == hi
    near = np.empty((len(a), len(b)), bool)
    for at in range(0, len(a), 256):
        near[at : at + 256] = x[a[at : at + 256]] @ x[b].T >= threshold
    if one:
        np.fill_diagonal(near, False)
    ra, rb = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(ra):
        return pd.DataFrame({"vec_id": ids[:0], "links": weight[:0], "root": ids[:0]})
    near, a, b = near[np.ix_(ra, rb)], a[ra], b[rb]
    # Who has met in an earlier leaf: a product of two incidence matrices, of the vectors that have a link only.
    leaves = list(pdf["leaves"])
    (ia, la), (ib, lb) = (_incidence([leaves[i] for i in own], leaf) for own in (a, b))
    known = np.intersect1d(la, lb)
    new = near
    if len(known):
        ma, mb = (np.zeros((len(own), len(known)), np.float32) for own in (a, b))
        for m, i, f in ((ma, ia, la), (mb, ib, lb)):
            some = np.isin(f, known)
            m[i[some], np.searchsorted(known, f[some])] = 1
        new = near & (ma @ mb.T == 0)
    count = np.zeros(len(ids), np.int64)
    count[a] += new @ weight[b]
    if not one:
        count[b] += weight[a] @ new
    label, top = ids.copy(), np.iinfo(np.int64).max
    while True:
        before = label.copy()
        for rows, cols, m in ((a, b, near), (b, a, near.T)):
            for at in range(0, len(rows), 256):
                own = rows[at : at + 256]
                label[own] = np.minimum(label[own], np.where(m[at : at + 256], label[cols][None, :], top).min(1))
        if (label == before).all():
            break
    got = (count > 0) | (label != ids)
    return pd.DataFrame({"vec_id": ids[got], "links": count[got], "root": label[got]})


def build(classes: DataFrame, threshold: float, sample: int, leaf: int, meet: float) -> dict[int, Forest]:
    """A forest for each length of the vectors v of classes that the sample holds, fitted on its share of the sample."""
    drawn = classes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow().column(0).combine_chunks()  # compact, unlike rows
    values, size = drawn.flatten().to_numpy(zero_copy_only=False), np.diff(drawn.offsets.to_numpy())
    start = np.cumsum(size) - size
    by = {d: values[start[size == d][:, None] + np.arange(d)] for d in np.unique(size).tolist()}
    totals = {r.d: r.n for r in classes.where(F.size("v").isin(list(by))).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row a length in the sample
    out, base = {}, 0
    for dim, own in sorted(by.items()):
        out[dim] = fit(unit(own), totals[dim], threshold, leaf, meet, base)
        base += out[dim].leaves
    return out


def near_duplicates(vectors: DataFrame, embedding: str = "embedding", threshold: float = 0.9, sample: int = SAMPLE, leaf: int = LEAF, meet: float = MEET) -> DataFrame:
    """One row per vec_id: n_links (other vectors of cosine >= threshold found), component_id and kept.

    Recall against brute force is measured in the tests; precision is exact. Vectors link only with those of their own
    length. Vectors that are null, zero or empty, or hold null or non-finite components link with nothing. Of rows that
    repeat a vec_id the least vector is compared and one row returned; rows of a null vec_id give one row without
    component. Extra columns are not read. No table: no row. meet: the share of pairs at the threshold that the forest
    must bring together in its own trial; closer pairs meet more often.
    """
    rows = vectors.select("vec_id", F.col(embedding).cast("array<double>").alias("v"))
    every = rows.groupBy("vec_id").agg(F.lit(1).alias("one")).select("vec_id")
    good = rows.where(_usable(F.col("v"))).groupBy("vec_id").agg(F.min("v").alias("v"))
    good = materialize(good.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v")), "vectors")
    classes = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("m"), F.min("v").alias("v"))
    classes = materialize(classes, "classes")
    forests = build(classes, threshold, sample, leaf, meet)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(forests)

    def index(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                ids, m = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                values, size = b.column(2).flatten().to_numpy(zero_copy_only=False), np.diff(b.column(2).offsets.to_numpy())
                start = np.cumsum(size) - size
                for dim in np.unique(size).tolist():
                    own = np.flatnonzero(size == dim)
                    raw = np.ascontiguousarray(values[start[own][:, None] + np.arange(dim)], "<f8")
                    forest = shared.value.get(dim)
                    x = unit(raw)
                    r, f = forest.assign(x) if forest else (np.arange(len(own)), np.full(len(own), -dim))  # a length that the sample lacks is one leaf
                    ball = forest.ball(x) if forest else np.full(len(own), -1)
                    ends = np.searchsorted(r, np.arange(len(own) + 1))
                    leaves = [f[ends[i] : ends[i + 1]].astype("<i4").tobytes() for i in range(len(own))]
                    texts = [v.tobytes() for v in raw]
                    for lo in range(0, len(r), 4096):
                        s = slice(lo, lo + 4096)
                        k = own[r[s]]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(f[s], pa.int32()), pa.array(ball[r[s]], pa.int32()), pa.array(np.arange(lo, lo + len(k)) == ends[r[s]], pa.bool_()), pa.array(ids[k], pa.int64()), pa.array(m[k], pa.int64()),
                                pa.array([texts[i] for i in r[s]], pa.binary()), pa.array([leaves[i] for i in r[s]], pa.binary()),
                            ],
                            ["leaf", "ball", "first", "vec_id", "m", "vector", "leaves"],
                        )

    placed = classes.select("vec_id", "m", "v").mapInArrow(index, "leaf int, ball int, first boolean, vec_id bigint, m bigint, vector binary, leaves binary")
    placed = materialize(placed.withColumn("dim", F.octet_length("vector")), "leaves")

    # Blocks of a leaf, those of a ball apart; each is held against itself and the others but those of the same ball.
    sizes = placed.groupBy("leaf", "ball").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    parts = sizes.select("leaf", "ball", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    code = lambda ball, block: (ball.cast("long") + 1) * F.lit(1 << 32) + block
    parts = parts.groupBy("leaf").agg(F.collect_list(code(F.col("ball"), F.col("block"))).alias("parts"), F.map_from_entries(F.collect_set(F.struct("ball", "blocks"))).alias("blocks"))
    cut = placed.join(parts, "leaf").withColumn("part", code(F.col("ball"), F.pmod(F.xxhash64("vec_id"), F.element_at("blocks", F.col("ball"))).cast("int")))
    other = F.filter("parts", lambda p: (F.col("ball") < 0) | (F.shiftright(p, 32) != F.shiftright(F.col("part"), 32)))
    cut = cut.withColumn("other", F.explode(other)).select("leaf", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "vec_id", "m", "vector", "leaves")
    found = materialize(cut.groupBy("leaf", "lo", "hi").applyInPandas(lambda pdf: _compare(pdf, threshold), "vec_id bigint, links bigint, root bigint"), "links")

    # Inside a ball all are linked: counts by sums, and one edge each to its smallest id.
    inside = placed.where("first and ball >= 0").select("dim", "ball", "vec_id", "m")
    total = F.broadcast(inside.groupBy("dim", "ball").agg(F.sum("m").alias("all"), F.min("vec_id").alias("root")))  # BALL_SAMPLE / BALL_LEAST balls a length
    found = found.unionByName(inside.join(total, ["dim", "ball"]).select("vec_id", (F.col("all") - F.col("m")).alias("links"), "root"))
    found = materialize(found.groupBy("vec_id", "root").agg(F.sum("links").alias("links")), "found")
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    counted = classes.select("h1", "h2", "vec_id", "m").join(found.groupBy("vec_id").agg(F.sum("links").alias("n")), "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    counted = counted.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = every.join(good.select("vec_id", "h1", "h2").join(counted, ["h1", "h2"]).drop("h1", "h2"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
