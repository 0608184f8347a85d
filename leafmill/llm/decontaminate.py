"""Benchmark decontamination: latent semantic candidates, then longest common subsequences and answer checks.

Passages of WINDOW words, every STRIDE words, are TF-IDF rows over the benchmark's words. A randomised SVD of these
rows (one pass over the passages of all documents and over the benchmark: sketch, Nystrom core, small SVD) gives the
latent space. Items are cut into even pieces of at most PIECE words, as a passage can hold only a
small part of a long item. Every passage of every document is projected and held against all pieces by cosine; where
one is found, the whole item is verified word by word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_ANY_CASE, Words, bucket_totals, slices, strings

WINDOW, STRIDE = 64, 32
#: Words of a piece of an item at most: any so long stretch of a document stands in one passage whole.
PIECE = WINDOW - STRIDE
#: Latent dimensions; rows that the passages of a slice of documents add up to before they are multiplied; pieces of
#: items searched for in one pass over the documents, which bounds what is broadcast.
RANK, ROWS, PIECES = 128, 256, 4000
DF_BITS = 16
#: The weight of a word that stands in every document; one in few has the logarithm of its rarity more. No word is left out, as a
#: word may be frequent because its item leaks into many documents.
LEAST_IDF = 1.0
#: The pieces' energy in the fit, in units of that of the documents' passages.
ITEM_ENERGY = 10.0
#: A passage is a candidate if its cosine to a piece and the piece's share that it holds reach these: far below the
#: shares of words that make a leak, which verification alone decides on.
LEAST_COSINE, LEAST_SHARE = 0.1, 0.2
#: Share of an item's words, in order, that makes a leak; or the lower share if its answer stands there as well.
LCS, LCS_WITH_ANSWER = 0.7, 0.5


@dataclass
class Item:
    item_id: int
    words: list[int]  # hashes
    answer: list[int]


def lcs(item: dict[int, int], size: int, words: list[int], least: float = 0) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming; item: bits of its places by word.

    Below least, 0 may stand for it: it is no more than the words in common, or the item's less those not in words.
    """
    full = (1 << size) - 1
    v = full
    common = list(filter(None, map(item.get, words)))
    if min(len(common), size - len(item) + len(set(common))) < least:
        return 0
    for m in common:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def places(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def holds(words: list[int], part: list[int]) -> bool:
    """Whether part stands in words consecutively."""
    n = len(part)
    return any(words[i : i + n] == part for i, w in enumerate(words[: len(words) - n + 1]) if w == part[0]) if n else False


def _items(benchmark: DataFrame, text: str, answer: str | None, upto: int):
    """Items in lists of upto pieces, an item more at most. The answer is a column if named, else the last quarter of the item's words."""
    own: list[Item] = []
    size = 0
    for row in benchmark.select("item_id", F.col(text).alias("t"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("a")).where("item_id is not null").toLocalIterator():
        h = [Words(pc.utf8_lower(strings(pa.array([x or ""], pa.string()))), ALNUM_ANY_CASE).hashes().tolist() for x in (row.t, row.a)]
        if h[0]:
            own.append(Item(row.item_id, h[0], h[1] or h[0][-max(1, len(h[0]) // 4) :]))
            size += -(-len(h[0]) // PIECE)
        if size >= upto:
            yield own
            own, size = [], 0
    if own:
        yield own


class Space:
    """The latent space of one list of items: the buckets of their words, weights, and projections of their pieces.

    piece_item, piece_at, piece_size: each piece's item, its first word in it and its words.
    """

    def __init__(self, items: list[Item]):
        self.items = items
        whole = [np.array(i.words, np.uint64) >> np.uint64(64 - DF_BITS) for i in items]
        buckets = [x for b in whole for x in np.array_split(b, -(-len(b) // PIECE))]
        self.piece_item = np.repeat(np.arange(len(items)), [-(-len(b) // PIECE) for b in whole])
        self.piece_size = np.array([len(b) for b in buckets])
        before = np.cumsum(self.piece_size) - self.piece_size
        self.piece_at = before - before[np.searchsorted(self.piece_item, self.piece_item)]
        self.vocabulary = np.unique(np.concatenate(buckets)).astype(np.int64)
        self.row = np.full(1 << DF_BITS, -1, np.int32)
        self.row[self.vocabulary] = np.arange(len(self.vocabulary))
        self.piece_buckets = [b.astype(np.int64) for b in buckets]

    def weigh(self, df: np.ndarray, docs: int) -> None:
        self.idf = np.log((docs + 1) / (df[self.vocabulary] + 1)).clip(min=0).astype(np.float32) + np.float32(LEAST_IDF)
        self.of_piece = [self.row[b].astype(np.int64) for b in self.piece_buckets]

    def rows(self, terms: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
        """Dense TF-IDF rows of n passages."""
        m = len(self.vocabulary)
        return np.bincount(passage * m + terms, minlength=n * m).reshape(n, m).astype(np.float32) * self.idf

    def blocks(self):
        """Rows of the pieces, 256 at a time."""
        for at in range(0, len(self.of_piece), 256):
            some = self.of_piece[at : at + 256]
            yield self.rows(np.concatenate(some), np.repeat(np.arange(len(some)), [len(t) for t in some]), len(some))

    def fit(self, sketch: np.ndarray, omega: np.ndarray, energy: float) -> None:
        """From sketch = A'A omega over the documents' passages; each piece joins with an equal share of ITEM_ENERGY."""
        n = len(self.of_piece)
        z = np.zeros(sketch.shape)
        for a in self.blocks():
            even = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
            z += even.T @ (even @ omega)
        z = sketch + max(1.0, ITEM_ENERGY * energy / n) * z
        shift = 1e-6 * np.linalg.norm(z)
        z = z + shift * omega
        core = omega.T @ z
        ch = np.linalg.cholesky((core + core.T) / 2 + 1e-9 * np.trace(core) * np.eye(len(core)))
        v, _, _ = np.linalg.svd(np.linalg.solve(ch, z.T).T, full_matrices=False)
        self.basis = (v * self.idf[:, None]).astype(np.float32)
        q = np.concatenate([a @ v for a in self.blocks()])
        self.q = q.astype(np.float32)
        self.q_norm = np.maximum(np.linalg.norm(q, axis=1), 1e-9).astype(np.float32)

    def candidates(self, w: Words, h: np.ndarray):
        """(text, first word, piece, cosine) of every candidate passage, in the order of the texts."""
        row = self.row[(h >> np.uint64(64 - DF_BITS)).astype(np.int64)]
        counts = w.counts()
        blocks = -(-counts // STRIDE)
        first = np.cumsum(blocks) - blocks
        doc = w.doc()
        block = first[doc] + (np.arange(len(h)) - w.doc_at[doc]) // STRIDE
        hit = np.flatnonzero(row >= 0)
        row, block = row[hit], block[hit]
        total = int(blocks.sum())
        own_doc = np.repeat(np.arange(len(counts)), blocks)
        for lo in range(0, total, 1024):  # passages of 1024 blocks at a time
            hi = min(total, lo + 1024)
            s = slice(np.searchsorted(block, lo), np.searchsorted(block, hi + 1))
            y = np.zeros((hi + 1 - lo, self.basis.shape[1]), np.float32)
            if s.start < s.stop:
                b = block[s] - lo
                starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                y[b[starts]] = np.add.reduceat(self.basis[row[s]], starts, axis=0)
            window = y[:-1].copy()
            joined = np.flatnonzero(own_doc[lo:hi] == np.r_[own_doc[lo + 1 : hi + 1], np.full(max(0, hi + 1 - total), -1)][: hi - lo])
            window[joined] += y[1:][joined]
            norm = np.maximum(np.linalg.norm(window, axis=1), 1e-9)
            live = np.flatnonzero(norm > LEAST_SHARE * self.q_norm.min())
            dot = window[live] @ self.q.T
            p, i = np.nonzero((dot >= LEAST_COSINE * norm[live][:, None] * self.q_norm) & (dot >= LEAST_SHARE * self.q_norm**2))
            some = self.held(own_doc, block, row, lo + live[p], i)
            p, i = p[some], i[some]
            d = own_doc[lo + live[p]]
            yield d, w.doc_at[d] + (lo + live[p] - first[d]) * STRIDE, i, dot[p, i] / norm[live[p]] / self.q_norm[i]

    def stretch(self, start: int, piece: int) -> tuple[int, int]:
        """Where the whole item stands (first word, last word + 1) if the passage from start on holds its piece.

        An eighth of the item, or STRIDE words, is given on either side. Long items begin on a grid of that width, so
        that their pieces ask for the same stretch.
        """
        n = len(self.items[self.piece_item[piece]].words)
        give = max(STRIDE, n // 8)
        grid = give if n > 4 * PIECE else 1
        lo = (start - int(self.piece_at[piece]) - give) // grid * grid
        return lo, lo + n - int(self.piece_size[piece]) + WINDOW + 2 * give + grid - 1

    def held(self, own_doc: np.ndarray, block: np.ndarray, row: np.ndarray, at: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Candidates (block at, ascending, and piece) whose passage, a block more on either side, has enough words.

        A subsequence misses every word that its stretch lacks, and one piece at least of an item that leaks holds its
        share of it: the others are no leaks.
        """
        m = len(self.vocabulary)
        step = max(1, min((1 << 24) // (m + 1), int(at[-1] - at[0]) + 1 if len(at) else 1))
        out = np.zeros(len(at), bool)
        for first in range(int(at[0]), int(at[-1]) + 1, step) if len(at) else ():
            last = min(len(own_doc), first + step)
            begin, end = np.searchsorted(at, [first, last]).tolist()
            near = np.zeros((last - first, m + 1), bool)  # the last column: no word, for shorter pieces
            for by in (-1, 0, 1, 2):
                s = slice(np.searchsorted(block, first + by), np.searchsorted(block, last + by))
                b, r = block[s], row[s]
                same = own_doc[b - by] == own_doc[b]
                near[b[same] - by - first, r[same]] = True
            for b in range(begin, end, 1 << 16):
                c = slice(b, min(end, b + (1 << 16)))
                found = near.ravel()[((at[c] - first) * (m + 1))[:, None] + self.padded[piece[c]]].sum(1)
                out[c] = found >= LCS_WITH_ANSWER * self.piece_size[piece[c]]
        # The same of whole items, for those of at most two pieces, over their stretch.
        few = np.flatnonzero(out)
        few = few[self.item_size[self.piece_item[piece[few]]] <= 2 * PIECE]
        for first in range(int(at[few[0]]), int(at[few[-1]]) + 1, step) if len(few) else ():
            begin, end = np.searchsorted(at[few], [first, first + step]).tolist()
            s = slice(np.searchsorted(block, first - 2), np.searchsorted(block, first + step + 3))
            has = np.zeros((step + 5, m + 1), bool)
            has[block[s] - first + 2, row[s]] = True
            for b in range(begin, end, 1 << 16):
                c = few[b : min(end, b + (1 << 16))]
                p = piece[c]
                i = self.piece_item[p]
                lo, hi = -((self.piece_at[p] + 2 * STRIDE - 1) // STRIDE), -((self.piece_at[p] + self.piece_size[p] - self.item_size[i] - WINDOW - STRIDE) // STRIDE)
                found = np.zeros((len(c), 2 * PIECE), bool)
                for by in range(-2, 4):
                    x = at[c] + by
                    some = np.flatnonzero((lo <= by) & (by < hi) & (x >= 0) & (x < len(own_doc)))
                    some = some[own_doc[x[some]] == own_doc[at[c[some]]]]
                    found[some] |= has.ravel()[((x[some] - first + 2) * (m + 1))[:, None] + self.padded_item[i[some]]]
                out[c] = found.sum(1) >= LCS_WITH_ANSWER * self.item_size[i]
        return out

    def index(self) -> None:
        """What verification looks up: places of each item's words, words of each piece as rows of the space."""
        self.bits = [places(i.words) for i in self.items]
        self.padded = np.full((len(self.of_piece), PIECE), len(self.vocabulary))
        self.padded_item = np.full((len(self.items), 2 * PIECE), len(self.vocabulary))
        self.item_size = np.array([len(i.words) for i in self.items])
        for p, (t, i, a) in enumerate(zip(self.of_piece, self.piece_item.tolist(), self.piece_at.tolist())):
            self.padded[p, : len(t)] = t
            if self.item_size[i] <= 2 * PIECE:
                self.padded_item[i, a : a + len(t)] = t

    def leaks(self, w: Words, h: np.ndarray) -> dict[tuple[int, int], list]:
        """By text and item: share of the item in order, whether its answer stands there, cosine of the best passage."""
        best: dict[tuple[int, int], list] = {}
        items, piece_item = self.items, self.piece_item.tolist()
        first, end, seen = 0, 0, {}
        for some in self.candidates(w, h):
            for d, start, p, c in zip(*(x.tolist() for x in some)):
                if start >= end:
                    first, end, seen = int(w.doc_at[d]), int(w.doc_at[d + 1]), {}
                i = piece_item[p]
                lo, hi = self.stretch(start - first, p)
                key = (i, first + max(0, lo), min(end, first + hi))
                if key not in seen:
                    words = h[key[1] : key[2]].tolist()
                    n = len(items[i].words)
                    share = lcs(self.bits[i], n, words, LCS_WITH_ANSWER * n) / n
                    seen[key] = (share, share >= LCS_WITH_ANSWER and holds(words, items[i].answer))
                share, there = seen[key]
                if share >= LCS or there:
                    own = best.setdefault((d, i), [0.0, False, 0.0])
                    own[0], own[1], own[2] = max(own[0], share), own[1] or there, max(own[2], c)
        return best


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """One row per document and item that leaks into it: doc_id, item_id, lcs (share of the item's words that stand in
    the document in order, within a stretch of about the item's length), answer (whether the answer stands there) and
    cosine (of the best candidate passage).

    Words are runs of letters, digits and non-ASCII characters, lower-cased. Null and empty texts, items without
    words and null item ids give no row. Repeated rows of docs give a row each; equal items are items of their own.
    Items are taken PIECES pieces at a time, each time in one pass over the documents, so nothing that is broadcast outgrows
    that bound.
    """
    schema = "doc_id bigint, item_id bigint, lcs double, answer boolean, cosine double"
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col(text).alias("text"))
    total, result = None, None
    for items in _items(benchmark, item_text, answer, PIECES):
        total = docs.count() if total is None else total
        one = docs.mapInArrow(_search(_fitted(docs, Space(items), total)), schema)
        result = one if result is None else result.unionByName(one)
    return result if result is not None else spark.createDataFrame([], schema)


def _fitted(docs: DataFrame, space: Space, total: int):
    """The space with weights and basis from docs (doc_id, text), as a broadcast.

    One pass over all documents counts their words and sketches C'C omega, C the words of all passages. The weights,
    known only then, scale rows of the sketch and of omega. A slice's passages add up to ROWS rows at most, each by a
    random sign: products of different passages cancel out on average, and slices of few passages are exact.
    """
    known, m = space.row, len(space.vocabulary)
    rank = min(RANK, m)
    omega = np.random.default_rng(3).standard_normal((m, rank))
    narrow = omega.astype(np.float32)
    at = 1 << DF_BITS  # then the squares of each word's counts, then the sketch
    bits = int(np.ceil(np.log2(at + m + m * rank)))

    def count(batch, counters):
        for _, arr in slices(batch, "text"):
            w = Words(pc.utf8_lower(arr), ALNUM_ANY_CASE)
            h, doc = w.hashes(), w.doc()
            b = (h >> np.uint64(64 - DF_BITS)).astype(np.int64)
            some = np.flatnonzero(known[b] >= 0)
            if not len(some):
                continue
            key = np.unique((doc[some] << DF_BITS) | b[some])
            counters[:at] += np.bincount(key & (at - 1), minlength=at)
            blocks = -(-w.counts() // WINDOW)
            passage = (np.cumsum(blocks) - blocks)[doc[some]] + (some - w.doc_at[doc[some]]) // WINDOW
            n, rows = int(blocks.sum()), max(1, min(ROWS, (1 << 22) // m))
            rng = np.random.default_rng([len(h), int(h[0])])  # so that a task that runs again gives the same
            sign = rng.integers(0, 2, n) * 2.0 - 1 if n > rows else np.ones(n)
            a = np.bincount(passage % rows * m + known[b[some]], sign[passage], rows * m).reshape(rows, m).astype(np.float32)
            counters[at : at + m] += (a**2).sum(0)
            counters[at + m : at + m + m * rank] += (a.T @ (a @ narrow)).ravel()

    got = bucket_totals(docs, count, bits, ["text"], "<f8")
    space.weigh(got[:at], total)
    idf = space.idf.astype(np.float64)
    sketch = got[at + m : at + m + m * rank].reshape(m, rank) * idf[:, None]
    space.fit(sketch, omega / idf[:, None], float(got[at : at + m] @ idf**2))
    return docs.sparkSession.sparkContext.broadcast(space)


def _found(shared, batch: pa.RecordBatch):
    """(rows, their leaks by row number and item) of each slice of the batch."""
    for part, arr in slices(batch, "text", 4 << 20):
        w = Words(pc.utf8_lower(arr), ALNUM_ANY_CASE)
        yield part, shared.leaks(w, w.hashes())


def _search(shared):
    def run(batches):
        sp = shared.value
        sp.index()
        for batch in batches:
            for part, best in _found(sp, batch):
                if best:
                    ids = part.column(0).to_pylist()
                    keys = sorted(best)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[k[0]] for k in keys], pa.int64()), pa.array([sp.items[k[1]].item_id for k in keys], pa.int64()),
                            *(pa.array([best[k][j] for k in keys], t) for j, t in enumerate((pa.float64(), pa.bool_(), pa.float64()))),
                        ],
                        ["doc_id", "item_id", "lcs", "answer", "cosine"],
                    )

    return run


def _clean(shared):
    def run(batches):
        sp = shared.value
        sp.index()
        for batch in batches:
            for part, best in _found(sp, batch):
                keep = np.ones(part.num_rows, bool)
                keep[[d for d, _ in best]] = False
                yield part.filter(pa.array(keep))

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """docs without the rows that an item leaks into, as find_leaks tells.

    Each row is judged by itself while it passes by, so rows of a null or repeated doc_id are judged like any other.
    """
    names, total = docs.columns, None
    rows = docs if text == "text" else docs.withColumn("text", F.col(text))
    for items in _items(benchmark, item_text, answer, PIECES):
        total = docs.count() if total is None else total
        rows = rows.mapInArrow(_clean(_fitted(docs.select("doc_id", F.col(text).alias("text")), Space(items), total)), rows.schema)
    return rows.select(*names)
