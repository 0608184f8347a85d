"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, one verification a pair.

A document is the set of 64-bit hashes of its shingles. Documents of equal sets form a class and only its smallest
doc_id takes part. Sets are put in a global order, rare shingles first, and two sets of similarity t can only reach it
if they share one of their first n - ceil(t n) + 1 shingles. What documents share these prefixes is found by one sort;
a shingle that a single class holds goes no further.

For components, a shingle's documents are first held against one pivot, so a group of m near copies costs m - 1
pairs; then every pair of documents that are still apart is enumerated, which makes the components exact. The plain
join skips the first step and returns every link.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Words, as_long, bucket_totals, components, lists, materialize, mix, release, slices

#: The global order counts shingles in 2**ORDER_BITS buckets; any order is right, rare-first makes few candidates.
ORDER_BITS = 20
#: Bits of the filter that spares most texts a look when sets are fetched, sixteen a document asked for within these
#: bounds (16 MB at most); what passes is joined exactly.
FILTER_BITS = (20, 27)
#: A shingle goes on against pivots while more pairs than this a posting of its own are apart; below, its pairs are all
#: enumerated. All are where a turn leaves more than nine tenths of the pairs, as pivots then do not help.
PAIRS_PER_ROW = 64
#: Pivots of a shingle in each turn but the first: in a loose group a single one links with some of the others only.
PIVOTS = 8
#: Parts of the hash range whose counts the suffix filter compares.
PARTS = 16


def shingles(arr: pa.StringArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text number) of all k-word shingles; a text of fewer words, but one at least, has one of all of them."""
    w = Words(arr, NOT_SPACE)
    h, n, doc = w.hashes(), w.counts(), w.doc()
    at = np.arange(len(h))
    at = at[at + k <= w.doc_at[doc + 1]] if len(h) else at
    acc = np.full(len(at), k, np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[at + j]
    out, of = [mix(acc)], [doc[at]]
    for few in range(1, k):
        d = np.flatnonzero(n == few)
        acc = np.full(len(d), few, np.uint64)
        for j in range(few):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[w.doc_at[d] + j]
        out.append(mix(acc))
        of.append(d)
    return np.concatenate(out), np.concatenate(of)


def sets(arr: pa.StringArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes sorted by text and value, their text numbers, how many each text has)."""
    h, d = shingles(arr, k)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, d, np.bincount(d, minlength=len(arr))


def _signatures(docs: DataFrame, text: str, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, fp1, fp2, parts, grams): set size, two fingerprints of the set, counts by part, prefix in order."""

    def tally(batch, total):
        for _, arr in slices(batch, text):
            h, _d = shingles(arr, k)
            total += np.bincount((h >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=len(total))

    order = docs.sparkSession.sparkContext.broadcast(bucket_totals(docs, tally, ORDER_BITS, [text]).astype(np.uint32))

    def run(batches):
        for batch in batches:
            for part, arr in slices(batch, text):
                h, d, n = sets(arr, k)
                ends = np.cumsum(n)
                some = n > 0
                first = (ends - n)[some]
                fp1, fp2 = np.zeros(len(arr), np.uint64), np.zeros(len(arr), np.uint64)
                if len(h):
                    fp1[some] = np.add.reduceat(mix(h + np.uint64(1)), first)
                    fp2[some] = np.bitwise_xor.reduceat(mix(h + np.uint64(2)), first)
                counts = np.bincount(d * PARTS + (h >> np.uint64(20)).astype(np.int64) % PARTS, minlength=len(arr) * PARTS)
                by = np.lexsort((order.value[(h >> np.uint64(64 - ORDER_BITS)).astype(np.int64)], d))  # stable: then by hash
                length = np.where(some, n - (num * n + den - 1) // den + 1, 0)
                place = np.arange(len(h)) - (ends - n)[d]
                grams = h[by][place < length[d]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(as_long(fp1), pa.int64()), pa.array(as_long(fp2), pa.int64()), lists(counts, np.full(len(arr), PARTS), pa.int32()), lists(as_long(grams), length, pa.int64())],
                    ["doc_id", "n", "fp1", "fp2", "parts", "grams"],
                )

    return docs.select("doc_id", text).mapInArrow(run, "doc_id bigint, n bigint, fp1 bigint, fp2 bigint, parts array<int>, grams array<bigint>")


def _shared(postings: DataFrame) -> DataFrame:
    """The postings (gram, rep, n, pos) whose gram has more than one of them, and a few others.

    Range partitions over (gram, rep) split a gram of many documents; within one, equal grams follow each other, so a
    row is held against its neighbours as the batches stream by. The first and last gram of a partition may go on in
    the next one and always stay.
    """

    def run(batches):
        first = last = pending = None  # the partition's first gram; the last one so far; its row, if it is alone so far
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0).to_numpy(zero_copy_only=False)
            if first is None:
                first = g[0]
            same = g[1:] == g[:-1]
            keep = g == first
            keep[1:] |= same
            keep[:-1] |= same
            if last is not None and g[0] == last:
                keep[0] = True
                if pending is not None:
                    yield pending
            pending = None if keep[-1] else batch.slice(batch.num_rows - 1)
            last = g[-1]
            if keep.any():
                yield batch.filter(pa.array(keep))
        if pending is not None:
            yield pending

    return postings.repartitionByRange("gram", "rep").sortWithinPartitions("gram", "n", "rep").mapInArrow(run, "gram bigint, rep bigint, n bigint, pos int")


def _may_link(na, pa_, nb, pb, num: int, den: int):
    """Length filter; positional filter for a gram at places pa_ and pb: what is left must reach the least overlap."""
    least = F.ceil((F.lit(num) * (na + nb)).cast("double") / (num + den))
    return (F.lit(den) * F.least(na, nb) >= F.lit(num) * F.greatest(na, nb)) & (1 + F.least(na - pa_ - 1, nb - pb - 1) >= least)


class JaccardJoin:
    """Documents that link when den * |intersection| >= num * |union| of their k-word shingle sets.

    docs need doc_id and text; other columns are not read. Documents are told apart by doc_id: rows that repeat an id
    with different texts are one document, which links if one of its texts does. Null and empty texts and texts of white space have the empty
    set and link with nothing, and so do null ids. Texts of any length are used whole.
    """

    def __init__(self, docs: DataFrame, text: str = "text", k: int = 5, num: int = 80, den: int = 100):
        self.docs, self.text, self.k, self.num, self.den = docs.select("doc_id", F.col(text).alias("text")), "text", k, num, den
        self.members = materialize(_signatures(self.docs, "text", k, num, den), "sets")
        whole = self.members.where("n > 0 and doc_id is not null")
        self.reps = materialize(whole.groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep"), F.first("parts").alias("parts")), "reps")
        own = self.reps.select("fp1", "fp2", "n", F.col("rep").alias("doc_id"))
        own = whole.select("fp1", "fp2", "n", "doc_id", "grams").join(own, ["fp1", "fp2", "n", "doc_id"], "left_semi")
        postings = own.select(F.posexplode("grams").alias("pos", "gram"), F.col("doc_id").alias("rep"), "n").select("gram", "rep", "n", "pos")
        self.postings = materialize(_shared(postings), "postings")
        self.scratch: list[DataFrame] = []  # tables that the last verify reads

    def sets(self, ids: DataFrame) -> DataFrame:
        """(rep, set): whole sets of the documents ids (rep), computed again from their texts, and of a few others.

        A bit for each id's hash goes to all tasks; joins with the result drop what passes by chance.
        """
        k = self.k
        bits_used = min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * ids.count()).bit_length()))

        def place(doc_id: str) -> F.Column:
            return F.shiftrightunsigned(F.xxhash64(F.col(doc_id).cast("long")), 64 - bits_used)

        at = ids.select((place("rep") + 1).alias("at"))
        maps = at.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        bits = bytearray((1 << bits_used) // 8)
        for row in maps.collect():  # at most 2**bits_used bits
            bits[(row.block - 1) * len(row.bits) : row.block * len(row.bits)] = row.bits
        shared = self.docs.sparkSession.sparkContext.broadcast(bytes(bits))

        def run(batches):
            asked = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").astype(bool)
            for batch in batches:
                known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                mask = known & asked[batch.column(2).to_numpy(zero_copy_only=False)]
                if mask.any():
                    for part, arr in slices(batch.filter(pa.array(mask)), "text"):
                        h, _, n = sets(arr, k)
                        yield pa.RecordBatch.from_arrays([part.column(0), lists(as_long(h), n, pa.int64())], ["rep", "set"])

        return materialize(self.docs.select("doc_id", "text", place("doc_id").alias("place")).mapInArrow(run, "rep bigint, set array<bigint>"), "candidates")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, after the suffix filter: sets that share enough differ little in any part."""
        num, den = self.num, self.den
        small = self.reps.select("rep", "parts", "n")
        p = pairs.join(small.toDF("a", "parts_a", "n_a"), "a").join(small.toDF("b", "parts_b", "n_b"), "b")
        apart = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
        p = p.where((F.lit(num + den) * (F.col("n_a") + F.col("n_b") - apart)) >= F.lit(2 * num) * (F.col("n_a") + F.col("n_b")))
        p = materialize(p.select("a", "b").distinct(), "filtered")
        whole = self.sets(p.select(F.explode(F.array("a", "b")).alias("rep")))
        self.scratch = [p, whole]
        p = p.join(whole.toDF("b", "set_b"), "b").join(whole.toDF("a", "set_a"), "a")
        both = F.size(F.array_intersect("set_a", "set_b"))
        return p.where(F.lit(den) * both >= F.lit(num) * (F.size("set_a") + F.size("set_b") - both)).select("a", "b").distinct()

    def _apart(self, rows: DataFrame) -> DataFrame:
        """All pairs of one gram's documents under different labels that pass the length and positional filters."""
        x = rows.select("gram", F.col("rep").alias("ra"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("label").alias("la"))
        y = rows.select("gram", F.col("rep").alias("rb"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("label").alias("lb"))
        c = F.col
        return x.join(y, "gram").where((c("ra") < c("rb")) & (c("la") != c("lb")) & _may_link(c("na"), c("pa"), c("nb"), c("pb"), self.num, self.den)).select(c("ra").alias("a"), c("rb").alias("b")).distinct()

    def pairs(self) -> DataFrame:
        """Every link (a, b), a < b, between class representatives."""
        return self.verify(materialize(self._apart(self.postings.withColumn("label", F.col("rep"))), "pairs"))

    def _pivots(self, rows: DataFrame, turn: int) -> DataFrame:
        """Pairs of each gram's documents with its pivots.

        A document whose place of the gram is low has few shingles rarer than it: the middle of a group of edited copies
        rather than one of the copies. So the first turn takes the lowest place, whatever the ids; further turns the
        labels that come first in orders of their own, and of those the lowest place or, every other time, any document.
        """
        seeds = [F.lit(turn * PIVOTS + i) for i in range(PIVOTS)]
        orders = [(F.xxhash64("label", x), F.xxhash64("rep", x) if i % 2 else F.struct("pos", "rep")) for i, x in enumerate(seeds)] if turn else [(F.col("pos"), F.col("rep"))]
        row = ("label", "rep", "n", "pos")
        first = F.array(*(F.struct(*(F.min(F.struct(k.alias("key"), r.alias("then"), *row))[x].alias(x) for x in row)) for k, r in orders))
        top = rows.groupBy("gram").agg(first.alias("p"), F.max("label").alias("hi"), F.min("label").alias("lo"))
        top = top.where("lo < hi").select(F.col("gram").alias("g"), F.explode("p").alias("p"))
        c = F.col
        met = rows.join(top, c("gram") == c("g")).where((c("label") != c("p.label")) & _may_link(c("n"), c("pos"), c("p.n"), c("p.pos"), self.num, self.den))
        return met.select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b")).distinct()

    def links(self) -> DataFrame | None:
        """Links that connect whatever is connected, or None; (a, b) between class representatives."""
        rows = self.postings.withColumn("label", F.col("rep"))
        done = found = before = None
        spent: list[DataFrame] = []  # tables that this turn reads for the last time
        for turn in itertools.count():
            if not turn:
                new, last = self._pivots(rows, 0), False
            else:
                per = rows.groupBy("gram", "label").agg(F.count("*").cast("double").alias("m")).groupBy("gram").agg(((F.sum("m") ** 2 - F.sum(F.col("m") ** 2)) / 2).alias("left"), F.sum("m").alias("m"))
                per = materialize(per.where("left > 0").withColumn("many", F.col("left") > PAIRS_PER_ROW * F.col("m")), "apart")
                every, left = per.agg(F.count("*"), F.sum(F.when(F.col("many"), F.col("left")))).first()
                if not every:
                    break
                last = left is None or before is not None and left > 0.9 * before
                before = left
                own = lambda grams: rows.join(grams.select("gram"), "gram", "left_semi")  # noqa: E731, B023
                new = self._apart(own(per) if last else own(per.where("not many")))
                spent = [rows, per]
                if not last:
                    rows = materialize(own(per.where("many")), "labels")
                    new = new.unionByName(self._pivots(rows, turn)).distinct()
            new = materialize(new if done is None else new.join(done, ["a", "b"], "left_anti"), "pairs")
            release(*spent)
            links = materialize(self.verify(new), "links")
            release(*self.scratch)
            found = links if found is None else found.unionByName(links)
            if last:
                break
            done = new if done is None else done.unionByName(new)
            label = components(found)
            spent = [rows] if turn else []
            rows = materialize(rows.drop("label").join(label, F.col("rep") == F.col("node"), "left").select("gram", "rep", "n", "pos", F.coalesce("component", "rep").alias("label")), "labels")
            release(*spent)
        return found

    def documents(self) -> DataFrame:
        """One row per row of docs: doc_id, n_shingles, class_id (smallest id of its equal set) and component_id."""
        out = self.members.select("doc_id", F.col("n").alias("n_shingles"), "fp1", "fp2")
        out = out.join(self.reps.select("fp1", "fp2", F.col("n").alias("n_shingles"), "rep"), ["fp1", "fp2", "n_shingles"], "left")
        out = out.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
        links = self.links()
        if links is None:
            return out.select("doc_id", "n_shingles", "class_id", F.col("class_id").alias("component_id"))
        return out.join(components(links), F.col("class_id") == F.col("node"), "left").select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
