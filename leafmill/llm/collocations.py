"""Phrase collocations: phrases of two to four words by how well they hold together at their weakest cut.

Identical pieces of text become one row with a multiplicity. Tasks cut the pieces into runs of up to four words, add up
equal runs and send them as compressed Arrow tables to hash buckets by their first two words, so every n-gram of two
words and more is counted whole in one bucket. A bucket is counted by DuckDB in one task, in a bounded memory beyond
which it spills to the shared folder; longer n-grams are counted only where the shorter ones they begin with are frequent. The parts of candidates
are looked up by shuffled requests. Word pairs that would fill a bucket are told beforehand and dealt by their third word.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, Words, bucket_totals, materialize, mix, release, shared_dir, strings

#: Characters that end a piece, and those between the words of one.
CUT, GAP = r"[.,;:!?\x0A-\x0D]+", r"[\x20\x09]+"
#: The longest phrase, in words.
WORDS = 4
#: Runs of words in one bucket, about, and the most buckets; the memory that counting one may take before it spills.
BUCKET_RUNS, MOST_BUCKETS, MEMORY = 1 << 20, 1 << 16, "384MB"
#: Runs that a task adds up before it sends them.
FLUSH_RUNS = 1 << 20
#: Pairs are told heavy by 2**PAIR_BITS counters: those whose counter has more than 1 / HEAVY of all runs.
PAIR_BITS, HEAVY = 16, 256
#: Parts of a word that is looked up, and of the requests for it.
DEALS = 16


def pieces(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, piece, m): the distinct pieces of all texts, words set apart by one space, and how often each occurs."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(F.regexp_replace(low, GAP, " "), CUT)).alias("piece"))
    return own.select("lang", F.trim("piece").alias("piece")).where("piece != ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


class Runs:
    """The words of a batch (lang, piece, ...): words, what each is (code), the language of each, how many its piece still has from it on."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        lang, text = (strings(batch.column(i)) for i in range(2))
        w = Words(text, NOT_SPACE)
        spelt = pa.StringArray.from_buffers(len(w), pa.py_buffer(np.append(w.start, len(w.data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(w.data)))
        spelt = pc.utf8_rtrim(spelt, characters=" ").dictionary_encode()
        self.words, self.code = spelt.dictionary, spelt.indices.to_numpy().astype(np.int64)
        self.piece = w.doc()
        self.left = w.doc_at[1:][self.piece] - np.arange(len(w))
        langs = lang.dictionary_encode()
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy().astype(np.int64)[self.piece]
        self.hash = Words(self.words, NOT_SPACE).hashes(folded=False)
        self.lang_hash = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in self.langs.to_pylist()], np.uint64)

    def key(self, lang: np.ndarray, *codes: np.ndarray) -> np.ndarray:
        """A hash of a language and words."""
        h = self.lang_hash[lang]
        for c in codes:
            h = mix(h * np.uint64(31) + self.hash[c])
        return h

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs of two words and more begin, and the hash of each one's first two."""
        at = np.flatnonzero(self.left > 1)
        return at, self.key(self.lang[at], self.code[at], self.code[at + 1])


def _heavy_pairs(found: DataFrame) -> np.ndarray:
    """The counters of word pairs that more than 1 / HEAVY of all runs begin with: fewer than HEAVY."""

    def count(batch, total):
        total += np.bincount((Runs(batch).pairs()[1] & np.uint64((1 << PAIR_BITS) - 1)).astype(np.int64), minlength=1 << PAIR_BITS)

    total = bucket_totals(found, count, PAIR_BITS, ["lang", "piece"])
    return np.flatnonzero(total > total.sum() / HEAVY)


def _summed(runs: Runs, codes: list[np.ndarray], lang: np.ndarray, m: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Equal runs added up. codes: of the words, -1 for none."""
    width = np.int64(len(runs.words) + 1)
    keys = [lang * width + codes[0] + 1, *((a + 1) * width + b + 1 for a, b in zip(codes[1::2], codes[2::2]))] if len(codes) > 1 else [lang * width + codes[0] + 1]
    if len(codes) % 2 == 0:
        keys.append(codes[-1])
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    first = np.flatnonzero(new)
    at = order[first]
    return [c[at] for c in codes], lang[at], np.add.reduceat(m[order], first) if len(first) else m[:0]


def _tables(some: pa.Table, buckets: int, heavy: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, compressed table) of the runs of some pieces: (lang, w1..w4, m, dealt).

    Single words are counted from rows without w2; rows with it count for runs of two words and more that they begin
    with, if dealt for those of three and more: what a heavy pair itself occurs is sent as a row of two words.
    """
    runs = Runs(some)
    m = some.column(2).combine_chunks().to_numpy()[runs.piece]
    none = lambda n: np.full(n, -1, np.int64)
    codes, lang, sums = _summed(runs, [runs.code], runs.lang, m)
    out = [(codes + [none(len(sums))] * 3, lang, sums, np.zeros(len(sums), bool), runs.key(lang, *codes))]
    at, key = runs.pairs()
    following = [np.where(runs.left[at] > i, runs.code[np.minimum(at + i, len(runs.code) - 1)], -1) for i in range(WORDS)]
    codes, lang, sums = _summed(runs, following, runs.lang[at], m[at])
    key = runs.key(lang, codes[0], codes[1])
    hot = np.isin((key & np.uint64((1 << PAIR_BITS) - 1)).astype(np.int64), heavy)
    if hot.any():
        two, own, n = _summed(runs, [c[hot] for c in codes[:2]], lang[hot], sums[hot])
        out.append((two + [none(len(n))] * 2, own, n, np.zeros(len(n), bool), runs.key(own, *two)))
        long = hot & (codes[2] >= 0)
        out.append(([c[long] for c in codes], lang[long], sums[long], np.ones(long.sum(), bool), runs.key(lang[long], *(c[long] for c in codes[:3]))))
    rest = ~hot
    out.append(([c[rest] for c in codes], lang[rest], sums[rest], np.zeros(rest.sum(), bool), key[rest]))
    columns = [np.concatenate([x[0][i] for x in out]) for i in range(WORDS)]
    lang, sums, dealt, key = (np.concatenate([x[i] for x in out]) for i in range(1, 5))
    bucket = (key >> np.uint64(PAIR_BITS)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    borders = np.searchsorted(bucket[order], np.arange(buckets + 1).astype(np.uint64))
    word = lambda c: runs.words.take(pa.array(c, mask=c < 0))
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for b in np.flatnonzero(np.diff(borders)):
        i = order[borders[b] : borders[b + 1]]
        t = pa.table({"lang": runs.langs.take(pa.array(lang[i])), **{f"w{k + 1}": word(c[i]) for k, c in enumerate(columns)}, "m": sums[i], "dealt": dealt[i]})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=options) as writer:
            writer.write_table(t)
        yield int(b), sink.getvalue().to_pybytes()


def _count(blobs: Iterator[bytes], least: int, folder: str) -> pa.Table:
    """(lang, phrase, words, f) of the n-grams of one bucket that occur `least` times and more. folder: where DuckDB may
    spill; empty: nowhere, so that a bucket beyond MEMORY fails rather than fill a local disk."""
    import duckdb

    temp = f"{folder}/{uuid.uuid4().hex}" if folder else ""
    if temp:
        os.makedirs(temp)  # DuckDB makes it when it first spills, but no folder above it
    con = duckdb.connect(":memory:", config={"memory_limit": MEMORY, "threads": 1, "temp_directory": temp, "preserve_insertion_order": "false"})
    try:
        con.execute("create table r (lang varchar, w1 varchar, w2 varchar, w3 varchar, w4 varchar, m bigint, dealt boolean)")
        for blob in blobs:
            con.register("sent", pa.ipc.open_stream(blob).read_all())
            con.execute("insert into r select * from sent")
            con.unregister("sent")
        con.execute(f"create table f2 as select lang, w1, w2, sum(m) as f from r where w2 is not null and not dealt group by all having sum(m) >= {least}")
        begin = "r where (dealt or exists (select 1 from f2 where f2.lang = r.lang and f2.w1 = r.w1 and f2.w2 = r.w2))"
        con.execute(f"create table f3 as select lang, w1, w2, w3, sum(m) as f from {begin} and w3 is not null group by all having sum(m) >= {least}")
        begin = "r where exists (select 1 from f3 where f3.lang = r.lang and f3.w1 = r.w1 and f3.w2 = r.w2 and f3.w3 = r.w3)"
        f4 = f"select lang, concat_ws(' ', w1, w2, w3, w4) as phrase, 4 as words, sum(m) as f from {begin} and w4 is not null group by lang, w1, w2, w3, w4 having sum(m) >= {least}"
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return con.execute(
                f"""select lang, phrase, words::int as words, f::bigint as f from (
                select lang, w1 as phrase, 1 as words, sum(m) as f from r where w2 is null group by all having sum(m) >= {least}
                union all select lang, w1 || ' ' || w2, 2, f from f2 union all select lang, w1 || ' ' || w2 || ' ' || w3, 3, f from f3 union all {f4})"""
            ).to_arrow_table()
    finally:
        con.close()
        if temp:
            shutil.rmtree(temp, ignore_errors=True)


def frequent(found: DataFrame, runs: int, least: int) -> DataFrame:
    """(lang, phrase, words, f): all n-grams of up to four words of the pieces (lang, piece, m) that occur `least` times
    and more. runs: words of all distinct pieces, by which the number of buckets is chosen."""
    spark = found.sparkSession
    buckets, heavy = max(1, min(MOST_BUCKETS, -(-runs // BUCKET_RUNS))), _heavy_pairs(found)
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    folder = f"{folder}/leafmill/duckdb" if os.path.isdir(folder) else ""

    def cut(batches):
        some, size = [], 0

        def sent():
            for bucket, data in _tables(pa.Table.from_batches(some), buckets, heavy):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], ["bucket", "data"])

        for b in batches:
            some.append(b)
            size += b.column(1).nbytes
            if size >= 6 * FLUSH_RUNS:
                yield from sent()
                some, size = [], 0
        if some:
            yield from sent()

    def count(batches):
        rows = ((b.column(0)[i].as_py(), b.column(1)[i].as_py()) for b in batches for i in range(b.num_rows))
        row = next(rows, None)
        while row:
            bucket = row[0]

            def own():
                nonlocal row
                while row and row[0] == bucket:
                    yield row[1]
                    row = next(rows, None)

            yield from _count(own(), least, folder).cast(_GRAMS).to_batches()

    sent = found.select("lang", "piece", "m").mapInArrow(cut, "bucket int, data binary")
    return sent.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "lang string, phrase string, words int, f bigint")


_GRAMS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])


def _some(words: Column, first, length) -> Column:
    return F.array_join(F.slice(words, first, length), " ")


def _exact(x: str) -> Column:
    return F.col(x).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score, then a, then phrase in byte order.

    Texts are lower-cased (A-Z) and cut into pieces and words as CUT and GAP say; a null text is empty, a null language
    `und`. n: words of the language; a, l, r: how often the phrase and the two parts at its weakest cut occur,
    overlapping ones included; score: floor(2,000,000 a / (l + r)), the lowest of all cuts, of equal ones the earliest. Phrases
    that occur less than `least` times are no candidates. A candidate within a longer one that occurs at least 0.8
    times as often is dropped, whether that one is dropped or not. Repeated rows count each; an empty table gives no rows.
    """
    found = materialize(pieces(docs), "pieces")
    per = found.withColumn("words", (F.length("piece") - F.length(F.translate("piece", " ", "")) + 1).cast("long"))
    langs = materialize(per.groupBy("lang").agg(F.sum(F.col("words") * F.col("m")).alias("n"), F.sum("words").alias("runs")), "langs")
    grams = materialize(frequent(found, langs.agg(F.sum("runs")).first()[0] or 0, least), "grams")
    release(found)
    candidates = grams.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", F.split("phrase", " ").alias("w"))

    cuts = candidates.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    sides = F.array(F.struct(F.lit(True).alias("first"), _some(F.col("w"), F.lit(1), F.col("cut")).alias("part")), F.struct(F.lit(False).alias("first"), _some(F.col("w"), F.col("cut") + 1, F.col("words") - F.col("cut")).alias("part")))
    asked = cuts.select("lang", "phrase", "a", "cut", F.explode(sides).alias("s")).select("lang", "phrase", "a", "cut", "s.*")
    asked = asked.withColumn("deal", F.when(F.instr("part", " ") == 0, F.pmod(F.xxhash64("phrase"), F.lit(DEALS)).cast("int")).otherwise(0))
    known = grams.select("lang", F.col("phrase").alias("part"), "f", F.explode(F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(DEALS - 1))).otherwise(F.array(F.lit(0)))).alias("deal"))
    told = asked.join(known, ["lang", "part", "deal"]).groupBy("lang", "phrase", "cut").agg(F.max("a").alias("a"), F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    told = told.withColumn("score", F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    scored = told.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("at")).select("lang", "phrase", "a", "at.l", "at.r", "at.score")

    within = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: _some(F.col("w"), i, k))))
    longer = candidates.where("words > 2").select("lang", F.explode(within).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * _exact("longer") < 80 * _exact("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(langs, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
