"""Shared ground of the training-data operators: word scans over Arrow buffers, bounded sketches, shared-folder tables.

Words are found on the UTF-8 bytes of a whole Arrow column at once, so no operator loops over characters in
Python. A word is a maximal run of bytes that a 256-entry table accepts; since every byte of a multi-byte
character is at or above 0x80, run borders always fall between characters.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in text whose A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
ALNUM_ANY_CASE = ALNUM.copy()
ALNUM_ANY_CASE[0x41:0x5B] = True

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[0x41:0x5B] = _BYTE[0x61:0x7B]
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a local one only where that is unset and there is one process (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    d = d or spark.conf.get("leafmill.shared.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("leafmill.shared.dir", d)  # spark.checkpoint.dir cannot be set in a running session
    return d


#: With it Spark removes the shuffle files of an execution when that ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, what: str = "t") -> DataFrame:
    """Cuts the lineage: df written once as Parquet in the shared folder and read again with the same schema.

    What was shuffled for it is of no use once the table is there, so those files go at once, not when the driver
    happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables of materialize. Only for those that no plan still to be run reads, also after a lost executor: what
    was made of them must be written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash depends on every bit of its input."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    have = 1
    while have <= n:
        step = np.uint64(pow(base, have, 2**64))
        more = min(have, n + 1 - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out


#: Bytes hashed at a time, so that arrays of 64-bit numbers stay in cache; powers for such a stretch are kept.
_STRETCH = 1 << 18
_kept_powers: dict[int, np.ndarray] = {}


def _powers_upto(base: int, n: int) -> np.ndarray:
    if n > 2 * _STRETCH:
        return _powers(base, n)
    if base not in _kept_powers:
        _kept_powers[base] = _powers(base, 2 * _STRETCH)
    return _kept_powers[base][: n + 1]


def strings(col: pa.Array) -> pa.StringArray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.cast(pa.string()).fill_null("")


def raw_bytes(arr: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts on end, and where each text starts (one more entry: the end)."""
    n = len(arr)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int32, n + 1, arr.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return buf, off - off[0]


class Words:
    """The words of a column of texts.

    start, end: byte borders of each word in data; doc_at: the first word of each text (one more entry: the end).
    """

    def __init__(self, arr: pa.StringArray, accept: np.ndarray):
        self.data, self.off = raw_bytes(arr)
        inside = accept[self.data]
        before, after = np.empty_like(inside), np.empty_like(inside)
        if len(inside):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            first = self.off[:-1][self.off[:-1] < len(inside)]
            before[first] = False
            last = self.off[1:] - 1
            after[last[last >= 0]] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc_at = np.searchsorted(self.start, self.off)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.doc_at)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), self.counts())

    def hashes(self, folded: bool = True, most: int = 0) -> np.ndarray:
        """64-bit hashes of the words; folded: with A-Z lower-cased. Equal words have equal hashes in any batch.

        most: if not 0, hashes of the first so many bytes of each word, apart from those of whole words.
        """
        if not len(self):
            return np.zeros(0, np.uint64)
        out = np.empty(len(self), np.uint64)
        begin = 0
        while begin < len(self):
            stop = max(begin + 1, int(np.searchsorted(self.end, self.start[begin] + _STRETCH, "right")))
            lo, hi = self.start[begin], self.end[stop - 1]
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((_FOLDED if folded else _BYTE)[self.data[lo:hi]] * _powers_upto(_P, hi - lo)[:-1], out=sums[1:])
            s, e = self.start[begin:stop] - lo, self.end[begin:stop] - lo
            if most:
                e = np.minimum(e, s + most)
            out[begin:stop] = mix(np.uint64(most << 32) + (sums[e] - sums[s]) * _powers_upto(_P_INV, hi - lo)[s] + (e - s).astype(np.uint64))
            begin = stop
        return out


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Pieces of a batch of about `most` bytes of text each (one longer text is a piece of its own): bounded memory."""
    arr = strings(batch.column(batch.schema.get_field_index(column)))
    _, off = raw_bytes(arr)
    at = 0
    while at < len(arr):
        stop = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, stop - at), arr.slice(at, stop - at)
        at = stop


def schema_with(df: DataFrame, kept: list[str], added: str) -> str:
    """DDL of the columns kept of df, followed by those added."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema), added])


def carry(part: pa.RecordBatch, kept: list[str], added: list[str], new: list[pa.Array]) -> pa.RecordBatch:
    """The columns kept of part, followed by new ones."""
    return pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), *new], [*kept, *added])


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))


def held_out(doc_id) -> F.Column:
    """crc32 of doc_id as text, mod 5, is 0; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """All labelled ids outside the held-out fold: (doc_id, label).

    An id with several rows has the largest of its labels; null ids and labels are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def training_sample(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most max_rows of training_labels, those of the smallest id hashes.

    max_rows is the documented bound of everything that is fitted on them, and so of what a broadcast of them holds.
    """
    return training_labels(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def bucket_totals(df: DataFrame, count_batch, bits: int, columns: list[str], kind: str = "<i8") -> np.ndarray:
    """Totals of 2**bits counters over all rows of df, on the driver: 8 * 2**bits bytes at any input size.

    count_batch(batch, counters) adds a record batch to an array of kind (64-bit integers or floats). Each task sends its counters in blocks of
    2**12; those of up to 1024 tasks are added up in one group, the sums of the groups on the driver.
    """
    size, width = 1 << bits, 1 << min(bits, 12)

    def per_task(batches):
        from pyspark import TaskContext

        total = np.zeros(size, kind)
        for b in batches:
            count_batch(b, total)
        part = TaskContext.get().partitionId() // 1024
        blocks = [i for i in range(size // width) if total[i * width : (i + 1) * width].any()]
        for at in range(0, len(blocks), 64):
            some = blocks[at : at + 64]
            data = [total[i * width : (i + 1) * width].tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(data, pa.binary())], ["part", "block", "counts"])

    def add(pdf):
        total = np.zeros(width, kind)
        for x in pdf["counts"]:
            total += np.frombuffer(x, kind)
        return pdf.iloc[:1].assign(counts=[total.tobytes()])

    schema = "part int, block int, counts binary"
    blocks = df.select(*columns).mapInArrow(per_task, schema)
    blocks = blocks.groupBy("part", "block").applyInPandas(add, schema)
    total = np.zeros(size, kind)
    for row in blocks.select("block", "counts").collect():
        total[row.block * width : (row.block + 1) * width] += np.frombuffer(row.counts, kind)
    return total


#: Of the nodes of a graph at most this many have more edges than its heavy_bound allows: their rows are broadcast.
HEAVY_NODES = 10_000


def heavy_bound(edges: int) -> int:
    """Edges that a node may have before it counts as heavy: the sum of all degrees leaves room for HEAVY_NODES such nodes."""
    return max(64, 2 * edges // HEAVY_NODES)


def _state(sym: DataFrame) -> tuple[int, int, int]:
    """(edges, a checksum of them, the largest degree) of edges (a, b)."""
    per = sym.groupBy("a").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h"))
    row = per.agg(F.sum("n"), F.sum("h"), F.max("n")).first()
    return row[0] or 0, row[1] or 0, row[2] or 0


def _lowest(sym: DataFrame, edges: int, most: int) -> DataFrame:
    """Edges (a, b) with m, the smallest of a and its neighbours. edges: how many there are; most: the largest degree.

    The minimum is a partial aggregate. A heavy node, the centre of a star, would bring all its edges to one task of the
    join: the minima of the heavy nodes are broadcast instead, HEAVY_NODES at most, and their edges go where b hashes to.
    """
    low = sym.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"), "degree")
    bound = heavy_bound(edges)
    if most <= bound:
        return sym.join(low, F.col("a") == F.col("u")).select("a", "b", "m")
    heavy = F.broadcast(low.where(F.col("degree") > bound).select(F.col("u").alias("hu"), F.col("m").alias("hm")))
    light = low.where(F.col("degree") <= bound).select("u", "m")
    marked = sym.join(heavy, F.col("a") == F.col("hu"), "left").withColumn("at", F.when(F.col("hm").isNull(), F.col("a")).otherwise(F.col("b")))
    return marked.join(light, F.col("at") == F.col("u"), "left").select("a", "b", F.coalesce("hm", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b): (node, component), component the smallest node reachable.

    Alternating large-star and small-star steps; no neighbour list is ever gathered and the edges of a star are not
    brought together. Edges of each step are written to the shared folder. Null ends and loops are left out.
    """
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    both = lambda: e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    before = _state(both())
    while before[0]:
        large = _lowest(both(), before[0], before[2]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large, "large")
        n, _, most = _state(large)
        old = e
        small = _lowest(large, n, most).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s")).select("s.*")
        e = materialize(small.where("a != b").distinct(), "edges")
        release(old, large)
        now = _state(both())
        if now == before:
            break
        before = now
    return e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
