"""Streams with removals, cached vectors, providers, images, differences, measured actions."""

import base64

from pyspark.sql import functions as F

from leafmill.operators import documents, evaluation
from leafmill.sources import images
from leafmill.streaming import ingest


def test_versions_with_removals_and_replays(spark, tmp_path):
    schema = "doc_id long, version long, chunk_id string, hash string"
    steps = [
        [(1, 0, "a", "x"), (1, 0, "b", "y"), (2, 0, "a", "z")],
        [(1, 1, "a", "x2"), (1, 1, "c", "w"), (2, 1, None, None)],  # b goes, a changes, document 2 goes
        [(1, 0, "b", "y"), (1, 1, "c", "w")],  # old versions again
        [(2, 2, "a", "z"), (3, 5, "q", "1"), (3, 6, "q", "2"), (3, 6, "r", "3"), (3, 7, "r", "3")],  # 2 comes back; three versions at once
    ]
    for rows in steps:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    want = {(1, "a", "x2"), (1, "c", "w"), (2, "a", "z"), (3, "r", "3")}
    assert {(r.doc_id, r.chunk_id, r.hash) for r in ingest.latest(spark, f"{tmp_path}/out").collect()} == want
    told = sorted((r.doc_id, r.version, r.chunk_id, r.status) for r in spark.read.parquet(f"{tmp_path}/out/batch=*").collect())
    assert told == sorted([(1, 0, "a", "new"), (1, 0, "b", "new"), (2, 0, "a", "new"), (1, 1, "a", "changed"), (1, 1, "c", "new"), (1, 1, "b", "removed"), (2, 1, "a", "removed"), (2, 2, "a", "new"), (3, 5, "q", "new"), (3, 6, "q", "changed"), (3, 6, "r", "new"), (3, 7, "q", "removed")])
    assert {(r.doc_id, r.chunk_id, r.hash) for r in ingest.compact(spark, f"{tmp_path}/out", f"{tmp_path}/small").collect()} == want
    assert spark.read.parquet(f"{tmp_path}/small/batch=*").count() == 4


def test_documents_of_a_group_share_a_state(spark, tmp_path):
    schema = "doc_id long, version long, chunk_id string, hash string"
    ids = [None, 0, 2**60 + 1, *range(1, 40)]
    for version in range(2):  # then every third loses its second chunk, and the null one goes
        rows = [(d, version, c, f"{d}{c}") for i, d in enumerate(ids) for c in ("a", "b") if not version or (i and (i % 3 or c == "a"))]
        spark.createDataFrame([*rows, *([(None, 1, None, None)] if version else [])], schema).write.mode("append").parquet(f"{tmp_path}/in")
        q = ingest.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/at", groups=2)
        q.awaitTermination()
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
    want = {(d, c, f"{d}{c}") for i, d in enumerate(ids) for c in ("a", "b") if i and (i % 3 or c == "a")}
    assert {(r.doc_id, r.chunk_id, r.hash) for r in ingest.latest(spark, f"{tmp_path}/out").collect()} == want


def test_vectors_are_made_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def provider(texts):
        calls.add(len(texts))
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, None), (4, "b")], "chunk_id long, text string")
    cache = spark.createDataFrame([], "model string, hash string, vector array<float>")
    for model, kind, more, made in (("nomic-1", "query", 14, 3), ("plain", "document", 0, 3), ("BGE-m", "query", 57, 3), ("bge-m", "document", 0, 3)):
        before = calls.value
        vectors, fresh = evaluation.embed_cached(rows, cache, provider, model, kind)
        fresh.write.parquet(f"{tmp_path}/{model}-{kind}")
        assert calls.value - before == made
        cache = cache.unionByName(spark.read.parquet(f"{tmp_path}/{model}-{kind}"))
        again, none = evaluation.embed_cached(rows, cache, provider, model, kind)
        assert none.count() == 0 and {r.chunk_id: r.vector[0] for r in again.collect()} == {1: 2.0 + more, 2: 2.0 + more, 3: 0.0 + more, 4: 1.0 + more}
        assert calls.value - before == made


def test_a_failing_provider_loses_no_row(spark):
    shown = spark.sparkContext.accumulator(0)

    @evaluation.provider("caption")
    def caption(some):
        shown.add(len(some))
        if b"bad" in some:
            raise OSError("no answer")
        return [None if x == b"blank" else x.decode() for x in some]

    @evaluation.provider("short")
    def short(some):
        return ["one"]

    rows = spark.createDataFrame([(1, b"a"), (2, b"bad"), (3, b"a"), (4, None), (5, b"blank"), (6, b"bad")], "k long, content binary").coalesce(1)
    got = {r.k: (r.told, r.error) for r in evaluation.provided(rows, "caption").collect()}
    assert got == {1: ("a", None), 3: ("a", None), 2: (None, "OSError: no answer"), 6: (None, "OSError: no answer"), 4: (None, None), 5: (None, None)}
    assert 3 <= shown.value <= 10  # equal bytes once, a failed batch twice, then one by one
    assert {r.told for r in evaluation.provided(rows.where("k in (1, 5)"), "short", batch=1).collect()} == {"one"}
    assert {r.told for r in evaluation.provided(rows.where("k in (1, 5)"), "short").collect()} == {"one"}  # a batch of wrong length is shown one by one


def test_images_in_markdown(spark):
    text = "![a](pic.png)![b](  ../up/p.JPG 'title') ![c](/root/c.svg) ![d](http://x/p.png) ![e](data:x) ![f](../../../out.png) ![g](gone.gif) end ![h](C:\\w\\h.bin)"
    docs = spark.createDataFrame([("/d/md/t.md", text), ("/d/md/u.md", "no image"), ("v.md", "![](pic.png)"), ("w.md", None)], "file string, value string")
    files = spark.createDataFrame([("/d/md/pic.png", b"1"), ("/d/up/p.JPG", b"2"), ("/root/./c.svg", b"3"), ("/out.png", b"4"), ("pic.png", b"5"), ("C:/w/h.bin", b"6")], "path string, content binary")
    got = {r.file: r.value for r in images.inline_images(docs, files).collect()}
    url = lambda kind, b: f"data:{kind};base64,{base64.b64encode(b).decode()}"
    want = f"![a]({url('image/png', b'1')})![b]({url('image/jpeg', b'2')} 'title') ![c]({url('image/svg+xml', b'3')}) ![d](http://x/p.png) ![e](data:x) ![f](../../../out.png) ![g](gone.gif) end ![h]({url('application/octet-stream', b'6')})"
    assert got == {"/d/md/t.md": want, "/d/md/u.md": "no image", "v.md": f"![]({url('image/png', b'5')})", "w.md": None}
    refs = {r.src: r.path for r in images.image_refs(docs).where("file = '/d/md/t.md'").collect()}
    assert refs["../up/p.JPG"] == "/d/up/p.JPG" and refs["../../../out.png"] is None and refs["http://x/p.png"] is None


def test_differences(spark):
    schema = "doc_id long, page int, n int, type string, text string, font string, shape string"
    a = [(1, 1, 0, "text", "Some  words here", "'Arial', serif", None), (1, 1, 1, "table", "x y", None, "3×2"), (1, 2, 2, "image", None, None, None)] + [(2, 1, i, "shape", None, None, None) for i in range(40)]
    b = [(1, 1, 0, "text", "here some words", "Times", None), (1, 1, 1, "table", "x z", None, "3×3"), (1, 1, 3, "list", "new", None, None)] + [(2, 1, i, "shape", None, None, None) for i in range(36)]
    got = documents.differences(*(documents.fingerprints(spark.createDataFrame(x, schema)) for x in (a, b))).collect()
    facts = {(r.doc_id, r.page, r.what, r.name): (r.was, r.now) for r in got if r.what != "text"}
    assert facts == {
        (1, 1, "font", "Arial"): (1, 0), (1, 1, "font", "Times"): (0, 1), (1, 1, "table", "3×2"): (1, 0), (1, 1, "table", "3×3"): (0, 1), (1, 1, "type", "list"): (0, 1), (1, 1, "words", ""): (5, 6),
    }
    assert [(r.doc_id, r.was, r.now) for r in got if r.what == "text" and r.now] == [(1, 0, 6)]


def test_measured(spark):
    df, seen = evaluation.measured(spark.range(100).withColumn("tokens", F.col("id") % 3))
    assert df.where("id > 50").count() == 49 and seen.get == {"rows": 100, "tokens": 99}
