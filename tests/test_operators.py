"""Operators on hand-made documents."""

import json
import random

from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import chunking, documents, elements, layout, retrieval
from leafmill.sources import readers, writers


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    c = F.col("s")
    assert one(spark, tx.utf16_len(c), s="a😀") == 3
    assert one(spark, tx.trim_all(c), s="  a b﻿ ") == "a b"
    assert one(spark, tx.terms(c), s="Été, naïve-2") == ["ete", "naive", "2"]
    assert [one(spark, tx.clock(F.lit(x))) for x in (5.4, 65.0, 3661.0)] == ["00:05", "01:05", "1:01:01"]
    assert [one(spark, tx.seconds(c), s=x) for x in ("00:01,500", "1:00:02.25", "x")] == [1.5, 3602.25, None]
    assert one(spark, tx.caption_stamp(F.lit(3661.5))) == "01:01:01.500"
    assert one(spark, tx.pdf_date(c), s="D:20240102030405+02'00'") == "2024-01-02T01:04:05Z"
    assert one(spark, tx.rgb_hex(F.lit(255), F.lit(0), F.lit(16))) == "#ff0010"
    assert one(spark, tx.mime(c), s="a/b.PNG") == "image/png"
    assert one(spark, tx.fill_template(c, page=F.lit(3)), s="p {{page}}") == "p 3"


TREE = {
    "meta": {"title": "T"},
    "pages": [
        {"elements": [
            {"type": "text", "content": "Top", "heading": True}, {"type": "text", "content": "Sub", "heading": 3, "id": "s"}, {"type": "text", "content": " body "},
            {"type": "list", "items": ["a", {"content": "b", "children": [{"content": "c"}]}]},
            {"type": "table", "headers": ["x", "y"], "rows": [["1", ""], ["", ""], [{"content": "2"}, "3"]]},
            {"type": "collapsible", "title": "more", "elements": [{"type": "text", "content": "in"}, {"type": "collapsible", "title": "deep", "elements": [{"type": "image", "alt": "pic", "caption": "cap"}]}]},
            {"type": "checkbox", "name": "ok", "label": "Agree", "checked": True}, {"type": "shape", "shape": "rect"}, {"type": "text", "content": "no", "heading": False, "tocLevel": 2},
        ]},
        {"elements": []},
    ],
}


def test_elements(spark):
    docs = elements.parse_documents(spark.createDataFrame([(1, json.dumps(TREE)), (2, "not json")], "doc_id long, value string"))
    top = elements.top_level(docs)
    rows = top.withColumn("text", elements.serialize(F.col("el"))).orderBy("el_idx").collect()
    assert [r.el_id for r in rows][:3] == ["p1e0", "s", "p1e2"]
    assert [r.level for r in rows] == [1, 3, None, None, None, None, None, None, 2]
    assert [r.text for r in rows][2:8] == ["body", "- a\n- b\n  - c", "x: 1\nx: 2 | y: 3", "more", "[x] Agree", ""]
    deep = elements.walk(top).where("depth > 0").orderBy("el_path").collect()
    assert [(r.el_path, r.type) for r in deep] == [([5, 0], "text"), ([5, 1], "collapsible"), ([5, 1, 0], "image")]
    assert len(elements.KINDS) == 14


def greedy_by_hand(costs, most):
    out, total, part = [], 0, 0
    for i, c in enumerate(costs):
        if i and total + c > most:
            total, part = 0, part + 1
        total += c
        out.append(part)
    return out


def test_greedy_and_breadcrumbs_on_random_input(spark):
    rng = random.Random(3)
    lists = [(i, [rng.randint(0, 9) for _ in range(rng.randint(1, 30))]) for i in range(60)]
    got = spark.createDataFrame(lists, "i long, x array<int>").select("i", chunking.greedy(F.col("x"), F.lit(12)).alias("g")).collect()
    assert all(list(r.g) == greedy_by_hand(lists[r.i][1], 12) for r in got)
    rows, want = [], {}
    for doc in range(40):
        crumb = []
        for seq in range(25):
            level = rng.choice([None, None, 1, 2, 3, 4])
            if level:
                crumb = (crumb + [None] * 6)[: level - 1] + [f"t{seq}"]
            rows.append((doc, seq, level, f"t{seq}"))
            want[doc, seq] = list(crumb)
    df = spark.createDataFrame(rows, "doc_id long, seq long, level int, text string")
    assert all(list(r.path) == want[r.doc_id, r.seq] for r in chunking.breadcrumbs(df).collect())


def test_splitter_keeps_every_word(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "bb ", "\n", "\n\n", "ccc ", " ", "😀"]) for _ in range(rng.randint(0, 200))) for _ in range(200)] + [None, "", " \n "]
    texts += ["x" * 600 + "\n\n\n\n" + "y" * 600]

    def split(size, overlap):
        out = {i: [] for i in range(len(texts))}
        for r in chunking.split_characters(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size, overlap).orderBy("doc_id", "piece_no").collect():
            assert r.piece_no == len(out[r.doc_id])
            out[r.doc_id].append(r.piece)
        return out

    got = split(40, 0)
    for i, t in enumerate(texts):
        assert "".join("".join(got[i]).split()) == "".join((t or "").split()) and all(len(p) <= 42 for p in got[i])
    assert got[200] == got[201] == got[202] == []
    first, second = split(1000, 200)[len(texts) - 1]
    assert first == "x" * 600 and second == "x" * 198 + "\n\n" + "y" * 600  # no empty part between the line feeds


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1\n00:00:01,000 --> 00:00:02,500\n<i>Hi</i>\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\nbye"), ("b", '[{"start": 1, "end": 2, "text": "x"}]')], "file string, value string")
    segs = readers.subtitles(rows)
    assert sorted((r.file, r.t0, r.t1, r.text) for r in segs.collect()) == [("a", 1.0, 2.5, "Hi there"), ("a", 3.0, 4.0, "bye"), ("b", 1.0, 2.0, "x")]
    ch = readers.chapters(spark.createDataFrame([("a", "00:00 Start\n0:03 Next"), ("b", '[{"t": 5, "title": "L"}]')], "file string, value string"))
    assert sorted((r.t0, r.chapter) for r in readers.with_chapter(segs, ch).collect() if r.file == "a") == [(1.0, "Start"), (3.0, "Next")]
    md = readers.markdown(spark.createDataFrame([("m", "# A *b*\n\npara **x**\ny\n\n- i\n  - j\n\n|a|b|\n|-|-|\n|1|2|\n\n> q\n\n---")], "file string, value string")).orderBy("seq").collect()
    assert [(r.kind, r.text) for r in md] == [("heading", "A b"), ("paragraph", "para x y"), ("item", "i"), ("item", "j"), ("table", ""), ("quote", "q"), ("rule", "")]
    n = readers.normalise(spark.createDataFrame([("x.json", '[{"type":"list","items":["a"]}]'), ("y", "[]"), ("z", "{")], "file string, value string")).orderBy("file").collect()
    assert [r.error for r in n] == [None, "no elements", "not JSON"]
    bundle = writers.bundle_bytes(spark.createDataFrame([(1, "document.json", b'{"pages":[]}'), (1, "manifest.json", b'{"assets":[{"id":"i","path":"assets/i","mimeType":"t"}]}'), (1, "assets/i", b"z"), (1, "../evil", b"!")], "doc_id long, name string, content binary")).first()["bundle"]
    (tmp_path / "b.zip").write_bytes(bytes(bundle))
    docs, assets = readers.bundles(spark, str(tmp_path))
    assert docs.count() == 1 and bytes(assets.first()["content"]) == b"z"
    assert readers.bundle_entries(spark, str(tmp_path)).where("name like '%evil%'").count() == 0


def test_layout(spark):
    schema = "page int, idx int, text string, x double, y double, width double, font_size double, body double"
    column = [(1, i, "t", x, y, 50.0, 10.0, 10.0) for i, (x, y) in enumerate((x, 10.0 + 5 * k) for x in (20.0, 110.0) for k in range(10))]
    lines = spark.createDataFrame(column + [(1, 90, "wide", 30.0, 200.0, 100.0, 10.0, 10.0), (1, 91, "head", 20.0, 5.0, 160.0, 10.0, 10.0), (1, 92, "middle", 80.0, 31.0, 10.0, 10.0, 10.0)] + [(2, *r[1:]) for r in column[:11]] + [(3, *r[1:3], 20.0, *r[4:]) for r in column], schema)
    g = layout.gutters(lines, 210.0)
    assert [(r.page, r.left, r.right) for r in g.collect()] == [(1, 70.0, 110.0)]  # two lines may cross
    order = [r.idx for r in layout.reading_order(lines, g, 210.0).where("page = 1").orderBy("place").collect()]
    assert order == [91, *range(5), 92, *range(5, 10), 90, *range(10, 20)]
    assert [r.idx for r in layout.reading_order(lines, g, 210.0).where("page = 2").orderBy("place").collect()] == sorted(r[1] for r in column[:11])


def test_reading_order_sorts_few_rows_in_a_task(spark):
    """Parts grow in number with the rows; strips are found without a row a bin, and boxes are sorted without their page's
    columns and apart from what finds the strips."""
    from leafmill.plans import tables
    from leafmill.sources.shared import dealt

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert dealt(spark.range(1000), "id", 100).rdd.getNumPartitions() == 11 and dealt(spark.range(10), "id", 100).rdd.getNumPartitions() == 4
    lines = tables._printed(spark, "/root/testdata/sf0.001")
    assert "RepartitionByExpression [l_suppkey" in plan(lines)
    strips = layout.gutters(lines, 210.0)
    assert "sequence(" not in plan(strips)
    ordered = plan(layout.reading_order(lines.withColumn("y", F.lit(1.0)), strips, 210.0))
    assert sum("Window [" in x for x in ordered.splitlines()) == 3 and "covered" not in ordered
    # What stands above the join, which is all that is sorted, has no array of columns.
    assert "columns#" not in "".join(x for x in ordered[: ordered.index("Join LeftOuter")].splitlines() if "Window [" in x)


def test_next_on_line_and_intervals(spark):
    rng = random.Random(3)
    runs = [(p, i, rng.uniform(0, 200), rng.choice([0, 0.4, 3, 3.2, 9]) + rng.random(), rng.choice([4.0, 10.0, 30.0, None]), rng.random() < 0.1) for p in range(3) for i in range(60)] + [(0, 100, None, 1.0, 4.0, False)]
    got = {(r.page, r.k): r.next for r in layout.next_on_line(spark.createDataFrame(runs, "page int, k int, x double, y double, font_size double, rotated boolean"), ["page"], "k").collect()}
    for p, k, x, y, s, turned in runs:
        near = [(b[2], b[1]) for b in runs if b[0] == p and b[2] is not None and x is not None and not turned and not b[5] and b[2] > x and abs(b[3] - y) <= max(0.6, max(s or 0, b[4] or 0) * layout.MM / 2)]
        assert got[p, k] == (min(near)[1] if near else None)
    points = [(rng.randint(0, 2), i, round(rng.uniform(-50, 50), 1)) for i in range(200)] + [(0, 999, None)]
    spans = [(rng.randint(0, 2), i, lo := round(rng.uniform(-50, 50), 1), lo + rng.choice([0, -1, 0.1, 3, 64, 200])) for i in range(80)] + [(0, 998, None, 3.0)]
    pairs = layout.containing(spark.createDataFrame(points, "g int, p int, v double"), spark.createDataFrame(spans, "g int, i int, lo double, hi double"), ["g"], "v").collect()
    assert sorted((r.p, r.i) for r in pairs) == sorted((p, i) for g, p, v in points for h, i, lo, hi in spans if g == h and v is not None and lo is not None and lo < v < hi)
    rules = spark.createDataFrame([(1, 10.0, 0.2, 5.0), (1, 10.4, 0.2, 6.0), (1, 30.0, 0.2, 9.0), (1, 50.0, 9.0, 0.2), (1, 70.0, 0.0, 10.0)], "page int, x double, width double, height double")
    assert [r.x for r in layout.rule_edges(rules, ["page"], F.lit(10.0)).orderBy("x").collect()] == [10.1, 70.0]


def test_edits_and_embedding(spark):
    xs = F.array(*map(F.lit, "abcd"))
    assert one(spark, documents.move(xs, 0, 2)) == list("bcad")
    assert one(spark, documents.duplicate(xs, 3)) == list("abcdd")
    assert one(spark, documents.insert_after(xs, 0, F.lit("z"))) == list("azbcd")
    chunks = spark.createDataFrame([("c1", "h1", "one two"), ("c2", "h2", "three")], "chunk_id string, hash string, text string")
    v = retrieval.embed(chunks, retrieval.hashing_provider(8), 8, "m")
    assert retrieval.to_embed(chunks, v.where("chunk_id = 'c1'"), "m").count() == 1
    assert retrieval.to_embed(chunks, v, "other").count() == 2


def test_held_values_against_pairs(spark):
    rng = random.Random(5)
    points = [(rng.randrange(3), float(rng.randrange(40))) for _ in range(600)] + [(0, None)]
    spans = [(rng.randrange(4), i, float(a := rng.randrange(-5, 45)), float(a + rng.randrange(-1, 20))) for i in range(300)]
    want = {}
    for g, i, lo, hi in spans:
        inside = [v for p, v in points if p == g and v is not None and lo < v < hi]
        if inside:
            want[i] = (len(inside), min(inside))
    got = layout.held_values(spark.createDataFrame(points, "g int, v double"), spark.createDataFrame(spans, "g int, i int, lo double, hi double"), ["g"], "v")
    assert {r.i: (r.held, r.first) for r in got.collect()} == want


def test_nearest_makes_pairs_of_places_only(spark):
    """A thousand rows on each of a few places: their pairs would be a million a place."""
    left = spark.range(5000).selectExpr("id as key", "double(id % 5) as x", "if(id = 7, null, 0.0D) as y")
    right = spark.range(5000).selectExpr("id + 10 as other", "double(id % 5) + 0.25D as x", "0.0D as y")
    got = layout.nearest(left, right, "key", 10.0)
    assert {(r.x, r.other, r.distance2, r.n) for r in got.groupBy("x", "other", "distance2").agg(F.count("*").alias("n")).collect()} == {
        *((float(i), 10 + i, 0.0625, 1000 - (i == 2)) for i in range(5)), (2.0, None, None, 1)
    }
    at = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert at(got).index("Join") < at(got).index("Generate") and at(got).count("Aggregate") >= 3


def test_outline_against_all_pairs(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts = [(p, i, word(rng.randrange(1, 9)), float(rng.randrange(3)), None) for i in range(300) for p in (i % 2,)]
    outline = [(s % 2, s, rng.choice(texts)[2][: rng.randrange(1, 9)] + rng.choice(("", "!", word(4))) if s % 3 else word(3) + rng.choice(texts)[2] + word(2), s % 9) for s in range(200)]
    frames = spark.createDataFrame(texts, "p int, o int, text string, y double, heading int"), spark.createDataFrame(outline, "p int, seq int, title string, depth int")
    clean = lambda d, c: [tuple(r) for r in d.select("p", d.columns[1], layout.match_title(F.col(c))).collect()]
    have, level, best = clean(frames[0], "text"), {s: min(6, max(1, d)) for _, s, _, d in outline}, {}
    for p, seq, w in clean(frames[1], "title"):
        score = lambda h: 3 if h == w else 2 if h.startswith(w) or w.startswith(h) else 1 if len(h) >= 6 and h in w else 0
        hits = [(-score(h), texts[o][3], o) for q, o, h in have if q == p and h and w and score(h)]
        if hits:
            best.setdefault(min(hits)[2], []).append(seq)
    got = layout.apply_outline(*frames, ["p"], "o").where("toc_level is not null").collect()
    assert {r.o: (r.heading, r.toc_level) for r in got} == {o: (level[min(s)], level[max(s)]) for o, s in best.items()} and len(got) > 20


def test_dense_scores_are_worked_out_in_small_matrices(spark, monkeypatch):
    """A batch of rows against a block of queries was one matrix, of 10,000 by 4,096 doubles and its copies."""
    rng = random.Random(2)
    v = [(i, [float(rng.randrange(-3, 4)) for _ in range(3)]) for i in range(90)]
    monkeypatch.setattr(retrieval, "ROWS", 7)
    monkeypatch.setattr(retrieval, "QUERIES", 4)
    frame = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    size = lambda x: max(sum(c * c for c in x) ** 0.5, 1e-300)
    cos = lambda a, b: round(sum(x / size(a) * (y / size(b)) for x, y in zip(a, b)), 6)
    got = {}
    for r in retrieval.dense(frame, frame.where("vec_id % 9 = 0"), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(round(r.score, 6))
    assert got == {q: sorted((cos(v[q][1], x) for i, x in v if i != q), reverse=True)[:5] for q in range(0, 90, 9)}
