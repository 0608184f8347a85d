"""Operators on JSON trees, layout folds, questions and plain text, against brute force or documents made by hand."""

import json
import random

from pyspark.sql import functions as F

from leafmill.functions import text as tx
from leafmill.operators import chunking, documents, elements, layout, retrieval, trees
from leafmill.sources import readers


def frame(spark, trees_):
    return spark.createDataFrame([(i, x if isinstance(x, str) or x is None else json.dumps(x)) for i, x in enumerate(trees_)], "doc_id long, value string")


def chain(kind, n, leaf):
    """An element of a kind nested n deep."""
    for i in range(n):
        leaf = {"type": "collapsible", "title": f"s{i}", "elements": [leaf]} if kind == "collapsible" else {"content": f" i{i} ", "children": [leaf]}
    return leaf


def test_any_depth(spark):
    deep = {"pages": [{"elements": [chain("collapsible", 150, {"type": "text", "content": "x"}), {"type": "list", "items": [chain("list", 9, {"content": "end"}), "flat"]}]}]}
    top = elements.top_level(elements.parse_documents(frame(spark, [deep])))
    rows = elements.walk(top).where("depth > 0").collect()
    assert max(r.depth for r in rows) == 150 and len(rows) == 150
    text = top.where("type = 'list'").select(elements.serialize(F.col("el")).alias("x")).first()["x"]
    assert text == "\n".join([*("  " * i + f"- i{8 - i}" for i in range(9)), "  " * 9 + "- end", "- flat"])


def test_form_fields_everywhere(spark):
    field = lambda n, **kw: {"type": "input", "name": n, **kw}
    tree = {
        "footer": {"elements": [field("last")]},
        "pages": [{"footer": {"elements": [field("b")]}, "header": {"elements": [{"type": "select", "name": "h", "values": ["p", "q"]}]}, "elements": [field(""), field(3), {"items": [field("i", value="v")], "rows": [[[field("r")], "x"], 5], "elements": [field("e")]}]}, None],
    }
    got = trees.form_fields(frame(spark, [tree, "[]", "{", None, "{}"])).orderBy("seq").collect()
    assert [(r.doc_id, r.name, r.value) for r in got] == [(0, "e", None), (0, "i", "v"), (0, "r", None), (0, "h", '["p","q"]'), (0, "b", None), (0, "last", None)]


def test_edits(spark):
    tree = {"pages": [{"elements": [{"a": 1, "position": {"x": 1}}, {"b": 2}]}]}
    first = ["pages", 0, "elements", 0]
    steps = [("duplicate", first, None, None), ("set", first, "style.runs.1.size", 3), ("set", ["pages", 9], "x", 1), ("move", first, None, -1), ("delete", ["pages", 0, "elements", 2], None, None), ("delete_page", [0], None, None), ("delete", ["pages", 0, "elements", 0, "a"], None, None)]
    edits = spark.createDataFrame([(0, i, op, json.dumps(path), field, json.dumps(v)) for i, (op, path, field, v) in enumerate(steps)], "doc_id long, seq int, op string, path string, field string, payload string")
    got = {r.doc_id: r.value for r in trees.apply_edits(frame(spark, [tree, '{"untouched" : 1}', None]), edits).collect()}
    assert json.loads(got[0]) == {"pages": [{"elements": [{"position": {"x": 1}, "style": {"runs": [None, {"size": 3}]}}, {"a": 1, "position": {"x": 5, "y": 4}}]}]}
    assert got[1] == '{"untouched" : 1}' and got[2] is None
    broken = spark.createDataFrame([(1, 0, "set", "no path", "x", "1")], edits.schema)
    assert json.loads(next(r.value for r in trees.apply_edits(frame(spark, [tree, '{"u":1}']), broken).collect() if r.doc_id == 1)) == {"u": 1, "x": 1}


def test_schema_rules():
    rules = {"type": "object", "properties": {"n": {"oneOf": [{"type": "string"}, {"type": "integer"}]}, "k": {"if": {"const": 1}, "then": False}, "s": {"pattern": "^a", "minLength": 3}}, "patternProperties": {"^x": {"type": ["null", "array"]}}, "minProperties": 9}
    found = lambda v: list(trees.broken_rules(v, rules, rules))
    assert found({"n": 1, "k": 2, "s": "abc", "xy": None}) == []
    assert found([]) == [("", "must be object")]
    assert found({"n": 1.5, "k": 1, "s": "b", "xy": {}}) == [
        ("/n", "must match exactly one schema in oneOf"), ("/k", "boolean schema is false"), ("/s", "must NOT have fewer than 3 characters"), ("/s", 'must match pattern "^a"'), ("/xy", "must be null,array"),
    ]


def test_structure_of_odd_documents(spark):
    docs = elements.parse_documents(frame(spark, ["3", '{"v":"1","meta":{"title":"t"},"pages":[{"elements":[null,"x"]}]}']))
    got = documents.structure_report(docs, "v").collect()
    assert [r.message for r in got if r.doc_id == 1] == ["page[0].element[0].type missing", "page[0].element[1].type missing"]
    assert len([r for r in got if r.doc_id == 0]) == 3


def test_search_texts():
    e = {"type": "table", "headers": ["h"], "rows": [["a", None, {"content": "c"}], [1]]}
    assert trees.shown_text(e) == "h a  c 1" and trees.every_text(e) == "a c"
    field = {"type": "input", "label": "L", "value": "data:x", "values": ["v"], "elements": [{"content": "in"}, {}], "runs": [{"text": "r"}, {"text": "s"}]}
    assert trees.every_text(field) == "rs L L data:x v in" and trees.every_text(field, False) == "rs L v in"
    assert trees.shown_text({"type": "list", "items": [{"content": "a", "children": [{"content": "b"}]}, {"content": "c"}]}) == "a b c"


def test_assets_that_cannot_be_read_stay():
    tree = {"pages": [{"elements": [{"type": "image", "src": "data:image/png;base64,*"}, {"type": "video", "src": "data:video/mp4;base64,aGk="}]}], "resources": {"images": {"k": {"data": "%%"}}}}
    assert trees.take_assets(tree) == [("asset-1", "video/mp4", "mp4", b"hi")]
    assert tree["pages"][0]["elements"][0]["src"].endswith("*") and tree["resources"]["images"]["k"] == {"data": "%%"}


def test_documents_are_not_held_together(spark):
    """Small documents pass a hundred at a time and are read once; of twenty of 20 MB Python holds a few. Both ways make
    the same rows."""

    def held(tree):
        with open("/proc/self/statm") as f:
            yield int(f.read().split()[1]) * 4096 // 1_000_000, len(tree["text"])

    def most(n, size):
        docs = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.to_json(F.struct(F.repeat(F.lit("x"), size).alias("text"))).alias("value"))
        got = trees.each(docs, held, "mb long, n int").agg(F.max("mb").alias("mb"), F.min("n").alias("n"), F.count("*").alias("rows")).first()
        assert (got["n"], got["rows"]) == (size, n)
        return got["mb"]

    assert most(20, 20_000_000) < 600
    odd = [{"pages": [{"elements": [{"type": "image", "src": "data:image/png;base64,aGk="}]}]}, "{", None, "[1]", {}]
    want = [("asset", "asset-1", b"hi"), ("document", None, None)]
    for pad, both in (("", (0, 4)), ("x" * trees.LARGE, (0, 4))):
        rows = trees.extract_assets(frame(spark, [x | {"pad": pad} if isinstance(x, dict) else x for x in odd]))
        got = sorted((r.doc_id, r.kind, r.id, r.content and bytes(r.content)) for r in rows.collect())
        assert got == [(both[0], *w) for w in want] + [(both[1], *want[1])]
    plan = rows.where("kind = 'asset'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython [") == 1


#: Sentences, and of each the text of its question, the answer and the key word; None where no question is made. The blank
#: takes a space behind the number with it; a key word has five to nine letters and no hyphen.
ANSWERS = [
    ("The harbour handled 1,204 containers in the first quarter of it.", ("The harbour handled ____containers in the first quarter of it.", "1,204", "harbour")),
    ("Sales of widget-like goods rose by 12.5 % over all of last spring.", ("Sales of widget-like goods rose by ____ over all of last spring.", "12.5 %", "spring")),
    ("In 1999 the council opened 14 new libraries near the river.", ("In 1999 the council opened ____new libraries near the river.", "14", "libraries")),
    ("In 1999 the council opened a new library near the old river.", None),
    ("The 21st amendment was passed without any of the usual debate then.", None),
    ("See Table 12 for the complete list of all the harbour fees.", None),
    ("Only 37 ships.", None),
    ("The contents ....... 12 pages are listed before all of the chapters.", None),
    ("Version v1.20 shipped with 99% coverage of all the modules inside.", ("Version v1.20 shipped with ____ coverage of all the modules inside.", "99%", "coverage")),
    ("As shown before [39] the crane lifts 250 tonnes without any strain.", ("As shown before [39] the crane lifts ____tonnes without any strain.", "250", "without")),
]


def test_blanked_questions(spark):
    rows = [(i, s) for i, (s, _) in enumerate(ANSWERS)] + [(90, None), (91, ""), (92, " ".join(s for s, _ in ANSWERS))]
    got = {}
    for r in retrieval.blanked_questions(spark.createDataFrame(rows, "doc_id long, text string"), 3).orderBy("n").collect():
        got.setdefault(r.doc_id, []).append((r.question.removeprefix("Fill in the blank: "), r.answer, r.word))
    made = [a for _, a in ANSWERS if a]
    assert got == {**{i: [a] for i, (_, a) in enumerate(ANSWERS) if a}, 92: [made[0], made[1], made[3]]}  # three of five, evenly


def wrapped_by_hand(text, most):
    out = []
    for line in text.split("\n"):
        now = ""
        for w in line.split():
            if now and len(now) + 1 + len(w) <= most:
                now += " " + w
                continue
            out += [now] if now else []
            *full, now = [w[i : i + most] for i in range(0, len(w), most)]
            out += full
        out.append(now)
    return out


def test_wrap_and_draws(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab  \n😀") for _ in range(rng.randint(0, 90))) for _ in range(100)]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, s string").select("i", tx.wrap(F.col("s"), 7).alias("w")).collect()
    assert all(list(r.w) == wrapped_by_hand(texts[r.i], 7) for r in got)

    def stream(state, n):
        for _ in range(n):
            state = (state + 0x6D2B79F5) & 0xFFFFFFFF
            x = (state ^ state >> 15) * (state | 1) & 0xFFFFFFFF
            x ^= (x + ((x ^ x >> 7) * (x | 61))) & 0xFFFFFFFF
            yield (x ^ x >> 14) / 2**32

    for seed in (0, 7, 4294967295):
        got = [r.x for r in spark.range(200).orderBy("id").select(tx.draw(F.lit(seed), F.col("id")).alias("x")).collect()]
        assert got == list(stream(seed, 200))


RUN = "page int, seq int, text string, x double, y double, width double, font_size double, face string, color string"


def test_lines_of_runs(spark):
    run = lambda i, text, x, y, width, color="k", size=10.0: (1, i, text, float(x), float(y), float(width), size, "f", color)
    runs = [run(0, "Hel", 0, 0, 5), run(1, "lo", 5, 0.1, 4), run(2, "you", 10, 0, 6), run(3, "37", 18, 0, 3), run(4, "$", 21, 0, 1), run(5, " ", 22, 0, 9), run(6, "far", 31, 0, 4), run(7, "red", 35, 0, 4, "r"), run(8, "", 1, 1, 1), run(9, "low", 39, 0.8, 4, "r"), run(10, "big", 43, 0.8, 4, "r", 10.5)]
    got = layout.merge_lines(spark.createDataFrame(runs, RUN), ["page"], "seq").orderBy("seq").collect()
    assert [(r.seq, r.text, r.x, round(r.width, 3)) for r in got] == [(0, "Hello you", 0, 16), (3, "37", 18, 3), (4, "$", 21, 1), (6, "far", 31, 4), (7, "red", 35, 4), (9, "low", 39, 4), (10, "big", 43, 4)]
    gaps = [run(i, " " if i % 2 else "w", 6 * i, 0, 8.0 if i % 4 == 1 else 4.0) for i in range(20)]
    assert layout.merge_lines(spark.createDataFrame(gaps, RUN), ["page"], "seq").count() == 10  # blanks of an em part columns where many are wide
    turned = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 2.0, 10.0, 0), (1, 1, "b", 2.0, 0.0, 2.0, 10.0, 90), (1, 2, "c", 4.0, 0.0, 2.0, 10.0, 90)], "page int, seq int, text string, x double, y double, width double, font_size double, rotation int")
    assert [r.text for r in layout.merge_lines(turned, ["page"], "seq").orderBy("seq").collect()] == ["a", "bc"]


def test_lines_drawn_twice(spark):
    lines = [(1, i, t, x, y, 1.0, 10.0, "f", "k") for i, (t, x, y) in enumerate([("a", 0.0, 0.0), ("a ", 0.4, 0.4), ("b", 0.0, 0.0), ("a", 0.0, 5.0), (" ", 0.0, 0.0), (" ", 0.0, 0.0)])]
    far = [(2, i, f"{i}", 0.0, float(i), 1.0, 10.0, "f", "k") for i in range(50)] + [(2, 50, "3", 0.0, 3.0, 1.0, 10.0, "f", "k"), (2, 51, "30", 0.0, 30.0, 1.0, 10.0, "f", "k")]
    got = layout.without_doubles(spark.createDataFrame(lines + far, RUN), ["page"], "seq").orderBy("page", "seq").collect()
    assert [(r.seq, r.bold) for r in got if r.page == 1] == [(0, True), (2, False), (3, False), (4, False), (5, False)]
    assert [r.seq for r in got if r.page == 2] == list(range(51)) and [r.seq for r in got if r.page == 2 and r.bold] == [30]  # 3 is more than 40 lines back


def test_paragraphs(spark):
    line = lambda i, text, x, y, width, heading=None, page=1: (page, i, text, float(x), float(y), float(width), 10.0, "f", heading)
    rows = [line(0, "First line is full", 3, 20, 100), line(1, "goes on.", 0, 24, 30), line(2, "New one", 0, 28, 40), line(3, "• item", 0, 32, 100), line(4, "Head", 0, 36, 90, 1), line(5, "body", 0, 40, 10), line(6, "Far below", 0, 60, 10)]
    rows += [line(0, "A word is hyphen-", 0, 20, 20, page=2), line(1, "ated and", 0, 24, 90, page=2), line(2, "Then more of it", 0.5, 28, 100, page=2), line(3, "and off the edge", 4, 32, 100, page=2)]
    schema = "page int, seq int, text string, x double, y double, width double, font_size double, face string, heading int"
    numbered = layout.paragraphs(spark.createDataFrame(rows, schema), ["page"], "seq")
    assert [(r.page, r.paragraph) for r in numbered.orderBy("page", "seq").collect()] == [(1, 0), (1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 0), (2, 0), (2, 0), (2, 1)]
    p = layout.merged_paragraphs(numbered, ["page"], "seq", 210.0).where("page = 1").orderBy("paragraph").collect()
    assert (p[0].text, p[0].lines, p[0].x, p[0].indent, p[0].line_height) == ("First line is full\ngoes on.", 2, 0.0, 3.0, 1.13)
    assert p[0].width == round(103 * 1.2 + 10 * layout.MM * 0.4, 2) and p[0].y == round(20 - 0.13 / 2 * 10 * layout.MM, 2) and p[1].width == 40 and p[1].indent is None


def test_plain_text(spark):
    text = "Quarterly Report\n\nSALES FIGURES\n\nWe sold things\r\nand more.\n\n- one\n• two\n\n1. a\n2) b\nnote\n\f\n\f\nWhat Came Next\n\nnot a heading here, as it is long\n\n- lone"
    got = readers.plain_text(spark.createDataFrame([("f", text), ("g", ""), ("h", None)], "file string, value string")).orderBy("page", "seq").collect()
    assert [(r.page, r.kind, r.level, r.text, r["items"]) for r in got] == [
        (1, "heading", 1, "Quarterly Report", None), (1, "heading", 2, "SALES FIGURES", None), (1, "text", None, "We sold things and more.", None), (1, "list", None, None, ["one", "two"]),
        (1, "ordered", None, None, ["a", "b", "note"]), (2, "heading", 3, "What Came Next", None), (2, "text", None, "not a heading here, as it is long", None), (2, "text", None, "- lone", None),
    ]


def test_subtitles_keep_speakers(spark):
    rows = spark.createDataFrame([("a", '{"segments":[{"from":1,"to":2,"text":" x ","speaker":"Ann"},{"text":""}]}'), ("b", "WEBVTT\n\n00:01.5 --> 00:02.5 align:start\n<b>hi</b>\n\nbad --> 0:03\nyes")], "file string, value string")
    assert [tuple(r) for r in readers.subtitles(rows).orderBy("file", F.desc("t0")).collect()] == [("a", 1.0, 2.0, "x", "Ann"), ("b", 1.5, 2.5, "hi", None), ("b", None, 3.0, "yes", None)]
    ch = readers.chapters(spark.createDataFrame([("a", '[{"start": 4, "title": "s"}, {}]')], "file string, value string"))
    assert sorted(tuple(r) for r in ch.collect()) == [("a", 0.0, ""), ("a", 4.0, "s")]


def test_section_chunks_of_a_document(spark):
    """Chunks by hand: headings that follow one another lead one section; texts are joined by a blank line."""
    el = lambda content, **kw: {"type": "text", "content": content, **kw}
    tree = {"pages": [{"elements": [el("Report", heading=1, id="top"), el("Costs", heading=2), el("Rent is 5."), {"type": "list", "items": [{"content": "a"}, {"content": "b"}]}]}, {"elements": [el("goes on"), el("Staff", heading=2), el("Ten.")]}]}
    top = elements.top_level(elements.parse_documents(frame(spark, [tree]))).withColumn("seq", F.col("page").cast("long") * 1000 + F.col("el_idx")).withColumn("text", elements.serialize(F.col("el")))
    got = chunking.chunk(top, "section").orderBy("section").collect()
    assert [(r.id, r.page, list(r.path), list(r.types), r.text) for r in got] == [
        ("top", 1, ["Report", "Costs"], ["text", "list"], "Report\n\nCosts\n\nRent is 5.\n\n- a\n- b\n\ngoes on"),
        ("p2e1", 2, ["Report", "Staff"], ["text"], "Staff\n\nTen."),
    ]
    assert [r.tokens for r in got] == [11, 3]
