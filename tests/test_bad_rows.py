"""One bad row among good ones loses only itself."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from leafmill.operators import trees
from leafmill.sources import readers

from .test_trees import frame

RULES = {"type": "object", "properties": {"n": {"type": "integer"}, "e": {"$ref": "#/$defs/e"}}, "$defs": {"e": {"oneOf": [{"type": "string"}, {"type": "object", "properties": {"e": {"$ref": "#/$defs/e"}}}]}}}


def deep(n, leaf, key="e"):
    for _ in range(n):
        leaf = {key: leaf}
    return leaf


def test_schema_rules_on_bad_rows(spark):
    nested = '{"e":' * 2000 + '"x"' + "}" * 2000
    docs = ['{"n": 1}', '{"n": NaN}', '{"n": 1e999}', '{"n": 1.5}', '{"n": "\\ud800"}', nested, nested.replace('"x"', "3"), '{"e": {"e": 3}}', "{" * 100000]
    got = {}
    for r in trees.schema_errors(frame(spark, docs), RULES).collect():
        got.setdefault(r.doc_id, []).append((r.place, r.message))
    assert got.pop(1) == got.pop(8) == [("", "must be JSON")]
    assert got.pop(2) == got.pop(3) == got.pop(4) == [("/n", "must be integer")]
    assert got.pop(6) == got.pop(7) == [("/e", "must match exactly one schema in oneOf")] and not got


def test_edits_on_bad_rows(spark):
    tree = {"pages": [{"elements": [{"a": "\ud800", "position": {"x": "left", "y": 2}}, {"b": [1]}]}]}
    first = ["pages", 0, "elements", 0]
    steps = [("move", first, None, None), ("move", first, None, "1"), ("duplicate", first, None, None), ("set", ["pages", 0, "elements", 2], "b.20000000", 1), ("set", ["pages", 0, "elements", 2], "b." + "9" * 5000, 1), ("set", ["pages", 0, "elements", 2], "b.2", 7)]
    edits = [(d, i, op, json.dumps(path), field, None if v is None else json.dumps(v)) for d in (0, 1) for i, (op, path, field, v) in enumerate(steps)]
    got = {r.doc_id: r.value for r in trees.apply_edits(frame(spark, [json.dumps(tree), "[NaN"]), spark.createDataFrame(edits, "doc_id long, seq int, op string, path string, field string, payload string")).collect()}
    elements = json.loads(got[0])["pages"][0]["elements"]
    assert [e.get("a") for e in elements] == ["\ud800", "\ud800", None] and elements[1]["position"] == {"x": 4, "y": 6} and elements[2] == {"b": [1, None, 7]} and got[1] == "[NaN"


def test_search_texts_of_any_depth(spark):
    section = {"type": "text", "content": "end\ud800"}
    for i in range(2000):
        section = {"type": "collapsible", "title": f"s{i}", "elements": [section, None]}
    words = trees.every_text(section).split()
    assert len(words) == 2001 and words[:2] == ["s1999", "s1998"] and words[-1] == "end�"
    assert trees.shown_text(section).startswith("s1999 s1998 ") and trees.shown_text(section).strip().endswith("end�")
    small = json.dumps({"type": "collapsible", "title": "t", "elements": [{"type": "text", "content": "a"}, 3, {"type": "text", "content": "b"}]})
    df = spark.createDataFrame([(0, small), (1, None)], "doc_id long, v string").withColumn("v", F.parse_json("v"))
    assert [r.t for r in df.orderBy("doc_id").select(trees.search_text(F.col("v")).alias("t")).collect()] == ["t a  b", ""]
    fields = trees.form_fields(frame(spark, [{"pages": [{"elements": [{"type": "input", "name": "n\ud800", "value": "\udc00"}, {"type": "input", "name": "m"}]}]}])).collect()
    assert [(r.name, r.value) for r in fields] == [("n�", "�"), ("m", None)]


def test_damaged_bundles_are_rows(spark, tmp_path):
    good = io.BytesIO()
    with zipfile.ZipFile(good, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("document.json", '{"pages":[]}')
        z.writestr("assets/a", "x" * 5000)
    raw = bytearray(good.getvalue())
    at = raw.index(b"assets/a") + len(b"assets/a")
    raw[at : at + 8] = b"\xff" * 8
    for name, content in (("good.zip", good.getvalue()), ("torn.zip", bytes(raw)), ("none.zip", b"no zip at all")):
        (tmp_path / name).write_bytes(content)
    rows = {(r.file.rpartition("/")[2], r["name"]): r for r in readers.bundle_entries(spark, str(tmp_path)).collect()}
    assert set(rows) == {("good.zip", "document.json"), ("good.zip", "assets/a"), ("torn.zip", "document.json"), ("torn.zip", "assets/a"), ("none.zip", None)}
    assert {k for k, r in rows.items() if r.error} == {("torn.zip", "assets/a"), ("none.zip", None)}
    assert readers.bundles(spark, str(tmp_path))[0].count() == 2
