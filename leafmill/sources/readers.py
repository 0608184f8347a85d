"""Readers: JSON documents plain or bundled, folders, subtitles, chapters, plain text, Markdown, JSON of three shapes."""

from __future__ import annotations

import io
import json
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse, seconds, trim_all

#: Folders that a scan of documents leaves out.
SKIPPED = r"(^|/)(node_modules|\.[^/]+)(/|$)"


def folder(spark: SparkSession, path: str, pattern: str = "*.json", output: str | None = None) -> DataFrame:
    """(file, value): whole text files under path in path order of code points; hidden folders, node_modules and the
    output folder are left out."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    own = F.substring_index("file", path.rstrip("/").rpartition("/")[2] + "/", -1)
    rows = rows.where(~own.rlike(SKIPPED))
    rows = rows.where(~F.startswith(own, F.lit(output.strip("/") + "/"))) if output else rows
    return rows.orderBy("file")


def documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(file, value, doc): doc is null where a file is no JSON."""
    return folder(spark, path, pattern).withColumn("doc", F.try_parse_json("value"))


def safe_name(name: Column) -> Column:
    """Whether a bundle's entry stays inside its folder."""
    return ~(F.startswith(name, F.lit("/")) | F.contains(name, F.lit("\\")) | F.array_contains(F.split(name, "/"), ".."))


def bundle_entries(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """(file, name, content, error): entries of zip bundles with safe names. What cannot be read is a row of its own with
    error set and no content: a damaged entry by its name, a file that is no zip without one."""

    def run(batches):
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"]):
                try:
                    bundle = zipfile.ZipFile(io.BytesIO(content))
                    names = [n for n in bundle.infolist() if not n.is_dir()]
                except Exception as e:  # noqa: BLE001, whatever a broken file brings about is told in its row
                    rows.append((file, None, None, f"{type(e).__name__}: {e}"))
                    continue
                for n in names:
                    try:
                        rows.append((file, n.filename, bundle.read(n), None))
                    except Exception as e:  # noqa: BLE001
                        rows.append((file, n.filename, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["file", "name", "content", "error"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")
    return raw.mapInPandas(run, "file string, name string, content binary, error string").where(F.coalesce(safe_name(F.col("name")), F.lit(True)))


def bundles(spark: SparkSession, path: str, pattern: str = "*.zip") -> tuple[DataFrame, DataFrame]:
    """(documents, assets): document.json of each bundle as VARIANT; assets of its manifest with their bytes."""
    e = bundle_entries(spark, path, pattern).where("error is null").drop("error")
    docs = e.where("name = 'document.json'").select("file", F.try_parse_json(F.decode("content", "UTF-8")).alias("doc"))
    listed = e.where("name = 'manifest.json'").select("file", F.explode(F.from_json(F.decode("content", "UTF-8"), "struct<assets:array<struct<id:string,path:string,mimeType:string>>>")["assets"]).alias("a")).select("file", "a.*")
    return docs, listed.join(e.withColumnRenamed("name", "path"), ["file", "path"])


def _tree(value: Column) -> Column:
    """An array or object as VARIANT; null for other text (the parser alone would take a leading number for a value)."""
    return F.when(value.rlike(r"^\s*[\[{]"), F.try_parse_json(value))


def subtitles(rows: DataFrame, key: str = "file", value: str = "value") -> DataFrame:
    """(key, t0, t1, text, speaker): SRT, WebVTT or JSON segments; tags are dropped, lines joined, segments without text
    left out. speaker is null where none is named; a stamp that is none, and a missing end or begin in SRT, are null."""
    plain = rows.where(_tree(F.col(value)).isNull()).select(key, F.explode(F.split(F.regexp_replace(value, "\r\n?", "\n"), r"\n\s*\n")).alias("b")).where(F.contains("b", F.lit("-->")))
    stamp = F.regexp_extract("b", r"([^\n]*)-->([^\n]*)", 0)
    side = lambda i: seconds(F.get(F.split(F.trim(F.get(F.split(stamp, "-->"), F.lit(i))), r"\s+"), F.lit(0)))
    body = F.regexp_replace(F.regexp_replace("b", r"(?s)^.*?-->[^\n]*\n?", ""), "<[^>]+>", "")
    plain = plain.select(key, side(0).alias("t0"), side(1).alias("t1"), collapse(body).alias("text"), F.lit(None).cast("string").alias("speaker"))
    v = _tree(F.col(value))
    parts = F.coalesce(F.try_variant_get(v, "$.segments", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    num = lambda s, *ps: F.coalesce(*(F.try_variant_get(s, p, "double") for p in ps), F.lit(0.0))
    said = lambda p: F.try_variant_get("s", p, "string")
    tree = rows.where(v.isNotNull()).select(key, F.explode(parts).alias("s"))
    tree = tree.select(key, num(F.col("s"), "$.t0", "$.start", "$.from").alias("t0"), num(F.col("s"), "$.t1", "$.end", "$.to").alias("t1"), trim_all(F.coalesce(said("$.text"), F.lit(""))).alias("text"), F.nullif(said("$.speaker"), F.lit("")).alias("speaker"))
    return plain.unionByName(tree).where("text <> ''")


def chapters(rows: DataFrame, key: str = "file", value: str = "value") -> DataFrame:
    """(key, t, title): lines `mm:ss Title` or a JSON array of {t or start, title}."""
    line = r"^\s*((?:\d+:)?\d{1,2}:\d{2}(?:[.,]\d+)?)\s+(.*\S)\s*$"
    v = _tree(F.col(value))
    plain = rows.where(v.isNull()).select(key, F.explode(F.split(value, "\r?\n")).alias("l")).where(F.col("l").rlike(line)).select(key, seconds(F.regexp_extract("l", line, 1)).alias("t"), F.regexp_extract("l", line, 2).alias("title"))
    at = F.coalesce(F.try_variant_get("c", "$.t", "double"), F.try_variant_get("c", "$.start", "double"), F.lit(0.0))
    tree = rows.where(v.isNotNull()).select(key, F.explode(F.try_variant_get(v, "$", "array<variant>")).alias("c")).select(key, at.alias("t"), F.coalesce(F.try_variant_get("c", "$.title", "string"), F.lit("")).alias("title"))
    return plain.unionByName(tree)


def with_chapter(segments: DataFrame, chapter: DataFrame, key: str = "file") -> DataFrame:
    """segments (key, t0, ...) with the latest chapter that begins by t0 + 1e-6: an as-of join as one sorted window."""
    from pyspark.sql import Window

    c = chapter.select(key, F.col("t").alias("t0"), F.col("title").alias("_c"), F.lit(0).alias("_o"))
    s = segments.select("*", F.lit(None).cast("string").alias("_c"), F.lit(1).alias("_o"))
    w = Window.partitionBy(key).orderBy((F.col("t0") + F.col("_o") * 1e-6), "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = s.unionByName(c, allowMissingColumns=True).withColumn("chapter", F.last("_c", True).over(w))
    return both.where("_o = 1").drop("_c", "_o")


def plain_text(rows: DataFrame, key: str = "file", value: str = "value") -> DataFrame:
    """(key, page, seq, kind, level, text, items): blocks of a plain text; pages are parted by form feeds, blocks by
    blank lines, both counted from 1 and 0.

    A block of two lines or more that all begin with a bullet is a list; one where at least half begin with a number and
    a dot or bracket, two or more, is ordered. A block of one line is a heading where it is short and no sentence: level
    1 if capitals prevail (and for a document's first block), 2 and 3 below that. Other blocks are text, their lines
    joined. Sizes are in UTF-8 bytes.
    """
    whole = F.regexp_replace(value, "\r\n?", "\n")
    pages = rows.select(key, F.posexplode(F.filter(F.split(whole, "\f"), lambda p: trim_all(p) != "")).alias("page", "p"))
    blocks = F.filter(F.transform(F.split("p", "\n\n"), lambda b: F.regexp_replace(b, r"^[\n ]+|[\n ]+$", "")), lambda b: b != "")
    b = pages.select(key, (F.col("page") + 1).alias("page"), F.posexplode(blocks).alias("seq", "b"))
    b = b.withColumn("lines", F.filter(F.transform(F.split("b", "\n"), lambda x: F.rtrim(x)), lambda x: x != "")).where(F.size("lines") > 0)
    some = lambda pattern: F.size(F.filter("lines", lambda x: x.rlike(pattern)))
    bullets, numbers, n = some(r"^\s*([●•○]|[-*·] )"), some(r"^\s*[0-9]+[.)] "), F.size("lines")
    is_list = (bullets >= n) & (bullets >= 2)
    is_ordered = ~is_list & (numbers >= 2) & (numbers >= F.floor(n / 2))
    bare = lambda pattern: F.filter(F.transform("lines", lambda x: trim_all(F.regexp_replace(x, pattern, ""))), lambda x: x != "")
    items = F.when(is_list, bare("^[\\s●•○·*-]+")).when(is_ordered, bare(r"^\s*[0-9]*[.)]?"))
    t = trim_all(F.element_at("lines", 1))
    size, letters, capitals = F.octet_length(t), F.regexp_replace(t, r"\P{L}", ""), F.regexp_count(t, F.lit(r"\p{Lu}"))
    titled = F.forall(F.split(t, r"\s+"), lambda w: w.rlike(r"^(\p{Lu}|\P{L})"))
    level = F.when((capitals / F.octet_length(letters) > 0.85) & (size <= 60), 1).when((F.size(F.split(t, r"\s+")) <= 8) & titled & (size <= 60), 2)
    level = F.when((n == 1) & (size <= 90) & ~t.rlike("[.,;:]$") & (F.octet_length(letters) >= 2), level)
    first = (F.col("page") == 1) & (F.col("seq") == 0)
    kind = F.when(is_list, "list").when(is_ordered, "ordered").when(level.isNotNull(), "heading").otherwise("text")
    text = F.when(items.isNull(), F.array_join(F.transform("lines", lambda x: trim_all(x)), " "))
    return b.select(key, "page", "seq", kind.alias("kind"), F.when(kind == "heading", F.when(first, 1).otherwise(level + 1)).alias("level"), text.alias("text"), items.alias("items"))


def _markdown(text: str) -> list[tuple]:
    """(kind, level, text, rows as JSON) of the blocks of a Markdown text."""
    out, lines, i = [], (text or "").replace("\r\n", "\n").split("\n"), 0
    while i < len(lines):
        line = lines[i]
        if m := re.match(r"^(#{1,6})\s+(.*?)\s*#*\s*$", line):
            out.append(("heading", len(m[1]), strip_marks(m[2]), None))
        elif m := re.match(r"^(```|~~~)", line):
            body, i = [], i + 1
            while i < len(lines) and not lines[i].startswith(m[1]):
                body.append(lines[i])
                i += 1
            out.append(("code", None, "\n".join(body), None))
        elif re.match(r"^\s*([-*_])(\s*\1){2,}\s*$", line):
            out.append(("rule", None, "", None))
        elif "|" in line and i + 1 < len(lines) and re.match(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[i + 1]):
            cells = lambda r: [strip_marks(c.strip()) for c in r.strip().strip("|").split("|")]
            table, i = [cells(line)], i + 2
            while i < len(lines) and "|" in lines[i]:
                table.append(cells(lines[i]))
                i += 1
            i -= 1
            out.append(("table", None, "", json.dumps(table, ensure_ascii=False)))
        elif m := re.match(r"^(\s*)(?:[-*+]|\d+[.)])\s+(.*)$", line):
            out.append(("item", len(m[1].expandtabs(4)) // 2, strip_marks(m[2]), None))
        elif m := re.match(r"^>\s?(.*)$", line):
            body = [m[1]]
            while i + 1 < len(lines) and (m := re.match(r"^>\s?(.*)$", lines[i + 1])):
                body.append(m[1])
                i += 1
            out.append(("quote", None, strip_marks(" ".join(body).strip()), None))
        elif m := re.match(r"^!\[([^\]]*)\]\(([^)\s]+)[^)]*\)\s*$", line):
            out.append(("image", None, m[1], json.dumps(m[2])))
        elif line.strip():
            body = [line.strip()]
            while i + 1 < len(lines) and lines[i + 1].strip() and not re.match(r"^(#{1,6}\s|```|~~~|>|\s*(?:[-*+]|\d+[.)])\s)", lines[i + 1]):
                i += 1
                body.append(lines[i].strip())
            out.append(("paragraph", None, strip_marks(" ".join(body)), None))
        i += 1
    return out


_INLINE = re.compile(r"\[([^\]]*)\]\(([^)\s]*)\)|`([^`]+)`|(\*\*|__)(.+?)\4|([*_])(.+?)\6")


def runs(text: str, **style) -> list[dict]:
    """Inline Markdown as styled runs: links, code, bold and italic, nested."""
    out, at = [], 0
    for m in _INLINE.finditer(text):
        if m.start() > at:
            out.append({"text": text[at : m.start()], **style})
        if m[1] is not None:
            out += runs(m[1], **{**style, "link": m[2]})
        elif m[3] is not None:
            out.append({"text": m[3], **style, "code": True})
        elif m[4]:
            out += runs(m[5], **{**style, "bold": True})
        else:
            out += runs(m[7], **{**style, "italic": True})
        at = m.end()
    if at < len(text):
        out.append({"text": text[at:], **style})
    return out


def strip_marks(text: str) -> str:
    return "".join(r["text"] for r in runs(text))


def markdown(rows: DataFrame, key: str = "file", value: str = "value") -> DataFrame:
    """(key, seq, kind, level, text, extra): blocks in order; extra has a table's rows or an image's address as JSON."""

    def run(batches):
        for pdf in batches:
            got = [(k, i, *b) for k, t in zip(pdf[key], pdf[value]) for i, b in enumerate(_markdown(t))]
            yield pd.DataFrame(got, columns=[key, "seq", "kind", "level", "text", "extra"]).astype({"level": "Int32"})

    return rows.select(key, value).mapInPandas(run, f"`{key}` string, seq int, kind string, level int, text string, extra string")


def normalise(rows: DataFrame, key: str = "file", value: str = "value") -> DataFrame:
    """(key, doc, error): JSON of three shapes as a document: a whole one, an array of elements, {pages} or {elements}.

    Missing elements of a page become an empty list, plain strings in lists become items, objects in table rows their
    values in order; empty arrays and other values are errors.
    """

    def element(e):
        if not isinstance(e, dict):
            return {"type": "text", "content": str(e)}
        e = dict(e)
        if e.get("type") == "list":
            e["items"] = [{"content": i} if isinstance(i, str) else i for i in e.get("items") or []]
        if e.get("type") == "table":
            e["rows"] = [list(r.values()) if isinstance(r, dict) else r for r in e.get("rows") or []]
        if isinstance(e.get("elements"), list):
            e["elements"] = [element(x) for x in e["elements"]]
        return e

    def shape(title: str, text: str):
        try:
            v = json.loads(text)
        except (TypeError, ValueError):
            return None, "not JSON"
        if isinstance(v, list):
            v = {"elements": v}
        if not isinstance(v, dict):
            return None, "not a document"
        if "pages" not in v and "elements" in v:
            if not v["elements"]:
                return None, "no elements"
            v = {**{k: x for k, x in v.items() if k != "elements"}, "pages": [{"elements": v["elements"]}]}
        if not isinstance(v.get("pages"), list) or not v["pages"]:
            return None, "no pages"
        v["meta"] = {"title": title, **(v.get("meta") or {})}
        v["pages"] = [{**p, "elements": [element(e) for e in p.get("elements") or []]} for p in v["pages"] if isinstance(p, dict)]
        return json.dumps(v, ensure_ascii=False), None

    def run(batches):
        for pdf in batches:
            got = [shape(re.sub(r"\.[^.]*$", "", str(k).rpartition("/")[2]), t) for k, t in zip(pdf[key], pdf[value])]
            yield pd.DataFrame({key: pdf[key], "json": [g[0] for g in got], "error": [g[1] for g in got]})

    return rows.select(key, value).mapInPandas(run, f"`{key}` string, json string, error string").select(key, F.try_parse_json("json").alias("doc"), "error")
