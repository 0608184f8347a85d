"""Chunks: breadcrumbs and sections from windows, greedy budgets from an ordered fold, assembly and hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import fold_items
from ..functions.text import clock, collapse, content_hash, trim_all, utf16_len


def breadcrumbs(rows: DataFrame, key: str = "doc_id", order: str = "seq", level: str = "level", text: str = "text") -> DataFrame:
    """rows with path: for each level the latest heading that no later heading of a lower level ended.

    The length is the latest heading's level; skipped levels are null.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows
    for n in range(1, 7):
        out = out.withColumn(f"_s{n}", F.last(F.when(F.col(level) == n, F.col(order)), True).over(w)).withColumn(f"_t{n}", F.last(F.when(F.col(level) == n, F.col(text)), True).over(w))
    out = out.withColumn("_n", F.last(F.when(F.col(level).between(1, 6), F.col(level)), True).over(w))
    lower = lambda n: F.greatest(*(F.coalesce(F.col(f"_s{i}"), F.lit(-1)) for i in range(1, n)), F.lit(-1)) if n > 1 else F.lit(-1)
    parts = [F.when(F.col(f"_s{n}") > lower(n), F.col(f"_t{n}")) for n in range(1, 7)]
    out = out.withColumn("path", F.coalesce(F.slice(F.array(*parts), 1, F.coalesce("_n", F.lit(0))), F.array().cast("array<string>")))
    return out.drop(*(f"_{c}{n}" for c in "st" for n in range(1, 7)), "_n")


def sections(rows: DataFrame, key: str = "doc_id", order: str = "seq", level: str = "level") -> DataFrame:
    """rows with section: it grows at each heading that does not follow a heading."""
    w = Window.partitionBy(key).orderBy(order)
    heading = F.col(level).isNotNull()
    begins = heading & ~F.coalesce(F.lag(heading).over(w), F.lit(True))
    return rows.withColumn("section", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def greedy(costs: Column, most) -> Column:
    """Group number of each cost, in order: a new group begins where the sum would pass most; none is ever split."""
    def step(a: Column, c: Column) -> tuple[Column, Column]:
        full = (a["group"] < 0) | (a["sum"] + c > most)
        group = a["group"] + full.cast("int")
        return F.struct(F.when(full, c.cast("bigint")).otherwise(a["sum"] + c).alias("sum"), group.alias("group")), group

    return fold_items(costs, F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-1).alias("group")), "int", step)["items"]


def budget_groups(rows: DataFrame, by: list[str], order: str, cost: str, most: int) -> DataFrame:
    """rows with part: greedy groups of at most most within each key of by, in order. Keys are documents or sections,
    whose rows fit in one row of arrays; only order and cost are gathered."""
    got = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, cost))).alias("x"))
    got = got.select(*by, F.explode(F.arrays_zip(F.transform("x", lambda r: r[order]).alias("o"), greedy(F.transform("x", lambda r: r[cost]), F.lit(most)).alias("part"))).alias("z")).select(*by, F.col("z.o").alias(order), F.col("z.part").alias("part"))
    return rows.join(got, [*by, order])


def assemble(rows: DataFrame, by: list[str], order: str = "seq", joiner: str = "\n\n") -> DataFrame:
    """One chunk per key of by: id, page and path of its first row, joined non-empty texts, kinds in order of first
    sight, tokens and hash of the joined text; chunks without text are dropped. rows: el_id, page, type, text, path."""
    x = F.array_sort(F.collect_list(F.struct(order, "el_id", "page", "type", "text", "path")))
    out = rows.groupBy(*by).agg(x.alias("x"))
    text = trim_all(F.array_join(F.filter(F.transform("x", lambda r: r["text"]), lambda t: F.coalesce(t, F.lit("")) != ""), joiner))
    heads = F.filter("x", lambda r: r["path"].isNotNull())
    out = out.select(*by, F.col("x")[0]["el_id"].alias("id"), text.alias("text"), F.element_at(heads, 1)["path"].alias("path"), F.col("x")[0]["page"].alias("page"), F.array_distinct(F.transform("x", lambda r: r["type"])).alias("types"))
    return out.where("text <> ''").withColumn("tokens", F.ceil(utf16_len(F.col("text")) / F.lit(4.0)).cast("int")).withColumn("hash", content_hash(F.col("text")))


def chunk(elements: DataFrame, strategy: str = "section", max_tokens: int = 512, key: str = "doc_id") -> DataFrame:
    """Chunks of elements (key, seq, el_id, page, type, level, text) by strategy: element, fixed or section.

    section: sections, cut greedily where they pass max_tokens, all under the breadcrumb after the section's leading
    headings. fixed: greedy over the document, each chunk under the breadcrumb at the first element of the next one.
    element: each element by itself.
    """
    rows = breadcrumbs(elements, key).withColumn("cost", F.ceil(utf16_len(F.col("text")) / F.lit(4.0)).cast("int"))
    if strategy == "element":
        return assemble(rows, [key, "seq"]).withColumn("part", F.lit(0))
    if strategy == "fixed":
        rows = budget_groups(rows, [key], "seq", "cost", max_tokens)
        following = rows.groupBy(key, "part").agg(F.min_by("path", "seq").alias("first"), F.max_by("path", "seq").alias("last")).withColumn("crumb", F.coalesce(F.lead("first").over(Window.partitionBy(key).orderBy("part")), "last"))
        return assemble(rows.drop("path").join(following.select(key, "part", F.col("crumb").alias("path")), [key, "part"]), [key, "part"])
    rows = sections(rows, key)
    leads = F.col("level").isNotNull()
    s = Window.partitionBy(key, "section").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_lead", leads & (F.sum((~leads).cast("int")).over(s) == 0))
    whole = Window.partitionBy(key, "section")
    head = F.max(F.when(F.col("_lead"), F.struct("seq", "path"))).over(whole)["path"]
    rows = rows.withColumn("path", F.coalesce(head, F.min(F.struct("seq", "path")).over(whole)["path"])).drop("_lead")
    return assemble(budget_groups(rows, [key, "section"], "seq", "cost", max_tokens), [key, "section", "part"])


def embedding_text(path: Column, text: Column) -> Column:
    crumb = F.array_join(F.filter(path, lambda p: F.coalesce(p, F.lit("")) != ""), " > ")
    return F.when(crumb != "", F.concat(crumb, F.lit("\n"), text)).otherwise(text)


def windows(segments: Column, seconds: float, max_tokens: int) -> Column:
    """Window number of each segment (t0, t1, text, chapter), in order: a new one begins where the chapter changes,
    where the segment's end is more than seconds after the window's start, or where the text would pass max_tokens."""
    start = F.struct(F.lit(0.0).alias("t0"), F.lit(None).cast("string").alias("chapter"), F.lit(0).cast("bigint").alias("len"), F.lit(-1).alias("n"))

    def step(a: Column, s: Column) -> tuple[Column, Column]:
        size = utf16_len(s["text"]).cast("bigint")
        fresh = (a["n"] < 0) | ~s["chapter"].eqNullSafe(a["chapter"]) | (s["t1"] - a["t0"] > seconds) | (F.ceil((a["len"] + size) / F.lit(4.0)) > max_tokens)
        n = a["n"] + fresh.cast("int")
        return F.struct(F.when(fresh, s["t0"]).otherwise(a["t0"]).alias("t0"), s["chapter"].alias("chapter"), F.when(fresh, size).otherwise(a["len"] + 1 + size).alias("len"), n.alias("n")), n

    return fold_items(segments, start, "int", step)["items"]


def transcript_chunks(segments: DataFrame, key: str = "doc_id", seconds: float = 45, max_tokens: int = 512) -> DataFrame:
    """Chunks of segments (key, t0, t1, text, speaker, chapter); blank segments are left out."""
    s = segments.where(trim_all(F.col("text")) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t0", "t1", "text", "speaker", "chapter"))).alias("s"))
    s = s.select(key, F.explode(F.arrays_zip("s", windows(F.col("s"), seconds, max_tokens).alias("n"))).alias("z")).select(key, "z.n", "z.s.*")
    said = F.array_sort(F.collect_list(F.struct("t0", "t1", F.concat(F.coalesce(F.concat(F.nullif("speaker", F.lit("")), F.lit(": ")), F.lit("")), F.col("text")).alias("text"))))
    out = s.groupBy(key, "n").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.first("chapter").alias("chapter"), said.alias("said"))
    body = collapse(F.array_join(F.transform("said", lambda r: r["text"]), " "))
    text = F.concat(F.lit("["), clock(F.col("t0")), F.lit("–"), clock(F.col("t1")), F.lit("] "), body)
    return out.select(key, "n", "t0", "t1", "chapter", text.alias("text")).withColumn("tokens", F.ceil(utf16_len(F.col("text")) / F.lit(4.0)).cast("int")).withColumn("hash", content_hash(F.col("text")))


#: Where texts are parted, from the best place to the worst: paragraphs, lines, words, characters (fixed values).
SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: Column, size: int, level: int = 0) -> Column:
    """Parts of a text between separators of a level, those longer than size parted at the next; all but the last get the separator back."""
    sep, last = SEPARATORS[level], level + 1 == len(SEPARATORS)
    parts = F.filter(F.split(text, sep), lambda p: p != "")
    if not last:
        parts = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(_pieces(p, size, level + 1))))
    whole = F.transform(F.array(parts), lambda x: F.transform(x, lambda p, i: F.when(i < F.size(x) - 1, F.concat(p, F.lit(sep))).otherwise(p)))
    return F.get(whole, F.lit(0))


def split_characters(docs: DataFrame, size: int = 1000, overlap: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece_no, piece): pieces of about size characters, each led by the last `overlap` of the one before.

    A text is parted at blank lines; parts that are too long at line ends, then at spaces, then anywhere. Empty parts go.
    At each level every part but the last gets its separator back, parts cut finer included, so some gain several.
    Pieces are stripped; a separator and the overlap may take one past size. The lengths of the parts tell which of them
    a piece takes (first, number); the texts are joined afterwards.
    """
    span = "struct<at: int, n: int>"
    start = F.struct(F.lit(0).alias("held"), F.lit(0).alias("at"), F.lit(0).alias("n"))
    none = F.array().cast(f"array<{span}>")

    def count(s: Column, n: Column) -> tuple[Column, Column]:
        full = (s["held"] > 0) & (s["held"] + n > size)
        after = F.struct(
            (F.when(full, F.least(s["held"], F.lit(overlap))).otherwise(s["held"]) + n).alias("held"), F.when(full, s["at"] + s["n"]).otherwise(s["at"]).alias("at"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"),
        )
        return after, F.when(full, F.array(F.struct(s["at"].alias("at"), s["n"].alias("n")))).otherwise(none)

    counted = fold_items(F.transform("parts", lambda p: F.length(p)), start, f"array<{span}>", count)

    def join(s: Column, x: Column) -> tuple[Column, Column]:
        tail = F.right(s["last"], F.lit(overlap)) if overlap > 0 else F.lit("")
        own = F.concat(tail, F.array_join(F.slice("parts", x["at"] + 1, x["n"]), ""))
        return F.struct(own.alias("last")), own

    joined = F.transform(fold_items(F.col("spans"), F.struct(F.lit("").alias("last")), "string", join)["items"], trim_all)
    got = docs.select(key, _pieces(F.coalesce(F.col(text), F.lit("")), size).alias("parts"))
    last = F.struct(F.col("c.state.at").alias("at"), F.col("c.state.n").alias("n"))
    got = got.select(key, "parts", counted.alias("c")).select(key, "parts", F.array_append(F.flatten("c.items"), last).alias("spans")).select(key, joined.alias("pieces"))
    # The outer form: with the other, Spark would work the pieces out a second time to see whether there are any.
    rows = got.select(key, F.size("pieces").alias("_n"), F.posexplode_outer("pieces").alias("piece_no", "piece"))
    return rows.where((F.col("piece") != "") | (F.col("piece_no") < F.col("_n") - 1)).select(key, "piece_no", "piece")
