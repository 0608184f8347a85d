"""Search, edits, forms, validation, coverage and fingerprints of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import fold_items


def occurrences(text: Column, query: str) -> Column:
    """0-based places of all non-overlapping occurrences, without regard to case."""
    low = F.lower(text)
    parts = F.split(low, f"\\Q{query.lower()}\\E")
    heads = F.slice(parts, 1, F.size(parts) - 1)
    step = lambda a, p: (F.struct((a["at"] + F.length(p) + len(query)).alias("at")), a["at"] + F.length(p))
    return fold_items(heads, F.struct(F.lit(0).alias("at")), "int", step)["items"]


def context(text: Column, at: Column, size: int, around: int = 30) -> Column:
    """The occurrence with around characters on each side, an ellipsis where text is cut."""
    lo, hi = F.greatest(F.lit(0), at - around), F.least(F.length(text), at + size + around)
    return F.concat(F.when(lo > 0, "…").otherwise(""), F.substring(text, lo + 1, hi - lo), F.when(hi < F.length(text), "…").otherwise(""))


def search(rows: DataFrame, query: str, key: str, text: str = "text", most: int | None = None) -> DataFrame:
    """(key, hit, at, snippet) of all occurrences; most: the first so many over all rows, by key and place."""
    hits = rows.where(F.instr(F.lower(F.col(text)), query.lower()) > 0).select(key, text, F.posexplode(occurrences(F.col(text), query)).alias("hit", "at"))
    hits = hits.select(key, "hit", "at", context(F.col(text), F.col("at"), len(query)).alias("snippet"))
    return hits.orderBy(key, "hit").limit(most) if most else hits


def first_hit(text: Column, query: str) -> Column:
    """0-based place of the first occurrence without regard to case, or null."""
    return F.nullif(F.locate(query.lower(), F.lower(text)), F.lit(0)) - 1


def delete_at(xs: Column, i) -> Column:
    return F.filter(xs, lambda _, j: j != i)


def insert_after(xs: Column, i, x: Column) -> Column:
    return F.array_insert(xs, F.least(F.lit(i) + 2, F.size(xs) + 1), x)


def move(xs: Column, i: int, j: int) -> Column:
    """xs with the item at i moved to place j of the rest; out of range: as it was."""
    rest = delete_at(xs, i)
    return F.when((F.size(xs) > i) & (F.size(xs) > j), F.array_insert(rest, j + 1, F.get(xs, F.lit(i)))).otherwise(xs)


def duplicate(xs: Column, i: int) -> Column:
    return F.when(F.size(xs) > i, insert_after(xs, i, F.get(xs, F.lit(i)))).otherwise(xs)


def newest(rows: DataFrame, by: str, order: list[str], most: int = 100) -> DataFrame:
    """The last `most` states of each key."""
    w = Window.partitionBy(by).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most).drop("_i")


def last_values(fields: DataFrame, by: list[str], value: str, order: Column) -> DataFrame:
    """A form's values: of fields of one name the last wins; first_value is what a single look-up finds."""
    return fields.groupBy(*by).agg(F.max_by(value, order).alias("last_value"), F.min_by(value, order).alias("first_value"), F.count("*").alias("n"))


def violations(rows: DataFrame, table: str, key: Column, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(table, severity, rule, key) for each rule (severity, name, predicate that must hold) a row breaks; null breaks it.
    All rules in one pass over the rows."""
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(sev).alias("severity"), F.lit(name).alias("rule"))) for sev, name, ok in rules))
    return rows.select(F.lit(table).alias("table_name"), key.cast("string").alias("key"), F.explode(F.filter(broken, lambda b: b.isNotNull())).alias("v")).select("table_name", "v.severity", "v.rule", "key")


def structure_report(docs: DataFrame, version_field: str, key: str = "doc_id", doc: str = "doc") -> DataFrame:
    """(key, severity, message): what a JSON document (VARIANT) lacks: its version, meta, pages, their elements and types.
    Places count from 0. A null document lacks all of them."""
    from .elements import KINDS

    d, none = F.col(doc), F.array().cast("array<struct<severity:string,message:string>>")
    at = lambda v, p: F.try_variant_get(v, p, "variant")
    there = lambda v, p: at(v, p).isNotNull() & ~F.is_variant_null(at(v, p))
    is_object = lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    is_text = lambda v, p: F.coalesce(F.schema_of_variant(at(v, p)) == "STRING", F.lit(False))
    found = lambda message, severity="error": F.struct(F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"))
    version = f"$['{version_field}']"
    elements = lambda p: F.try_variant_get(p, "$.elements", "array<variant>")

    def of_element(e: Column, page: Column, i: Column) -> Column:
        place = F.concat(F.lit("page["), page.cast("string"), F.lit("].element["), i.cast("string"), F.lit("].type "))
        kind = F.try_variant_get(e, "$.type", "string")
        unknown = found(F.concat(place, F.lit('"'), kind, F.lit('" is not a known type')), "warning")
        return F.when(~is_text(e, "$.type"), found(F.concat(place, F.lit("missing")))).when(~kind.isin(*KINDS), unknown)

    def of_page(p: Column, i: Column) -> Column:
        place = F.concat(F.lit("page["), i.cast("string"), F.lit("]"))
        inner = F.filter(F.transform(elements(p), lambda e, j: of_element(e, i, j)), lambda m: m.isNotNull())
        lacking = F.array(found(F.concat(place, F.lit(".elements missing or not an array"))))
        return F.when(~is_object(p), F.array(found(F.concat(place, F.lit(" must be an object"))))).when(elements(p).isNull(), lacking).otherwise(inner)

    pages = F.try_variant_get(d, "$.pages", "array<variant>")
    head = F.array(
        F.when(at(d, version).isNull(), found(f"Missing required field: {version_field}")).when(~is_text(d, version), found(f"{version_field} must be a string")),
        F.when(at(d, "$.meta").isNull(), found("Missing required field: meta")).when(~is_object(at(d, "$.meta")), found("meta must be an object")).when(~is_text(d, "$.meta.title"), found("meta.title is missing or empty", "warning")),
        F.when(pages.isNull(), found("Missing required field: pages (must be array)")).when(F.size(pages) == 0, found("pages is empty, at least one page required")),
    )
    rest = F.coalesce(F.flatten(F.transform(pages, of_page)), none)
    return docs.select(key, F.explode(F.concat(F.filter(head, lambda m: m.isNotNull()), rest)).alias("m")).select(key, "m.*")


def coverage(rows: DataFrame, by: list[str], covered: Column) -> DataFrame:
    """Totals, covered and missing by the columns of by and over all (rollup, null keys), with a summary sentence."""
    out = rows.rollup(*by).agg(F.count("*").alias("total"), F.count_if(covered).alias("covered"))
    out = out.withColumn("missing", F.col("total") - F.col("covered"))
    return out.withColumn("summary", F.concat_ws(" ", F.col("covered").cast("string"), F.lit("of"), F.col("total").cast("string"), F.lit("covered")))


def intern(assets: DataFrame, key: str, content: Column) -> DataFrame:
    """(key, asset, canonical): assets of equal bytes share the hash and the smallest key."""
    from ..functions.text import asset_hash

    h = assets.select(key, asset_hash(content).alias("asset"))
    return h.join(h.groupBy("asset").agg(F.min(key).alias("canonical"), F.count("*").alias("uses")), "asset")


def fingerprint(words: Column) -> Column:
    """Digest of a multiset of words."""
    return F.substring(F.sha1(F.array_join(F.sort_array(words), " ")), 1, 16)


#: Kinds whose number may differ a little between two readings of a page (fixed values): by a tenth, by two at least.
LOOSE = ("shape", "image")


def fingerprints(elements: DataFrame, key: str = "doc_id", order: str = "n") -> DataFrame:
    """(key, page, what, name, n): what a document is made of, as counts.

    elements: (key, page, order, type, text, font, shape). Rows of what: type, elements of a kind; font, families of
    a page (the first of a list, without quotes); table, the shapes of its tables in their order as one name; words, its
    words; and, with page 0, text: the hash of all words of the document, sorted, so that their order does not count.
    """
    e = elements.withColumn("_w", F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " ")), " "), lambda w: w != ""))
    row = lambda what, name, n: (F.lit(what).alias("what"), name.alias("name"), n.cast("long").alias("n"))
    kinds = e.groupBy(key, "page", F.col("type").alias("name")).agg(F.count("*").alias("n")).select(key, "page", *row("type", F.col("name"), F.col("n")))
    family = F.regexp_replace(F.trim(F.get(F.split("font", ","), F.lit(0))), "['\"]", "")
    fonts = e.where("font is not null").select(key, "page", family.alias("name")).distinct().select(key, "page", *row("font", F.col("name"), F.lit(1)))
    shapes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "shape"))), lambda s: s["shape"]), " ")
    tables = e.where("shape is not null").groupBy(key, "page").agg(shapes.alias("name"), F.count("*").alias("n")).select(key, "page", *row("table", F.col("name"), F.col("n")))
    words = e.groupBy(key, "page").agg(F.sum(F.size("_w")).alias("n")).select(key, "page", *row("words", F.lit(""), F.col("n")))
    text = e.groupBy(key).agg(F.flatten(F.collect_list("_w")).alias("w")).select(key, F.lit(0).alias("page"), *row("text", F.substring(F.sha1(F.array_join(F.sort_array("w"), "\n")), 1, 16), F.size("w")))
    return kinds.unionByName(fonts).unionByName(tables).unionByName(words).unionByName(text)


def differences(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, what, name, was, now): facts of either side's fingerprints that the other lacks or counts otherwise; 0
    where there is none. Kinds of LOOSE may differ by a tenth, by two at least."""
    on = [key, "page", "what", "name"]
    both = before.withColumnRenamed("n", "was").join(after.withColumnRenamed("n", "now"), on, "full_outer").fillna(0, ["was", "now"])
    off, most = F.abs(F.col("was") - F.col("now")), F.greatest("was", "now")
    allowed = F.when((F.col("what") == "type") & F.col("name").isin(*LOOSE), F.greatest(F.lit(2), F.ceil(most * 0.1))).otherwise(0)
    return both.where(off > allowed).select(*on, "was", "now")


def counts(docs: DataFrame, key: str = "doc_id", doc: str = "doc") -> DataFrame:
    """(key, pages, elements): how many a JSON document (VARIANT) has; 0 where there are none."""
    none = F.array().cast("array<variant>")
    pages = F.coalesce(F.try_variant_get(doc, "$.pages", "array<variant>"), none)
    sizes = F.transform(pages, lambda p: F.size(F.coalesce(F.try_variant_get(p, "$.elements", "array<variant>"), none)))
    return docs.select(key, F.size(pages).alias("pages"), F.aggregate(sizes, F.lit(0), lambda a, n: a + n).alias("elements"))


def search_lines(rows: DataFrame, query: str, key: str, text: str = "text") -> DataFrame:
    """(key, line, hit, at, snippet): occurrences in the lines of a text; lines count from 1, hits and places from 0."""
    lines = rows.where(F.instr(F.lower(F.col(text)), query.lower()) > 0).select(key, F.posexplode(F.split(text, "\n")).alias("line", "_l"))
    hits = lines.where(F.instr(F.lower("_l"), query.lower()) > 0).select(key, (F.col("line") + 1).alias("line"), "_l", F.posexplode(occurrences(F.col("_l"), query)).alias("hit", "at"))
    return hits.select(key, "line", "hit", "at", context(F.col("_l"), F.col("at"), len(query)).alias("snippet"))
