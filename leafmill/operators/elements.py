"""Documents as relations: pages and elements of a JSON tree held as VARIANT, in document order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import trim_all, utf16_len
from .trees import list_lines, load, nested

KINDS = ("text", "richtext", "image", "video", "table", "list", "shape", "collapsible", "toc", "input", "textarea", "checkbox", "select", "signature")


def parse_documents(raw: DataFrame, text: str = "value") -> DataFrame:
    """raw with column doc (VARIANT); null where the text is no JSON."""
    return raw.withColumn("doc", F.try_parse_json(text))


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def kind_of(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def element_id(el: Column, page: Column, idx: Column) -> Column:
    """Its own id if that is a non-empty string, else p{page}e{idx}: page 1-based, idx 0-based."""
    own = F.when(kind_of(el, "$.id") == "STRING", get(el, "$.id"))
    return F.coalesce(F.nullif(own, F.lit("")), F.concat(F.lit("p"), page.cast("string"), F.lit("e"), idx.cast("string")))


def heading_level(el: Column) -> Column:
    """heading true: 1; a number 1 to 6: that; else a numeric tocLevel; else null. Only text elements have one."""
    kind, toc = kind_of(el, "$.heading"), kind_of(el, "$.tocLevel")
    number = get(el, "$.heading", "int")
    level = (
        F.when((kind == "BOOLEAN") & get(el, "$.heading", "boolean"), 1)
        .when((kind != "BOOLEAN") & number.between(1, 6), number)
        .when(toc.isNotNull() & (toc != "BOOLEAN") & (toc != "STRING"), get(el, "$.tocLevel", "int"))
    )
    return F.when(get(el, "$.type") == "text", level)


def top_level(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, el_idx, el_id, type, level, el): the elements of all pages; page from 1, el_idx from 0."""
    docs.createOrReplaceTempView("_leafmill_docs")
    rows = docs.sparkSession.sql(
        f"select d.`{key}`, cast(p.pos + 1 as int) as page, e.pos as el_idx, e.value as el from _leafmill_docs d, lateral variant_explode(try_variant_get(d.doc, '$.pages', 'variant')) p, lateral variant_explode(try_variant_get(p.value, '$.elements', 'variant')) e"
    )
    return rows.select(key, "page", "el_idx", element_id(F.col("el"), F.col("page"), F.col("el_idx")).alias("el_id"), get(F.col("el"), "$.type").alias("type"), heading_level(F.col("el")).alias("level"), "el")


def walk(elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """elements and, level by level, those nested in collapsibles: adds el_path (array of places) and depth.

    Only elements with nested ones are unrolled, in Arrow batches and to any depth; flat ones are joined in after it.
    """
    first = elements.withColumn("el_path", F.array(F.col("el_idx").cast("int"))).withColumn("depth", F.lit(0))
    holders = elements.where(F.try_variant_get("el", "$.elements", "variant").isNotNull()).select(key, "page", F.col("el_idx").cast("int").alias("el_idx"), F.to_json("el").alias("el"))

    def run(batches):
        for pdf in batches:
            rows = [(k, p, *r) for k, p, i, e in zip(pdf[key], pdf["page"], pdf["el_idx"], pdf["el"]) for r in nested(load(e) or {}, int(i))]
            yield pd.DataFrame(rows, columns=[key, "page", "el_path", "depth", "el"])

    deep = holders.mapInPandas(run, f"`{key}` {dict(elements.dtypes)[key]}, page int, el_path array<int>, depth int, el string").withColumn("el", F.parse_json("el"))
    cols = [key, "page", "el_path", "depth", "el"]
    return first.select(*cols).unionByName(deep).withColumn("type", get(F.col("el"), "$.type"))


def _strings(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>"))


def _cells(v: Column, path: str) -> Column:
    """Cells as text: a string, or the content of an object."""
    cell = lambda c: F.coalesce(F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string")), F.try_variant_get(c, "$.content", "string"), F.try_variant_get(c, "$", "string"), F.lit(""))
    return F.transform(F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>")), cell)


def table_rows(headers: Column, rows: Column) -> Column:
    """Rows as lines `header: value | header: value`; blank cells are left out, blank rows too; no header: the value."""
    cell = lambda h, c: F.when(F.coalesce(trim_all(h), F.lit("")) == "", trim_all(c)).otherwise(F.concat(trim_all(h), F.lit(": "), trim_all(c)))
    line = lambda r: F.array_join(F.filter(F.zip_with(headers, r, lambda h, c: F.when(F.coalesce(trim_all(c), F.lit("")) != "", cell(h, c))), lambda x: x.isNotNull()), " | ")
    return F.array_join(F.filter(F.transform(rows, line), lambda x: x != ""), "\n")


def _list_lines(items: Column, depth: int, levels: int) -> Column:
    """Lines `- content` indented two spaces a level, children after their item; the first levels are unrolled."""
    def lines(i: Column) -> Column:
        own = F.array(F.concat(F.lit("  " * depth + "- "), trim_all(F.coalesce(F.when(F.schema_of_variant(i) == "STRING", F.try_variant_get(i, "$", "string")), F.try_variant_get(i, "$.content", "string"), F.lit("")))))
        if depth + 1 >= levels:
            return own
        return F.concat(own, _list_lines(F.try_variant_get(i, "$.children", "array<variant>"), depth + 1, levels))

    return F.flatten(F.transform(F.coalesce(items, F.array().cast("array<variant>")), lines))


@F.pandas_udf(StringType())
def _deep_list(items: pd.Series) -> pd.Series:
    return items.map(lambda x: None if x is None else "\n".join(list_lines(load(x))))


def _goes_deeper(items: Column, levels: int) -> Column:
    """Whether an item stands below the first levels."""
    inner = lambda i: F.try_variant_get(i, "$.children", "array<variant>")
    return F.exists(items, lambda i: F.size(F.coalesce(inner(i), F.array().cast("array<variant>"))) > 0 if levels == 1 else F.coalesce(_goes_deeper(inner(i), levels - 1), F.lit(False)))


def list_text(el: Column, levels: int = 4) -> Column:
    """Lines of a list: its first levels as expressions; a list that goes deeper is read whole in an Arrow batch instead."""
    items = F.try_variant_get(el, "$.items", "array<variant>")
    deeper = _deep_list(F.when(_goes_deeper(items, levels), F.to_json(F.try_variant_get(el, "$.items", "variant"))))
    return F.coalesce(deeper, F.array_join(_list_lines(items, 0, levels), "\n"))


def serialize(el: Column, list_levels: int = 4) -> Column:
    """Text of an element by kind; shapes, tables of contents and signatures have none."""
    t = get(el, "$.type")
    text = lambda p: F.coalesce(get(el, p), F.lit(""))
    join = lambda sep, *parts: F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), sep)
    headers = F.when(F.size(_cells(el, "$.headers")) > 0, _cells(el, "$.headers")).otherwise(F.transform(F.coalesce(F.try_variant_get(el, "$.columns", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.coalesce(F.try_variant_get(c, "$.header", "string"), F.lit(""))))
    rows = F.transform(F.coalesce(F.try_variant_get(el, "$.rows", "array<variant>"), F.array().cast("array<variant>")), lambda r: _cells(r, "$"))
    ocr = F.transform(F.coalesce(F.try_variant_get(el, "$.ocr.blocks", "array<variant>"), F.array().cast("array<variant>")), lambda b: F.try_variant_get(b, "$.text", "string"))
    label = F.coalesce(F.nullif(get(el, "$.label"), F.lit("")), get(el, "$.name"))
    value = F.coalesce(F.nullif(F.array_join(_strings(el, "$.values"), ", "), F.lit("")), get(el, "$.value"), F.lit(""))
    field = F.when(value != "", F.concat_ws(": ", label, value)).otherwise(F.coalesce(label, F.lit("")))
    return (
        F.when(t == "text", trim_all(text("$.content")))
        .when(t == "richtext", trim_all(F.array_join(F.transform(F.coalesce(F.try_variant_get(el, "$.runs", "array<variant>"), F.array().cast("array<variant>")), lambda r: F.coalesce(F.try_variant_get(r, "$.text", "string"), F.lit(""))), "")))
        .when(t == "list", list_text(el, list_levels))
        .when(t == "table", table_rows(headers, rows))
        .when(t == "collapsible", trim_all(text("$.title")))
        .when(t == "image", join("\n", F.when(text("$.alt") != "", F.concat(F.lit("[image: "), text("$.alt"), F.lit("]"))), text("$.caption"), F.array_join(ocr, "\n")))
        .when(t == "video", join("\n", text("$.title"), text("$.caption")))
        .when(t == "checkbox", F.concat(F.when(F.coalesce(get(el, "$.checked", "boolean"), F.lit(False)), "[x] ").otherwise("[ ] "), F.coalesce(label, F.lit(""))))
        .when(t.isin("input", "textarea", "select"), field)
        .otherwise("")
    )


def cost(text: Column) -> Column:
    return F.ceil(utf16_len(text) / F.lit(4.0)).cast("int")


def has_media_text(el: Column) -> Column:
    """Images with a caption or recognised text, videos with segments; null for other kinds."""
    size = lambda p: F.size(F.coalesce(F.try_variant_get(el, p, "array<variant>"), F.array().cast("array<variant>")))
    t = get(el, "$.type")
    return F.when(t == "image", (F.coalesce(get(el, "$.caption"), F.lit("")) != "") | (size("$.ocr.blocks") > 0)).when(t == "video", size("$.transcript.segments") > 0)


def resolve_style(names: Column, styles: Column) -> Column:
    """Maps of the named styles merged from left to right, later keys win (an ordered fold, no session setting)."""
    merge = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    return F.aggregate(names, F.create_map().cast("map<string,string>"), lambda acc, n: merge(acc, F.coalesce(F.try_element_at(styles, n), F.create_map().cast("map<string,string>"))))


def resource(doc: Column, key: Column) -> Column:
    """The resource of a key in a document (VARIANT): an entry of its own that holds data, else the image, else the video."""
    held = lambda path: F.try_element_at(F.try_variant_get(doc, path, "map<string,variant>"), key)
    there = lambda v: F.when(v.isNotNull() & ~F.is_variant_null(v), v)
    direct = held("$.resources")
    return F.coalesce(F.when(F.try_variant_get(direct, "$.data", "variant").isNotNull(), direct), there(held("$.resources.images")), there(held("$.resources.videos")))


#: Sheets in millimetres (fixed values).
SHEETS = {"A3": (297.0, 420.0), "A4": (210.0, 297.0), "A5": (148.0, 210.0), "Letter": (215.9, 279.4), "Legal": (215.9, 355.6), "Tabloid": (279.4, 431.8)}


def page_size(page: Column, doc: Column) -> Column:
    """(width, height) in mm of a page: its own size, else the document's, by name or in figures; else A4. Landscape
    swaps the two."""
    own = lambda p: F.coalesce(F.try_variant_get(page, f"$.{p}", "variant"), F.try_variant_get(doc, f"$.meta.{p}", "variant"))
    size, name = own("pageSize"), F.try_variant_get(own("pageSize"), "$", "string")
    named = lambda i: F.try_element_at(F.create_map(*(F.lit(x) for k, v in SHEETS.items() for x in (k, v[i]))), name)
    w, h = (F.coalesce(F.try_variant_get(size, f"$.{f}", "double"), named(i), F.lit(SHEETS["A4"][i])) for i, f in enumerate(("width", "height")))
    turned = F.coalesce(F.try_variant_get(own("pageOrientation"), "$", "string") == "landscape", F.lit(False))
    return F.struct(F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))


#: Margins in millimetres where nothing says otherwise (fixed values).
MARGINS = {"top": 25.0, "right": 20.0, "bottom": 25.0, "left": 20.0}


def margins(page: Column, doc: Column) -> Column:
    """(top, right, bottom, left): each from the page, else from the document, else MARGINS."""
    side = lambda s, usual: F.coalesce(F.try_variant_get(page, f"$.margins.{s}", "double"), F.try_variant_get(doc, f"$.meta.margins.{s}", "double"), F.lit(usual)).alias(s)
    return F.struct(*(side(s, v) for s, v in MARGINS.items()))


def running_part(page: Column, doc: Column, part: str) -> Column:
    """The header or footer (part) of a page: its own, else the document's."""
    here = lambda v: F.try_variant_get(v, f"$.{part}", "variant")
    return F.coalesce(F.when(~F.is_variant_null(here(page)), here(page)), here(doc))
