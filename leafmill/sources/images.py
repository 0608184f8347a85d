"""Images that Markdown refers to, written into it as data URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mime

#: An image: what stands before its address, the address, and a title behind it.
IMAGE = r"(!\[[^\]]*\]\(\s*)([^)\s]+)([^)]*\))"


def plain_path(path: Column) -> Column:
    """A path without `.`, `..` and empty steps; null where it leads above its root."""
    start = F.array().cast("array<string>")
    up = lambda s: F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))
    steps = F.aggregate(
        F.split(path, r"[/\\]"), start,
        lambda s, x: F.when(x.isin("", "."), s).when((x == "..") & (F.size(s) > 0), up(s)).when(x == "..", F.lit(None).cast("array<string>")).otherwise(F.array_append(s, x)),
    )
    return F.when(steps.isNotNull(), F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(steps, "/")))


def image_refs(docs: DataFrame, key: str = "file", value: str = "value") -> DataFrame:
    """(key, seq, src, path): the images of each text in order; path is where a local one lies, null for addresses on the
    net, data and file URLs. A relative one starts from the folder of its text."""
    found = F.regexp_extract_all(F.col(value), F.lit(IMAGE), F.lit(2))
    refs = docs.select(key, F.posexplode(found).alias("seq", "src"))
    folder = F.regexp_extract(F.col(key), r"^(.*)[/\\][^/\\]*$", 1)
    far = F.lower("src").rlike("^(https?:|data:|file:)")
    absolute = F.col("src").rlike(r"^(/|[A-Za-z]:[\\/])")
    whole = F.when(absolute, F.col("src")).when(folder == "", F.col("src")).otherwise(F.concat(folder, F.lit("/"), F.col("src")))
    return refs.select(key, "seq", "src", F.when(~far, plain_path(whole)).alias("path"))


def inline_images(docs: DataFrame, files: DataFrame, key: str = "file", value: str = "value") -> DataFrame:
    """docs with local images as data URLs; files: (path, content). What is not among the files stays as it is.

    References and files meet in a join on the path; then the text between a document's images is put together again.
    A document's images are gathered with it, as they become part of it.
    """
    known = files.select(plain_path(F.col("path")).alias("path"), "content").dropDuplicates(["path"])
    data = F.concat(F.lit("data:"), mime(F.col("path")), F.lit(";base64,"), F.regexp_replace(F.base64("content"), r"\s", ""))
    urls = image_refs(docs, key, value).where("path is not null").join(known, "path").select(key, "seq", data.alias("url"))
    urls = urls.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("seq", "url"))).alias("_urls"))
    text = F.col(value)
    parts = lambda n: F.regexp_extract_all(text, F.lit(IMAGE), F.lit(n))
    between = F.split(text, IMAGE, -1)
    heads, srcs, tails = parts(1), parts(2), parts(3)
    own = lambda s, i: F.when(F.try_element_at("_urls", i).isNull(), F.concat(F.get(heads, i), s)).otherwise(F.concat(F.rtrim(F.get(heads, i)), F.try_element_at("_urls", i)))
    pieces = F.transform(srcs, lambda s, i: F.concat(own(s, i), F.get(tails, i), F.get(between, i + 1)))
    out = docs.join(urls, key, "left")
    return out.withColumn(value, F.when(F.col("_urls").isNull(), text).otherwise(F.concat(F.get(between, F.lit(0)), F.array_join(pieces, "")))).drop("_urls")
