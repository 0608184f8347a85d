"""Queries over whole pipelines: streams with removals, several retrievers, providers, images, differences of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import documents as dc
from ..operators import evaluation as ev
from ..sources import images
from ..sources.shared import shared_dir
from ..streaming import ingest
from .catalogue import query, t


@query(
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as text, unnest(range(len(string_split(text, chr(10))))) as i from documents),
v as (select doc_id, i, case when doc_id % 3 = 0 and i = 0 then text || '!' else text end as text, case when doc_id % 2 = 0 and i % 2 = 1 then 1 when doc_id % 3 = 0 and i = 0 then 1 else 0 end as changed from l)
select doc_id, 'c' || i as chunk_id, substr(sha256(text), 1, 12) as hash from v where doc_id % 5 <> 4 and not (doc_id % 2 = 0 and i % 2 = 1)"""
)
def stream_removals(spark, d):
    """Two versions of each document: even ones lose every other line, every third changes its first, every fifth goes."""
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    text = F.when((F.col("doc_id") % 3 == 0) & (F.col("i") == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    chunk = F.concat(F.lit("c"), F.col("i").cast("string"))
    first = lines.select("doc_id", F.lit(0).cast("long").alias("version"), chunk.alias("chunk_id"), tx.content_hash(F.col("text")).alias("hash"))
    second = lines.where("doc_id % 5 <> 4 and not (doc_id % 2 = 0 and i % 2 = 1)").select("doc_id", F.lit(1).cast("long").alias("version"), chunk.alias("chunk_id"), tx.content_hash(text).alias("hash"))
    gone = t(spark, d, "documents").where("doc_id % 5 = 4").select("doc_id", F.lit(1).cast("long").alias("version"), F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("hash"))
    base = f"{shared_dir(spark)}/leafmill/removals-{uuid.uuid4().hex}"
    for version in (first, second.unionByName(gone)):
        version.write.mode("append").parquet(f"{base}/versions")
        source = spark.readStream.schema(first.schema).parquet(f"{base}/versions")
        ingest.follow(source, f"{base}/changes", f"{base}/checkpoint").awaitTermination()
    return ingest.compact(spark, f"{base}/changes", f"{base}/compact").select("doc_id", "chunk_id", "hash")


#: Ranked results of three retrievers: of each question, parts that a rule picks.
_RANKS = """q as (select p_partkey as item_id, p_brand as type, p_size % 7 as want from part), c as (select s_suppkey as chunk_id, s_suppkey % 7 as about, (s_suppkey * 13 % 50 + 1)::bigint as tokens from supplier),
n as (select count(*) as n from supplier),
r as (select 'first' as retriever, item_id, k as rank, (item_id * 3 + k) % n.n + 1 as chunk_id from q, n, (select unnest(range(1, 11)) as k) union all
  select 'second', item_id, k, (item_id + k * k) % n.n + 1 from q, n, (select unnest(range(1, 6)) as k) where item_id % 4 <> 0 union all
  select 'third', item_id, k, (item_id * 7 + k * 5) % n.n + 1 from q, n, (select unnest(range(1, 11)) as k)),
f as (select r.*, about = want as hit, sum(tokens) over (partition by retriever, item_id order by rank) as read, tokens from r join q using (item_id) join c using (chunk_id)),
p as (select x.retriever, q.item_id, q.type, coalesce(min(rank) filter (hit), 0) as rank, arg_min(read, rank) filter (hit) as tth, coalesce(sum(tokens) filter (rank <= 5), 0) as ctx from q cross join (values ('first'), ('second'), ('third')) x(retriever) left join f on f.item_id = q.item_id and f.retriever = x.retriever group by all)"""


@query(
    f"""with {_RANKS} select retriever, type, count(*) as n, round(avg((rank between 1 and 1)::int), 6) as recall_1, round(avg((rank between 1 and 5)::int), 6) as recall_5, round(avg((rank between 1 and 10)::int), 6) as recall_10,
round(avg(case when rank > 0 then 1.0 / rank::double else 0.0 end), 6) as mrr, round(avg(tth), 6) as tokens_to_hit, round(avg(ctx), 6) as context_5 from p group by grouping sets ((retriever, type), (retriever))"""
)
def retriever_scores(spark, d):
    q = t(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("type"), (F.col("p_size") % 7).alias("want"))
    s = F.col("s_suppkey")
    chunks = t(spark, d, "supplier").select(s.alias("chunk_id"), (s % 7).alias("about"), (s * 13 % 50 + 1).alias("tokens"))
    size = chunks.count()
    ranks = lambda most, at, of=q: of.select("item_id", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("rank")).select("item_id", "rank", (at % size + 1).alias("chunk_id"))
    i, k = F.col("item_id"), F.col("rank")
    results = {"first": ranks(10, i * 3 + k), "second": ranks(5, i + k * k, q.where("item_id % 4 <> 0")), "third": ranks(10, i * 7 + k * 5)}
    return ev.evaluate(results, q, chunks, F.col("about") == F.col("want"))[0]


@query("select doc_id, length(coalesce(text, ''))::int as n, doc_id % 3 = 0 as known from documents")
def cached_vectors(spark, d):
    """Vectors of documents whose every third is in the cache already; the vector tells how long a text the model saw."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    length = lambda texts: [[float(len(x)), 0.0] for x in texts]
    shown = F.sha2(ev.prefixed(F.coalesce("text", F.lit("")), "e5-small", "document"), 256)
    cache = docs.where("doc_id % 3 = 0").select(F.lit("e5-small").alias("model"), shown.alias("hash"), F.array(F.length("text").cast("float") + 9, F.lit(1.0).cast("float")).alias("vector")).dropDuplicates(["hash"])
    vectors, _ = ev.embed_cached(docs, cache, length, "e5-small", key="doc_id")
    copies = docs.join(docs.where("doc_id % 3 = 0").select("text").distinct(), "text", "left_semi").select("doc_id", F.lit(True).alias("copy"))
    told = vectors.join(copies, "doc_id", "left").select("doc_id", (F.get("vector", F.lit(0)) - 9).cast("int").alias("n"), (F.get("vector", F.lit(1)) == 1).alias("cached"), F.coalesce("copy", F.lit(False)).alias("copy"))
    return told.select("doc_id", "n", F.when(F.col("cached") == F.col("copy"), F.col("doc_id") % 3 == 0).alias("known"))


@query("select page_id, case when length(url) % 4 = 0 then null else upper(substr(url, 1, 9)) end as told, case when length(url) % 4 = 0 then 'ValueError: unreadable' end as error from pages")
def provided_texts(spark, d):
    @ev.provider("head")
    def head(some: list[bytes]) -> list[str]:
        if any(len(x.decode()) % 4 == 0 for x in some):
            raise ValueError("unreadable")
        return [x.decode()[:9].upper() for x in some]

    rows = t(spark, d, "pages").select("page_id", F.encode("url", "UTF-8").alias("content"))
    return ev.provided(rows, "head").select("page_id", "told", "error")


@query(
    """with p as (select page_id, url, base64(encode(url)) as b from pages)
select page_id, '# ' || url || chr(10) || '![a](' || case when page_id % 3 = 0 then 'data:image/png;base64,' || b else '../img/' || page_id || '.png' end || ' "t") and ![](https://x.y/z.png)' || ' ![c](' || case when page_id % 3 = 0 then 'data:image/png;base64,' || b else '/site/img/' || page_id || '.png' end || ')' as value from p"""
)
def inlined_images(spark, d):
    """Texts of pages with images beside them, of which every third exists."""
    p = t(spark, d, "pages")
    name = F.concat(F.col("page_id").cast("string"), F.lit(".png"))
    text = F.concat(F.lit("# "), "url", F.lit("\n![a](../img/"), name, F.lit(' "t") and ![](https://x.y/z.png) ![c](/site/img/'), name, F.lit(")"))
    docs = p.select("page_id", F.concat(F.lit("/site/md/"), F.col("page_id").cast("string"), F.lit(".md")).alias("file"), text.alias("value"))
    files = p.where("page_id % 3 = 0").select(F.concat(F.lit("/site/img/"), name).alias("path"), F.encode("url", "UTF-8").alias("content"))
    return images.inline_images(docs, files).select("page_id", "value")


@query(
    """with e as (select l_orderkey as doc_id, 1 + l_linenumber // 4 as page, case when l_quantity > 40 then 'table' when l_quantity > 20 then 'text' else 'image' end as kind, l_returnflag as font, l_linestatus || ' w' || l_linenumber as words, l_linenumber as n from lineitem),
b as (select * from e where not (doc_id % 4 = 1 and n = 1)), x as (select doc_id, page, kind, count(*) as n from e group by all), y as (select doc_id, page, kind, count(*) as n from b group by all),
t as (select doc_id, page, kind, coalesce(x.n, 0) as was, coalesce(y.n, 0) as now from x full join y using (doc_id, page, kind))
select doc_id, page::int as page, kind, was, now from t where was <> now and abs(was - now) > case when kind = 'image' then greatest(2, ceil(greatest(was, now) * 0.1)) else 0 end"""
)
def changed_counts(spark, d):
    """What differs between documents and themselves without their first element: the counts of kinds beyond tolerance."""
    li = t(spark, d, "lineitem")
    kind = F.when(F.col("l_quantity") > 40, "table").when(F.col("l_quantity") > 20, "text").otherwise("image")
    e = li.select(F.col("l_orderkey").alias("doc_id"), (1 + F.floor(F.col("l_linenumber") / 4)).cast("int").alias("page"), kind.alias("type"), F.col("l_returnflag").alias("font"), F.concat("l_linestatus", F.lit(" w"), F.col("l_linenumber").cast("string")).alias("text"), F.lit(None).cast("string").alias("shape"), F.col("l_linenumber").alias("n"))
    before, after = dc.fingerprints(e), dc.fingerprints(e.where("not (doc_id % 4 = 1 and n = 1)"))
    return dc.differences(before, after).where("what = 'type'").select("doc_id", "page", F.col("name").alias("kind"), "was", "now")
