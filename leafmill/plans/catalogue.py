"""The catalogue: one query for each operator over the driver's tables, with SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking as ck
from ..operators import documents as dc
from ..operators import elements as el
from ..operators import layout as ly
from ..operators import retrieval as rt
from ..operators import trees as tr

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
CHUNKER = "leafmill-element-v1"


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark, d) -> DataFrame:
    """Lines of documents as elements: seq from 0."""
    return t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))


_LINES = "lines as (select doc_id, unnest(string_split(text, chr(10))) as text, unnest(range(len(string_split(text, chr(10))))) as seq from documents)"


@query("select doc_id, ceil(length(text) / 4.0)::bigint as tokens, substr(sha256(text), 1, 12) as hash, ceil(length(text) / 4.0)::bigint as tokens16 from documents")
def doc_tokens_hash(spark, d):
    c = F.col("text")
    return t(spark, d, "documents").select("doc_id", tx.tokens(c).alias("tokens"), tx.content_hash(c).alias("hash"), tx.tokens_utf16(c).alias("tokens16"))


@query(f"with {_LINES} select doc_id, 1 as page, seq::int as el_idx, 'p1e' || seq as el_id, text from lines")
def elements_flatten(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.array(F.struct(F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit("text").alias("type"), x.alias("content"))).alias("elements"))).alias("pages"))).alias("value"))
    return el.top_level(el.parse_documents(docs)).select("doc_id", "page", "el_idx", "el_id", el.get(F.col("el"), "$.content").alias("text"))


@query(
    "select o_orderkey, concat_ws(' | ', 'order: ' || o_orderkey, case when o_orderstatus <> 'P' then 'status: ' || o_orderstatus end, 'segment: ' || c_mktsegment, o_orderpriority) as line from orders join customer on o_custkey = c_custkey"
)
def serialize_table_rows(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    cells = F.array(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise(" "), "c_mktsegment", "o_orderpriority")
    return o.select("o_orderkey", el.table_rows(F.array(F.lit("order"), F.lit("status"), F.lit("segment"), F.lit("")), F.array(cells)).alias("line"))


@query("select r_regionkey, '- ' || r_name || chr(10) || string_agg('  - ' || n_name, chr(10) order by n_nationkey) as text from region join nation on r_regionkey = n_regionkey group by r_regionkey, r_name")
def list_serialize(spark, d):
    n = t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    r = t(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    items = F.array(F.struct(F.col("r_name").alias("content"), F.transform("x", lambda i: F.struct(i["n_name"].alias("content"))).alias("children")))
    tree = F.parse_json(F.to_json(F.struct(F.lit("list").alias("type"), items.alias("items"))))
    return r.select("r_regionkey", el.serialize(tree).alias("text"))


def _outline(spark, d) -> DataFrame:
    """A document for each region: the region and its nations as headings, customers as text."""
    r, n, c = t(spark, d, "region"), t(spark, d, "nation"), t(spark, d, "customer")
    names = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    no = lambda x: F.lit(x).cast("long")
    heads = r.select(F.col("r_regionkey").alias("doc_id"), no(-1).alias("a"), no(-1).alias("b"), F.lit(1).alias("level"), F.col("r_name").alias("text"))
    subs = names.select(F.col("r_regionkey").alias("doc_id"), F.col("n_nationkey").cast("long").alias("a"), no(-1).alias("b"), F.lit(2).alias("level"), F.col("n_name").alias("text"))
    body = c.join(names, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_regionkey").alias("doc_id"), F.col("n_nationkey").cast("long").alias("a"), F.col("c_custkey").alias("b"), F.lit(None).cast("int").alias("level"), F.col("c_name").alias("text"))
    rows = heads.unionByName(subs).unionByName(body)
    # The order as one number: nation and customer keys are put together instead of numbering a whole document's rows.
    seq = (F.col("a") + 1) * F.lit(1 << 40) + F.col("b") + 1
    return rows.select("doc_id", seq.alias("seq"), F.concat(F.lit("o"), seq.cast("string")).alias("el_id"), F.lit(1).alias("page"), F.when(F.col("level").isNull(), "text").otherwise("heading").alias("type"), "level", "text")


_OUTLINE = """o as (
  select r_regionkey as doc_id, 0::bigint as seq, 1 as level, r_name as text from region
  union all select n_regionkey, (n_nationkey + 1)::bigint * 1099511627776, 2, n_name from nation
  union all select n_regionkey, (n_nationkey + 1)::bigint * 1099511627776 + c_custkey + 1, null, c_name from customer join nation on c_nationkey = n_nationkey)"""


@query(
    f"with {_OUTLINE} select doc_id, seq, r_name || case when seq > 0 then ' > ' || n_name else '' end as path from o join region on doc_id = r_regionkey left join nation on seq // 1099511627776 = n_nationkey + 1"
)
def breadcrumb_paths(spark, d):
    return ck.breadcrumbs(_outline(spark, d)).select("doc_id", "seq", F.array_join("path", " > ").alias("path"))


@query(
    f"""with {_OUTLINE},
s as (select *, sum(case when level is not null and prev is null and seq > 0 then 1 else 0 end) over (partition by doc_id order by seq) as section from (select *, lag(level) over (partition by doc_id order by seq) as prev from o)),
g as (select doc_id, section, string_agg(text, chr(10) || chr(10) order by seq) as text, min(seq) as first, count(*) as n from s group by doc_id, section)
select doc_id, section::bigint as section, 'o' || first as id, ceil(length(text) / 4.0)::int as tokens, substr(sha256(text), 1, 12) as hash from g"""
)
def section_chunks(spark, d):
    return ck.chunk(_outline(spark, d), "section", max_tokens=1 << 30).select("doc_id", F.col("section").cast("long").alias("section"), "id", "tokens", "hash")


def _greedy_sql(rows: str, key: str, order: str, cost: str, most: int) -> str:
    """Recursive CTE g(key, order, part): the greedy rule row by row, for rows numbered from 0."""
    return f"""g as (
  select {key}, {order}, {cost} as total, 0 as part from {rows} where {order} = 0
  union all select r.{key}, r.{order}, case when g.total + r.{cost} > {most} then r.{cost} else g.total + r.{cost} end, g.part + case when g.total + r.{cost} > {most} then 1 else 0 end
  from g join {rows} r on r.{key} = g.{key} and r.{order} = g.{order} + 1)"""


_BUDGET = 128


@query(
    f"""with recursive {_LINES}, c as (select doc_id, seq, text, ceil(length(text) / 4.0)::bigint as cost from lines), {_greedy_sql("c", "doc_id", "seq", "cost", _BUDGET)},
x as (select g.doc_id, g.part, string_agg(text, chr(10) || chr(10) order by seq) filter (text <> '') as text, min(seq) as first from g join c using (doc_id, seq) group by 1, 2)
select doc_id, part, 'e' || first as id, ceil(length(text) / 4.0)::int as tokens, substr(sha256(text), 1, 12) as hash from (select doc_id, part, first, trim(text) as text from x) where text <> ''"""
)
def greedy_chunks(spark, d):
    rows = _lines(spark, d).select("doc_id", "seq", F.concat(F.lit("e"), F.col("seq").cast("string")).alias("el_id"), F.lit(1).alias("page"), F.lit("text").alias("type"), F.lit(None).cast("int").alias("level"), "text")
    return ck.chunk(rows, "fixed", max_tokens=_BUDGET).select("doc_id", "part", "id", "tokens", "hash")


_TALK = "c as (select conv_id, row_number() over (partition by conv_id order by turn, role, text) - 1 as seq, role, text, ceil(length(text) / 4.0)::bigint as cost from conversations)"


def _talk(spark, d) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    return t(spark, d, "conversations").withColumn("seq", seq)


@query(
    f"""with recursive {_TALK}, {_greedy_sql("c", "conv_id", "seq", "cost", 256)},
x as (select conv_id, part, role, min(seq) as first, count(*) as n, sum(cost) as cost from g join c using (conv_id, seq) group by 1, 2, 3)
select conv_id, part, sum(n)::bigint as turns, sum(cost)::bigint as tokens, string_agg(role, ',' order by first) as roles from x group by 1, 2"""
)
def conversation_chunks(spark, d):
    rows = _talk(spark, d).withColumn("cost", tx.tokens(F.col("text")))
    rows = ck.budget_groups(rows, ["conv_id"], "seq", "cost", 256)
    said = F.array_sort(F.collect_list(F.struct("seq", "role")))
    return rows.groupBy("conv_id", "part").agg(F.count("*").alias("turns"), F.sum("cost").alias("tokens"), F.array_join(F.array_distinct(F.transform(said, lambda r: r["role"])), ",").alias("roles"))


@query(
    f"""with recursive {_TALK}, s as (select conv_id, seq, role, text, seq * 20 as t0, seq * 20 + 15 as t1, seq // 4 as chapter, length(text) as size from c),
g as (select conv_id, seq, t0 as w0, chapter, size, 0 as n from s where seq = 0
  union all select s.conv_id, s.seq, case when f then s.t0 else g.w0 end, s.chapter, case when f then s.size else g.size + 1 + s.size end, g.n + case when f then 1 else 0 end
  from g join s on s.conv_id = g.conv_id and s.seq = g.seq + 1, lateral (select s.chapter <> g.chapter or s.t1 - g.w0 > 45 or ceil((g.size + s.size) / 4.0) > 512 as f)),
x as (select conv_id, n, min(t0) as t0, max(t1) as t1, min(s.chapter) as chapter, string_agg(role || ': ' || text, ' ' order by s.seq) as body from g join s using (conv_id, seq) group by 1, 2),
y as (select *, '[' || case when t0 >= 3600 then (t0 // 3600) || ':' else '' end || printf('%02d:%02d', (t0 % 3600) // 60, t0 % 60) || '–' || case when t1 >= 3600 then (t1 // 3600) || ':' else '' end || printf('%02d:%02d', (t1 % 3600) // 60, t1 % 60) || '] ' || trim(regexp_replace(body, '\\s+', ' ', 'g')) as text from x)
select conv_id, n, t0::double as t0, t1::double as t1, 'Chapter ' || chapter as chapter, ceil(length(text) / 4.0)::int as tokens, substr(sha256(text), 1, 12) as hash from y"""
)
def transcript_windows(spark, d):
    s = _talk(spark, d).select("conv_id", (F.col("seq") * 20.0).alias("t0"), (F.col("seq") * 20.0 + 15).alias("t1"), "text", F.col("role").alias("speaker"), F.concat(F.lit("Chapter "), F.floor(F.col("seq") / 4).cast("string")).alias("chapter"))
    return ck.transcript_chunks(s, "conv_id").select("conv_id", "n", "t0", "t1", "chapter", "tokens", "hash")


@query("with c as (select user_id, ts as chapter from events where event_type = 'signup') select event_id, e.user_id, c.chapter from events e asof left join c on e.user_id = c.user_id and e.ts >= c.chapter")
def chapter_asof(spark, d):
    e = t(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts")  # the default frame takes in equal times
    return e.select("event_id", "user_id", F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).over(w).alias("chapter"))


@query(
    f"""with {_LINES} select doc_id, '{{"chunker":"{CHUNKER}","chunks":[' || string_agg('{{"id":"p1e' || seq || '","tokens":' || ceil(length(text) / 4.0)::bigint || ',"hash":"' || substr(sha256(text), 1, 12) || '"}}', ',' order by seq) || ']}}' as index_json from lines where text <> '' group by doc_id"""
)
def index_inline(spark, d):
    chunks = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.concat(F.lit("p1e"), i.cast("string")).alias("id"), tx.tokens(x).alias("tokens"), tx.content_hash(x).alias("hash"), x.alias("x"))), lambda c: c["x"] != "")
    index = F.struct(F.lit(CHUNKER).alias("chunker"), F.transform(chunks, lambda c: F.struct(c["id"].alias("id"), c["tokens"].alias("tokens"), c["hash"].alias("hash"))).alias("chunks"))
    return t(spark, d, "documents").where(F.size(chunks) > 0).select("doc_id", F.to_json(index).alias("index_json"))


_TERMS = "list_filter(string_split_regex(lower(strip_accents(lower({}))), '[^a-z0-9]+'), lambda x: x <> '')"
_POSTS = f"w as (select doc_id, unnest({_TERMS.format('text')}) as term from documents), p as (select term, doc_id, count(*) as tf from w group by 1, 2)"


@query(f"with {_POSTS} select term, count(*) as df, sum(tf)::bigint as cf from p group by term")
def bm25_stats(spark, d):
    return rt.term_stats(rt.postings(t(spark, d, "documents").withColumnRenamed("doc_id", "chunk_id")))


_BM25 = f"""{_POSTS}, l as (select doc_id, len({_TERMS.format('text')}) as len from documents), s as (select count(*)::double as n, avg(len) as a from l),
q as (select distinct item_id, term from (select item_id, unnest({_TERMS.format('text')}) as term from benchmark)), f as (select term, count(*)::double as df from p group by term),
h as (select item_id, p.doc_id, sum(ln(1.0::double + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.5::double) / (tf + 1.5::double * (0.25::double + 0.75::double * len / a))) as score from q join f using (term) join p using (term) join l on l.doc_id = p.doc_id, s group by 1, 2),
e as (select item_id, doc_id, round(coalesce(score, 0), 9) as score from (select item_id, doc_id from benchmark, documents) left join h using (item_id, doc_id)),
r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from e qualify rank <= 10)"""


def _bm25(spark, d) -> DataFrame:
    return rt.bm25(t(spark, d, "benchmark"), t(spark, d, "documents"), key="doc_id")


@query(f"with {_BM25} select item_id, rank::int as rank, doc_id, round(score, 6) as score from r")
def bm25_topk(spark, d):
    return _bm25(spark, d).select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


_DENSE = """v as (select vec_id, label, embedding::double[] as e from embeddings),
s as (select q.vec_id as query_id, q.label as ql, v.vec_id, v.label, round(list_cosine_similarity(q.e, v.e), 9) as score from v q, v where q.vec_id % 50 = 0 and q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s qualify rank <= 10)"""


def _dense(spark, d) -> DataFrame:
    v = t(spark, d, "embeddings")
    return rt.dense(v, v.where(F.col("vec_id") % 50 == 0))


@query(f"with {_DENSE} select query_id, rank::int as rank, vec_id, round(score, 6) as score from r")
def dense_topk(spark, d):
    return _dense(spark, d).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(
    f"""with {_DENSE}, f as (select query_id, ql as label, coalesce(min(rank) filter (label = ql), 0) as rank from r group by 1, 2)
select label, count(*) as n, round(avg((rank between 1 and 1)::int::double), 6) as recall_1, round(avg((rank between 1 and 5)::int::double), 6) as recall_5, round(avg((rank between 1 and 10)::int::double), 6) as recall_10,
round(avg(case when rank > 0 then 1.0::double / rank else 0 end), 6) as mrr from f group by rollup (label)"""
)
def recall_mrr_by_label(spark, d):
    v = t(spark, d, "embeddings").select("vec_id", "label")
    r = _dense(spark, d).join(v, "vec_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    ranks = r.groupBy("query_id", F.col("ql").alias("l")).agg(F.min(F.when(F.col("label") == F.col("ql"), F.col("rank"))).alias("rank"))
    return rt.metrics(ranks.withColumnRenamed("l", "label"), ["label"])


@query(
    f"""with {_BM25}, x as (select r.item_id, rank, ceil(length(d.text) / 4.0)::bigint as tokens, contains(regexp_replace(lower(d.text), '\\s+', '', 'g'), regexp_replace(lower(b.text), '\\s+', '', 'g')) as hit from r join documents d using (doc_id) join benchmark b on b.item_id = r.item_id),
y as (select *, sum(tokens) over (partition by item_id order by rank) as read from x)
select item_id, coalesce(min(rank) filter (hit), 0)::int as rank, coalesce(min(read) filter (hit), 0)::bigint as tokens_to_hit, sum(tokens) filter (rank <= 5)::bigint as context_5 from y group by item_id"""
)
def token_budget_recall(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    r = _bm25(spark, d).join(docs, "doc_id").join(t(spark, d, "benchmark").select("item_id", "text"), "item_id").withColumn("tokens", tx.tokens(F.col("body")))
    return rt.first_hits(r, "item_id", F.contains(tx.match_form(F.col("body")), tx.match_form(F.col("text"))))


_EDIT = "case when doc_id % 24 = 0 then text || ' Edited.' else text end"


def _diff(spark, d) -> DataFrame:
    docs = t(spark, d, "documents")
    before = docs.where("doc_id % 10 <> 9").select(F.col("doc_id").alias("chunk_id"), tx.content_hash(F.col("text")).alias("hash"))
    after = docs.where("doc_id % 10 <> 8").select(F.col("doc_id").alias("chunk_id"), "source", F.expr(_EDIT).alias("text")).withColumn("hash", tx.content_hash(F.col("text"))).withColumn("tokens", tx.tokens(F.col("text")))
    return rt.changed(before, after)


@query(
    f"select doc_id as chunk_id, case when doc_id % 10 = 8 then 'removed' when doc_id % 10 = 9 then 'new' when doc_id % 24 = 0 then 'changed' else 'same' end as status from documents"
)
def incremental_diff(spark, d):
    return _diff(spark, d).select("chunk_id", "status")


@query("with h as (select doc_id, substr(sha1(text), 1, 16) as asset from documents) select doc_id, asset, min(doc_id) over (partition by asset) as canonical, count(*) over (partition by asset) as uses from h")
def asset_intern(spark, d):
    return dc.intern(t(spark, d, "documents"), "doc_id", F.col("text")).select("doc_id", "asset", "canonical", "uses")


@query(
    "select lang, count(*) as total, count(l.doc_id) as covered, count(*) - count(l.doc_id) as missing, count(l.doc_id) || ' of ' || count(*) || ' covered' as summary from documents d left join labels l on d.doc_id = l.doc_id group by rollup (lang)"
)
def media_coverage(spark, d):
    marked = t(spark, d, "labels").select("doc_id", F.lit(True).alias("marked"))
    return dc.coverage(t(spark, d, "documents").select("doc_id", "lang").join(marked, "doc_id", "left"), ["lang"], F.col("marked"))


@query("select source, lang, count(*) as files, sum(n_chars)::bigint as chars, sum(ceil(length(text) / 4.0)::bigint)::bigint as tokens from documents group by rollup (source, lang)")
def coverage_rollup(spark, d):
    return t(spark, d, "documents").rollup("source", "lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.sum(tx.tokens(F.col("text"))).alias("tokens"))


_FILES = 10_000
#: Price list of the cost queries (example values).
PRICES = [("small", 0.02), ("large", 0.13)]
_PRICES = ", ".join(f"('{p}', {u})" for p, u in PRICES)


@query(
    f"""with d as (select row_number() over (order by doc_id) - 1 as i, ceil(length(text) / 4.0)::bigint as tokens, octet_length(encode(text)) as bytes, count(*) over () as n from documents),
x as (select sum(c) as chunks, sum(c * tokens) as tokens, sum(c * bytes) as bytes from (select *, ({_FILES} // n + case when i < {_FILES} % n then 1 else 0 end) as c from d))
select p as price, chunks::bigint as chunks, tokens::bigint as tokens, bytes::bigint as bytes, round(tokens::double * u / 1000000, 6) as usd from x, (values {_PRICES}) v(p, u)"""
)
def cost_totals(spark, d):
    docs = t(spark, d, "documents").select("doc_id", tx.tokens(F.col("text")).alias("tokens"), F.octet_length("text").cast("long").alias("bytes"))
    # File i is document i mod n: n // N copies of each and one more of the first N mod n, so no row is repeated.
    n = docs.count()
    first = docs.orderBy("doc_id").limit(_FILES % n).select("doc_id").withColumn("more", F.lit(1)) if n else docs.select("doc_id").withColumn("more", F.lit(1))
    c = F.lit(_FILES // max(n, 1)).cast("long") + F.coalesce("more", F.lit(0))
    x = docs.join(first, "doc_id", "left").agg(F.sum(c).alias("chunks"), F.sum(c * F.col("tokens")).alias("tokens"), F.sum(c * F.col("bytes")).alias("bytes"))
    prices = spark.createDataFrame(PRICES, "price string, usd_per_1m_tokens double")
    return rt.cost_model(x, prices).select("price", "chunks", "tokens", "bytes", "usd")


@query(
    f"""with a as (select doc_id, source, {_EDIT} as text from documents where doc_id % 10 <> 8)
select source, count(*) filter (doc_id % 24 = 0 or doc_id % 10 = 9) as chunks, coalesce(sum(ceil(length(text) / 4.0)::bigint) filter (doc_id % 24 = 0 or doc_id % 10 = 9), 0)::bigint as tokens, sum(ceil(length(text) / 4.0)::bigint)::bigint as whole_tokens from a group by source"""
)
def reindex_cost(spark, d):
    again = F.col("status").isin("changed", "new")
    return _diff(spark, d).where("status <> 'removed'").groupBy("source").agg(F.count_if(again).alias("chunks"), F.coalesce(F.sum(F.when(again, F.col("tokens"))), F.lit(0)).cast("long").alias("tokens"), F.sum("tokens").alias("whole_tokens"))


@query(
    """select 'conversations' as table_name, severity, rule, key from (select 'error' as severity, 'role is known' as rule, conv_id || ':' || turn as key from conversations where role not in ('user', 'assistant') union all
 select 'warning', 'text is short', conv_id || ':' || turn from conversations where length(text) > 2000 union all select 'error', 'turn is not negative', conv_id || ':' || turn from conversations where turn < 0)
union all select 'pages', 'error', 'url has a scheme', page_id::varchar from pages where not regexp_matches(url, '^https?://')
union all select 'pages', 'warning', 'html is closed', page_id::varchar from pages where not contains(html, '</html>')
union all select 'events', 'error', 'value is positive', event_id::varchar from events where not coalesce(value > 1, false)"""
)
def validate_report(spark, d):
    c = dc.violations(t(spark, d, "conversations"), "conversations", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), [("error", "role is known", F.col("role").isin("user", "assistant")), ("warning", "text is short", F.length("text") <= 2000), ("error", "turn is not negative", F.col("turn") >= 0)])
    p = dc.violations(t(spark, d, "pages"), "pages", F.col("page_id"), [("error", "url has a scheme", F.col("url").rlike("^https?://")), ("warning", "html is closed", F.contains(F.col("html"), F.lit("</html>")))])
    e = dc.violations(t(spark, d, "events"), "events", F.col("event_id"), [("error", "value is positive", F.col("value") > 1)])
    return c.unionByName(p).unionByName(e)


_Q = "license"


@query(
    f"""with h as (select doc_id, text, string_split(lower(text), '{_Q}') as parts from documents where contains(lower(text), '{_Q}')),
o as (select doc_id, text, unnest(range(len(parts) - 1)) as hit, unnest(list_transform(range(len(parts) - 1), lambda i: list_sum(list_transform(parts[1:i + 1], lambda p: length(p)))::bigint + i * {len(_Q)})) as pos from h),
b as (select *, greatest(0, pos - 30) as lo, least(length(text), pos + {len(_Q)} + 30) as hi from o)
select doc_id, hit::int as hit, pos::int as at, case when lo > 0 then '…' else '' end || substr(text, lo + 1, hi - lo) || case when hi < length(text) then '…' else '' end as snippet from b"""
)
def search_kwic(spark, d):
    return dc.search(t(spark, d, "documents"), _Q, "doc_id")


@query("select doc_id, (strpos(lower(text), 'the ') - 1)::int as at from documents where strpos(lower(text), 'the ') > 0")
def search_first_hit(spark, d):
    return t(spark, d, "documents").select("doc_id", dc.first_hit(F.col("text"), "the ").cast("int").alias("at")).where("at is not null")


@query(f"with {_LINES} select source, l.text as line, count(distinct l.doc_id) as pages from lines l join documents d using (doc_id) where l.text <> '' group by 1, 2 having count(distinct l.doc_id) >= 3")
def boilerplate_lines(spark, d):
    return rt.repeated_lines(t(spark, d, "documents"), "source", "doc_id")


@query(
    f"""with {_LINES}, s as (select doc_id, seq, text as sentence, regexp_extract(text, '[0-9]+([.,][0-9]+)*', 0) as answer, regexp_extract_all(text, '[A-Za-z]{{4,}}') as ws from lines),
k as (select *, list_filter(ws, lambda w: length(w) = list_max(list_transform(ws, lambda v: length(v))))[1] as word, row_number() over (partition by doc_id order by seq) - 1 as i, count(*) over (partition by doc_id) as m from s where answer <> '' and not regexp_matches(answer, '^(19|20)[0-9][0-9]$') and len(ws) > 0)
select doc_id, i::int as n, sentence, answer, word from k where list_contains(list_transform(range(least(2, m)), lambda j: floor(j * m / least(2.0, m))::bigint), i)"""
)
def numeric_questions(spark, d):
    return rt.questions(t(spark, d, "documents"))


@query()
def char_splitter(spark, d):
    return ck.split_characters(t(spark, d, "documents")).select("doc_id", "piece_no", F.length("piece").alias("chars"), tx.content_hash(F.col("piece")).alias("hash"))


@query("select a.l_orderkey, count(*) as pairs, count(*) filter (a.l_shipdate < b.l_shipdate) as agreeing from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber group by 1")
def pairwise_order(spark, d):
    return ly.pairwise_agreement(t(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_shipdate")


@query(
    f"select doc_id, lang, len({_TERMS.format('text')})::int as words, substr(sha1(array_to_string(list_sort({_TERMS.format('text')}), ' ')), 1, 16) as print from documents"
)
def fingerprint(spark, d):
    w = tx.terms(F.col("text"))
    return t(spark, d, "documents").select("doc_id", "lang", F.size(w).alias("words"), dc.fingerprint(w).alias("print"))


@query("select user_id, event_type, arg_max(props, (ts, event_id)) as last_value, arg_min(props, (ts, event_id)) as first_value, count(*) as n from events group by 1, 2")
def form_values(spark, d):
    return dc.last_values(t(spark, d, "events"), ["user_id", "event_type"], "props", F.struct("ts", "event_id"))


@query(
    "select p_partkey, case when p_size > 25 then 'large' else p_brand end as face, case when p_size > 25 then '22' else '11' end as size, case when p_retailprice > 1000 then 'red' else 'black' end as color from part"
)
def style_merge(spark, d):
    m = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v)))
    styles = F.create_map(F.lit("base"), m(face=F.col("p_brand"), size=F.lit("11"), color=F.lit("black")), F.lit("title"), m(face=F.lit("large"), size=F.lit("22")), F.lit("alert"), m(color=F.lit("red")))
    names = F.filter(F.array(F.lit("base"), F.when(F.col("p_size") > 25, "title"), F.when(F.col("p_retailprice") > 1000, "alert")), lambda n: n.isNotNull())
    s = el.resolve_style(names, styles)
    return t(spark, d, "part").select("p_partkey", s["face"].alias("face"), s["size"].alias("size"), s["color"].alias("color"))


@query("select doc_id, source || ' (' || lang || ') page ' || (doc_id % 7 + 1) || ' of 7' as footer from documents")
def template_footer(spark, d):
    f = tx.fill_template(F.lit("{{title}} ({{author}}) page {{page}} of {{pages}}"), title=F.col("source"), author=F.col("lang"), page=F.col("doc_id") % 7 + 1, pages=F.lit(7))
    return t(spark, d, "documents").select("doc_id", f.alias("footer"))


@query(f"with {_OUTLINE} select doc_id, seq, level, text from o where level <= 2")
def toc_entries(spark, d):
    return _outline(spark, d).where("level <= 2").select("doc_id", "seq", "level", "text")


@query(
    f"with recursive {_LINES}, c as (select doc_id, seq, (greatest(1, ceil(length(text) / 80.0)) * 5)::bigint as cost from lines), {_greedy_sql('c', 'doc_id', 'seq', 'cost', 247)} select doc_id, seq::int as seq, part + 1 as page_no from g"
)
def flow_pages(spark, d):
    rows = _lines(spark, d).select("doc_id", "seq", (F.greatest(F.lit(1), F.ceil(F.length("text") / 80.0)) * 5).cast("long").alias("h"))
    return ly.flow_pages(rows, "doc_id", "seq", "h", 247)


@query(
    """with e as (select event_id, user_id, ts, epoch(ts) - epoch(lag(ts) over w) as gap from events window w as (partition by user_id order by ts, event_id))
select user_id, island::bigint as island, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from (select *, sum(case when gap <= 21600 then 0 else 1 end) over (partition by user_id order by ts, event_id) as island from e) group by 1, 2"""
)
def collinear_islands(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t(spark, d, "events").select("event_id", "user_id", "ts", F.struct("ts", "event_id").alias("o"))
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    e = ly.islands(e, ["user_id"], "o", gap <= 21600 * 1000000)
    return e.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query(
    "select bin, count(*) as covered from (select unnest(range(floor(l_quantity / 0.5)::bigint, ceil((l_quantity + 3) / 0.5)::bigint)) as bin from lineitem) group by bin"
)
def histogram_gutters(spark, d):
    return ly.coverage(t(spark, d, "lineitem").select("l_quantity", (F.col("l_quantity") + 3).alias("hi")), [], "l_quantity", "hi").where("covered > 0")


@query(
    """with p as (select p_partkey as key, (p_partkey * 7919 % 1000) / 10.0::double as x, (p_partkey * 104729 % 1000) / 10.0::double as y from part), s as (select s_suppkey as other, (s_suppkey * 6007 % 1000) / 10.0::double as x, (s_suppkey * 3571 % 1000) / 10.0::double as y from supplier),
n as (select key, other, (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) as d from p join s on abs(floor(p.x / 10) - floor(s.x / 10)) <= 1 and abs(floor(p.y / 10) - floor(s.y / 10)) <= 1),
m as (select key, other, d from n qualify row_number() over (partition by key order by d, other) = 1)
select p.key, m.other, round(m.d, 6) as distance2 from p left join m using (key)"""
)
def nearest_bin_join(spark, d):
    at = lambda c, m: ((F.col(c) * m) % 1000) / F.lit(10.0)
    p = t(spark, d, "part").select(F.col("p_partkey").alias("key"), at("p_partkey", 7919).alias("x"), at("p_partkey", 104729).alias("y"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("other"), at("s_suppkey", 6007).alias("x"), at("s_suppkey", 3571).alias("y"))
    return ly.nearest(p, s, "key", 10.0).select("key", "other", F.round("distance2", 6).alias("distance2"))


@query("select l_partkey, list_sort(list(l_quantity))[(count(*) // 2 + 1)::int] as median, count(*) as n from lineitem group by l_partkey")
def upper_median(spark, d):
    return ly.upper_median(t(spark, d, "lineitem"), "l_partkey", "l_quantity")


@query(
    "with x as (select doc_id, string_split(text, chr(10)) as a from documents) select doc_id, (len(a) - case when len(a) > 1 then 1 else 0 end)::int as n, array_to_string(case when len(a) > 2 then list_concat(a[3:], [a[1]]) when len(a) = 2 then [a[1]] else a end, '|') as lines from x"
)
def edit_move_delete(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("a"))
    x = x.withColumn("a", F.when(F.size("a") > 1, dc.delete_at(F.col("a"), 1)).otherwise(F.col("a")))
    x = x.withColumn("a", F.concat(F.slice("a", 2, F.size("a")), F.slice("a", 1, 1)))
    return x.select("doc_id", F.size("a").alias("n"), F.array_join("a", "|").alias("lines"))


@query("select user_id, count(*) as n, min(ts) as oldest from (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 100) group by user_id")
def history_cap(spark, d):
    return dc.newest(t(spark, d, "events"), "user_id", ["ts", "event_id"]).groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


@query("select doc_id, substr(sha256(text), 1, 12) as hash, ceil(length(text) / 4.0)::bigint as tokens from documents")
def stream_ingest(spark, d):
    from ..streaming import ingest

    return ingest.run_once(spark, d, "documents")


#: Mean order value in millions of each priority (a tool), status (a retriever) and last digit of the order (a setting).
_FIGURES = """f as (select o_orderpriority as tool, o_orderstatus as retriever, o_orderpriority || '-' || (o_orderkey % 10) as pipeline, (o_orderkey % 10)::bigint as setting, round(avg(o_totalprice::double) / 1e6, 6) as value from orders group by all)"""


def _figures(spark, d) -> DataFrame:
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("tool"), F.col("o_orderstatus").alias("retriever"), (F.col("o_orderkey") % 10).cast("long").alias("setting"), F.col("o_totalprice").cast("double").alias("p"))
    return o.groupBy("tool", "retriever", "setting").agg(F.round(F.avg("p") / 1e6, 6).alias("value")).withColumn("pipeline", F.concat_ws("-", "tool", F.col("setting").cast("string")))


@query(f"with {_FIGURES} select tool, retriever, setting, value from f qualify row_number() over (partition by tool, retriever order by value desc, setting) = 1")
def best_setting(spark, d):
    return rt.best(_figures(spark, d).drop("pipeline"), ["tool", "retriever"], "value", "setting").select("tool", "retriever", "setting", "value")


@query(
    f"with {_FIGURES}, b as (select tool, setting, value from f where retriever = 'O' qualify row_number() over (partition by tool order by value desc, setting) = 1) select tool, setting, value, row_number() over (order by value desc, setting)::int as rank from b qualify rank <= 3"
)
def leading_tools(spark, d):
    return rt.leaders(_figures(spark, d).where("retriever = 'O'"), "tool", "value", "setting").select("tool", "setting", "value", "rank")


@query(f"with {_FIGURES} select retriever, round(avg(value), 6) as mean from f where retriever <> 'F' group by 1 order by avg(value) desc limit 1")
def headline_retriever(spark, d):
    return rt.headline(_figures(spark, d), "retriever", "value", "setting", "F").select("retriever", F.round("mean", 6).alias("mean"))


@query(
    f"""with {_FIGURES}, n as (select pipeline, retriever, case when setting = 3 then value + 0.001 when setting = 4 then value + 0.03 else value end as fresh from f where setting <> 5 and not (setting = 6 and retriever = 'P')),
p as (select pipeline, case when retriever = 'F' then 'bm25' else retriever end as retriever, value from f), m as (select pipeline, case when retriever = 'F' then 'bm25' else retriever end as retriever, fresh from n)
select p.pipeline, p.retriever, case when p.pipeline not in (select pipeline from m) then 'missing' when fresh is null then 'skipped' when abs(value - fresh) > case when p.retriever = 'bm25' then 0.0005 else 0.02 end then 'differs' else 'ok' end as status from p left join m using (pipeline, retriever)"""
)
def verify_figures(spark, d):
    f = _figures(spark, d).withColumn("metric", F.lit("mean"))
    now = f.where("setting <> 5 and not (setting = 6 and retriever = 'P')").withColumn("value", F.col("value") + F.when(F.col("setting") == 3, 0.001).when(F.col("setting") == 4, 0.03).otherwise(0.0))
    named = lambda x: x.withColumn("retriever", F.when(F.col("retriever") == "F", "bm25").otherwise(F.col("retriever"))).select("pipeline", "retriever", "metric", "value")
    return rt.verify(named(f), named(now)).select("pipeline", "retriever", "status")


@query("select page_id, url || ' é 50%zz+%4' as plain from pages")
def percent_decoded(spark, d):
    coded = F.replace(F.replace(F.col("url"), F.lit("/"), F.lit("%2F")), F.lit(":"), F.lit("%3a"))
    return t(spark, d, "pages").select("page_id", tx.percent_decode(F.concat(coded, F.lit("%20%C3%A9%2050%zz+%4"))).alias("plain"))


@query("select doc_id, case when doc_id % 5 < 4 then case when doc_id % 2 = 0 then 'image/jpeg' else 'note' end end as mime, case when doc_id % 5 < 4 then case when doc_id % 2 = 0 then 'jpg' else 'bin' end end as ext, case when doc_id % 5 < 4 then sha256(text) end as sha from documents")
def data_urls(spark, d):
    src = F.concat(F.when(F.col("doc_id") % 5 < 4, "data:").otherwise("https:"), F.when(F.col("doc_id") % 2 == 0, "image/jpeg").otherwise("note"), F.lit(";base64,"), F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", ""))
    u = tx.data_url(src)
    return t(spark, d, "documents").select("doc_id", u["mime"].alias("mime"), u["ext"].alias("ext"), F.sha2(u["content"], 256).alias("sha"))


@query("select p_partkey, case p_partkey % 5 when 0 then p_brand when 1 then p_size::varchar when 2 then p_type when 3 then p_name end as data from part")
def resource_lookup(spark, d):
    at, c = F.col("p_partkey") % 5, F.col
    entry = lambda x: F.create_map(F.lit("k"), F.struct(x.alias("data")))
    held = lambda n, x: F.when(at == n, entry(c(x)))
    doc = F.parse_json(F.to_json(F.struct(F.struct(F.when(at == 0, F.struct(c("p_brand").alias("data"))).when(at == 2, F.struct(F.lit(None).cast("string").alias("data"))).alias("k"), F.coalesce(F.when(at == 1, entry(c("p_size").cast("string"))), held(2, "p_type")).alias("images"), F.coalesce(held(0, "p_name"), held(1, "p_name"), held(3, "p_name")).alias("videos")).alias("resources"))))
    return t(spark, d, "part").select("p_partkey", el.get(el.resource(doc, F.lit("k")), "$.data").alias("data"))


@query(
    """with recursive r as (select user_id, event_id, value::double as y, (event_id % 7)::double as x, (8 + event_id % 5)::double as fs, row_number() over (partition by user_id order by value::double, event_id % 7, event_id) as i from events),
g as (select user_id, event_id, i, y as top, 0 as row from r where i = 1 union all
select r.user_id, r.event_id, r.i, case when abs(g.top - r.y) <= greatest(0.8, r.fs * (25.4::double / 72) * 0.35) then g.top else r.y end, case when abs(g.top - r.y) <= greatest(0.8, r.fs * (25.4::double / 72) * 0.35) then g.row else g.row + 1 end from g join r on r.user_id = g.user_id and r.i = g.i + 1)
select event_id, row from g"""
)
def rows_of_runs(spark, d):
    n = F.col("event_id")
    runs = t(spark, d, "events").select("user_id", n, F.col("value").cast("double").alias("y"), (n % 7).cast("double").alias("x"), (8 + n % 5).cast("double").alias("font_size"))
    return ly.text_rows(runs, ["user_id"], "event_id").select("event_id", "row")


def _tree_rows(spark, d) -> DataFrame:
    """A JSON document for each supplier: fields in a section, a table, a list and the running parts."""
    s = t(spark, d, "supplier")
    field = lambda kind, name, value: F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"), value.cast("string").alias("value"))
    box = F.struct(F.lit("checkbox").alias("type"), F.lit("known").alias("name"), (F.col("s_suppkey") % 2 == 0).alias("checked"))
    section = F.struct(F.lit("collapsible").alias("type"), F.array(field("input", "key", F.col("s_suppkey"))).alias("elements"))
    table = F.struct(F.lit("table").alias("type"), F.array(F.array(field("select", "nation", F.col("s_nationkey")))).alias("rows"))
    items = F.struct(F.lit("list").alias("type"), F.array(field("textarea", "", F.col("s_name"))).alias("items"))
    page = F.struct(F.array(F.to_variant_object(section), F.to_variant_object(table), F.to_variant_object(items)).alias("elements"), F.struct(F.array(box).alias("elements")).alias("header"))
    tree = F.struct(F.array(page).alias("pages"), F.struct(F.array(field("signature", "signed", F.col("s_name"))).alias("elements")).alias("footer"))
    return s.select(F.col("s_suppkey").alias("doc_id"), F.to_json(tree).alias("value"))


@query(
    """select s_suppkey as doc_id, seq::int as seq, name, kind as type, value from supplier, lateral (values (0, 'key', 'input', s_suppkey::varchar), (1, 'nation', 'select', s_nationkey::varchar),
(2, 'known', 'checkbox', case when s_suppkey % 2 = 0 then 'true' else 'false' end), (3, 'signed', 'signature', s_name)) f(seq, name, kind, value)"""
)
def form_fields(spark, d):
    return tr.form_fields(_tree_rows(spark, d))


#: Documents with one fault or two, by their number.
_FAULTS = (
    '{"v":"1","meta":{"title":"t"},"pages":[{"elements":[{"type":"text"}]}]}', '{"v":1,"meta":{},"pages":[]}', '{"meta":[],"pages":{}}',
    '{"v":"1","meta":{"title":"t"},"pages":[{"elements":[{},{"type":"map"},{"type":3}]},7,{"elements":1}]}', "not JSON", '{"v":null,"meta":{"title":2},"pages":[{"elements":[]}]}',
)
_LACKS = {
    1: [("error", "v must be a string"), ("warning", "meta.title is missing or empty"), ("error", "pages is empty, at least one page required")],
    2: [("error", "Missing required field: v"), ("error", "meta must be an object"), ("error", "Missing required field: pages (must be array)")],
    3: [("error", "page[0].element[0].type missing"), ("warning", 'page[0].element[1].type "map" is not a known type'), ("error", "page[0].element[2].type missing"), ("error", "page[1] must be an object"), ("error", "page[2].elements missing or not an array")],
    4: [("error", "Missing required field: v"), ("error", "Missing required field: meta"), ("error", "Missing required field: pages (must be array)")],
    5: [("error", "v must be a string"), ("warning", "meta.title is missing or empty")],
}
_LACKS_SQL = ", ".join(f"({i}, '{s}', '{m}')" for i, found in _LACKS.items() for s, m in found)


def _faulty(spark, d) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, _FAULTS)), (F.col("doc_id") % len(_FAULTS) + 1).cast("int")).alias("value"))


@query(f"select doc_id, severity, message from documents join (values {_LACKS_SQL}) v(i, severity, message) on doc_id % {len(_FAULTS)} = i")
def structure_report(spark, d):
    return dc.structure_report(el.parse_documents(_faulty(spark, d)), "v")


@query("select doc_id, case doc_id % 6 when 1 then 0 when 2 then 0 when 4 then 0 when 3 then 3 else 1 end::int as pages, case doc_id % 6 when 0 then 1 when 3 then 3 else 0 end::int as elements from documents")
def tree_counts(spark, d):
    return dc.counts(el.parse_documents(_faulty(spark, d)))


_PART_RULES = {
    "type": "object", "required": ["name", "maker"], "additionalProperties": False,
    "properties": {"name": {"type": "string", "maxLength": 20}, "size": {"$ref": "#/$defs/size"}, "sizes": {"type": "array", "items": {"$ref": "#/$defs/size"}, "minItems": 2}, "maker": {"enum": ["Brand#11", "Brand#12", None]}},
    "$defs": {"size": {"type": "integer", "minimum": 10}},
}


@query(
    """with p as (select p_partkey as doc_id, p_name, p_size, p_brand, p_partkey % 3 = 0 as extra from part)
select doc_id, '/name' as place, 'must NOT have more than 20 characters' as message from p where length(p_name) > 20
union all select doc_id, '/size', 'must be >= 10' from p where p_size < 10 union all select doc_id, '/sizes/0', 'must be >= 10' from p where p_size < 10
union all select doc_id, '/sizes', 'must NOT have fewer than 2 items' from p union all select doc_id, '', 'must have required property ''maker''' from p where p_brand = 'Brand#13'
union all select doc_id, '/maker', 'must be equal to one of the allowed values' from p where p_brand not in ('Brand#11', 'Brand#12', 'Brand#13') union all select doc_id, '', 'must NOT have additional properties' from p where extra"""
)
def schema_errors(spark, d):
    p = t(spark, d, "part")
    size = F.col("p_size").cast("int")
    tree = F.struct(F.col("p_name").alias("name"), size.alias("size"), F.array(size).alias("sizes"), F.when(F.col("p_brand") != "Brand#13", F.col("p_brand")).alias("maker"), F.when(F.col("p_partkey") % 3 == 0, 1).alias("extra"))
    return tr.schema_errors(p.select(F.col("p_partkey").alias("doc_id"), F.to_json(tree).alias("value")), _PART_RULES)


@query(
    """with x as (select conv_id, list(text order by turn, role, text) as a from conversations group by conv_id),
b as (select conv_id, case when len(a) > 1 then list_concat(a[:1], ['new'], a[2:]) else list_concat(a, ['new']) end as a from x),
c as (select conv_id, case when conv_id % 2 = 0 then list_concat(['set'], a[2:]) else list_concat([a[2], a[1]], a[3:]) end as a from b)
select conv_id as doc_id, (2 - conv_id % 2)::int as pages, case when conv_id % 2 = 0 then array_to_string(a, '|') else array_to_string(list_concat(a, ['last']), '|') end as lines from c"""
)
def edited_documents(spark, d):
    c = t(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    docs = c.select("doc_id", F.to_json(F.struct(F.array(F.struct(F.transform("x", lambda r: F.struct(r["text"].alias("content"))).alias("elements"))).alias("pages"))).alias("value"))
    edit = lambda seq, op, path, field, payload: F.struct(F.lit(seq).alias("seq"), F.lit(op).alias("op"), F.lit(path).alias("path"), F.lit(field).cast("string").alias("field"), F.lit(payload).cast("string").alias("payload"))
    first = edit(0, "insert_after", '["pages",0,"elements",0]', None, '{"content":"new"}')
    even = F.array(first, edit(1, "set", '["pages",0,"elements",0]', "content", '"set"'), edit(2, "insert_page", "[0]", None, None))
    odd = F.array(first, edit(1, "move", '["pages",0,"elements",0]', None, "1"), edit(2, "append", "[0]", None, '{"content":"last"}'), edit(3, "delete_page", "[0]", None, None))
    edits = docs.select("doc_id", F.explode(F.when(F.col("doc_id") % 2 == 0, even).otherwise(odd)).alias("e")).select("doc_id", "e.*")
    v = F.try_parse_json("value")
    pages = F.try_variant_get(v, "$.pages", "array<variant>")
    lines = F.transform(F.try_variant_get(v, "$.pages[0].elements", "array<variant>"), lambda e: F.try_variant_get(e, "$.content", "string"))
    return tr.apply_edits(docs, edits).select("doc_id", F.size(pages).alias("pages"), F.array_join(lines, "|").alias("lines"))


@query(
    "select p_partkey as doc_id, 'Part ' || p_partkey || '  ' || p_name || ' x' as shown, p_name || ' Part ' || p_partkey || ' L' || p_size || ' v L' || p_size || ' v' as found from part"
)
def search_texts(spark, d):
    p = t(spark, d, "part").withColumn("title", F.concat(F.lit("Part "), F.col("p_partkey").cast("string"))).withColumn("label", F.concat(F.lit("L"), F.col("p_size").cast("string")))
    text = lambda c: F.struct(F.lit("text").alias("type"), c.alias("content"))
    shown = F.struct(F.lit("collapsible").alias("type"), "title", F.array(F.struct(F.lit("shape").alias("type"), F.lit("").alias("content")), text(F.col("p_name")), text(F.lit("x"))).alias("elements"))
    found = F.struct(F.lit("input").alias("type"), F.col("p_name").alias("content"), "title", "label", F.lit("v").alias("value"))
    tree = lambda s: F.parse_json(F.to_json(s))
    return p.select(F.col("p_partkey").alias("doc_id"), tr.search_text(tree(shown)).alias("shown"), tr.search_text(tree(found), every=True).alias("found"))


@query(
    """select page_id as doc_id, id, sha, mime, uses::int as uses from (select page_id, 'asset-2' as id, sha256(html) as sha, 'image/png' as mime, 3 as uses from pages union all
select page_id, 'asset-3', sha256(url), 'video/quicktime', 1 from pages union all select page_id, 'asset-1', sha256('own'), 'image/webp', 1 from pages)"""
)
def extracted_assets(spark, d):
    b64 = lambda c: F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"\s", "")
    pic = lambda c, mime="image/png", kind="image": F.struct(F.lit(kind).alias("type"), F.concat(F.lit(f"data:{mime};base64,"), b64(c)).alias("src"))
    ref = lambda name: F.struct(F.lit("image").alias("type"), F.lit(name).alias("resource"))
    var = F.to_variant_object
    elements = F.array(var(pic(F.col("html"))), var(F.struct(F.lit("collapsible").alias("type"), F.array(pic(F.col("html"))).alias("elements"))), var(pic(F.col("url"), "video/quicktime", "video")), var(ref("asset-1")), var(ref("logo")))
    images = F.struct(F.struct(b64(F.lit("own")).alias("data"), F.lit("image/webp").alias("mimeType")).alias("asset-1"), F.struct(b64(F.col("html")).alias("data")).alias("logo"))
    docs = t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.to_json(F.struct(F.array(F.struct(elements.alias("elements"))).alias("pages"), F.struct(images.alias("images")).alias("resources"))).alias("value"))
    got = tr.extract_assets(docs)
    # How many elements refer to each asset is read back from the document's row.
    refs = F.regexp_extract_all("value", F.lit('"resource":"([^"]+)"'), F.lit(1))
    doc = got.where("kind = 'document'").select("doc_id", F.explode(refs).alias("id")).groupBy("doc_id", "id").agg(F.count("*").cast("int").alias("uses"))
    return got.where("kind = 'asset'").select("doc_id", "id", F.sha2("content", 256).alias("sha"), "mime").join(doc, ["doc_id", "id"])


@query(
    """select o_orderkey, case o_orderkey % 4 when 0 then 297 when 1 then 215.9 when 2 then 100 else 210 end::double as width, case o_orderkey % 4 when 0 then 420 when 1 then 279.4 when 2 then 297 else 297 end::double as height,
(o_orderkey % 9)::double as top, 20::double as "left", case when o_orderkey % 2 = 0 then 'page' else 'document' end as header from orders where o_orderkey % 3 > 0 union all
select o_orderkey, case o_orderkey % 4 when 0 then 420 when 1 then 279.4 when 2 then 297 else 297 end, case o_orderkey % 4 when 0 then 297 when 1 then 215.9 when 2 then 100 else 210 end, 25, 7, case when o_orderkey % 2 = 0 then 'page' else 'document' end from orders where o_orderkey % 3 = 0"""
)
def page_geometry(spark, d):
    k = F.col("o_orderkey")
    size = F.when(k % 4 == 0, F.to_variant_object(F.struct(F.lit("A3").alias("s")))).when(k % 4 == 2, F.to_variant_object(F.struct(F.struct(F.lit(100).alias("width")).alias("s"))))
    own = F.struct(F.variant_get(size, "$.s", "variant").alias("pageSize"), F.when(k % 3 == 0, "landscape").alias("pageOrientation"), F.struct(F.when(k % 3 > 0, k % 9).alias("top")).alias("margins"), F.when(k % 2 == 0, F.struct(F.lit("page").alias("x"))).alias("header"))
    meta = F.struct(F.when(k % 4 == 1, "Letter").alias("pageSize"), F.struct(F.when(k % 3 == 0, 7).alias("left")).alias("margins"))
    doc = F.struct(meta.alias("meta"), F.struct(F.lit("document").alias("x")).alias("header"))
    x = t(spark, d, "orders").select(k, F.parse_json(F.to_json(own)).alias("p"), F.parse_json(F.to_json(doc)).alias("d"))
    p, dd = F.col("p"), F.col("d")
    return x.select(k, el.page_size(p, dd)["width"].alias("width"), el.page_size(p, dd)["height"].alias("height"), el.margins(p, dd)["top"].alias("top"), el.margins(p, dd)["left"].alias("left"), F.try_variant_get(el.running_part(p, dd, "header"), "$.x", "string").alias("header"))


@query()
def blanked_questions(spark, d):
    return rt.blanked_questions(t(spark, d, "documents")).select("doc_id", "n", "question", "answer", "word")


@query()
def word_wrap(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(tx.wrap(F.col("text"), 60)).alias("line_no", "line"))


_M32 = "4294967296::hugeint"
_T32 = f"(({{}})::hugeint * ({{}})::hugeint % {_M32})::bigint"
_X1 = _T32.format("xor(s, s >> 15)", "s | 1")
_X2 = f"xor(x, ((x + {_T32.format('xor(x, x >> 7)', 'x | 61')}) % {_M32})::bigint)"


@query(
    f"""with a as (select event_id, ((user_id::hugeint + (event_id + 1)::hugeint * 1831565813) % {_M32})::bigint as s from events), b as (select event_id, {_X1} as x from a), c as (select event_id, {_X2} as x from b)
select event_id, xor(x, x >> 14) / 4294967296.0::double as draw, (floor(xor(x, x >> 14) / 4294967296.0::double * 6) + 1)::bigint as die from c"""
)
def seeded_draws(spark, d):
    seed, i = F.col("user_id"), F.col("event_id")
    return t(spark, d, "events").select("event_id", tx.draw(seed, i).alias("draw"), tx.draw_between(seed, i, 1, 6).alias("die"))


@query(
    """select p_partkey, case p_partkey % 5 when 0 then 'Arimo, Arial, Helvetica, sans-serif' when 1 then 'Tinos, ''Times New Roman'', serif' when 2 then 'Cousine, ''Courier New'', JetBrains Mono, monospace' when 3 then 'Cousine, ''Courier New'', monospace' else '''IBM Plex Sans'', Arimo, sans-serif' end as family,
p_partkey % 5 = 1 or p_size > 25 as bold, p_partkey % 5 = 2 as italic from part"""
)
def font_faces(spark, d):
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, "ABCDEF+Open Sans").when(k == 1, "Times_New-Roman,Semi Bold").when(k == 2, "Fira Code Oblique").when(k == 4, "IBM-Plex Sans")
    face = tx.font_face(name, monospace=k == 3, bold=F.col("p_size") > 25)
    return t(spark, d, "part").select("p_partkey", face["family"].alias("family"), face["bold"].alias("bold"), face["italic"].alias("italic"))


@query("select doc_id, '→ ' || source || ' •✓•' as plain from documents")
def symbol_glyphs(spark, d):
    c = lambda *codes: F.lit("".join(map(chr, codes)))
    return t(spark, d, "documents").select("doc_id", tx.symbol_glyphs(F.concat(c(0xF0E0, 32), F.col("source"), c(32, 0xF0B7, 0xF0FC, 0xE001))).alias("plain"))


@query(
    f"""with {_LINES}, h as (select doc_id, seq + 1 as line, text, string_split(lower(text), '{_Q}') as parts from lines where contains(lower(text), '{_Q}')),
o as (select doc_id, line, text, unnest(range(len(parts) - 1)) as hit, unnest(list_transform(range(len(parts) - 1), lambda i: list_sum(list_transform(parts[1:i + 1], lambda p: length(p)))::bigint + i * {len(_Q)})) as pos from h),
b as (select *, greatest(0, pos - 30) as lo, least(length(text), pos + {len(_Q)} + 30) as hi from o)
select doc_id, line::int as line, hit::int as hit, pos::int as at, case when lo > 0 then '…' else '' end || substr(text, lo + 1, hi - lo) || case when hi < length(text) then '…' else '' end as snippet from b"""
)
def search_lines(spark, d):
    return dc.search_lines(t(spark, d, "documents"), _Q, "doc_id")


_TITLE = "trim(regexp_replace(regexp_replace(lower({}), '\\s+', ' ', 'g'), '[^\\p{{L}}\\p{{N}} ]', '', 'g'))"


@query(
    f"""with c as (select c_nationkey as page, c_custkey, c_name, c_acctbal::double as y, {_TITLE.format("c_name")} as have from customer),
e as (select c_nationkey as page, c_custkey as seq, case c_custkey % 3 when 0 then upper(c_name) || '!' when 1 then c_name || ' and more' else left(c_name, 12) end as title, c_custkey % 9 as depth from customer where c_custkey % 7 = 0),
f as (select *, {_TITLE.format("title")} as want, least(6, greatest(1, depth))::int as lvl from e),
h as (select page, seq, title, lvl, c_custkey from (select f.page, seq, title, lvl, c_custkey, y, case when have = want then 3 when starts_with(have, want) or starts_with(want, have) then 2 when length(have) >= 6 and contains(want, have) then 1 end as score from f join c using (page)) where score > 0
  qualify row_number() over (partition by page, seq order by score desc, y, c_custkey) = 1)
select c_custkey, case when c_custkey % 2 = 0 then 9 else arg_min(lvl, seq) end::int as heading, arg_max(trim(title), seq) as toc_entry, arg_max(lvl, seq) as toc_level from h group by c_custkey"""
)
def outline_headings(spark, d):
    k = F.col("c_custkey")
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("page"), k, F.col("c_name").alias("text"), F.col("c_acctbal").cast("double").alias("y"), F.when(k % 2 == 0, 9).alias("heading"))
    title = F.when(k % 3 == 0, F.concat(F.upper("text"), F.lit("!"))).when(k % 3 == 1, F.concat("text", F.lit(" and more"))).otherwise(F.substring("text", 1, 12))
    outline = c.where(k % 7 == 0).select("page", k.alias("seq"), title.alias("title"), (k % 9).alias("depth"))
    return ly.apply_outline(c, outline, ["page"], "c_custkey").where("toc_entry is not null").select("c_custkey", "heading", "toc_entry", "toc_level")


@query(
    """with c as (select l_suppkey, l_linenumber, l_quantity::int::varchar as q, l_returnflag as f, l_partkey % 9 as k from lineitem),
t as (select *, case k when 0 then '$ ' || q when 1 then '(' || q || ')' when 2 then '—' when 3 then q || 'ms' when 4 then '−' || q when 5 then f || q when 6 then q || '%' when 7 then q || ' ' || f else '' end as cell from c),
n as (select *, trim(cell) <> '' as used, regexp_matches(trim(cell), '^[—–\\-]+$') or regexp_matches(regexp_replace(regexp_replace(cell, '[\\s$€£¥(),%]', '', 'g'), '^[+\\-−–]', ''), '^\\d+(\\.\\d+)?(ms|s|k|m|b|M|K|B|x|×)?$') as num from t)
select l_suppkey, l_linenumber, count(*) filter (used) as filled, count(*) filter (used and num) as numeric, count(*) filter (used and num) >= 2 and count(*) filter (used and num) >= count(*) filter (used) * 0.6 as is_numeric from n group by 1, 2"""
)
def numeric_columns(spark, d):
    q, f = F.col("l_quantity").cast("int").cast("string"), F.col("l_returnflag")
    forms = [F.concat(F.lit("$ "), q), F.concat(F.lit("("), q, F.lit(")")), F.lit("—"), F.concat(q, F.lit("ms")), F.concat(F.lit("−"), q), F.concat(f, q), F.concat(q, F.lit("%")), F.concat(q, F.lit(" "), f), F.lit("")]
    cell = F.element_at(F.array(*forms), (F.col("l_partkey") % 9 + 1).cast("int"))
    return ly.numeric_columns(t(spark, d, "lineitem").select("l_suppkey", "l_linenumber", cell.alias("text")), ["l_suppkey", "l_linenumber"])


@query("select user_id, min(value::double) as \"left\", min((event_id % 50)::double) as top, max(value::double + 3) as \"right\", max((event_id % 50)::double + event_id % 4) as bottom from events group by 1")
def box_extent(spark, d):
    n = F.col("event_id")
    boxes = t(spark, d, "events").select("user_id", F.col("value").cast("double").alias("x"), (n % 50).cast("double").alias("y"), F.lit(3.0).alias("width"), (n % 4).cast("double").alias("height"))
    return ly.extent(boxes, ["user_id"])


@query(
    "with g as (select l_partkey, l_extendedprice::double - lag(l_extendedprice::double) over (partition by l_partkey order by l_extendedprice::double) as g from lineitem) select l_partkey, round(list_sort(list(g))[(count(*) // 2 + 1)::int], 6) as median, count(*) as n from g where g is not null group by 1"
)
def row_pitch(spark, d):
    rows = t(spark, d, "lineitem").select("l_partkey", F.col("l_extendedprice").cast("double").alias("y"))
    return ly.row_pitch(rows, "l_partkey").select("l_partkey", F.round("median", 6).alias("median"), "n")


@query(
    """with e as (select event_id, user_id, (user_id % 3 + 1)::int as level, value::double as y, row_number() over (partition by user_id order by ts, event_id) as i from events), h as (select *, case when event_id % 4 > 0 then level end as heading from e),
j as (select *, coalesce(heading = lag(heading) over w and y - lag(y) over w > 0 and y - lag(y) over w < 12 * (25.4::double / 72) * 2.2, false) as joins from h window w as (partition by user_id order by i))
select event_id, case when heading is not null then sum(case when joins then 0 else 1 end) over (partition by user_id order by i)::bigint end as title from j"""
)
def wrapped_headings(spark, d):
    n = F.col("event_id")
    lines = t(spark, d, "events").select("user_id", n, F.struct("ts", "event_id").alias("o"), F.col("value").cast("double").alias("y"), F.lit(1.0).alias("x"), F.lit(12.0).alias("font_size"), F.when(n % 4 > 0, (F.col("user_id") % 3 + 1).cast("int")).alias("heading"))
    return ly.wrapped_headings(lines, ["user_id"], "o").select("event_id", F.col("title").cast("long").alias("title"))


@query(
    """with r as (select event_id, user_id % 20 as page, event_type as text, value::double as x, (event_id % 30)::double as y from events), w as (select user_id % 20 as page, event_type as value, event_id as wid, value::double - 5 as x, (event_id % 30)::double as y from events where event_id % 11 = 0)
select event_id from r where not exists (select 1 from w where w.page = r.page and w.value = r.text and r.x + 2 between w.x and w.x + 10 and r.y + 1 between w.y - 1 and w.y + 3)"""
)
def runs_without_widgets(spark, d):
    n = F.col("event_id")
    e = t(spark, d, "events").select((F.col("user_id") % 20).alias("page"), n, F.col("event_type").alias("text"), F.col("value").cast("double").alias("x"), (n % 30).cast("double").alias("y"))
    runs = e.withColumn("width", F.lit(4.0)).withColumn("height", F.lit(2.0))
    widgets = e.where(n % 11 == 0).select("page", F.concat(F.lit(" "), F.col("text")).alias("value"), (F.col("x") - 5).alias("x"), "y", F.lit(10.0).alias("width"), F.lit(2.0).alias("height"))
    return ly.without_widget_values(runs, widgets, ["page"], "event_id").select("event_id")


def _all() -> None:
    from . import pipelines, tables  # noqa: F401, they add their own


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
