"""One query for each operator, over its whole tables with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontaminate, filter_audit, forest, licenses, mixing, ngram_join, packing, pii, quality, token_counts, toxicity
from .common import held_out, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("r")).select("r.*")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digest(chat.format_chat(turns))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id"], share=mixing.LONGER).select("doc_id", "size", "source_size", "target", "taken")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.JaccardJoin(table(spark, sf_dir, "documents")).documents().select("doc_id", "n_shingles", "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"]))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_pii, op3_quality, op4_licenses, op5_near_dedup, op6_decontaminate, op7_chat, op8_mixing, op9_ngram_join, op10_toxicity, op11_filter_audit, op12_packing, op13_collocations)}


_CONTROLS = ", ".join("'" + c + "'" for c in chat.CONTROL)

#: Turns with escapes counted: a backslash doubles, a control string gains one.
_OP7 = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce("text", '') as txt from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n as (
  select *, lag(role) over (partition by conv_id order by turn, role, txt) as before,
    length(txt) + length(txt) - length(replace(txt, '\\', ''))
      + list_sum(list_transform([{_CONTROLS}], lambda c: (length(txt) - length(replace(txt, c, ''))) // length(c))) as chars from t)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || txt || chr(10), '' order by turn, role, txt)) as turns_sha256,
  coalesce(sum(length(txt)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(txt, '' order by turn, role, txt) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars + case when before is null or before <> role then case when role = 'assistant' then {len(chat.ANSWER) + len(chat.END)} else {len(chat.OPEN) + 1 + len(chat.CLOSE)} + length(role) end else {len(chat.SEP)} end)::bigint as formatted_chars
from n group by conv_id"""


#: Documents by mask of the filters they fail, then every order of five letters and every place in it.
_OP11 = r"""
with d as (
  select doc_id, coalesce("source", '') as part, coalesce("text", '') as txt,
    list_filter(string_split_regex(coalesce("text", ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
    min(doc_id) over (partition by coalesce("text", '')) as first_id from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as bad from labels group by doc_id),
f as (
  select d.part, coalesce(l.good, 0) as good, coalesce(l.bad, 0) as bad,
    {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
     'C': 100 * length(regexp_replace(txt, '[^A-Z]', '', 'g')) > 5 * length(txt),
     'D': regexp_matches(txt, '[#$%&*|]'), 'E': coalesce(d.doc_id > first_id, false)} as s
  from d left join l on d.doc_id = l.doc_id),
m as (
  select part, concat(case when s.A then 'A' else '' end, case when s.B then 'B' else '' end, case when s.C then 'C' else '' end,
    case when s.D then 'D' else '' end, case when s.E then 'E' else '' end) as failed, count(*) as n, sum(good) as good, sum(bad) as bad from f group by 1, 2),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e
  where a.x <> b.x and a.x <> c.x and a.x <> d.x and a.x <> e.x and b.x <> c.x and b.x <> d.x and b.x <> e.x and c.x <> d.x and c.x <> e.x and d.x <> e.x),
steps as (select filter_order, i as step, filter_order[i] as letter, filter_order[1:i - 1] as earlier from orders, (select unnest(range(1, 6)) as i)),
r as (
  select part, filter_order, step, letter,
    sum(n) filter (not here and translate(failed, earlier, '') = failed) as kept,
    sum(n) filter (here and translate(failed, earlier, '') = failed) as removed,
    sum(n) filter (here and translate(failed, earlier, '') <> failed) as redundant,
    sum(n) filter (failed = letter) as unique_fails,
    sum(good) filter (here and translate(failed, earlier, '') = failed) as good_lost,
    sum(bad) filter (here and translate(failed, earlier, '') = failed) as toxic_lost
  from (select *, contains(failed, letter) as here from m, steps) group by all)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
  coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  (sum(coalesce(removed, 0)) over (partition by part, letter))::bigint as shapley
from r"""


#: Pieces of words, all runs of up to four of them with their counts, the lowest cut of each frequent one.
_OP13 = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p),
n as (select lang, sum(len(w)) as n from w group by lang),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from w),
runs as (select lang, w[i:i + 3] as w from starts),
grams as (
  select lang, k, array_to_string(w[1:k], ' ') as phrase, count(*)::hugeint as f from (select lang, w, unnest(range(1, len(w) + 1)) as k from runs) group by all having count(*) >= 30),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from grams where k > 1),
cuts as (select lang, phrase, a, k, w, unnest(range(1, k)) as cut from c),
scored as (
  select x.lang, x.phrase, x.a, x.cut, l.f as l, r.f as r, 2000000::hugeint * x.a // (l.f + r.f) as score
  from cuts x join grams l on l.lang = x.lang and l.phrase = array_to_string(x.w[1:x.cut], ' ') join grams r on r.lang = x.lang and r.phrase = array_to_string(x.w[x.cut + 1:x.k], ' ')),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
firsts as (select lang, a, k, w, len, unnest(range(1, k - len + 2)) as i from (select *, unnest(range(2, k)) as len from c)),
inside as (select lang, array_to_string(w[i:i + len - 1], ' ') as phrase, max(a) as longer from firsts group by all),
kept as (select b.* from best b left join inside i on b.lang = i.lang and b.phrase = i.phrase where i.longer is null or 100 * i.longer < 80 * b.a)
select k.lang, (row_number() over (partition by k.lang order by score desc, a desc, encode(phrase)))::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n.n::bigint as n, score::bigint as score
from kept k join n on k.lang = n.lang
qualify row_number() over (partition by k.lang order by score desc, a desc, encode(phrase)) <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op7_chat": _OP7, "op11_filter_audit": _OP11, "op13_collocations": _OP13}
