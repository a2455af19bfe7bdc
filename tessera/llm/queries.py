"""The operators' registered queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, debruijn, decontam, embedding, htmltext, langid, minhash, mixing, secretscan, tokens
from tessera.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    return chat.digest(chat.format_chats(rows.unionByName(more)))


QUERIES["op1_chat_format"] = op1_chat_format
ORACLES["op1_chat_format"] = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
  select *, regexp_replace(replace(text, '\', '\\'), '<(/?turn>|says/>|next/>)', '<\\\1', 'g') as et,
    regexp_replace(replace(role, '\', '\\'), '<(/?turn>|says/>|next/>)', '<\\\1', 'g') as er,
    coalesce(role = lag(role) over (partition by conv_id order by turn nulls first, role, text), false) as joined from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(et) + case when joined then 7 else 20 + length(er) end) as bigint) as formatted_chars
from e group by conv_id"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


QUERIES["op6_mixing"] = op6_mixing
ORACLES["op6_mixing"] = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5(cast(doc_id as varchar)) as h from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as sid from d group by source),
w as (select *, [1, 2, 3][(sid - 1) % 3 + 1] as w, 3 * source_size as cap from s),
c as (
  select *, sum(source_size) over () as total,
    coalesce(sum(cap) over (order by cap::double / w, sid rows between unbounded preceding and 1 preceding), 0) as used,
    sum(w) over (order by cap::double / w, sid rows between current row and unbounded following) as rest from w),
l as (select *, max(case when (total - used)::double / rest::double * w <= cap then (total - used)::double / rest::double end) over () as level from c),
t as (select source, source_size, case when level * w <= cap then level * w else cap::double end as target from l),
p as (
  select d.doc_id, d.size, t.source_size, t.target, cast(floor(t.target) as bigint) as take,
    sum(d.size) over (partition by d.source order by d.h, d.doc_id, d.size rows between unbounded preceding and current row) - d.size as start
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(greatest(least(start + size, take) - start, 0) + greatest(least(source_size + start + size, take) - source_size - start, 0)
  + greatest(least(2 * source_size + start + size, take) - 2 * source_size - start, 0) as bigint) as taken from p"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048).drop("cut_bytes")


QUERIES["op10_token_counts"] = op10_token_counts


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES["op3_language_id"] = op3_language_id


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


QUERIES["op4_secret_scan"] = op4_secret_scan
# what SQL can say of two operators whose whole results it cannot
QUERIES["secret_counts"] = lambda spark, sf_dir: op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")
QUERIES["token_limits"] = lambda spark, sf_dir: op10_token_counts(spark, sf_dir).select("doc_id", "n_bytes", (F.col("n_tokens") <= F.col("n_bytes")).alias("bounded"), (F.col("n_tokens") > 2048).eqNullSafe(F.col("over_limit")).alias("agrees"))

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
ORACLES["secret_counts"] = rf"""
select doc_id, cast(len(list_filter(regexp_extract_all(coalesce(text, ''), '{ASSIGN}', 1), lambda x: length(x) >= 6)) as bigint) as n_assign,
  cast(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) as bigint) as n_access,
  cast(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) as bigint) as n_hex from documents"""
ORACLES["token_limits"] = "select doc_id, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n_bytes, true as bounded, true as agrees from documents"


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


QUERIES["op7_html_extract"] = op7_html_extract


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES["op8_minhash_dedup"] = op8_minhash_dedup


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES["op5_embedding_dedup"] = op5_embedding_dedup


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("score")


QUERIES["op9_decontamination"] = op9_decontamination


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.dedup(table(spark, sf_dir, "documents")).drop("kept")


QUERIES["op2_substring_dedup"] = op2_substring_dedup


# What SQL can express of the operators above, by plain enumeration.
ORACLES["op2_substring_dedup"] = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, s, array_to_string(ws[s + 1 : s + 20], ' ') as k from (select doc_id, ws, unnest(range(0, len(ws) - 19)) as s from w where len(ws) >= 20)),
later as (select doc_id, s from (select *, row_number() over (partition by k order by doc_id, s) as r from win) where r > 1),
gone as (select distinct doc_id, s + o as i from later, range(20) t(o)),
words as (select doc_id, unnest(ws) as word, unnest(range(0, len(ws))) as i from w),
kept as (select doc_id, string_agg(word, ' ' order by i) as text, count(*) as n from words anti join gone using (doc_id, i) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from w left join kept using (doc_id)"""

_COMPONENTS = r"""
reach(node, component) as (select distinct a, a from links union select l.b, r.component from reach r join links l on r.node = l.a),
least as (select node, min(component) as component from reach group by node)"""

ORACLES["op8_minhash_dedup"] = (
    r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)
  union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 4),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.k = y.k and x.doc_id <> y.doc_id group by all),
links as (select a, b from common join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 75 * (x.n + y.n - c)),"""
    + _COMPONENTS
    + r"""
select w.doc_id, coalesce(n, 0) as n_shingles, coalesce(component, w.doc_id) as component_id, coalesce(component, w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join least on node = w.doc_id"""
)

ORACLES["op5_embedding_dedup"] = (
    r"""
with recursive e as (select vec_id, cast(embedding as double[]) as v from embeddings where embedding is not null),
links as (select x.vec_id as a, y.vec_id as b from e x join e y on x.vec_id <> y.vec_id where list_cosine_similarity(x.v, y.v) >= 0.9),"""
    + _COMPONENTS
    + r"""
select vec_id, (select count(*) from links where a = vec_id) as n_links, coalesce(component, vec_id) as component_id, coalesce(component, vec_id) = vec_id as kept
from embeddings left join least on node = vec_id"""
)

ORACLES["op9_decontamination"] = r"""
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as ws from documents),
i as (
  select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as ws,
    len(regexp_extract_all(regexp_extract(trim(text, chr(10) || ' '), '(?s)^(.*[.?!:\n]\s)', 1), '[\p{L}\p{N}_]+')) as broken from benchmark where text is not null),
q as (select item_id, ws, len(ws) as n, least(5, len(ws)) as g, case when broken > 0 and broken < len(ws) then broken else greatest(1, cast(round(len(ws) * 2 / 3) as bigint)) end as ask from i where len(ws) > 0),
sizes as (select distinct g from q),
dg as (select distinct doc_id, k from (select doc_id, array_to_string(ws[p + 1 : p + g], ' ') as k from (select doc_id, ws, g, unnest(range(0, len(ws) - g + 1)) as p from d, sizes where len(ws) >= g))),
ig as (select item_id, p, g, array_to_string(ws[p + 1 : p + g], ' ') as k from (select item_id, ws, g, unnest(range(0, n - g + 1)) as p from q)),
hit as (select distinct doc_id, item_id, p + o as pos from (select doc_id, item_id, p, unnest(range(0, g)) as o from dg join ig using (k))),
c as (select doc_id, item_id, count(*) as whole, count(*) filter (pos < ask) as asked, any_value(n) as n, any_value(ask) as ask from hit join q using (item_id) group by doc_id, item_id),
r as (
  select doc_id, item_id, whole::double / n as overlap, asked::double / ask as question_overlap, case when ask < n then (whole - asked)::double / (n - ask) else 0.0::double end as answer_overlap from c)
select * from r where overlap >= 0.6 or (question_overlap >= 0.8 and answer_overlap > 0)"""
