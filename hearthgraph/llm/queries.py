"""The queries of this folder on the test tables, and the DuckDB statements for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, joins, lines, packing, pages, phrases, prefixes, quality, tokens, vectors
from .common import prepare, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(read(spark, sf_dir, "pages"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_histogram(read(spark, sf_dir, "documents"))


@query
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_conversations(turns))


@query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.similar_groups(read(spark, sf_dir, "documents"))


@query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(read(spark, sf_dir, "documents"))


@query
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_scores(read(spark, sf_dir, "embeddings"))


@query
def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(read(spark, sf_dir, "documents"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    scored = quality.classify(docs, model)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


@query
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.weigh(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return lines.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id").cast("long")
    turns = read(spark, sf_dir, "conversations")
    return prefixes.prefix_trie(prefixes.sequences(turns, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9))


ORACLES["op5_embedding_near_dedup"] = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
n as (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v),
link as (
  select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach as (
  select a as vec_id, a as other from link union select vec_id, b from reach join link on other = a)
select e.vec_id, (select count(*) from link where a = e.vec_id) as n_links,
       coalesce((select min(other) from reach r where r.vec_id = e.vec_id), e.vec_id) as component_id,
       e.vec_id = coalesce((select min(other) from reach r where r.vec_id = e.vec_id), e.vec_id) as kept
from embeddings e
"""
ORACLES["op8_exact_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e::double[], c.e::double[])::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
ORACLES["op4_ngram_jaccard_join"] = """
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (
  select distinct doc_id, unnest(case when len(w) < 5 then [w] else list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) end) as s
  from w where len(w) > 0),
n as (select doc_id, count(*) as n from g group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as m from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
link as (select pairs.a, pairs.b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where m / (x.n + y.n - m) >= 0.8),
reach as (select a as doc_id, a as other from link union select doc_id, b from reach join link on other = a)
select d.doc_id, coalesce((select min(other) from reach r where r.doc_id = d.doc_id), d.doc_id) as class_id,
       (select count(*) from link where a = d.doc_id) as n_links
from documents d
"""
ORACLES["op7_substring_dedup"] = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, unnest(range(1, len(w) - 18)) as p, w from w where len(w) >= 20),
k as (select doc_id, p, w[p:p + 19] as k from s),
r as (select doc_id, p, row_number() over (partition by k order by doc_id, p) > 1 as again from k),
gone as (select distinct doc_id, unnest(range(p, p + 20)) as p from r where again),
left_over as (
  select doc_id, list(x order by i) as kept from (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from w) u
  where not exists (select 1 from gone where gone.doc_id = u.doc_id and gone.p = u.i) group by 1)
select w.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(len(kept), 0))::bigint as n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) as kept_sha256
from w left join left_over using (doc_id)
"""
ORACLES["op3_chat_formatting"] = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, length(role || text) + len(regexp_extract_all(role, '<\\*(?:turn>|text>|/turn>|\|endoftext\|>)')) + len(regexp_extract_all(text, '<\\*(?:turn>|text>|/turn>|\|endoftext\|>)'))
             + length('<turn><text></turn>') as n from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
       sum(n)::bigint as formatted_chars
from e group by conv_id
"""
ORACLES["op12_line_dedup"] = """
with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
p as (select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as line from t),
k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from p),
r as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select k.*, coalesce(k.doc_id <> r.first, false) as gone from k left join r using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(c::varchar, ''),
  lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda acc, x: case when x >= 0 then xor(acc, x) else xor(acc >> 1, 3988292384 * (acc & 1)) end))"""
ORACLES["op13_prefix_trie"] = f"""
with t as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
own as (select c, list({{'r': role, 't': text}} order by turn nulls first, role, text) as l from t group by c),
rebuilt as (
  select o.c, list_concat(coalesce(b.l, [])[1:o.h], o.l[o.h + 1:]) as l
  from (select c, l, {_CRC32} % 9 as h from own) o left join own b on b.c = o.c - o.c % 5),
pre as (select c, l[1:d] as p, d, len(l) as n from (select c, l, unnest(range(0, len(l) + 1)) as d from rebuilt)),
node as (
  select p, min(d) as d, min(c) as c, count(*) as n, coalesce(string_agg(c::varchar, ',' order by c) filter (n = d), '') as ends,
         case when min(d) > 0 then (count(*) - 1) * octet_length(encode(p[-1].t)) else 0 end as saved from pre group by p),
kids as (select p[1:d - 1] as p, count(*) as k from node where d > 0 group by 1),
up as (select node.p as v, unnest(list_transform(range(0, d + 1), lambda i: node.p[1:i])) as p, saved, kids.k is null as leaf from node left join kids on kids.p = node.p),
total as (select p, sum(saved)::bigint as saved, (count(*) filter (leaf))::bigint as leaves from up group by p)
select node.c as conv_id, node.d as depth, par.c as parent_conv_id, node.n as n_convs, coalesce(kids.k, 0) as n_children,
       total.leaves as n_leaves, total.saved as saved_tokens, sha256(node.ends) as ends_sha256
from node join total using (p) left join kids using (p) left join node par on node.d > 0 and par.p = node.p[1:node.d - 1]
"""
