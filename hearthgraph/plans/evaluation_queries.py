"""E* on the test tables: orders as ranked lists, parts as beliefs, events as the audit log of agents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import evaluate as E
from ..operators import retrieval as R
from ..session import materialize, table
from . import bindings as B
from .registry import RAW, cte, query
from .retrieval_queries import hits, scoped_conversations


def ranked(spark, sf, by="o_totalprice"):
    """Each customer's ten best orders by value stand for a query's hits."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), F.col(by).alias("s"))
    return R.top_per_query(o, "s", 10).select("query_id", F.col("chunk_id").alias("key"), "rank")


def relevant(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P' and o_orderpriority <> '1-URGENT'")
    return o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("key"))


def ir_sql(ranked_sql, relevant_sql):
    return f"""
  with r as materialized ({ranked_sql}),
  q as materialized ({relevant_sql}),
  t as (select query_id, count(*) as n_rel from q group by 1),
  j as (select r.*, q.key is not null as rel from r left join q using (query_id, key)),
  p as (select query_id, count(*) filter (where rel and rank <= 5) as hits, min(rank) filter (where rel) as first,
               coalesce(sum(round(1 / log2(rank + 1), 12)) filter (where rel and rank <= 5), 0) as dcg from j group by 1)
  select query_id, round(coalesce(hits, 0) / 5.0::double, 6) as precision, round(case when n_rel > 0 then coalesce(hits, 0)::double / n_rel else 0 end, 6) as recall,
         (coalesce(hits, 0) > 0)::integer as hit, round(coalesce(1::double / first, 0), 6) as reciprocal_rank,
         round(case when n_rel > 0 then coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_rel, 5) + 1), lambda i: round(1 / log2(i + 1), 12))) else 0 end, 6) as ndcg,
         coalesce(first - 1, -1)::integer as first_rank
  from p full join t using (query_id)"""


def ir_cte(name, by):
    best = f"select * from (select o_custkey as query_id, o_orderkey as key, row_number() over (partition by o_custkey order by {by} desc, o_orderkey) as rank from orders) where rank <= 10"
    cte(name, ir_sql(best, "select o_custkey as query_id, o_orderkey as key from orders where o_orderstatus = 'P' and o_orderpriority <> '1-URGENT'"))


ir_cte("ir", "o_totalprice")
ir_cte("ir_by_date", "o_orderdate")
ir_cte("ir_by_key", "o_orderkey")


@query("E01_ir_metrics", "select * from ir")
def e01(spark, sf):
    return E.ir_metrics(ranked(spark, sf), relevant(spark, sf))


def passage_pages(spark, sf):
    """(query_id, key): readable pages that contain a passage. Runs of its second to fourth word find them, then the text decides."""
    words = lambda c: F.split(c, r"\s+")
    p = B.passages(spark, sf).withColumn("run", F.array_join(F.slice(words("query"), 2, 3), " "))
    d = B.pages_state(spark, sf).filter("tier = 1").select(F.col("id").alias("key"), "text")
    # each word with the two after it; a short text ends in empty places
    ws = d.select("key", words("text").alias("w")).select("key", F.arrays_zip("w", F.slice("w", 2, F.size("w")).alias("x"), F.slice("w", 3, F.size("w")).alias("y")).alias("z"))
    runs = ws.select("key", F.explode("z").alias("z")).select("key", F.concat_ws(" ", "z.w", "z.x", "z.y").alias("run"))
    # written, so that its size is known and the texts need not move
    near = materialize(runs.join(p, "run").select("key", "query_id", "query").distinct(), "near")
    return near.join(d, "key").filter(F.col("text").contains(F.col("query"))).select("query_id", "key").distinct()


@query(
    "R05_search_quality",
    ir_sql("select query_id, id as key, rank from hits", "select p.query_id, d.id as key from passages p join pages_state d on contains(d.text, p.query) and d.tier = 1"),
)
def r05_quality(spark, sf):
    """Are the pages that hold a passage among its hits, and how high?"""
    return E.ir_metrics(hits(spark, sf).select("query_id", F.col("id").alias("key"), "rank"), passage_pages(spark, sf))


def per_query(spark, sf, by="o_totalprice"):
    m = E.ir_metrics(ranked(spark, sf, by), relevant(spark, sf))
    c = table(spark, sf, "customer")
    area = F.when(F.col("c_nationkey") % 4 == 0, "graph").when(F.col("c_nationkey") % 4 == 1, "provenance").when(F.col("c_nationkey") % 4 == 2, "robustness").otherwise("retrieval")
    j = m.join(c, F.col("query_id") == F.col("c_custkey")).withColumn("area", area).withColumn("bucket", F.lower("c_mktsegment"))
    ok = E.area_ok(F.col("area"), F.col("first_rank"), F.col("c_acctbal") > 8000, F.col("c_acctbal") > 0, F.col("c_acctbal") < -500)
    return j.select("query_id", "area", "bucket", "first_rank", "ndcg", ok.alias("ok"), F.abs("c_acctbal").alias("latency_ms"))


def report_cte(name, src):
    cte(
        name,
        f"""
  with q as (select i.*, case c_nationkey % 4 when 0 then 'graph' when 1 then 'provenance' when 2 then 'robustness' else 'retrieval' end as area, lower(c_mktsegment) as bucket,
                    abs(c_acctbal) as latency_ms, c_acctbal as b from {src} i join customer on c_custkey = query_id),
  k as (select *, case area when 'graph' then b > 8000 or first_rank between 0 and 2 when 'provenance' then first_rank = 0 and b > 0 when 'robustness' then not b < -500
                            else first_rank between 0 and 2 end as ok from q)
  select area, bucket, count(*) as n, round(avg((first_rank = 0)::integer), 4) as hit1, round(avg((first_rank between 0 and 2)::integer), 4) as hit3,
         round(avg((first_rank between 0 and 4)::integer), 4) as hit5, round(avg(case when first_rank >= 0 then round(1::double / (first_rank + 1), 9) else 0 end), 4) as mrr,
         round(avg(ndcg), 4) as ndcg5, round(avg((first_rank between 0 and 2)::integer), 4) as recall3, round(avg(ok::integer), 4) as accuracy,
         round(percentile_disc(0.5) within group (order by latency_ms), 2) as latency_p50, round(percentile_disc(0.95) within group (order by latency_ms), 2) as latency_p95
  from k group by grouping sets ((area, bucket), (area))""",
    )


report_cte("report", "ir")
report_cte("report_by_date", "ir_by_date")
report_cte("report_by_key", "ir_by_key")


@query("E02_area_report", "select * from report")
def e02(spark, sf):
    return E.area_report(per_query(spark, sf))


MEASURES = """
  select area, unnest(['hit1', 'hit3', 'hit5', 'mrr', 'ndcg5', 'accuracy', 'latency_p95_ms']) as metric, unnest([hit1, hit3, hit5, mrr, ndcg5, accuracy, latency_p95]) as value from {0} where bucket is null
  union all select area, unnest(['bucket:' || bucket || ':hit3', 'bucket:' || bucket || ':hit1']), unnest([hit3, hit1]) from {0} where bucket is not null"""
cte("measures", MEASURES.format("report"))
cte("measures_by_key", MEASURES.format("report_by_key"))


@query(
    "E03_baseline_diff",
    """
with f as (select area, metric, value as floor, metric = 'mrr' as provisional from measures_by_key where metric <> 'hit5')
select area, metric, value, floor, round(value - floor, 4) as delta, coalesce(provisional, false) as provisional,
       case when floor is null then 'missing' when (metric = 'latency_p95_ms' and value > floor + 50) or (metric <> 'latency_p95_ms' and value < floor - 0.03) then 'regression' else 'ok' end as status
from measures left join f using (area, metric)""",
)
def e03(spark, sf):
    """The run by value against floors from a run by order number; one metric has no floor yet."""
    floors = E.measurements(E.area_report(per_query(spark, sf, "o_orderkey"))).filter("metric <> 'hit5'")
    floors = floors.select("area", "metric", F.col("value").alias("floor"), (F.col("metric") == "mrr").alias("provisional"))
    return E.baseline_diff(E.measurements(E.area_report(per_query(spark, sf))), floors)


@query(
    "E04_median_of_repeats",
    """
with u as (select 0 as run, area, hit3, latency_p95 from report where bucket is null union all select 1, area, hit3, latency_p95 + 7 from report_by_date where bucket is null
           union all select 2, area, hit3, latency_p95 - 3 from report_by_key where bucket is null),
r as (select *, row_number() over (partition by area order by hit3, run) as h, row_number() over (partition by area order by latency_p95, run) as l from u)
select area, max(case when h = 2 then run end)::integer as median_run, min(hit3) as hit3_min, max(case when h = 2 then hit3 end) as hit3_med, max(hit3) as hit3_max,
       min(latency_p95) as p95_min, max(case when l = 2 then latency_p95 end) as p95_med, max(latency_p95) as p95_max from r group by area""",
)
def e04(spark, sf):
    runs = None
    for run, (by, shift) in enumerate((("o_totalprice", 0), ("o_orderdate", 7), ("o_orderkey", -3))):
        r = E.area_report(per_query(spark, sf, by)).filter("bucket is null").select(F.lit(run).alias("run"), "area", "hit3", (F.col("latency_p95") + shift).alias("latency_p95"))
        runs = r if runs is None else runs.unionByName(r)
    return E.median_of_repeats(runs)


cte("scoped_hits", RAW["R06_scoped_search"])


@query(
    "E05_session_recall",
    """
with q as (select distinct conv_id as query_id, 'type' || (conv_id % 3)::varchar as type from conversations where role = 'user'),
f as (select q.query_id, q.type, coalesce(min(rank), 0) as rank from q left join scoped_hits h on h.query_id = q.query_id and h.id % 21 = q.query_id % 21 group by 1, 2)
select type, count(*) as n, round(avg((rank = 1)::integer), 4) as recall1, round(avg((rank between 1 and 5)::integer), 4) as recall5, round(avg((rank between 1 and 10)::integer), 4) as recall10,
       round(avg(case when rank > 0 then round(1::double / rank, 9) else 0 end), 4) as mrr10 from f group by grouping sets ((type), ())""",
)
def e05(spark, sf):
    """Evidence of a conversation: every conversation whose number agrees with its own modulo 21."""
    t = table(spark, sf, "conversations")
    q = t.filter("role = 'user'").select(F.col("conv_id").alias("query_id"), F.concat(F.lit("type"), F.col("conv_id") % 3).alias("type")).distinct()
    ids = t.select(F.col("conv_id").alias("id")).distinct().withColumn("g", F.col("id") % 21)
    hits = scoped_conversations(spark, sf).select("query_id", "id", "rank")
    ev = R.in_scope(hits.select("query_id", "id"), (q.select("query_id", (F.col("query_id") % 21).alias("g")), ids), "id")
    return E.session_recall(q, hits, ev)


# ------------------------------------------------------------------ precision cases


def beliefs(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"), (F.col("p_size") % 10).alias("user_id"),
        F.when(k % 11 == 0, "open_question").when(k % 7 == 0, "relation").otherwise("fact").alias("type"), F.array("p_brand", "p_type").alias("scopes"),
        (k % 5 == 0).alias("pinned"), (k % 13 == 0).alias("superseded"), (k % 17 == 0).alias("resolved"), F.array(k + 1, k + 2).alias("participants"),
    )


cte(
    "beliefs",
    """
  select p_partkey as id, p_size % 10 as user_id, case when p_partkey % 11 = 0 then 'open_question' when p_partkey % 7 = 0 then 'relation' else 'fact' end as type, p_brand, p_type,
         p_partkey % 5 = 0 as pinned, p_partkey % 13 = 0 as superseded, p_partkey % 17 = 0 as resolved from part""",
)


def cases(spark, sf):
    """One case per customer: its segment picks the part type in scope, its number the brand and the user."""
    c = table(spark, sf, "customer")
    types = F.array(*[F.lit(x) for x in ("ECONOMY", "SMALL", "STANDARD", "PROMO", "MEDIUM")])
    return c.select(
        F.col("c_custkey").alias("case_id"), (F.col("c_custkey") % 10).cast("int").alias("user_id"),
        F.array(F.concat(F.lit("Brand#"), F.col("c_custkey") % 25), F.get(types, (F.col("c_custkey") % 5).cast("int"))).alias("scopes"),
        F.lit(8).alias("max_beliefs"), F.lit(3).alias("max_questions"),
        F.when(F.col("c_nationkey") % 2 == 0, "Ranking stability").otherwise("Recall").alias("category"), F.abs("c_acctbal").alias("latency_ms"),
    )


def case_hits(spark, sf, b, c):
    """The scoped search of a case: its user's parts of the brand in scope, dearest first."""
    price = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_retailprice")
    s = b.select("id", "user_id", F.get("scopes", F.lit(0)).alias("scope")).join(price.hint("merge"), "id")
    # cases of one user and scope have the same dearest 20, so no case meets all parts of its scope
    dearest = Window.partitionBy("user_id", "scope").orderBy(F.desc("p_retailprice"), "id")
    s = s.withColumn("_r", F.row_number().over(dearest)).filter(F.col("_r") <= 20)
    j = s.join(c.select("case_id", "user_id", F.get("scopes", F.lit(0)).alias("scope")).hint("merge"), ["user_id", "scope"])
    j = j.select(F.col("case_id").alias("query_id"), F.col("id").alias("chunk_id"), "p_retailprice")
    return R.top_per_query(j, "p_retailprice", 20).select(F.col("query_id").alias("case_id"), F.col("chunk_id").alias("id"), "rank")


cte(
    "pcases",
    """
  select c_custkey as case_id, (c_custkey % 10)::integer as user_id, 'Brand#' || (c_custkey % 25)::varchar as s1, (['ECONOMY', 'SMALL', 'STANDARD', 'PROMO', 'MEDIUM'])[(c_custkey % 5 + 1)::integer] as s2,
         8 as max_beliefs, case when c_nationkey % 2 = 0 then 'Ranking stability' else 'Recall' end as category, abs(c_acctbal) as latency_ms from customer""",
)
cte("pscope", "select case_id, b.* from pcases c join beliefs b on b.user_id = c.user_id and (b.p_brand in (s1, s2) or b.p_type in (s1, s2))")
cte("ppin_all", "select case_id, id, row_number() over (partition by case_id order by id) as pos from pscope where pinned and not resolved and type <> 'open_question' and not superseded")
cte("pask", "select * from (select case_id, id, row_number() over (partition by case_id order by id) as pos from pscope where pinned and not resolved and type = 'open_question') where pos <= 3")
cte(
    "phit",
    """select * from (select case_id, b.id, b.type, row_number() over (partition by case_id order by p_retailprice desc, b.id) as rank from pcases c
       join beliefs b on b.user_id = c.user_id and b.p_brand = s1 join part on p_partkey = b.id) h where rank <= 8 and not exists (select 1 from ppin_all p where p.case_id = h.case_id and p.id = h.id)""",
)
cte(
    "pextra",
    """select case_id, id, min(rank * 10 + p) as o from (select case_id, rank, p, id + 1 + p as id from phit, (values (0), (1)) x(p) where type = 'relation') e
       where (case_id, id) in (select case_id, id from pscope) and (case_id, id) not in (select case_id, id from ppin_all) and (case_id, id) not in (select case_id, id from phit) group by 1, 2""",
)
cte(
    "prel",
    """select case_id, id, pos from (select case_id, id, row_number() over (partition by case_id order by x, o, id) as pos from (
         select case_id, id, 0 as x, rank * 10 as o from phit union all select case_id, id, 1, o from pextra))
       left join (select case_id, count(*) as used from ppin_all where pos <= 8 group by 1) using (case_id) where pos <= greatest(8 - coalesce(used, 0), 0)""",
)


def context(spark, sf):
    b, c = beliefs(spark, sf), cases(spark, sf)
    return E.build_context(c, b, case_hits(spark, sf, b, c))


CONTEXT = """select case_id, 'pinned' as section, id, pos::integer as pos from ppin_all where pos <= 8
  union all select case_id, 'relevant', id, pos::integer from prel union all select case_id, 'questions', id, pos::integer from pask"""
cte("pcontext", CONTEXT)


@query("E06_precision_context", "select * from pcontext")
def e06_context(spark, sf):
    return context(spark, sf)


def expectations(spark, sf):
    """Expected of each case: its brand's small-numbered parts, none beyond a number, at most five, order of two."""
    b, c = beliefs(spark, sf), cases(spark, sf)
    ends = b.groupBy("user_id", F.get("scopes", F.lit(0)).alias("scope")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    j = c.select("case_id", "user_id", F.get("scopes", F.lit(0)).alias("scope")).join(ends, ["user_id", "scope"])
    per = j.groupBy("case_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    e = lambda sec, rule, i, o, n: F.struct(F.lit(sec).alias("section"), F.lit(rule).alias("rule"), i.cast("bigint").alias("id"), o.cast("bigint").alias("other"), n.cast("int").alias("n"))
    no = F.lit(None)
    return per.select(
        "case_id",
        F.explode(F.array(
            e("union", "must", F.col("hi"), no, no), e("union", "must_not", F.col("lo"), no, no), e("relevant", "max", no, no, F.lit(5)), e("relevant", "before", F.col("hi"), F.col("lo"), no),
            e("pinned", "must", F.col("lo") - F.col("lo") % 5, no, no),
        )).alias("x"),
    ).select("case_id", "x.*")


cte(
    "pscored",
    """
  with per as (select c.case_id, min(b.id) as lo, max(b.id) as hi from pcases c join beliefs b on b.user_id = c.user_id and b.p_brand = c.s1 group by 1),
  un as (select distinct case_id, id from pcontext where section <> 'questions'),
  s as (select p.*, exists (select 1 from un where un.case_id = p.case_id and un.id = hi) as has_hi, exists (select 1 from un where un.case_id = p.case_id and un.id = lo) as has_lo,
               (select count(*) from prel r where r.case_id = p.case_id) as n_rel, (select pos from prel r where r.case_id = p.case_id and r.id = hi) as hi_at,
               (select pos from prel r where r.case_id = p.case_id and r.id = lo) as lo_at, exists (select 1 from ppin_all r where r.case_id = p.case_id and pos <= 8 and r.id = lo - lo % 5) as pin_hit from per p)
  select c.case_id, category, latency_ms, (coalesce((not has_hi)::integer + has_lo::integer + (n_rel > 5)::integer + (not coalesce(hi_at < lo_at, false))::integer + (not pin_hit)::integer, 0))::bigint as failures,
         case when coalesce(n_all, 0) = 0 and (hi is null or hi % 5 = 0) then null when coalesce(n_all, 0) = 0 then 0.0::double
              else round((case when hi % 5 <> 0 and hi_at is not null then 1 else 0 end)::double / n_all, 4) end as precision,
         case when hi % 5 <> 0 then round((hi_at is not null)::integer::double, 4) end as recall, case when hi is not null then pin_hit::integer::double end as pinned_coverage
  from pcases c left join s using (case_id) left join (select case_id, count(*) as n_all from prel group by 1) using (case_id)""",
)


def scored(spark, sf):
    c = cases(spark, sf)
    return E.score_cases(c, context(spark, sf), expectations(spark, sf), beliefs(spark, sf).filter("pinned").select("id"))


@query("E06_precision_cases", "select case_id, category, failures, failures = 0 as passed, precision, recall, pinned_coverage, coalesce(1 - precision, 0) as drift from pscored")
def e06(spark, sf):
    return scored(spark, sf).select("case_id", "category", "failures", "passed", "precision", "recall", "pinned_coverage", "drift")


@query(
    "E07_precision_summary",
    """
select category, count(*) as cases, count(*) filter (where failures = 0) as passed, round(avg((failures = 0)::integer), 4) as pass_rate, round(avg(precision), 4) as mean_precision,
       round(avg(recall), 4) as mean_recall, round(avg(latency_ms), 2) as mean_latency, percentile_disc(0.5) within group (order by latency_ms) as p50_latency,
       percentile_disc(0.95) within group (order by latency_ms) as p95_latency, count(*) filter (where failures = 0 and precision > 0) as active,
       count(*) filter (where failures = 0 and not coalesce(precision > 0, false) and cat = 'Ranking stability') as structural,
       count(*) filter (where failures = 0 and not coalesce(precision > 0, false) and cat <> 'Ranking stability') as trivially_empty
from (select *, category as cat from pscored) group by grouping sets ((category), ())""",
)
def e07(spark, sf):
    return E.precision_summary(scored(spark, sf).select("category", "latency_ms", "precision", "recall", "passed"))


# ------------------------------------------------------------------ contracts, leakage, leaks


def agent_tasks(spark, sf):
    t = table(spark, sf, "conversations")
    a = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("steps"), F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"))
    return a.select(
        F.col("conv_id").alias("task_id"), F.concat(F.lit("suite"), F.col("conv_id") % 4).alias("suite"), F.col("conv_id").cast("string").alias("actor"), "answer", "steps"
    )


def agent_asserts(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("task_id")).distinct()
    r = lambda rule, v: F.struct(F.lit(rule).alias("rule"), F.lit(v).alias("value"))
    return c.select("task_id", F.explode(F.array(r("must_call", "view"), r("must_not_call", "error"), r("match", "\\b(the|der|le|la)\\b"), r("any_of", "ing"), r("any_of", "ung"), r("cite", ""))).alias("x")).select("task_id", "x.*")


@query(
    "E08_contract_score",
    """
with a as (select conv_id, count(*) as steps, arg_max(text, turn) filter (where role = 'assistant') as answer from conversations group by 1),
v as (select distinct user_id, event_type from events),
s as (select conv_id, steps, 'suite' || (conv_id % 4)::varchar as suite,
        (not exists (select 1 from v where user_id = conv_id and event_type = 'view'))::integer + exists (select 1 from v where user_id = conv_id and event_type = 'error')::integer
        + (not coalesce(regexp_matches(answer, '(?i)\\b(the|der|le|la)\\b'), false))::integer + (not coalesce(regexp_matches(answer, '(?i)ing') or regexp_matches(answer, '(?i)ung'), false))::integer
        + (not coalesce(contains(answer, substr(fw, 1, 4)) and length(fw) >= 4, false))::integer + (answer is null or answer = '')::integer as failures
      from a left join (select conv_id, arg_min(split_part(text, ' ', 1), turn) as fw from conversations where role = 'user' group by 1) using (conv_id))
select suite, count(*) as n, count(*) filter (where failures = 0) as passed, round(avg(steps), 1) as mean_steps, sum(failures)::bigint as failures from s group by grouping sets ((suite), ())""",
)
def e08(spark, sf):
    log = B.audit_log(spark, sf).withColumn("verb", F.when(F.col("verb") == "tool:get_context", "tool:click").otherwise(F.col("verb")))
    u = table(spark, sf, "conversations").filter("role = 'user'")
    cited = u.groupBy(F.col("conv_id").alias("task_id")).agg(F.split_part(F.min_by("text", "turn"), F.lit(" "), F.lit(1)).alias("id"))
    s = E.contract_score(agent_tasks(spark, sf), agent_asserts(spark, sf), log.select("actor", "verb"), cited)
    total = s.withColumn("suite", F.explode(F.array(F.col("suite"), F.lit(None).cast("string")))).groupBy("suite").agg(F.sum("failures").alias("failures"))
    rep = E.suite_report(s)
    return rep.join(total, rep["suite"].eqNullSafe(total["suite"])).select(rep["suite"], "n", "passed", "mean_steps", "failures")


@query(
    "E09_answer_leakage",
    """
with gold as (select distinct token from (select unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as token from benchmark) where token <> ''),
w as (select distinct doc_id, unnest(regexp_split_to_array(lower(text), '[^0-9a-z_]+')) as token from documents),
had as (select distinct doc_id, unnest(regexp_split_to_array(lower(split_part(text, chr(10), 1)), '[^a-z]+')) as token from documents)
select doc_id as id, count(*) as leaked, min(token) as first_token from (select * from w where token in (select token from gold) and token <> '' except select * from had) group by 1""",
)
def e09(spark, sf):
    """Documents against their own first line: which benchmark words does the rest bring in?"""
    d = table(spark, sf, "documents")
    gold = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token")).filter("token <> ''")
    out = E.answer_leakage(d.select(F.col("doc_id").alias("id"), "text"), d.select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("text")), gold)
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("leaked"), F.min("token").alias("first_token"))


@query(
    "E10_leak_audit",
    """
select p.id as result_id, 1 as reader_tier, case when p.id % 2 = 0 then 'sentinel_' || p.id::varchar else 'locked page ' || p.id::varchar end as sentinel
from pages_state p where p.tier = 2 and p.id % 3 = 0""",
)
def e10(spark, sf):
    """Pages served to tier-1 readers; a careless server lets every third locked page through."""
    p = B.pages_state(spark, sf).withColumn("mark", F.when(F.col("id") % 2 == 0, F.concat(F.lit("sentinel_"), "id")).otherwise(F.concat(F.lit("locked page "), "id")))
    served = p.filter((F.col("tier") <= 1) | (F.col("id") % 3 == 0)).select(F.col("id").alias("result_id"), F.lit(1).alias("reader_tier"), F.concat("mark", F.lit(" "), "text").alias("text"))
    return E.leak_audit(served, p.select(F.col("mark").alias("sentinel"), "tier"))
