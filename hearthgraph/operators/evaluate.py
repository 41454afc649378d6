"""Scoring of ranked results: IR metrics, area reports, floors, sessions, precision cases, contracts, leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: how far a metric may fall, how far a latency may rise, categories that pass by structure
TOLERANCE, LATENCY_TOLERANCE_MS = 0.03, 50.0
STRUCTURAL = [
    "Scope disambiguation",
    "Supersession chain exclusion",
    "Type routing and open questions",
    "Budget eviction and capacity",
    "Cross-user isolation",
    "Ranking stability",
    "Persona prelude content",
]


def ir_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Per query: precision, recall, hit, reciprocal rank, nDCG at k and the first relevant rank (0-based, -1 none).

    ranked(query_id, key, rank from 1), relevant(query_id, key). Queries come from either side.
    """
    rel = relevant.select("query_id", "key").distinct().withColumn("rel", F.lit(1))
    total = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    top = ranked.select("query_id", "key", "rank")
    j = top.join(rel, ["query_id", "key"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    in_k = (F.col("rank") <= k) & (F.col("rel") == 1)
    per = j.groupBy("query_id").agg(
        F.sum(F.when(in_k, 1).otherwise(0)).alias("hits"), F.countDistinct(F.when(in_k, F.col("key"))).alias("found"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(in_k, F.round(1 / F.log2(F.col("rank") + 1), 12)).otherwise(0.0)).alias("dcg"),
    )
    gains = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.col("n_rel"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + F.round(1 / F.log2(i + 1), 12)
    )
    both = per.join(total, "query_id", "full").na.fill({"hits": 0, "found": 0, "dcg": 0.0, "n_rel": 0})
    first = F.coalesce(F.col("first") - 1, F.lit(-1))
    return both.select(
        "query_id", F.round(F.col("hits") / k, 6).alias("precision"), F.round(F.when(F.col("n_rel") > 0, F.col("found") / F.col("n_rel")).otherwise(0.0), 6).alias("recall"),
        (F.col("hits") > 0).cast("int").alias("hit"), F.round(F.when(F.col("first").isNotNull(), 1 / F.col("first")).otherwise(0.0), 6).alias("reciprocal_rank"),
        F.round(F.when(F.col("n_rel") > 0, F.col("dcg") / gains).otherwise(0.0), 6).alias("ndcg"), first.cast("int").alias("first_rank"),
    )


def area_ok(area: Column, first_rank: Column, graph_ok: Column, provenance_ok: Column, leaked: Column) -> Column:
    """The pass rule of each area: names or top three, provenance of the top hit, no leak, else top three."""
    hit3 = first_rank.between(0, 2)
    return (
        F.when(area == "graph", graph_ok | hit3).when(area == "provenance", (first_rank == 0) & provenance_ok).when(area == "robustness", ~leaked).otherwise(hit3)
    )


def area_report(per_query: DataFrame) -> DataFrame:
    """(area, bucket) means, all buckets together under null, with accuracy and nearest-rank latencies.

    per_query(area, bucket, first_rank, ndcg, ok, latency_ms).
    """
    fr = F.col("first_rank")
    hit = lambda n: F.when(fr.between(0, n - 1), 1).otherwise(0)
    rows = per_query.withColumn("latency_ms", F.round("latency_ms", 2)).withColumn("bucket", F.explode(F.array_distinct(F.array(F.col("bucket"), F.lit(None).cast("string")))))
    mean = lambda c: F.round(F.avg(c), 4)
    return rows.groupBy("area", "bucket").agg(
        F.count(F.lit(1)).alias("n"), mean(hit(1)).alias("hit1"), mean(hit(3)).alias("hit3"), mean(hit(5)).alias("hit5"),
        mean(F.when(fr >= 0, F.round(1 / (fr + 1), 9)).otherwise(0.0)).alias("mrr"), mean("ndcg").alias("ndcg5"), mean(hit(3)).alias("recall3"),
        mean(F.col("ok").cast("int")).alias("accuracy"),
        F.round(F.expr("percentile_disc(0.5) within group (order by latency_ms)"), 2).alias("latency_p50"),
        F.round(F.expr("percentile_disc(0.95) within group (order by latency_ms)"), 2).alias("latency_p95"),
    )


def measurements(report: DataFrame) -> DataFrame:
    """(area, metric, value, lower_better): the report in long form, bucket metrics named by bucket."""
    whole = report.filter("bucket is null").selectExpr(
        "area", "stack(7, 'hit1', hit1, 'hit3', hit3, 'hit5', hit5, 'mrr', mrr, 'ndcg5', ndcg5, 'accuracy', accuracy, 'latency_p95_ms', latency_p95) as (metric, value)"
    )
    parts = report.filter("bucket is not null").selectExpr(
        "area", "stack(2, concat('bucket:', bucket, ':hit3'), hit3, concat('bucket:', bucket, ':hit1'), hit1) as (metric, value)"
    )
    return whole.unionByName(parts).withColumn("lower_better", F.col("metric") == "latency_p95_ms")


def baseline_diff(current: DataFrame, floors: DataFrame) -> DataFrame:
    """Every measurement against its floor: regression, ok, or missing where no floor is committed.

    floors(area, metric, floor, provisional).
    """
    j = current.join(floors, ["area", "metric"], "left")
    worse = F.when(F.col("lower_better"), F.col("value") > F.col("floor") + LATENCY_TOLERANCE_MS).otherwise(F.col("value") < F.col("floor") - TOLERANCE)
    status = F.when(F.col("floor").isNull(), "missing").when(worse, "regression").otherwise("ok")
    return j.select(
        "area", "metric", "value", "floor", F.round(F.col("value") - F.col("floor"), 4).alias("delta"), F.coalesce("provisional", F.lit(False)).alias("provisional"), status.alias("status")
    )


def median_of_repeats(reports: DataFrame) -> DataFrame:
    """(run, area, hit3, latency_p95) -> the median run by hit3 and the spread of both values per area."""
    w = Window.partitionBy("area")
    mid = F.floor(F.count(F.lit(1)).over(w) / 2) + 1
    r = reports.withColumn("_h", F.row_number().over(w.orderBy("hit3", "run"))).withColumn("_l", F.row_number().over(w.orderBy("latency_p95", "run")))
    r = r.withColumn("_mid", mid)
    return r.groupBy("area").agg(
        F.max(F.when(F.col("_h") == F.col("_mid"), F.col("run"))).alias("median_run"), F.min("hit3").alias("hit3_min"),
        F.max(F.when(F.col("_h") == F.col("_mid"), F.col("hit3"))).alias("hit3_med"), F.max("hit3").alias("hit3_max"),
        F.min("latency_p95").alias("p95_min"), F.max(F.when(F.col("_l") == F.col("_mid"), F.col("latency_p95"))).alias("p95_med"), F.max("latency_p95").alias("p95_max"),
    )


def session_recall(questions: DataFrame, hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """Recall at 1, 5, 10 and MRR at 10 of the first evidence session, per question type and in total (type null).

    questions(query_id, type), hits(query_id, id, rank), evidence(query_id, id).
    """
    first = hits.join(evidence, ["query_id", "id"], "left_semi").filter("rank <= 10").groupBy("query_id").agg(F.min("rank").alias("rank"))
    q = questions.join(first, "query_id", "left").na.fill({"rank": 0})
    q = q.withColumn("type", F.explode(F.array(F.col("type"), F.lit(None).cast("string"))))
    at = lambda k: F.round(F.avg(F.col("rank").between(1, k).cast("int")), 4)
    return q.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), at(1).alias("recall1"), at(5).alias("recall5"), at(10).alias("recall10"),
        F.round(F.avg(F.when(F.col("rank") > 0, F.round(1 / F.col("rank"), 9)).otherwise(0.0)), 4).alias("mrr10"),
    )


# ------------------------------------------------------------------ precision cases


def build_context(cases: DataFrame, beliefs: DataFrame, hits: DataFrame) -> DataFrame:
    """(case_id, section, id, pos): pinned, relevant and questions of each case, within its budget.

    cases(case_id, user_id, scopes, max_beliefs, max_questions), beliefs(id, user_id, type, scopes, pinned,
    superseded, resolved, participants), hits(case_id, id, rank) of the scoped search. Only the first beliefs of a
    (user, scope) can be in a list that is cut by id, so beliefs are cut to the largest budget before they meet
    cases. What is pinned leaves the hits; relations bring in their participants; whether a hit or participant is in
    scope is read off the belief itself. The lists are cut to the budget as top-k reports.
    """
    c = cases.select("case_id", "user_id", "max_beliefs", "max_questions", F.explode("scopes").alias("scope"))
    live = F.col("pinned") & ~F.col("resolved")
    pin = F.coalesce(live & (F.col("type") != "open_question") & ~F.col("superseded"), F.lit(False))
    b = beliefs.select("id", "user_id", "type", "participants", "scopes", pin.alias("pin"), (live & (F.col("type") == "open_question")).alias("ask"))
    # beliefs are small where they are stored and large as rows with their lists: they meet cases by a shuffle, and the driver holds none
    b = b.hint("merge")
    order = Window.partitionBy("case_id").orderBy("id")
    # the largest budgets as plain numbers, so that the rank limit also works before the shuffle
    most = cases.agg(F.max("max_beliefs").alias("b"), F.max("max_questions").alias("q")).first()

    def first(flag: str, n: int | None) -> DataFrame:
        alike = Window.partitionBy("user_id", "scope").orderBy("id")
        few = b.filter(flag).select("id", "user_id", F.explode("scopes").alias("scope")).distinct()
        few = few.withColumn("_r", F.row_number().over(alike)).filter(F.col("_r") <= (n or 0)).drop("_r")
        met = c.join(few.hint("merge"), ["user_id", "scope"]).dropDuplicates(["case_id", "id"])
        return met.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= (n or 0))

    pinned = first("pin", most["b"]).filter(F.col("pos") <= F.col("max_beliefs"))
    asks = first("ask", most["q"]).filter(F.col("pos") <= F.col("max_questions"))
    # the provider's limit counts pinned hits too, so they are cut first and then left out
    budget = cases.select("case_id", "max_beliefs", F.col("user_id").alias("_user"), F.col("scopes").alias("_scopes"))
    mine = F.coalesce((F.col("user_id") == F.col("_user")) & F.arrays_overlap("scopes", "_scopes"), F.lit(False))
    got = hits.join(budget.hint("merge"), "case_id").filter(F.col("rank") <= F.col("max_beliefs")).join(b, "id")
    got = got.filter(~(mine & F.col("pin"))).select("case_id", "id", "rank", "type", "participants")
    extra = got.filter("type = 'relation'").select("case_id", "rank", F.posexplode("participants").alias("p", "id"))
    extra = (
        extra.join(budget.hint("merge"), "case_id").join(b.drop("type", "participants").hint("merge"), "id").filter(mine & ~F.col("pin"))
        .join(got.select("case_id", "id"), ["case_id", "id"], "left_anti")
        .groupBy("case_id", "id").agg(F.min(F.struct("rank", "p")).alias("o"))
    )
    budget = budget.select("case_id", "max_beliefs")
    rows = got.select("case_id", "id", F.struct(F.lit(0).alias("x"), F.col("rank").alias("r"), F.lit(0).alias("p")).alias("o")).unionByName(
        extra.select("case_id", "id", F.struct(F.lit(1).alias("x"), F.col("o.rank").alias("r"), F.col("o.p").alias("p")).alias("o"))
    )
    used = pinned.groupBy("case_id").agg(F.count(F.lit(1)).alias("used"))
    rel = rows.withColumn("pos", F.row_number().over(Window.partitionBy("case_id").orderBy("o", "id"))).join(budget, "case_id").join(used, "case_id", "left")
    rel = rel.filter(F.col("pos") <= F.greatest(F.col("max_beliefs") - F.coalesce("used", F.lit(0)), F.lit(0)))
    part = lambda df, name: df.select("case_id", F.lit(name).alias("section"), "id", "pos")
    return part(pinned, "pinned").unionByName(part(rel, "relevant")).unionByName(part(asks, "questions"))


def score_cases(cases: DataFrame, context: DataFrame, expect: DataFrame, pinned_ids: DataFrame) -> DataFrame:
    """Failures, precision, recall, pinned coverage, pass and drift of each case.

    expect(case_id, section, rule, id, other, n): rule is must, must_not, should, only, max, min, before or
    noise; section is pinned, relevant, questions or union (pinned and relevant). pinned_ids(id) lists what
    is pinned in the seed and so not expected to be retrieved.
    """
    ctx = context.select("case_id", "section", "id", "pos")
    u = ctx.filter("section in ('pinned', 'relevant')").select("case_id", F.lit("union").alias("section"), "id", "pos")
    have = ctx.unionByName(u).groupBy("case_id", "section", "id").agg(F.min("pos").alias("pos"))
    e = expect.join(have.withColumnRenamed("pos", "at"), ["case_id", "section", "id"], "left").join(
        have.select("case_id", "section", F.col("id").alias("other"), F.col("pos").alias("other_at")), ["case_id", "section", "other"], "left"
    )
    count = have.groupBy("case_id", "section").agg(F.count(F.lit(1)).alias("size"))
    e = e.join(count, ["case_id", "section"], "left").na.fill({"size": 0})
    here = F.col("at").isNotNull()
    bad = (
        F.when(F.col("rule").isin("must", "should", "only") & ~here, F.concat(F.lit("missing "), "section", F.lit(": "), "id"))
        .when(F.col("rule").isin("must_not", "noise") & here, F.concat(F.lit("surfaced "), "section", F.lit(": "), "id"))
        .when((F.col("rule") == "max") & (F.col("size") > F.col("n")), F.concat(F.lit("more than "), "n"))
        .when((F.col("rule") == "min") & (F.col("size") < F.col("n")), F.concat(F.lit("fewer than "), "n"))
        .when((F.col("rule") == "before") & ~F.coalesce(F.col("at") < F.col("other_at"), F.lit(False)), F.concat(F.lit("order: "), "id", F.lit(" before "), "other"))
    )
    told = e.select("case_id", bad.alias("failure")).filter("failure is not null")
    only = expect.filter("rule = 'only'").select("case_id", "section", "id")
    stray = (
        have.join(only.select("case_id", "section").distinct(), ["case_id", "section"], "left_semi").join(only, ["case_id", "section", "id"], "left_anti")
        .select("case_id", F.concat(F.lit("unexpected "), "section", F.lit(": "), "id").alias("failure"))
    )
    fails = told.unionByName(stray).distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias("failures"), F.min("failure").alias("first_failure"))
    strict = only.filter("section = 'relevant'").select("case_id").distinct()
    wanted = only.filter("section = 'relevant'").select("case_id", "id").unionByName(
        expect.filter("rule = 'must' and section = 'union'").select("case_id", "id").join(strict, "case_id", "left_anti").join(pinned_ids.select("id").distinct(), "id", "left_anti").select("case_id", "id")
    ).distinct()
    rel = have.filter("section = 'relevant'").select("case_id", "id")
    n_rel = rel.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_rel"))
    n_want = wanted.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_want"))
    n_hit = wanted.join(rel, ["case_id", "id"], "left_semi").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_hit"))
    pins = expect.filter("rule = 'must' and section = 'pinned'").select("case_id", "id").distinct()
    pin_hit = pins.join(have.filter("section = 'pinned'").select("case_id", "id"), ["case_id", "id"], "left_semi").groupBy("case_id").agg(F.count(F.lit(1)).alias("pin_hit"))
    n_pin = pins.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_pin"))
    out = cases
    for part in (fails, n_rel, n_want, n_hit, n_pin, pin_hit):
        out = out.join(part, "case_id", "left")
    out = out.na.fill(0, ["failures", "n_rel", "n_want", "n_hit", "n_pin", "pin_hit"])
    precision = F.when((F.col("n_rel") == 0) & (F.col("n_want") == 0), None).when(F.col("n_rel") == 0, 0.0).otherwise(F.round(F.col("n_hit") / F.col("n_rel"), 4))
    return out.select(
        *cases.columns, "failures", "first_failure", (F.col("failures") == 0).alias("passed"), precision.alias("precision"),
        F.when(F.col("n_want") > 0, F.round(F.col("n_hit") / F.col("n_want"), 4)).alias("recall"),
        F.when(F.col("n_pin") > 0, F.round(F.col("pin_hit") / F.col("n_pin"), 4)).alias("pinned_coverage"),
        F.coalesce(1 - precision, F.lit(0.0)).alias("drift"),
    )


def precision_summary(scored: DataFrame) -> DataFrame:
    """Per category and in total (category null): latency, means without nulls, pass rate and kinds of passes.

    scored(category, latency_ms, precision, recall, passed).
    """
    rows = scored.withColumn("kind", F.when(~F.col("passed"), F.lit(None)).when(F.col("precision") > 0, "active").when(F.col("category").isin(STRUCTURAL), "structural").otherwise("empty"))
    rows = rows.withColumn("category", F.explode(F.array(F.col("category"), F.lit(None).cast("string"))))
    kind = lambda k: F.count(F.when(F.col("kind") == k, 1))
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("cases"), F.count(F.when(F.col("passed"), 1)).alias("passed"), F.round(F.avg(F.col("passed").cast("int")), 4).alias("pass_rate"),
        F.round(F.avg("precision"), 4).alias("mean_precision"), F.round(F.avg("recall"), 4).alias("mean_recall"), F.round(F.avg("latency_ms"), 2).alias("mean_latency"),
        F.expr("percentile_disc(0.5) within group (order by latency_ms)").alias("p50_latency"), F.expr("percentile_disc(0.95) within group (order by latency_ms)").alias("p95_latency"),
        kind("active").alias("active"), kind("structural").alias("structural"), kind("empty").alias("trivially_empty"),
    )


# ------------------------------------------------------------------ contracts and leaks


def contract_score(tasks: DataFrame, asserts: DataFrame, log: DataFrame, returned: DataFrame) -> DataFrame:
    """Failures and pass of each agent task, judged by the audit log and the answer.

    tasks(task_id, suite, actor, answer, steps), asserts(task_id, rule, value): rule is must_call,
    must_not_call, match, any_of or cite; log(actor, verb); returned(task_id, id).
    """
    called = log.select("actor", F.regexp_replace("verb", "^tool:", "").alias("value")).distinct().withColumn("called", F.lit(True))
    t = tasks.join(asserts, "task_id", "left").join(called, ["actor", "value"], "left")
    cited = (
        returned.filter(F.length("id") >= 4).select("task_id", F.substring("id", 1, 4).alias("stub")).distinct()
        .join(tasks.select("task_id", "answer"), "task_id").filter(F.col("answer").contains(F.col("stub"))).select("task_id").distinct().withColumn("cited", F.lit(True))
    )
    t = t.join(cited, "task_id", "left")
    hit = F.coalesce(F.expr("answer rlike concat('(?i)', value)"), F.lit(False))
    was = F.coalesce("called", F.lit(False))
    rule = F.col("rule")
    one = (
        ((rule == "must_call") & ~was) | ((rule == "must_not_call") & was) | ((rule == "match") & ~hit) | ((rule == "cite") & ~F.coalesce("cited", F.lit(False)))
    )
    per = t.groupBy("task_id", "suite", "steps", "answer").agg(
        F.count(F.when(one, 1)).alias("_f"), F.count(F.when(rule == "any_of", 1)).alias("_any"), F.count(F.when((rule == "any_of") & hit, 1)).alias("_got")
    )
    silent = F.when(F.length(F.coalesce("answer", F.lit(""))) == 0, 1).otherwise(0)
    failures = F.col("_f") + F.when((F.col("_any") > 0) & (F.col("_got") == 0), 1).otherwise(0) + silent
    return per.select("task_id", "suite", "steps", failures.alias("failures"), (failures == 0).alias("passed"))


def suite_report(scored: DataFrame) -> DataFrame:
    rows = scored.withColumn("suite", F.explode(F.array(F.col("suite"), F.lit(None).cast("string"))))
    return rows.groupBy("suite").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("passed"), 1)).alias("passed"), F.round(F.avg("steps"), 1).alias("mean_steps"))


def answer_leakage(candidates: DataFrame, originals: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, token): gold tokens that stand as whole words in a candidate text and not in its original.

    candidates(id, text), originals(id, text), gold(token). Words are compared by equality, so a gold
    list of any size costs one join.
    """
    # a word edge sits between a word character and another one, so words keep digits and underscores
    w = candidates.select("id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^0-9a-z_]+"))).alias("token")).filter("token <> ''")
    had = originals.select("id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("token")).filter("token <> ''")
    g = gold.select(F.lower("token").alias("token")).distinct()
    return w.join(g, "token", "left_semi").join(had, ["id", "token"], "left_anti").select("id", "token")


def leak_audit(results: DataFrame, sentinels: DataFrame) -> DataFrame:
    """Result rows above the reader's tier: (result_id, reader_tier, sentinel) for each sentinel found in the text.

    results(result_id, reader_tier, text), sentinels(sentinel, tier). A sentinel is a run of any number of words. Words
    of the results that open a sentinel are found by equality, and the run from there meets the sentinels as a whole, so a
    first word that many sentinels share makes no pairs.
    """
    words = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    s = sentinels.select("sentinel", "tier", words("sentinel").alias("run")).filter(F.size("run") > 0).withColumn("head", F.col("run")[0])
    r = results.select("result_id", "reader_tier", words("text").alias("ws"))
    lengths = s.select("head", F.size("run").alias("n")).distinct()
    at = r.select("result_id", "reader_tier", F.posexplode("ws").alias("pos", "head")).join(lengths, "head")
    alone = at.filter("n = 1").join(s.filter(F.size("run") == 1).select("sentinel", "tier", "head"), "head")
    longer = at.filter("n > 1").join(r.select("result_id", "ws").distinct(), "result_id").withColumn("run", F.slice("ws", F.col("pos") + 1, F.col("n"))).drop("ws", "head")
    longer = longer.join(s.filter(F.size("run") > 1).select("sentinel", "tier", "run"), "run")
    told = lambda d: d.filter(F.col("tier") > F.col("reader_tier")).select("result_id", "reader_tier", "sentinel")
    return told(alone).unionByName(told(longer)).distinct()
