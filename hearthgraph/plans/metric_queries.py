"""A*, W01, W02, V01 on the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..session import table
from .bindings import EVENT_NOW, audit_log
from .registry import cte, query

ORDERS_FROM, ORDERS_TO = dt.date(1995, 1, 1), dt.date(2001, 12, 31)
EVENTS_FROM, EVENTS_TO = dt.date(2024, 1, 1), dt.date(2024, 12, 31)


def transactions(spark, sf):
    o = table(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.select(
        F.to_date("o_orderdate").alias("occurred_on"),
        F.when(F.col("o_orderstatus") == "F", -cents).otherwise(cents).alias("cents"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("category"),
    )


cte(
    "transactions",
    """
  select o_orderdate::date as occurred_on,
         (case when o_orderstatus = 'F' then -1 else 1 end) * round(o_totalprice * 100)::bigint as cents,
         case when o_orderpriority <> '4-NOT SPECIFIED' then o_orderpriority end as category
  from orders""",
)


def samples(spark, sf):
    """Views count as steps and purchases as sleep minutes; values in whole hundredths."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "view", "steps").when(F.col("event_type") == "purchase", "sleep_minutes")
    return e.select(
        kind.alias("kind"), F.col("ts").cast("timestamp").alias("happened_at"), F.round(F.col("value") * 100).cast("bigint").alias("value")
    ).filter("kind is not null")


cte(
    "samples",
    """
  select case event_type when 'view' then 'steps' when 'purchase' then 'sleep_minutes' end as kind, ts as happened_at,
         round(value * 100)::bigint as value
  from events where event_type in ('view', 'purchase')""",
)


def calendar(spark, sf):
    e = table(spark, sf, "events")
    title = (
        F.when(F.col("event_type") == "click", "Deep Work block").when(F.col("event_type") == "error", "FOCUS time").otherwise("Chat")
    )
    ts = F.col("ts").cast("timestamp")
    mins = F.expr("make_interval(0, 0, 0, 0, 0, cast(user_id % 90 as int), 0)")
    return e.select(
        title.alias("title"), ts.alias("starts_at"), F.when(F.col("event_id") % 5 != 0, ts + mins).alias("ends_at")
    )


cte(
    "calendar",
    """
  select case event_type when 'click' then 'Deep Work block' when 'error' then 'FOCUS time' else 'Chat' end as title,
         ts as starts_at, case when event_id % 5 <> 0 then ts + to_minutes(user_id % 90) end as ends_at
  from events""",
)


def journal(spark, sf):
    e = table(spark, sf, "events")
    return e.filter("event_type = 'signup'").select(F.col("ts").cast("timestamp").alias("happened_at"))


def registry(spark, sf):
    return M.MetricRegistry(
        {
            "transactions": transactions(spark, sf),
            "samples": samples(spark, sf),
            "calendar": calendar(spark, sf),
            "journal": journal(spark, sf),
        }
    )


cte(
    "spend_total",
    """select occurred_on as period_start, (sum(case when cents < 0 then -cents else 0 end) / 100.0)::double as value,
              null::varchar as label from transactions group by 1""",
)
cte(
    "spend_by_category",
    """select occurred_on as period_start, (sum(case when cents < 0 then -cents else 0 end) / 100.0)::double as value,
              coalesce(category, 'uncategorized') as label from transactions group by 1, 3""",
)
cte(
    "steps_by_day",
    "select happened_at::date as period_start, sum(value)::double as value, null::varchar as label from samples where kind = 'steps' group by 1",
)
cte(
    "sleep_by_day",
    "select happened_at::date as period_start, sum(value)::double as value, null::varchar as label from samples where kind = 'sleep_minutes' group by 1",
)
cte(
    "focus_by_day",
    """select starts_at::date as period_start,
              (sum(epoch_us(coalesce(ends_at, starts_at + interval 1 hour)) - epoch_us(starts_at)) / 60000000.0)::double as value,
              null::varchar as label
       from calendar where regexp_matches(title, '(?i)deep work|focus') group by 1""",
)
cte(
    "streak_by_day",
    """select d as period_start, (count(*) over (partition by g order by d))::double as value, null::varchar as label
       from (select d, d - (row_number() over (order by d))::integer as g
             from (select distinct ts::date as d from events where event_type = 'signup'))""",
)
cte(
    "all_daily",
    """select 'spend_total' as metric, * from spend_total union all select 'spend_by_category', * from spend_by_category
       union all select 'steps', * from steps_by_day union all select 'sleep_minutes', * from sleep_by_day
       union all select 'deep_work_minutes', * from focus_by_day union all select 'journal_streak', * from streak_by_day""",
)


@query("A01_metric_spend_total", "select period_start, value from spend_total")
def a01(spark, sf):
    return registry(spark, sf).run("spend_total", ORDERS_FROM, ORDERS_TO).select("period_start", "value")


@query("A02_metric_spend_by_category", "select period_start, value, label from spend_by_category")
def a02(spark, sf):
    return registry(spark, sf).run("spend_by_category", ORDERS_FROM, ORDERS_TO)


@query(
    "A03_metric_samples_by_day",
    "select 'steps' as metric, period_start, value from steps_by_day union all select 'sleep_minutes', period_start, value from sleep_by_day",
)
def a03(spark, sf):
    return registry(spark, sf).run_all(EVENTS_FROM, EVENTS_TO, ["steps", "sleep_minutes"]).select("metric", "period_start", "value")


@query("A04_metric_block_minutes", "select period_start, round(value, 4) as value from focus_by_day")
def a04(spark, sf):
    return (
        registry(spark, sf).run("deep_work_minutes", EVENTS_FROM, EVENTS_TO).select("period_start", F.round("value", 4).alias("value"))
    )


ROLLUP_SQL = """
select metric, granularity, period_start, label, round(sum(value), 2) as value from (
  select metric, label, value, g as granularity,
         case g when 'day' then period_start when 'week' then date_trunc('week', period_start)::date
                else date_trunc('month', period_start)::date end as period_start
  from all_daily, (values ('day'), ('week'), ('month')) t(g)) group by all"""


@query("A05_metric_rollup", ROLLUP_SQL)
def a05(spark, sf):
    reg = registry(spark, sf)
    return reg.rollup(reg.run_all(ORDERS_FROM, EVENTS_TO)).withColumn("value", F.round("value", 2))


@query("A06_metric_registry", "select metric, period_start, label, round(value, 2) as value from all_daily")
def a06(spark, sf):
    return registry(spark, sf).run_all(ORDERS_FROM, EVENTS_TO).withColumn("value", F.round("value", 2))


@query(
    "A07_metric_anomalies",
    """
with daily as (
  select event_type as metric, ts::date as period_start, sum(round(value * 100)::bigint)::double as value from events group by 1, 2
  union all
  select 'user ' || user_id::varchar, ts::date, sum(round(value * 100)::bigint)::double from events group by 1, 2),
latest as (select metric, max(period_start) as day, arg_max(value, period_start) as latest from daily group by metric),
stats as (select l.metric, avg(d.value) as mean, stddev_samp(d.value) as sd, count(*) as n_days
          from latest l join daily d on d.metric = l.metric and d.period_start between l.day - 28 and l.day - 1 group by l.metric)
select metric, day, latest, round(mean, 3) as mean, round(sd, 3) as sd, n_days
from latest join stats using (metric) where sd > 0 and abs(latest - mean) > 2 * sd""",
)
def a07(spark, sf):
    e = table(spark, sf, "events").select(
        F.to_date("ts").alias("period_start"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
        F.explode(F.array(F.col("event_type"), F.concat(F.lit("user "), F.col("user_id")))).alias("metric"),
    )
    daily = e.groupBy("metric", "period_start").agg(F.sum("v").cast("double").alias("value")).withColumn("granularity", F.lit("day"))
    out = M.anomalies(daily, F.lit(EVENT_NOW).cast("date"))
    return out.select("metric", "day", "latest", F.round("mean", 3).alias("mean"), F.round("sd", 3).alias("sd"), "n_days")


ACCESS_SQL = f"""
select json_extract_string(payload, '$.returned_ids[0]') as parent_id, count(*) as drills
from audit_log where verb = 'tool:get_context' and happened_at >= timestamp '{EVENT_NOW}' - interval 90 days group by 1"""


@query("A08_access_counts", ACCESS_SQL)
def a08(spark, sf):
    return M.access_counts(audit_log(spark, sf), F.lit(EVENT_NOW).cast("timestamp"))


@query(
    "A09_audit_summary",
    """select actor, verb, count(*) as calls, (2 * count(*))::bigint as ids, 0::bigint as errors,
              min(happened_at)::date as first_on, max(happened_at)::date as last_on
       from audit_log where happened_at >= timestamp '2024-01-05 00:00:00' group by actor, verb""",
)
def a09(spark, sf):
    s = M.audit_summary(audit_log(spark, sf), F.lit("2024-01-05 00:00:00").cast("timestamp"))
    return s.select(
        "actor", "verb", "calls", "ids", "errors", F.to_date("first_at").alias("first_on"), F.to_date("last_at").alias("last_on")
    )


@query(
    "A11_embedding_inventory",
    """select 'model-' || (label % 2)::varchar as embed_model, count(*) as chunks,
              count(case when vec_id % 3 = 0 then 1 end) as missing, label % 2 <> 0 as to_clear
       from embeddings group by 1, 4""",
)
def a11(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.concat(F.lit("model-"), F.col("label") % 2).alias("embed_model"),
        F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"),
    )
    return M.embedding_inventory(e, "model-0")


@query(
    "W01_journal_streak",
    """
with days as (select distinct user_id, ts::date as day from events),
isl as (select *, day - (row_number() over (partition by user_id order by day))::integer as g from days)
select user_id, day, (row_number() over (partition by user_id, g order by day))::integer as streak from isl""",
)
def w01(spark, sf):
    d = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    return M.streaks(d, ["user_id"])


@query(
    "W02_latest_per_key",
    """select user_id, max(ts)::date as day, arg_max(event_type, (ts, event_id)) as event_type,
              arg_max(value, (ts, event_id)) as value from events group by user_id""",
)
def w02(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    out = M.latest_per_key(e, ["user_id"], F.struct("ts", "event_id"))
    return out.select("user_id", F.to_date("ts").alias("day"), "event_type", "value")


@query(
    "V01_registered_metrics",
    """select metric, granularity, period_start, label, max(value) as value from (
         select 'busiest_price_cents' as metric, g as granularity, o_orderpriority as label,
                case g when 'day' then o_orderdate::date when 'week' then date_trunc('week', o_orderdate)::date
                       else date_trunc('month', o_orderdate)::date end as period_start,
                round(o_totalprice * 100)::bigint::double as value
         from orders, (values ('day'), ('week'), ('month')) t(g)) group by all""",
)
def v01(spark, sf):
    reg = registry(spark, sf)
    reg.register(
        M.Metric(
            "busiest_price_cents",
            "cents",
            """select occurred_on as period_start, cast(max(abs(cents)) as double) as value,
                      coalesce(category, '4-NOT SPECIFIED') as label
               from {transactions} where occurred_on between :from and :to
               group by occurred_on, coalesce(category, '4-NOT SPECIFIED')""",
            fold="max",
        )
    )
    return reg.rollup(reg.run("busiest_price_cents", ORDERS_FROM, ORDERS_TO).withColumn("metric", F.lit("busiest_price_cents")))
