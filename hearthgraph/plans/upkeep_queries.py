"""What state changes leave beside the changed rows: edges, statistics, gaps, cleared vectors, filled fields."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import model
from ..operators import extraction as X
from ..operators import metrics as M
from ..operators import state as S
from ..session import table
from . import bindings as B
from .metric_queries import registry
from .registry import QUERIES, RAW, query
from .state_queries import options, today

AT = "2024-01-20 12:00:00"


@query("F01_unnamed_reader", f"select case when exists (select 1 from grants where granted_at <= timestamp '{AT}' and expires_at > timestamp '{AT}') then 2 else 1 end as allowed")
def f01_unnamed(spark, sf):
    return model.allowed_anyone(B.grants(spark, sf), F.lit(AT).cast("timestamp"))


@query(
    "A05_nightly_rollup",
    """
with daily as (
  select event_type as metric, ts::date as d, case when event_type = 'error' and user_id % 2 = 0 then 'even' end as label, sum(round(value * 100)::bigint)::double as value
  from events where ts::date >= date '2024-01-01' and ts::date <= date '2024-01-25' group by 1, 2, 3),
kept as (select * from daily where metric not in (select metric from daily where label is not null))
select metric, g as granularity, case g when 'day' then d when 'week' then date_trunc('week', d)::date else date_trunc('month', d)::date end as period_start, sum(value) as value
from kept, (values ('day'), ('week'), ('month')) t(g) group by 1, 2, 3""",
)
def a05_nightly(spark, sf):
    """The scan starts where the edge week and month of the last ten days begin; a labelled metric is left out."""
    end = dt.date(2024, 1, 25)
    start = M.rollup_scan_start(end, 10)
    e = table(spark, sf, "events").withColumn("period_start", F.to_date("ts")).filter(F.col("period_start").between(F.lit(start), F.lit(end)))
    label = F.when((F.col("event_type") == "error") & (F.col("user_id") % 2 == 0), "even")
    daily = e.groupBy(F.col("event_type").alias("metric"), "period_start", label.alias("label")).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double").alias("value"))
    return M.nightly_rollup(daily)


NAMES = ", ".join(f"'{m.name}'" for m in M.BUILT_IN)


@query(
    "A06_metric_gaps",
    f"""select metric, 'no data for ''' || metric || ''' between 2024-01-01 and 2024-01-31' as gap from (select unnest([{NAMES}]) as metric)
        where metric not in (select metric from all_daily where period_start between date '2024-01-01' and date '2024-01-31')""",
)
def a06_gaps(spark, sf):
    reg, start, end = registry(spark, sf), dt.date(2024, 1, 1), dt.date(2024, 1, 31)
    return reg.gaps(reg.run_all(start, end), start, end)


@query(
    "A11_cleared_vectors",
    "select vec_id as chunk_id, case when label % 2 = 0 then 'model-0' end as embed_model, case when label % 2 = 0 then len(embedding) end as dim from embeddings",
)
def a11_cleared(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("model-"), F.col("label") % 2).alias("embed_model"), "embedding")
    out = M.clear_other_models(e, "model-0")
    return out.select("chunk_id", "embed_model", F.when(F.col("embedding").isNotNull(), F.size("embedding").cast("bigint")).alias("dim"))


@query(
    "M02_branch_status",
    f"""
with b as ({RAW['M02_decision_branches']}),
n as (select *, case when decision_id % 7 = 0 and label = 'way R' then 'chosen' when decision_id % 7 = 0 then 'rejected' else status end as s from b)
select decision_id, label, s as status, case s when 'chosen' then 'chose' else s end as rel, s <> status as rewritten from n""",
)
def m02_status(spark, sf):
    """Every seventh decision turns to way R; its other branches are rejected."""
    b = QUERIES["M02_decision_branches"](spark, sf)
    to = F.when(F.col("label") == "way R", "chosen").otherwise("rejected").alias("status")
    return S.restatus_branches(b, b.filter("decision_id % 7 = 0").select("decision_id", "label", to))


@query(
    "M03_learned_principles",
    """select 'principle-' || o_orderkey::varchar as id, 'ship early' as rule, 'learned_from' as rel, o_orderkey as dst_id
       from orders join decisions d on d.id = o_orderkey where o_orderkey % 15 = 0 and o_orderstatus = 'P'""",
)
def m03_principles(spark, sf):
    k = F.col("o_orderkey")
    out = table(spark, sf, "orders").filter((k % 5 == 0) & (F.col("o_orderstatus") == "P")).select(
        k.alias("id"), F.lit("went as planned").alias("actual_outcome"), F.lit(None).cast("int").alias("score"), F.when(k % 15 == 0, "ship early").alias("lesson")
    )
    _, principles, edges = S.review_decisions(B.decisions(spark, sf), out, today())
    return principles.select("id", "rule").join(edges.select(F.col("src_id").alias("id"), "rel", "dst_id"), "id")


def subjects(spark, sf):
    """Orders as interactions with a person, an organisation, both or neither."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("id"), F.when(k % 3 != 0, F.col("o_custkey")).alias("person_id"), F.when((k % 3 == 0) & (k % 7 != 0) | (k % 11 == 1), k % 100).alias("org_id"), F.to_date("o_orderdate").alias("occurred_on")
    )


SUBJECTS = """(select o_orderkey as id, case when o_orderkey % 3 <> 0 then o_custkey end as person_id,
                 case when (o_orderkey % 3 = 0 and o_orderkey % 7 <> 0) or o_orderkey % 11 = 1 then o_orderkey % 100 end as org_id, o_orderdate::date as occurred_on from orders)"""


@query(
    "M04_involves_edges",
    f"""select 'interaction' as src_type, id as src_id, 'involves' as rel, case when person_id is not null then 'person' else 'org' end as dst_type, coalesce(person_id, org_id) as dst_id
        from {SUBJECTS} where (person_id is null) <> (org_id is null)""",
)
def m04_edges(spark, sf):
    return S.involves_edges(subjects(spark, sf))


@query(
    "M04_last_contact",
    f"""select p.id, greatest(case when p.id % 2 = 0 then date '1997-01-01' end, max(s.occurred_on)) as last_contact
        from people p left join {SUBJECTS} s on s.person_id = p.id group by p.id""",
)
def m04_contact(spark, sf):
    p = B.people(spark, sf).select("id", F.when(F.col("id") % 2 == 0, F.lit("1997-01-01").cast("date")).alias("last_contact"))
    return S.touch_last_contact(p, subjects(spark, sf)).select("id", "last_contact")


@query(
    "G06_filled_relation",
    """select p.id, coalesce(p.relation, (select min(case o_orderpriority when '2-HIGH' then 'manager' when '3-MEDIUM' then 'friend' end) from orders where o_custkey = p.id)) as relation from people p""",
)
def g06_relation(spark, sf):
    """What the orders' priorities say about a customer fills an empty relation; a work role but manager does not."""
    said = F.when(F.col("o_orderpriority") == "1-URGENT", "colleague").when(F.col("o_orderpriority") == "2-HIGH", "manager").when(F.col("o_orderpriority") == "3-MEDIUM", "friend")
    resolved = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), said.alias("relation"))
    return X.fill_relation(B.people(spark, sf), resolved).select("id", "relation")
