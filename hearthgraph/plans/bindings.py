"""How the knowledge-base tables are read off the test tables, once in Spark and once in SQL.

Nothing here is operator logic: each function is a projection that gives the operators their input
shape (documents as pages, customers as people, suppliers as organisations, orders as work items).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .registry import cte

TODAY = "2001-06-15"  # the literal "now" of the order-shaped tables
DOC_NOW = "2025-01-01"  # the literal "now" of the document-shaped tables
EVENT_NOW = "2024-01-30 00:00:00"


def pages_state(spark: SparkSession, sf: str) -> DataFrame:
    """documents + labels as pages with tier, provenance and an update day."""
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    src = F.col("source")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 120).alias("title"),
        F.when(F.col("toxic") == 1, 2).otherwise(1).alias("tier"),
        F.expr("date_add(date'2024-01-01', cast(doc_id % 365 as int))").alias("updated_on"),
        F.when(F.col("lang") == "en", "system:curate").otherwise("human").alias("created_by"),
        F.when(src == "src0", "job:notes").when(src == "src1", "job:decision-digest").otherwise(src).alias("source"),
        F.coalesce(F.col("quality") == 0, F.lit(False)).alias("derived"),
        "lang",
        "text",
    )


cte(
    "pages_state",
    """
  select d.doc_id as id, substr(split_part(d.text, chr(10), 1), 1, 120) as title,
         case when l.toxic = 1 then 2 else 1 end as tier,
         date '2024-01-01' + cast(d.doc_id % 365 as integer) as updated_on,
         case when d.lang = 'en' then 'system:curate' else 'human' end as created_by,
         case d.source when 'src0' then 'job:notes' when 'src1' then 'job:decision-digest' else d.source end as source,
         coalesce(l.quality = 0, false) as derived, d.lang, d.text
  from documents d left join labels l using (doc_id)""",
)


def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """One chunk per non-blank line of a page; the chunker's own output has the same columns."""
    p = pages_state(spark, sf)
    return (
        p.select("id", "tier", "updated_on", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
        .filter(F.length(F.trim("text")) > 0)
        .select(
            F.concat_ws(":", F.col("id").cast("string"), F.col("ord").cast("string")).alias("chunk_id"),
            F.lit("page").alias("parent_type"),
            F.col("id").alias("parent_id"),
            "ord",
            "text",
            "tier",
            "updated_on",
        )
    )


cte(
    "line_chunks",
    """
  select id::varchar || ':' || (ord - 1)::varchar as chunk_id, 'page' as parent_type, id as parent_id,
         (ord - 1)::integer as ord, line as text, tier, updated_on
  from (select id, tier, updated_on, unnest(string_split(text, chr(10))) as line,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) as ord from pages_state)
  where length(trim(line)) > 0""",
)


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


cte("passages", "select item_id as query_id, text as query from benchmark")


def people(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("canonical_name"),
        F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.lower("c_mktsegment")).alias("relation"),
        F.when(F.col("c_nationkey") == 3, 2).otherwise(1).alias("tier"),
        F.lit("system:extract").alias("created_by"),
        F.expr("date_add(date'1999-01-01', cast(c_custkey % 900 as int))").alias("updated_on"),
    )


cte(
    "people",
    """
  select c_custkey as id, c_name as canonical_name,
         case when c_acctbal < 0 then null else lower(c_mktsegment) end as relation,
         case when c_nationkey = 3 then 2 else 1 end as tier, 'system:extract' as created_by,
         date '1999-01-01' + cast(c_custkey % 900 as integer) as updated_on
  from customer""",
)


def person_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Every person goes by 'cust N'; every tenth also by the name of the same-numbered supplier."""
    c = table(spark, sf, "customer")
    a = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("Cust "), F.col("c_custkey")).alias("alias"))
    b = c.filter("c_custkey % 10 = 0").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("SUPPLIER#"), F.lpad((F.col("c_custkey") / 10).cast("long").cast("string"), 9, "0")).alias("alias"),
    )
    return a.unionByName(b)


cte(
    "person_aliases",
    """
  select c_custkey as id, 'Cust ' || c_custkey::varchar as alias from customer
  union all
  select c_custkey, 'SUPPLIER#' || lpad((c_custkey // 10)::varchar, 9, '0') from customer where c_custkey % 10 = 0""",
)


def orgs(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("canonical_name"),
        (F.col("s_acctbal") < 0).alias("retired"),
        F.lit(1).alias("tier"),
    )


cte("orgs", "select s_suppkey as id, s_name as canonical_name, s_acctbal < 0 as retired, 1 as tier from supplier")


def org_aliases(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Supp "), F.col("s_suppkey")).alias("alias"))


cte("org_aliases", "select s_suppkey as id, 'Supp ' || s_suppkey::varchar as alias from supplier")


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("person_id"),
        F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("kind"),
        F.to_date("o_orderdate").alias("occurred_on"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(2).alias("tier"),
    )


cte(
    "interactions",
    """
  select o_orderkey as id, o_custkey as person_id, lower(split_part(o_orderpriority, '-', 2)) as kind,
         o_orderdate::date as occurred_on, case when o_orderstatus = 'P' then 1 else 2 end as tier
  from orders""",
)


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    st = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Pack "), F.lower("o_orderpriority"), F.lit(" for cust "), F.col("o_custkey")).alias("title"),
        F.when(st == "O", "active").when(st == "P", "waiting").otherwise("done").alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise(F.to_date("o_orderdate")).alias("due"),
        F.to_date("o_orderdate").alias("updated_on"),
        F.when(F.col("o_custkey") % 20 == 0, 2).otherwise(1).alias("tier"),
    )


cte(
    "tasks",
    """
  select o_orderkey as id, 'Pack ' || lower(o_orderpriority) || ' for cust ' || o_custkey::varchar as title,
         case o_orderstatus when 'O' then 'active' when 'P' then 'waiting' else 'done' end as status,
         case when o_orderpriority = '5-LOW' then null else o_orderdate::date end as due,
         o_orderdate::date as updated_on, case when o_custkey % 20 = 0 then 2 else 1 end as tier
  from orders""",
)


def commitments(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Deliver order "), F.col("o_orderkey")).alias("what"),
        F.upper("c_name").alias("to_whom"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.to_date("o_orderdate")).alias("due"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("kept").alias("status"),
        F.lit(1).alias("tier"),
    )


cte(
    "commitments",
    """
  select o_orderkey as id, 'Deliver order ' || o_orderkey::varchar as what, upper(c_name) as to_whom,
         case when o_orderpriority = '1-URGENT' then o_orderdate::date end as due,
         case when o_orderstatus = 'O' then 'open' else 'kept' end as status, 1 as tier
  from orders join customer on o_custkey = c_custkey""",
)


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    pr = F.split_part("o_orderpriority", F.lit("-"), F.lit(2))
    done = F.col("o_orderstatus") == "F"
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("which way to ship "), pr, F.lit(" order "), F.col("o_orderkey"), F.lit("??")).alias("question"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("choice"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit("late parcels cost us")).alias("stakes"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("cust "), F.col("o_custkey"), F.lit(" asked twice"))).alias("reasoning"),
        F.when(F.col("o_custkey") % 5 == 0, F.lit("it comes back")).alias("falsifier"),
        F.when(F.col("o_custkey") % 4 == 0, F.lit("it arrives in time")).alias("expected_outcome"),
        F.when(done & (F.col("o_custkey") % 7 == 0), F.lit("it arrived")).alias("actual_outcome"),
        F.when(F.col("o_custkey") % 6 == 0, (F.col("o_orderkey") % 101).cast("int")).alias("confidence"),
        F.when(done & (F.col("o_custkey") % 7 == 0), (F.col("o_orderkey") % 100).cast("int")).alias("outcome_score"),
        F.when(F.col("o_custkey") % 3 != 1, F.date_add(F.to_date("o_orderdate"), 90)).alias("review_on"),
        F.when(done, F.date_add(F.to_date("o_orderdate"), 95)).alias("reviewed_on"),
        F.to_date("o_orderdate").alias("updated_on"),
        F.when(F.col("o_custkey") % 20 == 0, 2).otherwise(1).alias("tier"),
    )


cte(
    "decisions",
    """
  select o_orderkey as id,
         'which way to ship ' || split_part(o_orderpriority, '-', 2) || ' order ' || o_orderkey::varchar || '??' as question,
         case when o_orderstatus <> 'O' then o_orderpriority end as choice,
         case when o_custkey % 3 = 0 then 'late parcels cost us' end as stakes,
         case when o_custkey % 2 = 0 then 'cust ' || o_custkey::varchar || ' asked twice' end as reasoning,
         case when o_custkey % 5 = 0 then 'it comes back' end as falsifier,
         case when o_custkey % 4 = 0 then 'it arrives in time' end as expected_outcome,
         case when o_orderstatus = 'F' and o_custkey % 7 = 0 then 'it arrived' end as actual_outcome,
         case when o_custkey % 6 = 0 then (o_orderkey % 101)::integer end as confidence,
         case when o_orderstatus = 'F' and o_custkey % 7 = 0 then (o_orderkey % 100)::integer end as outcome_score,
         case when o_custkey % 3 <> 1 then o_orderdate::date + 90 end as review_on,
         case when o_orderstatus = 'F' then o_orderdate::date + 95 end as reviewed_on,
         o_orderdate::date as updated_on, case when o_custkey % 20 = 0 then 2 else 1 end as tier
  from orders""",
)


def branches(spark: SparkSession, sf: str) -> DataFrame:
    """A decision's branches: the return flags on its lines."""
    li = table(spark, sf, "lineitem")
    flag = F.col("l_returnflag")
    return (
        li.groupBy("l_orderkey", "l_returnflag")
        .agg(F.max(F.to_date("l_shipdate")).alias("updated_on"), F.max("l_linenumber").alias("n"))
        .select(
            F.col("l_orderkey").alias("decision_id"),
            F.concat(F.lit("way "), flag).alias("label"),
            F.when(flag == "A", "chosen").when(flag == "R", "rejected").otherwise("considered").alias("status"),
            "updated_on",
            F.when(F.col("n") > 6, 2).otherwise(1).alias("tier"),
        )
    )


cte(
    "branches",
    """
  select l_orderkey as decision_id, 'way ' || l_returnflag as label,
         case l_returnflag when 'A' then 'chosen' when 'R' then 'rejected' else 'considered' end as status,
         max(l_shipdate)::date as updated_on, case when max(l_linenumber) > 6 then 2 else 1 end as tier
  from lineitem group by l_orderkey, l_returnflag""",
)

EDGE_COLS = [
    "edge_id", "src_type", "src_id", "rel", "dst_type", "dst_id", "source_table", "source_id",
    "extracted_by", "confidence", "created_on",
]


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """interaction -> person, interaction -> org and person -> org edges read off the star schema."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    inv = o.select(
        F.concat(F.lit("i"), F.col("o_orderkey")).alias("edge_id"),
        F.lit("interaction").alias("src_type"), F.col("o_orderkey").alias("src_id"),
        F.lit("involves").alias("rel"), F.lit("person").alias("dst_type"), F.col("o_custkey").alias("dst_id"),
        F.lit("interactions").alias("source_table"), F.col("o_orderkey").alias("source_id"),
        F.lit("human").alias("extracted_by"), F.lit(1.0).alias("confidence"),
        F.to_date("o_orderdate").alias("created_on"),
    )
    men = (
        li.groupBy("l_orderkey", "l_suppkey")
        .agg(F.min(F.to_date("l_shipdate")).alias("created_on"))
        .select(
            F.concat(F.lit("m"), F.col("l_orderkey"), F.lit("-"), F.col("l_suppkey")).alias("edge_id"),
            F.lit("interaction").alias("src_type"), F.col("l_orderkey").alias("src_id"),
            F.lit("mentions").alias("rel"), F.lit("org").alias("dst_type"), F.col("l_suppkey").alias("dst_id"),
            F.lit("interactions").alias("source_table"), F.col("l_orderkey").alias("source_id"),
            F.lit("system:extract").alias("extracted_by"), F.lit(0.8).alias("confidence"), "created_on",
        )
    )
    wrk = (
        o.filter("o_orderpriority = '1-URGENT'")
        .join(li, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey", "l_suppkey")
        .agg(F.min(F.to_date("o_orderdate")).alias("created_on"), F.min("o_orderkey").alias("k"))
        .select(
            F.concat(F.lit("w"), F.col("o_custkey"), F.lit("-"), F.col("l_suppkey")).alias("edge_id"),
            F.lit("person").alias("src_type"), F.col("o_custkey").alias("src_id"),
            F.lit("works_at").alias("rel"), F.lit("org").alias("dst_type"), F.col("l_suppkey").alias("dst_id"),
            F.lit("tasks").alias("source_table"), F.col("k").alias("source_id"),
            F.lit("system:extract").alias("extracted_by"), F.lit(0.85).alias("confidence"), "created_on",
        )
    )
    return inv.unionByName(men).unionByName(wrk)


cte(
    "edges",
    """
  select 'i' || o_orderkey::varchar as edge_id, 'interaction' as src_type, o_orderkey as src_id, 'involves' as rel,
         'person' as dst_type, o_custkey as dst_id, 'interactions' as source_table, o_orderkey as source_id,
         'human' as extracted_by, 1.0::double as confidence, o_orderdate::date as created_on from orders
  union all
  select 'm' || l_orderkey::varchar || '-' || l_suppkey::varchar, 'interaction', l_orderkey, 'mentions', 'org', l_suppkey,
         'interactions', l_orderkey, 'system:extract', 0.8, min(l_shipdate)::date from lineitem group by l_orderkey, l_suppkey
  union all
  select 'w' || o_custkey::varchar || '-' || l_suppkey::varchar, 'person', o_custkey, 'works_at', 'org', l_suppkey,
         'tasks', min(o_orderkey), 'system:extract', 0.85, min(o_orderdate)::date
  from orders join lineitem on o_orderkey = l_orderkey where o_orderpriority = '1-URGENT' group by o_custkey, l_suppkey""",
)


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The unified titled rows of every parent type that the edges touch."""
    p = people(spark, sf).select(F.lit("person").alias("type"), "id", F.col("canonical_name").alias("title"), "tier")
    g = orgs(spark, sf).select(F.lit("org").alias("type"), "id", F.col("canonical_name").alias("title"), "tier")
    i = interactions(spark, sf).select(
        F.lit("interaction").alias("type"), "id", F.concat("kind", F.lit(" on "), F.col("occurred_on").cast("string")).alias("title"), "tier"
    )
    t = tasks(spark, sf).select(F.lit("task").alias("type"), "id", "title", "tier")
    d = decisions(spark, sf).select(F.lit("decision").alias("type"), "id", F.col("question").alias("title"), "tier")
    return p.unionByName(g).unionByName(i).unionByName(t).unionByName(d)


cte(
    "nodes",
    """
  select 'person' as type, id, canonical_name as title, tier from people
  union all select 'org', id, canonical_name, tier from orgs
  union all select 'interaction', id, kind || ' on ' || occurred_on::varchar, tier from interactions
  union all select 'task', id, title, tier from tasks
  union all select 'decision', id, question, tier from decisions""",
)


def edges_tiered(spark: SparkSession, sf: str) -> DataFrame:
    from ..model import with_edge_tier

    return with_edge_tier(edges(spark, sf), nodes(spark, sf))


cte(
    "edges_tiered",
    """
  select e.*, coalesce(n.tier, 1) as tier from edges e
  left join nodes n on n.id = e.source_id
   and n.type = case e.source_table when 'interactions' then 'interaction' when 'tasks' then 'task' end""",
)


def grants(spark: SparkSession, sf: str) -> DataFrame:
    """A signup event unlocks tier 2 for its user for an hour."""
    e = table(spark, sf, "events")
    return e.filter("event_type = 'signup'").select(
        F.col("user_id").cast("string").alias("actor"),
        F.col("ts").cast("timestamp").alias("granted_at"),
        (F.col("ts").cast("timestamp") + F.expr("interval 60 minutes")).alias("expires_at"),
    )


cte(
    "grants",
    """
  select user_id::varchar as actor, ts as granted_at, ts + interval 60 minutes as expires_at
  from events where event_type = 'signup'""",
)


def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    """events as the audit log: a click is a drill-in whose first returned id is props.k."""
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("happened_at"),
        F.col("user_id").cast("string").alias("actor"),
        F.when(F.col("event_type") == "click", "tool:get_context").otherwise(F.concat(F.lit("tool:"), "event_type")).alias("verb"),
        F.concat(F.lit('{"returned_ids":["'), F.get_json_object("props", "$.k"), F.lit('","x"]}')).alias("payload"),
    )


cte(
    "audit_log",
    """
  select event_id, ts as happened_at, user_id::varchar as actor,
         case when event_type = 'click' then 'tool:get_context' else 'tool:' || event_type end as verb,
         '{"returned_ids":["' || json_extract_string(props, '$.k') || '","x"]}' as payload
  from events""",
)
