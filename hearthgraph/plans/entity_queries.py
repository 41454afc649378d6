"""F01-F03, F05, J*, T03, U01, W06, A10, G04, G08, G09 on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..operators import entities as E
from ..session import table
from . import bindings as B
from .bindings import TODAY
from .registry import cte, query


@query(
    "F01_tier_filter",
    """
with actors as (select distinct user_id::varchar as actor from events),
allowed as (select actor, max(case when expires_at > timestamp '2024-01-20 12:00:00' and granted_at <= timestamp '2024-01-20 12:00:00'
                                   then 2 else 1 end) as allowed
            from actors left join grants using (actor) group by actor)
select allowed, count(*) as readers, (select count(*) from pages_state where tier between 1 and allowed) as readable_pages
from allowed group by allowed""",
)
def f01(spark, sf):
    at = F.lit("2024-01-20 12:00:00").cast("timestamp")
    actors = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("actor")).distinct()
    readers = model.allowed_tiers(actors, B.grants(spark, sf), at).groupBy("allowed").agg(F.count(F.lit(1)).alias("readers"))
    levels = F.explode(F.array(F.lit(1), F.lit(2))).alias("allowed")
    pages = (
        B.pages_state(spark, sf).select("tier", levels).filter(model.visible(F.col("tier"), F.col("allowed")))
        .groupBy("allowed").agg(F.count(F.lit(1)).alias("readable_pages"))
    )
    return readers.join(pages, "allowed")


@query(
    "F03_edge_tier",
    "select rel, source_table, tier, count(*) as edges, count(distinct src_id) as sources from edges_tiered group by 1, 2, 3",
)
def f03(spark, sf):
    e = B.edges_tiered(spark, sf)
    return e.groupBy("rel", "source_table", "tier").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src_id").alias("sources"))


def proper_orgs(spark, sf):
    """Documents' opening words as extractor-made organisation names, to screen for personal names."""
    d = table(spark, sf, "documents")
    # the runs of letters that open the text and that follow its first other characters, as splitting the whole text tells them
    first, rest = r"^([A-Za-z]*)", r"^[A-Za-z]*[^A-Za-z]+([A-Za-z]*)"
    second = F.when(F.col("text").rlike(rest), F.regexp_extract("text", rest, 1))
    name = F.concat_ws(" ", F.initcap(F.regexp_extract("text", first, 1)), F.initcap(second))
    return d.select(
        F.col("doc_id").alias("id"), name.alias("canonical_name"), (F.col("n_chars") < 200).alias("retired"),
        F.lit("system:extract").alias("created_by"),
    )


cte(
    "proper_orgs",
    """
  select doc_id as id, n_chars < 200 as retired,
         (case when len(w) >= 1 then upper(substr(w[1], 1, 1)) || lower(substr(w[1], 2)) else '' end)
         || case when len(w) >= 2 then ' ' || upper(substr(w[2], 1, 1)) || lower(substr(w[2], 2)) else '' end as canonical_name
  from (select doc_id, n_chars, regexp_split_to_array(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), ' +') as w from documents)""",
)


@query(
    "F05_mistyped_entities",
    f"""
with staffed as (select dst_id as id from edges where rel = 'works_at' group by 1 having count(distinct src_id) >= 2),
deg as (select id, count(*) as edges from (
          select edge_id, src_id as id from edges where src_type = 'org' union select edge_id, dst_id from edges where dst_type = 'org') group by 1)
select 'org_should_be_person' as kind, 'org' as type, o.id, o.canonical_name as name, coalesce(deg.edges, 0) as edges
from proper_orgs o left join deg using (id)
where not retired and regexp_matches(o.canonical_name, '^\\p{{Lu}}\\p{{L}}+( \\p{{Lu}}\\p{{L}}+){{1,2}}$')
  and not regexp_matches(lower(o.canonical_name), '({E.ORG_NAME_CUES})')
  and o.id not in (select id from staffed)
  and lower(o.canonical_name) not in (select lower(r_name) from region)""",
)
def f05(spark, sf):
    known = table(spark, sf, "region").select(F.col("r_name").alias("value"))
    return E.mistyped(proper_orgs(spark, sf), B.people(spark, sf), B.edges(spark, sf), E.term_list(known))


def lexicon(spark, sf):
    p = E.names(B.people(spark, sf), B.person_aliases(spark, sf)).withColumn("type", F.lit("person"))
    o = E.names(B.orgs(spark, sf), B.org_aliases(spark, sf)).withColumn("type", F.lit("org"))
    return p.unionByName(o)


cte(
    "lexicon",
    """
  select 'person' as type, id, canonical_name as name from people union select 'person', id, alias from person_aliases
  union select 'org', id, canonical_name from orgs union select 'org', id, alias from org_aliases""",
)


def questions(spark, sf):
    """One question per commitment; each spells its customer in its own way and may run on into a digit."""
    c = B.commitments(spark, sf)
    return c.select(
        F.col("id").alias("query_id"),
        F.concat(F.lit("what is open for "), F.col("to_whom"), F.lit(" and supp "), F.col("id") % 40, F.lit("?")).alias("query"),
    )


cte(
    "questions",
    "select id as query_id, 'what is open for ' || to_whom || ' and supp ' || (id % 40)::varchar || '?' as query from commitments",
)


@query(
    "J01_entities_named_in",
    """
with grams as (select distinct type, id, lower(name) as name from lexicon),
q as (select query_id, lower(query) as q, regexp_extract(lower(query), 'customer#([0-9]+)', 1)::bigint as k, (query_id % 40)::varchar as s from questions)
select query_id, type, id from (
  select q.query_id, g.type, g.id from q join grams g on g.type = 'person' and g.id = q.k where contains(q.q, g.name)
  union select q.query_id, g.type, g.id from q join grams g on g.type = 'org' and starts_with(g.name, 'supp ') and contains(q.q, g.name)
  union select q.query_id, g.type, g.id from q join grams g on starts_with(g.name, 'cust ') and contains(q.q, g.name))""",
)
def j01(spark, sf):
    return E.named_in(questions(spark, sf), lexicon(spark, sf))


NEIGHBORS = """
with refs as (select 'o' || id::varchar as key, 'org' as type, id from orgs where not retired
              union all select 'p' || id::varchar, 'person', id from people where relation is null),
e as (select * from edges_tiered where tier <= 1)
select key, type, id from (
  select r.key, e.src_type as type, e.src_id as id from refs r join e on e.dst_type = r.type and e.dst_id = r.id
  union select r.key, e.dst_type, e.dst_id from refs r join e on e.src_type = r.type and e.src_id = r.id
  union select key, type, id from refs)"""


@query("J02_one_hop_neighbors", NEIGHBORS)
def j02(spark, sf):
    o = B.orgs(spark, sf).filter("not retired").select(F.concat(F.lit("o"), "id").alias("key"), F.lit("org").alias("type"), "id")
    p = B.people(spark, sf).filter("relation is null").select(F.concat(F.lit("p"), "id").alias("key"), F.lit("person").alias("type"), "id")
    return E.neighbors(o.unionByName(p), B.edges_tiered(spark, sf))


@query(
    "J03_parent_meta_join",
    """select l.doc_id as id, p.title, p.updated_on, p.created_by, p.source, p.derived
       from labels l join pages_state p on p.id = l.doc_id where p.tier <= 1""",
)
def j03(spark, sf):
    refs = table(spark, sf, "labels").select(F.lit("page").alias("type"), F.col("doc_id").alias("id"))
    nodes = B.pages_state(spark, sf).withColumn("type", F.lit("page"))
    return E.parent_meta(refs, nodes).select("id", "title", "updated_on", "created_by", "source", "derived")


@query(
    "J05_phantom_person_candidates",
    """
with org_low as (select lower(canonical_name) as low from orgs where not retired
                 union select lower(a.alias) from org_aliases a join orgs o using (id) where not o.retired)
select p.id, p.canonical_name,
       exists (select 1 from org_low where low = lower(p.canonical_name))
       or exists (select 1 from person_aliases a join org_low on low = lower(a.alias) where a.id = p.id) as name_match,
       p.relation is not null or exists (select 1 from interactions i where i.person_id = p.id) as has_human_signal
from people p""",
)
def j05(spark, sf):
    return E.phantom_people(
        B.people(spark, sf), B.person_aliases(spark, sf), B.orgs(spark, sf), B.org_aliases(spark, sf), B.interactions(spark, sf)
    )


@query(
    "J06_pairs_sharing_entity",
    """
with m as (select distinct l_partkey as entity, l_orderkey as member from lineitem)
select * from (select entity, member, count(*) over (partition by entity) as group_size from m) where group_size > 1""",
)
def j06(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("member"))
    return E.groups_sharing(li)


@query(
    "J08_resolve_entity",
    """
with asked as (select distinct lower(name) as name from (select c_name as name from customer union all select s_name from supplier
                                                         union all select 'Cust ' || c_custkey::varchar from customer
                                                         union all select n_name from nation)),
allnames as (select lower(name) as low, 0 as o, 'person' as type, id from lexicon where type = 'person'
             union all select lower(l.name), 1, 'org', l.id from lexicon l join orgs g on g.id = l.id where l.type = 'org' and not g.retired)
select name, arg_min(type, (o, id)) as type, arg_min(id, (o, id)) as id from asked join allnames on low = name group by name""",
)
def j08(spark, sf):
    c, s, n = (table(spark, sf, t) for t in ("customer", "supplier", "nation"))
    asked = (
        c.select(F.lower("c_name").alias("name"))
        .union(s.select(F.lower("s_name")))
        .union(c.select(F.concat(F.lit("cust "), "c_custkey")))
        .union(n.select(F.lower("n_name")))
    )
    live = B.orgs(spark, sf).filter("not retired")
    org_names = E.names(live, B.org_aliases(spark, sf).join(live.select("id"), "id", "left_semi"))
    return E.resolve(asked, E.names(B.people(spark, sf), B.person_aliases(spark, sf)), org_names)


TITLED = """
  select e.edge_id, e.src_type, e.src_id, e.rel, e.dst_type, e.dst_id, s.title as src_title, d.title as dst_title
  from edges e left join (select * from nodes where tier <= 1) s on s.type = e.src_type and s.id = e.src_id
  left join (select * from nodes where tier <= 1) d on d.type = e.dst_type and d.id = e.dst_id"""


@query("J09_edge_titles", TITLED)
def j09(spark, sf):
    e = E.with_titles(B.edges(spark, sf), B.nodes(spark, sf))
    return e.select("edge_id", "src_type", "src_id", "rel", "dst_type", "dst_id", "src_title", "dst_title")


@query(
    "J10_edges_around",
    """
with e as (select * from edges_tiered where tier <= 1),
b as (select src_type as node_type, src_id as node_id, edge_id, created_on from e
      union select dst_type, dst_id, edge_id, created_on from e),
r as (select *, row_number() over (partition by node_type, node_id order by created_on desc, edge_id) as rn from b)
select node_type, node_id, edge_id, rn::integer as rn from r where rn <= 20""",
)
def j10(spark, sf):
    return E.edges_around(B.edges_tiered(spark, sf)).select("node_type", "node_id", "edge_id", "rn")


@query(
    "J07_open_items_for_person",
    """
select p.id as person_id, 'commitment' as kind, c.id as item_id, c.due from people p
join commitments c on c.status = 'open' and lower(c.to_whom) = lower(p.canonical_name) and c.tier <= 1
union all
select p.id, 'task', t.id, t.due from people p
join tasks t on t.status in ('inbox', 'active', 'waiting') and t.tier <= 1
  and contains(lower(t.title), 'cust ' || p.id::varchar)
  and starts_with(split_part(t.title, 'cust ', 2), p.id::varchar)""",
)
def j07(spark, sf):
    from ..operators.state import open_items

    who = B.people(spark, sf).select(
        F.col("id").alias("person_id"), F.col("canonical_name").alias("to_whom"), F.concat(F.lit("Cust "), F.col("id")).alias("in_title")
    )
    return open_items(who, B.commitments(spark, sf), B.tasks(spark, sf))


@query(
    "T03_recent_interactions",
    """select person_id, id, occurred_on, rn::integer as rn from (
         select *, row_number() over (partition by person_id order by occurred_on desc, id desc) as rn from interactions)
       where rn <= 20""",
)
def t03(spark, sf):
    return E.recent_interactions(B.interactions(spark, sf), "person_id").select("person_id", "id", "occurred_on", "rn")


@query("U01_name_union", "select id, canonical_name as name from people union select id, alias from person_aliases")
def u01(spark, sf):
    return E.names(B.people(spark, sf), B.person_aliases(spark, sf))


@query("A10_names_per_entity", "select type, id, name, count(*) over (partition by type, id) as names from lexicon")
def a10(spark, sf):
    lex = lexicon(spark, sf)
    return lex.join(lex.groupBy("type", "id").agg(F.count(F.lit(1)).alias("names")), ["type", "id"]).select("type", "id", "name", "names")


def repeated_edges(spark, sf):
    """Edges at line grain, so that equal ones repeat."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.lit("interaction").alias("src_type"), F.col("l_orderkey").alias("src_id"), F.lit("mentions").alias("rel"),
        F.lit("org").alias("dst_type"), F.col("l_suppkey").alias("dst_id"),
        F.concat(F.col("l_orderkey"), F.lit("/"), F.col("l_linenumber"), F.lit("/"), F.col("l_partkey")).alias("edge_id"),
        F.to_date("l_shipdate").alias("created_on"),
    )


@query(
    "W06_dedupe_edges_keep_oldest",
    """select l_orderkey as src_id, l_suppkey as dst_id,
              arg_min(l_orderkey::varchar || '/' || l_linenumber::varchar || '/' || l_partkey::varchar,
                      (l_shipdate::date, l_orderkey::varchar || '/' || l_linenumber::varchar || '/' || l_partkey::varchar)) as edge_id,
              min(l_shipdate)::date as created_on
       from lineitem group by 1, 2""",
)
def w06(spark, sf):
    return E.dedupe_edges(repeated_edges(spark, sf)).select("src_id", "dst_id", "edge_id", "created_on")


@query(
    "G04_known_entity_mentions",
    """
with lex as (select id, name from (select r_regionkey as id, lower(r_name) as name from region
             union all select 100 + p_partkey, split_part(p_name, ' ', 1) from part union all select 9000, 'in the'
             union all select 9001, 'of the' union all select 9002, 'the th' union all select 9003, 'den')
             where length(name) >= 3)
select doc_id as text_id, id from (select doc_id, '|' || regexp_replace(lower(text), '[^\\p{L}\\p{N} ]', '|', 'g') || '|' as t from documents)
join (select distinct id, name from lex) on contains(t, ' ' || name || ' ') or contains(t, ' ' || name || '|')
  or contains(t, '|' || name || ' ') or contains(t, '|' || name || '|')""",
)
def g04(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.lower("r_name").alias("name"))
    p = table(spark, sf, "part").select((F.lit(100) + F.col("p_partkey")).alias("id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"))
    extra = spark.createDataFrame([(9000, "in the"), (9001, "of the"), (9002, "the th"), (9003, "den")], "id bigint, name string")
    lex = r.unionByName(p).unionByName(extra).withColumn("type", F.lit("org"))
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return E.known_mentions(texts, lex).select("text_id", "id")


@query(
    "G08_retype_org_to_person",
    """
with map as (select id as org_id, id as person_id from orgs where id % 2 = 0),
m as (select case when sm.person_id is not null then 'person' else src_type end as src_type, coalesce(sm.person_id, src_id) as src_id, rel,
             case when dm.person_id is not null then 'person' else dst_type end as dst_type, coalesce(dm.person_id, dst_id) as dst_id,
             edge_id, created_on
      from edges left join map sm on src_type = 'org' and src_id = sm.org_id left join map dm on dst_type = 'org' and dst_id = dm.org_id),
k as (select * from m where not (src_type = 'person' and dst_type = 'person' and src_id = dst_id)),
t as (select *, (src_type = 'person' and src_id in (select person_id from map)) or (dst_type = 'person' and dst_id in (select person_id from map)) as touched from k),
r as (select *, row_number() over (partition by src_type, src_id, rel, dst_type, dst_id order by created_on, edge_id) as rn from t)
select edge_id, src_type, src_id, rel, dst_type, dst_id from r where rn = 1 or not touched""",
)
def g08(spark, sf):
    m = B.orgs(spark, sf).filter("id % 2 = 0").select(F.col("id").alias("org_id"), F.col("id").alias("person_id"))
    return E.retype_orgs(B.edges(spark, sf), m).select("edge_id", "src_type", "src_id", "rel", "dst_type", "dst_id")


cte(
    "retype_map",
    """
  select a.org_id, a.relation, a.reason, o.canonical_name, case when o.id is null then 'unknown' when k.id is not null then 'reused' else 'created' end as outcome,
         case when o.id is not null then coalesce(k.id, 'person-' || substr(sha256(lower(o.canonical_name)), 1, 16)) end as person_id
  from (select s_suppkey::varchar as org_id, case when s_suppkey % 4 = 0 then 'friend' end as relation, case when s_suppkey % 6 = 0 then 'a person' end as reason from supplier where s_suppkey % 2 = 0
        union all select (s_suppkey + 1000000)::varchar, null, null from supplier where s_suppkey % 50 = 0) a
  left join orgs o on o.id::varchar = a.org_id
  left join (select low, min(id) as id from (select lower(canonical_name) as low, id::varchar as id from people union all select lower(alias), id::varchar from person_aliases) group by low) k on k.low = lower(o.canonical_name)""",
)
cte(
    "retyped_edges",
    """
  with m as (
    select case when sm.person_id is not null then 'person' else src_type end as src_type, coalesce(sm.person_id, src_id::varchar) as src_id, rel,
           case when dm.person_id is not null then 'person' else dst_type end as dst_type, coalesce(dm.person_id, dst_id::varchar) as dst_id, edge_id, created_on
    from edges left join retype_map sm on src_type = 'org' and src_id::varchar = sm.org_id and sm.person_id is not null
    left join retype_map dm on dst_type = 'org' and dst_id::varchar = dm.org_id and dm.person_id is not null),
  k as (select * from m where not (src_type = 'person' and dst_type = 'person' and src_id = dst_id)),
  t as (select *, (src_type = 'person' and src_id in (select person_id from retype_map)) or (dst_type = 'person' and dst_id in (select person_id from retype_map)) as touched from k),
  r as (select *, row_number() over (partition by src_type, src_id, rel, dst_type, dst_id order by created_on, edge_id) as rn from t)
  select edge_id, src_type, src_id, rel, dst_type, dst_id from r where rn = 1 or not coalesce(touched, false)""",
)


def retyped(spark, sf):
    """Every other supplier turns out to be a person; some of those asked about do not exist."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    asked = s.filter(k % 2 == 0).select(k.alias("org_id"), F.when(k % 4 == 0, "friend").alias("relation"), F.when(k % 6 == 0, "a person").alias("reason"))
    ghosts = s.filter(k % 50 == 0).select((k + 1000000).alias("org_id"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("reason"))
    now = F.lit(TODAY).cast("date")
    return E.retype(B.people(spark, sf), B.person_aliases(spark, sf), B.orgs(spark, sf), B.org_aliases(spark, sf), B.edges(spark, sf), asked.unionByName(ghosts), now)


@query(
    "G08_retype_mapping",
    """
select org_id, person_id, outcome, case when outcome <> 'unknown' then coalesce(n, 0) end as edges from retype_map left join (
  select id, count(*) as n from (select edge_id, src_id as id from retyped_edges where src_type = 'person' union select edge_id, dst_id from retyped_edges where dst_type = 'person') group by id) on id = person_id""",
)
def g08_mapping(spark, sf):
    return retyped(spark, sf).mapping


@query("G08_retyped_edges", "select * from retyped_edges")
def g08_edges(spark, sf):
    return retyped(spark, sf).edges.select("edge_id", "src_type", "src_id", "rel", "dst_type", "dst_id")


@query(
    "G08_retyped_people",
    """
with g as (select person_id, arg_min(canonical_name, org_id) as n, max(relation) as relation, min(org_id) as org_id from retype_map where outcome <> 'unknown' group by 1)
select coalesce(p.id::varchar, g.person_id) as id, coalesce(p.canonical_name, g.n) as canonical_name, coalesce(p.relation, g.relation) as relation, g.org_id as supersedes_id
from people p full join g on g.person_id = p.id::varchar""",
)
def g08_people(spark, sf):
    return retyped(spark, sf).people


@query(
    "G08_retyped_aliases",
    """
select id::varchar as id, alias from person_aliases union select person_id, canonical_name from retype_map where outcome <> 'unknown'
union select person_id, a.alias from retype_map m join org_aliases a on a.id::varchar = m.org_id where outcome <> 'unknown'""",
)
def g08_aliases(spark, sf):
    return retyped(spark, sf).person_aliases


@query(
    "G08_retyped_orgs",
    """
select o.id::varchar as id, o.canonical_name, o.tier, o.retired or m.org_id is not null as retired, case when m.org_id is not null then date '2001-06-15' end as retired_on,
       case when m.org_id is not null then coalesce(m.reason, 'retyped to person') end as retired_reason
from orgs o left join retype_map m on m.org_id = o.id::varchar""",
)
def g08_orgs(spark, sf):
    return retyped(spark, sf).orgs


@query(
    "G09_relation_answers",
    """
with q as (select n_nationkey::bigint as query_id, s_suppkey, s_name, r_name from nation join supplier on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
named as (select distinct query_id, s_suppkey as id from q),
e as (select src_type, src_id, dst_id from edges_tiered where tier <= 1 and dst_type = 'org' and rel = 'works_at'),
around as (select query_id, 'person' as type, src_id as id from named join e on dst_id = id union select query_id, 'org', id from named),
answers as (select query_id, n.title as name from around a join nodes n on n.type = a.type and n.id = a.id and n.tier <= 1),
expected as (select query_id, 'customer#' || lpad((s_suppkey * 10)::varchar, 9, '0') as expect from q)
select query_id, count(*) as expected, count(*) filter (where found) as found, bool_and(found) as ok from (
  select x.query_id, x.expect, exists (select 1 from answers a where a.query_id = x.query_id and contains(lower(a.name), lower(x.expect))) as found
  from (select distinct query_id, expect from expected) x) group by 1""",
)
def g09(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    ask = rows.select(
        F.col("n_nationkey").cast("bigint").alias("query_id"), F.concat(F.lit("who works at "), "s_name", F.lit("?")).alias("query"),
        F.concat(F.lit("customer#"), F.lpad((F.col("s_suppkey") * 10).cast("string"), 9, "0")).alias("expect"),
    )
    # several questions per nation: each is searched on its own and the answers pool by nation
    each = ask.withColumn("qid", F.concat_ws("|", F.col("query_id").cast("string"), "query"))
    lex = E.names(B.orgs(spark, sf), B.org_aliases(spark, sf)).withColumn("type", F.lit("org"))
    edges = B.edges_tiered(spark, sf).filter("rel = 'works_at'")
    ans = E.relation_answers(each.select(F.col("qid").alias("query_id"), "query"), lex, edges, B.nodes(spark, sf))
    pooled = ans.select(F.split_part("query_id", F.lit("|"), F.lit(1)).cast("bigint").alias("query_id"), "name").distinct()
    return E.answer_check(pooled, ask.select("query_id", "expect").distinct())
