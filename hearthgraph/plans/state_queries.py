"""F04, F07, F08, J07, J11-J15, M*, D*, U02, X10, X11, X13 on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import capture as P
from ..functions import clock
from ..operators import captures as K
from ..operators import curation as D
from ..operators import entities as E
from ..operators import state as S
from ..session import table
from . import bindings as B
from .bindings import TODAY
from .registry import cte, query

NOW = "2001-06-15 08:00:00"
today = lambda: F.lit(TODAY).cast("date")


def calendar(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("id"),
        F.col("l_shipdate").cast("timestamp").alias("starts_at"), F.lit(1).alias("tier"),
    )


@query(
    "F07_state_windows",
    f"""
select 'calendar' as section, l_orderkey::varchar || '-' || l_linenumber::varchar || '-' || l_partkey::varchar as id, l_shipdate::date as at_day
from lineitem where l_shipdate >= timestamp '{NOW}' - interval 1 hour and l_shipdate < timestamp '{NOW}' + interval 2 days
union all select 'tasks_due', id::varchar, due from tasks where status in ('inbox', 'active', 'waiting') and due <= date '{TODAY}' and tier <= 1
union all select 'commitments_open', id::varchar, due from commitments where status = 'open' and tier <= 1
union all select 'decision_reviews_due', id::varchar, review_on from decisions
  where reviewed_on is null and tier <= 1 and (review_on <= date '{TODAY}' + 3 or choice is null)
union all select 'moved_today', id::varchar, updated_on from tasks where status in ('done', 'dropped') and updated_on = date '{TODAY}' and tier <= 1""",
)
def f07(spark, sf):
    text_id = lambda df: df.withColumn("id", F.col("id").cast("string"))
    return S.state_now(
        calendar(spark, sf), text_id(B.tasks(spark, sf)), text_id(B.commitments(spark, sf)), text_id(B.decisions(spark, sf)),
        F.lit(NOW).cast("timestamp"), today(),
    )


@query(
    "F08_agenda_range",
    f"""select due, id, title, status, count(*) over (partition by due) as day_total from tasks
        where status in ('inbox', 'active', 'waiting') and due between date '{TODAY}' and date '{TODAY}' + 7 and tier <= 1""",
)
def f08(spark, sf):
    return S.agenda(B.tasks(spark, sf), today(), F.date_add(today(), 7))


@query(
    "M01_task_merge",
    """
with each as (select o_orderkey as id, case when o_orderkey % 4 = 0 then 'renamed ' || o_orderkey::varchar end as title,
                     case when o_orderkey % 6 = 0 then 'done' end as status, null::date as due, 1 as arrived from orders where o_orderkey % 2 = 0
              union all select o_orderkey, 'again ' || o_orderkey::varchar, case when o_orderkey % 20 = 0 then 'waiting' end, case when o_orderkey % 30 = 0 then o_orderdate::date + 7 end, 2
              from orders where o_orderkey % 10 = 0
              union all select o_orderkey + 100000000, 'ghost', 'done', null, 1 from orders where o_orderkey % 500 = 1),
changes as (select id, arg_max(title, arrived) filter (title is not null) as title, arg_max(status, arrived) filter (status is not null) as status,
                   arg_max(due, arrived) filter (due is not null) as due, coalesce(bool_or(status = 'done'), false) as was_done from each group by id),
fresh as (select 'new-' || o_orderkey::varchar as key, 'New from ' || o_orderkey::varchar as title,
                 case when o_orderkey % 3 = 0 then 'done' end as status, o_orderdate::date as due from orders where o_orderkey % 700 = 3)
select coalesce(b.id, c.id) as id, null::varchar as new_key, coalesce(c.title, b.title) as title, coalesce(c.status, b.status) as status,
       coalesce(c.due, b.due) as due, case when c.was_done then date '2001-06-15' end as completed_on,
       case when b.id is null then 'rejected' when c.id is not null then 'updated' else 'kept' end as outcome
from tasks b full join changes c on b.id = c.id
union all
select null, key, title, coalesce(status, 'inbox'), due, case when status = 'done' then date '2001-06-15' end, 'inserted' from fresh""",
)
def m01(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    no_date = F.lit(None).cast("date")
    edits = o.filter(k % 2 == 0).select(
        k.alias("id"), k.cast("string").alias("key"), F.when(k % 4 == 0, F.concat(F.lit("renamed "), k)).alias("title"),
        F.when(k % 6 == 0, "done").alias("status"), no_date.alias("due"), F.lit(1).alias("arrived"),
    )
    later = o.filter(k % 10 == 0).select(
        k.alias("id"), k.cast("string").alias("key"), F.concat(F.lit("again "), k).alias("title"), F.when(k % 20 == 0, "waiting").alias("status"),
        F.when(k % 30 == 0, F.date_add(F.to_date("o_orderdate"), 7)).alias("due"), F.lit(2).alias("arrived"),
    )
    ghosts = o.filter(k % 500 == 1).select(
        (k + 100000000).alias("id"), k.cast("string").alias("key"), F.lit("ghost").alias("title"), F.lit("done").alias("status"), no_date.alias("due"), F.lit(1).alias("arrived")
    )
    fresh = o.filter(k % 700 == 3).select(
        F.lit(None).cast("bigint").alias("id"), F.concat(F.lit("new-"), k).alias("key"), F.concat(F.lit("New from "), k).alias("title"),
        F.when(k % 3 == 0, "done").alias("status"), F.to_date("o_orderdate").alias("due"), F.lit(1).alias("arrived"),
    )
    base = B.tasks(spark, sf).withColumn("completed_on", no_date)
    return S.merge_tasks(base, edits.unionByName(later).unionByName(ghosts).unionByName(fresh), today())


def options(spark, sf):
    """Decisions with their shipping flags as options; the choice is the smallest one."""
    b = B.branches(spark, sf)
    return b.groupBy(F.col("decision_id").alias("id")).agg(
        F.when(F.col("id") % 4 != 0, F.min("label")).alias("choice"), F.array_sort(F.collect_set("label")).alias("options")
    )


@query(
    "M02_decision_branches",
    """
with d as (select decision_id as id, case when decision_id % 4 <> 0 then min(label) end as choice from branches group by 1),
explicit as (select decision_id, label, case when label = 'way R' then 'rejected' end as status from branches where decision_id % 3 = 0)
select decision_id, label, status, case status when 'chosen' then 'chose' else status end as rel from (
  select e.decision_id, e.label, coalesce(e.status, case when e.label = d.choice then 'chosen' end, 'considered') as status
  from explicit e join d on d.id = e.decision_id
  union all
  select b.decision_id, b.label, case when b.label = d.choice then 'chosen' else 'considered' end
  from branches b join d on d.id = b.decision_id where b.decision_id % 3 <> 0)""",
)
def m02(spark, sf):
    given = B.branches(spark, sf).filter("decision_id % 3 = 0").select(
        "decision_id", "label", F.when(F.col("label") == "way R", "rejected").alias("status")
    )
    return S.decision_branches(options(spark, sf), given)


cte(
    "outcomes",
    """
  select o_orderkey as id, 'went as planned' as actual_outcome, case when o_orderkey % 10 = 0 then (o_orderkey % 100)::integer end as score,
         case when o_orderkey % 15 = 0 then 'ship early' end as lesson, 1 as arrived from orders where o_orderkey % 5 = 0 and o_orderstatus = 'P'
  union all
  select o_orderkey, 'came back', case when o_orderkey % 30 = 0 then 7 end, case when o_orderkey % 45 = 0 then 'ask twice' end, 2 from orders where o_orderkey % 15 = 0 and o_orderstatus = 'P'""",
)


def outcomes(spark, sf):
    """What became of decisions; every third is reviewed a second time."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").filter((k % 5 == 0) & (F.col("o_orderstatus") == "P"))
    first = o.select(
        k.alias("id"), F.lit("went as planned").alias("actual_outcome"), F.when(k % 10 == 0, (k % 100).cast("int")).alias("score"),
        F.when(k % 15 == 0, "ship early").alias("lesson"), F.lit(1).alias("arrived"),
    )
    again = o.filter(k % 15 == 0).select(
        k.alias("id"), F.lit("came back").alias("actual_outcome"), F.when(k % 30 == 0, F.lit(7)).alias("score"), F.when(k % 45 == 0, "ask twice").alias("lesson"), F.lit(2).alias("arrived"),
    )
    return first.unionByName(again)


@query(
    "M03_decision_review",
    """
with l as (select id, arg_max(actual_outcome, arrived) as actual_outcome, arg_max(score, arrived) filter (score is not null) as score, count(lesson) as lessons from outcomes group by id)
select d.id, case when l.id is not null then l.actual_outcome else d.actual_outcome end as actual_outcome,
       coalesce(l.score, d.outcome_score) as outcome_score, case when l.id is not null then date '2001-06-15' else d.reviewed_on end as reviewed_on,
       case when lessons > 0 then 'principle-' || d.id::varchar || case when lessons > 1 then '-' || lessons::varchar else '' end end as principle_id
from decisions d left join l using (id)""",
)
def m03(spark, sf):
    after, _, _ = S.review_decisions(B.decisions(spark, sf), outcomes(spark, sf), today())
    return after.select("id", "actual_outcome", "outcome_score", "reviewed_on", "principle_id")


@query(
    "M03_principles",
    """
with l as (select id, lesson, row_number() over (partition by id order by arrived) as n from outcomes where lesson is not null)
select 'principle-' || id::varchar || case when n > 1 then '-' || n::varchar else '' end as id, lesson as rule, id as learned_from from l""",
)
def m03_principles(spark, sf):
    return S.review_decisions(B.decisions(spark, sf), outcomes(spark, sf), today())[1]


@query(
    "M04_interaction_merge",
    """
with new as (select o_orderkey as id, case when o_orderkey % 3 = 0 then 'supplier#' || lpad((o_orderkey % 150)::varchar, 9, '0')
                    when o_orderkey % 3 = 1 then c_name else 'Parcel Company ' || o_orderkey::varchar end as name,
                    case when o_orderkey % 5 = 0 then 'person' end as subject_type, o_custkey, o_orderdate::date as occurred_on
             from orders join customer on c_custkey = o_custkey),
live as (select lower(s_name) as low, s_suppkey as id from supplier where s_acctbal >= 0),
r as (select n.*, l.id as org_id, case when l.id is not null then 'org' when subject_type = 'person' then 'person'
             when regexp_matches(n.name, '(?i)\\bcompany\\b') or regexp_matches(n.name, '(?i)\\bsupplier\\b') then 'org' else 'person' end as subject
      from new n left join live l on l.low = lower(n.name))
select subject, count(*) as interactions, count(org_id) as known_orgs, count(distinct name) as names, max(occurred_on) as last_contact from r group by 1""",
)
def m04(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    k = F.col("o_orderkey")
    name = (
        F.when(k % 3 == 0, F.concat(F.lit("supplier#"), F.lpad((k % 150).cast("string"), 9, "0")))
        .when(k % 3 == 1, F.col("c_name"))
        .otherwise(F.concat(F.lit("Parcel Company "), k))
    )
    new = o.select(k.alias("id"), name.alias("name"), F.when(k % 5 == 0, "person").alias("subject_type"), F.to_date("o_orderdate").alias("occurred_on"))
    live = B.orgs(spark, sf).filter("not retired").select(F.col("canonical_name").alias("name"), "id")
    r = S.route_subject(new, live, P.org_cue(F.col("name")))
    return r.groupBy("subject").agg(
        F.count(F.lit(1)).alias("interactions"), F.count("org_id").alias("known_orgs"), F.countDistinct("name").alias("names"), F.max("occurred_on").alias("last_contact")
    )


# ------------------------------------------------------------------ captures


def own_id(place, source):
    """A number that no other capture has: a text holds fewer than 2^31 lines or turns, and each source has its own remainder."""
    return place.cast("bigint") * 3 + source


def capture_texts(spark, sf):
    """Conversation turns and every line of the documents as captures, with a lead-in that exercises each rule."""
    c = table(spark, sf, "conversations").select(own_id(F.col("conv_id") * (1 << 31) + F.col("turn"), 0).alias("capture_id"), "text")
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    d = d.select(own_id(F.col("doc_id") * (1 << 31) + F.col("pos"), 1).alias("capture_id"), "text")
    p = table(spark, sf, "part").select(
        own_id(F.col("p_partkey"), 2).alias("capture_id"),
        F.concat(F.lit("x"), "p_name", F.lit(" "), F.lower("p_brand"), F.lit(" "), F.lower("p_type")).alias("text"),
    )
    n = F.expr("capture_id div 3") % 12
    lead = (
        F.when(n == 0, "todo: ").when(n == 1, "Met Anna Berg about ").when(n == 2, "Decided: done with ").when(n == 3, "unclear: ")
        .when(n == 4, "Feeling tired, I saw ").when(n == 5, "task pack and ship ").when(n == 6, "called with Vendor Ltd on ").when(n == 7, "Decision: ")
        .when(n == 8, "Task: sort bins and decide whether to keep ").otherwise("")
    )
    tail = F.when(n == 0, " by 2001-07-01").when(n == 5, F.concat(F.lit(" by 1999-01-01"), F.when(F.expr("capture_id div 3") % 24 == 5, " - done").otherwise(""))).otherwise("")
    return c.unionByName(d).unionByName(p).select("capture_id", F.concat(lead, "text", tail).alias("text"))


cte(
    "capture_texts",
    """
  select capture_id, (case (capture_id // 3) % 12 when 0 then 'todo: ' when 1 then 'Met Anna Berg about ' when 2 then 'Decided: done with ' when 3 then 'unclear: '
         when 4 then 'Feeling tired, I saw ' when 5 then 'task pack and ship ' when 6 then 'called with Vendor Ltd on ' when 7 then 'Decision: '
         when 8 then 'Task: sort bins and decide whether to keep ' else '' end) || text
         || (case (capture_id // 3) % 12 when 0 then ' by 2001-07-01' when 5 then ' by 1999-01-01' || case when (capture_id // 3) % 24 = 5 then ' - done' else '' end else '' end) as text
  from (select (conv_id * 2147483648 + turn) * 3 as capture_id, text from conversations
        union all select (doc_id * 2147483648 + pos) * 3 + 1, line from (
          select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents)
        union all select p_partkey * 3 + 2, 'x' || p_name || ' ' || lower(p_brand) || ' ' || lower(p_type) from part)""",
)
cte(
    "capture_lines",
    r"""select capture_id, text, trim(text) as t, lower(trim(text)) as low,
              trim(regexp_replace(split_part(trim(text), chr(10), 1), '^<!--.*?-->\s*', '')) as line from capture_texts""",
)
MET = r"(?i)^(met|call(?:ed)? with|talked to|coffee with|lunch with)"
cte(
    "capture_class",
    rf"""select capture_id, text, line, t, low, type,
       case type || rule when 'unknown1' then 0.2 when 'unknown2' then 0.3 when 'task3' then 0.9 when 'interaction4' then 0.85 when 'decision_note5' then 0.8
            when 'journal6' then 0.8 when 'note7' then 0.75 else 0.4 end::double as confidence,
       case type when 'task' then coalesce(nullif(trim(regexp_replace(line, '(?i)^(todo|task)[:\s]+', '')), ''), line)
                 when 'decision_note' then line when 'note' then substr(line, 1, 80) end as title,
       case when type = 'task' then nullif(regexp_extract(low, '\bby (\d{{4}}-\d{{2}}-\d{{2}})\b', 1), '') end as due,
       case when type = 'interaction' then coalesce(nullif(regexp_extract(line, '(?i)^(?:met|call(?:ed)? with|talked to|coffee with|lunch with)\s+([A-Z][\w''-]+(?:\s[A-Z][\w''-]+)?)', 1), ''), 'Unknown') end as name,
       case when type = 'interaction' then case when regexp_matches(line, '(?i)call') then 'call' else 'meeting' end end as kind,
       case when type = 'interaction' then case when regexp_matches(line, '(?i)\b({P.ORG_CUE})\b') then 'org' else 'person' end end as subject_type
from (select *, case when rule in (1, 2, 8) then 'unknown' when rule = 3 then 'task' when rule = 4 then 'interaction' when rule = 5 then 'decision_note'
                     when rule = 6 then 'journal' else 'note' end as type from (
  select *, case when length(t) < 3 or not regexp_matches(t, '[A-Za-z]') then 1 when starts_with(low, 'unclear:') then 2
       when regexp_matches(line, '(?i)^(todo|task)[:\s]') or regexp_matches(low, '\bremind me\b') then 3
       when regexp_matches(line, '{MET}\b') then 4
       when regexp_matches(line, '(?i)^(decided|decision[:\s])') then 5
       when regexp_matches(low, '\b(today|feeling|grateful|tired|mood)\b') and regexp_matches(low, '\b(i|my|me)\b') then 6
       when length(t) > 40 then 7 else 8 end as rule from capture_lines))""",
)


@query("X10_capture_class", "select capture_id, type, confidence, title, due, name, kind, subject_type from capture_class")
def x10(spark, sf):
    return capture_texts(spark, sf).select("capture_id", P.classify(F.col("text")).alias("c")).select(
        "capture_id", "c.type", "c.confidence", "c.title", "c.due", "c.name", "c.kind", "c.subject_type"
    )


DONE_RE = r"(?i)\b(done|finished|completed?|confirmed|works|worked|working|succeeded|success(?:ful)?|achieved|shipped|resolved|fixed)\b"
SPLIT_RE = r"(?i)^(.*?\S)\s+and\s+(decide|determine)\s+(on|whether|if|between|about|to)\b\s*(.*)$"
cte(
    "capture_split",
    rf"""select *, case when halves then regexp_extract(bare, '{SPLIT_RE}', 1) end as action,
        case when halves then trim(regexp_replace('Decide ' || lower(regexp_extract(bare, '{SPLIT_RE}', 3)) || ' ' || trim(regexp_extract(bare, '{SPLIT_RE}', 4)), '\s+', ' ', 'g')) end as decision
       from (select *, not done and regexp_matches(bare, '{SPLIT_RE}') and length(regexp_extract(bare, '{SPLIT_RE}', 1)) >= 3
                       and not regexp_matches(regexp_extract(bare, '{SPLIT_RE}', 1), '(?i)^(decide|determine|decision)\b') as halves from (
         select *, regexp_matches(text, '{DONE_RE}') as done, trim(regexp_replace(line, '(?i)^(todo|task)[:\s]+', '')) as bare,
                substr(trim(regexp_replace(coalesce(nullif(trim(string_split(regexp_replace(line, '(?i)\s*(?:[.;]|\bbut\b|\bhowever\b|\bneed to\b|\bnote:)', chr(1)), chr(1))[1]), ''), line),
                       '(?i)^(decision|decided)\b[:\s-]*', '')), 1, 120) as done_title from capture_class))""",
)


@query("X11_completion_split", "select capture_id, done, done_title, action, decision from capture_split")
def x11(spark, sf):
    t = F.col("text")
    return capture_texts(spark, sf).select(
        "capture_id", P.completed(t).alias("done"), P.done_title(t).alias("done_title"), P.action_and_decision(t).alias("h")
    ).select("capture_id", "done", "done_title", "h.action", "h.decision")


# ------------------------------------------------------------------ duplicates


def dedup_sets_sql(src: str, out: str) -> None:
    stop = ", ".join(f"'{w}'" for w in K.DEDUP_STOP)
    cte(
        out,
        rf"""select id, due, list_sort(list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower(title), '[''’]s\b', '', 'g'), '[^a-z0-9一-鿿]+', ' ', 'g'), ' '),
             lambda w: length(w) > 1 and not list_contains([{stop}], w)))) as toks from {src}""",
    )


cte(
    "open_parts",
    """select p_partkey as id, p_name || ' ' || lower(p_type) || ' for the ' || lower(p_brand) as title, date '2001-01-01' + (p_size % 10) as due from part where p_partkey % 2 = 0""",
)
cte(
    "new_parts",
    """select p_partkey as id, lower(p_type) || ' ' || p_name || ' event' as title, case when p_size % 4 <> 0 then date '2001-01-01' + (p_size % 10) end as due from part where p_partkey % 2 = 1""",
)
dedup_sets_sql("open_parts", "open_sets")
dedup_sets_sql("new_parts", "new_sets")


def open_parts(spark, sf):
    p = table(spark, sf, "part").filter("p_partkey % 2 = 0")
    due = F.date_add(F.lit("2001-01-01").cast("date"), F.col("p_size") % 10)
    return p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" for the "), F.lower("p_brand")).alias("title"), due.alias("due"))


def new_parts(spark, sf):
    p = table(spark, sf, "part").filter("p_partkey % 2 = 1")
    due = F.when(F.col("p_size") % 4 != 0, F.date_add(F.lit("2001-01-01").cast("date"), F.col("p_size") % 10))
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lower("p_type"), F.lit(" "), "p_name", F.lit(" event")).alias("title"), due.alias("due"))


@query(
    "J14_duplicate_titles",
    """
with p as (select n.id as new_id, o.id as open_id, len(list_intersect(n.toks, o.toks))::double / least(len(n.toks), len(o.toks)) as score
           from new_sets n, open_sets o where len(n.toks) > 0 and len(o.toks) > 0
             and (n.due is null or o.due is null or abs(date_diff('day', n.due, o.due)) <= 3))
select new_id, arg_max(open_id, (score, open_id)) as open_id, round(max(score), 3) as score from p where score >= 0.5 group by new_id""",
)
def j14(spark, sf):
    return K.duplicate_titles(new_parts(spark, sf), open_parts(spark, sf))


@query(
    "M05_route_captures",
    """
with open_t as (select p_partkey as id, 'pack and ship x' || p_name || ' ' || lower(p_brand) as title, null::date as due from part where p_partkey % 3 = 0),
os as (select id, list_distinct(list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9一-鿿]+', ' ', 'g'), ' '), lambda w: length(w) > 1 and not list_contains([DSTOP], w))) as toks from open_t),
og as (select toks, max(id) as id from (select id, list_sort(toks) as toks from os) group by toks),
ns as (select capture_id, list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower(title), '[''’]s\\b', '', 'g'), '[^a-z0-9一-鿿]+', ' ', 'g'), ' '), lambda w: length(w) > 1 and not list_contains([DSTOP], w))) as toks
       from capture_class where type = 'task'),
dup as (select capture_id, arg_max(id, (score, id)) as open_id from (
          select n.capture_id, o.id, len(list_intersect(n.toks, o.toks))::double / least(len(n.toks), len(o.toks)) as score from ns n, og o where len(n.toks) > 0) where score >= 0.5 group by 1),
c as (select s.*, d.open_id, s.confidence >= 0.7 and s.type <> 'unknown' as ok from capture_split s left join dup d using (capture_id)),
rows as (
  select capture_id, 0 as part, 'review_queue' as target, 'unfiled' as action, null as title, 1 as tier, null as status, null::bigint as ref from c where not ok
  union all select capture_id, 0, case when done then 'tasks' else 'review_queue' end, case when done then 'close' else 'duplicate' end,
                   case when done then null else title end, 1, case when done then 'done' end, open_id from c where ok and type = 'task' and open_id is not null
  union all select capture_id, 0, 'tasks', 'insert', case when halves then substr(action, 1, 200) else title end, 1, case when done and not halves then 'done' else 'inbox' end, null
            from c where ok and type = 'task' and open_id is null
  union all select capture_id, 1, 'decisions', 'split', decision, 1, null, null from c where ok and type = 'task' and open_id is null and halves
  union all select capture_id, 0, 'journal_entries', 'insert', null, 2, null, null from c where ok and type = 'journal'
  union all select capture_id, 0, 'interactions', 'insert', name, 2, subject_type, null from c where ok and type = 'interaction'
  union all select capture_id, 0, 'decisions', 'insert', title, 1, null, null from c where ok and type = 'decision_note'
  union all select capture_id, 1, 'tasks', 'split', coalesce(nullif(done_title, ''), line), 1, 'done', null from c where ok and type = 'decision_note' and done
  union all select capture_id, 0, 'pages', 'insert', title, 1, null, null from c where ok and type = 'note')
select r.capture_id, part::integer as part, target, r.action, r.title, tier::integer as tier, status, ref,
       case when c.due is not null and c.due >= '2001-06-15' then try_cast(c.due as date) end as due_day
from rows r join c using (capture_id)""".replace("DSTOP", ", ".join(f"'{w}'" for w in K.DEDUP_STOP)),
)
def m05(spark, sf):
    return routed(spark, sf, capture_texts(spark, sf))


def routed(spark, sf, captures, folder=None):
    p = table(spark, sf, "part").filter("p_partkey % 3 = 0")
    open_t = p.select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("pack and ship x"), "p_name", F.lit(" "), F.lower("p_brand")).alias("title"), F.lit(None).cast("date").alias("due")
    )
    orgs = B.orgs(spark, sf).select(F.col("canonical_name").alias("name"))
    return K.route(captures, open_t, orgs, today(), folder).select("capture_id", "part", "target", "action", "title", "tier", "status", "ref", "due_day")


# ------------------------------------------------------------------ curation


def known_people(spark, sf):
    last = B.interactions(spark, sf).groupBy(F.col("person_id").alias("id")).agg(F.max("occurred_on").alias("last_contact"))
    return B.people(spark, sf).join(last, "id", "left")


cte(
    "stale",
    f"""
  select 'page' as type, id, title as label, updated_on from pages_state where updated_on < date '2024-12-01' - 180
  union all
  select 'person', p.id, canonical_name, updated_on from people p left join (select person_id, max(occurred_on) as lc from interactions group by 1) i on i.person_id = p.id
  where coalesce(lc, updated_on) < date '{TODAY}' - 180""",
)


def stale(spark, sf):
    pages = B.pages_state(spark, sf).withColumn("status", F.lit("active"))
    none = known_people(spark, sf).limit(0)
    a = D.stale_items(pages, none, F.lit("2024-12-01").cast("date"))
    return a.unionByName(D.stale_items(pages.limit(0), known_people(spark, sf), today()))


@query("U02_stale_items", "select type, id, label, updated_on from stale")
def u02(spark, sf):
    return stale(spark, sf)


def prior_queue(spark, sf):
    """Items of an earlier night: every fifth document and order is queued already, some of them closed."""
    d = table(spark, sf, "documents").filter("doc_id % 5 = 0").select(
        F.lit("stale").alias("kind"), F.concat(F.lit("page:"), "doc_id").alias("key"), F.when(F.col("doc_id") % 10 == 0, "open").otherwise("resolved").alias("status")
    )
    o = table(spark, sf, "orders").filter("o_orderkey % 5 = 0").select(
        F.lit("decision_review").alias("kind"), F.col("o_orderkey").cast("string").alias("key"), F.lit("open").alias("status")
    )
    return d.unionByName(o)


@query("D04_stale_flags", "select type, id, label from stale where not (type = 'page' and id % 10 = 0)")
def d04(spark, sf):
    s = stale(spark, sf).withColumn("key", F.concat_ws(":", "type", F.col("id").cast("string")))
    return D.not_queued(s, prior_queue(spark, sf), "stale", "key").select("type", "id", "label")


@query(
    "D05_decision_review_flags",
    f"select id, question, review_on from decisions where review_on <= date '{TODAY}' and reviewed_on is null and id % 5 <> 0",
)
def d05(spark, sf):
    d = D.decision_reviews(B.decisions(spark, sf), today()).withColumn("key", F.col("id").cast("string"))
    return D.not_queued(d, prior_queue(spark, sf), "decision_review", "key").select("id", "question", "review_on")


@query(
    "D06_phantom_person_flags",
    """
with org_low as (select lower(canonical_name) as low from orgs where not retired),
p as (select c_custkey as id, c_name || case when c_custkey % 7 = 0 then ' Ltd' else '' end as canonical_name, c_acctbal >= 0 as has_relation from customer),
k as (select p.*, exists (select 1 from person_aliases a join org_low on low = lower(a.alias) where a.id = p.id) as name_match,
             has_relation or exists (select 1 from orders where o_custkey = p.id and o_orderpriority = '1-URGENT') as human from p)
select id, canonical_name, case when name_match then 'shares a name with an organisation' else 'named like a company, without human signal' end as reason
from k where name_match or (not human and regexp_matches(canonical_name, '(?i)\\b(ltd)\\b'))""",
)
def d06(spark, sf):
    p = B.people(spark, sf).withColumn("canonical_name", F.concat("canonical_name", F.when(F.col("id") % 7 == 0, " Ltd").otherwise("")))
    met = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("person_id"))
    no_alias = B.org_aliases(spark, sf)
    return D.phantom_flags(E.phantom_people(p, B.person_aliases(spark, sf), B.orgs(spark, sf), no_alias, met))


def claims(spark, sf):
    """Orders' line comments as claims about the part they share."""
    li = table(spark, sf, "lineitem")
    text = F.when(F.col("l_returnflag") == "A", "it Always fits").when(F.col("l_returnflag") == "R", "it never fits").otherwise("loves it")
    text = F.concat(text, F.when(F.col("l_linenumber") == 1, " but hates the box").otherwise(""))
    return li.select(
        F.col("l_partkey").alias("entity"),
        (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("chunk_id"), text.alias("text"),
    )


@query(
    "D01_contradiction_scan",
    """
with c as (select l_partkey as entity, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey as chunk_id, l_returnflag as f, l_linenumber = 1 as ha from lineitem),
s as (select distinct entity, chunk_id, 0 as claim, case f when 'A' then 0 else 1 end as side from c where f in ('A', 'R')
      union select entity, chunk_id, 1, 0 from c where f not in ('A', 'R') union select entity, chunk_id, 1, 1 from c where ha)
select x.entity, x.claim, x.side, x.chunk_id from s x
where exists (select 1 from s y where y.entity = x.entity and y.claim = x.claim and y.side <> x.side
              and (y.chunk_id <> x.chunk_id or exists (select 1 from s z where z.entity = x.entity and z.claim = x.claim and z.chunk_id <> x.chunk_id)))
  and not (x.entity % 10 = 3 and x.claim = 0)""",
)
def d01(spark, sf):
    c = claims(spark, sf)
    part = F.col("p_partkey")
    queue = table(spark, sf, "part").select(
        F.lit("contradiction").alias("kind"), part.alias("entity"), F.lit(0).alias("claim"), F.when(part % 10 == 3, "open").otherwise("dismissed").alias("status")
    )
    return D.contradictions(c, c.select("chunk_id", "text").distinct(), queue)


def mention_edges(spark, sf):
    """Pages mention the customer their id falls on; every fourth such page is a note itself."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("parent_id"), (F.col("doc_id") % 40).alias("person_id"), F.expr("date_add(date'2024-02-01', cast(doc_id % 300 as int))").alias("created_on")
    )


def named_chunks(spark, sf):
    """Line chunks; a chunk with a line number not divisible by three spells out the person."""
    c = B.line_chunks(spark, sf)
    return c.withColumn("text", F.when(F.col("ord") % 3 != 0, F.concat(F.lit("CUST "), F.col("parent_id") % 40, F.lit(" wrote: "), "text")).otherwise(F.col("text")))


def generated(spark, sf):
    return table(spark, sf, "documents").filter("source = 'src3'").select(F.col("doc_id").alias("parent_id"))


cte(
    "mention_edges",
    "select doc_id as parent_id, doc_id % 40 as person_id, date '2024-02-01' + (doc_id % 300)::integer as created_on from documents where source <> 'src3'",
)
cte(
    "named_chunks",
    """select chunk_id, parent_id, ord, tier, updated_on,
              case when ord % 3 <> 0 then 'CUST ' || (parent_id % 40)::varchar || ' wrote: ' || text else text end as text from line_chunks""",
)
cte(
    "note_cand",
    """select person_id, count(distinct chunk_id) as chunk_count, max(tier) as max_tier, max(created_on) as latest_mention
       from mention_edges join named_chunks using (parent_id) group by 1 having count(distinct chunk_id) >= 3""",
)
cte(
    "note_src",
    """select distinct m.person_id, c.* from mention_edges m join named_chunks c using (parent_id)
       join lexicon_people n on n.id = m.person_id and contains(lower(c.text), lower(n.name))""",
)
cte("lexicon_people", "select id, canonical_name as name from people union select id, alias from person_aliases")


@query("J11_note_candidates", "select person_id, canonical_name as name, chunk_count, max_tier, latest_mention from note_cand join people on id = person_id")
def j11(spark, sf):
    c = D.note_candidates(mention_edges(spark, sf), named_chunks(spark, sf), B.people(spark, sf), generated(spark, sf))
    return c.select("person_id", "name", "chunk_count", "max_tier", "latest_mention")


def person_names(spark, sf):
    return E.names(B.people(spark, sf), B.person_aliases(spark, sf))


@query("J12_note_sources", "select person_id, chunk_id, parent_id, tier from note_src")
def j12(spark, sf):
    s = D.note_sources(mention_edges(spark, sf), named_chunks(spark, sf), person_names(spark, sf), generated(spark, sf))
    return s.select("person_id", "chunk_id", "parent_id", "tier")


@query(
    "D02_compile_notes",
    r"""
with s as (select *, trim(string_split(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(text, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`#>]+', '', 'g'), '\s+', ' ', 'g')),
                     '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1]) as sentence from note_src),
f as (select person_id, lower(sentence) as low, arg_min(sentence, (updated_on, ord, chunk_id)) as sentence, min((updated_on, ord, chunk_id)) as k
      from s where length(sentence) >= 8 group by 1, 2),
l as (select person_id, string_agg(sentence, ' ' order by k) as lines from f group by 1),
t as (select person_id, max(tier) as tier, count(*) as sources, arg_min(parent_id, (updated_on, ord, chunk_id)) as derived_from from s group by 1),
n as (select c.person_id, c.max_tier, c.latest_mention, p.canonical_name || ': ' || coalesce(lines, '') as raw, t.tier, t.sources, t.derived_from,
             'derived/notes/person/' || substr(regexp_replace(regexp_replace(lower(canonical_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', ''), 1, 60) || '.md' as path,
             case when c.person_id % 4 = 0 then case when c.person_id % 8 = 0 then date '2024-12-31' else date '2024-01-01' end end as note_on
      from note_cand c join people p on p.id = c.person_id left join t using (person_id) left join l using (person_id)),
b as (select *, case when len(string_split_regex(trim(raw), '\s+')) <= 300 then trim(raw)
                     else array_to_string(string_split_regex(trim(raw), '\s+')[1:300], ' ') || ' …' end as body,
             case when note_on >= latest_mention or coalesce(sources, 0) < 3 then 'skipped' when note_on is not null then 'updated' else 'created' end as status from n)
select person_id, path, status, case when status <> 'skipped' then body end as body, coalesce(tier, max_tier) as tier, sources, derived_from from b""",
)
def d02(spark, sf):
    m, c, n, g = mention_edges(spark, sf), named_chunks(spark, sf), person_names(spark, sf), generated(spark, sf)
    cand = D.note_candidates(m, c, B.people(spark, sf), g)
    had = B.people(spark, sf).filter("id % 4 = 0").select(
        F.concat(F.lit("derived/notes/person/"), F.regexp_replace(F.lower("canonical_name"), "[^a-z0-9]+", "-"), F.lit(".md")).alias("path"),
        F.when(F.col("id") % 8 == 0, F.lit("2024-12-31")).otherwise(F.lit("2024-01-01")).cast("date").alias("updated_on"), F.lit("old").alias("body_hash"),
    )
    return D.compile_notes(cand, D.note_sources(m, c, n, g), had)


def transcripts(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.to_date("l_shipdate")).alias("updated_on")).select(
        F.col("l_orderkey").alias("decision_id"), F.col("l_linenumber").alias("ord"), "updated_on", F.lit(1).alias("tier")
    )


cte(
    "transcripts",
    "select l_orderkey as decision_id, l_linenumber as ord, min(l_shipdate)::date as updated_on, 1 as tier from lineitem group by 1, 2",
)


def digest_pages(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderkey % 3 <> 0")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("decision_id"), F.when(k % 7 == 0, "deleted").otherwise("active").alias("status"),
        F.when(k % 5 == 0, "compiler: inline-draft").otherwise("compiler: nightly").alias("body"), F.date_add(F.to_date("o_orderdate"), 1200).alias("updated_on"),
    )


cte(
    "digest_cand",
    """
  select d.id from decisions d left join (select decision_id, max(updated_on) as u from (
      select decision_id, updated_on from branches union all select decision_id, updated_on from transcripts) group by 1) t on t.decision_id = d.id
  left join orders o on o.o_orderkey = d.id and o_orderkey % 3 <> 0
  where o.o_orderkey is null or d.id % 7 = 0 or d.id % 5 = 0 or o.o_orderdate::date + 1200 < greatest(d.updated_on, t.u)""",
)


def digest_candidates(spark, sf):
    d = D.decision_touched(B.decisions(spark, sf), B.branches(spark, sf), transcripts(spark, sf))
    return D.digest_candidates(d, digest_pages(spark, sf))


@query("J13_digest_candidates", "select id from digest_cand")
def j13(spark, sf):
    return digest_candidates(spark, sf).select("id")


@query(
    "D03_compile_decision_digests",
    r"""
with b as (select decision_id as id, coalesce(string_agg(label, ', ' order by label) filter (where status = 'rejected'), '') as rejected, min(label) filter (where status = 'chosen') as chosen,
                  max(tier) as bt, count(*) as bn from branches group by 1),
t as (select decision_id as id, max(tier) as tt, count(*) as tn from transcripts group by 1),
d as (select d.*, b.*, t.* from decisions d semi join digest_cand using (id) left join b on b.id = d.id left join t on t.id = d.id)
select d.id, 'derived/decisions/' || d.id::varchar || '.md' as path, 'When facing ' || trim(regexp_replace(question, '\?+$', '')) as title,
       concat_ws(' ', question, stakes, reasoning, 'Falsifier: ' || falsifier) as situation,
       concat_ws(' ', 'Past-me chose ' || coalesce(choice, chosen, 'no choice yet') || '.', case when rejected <> '' then 'Rejected: ' || rejected || '.' end,
                 'Confidence: ' || confidence::varchar || '/100.', 'Expected: ' || expected_outcome || '.') as past,
       coalesce(nullif(case when actual_outcome is not null then concat_ws(' ', 'Outcome: ' || actual_outcome || '.', 'Outcome score: ' || outcome_score::varchar || '/100.')
            else concat_ws(' ', 'Watch for: ' || expected_outcome || '.', falsifier) end, ''), 'No outcome recorded yet.') as takeaway,
       1 + coalesce(tn, 0) + coalesce(bn, 0) as sources, greatest(d.tier, bt, tt) as tier
from d""",
)
def d03(spark, sf):
    out = D.compile_digests(digest_candidates(spark, sf), B.branches(spark, sf), transcripts(spark, sf))
    return out.drop("body", "hash")


def prior_digests(spark, sf):
    """What an earlier run left: some digests are not there yet, some read otherwise, some had another tier; one page has lost its decision."""
    d = D.compile_digests(digest_candidates(spark, sf), B.branches(spark, sf), transcripts(spark, sf))
    k = F.col("id") % 4
    first = F.lit("2001-01-01").cast("date")
    old = d.filter(k != 0).select(
        "path", "title", F.when(k == 1, "before").otherwise(F.col("body")).alias("body"), F.when(k == 1, "before").otherwise(F.col("hash")).alias("hash"),
        F.when(k == 2, 3 - F.col("tier")).otherwise(F.col("tier")).alias("tier"), first.alias("first_seen"), first.alias("updated_on"),
    )
    lost = table(spark, sf, "orders").groupBy().agg(F.max("o_orderkey").alias("m")).select(
        F.concat(F.lit("derived/decisions/"), F.col("m") + 1, F.lit(".md")).alias("path"), F.lit("t").alias("title"), F.lit("b").alias("body"), F.lit("h").alias("hash"), F.lit(1).alias("tier"), first.alias("first_seen"), first.alias("updated_on")
    )
    return d, old.unionByName(lost)


@query(
    "D03_digest_status",
    """
with t as (select decision_id as id, max(tier) as tt from transcripts group by 1), b as (select decision_id as id, max(tier) as bt from branches group by 1)
select 'derived/decisions/' || d.id::varchar || '.md' as path, greatest(d.tier, bt, tt) as tier, case d.id % 4 when 0 then 'created' when 1 then 'updated' when 2 then 'retiered' else 'unchanged' end as status,
       case when d.id % 4 = 0 then date '2001-06-15' else date '2001-01-01' end as first_seen, case when d.id % 4 <= 1 then date '2001-06-15' else date '2001-01-01' end as updated_on
from decisions d semi join digest_cand using (id) left join b on b.id = d.id left join t on t.id = d.id
union all select 'derived/decisions/' || (max(o_orderkey) + 1)::varchar || '.md', 1, 'kept', date '2001-01-01', date '2001-01-01' from orders""",
)
def d03_status(spark, sf):
    d, old = prior_digests(spark, sf)
    return D.merge_digests(old, d, today()).select("path", "tier", "status", "first_seen", "updated_on")


@query(
    "D03_digest_sources",
    """
select id, 'decision:' || id::varchar as ref from digest_cand
union all select decision_id, 'decision_transcript:' || ord::varchar from transcripts where decision_id in (select id from digest_cand)
union all select decision_id, 'decision_branch:' || label from branches where decision_id in (select id from digest_cand)""",
)
def d03_sources(spark, sf):
    return D.digest_sources(digest_candidates(spark, sf), B.branches(spark, sf), transcripts(spark, sf))


def flag_queue(spark, sf):
    """One night's flags as queue rows: stale people, due reviews and duplicate tasks."""
    p = known_people(spark, sf).select(
        F.concat(F.lit("s"), "id").alias("item_id"), F.lit("stale").alias("kind"), F.lit("person").alias("ref_type"), F.col("id").alias("ref_id"),
        F.col("canonical_name").alias("label"), F.concat(F.lit('{"id":'), "id", F.lit(',"label":"x","n":{"title":"'), "canonical_name", F.lit('","k":1}}')).alias("payload"),
        F.col("updated_on").alias("created_on"),
    )
    r = D.decision_reviews(B.decisions(spark, sf), today()).select(
        F.concat(F.lit("d"), "id").alias("item_id"), F.lit("decision_review").alias("kind"), F.lit("decision").alias("ref_type"), F.col("id").alias("ref_id"),
        F.col("question").alias("label"), F.concat(F.lit('{"decision_id":'), "id", F.lit(',"question":"'), "question", F.lit('"}')).alias("payload"),
        F.col("review_on").alias("created_on"),
    )
    return p.unionByName(r)


HID = "[above current tier]"
cte(
    "masked",
    f"""
  select 's' || p.id::varchar as item_id, 'stale' as kind, case when tier <= 1 then canonical_name else '{HID}' end as label,
         '{{"id":' || p.id::varchar || ',"label":"x","n":{{"title":"{HID}","k":1}}}}' as payload, updated_on as created_on from people p
  union all
  select 'd' || id::varchar, 'decision_review', case when tier <= 1 then substr(question, 1, 120) else '{HID}' end,
         '{{"decision_id":' || id::varchar || ',"question":"{HID}"}}', review_on from decisions where review_on <= date '{TODAY}' and reviewed_on is null""",
)


@query("F04_mask_payload", "select * from masked")
def f04(spark, sf):
    return D.masked_queue(flag_queue(spark, sf), B.nodes(spark, sf)).select("item_id", "kind", "label", "payload", "created_on")


@query(
    "D08_review_queue_view",
    "select item_id, kind, label, created_on from masked where regexp_extract(item_id, '[0-9]+')::bigint % 4 <> 0",
)
def d08(spark, sf):
    q = flag_queue(spark, sf).withColumn("status", F.lit("open"))
    n = F.regexp_extract("item_id", "([0-9]+)", 1).cast("bigint")
    verdicts = q.filter(n % 4 == 0).select("item_id", F.when(n % 8 == 0, "resolved").otherwise("dismissed").alias("verdict"))
    still = D.resolve_items(q, verdicts).filter("status = 'open'")
    return D.masked_queue(still, B.nodes(spark, sf)).select("item_id", "kind", "label", "created_on")


@query(
    "J15_dossier",
    """
with e as (select * from edges_tiered where tier <= 1),
around as (select src_id as id, edge_id, rel, dst_type, dst_id, created_on from e where src_type = 'person' union select dst_id, edge_id, rel, dst_type, dst_id, created_on from e where dst_type = 'person'),
ar as (select *, row_number() over (partition by id order by created_on desc, edge_id) as rn from around),
ne as (select id, count(*) as edges, string_agg(rel || ' ' || dst_type || ' ' || dst_id::varchar, ', ' order by rn) as related from ar where rn <= 20 group by 1),
ir as (select *, row_number() over (partition by person_id order by occurred_on desc, id desc) as rn from interactions where tier <= 1),
ia as (select person_id as id, count(*) as interactions, string_agg(id::varchar || ' ' || kind || ' ' || occurred_on::varchar, ', ' order by rn) as met from ir where rn <= 20 group by 1),
oc as (select p.id, count(*) as open_commitments from people p join commitments c on c.status = 'open' and c.tier <= 1 and lower(c.to_whom) = lower(p.canonical_name) group by 1),
lc as (select person_id as id, max(occurred_on) as last_contact from interactions group by 1)
select p.id, p.canonical_name, p.relation, coalesce(ne.edges, 0) as edges, coalesce(ne.related, '') as related, coalesce(ia.interactions, 0) as interactions, coalesce(ia.met, '') as met,
       coalesce(oc.open_commitments, 0) as open_commitments, ia.interactions is null as locked, case when date_diff('day', coalesce(lc.last_contact, p.updated_on), date '2001-06-15') > 30
         then 'last contact ' || date_diff('day', coalesce(lc.last_contact, p.updated_on), date '2001-06-15')::varchar || ' days ago' end as staleness
from people p left join ne using (id) left join ia using (id) left join oc using (id) left join lc using (id) where p.tier <= 1""",
)
def j15(spark, sf):
    from ..operators.dossier import dossiers

    d = dossiers(
        known_people(spark, sf), B.edges_tiered(spark, sf), B.nodes(spark, sf), B.interactions(spark, sf), B.commitments(spark, sf), B.tasks(spark, sf), today()
    )
    return d.select(
        "id", "canonical_name", "relation", F.size("related").cast("bigint").alias("edges"),
        F.array_join(F.transform("related", lambda x: F.concat_ws(" ", x["rel"], x["dst_type"], x["dst_id"].cast("string"))), ", ").alias("related"),
        F.size("interactions").cast("bigint").alias("interactions"),
        F.array_join(F.transform("interactions", lambda x: F.concat_ws(" ", x["interaction_id"].cast("string"), x["kind"], x["occurred_on"].cast("string"))), ", ").alias("met"),
        "open_commitments", "locked", "staleness",
    )


cte("org_meetings", "select i.id, i.kind, i.occurred_on, i.tier, l.org_id from (select distinct l_orderkey as id, l_suppkey as org_id from lineitem) l join interactions i using (id)")


@query(
    "J15_org_dossier",
    """
with e as (select * from edges_tiered where tier <= 1),
around as (select src_id as id, edge_id, rel, src_type, src_id, created_on from e where src_type = 'org' union select dst_id, edge_id, rel, src_type, src_id, created_on from e where dst_type = 'org'),
ar as (select *, row_number() over (partition by id order by created_on desc, edge_id) as rn from around),
ne as (select id, count(*) as edges, string_agg(rel || ' ' || src_type || ' ' || src_id::varchar, ', ' order by rn) as related from ar where rn <= 20 group by 1),
ir as (select *, row_number() over (partition by org_id order by occurred_on desc, id desc) as rn from org_meetings where tier <= 1),
ia as (select org_id as id, count(*) as interactions, string_agg(id::varchar || ' ' || kind || ' ' || occurred_on::varchar, ', ' order by rn) as met from ir where rn <= 20 group by 1)
select o.id, o.canonical_name, coalesce(ne.edges, 0) as edges, coalesce(ne.related, '') as related, coalesce(ia.interactions, 0) as interactions, coalesce(ia.met, '') as met, ia.interactions is null as locked,
       case when date_diff('day', date '2001-01-01' + (o.id % 160)::integer, date '2001-06-15') > 30
         then 'row ' || date_diff('day', date '2001-01-01' + (o.id % 160)::integer, date '2001-06-15')::varchar || ' days ago' end as staleness
from orgs o left join ne using (id) left join ia using (id) where o.tier <= 1""",
)
def j15_orgs(spark, sf):
    from ..operators.dossier import org_dossiers

    orgs = B.orgs(spark, sf).withColumn("updated_on", F.expr("date_add(date'2001-01-01', cast(id % 160 as int))"))
    d = org_dossiers(orgs, B.edges_tiered(spark, sf), B.nodes(spark, sf), org_meetings(spark, sf), today())
    return d.select(
        "id", "canonical_name", F.size("related").cast("bigint").alias("edges"),
        F.array_join(F.transform("related", lambda x: F.concat_ws(" ", x["rel"], x["src_type"], x["src_id"].cast("string"))), ", ").alias("related"),
        F.size("interactions").cast("bigint").alias("interactions"),
        F.array_join(F.transform("interactions", lambda x: F.concat_ws(" ", x["interaction_id"].cast("string"), x["kind"], x["occurred_on"].cast("string"))), ", ").alias("met"), "locked", "staleness",
    )


def org_meetings(spark, sf):
    """Interactions kept under an organisation: one for each supplier of an order."""
    li, i = table(spark, sf, "lineitem"), B.interactions(spark, sf)
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("org_id")).distinct().join(i.drop("person_id"), "id")


@query(
    "J15_decision_dossier",
    """
with t as (select decision_id as id, count(*) as turns, string_agg(ord::varchar, ',' order by ord) as transcript from transcripts where tier <= 1 group by 1),
b as (select *, row_number() over (partition by decision_id order by updated_on, label) as rn from branches where tier <= 1),
bb as (select decision_id as id, count(*) as ways, string_agg(label || ' ' || status, ', ' order by rn) as branches from b group by 1)
select d.id, question, coalesce(turns, 0) as turns, coalesce(transcript, '') as transcript, coalesce(ways, 0) as ways, coalesce(bb.branches, '') as branches,
       case when date_diff('day', d.updated_on, date '2001-06-15') > 30 then 'row ' || date_diff('day', d.updated_on, date '2001-06-15')::varchar || ' days ago' end as staleness
from decisions d left join t using (id) left join bb using (id) where d.tier <= 1""",
)
def j15_decisions(spark, sf):
    from ..operators.dossier import decision_dossiers

    d = decision_dossiers(B.decisions(spark, sf), B.edges_tiered(spark, sf), B.nodes(spark, sf), transcripts(spark, sf), B.branches(spark, sf), today())
    return d.select(
        "id", "question", "turns", F.array_join(F.transform("transcript", lambda x: x["ord"].cast("string")), ",").alias("transcript"),
        "ways", F.array_join(F.transform("branches", lambda x: F.concat_ws(" ", x["label"], x["status"])), ", ").alias("branches"), "staleness",
    )


@query(
    "J15_decision_timeline",
    """
select decision_id, 'transcript' as part, ord::integer as place, ''::varchar as label, transcripts.updated_on from transcripts join decisions d on d.id = decision_id where transcripts.tier <= 1 and d.tier <= 1
union all select decision_id, 'branch', row_number() over (partition by decision_id order by b.updated_on, label)::integer, label, b.updated_on from branches b join decisions d on d.id = decision_id where b.tier <= 1 and d.tier <= 1""",
)
def j15_timeline(spark, sf):
    from ..operators.dossier import decision_timeline

    return decision_timeline(B.decisions(spark, sf), transcripts(spark, sf), B.branches(spark, sf))


ZONES = ["Asia/Singapore", "America/New_York", "Europe/Oslo"]


@query(
    "X13_local_day_buckets",
    """select zone, (ts at time zone 'UTC' at time zone zone)::date as local_day, count(*) as events, sum(round(value * 100)::bigint)::bigint as cents
       from events, (values ('Asia/Singapore'), ('America/New_York'), ('Europe/Oslo')) z(zone) group by 1, 2""",
)
def x13(spark, sf):
    e = table(spark, sf, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return clock.local_day_buckets(e, "ts", ZONES).groupBy("zone", "local_day").agg(F.count(F.lit(1)).alias("events"), F.sum("cents").alias("cents"))
