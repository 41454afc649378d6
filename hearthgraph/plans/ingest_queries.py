"""S01-S08, S10, U04 on files and snapshots that Spark derives from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as S
from ..sources import merge as M
from ..sources.page_store import PageStore
from ..session import new_folder, table
from . import bindings as B
from .registry import cte, query


def ics_text(spark, sf):
    """events written as calendar entries: long titles folded, every 50th without uid, every 70th with a bad start."""
    e = table(spark, sf, "events")
    k = F.col("event_id")
    start = F.when(k % 70 == 3, F.lit("soon")).when(k % 3 == 0, F.date_format("ts", "yyyyMMdd")).when(
        k % 3 == 1, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")).otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss"))
    return e.select(
        F.concat_ws(
            "\n", F.lit("BEGIN:VEVENT"), F.when(k % 50 != 7, F.concat(F.lit("UID:evt-"), k % 4000)), F.concat(F.lit("DTSTART;X=1:"), start),
            F.concat(F.lit("SUMMARY:"), "event_type", F.lit("\\, no"), F.lit("\n  "), k), F.concat(F.lit("ATTENDEE;CN=U:mailto:u"), "user_id", F.lit("@x.example")),
            F.lit("END:VEVENT"),
        ).alias("value")
    )


@query(
    "S01_calendar_ingest",
    """
with e as (select *, case event_id % 3 when 0 then ts::date::timestamp when 1 then date_trunc('second', ts) else date_trunc('second', ts) - interval 8 hour end as s0 from events
           where event_id % 50 <> 7 and event_id % 70 <> 3),
g as (select 'evt-' || (event_id % 4000)::varchar as uid, arg_max(case when event_id % 3 = 0 then s0 - interval 8 hour else s0 end, event_id) as s, arg_max(event_type, event_id) as ty, max(event_id) as k,
             arg_max(user_id, event_id) as u from e group by 1)
select uid, epoch_us(s) as start_us, ty || ', no ' || k::varchar as title, 'u' || u::varchar || '@x.example' as attendee from g""",
)
def s01(spark, sf):
    path = new_folder(spark, "ics")
    ics_text(spark, sf).write.text(path)
    good, _ = S.parse_calendar(S.read_calendar(spark, path), "Asia/Singapore")
    k = F.regexp_extract("title", "no ([0-9]+)$", 1).cast("bigint")
    good = good.withColumn("seq", k)
    state = good.drop("seq").limit(0)
    merged = M.keyed_merge(state, good, ["uid"], "seq", update=True)
    return merged.select("uid", F.unix_micros("starts_at").alias("start_us"), "title", F.get("attendees", F.lit(0)).alias("attendee"))


BANK = S.BankProfile("main", "SGD", "Transaction Date", "Amount", "Description", "Category", "Reference")


@query(
    "S02_transactions_ingest",
    """
select case when o_orderkey % 9 = 0 then substr(sha256(strftime(o_orderdate, '%d/%m/%Y') || '|' || a || '|' || m || '|' || coalesce(c, '')), 1, 24) else 'R' || o_orderkey::varchar end as external_ref,
       o_orderdate::date as occurred_on, -cents as amount_cents, m as merchant, c as category
from (select *, round(o_totalprice * 100)::bigint as cents, '-' || (cents // 100)::varchar || '.' || lpad((cents % 100)::varchar, 2, '0') as a,
             'Shop, "' || o_orderkey::varchar || '"' as m, case when o_orderpriority <> '5-LOW' then o_orderpriority end as c
      from orders) where o_orderkey % 41 <> 5 and o_orderkey % 43 <> 6""",
)
def s02(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    amount = F.concat(F.lit("-"), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    rows = o.select(
        F.when(k % 41 == 5, F.lit("someday")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("Transaction Date"),
        F.when(k % 43 == 6, F.lit("n/a")).otherwise(amount).alias("Amount"), F.concat(F.lit('Shop, "'), k, F.lit('"')).alias("Description"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("Category"), F.when(k % 9 != 0, F.concat(F.lit("R"), k)).alias("Reference"),
    )
    path = new_folder(spark, "bank")
    rows.write.csv(path, header=True, quote='"', escape='"')
    good, _ = S.parse_bank(S.read_bank_csv(spark, path), BANK)
    merged = M.keyed_merge(good.limit(0).drop("arrival"), good, ["account_label", "external_ref"], "arrival", update=False)
    return merged.select("external_ref", "occurred_on", "amount_cents", "merchant", "category")


def health_xml(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id")
    kind = (
        F.when(F.col("event_type") == "view", "HKQuantityTypeIdentifierStepCount").when(F.col("event_type") == "click", "HKCategoryTypeIdentifierSleepAnalysis")
        .when(F.col("event_type") == "error", "HKQuantityTypeIdentifierBodyMass").otherwise("HKQuantityTypeIdentifierFlights")
    )
    value = F.when(F.col("event_type") == "click", F.when(k % 4 == 0, "InBed").otherwise("valueAsleepCore")).otherwise(F.when(k % 60 == 1, "many").otherwise(F.col("value").cast("string")))
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    fmt = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000"))
    start = F.when(k % 80 == 2, "bad-date").otherwise(fmt(ts))
    end = fmt(F.expr("date_trunc('second', cast(ts as timestamp)) + make_interval(0, 0, 0, 0, 0, cast(user_id as int), 0)"))
    attr = lambda n, c: F.concat(F.lit(f' {n}="'), c, F.lit('"'))
    record = lambda v: F.concat(F.lit("<Record"), attr("type", kind), attr("sourceName", F.concat(F.lit("w"), F.col("user_id"))), attr("startDate", start), attr("endDate", end), attr("value", v), F.lit("/>"))
    # every ninth record is followed by one of the same key and another value, which must not win
    later = F.when((k % 9 == 4) & (F.col("event_type") != "click"), record(F.lit("-1"))).otherwise("")
    bad = F.col("event_type").isin("view", "error") & (k % 60 == 1)
    return e.select(F.concat(record(value), F.when(bad, "").otherwise(later)).alias("value"))


cte(
    "health_samples",
    """select case event_type when 'view' then 'steps' when 'click' then 'sleep_minutes' else 'body_mass' end as kind, epoch_us(date_trunc('second', ts)) as at_us,
              'w' || user_id::varchar as source, arg_min(case when event_type = 'click' then user_id::double else value end, event_id) as value
       from events where event_type in ('view', 'click', 'error') and event_id % 80 <> 2
         and case when event_type = 'click' then event_id % 4 <> 0 else event_id % 60 <> 1 end group by 1, 2, 3""",
)


@query("S03_health_ingest", "select * from health_samples")
def s03(spark, sf):
    path = new_folder(spark, "health")
    health_xml(spark, sf).write.text(path)
    good, _ = S.parse_health(S.read_health(spark, path))
    merged = M.keyed_merge(good.limit(0).drop("arrival"), good, ["kind", "happened_at", "source"], "arrival", update=False)
    return merged.select("kind", F.unix_micros("happened_at").alias("at_us"), "source", "value")


@query(
    "S04_email_headers_ingest",
    """
select 'm' || conv_id::varchar || '.' || turn::varchar || '@x.example' as message_id, epoch_us(timestamp '2024-03-01 08:00:00' + to_minutes(conv_id * 10 + turn)) as at_us,
       role || '@x.example' as from_addr, 'Re: ' || conv_id::varchar || ' and more' as subject,
       case when turn > 1 then 'm' || conv_id::varchar || '.0@x.example' when turn = 1 then 'r' || conv_id::varchar || '@x.example'
            else 'm' || conv_id::varchar || '.' || turn::varchar || '@x.example' end as thread_id
from conversations where (conv_id + turn) % 13 <> 4""",
)
def s04(spark, sf):
    """conversations as mails: the text is the body and must not survive."""
    c = table(spark, sf, "conversations")
    mid = lambda t: F.concat(F.lit("m"), "conv_id", F.lit("."), t, F.lit("@x.example"))
    when = F.expr("timestamp'2024-03-01 08:00:00' + make_interval(0, 0, 0, 0, 0, cast(conv_id * 10 + turn as int), 0)")
    raw = F.concat_ws(
        "\n", F.concat(F.lit("From: A Person <"), "role", F.lit("@x.example>")),
        F.when((F.col("conv_id") + F.col("turn")) % 13 != 4, F.concat(F.lit("Message-ID: <"), mid(F.col("turn").cast("string")), F.lit(">"))),
        F.concat(F.lit("Date: "), F.date_format(when, "d MMM yyyy HH:mm:ss"), F.lit(" +0000")), F.concat(F.lit("Subject: Re: "), "conv_id", F.lit("\n\tand more")),
        F.when(F.col("turn") > 1, F.concat(F.lit("References: <"), mid(F.lit("0")), F.lit("> <x@y>"))),
        F.when(F.col("turn") == 1, F.concat(F.lit("In-Reply-To: <r"), "conv_id", F.lit("@x.example>"))), F.lit(""), F.col("text"),
    )
    # every seventh message comes a second time, under another subject
    again = raw.alias("raw"), F.regexp_replace(raw, "Subject: Re", "Subject: Fwd").alias("copy")
    seen = c.select(*again, "conv_id", "turn").select("conv_id", "turn", F.posexplode(F.when(F.col("conv_id") % 7 == 2, F.array("raw", "copy")).otherwise(F.array("raw"))).alias("n", "raw"))
    good, _ = S.parse_mail(seen.select("raw", F.struct("n", "conv_id", "turn").alias("arrival")))
    merged = M.keyed_merge(good.limit(0).drop("arrival"), good, ["message_id"], "arrival", update=False)
    return merged.select("message_id", F.unix_micros("happened_at").alias("at_us"), "from_addr", "subject", "thread_id")


@query(
    "S04_maildir",
    """
with c as (select conv_id, count(*) as turns, count(case when text is not null then 1 end) as said from conversations group by conv_id)
select 'c' || conv_id::varchar || '@x.example' as message_id, epoch_us(timestamp '2024-03-01 08:00:00' + to_minutes(conv_id)) as at_us, 'user' || conv_id::varchar || '@x.example' as from_addr,
       turns::varchar || ' turns' as subject, case when conv_id % 3 = 0 then 'root@x.example' else 'c' || conv_id::varchar || '@x.example' end as thread_id, 'kept' as outcome from c where conv_id % 13 <> 4
union all select null, case when conv_id % 2 = 0 then epoch_us(timestamp '2024-03-01 08:00:00' + to_minutes(conv_id)) end, 'user' || conv_id::varchar || '@x.example', turns::varchar || ' turns', case when conv_id % 3 = 0 then 'root@x.example' end, 'missing message-id/from/date' from c where conv_id % 13 = 4""",
)
def s04_maildir(spark, sf):
    """Each conversation as one mail in a folder of its own kind, read back through the file reader; its turns are the body."""
    c = table(spark, sf, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    m = c.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), "\n\n").alias("body"), F.count(F.lit(1)).alias("turns"))
    k, when = F.col("conv_id"), F.expr("timestamp'2024-03-01 08:00:00' + make_interval(0, 0, 0, 0, 0, cast(conv_id as int), 0)")
    raw = F.concat_ws(
        "\n", F.concat(F.lit("From: user"), k, F.lit("@x.example")), F.when(k % 13 != 4, F.concat(F.lit("Message-ID: <c"), k, F.lit("@x.example>"))),
        F.when((k % 13 != 4) | (k % 2 == 0), F.concat(F.lit("Date: "), F.date_format(when, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000 (UTC)"))),
        F.concat(F.lit("Subject: "), F.col("turns"), F.lit("\n turns")), F.when(k % 3 == 0, "References: <root@x.example>"), F.lit(""), F.col("body"),
    )
    path = new_folder(spark, "maildir")
    for folder, some in (("cur", k % 2 == 0), ("new", k % 2 == 1)):
        m.filter(some).select(k.alias("mail"), raw.alias("value")).repartition("mail").write.partitionBy("mail").text(f"{path}/{folder}")
    good, bad = S.parse_mail(S.read_maildir(spark, path))
    merged = M.keyed_merge(good.limit(0).drop("arrival"), good, ["message_id"], "arrival", update=False).withColumn("outcome", F.lit("kept"))
    out = merged.unionByName(bad.drop("arrival").withColumnRenamed("reason", "outcome"))
    return out.select("message_id", F.unix_micros("happened_at").alias("at_us"), "from_addr", "subject", "thread_id", "outcome")


@query(
    "S05_pages_sync",
    """
select 'p/' || page_id::varchar || '.md' as path, case when page_id % 10 = 0 then 'insert' when page_id % 10 = 1 or page_id % 10 = 6 then 'delete' when page_id % 10 = 2 then 'update'
       when page_id % 10 = 3 then 'retier' when page_id % 10 = 4 then 'reactivate' else 'noop' end as action from pages""",
)
def s05(spark, sf):
    p = table(spark, sf, "pages")
    k = F.col("page_id") % 10
    raw = lambda tier: F.concat(F.lit("---\ntitle: 'T'\ntier: "), tier, F.when(k == 6, "\nstatus: deleted").otherwise(""), F.lit("\n---\n"), F.col("html"))
    path = F.concat(F.lit("p/"), "page_id", F.lit(".md")).alias("path")
    new = S.parse_pages(p.filter(k != 1).select(path, raw(F.lit("1")).alias("raw")))
    old = S.parse_pages(p.filter(k != 0).select(path, F.concat(raw(F.lit("1")), F.when(k == 2, "old").otherwise("")).alias("raw"), k.alias("k")))
    kk = F.regexp_extract("path", "([0-9]+)", 1).cast("bigint") % 10
    state = old.withColumn("tier", F.when(kk == 3, 2).otherwise(F.col("tier"))).withColumn("status", F.when(kk == 4, "deleted").otherwise("active"))
    return M.sync_actions(state, new)


def page_trees(spark, sf):
    """The page table as two snapshots of a tree of files: a third of the pages stay, the others change in one way each."""
    p = table(spark, sf, "pages")
    k = F.col("page_id") % 9
    head = lambda late: F.concat(F.lit("---\ntitle: 'Page "), "page_id", F.lit("'\ntier: "), F.when(late & (k == 3), "2").otherwise("1"), F.when((late & (k == 4)) | (~late & (k == 5)), "\nstatus: deleted").otherwise(""), F.lit("\n---\n"))
    body = lambda late: F.when(late & (k == 2), F.concat("html", F.lit("\n\nnew end"))).when(late & (k == 6), "").otherwise(F.col("html"))
    tree = lambda late: S.parse_pages(p.filter(k != (1 if late else 0)).select(F.concat(F.lit("p/"), "page_id", F.lit(".md")).alias("path"), F.concat(head(F.lit(late)), body(F.lit(late))).alias("raw")))
    return tree(False), tree(True)


def synced_store(spark, sf):
    store = PageStore(spark, new_folder(spark, "page-store")).create()
    first, second = page_trees(spark, sf)
    return store, store.sync(first), store.sync(second), store.sync(second)


TREE = """(select page_id, page_id % 9 as k, 'p/' || page_id::varchar || '.md' as path from pages)"""


@query(
    "S05_sync_counts",
    f"""
select 1 as sync, count(case when k not in (0, 5) then 1 end) as scanned, count(case when k not in (0, 5) then 1 end) as changed, 0::bigint as unchanged, 0::bigint as deleted from {TREE}
union all select 2, count(case when k not in (1, 4) then 1 end), count(case when k in (0, 2, 3, 5, 6) then 1 end), count(case when k in (7, 8) then 1 end), count(case when k in (1, 4) then 1 end) from {TREE}
union all select 3, count(case when k not in (1, 4) then 1 end), 0, count(case when k not in (1, 4) then 1 end), 0 from {TREE}""",
)
def s05_counts(spark, sf):
    """A first snapshot, a second, and the second once more."""
    _, *counts = synced_store(spark, sf)
    one, two, three = (c.select(F.lit(i).alias("sync"), "*") for i, c in enumerate(counts, 1))
    return one.unionByName(two).unionByName(three)


@query(
    "S05_synced_index",
    f"""
with t as (select page_id, k, path, case when k = 2 then html || chr(10) || chr(10) || 'new end' when k = 6 then '' else html end as body from {TREE} join pages using (page_id))
select path, 'Page ' || page_id::varchar as title, (case when k = 3 then 2 else 1 end)::integer as tier, case when k in (1, 4) then 'deleted' else 'active' end as status,
       length(body) as chars, k not in (1, 4, 6) as indexed, case when k in (1, 4, 6) then 0 when k = 3 then 2 else 1 end::bigint as chunk_tier, k = 2 as new_end from t""",
)
def s05_index(spark, sf):
    """Pages and chunks of the store after the syncs."""
    store, *_ = synced_store(spark, sf)
    per = store.chunks().groupBy(F.col("parent_id").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.max("tier").alias("ct"), F.max(F.col("text").endswith("new end")).alias("end"))
    return store.pages().join(per, "path", "left").select(
        "path", "title", "tier", "status", F.length("body").cast("bigint").alias("chars"), F.col("n").isNotNull().alias("indexed"),
        F.coalesce("ct", F.lit(0)).cast("bigint").alias("chunk_tier"), F.coalesce("end", F.lit(False)).alias("new_end"),
    )


@query(
    "U04_absent_from_snapshot",
    "select page_id, url from pages where page_id % 2 = 0 and page_id % 6 <> 0",
)
def u04(spark, sf):
    p = table(spark, sf, "pages").withColumn("status", F.when(F.col("page_id") % 2 == 0, "active").otherwise("deleted"))
    return M.absent(p, table(spark, sf, "pages").filter("page_id % 3 = 0"), ["page_id"]).select("page_id", "url")


@query(
    "S06_session_summary_ingest",
    r"""
with t as (select conv_id, turn, role, trim(text) as text from conversations),
p as (select conv_id, count(*) as prompts, arg_min(text, turn) as first from t where role = 'user' and text <> '' and not starts_with(text, '<') group by 1 having count(*) >= 2),
a as (select conv_id, arg_max(text, turn) as final from t where role = 'assistant' and text <> '' group by 1),
s as (select conv_id, min(turn) as first_turn, max(turn) as last_turn from t group by 1),
f as (select p.conv_id, prompts, first_turn, last_turn, trim(regexp_replace(first, '\s+', ' ', 'g')) as r, trim(regexp_replace(final, '\s+', ' ', 'g')) as o
      from p join s using (conv_id) left join a using (conv_id))
select conv_id::varchar as session_id, prompts, case when length(r) <= 500 then r else rtrim(substr(r, 1, 499)) || '…' end as request,
       coalesce(case when length(o) <= 700 then o else rtrim(substr(o, 1, 699)) || '…' end, '(no final summary)') as outcome, first_turn, last_turn from f""",
)
def s06(spark, sf):
    t = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), "turn", "role", F.lit(False).alias("is_meta"), F.trim("text").alias("text"), F.array().cast("array<string>").alias("files")
    )
    return S.session_summaries(t).drop("files", "n_files")


@query(
    "S06_session_files",
    r"""
with t as (select conv_id, turn, role, trim(text) as text, role = 'user' and (conv_id + turn) % 5 = 0 as is_meta from conversations),
p as (select conv_id, count(*) as prompts, arg_min(text, turn) as first from t where role = 'user' and not is_meta and text <> '' and not starts_with(text, '<') group by 1 having count(*) >= 2),
a as (select conv_id, arg_max(text, turn) as final from t where role = 'assistant' and text <> '' group by 1),
s as (select conv_id, min(turn) as a, max(turn) as z from t group by 1),
e as (select conv_id, '/src/f' || ((turn * 5 + i + conv_id) % 23)::varchar || '.py' as file, min(turn * 8 + i) as pos from t, (select unnest(range(8)) as i) where role = 'assistant' group by 1, 2),
n as (select conv_id, string_agg(file, ',' order by pos) filter (where rn <= 20) as files, count(*) as n_files from (select *, row_number() over (partition by conv_id order by pos) as rn from e) group by 1),
f as (select p.conv_id, prompts, a, z, files, n_files, trim(regexp_replace(first, '\s+', ' ', 'g')) as r, trim(regexp_replace(final, '\s+', ' ', 'g')) as o
      from p join s using (conv_id) left join a using (conv_id) left join n using (conv_id))
select conv_id::varchar as session_id, prompts, case when length(r) <= 500 then r else rtrim(substr(r, 1, 499)) || '…' end as request,
       coalesce(case when length(o) <= 700 then o else rtrim(substr(o, 1, 699)) || '…' end, '(no final summary)') as outcome,
       strftime(timestamp '2031-03-01 09:00:00' + to_minutes(a), '%Y-%m-%dT%H:%M:%S') as first_turn, strftime(timestamp '2031-03-01 09:00:00' + to_minutes(z), '%Y-%m-%dT%H:%M:%S') as last_turn,
       coalesce(files, '') as files, coalesce(n_files, 0) as n_files from f""",
)
def s06_files(spark, sf):
    """Conversations as transcripts of JSON lines, read back: some prompts are not the user's own, each answer edits eight files."""
    c = table(spark, sf, "conversations")
    k, t = F.col("conv_id"), F.col("turn")
    when = F.date_format(F.expr("timestamp'2031-03-01 09:00:00' + make_interval(0, 0, 0, 0, 0, cast(turn as int), 0)"), "yyyy-MM-dd'T'HH:mm:ss")
    edit = lambda i: F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.when(i % 2 == 0, "Edit").otherwise("Write").alias("name"), F.struct(F.concat(F.lit("/src/f"), (t * 5 + i + k) % 23, F.lit(".py")).alias("file_path")).alias("input"))
    # a tool that only reads does not touch its file
    look = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("Read").alias("name"), F.struct(F.lit("/etc/seen").alias("file_path")).alias("input"))
    says = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("name"), F.struct(F.lit(None).cast("string").alias("file_path")).alias("input"))
    blocks = F.concat(F.array(says, look), F.transform(F.sequence(F.lit(0), F.lit(7)), edit))
    line = lambda content: F.to_json(F.struct(k.cast("string").alias("session_id"), F.col("role").alias("type"), ((F.col("role") == "user") & ((k + t) % 5 == 0)).alias("isMeta"), when.alias("timestamp"), F.struct("role", content.alias("content")).alias("message")))
    path = new_folder(spark, "transcripts")
    c.select(F.when(F.col("role") == "assistant", line(blocks)).otherwise(line(F.col("text"))).alias("value")).write.text(path)
    return S.session_summaries(S.read_sessions(spark, path)).withColumn("files", F.array_join("files", ","))


@query(
    "S07_keyed_merge",
    """
with b as (select o_orderkey as k, o_orderstatus as status, o_totalprice as price from orders where o_orderkey % 3 <> 0),
c as (select o_orderkey as k, arg_max(case when o_orderkey % 2 = 0 then 'X' else o_orderstatus end, v) as status, arg_max(o_totalprice + v - 1, v) as price from orders, (values (0), (1)) x(v)
      where o_orderkey % 4 <> 0 group by 1)
select coalesce(b.k, c.k) as o_orderkey, coalesce(c.status, b.status) as status, coalesce(c.price, b.price) as price,
       case when b.k is null then 'inserted' when c.k is not null and (c.status <> b.status or c.price <> b.price) then 'updated' else 'kept' end as outcome
from b full join c on b.k = c.k""",
)
def s07(spark, sf):
    base, batch = order_batch(spark, sf)
    return M.keyed_merge(base, batch, ["o_orderkey"], "v", update=True)


@query(
    "S07_merge_stats",
    """
with b as (select o_orderkey as k, o_orderstatus as status, o_totalprice as price from orders where o_orderkey % 3 <> 0),
raw as (select o_orderkey as k, case when o_orderkey % 2 = 0 then 'X' else o_orderstatus end as status, o_totalprice + v - 1 as price, v from orders, (values (0), (1)) x(v) where o_orderkey % 4 <> 0),
c as (select k, arg_max(status, v) as status, arg_max(price, v) as price from raw where price >= 50000 group by 1)
select (select count(*) from raw) as total, count(case when b.k is null then 1 end) as inserted,
       count(case when b.k is not null and c.k is not null and (c.status <> b.status or c.price <> b.price) then 1 end) as updated,
       (select count(*) from raw where price < 50000) as skipped
from b full join c on b.k = c.k""",
)
def s07_stats(spark, sf):
    base, batch = order_batch(spark, sf)
    good, bad = M.split_rejects(batch, {"too cheap": F.col("price") < 50000})
    return M.merge_stats(batch, M.keyed_merge(base, good, ["o_orderkey"], "v", update=True), bad)


def order_batch(spark, sf):
    o = table(spark, sf, "orders")
    base = o.filter("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    batch = o.filter("o_orderkey % 4 <> 0").withColumn("v", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), (F.col("o_totalprice") + F.col("v") - 1).alias("price"), "v"
    )
    return base, batch


@query(
    "S08_reject_table",
    """
select 'importer:documents' as actor, 'import:malformed' as verb, reason, count(*) as rows from (
  select case when length(text) < 40 then 'too short' when lang not in ('en', 'fr', 'de') then 'unsupported language' when n_chars > 20000 then 'too long' end as reason from documents
  union all select case when json_extract_string(props, '$.k')::integer > 90 then 'bad key' when value < 1 then 'bad value' end from events) where reason is not null group by reason""",
)
def s08(spark, sf):
    d = table(spark, sf, "documents")
    _, bad = M.split_rejects(d, {"too short": F.length("text") < 40, "unsupported language": ~F.col("lang").isin("en", "fr", "de"), "too long": F.col("n_chars") > 20000})
    _, bad2 = M.split_rejects(table(spark, sf, "events"), {"bad key": F.get_json_object("props", "$.k").cast("int") > 90, "bad value": F.col("value") < 1})
    return M.reject_counts(bad.select("reason").unionByName(bad2.select("reason")), "importer:documents")


@query(
    "S10_audit_append",
    """
with r as (select l_suppkey as call_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) - 1 as pos, l_orderkey::varchar as id from lineitem)
select s_suppkey as call_id, 'agent' as actor, 'tool:search' as verb, substr(sha256('{"q":"' || s_name || '"}'), 1, 16) as params_hash,
       coalesce(string_agg(id, ',' order by pos) filter (where pos < 100), '') as returned_ids, count(id) as returned_count
from supplier left join r on call_id = s_suppkey group by s_suppkey, s_name""",
)
def s10(spark, sf):
    li = table(spark, sf, "lineitem")
    ret = li.select(
        F.col("l_suppkey").alias("call_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("pos"), F.col("l_orderkey").cast("string").alias("id")
    )
    calls = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("call_id"), F.lit("agent").alias("actor"), F.lit("search").alias("verb"), F.concat(F.lit('{"q":"'), "s_name", F.lit('"}')).alias("params"), F.lit(None).cast("string").alias("error")
    )
    a = M.audit_rows(calls, ret)
    return a.select("call_id", "actor", "verb", "params_hash", F.array_join("returned_ids", ",").alias("returned_ids"), "returned_count")
