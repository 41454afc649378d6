import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from hearthgraph.operators import captures as K
from hearthgraph.operators import curation as D
from hearthgraph.operators import entities as E
from hearthgraph.operators import evaluate as V
from hearthgraph.operators import state as S_state
from hearthgraph.sources import files as S
from hearthgraph.sources import merge as M


def test_groups_say_every_pair(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("aaabcd"), rnd.randint(0, 60)) for _ in range(60)] + [("alone", 1), ("alone", 1)]
    want = {(e, x, y) for e in "abcd" for x, y in itertools.combinations(sorted({m for g, m in rows if g == e}), 2)}
    got = E.groups_sharing(spark.createDataFrame(rows, "entity string, member int")).collect()
    assert {(x["entity"], *sorted((x["member"], y["member"]))) for x, y in itertools.combinations(got, 2) if x["entity"] == y["entity"]} == want
    assert all(r["group_size"] == len({m for g, m in rows if g == r["entity"]}) for r in got)


def test_contradictions_say_every_pair(spark):
    rnd = random.Random(5)
    says = ["he always sings", "he NEVER sings", "she loves rain", "she hates rain", "a vegetarian", "ate a steak", "quiet"]
    rows = [(rnd.choice("aab"), i, rnd.choice(says)) for i in range(40)] + [("c", 90, "always and never"), ("d", 91, "always and never"), ("d", 92, "always")]
    sides = [(0, 1), (2, 3), (4, 5)]

    def on(text):
        return {says.index(text)} if text in says else {0, 1} if "never" in text else {0}

    def clash(a, b):
        return any({x, y} == set(s) for s in sides for x in on(a) for y in on(b))

    want = {(x[0], x[1], y[1]) for x, y in itertools.combinations(rows, 2) if x[0] == y[0] and clash(x[2], y[2])}
    df = spark.createDataFrame(rows, "entity string, chunk_id int, text string")
    got = D.contradictions(df, df.select("chunk_id", "text")).collect()
    pairs = {(x["entity"], *sorted((x["chunk_id"], y["chunk_id"]))) for x in got for y in got if (x["entity"], x["claim"]) == (y["entity"], y["claim"]) and x["side"] < y["side"] and x["chunk_id"] != y["chunk_id"]}
    assert pairs == want
    queue = spark.createDataFrame([("contradiction", "a", 0, "open"), ("contradiction", "b", 0, "dismissed")], "kind string, entity string, claim int, status string")
    left = D.contradictions(df, df.select("chunk_id", "text"), queue).collect()
    assert {tuple(r) for r in left} == {tuple(r) for r in got if (r["entity"], r["claim"]) != ("a", 0)}


def test_duplicate_titles_equals_comparing_all(spark):
    rnd = random.Random(11)
    vocab = ["fern", "moss", "sail", "lamp", "harbor", "rope", "the", "pack"]
    title = lambda: " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 5)))
    day = lambda: None if rnd.random() < 0.3 else dt.date(2031, 1, 1) + dt.timedelta(days=rnd.randint(0, 9))
    new = [(i, title(), day()) for i in range(40)]
    old = [(100 + i, title(), day()) for i in range(60)]
    toks = lambda t: {w for w in t.split() if w != "the"}
    want = {}
    for i, t, d in new:
        best = None
        for j, u, e in old:
            a, b = toks(t), toks(u)
            if not a or not b or (d and e and abs((d - e).days) > 3):
                continue
            s = len(a & b) / min(len(a), len(b))
            if s >= 0.5 and (best is None or (s, j) > best):
                best = (s, j)
        if best:
            want[i] = (best[1], round(best[0], 3))
    sch = "id int, title string, due date"
    got = {r["new_id"]: (r["open_id"], r["score"]) for r in K.duplicate_titles(spark.createDataFrame(new, sch), spark.createDataFrame(old, sch)).collect()}
    assert got == want


def test_named_in_equals_contains(spark):
    names = [("person", 1, "Ida"), ("person", 2, "Al"), ("org", 1, "Brine & Co"), ("org", 2, "o"), ("person", 3, "Idaho Falls")]
    qs = [(1, "calling IDAHO falls"), (2, "brine & company"), (3, "alone"), (4, "xyz")]
    want = {(q, t, i) for q, s in qs for t, i, n in names if n.lower() in s.lower()}
    got = {tuple(r) for r in E.named_in(spark.createDataFrame(qs, "query_id int, query string"), spark.createDataFrame(names, "type string, id int, name string")).collect()}
    assert got == want


def test_merge_twice_changes_nothing(spark):
    state = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, seq int")
    up = M.keyed_merge(state, batch, ["k"], "seq", update=True)
    assert {tuple(r) for r in up.collect()} == {(1, "a", "kept"), (2, "y", "updated"), (3, "z", "inserted")}
    again = M.keyed_merge(up.drop("outcome"), batch, ["k"], "seq", update=True)
    assert {r["outcome"] for r in again.collect()} == {"kept"}
    first = M.keyed_merge(state, batch, ["k"], "seq", update=False)
    assert {tuple(r) for r in first.collect()} == {(1, "a", "kept"), (2, "b", "kept"), (3, "z", "inserted")}


ICS = """BEGIN:VCALENDAR
BEGIN:VEVENT
uid:one
DTSTART;TZID=X:20310301T090000
SUMMARY:Plan\\, sail
  and rest
ATTENDEE;CN=I:MAILTO:ida@sea.example
END:VEVENT
BEGIN:VEVENT
UID:two
DTSTART:20310302
SUMMARY:All day
END:VEVENT
BEGIN:VEVENT
SUMMARY:No uid
DTSTART:20310302T100000Z
END:VEVENT
BEGIN:VEVENT
UID:bad
DTSTART:tomorrow
SUMMARY:x
END:VEVENT
END:VCALENDAR
"""


def test_calendar_file(spark, tmp_path):
    (tmp_path / "a.ics").write_text(ICS)
    good, bad = S.parse_calendar(S.read_calendar(spark, str(tmp_path / "a.ics")), "Asia/Singapore")
    rows = {r["uid"]: r for r in good.collect()}
    assert set(rows) == {"one", "two"} and bad.count() == 2
    assert rows["one"]["title"] == "Plan, sail and rest" and rows["one"]["attendees"] == ["ida@sea.example"]
    assert rows["one"]["starts_at"] == dt.datetime(2031, 3, 1, 1, 0)
    assert rows["two"]["starts_at"] == dt.datetime(2031, 3, 1, 16, 0)


def test_bank_file(spark, tmp_path):
    (tmp_path / "b.csv").write_text(
        'Day,Sum,Who,Kind,Ref\n03/02/2031,-12.50,"Rope, ""fine""",sea,R1\n04/02/2031,"1,200.00",Pay,,\nnever,1.00,x,,R3\n05/02/2031,abc,x,,R4\n'
    )
    p = S.BankProfile("main", "SGD", "Day", "Sum", "Who", "Kind", "Ref")
    good, bad = S.parse_bank(S.read_bank_csv(spark, str(tmp_path / "b.csv")), p)
    rows = {r["merchant"]: r for r in good.collect()}
    assert rows['Rope, "fine"']["amount_cents"] == -1250 and rows['Rope, "fine"']["occurred_on"] == dt.date(2031, 2, 3)
    assert rows["Pay"]["amount_cents"] == 120000 and len(rows["Pay"]["external_ref"]) == 24 and rows["Pay"]["category"] is None
    assert {r["reason"] for r in bad.collect()} == {"bad date", "bad amount"}


def test_health_file(spark, tmp_path):
    rec = lambda t, s, e, v: f'<Record type="{t}" sourceName="w" startDate="{s}" endDate="{e}" value="{v}"/>'
    day = "2031-03-01 0{}:00:00 +0800"
    (tmp_path / "h.xml").write_text(
        '<?xml version="1.0"?>\n<HealthData>\n <ExportDate value="x"/>\n'
        + "\n".join(
            [
                rec("HKQuantityTypeIdentifierStepCount", day.format(1), day.format(2), "500"),
                rec("HKCategoryTypeIdentifierSleepAnalysis", day.format(1), day.format(4), "valueAsleepCore"),
                rec("HKCategoryTypeIdentifierSleepAnalysis", day.format(1), day.format(4), "valueInBed"),
                rec("HKQuantityTypeIdentifierStepCount", "bad", day.format(2), "5"),
                rec("HKQuantityTypeIdentifierBodyMass", day.format(1), day.format(2), "heavy"),
                rec("Other", day.format(1), day.format(2), "5"),
            ]
        )
        + "\n</HealthData>"
    )
    good, bad = S.parse_health(S.read_health(spark, str(tmp_path / "h.xml")))
    assert sorted((r["kind"], r["value"]) for r in good.collect()) == [("sleep_minutes", 180.0), ("steps", 500.0)]
    assert sorted(r["reason"] for r in bad.collect()) == ["bad startDate", "bad value"]


def test_maildir(spark, tmp_path):
    for d in ("cur", "new"):
        (tmp_path / d).mkdir()
    (tmp_path / "cur" / "1").write_text("From: Ida <ida@sea.example>\nDate: Sat, 1 Mar 2031 09:00:00 +0800\nMessage-ID: <m1@x>\nReferences: <root@x>\n <m0@x>\nSubject: A\n\tB\n\nsecret body\n")
    (tmp_path / "new" / "2").write_text("From: ida@sea.example\nDate: 1 Mar 2031 09:00:00 +0000\nMessage-ID: <m2@x>\n\nX: y\n")
    (tmp_path / "new" / "3").write_text("From: ida@sea.example\nSubject: no id\n\n")
    good, bad = S.parse_mail(S.read_maildir(spark, str(tmp_path)))
    rows = {r["message_id"]: r for r in good.collect()}
    assert set(rows) == {"m1@x", "m2@x"} and bad.count() == 1
    assert (rows["m1@x"]["thread_id"], rows["m1@x"]["subject"], rows["m1@x"]["from_addr"]) == ("root@x", "A B", "ida@sea.example")
    assert rows["m1@x"]["happened_at"] == dt.datetime(2031, 3, 1, 1, 0) and rows["m2@x"]["thread_id"] == "m2@x"
    assert "secret" not in str(rows)


def test_pages_files(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.md").write_text("---\ntitle: 'Ferns'\ntier: 2\n---\n# Other\nx")
    (tmp_path / "b.md").write_text("# Moss\ny")
    (tmp_path / "c.md").write_text("plain")
    rows = {r["path"]: r for r in S.parse_pages(S.read_pages(spark, str(tmp_path))).collect()}
    assert {k: (r["title"], r["tier"]) for k, r in rows.items()} == {"n/a.md": ("Ferns", 2), "b.md": ("Moss", 1), "c.md": ("c", 1)}


def test_sessions_file(spark, tmp_path):
    import json

    e = lambda i, kind, content, **kw: json.dumps({"session_id": "s1", "type": kind, "timestamp": f"2031-03-01T09:0{i}:00", "message": {"role": kind, "content": content}, **kw})
    tool = [{"type": "text", "text": "all set"}, {"type": "tool_use", "name": "Edit", "input": {"file_path": "/a.py"}}]
    lines = [e(0, "user", "meta", isMeta=True), e(1, "user", "grow ferns"), e(2, "assistant", tool), e(3, "user", "<tool>"), e(4, "user", "and moss")]
    (tmp_path / "t.jsonl").write_text("\n".join(lines) + "\n" + json.dumps({"session_id": "s2", "type": "user", "timestamp": "x", "message": {"content": "one"}}))
    r = S.session_summaries(S.read_sessions(spark, str(tmp_path / "t.jsonl"))).collect()
    assert len(r) == 1 and (r[0]["request"], r[0]["outcome"], r[0]["files"], r[0]["prompts"]) == ("grow ferns", "all set", ["/a.py"], 2)


def test_ir_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1)], "query_id int, key string, rank int")
    rel = spark.createDataFrame([(1, "b"), (1, "z"), (3, "q")], "query_id int, key string")
    m = {r["query_id"]: r for r in V.ir_metrics(ranked, rel, 3).collect()}
    assert (m[1]["precision"], m[1]["recall"], m[1]["reciprocal_rank"], m[1]["first_rank"]) == (0.333333, 0.5, 0.5, 1)
    assert m[1]["ndcg"] == pytest.approx(0.63093 / 1.63093, abs=1e-4)
    assert m[2]["recall"] == 0.0 and m[3]["first_rank"] == -1


def test_masking_is_deep(spark):
    p = '{"a":{"title":"x, \\"y\\"","k":[1]},"text":null,"id":7}'
    r = spark.createDataFrame([(p,)], "p string").select(D.mask_payload(F.col("p")).alias("m")).first()["m"]
    assert r == '{"a":{"title":"[above current tier]","k":[1]},"text":"[above current tier]","id":7}'
    hidden = '"[above current tier]"'
    cases = {
        '{"a":{"text":{"x":{"y":1}},"title":[["deep"]]}}': f'{{"a":{{"text":{hidden},"title":{hidden}}}}}',
        '{ "title" : "secret" }': f'{{"title":{hidden}}}',
        '[{"body": "é"}, 2]': f'[{{"body":{hidden}}},2]',
        '{"title": secret}': hidden,
        "[" * 100_000 + "]" * 100_000: hidden,
        None: None,
    }
    df = spark.createDataFrame(list(cases.items()), "p string, want string")
    assert all(x["m"] == x["want"] for x in df.withColumn("m", D.mask_payload(F.col("p"))).collect())


def test_merge_keeps_the_first_arrival(spark):
    state = spark.createDataFrame([], "k int, v int")
    batch = spark.createDataFrame([(1, 500, 1), (1, 400, 2), (2, 7, 5), (2, 9, 5)], "k int, v int, at int")
    first = {r["k"]: r["v"] for r in M.keyed_merge(state, batch, ["k"], "at", update=False).collect()}
    again = {r["k"]: r["v"] for r in M.keyed_merge(state, batch.orderBy(F.desc("v")), ["k"], "at", update=False).collect()}
    assert first[1] == 500 and first == again
    assert {r["k"]: r["v"] for r in M.keyed_merge(state, batch, ["k"], "at", update=True).collect()}[1] == 400


def test_leaks_of_several_words(spark):
    res = spark.createDataFrame([(1, 1, "see the red fox here"), (2, 2, "red fox"), (3, 1, "red, fox"), (4, 1, "fox red")], "result_id int, reader_tier int, text string")
    marks = spark.createDataFrame([("red fox", 2), ("here", 2), ("see", 1)], "sentinel string, tier int")
    assert sorted(tuple(r) for r in V.leak_audit(res, marks).collect()) == [(1, 1, "here"), (1, 1, "red fox"), (3, 1, "red fox")]


def test_digest_pages_keep_what_did_not_change(spark):
    day = lambda x: F.lit(x).cast("date")
    digests = spark.createDataFrame([("a", "A", "new", "h1", 1), ("b", "B", "same", "h2", 2), ("c", "C", "first", "h3", 1), ("d", "D", "same", "h4", 1)], "path string, title string, body string, hash string, tier int")
    none = digests.withColumns({"first_seen": day("2000-01-01"), "updated_on": day("2000-01-01")}).limit(0)
    pages = spark.createDataFrame([("a", "A", "old", "h0", 1), ("b", "B", "same", "h2", 1), ("d", "D", "same", "h4", 1), ("e", "E", "lost", "h5", 2)], "path string, title string, body string, hash string, tier int")
    pages = pages.withColumns({"first_seen": day("2000-01-01"), "updated_on": day("2000-01-01")})
    after = D.merge_digests(pages, digests, day("2001-01-01")).cache()
    got = {r["path"]: (r["status"], r["body"], r["tier"], str(r["first_seen"])[:4], str(r["updated_on"])[:4]) for r in after.collect()}
    assert got == {
        "a": ("updated", "new", 1, "2000", "2001"), "b": ("retiered", "same", 2, "2000", "2000"), "c": ("created", "first", 1, "2001", "2001"), "d": ("unchanged", "same", 1, "2000", "2000"), "e": ("kept", "lost", 2, "2000", "2000")
    }
    again = D.merge_digests(after.drop("status"), digests, day("2002-01-01"))
    assert {r["status"] for r in again.collect()} == {"unchanged", "kept"} and again.drop("status").exceptAll(after.drop("status")).count() == 0
    assert {r["status"] for r in D.merge_digests(none, digests, day("2001-01-01")).collect()} == {"created"}


def test_changes_act_one_by_one(spark):
    now = F.lit("2001-01-01").cast("date")
    base = spark.createDataFrame([(1, "t", "inbox", None, None), (2, "u", "active", None, None)], "id long, title string, status string, due date, completed_on date")
    kinds = "id long, key string, title string, status string, due date, arrived int"
    changes = spark.createDataFrame([(1, "a", "first", "done", None, 1), (1, "b", None, "active", None, 2), (1, "c", "last", None, None, 3), (9, "d", "x", None, None, 1), (9, "e", "y", None, None, 2), (None, "f", "new", None, None, 1), (None, "g", "new", "done", None, 1)], kinds)
    got = sorted((r["id"] or 0, r["new_key"], r["title"], r["status"], str(r["completed_on"]), r["outcome"]) for r in S_state.merge_tasks(base, changes, now).collect())
    assert got == [
        (0, "f", "new", "inbox", "None", "inserted"), (0, "g", "new", "done", "2001-01-01", "inserted"), (1, None, "last", "active", "2001-01-01", "updated"), (2, None, "u", "active", "None", "kept"), (9, None, "y", None, "None", "rejected")
    ]
    decisions = spark.createDataFrame([(1, None, 3, None), (2, None, None, None)], "id long, actual_outcome string, outcome_score int, reviewed_on date")
    outcomes = spark.createDataFrame([(1, "bad", 5, "be slow", 1), (1, "good", None, "be quick", 2), (7, "x", 1, "y", 1)], "id long, actual_outcome string, score int, lesson string, arrived int")
    after, principles, edges = S_state.review_decisions(decisions, outcomes, now)
    assert sorted(tuple(map(str, r)) for r in after.collect()) == [("1", "good", "5", "2001-01-01", "principle-1-2"), ("2", "None", "None", "None", "None")]
    assert sorted(tuple(r) for r in principles.collect()) == [("principle-1", "be slow", 1), ("principle-1-2", "be quick", 1)] and edges.count() == 2
