import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthgraph.functions import capture as P
from hearthgraph.functions import clock
from hearthgraph.functions import embed as EM
from hearthgraph.functions import text as X


def values(spark, rows, fn):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[1] for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_fold_han(spark):
    got = values(spark, ["山水画 x", "云", "plain"], X.fold_han)
    assert got == [" zh5c716c34 zh6c34753b  x", " zh4e91 ", "plain"]


def test_han_stop_and_counts(spark):
    assert values(spark, ["zh76846211", "zh5c716c34", "的我", "the"], X.is_han_stop) == [True, False, True, False]
    assert values(spark, ["two words", "山水 画", ""], X.token_count) == [2, 3, 0]


def test_redaction_order_and_uuid(spark):
    texts = [
        "card 4539 5787 6362 1486 end",
        "not a card 4539 5787 6362 1487 end",
        "iban GB82WEST12345698765432",
        "acct 123456789 and 12345678",
        "id 11111111-2222-3333-4444-555555555555 stays, 4539578763621486 goes",
    ]
    assert values(spark, texts, X.redact) == [
        "card [REDACTED:card] end",
        "not a card 4539 5787 6362 1487 end",
        "iban [REDACTED:iban]",
        "acct [REDACTED:account] and 12345678",
        "id 11111111-2222-3333-4444-555555555555 stays, [REDACTED:card] goes",
    ]


def test_intent(spark):
    qs = ["latest plan with Ida", "what did Ida say", "Ida Holm", "who is the tall one", "how do lamps glow", "notes from march", "山水"]
    assert values(spark, qs, X.intent) == ["temporal", "event", "entity", "entity", "general", "temporal", "entity"]


@pytest.mark.parametrize(
    "query,title,boost",
    [
        ("Harbor lamps", "Harbor Lamps", 1.4),
        ("harbor lamps", "Old harbor lamps guide", 1.25),
        ("lamps", "Old harbor lamps guide", 1.0),
        ("arbor lam", "Old harbor lamps guide", 1.0),
        ("the old", "the old harbor", 1.0),
    ],
)
def test_title_boost(spark, query, title, boost):
    r = spark.range(1).select(X.title_boost(F.lit(query), F.lit(title), F.lit(1.0)).alias("b")).first()["b"]
    assert r == pytest.approx(boost)


def test_snippet(spark):
    text = "Sun rose early. The harbor lamps were lit. Gulls slept. Nothing else."
    r = spark.range(1).select(X.snippet(F.lit(text), F.lit("harbor lamps")).alias("s")).first()["s"]
    assert r == "Sun rose early. The harbor lamps were lit. Gulls slept."


def test_embedding_forms_agree(spark):
    df = spark.createDataFrame([("a", "harbor lamps harbor"), ("b", "山水画 glow x"), ("c", "!")], "id string, text string")
    dense = {r["id"]: r["embedding"] for r in EM.hash_vectors(df, 64).collect()}
    sparse = {}
    for r in EM.hash_weights(df, 64).collect():
        sparse.setdefault(r["id"], {})[r["dim"]] = r["weight"] / 2**32
    assert set(dense) == set(sparse) == {"a", "b"}
    for k, v in dense.items():
        norm = sum(x * x for x in sparse[k].values()) ** 0.5
        assert v == pytest.approx([sparse[k].get(i, 0.0) / norm for i in range(64)])


def test_capture_classes(spark):
    texts = [
        "todo: water the ferns by 2031-02-03",
        "Met Ida Holm about sails",
        "called with Brine Ltd on prices",
        "Decided: keep the ferns",
        "Feeling tired, but my ferns grow",
        "unclear: hm",
        "ok",
        "A long remark on the way ferns unroll in the shade of the yard",
        "Ferns unroll",
    ]
    got = values(spark, texts, P.classify)
    assert [g["type"] for g in got] == ["task", "interaction", "interaction", "decision_note", "journal", "unknown", "unknown", "note", "unknown"]
    assert got[0]["title"] == "water the ferns by 2031-02-03" and got[0]["due"] == "2031-02-03"
    assert (got[1]["name"], got[1]["subject_type"]) == ("Ida Holm", "person")
    assert (got[2]["kind"], got[2]["subject_type"]) == ("call", "org")


def test_completion_and_split(spark):
    assert values(spark, ["ferns done", "workshop undone", "it works"], P.completed) == [True, False, True]
    assert values(spark, ["Decision: ferns watered, done. But need to prune"], P.done_title) == ["ferns watered, done"]
    halves = values(spark, ["todo: prune ferns and decide whether to sell", "decide on ferns and decide on moss", "pruned ferns done and decide on moss"], P.action_and_decision)
    assert halves[0]["action"] == "prune ferns" and halves[0]["decision"] == "Decide whether to sell"
    assert halves[1] is None and halves[2] is None


def test_due_guard(spark):
    today = F.lit("2031-01-01").cast("date")
    got = values(spark, ["2031-01-01", "2030-12-31", "soon"], lambda c: P.due_or_null(c, today))
    assert got == [dt.date(2031, 1, 1), None, None]
    assert values(spark, ["2030-12-31"], lambda c: P.due_note(c, today)) == ["past due date dropped: 2030-12-31"]


def test_local_days(spark):
    df = spark.createDataFrame([("2031-03-01 23:30:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    r = df.select(
        clock.local_day(F.col("t"), "Asia/Singapore").alias("d"),
        clock.with_offset(F.col("t"), "America/New_York").alias("o"),
        F.unix_micros(clock.parse_moment(F.lit("2031-07-01"), "America/New_York")).alias("n"),
    ).first()
    assert r["d"] == dt.date(2031, 3, 2)
    assert r["o"] == "2031-03-01T18:30:00.000-05:00"
    assert r["n"] == int(dt.datetime(2031, 7, 1, 16, tzinfo=dt.timezone.utc).timestamp() * 1e6)
