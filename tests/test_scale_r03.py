"""The steps of the third round's findings: same rows as the plain statement, by a plan that does not grow with the pairs."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthgraph.functions import embed as EM
from hearthgraph.operators import entities as E
from hearthgraph.operators import evaluate as V
from hearthgraph.operators import facts as FA
from hearthgraph.operators import retrieval as R
from hearthgraph.plans import retrieval_queries as Q
from hearthgraph.streaming import jobs as J


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 7, "query_rows": 2}])
@pytest.mark.parametrize("idf", [False, True])
def test_lexical_blocks_find_the_best_chunks(spark, sizes, idf):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{x}" for x in rng.zipf(1.6, n) if x < 40)
    texts = {f"c{i}": word(12) for i in range(60)}
    asked = {i: word(8) for i in range(9)} | {50: "nobody says this"}
    c = spark.createDataFrame([(k, "page", i, 0, t, 1) for i, (k, t) in enumerate(texts.items())], "chunk_id string, parent_type string, parent_id int, ord int, text string, tier int")
    q = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    df = {w: sum(w in t.split() for t in texts.values()) for t in texts.values() for w in t.split()}
    want = set()
    for i, said in asked.items():
        terms = set(said.split())
        found = [(sum(x in terms for x in t.split()), k, sum(np.log(60 / df[w]) for w in terms & set(t.split()))) for k, t in texts.items()]
        best = sorted(((round(g if idf else n * 0.1, 6), k, n) for n, k, g in found if n), key=lambda r: (-r[0], r[1]))[:6]
        want |= {(i, k, n, s, at + 1) for at, (s, k, n) in enumerate(best)}
    got = R.lexical_arm(q, c, limit=6, idf=idf, **sizes)
    assert {(r["query_id"], r["chunk_id"], r["positions"], r["lexical"], r["rank"]) for r in got.collect()} == want
    # (query, chunk) pairs were shuffled to be summed before; now blocks meet and leave their best
    assert "FlatMapCoGroupsInPandas" in plan(got)


def test_lexical_scope_meets_its_own_chunks_only(spark):
    c = spark.createDataFrame([(f"c{i}", "page" if i % 5 else "note", i, 0, "lamp " * (i % 7 + 1), 1) for i in range(40)], "chunk_id string, parent_type string, parent_id int, ord int, text string, tier int")
    q = spark.createDataFrame([(i, "lamp") for i in range(4)], "query_id int, query string")
    scope = q.select("query_id", F.col("query_id").alias("g")), c.select("parent_id", (F.col("parent_id") % 3).alias("g"))
    got = R.lexical_arm(q, c, scope=scope, types=["page"], limit=5).collect()
    want = {(g, f"c{i}") for g in range(3) for i in sorted((i for i in range(40) if i % 5 and i % 3 == g), key=lambda i: (-(i % 7), f"c{i}"))[:5]}
    assert {(r["query_id"], r["chunk_id"]) for r in got} == want and len(got) == 15


def test_weights_of_an_id_are_summed_where_they_are_made(spark):
    rows = [(1, "harbor lamp harbor"), (1, "lamp"), (2, "x"), (3, None), (4, "brine brine")]
    w = EM.hash_weights(spark.createDataFrame(rows, "id int, text string"), 16)
    # one shuffle, of texts by id; draws were shuffled before
    assert plan(w).count("Exchange hashpartitioning") == 1
    got = {(r["id"], r["dim"]): r["weight"] for r in w.collect()}
    one = {(r["id"], r["dim"]): r["weight"] for r in EM.hash_weights(spark.createDataFrame([(1, "lamp harbor lamp harbor"), (4, "brine")], "id int, text string"), 16).collect()}
    assert {k[0] for k in got} == {1, 4} and {k: v for k, v in got.items() if k[0] == 1} == {k: v for k, v in one.items() if k[0] == 1}
    assert all(got[k] == 2 * v for k, v in one.items() if k[0] == 4)


def test_vectors_carry_columns_and_are_not_written(spark):
    t = spark.createDataFrame([("a", "harbor lamp", 7), ("b", "", 8), ("c", None, None), ("d", "brine lamp", None)], "id string, text string, parent bigint")
    got = {r["id"]: (r["parent"], round(sum(x * x for x in r["embedding"]), 9)) for r in EM.hash_vectors(t, 32).collect()}
    assert got == {"a": (7, 1.0), "d": (None, 1.0)}
    p = spark.createDataFrame([("a:0", "harbor lamp")], "chunk_id string, text string")
    # they were written and read back before
    assert "FileScan" not in plan(Q.vectors_of(p)) and "MapInArrow" in plan(Q.vectors_of(p))


def test_near_pairs_are_those_of_neighbors(spark):
    rng = np.random.default_rng(3)
    pick = lambda n: [int(x) for x in rng.integers(0, n, 60)]
    kinds = ["page", "org"]
    edges = [(kinds[a], b, kinds[c], d, 1 + e // 4) for a, b, c, d, e in zip(pick(2), pick(9), pick(2), pick(9), pick(5))]
    e = spark.createDataFrame(edges, "src_type string, src_id int, dst_type string, dst_id int, tier int")
    refs = spark.createDataFrame([(k, kinds[k % 2], k % 9) for k in range(12)] + [(3, "org", 5)], "key int, type string, id int")
    every = spark.createDataFrame([(k, p) for k in range(12) for p in range(9)], "query_id int, parent_id int")
    want = {(r["key"], r["id"]) for r in E.neighbors(refs, e).filter("type = 'page'").collect()}
    got = E.near_pairs(every, refs, e, "page").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    few = every.filter("query_id < 3 and parent_id > 4")
    assert {tuple(r) for r in E.near_pairs(few, refs, e, "page").collect()} == {(q, p) for q, p in want if q < 3 and p > 4}


def test_long_names_are_met_by_long_grams(spark):
    """Names that differ at their end only shared every short gram; now a query meets its own name and few others."""
    names = spark.createDataFrame([("person", i, f"Cust {i}") for i in range(3000)] + [("person", 9000, "Customer#" + "0" * 40)], "type string, id int, name string")
    qs = spark.createDataFrame([(i, f"pack for cust {i}, customer#{'0' * (i % 50)}") for i in range(0, 3000, 37)], "query_id int, query string")
    got = {tuple(r) for r in E.named_in(qs, names).collect()}
    want = {(i, "person", int(str(i)[:n])) for i in range(0, 3000, 37) for n in range(1, len(str(i)) + 1)} | {(i, "person", 9000) for i in range(0, 3000, 37) if i % 50 >= 40}
    assert got == want
    # eight characters say which of three thousand it is; three say a hundredth of them
    assert "xxhash64" in plan(E.named_in(qs, names))


def test_only_words_that_open_a_name_leave_the_text(spark):
    lex = spark.createDataFrame([("person", i, f"Ida{i} Brine") for i in range(50)], "type string, id int, name string")
    texts = spark.createDataFrame([(1, "we met ida7 brine and ida8, brine"), (2, "nobody"), (3, "Ida9 Brine"), (3, "ida49  brine")], "text_id int, text string")
    df = E.known_mentions(texts, lex)
    assert {(r["text_id"], r["id"]) for r in df.collect()} == {(1, 7), (3, 9)}
    # heads that occur are a table of their own that cuts the words beside the scan
    assert "heads-" in df._jdf.queryExecution().toString() or "LeftSemi" in plan(df)


def test_grants_are_dealt_out(spark):
    """A small file of grants is many minutes; they were shipped to every task through the driver."""
    g = spark.createDataFrame([("a", "2024-01-01 10:00:30", "2024-01-01 11:00:30")], "actor string, f string, t string").selectExpr("actor", "timestamp(f) granted_at", "timestamp(t) expires_at")
    e = spark.createDataFrame([(1, "a", "2024-01-01 10:59:59"), (2, "a", "2024-01-01 11:00:30"), (3, "b", "2024-01-01 10:30:00")], "event_id int, actor string, t string").selectExpr("event_id", "actor", "timestamp(t) happened_at")
    df = J.with_effective_tier(e, g)
    assert "BroadcastHashJoin" not in plan(df)
    assert {(r["event_id"], r["allowed"]) for r in df.collect()} == {(1, 2), (2, 1), (3, 1)}


def test_sentinels_that_share_their_first_word(spark):
    s = spark.createDataFrame([(f"locked page {i}", 2) for i in range(200)] + [("locked", 3), ("sentinel_7", 2), ("locked page 3", 1)], "sentinel string, tier int")
    r = spark.createDataFrame([(i, 1, f"see locked page {i}, or sentinel_{i}") for i in range(190, 220)] + [(7, 1, "sentinel_7 locked"), (8, 2, "locked page 8 sentinel_7")], "result_id int, reader_tier int, text string")
    got = {tuple(x) for x in V.leak_audit(r, s).collect()}
    want = {(i, 1, f"locked page {i}") for i in range(190, 200)} | {(i, 1, "locked") for i in range(190, 220)} | {(7, 1, "sentinel_7"), (7, 1, "locked"), (8, 2, "locked")}
    assert got == want


def test_beliefs_meet_cases_by_a_shuffle(spark):
    """Beliefs are a few bytes in a file and many as rows; they were shipped through the driver."""
    c = spark.createDataFrame([(1, 5, ["a"], 2, 1), (2, 6, ["a"], 2, 1)], "case_id int, user_id int, scopes array<string>, max_beliefs int, max_questions int")
    rows = [(i, 5, "fact", ["a", "b"], i % 2 == 0, False, False, [i + 1]) for i in range(6)]
    b = spark.createDataFrame(rows, "id int, user_id int, type string, scopes array<string>, pinned boolean, superseded boolean, resolved boolean, participants array<int>")
    h = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (2, 5, 1)], "case_id int, id int, rank int")
    made = V.build_context(c, b, h)
    first = plan(made).split("Initial Plan")[0]
    got = {tuple(r) for r in made.collect()}
    assert {r for r in got if r[1] == "pinned"} == {(1, "pinned", 0, 1), (1, "pinned", 2, 2)} and (2, "relevant", 5, 1) in got
    assert first.count("BroadcastHashJoin") <= 1  # what is used up is counted by case and may travel


@pytest.mark.parametrize("at_once", [100, 2])
def test_words_that_open_no_name_stay_beside_the_scan(spark, at_once):
    said = {1: "Ada Moe met Bob at Cyl Works.", 2: "nothing of note", 3: "bob saw Cyl Work and Dag Holm", 4: "Ada, Bo; (Eli)", 5: None}
    lex = [("person", "1", "Ada Moe"), ("person", "2", "Bob"), ("org", "3", "Cyl Works"), ("person", "4", "Dag"), ("person", "5", "(Eli)"), ("person", "6", "Fay")]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        # whatever Spark thinks of the size of a table: a run of words was shuffled for each word of the texts before
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = E.known_mentions(spark.createDataFrame(list(said.items()), "text_id int, text string"), spark.createDataFrame(lex, "type string, id string, name string"), at_once=at_once)
        how = plan(got)
        rows = {(r["text_id"], r["id"]) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert rows == {(1, "1"), (1, "2"), (3, "2"), (1, "3"), (3, "4"), (4, "5")}
    assert how.count("BroadcastHashJoin") == (1 if at_once == 100 else 3)


@pytest.mark.parametrize("idf", [False, True])
def test_lexical_terms_are_told_beside_the_scan(spark, idf):
    # a chunk id that stands in two rows is one chunk, and a term counts once for its rarity
    rows = [("a", "lamp harbor lamp"), ("a", "lamp brine"), ("b", "harbor the the"), ("c", None), ("d", ""), ("e", "tallow"), (None, "lamp")]
    c = spark.createDataFrame([(k, "page", 1, 0, t, 1) for k, t in rows], "chunk_id string, parent_type string, parent_id int, ord int, text string, tier int")
    q = spark.createDataFrame([(1, "lamp harbor"), (2, "the"), (3, None), (4, "harbor Harbor brine")], "query_id int, query string")
    read = lambda d: sorted((r["query_id"], r["chunk_id"], r["positions"], r["lexical"], r["rank"]) for r in d.collect())
    here = R.lexical_arm(q, c, idf=idf)
    # terms of all texts were counted in long form and joined before; many words still are
    assert read(here) == read(R.lexical_arm(q, c, idf=idf, vocabulary=1))
    assert "MapInArrow" in plan(R._asked_in(c, ["lamp"])) and "Exchange" not in plan(R._asked_in(c, ["lamp"]))
    assert {(r[0], r[1], r[2]) for r in read(here)} == {(1, "a", 4), (1, "b", 1), (4, "a", 2), (4, "b", 1)}


def test_vectors_are_made_where_they_are_searched(spark):
    words = ["harbor", "lamp", "brine", "tallow", "quay", "x", ""]
    rng = np.random.default_rng(11)
    texts = [(f"c{i}", " ".join(words[j] for j in rng.integers(0, 7, 6))) for i in range(40)] + [("none", None)]
    c = spark.createDataFrame(texts, "chunk_id string, text string")
    q = EM.hash_vectors(spark.createDataFrame([(1, "lamp quay"), (2, "brine")], "id int, text string")).withColumnRenamed("id", "query_id")
    read = lambda d: sorted((r["query_id"], r["rank"], r["chunk_id"], r["cosine"]) for r in d.collect())
    seeds = EM.seeded(c)
    got = R.vector_arm(q, seeds, limit=5, dense=EM.dense)
    how = plan(got)
    assert read(got) == read(R.vector_arm(q, Q.vectors_of(c), limit=5)) == read(R.vector_arm(q, seeds, limit=5, small_rows=1, dense=EM.dense)) and len(read(got)) == 10
    # a dense vector of each text went to the JVM and back before
    assert how.count("MapInArrow") == 1 and "MapInPandas" not in how


def test_only_sentences_that_name_somebody_leave_the_scan(spark):
    texts = [(1, "Nothing here at all. We saw pagg berg today.\n\nGrey days."), (2, "My manager is Anna Moe. Rain fell."), (3, "the pagg berg and the pagg berg"), (3, "the pagg berg and the pagg berg"), (4, None), (5, "all quiet")]
    known = spark.createDataFrame([("person", "7", "Pagg Berg", 0, "Pagg Berg")], "type string, id string, name string, ord int, canonical string")
    got = FA.sentence_facts(spark.createDataFrame(texts, "text_id int, text string"), known)
    rows = sorted((r["text_id"], r["para"], r["sent"], [p["name"] for p in r["persons"]]) for r in got.collect())
    assert rows == [(1, 0, 1, ["Pagg Berg"]), (2, 0, 0, ["Anna Moe"]), (3, 0, 0, ["Pagg Berg"]), (3, 0, 0, ["Pagg Berg"])]
    # every sentence was shuffled to meet the names before
    assert "NOT plain" in plan(got)


@pytest.mark.parametrize("idf", [False, True])
def test_lexical_arm_reads_the_texts_once(spark, tmp_path, idf):
    rows = [("c0", 0, "lamp harbor lamp"), ("c0", 1, "brine lamp"), ("c1", 2, "harbor"), ("c2", 3, "nothing"), ("c3", 4, None), (None, 5, "lamp")]
    c = spark.createDataFrame(rows, "chunk_id string, parent_id int, text string").selectExpr("*", "'page' as parent_type", "0 as ord", "1 as tier")
    c.write.parquet(f"{tmp_path}/texts")
    got = R.lexical_arm(spark.createDataFrame([(1, "lamp harbor brine"), (2, "nobody")], "query_id int, query string"), spark.read.parquet(f"{tmp_path}/texts"), idf=idf)
    # with counted terms, texts were read again to count the chunks and to find the parents of the best
    assert not (idf and [x for x in got.inputFiles() if "/texts/" in x])
    ln = lambda n: round(n, 6)
    # rows of a chunk id are one chunk: harbor and lamp stand in two and one, of the five rows that have an id
    c0, c1 = (ln(np.log(5 / 2) + 2 * np.log(5)), ln(np.log(5 / 2))) if idf else (0.5, 0.1)
    assert {(r["chunk_id"], r["parent_id"], r["positions"], r["lexical"]) for r in got.collect()} == {("c0", 0, 5, c0), ("c0", 1, 5, c0), ("c1", 2, 1, c1)}


def test_chunks_with_a_term(spark):
    idx = spark.createDataFrame([("a", [1, 2]), ("a", [2, 3]), ("a", [2]), ("b", [2, 2]), ("c", [4])], "chunk_id string, terms array<int>")
    assert {tuple(r) for r in R._chunks_with(idx).select("term", "df").collect()} == {(1, 1), (2, 2), (3, 1), (4, 1)}
