"""The steps of the fourth round's findings: same rows as the plain statement, by a plan that does not grow with the pairs."""

import contextlib
import io

from pyspark.sql import functions as F

from hearthgraph.functions import embed as EM
from hearthgraph.functions import text as X
from hearthgraph.functions.stem import stem
from hearthgraph.operators import entities as E
from hearthgraph.operators import extraction as EX
from hearthgraph.operators import facts as FA
from hearthgraph.operators import retrieval as R
from hearthgraph.plans import entity_queries as Q


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_expected_names_meet_answers_by_grams(spark):
    answers = [(1, "Ann Berg of Oslo"), (1, "BO"), (1, None), (2, "Ann Berg of Oslo"), (2, "ann berg of oslo"), (3, None), (None, "Ann"), (5, "Wø😀x")]
    expected = [(1, "ann berg"), (1, "Bo"), (1, "Oslo"), (1, "bergen"), (1, ""), (1, None), (2, "bo"), (2, "BERG OF"), (3, ""), (3, "x"), (None, "Ann"), (4, "Ann"), (5, "Ø😀"), (5, "x"), (1, "Oslo")]
    a, x = spark.createDataFrame(answers, "query_id int, name string"), spark.createDataFrame(expected, "query_id int, expect string")
    want = {}
    for q, e in expected:
        hit = e is not None and any(p is not None and p == q and n is not None and e.lower() in n.lower() for p, n in answers)
        n, k = want.get(q, (0, 0))
        want[q] = n + 1, k + hit
    got = E.answer_check(a, x)
    assert {r["query_id"]: (r["expected"], r["found"]) for r in got.collect()} == want
    assert all(r["ok"] == (r["expected"] == r["found"]) for r in got.collect())
    # every answer of a question met every expected name of it before
    assert "LeftSemi" in plan(got) and "xxhash64" in plan(got)


def test_answers_read_only_nodes_of_types_that_are_there(spark):
    lex = spark.createDataFrame([("org", 7, "Quay Works")], "type string, id int, name string")
    q = spark.createDataFrame([(1, "who is at quay works?"), (2, "nobody")], "query_id int, query string")
    e = spark.createDataFrame([("person", 3, "org", 7, 1), ("person", 4, "org", 7, 2), ("person", 5, "org", 8, 1)], "src_type string, src_id int, dst_type string, dst_id int, tier int")
    n = spark.createDataFrame([("person", 3, "Ann", 1), ("person", 4, "Bo", 1), ("org", 7, "Quay Works", 1), ("task", 3, "Pack", 1), ("person", 3, "Anna", 2)], "type string, id int, title string, tier int")
    got = E.relation_answers(q, lex, e, n)
    assert {tuple(r) for r in got.collect()} == {(1, "Ann"), (1, "Quay Works")}
    # a node of a type that nothing around has was joined before
    assert "type#" in plan(got) and "IN (org,person)" in plan(got).replace("IN (person,org)", "IN (org,person)")


def test_degrees_read_the_sides_that_can_have_the_type(spark):
    cols = "edge_id string, src_type string, src_id int, rel string, dst_type string, dst_id int"
    rows = [("a", "org", 1, "x", "org", 1), ("b", "org", 1, "x", "org", 2), ("c", "person", 1, "x", "org", 1), ("d", "org", None, "x", "org", None), ("e", None, 1, "x", "org", 1), ("f", "org", 1, "x", None, 1), ("g", "person", 2, "works_at", "org", 1)]
    got = {r["id"]: r["edges"] for r in E.edge_degree(spark.createDataFrame(rows, cols), "org").collect()}
    want = {}
    for _, st, si, _, dt, di in rows:
        for t, i in {(st, si), (dt, di)}:
            if t == "org":
                want[i] = want.get(i, 0) + 1
    assert got == want
    # edges of a kind that cannot touch the type are left out of the plan; both sides of all edges were exploded before
    some = spark.createDataFrame(rows, cols)
    kinds = some.select("edge_id", F.lit("person").alias("src_type"), "src_id", "rel", F.lit("task").alias("dst_type"), "dst_id")
    assert "LocalTableScan <empty>" in plan(E.edge_degree(kinds, "org")) and "Generate" not in plan(E.edge_degree(some, "org"))


def test_opening_words_do_not_need_the_whole_text(spark, tmp_path):
    texts = [None, "", "abc", "abc dEF", " abc", "  abc de", "abc ", "abc-", "-", "a1b2c3", "ÅB cd", "x\ny z", "\n\n", "aB😀cD", "ab  \r\n"]
    spark.createDataFrame([(i, t, 500) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    w = F.split(F.regexp_replace("text", r"[^A-Za-z ]", " "), " +")
    want = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", F.concat_ws(" ", F.initcap(F.get(w, F.lit(0))), F.initcap(F.get(w, F.lit(1)))).alias("n"))
    got = Q.proper_orgs(spark, str(tmp_path))
    assert {(r["id"], r["canonical_name"]) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert "regexp_replace" not in plan(got)


def test_mistyped_tells_edges_and_pronouns(spark):
    orgs = spark.createDataFrame([(1, "Ann Berg", False, "system:extract"), (2, "Bo Moe", False, "system:extract"), (3, "Eva Lie", False, "system:extract"), (4, "Quay Tech", False, "system:extract"), (5, "Per Dal", False, "system:extract")], "id int, canonical_name string, retired boolean, created_by string")
    people = spark.createDataFrame([(1, "She", "system:extract"), (2, "Ann", "system:extract"), (3, "it", "human")], "id int, canonical_name string, created_by string")
    rows = [("a", "person", 1, "works_at", "org", 2), ("b", "person", 2, "works_at", "org", 2), ("c", "person", 1, "works_at", "org", 1), ("d", "page", 1, "mentions", "org", 1)]
    edges = spark.createDataFrame(rows, "edge_id string, src_type string, src_id int, rel string, dst_type string, dst_id int")
    got = E.mistyped(orgs, people, edges, spark.createDataFrame([("per dal",)], "name string"))
    assert {(r["kind"], r["type"], r["id"], r["name"], r["edges"]) for r in got.collect()} == {("org_should_be_person", "org", 1, "Ann Berg", 2), ("org_should_be_person", "org", 3, "Eva Lie", 0), ("person_from_pronoun", "person", 1, "She", 2)}


def test_stems_are_counted_where_the_text_is_dealt_to(spark):
    texts = [("a", "The dogs running, the dog ran"), ("a", "dogs the"), ("b", ""), ("b", None), ("c", "the"), (None, "lamps lamp"), ("d", "漢字漢 dogs x1")]
    c = spark.createDataFrame(texts, "chunk_id string, text string").repartition(3)
    want = {}
    for i, t in texts:
        for at, w in enumerate(spark.createDataFrame([(t,)], "t string").select(X.terms(F.col("t"))).first()[0] or []):
            if w not in X.ENGLISH_STOP:
                n, first = want.get((i, stem(w)), (0, 99))
                want[i, stem(w)] = n + 1, min(first, at)
    got = R.term_table(c, stem=True)
    shuffles = plan(got).count("hashpartitioning"), plan(R.term_table(c)).count("hashpartitioning")
    assert {(r["chunk_id"], r["term"]): (r["tf"], r["first_pos"]) for r in got.collect()} == want
    # terms were shuffled to be counted, to meet their stems, and to be counted again
    assert shuffles == (1, 1)


WORDS = ["work", "Working", "job", "jobs", "ad job.", "coaCh", "ſervice", "worK", "jobıng", "İnsure", "vet", "velvet", "GP", "xgp", "gp_", "at Oslo", "at\x0bÅs", "at Oslo", "cat Oslo", "with 3", "for x", "joın", "Joining", "AS", "was", "kLinikk", "Bil", "mobile", "Dr. Moe, my dad", "lead; leader", "é job é", "", "😀boss😀"]


def test_hints_find_all_that_the_patterns_find(spark):
    d = spark.createDataFrame([(i, [w, f"So {w} it is", f"{w}{w}"]) for i, w in enumerate(WORDS)], "i int, said array<string>")
    got = EX.hinted(d).select("i", F.explode(F.arrays_zip("said", "hints")).alias("x")).select("i", "x.said", "x.hints")
    c = F.col("said")
    rows = got.select("said", "hints", EX.has_work_cue(c).alias("cue"), c.rlike(EX.PERSON_GATE).alias("who"), c.rlike(EX.ORG_GATE).alias("org")).collect()
    assert len(rows) == 3 * len(WORDS) and any(r["cue"] for r in rows) and any(r["who"] for r in rows) and any(r["org"] for r in rows)
    for r in rows:
        for flag, bit in (("cue", EX.HINT_CUE), ("who", EX.HINT_PERSON), ("org", EX.HINT_ORG)):
            assert r["hints"] & bit or not r[flag], (r["said"], flag)


def test_sentences_are_matched_only_where_a_hint_is(spark):
    texts = [(1, "My manager is Ann Berg. She joined Quay AS. Nothing here.\n\nNobody. The lead, Bo Moe, left."), (2, None), (3, ""), (4, "Plain words only.\n- bullet one\n- my dad Per Dal"), (5, "Dr. Eva Lie at Bay Clinic. Mr. X."), (6, "The Job is done. İnsured Advisor")]
    d = spark.createDataFrame(texts, "text_id int, text string")
    got = FA.sentence_table(d)
    low, c = F.lower("paragraph"), F.col("sentence")
    p = d.select("text_id", F.posexplode(EX.paragraphs(F.col("text"))).alias("para", "paragraph"))
    s = p.select("text_id", "para", "paragraph", F.posexplode(EX.sentences_of(F.col("paragraph"))).alias("sent", "sentence")).withColumn("cue", EX.has_work_cue(c))
    titled = F.when((F.col("sent") == 0) & low.rlike(EX.any_word(EX.TITLES)), low)
    want = s.select("text_id", "para", "sent", "sentence", "cue", EX.has_work_cue(F.col("paragraph")).alias("para_cue"), titled.alias("titled"), FA._people(EX.person_array(c)).alias("who"), EX.org_candidates(c, F.col("cue")).alias("cands"))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    # every word of the patterns was tried at every letter before
    assert "MapInArrow" in plan(got) and got.filter("cue").count() == 5


def test_opening_words_are_told_beside_the_scan(spark):
    lex = [("person", "1", "Ada Moe"), ("person", "2", "Bob"), ("org", "3", "Cyl Works Ltd."), ("person", "4", "(Eli)"), ("person", "5", "日本 Ann")]
    texts = [(1, "Ada Moe, Bob"), (2, None), (3, ""), (4, "cyl works ltd. and cyl works"), (5, "(eli)"), (5, "x(eli)"), (6, "日本 ann"), (None, "bob"), (7, "ada"), (8, " ... ")]
    df = E.known_mentions(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(lex, "type string, id string, name string"))
    # a run of pieces was made for each word of the texts before
    assert "MapInArrow" in plan(df)
    assert {(r["text_id"], r["id"]) for r in df.collect()} == {(1, "1"), (1, "2"), (4, "3"), (5, "4"), (6, "5"), (None, "2")}


def test_tokens_are_hashed_where_vectors_are_made(spark):
    def plain(word):
        h = EM.FNV_OFFSET
        for c in word:
            h = ((h ^ ord(c)) * EM.FNV_PRIME) & EM.MASK
        return h

    words = ["harbor", "a1", "漢字", "x" * 300, "", "lamp", "harbour", "漢"]
    assert EM.fnv1a(words).tolist() == [plain(w) for w in words] and EM.fnv1a([]).tolist() == []
    d = spark.createDataFrame([(1, "Harbor lamp harbor"), (2, "漢字漢 x"), (3, None), (4, "")], "id int, text string")
    # every character of a text was a step of a loop that Spark interprets before
    how = plan(EM.hash_vectors(d)), plan(EM.hash_weights(d))
    assert not any("aggregate(" in x.replace("Aggregate(", "") for x in how)
    assert {r["id"] for r in EM.hash_vectors(d).collect()} == {1, 2} == {r["id"] for r in EM.hash_weights(d).collect()}
