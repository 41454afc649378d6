import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthgraph.operators import chunking as C
from hearthgraph.operators import retrieval as R


def test_vector_arm_paths_agree_with_brute_force(spark):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(300, 8))
    qs = rng.normal(size=(11, 8))
    v = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(vecs)], "chunk_id bigint, embedding array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(qs)], "query_id bigint, embedding array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(qs) @ unit(vecs).T, 6)
    want = {(i, j) for i in range(11) for j in sorted(range(300), key=lambda j: (-sims[i, j], j))[:5]}
    small = {(r["query_id"], r["chunk_id"]) for r in R.vector_arm(q, v, limit=5).collect()}
    waves = [(r["query_id"], r["chunk_id"]) for r in R.vector_arm(q, v, limit=5, small_rows=4).collect()]
    assert small == want == set(waves) and len(waves) == len(want)


def test_best_of_a_task_equals_the_best_of_all_rows():
    rng = np.random.default_rng(1)
    vecs, qs = rng.integers(-1, 2, size=(400, 3)).astype(float), rng.normal(size=(300, 3))  # many ties
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    sims = np.round(unit(qs) @ unit(vecs).T, 6)
    ids = rng.permutation(400)
    frame = pd.DataFrame({"chunk_id": ids, "embedding": list(vecs)})
    got = R._best_of_task((frame.iloc[lo : lo + 37] for lo in range(0, 400, 37)), unit(qs), 6)
    want = {(i, ids[j]) for i in range(300) for j in sorted(range(400), key=lambda j: (-sims[i, j], ids[j]))[:6]}
    assert {(r.query_id, r.chunk_id) for r in got.itertuples()} == want and len(got) == len(want)


def test_vectors_are_not_shuffled(spark):
    v = spark.range(500).selectExpr("id as chunk_id", "array(cast(id as double), 1d) as embedding")
    near, _ = R._near_some(v.limit(3).selectExpr("chunk_id as query_id", "embedding").toPandas(), v, "query_id bigint, chunk_id bigint, cosine double", 5)
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()


def test_salted_join_equals_plain_join(spark):
    big = spark.range(2000).select(F.col("id").alias("chunk_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("term"))
    small = spark.createDataFrame([(1, "hot"), (2, "hot"), (2, "t7")], "query_id int, term string")
    plain = sorted(tuple(r) for r in big.join(small, "term").select("query_id", "chunk_id").collect())
    assert sorted(tuple(r) for r in R.salted_join(big, small, "term", "chunk_id").select("query_id", "chunk_id").collect()) == plain


@pytest.mark.parametrize("scores,keep", [([9.0, -5.0, -5.2, -6.0], 1), ([8.0, 7.8, 7.5, -4.0, -4.4], 3), ([5.0, 4.0, 3.0, 2.0, 1.0], 5), ([1.0], 1), ([2.0, 2.0], 2)])
def test_cliff(spark, scores, keep):
    df = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate(scores)], "query_id int, new_rank int, rerank double")
    assert R.cliff_cut(df).count() == keep


def test_rerank_keeps_order_on_bad_scores(spark):
    ranked = spark.createDataFrame([(q, f"c{i}", i) for q in (1, 2, 3) for i in range(1, 5)], "query_id int, chunk_id string, rank int")
    scores = spark.createDataFrame(
        [(1, f"c{i}", float(i)) for i in range(1, 5)] + [(2, "c1", 1.0), (2, "c2", float("nan")), (2, "c3", 3.0), (2, "c4", 2.0)] + [(3, "c1", 1.0)],
        "query_id int, chunk_id string, rerank double",
    )
    out = {(r["query_id"], r["chunk_id"]): r["new_rank"] for r in R.reorder_head(ranked, scores, head=3).collect()}
    assert [out[1, f"c{i}"] for i in range(1, 5)] == [3, 2, 1, 4]
    assert [out[2, f"c{i}"] for i in range(1, 5)] == [1, 2, 3, 4]
    assert [out[3, f"c{i}"] for i in range(1, 5)] == [1, 2, 3, 4]


def test_sections(spark):
    md = "intro\n# A\none\n### C\nthree\n## B\ntwo\n\n# D\n"
    got = C.split_sections(spark.createDataFrame([(1, md)], "id int, text string")).orderBy("section").collect()
    assert [(r["heading"], r["text"]) for r in got] == [("", "intro"), ("A", "one"), ("A > C", "three"), ("A > B", "two")]


def test_chunk_sizes_overlap_and_coverage(spark):
    words = [f"w{i}" + ("." if i % 9 == 8 else "") for i in range(900)]
    han = "山" * 900
    pages = spark.createDataFrame(
        [(1, "T", "# H\n" + " ".join(words), 1), (2, "", han, 1), (3, "S", "short text", 1), (4, "E", "# only heading", 2), (5, "N", "  \n ", 1)],
        "id int, title string, text string, tier int",
    )
    rows = C.chunk_pages(pages).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["parent_id"], r["ord"])):
        by.setdefault(r["parent_id"], []).append(r["text"])
    assert all(t.startswith("T > H\n\n") for t in by[1]) and len(by[1]) == 3
    bodies = [t.split("\n\n", 1)[1].split() for t in by[1]]
    assert all(len(b) <= 440 for b in bodies)
    assert {w for b in bodies for w in b} == set(words)
    for a, b in zip(bodies, bodies[1:]):
        assert a[-40:] == b[:40]
    assert all(len(t.replace("\n", "").replace(" ", "")) <= 440 for t in by[2]) and len(by[2]) > 1
    assert by[3] == ["S\n\nshort text"]
    assert by[4] == ["E\n\n# only heading"]
    assert 5 not in by


def test_result_does_not_depend_on_partitions(spark):
    chunks = spark.createDataFrame(
        [(f"c{i}", "page", i // 3, i % 3, f"harbor lamp w{i % 5} " * (i % 4 + 1), 1) for i in range(60)],
        "chunk_id string, parent_type string, parent_id int, ord int, text string, tier int",
    )
    q = spark.createDataFrame([(1, "harbor w3"), (2, "lamp")], "query_id int, query string")
    a = R.lexical_arm(q, chunks.repartition(1), limit=7).orderBy("query_id", "rank").collect()
    b = R.lexical_arm(q, chunks.repartition(13), limit=7).orderBy("query_id", "rank").collect()
    assert a == b and len(a) == 14


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 7, "query_rows": 2}])
def test_scoped_vectors_are_the_nearest_of_their_haystacks(spark, sizes):
    rng = np.random.default_rng(2)
    vecs, qs = rng.normal(size=(90, 5)), rng.normal(size=(9, 5))
    member = {j: {j % 3, 3 + j % 2} for j in range(90)}
    asked = {i: {i % 3} if i % 2 else {i % 3, 3 + i % 2} for i in range(9)}
    v = spark.createDataFrame([(j, j, [float(x) for x in vecs[j]]) for j in range(90)] + [(500, 500, None)], "chunk_id bigint, parent_id bigint, embedding array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in qs[i]]) for i in range(9)], "query_id bigint, embedding array<double>")
    has = spark.createDataFrame([(j, g) for j, gs in member.items() for g in gs] + [(500, 0)], "parent_id bigint, g int")
    asks = spark.createDataFrame([(i, g) for i, gs in asked.items() for g in gs], "query_id bigint, g int")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(qs) @ unit(vecs).T, 6)
    want = {(i, j) for i in range(9) for j in sorted((j for j in range(90) if member[j] & asked[i]), key=lambda j: (-sims[i, j], j))[:6]}
    got = [(r["query_id"], r["chunk_id"]) for r in R.scoped_vector_arm(q, v, (asks, has), limit=6, **sizes).collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_scorer_fails_open(spark):
    def scorer(rows):
        n, kind = len(rows), rows["query_id"].iloc[0]
        if kind == 1:
            raise RuntimeError("no")
        if kind == 2:
            time.sleep(5)
        good = [float(i) for i in range(n)]
        answers = {3: good[:-1], 4: [*good[:-1], float("inf")], 5: [*good[:-1], None], 6: [(0, 1.0)] * n, 7: [(i, -float(i)) for i in reversed(range(n))], 8: ["x"] * n, 9: good + [1.0]}
        return answers.get(kind, good)

    ranked = spark.createDataFrame([(q, f"c{i}", i) for q in range(11) for i in range(1, 5)], "query_id int, chunk_id string, rank int")
    said = R.ask_scorer(ranked.filter("rank <= 3"), scorer, seconds=1.0).cache()
    why = {r["query_id"]: r["reason"] for r in said.collect()}
    assert {q for q, w in why.items() if w is None} == {0, 7, 10} and why[1] == "raised RuntimeError" and why[2] == "too late" and why[3] == "2 scores for 3 rows"
    out = R.reorder_head(ranked, said, head=3).collect()
    order = {q: [r["chunk_id"] for r in sorted(out, key=lambda r: r["new_rank"]) if r["query_id"] == q] for q in range(11)}
    assert order[0] == order[10] == ["c3", "c2", "c1", "c4"] and order[7] == ["c1", "c2", "c3", "c4"]
    assert all(order[q] == ["c1", "c2", "c3", "c4"] for q in range(1, 10))
