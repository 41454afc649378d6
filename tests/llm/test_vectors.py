"""Vector operators against brute force on small tables with awkward rows."""

import numpy as np
import pytest

from hearthgraph.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, h long"


def rows(n=240, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    out = []
    for i in range(n):
        v = centres[i % 9] + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.3, 2.0])
        out.append((i, [float(x) for x in np.float32(v)], int(i % 3) if i % 17 else None, "x", 1))
    out += [(1000, None, 1, "x", 1), (1001, [], 1, "x", 1), (1002, [0.0] * dim, 1, "x", 1), (1003, [float("nan")] + [1.0] * (dim - 1), 1, "x", 1)]
    out += [(1004, [None] + [1.0] * (dim - 1), 1, None, None), (1020, [float("inf")] * dim, 1, "x", 1), (1005, out[1][1], 1, "x", 1), (1006, out[1][1], 1, "x", 1)]
    out += [(1007, out[4][1], 1, "x", 1), (1007, out[4][1], 1, "x", 1), (None, out[1][1], 1, "x", 1), (1040, [1.0, 2.0], 1, "x", 1), (1060, [2.0, 4.0], 1, "x", 1)]
    return out


def brute_links(data, threshold):
    good = {}
    for i, v, g, *_ in data:
        if i is not None:
            good.setdefault(i, (v, g))
    ok = {i: (np.array(v, dtype=float), g) for i, (v, g) in good.items() if v and g is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    near = {i: set() for i in good}
    for i, (v, g) in ok.items():
        for j, (u, k) in ok.items():
            if i != j and g == k and len(u) == len(v) and v @ u / (np.sqrt(v @ v) * np.sqrt(u @ u)) >= threshold:
                near[i].add(j)
    root = {}
    for i in sorted(good):
        if i not in root:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = i
                    todo += near[x]
    return {i: (len(near[i]), root[i], root[i] == i) for i in good}


@pytest.mark.parametrize("block", [7, 1024])
def test_near_vectors(spark, block):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, block_rows=block).collect()}
    assert got == brute_links(data, 0.93)


def test_near_vectors_of_nothing(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    assert [tuple(r) for r in vectors.near_vectors(alone).collect()] == [(1, 0, 1, True)]


def test_a_group_of_near_copies_is_one_component(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=6)
    data = [(i, [float(x) for x in np.float32(base + rng.normal(size=6) * 0.02)], 0, "x", 1) for i in range(150)]
    got = vectors.near_vectors(spark.createDataFrame(data, SCHEMA), block_rows=16).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(149, 0)}


def brute_top(data, k, every, scale):
    good = {}
    for i, v, *_ in data:
        if i is not None:
            good.setdefault(i, v)
    dim = max(len(v or []) for v in good.values())
    ints = {i: np.floor(scale * np.array(list(v) + [0.0] * (dim - len(v)), dtype=float)).astype(int) for i, v in good.items() if v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in (i for i in ints if i % every == 0):
        best = sorted((-int(ints[q] @ ints[i]), i) for i in ints if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [5, 2048])
def test_top_scores(spark, block):
    data = rows(seed=1)
    data += [(2000 + i, data[9][1], 1, "x", 1) for i in range(60)]  # ties by the dozen
    got = sorted(tuple(r) for r in vectors.top_scores(spark.createDataFrame(data, SCHEMA), block_rows=block).collect())
    assert got == brute_top(data, 20, 20, 64)


def test_top_scores_of_nothing(spark):
    assert vectors.top_scores(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vectors.top_scores(spark.createDataFrame([(20, [1.0], 1, "", 1)], SCHEMA)).collect() == []


def test_top_scores_with_outliers(spark):
    data = [(i, [float(i % 7), -float(i % 5)], 1, "x", 1) for i in range(60)]
    out = vectors.top_scores(spark.createDataFrame([*data, (100, [5e7, 0.0], 1, "x", 1), (120, [1e30, 1.0], 1, "x", 1)], SCHEMA), block_rows=16)
    want = brute_top([*data, (100, [5e7, 0.0], 1, "x", 1)], 20, 20, 64)
    assert sorted(tuple(r) for r in out.collect()) == want
