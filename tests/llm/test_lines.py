"""Line dedup against brute force: awkward rows, positions, thresholds."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearthgraph.llm import lines

SPACE = " \t\n\x0b\x0c\r"
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
SAME, OTHER = "One licence line for all.", "ÜBER allen Gipfeln ist Ruh"


def brute(rows, min_chars=10, min_docs=2):
    key = lambda x: x.strip(SPACE).translate(LOWER)
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        gone = [i is not None and len(held.get(key(x), ())) >= min_docs and i != min(held[key(x)]) for x in all_lines]
        out.append((-99 if i is None else i, len(all_lines), sum(gone), "\n".join(x for x, g in zip(all_lines, gone) if not g)))
    return sorted(out)


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("pos", "k1", "doc", "t", "gone", "line")})
    return sorted(tuple(r) for r in lines.drop_repeated_lines(df, **more).na.fill(-99, ["doc_id"]).collect())


ROWS = [
    (5, f"{SAME}\nmine alone, five\n\n{SAME}"),
    (7, f"\t {SAME.upper()} \r\nshort\nshort\n{SAME}\nmine alone, seven\n"),
    (7, f"{SAME}\na second row of seven"),
    (2, f"{OTHER}\n short\n"),
    (9, f"{OTHER}\n{OTHER.lower()}\nüber allen Gipfeln ist Ruh"),
    (9, f"{OTHER}\n{OTHER.lower()}\nüber allen Gipfeln ist Ruh"),
    (11, None),
    (12, ""),
    (13, "\n\n"),
    (None, f"{SAME}\n{SAME}"),
    (-3, "only with tabs\x85\nonly with tabs\x85  "),
    (14, "only with tabs\x85"),
    (15, "ten chars!\nnine char"),
    (16, "TEN CHARS!\nnine char"),
    (17, "\n".join(f"long text, line {i}" if i % 3 else SAME for i in range(30_000))),
    (18, "\n".join(f"long text, line {i}" for i in range(0, 30_000, 2))),
    (19, SAME),
]


@pytest.mark.parametrize("more", [{}, {"min_docs": 3}, {"min_chars": 1}, {"min_docs": 1, "min_chars": 30}])
def test_awkward_rows(spark, more):
    assert got(spark, ROWS, **more) == brute(ROWS, **more)


def test_everything_dropped(spark):
    assert got(spark, [(1, SAME), (2, SAME), (3, f"{SAME}\n{SAME}")]) == [(1, 1, 0, SAME), (2, 1, 1, ""), (3, 2, 2, "")]


def test_nothing(spark):
    assert got(spark, []) == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = lines.drop_repeated_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.lists(st.sampled_from([SAME, SAME + " ", "x" * 10, "X" * 10, "x" * 9, "", " ", "É" * 10, "é" * 10, "\x00" * 10]), max_size=8).map("\n".join)), max_size=12))
def test_any_rows(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_query(spark):
    from hearthgraph.llm import queries
    from tests.conftest import SF

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)]
    out = queries.QUERIES["op12_line_dedup"](spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, out)) == want and sum(x[2] for x in want) > 0
