"""The prefix trie against brute force over all beginnings, at capacities that burst never, sometimes and always."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hearthgraph.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, n long, ids string, depth int"


def ordered(rows):
    none = lambda x: (x is not None, x if x is not None else 0)
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((none(turn), role or "", text or ""))
    return {c: [t[1:] for t in sorted(v)] for c, v in own.items()}


def rebuilt(rows):
    own = ordered(rows)
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {p: 0 for p in members}
    saved = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in members.items()}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves = {p: int(not kids[p]) for p in members}
    for p in sorted(members, key=len, reverse=True):
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else -(10**9), len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def got(seqs, capacity=prefixes.CAPACITY):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in prefixes.prefix_trie(seqs, capacity).na.fill(-(10**9), ["parent_conv_id"]).select(cols).collect())


def taken():
    conv = F.col("conv_id")
    return conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9


def some_rows(seed, convs=70):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        c = c - 8 if c % 11 else c * 1000
        kind = rng.random()
        turns = ["system", "hello", "long start"] * 4 if kind < 0.3 else [rng.choice(["a", "b", "é", "", None]) for _ in range(rng.randrange(9))]
        turns = turns + [rng.choice(["x", "y"]) for _ in range(rng.randrange(4))]
        for i, t in enumerate(turns):
            rows.append((c, i if rng.random() < 0.95 else None, rng.choice(["user", "user", None]) if kind >= 0.3 else "user", t))
    rows += [(None, 0, "user", "no id"), (9000, 1, "user", "tie"), (9000, 1, "user", "eit"), (9000, 1, "user", "tie"), (9000, None, "", "")]
    rows += [(9101, 0, "ab", "c"), (9102, 0, "a", "bc"), (9103, 0, "ab", "c"), (9103, 1, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,capacity", [(1, 1), (3, 12), (5, prefixes.CAPACITY)])
def test_any_capacity(spark, seed, capacity):
    rows = some_rows(seed)
    assert got(prefixes.sequences(frame(spark, rows)), capacity) == brute(ordered(rows))


def test_rebuilt(spark):
    rows = some_rows(7, 120)
    assert got(prefixes.sequences(frame(spark, rows), *taken()), 40) == brute(rebuilt(rows))


def test_copies_and_a_long_conversation(spark):
    # a third are copies, one is very long, many share a long beginning, one has no turn left
    rows = [(c, i, "user", f"same {i}") for c in range(0, 9000, 5) for i in range(2)]
    rows += [(20001, i, "user", f"turn {i % 977}" * (i % 3)) for i in range(20_000)]
    rows += [(30000 + c, i, "user", "shared" if i < 40 else f"own {c % 50}") for c in range(100) for i in range(41 + c % 2)]
    convs = ordered(rows)
    want = {(r[0], r[1]): r for r in got(prefixes.sequences(frame(spark, rows)), 500)}
    assert len(want) == sum(1 for _ in want) and want[(0, 2)][3] == 1800 and want[(0, 2)][7] == hashlib.sha256(",".join(map(str, range(0, 9000, 5))).encode()).hexdigest()
    del convs[20001]
    small = [r for r in rows if r[0] != 20001]
    assert got(prefixes.sequences(frame(spark, small)), 500) == brute(convs)
    assert want[(20001, 20_000)][4:6] == (0, 1) and want[(20001, 1)][5] == 1 and want[(0, 0)][3] == len(convs) + 1


def test_turnless_and_nothing(spark):
    only = [(c, 0, "user", "x") for c in range(1, 40)]
    assert got(prefixes.sequences(frame(spark, only), *taken()), 1) == brute(rebuilt(only))
    assert any(not t for t in rebuilt(only).values())
    assert got(prefixes.sequences(frame(spark, []))) == [] and got(prefixes.sequences(frame(spark, [(None, 1, "user", "x")]))) == []


def test_query(spark):
    from hearthgraph.llm import queries
    from tests.conftest import SF

    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    out = queries.QUERIES["op13_prefix_trie"](spark, SF)
    assert sorted(tuple(r) for r in out.na.fill(-(10**9), ["parent_conv_id"]).collect()) == brute(rebuilt(rows))
