"""Similarity join and substring removal against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from hearthgraph.llm import joins, phrases
from hearthgraph.llm.common import Forest

SCHEMA = "doc_id long, text string, source string, c long, n long, anchor string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def table(spark, docs):
    return spark.createDataFrame([(k, t, "s", 1, 2, None) for k, t in docs], SCHEMA)


def corpus(seed=0, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(70)]
    docs = []
    for i in range(n):
        kind = i % 6
        own = [r.choice(vocab) for _ in range(r.randint(20, 120))]
        if kind == 1 and docs:  # near copy
            own = words_of(docs[r.randrange(len(docs))][1])
            for _ in range(max(1, len(own) // 60)):
                if own:
                    own[r.randrange(len(own))] = r.choice(vocab)
        elif kind == 2:  # a passage between own words
            own = own[:15] + passage[r.randint(0, 20) :] + own[15:]
        elif kind == 3:  # a word over and over
            own = own[:10] + ["ja"] * r.randint(25, 90) + own[10:]
        elif kind == 4 and docs:  # exact copy, other white space
            own = words_of(docs[r.randrange(len(docs))][1])
        docs.append((i * 3 + 1, r.choice([" ", "\n", "\t "]).join(own)))
    docs += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "one two"), (505, "é ü one two three four five " * 30), (506, "x " * 40_000)]
    r.shuffle(docs)
    return docs


def brute_removal(docs, window):
    seen, out = set(), {}
    for k, t in sorted(docs):
        w = words_of(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            run = tuple(w[s : s + window])
            if run in seen:
                gone[s : s + window] = [True] * window
            seen.add(run)
        out[k] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("window,hot,shard", [(20, 5_000, 2_048), (20, 2, 8), (6, 3, 16), (1, 4, 8)])
def test_remove_repeats(spark, monkeypatch, window, hot, shard):
    monkeypatch.setattr(phrases, "SHARD", shard)
    docs = corpus(window)
    got = phrases.remove_repeats(table(spark, docs), window=window, hot=hot).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_removal(docs, window)


def test_repeated_rows_and_rows_without_key(spark):
    long = " ".join(f"v{i}" for i in range(30))
    got = phrases.remove_repeats(table(spark, [(1, long), (1, long), (None, long), (2, "a " + long)]), carry=["source"]).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.kept) for r in got) == [(0, 0, long), (1, 0, long), (1, 0, long), (2, 30, "a")]
    assert {r.source for r in got} == {"s"}
    assert phrases.remove_repeats(table(spark, [])).collect() == []


def brute_groups(docs, threshold):
    sets = {}
    for k, t in docs:
        w = words_of(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    near = {k: {j for j in sets if j != k and sets[k] & sets[j] and len(sets[k] & sets[j]) / len(sets[k] | sets[j]) >= threshold} for k in sets}
    root = {}
    for k in sorted(sets):
        todo = [k]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = k if k == min(root.get(k, k), k) else root[k]
                todo += near[x]
    return {k: (root[k], len(near[k])) for k in sets}


@pytest.mark.parametrize("bucket,block", [(256, 512), (2, 3)])
def test_similar_groups(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(joins, "BUCKET", bucket)
    monkeypatch.setattr(joins, "BLOCK_ROWS", block)
    docs = corpus(5)
    got = joins.similar_groups(table(spark, docs)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute_groups(docs, 0.8)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(joins, "BUCKET", 8)
    monkeypatch.setattr(joins, "BLOCK_ROWS", 16)
    r = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for i in range(90):
        own = list(base)
        own[r.randrange(150)] = f"n{i}"
        docs.append((i, " ".join(own)))
    got = joins.similar_groups(table(spark, docs)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute_groups(docs, 0.8)


def test_pairs_at_the_threshold_outlast_all_splits(spark, monkeypatch):
    monkeypatch.setattr(joins, "BUCKET", 1)  # every bucket is split
    docs = []
    for i in range(1500):  # 50 shingles of 62 are shared: 0.806
        own = [f"{i}w{k}" for k in range(60)]
        docs += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:54] + [f"{i}x{k}" for k in range(6)]))]
    got = joins.similar_groups(table(spark, docs)).collect()
    assert sum(r.class_id != r.doc_id - r.doc_id % 2 or r.n_links != 1 for r in got) <= 2


def test_runs_follow_from_the_deepest_level():
    rate, sure = 1 / (0.8 * joins.TOKENS), 0.0
    for m in range(joins.TOKENS + 1):
        s = 1.0
        for _ in range(joins.DEPTH):
            s = 1 - (1 - rate * s) ** m
        sure += math.comb(joins.TOKENS, m) * 0.8**m * 0.2 ** (joins.TOKENS - m) * (1 - (1 - s) ** joins.run_count(0.8, 0.9999))
    assert sure >= 0.9999


def test_every_pair_of_a_large_bucket_is_compared():
    r = np.random.default_rng(1)
    n, nb = 700, 3
    sketch = r.integers(0, 2**32, (n, joins.TOKENS), dtype=np.uint32)
    for i in range(1, n):  # chains of sets that agree with the one before only
        if i % 5:
            sketch[i, :40] = sketch[i - 1, :40][r.permutation(40)] if i % 7 == 0 else sketch[i - 1, :40]
    rows = []
    for c in range(n):
        own = c * 7919 % nb
        rows += [(1, min(own, o), max(own, o), own > o, c, sketch[c].tobytes()) for o in range(nb)]
    rows.sort(key=lambda x: x[:5])
    names = ["path", "i", "j", "side", "c", "sketch"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in rows[k : k + 100]]) for k in range(0, len(rows), 100)]
    forest, ties = Forest(), 0
    for b in joins._candidates(0.55)(iter(batches)):
        ties += b.num_rows
        for a, z in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            forest.join(a, z)
    want = Forest()
    for a, z in zip(*np.nonzero((sketch[:, None, :] == sketch[None, :, :]).sum(axis=2) >= 0.55 * joins.TOKENS)):
        want.join(int(a), int(z))
    assert [forest.find(c) for c in range(n)] == [want.find(c) for c in range(n)] and ties < len(rows)


def test_large_buckets_are_dealt_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BUCKET", 4)
    monkeypatch.setattr(joins, "PAIR_ROWS", 8)
    docs = corpus(7, 90) + [(1000 + i, " ".join([f"b{k}" for k in range(120)] + [f"n{i}"])) for i in range(70)]
    got = joins.similar_groups(table(spark, docs)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute_groups(docs, 0.8)


def test_groups_of_awkward_rows(spark):
    t = "a b c d e f g"
    got = joins.similar_groups(table(spark, [(1, t), (1, t), (2, t), (None, t), (3, None), (4, None), (1, "x y z u v w")])).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in got) == [(0, 0, 0), (1, 1, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]
    assert joins.similar_groups(table(spark, [])).collect() == []
