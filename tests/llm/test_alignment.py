"""Alignment against the libraries and set arithmetic: groups, links, corpus counts."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearthgraph.llm import alignment
from hearthgraph.llm.automaton import byte_letters

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
LETTERS = byte_letters()
PIECES = alignment.Pieces.load(*alignment._paths(None, None))


def a_bytes(i):
    return bytes(LETTERS[c] for c in A.id_to_token(i))


def b_bytes(i):
    p = B.id_to_piece(i)
    m = re.fullmatch("<0x([0-9A-F]{2})>", p)
    return bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()


def brute_one(text):
    """(a ids, b ids, groups, linked pairs) by the sets of all ends."""
    if not text:
        return [], [], [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    whole = (" " + text).encode()
    if b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
        return [], [], [], []
    ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((a_bytes, a), (b_bytes, b))]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups, links, i, j = [], [], 0, 0
    for c in cuts:
        p, q = ends[0].index(c, i) + 1, ends[1].index(c, j) + 1
        groups.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
        links.append((a[p - 1], b[q - 1]))
        i, j = p, q
    return a, b, groups, links


def brute(rows):
    parts = [(k, *brute_one(t)) for k, t in rows]
    count = Counter(x for p in parts for x in p[4])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for k, a, b, groups, links in parts:
        said = ";".join(groups)
        out.append((-99 if k is None else k, len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return sorted(out)


COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
LONG = "The quick 棕色的狐狸 jumps over 13 lazy dogs; naïve façade – Straße! " * 400 + "zzz" * 3000 + " 你好" * 500
ROWS = [
    (1, "The cat's <|endoftext|> tail, 12 times.  \n"), (2, None), (3, ""), (4, "a" * 5_000), (5, " " * 300), (1, "again and again"), (None, "no id, but counted"), (6, "😀" * 500), (7, LONG),
    (8, "▁ is a sign that is lost"), (9, "two  spaces\n\n and <0x41> <s> </s> <unk>"), (10, "\x00\x01 control"), (11, "The cat's tail, 12 times."), (12, "The cat's tail, 12 times."), (13, "ﬁ ligature ① ½"), (14, " leading and trailing "),
]


@settings(max_examples=250, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["the", " ", "  ", "\n", "é", "你", "😀", "▁", "<0x0A>", "'s", "12", "tion", "ing", "zz", "\t", "½"]), max_size=30).map("".join)))
def test_one_text(text):
    x = alignment.Aligned(PIECES, ["before", text, None, text + "!"])
    for k, t in ((1, text), (3, text + "!")):
        a, b, groups, links = brute_one(t)
        assert x.groups()[k].decode() == ";".join(groups) and (x.n_a[k], x.n_b[k], x.n_groups[k]) == (len(a), len(b), len(groups))
        at = np.concatenate([[0], np.cumsum(x.n_groups)])
        assert x.links()[at[k] : at[k + 1]].tolist() == [p * len(PIECES.b_bytes) + q for p, q in links]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 60), max_size=40), st.sets(st.integers(0, 60), max_size=40)), min_size=1, max_size=5))
def test_cuts_of_many_spans(parts):
    ends = [np.array([v + 100 * k for k, p in enumerate(parts) for v in sorted(p[side])], dtype=np.int64) for side in (0, 1)]
    to = [np.concatenate([[0], np.cumsum([len(p[side]) for p in parts])]) for side in (0, 1)]
    i, j = alignment.shared_cuts(*ends, np.stack([to[0][:-1], to[0][1:], to[1][:-1], to[1][1:]], axis=1))
    assert ends[0][i].tolist() == ends[1][j].tolist() == sorted(set(ends[0].tolist()) & set(ends[1].tolist()))


@pytest.mark.parametrize("hot", [1, 40, alignment.HOT_PAIRS])
def test_weighed(spark, hot):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("links", "row", "n", "key")})
    got = alignment.weigh(df, hot=hot).na.fill(-99, ["doc_id"])
    assert got.columns == COLS and sorted(map(tuple, got.collect())) == brute(ROWS)


def test_groups_text_and_nothing(spark):
    df = spark.createDataFrame(ROWS[:1], "doc_id long, text string")
    assert alignment.align(df, groups=True).first().groups == ";".join(brute_one(ROWS[0][1])[2])
    assert alignment.weigh(df.limit(0)).collect() == []
    assert alignment.weigh(spark.createDataFrame(ROWS[1:3], "doc_id long, text string")).count() == 2


def test_query(spark):
    from hearthgraph.llm import queries
    from tests.conftest import SF

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op11_tokenizer_alignment"](spark, SF).select(COLS).collect())) == brute(rows)
