"""The automaton against the library, round trips, and the length histogram against counting."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearthgraph.llm import tokens
from hearthgraph.llm.automaton import Automaton

PATH = public_tokenizers.path("byte_bpe_50k.json")
MACHINE, LIBRARY = Automaton(PATH), Tokenizer.from_file(PATH)
BITS = ["a", "aa", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "the", "'s", "'re", "é", "é", "你", "½", "٣", "😀", "👨‍👩", "<|endoftext|>", "<|endof", "12", "_", "!!", "​", "\x00", "\r\n", "Ünder"]
ROWS = [(1, "The cat's <|endoftext|> tail, 12 times.  \n"), (2, None), (3, ""), (4, "a" * 60_000), (5, " " * 3_000), (1, "again"), (None, "no id"), (6, "😀" * 500)]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(BITS), max_size=14).map("".join)))
def test_automaton_is_the_library(text):
    ids = MACHINE.encode(text)
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert MACHINE.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_every_token_is_its_own_encoding():
    for t, label in enumerate(MACHINE.labels[:50_256]):
        assert MACHINE.path(label) == [t]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    got = sorted(tuple(r) for r in tokens.round_trip(df).na.fill(-1, ["doc_id"]).collect())
    want = []
    for k, t in ROWS:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if k is None else k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    there = tokens.decode(tokens.encode(df.where("doc_id > 1")))
    assert {r.doc_id: r.text for r in there.collect()} == {k: t or "" for k, t in ROWS if k and k > 1}


def test_histogram(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("length", F.lit("x"))
    enc = tokens.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    lens = [len(enc.encode_ordinary(t or "")) for _, t in ROWS]
    got = tokens.length_histogram(df)
    rows = {r.length: r for r in got.collect()}
    assert set(rows) == set(lens)
    for limit, r in rows.items():
        assert (r.n_docs, r.docs_over) == (lens.count(limit), sum(n > limit for n in lens))
        assert (r.tokens_over, r.truncated_total) == (sum(n for n in lens if n > limit), sum(min(n, limit) for n in lens))
        assert r.truncated_total + r.tokens_lost == sum(lens) and r.share == pytest.approx(sum(n <= limit for n in lens) / len(lens))
    for r in tokens.at_limits(got, [0, 3, 100, 10**6]).collect():
        assert (r.docs_over, r.truncated_total) == (sum(n > r.context for n in lens), sum(min(n, r.context) for n in lens))


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.round_trip(none).collect() == [] and tokens.length_histogram(none).collect() == []
