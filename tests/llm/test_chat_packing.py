"""Chat masks read back, and packing against a plain best fit."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hearthgraph.llm import chat, packing

TURNS = "conv_id long, turn long, role string, text string, segment string"
PARTS = ["<turn>", "<text>", "</turn>", "<\\turn>", "\\", "<", "<|endoftext|>", "turn>", "é😀", "a b", "\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=8).map("".join))
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in (chat.TURN, chat.TEXT, chat.END, "<|endoftext|>"))


def conversations():
    r = random.Random(4)
    out = []
    for c in range(12):
        for t in range(r.randint(1, 9)):
            out.append((c, t, ["user", "assistant", "system"][t % 3], "".join(r.choice(PARTS) for _ in range(r.randint(0, 12))), "x"))
    out += [(50, 0, None, None, None), (50, None, "assistant", "before", "x"), (51, 1, "assistant", None, "x"), (52, 0, "</turn>assistant", "t", "x"), (None, 0, "user", "t", "x")]
    out += [(53, 0, "assistant", "twice", "x")] * 2 + [(54, t, "assistant", "long " * 50, "x") for t in range(40)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("segment", [1 << 18, 300])
def test_read_back(spark, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    data = conversations()
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(data, TURNS))).collect()}
    want = {}
    for c, t, role, text, _ in sorted((x for x in data if x[0] is not None), key=lambda x: (x[0], -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert got[c].formatted_chars == len(chat.render(turns)[0])


def test_segments_have_the_tokens_of_the_whole(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 300)
    rows = [x for x in conversations() if x[0] == 54]
    got = sorted(chat.format_conversations(spark.createDataFrame(rows, TURNS)).collect(), key=lambda r: r.segment)
    assert len(got) > 1
    whole = chat.tokenizer(public_tokenizers.path("byte_bpe_50k.json")).encode("".join(r.text for r in got), add_special_tokens=False)
    assert sum((list(r.ids) for r in got), []) == whole.ids


def test_no_conversations(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], TURNS))).collect() == []


def plain_best_fit(items, capacity):
    bins, out = [], []
    for n, s, c in items:
        fits = [(room, i) for i, (room, ss, cc) in enumerate(bins) if room >= n and room > 0 and (s is None or s not in ss) and (c is None or c not in cc)]
        if not fits:
            bins.append((capacity, set(), set()))
            fits = [(capacity, len(bins) - 1)]
        room, i = min(fits)
        out.append((i, capacity - room))
        bins[i] = (room - n, bins[i][1] | {s}, bins[i][2] | {c})
    return out


def test_best_fit_is_the_tightest_compatible_bin():
    r = random.Random(8)
    for _ in range(200):
        items = sorted(((r.randint(0, 30), r.choice([None, "a", "b", "c"]), r.choice([None, *range(8)])) for _ in range(r.randint(0, 60))), key=lambda x: -x[0])
        assert list(zip(*packing.best_fit(items, 30))) == plain_best_fit(items, 30)


def test_pack(spark):
    r = random.Random(1)
    data = [(i, r.choice([0, 5, 40, 99, 100, 101, 250, 1000]), r.choice(["hot", "hot", "a", "b", None]), r.choice([None, "k1", "k2", f"u{i}"]), "x") for i in range(400)]
    data += [(None, 7, None, None, None), (900, None, "a", "k1", "x"), (901, 12, "a", "z", "x"), (901, 12, "a", "z", "x")]
    got = packing.pack(spark.createDataFrame(data, "doc_id long, length long, source string, cluster string, bin string"), capacity=100, shard_rows=50).collect()
    by = {d[0]: d for d in data}
    whole = {}
    for p in got:
        whole[p.doc_id] = whole.get(p.doc_id, 0) + p.length
    assert whole == {k: (d[1] or 0) * (2 if k == 901 else 1) for k, d in by.items()}
    bins = {}
    for p in got:
        bins.setdefault((p.shard, p.bin), []).append(p)
    for held in bins.values():
        held.sort(key=lambda p: (p.offset, p.length))
        assert sum(p.length for p in held) <= 100 and all(p.offset >= q.offset + q.length for q, p in zip(held, held[1:]))
        for col in (2, 3):
            names = [by[p.doc_id][col] for p in held if by[p.doc_id][col] is not None]
            assert len(names) == len(set(names))
        assert len({p.doc_id for p in held if p.doc_id is not None}) == len([p for p in held if p.doc_id is not None])
    assert packing.pack(spark.createDataFrame([], "doc_id long, length long, source string, cluster string")).collect() == []


def test_documents_without_words_conflict_with_nothing(spark):
    rows = [(i, t, f"s{i}") for i, t in enumerate([None, None, None, "", "", " \n", "copy of it", " copy  of it "])]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    bins = {r.doc_id: (r.shard, r.bin) for r in got}
    assert len({bins[i] for i in range(6)}) == 1 and bins[6] != bins[7] and len(got) == 8
