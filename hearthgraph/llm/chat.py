"""Conversations rendered with a template, encoded once, and a loss mask aligned by offsets."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

# The template: <turn>role<text>text</turn>, one after another.
TURN, TEXT, END = "<turn>", "<text>", "</turn>"
LEARNED = "assistant"
#: Characters after which a conversation is encoded in a further segment, at the start of a turn.
SEGMENT = 1 << 18

# A control string inside a role or text gets a backslash after its first character, and one more if it has some.
_CONTROL = r"(turn>|text>|/turn>|\|endoftext\|>)"
_INSIDE = re.compile(r"<(\\*)" + _CONTROL)
_ESCAPED = re.compile(r"<\\(\\*)" + _CONTROL)
_PARSE = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return _INSIDE.sub(r"<\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1\2", text)


_TOKENIZERS: dict = {}


def tokenizer(path: str):
    """The library's tokenizer, in which the template's control strings are tokens of their own."""
    if path not in _TOKENIZERS:
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        t.add_special_tokens([AddedToken(x, normalized=False) for x in (TURN, TEXT, END)])
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for each token that lies in one of the sorted spans, found by binary search."""
    if not spans:
        return np.zeros(len(starts), dtype=bool)
    lo, hi = np.array(spans, dtype=np.int64).T
    at = np.searchsorted(lo, starts, side="right") - 1
    return (at >= 0) & (ends <= hi[np.maximum(at, 0)]) & (starts < ends)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered turns, and the spans of the texts that are learned."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + END)
        at += len(out[-1])
    return "".join(out), spans


def format_conversations(df: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, segment, text, ids, starts, ends, loss): the rendered conversations, tokens, offsets and loss mask.

    Turns are ordered by number, then role and text; nulls come first and count as empty text or role. Rows without
    conv_id belong to none and are left out. Repeated rows are repeated turns. An empty table gives no rows.

    A conversation is one segment, or several that begin at a turn if it is very long, so that a task holds one
    segment however long a conversation is. Control strings are tokens of their own, so the tokens of the segments are
    the tokens of the whole, and no token reaches over the border of a text. Each segment is encoded once; a token is
    in the mask if its offsets lie in the span of an assistant's text, which a binary search over the spans decides.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    none = F.lit("")
    rows = df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    fields = ["conv_id", "segment", "text", "ids", "starts", "ends", "loss"]

    def run(batches):
        enc = tokenizer(path)
        turns: list[tuple[str, str]] = []
        size = number = 0
        conv = None

        def close():
            text, spans = render(turns)
            e = enc.encode(text, add_special_tokens=False)
            at = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
            loss = mask(at[:, 0], at[:, 1], spans)
            return pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([number], pa.int32()), pa.array([text]), *(pa.array([x], pa.list_(pa.int32())) for x in (e.ids, at[:, 0], at[:, 1])), pa.array([loss], pa.list_(pa.bool_()))], fields)

        for new, b in pieces(batches, ["conv_id"]):
            if new:
                if turns:
                    yield close()
                turns, size, number, conv = [], 0, 0, b.column("conv_id")[0].as_py()
            for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist()):
                if size >= SEGMENT:
                    yield close()
                    turns, size, number = [], 0, number + 1
                turns.append((role, text))
                size += len(role) + len(text)
        if turns:
            yield close()

    return rows.mapInArrow(run, "conv_id long, segment int, text string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, taken from the rendered text and the mask alone; segments must be in order."""

    def run(batches):
        state = None  # conv, turns, sha of the turns, learned characters, their sha, characters

        def close():
            conv, n, turns, chars, loss, size = state
            return pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([n]), pa.array([turns.hexdigest()]), pa.array([chars]), pa.array([loss.hexdigest()]), pa.array([size])], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for new, b in pieces(batches, ["conv_id"]):
            if new:
                if state:
                    yield close()
                state = [b.column("conv_id")[0].as_py(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for i, text in enumerate(b.column("text").to_pylist()):
                state[5] += len(text)
                for m in _PARSE.finditer(text):
                    state[1] += 1
                    state[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                loss = np.asarray(b.column("loss")[i].values.to_numpy(zero_copy_only=False), dtype=bool)
                starts, ends = b.column("starts")[i].values.to_numpy()[loss], b.column("ends")[i].values.to_numpy()[loss]
                if not len(starts):
                    continue
                # tokens of one text touch or overlap (parts of a character); between two texts stand control tokens
                reach = np.maximum.accumulate(ends)
                cut = np.concatenate([[True], starts[1:] > reach[:-1]])
                for s, e in zip(starts[cut], np.append(reach[:-1][cut[1:]], reach[-1])):
                    plain = unescape(text[s:e])
                    state[3] += len(plain)
                    state[4].update(plain.encode("utf-8", "surrogatepass"))
        if state:
            yield close()

    return formatted.select("conv_id", "text", "starts", "ends", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
