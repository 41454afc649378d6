"""Removal of passages that stand earlier in the corpus, by automata of recurring phrases."""

from __future__ import annotations

import hashlib
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces
from .words import Words, clean, first_of_each, minimizers

WINDOW = 20
#: Documents that share an anchor from which on its windows are dealt out one by one.
HOT = 5_000
#: Segments of one automaton.
SHARD = 2_048


def _anchors(words: Words, window: int):
    """(starts, counts, anchor hashes) of the runs of windows that share an anchor and are new in their text.

    A window is a run of `window` words in one text; its anchor is its smallest shorter run. Equal windows have equal
    anchors at equal places, so two windows can only be equal if their anchors are.
    """
    k = max(1, window * 2 // 5)
    starts = words.whole(window)
    if not len(starts):
        return starts, starts, np.zeros(0, dtype=np.int64)
    gram = words.grams(k)
    at = minimizers(gram, window - k + 1)[starts]
    new = first_of_each(words.doc[starts], words.grams(window)[starts])
    starts, at = starts[new], at[new]
    cut = np.ones(len(starts), dtype=bool)
    cut[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(cut)
    counts = np.diff(np.append(head, len(starts)))
    return starts[head], counts, gram[at[head]].view(np.int64)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int = HOT, carry: list[str] | None = None) -> DataFrame:
    """Remove each word covered by a window of `window` words whose word sequence also starts earlier.

    Earlier means a smaller key, or the same document and an earlier start; windows are judged on the input. Returns
    (key, n_words, n_removed, kept_sha256); with `carry` also kept (the words left, joined by one space), the text as
    it came, and the columns named. A null text has no words. Rows without key are compared with nothing but themselves. Rows that share a key are told apart by
    their text (in the order of its hash); repeated equal rows count as one document and each get its result.
    An empty table gives no rows.

    Method. Exact copies of a text are settled by its digest: only the first of them is compared. Each document's
    windows are grouped by anchor (a minimizer), and anchors in more than one document are counted; only segments
    around such anchors can hold recurring passages. A segment's words go to the shard of its anchor. A shard reads its
    segments in document order, confirms the windows that recur word by word, compiles them into an automaton, and
    streams the segments through it, which locates every occurrence: all but the first are marked. Windows around
    anchors of more than `hot` documents are dealt out one by one, by the hash of the window, so that no shard gets a
    whole hot passage. Marks return to their documents, where the covered words are removed.
    """
    kind = dict(df.dtypes)[key]
    extra = {f"x{i}": c for i, c in enumerate(carry or [])}
    docs = df.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(c).alias(x) for x, c in extra.items()]).withColumn("th", F.xxhash64("text"))
    known = docs.where("doc is not null")
    firsts = materialize(known.select("doc", "th", F.sha2("text", 256).alias("sha")).distinct(), "digests")
    owner = firsts.groupBy("sha").agg(F.min(F.struct("doc", "th")).alias("o"))
    status = firsts.join(owner, "sha").select("doc", "th", (F.struct("doc", "th") != F.col("o")).alias("copy"))

    def find(batches):
        for b in batches:
            words = Words([clean(t.as_py()) for t in b.column("text")])
            start, count, anchor = _anchors(words, window)
            row = words.doc[start]
            out = b.select(["doc", "th"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([out.column("doc"), out.column("th"), pa.array((start - words.first[row]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor)], ["doc", "th", "start", "n", "anchor"])

    def find_once(batches):
        for b in batches:
            words = Words([clean(t.as_py()) for t in b.column("text")])
            start, _, anchor = _anchors(words, window)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[first_of_each(words.doc[start], anchor)])], ["anchor"])

    many = known.select("text").mapInArrow(find_once, "anchor long").groupBy("anchor").agg(F.count("*").alias("docs")).where("docs > 1")
    every = known.select("doc", "th", "text").mapInArrow(find, f"doc {kind}, th long, start int, n int, anchor long")
    shared = every.join(many, "anchor").select("doc", "th", "start", "n", "anchor", (F.col("docs") > hot).alias("hot"))
    own = shared.join(status.where("not copy"), ["doc", "th"], "left_semi").groupBy("doc", "th").agg(F.collect_list(F.struct("start", "n", "anchor", "hot")).alias("at"))
    own = materialize(own, "anchors")

    def segments(batches):
        for b in batches:
            texts = [clean(t.as_py()) for t in b.column("text")]
            routes, rows, starts, counts, parts = [], [], [], [], []
            for i, (t, at) in enumerate(zip(texts, b.column("at").to_pylist())):
                words, grams = t.split(b" "), None
                for a in at:
                    s, n = a["start"], a["n"]
                    if a["hot"]:
                        if grams is None:
                            grams = Words([t]).grams(window).view(np.int64)
                        todo = [(s + j, 1, int(grams[s + j])) for j in range(n)]
                    else:
                        todo = [(s, n, a["anchor"])]
                    for s1, n1, route in todo:
                        routes.append(route)
                        rows.append(i)
                        starts.append(s1)
                        counts.append(n1)
                        parts.append(b" ".join(words[s1 : s1 + n1 + window - 1]))
            out = b.select(["doc", "th"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(routes, pa.int64()), out.column("doc"), out.column("th"), pa.array(starts, pa.int32()), pa.array(counts, pa.int32()), pa.array(parts, pa.binary())], ["route", "doc", "th", "start", "n", "words"])

    parts = known.join(own, ["doc", "th"]).mapInArrow(segments, f"route long, doc {kind}, th long, start int, n int, words binary")
    parts = parts.repartition("route").sortWithinPartitions("route", "doc", "th", "start")

    def locate(batches):
        waiting: list[tuple] = []  # (doc, th, start, n, words) of whole groups, or of a part of one group
        seen: set[bytes] = set()  # digests of the windows of the group that is not at its end

        def flush(goes_on: bool):
            nonlocal waiting
            marks = _locate([w[4] for w in waiting], [w[3] for w in waiting], window, seen, goes_on)
            found = [(w[0], w[1], w[2], m) for w, m in zip(waiting, marks) if m]
            waiting = []
            if found:
                d, t, s, m = zip(*found)
                return pa.RecordBatch.from_arrays([pa.array(d, doc_type), pa.array(t, pa.int64()), pa.array(s, pa.int32()), pa.array(m, pa.int64())], ["doc", "th", "start", "mark"])

        doc_type = None
        for new, b in pieces(batches, ["route"]):
            doc_type = b.schema.field("doc").type
            if new:
                if len(waiting) >= SHARD or seen:
                    if (out := flush(False)) is not None:
                        yield out
                    seen.clear()
            last = None
            for row in zip(*(b.column(c).to_pylist() for c in ("doc", "th", "start", "n", "words"))):
                if row[:3] != last and (new or not waiting or row[:3] != waiting[-1][:3]):  # a repeated row is one document
                    waiting.append(row)
                last = row[:3]
            if len(waiting) >= 2 * SHARD:
                if (out := flush(True)) is not None:
                    yield out
        if waiting and (out := flush(False)) is not None:
            yield out

    marks = parts.mapInArrow(locate, f"doc {kind}, th long, start int, mark long")
    marks = marks.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "mark")).alias("marks"))

    through = ["text", *extra] if carry else []

    def strip(batches):
        for b in batches:
            texts = [clean(t.as_py()) for t in b.column("text")]
            words = Words(texts)
            grams, starts = words.grams(window), words.whole(window)
            repeat = np.zeros(words.n + 1, dtype=bool)
            repeat[starts[~first_of_each(words.doc[starts], grams[starts])]] = True
            copies = b.column("copy").to_pylist()
            n_removed, kept, shas = [], [], []
            for i, (t, marks) in enumerate(zip(texts, b.column("marks").to_pylist())):
                lo, hi = int(words.first[i]), int(words.first[i + 1])
                n = hi - lo
                for m in marks or []:
                    bits, j = m["mark"], 0
                    while bits:
                        if bits & 1:
                            repeat[lo + m["start"] + j] = True
                        bits >>= 1
                        j += 1
                edge = np.zeros(n + window + 1, dtype=np.int64)
                at = np.flatnonzero(repeat[lo:hi])
                if copies[i] and n >= window:
                    at = np.arange(n - window + 1)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge)[:n] > 0
                n_removed.append(int(gone.sum()))
                left = b" ".join(w for w, g in zip(t.split(b" "), gone.tolist()) if not g) if len(at) else t
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "surrogatepass") if carry else None)
            counts = np.diff(words.first)
            brought = [b.column(c) for c in through]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(counts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string()), *brought], ["doc", "n_words", "n_removed", "kept_sha256", "kept", *through])

    told = status.join(marks, ["doc", "th"], "left")
    kinds = dict(docs.dtypes)
    out = f"doc {kind}, n_words long, n_removed long, kept_sha256 string, kept string" + "".join(f", {c} {kinds[c]}" for c in through)
    cols = ["doc", "text", *extra]
    main = known.join(told, ["doc", "th"]).select(*cols, "copy", "marks").mapInArrow(strip, out)
    nothing = F.lit(None).cast("array<struct<start:int,mark:bigint>>").alias("marks")
    nameless = docs.where("doc is null").select(*cols, F.lit(False).alias("copy"), nothing).mapInArrow(strip, out)
    also = ["kept", F.col("text"), *[F.col(x).alias(c) for x, c in extra.items()]] if carry else []
    return main.unionByName(nameless).select(F.col("doc").alias(key), "n_words", "n_removed", "kept_sha256", *also)


def _locate(parts: list[bytes], counts: list[int], window: int, seen: set[bytes], goes_on: bool) -> list[int]:
    """For each segment the windows (bits) that stood before, in an earlier segment or in `seen`; adds to `seen` if the group goes on."""
    ids: dict[bytes, int] = {}
    name = ids.setdefault
    rows = [tuple([name(w, len(ids)) for w in p.split(b" ")]) for p in parts]
    times = Counter(r[j : j + window] for r, n in zip(rows, counts) for j in range(n))
    words = list(ids)
    digest = lambda r: hashlib.blake2b(b" ".join([words[i] for i in r]), digest_size=16).digest()
    known = {r for r in times if digest(r) in seen} if seen else set()
    again = [r for r, k in times.items() if k > 1 or r in known]
    if goes_on:
        seen.update(digest(r) for r in times)
    if not again:
        return [0] * len(rows)
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, r in enumerate(again):
        machine.add_word(r, i)
    machine.make_automaton()
    met = [r in known for r in again]
    out = []
    for r, n in zip(rows, counts):
        mark = 0
        for end, i in machine.iter(r):
            j = end - window + 1
            if met[i]:
                mark |= 1 << j
            met[i] = True
        out.append(mark)
    return out
