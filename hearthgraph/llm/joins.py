"""Similarity join on word shingles by chosen paths, with exact verification inside candidate groups."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, pieces
from .words import Words, clean, mix

SHINGLE = 5
THRESHOLD = 0.8
#: Tokens of the fixed-size set that stands for a document while paths are chosen.
TOKENS = 64
#: Buckets of up to so many sets are compared pair by pair; larger ones are split again.
BUCKET = 256
#: Longest path. Buckets that are still large then, or that a split does not part, are compared in blocks.
DEPTH = 3
#: Sets of one block of a large bucket; a task compares two blocks at a time.
PAIR_ROWS = 4096
TARGET_RECALL = 0.9999
#: Documents, and words, of one block of the exact comparison.
BLOCK_ROWS, BLOCK_WORDS = 512, 400_000

_rng = np.random.default_rng(99)
_A = _rng.integers(1, 2**63, size=TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 2**63, size=TOKENS, dtype=np.uint64)


def _name(text: bytes) -> int:
    """The id of a class: 64 bits of the digest of its words."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of each run of k words; a text of fewer words is one shingle, an empty one none."""
    at = words.whole(k)
    doc, h = words.doc[at], words.grams(k)[at]
    n = np.diff(words.first)
    for short in range(1, k):
        which = np.flatnonzero(n == short)
        if len(which):
            doc = np.concatenate([doc, which])
            h = np.concatenate([h, words.grams(short)[words.first[which]] + np.uint64(short)])
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order]


def sketches(words: Words, k: int = SHINGLE) -> np.ndarray:
    """The smallest value of each of TOKENS hash functions over a text's shingles (texts without words: zeros)."""
    doc, h = shingles(words, k)
    out = np.zeros((len(words.first) - 1, TOKENS), dtype=np.uint32)
    if len(doc):
        heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        for i in range(TOKENS):
            out[doc[heads], i] = np.minimum.reduceat(h * _A[i] + _B[i], heads) >> np.uint64(32)
    return out


def _choose(tokens: np.ndarray, path: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, longer path) for each token that the path's random function picks, with probability `rate` each."""
    salt = mix(np.arange(1, TOKENS + 1, dtype=np.uint64))
    v = mix(mix(path[:, None] + salt[None, :]) + tokens.astype(np.uint64))
    row, i = np.nonzero(mix(v) < np.uint64(int(rate * 2.0**64)))
    return row, v[row, i]


def _sketch(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint32).reshape(-1, TOKENS)


def _paths(rate: float, roots: list[int] | None):
    """The next level: from the roots (one for each run), or from the path that a row has, with that path and its size."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            tokens = _sketch(b.column("sketch"))
            if roots is None:
                steps = [b.column("path").to_numpy().view(np.uint64)]
            else:
                steps = [np.full(len(tokens), r, dtype=np.uint64) for r in roots]
            got = [_choose(tokens, p, rate) for p in steps]
            row, path = pa.array(np.concatenate([g[0] for g in got])), np.concatenate([g[1] for g in got])
            out = {"path": pa.array(path.view(np.int64)), "c": b.column("c").take(row)}
            if roots is None:
                out |= {"parent": b.column("path").take(row), "m": b.column("n").take(row)}
            yield pa.RecordBatch.from_pydict(out)

    return run


def run_count(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has met with probability `recall`, if its buckets are split to DEPTH.

    Each of the pair's tokens is common with probability `threshold`. With m common tokens, a run keeps the pair for one
    more level with probability 1 - (1 - rate * s)^m, s being the probability for the levels below; runs are
    independent once m is known.
    """
    rate = 1 / (threshold * TOKENS)
    odds, lost = [], []
    for m in range(TOKENS + 1):
        s = 1.0
        for _ in range(DEPTH):
            s = 1 - (1 - rate * s) ** m
        odds.append(math.comb(TOKENS, m) * threshold**m * (1 - threshold) ** (TOKENS - m))
        lost.append(1 - s)
    runs = 1
    while sum(p * q**runs for p, q in zip(odds, lost)) > 1 - recall:
        runs += 1
    return runs


def _candidates(low: float):
    """A spanning forest (a, b) over the sets of one block, or of two blocks of a bucket, that may be similar.

    Every pair that agrees in `low` of the tokens or more is tied. A tie is passed on only if it joins two trees, so a
    task sends fewer ties than it reads rows; it holds two blocks of a bucket at most.
    """

    def close(held):
        tokens = np.concatenate([_sketch(b.column("sketch")) for b in held])
        who = np.concatenate([b.column("c").to_numpy() for b in held])
        half = None
        if held[0].column("i")[0].as_py() != held[0].column("j")[0].as_py():
            half = int(np.concatenate([b.column("side").to_numpy(zero_copy_only=False) for b in held]).argmax())  # sides are sorted
        mark = np.arange(len(who))
        rest = len(who) if half is None else half
        for lo in range(0, rest, BUCKET):
            hi = min(lo + BUCKET, rest)
            start = lo if half is None else half
            linked = _agree(tokens[lo:hi], tokens[start:]) >= math.ceil(low * TOKENS)
            for i in np.flatnonzero(linked.any(axis=1)):
                near = mark[start:][linked[i]]
                if (near != mark[lo + i]).any():
                    groups = np.append(np.unique(near), mark[lo + i])
                    mark[np.isin(mark, groups)] = groups.min()
        at = np.flatnonzero(mark != np.arange(len(mark)))
        return pa.RecordBatch.from_arrays([pa.array(who[mark[at]], pa.int64()), pa.array(who[at], pa.int64())], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for new, b in pieces(batches, ["path", "i", "j"]):
            if new and held:
                yield close(held)
                held = []
            held.append(b)
        if held:
            yield close(held)

    return run


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of equal tokens of each row of x with each row of y."""
    out = np.zeros((len(x), len(y)), dtype=np.uint8)
    for i in range(TOKENS):
        out += x[:, i][:, None] == y[:, i][None, :]
    return out


def _overlaps(rows: list[np.ndarray]) -> np.ndarray:
    """How many members each two sorted sets share, by products of their 0/1 rows over the members of two or more sets."""
    size = np.array([len(r) for r in rows])
    member, at = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.uint64), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), size)
    often = np.bincount(at, minlength=len(member)) > 1
    column = np.cumsum(often) - 1
    keep = often[at]
    row, at = row[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    total = np.zeros((len(rows), len(rows)), dtype=np.float64)
    wide = max(64, min(8192, (1 << 22) // max(1, len(rows))))
    for lo in range(0, int(often.sum()), wide):
        a, b = np.searchsorted(at, [lo, lo + wide])
        d = np.zeros((len(rows), wide), dtype=np.float32)
        d[row[a:b], at[a:b] - lo] = 1
        total += d @ d.T
    return total


def similar_groups(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, k: int = SHINGLE, recall: float = TARGET_RECALL) -> DataFrame:
    """Links between texts whose sets of `k`-word shingles have a Jaccard similarity of `threshold` or more.

    Returns (key, class_id, n_links), one row per row: the smallest key that links reach, and the number of other
    documents linked directly. Words are runs without ASCII white space, unchanged. A text of fewer than k words is
    one shingle; a null text or one without words links with nothing, not even its like. Rows without key are
    returned without class and links. Rows with equal key and text count once; an empty table gives no rows.

    Method (chosen paths). Texts with the same words form a class. Each class is sketched by TOKENS minimum hashes.
    In each run, a random function of the path so far picks 1 / threshold of the tokens of a set (in expectation) and
    sends the set to a bucket for each; a similar pair meets again with near certainty in one of the runs, whose
    number follows from the target recall for a pair whose buckets are all split (run_count). Buckets of two to BUCKET
    sets are compared, larger ones are split by the next token, up to paths of DEPTH tokens. If the parts
    of a bucket hold more than half as many rows as it had (near copies never separate), it is compared unsplit.
    All pairs of a bucket are compared, in pairs of blocks dealt out by a hash, so no task holds a large bucket.
    Sketches in a bucket give candidate ties, their components candidate groups.
    Inside a group all pairs are verified with the real shingles, in blocks of bounded size that report link counts
    and a spanning forest; so within a group no link is lost, whichever bucket tied it.
    """
    kind = dict(df.dtypes)[key]
    docs = df.select(F.col(key).alias("doc"), F.col(text).alias("text"))

    def sketch(batches):
        for b in batches:
            texts = [clean(t.as_py()) for t in b.column("text")]
            words = Words(texts)
            s = sketches(words, k)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), pa.array([_name(t) if t else None for t in texts], pa.int64()), pa.array(np.diff(words.first)), pa.array([r.tobytes() for r in s], pa.binary())],
                ["doc", "c", "nw", "sketch"],
            )

    every = materialize(docs.mapInArrow(sketch, f"doc {kind}, c long, nw long, sketch binary"), "sketches")
    once = every.where("doc is not null and c is not null")
    classes = once.dropDuplicates(["doc", "c"]).groupBy("c").agg(F.min("doc").alias("rep"), F.count("*").alias("w"), F.first("nw").alias("nw"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "classes")
    sets = classes.select("c", "sketch")

    rate = 1 / (threshold * TOKENS)
    roots = mix(np.arange(1, run_count(threshold, recall) + 1, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D)).tolist()
    step = sets.mapInArrow(_paths(rate, roots), "path long, c long")
    leaves = large = None
    for depth in range(DEPTH):
        sizes = step.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        step = materialize(step.join(sizes, "path"), "buckets")
        if large is not None:
            kept = step.groupBy("parent", "m").agg(F.count("*").alias("k")).where("2 * k > m").select("parent")
            kept = materialize(kept, "unparted")
            leaves = leaves.unionByName(large.join(kept.withColumnRenamed("parent", "path"), "path", "left_semi").select("path", "c", "n"))
            step = step.join(kept, "parent", "left_anti")
        large = step.where(F.col("n") > BUCKET)
        last = depth == DEPTH - 1 or large.isEmpty()
        done = (step if last else step.where(F.col("n") <= BUCKET)).select("path", "c", "n")
        leaves = done if leaves is None else leaves.unionByName(done)
        if last:
            break
        step = large.join(sets, "c").select("path", "n", "c", "sketch").mapInArrow(_paths(rate, None), "path long, c long, parent long, m long")
    # estimates from 64 tokens stray by 0.06; ties leave room for that
    blocks = F.ceil(F.col("n") / PAIR_ROWS).cast("int")
    met = leaves.join(sets, "c").withColumn("own", F.pmod(F.xxhash64("c"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("path", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), "c", "sketch")
    met = met.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j", "side", "c")
    ties = met.mapInArrow(_candidates(threshold - 0.25), "a long, b long").distinct()
    group = components(ties)
    group = group.unionByName(group.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "c")
    group = classes.select("c", "rep", "w", "nw").join(group, "c")
    sizes = group.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("nw") / BLOCK_WORDS)).cast("int").alias("nb"))
    group = materialize(group.join(sizes, "root"), "groups")

    def spell(batches):
        for b in batches:
            texts = [clean(t.as_py()) for t in b.column("text")]
            words = Words(texts)
            doc, h = shingles(words, k)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            same = np.array([_name(t) for t in texts], dtype=np.int64) == b.column("c").to_numpy()
            mine = np.flatnonzero(same)  # a repeated key may bring other texts
            lists = pa.array([np.unique(h[cut[i] : cut[i + 1]]).view(np.int64) for i in mine], pa.list_(pa.int64()))
            out = b.select(["root", "c", "w", "nb"]).take(pa.array(mine))
            yield pa.RecordBatch.from_arrays([out.column(c) for c in ("root", "c", "w", "nb")] + [lists], ["root", "c", "w", "nb", "set"])

    # the groups grow with the corpus, so the texts are dealt out at every size
    spelt = docs.join(group.hint("merge"), docs["doc"] == group["rep"]).select("root", "c", "w", "nb", "text")
    spelt = spelt.mapInArrow(spell, "root long, c long, w long, nb int, set array<long>")
    own = F.pmod(F.xxhash64("c"), F.col("nb")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    dealt = spelt.withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), "c", "w", "set")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "c")

    def verify(batches):
        held: list[pa.RecordBatch] = []

        def close():
            who = np.concatenate([h.column("c").to_numpy() for h in held])
            _, first = np.unique(who, return_index=True)  # repeated rows
            weight = np.concatenate([h.column("w").to_numpy() for h in held])[first]
            side = np.concatenate([h.column("side").to_numpy(zero_copy_only=False) for h in held])[first]
            pair = held[0].column("i")[0].as_py() != held[0].column("j")[0].as_py()
            rows = [np.asarray(h.column("set")[i].values) for h in held for i in range(h.num_rows)]
            rows = [rows[i] for i in first]
            who = who[first]
            size = np.array([len(r) for r in rows], dtype=np.float64)
            both = _overlaps(rows)
            linked = both / np.maximum(size[:, None] + size[None, :] - both, 1) >= threshold
            np.fill_diagonal(linked, False)
            if pair:
                linked &= side[:, None] != side[None, :]
            mark = np.arange(len(who))
            for i in range(len(who)):
                groups = np.unique(mark[linked[i]])
                if len(groups) and (len(groups) > 1 or groups[0] != mark[i]):
                    groups = np.union1d(groups, mark[i])
                    mark[np.isin(mark, groups)] = groups[0]
            return pa.RecordBatch.from_arrays([pa.array(who), pa.array((linked @ weight).astype(np.int64)), pa.array(who[mark])], ["c", "n", "to"])

        for new, b in pieces(batches, ["root", "i", "j"]):
            if new and held:
                yield close()
                held = []
            held.append(b)
        if held:
            yield close()

    told = materialize(dealt.mapInArrow(verify, "c long, n long, to long"), "verified")
    links = told.groupBy("c").agg(F.sum("n").alias("n"))
    roots = components(told.select(F.col("c").alias("a"), F.col("to").alias("b")))
    placed = classes.select("c", "rep", "w").join(links, "c", "left").join(roots.withColumnRenamed("node", "c"), "c", "left")
    placed = placed.select("c", "rep", F.coalesce("root", "c").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    named = placed.join(placed.groupBy("root").agg(F.min("rep").alias("class_id")), "root").select("c", "class_id", "n_links")
    out = every.select("doc", "c").join(named, "c", "left").select("doc", F.when(F.col("doc").isNotNull(), F.coalesce("class_id", "doc")).alias("class_id"), F.when(F.col("doc").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))
    return out.withColumnRenamed("doc", key)
