"""Every shared prefix of a table of conversations, by burst tries: containers of suffixes under heads, burst where too large, then swept."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import pieces

#: Turns (of different conversations) that a container may hold before it is burst.
CAPACITY = 1 << 14
#: Ids in one block of a list of copies, and rows of one output batch.
BLOCK = 4096

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NONE = hashlib.sha256(b"").hexdigest()
_HEAD = ["h1", "h2"]


def _sent(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)


def sequences(df: DataFrame, base: Column | None = None, taken: Column | None = None, most: int = 8) -> DataFrame:
    """(conv_id, ids, sizes): a row for each conversation; two numbers (128 bits of role and text) and the UTF-8 bytes of the text for each turn.

    Turns are ordered by number, then role and text, nulls first; null roles and texts are empty. Rows without conv_id
    belong to none. With `base` (a conversation's id, itself a base of its own) and `taken`, the first `taken` turns, at
    most `most`, come from the base as far as it has them, and then the conversation's own turns after its first
    `taken` follow. A conversation without any turn left keeps its row, with empty lists.

    One shuffle, by base; turns are then read as a sorted stream of which a task holds the numbers (24 bytes a turn)
    of one conversation and `most` turns of its base, and no texts.
    """
    none = F.lit("")
    conv = F.col("conv_id").cast("long")
    rows = df.where("conv_id is not null").select(
        (conv if base is None else base).cast("long").alias("g"),
        conv.alias("c"),
        (F.lit(0) if taken is None else taken).cast("int").alias("h"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", none).alias("role"),
        F.coalesce("text", none).alias("text"),
    )
    rows = rows.repartition("g").sortWithinPartitions("g", F.col("c") != F.col("g"), "c", "turn", "role", "text")
    rows = rows.select("g", "c", "h", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "role", "text").alias("b"), F.octet_length("text").cast("long").alias("size"))
    schema = pa.schema([("conv_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])

    def run(batches):
        out, held = [], 0
        key, first, parts = None, np.zeros((0, 3), np.int64), []

        def close():
            nonlocal first
            g, c, h = key
            own = np.concatenate(parts)
            if c == g:
                first = own[:most].copy()
            turns = np.concatenate([first[:h], own[h:]])
            return c, turns[:, :2].ravel(), turns[:, 2]

        for new, b in pieces(batches, ["g", "c"]):
            g, c, h = (b.column(k)[0].as_py() for k in ("g", "c", "h"))
            if new:
                if key:
                    out.append(close())
                    held += len(out[-1][2]) + 8
                    if held > BLOCK:
                        yield _sent(out, schema)
                        out, held = [], 0
                    if g != key[0]:
                        first = np.zeros((0, 3), np.int64)
                key, parts = (g, c, h), []
            parts.append(np.stack([b.column(k).to_numpy() for k in ("a", "b", "size")], axis=1))
        if key:
            out.append(close())
            yield _sent(out, schema)

    return rows.mapInArrow(run, "conv_id long, ids array<long>, sizes array<long>")


def copies(seqs: DataFrame) -> DataFrame:
    """(s1, s2, conv_id, n, ends): equal sequences as one row: the smallest id, how many, the digest of all their ids in order.

    A digest is sequential, but the list is not gathered by one task: ids are dealt out by range, so that a very large
    group of copies lies on many tasks, each of which writes its part as blocks of text; one stream reads the blocks.
    """
    same = ["s1", "s2"]
    dealt = seqs.select(*same, "conv_id").repartitionByRange(*same, "conv_id").sortWithinPartitions(*same, "conv_id")
    kinds = [("s1", pa.int64()), ("s2", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64())]
    block, whole = pa.schema([*kinds, ("ids", pa.string())]), pa.schema([*kinds, ("ends", pa.string())])

    def write(batches):
        out, key, ids = [], None, []
        close = lambda: out.append((*key, ids[0], len(ids), ",".join(map(str, ids))))
        for new, b in pieces(batches, same):
            if ids and (new or len(ids) >= BLOCK):
                close()
                ids = []
            if len(out) >= BLOCK:
                yield _sent(out, block)
                out = []
            key = b.column("s1")[0].as_py(), b.column("s2")[0].as_py()
            ids += b.column("conv_id").to_pylist()
        if ids:
            close()
        yield _sent(out, block)

    def read(batches):
        out, now = [], None  # s1, s2, smallest id, count, digest
        close = lambda: out.append((*now[:4], now[4].hexdigest()))
        for new, b in pieces(batches, same):
            if new:
                if now:
                    close()
                if len(out) >= BLOCK:
                    yield _sent(out, whole)
                    out = []
                now = [b.column("s1")[0].as_py(), b.column("s2")[0].as_py(), b.column("conv_id")[0].as_py(), 0, hashlib.sha256()]
            for n, ids in zip(b.column("n").to_pylist(), b.column("ids").to_pylist()):
                now[4].update((("," if now[3] else "") + ids).encode())
                now[3] += n
        if now:
            close()
        yield _sent(out, whole)

    blocks = dealt.mapInArrow(write, "s1 long, s2 long, conv_id long, n long, ids string")
    return blocks.repartition(*same).sortWithinPartitions(*same, "conv_id").mapInArrow(read, "s1 long, s2 long, conv_id long, n long, ends string")


def _turns(ids: str = "ids") -> Column:
    return F.expr(f"cast(size({ids}) div 2 as long)")


def burst(entries: DataFrame, capacity: int) -> tuple[DataFrame, list[DataFrame]]:
    """(entries in containers that need no bursting, one table of burst heads for each round).

    An entry is a distinct sequence; its container is the subtrie below its first `depth` turns, named by 128 bits of
    these (h1, h2). A container of more than `capacity` turns and more than one entry is burst: its smallest and
    largest entry show how far all its entries agree (`at` turns: the head's chain of nodes), and the next turn's id
    names the container that an entry goes to. So every burst parts the entries, and a group with a long common
    beginning costs one round. An entry that ends with the chain becomes the `ends` of its last node.
    """
    zero, nothing = F.lit(0).cast("long"), F.lit(None).cast("long")
    now = materialize(entries.select("*", zero.alias("h1"), zero.alias("h2"), nothing.alias("q1"), nothing.alias("q2"), zero.alias("depth"), nothing.alias("parent")), "containers")
    small, heads = [], []
    while True:
        load = now.groupBy(*_HEAD).agg(F.sum(_turns() - F.col("depth") + 1).alias("turns"), F.count("*").alias("entries"))
        large = materialize(load.where((F.col("turns") > capacity) & (F.col("entries") > 1)).select(*_HEAD), "oversized")
        if large.isEmpty():
            return _union([*small, now]), heads
        small.append(now.join(large, _HEAD, "left_anti"))
        full = now.join(large, _HEAD, "left_semi")
        tops = full.groupBy(*_HEAD, "q1", "q2", "depth", "parent").agg(F.min(F.struct("ids", "sizes")).alias("lo"), F.max("ids").alias("hi"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"))
        agree = F.zip_with("lo.ids", "hi", lambda x, y: x.eqNullSafe(y))
        tops = tops.withColumn("at", F.floor((F.array_position(agree, F.lit(False)) - 1) / 2))
        tops = materialize(tops.select(*_HEAD, "q1", "q2", "depth", "parent", "at", "n", "conv_id", F.slice("lo.sizes", F.lit(1), F.col("at").cast("int")).alias("sizes")), "heads")
        met = full.join(tops.select(*_HEAD, "at", F.col("conv_id").alias("top")), _HEAD)
        here = met.where(_turns() == F.col("at")).select(*_HEAD, "ends")
        heads.append(tops.join(here, _HEAD, "left"))
        name = F.slice("ids", F.lit(1), (2 * F.col("at") + 2).cast("int"))
        now = materialize(
            met.where(_turns() > F.col("at")).select(
                *entries.columns, F.xxhash64(name).alias("h1"), F.xxhash64(F.lit(1), name).alias("h2"), F.col("h1").alias("q1"), F.col("h2").alias("q2"), (F.col("at") + 1).alias("depth"), F.col("top").alias("parent")
            ),
            "containers",
        )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_SWEPT = pa.schema([(c, pa.string() if c == "ends_sha256" else pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "q1", "q2")])


class Sweep:
    """Nodes of one container from its sorted entries: the path to the last entry is open, the rest is closed."""

    def __init__(self, depth: int, parent: int | None, q1: int | None, q2: int | None):
        self.top = (depth, parent, q1, q2)
        self.path: list[list] = []  # depth, bytes of the last text, n, smallest id, children, leaves, saved, ends, rows of children
        self.rows: list[list] = []
        self.last = None

    def add(self, ids: np.ndarray, sizes: list[int], conv: int, n: int, ends: str) -> None:
        if self.last is None:
            common = self.top[0] - 1
        else:
            m = min(len(ids), len(self.last))
            differ = np.flatnonzero(ids[:m] != self.last[:m])
            common = int(differ[0] if len(differ) else m) // 2
        self.last = ids
        self.close(common)
        for d in range(common + 1, len(ids) // 2 + 1):
            self.path.append([d, sizes[d - 1] if d else 0, 0, conv, 0, 0, 0, _NONE, []])
        end = self.path[-1]
        end[2], end[3], end[7] = n, conv, ends

    def close(self, common: int) -> None:
        """Close the open nodes that lie deeper."""
        while self.path and self.path[-1][0] > common:
            depth, size, n, conv, children, leaves, saved, ends, below = self.path.pop()
            leaves, saved = leaves or 1, saved + (n - 1) * size
            for r in below:
                self.rows[r][2] = conv
            top = () if self.path else self.top[1:]
            self.rows.append([conv, depth, *(top[:1] or (None,)), n, children, leaves, saved, ends, *(top[1:] or (None, None))])
            if self.path:
                up = self.path[-1]
                up[2] += n
                up[3] = min(up[3], conv)
                up[4] += 1
                up[5] += leaves
                up[6] += saved
                up[8].append(len(self.rows) - 1)


def sweep(containers: DataFrame) -> DataFrame:
    """The nodes of all containers: their entries are sorted, and a path moves over them. A task holds one container, or one entry if that is longer."""

    def run(batches):
        out, now, key = [], None, None
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in ("h1", "h2", "depth", "parent", "q1", "q2", "conv_id", "n", "ends")}
            ids, sizes = b.column("ids"), b.column("sizes")
            for i in range(b.num_rows):
                head = cols["h1"][i], cols["h2"][i]
                if head != key:
                    if now:
                        now.close(-1)
                        out += now.rows
                        if len(out) >= BLOCK:
                            yield _sent(out, _SWEPT)
                            out = []
                    key, now = head, Sweep(cols["depth"][i], cols["parent"][i], cols["q1"][i], cols["q2"][i])
                now.add(ids[i].values.to_numpy(zero_copy_only=False), sizes[i].as_py(), cols["conv_id"][i], cols["n"][i], cols["ends"][i])
        if now:
            now.close(-1)
            out += now.rows
        yield _sent(out, _SWEPT)

    return containers.repartition(*_HEAD).sortWithinPartitions(*_HEAD, "ids").mapInArrow(run, f"{NODE}, q1 long, q2 long")


def _chains(heads: DataFrame, below: DataFrame) -> DataFrame:
    """The nodes of burst heads, given the sums (h1, h2, children, leaves, saved) of the containers below each."""
    size = lambda d: F.when(d > 0, F.get("sizes", (d - 1).cast("int"))).otherwise(0)
    chain = F.transform(F.sequence("depth", "at"), lambda d: F.struct(d.alias("d"), size(d).alias("size")))
    one = heads.join(below, _HEAD).withColumn("x", F.explode(chain)).drop("sizes").select("*", "x.d", "x.size")
    deeper = Window.partitionBy(*_HEAD).orderBy(F.desc("d"))
    top, last = F.col("d") == F.col("depth"), F.col("d") == F.col("at")
    return one.select(
        "conv_id",
        F.col("d").alias("depth"),
        F.when(top, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * F.sum("size").over(deeper)).cast("long").alias("saved_tokens"),
        F.when(last & F.col("ends").isNotNull(), F.col("ends")).otherwise(F.lit(_NONE)).alias("ends_sha256"),
        F.when(top, F.col("q1")).alias("q1"),
        F.when(top, F.col("q2")).alias("q2"),
    )


def prefix_trie(seqs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each distinct beginning (of d turns) of the conversations (conv_id, ids, sizes), which must have one row each.

    conv_id is the smallest member, that is conversation that begins so; depth is d; parent_conv_id belongs to the
    beginning of d - 1 turns (null for the root, d = 0, of which all are members); n_convs counts members, n_children
    the beginnings one turn longer, n_leaves those in the subtree (itself included) that none prolongs; saved_tokens
    sums (n_convs - 1) times the bytes of the last text over the subtree; ends_sha256 is the digest of the ids of the
    conversations that are just these d turns, ascending and joined by commas (of nothing, if there are none).
    (conv_id, depth) names a node. An empty table gives no rows; conversations without turns are members of the root.

    Equal conversations are one entry with a count, so a group of copies of any size is one row. Entries lie in
    containers under trie heads, which are burst while too large; what remains is sorted and swept into nodes; the sums
    of swept containers are carried up the burst heads, a round of bursting at a time. Each round is written to the
    shared folder. There are as many rounds as branchings above the containers, whatever the length of a conversation.
    """
    seqs = materialize(seqs.select("conv_id", "ids", "sizes", F.xxhash64("ids").alias("s1"), F.xxhash64(F.lit(1), "ids").alias("s2")), "sequences")
    entries = seqs.join(copies(seqs), ["s1", "s2", "conv_id"]).select("conv_id", "n", "ends", "ids", "sizes")
    small, heads = burst(entries, capacity)
    swept = materialize(sweep(small), "swept")
    above = ["q1", "q2", "n_leaves", "saved_tokens"]
    sums = lambda nodes: nodes.where("q1 is not null").groupBy(F.col("q1").alias("h1"), F.col("q2").alias("h2")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    parts, upper = [swept], swept.select(*above)
    for tops in reversed(heads):
        nodes = materialize(_chains(tops, sums(upper)), "chains")
        parts.append(nodes)
        upper = swept.select(*above).unionByName(nodes.select(*above))
    return _union(parts).drop("q1", "q2")
