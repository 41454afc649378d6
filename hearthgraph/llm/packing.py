"""Best-fit packing of documents into fixed-length sequences, under conflicts of source and duplicate cluster."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces
from .tokens import lengths

#: Units of one bin. The queries count tokens.
CAPACITY = 4_096
#: Pieces that are packed together; a task holds one such shard at a time.
SHARD_ROWS = 4_096


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each (length, source, cluster), longest first as given.

    Open bins are ordered by what is left in them. The successor search starts at the first bin that is large enough
    and goes on to the next larger until the bitmaps of the bin hold neither the item's source nor its cluster; that
    bin is the tightest compatible one. If there is none, a bin is opened. An item without source or cluster (None)
    conflicts with nothing on that side.
    """
    often = {c for c, k in Counter(i[2] for i in items if i[2] is not None).items() if k > 1}
    source_bit: dict = {}
    cluster_bit: dict = {}
    left: list[tuple[int, int]] = []  # (residual, bin), ordered
    sources: list[int] = []
    clusters: list[int] = []
    bins, offsets = [], []
    for length, source, cluster in items:
        s = 1 << source_bit.setdefault(source, len(source_bit)) if source is not None else 0
        c = 1 << cluster_bit.setdefault(cluster, len(cluster_bit)) if cluster in often else 0
        at = bisect_left(left, (length, -1))
        while at < len(left) and (sources[left[at][1]] & s or clusters[left[at][1]] & c):
            at += 1
        if at < len(left):
            room, number = left.pop(at)
        else:
            room, number = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        bins.append(number)
        offsets.append(capacity - room)
        sources[number] |= s
        clusters[number] |= c
        if room > length:
            insort(left, (room - length, number))
    return bins, offsets


def pack(df: DataFrame, key: str = "doc_id", length: str = "length", source: str = "source", cluster: str = "cluster", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Place every piece of every document: (key, piece, length, shard, bin, offset).

    A document longer than `capacity` is cut into full pieces and a rest; every unit of it is placed. No bin holds
    two pieces of one source or of one duplicate cluster, and the pieces of a long document are a cluster of their
    own. A null length counts as 0, and a piece of length 0 is placed like any other; a null source or cluster
    conflicts with nothing; a null key is an ordinary value; repeated rows are packed each. An empty table gives no
    rows.

    Pieces are dealt by a hash over shards of about `shard_rows`, as many as the table needs, and each shard is
    packed best-fit decreasing on its own. So a hot source or cluster is spread evenly, a task holds one shard, and
    the result does not depend on how Spark splits the table. Only lengths and labels are shuffled, never texts.
    """
    kind = dict(df.dtypes)[key]
    size = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0))
    base = df.select(F.col(key).alias("k"), size.alias("len"), F.col(source).cast("string").alias("s"), F.col(cluster).cast("string").alias("c"))
    last = F.greatest(F.ceil(F.col("len") / capacity).cast("int") - 1, F.lit(0))
    own = F.when(F.col("len") > capacity, F.coalesce("c", F.concat(F.lit("long:"), F.xxhash64("k", "len", "s").cast("string")))).otherwise(F.col("c"))
    cut = base.withColumn("c", own).withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    cut = cut.withColumn("n", F.least(F.lit(capacity).cast("long"), F.col("len") - F.col("piece") * F.lit(capacity).cast("long")))
    cut = materialize(cut.select("k", "piece", "n", "s", "c"), "pieces")
    shards = max(1, math.ceil(cut.count() / shard_rows))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("k", "piece", "s", "c"), F.lit(shards)).cast("int"))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("n"), "k", "piece", "s", "c")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def close():
            t = pa.Table.from_batches(held)
            bins, offsets = best_fit(list(zip(*(t.column(c).to_pylist() for c in ("n", "s", "c")))), capacity)
            b = t.select(["k", "piece", "n", "shard"]).combine_chunks()
            return pa.RecordBatch.from_arrays([*(b.column(c).chunk(0) for c in ("k", "piece", "n", "shard")), pa.array(bins, pa.int32()), pa.array(offsets, pa.int64())], ["k", "piece", "n", "shard", "bin", "offset"])

        for new, b in pieces(batches, ["shard"]):
            if new and held:
                yield close()
                held = []
            held.append(b)
        if held:
            yield close()

    out = dealt.mapInArrow(run, f"k {kind}, piece int, n long, shard int, bin int, offset long")
    return out.select(F.col("k").alias(key), "piece", F.col("n").alias("length"), "shard", "bin", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack the documents table by tokens; documents with the same words are one duplicate cluster.

    A null text, or one without words, is nobody's copy and has no tokens to speak of: it conflicts with nothing.
    """
    words = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    measured = lengths(docs.select("doc_id", "text", "source", F.when(words != "", F.xxhash64(words)).alias("cluster")), keep=["doc_id", "source", "cluster"])
    return pack(measured, capacity=capacity)
