"""What the operators of this folder share: session settings, scratch tables, streams of sorted rows, components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, spread, tune

#: Rows of one Arrow batch. Texts may be long, and a Python worker holds a few batches.
BATCH_ROWS = 256
#: Words of every operator: runs of anything but ASCII white space, as bytes.split() cuts them.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def one_per_id(df: DataFrame, key: str, *values: str) -> DataFrame:
    """(key, values): one row per key that is not null; a repeated key keeps its smallest row, nulls first."""
    picked = df.select(F.col(key).cast("long").alias(key), F.struct(*[F.col(v) for v in values]).alias("_v")).where(F.col(key).isNotNull())
    return picked.groupBy(key).agg(F.min("_v").alias("_v")).select(key, "_v.*")


def pieces(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Cut a stream sorted by `keys` where they change: (does a new group begin, rows of one group)."""
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k) for k in keys]
        cuts = {0, n}
        for c in cols:
            if n > 1:
                differ = pc.fill_null(pc.not_equal(c[1:], c[:-1]), True)
                cuts.update((pc.indices_nonzero(differ).to_numpy() + 1).tolist())
        marks = sorted(cuts)
        for a, b in zip(marks, marks[1:]):
            here = tuple(c[a].as_py() for c in cols)
            yield here != last, batch.slice(a, b - a)
            last = here


class Forest:
    """Union by smallest member over the ids one task meets."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (p := up.setdefault(root, root)) != root:
            root = p
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple]:
        return [(x, r) for x in list(self.up) if (r := self.find(x)) != x]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected edges (a, b) that is not the smallest of its component.

    Alternates large-star and small-star steps: each hangs neighbours on the smallest one they know, so a
    component becomes a star in a number of rounds that grows with the logarithm of its size. A round is written to
    the shared folder and read back; only its row count and checksum reach the driver.
    """
    flat = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = materialize(flat, "stars")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("a"), F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = materialize(small, "stars")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(df: DataFrame) -> tuple:
    r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000000007)).first()
    return r[0], r[1]


def finite(vec: Column) -> Column:
    """True for a vector whose components are all numbers."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & good, F.lit(False))
