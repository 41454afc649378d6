"""Pages and their chunks in key buckets, kept in step with snapshots of the page tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_pages
from ..session import materialize
from .merge import compare_pages

PAGES = "path string, title string, tier int, status string, body string, hash string, bucket int"
CHUNKS = "chunk_id string, parent_type string, parent_id string, ord int, text string, tier int, bucket int"


@dataclass(frozen=True)
class PageStore:
    """Two tables under `path`, both partitioned by a hash of the page's path.

    A sync rewrites only the buckets that hold a page that changed; all other files stay as they are. `buckets` is
    chosen once, so that one bucket is what a few tasks can rewrite (a gigabyte, say); a bucket that outgrows a task is
    cut by the rebalance hint. Chunks are written before pages: a sync that ends between the two finds the same
    changes again when it is repeated. One sync runs at a time.
    """

    spark: SparkSession
    path: str
    buckets: int = 64

    def create(self) -> PageStore:
        for name, schema in (("pages", PAGES), ("chunks", CHUNKS)):
            self.spark.createDataFrame([], schema).write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return self

    def pages(self) -> DataFrame:
        return self.spark.read.schema(PAGES).parquet(f"{self.path}/pages")

    def _chunk_rows(self) -> DataFrame:
        return self.spark.read.schema(CHUNKS).parquet(f"{self.path}/chunks")

    def chunks(self) -> DataFrame:
        return self._chunk_rows().filter("chunk_id is not null")

    def _bucket(self, path: str) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame, name: str) -> None:
        out = rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("bucket").parquet(f"{self.path}/{name}")

    def sync(self, snapshot: DataFrame) -> DataFrame:
        """(scanned, changed, unchanged, deleted) of one sync; `snapshot` is the whole tree as parse_pages gives it.

        Changed are new, altered and re-tiered pages: they are chunked anew. A page that comes back as it was gets its
        chunks back and counts as unchanged. A page absent from the snapshot, or marked deleted there, keeps its row
        as deleted and loses its chunks. Only paths, hashes, tiers and states of all pages are compared; bodies are read for
        the touched buckets only. The same snapshot a second time writes nothing.
        """
        plan = compare_pages(self.pages(), snapshot)
        plan = materialize(plan.select("*", self._bucket("path")), "sync")
        work = plan.filter("action <> 'noop'")
        touched = [r["bucket"] for r in work.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if touched:
            self._apply(work, snapshot, touched)
        gone, moved = F.col("action") == "delete", F.col("action").isin("insert", "update", "retier") | F.col("retiered")
        return plan.agg(F.count_if(~gone).alias("scanned"), F.count_if(~gone & moved).alias("changed"), F.count_if(~gone & ~moved).alias("unchanged"), F.count_if(gone).alias("deleted"))

    def _apply(self, work: DataFrame, snapshot: DataFrame, touched: list[int]) -> None:
        here = F.col("bucket").isin(touched)
        # the tree may change while it is read: chunks and pages come from one reading of the changed files
        fresh = materialize(snapshot.join(work.filter("action <> 'delete'").select("path", "bucket"), "path"), "fresh")
        made = chunk_pages(fresh.select(F.col("path").alias("id"), "title", F.col("body").alias("text"), "tier"))
        made = made.withColumn("bucket", self._bucket("parent_id"))
        none = lambda kind: F.lit(None).cast(kind)
        keys = work.select(F.lit("page").alias("parent_type"), F.col("path").alias("parent_id"), "bucket")
        # one row without a chunk for each page, so that a bucket whose last chunk goes is still overwritten
        marks = keys.select(none("string").alias("chunk_id"), "parent_type", "parent_id", none("int").alias("ord"), none("string").alias("text"), none("int").alias("tier"), "bucket")
        # what is made belongs to the named pages alone, so only the old rows meet them
        others = self._chunk_rows().filter(here).join(keys.drop("bucket"), ["parent_type", "parent_id"], "left_anti")
        self._write(others.unionByName(made).unionByName(marks), "chunks")

        old = self.pages().filter(here).join(work.select("path", "action"), "path", "left")
        kept = old.filter("action is null or action = 'delete'").withColumn("status", F.when(F.col("action") == "delete", "deleted").otherwise(F.col("status")))
        self._write(kept.drop("action").unionByName(fresh.withColumn("status", F.lit("active"))), "pages")
