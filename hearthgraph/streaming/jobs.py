"""Continuous capture, access counts, unlock checks and health deliveries with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.merge import keyed_merge


def run_available(query_writer, checkpoint: str) -> None:
    """Process everything that has arrived, then stop; the checkpoint makes a restart continue."""
    q = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def capture_stream(arrivals: DataFrame, route: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Route new captures once per path into `out`, one folder per batch.

    arrivals(path, capture_id, text). Paths seen before are dropped by the stream's own state, which is dealt out
    by path and restored with the checkpoint; a batch repeated after a failure sees the same rows and overwrites its
    own folder. So each path is decided exactly once. A row without text (its file is gone) is kept as rejected.
    The new captures of a batch are written once, over those of the batch before, so that its state is asked once.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch = materialize(batch, "arrived", f"{out}/arrived")
        gone = batch.filter("text is null").select("capture_id", F.lit("file is gone").alias("reason"))
        gone.write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
        route(batch.filter("text is not null").drop("path")).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    run_available(arrivals.dropDuplicates(["path"]).writeStream.foreachBatch(step), checkpoint)


def access_buckets(log: DataFrame, horizon: str = "90 days") -> DataFrame:
    """Streaming twin of access_counts: drill-ins per row and day; state older than the horizon is dropped.

    Days inside the window are summed at read time by serve_access.
    """
    return (
        log.filter(F.col("verb") == "tool:get_context")
        .withColumn("parent_id", F.get_json_object("payload", "$.returned_ids[0]"))
        .filter(F.col("parent_id").isNotNull())
        .withWatermark("happened_at", horizon)
        .groupBy(F.window("happened_at", "1 day"), "parent_id")
        .agg(F.count(F.lit(1)).alias("drills"))
        .select(F.to_date("window.start").alias("day"), "parent_id", "drills")
    )


def upsert_buckets(path: str) -> Callable[[DataFrame, int], None]:
    """Sink of the day buckets: each batch is written on its own and the newest value of a day wins on read."""

    def step(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step


def serve_access(buckets: DataFrame, today: Column, days: int = 90) -> DataFrame:
    newest = buckets.groupBy("day", "parent_id").agg(F.max_by("drills", "version").alias("drills"))
    return newest.filter(F.col("day") >= F.date_sub(today, days)).groupBy("parent_id").agg(F.sum("drills").alias("drills"))


def with_effective_tier(events: DataFrame, grants: DataFrame) -> DataFrame:
    """Each event with the tier its actor could read at that moment; events may be a stream, grants are a table.

    Grants, which last a minute or more, are cut at whole minutes, so the interval test becomes equality on
    (actor, minute). Within a minute a cut grant starts at its beginning or reaches its end; the latest end
    of the former and the earliest start of the latter say everything, and both are plain aggregates.
    """
    minute = lambda c: F.date_trunc("minute", c)
    after = F.col("slot") + F.expr("interval 1 minute")
    slots = (
        grants.withColumn("slot", F.explode(F.sequence(minute("granted_at"), minute("expires_at"), F.expr("interval 1 minute"))))
        .withColumn("start", F.greatest("granted_at", "slot"))
        .withColumn("end", F.least(F.col("expires_at"), after))
        .filter("start < end")
        .groupBy("actor", "slot")
        .agg(F.max(F.when(F.col("start") == F.col("slot"), F.col("end"))).alias("until"), F.min(F.when(F.col("end") == after, F.col("start"))).alias("since"))
    )
    e = events.withColumn("slot", minute(F.col("happened_at")))
    live = (F.col("happened_at") < F.col("until")) | (F.col("happened_at") >= F.col("since"))
    # a grant of some bytes is many minutes: its table's size says little of theirs, so they are dealt out and never shipped whole
    return e.join(slots.hint("merge"), ["actor", "slot"], "left").withColumn("allowed", F.when(F.coalesce(live, F.lit(False)), 2).otherwise(1)).drop("until", "since", "slot")


def deliveries(batch_parse: Callable[[DataFrame], DataFrame], state_path: str, keys: list[str], time: str, order: str) -> Callable[[DataFrame, int], None]:
    """Sink that adds each delivery to a state table, insert-if-absent; a repeated batch changes nothing.

    The state is append-only: a batch writes the rows whose key is new, once, under its own number and the day of
    `time` (one of the keys). To know what is new it reads the keys of the days that it brings rows for, so the time of
    a batch follows the batch and not the state. Within a batch the first by `order` wins.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        good = batch_parse(batch)
        first = keyed_merge(good.limit(0).drop(order), good, keys, order, update=False).drop("outcome").withColumn("day", F.to_date(time))
        if number:  # earlier batches only: a repeated batch must not see its own first try
            old = spark.read.parquet(state_path).filter(F.col("batch") < number).select(*keys, "day")
            known = old.join(first.select("day").distinct(), "day", "left_semi")
            first = first.join(known, [*keys, "day"], "left_anti")
        first.write.mode("overwrite").partitionBy("day").parquet(f"{state_path}/batch={number}")

    return step
