"""Idempotent keyed merges of raw records into state, rejects and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def split_rejects(raw: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): the first failing check names the reason; a bad row never stops the batch."""
    reason = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in checks.items()])
    tagged = raw.withColumn("reason", reason)
    return tagged.filter("reason is null").drop("reason"), tagged.filter("reason is not null")


def reject_counts(bad: DataFrame, actor: str) -> DataFrame:
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(actor).alias("actor"), F.lit("import:malformed").alias("verb"), "reason", "rows"
    )


def keyed_merge(state: DataFrame, batch: DataFrame, keys: list[str], order: str, update: bool) -> DataFrame:
    """State after a batch, with `outcome`: kept, inserted or updated.

    Insert mode keeps what is stored and takes the first of equal keys in the batch; update mode
    replaces it and takes the last. `order` is the batch column that says first and last (when a row arrived); rows
    of equal order are told apart by a hash of the row. Columns of the result are those of the state. Running the same batch again changes nothing.
    """
    cols = state.columns
    rest = [c for c in cols if c not in keys]
    pick = F.max_by if update else F.min_by
    one = batch.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*rest))).alias("_n"))
    both = state.select(*keys, F.struct(*rest).alias("_o")).join(one, keys, "full")
    new, old = F.col("_n").isNotNull(), F.col("_o").isNotNull()
    value = F.coalesce("_n", "_o") if update else F.coalesce("_o", "_n")
    outcome = F.when(~old, "inserted").when(new & F.lit(update) & ~F.col("_n").eqNullSafe(F.col("_o")), "updated").otherwise("kept")
    return both.select(*keys, value.alias("_v"), outcome.alias("outcome")).select(*keys, "_v.*", "outcome")


def merge_stats(raw: DataFrame, merged: DataFrame, rejected: DataFrame) -> DataFrame:
    """total, inserted, updated, skipped of one run, counted from what came, what the merge did and what was rejected."""
    says = raw.select(F.lit("total").alias("what")).unionByName(rejected.select(F.lit("skipped").alias("what"))).unionByName(merged.select(F.col("outcome").alias("what")))
    return says.agg(*[F.count_if(F.col("what") == own).alias(name) for own, name in (("total", "total"), ("inserted", "inserted"), ("updated", "updated"), ("skipped", "skipped"))])


def absent(state: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Active rows whose key is missing from the snapshot."""
    return state.filter("status = 'active'").join(snapshot.select(*keys).distinct(), keys, "left_anti")


def compare_pages(state: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, action, retiered): insert, update, retier, reactivate, noop or delete, and whether a stored tier changes.

    state(path, hash, tier, status), snapshot(path, hash, tier, status); a snapshot row marked deleted
    counts as absent.
    """
    s = state.select("path", F.col("hash").alias("oh"), F.col("tier").alias("ot"), F.col("status").alias("os"))
    n = snapshot.filter(F.coalesce("status", F.lit("active")) != "deleted").select("path", F.col("hash").alias("nh"), F.col("tier").alias("nt"))
    action = (
        F.when(F.col("oh").isNull(), "insert")
        .when(F.col("nh").isNull(), F.when(F.col("os") == "active", "delete").otherwise("gone"))
        .when(F.col("oh") != F.col("nh"), "update")
        .when(F.col("os") != "active", "reactivate")
        .when(F.col("ot") != F.col("nt"), "retier")
        .otherwise("noop")
    )
    retiered = F.coalesce(F.col("ot") != F.col("nt"), F.lit(False)).alias("retiered")
    return s.join(n, "path", "full").select("path", action.alias("action"), retiered).filter("action <> 'gone'")


def sync_actions(state: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, action) of compare_pages."""
    return compare_pages(state, snapshot).drop("retiered")


def audit_rows(calls: DataFrame, returned: DataFrame, limit: int = 100) -> DataFrame:
    """One audit row per call: parameter digest, first `limit` returned ids, full count; never content.

    calls(call_id, actor, verb, params, error), returned(call_id, pos, id) with pos in return order. The
    first `limit` ids of a call are cut by rank before they are gathered; the count is an aggregate of its own.
    """
    w = Window.partitionBy("call_id").orderBy("pos")
    first = returned.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)
    total = returned.groupBy("call_id").agg(F.count(F.lit(1)).alias("returned_count"))
    ids = first.groupBy("call_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]).alias("returned_ids")
    )
    digest = F.substring(F.sha2("params", 256), 1, 16)
    return calls.join(total, "call_id", "left").join(ids, "call_id", "left").select(
        "call_id", "actor", F.concat(F.lit("tool:"), "verb").alias("verb"), digest.alias("params_hash"),
        F.coalesce("returned_ids", F.array().cast("array<string>")).alias("returned_ids"),
        F.coalesce("returned_count", F.lit(0).cast("bigint")).alias("returned_count"), "error",
    )

