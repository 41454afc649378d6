"""Access tiers, parent types and provenance shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: source table of an edge -> parent type that carries its tier
TABLE_TYPES = {
    "values_items": "value",
    "goals": "goal",
    "principles": "principle",
    "tasks": "task",
    "commitments": "commitment",
    "decisions": "decision",
    "decision_branches": "decision_branch",
    "journal_entries": "journal",
    "people": "person",
    "orgs": "org",
    "interactions": "interaction",
    "pages": "page",
    "calendar_events": "calendar_event",
    "email_meta": "email",
    "inbox_items": "inbox_item",
    "chunks": "chunk",
}
HIDDEN = "[above current tier]"


def visible(tier: Column, allowed: Column | int = 1) -> Column:
    """Read rule of every content operator: never above the reader's tier, never tier 0."""
    return (tier <= F.lit(allowed) if isinstance(allowed, int) else tier <= allowed) & (tier >= 1)


def allowed_tiers(actors: DataFrame, grants: DataFrame, at: Column) -> DataFrame:
    """(actor, allowed): 2 while the actor holds a live grant at `at`, else 1."""
    live = grants.filter((F.col("granted_at") <= at) & (F.col("expires_at") > at)).select("actor").distinct()
    return actors.join(live.withColumn("_live", F.lit(True)), "actor", "left").select(
        "actor", F.when(F.col("_live"), 2).otherwise(1).alias("allowed")
    )


def allowed_anyone(grants: DataFrame, at: Column) -> DataFrame:
    """One row: the tier of a reader without a name; any live grant counts."""
    live = (F.col("granted_at") <= at) & (F.col("expires_at") > at)
    return grants.agg(F.coalesce(F.max(F.when(live, 2)), F.lit(1)).alias("allowed"))


def with_edge_tier(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """An edge inherits the tier of the row it was read from; 1 where that row is unknown."""
    type_of = F.create_map(*[F.lit(x) for kv in TABLE_TYPES.items() for x in kv])
    n = nodes.select(F.col("type").alias("_t"), F.col("id").alias("_i"), F.col("tier").alias("_tier"))
    e = edges.withColumn("_st", F.try_element_at(type_of, F.col("source_table")))
    return (
        e.join(n, (F.col("_st") == F.col("_t")) & (F.col("source_id") == F.col("_i")), "left")
        .withColumn("tier", F.coalesce("_tier", F.lit(1)))
        .drop("_st", "_t", "_i", "_tier")
    )
