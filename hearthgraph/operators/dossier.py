"""The page about an entity, for a whole table of entities at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import visible
from . import entities as E
from .state import open_items


def staleness(newest: Column, today: Column, what: str) -> Column:
    """Says how old the newest contact is once that is over 30 days."""
    age = F.datediff(today, newest)
    return F.when(age > 30, F.concat(F.lit(f"{what} "), age, F.lit(" days ago")))


def _related(edges: DataFrame, nodes: DataFrame, kind: str, allowed: int) -> DataFrame:
    """(id, related): the 20 newest titled edges of each row of a kind."""
    around = E.with_titles(E.edges_around(edges, allowed).filter(F.col("node_type") == kind), nodes, allowed)
    return around.groupBy(F.col("node_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rn", "rel", "src_type", "src_id", "src_title", "dst_type", "dst_id", "dst_title"))).alias("related")
    )


def _met(interactions: DataFrame, key: str, allowed: int) -> DataFrame:
    """(id, interactions): the last 20 of each person or organisation."""
    return E.recent_interactions(interactions, key, allowed).groupBy(F.col(key).alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rn", F.col("id").alias("interaction_id"), "kind", "occurred_on"))).alias("interactions")
    )


def dossiers(
    people: DataFrame, edges: DataFrame, nodes: DataFrame, interactions: DataFrame, commitments: DataFrame, tasks: DataFrame, today: Column, allowed: int = 1
) -> DataFrame:
    """Row, 20 newest titled edges, 20 last interactions, open items, gaps and staleness of each person.

    Lists are top-k reports of 20; open items, which have no such bound, are counted here and listed by
    open_items.
    """
    p = people.filter(visible(F.col("tier"), allowed))
    related, seen = _related(edges, nodes, "person", allowed), _met(interactions, "person_id", allowed)
    who = p.select(F.col("id").alias("person_id"), F.col("canonical_name").alias("to_whom"), F.col("canonical_name").alias("in_title"))
    items = open_items(who, commitments, tasks, allowed).groupBy(F.col("person_id").alias("id")).agg(
        F.count(F.when(F.col("kind") == "commitment", 1)).alias("open_commitments"), F.count(F.when(F.col("kind") == "task", 1)).alias("open_tasks")
    )
    out = p.join(related, "id", "left").join(seen, "id", "left").join(items, "id", "left")
    empty = lambda c: F.coalesce(c, F.array())
    return out.select(
        "id", "canonical_name", "relation", empty("related").alias("related"), empty("interactions").alias("interactions"),
        F.coalesce("open_commitments", F.lit(0).cast("bigint")).alias("open_commitments"), F.coalesce("open_tasks", F.lit(0).cast("bigint")).alias("open_tasks"),
        (F.col("interactions").isNull() & F.lit(allowed < 2)).alias("locked"),
        staleness(F.coalesce("last_contact", "updated_on"), today, "last contact").alias("staleness"),
    )


def org_dossiers(orgs: DataFrame, edges: DataFrame, nodes: DataFrame, interactions: DataFrame, today: Column, allowed: int = 1) -> DataFrame:
    """Row, 20 newest titled edges, 20 last interactions kept under the organisation, gaps and staleness of each organisation."""
    o = orgs.filter(visible(F.col("tier"), allowed))
    out = o.join(_related(edges, nodes, "org", allowed), "id", "left").join(_met(interactions, "org_id", allowed), "id", "left")
    empty = lambda c: F.coalesce(c, F.array())
    return out.select(
        "id", "canonical_name", empty("related").alias("related"), empty("interactions").alias("interactions"),
        (F.col("interactions").isNull() & F.lit(allowed < 2)).alias("locked"), staleness(F.col("updated_on"), today, "row").alias("staleness"),
    )


def decision_timeline(decisions: DataFrame, transcripts: DataFrame, branches: DataFrame, allowed: int = 1) -> DataFrame:
    """(decision_id, part, place, label, updated_on): every turn and branch of the decisions a reader may see, in long form."""
    seen = decisions.filter(visible(F.col("tier"), allowed)).select(F.col("id").alias("decision_id"))
    t = transcripts.filter(visible(F.col("tier"), allowed)).select("decision_id", F.lit("transcript").alias("part"), F.col("ord").cast("int").alias("place"), F.lit("").alias("label"), "updated_on")
    w = Window.partitionBy("decision_id").orderBy("updated_on", "label")
    b = branches.filter(visible(F.col("tier"), allowed)).select("decision_id", F.lit("branch").alias("part"), F.row_number().over(w).alias("place"), "label", "updated_on")
    return t.unionByName(b).join(seen, "decision_id", "left_semi")


def decision_dossiers(decisions: DataFrame, edges: DataFrame, nodes: DataFrame, transcripts: DataFrame, branches: DataFrame, today: Column, allowed: int = 1, limit: int = 20) -> DataFrame:
    """Row, 20 newest titled edges, the first `limit` turns and branches with their counts, and staleness of each decision.

    A transcript has no bound of its own, so the page shows its beginning; decision_timeline tells all of it.
    """
    d = decisions.filter(visible(F.col("tier"), allowed))

    def part(rows: DataFrame, order: list[str], columns: list[str], name: str, count: str) -> DataFrame:
        seen = rows.filter(visible(F.col("tier"), allowed))
        few = seen.withColumn("rn", F.row_number().over(Window.partitionBy("decision_id").orderBy(*order))).filter(F.col("rn") <= limit)
        shown = few.groupBy(F.col("decision_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rn", *columns))).alias(name))
        return shown.join(seen.groupBy(F.col("decision_id").alias("id")).agg(F.count(F.lit(1)).alias(count)), "id")

    out = d.join(_related(edges, nodes, "decision", allowed), "id", "left")
    out = out.join(part(transcripts, ["ord"], ["ord", "updated_on"], "transcript", "turns"), "id", "left")
    out = out.join(part(branches, ["updated_on", "label"], ["label", F.col("status"), "updated_on"], "branches", "ways"), "id", "left")
    empty, zero = (lambda c: F.coalesce(c, F.array())), F.lit(0).cast("bigint")
    return out.select(
        "id", "question", "choice", empty("related").alias("related"), empty("transcript").alias("transcript"), F.coalesce("turns", zero).alias("turns"),
        empty("branches").alias("branches"), F.coalesce("ways", zero).alias("ways"), staleness(F.col("updated_on"), today, "row").alias("staleness"),
    )
