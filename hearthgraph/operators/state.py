"""Work state: what is open now, agendas, merges of tasks, decisions, reviews and interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import visible
from .entities import named_in

OPEN = ["inbox", "active", "waiting"]


def open_items(who: DataFrame, commitments: DataFrame, tasks: DataFrame, allowed: int = 1) -> DataFrame:
    """Open commitments made to a person (to_whom) and open tasks whose title contains a name (in_title).

    Titles meet names through the gram join of named_in; no title is tested against every name.
    """
    c = (
        commitments.filter((F.col("status") == "open") & visible(F.col("tier"), allowed))
        .select(F.lower("to_whom").alias("low"), F.col("id").alias("item_id"), "due")
        .join(who.select("person_id", F.lower("to_whom").alias("low")), "low")
        .select("person_id", F.lit("commitment").alias("kind"), "item_id", "due")
    )
    open_t = tasks.filter(F.col("status").isin(OPEN) & visible(F.col("tier"), allowed))
    named = named_in(
        open_t.select(F.col("id").alias("query_id"), F.col("title").alias("query")),
        who.select(F.lit("person").alias("type"), F.col("person_id").alias("id"), F.col("in_title").alias("name")),
    )
    t = named.select(F.col("query_id").alias("item_id"), F.col("id").alias("person_id"))
    t = t.join(open_t.select(F.col("id").alias("item_id"), "due"), "item_id").select("person_id", F.lit("task").alias("kind"), "item_id", "due")
    return c.unionByName(t)


def state_now(
    calendar: DataFrame, tasks: DataFrame, commitments: DataFrame, decisions: DataFrame, now: Column, today: Column, allowed: int = 1
) -> DataFrame:
    """(section, id, at_day): everything that is due, open or moved now. Undated rows sort last in each section."""
    vis = visible(F.col("tier"), allowed)
    cal = calendar.filter(
        (F.col("starts_at") >= now - F.expr("interval 1 hour")) & (F.col("starts_at") < now + F.expr("interval 2 days")) & vis
    ).select(F.lit("calendar").alias("section"), "id", F.to_date("starts_at").alias("at_day"))
    due = tasks.filter(F.col("status").isin(OPEN) & (F.col("due") <= today) & vis).select(
        F.lit("tasks_due").alias("section"), "id", F.col("due").alias("at_day")
    )
    com = commitments.filter((F.col("status") == "open") & vis).select(
        F.lit("commitments_open").alias("section"), "id", F.col("due").alias("at_day")
    )
    rev = decisions.filter(
        F.col("reviewed_on").isNull() & vis & ((F.col("review_on") <= F.date_add(today, 3)) | F.col("choice").isNull())
    ).select(F.lit("decision_reviews_due").alias("section"), "id", F.col("review_on").alias("at_day"))
    moved = tasks.filter(F.col("status").isin("done", "dropped") & (F.col("updated_on") == today) & vis).select(
        F.lit("moved_today").alias("section"), "id", F.col("updated_on").alias("at_day")
    )
    return cal.unionByName(due).unionByName(com).unionByName(rev).unionByName(moved)


def agenda(tasks: DataFrame, first: Column, last: Column, allowed: int = 1) -> DataFrame:
    """Open tasks due in [first, last] with their day's total; order by due, title for display."""
    t = tasks.filter(F.col("status").isin(OPEN) & F.col("due").between(first, last) & visible(F.col("tier"), allowed))
    per_day = t.groupBy("due").agg(F.count(F.lit(1)).alias("day_total"))
    return t.join(per_day, "due").select("due", "id", "title", "status", "day_total")


def _latest(col: str, order: str) -> Column:
    """The last value given: nulls give none."""
    return F.max_by(col, F.when(F.col(col).isNotNull(), F.col(order))).alias(col)


def merge_tasks(base: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Apply task changes: null keeps the old value, 'done' stamps completed_on, no id inserts as 'inbox'.

    changes(id, key, title, status, due) may have `arrived`, the order in which they came: several changes of one task
    act as if applied one by one, so that of each field the last value given holds, and a task that was done once has
    its stamp. Without `arrived` they come in the order of their keys. Result has `outcome`: kept, updated, inserted or
    rejected (an id that does not exist).
    """
    order = F.struct(F.col("arrived") if "arrived" in changes.columns else F.lit(0), "key")
    c = changes.withColumn("_at", order)
    fields = ["key", "title", "status", "due"]
    folded = c.filter("id is not null").groupBy("id").agg(*[_latest(f, "_at") for f in fields], F.coalesce(F.bool_or(F.col("status") == "done"), F.lit(False)).alias("was_done"))
    made = c.filter("id is null").select("id", *fields, F.coalesce(F.col("status") == "done", F.lit(False)).alias("was_done"))
    b, c = base.alias("b"), folded.unionByName(made).alias("c")

    def pick(col: str) -> Column:
        return F.coalesce(F.col(f"c.{col}"), F.col(f"b.{col}"))

    known = F.col("b.id").isNotNull()
    asked = F.col("c.key").isNotNull()
    fresh = asked & F.col("c.id").isNull()
    outcome = (
        F.when(fresh, "inserted").when(asked & ~known, "rejected").when(asked, "updated").otherwise("kept").alias("outcome")
    )
    return b.join(c, F.col("b.id") == F.col("c.id"), "full").select(
        F.coalesce("b.id", "c.id").alias("id"),
        F.when(fresh, F.col("c.key")).alias("new_key"),
        pick("title").alias("title"),
        F.when(fresh, F.coalesce("c.status", F.lit("inbox"))).otherwise(pick("status")).alias("status"),
        pick("due").alias("due"),
        F.when(F.col("c.was_done"), now).otherwise(F.col("b.completed_on")).alias("completed_on"),
        outcome,
    )


def branch_rel(status: Column) -> Column:
    return F.when(status == "chosen", "chose").when(status == "rejected", "rejected").otherwise("considered")


def decision_branches(decisions: DataFrame, explicit: DataFrame) -> DataFrame:
    """Explicit branches win; a decision without any gets one per non-empty option.

    decisions(id, choice, options array); explicit(decision_id, label, status, note). A missing status
    is 'chosen' when the label is the choice, else 'considered'; the edge relation follows the status.
    """
    d = decisions.select(F.col("id").alias("decision_id"), "choice", "options")
    given = explicit.join(d.drop("options"), "decision_id").select(
        "decision_id", "label", F.coalesce("status", F.when(F.col("label") == F.col("choice"), "chosen"), F.lit("considered")).alias("status")
    )
    implied = (
        d.join(explicit.select("decision_id").distinct(), "decision_id", "left_anti")
        .select("decision_id", "choice", F.explode("options").alias("label"))
        .filter(F.length("label") > 0)
        .select("decision_id", "label", F.when(F.col("label") == F.col("choice"), "chosen").otherwise("considered").alias("status"))
    )
    return given.unionByName(implied).withColumn("rel", branch_rel(F.col("status")))


def restatus_branches(branches: DataFrame, changes: DataFrame) -> DataFrame:
    """Branches after status changes(decision_id, label, status); the relation of a branch's edge follows its status.

    A branch that several changes name takes the greatest status; a change of an unknown branch does nothing.
    """
    c = changes.groupBy("decision_id", "label").agg(F.max("status").alias("_s"))
    out = branches.join(c, ["decision_id", "label"], "left").withColumn("_new", F.coalesce("_s", "status"))
    return out.select("decision_id", "label", F.col("_new").alias("status"), branch_rel(F.col("_new")).alias("rel"), (F.col("_new") != F.col("status")).alias("rewritten"))


def review_decisions(decisions: DataFrame, outcomes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply outcomes(id, actual_outcome, score, lesson): decisions, new principles, learned_from edges.

    Outcomes may have `arrived`, the order in which they came. Several outcomes of one decision act as if applied one by
    one: the last outcome holds, and the last score given. Each lesson is a principle of its own, numbered from the
    second on; the decision points to the last.
    """
    o = outcomes.withColumn("_at", F.struct(F.col("arrived") if "arrived" in outcomes.columns else F.lit(0), "actual_outcome", "score", "lesson"))
    learned = o.join(decisions.select("id"), "id", "left_semi").filter(F.length("lesson") > 0)
    learned = learned.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("_at")))
    name = F.concat_ws("-", F.lit("principle"), F.col("id").cast("string"), F.when(F.col("n") > 1, F.col("n").cast("string")))
    learned = learned.withColumn("principle_id", name)
    last = o.groupBy("id").agg(F.max_by("actual_outcome", "_at").alias("_outcome"), F.max_by("score", F.when(F.col("score").isNotNull(), F.col("_at"))).alias("_score"), F.lit(True).alias("_hit"))
    points = learned.groupBy("id").agg(F.max_by("principle_id", "n").alias("principle_id"))
    after = decisions.join(last, "id", "left").join(points, "id", "left")
    others = [c for c in decisions.columns if c not in ("actual_outcome", "outcome_score", "reviewed_on", "principle_id")]
    after = after.select(
        *others,
        F.when(F.col("_hit"), F.col("_outcome")).otherwise(F.col("actual_outcome")).alias("actual_outcome"),
        F.coalesce("_score", "outcome_score").alias("outcome_score"),
        F.when(F.col("_hit"), now).otherwise(F.col("reviewed_on")).alias("reviewed_on"),
        "principle_id",
    )
    principles = learned.select(F.col("principle_id").alias("id"), F.col("lesson").alias("rule"), F.col("id").alias("learned_from"))
    edges = principles.select(
        F.lit("principle").alias("src_type"), F.col("id").alias("src_id"), F.lit("learned_from").alias("rel"),
        F.lit("decision").alias("dst_type"), F.col("learned_from").alias("dst_id"),
    )
    return after, principles, edges


def route_subject(new: DataFrame, org_names: DataFrame, org_cue: Column) -> DataFrame:
    """Person or organisation? An existing organisation wins, then the stated type, then a cue in the name."""
    o = org_names.select(F.lower("name").alias("_low"), F.col("id").alias("_org")).groupBy("_low").agg(F.min("_org").alias("_org"))
    n = new.withColumn("_low", F.lower("name")).join(o, "_low", "left")
    is_org = (
        F.col("_org").isNotNull()
        | (F.coalesce("subject_type", F.lit("")) == "org")
        | ((F.coalesce("subject_type", F.lit("")) != "person") & org_cue)
    )
    return n.withColumn("subject", F.when(is_org, "org").otherwise("person")).withColumn("org_id", F.col("_org")).drop("_low", "_org")


def involves_edges(interactions: DataFrame) -> DataFrame:
    """One `involves` edge per interaction with exactly one subject; the others are dropped as invalid."""
    one = F.col("person_id").isNull() != F.col("org_id").isNull()
    return interactions.filter(one).select(
        F.lit("interaction").alias("src_type"), F.col("id").alias("src_id"), F.lit("involves").alias("rel"),
        F.when(F.col("person_id").isNotNull(), "person").otherwise("org").alias("dst_type"),
        F.coalesce("person_id", "org_id").alias("dst_id"),
    )


def touch_last_contact(people: DataFrame, interactions: DataFrame) -> DataFrame:
    """last_contact = the later of what is stored and the newest interaction."""
    newest = interactions.filter(F.col("person_id").isNotNull()).groupBy(F.col("person_id").alias("id")).agg(F.max("occurred_on").alias("_m"))
    return people.join(newest, "id", "left").withColumn("last_contact", F.greatest("last_contact", "_m")).drop("_m")
