"""Duplicate titles and the routing of captured texts to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import capture as P
from ..session import fits, materialize

FLOOR = 0.7
# different words of the titles of one side, as many as may travel to the other side's titles
VOCABULARY = 200_000
# fixed values: words that do not make two titles alike
DEDUP_STOP = ["the", "a", "an", "to", "for", "of", "at", "in", "on", "and", "with", "by", "is", "are", "be", "event", "day"]


def title_tokens(title: Column) -> Column:
    """Distinct significant words of a title, sorted."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(title), "['’]s(?![0-9A-Za-z_])", ""), "[^a-z0-9一-鿿]+", " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(plain, " "), lambda w: (F.length(w) > 1) & ~w.isin(DEDUP_STOP))))


def shared_words(ns: DataFrame, os: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """For both tables of (set, toks): (set, n, words, short), of each set its size and the words that some set of the other table has.

    Words come in order of how many sets of the other table have them; those that none has would come first and are left
    out, so that a long title travels as the few words it can share. The first `short` of them are what is left of its n - ceil(n * threshold) + 1 rarest words.
    """

    def ranked(sets: DataFrame, vocab: DataFrame) -> DataFrame:
        # words of counted vocabularies are looked up where the titles are read
        e = sets.select("set", F.size("toks").alias("n"), F.explode("toks").alias("tok")).join(F.broadcast(vocab) if fits(vocab, VOCABULARY) else vocab, "tok")
        r = e.groupBy("set", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "tok"))), lambda s: s["tok"]).alias("words"))
        need = F.ceil(F.col("n") * F.lit(threshold)).cast("int")
        # of the rarest words of all, those that the other table lacks find nothing
        return r.withColumn("short", F.greatest(F.size("words") - need + 1, F.lit(0)))

    count = lambda d, words: d.select(F.explode(words).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    nr = materialize(ranked(ns, materialize(count(os, "toks"), "vocabulary")), "title_words")
    return nr, materialize(ranked(os, materialize(count(nr, "words"), "vocabulary")), "title_words")


def duplicate_titles(new: DataFrame, existing: DataFrame, threshold: float = 0.5, window_days: int = 3) -> DataFrame:
    """(new_id, open_id, score): the best open title for each new one, if it overlaps enough.

    new(id, title, due), existing(id, title, due). Overlap is shared words over the smaller word count;
    two dated titles must lie within `window_days`. Ties go to the newer (larger) open id.

    Everything is done on distinct word sets, so copies of a title never meet each other. Sets are paired
    through rare words: the smaller of two matching sets shares at least ceil(n/2) of its n words, so one
    of its n - ceil(n/2) + 1 rarest words must be among the words of the other. Dates come in afterwards,
    by equality on the days of the window, with one best open title per (word set, day).
    """

    def titles(df: DataFrame, side: str) -> DataFrame:
        c = df.select(F.col("id").alias(side), title_tokens(F.col("title")).alias("toks"), "due").filter(F.size("toks") > 0)
        return c.withColumn("set", F.sha2(F.array_join("toks", " "), 256))

    # each side is read several times below: write the small title tables once
    n = materialize(titles(new, "new_id"), "titles")
    o = materialize(titles(existing, "open_id").groupBy("set", "toks", "due").agg(F.max("open_id").alias("open_id")), "titles")
    ns, os = n.select("set", "toks").distinct(), o.select("set", "toks").distinct()
    nr, orr = shared_words(ns, os, threshold)
    # one open title for each day goes with its word set, so that pairs need not be moved to find it
    orr = orr.join(o.groupBy("set").agg(F.collect_list(F.struct("due", "open_id")).alias("opens")), "set")
    side = lambda r, name, words: r.select(*[F.col(c).alias(f"{name}_{c}") for c in r.columns if c != "short"], F.explode(words).alias("tok"))
    rare = F.slice("words", F.lit(1), F.col("short"))
    score = F.size(F.array_intersect("ns_words", "os_words")) / F.least("ns_n", "os_n")
    alike = lambda a, b: side(nr, "ns", a).join(side(orr, "os", b), "tok").select("ns_set", "os_opens", score.alias("score")).filter(F.col("score") >= threshold)
    # best open title per word set and open day; a pair may be found several times
    every = alike(rare, F.col("words")).union(alike(F.col("words"), rare)).select(F.col("ns_set").alias("ns"), "score", F.explode("os_opens").alias("open"))
    by_day = materialize(every.groupBy("ns", F.col("open.due").alias("day")).agg(F.max(F.struct("score", "open.open_id")).alias("b")), "alike")
    asked = n.select(F.col("set").alias("ns"), "due").distinct()
    days = F.sequence(F.date_sub("due", window_days), F.date_add("due", window_days))
    dated = asked.filter("due is not null").select("ns", "due", F.explode(days).alias("day")).join(by_day.filter("day is not null"), ["ns", "day"])
    undated_open = asked.filter("due is not null").join(by_day.filter("day is null").drop("day"), "ns")
    undated_new = asked.filter("due is null").join(by_day.groupBy("ns").agg(F.max("b").alias("b")), "ns")
    part = lambda d: d.select("ns", "due", "b")
    best = part(dated).unionByName(part(undated_open)).unionByName(part(undated_new)).groupBy("ns", "due").agg(F.max("b").alias("b"))
    hit = best.select(F.col("ns").alias("_set"), F.col("due").alias("_due"), "b.score", "b.open_id")
    j = n.join(hit, (F.col("set") == F.col("_set")) & F.col("due").eqNullSafe(F.col("_due")))
    return j.select("new_id", "open_id", F.round("score", 3).alias("score"))


def route(captures: DataFrame, open_tasks: DataFrame, org_names: DataFrame, today: Column, folder: str | None = None) -> DataFrame:
    """(capture_id, part, target, action, title, tier, ...): the typed rows each capture becomes.

    captures(capture_id, text). A confident task that repeats an open one closes it when it reports
    completion and is flagged as a duplicate otherwise; compound and mixed captures give a second row;
    anything unclear is flagged as unfiled.

    Classified captures are written, to `folder` if one is given, over what a call before left there: the rows of that call
    must have been written by then. Only tasks meet the open ones and only interactions the organisations, so no other text is moved.
    """
    c = captures.select("capture_id", "text", P.classify(F.col("text")).alias("c"), P.completed(F.col("text")).alias("done")).select(
        "capture_id", "text", "c.*", "done"
    )
    c = materialize(c, "captures", folder)
    c = c.withColumn("due_day", P.due_or_null(F.col("due"), today)).withColumn("note", P.due_note(F.col("due"), today))
    dup = duplicate_titles(
        c.filter("type = 'task'").select(F.col("capture_id").alias("id"), "title", F.col("due_day").alias("due")), open_tasks
    ).select(F.col("new_id").alias("capture_id"), "open_id", "score")
    orgs = org_names.select(F.lower("name").alias("_low")).distinct().withColumn("_known", F.lit(True))
    no_id, no_org = F.lit(None).cast(dict(open_tasks.dtypes)["id"]), F.lit(None).cast("boolean")
    tasks = c.filter("type = 'task'").join(dup.drop("score"), "capture_id", "left").withColumn("_known", no_org)
    met = c.filter("type = 'interaction'").withColumn("open_id", no_id).withColumn("_low", F.lower("name")).join(orgs, "_low", "left").drop("_low")
    rest = c.filter("type not in ('task', 'interaction')").withColumns({"open_id": no_id, "_known": no_org})
    d = tasks.unionByName(met).unionByName(rest)
    line = P.first_line(F.col("text"))
    halves = P.action_and_decision(F.col("text"))
    ok = (F.col("confidence") >= FLOOR) & (F.col("type") != "unknown")
    none = F.lit(None).cast("string")

    def row(target, action, title, tier, status=none, ref=no_id):
        return F.struct(
            F.lit(target).alias("target") if isinstance(target, str) else target.alias("target"), F.lit(action).alias("action"),
            title.alias("title"), tier.cast("int").alias("tier"), status.alias("status"), ref.alias("ref"),
        )

    one, two = F.lit(1), F.lit(2)
    is_org = F.coalesce("_known", F.lit(False)) | (F.col("subject_type") == "org")
    filed_task = F.when(
        halves.isNotNull(),
        F.array(
            row("tasks", "insert", F.substring(halves["action"], 1, 200), one, F.lit("inbox")),
            row("decisions", "split", halves["decision"], one),
        ),
    ).otherwise(F.array(row("tasks", "insert", F.coalesce("title", line), one, F.when(F.col("done"), "done").otherwise("inbox"))))
    decision = row("decisions", "insert", F.coalesce("title", line), one)
    done_title = P.done_title(F.col("text"))
    rows = (
        F.when(~ok, F.array(row("review_queue", "unfiled", none, one)))
        .when((F.col("type") == "task") & F.col("open_id").isNotNull() & F.col("done"), F.array(row("tasks", "close", none, one, F.lit("done"), F.col("open_id"))))
        .when((F.col("type") == "task") & F.col("open_id").isNotNull(), F.array(row("review_queue", "duplicate", F.col("title"), one, none, F.col("open_id"))))
        .when(F.col("type") == "task", filed_task)
        .when(F.col("type") == "journal", F.array(row("journal_entries", "insert", none, two)))
        .when(
            F.col("type") == "interaction",
            F.array(row("interactions", "insert", F.col("name"), two, F.when(is_org, "org").otherwise("person"))),
        )
        .when(
            (F.col("type") == "decision_note") & F.col("done"),
            F.array(decision, row("tasks", "split", F.when(done_title != "", done_title).otherwise(line), one, F.lit("done"))),
        )
        .when(F.col("type") == "decision_note", F.array(decision))
        .otherwise(F.array(row("pages", "insert", F.coalesce("title", line), F.when(F.contains("text", F.lit(P.SESSION_HINT)), 2).otherwise(1))))
    )
    return d.select("capture_id", "type", "confidence", "due_day", "note", F.posexplode(rows).alias("part", "row")).select(
        "capture_id", "part", "type", "confidence", "due_day", "note", "row.*"
    )
