"""Nightly jobs: stale rows, reviews, contradictions, phantom people, compiled notes and digests, the queue."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions.capture import org_cue
from ..functions.text import any_word
from ..model import HIDDEN, visible

# fixed values: opposite claims, and payload keys that carry content
ANTONYMS = [
    ("always", "never"),
    ("loves?", "hates?"),
    ("vegetarian", "steak|meat[- ]eater"),
    ("moved to", "still lives in"),
]
CONTENT_KEYS = ["body", "body_md", "candidate_title", "entry_md", "existing_title", "question", "summary", "text", "title"]
NOTE_WORDS, DIGEST_WORDS, TITLE_WORDS, NOTE_MIN_CHUNKS, MIN_SENTENCE = 300, 120, 18, 3, 8


def not_queued(flags: DataFrame, queue: DataFrame, kind: str, key: str) -> DataFrame:
    """Flags whose key has no open item of that kind yet. queue(kind, key, status)."""
    have = queue.filter((F.col("kind") == kind) & (F.col("status") == "open")).select(F.col("key").alias(key)).distinct()
    return flags.join(have, key, "left_anti")


def stale_items(pages: DataFrame, people: DataFrame, now: Column, days: int = 180) -> DataFrame:
    """Active pages untouched for `days` and people not in contact (or else not updated) for as long."""
    old = F.date_sub(now, days)
    p = pages.filter((F.col("status") == "active") & (F.col("updated_on") < old)).select(
        F.lit("page").alias("type"), "id", F.col("title").alias("label"), "updated_on"
    )
    h = people.filter(F.coalesce("last_contact", "updated_on") < old).select(
        F.lit("person").alias("type"), "id", F.col("canonical_name").alias("label"), "updated_on"
    )
    return p.unionByName(h)


def decision_reviews(decisions: DataFrame, today: Column) -> DataFrame:
    return decisions.filter((F.col("review_on") <= today) & F.col("reviewed_on").isNull()).select("id", "question", "review_on")


def phantom_flags(candidates: DataFrame) -> DataFrame:
    """People that look like organisations: a shared name, or a cue without any human signal."""
    cue = ~F.col("has_human_signal") & org_cue(F.col("canonical_name"))
    return candidates.filter(F.col("name_match") | cue).select(
        "id", "canonical_name",
        F.when(F.col("name_match"), "shares a name with an organisation").otherwise("named like a company, without human signal").alias("reason"),
    )


def contradictions(members: DataFrame, texts: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """(entity, claim, side, chunk_id): all chunks about an entity that take a side in a claim on which sides meet.

    members(entity, chunk_id), texts(chunk_id, text). Every chunk of one side contradicts every chunk of the other,
    so a group says all its pairs in as many rows as it has chunks. A group of a single chunk that takes both
    sides is no contradiction. With queue(kind, entity, claim, status), groups with an open item are left out.
    """
    flags = F.array(
        *[
            F.struct(F.lit(i * 2 + s).alias("f"), F.col("text").rlike(f"(?i){any_word(p)}").alias("on"))
            for i, pair in enumerate(ANTONYMS)
            for s, p in enumerate(pair)
        ]
    )
    said = (
        texts.select("chunk_id", F.explode(F.filter(flags, lambda x: x["on"])).alias("x"))
        .select("chunk_id", F.floor(F.col("x.f") / 2).cast("int").alias("claim"), (F.col("x.f") % 2).alias("side"))
    )
    m = members.select("entity", "chunk_id").distinct().join(said, "chunk_id").distinct()
    met = m.groupBy("entity", "claim").agg(F.min("side").alias("s0"), F.max("side").alias("s1"), F.min("chunk_id").alias("c0"), F.max("chunk_id").alias("c1"))
    met = met.filter("s0 < s1 and c0 < c1").select("entity", "claim")
    if queue is not None:
        open_ = queue.filter("kind = 'contradiction' and status = 'open'").select("entity", "claim").distinct()
        met = met.join(open_, ["entity", "claim"], "left_anti")
    return m.join(met, ["entity", "claim"], "left_semi").select("entity", "claim", "side", "chunk_id")


# ------------------------------------------------------------------ compiled notes


def cap_words(text: Column, most: int, mark: str) -> Column:
    words = F.split(F.trim(text), r"\s+")
    return F.when(F.size(words) <= most, F.trim(text)).otherwise(
        F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit(mark))
    )


def note_candidates(mentions: DataFrame, chunks: DataFrame, people: DataFrame, generated: DataFrame, least: int = NOTE_MIN_CHUNKS) -> DataFrame:
    """People mentioned by `least` or more chunks of pages that are not notes themselves.

    mentions(parent_id, person_id, created_on); generated(parent_id) lists note pages.
    """
    m = mentions.join(generated.select("parent_id").distinct(), "parent_id", "left_anti")
    per = (
        m.join(chunks.select("parent_id", "chunk_id", "tier"), "parent_id")
        .groupBy("person_id")
        .agg(F.countDistinct("chunk_id").alias("chunk_count"), F.max("tier").alias("max_tier"), F.max("created_on").alias("latest_mention"))
        .filter(F.col("chunk_count") >= least)
    )
    return per.join(people.select(F.col("id").alias("person_id"), F.col("canonical_name").alias("name")), "person_id")


def note_sources(mentions: DataFrame, chunks: DataFrame, names: DataFrame, generated: DataFrame) -> DataFrame:
    """Chunks of mentioning pages that literally contain one of the person's names."""
    m = mentions.join(generated.select("parent_id").distinct(), "parent_id", "left_anti").select("parent_id", "person_id").distinct()
    n = names.select(F.col("id").alias("person_id"), F.lower("name").alias("low")).distinct()
    return (
        m.join(chunks, "parent_id")
        .join(n, "person_id")
        .filter(F.lower("text").contains(F.col("low")))
        .select("person_id", "chunk_id", "parent_id", "ord", "text", "tier", "updated_on")
        .dropDuplicates(["person_id", "chunk_id"])
    )


def lead_sentence(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1"), "[*_`#>]+", "")
    return F.trim(F.get(F.split(F.trim(F.regexp_replace(plain, r"\s+", " ")), r"(?<=[.!?])\s+"), F.lit(0)))


def compile_notes(candidates: DataFrame, sources: DataFrame, existing: DataFrame) -> DataFrame:
    """One note per stale person: leading sentences of the sources, first mention first, capped in words.

    existing(path, updated_on, body_hash). A note no older than the latest mention is skipped; an equal
    body leaves the page unchanged. Only the first NOTE_WORDS sentences of a person can reach the note
    (each holds a word or more), so a person with a third of all chunks is cut to that by rank.
    """
    key = ["updated_on", "ord", "chunk_id"]
    s = sources.withColumn("sentence", lead_sentence(F.col("text"))).withColumn("low", F.lower("sentence"))
    said = s.filter(F.length("sentence") >= MIN_SENTENCE)
    firsts = said.groupBy("person_id", "low").agg(F.min(F.struct(*key, "sentence")).alias("f")).select("person_id", "f.*")
    w = Window.partitionBy("person_id").orderBy(*key)
    head = firsts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= NOTE_WORDS)
    lines = head.groupBy("person_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "sentence"))), lambda x: x["sentence"]), " ").alias("lines")
    )
    tiers = s.groupBy("person_id").agg(
        F.max("tier").alias("tier"), F.count(F.lit(1)).alias("sources"), F.min_by("parent_id", F.struct(*key)).alias("derived_from")
    )
    low = F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-|-$", "")
    slug = F.substring(low, 1, 60)
    path = F.concat(F.lit("derived/notes/person/"), F.when(slug != "", slug).otherwise(F.col("person_id").cast("string")), F.lit(".md"))
    c = candidates.withColumn("path", path).join(existing.withColumnRenamed("updated_on", "note_on"), "path", "left")
    body = cap_words(F.concat(F.col("name"), F.lit(": "), F.coalesce("lines", F.lit(""))), NOTE_WORDS, " …")
    n = c.join(tiers, "person_id", "left").join(lines, "person_id", "left").withColumn("body", body)
    n = n.withColumn("hash", F.sha2("body", 256))
    fresh = F.col("note_on").isNotNull() & (F.col("note_on") >= F.col("latest_mention"))
    few = F.coalesce("sources", F.lit(0)) < NOTE_MIN_CHUNKS
    status = (
        F.when(fresh | few, "skipped").when(F.col("body_hash") == F.col("hash"), "unchanged").when(F.col("note_on").isNotNull(), "updated").otherwise("created")
    )
    return n.withColumn("status", status).select(
        "person_id", "path", "status",
        F.when(status != "skipped", F.col("body")).alias("body"), F.coalesce("tier", "max_tier").alias("tier"), "sources", "derived_from",
    )


# ------------------------------------------------------------------ decision digests


def decision_touched(decisions: DataFrame, branches: DataFrame, transcripts: DataFrame) -> DataFrame:
    """A decision counts as updated when a branch or transcript row of it is."""
    t = branches.select("decision_id", "updated_on").unionByName(transcripts.select("decision_id", "updated_on"))
    t = t.groupBy(F.col("decision_id").alias("id")).agg(F.max("updated_on").alias("_u"))
    return decisions.join(t, "id", "left").withColumn("updated_on", F.greatest("updated_on", "_u")).drop("_u")


def digest_candidates(decisions: DataFrame, pages: DataFrame) -> DataFrame:
    """Decisions whose digest page is missing, inactive, not compiled by the job, or older than the decision."""
    pg = pages.select(F.col("decision_id").alias("id"), F.col("status").alias("_st"), F.col("body").alias("_b"), F.col("updated_on").alias("_pu"))
    return decisions.join(pg, "id", "left").filter(
        F.col("_st").isNull() | (F.col("_st") != "active") | ~F.contains("_b", F.lit("compiler: nightly")) | (F.col("_pu") < F.col("updated_on"))
    ).drop("_st", "_b", "_pu")


def _sentence(label: str, col: str, end: str = ".") -> Column:
    return F.when(F.col(col).isNotNull(), F.concat(F.lit(label), F.col(col).cast("string"), F.lit(end)))


def digest_sources(decisions: DataFrame, branches: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(id, ref): every row a digest rests on, one per row rather than gathered into a text."""
    d = decisions.select("id", F.concat(F.lit("decision:"), F.col("id").cast("string")).alias("ref"))
    t = transcripts.select(F.col("decision_id").alias("id"), F.concat(F.lit("decision_transcript:"), "ord").alias("ref"))
    b = branches.select(F.col("decision_id").alias("id"), F.concat(F.lit("decision_branch:"), "label").alias("ref"))
    only = decisions.select("id")
    return d.unionByName(t.join(only, "id", "left_semi")).unionByName(b.join(only, "id", "left_semi"))


def compile_digests(decisions: DataFrame, branches: DataFrame, transcripts: DataFrame) -> DataFrame:
    """title, situation, past and takeaway of each decision; tier is the highest of its parts.

    `past` is cut at DIGEST_WORDS words and a label has one or more, so only the first DIGEST_WORDS + 1
    rejected labels of a decision can matter; they are cut to that by rank.
    """
    w = Window.partitionBy("decision_id").orderBy("label")
    few = branches.filter("status = 'rejected'").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= DIGEST_WORDS + 1)
    rejected = few.groupBy(F.col("decision_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("rejected"))
    b = branches.groupBy(F.col("decision_id").alias("id")).agg(
        F.min(F.when(F.col("status") == "chosen", F.col("label"))).alias("chosen"), F.max("tier").alias("_bt"), F.count(F.lit(1)).alias("_bn")
    ).join(rejected, "id", "left")
    t = transcripts.groupBy(F.col("decision_id").alias("id")).agg(F.max("tier").alias("_tt"), F.count(F.lit(1)).alias("_tn"))
    d = decisions.join(b, "id", "left").join(t, "id", "left")
    title = cap_words(F.concat(F.lit("When facing "), F.trim(F.regexp_replace("question", r"\?+$", ""))), TITLE_WORDS, " ...")
    situation = F.concat_ws(" ", "question", "stakes", "reasoning", _sentence("Falsifier: ", "falsifier", ""))
    chosen = F.coalesce("choice", "chosen", F.lit("no choice yet"))
    past = F.concat_ws(
        " ", F.concat(F.lit("Past-me chose "), chosen, F.lit(".")), F.when(F.col("rejected") != "", F.concat(F.lit("Rejected: "), "rejected", F.lit("."))),
        _sentence("Confidence: ", "confidence", "/100."), _sentence("Expected: ", "expected_outcome"),
    )
    take = F.when(
        F.col("actual_outcome").isNotNull(), F.concat_ws(" ", _sentence("Outcome: ", "actual_outcome"), _sentence("Outcome score: ", "outcome_score", "/100."))
    ).otherwise(F.concat_ws(" ", _sentence("Watch for: ", "expected_outcome"), "falsifier"))
    sources = F.lit(1) + F.coalesce("_tn", F.lit(0)) + F.coalesce("_bn", F.lit(0))
    take = cap_words(take, DIGEST_WORDS, " ...")
    out = d.select(
        "id", F.concat(F.lit("derived/decisions/"), F.col("id").cast("string"), F.lit(".md")).alias("path"), title.alias("title"),
        cap_words(situation, DIGEST_WORDS, " ...").alias("situation"), cap_words(past, DIGEST_WORDS, " ...").alias("past"),
        F.when(take != "", take).otherwise("No outcome recorded yet.").alias("takeaway"), sources.alias("sources"),
        F.greatest("tier", "_bt", "_tt").alias("tier"),
    )
    body = F.concat(
        F.lit("# "), "title", F.lit("\n\ncompiler: nightly\n\n## Situation\n"), "situation", F.lit("\n\n## Past-me decided\n"), "past",
        F.lit("\n\n## Takeaway\n"), "takeaway", F.lit("\n\n## Source\n"), "sources", F.lit(" rows of decision:"), F.col("id").cast("string"), F.lit("\n"),
    )
    return out.withColumn("body", body).withColumn("hash", F.sha2("body", 256))


def merge_digests(pages: DataFrame, digests: DataFrame, now: Column) -> DataFrame:
    """The digest pages after a compile run, with `status`: created, updated, retiered, unchanged or kept.

    pages(path, title, body, hash, tier, first_seen, updated_on) is what earlier runs wrote. A digest with the hash of its
    page changes nothing but, where it differs, the tier; any other replaces title, body and hash and is stamped.
    Pages without a digest in this run stay as they are. first_seen never changes. The same run again changes nothing.
    """
    p = pages.select("path", F.struct("title", "body", "hash", "tier", "first_seen", "updated_on").alias("p"))
    d = digests.select("path", F.struct("title", "body", "hash", "tier").alias("d"))
    new, old = F.col("d").isNotNull(), F.col("p").isNotNull()
    same = F.col("p.hash").eqNullSafe(F.col("d.hash"))
    status = F.when(~new, "kept").when(~old, "created").when(~same, "updated").when(~F.col("p.tier").eqNullSafe(F.col("d.tier")), "retiered").otherwise("unchanged")
    written = new & (~old | ~same)
    pick = lambda c, yes: F.when(yes, F.col(f"d.{c}")).otherwise(F.col(f"p.{c}")).alias(c)
    return p.join(d, "path", "full").select(
        "path", pick("title", written), pick("body", written), pick("hash", written), pick("tier", new),
        F.coalesce("p.first_seen", now).alias("first_seen"), F.when(written, now).otherwise(F.col("p.updated_on")).alias("updated_on"), status.alias("status"),
    )


# ------------------------------------------------------------------ review queue


def _masked(value):
    if isinstance(value, dict):
        return {k: HIDDEN if k in CONTENT_KEYS else _masked(v) for k, v in value.items()}
    return [_masked(v) for v in value] if isinstance(value, list) else value


def _mask(payload: str | None) -> str | None:
    if payload is None:
        return None
    try:
        return json.dumps(_masked(json.loads(payload)), separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):  # no JSON, or nested deeper than can be read
        return json.dumps(HIDDEN)


@F.pandas_udf(StringType())
def mask_payload(payload: pd.Series) -> pd.Series:
    """Every value of a content key, whatever it is and at any depth, shows a placeholder; so does a payload that is no JSON."""
    return payload.map(_mask)


def masked_queue(queue: DataFrame, nodes: DataFrame, allowed: int = 1) -> DataFrame:
    """Queue rows for a reader: content masked, titles re-read through the reader's tier.

    queue(item_id, kind, ref_type, ref_id, label, payload, created_on).
    """
    n = nodes.filter(visible(F.col("tier"), allowed)).select(
        F.col("type").alias("ref_type"), F.col("id").alias("ref_id"), F.substring("title", 1, 120).alias("_title")
    )
    reread = F.col("kind").isin("stale", "duplicate", "decision_review")
    return (
        queue.join(n, ["ref_type", "ref_id"], "left")
        .withColumn("label", F.when(reread, F.coalesce("_title", F.lit(HIDDEN))).otherwise(F.col("label")))
        .withColumn("payload", mask_payload(F.col("payload")))
        .drop("_title")
    )


def resolve_items(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Apply (item_id, verdict) with verdict resolved or dismissed; other items stay as they are."""
    v = verdicts.filter(F.col("verdict").isin("resolved", "dismissed")).groupBy("item_id").agg(F.max("verdict").alias("_v"))
    return queue.join(v, "item_id", "left").withColumn("status", F.coalesce("_v", "status")).drop("_v")
