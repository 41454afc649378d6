"""Readers of exported files: calendars, bank CSV, health XML, mail headers, pages and agent sessions.

Each format has a reader that lets Spark split the files and a parser that works on the read table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import clock
from .merge import split_rejects

def arrival() -> Column:
    """Where a row of a file source stands: file, block and place in it. The first of equal keys is the least."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("arrival")


def _carried(rows: DataFrame) -> list[str]:
    """Parsers pass the arrival of their rows on, if they have one."""
    return [c for c in rows.columns if c == "arrival"]


# ------------------------------------------------------------------ calendars


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """One row per piece of an ICS file, cut after each event, so one large export is read in parallel."""
    return spark.read.option("lineSep", "END:VEVENT").text(path).select(F.col("value").alias("block"))


def _ics_instant(v: Column, zone: str) -> Column:
    wall = F.concat_ws(" ", F.regexp_replace(F.substring(v, 1, 8), "(....)(..)(..)", "$1-$2-$3"),
                       F.regexp_replace(F.substring(v, 10, 6), "(..)(..)(..)", "$1:$2:$3"))
    utc = F.try_to_timestamp(wall)
    return (
        F.when(v.rlike("^[0-9]{8}T[0-9]{6}Z$"), utc)
        .when(v.rlike("^[0-9]{8}T[0-9]{6}$"), clock.wall_to_instant(utc, zone))
        .when(v.rlike("^[0-9]{8}$"), clock.wall_to_instant(F.try_to_timestamp(F.regexp_replace(v, "(....)(..)(..)", "$1-$2-$3")), zone))
    )


def parse_calendar(blocks: DataFrame, zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """(events, rejects). Folded lines are joined, keys read before ';' or ':' in any case, the last of a key wins."""
    inner = F.regexp_extract("block", r"(?s)BEGIN:VEVENT(.*)$", 1)
    lines = F.split(F.regexp_replace(inner, r"\r?\n[ \t]", ""), r"\r?\n")

    def values(key: str) -> Column:
        mark = rf"(?i)^{key}(?:;[^:]*)?:(.*)$"
        return F.transform(F.filter(lines, lambda x: x.rlike(mark)), lambda x: F.regexp_extract(x, mark, 1))

    last = lambda key: F.try_element_at(values(key), F.lit(-1))
    comma = lambda c: F.regexp_replace(c, r"\\,", ",")
    e = blocks.filter(F.col("block").contains("BEGIN:VEVENT")).select(
        last("UID").alias("uid"), _ics_instant(last("DTSTART"), zone).alias("starts_at"), _ics_instant(last("DTEND"), zone).alias("ends_at"),
        F.regexp_replace(comma(last("SUMMARY")), r"\\n", "\n").alias("title"), comma(last("LOCATION")).alias("location"),
        F.transform(values("ATTENDEE"), lambda a: F.regexp_replace(a, "(?i)^mailto:", "")).alias("attendees"),
    )
    miss = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return split_rejects(e, {"missing uid/dtstart/summary": miss("uid") | F.col("starts_at").isNull() | miss("title")})


# ------------------------------------------------------------------ bank CSV


@dataclass(frozen=True)
class BankProfile:
    """How one bank names its columns and writes dates and signs."""

    account_label: str
    currency: str
    date: str
    amount: str
    merchant: str
    category: str
    external_ref: str
    date_format: str = "dd/MM/yyyy"
    negative_is_spend: bool = True


def read_bank_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, quote='"', escape='"').select("*", arrival())


def parse_bank(rows: DataFrame, p: BankProfile) -> tuple[DataFrame, DataFrame]:
    """(transactions, rejects): cents, ISO day, and a 24-digit hash of the row where no reference is given."""
    amount = F.regexp_replace(F.col(f"`{p.amount}`"), "[, ]", "").try_cast("decimal(18,2)")
    cents = (amount * 100).cast("bigint")
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (p.date, p.amount, p.merchant, p.category)]
    ref = F.trim(F.col(f"`{p.external_ref}`"))
    t = rows.select(
        F.lit(p.account_label).alias("account_label"),
        F.when(F.length(F.coalesce(ref, F.lit(""))) > 0, ref).otherwise(F.substring(F.sha2(F.concat_ws("|", *text), 256), 1, 24)).alias("external_ref"),
        F.to_date(F.try_to_timestamp(F.col(f"`{p.date}`"), F.lit(p.date_format))).alias("occurred_on"),
        (cents if p.negative_is_spend else -cents).alias("amount_cents"), F.lit(p.currency).alias("currency"),
        F.col(f"`{p.merchant}`").alias("merchant"), F.nullif(F.trim(F.col(f"`{p.category}`")), F.lit("")).alias("category"),
        *_carried(rows),
    )
    return split_rejects(t, {"bad date": F.col("occurred_on").isNull(), "bad amount": F.col("amount_cents").isNull()})


# ------------------------------------------------------------------ health XML

# fixed values: record types that are kept, with kind, unit and whether the value is a duration
HEALTH_TYPES = [
    ("HKQuantityTypeIdentifierStepCount", "steps", "steps", False),
    ("HKQuantityTypeIdentifierRestingHeartRate", "hr_resting", "bpm", False),
    ("HKQuantityTypeIdentifierHeartRate", "hr", "bpm", False),
    ("HKQuantityTypeIdentifierBodyMass", "body_mass", "kg", False),
    ("HKCategoryTypeIdentifierSleepAnalysis", "sleep_minutes", "minutes", True),
]
def read_health(spark: SparkSession, path: str) -> DataFrame:
    """Record tags of an export. Text pieces end at '/>', so one file of gigabytes is read by many tasks."""
    return health_tags(spark.read.option("lineSep", "/>").text(path).select("value", arrival()))


def health_tags(pieces: DataFrame) -> DataFrame:
    """(value) text pieces -> the attributes of the record tag each one ends in."""
    tag = F.regexp_extract("value", r"<Record\b([^>]*)$", 1)
    attr = lambda n: F.when(F.col("tag").rlike(rf'\b{n}="'), F.regexp_extract("tag", rf'\b{n}="([^"]*)"', 1)).alias(f"_{n}")
    kept = _carried(pieces)
    return pieces.select(tag.alias("tag"), *kept).filter("tag <> ''").select(*[attr(n) for n in ("type", "sourceName", "unit", "startDate", "endDate", "value")], *kept)


def _health_instant(c: str) -> Column:
    ok = F.col(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}$")
    return F.when(ok, F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss Z")))


def parse_health(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, rejects). Other types and sleep that is not asleep are left out silently."""
    spark = records.sparkSession
    kinds = spark.createDataFrame(HEALTH_TYPES, "_type string, kind string, kind_unit string, is_duration boolean")
    r = records.join(F.broadcast(kinds), "_type").withColumn("happened_at", _health_instant("_startDate")).withColumn("until", _health_instant("_endDate"))
    asleep = F.col("until").isNotNull() & F.coalesce(F.col("_value").rlike("(?i)Asleep"), F.lit(False))
    r = r.filter(F.col("happened_at").isNull() | ~F.col("is_duration") | asleep)
    minutes = (F.unix_micros("until") - F.unix_micros("happened_at")) / 60000000
    s = r.select(
        "kind", "happened_at", F.when(F.col("is_duration"), minutes).otherwise(F.col("_value").try_cast("double")).alias("value"), F.col("kind_unit").alias("unit"),
        F.coalesce("_sourceName", F.lit("apple-health")).alias("source"), *_carried(records),
    )
    return split_rejects(s, {"bad startDate": F.col("happened_at").isNull(), "bad value": F.col("value").isNull()})


# ------------------------------------------------------------------ mail headers


def read_maildir(spark: SparkSession, path: str) -> DataFrame:
    """Messages under cur and new, one row each; dot files are left out by the file source itself."""
    return spark.read.option("recursiveFileLookup", "true").text([f"{path}/cur", f"{path}/new"], wholetext=True).select(F.col("value").alias("raw"), arrival())


def parse_mail(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(email_meta, rejects): headers only. The body is cut off before anything else is read."""
    head = F.get(F.split("raw", r"\r?\n\r?\n", 2), F.lit(0))
    lines = F.split(F.regexp_replace(head, r"\r?\n[ \t]+", " "), r"\r?\n")

    def header(key: str) -> Column:
        mark = rf"(?i)^{key}:\s*(.*)$"
        hit = F.try_element_at(F.filter(lines, lambda x: x.rlike(mark)), F.lit(-1))
        return F.nullif(F.trim(F.regexp_extract(hit, mark, 1)), F.lit(""))

    angled = lambda c: F.nullif(F.regexp_extract(c, "<([^>]+)>", 1), F.lit(""))
    plain = F.trim(F.regexp_replace(F.regexp_replace(header("date"), r"^[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)$", ""))
    when = F.coalesce(
        F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(plain)
    )
    mid = F.regexp_replace(header("message-id"), "[<>]", "")
    m = messages.select(
        mid.alias("message_id"), when.alias("happened_at"), F.coalesce(angled(header("from")), header("from")).alias("from_addr"), header("subject").alias("subject"),
        F.coalesce(angled(header("references")), angled(header("in-reply-to")), mid).alias("thread_id"), F.lit(2).alias("tier"), *_carried(messages),
    )
    bad = F.col("message_id").isNull() | F.col("from_addr").isNull() | F.col("happened_at").isNull()
    return split_rejects(m, {"missing message-id/from/date": bad})


# ------------------------------------------------------------------ pages


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")).select(
        F.regexp_replace("file", r"^.*?" + path.rstrip("/").replace(".", r"\.") + "/", "").alias("path"), "raw"
    )


def parse_pages(files: DataFrame) -> DataFrame:
    """(path, raw) -> (path, title, tier, status, body, hash): front matter, else the first heading, else the file's name."""
    front = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?"
    head = F.regexp_extract("raw", front, 1)
    body = F.regexp_replace("raw", front, "")

    def field(key: str) -> Column:
        v = F.trim(F.regexp_extract(head, rf"(?m)^{key}:[ \t]*(.*?)\r?$", 1))
        return F.nullif(F.regexp_replace(v, "^[\"']|[\"']$", ""), F.lit(""))

    h1 = F.nullif(F.trim(F.regexp_extract(body, r"(?m)^#[ \t]+(.+)$", 1)), F.lit(""))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    tier = F.when(field("tier").rlike("^[012]$"), field("tier").try_cast("int")).otherwise(1)
    return files.select(
        "path", F.coalesce(field("title"), h1, stem).alias("title"), tier.alias("tier"), F.coalesce(field("status"), F.lit("active")).alias("status"),
        body.alias("body"), F.sha2("raw", 256).alias("hash"),
    )


# ------------------------------------------------------------------ agent sessions


def clip(text: Column, most: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…")))


SESSION = T.StructType().add("session_id", "string").add("type", "string").add("isMeta", "boolean").add("timestamp", "string").add(
    "message", T.StructType().add("role", "string").add("content", "string")
)
BLOCKS = T.ArrayType(
    T.StructType().add("type", "string").add("text", "string").add("name", "string").add("input", T.StructType().add("file_path", "string"))
)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Transcript lines as turns; content is a string or a list of typed blocks."""
    j = spark.read.schema(SESSION).json(path)
    blocks = F.from_json("message.content", BLOCKS)
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"])
    files = F.transform(
        F.filter(blocks, lambda b: (b["type"] == "tool_use") & b["name"].isin("Write", "Edit", "NotebookEdit")), lambda b: b["input"]["file_path"]
    )
    as_blocks = F.col("message.content").startswith("[") & blocks.isNotNull()
    return j.select(
        "session_id", F.col("timestamp").alias("turn"), F.col("type").alias("role"), F.coalesce("isMeta", F.lit(False)).alias("is_meta"),
        F.trim(F.when(as_blocks, F.array_join(texts, "\n")).otherwise(F.col("message.content"))).alias("text"),
        F.coalesce(F.when(as_blocks, files), F.array().cast("array<string>")).alias("files"),
    )


def session_summaries(turns: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """One summary per session of two or more real prompts: first request, last answer, files, span.

    turns(session_id, turn, role, is_meta, text, files). `done` lists session ids summarized before.
    Only first, last and counts are aggregated; file lists keep the first twenty and a count.
    """
    t = turns if done is None else turns.join(done.select("session_id").distinct(), "session_id", "left_anti")
    prompt = (F.col("role") == "user") & ~F.col("is_meta") & (F.col("text") != "") & ~F.col("text").startswith("<")
    answer = (F.col("role") == "assistant") & (F.col("text") != "")
    base = t.groupBy("session_id").agg(
        F.count(F.when(prompt, 1)).alias("prompts"), F.min_by("text", F.when(prompt, F.col("turn"))).alias("first"),
        F.max_by("text", F.when(answer, F.col("turn"))).alias("final"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
    )
    f = t.select("session_id", "turn", F.posexplode("files").alias("i", "file")).filter("file is not null")
    f = f.groupBy("session_id", "file").agg(F.min(F.struct("turn", "i")).alias("at"))
    f = f.withColumn("rn", F.row_number().over(Window.partitionBy("session_id").orderBy("at", "file")))
    few = f.filter("rn <= 20").groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "file"))), lambda x: x["file"]).alias("files"))
    n = f.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_files"))
    out = base.filter("prompts >= 2").join(few, "session_id", "left").join(n, "session_id", "left")
    return out.select(
        "session_id", "prompts", clip(F.col("first"), 500).alias("request"), F.coalesce(clip(F.col("final"), 700), F.lit("(no final summary)")).alias("outcome"),
        "first_turn", "last_turn", F.coalesce("files", F.array().cast("array<string>")).alias("files"), F.coalesce("n_files", F.lit(0).cast("bigint")).alias("n_files"),
    )
