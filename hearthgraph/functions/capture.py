"""Reading a short captured text: its class, its completion report and its two halves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WB0, WB1, any_word

# fixed values: cues of the capture rules
COMPLETION = "done|finished|completed?|confirmed|works|worked|working|succeeded|success(?:ful)?|achieved|shipped|resolved|fixed"
ORG_CUE = (
    r"company|companies|vendor|supplier|corp(?:oration)?|inc\.?|ltd\.?|llc|gmbh|s\.?a\.?|pte\.?|co\.?|biotech|bioscience|"
    r"laborator(?:y|ies)|institute|university|clinic|hospital|foundation|agency|firm|startup|manufacturer|distributor|"
    r"contractor|consultancy|consulting"
)
MET = "met|call(?:ed)? with|talked to|coffee with|lunch with"
SESSION_HINT = "<!-- hint: agent work session -->"


def completed(text: Column) -> Column:
    return text.rlike(f"(?i){any_word(COMPLETION)}")


def org_cue(text: Column) -> Column:
    return text.rlike(f"(?i){any_word(ORG_CUE)}")


def first_line(text: Column) -> Column:
    """First line without a leading comment mark."""
    line = F.split_part(F.trim(text), F.lit("\n"), F.lit(1))
    return F.trim(F.regexp_replace(line, r"^<!--.*?-->\s*", ""))


def due_or_null(due: Column, today: Column) -> Column:
    """A proposed date is kept only when well-formed and not before today."""
    ok = due.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    return F.when(ok & (due >= F.date_format(today, "yyyy-MM-dd")), F.try_to_date(due))


def due_note(due: Column, today: Column) -> Column:
    ok = due.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (due < F.date_format(today, "yyyy-MM-dd"))
    return F.when(ok, F.concat(F.lit("past due date dropped: "), due))


def done_title(text: Column) -> Column:
    """The leading clause before the text turns to what is next, without a decision prefix."""
    line = first_line(text)
    turn = rf"(?i)\s*(?:[.;]|{WB0}but{WB1}|{WB0}however{WB1}|{WB0}need to{WB1}|{WB0}note:)"
    clause = F.trim(F.get(F.split(line, turn, 2), F.lit(0)))
    base = F.when(clause != "", clause).otherwise(line)
    return F.substring(F.trim(F.regexp_replace(base, rf"(?i)^(decision|decided){WB1}[:\s-]*", "")), 1, 120)


SPLIT = rf"(?i)^(.*?\S)\s+and\s+(decide|determine)\s+(on|whether|if|between|about|to){WB1}\s*(.*)$"


def action_and_decision(text: Column) -> Column:
    """struct(action, decision) of a 'do X and decide on Y' capture, else null."""
    line = F.trim(F.regexp_replace(first_line(text), r"(?i)^(todo|task)[:\s]+", ""))
    action = F.trim(F.regexp_extract(line, SPLIT, 1))
    tail = F.concat(F.lit("Decide "), F.lower(F.regexp_extract(line, SPLIT, 3)), F.lit(" "), F.trim(F.regexp_extract(line, SPLIT, 4)))
    ok = (
        ~completed(text)
        & line.rlike(SPLIT)
        & (F.length(action) >= 3)
        & ~action.rlike(rf"(?i)^(decide|determine|decision){WB1}")
    )
    return F.when(ok, F.struct(action.alias("action"), F.trim(F.regexp_replace(tail, r"\s+", " ")).alias("decision")))


def classify(text: Column) -> Column:
    """struct(type, confidence, title, due, name, kind, subject_type, reason): the first rule that fits."""
    t = F.trim(text)
    low = F.lower(t)
    line = first_line(text)
    none = F.lit(None).cast("string")

    def out(kind, conf, reason, title=none, due=none, name=none, how=none, subject=none):
        return F.struct(
            F.lit(kind).alias("type"), F.lit(conf).cast("double").alias("confidence"), title.alias("title"), due.alias("due"),
            name.alias("name"), how.alias("kind"), subject.alias("subject_type"), F.lit(reason).alias("reason"),
        )

    bare = F.trim(F.regexp_replace(line, r"(?i)^(todo|task)[:\s]+", ""))
    by = F.regexp_extract(low, rf"{WB0}by ([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}){WB1}", 1)
    # the verb is read in any case, and so is the name that follows it
    who = F.regexp_extract(line, rf"(?i)^(?:{MET})\s+([A-Z][\w'-]+(?:\s[A-Z][\w'-]+)?)", 1)
    return (
        F.when((F.length(t) < 3) | ~t.rlike("[A-Za-z]"), out("unknown", 0.2, "too short or no letters"))
        .when(low.startswith("unclear:"), out("unknown", 0.3, "marked unclear"))
        .when(
            line.rlike(r"(?i)^(todo|task)[:\s]") | low.rlike(any_word("remind me")),
            out("task", 0.9, "task prefix or reminder", title=F.when(bare != "", bare).otherwise(line), due=F.when(by != "", by)),
        )
        .when(
            line.rlike(rf"(?i)^({MET}){WB1}"),
            out(
                "interaction", 0.85, "opens with a meeting verb", name=F.when(who != "", who).otherwise("Unknown"),
                how=F.when(line.rlike("(?i)call"), "call").otherwise("meeting"), subject=F.when(org_cue(line), "org").otherwise("person"),
            ),
        )
        .when(line.rlike(r"(?i)^(decided|decision[:\s])"), out("decision_note", 0.8, "opens with a decision", title=line))
        .when(
            low.rlike(any_word("today|feeling|grateful|tired|mood")) & low.rlike(any_word("i|my|me")),
            out("journal", 0.8, "first-person reflection"),
        )
        .when(F.length(t) > 40, out("note", 0.75, "long text without a cue", title=F.substring(line, 1, 80)))
        .otherwise(out("unknown", 0.4, "no cue"))
    )
