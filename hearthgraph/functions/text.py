"""Column expressions over text: folding, terms, titles, intent, snippets, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"㐀-䶿一-鿿"
# ASCII word edges: Java's own \b also treats accented letters as word characters
WB0, WB1 = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"


def any_word(words: str) -> str:
    return f"{WB0}({words}){WB1}"


# fixed values: the English stop list of the full-text index
ENGLISH_STOP = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing",
    "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
]

# fixed values: Han characters that carry no content
HAN_STOP = "的一了是我不在有这那他她它们你您么什哪里谁个上中下要会能可以和与就都还也很到从把被让为多少每天年月日时候后前先看做去过来吗呢啊吧没好再又只但如果因所然"

# fixed values: filler words of the title match
TITLE_STOP = [
    "a", "an", "and", "the", "of", "to", "in", "on", "for", "with", "is", "are", "was", "were", "my", "me", "i", "it", "this", "that", "about",
    "what", "who", "when", "how",
]

# fixed values: cues of the query intent and the months
TEMPORAL_CUES = [
    "as of", "latest", "most recent", "recently", "recent", "current", "currently", "today", "yesterday", "this week",
    "last week", "this month", "last month", "this year", "last year",
]
EVENT_CUES = [
    "what happened", "what did", "meeting", "meetings", "call", "calls", "event", "conversation", "discussion", "talked",
    "spoke", "happened", "occurred", "trip",
]
ENTITY_CUES = ["who is", "who's", "profile of", "contact for", "page for"]
# a month in full or by its first three letters; May is left out, being a common verb
MONTHS = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)


def _hex4(ch: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.ascii(ch))), 4, "0")


def _fold(text: Column, gram, single) -> Column:
    runs = F.regexp_extract_all(text, F.lit(f"([{HAN}]+|[^{HAN}]+)"), F.lit(1))

    def one(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: gram(run, i))
        return (
            F.when(~run.rlike(f"[{HAN}]"), run)
            .when(F.length(run) == 1, F.concat(F.lit(" "), single(run), F.lit(" ")))
            .otherwise(F.concat(F.lit(" "), F.array_join(pairs, " "), F.lit(" ")))
        )

    return F.when(text.rlike(f"[{HAN}]"), F.array_join(F.transform(runs, one), "")).otherwise(text)


def fold_han(text: Column) -> Column:
    """Han runs become overlapping character pairs spelled zh + four hex digits each; other text is kept."""
    return _fold(
        text,
        lambda r, i: F.concat(F.lit("zh"), _hex4(F.substring(r, i, F.lit(1))), _hex4(F.substring(r, i + 1, F.lit(1)))),
        lambda r: F.concat(F.lit("zh"), _hex4(r)),
    )


def fold_han_raw(text: Column) -> Column:
    """The same pairs in the original characters, as the offline embedding wants them."""
    return _fold(text, lambda r, i: F.substring(r, i, F.lit(2)), lambda r: r)


def terms(text: Column) -> Column:
    """Folded, lowercased runs of letters and digits."""
    return F.filter(F.split(F.lower(fold_han(text)), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def is_folded(token: Column) -> Column:
    return token.rlike("^zh([0-9a-f]{4})+$")


def is_han_stop(token: Column) -> Column:
    """A folded token made only of function characters; raw Han tokens count as well."""
    codes = "|".join(f"{ord(c):04x}" for c in dict.fromkeys(HAN_STOP))
    return token.rlike(f"^zh({codes})+$") | token.rlike(f"^[{HAN_STOP}]+$")


def token_count(text: Column) -> Column:
    """Whitespace words, a word with Han characters counting one per character."""
    ws = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.aggregate(
        F.transform(ws, lambda w: F.greatest(F.lit(1), F.regexp_count(w, F.lit(f"[{HAN}]")))), F.lit(0), lambda a, x: a + x
    )


# ------------------------------------------------------------------ query side


def has_any(low: Column, cues: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(c) for c in cues])


def intent(query: Column) -> Column:
    """temporal, then event, then entity, then general."""
    low = F.lower(query)
    toks = F.filter(F.split(F.trim(query), r"\s+"), lambda x: x != "")
    only_han = F.trim(F.regexp_replace(query, f"[{HAN}]", "")) == ""
    namelike = F.size(toks).between(1, 3) & (only_han | F.forall(toks, lambda t: t.rlike("^[A-Z]")))
    return (
        F.when(has_any(low, TEMPORAL_CUES) | low.rlike(any_word(MONTHS)), "temporal")
        .when(has_any(low, EVENT_CUES), "event")
        .when(has_any(low, ENTITY_CUES) | namelike, "entity")
        .otherwise("general")
    )


def intent_scales(name: Column) -> dict[str, Column]:
    """The one lever each intent moves: title lift, recency lift or lexical weight."""
    return {
        "title_scale": F.when(name == "entity", 1.4).otherwise(1.0),
        "recency_scale": F.when(name == "temporal", 1.6).otherwise(1.0),
        "lexical_weight": F.when(name == "event", 1.25).otherwise(1.0),
    }


def title_boost(query: Column, title: Column, scale: Column) -> Column:
    """Query tokens standing as one run of whole tokens inside the title lift the score."""
    q, t = terms(query), terms(title)

    def fence(tokens: Column) -> Column:
        return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))

    content = F.filter(q, lambda x: is_folded(x) | ~x.isin(TITLE_STOP))
    run = (F.size(q) > 0) & fence(t).contains(fence(q))
    return (
        F.when(run & (F.size(q) == F.size(t)), F.lit(1) + F.lit(0.4) * scale)
        .when(run & (F.size(content) >= 2), F.lit(1) + F.lit(0.25) * scale)
        .otherwise(F.lit(1.0))
    )


def snippet(text: Column, query: Column, limit: int = 400) -> Column:
    """The sentence with most query terms and its neighbours, cut at `limit` characters."""
    sents = F.split(text, r"(?<=[.!?])\s+")
    words = F.filter(F.split(F.lower(query), r"\W+"), lambda t: F.length(t) > 2)
    scores = F.transform(sents, lambda s: F.size(F.filter(words, lambda t: F.contains(F.lower(s), t))))
    best = F.array_position(scores, F.array_max(scores)).cast("int")
    start = F.greatest(best - 1, F.lit(1))
    out = F.array_join(F.slice(sents, start, best + 2 - start), " ")
    return F.when(F.length(out) > limit, F.concat(F.substring(out, 1, limit), F.lit("…"))).otherwise(out)


# ------------------------------------------------------------------ redaction

UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
IBAN = any_word("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
CARD = f"{WB0}(?:[0-9][ -]?){{13,19}}{WB1}"
ACCOUNT = f"{WB0}[0-9]{{9,}}{WB1}"
_MARK = "\u0001"


def _pieces(text: Column, pattern: str) -> Column:
    """Array of alternating gaps and matches: gap, match, gap, ..."""
    gaps = F.split(text, pattern)
    found = F.concat(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.array(F.lit("")))
    return F.arrays_zip(gaps.alias("gap"), found.alias("hit"))


def _replace_cards(text: Column) -> Column:
    def one(p: Column) -> Column:
        digits = F.regexp_replace(p["hit"], "[ -]", "")
        luhn = F.call_function("luhn_check", digits) & F.length(digits).between(13, 19)
        return F.concat(p["gap"], F.when(p["hit"] == "", "").when(luhn, "[REDACTED:card]").otherwise(p["hit"]))

    return F.when(text.rlike(CARD), F.array_join(F.transform(_pieces(text, CARD), one), "")).otherwise(text)


def redact(text: Column) -> Column:
    """IBANs, then Luhn-valid card numbers, then other runs of nine and more digits; UUIDs pass unchanged."""

    def scrub(part: Column) -> Column:
        no_iban = F.regexp_replace(part, IBAN, "[REDACTED:iban]")
        return F.regexp_replace(_replace_cards(no_iban), ACCOUNT, "[REDACTED:account]")

    def one(p: Column) -> Column:
        return F.concat(scrub(p["gap"]), p["hit"])

    with_ids = F.array_join(F.transform(_pieces(text, UUID), one), "")
    return F.when(text.rlike(UUID), with_ids).when(text.rlike("[0-9]{2}"), scrub(text)).otherwise(text)


def redactions(clean: Column, kind: str) -> Column:
    return F.regexp_count(clean, F.lit(rf"\[REDACTED:{kind}\]"))
