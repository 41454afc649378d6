"""English stems of index terms (the published Porter2 rules), computed once per distinct term, of all or of a batch."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: words with a stem of their own, words left alone after the plural step, suffix tables
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
STOP_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = [
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"),
    ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"),
    ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"),
]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic"]

VOWEL = "aeiouy"
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _after(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.fullmatch(r"[aeiouy][^aeiouy]", word))


def _suffix(word: str, table: list) -> tuple[str, str] | None:
    return next(((s, r) for s, r in table if word.endswith(s)), None)


def stem(word: str) -> str:
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = re.sub(f"(?<=[{VOWEL}])y", "Y", "Y" + word[1:] if word[0] == "y" else word)
    head = re.match("gener|commun|arsen", w)
    r1 = head.end() if head else _after(w, 0)
    r2 = _after(w, r1)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{VOWEL}].", w[:-1]):
        w = w[:-1]
    if w in STOP_AFTER_PLURAL:
        return w
    # past and progressive forms
    m = re.search("(eedly|ingly|edly|eed|ing|ed)$", w)
    if m:
        base = w[: m.start()]
        if m.group().startswith("eed"):
            w = base + "ee" if m.start() >= r1 else w
        elif re.search(f"[{VOWEL}]", base):
            if base.endswith(("at", "bl", "iz")):
                w = base + "e"
            elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", base):
                w = base[:-1]
            else:
                w = base + "e" if len(base) <= r1 and _short_end(base) else base
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWEL:
        w = w[:-1] + "i"
    # derivational endings
    hit = _suffix(w, STEP2)
    if hit:
        if len(w) - len(hit[0]) >= r1:
            w = w[: -len(hit[0])] + hit[1]
    elif w.endswith("ogi"):
        w = w[:-1] if len(w) - 3 >= r1 and w[-4:-3] == "l" else w
    elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] and w[-3] in "cdeghkmnrt":
        w = w[:-2]
    hit = _suffix(w, STEP3)
    if hit:
        if len(w) - len(hit[0]) >= r1:
            w = w[: -len(hit[0])] + hit[1]
    elif w.endswith("ative") and len(w) - 5 >= r2:
        w = w[:-5]
    end = next((s for s in STEP4 if w.endswith(s)), None)
    if end:
        w = w[: -len(end)] if len(w) - len(end) >= r2 else w
    elif w.endswith(("sion", "tion")) and len(w) - 3 >= r2:
        w = w[:-3]
    if w.endswith("e"):
        n = len(w) - 1
        if n >= r2 or (n >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@lru_cache(200_000)
def _stem_of(word: str) -> str:
    return stem(word)


@F.pandas_udf(T.StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem)


def stemmed(terms: DataFrame) -> DataFrame:
    """Replace the `term` column by its stem; each distinct term is stemmed once and joined back."""
    vocab = terms.select("term").distinct().withColumn("_stem", _stems("term"))
    return terms.join(vocab, "term").withColumn("term", F.col("_stem")).drop("_stem")


def stemmed_texts(texts: DataFrame, stop: list[str]) -> DataFrame:
    """(..., said) with said, a list of terms, as one string of its stems with a blank between; a stop word leaves its place empty.

    Found beside the scan, each distinct term of a batch once.
    """
    none = frozenset(stop)
    rest = [c for c in texts.columns if c != "said"]

    def found(batches):
        for batch in batches:
            lists = batch.column("said")
            said = lists.flatten().dictionary_encode()
            known = pa.array(["" if w in none else _stem_of(w) for w in said.dictionary.to_pylist()], pa.string())
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            stems = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), known.take(said.indices))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pc.binary_join(stems, " ")], names=[*rest, "said"])

    return texts.mapInArrow(found, ", ".join(f"`{c}` {t}" for c, t in texts.select(*rest).dtypes) + ", said string")
