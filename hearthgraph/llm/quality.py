"""A quality classifier: rules from trees over text statistics, weighted by a lasso, compiled to columns."""

from __future__ import annotations

import math
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import one_per_id

#: Labelled rows at most that the classifier is fitted on, picked by a hash of their id.
FIT_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, LEAST, STEP = 30, 3, 32, 20, 0.3
LASSO, ROUNDS = 1e-3, 400


#: What is measured of a text, each a number of its own: see `measure`.
STATISTICS = ["length", "word_length", "symbols", "bars", "shouts", "stops", "digits", "capitals", "letters", "short_words", "doubled", "lines", "repeated_lines"]
_CLASSES = {"symbols": b"#$%&*+/<=>@\\^_`{|}~[]", "bars": b"|", "shouts": b"!?", "stops": b".,;:", "digits": b"0123456789"}


def _shares() -> np.ndarray:
    """A row of weights over the 256 byte values for each class of characters."""
    out = np.zeros((len(_CLASSES) + 2, 256))
    for i, chars in enumerate(_CLASSES.values()):
        out[i, list(chars)] = 1
    out[-2, 65:91] = 1  # capitals: of ASCII only
    out[-1, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1  # letters: of ASCII, and all bytes beyond
    return out


_SHARES = _shares()


def measure(text: str) -> list[float]:
    """The statistics of one whole text: shares of its bytes, words or lines; none reads anything but the text."""
    raw = text.encode("utf-8", "surrogatepass")
    classes = _SHARES @ np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) / max(1, len(raw))
    words, lines = raw.split(), raw.split(b"\n")
    many = max(1, len(words))
    short = sum(1 for w in words if len(w) < 4)
    doubled = sum(map(eq, words, islice(words, 1, None)))
    return [math.log1p(len(raw)), len(raw) / many, *classes, short / many, doubled / many, len(lines) / many, 1 - len(set(lines)) / len(lines)]


@F.arrow_udf(StructType([StructField(n, DoubleType()) for n in STATISTICS]))
def statistics(texts: pa.Array) -> pa.Array:
    """The statistics of a column of texts, as a struct; a null text counts as empty."""
    rows = np.array([measure(t.as_py() or "") for t in texts]).reshape(-1, len(STATISTICS))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(STATISTICS))], STATISTICS)


class Rule:
    """A conjunction of conditions (feature, is it above, value)."""

    def __init__(self, parts: tuple):
        self.parts = parts

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for f, above, v in self.parts:
            out &= (x[:, f] > v) if above else (x[:, f] <= v)
        return out

    def column(self, names: list[str]) -> Column:
        out = F.lit(True)
        for f, above, v in self.parts:
            out = out & ((F.col(names[f]) > F.lit(float(v))) if above else (F.col(names[f]) <= F.lit(float(v))))
        return out


def grow(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The distinct paths of boosted trees, each fitted on half of the rows."""
    rng = np.random.default_rng(5)
    # cuts at quantiles of the rows, and of the values for what is 0 in nearly all rows
    inner = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique([np.quantile(v, inner, method="lower") for v in (x[:, f], np.unique(x[:, f]))]) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    score = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[tuple, Rule] = {}
    least = max(3, min(LEAST, len(y) // 25))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
        used = rng.random(len(y)) < 0.5
        feats = rng.permutation(x.shape[1])[: max(2, x.shape[1] // 2)]
        step = np.zeros(len(y))

        def split(rows: np.ndarray, depth: int, parts: tuple) -> None:
            mine = rows & used
            total_g, total_h = grad[mine].sum(), hess[mine].sum()
            best = (1e-6, None, None)
            if depth < DEPTH and mine.sum() >= 2 * least:
                for f in feats:
                    size = len(edges[f]) + 1
                    g = np.cumsum(np.bincount(bins[mine, f], grad[mine], size))[:-1]
                    h = np.cumsum(np.bincount(bins[mine, f], hess[mine], size))[:-1]
                    k = np.cumsum(np.bincount(bins[mine, f], minlength=size))[:-1]
                    gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                    gain = np.where((k >= least) & (mine.sum() - k >= least), gain, 0)
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), f, int(gain.argmax()))
            if best[1] is None:
                step[rows] = STEP * total_g / (total_h + 1)
                return
            _, f, at = best
            below = bins[:, f] <= at
            for above in (False, True):
                path = (*parts, (int(f), above, float(edges[f][at])))
                rules.setdefault(path, Rule(path))
                split(rows & (~below if above else below), depth + 1, path)

        split(np.ones(len(y), dtype=bool), 0, ())
        score = score + step
    return list(rules.values())


def lasso(r: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Sparse logistic weights of 0/1 columns by accelerated proximal steps; the intercept is not punished."""
    a = np.hstack([r, np.ones((len(r), 1), dtype=r.dtype)])
    w = z = np.zeros(a.shape[1])
    w[-1] = 0.0
    # a bound of the curvature by a few power steps
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    size = 4 * len(y) / (np.linalg.norm(a @ v) ** 2 * 1.05)
    t = 1.0
    for _ in range(ROUNDS):
        g = a.T @ (1 / (1 + np.exp(-(a @ z))) - y) / len(y)
        new = z - size * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - size * LASSO, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / nt * (new - w)
        w, t = new, nt
    return w[:-1], float(w[-1])


class Classifier:
    """Weighted rules over the statistics; without rules, the share of good rows."""

    def __init__(self, names: list[str], x: np.ndarray, y: np.ndarray):
        self.names = names
        if len(y) and 0 < y.mean() < 1:
            rules = grow(x, y)
            held = np.stack([k.holds(x) for k in rules], axis=1) if rules else np.zeros((len(y), 0), dtype=bool)
            weights, self.base = lasso(held.astype(np.float64), y)
            self.rules = [(k, float(w)) for k, w in zip(rules, weights) if abs(w) > 1e-6]
        else:
            share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
            self.rules, self.base = [], float(np.log(share / (1 - share)))

    def score(self, prefix: str) -> Column:
        """The rules as one column over the statistics, columns whose names begin with `prefix`."""
        names = [prefix + n for n in self.names]
        total = F.lit(self.base)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(names), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> Classifier:
    """Fit on at most `fit_rows` labelled rows that are not held out; a repeated label counts once, its smallest, and a repeated key by its text of the smallest statistics."""
    marked = one_per_id(labels.select(key, "quality"), key, "quality").where(F.col("quality").isin(0, 1) & ~held_out(key))
    few = marked.orderBy(F.xxhash64(F.col(key), F.lit(3)), key).limit(fit_rows)  # the bound that allows the broadcast
    texts = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("_t")).join(F.broadcast(few), key)
    # one row a key, however many texts it has: the bound holds for what the driver gets, too
    got = texts.select(key, "quality", statistics("_t").alias("s")).groupBy(key, "quality").agg(F.min("s").alias("s")).select(key, "quality", "s.*").toArrow()
    got = got.sort_by([(key, "ascending"), *((n, "ascending") for n in STATISTICS)])
    x = np.stack([got.column(n).to_numpy() for n in STATISTICS], axis=1) if got.num_rows else np.zeros((0, len(STATISTICS)))
    return Classifier(STATISTICS, x, got.column("quality").to_numpy().astype(np.float64) if got.num_rows else np.zeros(0))


def classify(docs: DataFrame, model: Classifier, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with `score` (0 to 1) and `predicted` (1 if the score reaches the threshold).

    Null texts are scored as empty ones, every row keeps its columns and gets a score, whatever the table holds. The
    statistics are computed once, beside the scan; columns of the table named like the results are replaced.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    own = "_stat"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    wide = docs.select(*rest, statistics(text).alias(own))
    # a generator of one row keeps the optimizer from copying the struct into each rule
    wide = wide.select(*rest, F.inline(F.array(own)).alias(*[f"{own}_{n}" for n in STATISTICS]))
    scored = wide.withColumn("score", model.score(f"{own}_")).select(*rest, "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
