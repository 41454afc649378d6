"""Encoding and decoding of a table of texts, and the exact histogram of encoded lengths."""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .automaton import load
from .common import materialize

#: Lengths of one block of the suffix sums.
BLOCK = 4096


def _default(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each row's whole text by the automaton; a null text counts as empty."""
    path = path or _default("byte_bpe_50k.json")

    def run(batches):
        a = load(path)
        for b in batches:
            ids = [a.encode(t or "").astype("int32") for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(ids, pa.list_(pa.int32()))], ["k", "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text): the text that each row's ids spell; null ids give an empty text."""
    path = path or _default("byte_bpe_50k.json")

    def run(batches):
        a = load(path)
        for b in batches:
            texts = [b"".join(map(a.labels.__getitem__, i or [])).decode("utf-8", "replace") for i in b.column("i").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(texts, pa.string())], ["k", "text"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode in one pass, beside the scan: (key, n_tokens, ids_sha256, decoded_sha256).

    A row per row; null texts count as empty, repeated keys are repeated. Nothing is shuffled, and a worker holds one
    batch of texts, the automaton and two caches of bounded size.
    """
    path = path or _default("byte_bpe_50k.json")

    def run(batches):
        a = load(path)
        for b in batches:
            n, ids, back = [], [], []
            for t in b.column("t"):
                e = a.encode(t.as_py() or "")
                n.append(len(e))
                ids.append(hashlib.sha256(e.tobytes()).hexdigest())
                back.append(hashlib.sha256(a.decode(e).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("k", key)


_RANKS: dict = {}


def encoder(path: str):
    """The library's encoder for a file of ranks, built once in each worker."""
    if path not in _RANKS:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _RANKS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _RANKS[path]


def lengths(df: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """(length, and the columns `keep`): the number of tokens of each row's whole text; null counts as empty, control strings as text."""
    path = path or _default("byte_bpe_50k.tiktoken")
    keep = keep or []
    kinds = dict(df.dtypes)

    def run(batches):
        count = encoder(path).encode_ordinary
        for b in batches:
            n = pa.array([len(count(t.as_py() or "")) for t in b.column("_text")], pa.int64())
            yield pa.RecordBatch.from_arrays([n, *(b.column(c) for c in keep)], ["length", *keep])

    return df.select(F.col(text).alias("_text"), *keep).mapInArrow(run, "length long" + "".join(f", {c} {kinds[c]}" for c in keep))


def length_histogram(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """What every context limit does to a corpus, from one exact histogram of encoded lengths.

    One row per length L that occurs: n_docs and n_tokens of documents of this length; docs_over and tokens_over of
    longer documents (suffix sums); truncated_total, the tokens left when all documents are cut to L; tokens_lost by
    that cut; and share, the part of documents of at most L tokens, so that the q-quantile is the first L whose share
    reaches q. Every row counts; a null text has no tokens; an empty table gives no rows.

    Lengths are counted where the texts are read, and only (length, count) is shuffled. Suffix sums run in two
    levels, over blocks of lengths and inside each block, so that no task orders more than a block or the blocks.
    """
    hist = materialize(lengths(df, text, path).groupBy("length").agg(F.count("*").alias("n_docs")), "lengths")
    hist = hist.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(after), zero).alias(f"{c}_after") for c in ("d", "t")], *[F.sum(c).over(total).alias(f"{c}_all") for c in ("d", "t")])
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = hist.join(blocks, "block")
    out = out.withColumn("docs_over", F.coalesce(F.sum("n_docs").over(inside), zero) + F.col("d_after")).withColumn("tokens_over", F.coalesce(F.sum("n_tokens").over(inside), zero) + F.col("t_after"))
    lost = F.col("tokens_over") - F.col("length") * F.col("docs_over")
    return out.select("length", "n_docs", "n_tokens", "docs_over", "tokens_over", (F.col("t_all") - lost).alias("truncated_total"), lost.alias("tokens_lost"), ((F.col("d_all") - F.col("docs_over")) / F.col("d_all")).alias("share"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_over, truncated_total, tokens_lost) for any context limits, each of which need not occur as a length."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context long")
    over = F.when(F.col("length") > F.col("context"), F.col("n_docs")).otherwise(0)
    cut = F.col("n_docs") * F.least("length", "context")
    # the limits are a short list that the caller writes down
    each = histogram.select("length", "n_docs", "n_tokens", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context"))
    sums = each.groupBy("context").agg(F.sum(over).alias("docs_over"), F.sum(cut).alias("truncated_total"), F.sum(F.col("n_tokens") - cut).alias("tokens_lost"))
    return asked.join(sums, "context", "left").select("context", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("docs_over", "truncated_total", "tokens_lost")])
