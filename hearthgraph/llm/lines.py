"""Lines that several documents hold, dropped everywhere but in the first; in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: A shorter key never counts as repeated: blank lines, brackets, list marks.
MIN_CHARS = 10
#: White space that is stripped from both ends of a line: x20 and x09 to x0D.
_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_lines(text: Column) -> Column:
    """The lines of a text; an empty text is one empty line."""
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space around it and with A to Z in lower case; other letters stay as they are."""
    body = F.btrim(line, F.lit(_SPACE))
    ascii_only = F.octet_length(body) == F.char_length(body)
    return F.when(ascii_only, F.lower(body)).otherwise(F.translate(body, _UPPER, _UPPER.lower()))


def _identity(of: Column, *names: str) -> list[Column]:
    """128 bits of a string, as two numbers under the names given."""
    return [F.xxhash64(of).alias(names[0]), F.xxhash64(F.lit(1), of).alias(names[1])]


def repeated_keys(places: DataFrame, min_docs: int = 2) -> DataFrame:
    """(k1, k2, first): keys held by at least min_docs different documents, and the smallest id that holds each.

    Partial sums are made before the shuffle, so a key of very many documents sends a row from each task. For two
    documents, a smallest id that is not the largest says enough; for more, (key, document) pairs are made distinct.
    """
    keys = ["k1", "k2"]
    if min_docs <= 2:
        ends = places.groupBy(*keys).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        return ends.where("first < last" if min_docs == 2 else "true").drop("last")
    each = places.groupBy(*keys, "doc").agg(F.lit(1).alias("one"))
    return each.groupBy(*keys).agg(F.min("doc").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs).drop("n")


def drop_repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = 2) -> DataFrame:
    """(key, n_lines, n_dropped, kept): each text without the lines that stand in a document of smaller id already.

    A line counts by its key (line_key). Keys of at least min_chars code points that at least min_docs documents hold
    lose all lines except those of the smallest id, which keeps every one. The other lines stay as they are, in order.

    One row for each row. A null or empty text is one empty line. Rows of one id are one document when keys are
    counted and each is returned with its own lines; equal rows give equal rows. A row without id is no document: it
    keeps its lines and no line is dropped for its sake. An empty table gives no rows. Other columns are not read.

    Lines are exploded beside the scan as (document, position, 128 bits of the key) and written once; the counts have
    partial sums before their shuffle; lines meet the repeated keys in a join that Spark splits where a key is hot; only the
    places of dropped lines travel on, and the texts meet them once. A text is cut at its dropped places and what
    lies between is joined, in time linear in the text.
    """
    docs = df.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    row = ["doc", "t1", "t2"]
    lines = docs.where("doc is not null").select("doc", *_identity(F.col("t"), "t1", "t2"), F.posexplode(split_lines(F.col("t"))).alias("pos", "line"))
    named = lines.select(*row, "pos", line_key(F.col("line")).alias("k")).where(F.char_length("k") >= min_chars)
    places = materialize(named.select(*row, "pos", *_identity(F.col("k"), "k1", "k2")), "lines")
    # written, so that the join has a shuffle of its own, which Spark can split where a key is hot
    repeated = materialize(repeated_keys(places.select("doc", "k1", "k2"), min_docs), "repeated")
    gone = places.join(repeated, ["k1", "k2"]).where("doc <> first").groupBy(*row).agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    met = docs.select("doc", "t", *_identity(F.col("t"), "t1", "t2")).join(gone, row, "left")

    # one array that holds the lines and the cuts, so that both are made once for a text
    cuts = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size(split_lines(F.col("t")))))
    whole = F.array(F.struct(split_lines(F.col("t")).alias("l"), cuts.alias("c")))

    def between(s: Column) -> Column:
        left, right = lambda i: F.get(s["c"], i - 1), lambda i: F.get(s["c"], i)
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(s["c"]) - 1), lambda i: F.slice(s["l"], left(i) + 2, right(i) - left(i) - 1)))

    kept = F.get(F.transform(whole, lambda s: F.array_join(between(s), "\n")), F.lit(0))
    return met.select(
        F.col("doc").alias(key),
        F.size(split_lines(F.col("t"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("t")).otherwise(kept).alias("kept"),
    )
