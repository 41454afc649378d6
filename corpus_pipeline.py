"""A corpus pipeline of four stages; each reads what the one before it wrote, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthgraph.llm import joins, packing, phrases, quality
from hearthgraph.llm.common import materialize, prepare, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; the classifier is fitted on labelled rows of the incoming documents."""
    prepare(spark)
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.classify(docs, model).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that with the smallest id; repeated equal rows count as one."""
    prepare(spark)
    groups = joins.similar_groups(docs)
    # rows without id have no group: they stay
    keep = groups.where("doc_id = class_id").select("doc_id").distinct()
    named = docs.join(keep, "doc_id", "left_semi").withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"])
    return named.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand earlier; a document that loses nothing keeps its text as it is."""
    prepare(spark)
    kept = phrases.remove_repeats(docs, carry=["lang", "source", "n_chars"])
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the packed sequences."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", packed),
]

#: The stages have no SQL form (a fitted classifier, best-fit packing); tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each result is written to the shared folder and read as the next one's input."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
