"""P01-P04: the given tables read as streams, and the tables the streams leave behind."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import embed as EM
from ..operators import chunking as C
from ..operators import retrieval as R
from ..session import materialize, new_folder, table
from ..sources import files as S
from ..streaming import jobs as J
from . import bindings as B
from .bindings import EVENT_NOW
from .ingest_queries import health_xml
from .registry import CTES, RAW, cte, query
from .retrieval_queries import centroids, vectors
from .state_queries import capture_texts, routed


def as_stream(spark, df, label, batches=3):
    """Write a table in as many pieces as it has, and read the folder as a stream in about `batches` steps."""
    path = new_folder(spark, label)
    files = max(batches, df.rdd.getNumPartitions())
    df = df.repartition(files) if df.rdd.getNumPartitions() < batches else df
    df.write.option("compression", "zstd").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(path)


@query("P01_capture_stream", RAW["M05_route_captures"])
def p01(spark, sf):
    """Captures arrive in several batches; the rows left behind equal the batch routing."""
    arrivals = capture_texts(spark, sf).withColumn("path", F.concat(F.lit("inbox/"), "capture_id", F.lit(".txt")))
    out = new_folder(spark, "routed")
    held = new_folder(spark, "captures")
    J.capture_stream(as_stream(spark, arrivals, "arrivals"), lambda b: routed(spark, sf, b, held), out, new_folder(spark, "cp"))
    return spark.read.parquet(f"{out}/rows").drop("batch")


@query("P02_access_stream", RAW["A08_access_counts"])
def p02(spark, sf):
    out = new_folder(spark, "access")
    stream = J.access_buckets(as_stream(spark, B.audit_log(spark, sf), "audit"))
    J.run_available(stream.writeStream.outputMode("update").foreachBatch(J.upsert_buckets(out)), new_folder(spark, "cp"))
    return J.serve_access(spark.read.parquet(out), F.lit(EVENT_NOW).cast("date"))


@query(
    "P03_unlock_expiry",
    """
select event_id, case when exists (select 1 from grants g where g.actor = a.actor and g.granted_at <= a.happened_at and a.happened_at < g.expires_at) then 2 else 1 end as allowed
from audit_log a""",
)
def p03(spark, sf):
    out = new_folder(spark, "tiers")
    stream = J.with_effective_tier(as_stream(spark, B.audit_log(spark, sf), "audit"), B.grants(spark, sf)).select("event_id", "allowed")
    J.run_available(stream.writeStream.format("parquet").option("path", out), new_folder(spark, "cp"))
    return spark.read.parquet(out)


@query("P04_incremental_health", "select kind, at_us, source, value from health_samples")
def p04(spark, sf):
    """The export is delivered twice, each time in as many files as it has pieces."""
    path = new_folder(spark, "health")
    x = health_xml(spark, sf)
    x.write.text(path)
    x.write.mode("append").text(path)
    files = 2 * x.rdd.getNumPartitions()
    stream = spark.readStream.option("lineSep", "/>").option("maxFilesPerTrigger", -(-files // 3)).text(path)
    stream = stream.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    placed = lambda b: b.select("value", F.struct("file", "block", F.monotonically_increasing_id().alias("row")).alias("arrival"))
    state = new_folder(spark, "samples")
    sink = J.deliveries(lambda b: S.parse_health(S.health_tags(placed(b)))[0], state, ["kind", "happened_at", "source"], "happened_at", "arrival")
    J.run_available(stream.writeStream.foreachBatch(sink), new_folder(spark, "cp"))
    return spark.read.parquet(state).select("kind", F.unix_micros("happened_at").alias("at_us"), "source", "value")


@query("V03_pluggable_scorer", "select query_id, chunk_id, new_rank::integer as new_rank from (select *, row_number() over (partition by query_id order by rank > 20, case when rank <= 20 then (chunk_id * 37 % 101)::double end desc nulls last, rank) as new_rank from vector_top where rank <= 30)")
def v03(spark, sf):
    """A scorer of one's own over Arrow batches re-ranks the head of each list."""
    @F.pandas_udf("double")
    def scorer(ids: pd.Series) -> pd.Series:
        return (ids * 37 % 101).astype("float64")

    near = R.vector_arm(centroids(spark, sf), vectors(spark, sf), limit=30)
    return R.score_and_reorder(near, lambda c: scorer(c["chunk_id"])).select("query_id", "chunk_id", "new_rank")


@query(
    "V03_fail_open_scorer",
    """
select query_id, chunk_id, query_id % 3 = 1 as reranked, row_number() over (partition by query_id order by rank > 20, case when rank <= 20 and query_id % 3 = 1 then (chunk_id * 37 % 101)::double end desc nulls last, rank)::integer as new_rank
from vector_top where rank <= 30""",
)
def v03_fail_open(spark, sf):
    """The scorer fails on two queries of three, in two ways; these keep their order."""

    def scorer(rows):
        if rows["query_id"].iloc[0] % 3 == 0:
            raise ConnectionError("nobody answers")
        scores = (rows["chunk_id"] * 37 % 101).astype(float).tolist()
        return scores if rows["query_id"].iloc[0] % 3 == 1 else scores[:-1]

    near = materialize(R.vector_arm(centroids(spark, sf), vectors(spark, sf), limit=30), "near")
    scores = materialize(R.ask_scorer(near.filter(F.col("rank") <= R.HEAD), scorer), "scores")
    return R.reorder_head(near, scores).select("query_id", "chunk_id", "reranked", "new_rank")


@query("D07_embed_backlog_drained", """
select d.doc_id::varchar as chunk_id, case when d.doc_id in (select vec_id from embeddings) then 'old-model' else 'hash-768' end as embed_model
from documents d where (d.doc_id in (select vec_id from embeddings)) or (regexp_matches(lower(d.text), '[a-z0-9]{2}'))""")
def d07(spark, sf):
    return drained(spark, sf).select("chunk_id", "embed_model")


def drained(spark, sf):
    c = B.pages_state(spark, sf).select(F.col("id").cast("string").alias("chunk_id"), "text", "tier")
    e = table(spark, sf, "embeddings").join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    v = e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit("old-model").alias("embed_model"))
    return C.drain_embed_backlog(c, v, EM.hash_vectors, "hash-768")


# the statements of the offline embedding once more, over the texts of the backlog
cte("drain_input", "select doc_id::varchar as id, text from documents where doc_id not in (select vec_id from embeddings)")
for _old, _new, _from, _to in (
    ("lex_embed_tokens", "drain_tokens", "embed_input", "drain_input"), ("token_seeds", "drain_seeds", "lex_embed_tokens", "drain_tokens"), ("token_draws", "drain_draws", "token_seeds", "drain_seeds"),
):
    cte(_new, CTES[_old].replace(_from, _to))
cte("drain_weights", CTES["embed_weights"].replace("lex_embed_tokens", "drain_tokens").replace("token_draws", "drain_draws"))


@query(
    "D07_drained_vectors",
    """
select id as chunk_id, 'hash-768' as embed_model, count(*) as filled, round(sum((dim + 1) * weight::double) / sqrt(sum(weight::double ** 2)), 4) as checksum from drain_weights group by id
union all
select vec_id::varchar, 'old-model', len(list_filter(embedding, lambda x: x <> 0)), round(list_sum(list_transform(embedding, lambda x, i: i * x::double)), 4) from embeddings where vec_id in (select doc_id from documents)""",
)
def d07_vectors(spark, sf):
    """The vectors themselves: how many components are filled, and the sum of all by their place."""
    x = F.col("embedding")
    placed = F.aggregate(F.zip_with(x, F.sequence(F.lit(1), F.size(x)), lambda a, i: a * i), F.lit(0.0), lambda s, a: s + a)
    return drained(spark, sf).select("chunk_id", "embed_model", F.size(F.filter(x, lambda a: a != 0)).cast("bigint").alias("filled"), F.round(placed, 4).alias("checksum"))
