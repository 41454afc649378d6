"""Hybrid retrieval for a table of queries over a table of chunks.

chunks: chunk_id, parent_type, parent_id, ord, text, tier. queries: query_id, query.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.embed import spoken
from ..functions.stem import stemmed, stemmed_texts
from ..model import visible
from ..session import fits, materialize, new_folder

# fixed values: candidates per arm, fusion constant, blend and bands of the score
ARM_LIMIT, RRF_K = 50, 60
BLEND_RANK, BLEND_COS = 0.7, 0.3
RECENCY_BAND, GRAPH_BAND, ACCESS_BAND, ACCESS_CAP = 0.05, 0.05, 0.05, 5
DERIVED_FACTOR, COMPILED_FACTOR = 0.85, 1.5
COMPILED_SOURCES = ["job:notes", "job:decision-digest"]
COMPILED_BY = "system:curate"
HEAD, CLIFF = 20, 0.35
SALTS = 16
# queries that one block of vectors is multiplied with at a time
TILE = 256
# different terms of all queries, as many as may travel to the texts; with more, terms meet by a join
VOCABULARY = 200_000


# ------------------------------------------------------------------ lexical arm


def term_table(chunks: DataFrame, stop: list[str] | None = None, stem: bool = False) -> DataFrame:
    """(chunk_id, term, tf, first_pos): the searchable index, one row per chunk and term or stem.

    Texts are dealt out by chunk id, once; their terms are counted where they arrive and stay there, since the
    terms of a text with their places are more than the text.
    """
    stop = X.ENGLISH_STOP if stop is None else stop
    said = X.terms(F.col("text"))
    if stem:
        said, chunks = F.split("said", " "), stemmed_texts(chunks.select("chunk_id", said.alias("said")), stop)
    # the outer form, since of the plain one Spark tells which lists are empty, finding the terms once more
    exploded = chunks.repartition("chunk_id").select("chunk_id", F.posexplode_outer(said).alias("pos", "term")).filter(F.col("term") != "")
    kept = exploded.filter(~F.col("term").isin(stop)) if stop and not stem else exploded
    return kept.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("first_pos"))


def query_terms(queries: DataFrame, stop: list[str] | None = None, stem: bool = False) -> DataFrame:
    """(query_id, term): distinct folded query tokens; function-character tokens and stop words drop out."""
    stop = X.ENGLISH_STOP if stop is None else stop
    t = queries.select("query_id", F.explode(F.array_distinct(X.terms(F.col("query")))).alias("term"))
    kept = t.filter(~X.is_han_stop(F.col("term")) & ~F.col("term").isin(stop))
    return stemmed(kept).distinct() if stem else kept


def salted_join(big: DataFrame, small: DataFrame, key: str, spread: str) -> DataFrame:
    """Equi-join where one key may own a third of `big`.

    `big` gets a salt from its own unique column and `small` one copy per salt, so no task sees a whole key. Where
    `small` is small, Catalyst's size check ships it instead.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "_salt"]).drop("_salt")


def top_per_query(df: DataFrame, score: str, limit: int, tie: str = "chunk_id") -> DataFrame:
    """Best `limit` rows per query; the rank limit is applied before the shuffle as well as after it."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def in_scope(pairs: DataFrame, scope: tuple[DataFrame, DataFrame], other: str = "parent_id") -> DataFrame:
    """Pairs (query_id, other) whose two sides share a scope.

    scope is (query_id, g) and (other, g): the key stays on both sides, so pairs are tested, never made.
    """
    asks, has = scope
    return pairs.join(asks.select("query_id", "g").distinct(), "query_id").join(has.select(other, "g").distinct(), [other, "g"]).drop("g")


def scoped(candidates: DataFrame, scope: tuple[DataFrame, DataFrame] | None, types: list[str] | None = None) -> DataFrame:
    """Keep candidates whose type is asked for and whose parent is in the query's own scope, if scopes are given."""
    out = candidates.filter(F.col("parent_type").isin(types)) if types else candidates
    return out if scope is None else in_scope(out, scope)


def _asked_in(chunks: DataFrame, words: list[str]) -> DataFrame:
    """(every column but text, terms, tfs): which of the words each chunk row has, by their place in the list, and how often; found beside the scan.

    A row of each chunk row, with empty lists where it has none of the words.
    """
    packed = chunks.sparkSession.sparkContext.broadcast(words)
    rest = [c for c in chunks.columns if c != "text"]

    def found(batches):
        vocabulary = pa.array(packed.value, pa.string())
        for batch in batches:
            said = batch.column("said")
            code = pc.fill_null(pc.index_in(said.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(said)), pc.list_value_length(said).to_numpy(zero_copy_only=False))
            key, tf = np.unique((row * len(vocabulary) + code)[code >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(len(said) + 1) * len(vocabulary)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((key % len(vocabulary)).astype(np.int32), tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *lists], names=[*rest, "terms", "tfs"])

    said = chunks.select(*rest, X.terms(F.coalesce("text", F.lit(""))).alias("said"))
    return said.mapInArrow(found, ", ".join(f"`{c}` {t}" for c, t in chunks.select(*rest).dtypes) + ", terms array<int>, tfs array<bigint>")


def _chunks_with(idx: DataFrame) -> DataFrame:
    """(term, df): in how many chunks each term stands; rows of one chunk id are one chunk.

    Rows are counted by term, and what the rows of repeated ids count too often is taken off again: only these rows are
    brought together, so that no list of terms is shuffled.
    """
    said = idx.select("chunk_id", F.explode(F.array_distinct("terms")).alias("term"))
    again = materialize(idx.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("chunk_id"), "repeated")
    over = said.join(again, "chunk_id", "left_semi").groupBy("term", "chunk_id").agg((F.count(F.lit(1)) - 1).alias("n")).groupBy("term").agg(F.sum("n").alias("over"))
    rows = said.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(over, "term", "left").select("term", (F.col("n") - F.coalesce("over", F.lit(0))).alias("df"))


def _block_matches(chunks: pd.DataFrame, asked: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Per query of a block the `limit` best chunks of a block, ties by id; chunks(chunk_id, terms, tfs), asked(ask, terms, gains).

    Without gains a matching position counts a tenth. A query sums the postings of its own terms, so nothing is made per pair.
    Rows of one chunk id are one chunk.
    """
    at, ids = pd.factorize(chunks["chunk_id"], sort=True)
    ids, n = np.asarray(ids), len(ids)
    words, vocabulary = pd.factorize(np.concatenate(asked["terms"].to_list()))
    code = pd.Index(vocabulary).get_indexer(np.concatenate(chunks["terms"].to_list()))
    row, tf = np.repeat(at, chunks["terms"].map(len)), np.concatenate(chunks["tfs"].to_list()).astype(float)
    key, place = np.unique((code.astype(np.int64) * n + row)[code >= 0], return_inverse=True)
    code, row, tf = key // n, key % n, np.bincount(place, weights=tf[code >= 0], minlength=len(key))
    start = np.searchsorted(code, np.arange(len(vocabulary) + 1))
    ends = np.cumsum(asked["terms"].map(len).to_numpy())
    who, what, many, how = [], [], [], []
    for ask, gains, end in zip(asked["ask"], asked["gains"], ends):
        mine = words[end - len(gains) : end]
        spans = [slice(start[w], start[w + 1]) for w in mine]
        where = np.concatenate([row[x] for x in spans])
        positions = np.bincount(where, weights=np.concatenate([tf[x] for x in spans]), minlength=n)
        if np.isnan(gains).any():
            score = np.round(positions * 0.1, 6)
        else:
            score = np.round(np.bincount(where, weights=np.repeat(gains, [x.stop - x.start for x in spans]), minlength=n), 6)
        found = np.flatnonzero(positions)
        if len(found) > limit:
            found = found[score[found] >= np.partition(score[found], len(found) - limit)[len(found) - limit]]
            found = found[np.argsort(-score[found], kind="stable")[:limit]]
        who.extend([ask] * len(found))
        what.append(ids[found])
        many.append(positions[found].astype(np.int64))
        how.append(score[found])
    return pd.DataFrame({"ask": pd.Series(who, dtype=object), "chunk_id": np.concatenate(what), "positions": np.concatenate(many), "lexical": np.concatenate(how)})


def _best_matches(asked: DataFrame, idx: DataFrame, chunk_groups: DataFrame, ask_groups: DataFrame | None, limit: int, block_rows: int, query_rows: int) -> DataFrame:
    """(query_id, chunk_id, positions, lexical): at least the `limit` best chunks of each query and group; one group, 0, if queries have none.

    A group's chunks are dealt over blocks of about `block_rows` and its queries over blocks of `query_rows`. Every pair of
    blocks is one task's group and leaves `limit` rows a query, so a (query, chunk) pair is never shuffled or written.
    idx(chunk_id, terms, tfs) may have several rows of a chunk id; they meet in their block.
    """
    kinds = dict(asked.dtypes)
    q = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "gain")).alias("t"))
    v = idx.withColumn("g", F.lit(0)) if ask_groups is None else idx.join(chunk_groups.distinct(), "chunk_id")
    q = q.withColumn("g", F.lit(0)) if ask_groups is None else q.join(ask_groups.distinct(), "query_id")
    # how many blocks there are follows the number of chunks, for which no text is cut into terms
    parts = lambda d, rows, name: d.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    sizes = materialize(parts(chunk_groups, block_rows, "nv").join(parts(q.select("g"), query_rows, "nq"), "g"), "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = ["g", "vb", "qb"]
    vs = v.join(sizes, "g").select("g", F.pmod(F.xxhash64("chunk_id"), F.col("nv")).cast("int").alias("vb"), every("nq").alias("qb"), "chunk_id", "terms", "tfs")
    qs = q.join(sizes, "g").select(
        "g", every("nv").alias("vb"), F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int").alias("qb"), F.col("query_id").cast("string").alias("ask"),
        F.col("t.term").alias("terms"), F.transform("t.gain", lambda x: F.coalesce(x, F.lit(float("nan")))).alias("gains"),
    )
    schema = f"ask string, chunk_id {dict(idx.dtypes)['chunk_id']}, positions bigint, lexical double"

    def meet(vp: pd.DataFrame, qp: pd.DataFrame) -> pd.DataFrame:
        if vp.empty or qp.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("ask", "chunk_id", "positions", "lexical")})
        return _block_matches(vp, qp, limit)

    near = vs.groupBy(*at).cogroup(qs.groupBy(*at)).applyInPandas(meet, schema)
    return near.select(F.col("ask").cast(kinds["query_id"]).alias("query_id"), "chunk_id", "positions", "lexical")


def lexical_arm(
    queries: DataFrame, chunks: DataFrame, *, allowed: int = 1, types=None, scope=None, limit: int = ARM_LIMIT,
    stop: list[str] | None = None, common: float | None = None, idf: bool = False, index: DataFrame | None = None, stem: bool = False,
    block_rows: int = 4_096, query_rows: int = 4_096, vocabulary: int = VOCABULARY,
) -> DataFrame:
    """(query_id, chunk_id, parent_type, parent_id, positions, lexical, rank): top chunks by matching positions.

    Any shared term makes a candidate; its rank value is a tenth of its number of matching positions.
    `common` drops terms that stand in more than this share of the chunks (a stop list for languages without one),
    `idf=True` weighs each matching term by its rarity; `stem=True` matches English stems (an `index` given must then
    hold stems). The index is cut to the terms somebody asks for before anything is counted or moved: up to `vocabulary`
    terms travel to the texts and a chunk leaves the scan as the numbers of those it has; more terms, stems and an
    `index` given meet by a join. Queries meet the chunks of their own scope only, and a block of chunks keeps `limit` rows a query.
    """
    seen = chunks.filter(visible(F.col("tier"), allowed) & F.col("chunk_id").isNotNull()).select("chunk_id", "parent_type", "parent_id", "text")
    asked = query_terms(queries, stop, stem)
    words = asked.select("term").distinct()
    local = words.limit(vocabulary + 1).toPandas()["term"].tolist() if index is None and not stem else []
    if 0 < len(local) <= vocabulary:
        counted = idf or common is not None
        idx = _asked_in(seen if counted else seen.select("chunk_id", "text"), local)
        if counted:
            # counted before it is matched: written, so that chunks are counted, matched and told their parents from it and no text is read again
            idx = materialize(idx, "asked_terms")
            seen = idx.drop("terms", "tfs")
        idx = idx.filter(F.size("terms") > 0).select("chunk_id", "terms", "tfs")
        coded = seen.sparkSession.createDataFrame(pd.DataFrame({"term": local, "code": np.arange(len(local), dtype=np.int32)}), "term string, code int")
        asked = asked.join(coded, "term").select("query_id", F.col("code").alias("term"))
    else:
        rows = index if index is not None else term_table(seen, stop, stem)
        rows = rows.select("chunk_id", "term", "tf").join(words, "term", "left_semi")
        idx = rows.groupBy("chunk_id").agg(F.collect_list(F.struct("term", "tf")).alias("t")).select("chunk_id", F.col("t.term").alias("terms"), F.col("t.tf").alias("tfs"))
    gain = F.lit(None).cast("double")
    if idf or common is not None:
        if "text" in seen.columns:
            # the same for terms that meet by a join
            idx = materialize(idx, "asked_terms")
        total = seen.agg(F.count(F.lit(1))).scalar()
        stats = _chunks_with(idx).withColumn("total", total)
        if common is not None:
            stats = stats.filter(F.col("df") <= common * F.col("total"))
        asked = asked.join(stats, "term")
        gain = F.log(F.col("total").cast("double") / F.col("df")) if idf else gain
    asked = asked.select("query_id", "term", gain.alias("gain"))
    kept = seen.filter(F.col("parent_type").isin(types)) if types else seen
    if types and scope is None:
        idx = idx.join(kept.select("chunk_id").distinct(), "chunk_id", "left_semi")
    chunk_groups, ask_groups = kept.select("chunk_id", F.lit(0).alias("g")), None
    if scope is not None:
        ask_groups, has = scope[0].select("query_id", "g"), scope[1].select("parent_id", "g")
        chunk_groups = kept.select("chunk_id", "parent_id").join(has.distinct(), "parent_id").select("chunk_id", "g")
    scores = _best_matches(asked, idx, chunk_groups, ask_groups, limit, block_rows, query_rows)
    if scope is not None:  # a chunk that a query finds in two of its scopes is told apart below
        scores = scores.distinct()
    elif not types:
        scores = top_per_query(scores, "lexical", limit).drop("rank")
    return top_per_query(scoped(scores.join(kept.drop("text"), "chunk_id"), scope, types), "lexical", limit)


# ------------------------------------------------------------------ vector arm


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


def _best(qids: np.ndarray, q: np.ndarray, ids: pd.Series, vecs: np.ndarray, limit: int, least: np.ndarray | None = None) -> pd.DataFrame:
    """Per query the `limit` best of one block, ties by id, on similarities rounded to 6 places; TILE queries at a time.

    `least` says for each query below which similarity nothing is wanted.
    """
    order = np.argsort(ids.to_numpy(), kind="stable")
    unit, ids = _unit(vecs)[order].T, ids.to_numpy()[order]
    k = min(limit, len(ids))
    who, what, how = [], [], []
    for lo in range(0, len(qids), TILE):
        sims = np.round(q[lo : lo + TILE] @ unit, 6)
        floor = np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k]
        if least is not None:
            floor = np.fmax(floor, least[lo : lo + TILE])
        row, col = np.nonzero(sims >= floor[:, None])  # a few more than k where scores are equal
        val = sims[row, col]
        at = np.lexsort((col, -val, row))
        row, col, val = row[at], col[at], val[at]
        first = np.searchsorted(row, np.arange(len(sims)))
        keep = np.arange(len(row)) - first[row] < k
        who.append(qids[lo + row[keep]])
        what.append(ids[col[keep]])
        how.append(val[keep])
    return pd.DataFrame({"query_id": np.concatenate(who), "chunk_id": np.concatenate(what), "cosine": np.concatenate(how)})


def _best_of_task(batches, qm: np.ndarray, limit: int) -> pd.DataFrame | None:
    """The `limit` best of all batches of a task for each row of `qm`; what is kept so far bars weaker rows of later batches."""
    kept, least, rows = None, np.full(len(qm), -np.inf), np.arange(len(qm))
    for pdf in batches:
        if pdf.empty:
            continue
        got = _best(rows, qm, pdf["chunk_id"], np.stack(pdf["embedding"].to_numpy()).astype(float), limit, least)
        if kept is not None:
            got = pd.concat([kept, got]).sort_values(["query_id", "cosine", "chunk_id"], ascending=[True, False, True]).groupby("query_id").head(limit)
        kept = got
        by = kept.groupby("query_id")["cosine"].agg(["size", "min"])
        full = by[by["size"] == limit]
        least[full.index.to_numpy()] = full["min"].to_numpy()
    return kept


def _near_some(local: pd.DataFrame, v: DataFrame, schema: str, limit: int, dense=None):
    """(near, broadcast): the best of each task for the queries of a frame of checked size, which travels to the scan."""
    packed = v.sparkSession.sparkContext.broadcast((local["query_id"].to_numpy(), _unit(np.stack(local["embedding"].to_numpy()).astype(float))))

    def scan(batches):
        qids, qm = packed.value
        best = _best_of_task(batches, qm, limit)
        if best is not None:
            yield best.assign(query_id=qids[best["query_id"].to_numpy()])

    def make_and_scan(batches):
        made = (pd.DataFrame({"chunk_id": b.column("chunk_id").to_pandas(), "embedding": list(dense(b))}) for b in spoken(batches))
        yield from (pa.RecordBatch.from_pandas(best, preserve_index=False) for best in scan(made))

    return v.mapInPandas(scan, schema) if dense is None else v.mapInArrow(make_and_scan, schema), packed


def vector_arm(queries: DataFrame, vectors: DataFrame, *, limit: int = ARM_LIMIT, small_rows: int = 4096, dense: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> DataFrame:
    """(query_id, chunk_id, cosine, rank): the exact nearest chunks of each query.

    queries(query_id, embedding) x vectors(chunk_id, embedding). A query table of checked size travels to
    the scan, which multiplies block by block and keeps the best `limit` per query and task. A larger one is written in
    waves of about `small_rows` queries, and each wave is such a scan whose result is written: a vector is never
    shuffled or copied, it is read once for `small_rows` queries, and neither the driver nor a task holds more than one wave.
    Only `limit` rows per query and task are shuffled to the final cut. With `dense`, which makes the vectors of a batch
    of seeds (see functions.embed), vectors has a column `seeds` and each vector is made where it is multiplied.
    """
    spark = vectors.sparkSession
    schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(vectors.dtypes)['chunk_id']}, cosine double"
    v = vectors.select("chunk_id", "embedding").filter(F.col("embedding").isNotNull()) if dense is None else vectors.select("chunk_id", "seeds")
    q = queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull())
    if fits(q, small_rows):
        local = q.toPandas()
        if local.empty:
            return spark.createDataFrame([], f"{schema}, rank int")
        return top_per_query(_near_some(local, v, schema, limit, dense)[0], "cosine", limit)
    waves = -(-q.count() // small_rows)
    asked, out = new_folder(spark, "waves"), new_folder(spark, "near")
    q = q.withColumn("wave", F.pmod(F.xxhash64("query_id"), F.lit(waves)).cast("int"))
    q.repartition("wave").write.partitionBy("wave").parquet(asked)
    q = spark.read.schema(q.schema).parquet(asked)
    for wave in range(waves):
        local = q.filter(F.col("wave") == wave).drop("wave").toPandas()
        if not local.empty:
            near, packed = _near_some(local, v, schema, limit, dense)
            top_per_query(near, "cosine", limit).write.parquet(f"{out}/wave={wave}")
            packed.destroy()
    return spark.read.schema(f"{schema}, rank int").parquet(f"{out}/wave=*")


# ------------------------------------------------------------------ fusion and ranking


def fuse(vec: DataFrame, lex: DataFrame, queries: DataFrame) -> DataFrame:
    """Union of the arms by chunk with summed reciprocal ranks, scaled to 1 for the query's best.

    Arms carry (query_id, chunk_id, cosine|lexical, rank); queries carry lexical_weight.
    """
    v = vec.select("query_id", "chunk_id", "cosine", F.col("rank").alias("vrank"))
    x = lex.select("query_id", "chunk_id", "lexical", F.col("rank").alias("lrank"))
    both = v.join(x, ["query_id", "chunk_id"], "full").join(queries.select("query_id", "lexical_weight"), "query_id")
    rrf = F.coalesce(F.lit(1.0) / (RRF_K + F.col("vrank")), F.lit(0.0)) + F.coalesce(
        F.col("lexical_weight") / (RRF_K + F.col("lrank")), F.lit(0.0)
    )
    top = F.max("rrf").over(Window.partitionBy("query_id"))
    return (
        both.withColumn("rrf", rrf)
        .withColumn("rrf_norm", F.when(top > 0, F.col("rrf") / top).otherwise(F.lit(0.0)))
        .select("query_id", "chunk_id", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), F.coalesce("lexical", F.lit(0.0)).alias("lexical"), "rrf_norm")
    )


def adjust(include_derived: bool = False) -> Column:
    """Blend times recency, graph, access and title factors, then the compiled or derived factor.

    Reads rrf_norm, cosine, age_days, recency_scale, near, drills, boost, source, created_by, derived.
    """
    base = BLEND_RANK * F.col("rrf_norm") + BLEND_COS * F.col("cosine")
    recency = 1 + RECENCY_BAND * F.col("recency_scale") * F.exp(-F.greatest(F.col("age_days"), F.lit(0)) / F.lit(180.0))
    graph = F.when(F.col("near"), 1 + GRAPH_BAND).otherwise(1.0)
    access = 1 + ACCESS_BAND * F.least(F.col("drills"), F.lit(ACCESS_CAP)) / ACCESS_CAP
    compiled = F.col("source").isin(COMPILED_SOURCES) & (F.col("created_by") == COMPILED_BY)
    derived = F.col("derived") & F.lit(not include_derived)
    kind = F.when(compiled, COMPILED_FACTOR).when(derived, DERIVED_FACTOR).otherwise(1.0)
    return F.round(base * recency * graph * access * F.col("boost") * kind, 9)


def best_per_parent(scored: DataFrame) -> DataFrame:
    """The best chunk of each parent; every other column of that chunk comes along."""
    rest = [c for c in scored.columns if c not in ("query_id", "parent_type", "parent_id")]
    first = F.min_by(F.struct(*rest), F.struct(-F.col("score"), F.col("chunk_id")))
    return scored.groupBy("query_id", "parent_type", "parent_id").agg(first.alias("r")).select(
        "query_id", "parent_type", "parent_id", "r.*"
    )


def reorder_head(ranked: DataFrame, scores: DataFrame, head: int = HEAD) -> DataFrame:
    """Re-rank the first `head` hits by an outside score; the tail keeps its order.

    ranked(query_id, chunk_id, rank), scores(query_id, chunk_id, rerank). A query keeps its order when a
    score is missing, not finite or given twice, and when it has fewer than two hits.
    """
    s = scores.groupBy("query_id", "chunk_id").agg(F.max("rerank").alias("rerank"), F.count(F.lit(1)).alias("_times"))
    h = ranked.join(s, ["query_id", "chunk_id"], "left")
    in_head = F.col("rank") <= head
    good = F.col("rerank").isNotNull() & ~F.isnan("rerank") & (F.abs("rerank") < float("inf")) & (F.col("_times") == 1)
    q = Window.partitionBy("query_id")
    valid = (F.count(F.when(in_head & good, 1)).over(q) == F.count(F.when(in_head, 1)).over(q)) & (F.count(F.lit(1)).over(q) > 1)
    h = h.withColumn("reranked", valid).withColumn("rerank", F.when(F.col("reranked") & in_head, F.col("rerank")))
    w = q.orderBy((F.col("rank") > head), F.desc_nulls_last("rerank"), "rank")
    return h.withColumn("new_rank", F.row_number().over(w)).drop("_times")


def wording(query: Column, text: Column) -> Column:
    """How much of the query's wording a text has: the share of its different words, and of its words side by side, that are there too."""

    def said(c: Column) -> Column:
        side = lambda t: F.filter(F.zip_with(t, F.slice(t, F.lit(2), F.size(t)), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
        return F.array_distinct(F.get(F.transform(F.array(X.terms(c)), lambda t: F.concat(t, side(t))), F.lit(0)))

    asked = said(query)
    return F.when(F.size(asked) > 0, F.round(F.size(F.array_intersect(asked, said(text))) / F.size(asked), 6)).otherwise(F.lit(0.0))


def score_and_reorder(ranked: DataFrame, scorer, head: int = HEAD) -> DataFrame:
    """Re-rank with a scorer of one's own: a function of the head rows giving a score column.

    A batch the scorer cannot do should give nulls; the queries of that batch then keep their order.
    """
    first = ranked.filter(F.col("rank") <= head)
    return reorder_head(ranked, first.withColumn("rerank", scorer(first)).select("query_id", "chunk_id", "rerank"), head)


def ask_scorer(rows: DataFrame, scorer, seconds: float = 30.0) -> DataFrame:
    """(query_id, chunk_id, rerank, reason): what an outside scorer says of each query's rows, or why it counts for nothing.

    scorer(rows of one query, in order of rank) gives a score for each row, or (place, score) pairs. If it raises, takes
    longer than `seconds`, answers for too few or too many rows, names a place twice or one that is not there, or gives
    a score that is null or not finite, all scores of this query are null and `reason` says so; no other query is
    touched and the job goes on. Rows are those of a cut list (the head of a ranking), so a query is one small group.
    """
    kinds = dict(rows.dtypes)
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, rerank double, reason string"

    def judged(pdf: pd.DataFrame) -> tuple[list[float | None], str | None]:
        n = len(pdf)
        pool = ThreadPoolExecutor(1)
        try:
            said = list(pool.submit(scorer, pdf).result(timeout=seconds))
        except TimeoutError:
            return [None] * n, "too late"
        except Exception as e:  # noqa: BLE001  whatever an outside scorer raises, the order stays
            return [None] * n, f"raised {type(e).__name__}"
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        if len(said) != n:
            return [None] * n, f"{len(said)} scores for {n} rows"
        try:
            if said and isinstance(said[0], tuple | list):
                places = [int(i) for i, _ in said]
                if sorted(places) != list(range(n)):
                    return [None] * n, "a place twice or out of range"
                said = [x for _, x in sorted(zip(places, (x for _, x in said)))]
            scores = [float(x) for x in said]
        except (TypeError, ValueError):
            return [None] * n, "not a number"
        return (scores, None) if all(map(math.isfinite, scores)) else ([None] * n, "not finite")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "chunk_id"])
        scores, reason = judged(pdf)
        return pd.DataFrame({"query_id": pdf["query_id"], "chunk_id": pdf["chunk_id"], "rerank": pd.Series(scores, index=pdf.index, dtype="float64"), "reason": pd.Series([reason] * len(pdf), index=pdf.index, dtype="object")})

    return rows.groupBy("query_id").applyInPandas(run, schema)


def cliff_cut(ranked: DataFrame, score: str = "rerank", order: str = "new_rank", min_gap: float = CLIFF) -> DataFrame:
    """Drop everything after the widest score gap worth `min_gap` of the range; first widest gap wins.

    Without such a gap, or with fewer than two finite scores, everything stays.
    """
    q = Window.partitionBy("query_id")
    fin = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    s = F.when(fin, F.col(score))
    w = q.orderBy(F.col("_s").isNull(), order)
    d = ranked.withColumn("_s", s).withColumn("_next", F.lead("_s").over(w)).withColumn("_pos", F.row_number().over(w))
    span = F.first("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.last(
        "_s", ignorenulls=True
    ).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gap = F.when(span > 0, F.round((F.col("_s") - F.col("_next")) / span, 9))
    d = d.withColumn("_gap", gap)
    best = F.min(F.when(F.col("_gap") >= min_gap, F.struct((-F.col("_gap")).alias("g"), F.col("_pos").alias("p")))).over(q)
    d = d.withColumn("_cut", best["p"])
    return d.filter(F.col("_cut").isNull() | (F.col("_pos") <= F.col("_cut"))).drop("_s", "_next", "_pos", "_gap", "_cut")


def hybrid_search(
    queries: DataFrame, chunks: DataFrame, meta: DataFrame, now: Column, *, query_vectors: DataFrame | None = None,
    chunk_vectors: DataFrame | None = None, near: DataFrame | Callable[[DataFrame], DataFrame] | None = None, access: DataFrame | None = None, allowed: int = 1,
    types: list[str] | None = None, scope: tuple[DataFrame, DataFrame] | None = None, include_derived: bool = False, limit: int = 10,
    rerank=None, head: int = HEAD, autocut: bool = False, stop: list[str] | None = None, common: float | None = None,
    idf: bool = False, index: DataFrame | None = None, stem: bool = False, dense: Callable[[pa.RecordBatch], np.ndarray] | None = None,
) -> DataFrame:
    """The whole pipeline: intent, both arms, fusion, metadata, adjustment, best chunk, rerank, cut, snippet.

    meta: id, title, tier, updated_on, created_by, source, derived. near: (query_id, parent_id) pairs one
    hop from a named entity, or a function that keeps those of the candidates' pairs. access: (parent_id, drills). Without vectors the lexical arm stands alone. dense: see vector_arm, for a search without types and scope.
    rerank orders the first `head` hits anew: scores (query_id, chunk_id, rerank), a column over `query` and `text` (see
    wording), or an outside scorer that is asked for each query's head (see ask_scorer).
    """
    name = X.intent(F.col("query"))
    q = queries.select("query_id", "query", *[c.alias(n) for n, c in X.intent_scales(name).items()])
    seen = chunks.filter(visible(F.col("tier"), allowed))
    lex = lexical_arm(q, chunks, allowed=allowed, types=types, scope=scope, stop=stop, common=common, idf=idf, index=index, stem=stem)
    if query_vectors is not None and chunk_vectors is not None:
        # a vector table that carries tier and parent is filtered where it is read
        if {"parent_type", "parent_id", "tier"} <= set(chunk_vectors.columns):
            cv = chunk_vectors.filter(visible(F.col("tier"), allowed))
        else:
            cv = chunk_vectors.join(seen.select("chunk_id", "parent_type", "parent_id"), "chunk_id")
        if scope is None and not types:
            vec = vector_arm(query_vectors, cv, dense=dense)
        else:
            vec = scoped_vector_arm(query_vectors, cv, scope, types)
    else:
        vec = lex.select("query_id", "chunk_id").limit(0).withColumn("cosine", F.lit(0.0)).withColumn("rank", F.lit(1))
    # a candidate list holds at most 100 chunks per query: everything from here on is small, and it is written so that it is found once
    cand = materialize(fuse(vec, lex, q).join(seen.select("chunk_id", "parent_type", "parent_id"), "chunk_id"), "candidates")
    m = meta.filter(visible(F.col("tier"), allowed)).select(
        F.col("id").alias("parent_id"), F.substring("title", 1, 120).alias("title"), "updated_on", "created_by", "source", "derived"
    )
    d = cand.join(m, "parent_id").join(q, "query_id")
    if near is not None:
        near = near(cand.select("query_id", "parent_id")) if callable(near) else near
        d = d.join(near.select("query_id", "parent_id").distinct().withColumn("near", F.lit(True)), ["query_id", "parent_id"], "left")
        d = d.withColumn("near", F.coalesce("near", F.lit(False)))
    else:
        d = d.withColumn("near", F.lit(False))
    if access is not None:
        d = d.join(access.select("parent_id", "drills"), "parent_id", "left").withColumn("drills", F.coalesce("drills", F.lit(0).cast("bigint")))
    else:
        d = d.withColumn("drills", F.lit(0).cast("bigint"))
    d = d.withColumn("age_days", F.datediff(now, "updated_on")).withColumn("boost", X.title_boost(F.col("query"), F.col("title"), F.col("title_scale")))
    scored = d.withColumn("score", adjust(include_derived)).select(
        "query_id", "query", "chunk_id", "parent_type", "parent_id", "score", "title", "updated_on", "created_by", "derived"
    )
    best = best_per_parent(scored)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = best.withColumn("rank", F.row_number().over(w))
    if rerank is not None:
        if not isinstance(rerank, DataFrame):
            # only the head is read with its texts; it is written so that an outside scorer is asked once
            first = materialize(ranked.filter(F.col("rank") <= head), "ranked").join(seen.select("chunk_id", "text"), "chunk_id").select("query_id", "query", "chunk_id", "rank", "text")
            rerank = first.select("query_id", "chunk_id", rerank.alias("rerank")) if isinstance(rerank, Column) else materialize(ask_scorer(materialize(first, "head"), rerank), "scores")
        ranked = reorder_head(ranked, rerank, head)
        if autocut:
            ranked = cliff_cut(ranked)
        ranked = ranked.withColumn("rank", F.col("new_rank")).drop("new_rank", "rerank", "reranked")
    # the text joins what is left, for the snippet only; that is written, so that its size is known and the texts need not move
    shown = materialize(ranked.filter(F.col("rank") <= limit), "shown").join(seen.select("chunk_id", "text"), "chunk_id")
    return shown.select(
        "query_id", "rank", F.col("parent_type").alias("type"), F.col("parent_id").alias("id"), "chunk_id", "title",
        X.snippet(F.col("text"), F.col("query")).alias("snippet"), F.round("score", 4).alias("score"), "updated_on", "derived", "created_by",
    )


def scoped_vector_arm(
    query_vectors: DataFrame, vectors: DataFrame, scope: tuple[DataFrame, DataFrame] | None, types=None, limit: int = ARM_LIMIT, *, block_rows: int = 8_192, query_rows: int = 1_024,
) -> DataFrame:
    """Nearest chunks inside each query's own haystack: queries meet the vectors of their scope and no others.

    scope is asks(query_id, g) and has(parent_id, g); a query may ask several haystacks, a parent may be in several.
    A haystack's vectors are dealt over blocks of about `block_rows` and its queries over blocks of `query_rows`, so
    that a haystack of any size becomes many groups of bounded size; each is one matrix product that keeps `limit` rows a
    query. A chunk found in two haystacks of a query counts once.
    """
    v = vectors.filter(F.col("parent_type").isin(types)) if types else vectors
    if scope is None:
        return vector_arm(query_vectors, v, limit=limit)
    asks, has = scope
    schema = f"query_id {dict(query_vectors.dtypes)['query_id']}, chunk_id {dict(vectors.dtypes)['chunk_id']}, cosine double"
    v = v.filter(F.col("embedding").isNotNull()).join(has.select("parent_id", "g").distinct(), "parent_id").select("g", "chunk_id", "embedding")
    q = query_vectors.filter(F.col("embedding").isNotNull()).join(asks.select("query_id", "g").distinct(), "query_id").select("g", "query_id", "embedding")
    parts = lambda d, rows, name: d.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    sizes = materialize(parts(v, block_rows, "nv").join(parts(q, query_rows, "nq"), "g"), "haystacks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    vs = v.join(sizes, "g").select("g", F.pmod(F.xxhash64("chunk_id"), F.col("nv")).cast("int").alias("vb"), every("nq").alias("qb"), "chunk_id", "embedding")
    qs = q.join(sizes, "g").select("g", every("nv").alias("vb"), F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int").alias("qb"), "query_id", "embedding")

    def meet(vp: pd.DataFrame, qp: pd.DataFrame) -> pd.DataFrame:
        if vp.empty or qp.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "cosine": []})
        qm = _unit(np.stack(qp["embedding"].to_numpy()).astype(float))
        return _best(qp["query_id"].to_numpy(), qm, vp["chunk_id"], np.stack(vp["embedding"].to_numpy()).astype(float), limit)

    at = ["g", "vb", "qb"]
    near = vs.groupBy(*at).cogroup(qs.groupBy(*at)).applyInPandas(meet, schema)
    once = near.groupBy("query_id", "chunk_id").agg(F.max("cosine").alias("cosine"))
    return top_per_query(once, "cosine", limit)
