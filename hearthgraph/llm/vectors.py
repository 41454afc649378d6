"""Embedding near-duplicates by spherical k-means cells, and exact top-k search by a pivot-distance index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, finite, materialize, one_per_id, pieces

#: Rows of one block of a cell or ring; a larger cell is dealt out over several blocks.
BLOCK_ROWS = 1024
#: Vectors at most that centres and pivots are fitted on (the index itself covers every row).
FIT_ROWS = 20_000
#: Most centres; beyond it cells grow and are cut into more blocks.
MOST_CELLS = 1024
PIVOTS = 32
MOST_RINGS = 64


def _matrix(col: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column as a matrix of doubles; shorter vectors are filled with zeros up to `dim`."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lens = np.diff(col.offsets.to_numpy())
    dim = dim or int(lens.max(initial=0))
    if (lens == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lens), dim))
    out[np.arange(dim)[None, :] < lens[:, None]] = flat
    return out


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by their largest component, so that no square overflows, and their norms."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, np.sqrt((x * x).sum(axis=1))


def _fit(df: DataFrame, vec: str, key: str, dim: int) -> np.ndarray:
    """At most FIT_ROWS vectors, picked by a hash of their id."""
    got = df.orderBy(F.xxhash64(F.col(key), F.lit(17)), key).limit(FIT_ROWS).select(vec).toArrow()
    return _matrix(got.column(0).combine_chunks(), dim) if got.num_rows else np.zeros((0, dim))


def spherical_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of unit rows by cosine; an empty cell takes the row that fits its own centre worst."""
    k = max(1, min(k, len(x)))
    c = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        s = x @ c.T
        home, fit = s.argmax(axis=1), s.max(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        empty = np.flatnonzero(np.bincount(home, minlength=k) == 0)
        total[empty] = x[np.argsort(fit)[: len(empty)]]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return c


def near_vectors(df: DataFrame, key: str = "vec_id", vec: str = "embedding", group: str = "label", threshold: float = 0.93, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links of at least `threshold` cosine between vectors of one group, and their components.

    Returns (key, n_links, component_id, kept): a row per key that is not null. A repeated key keeps its smallest
    row. Null, empty or zero vectors, vectors with components that are null or not finite, and rows without a group
    link with nothing and are kept. Vectors of different length never link. An empty table gives no rows.

    Method: equal vectors are collapsed and weighted. Centres of a spherical k-means, as many as the group needs,
    assign each vector to a home cell. Two vectors at the threshold lie at most sqrt(2 - 2 * threshold) apart, so a vector also visits every cell
    whose dividing plane is that near: no pair is lost at a border. Cells are cut into blocks of bounded size;
    a block holds its home rows and streams its visitors past them, one cosine product per batch. Each block counts
    the links of its own home rows and passes on a spanning forest, so no pair leaves a task.
    """
    # float to double is exact, and the labels are compared as they are
    base = one_per_id(df.select(key, F.col(group).alias("grp"), F.col(vec).cast("array<double>").alias("v")), key, "grp", "v")
    valid = base.where(finite(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("grp").isNotNull())
    named = valid.select(key, "grp", "v", F.xxhash64("v").alias("h"))
    reps = materialize(named.groupBy("grp", "h", "v").agg(F.min(key).alias("rep"), F.count("*").alias("w")), "vectors")
    n, dim = reps.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = dim or 1
    near = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    fit = _fit(reps, "v", "rep", dim)
    unit = fit / np.abs(fit).max(axis=1, keepdims=True) if len(fit) else fit
    unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True)) if len(fit) else unit
    levels = range(math.ceil(math.log2(max(1, min(MOST_CELLS, math.ceil(n / block_rows))))) + 1)
    centres = [spherical_means(unit, 2**i) if len(unit) else np.zeros((1, dim)) for i in levels]
    widths = [np.sqrt(np.maximum((c * c).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * c @ c.T, 1e-300)) for c in centres]

    def assign(batches):
        for b in batches:
            if not b.num_rows:
                continue
            u, norm = _scaled(_matrix(b.column("v"), dim))
            u /= norm[:, None]
            at = b.column("level").to_numpy()
            for i in np.unique(at):
                mine = np.flatnonzero(at == i)
                s = u[mine] @ centres[i].T
                home = s.argmax(axis=1)
                row, cell = np.nonzero(s[np.arange(len(s)), home][:, None] - s <= near * widths[i][home])
                out = b.take(pa.array(mine[row]))
                yield pa.RecordBatch.from_arrays([out.column(c) for c in ("grp", "rep", "w", "v")] + [pa.array(cell.astype(np.int32)), pa.array(home[row] == cell)], ["grp", "rep", "w", "v", "cell", "home"])

    # a group has about one cell for each block of rows: the centres of the next power of two
    many = F.ceil(F.log2(F.ceil(F.count("*") / block_rows))).cast("int")
    sized = reps.join(reps.groupBy("grp").agg(F.least(many, F.lit(len(centres) - 1)).alias("level")), "grp")
    kind = dict(reps.dtypes)["grp"]
    visits = sized.select("grp", "rep", "w", "v", "level").mapInArrow(assign, f"grp {kind}, rep long, w long, v array<double>, cell int, home boolean")
    visits = materialize(visits.withColumn("dim", F.size("v")), "visits")
    cells = visits.where("home").groupBy("grp", "dim", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("nb"))
    at = visits.join(cells, ["grp", "dim", "cell"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    # a home row stands in its own block once as the row that is counted, and visits every block of the cell
    rows = at.where("home").select("grp", "dim", "cell", F.col("own").alias("block"), F.lit(0).alias("kind"), "rep", "w", "v").unionByName(
        at.select("grp", "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"), F.lit(1).alias("kind"), "rep", "w", "v")
    )
    rows = rows.repartition("grp", "dim", "cell", "block").sortWithinPartitions("grp", "dim", "cell", "block", "kind", "rep")

    def products(batches):
        ids = mark = links = None

        def told(a, n, b):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.int64())], ["a", "n", "b"])

        def close():
            if ids is not None and len(ids):
                yield told(ids, links, [None] * len(ids))
                yield told(ids, [0] * len(ids), ids[mark])

        for new, b in pieces(batches, ["grp", "dim", "cell", "block"]):
            if new:
                yield from close()
                ids, parts = None, []
            first = int((b.column("kind").to_numpy() == 0).sum())
            if first:
                parts.append(b.slice(0, first))
                ids = np.concatenate([p.column("rep").to_numpy() for p in parts])
                home, home_norm = _scaled(np.vstack([_matrix(p.column("v")) for p in parts]))
                links, mark = np.zeros(len(ids), np.int64), np.arange(len(ids))
            rest = b.slice(first)
            if not rest.num_rows or ids is None:
                continue
            who, weight = rest.column("rep").to_numpy(), rest.column("w").to_numpy()
            u, norm = _scaled(_matrix(rest.column("v")))
            linked = (u @ home.T) / (norm[:, None] * home_norm[None, :]) >= threshold
            linked &= who[:, None] != ids[None, :]
            links += weight @ linked
            tied = np.flatnonzero(linked.any(axis=1))
            for i in tied:  # home rows that one visitor links belong together
                groups = np.unique(mark[linked[i]])
                if len(groups) > 1:
                    mark[np.isin(mark, groups)] = groups[0]
            if len(tied):
                yield told(who[tied], [0] * len(tied), ids[linked[tied].argmax(axis=1)])
        yield from close()

    told = materialize(rows.mapInArrow(products, "a long, n long, b long"), "links")
    links = told.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(told.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    classes = reps.join(links, "rep", "left").join(roots, "rep", "left")
    classes = classes.select("grp", "h", "v", F.col("rep"), "w", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "rep").alias("root"))
    member = named.join(classes, ["grp", "h", "v"]).select(key, (F.col("n") + F.col("w") - 1).alias("n_links"), F.col("root").alias("component_id"))
    alone = base.select(key).join(member, key, "left")
    return alone.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", key).alias("component_id")).withColumn("kept", F.col(key) == F.col("component_id"))


def top_scores(df: DataFrame, key: str = "vec_id", vec: str = "embedding", k: int = 20, every: int = 20, scale: int = 64, block_rows: int = 2 * BLOCK_ROWS) -> DataFrame:
    """Each query's `k` highest integer inner products: (query_id, rank, vec_id, score), ties to the smaller id.

    Components become floor(scale * x). Queries are the rows whose id is divisible by `every`, candidates all other
    rows. Rows without id, and vectors that are null, empty, or hold null or non-finite components take no part. A
    repeated id keeps its smallest vector; missing components of a shorter vector count as zero. Neither does a vector
    of which floor(scale * x) does not fit a long; the scores of all others must. An empty table gives no rows.

    Method: with one more component, sqrt(M - |x|^2) for a row and 0 for a query, the highest products are the
    shortest distances. Every row is keyed by its nearest pivot and its distance to it, and rows of one pivot are
    kept in rings (annuli) of that distance. A query first searches the ring nearest to it, which gives a k-th score;
    it then expands to the rings that the triangle inequality cannot rule out against that score, and stops there.
    Equal vectors are stored once with their k + 1 smallest ids, since no more of them can be in an answer.
    """
    more = k + 1
    ints = F.transform("v", lambda x: F.when(F.abs(F.lit(float(scale)) * x) < 2.0**62, F.floor(F.lit(float(scale)) * x).cast("long")))
    base = one_per_id(df.select(key, F.col(vec).cast("array<double>").alias("v")), key, "v").where(finite(F.col("v"))).select(F.col(key).alias("id"), ints.alias("v")).where(F.forall("v", lambda x: x.isNotNull()))
    base = materialize(base.withColumn("h", F.xxhash64("v")).withColumn("asks", F.col("id") % every == 0), "ints")
    few = base.withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("r") <= more)
    ids = few.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = base.groupBy("h", "v").agg(F.min("id").alias("rep"), F.max("asks").alias("asks"))
    # squares of the norms decide the added component; as doubles, since those of long vectors may pass a long
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    reps = materialize(asked.join(ids, ["h", "v"]).select("rep", "asks", "ids", "v", norm2.alias("q2")), "classes")
    n, top2, dim = reps.agg(F.count("*"), F.max("q2"), F.max(F.size("v"))).first()
    n, top2, dim = n or 0, float(top2 or 0), dim or 1

    fit = _fit(reps, "v", "rep", dim)

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(top2 - (x * x).sum(axis=1), 0))[:, None]])

    def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0))

    up = lifted(fit)
    pivots = up[:1] if len(up) else np.zeros((1, dim + 1))
    while len(pivots) < min(PIVOTS, len(up)):  # farthest first
        pivots = np.vstack([pivots, up[apart(up, pivots).min(axis=1).argmax()][None]])
    rings = max(1, min(MOST_RINGS, math.ceil(n / (len(pivots) * block_rows))))
    d = apart(up, pivots) if len(up) else np.zeros((0, len(pivots)))
    nearest = d.argmin(axis=1) if len(up) else np.zeros(0, int)
    edges = [np.quantile(d[nearest == p, p], np.linspace(0, 1, rings + 1)[1:-1]) if (nearest == p).any() else np.zeros(rings - 1) for p in range(len(pivots))]

    def place(batches):
        for b in batches:
            if b.num_rows:
                far = apart(lifted(_matrix(b.column("v"), dim)), pivots)
                p = far.argmin(axis=1)
                dist = far[np.arange(len(p)), p]
                ring = [int(np.searchsorted(edges[i], x)) for i, x in zip(p, dist)]
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("ids"), b.column("v"), pa.array(p.astype(np.int32)), pa.array(ring, pa.int32()), pa.array(dist)], ["rep", "ids", "v", "pivot", "ring", "dist"])

    index = materialize(reps.select("rep", "ids", "v").mapInArrow(place, "rep long, ids array<long>, v array<long>, pivot int, ring int, dist double"), "rings")
    catalogue = materialize(index.groupBy("pivot", "ring").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.ceil(F.count("*") / block_rows).cast("int").alias("nb")), "catalogue")

    def reach(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), dim)
                far = apart(np.hstack([x, np.zeros((len(x), 1))]), pivots)
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("q2"), pa.array([list(enumerate(r)) for r in far.tolist()], pa.list_(pa.struct([("pivot", pa.int32()), ("dist", pa.float64())])))], ["rep", "q2", "far"])

    seen = reps.where("asks").select("rep", "q2", "v").mapInArrow(reach, "rep long, q2 double, far array<struct<pivot:int,dist:double>>")
    seen = seen.select("rep", "q2", F.explode("far").alias("f")).select("rep", "q2", "f.pivot", F.col("f.dist").alias("to"))
    # the triangle inequality: no row of a ring is nearer to the query than this
    least = F.greatest(F.col("low") - F.col("to"), F.col("to") - F.col("high"), F.lit(0.0))
    bounds = seen.join(catalogue, "pivot").select("rep", "pivot", "ring", "nb", least.alias("least"), ((F.col("q2") + F.lit(top2) - least * least) / 2).alias("most"))
    bounds = materialize(bounds, "bounds")
    first = bounds.groupBy("rep").agg(F.min(F.struct("least", "pivot", "ring", "nb")).alias("b")).select("rep", "b.*")
    asks = reps.where("asks").select("rep", "v")

    def search(visits: DataFrame) -> DataFrame:
        """(rep, score, id) of the rows in the visited rings, at most `more` for each query and block, none below `floor`."""
        blocks = index.join(catalogue.select("pivot", "ring", "nb"), ["pivot", "ring"]).select("pivot", "ring", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int").alias("block"), F.lit(0).alias("kind"), "rep", "ids", "v", F.lit(None).cast("double").alias("floor"))
        come = visits.select("rep", "pivot", "ring", "floor", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block")).join(asks, "rep")
        come = come.select("pivot", "ring", "block", F.lit(1).alias("kind"), "rep", F.lit(None).cast("array<long>").alias("ids"), "v", "floor")
        rows = blocks.unionByName(come).repartition("pivot", "ring", "block").sortWithinPartitions("pivot", "ring", "block", "kind", "rep")
        hits = rows.mapInArrow(meet, "rep long, hits array<struct<score:long,id:long>>")
        return hits.select("rep", F.explode("hits").alias("x")).select("rep", "x.score", "x.id")

    exact = top2 < 2.0**52  # products are then whole numbers that a double holds

    def meet(batches):
        parts, home, ids, names = [], None, [], None
        for new, b in pieces(batches, ["pivot", "ring", "block"]):
            if new:
                parts, home, ids, names = [], None, [], None
            first = int((b.column("kind").to_numpy() == 0).sum())
            if first:
                parts.append(b.slice(0, first))
                home = np.vstack([_matrix(p.column("v"), dim) for p in parts]) if exact else np.vstack([_matrix(p.column("v"), dim).astype(np.int64) for p in parts])
                ids = [x for p in parts for x in p.column("ids").to_pylist()]
                names = np.concatenate([p.column("rep").to_numpy() for p in parts])
            rest = b.slice(first)
            if not rest.num_rows or home is None:
                continue
            q = _matrix(rest.column("v"), dim)
            s = (q @ home.T).astype(np.int64) if exact else q.astype(np.int64) @ home.T
            floor = rest.column("floor").to_numpy(zero_copy_only=False)
            out_rep, out = [], []
            for i, rep in enumerate(rest.column("rep").to_pylist()):
                good = s[i]
                if math.isnan(floor[i]):
                    who = np.arange(len(good))
                else:
                    who = np.flatnonzero(good >= floor[i])
                if len(who) > more:
                    cut = np.partition(good[who], len(who) - more)[len(who) - more]
                    who = who[good[who] >= cut]
                who = who[np.lexsort((names[who], -good[who]))][:more]
                got = sorted(((-int(good[j]), x) for j in who for x in ids[j]))[:more]
                if got:
                    out_rep.append(rep)
                    out.append([(-a, x) for a, x in got])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out_rep, pa.int64()), pa.array(out, pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())])))], ["rep", "hits"])

    best = Window.partitionBy("rep").orderBy(F.desc("score"), "id")
    near = search(first.withColumn("floor", F.lit(None).cast("double")))
    near = materialize(near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= more).drop("r"), "first")
    floor = near.groupBy("rep").agg(F.when(F.count("*") >= more, F.min("score")).cast("double").alias("floor"))
    # scores are whole; half a point and a share of the largest square cover the rounding of the distances
    rest = bounds.join(floor, "rep", "left").join(first.select("rep", "pivot", "ring", F.lit(True).alias("done")), ["rep", "pivot", "ring"], "left")
    rest = rest.where(f"done is null and (floor is null or most >= floor - {0.5 + 1e-7 * top2})")
    both = near.unionByName(search(rest))
    both = both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= more).select("rep", "score", F.col("id").alias(key))
    classes = reps.where("asks").select("rep", "v", F.xxhash64("v").alias("h"))
    queries = base.where("asks").select(F.col("id").alias("query_id"), "v", "h").join(classes, ["h", "v"]).select("query_id", "rep")
    found = queries.join(both, "rep").where(F.col(key) != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), key, "score")
