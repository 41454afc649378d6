"""The deterministic offline embedding as integer column expressions.

A token seeds a 32-bit generator with its FNV-1a hash; eight (dimension, weight) pairs are drawn and
summed over the tokens of a text. Weights are kept as whole multiples of 2^-32, so sums are exact in
any order and the same on every engine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import HAN, fold_han_raw

MASK = 0xFFFFFFFF
# fixed values: FNV-1a offset and prime, generator step
FNV_OFFSET, FNV_PRIME, STEP = 2166136261, 16777619, 0x6D2B79F5
DRAWS = 8
UNIT = float(2**32)


def _mul32(a: Column, b: Column) -> Column:
    """Low 32 bits of a product of two 32-bit numbers, without leaving 64 bits."""
    low = a * b.bitwiseAND(F.lit(0xFFFF))
    high = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(MASK))


def fnv1a(words: list[str]) -> np.ndarray:
    """The 32-bit FNV-1a hash of each word, over its characters; all words take a step at a time."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    order = np.argsort(-size, kind="stable")
    start, size = (np.cumsum(size) - size)[order], size[order]
    seeds = np.full(len(words), FNV_OFFSET, np.uint64)
    # the longest stand first, so that those with a next character are the first `n`
    for i, n in enumerate(np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")):
        seeds[:n] = ((seeds[:n] ^ chars[start[:n] + i]) * np.uint64(FNV_PRIME)) & np.uint64(MASK)
    out = np.empty_like(seeds)
    out[order] = seeds
    return out


def with_draw(df: DataFrame, seed: str, k: Column, out: str) -> DataFrame:
    """Add the k-th (from 1) 32-bit number of the generator started at `seed`.

    One column per step: every step reads the one before it several times over.
    """
    c = F.col
    d = df.withColumn("_a", (c(seed) + k.cast("bigint") * F.lit(STEP).cast("bigint")).bitwiseAND(F.lit(MASK)))
    d = d.withColumn("_t", _mul32(c("_a").bitwiseXOR(F.shiftright("_a", 15)), c("_a").bitwiseOR(F.lit(1).cast("bigint"))))
    d = d.withColumn("_u", _mul32(c("_t").bitwiseXOR(F.shiftright("_t", 7)), c("_t").bitwiseOR(F.lit(61).cast("bigint"))))
    d = d.withColumn("_t", (c("_t") + c("_u")).bitwiseAND(F.lit(MASK)).bitwiseXOR(c("_t")))
    return d.withColumn(out, c("_t").bitwiseXOR(F.shiftright("_t", 14))).drop("_a", "_t", "_u")


def embed_tokens(text: Column) -> Column:
    parts = F.split(F.lower(fold_han_raw(text)), f"[^a-z0-9{HAN}]+")
    return F.filter(parts, lambda t: F.length(t) >= 2)


def _draws(seeds: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, weight in units of 2^-32) arrays of shape (len(seeds), DRAWS) for one batch of seeds."""
    mask = np.uint64(MASK)
    k = np.arange(1, 2 * DRAWS + 1, dtype=np.uint64)
    a = (seeds[:, None] + k * np.uint64(STEP)) & mask
    t = ((a ^ (a >> np.uint64(15))) * (a | np.uint64(1))) & mask
    u = ((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & mask
    t = ((t + u) & mask) ^ t
    r = t ^ (t >> np.uint64(14))
    return ((r[:, 0::2] * np.uint64(dims)) >> np.uint64(32)).astype(np.int64), r[:, 1::2].astype(np.int64) * 2 - 2**31


def _rows(batch: pa.RecordBatch, dims: int):
    """(row, dimension, weight) of every draw of a batch, and its number of rows."""
    seeds = batch.column("seeds")
    n = np.diff(seeds.offsets.to_numpy())
    said = seeds.flatten().dictionary_encode()
    where, weight = _draws(fnv1a(said.dictionary.to_pylist()), dims)
    at = said.indices.to_numpy()
    return np.repeat(np.arange(len(n)), n * DRAWS), where[at].ravel(), weight[at].ravel()


def _few(batches, rows: int = 2048):
    """Slices of at most `rows` rows, so that what is made of them stays small whatever the batch size."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def hash_weights(texts: DataFrame, dims: int = 768) -> DataFrame:
    """(id, text) -> (id, dim, weight): the sparse vector in units of 2^-32, zero sums kept out.

    The relational form of hash_vectors, for joins on single dimensions and for exact comparison.

    The texts of an id are brought together, once; draws are summed in whole numbers inside the Arrow batch
    that makes them, so that only an id's own sums leave it and no draw is shuffled or spilled.
    """

    def summed(batches):
        for batch in _few(batches):
            row, where, weight = _rows(batch, dims)
            key, at = np.unique(row * dims + where, return_inverse=True)
            total = np.zeros(len(key), dtype=np.int64)
            np.add.at(total, at, weight)
            key, total = key[total != 0], total[total != 0]
            ends = np.searchsorted(key, np.arange(batch.num_rows + 1) * dims).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((key % dims).astype(np.int32), total)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], names=["id", "dim", "weight"])

    tokens = F.flatten(F.collect_list(embed_tokens(F.col("text"))))
    seeds = texts.groupBy("id").agg(tokens.alias("tokens")).select("id", F.col("tokens").alias("seeds")).filter(F.size("seeds") > 0)
    sums = seeds.mapInArrow(summed, f"id {dict(texts.dtypes)['id']}, dim array<int>, weight array<bigint>")
    return sums.select("id", F.explode(F.arrays_zip("dim", "weight")).alias("w")).select("id", "w.dim", "w.weight")


def seeded(texts: DataFrame) -> DataFrame:
    """(..., text) -> (..., seeds): what a text's vector is made of, its tokens; each different one of a batch is hashed where vectors are made."""
    return texts.select(*[c for c in texts.columns if c != "text"], embed_tokens(F.coalesce("text", F.lit(""))).alias("seeds"))


def dense(batch: pa.RecordBatch, dims: int = 768) -> np.ndarray:
    """The normalized vectors of a batch of seeds, one row each."""
    row, where, weight = _rows(batch, dims)
    v = np.bincount(row * dims + where, weights=weight / UNIT, minlength=batch.num_rows * dims).reshape(-1, dims)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    norm[norm == 0] = 1.0
    return v / norm


def dense_single(batch: pa.RecordBatch) -> np.ndarray:
    """The same in single precision, as an index stores them."""
    return dense(batch).astype(np.float32)


def spoken(batches):
    """Small batches of seeds, without the rows that have none."""
    for batch in batches:
        yield from _few([batch.filter(pc.greater(pc.list_value_length(batch.column("seeds")), 0))])


def hash_vectors(texts: DataFrame, dims: int = 768) -> DataFrame:
    """(id, text) -> (id, embedding array<double>) normalized; texts without a token have no vector.

    Columns beside id and text come along. A text's vector depends on its own tokens only, so this is a projection:
    tokens are cut beside the scan and an Arrow batch turns them into vectors, without any shuffle.
    """
    rest = [c for c in texts.columns if c != "text"]

    def made(batches):
        for batch in spoken(batches):
            vectors = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * dims, pa.array(dense(batch, dims).ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), vectors], names=[*rest, "embedding"])

    return seeded(texts).mapInArrow(made, ", ".join(f"`{c}` {t}" for c, t in texts.select(*rest).dtypes) + ", embedding array<double>")
