"""Two tokenizers' tokens of one text, aligned where both end, and how often each pair of ids ends together in the corpus."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import encoder

#: Pairs of ids that are sent to every task: those that hold one in so many links, so that there are no more of them.
HOT_PAIRS = 1 << 18
#: Characters of the texts that are aligned together.
CHUNK = 1 << 20


class Pieces:
    """Both encoders and what each of their ids spells; built once in each worker."""

    _built: dict = {}

    def __init__(self, ranks: str, model: str):
        import sentencepiece

        self.a = encoder(ranks)
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        spelt = {self.a.encode_single_token(x): x for x in self.a.token_byte_values()}
        self.a_bytes = [spelt.get(i, b"") for i in range(self.a.n_vocab)]
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.b_bytes = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in own], dtype=np.int64) for own in (self.a_bytes, self.b_bytes))
        # an id followed by each sign that may stand after it
        self.a_text = [np.array([f"{i}{sign}".encode() for i in range(self.a.n_vocab)], dtype=object) for sign in ",|"]
        self.b_text = [np.array([f"{i}{sign}".encode() for i in range(len(pieces))], dtype=object) for sign in ",;"]

    @classmethod
    def load(cls, ranks: str, model: str) -> Pieces:
        if (ranks, model) not in cls._built:
            cls._built[ranks, model] = cls(ranks, model)
        return cls._built[ranks, model]

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """The ids of each text by both; none where a text is null or empty or does not come back from both."""
        there = [i for i, t in enumerate(texts) if t]
        out: list[tuple[list[int], list[int]]] = [([], [])] * len(texts)
        for i, b in zip(there, self.b.encode([texts[i] for i in there], num_threads=1)):
            a, whole = self.a.encode_ordinary(" " + texts[i]), (" " + texts[i]).encode()
            if b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole:
                out[i] = (a, b)
        return out


def shared_cuts(a: np.ndarray, b: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the ascending ends `a` and `b` of the ends they share, by divide and conquer over many spans at once.

    A span (from and to in a, from and to in b) holds ends that may be shared. Each is tried at the middle of its ends
    of a: a bisect in b tells whether the end is shared; if not, the next nearest to the middle is tried. A shared end
    cuts the span, and both halves go on; a span with no shared end is a leaf. All open spans take a step together, so
    the steps are those of the deepest recursion and the work is that of all.
    """
    found_a, found_b = [], []
    lo, hi, blo, bhi = spans.T.astype(np.int64)
    tried = np.zeros(len(lo), dtype=np.int64)
    while True:
        open_ = (lo < hi) & (blo < bhi) & (tried < hi - lo)
        if not open_.any():
            break
        lo, hi, blo, bhi, tried = (x[open_] for x in (lo, hi, blo, bhi, tried))
        # the middle, one after, one before, two after, ... ; past an end of the span the other side goes on
        middle = (lo + hi) // 2
        before, after = middle - lo, hi - 1 - middle
        both = 2 * np.minimum(before, after)
        swing = np.where(tried % 2 == 1, (tried + 1) // 2, -(tried // 2))
        rest = tried - both // 2
        at = middle + np.where(tried <= both, swing, np.where(after > before, rest, -rest))
        place = np.searchsorted(b, a[at])
        shared = (place < bhi) & (place >= blo)
        shared[shared] = b[place[shared]] == a[at[shared]]
        at_cut, place_cut = at[shared], place[shared]
        found_a.append(at_cut)
        found_b.append(place_cut)
        keep = ~shared
        zero = np.zeros(len(at_cut), dtype=np.int64)
        lo, hi, blo, bhi, tried = (
            np.concatenate(x)
            for x in (
                (lo[keep], lo[shared], at_cut + 1),
                (hi[keep], at_cut, hi[shared]),
                (blo[keep], blo[shared], place_cut + 1),
                (bhi[keep], place_cut, bhi[shared]),
                (tried[keep] + 1, zero, zero),
            )
        )
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


class Aligned:
    """The alignment of some texts: tokens of all texts one after another, groups, and the links at their ends."""

    def __init__(self, pieces: Pieces, texts: list[str | None]):
        pairs = pieces.encode(texts)
        self.pieces = pieces
        self.n_a, self.n_b = (np.array([len(p[k]) for p in pairs], dtype=np.int64) for k in (0, 1))
        self.a, self.b = (np.fromiter((x for p in pairs for x in p[k]), np.int64, n.sum()) for k, n in ((0, self.n_a), (1, self.n_b)))
        self.to_a, self.to_b = (np.concatenate([[0], np.cumsum(n)]) for n in (self.n_a, self.n_b))
        # byte offsets run on over the texts; the last ends of a text are shared, the rest is searched
        ends_a, ends_b = np.cumsum(pieces.a_size[self.a]), np.cumsum(pieces.b_size[self.b])
        some = self.n_a > 0
        last_a, last_b = self.to_a[1:][some] - 1, self.to_b[1:][some] - 1
        spans = np.stack([self.to_a[:-1][some], last_a, self.to_b[:-1][some], last_b], axis=1)
        cut_a, cut_b = shared_cuts(ends_a, ends_b, spans)
        self.end_a, self.end_b = np.sort(np.concatenate([cut_a, last_a])), np.sort(np.concatenate([cut_b, last_b]))
        self.n_groups = np.diff(np.searchsorted(self.end_a, self.to_a))

    def links(self) -> np.ndarray:
        """For each group in order, the pair of ids that end it, as one number."""
        return self.a[self.end_a] * len(self.pieces.b_bytes) + self.b[self.end_b]

    def groups(self) -> list[bytes]:
        """The groups of each text, a1,a2|b1;a3|b2,b3; empty without tokens."""
        last_a, last_b = (np.zeros(len(x), dtype=bool) for x in (self.a, self.b))
        last_a[self.end_a] = last_b[self.end_b] = True
        out = np.empty(len(self.a) + len(self.b), dtype=object)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before = np.concatenate([[0], self.end_b + 1])  # tokens of b before each group
        through = np.concatenate([self.end_a + 1, [0]])  # tokens of a up to the end of each group
        for ids, text, last, at in ((self.a, self.pieces.a_text, last_a, np.arange(len(self.a)) + before[group_a]), (self.b, self.pieces.b_text, last_b, np.arange(len(self.b)) + through[group_b])):
            out[at[last]] = text[1][ids[last]]
            out[at[~last]] = text[0][ids[~last]]
        flat, cuts = out.tolist(), (self.to_a + self.to_b).tolist()
        return [b"".join(flat[s:e])[:-1] for s, e in zip(cuts, cuts[1:])]


def _chunks(texts: list[str | None]):
    """Slices of a batch with about CHUNK characters, or one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or "") > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def _paths(ranks: str | None, model: str | None) -> tuple[str, str]:
    if ranks and model:
        return ranks, model
    import public_tokenizers

    return ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), model or public_tokenizers.path("piece_bpe_32k.model")


def align(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None, model: str | None = None, groups: bool = False) -> DataFrame:
    """(key, n_a, n_b, n_groups, groups_sha256, links; with `groups` their text): both encodings of each row, aligned.

    A is the byte-level vocabulary of the file of ranks over a space and the text, B the piece model over the text, to
    which it adds that space itself; control strings are ordinary text. Byte offsets at which a token of A and one of B
    end cut the tokens into groups. links holds (a, b, n): the ids that end together at n such offsets of the row.

    One row for each row. Null and empty texts, and texts that the joined bytes of A or B do not spell (the piece model
    writes some signs otherwise), have no tokens: zeros, no links, and '' for the digest. Whole texts are read, some
    at a time so that about a million characters, or one longer text, are held; nothing is shuffled.
    """
    ranks, model = _paths(ranks, model)
    kind = dict(df.dtypes)[key]
    link = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])

    def run(batches):
        pieces = Pieces.load(ranks, model)
        width = len(pieces.b_bytes)
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for s, e in _chunks(texts):
                x = Aligned(pieces, texts[s:e])
                # pairs of one text stand together, so that they are counted by one sort
                pairs, rows = x.links(), np.repeat(np.arange(e - s), x.n_groups)
                order = np.lexsort((pairs, rows))
                pairs, rows = pairs[order], rows[order]
                new = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (rows[1:] != rows[:-1])])) if len(pairs) else np.zeros(0, np.int64)
                n = np.diff(np.append(new, len(pairs)))
                values = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in (pairs[new] // width, pairs[new] % width, n)], fields=list(link))
                offsets = np.searchsorted(rows[new], np.arange(e - s + 1))
                said = x.groups()
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in said]
                cols = [batch.column("k").slice(s, e - s), *(pa.array(v, pa.int64()) for v in (x.n_a, x.n_b, x.n_groups)), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)]
                names = ["k", "n_a", "n_b", "n_groups", "groups_sha256", "links"]
                if groups:
                    cols, names = [*cols, pa.array([g.decode() for g in said], pa.string())], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(cols, names)

    out = f"k {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links array<struct<a: int, b: int, n: int>>" + ", groups string" * groups
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, out).withColumnRenamed("k", key)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): how often each pair of ids is linked in all rows, and whether no other a has b more often; ties are all best."""
    counts = aligned.select(F.inline("links")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "pairs")
    # at most one row for each id of B
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(highest, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def weigh(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None, model: str | None = None, hot: int = HOT_PAIRS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): each row's alignment, weighed by the whole corpus.

    n_links counts the pairs of token occurrences that end together, n_best those whose pair of ids is the most
    frequent one of its B id, count_sum adds up the pair's count over all links. Rows as `align` says; repeated rows count
    each time; an empty table gives no rows.

    Texts are encoded once, and what follows reads the written alignments. A pair with at least one in `hot` of all
    links is known to every task: there are no more than `hot` of these, whatever the corpus, and they make up most
    links. The links of all other pairs meet their counts in a shuffle in which, for the same reason, no key has more
    than one in `hot` of the links. Sums of a row are made before they are shuffled.
    """
    rows = materialize(align(df, key, text, ranks, model).withColumnRenamed(key, "key").withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(link_counts(rows), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = F.col("n") >= -(-total // hot)
    each = rows.select("row", F.inline("links")).withColumnRenamed("n", "m")
    known = F.broadcast(counts.where(frequent))
    met = each.join(known, ["a", "b"]).unionByName(each.join(known.select("a", "b"), ["a", "b"], "left_anti").join(counts.where(~frequent), ["a", "b"]))
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return rows.drop("links").join(sums, "row", "left").select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), *[F.coalesce(c, none).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256"
    )
