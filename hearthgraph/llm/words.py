"""Words of a batch of texts as arrays: word hashes, hashes of runs of words, minimizers."""

from __future__ import annotations

import numpy as np

_M = np.uint64(0xFFFFFFFFFFFFFFFF)
_rng = np.random.default_rng(20250101)
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes hashed at a time; a longer text is hashed in several steps.
STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a published finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of them."""
    have = _POW.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POW[base] = tuple(both)
    return have


def clean(text: str | None) -> bytes:
    """The words of a text joined by single spaces."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").split())


class Words:
    """The words of several cleaned texts: `first[i]:first[i + 1]` are the words of text i."""

    def __init__(self, texts: list[bytes]):
        full = [t for t in texts if t]
        counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.n = int(self.first[-1])
        buf = np.frombuffer(b" ".join(full) + b" " if full else b"", dtype=np.uint8)
        ends = np.flatnonzero(buf == 32)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        out = np.empty(len(ends), dtype=np.uint64)
        w = 0
        while w < len(ends):  # pieces of whole words, so that the tables of powers stay small
            to = max(w + 1, int(np.searchsorted(ends, starts[w] + STEP)))
            lo, hi = int(starts[w]), int(ends[to - 1])
            pw, inv = _powers(0x9E3779B97F4A7C15, hi - lo + 1)
            c = np.empty(hi - lo + 1, dtype=np.uint64)
            c[0] = 0
            np.cumsum(_BYTE[buf[lo:hi]] * pw[: hi - lo], out=c[1:])
            s, e = starts[w:to] - lo, ends[w:to] - lo
            out[w:to] = (c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64)
            w = to
        self.hash = mix(out)
        self.doc = np.repeat(np.arange(len(texts)), counts)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each position on; runs that leave a text are there too, see `whole`."""
        n = self.n - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        pw, inv = _powers(0xD1342543DE82EF95, self.n + 1)
        c = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(self.hash * pw[: self.n], out=c[1:])
        return mix((c[k:] - c[:n]) * inv[:n])

    def whole(self, k: int) -> np.ndarray:
        """Positions whose k words lie in one text."""
        n = self.n - k + 1
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)


def first_of_each(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True where a hash stands for the first time in its text."""
    out = np.zeros(len(h), dtype=bool)
    if len(h):
        order = np.lexsort((h, doc))
        d, v = doc[order], h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
        out[order[new]] = True
    return out


def minimizers(gram: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` grams, the position of its smallest one, the leftmost of equals."""
    n = len(gram) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    bits = np.uint64(max(1, int(len(gram)).bit_length()))
    m = (mix(gram) >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: n], m[width - span : width - span + n])
    return (m[:n] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
