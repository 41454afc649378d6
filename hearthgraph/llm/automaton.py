"""BPE as a deterministic automaton over tokens, built merge by merge, and the pre-split of byte-level BPE."""

from __future__ import annotations

import json
import re

import numpy as np
import regex

# Fixed value: the published pre-split pattern of byte-level BPE.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries of each of the two caches of a worker; a full cache is emptied.
CACHE = 300_000
_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """States are "the last token was t"; an arc is the next token and its label that token's bytes.

    At the start every state has an arc for each byte. The gadget of merge number i, (u, v) -> w, changes it thus:
    the state after u loses its arc v; each state that still has an arc u gets an arc w; and the state after w is a
    copy of the state after v as it stood before step i. Each gadget is recorded once (`gone`, `head`, `tail`), so
    construction is linear in the merges; arcs are read off these records when first asked for and kept in a table.
    Exactly one path spells any text: its encoding.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        kind = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or spec.get("normalizer") or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or model.get("ignore_merges"):
            raise ValueError(f"{path} is no byte-level BPE without normalizer and prefix space")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.labels[i] = bytes(letters[c] for c in t)
        for t, i in self.special.items():
            self.labels[i] = t.encode()
        # the gadget records: born[w] = i, head[w] = u, tail[w] = v, gone[u][v] = i
        self.born = [-1] * size
        self.head, self.tail = [-1] * size, [-1] * size
        self.gone: list[dict[int, int]] = [{} for _ in range(size)]
        for i, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if self.born[w] >= 0 or len(self.labels[w]) < 2:
                raise ValueError(f"merge {i} makes a token that exists already")
            self.gone[u][v] = i
            self.born[w], self.head[w], self.tail[w] = i, u, v
        # a token that no merge makes is never emitted
        self.ids = {self.labels[i]: i for i in vocab.values() if self.born[i] >= 0 or len(self.labels[i]) == 1}
        # the labels as a tree of bytes: (node, byte) -> node, and the token that ends in a node
        self.step: dict[int, int] = {}
        self.ends = [-1]
        for label, t in self.ids.items():
            node = 0
            for byte in label:
                to = self.step.setdefault(node << 8 | byte, len(self.ends))
                if to == len(self.ends):
                    self.ends.append(-1)
                node = to
            self.ends[node] = t
        self.prefix = [-2] * size
        self.table: dict[int, bool] = {}
        self.size = size
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.split = regex.compile(PRE_SPLIT).findall
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.next_to_space = re.compile(r"\s\s|^ | $")
        self.cut = re.compile(r"(?<=\S) (?=\S)")

    def lost(self, state: int, arc: int) -> int:
        """The step at which the state lost the arc that it had, or inherited as lost; never: a huge number."""
        when, until = _NEVER, _NEVER
        while state >= 0:
            i = self.gone[state].get(arc, _NEVER)
            if i < until and i < when:
                when = i
            until, state = self.born[state], self.tail[state]
        return when

    def follows(self, state: int, arc: int) -> bool:
        """Has the state the arc in the end?  Arc w is there if arc u was there right after the step that made w."""
        key = state * self.size + arc
        known = self.table.get(key)
        if known is None:
            until, known = _NEVER - 1, True
            while arc >= 0:
                if self.lost(state, arc) <= until:
                    known = False
                    break
                until, arc = self.born[arc], self.head[arc]
            if len(self.table) >= 4 * CACHE:
                self.table.clear()
            self.table[key] = known
        return known

    def longest_at(self, label: bytes, start: int) -> int:
        step, ends, node, best = self.step, self.ends, 0, -1
        for i in range(start, len(label)):
            node = step.get(node << 8 | label[i])
            if node is None:
                break
            t = ends[node]
            if t >= 0:
                best = t
        if best < 0:
            raise ValueError("a byte is missing in the vocabulary")
        return best

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 for a single byte."""
        t = self.prefix[token]
        if t == -2:
            label = self.labels[token]
            t = self.prefix[token] = self.longest_at(label[:-1], 0) if len(label) > 1 else -1
        return t

    def path(self, label: bytes) -> list[int]:
        """The tokens of the one path that spells the bytes.

        Any prefix is spelled by one path only, so a position from which no arc leads on is dead for good, and the walk
        takes the longest arc first and steps back at most once from each position.
        """
        n, labels, table, size = len(label), self.labels, self.table, self.size
        out: list[int] = []
        dead: set[int] = set()
        pos, last, token = 0, -1, self.longest_at(label, 0) if n else -1
        while pos < n:
            end = pos + len(labels[token])
            if end not in dead:
                fits = last < 0 or table.get(last * size + token)
                if fits is None:
                    fits = self.follows(last, token)
                if fits:
                    out.append(token)
                    pos, last = end, token
                    if pos < n:
                        token = self.longest_at(label, pos)
                    continue
            token = self.shorter(token)
            while token < 0:
                dead.add(pos)
                token = out.pop()
                pos -= len(labels[token])
                last = out[-1] if out else -1
                token = self.shorter(token)
        return out

    def piece(self, s: str) -> bytes:
        got = self.pieces.get(s)
        if got is None:
            got = np.array(self.path(s.encode("utf-8", "surrogatepass")), dtype="<u4").tobytes()
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            if len(s) <= 64:
                self.pieces[s] = got
        return got

    def chunk(self, s: str) -> bytes:
        got = self.chunks.get(s)
        if got is None:
            # a word of letters is one piece
            got = self.piece(s) if s[1:].isalpha() and s[0] == " " else b"".join(map(self.piece, self.split(s)))
            if len(self.chunks) >= CACHE:
                self.chunks.clear()
            if len(s) <= 64:
                self.chunks[s] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text, as little-endian 32-bit integers.

        A space between two characters that are no white space always begins a piece of the pre-split, so the text may
        be cut there and the parts looked up whole.
        """
        out = []
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
            elif part:
                first, *rest = part.split(" ") if not self.next_to_space.search(part) else self.cut.split(part)
                out.append(self.chunk(first))
                get = self.chunks.get
                for s in rest:
                    out.append(get(s := " " + s) or self.chunk(s))
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs, one after another."""
        return b"".join(map(self.labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


_BUILT: dict[str, Automaton] = {}


def load(path: str) -> Automaton:
    """The automaton of a vocabulary file, built once in each worker."""
    if path not in _BUILT:
        _BUILT[path] = Automaton(path)
    return _BUILT[path]
