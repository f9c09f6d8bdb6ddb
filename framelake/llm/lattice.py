"""Segmentation lattices over a unigram vocabulary, many words at a time.

The vocabulary is read from a SentencePiece file of public pieces. Where the file is a merge table (its scores
are ranks), piece r of its order takes the log-probability of Zipf's law, -ln(r + 2.7), in whole thousandths,
so that sums are exact and ties are true ties. A character that no piece covers costs UNKNOWN less than the
rarest piece and is written as its UTF-8 byte pieces.

No piece has a word mark after another character, so a text's lattice is cut into words ("chunks": a run of
marks and what follows), and its best score and its partition function are those of its chunks together.
Aho-Corasick finds the pieces in all distinct chunks of a batch; dynamic programming then runs over all of
them at once, one character position at a time.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

import ahocorasick
import numpy as np

MARK = "▁"
PATH = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = 10_000


class Vocab:
    """Pieces with whole-number scores (thousandths of a nat), and the ids of the 256 byte pieces."""

    def __init__(self, ids: list[int], pieces: list[str], scores: list[int], byte_ids: list[int]):
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a word mark after another character")
        self.pieces = pieces
        self.ids = np.array(ids, np.int64)
        self.scores = np.array(scores, np.int64)
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.unknown = int(self.scores.min()) - UNKNOWN
        self.byte_ids = np.array(byte_ids, np.int64)
        self._find = None
        self._trie = None

    @classmethod
    def read(cls, path: str = PATH) -> Vocab:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        bytes_ = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        return cls(plain, [m.id_to_piece(i) for i in plain], [-round(1000 * math.log(r + 2.7)) for r in range(len(plain))], [bytes_[b] for b in range(256)])

    def __getstate__(self):
        return self.__dict__ | {"_find": None, "_trie": None}

    def walk(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every occurrence, as matches() has them: a trie walked from all positions at once."""
        if self._trie is None:
            self._trie = Trie(self.pieces)
        return self._trie.walk(points)

    def matches(self, text: str) -> np.ndarray:
        """Last position and piece of every occurrence, flat."""
        if self._find is None:
            self._find = ahocorasick.Automaton()
            for k, p in enumerate(self.pieces):
                self._find.add_word(p, k)
            self._find.make_automaton()
        return np.fromiter(itertools.chain.from_iterable(self._find.iter(text)), np.int64)


class Trie:
    """Child nodes in one open-addressing table keyed by (node, character)."""

    BITS = 19

    def __init__(self, pieces: list[str]):
        node, child, self.piece = {"": 0}, {}, [-1]
        for k, p in enumerate(pieces):
            for i in range(len(p)):
                if p[: i + 1] not in node:
                    node[p[: i + 1]] = len(node)
                    self.piece.append(-1)
                    child[node[p[:i]] << 21 | ord(p[i])] = node[p[: i + 1]]
            self.piece[node[p]] = k
        self.bits = max(self.BITS, (4 * len(child)).bit_length())
        self.piece = np.array(self.piece, np.int64)
        keys = np.fromiter(child, np.int64, len(child))
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        for slot, key in zip(self._slot(keys).tolist(), keys.tolist(), strict=True):
            while self.key[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.key[slot], self.to[slot] = key, child[key]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def walk(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, state, depth = np.arange(len(points)), np.zeros(len(points), np.int64), 0
        text = np.concatenate([points.astype(np.int64), np.zeros(1, np.int64)])
        found = []
        while len(at):
            key = state << 21 | text[np.minimum(at + depth, len(points))]
            slot = self._slot(key)
            have = self.key[slot]
            other = np.flatnonzero((have != key) & (have >= 0))
            while len(other):
                slot[other] = (slot[other] + 1) & ((1 << self.bits) - 1)
                have[other] = self.key[slot[other]]
                other = other[(have[other] != key[other]) & (have[other] >= 0)]
            hit = np.flatnonzero(have == key)
            at, state = at[hit], self.to[slot[hit]]
            depth += 1
            piece = self.piece[state]
            whole = np.flatnonzero(piece >= 0)
            found.append((at[whole], at[whole] + depth, piece[whole]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def split(text: str) -> list[str]:
    """The chunks of a text, each without its first mark. Text begins with a mark that is not in it."""
    out = text.replace(MARK, " ").split(" ")
    if "" in out[:-1]:
        joined, marks = [], ""
        for w in out:
            if w == "" and len(joined) + len(marks) < len(out):
                marks += MARK
            else:
                joined.append(marks + w)
                marks = ""
        if marks:
            joined.append(marks[1:])
        return joined
    return out


def _by_end(end: np.ndarray, size: np.ndarray, nodes: int) -> np.ndarray:
    """The order of edges by end, the longest first; of one size no two have the same end."""
    place, order = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=nodes))]), np.empty(len(end), np.int64)
    by_size = np.argsort(size.astype(np.uint8) if len(size) and size.max() < 256 else size, kind="stable")
    cuts = np.searchsorted(size[by_size], np.arange(1, int(size.max(initial=0)) + 2))
    for a, b in reversed(list(itertools.pairwise(cuts))):
        e = by_size[a:b]
        order[place[end[e]]] = e
        place[end[e]] += 1
    return order


class Edges:
    """The lattices of a list of chunks. Nodes are positions in the joined chunks; each chunk has one node more than characters."""

    def __init__(self, vocab: Vocab, chunks: list[str], automaton: bool = True):
        text = MARK + ("\x00" + MARK).join(chunks) + "\x00" if chunks else ""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
        self.first = np.concatenate([[0], np.cumsum(size + 1)])[:-1] if len(size) else np.zeros(0, np.int64)
        self.last = self.first + size
        n = len(text)
        all_points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if automaton:
            found = vocab.matches(text)
            end, piece = found[::2] + 1, found[1::2]
            start = end - vocab.sizes[piece]
        else:
            start, end, piece = vocab.walk(all_points)
        single = np.zeros(n + 1, bool)
        single[start[end - start == 1]] = True
        single[self.last] = True
        rest = np.flatnonzero(~single[:n])
        points = all_points[rest].astype(np.int64)
        start, end, piece = np.concatenate([start, rest]), np.concatenate([end, rest + 1]), np.concatenate([piece, -1 - points])
        order = _by_end(end, end - start, n + 1)
        self.start, self.end, self.piece = start[order], end[order], piece[order]
        known = self.piece >= 0
        self.score = np.where(known, vocab.scores[np.where(known, self.piece, 0)], vocab.unknown)
        cp = -1 - self.piece
        self.count = np.where(known, 1, 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)).astype(np.int64)
        self.nodes = n + 1
        # Rounds: edges by how far their end is from the chunk's start; within a round by end.
        chunk = np.searchsorted(self.first, self.end - 1, "right") - 1
        depth = self.end - self.first[chunk] if len(chunk) else np.zeros(0, np.int64)
        by = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(depth, minlength=1))])
        self.rounds = [by[a:b] for a, b in itertools.pairwise(cuts) if b > a]

    def viterbi(self) -> tuple[np.ndarray, np.ndarray]:
        """Best score and its number of pieces, by chunk. Of equal paths the one whose last piece starts first, as the tokenizer has it."""
        best, pieces = np.zeros(self.nodes, np.int64), np.zeros(self.nodes, np.int64)
        for e in self.rounds:
            end = self.end[e]
            head = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
            value = best[self.start[e]] + self.score[e]
            top = np.maximum.reduceat(value, head)
            group = np.cumsum(np.bincount(head, minlength=len(e))) - 1
            at = np.flatnonzero(value == top[group])
            at = at[np.concatenate([[True], group[at][1:] != group[at][:-1]])]
            best[end[at]] = top
            pieces[end[at]] = pieces[self.start[e[at]]] + self.count[e[at]]
        return best[self.last], pieces[self.last]

    def forward(self, alpha: float) -> np.ndarray:
        """Log-probability of each edge given its end, for segmentations weighted by alpha times their score in nats."""
        mass = np.zeros(self.nodes)
        out = np.zeros(len(self.end))
        for e in self.rounds:
            end = self.end[e]
            head = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
            value = mass[self.start[e]] + self.score[e] * (alpha / 1000)
            top = np.maximum.reduceat(value, head)
            width = np.diff(np.append(head, len(e)))
            total = np.log(np.add.reduceat(np.exp(value - np.repeat(top, width)), head)) + top
            mass[end[head]] = total
            out[e] = value - np.repeat(total, width)
        return np.minimum(out, 0)


class _Rows:
    """An array that grows at its end and can be cut back."""

    def __init__(self, kind):
        self.n, self.all = 0, np.zeros(1 << 12, kind)

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.all):
            more = np.zeros(max(2 * len(self.all), self.n + len(x)) if len(self.all) < 1 << 22 else (self.n + len(x)) * 5 // 4, self.all.dtype)
            more[: self.n] = self.all[: self.n]
            self.all = more
        self.all[self.n : self.n + len(x)] = x
        self.n += len(x)


class Lattices:
    """Lattices by chunk with the probability of each edge given its end, kept from batch to batch.

    The first `most` distinct chunks stay, as frequent ones come early; later ones go when their batch is done."""

    def __init__(self, vocab: Vocab, alpha: float, most: int = 60_000):
        self.vocab, self.alpha, self.most = vocab, alpha, most
        self.number: dict[str, int] = defaultdict(itertools.count().__next__)
        self.late: list[str] = []
        self.cut: tuple[int, int] | None = None
        self.rows = {"first": _Rows(np.int32), "last": _Rows(np.int32), "low": _Rows(np.int32)} | {k: _Rows(np.int32) for k in ("start", "end", "piece")} | {k: _Rows(np.float64) for k in ("logp", "upto")}

    def __getattr__(self, name):
        r = self.__dict__["rows"][name]
        return r.all[: r.n]

    def types(self, chunks: list[list[str]]) -> np.ndarray:
        """The number of each chunk, in order."""
        number, rows = self.number, self.rows
        if self.late:
            for w in self.late:
                del number[w]
            number.default_factory = itertools.count(len(number)).__next__
            n, nodes, edges = len(number), *self.cut
            for k, r in rows.items():
                r.n = n if k in ("first", "last") else nodes if k == "low" else edges
            self.late = []
        known = len(number)
        flat = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(chunks)), np.int64)
        if len(number) > known:
            new = list(itertools.islice(number, known, None))
            keep = max(0, self.most - known)
            self._add(new[:keep])
            if len(new) > keep:
                self.late, self.cut = new[keep:], (rows["low"].n, rows["start"].n)
                self._add(self.late)
        return flat

    def _add(self, new: list[str]) -> None:
        if not new:
            return
        e, rows = Edges(self.vocab, new, automaton=False), self.rows
        logp = e.forward(self.alpha)
        # Running sums of the probabilities of the edges into a node, summed within the node alone.
        into = np.bincount(e.end, minlength=e.nodes)
        low = np.cumsum(into) - into
        upto, rank = np.exp(logp), np.arange(len(e.end)) - low[e.end]
        later = np.flatnonzero(rank)
        rank, r = rank[later], 0
        while len(later):
            r += 1
            now = rank == r
            upto[later[now]] += upto[later[now] - 1]
            later, rank = later[~now], rank[~now]
        nodes, edges = rows["low"].n, rows["start"].n
        for k, x in (("first", e.first + nodes), ("last", e.last + nodes), ("low", low + edges), ("start", e.start + nodes), ("end", e.end + nodes), ("piece", e.piece), ("logp", logp), ("upto", upto)):
            rows[k].add(x)
