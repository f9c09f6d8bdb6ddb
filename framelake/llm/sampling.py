"""Operator 6: SentencePiece encoding and decoding by Gumbel top-k without replacement.

A text's segmentations are weighted by exp(alpha * score). Each gets, in effect, its log-probability plus an
independent Gumbel number; the k largest are k distinct samples without replacement. An A-star search finds
them without listing segmentations: the agenda holds sets of them (a fixed rest of the text, one node, and the
edges into it that are still open), each with the largest perturbed score in the set, which is a Gumbel number
truncated at the set's parent. The forward mass of a node is the exact heuristic, so the search never expands
in vain: popping a set yields its best segmentation, whose own steps open the sets that remain.

The lattice of a text falls into words (see lattice), so all texts of a batch are searched together, one piece
a round. Random numbers are a hash of (seed, row key, sample, word, step): they depend on neither batch nor
partition, and a rerun gives the same rows.

A sample's inclusion score is log(1 - exp(-exp(log_prob - kappa))), kappa being the perturbed score of the
(k+1)-th; with no such segmentation every one is included and the score is 0.

Defined cases: a null text gives one sample that is null and has no pieces; an empty text one without pieces,
as decode("") is ""; fewer than k segmentations give fewer rows; a null id is hashed as 0; equal rows get equal
samples; an empty table gives none. A word mark in the text (U+2581) is encoded like a blank and decodes to
one; everything else decodes exactly. Columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, read, salted, small_batches
from .lattice import MARK, PATH, Lattices, Vocab, split

K = 2
ALPHA = 0.5
SEED = 6
#: Characters of text that are searched together, or one text.
TOGETHER = 1 << 19


#: What a random number is for.
ROOT, STEP, SET, PICK, REST = range(5)
SAMPLES = 31


def uniform(key: np.ndarray, what: int, t: int, word, step) -> np.ndarray:
    """Numbers in (0, 1): the SplitMix64 generator seeded by key, at a counter of purpose, sample, word and step.

    The counter has room for SAMPLES samples; those after take another seed."""
    with np.errstate(over="ignore"):
        if t >= SAMPLES:
            key, t = salted(key, t // SAMPLES), t % SAMPLES
        at = (np.asarray(word).astype(np.uint64) << np.uint64(24)) + np.asarray(step).astype(np.uint64) + np.uint64((t * 8 + what + 1) << 56)
        h = mix(key + at * np.uint64(0x9E3779B97F4A7C15))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Samples:
    """The paths of sample number t over a batch: steps in search order (last piece first), by text."""

    def __init__(self, doc, word, edge, logp, n):
        self.doc, self.word, self.edge, self.logp = doc, word, edge, logp
        self.at = np.searchsorted(doc, np.arange(n + 1))


class Search:
    def __init__(self, lattices: Lattices, texts: list[str], keys: np.ndarray, seed: int):
        chunks = [split(t) if t else [] for t in texts]
        flat = lattices.types(chunks)
        self.edges = lattices
        self.logp, self.upto = lattices.logp, lattices.upto
        # The edges into a node are those from its low to the next node's.
        self.low = lattices.low
        self.high = np.append(self.low[1:], np.int32(len(self.logp)))
        self.n, self.keys = len(texts), salted(salted(keys, seed), 1)
        sizes = np.array([len(c) for c in chunks], np.int64)
        self.doc = np.repeat(np.arange(self.n), sizes)
        # Words in search order: the last of a text first. Its number counts from the text's start.
        self.word = np.repeat(sizes, sizes) - 1 - (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        at = np.repeat(np.cumsum(sizes) - sizes, sizes) + self.word
        self.type = flat[at] if len(flat) else flat

    def free(self, doc, word, node, type_, t):
        """Sample from the given nodes back to their words' starts: doc, word, edge of each step, in search order."""
        stop = self.edges.first[type_] if len(type_) else type_
        out, size, step = [], np.zeros(len(doc), np.int64), 0
        i = np.flatnonzero(node > stop)
        while len(i):
            at = node[i]
            u = uniform(self.keys[doc[i]], STEP, t, word[i], step)
            edge, last = self.low[at].astype(np.int64), self.high[at] - 1
            on = np.flatnonzero((self.upto[edge] <= u) & (edge < last))
            while len(on):
                edge[on] += 1
                on = on[(self.upto[edge[on]] <= u[on]) & (edge[on] < last[on])]
            out.append((i, edge))
            step += 1
            size[i] = step
            at = self.edges.start[edge]
            node[i] = at
            i = i[at > stop[i]]
        # A word that is not done has a step in every round, so a step's place is known.
        first = np.cumsum(size) - size
        path = np.empty(int(size.sum()), np.int64)
        for r, (i, edge) in enumerate(out):
            path[first[i] + r] = edge
        return np.repeat(doc, size), np.repeat(word, size), path

    def open_sets(self, s: Samples, t: int, since: np.ndarray) -> np.ndarray:
        """Of the set that each step of sample t opens, the perturbed score that it would have were it not below its
        sample's; none before step `since`. See truncated()."""
        if not len(s.edge):
            return np.zeros(0)
        end = self.edges.end[s.edge]
        with np.errstate(divide="ignore"):
            rest = np.where(self.high[end] - self.low[end] > 1, np.log(np.maximum(-np.expm1(s.logp), 0)), -np.inf)
            run = np.cumsum(s.logp)
            later = run - s.logp - np.concatenate([[0.0], run])[s.at[:-1]][s.doc]
            step = np.arange(len(run)) - s.at[:-1][s.doc]
            out = later + rest - np.log(-np.log(uniform(self.keys[s.doc], SET, t, step, 0)))
        out[step < since[s.doc]] = -np.inf
        return out

    def run(self, k: int):
        """Of each sample number: (Samples, perturbed score, log-probability, whether there is one) by text; and kappa."""
        n = self.n
        everyone = np.arange(n)
        g = -np.log(-np.log(uniform(self.keys, ROOT, 0, 0, 0)))
        doc, word, edge = self.free(self.doc, self.word, self.edges.last[self.type].astype(np.int64) if len(self.type) else self.type, self.type, 0)
        s = Samples(doc, word, edge, self.logp[edge], n)
        found = [(s, g, sums(s), np.ones(n, bool))]
        sets = [self.open_sets(s, 0, np.zeros(n, np.int64))]
        taken: dict[tuple[int, int, int], set[int]] = {}
        for t in range(1, k + 1):
            best, of, step = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for a, value in enumerate(sets):
                s = found[a][0]
                if not len(value):
                    continue
                some = np.flatnonzero(np.diff(s.at) > 0)
                top = np.full(n, -np.inf)
                top[some] = np.maximum.reduceat(value, s.at[some])
                hit = np.flatnonzero(value == top[s.doc])
                first = np.zeros(n, np.int64)
                first[s.doc[hit][::-1]] = hit[::-1]
                top = truncated(top, found[a][1])
                better = top > best
                best[better], of[better], step[better] = top[better], a, first[better]
            is_one = best > -np.inf
            if t == k:
                return found, np.where(is_one, best, -np.inf)
            s, since = self._realise(found, sets, taken, everyone[is_one], of, step, best, t)
            found.append((s, best, sums(s), is_one))
            sets.append(self.open_sets(s, t, since))
        return found, np.full(n, -np.inf)

    def _realise(self, found, sets, taken, docs, of, step, best, t) -> tuple[Samples, np.ndarray]:
        """The best segmentation in the popped set of each text, and the first step whose sets are its own."""
        e = self.edges
        kept, alt, words, nodes, since = [], [], [], [], np.zeros(self.n, np.int64)
        u = uniform(self.keys, PICK, t, 0, 0)
        w = uniform(self.keys, REST, t, 0, 0)
        start_word = np.full(self.n, -1, np.int64)
        for d in docs.tolist():
            a, j = int(of[d]), int(step[d])
            s = found[a][0]
            first = int(s.at[d])
            node = int(e.end[s.edge[j]])
            out = taken.setdefault((a, d, j), {int(s.edge[j])})
            low, high = int(self.low[node]), int(self.high[node])
            p = np.exp(self.logp[low:high])
            p[[x - low for x in out]] = 0
            total = p.sum()
            pick = low + min(int(np.searchsorted(np.cumsum(p), u[d] * total, "right")), high - low - 1)
            while pick in out:  # rounding at the edge of the sum
                pick = low + (pick - low + 1) % (high - low)
            out.add(pick)
            # The popped set keeps what is left at this node, below the new sample.
            p[pick - low] = 0
            left = p.sum() if len(out) < high - low else 0.0
            if left > 0:
                later = float(s.logp[first:j].sum())
                # Below the new sample, which is below the set's own: as a number below the latter.
                gap = np.logaddexp(-best[d], np.log(-np.log(w[d])) - later - np.log(left))
                top = found[a][1][d]
                sets[a][j] = -(gap + np.log(-np.expm1(min(-top - gap, -1e-300))))
            else:
                sets[a][j] = -np.inf
            since[d] = j - first + 1
            kept.append(np.arange(first, j) if j > first else np.zeros(0, np.int64))
            alt.append(pick)
            words.append(int(s.word[j]))
            nodes.append(int(e.start[pick]))
            start_word[d] = words[-1]
        if not len(docs):
            none = np.zeros(0, np.int64)
            return Samples(none, none, none, np.zeros(0), self.n), since
        kept_doc = np.repeat(docs, [len(x) for x in kept])
        kept_edge = np.concatenate([found[int(of[d])][0].edge[x] for d, x in zip(docs, kept, strict=True)])
        kept_word = np.concatenate([found[int(of[d])][0].word[x] for d, x in zip(docs, kept, strict=True)])
        alt, words, nodes = np.array(alt, np.int64), np.array(words, np.int64), np.array(nodes, np.int64)
        # Free: the rest of the popped node's word, and all words before it.
        mine = np.flatnonzero((start_word[self.doc] >= 0) & (self.word <= start_word[self.doc]))
        same = self.word[mine] == start_word[self.doc[mine]]
        node = e.last[self.type[mine]].astype(np.int64)
        node[same] = nodes[np.searchsorted(docs, self.doc[mine][same])]
        doc, word, edge = self.free(self.doc[mine], self.word[mine], node, self.type[mine], t)
        all_doc = np.concatenate([kept_doc, docs, doc])
        order = np.argsort(all_doc, kind="stable")
        edge = np.concatenate([kept_edge, alt, edge])[order]
        return Samples(all_doc[order], np.concatenate([kept_word, words, word])[order], edge, self.logp[edge], self.n), since


def truncated(free: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Gumbel numbers made to lie below top: what was above comes under it, the order stays."""
    with np.errstate(over="ignore"):
        return -np.logaddexp(-top, -free)


def sums(s: Samples) -> np.ndarray:
    out, some = np.zeros(len(s.at) - 1), np.flatnonzero(np.diff(s.at) > 0)
    if len(some):
        out[some] = np.add.reduceat(s.logp, s.at[some])
    return out


def inclusion(logp: np.ndarray, kappa: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", over="ignore"):
        x = np.minimum(logp - kappa, 50)  # far below 0 the score is x itself
        return np.where(np.isneginf(kappa), 0.0, np.where(x < -30, x, np.log(-np.expm1(-np.exp(x)))))


class Encoder:
    def __init__(self, vocab: Vocab, alpha: float = ALPHA):
        self.vocab, self.lattices = vocab, Lattices(vocab, alpha)
        of = dict(zip(vocab.ids.tolist(), (p.replace(MARK, " ").encode() for p in vocab.pieces), strict=True)) | {int(i): bytes([b]) for b, i in enumerate(vocab.byte_ids)}
        self.bytes = np.empty(max(of) + 1, object)
        for i, b in of.items():
            self.bytes[i] = b

    def ids(self, piece: np.ndarray) -> np.ndarray:
        """Ids of pieces in text order; -1 - c stands for a character c that no piece covers."""
        out = self.vocab.ids[piece].astype(np.int32)
        odd = np.flatnonzero(piece < 0)
        if not len(odd):
            return out
        each = [self.vocab.byte_ids[list(chr(-1 - p).encode("utf-8", "surrogatepass"))] for p in piece[odd].tolist()]
        sizes = np.array([len(x) for x in each])
        out = np.repeat(out, np.bincount(odd, sizes, len(piece)).astype(int) + (piece >= 0))
        at = odd + np.cumsum(sizes - 1) - (sizes - 1)
        out[np.repeat(at, sizes) + np.concatenate([np.arange(k) for k in sizes])] = np.concatenate(each)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the mark that encoding put first is taken off."""
        return self.raw(ids).decode("utf-8", "replace")

    def raw(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes[ids].tolist())[1:]

    def samples(self, texts: list[str], keys: np.ndarray, k: int = K, seed: int = SEED) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """Of each text up to k (ids, log-probability, perturbed score, inclusion score)."""
        search = Search(self.lattices, texts, keys, seed)
        found, kappa = search.run(k)
        out: list[list] = [[] for _ in texts]
        for s, g, logp, is_one in found:
            score = inclusion(logp, kappa)
            piece = search.edges.piece[s.edge]
            for d in np.flatnonzero(is_one).tolist():
                out[d].append((self.ids(piece[s.at[d] : s.at[d + 1]][::-1]), round(float(logp[d]), 9), round(float(g[d]), 9), round(float(score[d]), 9)))
        return out


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and size + n > TOGETHER:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def encode(spark: SparkSession, docs: DataFrame, k: int = K, alpha: float = ALPHA, seed: int = SEED, path: str = PATH, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, copies_col: str | None = None) -> DataFrame:
    """doc_id, sample (from 1), n_pieces, log_prob, perturbed, inclusion, ids, ids_md5 and whether the ids decode to the text.

    ids=False leaves the ids themselves null, for callers who need their digest alone. copies_col: how many samples a row
    gives instead of k, its first ones, over again where it has fewer segmentations; a null text so many nulls."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(Vocab.read(path))
    names = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "ids", "ids_md5", "decodes"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.string(), pa.bool_()]

    def sampled(encoder: Encoder, texts: list[str | None], keys: np.ndarray, copies: list[int] | None) -> list[list]:
        texts = [t or "" for t in texts]
        if copies is None:
            return encoder.samples(texts, keys, k, seed)
        out: list[list] = [[] for _ in texts]
        # A row's samples and scores do not depend on its neighbours': all rows search k, those that need more alone.
        for most in sorted({max(k, n) for n in copies}):
            own = [i for i, n in enumerate(copies) if max(k, n) == most]
            for i, found in zip(own, encoder.samples([texts[i] for i in own], keys[own], most, seed), strict=True):
                out[i] = [found[r % len(found)] for r in range(copies[i])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value, alpha)
        for batch in batches:
            texts, doc_ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            copies = batch.column(2).to_pylist() if copies_col else None
            for a, b in _groups(texts):
                rows = []
                keys = np.array([(i or 0) & 0xFFFFFFFFFFFFFFFF for i in doc_ids[a:b]], np.uint64)
                for i, found in zip(range(a, b), sampled(encoder, texts[a:b], keys, None if copies is None else copies[a:b]), strict=True):
                    if texts[i] is None:
                        rows += [(doc_ids[i], r, 0, None, None, None, None, None, None) for r in range(1, 2 if copies is None else copies[i] + 1)]
                        continue
                    want = texts[i].replace(MARK, " ").encode("utf-8", "surrogatepass")
                    for r, (own, logp, g, score) in enumerate(found, 1):
                        rows.append((doc_ids[i], r, len(own), logp, g, score, own if ids else None, hashlib.md5(own.tobytes()).hexdigest(), encoder.raw(own) == want))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=names)

    schema = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids array<int>, ids_md5 string, decodes boolean"
    more = [F.col(copies_col).cast("int")] if copies_col else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more).mapInArrow(run, schema)


def decode(spark: SparkSession, encoded: DataFrame, path: str = PATH, ids_col: str = "ids", keep_cols: tuple[str, ...] = ("doc_id", "sample")) -> DataFrame:
    """The named columns and the text of the ids; null ids give a null text."""
    sent = spark.sparkContext.broadcast(Vocab.read(path))
    rows = encoded.select(*[F.col(f"`{c}`") for c in keep_cols], F.col(ids_col).cast("array<int>").alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batches:
            texts = [None if x is None else encoder.decode(np.array(x, np.int32)) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep_cols, "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "text string"])
    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark, read(spark, sf_dir, "documents"))
