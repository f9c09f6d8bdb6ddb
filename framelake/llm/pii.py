"""Operator 4: personal data by patterns and a skip-chain conditional random field.

Patterns give base spans (email, ip, card, phone), which stay. The field has a node for each token that holds a
digit or @ and for each later mention of an address's local part; neighbouring tokens share a chain potential,
and distant tokens of the same form, or of the same last seven digits, share a skip potential. Loopy message
passing over a batch of documents at once (no edge leaves a document) makes labels agree across a document:
a token like one that a pattern found is labelled as it where the field says so. Neighbouring tokens that the
field labels card or phone are one span while it has no more digits than its kind may have. Each document's messages run until they rest, on steps that shrink, so
that every document does; the others of its batch do not matter.

The field is trained here, piecewise, from counts over all documents with the base spans as labels: node weights
by multinomial regression on BITS shape bits (at most 2**BITS * 5 counts are gathered), pair potentials from
co-occurrence counts. What a pattern matched but dropped as too long (a phone that runs on into the next number)
is no evidence: such tokens have no label in training, and the field decides on them afterwards.

Defined cases: a null text is empty and has no spans; spans count code points, end exclusive, and stand by start,
then kind; repeated rows are labelled alike; an empty table gives none; without any token nothing is added. Only
the columns named are read; mask() hands all columns of docs on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Added spans need this probability.
SURE = 0.9
#: Counts that repeated tokens start with: for equal labels, for different ones.
AGREE, DIFFER = 20.0, 0.2
#: Messages rest when none of a document's changes by more; steps are of STEP, and shrink by SHRINK after so many rounds.
REST, STEP, SHRINK, ROUNDS = 1e-4, 0.5, 0.97, 32
BITS = 15
#: A node that no pattern labels, and one that is not known.
NONE, UNKNOWN = 0, -1
#: Local parts of an address shorter than this are not looked for elsewhere.
LOCAL_LEAST = 5
#: Digits that a span may have by kind; an address of either kind is one token.
MOST_DIGITS = (0, 0, 19, 15)
MASKS = {k: f"[{k.upper()}]" for k in KINDS}

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A start inside a run of digits can't match where the run's first digit doesn't.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ACTIVE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?()[]{}<>\"'|*#$%&"
_DIGITS = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9]\.[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1) if at > done and text[at - 1] in _LOCAL else None
        if m:
            start = at - 1
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind), by start, then kind."""
    if not text:
        return []
    out = [(s, e, 0) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=_order)


def _order(span: tuple) -> tuple:
    return span[0], span[2], span[1]


def too_long(text: str) -> list[tuple[int, int]]:
    """What the card and phone patterns match and drop for having too many digits."""
    out = [m.span() for m in _CARD.finditer(text) if len(_DIGITS.findall(m[0])) > MOST_DIGITS[2]]
    return out + [m.span() for m in _PHONE.finditer(text) if len(_DIGITS.findall(m[0])) > MOST_DIGITS[3]]


def _shape(raw: str, core: str, number: str, before: bool, after: bool) -> int:
    digits = len(number)
    bits = ("@" in core, "+" in raw[:2], "(" in raw or ")" in raw, 1 <= digits <= 2, 3 <= digits <= 4, 5 <= digits <= 7, 8 <= digits <= 11, 12 <= digits <= 19, digits > 19, any(c.isalpha() for c in core), bool(_DOTTED.search(core)), "-" in core, before, after, 12 <= digits <= 19 and luhn(number))
    return sum(1 << i for i, b in enumerate(bits) if b)


class Graph:
    """Nodes and edges of many documents; labels run from 0 (none) over the kinds, UNKNOWN is none of them."""

    def __init__(self):
        self.doc, self.span, self.label, self.shape = [], [], [], []
        self.chain, self.skip = [], []

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        spans, at, n = [], 0, len(text)
        while m := _ACTIVE.search(text, at):
            s = e = m.start()
            while s > at and not text[s - 1].isspace():
                s -= 1
            t = _TOKEN.match(text, e)
            e = t.end()
            spans.append((s, e))
            at = e
        locals_ = {text[s:e].partition("@")[0].lower(): None for s, e, k in base if k == 0}
        locals_ = {x for x in locals_ if len(x) >= LOCAL_LEAST}
        if locals_:
            have = {s for s, _ in spans}
            spans = sorted(spans + [m.span() for m in _TOKEN.finditer(text) if m.start() not in have and m[0].strip(_EDGE).lower() in locals_])
        first, seen, j = len(self.doc), {}, 0
        base, dropped = sorted(base), too_long(text)
        cores = []
        for s, e in spans:
            raw = text[s:e]
            a = s + len(raw) - len(raw.lstrip(_EDGE))
            b = max(a, e - (len(raw) - len(raw.rstrip(_EDGE))))
            cores.append((a, b) if b > a else (s, e))
        for i, ((s, e), (a, b)) in enumerate(zip(spans, cores, strict=True)):
            while j < len(base) and base[j][1] <= s:
                j += 1
            label = next((k + 1 for x, y, k in base[j : j + 4] if x < b and y > a), NONE)
            if label == NONE and any(x < b and y > a for x, y in dropped):
                label = UNKNOWN
            core, node = text[a:b], len(self.doc)
            before = i > 0 and s - spans[i - 1][1] <= 1
            after = i + 1 < len(spans) and spans[i + 1][0] - e <= 1
            digits = "".join(_DIGITS.findall(core))
            self.doc.append(doc)
            self.span.append((a, b))
            self.label.append(label)
            self.shape.append(_shape(text[s:e], core, digits, before, after))
            if before and node > first:
                self.chain.append((node - 1, node))
            keys = [core.lower()]
            if "@" in core:
                keys.append(core.partition("@")[0].lower())
            if len(digits) >= 7:
                keys.append("#" + digits[-7:])
            for k in keys:
                if k in seen and seen[k] != node and len(k) >= LOCAL_LEAST:
                    self.skip.append((seen[k], node))
                seen[k] = node


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


class Field:
    """Node weights (BITS + 1, labels) and pair potentials."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip
        # By shape, so that a node's number does not depend on the nodes beside it.
        self.unary = np.stack([((np.arange(1 << BITS)[:, None] >> np.arange(BITS)) & 1) @ weights[:-1, k] + weights[-1, k] for k in range(5)], 1)

    def marginals(self, g: Graph) -> np.ndarray:
        label, doc = np.array(g.label), np.array(g.doc)
        unary = self.unary[np.array(g.shape, np.int64)]
        fixed = label > 0
        unary[fixed] = -40.0
        unary[fixed, label[fixed]] = 40.0
        edges = np.array(g.chain + g.skip, np.int64).reshape(-1, 2)
        n = len(edges)
        if n:
            pair = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.skip), 0)])
            source, to = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
            np.add.at(unary, to, self._messages(unary, source, to, back, pair, doc[source]))
        return np.exp(unary - _logsum(unary, 1)[:, None])

    @staticmethod
    def _messages(unary, source, to, back, pair, doc) -> np.ndarray:
        """The message of each directed edge once its document's messages rest."""
        m, live, step, rounds = np.zeros((len(source), 5)), np.arange(len(source)), STEP, 0
        while len(live):
            belief = unary.copy()
            np.add.at(belief, to, m)
            new = _logsum((belief[source[live]] - m[back[live]])[:, :, None] + pair[live], 1)
            new -= _logsum(new, 1)[:, None]
            move = step * (new - m[live])
            m[live] += move
            most = np.zeros(int(doc.max()) + 1)
            np.maximum.at(most, doc[live], np.abs(move).max(1))
            live = live[most[doc[live]] >= REST]
            rounds += 1
            step *= SHRINK if rounds > ROUNDS else 1.0
        return m

    def label(self, texts: list[str | None]) -> list[list[tuple[int, int, int, bool]]]:
        """Of each text (start, end, number of the kind, whether base), by start, then kind."""
        out, g = [], Graph()
        for i, text in enumerate(texts):
            base = base_spans(text)
            out.append([(*s, True) for s in base])
            if text and _ACTIVE.search(text):
                g.add(i, text, base)
        if g.doc:
            p = self.marginals(g)
            best = p.argmax(1)
            last, runs_on = -1, {b for a, b in g.chain if a == b - 1}
            for node in np.flatnonzero((np.array(g.label) <= 0) & (best > 0) & (p.max(1) >= SURE)).tolist():
                kind, own = int(best[node]) - 1, out[g.doc[node]]
                if last == node - 1 and node in runs_on and own[-1][2] == kind and len(_DIGITS.findall(texts[g.doc[node]], own[-1][0], g.span[node][1])) <= MOST_DIGITS[kind]:
                    own[-1] = (own[-1][0], g.span[node][1], kind, False)
                else:
                    own.append((*g.span[node], kind, False))
                last = node
        return [sorted(x, key=_order) for x in out]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for text in batch.column(0).to_pylist():
            if text and _ACTIVE.search(text):
                g = Graph()
                g.add(0, text, base_spans(text))
                seen.update(("node", a, b) for a, b in zip(g.shape, g.label, strict=True) if b != UNKNOWN)
                for what, edges in (("chain", g.chain), ("skip", g.skip)):
                    seen.update((what, x, y) for a, b in edges if (x := g.label[a]) != UNKNOWN and (y := g.label[b]) != UNKNOWN)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array([k[2] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["what", "a", "b", "n"])


def _potential(n: np.ndarray, prior: np.ndarray | float = 0.5) -> np.ndarray:
    """Pointwise mutual information of two labels, from smoothed counts."""
    p = (n + prior) / (n + prior).sum()
    return np.clip(np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))), -6, 6)


def train(node: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 400) -> Field:
    """From counts of (shape, label) and of the labels at both ends of edges."""
    weights = np.zeros((BITS + 1, 5))
    weights[-1, 0] = 4.0
    shapes = np.flatnonzero(node.sum(1))
    if len(shapes):
        x = np.concatenate([(shapes[:, None] >> np.arange(BITS)) & 1, np.ones((len(shapes), 1))], 1)
        n = node[shapes]
        total, m, v = n.sum(), np.zeros_like(weights), np.zeros_like(weights)
        for t in range(1, steps + 1):
            logit = x @ weights
            p = np.exp(logit - _logsum(logit, 1)[:, None])
            g = x.T @ (n.sum(1, keepdims=True) * p - n) / total + 1e-5 * weights
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            weights -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Field(weights, _potential(chain), _potential(skip + skip.T, np.where(np.eye(5) > 0, AGREE, DIFFER)))


def fit(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> Field:
    small_batches(spark)
    counts = docs.select(F.col(text_col)).mapInArrow(_statistics, "what string, a int, b int, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    tables = {"node": np.zeros((1 << BITS, 5)), "chain": np.zeros((5, 5)), "skip": np.zeros((5, 5))}
    for r in counts.collect():
        tables[r[0]][r[1], r[2]] += r[3]
    return train(**tables)


def find_spans(spark: SparkSession, docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, base) by start, then kind."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(field)
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.label(batch.column(1).to_pylist())
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, e, k, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(struct))], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def redact(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each span replaced by its kind; spans that overlap go together, by the kind of the first."""
    out, done = [], 0
    for s, e, k, _ in spans:
        if s >= done:
            out += [text[done:s], MASKS[KINDS[k]]]
        done = max(done, e)
    return "".join(out) + text[done:]


def mask(spark: SparkSession, docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """docs with personal data in the text replaced; n_chars, if docs has it, follows the text."""
    small_batches(spark)
    sent, at = spark.sparkContext.broadcast(field), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = sent.value.label(texts)
            new = [t if t is None or not s else redact(t, s) for t, s in zip(texts, spans, strict=True)]
            columns = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            if "n_chars" in batch.schema.names:
                k = batch.schema.names.index("n_chars")
                columns[k] = pa.array([n if t is None else len(t) for t, n in zip(new, batch.column(k).to_pylist(), strict=True)], batch.schema.types[k])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = find_spans(spark, docs, fit(spark, docs))
    text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"))
