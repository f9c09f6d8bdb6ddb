"""Operator 5: toxicity by a weighted finite-state pattern grammar.

Five small transducers read a sentence's words in order, each the output of the one before it. Negation marks the
insults and threats within its scope, the SCOPE words after a negating one in the same clause. Reported speech marks
those between quotes and those after a verb of saying, to the sentence's end. Target marks those that follow a word
for who is addressed or meant in their clause. Insult and threat keep the least excused hit of a clause and whether
a target came before or after it, and write it out at the clause's end. compose() makes one automaton of the five;
running a text is a table look-up a word. What it writes are matched clauses, and a document's score is the
logistic of the weights of theirs, each by the logarithm of its count; single words score only in their clause.

The insult transducer's entries (words and word beginnings) and the weights are learned from labelled rows, a
bounded sample of at most MAX_TRAIN documents, first by a hash of the id, never of a held-out fold. Closed-class
words (target, negation, report, threat) are fixed lists.

Defined cases: null, empty and unmatched texts score the base rate that the weights give; a quote or report that a
sentence does not close ends with it; null labels and null ids are not learned from; without labelled rows of both
kinds only threats match, with fixed weights; repeated rows are scored alike; an empty table gives none. Other
columns are not read.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

MAX_TRAIN = 12000
#: Toxic documents that an entry needs to be looked at more closely.
MIN_DOCS = 4
#: Different pairs of neighbouring words in toxic documents that an entry needs; copies of one document have the same.
MIN_CONTEXTS = 8
#: Log-odds of such contexts that an entry needs.
MIN_ODDS = 5.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
# Closed-class words in English, German, French and Spanish.
TARGET = "you your yours yourself he she him her they them their these those people du dich dir dein ihr euch sie ihn ihm tu te toi ton vous il elle lui leur tú tu usted ustedes él ella ellos ellas".split()
NEGATION = "not no never neither nor without nobody isn't aren't don't doesn't wasn't nicht kein keine nie niemals ohne ne pas jamais sans ni nunca jamás sin tampoco".split()
REPORT = "said says say told called calls wrote writes quoted reported claims claimed sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó".split()
THREAT = "kill hurt destroy murder beat burn stab shoot töten verletzen umbringen zerstören tuer blesser détruire frapper matar destruir golpear quemar".split()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = ".,;:!?\n"
SENTENCE = ".!?\n"
_SENTENCE = re.compile(rf"[{SENTENCE}]")
_TOKEN = re.compile(rf"{WORD.pattern}|[{CLAUSE}\"«»„“”]")

#: Words after a negating one that it reaches.
SCOPE = 4
SYMBOLS = ("other", "insult", "threat", "target", "negation", "report", "quote", "clause", "sentence")
ENDS = ("clause", "sentence")
#: What a clause has: no hit, or its least excused hit by (negated, reported, where its target is).
PARTS = [None, *((n, r, t) for n in (0, 1) for r in (0, 1) for t in ("none", "before", "after"))]

# A symbol is (class, marks); at a clause's end the marks are what has been matched. A transducer maps
# (state, symbol) to (next state, symbol).
Symbol = tuple[str, tuple]
Step = Callable[[object, Symbol], tuple[object, Symbol]]


def negation(state: int, symbol: Symbol) -> tuple[int, Symbol]:
    """state: words that the last negation still reaches."""
    kind, marks = symbol
    if kind in ENDS:
        return 0, symbol
    if kind == "negation":
        return SCOPE, symbol
    if kind == "quote":
        return state, symbol
    return max(0, state - 1), (kind, (*marks, "negated")) if state and kind in ("insult", "threat") else symbol


def report(state: tuple[bool, bool], symbol: Symbol) -> tuple[tuple[bool, bool], Symbol]:
    """state: whether something was said in this sentence, and whether a quote is open."""
    kind, marks = symbol
    if kind == "sentence":
        return (False, False), symbol
    if kind == "report":
        return (True, state[1]), symbol
    if kind == "quote":
        return (state[0], not state[1]), symbol
    return state, (kind, (*marks, "reported")) if any(state) and kind in ("insult", "threat") else symbol


def target(state: bool, symbol: Symbol) -> tuple[bool, Symbol]:
    """state: whether the clause has named a target."""
    kind, marks = symbol
    if kind in ENDS:
        return False, symbol
    if kind == "target":
        return True, symbol
    return state, (kind, (*marks, "aimed")) if state and kind in ("insult", "threat") else symbol


def hits(of: str) -> Step:
    """The transducer of one kind of hit. state: the place in PARTS of the clause's least excused one so far."""

    def excuse(part: tuple) -> tuple:
        return part[0] + part[1], part[2] == "none", part

    def step(state: int, symbol: Symbol) -> tuple[int, Symbol]:
        kind, marks = symbol
        if kind in ENDS:
            return 0, (kind, (*marks, state))
        best = PARTS[state]
        if kind == of:
            part = int("negated" in marks), int("reported" in marks), "before" if "aimed" in marks else "none"
            best = part if best is None else min(best, part, key=excuse)
        elif kind == "target" and best and best[2] == "none":
            best = (*best[:2], "after")
        return PARTS.index(best), symbol

    return step


def cascade(first: Step, second: Step) -> Step:
    """Composition: second reads what first writes."""

    def step(state: tuple, symbol: Symbol) -> tuple[tuple, Symbol]:
        a, between = first(state[0], symbol)
        b, out = second(state[1], between)
        return (a, b), out

    return step


def compose() -> tuple[list[list[int]], list[list[tuple[int, int] | None]]]:
    """Next state and what a clause's end writes, (insult, threat) as places in PARTS, by state and symbol of the composed transducer."""
    step, start = negation, 0
    for other, begin in ((report, (False, False)), (target, False), (hits("insult"), 0), (hits("threat"), 0)):
        step, start = cascade(step, other), (start, begin)
    number, waiting, to, emit = {start: 0}, [start], [], []
    for state in waiting:  # grows as states are found
        row, out = [], []
        for kind in SYMBOLS:
            new, (_, marks) = step(state, (kind, ()))
            if new not in number:
                number[new] = len(waiting)
                waiting.append(new)
            row.append(number[new])
            out.append(marks if kind in ENDS and any(marks) else None)
        to.append(row)
        emit.append(out)
    return to, emit


STEP, EMIT = compose()
_LAST = SYMBOLS.index("sentence")
#: Features: the base, then the parts of insults, then those of threats.
SIZE = 1 + 2 * (len(PARTS) - 1)


def untrained() -> np.ndarray:
    """Weights to go by where nothing is labelled: an insult, or a threat to a target, tells, less so if excused."""
    w = np.zeros(SIZE)
    w[0] = -3.0
    for i, (negated, reported, aim) in enumerate(PARTS[1:]):
        w[1 + i] = 1.0 if negated or reported else 4.0
        w[len(PARTS) + i] = 0.0 if aim == "none" else w[1 + i]
    return w


class Grammar:
    def __init__(self, entries: dict[str, float], weights: np.ndarray | None = None):
        """entries: a word, or a beginning with a trailing *."""
        self.entries = entries
        self.weights = untrained() if weights is None else weights
        self.words = {w for w in entries if not w.endswith("*")}
        self.starts = {w[:-1] for w in entries if w.endswith("*")}
        self.sizes = sorted({len(w) for w in self.starts})
        self.closed = {w: SYMBOLS.index(k) for k, words in (("target", TARGET), ("negation", NEGATION), ("report", REPORT), ("threat", THREAT)) for w in words}
        self._find = None

    def __getstate__(self):
        return self.__dict__ | {"_find": None}

    def symbol(self, word: str) -> int:
        if word in self.words or any(word[:n] in self.starts for n in self.sizes):
            return 1
        if len(word) == 1 and not word.isalpha():
            return 8 if word in SENTENCE else 7 if word in CLAUSE else 6
        return self.closed.get(word, 0)

    def patterns(self, text: str | None) -> Counter:
        """Of each (insult, threat) the clauses that have it. Sentences without insult or threat write nothing and are skipped."""
        out: Counter = Counter()
        if not text:
            return out
        if self._find is None:
            self._find = ahocorasick.Automaton()
            for w in self.words | self.starts | set(THREAT):
                self._find.add_word(w, len(w))
            if len(self._find):
                self._find.make_automaton()
        text = text.lower()
        cuts, done = [m.end() for m in _SENTENCE.finditer(text)], 0
        for end, size in self._find.iter(text) if len(self._find) else ():
            at = end - size + 1
            if at < done or at and text[at - 1].isalpha():
                continue
            k = bisect.bisect_right(cuts, at)
            begin, done = cuts[k - 1] if k else 0, cuts[k] if k < len(cuts) else len(text)
            state = 0
            for token in _TOKEN.findall(text, begin, done):
                symbol = self.symbol(token)
                if p := EMIT[state][symbol]:
                    out[p] += 1
                state = STEP[state][symbol]
            if p := EMIT[state][_LAST]:
                out[p] += 1
        return out

    def features(self, text: str | None) -> np.ndarray:
        """1, then by part the logarithm of one more than the clauses that have it."""
        x = np.zeros(SIZE)
        for (insult, threat), n in self.patterns(text).items():
            if insult:
                x[insult] += n
            if threat:
                x[len(PARTS) - 1 + threat] += n
        x = np.log2(1 + x)
        x[0] = 1
        return x

    def score(self, text: str | None) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.features(text) @ self.weights))))))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bad, good = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            found = set(WORD.findall((text or "").lower()))
            found |= {w[:n] + "*" for w in found for n in PREFIXES if len(w) >= n}
            (bad if label else good).update(found)
        if bad:
            yield pa.RecordBatch.from_arrays([pa.array(list(bad), pa.string()), pa.array(list(bad.values()), pa.int64()), pa.array([good[w] for w in bad], pa.int64())], names=["entry", "bad", "good"])
        if rest := [w for w in good if w not in bad]:
            yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([good[w] for w in rest], pa.int64())], names=["entry", "bad", "good"])


def _contexts(entries: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(entries)
        for batch in batches:
            seen = set()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                w = ["", *WORD.findall((text or "").lower()), ""]
                for i in range(1, len(w) - 1):
                    for e in (w[i], *[w[i][:n] + "*" for n in PREFIXES if len(w[i]) >= n]):
                        if e in known:
                            seen.add((e, label, f"{w[i - 1]} {w[i + 1]}"))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in seen], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["entry", "label", "context"])

    return run


def choose(counts: list[tuple[str, int, int]], n_bad: int, n_good: int) -> dict[str, float]:
    """Of (entry, toxic contexts, other contexts) those that tell, without what a kept beginning covers."""
    out: dict[str, float] = {}
    for entry, bad, good in sorted(counts, key=lambda x: (-x[1], len(x[0]), x[0])):
        odds = math.log((bad + 0.1) / (n_bad + 0.2)) - math.log((good + 0.1) / (n_good + 0.2))
        word = entry.rstrip("*")
        if bad >= MIN_CONTEXTS and odds >= MIN_ODDS and not any(word[:n] + "*" in out for n in PREFIXES if n <= len(word)):
            out[entry] = odds
    return out


def _fit_weights(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Logistic regression by Newton's method; x has a row for each distinct feature vector, n how often."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * p - y) + penalty * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-9:
            break
    return w


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_TRAIN) -> Grammar:
    small_batches(spark)
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("id is not null and label is not null").distinct()
    # The sample has a fixed size, so it can be broadcast.
    sample = F.broadcast(rows.orderBy(F.xxhash64("id"), "id", "label").limit(most))
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id").select("text", "label")
    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    if not n_bad or not n_good:
        return Grammar({})
    counts = train.mapInArrow(_candidates, "entry string, bad long, good long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.1) / (n_bad + 0.2)) - F.log((F.col("good") + 0.1) / (n_good + 0.2))
    # Words of the bounded sample; all of them are looked at.
    top = counts.filter(F.col("bad") >= MIN_DOCS).withColumn("odds", odds).filter(F.col("odds") >= 2.5).collect()
    contexts = train.mapInArrow(_contexts([r["entry"] for r in top]), "entry string, label long, context string").distinct().groupBy("entry")
    contexts = contexts.agg(F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") != 1).alias("good")).collect()
    grammar = Grammar(choose([(r["entry"], r["bad"], r["good"]) for r in contexts], n_bad, n_good))
    sent = spark.sparkContext.broadcast(grammar)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                seen[sent.value.features(text).tobytes(), label] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.binary()), pa.array([k[1] for k in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["x", "label", "n"])

    table = train.mapInArrow(matched, "x binary, label long, n long").groupBy("x").agg(F.sum(F.col("label") * F.col("n")).alias("y"), F.sum("n").alias("n")).orderBy("x").collect()
    if not table:
        return Grammar({})
    x = np.array([np.frombuffer(r[0]) for r in table])
    grammar.weights = _fit_weights(x, np.array([r[1] for r in table], float), np.array([r[2] for r in table], float))
    return grammar


def score(spark: SparkSession, docs: DataFrame, grammar: Grammar, text_col: str = "text", keep_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns of docs, and score (0 to 1) and predicted (0 or 1) of each whole text."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(grammar)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep_cols], F.col(f"`{text_col}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([sent.value.score(t) for t in batch.column("__text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=[*keep_cols, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "score double", "predicted int"])
    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))
    labels = read(spark, sf_dir, "labels").filter(fold != 2)
    return score(spark, docs, fit(spark, docs, labels), keep_cols=("doc_id", "held_out"))
