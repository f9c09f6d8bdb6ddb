"""Operator 1: URL filter by rules and by a character language-model ratio.

Two smoothed variable-order Markov models over the characters of a URL, one for accepted and one for rejected
URLs, are counted over every URL that a rule decides. Every context that was seen stays, so the models grow with
the input; they are one table in the shared folder, a row a context, and are never gathered. To score, rows are
dealt into chunks of about CHUNK, whatever their URLs, the contexts that a chunk needs are joined from the table, and the chunk's task
works with those alone. Longer contexts are smoothed by shorter ones (Witten-Bell).
A URL's evidence is its log-likelihood difference a character; the cut is set where held-out labelled URLs
(one in HOLD by hash) have the least balanced error.

Defined cases: a URL that is null or has no "://" has empty host and path, so no rule fits; a null or empty URL
has evidence 0; with no labelled URL of one kind evidence is 0 and the cut 0, and evidence at or above the cut
allows. Repeated rows are judged alike and counted each time. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, keep, read

#: (rule, verdict); the longest rule that fits a URL wins.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
ORDER = 4
#: URLs that are scored together.
CHUNK = 2048
HOLD = 8
BINS = 400
#: Differences beyond this many nats a character share the outermost bins.
SPAN = 4.0
END = "\x03"
BEGIN = "\x02"

_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    m = _PARTS.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class Rules:
    """Rules by host and path prefix. A lookup tries each suffix of the host and each rule-path length."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by: dict[str, list[tuple[int, str, str, str]]] = defaultdict(list)
        for rule, verdict in rules:
            host, _, path = rule.partition("/")
            self.by[host.translate(_LOWER)].append((len(rule), rule, "/" + path, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[int, str, str] | None = None
        tail = host
        while True:
            for n, rule, start, verdict in self.by.get(tail, ()):
                if path.startswith(start) and (best is None or n > best[0]):
                    best = (n, rule, verdict)
            dot = tail.find(".")
            if dot < 0:
                return (best[1], best[2]) if best else (None, None)
            tail = tail[dot + 1 :]


class Markov:
    """Witten-Bell smoothed variable-order model from counts of (context, character).

    Contexts rarer than one in `most` are left out; None keeps all."""

    def __init__(self, counts: dict[str, int], alphabet: int, order: int, most: int | None = None):
        by: dict[str, dict[str, int]] = defaultdict(dict)
        for gram, n in counts.items():
            by[gram[:-1]][gram[-1]] = n
        total = sum(by.get("", {}).values())
        least = max(1, -(-total // most)) if most else 1
        self.order, self.miss = order, math.log(1 / max(alphabet, 1))
        self.step: dict[str, tuple[float, dict[str, float]]] = {}
        for context in sorted(by, key=len):
            after = by[context]
            n = sum(after.values())
            if context and (n < least or context[1:] not in self.step):
                continue
            back = len(after) / (n + len(after))
            self.step[context] = (math.log(back), {c: math.log(k / (n + len(after)) + back * math.exp(self.logp(context[1:], c) if context else self.miss)) for c, k in after.items()})

    def logp(self, context: str, c: str) -> float:
        total = 0.0
        while True:
            found = self.step.get(context)
            if found:
                if c in found[1]:
                    return total + found[1][c]
                total += found[0]
            if not context:
                return total + self.miss
            context = context[1:]

    def of(self, text: str) -> float:
        total, step, order = 0.0, self.step, self.order
        padded = BEGIN + text + END
        for i in range(1, len(padded)):
            context, c = padded[max(0, i - order) : i], padded[i]
            while context and context not in step:
                context = context[1:]
            total += self.logp(context, c)
        return total


def _held(url: str) -> bool:
    h = 2166136261
    for b in url.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h >> 16) % HOLD == 0


def _count(rules: Sequence[tuple[str, str]], order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Rules(rules)
        for batch in batches:
            seen = {"allow": Counter(), "block": Counter()}
            for url, n in Counter(batch.column(0).to_pylist()).items():
                verdict = known.find(*split_url(url))[1]
                if verdict is None or not url or _held(url):
                    continue
                text, counts = BEGIN + url.translate(_LOWER) + END, seen[verdict]
                for i in range(1, len(text)):
                    for k in range(min(order, i) + 1):
                        counts[text[i - k : i + 1]] += n
            for verdict, counts in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([verdict] * len(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "verdict", "n"])

    return run


class Judge:
    """Rules, the cut, and the table of both models: each context with how often characters followed it in accepted and rejected URLs."""

    def __init__(self, rules, contexts: DataFrame | None, alphabet: int, order: int, cut: float = 0.0):
        self.rules, self.contexts, self.alphabet, self.order, self.cut = rules, contexts, alphabet, order, cut


def _decided(rules: Sequence[tuple[str, str]]):
    """Held-out URLs that a rule decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Rules(rules)
        for batch in batches:
            yield batch.filter(pa.array([bool(u) and _held(u) and known.find(*split_url(u))[1] is not None for u in batch.column(1).to_pylist()], pa.bool_()))

    return run


def _contexts(order: int):
    """The contexts that the URLs of each chunk meet, and all their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met: dict[int, set[str]] = defaultdict(set)
            for url, chunk in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if url:
                    text = BEGIN + url.translate(_LOWER) + END
                    met[chunk].update([text[max(0, i - order) : i] for i in range(1, len(text))])
            for chunk, longest in met.items():
                every = list({c[k:] for c in longest for k in range(len(c) + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(every), pa.int64()), pa.array(every, pa.string())], names=["chunk", "context"])

    return run


def _scored(pages: DataFrame, judge: Judge) -> DataFrame:
    """page_id, host, path, rule, verdict (null where no rule fits) and evidence of each row of page_id, url."""
    rules, alphabet, order = judge.rules, judge.alphabet, judge.order

    def rows(ids: pa.Array, urls: list[str | None], evidence: list[float]) -> list[pa.Array]:
        known = Rules(rules)
        parts = [split_url(u) for u in urls]
        found = [known.find(*p) for p in parts]
        return [ids, pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array(evidence, pa.float64())]

    names = ["page_id", "host", "path", "rule", "verdict", "evidence"]
    schema = "page_id long, host string, path string, rule string, verdict string, evidence double"
    if judge.contexts is None:

        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(rows(batch.column(0), batch.column(1).to_pylist(), [0.0] * len(batch)), names=names)

        return pages.mapInArrow(plain, schema)

    def run(own: pa.Table, near: pa.Table) -> pa.Table:
        allow, block = {}, {}
        for context, after in zip(near.column("context").to_pylist(), near.column("after").to_pylist(), strict=True):
            for x in after:
                if x["allow"]:
                    allow[context + x["c"]] = x["allow"]
                if x["block"]:
                    block[context + x["c"]] = x["block"]
        accepted, rejected = Markov(allow, alphabet, order), Markov(block, alphabet, order)
        urls = own.column("url").to_pylist()
        low = [(u or "").translate(_LOWER) for u in urls]
        evidence = [(accepted.of(u) - rejected.of(u)) / (len(u) + 1) if u else 0.0 for u in low]
        return pa.Table.from_arrays(rows(own.column("page_id"), urls, evidence), names=names)

    # A row's number is in its chunk's hash, so rows alike are spread as all others; written, so that both readers see the same chunks.
    spark = pages.sparkSession
    chunks = F.lit(pages.count() // CHUNK + 1)
    # A chunk is little data and much work: partitions by number, not by size.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = keep(spark, pages.withColumn("chunk", F.pmod(F.xxhash64("page_id", "url", F.monotonically_increasing_id()), chunks))).repartition(parts, "chunk")
    met = dealt.mapInArrow(_contexts(order), "chunk long, context string").distinct()
    near = met.join(judge.contexts, "context").select("chunk", "context", "after")
    return dealt.groupBy("chunk").cogroup(near.groupBy("chunk")).applyInArrow(run, schema)


def fit(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = ORDER) -> Judge:
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    seen = pages.select("url").mapInArrow(_count(rules, order), "gram string, verdict string, n long")
    count = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0)).alias(v)
    grams = seen.groupBy("gram").agg(count("allow"), count("block"))
    after = F.struct(F.expr("right(gram, 1)").alias("c"), "allow", "block")
    contexts = keep(spark, grams.groupBy(F.expr("left(gram, length(gram) - 1)").alias("context")).agg(F.collect_list(after).alias("after")))
    letters = contexts.filter("context = ''").select(F.inline("after")).agg(F.count("*"), F.sum("allow"), F.sum("block")).first()
    if not (letters[1] and letters[2]):
        drop(spark, contexts)
        return Judge(rules, None, 0, order)
    judge = Judge(rules, contexts, letters[0] + 1, order)
    bins = F.least(F.greatest(((F.col("evidence") + SPAN) * (BINS / (2 * SPAN))).cast("int"), F.lit(0)), F.lit(BINS - 1))
    table = np.zeros((2, BINS))
    for r in _scored(pages.mapInArrow(_decided(rules), pages.schema), judge).groupBy("verdict", bins.alias("bin")).count().collect():
        table[int(r[0] == "allow"), r[1]] += r[2]
    if table.sum(1).all():
        share = table / table.sum(1, keepdims=True)
        # error of a cut at the lower edge of each bin: accepted below it, rejected at or above it
        wrong = np.concatenate([[0], np.cumsum(share[1])]) + 1 - np.concatenate([[0], np.cumsum(share[0])])
        edges = np.linspace(-SPAN, SPAN, BINS + 1)
        best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
        judge.cut = float(edges[best[np.argmin(np.abs(edges[best]))]])
    return judge


def judge_urls(spark: SparkSession, pages: DataFrame, judge: Judge, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, evidence (nats a character), cut: a row for each page."""
    rows = _scored(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")), judge)
    learned = F.when(F.col("evidence") >= judge.cut, "allow").otherwise("block")
    return rows.withColumn("verdict", F.coalesce("verdict", learned)).withColumn("cut", F.lit(float(judge.cut)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judge_urls(spark, pages, fit(spark, pages))
