"""Operator 7: language by rank-order profiles.

Each language has the ranks of its TOP most frequent letter n-grams (one to three letters, words padded by a
blank); a document has the ranks of its own. The out-of-place distance sums the rank differences, an n-gram
that a profile lacks counting TOP; the nearest profile names the language.

Profiles are fitted on a bounded sample: of each language at most `per_lang` documents (800), those first by a
hash of the id, never of a held-out fold. A bound on the hash from the language's number of ids comes first, so
that what is ranked has the sample's size, however many documents the language has. What is scored are whole
texts of all rows.

keep_identified() rejects a text that no learned language explains: one that scores less than the cut of its
nearest language, CUT_SHARE of what all but CUT_QUANTILE of that language's sample score.

Defined cases: a null text, or one without letters, is `und` with score 0; a null lang is not learned from;
with nothing to learn from every text is `und`; equal distances go to the language first in code-point order;
n-grams of equal count rank by a fixed hash; a null id counts as held out; repeated rows are scored alike.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, drop, keep, read, small_batches, utf8

TOP = 300
#: Less than 1000, so that Spark limits each group before it shuffles.
PER_LANG = 800
#: How many times per_lang ids the bound on the hash is to leave, give or take.
BOUND = 1.5
CUT_QUANTILE, CUT_SHARE = 0.005, 0.7
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_table: list[np.ndarray] = []


def _letter(cp: int) -> int:
    c = chr(cp)
    return ord(low) if c.isalpha() and len(low := c.lower()) == 1 else cp if c.isalpha() else 0


def letters(points: np.ndarray) -> np.ndarray:
    """Lower-cased letters, 0 for all else."""
    if not _table:
        _table.append(np.array([_letter(i) for i in range(1 << 16)], np.uint32))
    out = _table[0][np.minimum(points, 0xFFFF)]
    for cp in np.unique(points[points > 0xFFFF]):
        out[points == cp] = _letter(int(cp))
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text as (text << 40 | hash), sorted, and their counts; and letters per text."""
    n = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    whole = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    doc = np.repeat(np.arange(n), np.diff(whole))
    text = np.zeros(len(points) + n + 1, np.uint32)
    text[np.arange(len(points)) + doc + 1] = letters(points)
    of = np.zeros(len(text), np.int64)
    of[np.arange(len(points)) + doc + 1] = doc
    of[whole[:-1] + np.arange(n)] = np.arange(n)
    of[-1] = n - 1
    stay = text != 0
    stay[0] = True
    stay[1:] |= text[:-1] != 0
    text, of = text[stay].astype(np.uint64), of[stay]
    letter = text != 0
    # A blank after a text's last letter may be the next text's first position; n-grams belong to the text of a letter in them.
    c1, c2, c3 = text[:-2], text[1:-1], text[2:]
    l2 = letter[1:-1]
    parts = []
    with np.errstate(over="ignore"):
        keep = letter
        parts.append((of[keep], text[keep] | np.uint64(1 << 62)))
        if len(text) > 1:
            b1, b2, m1, m2 = text[:-1], text[1:], letter[:-1], letter[1:]
            keep = m1 | m2
            parts.append((np.where(m1, of[:-1], of[1:])[keep], (b1 << np.uint64(21) | b2 | np.uint64(2 << 62))[keep]))
        if len(text) > 2:
            keep = l2
            parts.append((of[1:-1][keep], ((c1 << np.uint64(42)) ^ (c2 << np.uint64(21)) ^ c3 ^ np.uint64(3 << 62))[keep]))
        keys = np.concatenate([d.astype(np.uint64) << np.uint64(40) | (code * _GOLD) >> np.uint64(24) for d, code in parts])
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.append(at, len(keys))), np.bincount(of[letter], minlength=n)


def ranked(keys: np.ndarray, counts: np.ndarray, n: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's most frequent n-grams: text, hash, rank from 0."""
    doc = (keys >> np.uint64(40)).astype(np.int64)
    often = np.bincount(doc[counts > 1], minlength=n)
    stay = (counts > 1) | (often[doc] < top)
    keys, counts, doc = keys[stay], counts[stay], doc[stay]
    order = np.argsort((doc << 24 | (0xFFFFFF - np.minimum(counts, 0xFFFFFF))), kind="stable")
    doc = doc[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    first = rank < top
    return doc[first], (keys[order][first] & np.uint64((1 << 40) - 1)), rank[first]


class Profiles:
    def __init__(self, ranks: dict[str, list[int]], top: int, least: dict[str, float] | None = None):
        """least: by language the score under which a text is not in it."""
        self.langs, self.top, self.least = sorted(ranks), top, least or {}
        self.known = np.array(sorted({h for v in ranks.values() for h in v}), np.uint64)
        self.table = np.full((len(self.known) + 1, len(self.langs)), top, np.int32)
        for j, lang in enumerate(self.langs):
            self.table[np.searchsorted(self.known, np.array(ranks[lang], np.uint64)), j] = np.arange(len(ranks[lang]))

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        keys, counts, seen = grams(data, offsets)
        out, score = ["und"] * n, np.zeros(n)
        if not self.langs or not len(keys):
            return out, score
        doc, h, rank = ranked(keys, counts, n, self.top)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        at[self.known[at] != h] = len(self.known)
        place = self.table[at]
        away = np.where(place < self.top, np.abs(place - rank[:, None]), self.top)
        distance = np.stack([np.bincount(doc, away[:, j], n) for j in range(len(self.langs))], 1)
        size = np.bincount(doc, minlength=n)
        best = distance.argmin(1)
        for i in np.flatnonzero(seen > 0):
            out[i] = self.langs[best[i]]
            score[i] = 1 - distance[i, best[i]] / (self.top * size[i])
        return out, score


    def judged(self, texts: pa.Array) -> Iterator[tuple[list[str], np.ndarray]]:
        """judge() over texts in order, some at a time."""
        data, offsets = utf8(texts)
        for a, b in chunks(offsets):
            yield self.judge(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def fold(id_col: Column, of: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % of


def fit(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = TOP, per_lang: int = PER_LANG) -> Profiles:
    small_batches(spark)
    part = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).filter("lang is not null and id is not null").withColumn("part", part)
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("id", 0.02).alias("ids"))
    # A row a language, of which the profiles hold `top` numbers each anyway; joined where the rows are.
    near = rows.join(F.broadcast(sizes), "lang").filter(F.col("part") * F.col("ids") <= BOUND * per_lang)
    order = Window.partitionBy("lang").orderBy("part", "id")
    # At most per_lang ids of each language.
    ids = near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_lang).select("id", "lang").distinct()
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(ids), ["id", "lang"], "left_semi")
    sample = keep(spark, sample.select("lang", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                data, offsets = utf8(batch.column("text").filter(pa.array([x == lang for x in langs])))
                for a, b in chunks(offsets):
                    keys, counts, _ = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    h, back = np.unique(keys & np.uint64((1 << 40) - 1), return_inverse=True)
                    n = np.bincount(back, counts, len(h)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranks: dict[str, list[int]] = {}
    for r in counts.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= top).select("lang", "gram", "k").orderBy("lang", "k").collect():
        ranks.setdefault(r[0], []).append(r[1])
    profiles = Profiles(ranks, top)
    sent = spark.sparkContext.broadcast(profiles)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = 0
            for langs, scores in sent.value.judged(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, len(langs)), pa.array(langs, pa.string()), pa.array(scores)], names=["lang", "told", "score"])
                a += len(langs)

    scores: dict[str, list[float]] = {}
    for lang, score in sample.mapInArrow(told, "lang string, told string, score double").filter("lang = told").select("lang", "score").collect():
        scores.setdefault(lang, []).append(score)
    profiles.least = {lang: CUT_SHARE * sorted(x)[int(CUT_QUANTILE * len(x))] for lang, x in scores.items()}
    drop(spark, sample)
    return profiles


def identify(spark: SparkSession, docs: DataFrame, profiles: Profiles, text_col: str = "text", keep_cols: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The named columns of docs, and the language and score of each whole text."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast(profiles)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep_cols], F.col(f"`{text_col}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for lang, score in sent.value.judged(batch.column("__text")):
                langs += lang
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*keep_cols, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"`{names[0]}` string", f"`{names[1]}` double"])
    return rows.mapInArrow(run, schema)


def keep_identified(spark: SparkSession, docs: DataFrame, profiles: Profiles, least: float | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without texts that are `und` or score less than their language's cut (`least`, if given); a null lang becomes the one identified.

    With no profile to compare with, only texts without letters go and lang stays."""
    small_batches(spark)
    if not profiles.langs:
        return docs.filter(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    sent, at, lang_at = spark.sparkContext.broadcast(profiles), docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], [np.zeros(0)]
            for lang, score in sent.value.judged(batch.column(at)):
                langs += lang
                scores.append(score)
            cut = np.array([np.inf if x == "und" else sent.value.least.get(x, 0.0) if least is None else least for x in langs], float)
            stay = np.concatenate(scores) >= cut
            filled = [x if x is not None else y for x, y in zip(batch.column(lang_at).to_pylist(), langs, strict=True)]
            columns = [pa.array(filled, batch.schema.types[i]) if i == lang_at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(stay))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True)))
    return identify(spark, docs, fit(spark, docs.filter("not held_out")), keep_cols=("doc_id", "held_out"))
