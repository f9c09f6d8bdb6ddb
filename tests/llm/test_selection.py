"""Exact deduplication and importance resampling: the filter, hot groups, edge cases, drawn rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from framelake.llm import exact_dedup, importance

TEXTS = [None, "", "a", "A", "long " * 20000, "é", "é", " a", "a ", "日本語", "same", "same"]
SCHEMA = "doc_id long, text string, sha string, row string, kept boolean, size int, bucket int, score double, rank string, `odd name` string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "s", "r", False, 1, 2, 3.0, "k", "o") for r in rows], SCHEMA)


def _copies(rows):
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    return by


def test_exact_edges(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, "no id"), (3, "A"), (3, "A"), (None, "a")]
    docs, by = _docs(spark, rows), _copies(rows)
    for most in (exact_dedup.FILTER_BITS, exact_dedup.BLOCK):
        got = exact_dedup.mark(spark, docs, most=most).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
        sizes = {hashlib.sha256(t.encode()).hexdigest(): (len(v), max((i for i in v if i is not None), default=None)) for t, v in by.items()}
        assert all((r.group_size, r.keep_id) == sizes[r.text_sha256] for r in got)
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter(dict.fromkeys(sizes, 1))
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
        one = exact_dedup.keep_one(spark, docs, most=most)
        assert one.columns == docs.columns
        assert sorted((r.text or "", str(r.doc_id)) for r in one.collect()) == sorted((t, str(max((i for i in v if i is not None), default=None))) for t, v in by.items())
    empty = docs.limit(0)
    assert exact_dedup.mark(spark, empty).collect() == [] and exact_dedup.keep_one(spark, empty).collect() == []


def test_exact_hot_groups_and_filter(spark):
    """A third of all rows alike, many small groups, most rows alone: all groups whole, and few single rows are shuffled."""
    rng = random.Random(5)
    rows = [(i, "hot") for i in range(4000)] + [(10000 + i, f"pair {i // 2}") for i in range(2000)] + [(20000 + i, f"one {rng.random()}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = exact_dedup.mark(spark, docs).collect()
    by = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in _copies(rows).items()}
    assert len(got) == len(rows) and all(r.group_size == len(by[r.text_sha256]) and r.keep_id == max(by[r.text_sha256]) and r.kept == (r.doc_id == r.keep_id) for r in got)
    hashes = docs.select("doc_id", exact_dedup.sha256(F.col("text")).alias("sha"))
    tested = exact_dedup.maybe_repeated(hashes, exact_dedup.repeated_bits(hashes, len(rows)), len(rows))
    maybe = {r.doc_id for r in tested.filter("maybe").collect()}
    assert maybe >= {i for i, t in rows if not t.startswith("one")}
    assert len([i for i in maybe if i >= 20000]) < 0.03 * 6000


def test_exact_is_native(spark):
    plan = exact_dedup.query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def _loops(docs, target, percent=25, least=20):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = "".join(c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c >= "\x80" else " " for c in low).split(" ")
        w = [x for x in w if x]
        return len(w), [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    count = lambda texts: Counter(b for t in texts for b in features(t)[1])
    s, t = count(x for _, x in docs), count(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for i, text in docs:
        n, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    order = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], -1 if x[0] is None else x[0]))
    ranks = {id(x): k + 1 for k, x in enumerate(order[: percent * len(order) // 100])}
    return [(*x[:4], ranks.get(id(x))) for x in out]


def test_importance_against_loops(spark):
    rng = random.Random(3)
    pool = "cat dog Ünï 12 a-b x_y {z| The END, мир. 日本".split()
    docs = [(i, " ".join(rng.choices(pool, k=rng.randrange(1, 60)))) for i in range(300)] + [(900, None), (901, ""), (902, "!?"), (None, "w " * 40), (903, "long " * 30000)]
    target = ["cat dog cat", None, "", "мир cat"]
    table = _docs(spark, docs).repartition(3)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    want = _loops(docs, target)
    got = [tuple(r) for r in importance.ranked(spark, table, aim).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    drawn = importance.resample(spark, table, aim)
    assert drawn.columns == table.columns
    assert sorted(str(r.doc_id) for r in drawn.collect()) == sorted(str(w[0]) for w in want if w[4])


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "few words only")]])
def test_importance_draws_none(spark, rows):
    docs, aim = _docs(spark, rows), spark.createDataFrame([], "text string")
    got = importance.ranked(spark, docs, aim).collect()
    assert len(got) == len(rows) and all(r["rank"] is None for r in got)
    assert importance.resample(spark, docs, aim).collect() == []


def test_importance_ties_and_repeats(spark):
    """Repeated rows, a third of all under one id: each has a rank of its own, equal scores go by id."""
    docs = spark.createDataFrame([(5, "alike " * 30)] * 300 + [(i, f"w{i} " * 30) for i in range(600)], "doc_id long, text string").repartition(4)
    got = importance.ranked(spark, docs, spark.createDataFrame([("alike alike",)], "text string")).filter("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 226))
    assert all((a.score, -a.doc_id) >= (b.score, -b.doc_id) for a, b in zip(got, got[1:]))


def test_scoring_does_not_explode_or_shuffle(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = importance.scored(docs, [0] * importance.BUCKETS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Python" not in plan
