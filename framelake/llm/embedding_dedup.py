"""Operator 3: near-duplicate embeddings by cross-polytope hashing.

A vector is normalised, turned by three rounds of random signs and a fast Hadamard transform, and hashed to the
nearest vertex of the cross-polytope (its largest coordinate and sign). A table's key joins `hashes` such
vertices; a vector also stands in the buckets that its second-nearest vertices name, one hash at a time
(multiprobe). The number of hashes follows the number of vectors so that a bucket of unrelated vectors holds
about BUCKET rows; the number of tables is the least at which simulated pairs at the threshold meet with
probability RECALL.

Equal vectors are one class with a number of ids before anything is hashed, so copies cost no comparisons: the
class is hashed once, and its links count for each of its ids. Buckets give candidates; each is verified by its
cosine in double precision. A pair that meets in several buckets counts in the one with the smallest key. A bucket
of more than BLOCK classes is cut into blocks and every pair of blocks is a group of its own, so no task holds a
bucket. Per bucket a class sends its number of links and the smallest id of its part, not its pairs. Rows find
their class by the vector's digest, those of a class of more than HOT ids in SALTS parts.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; of
vectors of different length missing components are 0; rows repeated under another id link like any others, rows
repeated under one id are one vertex: each row is returned with the links of all vectors of its id, its own id does
not count, and another id counts once for each linked pair of different vectors; a null id takes part in nothing, its component
is null and kept is false; an empty table gives none. Columns other than the two named are not read. If simulated
pairs do not reach RECALL within MOST_TABLES tables, an error is raised.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, keep, read, salted
from .components import components
from .topk_search import matrix

THRESHOLD = 0.95
BUCKET = 64
RECALL = 0.997
BLOCK = 1024
SEED = 3
MOST_TABLES = 256
HOT, SALTS = 4096, 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the number of columns is a power of 2."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class Hashing:
    def __init__(self, dims: int, hashes: int, tables: int, seed: int = SEED):
        self.width, self.hashes, self.tables = 1 << max(0, (max(dims, 1) - 1).bit_length()), hashes, tables
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, hashes, 3, self.width))

    def vertices(self, x: np.ndarray, table: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest and second-nearest vertex."""
        for s in self.signs[table, j]:
            x = hadamard(x * s)
        size, row = np.abs(x), np.arange(len(x))
        first = size.argmax(1)
        sign = lambda i: (x[row, i] > 0).astype(np.uint64)
        out = first.astype(np.uint64) * np.uint64(2) + sign(first)
        if self.width == 1:
            return out, out
        size[row, first] = -1
        second = size.argmax(1)
        return out, second.astype(np.uint64) * np.uint64(2) + sign(second)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """All bucket keys of each row, ascending: tables * (hashes + 1) of them."""
        x = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        out = []
        for t in range(self.tables):
            found = [self.vertices(x, t, j) for j in range(self.hashes)]
            for probe in range(-1, self.hashes):
                key = np.full(len(x), np.uint64(t))
                for j, (first, second) in enumerate(found):
                    key = salted(key ^ (second if j == probe else first), j + 1)
                out.append((key >> np.uint64(9)) | np.uint64(t) << np.uint64(55))
        return np.sort(np.stack(out, 1).astype(np.int64), 1)


def plan(n: int, dims: int, threshold: float = THRESHOLD, seed: int = SEED) -> Hashing:
    """Hashes a table from the number of vectors, tables from simulated pairs at the threshold."""
    width = 1 << max(0, (max(dims, 1) - 1).bit_length())
    hashes = max(1, math.ceil(math.log(max(n / BUCKET, 2)) / math.log(2 * width)))
    if dims <= 1:  # a vector is its sign, and links are between equal ones
        return Hashing(1, hashes, 1, seed)
    rng = np.random.default_rng(seed + 1)
    a = rng.standard_normal((4000, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = threshold * a + math.sqrt(1 - threshold**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = np.zeros(len(a), bool)
    for tables in range(1, MOST_TABLES + 1):
        h = Hashing(dims, hashes, tables, seed)
        one = Hashing(dims, hashes, 1, seed)
        one.signs = h.signs[-1:]
        met |= (one.keys(a)[:, :, None] == one.keys(b)[:, None, :]).any((1, 2))
        if met.mean() >= RECALL and tables >= 2:
            return h
    raise ValueError(f"recall {met.mean():.4f} with {MOST_TABLES} tables; {RECALL} is asked for")


def _clean(dims: int, kind: str):
    """Vectors as bytes of one length, null where they link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = matrix(batch.column(1))
            some = np.abs(x).max(1, initial=0) > 0
            out: list[bytes | None] = [None] * len(batch)
            for i, r in zip(good[some].tolist(), np.pad(x[some], ((0, 0), (0, dims - x.shape[1]))).astype(kind), strict=True):
                out[i] = r.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vector"])

    return run


def unit(vectors: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of huge or tiny components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash(hashing: Hashing, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys = hashing.keys(unit(batch.column(3).to_pylist(), kind))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), pa.list_(pa.int64()))], names=["id", "m", "alone", "vector", "keys"])

    return run


def links(ids: np.ndarray, m: np.ndarray, unit: np.ndarray, keys: np.ndarray, key: int, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that count in this bucket, by class, and the smallest id of each class's part of the bucket.

    m: ids of each class. side: rows of block 0 meet rows of block 1 where both are there, else all meet each other."""
    n = len(ids)
    count, part = np.zeros(n, np.int64), np.arange(n)
    order = np.argsort(ids, kind="stable")
    ids, m, unit, keys, side = ids[order], m[order], unit[order], keys[order], side[order]
    two = side.any() and not side.all()
    step = max(1, (1 << 18) // n)
    pairs = []
    for a in range(0, n, step):
        cosine = unit[a : a + step] @ unit.T
        i, j = np.nonzero(cosine >= threshold)
        i += a
        on = (i < j) & (ids[i] != ids[j])
        if two:
            on &= side[i] != side[j]
        i, j = i[on], j[on]
        for b in range(0, len(i), 1 << 14):
            p, q = i[b : b + (1 << 14)], j[b : b + (1 << 14)]
            shared = (keys[p][:, :, None] == keys[q][:, None, :]).any(2)
            first = np.where(shared, keys[p], np.iinfo(np.int64).max).min(1) == key
            pairs.append((p[first], q[first]))
    p, q = (np.concatenate([x[k] for x in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    np.add.at(count, p, m[q])
    np.add.at(count, q, m[p])
    while len(p):
        low = np.minimum(part[p], part[q])
        before = part.copy()
        np.minimum.at(part, p, low)
        np.minimum.at(part, q, low)
        part = part[part]
        if (part == before).all():
            break
    out_count, out_low = np.empty(n, np.int64), np.empty(n, ids.dtype)
    out_count[order], out_low[order] = count, ids[part]
    return out_count, out_low


def _verify(threshold: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (key, pair), so a group is a run of rows."""

        def groups():
            rest = None
            for batch in batches:
                table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
                key, pair = table["key"].to_numpy(), table["pair"].to_numpy()
                cuts = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
                for a, b in zip([0, *cuts], cuts, strict=False):
                    yield table.slice(a, b - a)
                rest = table.slice(cuts[-1] if len(cuts) else 0)
            if rest is not None and len(rest):
                yield rest

        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], names=["id", "n", "low"])

        for g in groups():
            if len(g) < 2:
                continue
            g = g.combine_chunks()
            ids = g["id"].to_numpy()
            keys = g["keys"].combine_chunks().flatten().to_numpy().reshape(len(g), -1)
            count, low = links(ids, g["m"].to_numpy(), unit(g["vector"].to_pylist(), kind), keys, g["key"][0].as_py(), g["side"].to_numpy(), threshold)
            some = count > 0
            if some.any():
                out.append((ids[some], count[some], low[some]))
                waiting += int(some.sum())
                if waiting > 20000:
                    yield flush()
                    out, waiting = [], 0
        if out:
            yield flush()

    return run


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    kind = "<f4" if dict(rows.dtypes)["v"] == "array<float>" else "<f8"
    n, dims = rows.agg(F.count("id"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dims = max(1, dims)
    hashing = plan(n, dims, threshold)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "2000")
    clean = rows.mapInArrow(_clean(dims, kind), "id long, vector binary")
    some = clean.filter("id is not null and vector is not null")
    # own: the id where it has several rows, so that it shares no class; else null.
    light = clean.select("id", F.md5("vector").alias("digest"))
    repeated = keep(spark, light.filter("id is not null").groupBy("id").count().filter("count > 1").select("id", F.col("id").alias("own")))
    if repeated.limit(1).count():
        light, some = (t.join(repeated, "id", "left") for t in (light, some))
    else:
        light, some = (t.withColumn("own", F.lit(None).cast("long")) for t in (light, some))
    light = keep(spark, light)
    groups = some.groupBy("vector", "own").agg(F.min("id").alias("id"), F.when(F.col("own").isNull(), F.count("*")).otherwise(1).alias("m"))
    groups = groups.select("id", "m", F.col("own").isNotNull().alias("alone"), "vector")
    hashed = keep(spark, groups.mapInArrow(_hash(hashing, kind), "id long, m long, alone boolean, vector binary, keys array<long>"))
    placed = hashed.select("id", F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    placed = keep(spark, placed.select("key", F.when(F.col("c") > block, F.ceil(F.col("c") / block).cast("int")).alias("s")))
    each = hashed.select("id", "m", "vector", "keys", F.explode(F.array_distinct("keys")).alias("key")).join(placed, "key")
    own = F.pmod(F.xxhash64("id", "vector"), F.col("s").cast("long")).cast("int")
    # A class in a bucket of s blocks goes to each pair of blocks that its own block is in.
    each = each.withColumn("own", F.when(F.col("s").isNull(), 0).otherwise(own))
    each = each.withColumn("other", F.explode(F.when(F.col("s").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("s") - 1))))
    pair = F.least("own", "other").cast("long") * F.coalesce("s", F.lit(1)) + F.greatest("own", "other")
    each = each.withColumn("pair", pair).withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = keep(
        spark,
        each.select("id", "m", "vector", "keys", "key", "pair", "side").repartition(parts, "key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_verify(threshold, kind), "id long, n long, low long"),
    )
    spark.conf.set(batch, before)  # what follows reads written tables
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    parted = components(spark, found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    classes = hashed.select("id", "m", _key(F.col("alone"), F.col("id"), F.md5("vector")).alias("key")).distinct()
    result = classes.join(counts, "id", "left").join(parted, "id", "left")
    result = keep(spark, result.select("key", "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "id").alias("component")))
    out = _of_rows(light.select("id", _key(F.col("own").isNotNull(), F.col("id"), F.col("digest")).alias("key")), result)
    drop(spark, repeated, hashed, placed, found)
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _key(alone: Column, id_: Column, digest: Column) -> Column:
    """What a row finds its class by: the vector's digest, or the id where it has several rows; null without either."""
    return F.when(id_.isNotNull(), F.when(alone, F.concat(F.lit("id "), id_.cast("string"))).otherwise(digest))


def _of_rows(rows: DataFrame, result: DataFrame) -> DataFrame:
    """id, n, component of each row (id, key); the rows of large classes are dealt by salt as well as by key."""
    none = rows.filter("key is null").select("id", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("component"))
    rows = rows.filter("key is not null").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    large = result.filter(F.col("m") > HOT)
    if not large.limit(1).count():
        return rows.join(result, "key", "left").select("id", "n", "component").unionByName(none)
    salted_ = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = rows.join(salted_, ["key", "salt"], "left")
    rest = met.filter("m is null").select("id", "key").join(result.filter(F.col("m") <= HOT), "key", "left").select("id", "n", "component")
    return met.filter("m is not null").select("id", "n", "component").unionByName(rest).unionByName(none)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read(spark, sf_dir, "embeddings"))
