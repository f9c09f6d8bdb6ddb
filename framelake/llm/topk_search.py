"""Operator 9: exact top-k by integer inner product, columnar branch-and-bound.

Components become floor(256 x). Vectors are packed into blocks in vertical layout (one run of values a dimension).
Blocks of candidates stay where they are; blocks of queries, of at most about ROUND_BYTES together, are sent to all
of them, round after round. A task keeps the k best of each query from block to block. Within a block, scores grow
by SLICE dimensions at a time; after each slice candidates are compacted to those whose score so far plus the most
that the remaining dimensions can add (Cauchy-Schwarz on the remaining mass) reaches the query's k-th best so far,
or the k-th best least score of the block. A query whose whole mass can't reach it leaves the block out.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither as query nor
as candidate; an empty vector scores 0 with all; of vectors of different length the missing components are 0;
a query's own id is never its candidate, rows repeated under another id are; rows repeated under one id count
as so many candidates, and as one query if their vectors are equal, else each has results of its own; ties go to
the smaller id; fewer than k candidates give fewer rows; an empty table gives none. Rows with a null id take no
part. Scores beyond 63 bits raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, keep, read

K = 5
BLOCK, QUERY_BLOCK = 4096, 512
SLICE = 16
#: Bytes of query blocks that are broadcast at a time, about.
ROUND_BYTES = 32 << 20
#: Once so small a share of a block's pairs is left, pairs go on one by one.
SPARSE = 0.125
NONE = -(1 << 63) + 1


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are whole, and those as a matrix of doubles, shorter ones filled up with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    good = np.asarray(column.is_valid())
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    out = np.zeros((n, int(sizes.max()) if n else 0))
    row = np.repeat(np.arange(n), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1] if n else np.zeros(0, np.int64)
    out[row, np.arange(len(row)) - first[row]] = values
    good = good & np.isfinite(out).all(1)
    return np.flatnonzero(good), out[good]


def _pack(scale: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            parts, n = [], 0
            for batch in batches:
                good, x = matrix(batch.column(2))
                ids, tags = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False))[good] for i in (0, 1))
                x = np.floor(x * scale)
                while len(ids):
                    parts.append((ids[: block - n], tags[: block - n], x[: block - n]))
                    ids, tags, x = ids[block - n :], tags[block - n :], x[block - n :]
                    n += len(parts[-1][0])
                    if n == block:
                        yield parts
                        parts, n = [], 0
            if n:
                yield parts

        for parts in blocks():
            dims = max(p[2].shape[1] for p in parts)
            x = np.concatenate([np.pad(p[2], ((0, 0), (0, dims - p[2].shape[1]))) for p in parts])
            kind = np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.float64
            ids, tags = (np.concatenate([p[i] for p in parts]).astype(np.int64).tobytes() for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([tags], pa.binary()), pa.array([np.ascontiguousarray(x.T.astype(kind)).tobytes()], pa.binary()), pa.array([dims], pa.int32())], names=["ids", "tags", "columns", "dims"])

    return run


def _unpack(ids: bytes, columns: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    kind = np.int16 if len(columns) == 2 * dims * len(own) else np.float64
    return own, np.frombuffer(columns, kind).reshape(dims, len(own)).astype(np.float64)


def masses(x: np.ndarray) -> np.ndarray:
    """The norm of what each column has from the start of each slice on; the last row is 0."""
    squares = np.add.reduceat(x**2, np.arange(0, len(x), SLICE)) if len(x) else np.zeros((0, x.shape[1]))
    return np.sqrt(np.concatenate([np.cumsum(squares[::-1], 0)[::-1], np.zeros((1, x.shape[1]))])) * (1 + 1e-9)


class Best:
    """The k best candidates so far of a block of queries. Values are whole numbers in doubles, q and c vertical."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int):
        self.qid, self.q, self.k, self.mass = qid, q, k, masses(q)
        self.score, self.id = np.full((len(qid), k), NONE, np.int64), np.zeros((len(qid), k), np.int64)

    def meet(self, cid: np.ndarray, c: np.ndarray) -> None:
        mass = masses(c)
        if not len(cid) or not len(self.qid):
            return
        if self.mass[0].max() * mass[0].max() >= 2.0**52:
            self._add(*self._big(cid, c))
            return
        i, j, s = self._bounded(cid, c, mass)
        self._add(i, cid[j], s.astype(np.int64))

    def _big(self, cid, c):
        """All pairs in Python's integers."""
        n = min(len(self.q), len(c))
        whole = lambda x: np.array([[int(v) for v in row] for row in x[:n]], object).reshape(n, x.shape[1])
        i, j = np.nonzero(self.qid[:, None] != cid[None, :])
        s = (whole(self.q).T @ whole(c))[i, j] if n else np.zeros(len(i), object)
        if any(abs(x) >= 1 << 63 for x in s):
            raise OverflowError("a score needs more than 64 bits")
        return i, cid[j], s.astype(np.int64)

    def _bounded(self, cid, c, mass):
        """Query, candidate (places) and score of the pairs that may be among the k best."""
        dims = min(len(self.q), len(c))
        least = np.where(self.score[:, -1] == NONE, -np.inf, self.score[:, -1] - 0.5)
        rows = np.flatnonzero(self.mass[0] * mass[0].max() >= least)
        if not len(rows):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0)
        least, cols = least[rows], np.arange(len(cid))
        own = self.qid[rows][:, None] == cid[None, :]
        score = np.where(own, -np.inf, 0.0)
        stay = score >= least[:, None]
        for at in range(0, dims, SLICE):
            to = min(at + SLICE, dims)
            score += self.q[at:to, rows].T @ c[at:to, cols]
            t = at // SLICE + 1
            slack = self.mass[min(t, len(self.mass) - 1), rows][:, None] * mass[min(t, len(mass) - 1), cols][None, :]
            now = least.copy()
            new = np.flatnonzero(least == -np.inf)
            if len(new) and len(cols) > self.k:  # nothing carried yet: the block's own k-th best least score
                now[new] = np.partition(score[new] - slack[new], len(cols) - self.k, 1)[:, len(cols) - self.k] - 0.5
            stay = score + slack >= now[:, None]
            if to < dims and stay.sum() < SPARSE * stay.size:
                i, j = np.nonzero(stay)
                return self._pairs(rows, cols, c, mass, now, i, j, score[i, j], to, dims)
            alive = stay.any(0)
            if to < dims and alive.sum() < 0.75 * len(alive):
                cols, score = cols[alive], score[:, alive]
        i, j = np.nonzero(stay & (score > -np.inf))
        return rows[i], cols[j], score[i, j]

    def _pairs(self, rows, cols, c, mass, least, i, j, s, at, dims):
        for at in range(at, dims, SLICE):
            to = min(at + SLICE, dims)
            for a in range(0, len(i), 1 << 16):
                b = a + (1 << 16)
                s[a:b] += (self.q[at:to, rows[i[a:b]]] * c[at:to, cols[j[a:b]]]).sum(0)
            t = at // SLICE + 1
            stay = s + self.mass[min(t, len(self.mass) - 1), rows[i]] * mass[min(t, len(mass) - 1), cols[j]] >= least[i]
            i, j, s = i[stay], j[stay], s[stay]
        on = s > -np.inf
        return rows[i[on]], cols[j[on]], s[on]

    def _add(self, i: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        some = np.unique(i)
        if not len(some):
            return
        have = self.score[some] != NONE
        row = np.concatenate([np.repeat(some, self.k).reshape(have.shape)[have], i])
        s, ids = np.concatenate([self.score[some][have], s]), np.concatenate([self.id[some][have], ids])
        order = np.lexsort((ids, -s, row))
        row, s, ids = row[order], s[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        on = place < self.k
        self.score[row[on], place[on]], self.id[row[on], place[on]] = s[on], ids[on]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, candidate, score; a query's best first."""
        i, r = np.nonzero(self.score != NONE)
        return i, self.id[i, r], self.score[i, r]


def best(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best candidates: query, candidate, score. q and c are vertical: a row for each dimension."""
    b = Best(qid, q, k)
    b.meet(cid, c)
    i, ids, s = b.rows()
    return qid[i].astype(np.int64), ids, s


def _meet(k: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All blocks of a partition, one after the other, against all query blocks of the round."""
        asked = None
        for batch in batches:
            if asked is None:
                asked = [(Best(*_unpack(ids, columns, dims), k), np.frombuffer(tags, np.int64)) for ids, tags, columns, dims in sent.value]
            for r in batch.to_pylist():
                block = _unpack(r["ids"], r["columns"], r["dims"])
                for b, _ in asked:
                    b.meet(*block)
        for b, tags in asked or ():
            i, ids, s = b.rows()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (b.qid[i], tags[i], ids, s)], names=["query_id", "tag", "vec_id", "score"])

    return run


def search(
    spark: SparkSession, queries: DataFrame, candidates: DataFrame, k: int = K, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, round_bytes: int = ROUND_BYTES
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    rows = lambda t: t.select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("tag"), F.col(vector_col).alias("v")).filter("id is not null")
    schema = "ids binary, tags binary, columns binary, dims int"
    found = None
    try:
        spark.conf.set(batch, str(block))
        table = keep(spark, rows(candidates).mapInArrow(_pack(scale, block), schema))
        # One id with one vector is one query; its tag tells the vectors of one id apart.
        each = rows(queries).withColumn("tag", F.xxhash64("v")).dropDuplicates(["id", "tag"])
        asked = keep(spark, each.mapInArrow(_pack(scale, QUERY_BLOCK), schema))
        size = asked.agg(F.sum(F.length("columns") + F.length("ids") + F.length("tags"))).first()[0] or 0
        rounds = math.ceil(size / round_bytes)
        spark.conf.set(batch, "4")  # a row is a block
        for r in range(rounds):
            sent = spark.sparkContext.broadcast([tuple(x) for x in asked.filter(F.pmod(F.xxhash64("ids"), F.lit(rounds)) == r).collect()])
            found = keep(spark, table.mapInArrow(_meet(k, sent), "query_id long, tag long, vec_id long, score long"), found)
            sent.destroy()
        drop(spark, table, asked)
    finally:
        spark.conf.set(batch, before)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    return search(spark, table.filter("vec_id % 50 = 0"), table)


SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
