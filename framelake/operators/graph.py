"""Graphs: connected components, similarity links, face clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.numbering import numbered
from framelake.session import drop, keep

#: Vectors of a block, and bytes of the blocks that a task holds of each of two sides.
BLOCK, STRIPE = 2048, 64_000_000


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): a row for each end of the edges (a, b).

    Each round a node takes the least label around it, then its label's label; rounds are written out."""
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    label = kept = keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")))
    while True:
        around = both.join(label.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        near = label.join(around, "a").select("a", "c", F.least("c", "m").alias("n"))
        up = label.select(F.col("a").alias("n"), F.col("c").alias("u"))
        new = keep(near.join(up, "n", "left").select("a", F.col("c").alias("old"), F.least("n", F.coalesce("u", "n")).alias("c")))
        drop(kept)
        kept = new
        if not new.filter("c <> old").limit(1).count():
            drop(both)
            return new.select(F.col("a").alias("node"), F.col("c").alias("component"))
        label = new.select("a", "c")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            x = np.array(part.column(1).to_pylist(), np.float64)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
            ids = np.asarray(part.column(0).to_numpy(zero_copy_only=False), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int(ids.min())]), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["at", "ids", "x"])


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of nodes after the links (i, j), and which of the links to keep, so that what they connect stays connected; each joins two labels."""
    n, kept = len(label), np.zeros(len(i), bool)
    open_ = np.flatnonzero(label[i] != label[j])
    while len(open_):
        a, b = label[i[open_]], label[j[open_]]
        # Each part takes its link to the least other part; a link between two parts joins them.
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], np.diff(high[order]) != 0])]
        kept[open_[first]] = True
        label_of = np.arange(n)
        label_of[high[first]] = low[first]
        while not (label_of[label_of] == label_of).all():
            label_of = label_of[label_of]
        label = label_of[label]
        open_ = open_[label[i[open_]] != label[j[open_]]]
    return label, kept


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Which of the links (i, j) between n nodes to keep, so that what they connect stays connected: at most n - 1."""
    return _joined(np.arange(n), i, j)[1]


def similar(vectors: DataFrame, least: float, id_col: str, vector_col: str, forest: bool = False) -> DataFrame:
    """Pairs a < b of vectors with a cosine of at least `least`, block by block; with `forest`, of two stripes only so many as keep
    connected what is (fewer than they have vectors).

    A row of the block table holds thousands of vectors. Blocks are dealt into stripes of at most STRIPE bytes, and a task meets all
    blocks of two stripes: it reads no more than those, and a block is moved once a stripe, not once a block."""
    spark = vectors.sparkSession
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, str(BLOCK))
    table = keep(vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).dropna().mapInArrow(_blocks, "at long, ids binary, x binary"))
    spark.conf.set(batch, before)
    blocks, size = table.agg(F.count("*"), F.coalesce(F.sum(F.length("x")), F.lit(0))).first()
    # At least two tasks a core, where there are so many blocks.
    stripes = max(1, min(blocks, max(math.ceil(size / STRIPE), math.ceil(2 * spark.sparkContext.defaultParallelism**0.5))))
    dealt = numbered(table, ["at"], "n", 0).withColumn("own", (F.col("n") % stripes).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    low, high = F.least("own", "other").cast("long"), F.greatest("own", "other").cast("long")
    # Pairs of stripes, low <= high, by number: a task each.
    dealt = dealt.select((high * (high + 1) / 2 + low).cast("int").alias("pair"), (F.col("own") > F.col("other")).alias("right"), (low == high).alias("same"), "n", "ids", "x")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, label = [], np.zeros(0, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                b, y, right = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["x"]), r["right"]
                at, label = len(label), np.concatenate([label, np.arange(len(label), len(label) + len(b))])
                mine = (b, y.reshape(len(b), -1), at)
                if not right:
                    left.append(mine)
                # The left stripe meets the right one; a stripe that meets itself, each block with those up to it.
                for a, x, start in left if right or r["same"] else []:
                    cos = x @ mine[1].T
                    i, j = np.nonzero(cos >= least)
                    on = a[i] < b[j] if start == at else a[i] != b[j]
                    i, j = i[on], j[on]
                    if forest:
                        label, some = _joined(label, i + start, j + at)
                        i, j = i[some], j[some]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j])), pa.array(cos[i, j])], names=["a", "b", "cosine"])

    spark.conf.set(batch, "4")  # a row holds a block
    pairs = keep(dealt.repartitionById(stripes * (stripes + 1) // 2, "pair").sortWithinPartitions("right", "n").drop("pair", "n").mapInArrow(meet, "a long, b long, cosine double"))
    spark.conf.set(batch, before)
    drop(table)
    return pairs


def face_clusters(faces: DataFrame, confidence: float, id_col: str = "face_id", vector_col: str = "embedding") -> DataFrame:
    """face_id, cluster: density clustering with a least size of 2 and eps = 1 - confidence.

    Every face with a partner is a core point, so clusters are connected components, numbered by their smallest
    face; faces without one are -1. Equal vectors meet the others once, as the first of them; blocks still meet all blocks."""
    same = faces.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).dropna()
    leaders = keep(same.groupBy("v").agg(F.min("id").alias("leader"), F.count("*").alias("m")))
    some = leaders.select(F.col("leader").alias(id_col), F.col("v").alias(vector_col))
    # A vector without a direction is near nothing, not even its equal.
    many = leaders.filter(F.col("m") > 1).filter(F.exists("v", lambda x: x != 0)).select("v", "leader")
    equal = same.join(many, "v").filter("id <> leader")
    links = similar(some, confidence, id_col, vector_col, forest=True).select("a", "b").unionByName(equal.select(F.col("leader").alias("a"), F.col("id").alias("b")))
    parts = connected(links)
    roots = numbered(parts.select("component").distinct(), ["component"], "cluster", 0).withColumn("cluster", F.col("cluster").cast("int"))
    named = parts.join(roots, "component").select(F.col("node").alias("id"), "cluster")
    return faces.select(F.col(id_col).alias("id")).join(named, "id", "left").select(F.col("id").alias(id_col), F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def representatives(clustered: DataFrame, score: str = "det_score", order: str = "face_id") -> DataFrame:
    """Of each cluster but noise its best face and size; equal ones go to the first."""
    return clustered.filter("cluster >= 0").groupBy("cluster").agg(F.max_by(order, F.struct(F.col(score), -F.col(order))).alias(order), F.max(score).alias(score), F.count("*").alias("size"))
