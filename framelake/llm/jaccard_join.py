"""Operator 8: exact Jaccard join of word shingles, by leaders, an index of first shingles, and pivot windows.

The method asked for cuts the corpus into Voronoi regions of document firsts and copies what lies near a boundary.
Documents that are no copies share next to nothing, so all distances to document firsts are close to 1, within the
windows of each other, and every document would go to every region (figures in the README). What is kept of the
method is what works at such distances:

1. Leaders. Documents that agree in a band of minwise hashes are compared to the smallest id and to one drawn by a
   hash; these are firsts near by, whose regions are groups of copies. Such groups collapse to their connected parts
   here, at a few comparisons a document. This finds links; it proves none absent.
2. First shingles. Shingles are ordered, rare ones first. A partner within distance r lacks at most r|x| of x's
   shingles, so it has one of x's first floor(r|x|) + 1: documents go to the region of each of these, and two within
   r meet in the region of their first common one, where their sizes and places bound the overlap. Regions whose
   documents are all of one part need nothing; of the others pairs of different parts meet. A region of more than
   SPLIT documents is first split again by its members' next shingles, windows one wider.
3. Pivot windows. Cells of the hash range are pivot sets, disjoint, so by the triangle inequality of the symmetric
   difference two sets differ by at least the sum, over cells, of what the numbers of their shingles there differ by.
   Pairs beyond r by that bound alone leave before any set is sent; this is nearly all pairs of unrelated documents.

Every pair that is left is verified on the whole shingle sets; nothing is capped. The order of shingles decides cost,
not results: it comes from a count sketch of fixed size over all documents. Shingles are 64-bit hashes; that
two different ones among a pair's share a hash has a chance of about |x||y| / 2**64.

Defined cases: a text of fewer words than a shingle is one shingle; null texts and texts without words have no
shingles and link with nothing; rows repeated under one id are one vertex with the shingles of each, and each
row is returned; a null id links with nothing and its component is null; an empty table gives none. Columns
other than the two named are not read, keep_one() hands all columns on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, keep, mix, read, release, salted, shingles, small_batches, text_chunks
from .components import components

WIDTH, PERCENT = 5, 80
#: Bits of the count sketch, and how many of its cells count as frequent at most.
SKETCH_BITS, FREQUENT = 20, 1 << 16
BANDS, ROWS = 5, 3
#: Bits of the filter of ids whose sets are needed; 2**20 bytes whatever the input.
ID_BITS = 23


#: A region of more documents is split by its members' next shingles.
SPLIT = 4096
#: Shingles that a pivot cell has on average, and the bits of the least and greatest number of cells.
PER_CELL, CELL_BITS = 8, (4, 11)


def window(n, percent: int):
    """First shingles of a set of n, of which a partner has one."""
    return n - (percent * n + 99) // 100 + 1


def depth(percent: int) -> int:
    """How often regions are split, and one more: linked, different sets share two first shingles at least from 50 percent on.

    A third level would cost more than it saves: a pair that shares k of them meets in all triples of them."""
    return 2 if percent >= 50 else 1


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, data, offsets in text_chunks(batches, "text"):
            s, _ = shingles(data, offsets, width)
            cells += np.bincount((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(cells))
        mean = cells.mean()
        some = np.flatnonzero(cells >= 8 + 2 * mean + 4 * mean**0.5)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array((cells[some] - mean).astype(np.int64))], names=["cell", "n"])

    return run


def frequent(spark: SparkSession, docs: DataFrame, width: int) -> np.ndarray:
    """By cell of the sketch the class of its shingles' frequency, 0 for rare ones; of fixed size."""
    found = docs.select("text").mapInArrow(_sketch(width), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cell").limit(FREQUENT).collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for cell, n in found:
        out[cell] = int(n).bit_length()
    return out


def _summaries(width: int, percent: int, classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = classes.value
        for rows, data, offsets in text_chunks(batches, "text"):
            s, n = shingles(data, offsets, width)
            at = np.concatenate([[0], np.cumsum(n)])
            some = np.flatnonzero(n > 0)
            first = at[:-1][some]
            digest = np.zeros((2, len(n)), np.uint64)
            bands = np.zeros((len(n), BANDS), np.uint64)
            doc = np.repeat(np.arange(len(n)), n)
            with np.errstate(over="ignore"):
                if len(some):
                    for k in (0, 1):
                        digest[k, some] = np.add.reduceat(salted(s, 101 + k), first)
                    for b in range(BANDS):
                        key = np.full(len(some), np.uint64(b))
                        for r in range(ROWS):
                            key = mix(key ^ np.minimum.reduceat(salted(s, b * ROWS + r), first))
                        bands[some, b] = key
            # Rare shingles first; of one class by hash, as they stand.
            order = np.argsort(doc.astype(np.int64) << 8 | level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
            place = np.arange(len(s)) - at[:-1][doc]
            # Windows as wide as the deepest split needs.
            size = np.minimum(np.where(n > 0, window(n, percent) + depth(percent) - 1, 0), n)
            inside = place < size[doc]
            firsts = s[order][inside].astype(np.int64)
            common = level[(s[order] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] > 0
            rare = np.bincount(doc[inside & ~common], minlength=len(n)).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            cells, cell_ends = _cells(s, n, doc)
            band_ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(n),
                    *(pa.array(d.astype(np.int64)) for d in digest),
                    pa.ListArray.from_arrays(pa.array(band_ends), pa.array(bands[some].ravel().astype(np.int64))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(firsts)),
                    pa.array(rare),
                    pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cell_ends.tobytes()), pa.py_buffer(cells.tobytes())]),
                ],
                names=["doc_id", "n", "d1", "d2", "bands", "firsts", "rare", "cells"],
            )

    return run


def _cells(s: np.ndarray, n: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the shingles in each pivot cell, up to 255, and where its cells end; more cells for larger sets."""
    bits = np.clip(np.ceil(np.log2(np.maximum(n, 1) / PER_CELL)), *CELL_BITS).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(np.where(n > 0, 1 << bits, 0))])
    at = ends[:-1][doc] + (s >> (64 - bits[doc]).astype(np.uint64)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=int(ends[-1])), 255).astype(np.uint8), ends.astype(np.int32)


def _apart(percent: int):
    """Of pairs (a, b, na, nb, ca, cb) those whose pivot cells do not prove them beyond the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            ca, cb = (np.array(batch.column(i).to_pylist(), object) for i in (4, 5))
            sizes = np.array([(len(x), len(y)) for x, y in zip(ca, cb, strict=True)], np.int64).reshape(-1, 2)
            least = np.zeros(len(na), np.int64)
            for la, lb in np.unique(sizes, axis=0).tolist():
                rows, m = np.flatnonzero((sizes == (la, lb)).all(1)), min(la, lb)
                # Neighbouring cells together are a cell of the coarser division; 255 stands for all from there on.
                x, y = (np.minimum(np.frombuffer(b"".join(c[rows]), np.uint8).reshape(len(rows), m, -1).sum(2, dtype=np.int64), 255) for c in (ca, cb))
                least[rows] = np.abs(x - y).sum(1)
            both = na + nb
            yield batch.select([0, 1]).filter(pa.array((100 + percent) * (both - least) >= 2 * percent * both))

    return run


def _sets(width: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chosen():
            for batch in batches:
                slot = batch.column("slot").to_numpy()
                yield batch.filter(pa.array((wanted.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))

        for rows, data, offsets in text_chunks(chosen(), "text"):
            s, n = shingles(data, offsets, width)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(s.astype(np.int64)))], names=["doc_id", "s"])

    return run


class Join:
    """The steps of one join over docs (doc_id, text)."""

    def __init__(self, spark: SparkSession, docs: DataFrame, width: int, percent: int, split: int = SPLIT):
        self.spark, self.docs, self.width, self.percent, self.split = spark, docs, width, percent, split

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b) of ids those within the distance, written out.

        A filter of fixed size keeps the sets of other documents out of the shuffle."""
        slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << ID_BITS)).cast("int")
        slots = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(slot("id").alias("slot"))
        words = slots.groupBy(F.shiftright("slot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 31)"))).collect()
        bits = np.zeros(1 << (ID_BITS - 5), np.uint32)
        for word, x in words:
            bits[word] = x
        wanted = self.spark.sparkContext.broadcast(bits.view(np.uint8))
        sets = self.docs.withColumn("slot", slot("doc_id")).mapInArrow(_sets(self.width, wanted), "doc_id long, s array<long>")
        a, b = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return keep(self.spark, pairs.join(a, "a").join(b, "b").filter(100 * both >= self.percent * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct(), narrow=True)

    def regions(self, members: DataFrame, above: DataFrame | None, level: int) -> DataFrame:
        """Rows (region, id, n, part, place) of the regions whose documents are of several parts.

        above: rows of the regions to split, each by the shingles that follow a member's place; None for all members."""
        n = F.col("n")
        reach = (n - F.floor((self.percent * n + 99) / 100) + level).cast("int")
        if above is not None:
            rows = above.select("region", "id", "place").join(members.select("id", "n", "part", "firsts"), "id")
            after = F.greatest(reach - F.col("place") - 1, F.lit(0))
            rows = rows.select("region", "id", "n", "part", "place", F.posexplode(F.slice("firsts", F.col("place") + 2, after)).alias("step", "first"))
            return self._mixed(rows.select(F.xxhash64("region", "first").alias("region"), "id", "n", "part", (F.col("place") + 1 + F.col("step")).alias("place")))
        members = members.withColumn("reach", reach).withColumn("rare", F.least("rare", "reach"))
        rows = members.select("id", "n", "part", F.posexplode(F.slice("firsts", F.lit(1), F.col("rare"))).alias("place", "region"))
        # A rare shingle's region is small by the sketch, so one shuffle will do; a frequent one's may be any size.
        of = Window.partitionBy("region")
        rare = rows.withColumn("low", F.min("part").over(of)).withColumn("high", F.max("part").over(of)).filter("low < high").select("region", "id", "n", "part", "place")
        rest = F.posexplode(F.slice("firsts", F.col("rare") + 1, F.col("reach") - F.col("rare"))).alias("step", "region")
        rows = members.select("id", "n", "part", "rare", rest).select("region", "id", "n", "part", (F.col("rare") + F.col("step")).alias("place"))
        return rare.unionByName(self._mixed(rows))

    @staticmethod
    def _mixed(rows: DataFrame) -> DataFrame:
        mixed = rows.groupBy("region").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("region")
        return rows.join(mixed, "region", "left_semi")

    def leads(self, sets: DataFrame) -> DataFrame:
        """Pairs (a, b) of a set and a leader of a band of it."""
        banded = sets.select("id", F.explode("bands").alias("band"))
        leaders = banded.groupBy("band").agg(F.min("id").alias("x"), F.min_by("id", F.xxhash64("id", "band")).alias("y"), F.count("*").alias("m")).filter("m > 1").select("band", F.explode(F.array("x", "y")).alias("leader"))
        return banded.join(leaders, "band").filter("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()

    def screened(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of the pairs (a, b) those that their sizes and pivot cells do not rule out."""
        a, b = (sets.select(F.col("id").alias(k), F.col("n").alias("n" + k), F.col("cells").alias("c" + k)) for k in "ab")
        sized = (100 * F.col("na") >= self.percent * F.col("nb")) & (100 * F.col("nb") >= self.percent * F.col("na"))
        return pairs.join(a, "a").join(b, "b").filter(sized).select("a", "b", "na", "nb", "ca", "cb").mapInArrow(_apart(self.percent), "a long, b long")

    def pairs(self, regions: DataFrame, level: int) -> DataFrame:
        """Candidates (a, b) of different parts that share a region and whose sizes and places leave room for the overlap.

        In the region of their first common shingles two linked sets have at most what follows it in either in common."""
        x, y, percent = regions.alias("x"), regions.alias("y"), self.percent
        on = (F.col("x.region") == F.col("y.region")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.part") != F.col("y.part"))
        on &= (100 * F.col("x.n") >= percent * F.col("y.n")) & (100 * F.col("y.n") >= percent * F.col("x.n"))
        most = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + (level - 1)
        on &= (100 + percent) * most >= percent * (F.col("x.n") + F.col("y.n"))
        return x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id: a row for each row of docs."""
        spark, percent = self.spark, self.percent
        small_batches(spark)
        classes = spark.sparkContext.broadcast(frequent(spark, self.docs, self.width))
        rows = keep(spark, self.docs.mapInArrow(_summaries(self.width, percent, classes), "doc_id long, n long, d1 long, d2 long, bands array<long>, firsts array<long>, rare int, cells binary"))
        light = keep(spark, rows.select("doc_id", "n", "d1", "d2"), narrow=True)
        named = lambda t: t.filter("n > 0 and doc_id is not null")
        # Equal sets are one member.
        sets = keep(spark, named(rows).groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("bands", "firsts", "rare", "cells")]), narrow=True)
        drop(spark, rows)
        equal = named(light).join(sets.select("id", "n", "d1", "d2"), ["n", "d1", "d2"]).filter("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
        # Leaders.
        release(spark)
        near = keep(spark, self.screened(self.leads(sets), sets), narrow=True)
        led = self.verified(near)
        drop(spark, near)
        release(spark)
        parts = components(spark, led).withColumnRenamed("component", "part")
        # Shingles.
        members = sets.select("id", "n", "firsts", "rare").join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
        regions, pairs, level = None, [], 1
        while True:
            regions, old = keep(spark, self.regions(members, regions, level), narrow=True), regions
            if old is not None:
                drop(spark, old)
            large = regions.groupBy("region").agg(F.count("*").alias("m")).filter(F.col("m") > self.split).select("region")
            some = level < depth(percent) and large.limit(1).count() > 0
            small, rest = (regions.join(large, "region", "left_anti"), keep(spark, regions.join(large, "region", "left_semi"), narrow=True)) if some else (regions, None)
            pairs.append(keep(spark, self.pairs(small, level), narrow=True))
            release(spark)
            if not some:
                break
            drop(spark, regions)
            regions, level = rest, level + 1
        drop(spark, regions)
        candidates = pairs[0]
        for p in pairs[1:]:
            candidates = candidates.unionByName(p)
        close = keep(spark, self.screened(candidates.distinct() if len(pairs) > 1 else candidates, sets), narrow=True)
        drop(spark, *pairs)
        release(spark)
        found = self.verified(close)
        linked = components(spark, equal.unionByName(led).unionByName(found))
        release(spark)
        out = light.select("doc_id", "n").join(linked.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        drop(spark, sets, led, close, found)
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def jaccard_groups(spark: SparkSession, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links): a row for each row of docs."""
    return Join(spark, docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), width, percent).run()


def keep_one(spark: SparkSession, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that a link path joins to a smaller id; of rows under one id one stays."""
    groups = jaccard_groups(spark, docs, width, percent, id_col, text_col)
    gone = groups.filter("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
    if docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").limit(1).count():
        left = left.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(left.filter(F.col(id_col).isNull()))
    return left


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark, read(spark, sf_dir, "documents"), width=4, percent=85)


SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM worded
), grams AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), rare AS (
  SELECT x.doc_id, x.n, x.g, row_number() OVER (PARTITION BY x.doc_id ORDER BY c.c, x.g) AS k
  FROM grams x JOIN (SELECT g, count(*) AS c FROM grams GROUP BY g) c ON x.g = c.g
), candidates AS (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM rare x JOIN rare y ON x.g = y.g AND x.doc_id < y.doc_id
  WHERE x.k <= x.n - (85 * x.n + 99) // 100 + 1 AND y.k <= y.n - (85 * y.n + 99) // 100 + 1 AND 100 * x.n >= 85 * y.n AND 100 * y.n >= 85 * x.n
), links AS MATERIALIZED (
  SELECT a, b FROM (SELECT c.a, c.b, len(x.s) + len(y.s) AS total, len(list_intersect(x.s, y.s)) AS common FROM candidates c JOIN sets x ON x.doc_id = c.a JOIN sets y ON y.doc_id = c.b)
  WHERE 100 * common >= 85 * (total - common)
), steps AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a, b FROM steps UNION SELECT r.a, s.b FROM reach r JOIN steps s ON r.b = s.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(r.low, s.doc_id)) AS component_id
FROM sets s LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = s.doc_id
"""
