"""Operator 10: mix sources to target weights by systematic sampling.

Sources take weights in turn by code point (null last), share a budget of words in proportion and stop at a
cap; what a capped source leaves goes to the others by weight. Within a source every document expects
target / source_size copies. Documents stand in order of size class, then id; the expected copies are summed
along that order, one offset per source is added, and a document is emitted once per integer crossed.

The order is cut by quantiles of the whole key (range partitioning, with a row's place in its file last), so that
no task holds a source, whatever its ids: rows are numbered within a cut, counts per (source, cut) are summed along
the cuts, and both give the rank. Copies are the whole part of the expectation, and one more where the sum of the
fractions crosses, so that rounding never gives a document more than the expectation rounded up.

Defined cases: a null text has size 0; a null source is a source of its own; a null id sorts first; rows with
the same id are ranked one after the other and each counts; a source without words has target 0; an empty
table gives no rows. Columns other than the three named are not read. Sources are ordered in one task, a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, keep, read

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def size_class(size: Column) -> Column:
    """Four classes to each doubling, from the leading three bits."""
    bits = F.length(F.bin(size))
    return bits * 4 + F.when(size >= 4, F.expr("cast(conv(substr(bin(size), 2, 2), 2, 10) as int)")).otherwise(0)


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """source, source_size -> also target. One row per source; a window over sources, not documents."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn % len(weights) + 1)
    t = sizes.withColumn("w", weight).withColumn("cap", (F.col("source_size") * cap).cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy().orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double") * budget
    t = t.withColumn("level", (total - before) / rest)
    level = F.max(F.when(F.col("level") * F.col("w") < F.col("cap"), F.col("level"))).over(everything)
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * level, F.col("cap"))).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) per source, the same in every run."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_copies(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    budget: float = BUDGET,
    cap: int = CAP,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, copies: a row for each row of docs."""
    rows = keep(
        spark,
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).alias("source"),
            F.xxhash64(F.col(text_col)).alias("text_hash"),
            word_count(F.col(text_col)).alias("size"),
        ),
    )
    order = ["source", "class", "doc_id", "size", "text_hash", "place"]
    rows, whole = rows.withColumns({"class": size_class(F.col("size")), "place": F.struct("_metadata.file_name", "_metadata.row_index")}), rows
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = keep(spark, ranged.select("doc_id", "source", "text_hash", "size", F.shiftright("at", 33).alias("cut"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at")))
    drop(spark, whole)
    counts = rows.groupBy("source", "cut").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum("size").alias("words"))
    aims = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, cap)
    before = Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
    a, b = counts.alias("a"), aims.alias("b")
    starts = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "a.cut", "a.start", "b.source_size", "b.target")
    a, b = rows.alias("a"), starts.alias("b")
    out = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.cut") == F.col("b.cut")))
    out = out.select("a.doc_id", "a.source", "a.text_hash", "a.size", "b.source_size", "b.target", (F.col("a.at") + F.col("b.start") + 1).alias("rank"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return out.withColumn("copies", crossed(F.col("rank"), each, offset(F.col("source"), seed))).drop("rank")


def crossed(rank: Column, each: Column, u: Column) -> Column:
    """Integers that u + rank * each has passed since the rank before; never more than `each` rounded up."""
    part = each - F.floor(each)
    return (F.floor(each) + F.least(F.floor(u + rank * part) - F.floor(u + (rank - 1) * part), F.lit(1))).cast("long")


def mix_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of docs as often as it is taken, with the columns of docs.

    Rows alike in id, text and source are taken together: one of them, as often as all of them are."""
    columns = docs.columns
    id_col, text_col, source_col = (options.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    # Keys without nulls, so that dropping repeats and joining share one shuffle.
    keys = lambda i, source, text_hash: {"__id": F.coalesce(i, F.lit(-(1 << 63))), "__source": F.coalesce(F.concat(F.lit("s"), source), F.lit("")), "__hash": text_hash}
    copies = mix_copies(spark, docs, **options).withColumns(keys(F.col("doc_id"), F.col("source"), F.col("text_hash")))
    taken = copies.groupBy("__id", "__source", "__hash").agg(F.sum("copies").alias("__copies")).filter("__copies > 0")
    one = docs.withColumns(keys(F.col(id_col).cast("long"), F.col(source_col), F.xxhash64(text_col))).dropDuplicates(["__id", "__source", "__hash"])
    return one.join(taken, ["__id", "__source", "__hash"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[F.col(f"`{c}`") for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_copies(spark, read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), classed AS (
  SELECT *, length(bin(size)) * 4 + CASE WHEN size >= 4 THEN CAST(substr(bin(size), 2, 1) AS INT) * 2 + CAST(substr(bin(size), 3, 1) AS INT) ELSE 0 END AS class FROM rows
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source
), weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, CAST(source_size * 2 AS DOUBLE) AS cap FROM sizes
), levels AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM sizes) AS DOUBLE) * 1.5::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), aims AS (
  SELECT source, source_size, least(cap, coalesce(w * (SELECT max(level) FROM levels WHERE level * w < cap), cap)) AS target FROM levels
), ranked AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY class, doc_id NULLS FIRST, size) AS rank FROM classed
), joined AS (
  SELECT r.doc_id, r.size, a.source_size, a.target, r.rank,
    CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0.0 END AS each_,
    CAST(('0x' || substr(md5('mix-1:' || coalesce('s' || r.source, 'null')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM ranked r JOIN aims a ON r.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(u + rank * each_) - floor(u + (rank - 1) * each_)) AS BIGINT) AS taken
FROM joined
"""
