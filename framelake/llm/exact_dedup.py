"""Operator 11: exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Pass one writes a narrow row of every document (id, place, hash of its text) and builds a blocked Bloom filter of the
hashes that occur again: a hash takes PROBES bits of one block, a bit is in the filter when two rows set it. Bits are
counted where the rows are and only counts are exchanged. Pass two tests every narrow row against the filter, which is
broadcast: a hash with a bit that only it set occurs once, its row is done and passes straight through. Only the rest
is shuffled by hash and grouped. A false positive costs its shuffle, never a wrong result.

The filter has BITS_A_ROW bits a row while pass one counts. What is broadcast is its repeated bits, folded to at most
FILTER_BITS (128 MB); folding adds false positives, and a corpus whose repeated hashes fill it shuffles its narrow rows.
A group that holds over 1/SHARE of all rows meets its rows by broadcast, at most SHARE such groups; all others are
joined by hash, so no key of that join has more than 1/SHARE of the rows.

Defined cases: null texts count as empty, so all null and empty texts are equal. The row with the largest id stays; null
ids are smallest, and of rows alike in text and id the one read last stays, so that each text stays once. keep_id is null
where all ids of a group are. An empty table gives no rows. Columns other than id and text are not read, or, in
keep_one(), carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, keep, read

PROBES = 3
BITS_A_ROW = 16
FILTER_BITS = 1 << 30
SHARE = 1000
#: Bits of a block: what bitmap_construct_agg() gathers.
BLOCK = 32768


def sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def block_of(sha: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(blocks))


def probes(sha: Column) -> Column:
    """The bits that a hash takes in its block."""
    return F.array(*[F.pmod(F.xxhash64(sha, F.lit(i)), F.lit(BLOCK)) for i in range(1, PROBES + 1)])


def blocks_for(rows: int, bits: int) -> int:
    """A power of two, so that one filter folds into another."""
    return 1 << max(0, (min(rows * BITS_A_ROW, bits) - 1) // BLOCK).bit_length()


def repeated_bits(hashes: DataFrame, rows: int, most: int = FILTER_BITS) -> DataFrame:
    """block, bitmap: at most `most` bits, in which those are set that two or more of the hashes (column sha) set."""
    wide, narrow = blocks_for(rows, 1 << 62), blocks_for(rows, most)
    bits = hashes.select(block_of(F.col("sha"), wide).alias("block"), F.explode(F.array_distinct(probes(F.col("sha")))).alias("bit"))
    again = bits.groupBy((F.col("block") * BLOCK + F.col("bit")).alias("bit")).agg(F.count("*").alias("n")).filter("n > 1")
    folded = again.select(F.pmod(F.floor(F.col("bit") / BLOCK), F.lit(narrow)).alias("block"), F.pmod("bit", F.lit(BLOCK)).alias("bit"))
    return folded.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


def maybe_repeated(rows: DataFrame, bitmaps: DataFrame, n: int, most: int = FILTER_BITS) -> DataFrame:
    """rows with `maybe`: all bits of sha are in the filter."""
    met = rows.withColumn("block", block_of(F.col("sha"), blocks_for(n, most))).join(F.broadcast(bitmaps), "block", "left")
    hit = F.lit(True)
    for i in range(PROBES):
        hit = hit & is_set(F.col("bitmap"), probes(F.col("sha"))[i])
    return met.withColumn("maybe", F.when(F.col("bitmap").isNull(), False).otherwise(hit)).drop("block", "bitmap")


def mark(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = FILTER_BITS) -> DataFrame:
    """doc_id, text_sha256, keep_id, group_size, kept: a row for each row of docs."""
    rows = keep(spark, docs.select(F.col(id_col).alias("doc_id"), sha256(F.col(text_col)).alias("sha"), F.monotonically_increasing_id().alias("place")))
    n = rows.count()
    bitmaps = keep(spark, repeated_bits(rows, n, most), narrow=True)
    tested = maybe_repeated(rows, bitmaps, n, most)
    single = tested.filter("not maybe").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    some = tested.filter("maybe")
    groups = keep(spark, some.groupBy("sha").agg(F.max(F.struct("doc_id", "place")).alias("best"), F.count("*").alias("size")))
    hot = F.broadcast(groups.filter(F.col("size") > n / SHARE))
    pairs = some.join(hot, "sha").unionByName(some.join(hot, "sha", "left_anti").join(groups.filter(F.col("size") <= n / SHARE), "sha"))
    grouped = pairs.select("doc_id", "sha", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("place") == F.col("best.place")).alias("kept"))
    return single.unionByName(grouped).withColumnRenamed("sha", "text_sha256")


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = FILTER_BITS) -> DataFrame:
    """docs with one row of each text: the one with the largest id. Rows whose text occurs once are not shuffled."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), sha256(F.col(text_col)).alias("sha"))
    hashes = keep(spark, rows.select("sha"))
    n = hashes.count()
    bitmaps = keep(spark, repeated_bits(hashes, n, most), narrow=True)
    drop(spark, hashes)
    tested = maybe_repeated(rows, bitmaps, n, most)
    one = tested.filter("maybe").groupBy("sha").agg(F.max_by("row", F.struct("id")).alias("row"))
    return tested.filter("not maybe").select("row").unionByName(one.select("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(spark, read(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
