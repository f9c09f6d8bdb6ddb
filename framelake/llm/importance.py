"""Operator 12: importance resampling towards a target distribution, scored without exploding a document.

Features are runs of one and two words, hashed to BUCKETS. fit() counts the buckets of the corpus and of the target
texts (counts are summed where the rows are, so that a task sends BUCKETS totals at most) and makes one whole number of
each bucket, its gain. Scoring is one projection: higher-order functions turn a text into the array of its buckets and
sum element_at() of the gains, a literal array of BUCKETS numbers. A seeded Gumbel term is added, and the highest scores
are drawn. Ranks come from range cuts of the scores, so that no task orders the corpus.

Defined cases: a null text has no words; a document without features weighs 0; a null id hashes as the empty string and
ranks before others of its score; rows alike in id and score rank in the order read, and resample() draws them together;
too few words (least_words) never draws; empty tables give gains of 0 and no rows. Other columns are not read, or, in
resample(), carried along whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators.numbering import numbered

from .common import drop, keep, read

BUCKETS = 10000
#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def bucket(feature: Column) -> Column:
    return (F.crc32(feature.cast("binary")) % BUCKETS).cast("int")


def buckets(words: str) -> Column:
    """The bucket of each word of an array column, then of each pair of neighbours. Not of an expression, which would be computed at each use."""
    but_one = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, but_one), F.slice(words, 2, but_one), lambda a, b: bucket(F.concat(a, F.lit(" "), b)))
    return F.concat(F.transform(words, bucket), pairs)


def bucket_counts(rows: DataFrame, text_col: str) -> DataFrame:
    split = rows.select(words(F.col(text_col)).alias("w"))
    return split.select(F.explode(buckets("w")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int]) -> list[int]:
    """What a feature of each bucket adds: the logarithm of how much likelier the target is to hold it, in thousandths."""
    s_all, t_all = sum(corpus.values()), sum(target.values())
    ratio = lambda b: (target.get(b, 0) + 1) * (s_all + BUCKETS) / ((corpus.get(b, 0) + 1) * (t_all + BUCKETS))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(BUCKETS)]


def fit(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text") -> list[int]:
    """The gains: two results of at most BUCKETS rows each."""
    corpus, aim = ({r.bucket: r.n for r in bucket_counts(t, c).collect()} for c, t in ((text_col, docs), (target_col, target)))
    return gains(corpus, aim)


def scored(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Columns __words, n_features, weight, score beside those of docs; one projection, nothing is shuffled."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    rows = docs.withColumn("__w", words(F.col(text_col))).withColumn("__words", F.size("__w")).withColumn("__b", buckets("__w")).drop("__w")
    total = F.aggregate("__b", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b + 1))
    rows = rows.withColumn("n_features", F.size("__b").cast("long")).withColumn("__total", total).drop("__b")
    floored = F.expr("(__total - pmod(__total, n_features)) div n_features")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = rows.withColumn("weight", F.when(F.col("n_features") > 0, floored).otherwise(F.lit(0)).cast("long")).drop("__total")
    return rows.withColumn("score", (F.col("weight") + gumbel).cast("long"))


def ranked(spark: SparkSession, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: a row for each row of docs; rank is null where a row is not drawn."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = scored(slim, fit(slim, target), seed=seed).select("doc_id", "n_features", "weight", "score", (F.col("__words") < least_words).alias("short"), (-F.col("score")).alias("down"), F.monotonically_increasing_id().alias("place"))
    rows = keep(spark, rows)
    draw = percent * rows.filter("not short").count() // 100
    out = numbered(rows, ["short", "down", "doc_id", "place"], "rank")
    return out.select("doc_id", "n_features", "weight", "score", F.when(~F.col("short") & (F.col("rank") <= draw), F.col("rank")).cast("long").alias("rank"))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of docs that are drawn: those at or above the lowest drawn score. Their texts are not shuffled."""
    drawn = keep(spark, ranked(spark, docs, target, id_col, text_col, percent, least_words, seed).filter("rank is not null"), narrow=True)
    last = drawn.agg(F.max_by(F.struct("score", "doc_id"), "rank").alias("last")).first().last
    drop(spark, drawn)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if last is None:
        return whole.limit(0).select("row.*")
    rows = scored(whole, fit(docs.select(F.col(text_col).alias("text")), target), seed=seed)
    tied = F.lit(last.doc_id).isNull() & F.col("doc_id").isNull() if last.doc_id is None else F.col("doc_id").isNull() | (F.col("doc_id") <= F.lit(last.doc_id))
    return rows.filter((F.col("__words") >= least_words) & ((F.col("score") > last.score) | (F.col("score") == last.score) & tied)).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: crc32 byte by byte, from the table of its polynomial.
SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)
), texts AS (
  SELECT 0 AS side, doc_id AS id, row_number() OVER () AS place, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 1, NULL, row_number() OVER (), coalesce(text, '') FROM benchmark
), worded AS (
  SELECT side, id, place, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
  SELECT side, id, place, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM worded
), hashed AS (
  SELECT f, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000) AS bucket
  FROM (SELECT DISTINCT f FROM features), crc_table
), placed AS (
  SELECT side, id, place, bucket FROM features JOIN hashed USING (f)
), counts AS (
  SELECT b.bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM range(10000) AS b(bucket) LEFT JOIN placed USING (bucket) GROUP BY ALL
), gained AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE)) AS BIGINT) AS gain FROM counts
), weighed AS (
  SELECT place, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM placed JOIN gained USING (bucket) WHERE side = 0 GROUP BY place
), rows AS (
  SELECT id AS doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    (CAST('0x' || substr(sha256('7:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM worded LEFT JOIN weighed USING (place) WHERE side = 0
), scored AS (
  SELECT *, CAST(weight + floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM rows
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS r, count(*) FILTER (words >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND r <= n * 25 // 100 THEN r END AS rank FROM ordered
"""
