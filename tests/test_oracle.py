import pytest

from framelake.plans import QUERIES, SQL
from oracle import DATA, same


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    same(QUERIES[name](spark, DATA), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0


def test_same_rows_for_any_partitioning(spark):
    names = ["dedup_banded", "dedup_hybrid", "nms_frame", "hota", "identity_first"]
    first = {n: sorted(map(str, QUERIES[n](spark, DATA).collect())) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert first == {n: sorted(map(str, QUERIES[n](spark, DATA).collect())) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
