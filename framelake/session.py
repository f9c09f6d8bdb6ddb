"""Sessions, and tables that cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that queries assume."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("framelake")
    for k, v in ({"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="framelake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/framelake-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """df written to the folder that driver and executors share, and read back."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._framelake_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by keep() that no returned DataFrame reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._framelake_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
