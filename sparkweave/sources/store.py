"""Tables that a plan uses more than once, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a folder of our own, but only if Spark runs in this one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="linkage-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written and read again, so that what follows reads only the columns it needs. Shuffle files of the
    work are given up at once; else they stay until the driver happens to collect its garbage."""
    spark, at = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = [at]
    return out


def joined(parts: list[DataFrame]) -> DataFrame:
    """Tables of materialized() with the same columns as one."""
    at = [x for part in parts for x in part.written_at]
    out = parts[0].sparkSession.read.schema(parts[0].schema).parquet(*at)
    out.written_at = at
    return out


def apart(table: DataFrame) -> list[DataFrame]:
    """The tables that joined() made one of."""
    out = []
    for at in table.written_at:
        out.append(table.sparkSession.read.schema(table.schema).parquet(at))
        out[-1].written_at = [at]
    return out


def dropped(table: DataFrame) -> None:
    """Deletes a table of materialized() that nothing reads any more."""
    spark = table.sparkSession
    for at in table.written_at:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
