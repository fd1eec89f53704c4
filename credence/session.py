"""Session defaults and shared work folders."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "credence", **conf: str) -> SparkSession:
    """A session with the defaults of this library; ``conf`` overrides them."""
    return SparkSession.builder.appName(name).config(map=DEFAULTS | conf).getOrCreate()


def work_path(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; local sessions without it get a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="credence-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Write and reread ``df``: cuts the lineage of iterative plans and survives lost executors."""
    path = work_path(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.work_path = path
    return table


def dropped(table: DataFrame) -> None:
    """Remove a settled table that nothing reads any more, and let go of the shuffles that made it."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.work_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    released(spark)


def released(spark: SparkSession) -> None:
    """Let go of the shuffles of plans that are no longer referred to; the scheduler holds the last job's until another one runs."""
    spark.range(0, 1, 1, 1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark._jvm.System.gc()
