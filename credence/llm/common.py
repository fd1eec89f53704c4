"""Helpers shared by the corpus operators: written work tables and text batches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to numpy in groups of about this many bytes, so that a
#: task's memory follows its longest text and not its Arrow batch.
CHUNK_BYTES = 1 << 20


def work_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor shares.

    Local sessions without that setting (tests) get a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="credence-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/credence-{uuid.uuid4().hex}"


def written(df: DataFrame, *, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to a work table and return the table.

    This cuts the lineage and survives lost executors; rows keep their
    values in every later read, which a recomputation need not promise.
    """
    path = work_folder(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.work_path = path
    return table


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run meanwhile hands at most ``rows`` rows to Python at once."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, str(rows))
    try:
        yield
    finally:
        spark.conf.set(size, before)


def drop(table: DataFrame) -> None:
    """Remove a work table that nothing reads any more."""
    spark = table.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(table.work_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def collected(spark: SparkSession) -> None:
    """Let go of plans, broadcasts and shuffles that nothing refers to any more, on the driver and through it on executors."""
    gc.collect()
    spark._jvm.System.gc()


def text_hash() -> Column:
    """A hash of the text, by which rows of equal id are told apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents listed in ``kept`` (doc_id, t: the hash of the text), one row each, and those without an id."""
    marks = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), text_hash().alias("_t"))
    chosen = marks.where("_id is not null").join(kept.toDF("_id", "_t"), ["_id", "_t"], "left_semi").dropDuplicates(["_id", "_t"])
    return chosen.select("_row.*").union(docs.where("doc_id is null"))


def text_groups(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of a string column that hold about ``limit`` bytes each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    start, total = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield start, row
            start, total = row, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table whose size a parameter bounds; more rows are an error, never cut off."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


