"""Vector, graph, belief and cache stores as Parquet tables."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions.text import key
from credence.operators.providers import Encoder, embedded
from credence.session import settled

SCHEMAS = {
    "vectors": "namespace string, hash_id string, content string, embedding array<double>",
    "nodes": "name string, content string, type string",
    "edges": "src string, dst string, type string, weight double",
    "beliefs": "prop_key string, text string, entities array<string>, source string, attitude string, ordinal bigint",
    "aliases": "alias string, canonical string",
    "traits": "canonical string, trait string, ordinal bigint",
    "audits": "agent string, statement string, status string, reasoning string, evidence array<string>",
    "cache": "request string, response string",
    "embeddings": "request string, embedding array<double>",
    "grid": "paths bigint, entities bigint, damping double, recall double",
}


class Store:
    """Tables under one folder, written by numbered batches.

    A batch becomes visible as a whole when it is committed. What a batch that
    was never committed left behind is not read, and is overwritten when its
    number is used again, so a batch may be run again after a crash at any
    point. A table that was never written reads as empty.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        where = hadoop.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def last(self) -> int:
        """Number of the last committed batch; -1 if there is none."""
        if not self._exists("commits"):
            return -1
        found = self.spark.read.schema("done long, batch long").parquet(f"{self.path}/commits").agg(F.max("batch")).first()[0]
        return -1 if found is None else found

    def commit(self, batch: int) -> None:
        self.spark.range(1).select(F.col("id").alias("done")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")

    def read(self, name: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        every = self.spark.read.schema(f"{SCHEMAS[name]}, batch long").parquet(f"{self.path}/{name}")
        return every.where(F.col("batch") <= self.last()).drop("batch")

    def append(self, name: str, rows: DataFrame, batch: int | None = None) -> None:
        """Add rows to a table, as part of a batch that is committed later or as a batch of its own."""
        number = self.last() + 1 if batch is None else batch
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        writer = rows.select(*columns).write.mode("overwrite")
        if name == "vectors":
            writer = writer.partitionBy("namespace")
        writer.parquet(f"{self.path}/{name}/batch={number}")
        if batch is None:
            self.commit(number)

    def vectors(self, namespace: str) -> DataFrame:
        """One namespace; the others' files are pruned."""
        return self.read("vectors").where(F.col("namespace") == namespace)

    def missing(self, texts: DataFrame, namespace: str, prefix: str) -> DataFrame:
        """hash_id and content of the texts that the store lacks, one row each."""
        wanted = texts.select(key(prefix, F.col("content")).alias("hash_id"), "content").dropDuplicates(["hash_id"])
        return wanted.join(self.vectors(namespace).select("hash_id"), "hash_id", "left_anti")

    def upsert(self, texts: DataFrame, namespace: str, prefix: str, encoder: Encoder) -> None:
        """Embed and append what is new; known texts are not encoded again."""
        fresh = embedded(self.missing(texts, namespace, prefix), "content", encoder)
        self.append("vectors", fresh.withColumn("namespace", F.lit(namespace)))

    def ids(self, namespace: str) -> DataFrame:
        return self.vectors(namespace).select("hash_id")

    def lookup(self, keys: DataFrame, namespace: str) -> DataFrame:
        return keys.select("hash_id").join(self.vectors(namespace), "hash_id")


def with_cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that the cache answers, and those that it lacks (one each)."""
    hits = requests.join(cache.dropDuplicates(["request"]), "request")
    return hits, requests.select("request").distinct().join(cache, "request", "left_anti")


GRAPHML_HEAD = [
    '<?xml version="1.0" encoding="UTF-8"?>',
    '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
    '<key id="type" for="node" attr.name="type" attr.type="string"/>',
    '<key id="weight" for="edge" attr.name="weight" attr.type="double"/>',
    '<graph id="G" edgedefault="directed">',
]
GRAPHML_FOOT = ["</graph>", "</graphml>"]


def export_graphml(nodes: DataFrame, edges: DataFrame, path: str, compression: str = "none") -> None:
    """The graph as GraphML lines in text files; the parts head, nodes, edges and foot joined in this order are the document.

    Files that are each compressed by gzip still make one gzip file when joined.
    """
    def escaped(c: Column) -> Column:
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(sign), F.lit(name))
        return c

    node = F.concat(F.lit('<node id="'), escaped(F.col("name")), F.lit('"><data key="type">'), "type", F.lit("</data></node>"))
    edge = F.concat(
        F.lit('<edge source="'), escaped(F.col("src")), F.lit('" target="'), escaped(F.col("dst")), F.lit('"><data key="weight">'),
        F.coalesce("weight", F.lit(1.0)).cast("string"), F.lit("</data></edge>"),
    )
    lines = lambda rows: nodes.sparkSession.createDataFrame([(x,) for x in rows], "value string").coalesce(1)
    lines(GRAPHML_HEAD).write.mode("overwrite").option("compression", compression).text(f"{path}/0-head")
    nodes.select(node).write.mode("overwrite").option("compression", compression).text(f"{path}/1-nodes")
    edges.select(edge).write.mode("overwrite").option("compression", compression).text(f"{path}/2-edges")
    lines(GRAPHML_FOOT).write.mode("overwrite").option("compression", compression).text(f"{path}/3-foot")


def import_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes(name, type) and edges(src, dst, weight) of an exported graph."""
    def plain(c: Column) -> Column:
        for sign, name in (('"', "&quot;"), ("<", "&lt;"), ("&", "&amp;")):
            c = F.replace(c, F.lit(name), F.lit(sign))
        return c

    part = lambda pattern: plain(F.regexp_extract("value", pattern, 1))
    nodes = spark.read.text(f"{path}/1-nodes").select(part('id="([^"]*)"').alias("name"), part('"type">([^<]*)<').alias("type"))
    edges = spark.read.text(f"{path}/2-edges").select(
        part('source="([^"]*)"').alias("src"), part('target="([^"]*)"').alias("dst"), part('"weight">([^<]*)<').cast("double").alias("weight")
    )
    return nodes, edges


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts = batch.column(0).to_pylist()
        row = pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([len(texts)], pa.int64())
        yield pa.RecordBatch.from_arrays([*row, pa.array([zlib.compress("".join(texts).encode(), 1)], pa.binary())], ["part", "at", "n", "text"])
        at += 1


def _md5_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, digest = 0, hashlib.md5()
    for batch in batches:
        n += pc.sum(batch.column("n")).as_py() or 0
        for block in batch.column("text"):
            digest.update(zlib.decompress(block.as_py()))
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], ["n", "md5"])


def ordered_md5(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n, and the md5 of the columns' texts joined in their order; null without rows.

    Rows are sorted by ranges and joined into compressed blocks where they
    are. An md5 can only be taken from the first byte on, so one task reads
    the blocks, a few at a time.
    """
    text = F.coalesce(F.concat(*columns), F.lit("")).alias("text")
    blocks = settled(rows.select(*columns).orderBy(*columns).select(text).mapInArrow(_blocks, "part int, at long, n long, text binary"))
    conf, size = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(size)
    conf.set(size, "16")
    try:
        found = settled(blocks.repartition(1).sortWithinPartitions("part", "at").mapInArrow(_md5_of, "n long, md5 string"))
    finally:
        conf.set(size, before)
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("md5").alias("md5"))
