"""Exact nearest neighbours by blocked matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.functions.text import alnum_length

#: Keys and queries of one block; a task holds one block of each, and scores of TILE queries by BLOCK_ROWS keys.
BLOCK_ROWS, QUERY_ROWS, TILE = 16_384, 65_536, 512
#: Key matrices up to this many bytes are broadcast; larger ones go block by block.
BROADCAST_BYTES = 64 << 20


def _matrix(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    if not len(m):
        return m
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


SCHEMA = "query_id long, key_id long, score double, low double, high double"


def _tile(ids: np.ndarray, scores: np.ndarray, key_ids: np.ndarray, k: int, least: float | None) -> pd.DataFrame:
    """The k best keys of each query at least as similar as ``least``, ties by key, with the extremes over all keys."""
    rows, columns = [], []
    for row, own in enumerate(scores):
        near = np.arange(len(own)) if least is None else np.flatnonzero(own >= least)
        if len(near) > k:
            # keep ties of the k-th score, so that the order by key decides
            floor = np.partition(own[near], len(near) - k)[len(near) - k]
            near = near[own[near] >= floor]
            near = near[np.lexsort((key_ids[near], -own[near]))][:k]
        rows.append(np.full(len(near), row))
        columns.append(near)
    row, column = np.concatenate(rows), np.concatenate(columns)
    return pd.DataFrame(
        {"query_id": ids[row], "key_id": key_ids[column], "score": scores[row, column], "low": scores.min(axis=1)[row], "high": scores.max(axis=1)[row]}
    )


def _best(query_ids, queries: np.ndarray, key_ids: np.ndarray, keys: np.ndarray, k: int, least: float | None) -> Iterator[pd.DataFrame]:
    """``_tile`` of all queries and keys, some queries and one block of keys at a time."""
    ids = np.asarray(query_ids, np.int64)
    for a in range(0, len(queries), TILE):
        for b in range(0, len(keys), BLOCK_ROWS):
            scores = np.round(queries[a : a + TILE] @ keys[b : b + BLOCK_ROWS].T, 6)
            yield _tile(ids[a : a + TILE], scores, key_ids[b : b + BLOCK_ROWS], k, least)


def _none() -> pd.DataFrame:
    kinds = {"query_id": "int64", "key_id": "int64", "score": "float64", "low": "float64", "high": "float64"}
    return pd.DataFrame({c: [] for c in kinds}).astype(kinds)


def nearest(
    queries: DataFrame, keys: DataFrame, k: int, least: float | None = None, broadcast_bytes: int = BROADCAST_BYTES, extremes: bool = False
) -> DataFrame:
    """query_id, key_id, score and rank of the k nearest keys of every query, by cosine.

    Both sides have columns id (long) and embedding. Scores are rounded to six
    places before they are ranked, and ties go to the smaller key. With
    ``extremes``, also low and high, the least and largest score of the query
    over all keys. A task's memory is bounded whatever the sizes: blocks of
    queries meet blocks of keys, and a block's k best are all that it returns.
    """
    rows = keys.count()
    first = keys.select(F.size("embedding")).first()
    bytes_ = rows * (first[0] if first else 0) * 8
    if bytes_ <= broadcast_bytes:
        held = keys.select("id", "embedding").toPandas()
        sent = keys.sparkSession.sparkContext.broadcast((held["id"].to_numpy(np.int64), _matrix(held["embedding"])))

        def all_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = sent.value
            for batch in batches:
                yield from _best(batch["id"], _matrix(batch["embedding"]), ids, matrix, k, least)

        found = queries.select("id", "embedding").mapInPandas(all_keys, SCHEMA)
    else:
        blocks, groups = -(-rows // BLOCK_ROWS), max(1, -(-queries.count() // QUERY_ROWS))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
        # every block of queries meets every block of keys once: an exact search can't do less
        one = queries.select("id", "embedding", dealt(groups).alias("group"), every(blocks).alias("block"))
        other = keys.select(F.col("id").alias("key_id"), F.col("embedding").alias("vector"), every(groups).alias("group"), dealt(blocks).alias("block"))

        def one_block(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            if not len(mine) or not len(theirs):
                return _none()
            tiles = _best(mine["id"], _matrix(mine["embedding"]), theirs["key_id"].to_numpy(np.int64), _matrix(theirs["vector"]), k, least)
            return pd.concat(tiles, ignore_index=True)

        found = one.groupBy("group", "block").cogroup(other.groupBy("group", "block")).applyInPandas(one_block, SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    if extremes:
        whole = Window.partitionBy("query_id")
        ranked = ranked.withColumn("low", F.min("low").over(whole)).withColumn("high", F.max("high").over(whole))
    else:
        ranked = ranked.drop("low", "high")
    return ranked.where(F.col("rank") <= k)


def synonym_edges(vectors: DataFrame, k: int, least: float, most: int, new: DataFrame | None = None) -> DataFrame:
    """Edges between entities (id, content, embedding) whose cosine reaches ``least``.

    Names of at most two letters and digits take no part; each keeps ``most``
    neighbours, itself not counted. With ``new``, only edges from these entities.
    """
    named = vectors.where(alnum_length(F.col("content")) > 2)
    asked = named if new is None else new.where(alnum_length(F.col("content")) > 2)
    # one more than k, as every key finds itself
    pairs = nearest(asked, named, k + 1, least).where("query_id <> key_id").drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key_id")
    kept = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return kept.select(
        F.col("query_id").alias("src"), F.col("key_id").alias("dst"), F.lit("synonymy").alias("type"), F.col("score").alias("weight")
    )


def dropping_last(found: DataFrame) -> DataFrame:
    """Compatible mode: a neighbour list that ends above the threshold loses its last entry."""
    whole = Window.partitionBy("query_id")
    return found.withColumn("last", F.max("rank").over(whole)).where("rank < last").drop("last")
