"""Retrieval and answer metrics over tables of queries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions.text import normal_answer, words


def recall_at(retrieved: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """k and mean recall (four places): retrieved(query_id, doc, rank) against gold(query_id, doc)."""
    wanted = gold.select("query_id", "doc").distinct()
    sizes = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    hits = retrieved.select("query_id", "doc", "rank").join(wanted, ["query_id", "doc"], "left_semi")
    return recall_of(hits.groupBy("query_id", "doc").agg(F.min("rank").alias("rank")), sizes, ks)


def recall_of(hits: DataFrame, sizes: DataFrame, ks: list[int]) -> DataFrame:
    """k and mean recall from the ranks of gold documents that were retrieved and sizes(query_id, n_gold).

    The mean is over all queries that have gold documents; queries that
    retrieve nothing count 0.
    """
    at = F.explode(F.array(*[F.lit(k) for k in sorted(set(ks))])).alias("k")
    found = hits.select("query_id", "rank", at).where("rank <= k").groupBy("query_id", "k").agg(F.count(F.lit(1)).alias("found"))
    every = sizes.where("n_gold > 0").select("query_id", "n_gold", at)
    recall = F.coalesce(F.col("found"), F.lit(0)) / F.col("n_gold")
    return every.join(found, ["query_id", "k"], "left").groupBy("k").agg(F.round(F.avg(recall), 4).alias("recall"))


def exact(gold: Column, predicted: Column) -> Column:
    return (normal_answer(gold) == normal_answer(predicted)).cast("double")


def _overlaps(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sum((Counter(x) & Counter(y)).values()) for x, y in zip(a, b, strict=True)])


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays; a pass over each in Arrow batches."""
    return F.pandas_udf(_overlaps, "long")(a, b)


def f1(gold: Column, predicted: Column) -> Column:
    """Token F1 of two answers in normal form; 0 without a common token."""
    g, p = words(normal_answer(gold)), words(normal_answer(predicted))
    same = overlap(g, p).cast("double")
    return F.when(same > 0, 2 * same / (F.size(g) + F.size(p))).otherwise(F.lit(0.0))


def over_golds(
    answers: DataFrame, metric: Callable[[Column, Column], Column], best: Callable[[Column], Column] = F.max
) -> DataFrame:
    """query_id and score: answers(query_id, gold, predicted), the best over each query's gold answers."""
    scored = answers.select("query_id", metric(F.col("gold"), F.col("predicted")).alias("score"))
    return scored.groupBy("query_id").agg(best("score").alias("score"))


def rollup(answers: DataFrame) -> DataFrame:
    """Mean exact match and mean F1, four places, in one row; one pass over the answers."""
    both = answers.select(
        "query_id", exact(F.col("gold"), F.col("predicted")).alias("em"), f1(F.col("gold"), F.col("predicted")).alias("f1")
    )
    best = both.groupBy("query_id").agg(F.max("em").alias("em"), F.max("f1").alias("f1"))
    return best.agg(F.round(F.avg("em"), 4).alias("exact_match"), F.round(F.avg("f1"), 4).alias("f1"))
