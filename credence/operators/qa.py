"""Questions answered over retrieved passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.config import DEFAULT, Settings
from credence.functions.text import answer_of, prompt
from credence.operators.metrics import recall_at, rollup
from credence.operators.providers import Encoder, Model, answered, embedded, instruction_for
from credence.operators.retrieval import dense_best, ranking, single_stage


def solutions(questions: DataFrame, ranked: DataFrame, passages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """query_id, question, docs and doc_scores (four places) of the best passages, in order of rank."""
    texts = ranked.where(F.col("rank") <= settings.retrieval_top_k).join(passages.select("name", "content"), "name")
    listed = texts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content", "score"))).alias("d"))
    return questions.join(listed, "query_id", "left").select(
        "query_id",
        "question",
        F.coalesce(F.transform("d", lambda x: x["content"]), F.array().cast("array<string>")).alias("docs"),
        F.coalesce(F.transform("d", lambda x: F.round(x["score"], 4)), F.array().cast("array<double>")).alias("doc_scores"),
    )


def answers(found: DataFrame, model: Model, cache: DataFrame, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """``solutions`` with an answer each, and new cache rows."""
    asked = found.withColumn("prompt", prompt(F.col("docs"), F.col("question"), settings.qa_top_k))
    told, fresh = answered(asked, cache, model, must_hold="Answer:")
    return told.withColumn("answer", answer_of(F.col("response"))).drop("prompt", "response"), fresh


def scores(told: DataFrame, golds: DataFrame) -> DataFrame:
    """Exact match and F1 of the answers against golds(query_id, gold), in one row."""
    return rollup(told.select("query_id", F.col("answer").alias("predicted")).join(golds, "query_id"))


def retrieve(
    questions: DataFrame, passages: DataFrame, encoder: Encoder, settings: Settings = DEFAULT, edges: DataFrame | None = None,
    entities: DataFrame | None = None,
) -> DataFrame:
    """query_id, name, score and rank of the best passages of all questions at once.

    ``questions`` has query_id and question, ``passages`` name and content.
    Scores are dense ones; with a graph (``edges``) and entity weights
    (query_id, name, weight) they are those of single-stage retrieval, from the
    best passages and the entities.
    """
    asked = embedded(questions.select(F.col("query_id").alias("id"), "question"), "question", encoder, instruction_for("passage"))
    held = embedded(passages.select("name", F.xxhash64("name").alias("id"), "content"), "content", encoder)
    scaled = dense_best(asked, held.select("id", "embedding"), settings.retrieval_top_k)
    names = passages.select("name", F.xxhash64("name").alias("key_id"))
    dense = scaled.join(names, "key_id").select("query_id", "name", "score")
    if edges is None:
        return ranking(dense.withColumn("score", F.round("score", 6)), settings.retrieval_top_k)
    found = single_stage(edges, dense, entities, settings=settings)
    return ranking(found.withColumn("score", F.round("score", 9)), settings.retrieval_top_k)


def with_recall(ranked: DataFrame, golds: DataFrame, ks: list[int]) -> DataFrame:
    """k and recall of ranked passages against golds(query_id, doc)."""
    return recall_at(ranked.select("query_id", F.col("name").alias("doc"), "rank"), golds, ks)


def rag_qa(
    questions: DataFrame, passages: DataFrame, encoder: Encoder, model: Model, cache: DataFrame, golds: DataFrame | None = None,
    settings: Settings = DEFAULT,
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Solutions with answers, their scores against golds(query_id, gold) in one row, and new cache rows."""
    found = solutions(questions, retrieve(questions, passages, encoder, settings), passages, settings)
    told, fresh = answers(found, model, cache, settings)
    return told, None if golds is None else scores(told, golds), fresh


def shown(told: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` documents of each solution, with scores of four places."""
    return told.withColumn("docs", F.slice("docs", 1, k)).withColumn("doc_scores", F.transform(F.slice("doc_scores", 1, k), lambda x: F.round(x, 4)))
