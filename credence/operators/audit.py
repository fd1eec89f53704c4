"""Consistency audits: new beliefs against what their speaker said before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.config import GLOBAL
from credence.functions.parsing import parsed
from credence.operators.providers import Model, answered

VERDICTS = ["Consistent", "Inconsistent", "Neutral"]
VERDICT_SCHEMA = "status string, reasoning string"


def subjective(beliefs: DataFrame) -> DataFrame:
    """Beliefs that somebody in particular holds."""
    return beliefs.where(F.col("source") != GLOBAL)


def evidence(new: DataFrame, stated: DataFrame) -> DataFrame:
    """Each new subjective belief with its speaker's earlier beliefs.

    ``stated``: (agent, prop_key, text). The whole batch is left out of the
    memories, not only the belief at hand. Memories are one sorted array an
    agent, joined once.
    """
    old = stated.join(new.select("prop_key").distinct(), "prop_key", "left_anti")
    memory = old.groupBy("agent").agg(F.array_sort(F.collect_set("text")).alias("evidence"))
    return (
        subjective(new)
        .withColumnRenamed("source", "agent")
        .join(memory, "agent", "left")
        .select("agent", "prop_key", F.col("text").alias("statement"), F.coalesce("evidence", F.array()).alias("evidence"))
    )


def validation_prompt(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """``rows`` of evidence with a prompt that names the agent, the profile, the memories and the statement."""
    known = profiles.select(F.col("canonical").alias("agent"), F.array_join("profile", "; ").alias("profile"))
    joined = rows.join(known, "agent", "left")
    prompt = F.concat(
        F.lit("Agent: "), "agent", F.lit("\nProfile: "), F.coalesce("profile", F.lit("")), F.lit("\nEarlier statements:\n"),
        F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("- "), e)), "\n"), F.lit("\nNew statement: "), "statement",
        F.lit('\nAnswer as JSON {"status": "Consistent|Inconsistent|Neutral", "reasoning": "..."}.'),
    )
    return joined.withColumn("prompt", prompt).drop("profile")


def audited(new: DataFrame, stated: DataFrame, profiles: DataFrame, model: Model, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """agent, statement, status, reasoning and evidence of every new subjective belief, and new cache rows."""
    asked, fresh = answered(validation_prompt(evidence(new, stated), profiles), cache, model)
    verdict = parsed(F.col("response"), VERDICT_SCHEMA)
    status = F.when(verdict["status"].isin(*VERDICTS), verdict["status"]).otherwise("Error")
    return asked.select("agent", "statement", status.alias("status"), verdict["reasoning"].alias("reasoning"), "evidence"), fresh
