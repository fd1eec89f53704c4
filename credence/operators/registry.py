"""The entity registry: canonical names, aliases and trait profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.functions.parsing import parsed
from credence.operators.knn import nearest
from credence.operators.providers import Model, answered

RECENT_ENTITIES, RECENT_PASSAGES = 10, 3


def canonical(mentions: DataFrame, aliases: DataFrame, column: str = "mention") -> DataFrame:
    """Mentions with their canonical name; an unknown mention stands for itself."""
    known = aliases.select("alias", F.col("canonical").alias("found"))
    return mentions.join(known, F.col(column) == F.col("alias"), "left").select(
        *mentions.columns, F.coalesce("found", F.col(column)).alias("canonical"), F.col("found").isNull().alias("is_new")
    )


def registered(aliases: DataFrame, resolved: DataFrame) -> DataFrame:
    """The alias table with what was resolved (mention, canonical, ordinal); the first resolution of an alias stands."""
    fresh = resolved.groupBy(F.col("mention").alias("alias")).agg(F.min_by("canonical", "ordinal").alias("canonical"))
    return aliases.unionByName(fresh.join(aliases, "alias", "left_anti"))


def profiles(traits: DataFrame) -> DataFrame:
    """canonical and its distinct traits in the order in which they first came: traits(canonical, trait, ordinal)."""
    first = traits.groupBy("canonical", "trait").agg(F.min("ordinal").alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "trait")))
    return first.groupBy("canonical").agg(F.transform(listed, lambda x: x["trait"]).alias("profile"))


def context(passages: DataFrame, by: str, order: str, text: str, n: int = RECENT_PASSAGES) -> DataFrame:
    """Each passage with the ``n`` passages before it; a passage equal to the one before it counts once.

    Counted passages are numbered first, so that each row's frame holds ``n``
    rows at most, however long the history.
    """
    time = Window.partitionBy(by).orderBy(order)
    new = passages.withColumn("new", F.coalesce(F.lag(text).over(time) != F.col(text), F.lit(True)))
    counted = new.withColumn("number", F.sum(F.col("new").cast("int")).over(time) - F.col("new").cast("int"))
    frame = Window.partitionBy(by).orderBy("number").rangeBetween(-n, -1)
    # of equal neighbours only the first is listed; its number is one less than its successor's
    listed = F.collect_list(F.when(F.col("new"), F.struct(F.col("number"), F.col(text)))).over(frame)
    ordered = F.transform(F.array_sort(listed), lambda x: x[text])
    return counted.withColumn("context", ordered).drop("new", "number")


def recent(mentions: DataFrame, by: str, entity: str, order: str, n: int = RECENT_ENTITIES) -> DataFrame:
    """The ``n`` entities of each group that were mentioned last, the latest first."""
    last = mentions.groupBy(by, entity).agg(F.max(order).alias("last"))
    ranked = last.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("last"), entity)))
    return ranked.where(F.col("rank") <= n)


def candidates(mentions: DataFrame, known: DataFrame, recently: DataFrame, k: int) -> DataFrame:
    """For each mention the ``k`` most similar known entities that are not recent (recent ones are listed apart)."""
    others = known.join(recently.select("id").distinct(), "id", "left_anti")
    return nearest(mentions, others, k)


def section(rows: DataFrame, names: str = "content") -> DataFrame:
    """Candidates of each mention as one text for a prompt."""
    listed = F.array_sort(F.collect_list(F.struct("rank", names)))
    lines = F.transform(listed, lambda x: F.concat(F.lit("- "), x[names]))
    return rows.groupBy("query_id").agg(F.array_join(lines, "\n").alias("section"))


def known_first(entities: DataFrame, order: str, k: int) -> DataFrame:
    """The first ``k`` entities by insertion."""
    return entities.orderBy(order).limit(k)


def recent_as_inserted(mentions: DataFrame, by: str, entity: str, order: str, n: int = RECENT_ENTITIES) -> DataFrame:
    """The ``n`` entities of each group that were first mentioned last: a repeated mention does not move an entity."""
    first = mentions.groupBy(by, entity).agg(F.min(order).alias("first"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("first"), entity)))
    return ranked.where(F.col("rank") <= n)


RESOLVE = 'Resolve the mention to one of the candidates or to a full name of its own. Answer as JSON: {"canonical": "..."}.\nMention: '


def resolved(mentions: DataFrame, aliases: DataFrame, found: DataFrame, model: Model, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mention, ordinal and canonical of every mention, and new cache rows.

    A known alias gives its name. For other mentions a model is asked, with the
    context of the mention (mentions: mention, ordinal, context) and the
    candidates' section (found: mention, section); an answer that can't be read
    leaves the mention as it is.
    """
    known = canonical(mentions, aliases)
    asked = known.where("is_new").join(found, "mention", "left")
    prompt = F.concat(
        F.lit(RESOLVE), "mention", F.lit("\nContext: "), F.coalesce("context", F.lit("")), F.lit("\nCandidates:\n"), F.coalesce("section", F.lit(""))
    )
    told, fresh = answered(asked.withColumn("prompt", prompt), cache, model)
    name = F.nullif(F.trim(parsed(F.col("response"), "canonical string")["canonical"]), F.lit(""))
    answers = told.select("mention", "ordinal", F.coalesce(name, F.col("mention")).alias("canonical"))
    return known.where("not is_new").select("mention", "ordinal", "canonical").unionByName(answers), fresh


def dump(aliases: DataFrame, traits: DataFrame) -> DataFrame:
    """The whole registry as text: canonical, and a line with its other names and its traits."""
    names = aliases.where("alias <> canonical").groupBy("canonical").agg(F.array_join(F.array_sort(F.collect_set("alias")), ", ").alias("names"))
    known = aliases.select("canonical").union(traits.select("canonical")).distinct()
    line = F.concat("canonical", F.lit(" ("), F.coalesce("names", F.lit("")), F.lit("): "), F.coalesce(F.array_join("profile", "; "), F.lit("")))
    return known.join(names, "canonical", "left").join(profiles(traits), "canonical", "left").select("canonical", line.alias("line"))
