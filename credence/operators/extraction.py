"""Beliefs, traits and triples from passages, by any model that answers in JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.config import BELIEF, CHUNK
from credence.functions.parsing import parsed, repair_json
from credence.functions.text import key, known_triples, owner_of, present, valid_triples
from credence.operators.providers import Model, answered
from credence.session import settled

ENTITIES = "named_entities array<string>"
STATEMENTS = (
    "propositions array<struct<text:string,entities:array<string>,source:string,attitude:string>>, "
    "traits array<struct<entity:string,trait:string>>"
)
TRIPLES = "triples array<array<string>>"

# Prompts of our own; $passage, $entities and $context are filled in.
PROMPTS = {
    "entities": 'List the named entities of the passage as JSON: {"named_entities": [...]}.\nPassage: $passage',
    "entities_strict": 'List only people, organisations and places of the passage as JSON: {"named_entities": [...]}.\nPassage: $passage',
    "query_entities": 'List the named entities of the question as JSON: {"named_entities": [...]}.\nQuestion: $passage',
    "statements": (
        "Split the passage into statements, each with the entities it names, who makes it and with what attitude, and list "
        'lasting traits of entities. Answer as JSON: {"propositions": [{"text", "entities", "source", "attitude"}], '
        '"traits": [{"entity", "trait"}]}.\nEntities: $entities\nPassage: $passage'
    ),
    "triples": 'Give (subject, relation, object) triples over the entities as JSON: {"triples": [[...]]}.\nEntities: $entities\nPassage: $passage',
    "triples_in_context": 'Give triples that the context supports as JSON: {"triples": [[...]]}.\nContext: $context\nPassage: $passage',
    "entities_all": 'List every name and term of the passage as JSON: {"named_entities": [...]}.\nPassage: $passage',
    "reason_steps": "Read the passages and give one step of the reasoning at a time.\n$context\nQuestion: $passage",
    "repair": "Correct this JSON and answer with nothing else: $passage",
    "answer": "Read the passages, think, and end with 'Answer:' and a short answer.\n$context\nQuestion: $passage",
    "reason": "Read the passages and give the next thought; write 'So the answer is:' once it is known.\n$context\nQuestion: $passage",
}


def filled(name: str, **columns: Column) -> Column:
    """A prompt as a column; every variable of the prompt must be given."""
    text = PROMPTS[name]
    out, rest = [], text
    while "$" in rest:
        head, _, rest = rest.partition("$")
        variable = next((v for v in ("passage", "entities", "context") if rest.startswith(v)), None)
        if variable is None or variable not in columns:
            raise KeyError(f"prompt {name} needs {variable or rest[:10]}")
        out += [F.lit(head), F.coalesce(columns[variable], F.lit(""))]
        rest = rest[len(variable) :]
    return F.concat(*out, F.lit(rest))


def read_statements(answers: DataFrame) -> DataFrame:
    """chunk_key, propositions and traits from (chunk_key, response); faulty JSON is repaired or counts as empty."""
    value = parsed(repair_json(F.col("response")), STATEMENTS)
    empty = F.array()
    return answers.select("chunk_key", value.alias("v")).select(
        "chunk_key",
        F.coalesce(F.filter("v.propositions", lambda p: present(p["text"])), empty).alias("propositions"),
        F.coalesce(F.filter("v.traits", lambda t: present(t["entity"]) & present(t["trait"])), empty).alias("traits"),
    )


def read_entities(answers: DataFrame) -> DataFrame:
    value = parsed(repair_json(F.col("response")), ENTITIES)
    return answers.select("chunk_key", F.coalesce(F.array_distinct(value["named_entities"]), F.array()).alias("entities"))


def read_triples(answers: DataFrame) -> DataFrame:
    """Valid triples over the passage's entities: answers(chunk_key, entities, response)."""
    value = parsed(repair_json(F.col("response")), TRIPLES)
    found = valid_triples(F.coalesce(value["triples"], F.array()))
    return answers.select("chunk_key", known_triples(found, F.col("entities")).alias("triples"))


def merged(chunks: DataFrame, entities: DataFrame, statements: DataFrame, triples: DataFrame | None = None) -> DataFrame:
    """One extraction record a chunk: idx, passage, extracted_entities, extracted_triples, propositions, traits."""
    none = F.array().cast("array<array<string>>")
    joined = chunks.join(entities, "chunk_key").join(statements, "chunk_key", "left")
    joined = joined.withColumn("triples", none) if triples is None else joined.join(triples, "chunk_key", "left")
    return (
        joined.select(
            F.col("chunk_key").alias("idx"),
            F.col("content").alias("passage"),
            F.array_sort(F.array_distinct("entities")).alias("extracted_entities"),
            valid_triples(F.coalesce("triples", none)).alias("extracted_triples"),
            F.coalesce("propositions", F.array()).alias("propositions"),
            F.coalesce("traits", F.array()).alias("traits"),
        )
    )


def beliefs_of(records: DataFrame) -> DataFrame:
    """chunk_key, prop_key and the statement of every proposition."""
    each = records.select(F.col("idx").alias("chunk_key"), F.explode("propositions").alias("p"))
    return each.select(
        "chunk_key",
        key(BELIEF, F.col("p.text")).alias("prop_key"),
        F.col("p.text").alias("text"),
        F.coalesce("p.entities", F.array()).alias("entities"),
        owner_of(F.col("p.source")).alias("source"),
        F.col("p.attitude").alias("attitude"),
    )


def chunk_entities(records: DataFrame) -> DataFrame:
    """chunk_key and the distinct entities of its propositions, sorted."""
    names = F.flatten(F.transform("propositions", lambda p: F.coalesce(p["entities"], F.array())))
    return records.select(F.col("idx").alias("chunk_key"), F.array_sort(F.array_distinct(names)).alias("entities"))


def passages_of_beliefs(beliefs: DataFrame) -> DataFrame:
    return beliefs.groupBy("prop_key").agg(F.array_sort(F.collect_set("chunk_key")).alias("passages"))


def averages(records: DataFrame) -> DataFrame:
    """Mean characters and words of the extracted entities, four places, 0 if there are none."""
    each = records.select(F.explode("extracted_entities").alias("e"))
    n = F.nullif(F.count(F.lit(1)), F.lit(0))
    chars = F.sum(F.length("e")) / n
    tokens = F.sum(F.size(F.filter(F.split("e", "\\s+"), lambda w: w != ""))) / n
    return each.agg(
        F.coalesce(F.round(chars, 4), F.lit(0.0)).alias("avg_chars"), F.coalesce(F.round(tokens, 4), F.lit(0.0)).alias("avg_words")
    )


def chunk_keys(contents: DataFrame) -> DataFrame:
    return contents.select(key(CHUNK, F.col("content")).alias("chunk_key"), "content").dropDuplicates(["chunk_key"])


def entities_of(chunks: DataFrame, model: Model, cache: DataFrame, prompt: str = "entities") -> tuple[DataFrame, DataFrame]:
    """chunk_key and entities of every chunk, and new cache rows.

    An answer that holds no object even after repair is given to the model
    once more, to be corrected; what is then still faulty counts as empty.
    """
    told, fresh = answered(chunks.withColumn("prompt", filled(prompt, passage=F.col("content"))), cache, model)
    told = told.withColumn("response", repair_json(F.col("response")))
    faulty = told.where("response is null").drop("response", "prompt")
    fixed, more = answered(faulty.withColumn("prompt", filled("repair", passage=F.col("content"))), cache, model)
    columns = ["chunk_key", "response"]
    return read_entities(told.where("response is not null").select(*columns).union(fixed.select(*columns))), fresh.unionByName(more)


def extracted(chunks: DataFrame, model: Model, cache: DataFrame, with_triples: bool = False) -> tuple[DataFrame, DataFrame]:
    """Extraction records of chunks (chunk_key, content), and new cache rows: entities, then statements over them, then triples.

    Each stage is settled before the next asks, so no prompt is asked twice.
    """
    entities, first = entities_of(chunks, model, cache)
    entities = settled(entities)
    named = chunks.join(entities, "chunk_key").withColumn("names", F.array_join("entities", ", "))
    told, second = answered(named.withColumn("prompt", filled("statements", passage=F.col("content"), entities=F.col("names"))), cache, model)
    statements = settled(read_statements(told))
    fresh = first.unionByName(second)
    triples = None
    if with_triples:
        text = F.array_join(F.transform("propositions", lambda p: p["text"]), ". ")
        over = named.join(statements, "chunk_key").withColumn("prompt", filled("triples", passage=text, entities=F.col("names")))
        told, third = answered(over, cache, model)
        triples, fresh = settled(read_triples(told)), fresh.unionByName(third)
    return merged(chunks, entities, statements, triples), fresh


def triple_entities(triples: DataFrame) -> DataFrame:
    """The distinct entities of triples (array of three), sorted by name."""
    return triples.select(F.explode(F.array(F.col("triple")[0], F.col("triple")[2])).alias("entity")).distinct()


def triple_relations(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("triple")[1].alias("relation")).distinct()


def facts(records: DataFrame) -> DataFrame:
    """The distinct triples of all records."""
    return records.select(F.explode("extracted_triples").alias("triple")).distinct()


def prompt_table(names: list[str] | None = None) -> list[tuple[str, str]]:
    """Names of the prompts and the variables that each needs, in alphabetical order."""
    return sorted((n, ",".join(sorted(set(re.findall(r"\$(passage|entities|context)", PROMPTS[n]))))) for n in names or PROMPTS)


def reasoned(questions: DataFrame, model: Model, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next thought on each question (query_id, question, context), whether it holds the answer, and new cache rows."""
    asked = questions.withColumn("prompt", filled("reason", passage=F.col("question"), context=F.col("context")))
    told, fresh = answered(asked, cache, model)
    done = F.contains("response", F.lit("So the answer is:"))
    return told.select("query_id", F.coalesce("response", F.lit("")).alias("thought"), F.coalesce(done, F.lit(False)).alias("done")), fresh
