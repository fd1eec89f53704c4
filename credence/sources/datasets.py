"""Question sets, corpora and extraction records from JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.config import CHUNK
from credence.functions.text import key
from credence.operators.extraction import averages

CORPUS = "title string, text string"
#: The union of the three layouts in which question sets come.
QUESTIONS = (
    "id string, question string, answer string, gold_ans string, reference string, obj string, answer_aliases array<string>, "
    "possible_answers array<string>, o_aliases array<string>, supporting_facts array<array<string>>, "
    "context string, contexts array<struct<title:string,text:string,is_supporting:boolean>>, "
    "paragraphs array<struct<title:string,text:string,paragraph_text:string,is_supporting:boolean>>"
)
RECORDS = (
    "idx string, passage string, extracted_entities array<string>, extracted_triples array<array<string>>, "
    "propositions array<struct<text:string,entities:array<string>,source:string,attitude:string>>, "
    "traits array<struct<entity:string,trait:string>>"
)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """chunk documents: title and text on a line each."""
    rows = spark.read.schema(CORPUS).option("multiLine", True).json(path)
    return rows.select(F.concat_ws("\n", "title", "text").alias("content")).withColumn("chunk_key", key(CHUNK, F.col("content")))


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).option("multiLine", True).json(path)


def gold_docs(sentence_join: str = " ") -> Column:
    """Gold documents of a question, from whichever layout it has; without repeats."""
    facts = F.transform("supporting_facts", lambda f: f[0])
    pairs = F.from_json("context", "array<array<string>>")
    sentences = lambda p: F.array_join(F.from_json(p[1], "array<string>"), sentence_join)
    by_fact = F.transform(F.filter(pairs, lambda p: F.array_contains(facts, p[0])), lambda p: F.concat(p[0], F.lit("\n"), sentences(p)))
    titled = lambda title, text: F.concat(title, F.lit("\n"), text)
    by_context = F.transform(F.filter("contexts", lambda c: c["is_supporting"]), lambda c: titled(c["title"], c["text"]))
    by_paragraph = F.transform(
        F.filter("paragraphs", lambda p: F.coalesce(p["is_supporting"], F.lit(True))),
        lambda p: titled(p["title"], F.coalesce(p["text"], p["paragraph_text"])),
    )
    return F.array_distinct(F.coalesce(by_fact, by_context, by_paragraph, F.array().cast("array<string>")))


def gold_answers() -> Column:
    """Gold answers of a question with its aliases; without repeats."""
    one = F.coalesce("answer", "gold_ans", "reference", "obj", F.lit(""))
    none = F.array().cast("array<string>")
    more = [F.coalesce(c, none) for c in ("answer_aliases", "possible_answers", "o_aliases")]
    return F.array_distinct(F.concat(F.array(one), *more))


def qa_dataset(spark: SparkSession, path: str) -> DataFrame:
    """question, gold_docs and gold_answers of a question set; a question without gold has one empty string."""
    empty = F.array(F.lit(""))
    filled = lambda c: F.when(F.size(c) > 0, c).otherwise(empty)
    return questions(spark, path).select("id", "question", filled(gold_docs()).alias("gold_docs"), filled(gold_answers()).alias("gold_answers"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Extraction records, keyed again by their passage."""
    return spark.read.schema(RECORDS).json(f"{path}/docs").withColumn("idx", key(CHUNK, F.col("passage")))


def write_records(rows: DataFrame, path: str) -> None:
    """Add extraction records, and write the averages over all that are there beside them."""
    rows.write.mode("append").json(f"{path}/docs")
    every = rows.sparkSession.read.schema(RECORDS).json(f"{path}/docs")
    averages(every).coalesce(1).write.mode("overwrite").json(f"{path}/averages")


def unextracted(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks without an extraction record."""
    return chunks.join(known.select(F.col("idx").alias("chunk_key")), "chunk_key", "left_anti")
