"""Language models and encoders as exchangeable parts, with deterministic built-in ones."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions.parsing import repaired


class Model(Protocol):
    """Answers prompts. It is sent to the tasks, so it must pickle."""

    def infer(self, prompts: list[str]) -> list[str]: ...


class Encoder(Protocol):
    """Turns texts into vectors of one size."""

    size: int

    def encode(self, texts: list[str], instruction: str = "") -> np.ndarray: ...


class HashingEncoder:
    """Signed feature hashing of words, scaled to length 1; no word gives a zero vector."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str], instruction: str = "") -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in enumerate(texts):
            for word in re.findall(r"[^\W_]+", (text or "").lower()):
                digest = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[row, digest % self.size] += 1 if digest >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class RecordedModel:
    """Replays answers by prompt; an unknown prompt gets an empty answer."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def infer(self, prompts: list[str]) -> list[str]:
        return [self.answers.get(p, "") for p in prompts]


class SentenceModel:
    """Answers statement prompts by rule: every sentence of the passage is a statement, its capitalised words are entities."""

    def infer(self, prompts: list[str]) -> list[str]:
        return [json.dumps({"propositions": self.statements(p.partition("\nPassage: ")[2]), "traits": []}) for p in prompts]

    @staticmethod
    def statements(passage: str) -> list[dict]:
        sentences = [s.strip() for s in passage.replace("\n", " ").split(".")]
        return [
            {"text": s, "entities": sorted(set(re.findall(r"[A-Z][a-z]+", s))), "source": "", "attitude": "states"} for s in sentences if s
        ]


class RuleModel(SentenceModel):
    """Answers every built-in prompt by rule, so that whole chains run without a network.

    Entities are the passage's capitalised words, triples join neighbouring
    entities, a mention resolves to the first candidate of equal letters, an
    answer is the last passage's first word, and a statement contradicts
    evidence that is the same but for a "not".
    """

    def infer(self, prompts: list[str]) -> list[str]:
        return [self.one(p) for p in prompts]

    def one(self, prompt: str) -> str:
        passage = prompt.partition("\nPassage: ")[2] or prompt.partition("\nQuestion: ")[2]
        if prompt.startswith("Split the passage"):
            return json.dumps({"propositions": self.statements(passage), "traits": []})
        if prompt.startswith("List"):
            return json.dumps({"named_entities": list(dict.fromkeys(re.findall("[A-Z][a-z]+", passage)))})
        if prompt.startswith("Give"):
            names = [x for x in prompt.partition("\nEntities: ")[2].partition("\n")[0].split(", ") if x]
            return json.dumps({"triples": [[a, "and", b] for a, b in zip(names, names[1:], strict=False)]})
        if prompt.startswith("Resolve"):
            mention = prompt.partition("\nMention: ")[2].partition("\n")[0]
            known = [x[2:] for x in prompt.partition("\nCandidates:\n")[2].split("\n") if x.startswith("- ")]
            same = [x for x in known if x.lower() == mention.lower()]
            return json.dumps({"canonical": same[0] if same else mention})
        if prompt.startswith("Agent: "):
            said, _, new = prompt.partition("\nEarlier statements:\n")[2].partition("\nNew statement: ")
            new = new.partition("\n")[0]
            old = [x[2:] for x in said.split("\n") if x.startswith("- ")]
            bare = lambda x: " ".join(w for w in x.split() if w != "not")
            against = any(bare(x) == bare(new) and x != new for x in old)
            status = "Inconsistent" if against else "Consistent" if old else "Neutral"
            return json.dumps({"status": status, "reasoning": f"{len(old)} earlier"})
        if "Thought: " in prompt:
            docs = prompt.split("Passage: ")[1:]
            return f"Answer: {(docs[0].split() or ['none'])[0] if docs else 'none'}"
        return passage


class Patient:
    """A model that is asked again after an error, each time after twice the wait; then the answer is empty."""

    def __init__(self, model: Model, tries: int = 3, wait: float = 0.1, most: float = 10.0):
        self.model, self.tries, self.wait, self.most = model, tries, wait, most

    def infer(self, prompts: list[str]) -> list[str]:
        for k in range(self.tries):
            try:
                return self.model.infer(prompts)
            except Exception:  # noqa: BLE001 - any fault of a remote model
                time.sleep(min(self.wait * 2**k, self.most))
        return [""] * len(prompts)


class Timely:
    """A model whose batches may take so many seconds; a late batch has empty answers."""

    def __init__(self, model: Model, seconds: float):
        self.model, self.seconds = model, seconds

    def infer(self, prompts: list[str]) -> list[str]:
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(self.model.infer, prompts).result(self.seconds)
        except TimeoutError:
            return [""] * len(prompts)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)


class JsonModel:
    """A model for batches whose answers are JSON objects with the given keys; others become an object of empty lists."""

    def __init__(self, model: Model, keys: list[str]):
        self.model, self.keys = model, keys

    def infer(self, prompts: list[str]) -> list[str]:
        out = []
        for answer in self.model.infer(prompts):
            value = json.loads(repaired(answer) or "null")
            value = value if isinstance(value, dict) else {}
            out.append(json.dumps({k: value.get(k, []) for k in self.keys}))
        return out


#: What a query is put in before it is encoded, by what it is matched with.
INSTRUCTIONS = {
    "passage": "Given a question, retrieve passages that answer it.",
    "statement": "Given a question, retrieve statements that bear on it.",
    "entity": "Given a name, retrieve other names of the same thing.",
}
DEFAULT_INSTRUCTION = "Given a text, retrieve texts that are related to it."


def instruction_for(kind: str) -> str:
    return INSTRUCTIONS.get(kind, DEFAULT_INSTRUCTION)


def instructed(text: Column, instruction: str) -> Column:
    """The text as an instructed encoder wants it; without an instruction as it is."""
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), text) if instruction else text


def embedding_key(text: Column, instruction: str, model: str, norm: bool) -> Column:
    return F.sha2(F.to_json(F.struct(text.alias("text"), F.lit(instruction).alias("instruction"), F.lit(model).alias("model"), F.lit(norm).alias("norm"))), 256)


def embedded_through(
    texts: DataFrame, column: str, cache: DataFrame, encoder: Encoder, instruction: str = "", model: str = "built-in", norm: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The rows with ``embedding``, and the cache rows (request, embedding) that are new.

    Each distinct text that the cache lacks is encoded once.
    """
    asked = texts.withColumn("request", embedding_key(F.col(column), instruction, model, norm))
    missing = asked.select("request", instructed(F.col(column), instruction).alias("_text")).dropDuplicates(["request"])
    fresh = embedded(missing.join(cache, "request", "left_anti"), "_text", encoder, instruction).select("request", "embedding")
    known = cache.select("request", "embedding").unionByName(fresh)
    return asked.join(known, "request", "left").drop("request"), fresh


def usage(prompts: DataFrame, cache: DataFrame, name: str = "built-in", seed: int = 0, temperature: float = 0.0) -> DataFrame:
    """One row: requests, how many of them the cache answers, and the words of the others' prompts."""
    asked = prompts.select("prompt", request_key(F.col("prompt"), name, seed, temperature).alias("request"))
    seen = asked.join(cache.select("request", F.lit(True).alias("hit")).dropDuplicates(["request"]), "request", "left")
    n_words = F.size(F.filter(F.split("prompt", "\\s+"), lambda w: w != ""))
    return seen.agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.count_if("hit").alias("n_hits"),
        F.coalesce(F.sum(F.when(F.col("hit").isNull(), n_words)), F.lit(0)).alias("prompt_words"),
    )


def embedded(texts: DataFrame, column: str, encoder: Encoder, instruction: str = "") -> DataFrame:
    """The rows with an ``embedding`` column; the encoder sees Arrow batches."""

    @F.pandas_udf("array<double>")
    def encode(values: pd.Series) -> pd.Series:
        return pd.Series(list(encoder.encode(values.fillna("").tolist(), instruction)))

    return texts.withColumn("embedding", encode(F.col(column)))


def request_key(prompt: Column, model: str, seed: int, temperature: float) -> Column:
    """The cache key of a request: SHA-256 of its sorted JSON."""
    request = F.struct(
        prompt.alias("messages"), F.lit(model).alias("model"), F.lit(seed).alias("seed"), F.lit(temperature).alias("temperature")
    )
    return F.sha2(F.to_json(request), 256)


def answered(
    prompts: DataFrame, cache: DataFrame, model: Model, name: str = "built-in", seed: int = 0, temperature: float = 0.0,
    retries: int = 3, must_hold: str | None = None, use_cache: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Answers to ``prompts(prompt)``, and the cache rows (request, response) that are new.

    Each distinct prompt that the cache lacks is asked once, and again up to
    ``retries`` times while its answer is empty or lacks ``must_hold``; then the
    last answer stands.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = model.infer(batch["prompt"].tolist())
            for _ in range(retries):
                again = [k for k, a in enumerate(answers) if not a or (must_hold and must_hold not in a)]
                if not again:
                    break
                for k, answer in zip(again, model.infer([batch["prompt"].iloc[k] for k in again]), strict=True):
                    answers[k] = answer
            yield pd.DataFrame({"request": batch["request"], "response": answers})

    asked = prompts.withColumn("request", request_key(F.col("prompt"), name, seed, temperature))
    distinct = asked.select("request", "prompt").dropDuplicates(["request"])
    missing = distinct.join(cache, "request", "left_anti") if use_cache else distinct
    fresh = missing.mapInPandas(ask, "request string, response string")
    known = fresh.unionByName(cache.select("request", "response")) if use_cache else fresh
    return asked.join(known, "request", "left").drop("request"), fresh
