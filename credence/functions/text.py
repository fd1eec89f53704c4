"""Keys, normal forms and prompts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credence.config import BELIEF, CHUNK, ENTITY, GLOBAL

NO_ANSWER = "[No Answer Received]"
# The spellings that count as true.
TRUE_WORDS = ["yes", "true", "t", "y", "1"]
FALSE_WORDS = ["no", "false", "f", "n", "0"]


def key(prefix: str, content: Column, hashed: bool = False) -> Column:
    """The key of a text in a namespace: prefix and text, or prefix and MD5."""
    return F.concat(F.lit(prefix), F.md5(content.cast("binary")) if hashed else content)


def kind_of(name: Column) -> Column:
    """Node type by key prefix."""
    return F.when(name.startswith(BELIEF), "belief").when(name.startswith(CHUNK), "chunk").otherwise("entity")


def content_of(name: Column) -> Column:
    return F.regexp_replace(name, f"^({ENTITY}|{BELIEF}|{CHUNK})", "")


def plain(text: Column) -> Column:
    """Lower case; what is no ASCII letter, digit or space becomes a space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "))


def normal_answer(text: Column) -> Column:
    """Lower case, ASCII punctuation removed, articles removed as words, single spaces."""
    out = F.regexp_replace(F.lower(text), "[!-/:-@\\[-`{-~]", "")
    out = F.regexp_replace(out, "(?<![\\p{L}\\p{N}_])(a|an|the)(?![\\p{L}\\p{N}_])", " ")
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def alnum_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def present(text: Column) -> Column:
    return F.length(F.trim(text)) > 0


def owner_of(source: Column) -> Column:
    """The speaker, or the global context where none is named."""
    return F.coalesce(F.nullif(source, F.lit("")), F.lit(GLOBAL))


def answer_of(response: Column) -> Column:
    """What follows the first 'Answer:', else all of it; a fixed text if nothing came back."""
    at = F.instr(response, "Answer:")
    found = F.when(at > 0, F.trim(F.substr(response, at + F.lit(len("Answer:"))))).otherwise(response)
    return F.when(F.coalesce(F.length(response), F.lit(0)) == 0, F.lit(NO_ANSWER)).otherwise(found)


def prompt(docs: Column, question: Column, k: int) -> Column:
    """The first ``k`` passages, each under a heading, then the question."""
    parts = F.transform(F.slice(docs, 1, k), lambda d: F.concat(F.lit("Passage: "), d, F.lit("\n\n")))
    return F.concat(F.array_join(parts, ""), F.lit("Question: "), question, F.lit("\nThought: "))


def truth(value: Column) -> Column:
    """A boolean from its usual spellings; null for any other."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def valid_triples(triples: Column) -> Column:
    """Triples of exactly three items, the first of equal ones, in order."""
    return F.array_distinct(F.filter(triples, lambda t: F.size(t) == 3))


def known_triples(triples: Column, entities: Column) -> Column:
    """Triples whose ends are both among the entities, in normal form."""
    names = F.transform(entities, plain)
    return F.filter(triples, lambda t: F.array_contains(names, plain(t[0])) & F.array_contains(names, plain(t[2])))


def first_line(text: Column) -> Column:
    return F.split(text, "\n", 2)[0]


def rest_of(text: Column) -> Column:
    return F.coalesce(F.get(F.split(text, "\n", 2), F.lit(1)), F.lit(""))


def equal_sizes(*arrays: Column) -> Column:
    sizes = [F.size(a) for a in arrays]
    return F.least(*sizes) == F.greatest(*sizes) if len(sizes) > 1 else F.lit(True)


def words(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda w: w != "")


def template(text: str) -> str:
    """``{name}`` placeholders rewritten as ``${name}``; doubled braces stand for themselves."""
    out, k = [], 0
    while k < len(text):
        two = text[k : k + 2]
        if two in ("{{", "}}"):
            out.append(two[0])
            k += 2
        elif text[k] == "$":
            out.append("$$")
            k += 1
        elif text[k] == "{":
            out.append("${")
            k += 1
        else:
            out.append(text[k])
            k += 1
    return "".join(out)
