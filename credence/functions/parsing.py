"""Reading what language models write: JSON with faults, escapes, embedded objects."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CLOSERS = {"{": "}", "[": "]"}
ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")


def repaired(text: str | None) -> str | None:
    """Valid JSON from a truncated object or array, as far as it goes; null if there is nothing to keep.

    The text is read once. After each complete value the state is noted; a text
    that ends elsewhere is cut back to the last note and its brackets are closed.
    """
    if text is None:
        return None
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    # prose before the first bracket goes
    begins = [k for k in (text.find("{"), text.find("[")) if k >= 0]
    if not begins:
        return None
    text = text[min(begins) :]
    out: list[str] = []
    stack: list[str] = []
    good: tuple[int, str] | None = None  # output length after the last complete value, and what closes it
    inside = escaped = is_key = False
    expects_key = False

    def note() -> None:
        nonlocal good
        good = (len(out), "".join(CLOSERS[c] for c in reversed(stack)))

    for at, c in enumerate(text):
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"' and not _closes(text, at + 1, is_key):
                c = '\\"'  # a quote within a text
            elif c == '"':
                inside = False
                out.append(c)
                if not is_key:
                    note()
                continue
            if c == "\n":
                c = "\\n"
            elif c == "\t":
                c = "\\t"
            elif c < " ":
                continue
            out.append(c)
            continue
        out.append(c)
        if c == '"':
            inside, is_key = True, expects_key
        elif c in CLOSERS:
            stack.append(c)
            expects_key = c == "{"
            note()
        elif c in "}]":
            if not stack or CLOSERS[stack[-1]] != c:
                break
            stack.pop()
            note()
            if not stack:
                break
        elif c == ":":
            expects_key = False
        elif c == ",":
            expects_key = bool(stack) and stack[-1] == "{"
            # the value before a comma is complete, whatever its kind
            out.pop()
            note()
            out.append(c)
    tries = []
    if inside and not is_key:
        tries.append("".join(out) + '"' + "".join(CLOSERS[c] for c in reversed(stack)))
    elif not inside:
        tries.append("".join(out) + "".join(CLOSERS[c] for c in reversed(stack)))
    if good:
        tries.append("".join(out[: good[0]]) + good[1])
    for candidate in tries:
        try:
            json.loads(candidate)
            return candidate
        except ValueError:
            continue
    return None


def _closes(text: str, at: int, is_key: bool) -> bool:
    """Whether a quote before ``at`` ends its text: by the sign that follows it."""
    while at < len(text) and text[at] in " \t\r\n":
        at += 1
    return at == len(text) or text[at] in (":" if is_key else ",}]")


def _repair_all(values: pd.Series) -> pd.Series:
    return values.map(repaired, na_action="ignore")


def decoded(text: str) -> str:
    """\\uXXXX sequences as the characters they name; a text with lone surrogates stays as written."""
    out = ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
    try:
        return out.encode("utf-16", "surrogatepass").decode("utf-16")
    except UnicodeDecodeError:
        return text


def _decode_all(values: pd.Series) -> pd.Series:
    return values.map(decoded, na_action="ignore")


def repair_json(value: Column) -> Column:
    return F.pandas_udf(_repair_all, "string")(value)


def decode_escapes(value: Column) -> Column:
    return F.pandas_udf(_decode_all, "string")(value)


def object_with(text: Column, field: str) -> Column:
    """The first JSON object that holds an array under ``field``, as text."""
    return F.nullif(F.regexp_extract(text, f'\\{{[^{{}}]*"{field}"\\s*:\\s*\\[[^\\]]*\\][^{{}}]*\\}}', 0), F.lit(""))


def parsed(text: Column, schema: str) -> Column:
    """A struct from JSON text; null fields where it is faulty."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})
