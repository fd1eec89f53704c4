"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base finds e-mail addresses, IP addresses, payment cards and phone numbers
by pattern. The model adds what patterns miss: secrets (access keys, passwords,
tokens) and unusual spellings of the base kinds. It scores whole candidate
spans of up to LONGEST tokens by features of the span's text and neighbours;
dynamic programming over the spans of a passage chooses boundaries and types
jointly. Spans of the base stay, and added spans never touch them.

The model is trained here, by maximum likelihood, on generated sentences with
known spans. It reads the passages around digits, @, =, spelt-out dots, cue
words with a colon and key prefixes; elsewhere there is nothing that its
features could score. A passage of more than PIECE tokens is decoded in pieces
that overlap, so memory is bounded; in the middle of an overlap the labels no
longer depend on where a piece begins.

Positions are code points, ends exclusive. Defined results: a null or empty
text has no spans and stays as it is; repeated rows each get their row; an
empty table gives no rows. ``found`` reads doc_id and text only; ``redacted``
keeps all columns.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import flat_bytes, text_groups

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret"]
LONGEST = 5
SENTENCES = 300
EPOCHS = 8
SEED = 7

# ---------------------------------------------------------------- base patterns
# A digit run can only match from its first digit, and possessive repeats give
# up nothing that would match, so each scan is linear in the text.
MAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MAIL_RIGHT = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every @ with a domain after it and, back to the last match, a name before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        right = MAIL_RIGHT.match(text, at + 1)
        start = at
        if right:
            while start > done and text[start - 1] in MAIL_LEFT:
                start -= 1
        if start < at:
            yield start, right.end()
            done = right.end()
            at = text.find("@", done)
        else:
            # what lies before this @ can't be part of a later name
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base, by start and then kind."""
    out = [(a, b, "email") for a, b in _emails(text)]
    if IP_HINT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


IP_HINT = re.compile("[0-9]")

# ---------------------------------------------------------------- features of spans
OPEN, CLOSE = "\"'<[{", ",.;:!?\"'>]})"
WORDS_BEFORE = {
    "phone": {"call", "tel", "phone", "mobile", "fax", "dial", "number"},
    "card": {"card", "visa", "credit", "debit", "pay"},
    "ip": {"ip", "host", "server", "address", "from"},
    "key": {"password", "passwd", "token", "secret", "key", "="},
    "mail": {"mail", "email", "e-mail", "contact", "write"},
}
OCTETS = re.compile(r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}")
SIX = re.compile(r"(?:[0-9a-fA-F]{0,4}:){3,7}[0-9a-fA-F]{1,4}")
MAIL = re.compile(r"[^\s@]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# between the parts stands a space or a bracket, which no part holds, so each part ends in one place only
SPELT_MAIL = re.compile(
    r"[a-z0-9._-]++(?:@| (?:at|@) | ?[\[(](?:at|@)[\])] ?)[a-z0-9-]++(?:(?: dot | ?[\[(]dot[\])] ?)[a-z]++)++", re.I
)
AREA = re.compile(r"\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}")
QUADS = re.compile(r"\d{4}([ .-]?)\d{4}\1\d{4}\1\d{1,7}")
ACCESS = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}")
NAMED = re.compile(r"(?:password|passwd|pwd|secret|token|api_?key)\s*[=:]\s*[\"']?[^\s\"']{6,}[\"']?", re.I)
PREFIXED = re.compile(r"(?:gh[pousr]_|sk-|xox[abp]-)[0-9A-Za-z_-]{16,}")
HEX = re.compile(r"[0-9a-f]{16,}")
DATE = re.compile(r"\d{4}-\d\d-\d\d|\d\d?[/.]\d\d?[/.]\d{2,4}|\d\d?:\d\d")
AMOUNT = re.compile(r"[$€£]?\d{1,3}(?:,\d{3})*(?:\.\d+)?%?|v?\d+(?:\.\d+){1,2}")

FEATURES = [
    "one", "two", "three", "four", "five", "letters", "digits_0", "digits_few", "digits_phone", "digits_card", "digits_many",
    "octets", "six", "mail", "spelt_mail", "area", "plus", "quads", "luhn", "access", "named", "prefixed", "hex",
    "mixed_case_digits", "quoted", "date", "amount", *(f"after_{x}" for x in WORDS_BEFORE), "before_quote",
]
INDEX = {name: k for k, name in enumerate(FEATURES)}


def span_features(text: str, count: int, before: str) -> list[int]:
    """Numbers of the features that a span of ``count`` tokens has."""
    digits = sum(c.isdigit() for c in text)
    plain = NOT_DIGIT.sub("", text)
    found = [["one", "two", "three", "four", "five"][count - 1]]
    if digits == 0:
        found.append("digits_0")
        if text.replace(" ", "").isalpha():
            found.append("letters")
    else:
        found.append(
            "digits_few" if digits < 7 else "digits_phone" if digits <= 11 else "digits_card" if digits <= 19 else "digits_many"
        )
        for name, pattern in (("octets", OCTETS), ("area", AREA), ("quads", QUADS), ("date", DATE), ("amount", AMOUNT)):
            if pattern.fullmatch(text):
                found.append(name)
        if text[0] == "+":
            found.append("plus")
        if 12 <= len(plain) <= 19 and luhn(plain):
            found.append("luhn")
        if len(text) >= 16 and text.isalnum() and not text.isdigit() and text.isupper():
            found.append("mixed_case_digits")
    for name, pattern in (("six", SIX), ("mail", MAIL), ("spelt_mail", SPELT_MAIL), ("access", ACCESS), ("named", NAMED), ("prefixed", PREFIXED), ("hex", HEX)):
        if pattern.fullmatch(text):
            found.append(name)
    word = before.strip(OPEN + CLOSE).lower() or before
    found += [f"after_{name}" for name, words in WORDS_BEFORE.items() if word in words]
    return [INDEX[x] for x in found]


Token = tuple[int, int]


def _cores(text: str, tokens: list[Token]) -> list[Token]:
    """The tokens without quotes and brackets before them and punctuation after them."""
    out = []
    for a, b in tokens:
        while a < b - 1 and text[a] in OPEN:
            a += 1
        while b > a + 1 and text[b - 1] in CLOSE:
            b -= 1
        out.append((a, b))
    return out


def segment_features(text: str, tokens: list[Token]) -> dict[tuple[int, int], list[int]]:
    """Features of every span of up to LONGEST tokens, by first token and count."""
    cores = _cores(text, tokens)
    out = {}
    for i in range(len(tokens)):
        before = text[slice(*tokens[i - 1])] if i else ""
        for count in range(1, min(LONGEST, len(tokens) - i) + 1):
            a, b = cores[i][0], cores[i + count - 1][1]
            found = span_features(text[a:b], count, before)
            if a and text[a - 1] in "\"'":
                found.append(INDEX["quoted"])
            out[i, count] = found
    return out


# ---------------------------------------------------------------- the random field
LABELS = ["other", *KINDS]


def _scores(features: dict, n: int, weights: np.ndarray) -> np.ndarray:
    """Score of label y for the span that ends after token i and has d tokens: [i, d, y]."""
    out = np.full((n + 1, LONGEST + 1, len(LABELS)), -np.inf)
    for (i, count), found in features.items():
        out[i + count, count] = weights[:, found].sum(axis=1)
        if count > 1:
            out[i + count, count, 0] = -np.inf  # what is no entity goes token by token
    return out


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    return np.log(np.exp(x - top).sum(axis=axis) + 1e-300) + np.squeeze(top, axis)


def _gradient(features: dict, n: int, gold: list[tuple[int, int, int]], weights: np.ndarray, moves: np.ndarray):
    """Gradient of the log-likelihood of the gold spans (first token, count, label)."""
    scores = _scores(features, n, weights)
    k = len(LABELS)
    ahead = np.full((n + 1, k), -np.inf)  # all ways to token i whose last span has label y
    entry = np.full((n + 1, k), -np.inf)  # the same, moved on to the next span's label
    entry[0] = 0
    for i in range(1, n + 1):
        d = np.arange(1, min(LONGEST, i) + 1)
        ahead[i] = _logsumexp(scores[i, d] + entry[i - d], axis=0)
        entry[i] = _logsumexp(ahead[i][:, None] + moves, axis=0)
    total = _logsumexp(ahead[n], axis=0)
    back = np.full((n + 1, k), -np.inf)  # all ways from token i on, after a span of label y
    back[n] = 0
    for i in range(n - 1, -1, -1):
        d = np.arange(1, min(LONGEST, n - i) + 1)
        start = _logsumexp(scores[i + d, d] + back[i + d], axis=0)
        back[i] = _logsumexp(moves + start[None, :], axis=1)
    slope_w, slope_m = np.zeros_like(weights), np.zeros_like(moves)
    for (i, count), found in features.items():
        p = np.exp(scores[i + count, count] + entry[i] + back[i + count] - total)
        slope_w[:, found] -= p[:, None]
    for i in range(1, n):
        d = np.arange(1, min(LONGEST, n - i) + 1)
        start = _logsumexp(scores[i + d, d] + back[i + d], axis=0)
        slope_m -= np.exp(ahead[i][:, None] + moves + start[None, :] - total)
    last = None
    for i, count, label in gold:
        slope_w[label, features[i, count]] += 1
        if last is not None:
            slope_m[last, label] += 1
        last = label
    return slope_w, slope_m


def decoded(features: dict, n: int, weights: np.ndarray, moves: np.ndarray) -> list[tuple[int, int, int]]:
    """The best spans (first token, count, label)."""
    scores = _scores(features, n, weights)
    k = len(LABELS)
    entry = np.zeros((n + 1, k))
    came = np.zeros((n + 1, k), np.int64)  # label before the span that begins here
    best = np.full((n + 1, k), -np.inf)
    size = np.zeros((n + 1, k), np.int64)
    for i in range(1, n + 1):
        d = np.arange(1, min(LONGEST, i) + 1)
        ways = scores[i, d] + entry[i - d]
        size[i] = d[ways.argmax(axis=0)]
        best[i] = ways.max(axis=0)
        moved = best[i][:, None] + moves
        came[i], entry[i] = moved.argmax(axis=0), moved.max(axis=0)
    out = []
    i, label = n, int(best[n].argmax())
    while i > 0:
        count = int(size[i, label])
        out.append((i - count, count, label))
        i -= count
        label = int(came[i, label])
    return out[::-1]


# ---------------------------------------------------------------- training sentences
def _filler(rng: random.Random) -> str:
    word = "".join(rng.choice("bcdfghlmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    return rng.choice([word, word, word + rng.choice(["s", "n", "t"]), word.capitalize(), word + rng.choice([",", ".", ";"])])


def _number(rng: random.Random) -> str:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice(
        [
            str(rng.randint(1, 99)), f"{rng.randint(1, 9)}.", f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.", str(rng.randint(1900, 2030)),
            f"{rng.randint(1, 900)},{d(3)}", f"20{d(2)}-0{rng.randint(1, 9)}-1{d(1)}", f"{rng.randint(1, 12)}:{rng.randint(10, 59)}",
            f"v{d(1)}.{d(1)}.{d(1)}", f"{d(2)}%", f"${d(3)}", d(6), d(8), f"x={d(1)}", f"{d(1)}+{d(1)}", "=", f"a{d(1)}", _no_card(rng),
        ]
    )


def _no_card(rng: random.Random) -> str:
    while True:
        digits = "".join(rng.choice("0123456789") for _ in range(rng.choice([13, 15, 16])))
        if not luhn(digits):
            return digits


def _card(rng: random.Random) -> str:
    body = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(14))
    digits = next(body + c for c in "0123456789" if luhn(body + c))
    gap = rng.choice(["", "-", " ", "."])
    return gap.join(digits[k : k + 4] for k in range(0, 16, 4))


def _entity(rng: random.Random) -> tuple[str, str]:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    h = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    name = _filler(rng).strip(",.;").lower()
    host = _filler(rng).strip(",.;").lower()
    kind = rng.choice(KINDS)
    forms = {
        "email": [f"{name}.{d(2)}@{host}.com", f"{name}@{host}.example.org", f"{name} [at] {host} [dot] com", f"{name} at {host} dot org", f"{name} AT {host} DOT com"],
        "ip": [".".join(str(rng.randint(0, 255)) for _ in range(4)), ":".join(h(4) for _ in range(8))],
        "card": [_card(rng)],
        "phone": [f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"],
        "secret": [f"AKIA{upper(16)}", f"password={h(18)}", f"passwd={h(12)}", f'"{h(40)}"', h(40), f"ghp_{upper(20)}", f"secret={h(16)}",
                   f"password: {name}{host}word", f"token: {h(16)}", f"sk-{name}{host}wordsandmore"],
    }
    return kind, rng.choice(forms[kind])


def sentence(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A generated text and its spans."""
    parts: list[tuple[str, str | None]] = []
    for _ in range(rng.randint(5, 9)):
        parts.append((_filler(rng), None))
        roll = rng.random()
        if roll < 0.25:
            parts.append((_number(rng), None))
        elif roll < 0.5:
            kind, text = _entity(rng)
            if rng.random() < 0.4:
                cue = {"secret": "key", "email": "mail"}.get(kind, kind)
                parts.append((rng.choice(sorted(WORDS_BEFORE[cue])), None))
            if text[0] == '"':
                parts += [("token", None), ("=", None)]
            parts.append((text, kind))
    text, spans = "", []
    for word, kind in parts:
        text += " " if text else ""
        if kind:
            inner = word.strip('"')
            at = len(text) + word.index(inner)
            spans.append((at, at + len(inner), kind))
            word += rng.choice(["", "", ",", "."])
        text += word
    return text, spans


TOKEN = re.compile(r"\S+")


@functools.cache
def model(sentences: int = SENTENCES, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Weights by label and feature, and scores of neighbouring labels (AdaGrad, light ridge)."""
    rng = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, spans = sentence(rng)
        tokens = [m.span() for m in TOKEN.finditer(text)]
        gold, k = [], 0
        while k < len(tokens):
            span = next((s for s in spans if tokens[k][0] <= s[0] < tokens[k][1]), None)
            count = 1
            if span:
                count = sum(1 for t in tokens[k:] if t[0] < span[1])
            gold.append((k, count, LABELS.index(span[2]) if span else 0))
            k += count
        data.append((segment_features(text, tokens), len(tokens), gold))
    weights, moves = np.zeros((len(LABELS), len(FEATURES))), np.zeros((len(LABELS), len(LABELS)))
    sums = [np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)]
    for _ in range(epochs):
        rng.shuffle(data)
        for features, n, gold in data:
            for value, slope, total in zip((weights, moves), _gradient(features, n, gold, weights, moves), sums, strict=True):
                slope = slope - 1e-3 * value
                total += slope**2
                value += 0.5 * slope / np.sqrt(total)
    return weights, moves


# ---------------------------------------------------------------- reading documents
CUES = r"(?:password|passwd|pwd|secret|token|api_?key)[ \t]?:|(?:gh[pousr]_|sk-|xox[abp]-)[a-z_-]{16}"
SPELT = r"[\[( ]dot[\]) ]"
TRIGGER = re.compile(f"[0-9@=]|(?i:{SPELT}|{CUES})")
SIGNS = np.zeros(256, bool)
SIGNS[[*range(0x30, 0x3A), 0x40, 0x3D, 0x2B]] = True
MARGIN = 3
#: Tokens decoded at once, and by how many two such pieces of a longer passage overlap.
PIECE, OVERLAP = 2048, 64


def passages(text: str) -> Iterator[list[Token]]:
    """Runs of tokens around triggers, with MARGIN tokens on either side."""
    held: list[Token] = []
    quiet, live = 0, False
    hit = TRIGGER.search(text)
    while hit:
        start = hit.start()
        # back to the beginning of the hit's token, and over MARGIN tokens before it. After a
        # passage come more quiet tokens than that, so no token is gone over more than twice
        for k in range(MARGIN + 1):
            while k and start and text[start - 1].isspace():
                start -= 1
            while start and not text[start - 1].isspace():
                start -= 1
        held, quiet, live, end = [], 0, False, len(text)
        for m in TOKEN.finditer(text, start):
            held.append(m.span())
            if TRIGGER.search(text, max(0, m.start() - 1), min(len(text), m.end() + 2)):
                quiet, live = 0, True
            elif live:
                quiet += 1
                if quiet > MARGIN:
                    end = m.end()
                    break
        yield held
        hit = TRIGGER.search(text, max(end, hit.end()))


def _pieces(tokens: list[Token]) -> Iterator[tuple[list[Token], int, int]]:
    """A passage in pieces of bounded size: tokens, and the first and the end of those whose spans count."""
    at = 0
    while True:
        part = tokens[at : at + PIECE]
        last = at + PIECE >= len(tokens)
        yield part, OVERLAP // 2 if at else 0, len(part) if last else PIECE - OVERLAP // 2
        if last:
            return
        at += PIECE - OVERLAP


def modelled(text: str, tokens: list[Token], weights: np.ndarray, moves: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """The spans that the model finds in a passage, in order of their start."""
    for part, low, high in _pieces(tokens):
        features = segment_features(text, part)
        cores = _cores(text, part)
        for i, count, label in decoded(features, len(part), weights, moves):
            if label and low <= i < high:
                yield cores[i][0], cores[i + count - 1][1], LABELS[label]


def all_spans(text: str, weights: np.ndarray, moves: np.ndarray) -> tuple[list, list]:
    """The base spans, and all spans: the base and those the model adds."""
    base = base_spans(text)
    starts = [a for a, _, _ in base]
    # how far the spans up to each one reach
    reach = list(itertools.accumulate((b for _, b, _ in base), max))
    added, done = [], 0
    for tokens in passages(text):
        for a, b, kind in modelled(text, tokens, weights, moves):
            before = bisect.bisect_left(starts, b)
            if a >= done and (not before or reach[before - 1] <= a):
                added.append((a, b, kind))
                done = b
    return base, sorted((*base, *added), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _spelled(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _each(batch: pa.RecordBatch, weights: np.ndarray, moves: np.ndarray) -> Iterator[tuple[str | None, list, list]]:
    """Text, base spans and all spans of each row; rows without any sign are not searched."""
    column = batch.column("text")
    spelt = pc.fill_null(pc.match_substring_regex(column, f"(?i)(?:{SPELT}|{CUES})"), False)
    for a, b in text_groups(column):
        data, offsets = flat_bytes(column.slice(a, b - a))
        marks = np.concatenate(([0], np.cumsum(SIGNS[data])))
        signs = marks[offsets[1:]] > marks[offsets[:-1]]
        for k, text in enumerate(column.slice(a, b - a).to_pylist()):
            if signs[k] or spelt[a + k].as_py():
                yield text, *all_spans(text, weights, moves)
            else:
                yield text, [], []


def found(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans."""
    weights, moves = model()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spelled = [], [], []
            for _, base, spans in _each(batch, weights, moves):
                counts.append([sum(kind == k for _, _, kind in base) for k in BASE])
                digests.append(hashlib.sha256(_spelled(base).encode()).hexdigest())
                spelled.append(_spelled(spans))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([c[k] for c in counts], pa.int64()) for k in range(len(BASE))),
                    pa.array(digests, pa.string()),
                    pa.array(spelled, pa.string()),
                ],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return narrow.mapInArrow(find, f"doc_id long, {counts}, base_sha256 string, spans string")


def blanked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame) -> DataFrame:
    """All documents with their spans blanked, with the columns of ``docs``; n_chars follows the text."""
    weights, moves = model()
    names = docs.columns

    def blank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [blanked(text, spans) if spans else text for text, _, spans in _each(batch, weights, moves)]
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.array(texts, batch.column("text").type)
            if "n_chars" in columns:
                size = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
                columns["n_chars"] = pc.if_else(pc.is_null(size), columns["n_chars"], size)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return docs.mapInArrow(blank, docs.schema)
