"""Suffix-array deduplication: repeated byte strings by distributed prefix doubling.

Every byte covered by a string of LENGTH bytes that also starts earlier (in a
document of smaller id, or earlier in the same document) is removed.

Prefix doubling ranks positions by their first 2, 4, 8, ... bytes, each time
from pairs of the ranks before, and drops positions whose rank is unique. Ranks
here are 64-bit fingerprints, which doubles them without a sort as long as the
bytes are at hand: up to 32 bytes within a task, and further after Spark has
sorted the ranks and found the ones that repeat.

Sorting all positions of 100 TB several times is out of reach, so positions are
sampled, without loss: of the 69 strings of 32 bytes in a window of 100, the one
of lowest rank (the leftmost on a tie) is the window's anchor, and equal windows
have their anchors at the same place. About one position in 35 is an anchor.

1. Anchors are sorted by their 32-byte rank. Unique ones are settled: no window
   that has such an anchor recurs.
2. The windows of one anchor follow each other; the string that they span is
   ranked too. Where that rank repeats, all but its first occurrence are settled:
   all their windows occur earlier.
3. What is left are first occurrences under a repeated anchor, mostly around the
   ends of repeats. Their spans are fetched and their windows ranked at 100
   bytes; all but the first of equal windows occur earlier. An anchor with more
   than CROWD spans has its windows ranked by an aggregation instead of in one task.

Defined results: a null or empty text has no bytes; rows equal in id and text
are one document and get equal rows; rows of equal id and different text are
ordered by a hash of the text; a null id comes before all others; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.common import arrow_rows, bounded_rows, flat_bytes, text_groups, written
from credence.llm.hashing import MASK, ODD, mixed

LENGTH = 100
GRAM = 32
WIDTH = LENGTH - GRAM + 1
#: Window starts handled at once; a longer text goes in overlapping parts.
PART = 1 << 20
#: Bytes of texts, and rows, that a task works on at once: some ten numbers of 8 bytes are held for each byte.
GROUP_BYTES, GROUP_ROWS = 1 << 18, 2048
#: Texts handed to Python at once.
BATCH = 1024
#: Spans that a task holds to find repeats among them.
AT_HAND = 1 << 17
#: Spans under one anchor that one task may compare.
CROWD = 50_000
#: Bits of the filter on documents that hold repeats; more documents fill it, which costs shuffling only.
FILTER_BITS = 1 << 22

BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD)) | np.uint64(1)
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)

KEY = ["doc", "t"]
KEY_TYPE = "doc long, t long"


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(step)))
        step = step * step & MASK
    return out[:n]


UP, DOWN = _geometric(BASE, PART + 2 * LENGTH + 1), _geometric(INVERSE, PART + 2 * LENGTH + 1)


def _power(k: int) -> np.uint64:
    return np.uint64(pow(BASE, k, 1 << 64))


def _longer(a: np.ndarray, size: int, b: np.ndarray, more: int) -> np.ndarray:
    """Ranks of strings of ``size + more`` bytes, from those of their two parts."""
    n = len(a) - more
    return a[:n] * _power(more) + b[size : size + n]


def ranks(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Ranks of all positions by their first bytes, for ascending ``sizes`` that are powers of two; only these are held."""
    out, now, size = [], BYTE[data], 1
    for wanted in sizes:
        while size < wanted:
            now = _longer(now, size, now, size)
            size *= 2
        out.append(now)
    return out


def window_ranks(data: np.ndarray) -> np.ndarray:
    """Ranks of all positions by their first LENGTH bytes."""
    four, half, now = ranks(data, (4, 32, 64))
    now = _longer(now, 64, half, 32)
    return _longer(now, 96, four, 4)


def anchors(data: np.ndarray) -> np.ndarray:
    """For each window of LENGTH bytes, where its anchor is."""
    low = mixed(ranks(data, (GRAM,))[0])
    place = np.arange(len(low), dtype=np.int32)  # a part has far fewer positions
    size = 1
    while size < WIDTH:
        more = min(size, WIDTH - size)
        a, b = place[: len(place) - more], place[more:]
        place = np.where(low[b] < low[a], b, a)
        size += more
    return place.astype(np.int64)


def _runs(doc: np.ndarray, start: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of neighbouring windows with one anchor."""
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(first, append=len(start))


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a group of texts: bytes, bounds of texts in them, and each text's first byte's place in its text."""
    if len(data) <= PART + LENGTH:
        yield data, offsets, np.zeros(len(offsets) - 1, np.int64)
        return
    for k in range(len(offsets) - 1):
        a, b = int(offsets[k]), int(offsets[k + 1])
        for at in range(a, max(a + 1, b - LENGTH + 1), PART):
            end = min(b, at + PART + LENGTH - 1)
            bounds = np.zeros(len(offsets), np.int64)
            bounds[k + 1 :] = end - at
            skip = np.zeros(len(offsets) - 1, np.int64)
            skip[k] = at - a
            yield data[at:end], bounds, skip


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each anchor: g (its rank), s (rank of its span), doc, t, lo (first window) and n (windows).

    ``known`` marks rows whose span occurs earlier among the spans at hand. They
    need no comparison, so their g is a hash of their own place, which scatters
    them: copies of one text don't all go to the sort of its anchors.
    """
    made: list[pa.RecordBatch] = []
    for batch in batches:
        for part in _batch_spans(batch):
            made.append(part)
            if sum(len(m) for m in made) >= AT_HAND:
                yield _combined(made)
                made = []
    if made:
        yield _combined(made)


def _combined(made: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.concat_batches(made)
    g, s, doc, t, lo = (whole.column(c).to_numpy() for c in ("g", "s", "doc", "t", "lo"))
    order = np.lexsort((lo, t, doc, s, g))
    g, s, doc, t, lo = g[order], s[order], doc[order], t[order], lo[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    # rows of one document that repeats tie with its first
    known = (doc != doc[head]) | (t != t[head]) | (lo != lo[head])
    apart = mixed(mixed(doc.view(np.uint64) ^ t.view(np.uint64)) + lo.astype(np.uint64)).view(np.int64)
    out = whole.take(pa.array(order)).set_column(0, "g", pa.array(np.where(known, apart, g)))
    return out.append_column("known", pa.array(known))


def _batch_spans(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The anchors' rows of one batch."""
    for a, b in text_groups(batch.column("text"), GROUP_BYTES):
        doc = batch.column("doc").slice(a, b - a).to_numpy()
        t = batch.column("t").slice(a, b - a).to_numpy()
        for data, bounds, skip in _parts(*flat_bytes(batch.column("text").slice(a, b - a))):
            if len(data) < LENGTH:
                continue
            size = np.diff(bounds)
            windows = np.maximum(size - LENGTH + 1, 0)
            owner = np.repeat(np.arange(len(size)), windows)
            if not len(owner):
                continue
            start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + bounds[owner]
            anchor = anchors(data)[start]
            first, n = _runs(owner, start, anchor)
            lo, at, own = start[first], anchor[first], owner[first]
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(BYTE[data] * UP[: len(data)], out=sums[1:])
            span = (sums[lo + n - 1 + LENGTH] - sums[lo]) * DOWN[lo]
            shape = ((at - lo) * 128 + n).astype(np.uint64)
            gram = (sums[at + GRAM] - sums[at]) * DOWN[at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(mixed(gram).view(np.int64)),
                    pa.array((mixed(span) ^ mixed(shape * np.uint64(ODD))).view(np.int64)),
                    pa.array(doc[own]),
                    pa.array(t[own]),
                    pa.array((lo - bounds[own] + skip[own]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                ],
                ["g", "s", "doc", "t", "lo", "n"],
            )


def keyed(docs: DataFrame) -> DataFrame:
    """doc, t and text of every row: the id with nulls first, and a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(F.col("doc_id"), doc.alias("doc"), F.xxhash64(text).alias("t"), text.alias("text"))


def settled(texts: DataFrame) -> DataFrame:
    """Spans under repeated anchors: g (of first ones), doc, t, lo, n, and whether the span occurs earlier (else it is a first one).

    Spans that are alone under their anchor are left out: their windows occur once.
    """
    spans = texts.select("doc", "t", "text").mapInArrow(
        _spans, f"g long, s long, {KEY_TYPE}, lo int, n int, known boolean"
    )
    whole = Window.partitionBy("g")
    same = Window.partitionBy("g", "s").orderBy("doc", "t", "lo")
    found = (
        spans.repartition("g")
        .withColumn("place", F.rank().over(same))
        .withColumn("several", F.min("s").over(whole) != F.max("s").over(whole))
        .where("known or place > 1 or several")
        .select("g", *KEY, "lo", "n", (F.col("known") | (F.col("place") > 1)).alias("earlier"))
    )
    with arrow_rows(texts.sparkSession, BATCH):
        return written(found)


def holders(rows: DataFrame) -> np.ndarray:
    """A filter of fixed size: the bits of all documents in ``rows``."""
    bit = F.pmod(F.xxhash64(*KEY), F.lit(FILTER_BITS))
    words = (
        rows.select(bit.alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits"))
    )
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for word, bits in bounded_rows(words, FILTER_BITS // 64, "filter words"):
        out[word] = bits
    return out


def _held(words: np.ndarray) -> Column:
    """Whether a row's document may be in the filter. No text goes through Python for it."""
    # a literal of fixed size travels with the plan
    filter_words = F.split(F.lit(",".join(map(str, words.tolist()))), ",").cast("array<long>")
    word = F.get(filter_words, F.shiftright(F.col("bit"), 6).cast("int"))
    return F.call_function("shiftright", word, F.col("bit").bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the listed spans out of each text."""
    for batch in batches:
        for row in range(batch.num_rows):
            data = batch.column("text")[row].as_buffer()
            listed = batch.column("listed")[row].values
            lo, n = listed.field("lo").to_numpy(), listed.field("n").to_numpy()
            raw = memoryview(data)
            yield pa.RecordBatch.from_arrays(
                [
                    listed.field("g"),
                    pa.array(np.full(len(lo), batch.column("doc")[row].as_py())),
                    pa.array(np.full(len(lo), batch.column("t")[row].as_py())),
                    listed.field("lo"),
                    pa.array([bytes(raw[a : a + k - 1 + LENGTH]) for a, k in zip(lo.tolist(), n.tolist(), strict=True)]),
                ],
                ["g", "doc", "t", "lo", "span"],
            )


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, GROUP_ROWS):
            yield batch.slice(a, GROUP_ROWS)


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """For all windows of the spans of a batch: rank, row and place in the text."""
    data, offsets = flat_bytes(batch.column("span").cast(pa.large_binary()).view(pa.large_string()))
    n = np.diff(offsets) - LENGTH + 1
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    rank = window_ranks(data)[offsets[row] + inside]
    return mixed(rank), row, batch.column("lo").to_numpy()[row] + inside


def _listed(doc: np.ndarray, t: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Windows as runs (doc, t, lo, n); they come sorted by document and place."""
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (t[1:] != t[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc[first]),
            pa.array(t[first]),
            pa.array(at[first].astype(np.int32)),
            pa.array(np.diff(first, append=len(at)).astype(np.int32)),
        ],
        ["doc", "t", "lo", "n"],
    )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that occur earlier among the spans of their anchor; spans come sorted by anchor."""

    def done(part: pa.RecordBatch) -> pa.RecordBatch:
        rank, row, at = _windows(part)
        doc, t = part.column("doc").to_numpy()[row], part.column("t").to_numpy()[row]
        g = part.column("g").to_numpy()[row]
        order = np.lexsort((at, t, doc, rank, g))
        g, rank, doc, t, at = g[order], rank[order], doc[order], t[order], at[order]
        new = np.ones(len(rank), bool)
        new[1:] = (rank[1:] != rank[:-1]) | (g[1:] != g[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (doc != doc[head]) | (t != t[head]) | (at != at[head])
        doc, t, at = doc[later], t[later], at[later]
        order = np.lexsort((at, t, doc))
        return _listed(doc[order], t[order], at[order])

    held: list[pa.RecordBatch] = []
    for batch in _small(batches):
        g = batch.column("g").to_numpy()
        # all but the last anchor are complete; a batch of one anchor is held
        cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
        if held and held[-1].column("g")[0].as_py() != g[0]:
            yield done(pa.concat_batches(held))
            held = []
        if cut:
            yield done(pa.concat_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield done(pa.concat_batches(held))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each window."""
    for part in _small(batches):
        rank, row, at = _windows(part)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("g").take(pa.array(row)),
                pa.array(rank.view(np.int64)),
                part.column("doc").take(pa.array(row)),
                part.column("t").take(pa.array(row)),
                pa.array(at.astype(np.int32)),
            ],
            ["g", "r", "doc", "t", "lo"],
        )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the listed windows' bytes out of each text."""
    for batch in (whole.slice(a, b - a) for whole in batches for a, b in text_groups(whole.column("text"), GROUP_BYTES)):
        out = []
        for row in range(batch.num_rows):
            data = np.frombuffer(batch.column("text")[row].as_buffer(), np.uint8)
            depth = np.zeros(len(data) + 1, np.int32)
            listed = batch.column("listed")[row]
            if listed.is_valid:
                lo, n = listed.values.field("lo").to_numpy(), listed.values.field("n").to_numpy()
                np.add.at(depth, lo, 1)
                np.add.at(depth, lo + n - 1 + LENGTH, -1)
            gone = np.cumsum(depth[:-1]) > 0
            begins = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((len(data), int(gone.sum()), begins, data[~gone].tobytes()))
        size, removed, spans, kept = zip(*out, strict=True) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(size, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()),
                pa.array(kept, pa.binary()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def removals(texts: DataFrame) -> DataFrame:
    """doc, t, lo, n: runs of windows that occur earlier."""
    found = settled(texts)
    first = found.where("not earlier").distinct()
    words = holders(first)
    bit = F.pmod(F.xxhash64(*KEY), F.lit(FILTER_BITS))
    likely = texts.select(*KEY, "text", bit.alias("bit")).where(_held(words))
    listed = first.groupBy(*KEY).agg(F.collect_list(F.struct("g", "lo", "n")).alias("listed"))
    cut = likely.join(listed, KEY).select(*KEY, F.col("text").cast("binary"), "listed")
    with arrow_rows(texts.sparkSession, BATCH):
        spans = written(cut.mapInArrow(_fetch, f"g long, {KEY_TYPE}, lo int, span binary"))
    many = spans.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CROWD)
    few = spans.join(many, "g", "left_anti").repartition("g").sortWithinPartitions("g")
    compared = few.mapInArrow(_compare, f"{KEY_TYPE}, lo int, n int")
    apart = spans.join(many, "g", "left_semi").mapInArrow(_spread, f"g long, r long, {KEY_TYPE}, lo int")
    heads = apart.groupBy("g", "r").agg(F.min(F.struct(*KEY, "lo")).alias("head"))
    crowded = apart.join(heads, ["g", "r"]).where(F.struct(*KEY, "lo") != F.col("head"))
    return (
        found.where("earlier")
        .select(*KEY, "lo", "n")
        .union(compared)
        .union(crowded.select(*KEY, "lo", F.lit(1).cast("int").alias("n")))
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every document."""
    texts = keyed(docs)
    gone = written(removals(texts))
    words = holders(gone)
    bit = F.pmod(F.xxhash64(*KEY), F.lit(FILTER_BITS))
    marked = texts.withColumn("bit", bit)
    kept_schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    likely, others = marked.where(_held(words)), marked.where(~_held(words))
    listed = gone.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "n")).alias("listed"))
    lists = "array<struct<lo:int,n:int>>"
    touched = likely.join(listed, KEY, "left").select("doc_id", F.col("text").cast("binary"), "listed")
    whole = others.select("doc_id", F.col("text").cast("binary"), F.lit(None).cast(lists).alias("listed"))
    return touched.mapInArrow(_remove, kept_schema).union(whole.mapInArrow(_remove, kept_schema))
