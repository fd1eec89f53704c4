"""SimHash near-duplicates, paired through pivot distance tables.

A document's 64-bit fingerprint has bit i set if more than half of its
shingles' XXH64 values have it set. Documents whose fingerprints differ in at
most two bits are linked, and components of links are groups.

Pairs come from tables of Hamming distances to reference fingerprints. By the
triangle inequality, d(x, p) and d(y, p) differ by at most d(x, y). The
references are one base fingerprint, 32 copies of it that differ in one pair
of bits each, and eight scattered ones. The distance to a copy, seen against
the distance to the base, tells the distance within that pair of bits; over
the 32 copies those parts add up to at most d(x, y), so when two fingerprints
differ by 2, at most two of four groups of eight copies show any difference.
Rows that agree on two groups meet in a join, are discarded if any distance to
a scattered reference differs by more than 2, and are verified.

Only distinct fingerprints are paired, so copies cost nothing. A join key that
more than CROWD fingerprints share is not joined: its fingerprints meet at the
fingerprints one bit away from them instead (two fingerprints within 2 bits
share such a neighbour, and at most 65 can share one), which is exact and
linear in their number.

Defined results: null and empty texts have fingerprint 0 and are linked like
others; repeated rows share a group; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import only, text_hash, written
from credence.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
GROUPS = 4
#: Fingerprints that may meet under one join key; more take the neighbour path.
CROWD = 256
BASE = 0x5DEECE66D1CE4E5B
SCATTERED = [xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed=SEED) for i in range(8)]

#: For each byte value its eight bits, the highest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: Shingles hashed before their bits are counted.
STEP = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), STEP):
        spans = zip(starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], ">u8")
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ BITS
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        found = [fingerprint(x.as_py() or b"") for x in texts]
        values = np.array(found, np.uint64).view(np.int64)
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(values)], [*kept, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every document."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _fingerprints, "doc_id long, fp long"
    )


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _distance(fp: Column, reference: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(reference))))


#: The copies of the base: each differs from it in one pair of bits.
COPIES = [BASE ^ (3 << 2 * j) for j in range(32)]


def pair_profile(fp: Column) -> Column:
    """Distances within each pair of bits, 32 fields of two bits, from the table of distances to the copies.

    Field j is (d(x, base) - d(x, copy j) + 2) / 2, the number of the pair's
    two bits in which x differs from the base.
    """
    base = _distance(fp, BASE)
    out = F.lit(0).cast("long")
    for j, copy in enumerate(COPIES):
        field = F.shiftright(base - _distance(fp, copy) + 2, 1).cast("long")
        out = out.bitwiseOR(F.shiftleft(field, 2 * j))
    return out


def scattered_profile(fp: Column) -> Column:
    """Distances to the eight scattered references, a byte each."""
    out = F.lit(0).cast("long")
    for k, pivot in enumerate(SCATTERED):
        out = out.bitwiseOR(F.shiftleft(_distance(fp, pivot).cast("long"), 8 * k))
    return out


def within(one: Column, other: Column, radius: int) -> Column:
    """Whether the largest coordinate difference of two scattered profiles is at most ``radius``."""
    out = F.lit(True)
    for k in range(len(SCATTERED)):
        a, b = (F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255)) for x in (one, other))
        out = out & (F.abs(a - b) <= radius)
    return out


def links(classes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of ``rep`` of classes whose fingerprints link, or links with the same components.

    ``classes`` has a row per distinct fingerprint: fp and rep.
    """
    profile = classes.select("fp", "rep", pair_profile(F.col("fp")).alias("pairs"))
    width = 64 // GROUPS
    part = [F.shiftrightunsigned("pairs", width * g).bitwiseAND(F.lit((1 << width) - 1)) for g in range(GROUPS)]
    keys = [
        F.struct(
            F.lit(i).cast("int").alias("choice"),
            F.shiftleft(part[g], width).bitwiseOR(part[h]).alias("key"),
        )
        for i, (g, h) in enumerate((g, h) for g in range(GROUPS) for h in range(g + 1, GROUPS))
    ]
    keyed = written(
        profile.select("fp", "rep", F.explode(F.array(*keys)).alias("k")).select(
            "k.choice", "k.key", "fp", "rep", scattered_profile(F.col("fp")).alias("far")
        )
    )
    sizes = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n"))
    met = keyed.join(sizes.where((F.col("n") > 1) & (F.col("n") <= crowd)), ["choice", "key"]).drop("n")
    a = met.toDF("choice", "key", "fp_a", "a", "far_a")
    b = met.toDF("choice", "key", "fp_b", "b", "far_b")
    joined = a.join(
        b,
        (a["choice"] == b["choice"])
        & (a["key"] == b["key"])
        & (F.col("fp_a") < F.col("fp_b"))
        & within(F.col("far_a"), F.col("far_b"), DISTANCE)
        & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= DISTANCE),
    ).select("a", "b")

    crowded = keyed.join(sizes.where(F.col("n") > crowd), ["choice", "key"], "left_semi").select("fp", "rep").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])
    near = crowded.select("rep", F.explode(flips).alias("near"))
    # at most 65 fingerprints lie within one bit of any other
    low = near.groupBy("near").agg(F.collect_list("rep").alias("reps"))
    hubs = (
        low.where(F.size("reps") > 1)
        .select(F.array_min("reps").alias("a"), F.explode("reps").alias("b"))
        .where("a <> b")
    )
    return joined.union(hubs)


def grouped(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = written(fingerprints(docs))
    classes = written(found.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    joined = components(links(classes.where("rep is not null"), crowd))
    named = classes.join(joined, classes["rep"] == joined["node"], "left").select(
        "fp", F.coalesce("low", "rep").alias("component_id")
    )
    return found.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def survivors(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One document of each group, the one of smallest id, with the columns of ``docs``.

    Rows equal in id and text are one document, of which one row stays; rows of
    equal id and other texts are different documents. Documents without an id all stay.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = written(rows.select("doc_id", text_hash().alias("t"), "text").mapInArrow(_fingerprints, "doc_id long, t long, fp long"))
    classes = written(found.groupBy("fp").agg(F.min(F.struct("doc_id", "t")).alias("first")))
    # classes are linked by their fingerprints, as one id may have several
    lower = components(links(classes.select("fp", F.col("fp").alias("rep")), crowd))
    groups = classes.join(lower, classes["fp"] == lower["node"], "left").groupBy(F.coalesce("low", "fp"))
    return only(docs, groups.agg(F.min("first").alias("first")).select("first.*"))
