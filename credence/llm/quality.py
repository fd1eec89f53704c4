"""Quality rules: hashed n-gram log-likelihood ratio, native Spark SQL only.

Two multinomials over hashed words and word pairs are counted in one pass: one
over all documents labelled good (the trusted target), one over the whole corpus. A
document's score is the sum of log p_target - log p_corpus over its features,
divided by their number; it is kept when the score reaches the threshold and
the base rules hold. One in HELD good documents, by a hash of its id, is held
out of the target. The threshold is the largest score that keeps KEPT_SHARE of
those, less a margin for what so many documents don't show: their standard
deviation times 1 + FEW / their number. No Python code runs on the executors.

Words are runs of characters other than ASCII white space. Defined results: a
null or empty text has no words and is rejected by the base rule of ten words;
repeated rows each get the same row; an empty table gives no rows; a corpus
without labelled rows scores every feature 0, and without held-out ones there
is no threshold, so only the base rules decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import bounded_rows, written

#: Hash buckets of the two multinomials: 512 KB of ratios at any corpus size.
BUCKETS = 1 << 16
#: Good ids are broadcast up to this many, some 60 MB; more are joined by a shuffle, to the same result.
BROADCAST_IDS = 1 << 20
#: Ranges in which held-out scores are counted at once.
RANGES = 1 << 12
#: Pseudo-count of each bucket, on the target's scale: a bucket that the target should hold
#: only a few times by the corpus's rate says little when it holds none.
PSEUDO = 5.0
#: One in so many good documents is held out to set the threshold.
HELD = 4
#: The share of the held-out good documents that the threshold keeps.
KEPT_SHARE = 0.995
#: So many held-out documents double the margin below the threshold.
FEW = 10

SPACE = "[\\x20\\x09-\\x0D]+"
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def joined(hashes: Column, other: Column, step: int) -> Column:
    """Hashes of ``hashes[i]`` followed by ``other[i + step]``, for every i that has both."""
    n = F.greatest(F.least(F.size(hashes), F.size(other) - step), F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(other, step + 1, n), lambda a, b: F.xxhash64(a, b))


def with_hashes(docs: DataFrame) -> DataFrame:
    """``docs`` with the arrays _words, _ones (word hashes) and _pairs (hashes of neighbours)."""
    return (
        docs.withColumn("_words", words_of(F.col("text")))
        .withColumn("_ones", hashes_of(F.col("_words")))
        .withColumn("_pairs", joined(F.col("_ones"), F.col("_ones"), 1))
    )


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Words and pairs of neighbours by hash bucket: n of all documents, wanted of those whose ``target`` is true.

    One partial row per task and bucket is shuffled.
    """
    return (
        with_hashes(docs.select("text", "target"))
        .select("target", F.explode(F.concat("_ones", "_pairs")).alias("h"))
        .groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("target").alias("wanted"))
    )


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_id of all good documents, and whether each is held out."""
    named = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    good = named.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(HELD)) == 0)
    return F.broadcast(good) if named.count() <= BROADCAST_IDS else good


def ratios(docs: DataFrame, good: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log p_target - log p_corpus by bucket; both models smoothed alike."""
    marked = docs.join(good, "doc_id", "left").withColumn("target", F.coalesce(~F.col("held"), F.lit(False)))
    counts = [(0, 0)] * buckets
    for bucket, corpus, wanted in bucket_counts(marked, buckets).toLocalIterator():  # a row per bucket, a fixed number
        counts[bucket] = (corpus, wanted)
    all_corpus, all_target = (sum(x[i] for x in counts) for i in (0, 1))
    if not all_target:
        return [0.0] * buckets
    scale = all_target / all_corpus
    return [math.log((wanted + PSEUDO) / (corpus * scale + PSEUDO)) for corpus, wanted in counts]


def kth(scores: DataFrame, k: int) -> float:
    """The score that ``k`` others precede in ascending order, exactly; rows are counted by range, never collected."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while low < high:
        part = F.least(F.floor((F.col("score") - low) / ((high - low) / RANGES)), F.lit(RANGES - 1))
        counted = scores.where(F.col("score").between(low, high)).groupBy(part.alias("part"))
        rows = counted.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        for r in sorted(bounded_rows(rows, RANGES, "ranges of scores")):
            if k < r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def threshold_of(docs: DataFrame, good: DataFrame, table: list[float], buckets: int, share: float = KEPT_SHARE) -> float:
    """The largest score that ``share`` of the held-out good documents reach, less the margin.

    Repeated ids count once, at their least.
    """
    held = docs.join(good, "doc_id").where("held")
    rows = scored(with_hashes(held), table, buckets).groupBy("doc_id").agg(F.min("score").alias("score"))
    scores = written(rows.select("score"))
    n, spread = scores.agg(F.count(F.lit(1)), F.stddev_pop("score")).first()
    if not n:
        return -math.inf
    return kth(scores, int(n * (1 - share))) - spread * (1 + FEW / n)


def repeat_words(fives: Column) -> Column:
    """Words in windows of five that occur at least twice; ``fives`` has the windows' hashes.

    Windows are sorted with their positions, so equal ones are neighbours;
    the union of the repeated windows is measured on the sorted positions.
    """
    at = F.transform(fives, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def covered(sorted_at: Column) -> Column:
        twice = F.filter(
            sorted_at,
            lambda x, k: F.coalesce(F.get(sorted_at, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(sorted_at, k + 1)["h"] == x["h"], F.lit(False)),
        )
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda acc, s: F.struct(
                (s + WINDOW).alias("end"),
                (acc["n"] + s + WINDOW - F.greatest(acc["end"], s)).cast("long").alias("n"),
            ),
        )["n"]

    return F.get(F.transform(F.array(F.array_sort(at)), covered), 0)


def base_columns(docs: DataFrame) -> DataFrame:
    """``docs`` with the hash arrays and the base counts.

    Windows of five are hashed only where some window of four recurs.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    fours = joined(F.col("_pairs"), F.col("_pairs"), 2)
    fives = joined(F.col("_fours"), F.col("_ones"), WINDOW - 1)
    return (
        with_hashes(docs)
        .withColumn("_lines", lines)
        .withColumn("_fours", fours)
        .withColumn("_recur", F.size(F.array_distinct("_fours")) < F.size("_fours"))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.when(F.col("_recur"), repeat_words(fives)).otherwise(F.lit(0).cast("long")))
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        )
        .drop("_lines", "_fours", "_recur")
    )


def scored(rows: DataFrame, table: list[float], buckets: int) -> DataFrame:
    """``rows`` with score: the mean ratio of the features of one text; 0 without words.

    The ratios are a scalar subquery. As a literal they would stand, 600 KB
    each time, in every description of the plan that the driver keeps.
    """
    numbers = rows.sparkSession.createDataFrame([([float(f"{x:.6f}") for x in table],)], "ratios array<double>")

    def total(hashes: Column) -> Column:
        return F.aggregate(hashes, F.lit(0.0), lambda acc, h: acc + F.get("_ratios", F.pmod(h, F.lit(buckets)).cast("int")))

    # _ratios is used once, so the subquery itself takes its place and no row carries the numbers
    both = F.aggregate(F.array("_ones", "_pairs"), F.lit(0.0), lambda acc, hashes: acc + total(hashes))
    mean = both / F.greatest(F.size("_ones") + F.size("_pairs"), F.lit(1))
    return rows.withColumn("_ratios", written(numbers).scalar()).withColumn("score", mean).drop("_ratios")


def rated(docs: DataFrame, labels: DataFrame, threshold: float | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The columns of ``docs`` with the base counts, score, base_failed and kept."""
    narrow = docs.select("doc_id", "text")
    good = good_ids(labels)
    table = ratios(narrow, good, buckets)
    least = threshold_of(narrow, good, table, buckets) if threshold is None else threshold
    return (
        scored(base_columns(docs), table, buckets)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))
        .drop("_words", "_ones", "_pairs")
    )


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents kept, with the columns of ``docs``.

    The row number keeps the filter above the projections that make its
    condition. Pushed below them, it would hold a copy of every expression
    for each of its uses, and split and hash each text dozens of times.
    """
    whole = docs.select(F.struct("*").alias("_row"), "doc_id", "text")  # so that no column's name clashes
    marked = rated(whole, labels).withColumn("_number", F.monotonically_increasing_id())
    return marked.where(F.col("kept") & (F.col("_number") >= 0)).select("_row.*")
