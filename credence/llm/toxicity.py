"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another by logistic regressions over the
presence of selected words and word beginnings; each model also sees the log-odds of the
categories before it. In training those log-odds are out-of-fold predictions,
so a later model learns from what an earlier one says about unseen documents.

The categories are what the labels tell: poor (of low quality), toxic, and
foul (both). The words that the models see are not given: they are all, whole
or by their first bytes, whose presence differs significantly between toxic
and other labelled documents.

Training uses at most SAMPLE labelled documents, those of smallest id hash;
all documents are scored whole. Defined results: null and empty texts have no
words and get the models' base rates; repeated rows each get their row; an
empty table gives no rows; with no labels of both kinds every probability is 0;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import bounded_rows, flat_bytes, text_groups, text_hash, written
from credence.llm.hashing import ODD, Seeds, mixed, stem_hashes, word_hashes

#: Labelled documents used for training, at most.
SAMPLE = 8_000
#: The least z-score of the difference that admits a word; all that reach it are seen.
LEAST_Z = 6.0
FOLDS = 5
#: Words are seen whole and by their first bytes, which inflected forms share.
STEM = 4
RIDGE = 1.0
#: Probability from which a document counts as toxic.
THRESHOLD = 0.15

CHAIN = ["poor", "toxic", "foul"]
#: Words that pass the test, at most: more are an error. Each is in at least LEAST_DOCS of SAMPLE documents.
MOST_WORDS = 1 << 20
LEAST_DOCS = 5


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct word hashes of each document."""
    for batch in batches:
        rows = []
        for a, b in text_groups(batch.column("text")):
            words, bounds = stem_hashes(*flat_bytes(batch.column("text").slice(a, b - a)), STEM)
            rows += [np.unique(words[bounds[k] : bounds[k + 1]]).view(np.int64) for k in range(b - a)]
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(rows, pa.list_(pa.int64()))], [*kept, "words"])


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The labelled sample, written: doc_id, poor, toxic and the distinct words of each document.

    Of rows of equal id the one of the smallest text hash is taken.
    """
    known = labels.where("doc_id is not null and toxic is not null")
    poor = F.max(F.coalesce(F.col("quality") == 0, F.lit(False)).cast("int")).alias("poor")
    chosen = known.groupBy("doc_id").agg(poor, F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long"), text_hash().alias("t"), F.col("text").cast("string"))
    # at most ``sample`` rows of 16 bytes
    joined = rows.join(F.broadcast(chosen), "doc_id")
    first = joined.groupBy("doc_id").agg(F.min("t").alias("t"))
    single = joined.join(F.broadcast(first), ["doc_id", "t"]).select("doc_id", "poor", "toxic", "text")
    return written(single.mapInArrow(_words, "doc_id long, poor int, toxic int, words array<long>").dropDuplicates(["doc_id"]))


def selected(rows: DataFrame, least: float = LEAST_Z) -> np.ndarray:
    """Hashes of the words whose presence differs by ``least`` or more between toxic and other documents.

    Words are counted in Spark; only those that pass come to the driver.
    """
    n, toxic = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    counts = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"))
    share = F.col("n") / n
    spread = F.sqrt(share * (1 - share) * (1 / toxic + 1 / (n - toxic))) + 1e-12
    z = F.abs(F.col("toxic") / toxic - (F.col("n") - F.col("toxic")) / (n - toxic)) / spread
    passed = counts.where((F.col("n") >= LEAST_DOCS) & (z >= least)).select("word")
    return np.array([r["word"] for r in bounded_rows(passed, MOST_WORDS, "words")], np.int64).view(np.uint64)


def _seen(seeds: Seeds):
    """Reduces the words of each document to the numbers of those that the models see."""

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.sort(seeds.find(np.asarray(x.values, np.int64).view(np.uint64))[1]).astype(np.int32) for x in batch.column("words")]
            yield batch.set_column(batch.schema.get_field_index("words"), "words", pa.array(each, pa.list_(pa.int32())))

    return see


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, start: np.ndarray | None = None) -> np.ndarray:
    """Weights of a ridge logistic regression (Newton steps from ``start``); the last column of ``x`` is 1."""
    weights = np.zeros(x.shape[1]) if start is None else start.copy()
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(25):
        p = sigmoid(x @ weights)
        slope = x.T @ (y - p) - penalty * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def chained(x: np.ndarray, targets: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """One weight vector a category; ``x`` gets a column of out-of-fold log-odds after each."""
    out = []
    ones = np.ones((len(x), 1))
    for k in range(targets.shape[1]):
        now = np.hstack((x, ones))
        out.append(fitted(now, targets[:, k]))
        unseen = np.zeros(len(x))
        for fold in np.unique(folds):
            held = folds == fold
            # most rows are the same as for the whole, so its weights are near
            unseen[held] = now[held] @ fitted(now[~held], targets[~held, k], start=out[k])
        x = np.hstack((x, np.clip(unseen, -10, 10)[:, None]))
    return out


def chain_probabilities(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    out = []
    ones = np.ones((len(x), 1))
    for weights in models:
        odds = np.hstack((x, ones)) @ weights
        out.append(sigmoid(odds))
        x = np.hstack((x, np.clip(odds, -10, 10)[:, None]))
    return np.stack(out, axis=1)


def trained(docs: DataFrame, labels: DataFrame) -> tuple[Seeds, list[np.ndarray]] | None:
    sample = sampled(docs, labels)
    if sample.select("toxic").distinct().count() < 2:
        return None
    seeds = Seeds(selected(sample))
    # one short row for each document of the sample
    seen = sample.mapInArrow(_seen(seeds), "doc_id long, poor int, toxic int, words array<int>")
    rows = sorted(bounded_rows(seen, SAMPLE, "labelled sample"), key=lambda r: r["doc_id"])
    x = np.zeros((len(rows), len(seeds.grams)))
    for k, row in enumerate(rows):
        x[k, row["words"]] = 1
    poor, toxic = (np.array([r[c] for r in rows], float) for c in ("poor", "toxic"))
    # by a hash, so that no order of ids lines up with the folds
    ids = np.array([r["doc_id"] for r in rows], np.int64).view(np.uint64)
    folds = mixed(ids * np.uint64(ODD)) % np.uint64(FOLDS)
    return seeds, chained(x, np.stack([poor, toxic, poor * toxic], axis=1), folds)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_<category> of every category, and toxic (whether p_toxic is at least THRESHOLD)."""
    model = trained(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros((batch.num_rows, len(CHAIN)))
            if model is not None:
                seeds, models = model
                for a, b in text_groups(batch.column("text")):
                    words, bounds = stem_hashes(*flat_bytes(batch.column("text").slice(a, b - a)), STEM)
                    at, number = seeds.find(words)
                    x = np.zeros((b - a, len(seeds.grams)))
                    x[np.searchsorted(bounds, at, "right") - 1, number] = 1
                    p[a:b] = chain_probabilities(x, models).round(6)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(CHAIN))), pa.array(p[:, CHAIN.index("toxic")] >= THRESHOLD)],
                ["doc_id", *(f"p_{c}" for c in CHAIN), "toxic"],
            )

    columns = ", ".join(f"p_{c} double" for c in CHAIN)
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(score, f"doc_id long, {columns}, toxic boolean")
