"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters and digits and of bytes above 127, after full
Unicode case folding in normal form C. An item leaks into a document when the
best local alignment of their words scores at least THRESHOLD of the item's
perfect score.

Seeds are pairs of neighbouring words of an item; in a document they may have
one word between them. An alignment that reaches the threshold keeps at least
``surviving`` of an item's n - 1 pairs, whatever is replaced, inserted or
removed: replacing or removing a word costs three points and breaks two pairs
at most, an inserted word costs one point, and only two of them between two
words break a pair. Pairs are counted over all training documents (in how many
they occur), and an item's commonest pairs, half of those that may be spared,
are no seeds. A document is aligned with an item, around the seeds, when it
holds as many of its seeds as must be left. So every leak of an item of SHORT
words or more is found; the rare seeds decide the cost alone.

The benchmark is a stated query set: it is sent to all tasks in blocks of at
most BLOCK_WORDS words, one pass over the documents a block.

Defined results: null and empty texts, and items without words, leak nothing;
items of fewer than SHORT words are looked for by their whole word sequence; repeated
rows give a row each; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import bounded_rows, flat_bytes, text_groups
from credence.llm.hashing import ODD, Seeds, gram_hashes, mixed, word_hashes

THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of the shortest item that is looked for by pairs.
SHORT = 4
#: Words of benchmark text sent to the tasks at once.
BLOCK_WORDS = 1 << 21


def folded(column: pa.Array) -> pa.Array:
    """The texts by full Unicode case folding, in normal form C; ASCII texts stay, as word hashes fold them."""
    out = []
    for text in column.to_pylist():
        if text is not None and not text.isascii():
            text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
        out.append(text)
    return pa.array(out, pa.large_string())


def align(item: np.ndarray, passage: np.ndarray) -> int:
    """Best local alignment score of two word sequences; gaps cost GAP a word."""
    width = len(passage)
    ramp = np.arange(width + 1) * GAP
    before = np.zeros(width + 1, np.int64)
    best = 0
    for word in item:
        now = np.zeros(width + 1, np.int64)
        now[1:] = np.maximum(before[:-1] + np.where(passage == word, MATCH, MISMATCH), before[1:] + GAP)
        np.maximum(now, 0, out=now)
        # gaps along the passage: the best earlier cell less its distance
        now = np.maximum.accumulate(now - ramp) + ramp
        best = max(best, int(now.max()))
        before = now
    return best


def items_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Blocks of (item_id, word hashes) of bounded size."""
    block, held = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words, _ = word_hashes(*flat_bytes(folded(pa.array([row["text"] or ""]))))
        if len(words):
            block.append((row["item_id"], words))
            held += len(words)
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def surviving(words: int, threshold: float = THRESHOLD) -> int:
    """Least number of an item's pairs that an alignment of at least ``threshold`` keeps, with at most one word between.

    What the perfect score has over the threshold pays for replaced or removed
    words (three points, two pairs) and for inserted or left out ones (two points, one pair).
    """
    spare = MATCH * words - int(np.ceil(MATCH * words * threshold))
    lost = max(2 * e + (spare - 3 * e) // 2 for e in range(spare // 3 + 1))
    return words - 1 - lost


def pairs_of(words: np.ndarray, between: int) -> np.ndarray:
    """Hashes of all pairs of words with so many words between them."""
    n = max(len(words) - between - 1, 0)
    return mixed(words[:n] * np.uint64(ODD) + words[len(words) - n :])


class Owners:
    """The seeds of a block: their hashes, and for each the items that have it and where in them."""

    def __init__(self, grams: list[np.ndarray], places: list[np.ndarray]):
        self.seeds = Seeds(np.concatenate(grams) if grams else np.zeros(0, np.uint64))
        number = np.searchsorted(self.seeds.grams, np.concatenate(grams))
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        order = np.argsort(number, kind="stable")
        self.item, self.place = item[order], np.concatenate(places)[order]
        self.first = np.searchsorted(number[order], np.arange(len(self.seeds.grams) + 1))


def _scan(batch: pa.RecordBatch, seeds: Seeds, short: list[int]) -> Iterator[tuple]:
    """For groups of texts: first row, word hashes, text bounds, and hits (word place, seed).

    ``short`` lists the sizes of the whole sequences that are looked for.
    """
    for a, b in text_groups(batch.column("text")):
        words, bounds = word_hashes(*flat_bytes(folded(batch.column("text").slice(a, b - a))))
        places, numbers = [], []
        runs = [(pairs_of(words, 0), 2), (pairs_of(words, 1), 3), *((sequence_hashes(words, n), n) for n in short)]
        for hashes, n in runs:
            at, number = seeds.find(hashes)
            text = np.searchsorted(bounds, at, "right") - 1
            whole = at + n <= bounds[text + 1]  # within one text
            places.append(at[whole])
            numbers.append(number[whole])
        yield a, words, bounds, np.concatenate(places), np.concatenate(numbers)


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of whole short items, apart from those of pairs."""
    return mixed(gram_hashes(words, n) ^ np.uint64(n))


def gram_frequencies(docs: DataFrame, seeds: Seeds, short: list[int]) -> np.ndarray:
    """In how many documents each seed occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(seeds.grams), np.int64)
        for batch in batches:
            for _, _, bounds, at, number in _scan(batch, seeds, short):
                text = np.searchsorted(bounds, at, "right") - 1
                pairs = np.unique(text * len(seeds.grams) + number)
                total += np.bincount(pairs % len(seeds.grams), minlength=len(seeds.grams))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["seed", "n"])

    counted = docs.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n"))
    out = np.zeros(len(seeds.grams), np.int64)
    for seed, n in bounded_rows(counted, len(seeds.grams), "seeds"):
        out[seed] = n
    return out


class Finder:
    """Finds the items of one block in batches of documents."""

    def __init__(self, docs: DataFrame, block: list[tuple[int, np.ndarray]], threshold: float):
        self.block, self.threshold = block, threshold
        keep = [surviving(len(w), threshold) if len(w) >= SHORT else 0 for _, w in block]
        whole = [k < 1 for k in keep]
        self.short = sorted({len(w) for (_, w), x in zip(block, whole, strict=True) if x})
        grams = [sequence_hashes(w, len(w)) if x else pairs_of(w, 0) for (_, w), x in zip(block, whole, strict=True)]
        places = [np.arange(len(g)) for g in grams]
        every = Seeds(np.concatenate(grams))
        frequencies = gram_frequencies(docs, every, self.short)
        need = np.ones(len(block), np.int64)
        for k, least in enumerate(keep):
            spared = max((least - 1) // 2, 0)
            need[k] = max(least - spared, 1)
            if spared:
                common = np.argsort(frequencies[np.searchsorted(every.grams, grams[k])], kind="stable")[len(grams[k]) - spared :]
                places[k] = np.delete(places[k], common)
                grams[k] = np.delete(grams[k], common)
        self.need = need
        self.owned = Owners(grams, places)

    def best(self, wanted: np.ndarray, words: np.ndarray, begins: list[int]) -> int:
        """Best alignment of an item in a document whose seeds suggest that it begins at ``begins``."""
        # as many words may be inserted before and after a seed
        slack = len(wanted) + 2
        best, low, high = 0, None, 0
        for begin in sorted(begins):
            # windows that overlap are aligned as one
            if low is not None and begin - slack > high:
                best = max(best, align(wanted, words[max(0, low) : max(0, high)]))
                low = None
            low = begin - slack if low is None else low
            high = begin + len(wanted) + slack
        return max(best, align(wanted, words[max(0, low) : max(0, high)]))

    def leaks(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, float]]:
        """(row, item_id, score, similarity) of every leak in a batch."""
        owners, items = self.owned, len(self.block)
        for first, words, bounds, at, number in _scan(batch, owners.seeds, self.short):
            # each hit meets all items that have the seed
            n = owners.first[number + 1] - owners.first[number]
            hit = np.repeat(np.arange(len(at)), n)
            entry = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + owners.first[number][hit]
            item, offset = owners.item[entry], owners.place[entry]
            text = np.searchsorted(bounds, at, "right") - 1
            pair = text[hit] * items + item
            # how many of an item's seeds the document holds, each place of the item counted once
            longest = int(offset.max(initial=0)) + 1
            held, size = np.unique(np.unique(pair * longest + offset) // longest, return_counts=True)
            enough = held[size >= self.need[held % items]]
            order = np.argsort(pair, kind="stable")
            ends = np.searchsorted(pair[order], enough, "right")
            for which, a, b in zip(enough.tolist(), np.searchsorted(pair[order], enough).tolist(), ends.tolist(), strict=True):
                doc, k = divmod(which, items)
                mine = order[a:b]
                begins = np.unique(at[hit[mine]] - bounds[doc] - offset[mine])
                item_id, wanted = self.block[k]
                best = self.best(wanted, words[bounds[doc] : bounds[doc + 1]], begins.tolist())
                similarity = best / (MATCH * len(wanted))
                if similarity >= self.threshold:
                    yield first + doc, item_id, best, similarity


def finders(docs: DataFrame, benchmark: DataFrame, threshold: float) -> Iterator:
    """A broadcast finder for each block of the benchmark."""
    texts = docs.select(F.col("text").cast("string"))
    for block in items_of(benchmark):
        yield docs.sparkSession.sparkContext.broadcast(Finder(texts, block, threshold))


def leaked(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score and similarity of every leak."""
    schema = "doc_id long, item_id long, score long, similarity double"
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.sparkSession.createDataFrame([], schema)
    for sent in finders(docs, benchmark, threshold):

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if rows := list(sent.value.leaks(batch)):
                    row, item, score, similarity = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(pa.array(row)),
                            pa.array(item, pa.int64()),
                            pa.array(score, pa.int64()),
                            pa.array(similarity),
                        ],
                        ["doc_id", "item_id", "score", "similarity"],
                    )

        out = out.union(narrow.mapInArrow(find, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents into which nothing leaked, with the columns of ``docs``; nothing is shuffled."""
    out = docs
    for sent in finders(docs, benchmark, threshold):

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                stays[[row for row, *_ in sent.value.leaks(batch)]] = False
                yield batch.filter(pa.array(stays))

        out = out.mapInArrow(keep, docs.schema)
    return out
