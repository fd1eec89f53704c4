"""Packing documents into fixed-length sequences by minimum bin slack.

Documents are cut into pieces of at most CAPACITY tokens; only longer ones are
cut, and then only the first piece may be short. Each bin starts with the
longest piece left; a subset-sum table over the lengths still available, kept
as one bit string a length, finds the fullest combination that goes with it,
and its pieces are removed. Bins that would come out alike are taken at once,
so the plan depends on how many pieces there are of each length, at most
CAPACITY numbers, and is made on the driver at any input size: a combination
is used until a length runs short for it, which bounds the combinations by
CAPACITY * ln(CAPACITY) (about 7,100).

Pieces find their places in parallel: a piece's rank among all of its length
comes from counts per written partition and length, and its rank tells bin and
offset. No task gathers all pieces of a length.

Defined results: a null or empty text has only the end id; rows that repeat
are packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.common import bounded_rows, flat_bytes, text_groups, written
from credence.llm.huffman import _binary
from credence.llm.tokens import encoder, released

CAPACITY = 1024
END_ID = 2

PIECES = "part int, rank long, doc_id long, piece int, start long, length int, ids binary"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents, written, with their rank among those of their length in their partition.

    ids are little-endian 32-bit numbers.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a, b in text_groups(batch.column("text")):
                ids, sizes = tool.encode(batch.column("text").slice(a, b - a))
                ids = np.insert(ids.astype("<u4"), np.cumsum(sizes), end_id)
                sizes = sizes + 1
                count = (sizes + capacity - 1) // capacity
                row = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                head = sizes - (count - 1) * capacity  # the first piece has what the others leave
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                order = np.argsort(length, kind="stable")
                run = np.arange(len(order)) - np.searchsorted(length[order], length[order])
                rank = np.empty(len(order), np.int64)
                rank[order] = seen[length[order]] + run
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(row), part, np.int32)),
                        pa.array(rank),
                        batch.column("doc_id").slice(a, b - a).take(pa.array(row)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(length.astype(np.int32)),
                        _binary(ids, length * 4),
                    ],
                    ["part", "rank", "doc_id", "piece", "start", "length", "ids"],
                )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(narrow.mapInArrow(cut, PIECES))


def fullest(left: np.ndarray, capacity: int) -> dict[int, int]:
    """The lengths of the next bin and how many of each: the longest piece, and what fills it best."""
    longest = int(np.flatnonzero(left)[-1])
    room = capacity - longest
    chosen = {longest: 1}
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int]] = []
    for length in np.flatnonzero(left[: room + 1])[::-1].tolist():
        count = min(int(left[length]) - (length == longest), room // length)
        if count <= 0:
            continue
        steps.append((length, reach))
        block = 1
        while count > 0:  # powers of two, then the rest, make every number of copies
            take = min(block, count)
            reach |= (reach << (take * length)) & mask
            count -= take
            block *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    for length, before in reversed(steps):
        while not before >> total & 1:
            total -= length
            chosen[length] = chosen.get(length, 0) + 1
    return chosen


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths, and how many bins each fills."""
    left = counts.copy()
    out = []
    while left.any():
        chosen = fullest(left, capacity)
        times = min(int(left[length]) // n for length, n in chosen.items())
        for length, n in chosen.items():
            left[length] -= n * times
        out.append((chosen, times))
    return out


def places(combinations: list[tuple[dict[int, int], int]], capacity: int) -> list[np.ndarray]:
    """For each length, rows (first rank, pieces a bin, first bin, offset of the first piece)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    first_bin = 0
    for chosen, times in combinations:
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            rows[length].append((used[length], n, first_bin, offset))
            used[length] += n * times
            offset += n * length
        first_bin += times
    return [np.array(rows.get(k, []), np.int64).reshape(-1, 4) for k in range(capacity + 1)]


def _lists(column: pa.Array) -> pa.Array:
    """A binary column of little-endian 32-bit numbers as lists."""
    data, offsets = flat_bytes(column.cast(pa.large_binary()).view(pa.large_string()))
    return pa.ListArray.from_arrays(pa.array((offsets // 4).astype(np.int32)), pa.array(data.view("<i4")))


def placed(found: DataFrame, columns: str, capacity: int = CAPACITY) -> DataFrame:
    """The named columns of ``pieces`` (name and type, comma-separated) with sequence_id and offset."""
    here = found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part")
    first = here.select("length", "part", (F.sum("n").over(before) - F.col("n")).alias("first"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in bounded_rows(here.groupBy("length").agg(F.sum("n")), capacity, "lengths"):
        counts[length] = n
    table = places(plan(counts, capacity), capacity)
    names = [c.split()[0] for c in columns.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the pieces are written, so nothing is encoded from here on
        released()
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("first").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for k in np.unique(length).tolist():
                mine = length == k
                row = table[k][np.searchsorted(table[k][:, 0], rank[mine], "right") - 1]
                bin_, slot = np.divmod(rank[mine] - row[:, 0], row[:, 1])
                sequence[mine] = row[:, 2] + bin_
                offset[mine] = row[:, 3] + slot * k
            yield pa.RecordBatch.from_arrays(
                [*(_lists(batch.column(n)) if n == "ids" else batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    narrow = found.withColumn("ids_crc32", F.crc32("ids"))
    wanted = narrow.select(*dict.fromkeys(["length", "part", "rank", *names]))
    return wanted.join(first, ["length", "part"]).mapInArrow(place, f"{columns}, sequence_id long, offset long")


def packed(found: DataFrame, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece; on demand its ids too."""
    columns = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * ids
    return placed(found, columns, capacity).withColumn("length", F.col("length").cast("long"))


def sequences(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids (array) and n of every sequence; a sequence has at most ``capacity`` ids."""
    found = placed(pieces(docs, vocabulary, capacity), "ids array<int>", capacity)
    listed = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = found.groupBy("sequence_id").agg(F.flatten(F.transform(listed, lambda x: x["ids"])).alias("ids"))
    return whole.withColumn("n", F.size("ids"))
