"""Token ids in binary form: canonical length-limited Huffman codes.

Ids are encoded once, counted over the whole corpus, and written with one
canonical code whose words have at most 16 bits. A file holds segments of
whole documents in ascending doc_id order; a segment's bits are one string of
bytes, in which every document starts at a byte and every BLOCK ids a
checkpoint gives the bit offset. Blocks are decoded independently of each
other, all in step, by one table look-up an id.

Row of a file: part and segment (order of the files and within one), doc_ids,
sizes (ids of each document), bits, checkpoints (bit offset of each block, in
document order; a document's last block may be short). Numbers are
little-endian. The code lengths are stored beside the rows, by id.

Defined results: a null or empty text has only the end id; null ids come
first; rows equal in doc_id follow each other, in the order of their sizes;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.common import bounded_rows, drop, text_groups, written
from credence.llm.tokens import encoder

END_ID = 0
LONGEST = 16
BLOCK = 512
#: Ids after which a segment ends with the document at hand.
SEGMENT = 1 << 18
#: Ids of a file, on average.
FILE_IDS = 1 << 25


def encoded(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n (ids with the end id) and ids (little-endian, 16 or 32 bits) of every document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        kind = id_type(tool.tokenizer.get_vocab_size())
        for batch in batches:
            for a, b in text_groups(batch.column("text")):
                ids, sizes = tool.encode(batch.column("text").slice(a, b - a))
                ends = np.cumsum(sizes)
                ids = np.insert(ids.astype(kind), ends, end_id)
                sizes = sizes + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(sizes), _binary(ids, sizes * kind.itemsize)],
                    ["doc_id", "n", "ids"],
                )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(encode, "doc_id long, n long, ids binary")


def id_type(vocabulary_size: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary_size <= 1 << 16 else "<u4")


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column over the bytes of ``values``, cut by ``sizes`` (bytes)."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), buffers).cast(pa.binary())


def id_counts(ids: DataFrame, vocabulary_size: int) -> np.ndarray:
    """How often each id occurs in the whole table; a row per task and id is shuffled."""
    kind = id_type(vocabulary_size)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary_size, np.int64)
        for batch in batches:
            total += np.bincount(_values(batch.column("ids"), kind), minlength=vocabulary_size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    rows = bounded_rows(
        ids.select("ids").mapInArrow(summed, "id long, n long").groupBy("id").agg(F.sum("n")), vocabulary_size, "ids"
    )
    out = np.zeros(vocabulary_size, np.int64)
    for number, n in rows:
        out[number] = n
    return out


def _values(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """All numbers of a binary column."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return np.zeros(0, kind)
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].view(kind)


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits, by package-merge; 0 for ids that don't occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) == 0:
        return out
    if len(used) == 1:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError("more ids than codes")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.int64)
    n = len(used)
    # levels[k] marks, in weight order, which entries of that level are single ids
    levels = []
    now = weight
    single = np.ones(n, bool)
    for _ in range(longest - 1):
        levels.append(single)
        pairs = now[: len(now) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weight, pairs))
        order = np.argsort(both, kind="stable")
        now, single = both[order], order < n
    levels.append(single)
    take = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for single in reversed(levels):
        ids = int(single[:take].sum())
        lengths[:ids] += 1
        take = 2 * (take - ids)
    out[used] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words by id: shorter codes first, ids ascending among equal lengths."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    words = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    steps = lengths[order].astype(np.int64)
    # words of one length are consecutive numbers
    for size in np.unique(steps):
        code <<= int(size) - last
        last = int(size)
        mine = order[steps == size]
        words[mine] = np.arange(code, code + len(mine), dtype=np.uint64)
        code += len(mine)
    return words


def decode_table(lengths: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """For every ``longest`` next bits: id << 8 | code length."""
    out = np.zeros(1 << longest, np.uint32)
    words = canonical(lengths)
    used = np.flatnonzero(lengths)
    size = lengths[used].astype(np.int64)
    first = (words[used] << (longest - size).astype(np.uint64)).astype(np.int64)
    span = 1 << (longest - size)
    order = np.argsort(first)
    filled = np.repeat(used[order].astype(np.uint32) << 8 | lengths[used][order], span[order])
    out[: len(filled)] = filled
    return out


def pack(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """The bits of documents of ``sizes`` ids, their bytes, and the bit offset in its document of each block."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    first = np.cumsum(sizes) - sizes
    before = (ends - bits)[first]  # bits before each document, if none were aligned
    own = np.add.reduceat(bits, first)
    octets = (own + 7) // 8
    start = (np.cumsum(octets) - octets) * 8
    at = ends - bits + np.repeat(start - before, sizes)
    word = at >> 5
    # at most 16 bits from bit 0..31 of a 32-bit word: the rest falls into the next word
    value = words[ids] << (64 - (at & 31) - bits).astype(np.uint64)
    n = int(octets.sum())
    total = n // 4 + 2
    # words never overlap, so sums below 2**32 are exact in doubles
    high = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=total)
    high[1 : total] += np.bincount(word, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=total)[: total - 1]
    data = high.astype(np.uint32).astype(">u4").view(np.uint8)[:n]
    blocks = (sizes + BLOCK - 1) // BLOCK
    inside = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    points = at[np.repeat(first, blocks) + inside * BLOCK] - np.repeat(start, blocks)
    return data, octets, points, blocks


def unpack(data: np.ndarray, points: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Ids of blocks that begin at bit ``points`` and have ``counts`` ids; all blocks advance together."""
    padded = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.uint32)
    window = padded[:-3] << 16 | padded[1:-2] << 8 | padded[2:-1]  # 24 bits from each byte
    order = np.argsort(-counts, kind="stable")
    at, left = points[order].astype(np.int64), counts[order]
    target = (np.cumsum(counts) - counts)[order]
    out = np.zeros(int(counts.sum()), np.uint32)
    live = len(order)
    for step in range(int(left[0]) if live else 0):
        while left[live - 1] <= step:
            live -= 1
        here = at[:live]
        entry = table[(window[here >> 3] >> (8 - (here & 7)).astype(np.uint32)) & 0xFFFF]
        out[target[:live] + step] = entry >> 8
        here += entry & 0xFF
    return out


def write_files(ids: DataFrame, lengths: np.ndarray, files: int) -> DataFrame:
    """Encode and write all documents in ascending doc_id order; returns the table of segments.

    Documents are dealt to files by range, rows of one id by their ids too, so
    a file is one task's work and files are of like numbers of documents.
    """
    kind = id_type(len(lengths))
    words = canonical(lengths)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        number = total = 0

        def close() -> pa.RecordBatch:
            docs, sizes, bits, points = zip(*held, strict=True)
            starts = np.cumsum([0, *map(len, bits)]) * 8
            moved = [p + s for p, s in zip(points, starts, strict=False)]
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "segment": pa.array([number], pa.int64()),
                    "n": pa.array([sum(sizes)], pa.int64()),
                    "doc_ids": pa.array([docs], pa.list_(pa.int64())),
                    "sizes": pa.array([sizes], pa.list_(pa.int64())),
                    "bits": pa.array([b"".join(bits)], pa.binary()),
                    "checkpoints": pa.array([np.concatenate(moved).astype("<i8").tobytes()], pa.binary()),
                }
            )

        for batch in batches:
            for a, b in text_groups(batch.column("ids")):
                docs, sizes = batch.column("doc_id").slice(a, b - a).to_pylist(), batch.column("n").slice(a, b - a).to_numpy()
                raw = _values(batch.column("ids").slice(a, b - a), kind)
                data, octets, points, blocks = pack(raw, sizes, lengths, words)
                ends, last = np.cumsum(octets), np.cumsum(blocks)
                for k, doc in enumerate(docs):
                    bits = data[ends[k] - octets[k] : ends[k]].tobytes()
                    held.append((doc, int(sizes[k]), bits, points[last[k] - blocks[k] : last[k]]))
                    total += int(sizes[k])
                    if total >= SEGMENT:
                        yield close()
                        held.clear()
                        number, total = number + 1, 0
        if held:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.col("n").asc(), F.crc32("ids").asc()]
    dealt = ids.repartitionByRange(files, *order).sortWithinPartitions(*order)
    return written(
        dealt.mapInArrow(
            segments,
            "part int, segment long, n long, doc_ids array<long>, sizes array<long>, bits binary, checkpoints binary",
        )
    )


def read_files(segments: DataFrame, lengths: np.ndarray) -> DataFrame:
    """part, segment, place (in the segment), doc_id, n, before (ids before it in the segment) and ids."""
    table = decode_table(lengths)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row]  # noqa: B023, E731
                sizes = np.asarray(get("sizes").values, np.int64)
                blocks = (sizes + BLOCK - 1) // BLOCK
                counts = np.full(int(blocks.sum()), BLOCK, np.int64)
                counts[np.cumsum(blocks) - 1] = sizes - (blocks - 1) * BLOCK
                points = np.frombuffer(get("checkpoints").as_buffer(), "<i8")
                ids = unpack(np.frombuffer(get("bits").as_buffer(), np.uint8), points, counts, table)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(sizes), get("part").as_py(), np.int32)),
                        pa.array(np.full(len(sizes), get("segment").as_py(), np.int64)),
                        get("doc_ids").values,
                        pa.array(sizes),
                        pa.array(np.cumsum(sizes) - sizes),
                        _binary(ids.astype("<u4"), sizes * 4),
                    ],
                    ["part", "segment", "doc_id", "n", "before", "ids"],
                )

    return segments.mapInArrow(decode, "part int, segment long, doc_id long, n long, before long, ids binary")


def stored(docs: DataFrame, vocabulary: str) -> tuple[DataFrame, np.ndarray]:
    """Encode, count, and write all documents; the table of segments and the code lengths."""
    from tokenizers import Tokenizer

    ids = written(encoded(docs, vocabulary))
    counts = id_counts(ids, Tokenizer.from_file(vocabulary).get_vocab_size())
    lengths = code_lengths(counts)
    files = max(docs.sparkSession.sparkContext.defaultParallelism, int(counts.sum()) // FILE_IDS)
    segments = write_files(ids, lengths, files)
    drop(ids)
    return segments, lengths


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document, as read back from the files."""
    segments, lengths = stored(docs, vocabulary)
    parts = segments.groupBy("part").agg(F.sum("n").alias("n"))
    # one row a file
    first = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    inside = Window.partitionBy("part").orderBy("segment")
    starts = (
        segments.select("part", "segment", (F.sum("n").over(inside) - F.col("n")).alias("inner"))
        .join(first, "part")
        .select("part", "segment", (F.col("first") + F.col("inner")).alias("begin"))
    )
    return (
        read_files(segments, lengths)
        .select("part", "segment", "doc_id", "n", "before", F.crc32("ids").alias("ids_crc32"))
        .join(starts, ["part", "segment"])
        .select("doc_id", (F.col("begin") + F.col("before")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")
    )
