"""Hierarchical residual best-fit packing of tokenised documents into fixed-length sequences.

Round 0 tokenises and packs inside each partition: pieces go by best fit, longest first, and bins that are nearly full
are final. Bins with room left travel as items to fewer and fewer tasks (a tree of `FAN_IN`), where best fit merges whole
bins, or their pieces where that needs fewer bins. After each round, bins into which not even the shortest open piece of the corpus
fits are final as well, so what is left for the root is bins that can still take something; the tree ends there, or when no
bin is open. A task packs `BLOCK` pieces at a time. Only piece metadata moves; texts never do.

Defined cases: a null or empty text is the end id alone (one piece of length 1); repeated rows and repeated or null ids
are packed row by row; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import materialize
from plumbline.llm.textvec import chunks, text_buffer
from plumbline.llm.wordbpe import WordBpe

CAPACITY = 4096
END_ID = 1
FAN_IN = 8
#: Pieces or bins that a task packs at a time.
BLOCK = 200_000
#: A bin with this share of its capacity filled is final.
NEARLY_FULL = 0.998

_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long, open boolean, task long"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    + [("sequence_id", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64()), ("open", pa.bool_()), ("task", pa.int64())]
)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best fit, longest item first: (bin, offset) of every item and the fill of every bin.

    `room` has bit r set when some bin has r tokens left, so the tightest bin that fits is the lowest bit from the item's
    length upwards.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    by_room: dict[int, list[int]] = {}
    room = 0
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if size >= capacity:
            bins[i] = len(fill)
            fill.append(size)
            continue
        fitting = room >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            stack = by_room[left]
            b = stack.pop()
            if not stack:
                room &= ~(1 << left)
        else:
            b, left = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        left -= size
        if left:
            by_room.setdefault(left, []).append(b)
            room |= 1 << left
    return bins, offsets, fill


def _number(level: int, part: int, at: int) -> int:
    return (level << 56) | (part << 32) | at


def _tokenize(capacity: int, end_id: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = WordBpe.load(path), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        held: list[tuple] = []
        used = 0

        def packed() -> pa.RecordBatch:
            nonlocal used
            doc, piece, start, length, crc = zip(*held, strict=True)
            sizes = np.array(length, np.int64)
            bins, offsets, fill = best_fit(sizes, capacity)
            fill = np.array(fill, np.int64)
            full = fill >= NEARLY_FULL * capacity
            ids = bins + _number(0, part, used)
            used += len(fill)
            held.clear()
            return pa.record_batch([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(ids), pa.array(offsets), pa.array(fill[bins]), pa.array(~full[bins]), pa.array(np.full(len(sizes), part, np.int64))], schema=_ARROW)

        for batch in chunks(batches, "text"):
            data, offs = text_buffer(batch.column("text"))
            ids, first = bpe.encode(data, offs)
            ids = ids.astype("<u4", copy=False)
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                for piece, at in enumerate(range(0, b - a + 1, capacity)):
                    stop = min(at + capacity, b - a)
                    crc = zlib.crc32(ids[a + at : a + stop])
                    size = stop - at
                    if size < capacity:
                        crc, size = zlib.crc32(end, crc), size + 1
                    held.append((doc, piece, at, size, crc))
            if len(held) >= BLOCK:
                yield packed()
        if held:
            yield packed()

    return run


def _merge(capacity: int, level: int):
    """Best fit over whole bins, or over their pieces if that needs fewer; the rows of a bin follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used, rest = TaskContext.get().partitionId(), 0, None

        def packed(table: pa.Table) -> pa.RecordBatch:
            nonlocal used
            seq, length = table["sequence_id"].to_numpy(), table["length"].to_numpy()
            heads = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(seq))))
            bins, base, fill = best_fit(np.add.reduceat(length, heads), capacity)
            bins, offsets = bins[of], table["offset"].to_numpy() + base[of]
            loose = best_fit(length, capacity)
            if len(loose[2]) < len(fill):
                bins, offsets, fill = loose
            fill = np.array(fill, np.int64)
            full = fill >= NEARLY_FULL * capacity
            new = {"sequence_id": pa.array(bins + _number(level, part, used)), "offset": pa.array(offsets), "fill": pa.array(fill[bins]), "open": pa.array(~full[bins])}
            used += len(fill)
            return pa.record_batch([new[n] if n in new else table[n].combine_chunks() for n in _ARROW.names], schema=_ARROW)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                table = pa.Table.from_batches(held).combine_chunks()
                seq = table["sequence_id"].to_numpy()
                cut = int(np.searchsorted(seq, seq[-1]))  # the last bin may go on in the next batch
                if cut:
                    yield packed(table.slice(0, cut).combine_chunks())
                held = table.slice(cut).to_batches()
        if held and sum(b.num_rows for b in held):
            yield packed(pa.Table.from_batches(held).combine_chunks())

    return run


def _settled(rows: DataFrame, capacity: int) -> tuple[DataFrame, bool]:
    """rows of which only those bins are open that the shortest open piece still fits into, and whether there are any."""
    shortest = rows.where("open").agg(F.min("length")).first()[0]
    if shortest is None:
        return rows, False
    return rows.withColumn("open", F.col("open") & (F.col("fill") + shortest <= capacity)), True


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenize(capacity, end_id, tokenizer), _COLUMNS))
    tasks, level = (rows.agg(F.max("task")).first()[0] or 0) + 1, 0
    result = None
    while True:
        rows, more = _settled(rows, capacity)
        last = not more or (level and tasks == 1)
        done = rows if last else rows.where(~F.col("open"))
        result = done if result is None else result.unionByName(done)
        if last:
            return result.drop("open", "task", "fill")
        tasks, level = -(-tasks // FAN_IN), level + 1
        grouped = rows.where("open").withColumn("task", F.floor(F.col("task") / FAN_IN)).repartition(tasks, "task").sortWithinPartitions("sequence_id", "offset")
        rows = materialize(grouped.mapInArrow(_merge(capacity, level), _COLUMNS))
