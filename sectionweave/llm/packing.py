"""Packing of documents into training sequences by Karmarkar-Karp multiway differencing.

Documents are encoded where they lie; whole sequences are cut off, and what is left of them gathers until it
fills a set of windows. The set is then parted into near-equal windows: every piece is a partition of its own,
and the two partitions with the largest imbalance are merged, the fullest window of one with the emptiest of
the other, until one is left. No rows are moved between tasks, so a task's sequences depend on its rows alone.
"""

import heapq
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .tables import record_batch, sliced

CAPACITY = 2048
#: Windows that are filled together.
WINDOWS = 32
_SUM = itemgetter(0)
PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` windows of near-equal sums; ties go by index."""
    if not sizes:
        return [[] for _ in range(k)]
    empty: list[tuple[int, list[int]]] = [(0, [])] * (k - 1)
    heap = [(-size if k > 1 else 0, i, [*empty, (size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, windows = heapq.heappop(heap)
        _, j, others = heap[0]
        others.reverse()  # both ascend: opposing imbalances meet
        merged = sorted([(a[0] + b[0], a[1] + b[1]) for a, b in zip(windows, others, strict=True)], key=_SUM)
        heapq.heapreplace(heap, (merged[0][0] - merged[-1][0], min(i, j), merged))
    return [items for _, items in heap[0][2]]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; their number starts at the least possible and rises until all fit."""
    if sizes and max(sizes) > capacity:
        raise ValueError("a piece is larger than a window")
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, k)
        if all(sum(sizes[i] for i in window) <= capacity for window in found):
            return [window for window in found if window]
        k += 1


class Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, at: int) -> tuple["Piece", "Piece"]:
        return Piece(self.doc, self.start, self.ids[:at], self.total), Piece(self.doc, self.start + at, self.ids[at:], self.total)


def arranged(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """The pieces in as few windows of at most ``capacity`` as can hold them.

    The near-equal windows differ by little; what one holds beyond its capacity is cut off and moves to windows
    with room. Only when all of them together are exceeded are there more.
    """
    found = differencing([len(p.ids) for p in pieces], -(-sum(len(p.ids) for p in pieces) // capacity))
    windows = [[pieces[i] for i in sorted(window)] for window in found]
    rooms = [capacity - sum(len(p.ids) for p in window) for window in windows]
    loose = []
    for window, room in zip(windows, rooms, strict=True):
        while room < 0:
            last = window.pop()
            kept, off = last.cut(max(0, len(last.ids) + room))
            room += len(off.ids)
            loose.append(off)
            window += [kept] if len(kept.ids) else []
    for window, room in zip(windows, rooms, strict=True):
        while room > 0 and loose:
            moved, rest = loose.pop().cut(room)
            room -= len(moved.ids)
            window.append(moved)
            loose += [rest] if len(rest.ids) else []
    return [window for window in windows if window]


def pack_stream(documents: Iterator[tuple[int | None, np.ndarray]], capacity: int, n_windows: int) -> Iterator[list[Piece]]:
    """Sequences, each a list of pieces, of a stream of (document, ids)."""
    pending: list[Piece] = []
    pending_size, target = 0, n_windows * capacity
    for doc, ids in documents:
        rest = Piece(doc, 0, ids, len(ids))
        while len(rest.ids) >= capacity:
            whole, rest = rest.cut(capacity)
            yield [whole]
        if not len(rest.ids):
            continue
        if pending_size + len(rest.ids) >= target:
            last, rest = rest.cut(target - pending_size)
            yield from arranged([*pending, last], capacity)
            pending, pending_size = [], 0
        if len(rest.ids):
            pending.append(rest)
            pending_size += len(rest.ids)
    if pending:
        yield from arranged(pending, capacity)


def _pack(tokenizer: str, end_id: int, capacity: int, n_windows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode, end = tokens.encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
    # A sequence is named by its task's partition and its place there.
    sequence = TaskContext.get().partitionId() << 40
    documents = ((doc, np.frombuffer(encode(text or "") + end, "<u4")) for batch in sliced(batches, 1, 8 << 20)
                 for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    rows, size = [], 0
    for pieces in pack_stream(documents, capacity, n_windows):
        offset = 0
        for p in pieces:
            rows.append((p.doc, p.start, len(p.ids), p.ids.tobytes(), p.total, sequence, offset))
            offset += len(p.ids)
        sequence, size = sequence + 1, size + offset
        if size > 1 << 20:
            yield record_batch(PIECE, list(zip(*rows, strict=True)))
            rows, size = [], 0
    if rows:
        yield record_batch(PIECE, list(zip(*rows, strict=True)))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 1, n_windows: int = WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, <u4), doc_tokens, sequence_id, offset.

    Reads ``doc_id`` and ``text`` only. A null text counts as empty and makes one piece of the end id; null and
    repeated doc_ids are kept as they are, each row a document of its own (its pieces share doc_tokens, and
    rows with one doc_id and text are told apart by their sequences alone). An empty table gives no rows.
    """
    tokenizer = tokenizer or tokens.default_path()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: _pack(tokenizer, end_id, capacity, n_windows, batches), PIECE)


def piece_digests(docs: DataFrame, **options) -> DataFrame:
    """The pieces with the crc32 of their ids instead of the ids."""
    return pack(docs, **options).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                                        "sequence_id", "offset")
