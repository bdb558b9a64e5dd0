"""Packed token ids by best-fit decreasing.

Each task tokenizes its texts, splits the longer ones into stretches of the capacity and packs the stretches of a bounded part of its
input: longest first, each into the bin with the least room that still holds it. A segment tree over the room that bins have
left finds that bin. Every bin becomes one row of an id matrix of fixed width, with the cumulative lengths of its
segments and the places where positions start again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyscope.llm.common import text_bytes
from replyscope.llm.packing import BATCH_BYTES, tokenizer

ROW = (
    "sequence_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<long>, starts array<long>, doc_tokens array<long>"
)


class Rooms:
    """Bins by the room they have left, in a segment tree over 0..capacity that counts the bins of each half."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, b: int) -> None:
        self.bins[room].append(b)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room of at least ``need``, and that room."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        self._change(room, -1)
        return self.bins[room].pop(), room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of the items, as lists of their indexes in the order they were put in."""
    rooms, out = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        got = rooms.take(lengths[i])
        if got is None:
            out.append([i])
            b, room = len(out) - 1, capacity
        else:
            b, room = got
            out[b].append(i)
        rooms.put(room - lengths[i], b)
    return out


def pack_rows(
    docs: DataFrame, path: str, end_id: int = 2, pad_id: int = 0, capacity: int = 4096, part_tokens: int = 1 << 23
) -> DataFrame:
    """Rows of the id matrix of all ``docs`` (doc_id, text, any further columns): sequence_id, n_tokens, input_ids (``capacity``
    little-endian unsigned 32-bit ids, padded with ``pad_id``), cu_seqlens (0 and each segment's end), position_resets (each segment's
    start), and per segment the doc_ids, starts (ids of the document before it) and doc_tokens.

    A row's ids are those of its text by the tokenizer file ``path``, then ``end_id``; null and empty texts give the end alone. A text
    with more than ``capacity`` ids is split into stretches of ``capacity`` and a rest; every id lies in one segment. Rows that share
    an id, have none or are equal in all are packed one by one. A task packs ``part_tokens`` ids at a time, whatever its input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def pack() -> Iterator[pa.RecordBatch]:
            nonlocal made, held, size
            bins = best_fit_decreasing([len(h[2]) for h in held], capacity)
            for lo in range(0, len(bins), 512):
                out = []
                for own in bins[lo : lo + 512]:
                    parts = [held[i] for i in own]
                    ends = np.cumsum([len(p[2]) for p in parts])
                    ids = np.full(capacity, pad_id, "<u4")
                    ids[: ends[-1]] = np.concatenate([p[2] for p in parts])
                    at = [0, *ends.tolist()]
                    out.append((task << 32 | made, at[-1], ids.tobytes(), at, at[:-1], *([p[c] for p in parts] for c in (0, 1, 3))))
                    made += 1
                kinds = [pa.int64(), pa.int32(), pa.binary(), *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.int64())] * 3]
                names = [c.split()[0] for c in ROW.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            held, size = [], 0

        def hold(part: list[tuple]) -> None:
            nonlocal size
            for (doc, _), ids in zip(part, tokenizer(path)([t for _, t in part]), strict=True):
                ids = np.append(ids, np.uint16(end_id))
                size += len(ids)
                held.extend((doc, at, ids[at : at + capacity], len(ids)) for at in range(0, len(ids), capacity))

        for b in batches:
            part, n = [], 0
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part.append((doc, t.as_py()))
                n += len(part[-1][1])
                if n >= BATCH_BYTES:
                    hold(part)
                    part, n = [], 0
            if part:
                hold(part)
            if size >= part_tokens:
                yield from pack()
        if held:
            yield from pack()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t")).mapInArrow(run, ROW)
