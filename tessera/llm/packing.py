"""Packing of token pieces into sequences by attention cost.

A piece of n tokens costs linear * n + quadratic * n * n.  Each task packs the
documents that it reads: whole runs of `length` tokens are sequences by
themselves; what is left of documents waits until it fills POOL sequences,
then goes, largest first, to the sequence of lowest cost that has room; a piece
that no sequence has room for is cut.  Sequences of a pool are full; only a
task's last one is padded.  No rows move between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common as C
from tessera.llm import tokens as T

#: Sequences that are filled together.
POOL = 1024


def fill(sizes: np.ndarray, length: int, bins: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, tokens, sequence, offset) of the pieces over so many sequences.

    The sizes sum to at most bins * length."""
    room = np.full(bins, length)
    cost = np.zeros(bins)
    out = []
    for p in np.argsort(-sizes, kind="stable").tolist():
        start, left = 0, int(sizes[p])
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            s = int(np.argmin(np.where(fits, cost, np.inf)))
            n = min(left, int(room[s]))
            out.append((p, start, n, s, length - int(room[s])))
            room[s] -= n
            cost[s] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.float64()), ("ids", pa.list_(pa.int32()))])


class Packer:
    def __init__(self, length: int, linear: float, quadratic: float, first: int, with_ids: bool):
        self.length, self.linear, self.quadratic, self.next, self.with_ids = length, linear, quadratic, first, with_ids
        self.wait: list[tuple] = []  # doc_id, start, ids, doc_tokens
        self.waiting = 0
        self.rows: list[tuple] = []

    def _put(self, doc, start, ids, total, sequence, offset) -> None:
        self.rows.append((doc, start, ids, total, sequence, offset))

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.length * self.length
        for a in range(0, whole, self.length):
            self._put(doc, a, ids[a : a + self.length], len(ids), self.next, 0)
            self.next += 1
        if len(ids) > whole:
            self.wait.append((doc, whole, ids[whole:], len(ids)))
            self.waiting += len(ids) - whole
        if self.waiting >= POOL * self.length:
            self.flush(self.waiting // self.length)

    def flush(self, bins: int) -> None:
        """Fill so many sequences; what is beyond their room waits on."""
        room, now, later = bins * self.length, [], []
        for piece in self.wait:
            doc, start, ids, total = piece
            if len(ids) <= room:
                now.append(piece)
            else:
                if room:
                    now.append((doc, start, ids[:room], total))
                later.append((doc, start + room, ids[room:], total))
            room -= min(room, len(ids))
        for p, a, n, s, offset in fill(np.array([len(x[2]) for x in now], np.int64), self.length, bins, self.linear, self.quadratic):
            doc, start, ids, total = now[p]
            self._put(doc, start + a, ids[a : a + n], total, self.next + s, offset)
        self.next += bins
        self.wait, self.waiting = later, sum(len(x[2]) for x in later)

    def batch(self) -> pa.RecordBatch:
        doc, start, ids, total, sequence, offset = zip(*self.rows) if self.rows else ((),) * 6
        self.rows = []
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        lists = pa.nulls(len(n), pa.list_(pa.int32()))
        if self.with_ids:
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
        return C.record(_PIECE, doc_id=list(doc), start=list(start), length=n, ids_crc32=T.crc32s(flat, n), doc_tokens=list(total), sequence_id=list(sequence), offset=list(offset), cost=self.linear * n + self.quadratic * n * n, ids=lists)


def pack_sequences(docs: DataFrame, path: str, end: int = 1, length: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents (doc_id, text; null text: empty): doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, cost, and ids (null if not wanted).

    Each document is its ids by the tokenizer file, then the end id.  A sequence id
    is the task's number times 2**32 plus a count.  Rows that share a doc_id are
    documents of their own; a null doc_id stays null.  An empty table gives no rows.
    """
    C.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(length, linear, quadratic, TaskContext.get().partitionId() << 32, with_ids)
        for big in batches:
            for b in C.slices(big):
                ids, counts = T.encode_column(path, C.column(b, "text"), end)
                at = np.cumsum(counts)
                for doc, a, z in zip(C.column(b, "doc_id").to_pylist(), (at - counts).tolist(), at.tolist()):
                    packer.add(doc, ids[a:z])
                yield packer.batch()
        for bins in (packer.waiting // length, 1):  # full ones, then the rest
            if packer.waiting and bins:
                packer.flush(bins)
        yield packer.batch()

    return C.map_arrow(docs.select("doc_id", "text"), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double, ids array<int>")
