"""Binary token files: canonical length-limited Huffman codes in independent blocks.

A file is a sequence of containers in ascending doc_id order.  A container
holds some whole documents and can be read by itself:

    magic "HTK1", counts (documents, tokens, symbols, blocks, payload bytes),
    first token's global start, document ids with validity, tokens of each
    document, symbols and code lengths (which fix the canonical code), the bit
    offset of each block (checkpoints, BLOCK tokens apart), the code bits.

Code lengths come from the counts of all ids by package-merge, at most MOST
bits.  Decoding reads MOST bits at a block's position, looks up symbol and
length in one table, and advances; all blocks of a container go in step.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm import tokens as T

MOST = 20
BLOCK = 1024
#: Tokens after which a container is closed.
CONTAINER = 1 << 20
_HEAD = struct.Struct("<4sqqqqqq")


def code_lengths(counts: np.ndarray, most: int = MOST) -> np.ndarray:
    """Optimal code lengths of at most `most` bits for symbols with these counts (0: no code)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << most:
        raise ValueError(f"{n} symbols need more than {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    kinds, level = [], leaf
    for _ in range(most):
        both = level if not kinds else np.concatenate([leaf, packed])
        is_leaf = np.arange(len(both)) < n
        by = np.argsort(both, kind="stable")
        level = both[by]
        kinds.append(is_leaf[by])
        pairs = len(level) // 2
        packed = level[0 : 2 * pairs : 2] + level[1 : 2 * pairs : 2]
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for flags in reversed(kinds):
        leaves = int(flags[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by (length, symbol) and their codes."""
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
    size = lengths[symbols]
    room = np.int64(1) << (MOST - size)
    codes = (np.cumsum(room) - room) >> (MOST - size)
    return symbols, codes


def pack(ids: np.ndarray, code: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code bits of ids, highest first, and the bit offset of each block."""
    size = lengths[ids]
    end = np.cumsum(size)
    at = end - size
    words = np.zeros((int(end[-1]) >> 6) + 2 if len(ids) else 1, C.U64)
    if len(ids):
        word, off = at >> 6, at & 63
        c = code[ids].astype(C.U64)
        over = off + size - 64
        part = np.where(over > 0, c >> np.maximum(over, 0).astype(C.U64), c << np.maximum(-over, 0).astype(C.U64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.add.reduceat(part, first)
        spill = np.flatnonzero(over > 0)
        words[word[spill] + 1] += c[spill] << (64 - over[spill]).astype(C.U64)
    total = (int(end[-1]) + 7) // 8 if len(ids) else 0
    return words.byteswap().tobytes()[:total], at[::BLOCK]


def unpack(payload: bytes, offsets: np.ndarray, n: int, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The n ids of a payload; lengths: of the symbols, in canonical order."""
    room = np.int64(1) << (MOST - lengths)
    table = np.zeros(1 << MOST, np.int64)
    filled = int(room.sum())
    table[:filled] = np.repeat((symbols << 5) | lengths, room)
    raw = np.frombuffer(payload + b"\0" * 4, np.uint8).astype(np.uint32)
    peek = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    pos = offsets.copy()
    out = np.zeros((len(offsets), BLOCK), np.int32)
    full = n - (len(offsets) - 1) * BLOCK if len(offsets) else 0
    for t in range(BLOCK):
        k = len(pos) if t < full else len(pos) - 1
        if not k:
            break
        p = pos[:k]
        hit = table[(peek[p >> 3] >> (32 - MOST - (p & 7))) & ((1 << MOST) - 1)]
        out[:k, t] = hit >> 5
        pos[:k] = p + (hit & 31)
    return out.reshape(-1)[:n]


def write_container(doc_ids: np.ndarray, valid: np.ndarray, counts: np.ndarray, start: int, ids: np.ndarray, lengths: np.ndarray) -> bytes:
    symbols, codes = canonical(lengths)
    code = np.zeros(len(lengths), np.int64)
    code[symbols] = codes
    payload, offsets = pack(ids, code, lengths)
    table = zlib.compress(np.sort(symbols).astype("<i4").tobytes() + lengths[np.sort(symbols)].astype("u1").tobytes(), 1)
    head = _HEAD.pack(b"HTK1", len(doc_ids), len(ids), len(table), len(offsets), len(payload), start)
    return b"".join([head, doc_ids.astype("<i8").tobytes(), valid.astype("u1").tobytes(), counts.astype("<i8").tobytes(), table, offsets.astype("<i8").tobytes(), payload])


def read_container(raw: bytes) -> dict:
    """doc_ids, valid, counts, start (first token's) and ids of a container."""
    magic, docs, n, table, blocks, size, start = _HEAD.unpack_from(raw)
    if magic != b"HTK1":
        raise ValueError("not a token container")
    at = _HEAD.size

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, k, at)
        at += out.nbytes
        return out

    doc_ids, valid, counts = take("<i8", docs), take("u1", docs).astype(bool), take("<i8", docs)
    packed = zlib.decompress(take("u1", table).tobytes())
    k = len(packed) // 5
    symbols, lengths = np.frombuffer(packed, "<i4", k).astype(np.int64), np.frombuffer(packed, "u1", k, 4 * k).astype(np.int64)
    by = np.argsort(lengths, kind="stable")
    offsets = take("<i8", blocks)
    ids = unpack(take("u1", size).tobytes(), offsets, n, symbols[by], lengths[by])
    return {"doc_ids": doc_ids, "valid": valid, "counts": counts, "start": start, "ids": ids}


_IDS = pa.schema([("bucket", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("docs", pa.binary()), ("planes", pa.list_(pa.binary())), ("symbols", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])


def _encode(path: str, end: int):
    """Containers' ids in byte planes, then the counts of all ids of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bucket, seq, before = TaskContext.get().partitionId(), 0, 0
        total = np.zeros(1 << 16, np.int64)
        held: list[tuple] = []

        def closed() -> pa.RecordBatch:
            nonlocal seq, before
            ids, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            docs = np.concatenate([h[2] for h in held]).astype("<i8").tobytes() + np.concatenate([h[3] for h in held]).astype("u1").tobytes() + counts.astype("<i8").tobytes()
            planes = [p.tobytes() for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]
            out = C.record(_IDS, bucket=[bucket], seq=[seq], before=[before], n=[len(ids)], docs=[docs], planes=[planes], symbols=[None], times=[None])
            seq, before = seq + 1, before + len(ids)
            held.clear()
            return out

        for big in batches:
            for b in C.slices(big):
                ids, counts = T.encode_column(path, C.column(b, "text"), end)
                seen = np.bincount(ids, minlength=len(total))
                if len(seen) > len(total):
                    total = np.pad(total, (0, len(seen) - len(total)))
                total[: len(seen)] += seen
                doc = C.column(b, "doc_id")
                held.append((ids, counts, doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False)))
                if sum(len(h[0]) for h in held) >= CONTAINER:
                    yield closed()
        if held:
            yield closed()
        used = np.flatnonzero(total)
        yield C.record(_IDS, bucket=[bucket], seq=[-1], before=[0], n=[before], docs=[None], planes=[None], symbols=[used.tolist()], times=[total[used].tolist()])

    return run


_FILE = pa.schema([("bucket", pa.int32()), ("seq", pa.int32()), ("container", pa.binary())])


def _containers(lengths: np.ndarray, base: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                bucket, seq, before, n, docs = (C.column(b, c)[r].as_py() for c in ("bucket", "seq", "before", "n", "docs"))
                planes = [np.frombuffer(p.as_buffer(), np.uint8) for p in C.column(b, "planes")[r].values]
                ids = np.stack(planes, 1).reshape(-1).view("<u4").astype(np.int64)
                k = len(docs) // 17
                doc_ids, valid, counts = np.frombuffer(docs, "<i8", k), np.frombuffer(docs, "u1", k, 8 * k), np.frombuffer(docs, "<i8", k, 9 * k)
                yield C.record(_FILE, bucket=[bucket], seq=[seq], container=[write_container(doc_ids, valid, counts, base[bucket] + before, ids, lengths)])

    return run


def write_tokens(docs: DataFrame, path: str, end: int, files: str) -> None:
    """Write the ids of docs (doc_id, text) to `files`, one file of containers for each range of doc_id.

    Each text (null: none) is followed by the end id.  Documents go in ascending doc_id order,
    nulls first, equal ids by text.  What comes to the driver: a count for each id of the
    vocabulary and for each file.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    ranged = docs.select("doc_id", "text").repartitionByRange(C.buckets_of(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ids = C.materialise(C.map_arrow(ranged, _encode(path, end), "bucket int, seq int, before long, n long, docs binary, planes array<binary>, symbols array<int>, times array<long>"), "ids")
    heads = ids.where("seq < 0")
    sums = heads.select(F.explode(F.arrays_zip("symbols", "times")).alias("x")).groupBy("x.symbols").agg(F.sum("x.times").alias("n")).collect()
    counts = np.zeros(max([int(r["symbols"]) for r in sums], default=0) + 1, np.int64)
    for r in sums:
        counts[r["symbols"]] = r["n"]
    sizes = sorted((r["bucket"], r["n"]) for r in heads.select("bucket", "n").collect())
    base, at = {}, 0
    for bucket, n in sizes:
        base[bucket], at = at, at + n
    body = ids.where("seq >= 0").select("bucket", "seq", "before", "n", "docs", "planes")
    C.map_arrow(body, _containers(code_lengths(counts), base), "bucket int, seq int, container binary").write.option("compression", "none").parquet(files)


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


def read_tokens(spark, files: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (null if not wanted) ids of each document of token files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in C.column(b, "container"):
                c = read_container(raw.as_buffer().to_pybytes())
                n = c["counts"]
                at = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(c["ids"])) if with_ids else pa.nulls(len(n), pa.list_(pa.int32()))
                yield C.record(_DOCS, doc_id=pa.array(c["doc_ids"], mask=~c["valid"]), start=c["start"] + at[:-1], n_tokens=n, ids_crc32=T.crc32s(c["ids"], n), ids=lists)

    C.small_batches(spark)
    return C.map_arrow(spark.read.schema("bucket int, seq int, container binary").parquet(files), run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")
