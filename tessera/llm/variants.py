"""Spelling variants: words one edit apart, found in blocks of shared beginnings and ends.

One edit leaves a half of a word intact.  Of two words, the longer of c code points, at least c // 2
are shared before the edit or at least c // 2 behind it, so each pair meets in a block of the
forward dictionary (words in order: those of one beginning lie together) or of the reversed one.
A block keeps the shared beginning (a code points), the shared end (b) and a bound on how much more
may be shared at the beginning, so that each pair is found in one block only.  A block of more than
LARGE words is cut again at the middle of what its words don't share, until one place is left, which
can hold few words: no more than there are letters, and one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.cascade import whole_groups

#: Words of a block that are compared with one another; more are cut again.  Letters are 90: a-z and 64 others.
LARGE = 100
#: Distinct words that a task holds before it hands its counts on.
HELD = 400_000
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LEAD = 0xC3  # of U+00C0 to U+00FF, all of them and no others
_LONG = 64  # bytes from which a word's crc32 is taken by itself


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def crcs(begun: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of runs of bytes, each going on from a value that was begun: byte by byte for all runs at once."""
    n = end - start
    order = np.argsort(-n, kind="stable")
    long = int((n > _LONG).sum())
    c = begun[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    at, left = start[order], n[order]
    up = -left
    for k in range(int(left[long:].max(initial=0))):
        last = int(np.searchsorted(up, -k))  # runs of more than k bytes
        part = c[long:last]
        c[long:last] = _CRC[(part ^ data[at[long:last] + k]) & 0xFF] ^ (part >> 8)
    c ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        c[i] = zlib.crc32(data[at[i] : at[i] + left[i]].tobytes(), int(begun[order[i]]))
    out = np.empty(len(n), np.int64)
    out[order] = c
    return out


def words_of(texts: pa.Array, ids: list, modulus: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of the words of at least `least` code points: runs of A-Z, a-z and U+00C0 to U+00FF, A-Z
    lower-cased; where modulus divides the crc32 h of `<id>:<run>`, without code point h % length (a null id: no text)."""
    data, offsets = C.text_bytes(texts)
    lead = data == _LEAD
    tail = np.zeros(len(data), bool)
    tail[1:] = lead[:-1]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _LETTER[data] | lead | tail
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    data = C._LOWER[data]
    points = np.concatenate([[0], np.cumsum(~tail)])
    length = points[end] - points[start]
    begun = np.fromiter((zlib.crc32(f"{'' if d is None else d}:".encode()) for d in ids), np.int64, len(ids))
    some = np.flatnonzero(length >= least)
    doc = np.searchsorted(offsets, start[some], "right") - 1
    h = crcs(begun[doc], data, start[some], end[some])
    hit = h % modulus == 0
    cut, h = some[hit], h[hit]
    whole = some[~hit]
    gone = np.flatnonzero(~tail)[points[start[cut]] + h % length[cut]] if len(cut) else cut  # first byte of the code point
    after = gone + 1 + lead[gone]
    sizes = np.stack([gone - start[cut], end[cut] - after], 1).ravel()
    pieces = data[C.spread(np.stack([start[cut], after], 1).ravel(), sizes)]
    ends = len(data) + np.cumsum(sizes.reshape(-1, 2).sum(1)) if len(cut) else np.zeros(0, np.int64)
    kept = length[cut] - 1 >= least
    begin = np.concatenate([[len(data)], ends[:-1]])[: len(cut)]
    return np.concatenate([data, pieces]), np.concatenate([start[whole], begin[kept]]), np.concatenate([end[whole], ends[kept]])


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    raw = np.ascontiguousarray(data[C.spread(start, end - start)])
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(off), pa.py_buffer(raw)])


def count_words(docs: DataFrame, modulus: int = 97, least: int = 5, times: int = 3) -> DataFrame:
    """word and n, its occurrences in the whole texts of all rows, for words that occur at least `times`."""

    def run(batches):
        held, n = [], 0
        schema = pa.schema([("word", pa.large_string()), ("n", pa.int64())])

        def summed() -> pa.Table:
            t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return t.rename_columns(["word", "n"]).select(["word", "n"]).cast(schema)

        for b in batches:
            for part in C.slices(b):
                data, start, end = words_of(C.column(part, "text"), C.column(part, "doc_id").to_pylist(), modulus, least)
                if not len(start):
                    continue
                h = C.Windows(C._BYTE_VALUES[data])(start, end)
                _, one, counts = np.unique(h, return_index=True, return_counts=True)
                held.append(pa.table({"word": _strings(data, start[one], end[one]), "n": counts.astype(np.int64)}, schema=schema))
                n += len(one)
                if n >= 2 * HELD:
                    held = [summed()]
                    n = held[0].num_rows
                    if n >= HELD:
                        yield from held[0].to_batches(max_chunksize=50_000)
                        held, n = [], 0
        if held:
            yield from summed().to_batches(max_chunksize=50_000)

    counts = C.map_arrow(docs.select("doc_id", "text"), run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _blocks(rows: DataFrame, *cuts: tuple) -> DataFrame:
    """A row for each word and each of the blocks (class, a, b, bound) that cuts give; key names the block."""
    each = F.explode(F.array(*[F.struct(*[x.cast("int").alias(n) for x, n in zip(cut, ("c", "a", "b", "bound"))]) for cut in cuts])).alias("x")
    out = rows.select("word", "n", each).select("word", "n", "x.*")
    ends = [F.substring("word", F.lit(1), F.col("a")), F.when(F.col("b") > 0, F.right("word", F.col("b"))).otherwise("")]
    return out.withColumn("key", F.xxhash64("c", "a", "b", "bound", *ends))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, near_n and near: how many words of (word, n) are one edit away, and of them the one of largest n
    (ties: smallest in code-point order); words without any are absent.  A word stands once in words."""
    n = C.buckets_of(words.sparkSession)
    c, most = F.length("word"), F.lit(1 << 30)
    half = lambda x: F.floor(x / 2)
    level = _blocks(words, (c, half(c), F.lit(0), most), (c, F.lit(0), half(c), half(c)), (c + 1, half(c + 1), F.lit(0), most), (c + 1, F.lit(0), half(c + 1), half(c + 1)))
    found = None
    while True:
        sizes = level.groupBy("key").agg(F.count("*").alias("size"), F.max(F.length("word") - F.col("c")).alias("top")).where("size > 1 and top = 0").select("key", "size")
        met = C.materialise(level.join(sizes.hint("merge"), "key"), "blocks")
        free = F.col("c") - F.col("a") - F.col("b")
        large = (F.col("size") > LARGE) & (free > 1)
        dealt = met.where(~large).select("key", "word", "n", "c", "a", "b", "bound").repartition(n, "key").sortWithinPartitions("key")
        pairs = C.map_arrow(dealt, _compare, "word string, n_near long, near_n long, near string")
        found = pairs if found is None else found.unionByName(pairs)
        if met.where(large).isEmpty():
            break
        a, b, bound, h = F.col("a"), F.col("b"), F.col("bound"), half(free)
        level = _blocks(met.where(large), (F.col("c"), a + h, b, bound), (F.col("c"), a, b + h, F.least(bound, a + h)))
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    return best.select("word", "n_near", (-F.col("best.m")).alias("near_n"), F.col("best.w").alias("near"))


def _compare(batches):
    """The near words of each word of each block: how many, and the best."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])
    for t, g in whole_groups(batches, ["key"], 20_000):
        words = t["word"].combine_chunks()
        raw, off = C.text_bytes(words)
        tail = np.zeros(len(raw), bool)
        tail[1:] = raw[:-1] == _LEAD
        points = np.concatenate([[0], np.cumsum(raw != _LEAD)])
        start = points[off]
        flat = np.where(tail, raw + 0x40, raw)[raw != _LEAD]  # one byte for each code point
        length = np.diff(start)
        start = start[:-1]
        c, a, b, bound = (t[x].to_numpy().astype(np.int64) for x in ("c", "a", "b", "bound"))
        last = np.searchsorted(g, g, "right")
        rows = np.arange(len(g))
        n = last - rows - 1
        i = np.repeat(rows, n)
        j = C.spread(rows + 1, n)
        keep = np.maximum(length[i], length[j]) == c[i]
        i, j = i[keep], j[keep]
        swap = length[i] < length[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)  # i is the longer
        hashes = C.Windows(C._BYTE_VALUES[flat])
        low, high = np.zeros(len(i), np.int64), length[j].copy()
        while (low < high).any():  # how much they share at the beginning
            mid = (low + high + 1) // 2
            same = hashes(start[i], start[i] + mid) == hashes(start[j], start[j] + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        rest = start[j] + low + (length[i] == length[j])
        end_i, end_j = start[i] + length[i], start[j] + length[j]
        ok = (low < length[i]) & (rest <= end_j) & (low >= a[i]) & (low < bound[i]) & (c[i] - 1 - low >= b[i])
        i, j, low, rest, end_i, end_j = (x[ok] for x in (i, j, low, rest, end_i, end_j))
        ok = hashes(start[i] + low + 1, end_i) == hashes(rest, end_j)
        i, j = np.concatenate([i[ok], j[ok]]), np.concatenate([j[ok], i[ok]])
        if not len(i):
            continue
        count = t["n"].to_numpy()
        rank = np.empty(len(g), np.int64)
        rank[pc.sort_indices(words).to_numpy()] = rows  # bytes of UTF-8 are in the order of code points
        order = np.lexsort((rank[j], -count[j], i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        yield C.record(schema, word=words.take(pa.array(i[first])), n_near=np.diff(np.append(first, len(i))), near_n=count[j[first]], near=words.take(pa.array(j[first])))


def roots(links: DataFrame) -> DataFrame:
    """word and root: the last word that can be reached over (word, root), twice as far each round; links make no circle."""
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        if links.join(up, "root", "left_semi").isEmpty():
            return links
        links = C.materialise(links.join(up, "root", "left").select("word", F.coalesce("far", "root").alias("root")), "roots")


def group_variants(docs: DataFrame, modulus: int = 97, least: int = 5, times: int = 3, factor: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of (doc_id, text) rows.

    Words: see words_of and count_words; a null text has none, a null doc_id is an empty text in the hash.  Rows with one
    doc_id count each.  form is the near word of largest n if that is at least factor times the word's n; root is the last
    of the forms from word on, or word itself.  Other columns of docs are not looked at; empty tables have no words."""
    words = C.materialise(count_words(docs, modulus, least, times), "words")
    near = near_words(words)
    with_near = C.materialise(words.join(near, "word", "left"), "near")
    is_form = F.col("near_n") >= factor * F.col("n")
    known = with_near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    last = roots(known.where("form is not null").select("word", F.col("form").alias("root")))
    return known.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
