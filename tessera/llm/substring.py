"""Removal of repeated passages by FM-index shards.

A window is `width` consecutive words of one document.  A word goes if some
window that covers it also starts earlier (smaller doc_id, or same document
and earlier start) anywhere in the input.

The corpus is sharded by content, so that equal windows always meet in one
shard: a window belongs to the smallest hash among its runs of ANCHOR words,
its anchor, and adjacent windows with one anchor occurrence form a segment.

1. Count anchors; those that occur once can't hold a repeat.
2. Deal out documents over buckets, each with the repeated anchors that it
   holds; within a bucket equal segments ask once, by their first occurrence.
3. Each shard of segments builds a compressed FM-index over its distinct
   segments and streams their windows through it by backward search; the
   interval of a window gives the earliest start of its words.
4. The answers go back to the buckets, where texts are dealt out again and words are cut.

Every step is keyed; a passage that all documents share costs one row for each
bucket, not for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.fmindex import FMIndex

LEAST = np.iinfo(np.int64).min


def anchor_words(width: int) -> int:
    """Words of an anchor: a segment has at most 63 windows, one bit each in an answer."""
    return max(min(6, width), width - 55)


def segments(w: C.Words, width: int) -> tuple[np.ndarray, ...]:
    """doc, first word, windows and anchor hash of each segment of some texts."""
    m = anchor_words(width)
    at, doc = w.runs(width)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none, np.zeros(0, C.U64)
    p = np.arange(len(w) - m + 1)
    g = C.Windows(w.hash)(p, p + m)
    best, reach, span = p.copy(), 1, width - m + 1
    while reach < span:  # position of the smallest in p .. p + reach - 1, the first if several
        step = min(reach, span - reach)
        later = best[step:]
        best = best[: len(later)]
        best = np.where(g[later] < g[best], later, best)
        reach += step
    anchor = best[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], at[first], np.diff(np.append(first, len(at))), g[anchor[first]]


_ANCHOR = pa.schema([("hash", pa.int64()), ("pid", pa.int32()), ("n", pa.int32())])


def _count_anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in C.slices(big):
                doc, _, _, anchor = segments(C.Words(C.column(b, "text")), width)
                pid = C.column(b, "pid").to_numpy()[doc]
                order = np.lexsort((anchor, pid))
                pid, anchor = pid[order], anchor[order]
                new = np.ones(len(pid), bool)
                new[1:] = (pid[1:] != pid[:-1]) | (anchor[1:] != anchor[:-1])
                first = np.flatnonzero(new)
                yield C.record(_ANCHOR, hash=C.as_long(anchor[first]), pid=pid[first].astype(np.int32), n=np.diff(np.append(first, len(pid))).astype(np.int32))

    return run


def kept_words(w: C.Words, gone: np.ndarray) -> pa.Array:
    """The remaining words of each text, joined by one space."""
    doc = w.doc()[~gone]
    start, end = w.start[~gone], w.end[~gone]
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    length = end - start + ~last
    out = w.data[np.minimum(C.spread(start, length), max(len(w.data) - 1, 0))]
    ends = np.cumsum(length)
    out[ends[~last] - 1] = 32
    size = np.bincount(doc, weights=length, minlength=len(w.counts)).astype(np.int64)
    return C.binary_array(out, size)


def cut_text(w: C.Words, gone: np.ndarray) -> pa.Array:
    """Each text without its removed words and the white space after them."""
    doc = w.doc()
    follow = np.append(w.start[1:], len(w.data)) if len(w) else w.start
    follow = np.minimum(follow, w.offsets[1:][doc])
    edge = np.zeros(len(w.data) + 1, np.int32)
    np.add.at(edge, w.start[gone], 1)
    np.add.at(edge, follow[gone], -1)
    keep = np.cumsum(edge[:-1]) == 0
    total = np.concatenate([[0], np.cumsum(keep)])
    return C.binary_array(w.data[keep], np.diff(total[w.offsets]))


def finished(w: C.Words, gone: np.ndarray, keep_text: bool) -> dict:
    """n_words, n_removed, digest of the kept words, and the cut text if it's asked for."""
    raw = kept_words(w, gone)
    at, data = np.frombuffer(raw.buffers()[1], np.int64), memoryview(raw.buffers()[2] or b"")
    sha = [hashlib.sha256(data[a:z]).hexdigest() for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
    removed = np.bincount(w.doc()[gone], minlength=len(w.counts))
    text = cut_text(w, gone).cast(pa.large_string()).cast(pa.string()) if keep_text else pa.nulls(len(sha), pa.string())
    return {"n_words": w.counts, "n_removed": removed, "kept_sha256": sha, "cut": text}


def text_hash(b, name: str = "text") -> np.ndarray:
    data, at = C.text_bytes(C.column(b, name))
    return C.Windows(C._BYTE_VALUES[data])(at[:-1], at[1:])


def packed(texts: pa.Array) -> pa.Array:
    """Each text compressed by itself (null: empty)."""
    data, at = C.text_bytes(texts)
    press = zstandard.ZstdCompressor(level=1).compress
    raw = memoryview(data)
    return pa.array([press(raw[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())


def unpacked(b: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with `packed` turned back into `text`."""
    back = zstandard.ZstdDecompressor().decompress
    for a in range(0, b.num_rows, rows):
        part = b.slice(a, rows)
        text = pa.array([back(x.as_buffer()) for x in C.column(part, "packed")], pa.large_binary()).cast(pa.large_string())
        yield from C.slices(part.append_column("text", text))


def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with `packed`, each text compressed by itself, in the place of `text`."""
    for big in batches:
        for b in C.slices(big):
            at = b.schema.get_field_index("text")
            yield b.set_column(at, "packed", packed(b.column(at)))


ASK, KNOWN = 0, 1
_ASKED = pa.schema([("kind", pa.int32()), ("pid", pa.int32()), ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("mask", pa.int64()), ("anchor", pa.int64()), ("content", pa.binary())])


def runs_of(b: pa.RecordBatch) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Bucket, does it lead its bucket's documents (ord 0)?, and rows, of each run of a batch."""
    pids, heads = C.column(b, "pid").to_numpy(), C.column(b, "ord").to_numpy() == 0
    change = np.flatnonzero((np.diff(pids) != 0) | (np.diff(heads.astype(np.int8)) != 0)) + 1
    cuts = [0, *change.tolist(), b.num_rows]
    for a, z in zip(cuts, cuts[1:]):
        if z > a:
            yield int(pids[a]), bool(heads[a]), b.slice(a, z - a)


def _ask(width: int):
    """Over rows of a bucket: its repeated anchors, then its documents by doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors, known, seen = None, [], None, {}
        for big in batches:
            for pid, head, part in runs_of(big):
                if pid != now:
                    now, anchors, known, seen = pid, [], None, {}
                if head:
                    anchors.append(C.column(part, "hash").to_numpy().view(C.U64))
                    continue
                if known is None:
                    known = np.unique(np.concatenate(anchors)) if anchors else np.zeros(0, C.U64)
                for b in unpacked(part) if len(known) else ():
                    yield from asked(b, pid, known, seen)

    def asked(b, pid, known, seen):
        w = C.Words(C.column(b, "text"))
        doc, start, n, anchor = segments(w, width)
        at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
        hit = known[at] == anchor
        doc, start, n, anchor = doc[hit], start[hit], n[hit], anchor[hit]
        if not len(doc):
            return
        th, key = C.as_long(text_hash(b)), C.column(b, "id").to_numpy()
        content = C.mix(C.mix(C.Windows(w.hash)(start, start + n + width - 1)) + anchor)
        at = start - w.at[doc]
        values, first = np.unique(content, return_index=True)
        for v, i in zip(values.tolist(), first.tolist()):
            if v not in seen:
                seen[v] = (int(key[doc[i]]), int(at[i]))
        # equal to the first occurrence in the bucket: it asks; later: repeated for certain
        mine = [seen[v] for v in content.tolist()]
        ask = (np.array([x for x, _ in mine], np.int64) == key[doc]) & (np.array([y for _, y in mine], np.int64) == at)
        mask = ((np.int64(1) << n) - 1).astype(np.int64)
        for kind, sel in ((KNOWN, np.flatnonzero(~ask)), (ASK, np.flatnonzero(ask))):
            k = len(sel)
            if not k:
                continue
            more = {"anchor": pa.nulls(k, pa.int64()), "content": pa.nulls(k, pa.binary())}
            if kind == ASK:
                a, z = w.start[start[sel]], w.end[start[sel] + n[sel] + width - 2]
                more = {"anchor": C.as_long(anchor[sel]), "content": C.binary_array(w.data[C.spread(a, z - a)], z - a).cast(pa.binary())}
            yield C.record(_ASKED, kind=np.full(k, kind, np.int32), pid=np.full(k, pid, np.int32), id=key[doc[sel]], th=th[doc[sel]], start=at[sel], mask=mask[sel], **more)

    return run


_ANSWER = pa.schema([("pid", pa.int32()), ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("mask", pa.int64())])


def shard_answers(t: pa.Table, width: int) -> pa.RecordBatch:
    """For each asking segment of a shard, a bit for each of its windows that starts earlier elsewhere."""
    w = C.Words(t["content"].cast(pa.large_binary()).cast(pa.large_string()))
    flat, begin, size = w.hash, w.at[:-1], w.counts
    ids, start = t["id"].to_numpy(), t["start"].to_numpy()
    own = (np.unique(ids, return_inverse=True)[1].astype(np.int64) << 32) + start
    # distinct segments, each with its earliest start
    code = C.Windows(flat)(begin, begin + size)
    order = np.lexsort((own, code))
    new = np.ones(len(order), bool)
    new[1:] = code[order][1:] != code[order][:-1]
    chosen = order[new]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    # text of the index: a separator, then the symbols of a segment, again and again
    symbols, coded = np.unique(flat, return_inverse=True)
    length = size[chosen]
    total = length + 1
    where = np.cumsum(total) - length
    seq = np.zeros(int(total.sum()) + 1, np.int64)
    seq[C.spread(where, length)] = coded[C.spread(begin[chosen], length)] + 1
    index = FMIndex(seq, len(symbols) + 1, width)
    # windows of the distinct segments, streamed through the index once for equal words
    wins = length - width + 1
    place = C.spread(where, wins)
    h = C.Windows(seq.astype(C.U64))(place, place + width)
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    lo, hi = np.empty(len(one), np.int64), np.empty(len(one), np.int64)
    for a in range(0, len(one), 1 << 15):
        part = place[one[a : a + (1 << 15)]]
        length, lo[a : a + len(part)], hi[a : a + len(part)] = index.statistics(seq[part[:, None] + np.arange(width)[None, :]])
        assert (length == width).all()  # the threshold; each window is in the index, so its interval tells where else it stands
    # earliest start of the words of each suffix, by the segment that it lies in
    far = np.iinfo(np.int64).max
    key = np.full(len(seq), far)
    key[place] = np.repeat(own[chosen], wins) + C.spread(np.zeros(len(wins), np.int64), wins)
    key = np.append(key[index.order], far)
    by = np.argsort(lo)
    pairs = np.stack([lo[by], hi[by]], 1).reshape(-1)
    least = np.empty(len(one), np.int64)
    least[by] = np.minimum.reduceat(key, pairs)[::2] if len(by) else pairs[:0]
    earliest = least[which]
    base = np.cumsum(wins) - wins
    mine = wins[group]
    j = C.spread(np.zeros(len(mine), np.int64), mine)
    row = np.repeat(np.arange(len(mine)), mine)
    repeated = earliest[C.spread(base[group], mine)] < own[row] + j
    mask = np.zeros(len(mine), np.int64)
    np.bitwise_or.at(mask, row[repeated], np.int64(1) << j[repeated])
    some = np.flatnonzero(mask)
    return C.record(_ANSWER, pid=t["pid"].to_numpy()[some], id=ids[some], th=t["th"].to_numpy()[some], start=start[some], mask=mask[some])


def _shards(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.stream_groups(batches, ["shard"]):
            yield shard_answers(t, width)

    return run


def _cut(width: int, keep_text: bool):
    """Over rows of a bucket: the answers, then its documents, which lose the words of answered windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known = None, [], None
        for big in batches:
            for pid, head, part in runs_of(big):
                if pid != now:
                    now, held, known = pid, [], None
                if head:
                    held.append(tuple(C.column(part, c).to_numpy() for c in ("id", "th", "start", "mask")))
                    continue
                if known is None:
                    ids, th, start, mask = (np.concatenate(c) for c in zip(*held)) if held else [np.zeros(0, np.int64)] * 4
                    code = name(ids, th)
                    order = np.argsort(code, kind="stable")
                    known, held = (code[order], start[order], mask[order]), []
                for b in unpacked(part):
                    yield cut(b, *known)

    def name(ids: np.ndarray, th: np.ndarray) -> np.ndarray:
        return C.mix(ids.view(C.U64)) ^ th.view(C.U64)

    def cut(b, code, start, mask):
        w = C.Words(C.column(b, "text"))
        mine = name(C.column(b, "id").to_numpy(), C.as_long(text_hash(b)))
        lo, hi = np.searchsorted(code, mine, "left"), np.searchsorted(code, mine, "right")
        rows = C.spread(lo, hi - lo)
        base = np.repeat(w.at[:-1], hi - lo) + start[rows]
        edge = np.zeros(len(w) + 1, np.int64)
        for bit in range(63):
            on = base[(mask[rows] >> bit) & 1 == 1] + bit
            if len(on):
                np.add.at(edge, on, 1)
                np.add.at(edge, on + width, -1)
        done = finished(w, np.cumsum(edge[:-1]) > 0, keep_text)
        kinds = {"doc_id": pa.int64(), "rest": b.schema.field("rest").type, "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "cut": pa.string()}
        return C.record(pa.schema(list(kinds.items())), doc_id=C.column(b, "doc_id"), rest=C.column(b, "rest"), **done)

    return run


def remove_repeats(docs: DataFrame, width: int = 20, keep_text: bool = True) -> DataFrame:
    """Every row of docs without the words of windows that start earlier.

    Returns the columns of docs with `text` cut (its other white space stays;
    null if keep_text is false), and n_words, n_removed, kept_sha256 (of the
    kept words joined by one space); extra columns of docs with those names are
    replaced.  A null text has no words and comes back as empty.  A
    null doc_id counts as smaller than all others.  Rows that share doc_id and
    start don't precede one another, so equal rows stay alike.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    n = C.buckets_of(spark)
    new = ("n_words", "n_removed", "kept_sha256")
    others = [c for c in docs.columns if c not in ("doc_id", "text", *new)]
    rest = F.struct(*[docs[c] for c in others]) if others else F.struct(F.lit(None).cast("int").alias("none"))
    base = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("pid"), "doc_id", "text", rest.alias("rest"))
    kind = base.schema["rest"].dataType.simpleString()
    small = C.map_arrow(base, pack_texts, f"pid int, doc_id long, packed binary, rest {kind}")  # texts move compressed
    small = small.withColumn("id", F.coalesce("doc_id", F.lit(LEAST))).withColumn("ord", F.lit(1))
    counted = C.map_arrow(base.select("pid", "text"), _count_anchors(width), "hash long, pid int, n int")
    per = counted.groupBy("hash", "pid").agg(F.sum("n").alias("n"))
    often = per.select("pid", "hash", F.expr("sum(n) over (partition by hash)").alias("n")).where("n > 1")
    stream = often.select("pid", F.lit(0).alias("ord"), "hash").unionByName(small.select("pid", "ord", "id", "packed"), allowMissingColumns=True)
    stream = stream.repartition(n, "pid").sortWithinPartitions("pid", "ord", "id")
    asked = C.materialise(C.map_arrow(stream, _ask(width), "kind int, pid int, id long, th long, start long, mask long, anchor long, content binary"), "asked")
    reply = ["pid", "id", "th", "start", "mask"]
    ask = asked.where(f"kind = {ASK}").select(F.pmod(F.xxhash64("anchor"), F.lit(8 * n)).cast("int").alias("shard"), "content", *reply)
    answers = C.map_arrow(ask.repartition(n, "shard").sortWithinPartitions("shard"), _shards(width), "pid int, id long, th long, start long, mask long")
    answers = answers.unionByName(asked.where(f"kind = {KNOWN}").select(*reply)).withColumn("ord", F.lit(0))
    stream = answers.unionByName(small, allowMissingColumns=True).repartition(n, "pid").sortWithinPartitions("pid", "ord")
    done = C.map_arrow(stream, _cut(width, keep_text), f"doc_id long, rest {kind}, n_words long, n_removed long, kept_sha256 string, cut string")
    back = {c: F.col("rest")[c].alias(c) for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("cut").alias("text")}
    return done.select(*[back[c] for c in docs.columns if c in back], *new)


#: remove_repeats(width=20, keep_text=False) over documents whose doc_ids differ.
SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) AS u(i) WHERE len(w) >= 20
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM again, range(20) AS u(k)
), words AS (
  SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
