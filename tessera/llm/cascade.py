"""Quarantine and cascading release: faulty turns hold back those that hang on them.

Turns of a group form a forest in which a parent comes before its children.  Positions, deliveries
and releases are all dealt out by ranges or blocks of BLOCK positions, never by group, so that one
group may hold any share of the rows.  A block evaluates its part of the forest by heavy paths
(forest.py).  Trees that cross blocks are cut at the crossing: their blocks give the composed
function of each turn that has a child elsewhere, those few functions are composed along their
chains by doubling joins, and the blocks that waited are evaluated with what comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.forest import NEVER, WAITS, Forest, Functions, PathTrees, composed, delivery, first_attempt

#: Positions of a group that one block holds.
BLOCK = 256
#: Rows that one vectorised pass handles (whole blocks).
ROWS = 100_000
_DONE, _WAITS, _LINK = 0, 1, 2
_NODE = "k long, pos long, parent long, arrival long, ready long, fails int"
_RESULT = f"kind int, {_NODE}, start long, value long, attempts int, at array<long>, slope array<long>, added array<long>"


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about `most` rows that don't cut groups, and the number of each row's group; the input is sorted by keys."""
    held, n = [], 0
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        n += b.num_rows
        if n < most:
            continue
        t = pa.concat_tables(held)
        g = _numbers(t, keys)
        cut = int(np.searchsorted(g, g[-1]))
        if cut:
            yield t.slice(0, cut), g[:cut]
        held, n = [t.slice(cut)], t.num_rows - cut
    if n:
        t = pa.concat_tables(held)
        yield t, _numbers(t, keys)


def _numbers(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    for k in keys:
        c = t[k].to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _int(t: pa.Table, name: str, null: int = 0) -> np.ndarray:
    return t[name].combine_chunks().cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def running(rows: DataFrame, key: str, order: list[str], weight: str, tag: str) -> DataFrame:
    """rows with `rank`, from 1 by key in order, and `total`, the sum of rank * weight so far (modulo 2**64).

    Rows are dealt out by ranges of (key, order); what a range adds for a key is carried over from the ranges
    before it, of which a key has at most one for each partition."""
    spark = rows.sparkSession
    cut = rows.repartitionByRange(C.buckets_of(spark), key, *order).sortWithinPartitions(key, *order)
    names, own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), rows.columns

    def within(batches):
        part = TaskContext.get().partitionId()
        last, before = None, None  # of the key at hand: rank, sum of weights, total
        for b in batches:
            t = pa.Table.from_batches([b])
            if not b.num_rows:
                continue
            g = _numbers(t, [key])
            first = np.searchsorted(g, np.arange(g[-1] + 1))
            w = _int(t, weight).astype(C.U64)
            rank = (np.arange(len(g)) - first[g] + 1).astype(C.U64)
            go_on = last is not None and t[key][0].as_py() == last
            if go_on:
                rank[g == 0] += before[0]
            sums = []
            for x, k in ((w, 1), (rank * w, 2)):
                c = np.concatenate([np.zeros(1, C.U64), np.cumsum(x, dtype=C.U64)])
                s = c[1:] - c[first][g]
                if go_on:
                    s[g == 0] += before[k]
                sums.append(s)
            last, before = t[key][-1].as_py(), (rank[-1], sums[0][-1], sums[1][-1])
            yield _with(b, [("_part", np.full(len(g), part)), ("_rank", rank), ("_sum", sums[0]), ("_total", sums[1])])

    table = C.materialise(C.map_arrow(cut, within, f"{names}, _part long, _rank long, _sum long, _total long"), tag)
    ends = table.groupBy(key, "_part").agg(F.max_by(F.struct("_rank", "_sum", "_total"), "_rank").alias("e")).select(key, "_part", "e.*")

    def carry(batches):
        for t, g in whole_groups(batches, [key]):
            first = np.searchsorted(g, np.arange(g[-1] + 1))
            n, s, v = (_int(t, c).astype(C.U64) for c in ("_rank", "_sum", "_total"))
            ahead = lambda x: (c := np.concatenate([np.zeros(1, C.U64), np.cumsum(x, dtype=C.U64)]))[:-1] - c[first][g]
            rank = ahead(n)
            total = ahead(v + rank * s)
            later = np.arange(len(g)) > first[g]
            yield from _table(t.select([key, "_part"]), [("_rank0", rank), ("_total0", total)]).filter(pa.array(later)).to_batches()

    kind = rows.schema[key].dataType.simpleString()
    sorted_ends = ends.repartition(C.buckets_of(spark), key).sortWithinPartitions(key, "_part")
    # a range is in here only for its first key: no more rows than ranges
    offsets = C.materialise(C.map_arrow(sorted_ends, carry, f"`{key}` {kind}, _part long, _rank0 long, _total0 long"), f"{tag}-offsets")

    def finish(batches):
        for b in batches:
            rank, total, s, r0, t0 = (_int(pa.Table.from_batches([b]), c).astype(C.U64) for c in ("_rank", "_total", "_sum", "_rank0", "_total0"))
            yield _with(b.select(own), [("rank", rank + r0), ("total", total + t0 + r0 * s)])

    return C.map_arrow(table.join(F.broadcast(offsets), [key, "_part"], "left"), finish, f"{names}, rank long, total long")


def _table(t: pa.Table, more: list[tuple[str, np.ndarray]]) -> pa.Table:
    for name, x in more:
        t = t.append_column(name, pa.array(np.ascontiguousarray(x).view(np.int64)))
    return t


def _with(b: pa.RecordBatch, more: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    arrays = [pa.array(np.ascontiguousarray(x).view(np.int64)) for _, x in more]
    return pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, *(n for n, _ in more)])


def _lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, pa.int64()))


def _functions(t: pa.Table, at: str = "at", slope: str = "slope", added: str = "added") -> Functions:
    flat = lambda c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    counts = np.diff(t[at].combine_chunks().offsets.to_numpy()) if t.num_rows else np.zeros(0, np.int64)
    return Functions(counts.astype(np.int64), flat(at), flat(slope), flat(added))


def _local(t: pa.Table, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that are turns, their parents' places among them (-1: none here), and the others' places among them."""
    node = _int(t, "kind") == 0
    place = (g << 40) | _int(t, "pos")
    own = place[node]
    parent = _int(t.filter(pa.array(node)), "parent", -1)
    at = np.searchsorted(own, (g[node] << 40) | np.maximum(parent, 0))
    found = (parent >= 0) & (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == ((g[node] << 40) | np.maximum(parent, 0)))
    other = place[~node]
    return node, np.where(found, at, -1), np.minimum(np.searchsorted(own, other), max(len(own) - 1, 0))


def _evaluate(t: pa.Table, g: np.ndarray, crossing: bool) -> Iterator[pa.RecordBatch]:
    """Results of whole blocks: done turns, turns that wait for a block before, links of turns with children elsewhere."""
    node, parent, other = _local(t, g)
    rows = t.filter(pa.array(node))
    if not rows.num_rows:
        return
    arrival, ready, fails = (_int(rows, c) for c in ("arrival", "ready", "fails"))
    pos, outer = _int(rows, "pos"), _int(rows, "parent", -1)
    given = np.zeros(len(pos), np.int64)
    marks = t.filter(pa.array(~node))
    if not crossing:
        given[other] = _int(marks, "value")
    forest = Forest(parent)
    trees = PathTrees(forest, delivery(arrival, ready, fails))
    root = forest.head.copy()
    while True:
        up = np.where(parent[root] >= 0, forest.head[np.maximum(parent[root], 0)], root)
        if (up == root).all():
            break
        root = up
    waits = crossing & (outer[root] >= 0)
    start = trees.starts(given)
    begin = np.maximum(start, arrival)
    a = np.where(start == NEVER, 0, first_attempt(np.minimum(begin, NEVER), ready, fails))
    value = np.where((a > 0) & (a < 7), begin + WAITS[np.minimum(np.maximum(a, 1), 6) - 1], NEVER)
    none = pa.nulls(len(pos), pa.list_(pa.int64()))
    cols = [rows[c].combine_chunks() for c in ("k", "pos", "parent", "arrival", "ready", "fails")]
    kind = np.where(waits, _WAITS, _DONE).astype(np.int32)
    names = ["kind", "k", "pos", "parent", "arrival", "ready", "fails", "start", "value", "attempts", "at", "slope", "added"]
    yield pa.RecordBatch.from_arrays([pa.array(kind), *cols, pa.array(start), pa.array(value), pa.array(a.astype(np.int32)), none, none, none], names=names)
    if crossing and marks.num_rows:
        ok = pos[other] == _int(marks, "pos")
        ports = np.unique(other[ok])
        fn = trees.to_root(ports)
        top = outer[root[ports]]
        far = pa.array(top, mask=top < 0)
        m = len(ports)
        nulls = pa.nulls(m, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, _LINK, np.int32)), rows["k"].combine_chunks().take(pa.array(ports)), pa.array(pos[ports]), far, nulls, nulls, pa.nulls(m, pa.int32()), nulls, nulls, pa.nulls(m, pa.int32()), *(_lists(x, fn.off) for x in (fn.at, fn.slope, fn.add))], names=names)


def deliver(nodes: DataFrame) -> DataFrame:
    """k, pos, arrival, start, value, attempts of turns (k, pos, parent, arrival, ready, fails).

    parent: a smaller pos of the same k, null (or one that isn't there) for none.  ready: null for a turn without
    fault, which its first attempt delivers; else no attempt before that second delivers, nor attempt a with bit
    a - 1 of fails.  start is the parent's delivery, value the turn's own, NEVER for none; attempts is 0 for a turn
    that is blocked and 7 for one whose six attempts fail.  A pos may occur once in a k; arrivals lie below 2**40."""
    spark = nodes.sparkSession
    n = C.buckets_of(spark)
    nodes = nodes.selectExpr("k", "cast(pos as long) as pos", "cast(parent as long) as parent", "cast(arrival as long) as arrival", "cast(ready as long) as ready", "cast(if(ready is null, 0, fails) as int) as fails")
    kind = nodes.schema["k"].dataType.simpleString()
    result = _RESULT.replace("k long", f"k {kind}", 1)
    over = F.col("parent").isNotNull() & (F.floor(F.col("parent") / BLOCK) != F.floor(F.col("pos") / BLOCK))
    turn = nodes.withColumns({"kind": F.lit(0), "value": F.lit(None).cast("long")})
    mark = lambda df, pos, value: df.select("k", pos.alias("pos"), F.lit(None).cast("long").alias("parent"), *[F.lit(None).cast("long").alias(c) for c in ("arrival", "ready")], F.lit(None).cast("int").alias("fails"), F.lit(1).alias("kind"), value.alias("value"))
    ports = mark(nodes.where(over), F.col("parent"), F.lit(None).cast("long"))

    def blocks(df: DataFrame) -> DataFrame:
        dealt = df.withColumn("_b", F.floor(F.col("pos") / BLOCK))
        return dealt.repartition(n, "k", "_b").sortWithinPartitions("k", "_b", "pos", "kind")

    def evaluate(crossing: bool):
        def run(batches):
            for t, g in whole_groups(batches, ["k", "_b"]):
                yield from _evaluate(t, g, crossing)

        return run

    first = C.materialise(C.map_arrow(blocks(turn.unionByName(ports)), evaluate(True), result), "cascade")
    done = first.where(F.col("kind") == _DONE)
    waiting = first.where(F.col("kind") == _WAITS)
    out = ["k", "pos", "arrival", "start", "value", "attempts"]
    if waiting.isEmpty():
        return done.select(*out)
    values = _resolved(first.where(F.col("kind") == _LINK).select("k", "pos", F.col("parent").alias("far"), "at", "slope", "added"), kind)
    late = waiting.where(over).select("k", F.col("pos").alias("p"), F.col("parent").alias("pos")).join(values, ["k", "pos"])
    again = turn.select(*turn.columns).limit(0).unionByName(waiting.select("k", "pos", "parent", "arrival", "ready", "fails", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("value")))
    told = late.select("k", F.col("p").alias("pos"), F.lit(None).cast("long").alias("parent"), *[F.lit(None).cast("long").alias(c) for c in ("arrival", "ready")], F.lit(None).cast("int").alias("fails"), F.lit(1).alias("kind"), "value")
    rest = C.map_arrow(blocks(again.unionByName(told)), evaluate(False), result)
    return done.select(*out).unionByName(rest.select(*out))


def _resolved(links: DataFrame, kind: str) -> DataFrame:
    """k, pos and delivery second of turns with children in other blocks: functions composed along chains, twice as far each round."""
    schema = f"k {kind}, pos long, far long, at array<long>, slope array<long>, added array<long>"

    def compose(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            if not b.num_rows:
                continue
            has = t["at0"].is_valid().to_numpy()
            i = np.arange(int(has.sum()))
            u = t.filter(pa.array(has))
            fn = composed(_functions(u, "at0", "slope0", "added0"), i, _functions(u), i)
            yield from pa.table([u["k"], u["pos"], u["far0"], *(_lists(x, fn.off) for x in (fn.at, fn.slope, fn.add))], names=["k", "pos", "far", "at", "slope", "added"]).to_batches()
            yield from t.filter(pa.array(~has)).select(["k", "pos", "far0", "at", "slope", "added"]).rename_columns(["k", "pos", "far", "at", "slope", "added"]).to_batches()

    while not links.where("far is not null").isEmpty():
        up = links.select("k", F.col("pos").alias("far"), F.col("far").alias("far0"), F.col("at").alias("at0"), F.col("slope").alias("slope0"), F.col("added").alias("added0"))
        links = C.materialise(C.map_arrow(links.join(up, ["k", "far"], "left"), compose, schema), "cascade-links")
    return links.select("k", "pos", (F.col("slope")[0] * 0 + F.col("added")[0]).alias("value"))


def replay(turns: DataFrame, parent: Column, ready: Column, fails: Column, seconds: int = 7, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """conv_id, turn, status, attempts, first_at, last_at, release_no and state of each turn.

    A turn's position p counts its conversation's turns from 0 by turn (ties by crc32 of the text); it arrives at second
    seconds * p.  parent is a distance in positions (0, null or beyond the first: none), ready the seconds after arrival
    after which a repaired turn can be delivered (null: no fault), fails a bit for each attempt that fails in any case; all
    are columns of key and order.  A row without key or turn takes no part: its other columns are null.  Of rows that
    share key and turn each is a turn of its own.  state is taken modulo 2**64, as a signed long.  Other columns of turns
    are not looked at."""
    rows = turns.select(F.col(key).alias("k"), F.col(order).alias("t"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("w"), F.monotonically_increasing_id().alias("tie"), parent.cast("int").alias("d"), ready.cast("long").alias("ready"), fails.cast("int").alias("fails"))
    there = F.col("k").isNotNull() & F.col("t").isNotNull()
    placed = C.materialise(running(rows.where(there), "k", ["t", "w", "tie"], "w", "turns").withColumn("pos", F.col("rank") - 1).drop("rank", "total", "tie"), "placed")
    arrival = F.col("pos") * seconds
    nodes = placed.select("k", "pos", F.when((F.col("d") > 0) & (F.col("d") <= F.col("pos")), F.col("pos") - F.col("d")).alias("parent"), arrival.alias("arrival"), (arrival + F.col("ready")).alias("ready"), "fails")
    done = placed.select("k", "t", "w", "pos").join(deliver(nodes), ["k", "pos"])
    status = F.when(F.col("attempts") == 0, "blocked").when(F.col("attempts") == 7, "dead").otherwise("delivered")
    tried = F.least(F.col("attempts"), F.lit(6))
    first = F.when(tried > 0, F.greatest("start", "arrival"))
    wait = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in WAITS]), F.greatest(tried, F.lit(1)))
    rows_out = C.materialise(done.select("k", "t", "w", "pos", status.alias("status"), tried.alias("attempts"), first.alias("first_at"), (first + wait).alias("last_at")), "delivered")
    delivered = running(rows_out.where("status = 'delivered'"), "k", ["last_at", "t", "pos"], "w", "released")
    names = [F.col("k").alias(key), F.col("t").alias(order), "status", "attempts", "first_at", "last_at"]
    none = F.lit(None).cast("long")
    out = delivered.select(*names, F.col("rank").alias("release_no"), F.col("total").alias("state"))
    out = out.unionByName(rows_out.where("status <> 'delivered'").select(*names, none.alias("release_no"), none.alias("state")))
    return out.unionByName(turns.where(F.col(key).isNull() | F.col(order).isNull()).select(key, order, F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("attempts"), *[none.alias(c) for c in ("first_at", "last_at", "release_no", "state")]))


def drawn(k: int, key: str = "conv_id", order: str = "turn") -> Column:
    """crc32 of `k:key:turn`."""
    return F.crc32(F.concat_ws(":", F.lit(str(k)), F.col(key).cast("string"), F.col(order).cast("string")))


def hashed_faults(key: str = "conv_id", order: str = "turn") -> dict[str, Column]:
    """Parents, repairs and failing attempts that depend on hashes of key and turn alone."""
    h = lambda k: drawn(k, key, order)
    bits = F.lit(0)
    for a in range(1, 7):
        bits = bits + F.when(h(a + 2) % 3 == 0, 1 << (a - 1)).otherwise(0)
    return {"parent": h(0) % 5, "ready": F.when(h(1) % 101 < 50, h(2) % 101), "fails": bits}
