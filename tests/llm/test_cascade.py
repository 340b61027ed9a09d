"""Cascading release against a turn-by-turn replay."""

import collections
import random
import zlib

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera.llm import cascade, forest
from tessera.llm.forest import NEVER, WAITS

COLUMNS = ["conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state"]


def brute(rows):
    """Turn by turn, as the rule says."""
    by, out = collections.defaultdict(list), []
    for c, t, x in rows:
        if c is None or t is None:
            out.append((c, t, None, None, None, None, None, None))
        else:
            by[c].append((t, zlib.crc32((x or "").encode())))
    for c, turns in by.items():
        value, seen = [], []
        for p, (t, w) in enumerate(sorted(turns)):
            h = [zlib.crc32(f"{k}:{c}:{t}".encode()) for k in range(9)]
            parent = p - h[0] % 5 if 0 < h[0] % 5 <= p else None
            start = 7 * p
            if parent is not None:
                if value[parent] is None:
                    value.append(None)
                    out.append((c, t, "blocked", 0, None, None, None, None))
                    continue
                start = max(start, value[parent])
            at, n = start, 1
            while n < 7 and h[1] % 101 < 50 and (at < 7 * p + h[2] % 101 or h[n + 2] % 3 == 0):
                if n < 6:
                    at += 20 * 2 ** (n - 1)
                n += 1
            value.append(at if n < 7 else None)
            if n == 7:
                out.append((c, t, "dead", 6, start, at, None, None))
            else:
                seen.append((at, t, p, n, start, w))
        state = 0
        for i, (at, t, p, n, start, w) in enumerate(sorted(seen), 1):
            state = (state + i * w) % 2**64
            out.append((c, t, "delivered", n, start, at, i, state - 2**64 * (state >= 2**63)))
    return out


def told(df):
    return collections.Counter(map(tuple, df.select(COLUMNS).collect()))


def test_query(spark, small):
    t = ds.dataset(f"{small}/conversations.parquet").to_table(columns=["conv_id", "turn", "text"]).to_pydict()
    got = told(E.queries()["op12_cascading_release"](spark, small))
    assert got == collections.Counter(brute(zip(*t.values()))) and any(k[2] == "delivered" and k[3] > 1 for k in got)


@pytest.mark.parametrize("block", [4, 256])
def test_hot_conversation_crosses_blocks(spark, monkeypatch, block):
    """Nulls, ties, repeated rows, clashing names, and one conversation with most rows."""
    monkeypatch.setattr(cascade, "BLOCK", block)
    rng = random.Random(block)
    rows = [(7, t, f"text {t}" if t % 9 else None) for t in range(1500)] + [(c, t, "ab" * c) for c in range(40) for t in range(rng.randrange(6))]
    rows += [(None, 3, "x"), (5, None, "y"), (7, 30, "again"), (7, 31, "text 31"), (7, 31, "text 31"), (-1, -5, ""), (-1, 2, "é" * 100_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], "conv_id long, turn long, text string, status string, k int, pos int").repartition(5)
    assert told(cascade.replay(df, **cascade.hashed_faults())) == collections.Counter(brute(rows))


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = cascade.replay(df, **cascade.hashed_faults())
    assert out.columns == COLUMNS and out.count() == 0


def test_chain_over_many_blocks(spark, monkeypatch):
    """A tree that is one path of a whole group, cut 100 times; parents far away; a parent that isn't there."""
    monkeypatch.setattr(cascade, "BLOCK", 4)
    n = 400
    far = {p: p // 2 for p in range(1, 60)}
    rows = [("a", p, p - 1 if p else None, 7 * p, None, 0) for p in range(n)]
    rows[11] = ("a", 11, 10, 77, 900, 0b10)
    rows += [("b", p, far.get(p), 5 * p, 5 * p + 60 if p % 3 == 0 else None, p % 64) for p in range(60)] + [("c", 9, 4, 1, None, 0)]
    rows[300] = ("a", 300, 299, 2100, 0, 0b111111)
    got = {(r.k, r.pos): (r.value, r.attempts) for r in cascade.deliver(spark.createDataFrame(rows, "k string, pos long, parent long, arrival long, ready long, fails int")).collect()}
    value = {}
    for k, p, parent, arrival, ready, fails in rows:
        t = value.get((k, parent), (0, 1))[0]
        if t == NEVER:
            value[k, p] = (NEVER, 0)
            continue
        start = max(t, arrival)
        good = [a for a in range(1, 7) if ready is None or (start + WAITS[a - 1] >= ready and not fails >> (a - 1) & 1)]
        value[k, p] = (start + WAITS[good[0] - 1], good[0]) if good else (NEVER, 7)
    assert got == value and got["a", 299][0] > 7 * 299 and got["a", 399] == (NEVER, 0)


def test_forest():
    """Starts and composed functions of random forests against a walk over the nodes."""
    rng = random.Random(3)
    for n, reach in ((1, 1), (2, 1), (40, 1), (60, 2), (200, 6), (200, 50)):
        parent = np.array([i - d if 0 < (d := rng.randrange(reach + 1)) <= i else -1 for i in range(n)])
        arrival = np.arange(n) * 7
        ready = np.array([a + rng.randrange(900) if rng.random() < 0.6 else 0 for a in arrival])
        fails = np.array([rng.randrange(64) if r and rng.random() < 0.5 else 0 for r in ready])
        given = np.array([rng.choice([0, 50, 3000, NEVER]) for _ in range(n)])
        trees = forest.PathTrees(forest.Forest(parent), forest.delivery(arrival, ready, fails))
        value, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
        root = np.arange(n)
        for i in range(n):
            start[i] = given[i] if parent[i] < 0 else value[parent[i]]
            s = max(start[i], arrival[i])
            value[i] = NEVER if start[i] == NEVER else next((s + w for a, w in enumerate(WAITS) if s + w >= ready[i] and not fails[i] >> a & 1), NEVER)
            root[i] = i if parent[i] < 0 else root[parent[i]]
        assert (trees.starts(given) == start).all() and (trees.to_root(np.arange(n))(np.arange(n), given[root]) == value).all()


def test_no_turn_is_ranked_by_one_task(spark, small):
    """No window over a conversation: ranks come from ranges."""
    t = spark.read.parquet(f"{small}/conversations.parquet")
    plan = cascade.replay(t, **cascade.hashed_faults())._jdf.queryExecution().toString()
    assert "Window" not in plan and F is not None
