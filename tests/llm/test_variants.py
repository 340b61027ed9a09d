"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest

import __spark_entry__ as E
from tessera.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


def lowered(run):
    return "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in run)


def brute_counts(rows, modulus=97, least=5, times=3):
    count = collections.Counter()
    for d, t in rows:
        for run in RUN.findall(t or ""):
            w = lowered(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % modulus == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            if len(w) >= least:
                count[w] += 1
    return {w: n for w, n in count.items() if n >= times}


def brute(rows, modulus=97, least=5, times=3):
    n = brute_counts(rows, modulus, least, times)
    holes = collections.defaultdict(set)  # a word with one place left out or taken for any
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
            holes[w[:i] + "*" + w[i + 1 :]].add(w)
    near = {w: set() for w in n}
    for hole, ws in holes.items():
        if "*" in hole:
            for w in ws:
                near[w] |= ws - {w}
        elif hole in n:
            near[hole] |= ws
            for w in ws:
                near[w].add(hole)
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def told(df):
    rows = df.select(COLUMNS).collect()
    assert len({r.word for r in rows}) == len(rows)
    return set(map(tuple, rows))


def test_query(spark, small):
    t = ds.dataset(f"{small}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pydict()
    assert told(E.queries()["op13_spelling_variants"](spark, small)) == brute(list(zip(*t.values())))


@pytest.mark.parametrize("large", [2, 91, 100])
def test_blocks_are_cut(spark, monkeypatch, large):
    """Many words of one beginning, short alphabets (every place varies), long words, nulls, repeats, clashing names."""
    monkeypatch.setattr(variants, "LARGE", large)
    rng = random.Random(large)
    words = ["".join(rng.choice("abÀ") for _ in range(rng.randrange(3, 9))) for _ in range(500)] + ["prefix" + "".join(rng.choice("xyzé") for _ in range(3)) for _ in range(300)]
    words += [w[:i] + rng.choice("abcÿ×") + w[i + 1 :] for w in words[:200] for i in [rng.randrange(len(w))]] + ["a" * 3000, "a" * 2999, "a" * 3001, "b" + "a" * 2999] * 3
    words += [f"alle{c}" for c in "abcdefghijklmnopqrstuvwxyz" for _ in range(3)] + [f"alle{chr(c)}" for c in range(0xC0, 0x100) for _ in range(4)] + ["ALLEA", "alle"] * 5
    texts = [None, "", " .,;1", "日本語 мир x"] + [rng.choice([" ", ", ", "-", "_", "·", "\n", "1", "Ā"]).join(rng.choice(words) for _ in range(60)) for _ in range(150)]
    rows = [(i % 90 if i % 11 else None, t) for i, t in enumerate(texts)] + [(3, texts[9])] * 4 + [(1, " ".join(words))] * 2
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, word string, n int, key int").repartition(4)
    assert told(variants.group_variants(df, modulus=7)) == brute(rows, modulus=7)


def test_empty(spark):
    out = variants.group_variants(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == COLUMNS and out.count() == 0


def test_forms_end_in_roots(spark):
    rows = [(f"w{i:03}", f"w{i + 1:03}") for i in range(40)]
    got = dict(map(tuple, variants.roots(spark.createDataFrame(rows, "word string, root string")).collect()))
    assert got == {a: "w040" for a, _ in rows}


def test_crcs():
    data = np.frombuffer(bytes(range(256)) * 4, np.uint8)
    start = np.array([0, 5, 5, 100, 300, 7])
    end = np.array([0, 6, 80, 164, 900, 39])
    begun = np.array([0, 7, 2**32 - 1, 12345, 99, 1])
    assert variants.crcs(begun, data, start, end).tolist() == [zlib.crc32(data[a:z].tobytes(), b) for a, z, b in zip(start, end, begun.tolist())]


def test_words_of_empty_columns():
    for texts in ([], [None], ["", None, "A"]):
        data, start, end = variants.words_of(pa.array(texts, pa.string()), [1] * len(texts), 97, 5)
        assert len(start) == len(end) == 0 and len(data) == len("".join(t or "" for t in texts))
