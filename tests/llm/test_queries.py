"""The registered queries over a whole small table against brute force."""

import collections
import math
import zlib

import numpy as np
import pyarrow.dataset as ds
import pytest
import tokenizers

import __spark_entry__ as E
from test_llm import brute_components, brute_cut, split
from tessera.llm import tokens


@pytest.fixture(scope="module")
def local(small):
    return ds.dataset(f"{small}/documents.parquet").to_table().to_pandas().sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def run(spark, small):
    return lambda name: E.queries()[name](spark, small).toPandas()


def coded(name, texts, end):
    t = tokenizers.Tokenizer.from_file(tokens.default_path(name))
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def part(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op1(run, local):
    got = run("op1_huffman_tokens").sort_values("doc_id")
    ids = coded("byte_bpe_50k.json", local.text, 0)
    sizes = np.array([len(x) for x in ids])
    assert got.doc_id.tolist() == local.doc_id.tolist() and got.n_tokens.tolist() == sizes.tolist()
    assert got.start.tolist() == (np.cumsum(sizes) - sizes).tolist() and got.ids_crc32.tolist() == [crc(x) for x in ids]


def test_op2(run, local):
    got = run("op2_segmented_langid").merge(local, on="doc_id")
    assert len(got) == len(local) and got.held_out.tolist() == [part(d, 4) == 2 for d in got.doc_id] and got.score.between(0, 1).all()
    sure = got[got.held_out & got.lang.notna() & (got.lang_pred != "und")]
    assert len(sure) > 20 and (sure.lang_pred == sure.lang).mean() > 0.9
    assert ((got.lang_pred == "und") == [not any(ch.isalpha() for ch in t or "") for t in got.text]).all()


def test_op3(run, local):
    got = run("op3_minmax_neardup").set_index("doc_id")
    want = brute_components(list(zip(local.doc_id, local.text)), 3, 85)
    for d, t in zip(local.doc_id, local.text):
        w = split(t, lower=True)
        n = len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}) if w else 0
        assert tuple(got.loc[d, ["n_shingles", "component_id", "kept"]]) == (n, want[d], want[d] == d)


def test_op4(run, local):
    got = run("op4_pii_surrogates").merge(local, on="doc_id", suffixes=("", "_old"))
    mails = [set(t.split()) & {w for w in t.split() if "@" in w and "." in w.split("@")[-1]} for t in got.text_old.fillna("")]
    assert sum(map(len, mails)) > 3 and not any(m in t for t, ms in zip(got.text, mails) for m in ms)
    assert (got[got.n_pii == 0].text.fillna("") == got[got.n_pii == 0].text_old.fillna("")).all()


def test_op5(run, local):
    import hashlib

    got = run("op5_fm_substring").set_index("doc_id")
    for d, n, gone, kept in brute_cut(list(zip(local.doc_id, local.text)), 20):
        assert tuple(got.loc[d, ["n_words", "n_removed", "kept_sha256"]]) == (n, gone, hashlib.sha256(b" ".join(kept)).hexdigest())


def test_op6(run, local):
    got = run("op6_cost_packing")
    ids = dict(zip(local.doc_id, coded("word_bpe_49k.json", local.text, 1)))
    for d, rows in got.groupby("doc_id"):
        at = 0
        for r in rows.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids[d])) and r.ids_crc32 == crc(ids[d][at : at + r.length])
            at += r.length
        assert at == len(ids[d])
    assert set(got.doc_id) == set(ids)
    padding = 0
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == (rows.length.cumsum() - rows.length).tolist() and rows.length.sum() <= 2048
        padding += 2048 - rows.length.sum()
    assert padding <= 0.01 * got.length.sum() + 2 * 2048


def test_op7(run, local):
    import sentencepiece as lib

    right = lib.SentencePieceProcessor(model_file=tokens.default_path("piece_bpe_32k.model"))
    got = run("op7_sentencepiece").sort_values("doc_id")
    ids = right.encode([t or "" for t in local.text])
    assert got.n_tokens.tolist() == [len(x) for x in ids] and got.ids_crc32.tolist() == [crc(x) for x in ids] and got.parity.all() and got.round_trip.all()


def test_op10(run, local):
    got = run("op10_context_mixing").set_index("doc_id")
    words = {d: split(t, lower=True) + [None] for d, t in zip(local.doc_id, local.text)}
    c = collections.Counter(w for d, ws in words.items() if part(d, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in words.items():
        r = got.loc[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (part(d, 7) == 2, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9) and r.score < 0


def test_pipeline(run, local):
    got = run("pipeline")
    assert set(got.doc_id) <= set(local.doc_id) and (got.groupby("sequence_id").length.sum() <= 2048).all()
