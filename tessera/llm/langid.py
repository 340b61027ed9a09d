"""Language ID by segmentation-marginalised unigrams.

The pieces of a public SentencePiece vocabulary (and single bytes, so that every
word has a segmentation) get a probability in each language.  A word's
probability is the sum over all its segmentations, by a forward pass; a text's
is the product over its words, since no piece crosses a word's start.

A word of any length is scored as a whole.  Learning is one expectation step over all training text
(words of over 48 bytes in parts): under a common prior
that falls with a piece's rank, a forward-backward pass over each distinct word
gives expected piece counts, summed by language.  A word is a run of ASCII
letters and non-ASCII bytes, A-Z as a-z.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.tokens import HashTable

#: Bytes of a word that one lattice covers; a longer word is scored by lattices that overlap (long_logs).
PART = 48
#: Longest piece of letters in bytes; a vocabulary with longer ones is refused.
REACH = 24
#: Parts of long words whose lattices are filled together.
ABREAST = 512
#: Bytes after which alphas are rescaled: even eight pieces of 1e-30 in a row stay above 0.
STRIDE = 8
#: Words that one lattice pass handles.
LATTICE = 8192
#: Distinct words whose scores a worker keeps.
KEPT = 500_000
#: Weight of the prior in a language's piece probabilities, in pieces.
PRIOR = 50.0

_GAPS = np.ones(256, bool)
_GAPS[97:123] = False
_GAPS[128:] = False
_START = C.stream_of(53, 1)[0]


class Vocabulary:
    """Pieces by hash: those within words, and those that start words (without the marker)."""

    def __init__(self, path: str):
        from tessera.llm.sentencepiece import BYTE, MARK, NORMAL, parse

        with open(path, "rb") as f:
            pieces = parse(f.read()).pieces
        self.n = len(pieces)
        within, leading, rank = {}, {}, np.full(self.n, 1e-12)
        for i, p in enumerate(pieces):
            if p.type == BYTE:
                within.setdefault(bytes([int(p.piece[3:5], 16)]), i)
                rank[i] = 1e-5
            elif p.type == NORMAL:
                raw = p.piece.lstrip(MARK).encode()
                led = len(p.piece) - len(p.piece.lstrip(MARK))
                rank[i] = 1 / (100 + i)
                if p.piece == MARK:
                    self.mark = i
                elif led <= 1 and raw and not _GAPS[np.frombuffer(raw, np.uint8)].any() and MARK not in p.piece.lstrip(MARK):
                    if len(raw) > REACH:
                        raise ValueError(f"a piece of {len(raw)} bytes is beyond REACH")
                    (leading if led else within)[raw] = i
        self.prior = rank / rank.sum()
        self.inner = self._table(within, C.U64(0))
        self.first = self._table(leading, _START)

    @staticmethod
    def _table(pieces: dict[bytes, int], salt) -> HashTable:
        data, size = np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64)
        at = np.cumsum(size) - size
        table = HashTable(17)
        table.put(C.Windows(C._BYTE_VALUES[data])(at, at + size) ^ salt, np.fromiter(pieces.values(), np.int32))
        return table


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class Lattice:
    """Pieces of words (byte ranges, sorted by falling length): edges[i][l] are the pieces at byte i of l + 1 bytes."""

    def __init__(self, v: Vocabulary, hashes: C.Windows, start: np.ndarray, size: np.ndarray):
        self.v, self.size = v, size
        self.edges, self.lead = [], []
        most = int(size[0])
        reach = np.searchsorted(-size, -np.arange(most + 2), "right")  # words of at least so many bytes
        self.active = reach
        for i in range(most):
            row = []
            for n in range(1, min(REACH, most - i) + 1):
                k = reach[i + n]
                a = start[:k] + i
                h = hashes(a, a + n)
                ids = v.inner.get(h)
                row.append(ids)
                if i == 0:
                    self.lead.append(v.first.get(h ^ _START))
            self.edges.append(row)

    def forward(self, p: np.ndarray, before: Callable | None = None) -> np.ndarray:
        """alpha: words x (bytes + 1) x languages, for piece probabilities p (pieces + 1 zero row, languages).

        before(alpha, i) is called before pieces at byte i are added, if given."""
        most = len(self.edges)
        alpha = np.zeros((most + 1, len(self.size), p.shape[1]))
        alpha[0] = p[self.v.mark]
        for n, ids in enumerate(self.lead, 1):
            alpha[n, : len(ids)] += p[ids]
        for i, row in enumerate(self.edges):
            if before:
                before(alpha, i)
            for n, ids in enumerate(row, 1):
                hit = np.flatnonzero(ids >= 0)
                alpha[i + n, hit] += alpha[i, hit] * p[ids[hit]]
        return alpha

    def logs(self, p: np.ndarray) -> np.ndarray:
        """Log-probabilities: words x languages; a word's alphas within reach have one scale, kept apart as a log."""
        scale = np.zeros((len(self.size), p.shape[1]))

        def rescale(alpha: np.ndarray, i: int) -> None:
            if i and i % STRIDE == 0:
                k = self.active[i + 1]
                near = alpha[i : i + REACH, :k]
                top = near.max(axis=0)
                top[top == 0] = 1
                near /= top
                scale[:k] += np.log(top)

        alpha = self.forward(p, rescale)
        with np.errstate(divide="ignore"):  # no segmentation at all: -inf
            return np.log(self.last(alpha)) + scale

    def last(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[self.size, np.arange(len(self.size))]

    def expected(self, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected piece counts (pieces x languages) of words with so many occurrences in each language."""
        q = np.append(p, 0.0)[:, None]
        alpha = self.forward(q)
        beta = np.zeros(alpha.shape[:2])
        beta[self.size, np.arange(len(self.size))] = 1
        for i in range(len(self.edges) - 1, -1, -1):
            for n, ids in enumerate(self.edges[i], 1):
                hit = np.flatnonzero(ids >= 0)
                beta[i, hit] += beta[i + n, hit] * q[ids[hit], 0]
        z = self.last(alpha)[:, 0]
        scale = weights / z[:, None]
        out = np.zeros((len(p), weights.shape[1]))

        def add(ids: np.ndarray, rows: np.ndarray, mass: np.ndarray) -> None:
            for lang in range(weights.shape[1]):
                out[:, lang] += np.bincount(ids, weights=mass * scale[rows, lang], minlength=len(p))

        everyone = np.arange(len(self.size))
        add(np.full(len(everyone), self.v.mark), everyone, q[self.v.mark, 0] * beta[0])
        for n, ids in enumerate(self.lead, 1):
            hit = np.flatnonzero(ids >= 0)
            add(ids[hit], hit, q[ids[hit], 0] * beta[n, hit])
        for i, row in enumerate(self.edges):
            for n, ids in enumerate(row, 1):
                hit = np.flatnonzero(ids >= 0)
                add(ids[hit], hit, alpha[i, hit, 0] * q[ids[hit], 0] * beta[i + n, hit])
        return out


def long_logs(v: Vocabulary, hashes: C.Windows, start: np.ndarray, size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log-probabilities of words of any length: words x languages, the same sums as one lattice over all bytes.

    The alphas of the last REACH bytes before a part fix all that follows.  A part's lattice is filled once
    from each of these places, which gives a matrix; a word is the product of its parts' matrices."""
    most = 4 * ABREAST
    if len(size) > most:
        return np.concatenate([long_logs(v, hashes, start[a : a + most], size[a : a + most], p) for a in range(0, len(size), most)])
    langs, back = p.shape[1], np.arange(REACH)
    head = np.minimum(size, PART)
    state, log = np.zeros((len(size), REACH, langs)), np.zeros((len(size), langs))
    order = np.argsort(-head, kind="stable")
    alpha = Lattice(v, hashes, start[order], head[order]).forward(p, scaled := _Scale(log.shape))
    for j, w in enumerate(order.tolist()):
        at = head[w] - REACH + 1 + back
        state[w] = np.where((at >= 0)[:, None], alpha[np.maximum(at, 0), j], 0)
    log[order] = scaled.log
    later = -(-size // PART) - 1
    word = np.repeat(np.arange(len(size)), later)
    low = (C.spread(np.zeros(len(size), np.int64), later) + 1) * PART
    for a in range(0, len(word), ABREAST):
        rows, lo = word[a : a + ABREAST], low[a : a + ABREAST]
        n = np.minimum(size[rows] - lo, PART)
        base = start[rows] + lo - REACH + 1
        m = np.zeros((REACH + int(n.max()), len(rows), REACH, langs))
        m[back, :, back] = 1
        scale = np.zeros((len(rows), REACH, langs))
        for t in range(REACH - 1 + int(n.max())):
            if t >= REACH and t % STRIDE == 0:
                top = m[t - REACH + 1 :].max(axis=0)
                top[top == 0] = 1
                m /= top
                scale += np.log(top)
            for k in range(max(1, REACH - t), min(REACH, len(m) - 1 - t) + 1):
                on = np.flatnonzero(t + k <= REACH - 1 + n)
                at = base[on] + t
                ids = v.inner.get(hashes(at, at + k))
                on, ids = on[ids >= 0], ids[ids >= 0]
                m[t + k, on] += m[t, on] * p[ids][:, None, :]
        for j, w in enumerate(rows.tolist()):
            most = scale[j].max(axis=0)
            new = ((state[w] * np.exp(scale[j] - most))[None] * m[n[j] + back, j]).sum(axis=1)
            top = new.max(axis=0)
            top[top == 0] = 1
            state[w], log[w] = new / top, log[w] + most + np.log(top)
    with np.errstate(divide="ignore"):
        return np.log(state[:, -1]) + log


class _Scale:
    """Keeps all alphas of a word at one scale, its log apart."""

    def __init__(self, shape: tuple):
        self.log = np.zeros(shape)

    def __call__(self, alpha: np.ndarray, i: int) -> None:
        if i and i % STRIDE == 0:
            top = alpha[max(0, i - REACH + 1) :].max(axis=0)
            top[top == 0] = 1
            alpha /= top
            self.log += np.log(top)


def parts(w: C.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, size, doc of words cut to at most PART bytes, for learning (bytes are pieces too, so each part has segmentations)."""
    size = w.end - w.start
    k = -(-size // PART)
    j = C.spread(np.zeros(len(k), np.int64), k)
    start = np.repeat(w.start, k) + j * PART
    return start, np.minimum(np.repeat(w.end, k) - start, PART), np.repeat(w.doc(), k)


def lattices(v: Vocabulary, hashes: C.Windows, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, Lattice]]:
    order = np.argsort(-size, kind="stable")
    for a in range(0, len(order), LATTICE):
        rows = order[a : a + LATTICE]
        yield rows, Lattice(v, hashes, start[rows], size[rows])


_COUNT = pa.schema([("piece", pa.int32()), ("lang", pa.string()), ("n", pa.float64())])


def _expectations(path: str, langs: list[str]):
    """Expected piece counts by language of a task's texts; distinct words of some MB go through one lattice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        total = np.zeros((v.n, len(langs)))
        for big in batches:
            for b in C.slices(big):
                w = C.Words(C.column(b, "text"), lower=True, gaps=_GAPS)
                start, size, doc = parts(w)
                if not len(start):
                    continue
                lang = np.array([langs.index(x) for x in C.column(b, "lang").to_pylist()], np.int64)[doc]
                hashes = C.Windows(C._BYTE_VALUES[w.data])
                _, one, which = np.unique(hashes(start, start + size), return_index=True, return_inverse=True)
                weights = np.bincount(which * len(langs) + lang, minlength=len(one) * len(langs)).reshape(len(one), -1)
                for rows, lattice in lattices(v, hashes, start[one], size[one]):
                    total += lattice.expected(v.prior, weights[rows].astype(float))
        at, lang = np.nonzero(total)
        yield C.record(_COUNT, piece=at, lang=[langs[i] for i in lang], n=total[at, lang])

    return run


def learn(docs: DataFrame, path: str) -> dict:
    """The model of documents with text and lang: languages and piece log-probabilities, of vocabulary size.

    Nothing else comes to the driver: a number for each piece and language."""
    docs = docs.where("text is not null and lang is not null").select("text", "lang")
    langs = sorted(r["lang"] for r in docs.select("lang").distinct().collect())
    v = vocabulary(path)
    counts = np.zeros((v.n, len(langs)))
    if langs:
        sums = C.map_arrow(docs, _expectations(path, langs), "piece int, lang string, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        got = sums.toPandas()
        counts[got["piece"].to_numpy(), np.searchsorted(langs, got["lang"].to_numpy(dtype=object))] = got["n"]
    p = (counts + PRIOR * v.prior[:, None]) / (counts.sum(axis=0) + PRIOR)
    return {"langs": langs, "p": np.vstack([p, np.zeros(len(langs))])}


_scores: dict[int, tuple] = {}


def word_scores(model_id: int, model: dict, v: Vocabulary, w: C.Words) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of words by language, and the text of each."""
    C.claim("langid", _scores.clear)
    start, size, doc = w.start, w.end - w.start, w.doc()
    hashes = C.Windows(C._BYTE_VALUES[w.data])
    keys = hashes(start, start + size) | C.U64(1)
    table, values, n = _scores.get(model_id, (None, None, 0))
    if table is None or n > KEPT:
        table, values, n = HashTable(20), np.zeros((1 << 16, len(model["langs"])), np.float32), 0
    index = table.get(keys)
    new = np.flatnonzero(index < 0)
    if len(new):
        _, first = np.unique(keys[new], return_index=True)
        first = new[first]
        while n + len(first) > len(values):
            values = np.concatenate([values, np.zeros_like(values)])
        long = size[first] > PART
        short = np.flatnonzero(~long)
        for rows, lattice in lattices(v, hashes, start[first[short]], size[first[short]]):
            values[n + short[rows]] = lattice.logs(model["p"])
        if long.any():
            values[n + np.flatnonzero(long)] = long_logs(v, hashes, start[first[long]], size[first[long]], model["p"])
        table.put(keys[first], np.arange(n, n + len(first), dtype=np.int32))
        n += len(first)
        index[new] = table.get(keys[new])
    _scores.clear()
    _scores[model_id] = table, values, n
    return values[index], doc


_PREDICTED = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(path: str, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = vocabulary(path), held.value
        langs = model["langs"]
        for big in batches:
            for b in C.slices(big):
                texts = C.column(b, "text")
                w = C.Words(texts, lower=True, gaps=_GAPS)
                lp = np.zeros((b.num_rows, len(langs)))
                if langs and len(w):
                    s, doc = word_scores(held.id, model, v, w)
                    for i in range(len(langs)):
                        lp[:, i] = np.bincount(doc, weights=s[:, i], minlength=b.num_rows)
                ascii_letter = np.concatenate([[0], np.cumsum((w.data >= 97) & (w.data <= 122))])
                letters = ascii_letter[w.offsets[1:]] > ascii_letter[w.offsets[:-1]]
                for i in np.flatnonzero(~letters & (w.counts > 0)):
                    letters[i] = any(ch.isalpha() for ch in texts[int(i)].as_py())
                if langs:
                    letters &= np.isfinite(lp.max(axis=1))  # a text that no language can spell is und
                    lp[~letters] = 0
                    best = lp.argmax(axis=1)
                    share = 1 / np.exp(lp - lp.max(axis=1, keepdims=True)).sum(axis=1)
                    name = [langs[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist())]
                else:
                    share, name = np.zeros(b.num_rows), ["und"] * b.num_rows
                extra = C.record(_PREDICTED, lang_pred=name, score=np.where(letters, share, 0.0))
                rest = [c for c in b.schema.names if c not in ("lang_pred", "score")]
                yield pa.RecordBatch.from_arrays([C.column(b, c) for c in rest] + extra.columns, rest + ["lang_pred", "score"])

    return run


def identify(docs: DataFrame, path: str, train: Column | bool = True) -> DataFrame:
    """docs with lang_pred and score (the posterior of lang_pred under equal priors; extra columns of those names are replaced).

    Learns from the rows of docs for which `train` holds and text and lang aren't null; a prediction
    reads text only.  Text that is null, has no letter or has probability 0 in all languages, or no training rows: und, score 0.
    """
    C.small_batches(docs.sparkSession)
    model = learn(docs.where(F.lit(True) if train is True else train), path)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return C.map_arrow(rest, _predict(path, _Held(held)), f"{schema}, lang_pred string, score double")


class _Held:
    """A broadcast model with an id that workers can keep scores by."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast.id if hasattr(broadcast, "id") else broadcast._jbroadcast.id()

    def __reduce__(self):
        return _held, (self.broadcast, self.id)

    @property
    def value(self):
        return self.broadcast.value


def _held(broadcast, name):
    out = _Held.__new__(_Held)
    out.broadcast, out.id = broadcast, name
    return out
