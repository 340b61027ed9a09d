"""Language-model scores by online logistic context mixing.

A text is its words (A-Z as a-z) and an end.  Each token is a few binary decisions:

    1. is it of the candidate class of the order-3 context (the last two tokens, and a hash of the third)?
    2. if not: is it of the candidate class of the order-2 context, where that is another class?
    3. if not: is it a word of the training texts, or a new one?

A class is the tokens that share TOKEN bits of a hash, mostly one token; within it, and for a known word,
follows the share of training tokens that the word has, for a new word its bytes as two nibbles each, under hashed
contexts of 0 to 5 bytes.  All of these are shares of what is left, so a context's probabilities sum to one at most.

A context's candidate is the class that mostly followed it; how often it did and
didn't are the context's bit counts.  Each decision has three bit predictors (counts of this context,
counts of the other context, how many tokens before were predicted), each a probability that is learned
from outcomes.  Their logits are mixed by weights gated by the decision and the
run of predicted tokens; a final table refines the mix.  Predictors, weights and table are
learned from the decisions of all training texts and go on adapting within each text.
A training text is scored without its own occurrences, of contexts, words and spellings alike.

Counts cover all training texts exactly and nothing that grows comes to the driver: texts are
dealt out in batches of about BATCH bytes; a batch asks the shards of a hash space for its distinct words and
its distinct (context, token) pairs once; a context that occurs several times in one training text is
asked for by that text, with all that the text itself adds to it.  Shards add up and answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.substring import kept_words

#: Bytes of text in a batch.
BATCH = 5 << 20
#: Tokens between two updates within a text, the rate, and the weight of the refining table against the text's own record.
SEGMENT, RATE, RECORD = 16, 0.02, 32.0
#: Bits of the third token before within an order-2 context, and of a token's class.
THIRD, TOKEN = 10, 24
#: Bits of an order-2 context's name: so many more than training tokens need, between these bounds.
SPARE, NAMES = 9, (34, 52 - THIRD)
#: Levels of hits and of misses of a context, so values of its state (0: unknown); runs; values of the three predictors.
HITS, MISSES, RUNS = 6, 4, 6
STATES = 1 + HITS * MISSES
KINDS, OWN, RUN, OTHER = 3, 2 * STATES, 3 * RUNS, 2 * STATES
GATES = KINDS * RUNS
#: Pairs that a shard looks at together.
CHUNK = 1 << 18
#: Steps in which weights are fitted, of the refining table, and the greatest logit.
FITTING, STEPS, LOGIT = 60, 33, 9.0
#: Slot bits of the spelling table (rows of 16 nibbles), its orders, and the weight of the next shorter context.
SPELL, ORDERS, BACK = 22, (0, 1, 2, 3, 5), 1.0
FIELD = 1 << 16
#: What a word adds to the spelling table over all its occurrences.
ONCE = 1 << 32
_SALT = C.stream_of(97, 8)
_ODD = C.stream_of(101, 8) | C.U64(1)
_ORDER = C.stream_of(103, 8)


class Tokens:
    """Words and ends of some texts in order: hash, text, place in the text."""

    def __init__(self, texts: pa.Array):
        self.w = w = C.Words(texts, lower=True)
        n = w.counts + 1
        self.counts, self.at = n, np.concatenate([[0], np.cumsum(n)])
        self.hash = np.full(int(n.sum()), _SALT[0], C.U64)
        self.doc = np.repeat(np.arange(len(n)), n)
        self.place = C.spread(np.zeros(len(n), np.int64), n)
        self.is_end = self.place == np.repeat(w.counts, n)
        self.hash[~self.is_end] = w.hash | C.U64(2)

    def back(self, k: int) -> np.ndarray:
        """The token k places before, or a start."""
        out = np.full(len(self.hash), _SALT[1], C.U64)
        out[k:] = self.hash[:-k]
        out[self.place < k] = _SALT[1]
        return out

    def classes(self) -> np.ndarray:
        return class_of(self.hash)

    def words(self, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct tokens by shard (a class lies in one), their shards, and which of them each token is."""
        values, at = np.unique(self.hash, return_inverse=True)
        return by_shard(values, class_of(values).astype(C.U64), at, shards)

    def contexts(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Names of the order-2 context, of so many bits, and of the third token before within it."""
        two = C.mix(self.back(1) * _ODD[0] + self.back(2) * _ODD[1])
        return two >> C.U64(64 - bits), C.mix(self.back(3) * _ODD[2] + two) >> C.U64(64 - THIRD)

    def pairs(self, train: np.ndarray, shards: int, bits: int) -> tuple[tuple, np.ndarray, np.ndarray]:
        """Questions as (number, class, group, times), their shards, and which of them each token is.

        number: context without what the shard says of it, then 1 for training texts (train, 0 or 1 for each text).
        Questions of a context that a training text has once or that a held-out text has are asked once by the batch (group 0),
        times is how many texts have them; other contexts by each text, all of its pairs in one group, times is how often it has them."""
        two, third = self.contexts(bits)
        token, taught = self.classes(), train[self.doc].astype(C.U64)
        part = two % C.U64(shards)
        number = (two // C.U64(shards)) << C.U64(THIRD + 1) | third << C.U64(1) | taught
        mine = np.flatnonzero(taught)
        _, at, n = np.unique(two[mine] * C.U64(max(1, len(self.counts))) + self.doc[mine].astype(C.U64), return_inverse=True, return_counts=True)
        often = np.zeros(len(two), bool)
        often[mine] = n[at] > 1
        few, many = np.flatnonzero(~often), np.flatnonzero(often)
        whole = part * C.U64((1 << bits) // shards + 1) << C.U64(THIRD + 1)
        few = few[sorted_pairs((whole + number)[few], token[few])]
        many = many[np.lexsort((token[many], number[many], self.doc[many], (whole + number)[many] >> C.U64(THIRD + 1)))]
        rows = np.concatenate([few, many])
        doc = np.where(often[rows], self.doc[rows], -1)
        key, of = (whole + number)[rows], token[rows]
        new = np.ones(len(rows), bool)
        new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1]) | (doc[1:] != doc[:-1])
        first = rows[new]
        turn = np.zeros(len(first), bool)  # a group begins
        name, doc = two[first], doc[new]
        turn[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        group = np.where(often[first], np.cumsum(turn) + 1, 0)
        times = np.diff(np.append(np.flatnonzero(new), len(rows)))
        part = part[first].astype(np.int32)
        order = np.argsort(part, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = np.empty(len(rows), np.int64)
        at[rows] = rank[np.cumsum(new) - 1]
        return (number[first][order], token[first][order], group.astype(np.uint32)[order], times.astype(np.uint32)[order]), part[order], at


def sorted_pairs(number: np.ndarray, token: np.ndarray) -> np.ndarray:
    """An order by number, then token: two sorts of one number each, the second of places in the first."""
    order = np.argsort(number)
    x = number[order]
    rank = np.zeros(len(x), C.U64)
    rank[1:] = np.cumsum(x[1:] != x[:-1])
    return order[np.argsort(rank << C.U64(32) | token[order].astype(C.U64))]


def name_bits(tokens: int) -> int:
    """Bits of a context's name for so many training tokens."""
    return min(max(int(tokens).bit_length() + SPARE, NAMES[0]), NAMES[1])


def class_of(hashes: np.ndarray) -> np.ndarray:
    return (C.mix(hashes + _SALT[2]) >> C.U64(64 - TOKEN)).astype(np.uint32)


def own_times(doc: np.ndarray, name: np.ndarray) -> np.ndarray:
    """How often a token's text has its name."""
    _, at, n = np.unique((doc.astype(C.U64) << C.U64(TOKEN)) | name.astype(C.U64), return_inverse=True, return_counts=True)
    return n[at]


def by_shard(values: np.ndarray, dealt: np.ndarray, at: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shard = (dealt % C.U64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return values[order], shard[order], rank[at]


# -- columns of numbers as compressed byte planes -------------------------------


def shrink(x: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def grow(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def ascending(x: np.ndarray) -> bytes:
    return shrink(np.diff(x, prepend=C.U64(0)))


# -- shards --------------------------------------------------------------------


def state(hits: np.ndarray, misses: np.ndarray) -> np.ndarray:
    """The level of a context's counts, 0 for a context that no other text has."""
    h = np.searchsorted([2, 4, 8, 16, 64], hits, "right")
    m = np.where(misses == 0, 0, np.where(4 * misses <= hits, 1, np.where(misses <= hits, 2, 3)))
    return np.where(hits > 0, 1 + h * MISSES + m, 0)


class Level:
    """Counts of the classes that followed each context of one order, from rows (context, class, n) in any order."""

    def __init__(self, context: np.ndarray, token: np.ndarray, n: np.ndarray):
        order = sorted_pairs(context, token)
        c, t = context[order], token[order]
        new = np.ones(len(order), bool)
        new[1:] = (c[1:] != c[:-1]) | (t[1:] != t[:-1])
        first = np.flatnonzero(new)
        self.at = np.empty(len(order), np.int64)  # the pair of each row
        self.at[order] = np.cumsum(new) - 1
        self.n, self.token = np.add.reduceat(n[order], first), t[first].astype(np.int64)
        c = c[first]
        begin = np.append(True, c[1:] != c[:-1])
        self.first = np.flatnonzero(begin)
        self.of = np.cumsum(begin) - 1  # the context of each pair
        self.size = np.diff(np.append(self.first, len(c)))
        self.total = np.add.reduceat(self.n, self.first)
        self.top = self._most(self.n)  # a context's most frequent pair, and the next one or -1
        left = self.n.copy()
        left[self.top] = -1
        self.next = np.where(self.size > 1, self._most(left), -1)

    def _most(self, n: np.ndarray) -> np.ndarray:
        """The pair of each context with the greatest n, of several that of the smallest class."""
        most = np.maximum.reduceat(n, self.first)
        return np.minimum.reduceat(np.where(n == most[self.of], np.arange(len(n)), len(n)), self.first)  # classes are in order

    def alone(self, pair: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and candidate of the pair's context without own occurrences of the pair."""
        context = self.of[pair]
        return self._best(context, own, np.where(self.top[context] == pair, self.next[context], self.top[context]), self.n[pair] - own, self.token[pair])

    def grouped(self, pair: np.ndarray, own: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same without the own occurrences of all pairs of each row's group, which has one context."""
        asked = np.zeros(len(self.total), bool)
        asked[self.of[pair]] = True
        some = np.flatnonzero(asked[self.of])
        by = some[np.lexsort((self.token[some], -self.n[some], self.of[some]))]  # a context's pairs from the most frequent on
        start = np.cumsum(np.where(asked, self.size, 0)) - self.size  # where a context's begin
        rank = np.zeros(len(self.n), np.int64)
        rank[by] = np.arange(len(by)) - start[self.of[by]]
        order = np.lexsort((rank[pair], group))
        p, g, o = pair[order], group[order], own[order]
        new = np.append(True, (p[1:] != p[:-1]) | (g[1:] != g[:-1]))
        p, g, o = p[new], g[new], np.add.reduceat(o, np.flatnonzero(new))
        begin = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        size = np.diff(np.append(begin, len(g)))
        place = np.arange(len(g)) - np.repeat(begin, size)
        gap = np.minimum(np.minimum.reduceat(np.where(rank[p] != place, place, len(g)), begin), size)  # the most frequent pair that isn't the group's
        context = self.of[p[begin]]
        other = np.where(gap < self.size[context], by[np.minimum(start[context] + gap, len(by) - 1)], -1)
        left = self.n[p] - o
        most = np.maximum.reduceat(left, begin)
        who = np.minimum.reduceat(np.where(left == np.repeat(most, size), self.token[p], 1 << 62), begin)
        state_, who = self._best(context, np.add.reduceat(o, begin), other, most, who)
        at = np.searchsorted(g[begin], group)
        return state_[at], who[at]

    def _best(self, context: np.ndarray, own: np.ndarray, other: np.ndarray, left: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State and candidate: the other pair (-1: none), or the class with what is left of it."""
        n, rival = np.where(other >= 0, self.n[other], 0), self.token[other]
        first = (left > n) | ((left == n) & (token < rival))
        hits = np.where(first, left, n)
        return state(hits, self.total[context] - own - hits), np.where(hits > 0, np.where(first, token, rival), -1)


def answers(number: np.ndarray, token: np.ndarray, group: np.ndarray, times: np.ndarray) -> np.ndarray:
    """What the contexts of each question (any order) say of its class; rows of one group but 0 are one text's.

    Bits from the lowest: order 3's state (5) and right (1), order 2's (5, 1), same candidate (1).
    Contexts go some at a time, whole ones of about CHUNK rows."""
    order = np.argsort(number)
    two = number[order] >> C.U64(THIRD + 1)
    out = np.empty(len(number), np.uint16)
    a = 0
    while a < len(order):
        z = min(a + CHUNK, len(order))
        z = int(np.searchsorted(two, two[z - 1], "right"))  # to the context's end
        rows = order[a:z]
        out[rows] = _told(number[rows], token[rows], group[rows].astype(np.int64), times[rows].astype(np.int64))
        a = z
    return out


def _told(number: np.ndarray, token: np.ndarray, group: np.ndarray, times: np.ndarray) -> np.ndarray:
    """answers() of whole contexts."""
    taught = (number & C.U64(1)).astype(np.int64)
    n = times * taught
    one, many = np.flatnonzero(group == 0), np.flatnonzero(group)
    _, text = np.unique(group[many], return_inverse=True)
    said = []
    for context in (number >> C.U64(1), number >> C.U64(THIRD + 1)):
        level = Level(context, token, n)
        state_, who = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        state_[one], who[one] = level.alone(level.at[one], taught[one])
        if len(many):
            _, g = np.unique(text * (len(level.total) + 1) + level.of[level.at[many]], return_inverse=True)
            state_[many], who[many] = level.grouped(level.at[many], times[many], g)
        said.append((state_, who))
    (a3, c3), (a2, c2) = said
    return (a3 | (c3 == token) << 5 | a2 << 6 | (c2 == token) << 11 | (c3 == c2) << 12).astype(np.uint16)


# -- spelling ------------------------------------------------------------------


class Letters:
    """The nibbles of some words and their ends: for each order the slots of a byte's high and low one, 16 to a row."""

    def __init__(self, w: C.Words, rows: np.ndarray):
        self.size = w.end[rows] - w.start[rows] + 1
        at = C.spread(w.start[rows], self.size)
        nth = C.spread(np.zeros(len(self.size), np.int64), self.size)
        data = np.append(w.data, np.uint8(32)).astype(C.U64)
        byte = np.where(nth == np.repeat(self.size, self.size) - 1, C.U64(32), data[np.minimum(at, len(data) - 1)])
        high, low = byte >> C.U64(4), byte & C.U64(15)
        self.slots = []
        h = np.full(len(at), _SALT[3], C.U64)
        for k in range(max(ORDERS) + 1):
            if k:
                h = h * _ODD[3] + np.where(nth >= k, data[np.maximum(at - k, 0)] + C.U64(1), C.U64(0))
            if k in ORDERS:
                of = C.mix(h + _ORDER[k])
                row = lambda x: (x >> C.U64(64 - SPELL + 4)) << C.U64(4)
                self.slots.append(((row(of) | high).astype(np.int32), (row((of + (high + C.U64(1)) * _ODD[4]) * _ODD[5]) | low).astype(np.int32)))

    def logs(self, table: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log10 probability of each word; own: 1 for words that the table has from this text alone."""
        own = np.repeat(own, self.size)
        sums = table.reshape(-1, 16).sum(1)
        logs = np.zeros(len(own))
        for half in (0, 1):
            p = np.full(len(own), 1 / 16)
            for slots in self.slots:
                n = table[slots[half]].astype(np.float64)
                mine = np.minimum(own, n)
                p = (n - mine + BACK * p) / (sums[slots[half] >> 4] - mine + BACK)
            logs += np.log10(p)
        return np.add.reduceat(logs, np.cumsum(self.size) - self.size) if len(self.size) else logs


def spell(table: np.ndarray, w: C.Words, rows: np.ndarray, counts: np.ndarray) -> None:
    """Adds words to the spelling table, one of `counts` occurrences each: over all texts each word counts ONCE."""
    _, first, times = np.unique(w.hash[rows], return_index=True, return_counts=True)
    share = times * ONCE // np.maximum(counts[first], 1)
    rows = rows[first]
    for a in range(0, len(rows), 1 << 16):
        letters = Letters(w, rows[a : a + (1 << 16)])
        n = np.repeat(share[a : a + (1 << 16)], letters.size)
        for pair in letters.slots:
            for slot in pair:
                np.add.at(table, slot, n)


# -- decisions -----------------------------------------------------------------


class Decisions:
    """The binary decisions of some tokens in order: token, outcome, cell (kind and values of the three predictors)."""

    def __init__(self, t: Tokens, code: np.ndarray, known: np.ndarray):
        """code: answers of each token's pair; known: do other training texts have the token?  (Else its class is another token's.)"""
        a3, r3, a2, r2, same = code & 31, (code >> 5) & 1, (code >> 6) & 31, (code >> 11) & 1, (code >> 12) & 1
        a3, a2, same = (v.astype(np.int64) for v in (a3, a2, same))
        one = a3 > 0
        right = one & (r3 == 1) & known
        two = ~right & (a2 > 0) & ~(one & (same == 1))
        right2 = two & (r2 == 1) & known
        self.hit = right | right2
        three = ~self.hit
        i = np.arange(len(code))
        last = np.maximum.accumulate(np.where(self.hit, -1, i)) if len(i) else i  # the last token that wasn't predicted
        run = np.zeros(len(code), np.int64)
        run[1:] = i[:-1] - last[:-1]
        run = np.searchsorted([1, 2, 4, 8, 16], np.minimum(run, t.place), "right")
        new = np.zeros(len(code), np.int64)
        new[1:] = three[:-1] & ~known[:-1]
        new[t.place == 0] = 0
        other = np.where(a2 == 0, 0, np.where(same == 1, 1, 2))
        kinds = [(one, right, a3, other, 2 * a2 + same), (two, right2, a2, one.astype(np.int64), a3), (three, known, new, one.astype(np.int64) + two, np.zeros(len(code), np.int64))]
        rows = [np.flatnonzero(k[0]) for k in kinds]
        self.token = np.concatenate(rows)
        kind = np.repeat(np.arange(KINDS), [len(r) for r in rows])
        pick = lambda j: np.concatenate([k[j][r] for k, r in zip(kinds, rows)])
        order = np.argsort(self.token, kind="stable")
        self.token, self.right = self.token[order], pick(1)[order]
        self.cells = (((kind * OWN + pick(2)) * RUN + run[np.concatenate(rows)] * 3 + pick(3)) * OTHER + pick(4))[order]


CELLS = KINDS * OWN * RUN * OTHER


def parts(cells: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, int]], np.ndarray]:
    """kind, (index, size) of the three predictors' tables, gate of some cells."""
    rest, other = np.divmod(cells, OTHER)
    rest, run = np.divmod(rest, RUN)
    kind, own = np.divmod(rest, OWN)
    return kind, [(kind * OWN + own, KINDS * OWN), (kind * RUN + run, KINDS * RUN), (kind * OTHER + other, KINDS * OTHER)], kind * RUNS + run // 3


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -LOGIT, LOGIT)))


def steps(kind: np.ndarray, dot: np.ndarray) -> np.ndarray:
    """Cells of the refining table."""
    return kind * STEPS + np.clip((dot + LOGIT) * ((STEPS - 1) / (2 * LOGIT)) + 0.5, 0, STEPS - 1).astype(np.int64)


def tally(cells: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells that occur, how often, and how often with outcome 1."""
    n, good = np.bincount(cells, minlength=CELLS), np.bincount(cells, weights=right, minlength=CELLS)
    at = np.flatnonzero(n)
    return at, n[at].astype(np.float64), good[at]


def fitted(at: np.ndarray, n: np.ndarray, good: np.ndarray) -> dict:
    """Logits of the three predictors by value, gated weights, refining table, from the tally of training decisions.

    Weights climb the likelihood by the bound of its curvature, so no step falls; a prior holds them."""
    kind, keys, gate = parts(at)
    logits = []
    for key, m in keys:
        p = (np.bincount(key, weights=good, minlength=m) + 0.5) / (np.bincount(key, weights=n, minlength=m) + 1)
        logits.append(np.clip(np.log(p / (1 - p)), -LOGIT, LOGIT))
    x = np.stack([v[key] for v, (key, _) in zip(logits, keys)] + [np.ones(len(at))])
    first = np.array([0.5, 0.3, 0.2, 0.0])
    weights = np.tile(first, (GATES, 1))
    of_gate = lambda v: np.bincount(gate, weights=v, minlength=GATES)
    bound = np.stack([np.stack([of_gate(n * a * b) for b in x], 1) for a in x], 1) / 4 + 4 * np.eye(4)
    inverse = np.linalg.inv(bound)
    for _ in range(FITTING):
        error = good - n * squash((weights[gate].T * x).sum(axis=0))
        weights += np.einsum("gab,gb->ga", inverse, np.stack([of_gate(error * a) for a in x], 1) - 4 * (weights - first))
    dot = (weights[gate].T * x).sum(axis=0)
    cell = steps(kind, dot)
    start = np.tile(squash(np.linspace(-LOGIT, LOGIT, STEPS)), KINDS)
    refine = (np.bincount(cell, weights=good, minlength=KINDS * STEPS) + 4 * start) / (np.bincount(cell, weights=n, minlength=KINDS * STEPS) + 4)
    return {"logits": logits, "weights": weights, "refine": refine}


def decided(cells: np.ndarray, right: np.ndarray, doc: np.ndarray, place: np.ndarray, sizes: np.ndarray, mix: dict) -> np.ndarray:
    """log10 probability of each decision's outcome; doc, place: of its token; sizes: tokens of the texts.

    Weights and the refining table adapt within each text, SEGMENT tokens at a time."""
    segment = place // SEGMENT
    order = np.argsort(segment.astype(np.int16 if int(segment.max(initial=0)) < 1 << 15 else np.int64), kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(segment))]).tolist()
    y, doc = right[order].astype(np.float64), doc[order]
    kind, keys, gate = parts(cells[order])
    x = [v[key] for v, (key, _) in zip(mix["logits"], keys)] + [np.ones(len(order))]
    fixed = sum(w[gate] * v for w, v in zip(mix["weights"].T, x))
    shift = np.zeros((4, KINDS * len(sizes)))
    long = sizes > SEGMENT  # only these texts need a record
    size = KINDS * STEPS
    record = (np.cumsum(long) - 1) * size
    seen, good = np.zeros((2, int(long.sum()) * size))
    out = np.empty(len(order))
    for r, (a, z) in enumerate(zip(ends, ends[1:])):
        part = slice(a, z)
        who = doc[part] * KINDS + kind[part]
        dot = fixed[part] + sum(m[who] * v[part] for m, v in zip(shift, x)) if r else fixed[part]
        cell = steps(kind[part], dot)
        own = record[doc[part]] + cell
        table = (RECORD * mix["refine"][cell] + good[own]) / (RECORD + seen[own]) if r else mix["refine"][cell]
        p = np.clip((squash(dot) + table) / 2, 1e-6, 1 - 1e-6)
        out[part] = np.where(y[part] > 0, p, 1 - p)
        if r + 2 < len(ends):
            error = RATE * (y[part] - p)
            for k in range(4):
                shift[k] += np.bincount(who, weights=error * x[k][part], minlength=shift.shape[1])
            on = long[doc[part]]
            np.add.at(seen, own[on], 1.0)
            np.add.at(good, own[on], y[part][on])
    back = np.empty(len(order))
    back[order] = np.log10(out)
    return back


def plain_logs(t: Tokens, d: Decisions, left: np.ndarray, of_class: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of what the decisions leave open, for each token but new words, and which words are new.

    left, of_class, tokens: of training texts but the token's own, the occurrences of the token, of its class and of all."""
    out = np.zeros(len(left))
    hit, known = np.flatnonzero(d.hit), np.flatnonzero(~d.hit & (left > 0))
    out[hit] = np.log10(left[hit] / of_class[hit])
    out[known] = np.log10(left[known] / tokens[known])
    new = ~d.hit & (left <= 0)
    out[new & t.is_end] = -np.log10(256)  # an end that training texts don't have
    return out, np.flatnonzero(new[~t.is_end])


# -- passes over the documents -------------------------------------------------

_ROW = "batch long, kind int, shard int, n long, words binary, pairs binary"
_SCHEMA = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary())])
TEXTS, SPELLED, ASKED, ANSWERED, TYPES = range(5)


def _row(batch: int, kind: int, shard: int, n: int, words: bytes | None, pairs: bytes | None) -> pa.RecordBatch:
    return C.record(_SCHEMA, batch=[batch], kind=[kind], shard=[shard], n=[n], words=[words], pairs=[pairs])


def _flags(b) -> np.ndarray:
    return C.column(b, "train").to_numpy(zero_copy_only=False).astype(np.int64)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of texts; n: their training tokens."""
    from pyspark import TaskContext

    task, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

    def closed() -> pa.RecordBatch:
        nonlocal seq, size
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        out = _row((task << 24) + seq, TEXTS, 0, int(_flags(b) @ Tokens(C.column(b, "text")).counts), sealed(b), None)
        held.clear()
        seq, size = seq + 1, 0
        return out

    for big in batches:
        for b in C.slices(big):
            b = pa.RecordBatch.from_arrays([C.column(b, "doc_id"), C.column(b, "train"), C.column(b, "text").cast(pa.large_string())], ["doc_id", "train", "text"])
            held.append(b)
            size += int(C.column(b, "text").nbytes)
            if size >= BATCH:
                yield closed()
    if held:
        yield closed()


def sealed(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as f:
        f.write_batch(b)
    return sink.getvalue().to_pybytes()


def _texts(raw: bytes) -> tuple[pa.RecordBatch, Tokens, np.ndarray]:
    b = pa.ipc.open_stream(raw).read_next_batch()
    return b, Tokens(C.column(b, "text")), _flags(b)


def _ask(shards: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                _, t, train = _texts(r["words"])
                word, of_word, at = t.words(shards)
                often = np.bincount(at, weights=train[t.doc], minlength=len(word)).astype(np.uint32)
                question, of_pair, _ = t.pairs(train, shards, bits)
                cut_w, cut_p = (np.searchsorted(s, np.arange(shards + 1)).tolist() for s in (of_word, of_pair))
                for s in range(shards):
                    w, p = slice(cut_w[s], cut_w[s + 1]), slice(cut_p[s], cut_p[s + 1])
                    if w.start < w.stop or p.start < p.stop:
                        yield _row(r["batch"], ASKED, s, w.stop - w.start, packed(ascending(word[w]), shrink(often[w])), packed(ascending(question[0][p]), *(shrink(x[p]) for x in question[1:])))

    return run


def packed(*parts: bytes) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def unpacked(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def one_of(raw: bytes) -> list[np.ndarray]:
    first, *rest = unpacked(raw)
    return [np.cumsum(grow(first, C.U64), dtype=C.U64), *(grow(x, np.uint32) for x in rest)]


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch's question to a shard: counts of its words and of their classes, and what contexts say of its pairs; then the shard's number of words."""
    for t in C.stream_groups(batches, ["shard"]):
        shard = t["shard"][0].as_py()
        names = t["batch"].to_pylist()
        words, pairs = ([one_of(x.as_buffer().to_pybytes()) for x in t[c]] for c in ("words", "pairs"))
        ends = [np.concatenate([[0], np.cumsum([len(x[0]) for x in q])]).tolist() for q in (words, pairs)]
        values, at = np.unique(np.concatenate([x for x, _ in words]), return_inverse=True)
        counts = np.zeros(len(values), np.int64)
        np.add.at(counts, at, np.concatenate([n for _, n in words]).astype(np.int64))
        yield _row(-1 - shard, TYPES, shard, int((counts > 0).sum()), None, None)
        _, of = np.unique(class_of(values), return_inverse=True)
        class_counts = np.zeros(int(of.max(initial=-1)) + 1, np.int64)
        np.add.at(class_counts, of, counts)
        more = (class_counts[of] - counts)[at]
        counts = counts[at]
        column = lambda k: np.concatenate([x[k] for x in pairs])
        lists = np.repeat(np.arange(len(pairs)), np.diff(ends[1]))
        group = column(2).astype(np.int64)
        group = np.where(group > 0, (lists << 32) | group, 0)
        code = answers(column(0), column(1), group, column(3))
        for i, name in enumerate(names):
            w = slice(ends[0][i], ends[0][i + 1])
            yield _row(name, ANSWERED, shard, 0, packed(shrink(counts[w]), shrink(more[w])), shrink(code[ends[1][i] : ends[1][i + 1]]))


_TEXT = pa.schema([("doc_id", pa.int64()), ("train", pa.uint8()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("new", pa.large_string())])


def without_own(t: Tokens, train: np.ndarray, word: np.ndarray, counts: np.ndarray, more: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of each token, of its class and of all tokens in training texts but its own; more: of its class beyond its own.

    word: a number below 2**32 of each token's word."""
    taught = train[t.doc]
    left = counts - taught * own_times(t.doc, word)
    of_class = counts + more - taught * own_times(t.doc, t.classes())
    return left, of_class, np.maximum(tokens - taught * t.counts[t.doc], 1)


def _decide(shards: int, bits: int, tokens: int):
    """For each batch: its texts' sums, training flags and new words (words), the cells and outcomes of its decisions
    in order (pairs: the different ones by number, then which it is); then the task's spelling counts in fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, table = TaskContext.get().partitionId(), np.zeros(1 << SPELL, np.int64)
        for g in C.stream_groups(batches, ["batch"]):
            if g["kind"][0].as_py() == TYPES:
                yield from g.to_batches()
                continue
            b, t, train = _texts(g["words"][0].as_buffer().to_pybytes())  # texts come first, then answers by shard
            said = g.slice(1)
            at = t.words(shards)[2]
            counts, more = (np.concatenate(x)[at] for x in zip(*([grow(x, np.int64) for x in unpacked(x.as_buffer().to_pybytes())] for x in said["words"])))
            code = np.concatenate([grow(x.as_buffer().to_pybytes(), np.uint16) for x in said["pairs"]])[t.pairs(train, shards, bits)[2]]
            taught = train[t.doc]
            left, of_class, others = without_own(t, train, at, counts, more, tokens)
            d = Decisions(t, code, left > 0)
            plain, new = plain_logs(t, d, left, of_class, others)
            word = np.flatnonzero(taught[~t.is_end])
            spell(table, t.w, word, counts[~t.is_end][word])
            total = lambda x: np.bincount(t.doc, weights=x, minlength=len(t.counts))
            fresh = np.zeros(len(t.w), bool)
            fresh[new] = True
            spelled = kept_words(t.w, ~fresh).cast(pa.large_string())
            texts = C.record(_TEXT, doc_id=C.column(b, "doc_id"), train=train, n_tokens=t.counts, n_known=total(counts > 0).astype(np.int64), logs=total(np.log10(counts + 1.0)), score=total(plain), n_bytes=np.diff(t.w.offsets), new=spelled)
            names, rank, n = np.unique(d.cells * 2 + d.right, return_inverse=True, return_counts=True)
            by = np.argsort(-n, kind="stable")
            place = np.empty(len(by), np.uint32)
            place[by] = np.arange(len(by))
            yield _row(int(g["batch"][0].as_py()), TEXTS, 0, 0, sealed(texts), packed(shrink(names[by].astype(np.uint32)), shrink(place[rank])))
        for i in range(0, len(table), FIELD):
            some = np.flatnonzero(table[i : i + FIELD])
            if len(some):
                yield _row(task, SPELLED, i // FIELD, 0, ascending(some.astype(C.U64)), shrink(table[i : i + FIELD][some]))

    return run


def _decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Texts, tokens, cells and outcomes of the decisions of each batch."""
    for b in batches:
        for words, pairs in zip(C.column(b, "words"), C.column(b, "pairs")):
            names, place = (grow(x, np.uint32).astype(np.int64) for x in unpacked(pairs.as_buffer().to_pybytes()))
            cells, right = names[place] >> 1, names[place] & 1
            last = (cells >= 2 * (CELLS // KINDS)) | (right == 1)  # a token's last decision: one that came true, or the third
            yield pa.ipc.open_stream(words.as_buffer()).read_next_batch(), np.cumsum(last) - last, cells, right


_TALLY = pa.schema([("cell", pa.int32()), ("n", pa.float64()), ("good", pa.float64())])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The decisions of a task's training texts by cell."""
    sums = np.zeros((2, CELLS))
    for texts, token, cells, right in _decisions(batches):
        teach = np.repeat(C.column(texts, "train").to_numpy(), C.column(texts, "n_tokens").to_numpy())[token] > 0
        at, n, good = tally(cells[teach], right[teach])
        sums[:, at] += n, good
    at = np.flatnonzero(sums[0])
    yield C.record(_TALLY, cell=at, n=sums[0, at], good=sums[1, at])


_SCORED = ["doc_id", "n_tokens", "n_known", "logs", "score", "n_bytes"]


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix, table = held.value
        for texts, token, cells, right in _decisions(batches):
            n = C.column(texts, "n_tokens").to_numpy()
            doc, place = np.repeat(np.arange(len(n)), n)[token], C.spread(np.zeros(len(n), np.int64), n)[token]
            w = C.Words(C.column(texts, "new"))
            spelled = Letters(w, np.arange(len(w))).logs(table, C.column(texts, "train").to_numpy()[w.doc()])
            score = C.column(texts, "score").to_numpy() + np.bincount(w.doc(), weights=spelled, minlength=len(n))
            score += np.bincount(doc, weights=decided(cells, right, doc, place, n, mix), minlength=len(n))
            yield texts.set_column(texts.schema.get_field_index("score"), "score", pa.array(score)).select(_SCORED)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the spelling counts of each field, one field at a time."""
    for g in _runs(batches, ("shard", "fan")):
        table = np.zeros(FIELD, np.int64)
        for r in g:
            key = r
            at, n = np.cumsum(grow(r["words"], C.U64), dtype=C.U64).astype(np.int64), grow(r["pairs"], np.int64)
            table[at] += n
        some = np.flatnonzero(table)
        yield _row(key["fan"], SPELLED, key["shard"], 0, ascending(some.astype(C.U64)), shrink(table[some]))


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple) -> Iterator[Iterator[dict]]:
    import itertools

    rows = (r for b in batches for r in b.to_pylist())
    for _, g in itertools.groupby(rows, lambda r: tuple(r[k] for k in keys)):
        yield g


def spelling_table(rows: DataFrame) -> np.ndarray:
    """The spelling counts of all tasks, added up in two levels; the table has one size whatever the input."""
    n = C.buckets_of(rows.sparkSession)
    for fan in (F.pmod("batch", F.lit(32)), F.lit(0)):
        keyed = rows.withColumn("fan", fan.cast("int")).repartition(n, "shard", "fan").sortWithinPartitions("shard", "fan")
        rows = C.map_arrow(keyed, _added, _ROW)
    table = np.zeros(1 << SPELL, np.float32)
    for r in rows.collect():
        table[r["shard"] * FIELD + np.cumsum(grow(r["words"], C.U64), dtype=C.U64).astype(np.int64)] = grow(r["pairs"], np.int64) / ONCE
    return table


def score_texts(docs: DataFrame, train: Column | bool = True) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row of docs (doc_id, text).

    Learns from rows for which `train` holds (null: it doesn't); a null text is empty (one token, its end).
    base_score is the add-one unigram score over training counts.  score is the model's log10
    probability; a training row is scored by what the other rows teach, without anything that it adds itself, so a text that
    stands twice helps its copy and no text helps itself.  Scores don't depend on how rows are dealt out.
    Without training rows every count is 0.  Repeated rows are scored and learned from as often as they stand.
    bits_per_byte is null for an empty text.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    shards = C.buckets_of(spark)
    flag = F.coalesce(F.lit(True) if train is True else train, F.lit(False))
    texts = C.materialise(C.map_arrow(docs.select("doc_id", flag.alias("train"), "text"), _prepare, _ROW), "texts")
    tokens = texts.agg(F.sum("n")).first()[0] or 0
    bits = name_bits(tokens)
    asked = C.map_arrow(texts, _ask(shards, bits), _ROW).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "batch")
    said = C.map_arrow(asked, _answer, _ROW).unionByName(texts).repartition(shards, "batch").sortWithinPartitions("batch", "kind", "shard")
    rows = C.materialise(C.map_arrow(said, _decide(shards, bits, tokens), _ROW), "decisions")
    types = rows.where(f"kind = {TYPES}").agg(F.sum("n")).first()[0] or 0
    table = spelling_table(rows.where(f"kind = {SPELLED}"))
    rows = rows.where(f"kind = {TEXTS}").select("words", "pairs")
    sums = C.map_arrow(rows, _tally, "cell int, n double, good double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("cell").toPandas()
    mix = fitted(*(sums[c].to_numpy(k) for c, k in (("cell", np.int64), ("n", float), ("good", float))))
    return C.map_arrow(rows, _score(spark.sparkContext.broadcast((mix, table))), "doc_id long, n_tokens long, n_known long, logs double, score double, n_bytes long").select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * float(np.log10(tokens + types + 1))).alias("base_score"),
        "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
