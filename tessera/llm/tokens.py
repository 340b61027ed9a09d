"""Token ids by the tokenizers library, one library call for each new piece of text.

A text is cut into pieces at which the tokenizer's own pre-tokenisation cuts it
in any case, so ids of the text are the ids of its pieces one after another.
The ids of pieces lie in a bounded table by 64-bit piece hash; a repeated piece
costs one vectorised lookup and no Python object.  New pieces go to the library
JOINED at a time as one text, with a word or line end between them whose id tells where each ends.
A text with white space that the cutting rule doesn't cover goes to the library whole.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers

from tessera.llm import common as C

#: Pieces that a table holds; beyond that it starts anew.
PIECES = 1_200_000
#: New pieces in one call's text.
JOINED = 100
_SPACED, _FOREIGN = (C.U64(x) for x in C.stream_of(41, 2))


class HashTable:
    """64-bit keys to int32 values: open addressing in numpy arrays, looked up in batches."""

    def __init__(self, bits: int):
        self.shift = C.U64(64 - bits)
        self.keys = np.zeros(1 << bits, C.U64)
        self.values = np.zeros(1 << bits, np.int32)
        self.last = (1 << bits) - 1

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slot = (keys >> self.shift).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.last
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct new keys, none 0."""
        slot = (keys >> self.shift).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = keys[free]  # of several for a slot, the last stays
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = values[won]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.last


class PieceEncoder:
    """ids of many texts.  spaced: a piece is a word with the space before it and a line end is a
    piece; otherwise white space has no ids and A-Z count as a-z."""

    def __init__(self, tokenizer: tokenizers.Tokenizer, spaced: bool, prefix: bool = False, check=None):
        """prefix: a text counts as led by a space.  check(pieces, ids) tells of each piece whether
        its ids are right; `faults` tells it of the last call's texts; such pieces are not joined."""
        self.tokenizer, self.spaced, self.prefix, self.check = tokenizer, spaced, prefix, check
        self.faults = np.zeros(0, bool)
        self.line = self._encode(["\n"])[0] if spaced else []
        self.between = None if check else self._between()
        self.stops = {c: np.array(i, np.int32) for c, i in zip(_STOPS, self._encode([chr(c) for c in _STOPS]))}
        self._clear()

    def _between(self) -> tuple[bytes, int] | None:
        """What stands between joined pieces, and its id: a line end, or the longest plain word of one id."""
        if self.spaced:
            return (b"\n", self.line[0]) if len(self.line) == 1 else None
        words = [t.removesuffix("</w>") for t in self.tokenizer.get_vocab(with_added_tokens=False) if t.endswith("</w>")]
        word = max((w for w in words if w.isascii() and w.isalpha() and w.islower()), key=lambda w: (len(w), w), default="")
        ids = self._encode([word])[0]
        return (f" {word} ".encode(), ids[0]) if len(ids) == 1 else None

    def _clear(self) -> None:
        self.table = HashTable(21)
        self.ids = np.zeros(1 << 20, np.int32)
        self.at = np.zeros(PIECES + 2, np.int64)
        self.odd = np.zeros(PIECES + 2, bool)
        self.bad = np.zeros(PIECES + 2, bool)
        self.n = 0
        self._add(np.array([1], C.U64), np.array(self.line, np.int32), np.array([len(self.line)]), np.array([False]), np.array([False]))

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _joined(self, raw: bytes) -> list[int]:
        return self.tokenizer.encode_batch_fast([raw.decode()], add_special_tokens=False)[0].ids

    def _coded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, spaced: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after another, and how many each has; odd ones go to the library one by one."""
        n = len(start)
        mark, cut = self.between or (b"", 0)
        lead = spaced.astype(np.int64)
        size = end - start + lead + len(mark)
        ends = np.cumsum(size)
        at = ends - size
        raw = np.full(int(size.sum()), 32, np.uint8)
        raw[C.spread(at + lead, end - start)] = data[C.spread(start, end - start)]
        for k, c in enumerate(mark):
            raw[ends - len(mark) + k] = c
        flat, sizes, whole = [], np.zeros(n, np.int64), raw.tobytes()
        easy = np.zeros(n, bool) if self.between is None else ~odd
        turn = np.flatnonzero(easy[1:] != easy[:-1]) + 1
        cuts = np.unique(np.concatenate([turn, np.arange(0, n, JOINED), [0, n]])).tolist()
        for a, z in zip(cuts, cuts[1:]):
            if easy[a]:
                ids = np.array(self._joined(whole[at[a] : ends[z - 1]]), np.int32)
                last = np.flatnonzero(ids == cut)
                if len(last) == z - a:
                    keep = np.ones(len(ids), bool)
                    keep[last] = False
                    flat.append(ids[keep])
                    sizes[a:z] = np.diff(last, prepend=-1) - 1
                    continue
            coded = self._encode([whole[at[i] : ends[i] - len(mark)].decode() for i in range(a, z)])  # odd, or one has the mark's id
            flat.append(np.array([x for one in coded for x in one], np.int32))
            sizes[a:z] = [len(one) for one in coded]
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), sizes

    def _add(self, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray, odd: np.ndarray, bad: np.ndarray) -> None:
        start, n = int(self.at[self.n]), len(keys)
        if start + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(flat) + len(self.ids), np.int32)])
        if self.n + n + 2 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(n, np.int64)])
            self.odd = np.concatenate([self.odd, np.zeros(n, bool)])
            self.bad = np.concatenate([self.bad, np.zeros(n, bool)])
        self.ids[start : start + len(flat)] = flat
        self.at[self.n + 1 : self.n + 1 + n] = start + np.cumsum(sizes)
        self.odd[self.n : self.n + n] = odd
        self.bad[self.n : self.n + n] = bad
        self.table.put(keys, np.arange(self.n, self.n + n, dtype=np.int32))
        self.n += n

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, spaced: np.ndarray, keys: np.ndarray, stem: np.ndarray, stems: np.ndarray) -> None:
        """New pieces; one that is a word and a stop or comma has the ids of both."""
        has = stem & (self.table.get(stems) < 0)
        order = np.flatnonzero(has)
        order = order[np.unique(stems[order], return_index=True)[1]]
        order = order[~np.isin(stems[order], keys)]
        plain = np.flatnonzero(~stem)
        rows = np.concatenate([plain, order])
        a, z, lead = start[rows], np.concatenate([end[plain], end[order] - 1]), spaced[rows]
        key = np.concatenate([keys[plain], stems[order]])
        text = lambda at, to, s: [" " * k + data[x:y].tobytes().decode() for x, y, k in zip(at.tolist(), to.tolist(), s.tolist())]
        rare = np.concatenate([[0], np.cumsum(_RARE[data])])
        odd = rare[z] > rare[a]  # may hold white space beyond the words' own
        look = np.flatnonzero(odd)
        odd[look] = [t.split() != [t.lstrip(" ")] for t in text(a[look], z[look], lead[look])]
        flat, sizes = self._coded(data, a, z, lead, odd)
        self._add(key, flat, sizes, odd, self._faulty(lambda: text(a, z, lead), flat, sizes))
        tail = np.flatnonzero(stem)
        if len(tail):
            base = self.table.get(stems[tail])
            last = data[end[tail] - 1]
            more = np.zeros(256, np.int64)
            more[list(self.stops)] = [len(i) for i in self.stops.values()]
            size, extra = self.at[base + 1] - self.at[base], more[last]
            sizes = size + extra
            flat = np.empty(int(sizes.sum()), np.int32)
            ends = np.cumsum(sizes)
            flat[C.spread(ends - sizes, size)] = self.ids[C.spread(self.at[base], size)]
            for c, ids in self.stops.items():
                at = ends[last == c] - len(ids)
                for k, x in enumerate(ids):
                    flat[at + k] = x
            bad = self.bad[base] | self._faulty(lambda: text(start[tail], end[tail], spaced[tail]), flat, sizes)
            self._add(keys[tail], flat, sizes, self.odd[base], bad)

    def _faulty(self, pieces, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not self.check:
            return np.zeros(len(sizes), bool)
        ends = np.cumsum(sizes)
        return self._checked(pieces(), [flat[a:z].tolist() for a, z in zip((ends - sizes).tolist(), ends.tolist())])

    def _checked(self, pieces: list[str], ids: list[list[int]]) -> np.ndarray:
        return ~np.array(self.check(pieces, ids), bool) if self.check else np.zeros(len(ids), bool)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none), one after another, and how many each has."""
        if self.n > PIECES:
            self._clear()
        w = C.Words(texts)
        data, doc = w.data, w.doc()
        foreign = np.concatenate([[0], np.cumsum(data >= 128)])
        foreign = foreign[w.end] > foreign[w.start]
        folded = data if self.spaced else C._LOWER[data]
        hashes = C.Windows(C._BYTE_VALUES[folded])
        head = w.start == w.offsets[:-1][doc]
        before = np.where(head, 0, data[np.maximum(w.start - 1, 0)]) if len(w) else np.zeros(0, np.uint8)
        spaced = ((before == 32) | (head & self.prefix)) & self.spaced
        salt = np.where(spaced, _SPACED, C.U64(0)) ^ np.where(foreign & (not self.spaced), _FOREIGN, C.U64(0))
        if not self.spaced:  # a word with other letters is not folded
            plain = C.Windows(C._BYTE_VALUES[data])
            name = lambda a, z, s, f: C.mix(np.where(f, plain(a, z), hashes(a, z)) ^ s) | C.U64(2)
        else:
            name = lambda a, z, s, f: C.mix(hashes(a, z) ^ s) | C.U64(2)
        keys = name(w.start, w.end, salt, foreign)
        index = self.table.get(keys)
        new = np.flatnonzero(index < 0)
        if len(new):
            first = new[np.unique(keys[new], return_index=True)[1]]
            a, z = w.start[first], w.end[first]
            last, prior = data[z - 1], data[np.maximum(z - 2, 0)] | 32
            stem = _IS_STOP[last] & (z - a > 1) & (prior >= 97) & (prior <= 122)
            if not self.spaced:
                stem &= ~foreign[first]
            stems = name(a, np.where(stem, z - 1, z), salt[first], foreign[first])
            self._learn(folded if not self.spaced and not foreign[first].any() else data, a, z, spaced[first], keys[first], stem, stems)
            index[new] = self.table.get(keys[new])
        # texts that the cutting rule doesn't cover
        gap = np.diff(w.offsets) - np.bincount(doc, weights=w.end - w.start, minlength=len(w.counts)).astype(np.int64)
        whole = gap != np.maximum(w.counts - 1, 0)
        tail = np.ones(len(w), bool)
        tail[:-1] = doc[1:] != doc[:-1]
        wrong = (~head & (before != 32) & (before != 10)) | self.odd[index]
        wrong[1:] |= ~head[1:] & (doc[1:] == doc[:-1]) & (w.start[1:] != w.end[:-1] + 1)
        whole |= np.bincount(doc[wrong], minlength=len(w.counts)) > 0
        whole |= np.bincount(doc[head], minlength=len(w.counts)) < (w.counts > 0)
        whole |= (w.counts == 0) & (np.diff(w.offsets) > 0)
        self.faults = np.bincount(doc[self.bad[index]], minlength=len(w.counts)) > 0
        sizes = w.counts
        if self.spaced:  # a line end stands before its word
            led = ~head & (before == 10)
            both = np.zeros(len(index) + int(led.sum()), np.int64)
            at = np.arange(len(index)) + np.cumsum(led)
            both[at] = index
            index = both
            sizes = w.counts + np.bincount(doc[led], minlength=len(w.counts))
        start, length = self.at[index], self.at[index + 1] - self.at[index]
        ids = self.ids[C.spread(start, length)]
        sums, ends = np.concatenate([[0], np.cumsum(length)]), np.concatenate([[0], np.cumsum(sizes)])
        counts = sums[ends[1:]] - sums[ends[:-1]]
        rows = np.flatnonzero(whole)
        if len(rows):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            text = [" " * self.prefix + data[w.offsets[i] : w.offsets[i + 1]].tobytes().decode() for i in rows]
            coded = self._encode(text)
            for i, one in zip(rows.tolist(), coded):
                parts[i] = np.array(one, np.int32)
                counts[i] = len(one)
            self.faults[rows] = self._checked(text, coded)
            ids = np.concatenate(parts)
        return ids, counts


_STOPS = b".,;:"
_IS_STOP = np.zeros(256, bool)
_IS_STOP[list(_STOPS)] = True
_RARE = np.zeros(256, bool)  # first bytes of white space that str.split() knows beside the words' own
_RARE[[28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True


class WholeEncoder:
    """ids of texts of a tokenizer whose cutting rule isn't known: the library gets them whole."""

    def __init__(self, tokenizer: tokenizers.Tokenizer):
        self.tokenizer = tokenizer

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.array([x for one in ids for x in one], np.int32), counts


class WithAdded:
    """ids of texts as the library gives them by default: a text that holds the string of an added token goes to it whole."""

    def __init__(self, inner, plain: tokenizers.Tokenizer, added: list[str]):
        self.inner, self.plain, self.added = inner, plain, added

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        holds = np.zeros(len(texts), bool)
        for x in self.added:
            holds |= pc.fill_null(pc.match_substring(texts, x), False).to_numpy(zero_copy_only=False)
        if not holds.any():
            return self.inner(texts)
        ids, counts = self.inner(pc.if_else(pa.array(holds), pa.scalar(None, texts.type), texts))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(holds).tolist():
            parts[i] = np.array(self.plain.encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32)
            counts[i] = len(parts[i])
        return np.concatenate(parts), counts


_encoders: dict = {}


def encoder(path: str):
    """The encoder of a tokenizer file, kept by this worker."""
    C.claim("tokens", _encoders.clear)
    if path not in _encoders:
        t, plain = (tokenizers.Tokenizer.from_file(path) for _ in range(2))
        t.encode_special_tokens = True  # pieces hold no string of an added token
        for x in (t, plain):
            x.no_padding()
            x.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        spaced = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        norms = (spec.get("normalizer") or {}).get("normalizers", [])
        bare = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and any(n["type"] == "Lowercase" for n in norms)
        if spaced or bare:
            if hasattr(t.model, "_resize_cache"):
                t.model._resize_cache(0)  # pieces are kept here
            _encoders[path] = PieceEncoder(t, bool(spaced))
        else:
            _encoders[path] = WholeEncoder(t)
        added = [x["content"] for x in spec.get("added_tokens") or []]
        if added:
            _encoders[path] = WithAdded(_encoders[path], plain, added)
    return _encoders[path]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_column(path: str, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """ids of a column's texts with the end id after each (null: only that), one after another, and counts."""
    ids, counts = encoder(path)(texts)
    at = np.cumsum(counts + 1) - 1
    out = np.full(len(ids) + len(counts), end, np.int32)
    keep = np.ones(len(out), bool)
    keep[at] = False
    out[keep] = ids
    return out, counts + 1


def crc32s(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each run of ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    at = (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
    return np.fromiter((zlib.crc32(raw[a:z]) for a, z in zip(at, at[1:])), np.int64, len(counts))
