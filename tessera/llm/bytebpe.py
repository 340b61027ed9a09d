"""Byte-level BPE by backtracking over longest matches, and its decoding.

A piece of text (one match of the splitting pattern) is matched against all tokens at once by an
automaton over its bytes, written as Latin-1 characters.  From the longest token at each place the
encoder goes on while a token may follow the one before it, takes a shorter token where it may not,
and goes back a token where none is left; a place that was left is closed, so no place is tried
twice.  Two tokens may be neighbours if the merges of their joined bytes give just the two; that is
found once for each pair and kept.  A sequence of tokens is what the merges give if all its
neighbours may be so, hence the result is exact.
"""

from __future__ import annotations

import base64
import hashlib
from types import SimpleNamespace

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm import common as C
from tessera.llm.tokens import PieceEncoder

#: Pairs of tokens, and pieces of whole texts, that are kept; beyond that they are found anew.
PAIRS = 2_000_000
PIECES = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens of a rank file: lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class BacktrackingBpe:
    """ids of pieces and of texts, as the merges of a rank file give them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a rank file needs all single bytes")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {rank: raw for raw, rank in ranks.items()}
        self.size = {rank: len(raw) for raw, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for raw, rank in ranks.items():
            if self.merge(raw) == [rank]:  # one that merges never make can only be a whole piece
                self.automaton.add_word(raw.decode("latin-1"), (len(raw), rank))
        self.automaton.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int] = {}
        self._kept: dict[str, list[int]] = {}

    def merge(self, raw: bytes) -> list[int]:
        """The merges step by step, least rank first and of equal ones the leftmost: for single tokens and pairs of them."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, first: int, second: int) -> bool:
        """May the two tokens be neighbours?"""
        known = self._fits.get((first, second))
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[first, second] = self.merge(self.token[first] + self.token[second]) == [first, second]
        return known

    def shorter(self, token: int) -> int:
        """The next shorter token that begins this one; -1 for none."""
        known = self._shorter.get(token)
        if known is None:
            raw, known = self.token[token], -1
            for n in range(len(raw) - 1, 0, -1):
                found = raw[:n].decode("latin-1")
                if found in self.automaton:
                    known = self.ranks[raw[:n]]
                    break
            self._shorter[token] = known
        return known

    def piece(self, raw: bytes) -> list[int]:
        """ids of one match of the pattern."""
        whole = self.ranks.get(raw)
        if whole is not None or not raw:
            return [whole] if raw else []
        n = len(raw)
        longest = [-1] * n
        for last, (size, token) in self.automaton.iter(raw.decode("latin-1")):
            if longest[last - size + 1] < 0 or self.size[longest[last - size + 1]] < size:
                longest[last - size + 1] = token
        open_, out, at, token = bytearray(b"\1") * (n + 1), [], 0, longest[0]
        while at < n:
            if token < 0:  # nothing goes on from here
                open_[at] = 0
                last = out.pop()
                at -= self.size[last]
                token = self.shorter(last)
                continue
            end = at + self.size[token]
            if open_[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                token = self.shorter(token)
        return out

    def text(self, text: str) -> list[int]:
        out: list[int] = []
        for m in self.pattern.findall(text):
            ids = self._kept.get(m)
            if ids is None:
                ids = self.piece(m.encode())
                if len(m) < 100:
                    if len(self._kept) >= PIECES:
                        self._kept.clear()
                    self._kept[m] = ids
            out += ids
        return out

    def encode_batch_fast(self, texts: list[str], add_special_tokens: bool = False) -> list[SimpleNamespace]:
        """What PieceEncoder asks of a tokenizer."""
        return [SimpleNamespace(ids=self.text(t)) for t in texts]


class _Own(PieceEncoder):
    """Pieces go to the encoder one by one: it has no call that joining would save."""

    def _between(self):
        return None


class Decoder:
    """Bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values()) + 1
        self.length = np.zeros(top, np.int64)
        self.length[list(ranks.values())] = [len(raw) for raw in ranks]
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(raw for raw, _ in sorted(ranks.items(), key=lambda e: e[1])), np.uint8)

    def __call__(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of runs of ids, one after another, and how many each run has."""
        n = self.length[ids]
        data = self.data[C.spread(self.start[ids], n)]
        sums = np.concatenate([[0], np.cumsum(n)])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return data, sums[ends[1:]] - sums[ends[:-1]]


_tools: dict[tuple, tuple] = {}


def tools(path: str, pattern: str) -> tuple:
    """Encoder and decoder of a rank file, kept by this worker."""
    C.claim("bytebpe", _tools.clear)
    if (path, pattern) not in _tools:
        ranks = read_ranks(path)
        _tools[path, pattern] = _Own(BacktrackingBpe(ranks, pattern), spaced=True), Decoder(ranks)
    return _tools[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip and ids (array of int) of each row's whole text.

    A null text counts as empty and has no ids.  pattern is the splitting pattern of the GPT-2 kind: a piece takes one
    leading space, and white space before it is a piece of its own.  Rows are taken one by one, so shared or null doc_ids
    and repeated rows stay as they are; the result has no other columns of docs.  A text may have any length that a row
    can hold.  decoded_sha256 is of the bytes that the ids stand for; round_trip says whether they are the text's."""
    ids_kind = pa.list_(pa.int32()) if with_ids else pa.int32()

    def run(batches):
        coder, decoder = tools(path, pattern)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_()), ("ids", ids_kind)])
        for b in batches:
            for part in C.slices(b):
                texts = C.column(part, "text")
                ids, counts = coder(texts)
                data, sizes = decoder(ids, counts)
                raw, at = C.text_bytes(texts)
                coded = digests(np.ascontiguousarray(ids, "<u4"), counts)
                same = sizes == np.diff(at)
                if same.all() and not np.array_equal(data, raw):
                    ends = np.cumsum(sizes)
                    same = np.array([np.array_equal(data[z - n : z], raw[x:y]) for z, n, x, y in zip(ends, sizes, at, at[1:])])
                off = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32())) if with_ids else pa.nulls(len(counts), pa.int32())
                yield C.record(schema, doc_id=C.column(part, "doc_id"), n_tokens=counts, ids_sha256=coded, decoded_sha256=digests(data, sizes), round_trip=same, ids=lists)

    kind = "array<int>" if with_ids else "int"
    return C.map_arrow(docs.select("doc_id", "text"), run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, ids {kind}")


def digests(values: np.ndarray, counts: np.ndarray) -> list[str]:
    """Lowercase hex of the sha256 of each run of values."""
    raw = memoryview(np.ascontiguousarray(values)).cast("B")
    at = (values.itemsize * np.concatenate([[0], np.cumsum(counts)])).tolist()
    return [hashlib.sha256(raw[a:z]).hexdigest() for a, z in zip(at, at[1:])]
