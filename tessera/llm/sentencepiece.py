"""SentencePiece models in the tokenizers library.

The model protobuf is parsed and rebuilt: normaliser (its character map, the
dummy prefix, white space as the metaspace marker), unigram scores or the
merges that BPE scores imply, byte fallback, and the decoder.  Each new piece of
text is checked against the sentencepiece library, and texts are decoded again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from tokenizers import decoders, models, normalizers

from tessera.llm import common as C
from tessera.llm import tokens as T

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def parse(raw: bytes):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(raw)
    return proto


def merges(proto) -> list[tuple[str, str]]:
    """Pairs that BPE joins, best result first: each way to split a piece into two pieces."""
    rank = {p.piece: (-p.score, i) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)}
    found = [(rank[p], rank[p[:k]], rank[p[k:]], p[:k], p[k:]) for p in rank for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
    return [(a, b) for *_, a, b in sorted(found)]


def rebuild(proto, prefix: bool = False) -> tokenizers.Tokenizer:
    """A tokenizer with the model's pieces; the dummy prefix is left to the caller unless `prefix` is set."""
    unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
    kind, fallback = proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback
    if kind == UNIGRAM:
        model = models.Unigram([(p.piece, p.score) for p in proto.pieces], unk_id=unknown, byte_fallback=fallback)
    elif kind == BPE:
        model = models.BPE({p.piece: i for i, p in enumerate(proto.pieces)}, merges(proto), unk_token=proto.pieces[unknown].piece, fuse_unk=True, byte_fallback=fallback)
    else:
        raise ValueError("a unigram or BPE model is needed")
    t = tokenizers.Tokenizer(model)
    steps = []
    if proto.normalizer_spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(proto.normalizer_spec.precompiled_charsmap))
    if proto.normalizer_spec.remove_extra_whitespaces:
        steps += [normalizers.Replace(tokenizers.Regex(r"\A +| +\z"), ""), normalizers.Replace(tokenizers.Regex(" {2,}"), " ")]  # spaces alone
    steps.append(normalizers.Replace(" ", MARK))
    if prefix and proto.normalizer_spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    t.normalizer = normalizers.Sequence(steps)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return t


class WholeTexts:
    """ids of whole texts, in batches over the library's threads, each text checked against sentencepiece."""

    def __init__(self, tokenizer: tokenizers.Tokenizer, other):
        self.tokenizer, self.other = tokenizer, other
        self.faults = np.zeros(0, bool)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        said = [x or "" for x in texts.to_pylist()]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(said, add_special_tokens=False)]
        self.faults = np.array([a != b for a, b in zip(ids, self.other.encode(said, num_threads=1))], bool)
        return np.array([x for one in ids for x in one], np.int32), np.fromiter(map(len, ids), np.int64, len(ids))


class Codec:
    """Encoder, checked against sentencepiece, and decoder of a model file."""

    def __init__(self, path: str, threads: int):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        with open(path, "rb") as f:
            proto = parse(f.read())
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        self.newline = len(self._right(["\n"], "")[0])
        t = rebuild(proto)
        crossing = any(MARK in p.piece.lstrip(MARK) or "\n" in p.piece for p in proto.pieces if p.type in (NORMAL, USER))
        plain = not proto.normalizer_spec.precompiled_charsmap and not proto.normalizer_spec.remove_extra_whitespaces
        # cutting before spaces is safe if no piece has the marker after other characters; else texts go whole
        if crossing or not plain or not self.prefix:
            self.encoder = WholeTexts(rebuild(proto, prefix=True), self.other)
        else:
            self.encoder = T.PieceEncoder(t, spaced=True, prefix=True, check=self.same)
        text = [p.piece.replace(MARK, " ").encode() if p.type in (NORMAL, USER) else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" for p in proto.pieces]
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.size = np.fromiter(map(len, text), np.int64, len(text))
        self.at = np.cumsum(self.size) - self.size

    def _right(self, pieces: list[str], skip: str) -> list[list[int]]:
        return self.other.encode([skip + p for p in pieces], num_threads=1)

    def same(self, pieces: list[str], ids: list[list[int]]) -> list[bool]:
        """Does sentencepiece give these ids?  It leads a text with a space, so a piece's own goes first;
        a piece without one is looked at after a line end, which no piece crosses."""
        out = np.zeros(len(pieces), bool)
        led = [i for i, p in enumerate(pieces) if p.startswith(" ")]
        bare = [i for i, p in enumerate(pieces) if not p.startswith(" ")]
        for i, r in zip(led, self._right([pieces[i][1:] for i in led], "")):
            out[i] = r == ids[i] or (pieces[i] == " " and not r)
        for i, r in zip(bare, self._right([pieces[i] for i in bare], "\n")):
            out[i] = r[self.newline :] == ids[i]
        return out.tolist()

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of runs of ids without the dummy prefix, one after another, and their sizes."""
        size = self.size[ids]
        raw = self.bytes[C.spread(self.at[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        full = np.flatnonzero(np.diff(ends))
        keep = np.ones(len(raw), bool)
        keep[ends[full]] = (raw[ends[full]] != 32) | (not self.prefix)
        lengths = np.diff(np.concatenate([[0], np.cumsum(keep)])[ends])
        return raw[keep], lengths


_codecs: dict = {}


def codec(path: str, threads: int) -> Codec:
    C.claim("pieces", _codecs.clear)
    if path not in _codecs:
        _codecs[path] = Codec(path, threads)
    return _codecs[path]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("parity", pa.bool_()), ("round_trip", pa.bool_()), ("ids", pa.list_(pa.int32()))])


def encode(docs: DataFrame, path: str, threads: int = 2, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, parity, round_trip and (null if not wanted) ids of each row of docs.

    parity: sentencepiece gives the same ids for each piece of the text, or, for a model that normalises
    texts or whose pieces cross words, for the whole text; round_trip: decoding
    the ids gives the text's bytes, which a normaliser may change.  A null or empty text has no ids; both flags hold.
    """
    C.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, threads)
        for big in batches:
            for b in C.slices(big):
                ids, counts = c.encoder(C.column(b, "text"))
                parity = ~c.encoder.faults
                data, at = C.text_bytes(C.column(b, "text"))
                back, size = c.decode(ids, counts)
                ends = np.concatenate([[0], np.cumsum(size)])
                same = size == np.diff(at)
                if len(back) == len(data) and same.all():
                    wrong = np.concatenate([[0], np.cumsum(back != data)])
                    same &= wrong[at[1:]] == wrong[at[:-1]]
                else:
                    same &= np.fromiter((back[x:y].tobytes() == data[a:z].tobytes() for x, y, a, z in zip(ends, ends[1:], at, at[1:])), bool, len(size))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids)) if with_ids else pa.nulls(len(counts), pa.list_(pa.int32()))
                yield C.record(_OUT, doc_id=C.column(b, "doc_id"), n_tokens=counts, ids_crc32=T.crc32s(ids, counts), parity=parity, round_trip=same, ids=lists)

    return C.map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean, ids array<int>")


def decode(coded: DataFrame, path: str, threads: int = 2) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (null: no ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, threads)
        for b in batches:
            ids = C.column(b, "ids").fill_null([])
            counts = ids.value_lengths().to_numpy()
            raw, size = c.decode(ids.flatten().to_numpy(), counts)
            text = C.binary_array(raw, size).cast(pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([C.column(b, "doc_id"), text], ["doc_id", "text"])

    return C.map_arrow(coded.select("doc_id", "ids"), run, "doc_id long, text string")
