"""What the operators share: the shared work folder, group streaming, vectorised words.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D.  They are found and
hashed with numpy over the UTF-8 buffer of an Arrow column, so that no Python
object is made for a word.  A hash is a polynomial in 2**64 with a mixing
finish; sets and windows are compared through these 64-bit hashes.
"""

from __future__ import annotations

import ctypes
import secrets
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text bytes that one vectorised pass handles (a longer document makes its own pass).
SLICE_BYTES = 1 << 20
_GOLD = U64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on one machine a temporary one is set where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.tessera.work.dir", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.conf.set("spark.tessera.work.dir", base)
    return base.rstrip("/")


def secret(spark: SparkSession) -> str:
    """The key in spark.tessera.key; where it is unset, a random one for this session."""
    key = spark.conf.get("spark.tessera.key", None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("spark.tessera.key", key)
    return key


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder, which clean() deletes."""
    path = f"{shared_folder(spark)}/tessera/{uuid.uuid4().hex}-{tag}"
    _made.append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Deletes what the operators wrote in this session; results that are read later need it no more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = hadoop(_made.pop())
        path.getFileSystem(conf).delete(path, True)


_made: list[str] = []


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and return the written table: it survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def buckets_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(fn, schema); a worker gives unused memory back when a partition ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_clears: dict[str, Callable] = {}


def claim(owner: str, clear: Callable) -> None:
    """A worker keeps the tables of one operator at a time: all other owners' are cleared."""
    if owner not in _clears or len(_clears) > 1:
        for other, f in list(_clears.items()):
            if other != owner:
                f()
                del _clears[other]
        _clears[owner] = clear


def stream_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of adjacent rows that agree in keys; the input is sorted by them."""
    held: list[pa.Table] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            c = np.asarray(t[k].to_numpy())
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            part = t.slice(a, z - a)
            key = tuple(part[k][0].as_py() for k in keys)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
            last = key
    if held:
        yield pa.concat_tables(held)


# -- hashing -----------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The finish of splitmix64, a bijection of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream_of(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix(U64(seed) * _GOLD + np.arange(1, n + 1, dtype=U64) * _GOLD)


_BASE = int(stream_of(11, 1)[0]) | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) in 2**64; kept and grown."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, SLICE_BYTES + 1), base, U64)
        out[0] = 1
        have = _powers[base] = np.cumprod(out, dtype=U64)
    return have[:n]


class Windows:
    """Hashes of any runs of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * powers(_BASE, n), out=self.sums[1:])
        self.inverse = powers(_INV, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h + (end - start).astype(U64) * _GOLD)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUES = stream_of(29, 256)


class Words:
    """The words of some texts: byte range, hash, and first word of each text."""

    def __init__(self, texts: pa.Array, lower: bool = False, gaps: np.ndarray | None = None):
        """lower: A-Z count as a-z; gaps: for each byte value, does it end a word (default: white space)?"""
        data, offsets = text_bytes(texts)
        if lower:
            data = _LOWER[data]
        self.data, self.offsets = data, offsets
        space = np.ones(len(data) + 2, bool)
        space[1:-1] = (_IS_SPACE if gaps is None else gaps)[data]
        word = ~space[1:-1]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        self.start = np.flatnonzero(word & (space[:-2] | first[:-1]))
        self.end = np.flatnonzero(word & (space[2:] | first[1:])) + 1
        self.at = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.at)
        self.hash = Windows(_BYTE_VALUES[data])(self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each run of k words of one text, and that text."""
        n = np.maximum(self.counts - k + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        return spread(self.at[:-1], n), doc


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the lengths, one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - before, lengths)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of some texts and the byte offsets of each; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(b: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each."""
    n = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(n.astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    for a, z in zip(cuts, cuts[1:]):
        if z > a:
            yield b.slice(a, z - a)


def column(b: pa.RecordBatch | pa.Table, name: str):
    return b.column(b.schema.get_field_index(name))


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    def typed(x, kind: pa.DataType) -> pa.Array:
        if not isinstance(x, pa.Array):
            return pa.array(x, kind)
        return x if x.type == kind else x.cast(kind)

    return pa.RecordBatch.from_arrays([typed(columns[f.name], f.type) for f in schema], schema=schema)


def binary_array(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values that lie one after another in values, of so many items each."""
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths * values.itemsize, out=at[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


#: Rows of a link table that one file may hold.
FEW = 50_000


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, comp) of the nodes of the edges (a, b): comp is the smallest node that can be reached.

    Each round every node that has a smaller neighbour hooks to the smallest one, hooks are followed
    to their roots, and links contract to links between roots; a link whose ends meet goes.  At most
    half of a component's nodes are left after a round, a star takes one round.  All steps are
    keyed aggregates and joins on tables in the shared folder; only counts come to the driver.
    """
    lower = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    most = buckets_of(edges.sparkSession)
    few = lambda df, n: df.coalesce(min(most, n // FEW + 1))  # noqa: E731  small tables in few files
    links = materialise(edges.where("a <> b").select(*lower("a", "b")).distinct(), f"{tag}-links")
    hooks, n = [], links.count()
    while n:
        hook = materialise(few(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")), n), f"{tag}-hooks")
        while True:  # to the roots
            up = hook.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
            if hook.join(up, "comp", "left_semi").isEmpty():
                break
            hook = materialise(few(hook.join(up, "comp", "left").select("node", F.coalesce("far", "comp").alias("comp")), n), f"{tag}-hooks")
        hooks.append((hook, n))
        x, y = hook.toDF("a", "x"), hook.toDF("b", "y")
        first = links.join(x, "a").where("b <> x").select("x", "b")  # the link that a node hooked by is settled
        links = materialise(few(first.join(y, "b", "left").select("x", F.coalesce("y", "b").alias("y")).where("x <> y").select(*lower("x", "y")).distinct(), n), f"{tag}-links")
        n = links.count()
    if not hooks:
        return links.toDF("node", "comp")  # empty
    out = None
    for hook, n in reversed(hooks):  # roots of a round are nodes of the next
        if out is None:
            out = hook
            continue
        far = hook.join(out.toDF("comp", "far"), "comp", "left").select("node", F.coalesce("far", "comp").alias("comp"))
        out = materialise(few(far.unionByName(out), n), f"{tag}-labels")
    return materialise(few(out.unionByName(out.select(F.col("comp").alias("node"), "comp")).distinct(), hooks[0][1]), f"{tag}-labels")
