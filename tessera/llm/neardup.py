"""Near duplicates by min-max hashing.

Each hash function gives two signature values of a shingle set, its minimum and
its maximum, so a signature of 2k values costs k evaluations of each shingle.
Bands of four values (the extremes under two functions) propose pairs; a
proposed pair is a link only if the full sets agree.

Stages: equal sets are one class (a keyed aggregate); band keys of the classes
form families (connected components of shared keys); a family is dealt out in
blocks of about BLOCK classes.  First each block meets the family's first block
in a tile that compares its sets exactly; then only classes that this left out
of the family's largest component, its strays, meet all blocks: two classes of one component need no
comparison.  The links, at most one for each class and tile, form the components.
No pairs of a group are emitted and no task holds a family; a large family of
near copies costs work in proportion to its size, times one more for each block of strays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

#: Classes in a block; a tile compares two blocks.
BLOCK = 96
#: A class of more members than HOT, and than one row in CLASSES, is broadcast: at most CLASSES rows of 32 bytes.
HOT, CLASSES = 10_000, 500_000
#: Bands that are connected together.
STEP = 8
#: Shingle columns that one product of a tile handles.
COLUMNS = 8192


def shingle_sets(words: C.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their counts.

    A text of fewer than k words has its whole sequence as its only shingle."""
    at, doc = words.runs(k)
    w = C.Windows(words.hash)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    h = np.concatenate([w(at, at + k), w(words.at[short], words.at[short + 1])])
    doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(words.counts))


def signatures(h: np.ndarray, counts: np.ndarray, functions: int) -> np.ndarray:
    """Minimum and maximum of each set (none empty) under each function: sets x 2 functions."""
    at = np.cumsum(counts) - counts
    out = np.empty((len(counts), 2 * functions), np.uint32)
    for i, (a, b) in enumerate(C.stream_of(71, 2 * functions).reshape(-1, 2)):
        x = ((h ^ b) * (a | C.U64(1))) >> C.U64(32)
        x = x.astype(np.uint32)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        out[:, 2 * i] = np.minimum.reduceat(x, at)
        out[:, 2 * i + 1] = np.maximum.reduceat(x, at)
    return out


def band_keys(sig: np.ndarray, rows: int = 4) -> np.ndarray:
    """One 64-bit key for each band of `rows` signature values; bands differ in their keys."""
    n, m = sig.shape
    x = np.zeros((n, m // rows), C.U64)
    for r in range(rows):
        x = C.mix((x ^ sig[:, r::rows].astype(C.U64)) + C.stream_of(83 + r, m // rows)[None, :])
    return x


_CLASS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _classes(k: int, functions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in C.slices(big):
                h, n = shingle_sets(C.Words(C.column(b, "text"), lower=True), k)
                full = np.flatnonzero(n)
                s = np.zeros((2, len(n)), C.U64)
                bands = np.zeros((0, functions // 2), C.U64)
                if len(full):
                    at = (np.cumsum(n) - n)[full]
                    s[0, full] = np.add.reduceat(C.mix(h ^ C.U64(0x5BD1E995)), at)
                    s[1, full] = np.bitwise_xor.reduceat(C.mix(h + C.U64(0x1B873593)), at)
                    bands = band_keys(signatures(h, n[full], functions))
                length = np.where(n > 0, functions // 2, 0)
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(C.as_long(bands.reshape(-1))))
                yield C.record(_CLASS, doc_id=C.column(b, "doc_id"), n_shingles=n, s1=C.as_long(s[0]), s2=C.as_long(s[1]), bands=lists)

    return run


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def linked(h: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first set of its local component for each of some sets (sorted, one after another).

    Intersections of all pairs are exact counts: products of the incidence
    matrix of the shingles that two sets or more hold."""
    m = len(n)
    values, at, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    doc = np.repeat(np.arange(m), n)
    use = times[at] > 1
    doc, col = doc[use], shared[at[use]]
    inter = np.zeros((m, m), np.float32 if len(values) < 1 << 24 else np.float64)
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        a, z = np.searchsorted(col, [lo, lo + COLUMNS])
        x = np.zeros((m, min(COLUMNS, int(col[-1]) + 1 - lo)), np.float32)
        x[doc[a:z], col[a:z] - lo] = 1
        inter += x @ x.T
    inter = np.rint(inter).astype(np.int64)
    link = den * inter >= num * (n[:, None] + n[None, :] - inter)
    root = np.arange(m)
    while True:  # smallest label among the neighbours, then jump
        new = np.where(link, root[None, :], m).min(axis=1)
        new = np.minimum(new, root)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tiles(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.stream_groups(batches, ["family", "i", "j"]):
            ids = t["doc_id"].to_numpy()
            h, n = shingle_sets(C.Words(t["text"], lower=True), k)
            root = linked(h, n, num, den)
            out = np.flatnonzero(root != np.arange(len(root)))
            yield C.record(_LINK, a=ids[out], b=ids[root[out]])

    return run


def families(bands: DataFrame, n: int) -> DataFrame:
    """rep, family of the classes that share a band key with another, from rows (rep, nth, band) of n bands.

    STEP bands at a time: what they connect counts as one class for the next bands, so a large
    group is a few rows after the first step.  A class gives one link, to the smallest head of its
    bands; its other heads are linked to that head, each such pair once."""
    labels = None
    for lo in range(0, n, STEP):
        now = bands.where((F.col("nth") >= lo) & (F.col("nth") < lo + STEP)).select("rep", "band")
        if labels is not None:
            now = now.join(labels.hint("merge"), "rep", "left").select(F.coalesce("family", "rep").alias("rep"), "band").distinct()
        heads = now.groupBy("band").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b < top").select("band", "b")
        stars = now.join(heads.hint("merge"), "band").where("rep <> b").groupBy("rep").agg(F.min("b").alias("b"), F.collect_set("b").alias("heads"))
        stars = C.materialise(stars, "stars")
        between = stars.select(F.explode("heads").alias("a"), "b").where("a <> b").distinct()
        new = C.components(stars.select(F.col("rep").alias("a"), "b").unionByName(between), "families")
        if labels is None:
            labels = new.select(F.col("node").alias("rep"), F.col("comp").alias("family"))
            continue
        moved = labels.join(new, labels.family == new.node, "left").select("rep", F.coalesce("comp", "family").alias("family"))
        fresh = new.join(labels, new.node == labels.rep, "left_anti").select(F.col("node").alias("rep"), F.col("comp").alias("family"))
        labels = C.materialise(moved.unionByName(fresh), "families")
    return labels


def block_of(n: str) -> Column:
    """The block of each class, of so many blocks."""
    return F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")


def links_of(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links within each tile (i, j) of a family; texts: doc_id, text, family and the tiles that a class is in."""
    texts = texts.select("doc_id", "text", "family", F.explode("tiles").alias("tile"))
    texts = texts.select("doc_id", "text", "family", "tile.i", "tile.j").repartition(C.buckets_of(texts.sparkSession), "family", "i", "j")
    return C.map_arrow(texts.sortWithinPartitions("family", "i", "j", "doc_id"), _tiles(k, percent, 100), "a long, b long")


def strays(family: DataFrame, comp: DataFrame) -> DataFrame:
    """rep, family, tiles of the classes of families of several components: strays meet one another and all others."""
    label = family.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "family", F.coalesce("comp", "rep").alias("label"))
    label = C.materialise(label, "labels")
    size = label.groupBy("family", "label").agg(F.count("*").alias("n"))
    size = size.groupBy("family").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("all")).where("main.n < all")
    size = size.select("family", F.col("main.label").alias("main"), F.ceil(F.col("main.n") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).cast("int").alias("strays"))
    of = label.join(size, "family").withColumn("stray", F.col("label") != F.col("main"))
    of = of.withColumn("own", F.when(F.col("stray"), block_of("strays")).otherwise(block_of("mains")))
    tile = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    # tile (i, j): stray block i, and main block j or stray block j - mains
    every = F.sequence(F.lit(0), F.col("strays") - 1)
    own, mains = F.col("own"), F.col("mains")
    met = F.transform(every, lambda t: tile(F.least(own, t), mains + F.greatest(own, t)))
    of_stray = F.concat(F.transform(F.sequence(F.lit(0), mains - 1), lambda j: tile(own, j)), met)
    return of.select("rep", "family", F.when(F.col("stray"), of_stray).otherwise(F.transform(every, lambda t: tile(t, own))).alias("tiles"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, functions: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text).

    Words are lower-cased in A-Z only.  Two documents are linked if 100 times
    the size of the intersection of their sets of k-word shingles is at least
    `percent` times the size of the union.  component_id is the smallest doc_id that
    links reach.  A null or blank text has no shingles and no links.  A doc_id is
    meant to name one text; rows that share one and have several texts are linked by their texts
    alone, each row with the component of its text.  A null doc_id is never linked and has
    component_id null; such rows are kept.  An empty table gives no rows.
    """
    C.small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = C.materialise(C.map_arrow(docs, _classes(k, functions), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "sets")
    key = ["n_shingles", "s1", "s2"]
    real = rows.where("n_shingles > 0")
    rep = C.materialise(real.where("doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")), "classes")
    own = real.join(rep.select(*key, "rep", F.col("rep").alias("doc_id")).hint("merge"), [*key, "doc_id"])  # no task gets all copies of a text
    own = own.select("rep", F.posexplode("bands").alias("nth", "band")).distinct()
    family = families(C.materialise(own, "bands"), functions // 2)
    size = family.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    dealt = family.join(size, "family").withColumn("own", block_of("n"))
    tile = lambda j: F.struct(F.lit(0).alias("i"), j.alias("j"))
    first = F.when(F.col("own") == 0, F.transform(F.sequence(F.least(F.lit(1), F.col("n") - 1), F.col("n") - 1), tile)).otherwise(F.array(tile(F.col("own"))))
    # texts of families are few, so they are written once: the strays' tiles don't shuffle all documents anew
    texts = C.materialise(docs.join(dealt.hint("merge"), docs.doc_id == dealt.rep).select("doc_id", "text", "family", "n", "own"), "texts")
    links = C.materialise(links_of(texts.withColumn("tiles", first), k, percent), "links")
    comp = C.components(links, "links")
    large = family.join(size.where("n > 2"), "family", "left_semi")  # one tile has compared all of a smaller one
    if not large.isEmpty():
        tiles = strays(large, comp).select("rep", "tiles")
        more = links_of(texts.where("n > 2").join(tiles.hint("merge"), F.col("doc_id") == F.col("rep")), k, percent)
        comp = C.components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more), "links")
    of_class = rep.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(*key, "members", F.coalesce("comp", "rep").alias("comp"))
    # classes of very many copies are few, so they go to the rows; the rows of all others meet theirs in a shuffle
    limit = max(HOT, rows.count() // CLASSES)
    hot = of_class.where(F.col("members") > limit).select(*key, F.col("comp").alias("hot"))
    told = real.select("doc_id", *key).join(F.broadcast(hot), key, "left")
    cold = told.where("hot is null").join(of_class.where(F.col("members") <= limit).select(*key, "comp").hint("merge"), key, "left")
    out = told.where("hot is not null").withColumnRenamed("hot", "comp").unionByName(cold.drop("hot")).select("doc_id", "n_shingles", "comp")
    out = out.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("comp")))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: near_duplicates(k=3, percent=85) over documents whose doc_ids differ; for small tables, since all pairs that share a shingle are counted.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 1, 2))) AS u(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT x, y FROM ways UNION SELECT r.x, b.y FROM reach r JOIN ways b ON b.x = r.y
), least_of AS (
  SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""
