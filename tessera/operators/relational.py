"""Row selection, splits, samples and renames with defined order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column | str, seed: int) -> Column:
    """60 bits of the md5 of key and seed, which any engine can repeat."""
    text = F.concat((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(f"|{seed}"))
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(15)), 16, 10).cast("long")


def sample(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows (all, if there are fewer) without replacement, the same ones for the same seed."""
    return rows.orderBy(hash_order(key, seed), key).limit(k)


def row_range(rows: DataFrame, index: str, start: int, end: int | None = None) -> DataFrame:
    """Rows with start <= index < end: a filter that reaches the scan."""
    out = rows.where(F.col(index) >= start)
    return out if end is None else out.where(F.col(index) < end)


def pick(rows: DataFrame, index: str, wanted: list[int]) -> DataFrame:
    """The listed rows with their place in the list; an error if one is out of bounds."""
    if wanted and min(wanted) < 0:
        raise IndexError("rows are counted from 0")
    spark = rows.sparkSession
    found = rows.where(F.col(index).isin(wanted)) if wanted else rows.limit(0)
    most = rows.agg(F.max(index)).first()[0]
    if wanted and (most is None or max(wanted) > most):
        raise IndexError(f"row {max(wanted)} is beyond the last row {most}")
    places = spark.createDataFrame([(w, i) for i, w in enumerate(wanted)], "wanted long, pos int")
    return found.join(F.broadcast(places), found[index] == places["wanted"]).drop("wanted")


def split_exact(rows: DataFrame, key: str, test: int, seed: int = 42) -> DataFrame:
    """rows with split: exactly `test` rows (all, if there are fewer) are test rows, by hash order.

    The boundary is the test-th smallest hash, found by a bounded top-k; no row number over all rows."""
    h = hash_order(key, seed)
    edge = rows.select(h.alias("h"), F.col(key).alias("k")).orderBy("h", "k").limit(test).agg(F.max(F.struct("h", "k")).alias("e")).first()["e"]
    is_test = F.lit(False) if edge is None else (h < edge["h"]) | ((h == edge["h"]) & (F.col(key) <= F.lit(edge["k"])))
    return rows.withColumn("split", F.when(is_test, "test").otherwise("train"))


def relabel(rows: DataFrame, column: str, labels: dict[str, str | None]) -> DataFrame:
    """Values renamed by a map; values without a name are dropped."""
    known = {k: v for k, v in labels.items() if v is not None}
    out = F.lit(None).cast("string")
    for k, v in known.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return rows.where(F.col(column).isin(list(known))).withColumn(column, out)


def batches(rows: DataFrame, key: str, size: int, epoch: int = 0, seed: int = 42) -> DataFrame:
    """batch_id of one epoch's shuffled batches of exactly `size` rows (the last may be smaller); epochs go on without end.

    Rows go by hash order.  Equal ranges of the hash are counted, their offsets are known by the driver, and
    places run within each range: no row number over all rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("_h", F.coalesce(hash_order(key, seed + epoch), F.lit(0).cast("long"))).withColumn("_part", F.floor(F.col("_h") / ((1 << 60) // parts + 1)).cast("int"))
    before, at = {}, 0
    for r in sorted(ranged.groupBy("_part").count().collect(), key=lambda r: r["_part"]):
        before[r["_part"]], at = at, at + r["count"]
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for p in before.items() for x in p]), F.col("_part").cast("long")) if before else F.lit(0).cast("long")
    place = offset + F.row_number().over(Window.partitionBy("_part").orderBy("_h", key)) - 1
    return ranged.withColumn("batch_id", F.floor(place / size).cast("int")).drop("_h", "_part")


def reassemble(ranks: DataFrame, parts: DataFrame, key: str, column: str, default: str = "") -> DataFrame:
    """Every row of `ranks` with its value from `parts`, a default where there is none."""
    return ranks.join(parts.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def score_groups(rows: DataFrame, value: str) -> DataFrame:
    """rows whitened over all rows: (x - mean) / sqrt(population variance + 1e-8); sums only reach the driver."""
    s = rows.agg(F.avg(value).alias("m"), F.var_pop(value).alias("v")).first()
    if s["m"] is None:
        return rows.withColumn("whitened", F.lit(None).cast("double"))
    return rows.withColumn("whitened", (F.col(value) - s["m"]) / F.sqrt(F.lit(s["v"]) + 1e-8))
