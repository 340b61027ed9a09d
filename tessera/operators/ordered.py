"""Work along an order without a task that holds it: ranges, what each adds, and offsets of their sums or products.

A range is written once, so its number and its rows stay the same whatever is read again; for each
range one row of totals reaches the driver, never a row of data.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sequences import kl_factor
from tessera.sources.io import work_path


def written(rows: DataFrame, tag: str) -> DataFrame:
    """rows as a table in the shared folder: computed once, and there if an executor is lost."""
    path = work_path(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def in_ranges(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt out by ranges of `by` and written, with the range's number `_part`, which grows with `by`."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), "ranges")


def totals(ranged: DataFrame, **sums: Column) -> list[dict]:
    """The totals of each range, in order: a row for each partition."""
    rows = ranged.groupBy("_part").agg(*[c.alias(n) for n, c in sums.items()]).collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["_part"])


def by_part(values: dict[int, object], kind: str) -> Column:
    """The value of the row's range."""
    if not values:
        return F.lit(None).cast(kind)
    pairs = [F.lit(x).cast(t) for p, v in values.items() for x, t in ((p, "int"), (v, kind))]
    return F.element_at(F.create_map(*pairs), F.col("_part"))


def before(parts: Sequence[dict], name: str, start, combine: Callable) -> dict[int, object]:
    """What the ranges before each one come to."""
    out, at = {}, start
    for p in parts:
        out[p["_part"]] = at
        at = combine(at, p[name])
    return out


def prefix_product(rows: DataFrame, factor: str, order: Sequence[str], out: str, start: float = 1.0) -> DataFrame:
    """rows with `out`, start times the product of the factors of all rows so far in order: running products within
    ranges, which are written, and offsets of the ranges' products.  A null factor counts as 1; order has to name each row once.

    As in a fold along the rows, a product that has become infinite or zero stays so, whatever factors follow; start
    comes last, as in SQL's start * product(f)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_f", F.coalesce(F.col(factor).cast("double"), F.lit(1.0))).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    running = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = written(dealt.withColumn("_run", F.product("_f").over(running)), "products")
    ahead = before(totals(ranged, p=F.product("_f")), "p", 1.0, lambda x, y: x * y)
    whole = ranged.withColumns({"_c": by_part(ahead, "double") * F.col("_run"), "_at": F.struct(*order)})
    gone = whole.where((F.col("_c") == 0) | (F.abs("_c") == math.inf)).agg(F.min(F.struct("_at", "_c")).alias("_gone"))
    stays = F.when(F.col("_at") >= F.col("_gone._at"), F.col("_c") * F.abs("_gone._c")).otherwise(F.col("_c"))
    return whole.crossJoin(F.broadcast(gone)).withColumn(out, F.lit(float(start)) * stays).drop("_f", "_part", "_run", "_c", "_at", "_gone")


def adaptive_coefficient(rows: DataFrame, kl: str, order: Sequence[str], out: str, start: float, target: float, horizon: float, batch: float) -> DataFrame:
    """rows with the coefficient after each one's update, in an order that names each row once; a null kl changes nothing."""
    factor = kl_factor(F.col(kl), target, horizon, batch)
    return prefix_product(rows.withColumn("_factor", factor), "_factor", order, out, start).drop("_factor")


def place(value: Column, splits: Sequence[float]) -> Column:
    """Where a value lies among sorted splits: 2k between splits k - 1 and k, 2k + 1 on split k; a search tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(2 * low)
        mid = (low + high) // 2
        return F.when(value < splits[mid], tree(low, mid)).when(value == splits[mid], F.lit(2 * mid + 1)).otherwise(tree(mid + 1, high))

    return tree(0, len(splits))


def quantiles(rows: DataFrame, column: str, parts: int) -> list[float]:
    """At most parts - 1 distinct splits between which about equally many rows lie."""
    if parts < 2:
        return []
    return sorted(set(rows.approxQuantile(column, [i / parts for i in range(1, parts)], 1 / (4 * parts))))


union = functools.partial(functools.reduce, DataFrame.unionByName)
