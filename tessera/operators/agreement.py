"""Agreement of scores: Pearson, Spearman, Kendall, by array, as matrices, with p-values."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import direction, stars, strength
from tessera.operators import ordered


#: Most distinct values whose ranks are broadcast (16 bytes each); beyond that adaptive execution splits hot ties.
BROADCAST = 1_000_000


#: Points of the quadrature of p_value, and the share of the density (as a power of e) beyond which nothing is added.
POINTS, FAR = 64, 40.0


#: Most pairs whose p is a finite sum, and the least p that is taken from it (it is one less the sum).
FEW_PAIRS, LEAST = 24, 1e-4


def few_pairs_p(s: Column, n: Column) -> Column:
    """p of |r| = s for 3 to FEW_PAIRS pairs: the finite sums of Student's t for whole degrees of freedom; cheap, without lambdas."""
    c2 = (1 - s) * (1 + s)
    odd, even = F.lit(1.0), F.lit(1.0)
    for j in range(FEW_PAIRS // 2, 0, -1):  # innermost terms first
        odd = 1 + F.when(n >= 5 + 2 * j, 2 * j / (2 * j + 1) * c2 * odd).otherwise(0.0)
        even = 1 + F.when(n >= 4 + 2 * j, (2 * j - 1) / (2 * j) * c2 * even).otherwise(0.0)
    return F.when(n == 3, 2 / math.pi * F.asin(F.sqrt(c2))).when(n == 4, 1 - s).when(n % 2 == 1, 1 - 2 / math.pi * (F.asin(s) + s * F.sqrt(c2) * odd)).otherwise(1 - s * even)


def p_value(r: Column | str, n: Column | str) -> Column:
    """Two-sided p of a correlation of n pairs, Student's t with n - 2 degrees of freedom; null for r null or NaN, or n < 3.

    Few pairs have a finite sum (few_pairs_p).  Else, with r = sin(a) it is the share of cos(t) ** (n - 3) beyond |a|; both areas come from Gauss-Legendre
    points between where they begin and where the density has fallen by e ** -FAR."""
    r, n = (F.col(c) if isinstance(c, str) else c for c in (r, n))
    x, w = np.polynomial.legendre.leggauss(POINTS)
    points = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("w")) for a, b in zip((x + 1) / 2, w / 2)])
    m = (n - 3).cast("double")

    def area(s: Column) -> Column:
        """Of cos ** m from asin(s) on, over cos(asin(s)) ** m."""
        level = F.log1p(-s * s) / 2
        low = F.when(s < 0.7, F.asin(s)).otherwise(F.acos(F.exp(level)))
        log_cos = lambda t: F.when(t < 0.5, F.log1p(-F.pow(F.sin(t), 2)) / 2).otherwise(F.log(F.greatest(F.cos(t), F.lit(1e-300))))
        width = F.acos(F.exp(level) * F.when(m > 0, F.exp(-FAR / m)).otherwise(0.0)) - low
        height = lambda e: F.exp(m * (log_cos(low + e["x"] * width) - level))
        return width * F.aggregate(points, F.lit(0.0), lambda t, e: t + e["w"] * height(e))

    near = F.least(F.abs(r), F.lit(1 - 1e-15))
    p = F.exp(m * F.log1p(-near * near) / 2) * area(near) / area(F.lit(0.0))
    few = few_pairs_p(F.abs(r), n)
    whole = F.when((n <= 4) | ((n <= FEW_PAIRS) & (few > LEAST)), few).otherwise(F.least(p, F.lit(1.0)))
    return F.when(r.isNull() | F.isnan(r) | (n < 3), None).when(F.abs(r) >= 1, 0.0).otherwise(whole)


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's r as an aggregate; null, not an error, where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def normal_p_value(z: Column) -> Column:
    """Two-sided p of a normal deviate (Abramowitz and Stegun 7.1.26, errors below 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def pearson(rows: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """r and n by keys over rows with both values; r is null for a constant side."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*(keys or [])).agg(correlation(x, y).alias("r"), F.count("*").alias("n"))


def average_ranks(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Ranks with ties at their mean, without a one-task window; rows without a value go.

    Distinct values are counted and written in ranges; the ranges' sizes, summed on the
    driver, are their offsets, and a running sum within each range does the rest."""
    counts = ordered.in_ranges(rows.groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")), "_v")
    parts = ordered.totals(counts, n=F.sum(F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0)), k=F.count("*"))
    offset = ordered.by_part(ordered.before(parts, "n", 0, lambda x, y: x + y), "long")
    within = F.sum(F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0)).over(Window.partitionBy("_part").orderBy("_v"))
    ranks = counts.select("_v", (offset + within - (F.col("_n") - 1) / 2).cast("double").alias(out))
    if sum(p["k"] for p in parts) <= BROADCAST:  # a tie may hold any share of the rows
        ranks = F.broadcast(ranks)
    return rows.join(ranks, rows[value].cast("double") == ranks["_v"]).drop("_v")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    return pearson(average_ranks(average_ranks(both, x, "_rx"), y, "_ry"), "_rx", "_ry")


def kendall(rows: DataFrame, x: str, y: str) -> DataFrame:
    """tau-b, n, concordant - discordant, and the z of its tie-corrected normal approximation.

    From the table of joint counts; cells are compared with one another, so both sides need few levels
    (the count of cells is at most the product of levels)."""
    cells = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("c"))
    packed = cells.agg(F.array_sort(F.collect_list(F.struct("x", "y", "c"))).alias("t"))
    zero = F.lit(0).cast("long")
    sign = lambda a, b: F.signum((a["x"] - b["x"]) * (a["y"] - b["y"])).cast("long") * a["c"] * b["c"]
    total = lambda arr, f, z=zero: F.aggregate(arr, z, lambda s, e: s + f(e))
    twice = total(F.col("t"), lambda a: total(F.col("t"), lambda b: sign(a, b)))
    margin = lambda side: F.transform(F.array_distinct(F.transform("t", lambda e: e[side])), lambda v: total(F.filter("t", lambda e: e[side] == v), lambda e: e["c"]))
    s = packed.select(total(F.col("t"), lambda e: e["c"]).alias("n"), (twice / 2).cast("double").alias("s"), margin("x").alias("tx"), margin("y").alias("ty"))
    z = F.lit(0.0)
    tie = lambda c, f: total(F.col(c), lambda v: f(v.cast("double")), z)
    pairs, v3 = (lambda v: v * (v - 1) / 2), (lambda v: v * (v - 1) * (2 * v + 5))
    n = F.col("n").cast("double")
    n0 = pairs(n)
    var = (v3(n) - tie("tx", v3) - tie("ty", v3)) / 18 + F.try_divide(tie("tx", lambda v: v * (v - 1)) * tie("ty", lambda v: v * (v - 1)), 2 * n * (n - 1)) + F.try_divide(tie("tx", lambda v: v * (v - 1) * (v - 2)) * tie("ty", lambda v: v * (v - 1) * (v - 2)), 9 * n * (n - 1) * (n - 2))
    return s.select(F.try_divide(F.col("s"), F.sqrt((n0 - tie("tx", pairs)) * (n0 - tie("ty", pairs)))).alias("tau"), "n", "s", F.try_divide(F.col("s"), F.sqrt(var)).alias("z"))


#: Most ranges of one side of kendall_values; their joint counts, four times the square of this at most, reach the driver.
RANGES = 256


def inversions(y: np.ndarray, c: np.ndarray) -> int:
    """The sum of c_i c_j over i < j with y_i > y_j: one stable parting of the places for each bit of the values' ranks."""
    if len(y) < 2:
        return 0
    if float(c.sum()) ** 2 >= 2**62:
        c = c.astype(object)  # products beyond 64 bits
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    out = 0
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        group = rank >> (bit + 1)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        start = np.repeat(first, np.diff(np.append(first, len(rank))))
        one = (rank >> bit) & 1
        ahead = np.cumsum(c * one) - c * one  # weight of ones before each place
        out += int(((c * (1 - one)) * (ahead - ahead[start])).sum())
        ones = np.cumsum(one) - one
        ones = ones - ones[start]
        zeros = np.arange(len(rank)) - start - ones
        total = np.add.reduceat(1 - one, first)
        to = start + np.where(one == 1, np.repeat(total, np.diff(np.append(first, len(rank)))) + ones, zeros)
        moved, weights = np.empty_like(rank), np.empty_like(c)
        moved[to], weights[to] = rank, c
        rank, c = moved, weights
    return out


def _inverted(cells: DataFrame, group: str, order: list[str]) -> DataFrame:
    """s: the weighted inversions of y in each group, rows in order."""
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.select(group, "x", "y", "c", *[o for o in order if o not in ("x", "y")]).repartition(parts, group).sortWithinPartitions(group, *order)

    def run(batches):
        held, last = [], None

        def done() -> pa.RecordBatch:
            t = pa.concat_tables(held)
            return pa.RecordBatch.from_pydict({"s": [str(inversions(t["y"].to_numpy(), t["c"].to_numpy()))]}, pa.schema([("s", pa.string())]))

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).select([group, "y", "c"])
            g = t[group].to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, z in zip(cuts, cuts[1:]):
                if held and g[a] != last:
                    yield done()
                    held = []
                held.append(t.slice(a, z - a))
                last = g[a]
        if held:
            yield done()

    return dealt.mapInArrow(run, "s string").select(F.col("s").cast("decimal(38,0)").alias("s"))


def kendall_values(rows: DataFrame, x: str, y: str) -> DataFrame:
    """tau, n, s and z as kendall() has them, for values of any number of levels; rows without both values go.

    Distinct pairs are counted and written.  Both sides are cut into ranges, each split value a range of its own, so that a
    tie of any size lies in one where nothing is inverted.  Pairs that differ in both ranges are counted from the ranges'
    joint counts, pairs that share a range of x or one of y within it, by a task for each range."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cells = ordered.written(both.groupBy("x", "y").agg(F.count("*").alias("c")), "cells")
    parts = min(RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sides = {c: ordered.quantiles(cells, c, parts) for c in ("x", "y")}
    placed = cells.withColumns({"a": ordered.place(F.col("x"), sides["x"]), "b": ordered.place(F.col("y"), sides["y"])})
    joint = np.zeros((2 * len(sides["x"]) + 1, 2 * len(sides["y"]) + 1), object)
    for r in placed.groupBy("a", "b").agg(F.sum("c").alias("c")).collect():
        joint[r["a"], r["b"]] = r["c"]
    later = np.zeros_like(joint)
    later[:-1, 1:] = np.cumsum(np.cumsum(joint[::-1], 0)[::-1], 1)[1:, :-1]  # rows of larger x and smaller y
    apart = int((joint * later).sum()) if joint.size else 0
    within = ordered.union([_inverted(placed.where("a % 2 = 0"), "a", ["x", "y"]), _inverted(placed.where("b % 2 = 0"), "b", ["a", "y"])])
    big = lambda c: c.cast("decimal(19,0)")
    t = F.col("t")
    d = t.cast("double")

    def ties(column: str | None) -> DataFrame:
        """Of one side's ties, or of both sides' together: pairs, and the sums that the variance needs."""
        each = cells.select(F.col("c").alias("t")) if column is None else cells.groupBy(column).agg(F.sum("c").alias("t"))
        return each.agg(F.sum((big(t) * big(t - 1) / 2).cast("decimal(38,0)")).alias("p"), F.sum("t").alias("n"), F.sum(d * (d - 1) * (2 * d + 5)).alias("u"), F.sum(d * (d - 1) * (d - 2)).alias("v"))

    tx, ty, txy = (ties(c).first() for c in ("x", "y", None))
    n = tx["n"] or 0
    discordant = apart + int(within.agg(F.sum("s")).first()[0] or 0)
    n0, n1, n2, n3 = n * (n - 1) // 2, int(tx["p"] or 0), int(ty["p"] or 0), int(txy["p"] or 0)
    s = n0 - n1 - n2 + n3 - 2 * discordant
    tau = s / math.sqrt((n0 - n1) * (n0 - n2)) if n0 > n1 and n0 > n2 else None
    z = None
    if n > 2:
        f = float(n)
        var = (f * (f - 1) * (2 * f + 5) - tx["u"] - ty["u"]) / 18 + 2.0 * n1 * n2 / (f * (f - 1)) + tx["v"] * ty["v"] / (9 * f * (f - 1) * (f - 2))
        z = s / math.sqrt(var) if var > 0 else None
    return rows.sparkSession.range(1).select(F.lit(tau).cast("double").alias("tau"), F.lit(n).cast("long").alias("n"), F.lit(float(s)).alias("s"), F.lit(z).cast("double").alias("z"))


def exact_kendall_p(n: int, s: int) -> float:
    """Two-sided p of |S| or more for n values without ties: counts of permutations by inversions."""
    most = n * (n - 1) // 2
    counts = [1]
    for k in range(2, n + 1):
        new = [0] * (len(counts) + k - 1)
        for i, c in enumerate(counts):
            for j in range(k):
                new[i + j] += c
        counts = new
    least = (most - abs(s)) // 2
    return min(1.0, 2 * sum(counts[: least + 1]) / math.factorial(n))


def _flat(side: DataFrame, array: str, order: str, out: str) -> DataFrame:
    """Values of a table of arrays with their place `_at` in the whole, arrays in the order of `order`, then of their values.

    Arrays fall into ranges between fixed splits; the ranges' sizes, summed on the driver, are their offsets."""
    rows = side.select(F.col(order).alias("_o"), F.col(array).alias("_a"), F.coalesce(F.cardinality(array), F.lit(0)).cast("long").alias("_n"))
    parts = int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col("_o").cast("double")
    splits = sorted(set(rows.select(key.alias("_o")).approxQuantile("_o", [i / parts for i in range(1, parts)], 0.01))) if parts > 1 else []
    ranged = rows.withColumn("_part", F.size(F.filter(F.array(*[F.lit(s) for s in splits]), lambda s: s < key)) if splits else F.lit(0))
    before, at = {}, 0
    for r in sorted(ranged.groupBy("_part").agg(F.sum("_n").alias("n")).collect(), key=lambda r: r["_part"]):
        before[r["_part"]], at = at, at + r["n"]
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for p in before.items() for x in p]), F.col("_part").cast("long")) if before else F.lit(0).cast("long")
    within = F.sum("_n").over(Window.partitionBy("_part").orderBy("_o", "_a").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.select("_a", (offset + within - F.col("_n")).alias("_from")).select("_from", F.posexplode("_a").alias("_i", out)).select((F.col("_from") + F.col("_i")).alias("_at"), out)


def flattened(left: DataFrame, right: DataFrame, array: str, order: str) -> DataFrame:
    """Values of two tables of arrays side by side, each side flattened by itself and cut to the shorter.

    left and right hold a number `order` for each array; values meet by their place, no side is collected."""
    return _flat(left, array, order, "x").join(_flat(right, array, order, "y"), "_at").select("x", "y")


def mean_of_array_correlations(rows: DataFrame, x: str, y: str, key: str, keep_nan: bool = True, with_p: bool = False) -> DataFrame:
    """Mean of r (and of its p) over arrays, each pair cut to its shorter; arrays of fewer than two points are left out.

    A constant side gives NaN, which stays and makes the mean NaN, unless keep_nan is false; p of two points is 1."""
    n = F.least(F.size(x), F.size(y))
    points = rows.where(n >= 2).select(key, F.explode(F.arrays_zip(F.slice(x, 1, n).alias("x"), F.slice(y, 1, n).alias("y"))).alias("p"))
    per = points.groupBy(key).agg(correlation("p.x", "p.y").alias("r"), F.count("*").alias("n"))
    mean = lambda v: F.avg(F.coalesce(v, F.lit(float("nan"))) if keep_nan else F.when(~F.isnan(v), v))
    p = [mean(F.when(F.col("r").isNotNull(), F.when(F.col("n") == 2, 1.0).otherwise(p_value("r", "n")))).alias("mean_p")] if with_p else []
    return per.agg(mean(F.col("r")).alias("mean_r"), *p, F.count("*").alias("arrays"))


#: Columns up to which a matrix is a sum for each pair in one aggregate; beyond that it is made of blocks.
FEW_COLUMNS = 16


def correlation_matrix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r, n for all ordered pairs of columns, 1 on the diagonal; n counts all rows, r those with both values."""
    if len(columns) > FEW_COLUMNS:
        return _matrix_of_blocks(rows, columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(F.count("*").alias("n"), *[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs for x, y in ((a, b), (b, a))]
    cells += [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("r")) for c in columns]
    return one.select("n", F.explode(F.array(*cells)).alias("c")).select("c.a", "c.b", "c.r", "n")


def _matrix_of_blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each task sums outer products of its rows, batch by batch, as matrix products: counts, sums, squares and products of
    pairs where both are there.  Values are shifted by their means, which a first pass finds, so that nothing cancels; a
    task holds four matrices of the columns' number squared, and what is shuffled is a row of them for each column and task."""
    k = len(columns)
    first = rows.agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    middle = np.array([first[f"_{i}"] or 0.0 for i in range(k)])
    middle[~np.isfinite(middle)] = 0.0
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def run(batches):
        sums = np.zeros((4, k, k))
        for batch in batches:
            nulls = np.stack([np.asarray(c.is_null()) for c in batch.columns], 1)
            x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns], 1) - middle
            x[nulls] = 0.0
            there = (~nulls).astype(float)
            sums += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        n, sx, sxx, sxy = sums
        parts = {"n": n, "sx": sx, "sy": sx.T, "sxx": sxx, "syy": sxx.T, "sxy": sxy}
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(k), pa.int32()), **{c: pa.array(list(np.ascontiguousarray(parts[c]))) for c in names}})

    doubles = rows.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    part = doubles.mapInArrow(run, "i int, " + ", ".join(f"{c} array<double>" for c in names))
    cells = part.select("i", F.posexplode(F.arrays_zip(*names)).alias("j", "s")).groupBy("i", "j").agg(*[F.sum(f"s.{c}").alias(c) for c in names])
    spread = lambda s, ss: F.col("n") * F.col(ss) - F.col(s) * F.col(s)
    varies = (spread("sx", "sxx") > 1e-12 * F.col("n") * F.col("sxx")) & (spread("sy", "syy") > 1e-12 * F.col("n") * F.col("syy"))
    r = F.when(varies | F.isnan("sxy"), (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread("sx", "sxx")) / F.sqrt(spread("sy", "syy")))
    name = lambda c: F.element_at(F.array(*[F.lit(x) for x in columns]), F.col(c) + 1)
    return cells.select(name("i").alias("a"), name("j").alias("b"), F.when(F.col("i") == F.col("j"), 1.0).otherwise(r).alias("r"), F.lit(first["n"]).cast("long").alias("n"))


def with_p(rows: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    return rows.withColumn("p", p_value(F.col(r), F.col(n)))


def against(rows: DataFrame, key: str, value: str, truth: list[float]) -> DataFrame:
    """r and n of values against a given list: row k of it belongs to key k; keys beyond it are left out."""
    known = F.get(F.array(*[F.lit(float(t)) for t in truth]), F.col(key).cast("int"))
    return pearson(rows.withColumn("_truth", known), value, "_truth")


def described(rows: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """Adds p, strength, direction and significance to a table of coefficients."""
    out = with_p(rows, r, n)
    return out.withColumns({"strength": strength(F.col(r)), "direction": direction(F.col(r)), "significance": stars(F.col("p"))})
