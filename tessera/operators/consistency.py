"""Consistency of pairwise preferences: intransitivity, SNTD, cycles, Condorcet winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import clip, logit, sigmoid


def intransitive(ab: Column, bc: Column, ac: Column) -> Column:
    """Do three preferences of {0, .5, 1} contradict one another?  Other values are an error."""
    known = ab.isin(0.0, 0.5, 1.0) & bc.isin(0.0, 0.5, 1.0) & ac.isin(0.0, 0.5, 1.0)
    rule = F.when(ab == 0.5, bc != ac).when(bc == 0.5, ab != ac).when(ac == 0.5, ab != 1 - bc).otherwise((ab == bc) & (ac != ab))
    return F.when(known, rule).otherwise(F.raise_error("preferences of 0, 0.5 or 1 are needed").cast("boolean"))


def binarise(p: Column) -> Column:
    return F.when(p > 0.5, 1.0).when(p == 0.5, 0.5).when(p < 0.5, 0.0)


def _roles(mode: str) -> tuple[str, str, str]:
    """Columns for AB, BC, AC of responses 0, 1, 2; reference mode takes BC from 0-2 and AC from 1-2."""
    return ("p01", "p02", "p12") if mode == "reference" else ("p01", "p12", "p02")


def intransitivity(prefs: DataFrame, mode: str = "fixed") -> DataFrame:
    """Share and count of prompts whose three preferences (p01, p02, p12) are intransitive."""
    ab, bc, ac = (F.col(c) for c in _roles(mode))
    v = intransitive(ab, bc, ac)
    return prefs.agg(F.avg(v.cast("int")).alias("ratio"), F.sum(v.cast("long")).alias("violations"), F.count("*").alias("n"))


def sntd(prefs: DataFrame, mode: str = "fixed") -> DataFrame:
    """Soft non-transitivity: squared Jensen-Shannon distance between given preferences and those that
    the other two imply, each vector over all prompts scaled to sum 1; the mean of the three."""
    ab, bc, ac = (clip(F.col(c)) for c in _roles(mode))
    sab, sbc, sac = logit(ab), logit(bc), logit(ac)
    implied_bc = sigmoid(sab - sac) if mode == "reference" else sigmoid(sac - sab)
    rows = prefs.select(ab.alias("p0"), bc.alias("p1"), ac.alias("p2"), sigmoid(sac - sbc).alias("q0"), implied_bc.alias("q1"), sigmoid(sab + sbc).alias("q2"))
    names = [f"{k}{i}" for k in "pq" for i in range(3)]
    sums = rows.agg(*[F.sum(c).alias(c) for c in names]).first()
    if sums["p0"] is None:
        return prefs.sparkSession.createDataFrame([], "sntd double")
    terms = []
    for i in range(3):
        p, q = F.col(f"p{i}") / sums[f"p{i}"], F.col(f"q{i}") / sums[f"q{i}"]
        m = (p + q) / 2
        terms.append(0.5 * (p * F.log(p / m) + q * F.log(q / m)))
    return rows.agg((F.sum(terms[0] + terms[1] + terms[2]) / 3).alias("sntd"))


#: Most responses of a judgment: its subsets are listed in the row.
MOST = 16


def matrices(prefs: DataFrame, most: int) -> DataFrame:
    """jid and p, the array of p(i over j) row by row for i, j < most, from rows (jid, i, j, p) with i < j; 0.5 on the
    diagonal, null where there is no row.  The rows of a jid are one for each pair."""
    if not 2 <= most <= MOST:
        raise ValueError(f"2 to {MOST} responses")
    known = prefs.where((F.col("j") < most) & F.col("p").isNotNull())
    full = known.groupBy("jid").agg(F.map_from_entries(F.collect_list(F.struct(F.col("i") * most + F.col("j"), "p"))).alias("m"))
    cells = [F.lit(0.5).cast("double") if i == j else F.element_at("m", F.lit(i * most + j)) if i < j else 1 - F.element_at("m", F.lit(j * most + i)) for i in range(most) for j in range(most)]
    return full.select("jid", F.array(*cells).alias("p"))


def by_size(judgments: DataFrame, most: int, sizes: list[int]) -> DataFrame:
    """A row (jid, n, p) for each of the sizes at which all pairs of a judgment's first n responses are known."""
    row = f"transform(sequence(0, {most - 1}), i -> size(filter(slice(p, i * {most} + 1, n), x -> x is not null)))"
    rows = judgments.select("jid", F.explode(F.array(*[F.lit(k) for k in sizes])).alias("n"), "p")
    return rows.where(F.expr(f"forall(slice({row}, 1, n), k -> k = n)"))


def cycles(rows: DataFrame, most: int) -> DataFrame:
    """rows (jid, n, p) with `cycles`, the simple cycles of the graph of preferences, and `dominant`, how many responses no other beats.

    Responses of equal preference are tied, ties reach on, and a tied group is one node, named by its smallest response; an
    edge goes from winner to loser, and a strict preference within a group is a loop, which counts as a cycle.  Cycles are
    counted over subsets of nodes: the paths that begin at a subset's smallest node, fill it and end at v come from those of the
    subset without v.  Sets are bits of a long, all is local to the row; nodes on no cycle are taken off first."""
    seq = "sequence(0, n - 1)"
    at = f"p[i * {most} + j]"
    step = lambda df, name, text: df.withColumn(name, F.expr(text))
    rows = step(rows, "_t", f"transform({seq}, i -> aggregate({seq}, 0L, (m, j) -> if(i = j or {at} = 0.5, m | shiftleft(1L, j), m)))")
    for _ in range(max(1, (most - 1).bit_length())):  # each round reaches twice as far
        rows = step(rows, "_t", f"transform(_t, t -> aggregate({seq}, t, (m, j) -> if(getbit(t, j) = 1, m | _t[j], m)))")
    rows = step(rows, "_g", "transform(_t, t -> bit_count((t & -t) - 1))")
    rows = step(rows, "_w", f"transform({seq}, i -> aggregate({seq}, 0L, (m, j) -> if(i <> j and {at} > 0.5, m | shiftleft(1L, _g[j]), m)))")
    rows = step(rows, "_o", f"transform({seq}, a -> aggregate({seq}, 0L, (m, i) -> if(_g[i] = a, m | _w[i], m)))")
    left = f"aggregate({seq}, 0L, (m, a) -> if(getbit(r, a) = 1 and (_o[a] & r & ~shiftleft(1L, a)) <> 0, m | shiftleft(1L, a), m))"
    rows = step(rows, "_r", f"aggregate(sequence(1, n), shiftleft(1L, n) - 1, (r, k) -> {left})")  # nodes from which one can go on for ever
    on = f"aggregate({seq}, 0L, (s, u) -> if(u <> v and getbit(mask, u) = 1 and getbit(_o[u], v) = 1, s + acc[cast(mask ^ shiftleft(1L, v) as int)][u], s))"
    ends = f"transform({seq}, v -> case when getbit(mask, v) = 0 then 0L when mask = shiftleft(1L, v) then 1L when (mask & -mask) = shiftleft(1L, v) then 0L else {on} end)"
    none = "cast(null as array<bigint>)"
    paths = f"aggregate(sequence(1L, shiftleft(1L, n) - 1), array({none}), (acc, mask) -> concat(acc, array(if((mask & ~_r) <> 0, {none}, {ends}))))"
    rows = step(rows, "_h", f"if(_r = 0, array({none}), {paths})")
    closed = f"aggregate({seq}, 0L, (q, v) -> if(getbit(_o[v], bit_count((mask & -mask) - 1)) = 1, q + _h[cast(mask as int)][v], q))"
    rings = f"aggregate(sequence(1L, shiftleft(1L, n) - 1), 0L, (s, mask) -> if(bit_count(mask) < 2 or (mask & ~_r) <> 0, s, s + {closed}))"
    loops = f"aggregate({seq}, 0L, (s, a) -> s + getbit(_o[a], a))"
    rows = step(rows, "cycles", f"{loops} + if(_r = 0, 0L, {rings})")
    rows = step(rows, "dominant", f"size(filter({seq}, i -> forall(slice(p, i * {most} + 1, n), x -> x >= 0.5)))")
    return rows.drop("_t", "_g", "_w", "_o", "_r", "_h")


def sweep(prefs: DataFrame, most: int, sizes: list[int] | None = None) -> DataFrame:
    """A row for each number of responses, 2 .. most: judgments, cycles, their mean, judgments with cycles and with no, one
    or several dominant responses.  prefs is read once; a size without a judgment has zeros and null means."""
    sizes = sizes or list(range(2, most + 1))
    each = cycles(by_size(matrices(prefs, most), most, sizes), most)
    total, c, d = F.count("*"), F.col("cycles"), F.col("dominant")
    out = each.groupBy("n").agg(total.alias("total_judgments"), F.sum(c).alias("total_cycles"), F.avg(c).alias("avg_cycles"), F.count_if(c > 0).alias("judgments_with_cycles"), (100.0 * F.count_if(c > 0) / total).alias("intransitivity_percentage"), F.count_if(d == 0).alias("no_dominant"), F.count_if(d == 1).alias("one_dominant"), F.count_if(d > 1).alias("multiple_dominant"), F.avg(d).alias("avg_dominant"))
    all_ = prefs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in sizes])).alias("n_response"))
    both = all_.join(out, F.col("n_response") == F.col("n"), "left").drop("n")
    return both.withColumns({x: F.coalesce(x, F.lit(0)) for x in both.columns if x not in ("n_response", "avg_cycles", "avg_dominant")})


def cycle_report(prefs: DataFrame, n: int) -> DataFrame:
    """sweep() at n responses alone."""
    return sweep(prefs, n, [n])
