"""Queries of p-values: each coefficient report with its significance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalar as X
from tessera.operators import agreement
from tessera.plans.base import query, rounded
from tessera.plans.views import sql_with, table, view


def p_sql(r: str, n: str, steps: int = 4000) -> str:
    """Two-sided p of a correlation: with r = sin(t), the share of cos(t)^(n - 3) beyond |t| (midpoints)."""
    top = f"least(pi() / 2, 14 / sqrt({n}))"
    part = lambda low: f"list_sum(list_transform(range({steps}), lambda k: pow(cos({low} + (k + 0.5) * ({top} - {low}) / {steps}), {n} - 3))) * ({top} - {low})"
    low = f"least(asin(least(1.0, abs({r}))), {top})"
    return f"CASE WHEN {r} IS NULL OR {n} < 3 THEN NULL WHEN abs({r}) >= 1 THEN 0.0 ELSE {part(low)} / ({part('0.0')}) END"


def z_sql(z: str, steps: int = 20000) -> str:
    """Two-sided p of a normal deviate (midpoints up to 12)."""
    return f"2 / sqrt(2 * pi()) * (12 - least(abs({z}), 12)) / {steps} * list_sum(list_transform(range({steps}), lambda k: exp(-pow(least(abs({z}), 12) + (k + 0.5) * (12 - least(abs({z}), 12)) / {steps}, 2) / 2)))"


_WORDS = """CASE WHEN abs(r) >= 0.9 THEN 'very strong' WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' WHEN abs(r) >= 0.3 THEN 'weak' ELSE 'very weak' END AS strength,
CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS significance"""


@query(f"""WITH c AS (SELECT o_orderpriority, corr(o_custkey, o_totalprice) AS r, count(*) AS n FROM orders GROUP BY o_orderpriority), p AS (SELECT *, {p_sql('r', 'n')} AS p FROM c)
SELECT o_orderpriority, round(r, 6) AS r, n, round(p, 5) AS p, {_WORDS} FROM p""")
def correlation_significance(spark, d):
    rows = agreement.pearson(table(spark, d, "orders"), "o_custkey", "o_totalprice", ["o_orderpriority"])
    return rounded(rounded(agreement.described(rows), "r"), "p", digits=5)


@query(f"""WITH e AS (SELECT value AS x, CAST(json_extract(props, '$.k') AS INTEGER) AS y FROM events), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM e),
c AS (SELECT corr(rx, ry) AS r, count(*) AS n FROM k) SELECT round(r, 6) AS r, n, round({p_sql('r', 'n')}, 5) AS p FROM c""")
def spearman_significance(spark, d):
    rows = table(spark, d, "events").select(F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("int").alias("y"))
    return rounded(rounded(agreement.with_p(agreement.spearman(rows, "x", "y")), "r"), "p", digits=5)


@query(sql_with("v_judge") + f""", p AS (SELECT verdict AS x, CASE letter WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.0 ELSE 0.5 END AS y FROM v_judge), c AS (SELECT x, y, count(*) AS c FROM p GROUP BY ALL),
s AS (SELECT sum(sign((a.x - b.x) * (a.y - b.y)) * a.c * b.c) / 2.0 AS s FROM c a, c b), n AS (SELECT CAST(sum(c) AS DOUBLE) AS n FROM c),
tx AS (SELECT sum(t * (t - 1) / 2.0) AS t, sum(t * (t - 1) * (2.0 * t + 5)) AS u, sum(t * (t - 1) * (t - 2.0)) AS v FROM (SELECT CAST(sum(c) AS DOUBLE) AS t FROM c GROUP BY x)),
ty AS (SELECT sum(t * (t - 1) / 2.0) AS t, sum(t * (t - 1) * (2.0 * t + 5)) AS u, sum(t * (t - 1) * (t - 2.0)) AS v FROM (SELECT CAST(sum(c) AS DOUBLE) AS t FROM c GROUP BY y)),
z AS (SELECT n, s, s / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)) AS tau, s / sqrt((n * (n - 1) * (2 * n + 5) - tx.u - ty.u) / 18 + 2 * tx.t * ty.t / (n * (n - 1)) + tx.v * ty.v / (9 * n * (n - 1) * (n - 2))) AS z FROM s, n, tx, ty)
SELECT round(tau, 6) AS tau, CAST(n AS BIGINT) AS n, CAST(s AS DOUBLE) AS s, round(z, 6) AS z, round({z_sql('z')}, 5) AS p FROM z""")
def kendall_significance(spark, d):
    rows = view(spark, d, "v_judge").select("verdict", X.label_number(F.col("letter")).alias("y"))
    return rounded(rounded(agreement.kendall(rows, "verdict", "y").withColumn("p", agreement.normal_p_value(F.col("z"))), "tau", "z"), "p", digits=5)


_COLS = ["o_custkey", "o_totalprice", "o_orderkey"]


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {'1.0' if a == b else f'corr({a}, {b})'} AS r, count(*) AS n FROM orders" for a in _COLS for b in _COLS) + f") SELECT a, b, round(r, 6) AS r, n, round(CASE WHEN a = b THEN 0.0 ELSE {p_sql('r', 'n')} END, 5) AS p FROM c")
def matrix_significance(spark, d):
    return rounded(rounded(agreement.with_p(agreement.correlation_matrix(table(spark, d, "orders"), _COLS)), "r"), "p", digits=5)


def _small_p() -> str:
    """p for 3 to 7 points: the integral of cos^m in closed form."""
    t = "asin(least(1.0, abs(r)))"
    forms = [t, f"sin({t})", f"({t} + sin({t}) * cos({t})) / 2", f"sin({t}) - pow(sin({t}), 3) / 3", f"3 * {t} / 8 + sin(2 * {t}) / 4 + sin(4 * {t}) / 32"]
    whole = [math.pi / 2, 1.0, math.pi / 4, 2 / 3, 3 * math.pi / 16]
    return "CASE " + " ".join(f"WHEN n = {m + 3} THEN 1 - ({f}) / {w!r}" for m, (f, w) in enumerate(zip(forms, whole))) + f" ELSE {p_sql('r', 'n', 1000)} END"


@query(sql_with("v_rewards") + f""", k AS (SELECT prompt_id, corr(r0, r1) AS r, count(*) AS n, stddev_pop(r0) AS s, stddev_pop(r1) AS t FROM v_rewards GROUP BY prompt_id HAVING count(*) >= 2),
p AS (SELECT CASE WHEN s > 1e-9 AND t > 1e-9 THEN r END AS r, n FROM k)
SELECT round(avg(r), 5) AS mean_r, round(avg(CASE WHEN r IS NULL THEN NULL WHEN n < 3 THEN 1.0 ELSE {_small_p()} END), 5) AS mean_p, count(*) AS arrays FROM p""")
def mean_array_significance(spark, d):
    return rounded(agreement.mean_of_array_correlations(view(spark, d, "v_packed"), "a0", "a1", "prompt_id", keep_nan=False, with_p=True), "mean_r", "mean_p", digits=5)


#: One given score for each nation, in their order.
TRUTH = [float((7 * i) % 25) for i in range(25)]


@query("WITH c AS (SELECT n.n_nationkey AS k, avg(c_acctbal) AS x, round(avg(c_acctbal) / 2500) / 4 AS m FROM customer JOIN nation n ON n_nationkey = c_nationkey GROUP BY n.n_nationkey), "
       f"t AS (SELECT *, CAST({TRUTH}[CAST(k + 1 AS INTEGER)] AS DOUBLE) AS y FROM c) SELECT 'mean' AS score, round(corr(x, y), 6) AS r, count(*) AS n FROM t UNION ALL SELECT 'majority', round(CASE WHEN stddev_pop(m) > 1e-9 THEN corr(m, y) END, 6), count(*) FROM t")  # fmt: skip
def against_truth(spark, d) -> DataFrame:
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("x"))
    rows = rows.withColumn("m", F.round(F.col("x") / 2500) / 4)
    one = lambda name, c: agreement.against(rows, "k", c, TRUTH).select(F.lit(name).alias("score"), "r", "n")
    return rounded(one("mean", "x").unionByName(one("majority", "m")), "r")
