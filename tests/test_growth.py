"""Rounding, ranges of doubles and memory where tables grow."""

import math
import time

import duckdb
from pyspark.sql import functions as F

from test_agreement import exact_p
from tessera.functions import vocabulary as V
from tessera.operators import agreement, ordered, selection
from tessera.plans import pipelines
from tessera.plans.registry import QUERIES


def test_product_is_infinite_where_sql_says_so(spark):
    """0.05 * product(f): the product leaves the range of doubles before its 20th part does, and doesn't come back."""
    rows = [(0, 1e307), (1, 20.0), (2, 0.01), (3, 0.5)]
    want = duckdb.sql("SELECT i, 0.05 * product(f) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM (VALUES (0, 1e307::DOUBLE), (1, 20.0::DOUBLE), (2, 0.01::DOUBLE), (3, 0.5::DOUBLE)) t(i, f) ORDER BY i").fetchall()
    out = ordered.prefix_product(spark.createDataFrame(rows, "i int, f double"), "f", ["i"], "c", 0.05).orderBy("i").select("i", "c")
    assert [tuple(r) for r in out.collect()] == want


def test_worst_dimension_where_rounding_decides(spark):
    """Order 49684 of sf0.1: two sums of penalties are one and the same but for rounding."""
    row = (49684, [0.86, 0.26, 0.66, 0.62, 0.4, 1.0], [0.8999999999999999, 0.5, 0.7000000000000001, 0.8, 0.3, 0.5], [0.1, 0.5, 0.4, 0.3, 0.3, 0.0])
    out = selection.worst_dimension_pairs(spark.createDataFrame([row], "prompt_id long, a0 array<double>, a1 array<double>, a2 array<double>"), ["a0", "a1", "a2"]).first()
    assert (out["j_star"], out["chosen"], out["reject"]) == (1, 1, 0)


def test_p_of_few_pairs_is_a_finite_sum(spark):
    """Against the quadrature of many pairs' p, and as cheap as a column should be: 300,000 of them in seconds, not minutes."""
    cases = spark.createDataFrame([(r, n) for n in range(3, agreement.FEW_PAIRS + 1) for r in (0.0, 1e-9, 0.05, 0.4, 0.8, 0.97)], "r double, n long")
    few = cases.select("r", "n", agreement.p_value("r", "n").alias("p"), agreement.few_pairs_p(F.col("r"), F.col("n")).alias("q")).collect()
    for r in few:
        assert math.isclose(r["p"], r["q"], rel_tol=1e-6, abs_tol=1e-9), r
        assert math.isclose(r["p"], exact_p(r["r"], r["n"]), rel_tol=1e-6), r
    start = time.perf_counter()
    spark.range(300_000).select(agreement.p_value(F.col("id") / 400_000, F.lit(7)).alias("p")).agg(F.sum("p")).collect()
    assert time.perf_counter() - start < 15


def test_judged_prompts_are_dealt_out(spark):
    """A short table comes in one split; what a prompt becomes is judged in many tasks, each with a share."""
    columns = [F.lit("p").alias("prompt"), *[F.lit(f"r{k}").alias(f"response_{k}") for k in range(3)], F.lit("1) a (importance: 1/100)\n2) b (importance: 2/100)").alias("requirements")]
    rows = spark.range(0, 2000, 1, 1).select(F.col("id").alias("prompt_id"), *columns)
    parts = {r["part"]: r["count"] for r in pipelines.dealt(rows).groupBy(F.spark_partition_id().alias("part")).count().collect()}
    assert len(parts) >= 4 * spark.sparkContext.defaultParallelism and max(parts.values()) < 400
    for out in (pipelines.checklist_judging(rows, "{prompt}{check}", n=1), pipelines.all_pairs_judging(rows, "{prompt}{check}", ["response_0", "response_1", "response_2"])):
        assert "RepartitionByExpression" in out._jdf.queryExecution().analyzed().toString()
        assert out.select("prompt_id").distinct().count() == 2000


def test_the_library_gets_bounded_slices(monkeypatch):
    """However many texts a batch has, only some of their characters are with the library at once; results keep their places."""
    calls = []

    class Library:
        def encode_batch_fast(self, texts, add_special_tokens):
            calls.append(sum(map(len, texts)))
            return [type("E", (), {"ids": [len(t)], "__len__": lambda self: 1})() for t in texts]

        def decode_batch(self, ids, skip_special_tokens):
            calls.append(sum(map(len, ids)))
            return [str(len(x)) for x in ids]

    monkeypatch.setattr(V, "_tokenizer", lambda path: Library())
    texts = ["x" * (1 + k % 5000) for k in range(1000)]
    assert [e.ids for e in V._encoded("", texts)] == [[len(t)] for t in texts]
    assert len(calls) > 1 and max(calls) <= V.AT_ONCE
    assert [len(s) for s in V._slices(["x" * (V.AT_ONCE + 1), "y", "z"])] == [1, 2] and list(V._slices([])) == []


def test_flattened_sides_share_one_packing(spark, small):
    """The lines are packed once; both sides, with their splits and sizes, read what was written."""
    out = QUERIES["flattened_correlation"](spark, small)
    assert out.inputFiles() and not any("lineitem.parquet" in f for f in out.inputFiles())
