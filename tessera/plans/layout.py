"""Queries of layouts and of what is seen while a table is written."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evaluation, selection
from tessera.plans.base import ORACLE, query, rounded
from tessera.plans.views import VIEWS, pack, table
from tessera.sources import io


@query(ORACLE["best_worst_pair"])
def bucketed_selection(spark, d):
    """The lines in buckets of their order: rewards are numbered, packed and selected without a shuffle."""
    lines = spark.table(io.write_bucketed(table(spark, d, "lineitem"), "l_orderkey"))
    packed = pack(spark.sql(VIEWS["v_rewards"].replace("FROM lineitem", "FROM {lines}"), lines=lines), ["r0", "r1", "r2"], ["a0", "a1", "a2"])
    return rounded(selection.best_worst_pair(packed), "g_chosen", "g_reject")


@query(ORACLE["win_table"])
def bucketed_win_table(spark, d):
    """The events in buckets of their user: only the sums of pairs of models are shuffled."""
    events = spark.table(io.write_bucketed(table(spark, d, "events"), "user_id"))
    scores = spark.sql(VIEWS["v_models"].replace("FROM events", "FROM {events}"), events=events)
    return rounded(evaluation.win_table(scores), "t1", "t2", "t3")


@query("""WITH s AS (SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS finished FROM orders)
SELECT m.metric, CAST(NULL AS INTEGER) AS bin, round(m.value, 6) AS value FROM s, LATERAL (VALUES ('n', CAST(n AS DOUBLE)), ('mean', mean), ('least', least), ('most', most), ('finished', finished)) m(metric, value)
UNION ALL SELECT 'price', CAST(k AS INTEGER), CAST((SELECT count(*) FROM orders WHERE CAST(greatest(0, least(63, floor(o_totalprice / 8000))) AS BIGINT) = k) AS DOUBLE) FROM range(64) u(k)""")
def metrics_of_a_write(spark, d):
    """Scalars and a histogram that are gathered while a table is written, without a second pass."""
    rows = table(spark, d, "orders")
    price = F.col("o_totalprice")
    scalars = {"n": F.count("*"), "mean": F.avg(price), "least": F.min(price), "most": F.max(price), "finished": F.avg((F.col("o_orderstatus") == "F").cast("int"))}
    seen, metrics = evaluation.observed(rows, scalars, {"price": (price, 0.0, 512000.0)})
    io.write_dataset(seen, io.work_path(spark, "observed"))
    out = metrics()
    return out.withColumn("value", F.when(F.col("metric") == "mean", F.round("value", 4)).otherwise(F.round("value", 6)))
