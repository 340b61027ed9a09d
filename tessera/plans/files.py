"""Queries through the readers and writers: tables and text reports are written to the work folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import evaluation, relational
from tessera.plans.base import HASH_SQL, query, rounded
from tessera.plans.views import sql_with, table, view
from tessera.sources import io


@query(f"SELECT o_orderkey, split, o_orderpriority AS \"tag.priority\", o_orderstatus AS \"tag.status\" FROM (SELECT *, CASE WHEN row_number() OVER (ORDER BY {HASH_SQL.format('o_orderkey')}, o_orderkey) <= 500 THEN 'test' ELSE 'train' END AS split FROM orders) WHERE split = 'test'")
def written_splits(spark, d):
    """Splits as folders, one of them read again; struct fields as dotted columns."""
    rows = table(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).alias("tag"))
    path = io.work_path(spark, "splits")
    io.write_splits(relational.split_exact(rows, "o_orderkey", 500), path)
    return io.flattened_columns(io.read_dataset(spark, path, "test"))


@query("SELECT n_nationkey, n_name, 'second' AS place FROM nation")
def written_with_fallback(spark, d):
    """A path that can't be written, then the second one; the wanted split, else the first there is."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name")
    second = io.work_path(spark, "fallback")
    path = io.write_with_fallback(rows, "nowhere://there/nation", second)
    made = io.read_or_make(spark, io.work_path(spark, "made"), lambda: io.read_split(spark, {"test": path}, "train"))
    return made.withColumn("place", F.lit("second" if path == second else "first"))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def written_csv(spark, d):
    path = io.work_path(spark, "csv")
    io.write_csv(table(spark, d, "region").select("r_regionkey", "r_name"), path)
    return spark.read.csv(path, header=True)


_MODELS = ["view", "click", "purchase", "error", "signup"]
_CELL = " + ".join(f"CAST(printf('%.3f', max(CASE WHEN y = '{m}' THEN CASE k WHEN 1 THEN t1 ELSE t2 END END)) AS DOUBLE)" for m in _MODELS)
_IN = ", ".join(f"'{m}'" for m in _MODELS)
_WIN = "round(avg(CASE WHEN a.{0} > b.{0} THEN 1 WHEN a.{0} = b.{0} THEN 0.5 ELSE 0 END), 6)"


@query(sql_with("v_models") + f""", m AS (SELECT * FROM v_models WHERE model IN ({_IN})), t AS (SELECT a.model AS x, b.model AS y, {_WIN.format('helpfulness')} AS t1, {_WIN.format('correctness')} AS t2 FROM m a JOIN m b USING (prompt_id) WHERE a.model <> b.model GROUP BY ALL
UNION ALL SELECT DISTINCT model, model, 0.5, 0.5 FROM m)
SELECT CAST(k AS INTEGER) AS table_no, x AS row_model, round({_CELL}, 3) AS total FROM t, range(1, 3) u(k) GROUP BY k, x""")
def win_report_round_trip(spark, d):
    """The text report of a win table, written as lines and parsed again."""
    wins = rounded(evaluation.win_table(view(spark, d, "v_models").where(F.col("model").isin(_MODELS))), "t1", "t2")
    path = io.work_path(spark, "report")
    io.write_text(io.win_table_report(wins, _MODELS, {"t1": "Helpfulness", "t2": "Correctness"}), path)
    back = io.read_win_tables(spark, path, len(_MODELS))
    return back.select("table_no", "row_model", F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@query(sql_with("v_models") + "SELECT model, CAST(printf('%.4f', avg(helpfulness)) AS DOUBLE) AS helpfulness, CAST(printf('%.4f', avg(correctness)) AS DOUBLE) AS correctness FROM v_models GROUP BY model")
def evaluation_report_round_trip(spark, d):
    rows = view(spark, d, "v_models").groupBy("model").agg(F.avg("helpfulness").alias("helpfulness"), F.avg("correctness").alias("correctness"))
    path = io.work_path(spark, "evaluation")
    io.evaluation_report(rows).select("value").write.mode("overwrite").text(path)
    return io.read_evaluation(spark, path)


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS array_idx, CAST(n_nationkey % 5 + n_regionkey AS BIGINT) AS total FROM nation WHERE n_nationkey % 4 <> 0")
def annotation_round_trip(spark, d):
    """Lists of integers below two lines of heading; lines that aren't lists are left out."""
    lines = table(spark, d, "nation").select((F.col("n_nationkey") + 3).alias("line_no"), F.when(F.col("n_nationkey") % 4 == 0, "no list here").otherwise(F.concat(F.lit("["), (F.col("n_nationkey") % 5).cast("string"), F.lit(", "), F.col("n_regionkey").cast("string"), F.lit("]"))).alias("value"))
    head = spark.createDataFrame([(1, "Annotation"), (2, "[9, 9]")], "line_no long, value string")
    path = io.work_path(spark, "annotations")
    io.write_text(head.unionByName(lines), path)
    return io.read_annotations(spark, path).select(F.col("array_idx").cast("int").alias("array_idx"), F.aggregate("scores", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT t.name, CAST(n_nationkey AS BIGINT) AS n_nationkey, t.head || n_name || t.tail AS filled FROM nation, (VALUES ('first', 'Rate ', '.'), ('second', 'Is ', ' {fine}?')) t(name, head, tail)")
def filled_templates(spark, d) -> DataFrame:
    """Template files, loaded by name and filled."""
    from tessera.functions import text as T

    path = io.work_path(spark, "templates")
    for name, text in (("first", "Rate {prompt}."), ("second", "Is {prompt} {{fine}}?")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{name}.txt")
    loaded = {n: io.read_templates(spark, f"{path}/{n}.txt") for n in ("first", "second")}
    rows = table(spark, d, "nation")
    one = lambda n: rows.select(F.lit(n).alias("name"), F.col("n_nationkey").cast("long").alias("n_nationkey"), T.fill_template(next(iter(loaded[n].values())).rstrip("\n"), prompt=F.col("n_name")).alias("filled"))
    return one("first").unionByName(one("second"))
