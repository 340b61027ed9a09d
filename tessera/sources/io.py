"""Readers of datasets, annotation and report files, and writers of tables and reports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Short templates of our own by judge type; read_templates() loads others.
TEMPLATES = {
    "reward": "Rate from 0 to 100 how well the text meets the question.\nInput:\n{prompt}\nText:\n{response}\nQuestion:\n{check}\nScore:",
    "preference_binary": "Which text meets the question better, A or B?\nInput:\n{prompt}\nA:\n{response_a}\nB:\n{response_b}\nQuestion:\n{check}\nAnswer:",
    "preference_ternary": "Which text meets the question better, A, B or Tie?\nInput:\n{prompt}\nA:\n{response_a}\nB:\n{response_b}\nQuestion:\n{check}\nAnswer:",
    "preference_score": "How much better is A than B, from 10 (A) over 5 to 0 (B)?\nInput:\n{prompt}\nA:\n{response_a}\nB:\n{response_b}\nQuestion:\n{check}\nScore:",
    "preference_5score": "How much better is A than B, one of {{4,3,2,1,0}}, -1 if that can't be told?\nInput:\n{prompt}\nA:\n{response_a}\nB:\n{response_b}\nScore:",
}


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, which clean() deletes; where none is set, in a
    temporary folder of the session (one machine only)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tessera.io.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.tessera.io.dir", base)
    path = f"{base.rstrip('/')}/tessera/{uuid.uuid4().hex}-{name}"
    _made.append(path)
    return path


_made: list[str] = []
_tables: list[str] = []


def clean(spark: SparkSession) -> None:
    """Deletes what was written under work paths in this session; results that are read later need it no more."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _made:
        path = _hadoop(spark, _made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _hadoop(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def read_dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A Parquet dataset, or one split of it kept as folders split=name."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def read_split(spark: SparkSession, paths: dict[str, str], wanted: str = "train") -> DataFrame:
    """The wanted split, else the first there is."""
    if not paths:
        raise ValueError("no splits")
    return spark.read.parquet(paths.get(wanted) or next(iter(paths.values())))


def read_or_make(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; where there is none it is made and written first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split, line_no (from 0) and line of text files of any size.

    A file is read in splits.  Rows of a split have numbers one after another, so a line's place in its split is a
    difference; the counts of a file's splits, a row for each, give what lies before."""
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    rows = spark.read.text(path).select(*where, F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    splits = rows.groupBy("file", "split").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    offsets = splits.select("file", "split", "_first", _sum_before("_n").alias("_before"))
    return rows.join(offsets, ["file", "split"]).select("file", "split", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"), "line")


def _sum_before(count: str) -> Column:
    """Over the splits of a file: the sum of those before."""
    w = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(w), F.lit(0))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0) and line of text files; no file has to fit into a task."""
    return _split_lines(spark, path).drop("split")


def read_annotations(spark: SparkSession, path: str, skip: int = 2) -> DataFrame:
    """array_idx and scores of files of integer lists: the first lines are skipped, lines that aren't lists are left out."""
    lines = _split_lines(spark, path).where(F.col("line_no") >= skip).withColumn("line", F.trim("line"))
    lists = lines.where(F.col("line").rlike(r"^\[.*\]$")).select("file", "split", "line_no", F.from_json("line", "array<int>").alias("scores")).where(F.col("scores").isNotNull() & F.forall("scores", lambda x: x.isNotNull()))
    before = lists.groupBy("file", "split").agg(F.count("*").alias("_n")).select("file", "split", _sum_before("_n").alias("_before"))
    place = F.row_number().over(Window.partitionBy("file", "split").orderBy("line_no")) - 1
    return lists.withColumn("_at", place).join(before, ["file", "split"]).select("file", (F.col("_before") + F.col("_at")).alias("array_idx"), "scores")


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """model, helpfulness, correctness of evaluation reports: a line that names the model and the two lines under it."""
    lines = numbered_lines(spark, path)
    found = lambda pattern, up, name: lines.where(F.col("line").rlike(pattern)).select("file", (F.col("line_no") - up).alias("line_no"), F.regexp_extract("line", pattern, 1).alias(name))
    rows = found(r"^Model: (.+)$", 0, "model").join(found(r"^\s+Helpfulness: ([0-9.]+)$", 1, "h"), ["file", "line_no"]).join(found(r"^\s+Correctness: ([0-9.]+)", 2, "c"), ["file", "line_no"])
    return rows.select("model", F.col("h").cast("double").alias("helpfulness"), F.col("c").cast("double").alias("correctness"))


def read_win_tables(spark: SparkSession, path: str, models: int = 3) -> DataFrame:
    """file, table_no, row_model, values of win-table reports: as many rows of numbers under each heading as there are models.

    Each line has the heading last seen in its split, or else the last one of the splits before."""
    lines = _split_lines(spark, path)
    heading = F.regexp_extract("line", r"^Table ([0-9]+):", 1).try_cast("int")
    own = lines.withColumn("_h", heading)
    last = own.where("_h is not null").groupBy("file", "split").agg(F.max_by("_h", "line_no").alias("_l"))
    splits = lines.select("file", "split").distinct().join(last, ["file", "split"], "left")
    w = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = splits.select("file", "split", F.last("_l", ignorenulls=True).over(w).alias("_c"))
    within = F.last("_h", ignorenulls=True).over(Window.partitionBy("file", "split").orderBy("line_no"))
    under = own.withColumn("_o", within).join(carried, ["file", "split"]).withColumn("table_no", F.coalesce("_o", "_c"))
    words = F.split(F.trim("line"), r"\s+")
    numbers = F.transform(F.slice(words, 2, models + 1), lambda x: x.try_cast("double"))
    rows = under.where(F.col("table_no").isNotNull() & (F.size(words) == models + 1)).withColumn("v", numbers).where(F.forall("v", lambda x: x.isNotNull()))
    nth = F.row_number().over(Window.partitionBy("file", "table_no").orderBy("line_no"))
    return rows.withColumn("_n", nth).where(F.col("_n") <= models).select("file", "table_no", F.get(words, F.lit(0)).alias("row_model"), F.col("v").alias("values"))


def read_templates(spark: SparkSession, path: str, most: int = 1000) -> dict[str, str]:
    """Templates by file name without folder and ending: small files, an error beyond `most` of them."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]*$", 1).alias("n"), "value").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates at {path}")
    return {r["n"]: r["value"] for r in rows}


def flattened_columns(df: DataFrame) -> DataFrame:
    """Fields of struct columns as columns named parent.field."""
    out = []
    for f in df.schema:
        if f.dataType.typeName() == "struct":
            out += [F.col(f"`{f.name}`").getField(g.name).alias(f"{f.name}.{g.name}") for g in f.dataType]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def write_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder for each value of split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def reachable(spark: SparkSession, path: str) -> bool:
    """Can a folder be made at this path?"""
    try:
        folder = _hadoop(spark, path)
        return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    except Py4JJavaError:
        return False


def write_with_fallback(df: DataFrame, path: str, fallback: str) -> str:
    """The path that was written: the first, or, where that can't be reached, the second as Parquet and JSON.

    An error of the rows themselves is an error for either path."""
    if reachable(df.sparkSession, path):
        write_dataset(df, path)
        return path
    write_dataset(df, fallback)
    df.write.mode("overwrite").json(f"{fallback}-json")
    return fallback


def write_bucketed(df: DataFrame, key: str, buckets: int | None = None, sort: list[str] | None = None, name: str | None = None) -> str:
    """The name of a table of df in buckets of a key, sorted in each: grouping, windows and joins on the key then move no rows.

    Without a name it is one of this session, at a work path, and clean() drops it."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(n, key).write.bucketBy(n, key).sortBy(*(sort or [key]))
    if name is None:
        name = f"tessera_{uuid.uuid4().hex}"
        _tables.append(name)
        writer = writer.option("path", work_path(spark, name))
    writer.saveAsTable(name)
    return name


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def win_table_report(table: DataFrame, models: list[str], titles: dict[str, str]) -> DataFrame:
    """line_no and value of the text report of a win table: a heading and a row of '%8.3f' for each model by table."""
    wide = table.groupBy("row_model").pivot("col_model", models).agg(*[F.first(t).alias(t) for t in titles])
    place = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("row_model"))
    lines = None
    for k, (t, title) in enumerate(titles.items()):
        col = lambda m, t=t: F.col(f"`{m}_{t}`" if len(titles) > 1 else f"`{m}`")
        body = wide.select((F.lit(100 * k) + place).alias("line_no"), F.concat(F.format_string("%-8s", "row_model"), *[F.format_string("%8.3f", col(m)) for m in models]).alias("value"))
        head = table.sparkSession.createDataFrame([(100 * k, f"Table {k + 1}: {title}")], "line_no long, value string")
        lines = head.unionByName(body) if lines is None else lines.unionByName(head).unionByName(body)
    return lines


def evaluation_report(rows: DataFrame) -> DataFrame:
    """model and its text block with four decimals."""
    return rows.select("model", F.format_string("Model: %s\n  Helpfulness: %.4f\n  Correctness: %.4f\n", "model", "helpfulness", "correctness").alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    """Lines of a report (small by nature) in order, as one file."""
    lines.orderBy("line_no").select("value").coalesce(1).write.mode("overwrite").text(path)
