"""Model comparison: win tables, pairwise statistics, win rates, best-of-n, reward summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions.scalar import logistic


def indicator(a: Column, b: Column) -> Column:
    return F.when(a > b, 1.0).when(a == b, 0.5).when(a < b, 0.0)


def model_pairs(scores: DataFrame, dims: list[str], ordered: bool) -> DataFrame:
    """Pairs of models of one prompt with both rewards of each dimension.

    Each prompt's models come together in one array and are paired there, so nothing is joined."""
    packed = scores.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("model", *dims))).alias("m"))
    keep = (lambda a, b: a["model"] != b["model"]) if ordered else (lambda a, b: a["model"] < b["model"])
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: keep(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = packed.select("prompt_id", F.explode(pairs).alias("p"))
    return rows.select("prompt_id", F.col("p.a.model").alias("row_model"), F.col("p.b.model").alias("col_model"), *[c for d in dims for c in (F.col(f"p.a.{d}").alias(f"{d}_a"), F.col(f"p.b.{d}").alias(f"{d}_b"))])


def win_table(scores: DataFrame, dims: tuple[str, str] = ("helpfulness", "correctness"), soft: bool = False) -> DataFrame:
    """row_model, col_model, and mean wins by each dimension and by the worst of both; 0.5 on the diagonal.

    Wins count 1, 0.5 for ties, 0; soft: the logistic of the difference.  A prompt counts for a pair if it has both models."""
    win = logistic if soft else indicator
    one, two = (win(F.col(f"{d}_a"), F.col(f"{d}_b")) for d in dims)
    table = model_pairs(scores, list(dims), ordered=True).groupBy("row_model", "col_model").agg(F.avg(one).alias("t1"), F.avg(two).alias("t2"), F.avg(F.least(one, two)).alias("t3"))
    own = scores.select(F.col("model").alias("row_model"), F.col("model").alias("col_model")).distinct()
    return table.unionByName(own.select("row_model", "col_model", *[F.lit(0.5).alias(t) for t in ("t1", "t2", "t3")]))


def pairwise_stats(scores: DataFrame, dim: str = "helpfulness") -> DataFrame:
    """Strict wins, losses, ties and their rates for each unordered pair of models."""
    a, b = F.col(f"{dim}_a"), F.col(f"{dim}_b")
    n = F.count("*")
    rows = model_pairs(scores, [dim], ordered=False).groupBy(F.col("row_model").alias("model_i"), F.col("col_model").alias("model_j"))
    return rows.agg(F.count_if(a > b).alias("wins_i"), F.count_if(a < b).alias("wins_j"), F.count_if(a == b).alias("ties"), n.alias("total"), (F.count_if(a > b) / n).alias("rate_i"), (F.count_if(a < b) / n).alias("rate_j"), (F.count_if(a == b) / n).alias("tie_rate"))


def win_rates(stats: DataFrame) -> DataFrame:
    """Mean of a model's rates over its opponents, its pooled rate, and its rank by the first, then by name."""
    side = lambda me, wins, rate: stats.select(F.col(me).alias("model"), F.col(wins).alias("wins"), F.col(rate).alias("rate"), "total")
    both = side("model_i", "wins_i", "rate_i").unionByName(side("model_j", "wins_j", "rate_j"))
    out = both.groupBy("model").agg(F.avg("rate").alias("avg_pairwise_win_rate"), (F.sum("wins") / F.sum("total")).alias("overall_win_rate"), F.sum("wins").alias("total_wins"), F.sum("total").alias("total_games"))
    # one row for each model: a window without a partition is as small as the report
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("avg_pairwise_win_rate"), "model")))


def summary(rows: DataFrame, key: str, value: str, sample: bool = False) -> DataFrame:
    """Mean, population (or sample) deviation, count, least and greatest of a value by key."""
    deviation = F.stddev_samp if sample else F.stddev_pop
    return rows.groupBy(key).agg(F.avg(value).alias("mean"), deviation(value).alias("std"), F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def best_of_n_curve(packed: DataFrame, rewards: str, n: int) -> DataFrame:
    """k and the mean over prompts of the best of their first k responses, for prompts with n or more."""
    curve = packed.where(F.size(rewards) >= n).select(F.posexplode(A.running_max(F.slice(rewards, 1, n))).alias("k", "best"))
    return curve.groupBy((F.col("k") + 1).alias("k")).agg(F.avg("best").alias("mean_best"))


def best_of_two(packed: DataFrame, rewards: str) -> DataFrame:
    both = packed.where(F.size(rewards) >= 2)
    return both.agg(F.avg(F.greatest(F.get(rewards, F.lit(0)), F.get(rewards, F.lit(1)))).alias("mean_best_of_two"))


def best_response(packed: DataFrame, rewards: str) -> DataFrame:
    """prompt_id, best (first on ties) and its reward."""
    return packed.select("prompt_id", A.arg_max(F.col(rewards)).alias("best"), F.array_max(rewards).alias("best_reward"))


def length_statistics(rows: DataFrame, length: str) -> DataFrame:
    """Mean, median, maximum and 95th and 99th percentiles (interpolated), and capacity advice.

    Rows are counted by length first, so what meets in one task is a count for each length."""
    counts = rows.where(F.col(length).isNotNull()).groupBy(F.col(length).alias("_l")).agg(F.count("*").alias("_n"))
    s = counts.agg((F.sum(F.col("_l") * F.col("_n")) / F.sum("_n")).alias("mean"), F.max("_l").alias("most"), F.percentile("_l", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.col("_n")).alias("p"))
    return s.select("mean", "most", F.get("p", F.lit(0)).alias("median"), F.get("p", F.lit(1)).alias("p95"), F.get("p", F.lit(2)).alias("p99"), (F.col("most") + 5 * F.col("most")).alias("needed"), (6 * F.col("most") <= 2048).alias("fits_2048"))


def grouped_accuracy(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of a value by each key by itself and over all rows, in one statement.  `level` names the key, '' is the total."""
    sets = [[k] for k in keys] + [[]]
    level = F.lit("")
    for k in reversed(keys):
        level = F.when(F.grouping(k) == 0, k).otherwise(level)
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(level.alias("level"), F.avg(value).alias("accuracy"), F.count("*").alias("n"))
    return out.select("level", F.coalesce(*[F.col(k).cast("string") for k in keys]).alias("group"), "accuracy", "n")


def sign_agreement(rows: DataFrame, delta: str) -> DataFrame:
    return rows.agg(F.avg((F.col(delta) > 0).cast("int")).alias("accuracy"))


def histogram(rows: DataFrame, value: str, bins: int = 64) -> DataFrame:
    """Counts of a value over equal bins between its least and greatest: two passes, bounded results."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    if lo is None:
        return rows.sparkSession.createDataFrame([], "bin int, n long")
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) / ((hi - lo) / bins or 1.0))).cast("int")
    return rows.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def observed(rows: DataFrame, scalars: dict[str, Column], histograms: dict[str, tuple[Column, float, float]] | None = None, bins: int = 64) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """rows, and a function that gives (metric, bin, value) of what passed, once an action has run over those rows.

    scalars are aggregates (bin is null); a histogram counts a column's values in equal bins between two bounds, values
    beyond them in the first and last bin, nulls in none.  The rows' own job gathers all of it; there is no second one."""
    seen = Observation()
    counts, edges = [], {}
    for name, (value, low, high) in (histograms or {}).items():
        place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((value - low) / ((high - low) / bins))))
        place = F.when(value.isNotNull(), place)
        counts += [F.count_if(place == k).alias(f"{name}|{k}") for k in range(bins)]
        edges[name] = [f"{name}|{k}" for k in range(bins)]
    out = rows.observe(seen, *[c.alias(n) for n, c in scalars.items()], *counts)
    spark = rows.sparkSession

    def metrics() -> DataFrame:
        got = seen.get
        number = lambda x: None if x is None else float(x)
        found = [(n, None, number(got[n])) for n in scalars] + [(n, k, number(got[c])) for n, cs in edges.items() for k, c in enumerate(cs)]
        return spark.createDataFrame(found, "metric string, bin int, value double")

    return out, metrics


def comparison_frame(scores: DataFrame, dims: list[str], models: list[str]) -> DataFrame:
    """One row for each prompt, reward_{dim}_{model} for each model; 0.0 where there is none, the greatest where there are several."""
    wide = scores.groupBy("prompt_id").pivot("model", models).agg(*[F.max(d).alias(d) for d in dims])
    names = {f"{m}_{d}" if len(dims) > 1 else m: f"reward_{d}_{m}" for m in models for d in dims}
    return wide.select("prompt_id", *[F.coalesce(F.col(f"`{a}`"), F.lit(0.0)).alias(b) for a, b in names.items()])
