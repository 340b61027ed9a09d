"""Checklist judging: explode requirements, reverse switched verdicts, vote, regroup by prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.arrays import bind
from tessera.functions.scalar import label_number
from tessera.operators.relational import hash_order


def explode_requirements(rows: DataFrame, column: str) -> DataFrame:
    """A row for each item of a requirement list: check_idx, check, importance."""
    other = [c for c in rows.columns if c != column]
    return rows.select(*other, F.explode(T.requirements(F.col(column))).alias("r")).select(*other, "r.check_idx", "r.check", "r.importance")


def swap_at_random(rows: DataFrame, key: str, chosen: str, rejected: str, seed: int = 42) -> DataFrame:
    """response_0 and response_1 in an order that a hash of the key and seed gives."""
    first = hash_order(key, seed) % 2 == 0
    return rows.withColumns({"response_0": F.when(first, F.col(chosen)).otherwise(F.col(rejected)), "response_1": F.when(first, F.col(rejected)).otherwise(F.col(chosen))})


def unswitched(samples: DataFrame, verdict: str, judge: str, mode: str = "fixed") -> DataFrame:
    """Samples in the first order: those of switched order reversed, all that aren't valid left out.

    mode reference doesn't look again at what reversal made."""
    v = F.col(verdict).cast("string")
    valid = samples.where(T.is_valid(v, judge))
    out = valid.withColumn(verdict, F.when(F.col("switched"), T.reverse_verdict(v, judge, mode)).otherwise(v))
    return out if mode == "reference" else out.where(T.is_valid(F.col(verdict), judge))


def majority_label(values: Column) -> Column:
    """Majority of A, B and Tie among labels.  All equal (also with none): Tie; Tie level with a letter:
    the letter; A level with B: Tie.  Null for an empty list."""
    n = lambda label: F.count_if(values == label)
    a, b, t = n("A"), n("B"), n("Tie")
    most = F.greatest(a, b, t)
    pick = F.when((a == b) & (b == t), "Tie").when((a == most) & (b == most), "Tie").when(a == most, "A").when(b == most, "B").otherwise("Tie")
    return F.when(F.count(values) > 0, pick)


def _counts(list_: Column) -> Column:
    """Distinct values of an array with how often and where first they stand."""
    return F.transform(F.array_distinct(list_), lambda v: F.struct(F.size(F.filter(list_, lambda x: x == v)).alias("n"), F.array_position(list_, v).alias("at"), v.alias("v")))


def mode_of_counts(counts: Column, tie: str = "upper") -> Column:
    """Most frequent value of an array of (n, at, v); of k that are level the upper median, or (tie first) the one of least at."""

    def upper(c: Column) -> Column:
        most = F.array_max(F.transform(c, lambda e: e["n"]))
        level = F.sort_array(F.transform(F.filter(c, lambda e: e["n"] == most), lambda e: e["v"]))
        return bind(level, lambda x: F.get(x, F.floor(F.size(x) / 2).cast("int")))

    def first(c: Column) -> Column:
        return F.get(F.array_sort(F.transform(c, lambda e: F.struct((-e["n"]).alias("n"), e["at"].alias("at"), e["v"].alias("v")))), F.lit(0))["v"]

    return bind(counts, upper if tie == "upper" else first)


def numeric_mode(list_: Column, tie: str = "upper") -> Column:
    """mode_of_counts of an array of values, which stand at their positions."""
    return mode_of_counts(_counts(list_), tie)


def vote_numeric(samples: DataFrame, keys: list[str], verdict: str, order: str, tie: str = "upper", sentinel_in_mean: bool = False, sentinel_in_mode: bool = False, sentinel: int = -1) -> DataFrame:
    """pref_majority and pref_mean of numeric verdicts by keys; the sentinel, the confused verdict, counts only where asked for.

    Samples are counted by keys and verdict first, with the first place of each, so a key's own row holds a number
    for each verdict of the scale, however many samples it has.  Null verdicts count for nothing."""
    v = F.col("_v")
    counts = samples.groupBy(*keys, F.col(verdict).cast("int").alias("_v")).agg(F.count("*").alias("_n"), F.min(order).alias("_at"))
    in_mean = v.isNotNull() if sentinel_in_mean else v != sentinel
    in_mode = v.isNotNull() if sentinel_in_mode else v != sentinel
    listed = F.collect_list(F.when(in_mode, F.struct(F.col("_n").alias("n"), F.col("_at").alias("at"), v.alias("v"))))
    mean = F.try_divide(F.sum(F.when(in_mean, v * F.col("_n"))).cast("double"), F.sum(F.when(in_mean, F.col("_n"))))
    rows = counts.groupBy(*keys).agg(listed.alias("_c"), mean.alias("pref_mean"))
    return rows.select(*keys, mode_of_counts(F.col("_c"), tie).alias("pref_majority"), "pref_mean")


def vote_label(samples: DataFrame, keys: list[str], label: str) -> DataFrame:
    """pref_majority, its number, and the mean of labels as numbers (A 1, B 0, Tie 0.5)."""
    rows = samples.groupBy(*keys).agg(majority_label(F.col(label)).alias("pref_majority"), F.avg(label_number(F.col(label))).alias("pref_mean"))
    return rows.withColumn("pref_majority_num", label_number(F.col("pref_majority")))


def merged_orders(direct: DataFrame, switched: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of both orders' aggregates; of one where the other has none."""
    both = direct.select(*keys, F.col("pref_mean").alias("a")).join(switched.select(*keys, F.col("pref_mean").alias("b")), keys, "full")
    return both.select(*keys, ((F.coalesce("a", "b") + F.coalesce("b", "a")) / 2).alias("pref_mean"))


def valid_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.dropna(subset=columns)


def regroup(rows: DataFrame, key: str, order: str, first: list[str], lists: list[str]) -> DataFrame:
    """One row for each prompt: its first row's columns, and aligned lists in order.

    The rows of a prompt are one array of structs, so lists can't slip against each other."""
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *first, *lists))).alias("x"))
    return packed.select(key, *[F.get("x", F.lit(0))[c].alias(c) for c in first], *[F.col("x")[c].alias(c) for c in lists])


def flag_truncated(rows: DataFrame, reason: str) -> DataFrame:
    return rows.agg(F.count_if(F.col(reason) == "length").alias("truncated"), F.count("*").alias("n"))
