"""Kernels over packed arrays: selection, ranks, soft targets, worst-dimension targets.

One row holds all rewards of a prompt, so none of these moves rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalar import log_add_exp, log_add_exp_plain, logistic

TAU = 1000.0


def bind(x: Column, body) -> Column:
    """body(x), with x computed once also where lambdas of body use it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def arg_max(a: Column) -> Column:
    """0-based index of the first maximum; null for an empty or null array."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def arg_min(a: Column) -> Column:
    return F.array_position(a, F.array_min(a)).cast("int") - 1


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def ordinal_ranks(a: Column) -> Column:
    """0-based ranks by value, ties by position, divided by n - 1 (null for n = 1): sorted there and back."""
    by = F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    back = F.array_sort(F.transform(by, lambda e, k: F.struct(e["i"].alias("i"), k.alias("k"))))
    return F.transform(back, lambda e: F.try_divide(e["k"].cast("double"), F.size(a) - 1))


def soft_best_of_two(r: Column, pool: Column, tau: float = TAU, plain: bool = False) -> Column:
    """Target of one response against a gradient pool: 2 / (M tau) times the sum of log(exp(tau r) + exp(tau r_m))."""
    add = log_add_exp_plain if plain else log_add_exp
    return F.lit(2.0) / (F.size(pool) * tau) * total(F.transform(pool, lambda m: add(tau * r, tau * m)))


def _times(w: float):
    return lambda x: x * w


def weighted(arrays: list[Column], weights: list[float]) -> Column:
    out = F.transform(arrays[0], lambda x: x * weights[0])
    for a, w in zip(arrays[1:], weights[1:]):
        out = F.zip_with(out, F.transform(a, _times(w)), lambda s, x: s + x)
    return out


def penalties(first: Column, second: Column, beta: float) -> Column:
    """e_i = exp(-(mean over k of P(k over i)) / beta) for the responses of `second` against those of `first`."""
    share = lambda i: total(F.transform(first, lambda k: logistic(k, i))) / beta / F.size(first)
    return F.transform(second, lambda i: F.exp(-share(i)))


def worst_penalties(dims: list[Column], m: int, beta: float) -> Column:
    """Struct of A (sum of penalties for each dimension) and e (its penalties).

    Each dimension's array holds m responses y', m responses y_k, and the rest z."""
    e = F.array(*[penalties(F.slice(d, m + 1, m), F.slice(d, 1, m), beta) for d in dims])
    return bind(e, lambda x: F.struct(F.transform(x, total).alias("A"), x.alias("e")))


#: Relative distance of two sums of penalties below which rounding may decide which one is greater.
NEAR = 1e-12


def near_tie(a: Column) -> Column:
    """Does another value lie within rounding of the greatest one?"""
    return F.size(F.filter(a, lambda x: x >= F.array_max(a) * (1 - NEAR))) > 1


def _library_exp(x: float) -> float:
    return math.exp(x) if x < 709 else math.inf


def _arg_max_of_penalties(dims, m: int, beta: float) -> int | None:
    sums = []
    for d in dims:
        if d is None or any(x is None for x in d[: 2 * m]):
            return None
        first, second, total_ = d[m : 2 * m], d[:m], 0.0
        for i in second:
            share = 0.0
            for k in first:
                share += 1 / (1 + _library_exp(i - k))
            total_ += _library_exp(-(share / beta / len(first)))
        sums.append(total_)
    return sums.index(max(sums)) if all(x == x for x in sums) else None


def arg_max_by_library(dims: Column, m: int, beta: float) -> Column:
    """The first arg-max of A with the C library's exp, which is nearer to the true value than Java's: ties that rounding
    decides come out as they do in SQL engines.  For an array of the dimensions' arrays; null for null."""

    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else _arg_max_of_penalties(d, m, beta) for d in batch], dtype="Int32")

    return F.pandas_udf(run, "int")(dims)


def worst_of(dims: list[Column], penalties_: Column, j: Column) -> Column:
    """Struct of A, j, e and rewards of dimension j."""
    return F.struct(penalties_["A"].alias("A"), j.alias("j"), F.get(penalties_["e"], j).alias("e"), F.get(F.array(*dims), j).alias("r"))


def worst_dimension_pair(w: Column, m: int) -> Column:
    """chosen, reject (positions among z) and their targets g(z) = sum of P(z over i) e_i / A_j."""

    def of(x: Column) -> Column:
        z, first = F.slice(x["r"], 2 * m + 1, F.size(x["r"])), F.slice(x["r"], 1, m)
        g = lambda v: total(F.zip_with(first, x["e"], lambda i, e: logistic(v, i) * e)) / total(x["e"])
        best, worst = arg_max(z), arg_min(z)
        return F.struct(best.alias("chosen"), worst.alias("reject"), g(F.get(z, best)).alias("g_chosen"), g(F.get(z, worst)).alias("g_reject"))

    return bind(w, of)


def log_sum_exp(a: Column, tau: float = 1.0) -> Column:
    """tau log sum exp(r / tau), shifted by the maximum."""
    return bind(F.array_max(a), lambda m: m + tau * F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp((x - m) / tau))))


def running_max(a: Column) -> Column:
    """The greatest value so far at each place; nulls count for nothing."""
    return F.aggregate(a, F.slice(a, 1, 0), lambda s, x: F.concat(s, F.array(F.greatest(F.try_element_at(s, F.lit(-1)), x))))


def pairs(n: Column) -> Column:
    """All (i, j) with i < j < n as an array of structs, n (n - 1) / 2 in one row."""
    each = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    return F.when(n >= 2, F.flatten(each)).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
