"""Scalar expressions of preference data: logistic forms, label maps, words for coefficients."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels and their numbers.
LABEL_NUMBERS = {"A": 1.0, "B": 0.0, "Tie": 0.5}
#: Least magnitude of a coefficient for each word, and least p for each mark.
STRENGTHS = ((0.9, "very strong"), (0.7, "strong"), (0.5, "moderate"), (0.3, "weak"))
MARKS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))
CLIP = 1e-10


def logistic(a: Column, b: Column) -> Column:
    """Preference of a over b, exp(a) / (exp(a) + exp(b)), without overflow."""
    return 1 / (1 + F.exp(b - a))


def log_add_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log_add_exp_plain(a: Column, b: Column) -> Column:
    """As it is written down: infinite beyond exponents of about 709."""
    return F.log(F.exp(a) + F.exp(b))


def clip(p: Column, by: float = CLIP) -> Column:
    return F.greatest(F.lit(by), F.least(F.lit(1 - by), p))


def logit(p: Column) -> Column:
    p = clip(p)
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def nearest_quarter(x: Column) -> Column:
    """The nearest of 0, .25, .5, .75, 1, the lower one if two are as near."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.ceil(4 * x - 0.5) / 4))


def bradley_terry(chosen: Column, rejected: Column, beta: float) -> Column:
    """Arrays of scores to preferences, element by element."""
    return F.zip_with(chosen, rejected, lambda a, b: sigmoid(beta * (a - b)))


def differences(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def label_number(label: Column) -> Column:
    """A 1, B 0, Tie 0.5; null for all else."""
    out = F.lit(None).cast("double")
    for k, v in LABEL_NUMBERS.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def ternary(score: Column) -> Column:
    """Five-level scores to 0, 2, 4: below, at and above the middle; null stays null."""
    return F.when(score < 2, 0).when(score == 2, 2).when(score > 2, 4)


def ternary_sign(score: Column) -> Column:
    return F.signum(score - 2).cast("int")


def digit_preference(score: Column) -> Column:
    """Five-level verdicts (text or number) to 0 .. 1."""
    return score.cast("double") / 4


def strength(r: Column) -> Column:
    out = F.lit("very weak")
    for least, word in reversed(STRENGTHS):
        out = F.when(F.abs(r) >= least, word).otherwise(out)
    return out


def direction(r: Column) -> Column:
    return F.when(r > 0, "positive").otherwise("negative")


def stars(p: Column) -> Column:
    out = F.lit("ns")
    for most, mark in reversed(MARKS):
        out = F.when(p < most, mark).otherwise(out)
    return out


def exact_div(a: Column, b: Column) -> Column:
    """a div b, an error if it leaves a remainder."""
    return F.when(F.pmod(a, b) == 0, F.expr("1").cast("long") * F.floor(a / b)).otherwise(F.raise_error(F.concat(F.lit("not divisible: "), a.cast("string"), F.lit(" by "), b.cast("string"))).cast("long"))


def shard_bound(rank: Column, n: Column, shards: int) -> Column:
    """First row of a shard when n rows go to shards of nearly equal size, larger ones first."""
    return rank * F.floor(n / shards) + F.least(rank, F.pmod(n, F.lit(shards)))


def cosine_with_warmup(step: Column, warmup: int, total: int) -> Column:
    """Learning-rate factor: linear to 1, then half a cosine to 0."""
    return F.when(step < warmup, step / max(1, warmup)).otherwise(F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(3.141592653589793) * (step - warmup) / max(1, total - warmup)))))


def linear_decay(step: Column, total: int) -> Column:
    return 1 - (step - 1) / total


def rescale(x: Column) -> Column:
    """Logits of fallback reward models."""
    return x / 30 + 0.1


def per_thousand(score: Column) -> Column:
    """A score on the scale that penalties use."""
    return score / 1000
