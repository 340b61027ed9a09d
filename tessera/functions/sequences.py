"""Arithmetic of token sequences in arrays: padding, truncation, masks, log-probabilities, losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import bind, total

#: Ids of padding, end and start; bytes follow.
PAD, EOS, BOS, BYTES = 0, 1, 2, 3


def first_true(tokens: Column, value) -> Column:
    """0-based index of the first `value`, the length if there is none."""
    at = F.array_position(tokens, F.lit(value))
    return F.when(at > 0, at - 1).otherwise(F.size(tokens)).cast("int")


def truncate_after(tokens: Column, eos: int, pad: int) -> Column:
    """Everything after the first end token becomes padding; the end token stays."""
    return bind(first_true(tokens, eos), lambda k: F.transform(tokens, lambda t, i: F.when(i > k, F.lit(pad)).otherwise(t)))


def pad_left(tokens: Column, n: int, pad: int) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(F.lit(0), n - F.size(tokens))), tokens)


def pad_right(tokens: Column, n: int, pad: int) -> Column:
    return F.concat(tokens, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), n - F.size(tokens))))


def sequence_length(tokens: Column, pad: int) -> Column:
    """Index of the last token before the padding."""
    return first_true(tokens, pad) - 1


def reward_position(tokens: Column, pad: int) -> Column:
    """The reward trainer's form: -1, the last position, where there is no padding."""
    at = F.array_position(tokens, F.lit(pad)).cast("int")
    return F.when(at > 0, at - 2).otherwise(-1)


def last_token(tokens: Column, query: Column, pad: int) -> Column:
    """Position before the first padding after the query, else the last one."""
    rest = F.slice(tokens, query + 1, F.greatest(F.lit(0), F.size(tokens) - query))
    return query + first_true(rest, pad) - 1


def masked_sum(values: Column, length: Column) -> Column:
    """Sum of values at positions 0 .. length."""
    return total(F.slice(values, 1, length + 1))


def shift_labels(tokens: Column) -> Column:
    return F.slice(tokens, 2, F.size(tokens))


def log_softmax_at(logits: Column, index: Column) -> Column:
    """Log-probability of one entry of a small array of logits."""
    top = F.array_max(logits)
    return F.get(logits, index) - top - F.log(total(F.transform(logits, lambda x: F.exp(x - top))))


def entropy(logits: Column) -> Column:
    """log sum exp(x) - sum softmax(x) x."""

    def of(s: Column) -> Column:
        e = lambda x: F.exp(x - s["top"])
        z = total(F.transform(logits, e))
        return s["top"] + F.log(z) - total(F.transform(logits, lambda x: x * e(x))) / z

    return bind(F.struct(F.array_max(logits).alias("top")), of)


def contains_penalty(tokens: Column, pad: int | str, score: Column, penalty: float) -> Column:
    return F.when(F.array_contains(tokens, pad), score).otherwise(F.lit(penalty))


def kl(new: Column, old: Column) -> Column:
    return F.zip_with(new, old, lambda a, b: a - b)


def shaped(score: Column, kl_sum: Column, beta: float) -> Column:
    return score - beta * kl_sum


def gae(rewards: Column, values: Column, gamma: float = 1.0, lam: float = 0.95) -> Column:
    """Advantages, by a fold from the last step: delta + gamma lambda A."""
    n = F.size(rewards)
    steps = F.reverse(F.transform(rewards, lambda r, i: F.struct(r.alias("r"), F.get(values, i).alias("v"), F.coalesce(F.get(values, i + 1), F.lit(0.0)).alias("next"))))
    zero = F.struct(F.lit(0.0).alias("a"), F.array().cast("array<double>").alias("all"))

    def step(acc: Column, s: Column) -> Column:
        a = s["r"] + gamma * s["next"] - s["v"] + gamma * lam * acc["a"]
        return F.struct(a.alias("a"), F.concat(F.array(a), acc["all"]).alias("all"))

    return F.when(n > 0, F.aggregate(steps, zero, step)["all"]).otherwise(F.array().cast("array<double>"))


def terminal_rewards(kls: Column, score: Column, at: Column, beta: float) -> Column:
    """-beta kl at each step, and the score at its position."""
    return F.transform(kls, lambda k, i: -beta * k + F.when(i == at, score).otherwise(0.0))


def whiten(x: Column, mean: Column, var: Column, shift_mean: bool = True) -> Column:
    out = (x - mean) / F.sqrt(var + 1e-8)
    return out if shift_mean else out + mean


def regression_loss(chosen: Column, rejected: Column, gap: Column, eta: float) -> Column:
    """((log-ratio of chosen - log-ratio of rejected) - eta gap) squared."""
    return F.pow(chosen - rejected - eta * gap, 2)


def approx_kl(delta: Column) -> Column:
    return 0.5 * F.avg(delta * delta)


def ranking_loss(delta: Column) -> Column:
    """-log sigmoid(delta), stable."""
    return F.greatest(-delta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(delta)))


def clipped_policy_loss(advantage: Column, ratio: Column, cliprange: float) -> Column:
    return F.greatest(-advantage * ratio, -advantage * F.greatest(F.lit(1 - cliprange), F.least(F.lit(1 + cliprange), ratio)))


def clipped_value_loss(value: Column, old: Column, returns: Column, cliprange: float) -> Column:
    near = F.greatest(old - cliprange, F.least(old + cliprange, value))
    return F.greatest(F.pow(value - returns, 2), F.pow(near - returns, 2))


def masked_cross_entropy(logprobs: Column, labels: Column, ignore: int) -> Column:
    """Mean of -log-probability over positions whose label counts; null if none does."""
    keep = F.zip_with(logprobs, labels, lambda p, y: F.when(y != ignore, -p))
    kept = F.filter(keep, lambda x: x.isNotNull())
    return F.try_divide(total(kept), F.size(kept))


def adaptive_kl(kls: Column, start: float, target: float, horizon: float, batch: float) -> Column:
    """The coefficient after ordered updates by 1 + clip(kl / target - 1, -0.2, 0.2) batch / horizon."""
    return F.aggregate(kls, F.lit(start), lambda c, k: c * kl_factor(k, target, horizon, batch))


def kl_factor(kl: Column, target: float, horizon: float, batch: float) -> Column:
    """What one update multiplies the coefficient by; 1 where kl is null."""
    return F.when(kl.isNull(), 1.0).otherwise(1 + F.greatest(F.lit(-0.2), F.least(F.lit(0.2), kl / target - 1)) * batch / horizon)


def byte_tokens(text: Column) -> Column:
    """Ids of a text's UTF-8 bytes: the byte plus BYTES; smaller ids are special."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int") + BYTES)


def byte_text(tokens: Column) -> Column:
    """The text of byte ids; special ids have none."""
    return F.decode(F.unhex(F.array_join(F.transform(F.filter(tokens, lambda t: t >= BYTES), lambda t: F.lpad(F.hex(t.cast("long") - BYTES), 2, "0")), "")), "utf-8")


def without(tokens: Column, special: list[int]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(special))


def pads_to_end(tokens: Column, pad: int, eos: int) -> Column:
    """Padding masked as end tokens."""
    return F.transform(tokens, lambda t: F.when(t == pad, F.lit(eos)).otherwise(t))
