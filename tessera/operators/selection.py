"""Preference pairs and targets over packed rewards (one row for each prompt, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import vocabulary


def best_worst_pair(packed: DataFrame, rewards: str = "a0", selection: int = 2, tau: float = A.TAU, plain: bool = False) -> DataFrame:
    """Chosen and rejected of the first `selection` responses, with soft targets against the others.

    Ties go to the first; prompts without a gradient pool are left out."""
    pool = F.slice(F.col(rewards), selection + 1, F.size(rewards))
    rows = packed.where(F.size(rewards) > selection).select("prompt_id", F.slice(rewards, 1, selection).alias("sel"), pool.alias("pool"))
    rows = rows.select("prompt_id", "pool", A.arg_max(F.col("sel")).alias("chosen_idx"), A.arg_min(F.col("sel")).alias("reject_idx"), F.array_max("sel").alias("chosen_reward"), F.array_min("sel").alias("reject_reward"))
    g = lambda r: A.soft_best_of_two(F.col(r), F.col("pool"), tau, plain)
    return rows.select("prompt_id", "chosen_idx", "reject_idx", "chosen_reward", "reject_reward", g("chosen_reward").alias("g_chosen"), g("reject_reward").alias("g_reject"))


def multi_reward_targets(packed: DataFrame, dims: list[str], selection: int = 2, tau: float = A.TAU) -> DataFrame:
    """By dimension: rewards, ranks, soft targets and rank targets of the pair that the first dimension chooses.

    Ranks run over selection and gradient responses; rank targets use ranks in place of rewards."""
    rows = packed.where(F.size(dims[0]) > selection)
    first = F.slice(dims[0], 1, selection)
    rows = rows.select("prompt_id", *dims, *[A.ordinal_ranks(F.col(d)).alias(f"rank_{d}") for d in dims], A.arg_max(first).alias("c"), A.arg_min(first).alias("r"))
    out: list[Column] = [F.col("prompt_id"), F.col("c").alias("chosen_idx"), F.col("r").alias("reject_idx")]
    for j, d in enumerate(dims):
        for side, at in (("chosen", F.col("c")), ("reject", F.col("r"))):
            tail = lambda x: F.slice(x, selection + 1, F.size(x))
            reward, rank = F.get(d, at), F.get(f"rank_{d}", at)
            out += [reward.alias(f"{side}_reward_{j}"), rank.alias(f"{side}_rank_{j}"), A.soft_best_of_two(reward, tail(F.col(d)), tau).alias(f"g_{side}_{j}"), A.soft_best_of_two(rank, tail(F.col(f"rank_{d}")), tau).alias(f"g_winrate_{side}_{j}")]
    return rows.select(*out)


def weighted_difference(targets: DataFrame, weights: list[float], prefix: str = "g") -> DataFrame:
    """Sum over dimensions of weight times (chosen target - rejected target)."""
    total = F.lit(0.0)
    for j, w in enumerate(weights):
        total = total + w * (F.col(f"{prefix}_chosen_{j}") - F.col(f"{prefix}_reject_{j}"))
    return targets.withColumn(f"weighted_{prefix}_diff", total)


def worst_dimension_pairs(packed: DataFrame, dims: list[str], m: int = 2, beta: float = 1.0) -> DataFrame:
    """Pair and targets by the dimension in which the pool does worst (its first arg-max of A).

    Where sums A lie within rounding of one another, and only there, Python tasks find the arg-max."""
    columns = [F.col(d) for d in dims]
    rows = packed.where(F.size(dims[0]) > 2 * m).select("prompt_id", *dims, A.worst_penalties(columns, m, beta).alias("s"))
    tied = A.arg_max_by_library(F.when(A.near_tie(F.col("s.A")), F.array(*columns)), m, beta)
    rows = rows.withColumn("j", F.coalesce(tied, A.arg_max(F.col("s.A")))).select("prompt_id", A.worst_of(columns, F.col("s"), F.col("j")).alias("w"))
    rows = rows.select("prompt_id", F.col("w.j").alias("j_star"), F.get(F.col("w.A"), F.col("w.j")).alias("a_star"), A.worst_dimension_pair(F.col("w"), m).alias("p"))
    return rows.select("prompt_id", "j_star", "a_star", "p.chosen", "p.reject", "p.g_chosen", "p.g_reject")


def averaged_pair(packed: DataFrame, dims: list[str], weights: list[float]) -> DataFrame:
    """Pair by a weighted mean of dimensions."""
    rows = packed.select("prompt_id", A.weighted([F.col(d) for d in dims], weights).alias("w"))
    return rows.select("prompt_id", A.arg_max(F.col("w")).alias("chosen_idx"), A.arg_min(F.col("w")).alias("reject_idx"), F.array_max("w").alias("chosen_reward"), F.array_min("w").alias("reject_reward"))


def different_pairs(pairs: DataFrame, chosen: str, reject: str) -> DataFrame:
    """Pairs of different texts (or positions)."""
    return pairs.where(F.col(chosen) != F.col(reject))


def length_filter(rows: DataFrame, prompt: str, responses: str, longest_prompt: int, longest: int, pool: int | None = None) -> DataFrame:
    """Prompts and all of their responses (or of the first `pool`) within length bounds, in words between spaces."""
    some = F.col(responses) if pool is None else F.slice(responses, 1, pool)
    return rows.where((F.size(F.split(prompt, " ")) <= longest_prompt) & F.forall(some, lambda r: F.size(F.split(r, " ")) <= longest))


def token_length_filter(rows: DataFrame, prompt: str, responses: str, longest_prompt: int, longest: int, path: str, header: int = 0, prompt_frame: tuple[str, str] = ("", ""), response_frame: tuple[str, str] = ("", ""), pool: int | None = None) -> DataFrame:
    """length_filter in tokens of a tokenizers file: prompt and responses stand in their frames (a chat template's texts),
    and `header` tokens of a response's frame aren't counted.  A row with a null prompt or response is left out."""
    some = F.col(responses) if pool is None else F.slice(responses, 1, pool)
    sized = rows.withColumns({"_p": vocabulary.counts(F.array(prompt), path, *prompt_frame), "_r": vocabulary.counts(some, path, *response_frame)})
    fits = (F.get("_p", F.lit(0)) <= longest_prompt) & F.forall("_r", lambda n: F.coalesce(n - header <= longest, F.lit(False)))
    return sized.where(fits).drop("_p", "_r")


def adjacent_pairs(rewards: DataFrame, value: str) -> DataFrame:
    """Responses (0, 1), (2, 3), ... of each prompt side by side: one aggregate, an odd last one is left out."""
    by = rewards.groupBy("prompt_id", F.floor(F.col("resp_idx") / 2).cast("int").alias("pair_idx"))
    out = by.agg(F.max(F.when(F.col("resp_idx") % 2 == 0, F.col(value))).alias("first"), F.max(F.when(F.col("resp_idx") % 2 == 1, F.col(value))).alias("second"), F.count("*").alias("n"))
    return out.where("n = 2").drop("n")


def all_pairs(packed: DataFrame, values: str) -> DataFrame:
    """prompt_id, i, j and both values for all i < j."""
    rows = packed.select("prompt_id", values, F.explode(A.pairs(F.size(values))).alias("p"))
    return rows.select("prompt_id", "p.i", "p.j", F.get(values, F.col("p.i")).alias("first"), F.get(values, F.col("p.j")).alias("second"))


def cross_pairs(packed: DataFrame, values: str, selection: int) -> DataFrame:
    """Each of the first `selection` responses (1-based) against each of the others."""
    rows = packed.select("prompt_id", F.posexplode(F.slice(values, 1, selection)).alias("s", "left"), F.slice(values, selection + 1, F.size(values)).alias("rest"))
    rows = rows.select("prompt_id", "s", "left", F.posexplode("rest").alias("b", "right"))
    return rows.select("prompt_id", (F.col("s") + 1).alias("selection_idx"), (F.col("b") + 1).alias("base_idx"), "left", "right")
