"""The three life cycles as single lazy plans: preference pairs, checklist judging, model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation, inference, judging, selection
from tessera.plans.views import pack


def preference_pairs(prompts: DataFrame, prompt: str, responses: int, dims: list[str], selection_size: int = 2) -> DataFrame:
    """prompt_id, prompt -> generated responses -> rewards -> best and worst with soft targets: one shuffle, at the pack."""
    wide = inference.generate(prompts.select("prompt_id", prompt), prompt, responses)
    named = F.array(*[F.struct(F.lit(i).alias("resp_idx"), F.col(f"response_{i}").alias("text")) for i in range(responses)])
    long = wide.select("prompt_id", prompt, F.explode(named).alias("r")).select("prompt_id", prompt, "r.resp_idx", "r.text")
    scored = inference.score(long, prompt, "text", dims).select("prompt_id", "resp_idx", F.get("rewards", F.lit(0)).alias("r0"))
    return selection.best_worst_pair(pack(scored, ["r0"], ["a0"]), "a0", selection_size)


def dealt(rows: DataFrame) -> DataFrame:
    """rows by prompt_id over many tasks: a prompt's row is short, but becomes many long ones, which then stay where they are."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, "prompt_id")


def checklist_judging(pairs: DataFrame, template: str, n: int = 5) -> DataFrame:
    """prompt_id, prompt, response_0, response_1, requirements -> a row for each prompt with aligned lists of votes."""
    items = judging.explode_requirements(dealt(pairs), "requirements")
    fields = lambda a, b: T.fill_template(template, prompt=F.col("prompt"), response_a=F.col(a), response_b=F.col(b), check=F.col("check"))
    orders = F.array(F.struct(F.lit(False).alias("switched"), fields("response_0", "response_1").alias("ask")), F.struct(F.lit(True).alias("switched"), fields("response_1", "response_0").alias("ask")))
    asked = items.select("prompt_id", "check_idx", "check", "importance", F.explode(orders).alias("o")).select("prompt_id", "check_idx", "check", "importance", "o.switched", "o.ask")
    got = inference.judge(asked, "ask", ["-1", "0", "1", "2", "3", "4"], n)
    samples = got.select("prompt_id", "check_idx", "check", "importance", "switched", F.posexplode("verdicts").alias("k", "verdict"))
    fair = judging.unswitched(samples, "verdict", "preference_5score").withColumn("sample_idx", F.col("k") + F.when(F.col("switched"), n).otherwise(0))
    votes = judging.vote_numeric(fair, ["prompt_id", "check_idx", "check", "importance"], "verdict", "sample_idx")
    return judging.regroup(judging.valid_rows(votes, ["pref_mean"]), "prompt_id", "check_idx", [], ["check", "importance", "pref_majority", "pref_mean"])


def all_pairs_judging(rows: DataFrame, template: str, responses: list[str], n: int = 1) -> DataFrame:
    """prompt_id, prompt, requirements and any number of responses -> a row for each check and pair i < j:
    both orders judged n times by letter, switched ones reversed, one vote."""
    pairs = [(i, j) for i in range(len(responses)) for j in range(i + 1, len(responses))]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(responses[i]).alias("response_0"), F.col(responses[j]).alias("response_1")) for i, j in pairs])
    items = judging.explode_requirements(dealt(rows), "requirements")
    one = items.select("prompt_id", "prompt", "check_idx", "check", F.explode(cells).alias("p")).select("prompt_id", "prompt", "check_idx", "check", "p.*")
    ask = lambda a, b: T.fill_template(template, prompt=F.col("prompt"), response_a=F.col(a), response_b=F.col(b), check=F.col("check"))
    orders = F.array(F.struct(F.lit(False).alias("switched"), ask("response_0", "response_1").alias("ask")), F.struct(F.lit(True).alias("switched"), ask("response_1", "response_0").alias("ask")))
    asked = one.select("prompt_id", "i", "j", "check_idx", F.explode(orders).alias("o")).select("prompt_id", "i", "j", "check_idx", "o.switched", "o.ask")
    samples = inference.judge(asked, "ask", ["A", "B"], n).select("prompt_id", "i", "j", "check_idx", "switched", F.explode("verdicts").alias("verdict"))
    fair = judging.unswitched(samples, "verdict", "preference_binary")
    return judging.vote_label(fair, ["prompt_id", "i", "j", "check_idx"], "verdict")


def model_comparison(scores: DataFrame, soft: bool = False) -> DataFrame:
    """Win table of prompt_id, model, helpfulness, correctness."""
    return evaluation.win_table(scores, soft=soft)
