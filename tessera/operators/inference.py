"""The model boundary: batch backends behind mapInPandas, with deterministic stand-ins.

A backend is a class with a `load` and a batch method; real models implement the
same methods.  Nulls in answers are failures and stay nulls.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Names of reward dimensions, in their order.
REWARD_NAMES = [
    "helpsteer-helpfulness", "helpsteer-correctness", "helpsteer-coherence", "helpsteer-complexity", "helpsteer-verbosity",
    "ultrafeedback-overall_score", "ultrafeedback-instruction_following", "ultrafeedback-truthfulness", "ultrafeedback-honesty", "ultrafeedback-helpfulness",
    "beavertails-is_safe", "prometheus-score", "argilla-overall_quality", "argilla-judge_lm",
    "code-complexity", "code-style", "code-explanation", "code-instruction-following", "code-readability",
]


def _unit(*parts) -> float:
    """A number of 0 .. 1 that the parts fix."""
    return int.from_bytes(hashlib.sha256("\x1f".join(map(str, parts)).encode()).digest()[:6], "big") / float(1 << 48)


class Generator:
    """Stands in for a text generator: words of the prompt in an order that the seed fixes."""

    def __call__(self, prompts: list[str], seed: int) -> list[str]:
        return [" ".join(sorted(p.split(), key=lambda w: _unit(seed, w))) for p in prompts]


class RewardModel:
    """Stands in for a reward model with named dimensions."""

    def __init__(self, names: list[str]):
        unknown = [n for n in names if n not in REWARD_NAMES]
        if unknown:
            raise ValueError(f"unknown reward dimensions: {unknown}")
        self.names = names

    def __call__(self, prompts: list[str], responses: list[str]) -> list[list[float]]:
        return [[_unit(n, p, r) for n in self.names] for p, r in zip(prompts, responses)]


class Judge:
    """Stands in for a judge: n verdicts of a list of choices."""

    def __init__(self, choices: list[str], n: int):
        self.choices, self.n = choices, n

    def __call__(self, prompt: str) -> list[str]:
        return [self.choices[int(_unit(prompt, k) * len(self.choices))] for k in range(self.n)]


class StructuredJudge:
    """Stands in for a judge that answers with JSON: an explanation, then a verdict of the judge type's range."""

    def __init__(self, judge: str, n: int):
        if judge not in T.RANGES and judge not in T.LETTERS:
            raise ValueError(f"unknown judge type: {judge}")
        self.judge, self.n = judge, n

    def verdict(self, u: float) -> str:
        if self.judge in T.LETTERS:
            names = T.LETTERS[self.judge]
            return f'"{names[int(u * len(names))]}"'
        low, high = T.RANGES[self.judge]
        return str(low + int(u * (high - low + 1)))

    def explain(self, prompt: str) -> list[str]:
        """n unfinished answers: an explanation whose string is still open."""
        return [f'{{"explanation":"seen {int(1000 * _unit(prompt, k))}' for k in range(self.n)]

    def conclude(self, prompt: str, begun: str) -> str:
        """The answer that goes on from `begun`."""
        return f"{begun}{self.verdict(_unit(prompt, begun))}}}"


class LogProb:
    """Stands in for a policy: log-probability of each word of a response."""

    def __call__(self, prompts: list[str], responses: list[str]) -> list[list[float]]:
        return [[-10 * _unit(p, i, w) for i, w in enumerate(r.split())] for p, r in zip(prompts, responses)]


def generate(rows: DataFrame, prompt: str, n: int, backend: Generator | None = None) -> DataFrame:
    """response_0 .. response_{n-1} for each prompt, with seeds 0, 50, 100, ..."""
    backend = backend or Generator()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            texts = df[prompt].fillna("").tolist()
            yield df.assign(**{f"response_{p}": backend(texts, 50 * p) for p in range(n)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, fields + "".join(f", response_{p} string" for p in range(n)))


class Failing:
    """A backend that can't be reached."""

    def __call__(self, *args):
        raise ConnectionError("no model")


def score(rows: DataFrame, prompt: str, response: str, names: list[str], on_error: str = "null", backend=None) -> DataFrame:
    """rewards, an array by dimension; a batch that fails gets nulls, or zeros where that is asked for."""
    model = backend or RewardModel(names)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            try:
                got = model(df[prompt].fillna("").tolist(), df[response].fillna("").tolist())
            except Exception:  # the contract of the boundary: failures are values
                got = [[0.0] * len(names) if on_error == "zero" else None] * len(df)
            yield df.assign(rewards=got)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, fields + ", rewards array<double>")


def judge(rows: DataFrame, prompt: str, choices: list[str], n: int, most_at_once: int = 8) -> DataFrame:
    """verdicts, n for each prompt; calls of a batch run side by side, results stay by row, failures are null.

    verdicts is a column beside the others, so rows stay dealt out as they were; a thread takes every
    most_at_once-th prompt of a batch, not a prompt at a time."""
    backend = Judge(choices, n)

    def ask(text: str):
        try:
            return backend(text)
        except Exception:  # the contract of the boundary: failures are values
            return None

    def share(texts: list[str]) -> list:
        return [ask(t) for t in texts]

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with ThreadPoolExecutor(most_at_once) as pool:
            for batch in it:
                texts = batch.fillna("").tolist()
                out = [None] * len(texts)
                for k, got in enumerate(pool.map(share, [texts[k::most_at_once] for k in range(most_at_once)])):
                    out[k::most_at_once] = got
                yield pd.Series(out, dtype=object)

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn("verdicts", F.pandas_udf(run, "array<string>")(F.col(prompt)))


def _asked(rows: DataFrame, columns: list[str], out: str, kind: str, call, most_at_once: int = 8) -> DataFrame:
    """rows with call(*values of columns) as `out`; calls of a batch run side by side, failures are null."""

    def ask(*values):
        try:
            return call(*values)
        except Exception:  # the contract of the boundary: failures are values
            return None

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(most_at_once) as pool:
            for df in it:
                yield df.assign(**{out: list(pool.map(ask, *[df[c].fillna("").tolist() for c in columns]))})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, `{out}` {kind}")


def explained(rows: DataFrame, prompt: str, judge: str, n: int) -> DataFrame:
    """Two calls for each prompt and sample: an explanation, then the verdict that goes on from it.

    A row for each sample_idx (n of them) with explanation and verdict; an answer that isn't JSON, or whose
    verdict the judge type doesn't know, has verdict null.  Rows keep their keys, so nothing is put back in order."""
    backend = StructuredJudge(judge, n)
    first = _asked(rows, [prompt], "_begun", "array<string>", backend.explain)
    samples = first.select(*rows.columns, F.posexplode("_begun").alias("sample_idx", "_begun")).withColumn("_begun", T.repair_json(F.col("_begun")))
    said = _asked(samples, [prompt, "_begun"], "_answer", "string", backend.conclude)
    verdict = T.json_verdict(F.col("_answer"))
    return said.select(*rows.columns, "sample_idx", F.get_json_object("_answer", "$.explanation").alias("explanation"), F.when(T.is_valid(verdict, judge), verdict).alias("verdict"))


def log_probabilities(rows: DataFrame, prompt: str, response: str) -> DataFrame:
    """logprob: the sum over a response's words."""
    backend = LogProb()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            yield df.assign(logprob=[float(sum(x)) for x in backend(df[prompt].fillna("").tolist(), df[response].fillna("").tolist())])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, fields + ", logprob double")


def by_length(rows: DataFrame, text: str) -> DataFrame:
    """Rows of a partition longest first, so that batches pad little; results don't change."""
    return rows.sortWithinPartitions(F.desc(F.length(text)))
