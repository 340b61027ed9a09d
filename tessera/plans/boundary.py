"""Queries over the model boundary: stand-ins, and whole plans from prompts to votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar as X
from tessera.functions import sequences as S
from tessera.functions import text as T
from tessera.operators import inference
from tessera.plans import pipelines
from tessera.plans.base import query, rounded
from tessera.plans.views import sql_with, table, view
from tessera.sources.io import TEMPLATES


def unit_sql(*parts: str) -> str:
    """The number of 0 .. 1 that the stand-ins make of some texts."""
    joined = " || chr(31) || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(sha256({joined}), 1, 12) AS BIGINT) / 281474976710656.0)"


def said_sql(prompt: str, seed: int) -> str:
    """What the generator makes of a prompt."""
    return f"array_to_string(list_transform(list_sort(list_transform(string_split({prompt}, ' '), lambda w, i: {{'u': {unit_sql(str(seed), 'w')}, 'i': i, 'w': w}})), lambda x: x.w), ' ')"


def filled_sql(template: str, **fields: str) -> str:
    """A template with the given SQL expressions in its fields."""
    parts = [template.replace("{{", chr(1)).replace("}}", chr(2))]
    for name, sql in fields.items():
        parts = [y for x in parts for y in ([x] if x.startswith("=") else [z for k, piece in enumerate(x.split("{" + name + "}")) for z in ([f"={sql}", piece] if k else [piece])])]
    text = lambda x: "'" + x.replace(chr(1), "{").replace(chr(2), "}").replace("'", "''") + "'"
    return " || ".join(x[1:] if x.startswith("=") else text(x) for x in parts)


_WORDS = ["response_0", "response_1"]


@query(f"SELECT p_partkey, p_name, {said_sql('p_name', 0)} AS response_0, {said_sql('p_name', 50)} AS response_1 FROM part")
def stub_generation(spark, d):
    return inference.generate(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", 2)


@query("SELECT p_partkey, " + ", ".join(f"round({unit_sql(repr(n), 'p_name', 'p_type')}, 6) AS reward_{i}" for i, n in enumerate(inference.REWARD_NAMES[:2])) + " FROM part")
def stub_rewards(spark, d):
    rows = inference.score(inference.by_length(table(spark, d, "part").select("p_partkey", "p_name", "p_type"), "p_type"), "p_name", "p_type", inference.REWARD_NAMES[:2])
    return rounded(rows.select("p_partkey", *[F.get("rewards", F.lit(i)).alias(f"reward_{i}") for i in range(2)]), "reward_0", "reward_1")


@query("SELECT p_partkey, 0.0 AS reward FROM part")
def failed_rewards(spark, d):
    rows = inference.score(table(spark, d, "part").select("p_partkey", F.lit(None).cast("int").alias("p"), "p_type"), "p", "p_type", inference.REWARD_NAMES[:1], on_error="zero", backend=inference.Failing())
    return rows.select("p_partkey", F.get("rewards", F.lit(0)).alias("reward"))


@query(f"SELECT p_partkey, p_name, p_type, round(list_sum(list_transform(string_split(p_type, ' '), lambda w, i: -10 * {unit_sql('p_name', 'i - 1', 'w')})), 6) AS logprob FROM part")
def stub_log_probabilities(spark, d):
    return rounded(inference.log_probabilities(table(spark, d, "part").select("p_partkey", "p_name", "p_type"), "p_name", "p_type"), "logprob")


def _plan_sql() -> str:
    scores = "[" + ", ".join(unit_sql(repr(inference.REWARD_NAMES[0]), "p_name", said_sql("p_name", 50 * i)) for i in range(4)) + "]"
    g = "2.0 / (len(pool) * 1000.0) * list_sum(list_transform(pool, lambda m: greatest(1000.0 * {r}, 1000.0 * m) + ln(1 + exp(-abs(1000.0 * {r} - 1000.0 * m)))))"
    return f"""WITH a AS (SELECT p_partkey AS prompt_id, {scores} AS a0 FROM part), s AS (SELECT prompt_id, a0[1:2] AS sel, a0[3:] AS pool, list_max(a0[1:2]) AS hi, list_min(a0[1:2]) AS lo FROM a)
SELECT prompt_id, CAST(list_position(sel, hi) - 1 AS INTEGER) AS chosen_idx, CAST(list_position(sel, lo) - 1 AS INTEGER) AS reject_idx, round(hi, 6) AS chosen_reward, round(lo, 6) AS reject_reward, round({g.format(r='hi')}, 6) AS g_chosen, round({g.format(r='lo')}, 6) AS g_reject FROM s"""


@query(_plan_sql())
def preference_pair_plan(spark, d):
    prompts = table(spark, d, "part").select(F.col("p_partkey").alias("prompt_id"), F.col("p_name").alias("prompt"))
    return rounded(pipelines.preference_pairs(prompts, "prompt", 4, inference.REWARD_NAMES[:1]), "chosen_reward", "reject_reward", "g_chosen", "g_reject")


def _checklists(spark, d):
    text = F.concat(F.lit("1) "), "p_name", F.lit(" (importance: 90/100)\n2) "), "p_type", F.lit(" (importance: 75/100)"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("prompt_id"), F.col("p_name").alias("prompt"), F.col("p_brand").alias("response_0"), F.col("p_type").alias("response_1"), F.col("p_name").alias("response_2"), text.alias("requirements"))


_CHECKS = "SELECT p_partkey AS prompt_id, p_name AS prompt, p_brand AS r0, p_type AS r1, p_name AS r2, CAST(c AS INTEGER) AS check_idx, CASE c WHEN 0 THEN p_name ELSE p_type END AS \"check\", CASE c WHEN 0 THEN 90 ELSE 75 END AS importance FROM part, range(2) u(c)"


def _ask_sql(a: str, b: str) -> str:
    return filled_sql(TEMPLATES["preference_binary"], prompt="prompt", response_a=a, response_b=b, check='"check"')


def _checklist_sql() -> str:
    verdict = f"CAST(floor({unit_sql('ask', 'k')} * 6) AS INTEGER) - 1"
    return f"""WITH c AS ({_CHECKS}), o AS (SELECT *, false AS switched, {_ask_sql('r0', 'r1')} AS ask FROM c UNION ALL SELECT *, true, {_ask_sql('r1', 'r0')} FROM c),
v AS (SELECT prompt_id, check_idx, "check", importance, CASE WHEN switched AND v <> -1 THEN 4 - v ELSE v END AS v FROM (SELECT *, {verdict} AS v FROM o, range(3) u(k))),
n AS (SELECT prompt_id, check_idx, v, count(*) AS n FROM v WHERE v <> -1 GROUP BY ALL), m AS (SELECT prompt_id, check_idx, list(v ORDER BY v) AS l FROM (SELECT *, max(n) OVER (PARTITION BY prompt_id, check_idx) AS m FROM n) WHERE n = m GROUP BY ALL),
g AS (SELECT prompt_id, check_idx, any_value("check") AS "check", any_value(importance) AS importance, round(avg(CASE WHEN v <> -1 THEN v END), 6) AS pref_mean FROM v GROUP BY prompt_id, check_idx HAVING count_if(v <> -1) > 0)
SELECT prompt_id, array_to_string(list("check" ORDER BY check_idx), '|') AS checks, array_to_string(list(importance ORDER BY check_idx), '|') AS importances, array_to_string(list(CAST(l[len(l) // 2 + 1] AS INTEGER) ORDER BY check_idx), '|') AS majorities, round(sum(pref_mean), 5) AS means FROM g JOIN m USING (prompt_id, check_idx) GROUP BY prompt_id"""


@query(_checklist_sql())
def checklist_plan(spark, d):
    rows = pipelines.checklist_judging(_checklists(spark, d), TEMPLATES["preference_binary"], n=3)
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), "|")
    return rows.select("prompt_id", joined("check").alias("checks"), joined("importance").alias("importances"), joined("pref_majority").alias("majorities"), F.round(F.aggregate("pref_mean", F.lit(0.0), lambda s, x: s + F.round(x, 6)), 5).alias("means"))


def _all_pairs_sql() -> str:
    pairs = " UNION ALL ".join(f"SELECT prompt_id, {i} AS i, {j} AS j, check_idx, {s} AS switched, {_ask_sql(*((f'r{i}', f'r{j}') if s == 'false' else (f'r{j}', f'r{i}')))} AS ask FROM c" for i in range(3) for j in range(i + 1, 3) for s in ("false", "true"))
    return f"""WITH c AS ({_CHECKS}), o AS ({pairs}), v AS (SELECT prompt_id, i, j, check_idx, CASE WHEN ({unit_sql('ask', 'k')} < 0.5) <> switched THEN 'A' ELSE 'B' END AS v FROM o, range(2) u(k)),
n AS (SELECT prompt_id, i, j, check_idx, count_if(v = 'A') AS a, count_if(v = 'B') AS b FROM v GROUP BY ALL)
SELECT prompt_id, i, j, check_idx, CASE WHEN a = b THEN 'Tie' WHEN a > b THEN 'A' ELSE 'B' END AS pref_majority, round(a / (a + b), 6) AS pref_mean, CASE WHEN a = b THEN 0.5 WHEN a > b THEN 1.0 ELSE 0.0 END AS pref_majority_num FROM n"""


@query(_all_pairs_sql())
def all_pairs_plan(spark, d):
    return rounded(pipelines.all_pairs_judging(_checklists(spark, d), TEMPLATES["preference_binary"], ["response_0", "response_1", "response_2"], n=2), "pref_mean")


def _explained_sql() -> str:
    begun = f"'{{\"explanation\":\"seen ' || CAST(floor(1000 * {unit_sql('p_name', 'k')}) AS INTEGER) || '\", \"verdict\":'"
    return f"""WITH b AS (SELECT p_partkey, p_name, CAST(k AS INTEGER) AS sample_idx, {begun} AS begun, 'seen ' || CAST(floor(1000 * {unit_sql('p_name', 'k')}) AS INTEGER) AS explanation FROM part, range(2) u(k))
SELECT p_partkey, sample_idx, explanation, CAST(CAST(floor({unit_sql('p_name', 'begun')} * 6) AS INTEGER) - 1 AS VARCHAR) AS verdict FROM b"""


@query(_explained_sql())
def explained_verdicts(spark, d):
    return inference.explained(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "preference_5score", 2).drop("p_name")


@query(sql_with("v_tokens") + """, t AS (SELECT doc_id, list_filter(list_transform(tok, lambda x: CASE WHEN x = 1 THEN 2 ELSE x END), lambda x: x <> 4) AS t FROM v_tokens)
SELECT doc_id, CAST(len(t) AS INTEGER) AS n, CAST(coalesce(list_sum(t), 0) AS BIGINT) AS total FROM t""")
def masked_pads(spark, d):
    t = S.without(S.pads_to_end(F.col("tok"), 1, 2), [4])
    return view(spark, d, "v_tokens").select("doc_id", F.size(t).alias("n"), F.aggregate(t, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("""WITH t AS (SELECT conv_id, turn, list_filter(string_split('User: ' || role || ' ' || replace(text, 'the', 'END'), ' '), lambda w: w <> '') AS w FROM conversations)
SELECT conv_id, turn, array_to_string(w[greatest(1, len(w) - 15):], ' ') AS joined FROM t""")
def reward_texts(spark, d):
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", T.reward_text(F.concat(F.lit("User: "), "role"), F.col("text"), "the", "END", most=16).alias("joined"))


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS INTEGER) AS n, true AS same, CAST(greatest(400, octet_length(encode(text))) AS INTEGER) AS padded FROM documents WHERE text IS NOT NULL")
def byte_tokenizer(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("t"))
    rows = rows.withColumn("ids", S.byte_tokens(F.col("t")))
    return rows.select("doc_id", F.size("ids").alias("n"), (S.byte_text(S.pad_left(F.col("ids"), 400, S.PAD)) == F.col("t")).alias("same"), F.size(S.pad_right(F.col("ids"), 400, S.PAD)).alias("padded"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 1000 ELSE -10.0 END, 6) AS score FROM orders")
def normalised_scores(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.round(S.contains_penalty(F.array(F.col("o_orderstatus")), "F", X.per_thousand(F.col("o_totalprice")), -10.0), 6).alias("score"))
