"""Queries of the reference's operators over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import scalar as X
from tessera.functions import sequences as S
from tessera.functions import text as T
from tessera.functions import vocabulary as V
from tessera.operators import agreement, consistency, evaluation, judging, ordered, relational, selection
from tessera.plans import boundary, files, pipelines, significance  # noqa: F401  their queries join these
from tessera.plans.base import HASH_SQL as _H
from tessera.plans.base import ORACLE, QUERIES, query, rounded  # noqa: F401
from tessera.plans.views import sql_with, table, view, vocabulary

def doubles(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


# -- evaluation ----------------------------------------------------------------

_WIN = "CASE WHEN a.{0} > b.{0} THEN 1 WHEN a.{0} = b.{0} THEN 0.5 ELSE 0 END"
_SOFT = "1 / (1 + exp(b.{0} - a.{0}))"


def _win_sql(form: str) -> str:
    h, c = form.format("helpfulness"), form.format("correctness")
    return sql_with("v_models") + f"""
SELECT a.model AS row_model, b.model AS col_model, round(avg({h}), 6) AS t1, round(avg({c}), 6) AS t2, round(avg(least({h}, {c})), 6) AS t3
FROM v_models a JOIN v_models b USING (prompt_id) WHERE a.model <> b.model GROUP BY a.model, b.model
UNION ALL SELECT DISTINCT model, model, 0.5, 0.5, 0.5 FROM v_models"""


@query(_win_sql(_WIN))
def win_table(spark, d):
    return rounded(evaluation.win_table(view(spark, d, "v_models")), "t1", "t2", "t3")


@query(_win_sql(_SOFT))
def win_table_soft(spark, d):
    return rounded(pipelines.model_comparison(view(spark, d, "v_models"), soft=True), "t1", "t2", "t3")


_STATS = """SELECT a.model AS model_i, b.model AS model_j, count_if(a.helpfulness > b.helpfulness) AS wins_i, count_if(a.helpfulness < b.helpfulness) AS wins_j,
 count_if(a.helpfulness = b.helpfulness) AS ties, count(*) AS total FROM v_models a JOIN v_models b ON a.prompt_id = b.prompt_id AND a.model < b.model GROUP BY ALL"""


@query(sql_with("v_models") + f"SELECT model_i, model_j, CAST(wins_i AS BIGINT) AS wins_i, CAST(wins_j AS BIGINT) AS wins_j, CAST(ties AS BIGINT) AS ties, total, round(wins_i / total, 6) AS rate_i, round(wins_j / total, 6) AS rate_j, round(ties / total, 6) AS tie_rate FROM ({_STATS})")
def pairwise_stats(spark, d):
    return rounded(evaluation.pairwise_stats(view(spark, d, "v_models")), "rate_i", "rate_j", "tie_rate")


@query(sql_with("v_models") + f""", s AS ({_STATS}), b AS (SELECT model_i AS model, wins_i AS w, total FROM s UNION ALL SELECT model_j, wins_j, total FROM s),
r AS (SELECT model, round(avg(w / total), 6) AS avg_pairwise_win_rate, round(sum(w) / sum(total), 6) AS overall_win_rate, CAST(sum(w) AS BIGINT) AS total_wins, CAST(sum(total) AS BIGINT) AS total_games FROM b GROUP BY model)
SELECT *, CAST(row_number() OVER (ORDER BY avg_pairwise_win_rate DESC, model) AS INTEGER) AS rank FROM r""")
def win_rates(spark, d):
    return rounded(evaluation.win_rates(evaluation.pairwise_stats(view(spark, d, "v_models"))), "avg_pairwise_win_rate", "overall_win_rate")


def _summary_sql(std: str) -> str:
    return sql_with("v_models") + f"SELECT model, round(avg(helpfulness), 6) AS mean, round({std}(helpfulness), 6) AS std, count(helpfulness) AS n, min(helpfulness) AS least, max(helpfulness) AS most FROM v_models GROUP BY model"


@query(_summary_sql("stddev_pop"))
def model_summary(spark, d):
    return rounded(evaluation.summary(view(spark, d, "v_models"), "model", "helpfulness"), "mean", "std")


@query(_summary_sql("stddev_samp"))
def model_summary_sample(spark, d):
    return rounded(evaluation.summary(view(spark, d, "v_models"), "model", "helpfulness", sample=True), "mean", "std")


@query(sql_with("v_packed") + """SELECT CAST(k AS INTEGER) AS k, round(avg(list_max(a0[1:k])), 6) AS mean_best FROM v_packed, range(1, 5) u(k) WHERE len(a0) >= 4 GROUP BY k""")
def best_of_n_curve(spark, d):
    return rounded(evaluation.best_of_n_curve(view(spark, d, "v_packed"), "a0", 4), "mean_best")


@query(sql_with("v_packed") + "SELECT round(avg(greatest(a0[1], a0[2])), 6) AS mean_best_of_two FROM v_packed WHERE len(a0) >= 2")
def best_of_two(spark, d):
    return rounded(evaluation.best_of_two(view(spark, d, "v_packed"), "a0"), "mean_best_of_two")


@query(sql_with("v_packed") + "SELECT prompt_id, CAST(list_position(a0, list_max(a0)) - 1 AS INTEGER) AS best, list_max(a0) AS best_reward FROM v_packed")
def best_response(spark, d):
    return evaluation.best_response(view(spark, d, "v_packed"), "a0")


@query("""SELECT round(avg(n_chars), 6) AS mean, max(n_chars) AS most, round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.95), 6) AS p95,
round(quantile_cont(n_chars, 0.99), 6) AS p99, 6 * max(n_chars) AS needed, 6 * max(n_chars) <= 2048 AS fits_2048 FROM documents""")
def length_statistics(spark, d):
    return rounded(evaluation.length_statistics(table(spark, d, "documents"), "n_chars"), "mean", "median", "p95", "p99")


@query("""SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' ELSE '' END AS level,
coalesce(o_orderstatus, o_orderpriority) AS "group", round(avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0 END), 6) AS accuracy, count(*) AS n
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def grouped_accuracy(spark, d):
    rows = table(spark, d, "orders").withColumn("hit", (F.col("o_totalprice") > 200000).cast("double"))
    return rounded(evaluation.grouped_accuracy(rows, ["o_orderstatus", "o_orderpriority"], "hit"), "accuracy")


@query("SELECT round(avg(CASE WHEN l_discount - l_tax > 0 THEN 1.0 ELSE 0 END), 6) AS accuracy FROM lineitem")
def sign_agreement(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_discount") - F.col("l_tax")).alias("delta"))
    return rounded(evaluation.sign_agreement(rows, "delta"), "accuracy")


@query("""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT CAST(least(63, floor((o_totalprice - lo) / ((hi - lo) / 64))) AS INTEGER) AS bin, count(*) AS n FROM orders, e GROUP BY 1""")
def reward_histogram(spark, d):
    return evaluation.histogram(table(spark, d, "orders"), "o_totalprice")


_MODELS = ["click", "error", "purchase", "signup", "view"]


@query(sql_with("v_models") + "SELECT prompt_id, " + ", ".join(f"coalesce(max(CASE WHEN model = '{m}' THEN {c} END), 0.0) AS reward_{c}_{m}" for m in _MODELS for c in ("helpfulness", "correctness")) + " FROM v_models GROUP BY prompt_id")
def comparison_frame(spark, d):
    return evaluation.comparison_frame(view(spark, d, "v_models"), ["helpfulness", "correctness"], _MODELS)


@query(sql_with("v_models") + "SELECT model, round(avg(helpfulness), 6) AS helpfulness, round(avg(correctness), 6) AS correctness FROM v_models GROUP BY model")
def mean_rewards(spark, d):
    rows = view(spark, d, "v_models").groupBy("model").agg(F.avg("helpfulness").alias("helpfulness"), F.avg("correctness").alias("correctness"))
    return rounded(rows, "helpfulness", "correctness")


@query("SELECT CAST(count_if(length(text) > 800) AS BIGINT) AS truncated, count(*) AS n FROM conversations")
def truncation_count(spark, d):
    rows = table(spark, d, "conversations").select(F.when(F.length("text") > 800, "length").otherwise("stop").alias("reason"))
    return judging.flag_truncated(rows, "reason")


# -- selection and targets -------------------------------------------------------

_G = "2.0 / (len({p}) * {t}) * list_sum(list_transform({p}, lambda m: greatest({t} * {r}, {t} * m) + ln(1 + exp(-abs({t} * {r} - {t} * m)))))"
_G_PLAIN = "2.0 / (len({p}) * {t}) * list_sum(list_transform({p}, lambda m: ln(exp({t} * {r}) + exp({t} * m))))"


def _pair_sql(form: str, tau: float) -> str:
    return sql_with("v_packed") + f""", s AS (SELECT prompt_id, a0[1:2] AS sel, a0[3:] AS pool FROM v_packed WHERE len(a0) > 2), c AS (SELECT *, list_max(sel) AS hi, list_min(sel) AS lo FROM s)
SELECT prompt_id, CAST(list_position(sel, hi) - 1 AS INTEGER) AS chosen_idx, CAST(list_position(sel, lo) - 1 AS INTEGER) AS reject_idx, hi AS chosen_reward, lo AS reject_reward,
round({form.format(p='pool', t=tau, r='hi')}, 6) AS g_chosen, round({form.format(p='pool', t=tau, r='lo')}, 6) AS g_reject FROM c"""


@query(_pair_sql(_G, 1000.0))
def best_worst_pair(spark, d):
    return rounded(selection.best_worst_pair(view(spark, d, "v_packed")), "g_chosen", "g_reject")


@query(_pair_sql(_G_PLAIN, 100.0))
def best_worst_pair_plain(spark, d):
    return rounded(selection.best_worst_pair(view(spark, d, "v_packed"), tau=100.0, plain=True), "g_chosen", "g_reject")


def _multi_sql() -> str:
    ranks = ", ".join(f"(row_number() OVER (PARTITION BY prompt_id ORDER BY r{j}, resp_idx) - 1.0) / nullif(count(*) OVER (PARTITION BY prompt_id) - 1, 0) AS k{j}" for j in (0, 1))
    lists = ", ".join(f"list(r{j} ORDER BY resp_idx) AS a{j}, list(k{j} ORDER BY resp_idx) AS b{j}" for j in (0, 1))
    out = []
    for j in (0, 1):
        for side, at in (("chosen", "c"), ("reject", "r")):
            out.append(f"a{j}[{at} + 1] AS {side}_reward_{j}, round(b{j}[{at} + 1], 6) AS {side}_rank_{j}, round({_G.format(p=f'a{j}[3:]', t=1000.0, r=f'a{j}[{at} + 1]')}, 6) AS g_{side}_{j}, round({_G.format(p=f'b{j}[3:]', t=1000.0, r=f'b{j}[{at} + 1]')}, 6) AS g_winrate_{side}_{j}")
    return sql_with("v_rewards") + f""", k AS (SELECT *, {ranks} FROM v_rewards), p AS (SELECT prompt_id, {lists} FROM k GROUP BY prompt_id HAVING count(*) > 2),
c AS (SELECT *, CAST(list_position(a0[1:2], list_max(a0[1:2])) - 1 AS INTEGER) AS c, CAST(list_position(a0[1:2], list_min(a0[1:2])) - 1 AS INTEGER) AS r FROM p)
SELECT prompt_id, c AS chosen_idx, r AS reject_idx, {", ".join(out)} FROM c"""


@query(_multi_sql())
def multi_reward_targets(spark, d):
    t = selection.multi_reward_targets(view(spark, d, "v_packed"), ["a0", "a1"])
    return rounded(t, *[c for c in t.columns if c.startswith("g_") or "_rank_" in c])


@query(f"SELECT prompt_id, round(0.7 * (g_chosen_0 - g_reject_0) + 0.3 * (g_chosen_1 - g_reject_1), 5) + 0.0 AS weighted_g_diff, round(0.7 * (g_winrate_chosen_0 - g_winrate_reject_0) + 0.3 * (g_winrate_chosen_1 - g_winrate_reject_1), 5) + 0.0 AS weighted_g_winrate_diff FROM ({_multi_sql()})")
def weighted_target_difference(spark, d):
    t = multi_reward_targets(spark, d)
    t = selection.weighted_difference(selection.weighted_difference(t, [0.7, 0.3]), [0.7, 0.3], "g_winrate")
    return rounded(t, "weighted_g_diff", "weighted_g_winrate_diff", digits=5).select("prompt_id", "weighted_g_diff", "weighted_g_winrate_diff")


def _worst_sql() -> str:
    e = lambda a: f"list_transform({a}[1:2], lambda i: exp(-list_sum(list_transform({a}[3:4], lambda k: 1 / (1 + exp(i - k)))) / 2))"
    g = lambda v: f"round(list_sum(list_transform(list_zip(r[1:2], e), lambda p: 1 / (1 + exp(p[1] - {v})) * p[2])) / list_sum(e), 6)"
    return sql_with("v_packed") + f""", e AS (SELECT prompt_id, [{e('a0')}, {e('a1')}, {e('a2')}] AS es, [a0, a1, a2] AS rs FROM v_packed WHERE len(a0) > 4),
a AS (SELECT *, list_transform(es, lambda x: list_sum(x)) AS A FROM e), j AS (SELECT *, list_position(A, list_max(A)) AS j FROM a),
z AS (SELECT prompt_id, j, A[j] AS astar, es[j] AS e, rs[j] AS r, rs[j][5:] AS z FROM j),
c AS (SELECT *, list_position(z, list_max(z)) AS c, list_position(z, list_min(z)) AS w FROM z)
SELECT prompt_id, CAST(j - 1 AS INTEGER) AS j_star, round(astar, 6) AS a_star, CAST(c - 1 AS INTEGER) AS chosen, CAST(w - 1 AS INTEGER) AS reject, {g('z[c]')} AS g_chosen, {g('z[w]')} AS g_reject FROM c"""


@query(_worst_sql())
def worst_dimension_pairs(spark, d):
    return rounded(selection.worst_dimension_pairs(view(spark, d, "v_packed"), ["a0", "a1", "a2"]), "a_star", "g_chosen", "g_reject")


@query(sql_with("v_packed") + """, w AS (SELECT prompt_id, list_transform(list_zip(a0, a1), lambda p: p[1] * 0.5 + p[2] * 0.5) AS w FROM v_packed)
SELECT prompt_id, CAST(list_position(w, list_max(w)) - 1 AS INTEGER) AS chosen_idx, CAST(list_position(w, list_min(w)) - 1 AS INTEGER) AS reject_idx, round(list_max(w), 6) AS chosen_reward, round(list_min(w), 6) AS reject_reward FROM w WHERE list_max(w) <> list_min(w)""")
def averaged_pair(spark, d):
    pairs = selection.averaged_pair(view(spark, d, "v_packed"), ["a0", "a1"], [0.5, 0.5])
    return rounded(selection.different_pairs(pairs, "chosen_reward", "reject_reward"), "chosen_reward", "reject_reward")


@query(sql_with("v_rewards") + "SELECT a.prompt_id, CAST(a.resp_idx // 2 AS INTEGER) AS pair_idx, a.r0 AS first, b.r0 AS second FROM v_rewards a JOIN v_rewards b ON a.prompt_id = b.prompt_id AND b.resp_idx = a.resp_idx + 1 WHERE a.resp_idx % 2 = 0")
def adjacent_pairs(spark, d):
    return selection.adjacent_pairs(view(spark, d, "v_rewards"), "r0")


@query(sql_with("v_rewards") + "SELECT a.prompt_id, a.resp_idx AS i, b.resp_idx AS j, a.r0 AS first, b.r0 AS second FROM v_rewards a JOIN v_rewards b ON a.prompt_id = b.prompt_id AND a.resp_idx < b.resp_idx")
def all_pairs(spark, d):
    return selection.all_pairs(view(spark, d, "v_packed"), "a0")


@query(sql_with("v_rewards") + "SELECT a.prompt_id, a.resp_idx + 1 AS selection_idx, b.resp_idx - 1 AS base_idx, a.r0 AS \"left\", b.r0 AS \"right\" FROM v_rewards a JOIN v_rewards b ON a.prompt_id = b.prompt_id AND a.resp_idx < 2 AND b.resp_idx >= 2")
def selection_base_pairs(spark, d):
    return selection.cross_pairs(view(spark, d, "v_packed"), "a0", 2)


@query(sql_with("v_rewards") + "SELECT prompt_id, resp_idx, round((row_number() OVER (PARTITION BY prompt_id ORDER BY r0, resp_idx) - 1.0) / nullif(count(*) OVER (PARTITION BY prompt_id) - 1, 0), 6) AS rank FROM v_rewards")
def ordinal_ranks(spark, d):
    rows = view(spark, d, "v_packed").select("prompt_id", F.posexplode(A.ordinal_ranks(F.col("a0"))).alias("resp_idx", "rank"))
    return rounded(rows, "rank")


@query(sql_with("v_packed") + "SELECT prompt_id, round(list_max(a0) + 0.1 * ln(list_sum(list_transform(a0, lambda x: exp((x - list_max(a0)) / 0.1)))), 6) AS lse FROM v_packed")
def log_sum_exp(spark, d):
    return rounded(view(spark, d, "v_packed").select("prompt_id", A.log_sum_exp(F.col("a0"), 0.1).alias("lse")), "lse")


@query("""WITH c AS (SELECT conv_id, list(text ORDER BY turn, text) FILTER (WHERE role = 'assistant') AS responses, min(text) FILTER (WHERE role = 'user') AS prompt FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(len(responses) AS INTEGER) AS n FROM c WHERE len(string_split(prompt, ' ')) <= 60 AND len(list_filter(responses, lambda r: len(string_split(r, ' ')) > 200)) = 0""")
def length_filter(spark, d):
    turns = table(spark, d, "conversations")
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))), lambda x: x["text"])
    rows = turns.groupBy("conv_id").agg(said.alias("responses"), F.min(F.when(F.col("role") == "user", F.col("text"))).alias("prompt"))
    return selection.length_filter(rows.where(F.size("responses") > 0), "prompt", "responses", 60, 200).select("conv_id", F.size("responses").alias("n"))


@query()
def length_filter_tokens(spark, d):
    """Conversations whose prompt and answers are short in tokens of a public vocabulary, five tokens of frame not counted."""
    turns = table(spark, d, "conversations")
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))), lambda x: x["text"])
    rows = turns.groupBy("conv_id").agg(said.alias("responses"), F.min(F.when(F.col("role") == "user", F.col("text"))).alias("prompt"))
    short = selection.token_length_filter(rows, "prompt", "responses", 120, 400, vocabulary("word_bpe_49k.json"), header=5, response_frame=("assistant says: ", ""))
    return short.select("conv_id", F.size("responses").alias("n"))


@query("SELECT conv_id, turn, text, true AS fits FROM conversations")
def vocabulary_round_trip(spark, d):
    """Ids of a public byte-level vocabulary, and back; no turn has more ids than bytes."""
    path = vocabulary("byte_bpe_50k.json")
    coded = table(spark, d, "conversations").withColumn("ids", V.encode("text", path))
    fits = F.coalesce(F.size("ids") <= F.octet_length("text"), F.lit(True))
    return coded.select("conv_id", "turn", V.decode("ids", path).alias("text"), fits.alias("fits"))


# -- judging -----------------------------------------------------------------------

_FAIR = "CASE WHEN switched AND verdict <> -1 THEN 4 - verdict ELSE verdict END"
_MODE = """, c AS (SELECT prompt_id, check_idx, v, count(*) AS n, min(sample_idx) AS s FROM f {where} GROUP BY ALL), t AS (SELECT *, max(n) OVER (PARTITION BY prompt_id, check_idx) AS m FROM c),
g AS (SELECT prompt_id, check_idx, list(v ORDER BY {order}) AS l FROM t WHERE n = m GROUP BY ALL)
SELECT f.prompt_id, f.check_idx, CAST(any_value({pick}) AS INTEGER) AS pref_majority, round(avg(CASE WHEN v <> -1 THEN v END), 6) AS pref_mean FROM f LEFT JOIN g USING (prompt_id, check_idx) GROUP BY f.prompt_id, f.check_idx"""


def _judge(spark, d, mode="fixed", **options) -> DataFrame:
    fair = judging.unswitched(view(spark, d, "v_judge"), "verdict", "preference_5score", mode)
    return rounded(judging.vote_numeric(fair, ["prompt_id", "check_idx"], "verdict", "sample_idx", **options), "pref_mean")


@query(sql_with("v_judge") + f", f AS (SELECT prompt_id, check_idx, sample_idx, {_FAIR} AS v FROM v_judge)" + _MODE.format(where="WHERE v <> -1", order="v", pick="l[len(l) // 2 + 1]"))
def votes_upper_median(spark, d):
    return _judge(spark, d)


@query(sql_with("v_judge") + f", f AS (SELECT prompt_id, check_idx, sample_idx, {_FAIR} AS v FROM v_judge)" + _MODE.format(where="", order="s", pick="l[1]"))
def votes_first_seen(spark, d):
    return _judge(spark, d, tie="first", sentinel_in_mode=True)


@query(sql_with("v_judge") + ", f AS (SELECT prompt_id, check_idx, sample_idx, CASE WHEN switched THEN 4 - verdict ELSE verdict END AS v FROM v_judge)" + _MODE.format(where="WHERE v <> -1", order="v", pick="l[len(l) // 2 + 1]"))
def votes_reference_mode(spark, d):
    return _judge(spark, d, mode="reference")


@query(sql_with("v_judge") + """, c AS (SELECT prompt_id, check_idx, count_if(letter = 'A') AS a, count_if(letter = 'B') AS b, count_if(letter = 'Tie') AS t,
round(avg(CASE letter WHEN 'A' THEN 1 WHEN 'B' THEN 0 ELSE 0.5 END), 6) AS pref_mean FROM v_judge GROUP BY ALL),
m AS (SELECT *, CASE WHEN a = b AND b = t THEN 'Tie' WHEN a = b AND a > t THEN 'Tie' WHEN a >= b AND a >= t THEN 'A' WHEN b >= a AND b >= t THEN 'B' ELSE 'Tie' END AS pref_majority FROM c)
SELECT prompt_id, check_idx, pref_majority, pref_mean, CASE pref_majority WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.0 ELSE 0.5 END AS pref_majority_num FROM m""")
def votes_label(spark, d):
    return rounded(judging.vote_label(view(spark, d, "v_judge"), ["prompt_id", "check_idx"], "letter"), "pref_mean")


@query(sql_with("v_judge") + """, a AS (SELECT prompt_id, check_idx, avg(CASE WHEN NOT switched AND verdict <> -1 THEN verdict END) AS a, avg(CASE WHEN switched AND verdict <> -1 THEN 4 - verdict END) AS b FROM v_judge GROUP BY ALL)
SELECT prompt_id, check_idx, round((coalesce(a, b) + coalesce(b, a)) / 2, 6) AS pref_mean FROM a""")
def merged_orders(spark, d):
    fair = judging.unswitched(view(spark, d, "v_judge"), "verdict", "preference_5score")
    keys = ["prompt_id", "check_idx"]
    part = lambda flag: judging.vote_numeric(fair.where(F.col("switched") == flag), keys, "verdict", "sample_idx")
    return rounded(judging.merged_orders(part(False), part(True), keys), "pref_mean")


@query(sql_with("v_judge") + f""", f AS (SELECT prompt_id, check_idx, {_FAIR} AS v FROM v_judge), m AS (SELECT prompt_id, check_idx, round(avg(CASE WHEN v <> -1 THEN v END), 6) AS pref_mean FROM f GROUP BY ALL HAVING avg(CASE WHEN v <> -1 THEN v END) IS NOT NULL)
SELECT prompt_id, array_to_string(list(CAST(check_idx AS VARCHAR) ORDER BY check_idx), ',') AS checks, CAST(count(*) AS INTEGER) AS n, round(sum(pref_mean), 4) AS total FROM m GROUP BY prompt_id""")
def regrouped(spark, d):
    votes = judging.valid_rows(_judge(spark, d), ["pref_mean"]).withColumn("ord", F.col("check_idx"))
    rows = judging.regroup(votes, "prompt_id", "ord", [], ["check_idx", "pref_mean"])
    return rows.select("prompt_id", F.array_join(F.col("check_idx").cast("array<string>"), ",").alias("checks"), F.size("pref_mean").alias("n"), F.round(A.total(F.col("pref_mean")), 4).alias("total"))


@query("""SELECT p_partkey, CAST(k AS INTEGER) AS check_idx, CASE k WHEN 0 THEN p_name || ' with 2) inside' ELSE p_type END AS "check", CASE k WHEN 0 THEN CAST(p_size AS INTEGER) ELSE 75 END AS importance FROM part, range(2) u(k)""")
def requirement_lists(spark, d):
    text = F.concat(F.lit("1) "), "p_name", F.lit(" with 2) inside (importance: "), F.col("p_size").cast("string"), F.lit("/100)\n2) "), "p_type", F.lit(" (importance: 75/100)"))
    return judging.explode_requirements(table(spark, d, "part").select("p_partkey", text.alias("requirements")), "requirements")


_K = "CAST(json_extract(props, '$.k') AS INTEGER)"


def _verdict_text() -> Column:
    k = F.get_json_object("props", "$.k").cast("int")
    return F.when(k % 5 == 0, F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).when(k % 5 == 1, F.concat(k.cast("string"), F.lit(".0"))).when(k % 5 == 2, F.concat(F.lit("score: "), k.cast("string"))).when(k % 5 == 3, F.concat(k.cast("string"), F.lit("/4"))).otherwise(F.concat(F.lit("a "), k.cast("string"), F.lit(" b")))


_TEXT_SQL = f"CASE WHEN {_K} % 5 = 0 THEN ' ' || {_K} || ' ' WHEN {_K} % 5 = 1 THEN {_K} || '.0' WHEN {_K} % 5 = 2 THEN 'score: ' || {_K} WHEN {_K} % 5 = 3 THEN {_K} || '/4' ELSE 'a ' || {_K} || ' b' END"


@query(f"""SELECT event_id, CASE WHEN {_K} % 5 = 0 THEN {_K} BETWEEN 0 AND 100 ELSE false END AS valid_reward, CASE WHEN {_K} % 5 = 0 THEN {_K} BETWEEN 0 AND 10 ELSE false END AS valid_score,
CASE WHEN {_K} % 5 = 0 THEN {_K} BETWEEN -1 AND 4 ELSE false END AS valid_5score, CASE WHEN {_K} % 5 = 4 THEN NULL ELSE CAST({_K} AS VARCHAR) END AS edge,
CASE WHEN {_K} % 5 = 0 THEN CAST({_K} AS INTEGER) END AS percent FROM events""")
def verdict_parsing(spark, d):
    rows = table(spark, d, "events").select("event_id", _verdict_text().alias("t"))
    t = F.col("t")
    return rows.select("event_id", T.is_valid(t, "reward").alias("valid_reward"), T.is_valid(t, "preference_score").alias("valid_score"), T.is_valid(t, "preference_5score").alias("valid_5score"), T.edge_number(t).alias("edge"), T.percent_verdict(t).alias("percent"))


@query(f"""SELECT event_id, CASE WHEN {_K} % 6 = 0 THEN '-1' ELSE CAST(4 - ({_K} % 6 - 1) AS VARCHAR) END AS five, CASE {_K} % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' ELSE 'Tie' END AS letter,
CAST(10 - {_K} % 11 AS VARCHAR) AS ten, CAST(4 - ({_K} % 6 - 1) AS VARCHAR) AS five_reference,
CASE WHEN {_K} % 6 = 0 THEN '-3' ELSE CAST(3 - {_K} % 6 AS VARCHAR) END AS two, CAST(3 - {_K} % 6 AS VARCHAR) AS two_reference, {_K} % 6 > 0 AS two_valid FROM events""")
def verdict_reversal(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, d, "events").select("event_id", (k % 6 - 1).cast("string").alias("v"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").otherwise("Tie").alias("l"), (k % 11).cast("string").alias("t"), (k % 6 - 3).cast("string").alias("w"))
    two, ver2 = F.col("w"), "preference_5score_ver2"
    return rows.select("event_id", T.reverse_verdict(F.col("v"), "preference_5score").alias("five"), T.reverse_verdict(F.col("l"), "preference_ternary").alias("letter"), T.reverse_verdict(F.col("t"), "preference_score").alias("ten"), T.reverse_verdict(F.col("v"), "preference_5score", "reference").alias("five_reference"), T.reverse_verdict(two, ver2).alias("two"), T.reverse_verdict(two, ver2, "reference").alias("two_reference"), T.is_valid(two, ver2, -2).alias("two_valid"))


@query(f"""SELECT event_id, CASE WHEN {_K} % 3 = 2 THEN NULL ELSE CAST({_K} AS VARCHAR) END AS verdict, '{{"explanation":"' || event_type || '", "verdict":' AS repaired,
CASE WHEN {_K} % 2 = 0 THEN 'A' ELSE 'B' END AS letter, event_type AS tail FROM events""")
def json_answers(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events").select("event_id", "event_type", k.alias("k"))
    answer = F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"explanation":"x","verdict":'), F.col("k").cast("string"), F.lit("}"))).when(F.col("k") % 3 == 1, F.concat(F.lit('{"verdict":"'), F.col("k").cast("string"), F.lit('"}'))).otherwise('{"explanation":"x","verd')
    head = F.concat(F.lit('{"explanation":"'), "event_type")
    cut = F.when(F.col("k") % 4 == 0, F.concat(head, F.lit('" , " '))).when(F.col("k") % 4 == 1, F.concat(head, F.lit('", '))).when(F.col("k") % 4 == 2, F.concat(head, F.lit('" '))).otherwise(head)
    letter = F.when(F.col("k") % 2 == 0, " a ").otherwise("B")
    return e.select("event_id", T.json_verdict(answer).alias("verdict"), T.repair_json(cut).alias("repaired"), T.letter_verdict(letter).alias("letter"), T.after_thinking(F.concat(F.lit("<think>no</think> "), "event_type")).alias("tail"))


@query("SELECT conv_id, turn, 'In {0}: ' || text || ' / {check}' AS filled, role AS message_role, CAST(floor(length(text) / 4) AS BIGINT) AS approx_tokens FROM conversations")
def templates_and_messages(spark, d):
    rows = table(spark, d, "conversations")
    chat = T.messages(user=F.when(F.col("role") == "user", F.col("text")), assistant=F.when(F.col("role") != "user", F.col("text")))
    role = F.when(F.get(chat, F.lit(0))["role"] == "assistant", F.col("role")).otherwise(F.get(chat, F.lit(0))["role"])
    filled = T.fill_template("In {{0}}: {prompt} / {check}", prompt=F.col("text"), check=F.lit("{check}"))
    return rows.select("conv_id", "turn", filled.alias("filled"), role.alias("message_role"), T.fallback_length(F.col("text")).cast("long").alias("approx_tokens"))


@query(f"SELECT p_partkey, p_name AS chosen, p_type AS rejected, CASE WHEN {_H.format('p_partkey')} % 2 = 0 THEN p_name ELSE p_type END AS response_0, CASE WHEN {_H.format('p_partkey')} % 2 = 0 THEN p_type ELSE p_name END AS response_1 FROM part")
def random_swap(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("chosen"), F.col("p_type").alias("rejected"))
    return judging.swap_at_random(rows, "p_partkey", "chosen", "rejected")


# -- agreement ----------------------------------------------------------------------

#: Kendall's coefficient by the bits of y's ranks: of places that agree in all higher bits, ones before zeros are inverted.
INVERSIONS_SQL = """WITH e AS (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {source}), k AS (SELECT x, y, row_number() OVER (ORDER BY x, y) AS i, dense_rank() OVER (ORDER BY y) - 1 AS r FROM e WHERE x IS NOT NULL AND y IS NOT NULL),
b AS (SELECT i, r, level, (r >> level) & 1 AS bit FROM k, range(28) t(level)), o AS (SELECT bit, sum(bit) OVER (PARTITION BY level, r >> (level + 1) ORDER BY i ROWS UNBOUNDED PRECEDING) AS ones FROM b),
dis AS (SELECT coalesce(sum(ones), 0) AS d FROM o WHERE bit = 0), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM k),
tx AS (SELECT sum(t * (t - 1) / 2) AS t, sum(t * (t - 1) * (2 * t + 5)) AS u, sum(t * (t - 1) * (t - 2)) AS v FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM k GROUP BY x)),
ty AS (SELECT sum(t * (t - 1) / 2) AS t, sum(t * (t - 1) * (2 * t + 5)) AS u, sum(t * (t - 1) * (t - 2)) AS v FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM k GROUP BY y)),
txy AS (SELECT sum(t * (t - 1) / 2) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM k GROUP BY x, y)),
s AS (SELECT n, n * (n - 1) / 2 AS n0, n * (n - 1) / 2 - tx.t - ty.t + txy.t - 2 * CAST(d AS DOUBLE) AS s FROM n, tx, ty, txy, dis),
z AS (SELECT CAST(n AS BIGINT) AS n, s, s / sqrt((n0 - tx.t) * (n0 - ty.t)) AS tau, s / sqrt((n * (n - 1) * (2 * n + 5) - tx.u - ty.u) / 18 + 2 * tx.t * ty.t / (n * (n - 1)) + tx.v * ty.v / (9 * n * (n - 1) * (n - 2))) AS z FROM s, tx, ty)"""


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def pearson_by_group(spark, d):
    return rounded(agreement.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), "r")


@query(f"""WITH e AS (SELECT value AS x, {_K} AS y FROM events), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM e)
SELECT round(corr(rx, ry), 6) AS r, count(*) AS n FROM r""")
def spearman(spark, d):
    rows = table(spark, d, "events").select(F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("int").alias("y"))
    return rounded(agreement.spearman(rows, "x", "y"), "r")


@query(sql_with("v_judge") + """, p AS (SELECT verdict AS x, CASE letter WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.0 ELSE 0.5 END AS y FROM v_judge), c AS (SELECT x, y, count(*) AS c FROM p GROUP BY ALL),
s AS (SELECT sum(sign((a.x - b.x) * (a.y - b.y)) * a.c * b.c) / 2.0 AS s FROM c a, c b), n AS (SELECT sum(c) AS n, sum(c) * (sum(c) - 1) / 2.0 AS n0 FROM c),
tx AS (SELECT sum(t * (t - 1) / 2.0) AS t FROM (SELECT sum(c) AS t FROM c GROUP BY x)), ty AS (SELECT sum(t * (t - 1) / 2.0) AS t FROM (SELECT sum(c) AS t FROM c GROUP BY y))
SELECT round(s / sqrt((n0 - tx.t) * (n0 - ty.t)), 6) AS tau, CAST(n AS BIGINT) AS n, CAST(s AS DOUBLE) AS s FROM s, n, tx, ty""")
def kendall(spark, d):
    rows = view(spark, d, "v_judge").select("verdict", X.label_number(F.col("letter")).alias("y"))
    return rounded(agreement.kendall(rows, "verdict", "y").drop("z"), "tau")


@query(f"""{INVERSIONS_SQL.format(x='l_extendedprice', y='l_extendedprice * (1 - l_discount) * (1 + l_tax)', source='lineitem')} SELECT round(tau, 6) AS tau, n, s, round(z, 4) AS z FROM z""")
def kendall_continuous(spark, d):
    """Prices before and after discount and tax: both sides of very many values."""
    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("x"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("y"))
    return rounded(rounded(agreement.kendall_values(rows, "x", "y"), "tau"), "z", digits=4)


@query(f"""{INVERSIONS_SQL.format(x='l_extendedprice', y='l_discount', source='lineitem')} SELECT round(tau, 6) AS tau, n, s, round(z, 6) AS z FROM z""")
def kendall_tied(spark, d):
    """One side of eleven levels, of which each holds a tenth of the rows."""
    return rounded(agreement.kendall_values(table(spark, d, "lineitem"), "l_extendedprice", "l_discount"), "tau", "z")


@query(sql_with("v_rewards") + """, k AS (SELECT prompt_id, corr(r0, r1) AS r, stddev_pop(r0) AS s, stddev_pop(r1) AS t FROM v_rewards GROUP BY prompt_id HAVING count(*) >= 2)
SELECT round(avg(CASE WHEN s > 1e-9 AND t > 1e-9 THEN r END), 5) AS mean_r, count(*) AS arrays FROM k""")
def mean_array_correlation(spark, d):
    rows = view(spark, d, "v_packed")
    return rounded(agreement.mean_of_array_correlations(rows, "a0", "a1", "prompt_id", keep_nan=False), "mean_r", digits=5)


#: Columns of lines, and others made of their keys.
_WIDE = {c: c for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")} | {f"k{i}": f"CAST((l_orderkey * {i} + l_partkey) % {97 + i} AS DOUBLE)" for i in range(1, 21)} | {"gap": "CASE WHEN l_linenumber > 2 THEN l_tax + l_discount END"}


@query(f"""WITH w AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _WIDE.items())} FROM lineitem), m AS (SELECT count(*) AS n, [{", ".join(f"{{'a': '{a}', 'b': '{b}', 'r': {'1.0' if a == b else f'corr({a}, {b})'}}}" for a in _WIDE for b in _WIDE)}] AS l FROM w), u AS (SELECT n, unnest(l) AS x FROM m)
SELECT x.a AS a, x.b AS b, round(x.r, 6) + 0.0 AS r, n FROM u""")
def correlation_wide(spark, d):
    """More columns than one aggregate takes, one of them with nulls."""
    rows = table(spark, d, "lineitem").select(*[F.expr(e).alias(c) for c, e in _WIDE.items()])
    return rounded(agreement.correlation_matrix(rows, list(_WIDE)), "r")


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {'1.0' if a == b else f'round(corr({a}, {b}), 6)'} AS r, count(*) AS n FROM lineitem" for a in _COLS for b in _COLS))
def correlation_matrix(spark, d):
    return rounded(agreement.correlation_matrix(table(spark, d, "lineitem"), _COLS), "r")


@query(sql_with("v_packed") + """, l AS (SELECT flatten(list(a0 ORDER BY prompt_id)) AS x, flatten(list(a1 ORDER BY prompt_id)) AS y FROM v_packed),
p AS (SELECT unnest(x) AS x, unnest(y) AS y FROM l) SELECT round(corr(x, y), 6) AS r, count(*) AS n FROM p""")
def flattened_correlation(spark, d):
    rows = ordered.written(view(spark, d, "v_packed").select("prompt_id", "a0", "a1"), "packed")  # each side reads them three times
    side = lambda c: rows.select("prompt_id", F.col(c).alias("scores"))
    return rounded(agreement.pearson(agreement.flattened(side("a0"), side("a1"), "scores", "prompt_id"), "x", "y"), "r")


@query("""WITH c AS (SELECT l_linestatus, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem GROUP BY l_linestatus)
SELECT l_linestatus, round(r, 6) AS r, n, CASE WHEN abs(r) >= 0.9 THEN 'very strong' WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' WHEN abs(r) >= 0.3 THEN 'weak' ELSE 'very weak' END AS strength,
CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM c""")
def correlation_words(spark, d):
    rows = agreement.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_linestatus"])
    return rounded(agreement.described(rows).drop("p", "significance"), "r")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount * 10, 6) AS x, greatest(0.0, least(1.0, ceil(4 * l_discount * 10 - 0.5) / 4)) AS quarter, CASE WHEN l_linenumber < 2 THEN 0 WHEN l_linenumber = 2 THEN 2 ELSE 4 END AS ternary,
CAST(sign(l_linenumber - 2) AS INTEGER) AS ternary_sign, l_linenumber / 4.0 AS digit, round(1 / (1 + exp(l_tax - l_discount)), 6) AS btl, round(ln(l_discount * 0.5 + 0.2) - ln(1 - (l_discount * 0.5 + 0.2)), 6) AS logit FROM lineitem""")
def scalar_maps(spark, d):
    rows = table(spark, d, "lineitem")
    x = F.col("l_discount") * 10
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(x, 6).alias("x"), X.nearest_quarter(4 * x / 4).alias("quarter"), X.ternary(F.col("l_linenumber")).alias("ternary"), X.ternary_sign(F.col("l_linenumber")).alias("ternary_sign"), X.digit_preference(F.col("l_linenumber")).alias("digit"), F.round(X.logistic(F.col("l_discount"), F.col("l_tax")), 6).alias("btl"), F.round(X.logit(F.col("l_discount") * 0.5 + 0.2), 6).alias("logit"))


@query(sql_with("v_packed") + """SELECT prompt_id, round(list_sum(list_transform(list_zip(a0, a1), lambda p: 1 / (1 + exp(-(p[1] - p[2]))))), 5) AS bt_mean, round(list_sum(list_transform(list_zip(a0, a1), lambda p: 1 / (1 + exp(-25 * (p[1] - p[2]))))), 5) AS bt_majority,
round(list_sum(list_transform(list_zip(a0, a1), lambda p: p[1] - p[2])), 5) + 0.0 AS difference FROM v_packed""")
def array_scores(spark, d):
    a, b = F.col("a0"), F.col("a1")
    rows = view(spark, d, "v_packed").select("prompt_id", A.total(X.bradley_terry(a, b, 1.0)).alias("bt_mean"), A.total(X.bradley_terry(a, b, 25.0)).alias("bt_majority"), A.total(X.differences(a, b)).alias("difference"))
    return rounded(rows, "bt_mean", "bt_majority", "difference", digits=5)


# -- consistency -----------------------------------------------------------------------

_RULE = "CASE WHEN ab = 0.5 THEN bc <> ac WHEN bc = 0.5 THEN ab <> ac WHEN ac = 0.5 THEN ab <> 1 - bc ELSE ab = bc AND ac <> ab END"


def _intransitive_sql(bc: str, ac: str) -> str:
    return sql_with("v_prefs3") + f", r AS (SELECT p01 AS ab, {bc} AS bc, {ac} AS ac FROM v_prefs3), v AS (SELECT {_RULE} AS v FROM r) SELECT round(avg(CAST(v AS INTEGER)), 6) AS ratio, CAST(sum(CAST(v AS INTEGER)) AS BIGINT) AS violations, count(*) AS n FROM v"


@query(_intransitive_sql("p12", "p02"))
def intransitivity(spark, d):
    return rounded(consistency.intransitivity(view(spark, d, "v_prefs3").withColumns({c: F.col(c).cast("double") for c in ("p01", "p02", "p12")})), "ratio")


@query(_intransitive_sql("p02", "p12"))
def intransitivity_reference(spark, d):
    return rounded(consistency.intransitivity(view(spark, d, "v_prefs3").withColumns({c: F.col(c).cast("double") for c in ("p01", "p02", "p12")}), "reference"), "ratio")


def _sntd_sql() -> str:
    c = lambda x: f"greatest(1e-10, least(1 - 1e-10, {x}))"
    js = " + ".join(f"0.5 * (p{i} / sp{i} * ln((p{i} / sp{i}) / ((p{i} / sp{i} + q{i} / sq{i}) / 2)) + q{i} / sq{i} * ln((q{i} / sq{i}) / ((p{i} / sp{i} + q{i} / sq{i}) / 2)))" for i in range(3))
    return sql_with("v_prefs3") + f""", c AS (SELECT {c('p01')} AS ab, {c('p12')} AS bc, {c('p02')} AS ac FROM v_prefs3), s AS (SELECT *, ln(ab / (1 - ab)) AS sab, ln(bc / (1 - bc)) AS sbc, ln(ac / (1 - ac)) AS sac FROM c),
r AS (SELECT ab AS p0, bc AS p1, ac AS p2, 1 / (1 + exp(-(sac - sbc))) AS q0, 1 / (1 + exp(-(sac - sab))) AS q1, 1 / (1 + exp(-(sab + sbc))) AS q2 FROM s),
t AS (SELECT {", ".join(f"sum({k}{i}) AS s{k}{i}" for k in "pq" for i in range(3))} FROM r) SELECT round(sum({js}) / 3, 6) AS sntd FROM r, t"""


@query(_sntd_sql())
def sntd(spark, d):
    return rounded(consistency.sntd(view(spark, d, "v_prefs3").withColumns({c: F.col(c).cast("double") for c in ("p01", "p02", "p12")})), "sntd")


#: The models that are compared, in their order.
_TYPES = ["view", "click", "purchase", "error", "signup"]


def _pairs_of(spark, d, n: int) -> DataFrame:
    """jid, i, j, p: which of two event types a user has more of among the events that fall to this pair."""
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    count = lambda k, i, j: F.count_if((F.col("event_type") == _TYPES[k]) & (F.col("event_id") % 5 == (i + j) % 5))
    sums = table(spark, d, "events").groupBy(F.col("user_id").alias("jid")).agg(*[count(k, i, j).alias(f"c{i}{j}{k}") for i, j in pairs for k in (i, j)])
    p = lambda i, j: (F.signum(F.col(f"c{i}{j}{i}") - F.col(f"c{i}{j}{j}")) + 1) / 2
    return sums.select("jid", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), p(i, j).alias("p")) for i, j in pairs])).alias("x")).select("jid", "x.i", "x.j", "x.p")


def _cycles_sql(n: int) -> str:
    count = lambda k, i, j: f"count(*) FILTER (WHERE event_type = '{_TYPES[k]}' AND event_id % 5 = {(i + j) % 5})"
    one = lambda i, j: f"SELECT user_id AS jid, {i} AS i, {j} AS j, (sign({count(i, i, j)} - {count(j, i, j)}) + 1) / 2.0 AS p FROM events GROUP BY user_id"
    return f"""WITH RECURSIVE u AS (SELECT DISTINCT user_id AS jid FROM events), p AS ({" UNION ALL ".join(one(i, j) for i in range(n) for j in range(i + 1, n))}),
f AS (SELECT jid, i, j, p FROM p UNION ALL SELECT jid, j, i, 1 - p FROM p),
tied AS (SELECT jid, k AS i, k AS j FROM u, range({n}) r(k) UNION SELECT t.jid, t.i, f.j FROM tied t JOIN f ON f.jid = t.jid AND f.i = t.j AND f.p = 0.5),
rep AS (SELECT jid, i, min(j) AS g FROM tied GROUP BY ALL),
e AS (SELECT DISTINCT f.jid, a.g AS src, b.g AS dst FROM f JOIN rep a ON a.jid = f.jid AND a.i = f.i JOIN rep b ON b.jid = f.jid AND b.i = f.j WHERE f.p > 0.5),
w AS (SELECT jid, src AS start, dst AS cur, [src, dst] AS path, src = dst AS closed FROM e WHERE dst >= src
 UNION ALL SELECT w.jid, w.start, e.dst, list_append(w.path, e.dst), e.dst = w.start FROM w JOIN e ON e.jid = w.jid AND e.src = w.cur WHERE NOT w.closed AND e.dst >= w.start AND (e.dst = w.start OR NOT list_contains(w.path, e.dst))),
c AS (SELECT jid, count(*) AS c FROM w WHERE closed GROUP BY jid),
dom AS (SELECT jid, count(*) FILTER (WHERE ok) AS d FROM (SELECT jid, i, bool_and(p >= 0.5) AS ok FROM f GROUP BY ALL) GROUP BY jid),
b AS (SELECT u.jid, coalesce(c, 0) AS c, d FROM u LEFT JOIN c USING (jid) JOIN dom USING (jid))
SELECT {n} AS n_response, count(*) AS total_judgments, CAST(sum(c) AS BIGINT) AS total_cycles, round(avg(c), 6) AS avg_cycles, CAST(count_if(c > 0) AS BIGINT) AS judgments_with_cycles, round(100.0 * count_if(c > 0) / count(*), 6) AS intransitivity_percentage,
CAST(count_if(d = 0) AS BIGINT) AS no_dominant, CAST(count_if(d = 1) AS BIGINT) AS one_dominant, CAST(count_if(d > 1) AS BIGINT) AS multiple_dominant, round(avg(d), 6) AS avg_dominant FROM b"""


@query(_cycles_sql(5))
def cycle_report(spark, d):
    return rounded(consistency.cycle_report(_pairs_of(spark, d, 5), 5), "avg_cycles", "intransitivity_percentage", "avg_dominant")


@query(" UNION ALL ".join(f"({_cycles_sql(n)})" for n in (2, 3, 4, 5)))
def cycle_sweep(spark, d):
    return rounded(consistency.sweep(_pairs_of(spark, d, 5), 5), "avg_cycles", "intransitivity_percentage", "avg_dominant")


# -- sequences -----------------------------------------------------------------------------


@query(sql_with("v_tokens") + """, k AS (SELECT doc_id, tok, coalesce(list_position(tok, 4) - 1, len(tok)) AS k FROM v_tokens), t AS (SELECT doc_id, tok, k, list_transform(tok, lambda x, i: CASE WHEN i - 1 > k THEN 0 ELSE x END) AS cut FROM k)
SELECT doc_id, CAST(k AS INTEGER) AS first_eos, CAST(list_sum(cut) AS BIGINT) AS kept, CAST(coalesce(list_position(cut, 0) - 2, len(cut) - 1) AS INTEGER) AS length, CAST(coalesce(list_position(cut, 0) - 2, -1) AS INTEGER) AS reward_at,
CAST(list_sum(tok[2:]) AS BIGINT) AS shifted, CAST(coalesce(list_position(cut[3:], 0) - 1, greatest(0, len(cut) - 2)) + 1 AS INTEGER) AS last_after_two FROM t WHERE len(tok) >= 2""")
def truncation(spark, d):
    rows = view(spark, d, "v_tokens").where(F.size("tok") >= 2).select("doc_id", "tok", S.truncate_after(F.col("tok"), 4, 0).alias("cut"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("doc_id", S.first_true(F.col("tok"), 4).alias("first_eos"), total(F.col("cut")).alias("kept"), S.sequence_length(F.col("cut"), 0).alias("length"), S.reward_position(F.col("cut"), 0).alias("reward_at"), total(S.shift_labels(F.col("tok"))).alias("shifted"), S.last_token(F.col("cut"), F.lit(2), 0).alias("last_after_two"))


@query(sql_with("v_tokens") + """SELECT doc_id, CAST(greatest(64, len(tok)) AS INTEGER) AS padded, CAST(CASE WHEN len(tok) < 64 THEN 0 ELSE tok[1] END AS INTEGER) AS left_first, CAST(CASE WHEN len(tok) < 64 THEN 0 ELSE tok[len(tok)] END AS INTEGER) AS right_last,
CAST(tok[greatest(1, len(tok) - 9)] AS INTEGER) AS tail_first FROM v_tokens WHERE len(tok) > 0""")
def padding(spark, d):
    t = F.col("tok")
    rows = view(spark, d, "v_tokens").where(F.size(t) > 0)
    return rows.select("doc_id", F.size(S.pad_left(t, 64, 0)).alias("padded"), F.get(S.pad_left(t, 64, 0), F.lit(0)).alias("left_first"), F.element_at(S.pad_right(t, 64, 0), -1).alias("right_last"), F.get(T.keep_right(t, 10), F.lit(0)).alias("tail_first"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT vec_id, e, list_max(e) AS m FROM e)
SELECT vec_id, round(list_sum(e[1:9]), 5) AS masked, round(e[4] - m - ln(list_sum(list_transform(e, lambda x: exp(x - m)))), 5) AS log_softmax,
round(m + ln(list_sum(list_transform(e, lambda x: exp(x - m)))) - list_sum(list_transform(e, lambda x: x * exp(x - m))) / list_sum(list_transform(e, lambda x: exp(x - m))), 5) AS entropy,
round(1.0 - 0.05 * list_sum(list_transform(list_zip(e[1:8], e[9:16]), lambda p: p[1] - p[2])), 5) AS shaped FROM s""")
def log_probabilities(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", doubles("embedding").alias("e"))
    e = F.col("e")
    out = rows.select("vec_id", S.masked_sum(e, F.lit(8)).alias("masked"), S.log_softmax_at(e, F.lit(3)).alias("log_softmax"), S.entropy(e).alias("entropy"), S.shaped(F.lit(1.0), A.total(S.kl(F.slice(e, 1, 8), F.slice(e, 9, 8))), 0.05).alias("shaped"))
    return rounded(out, "masked", "log_softmax", "entropy", "shaped", digits=5)


def _gae_sql() -> str:
    r, v = "(-0.05 * e[{0}] + CASE WHEN {0} = 8 THEN 1.0 ELSE 0 END)", "e[{0} + 8]"
    delta = lambda t: f"({r.format(t)} + {v.format(t + 1) if t < 8 else '0.0'} - {v.format(t)})"
    a = lambda t: " + ".join(f"{0.95 ** k!r} * {delta(t + k)}" for k in range(9 - t))
    return f"WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, round({a(1)}, 5) AS first, round({a(8)}, 5) AS last, round({a(1)} + e[9], 5) AS first_return FROM e"


@query(_gae_sql())
def advantages(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", doubles("embedding").alias("e"))
    rows = rows.select("vec_id", F.slice("e", 9, 8).alias("v"), S.terminal_rewards(F.slice("e", 1, 8), F.lit(1.0), F.lit(7), 0.05).alias("r"))
    rows = rows.select("vec_id", "v", S.gae(F.col("r"), F.col("v")).alias("a"))
    return rounded(rows.select("vec_id", F.get("a", F.lit(0)).alias("first"), F.get("a", F.lit(7)).alias("last"), (F.get("a", F.lit(0)) + F.get("v", F.lit(0))).alias("first_return")), "first", "last", "first_return", digits=5)


@query("SELECT o_orderkey, round((o_totalprice - m) / sqrt(v + 1e-8), 5) AS whitened FROM orders, (SELECT avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders)")
def whitening(spark, d):
    return rounded(relational.score_groups(table(spark, d, "orders"), "o_totalprice").select("o_orderkey", "whitened"), "whitened", digits=5)


@query("""WITH r AS (SELECT l_returnflag AS k, l_discount AS c, l_tax AS r, l_quantity / 50 AS g, l_discount - l_tax AS dl, exp(l_discount - l_tax) AS ratio, l_quantity / 25 - 1 AS adv FROM lineitem)
SELECT k, round(avg((c - r - 0.5 * g) ** 2), 6) AS regression, round(avg(greatest(-dl, 0) + ln(1 + exp(-abs(dl)))), 6) AS ranking, round(avg(CASE WHEN dl > 0 THEN 1.0 ELSE 0 END), 6) AS accuracy, round(0.5 * avg(dl * dl), 8) AS approx_kl, round(avg(ratio), 6) AS mean_ratio,
round(avg(greatest(-adv * ratio, -adv * greatest(0.95, least(1.05, ratio)))), 6) AS policy_loss, round(avg(CASE WHEN abs(ratio - 1) > 0.05 THEN 1.0 ELSE 0 END), 6) AS clip_fraction,
round(avg(greatest((c - g) ** 2, (greatest(r - 0.02, least(r + 0.02, c)) - g) ** 2)), 6) AS value_loss FROM r GROUP BY k""")
def losses(spark, d):
    c, r, g = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), c.alias("c"), r.alias("r"), g.alias("g"), (c - r).alias("dl"), F.exp(c - r).alias("ratio"), (F.col("l_quantity") / 25 - 1).alias("adv"))
    dl, ratio = F.col("dl"), F.col("ratio")
    out = rows.groupBy("k").agg(F.avg(S.regression_loss(F.col("c"), F.col("r"), F.col("g"), 0.5)).alias("regression"), F.avg(S.ranking_loss(dl)).alias("ranking"), F.avg((dl > 0).cast("double")).alias("accuracy"), S.approx_kl(dl).alias("approx_kl"), F.avg(ratio).alias("mean_ratio"), F.avg(S.clipped_policy_loss(F.col("adv"), ratio, 0.05)).alias("policy_loss"), F.avg((F.abs(ratio - 1) > 0.05).cast("double")).alias("clip_fraction"), F.avg(S.clipped_value_loss(F.col("c"), F.col("r"), F.col("g"), 0.02)).alias("value_loss"))
    return rounded(rounded(out, "regression", "ranking", "accuracy", "mean_ratio", "policy_loss", "clip_fraction", "value_loss"), "approx_kl", digits=8)


@query(sql_with("v_tokens") + ", k AS (SELECT doc_id, list_filter(tok, lambda x: x <> 3) AS t FROM v_tokens WHERE len(tok) > 0) SELECT doc_id, CASE WHEN len(t) > 0 THEN round(list_sum(list_transform(t, lambda x: x / 10.0)) / len(t), 6) END AS loss FROM k")
def masked_cross_entropy(spark, d):
    rows = view(spark, d, "v_tokens").where(F.size("tok") > 0)
    lp = F.transform("tok", lambda x: -x / 10.0)
    return rounded(rows.select("doc_id", S.masked_cross_entropy(lp, F.col("tok"), 3).alias("loss")), "loss")


@query(sql_with("v_packed") + """SELECT prompt_id, round(list_reduce(list_transform(a0, lambda k: 1 + greatest(-0.2, least(0.2, k / 0.5 - 1)) * 32 / 1000), lambda x, y: x * y, CAST(0.05 AS DOUBLE)), 8) AS coefficient FROM v_packed""")
def adaptive_kl(spark, d):
    return rounded(view(spark, d, "v_packed").select("prompt_id", S.adaptive_kl(F.col("a0"), 0.05, 0.5, 1000.0, 32.0).alias("coefficient")), "coefficient", digits=8)


@query("""WITH f AS (SELECT o_orderkey, o_orderdate, 1 + greatest(-0.2, least(0.2, o_totalprice / 240000 - 1)) * 0.05 AS f FROM orders)
SELECT o_orderkey, round(0.05 * product(f) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 7) AS coefficient FROM f""")
def running_coefficient(spark, d):
    """The adaptive coefficient after each order, by date: the fold runs over the rows of the whole table."""
    rows = table(spark, d, "orders").withColumn("kl", F.col("o_totalprice"))
    out = ordered.adaptive_coefficient(rows, "kl", ["o_orderdate", "o_orderkey"], "coefficient", 0.05, 240000.0, 1000.0, 50.0)
    return rounded(out.select("o_orderkey", "coefficient"), "coefficient", digits=7)


@query("""SELECT o_orderkey, round(CASE WHEN o_orderkey < 100 THEN o_orderkey / 100 ELSE greatest(0.0, 0.5 * (1 + cos(3.141592653589793 * (o_orderkey - 100) / 19900))) END, 6) AS cosine, round(1 - (o_orderkey - 1) / 20000, 6) AS linear,
CAST((o_orderkey % 8) * (o_custkey // 8) + least(o_orderkey % 8, o_custkey % 8) AS BIGINT) AS shard_start, CAST(o_orderkey AS BIGINT) AS exact, round(o_totalprice / 30 + 0.1, 4) AS rescaled FROM orders""")
def schedules_and_shards(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", F.round(X.cosine_with_warmup(k, 100, 20000), 6).alias("cosine"), F.round(X.linear_decay(k, 20000), 6).alias("linear"), X.shard_bound(k % 8, F.col("o_custkey"), 8).cast("long").alias("shard_start"), X.exact_div(k * 4, F.lit(4)).cast("long").alias("exact"), F.round(X.rescale(F.col("o_totalprice")), 4).alias("rescaled"))


@query(sql_with("v_packed") + "SELECT prompt_id, CASE WHEN list_contains(a1, 0.0) THEN list_max(a0) ELSE -1.0 END AS score FROM v_packed")
def missing_end_penalty(spark, d):
    return view(spark, d, "v_packed").select("prompt_id", S.contains_penalty(F.col("a1"), 0.0, F.array_max("a0"), -1.0).alias("score"))


# -- rows, joins, text ------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def row_range(spark, d):
    return relational.row_range(table(spark, d, "orders"), "o_orderkey", 100, 200).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus, CAST(list_position([3, 9, 27, 81, 243], o_orderkey) - 1 AS INTEGER) AS pos FROM orders WHERE o_orderkey IN (3, 9, 27, 81, 243)")
def positional_pick(spark, d):
    return relational.pick(table(spark, d, "orders"), "o_orderkey", [3, 9, 27, 81, 243]).select("o_orderkey", "o_orderstatus", F.col("pos").cast("int").alias("pos"))


@query("SELECT CASE event_type WHEN 'view' THEN 'Base' ELSE 'Ours' END AS event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def relabelled(spark, d):
    return relational.relabel(table(spark, d, "events"), "event_type", {"view": "Base", "click": "Ours", "error": None}).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def reassembled(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return relational.reassemble(table(spark, d, "documents").select("doc_id"), labels, "doc_id", "quality")


@query(sql_with("v_tokens") + "SELECT doc_id FROM v_tokens WHERE len(tok) = 200")
def exact_length(spark, d):
    return view(spark, d, "v_tokens").where(F.size("tok") == 200).select("doc_id")


@query("SELECT url, list_last(string_split(url, '/')) AS short FROM pages")
def short_names(spark, d):
    return table(spark, d, "pages").select("url", T.short_name(F.col("url")).alias("short"))


@query(f"SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {_H.format('o_orderkey')}, o_orderkey) <= 1000 THEN 'test' ELSE 'train' END AS split FROM orders")
def exact_split(spark, d):
    return relational.split_exact(table(spark, d, "orders"), "o_orderkey", 1000).select("o_orderkey", "split")


@query(f"SELECT doc_id FROM documents ORDER BY {_H.format('doc_id')}, doc_id LIMIT 100")
def hash_sample(spark, d):
    return relational.sample(table(spark, d, "documents"), "doc_id", 100).select("doc_id")


@query(" UNION ALL ".join(f"SELECT o_orderkey, {e} AS epoch, CAST((row_number() OVER (ORDER BY {_H.format('o_orderkey').replace('|42', f'|{42 + e}')}, o_orderkey) - 1) // 64 AS INTEGER) AS batch_id FROM orders" for e in (0, 1)))
def shuffled_batches(spark, d):
    one = lambda e: relational.batches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 64, epoch=e).withColumn("epoch", F.lit(e))
    return one(0).unionByName(one(1))


_ROUGE_PAIRS = "SELECT conv_id, string_split(max(CASE WHEN turn = 0 THEN text END), ' ') AS a, string_split(max(CASE WHEN turn = 1 THEN text END), ' ') AS b FROM (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE turn < 2 GROUP BY ALL) GROUP BY conv_id HAVING count(*) = 2"


def _rouge_pairs(spark, d) -> DataFrame:
    turns = table(spark, d, "conversations").where("turn < 2").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    rows = turns.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("b"), F.count("*").alias("n"))
    return rows.where("n = 2").select("conv_id", F.split("a", " ").alias("a"), F.split("b", " ").alias("b"))


def _rouge_sql() -> str:
    parts = []
    for n in (1, 2):
        gram = lambda s: f"SELECT conv_id, array_to_string({s}[i:i + {n - 1}], ' ') AS g, count(*) AS n FROM p, range(1, 100000) u(i) WHERE i <= len({s}) - {n - 1} GROUP BY ALL"
        parts.append(f"a{n} AS ({gram('a')}), b{n} AS ({gram('b')}), m{n} AS (SELECT a{n}.conv_id, sum(least(a{n}.n, b{n}.n)) AS m FROM a{n} JOIN b{n} USING (conv_id, g) GROUP BY a{n}.conv_id)")
    score = lambda n: f"coalesce(round(2.0 * coalesce(m{n}.m, 0) / nullif(greatest(0, len(a) - {n - 1}) + greatest(0, len(b) - {n - 1}), 0), 6), 0.0) AS rouge{n}"
    return f"WITH p AS ({_ROUGE_PAIRS}), {', '.join(parts)} SELECT p.conv_id, {score(1)}, {score(2)} FROM p LEFT JOIN m1 USING (conv_id) LEFT JOIN m2 USING (conv_id)"


@query(_rouge_sql())
def rouge_ngrams(spark, d):
    rows = _rouge_pairs(spark, d)
    return rounded(rows.select("conv_id", T.rouge_n(F.col("a"), F.col("b"), 1).alias("rouge1"), T.rouge_n(F.col("a"), F.col("b"), 2).alias("rouge2")), "rouge1", "rouge2")


_ROW = "list_transform(m, lambda x, k: greatest(o[k], CASE WHEN x = 1 THEN coalesce(o[k - 1], 0) + 1 ELSE 0 END))"
#: Turns of a conversation and the ones after them, as the scorer cuts them.
_SCORER = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
_TURNS = f"SELECT t.conv_id, t.turn, {_SCORER.format('t.text')} AS a, {_SCORER.format('u.text')} AS b FROM c t JOIN c u ON u.conv_id = t.conv_id AND u.turn = t.turn + 1"


def _turn_pairs(spark, d) -> DataFrame:
    """conv_id, turn and the scorer's tokens of each turn and the next; of repeated turns the least text."""
    turns = table(spark, d, "conversations").where("text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", T.rouge_tokens(F.col("text")).alias("a"), T.rouge_tokens(F.col("next")).alias("b"))


def _turns_sql(tail: str) -> str:
    parts = []
    for n in (1, 2):
        gram = lambda s: f"SELECT conv_id, turn, array_to_string({s}[i:i + {n - 1}], ' ') AS g, count(*) AS n FROM p, range(1, 100000) u(i) WHERE i <= len({s}) - {n - 1} GROUP BY ALL"
        parts.append(f"a{n} AS ({gram('a')}), b{n} AS ({gram('b')}), m{n} AS (SELECT a{n}.conv_id, a{n}.turn, sum(least(a{n}.n, b{n}.n)) AS m FROM a{n} JOIN b{n} USING (conv_id, turn, g) GROUP BY ALL)")
    score = lambda n: f"coalesce(2.0 * coalesce(m{n}.m, 0) / nullif(greatest(0, len(a) - {n - 1}) + greatest(0, len(b) - {n - 1}), 0), 0.0) AS rouge{n}"
    return f"""WITH c AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL), p AS ({_TURNS}), {', '.join(parts)},
m AS (SELECT conv_id, turn, list_prepend(list_transform(b, lambda y: 0), list_transform(a, lambda w: list_transform(b, lambda y: CASE WHEN y = w THEN 1 ELSE 0 END))) AS rows FROM p WHERE len(b) > 0),
l AS (SELECT conv_id, turn, list_last(list_reduce(rows, lambda o, m: list_transform([{_ROW}], lambda c: list_transform(c, lambda x, k: list_max(c[1:k])))[1])) AS common FROM m),
s AS (SELECT p.conv_id, p.turn, {score(1)}, {score(2)}, coalesce(2.0 * common / nullif(len(a) + len(b), 0), 0.0) AS rouge_l FROM p LEFT JOIN m1 USING (conv_id, turn) LEFT JOIN m2 USING (conv_id, turn) LEFT JOIN l USING (conv_id, turn)) {tail}"""


@query(f"""WITH p AS ({_ROUGE_PAIRS}), m AS (SELECT conv_id, a, b, list_prepend(list_transform(b, lambda y: 0), list_transform(a, lambda w: list_transform(b, lambda y: CASE WHEN y = w THEN 1 ELSE 0 END))) AS rows FROM p),
l AS (SELECT conv_id, a, b, list_last(list_reduce(rows, lambda o, m: list_transform([{_ROW}], lambda c: list_transform(c, lambda x, k: list_max(c[1:k])))[1])) AS common FROM m)
SELECT conv_id, round(2.0 * common / (len(a) + len(b)), 6) AS rouge_l FROM l""")
def rouge_longest(spark, d):
    return rounded(_rouge_pairs(spark, d).select("conv_id", T.rouge_l("a", "b").alias("rouge_l")), "rouge_l")


@query(_turns_sql("SELECT conv_id, turn, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round(rouge_l, 6) AS rouge_l FROM s"))
def rouge_turns(spark, d):
    """Each turn against the one after it."""
    return rounded(_turn_pairs(spark, d).select("conv_id", "turn", *T.rouge(F.col("a"), F.col("b"))), "rouge1", "rouge2", "rouge_l")


@query(_turns_sql("SELECT count(*) AS n, round(avg(rouge1), 6) AS rouge1, round(avg(rouge2), 6) AS rouge2, round(avg(rouge_l), 6) AS rouge_l FROM s"))
def rouge_means(spark, d):
    """The three scores over all pairs of turns, as a trainer reports them."""
    scores = _turn_pairs(spark, d).select(*T.rouge(F.col("a"), F.col("b")))
    return rounded(scores.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in scores.columns]), "rouge1", "rouge2", "rouge_l")


from tessera.plans import layout  # noqa: E402, F401  some of its queries have the SQL of those above
