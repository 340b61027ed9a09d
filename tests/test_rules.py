"""Rules of single operators by hand-made cases."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import scalar as X
from tessera.functions import sequences as S
from tessera.functions import text as T
from tessera.operators import agreement, consistency, evaluation, inference, judging, relational
from tessera.sources import io


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_arg_max_takes_the_first(spark):
    got = values(spark, [([1.0, 3.0, 3.0],), ([2.0, 2.0],), ([],), (None,)], "a array<double>", A.arg_max(F.col("a")), A.arg_min(F.col("a")))
    assert got == [(1, 0), (0, 0), (None, None), (None, None)]


def test_majority(spark):
    cases = {"A": ["A", "Tie"], "Tie": ["A", "B"], "x": ["x"], "three": ["A", "B", "Tie"], "B": ["B", "B", "Tie", "Tie"]}
    rows = [(k, v) for k, vs in cases.items() for v in vs]
    got = {r["k"]: r["m"] for r in spark.createDataFrame(rows, "k string, v string").groupBy("k").agg(judging.majority_label(F.col("v")).alias("m")).collect()}
    assert got == {"A": "A", "Tie": "Tie", "x": "Tie", "three": "Tie", "B": "B"}
    empty = spark.createDataFrame([], "v string").agg(judging.majority_label(F.col("v")).alias("m")).first()["m"]
    assert empty is None


def test_numeric_mode(spark):
    rows = [([1, 1, 3, 3],), ([0, 0, 2, 2, 4, 4],), ([3, 1, 1, 3],), ([],)]
    got = values(spark, rows, "a array<int>", judging.numeric_mode(F.col("a")), judging.numeric_mode(F.col("a"), "first"))
    assert got == [(3, 1), (2, 0), (3, 3), (None, None)]


@pytest.mark.parametrize("mode,minus", [("fixed", "-1"), ("reference", "5")])
def test_reversal(spark, mode, minus):
    got = values(spark, [("-1",), ("4",), ("0",)], "v string", T.reverse_verdict(F.col("v"), "preference_5score", mode))
    assert got == [(minus,), ("0",), ("4",)]
    got = values(spark, [("-3",), ("-2",), ("0",), ("2",)], "v string", T.reverse_verdict(F.col("v"), "preference_5score_ver2", mode), T.is_valid(F.col("v"), "preference_5score_ver2", -2))
    assert got == [("-3" if mode == "fixed" else "3", False), ("2", True), ("0", True), ("-2", True)]
    assert values(spark, [("A",), ("B",), ("?",)], "v string", T.reverse_verdict(F.col("v"), "preference_binary")) == [("B",), ("A",), ("Tie",)]


def test_validity_and_numbers(spark):
    rows = [(" 3 ",), ("3.0",), ("score: 3",), ("3/4",), ("a 2 b",), ("-1",), (None,)]
    got = values(spark, rows, "v string", T.is_valid(F.col("v"), "preference_5score"), T.edge_number(F.col("v")))
    assert got == [(True, "3"), (False, "3"), (False, "3"), (False, "3"), (False, None), (True, "-1"), (False, None)]


def test_json(spark):
    rows = [('{"explanation":"x","verdict":3}',), ('{"explanation":"x","verd',), ('{"a":1}',)]
    assert values(spark, rows, "v string", T.json_verdict(F.col("v"))) == [("3",), (None,), (None,)]
    rows = [('{"e":"x" , " ',), ('{"e":"x", ',), ('{"e":"x" ',), ('{"e":"x',)]
    assert values(spark, rows, "v string", T.repair_json(F.col("v"))) == [('{"e":"x", "verdict":',)] * 4


def test_requirements(spark):
    text = "1) has 2) inside (importance: 90/100)\n2) other (importance: 75/100)\n7) not an item (importance: 1/100)\n3) last"
    got = spark.createDataFrame([(text,), ("no list",)], "t string").select(T.requirements(F.col("t")).alias("r")).collect()
    assert [(x["check_idx"], x["check"], x["importance"]) for x in got[0]["r"]] == [(0, "has 2) inside", 90), (1, "other", 75), (2, "last", None)]
    assert got[1]["r"] == []


def test_template_is_filled_once(spark):
    got = values(spark, [("say {check}", "c")], "p string, c string", T.fill_template("{{x}} {prompt} {check}", prompt=F.col("p"), check=F.col("c")))
    assert got == [("{x} say {check} c",)]


def test_messages_need_text(spark):
    df = spark.createDataFrame([(None, None)], "a string, b string")
    with pytest.raises(PySparkException):
        df.select(T.messages(F.col("a"), F.col("b"))).collect()


def test_truncation(spark):
    rows = [([5, 9, 7],), ([9, 1, 1],), ([1, 2],)]
    cut = S.truncate_after(F.col("t"), 9, 0)
    assert values(spark, rows, "t array<int>", cut) == [([5, 9, 0],), ([9, 0, 0],), ([1, 2],)]
    assert values(spark, rows, "t array<int>", S.sequence_length(cut, 0), S.reward_position(cut, 0)) == [(1, 1), (0, 0), (1, -1)]


def test_soft_target_has_no_overflow(spark):
    got = values(spark, [(0.8, [0.75, 0.9])], "r double, p array<double>", A.soft_best_of_two(F.col("r"), F.col("p")), A.soft_best_of_two(F.col("r"), F.col("p"), plain=True))
    assert math.isclose(got[0][0], 2 / 2 * (0.8 + 0.9), rel_tol=1e-9) and math.isinf(got[0][1])
    low = values(spark, [(0.2, [0.1, 0.3])], "r double, p array<double>", A.soft_best_of_two(F.col("r"), F.col("p")), A.soft_best_of_two(F.col("r"), F.col("p"), plain=True))
    assert math.isclose(*low[0], rel_tol=1e-12)


def test_gae_by_hand(spark):
    r, v, lam = [0.1, -0.2, 1.0], [0.5, 0.4, 0.3], 0.95
    a, want = 0.0, []
    for t in (2, 1, 0):
        nxt = v[t + 1] if t < 2 else 0.0
        a = r[t] + nxt - v[t] + lam * a
        want.insert(0, a)
    got = values(spark, [(r, v)], "r array<double>, v array<double>", S.gae(F.col("r"), F.col("v")))[0][0]
    assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(got, want))


def test_maps(spark):
    rows = [(0.125,), (0.126,), (1.0,), (-3.0,)]
    assert values(spark, rows, "x double", X.nearest_quarter(F.col("x"))) == [(0.0,), (0.25,), (1.0,), (0.0,)]
    assert values(spark, [(0.95,), (-0.6,), (0.0,)], "r double", X.strength(F.col("r")), X.direction(F.col("r"))) == [("very strong", "positive"), ("moderate", "negative"), ("very weak", "negative")]
    with pytest.raises(PySparkException):
        spark.createDataFrame([(5, 2)], "a int, b int").select(X.exact_div(F.col("a"), F.col("b"))).collect()


def test_p_values():
    assert math.isclose(agreement.exact_kendall_p(5, 6), 0.23333333, rel_tol=1e-6)


def test_constant_side_gives_no_error(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert agreement.pearson(df, "x", "y").first()["r"] is None
    arrays = spark.createDataFrame([(0, [1.0, 1.0], [1.0, 2.0]), (1, [1.0, 2.0, 9.0], [2.0, 4.0]), (2, [1.0], [1.0])], "k int, x array<double>, y array<double>")
    assert math.isnan(agreement.mean_of_array_correlations(arrays, "x", "y", "k").first()["mean_r"])
    assert agreement.mean_of_array_correlations(arrays, "x", "y", "k", keep_nan=False).first()["mean_r"] == 1.0


def test_arrays_shift_when_flattened(spark):
    left = spark.createDataFrame([(0, [1, 2]), (1, [3])], "k int, s array<int>")
    right = spark.createDataFrame([(0, [1]), (1, [2, 3, 4])], "k int, s array<int>")
    assert sorted(map(tuple, agreement.flattened(left, right, "s", "k").collect())) == [(1, 1), (2, 2), (3, 3)]


def test_flattened_sides_are_not_collected(spark, small):
    """All prompts of the table, sides of different sizes, against plain lists; and no plan holds a side as one row."""
    from tessera.plans.views import view

    packed = view(spark, small, "v_packed").select("prompt_id", "a0", "a1")
    left, right = packed.select("prompt_id", F.col("a0").alias("s")), packed.where("prompt_id % 7 <> 3").select("prompt_id", F.col("a1").alias("s"))
    flat = lambda d: [v for r in sorted(d.collect(), key=lambda r: r["prompt_id"]) for v in r["s"]]
    out = agreement.flattened(left, right, "s", "prompt_id")
    assert sorted(map(tuple, out.collect())) == sorted(zip(flat(left), flat(right))) and out.count() > 4000
    assert "collect_list(struct(prompt_id" not in out._jdf.queryExecution().toString()


def _brute_cycles(edges: set, n: int) -> int:
    def walk(start, cur, path):
        c = 0
        for a, b in edges:
            if a == cur:
                if b == start:
                    c += 1
                elif b > start and b not in path:
                    c += walk(start, b, path | {b})
        return c

    return sum(walk(s, s, {s}) for s in range(n))


@pytest.mark.parametrize("n,judgments", [(2, 20), (3, 30), (5, 40), (6, 30), (8, 12)])
def test_cycles_against_brute_force(spark, n, judgments):
    rng, rows, want = random.Random(n), [], {}
    for jid in range(judgments):
        values_of = rng.choice([[0.0, 0.5, 1.0], [0.0, 1.0], [0.0, 0.5, 1.0, 1.0], [1.0]])
        p = {(i, j): rng.choice(values_of) for i in range(n) for j in range(i + 1, n)}
        rows += [(jid, i, j, v) for (i, j), v in p.items()]
        full = p | {(j, i): 1 - v for (i, j), v in p.items()}
        group = list(range(n))
        for _ in range(n):
            group = [min(group[j] for j in range(n) if j == i or full[i, j] == 0.5) for i in range(n)]
        edges = {(group[i], group[j]) for (i, j), v in full.items() if v > 0.5}
        want[jid] = (_brute_cycles(edges, n), sum(all(full[i, j] >= 0.5 for j in range(n) if j != i) for i in range(n)))
    rows += [(999, 0, 1, None), (998, 0, n + 3, 1.0)]  # incomplete judgments
    prefs = spark.createDataFrame(rows, "jid int, i int, j int, p double")
    each = consistency.cycles(consistency.by_size(consistency.matrices(prefs, n), n, [n]), n)
    assert {r["jid"]: (r["cycles"], r["dominant"]) for r in each.collect()} == want
    one = consistency.cycle_report(prefs, n).first()
    assert (one["total_judgments"], one["total_cycles"]) == (judgments, sum(c for c, _ in want.values()))


def test_sweep_reads_once(spark):
    prefs = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 2, 1.0), (1, 0, 2, 0.0), (2, 0, 1, 0.5)], "jid int, i int, j int, p double")
    rows = consistency.sweep(prefs, 4)
    got = {r["n_response"]: (r["total_judgments"], r["total_cycles"], r["avg_cycles"]) for r in rows.collect()}
    assert got == {2: (2, 0, 0.0), 3: (1, 1, 1.0), 4: (0, 0, None)}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1
    with pytest.raises(ValueError):
        consistency.sweep(prefs, 17)


def test_intransitive(spark):
    rows = [(0.0, 0.0, 1.0), (1.0, 1.0, 0.0), (1.0, 1.0, 1.0), (0.5, 1.0, 1.0), (0.5, 1.0, 0.0)]
    assert values(spark, rows, "a double, b double, c double", consistency.intransitive(F.col("a"), F.col("b"), F.col("c"))) == [(True,), (True,), (False,), (False,), (True,)]


def test_win_table_properties(spark):
    rows = [(p, m, float((p * 7 + k * 3) % 5), float((p * 5 + k) % 4)) for p in range(20) for k, m in enumerate("abc") if (p, m) != (3, "a")]
    t = {(r["row_model"], r["col_model"]): r for r in evaluation.win_table(spark.createDataFrame(rows, "prompt_id int, model string, helpfulness double, correctness double")).collect()}
    for (a, b), r in t.items():
        assert math.isclose(r["t1"] + t[b, a]["t1"], 1) and r["t3"] <= min(r["t1"], r["t2"]) + 1e-12
        assert a != b or r["t1"] == r["t2"] == r["t3"] == 0.5


def test_rouge(spark):
    rng = random.Random(1)

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rows = [([rng.choice("abcd") for _ in range(rng.randrange(12))], [rng.choice("abcd") for _ in range(rng.randrange(12))]) for _ in range(40)]
    got = values(spark, rows, "a array<string>, b array<string>", T.rouge_l("a", "b"))
    assert all(math.isclose(g[0], 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0) for g, (a, b) in zip(got, rows))
    sizes = [(0, 3), (1, 1), (61, 62), (62, 62), (62, 63), (63, 61), (124, 125), (130, 5), (3, 200), (190, 186), (249, 250)]
    rows = [([rng.choice("abcdefgh") for _ in range(x)], [rng.choice("abcdefghx") for _ in range(y)]) for x, y in sizes] + [(["q"] * 200, ["q"] * 300), (None, ["a"]), (["a"], None)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(T.longest_common(F.col("a"), F.col("b")).alias("n"))
    assert [r["n"] for r in got.collect()] == [None if a is None or b is None else lcs(a, b) for a, b in rows]
    assert "Python" not in got._jdf.queryExecution().toString()
    assert values(spark, [("Don't  STOP, 3.5x naïve!",), ("",), (None,)], "t string", T.rouge_tokens(F.col("t"))) == [(["don", "t", "stop", "3", "5x", "na", "ve"],), ([],), (None,)]


def test_rows(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert sorted((r["k"], r["pos"]) for r in relational.pick(df, "k", [5, 3]).collect()) == [(3, 1), (5, 0)]
    with pytest.raises(IndexError):
        relational.pick(df, "k", [100])
    parts = {r["split"]: r["count"] for r in relational.split_exact(df, "k", 30).groupBy("split").count().collect()}
    assert parts == {"test": 30, "train": 70}
    assert relational.sample(df, "k", 1000).count() == 100


def test_backends(spark):
    with pytest.raises(ValueError):
        inference.RewardModel(["no such"])
    rows = spark.createDataFrame([("a b c",), (None,)], "p string")
    first, again = (sorted(map(tuple, inference.judge(rows, "p", ["A", "B"], 3).select("verdicts").collect())) for _ in range(2))
    assert first == again and all(len(v[0]) == 3 for v in first)


def test_report_files(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("rows= [0,8]\n\n[2,1,3]\nnot a list\n[4,4]\n[1,x]\n")
    assert sorted((r["array_idx"], r["scores"]) for r in io.read_annotations(spark, f"{tmp_path}/notes.txt").collect()) == [(0, [2, 1, 3]), (1, [4, 4])]
    (tmp_path / "eval.txt").write_text("Results\n====\n\nModel: org/base\n  Helpfulness: 0.7861\n  Correctness: 0.7843\n\nModel: org/ours\n  Helpfulness: 0.8153\n  Correctness: 0.8103\n")
    assert sorted(map(tuple, io.read_evaluation(spark, f"{tmp_path}/eval.txt").collect())) == [("org/base", 0.7861, 0.7843), ("org/ours", 0.8153, 0.8103)]
    table = "Tables\n=====\n\n" + "".join(f"Table {k}: title\nRows: Row model (y), Columns: model\n\nBase       0.500   0.4{k}0   0.332\nX      0.519   0.500   0.377\nOurs       0.668   0.624   0.500\n\n" for k in (1, 2, 3))
    (tmp_path / "win.txt").write_text(table)
    got = io.read_win_tables(spark, f"{tmp_path}/win.txt").collect()
    assert len(got) == 9 and {r["row_model"] for r in got} == {"Base", "X", "Ours"}
    assert [r["values"] for r in got if r["table_no"] == 2 and r["row_model"] == "Base"] == [[0.5, 0.42, 0.332]]


def test_reports_are_written(spark, tmp_path):
    rows = [("a", "b", 0.25, 0.5, 0.25), ("b", "a", 0.75, 0.5, 0.5), ("a", "a", 0.5, 0.5, 0.5), ("b", "b", 0.5, 0.5, 0.5)]
    t = spark.createDataFrame(rows, "row_model string, col_model string, t1 double, t2 double, t3 double")
    lines = io.win_table_report(t, ["a", "b"], {"t1": "First", "t2": "Second", "t3": "Worst"})
    io.write_text(lines, f"{tmp_path}/report")
    text = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/report").collect())
    assert text.splitlines()[:3] == ["Table 1: First", "a          0.500   0.250", "b          0.750   0.500"]
    made = []
    first = io.read_or_make(spark, f"{tmp_path}/made", lambda: made.append(1) or spark.range(3).toDF("x"))
    assert first.count() == io.read_or_make(spark, f"{tmp_path}/made", lambda: made.append(1) or spark.range(3).toDF("x")).count() == 3 and made == [1]
    io.write_splits(spark.createDataFrame([(1, "train"), (2, "test")], "x int, split string"), f"{tmp_path}/splits")
    assert io.read_dataset(spark, f"{tmp_path}/splits", "test").first()["x"] == 2


def test_streaming_votes(spark, tmp_path):
    from tessera.streaming.votes import streaming_votes

    spark.sql("SELECT 1 AS prompt_id, 'A' AS letter, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 1, 'A', timestamp'2024-01-01 01:00:00' UNION ALL SELECT 1, 'B', timestamp'2024-01-01 02:00:00'").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("prompt_id int, letter string, ts timestamp").parquet(f"{tmp_path}/in")
    q = streaming_votes(stream, "ts").writeStream.format("memory").queryName("votes").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["pref_majority"], r["n"]) for r in spark.table("votes").collect()] == [("A", 3)]


def test_byte_tokens_go_back(spark):
    texts = ["", "a", "naïve 日本 🙂", "x\x00y", None]
    got = values(spark, [(t,) for t in texts], "t string", S.byte_tokens(F.col("t")), S.byte_text(S.pad_right(S.byte_tokens(F.col("t")), 30, S.PAD)))
    assert [g[0] for g in got] == [None if t is None else [b + S.BYTES for b in t.encode()] for t in texts]
    assert [g[1] for g in got] == texts


def test_special_tokens_and_pads(spark):
    got = values(spark, [([5, 0, 7, 0, 0],), ([],), (None,)], "t array<int>", S.without(F.col("t"), [5]), S.pads_to_end(F.col("t"), 0, 1))
    assert got == [([0, 7, 0, 0], [5, 1, 7, 1, 1]), ([], []), (None, None)]


def test_reward_text_keeps_the_right_end(spark):
    rows = [("q one", "a </s> b"), ("q", "")]
    whole = T.reward_text(F.col("q"), F.col("r"), "</s>", "END")
    cut = T.reward_text(F.col("q"), F.col("r"), "</s>", "END", most=3)
    assert values(spark, rows, "q string, r string", whole, cut) == [("q one a END b", "a END b"), ("q ", "q")]


def test_batches_are_exact(spark):
    rows = spark.range(1003).withColumnRenamed("id", "k").repartition(5)
    one, two = ({r["k"]: r["batch_id"] for r in relational.batches(rows, "k", 64, epoch=e).collect()} for e in (0, 1))
    for got in (one, two):
        sizes = [list(got.values()).count(b) for b in range(16)]
        assert sizes == [64] * 15 + [43] and set(got) == set(range(1003))
    assert one != two and one == {r["k"]: r["batch_id"] for r in relational.batches(rows.repartition(2), "k", 64).collect()}
    assert relational.batches(rows.limit(0), "k", 64).count() == 0


def test_explanations_come_before_verdicts(spark):
    rows = spark.createDataFrame([(1, "p"), (2, None)], "id int, prompt string")
    got = inference.explained(rows, "prompt", "preference_ternary", 3).collect()
    assert len(got) == 6 and {r["sample_idx"] for r in got} == {0, 1, 2}
    assert all(r["explanation"].startswith("seen ") and r["verdict"] in ("A", "B", "Tie") for r in got)
    with pytest.raises(ValueError):
        inference.StructuredJudge("unheard of", 1)


def test_correlation_against_a_list(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0), (7, 9.0), (None, 1.0)], "k int, x double")
    r = agreement.against(rows, "k", "x", [1.0, 2.0, 3.0]).first()
    assert r["n"] == 3 and math.isclose(r["r"], 0.98198, abs_tol=1e-4)


def test_report_files_come_back(spark, tmp_path):
    table = spark.createDataFrame([("a", "a", 0.5), ("a", "b", 0.25), ("b", "a", 0.75), ("b", "b", 0.5)], "row_model string, col_model string, t1 double")
    lines = io.win_table_report(table, ["a", "b"], {"t1": "Title"})
    io.write_text(lines, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 3
    assert io.write_with_fallback(table, "nowhere://x/y", str(tmp_path / "second")) == str(tmp_path / "second")
    assert io.read_split(spark, {"test": str(tmp_path / "second")}).count() == 4
    with pytest.raises(ValueError):
        io.read_split(spark, {})
