"""Files of several splits, bucketed tables, metrics of a pass, folds over rows and streams."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import agreement, evaluation, judging, ordered, selection
from tessera.plans.views import VIEWS, pack, vocabulary
from tessera.sources import io
from tessera.streaming.coefficient import streaming_coefficient


@pytest.fixture
def small_splits(spark):
    """Text files are read in splits of a few hundred bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_of_several_splits(spark, tmp_path, small_splits):
    rng = random.Random(2)
    texts = {n: [f"{n} line {i} " + "x" * rng.randrange(40) if rng.random() < 0.9 else "" for i in range(200)] for n in ("one", "two")}
    (tmp_path / "in").mkdir()
    for n, lines in texts.items():
        (tmp_path / "in" / f"{n}.txt").write_text("\n".join(lines) + "\n")
    rows = io.numbered_lines(spark, str(tmp_path / "in"))
    got = {(r["file"].rsplit("/", 1)[1], r["line_no"]): r["line"] for r in rows.collect()}
    assert got == {(f"{n}.txt", i): x for n, lines in texts.items() for i, x in enumerate(lines)}
    assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 8


def test_reports_of_several_splits(spark, tmp_path, small_splits):
    lists = [[i, i % 7] for i in range(300)]
    lines = ["head", "[1, 1]"] + [x for v in lists for x in (str(v), "no list" if v[0] % 3 else "[1, 'a']")]
    (tmp_path / "annotated.txt").write_text("\n".join(lines))
    got = {r["array_idx"]: r["scores"] for r in io.read_annotations(spark, str(tmp_path / "annotated.txt")).collect()}
    assert got == dict(enumerate(lists))
    report = "".join(f"Model: m{i}\n  Helpfulness: {i / 8:.4f}\n  Correctness: {i / 4:.4f}\n\n" for i in range(90))
    (tmp_path / "evaluation.txt").write_text(report)
    got = {r["model"]: (r["helpfulness"], r["correctness"]) for r in io.read_evaluation(spark, str(tmp_path / "evaluation.txt")).collect()}
    assert got == {f"m{i}": (round(i / 8, 4), round(i / 4, 4)) for i in range(90)}
    tables = "".join(f"Table {k}: T\n" + "filler without numbers at all\n" * 9 + "".join(f"model{i} {k}.5 {i}.25 1 2\n" for i in range(4)) + "extra 1 2 3 4\n" for k in range(1, 40))
    (tmp_path / "wins.txt").write_text(tables)
    got = {(r["table_no"], r["row_model"]): r["values"] for r in io.read_win_tables(spark, str(tmp_path / "wins.txt"), 4).collect()}
    assert got == {(k, f"model{i}"): [k + 0.5, i + 0.25, 1.0, 2.0] for k in range(1, 40) for i in range(4)}


def test_too_many_templates_are_an_error(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"t{i}.txt").write_text(f"{i} {{prompt}}")
    assert io.read_templates(spark, str(tmp_path), 3) == {f"t{i}": f"{i} {{prompt}}" for i in range(3)}
    with pytest.raises(ValueError):
        io.read_templates(spark, str(tmp_path), 2)


def test_errors_of_rows_are_no_unreachable_path(spark, tmp_path):
    bad = spark.range(3).select(F.raise_error("broken row").alias("x"))
    with pytest.raises(Exception, match="broken row"):
        io.write_with_fallback(bad, str(tmp_path / "first"), str(tmp_path / "second"))
    assert not (tmp_path / "second").exists()


def _exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_bucketed_tables_need_no_shuffle(spark, small):
    lines, events = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("lineitem", "events"))
    table = spark.table(io.write_bucketed(lines, "l_orderkey", 5))
    rewards = spark.sql(VIEWS["v_rewards"].replace("FROM lineitem", "FROM {t}"), t=table)
    packed = pack(rewards, ["r0", "r1"], ["a0", "a1"])
    assert _exchanges(packed) == 0 and _exchanges(selection.best_worst_pair(packed)) == 0
    plain = pack(spark.sql(VIEWS["v_rewards"].replace("FROM lineitem", "FROM {t}"), t=lines), ["r0", "r1"], ["a0", "a1"])
    assert _exchanges(plain) > 0 and sorted(plain.collect()) == sorted(packed.collect())
    by_user = spark.table(io.write_bucketed(events, "user_id", 5))
    scores = spark.sql(VIEWS["v_models"].replace("FROM events", "FROM {t}"), t=by_user)
    assert _exchanges(evaluation.model_pairs(scores, ["helpfulness", "correctness"], True)) == 0
    votes = by_user.select(F.col("user_id").alias("prompt_id"), "event_id", "event_type")
    assert _exchanges(judging.regroup(votes, "prompt_id", "event_id", [], ["event_type"])) == 0
    joined = table.alias("a").join(spark.table(io.write_bucketed(lines, "l_orderkey", 5)).alias("b"), "l_orderkey")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert _exchanges(joined) == 0
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_work_paths_are_deleted(spark):
    path = io.work_path(spark, "x")
    io.write_dataset(spark.range(3), path)
    name = io.write_bucketed(spark.range(3), "id", 2)
    io.clean(spark)
    assert not spark.catalog.tableExists(name)
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_metrics_come_with_the_write(spark, tmp_path):
    df = spark.createDataFrame([(float(x),) for x in (-5, 0, 1, 9.9, 10, 99)] + [(None,)], "x double")
    seen, metrics = evaluation.observed(df, {"n": F.count("*"), "mean": F.avg("x")}, {"x": (F.col("x"), 0.0, 10.0)}, bins=10)
    io.write_dataset(seen, str(tmp_path / "out"))
    got = {(r["metric"], r["bin"]): r["value"] for r in metrics().collect()}
    assert got["n", None] == 7 and math.isclose(got["mean", None], (-5 + 0 + 1 + 9.9 + 10 + 99) / 6)
    assert [got["x", k] for k in range(10)] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 3] and spark.read.parquet(str(tmp_path / "out")).count() == 7
    nothing, metrics = evaluation.observed(df.limit(0), {"mean": F.avg("x")})
    nothing.collect()
    assert metrics().first()["value"] is None


def factors(kls, target, rate):
    return [1.0 if k is None else 1 + min(0.2, max(-0.2, k / target - 1)) * rate for k in kls]


def test_coefficient_over_rows(spark):
    rng = random.Random(4)
    rows = [(i // 3, i, rng.random() * 4 if rng.random() < 0.9 else None) for i in range(500)]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame([(*r, 1.0) for r in shuffled], "day int, k int, kl double, coefficient double").repartition(3).drop("coefficient")
    out = ordered.adaptive_coefficient(df, "kl", ["day", "k"], "coefficient", 0.1, 2.0, 100.0, 16.0)
    got = {r["k"]: r["coefficient"] for r in out.collect()}
    want = 0.1 * np.cumprod(factors([r[2] for r in rows], 2.0, 0.16))
    assert len(got) == 500 and all(math.isclose(got[i], w, rel_tol=1e-9) for i, w in enumerate(want))
    assert ordered.adaptive_coefficient(df.limit(0), "kl", ["day", "k"], "coefficient", 0.1, 2.0, 100.0, 16.0).count() == 0


def test_coefficient_over_a_stream(spark, tmp_path):
    """Three triggers, and a start from the checkpoint in between."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(run, step, None if step == 4 else step / 3.0) for run in ("a", "b") for step in range(9)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("run string, step long, kl double").parquet(f"{tmp_path}/in")
    try:
        for part in range(3):
            now = [r for r in rows if r[1] // 3 == part]
            spark.createDataFrame(now, "run string, step long, kl double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            q = streaming_coefficient(stream, 0.1, 2.0, 100.0, 16.0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            assert q.awaitTermination(120)
    finally:
        spark.conf.unset(provider)
    got = {(r["run"], r["step"]): r["coefficient"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = 0.1 * np.cumprod(factors([None if s == 4 else s / 3.0 for s in range(9)], 2.0, 0.16))
    assert len(got) == 18 and all(math.isclose(got[run, s], want[s]) for run in "ab" for s in range(9))


def test_many_columns_in_one_pass(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 200)) @ rng.normal(size=(200, 200)) + 1e6
    x[:, 7] = 5.0
    x[:, 8] = x[:, 9] * -2 + 3
    data = [[float(v) for v in row] for row in x]
    for i in range(0, 300, 4):
        data[i][3] = None
    names = [f"c{j}" for j in range(200)]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {(r["a"], r["b"]): r["r"] for r in agreement.correlation_matrix(df, names).collect()}
    assert len(got) == 200 * 200 and got["c7", "c1"] is None and got["c1", "c7"] is None and got["c7", "c7"] == 1.0
    keep = np.arange(300) % 4 != 0
    for a, b in ((0, 1), (8, 9), (199, 5), (3, 11), (11, 3)):
        rows = keep if 3 in (a, b) else slice(None)
        assert math.isclose(got[f"c{a}", f"c{b}"], np.corrcoef(x[rows, a], x[rows, b])[0, 1], rel_tol=1e-7)


def test_lengths_in_tokens(spark):
    import tokenizers

    path = vocabulary("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    count = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    rng = random.Random(6)
    words = ["a", "preference", "Tokenisation", "日本", "naïve", "antidisestablishment", "!"]
    say = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(12)))
    rows = [(i, say(), [say() for _ in range(rng.randrange(4))]) for i in range(60)] + [(90, None, ["a"]), (91, "a", [None, "a"]), (92, "", []), (93, "a", None)]
    got = selection.token_length_filter(spark.createDataFrame(rows, "k int, p string, r array<string>"), "p", "r", 14, 12, path, header=2, prompt_frame=("user: ", " ."), response_frame=("bot: ", ""))
    ok = lambda p, rs: p is not None and rs is not None and count(f"user: {p} .") <= 14 and all(x is not None and count(f"bot: {x}") - 2 <= 12 for x in rs)
    want = {k for k, p, rs in rows if ok(p, rs)}
    assert {r["k"] for r in got.collect()} == want and 5 < len(want) < 60 and got.columns == ["k", "p", "r"]
    pooled = selection.token_length_filter(spark.createDataFrame(rows[:60], "k int, p string, r array<string>"), "p", "r", 99, 8, path, pool=1)
    assert {r["k"] for r in pooled.collect()} == {k for k, p, rs in rows[:60] if all(count(x) <= 8 for x in rs[:1]) and count(p) <= 99}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_vocabulary_columns(spark, name):
    import tokenizers

    from tessera.functions import vocabulary as V

    path = vocabulary(name)
    t = tokenizers.Tokenizer.from_file(path)
    texts = ["", "plain words, and more", None, "naïve 日本 🙂", "<|endoftext|> is a token", "x " * 5000]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").repartition(2)
    rows = df.withColumn("ids", V.encode("t", path)).select("i", "ids", V.decode("ids", path).alias("some"), V.decode("ids", path, skip_special=False).alias("all")).orderBy("i").collect()
    for x, r in zip(texts, rows):
        ids = None if x is None else t.encode(x, add_special_tokens=False).ids
        assert r["ids"] == ids and r["some"] == (None if x is None else t.decode(ids)) and r["all"] == (None if x is None else t.decode(ids, skip_special_tokens=False))
    assert rows[3]["all"] == texts[3] or name != "byte_bpe_50k.json"


def test_ranks_and_running_maximum(spark):
    rows = [([3.0, 1.0, 3.0, 2.0],), ([5.0],), ([],), (None,)]
    df = spark.createDataFrame(rows, "a array<double>").select(A.ordinal_ranks(F.col("a")), A.running_max(F.col("a")))
    assert [tuple(r) for r in df.collect()] == [([2 / 3, 0.0, 1.0, 1 / 3], [3.0, 3.0, 3.0, 3.0]), ([None], [5.0]), ([], []), (None, None)]


def test_votes_of_a_scale_with_another_sentinel(spark):
    rows = [(1, i, v) for i, v in enumerate([2, -3, -3, -3, 2, 0, 0])] + [(2, 0, -3), (3, 0, None)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    got = {r["k"]: (r["pref_majority"], r["pref_mean"]) for r in judging.vote_numeric(df, ["k"], "v", "o", sentinel=-3).collect()}
    assert got == {1: (2, 1.0), 2: (None, None), 3: (None, None)}
    first = {r["k"]: r["pref_majority"] for r in judging.vote_numeric(df, ["k"], "v", "o", tie="first", sentinel=-3).collect()}
    assert first == {1: 2, 2: None, 3: None}
    assert {r["k"]: r["pref_majority"] for r in judging.vote_numeric(df, ["k"], "v", "o", sentinel_in_mode=True, sentinel=-3).collect()}[1] == -3


def test_a_hot_prompt_is_no_array(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), "id", (F.col("id") % 5).alias("v"))
    plan = judging.vote_numeric(df, ["k"], "v", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and "array_sort(collect_list" not in plan


def test_length_filter_query(spark, small):
    """The registered query over the whole table against the library, conversation by conversation."""
    import pyarrow.dataset as ds
    import tokenizers

    from tessera.plans.registry import QUERIES

    t = tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    count = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    rows = ds.dataset(f"{small}/conversations.parquet").to_table().to_pandas().sort_values(["conv_id", "turn", "text"])
    want = {}
    for conv, turns in rows.groupby("conv_id"):
        said, asked = turns.text[turns.role == "assistant"].tolist(), turns.text[turns.role == "user"].tolist()
        if asked and count(min(asked)) <= 120 and all(count("assistant says: " + s) - 5 <= 400 for s in said):
            want[conv] = len(said)
    got = {r["conv_id"]: r["n"] for r in QUERIES["length_filter_tokens"](spark, small).collect()}
    assert got == want and 0 < len(want)
