"""Preference-data views over the driver's tables, in Spark and (as common table expressions) in SQL.

v_rewards   prompts are orders, responses their lines in a fixed order, three reward dimensions
v_packed    the same, one row for each prompt with an array for each dimension
v_models    models are event types, prompts users: helpfulness and correctness
v_judge     verdicts -1 .. 4 of samples for (prompt, check), some in switched order
v_cat       verdicts A, B, Tie of the same samples
v_prefs3    preferences p01, p02, p12 of prompts with all three pairs
v_tokens    word lengths of documents as token ids
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "v_rewards": """
  SELECT l_orderkey AS prompt_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS INT) AS resp_idx,
         l_quantity / 50 AS r0, l_discount * 10 AS r1, l_tax * 10 AS r2 FROM lineitem""",
    "v_models": """
  SELECT user_id AS prompt_id, event_type AS model, sum(CAST(round(value * 100) AS BIGINT)) / (CAST(100 AS DOUBLE) * count(*)) AS helpfulness, max(value) AS correctness FROM events GROUP BY user_id, event_type""",
    "v_judge": """
  SELECT user_id AS prompt_id, CAST(event_id % 3 AS INT) AS check_idx, event_id AS sample_idx, event_id % 2 = 1 AS switched,
         CAST({json} AS INT) % 6 - 1 AS verdict,
         CASE CAST({json} AS INT) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'Tie' END AS letter FROM events""",
    "v_prefs3": """
  SELECT user_id AS prompt_id, max(CASE WHEN event_type = 'view' THEN p END) AS p01, max(CASE WHEN event_type = 'click' THEN p END) AS p02, max(CASE WHEN event_type = 'purchase' THEN p END) AS p12
  FROM (SELECT user_id, event_type, (count(*) % 3) / 2.0 AS p FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id, event_type) x GROUP BY user_id HAVING count(*) = 3""",
}
PACKED_SQL = """
  SELECT prompt_id, list(r0 ORDER BY resp_idx) AS a0, list(r1 ORDER BY resp_idx) AS a1, list(r2 ORDER BY resp_idx) AS a2 FROM v_rewards GROUP BY prompt_id"""
TOKENS_SQL = """
  SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), lambda w: CAST(length(w) AS INT)) AS tok FROM documents WHERE text IS NOT NULL"""


def sql_with(*names: str) -> str:
    """WITH clause of DuckDB for some views."""
    parts = []
    for n in dict.fromkeys(x for name in names for x in (("v_rewards", "v_packed") if name == "v_packed" else (name,))):
        text = PACKED_SQL if n == "v_packed" else TOKENS_SQL if n == "v_tokens" else VIEWS[n].replace("{json}", "json_extract(props, '$.k')")
        parts.append(f"{n} AS ({text})")
    return "WITH " + ", ".join(parts) + " "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "v_packed":
        return pack(view(spark, sf_dir, "v_rewards"), ["r0", "r1", "r2"], ["a0", "a1", "a2"])
    if name == "v_tokens":
        docs = table(spark, sf_dir, "documents").where("text is not null")
        words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
        return docs.select("doc_id", F.transform(words, F.length).alias("tok"))
    source = "lineitem" if name == "v_rewards" else "events"
    text = VIEWS[name].replace("{json}", "get_json_object(props, '$.k')").replace(f"FROM {source}", "FROM {source}")
    return spark.sql(text, source=table(spark, sf_dir, source))


def pack(rewards: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """One row for each prompt, an array in response order for each column: the only shuffle of the selection plans."""
    rows = F.array_sort(F.collect_list(F.struct("resp_idx", *columns)))
    packed = rewards.groupBy("prompt_id").agg(rows.alias("rows"))
    return packed.select("prompt_id", *[F.col("rows")[c].alias(n) for c, n in zip(columns, names)])


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
