"""Quality rules with host verdicts, in DataFrame functions only.

Each document gets base figures and rule failures; failures are summed by host,
a beta prior is fitted to the hosts' failure rates by moments, and a host whose
shrunk rate is above a limit takes its documents with it.  Figures are written
once; the join back to documents carries figures only, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

SPACE = " \t\n\u000b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Shrunk failure rate above which a host fails: three of five documents, so that a host goes only if
#: clearly more of it fails than not, also where its own rows are few.
HOST_LIMIT = 0.6
#: Most hosts whose verdicts are broadcast (some 100 bytes each); beyond that both sides are shuffled by
#: host, and adaptive execution splits the partitions of hot hosts.
BROADCAST = 500_000


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def bind(x: Column, body) -> Column:
    """body(x) with x computed once, also inside lambdas of body."""
    return F.element_at(F.transform(F.array(x), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that the text has twice or more."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
            hit = F.filter(s, lambda e, k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
            return F.sort_array(F.transform(hit, lambda e: e["i"]))

        step = lambda acc, i: F.struct((acc["n"] + F.lit(window) - F.greatest(acc["end"] - i, F.lit(0))).alias("n"), (i + window).alias("end"))
        return F.aggregate(bind(ranked, starts), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]

    some = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(some)


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row of docs.

    A null text has no words; a null source counts as the empty host."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    base = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), text.alias("t"), words_of(text).alias("w"))
    return base.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        bind(F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )


def failures() -> dict[str, Column]:
    """The rules; each is true where a document fails it."""
    n = F.col("n_words")
    return {
        "base_failed": (n < 20) | (100 * F.col("n_repeat_words") > 30 * n),
        "symbols_failed": 10 * F.col("n_symbols") > n,
        "lines_failed": 10 * F.col("n_dup_lines") > n,
        "length_failed": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    }


def host_verdicts(rows: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, documents, failed, host_rate, host_failed from rows with host and any_failed.

    Rates are shrunk by a beta prior: its mean is the overall rate m, its weight
    m (1 - m) / v - 1 with v the variance of hosts' rates weighted by documents,
    kept within 0 .. 1e6.  One row of sums comes to the driver."""
    hosts = C.materialise(rows.groupBy("host").agg(F.count("*").alias("documents"), F.sum(F.col("any_failed").cast("long")).alias("failed")), "hosts")
    s = hosts.select(F.sum("documents").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("documents")).alias("q")).first()
    n, m = s["n"] or 0, (s["f"] or 0) / max(s["n"] or 0, 1)
    v = (s["q"] or 0.0) / max(n, 1) - m * m
    weight = min(1e6, max(0.0, m * (1 - m) / v - 1)) if v > 1e-12 else 1e6
    rate = (F.col("failed") + F.lit(m * weight)) / (F.col("documents") + F.lit(weight))
    return hosts.select("host", "documents", "failed", rate.alias("host_rate"), (rate > limit).alias("host_failed"))


def quality_rules(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Figures, rule failures, host_rate, host_failed and kept of each row of docs (doc_id, text, source).

    kept: neither base_failed nor host_failed.  Other columns of docs are not read;
    repeated rows count as often as they stand; an empty table gives no rows."""
    rules = failures()
    any_failed = rules["base_failed"]
    for r in list(rules.values())[1:]:
        any_failed = any_failed | r
    rows = C.materialise(figures(docs).withColumns(rules).withColumn("any_failed", any_failed), "figures")
    hosts = host_verdicts(rows, limit).select("host", "host_rate", "host_failed")
    out = rows.join(hosts.hint("broadcast" if hosts.limit(BROADCAST + 1).count() <= BROADCAST else "merge"), "host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


SQL = r"""
WITH w AS (
  SELECT rowid AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT row_number() OVER () AS rowid, * FROM documents)
), win AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s
  FROM w, unnest(range(1, len(w) - 6)) AS u(i) WHERE len(w) >= 8
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range(8) AS u(k) GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), f AS (
  SELECT w.r, doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.r = w.r LEFT JOIN lines ON lines.r = w.r
), g AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f
), h AS (
  SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > n_words
         OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS bad FROM g GROUP BY host
), p AS (
  SELECT sum(bad) / sum(n) AS m, sum(bad * bad / n) / sum(n) - (sum(bad) / sum(n)) ** 2 AS v FROM h
), k AS (
  SELECT m, CASE WHEN v > 1e-12 THEN least(1e6, greatest(0, m * (1 - m) / v - 1)) ELSE 1e6 END AS s FROM p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (h.bad + m * s) / (h.n + s) > 0.6 AS kept
FROM g JOIN h USING (host), k
"""
