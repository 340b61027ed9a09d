"""The queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm import neardup, quality, substring, topk


def op2_segmented_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import identify
    from tessera.llm.tokens import default_path

    part = F.crc32(F.col("doc_id").cast("string")) % 4
    out = identify(C.documents(spark, sf_dir).select("doc_id", "text", "lang"), default_path("piece_bpe_32k.model"), train=part != 2)
    return out.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.neardup import near_duplicates

    return near_duplicates(C.documents(spark, sf_dir), k=3, percent=85)


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import replace_pii

    return replace_pii(C.documents(spark, sf_dir), C.secret(spark)).select("doc_id", "text", "n_pii")


def op5_fm_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substring import remove_repeats

    return remove_repeats(C.documents(spark, sf_dir).select("doc_id", "text"), width=20, keep_text=False).drop("text")


def op1_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.tokenfile import read_tokens, write_tokens
    from tessera.llm.tokens import default_path

    files = C.new_path(spark, "tokens")
    write_tokens(C.documents(spark, sf_dir), default_path("byte_bpe_50k.json"), 0, files)
    return read_tokens(spark, files, with_ids=False).drop("ids")


def op6_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack_sequences
    from tessera.llm.tokens import default_path

    return pack_sequences(C.documents(spark, sf_dir), default_path("word_bpe_49k.json"), end=1, length=2048, with_ids=False).drop("ids")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sentencepiece import encode
    from tessera.llm.tokens import default_path

    return encode(C.documents(spark, sf_dir), default_path("piece_bpe_32k.model"), with_ids=False).drop("ids")


def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(C.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import score_texts

    part = F.crc32(F.col("doc_id").cast("string")) % 7
    out = score_texts(C.documents(spark, sf_dir), train=part != 2)
    return out.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op11_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.bytebpe import encode

    docs = C.documents(spark, sf_dir)
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False).drop("ids")


def op12_cascading_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.cascade import hashed_faults, replay

    return replay(spark.read.parquet(f"{sf_dir}/conversations.parquet"), **hashed_faults())


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.variants import group_variants

    return group_variants(C.documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_huffman_tokens, op2_segmented_langid, op3_minmax_neardup, op4_pii_surrogates, op5_fm_substring, op6_cost_packing, op7_sentencepiece, op8_host_quality, op9_exact_topk, op10_context_mixing, op11_backtracking_bpe, op12_cascading_release, op13_spelling_variants)
}
ORACLE: dict[str, str] = {"op3_minmax_neardup": neardup.SQL, "op5_fm_substring": substring.SQL, "op8_host_quality": quality.SQL, "op9_exact_topk": topk.SQL}
