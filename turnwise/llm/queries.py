"""The operators as queries over the given tables, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import byte_bpe, pitman_yor
from turnwise.llm.alignment import align_documents
from turnwise.llm.arrow_text import remainder, shared_folder, table
from turnwise.llm.fingerprints import fingerprint_documents
from turnwise.llm.html_mincut import extract_pages
from turnwise.llm.language_id import fit_language, identify
from turnwise.llm.minhash_dedup import DedupOptions, near_duplicates
from turnwise.llm.mixing import mix_documents
from turnwise.llm.oracles import MIX, PHRASES
from turnwise.llm.packing import pack_documents
from turnwise.llm.phrase_mining import mine_phrases
from turnwise.llm.quality_classifier import fit_quality, quality_scores
from turnwise.llm.quality_rules import judge_documents
from turnwise.llm.subword import SubwordModel
from turnwise.llm.token_files import digests_with_starts, write_token_files

BYTE_BPE, MULTI_RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"


def _fold(divisor: int) -> Column:
    """Whether a document is held out from learning; one without an id is not."""
    return F.coalesce(remainder(F.col("doc_id"), divisor) == 2, F.lit(False))


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").filter(~_fold(4)).select("doc_id", F.col("quality").alias("label"))
    model = fit_quality(documents, labels)
    return quality_scores(documents, model).select("doc_id", _fold(4).alias("held_out"), "score", "predicted")


def learn_language(documents: DataFrame) -> SubwordModel:
    return fit_language(documents, documents.filter(~_fold(4)).select("doc_id", F.col("lang").alias("label")))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    found = identify(documents, learn_language(documents))
    return found.select("doc_id", _fold(4).alias("held_out"), "lang_pred", "score", "rejected")


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE)).drop("ids")


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = shared_folder(spark, "token-files")
    write_token_files(table(spark, folder, "documents"), files, public_tokenizers.path(BYTE_BPE), end_id=2)
    return digests_with_starts(spark, files)


def op5_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    return pitman_yor.score_documents(table(spark, folder, "documents"), _fold(7))


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(MULTI_RANKS)
    encoded = byte_bpe.encode_documents(table(spark, folder, "documents"), path, public_tokenizers.PATTERN, decode=True)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_html_mincut(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(table(spark, folder, "pages"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge_documents(table(spark, folder, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*base, "quality")


def op9_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), DedupOptions(percent=85))


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_documents(table(spark, folder, "documents"))


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return mine_phrases(table(spark, folder, "documents"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_documents(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES))


def op13_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mix = mix_documents(table(spark, folder, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_language": op3_language,
    "op4_token_files": op4_token_files,
    "op5_pitman_yor": op5_pitman_yor,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_html_mincut": op7_html_mincut,
    "op8_quality_rules": op8_quality_rules,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_fingerprints": op10_fingerprints,
    "op11_phrases": op11_phrases,
    "op12_alignment": op12_alignment,
    "op13_mixing": op13_mixing,
}
ORACLES: dict[str, str] = {"op11_phrases": PHRASES, "op13_mixing": MIX}
