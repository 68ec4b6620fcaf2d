"""The registered queries of this package: ``QUERIES[name](spark, sf_dir)`` and ``ORACLE[name]``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rewardframe.llm import ann, chat, html_text, mixing, pieces, pitman_yor, private_data, quality, simhash, spelling, topk, urls, vector_codes
from rewardframe.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to weights 5, 2, 1 over the sources, at most 3 epochs of each."""
    return mixing.op4_mixing(read(spark, sf_dir, "documents"))


QUERIES["op4_mix_sources"] = op4_mix_sources


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the components of those within 4 bits."""
    return simhash.op8_near_duplicates(read(spark, sf_dir, "documents"))


QUERIES["op8_near_duplicates"] = op8_near_duplicates


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents, learned from the labels outside the held-out fold."""
    return quality.op9_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES["op9_quality"] = op9_quality


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest whole-number inner products for every 50th vector, against all others."""
    return topk.op2_top_k(read(spark, sf_dir, "embeddings"))


QUERIES["op2_top_k"] = op2_top_k
ORACLE["op2_top_k"] = topk.ORACLE


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every 20th vector, against all others."""
    return ann.op10_nearest(read(spark, sf_dir, "embeddings"))


QUERIES["op10_nearest"] = op10_nearest


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and digests read back from the formatted strings."""
    return chat.op1_chat(read(spark, sf_dir, "conversations"))


QUERIES["op1_chat"] = op1_chat
ORACLE["op1_chat"] = chat.ORACLE


def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.op3_extract(read(spark, sf_dir, "pages"))


QUERIES["op3_extract"] = op3_extract


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages: rules first, then boosted trees."""
    return urls.op7_urls(read(spark, sf_dir, "pages"))


QUERIES["op7_urls"] = op7_urls


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of all documents, with inclusion scores, decoded again."""
    return pieces.op6_encode(read(spark, sf_dir, "documents"))


QUERIES["op6_sentencepiece"] = op6_sentencepiece


def op5_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under the language model learned from four folds."""
    return pitman_yor.op5_score(read(spark, sf_dir, "documents"))


QUERIES["op5_score"] = op5_score


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, their near words, forms and roots."""
    return spelling.op11_variants(read(spark, sf_dir, "documents"))


QUERIES["op11_spelling"] = op11_spelling
ORACLE["op11_spelling"] = spelling.ORACLE


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by four codebooks of 256 entries, with their errors."""
    return vector_codes.op12_codes(read(spark, sf_dir, "embeddings"))


QUERIES["op12_vector_codes"] = op12_vector_codes
ORACLE["op12_vector_codes"] = vector_codes.ORACLE


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: by their forms, and by contexts learned from these."""
    return private_data.op13_personal_data(read(spark, sf_dir, "documents"))


QUERIES["op13_personal_data"] = op13_personal_data
