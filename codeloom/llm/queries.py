"""The queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import docpairs, mixing, nearcopies, neighbors, quality, tokens
from codeloom.llm.sql import SQL
from codeloom.operators.store import current_nodes
from codeloom.plans.tables import table

__all__ = ["QUERIES", "SQL"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.similar_pairs(current_nodes(table(spark, d, "nodes"), "embedding")).select("id_a", "id_b")


#: The texts of problem 2: runs of three words, six tenths in common, from 25 words on; every pair.
CODE = nearcopies.Params(least=0.6, run=3, least_words=25, expand=None)


def _code_texts(spark: SparkSession, d: str) -> DataFrame:
    return current_nodes(table(spark, d, "nodes"), "raw_text").where("raw_text is not null").select("id", F.col("raw_text").alias("text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.similar_pairs(_code_texts(spark, d), CODE)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Class and number of links of every symbol with enough words."""
    return nearcopies.groups(_code_texts(spark, d), CODE)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.function_docs(table(spark, d, "nodes"), with_text=False).where("direct").select("id")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each documented function with its code and description."""
    return docpairs.function_docs(table(spark, d, "nodes"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p7_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Number of ids of each document and whether decoding gives the text back."""
    return tokens.token_counts(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents and how often each is used."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share that each source reaches."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_mix_chars(spark: SparkSession, d: str) -> DataFrame:
    """The mix by number of characters, which SQL can count."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), size=F.length("text"))[0]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_cases(table(spark, d, "documents"), table(spark, d, "doc_labels")).select("doc_id")


def p9_figures(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document."""
    docs = table(spark, d, "documents")
    return quality.figures(docs, quality.common_words(docs))


def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    """Those statistics that SQL can state."""
    return p9_figures(spark, d).select("doc_id", "words", "mean_word", "longest_word", "unique_share", "digit_share", "wide_share", "lines", "words_per_line", "common_share")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_groups, p3_found, p3_pairs, p7_ids, p7_sizes, p8_mix, p8_shares, p8_mix_chars, p9_found, p9_figures, p9_counts)}
