"""From raw documents to packed token sequences: five stages, each of one operator.

Every stage works on all rows its predecessor kept and returns the columns of
documents, but the last, which returns the pieces of sequences.  ``run`` writes each
stage to the shared folder, so a lost executor costs no earlier stage.

Nulls, empty texts, repeated rows and empty tables are as the operators define them:
a null text is an empty one, a row without ``doc_id`` takes no part in comparisons and
stays, and near duplicates keep one row of the ``doc_id`` that names a group, the smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siemspark.llm import minhash, packing, resample, rules, substring
from siemspark.llm.common import stage, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; toxic and low-quality ones go."""
    return resample.keep(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the boosted trees over their statistics.

    The trees are fitted on the raw table: the stage before has taken the labelled low-quality documents away.
    """
    return rules.keep(docs, rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity of 0.8), the smallest id."""
    found = minhash.near_duplicates(docs, percent=80, width=5)
    gone = stage(found.where(~F.col("kept")).select("doc_id").distinct(), "duplicates")
    docs = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Rows of one id are one document: the smallest row stays.
    repeated = stage(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"))
                     .where("n > 1").select("doc_id"), "repeated")
    rows = docs.join(repeated, "doc_id", "left_semi").select("doc_id", F.struct(*docs.columns).alias("row"))
    rows = rows.groupBy("doc_id").agg(F.min("row").alias("row")).select("row.*")
    return docs.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(rows)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word windows that an earlier document holds; untouched where there are none."""
    return substring.clean(docs, width=13)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 4096 ids, with their places."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_dedup", near_dedup),
          ("substring_dedup", substring_dedup), ("best_fit_packing", best_fit_packing)]
#: Models and tokenizers are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
