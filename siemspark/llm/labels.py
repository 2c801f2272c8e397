"""A bounded sample of labelled documents, for fitting small models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siemspark.llm.common import id_text

SAMPLE_ROWS = 20_000


def labelled(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, quality, toxic): one row for each of at most ``limit`` labelled ids, the ones of smallest hash.

    Ids labelled several times take the worst label; rows with null labels are not used.  Of an id with
    several texts the smallest is taken, a null one only if there is no other.
    """
    picked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").dropna()
              .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    # At most ``limit`` rows of three numbers.
    rows = id_text(docs).join(F.broadcast(picked), "doc_id")
    # Repeated rows are merged before they are shuffled.
    return rows.groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text")).select(
        "doc_id", "text", "quality", "toxic")
