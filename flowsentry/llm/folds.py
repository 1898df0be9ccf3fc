"""Labels and the held-out fifth of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_column: str | Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves no remainder. A null id is held out."""
    text = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(text.cast("string")) % FOLDS == 0, F.lit(True))


def training_labels(labels: DataFrame, label: str, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, label) of rows to learn from: one per id (the larger label wins), null labels and held-out ids left out."""
    return labels.select(F.col(id_column).alias("doc_id"), F.col(label).cast("int").alias("label")) \
        .filter(F.col("label").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label"))
