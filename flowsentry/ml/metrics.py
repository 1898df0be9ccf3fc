"""Model quality from confusion counts. The data is grouped once; what follows works on a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.col(truth).alias("truth"), F.col(predicted).alias("predicted")) \
        .agg(F.count("*").alias("n"))


def _per_class(cells: DataFrame, by: list[str]) -> DataFrame:
    """Support, predicted and hit counts of every class seen on either side."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), zero.alias("predicted"),
                 hit.alias("hits")),
        F.struct(F.col("predicted").alias("label"), zero.alias("support"), F.col("n").alias("predicted"),
                 zero.alias("hits")))
    return (cells.select(*by, F.inline(sides)).groupBy(*by, "label")
            .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                 F.sum("hits").alias("hits")))


def _rates(classes: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class; a zero denominator gives 0."""
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    both = F.col("precision") + F.col("recall")
    return classes.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1_score", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every class in the truth or among the predictions."""
    rates = _rates(_per_class(confusion(df, truth, predicted), []))
    return rates.select("label", "precision", "recall", "f1_score", "support")


def weighted_metrics(df: DataFrame, truth: str, predicted: str,
                     by: list[str] | None = None) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, for the whole or per `by`."""
    by = by or []
    return _weigh(_rates(_per_class(confusion(df, truth, predicted, by), by)), by)


def _weigh(rates: DataFrame, by: list[str]) -> DataFrame:
    total = F.sum("support")
    return rates.groupBy(*by).agg(
        (F.sum("hits") / total).alias("accuracy"),
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(m)
          for m in ("precision", "recall", "f1_score")])


def model_report(scored: DataFrame, truth: str, models: list[str]) -> DataFrame:
    """The weighted metrics of several models side by side.

    Rows are counted per combination of truth and outputs first, so only those few combinations are
    spread out per model.
    """
    combos = scored.groupBy(truth, *models).agg(F.count("*").alias("n"))
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in models])
    cells = combos.select(F.col(truth).alias("truth"), "n", F.inline(rows))
    cells = cells.groupBy("model", "truth", "predicted").agg(F.sum("n").alias("n"))
    return _weigh(_rates(_per_class(cells, ["model"])), ["model"])
