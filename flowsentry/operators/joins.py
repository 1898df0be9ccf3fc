"""Lookups and alignments."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowsentry.functions.labels import threat_level
from flowsentry.operators.toplists import latest
from flowsentry.schemas import ADVICE, DEFAULT_ADVICE

def keys_apart(df: DataFrame, keys: list[str]) -> tuple[DataFrame, Column, list[str]]:
    """`df` with its keys renamed, a condition matching them to the plain names in which missing keys
    match each other too, and the new names. A plain join on columns would lose rows with missing keys."""
    names = {key: f"_key_{key}" for key in keys}
    match = reduce(and_, [F.col(key).eqNullSafe(F.col(name)) for key, name in names.items()])
    return df.withColumnsRenamed(names), match, list(names.values())


def labelled_features(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Features with the labels stored apart from them, matched on the row key."""
    return features.join(labels, key)


def advice_table(spark) -> DataFrame:
    rows = [F.struct(F.lit(kind).alias("type"), F.lit(text).alias("advice"))
            for kind, text in ADVICE.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def with_advice(df: DataFrame, label: str, name: str = "protection_advice") -> DataFrame:
    """Add the advice for a label, or the default for labels without one. Nine fixed rows are broadcast."""
    known = advice_table(df.sparkSession).withColumnsRenamed({"type": "_kind", "advice": "_advice"})
    return (df.join(F.broadcast(known), F.col(label) == F.col("_kind"), "left")
            .withColumn(name, F.coalesce("_advice", F.lit(DEFAULT_ADVICE))).drop("_kind", "_advice"))


def traffic_timeline(traffic: DataFrame, predictions: DataFrame, limit: int | None = 60) -> DataFrame:
    """The i-th newest traffic row beside the i-th newest prediction; rows without one are safe.

    With a limit both sides are cut to that many rows before they are numbered. Without one the whole
    history is numbered slice by slice.
    """
    from flowsentry.operators.ordering import rank_rows  # ordering itself joins

    wanted = [("record_id", traffic, ["bytes"]), ("id", predictions, ["prediction"])]
    sides = []
    for tie, df, values in wanted:
        order = [F.col("ts").desc(), F.col(tie).asc()]
        side = df.select("ts", tie, *values)
        if limit:
            newest = latest(side, limit, tie=tie)
            place = F.row_number().over(Window.orderBy(*order))
            side = newest.withColumn("position", place.cast("bigint"))
        else:
            side = rank_rows(side, order, "position")
        sides.append(side)
    left, right = sides
    level = threat_level("prediction")
    return (left.join(right.select("position", "prediction"), "position", "left")
            .select("position", "ts", "record_id", "bytes", level.alias("threat_level")))
