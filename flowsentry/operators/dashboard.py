"""Counters, distributions and time buckets behind a live overview."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowsentry.functions.clock import AsOf, as_of_column, micros
from flowsentry.functions.labels import attack_bucket, chart_class, counts_as_attack, threat_level
from flowsentry.operators.toplists import latest
from flowsentry.schemas import ALARM_SEVERITIES, NAMED_ATTACKS


_SERIES = ["normal", "suspicious", "threats"]


def add_up(parts: list[tuple[DataFrame, dict[str, Column]]], by: list[str] | None = None) -> DataFrame:
    """One row (or one per `by`) of measures that come from different tables.

    Each table is reduced to its own measures, the small results are stacked with zeros for the others'
    measures, and the stack is summed. No join, and each table is read once.
    """
    by = by or []
    names = [name for _, measures in parts for name in measures]
    stacked = []
    for df, measures in parts:
        small = df.groupBy(*by).agg(*[c.alias(n) for n, c in measures.items()])
        stacked.append(small.select(*by, *[
            F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) if n in measures
            else F.lit(0).cast("bigint").alias(n) for n in names]))
    whole = reduce(DataFrame.unionByName, stacked)
    return whole.groupBy(*by).agg(*[F.sum(n).alias(n) for n in names])


def running_counters(traffic: DataFrame, alerts: DataFrame) -> DataFrame:
    """Connections, bytes and danger alerts per day, and their totals so far."""
    daily = add_up([
        (traffic.withColumn("day", F.col("ts").cast("date")),
         {"connections": F.count("*"), "bytes": F.sum("bytes")}),
        (alerts.withColumn("day", F.col("ts").cast("date")),
         {"attacks": F.count_if(F.col("severity") == "danger")}),
    ], by=["day"])
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("day", "connections", "bytes", "attacks",
                        F.sum("connections").over(so_far).alias("total_connections"),
                        F.sum("bytes").over(so_far).alias("total_bytes_analyzed"),
                        F.sum("attacks").over(so_far).alias("total_attacks_detected"))


def _normal_percentage(records: str, attacks: str) -> Column:
    """Can go below zero, when there are more attack predictions than traffic records."""
    share = (F.col(records) - F.col(attacks)) / F.col(records) * 100
    return F.when(F.col(records) == 0, 100.0).otherwise(F.round(share, 1))


def dashboard_stats(traffic: DataFrame, predictions: DataFrame, alerts: DataFrame,
                    alert_window: int | None = None) -> DataFrame:
    """Headline numbers. With `alert_window`, `total_alerts` looks at that many newest alerts only."""
    danger = F.col("severity") == "danger"
    counted = add_up([
        (traffic, {"total_records": F.count("*"), "total_bytes_analyzed": F.sum("bytes")}),
        (predictions, {"_attacks": F.count_if(counts_as_attack("prediction"))}),
        (alerts, {"total_attacks_detected": F.count_if(danger),
                  "active_threats": F.count_if(danger & ~F.col("acknowledged"))}),
        (latest(alerts.select("id", "ts", "severity"), alert_window) if alert_window else alerts,
         {"total_alerts": F.count_if(F.col("severity").isin(ALARM_SEVERITIES))}),
    ])
    return counted.select(
        F.col("total_records").alias("total_connections"), "total_records", "total_bytes_analyzed",
        "total_attacks_detected", "active_threats",
        _normal_percentage("total_records", "_attacks").alias("normal_percentage"), "total_alerts")


def threat_distribution(predictions: DataFrame, limit: int | None = None) -> DataFrame:
    """How many predictions (with `limit`, of the newest so many) are safe, suspicious and danger."""
    recent = latest(predictions.select("id", "ts", "prediction"), limit) if limit else predictions
    level = threat_level("prediction")
    return recent.agg(*[F.count_if(level == name).alias(name)
                        for name in ("safe", "suspicious", "danger")])


def attack_distribution(alerts: DataFrame, limit: int | None = None) -> DataFrame:
    """How many alerts (with `limit`, of the newest so many) fall under each named attack, or under Other."""
    recent = latest(alerts.select("id", "ts", "type"), limit) if limit else alerts
    bucket = attack_bucket("type")
    return recent.agg(*[F.count_if(bucket == name).alias(name) for name in [*NAMED_ATTACKS, "Other"]])


def report_summary(traffic: DataFrame, predictions: DataFrame, alerts: DataFrame,
                   max_alerts: int | None = None, max_predictions: int | None = None) -> DataFrame:
    """The five numbers a report opens with. With page sizes, alerts and predictions are counted up to them."""
    counted = add_up([
        (traffic, {"total_connections": F.count("*")}),
        (predictions, {"_attacks": F.count_if(counts_as_attack("prediction")),
                       "_predictions": F.count("*")}),
        (alerts, {"total_attacks_detected": F.count_if(F.col("severity") == "danger"),
                  "_alerts": F.count("*")}),
    ])
    return counted.select(
        "total_connections", "total_attacks_detected",
        _normal_percentage("total_connections", "_attacks").alias("normal_percentage"),
        # least() passes over missing bounds
        F.least("_alerts", F.lit(max_alerts).cast("bigint")).alias("total_alerts"),
        F.least("_predictions", F.lit(max_predictions).cast("bigint")).alias("total_predictions"))


def traffic_buckets(records: DataFrame, level: str = "threat_level", bucket_seconds: int = 10,
                    buckets: int = 60, as_of: AsOf = None) -> DataFrame:
    """Normal, suspicious and threat counts of the latest equal time buckets; the newest is the last.

    Only the window's rows are counted; empty buckets are added to the counted ones.
    """
    span = f"{bucket_seconds * buckets} SECONDS"
    start = as_of_column(records, as_of, back=span)
    now = start + F.expr(f"INTERVAL {span}")
    recent = records.filter((F.col("ts") > start) & (F.col("ts") <= now))
    age = F.floor((micros(now) - micros("ts")) / 1_000_000)
    placed = recent.select((buckets - 1 - F.floor(age / bucket_seconds)).cast("bigint").alias("bucket"),
                           chart_class(level).alias("_class"))
    counted = placed.groupBy("bucket").agg(*[F.count_if(F.col("_class") == c).alias(c) for c in _SERIES])
    axis = records.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    return axis.join(counted, "bucket", "left").select(
        "bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in _SERIES])


def bucket_totals(buckets: DataFrame) -> DataFrame:
    return buckets.agg(*[F.sum(c).alias(c) for c in _SERIES])


def attack_heatmap(alerts: DataFrame, as_of: AsOf = None, window: str = "24 HOURS") -> DataFrame:
    """Danger and warning alerts per hour of day, with a heat level from 0 to 3."""
    cutoff = as_of_column(alerts, as_of, back=window)
    recent = alerts.filter((F.col("ts") >= cutoff) & F.lower("severity").isin(ALARM_SEVERITIES))
    counted = recent.groupBy(F.hour("ts").cast("bigint").alias("hour")).agg(F.count("*").alias("_n"))
    hours = alerts.sparkSession.range(24).withColumnRenamed("id", "hour")
    cells = hours.join(counted, "hour", "left").select("hour", F.coalesce("_n", F.lit(0)).alias("attacks"))
    ratio = F.col("attacks") / F.greatest(F.max("attacks").over(Window.partitionBy()), F.lit(1))
    # Upper ends of heat levels 0, 1 and 2.
    level = F.when(ratio <= 0, 0).when(ratio <= 0.33, 1).when(ratio <= 0.66, 2).otherwise(3)
    return cells.select("hour", "attacks", level.alias("level"))
