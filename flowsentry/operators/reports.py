"""Tables of the written reports, and the flat export of a list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.functions.clock import AsOf, as_of_column, iso_text, micros
from flowsentry.functions.labels import severity_name, severity_rank
from flowsentry.operators.connections import MICROS, connection_stats
from flowsentry.operators.joins import with_advice
from flowsentry.schemas import ALARM_SEVERITIES, CONNECTION_KEY

# Report horizons and their lengths in hours.
HORIZONS = {"Last Hour": 1, "Last 6 Hours": 6, "Last 24 Hours": 24, "Last 7 Days": 168}


def threat_table(alerts: DataFrame) -> DataFrame:
    """Alerts per type with the highest severity seen and the advice against it."""
    grouped = alerts.groupBy("type").agg(F.count("*").alias("alerts"),
                                         F.max(severity_rank("severity")).alias("_rank"))
    return with_advice(grouped.select("type", "alerts", severity_name("_rank").alias("severity")),
                       "type", "mitigation")


def horizon_table(traffic: DataFrame, alerts: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Connections, bytes and alarms of several horizons back from `as_of`.

    Both tables are cut to the longest horizon and reduced in one pass with a sum per horizon. The shorter
    ones start a fixed time after the longest, so the newest time is looked up once.
    """
    longest = max(HORIZONS.values())
    cutoff = as_of_column(traffic, as_of, back=f"{longest} HOURS")
    calls = traffic.filter(F.col("ts") >= cutoff).select(
        "ts", "bytes", F.lit(1).alias("_call"), F.lit(0).alias("_alarm"))
    alarms = alerts.filter((F.col("ts") >= cutoff) & F.col("severity").isin(ALARM_SEVERITIES)).select(
        "ts", F.lit(0).cast("bigint").alias("bytes"), F.lit(0).alias("_call"), F.lit(1).alias("_alarm"))
    sums, rows = [], []
    for i, (name, hours) in enumerate(HORIZONS.items()):
        inside = F.col("ts") >= cutoff + F.expr(f"INTERVAL {longest - hours} HOURS")
        for source in ("_call", "bytes", "_alarm"):
            sums.append(F.coalesce(F.sum(F.when(inside, F.col(source))), F.lit(0))
                        .cast("bigint").alias(f"{source}{i}"))
        rows.append(F.struct(F.lit(name).alias("time_period"), F.lit(hours).alias("hours"),
                             F.col(f"_call{i}").alias("connections"), F.col(f"bytes{i}").alias("bytes"),
                             F.col(f"_alarm{i}").alias("anomalies")))
    return calls.unionByName(alarms).agg(*sums).select(F.inline(F.array(*rows)))


def protocol_table(packets: DataFrame) -> DataFrame:
    """Connections per protocol and how long they last on average."""
    grouped = connection_stats(packets, [*CONNECTION_KEY, "protocol"])
    length = micros("last_seen") - micros("first_seen")
    return grouped.groupBy("protocol").agg(
        F.count("*").alias("connections"),
        (F.sum(length) / F.count("*") / MICROS).alias("avg_duration_seconds"))


def export_rows(df: DataFrame) -> DataFrame:
    """Every column as text, with false, zero and missing values blank."""
    def text(field: T.StructField):
        value = F.col(field.name)
        if isinstance(field.dataType, T.BooleanType):
            shown = F.when(value, "true")
        elif isinstance(field.dataType, T.NumericType):
            shown = F.when(value != 0, value.cast("string"))
        elif isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            shown = iso_text(value)
        elif isinstance(field.dataType, (T.StructType, T.MapType, T.ArrayType)):
            shown = F.to_json(value)
        else:
            shown = value.cast("string")
        return F.coalesce(shown, F.lit("")).alias(field.name)

    return df.select(*[text(f) for f in df.schema.fields])
