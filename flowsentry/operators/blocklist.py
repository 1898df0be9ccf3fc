"""The set of blocked source addresses and what it does to traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _addresses(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.trim(column).alias("ip")).filter(F.col("ip") != "")


def auto_blocklist(alerts: DataFrame, source: str = "source_ip") -> DataFrame:
    """Sources of danger alerts."""
    return _addresses(alerts.filter(F.col("severity") == "danger"), source).distinct()


def block(blocklist: DataFrame, new: DataFrame, column: str = "ip") -> DataFrame:
    return blocklist.select("ip").union(_addresses(new, column)).distinct()


def unblock(blocklist: DataFrame, freed: DataFrame, column: str = "ip") -> DataFrame:
    return blocklist.select("ip").subtract(_addresses(freed, column))


def listed(blocklist: DataFrame) -> DataFrame:
    return blocklist.orderBy("ip")


def with_status(connections: DataFrame, blocklist: DataFrame) -> DataFrame:
    """`blocked` for sources on the list, `active` for the rest."""
    flagged = blocklist.select(F.col("ip").alias("src_ip"), F.lit(True).alias("_blocked"))
    return (connections.join(flagged, "src_ip", "left")
            .withColumn("status", F.when(F.col("_blocked"), "blocked").otherwise("active"))
            .drop("_blocked"))


def only_blocked(traffic: DataFrame, blocklist: DataFrame) -> DataFrame:
    return traffic.join(blocklist.select(F.col("ip").alias("src_ip")), "src_ip", "left_semi")


def only_unblocked(traffic: DataFrame, blocklist: DataFrame) -> DataFrame:
    return traffic.join(blocklist.select(F.col("ip").alias("src_ip")), "src_ip", "left_anti")
