"""Raising, appending, acknowledging and describing alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.clock import AsOf, as_of_column
from flowsentry.functions.labels import title_case
from flowsentry.functions.text import alert_source, detail, parse_details
from flowsentry.operators.ordering import rank_rows
from flowsentry.schemas import SAFE_LABELS


def alerts_from_predictions(scored: DataFrame, keep: list[str], label: str = "prediction",
                            details: str = "details") -> DataFrame:
    """One danger alert per row the ensemble calls DANGER."""
    message = F.concat(F.lit("Attack detected! "), F.col(label), F.lit(" - "), F.col(details))
    return scored.filter(F.col("threat_level") == "DANGER").select(
        *keep, F.col(label).alias("type"), F.lit("danger").alias("severity"),
        message.alias("message"), F.coalesce("source_ip", F.lit("")).alias("source_ip"))


def alerts_from_stream(scored: DataFrame, keep: list[str], label: str = "prediction",
                       requested: str | None = None) -> DataFrame:
    """Danger for any label but normal and safe, or for level DANGER; a warning for level SUSPICIOUS.

    Warnings carry the type that was asked for (`requested`), not the predicted one.
    """
    name = F.upper(F.coalesce(F.col(label), F.lit("Normal")))
    attack = ~name.isin(SAFE_LABELS) | (F.col("threat_level") == "DANGER")
    severity = F.when(attack, "danger").when(F.col("threat_level") == "SUSPICIOUS", "warning")
    asked = F.col(requested or label)
    danger = F.col("severity") == "danger"
    return (scored.withColumn("severity", severity).filter(F.col("severity").isNotNull())
            .select(*keep, F.when(danger, F.col(label)).otherwise(asked).alias("type"), "severity",
                    F.when(danger, F.concat(F.lit("Attack detected: "), F.col(label)))
                     .otherwise(F.concat(F.lit("Suspicious: "), title_case(asked))).alias("message"),
                    F.coalesce("source_ip", F.lit("")).alias("source_ip")))


def append_alerts(alerts: DataFrame, new: DataFrame) -> DataFrame:
    """Alerts plus new ones; fields the new ones leave out take the defaults of a manual alert."""
    # Defaults of a manual alert.
    defaults = {"type": "manual", "severity": "suspicious", "message": "Manual alert",
                "source_ip": "", "details": "{}", "acknowledged": False}
    present = set(new.columns)
    filled = new.withColumns({name: F.coalesce(name, F.lit(value)) if name in present else F.lit(value)
                              for name, value in defaults.items()})
    return alerts.unionByName(with_source(filled), allowMissingColumns=True)


def append_rows(table: DataFrame, new: DataFrame, defaults: dict[str, object] | None = None,
                ts: str = "ts", now: AsOf = None) -> DataFrame:
    """Traffic rows or predictions plus new ones, stamped with `now` where they carry no time."""
    values = dict(defaults or {})
    if now is not None:
        values[ts] = now
    present = set(new.columns)
    kinds = {f.name: f.dataType for f in table.schema.fields}
    filled = new.withColumns({n: F.coalesce(n, F.lit(v).cast(kinds[n])) if n in present
                              else F.lit(v).cast(kinds[n]) for n, v in values.items()})
    return table.unionByName(filled, allowMissingColumns=True)


def acknowledge(alerts: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Alerts whose id is listed become acknowledged. Ids are unique, so the join spreads evenly."""
    listed = ids.select(F.col(key).alias("_id")).distinct()
    return (alerts.join(listed, F.col(key) == F.col("_id"), "left")
            .withColumn("acknowledged", F.col("acknowledged") | F.col("_id").isNotNull()).drop("_id"))


def number_alerts(alerts: DataFrame, ts: str = "ts", tie: str = "id", name: str = "alert_id") -> DataFrame:
    """Sequential numbers in order of arrival."""
    return rank_rows(alerts, [F.col(ts).asc(), F.col(tie).asc()], name)


def with_source(alerts: DataFrame) -> DataFrame:
    """Fill empty source addresses from the details."""
    parsed = alerts.withColumn("_details", parse_details("details"))
    return parsed.withColumn("source_ip", alert_source("source_ip", F.col("_details"))).drop("_details")


def alert_details(alerts: DataFrame) -> DataFrame:
    """Addresses, ports and protocol read from the nested details, with the page's defaults."""
    parsed = F.col("_details")
    source = F.nullif(alert_source("source_ip", parsed), F.lit(""))
    # Where each shown field is looked up, and what is shown when it is missing.
    shown = {
        "dst_ip": (["traffic.DstIP", "traffic.dst_ip", "DstIP", "dst_ip"], "—"),
        "src_port": (["traffic.SrcPort", "SrcPort"], "—"),
        "dst_port": (["traffic.DstPort", "DstPort"], "5900"),
        "protocol": (["traffic.Protocol", "Protocol"], "—"),
    }
    return alerts.withColumn("_details", parse_details("details")).select(
        "id", "ts", "type", F.coalesce(source, F.lit("Unknown")).alias("src_ip"),
        *[F.coalesce(detail(parsed, *paths), F.lit(default)).alias(name)
          for name, (paths, default) in shown.items()])


def device_active(alerts: DataFrame, as_of: AsOf = None, window: str = "5 MINUTES") -> DataFrame:
    """Whether the alert is younger than `window`."""
    cutoff = as_of_column(alerts, as_of, back=window)
    return alerts.withColumn("is_active", F.col("ts") > cutoff)
