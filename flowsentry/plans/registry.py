"""Every registered query: name → (session, folder of tables) → DataFrame.

Windows are wider than the operators' defaults because the given events are sparse: a few hundred a day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.functions import labels as L
from flowsentry.functions import network as N
from flowsentry.functions.text import byte_entropy
from flowsentry.ml import features as MF
from flowsentry.ml import metrics as MM
from flowsentry.ml.vote import ensemble_vote
from flowsentry.operators import alerts as AL
from flowsentry.operators import blocklist as BL
from flowsentry.operators import connections as CN
from flowsentry.operators import dashboard as DB
from flowsentry.operators import filters as FL
from flowsentry.operators import joins as JN
from flowsentry.operators import profile as PF
from flowsentry.operators import reports as RP
from flowsentry.operators import toplists as TP
from flowsentry.schemas import DETECTORS, FLOW_FEATURES, FLOW_LABEL
from flowsentry.session import prepare
from flowsentry.sources.alert_table import AlertTable
from flowsentry.sources import derived as D
from flowsentry.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEY = D.FLOW_ROW_KEY
NUMERIC = [f for f in FLOW_FEATURES if f not in ("Protocol", "SrcIP", "DstIP")]
EVENT_KINDS = ["click", "error", "purchase", "signup", "view"]
PLACES = 6


def register(query: Callable[["Tables"], DataFrame]) -> Callable[["Tables"], DataFrame]:
    """Add a query under the function's name (a trailing underscore avoids clashes with operators)."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(Tables(prepare(spark), folder))

    QUERIES[query.__name__.rstrip("_")] = run
    return query


class Tables:
    """The given tables in the shapes the operators take."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    events = property(lambda self: self.read("events"))
    lineitem = property(lambda self: self.read("lineitem"))
    packets = property(lambda self: D.packets(self.events))
    traffic = property(lambda self: D.traffic(self.events))
    traffic_raw = property(lambda self: D.traffic_raw(self.events))
    flows = property(lambda self: D.flows(self.lineitem))
    votes = property(lambda self: D.flow_votes(self.lineitem))
    alerts = property(lambda self: D.alerts(self.events))
    predictions = property(lambda self: D.predictions(self.events))
    blocklist = property(lambda self: BL.auto_blocklist(self.alerts))


def rounded(df: DataFrame, *columns: str, places: int = PLACES) -> DataFrame:
    """Nearest multiple of 10^-places, for values whose last digits depend on the order of addition."""
    scale = 10.0 ** places
    return df.withColumns({c: F.floor(F.col(c) * scale + 0.5) / scale for c in columns})


# --- scans and exports ---

@register
def flows_scan(t: Tables) -> DataFrame:
    return t.flows


@register
def export_rows(t: Tables) -> DataFrame:
    return RP.export_rows(t.alerts)


# --- filters and projections ---

@register
def capture_filter(t: Tables) -> DataFrame:
    return FL.captured(t.packets)


@register
def alerts_by_severity(t: Tables) -> DataFrame:
    return FL.by_severity(t.alerts, "Danger")


@register
def alerts_open(t: Tables) -> DataFrame:
    return FL.by_acknowledged(t.alerts, False)


@register
def alert_history_by_ip(t: Tables) -> DataFrame:
    return FL.history_of_source(t.alerts, "10.0.0.7", limit=50)


@register
def alerts_by_ip_limit_then_filter(t: Tables) -> DataFrame:
    return FL.history_of_source(t.alerts, "10.0.0.7", limit=50, severity="danger", limit_first=True)


@register
def traffic_history(t: Tables) -> DataFrame:
    return FL.since(t.traffic, "24 HOURS")


@register
def retention_filter(t: Tables) -> DataFrame:
    return FL.retained(t.traffic, days=7)


@register
def schema_align(t: Tables) -> DataFrame:
    return FL.align_schema(t.flows.drop("FlagCount", "Entropy"), keep=KEY)


@register
def traffic_normalised(t: Tables) -> DataFrame:
    return FL.normalise_traffic(t.traffic_raw)


@register
def byte_fallback(t: Tables) -> DataFrame:
    return t.traffic_raw.select("record_id", N.byte_count().alias("bytes"),
                                N.byte_count(packet=None).alias("counter_bytes"))


@register
def alerts_from_predictions(t: Tables) -> DataFrame:
    scored = ensemble_vote(t.votes, keep=[*KEY, F.col("SrcIP").alias("source_ip")])
    return AL.alerts_from_predictions(scored, keep=KEY)


def stream_scored(predictions: DataFrame) -> DataFrame:
    """Unsure Normal predictions count as suspicious."""
    unsure = (F.col("prediction") == "Normal") & (F.col("confidence") < 0.5)
    return predictions.withColumn(
        "threat_level", F.when(unsure, "SUSPICIOUS").otherwise(F.col("threat_level")))


@register
def alerts_from_stream(t: Tables) -> DataFrame:
    return AL.alerts_from_stream(stream_scored(t.predictions), keep=["id", "ts"])


@register
def confidence_gate(t: Tables) -> DataFrame:
    scored = t.predictions.withColumn("severity", L.threat_level("prediction"))
    return FL.confident(scored, 0.70, "suspicious").select("id", "prediction", "severity")


@register
def device_active(t: Tables) -> DataFrame:
    return AL.device_active(t.alerts, window="60 MINUTES").select("id", "is_active")


@register
def flow_to_session(t: Tables) -> DataFrame:
    wide = FL.flow_to_session(t.flows, keep=KEY)
    return rounded(wide, "std_packet_size", "min_packet_size", "max_packet_size")


@register
def alert_details(t: Tables) -> DataFrame:
    return AL.alert_details(t.alerts)


@register
def alerts_acknowledge(t: Tables) -> DataFrame:
    seen = t.events.filter(F.col("value") > 250).select((F.col("event_id") + 1).alias("id"))
    return AL.acknowledge(t.alerts, seen).select("id", "acknowledged")


@register
def alert_table_calls(t: Tables) -> DataFrame:
    """An alert table filled by three calls, acknowledged between them and compacted: ids go on where they were."""
    table = AlertTable(t.spark, order=("ts", "event_id"))
    rows = t.alerts.withColumn("event_id", F.col("id") - 1)
    for part in range(3):
        table.append(rows.filter(F.pmod("event_id", F.lit(3)) == part))
        table.acknowledge(table.read().filter((F.col("event_id") % 5 == 0)))
        if part == 1:
            table.compact()
    return table.read().select("id", "event_id", "ts", "type", "severity", "acknowledged")


# --- joins ---

@register
def traffic_timeline(t: Tables) -> DataFrame:
    return JN.traffic_timeline(t.traffic, t.predictions, limit=60)


@register
def traffic_timeline_full(t: Tables) -> DataFrame:
    return JN.traffic_timeline(t.traffic, t.predictions, limit=None)


@register
def protection_advice(t: Tables) -> DataFrame:
    return JN.with_advice(t.alerts.select("id", "type"), "type")


@register
def connection_status(t: Tables) -> DataFrame:
    return BL.with_status(CN.connection_stats(t.packets), t.blocklist)


@register
def blocked_traffic(t: Tables) -> DataFrame:
    return BL.only_blocked(t.traffic, t.blocklist)


@register
def unblocked_traffic(t: Tables) -> DataFrame:
    return BL.only_unblocked(t.traffic, t.blocklist)


@register
def labelled_features(t: Tables) -> DataFrame:
    features = t.read("documents").select("doc_id", "lang", "source", "n_chars")
    return JN.labelled_features(features, t.read("labels"), "doc_id")


# --- aggregates ---

@register
def connection_stats(t: Tables) -> DataFrame:
    return CN.connection_stats(t.packets)


@register
def capture_totals(t: Tables) -> DataFrame:
    return CN.capture_totals(FL.captured(t.packets))


@register
def active_connections(t: Tables) -> DataFrame:
    return CN.active_connections(FL.normalise_traffic(t.traffic_raw), t.blocklist, window="1 DAYS")


@register
def active_connections_all(t: Tables) -> DataFrame:
    return CN.active_connections(FL.normalise_traffic(t.traffic_raw), t.blocklist, window="1 DAYS", limit=None)


@register
def flow_features(t: Tables) -> DataFrame:
    return CN.flow_features(t.packets)


@register
def running_counters(t: Tables) -> DataFrame:
    return DB.running_counters(t.traffic, t.alerts)


@register
def dashboard_stats(t: Tables) -> DataFrame:
    return DB.dashboard_stats(t.traffic, t.predictions, t.alerts)


@register
def threat_distribution(t: Tables) -> DataFrame:
    return DB.threat_distribution(t.predictions, limit=100)


@register
def threat_distribution_all(t: Tables) -> DataFrame:
    return DB.threat_distribution(t.predictions)


@register
def attack_distribution(t: Tables) -> DataFrame:
    return DB.attack_distribution(t.alerts, limit=100)


@register
def attack_distribution_all(t: Tables) -> DataFrame:
    return DB.attack_distribution(t.alerts)


@register
def report_summary(t: Tables) -> DataFrame:
    return DB.report_summary(t.traffic, t.predictions, t.alerts)


def _levelled(t: Tables) -> DataFrame:
    return t.predictions.withColumn("threat_level", L.threat_level("prediction"))


@register
def traffic_buckets(t: Tables) -> DataFrame:
    return DB.traffic_buckets(_levelled(t), bucket_seconds=600)


@register
def traffic_bucket_totals(t: Tables) -> DataFrame:
    return DB.bucket_totals(DB.traffic_buckets(_levelled(t), bucket_seconds=600))


@register
def attack_heatmap(t: Tables) -> DataFrame:
    return DB.attack_heatmap(t.alerts)


@register
def report_threats(t: Tables) -> DataFrame:
    return RP.threat_table(t.alerts)


@register
def report_horizons(t: Tables) -> DataFrame:
    return RP.horizon_table(t.traffic, t.alerts)


@register
def report_protocols(t: Tables) -> DataFrame:
    return rounded(RP.protocol_table(t.packets), "avg_duration_seconds")


@register
def class_balance(t: Tables) -> DataFrame:
    return PF.class_balance(t.flows, FLOW_LABEL)


@register
def dataset_profile(t: Tables) -> DataFrame:
    split = PF.stratified_split(t.flows.select(*KEY, FLOW_LABEL), FLOW_LABEL, KEY)
    return PF.dataset_profile(split, FLOW_LABEL, "Normal", FLOW_FEATURES)


@register
def feature_moments(t: Tables) -> DataFrame:
    return rounded(PF.feature_moments(t.flows, NUMERIC), "mean", "std", places=4)


@register
def payload_entropy(t: Tables) -> DataFrame:
    docs = t.read("documents")
    return rounded(docs.select("doc_id", byte_entropy("text").alias("entropy")), "entropy")


@register
def port_entropy(t: Tables) -> DataFrame:
    return rounded(CN.port_entropy(t.packets), "entropy")


@register
def anomaly_threshold(t: Tables) -> DataFrame:
    normal = t.flows.filter(F.col(FLOW_LABEL) == "Normal")
    return rounded(PF.anomaly_threshold(normal, "AnomalyScore"), "mean_error", "std_error", "threshold")


@register
def session_features(t: Tables) -> DataFrame:
    return rounded(CN.session_features(t.packets), "std_packet_size", "entropy_packets")


# Which events stand for which messages of the session schema.
SESSION_KINDS = {"vnc_commands": "purchase", "vnc_responses": "signup", "framebuffer_updates": "view",
                 "key_events": "error", "mouse_clicks": "click"}


@register
def session_matrix(t: Tables) -> DataFrame:
    wide = CN.session_matrix(t.packets, SESSION_KINDS)
    return rounded(wide, "std_packet_size", "entropy_packets")


@register
def session_event_counts(t: Tables) -> DataFrame:
    return CN.session_event_counts(t.packets, EVENT_KINDS)


# --- windows, orders and splits ---

@register
def packet_gaps(t: Tables) -> DataFrame:
    return CN.packet_gaps(t.packets)


@register
def recent_per_source(t: Tables) -> DataFrame:
    recent = TP.recent_per_group(t.packets, 5, ["src_ip"])
    return recent.select("src_ip", "place", "packet_id", "ts")


@register
def alert_ids(t: Tables) -> DataFrame:
    return AL.number_alerts(t.alerts.select("id", "ts"))


@register
def stratified_split(t: Tables) -> DataFrame:
    return PF.stratified_split(t.flows.select(*KEY, FLOW_LABEL), FLOW_LABEL, KEY)


@register
def latest_alerts(t: Tables) -> DataFrame:
    return TP.latest(t.alerts, 50)


@register
def latest_traffic(t: Tables) -> DataFrame:
    return TP.latest(t.traffic, 60, tie="record_id")


@register
def latest_predictions(t: Tables) -> DataFrame:
    return TP.latest(t.predictions, 100)


@register
def packet_tail(t: Tables) -> DataFrame:
    return TP.packet_tail(t.packets, 1000)


@register
def sessions(t: Tables) -> DataFrame:
    return CN.sessions(t.packets, gap_seconds=6 * 3600)


# --- blocklist and other sets ---

@register
def auto_blocklist(t: Tables) -> DataFrame:
    return t.blocklist


@register
def blocklist_add(t: Tables) -> DataFrame:
    warned = t.alerts.filter(F.col("severity") == "warning")
    return BL.listed(BL.block(t.blocklist, warned, "source_ip"))


@register
def blocklist_remove(t: Tables) -> DataFrame:
    harmless = t.alerts.filter((F.col("severity") == "danger") & (F.col("type") == "Normal"))
    return BL.listed(BL.unblock(t.blocklist, harmless, "source_ip"))


@register
def union_samples(t: Tables) -> DataFrame:
    samples = t.flows.select(*KEY, "PacketSize", FLOW_LABEL)
    normal = samples.filter(F.col(FLOW_LABEL) == "Normal").withColumn("label", F.lit(0))
    attack = samples.filter(F.col(FLOW_LABEL) != "Normal").withColumn("label", F.lit(1))
    return PF.union_samples(normal, attack)


@register
def alerts_append(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    new = t.packets.select(
        (-1 - F.col("packet_id")).alias("id"), "ts",
        F.when(kind == "error", "danger").when(kind == "view", "warning").alias("severity"),
        F.when(kind == "error", F.concat(F.lit('{"traffic":{"src_ip":"'), "src_ip", F.lit('"}}')))
         .alias("details"))
    return AL.append_alerts(t.alerts, new)


# --- scalar functions ---

@register
def ip_to_int(t: Tables) -> DataFrame:
    return t.flows.select(*KEY, N.ip_to_int("SrcIP").alias("src"), N.ip_to_int("DstIP").alias("dst"))


@register
def protocol_code(t: Tables) -> DataFrame:
    return t.flows.select(*KEY, N.protocol_code(F.lower("Protocol")).alias("code"))


@register
def threat_level(t: Tables) -> DataFrame:
    label = F.col("prediction")
    return t.predictions.select(
        "id", L.threat_level(label).alias("level"), L.counts_as_attack(label).alias("counts_as_attack"),
        L.ensemble_level(label).alias("ensemble_level"), L.chart_class(label).alias("series"))


@register
def alert_source_ip(t: Tables) -> DataFrame:
    return AL.with_source(t.alerts).select("id", "source_ip")


@register
def zscore_features(t: Tables) -> DataFrame:
    numeric = PF.numeric_features(t.flows.select(*FLOW_FEATURES))
    moments = PF.fit_moments(t.flows, numeric)
    return rounded(PF.standardise(t.flows, moments, KEY), *numeric)


@register
def anomaly_verdict(t: Tables) -> DataFrame:
    normal = t.flows.filter(F.col(FLOW_LABEL) == "Normal")
    limit = PF.anomaly_threshold(normal, "FlowRate").first()["threshold"]
    verdicts = PF.anomaly_verdicts(t.flows, "FlowRate", limit, KEY)
    return rounded(verdicts, "anomaly_score", "threshold", "confidence", places=4)


# --- votes and metrics ---

@register
def ensemble_vote_(t: Tables) -> DataFrame:
    voted = ensemble_vote(t.votes, keep=KEY)
    return voted.withColumns({"votes": F.to_json("votes"), "models_used": F.to_json("models_used")})


@register
def feature_matrix(t: Tables) -> DataFrame:
    return MF.feature_matrix(t.flows, keep=KEY)


def _voted(t: Tables) -> DataFrame:
    keep = [FLOW_LABEL, *DETECTORS]
    return ensemble_vote(t.votes, keep=keep).select(*keep, F.col("prediction").alias("ensemble"))


@register
def weighted_metrics(t: Tables) -> DataFrame:
    metrics = MM.weighted_metrics(_voted(t), FLOW_LABEL, "ensemble")
    return rounded(metrics, "accuracy", "precision", "recall", "f1_score")


@register
def class_report(t: Tables) -> DataFrame:
    report = MM.class_report(_voted(t), FLOW_LABEL, "ensemble")
    return rounded(report, "precision", "recall", "f1_score")


@register
def model_report(t: Tables) -> DataFrame:
    report = MM.model_report(_voted(t), FLOW_LABEL, [*DETECTORS, "ensemble"])
    return rounded(report, "accuracy", "precision", "recall", "f1_score")
