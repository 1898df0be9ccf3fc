"""Reading labelled flows, feature/label pairs, packets and packet streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.operators.joins import labelled_features
from flowsentry.schemas import FLOW, FLOW_LABEL, PACKET, TRAFFIC


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_flows(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Labelled flows from headered CSV or parquet. Columns may come in any order; the label must be there."""
    if fmt != "csv":
        flows = spark.read.format(fmt).load(path)
    else:
        header = spark.read.option("header", True).csv(path).columns
        known = {field.name: field for field in FLOW.fields}
        schema = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
        flows = spark.read.schema(schema).option("header", True).csv(path)
    if FLOW_LABEL not in flows.columns:
        raise ValueError(f"{path} has no column {FLOW_LABEL}")
    return flows


def read_features_and_labels(spark: SparkSession, features: str, labels: str, key: str,
                             fmt: str = "parquet", feature_schema: T.StructType | None = None,
                             label_schema: T.StructType | None = None) -> DataFrame:
    """Features and labels stored apart, joined on their row key. CSV without a schema is scanned for one."""
    def load(path: str, schema: T.StructType | None) -> DataFrame:
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.option("header", True).option("inferSchema", schema is None)
        return (reader.schema(schema) if schema else reader).load(path)

    return labelled_features(load(features, feature_schema), load(labels, label_schema), key)


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(PACKET)
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)


def packet_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                  schema: T.StructType = PACKET, max_files: int | None = None) -> DataFrame:
    """Packets arriving as files."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def packet_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Packets arriving as JSON messages on a topic. Needs the Kafka connector on the class path."""
    messages = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
                .option("subscribe", topic).load())
    return messages.select(F.from_json(F.col("value").cast("string"), PACKET).alias("p")).select("p.*")


# Keys of a free-form traffic record, in both accepted spellings.
RECORD_KEYS = [
    "timestamp", "SrcIP", "src_ip", "DstIP", "dst_ip", "SrcPort", "src_port", "DstPort",
    "dst_port", "Protocol", "protocol", "bytes", "BytesSent", "BytesReceived", "PacketSize",
]
RECORD_NUMBERS = ["SrcPort", "src_port", "DstPort", "dst_port"]
RECORD_TOTALS = ["bytes", "BytesSent", "BytesReceived", "PacketSize"]


def parse_records(records: DataFrame, text: str = "record") -> DataFrame:
    """Free-form JSON records as columns, parsed once per row.

    The two spellings of the protocol key differ in case only, so the filled one is kept as `Protocol`.
    """
    rest = [c for c in records.columns if c != text]
    names = [f"_{i}" for i in range(len(RECORD_KEYS))]
    wide = records.select(*rest, F.json_tuple(text, *RECORD_KEYS).alias(*names))
    by_key = {key: F.col(name) for key, name in zip(RECORD_KEYS, names)}
    lower = by_key.pop("protocol")
    by_key["Protocol"] = F.coalesce(F.nullif(by_key["Protocol"], F.lit("")), lower)
    for key in RECORD_NUMBERS:
        by_key[key] = by_key[key].try_cast("int")
    for key in RECORD_TOTALS:
        by_key[key] = by_key[key].try_cast("double").cast("bigint")
    return wide.select(*rest, *[value.alias(key) for key, value in by_key.items()])


def typed_traffic(df: DataFrame) -> DataFrame:
    """Only the columns of normalised traffic, in their types."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in TRAFFIC.fields])
