"""An alert table that lives across calls: stable ids, acknowledgements, and writes that count as a whole or not at all.

Each change (alerts appended, ids acknowledged) is a folder of Parquet files of its own; a manifest per version lists the
folders that make up the table and the next free id. Manifests are put under the next number by one rename: of two
writers one gets it, the other starts again from what is there then. Files that no manifest names don't exist for
readers. `compact` writes the merged state as one folder; older versions stay readable.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.operators.ordering import rank_rows
from flowsentry.session import shared_dir
from flowsentry.sources.files import names, put_once, read_text


class AlertTable:
    """Alerts in a folder. `order` are the columns that say in which order new alerts get their ids."""

    def __init__(self, spark: SparkSession, folder: str | None = None, order: tuple[str, ...] = ("ts",)):
        self.spark, self.order = spark, order
        self.folder = folder or f"{shared_dir(spark)}/alerts-{uuid.uuid4()}"

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in names(self.spark, f"{self.folder}/versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """What makes up a version: folders of alerts and of acknowledged ids, and the next free id."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "alerts": [], "acknowledged": [], "next_id": 1}
        return {"version": version, **json.loads(read_text(self.spark, f"{self.folder}/versions/{version:012d}.json"))}

    def _put(self, base: dict, **changed) -> bool:
        """The next version, if nobody put it meanwhile."""
        content = {k: changed.get(k, base[k]) for k in ("alerts", "acknowledged", "next_id")}
        return put_once(self.spark, f"{self.folder}/versions/{base['version'] + 1:012d}.json", json.dumps(content))

    def append(self, alerts: DataFrame) -> tuple[int, int]:
        """Add alerts under new ids, in the table's order. Returns the first id and the one after the last."""
        place = f"data/{uuid.uuid4()}"
        rows = alerts.drop("id", "acknowledged")
        # numbered from 1 on; the manifest says from which id on these numbers count, so a lost race costs no second write
        numbered = rank_rows(rows, [F.col(c).asc() for c in self.order], "number")
        numbered.write.parquet(f"{self.folder}/{place}")
        count = self.spark.read.parquet(f"{self.folder}/{place}").count()
        while True:
            base = self.manifest()
            first = base["next_id"]
            if self._put(base, alerts=[*base["alerts"], [place, first - 1]], next_id=first + count):
                return first, first + count

    def acknowledge(self, ids: DataFrame, key: str = "id") -> None:
        """Mark ids as acknowledged, also such as will come only later to those who read an older version."""
        place = f"data/{uuid.uuid4()}"
        ids.select(F.col(key).cast("bigint").alias("id")).distinct().write.parquet(f"{self.folder}/{place}")
        while True:
            base = self.manifest()
            if self._put(base, acknowledged=[*base["acknowledged"], place]):
                return

    def read(self, version: int | None = None) -> DataFrame:
        """All alerts of a version with id and acknowledged."""
        made = self.manifest(version)
        if not made["alerts"]:
            raise ValueError("the alert table is empty")
        parts = [self.spark.read.parquet(f"{self.folder}/{place}").withColumn("id", F.col("number") + offset).drop("number")
                 for place, offset in made["alerts"]]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part, allowMissingColumns=True)
        before = F.coalesce("before", F.lit(False)) if "before" in rows.columns else F.lit(False)
        if not made["acknowledged"]:
            return rows.withColumn("acknowledged", before).drop("before")
        seen = self.spark.read.parquet(*[f"{self.folder}/{p}" for p in made["acknowledged"]]).distinct()
        return rows.join(seen.withColumn("_seen", F.lit(True)), "id", "left") \
            .withColumn("acknowledged", before | F.col("_seen").isNotNull()).drop("_seen", "before")

    def compact(self) -> None:
        """One folder for all alerts so far; changes that others put meanwhile stay."""
        base = self.manifest()
        place = f"data/{uuid.uuid4()}"
        self.read(base["version"]).withColumnsRenamed({"id": "number", "acknowledged": "before"}) \
            .write.parquet(f"{self.folder}/{place}")
        while True:
            now = self.manifest()
            kept = [a for a in now["alerts"] if a not in base["alerts"]]
            if self._put(now, alerts=[[place, 0], *kept],
                         acknowledged=[a for a in now["acknowledged"] if a not in base["acknowledged"]]):
                return
