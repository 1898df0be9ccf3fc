import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowsentry.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """A small frame from rows and a schema, with text timestamps cast to wall-clock ones."""
    def build(rows, schema):
        df = spark.createDataFrame(rows, schema)
        return df.withColumn("ts", df["ts"].cast("timestamp_ntz")) if "ts" in df.columns else df

    return build
