"""Time helpers. "Now" is always a parameter; left out, it is the newest timestamp of the table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AsOf = datetime | str | Column | None


def as_of_column(df: DataFrame, as_of: AsOf = None, ts: str = "ts",
                 back: str | None = None) -> Column:
    """The point in time `back` (an interval such as "5 MINUTES") before `as_of`.

    The subtraction happens inside the subquery, so that what the outer filter compares with is one
    value the scan can be given.
    """
    if as_of is None:
        newest = F.max(ts)
        return df.agg((newest - _interval(back) if back else newest).alias("as_of")).scalar()
    point = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    return point - _interval(back) if back else point


def _interval(text: str) -> Column:
    return F.expr(f"INTERVAL {text}")


def micros(ts: Column | str) -> Column:
    return F.unix_micros((ts if isinstance(ts, Column) else F.col(ts)).cast("timestamp"))


def iso_text(ts: Column | str) -> Column:
    """ISO-8601 text; the fraction is left out when it is zero."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(text, r"\.000000$", "")


def parse_iso(text: Column | str) -> Column:
    """Timestamp from text; malformed or missing text gives null."""
    return (text if isinstance(text, Column) else F.col(text)).try_cast("timestamp_ntz")
