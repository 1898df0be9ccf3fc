"""Payload entropy and nested alert details."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COUNTED_ROWS = 1024


def byte_entropy(payload: Column | str) -> Column:
    """Shannon entropy in bits of the byte distribution; empty gives 0.

    The bytes of many rows are counted at once. The built-in form explodes every byte into a row of its own,
    which multiplies the data by the length of the text.
    """
    def bits(values: pd.Series) -> pd.Series:
        raw = pa.array(values, from_pandas=True).cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        out = np.zeros(len(raw))
        # so many rows at a time that their 256 counters stay small
        for first in range(0, len(raw), _COUNTED_ROWS):
            cut = ends[first:first + _COUNTED_ROWS + 1]
            length = np.diff(cut)
            row = np.repeat(np.arange(len(length)), length)
            counts = np.bincount(row * 256 + data[cut[0]:cut[-1]], minlength=256 * len(length)).reshape(-1, 256)
            share = counts / np.maximum(length, 1)[:, None]
            out[first:first + len(length)] = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1) + 0.0
        return pd.Series(out)

    return F.pandas_udf(bits, T.DoubleType())(payload)


def count_entropy(count: Column, total: Column) -> Column:
    """Entropy in bits of a group from its symbol counts: log2(N) - Σ c·log2(c) / N, in one aggregate."""
    return F.log2(total) - F.sum(count * F.log2(count)) / total


# Fields looked up in an alert's details, at the top or under `traffic`, in both spellings.
_FIELDS = ["SrcIP", "src_ip", "DstIP", "dst_ip", "SrcPort", "DstPort", "Protocol"]
_TEXTS = [T.StructField(name, T.StringType()) for name in _FIELDS]
DETAILS = T.StructType([*_TEXTS, T.StructField("traffic", T.StructType(_TEXTS))])


def parse_details(details: Column | str) -> Column:
    """The nested details of an alert as a struct, from one pass over the text."""
    return F.from_json(details, DETAILS)


def detail(parsed: Column, *paths: str) -> Column:
    """First value among several spellings of a field that is neither empty nor 0."""
    def filled(path: str) -> Column:
        value = parsed
        for name in path.split("."):
            value = value.getField(name)
        return F.when(~value.isin("", "0"), value)

    return F.coalesce(*[filled(p) for p in paths])


def alert_source(source_ip: Column | str, parsed: Column) -> Column:
    """Source address of an alert, looked up in its parsed details when the column is empty."""
    given = source_ip if isinstance(source_ip, Column) else F.col(source_ip)
    nested = detail(parsed, "SrcIP", "src_ip", "traffic.SrcIP", "traffic.src_ip")
    return F.coalesce(F.nullif(given, F.lit("")), nested, F.lit(""))
