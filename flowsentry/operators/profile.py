"""Describing and splitting training sets."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flowsentry.functions.scores import anomaly_columns, zscore
from flowsentry.operators.ordering import rank_in_group
from flowsentry.session import checkpointed

# Fixed value: added to every standard deviation.
STD_FLOOR = 1e-8
# Keys that come to the driver to tell about where a class is cut.
SAMPLED = 20_000


@dataclass(frozen=True)
class Moments:
    """Mean and population standard deviation per feature: two numbers each, kept with a model."""

    mean: dict[str, float]
    std: dict[str, float]


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share of each class. The total is summed over the few class rows."""
    counted = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("rows"))
    return counted.withColumn("ratio", F.col("rows") / F.sum("rows").over(Window.partitionBy()))


def _moment_columns(features: list[str]) -> list[Column]:
    mean = [F.avg(c).alias(f"mean_{c}") for c in features]
    return mean + [(F.stddev_pop(c) + STD_FLOOR).alias(f"std_{c}") for c in features]


def feature_moments(df: DataFrame, features: list[str]) -> DataFrame:
    """One row per feature with its mean and population deviation, from one pass over the table."""
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"mean_{c}").alias("mean"),
                     F.col(f"std_{c}").alias("std")) for c in features]
    return df.agg(*_moment_columns(features)).select(F.inline(F.array(*rows)))


def fit_moments(df: DataFrame, features: list[str]) -> Moments:
    """The moments as numbers, to be stored with a model and applied to other rows."""
    row = df.agg(*_moment_columns(features)).first()
    return Moments({c: row[f"mean_{c}"] for c in features}, {c: row[f"std_{c}"] for c in features})


def standardise(df: DataFrame, moments: Moments, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[zscore(F.col(c), moments.mean[c], moments.std[c]).alias(c)
                              for c in moments.mean])


def stratified_split(df: DataFrame, label: str, key: list[str], train: float = 0.8, whole: int = 2_000_000) -> DataFrame:
    """Mark the first share of every class, in key order, as training rows and the rest as test rows.

    Tables of at most `whole` rows are numbered whole, a class holding most of the table by many tasks. In larger ones
    only labels and keys are read to find each class's last training key, and the rows stay where they are.
    """
    last = None
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    if sum(sizes.values()) > whole:
        last = _last_keys(df, label, key, train, sizes)
    if last is not None:
        first = F.lit(False)
        for name, cut in last.items():
            own = _up_to(df, key, cut) if cut is not None else F.lit(False)
            first = F.when(F.col(label).eqNullSafe(F.lit(name)), own).otherwise(first)
        return df.withColumn("split", F.when(first, "train").otherwise("test"))
    order = [F.col(k) for k in key]
    numbered = rank_in_group(df, [label], order, "_rank", "_size")
    split = F.when(F.col("_rank") <= F.floor(F.col("_size") * train), "train").otherwise("test")
    return numbered.withColumn("split", split).drop("_rank", "_size")


def _up_to(df: DataFrame, key: list[str], cut: tuple) -> Column:
    """Whether a row's key is at most the given one; nulls come first, as in sorting."""
    kinds = df.schema
    return F.struct(*key) <= F.struct(*[F.lit(v).cast(kinds[k].dataType).alias(k) for k, v in zip(key, cut)])


def _last_keys(df: DataFrame, label: str, key: list[str], train: float, sizes: dict) -> dict | None:
    """The key of each class's last training row (None without one), exact. None if rows that share it lie on both
    sides, which only numbers can tell apart.

    A sample says between which keys it lies, a count says how many rows come before those, and the rows between,
    a few hundredths, are numbered.
    """
    rows, order = df.select(label, *key), [F.col(k) for k in key]
    wanted = {name: math.floor(size * train) for name, size in sizes.items()}
    draw = F.pmod(F.xxhash64(F.lit(11), *key), F.lit(1 << 30))
    drawn = rows.filter(draw < int((1 << 30) * min(1.0, SAMPLED / sum(sizes.values())))) \
        .groupBy(label, *key).count().orderBy(*order).limit(4 * SAMPLED).collect()
    between = {}
    for name in sizes:
        own = [tuple(r[k] for k in key) for r in drawn if r[label] == name]
        at, room = int(len(own) * train), int(4 * math.sqrt(len(own))) + 1
        between[name] = (own[at - room] if at >= room else None, own[at + room] if at + room < len(own) else None)
    below, inside = F.lit(False), F.lit(False)
    for name, (low, high) in between.items():
        mine = F.col(label).eqNullSafe(F.lit(name))
        under = _up_to(df, key, low) if low else F.lit(False)
        below = F.when(mine, under).otherwise(below)
        inside = F.when(mine, ~under & (_up_to(df, key, high) if high else F.lit(True))).otherwise(inside)
    before = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count_if(below).alias("n")).collect()}
    place = F.lit(-1)
    for name in sizes:
        place = F.when(F.col(label).eqNullSafe(F.lit(name)), F.lit(wanted[name] - before[name])).otherwise(place)
    # the last training row and the first test row
    found = rank_in_group(rows.filter(inside), [label], order, "_rank") \
        .filter(F.col("_rank").between(place, place + 1)).withColumn("_first", F.col("_rank") == place).collect()
    ends = {(r[label], r["_first"]): tuple(r[k] for k in key) for r in found}
    last = {}
    for name, many in wanted.items():
        cut, after = ends.get((name, True)), ends.get((name, False))
        if many == 0:
            last[name] = None
        elif cut is None or cut == after or (after is None and many < sizes[name]) or any(v != v for v in cut):
            return None
        else:
            last[name] = cut
    return last


def plain_split(df: DataFrame, key: list[str], train: float = 0.8, seed: int = 42) -> DataFrame:
    """Mark about that share of the rows for training. The mark depends on the key alone, so it stays the
    same when a lost partition is computed again."""
    draw = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(10_000))
    return df.withColumn("split", F.when(draw < int(train * 10_000), "train").otherwise("test"))


def bounded_sample(df: DataFrame, label: str, key: list[str], rows: int, least: int = 200) -> DataFrame:
    """About `rows` rows, every class in its proportion but with at least `least` rows or all it has.

    Whether a row is in depends on the hash of its key alone, so the choice stays the same when a lost
    partition is computed again.
    """
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(sizes.values())
    if not rows or total <= rows:
        return df
    draw = F.pmod(F.xxhash64(F.lit(7), *key), F.lit(1 << 30)) / (1 << 30)
    share = F.lit(rows / total)
    for name, size in sizes.items():
        if size * rows / total < least:
            share = F.when(F.col(label).eqNullSafe(F.lit(name)), F.lit(min(1.0, least / size))).otherwise(share)
    return df.filter(draw < share)


def gathered(sample: DataFrame, parts: int) -> DataFrame:
    """A bounded sample in a few partitions for repeated reading. The table that it is drawn from is read before that, by
    as many tasks as it has partitions."""
    return checkpointed(sample).coalesce(parts)


def stratified_folds(df: DataFrame, label: str, key: list[str], folds: int) -> DataFrame:
    """Fold number from 0 for every row, spread evenly inside each class."""
    numbered = rank_in_group(df, [label], [F.col(k) for k in key], "_rank")
    return numbered.withColumn("fold", (F.col("_rank") % folds).cast("int")).drop("_rank")


def dataset_profile(split: DataFrame, label: str, normal: str, features: list[str]) -> DataFrame:
    """Features, rows and attack share of the training and the test part."""
    train, test = F.col("split") == "train", F.col("split") == "test"
    attack = F.coalesce(F.col(label) != normal, F.lit(False))
    counts = split.agg(F.count_if(train).alias("n_train_samples"), F.count_if(test).alias("n_test_samples"),
                       F.count_if(train & attack).alias("_train"), F.count_if(test & attack).alias("_test"))
    return counts.select(
        F.lit(len(features)).alias("n_features"), "n_train_samples", "n_test_samples",
        (F.col("_train") / F.nullif("n_train_samples", F.lit(0))).alias("train_attack_ratio"),
        (F.col("_test") / F.nullif("n_test_samples", F.lit(0))).alias("test_attack_ratio"))


def union_samples(*sets: DataFrame) -> DataFrame:
    """Labelled sets on top of each other, matched by column name."""
    whole = sets[0]
    for more in sets[1:]:
        whole = whole.unionByName(more)
    return whole


def numeric_features(df: DataFrame, leave_out: list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in leave_out]


def anomaly_threshold(scores: DataFrame, score: str) -> DataFrame:
    """Mean, population deviation, and the threshold two deviations above the mean."""
    mean, std = F.avg(score), F.stddev_pop(score)
    return scores.agg(mean.alias("mean_error"), std.alias("std_error"),
                      (mean + 2 * std).alias("threshold"))


def anomaly_verdicts(scores: DataFrame, score: str, threshold: float, keep: list[str]) -> DataFrame:
    columns = anomaly_columns(F.col(score), F.lit(float(threshold)))
    return scores.select(*keep, *[c.alias(name) for name, c in columns.items()])
