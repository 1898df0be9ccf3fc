"""Majority vote over detector outputs that stand side by side in one row. No shuffle."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.labels import ensemble_level
from flowsentry.schemas import DETECTORS


def _is(detector: str, label: Column) -> Column:
    return F.coalesce(F.col(detector) == label, F.lit(False))


def with_vote_counts(scored: DataFrame, detectors: list[str]) -> DataFrame:
    """Add `_n_<detector>`: how many detectors gave the same label, 0 for a detector without one.

    The counts come out of a generator, which keeps later filters from being pushed below it. Pushed
    down, they would have every detector's output computed once more for each comparison made here.
    """
    counts = [reduce(add, [_is(other, F.col(d)).cast("int") for other in detectors]).alias(f"_n_{d}")
              for d in detectors]
    return scored.select("*", F.inline(F.array(F.struct(*counts))))


def _two_places(value: Column) -> Column:
    cents = F.floor(value * 100 + 0.5)
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"))


def ensemble_vote(scored: DataFrame, detectors: list[str] = DETECTORS,
                  keep: list[str] | None = None) -> DataFrame:
    """Winning label, level, mean confidence of its voters, vote counts and a readable detail.

    Expects a column per detector with its label and one named `<detector>_confidence`. A null label is
    no vote. Ties go to the detector that comes first; no votes at all give Unknown.
    """
    counted = with_vote_counts(scored, detectors)
    numbers = [F.col(f"_n_{d}") for d in detectors]
    decided = counted.withColumn("_top", F.greatest(*numbers) if len(numbers) > 1 else numbers[0])
    decided = decided.withColumn("_winner", F.coalesce(*[
        F.when((number == F.col("_top")) & (number > 0), F.col(d))
        for d, number in zip(detectors, numbers)]))

    winner, some = F.col("_winner"), F.col("_top") > 0
    voters = reduce(add, [F.col(d).isNotNull().cast("int") for d in detectors])
    confidence = reduce(add, [F.when(_is(d, winner), F.col(f"{d}_confidence")).otherwise(0.0)
                              for d in detectors])
    entries = []
    for place, d in enumerate(detectors):
        unseen = [~_is(earlier, F.col(d)) for earlier in detectors[:place]]
        entry = F.array(F.struct(F.col(d).alias("label"), F.col(f"_n_{d}").alias("count")))
        none = F.array().cast("array<struct<label:string,count:int>>")
        entries.append(F.when(reduce(and_, unseen, F.col(d).isNotNull()), entry).otherwise(none))
    parts = [F.concat(F.lit(f"{d}: "), F.col(d), F.lit(" ("), _two_places(F.col(f"{d}_confidence")),
                      F.lit(")")) for d in detectors]
    heading = F.concat(F.lit("Majority Vote: "), winner, F.lit(" ("), F.col("_top").cast("string"),
                       F.lit("/"), voters.cast("string"), F.lit("). "))
    used = F.create_map(*[x for d in detectors for x in (F.lit(d), F.col(d).isNotNull())])
    return decided.select(
        *(keep or [c for c in scored.columns if c not in detectors]),
        F.coalesce(winner, F.lit("Unknown")).alias("prediction"),
        F.when(some, ensemble_level("_winner")).alias("threat_level"),
        F.when(some, confidence / F.col("_top")).otherwise(0.0).alias("confidence"),
        F.when(some, F.concat(heading, F.concat_ws(", ", *parts)))
         .otherwise("No models available").alias("details"),
        F.map_from_entries(F.flatten(F.array(*entries))).alias("votes"),
        used.alias("models_used"))
