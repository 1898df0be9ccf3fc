"""Near copies: BagMinHash bands propose candidates, multiset overlap of five-word shingles decides.

Defined results: texts without words form a class only with texts equal to them; a text of fewer than five words
is one shingle of all of them; null is the empty text. Rows repeated under one id are rows of their text's class.
Rows without an id share their text's class, whose id is null if no row of the class has one. An empty table gives
an empty result. Other columns of the input are never looked at.

How it stays whole and small: equal texts are one node from the start. In each band bucket every node meets only
the bucket's hub. 1 - J is a metric, so a node near the hub can only have a link to a node outside the hub's class if
their distances to the hub differ by at most the allowed distance; all others are settled. What remains meets
through an exact prefix filter (nodes that may have a link share one of their rarest shingles), again with a few hubs
first and then every pair that is still in different classes. Pairs inside one class are never enumerated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.llm.bagminhash import signatures
from flowsentry.llm.batches import SMALL_CHUNK_BYTES, map_chunks
from flowsentry.llm.components import components, few_tasks, interpreted, no_broadcasts
from flowsentry.llm.words import encoded, mixed, shingles
from flowsentry.session import checkpointed

WORDS, SIMILARITY = 5, 0.8
# 24 bands of 4 slots miss a pair of similarity 0.8 three times in a million.
BANDS, ROWS = 24, 4
HUBS = 8


def _bags(texts, words: int):
    """Distinct shingles, their counts and the row they belong to."""
    parts = [np.unique(shingles(encoded(t), words), return_counts=True) for t in texts]
    sizes = [len(u) for u, _ in parts]
    return (np.concatenate([u for u, _ in parts]), np.concatenate([c for _, c in parts]).astype(float),
            np.repeat(np.arange(len(parts)), sizes), np.array(sizes))


def band_hashes(texts, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> list[list[int]]:
    """A hash per band of each text's signature; none for a text without words."""
    element, weight, owner, sizes = _bags(texts, words)
    made = signatures(element, weight, owner, len(sizes), bands * rows).reshape(len(sizes), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sizes), bands)).copy()
    with np.errstate(over="ignore"):
        for k in range(rows):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + made[:, :, k])
    return [x.tolist() if n else [] for x, n in zip(out.view(np.int64), sizes)]


def counted_shingles(texts, words: int = WORDS) -> list[list[int]]:
    """The multiset of a text's shingles as a set: the n-th occurrence of a shingle is an element of its own."""
    out = []
    for text in texts:
        found = np.sort(shingles(encoded(text), words))
        first = np.searchsorted(found, found)
        with np.errstate(over="ignore"):
            nth = (np.arange(len(found)) - first).astype(np.uint64)
            out.append(mixed(found + nth * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).tolist())
    return out


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS,
                similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, keys: bool = False) -> DataFrame:
    """One row per input row: its id, the id of its class (the smallest in it) and of its equal-text group.

    With `keys` also the text's own key (`text_key`) and its class's, which rows without an id have too.
    """
    with no_broadcasts(docs.sparkSession):
        return _classes(docs, id_column, text_column, words, similarity, bands, rows, keys)


def _classes(docs: DataFrame, id_column: str, text_column: str, words: int, similarity: float, bands: int, rows: int,
             keys: bool) -> DataFrame:
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    keyed = texts.withColumn("key", F.unhex(F.md5("text")))
    id_kind = texts.schema["id"].dataType

    def sketch(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column("id"), "key": batch.column("key"),
                "bands": band_hashes(batch.column("text").to_pylist(), words, bands, rows)}

    sketched = checkpointed(map_chunks(keyed, "text", T.StructType([
        T.StructField("id", id_kind), T.StructField("key", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType()))]), sketch, SMALL_CHUNK_BYTES))
    nodes = checkpointed(sketched.groupBy("key").agg(
        F.min("id").alias("copy_of"), F.min_by("bands", F.coalesce(F.col("id").cast("string"), F.lit("")))
        .alias("bands")))

    buckets = nodes.select("key", F.explode("bands").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("key").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    active = checkpointed(buckets.join(hubs.drop("size"), "bucket"))
    wanted = active.select("key").distinct()
    bags = _bags_of(keyed, nodes.select("key", "copy_of").join(wanted, "key", "left_semi"), words)

    pairs = active.filter("key != hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    compared = checkpointed(_verified(pairs, bags))
    links = compared.filter(F.col("shared") >= similarity * F.col("joint"))
    classes = few_tasks(checkpointed(components(links.select("a", "b"))))

    open_nodes = _unsettled(active, compared, classes, similarity)
    rare = few_tasks(checkpointed(_prefixes(bags.join(open_nodes, "key", "left_semi"), similarity)))
    done = compared.select("a", "b")
    with interpreted(docs.sparkSession, rare.rdd.getNumPartitions() <= 1):
        for count in (HUBS, None):
            pairs = _across(rare, classes, count, similarity).join(done, ["a", "b"], "left_anti")
            compared = few_tasks(checkpointed(_verified(pairs, bags)))
            found = compared.filter(F.col("shared") >= similarity * F.col("joint")).select("a", "b")
            done = done.union(compared.select("a", "b"))
            if found.limit(1).count() == 0:
                continue  # the classes stay as they are
            # the classes so far and the new links between them are all that later classes depend on
            known = classes.filter("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))
            classes = few_tasks(checkpointed(components(known.union(found))))

    named = nodes.select("key", "copy_of").join(classes.withColumnRenamed("node", "key"), "key", "left") \
        .withColumn("component", F.coalesce("component", "key"))
    ids = named.groupBy("component").agg(F.min("copy_of").alias("class_id"))
    named = named.join(ids, "component").select("key", "copy_of", "class_id", "component")
    extra = [F.hex("key").alias("text_key"), F.hex("component").alias("class_key")] if keys else []
    return sketched.select("id", "key").join(named, "key") \
        .select(F.col("id").alias(id_column), "class_id", "copy_of", *extra)


def text_key(text_column: str) -> Column:
    """The key of a text in the results of `near_copies`."""
    return F.upper(F.md5(F.coalesce(text_column, F.lit(""))))


def _bags_of(keyed: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """The counted shingles of one row of each wanted node."""
    chosen = keyed.join(nodes.select("key", F.col("copy_of").alias("chosen")), "key") \
        .filter(F.col("id").eqNullSafe(F.col("chosen")))

    def bag(batch: pa.RecordBatch) -> dict:
        return {"key": batch.column("key"), "items": counted_shingles(batch.column("text").to_pylist(), words)}

    made = map_chunks(chosen.select("key", "text"), "text", "key binary, items array<bigint>", bag, SMALL_CHUNK_BYTES)
    return checkpointed(made.dropDuplicates(["key"]))


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """Shared and joint number of shingles of each pair (a, b)."""
    left = bags.select(F.col("key").alias("b"), F.col("items").alias("right"))
    right = bags.select(F.col("key").alias("a"), F.col("items").alias("left"))
    met = pairs.join(left, "b").join(right, "a") \
        .withColumn("shared", F.size(F.array_intersect("left", "right")))
    return met.select("a", "b", "shared", (F.size("left") + F.size("right") - F.col("shared")).alias("joint"))


def _unsettled(active: DataFrame, compared: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Nodes of buckets that may hold a link the hub doesn't account for.

    Made in two steps: a table that is read twice within one query is planned twice, and so are the tables it is made of.
    The driver planned some fifty shuffles in one query, over and over as they ended.
    """
    met = active.filter("key != hub").join(compared.select(
        F.col("a").alias("hub"), F.col("b").alias("key"), (F.col("shared") / F.col("joint")).alias("likeness")),
        ["hub", "key"])
    outside = met.groupBy("bucket").agg(F.max(F.when(F.col("likeness") < similarity, F.col("likeness"))).alias("top"))
    # d(a, b) >= d(hub, b) - d(hub, a): a near the hub has a link outside only if its own distance reaches out there
    kept = met.join(outside.filter("top is not null"), "bucket") \
        .filter((F.col("likeness") < similarity) | (F.col("likeness") <= F.col("top") + (1 - similarity) + 1e-9))
    named = checkpointed(kept.select("bucket", "key").join(classes.withColumnRenamed("node", "key"), "key", "left")
                         .withColumn("component", F.coalesce("component", "key")))
    mixed_buckets = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")) \
        .filter("x != y").select("bucket")
    return checkpointed(named.join(mixed_buckets, "bucket", "left_semi").select("key").distinct())


def _prefixes(bags: DataFrame, similarity: float) -> DataFrame:
    """(item, key, size, own, left): each node's rarest items, so many that nodes with a link have one in common.

    Items that no other node holds can't be shared; a node with too many of them has no link and drops out. `own` is
    how many items no other node holds, `left` how many of the shareable ones come after this one.
    """
    items = bags.select("key", F.size("items").alias("size"), F.explode("items").alias("item"))
    common = items.groupBy("item").agg(F.count("*").alias("holders")).filter("holders > 1")
    ranked = items.join(common, "item").groupBy("key", "size").agg(
        F.array_sort(F.collect_list(F.struct("holders", "item"))).alias("items"))
    need = F.ceil(F.col("size") * F.lit(similarity) - 1e-9)
    return ranked.filter(F.size("items") >= need).select("key", "size", F.size("items").alias("common"), F.posexplode(
        F.slice("items", F.lit(1), (F.size("items") - need + 1).cast("int"))).alias("place", "x")).select(
        "x.item", "key", "size", (F.col("size") - F.col("common")).alias("own"),
        (F.col("common") - 1 - F.col("place")).alias("left"))


def _across(rare: DataFrame, classes: DataFrame, hubs: int | None, similarity: float) -> DataFrame:
    """Pairs of nodes in different classes that share a rare item; with `hubs`, one of them is an item's hub."""
    named = rare.join(classes.withColumnRenamed("node", "key"), "key", "left") \
        .withColumn("component", F.coalesce("component", "key"))
    open_items = named.groupBy("item").agg(F.min("component").alias("x"), F.max("component").alias("y")) \
        .filter("x != y").select("item")
    named = few_tasks(checkpointed(named.join(open_items, "item", "left_semi")))  # read twice
    centre = named
    if hubs:
        # The few nodes of each item with the fewest items of their own, a share of them at a time. They stand in the
        # middle of a crowd of edited copies: the others have their links to them, if they have any.
        part = named.withColumn("share", F.crc32("key") % 64)
        least = part.groupBy("item", "share").agg(
            F.min(F.struct("own", "key", "size", "left", "component")).alias("row"))
        least = least.groupBy("item").agg(F.slice(F.array_sort(F.collect_list("row")), 1, hubs).alias("rows"))
        centre = least.select("item", F.explode("rows").alias("row")).select("item", "row.*")
    centre = centre.select("item", F.col("key").alias("hub"), F.col("size").alias("hub_size"),
                           F.col("left").alias("hub_left"), F.col("component").alias("hub_component"))
    ordered = F.col("key") > F.col("hub") if not hubs else F.col("key") != F.col("hub")
    # at their first common item, nodes with a link still have enough items for the overlap that it takes
    needed = (F.col("size") + F.col("hub_size")) * (similarity / (1 + similarity)) - 1e-6
    met = named.join(centre, "item").filter(
        ordered & (F.col("component") != F.col("hub_component"))
        & (F.least("left", "hub_left") + 1 >= needed))
    return met.select(F.least("hub", "key").alias("a"), F.greatest("hub", "key").alias("b")).distinct()
