"""Indivisible groups into shards by best-fit-decreasing bin packing, remaining capacities in a balanced tree."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

GRAIN = 4096     # a group of at least 1/GRAIN of a shard is packed on its own
BUNDLES = 16384  # all smaller groups travel in so many bundles
CHUNK_ROWS = 8192


class CapacityTree:
    """Open bins by remaining capacity in an AVL tree of (remaining, bin)."""

    class _Node:
        __slots__ = ("key", "left", "right", "height")

        def __init__(self, key):
            self.key, self.left, self.right, self.height = key, None, None, 1

    def __init__(self):
        self._root = None

    def add(self, remaining: int, bin_id: int) -> None:
        self._root = self._insert(self._root, (remaining, bin_id))

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity that still holds ``size``."""
        best, at = None, self._root
        while at:
            if at.key[0] >= size:
                best, at = at.key, at.left
            else:
                at = at.right
        return self._drop(best)

    def take_widest(self) -> tuple[int, int] | None:
        at = self._root
        while at and at.right:
            at = at.right
        return self._drop(at.key if at else None)

    def _drop(self, key):
        if key is not None:
            self._root = self._delete(self._root, key)
        return key

    def _insert(self, at, key):
        if at is None:
            return self._Node(key)
        if key < at.key:
            at.left = self._insert(at.left, key)
        else:
            at.right = self._insert(at.right, key)
        return self._balanced(at)

    def _delete(self, at, key):
        if key < at.key:
            at.left = self._delete(at.left, key)
        elif key > at.key:
            at.right = self._delete(at.right, key)
        elif at.left is None or at.right is None:
            return at.left or at.right
        else:
            heir = at.right
            while heir.left:
                heir = heir.left
            at.key = heir.key
            at.right = self._delete(at.right, heir.key)
        return self._balanced(at)

    @staticmethod
    def _tall(at) -> int:
        return at.height if at else 0

    def _set(self, at):
        at.height = 1 + max(self._tall(at.left), self._tall(at.right))
        return at

    def _turn(self, at, up, down):
        child = getattr(at, up)
        setattr(at, up, getattr(child, down))
        setattr(child, down, self._set(at))
        return self._set(child)

    def _balanced(self, at):
        self._set(at)
        lean = self._tall(at.left) - self._tall(at.right)
        if lean > 1:
            if self._tall(at.left.left) < self._tall(at.left.right):
                at.left = self._turn(at.left, "right", "left")
            return self._turn(at, "left", "right")
        if lean < -1:
            if self._tall(at.right.right) < self._tall(at.right.left):
                at.right = self._turn(at.right, "left", "right")
            return self._turn(at, "right", "left")
        return at


def best_fit(sizes: list[int], capacity: int, shards: int | None = None) -> list[int]:
    """The bin of each size. Without ``shards`` bins open as needed, an oversize group alone in its own; with it there are
    just so many bins, and what fits nowhere goes where most room is left."""
    tree, bins, out = CapacityTree(), 0, [0] * len(sizes)
    for b in range(shards or 0):
        tree.add(capacity, b)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take_tightest(sizes[i])
        if found is None and shards:
            found = tree.take_widest()
        if found is None:
            found, bins = (capacity, bins), bins + 1
        out[i] = found[1]
        if shards or found[0] > sizes[i]:
            tree.add(found[0] - sizes[i], found[1])
    return out


def _fair_capacity(sizes: list[int], shards: int) -> int:
    """Room per shard if groups above the fair share keep a shard for themselves and the rest is shared equally."""
    total, left = sum(sizes), shards
    for size in sorted(sizes, reverse=True):
        if left == 1 or size * left <= total:
            break
        total, left = total - size, left - 1
    return -(-total // left)


def shard(docs: DataFrame, shards: int | None = 16, capacity: int | None = None) -> DataFrame:
    """Put documents into shards of near equal bytes, equal texts together.

    With ``shards`` there are exactly so many, numbered from 0; with ``capacity`` as many of that size as the packing needs.
    A group larger than a shard has one to itself. Groups below 1/GRAIN of a shard travel in BUNDLES bundles by the hash of
    the text, so the driver packs a bounded number of units: at most GRAIN per shard and the bundles.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, shard and slot (gapless from 0 in each shard). A null text counts as
    empty and shares its group. Repeated rows and null doc_ids are rows like others. An empty table gives an empty result.
    Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = written(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                               F.unhex(F.md5(text.cast("binary"))).alias("g"), F.monotonically_increasing_id().alias("rid")), "sizes")
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    share = capacity or -(-total // shards)
    bundle = F.pmod(F.xxhash64("g"), F.lit(BUNDLES))
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"))
    units = written(groups.withColumn("unit", F.when(F.col("bytes") * GRAIN >= share, F.col("g"))).withColumn("bundle", F.when(F.col("unit").isNull(), bundle))
                    .groupBy("unit", "bundle").agg(F.sum("bytes").alias("bytes")), "units")
    table = units.orderBy("unit", "bundle").toArrow()
    sizes = table.column("bytes").to_pylist()
    bins = best_fit(sizes, capacity) if capacity else best_fit(sizes, _fair_capacity(sizes, shards), shards)
    placed = docs.sparkSession.createDataFrame(table.select(["unit", "bundle"]).append_column("shard", pa.array(bins, pa.int32())))
    alone = placed.where("unit IS NOT NULL").select(F.col("unit").alias("g"), F.col("shard").alias("own"))
    bundled = placed.where("bundle IS NOT NULL").select("bundle", F.col("shard").alias("shared"))
    put = (rows.withColumn("bundle", bundle).join(F.broadcast(alone), "g", "left").join(F.broadcast(bundled), "bundle", "left")
           .select("doc_id", "size", "text_crc32", "rid", F.coalesce("own", "shared").alias("shard"))
           .withColumn("chunk", F.pmod(F.xxhash64("rid"), F.lit(max(1, n // CHUNK_ROWS)))))
    counts = put.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    slot = F.row_number().over(W.partitionBy("shard", "chunk").orderBy("rid")) - 1 + F.col("before")
    return put.join(starts, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))
