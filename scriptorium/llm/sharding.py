"""Sharding: extendible hashing into shards of a byte limit.

The directory is indexed by the first bits of a row's 64-bit hash. Bytes are
summed per prefix of a depth that total bytes and limit suggest. A prefix is a
shard as soon as its bytes fit; only oversized ones split on another bit, one bit
at a time, so small neighbours share a shard of smaller depth. Prefixes that are
still too large at the first depth are summed again by the whole hash. What no bit
can split (copies of one row, or a row above the limit) gets overflow pages: its
rows are dealt over pages of at most the limit, each task filling pages of its own, a
single larger row alone on its page.

Only sums per prefix are shuffled to find the directory, and the directory is a
table that never goes to the driver; it is broadcast up to `BROADCAST_ENTRIES`
entries and joined by a shuffle beyond that.

Defined results: null text has 0 bytes; null and repeated doc_id hash like others
and stay; an empty table gives no rows; other columns are kept (clashing names `shard`
`depth` `page` `n_bytes` are replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, document_text

BITS = 64
BROADCAST_ENTRIES = 1_000_000


def _prefix(of: Column, have: int, depth: int | Column) -> Column:
    """The first `depth` of the `have` bits in `of`."""
    if isinstance(depth, int):
        return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(of, have - depth)
    return F.when(depth == 0, F.lit(0)).otherwise(F.call_function("shiftrightunsigned", of, F.lit(have) - depth))


def _directory(sums: DataFrame, top: int, deepest: int, limit: int) -> DataFrame:
    """(prefix, depth): the depth, from `top` on, at which each prefix of the deepest level first fits; null if nowhere.

    Bytes are summed per level and node; a node that fits under one that does not is a shard.
    """
    by_level = sums.select(
        "prefix",
        "bytes",
        F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), _prefix(F.col("prefix"), deepest, d).alias("at")) for d in range(top, deepest + 1)))).alias("x"),
    ).select("prefix", "bytes", "x.depth", "x.at")
    fits = by_level.groupBy("depth", "at").agg(F.sum("bytes").alias("_level")).where(F.col("_level") <= limit).select("depth", "at")
    below = fits.where(F.col("depth") < deepest).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.shiftleft("at", 1), F.shiftleft("at", 1).bitwiseOR(F.lit(1)))).alias("at"))
    shards = fits.join(below, ["depth", "at"], "left_anti")
    own = by_level.join(shards, ["depth", "at"], "left_semi").select("prefix", "depth")
    return sums.select("prefix").join(own, "prefix", "left")


def _maybe_broadcast(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ENTRIES else table


def _bits(hash_: Column, depth: Column) -> Column:
    return F.substring(F.lpad(F.bin(hash_), BITS, "0"), F.lit(1), depth)


def shard(docs: DataFrame, limit: int, key: tuple[str, ...] = ("doc_id", "text"), space: Workspace | None = None) -> DataFrame:
    """Add `n_bytes`, `shard` (its prefix as bits, and its page after a dot if it has pages), `depth` and `page`.

    The result reads the directory's tables, which are in `space`: clear it once the result is stored.
    """
    space = space or Workspace()
    rows = docs.drop("shard", "depth", "page", "n_bytes")
    rows = rows.withColumn("n_bytes", F.octet_length(document_text()).cast("long")).withColumn("_hash", F.xxhash64(*key))
    total = docs.select(F.sum(F.octet_length(document_text()).cast("long"))).first()[0] or 0
    first = min(36, max(4, math.ceil(math.log2(total / limit + 1)) + 4))
    sums = rows.groupBy(_prefix(F.col("_hash"), BITS, first).alias("prefix")).agg(F.sum("n_bytes").alias("bytes"))
    upper = space.stash(_directory(sums, 0, first, limit), "directory")
    entries = upper.select(F.col("prefix").alias("_p"), F.col("depth").alias("_depth"))
    rows = rows.join(_maybe_broadcast(entries), _prefix(F.col("_hash"), BITS, first) == F.col("_p")).drop("_p")
    out = rows.where(F.col("_depth").isNotNull()).withColumn("page", F.lit(None).cast("long"))
    if not upper.where(F.col("depth").isNull()).isEmpty():
        over = rows.where(F.col("_depth").isNull()).drop("_depth")
        sums = over.groupBy(F.col("_hash").alias("prefix")).agg(F.sum("n_bytes").alias("bytes"))
        lower = space.stash(_directory(sums, first + 1, BITS, limit), "directory")
        entries = lower.select(F.col("prefix").alias("_p"), F.col("depth").alias("_depth"))
        over = over.join(_maybe_broadcast(entries), F.col("_hash") == F.col("_p")).drop("_p")
        fits = over.where(F.col("_depth").isNotNull()).withColumn("page", F.lit(None).cast("long"))
        out = out.unionByName(fits).unionByName(_pages(over.where(F.col("_depth").isNull()).drop("_depth"), limit))
    name = F.concat(_bits(F.col("_hash"), F.col("_depth")), F.when(F.col("page").isNull(), F.lit("")).otherwise(F.concat(F.lit("."), F.col("page").cast("string"))))
    return out.withColumn("shard", name).withColumnRenamed("_depth", "depth").drop("_hash")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Deal rows of equal hash over overflow pages: each task numbers its own pages, so no task gets all rows."""
    of_task = Window.partitionBy("_hash", "_task")
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.max("n_bytes").over(of_task), F.lit(1))))
    numbered = rows.withColumn("_task", F.spark_partition_id().cast("long")).withColumn("_k", F.row_number().over(of_task.orderBy("n_bytes")) - 1)
    page = F.shiftleft(F.col("_task"), 32) + F.floor(F.col("_k") / per_page).cast("long")
    return numbered.withColumn("page", page).withColumn("_depth", F.lit(BITS)).drop("_task", "_k")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows written by one task: a shard holds at most the limit, and a larger row has its own."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)
