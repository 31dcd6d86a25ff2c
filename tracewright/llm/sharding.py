"""Sharding: size-weighted key samples give splitters, records are range-partitioned, overfull ranges subdivided."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, ship

#: Samples for each range, ranges for each shard, rows of a range about, and most ranges (what the driver holds).
OVERSAMPLE, RANGES_A_SHARD, RANGE_ROWS, MOST_RANGES = 32, 4, 200_000, 100_000
#: A range above so many times the mean is subdivided; so often at most.
OVERFULL, ROUNDS = 1.6, 12
#: Groups of equal texts of more than a shard's bytes over this are placed one by one.
GROUP_SHARE = 512


def place(keys: np.ndarray, ties: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Range of each (key, tie): how many splitters are at or below it."""
    if not len(splitters):
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(splitters["key"], keys, "left")
    end = np.searchsorted(splitters["key"], keys, "right")
    out = end.astype(np.int64)
    for i in np.flatnonzero(at < end):
        out[i] = at[i] + np.searchsorted(splitters["tie"][at[i] : end[i]], ties[i], "right")
    return out


def choose(sample: list[tuple[int, int]], wanted: int) -> np.ndarray:
    """Quantiles of a size-weighted sample, as sorted distinct (key, tie) splitters."""
    kind = [("key", "i8"), ("tie", "i8")]
    got = np.sort(np.array(sample, kind), order=["key", "tie"])
    if not len(got) or wanted < 2:
        return got[:0]
    return np.unique(got[(np.arange(1, wanted) * len(got)) // wanted])


def fill_level(loads: list[int], rest: int) -> float:
    """The level up to which shards are filled so that the rest fits above their loads."""
    low = sorted(loads)
    for k in range(1, len(low) + 1):
        level = (rest + sum(low[:k])) / k
        if k == len(low) or level <= low[k]:
            return level
    return 0.0


def assign(groups: list[tuple[int, int, int]], shards: int, mean: float) -> tuple[dict[int, tuple[int, int]], list[int]]:
    """(key, bytes, rows) of large groups, the largest first, to the least filled shard: shard and rows before by key; bytes by shard.

    A group larger than a shard is not assigned, as it has to be cut.
    """
    heap = [(0, s) for s in range(shards)]
    rows, placed = [0] * shards, {}
    for key, size, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        if size > mean:
            continue
        load, s = heapq.heappop(heap)
        placed[key] = (s, rows[s])
        rows[s] += n
        heapq.heappush(heap, (load + size, s))
    return placed, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) of every record.

    Records are ordered by a hash of the text, then of the id, and this order is cut where the
    shards are full, between equal texts: a group's shard is that of the middle of its bytes.
    Groups of more than a share (1 / GROUP_SHARE) of a shard go first, whole, each to the least
    filled shard; one larger than a shard is cut between records. Sizes so differ by such a share
    or a record, unless groups of whole shards leave no other way. A null text counts as empty
    (size: overhead, crc32 0); null and repeated ids keep their rows; an empty table gives no
    rows. The driver holds samples, ranges within MOST_RANGES, and GROUP_SHARE large groups for
    each shard at most.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = scratch.keep(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text).cast("long") + overhead).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        )
    )
    n, total, largest = plain.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    total = total or 1
    large = plain.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where(F.col("bytes") > total / shards / GROUP_SHARE)
    groups = [tuple(r) for r in large.collect()]  # GROUP_SHARE for each shard at most
    placed_groups, loads = assign(groups, shards, total / shards)
    rest = total - sum(loads)
    level = fill_level(loads, rest)
    bounds = np.cumsum([max(0.0, level - x) for x in loads]).tolist()
    known = [(key, *placed_groups.get(key, (None, None))) for key, _, _ in groups]
    named = F.broadcast(spark.createDataFrame(known, "key long, own int, rows_before_group long"))
    is_large = F.col("large").isNotNull()
    base = plain.join(named.withColumn("large", F.lit(True)), "key", "left").select(
        "id", "size", "text_crc32", "key", "own", "rows_before_group", "large", F.when(is_large, F.xxhash64("id", F.lit(5))).otherwise(F.lit(0).cast("long")).alias("tie"), F.when(F.col("own").isNull(), F.col("size")).otherwise(0).alias("flow")
    )
    ranges = min(MOST_RANGES, max(RANGES_A_SHARD * shards, math.ceil(n / RANGE_ROWS)))
    mean = total / ranges

    def sampled(rows: DataFrame, seed: int) -> list[tuple[int, int]]:
        chance = F.col("size") * F.lit(OVERSAMPLE / mean)
        return [tuple(r) for r in rows.where(F.rand(seed) < chance).select("key", "tie").collect()]

    splitters = choose(sampled(base, 1), ranges)

    def placed(cuts: np.ndarray) -> DataFrame:
        @F.pandas_udf("long")
        def range_of(key: pd.Series, tie: pd.Series) -> pd.Series:
            return pd.Series(place(key.to_numpy(), tie.to_numpy(), cuts))

        return base.withColumn("range", range_of("key", "tie"))

    for turn in range(ROUNDS):
        rows = placed(splitters)
        sums = {r[0]: r[1] for r in rows.groupBy("range").agg(F.sum("size")).collect()}
        over = [r for r, s in sums.items() if s > OVERFULL * mean + 2 * largest]
        if not over or len(splitters) > MOST_RANGES:
            break
        more = sampled(rows.where(F.col("range").isin(over)), 2 + turn)
        extra = choose(more, 1 + math.ceil(2 * sum(sums[r] for r in over) / mean))
        grown = np.unique(np.concatenate([splitters, extra]))
        if len(grown) == len(splitters):
            break  # equal rows, and small groups, cannot be told apart
        splitters = grown
    rows = placed(splitters)
    flows = (F.col("own").isNull()).cast("long")
    per = sorted(tuple(r) for r in rows.groupBy("range").agg(F.sum("flow"), F.sum(flows), F.count("*")).collect())
    offsets, before = [], (0, 0, 0)
    for r, *sums in per:
        offsets.append((r, *before))
        before = tuple(x + y for x, y in zip(before, sums, strict=True))
    starts = F.broadcast(spark.createDataFrame(offsets, "range long, bytes_before long, flows_before long, rows_before long"))  # at most MOST_RANGES and the subdivided ones
    in_order = Window.partitionBy("range").orderBy("key", "tie", "id", "size")
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("range", "key")
    ranked = (
        rows.withColumn("upto", F.sum("flow").over(upto))
        .withColumn("flows", F.sum(flows).over(upto))
        .withColumn("rank", F.row_number().over(in_order).cast("long"))
        .withColumn("first_byte", F.min(F.col("upto") - F.col("flow")).over(group))
        .withColumn("group_bytes", F.sum("flow").over(group))
        .join(starts, "range")
    )
    middle = F.col("bytes_before") + F.when(is_large, F.col("upto") - F.col("size") / 2).otherwise(F.col("first_byte") + F.col("group_bytes") / 2)
    by_bytes = F.least(F.lit(shards - 1), F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= middle)))
    ranked = scratch.keep(
        ranked.select(
            "id", "size", "text_crc32", "key", "own", "rows_before_group", F.coalesce("own", by_bytes).cast("int").alias("shard"),
            F.when(F.col("own").isNull(), F.col("flows_before") + F.col("flows")).alias("flow_rank"), (F.col("rows_before") + F.col("rank")).alias("rank"),
        )
    )
    of_shard = F.broadcast(ranked.where("own is null").groupBy("shard").agg(F.min("flow_rank").alias("first"), F.count("*").alias("n_flow")))  # a row for each shard
    of_group = F.broadcast(ranked.where("own is not null").groupBy("key").agg(F.min("rank").alias("first_of_group")))  # a row for each large group
    out = ranked.join(of_shard, "shard", "left").join(of_group, "key", "left")
    of_large = F.coalesce("n_flow", F.lit(0)) + F.col("rows_before_group") + F.col("rank") - F.col("first_of_group")
    slot = F.when(F.col("own").isNull(), F.col("flow_rank") - F.col("first")).otherwise(of_large)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
