"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a shingle, and the weighted similarity from which a window is a leak.
SHINGLE, SIMILARITY = 5, 0.8
#: Largest Hamming distance of 64-bit fingerprints. Windows of similarity 0.8 lie at 10 +- 3 bits on average.
RADIUS = 23
#: Item shingles up to which the item side is broadcast; beyond it, Spark shuffles.
BROADCAST_SHINGLES = 200_000

_NO_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _NO_WORD), lambda w: w != "")


def shingles_of(words: Column, n: int) -> Column:
    """Hash of the n words from each position; empty where there are fewer than n words."""
    last = F.size(words) - n
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash; a shingle weighs as often as it occurs."""

    def bit(b: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda a, h: a + F.when(F.getbit(h, b) == 1, 1).otherwise(-1))
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def hamming_blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """radius + 1 pieces of a fingerprint: two within the radius agree in one of them at least."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.call_function("shiftrightunsigned", fingerprint, F.lit(lo)).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)])


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller counts over the sum of the larger counts of all shingles."""
    counted = F.aggregate(
        F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x)))
    )
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    common = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)
    return common / (F.size(a) + F.size(b) - common)


def items_of(benchmark: DataFrame) -> DataFrame:
    """Items with any word: item_id, size (words), n (words of a shingle), hashes, fingerprint."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    hashes = F.lit(None).cast("array<bigint>")
    for n in range(1, SHINGLE + 1):
        hashes = F.when(F.least(F.size("words"), F.lit(SHINGLE)) == n, shingles_of(F.col("words"), n)).otherwise(hashes)
    out = words.select("item_id", F.size("words").alias("size"), F.least(F.size("words"), F.lit(SHINGLE)).alias("n"), hashes.alias("hashes"))
    return out.withColumn("fingerprint", simhash(F.col("hashes")))


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Leaks of benchmark items into documents: doc_id, row_key, item_id, similarity, start, n_words.

    The windows of a document are as many words as an item has, where a shingle of the window
    and the same shingle of the item lie at the same place; any window that shares no shingle
    has similarity 0. A pair of a document and an item needs shared shingles for the similarity
    before its windows are fingerprinted. The best window (then the first) of each document and
    item is returned. Items of fewer than five words are one shingle of all their words; empty
    items and texts leak nothing; null ids count as ids; equal rows give one row.
    """
    items = items_of(benchmark).persist()
    sizes = {r[0]: r[1] for r in items.groupBy("n").agg(F.sum(F.size("hashes"))).collect()}
    small = sum(sizes.values()) <= BROADCAST_SHINGLES

    def maybe_broadcast(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    places = items.select("n", "size", "item_id", F.size("hashes").alias("of"), F.posexplode("hashes").alias("item_pos", "hash"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), words_of(F.col("text")).alias("words"))
    anchors = None
    for n in sorted(sizes):
        of_n = rows.select("row_key", F.posexplode(shingles_of(F.col("words"), n)).alias("pos", "hash"))
        got = of_n.join(maybe_broadcast(places.where(F.col("n") == n)), "hash").select("row_key", "item_id", "size", "n", "of", "item_pos", (F.col("pos") - F.col("item_pos")).alias("start"))
        anchors = got if anchors is None else anchors.unionByName(got)
    if anchors is None:
        return rows.select("doc_id", "row_key", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).alias("n_words")).limit(0)
    pairs = (
        anchors.groupBy("row_key", "item_id", "size", "n", "of")
        .agg(F.countDistinct("item_pos").alias("matched"), F.collect_set("start").alias("starts"))
        .where(F.col("matched") >= similarity * F.col("of"))
    )
    wanted = pairs.select("row_key", "size", "n", F.explode("starts").alias("start")).groupBy("row_key").agg(F.collect_set(F.struct("size", "n", "start")).alias("windows"))
    cut = rows.join(wanted, "row_key").dropDuplicates(["row_key"])
    first = F.greatest(F.col("w.start"), F.lit(0))
    window = F.slice(F.col("words"), first + 1, F.col("w.size") + F.least(F.col("w.start"), F.lit(0)))
    windows = cut.select("doc_id", "row_key", "words", F.explode("windows").alias("w")).select("doc_id", "row_key", "w.size", "w.n", first.alias("start"), window.alias("words"))
    hashes = F.lit(None).cast("array<bigint>")
    for n in sorted(sizes):
        hashes = F.when(F.col("n") == n, shingles_of(F.col("words"), n)).otherwise(hashes)
    printed = windows.select("doc_id", "row_key", "size", "n", "start", F.size("words").alias("n_words"), hashes.alias("hashes")).where(F.size("hashes") > 0)
    printed = printed.withColumn("fingerprint", simhash(F.col("hashes"))).withColumn("blocks", hamming_blocks(F.col("fingerprint"), radius))
    by_block = printed.select(*[c for c in printed.columns if c != "blocks"], F.posexplode("blocks").alias("block", "value"))
    of_items = items.select("item_id", "size", F.col("hashes").alias("item_hashes"), F.col("fingerprint").alias("item_print"), F.posexplode(hamming_blocks(F.col("fingerprint"), radius)).alias("block", "value"))
    near = by_block.join(maybe_broadcast(of_items), ["size", "block", "value"]).where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= radius)
    once = near.dropDuplicates(["row_key", "item_id", "start", "n_words"])
    exact = once.withColumn("similarity", weighted_similarity(F.col("hashes"), F.col("item_hashes"))).where(F.col("similarity") >= similarity)
    best = exact.groupBy("doc_id", "row_key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), "n_words")).alias("best"))
    return best.select("doc_id", "row_key", "item_id", "best.similarity", (-F.col("best.before")).alias("start"), "best.n_words")


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with all their columns."""
    leaks = find_leaks(docs, benchmark).select(F.col("row_key").alias("__leak")).distinct()
    return docs.join(leaks, F.xxhash64(docs["doc_id"], docs["text"]) == F.col("__leak"), "left_anti")
