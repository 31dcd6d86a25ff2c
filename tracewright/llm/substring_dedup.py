"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, small_batches
from .ngram_join import texts_of

#: Words of a passage (over 50), and of them at its start those whose rolling hash may see what is before it.
PASSAGE_WORDS, BLURRED = 51, 8
#: Every so many neighbouring ends of words hold a cut. Two whole windows lie inside a passage, so
#: it holds whole chunks; smaller windows make more chunks, and fewer chance runs to look at.
CUT_WINDOW = 16
#: Words that two documents may have alike by chance beside a passage that a smaller one holds too.
CHANCE_WORDS = 5

_TO_SPACE = bytes(32 if c < 32 else c for c in range(256))


def _gear(seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """256 fixed 16-bit values from a splitmix sequence."""
    out, x = [], seed
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) % (1 << 64)
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % (1 << 64)
        out.append((z ^ (z >> 27)) >> 48)
    return np.array(out, np.uint16)


GEAR = _gear()


def cut_points(data: np.ndarray, window: int = CUT_WINDOW) -> np.ndarray:
    """Ends of the chunks of some bytes: of any `window` neighbouring ends of words, the one of the smallest rolling hash.

    The rolling hash doubles and adds a byte's value; its 16 low bits depend on the last 16 bytes
    only (ends that have fewer before them are no cuts). It is found for all positions at once by
    doubling its length, and so is the smallest of a window, the last one of equals. A chunk has
    `window` words at most, except at the ends, and the cuts inside a stretch are those of any
    other text that holds it, from the smallest of its first window to that of its last.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    black = data > 32
    ends = np.flatnonzero(black & ~np.r_[black[1:], False]) + 1
    ends = ends[ends >= 16]
    n = len(ends)
    cuts = ends[:0]
    if n >= window:
        least = h[ends - 1].astype(np.int64) << 32 | (n - 1 - np.arange(n))
        span = 1
        while span < window:
            step = min(span, window - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        cuts = ends[np.unique(n - 1 - (least & 0xFFFFFFFF))]
    return cuts if len(cuts) and cuts[-1] == len(data) else np.r_[cuts, len(data)]


def words_of(text: str) -> list[bytes]:
    """Words between white space and control characters."""
    return text.encode().translate(_TO_SPACE).split()


def chunks_of(text: str, window: int = CUT_WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of chunks, and the words before and up to the end of each. White space counts as one space."""
    raw = b" ".join(words_of(text))
    data = np.frombuffer(raw, np.uint8)
    ends = cut_points(data, window)
    if not len(ends):
        return np.zeros(0, np.int64), ends, ends
    starts = np.r_[0, ends[:-1]]
    digests = np.fromiter((xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(ends))
    black = data > 32
    before = np.r_[0, np.cumsum(black & ~np.r_[False, black[:-1]])]
    return digests.view(np.int64), before[starts], before[ends]


def named_by_id(docs: DataFrame) -> DataFrame:
    """(id, text); a document without an id is named by a negative hash of its text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 61))).alias("id"), "text")


def digests_of(docs: DataFrame, window: int = CUT_WINDOW) -> DataFrame:
    """(key, id, span): digests of all texts' chunks, and the words before and up to the end of each in one number."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                b = whole.slice(lo, 64)
                got = [chunks_of(t or "", window) for t in b.column("text").to_pylist()]
                ids = np.repeat(b.column("id").to_numpy(), [len(k) for k, _, _ in got])
                key, w0, w1 = (np.concatenate([g[i] for g in got]).astype(np.int64) for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, ids.astype(np.int64), w0 << 31 | w1)], ["key", "id", "span"])

    return named_by_id(docs).mapInArrow(run, "key long, id long, span long")


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    odd = 0x9FB21C651E98DF25
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (odd, pow(odd, -1, 1 << 64)))


def stretch_hashes(text: str, words: int, zones: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the stretches of `words` words that begin in zones (both ends included), and where they begin."""
    split = words_of(text)
    n = len(split)
    wanted = np.zeros(max(0, n - words + 1), bool)
    for lo, hi in zones:
        wanted[max(lo, 0) : max(hi + 1, 0)] = True
    at = np.flatnonzero(wanted)
    if not len(at):
        return np.zeros(0, np.int64), at
    power, inverse = _powers(1 << n.bit_length())
    sums = np.r_[np.uint64(0), np.cumsum(np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, n) * power[:n])]
    x = (sums[at + words] - sums[at]) * inverse[at]
    x ^= x >> np.uint64(31)
    return (x * np.uint64(0xD6E8FEB86659FD93)).view(np.int64), at


def stretches(zones: DataFrame, named: DataFrame, words: int) -> DataFrame:
    """(gram, id, at): hashes of stretches in zones, and where they are.

    Only texts with zones are sent, and always by exchange: zones grow with the documents. Places count from a number of the text, so that places of two texts of one id are never neighbours.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                b = whole.slice(lo, 64)
                cols: list[list[np.ndarray]] = [[], [], []]
                for i, text, spans in zip(*(b.column(c).to_pylist() for c in ("id", "text", "zones")), strict=True):
                    gram, at = stretch_hashes(text or "", words, [(z["lo"], z["hi"]) for z in spans])
                    if len(at):
                        at = at + ((xxhash.xxh32_intdigest(text.encode()) >> 1) << 32)
                        for col, x in zip(cols, (gram, np.full(len(at), i, np.int64), at), strict=True):
                            col.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["gram", "id", "at"])

    of = zones.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("zones"))
    some = texts_of(named.select(F.col("id").alias("row_key"), "text"), zones.select(F.col("id").alias("row_key"))).withColumnRenamed("row_key", "id")
    return of.hint("merge").join(some, "id").mapInArrow(run, "gram long, id long, at long")


def repeated_passages(docs: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """Passages of `words` words or more that several documents hold: doc_id, first_word, end_word, n_words, kept_in, kept.

    Whatever its hash, a stretch of so many words has cuts in its first and its last window, and
    all chunks between them are chunks of every document that holds it. So only stretches about
    runs of shared chunks can be shared; each of those is hashed (64 bits), and the hashes that
    several documents hold are found by partial sums, whoever and however many they are. None is
    missed. Neighbouring stretches make a passage while the smallest document that holds them
    (for that one itself, the largest) has them side by side too, so that each passage lies in
    one piece in that other document. Passages of a document may overlap where the other changes;
    one that adds up to CHANCE_WORDS words to those of smaller keepers is left out.

    Words lie between white space. kept_in is the smallest id that holds the passage; kept marks
    the passages of that document, which cover all that others hold of it. Documents are told
    apart by their id, so rows with equal ids share nothing with each other; a null id is
    replaced by a negative hash of the text. Null and empty texts have no chunks.
    """
    window = min(CUT_WINDOW, (words - BLURRED) // 2)
    if window < 1:
        raise ValueError(f"a passage has {BLURRED + 2} words at least")
    scratch = Scratch(docs.sparkSession, "passages")
    rows = digests_of(docs, window)
    shared = rows.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("key")
    start, end = F.shiftright("span", 31), F.col("span").bitwiseAND(F.lit((1 << 31) - 1))
    found = rows.join(shared.hint("merge"), "key").select("id", start.cast("int").alias("w0"), end.cast("int").alias("w1"))
    # a run ends where a chunk begins after all ends before it; texts of one id share their runs
    before = Window.partitionBy("id").orderBy("w0", "w1")
    opens = F.coalesce((F.col("w0") > F.max("w1").over(before.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    marked = found.withColumn("opens", opens).withColumn("run", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy("id", "run").agg(F.min("w0").alias("w0"), F.max("w1").alias("w1"))
    # where a stretch may begin whose chunks, from the first window's cut to the last one's, are in the run
    zones = runs.select("id", (F.col("w0") - BLURRED - window).alias("lo"), (F.col("w1") - words - 1 + window).alias("hi")).where("hi >= lo and hi >= 0")
    grams = stretches(scratch.keep(zones), named_by_id(docs), words).repartition("gram")
    ends = grams.groupBy("gram").agg(F.min(F.struct("id", "at")).alias("l"), F.max(F.struct(F.col("id"), (-F.col("at")).alias("back"))).alias("m"))
    held = ends.where("l.id <> m.id").select("gram", F.col("l.id").alias("least"), F.col("m.id").alias("most"), F.col("l.at").alias("least_at"), (-F.col("m.back")).alias("most_at"))
    mine = F.col("id") == F.col("least")
    other, other_at = (F.when(mine, F.col(f"most{x}")).otherwise(F.col(f"least{x}")) for x in ("", "_at"))
    placed = grams.select("gram", "id", "at").join(held.hint("merge"), "gram").select("id", "at", other.alias("other"), (other_at - F.col("at")).alias("shift"))
    beside = Window.partitionBy("id", "other", "shift").orderBy("at")
    pieces = placed.withColumn("piece", F.col("at") - F.dense_rank().over(beside)).groupBy("id", "other", "shift", "piece").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    place = lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    found = pieces.select("id", F.shiftright("lo", 32).alias("copy"), F.struct(F.least("id", "other").alias("kept_in"), place("lo").alias("first"), (place("hi") + words).alias("end")).alias("p"))
    out = without_chance(found.groupBy("id", "copy").agg(F.collect_set("p").alias("p"))).distinct()
    return out.select("doc_id", "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), "kept_in", (F.col("doc_id") == F.col("kept_in")).alias("kept"))


def without_chance(found: DataFrame) -> DataFrame:
    """(doc_id, first_word, end_word, kept_in): passages, less those of up to CHANCE_WORDS words beyond the ones that smaller ids keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, p in zip(b.column("id").to_pylist(), b.column("p").to_pylist(), strict=True):
                told = np.zeros(max(x["end"] for x in p), bool)
                p.sort(key=lambda x: x["kept_in"])
                for kept_in, same in groupby(p, key=lambda x: x["kept_in"]):
                    new = [(x["first"], x["end"]) for x in same]
                    new = [(lo, hi) for lo, hi in new if hi - lo - np.count_nonzero(told[lo:hi]) > CHANCE_WORDS]
                    for lo, hi in new:
                        told[lo:hi] = True
                        out.append((i, lo, hi, kept_in))
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["doc_id", "first_word", "end_word", "kept_in"])

    return found.mapInArrow(run, "doc_id long, first_word int, end_word int, kept_in long")
