"""N-gram Jaccard join by T-occurrence search, and one document of each linked group.

A document's shingles are ordered from rare to frequent by a count sketch of all documents. Two
sets of the required similarity share a shingle among the rare ones of each, so these short
inverted lists give the candidates; the long lists are only probed. Parities of the sets rule out
most candidates before texts are read again, and only texts of the others are sent. Lists of a few documents give
pairs. A longer list gives a star around one document; what the star leaves unlinked is searched
in blocks with DivideSkip.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few_files, gathered, small_batches
from .components import connected_components

#: Words of a shingle, and the similarity in hundredths.
WORDS, PERCENT = 4, 85
#: Buckets of the count sketch (2 to this power), and of one of its rows.
SKETCH_BITS, CHUNK_BITS = 20, 12
#: Bits of the keys whose texts are wanted (2 to this power).
KEY_BITS = 25
#: Longest list that gives all its pairs, and documents of a block of the search.
SHORT_LIST, BLOCK = 32, 512

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)]


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: words between ASCII white space, A-Z lowered.

    With fewer words than a shingle has, the whole sequence is one; without words there is none.
    """
    raw = (text or "").encode().lower().split()
    if not raw:
        return np.zeros(0, np.uint64)
    if len(raw) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(raw), seed=len(raw))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
    n = len(w) - words + 1
    x = w[:n] * _MIX[0]
    for k in range(1, words):
        x += w[k : k + n] * _MIX[k]
        x ^= x >> np.uint64(29)
        x *= _MIX[7 - k % 4]
    x ^= x >> np.uint64(32)
    return np.unique(x)


def signature(s: np.ndarray) -> int:
    """A signed 64-bit name of a set; documents of equal sets are one node."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=1)).view(np.int64)))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, by probing the larger set."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def rare_first(s: np.ndarray, sketch: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The rarest shingles of a set, so many that a linked set shares one of them.

    Any fixed order of all shingles keeps this exact; the sketch only makes lists short.
    """
    n = len(s)
    keep = n - -(-percent * n // 100) + 1
    count = np.minimum(sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], (1 << 20) - 1).astype(np.uint64)
    key = (count << np.uint64(44)) | (s & np.uint64((1 << 44) - 1))
    return s if keep >= n else s[np.argpartition(key, keep - 1)[:keep]]


def parity_of(s: np.ndarray) -> bytes:
    """Bits, about as many as the set has shingles: whether an odd number of shingles fall on each."""
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def may_link(n_a: int, n_b: int, a: bytes, b: bytes, percent: int = PERCENT) -> bool:
    """False only where two sets cannot be linked: each bit in which their parities differ needs a shingle that one of them lacks."""
    if len(a) > len(b):
        a, b = b, a
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) != len(y):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    apart = n_a + n_b - 2 * -(-percent * (n_a + n_b) // (100 + percent))
    return int.from_bytes((x ^ y).tobytes(), "little").bit_count() <= apart


class Index:
    """Inverted lists of some sets, for T-occurrence search."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.sizes, self.percent = np.array([len(s) for s in sets]), percent
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        all_ = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(all_, kind="stable")
        self.owner = owner[order]
        self.token, self.start = np.unique(all_[order], return_index=True)
        self.end = np.r_[self.start[1:], len(all_)].astype(np.int64)

    def search(self, query: np.ndarray) -> np.ndarray:
        """Numbers of all sets linked with the query (DivideSkip).

        The longest lists, fewer than the least overlap T, are set apart. The short ones are
        merged and sets occurring at least T - L times go on; these are then looked for in each
        long list by binary search, and stay while they can reach their T.
        """
        n = len(query)
        if not n or not len(self.token):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.token, query), len(self.token) - 1)
        at = at[self.token[at] == query]
        need = -(-self.percent * (n + self.sizes) // (100 + self.percent))  # T for each set
        fits = (100 * self.sizes >= self.percent * n) & (100 * n >= self.percent * self.sizes) & (self.sizes > 0)
        least = -(-self.percent * n // 100)
        if len(at) < least or not fits.any():
            return np.zeros(0, np.int64)
        at = at[np.argsort(self.end[at] - self.start[at], kind="stable")]
        longest = int(self.end[at[-1]] - self.start[at[-1]])
        apart = min(least - 1, max(0, int(least / (0.01 * np.log2(longest + 1) + 1))))
        short, long = at[: len(at) - apart], at[len(at) - apart :]
        merged = np.concatenate([self.owner[self.start[t] : self.end[t]] for t in short])
        count = np.bincount(merged, minlength=len(self.sizes))
        found = np.flatnonzero(fits & (count >= need - apart))
        count = count[found]
        for left, t in zip(range(len(long), 0, -1), long[::-1], strict=True):
            alive = count + left >= need[found]
            found, count = found[alive], count[alive]
            if not len(found):
                break
            owners = self.owner[self.start[t] : self.end[t]]
            k = np.minimum(np.searchsorted(owners, found), len(owners) - 1)
            count = count + (owners[k] == found)
        return found[count >= need[found]]


def _long(values: list) -> pa.Array:
    return pa.array(values, pa.int64())


def describe(docs: DataFrame, words: int) -> DataFrame:
    """A row of (row_key, doc_id, n, sig, parity) for each document, and rows of (chunk, counts) of each task's sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row_key", "doc_id", "n", "sig", "parity", "chunk", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        id_type = None
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column("text").to_pylist()]
            all_ = np.concatenate(sets)
            if len(all_):
                np.add.at(counts, (all_ >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            id_type = b.column("doc_id").type
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [b.column("row_key"), b.column("doc_id"), _long([len(s) for s in sets]), _long([signature(s) if len(s) else None for s in sets]), pa.array([parity_of(s) for s in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names,
            )
        if id_type is not None:
            parts = counts.astype("<u4").reshape(-1, 1 << CHUNK_BITS)
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())],
                names,
            )

    return docs.mapInArrow(run, f"row_key long, doc_id {kind}, n long, sig long, parity binary, chunk int, counts binary")


def sum_sketch(parts: DataFrame) -> np.ndarray:
    """The sketch of all documents, of fixed size, from the tasks' (chunk, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
                v = np.frombuffer(zlib.decompress(x), "<u4").astype("<i8")
                sums[c] = sums[c] + v if c in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["chunk", "counts"])

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for chunk, counts in parts.repartition(8, "chunk").mapInArrow(run, "chunk int, counts binary").collect():
        out[chunk << CHUNK_BITS : (chunk + 1) << CHUNK_BITS] += np.frombuffer(counts, "<i8")
    return out


def short_lists(docs: DataFrame, sketch, words: int, percent: int) -> DataFrame:
    """(token, n, sig) for the rare shingles of each set; a task names a set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            tokens, sizes, sigs = [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t, words)
                if not len(s) or (name := signature(s)) in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(name)
                rare = rare_first(s, sketch.value, percent)
                tokens.append(rare.view(np.int64))
                sizes.append(np.full(len(rare), len(s)))
                sigs.append(np.full(len(rare), name))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (tokens, sizes, sigs)], ["token", "n", "sig"])

    return docs.select("text").mapInArrow(run, "token long, n long, sig long")


def candidates(lists: DataFrame, percent: int, short: int) -> DataFrame:
    """(a, b, star) from inverted lists: all pairs of a short list, a star around the first set of a longer one.

    Lists stream in order of token, size and name, so a task holds at most `short` entries of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, held, star = None, [], False

        def pairs(entries: list[tuple[int, int]]) -> list[tuple[int, int, bool]]:
            return [(x[1], y[1], False) for i, x in enumerate(entries) for y in entries[i + 1 :] if 100 * x[0] >= percent * y[0]]

        for b in batches:
            out: list[tuple[int, int, bool]] = []
            t = b.column("token").to_numpy()
            n, sig = b.column("n").to_pylist(), b.column("sig").to_pylist()
            edges = np.r_[0, np.flatnonzero(t[1:] != t[:-1]) + 1, len(t)].tolist()
            for lo, hi in zip(edges, edges[1:], strict=False):
                if t[lo] != token:
                    if len(held) > 1 and not star:
                        out += pairs(held)
                    token, held, star = t[lo], [], False
                for i in range(lo, hi):
                    if star:
                        if sig[i] != held[-1][1]:
                            held[-1] = (n[i], sig[i])
                            out.append((held[0][1], sig[i], True))
                    elif not held or sig[i] != held[-1][1]:
                        held.append((n[i], sig[i]))
                        if len(held) > short:
                            star = True
                            out += [(held[0][1], x[1], True) for x in held[1:]]
                            held = [held[0], held[-1]]
            if out:
                yield batch(out)
        if len(held) > 1 and not star:
            yield batch(pairs(held))

    def batch(rows: list[tuple[int, int, bool]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_long([r[0] for r in rows]), _long([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.bool_())], ["a", "b", "star"])

    return lists.mapInArrow(run, "a long, b long, star boolean")


def without_unlike(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of (a, b, n_a, n_b, parity_a, parity_b), less those that parities rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("n_a", "n_b", "parity_a", "parity_b")), strict=True)
            yield b.select(["a", "b"]).filter(pa.array([may_link(*r, percent) for r in rows], pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def texts_of(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows (row_key, text) whose key may be in keys (row_key), by a bitmap of fixed size, before any exchange of texts; few others stay."""
    low = F.col("row_key").bitwiseAND(F.lit((1 << KEY_BITS) - 1))
    marks = keys.select(F.shiftright(low, 15).alias("chunk"), low.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit")).groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("bits"))
    held = np.zeros(1 << KEY_BITS - 3, np.uint8)
    for chunk, bits in marks.collect():
        held[chunk << 12 : (chunk + 1) << 12] = np.frombuffer(bits, np.uint8)
    known = keys.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("row_key").to_numpy() & ((1 << KEY_BITS) - 1)
            yield b.filter(pa.array((known.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    return texts.mapInArrow(run, "row_key long, text string")


class _Sets:
    """Sets of the latest texts, as a star's centre comes again and again."""

    def __init__(self, words: int, most: int = 256):
        self.words, self.most, self.known = words, most, {}

    def of(self, name: int, text: str) -> np.ndarray:
        if name not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[name] = shingle_set(text, self.words)
        return self.known[name]


def verify(pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The linked ones of (a, b, text_a, text_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(words)
        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            keep = [i for i in range(len(a)) if linked(sets.of(a[i], x[i]), sets.of(b[i], y[i]), percent)]
            yield pa.RecordBatch.from_arrays([_long([a[i] for i in keep]), _long([b[i] for i in keep])], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def search_blocks(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between components, found in blocks of (centre, block, part, query, sig, component, text).

    A query returns one link to each other component.
    """

    def run(rows: pa.Table) -> pa.Table:
        sig, comp, query = (rows[c].to_pylist() for c in ("sig", "component", "query"))
        text = rows["text"].to_pylist()
        inside = [i for i, q in enumerate(query) if not q]
        index = Index([shingle_set(text[i], words) for i in inside], percent)
        found: list[tuple[int, int]] = []
        for i in (i for i, q in enumerate(query) if q):
            got, mine = index.search(shingle_set(text[i], words)), {comp[i]}
            for k in got.tolist():
                j = inside[k]
                if comp[j] not in mine:
                    mine.add(comp[j])
                    found.append((sig[i], sig[j]))
        return pa.table([_long([a for a, _ in found]), _long([b for _, b in found])], names=["a", "b"])

    return rows.groupBy("centre", "block", "part").applyInArrow(run, "a long, b long")


def ngram_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, short: int = SHORT_LIST, block: int = BLOCK) -> DataFrame:
    """row_key, doc_id, n_shingles, sig, component_id of every document.

    Links are those of similarity percent/100 or more between shingle sets; component_id is the
    smallest doc_id reachable by links. Documents of equal sets are one node. Empty documents
    (null or no words) link with nothing and keep their own id; null ids keep their rows and
    never name a component that has another id; repeated rows are equal sets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "ngram")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", "text")
    table = scratch.keep(few_files(describe(rows, words)))
    sketch = spark.sparkContext.broadcast(sum_sketch(table.where("chunk is not null").select("chunk", "counts")))  # of fixed size
    named = table.where("chunk is null").select("row_key", "doc_id", "n", "sig")
    nodes = table.where("sig is not null").groupBy("sig").agg(F.first("n").alias("n"), F.first("parity").alias("parity"))
    reps = named.where("sig is not null").groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"].alias("rep"))
    lists = short_lists(rows, sketch, words, percent)
    in_order = lists.repartition(F.col("token")).sortWithinPartitions("token", "n", "sig")
    pairs = scratch.keep(gathered(candidates(in_order, percent, short).groupBy("a", "b").agg(F.max("star").alias("star"))))
    texts = rows.select("row_key", "text")

    def with_text(df: DataFrame, **names: str) -> DataFrame:
        """With the text of each column of names that is given, as the column it names.

        Texts go by exchange: broadcast pairs would put texts_of and what reads them into one task, with a Python worker for each.
        """
        wanted = reduce(DataFrame.union, [df.select(F.col(sig).alias("sig")) for sig in names]).distinct()
        some = texts_of(texts, reps.join(wanted, "sig", "left_semi").select(F.col("rep").alias("row_key")))
        for sig, name in names.items():
            df = df.join(reps.select(F.col("sig").alias(sig), F.col("rep").alias("row_key")), sig).join(some.withColumnRenamed("text", name).hint("merge"), "row_key").drop("row_key")
        return df

    of = lambda x: nodes.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}"))
    alike = scratch.keep(few_files(without_unlike(pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b"), percent)))
    links = scratch.keep(gathered(verify(with_text(alike, a="text_a", b="text_b"), words, percent).distinct()))
    components = scratch.keep(gathered(connected_components(links, scratch)))
    stars = pairs.where("star").select(F.col("a").alias("centre"), F.col("b").alias("sig"))
    if stars.take(1):
        members = stars.union(stars.select("centre", F.col("centre").alias("sig")).distinct())
        members = scratch.keep(few_files(members.join(components.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))))
        sizes = members.groupBy("centre", "component").agg(F.count("*").alias("n"))
        main = sizes.groupBy("centre").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("parts"), F.max("n").alias("most")).where("parts > 1")
        plan = main.select("centre", "main", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("most")) / block).cast("int").alias("query_parts"))
        wide = with_text(scratch.keep(few_files(members.join(plan, "centre"))), sig="text")
        spot = F.pmod(F.xxhash64("sig", F.lit(2)), F.col("blocks")).cast("int")
        part = F.pmod(F.xxhash64("sig", F.lit(3)), F.col("query_parts")).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        index = wide.select("centre", spot.alias("block"), every("query_parts").alias("part"), F.lit(False).alias("query"), "sig", "component", "text")
        queries = wide.where(F.col("component") != F.col("main")).select("centre", every("blocks").alias("block"), part.alias("part"), F.lit(True).alias("query"), "sig", "component", "text")
        more = few_files(search_blocks(index.union(queries), words, percent))  # an exchange, so that one task has one Python worker
        components = scratch.keep(gathered(connected_components(links.union(more), scratch)))
    placed = named.join(components.withColumnRenamed("node", "sig"), "sig", "left").select("row_key", "doc_id", "n", "sig", F.coalesce("component", "sig").alias("component"))
    smallest = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(smallest, "component", "left")
    return out.select("row_key", "doc_id", F.col("n").alias("n_shingles"), "sig", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each linked group, that of the smallest id, with all its columns."""
    groups = ngram_groups(docs, words, percent)
    whole = groups.where((F.col("n_shingles") == 0) | F.col("component_id").isNull()).select("row_key")
    first = groups.where((F.col("n_shingles") > 0) & F.col("component_id").isNotNull()).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"].alias("row_key"))
    kept = whole.union(first.select("row_key")).distinct().withColumnRenamed("row_key", "__kept")
    keyed = docs.withColumn("__kept", F.xxhash64("doc_id", "text"))
    return keyed.join(kept, "__kept", "left_semi").dropDuplicates(["__kept"]).drop("__kept")
