"""Token counts: pieces are counted once per distinct pre-token and joined to pre-token frequencies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts, small_batches

#: Distinct pre-tokens that a task sums before it sends them, the longest one of the dictionary, and the most frequent ones that are broadcast.
REMEMBERED, LONGEST, FREQUENT = 400_000, 64, 200_000

#: The character that stands for a space in pieces.
SPACE_MARK = "▁"


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def splits_at_spaces(path: str) -> bool:
    """True if no piece continues past a space, so that merges never cross a pre-token's end."""
    sp = _processor(path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)


def pre_tokens(text: str) -> list[str]:
    """A text cut before each run of spaces, without the space that the tokenizer adds by itself.

    The tokenizer puts one space before a text, so a pre-token with k spaces is given to it
    with k - 1. Trailing spaces are a pre-token of their own; a single one is the empty string.
    """
    if not text:
        return []
    text = text.replace(SPACE_MARK, " ")
    words = text.split(" ")
    if "" not in words:
        return words
    out, spaces = [], 0
    for w in words:
        if w:
            out.append(" " * spaces + w)
            spaces = 0
        else:
            spaces += 1
    if spaces:
        out.append(" " * (spaces - 1))
    return out


class Pieces:
    """Numbers of pieces of pre-tokens, as whole texts would give them."""

    def __init__(self, path: str):
        self.sp = _processor(path)
        self.last_space = len(self.sp.encode("a ")) - len(self.sp.encode("a"))

    def of(self, tokens: list[str]) -> list[int]:
        """The empty pre-token is a single trailing space."""
        filled = [t for t in tokens if t]
        counted = iter(map(len, self.sp.encode(filled, num_threads=1)) if filled else ())
        return [next(counted) if t else self.last_space for t in tokens]


def _strings(batch: pa.RecordBatch, at_once: int = 128) -> Iterator[tuple[int, int, list[str]]]:
    for lo in range(0, batch.num_rows, at_once):
        part = batch.slice(lo, at_once)
        yield lo, part.num_rows, [t or "" for t in part.column("text").to_pylist()]


def pre_token_counts(texts: DataFrame) -> DataFrame:
    """(token, n): how often each distinct pre-token of up to LONGEST characters occurs. A task sums before it sends, within REMEMBERED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            kept = [(t, n) for t, n in seen.items() if t and len(t) <= LONGEST]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["token", "n"])

        for b in batches:
            for _, _, part in _strings(b):
                for t in part:
                    seen.update(pre_tokens(t))
                if len(seen) > REMEMBERED:
                    yield rows()
        yield rows()

    return texts.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def count_pieces(dictionary: DataFrame, model_path: str) -> DataFrame:
    """(token, n, pieces): each distinct pre-token is counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("token"), b.column("n"), pa.array(pieces.of(b.column("token").to_pylist()), pa.int64())], ["token", "n", "pieces"])

    return dictionary.mapInArrow(run, "token string, n long, pieces long")


def frequent_tokens(dictionary: DataFrame, most: int) -> tuple[dict[str, int], int]:
    """The pieces of pre-tokens that occur a number of times at least, at most so many of them, and that number."""
    sizes = {r[0]: r[1] for r in dictionary.groupBy(F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("b")).count().collect()}  # 64 rows at most
    total, least = 0, None
    for b in sorted(sizes, reverse=True):
        total += sizes[b]
        if total > most:
            break
        least = b
    if least is None:
        return {}, 1 << 62
    return {r[0]: r[1] for r in dictionary.where(F.col("n") >= 1 << least).select("token", "pieces").collect()}, 1 << least


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Bytes and tokens of every text: id, n_bytes, n_tokens, over_limit.

    Equal to encoding each whole text without begin, end or added special tokens. All distinct
    pre-tokens of the corpus are counted once; a document's frequencies are joined to these
    counts and summed. The join is in place for the most frequent pre-tokens (a bounded number,
    broadcast) and by exchange for the others, none of which is frequent, so no key is hot.
    Pre-tokens of more than LONGEST characters, of which there are few alike, are counted where
    they stand. A null text counts as empty (0 bytes, 0 tokens); null and repeated ids keep their
    rows; other columns are not read. If a model has pieces that cross spaces, whole texts are
    encoded instead.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    over = (F.col("n_tokens") > limit).alias("over_limit")
    small_batches(docs.sparkSession)
    if not splits_at_spaces(model_path):
        rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
        out = map_texts(rows, lambda: lambda texts: {"n_tokens": [len(i) for i in _processor(model_path).encode(texts, num_threads=1)]}, "n_tokens long")
        return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", over)

    scratch = Scratch(docs.sparkSession, "tokens")
    dictionary = scratch.keep(count_pieces(pre_token_counts(docs.select(text.alias("text"))), model_path))
    known, least = frequent_tokens(dictionary, frequent)
    shared = docs.sparkSession.sparkContext.broadcast(known)  # of `frequent` entries of LONGEST characters at most
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, table = Pieces(model_path), shared.value
        for b in batches:
            for lo, n, texts in _strings(b):
                part = b.slice(lo, n)
                at = part.column("row").to_pylist()
                sums, rare, here = [0] * n, [], []
                for k, t in enumerate(texts):
                    for token, f in Counter(pre_tokens(t)).items():
                        c = table.get(token)
                        if c is not None:
                            sums[k] += c * f
                        else:
                            (here if not token or len(token) > LONGEST else rare).append((k, token, f))
                for (k, _, f), c in zip(here, pieces.of([token for _, token, _ in here]), strict=True):
                    sums[k] += c * f
                full = lambda own, other, kind: pa.array([*own, *other], kind)
                m = len(rare)
                id_type = part.column("id").type
                yield pa.RecordBatch.from_arrays(
                    [
                        full(at, [at[k] for k, _, _ in rare], pa.int64()), pa.concat_arrays([part.column("id"), pa.nulls(m, id_type)]), full(part.column("n_bytes").to_pylist(), [None] * m, pa.int64()),
                        full(sums, [f for _, _, f in rare], pa.int64()), full([None] * n, [token for _, token, _ in rare], pa.string()),
                    ],
                    ["row", "id", "n_bytes", "n", "token"],
                )

    found = scratch.keep(rows.mapInArrow(join, f"row long, id {kind}, n_bytes long, n long, token string"))
    rare = found.where("token is not null").select("row", "token", "n").join(dictionary.where(F.col("n") < least).select("token", "pieces").hint("merge"), "token")
    parts = found.where("token is null").select("row", "id", "n_bytes", "n").union(rare.select("row", F.lit(None).cast(kind), F.lit(None).cast("long"), F.col("n") * F.col("pieces")))
    out = parts.groupBy("row").agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", over)
