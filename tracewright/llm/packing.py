"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, per randomised group."""

from __future__ import annotations

import os
import zlib
from array import array
from functools import lru_cache
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Distinct chunks that one Python worker remembers, and the longest one that it remembers.
REMEMBERED, LONGEST = 450_000, 40
#: Documents of a group, about.
GROUP_DOCS = 1024


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ChunkEncoder:
    """Ids of whole texts from ids of their chunks between ASCII white space.

    The tokenizer drops white space and lowers letters before it merges, so no token crosses a
    chunk's end and ASCII letters may be lowered first (not in texts that may hold a special
    token's string). Each distinct chunk is encoded once by the library itself, words of letters
    by its model alone, until the table is full; later chunks are encoded again as they come.
    """

    def __init__(self, path: str, end_id: int):
        self.tok, self.known = _tokenizer(path), {}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(*vocab.values(), end_id) < 65536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.end = self.pack([end_id])
        from tokenizers import pre_tokenizers

        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_level = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100)}

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def word(self, letters: bytes) -> bytes:
        """Ids of a word of letters below U+0100, which the tokenizer only lowers and writes as bytes."""
        w = letters.decode().lower()
        return self.pack([t.id for t in self.tok.model.tokenize(w if w.isascii() else w.translate(self.byte_level))])

    def others(self, chunks: list[bytes]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.tok.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]

    def look_up(self, fresh: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that are not in the table. A word and one mark after it are two tokens' texts."""
        marks = dict(zip((b".", b","), self.others([b".", b","]), strict=True))
        got: dict[bytes, bytes] = {}
        rest = []
        for c in fresh:
            mark = marks.get(c[-1:], b"")
            bare = c[:-1] if mark else c
            w = bare.decode()
            if w.isalpha() and (w.isascii() or max(w) < "\u0100"):
                got[c] = (self.known.get(bare) or self.word(bare)) + mark
            else:
                rest.append(c)
        for lo in range(0, len(rest), 1024):
            part = rest[lo : lo + 1024]
            got.update(zip(part, self.others(part), strict=True))
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        chunks = [(t if b"<|" in t else t.lower()).split() for t in raw]
        known = [list(map(self.known.get, c)) for c in chunks]
        missing = [list(compress(c, map(not_, k))) for c, k in zip(chunks, known, strict=True)]
        found = self.look_up(list(set().union(*missing)))
        out = []
        for k, m in zip(known, missing, strict=True):
            if m:
                new = map(found.__getitem__, m)
                k = [x or next(new) for x in k]
            out.append(b"".join(k) + self.end)
        if len(self.known) + len(found) <= REMEMBERED:
            self.known.update((c, ids) for c, ids in found.items() if len(c) <= LONGEST)
        return out


@lru_cache(maxsize=1)
def _encoder(path: str, end_id: int) -> ChunkEncoder:
    """One table for all tasks of a worker."""
    return ChunkEncoder(path, end_id)


class Tournament:
    """Free capacity of bins in a complete binary tree; each node holds the largest of its leaves."""

    def __init__(self, leaves: int, capacity: int):
        self.n = 1 << max(0, leaves - 1).bit_length()
        self.tree = [capacity] * (2 * self.n)

    def take(self, size: int) -> int:
        """Put size into the first bin with room; its number."""
        at, tree = 1, self.tree
        while at < self.n:
            at *= 2
            if tree[at] < size:
                at += 1
        tree[at] -= size
        found = at - self.n
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
        return found


def pack_lengths(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length).

    Whole sequences are cut from the front of long documents; the rests go by first-fit
    decreasing; then the emptiest bins are cut up to fill the others, so that at most one
    sequence of a group stays unfilled.
    """
    full, rests = [], []
    for i, n in enumerate(lengths):
        whole = n // capacity
        full += [[(i, k * capacity, capacity)] for k in range(whole)]
        if n % capacity:
            rests.append((n % capacity, i, whole * capacity))
    rests.sort(key=lambda r: (-r[0], r[1]))
    bins: list[list[tuple[int, int, int]]] = []
    tree = Tournament(len(rests), capacity)
    for size, i, start in rests:
        k = tree.take(size)
        if k == len(bins):
            bins.append([])
        bins[k].append((i, start, size))
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: (-fill[k], k))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        to, of = order[lo], order[hi]
        room = capacity - fill[to]
        if not room:
            lo += 1
        elif not fill[of]:
            hi -= 1
        else:
            i, start, size = bins[of].pop()
            moved = min(room, size)
            if moved < size:
                bins[of].append((i, start, size - moved))
            bins[to].append((i, start + size - moved, moved))
            fill[of] -= moved
            fill[to] += moved
    return full + [b for b in bins if b]


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, group_docs: int = GROUP_DOCS, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of packed sequences: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and their ids if asked for.

    A document is its ids and end_id; a null or empty text is end_id alone. Documents are dealt
    to groups by a hash of id and text, so no key, source or set of copies makes a large group,
    and null or repeated ids keep their rows. Every group is packed by itself (a bounded number
    of documents); ids travel once, as 16-bit numbers. An empty table gives no rows.
    """
    groups = max(1, -(-docs.count() // group_docs))
    kind = docs.schema[id_col].dataType.simpleString()
    kind_of = ChunkEncoder(tokenizer_path, end_id).dtype

    def make():
        enc = _encoder(tokenizer_path, end_id)
        return lambda texts: {"ids": enc.encode(texts)}

    def assemble(rows: pa.Table) -> pa.Table:
        in_order = sorted(zip(rows["id"].to_pylist(), rows["ids"].to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
        ids = [np.frombuffer(x, kind_of) for _, x in in_order]
        base = rows["grp"][0].as_py() << 32
        out: list[list] = [[] for _ in range(7 + with_ids)]
        for k, seq in enumerate(pack_lengths([len(x) for x in ids], capacity)):
            at = 0
            for i, start, n in seq:
                piece = ids[i][start : start + n]
                row = (in_order[i][0], start, n, zlib.crc32(piece.astype("<u4")), len(ids[i]), base + k, at)
                for col, v in zip(out, (*row, piece.tobytes()) if with_ids else row, strict=True):
                    col.append(v)
                at += n
        types = [rows.schema.field("id").type, *[pa.int64()] * 6, pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names=names)

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    added = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in names[1:])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.pmod(F.xxhash64(F.col(id_col), text, F.lit(17)), F.lit(groups)).alias("grp"), text.alias("text"))
    out = (
        map_texts(rows, make, "ids binary")
        .groupBy("grp")
        .applyInArrow(assemble, f"id {kind}, {added}")
    )
    return out.withColumnRenamed("id", id_col)
