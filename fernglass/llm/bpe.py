"""Byte-level BPE: encoding in length-bucketed padded matrices, and decoding.

A text is cut before every single space that a word follows; no match of the splitting pattern crosses such a
place, so a chunk always gets the same ids. A worker encodes the chunks it has not met: the pattern splits them
into pieces, pieces are sorted into buckets by length, and each bucket is one padded matrix of ids. In a round
every row merges its leftmost pair of minimum rank; rows are then compacted by one place and finished rows leave
the matrix. Pair ranks come from an open-addressing hash table in arrays. Pieces too long for a matrix keep the
same rule with minima per segment, so that a round costs a segment and not the piece.

Edge cases: a null text counts as empty (no ids); texts are encoded whole; a rank file without all 256 single
bytes is refused; the memory of a worker's chunk cache is bounded by `CACHE_BYTES`, after which only the chunks of the texts at hand stay;
ids of documents pass through exactly, null ones too;
repeated rows give equal rows; an empty table gives an empty result; extra columns pass through, but for older
columns of the names that are added.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Longest piece for a matrix; longer ones are merged by segments.
LONGEST = 256
SEGMENT = 256
CACHE_BYTES = 224 << 20
NO_RANK = np.int64(1 << 40)
#: A space that no word follows: there the quick cut does not hold.
LOOSE_SPACE = re.compile(r" (?=\s|$)")


class Ranks:
    """A vocabulary as ranks, with hashed lookup of the rank that two neighbouring ids merge into."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary holds all 256 single bytes")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.bits = max(4, int(len(pairs) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int64)
        self.longest_probe = 1
        for key, rank in pairs.items():
            at, probes = int(self.slot(np.array([key], np.int64))[0]), 1
            while self.keys[at] != -1:
                at, probes = (at + 1) & ((1 << self.bits) - 1), probes + 1
            self.keys[at], self.values[at] = key, rank
            self.longest_probe = max(self.longest_probe, probes)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of left+right, NO_RANK where the two do not merge; -1 stands for padding."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        keys = np.where((left < 0) | (right < 0), np.int64(-2), left << 32 | right)
        out = np.full(keys.shape, NO_RANK, np.int64)
        at = self.slot(keys)
        open_ = np.flatnonzero(keys >= 0)
        for _ in range(self.longest_probe):
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)

    def encode_bucket(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of about one length, all rows at once."""
        width = max(map(len, pieces))
        ids = np.full((len(pieces), width), -1, np.int64)
        for row, piece in enumerate(pieces):
            ids[row, : len(piece)] = self.byte_ids[np.frombuffer(piece, np.uint8)]
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        rows = np.arange(len(pieces))
        ranks = self.merged(ids[:, :-1], ids[:, 1:]) if width > 1 else np.zeros((len(pieces), 0), np.int64)
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = np.take_along_axis(ranks, at[:, None], 1)[:, 0] if ranks.shape[1] else np.full(len(rows), NO_RANK)
            done = least == NO_RANK
            for r in np.flatnonzero(done):
                out[rows[r]] = ids[r][ids[r] >= 0]
            live = ~done
            rows, ids, ranks, at, least = rows[live], ids[live], ranks[live], at[live], least[live]
            if not len(rows):
                break
            # Merge at `at`, close the gap to its right, and look up the two pairs that changed.
            n = ids.shape[1]
            ids[np.arange(len(rows)), at] = least
            column = np.arange(n - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
            if n > 2:
                ranks = np.take_along_axis(ranks, column[:-1] + (column[:-1] > at[:, None]), 1)
                r = np.arange(len(rows))
                right = np.minimum(at, n - 3)
                ranks[r, right] = np.where(at <= n - 3, self.merged(ids[r, right], ids[r, right + 1]), ranks[r, right])
                left = np.maximum(at - 1, 0)
                ranks[r, left] = np.where(at > 0, self.merged(ids[r, left], ids[r, left + 1]), ranks[r, left])
                filled = int((ids >= 0).sum(axis=1).max())
                if filled < ids.shape[1]:
                    ids, ranks = ids[:, :filled], ranks[:, : max(0, filled - 1)]
            else:
                ranks = np.zeros((len(rows), 0), np.int64)
        return out

    def encode_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: minima per segment tell where the leftmost least pair is."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].copy()
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ranks = np.full(-(-n // SEGMENT) * SEGMENT, NO_RANK, np.int64)
        ranks[: n - 1] = self.merged(ids[:-1], ids[1:])
        minima = ranks.reshape(-1, SEGMENT).min(axis=1)

        def pair(at: int) -> None:
            right = after[at]
            ranks[at] = NO_RANK if right >= n else self.merged(ids[at : at + 1], ids[right : right + 1])[0]
            minima[at // SEGMENT] = ranks[at // SEGMENT * SEGMENT : (at // SEGMENT + 1) * SEGMENT].min()

        while True:
            segment = int(minima.argmin())
            if minima[segment] == NO_RANK:
                return ids[ids >= 0]
            at = segment * SEGMENT + int(ranks[segment * SEGMENT : (segment + 1) * SEGMENT].argmin())
            gone = int(after[at])
            ids[at], ids[gone] = ranks[at], -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            ranks[gone] = NO_RANK
            minima[gone // SEGMENT] = ranks[gone // SEGMENT * SEGMENT : (gone // SEGMENT + 1) * SEGMENT].min()
            pair(at)
            if before[at] >= 0:
                pair(int(before[at]))

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, np.ndarray]:
        buckets: dict[int, list[bytes]] = {}
        out: dict[bytes, np.ndarray] = {}
        for piece in set(pieces):
            whole = self.ranks.get(piece)
            if whole is not None and len(piece) == 1:
                out[piece] = np.array([whole], np.int64)
            elif len(piece) > LONGEST:
                out[piece] = self.encode_long(piece)
            else:
                buckets.setdefault((len(piece) + 3) // 4, []).append(piece)
        for length, bucket in buckets.items():
            rows = max(1, (1 << 18) // (length * 4))
            for s in range(0, len(bucket), rows):
                out.update(zip(bucket[s : s + rows], self.encode_bucket(bucket[s : s + rows]), strict=True))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(maxsize=2)
def ranks_at(path: str) -> Ranks:
    return Ranks(read_ranks(path))


def chunks_of(text: str) -> list[str] | None:
    """Keys of a text's chunks: cut before each space that a word follows. A key without a space stands for a
    chunk that begins with one, a key that begins with a space for what follows it: so the words of a text are
    keys as they are. None where loose spaces need more care."""
    if LOOSE_SPACE.search(text):
        return None
    keys = text.split(" ")
    keys[0] = " " + keys[0]
    return keys


def chunk_of(key: str) -> str:
    return key[1:] if key[:1] == " " else " " + key


class ChunkCache:
    """Ids of chunks as little-endian bytes, encoded in batches and kept up to CACHE_BYTES."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], split: Callable[[str], list[str]]):
        self.encode, self.split = encode, split
        self.known: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def cost(entry: tuple[str, bytes]) -> int:
        """Bytes that an entry takes, about."""
        return len(entry[0]) + len(entry[1]) + 180

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        cut = [chunks_of(t) for t in texts]
        cut = [[" " + p for p in self.split(t)] if c is None else c for t, c in zip(texts, cut, strict=True)]
        needed: set[str] = set().union(*cut)
        if self.held > CACHE_BYTES:  # what the texts at hand share with earlier ones is worth keeping
            self.known = {c: self.known[c] for c in needed if c in self.known}
            self.held = sum(map(self.cost, self.known.items()))
        new = list(needed.difference(self.known))
        if new:
            added = dict(zip(new, self.encode([chunk_of(k) for k in new]), strict=True))
            self.known.update(added)
            self.held += sum(map(self.cost, added.items()))
        known = self.known.__getitem__
        return [b"".join(map(known, c)) for c in cut]


def small_batches(frames: Iterator[pd.DataFrame], column: str, most: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """Cut frames so that a piece holds about `most` characters of `column` (one row at least)."""
    for frame in frames:
        sizes = frame[column].str.len().fillna(0).to_numpy().cumsum()
        start = 0
        while start < len(frame):
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + most, side="right")))
            yield frame.iloc[start:stop]
            start = stop


def text_slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut a batch so that a slice holds about `most` bytes of text (one row at least); with its texts, null as empty."""
    ends = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        part = batch.slice(start, stop - start)
        yield part, [t or "" for t in part.column(column).to_pylist()]
        start = stop


def encoder(path: str, pattern: str) -> ChunkCache:
    import regex

    ranks, split = ranks_at(path), regex.compile(pattern).findall

    def encode(chunks: list[str]) -> list[bytes]:
        cut = [[p.encode("utf-8", "surrogatepass") for p in split(c)] for c in chunks]
        ids = {p: i.astype("<u4").tobytes() for p, i in ranks.encode_pieces({p for c in cut for p in c}).items()}
        return [b"".join(map(ids.__getitem__, c)) for c in cut]

    return ChunkCache(encode, split)


def encode_table(rows: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add `ids` (binary, little-endian unsigned 32-bit) and `n_tokens` to `rows`; older columns of these names go."""
    rows = rows.drop("ids", "n_tokens")
    schema = rows.withColumns({"n_tokens": F.lit(0).cast("long"), "ids": F.lit(b"").cast("binary")}).schema
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = encoder(path, pattern)
        for batch in batches:
            for part, texts in text_slices(batch, at):
                ids = cache.ids(texts)
                made = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode_table(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add `decoded` (binary) to `rows`; null ids decode to nothing. An older column of that name goes."""
    rows = rows.drop("decoded")
    schema = rows.withColumn("decoded", F.lit(b"").cast("binary")).schema
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_at(path)
        for batch in batches:
            decoded = [ranks.decode(np.frombuffer(i.as_py() or b"", "<u4")) for i in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def digests(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass that keeps neither."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, ranks = encoder(path, pattern), ranks_at(path)
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                ids = cache.ids(texts)
                decoded = [sha(ranks.decode(np.frombuffer(i, "<u4"))) for i in ids]
                made = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([*map(sha, ids)], pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=names)

    plain = rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    return digests(
        table(spark, sf_dir, "documents"),
        path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        pattern or public_tokenizers.PATTERN,
    )
