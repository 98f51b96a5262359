"""Packing of token sequences into as few bins as possible by bin completion.

Only lengths matter for packing, and there are at most `capacity` of them. So the documents are tokenized once
into pieces, the number of pieces of every length is counted (at most `capacity` counts reach the driver, however
large the input), and the search runs on that histogram: patterns of lengths, each with a number of uses. Then
every piece takes a place: its rank among the pieces of its length falls into one range of one pattern.

Search: a best-fit-decreasing solution is the first incumbent. Branch and bound takes the largest length left and
enumerates the fillings of the room beside it by waste, least first, keeping the undominated ones: a filling goes if
some of its pieces could be taken out for one piece left that is as long as they are together, or longer. A branch
is cut when the waste so far and the waste that the rest cannot avoid (the L2 bound of what is left) exceed what a
better plan may waste. A filling is first used as often as the counts allow, then once. The search ends at the
lower bound, when everything is tried, or after its budget, which follows the number of lengths (`NODES` a length,
`WIDTH` fillings at a place out of `TRIES`): beyond it the best plan so far stands.

Edge cases: a null text counts as empty and gives a piece of the end id alone; longer documents are cut into
pieces of `capacity` of which the first may be shorter; null ids stay null, repeated ids and rows are pieces of their
own; texts of any length are tokenized whole; ties between pieces of one length are settled by the key, equal keys
take any of their places; an empty table gives an empty result; extra columns pass through `pack`, but for older
columns named sequence_id and offset, which are replaced.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

CAPACITY = 2048
#: Places that the search may try for each length in the table, fillings it keeps at one place, and fillings it looks at.
NODES, WIDTH, TRIES = 2, 4, 64
#: Pieces of one length are numbered in this many independent parts, in more where parts would pass PART_ROWS rows.
PARTS, PART_ROWS = 1024, 1 << 20

#: Unicode white space, and the splitting pattern of byte-level vocabularies for texts in which no two
#: white-space characters stand side by side before something else.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SIMPLE_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+"
#: The full pattern ends a run of white space one character early if something follows: cut there, and the simple
#: pattern, which needs no look-ahead and so runs twice as fast, finds the same pieces.
RUN_END = re.compile(f"(?<=[{WHITE}])(?=[{WHITE}][^{WHITE}])")
RUN = re.compile(f"[{WHITE}]{{2}}")


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary file stands for: printable ones for themselves, the others by
    turn for the signs from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def fast_encoder(path: str) -> Callable[[str], np.ndarray] | None:
    """Ids of a text under a byte-level vocabulary file, without the library's per-word cost; None for files of another
    kind. Merges have to be in the order of their ids, which is checked."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    model, split = held["model"], held["pre_tokenizer"] or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if held["normalizer"] or any(split.get(k) != v for k, v in plain.items()) or model["type"] != "BPE":
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    added = held["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        return None
    byte = byte_of_sign()
    extra = {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in extra}
    encode = tiktoken.Encoding("own", pat_str=SIMPLE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
    marks = re.compile("(" + "|".join(re.escape(t) for t in sorted(extra, key=len, reverse=True)) + ")") if extra else None

    def plain_ids(text: str) -> np.ndarray:
        if RUN.search(text):
            return np.concatenate([encode(p, disallowed_special=()) for p in RUN_END.split(text)])
        return encode(text, disallowed_special=())

    def ids(text: str) -> np.ndarray:
        if marks is None or not marks.search(text):
            return plain_ids(text)
        return np.concatenate([np.array([extra[p]], "<u4") if p in extra else plain_ids(p) for p in marks.split(text)])

    return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text as the tokenizers library gives them for a file, without special tokens around it."""
    fast = fast_encoder(path)
    if fast is not None:
        return fast
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda text: np.array(own.encode(text, add_special_tokens=False).ids, "<u4")


def token_pieces(rows: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document; ids are little-endian unsigned 32-bit."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    end = np.array([end_id], "<u4")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end]).astype("<u4", copy=False)
                n = len(ids)
                bounds = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    piece = ids[a:b].tobytes()
                    for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(piece), piece), strict=False):
                        column.append(value)
                if keep_ids and len(out[0]) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names)

    return rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


@dataclass
class Plan:
    """Patterns as (uses, {length: number in a bin})."""

    patterns: list[tuple[int, dict[int, int]]] = field(default_factory=list)

    @property
    def bins(self) -> int:
        return sum(uses for uses, _ in self.patterns)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing, on equal bins at once."""
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms: list[int] = []

    def put(pattern: dict[int, int], uses: int) -> None:
        room = capacity - sum(a * n for a, n in pattern.items())
        if room not in groups:
            groups[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        groups[room].append((pattern, uses))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_right(rooms, length - 1)
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(left, each)
                for uses, n in ((full, each), (1, rest)):
                    if uses and n:
                        put({length: n}, uses)
                break
            room = rooms[at]
            pattern, uses = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            taken = min(uses, left)
            if taken < uses:
                put(pattern, uses - taken)
            put(pattern | {length: pattern.get(length, 0) + 1}, taken)
            left -= taken
    return Plan([(uses, pattern) for group in groups.values() for pattern, uses in group])


def spread(sums: int, first: int, last: int) -> int:
    """The bit set of s + d for every s in the bit set `sums` and every d from `first` to `last`."""
    out, width, wanted = sums, 1, last - first + 1
    if wanted <= 0:
        return 0
    while width < wanted:
        step = min(width, wanted - width)
        out |= out << step
        width += step
    return out << first


def dominated(filling: dict[int, int], waste: int, others: int) -> bool:
    """Whether one of the lengths in the bit set `others` could take the place of some pieces of `filling`: it is as
    long as these together (alone, only if longer than the one it replaces), and longer by `waste` at most."""
    one = many = 0  # bit sets of the sums of one piece, and of two and more
    for length, n in filling.items():
        for _ in range(n):
            many |= many << length | one << length
            one |= 1 << length
    return bool((spread(many | 1, 0, waste) | spread(one, 1, waste)) & others)


def fillings(lengths: list[int], counts: dict[int, int], room: int, width: int, most_waste: int, tries: int = TRIES) -> list[dict[int, int]]:
    """Undominated fillings of `room`, least waste first and larger pieces first, up to `width` of the first `tries`
    fillings. `lengths` is ascending, with counts left; no filling wastes more than `most_waste`."""
    usable = lengths[: bisect_right(lengths, room)]
    mask = (1 << (room + 1)) - 1
    reach = [1]  # reach[k]: bit set of the sums of pieces of the k smallest lengths
    for length in usable:
        sums, left, step = reach[-1], min(counts[length], room // length), 1
        while left:
            n = min(step, left)
            sums |= sums << (n * length) & mask
            left, step = left - n, step * 2
        reach.append(sums)
    every = sum(1 << length for length in usable)
    found: list[dict[int, int]] = []

    def exact(total: int) -> Iterator[dict[int, int]]:
        """Fillings of this sum, by depth-first search from the largest length; no step leads to a dead end."""
        stack: list[tuple[int, int, tuple]] = [(len(usable), total, ())]
        while stack:
            k, left, taken = stack.pop()
            if not left:
                yield dict(taken)
                continue
            k = min(k, bisect_right(usable, left))
            length = usable[k - 1]
            for n in range(min(counts[length], left // length) + 1):
                if reach[k - 1] >> (left - n * length) & 1:
                    stack.append((k - 1, left - n * length, (*taken, (length, n)) if n else taken))

    for waste in range(min(room, most_waste) + 1):
        if not reach[-1] >> (room - waste) & 1:
            continue
        for filling in exact(room - waste):
            others = every
            for length, n in filling.items():
                if counts[length] == n:
                    others &= ~(1 << length)
            if not dominated(filling, waste, others):
                found.append(filling)
            tries -= 1
            if len(found) == width or not tries:
                return found
    return found


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any plan needs: for every threshold, pieces that cannot share a bin plus the waste-free rest."""
    n = np.zeros(capacity + 1, np.int64)
    n[list(counts)] = list(counts.values())
    held, amount = np.concatenate([[0], n.cumsum()]), np.concatenate([[0], (n * np.arange(capacity + 1)).cumsum()])
    half = capacity // 2
    k = np.arange(1, half + 1)
    alone = held[capacity + 1] - held[capacity - k + 1]
    large, in_large = held[capacity - k + 1] - held[half + 1], amount[capacity - k + 1] - amount[half + 1]
    rest = amount[half + 1] - amount[k] - (large * capacity - in_large)
    each = alone + large + np.maximum(0, -(-rest // capacity))
    return max(-(-int(amount[-1]) // capacity), int(each.max(initial=0)))


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = None, width: int = WIDTH) -> Plan:
    """The best plan found for `counts` (length -> number of pieces), trying at most `nodes` places."""
    counts = {int(a): int(n) for a, n in counts.items() if n}
    nodes = NODES * max(64, len(counts)) if nodes is None else nodes
    whole = sum(a * n for a, n in counts.items())
    best = best_fit(counts, capacity)
    bound = lower_bound(counts, capacity)
    # A place yet to be tried: the counts before it, the waste and bins so far, the pattern and uses that lead to it, and
    # the chain of patterns before that.
    stack: list[tuple] = [(counts, 0, 0, {}, 0, None)]
    while stack and nodes > 0 and best.bins > bound:
        counts, wasted, bins, pattern, uses, chain = stack.pop()
        if bins + uses >= best.bins:
            continue
        if uses:
            counts = {a: n for a, m in counts.items() if (n := m - uses * pattern.get(a, 0))}
            wasted += uses * (capacity - sum(a * n for a, n in pattern.items()))
            bins, chain = bins + uses, (chain, uses, pattern)
        if not counts:
            best = Plan()
            while chain:
                chain, *step = chain
                best.patterns.append(tuple(step))
            continue
        most_waste = (best.bins - 1) * capacity - whole - wasted  # what a better plan may still waste
        if lower_bound(counts, capacity) * capacity - sum(a * n for a, n in counts.items()) > most_waste:
            continue
        nodes -= 1
        largest = max(counts)
        rest = dict(counts)
        rest[largest] -= 1
        rest = {a: n for a, n in rest.items() if n}
        options = fillings(sorted(rest), rest, capacity - largest, width, most_waste)
        once, often = [], []
        for filling in reversed(options):  # the least waste is taken first
            pattern = filling | {largest: filling.get(largest, 0) + 1}
            most = min(counts[a] // n for a, n in pattern.items())
            often.append((counts, wasted, bins, pattern, most, chain))
            if most > 1:
                once.append((counts, wasted, bins, pattern, 1, chain))
        stack += once + often
    return best


def places(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, uses, first bin, first offset): the ranks lo..hi of a length fill a pattern's slots."""
    out, next_rank, bin_ = [], {}, 0
    for uses, pattern in plan.patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            lo = next_rank.get(length, 0)
            next_rank[length] = hi = lo + uses * pattern[length]
            out.append((length, lo, hi, uses, bin_, offset))
            offset += length * pattern[length]
        bin_ += uses
    return out


def pack(pieces: DataFrame, key: list[str], capacity: int = CAPACITY, nodes: int | None = None) -> DataFrame:
    """Add sequence_id and offset to `pieces` (with a column `length` in 1..capacity). `key` spreads pieces of one
    length over independently numbered parts. The plan has under 3 * capacity patterns of fewer than 64 lengths, the
    proven bound under which its places travel with the tasks; a piece finds its own by binary search."""
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return pieces.select(*kept, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("pieces have 1 to `capacity` tokens")
    lengths, lo, _, uses, first, offset = np.array(sorted(places(complete(counts, capacity, nodes))), np.int64).T
    starts_of = np.searchsorted(lengths, np.arange(capacity + 2))
    parts = max(PARTS, -(-sum(counts.values()) // PART_ROWS))
    row = F.struct(*[F.col(c) for c in kept]).alias("row")
    parted = pieces.select(row, F.col("length").cast("long").alias("length"), F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int").alias("part"))
    sums = parted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "part").orderBy(*[f"row.{c}" for c in key])
    ranked = parted.withColumn("at", F.row_number().over(inside)).join(starts, ["length", "part"])
    ranked = ranked.select("row", "length", (F.col("first") + F.col("at") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            at = np.zeros(len(length), np.int64)
            for one in np.unique(length):
                mine, s, e = length == one, starts_of[one], starts_of[one + 1]
                at[mine] = s + np.searchsorted(lo[s:e], rank[mine], side="right") - 1
            nth = rank - lo[at]
            found = [first[at] + nth % uses[at], offset[at] + nth // uses[at] * length]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], names=["row", "sequence_id", "offset"])

    schema = ranked.select("row", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.mapInArrow(run, schema).select("row.*", "sequence_id", "offset")


def pack_documents(rows: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    pieces = cut(token_pieces(rows, path, capacity))
    return pack(pieces, ["doc_id", "piece"], capacity)


def op4_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    packed = pack_documents(docs, path or public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
