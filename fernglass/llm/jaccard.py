"""Exact n-gram Jaccard join: prefix families, then a T-occurrence search (DivideSkip) inside each family.

1. Every text becomes the set of its distinct word shingles (64-bit hashes). Texts with equal sets (equal 128-bit
   ids) are one vertex from there on, however many copies there are; a task sends an equal set's shingles once.
2. A count sketch of fixed size gives one global order, rare shingles first. It decides speed only: any order is
   right. Two sets that link share at least k shingles among the first n - ceil(t*n) + k of either (prefix filter), k
   growing with the smaller set, and in that set they stand earlier still. The prefix shingles are dealt by hash. Of
   the k at least about half stand in short lists, or about half in long ones. Sets of short lists are paired and the
   shingles of a pair counted: half of k make an edge. Sets with half of k in long lists are chained inside each
   of them in order of size, and a chain breaks where sizes differ too much for a link: a list of m sets gives m - 1
   edges at most, never its pairs. So sets that meet by chance in a few shingles give no edge, of which there are the
   more the larger the collection is. A list that the sketch shows to be hot is dealt by salts: each part is
   chained by itself, and one set of each size and part is chained again over the whole list.
3. Connected components of these edges are families: linked sets are always in one family, and most sets are in
   none. Only the texts of families are sent, to their family's task, and made sets there.
4. In a task the family's shingles form an inverted index. For a query set the T-occurrence search sets the L
   longest lists aside, merges the short ones on a heap, and looks candidates with T - L hits up in the long
   lists by binary search; sets that reach the overlap a link needs are linked. Pairs already known to be in one
   component are not compared again (they cannot change the result).
5. A family above BLOCK shingles is cut by size class and hash into blocks. In a first round every block is searched
   by itself, together with a few pivots of the family; that joins a large group of near copies whatever its size.
   In a second round only the sets outside the family's largest component are queries, against every block they
   could link with. So all pairs of different components are compared, a task's memory is bounded, and the work on
   a hot group grows with its size and not with its square.
6. Components of the links, whose nodes are the smallest id of each set, joined back to all documents by set.

Edge cases: null and empty texts have no shingles and link with nothing; a null doc_id takes part only
through documents of an equal set (without one its component is null); repeated rows are copies; ties do not arise,
a component is the smallest id; texts of any length are used whole (a set above BLOCK is a block of its own); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .arrays import blocks_of, combined
from .bpe import small_batches
from .common import cut, free_name, numbered, renulled, shuffles, sorted_groups, table
from .shingles import shingle_sets

WIDTH, PERCENT = 5, 75
#: Cells of the sketch (a byte each once broadcast), and shingles that a block of a family may hold.
CELLS, BLOCK = 1 << 22, 1 << 18
#: DivideSkip's weight of a list's length in choosing how many lists to set aside.
MU = 0.0085
#: Most rows (of 80 bytes) of a table of places that is broadcast.
SMALL = 250_000
#: Sets of a family that every one of its blocks is compared with in the first round, for each size class.
PIVOTS = 8
#: A set of n has to share 1 + n // SHARE shingles of its prefix with each larger set it links with. Sets of a list that
#: are paired; longer lists are chained.
SHARE, PAIRED = 16, 8
#: Rows of a shingle's list that one task chains; ids that a task remembers as sent.
LIST, SENT = 1 << 18, 1 << 20
#: Ids that leave the heap together.
SPAN = 4096
#: Largest bloom filter, in bits; fuller ones only let more rows through to the join that decides.
BLOOM_BITS = 1 << 27


def overlap_needed(a: int, b: int, percent: int) -> int:
    """Least intersection with 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def overlap_least(n: int, percent: int) -> int:
    """Least intersection of a set of n with any set it links with."""
    return -(-percent * n // 100)


def shared_least(n: int) -> int:
    """Least number of prefix shingles that a set of n shares with any set of its size or larger that it links with."""
    return 1 + n // SHARE


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


def _set_id(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits, as two signed numbers. The first alone names a vertex of the family graph, where a collision would only
    join two families; both together name the set."""
    return struct.unpack("<qq", hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, no_id, n, sid, sid2) of every document, and in rows of their own the blocks of each task's sketch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(CELLS, np.uint32)
        for frame in small_batches(frames, "text"):
            sets = shingle_sets(frame["text"].tolist(), width)
            np.add.at(sketch, _cell(np.concatenate(sets)), 1)
            sid, sid2 = zip(*map(_set_id, sets), strict=True)
            yield pd.DataFrame(
                {"doc_id": frame["doc_id"], "no_id": frame["no_id"], "n": [len(s) for s in sets], "sid": sid, "sid2": sid2, "block": -1, "data": None}
            )
        for block, data in blocks_of(sketch):
            yield pd.DataFrame({"doc_id": [0], "no_id": [True], "n": [0], "sid": [0], "sid2": [0], "block": [block], "data": [data]})

    schema = "doc_id long, no_id boolean, n long, sid long, sid2 long, block int, data binary"
    return numbered(docs.select("doc_id", "text")).mapInPandas(run, schema)


def rarity(counts: np.ndarray) -> np.ndarray:
    """Sketch counts on a logarithmic scale of one byte."""
    return np.minimum(255, 8 * np.log2(counts + 1.0)).astype(np.uint8)


def parts_of(order: np.ndarray) -> np.ndarray:
    """Into how many parts a list is dealt, by its shingle's value in `order`: 1 but where it stands far above the others."""
    counts = 2.0 ** (np.arange(256) / 8.0) - 1
    held = np.bincount(order, minlength=256)
    hot = (counts > max(LIST, 4 * float(counts @ held) / len(order))) & (held > 0)
    return np.where(hot, np.ceil(counts / LIST), 1).astype(np.int64)


def prefix_rows(docs: DataFrame, order: np.ndarray, width: int, percent: int) -> DataFrame:
    """(h, salt, sid, m): the prefix shingles of every set; m is twice its size, plus 1 where the shingle stands too late
    to be among the first `shared_least` that the set shares with a set of its size or larger. salt is -1 unless the shingle's list is hot,
    where no shingle counts as late."""
    shared, parts = docs.sparkSession.sparkContext.broadcast(order), parts_of(order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = shared.value
        sent: set[int] = set()
        for frame in small_batches(frames, "text"):
            hs, salts, sids, ms = [], [], [], []
            for s in shingle_sets(frame["text"].tolist(), width):
                n = len(s)
                if not n or (sid := _set_id(s)[0]) in sent:
                    continue
                if len(sent) >= SENT:  # what is forgotten may be sent again, which changes nothing
                    sent.clear()
                sent.add(sid)
                cells = _cell(s)
                k = shared_least(n)
                first = np.argsort(order[cells], kind="stable")[: n - overlap_least(n, percent) + k]
                held = parts[order[cells[first]]]
                hs.append(s[first])
                salts.append(np.where(held > 1, sid % held, -1).astype(np.int32))
                sids.append(np.full(len(first), sid, np.int64))
                ms.append(2 * n + ((np.arange(len(first)) >= n - overlap_needed(n, n, percent) + k) & (held == 1)))
            if hs:
                yield pd.DataFrame({"h": np.concatenate(hs).view(np.int64), "salt": np.concatenate(salts), "sid": np.concatenate(sids), "m": np.concatenate(ms)})

    return docs.select("text").mapInPandas(run, "h long, salt int, sid long, m int")


def _half(n: Column) -> Column:
    """The half of `shared_least` that two sets share in short lists or in long ones."""
    return F.floor((2 + F.floor(n / SHARE)) / 2)


def met(prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b, h, salt, m): for every list of up to PAIRED sets its pairs a, b whose sizes allow a link, the smaller
    first (m twice its size); for longer and hot lists their rows, with b null. A set counts once in a list."""
    by_size = Window.partitionBy("h", "salt").orderBy("m", "sid")
    rows = prefixes.withColumns({"before": F.lag("sid").over(by_size), "after": F.lead("sid").over(by_size)})
    alone = F.col("before").isNull() & F.col("after").isNull() & (F.col("salt") < 0)
    rows = rows.where(~alone & (F.col("before").isNull() | (F.col("before") != F.col("sid")))).drop("before", "after")
    rows = rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("h", "salt")))
    long_ = (F.col("salt") >= 0) | (F.col("size") > PAIRED)
    smaller = F.collect_list(F.when(~long_, F.struct("sid", "m"))).over(by_size.rowsBetween(1 - PAIRED, -1))
    n = lambda m: F.floor(m / 2)
    # The smaller set has the shingle early (m even); of two sets of one size, both have.
    close = lambda x: (x["m"] % 2 == 0) & (n(x["m"]) * 100 >= n(F.col("m")) * percent) & ((F.col("m") % 2 == 0) | (x["m"] < F.col("m") - 1))
    none = F.lit(None)
    row = lambda a, b, h, salt, m: F.struct(a.alias("a"), b.cast("long").alias("b"), h.cast("long").alias("h"), salt.cast("int").alias("salt"), m.alias("m"))
    pairs = F.transform(F.filter("smaller", close), lambda x: row(x["sid"], F.col("sid"), none, none, x["m"]))
    own = F.array(row(F.col("sid"), none, F.col("h"), F.col("salt"), F.col("m")))
    return rows.withColumn("smaller", smaller).select(F.inline(F.when(long_, own).otherwise(pairs)))


def chained(lists: DataFrame, by: list[str], percent: int) -> DataFrame:
    """`lists` with p: the last early set before a set in its list, by size; null where their sizes allow no link.

    The smaller set of a link has the shared shingle early (m even), so both sets of a link hang on one
    chain of early sets: what lies between them in size is close enough in size too."""
    by_size = Window.partitionBy(*by).orderBy("m", "sid")
    early = F.when(F.col("m") % 2 == 0, F.struct("sid", "m"))
    before = F.last(early, ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    found = lists.withColumns({"p": before, "again": F.lag("m").over(by_size) == F.col("m")})
    n = lambda m: F.floor(m / 2)
    close = (F.col("p.sid") != F.col("sid")) & (n(F.col("p.m")) * 100 >= n(F.col("m")) * percent)
    return found.withColumn("p", F.when(close, F.col("p.sid")))


def family_edges(prefixes: DataFrame, percent: int, hot: bool) -> DataFrame:
    """(src, dst): pairs that share enough in short lists, and each set that has enough long ones with those it is chained
    to there. If any list is `hot`, its parts are chained to one another by one set of each size and part.

    Of the k = shared_least(n) that a link of a set of n with a larger one needs, either _half(n) stand in short
    lists, or as many in long ones; the larger set is held to the half of the smallest set it may link with."""
    edges = lambda x: x.where("p is not null").select(F.col("p").alias("src"), F.col("sid").alias("dst"))
    found = cut(met(prefixes, percent))
    paired = found.where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("held"), F.first("m").alias("m"))
    paired = paired.where(F.col("held") >= _half(F.col("m") / 2)).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    least = F.ceil(F.floor(F.col("m") / 2) * percent / 100)
    rows = found.where("b is null").withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("a")))
    lists = rows.where(F.col("held") >= _half(least)).select("h", "salt", F.col("a").alias("sid"), "m")
    if not hot:
        return paired.union(edges(chained(lists, ["h"], percent))).distinct()
    parts = cut(chained(lists, ["h", "salt"], percent).where("p is not null or (salt >= 0 and not coalesce(again, false))"))
    heads = parts.where("salt >= 0 and not coalesce(again, false)").select("h", "sid", "m")
    return paired.union(edges(parts)).union(edges(chained(heads, ["h"], percent))).distinct()


def _bloom_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return np.stack([x >> shift, (x * np.uint64(0xD6E8FEB86659FD93)) >> shift]).astype(np.int64)


def bloom(ids: DataFrame, bits: int) -> np.ndarray:
    """A bloom filter of a table of ids, as one byte array of `bits` // 8."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(bits, bool)
        for frame in frames:
            held[_bloom_bits(frame["doc_id"].to_numpy(), bits).ravel()] = True
        for block, data in blocks_of(np.packbits(held)):
            yield pd.DataFrame({"block": [block], "data": [data]})

    return combined(ids.mapInPandas(run, "block int, data binary"), bits // 8, "u1", "bitwise_or")


def texts_of(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """`cells` with the texts of their documents. Small tables of cells are broadcast to the scan; for larger ones a bloom
    filter of their ids holds most other texts back before the shuffle."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    rows = cells.count()
    if rows <= SMALL:
        return docs.join(F.broadcast(cells), "doc_id")
    bits = 1 << 19
    while bits < 16 * rows and bits < BLOOM_BITS:
        bits *= 2
    shared = docs.sparkSession.sparkContext.broadcast(bloom(cells.select("doc_id"), bits))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for frame in frames:
            at = _bloom_bits(frame["doc_id"].to_numpy(), bits)
            yield frame[((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)]

    return docs.mapInPandas(run, "doc_id long, text string").join(cells, "doc_id")


def blocks_of_families(members: DataFrame) -> DataFrame:
    """`members` with cls (size class: sets that link are at most one class apart), own (its block, null in a family of one
    block), and for the class, the one below and the one above the number of blocks (k, below, above)."""
    cls = F.floor(F.log("n") / math.log(1.34)).cast("int")
    sizes = members.groupBy("fam", cls.alias("cls")).agg(F.sum("n").alias("held"))
    parts = sizes.withColumns({"k": F.ceil(F.col("held") / BLOCK).cast("int"), "all": F.sum("held").over(Window.partitionBy("fam"))})
    by_class = Window.partitionBy("fam").orderBy("cls")
    near = lambda f, d: F.when(f("cls").over(by_class) == F.col("cls") + d, f("k").over(by_class)).otherwise(0)
    parts = parts.withColumns({"below": near(F.lag, -1), "above": near(F.lead, 1)})
    dealt = members.withColumn("cls", cls).join(parts, ["fam", "cls"])
    own = F.when(F.col("all") > BLOCK, _block(F.col("cls"), F.pmod(F.xxhash64("sid"), F.col("k"))))
    return dealt.withColumn("own", own).drop("held", "all")


def _block(cls: Column, part: Column) -> Column:
    return cls.cast("long") * (1 << 32) + part


def _near_blocks() -> Column:
    """All blocks that a set's size class allows a link with."""
    none = F.array().cast("array<long>")

    def blocks(number: str, shift: int) -> Column:
        of = F.transform(F.sequence(F.lit(0), F.greatest(F.col(number), F.lit(1)) - 1), lambda s: _block(F.col("cls") + shift, s))
        return F.when(F.col(number) > 0, of).otherwise(none)

    return F.concat(blocks("k", 0), blocks("below", -1), blocks("above", 1))


CELL = ["doc_id", "sid", "sid2", "fam", "cell", "chunk", "side", "known"]


def first_cells(dealt: DataFrame) -> DataFrame:
    """Every set in its own block; pivots, a few sets of each class of a large family, in all others they could link with."""
    zero = F.lit(0).cast("long")
    own = dealt.select("doc_id", "sid", "sid2", "fam", F.coalesce("own", zero).alias("cell"), zero.alias("chunk"), F.lit(0).alias("side"), F.col("doc_id").alias("known"))
    nth = F.row_number().over(Window.partitionBy("fam", "cls").orderBy("sid", "sid2"))
    pivots = dealt.where("own is not null").withColumn("nth", nth).where(F.col("nth") <= PIVOTS)
    meets = pivots.withColumn("cell", F.explode(_near_blocks())).where("cell <> own")
    return own.unionByName(meets.select("doc_id", "sid", "sid2", "fam", "cell", zero.alias("chunk"), F.lit(0).alias("side"), F.col("doc_id").alias("known")))


def second_cells(dealt: DataFrame, roots: DataFrame) -> DataFrame:
    """For the large families, with the components of the first round as `known`: the sets outside the largest component, in
    chunks of at most about BLOCK shingles, meet every other block they could link with."""
    placed = dealt.where("own is not null").join(roots.select(F.col("node").alias("doc_id"), F.col("component").alias("known")), "doc_id", "left")
    placed = placed.withColumn("known", F.coalesce("known", "doc_id"))
    sizes = placed.groupBy("fam", "known").agg(F.count(F.lit(1)).alias("sets"))
    largest = sizes.groupBy("fam").agg(F.max_by("known", F.struct("sets", "known")).alias("largest"))
    placed = placed.join(largest, "fam")
    rest = placed.where("known <> largest")
    held = rest.groupBy("fam").agg(F.sum("n").alias("rest"))
    placed = placed.join(held.select("fam", F.ceil(F.col("rest") / BLOCK).cast("long").alias("chunks")), "fam")  # families without a rest are done
    chunk = F.pmod(F.xxhash64("sid2"), F.col("chunks"))
    side = lambda x, cell, chunk, which: x.select("doc_id", "sid", "sid2", "fam", cell.alias("cell"), chunk.alias("chunk"), F.lit(which).alias("side"), "known")
    queries = placed.where("known <> largest").withColumn("cell", F.explode(_near_blocks())).where("cell <> own")
    every = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return side(every, F.col("own"), F.col("chunk"), 0).unionByName(side(queries, F.col("cell"), chunk, 1))


class Index:
    """Inverted lists over the sets of one task, with the T-occurrence search."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, token, held = np.unique(flat, return_inverse=True, return_counts=True)
        shared = held[token] > 1
        order = np.argsort(token, kind="stable")
        self.owners = owner[order]
        self.ends = np.cumsum(held)
        self.starts = self.ends - held
        owner, token = owner[shared], token[shared]
        at = np.searchsorted(owner, np.arange(len(sets) + 1))
        self.tokens = [token[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        #: How much a set shares: hubs come first.
        self.weight = np.array([held[t].sum() for t in self.tokens])

    def merged(self, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, hits) of ascending lists: a heap holds the place at which each list goes on; the lists that go on within
        the next SPAN ids leave it together, and their ids there are counted."""
        heap = [(int(one[0]) // SPAN, k, 0) for k, one in enumerate(lists)]
        heapq.heapify(heap)
        ids, hits = [], []
        while heap:
            span, parts = heap[0][0], []
            while heap and heap[0][0] == span:
                _, k, at = heapq.heappop(heap)
                one = lists[k]
                end = len(one) if one[-1] < (span + 1) * SPAN else int(one.searchsorted((span + 1) * SPAN))
                parts.append(one[at:end])
                if end < len(one):
                    heapq.heappush(heap, (int(one[end]) // SPAN, k, end))
            counts = np.bincount(np.concatenate(parts) - span * SPAN)
            found = counts.nonzero()[0]
            ids.append(found + span * SPAN)
            hits.append(counts[found])
        return np.concatenate(ids), np.concatenate(hits)

    def search(self, q: int, allowed: np.ndarray, percent: int) -> np.ndarray:
        """Sets among `allowed` (a mask) that share enough with set q."""
        none = np.zeros(0, np.int64)
        own = int(self.sizes[q])
        least = overlap_needed(own, int(self.sizes[allowed].min()), percent)
        tokens = self.tokens[q]
        if len(tokens) < least:
            return none
        lengths = self.ends[tokens] - self.starts[tokens]
        tokens = tokens[np.argsort(lengths, kind="stable")]
        lists = [self.owners[a:b] for a, b in zip(self.starts[tokens].tolist(), self.ends[tokens].tolist(), strict=True)]
        aside = min(least - 1, int(least / (MU * math.log2(max(2, len(lists[-1]))) + 1)))
        short, long_ = lists[: len(lists) - aside], lists[len(lists) - aside :]
        ids, hits = self.merged(short)
        open_ = allowed[ids] & (hits >= least - aside)
        ids, hits = ids[open_], hits[open_]
        needed = -(-percent * (own + self.sizes[ids]) // (100 + percent))
        found = []
        for left in range(len(long_), -1, -1):  # binary probes, until the outcome is known
            sure = hits >= needed
            found.append(ids[sure])
            open_ = ~sure & (hits + left >= needed)
            ids, hits, needed = ids[open_], hits[open_], needed[open_]
            if not len(ids):
                break
            one = long_[len(long_) - left]
            at = np.minimum(one.searchsorted(ids), len(one) - 1)
            hits = hits + (one[at] == ids)
        return np.concatenate(found) if found else none


def links_of(names: np.ndarray, sides: np.ndarray, known: np.ndarray, sets: list[np.ndarray], crossed: bool, percent: int) -> list[tuple[int, int]]:
    """Links that join components, among the sets of a task (of its two sides with each other if `crossed`); sets with
    equal `known` are in one component already."""
    if len(sets) < 2:
        return []
    index = Index(sets)
    _, component = np.unique(known, return_inverse=True)
    waiting = np.ones(len(sets), bool)
    out = []
    n = index.sizes
    order = np.lexsort((names, -index.weight))
    for q in (order[sides[order] == 1] if crossed else order).tolist():
        waiting[q] = False
        if not len(index.tokens[q]):
            continue
        allowed = component != component[q]
        allowed &= (sides == 0) if crossed else waiting
        allowed &= (n * 100 >= n[q] * percent) & (n[q] * 100 >= n * percent)
        if not allowed.any():
            continue
        found = index.search(q, allowed, percent)
        joined, first = np.unique(component[found], return_index=True)
        out += [(int(names[q]), int(names[u])) for u in found[first]]
        if len(joined):
            component[np.isin(component, joined)] = component[q]
    return out


def family_links(cells: DataFrame, width: int, percent: int, crossed: bool = False) -> DataFrame:
    """(src, dst): spanning links of every cell (of its two sides, if `crossed`); the sets are made from the texts where they are compared."""
    key = ["fam", "cell", "chunk"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, parts in sorted_groups(batches, key):
            found: dict[tuple[int, int, int], tuple[np.ndarray, int, int]] = {}
            for part in parts:
                rows = zip(part["sid"], part["sid2"], part["side"], part["doc_id"], part["known"], shingle_sets(part["text"].tolist(), width), strict=True)
                for sid, sid2, side, doc_id, known, s in rows:
                    if (sid, sid2, side) not in found and _set_id(s) == (sid, sid2):  # rows that repeat an id may have other texts
                        found[sid, sid2, side] = s, doc_id, known
            sides = np.array([side for *_, side in found], np.int64)
            names, known = (np.array([x[k] for x in found.values()], np.int64) for k in (1, 2))
            links = links_of(names, sides, known, [x[0] for x in found.values()], crossed, percent)
            if links:
                yield pd.DataFrame(links, columns=["src", "dst"])

    dealt = cells.repartition(shuffles(cells.sparkSession), *key).sortWithinPartitions(*key)
    return dealt.mapInPandas(run, "src long, dst long")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of `docs(doc_id, text)`."""
    made = cut(set_table(docs, width))
    order = combined(made.where("block >= 0").select("block", "data"), CELLS, "u4", "add", rarity)
    every = made.where("block < 0").select("doc_id", "no_id", "n", "sid", "sid2")
    hot = bool((parts_of(order) > 1).any())
    families = connected_components(family_edges(prefix_rows(docs, order, width, percent), percent, hot), cut=cut)
    # One row a set: the smallest id of its documents stands for it. Sets without an id stay out.
    # Written, so that the last join does not share a shuffle with this one, and a set of very many copies can be split there.
    ids = cut(every.where("not no_id and n > 0").groupBy("sid", "sid2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")))
    dealt = cut(blocks_of_families(ids.join(families.select(F.col("node").alias("sid"), F.col("component").alias("fam")), "sid")))
    links = cut(family_links(texts_of(docs, first_cells(dealt).select(CELL)), width, percent))
    roots = connected_components(links, cut=cut)
    if not dealt.where("own is not null").isEmpty():
        again = cut(second_cells(dealt, roots).select(CELL))
        if not again.isEmpty():
            roots = connected_components(links.union(cut(family_links(texts_of(docs, again), width, percent, True))), cut=cut)
    # Most sets link with nothing; only those that do carry a component of another name than their own id.
    linked = roots.where("node <> component").select(F.col("node").alias("doc_id"), "component")
    names = ids.join(linked, "doc_id", "left").select("sid", "sid2", F.coalesce("component", "doc_id").alias("component_id"))
    placed = every.where("n > 0").join(names, ["sid", "sid2"], "left").select(renulled(), F.col("n").alias("n_shingles"), "component_id")
    return placed.union(every.where("n = 0").select(renulled(), "n", renulled()))


def _first_by(rows: DataFrame, key: str) -> DataFrame:
    """One row of each `key`; each task passes on one of its own at most, so a key of many rows makes no hot task."""
    nth, place = F.row_number().over(Window.partitionBy(key).orderBy("text")), free_name(rows, "_nth")
    return rows.withColumn(place, nth).where(F.col(place) == 1).drop(place)


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` without near copies: of each component the row with the smallest id stays, once.

    It goes by row, not by id: rows that share an id but have other texts are documents of their own, and so are
    rows with a null id, which come after all others. Ties go to the smaller text; of equal ids and texts one row
    stays. Rows without shingles link with nothing, so each of their ids and texts stays once."""
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    own = free_name(docs, "_key")
    every = docs.withColumn(own, key)
    rows = every.select(F.col(own).alias("_key"), "doc_id", "text")
    placed = cut(jaccard_components(rows.select(F.col("_key").alias("doc_id"), "text"), width, percent))
    sets = placed.select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_set")).distinct()
    ids = cut(rows.select("_key", "doc_id").distinct().join(sets, "_key").withColumn("_no_id", F.col("doc_id").isNull()))
    first = F.struct("_no_id", "doc_id")
    best = cut(ids.groupBy("_set").agg(F.min(first).alias("_least"), F.min(F.struct("_no_id", "doc_id", "_key")).alias("_best")))
    held = ids.join(best, "_set").where(first.eqNullSafe(F.col("_least"))).groupBy("_set").agg(F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_key"))
    held = cut(held)
    keep = held.where("_n = 1").select("_key")
    several = held.where("_n > 1").select("_set")
    if not several.isEmpty():  # other texts under the smallest id: the smaller text stays
        several = ids.join(several, "_set", "left_semi").join(best, "_set").where(first.eqNullSafe(F.col("_least"))).select("_key", "_set")
        by_text = rows.select("_key", "text").join(several, "_key").groupBy("_set").agg(F.min_by("_key", "text").alias("_key"))
        keep = keep.unionByName(by_text.select("_key"))
    return _first_by(every, own).join(keep.select(F.col("_key").alias(own)), own, "left_semi").select(docs.columns)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
