"""Context-tree weighting over bytes: code lengths of texts under all context depths mixed.

A byte is eight binary decisions, each with its own Krichevsky-Trofimov estimate in every context of 0 to `depth`
bytes before it. A node's weighted probability is half its own estimate and half the product of its children's;
after training, the posterior odds of "stop here" against "go deeper" mix the estimates along a context's path.
Texts start after `depth` bytes 0xFE and end with 0xFF, bytes that UTF-8 never has, so the probabilities of all
texts sum to one.

At scale. A text contributes its (context, byte) grams, one 64-bit code each. Documents are dealt into blocks; a
block sends each distinct gram once, with its count in training texts (0 if only held-out texts have it), packed
by buckets of the last two context bytes. A bucket's task merges the blocks' counts as a stream, learns the
bucket's part of the tree, and writes the log probability of each of its grams. A second pass hands every block
the probabilities of its own grams. So the model is never broadcast nor collected, what travels grows with the
input, and a task holds one bucket or one block. Depths 0 and 1 lie above the buckets: their counts are 256 * 256
numbers, summed over all and sent to each bucket (a fixed size), and the products of subtrees that their weights
need are one number per bucket and bit node, of fixed size too.

Words for the base score travel the same way: a block's distinct words meet their counts in a join, so a frequent
word has a row per block and not per occurrence.

Edge cases: a null text counts as empty and is scored by its end alone; a null doc_id counts as the text '' when
dealing out folds; blocks go by id and text; without training documents counts are 0 and every byte costs 8 bits; repeated rows
count and are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import BLOCK as ARRAY_BLOCK
from .arrays import blocks_of, combined
from .common import cut, numbered, renulled, shuffles, sorted_groups, table

DEPTH = 5
PAD, END = 0xFE, 0xFF
#: Text bytes of a block on average, and grams worked on at once.
BLOCK_BYTES, CHUNK = 8 << 20, 1 << 22
WORD_BUCKETS = 1024
GRAMS, WORDS, DOCS = 0, 1, 9
_LOG_HALF = math.log(0.5)
#: log of (1/2)(3/2)...(n-1/2) and of n!, for small n.
_SMALL = 1 << 16
_HALVES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL) + 0.5))])
_WHOLES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL) + 1.0))])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for large x."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _log_halves(n: np.ndarray) -> np.ndarray:
    return np.where(n <= _SMALL, _HALVES[np.minimum(n, _SMALL)], _log_gamma(np.maximum(n, 1) + 0.5) - 0.5 * math.log(math.pi))


def _log_wholes(n: np.ndarray) -> np.ndarray:
    return np.where(n <= _SMALL, _WHOLES[np.minimum(n, _SMALL)], _log_gamma(np.maximum(n, 1) + 1.0))


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _log_halves(zeros) + _log_halves(ones) - _log_wholes(zeros + ones)


def gram_codes(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every byte of the texts and their ends, with the bounds of each text in them.

    A code is the `depth` bytes before, the latest first, then the byte: codes in order walk the context tree."""
    pad = bytes([PAD]) * depth
    data = np.frombuffer(pad + pad.join(t + bytes([END]) for t in texts), np.uint8)
    codes = data[depth:].astype(np.uint64)
    for back in range(1, depth + 1):
        codes |= data[depth - back : len(data) - back].astype(np.uint64) << np.uint64(8 * (depth + 1 - back))
    lengths = np.array([len(t) + 1 for t in texts])
    keep = np.ones(len(codes), bool)
    ends = np.cumsum(lengths + depth)
    for gap in range(depth):
        keep[ends[:-1] - 1 - gap] = False
    return codes[keep], np.concatenate([[0], np.cumsum(lengths)])


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def distinct_grams(codes: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with how often each stands where `training` is true."""
    parts = []
    for s in range(0, len(codes), CHUNK):
        marked = np.sort(codes[s : s + CHUNK] << np.uint64(1) | training[s : s + CHUNK].astype(np.uint64))
        plain = marked >> np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], plain[1:] != plain[:-1]]))
        parts.append((plain[first], np.add.reduceat((marked & np.uint64(1)).astype(np.int64), first)))
    if len(parts) == 1:
        return parts[0]
    return summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


class Level:
    """The nodes of one bit position (`level` bits known) in all contexts of one subtree, for depths 2 to `depth`."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, level: int, depth: int):
        # A node is its context and its known bits; the bits stand where the byte's first bits stood.
        shift = np.uint64(8 - level)
        symbol = codes & np.uint64(0xFF)
        ones = (symbol >> np.uint64(7 - level) & np.uint64(1)).astype(bool)
        node = (codes >> np.uint64(8)) << np.uint64(8) | (symbol >> shift if level else np.uint64(0))
        self.ones = ones
        self.zero_n, self.one_n, self.log_kt, self.log_go, self.at = {}, {}, {}, {}, {}
        log_w = below = None
        for d in range(depth, 1, -1):
            # Drop the oldest context byte for each depth less.
            if d == depth:
                keys, at = np.unique(node, return_inverse=True)
                zeros = np.bincount(at, weights=np.where(ones, 0, counts), minlength=len(keys)).astype(np.int64)
                one_n = np.bincount(at, weights=np.where(ones, counts, 0), minlength=len(keys)).astype(np.int64)
                path = at
            else:
                bits = below & np.uint64(0xFF)
                shorter = (below >> np.uint64(16)) << np.uint64(8) | bits
                keys, up = np.unique(shorter, return_inverse=True)
                zeros = np.bincount(up, weights=self.zero_n[d + 1], minlength=len(keys)).astype(np.int64)
                one_n = np.bincount(up, weights=self.one_n[d + 1], minlength=len(keys)).astype(np.int64)
                path = up[self.at[d + 1]]
                self.log_go[d] = np.bincount(up, weights=log_w, minlength=len(keys))
            self.zero_n[d], self.one_n[d], self.at[d] = zeros, one_n, path
            self.log_kt[d] = kt_log(zeros, one_n)
            log_w = self.log_kt[d] if d == depth else _LOG_HALF + np.logaddexp(self.log_kt[d], self.log_go[d])
            below = keys
        #: The subtree's top nodes: their bits (the context is the same), counts and weighted log probabilities.
        self.top_bits, self.top_log_w = (below & np.uint64(0xFF)).astype(np.int64), log_w
        self.top_path = self.at[2]

    def probability(self, depth: int, upper: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """P(the bit that stands) for every gram; `upper` has (weight of stopping, KT estimate) for depths 1 and 0."""
        one = (self.one_n[depth] + 0.5) / (self.zero_n[depth] + self.one_n[depth] + 1.0)
        p = one[self.at[depth]]
        for d in range(depth - 1, 1, -1):
            stop = 1 / (1 + np.exp(np.clip(self.log_go[d] - self.log_kt[d], -700, 700)))
            own = (self.one_n[d] + 0.5) / (self.zero_n[d] + self.one_n[d] + 1.0)
            p = stop[self.at[d]] * own[self.at[d]] + (1 - stop[self.at[d]]) * p
        bits = self.top_bits[self.top_path]
        for stop, own in upper:
            p = stop[bits] * own[bits] + (1 - stop[bits]) * p
        return np.where(self.ones, p, 1 - p)


#: Numbers that a subtree adds to the tree's top, per first context byte and bit node: log of its weighted
#: probability, zeros and ones. One block of the fixed array has the three for one context byte and more.
TOP_CELLS = -(-3 * 256 * 256 // ARRAY_BLOCK) * ARRAY_BLOCK


def top_share(key: int, codes: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """What the subtree of the two latest context bytes `key` adds to the tree's top."""
    out = np.zeros((3, 256, 256))
    for level in range(8):
        nodes = Level(codes, counts, level, depth)
        at = (1 << level) + nodes.top_bits
        out[0, key >> 8, at] = nodes.top_log_w
        out[1, key >> 8, at], out[2, key >> 8, at] = nodes.zero_n[2], nodes.one_n[2]
    return np.concatenate([out.ravel(), np.zeros(TOP_CELLS - out.size)])


def tree_top(shares: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weight of stopping, KT estimate) by [context byte, bit node] at depth 1 and by [bit node] at depth 0."""
    go, zeros, ones = shares[: 3 * 256 * 256].reshape(3, 256, 256)
    out = []
    for _ in range(2):
        kt = kt_log(zeros.astype(np.int64), ones.astype(np.int64))
        out.append((1 / (1 + np.exp(np.clip(go - kt, -700, 700))), (ones + 0.5) / (zeros + ones + 1.0)))
        log_w = _LOG_HALF + np.logaddexp(kt, go)
        go, zeros, ones = log_w.sum(axis=0), zeros.sum(axis=0), ones.sum(axis=0)
    return out


def gram_scores(key: int, codes: np.ndarray, counts: np.ndarray, top: list[tuple[np.ndarray, np.ndarray]], depth: int) -> np.ndarray:
    """log10 P(byte | context) of every gram of a subtree."""
    total = np.zeros(len(codes))
    for level in range(8):
        first = 1 << level
        stop1, own1 = top[0][0][key >> 8, first : 2 * first], top[0][1][key >> 8, first : 2 * first]
        stop0, own0 = top[1][0][first : 2 * first], top[1][1][first : 2 * first]
        total += np.log10(Level(codes, counts, level, depth).probability(depth, [(stop1, own1), (stop0, own0)]))
    return total


def _packed(array: np.ndarray) -> bytes:
    return zlib.compress(array.tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def _lowered(texts: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]


def _key_bounds(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    keys = (codes >> np.uint64(8 * (depth - 1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.append(first, len(codes))


def block_rows(batches: Iterator[pd.DataFrame], depth: int) -> Iterator[pd.DataFrame]:
    """(block, kind, bucket, data, counts): a block's distinct grams and words with their counts in training texts."""
    for (block,), parts in sorted_groups(batches, ["block"]):
        rows = pd.concat([p[["text", "held_out"]] for p in parts], ignore_index=True)
        texts, held = _lowered(rows["text"]), rows["held_out"].to_numpy()
        out: list[tuple[int, int, bytes, bytes]] = []
        codes, bounds = gram_codes(texts, depth)
        codes, counts = distinct_grams(codes, np.repeat(~held, np.diff(bounds)))
        low = (codes & np.uint64((1 << 8 * (depth - 1)) - 1)).astype("<u8" if depth > 5 else "<u4")
        keys, ends = _key_bounds(codes, depth)
        for key, a, b in zip(keys.tolist(), ends[:-1], ends[1:], strict=True):
            out.append((GRAMS, key, _packed(low[a:b]), _packed(counts[a:b])))
        words: Counter[bytes] = Counter()
        for text, skip in zip(texts, held, strict=True):
            if skip:
                words.update(dict.fromkeys(text.split(), 0))
            else:
                words.update(text.split())
        buckets: dict[int, list[bytes]] = {}
        for word in words:
            buckets.setdefault(zlib.crc32(word) % WORD_BUCKETS, []).append(word)
        for bucket, own in buckets.items():
            own.sort()
            out.append((WORDS, bucket, zlib.compress(b"\n".join(own), 1), _packed(np.array([words[w] for w in own], np.int64))))
        made = pd.DataFrame(out, columns=["kind", "bucket", "data", "counts"])
        made.insert(0, "block", block)
        yield made


def merged_rows(batches: Iterator[pd.DataFrame], depth: int) -> Iterator[pd.DataFrame]:
    """(kind, bucket, data, counts, known, total, share): the sums over all blocks, as a stream."""
    kind_of = "<u8" if depth > 5 else "<u4"
    for (kind, bucket), parts in sorted_groups(batches, ["kind", "bucket"]):
        words: Counter[bytes] = Counter()
        codes, counts, held = [], [], 0
        for part in parts:
            for data, count in zip(part["data"], part["counts"], strict=True):
                n = _unpacked(count, "<i8")
                if kind == WORDS:
                    words.update(dict(zip(zlib.decompress(data).split(b"\n"), n.tolist(), strict=True)))
                    continue
                codes.append(_unpacked(data, kind_of))
                counts.append(n)
                held += len(n)
                if held > CHUNK:
                    one = summed(np.concatenate(codes), np.concatenate(counts))
                    codes, counts, held = [one[0]], [one[1]], len(one[0]) // 2
        if kind == WORDS:
            own = sorted(words)
            n = np.array([words[w] for w in own], np.int64)
            data, share = zlib.compress(b"\n".join(own), 1), None
        else:
            own, n = summed(np.concatenate(codes), np.concatenate(counts))
            data = _packed(own)
            share = zlib.compress(top_share(bucket, own.astype(np.uint64), n, depth).tobytes(), 1)
        yield pd.DataFrame(
            {"kind": [kind], "bucket": [bucket], "data": [data], "counts": [_packed(n)], "known": [int((n > 0).sum())], "total": [int(n.sum())], "share": [share]}
        )


def answered_rows(batches: Iterator[pd.DataFrame], top: list[tuple[np.ndarray, np.ndarray]], depth: int) -> Iterator[pd.DataFrame]:
    """(block, kind, bucket, data, counts): to each block the scores of its grams and the counts of its words.
    In a bucket the sums come first (block -1), then the blocks' questions."""
    kind_of = "<u8" if depth > 5 else "<u4"
    for (kind, bucket), parts in sorted_groups(batches, ["kind", "bucket"]):
        known: dict[bytes, int] = {}
        codes = scores = np.zeros(0)
        for part in parts:
            out = []
            for block, data, count in zip(part["block"], part["data"], part["counts"], strict=True):
                if block < 0:
                    n = _unpacked(count, "<i8")
                    if kind == WORDS:
                        known = dict(zip(zlib.decompress(data).split(b"\n"), n.tolist(), strict=True))
                    else:
                        codes = _unpacked(data, kind_of)
                        scores = gram_scores(bucket, codes.astype(np.uint64), n, top, depth).astype("<f4")
                elif kind == WORDS:
                    found = [known[w] for w in zlib.decompress(data).split(b"\n")]
                    out.append((block, kind, bucket, data, _packed(np.array(found, np.int64))))
                else:
                    out.append((block, kind, bucket, b"", scores[np.searchsorted(codes, _unpacked(data, kind_of))].tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["block", "kind", "bucket", "data", "counts"])


def _looked_up(codes: np.ndarray, distinct: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Scores of `codes`; small sorted runs keep the search in cache."""
    out = np.empty(len(codes), np.float64)
    for s in range(0, len(codes), 1 << 16):
        run = codes[s : s + (1 << 16)]
        order = np.argsort(run)
        out[s + order] = scores[np.searchsorted(distinct, run[order])]
    return out


def scored_rows(batches: Iterator[pd.DataFrame], n_train: int, vocabulary: int, ends: int, depth: int) -> Iterator[pd.DataFrame]:
    """Scores of a block's documents; its answers come first, in order of bucket."""
    norm = n_train + 0.5 * (vocabulary + 1)
    for _, parts in sorted_groups(batches, ["block"]):
        tables, known, docs = [], {}, []
        for part in parts:
            for kind, data, counts in part.loc[part["kind"] != DOCS, ["kind", "data", "counts"]].itertuples(index=False):
                if kind == GRAMS:
                    tables.append(np.frombuffer(counts, "<f4"))
                else:
                    known.update(zip(zlib.decompress(data).split(b"\n"), _unpacked(counts, "<i8").tolist(), strict=True))
            docs.append(part.loc[part["kind"] == DOCS, ["doc_id", "no_id", "held_out", "text"]])
        rows = pd.concat(docs, ignore_index=True)
        if not len(rows):
            continue
        texts = _lowered(rows["text"])
        codes, bounds = gram_codes(texts, depth)
        distinct, _ = distinct_grams(codes, np.zeros(len(codes), bool))
        scores = np.add.reduceat(_looked_up(codes, distinct, np.concatenate(tables)), bounds[:-1])
        n_tokens, n_known, base = [], [], []
        end = (math.log10((ends + 0.5) / norm), int(ends > 0))
        for text in texts:
            c = np.array([known[w] for w in text.split()], np.float64)
            n_tokens.append(len(c) + 1)
            n_known.append(int((c > 0).sum()) + end[1])
            base.append(float(np.log10((c + 0.5) / norm).sum()) + end[0])
        yield pd.DataFrame(
            {"doc_id": rows["doc_id"].astype("int64"), "no_id": rows["no_id"].astype(bool), "held_out": rows["held_out"].astype(bool), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": n_train, "base_score": base, "score": scores}
        )


def block_of(n_blocks: int) -> Column:
    """A row's block. The text takes part, so that neither null ids nor an id of many rows make a large block."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks))


def ctw_scores(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Learn from the documents whose crc32(doc_id as text) mod 5 is not 1 and score all of them."""
    if not 2 < depth < 7:
        raise ValueError("depth is 3 to 6")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = size // block_bytes + 1
    as_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    dealt = numbered(
        docs.select("doc_id", "text", (F.crc32(as_text) % 5 == 1).alias("held_out"), block_of(n_blocks).alias("block"))
    )
    parts = min(n_blocks, 2 * shuffles(spark))

    def streamed(rows: DataFrame, n: int, key: list[str], order: list[str], work, schema: str, *args) -> DataFrame:
        sorted_rows = rows.repartition(n, *key).sortWithinPartitions(*key, *order)
        return sorted_rows.mapInPandas(lambda batches: work(batches, *args), schema)

    sent = "block long, kind int, bucket int, data binary, counts binary"
    questions = cut(streamed(dealt.select("block", "held_out", "text"), parts, ["block"], [], block_rows, sent, depth))
    sums = cut(
        streamed(
            questions, 2 * shuffles(spark), ["kind", "bucket"], [], merged_rows,
            "kind int, bucket int, data binary, counts binary, known long, total long, share binary", depth,
        )
    )
    ends = dealt.where("not held_out").count()
    known, words = sums.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(TOP_CELLS)
        for batch in batches:
            for share in batch["share"]:
                total += _unpacked(share, "<f8")
        for block, data in blocks_of(total):
            yield pd.DataFrame({"block": [block], "data": [data]})

    top = tree_top(combined(sums.where(F.col("kind") == GRAMS).select("share").mapInPandas(shares, "block int, data binary"), TOP_CELLS, "f8", "add"))
    asked = questions.unionByName(sums.select(F.lit(-1).cast("long").alias("block"), "kind", "bucket", "data", "counts"))
    answers = streamed(asked, 2 * shuffles(spark), ["kind", "bucket"], ["block"], answered_rows, sent, top, depth)
    rows = answers.unionByName(dealt.withColumns({"kind": F.lit(DOCS), "bucket": F.lit(0)}), allowMissingColumns=True)
    out = streamed(
        rows, parts, ["block"], ["kind", "bucket"], scored_rows,
        "doc_id long, no_id boolean, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        int(words) + ends, int(known) + (ends > 0), ends, depth,
    )
    return out.select(renulled(), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", (-F.col("score") * math.log2(10)).alias("code_length_bits"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_scores(table(spark, sf_dir, "documents"))
