"""BPE, packing and the pipeline against the libraries and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from fernglass.llm import bpe, packing
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
LETTERS = " \n\t\r  ab'sDé中\x1c\x85 　😀1²%#., \x00\x0b"


def hard_texts(n):
    draw = random.Random(1)
    texts = ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 50))) for _ in range(n)]
    return [*texts, "", "a" * 3000, "ab" * 900 + " " * 700 + "x", "é" * 400, " a  b   c ", "\n\n a", "<|endoftext|> a", "x'll 's"]


def test_bpe_is_that_of_the_library(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = hard_texts(400) + [None]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    rows = bpe.decode_table(bpe.encode_table(frame, path, public_tokenizers.PATTERN), path).collect()
    for r in rows:
        want = library.encode_ordinary(texts[r.doc_id] or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want) and r.decoded == (texts[r.doc_id] or "").encode()
    for r in bpe.digests(frame, path, public_tokenizers.PATTERN).collect():
        ids = np.array(library.encode_ordinary(texts[r.doc_id] or ""), "<u4").tobytes()
        assert (r.ids_sha256, r.decoded_sha256) == (hashlib.sha256(ids).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())
    assert bpe.digests(frame.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_long_pieces_merge_alike():
    ranks = bpe.ranks_at(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    draw = random.Random(3)
    for n in (2, 90, 255):
        piece = bytes(draw.choice(b"theanr") for _ in range(n))
        assert ranks.encode_long(piece).tolist() == ranks.encode_bucket([piece, b"ab"])[0].tolist()


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_are_those_of_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = hard_texts(200) + [None, None, "word " * 5000]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = packing.pack_documents(frame, path, 64).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    library = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(ids)
        assert all(p.length == 64 for p in pieces[1:])
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    total = sum(r.length for r in rows)
    assert check_packing(rows, 64) <= -(-total // 64) + 1
    assert packing.pack_documents(frame.limit(0), path, 64).count() == 0


def test_texts_with_an_added_token_are_those_of_the_plain_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["<|endoftext|> a", "one two<|endoftext|>three", "a  <|endoftext|>  b \n<|endoftext|>", "x <|endoftext|><|endoftext|> y", "<|endoftext |> no mark"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in packing.pack_documents(frame, path, 64).collect()}
    library = Tokenizer.from_file(path)
    assert library.encode(texts[0], add_special_tokens=False).ids == [50256, 257]
    for i, t in enumerate(texts):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        assert (rows[i].length, rows[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def least_bins(sizes, capacity):
    """The fewest bins, by trying everything."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for at in range(len(rooms)):
            if rooms[at] >= sizes[k] and rooms[at] not in rooms[:at]:
                place(k + 1, [*rooms[:at], rooms[at] - sizes[k], *rooms[at + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_packing_search_against_brute_force(seed):
    draw = random.Random(seed)
    sizes = [draw.randint(1, 30) for _ in range(11)]
    plan = packing.complete(Counter(sizes), 30)
    used = Counter()
    for uses, pattern in plan.patterns:
        assert sum(a * n for a, n in pattern.items()) <= 30
        used.update({a: uses * n for a, n in pattern.items()})
    assert used == Counter(sizes) and least_bins(sizes, 30) <= plan.bins <= least_bins(sizes, 30) + (seed in ())
    assert packing.lower_bound(Counter(sizes), 30) <= plan.bins


def test_ids_of_the_vocabulary_and_of_hard_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encode = Tokenizer.from_file(path), packing.fast_encoder(path)
    byte = packing.byte_of_sign()
    tokens = [bytes(byte[c] for c in t).decode("utf-8", "replace") for t in library.get_vocab() if t != "<|endoftext|>"]
    for text in [*tokens, *hard_texts(2000), "\n\n x \n\n", "\u3000\u3000a \x1c\x1c b\x85\x85c", "a" * 100_000]:
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_files_of_other_kinds_go_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.fast_encoder(path) is None
    text = "Some  Words, and\nmore"
    assert packing.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def every_filling(counts, room):
    """Every filling of a room, by trying everything."""
    out = [{}]
    for length, n in counts.items():
        out = [f | ({length: k} if k else {}) for f in out for k in range(n + 1) if sum(a * m for a, m in f.items()) + k * length <= room]
    return out


def fits_into(pieces, rooms):
    """Whether the pieces can be dealt to the rooms (Martello and Toth: then the filling `rooms` dominates)."""
    if not pieces:
        return True
    return any(fits_into(pieces[1:], [*rooms[:k], r - pieces[0], *rooms[k + 1 :]]) for k, r in enumerate(rooms) if r >= pieces[0])


@pytest.mark.parametrize("seed", range(40))
def test_no_filling_dominates_another(seed):
    draw = random.Random(seed)
    room = draw.randint(5, 26)
    counts = Counter(draw.randint(1, 14) for _ in range(8))
    found = packing.fillings(sorted(counts), counts, room, 1000, room, 10**6)
    flat = lambda f: sorted((a for a, n in f.items() for _ in range(n)), reverse=True)
    every = [flat(f) for f in every_filling(counts, room)]
    for f in map(flat, found):
        assert not any(sorted(o) != sorted(f) and fits_into(f, o) for o in every)
    for f in every:  # and nothing undominated is missing
        assert f in [flat(x) for x in found] or any(o != f and fits_into(f, o) for o in every)


def test_places_with_clashing_columns_and_null_ids(spark):
    big = 2**53 + 1
    texts = [(big, "a b c"), (None, "x"), (None, None), (big, "a b c"), (-(2**63), "word " * 100)]
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in texts], "doc_id long, text string, part int, offset int, first int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(frame, path, 16).collect()
    assert Counter(r.doc_id for r in rows)[big] == 2 and Counter(r.doc_id for r in rows)[None] == 2
    check_packing(rows, 16)
    made = packing.pack(frame.select("*", (frame.part * 7).cast("long").alias("length"), frame.part.alias("row"), frame.part.alias("sequence_id")), ["doc_id"], 16)
    assert made.columns == ["doc_id", "text", "part", "first", "length", "row", "sequence_id", "offset"]
    assert check_packing(made.collect(), 16) == 3
    ids = {r.doc_id for r in bpe.digests(frame, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    assert ids == {big, None, -(2**63)}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    ids = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).toPandas(), docs.schema)
        assert kept.columns == columns
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
    assert ids[0] >= ids[1] == ids[2] and len(ids[2]) > 100
    texts = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert all(len(t) == n and 'token = "[0-9a-f]' not in t for t, n in texts.values())
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == ids[2]
    check_packing(rows, 2048)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows[:50]:
        whole = [*library.encode(texts[r.doc_id][0], add_special_tokens=False).ids, 0]
        assert r.ids_crc32 == zlib.crc32(np.array(whole[r.start : r.start + r.length], "<u4").tobytes())


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every row of the pipeline on a small table: rules by hand, all pairs of sets, planted secrets, library ids."""
    import corpus_pipeline
    from test_rows import brute_verdict
    from test_sets import brute_components

    draw = random.Random(31)
    words = ["river", "mill", "stone", "house", "evening", "winter", "letter", "morning", "garden", "window", "table", "journey", "village", "bridge", "market"]
    prose = lambda n: "\n".join(" ".join(draw.choice(words) for _ in range(draw.randint(6, 14))).capitalize() + "." for _ in range(n))
    key = lambda: "".join(draw.choice("0123456789abcdef") for _ in range(40))
    texts = [None, "", "too short"]
    for k in range(30):
        text = prose(draw.randint(4, 60))
        if k % 3 == 0:
            text += f'\nThe note said token = "{key()}" and no more.'
        if k % 4 == 0:
            text = "home | next | back\n" + text
        texts += [text, text + " So it ends."] if k % 5 == 0 else [text]
    texts += ["home | next | back\n" * 30, "word " * 400, prose(900)]
    ids = [*draw.sample(range(1000), len(texts) - 2), None, 2**53 + 1]
    rows = list(zip(ids, texts, ["en"] * len(texts), [f"s{k % 3}" for k in range(len(texts))], [len(t or "") for t in texts], strict=True))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))

    kept = [(i, clean) for i, t in zip(ids, texts, strict=True) for ok, clean, _ in [brute_verdict(t)] if ok]
    groups = defaultdict(list)
    for (i, text), (_, _, root) in zip(kept, brute_components([t for _, t in kept]), strict=True):
        groups[root].append((i is None, i or 0, text))
    kept = [(None if no_id else i, text) for no_id, i, text in map(min, groups.values())]
    assert 0 < len(kept) < len(rows) - 5
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in kept:
        whole = [*library.encode(re.sub(r'token = "[0-9a-f]{40}"', 'token = "[SECRET]"', text), add_special_tokens=False).ids, 0]
        first = len(whole) % 2048 or min(len(whole), 2048)
        bounds = [0, *range(first, len(whole) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(whole[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == sorted(want, key=repr)
    assert check_packing(found, 2048) == -(-sum(w[3] for w in want) // 2048)
