"""Top-k, chat repair, n-gram join and language model against brute force."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from fernglass.llm import chat, ctw, jaccard, topk
from fernglass.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_topk_against_brute_force(spark):
    draw = random.Random(1)
    rows = [(i, [draw.choice([-1.0, -0.3, 0.0, 0.26, 1.0]) for _ in range(4)], "x") for i in range(140)]
    rows += [(200, None, "x"), (201, [1.0, None, 0.0, 0.0], "x"), (202, [math.nan, 0.0, 0.0, 0.0], "x"), (203, [math.inf, 0.0, 0.0, 0.0], "x"), (250, [], "x"), (300, [1e6, 2e6], "x"), (350, [1e6, 2e6], "x")]
    frame = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<double>, score string")
    found = topk.top_k(topk.integer_vectors(frame, "vec_id", "embedding", 256), topk.F.col("id") % 50 == 0, 5, 3, 2).collect()
    whole = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q, a in whole.items():
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole.items() if i != q and len(a) == len(b))
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])]
    assert sorted(tuple(r) for r in found) == sorted(want)
    assert topk.top_k(topk.integer_vectors(frame.limit(0), "vec_id", "embedding", 256), topk.F.col("id") % 50 == 0, 5, 2).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_topk_where_own_rows_share_a_cell_with_the_best(spark, parts):
    draw = random.Random(11)
    rows = [(i, [draw.randint(-9, 9) / 4 for _ in range(3)]) for i in range(60)]
    rows += [(100, [k / 4, 1.0, -k / 8]) for k in range(40)] + [(150, [0.5, 0.25, 4.0, 1.0]), (151, [1.0, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(topk.integer_vectors(frame, "vec_id", "embedding", 256), topk.F.col("id") % 50 == 0, 5, parts, 1).collect()
    whole = sorted({(i, *[math.floor(256 * x) for x in v]) for i, v in rows})
    want = []
    for q in sorted({i for i, *_ in whole if i % 50 == 0}):
        pairs = [(-sum(x * y for x, y in zip(a, b, strict=True)), j) for i, *a in whole if i == q for j, *b in whole if j != q and len(a) == len(b)]
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted(pairs)[:5])]
    assert {q for q, *_ in want} == {0, 50, 100, 150}
    assert sorted(tuple(r) for r in found) == sorted(want)


def cheapest(own):
    """Least cost over all ways to assign roles, by trying them all."""
    best = math.inf
    for roles in itertools.product((1, 2, 3), repeat=len(own)):
        cost, state = 0, 0
        for o, r in zip(own, roles, strict=True):
            cost, state = cost + chat.step_cost(state, r, o), r
        best = min(best, cost)
    return best


@pytest.mark.parametrize("parts", [1, 3])
def test_topk_of_large_components(spark, parts):
    draw = random.Random(5)
    rows = [(i, [draw.choice([1e300, -1e300, 1e15, 0.3, -7.5, 1e9, 2.0**60]) for _ in range(3)]) for i in range(120)]
    rows += [(150, [1e308, 1.0, 1.0]), (200, [3e7, 3e7, 1.0]), (201, [2.0, 2.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(topk.integer_vectors(frame, "vec_id", "embedding", 256), topk.F.col("id") % 50 == 0, 5, parts, 1).collect()
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if math.isfinite(256 * max(map(abs, v)))}
    want = []
    for q in whole:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(whole[q], b, strict=True)), j) for j, b in whole.items() if j != q)[:5]
            want += [(q, n + 1, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(best)]
    assert {q for q, *_ in want} == {0, 50, 100, 200} and sorted(tuple(r) for r in found) == sorted(want)


@pytest.mark.parametrize(("segment", "crowd", "size"), [(2, 1 << 16, 4096), (64, 3, 2), (3, 1, 1)])
def test_chat_repair_against_brute_force(spark, segment, crowd, size):
    draw = random.Random(2)
    turns, own = [], {}
    for conv in range(60):
        roles = [draw.choice(["system", "user", "assistant", "tool", None]) for _ in range(draw.randint(1, 6))]
        own[conv] = [{"system": 1, "user": 2, "assistant": 3}.get(r, 0) for r in roles]
        turns += [(conv, t, r, f"t{t}", 9) for t, r in enumerate(roles)]
    turns += [(None, None, "user", None, 1), (99, 5, "user", "same", 1), (99, 5, "user", "same", 1)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, cost int")
    found = chat.repair_roles(frame, segment, crowd, size).collect()
    assert len(found) == len(turns)
    for conv, roles in own.items():
        rows = sorted((r for r in found if r.conv_id == conv), key=lambda r: (r.segment, r.position))
        assert {r.cost for r in rows} == {cheapest(roles)}
        text = "".join(r.rendered for r in rows)
        said = re.findall(r"<\|(system|user|assistant)\|>\n", text)
        assert re.fullmatch(r"s?(ua)*u?", "".join(r[0] for r in said)) and text.count("<|end|>\n") == len(said)
    assert [r.rendered for r in found if r.conv_id is None] == ["<|user|>\n<|end|>\n"]
    assert "".join(r.rendered for r in sorted((r for r in found if r.conv_id == 99), key=lambda r: r.position)) == "<|user|>\nsame\nsame<|end|>\n"
    assert chat.repair_roles(frame.limit(0)).count() == 0


def test_chat_with_crowded_segments_and_long_conversations(spark):
    draw = random.Random(9)
    roles = ["system", "user", "assistant", "tool", None]
    turns = [(2**53 + 1, t, draw.choice(roles), f"t{t}") for t in range(700)]
    turns += [(None, draw.choice([None, 7, 2**53 + 1]), draw.choice(roles), draw.choice(["", None, "x" * 3000, "same"])) for _ in range(500)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    whole, cut_up = chat.repair_roles(frame, 10**6, 10**6).collect(), chat.repair_roles(frame, 64, 20, 7).collect()
    text = lambda rows, conv: "".join(r.rendered for r in sorted((r for r in rows if r.conv_id == conv), key=lambda r: (r.segment, r.position)))
    for conv in (2**53 + 1, None):
        assert text(whole, conv) == text(cut_up, conv) and text(whole, conv)
        assert len({r.cost for r in [*whole, *cut_up] if r.conv_id == conv}) == 1
    assert {r.turn for r in cut_up if r.conv_id is None} == {None, 7, 2**53 + 1}


def near_texts():
    draw = random.Random(4)
    words = [f"W{k}" for k in range(300)]
    texts = [None, "", "   ", "one two", "One  two", "one two three", "one two three"]
    for _ in range(12):
        base = [draw.choice(words) for _ in range(draw.randint(8, 120))]
        for _ in range(draw.randint(1, 9)):
            copy = list(base)
            for _ in range(draw.randint(0, 5)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(draw.choice([" ", "\n"]).join(copy))
    passage = " ".join(draw.choice(words) for _ in range(70))
    return texts + [passage + " " + " ".join(draw.choice(words) for _ in range(draw.randint(2, 90))) for _ in range(30)]


def brute_components(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("block", "small", "listed", "span"), [(1 << 20, 10**6, 1 << 18, 4096), (300, 10**6, 3, 4096), (300, 0, 1 << 18, 2), (2000, 0, 2, 3)])
def test_jaccard_components_against_brute_force(spark, monkeypatch, block, small, listed, span):
    """With blocks and hot lists that are met only by huge inputs otherwise, and with both ways to send texts."""
    for name, value in (("BLOCK", block), ("SMALL", small), ("LIST", listed), ("SPAN", span), ("PIVOTS", 1 + block // 2000)):
        monkeypatch.setattr(jaccard, name, value)
    texts = near_texts()
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, sid int")
    assert sorted(tuple(r) for r in jaccard.jaccard_components(frame).collect()) == brute_components(texts)


@pytest.mark.parametrize(("paired", "listed"), [(1, 1 << 18), (2, 1 << 18), (2, 3), (8, 1 << 18)])
def test_every_link_is_within_a_family(spark, monkeypatch, paired, listed):
    """Whether the shingles that two sets share stand in short lists, long ones or both, in any order."""
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "LIST", listed)
    texts = near_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = np.random.default_rng(paired).integers(0, 30, jaccard.CELLS).astype(np.uint8)
    edges = jaccard.family_edges(jaccard.prefix_rows(frame, order, 5, 75), 75, bool((jaccard.parts_of(order) > 1).any()))
    family = {r.node: r.component for r in jaccard.connected_components(edges).collect()}
    sid = [jaccard._set_id(s)[0] for s in shingle_sets(texts, 5)]
    links = [(sid[i], sid[root]) for i, n, root in brute_components(texts) if n and sid[i] != sid[root]]
    assert links and all(family[a] == family[b] for a, b in links)


def test_sets_that_meet_by_chance_make_no_family(spark):
    """In a large collection each set shares some shingle with some other, so that such chains would hold all of them."""
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [f"{words(k, 90)} {words(-k, 6)} {words(-k - 1, 6)}" for k in range(1, 61)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = np.zeros(jaccard.CELLS, np.uint8)  # as where every cell of the sketch is full
    assert jaccard.family_edges(jaccard.prefix_rows(frame, order, 5, 75), 75, False).count() == 0


def test_jaccard_edges(spark):
    rows = [(None, "a b c d e f g", 1), (3, "a b c d e f g", 1), (3, "a b c d e f g", 1), (9, None, 1), (None, "q r s t u v", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n int")
    found = sorted((tuple(r) for r in jaccard.jaccard_components(frame).collect()), key=repr)
    assert found == sorted([(None, 3, 3), (3, 3, 3), (3, 3, 3), (9, 0, 9), (None, 2, None)], key=repr)
    assert jaccard.jaccard_components(frame.limit(0)).count() == 0


def test_one_of_each_goes_by_row(spark):
    draw = random.Random(12)
    texts = near_texts()
    rows = [(draw.choice([None, 7, 7, 20 + i, 20 + i]), t, f"s{i}") for i, t in enumerate(texts)]
    rows += [(None, "q r s t u v", "n"), (None, "Q r s t u v", "n"), (None, "clean and alone in its words", "n"), (7, "one of a kind under the id", "n"), rows[40], rows[40]]
    frame = spark.createDataFrame([(*r, 1.5, "k") for r in rows], "doc_id long, text string, source string, _nth double, _key string")
    groups = {}
    for (doc_id, text, _), (i, n, root) in zip(rows, brute_components([t for _, t, _ in rows]), strict=True):
        groups.setdefault(root if n else (doc_id, text), []).append((doc_id is None, doc_id or 0, text))
    want = [(None if no_id else doc_id, text) for no_id, doc_id, text in (min(g, key=lambda x: (x[0], x[1], x[2] or "")) for g in groups.values())]
    found = jaccard.one_of_each(frame)
    assert found.columns == frame.columns
    kept = found.collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(want, key=repr) and {(r._nth, r._key) for r in kept} == {(1.5, "k")}
    assert jaccard.one_of_each(frame.limit(0)).count() == 0


def test_search_sets_long_lists_aside():
    draw = np.random.default_rng(6)
    base = draw.choice(1 << 40, 200, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[draw.random(200) > 0.04], draw.integers(0, 1 << 40, 6).astype(np.uint64)])) for _ in range(60)]
    index = jaccard.Index(sets)
    ids, hits = index.merged([np.array([0, 5, 4100, 9000]), np.array([5, 9000]), np.array([9001])])
    assert ids.tolist() == [0, 5, 4100, 9000, 9001] and hits.tolist() == [1, 2, 1, 2, 1]
    for q in range(0, 60, 7):
        allowed = np.arange(60) != q
        want = [u for u in range(60) if u != q and 100 * (i := len(np.intersect1d(sets[q], sets[u]))) >= 75 * (len(sets[q]) + len(sets[u]) - i)]
        assert sorted(index.search(q, allowed, 75)) == want


def brute_ctw(train, text, depth):
    """log10 probability by the definition: one weighting tree per bit node, recursion over context depths."""
    counts = {}

    def walk(data):
        padded = bytes([ctw.PAD]) * depth + data + bytes([ctw.END])
        for at in range(depth, len(padded)):
            context, node = padded[at - depth : at][::-1], 1
            for k in range(7, -1, -1):
                bit = padded[at] >> k & 1
                yield context, node, bit
                node = node * 2 + bit

    children = {}
    for data in train:
        for context, node, bit in walk(data):
            for d in range(depth + 1):
                counts.setdefault((node, context[:d]), [0, 0])[bit] += 1
                if d:
                    children.setdefault((node, context[: d - 1]), set()).add(context[:d])

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    memo = {}

    def weighted(node, context):
        key = node, context
        if key not in memo:
            own = log_kt(*counts.get(key, (0, 0)))
            below = sum(weighted(node, c) for c in children.get(key, ()))
            memo[key] = (own, below, own if len(context) == depth else math.log(0.5) + np.logaddexp(own, below))
        return memo[key][2]

    total = 0.0
    for context, node, bit in walk(text):
        a, b = counts.get((node, context), (0, 0))
        p = (b + 0.5) / (a + b + 1)
        for d in range(depth - 1, -1, -1):
            weighted(node, context[:d])
            own, below, _ = memo[node, context[:d]]
            a, b = counts.get((node, context[:d]), (0, 0))
            stop = 1 / (1 + math.exp(below - own))
            p = stop * (b + 0.5) / (a + b + 1) + (1 - stop) * p
        total += math.log10(p if bit else 1 - p)
    return total


def test_blocks_of_one_id_are_spread(spark):
    frame = spark.createDataFrame([(i, f"text {k}") for i in (None, 7) for k in range(400)], "doc_id long, text string")
    held = frame.groupBy("doc_id", ctw.block_of(8).alias("block")).count().collect()
    assert len(held) == 16 and max(r["count"] for r in held) < 100


def test_ctw_against_the_definition(spark):
    draw = random.Random(9)
    texts = ["".join(draw.choice(["the ", "an", "é", "Ba ", "\n"]) for _ in range(draw.randint(0, 12))) for _ in range(40)] + [None, ""]
    rows = [(i, t, 0.5) for i, t in enumerate(texts)] + [(7, texts[7], 0.5), (None, "the end", 0.5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double")
    found = ctw.ctw_scores(frame, depth=3, block_bytes=200).collect()
    assert len(found) == len(rows)
    low = lambda t: (t or "").encode().lower()
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1
    train = [low(t) for i, t, _ in rows if not held(i)]
    tokens = [w for t in train for w in [*t.split(), b"\n"]]
    n, v = len(tokens), len(set(tokens))
    for r in found:
        text = low(texts[r.doc_id] if r.doc_id is not None else "the end")
        words = [*text.split(), b"\n"]
        c = [tokens.count(w) for w in words]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(words), sum(x > 0 for x in c), n)
        assert r.base_score == pytest.approx(sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c), rel=1e-9)
        assert r.score == pytest.approx(brute_ctw(train, text, 3), rel=1e-4)
    assert ctw.ctw_scores(frame.limit(0)).count() == 0


def test_shingles_of_odd_texts():
    sets = shingle_sets(["A b c d e", "a B c d E", "a\x1cb c d e f", None, "é é é é é é", "a b"])
    assert [len(s) for s in sets] == [1, 1, 1, 0, 1, 1] and sets[0][0] == sets[1][0]
