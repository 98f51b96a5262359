"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are values of any length after a secret-like name and a separator, quoted values without white space, and
long runs of token characters, in this order where they begin at one place. The forest judges each by its length, character transitions, dictionary coverage, the path it stands in and the words beside it. It is
trained (in the JVM) from labelled findings, then its trees are written out as one SQL expression, so scanning is
one pass over the table inside the row: no shuffle, no Python, no model to ship.

Training reads at most `max_rows` labelled rows, a documented bound; the rows with the smallest hashes are taken.
Without labelled findings of one's own, `sample_findings` makes a labelled set from rules: digests, random
strings, passwords and known key formats as secrets; words, code, placeholders, numbers, digests of files and commits as others.
The dictionary is the whole words of a public tokenizer's vocabulary (its path is a parameter); the words' own pairs of
neighbouring letters give the scale of the character transitions.

Edge cases: null texts have no findings and stay null; a null path counts as ''; overlapping candidates do not
occur (matches follow one another); repeated rows are scanned each; texts are scanned whole; an empty table gives
an empty result. Columns of other names pass through; `findings` and `redacted` are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, let, table

#: Names of secrets.
NAME = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer)"
TOKEN = "[A-Za-z0-9+/_=.~-]"
#: A word that holds such a name, and a separator, with quotes around the word and before the value as they come. The
#: separator is looked for first, and a word is gone through twice at most.
WORD = r"[\w.-]"
QUOTE = "[\"'`]"
NAMED = (
    rf"(?={WORD}++{QUOTE}?[ \t]*+[:=])(?i:(?={WORD}*?{NAME}){WORD}++{QUOTE}?[ \t]*+(?:=>|:=|[:=])[ \t]*+"
    rf"(?:(?:bearer|basic)[ \t]++)?+){QUOTE}?+"
)
#: What follows: up to the closing quote, or without what ends a clause or closes a bracket.
VALUE = r"(?:(?<=[\"'`])[^\s\"'`]++(?=[\"'`])|(?<![\"'`])[^\s\"'`]*[^\s\"'`,;.:)\]}>])"
#: A named value with its name, anything of 8 and more in quotes, or a run of token characters. Looks back by one
#: character at most: a longer look at every place would cost more than all the rest.
CANDIDATE = rf"(?<!{WORD}){NAMED}{VALUE}|(?<=[\"'])[^\s\"']{{8,}}+(?=[\"'])|(?<!{TOKEN}){TOKEN}{{16,}}+"
#: Characters looked at on either side.
NEAR = 48
FEATURES = (
    "length", "digits", "lowers", "uppers", "specials", "switches", "distinct", "hexes", "vowels", "transitions",
    "uncovered", "path_test", "name_near", "quoted", "assigned", "placeholder", "neutral_near",
)
#: Words of the dictionary (the most frequent ones), and their least length.
WORDS, SHORTEST = 4000, 4
#: What stands where no secret does, and words that speak of digests and ids.
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|your[_-]|placeholder|redacted|xxxx|\*\*\*\*|<[a-z_]+>|\$\{|test|todo|(.)\1{5}"
NEUTRAL = r"(?i)commit|sha-?\d*|md5|digest|checksum|revision|build|uuid|guid|etag|hash|https?://|version"
#: Rows that training may read.
MAX_TRAINING_ROWS = 20_000


def vocabulary_words(path: str, words: int = WORDS) -> tuple[str, ...]:
    """The most frequent whole words of a rank file (lower case, SHORTEST letters at least)."""
    with open(path, "rb") as file:
        ranks = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, file)]
    found = [m[1].decode() for _, token in sorted(ranks) if (m := re.fullmatch(rb" ([a-z]{%d,})" % SHORTEST, token))]
    return tuple(found[:words])


@lru_cache(maxsize=1)
def default_words() -> tuple[str, ...]:
    import public_tokenizers

    return vocabulary_words(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def any_of(words: tuple[str, ...]) -> str:
    """A pattern that finds the longest of the words at a place, a letter at a time."""
    tree: dict = {}
    for word in words:
        at = tree
        for letter in word:
            at = at.setdefault(letter, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        rest = [letter + pattern(under) for letter, under in sorted(at.items()) if letter]
        inside = rest[0] if len(rest) == 1 else "|".join(rest)
        return ("" if not rest else f"(?:{inside})?+" if "" in at else inside if len(rest) == 1 else f"(?:{inside})")

    return pattern(tree)


def pair_digits(words: tuple[str, ...]) -> str:
    """For every pair of letters a digit: 9 for the most frequent pairs in the words, 0 for pairs that do not occur."""
    held = Counter(a + b for word in words for a, b in zip(word, word[1:], strict=False))
    most = math.log1p(max(held.values(), default=1))
    return "".join(str(int(9 * math.log1p(held[a + b]) / most)) for a in LOWER for b in LOWER)


def features(value: Column, before: Column, after: Column, path: Column, words: tuple[str, ...] | None = None) -> Column:
    """The forest's inputs for one candidate as array<double>, in the order of FEATURES."""
    words = default_words() if words is None else words
    n = F.length(value).cast("double")
    count = lambda pattern, of=value: F.regexp_count(of, F.lit(pattern)).cast("double")
    letters = count(r"[A-Za-z]")
    distinct = F.size(F.array_distinct(F.split(value, ""))).cast("double")
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("double")
    digits = F.lit(pair_digits(words))

    def pair(a: Column, b: Column) -> Column:
        """How usual it is that letter b follows letter a, 0 to 9; null where one of them is no letter."""
        i, j = F.instr(F.lit(LOWER), a), F.instr(F.lit(LOWER), b)
        return F.when((i > 0) & (j > 0) & (a != "") & (b != ""), F.substring(digits, (i - 1) * 26 + j, F.lit(1)).cast("double"))

    def transitions(signs: Column) -> Column:
        pairs = F.array_compact(F.transform(signs, lambda a, k: pair(a, F.get(signs, k + 1))))
        return let(pairs, lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda t, v: t + v) / F.size(x)).otherwise(F.lit(9.0)))

    return F.array(
        n,
        count(r"[0-9]") / n,
        count(r"[a-z]") / n,
        count(r"[A-Z]") / n,
        count(r"[^A-Za-z0-9]") / n,
        count(r"(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[0-9]|(?<=[A-Z])[A-Z][a-z]") / n,
        distinct / n,
        count(r"[0-9a-fA-F]") / n,
        F.when(letters > 0, count(r"[aeiouAEIOU]") / letters).otherwise(F.lit(0.0)),
        let(F.split(F.lower(value), ""), transitions),
        F.when(letters > 0, F.length(F.regexp_replace(F.lower(value), f"{any_of(words)}|[^a-z]", "")) / letters).otherwise(F.lit(1.0)),
        flag(path.rlike(r"(?i)test|example|sample|fixture|mock|doc")),
        flag(before.rlike(rf"(?i){NAME}[\w.-]*[\"']?\W{{0,4}}$")),
        flag(before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")),
        flag(before.rlike(r"[:=]\s*[\"'`]?$")),
        flag(value.rlike(PLACEHOLDER)),
        flag(before.rlike(rf"({NEUTRAL})\W{{0,4}}$")),
    )


def candidates(text: Column, path: Column, judge) -> Column:
    """array of struct(start, length, value, score) for every candidate of a text, score = judge(features)."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    between = F.split(text, CANDIDATE)
    name_of = lambda m: F.regexp_extract(m, f"^({NAMED})[^\\s\"'`]", 1)

    def place(matches: Column, gaps: Column) -> Column:
        # starts[k]: all gaps up to k and all matches before it
        lengths = F.transform(matches, lambda m, k: F.struct(F.length(F.get(gaps, k)).alias("g"), F.length(m).alias("v")))
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(
            lengths,
            empty,
            lambda acc, x: F.struct(
                (acc["at"] + x["g"] + x["v"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + x["g"])).alias("starts")
            ),
            lambda acc: acc["starts"],
        )

        def finding(at: Column) -> Column:
            def one(m: Column, k: Column) -> Column:
                return let(name_of(m), lambda name: let(F.substring(m, F.length(name) + 1, F.length(m)), lambda v: judged(v, name, k)))

            def judged(v: Column, name: Column, k: Column) -> Column:
                gap = F.get(gaps, k)
                before = F.concat(F.when(F.length(gap) < NEAR, F.coalesce(F.get(matches, k - 1), F.lit(""))).otherwise(F.lit("")), gap, name)
                after = F.substring(F.get(gaps, k + 1), 1, NEAR)
                score = let(features(v, F.substring(before, -NEAR, NEAR), after, path), judge)
                start = (F.get(at, k) + F.length(name)).cast("long")
                return F.struct(start.alias("start"), F.length(v).cast("long").alias("length"), v.alias("value"), score.alias("score"))

            return F.transform(matches, one)

        return let(starts, finding)

    none = F.array().cast("array<struct<start:bigint,length:bigint,value:string,score:double>>")
    placed = let(found, lambda matches: let(between, lambda gaps: place(matches, gaps)))
    return F.when(text.rlike(CANDIDATE), placed).otherwise(none)


def sample_findings(spark: SparkSession, rows: int = 4096, seed: int = 17, words: tuple[str, ...] | None = None) -> DataFrame:
    """`rows` labelled findings (value, before, after, path, label) made from rules, the same on every call."""
    words = default_words() if words is None else words
    draw = random.Random(seed)
    pick, upto = draw.choice, draw.randint
    follow: dict[str, list[str]] = {}
    for word in words:
        for a, b in zip(word, word[1:], strict=False):
            follow.setdefault(a, []).append(b)

    def invented(n: int) -> str:
        """What looks like a word: letters that follow one another as in the dictionary."""
        out = pick(words)[:2]
        while len(out) < n:
            out += pick(follow.get(out[-1]) or ["e"])
        return out

    def digest(n: int) -> str:
        return hashlib.sha512(draw.randbytes(16)).hexdigest()[:n]

    def random64(n: int) -> str:
        return base64.b64encode(draw.randbytes(n)).decode()[:n]

    def random62(n: int) -> str:
        return re.sub("[^A-Za-z0-9]", "x", random64(n))

    names = ["token", "api_key", "secret", "password", "access_key", "auth_token", "private-key", "passwd", "pwd"]
    symbol = lambda: pick("!&#$%@?^")
    secrets: list[Callable[[], str]] = [
        lambda: digest(pick([32, 40, 64])),
        lambda: random64(upto(16, 44)),
        lambda: "AKIA" + random62(16).upper(),
        lambda: pick(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + random62(upto(20, 36)),
    ]
    passwords: list[Callable[[], str]] = [
        lambda: random64(upto(8, 15)),
        lambda: random64(upto(4, 8)) + symbol() + random64(3) + pick(["!", "$", ""]),
        lambda: pick(words)[:6] + str(upto(0, 99)) + invented(4),
        lambda: pick(words)[:5].title() + str(upto(0, 999)) + symbol(),
    ]
    others: list[Callable[[], str]] = [
        lambda: invented(upto(8, 30)),
        lambda: pick("_-./") .join(pick(words) for _ in range(upto(2, 5))),
        lambda: "".join(pick(words).title() for _ in range(upto(2, 4))),
        lambda: invented(upto(8, 20)).upper(),
        lambda: str(upto(10**8, 10 ** upto(15, 20))),
        lambda: f"https://www.{pick(words)}.example.com/{pick(words)}/{upto(1, 999)}",
        lambda: f"your_{pick(names)}_goes_here",
        lambda: "x" * upto(8, 14) + digest(upto(0, 8)),
    ]
    plain_values: list[Callable[[], str]] = [
        lambda: invented(upto(2, 12)),
        lambda: invented(upto(2, 12)).title(),
        lambda: pick(words) + "_" + pick(words),
        lambda: pick(["None", "null", "true", "false", "required", "optional", "str", "getpass.getpass(", "os.environ", "config.get(", "self.value", "${VALUE}"]),
        lambda: str(upto(0, 5000)),
        lambda: f"https://{pick(words)}.com/{pick(words)}",
    ]
    prose = ["of the ", "and ", "see ", "\n", ". ", "(", "to ", " "]
    lead = lambda: pick(["", "the ", "export ", "\n", "with ", invented(6) + " "])

    def quoted_name() -> tuple[str, str]:
        assign = pick([' = "', ': "', '="', " = '", ": '"])
        return lead() + pick(names) + assign, assign[-1]

    def bare_name() -> str:
        return lead() + pick(names) + pick([": ", "=", " = ", ":", " := "])

    end = lambda: pick([" ", ".", ",", "\n", ""])

    def one(label: int) -> tuple[str, str, str]:
        short = draw.random() < 0.25
        if label and short:
            return pick(passwords)(), bare_name(), end()
        if label:
            kind = upto(0, 3)
            if kind >= 2 and draw.random() < 0.5:  # known formats need no name
                return secrets[kind](), pick(prose), end()
            return (secrets[kind](), *quoted_name())
        if short:
            return pick(plain_values)(), bare_name(), end()
        if draw.random() < 0.15:
            return digest(pick([32, 40, 64])), pick(["commit ", "sha1: ", "checksum=", "etag: ", "revision ", "md5 "]), end()
        if draw.random() < 0.2:
            return (pick(others)(), *quoted_name())
        if draw.random() < 0.2:
            return pick(others)(), pick(prose) + '"', '"'
        return pick(others)(), pick(prose), end()

    paths = ["web", "forum/archive", "app/config.py", "tests/test_login.py", "docs/example.md", ""]
    made = [(*one(k % 2), pick(paths), k % 2) for k in range(rows)]
    return spark.createDataFrame(made, "value string, before string, after string, path string, label int")


def train(findings: DataFrame, trees: int = 16, depth: int = 6, max_rows: int = MAX_TRAINING_ROWS) -> list:
    """Fit the forest and return its trees as nested tuples (feature, threshold, left, right) or leaf probabilities."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    path = F.coalesce(F.col("path"), F.lit(""))
    shaped = findings.where("value is not null and value <> '' and label is not null").orderBy(F.xxhash64("value", "before")).limit(max_rows)
    # Inside `let` the features are evaluated by expression, as in a scan; generated code of their size would not compile.
    given = F.struct(F.col("value").alias("v"), F.coalesce("before", F.lit("")).alias("b"), F.coalesce("after", F.lit("")).alias("a"), path.alias("p"))
    x = let(given, lambda g: features(g["v"], g["b"], g["a"], g["p"]))
    shaped = shaped.select(array_to_vector(x).alias("x"), F.col("label").cast("double").alias("label"))
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=17).fit(shaped)

    def nested(node) -> object:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return stats[1] / sum(stats) if sum(stats) else 0.0
        split = node.split()
        return split.featureIndex(), split.threshold(), nested(node.leftChild()), nested(node.rightChild())

    return [nested(tree._call_java("rootNode")) for tree in model.trees]


def forest(trees: list):
    """The trees as a function of the feature array: their mean vote, in plain CASE expressions."""

    def walk(tree, x: Column) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        feature, threshold, left, right = tree
        return F.when(F.get(x, F.lit(feature)) <= threshold, walk(left, x)).otherwise(walk(right, x))

    return lambda x: reduce(lambda a, b: a + b, [walk(t, x) for t in trees]) / len(trees)


_fitted: dict[str, list] = {}


def default_trees(spark: SparkSession) -> list:
    """The forest of `sample_findings`; fitted once a session."""
    of = spark.sparkContext.applicationId
    if of not in _fitted:
        _fitted[of] = train(sample_findings(spark))
    return _fitted[of]


def scan_secrets(rows: DataFrame, text: str = "text", path: str = "source", threshold: float = 0.5, trees: list | None = None) -> DataFrame:
    """Add `findings` (start, length, value, score of each secret, in code points) and `redacted` to `rows`."""
    judge = forest(default_trees(rows.sparkSession) if trees is None else trees)
    value, place = F.col(text), F.coalesce(F.col(path).cast("string"), F.lit(""))
    every = candidates(F.coalesce(value, F.lit("")), place, judge)
    scanned = rows.withColumn("findings", F.filter(every, lambda f: f["score"] >= threshold))

    def redact(found: Column) -> Column:
        ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(found, lambda f: f["start"] + f["length"]))
        parts = F.transform(ends, lambda end, k: F.substring(value, (end + 1).cast("int"), F.coalesce(F.get(found, k)["start"] - end, F.length(value).cast("long")).cast("int")))
        return F.array_join(parts, "[SECRET]")

    return scanned.withColumn("redacted", F.when(F.size("findings") == 0, value).otherwise(redact(F.col("findings"))))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its findings and a checksum of the redacted text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    scanned = scan_secrets(docs)
    return scanned.select("doc_id", F.size("findings").alias("n_findings"), "findings", F.md5("redacted").alias("redacted_md5"))
