"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much goes too.

Everything is computed inside the row with built-in functions, so the plan is one scan without a shuffle and
without Python, however skewed the sources are.

Rules of a line (any one fails it; empty lines never fail, they are layout):
  navigation   at least `pipes` separators `|`, or a short line made of menu words only
  punctuation  symbols `#*$%&<>` or doubled `!`/`?` after at least a `symbol_share` of the words, or a line of
               `long_line` words and more without a single sentence mark
  boilerplate  cookie, script and copyright notices, and a word that stands nine times or more in a row
Verdict: rejected if the base rules fail or if more than `lost_share` percent of the word characters went.

Edge cases: a null text counts as the empty text, which has no words, so the base rules reject it; very long
texts are treated whole; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, free_name, let, table

#: Fillers and notices of web pages in English, German, French and Spanish.
MENU = (
    "home|menu|login|log in|sign in|sign up|register|search|contact|about|about us|next|previous|back|share|print|sitemap|top|"
    "startseite|menü|anmelden|registrieren|suche|kontakt|impressum|[Üü]ber uns|weiter|zurück|teilen|drucken|"
    "accueil|connexion|rechercher|recherche|suivant|précédent|retour|partager|imprimer|"
    "inicio|menú|iniciar sesión|buscar|contacto|siguiente|anterior|volver|compartir|imprimir"
)
NOTICES = (
    "all rights reserved|privacy policy|terms of (use|service)|cookie (policy|settings|notice)|accept (all )?cookies|"
    "enable javascript|javascript (is )?(disabled|required)|lorem ipsum|click here|subscribe to our|skip to (main )?content|"
    "alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|tous droits réservés|politique de confidentialité|"
    "mentions légales|todos los derechos reservados|política de privacidad|aviso legal"
)
MENU_LINE = rf"(?i)^[\x20\x09-\x0D]*({MENU})([\x20\x09-\x0D>/·-]+({MENU}))*[\x20\x09-\x0D]*$"
NOTICE_LINE = rf"(?i)({NOTICES})"
SENTENCE_MARK = r"[.!?:;…。！？]"
NOISY_WORD = rf"([#*$%&<>]|!!|\?\?){NOT_SPACE}*({SPACE}|$)"
#: A word of 1 to 64 characters, then the same word eight times more: an 8-word window that repeats.
STUTTER = rf"(^|{SPACE})({NOT_SPACE}{{1,64}}+)({SPACE}+\2){{8}}({SPACE}|$)"
NOTICE_PARTS = (
    "rights reserved", "privacy policy", "terms of", "cookie", "javascript", "lorem ipsum", "click here", "subscribe to", "skip to",
    "rechte vorbehalten", "datenschutz", "nutzungsbedingungen", "droits réservés", "confidentialité", "mentions légales",
    "derechos reservados", "privacidad", "aviso legal",
)
WORD = f"{NOT_SPACE}+"
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in an 8-word window found twice or more in the text.

    Windows are compared by 64-bit hashes of 64-bit word hashes. Texts without a repeat, nearly all, end after
    a set lookup; for the others the windows are sorted once and the covered words counted from the gaps."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(sorted_pairs: Column) -> Column:
            def same(x: Column, k: Column) -> Column:
                return (x["h"] == F.get(sorted_pairs, k - 1)["h"]) | (x["h"] == F.get(sorted_pairs, k + 1)["h"])

            return F.array_sort(F.transform(F.filter(sorted_pairs, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))

        def cover(at: Column) -> Column:
            return F.aggregate(
                F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda total, gap: total + gap,
            )

        return let(pairs, lambda s: let(twice(s), cover))

    def neighbours(hashes: Column, by: int) -> Column:
        """Hashes of (x[i], x[i + by]): spans of twice the words, for every i."""
        return let(hashes, lambda x: F.transform(F.slice(x, F.lit(1), F.size(x) - by), lambda h, i: F.xxhash64(h, F.get(x, i + by))))

    def from_fours(fours: Column) -> Column:
        eights = neighbours(fours, 4)
        repeats = let(eights, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))
        return F.when(F.size(F.array_distinct(fours)) == F.size(fours), F.lit(0).cast("long")).otherwise(repeats)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(neighbours(neighbours(hashed, 1), 2), from_fours))


def line_fails(line: Column, gates: Column, pipes: int, symbol_share: int, long_line: int) -> Column:
    """Whether a rule fails `line`. `gates` says which rules can fire anywhere in the document at all."""
    return (
        (gates["pipe"] & (F.regexp_count(line, F.lit(r"\|")) >= pipes))
        | (gates["symbol"] & let(line, lambda x: F.regexp_count(x, F.lit(NOISY_WORD)) * 100 > F.regexp_count(x, F.lit(WORD)) * symbol_share))
        | (~line.rlike(SENTENCE_MARK) & (F.regexp_count(line, F.lit(WORD)) >= long_line))
        | line.rlike(MENU_LINE)
        | (gates["notice"] & line.rlike(NOTICE_LINE))
        | (gates["repeat"] & line.rlike(STUTTER))
    )


def has_notice(text: Column) -> Column:
    """A cheap test that is true wherever NOTICE_LINE can match."""
    low = F.lower(text)
    return let(low, lambda x: reduce(lambda a, b: a | b, [x.contains(part) for part in NOTICE_PARTS]))


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long")


def quality_rules(
    rows: DataFrame, text: str = "text", pipes: int = 2, symbol_share: int = 20, long_line: int = 30, lost_share: int = 50
) -> DataFrame:
    """Add the base counts, `clean_text`, `lost_chars` and the verdict `kept` to `rows` (same-named columns are replaced)."""
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(value, "\n")

    def clean(repeats: Column) -> Column:
        gates = F.struct(
            value.contains("|").alias("pipe"),
            (value.rlike(r"[#*$%&<>]") | value.contains("!!") | value.contains("??")).alias("symbol"),
            has_notice(value).alias("notice"),
            (repeats > 0).alias("repeat"),
        )
        return let(gates, lambda g: F.array_join(F.filter(lines, lambda x: ~line_fails(x, g, pipes, symbol_share, long_line)), "\n"))

    def judge(words: Column) -> Column:
        n = F.size(words).cast("long").alias("n_words")
        return let(repeated_words(words), lambda r: F.struct(n, r.alias("n_repeat_words"), clean(r).alias("clean")))

    held = free_name(rows, "_q")
    q = lambda name: F.col(f"`{held}`")[name]
    worded = F.filter(lines, lambda x: x.rlike(NOT_SPACE))
    chars = word_chars(value)
    lost = F.when(q("clean") == value, F.lit(0).cast("long")).otherwise(chars - word_chars(q("clean")))
    counted = rows.withColumn(held, let(words_of(value), judge)).withColumns(
        {
            "n_words": q("n_words"),
            "n_repeat_words": q("n_repeat_words"),
            "word_chars": chars,
            "n_symbols": F.regexp_count(value, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "clean_text": q("clean"),
            "lost_chars": lost,
            "base_failed": (q("n_words") < 20) | (q("n_repeat_words") * 100 > q("n_words") * 30),
        }
    )
    verdict = ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * lost_share)
    return counted.withColumn("kept", verdict).drop(held)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"
    )
