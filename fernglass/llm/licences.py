"""Licence scan with a positional index over the rare words of licence templates.

Every word of a template is a posting (template, position) with the word's inverse document frequency (IDF) among the
templates. A template is found where at least `AGREE` of its words stand at their places; so of n words it may miss
e, and those that the file does not hold at all are missed at every place. Of the template's words that the file does
hold, those of the highest IDF are looked up, as many as may still be missed and two more: at a place of the template
at least two of them agree. Their places are moved back by their positions in the template and intersected: only
offsets on which two words meet remain. There the template is laid over the file word by word, and its mandatory
phrase has to stand. So no place is lost, and a file's frequent words are looked up only where rarer ones do not do.
The index is fixed and small, so all of this happens inside the row, with built-in functions: one scan, no shuffle,
no Python.

Base: places where a phrase's words stand consecutively (mit license, apache license, general public license).

Edge cases: a null text counts as empty: no words, no labels, score 0; positions are null where no base phrase
stands; labels are '' where none is found; texts of any length are scanned whole; repeated rows and equal
places are all counted; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, free_name, let, table

#: Base phrases and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
#: Characteristic sentences of licences (lower case, words only) and the phrases that must be in place.
TEMPLATES: list[tuple[str, str, str]] = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial", "creative commons attribution noncommercial"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "in compliance with the license"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote products"),
    ("bsl", "boost software license version 1 0", "boost software license"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "copyright and related and neighboring rights"),
    ("epl", "the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "without warranty of any kind express or implied"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "will the authors be held liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
]
#: Share of a template's words that must agree at a place.
AGREE = 0.7
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lowered.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What stands between words, before A-Z are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words_by_idf() -> list[list[tuple[str, int]]]:
    """For each template its words and their positions, the highest IDF first."""
    bodies = [body.split() for _, body, _ in TEMPLATES]
    held = Counter(w for body in bodies for w in set(body))
    idf = {w: math.log(len(bodies) / n) for w, n in held.items()}
    return [sorted(zip(body, range(len(body)), strict=True), key=lambda posting: (-idf[posting[0]], posting[1])) for body in bodies]


def least_agreeing(n: int) -> int:
    """How many of a template's n words have to agree at a place."""
    return next(k for k in range(n + 1) if k / n >= AGREE)


def index() -> Column:
    """The templates as one constant: name, body, mandatory phrase with its place, words by IDF, least number in agreement."""
    out = []
    for (name, body, must), postings in zip(TEMPLATES, words_by_idf(), strict=True):
        body, must = body.split(), must.split()
        at = next(p for p in range(len(body)) if body[p : p + len(must)] == must)
        words = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(p).alias("p")) for w, p in postings])
        fields = {"name": F.lit(name), "body": _strings(body), "must": _strings(must), "at": F.lit(at), "words": words, "least": F.lit(least_agreeing(len(body)))}
        out.append(F.struct(*[value.alias(field) for field, value in fields.items()]))
    return F.array(*out)


def gate_pattern() -> str:
    """Found in every text with a label or a place: those need a base phrase or a mandatory one, word after word.

    A phrase that holds another one of these asks for no more than that one does, so it is left out."""
    phrases = sorted({*PHRASES, *(tuple(must.split()) for _, _, must in TEMPLATES)}, key=lambda p: (len(p), p))
    within = lambda a, b: any(b[k : k + len(a)] == a for k in range(len(b) - len(a) + 1))
    least = [b for n, b in enumerate(phrases) if not any(within(a, b) for a in phrases[:n])]
    return "(?i)" + "|".join(f"{BETWEEN}+".join(phrase) for phrase in least)


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def phrase_places(words: Column, phrase: tuple[str, ...]) -> Column:
    """Positions (from 0) at which the phrase starts."""
    rest = lambda i: _all([F.get(words, i + k) == w for k, w in enumerate(phrase)])
    hits = F.transform(words, lambda w, i: F.when(w == phrase[0], i))
    return F.filter(hits, lambda i: i.isNotNull() & F.coalesce(rest(i), F.lit(False)))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def looked_up(template: Column, present: Column) -> Column:
    """The template's words to look up in a file that holds the words `present`: none if too many are missing, else
    those of the highest IDF, two more than may be missed among them."""

    def highest(have: Column) -> Column:
        return F.slice(have, F.lit(1), F.when(F.size(have) >= template["least"], F.size(have) - template["least"] + 2).otherwise(0))

    return let(F.filter(template["words"], lambda a: F.array_contains(present, a["w"])), highest)


def template_score(words: Column, held: Column, template: Column, chosen: Column) -> Column:
    """Best share of the template's words in agreement where two of the `chosen` ones meet; 0 below AGREE.

    `held` are struct(w, i) of the file's words that are looked up, so postings never walk the whole file."""

    def share(offset: Column) -> Column:
        start = offset + template["at"]
        mandatory = F.when(start >= 0, F.slice(words, start + 1, F.size(template["must"])) == template["must"]).otherwise(False)
        same = F.size(F.filter(template["body"], lambda w, p: F.coalesce(F.get(words, offset + p) == w, F.lit(False))))
        return F.when(mandatory & (same >= template["least"]), same.cast("double") / F.size(template["body"])).otherwise(0.0)

    offsets = F.flatten(F.transform(chosen, lambda a: F.transform(F.filter(held, lambda x: x["w"] == a["w"]), lambda x: x["i"] - a["p"])))
    # A word and its position give an offset once: where one stands twice, two of them meet.
    met = let(F.array_sort(offsets), lambda found: F.filter(found, lambda o, k: F.coalesce(F.get(found, k + 1) == o, F.lit(False))))
    return F.coalesce(F.array_max(F.transform(F.array_distinct(met), share)), F.lit(0.0))


def licence_scan(rows: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels and score to `rows`."""
    value = F.coalesce(F.col(text), F.lit(""))
    templates = index()
    vocabulary = _strings(sorted({w for _, body, _ in TEMPLATES for w in body.split()}))
    names = [name for name, _, _ in TEMPLATES]
    empty = F.array().cast("array<string>")
    nothing = F.struct(F.array().cast("array<int>").alias("places"), empty.alias("base"), empty.alias("found"), F.lit(0.0).alias("score"))

    def scan(words: Column) -> Column:
        chosen = let(F.array_intersect(vocabulary, words), lambda present: F.transform(templates, lambda t: looked_up(t, present)))

        def lookup(chosen: Column) -> Column:
            wanted = F.array_distinct(F.transform(F.flatten(chosen), lambda a: a["w"]))
            return let(wanted, lambda w: let(places_of(w), lambda held: verdict(chosen, held)))

        def places_of(wanted: Column) -> Column:
            return F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(wanted, x["w"]))

        def verdict(chosen: Column, held: Column) -> Column:
            scores = F.zip_with(templates, chosen, lambda t, c: template_score(words, held, t, c))
            places = [phrase_places(words, phrase) for phrase in PHRASES]
            base = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(places, PHRASES.values(), strict=True)]))

            def combine(s: Column) -> Column:
                found = F.filter(F.transform(_strings(names), lambda n, i: F.when(F.get(s, i) > 0, n)), lambda n: n.isNotNull())
                return F.struct(
                    F.flatten(F.array(*places)).alias("places"),
                    base.alias("base"),
                    found.alias("found"),
                    F.greatest(F.array_max(s), F.when(F.size(base) > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
                )

            return let(scores, combine)

        return let(chosen, lookup)

    words = F.regexp_extract_all(F.translate(value, UPPER, LOWER), F.lit(WORD), F.lit(0))
    gate = value.rlike(gate_pattern())
    held = free_name(rows, "_l")
    of = lambda name: F.col(f"`{held}`")[name]
    found = rows.withColumns(
        {
            "n_words": F.regexp_count(value, F.lit(ANY_CASE_WORD)).cast("long"),
            held: F.when(gate, let(words, scan)).otherwise(nothing),
        }
    )
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.withColumns(
        {
            "n_base": F.size(of("places")).cast("long"),
            "first_word": F.array_min(of("places")).cast("long"),
            "last_word": F.array_max(of("places")).cast("long"),
            "base_labels": labels(of("base")),
            "labels": labels(F.concat(of("base"), of("found"))),
            "score": of("score"),
        }
    ).drop(held)


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licence_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
