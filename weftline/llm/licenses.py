"""License scans by a positional index of rare tokens.

License templates are a fixed list; the words of a template with the highest inverse document frequency in the corpus
are its index (words of its key phrases only where it has few others, so that phrase and index are evidence of their own): postings (word, template, position). A file's words that have postings vote for a template's place,
which is the word's position less the posting's. Where enough of a template's index agrees on one place, a mandatory
key phrase of the template is looked for in the file, and only then the label is given.

All of it is native: document frequencies are one grouped count over the index vocabulary (a few hundred words, its
fixed bound), and a file is scanned inside its own row. Only files that hold some rare word pay for the votes.

Defined results: a null or empty text has no words, labels or places and score 0; repeated rows are scanned alike; an
empty table gives no rows; extra columns are ignored by ``scan``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import let
from .license_texts import TEXTS

#: Everything ASCII that is no digit and no lower-case letter separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Label, characteristic wording, and key phrases of which one must stand in the file.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license", "compliance with the license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution", "cc by"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("proprietary", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form", ["all rights reserved"]),
    ("proprietary", "all rights reserved do not redistribute without permission", ["all rights reserved"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["released into the public domain"]),
]
TEMPLATES += [(label, " ".join(re.findall("[0-9a-z]+", text.lower())), keys) for label, text, keys in TEXTS]


@dataclass(frozen=True)
class Scan:
    rare: int = 8  # index words of each template
    others: int = 4  # words a template has beside its key phrases, from which on these alone make its index
    agree: float = 0.7  # share of the index, by weight, that must agree on a place: of 840 shuffled templates 0.6 takes 8, 0.7 none
    slack: int = 2  # words by which places may differ, at least
    words_a_slack: int = 20  # and one more for so many words of the template: names and years that are filled in move what follows


def normal(text: Column) -> Column:
    """The words joined by single spaces, with one at either end.

    ``lower`` also changes letters beyond ASCII. It makes none of them a separator, so that places and counts are those of lower-casing
    A-Z only (which, letter by letter, costs several times more). Only the Kelvin sign becomes an ASCII letter, k, which no base phrase has.
    """
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, " ")), F.lit(" "))


def vocabulary() -> list[str]:
    return sorted({w for _, t, _ in TEMPLATES for w in t.split()})


def frequencies(docs: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that hold each word of the templates: counts are combined before the shuffle; as many rows come back as the templates have words."""
    rare = re.compile(r"[a-z]{2,}")
    known = [w for w in vocabulary() if rare.fullmatch(w)]
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    # array_intersect drops what occurs twice, so that a document counts once for each word; an empty string counts the documents.
    held = F.array_intersect(F.split(body, SEPARATORS), F.array(*map(F.lit, known)))
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("w")).groupBy("w").count().collect()
    found = {r["w"]: r["count"] for r in rows}
    return found.pop("", 0), found


@dataclass(frozen=True)
class Index:
    postings: dict[str, tuple[tuple[int, int], ...]]  # word: (template, position)
    weights: tuple[dict[str, float], ...]  # by template


def build_index(n_docs: int, held: dict[str, int], scan: Scan = Scan()) -> Index:
    """The highest-IDF words of every template, beside its key phrases; of equal ones the longer, then the first by name."""
    idf = lambda w: math.log((n_docs + 1) / (held.get(w, 0) + 1)) + 1
    postings: dict[str, list[tuple[int, int]]] = {}
    weights = []
    for t, (_, text, keys) in enumerate(TEMPLATES):
        words = text.split()
        known = {w for w in words if len(w) > 1}
        others = known - {w for key in keys for w in key.split()}
        usable = sorted(others if len(others) >= scan.others else known, key=lambda w: (-idf(w), -len(w), w))[: scan.rare]
        weights.append({w: idf(w) for w in usable})
        for i, w in enumerate(words):
            if w in usable:
                postings.setdefault(w, []).append((t, i))
    return Index({w: tuple(p) for w, p in postings.items()}, tuple(weights))


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after the other."""
    first, *rest = phrase.split()

    def whole(w: Column) -> Column:
        starts = F.filter(F.transform(w, lambda x, i: F.when(x == first, i)), lambda i: i.isNotNull())

        def follows(i: Column) -> Column:
            out = F.lit(True)
            for k, other in enumerate(rest, 1):
                out = out & F.coalesce(F.get(w, i + k) == other, F.lit(False))
            return out

        return F.filter(starts, follows)

    return let(words, whole)


def _agreements(hits: Column, held: Column, index: Index, scan: Scan) -> Column:
    """For each template of ``held`` that has votes: (t, best), the largest share, by weight, of its index that agrees on a place.
    hits: (w, i) of the file's index words.

    Votes are sorted by template and place and gone through once: the last place of each index word is kept, and at each vote those
    count that lie near enough before it. A word counts once at a place, however often it stands near it.
    """

    def posting(w: str, t: int, p: int) -> Column:
        names, total = list(index.weights[t]), sum(index.weights[t].values())
        slack = max(scan.slack, len(TEMPLATES[t][1].split()) // scan.words_a_slack)
        return F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), F.lit(names.index(w)).alias("k"), F.lit(index.weights[t][w] / total).alias("w"), F.lit(slack).alias("slack"))

    known = F.create_map(*[x for w, posts in index.postings.items() for x in (F.lit(w), F.array(*[posting(w, t, p) for t, p in posts]))])

    def voted(h: Column) -> Column:
        posts = F.filter(F.element_at(known, h["w"]), lambda q: F.array_contains(held, q["t"]))
        return F.transform(posts, lambda q: F.struct(q["t"].alias("t"), (h["i"] - q["p"]).alias("at"), q["k"].alias("k"), q["w"].alias("w"), q["slack"].alias("slack")))

    empty = F.array().cast("array<struct<k:int,at:int,w:double>>")
    none = F.array().cast("array<struct<t:int,best:double>>")
    start = F.struct(F.lit(-1).alias("t"), F.lit(0.0).alias("best"), empty.alias("last"), none.alias("done"))
    closed = lambda a: F.when(a["t"] < 0, a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["t"].alias("t"), a["best"].alias("best")))))

    def step(a: Column, x: Column) -> Column:
        same = a["t"] == x["t"]
        near = F.filter(F.when(same, a["last"]).otherwise(empty), lambda y: (y["k"] != x["k"]) & (y["at"] >= x["at"] - x["slack"]))
        agreed = F.aggregate(near, x["w"], lambda n, y: n + y["w"])
        last = F.concat(near, F.array(F.struct(x["k"].alias("k"), x["at"].alias("at"), x["w"].alias("w"))))
        best = F.when(same, F.greatest(a["best"], agreed)).otherwise(agreed)
        return F.struct(x["t"].alias("t"), best.alias("best"), last.alias("last"), F.when(same, a["done"]).otherwise(closed(a)).alias("done"))

    return F.aggregate(F.array_sort(F.flatten(F.transform(hits, voted))), start, step, closed)


def scan(docs: DataFrame, config: Scan = Scan(), text: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    index = build_index(*frequencies(docs, text), config)
    return scan_with(docs, index, config, text)


def scan_with(docs: DataFrame, index: Index, config: Scan = Scan(), text: str = "text") -> DataFrame:
    """As ``scan``, with an index at hand."""
    df = docs.select("doc_id", normal(F.col(text)).alias("_norm"))
    n_words = (F.length("_norm") - F.length(F.replace("_norm", F.lit(" "), F.lit("")))).cast("long") - 1
    df = df.withColumn("n_words", F.when(F.col("_norm") == "  ", F.lit(0)).otherwise(n_words).cast("long"))
    keys = "|".join(sorted({p for _, _, need in TEMPLATES for p in need} | set(PHRASES), key=lambda x: (-len(x), x)))
    # Without a key phrase or base phrase no label can follow, so only files with one are split into words.
    df = df.withColumn("_words", F.when(F.col("_norm").rlike(f" (?:{keys}) "), F.split(F.trim("_norm"), " ")))
    bases = [F.when(F.col("_words").isNotNull(), _places(F.col("_words"), p)).alias(f"_b{i}") for i, p in enumerate(PHRASES)]
    hits = F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*sorted(index.postings)))
    phrases = sorted({p for _, _, need in TEMPLATES for p in need})
    having = {p: F.when(F.contains("_norm", F.lit(f" {p} ")), F.array(*[F.lit(t) for t, (_, _, need) in enumerate(TEMPLATES) if p in need])) for p in phrases}
    held = F.flatten(F.array_compact(F.array(*having.values())))
    df = df.select("doc_id", "n_words", F.when(F.col("_words").isNotNull(), held).alias("_held"), F.when(F.col("_words").isNotNull(), hits).alias("_hits"), *bases)
    df = df.withColumn("_found", F.when(F.size("_held") > 0, _agreements(F.col("_hits"), F.col("_held"), index, config)))
    base = F.array_compact(F.array(*[F.when(F.size(f"_b{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]))
    labels = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    method = F.transform(F.filter("_found", lambda x: x["best"] >= config.agree), lambda x: F.get(labels, x["t"]))
    every = F.flatten(F.array(*[F.coalesce(F.col(f"_b{i}"), F.array().cast("array<int>")) for i in range(len(PHRASES))]))
    best = F.array_max(F.transform("_found", lambda x: x["best"]))
    none = F.array().cast("array<string>")
    df = df.select("doc_id", "n_words", every.alias("_at"), base.alias("_base"), F.coalesce(method, none).alias("_method"), F.coalesce(best, F.lit(0.0)).alias("_best"))
    return df.select(
        "doc_id", "n_words", F.size("_at").cast("long").alias("n_base"), F.array_min("_at").cast("long").alias("first_word"), F.array_max("_at").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat("_base", "_method"))), ",").alias("labels"),
        F.least(F.lit(1.0), F.when(F.size("_base") > 0, F.greatest(F.lit(0.5), "_best")).otherwise(F.col("_best"))).alias("score"),
    )
