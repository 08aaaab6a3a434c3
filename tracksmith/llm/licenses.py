"""Licence scans by a positional index of rare licence words, in DataFrame expressions only.

The templates' words are weighed by their document frequency over the whole corpus. A template
is indexed by the position of its rarest words. Each file looks up its own rare licence words,
every occurrence names the places where a template could start, the other rare words must
stand at their relative positions there, and the template's mandatory key phrase is verified
word for word. The share of a template's words found in place is the score.

Scanning is one projection of a file's row: nothing is shuffled, so neither a hot source nor a
very long file costs more than its own text. Base phrases are templates whose key phrase is
all of them, so no place of theirs is lost.

Defined cases: null and empty texts have no words and no labels; repeated rows give equal
rows; a place counts once however many rare words name it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """``key`` is the mandatory phrase within ``text``; ``base`` phrases are all key."""

    label: str
    text: str
    key: str = ""
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return (self.key or self.text).split()

    @property
    def key_at(self) -> int:
        k = self.key_words
        return next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k)


#: The phrases and labels of the base.
BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)

#: Opening sentences of public licences and common notices, in words of the scan.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published by"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("cc0-1.0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
)
TEMPLATES = BASE + NOTICES
#: Rare words by which a template is indexed, and the share of words in place that a notice needs.
RARE, COVER = 3, 0.6


def words_column(text: str = "text") -> Column:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, NOT_WORD), lambda w: w != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row."""
    return F.transform(F.array(value), body).getItem(0)


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many documents each template word occurs; the vocabulary bounds what reaches the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = F.array_intersect(words_column(), F.array(*[F.lit(w) for w in vocabulary]))
    rows = docs.select(F.explode(found).alias("w")).groupBy("w").count().collect()
    return {w: 0 for w in vocabulary} | {r["w"]: r["count"] for r in rows}


def rare_words(template: Template, idf: dict[str, float]) -> list[tuple[str, int]]:
    """Its rarest words within the key phrase with their positions, rarest first."""
    places = range(template.key_at, template.key_at + len(template.key_words))
    first = {}
    for q in places:
        first.setdefault(template.words[q], q)
    return sorted(first.items(), key=lambda x: (-idf[x[0]], x[1]))[: 1 if template.base else RARE]


def scan(docs: DataFrame, idf: dict[str, float], templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: doc_id and what its whole text holds."""
    anchors = [rare_words(t, idf) for t in templates]
    postings: dict[str, list[int]] = {}  # word -> template * 1000 + position of its rarest words
    for k, a in enumerate(anchors):
        for word, q in a:
            postings.setdefault(word, []).append(1000 * k + q)
    rare = sorted(postings)
    index = F.create_map(*[x for w in rare for x in (F.lit(w), F.array(*[F.lit(p) for p in postings[w]]))])
    table = F.array(
        *[
            F.struct(
                F.lit(t.label).alias("label"),
                F.lit(t.base).alias("base"),
                F.array(*[F.lit(w) for w in t.words]).alias("words"),
                F.lit(t.key_at).alias("key_at"),
                F.array(*[F.lit(w) for w in t.key_words]).alias("key"),
                F.array(*[F.struct(F.lit(w).alias("w"), F.lit(q).alias("q")) for w, q in a]).alias("rare"),
            )
            for t, a in zip(templates, anchors, strict=True)
        ]
    )
    span, shift = 1 << 40, 1_000  # a template may start up to ``shift`` words before the file

    def places(words: Column) -> Column:
        """template * 2^40 + shift + start of every place that a rare word names and the key phrase fits."""
        hits = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(rare), i)))
        named = F.flatten(F.transform(hits, lambda i: F.transform(F.element_at(index, words[i]), lambda p: F.struct(F.floor(p / 1000).cast("long").alias("t"), (i - p % 1000).cast("long").alias("a")))))
        fits = F.filter(named, lambda c: bound(
            F.struct((c["a"] + table[c["t"].cast("int")]["key_at"]).alias("at"), F.size(table[c["t"].cast("int")]["key"]).alias("n")),
            lambda k: (k["at"] >= 0) & (k["at"] + k["n"] <= F.size(words)),
        ))
        return F.array_distinct(F.transform(fits, lambda c: c["t"] * span + shift + c["a"]))

    def verified(words: Column) -> Column:
        def look(code: Column) -> Column:
            t, a = F.floor(code / span).cast("int"), (code % span - shift).cast("int")
            return bound(
                F.struct(table[t].alias("t"), a.alias("a")),
                lambda c: F.when(
                    F.forall(c["t"]["rare"], lambda r: words[c["a"] + r["q"]] == r["w"])
                    & (F.slice(words, c["a"] + c["t"]["key_at"] + 1, F.size(c["t"]["key"])) == c["t"]["key"]),
                    F.struct(
                        c["t"]["label"].alias("label"),
                        c["t"]["base"].alias("base"),
                        c["a"].cast("long").alias("a"),
                        (F.size(F.filter(F.transform(c["t"]["words"], lambda w, i: F.get(words, c["a"] + i) == w), lambda same: same)) / F.size(c["t"]["words"])).alias("cover"),
                    ),
                ),
            )

        return F.filter(F.transform(places(words), look), lambda f: f.isNotNull() & (f["base"] | (f["cover"] >= COVER)))

    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        bound(words_column(), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), verified(w).alias("found"))).alias("r"),
    )
    base = F.filter("r.found", lambda f: f["base"])
    names = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda f: f["label"]))), ",")
    return found.select(
        "doc_id",
        F.col("r.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda f: f["a"])).alias("first_word"),
        F.array_max(F.transform(base, lambda f: f["a"])).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("r.found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("r.found", lambda f: f["cover"])), F.lit(0.0)).alias("score"),
    )


def inverse_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    n = docs.count()
    return {w: math.log((n + 1) / (df + 1)) for w, df in document_frequencies(docs, templates).items()}


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, inverse_frequencies(docs))
