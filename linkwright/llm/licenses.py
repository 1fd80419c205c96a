"""Licence scan: a positional index of rare words, template alignment, mandatory phrases.

Spark SQL only; no shuffle but the word statistics.

1. Document frequencies of the licence words over all documents give their IDF.
2. Each template is entered in the index under its `ANCHORS` words of highest IDF, with their positions.
3. A document's words are looked up in the index; a hit at word p for a template's word r proposes the
   alignment p - r.  Alignments of the same template that several words propose are one.
4. An alignment scores the share of the template's words that stand at their relative positions.  It counts
   when the score reaches `ENOUGH` and the template's mandatory phrase stands word for word.

A base phrase is a template whose mandatory phrase is the whole of it, so all its places are found: its
rarest word is always looked up.  Null and empty texts have no words and no licence; repeated rows are
answered one by one; other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import LOWER, NOT_A_WORD, UPPER

ANCHORS = 3
ENOUGH = 0.7


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: str
    base: bool = False


# Fixed values of the contract: base phrases and their labels.
BASE = [
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
]

# Opening words of public licence notices, and what must stand in them.
NOTICES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    Template("gpl-2", "gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3", "gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("lgpl-2.1", "gnu lesser general public license version 2 1", "gnu lesser general public license version 2 1"),
    Template("lgpl-3", "gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    Template("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    Template("agpl-3", "gnu affero general public license version 3", "gnu affero general public license version 3"),
    Template("gfdl", "under the terms of the gnu free documentation license", "gnu free documentation license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
    Template("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies or substantial portions"),
    Template("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "distributed under the license is distributed on an as is basis"),
    Template("bsd-3", "may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    Template("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "including commercial applications and to alter it and redistribute it freely"),
    Template("boost-1", "boost software license version 1 0", "boost software license version 1 0"),
    Template("artistic-2", "the artistic license 2 0", "artistic license 2 0"),
    Template("odbl", "made available under the open database license", "open database license"),
]


def words_of(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of letters, digits and non-ASCII characters."""
    whole = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(whole, NOT_A_WORD), "")


def document_frequencies(worded: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of the vocabulary stands (one row a word)."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = worded.select(F.explode(F.array_intersect("words", known)).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _index(templates: list[Template], frequencies: dict[str, int], documents: int) -> dict[str, list[tuple[int, int]]]:
    """Anchor word -> (template, position): the words of highest IDF at each of their positions."""
    def idf(word: str) -> float:
        return math.log((documents + 1) / (frequencies.get(word, 0) + 1))

    index: dict[str, list[tuple[int, int]]] = {}
    for number, template in enumerate(templates):
        words = template.text.split()
        for word in sorted(set(words), key=lambda w: (-idf(w), w))[:ANCHORS]:
            index.setdefault(word, []).extend((number, at) for at, w in enumerate(words) if w == word)
    return index


def _lists(items: list[list[str]]) -> Column:
    return F.array(*[F.array(*[F.lit(w) for w in words]) for words in items])


def scan(documents: DataFrame, extra: list[Template] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Every input column `c` (or those of `carry`) as `in.c`, with n_words and matches: (template, start, score, base)."""
    templates = BASE + (NOTICES if extra is None else extra)
    texts = [t.text.split() for t in templates]
    required = [t.mandatory.split() for t in templates]
    within = []
    for words, phrase in zip(texts, required):
        places = [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]
        if not places:
            raise ValueError(f"the template does not hold its mandatory phrase: {' '.join(phrase)}")
        within.append(places[0])
    kept = documents.columns if carry is None else carry
    # one computation of the words per document, whatever is asked of them afterwards
    worded = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("in"), F.explode(F.array(words_of(F.col("text")))).alias("words"))
    vocabulary = sorted({w for words in texts for w in words})
    index = _index(templates, document_frequencies(worded, vocabulary), documents.count())

    anchors = F.array(*[F.lit(w) for w in sorted(index)])
    entries = F.create_map(*[
        x for word, places in sorted(index.items())
        for x in (F.lit(word), F.array(*[F.struct(F.lit(t).alias("template"), F.lit(at).alias("at")) for t, at in places]))
    ])
    word = F.col("words")

    def proposals(p: Column) -> Column:
        return F.transform(F.element_at(entries, F.get(word, p)), lambda e: F.struct(e["template"].alias("template"), (p - e["at"]).alias("start")))

    hits = F.filter(F.sequence(F.lit(0), F.size(word) - 1), lambda p: F.get(word, p).isin(sorted(index)))
    found = F.array_distinct(F.flatten(F.transform(hits, proposals)))
    none = F.expr("cast(array() as array<struct<template:int,start:int>>)")
    proposed = worded.select("in", "words", F.explode(F.array(F.when(F.arrays_overlap("words", anchors), found).otherwise(none))).alias("proposed"))

    all_texts, all_required = _lists(texts), _lists(required)
    offsets = F.array(*[F.lit(x) for x in within])
    based = F.array(*[F.lit(t.base) for t in templates])

    def at(place: Column) -> Column:
        return F.when(place >= 0, F.get(word, place))

    def agreeing(words: Column, start: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.coalesce(at(start + i) == F.get(words, i), F.lit(False))))

    def weighed(c: Column) -> Column:
        words, phrase = F.get(all_texts, c["template"]), F.get(all_required, c["template"])
        return F.struct(
            c["template"].alias("template"), c["start"].cast("bigint").alias("start"),
            (agreeing(words, c["start"]) / F.size(words)).alias("score"),
            (agreeing(phrase, c["start"] + F.get(offsets, c["template"])) == F.size(phrase)).alias("required"),
            F.get(based, c["template"]).alias("base"),
        )

    matches = F.filter(F.transform("proposed", weighed), lambda m: m["required"] & (m["score"] >= ENOUGH))
    matched = proposed.select("in", F.size("words").cast("bigint").alias("n_words"), F.explode(F.array(matches)).alias("matches"))
    labels = F.array(*[F.lit(t.label) for t in templates])
    return matched.select("in", "n_words", F.transform("matches", lambda m: F.struct(F.get(labels, m["template"]).alias("label"), m["start"].alias("start"), m["score"].alias("score"), m["base"].alias("base"))).alias("matches"))


def report(documents: DataFrame) -> DataFrame:
    """One digest row per document."""
    found = scan(documents, carry=["doc_id"]).withColumn("own", F.filter("matches", lambda m: m["base"]))
    starts = F.transform("own", lambda m: m["start"])

    def joined(column: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda m: m["label"]))), ",")

    return found.select(
        F.col("in.doc_id").alias("doc_id"), "n_words", F.size("own").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined("own").alias("base_labels"), joined("matches").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
