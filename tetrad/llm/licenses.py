"""Licence scans with a positional index of rare licence words (native Spark).

The phrases and notices of the table below are indexed by their rarest words:
the document frequencies of all licence words are counted over all documents,
and each template is listed under its key's words of highest IDF (its anchors),
with their places.  A text looks up its own rare licence words in that index:
each place of one gives, for every template listed there, where the template
would begin.  Beginnings that all anchors of a template agree on are verified
word by word: the mandatory key phrase as a whole, and the share of the
template's words that stand where they should.  What a text costs depends on
its rare licence words, not on the number of templates.

Only DataFrame functions are used.  One pass cuts the texts into words; a text
is kept for the look-up only if it holds all words of some key, which loses no
match.  Nothing but one row per licence word reaches the driver.

Defined results: null and empty texts have 0 words, no labels and score 0;
a phrase that overlaps itself or another counts at every place; repeated rows
are scanned alike, one result each; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetrad.llm.shared import texts, written

#: What a word is, once A-Z are lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence's words in order; ``key`` is the phrase that must stand whole."""

    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    base: bool = False


def phrase(label: str, text: str) -> Template:
    words = tuple(text.split())
    return Template(label, words, words, base=True)


def notice(label: str, text: str, key: str) -> Template:
    return Template(label, tuple(text.split()), tuple(key.split()))


# The base phrases of the contract, and sentences of public licences.
BASE = (
    phrase("gpl", "gnu general public license"),
    phrase("apache", "apache license"),
    phrase("cc-by", "cc by"),
    phrase("mit", "mit license"),
)
NOTICES = (
    notice("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    notice("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    notice("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    notice("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    notice("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "redistribute it and or modify it"),
    notice("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    notice("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    notice("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    notice("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    notice("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    notice("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    notice("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    notice("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    notice("cc0", "released under the creative commons zero cc0 1 0 universal", "cc0 1 0"),
    notice("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)


def _idf(counts: dict[str, int], n: int, word: str) -> float:
    return math.log((n + 1) / (counts.get(word, 0) + 1))


#: A template's number and a place, in one number.
_PLACES = 1 << 40


def _agreed(votes: Column, need: list[int], which: Callable[[Column], Column]) -> Column:
    """Of sorted votes, each value that comes as often as its template needs."""
    needed = lambda v: F.get(F.lit(need), which(v).cast("int"))
    return F.filter(votes, lambda v, i: (F.coalesce(F.get(votes, i - 1) != v, F.lit(True))) & F.coalesce(F.get(votes, i + needed(v) - 1) == v, F.lit(False)))


def _index(entries: list[tuple[str, int]]) -> Column:
    """A map of words to arrays of numbers."""
    of: dict[str, list[int]] = {}
    for word, value in entries:
        of.setdefault(word, []).append(value)
    return F.create_map(*[x for w in sorted(of) for x in (F.lit(w), F.array(*[F.lit(v).cast("bigint") for v in of[w]]))])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES, least: float = 0.6, anchors: int = 2) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)."""
    templates = (*base, *notices)
    vocabulary = sorted({w for t in templates for w in t.key})
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut = texts(docs, key, text=text).select(f"`{key}`", F.regexp_extract_all(F.translate("text", upper, lower), F.lit(WORD), F.lit(0)).alias("_words"))
    found = cut.withColumn("_found", F.array_intersect("_words", F.array(*[F.lit(w) for w in vocabulary])))
    # templates of which the text has all words of the key
    of_word = _index([(w, n) for n, t in enumerate(templates) for w in sorted(set(t.key))])
    found = found.withColumn("_votes", F.array_sort(F.flatten(F.transform("_found", lambda w: F.element_at(of_word, w)))))
    whole = F.size(_agreed(F.col("_votes"), [len(set(t.key)) for t in templates], lambda v: v)) > 0
    table = written(found.select(f"`{key}`", F.size("_words").cast("long").alias("n_words"), "_found", F.when(whole, F.col("_words")).alias("_words")), "license-words")
    n = table.count()
    counts = {r["w"]: r["count"] for r in table.select(F.explode("_found").alias("w")).groupBy("w").count().collect()}  # one row a licence word at most
    # the index: each template under its key's rarest words; a number for the template, less the word's place in the key
    listed: list[tuple[str, int]] = []
    for number, t in enumerate(templates):
        rare = sorted(range(len(t.key)), key=lambda i: (-_idf(counts, n, t.key[i]), i))[:anchors]
        listed += [(t.key[i], number * _PLACES - i) for i in sorted(rare)]
    index, rare_words = _index(listed), sorted({w for w, _ in listed})
    words, none = F.col("_words"), F.array().cast("array<int>")
    every = F.when(F.coalesce(F.size("_words"), F.lit(0)) > 0, F.sequence(F.lit(0), F.size("_words") - 1)).otherwise(none)
    looked = table.withColumn("_places", F.when(words.isNull(), none).otherwise(F.filter(every, lambda p: F.get(words, p).isin(rare_words))))
    votes = F.array_sort(F.flatten(F.transform("_places", lambda p: F.transform(F.element_at(index, F.get(words, p)), lambda x: x + p))))
    # a place before the text's beginning is none, whatever number it would have
    looked = looked.withColumn("_votes", F.filter(votes, lambda v: v % _PLACES < (_PLACES >> 1)))
    number = lambda v: F.floor(v / F.lit(_PLACES)).cast("int")
    agreed = _agreed(F.col("_votes"), [min(anchors, len(t.key)) for t in templates], number)
    of = lambda values, v: F.get(F.lit(values), number(v))
    start = lambda v: (v % _PLACES).cast("int")
    keys, bodies = [list(t.key) for t in templates], [list(t.words) for t in templates]
    inside = [next(i for i in range(len(t.words)) if t.words[i : i + len(t.key)] == t.key) for t in templates]
    stands = F.filter(agreed, lambda v: F.slice(words, start(v) + 1, F.size(of(keys, v))) == of(keys, v))

    def share(v: Column) -> Column:
        body, first, long = of(bodies, v), of(inside, v), F.size(of(keys, v))
        here = lambda i: F.coalesce(F.get(words, start(v) - first + i) == F.get(body, i), F.lit(False))
        return F.size(F.filter(F.sequence(F.lit(0), F.size(body) - 1), lambda i: ((i >= first) & (i < first + long)) | here(i))) / F.size(body)

    labels = [t.label for t in templates]
    match = lambda v: F.struct(of(labels, v).alias("label"), start(v).cast("long").alias("start"), F.size(of(keys, v)).cast("long").alias("n_words"), share(v).alias("share"), of([t.base for t in templates], v).alias("base"))
    spans = looked.withColumn("_stands", stands).withColumn("_all", F.transform("_stands", match))
    spans = spans.withColumn("_all", F.filter("_all", lambda m: m["base"] | (m["share"] >= least))).withColumn("_base", F.filter("_all", lambda m: m["base"]))
    joined = lambda column: F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda m: m["label"]))), ",")
    starts = F.transform("_base", lambda m: m["start"])
    return spans.select(
        f"`{key}`",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined("_base").alias("base_labels"),
        joined("_all").alias("labels"),
        F.coalesce(F.array_max(F.transform("_all", lambda m: m["share"])), F.lit(0.0)).alias("score"),
        F.col("_all").alias("spans"),
    )
