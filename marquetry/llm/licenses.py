"""License scans: an exact set-similarity join of text blocks with license templates, in built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.llm.common import held as held_row

#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices whose words a block (a line, or a stretch of words across lines) must contain to the threshold.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.8
#: Complement of the word characters: ASCII letters of either case, digits, and all beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lower(text: Column) -> Column:
    """Lower case. The two letters beyond ASCII whose lower case is ASCII become another letter beyond ASCII first."""
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı")))


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def template_frequencies(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, text_col: str = "text") -> dict[str, int]:
    """How often each word of the templates occurs in all texts: one row per template word reaches the driver."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    found = docs.select(F.explode(F.split(_lower(F.coalesce(F.col(text_col), F.lit(""))), GAP)).alias("w")).where(F.col("w").isin(vocabulary))
    counts = dict.fromkeys(vocabulary, 0)
    counts.update({r[0]: r[1] for r in found.groupBy("w").count().toLocalIterator()})
    return counts


def _sql(value: object) -> str:
    """A literal of strings, numbers, lists and named fields in SQL; the optimizer folds it into one constant."""
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"'{k}', {_sql(v)}" for k, v in value.items()) + ")"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(map(_sql, value)) + ")"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


class PrefixIndex:
    """Templates as sets of words in a global order, rarest first, under the words of their prefixes, as constants of a plan.

    A block that shares `need` of a template's n words shares one of its n - need + 1 rarest. An entry says how many of
    the template's words stand from its word on: with the words of the block from there on, it bounds what can be shared.
    The plan holds one index, whatever the number of templates, and only templates that a block fetches are compared.
    """

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float, counts: dict[str, int]):
        self.order = sorted(counts, key=lambda w: (counts[w], w))
        rank = {w: k for k, w in enumerate(self.order)}
        self.templates, entries = [], {}
        for number, (label, text) in enumerate(templates):
            own = sorted(set(text.split()), key=rank.get)
            need = max(1, math.ceil(threshold * len(own) - 1e-9))
            span = math.ceil(len(text.split()) / threshold - 1e-9)
            self.templates.append({"label": label, "words": own, "size": len(own), "need": need, "span": span})
            for at, word in enumerate(own[: len(own) - need + 1]):
                entries.setdefault(word, []).append({"number": number, "need": need, "rest": len(own) - at})
        self.prefix = sorted(entries, key=rank.get)
        self.least = min((t["need"] for t in self.templates), default=1)
        self.widest = max((t["span"] for t in self.templates), default=1)
        self._all = F.expr(_sql(self.templates)) if templates else None
        self._entries = F.expr(f"map_from_arrays({_sql(self.prefix)}, {_sql([entries[w] for w in self.prefix])})") if templates else None

    def template(self, number: Column) -> Column:
        return F.element_at(self._all, number + 1)

    def met(self, held: Column) -> Column:
        """(number, shared) of each template of which `held`, a block's template words in order, holds enough."""
        size = F.size(held)

        def fetched(word: Column, at: Column) -> Column:
            found = F.coalesce(F.try_element_at(self._entries, word), F.slice(F.try_element_at(self._entries, F.lit(self.prefix[0])), 1, 0))
            return F.transform(F.filter(found, lambda e: F.least(size - at, e["rest"]) >= e["need"]), lambda e: e["number"])

        numbers = F.array_distinct(F.flatten(F.transform(held, fetched)))
        shared = F.transform(numbers, lambda n: F.struct(n.alias("number"), F.size(F.array_intersect(self.template(n)["words"], held)).alias("shared")))
        return F.filter(shared, lambda x: x["shared"] >= self.template(x["number"])["need"])

    def stretch(self, number: Column, block: Column) -> Column:
        """(number, shared): the most words of a template that a stretch of the block as long as its span holds.

        The best stretch begins with a word of the template, so no other place is looked at.
        """
        own, span = self.template(number)["words"], self.template(number)["span"]
        starts = F.filter(F.sequence(F.lit(1), F.size(block)), lambda at: F.array_contains(own, F.element_at(block, at)))
        held = F.transform(starts, lambda at: F.size(F.array_intersect(own, F.slice(block, at, span))))
        return F.struct(number.alias("number"), F.coalesce(F.array_max(held), F.lit(0)).alias("shared"))


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Find license phrases and blocks that contain a template; adds n_words, n_base, first_word, last_word, base_labels, labels, score.

    A block is a line, or a stretch of consecutive words of the text, whatever lines they stand in: for a template of n
    words every stretch of ceil(n / threshold) words, so that a wrapped notice is met. It meets a template if it holds
    at least ceil(threshold * |T|) of the template's distinct words T. The join is exact. Words are ordered by their count
    in all texts, rarest first; a block fetches the templates that have one of its words in their prefix (`PrefixIndex`), drops
    those for which too few words are left on either side of that word (length and positional filters), and counts
    the overlap with the rest. Stretches are looked for in texts of several lines only (a line holds its own), for templates
    of which the whole text holds enough words, in blocks of twice the longest stretch that start one such stretch apart:
    every stretch lies whole in one of them. The index is a constant of the plan, so neither texts nor blocks are shuffled: a
    hot line or source has no effect on the plan.

    score: the largest containment of any template in any block, 1.0 if a base phrase occurs, else 0.0.
    Null and empty texts: no words, counts 0, null first_word and last_word, empty labels. Rows are judged one by one;
    columns of docs that bear the new names are replaced, and an empty table gives an empty result.
    """
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    docs = docs.drop(*[c for c in names if c in docs.columns])
    index = PrefixIndex(templates, threshold, template_frequencies(docs, templates, text_col))

    low = _lower(F.coalesce(F.col(text_col), F.lit("")))
    out = docs.withColumn("_l_text", low)
    # Base phrases: positions are worked out only where the raw text can hold a phrase.
    hint = F.lit(False)
    for phrase, _ in PHRASES:
        hint = hint | F.col("_l_text").rlike(GAP.join(phrase.split()))
    out = out.withColumns({"_l_words": _tokens(F.col("_l_text")), "_l_hint": hint})

    def starts(phrase: str) -> Column:
        first, *rest = phrase.split()

        def here(w: Column, i: Column) -> Column:
            ok = w == first
            for k, r in enumerate(rest, 1):
                ok = ok & F.coalesce(F.get("_l_words", i + k) == r, F.lit(False))
            return F.when(ok, i)

        return F.array_compact(F.transform("_l_words", here))

    none = F.array().cast("array<int>")
    for k, (phrase, _) in enumerate(PHRASES):
        out = out.withColumn(f"_l_at{k}", F.when(F.col("_l_hint"), starts(phrase)).otherwise(none))
    empty = F.array().cast("array<struct<number:int,shared:int>>")
    if templates:
        every, prefix = F.expr(_sql(index.order)), F.expr(_sql(index.prefix))
        # Lines with a word of a prefix, reduced to their template words in global order.
        lines = F.transform(F.split("_l_text", "\n"), lambda x: F.split(x, GAP))
        near = F.filter(lines, lambda b: (F.size(b) >= index.least) & F.arrays_overlap(b, prefix))
        out = out.withColumn("_l_lines", F.flatten(F.transform(near, lambda b: index.met(F.array_intersect(every, b)))))
        # Stretches across lines, for templates of which the text holds enough words at all.
        held = F.when(F.contains("_l_text", F.lit("\n")), index.met(F.array_intersect(every, "_l_words")))
        out = out.withColumn("_l_able", held)
        cut = F.transform(F.sequence(F.lit(1), F.size("_l_words"), F.lit(index.widest)), lambda at: F.slice("_l_words", at, F.lit(2 * index.widest)))
        out = out.withColumn("_l_cut", F.when(F.size("_l_able") > 0, F.filter(cut, lambda b: F.arrays_overlap(b, prefix))))
        across = F.flatten(F.transform("_l_cut", lambda b: F.transform("_l_able", lambda x: index.stretch(x["number"], b))))
        across = F.filter(across, lambda x: x["shared"] >= index.template(x["number"])["need"])
        out = out.withColumn("_l_met", F.concat("_l_lines", F.coalesce(F.when(F.size("_l_cut") > 0, across), empty)))
        own = F.transform("_l_met", lambda x: index.template(x["number"])["label"])
        share = F.array_max(F.transform("_l_met", lambda x: x["shared"] / index.template(x["number"])["size"].cast("double")))
    else:
        own, share = F.array().cast("array<string>"), F.lit(None).cast("double")
    n_base = sum((F.size(f"_l_at{k}") for k in range(len(PHRASES))), F.lit(0))
    base = F.array_compact(F.array(*[F.when(F.size(f"_l_at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    at = F.array_sort(F.concat(*[F.col(f"_l_at{k}") for k in range(len(PHRASES))]))
    score = F.greatest(F.when(n_base > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(share, F.lit(0.0)))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        held_row(F.size("_l_words").cast("long")).alias("n_words"),
        held_row(n_base.cast("long")).alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        held_row(F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",")).alias("labels"),
        held_row(score).alias("score"),
    )
