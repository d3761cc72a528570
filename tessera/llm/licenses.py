"""License scanning: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line of a text, as the set of its words. A template links to each block that contains at
least a share CONTAINED of the template's words. Words are ordered by their frequency over all blocks,
rarest first; a link needs a common word among the first ones of either side (prefix filter), a
block of enough words (length filter), and enough words left on both sides after the first common
one (positional filter). What remains is verified by intersection. Words that no template has can
be in no intersection, so blocks keep the others only; their frequencies order the join.

A notice that wraps stands in no line. A template also links to a window of consecutive words across
line ends, a quarter longer than the template so that comment marks made of letters fit in, that
contains the same share of its words. Windows that overlap are one link; one that touches a line
which links by itself is that line's. Only texts with enough of a template's words anywhere (length
filter) are searched, from each of the template's words on, in the pass that cuts the blocks.

All of it is DataFrame functions. The templates are fixed values, so their side is broadcast.

Edge cases: a null text counts as empty, without words, places or labels; repeated rows each get
their own row; templates that tie each give their label; a very long text with very many phrases is
read in linear time; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.shared import materialize

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License templates and their labels.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

#: The share of a template's words that a block must contain.
CONTAINED = 0.8
#: Words of a window over the words of its template, at most.
WIDER = 1.25
WRAPPED = "array<struct<label:string,n:int,share:double>>"
#: What separates words, in a lower-case text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same without the ends of lines.
IN_LINE = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def template_sets(templates: list[tuple[str, str]] | None = None, contained: float = CONTAINED) -> list[tuple[int, str, list[str], int]]:
    """Number, label, words and the least overlap of each template."""
    sets = [(n, label, sorted(set(re.split(GAP, text.lower())) - {""})) for n, (label, text) in enumerate(TEMPLATES if templates is None else templates)]
    return [(n, label, words, math.ceil(contained * len(words) - 1e-9)) for n, label, words in sets]


def window_widths(templates: list[tuple[str, str]] | None = None) -> list[int]:
    """The words of a window of each template."""
    return [math.ceil(WIDER * len([w for w in re.split(GAP, text.lower()) if w])) for _, text in (TEMPLATES if templates is None else templates)]


def lowered(text: Column) -> Column:
    """text in lower case. Beyond A-Z this changes letters outside ASCII, which are parts of words either way.

    The Kelvin sign and the dotted capital I, which would gain an ASCII letter, are kept out of it.
    """
    kept = F.when(text.rlike("[Kİ]"), F.translate(text, "Kİ", "ĸı")).otherwise(text)
    return F.lower(kept)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with value computed once even where fn names it in a lambda."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def phrase_starts(norm: Column, phrase: str) -> Column:
    """The word numbers at which phrase stands in norm, whose words have single blanks around them."""
    own = phrase.split()
    here = lambda words, i: reduce(Column.__and__, (F.get(words, i + k) == w for k, w in enumerate(own)))
    # Every word is looked at once; the words are bound, so that they are not split again for each.
    found = let(F.split(F.trim(norm), " "), lambda words: F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: here(words, i)))
    return F.when(norm.contains(f" {phrase} "), found).otherwise(F.lit([]).cast("array<int>"))


def wrapped(text: Column, lines: Column, sets: list, widths: list[int]) -> Column:
    """label, n and share of each template that windows across the line ends of text link to.

    text has blanks and line ends alone between words; lines: the template words of each of its lines.
    """
    if not sets:
        return F.lit([]).cast(WRAPPED)
    told = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(words).alias("words"), F.lit(need).alias("need"), F.lit(wide).alias("wide")) for (_, label, words, need), wide in zip(sets, widths, strict=True)))
    overlap = lambda words, t: F.size(F.array_intersect(words, t["words"]))
    may = let(F.array_distinct(F.flatten(lines)), lambda own: F.filter(told, lambda t: overlap(own, t) >= t["need"]))
    split = F.transform(F.split(text, "\n", -1), lambda l, n: F.transform(F.filter(F.split(l, " "), lambda w: w != ""), lambda w: F.struct(n.alias("line"), w.alias("word"))))
    tokens = F.transform(F.flatten(split), lambda x, at: F.struct(at.alias("at"), x["line"].alias("line"), x["word"].alias("word")))

    def window(span: Column, t: Column) -> Column:
        first, last = F.element_at(span, 1), F.element_at(span, -1)
        held = F.transform(span, lambda x: x["word"])
        return F.struct(first["at"].alias("start"), last["at"].alias("end"), first["line"].alias("first"), last["line"].alias("last"), overlap(held, t).alias("overlap"))

    def links(own: Column, t: Column) -> Column:
        windows = F.transform(own, lambda x, n: let(F.filter(F.slice(own, n + 1, t["wide"]), lambda y: y["at"] < x["at"] + t["wide"]), lambda span: window(span, t)))
        told_by_line = lambda w: F.exists(F.slice(lines, w["first"] + 1, w["last"] - w["first"] + 1), lambda l: overlap(l, t) >= t["need"])
        found = F.filter(windows, lambda w: (w["overlap"] >= t["need"]) & (w["first"] < w["last"]) & ~told_by_line(w))
        none = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n"), F.lit(0).alias("overlap"))
        step = lambda acc, w: F.struct(F.greatest(acc["end"], w["end"]).alias("end"), (acc["n"] + (w["start"] > acc["end"]).cast("int")).alias("n"), F.greatest(acc["overlap"], w["overlap"]).alias("overlap"))
        return F.aggregate(found, none, step, lambda acc: F.struct(t["label"].alias("label"), acc["n"].alias("n"), (acc["overlap"] / F.size(t["words"])).alias("share")))

    def search(ts: Column) -> Column:
        every = let(tokens, lambda all_: F.transform(ts, lambda t: let(F.filter(all_, lambda x: F.array_contains(t["words"], x["word"])), lambda own: links(own, t))))
        return F.when(F.size(ts) > 0, F.filter(every, lambda f: f["n"] > 0)).otherwise(F.lit([]).cast(WRAPPED))

    return let(may, search)


def words_and_blocks(docs: DataFrame, sets: list, id_column: str = "doc_id", text_column: str = "text", phrases: dict[str, str] | None = None, widths: list[int] | None = None) -> DataFrame:
    """Narrow rows, written once: id, word count, phrase places by label, blocks of template words and wrapped links."""
    phrases = PHRASES if phrases is None else phrases
    rows = docs.select(F.col(id_column).alias("doc_id"), lowered(F.coalesce(F.col(text_column), F.lit(""))).alias("text"))
    # Gaps within lines go in one pass; what is left at line ends is little.
    rows = rows.withColumn("even", F.regexp_replace("text", IN_LINE, " "))
    rows = rows.withColumn("norm", F.trim(F.regexp_replace("even", " *\\n[ \\n]*", " ")))
    vocabulary = F.lit(sorted({w for _, _, words, _ in sets for w in words}))
    least = min((c for *_, c in sets), default=1)
    lines = F.transform(F.split("even", "\n", -1), lambda l: F.array_intersect(F.split(l, " "), vocabulary))
    rows = rows.withColumn("lines", lines)
    widths = [math.ceil(WIDER * len(words)) for *_, words, _ in sets] if widths is None else widths
    rows = rows.select(
        "doc_id",
        F.when(F.col("norm") == "", 0).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.concat(F.lit(" "), "norm", F.lit(" ")).alias("norm"),
        F.filter("lines", lambda b: F.size(b) >= least).alias("blocks"),
        wrapped(F.col("even"), F.col("lines"), sets, widths).alias("wrapped"),
    )
    starts = [phrase_starts(F.col("norm"), p).alias(f"p{n}") for n, p in enumerate(phrases)]
    return materialize(rows.select("doc_id", "n_words", "blocks", "wrapped", *starts, F.monotonically_increasing_id().alias("row")), "blocks")


def word_order(rows: DataFrame) -> dict[str, int]:
    """Ranks of the templates' words, rarest over all blocks first: as many as the templates have words."""
    counts = rows.select(F.explode("blocks").alias("b")).select(F.explode("b").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.word: k for k, r in enumerate(sorted(counts, key=lambda r: (r.n, r.word)))}


def join(rows: DataFrame, sets: list) -> DataFrame:
    """row, place of the block, template, label and share contained, of every link."""
    spark = rows.sparkSession
    order = word_order(rows)
    least = min((c for *_, c in sets), default=1)
    prefixes = []
    for n, label, words, need in sets:
        ordered = sorted(words, key=lambda w: (order.get(w, -1), w))  # words that no block has come first: they join nothing
        prefixes += [(w, n, label, place, len(words), need, ordered) for place, w in enumerate(ordered[: len(words) - need + 1])]
    table = spark.createDataFrame(prefixes, "word string, template int, label string, t_place int, t_size int, need int, t_words array<string>")
    ranks = F.create_map(*(x for w, k in order.items() for x in (F.lit(w), F.lit(k)))) if order else F.create_map(F.lit(""), F.lit(0))
    blocks = rows.where(F.size("blocks") > 0).select("row", F.posexplode("blocks").alias("block", "words"))
    blocks = blocks.select("row", "block", "words", F.transform(F.array_sort(F.transform("words", lambda w: F.struct(ranks[w].alias("k"), w.alias("w")))), lambda s: s["w"]).alias("ordered"))
    size = F.size("words")
    heads = blocks.select("row", "block", "words", size.alias("size"), F.posexplode(F.slice("ordered", 1, size - least + 1)).alias("b_place", "word"))
    prefix = F.col("b_place") <= F.col("size") - F.col("need")
    length = F.col("size") >= F.col("need")
    positional = 1 + F.least(F.col("t_size") - F.col("t_place"), F.col("size") - F.col("b_place")) - 1 >= F.col("need")
    overlap = F.size(F.array_intersect("words", "t_words"))
    met = heads.join(F.broadcast(table), "word").where(prefix & length & positional).withColumn("overlap", overlap).where("overlap >= need")
    return met.groupBy("row", "block", "template").agg(F.first("label").alias("label"), F.first(F.col("overlap") / F.col("t_size")).alias("share"))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, contained: float = CONTAINED) -> DataFrame:
    """doc_id, n_words, places (starts and label of each phrase found); links of lines, their labels and best share; wrapped links."""
    phrases = PHRASES if phrases is None else phrases
    sets = template_sets(templates, contained)
    rows = words_and_blocks(docs, sets, id_column, text_column, phrases, window_widths(templates))
    linked = join(rows, sets).groupBy("row").agg(F.count(F.lit(1)).alias("n_links"), F.collect_set("label").alias("linked"), F.max("share").alias("share"))
    places = F.filter(F.array(*(F.struct(F.lit(label).alias("label"), F.col(f"p{n}").alias("starts")) for n, label in enumerate(phrases.values()))), lambda p: F.size(p["starts"]) > 0)
    return rows.join(linked, "row", "left").select("doc_id", "n_words", places.alias("places"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("linked", F.lit([]).cast("array<string>")).alias("linked"), F.coalesce("share", F.lit(0.0)).alias("share"), "wrapped")
