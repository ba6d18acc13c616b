"""License scan: an exact set-similarity join of text blocks with license templates.

DataFrame functions only. A block is a line of a document, and, as notices are
wrapped, also the whole document read across its line ends; where one of these
is longer than ``BLOCK_WORDS`` words, each window of that many words at half
that step. So every run of words as long as half a window and one (the longest
template has fewer) stands whole in some block. A block matches a template when it holds at least ``THRESHOLD`` of the
template's distinct words. Template words are ordered by their frequency in
the corpus; prefix, length and positional filters leave few candidates, and
each is checked on its whole sets.

Besides the join, the places of the plain base phrases are counted.

Edge cases: null and blank texts have no words, no labels and score 0;
repeated rows give repeated results; an empty table gives an empty result;
columns other than the id and the text are ignored; a null id is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.cluster import checkpointed, written

THRESHOLD_PERCENT = 80
BLOCK_WORDS = 96

#: The phrases whose places are counted, and their labels.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Opening words of well-known license notices.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def words_of(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z lowered."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(f"({_WORD})"), F.lit(1))


def literal_words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def least_overlap(words: list[str], percent: int) -> int:
    return -(-percent * len(words) // 100)


def base_places(words: str) -> Column:
    """Structs (start, label) of every base phrase in the array column ``words``."""
    cases = []
    for label, phrase in BASE.items():
        first, *others = phrase.split()
        rest = " and ".join(f"get({words}, i + {k}) = '{w}'" for k, w in enumerate(others, 1))
        cases.append(f"when w = '{first}' and {rest} then '{label}'")
    return F.expr(f"filter(transform({words}, (w, i) -> named_struct('start', cast(i as long), 'label', case {' '.join(cases)} end)), x -> x.label is not null)")


def scan_licenses(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: list[tuple[str, str]] = TEMPLATES, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """License labels of every document.

    Returns ``id, n_words, n_base, first_word, last_word, base_labels, labels,
    score``: the number of words, of base places, their smallest and largest
    start, the base labels, all labels, and the largest part of a template
    that a block holds (1 for a base phrase, 0 without any match). One pass
    reads all words and keeps the text only of documents that hold enough of
    some template, or of a base phrase, to match at all; words are never
    exploded over the corpus.
    """
    spark = documents.sparkSession
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    known = sorted({w for _, t in sets for w in t} | {w for p in BASE.values() for w in p.split()})
    docs = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    read = docs.select("id", "text", words_of(F.col("text")).alias("words"))
    read = read.select("id", "text", F.size("words").cast("long").alias("n_words"), F.array_intersect(literal_words(known), "words").alias("present"))
    could = [F.size(F.array_intersect("present", literal_words(t))) >= least_overlap(t, percent) for _, t in sets]
    could += [F.size(F.array_intersect("present", literal_words(p.split()))) == len(p.split()) for p in BASE.values()]
    keep = could[0]
    for c in could[1:]:
        keep = keep | c
    table = written(read.select("id", F.xxhash64("id", "text").alias("k"), "n_words", F.when(keep, F.col("present")).alias("present"), F.when(keep, F.col("text")).alias("text"), F.expr("if(size(present) > 0, present, null)").alias("seen")), "license-words")

    # The words of the templates, rarest first: at most as many rows as the templates have words.
    counts = {r["word"]: r["n"] for r in table.select(F.explode("seen").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    order = sorted(known, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    kept = table.where("text is not null").select("k", "id", "text")
    base = kept.select("k", words_of(F.col("text")).alias("words")).select("k", base_places("words").alias("places")).where("size(places) > 0")
    base = base.dropDuplicates(["k"]).select("k", F.size("places").cast("long").alias("n_base"), F.array_min(F.expr("places.start")).alias("first_word"), F.array_max(F.expr("places.start")).alias("last_word"), F.array_distinct(F.expr("places.label")).alias("base_labels"))

    # Before the lines of a document of several, number 0, stands the whole of it.
    parts = F.split("text", "\n")
    lines = kept.select("k", F.posexplode(F.concat(F.array(F.when(F.size(parts) > 1, F.col("text"))), parts)).alias("line", "part"))
    lines = lines.select("k", "line", words_of(F.col("part")).alias("w")).where("size(w) > 0")
    windows = F.expr(f"if(size(w) <= {BLOCK_WORDS}, array(w), transform(sequence(0, size(w) - 1, {BLOCK_WORDS // 2}), i -> slice(w, i + 1, {BLOCK_WORDS})))")
    blocks = lines.select("k", "line", F.posexplode(windows).alias("window", "w"))
    # In the order of ``order``, as the intersection keeps that of its first argument.
    blocks = blocks.select("k", "line", "window", F.array_intersect(literal_words(order), "w").alias("held"))
    least = min(least_overlap(t, percent) for _, t in sets)
    entries = blocks.where(f"size(held) >= {least}").select("k", "line", "window", "held", F.expr(f"posexplode(slice(held, 1, size(held) - {least - 1}))").alias("j", "word"))

    rows = []
    for number, (label, t) in enumerate(sets):
        t, c = sorted(t, key=rank.get), least_overlap(t, percent)
        items = ", ".join(f"'{w}'" for w in t)
        rows += [f"({number}, '{label}', '{w}', {i}, {len(t)}, {c}, array({items}))" for i, w in enumerate(t[: len(t) - c + 1])]
    prefixes = spark.sql("select * from values " + ", ".join(rows) + " as t(template, label, word, i, size, c, wanted)")
    # The broadcast side is the fixed list above.
    met = entries.join(F.broadcast(prefixes), "word").where("size(held) >= c and j <= size(held) - c and 1 + least(size - 1 - i, size(held) - 1 - j) >= c")
    met = met.withColumn("part", F.size(F.array_intersect("held", "wanted")) / F.col("size")).where(f"part * 100 >= {percent} - 1e-9")
    # Of the templates that a block meets, the nearest name it; a set of at most as many as there are templates.
    best = met.where("line > 0").groupBy("k", "line", "window").agg(F.max("part").alias("score"), F.collect_set(F.struct("part", "label")).alias("all"))
    best = best.select("k", "score", F.explode(F.expr("filter(all, x -> x.part = score)")).alias("x"))
    # A window's end can cut a notice that stands whole in the next or last one: no template is met by words that are all of a nearer one there.
    across = met.where("line = 0").select("k", F.explode(F.expr("array(window - 1, window, window + 1)")).alias("spot"), F.struct("window", "part", "label", F.array_intersect("held", "wanted").alias("own"), "wanted").alias("x"))
    across = across.groupBy("k", "spot").agg(F.collect_set("x").alias("all")).withColumn("score", F.expr("array_max(transform(filter(all, x -> x.window = spot), x -> x.part))"))
    across = across.select("k", "score", F.explode(F.expr("filter(all, x -> x.window = spot and x.part = score and not exists(all, y -> y.part > x.part and size(array_except(x.own, y.wanted)) = 0))")).alias("x"))
    best = best.unionByName(across.select("k", "score", F.expr("named_struct('part', x.part, 'label', x.label)").alias("x")))
    matched = best.groupBy("k").agg(F.collect_set("x.label").alias("added"), F.max("score").alias("score"))

    joined = table.select("id", "k", "n_words").join(checkpointed(base), "k", "left").join(matched, "k", "left")
    empty = F.array().cast("array<string>")
    base_labels, added = F.coalesce("base_labels", empty), F.coalesce("added", empty)
    return joined.select(
        "id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, added)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )


def op8_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
