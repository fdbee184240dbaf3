r"""License scans by a positional rare-token index, with DataFrame functions only.

A-Z are lower-cased; words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+. The index holds the words of license templates with their positions. A template scores at a place of a file by the IDF of its words that stand
there, over the IDF of all its words, those that no file has included; where that is 0, as every word is in every file, its words count alike. A template's score is that of its best place.

Steps. (1) A first pass counts in how many of all files each license word is; so few words are facts of the query. (2) A second pass keeps, of a file whose words could bring a template to FLOOR or that has all
words of a phrase, its license words with their positions. (3) Each such file looks up, for each template, its words of that template from the rarest on, until those that are left couldn't reach FLOOR by themselves; every place that can is
therefore met by one of them. The places are where a looked-up word stands in the template's postings, relative to its position in the file. (4) These places are scored from all words of the file. (5) A template
is a label if it scores MIN_SCORE and its mandatory phrases stand in the file. Base labels need a phrase alone: its words at consecutive positions.

The score of a file is that of its best template, 0 if none reaches FLOOR, whatever its phrases.

Defined results: a null, empty or wordless text has no words, places or labels and score 0; repeated rows get a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.llm.common import alnum_words, cut, table

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Openings of public licenses, and the phrases without which they don't count.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}
KEY_PHRASES = {
    "mit-text": ["permission is hereby granted", "free of charge"],
    "apache-2.0-header": ["apache license"],
    "gpl-notice": ["general public license", "free software"],
    "lgpl-notice": ["lesser general public license"],
    "bsd-text": ["redistribution and use", "source and binary forms"],
    "isc-text": ["permission to use", "is hereby granted"],
    "mpl-2.0-notice": ["mozilla public license"],
    "cc-by": ["creative commons attribution"],
}
#: From which score on a template is a label, and from which on it is scored at all.
MIN_SCORE, FLOOR = 0.6, 0.3
_EPS = 1e-9


def _bounded(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the templates; its size is that of the template parameter, so it is broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text).lower().split()


def document_frequencies(words: DataFrame, known: list[str]) -> tuple[int, dict[str, int]]:
    """How many files of words(w) there are, and in how many of them each known word is; as many facts as there are known words."""
    met = words.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect("w", F.array(*map(F.lit, known))))).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in met.collect()}
    return counts.pop("", 0), counts


def worths(body: dict[str, list[str]], n: int, df: dict[str, int]) -> dict[str, dict[str, float]]:
    """What each word of a template is worth wherever it stands in it: its IDF over n files, or 1 where that is 0 for all of them."""
    idf = {w: log((1.0 + n) / (1.0 + df.get(w, 0))) for ws in body.values() for w in ws}
    return {t: {w: idf[w] if sum(idf[x] for x in ws) > _EPS else 1.0 for w in ws} for t, ws in body.items()}


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, key_phrases: dict[str, list[str]] = KEY_PHRASES, min_score: float = MIN_SCORE, floor: float = FLOOR
) -> DataFrame:
    """(key, n_words, places, first_word, last_word, base_labels, labels, score) for every row of docs; labels are sorted arrays."""
    spark = docs.sparkSession
    body = {name: _words(t) for name, t in templates.items()}
    needed = sorted({*phrases, *(p for ps in key_phrases.values() for p in ps)})
    known = sorted({w for ws in body.values() for w in ws} | {w for p in needed for w in p.split()})
    worth = worths(body, *document_frequencies(docs.select(alnum_words(F.col(text)).alias("w")), known))
    whole = {t: sum(worth[t][w] for w in ws) for t, ws in body.items()}

    # a file's most for a template: all its words of it at their places
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), alnum_words(F.col(text)).alias("w"))
    own = words.withColumn("own", F.array_intersect("w", F.array(*map(F.lit, known))))
    able = []
    for t, ws in body.items():
        most = _sum_of("own", {w: worth[t][w] * ws.count(w) for w in set(ws)})
        able.append(F.when(most >= floor * whole[t] - _EPS, F.lit(t)))
    some = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.array_contains("own", w) for w in p.split()]) for p in phrases])
    at = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda x: F.array_contains("own", x["word"]))
    marked = own.select("row", "key", F.size("w").cast("long").alias("n_words"), "own", "w", F.filter(F.array(*able), lambda x: x.isNotNull()).alias("able"))
    files = cut(marked.select("row", "key", "n_words", "able", F.when((F.size("able") > 0) | some, at).alias("at")))
    hits = cut(files.where("at is not null").select("row", F.explode("at").alias("x")).select("row", "x.word", "x.pos"))

    parts = _bounded(spark, [(p, w, i, len(p.split())) for p in needed for i, w in enumerate(p.split())], "phrase string, word string, off int, size int")
    said = cut(hits.join(parts, "word").withColumn("start", F.col("pos") - F.col("off")).groupBy("row", "phrase", "size", "start").agg(F.count("*").alias("met")).where("met = size").select("row", "phrase", "start"))
    base = said.join(_bounded(spark, list(phrases.items()), "phrase string, label string"), "phrase")
    base = base.groupBy("row").agg(F.count("*").alias("places"), F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"), F.array_sort(F.collect_set("label")).alias("base_labels"))

    # each file's words of a template from the rarest on; a word is looked up while it and what follows could reach the floor
    rare = _bounded(spark, [(t, w, worth[t][w], worth[t][w] * body[t].count(w), floor * whole[t] - _EPS) for t in body for w in sorted(set(body[t]))], "template string, word string, worth double, most double, least double")
    mine = files.where("size(able) > 0").select("row", F.explode("able").alias("template"))
    has = hits.select("row", "word").distinct().join(rare, "word").join(mine, ["row", "template"], "left_semi")
    rest = F.sum("most").over(Window.partitionBy("row", "template").orderBy("worth", F.desc("word")).rowsBetween(Window.unboundedPreceding, 0))  # at most the words of a template
    looked_up = has.withColumn("rest", rest).where("rest >= least").select("row", "template", "word")
    posting = _bounded(spark, [(t, w, i, worth[t][w]) for t, ws in body.items() for i, w in enumerate(ws)], "template string, word string, tpos int, worth double")
    stands = cut(hits.join(posting, "word").join(mine, ["row", "template"], "left_semi").select("row", "template", "word", (F.col("pos") - F.col("tpos")).alias("place"), "worth"))
    places = cut(stands.join(looked_up, ["row", "template", "word"], "left_semi").select("row", "template", "place").distinct())
    scored = stands.join(places, ["row", "template", "place"]).groupBy("row", "template", "place").agg(F.sum("worth").alias("met"))
    full = _bounded(spark, [(t, x) for t, x in whole.items()], "template string, whole double")
    scores = scored.groupBy("row", "template").agg(F.max("met").alias("met")).join(full, "template").select("row", "template", F.least(F.col("met") / F.col("whole"), F.lit(1.0)).alias("score")).where(F.col("score") >= floor - _EPS)
    needs = _bounded(spark, [(t, p) for t, ps in key_phrases.items() for p in ps], "template string, phrase string")
    counts = _bounded(spark, [(t, len(ps)) for t, ps in key_phrases.items()], "template string, needed int")
    verified = said.select("row", "phrase").distinct().join(needs, "phrase").groupBy("row", "template").count().join(counts, "template").where("count = needed").select("row", "template", F.lit(True).alias("verified"))
    named = scores.join(verified, ["row", "template"], "left").groupBy("row").agg(
        F.array_sort(F.collect_set(F.when(F.col("verified") & (F.col("score") >= min_score - _EPS), F.col("template")))).alias("own_labels"), F.max("score").alias("score")
    )
    none = F.array().cast("array<string>")
    return (
        files.select("row", "key", "n_words")
        .join(base.join(named, "row", "full"), "row", "left")
        .select(
            F.col("key").alias(key), "n_words", F.coalesce("places", F.lit(0)).cast("long").alias("places"), "first_word", "last_word",
            F.coalesce("base_labels", none).alias("base_labels"), F.array_sort(F.array_union(F.coalesce("base_labels", none), F.coalesce("own_labels", none))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )


def _sum_of(words: str, values: dict[str, float]) -> Column:
    """The sum of the values that an array's words have."""
    known = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.aggregate(words, F.lit(0.0), lambda so_far, w: so_far + F.coalesce(F.try_element_at(known, w), F.lit(0.0)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.col("places").alias("n_base"), "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
