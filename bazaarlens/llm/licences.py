"""Licence scans by a positional rare-token index, in DataFrame operations only.

The index holds every word of every licence template with its position. Word rarity is measured over all files. A file
is looked up by the rarest word of each template; from there the postings of all its licence words are intersected by
relative position (file position minus template position), and an alignment counts if it holds every word of the
template's mandatory phrase, whatever stands around it, unless another version of the licence is named behind it. The
rarity that an alignment holds is only its score. Exact phrases are found beside it, place by place."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.session import cut_lineage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that carry a label wherever their words stand consecutively.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, template, mandatory phrase in it. A label has any number of templates.
TEMPLATES = (
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "released under cc0 1 0 universal public domain dedication", "cc0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose",
     "distribute this software for any purpose"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy",
     "granted free of charge"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("public-domain", "this work is dedicated to the public domain", "public domain"),
    # titles
    ("agpl", "gnu affero general public license version 3", "affero general public license"),
    ("apache-2.0", "apache license version 2 0", "apache license"),
    ("apache-2.0", "apache license 2 0", "apache license"),
    ("bsd", "bsd 2 clause license", "bsd 2 clause"),
    ("bsd", "bsd 3 clause license", "bsd 3 clause"),
    ("bsd", "the bsd license", "bsd license"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international", "attribution noncommercial"),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international", "attribution noderivatives"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international", "attribution sharealike"),
    ("cc0", "cc0 1 0 universal", "cc0"),
    ("gpl-3.0", "gnu general public license version 3", "gnu general public license"),
    ("isc", "isc license", "isc license"),
    ("lgpl", "gnu lesser general public license version 3", "lesser general public license"),
    ("mit", "mit license", "mit license"),
    ("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    # full texts, where the title may be missing
    ("apache-2.0", "terms and conditions for use reproduction and distribution",
     "conditions for use reproduction and distribution"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is "
     "distributed on an as is basis without warranties or conditions of any kind",
     "distributed under the license is distributed on an as is basis"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products", "nor the names of its contributors may be used to endorse"),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works",
     "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", "distribute this software for any purpose"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files the software to deal in the software without restriction", "granted free of charge"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     "mozilla public license"),
    ("public-domain", "this is free and unencumbered software released into the public domain", "public domain"),
)
#: Versions that a label does not name: behind a mandatory phrase they stand for another licence.
OTHER_VERSIONS = {"apache-2.0": ("1",), "gpl-3.0": ("1", "2"), "mpl-2.0": ("1",)}


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def phrase_starts(words: Column, phrase: str) -> Column:
    """Places, from 0, where a phrase's words stand consecutively."""
    parts = phrase.split()
    rare = max(parts, key=len)

    def here(i: Column) -> Column:
        return reduce(lambda x, y: x & y, [F.get(words, i + k) == p for k, p in enumerate(parts)])

    places = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)
    enough = F.array_contains(words, rare) & (F.size(words) >= len(parts))
    return F.when(enough, places).otherwise(F.array().cast("array<int>"))


def postings(templates: tuple = TEMPLATES) -> list[tuple[int, int, str, int, int]]:
    """(template, position, word, 1 if of the mandatory phrase, weight against the label) for every word of every
    template, and for words that name another version behind the mandatory phrase: weights of 2 rule the label out."""
    out = []
    for t, (label, template, key) in enumerate(templates):
        words, must = template.split(), key.split()
        at = next(i for i in range(len(words)) if words[i: i + len(must)] == must)
        out += [(t, i, w, int(at <= i < at + len(must)), 0) for i, w in enumerate(words)]
        end = at + len(must)
        if label in OTHER_VERSIONS:
            out += [(t, end, "version", 0, 1), (t, end, "v", 0, 1), (t, end + 1, "0", 0, 1)]
            for n in OTHER_VERSIONS[label]:  # "version 2", "v2", "2.0"; a bare "2" may begin a list
                out += [(t, end, n, 0, 1), (t, end, f"v{n}", 0, 2), (t, end + 1, n, 0, 1)]
    return out


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: tuple = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs (doc_id, text).

    n_base counts all places of the phrases, first_word and last_word are their smallest and largest start (null if
    there is none). labels adds those of templates whose whole mandatory phrase stands in the text, whatever other files
    hold, unless each time another version follows it. score is 1 if a phrase stands in the text, else the share of its
    rarity that the best template has there. A null or empty text has no words and score 0; labels are sorted;
    repeated rows and extra columns do not matter."""
    phrases = PHRASES if phrases is None else phrases
    spark = docs.sparkSession
    index = postings(templates)
    vocabulary = sorted({w for _, _, w, _, _ in index})
    rows = docs.select("doc_id", words_of(F.col("text").cast("string")).alias("words"))
    known = F.array(*[F.lit(w) for w in vocabulary])
    df = (rows.select(F.explode(F.array_intersect("words", known)).alias("word")).groupBy("word").count()
          .collect())  # a row per template word at most
    counts = {r["word"]: r["count"] for r in df}
    total = max(counts.values(), default=0) + 1
    idf = {w: max(0.1, float(math.log((total + 1) / (counts.get(w, 0) + 1)))) for w in vocabulary}
    anchors = {}
    for t, _, w, must, _ in index:  # the rarest word of the mandatory phrase opens a template
        if must and (t not in anchors or idf[w] > idf[anchors[t]]):
            anchors[t] = w
    table = spark.createDataFrame(
        [(t, i, w, must, 0.0 if against else idf[w], against) for t, i, w, must, against in index],
        "template int, off int, word string, must int, idf double, against int")
    sizes = spark.createDataFrame(
        [(t, label, sum(idf[w] for x, _, w, _, against in index if x == t and not against), len(key.split()))
         for t, (label, _, key) in enumerate(templates)], "template int, label string, whole double, need int")

    openers = F.array(*[F.lit(w) for w in sorted(set(anchors.values()))])
    placed = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    found = F.when(F.arrays_overlap("words", openers),
                   F.filter(placed, lambda x: F.array_contains(known, x["word"])))
    starts = {label: phrase_starts(F.col("words"), p) for p, label in phrases.items()}
    narrow = cut_lineage(rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"),
        F.struct(*[s.alias(f"s{k}") for k, s in enumerate(starts.values())]).alias("starts"), found.alias("found")))

    hits = narrow.select("row", F.explode("found").alias("x")).select("row", "x.at", "x.word")
    aligned = (hits.join(F.broadcast(table), "word")
               .groupBy("row", "template", (F.col("at") - F.col("off")).alias("shift"))
               .agg(F.sum("idf").alias("weight"), F.sum("must").alias("must"), F.sum("against").alias("against"))
               .where("must > 0 and against < 2").join(F.broadcast(sizes), "template").where("must = need")
               .withColumn("share", F.least(F.lit(1.0), F.col("weight") / F.col("whole"))))
    per_row = aligned.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))

    lists = [F.col(f"starts.s{k}") for k in range(len(starts))]
    places = F.concat(*lists) if lists else F.array().cast("array<int>")
    base = F.array_compact(F.array(*[F.when(F.size(s) > 0, label) for s, label in zip(lists, starts)]))
    out = narrow.withColumns({"places": places, "base": base}).join(per_row, "row", "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", more))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
