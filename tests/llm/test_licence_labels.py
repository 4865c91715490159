"""Licence labels of bare titles, reworded notices, full texts and other versions, alone and among neighbours."""

from bazaarlens.llm import licences

CASES = [
    ("MIT License", "mit"), ("The MIT License (MIT)", "mit"), ("Apache License", "apache-2.0"),
    ("Apache License 2.0", "apache-2.0"), ("Apache License, Version 2.0, January 2004", "apache-2.0"),
    ("Licensed, as we said, under the well known Apache License of the foundation", "apache-2.0"),
    ("you may use it under the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("code: CC BY-NC, see below", "cc-by,cc-by-nc"),
    ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("GNU General Public License", "gpl,gpl-3.0"), ("GNU General Public License, version 2", "gpl"),
    ("GNU General Public License v2 or GNU General Public License v3", "gpl,gpl-3.0"),
    ("Apache License, Version 1.1", ""), ("Apache License 1.1", ""), ("Apache License\n1. Definitions", "apache-2.0"),
    ("GNU Lesser General Public License v3", "gpl,lgpl"),
    ("TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "apache-2.0"),
    ("BSD 3-Clause License", "bsd"), ("ISC License", "isc"),
    ("dedicated to the public, domain names aside", "public-domain"),
    ("Apache and its License", ""), ("a license from MIT", ""), ("", ""), (None, "")]


def labels(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    return {r["doc_id"]: (r["labels"], r["score"]) for r in licences.scan(rows).collect()}


def test_a_whole_phrase_decides_whatever_the_neighbours(spark):
    texts, want = [t for t, _ in CASES], [x for _, x in CASES]
    alone = labels(spark, texts)
    assert [alone[k][0] for k in range(len(texts))] == want
    assert all((score > 0) == (label != "") and score <= 1 for label, score in alone.values())
    crowd = ["released under the MIT license, version 2.0, licensed under the Apache terms"] * 300
    crowded = labels(spark, texts + crowd)
    assert [crowded[k][0] for k in range(len(texts))] == want


def test_labels_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    rules = [(x, k) for x, _, k in licences.TEMPLATES] + [(x, k) for k, x in licences.PHRASES.items()]
    some = 0
    for r in docs.select("doc_id", licences.words_of(docs["text"]).alias("w")).collect():
        text = f" {' '.join(r['w'])} "
        want = {x for x, k in rules if f" {k} " in text}
        some += bool(want)
        assert got[r["doc_id"]]["labels"] == ",".join(sorted(want))
    assert some
