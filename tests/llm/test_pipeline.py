"""Every stage of the pipeline against plain Python on what its predecessor kept, edge rows among the documents."""

import re

import corpus_pipeline
import __spark_entry__ as entry
from bazaarlens.llm import langid, licences, queries
from test_operators import FOLDER, brute_components, documents, low


def edge_rows(spark, docs):
    text = docs.where("length(text) > 800").orderBy("doc_id").first()["text"]
    words = text.split()
    near = " ".join(words[:40] + ["other"] + words[41:])
    rows = [(9001, None, "en"), (9002, "", "en"), (9003, " 1234 !? ", None), (9004, near, None), (9004, near, None),
            (9005, text, "en"), (None, near + " more", "en"), (9006, "x" * 300_000, "en")]
    one = docs.first()
    return spark.createDataFrame([(i, t, lang, one["source"], len(t) if t else 0) for i, t, lang in rows], docs.schema)


def hits(words, windows):
    return {k + j for n in {len(x) for x in windows} for k in range(len(words) - n + 1)
            if tuple(words[k: k + n]) in windows for j in range(n)}


def test_stages_against_plain_python(spark):
    docs = documents(spark)
    docs = docs.unionByName(edge_rows(spark, docs)).cache()
    kept = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    model = langid.fit_documents(docs)
    judged = list(zip(kept, model.judge([t for _, t in kept])[3]))
    windows = set()
    for t, in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("text").collect():
        w = re.findall(licences.WORD, low(t))
        windows |= {tuple(w[k: k + min(13, len(w))]) for k in range(len(w) - min(13, len(w)) + 1)} - {()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name == "language_id":
            kept = [r for r, rejected in judged if not rejected]
            assert not any(i in (9001, 9002, 9003) for i, _ in kept)
        elif name == "near_duplicates":
            groups = {}
            for k, _, c in brute_components([(k, t) for k, (_, t) in enumerate(kept)], 5, 80):
                groups.setdefault(c, []).append((kept[k][0] is None, *kept[k]))
            got, kept = [(r["doc_id"] is None, r["doc_id"], r["text"]) for r in out.collect()], []
            for group in groups.values():
                first = min(x[:2] for x in group)
                # of rows with the smallest id any one text may stay
                kept += [next(x[1:] for x in got if x[:2] == first and x in group)]
        elif name == "decontamination":
            kept = [(i, t) for i, t in kept if not (h := hits(w := re.findall(licences.WORD, low(t)), windows))
                    or 20 * len(h) < len(w)]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(kept, key=str)
            docs = out.cache()
        else:
            rows = out.collect()
            assert sorted(str(r[0]) for r in rows) == sorted(str(i) for i, _ in kept) and all(r["round_trip"] for r in rows)


def test_nothing_to_learn_from(spark):
    """Without labels every text is rejected, so the pipeline's result is empty; so it is for an empty table."""
    docs = documents(spark).selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    assert corpus_pipeline.language_id(spark, docs, FOLDER).count() == 0
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), FOLDER).count() == 0
    assert corpus_pipeline.decontamination(spark, docs.limit(0), FOLDER).count() == 0
    assert corpus_pipeline.sentencepiece(spark, docs.limit(0), FOLDER).count() == 0


def test_registered():
    assert set(queries.queries()) <= set(entry.queries())
