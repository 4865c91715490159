"""The ten corpus operators against brute force, round trips and held-out labels, on edge cases and small tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import oracle_check
from bazaarlens.llm import (chat, components, decontaminate, jaccard, langid, lengths, licences, merkle, pieces, queries,
                            scoring, urls, words)

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_words string, contaminated string"
LONG = "word " * 30_000
EDGES = [(1, None, "en", "x", "y"), (2, "", "en", "x", "y"), (3, "   ", None, "x", "y"), (4, "one", "en", "x", "y"),
         (4, "one", "en", "x", "y"), (None, "the cat sat on the mat", "en", "x", "y"), (6, LONG, "en", "x", "y"),
         (7, "a b", "en", "x", "y"), (8, "é ü", "fr", None, None)]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


def documents(spark, n=None):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", ["op1_backoff_scores", "op2_decontamination", "op4_chat_formatting"])
def test_oracles(spark, name):
    _, rows, verdict = oracle_check.compare(spark, oracle_check.oracle(FOLDER), FOLDER, name, entry.queries()[name],
                                            entry.oracle_sql()[name])
    assert verdict == "ok" and rows


@pytest.mark.parametrize("kind, pattern", [(words.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
                                           (words.NONSPACE, r"[^\x20\x09-\x0D]+")])
def test_words(kind, pattern):
    texts = [None, "", " A b", "x" * 200 + " y", "é-Ü 9", LONG[:999]]
    got = words.words(pa.array(texts), kind)
    want = [re.findall(pattern, low(t)) for t in texts]
    assert got.counts.tolist() == [len(w) for w in want]
    names = {}
    for w, h in zip((x for one in want for x in one), got.hashes.tolist()):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_edge_rows_keep_their_number(spark):
    docs, none = edges(spark), edges(spark).limit(0)
    bench = spark.createDataFrame([(1, "the cat sat"), (None, "x"), (2, None)], "item_id long, text string")
    for run in (scoring.backoff_scores, lambda d: decontaminate.contamination(d, bench), langid.predictions,
                pieces.encoded, jaccard.jaccard_components, merkle.fingerprints, lengths.token_counts, licences.scan):
        assert run(docs).count() == len(EDGES)
        assert run(none).count() == 0


def test_stages_keep_columns(spark):
    docs = edges(spark)
    bench = spark.createDataFrame([(1, "the cat sat")], "item_id long, text string")
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.where("text like 'the cat%'").count() == 0
    assert clean.count() == len(EDGES) - 1
    assert langid.drop_rejected(docs).columns == docs.columns
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 4").count() == 1


def test_blocks_of_windows_change_nothing(spark):
    docs = documents(spark)
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    whole = decontaminate.contamination(docs, bench)
    cut = decontaminate.contamination(docs, bench, block=400)
    assert whole.exceptAll(cut).count() == 0 and cut.count() == whole.count()


def brute_components(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[k: k + size]) for k in range(len(w) - size + 1)])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_jaccard_components(spark, size, percent):
    docs = documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    base = [f"w{k}" for k in range(60)]
    for j in range(40):  # a group of near copies, all different
        rows.append((10_000 + j, " ".join(base[:j] + ["other"] + base[j + 1:])))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent)
    assert {tuple(r) for r in got.collect()} == brute_components(rows, size, percent)


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (None, 4), (20, 21), (21, 22), (22, 23), (23, 24)]
    got = components.components(spark.createDataFrame(pairs, "a long, b long"))
    assert dict(map(tuple, got.collect())) == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = rows.where("lang = lang_pred").count() / rows.count()
    assert right > 0.98 and rows.where("rejected").count() <= 0.02 * rows.count()
    odd = spark.createDataFrame([(10**6, "12 !?", None), (10**6 + 1, None, None)], "doc_id long, text string, lang string")
    got = langid.predictions(docs.select("doc_id", "text", "lang").union(odd)).where("doc_id >= 1000000").collect()
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in got] == [("und", 0.0, True)] * 2


def test_reply_tree(spark):
    rows = [("t", 1, None, 0.0, "user", "q"), ("t", 2, 1, 1.0, "assistant", "bad"), ("t", 3, 1, 2.0, "assistant", r"\#</x"),
            ("t", 4, 3, 0.5, "user", None), ("t", 5, 4, 0.5, "x: y", " </turn>\n### User: "), ("t", 7, 7, 9.0, "user", "loop"),
            ("u", 1, 99, 0.0, None, "orphan")]
    tree = spark.createDataFrame(rows, "conv string, node long, parent long, score double, role string, text string")
    out = chat.format_trees(tree)
    got = {r["conv"]: r for r in out.select("conv", "formatted", chat.read_turns(out["formatted"]).alias("turns"),
                                            chat.read_learned(out["formatted"], out["mask"]).alias("loss")).collect()}
    assert [tuple(t) for t in got["t"]["turns"]] == [("user", "q"), ("assistant", r"\#</x"), ("user", ""),
                                                      ("x: y", " </turn>\n### User: ")]
    assert got["t"]["loss"] == r"\#</x" and [tuple(t) for t in got["u"]["turns"]] == [("", "orphan")]
    assert chat.format_trees(tree, best=2).count() == 3


def toy():
    spelled = [("<unk>", 0.0, pieces.UNKNOWN), ("<s>", 0.0, pieces.CONTROL)] + [
        (f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)]
    return spelled + [(p, s, pieces.NORMAL) for p, s in
                      (("▁", -2.0), ("a", -1.5), ("b", -1.7), ("ab", -2.1), ("▁ab", -3.5), ("é", -4.0), ("ba", -2.9), ("aba", -4.4))]


def brute_score(table, text):
    known = {p: s for p, s, k in table if k == pieces.NORMAL}
    least = min(known.values()) - pieces.UNKNOWN_PENALTY
    best = [0.0] + [-1e18] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            p = text[i:j]
            if p in known or j == i + 1 and text[i] not in known:
                best[j] = max(best[j], best[i] + known.get(p, least))
    return best[-1]


def test_pieces_best_score_and_round_trip():
    table = toy()
    model = pieces.Pieces.of(table)
    rng = np.random.default_rng(1)
    texts = ["", None, " a", "ab  ab", "x", "日\n本", "a" * 200] + [
        "".join(rng.choice(list("ab é\nz"), rng.integers(1, 80))) for _ in range(300)]
    ids, bounds = model.encode(texts)
    assert model.decode(ids, bounds) == [t or "" for t in texts]
    least = min(s for _, s, k in table if k == pieces.NORMAL) - pieces.UNKNOWN_PENALTY
    for t, lo, hi in zip(texts, bounds[:-1], bounds[1:]):
        got, run = 0.0, b""
        for i in ids[lo:hi]:
            if table[i][2] == pieces.BYTE:
                run += bytes([int(table[i][0][3:5], 16)])
            else:
                got += table[i][1]
        got += least * len(run.decode())
        assert not t or abs(got - brute_score(table, "▁" + t.replace(" ", "▁"))) < 1e-6


def test_urls(spark):
    link = '<link rel="canonical" href="http://blocked.com/de/1">'
    rows = [(1, "https://www.a.net/x.html?utm_source=f#t", "<p>"), (2, "http://a.net/x/", link), (3, None, None),
            (4, "nothing", ""), (5, "http://q.example.org/en/12", ""), (6, "http://EXAMPLE.org/zz", ""),
            (7, "http://c.net/1", '<meta http-equiv="refresh" content="0; url=http://b.org/2">'),
            (8, "http://c.net/1#x", link.replace("blocked", "other")), (9, "http://free.net/", "")]
    got = {r[0]: tuple(r)[1:] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("www.a.net", "/x.html", None, "block") and got[2][3] == "block"
    assert got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow")
    assert got[5][2:] == ("example.org/en/1", "block") and got[6][2:] == ("org/", "allow")
    assert got[7][3] == "allow" and got[8][3] == "allow" and got[9][3] == "allow"


def test_fingerprints(spark):
    docs = documents(spark)
    rows = sorted((tuple(r) for r in docs.select("doc_id", "text").collect()), reverse=True)
    got = {r["doc_id"]: r for r in merkle.fingerprints(docs, parts=7).collect()}
    same = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert same.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
        assert (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == (t == edited)
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
    assert len(set(same.values())) == len(same)
    assert np.mean([g["near_edited"] for g in got.values()]) > 0.4 + np.mean([g["near_next"] for g in got.values()])


def test_lengths(spark):
    counts = [0, 3, 3, 5, 2000, 2000, 7]
    hist = lengths.length_histogram(spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "doc_id long, n_tokens long"))
    for r in hist.collect():
        n = r["n_tokens"]
        assert r["n_docs"] == counts.count(n) and r["docs_at_least"] == sum(c >= n for c in counts)
        assert r["truncated_total"] == sum(min(c, n) for c in counts) and r["total_tokens"] == sum(counts)
    cut = {r["limit"]: tuple(r)[1:] for r in lengths.at_limits(hist, [4, 9999]).collect()}
    assert cut == {4: (4, 0 + 3 + 3 + 4 * 4), 9999: (0, sum(counts))}
    assert {tuple(r) for r in lengths.length_quantiles(hist, [0.5, 1.0]).collect()} == {(0.5, 5), (1.0, 2000)}


def test_licences(spark):
    docs = documents(spark)
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    texts[-1] = "x. Licensed under CC BY-NC 4.0."
    texts[-2] = "All rights reserved and, all rights reserved"
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in licences.scan(rows).collect():
        w = re.findall(licences.WORD, low(texts[r["doc_id"]]))
        at = {label: [i for i in range(len(w)) if w[i: i + len(p.split())] == p.split()] for p, label in licences.PHRASES.items()}
        every = sorted(x for v in at.values() for x in v)
        base = sorted(k for k, v in at.items() if v)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(base))
        assert set(base) <= set(r["labels"].split(",")) and (r["score"] == 1.0 or not base)
        if r["doc_id"] == -1:
            assert "cc-by-nc" in r["labels"].split(",")
