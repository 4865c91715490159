"""Registered queries of this subpackage, each next to the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm import (boilerplate, chat, decontaminate, jaccard, langid, lengths, licences, merkle, orchard,
                            pieces, scoring, urls, whitening)
from bazaarlens.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def op1_backoff_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.backoff_scores(table(spark, folder, "documents"))
    return rows.withColumns({c: F.round(c, 4) for c in ("log_score", "mean_log_score")})


OP1 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
 p AS (SELECT doc_id, i, w[i] AS a, CASE WHEN i >= 2 THEN w[i-1] || ' ' || w[i] END AS b,
              CASE WHEN i >= 3 THEN w[i-2] || ' ' || w[i-1] || ' ' || w[i] END AS c,
              CASE WHEN i >= 2 THEN w[i-1] END AS a1, CASE WHEN i >= 3 THEN w[i-2] || ' ' || w[i-1] END AS b1
       FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
 g AS (SELECT doc_id, a AS k, count(*) AS n FROM p GROUP BY ALL
       UNION ALL SELECT doc_id, b, count(*) FROM p WHERE b IS NOT NULL GROUP BY ALL
       UNION ALL SELECT doc_id, c, count(*) FROM p WHERE c IS NOT NULL GROUP BY ALL),
 o AS (SELECT doc_id, k, sum(n) OVER (PARTITION BY k) - n AS n FROM g),
 s AS (SELECT p.doc_id, p.i, o1.n AS n1, o2.n AS n2, o3.n AS n3, q1.n AS m1, q2.n AS m2,
              greatest((SELECT count(*) FROM p) - len(d.w), 1) AS rest
       FROM p JOIN d USING (doc_id) JOIN o o1 ON o1.doc_id = p.doc_id AND o1.k = p.a
       LEFT JOIN o o2 ON o2.doc_id = p.doc_id AND o2.k = p.b LEFT JOIN o o3 ON o3.doc_id = p.doc_id AND o3.k = p.c
       LEFT JOIN o q1 ON q1.doc_id = p.doc_id AND q1.k = p.a1 LEFT JOIN o q2 ON q2.doc_id = p.doc_id AND q2.k = p.b1),
 v AS (SELECT doc_id, CASE WHEN n3 > 0 THEN 3 WHEN n2 > 0 THEN 2 WHEN n1 > 0 THEN 1 ELSE 0 END AS level,
              CASE WHEN n3 > 0 THEN ln(n3 / m2)
                   WHEN n2 > 0 THEN ln(n2 / m1) + CASE WHEN i >= 3 THEN 1 ELSE 0 END * ln(0.4)
                   WHEN n1 > 0 THEN ln(n1 / rest) + least(i - 1, 2) * ln(0.4)
                   ELSE least(i, 3) * ln(0.4) - ln(rest) END AS x FROM s)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(sum(x), 0), 4) AS log_score,
       round(sum(x) / nullif(len(w), 0), 4) AS mean_log_score, count(*) FILTER (level = 1) AS n_1,
       count(*) FILTER (level = 2) AS n_2, count(*) FILTER (level = 3) AS n_3, count(*) FILTER (level = 0) AS n_unseen
FROM d LEFT JOIN v USING (doc_id) GROUP BY doc_id, len(w)"""


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP2 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
 b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
 win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, w[s : s + least(13, len(w)) - 1] AS ws
         FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(s) WHERE len(w) > 0),
 pos AS (SELECT doc_id, p, n, w[p : p + n - 1] AS ws FROM d, (SELECT DISTINCT n FROM win) z,
                unnest(range(1, len(w) - n + 2)) AS t(p)),
 hit AS (SELECT doc_id, p, n, item_id FROM pos JOIN win USING (n, ws)),
 word AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM hit, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
 item AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)"""


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predictions(table(spark, folder, "documents").select("doc_id", "text", "lang"))


def op4_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)],
                                "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(rows.unionByName(own))


_ESC = r"replace(replace(replace(t, '\', '\\'), '#', '\#'), '</', '<\/')"
OP4 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
 g AS (SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t) AS told,
              coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '') AS loss,
              sum(4 + CASE WHEN r IN ('user', 'assistant', 'system', 'tool') THEN length(r) ELSE
                      1 + length(replace(replace(replace(replace(r, '\', '\\'), '#', '\#'), '</', '<\/'), ':', '\:')) END
                  + 2 + length({_ESC}) + 9)::BIGINT AS formatted_chars
       FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars FROM g"""


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encoded(table(spark, folder, "documents"))


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"))


def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"))


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.fingerprints(table(spark, folder, "documents"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return lengths.length_histogram(lengths.token_counts(table(spark, folder, "documents")))


def op10_licence_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def op11_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.main_text(table(spark, folder, "pages"))


def op12_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return orchard.clusters(table(spark, folder, "embeddings"))


def _op12() -> str:
    """Ten rounds of plain k-means: all distances, and of equals the smaller number."""
    gap = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
    parts = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x
     FROM embeddings WHERE len(embedding) = 64
     AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0)""",
             """c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS c, x
     FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 8))"""]
    for r in range(11):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, x, min(struct_pack(d := d, c := c)) AS m
     FROM (SELECT v.vec_id, v.x, c.c, {gap} AS d FROM v, c{r} c) GROUP BY vec_id, x)""")
        if r < 10:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.x, o.x) AS x FROM c{r} o LEFT JOIN (
       SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY i) AS x FROM (
         SELECT m.c AS c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, unnest(range(1, 65)) AS t(i) GROUP BY ALL)
       GROUP BY c) n USING (c))""")
    return "WITH " + ",\n ".join(parts) + """
SELECT vec_id, m.c AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia,
       (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c10.x, ',')) AS centroid_sha256
FROM a10 JOIN c10 ON c10.c = m.c"""


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Query]:
    every = (op1_backoff_scores, op2_decontamination, op3_language_id, op4_chat_formatting, op5_sentencepiece,
             op6_jaccard_join, op7_url_filters, op8_fingerprints, op9_token_counts, op10_licence_scans,
             op11_html_extraction, op12_centroid_clustering, op13_embedding_whitening, pipeline)
    return {q.__name__: q for q in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_backoff_scores": OP1, "op2_decontamination": OP2, "op4_chat_formatting": OP4,
            "op12_centroid_clustering": _op12()}
