"""The adapter views of `sources.tables` once more, as SQL for the oracle."""

from __future__ import annotations

VIEWS = {
    "v_messages": """
        SELECT event_id AS key, user_id % 3 AS chat, user_id AS sender, ts,
               CASE WHEN event_type = 'signup' THEN 'text' ELSE 'image' END AS kind, event_type,
               event_type = 'error' AS missing, CAST(floor(value * 100000) AS BIGINT) AS bytes, value
        FROM events""",
    "v_post_messages": """
        SELECT conv_id AS post_id, turn AS seq,
               CASE WHEN role IN ('user', 'system') THEN 'image' ELSE 'text' END AS kind,
               CASE WHEN length(text) % 3 = 0 THEN NULL ELSE substring(text, 1, 3) END AS caption,
               conv_id * 1000 + turn AS message_id, length(text) % 5 = 0 AS missing
        FROM conversations""",
    "v_listing": """
        SELECT p_partkey AS listing_id, p_partkey * 10 AS post_id, 0 AS segment_idx, p_brand AS brand, p_name AS model,
               CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DECIMAL(4,1)) END AS size_eu,
               ['caption', 'vlm', 'ocr', 'seed'][p_partkey % 4 + 1] AS size_source,
               ['caption', 'siglip', 'ocr', 'knn', 'vlm'][p_partkey % 5 + 1] AS brand_source,
               CASE WHEN p_partkey % 11 <> 0 THEN CAST(trunc(p_retailprice) AS INTEGER) END AS price,
               CASE WHEN p_partkey % 17 = 0 THEN 'USD' WHEN p_partkey % 17 < 9 THEN 'PKR' END AS currency,
               CASE WHEN p_partkey % 13 = 0 THEN 'sold' ELSE 'active' END AS status, p_partkey % 100 AS seller,
               CASE WHEN p_partkey % 5 = 0 THEN 'demo_seed' WHEN p_partkey % 5 = 1 THEN 'demo_upload'
                    ELSE 'chat_export' END AS source,
               CASE WHEN p_partkey % 5 = 1 THEN 'u' || (p_partkey % 4) END AS owner_session,
               p_partkey % 4 AS repost_count,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds(p_partkey * 7919 % 7776000) AS last_seen,
               p_partkey % (SELECT count(*) FROM embeddings) AS vec_id
        FROM part""",
    "v_listing_vec": """
        SELECT l.*, CAST(e.embedding AS DOUBLE[]) AS embedding
        FROM v_listing l JOIN embeddings e ON l.vec_id = e.vec_id""",
    "v_sighting": """
        SELECT l_partkey AS listing_id, l_orderkey AS post_id, l_linenumber AS segment_idx, l_shipdate AS seen_at,
               l_extendedprice / l_quantity AS price, CAST(l_quantity AS INTEGER) AS qty,
               CASE WHEN l_returnflag = 'A' THEN 'origin' WHEN l_returnflag = 'N' THEN 'phash'
                    ELSE 'embedding' END AS match_kind, l_suppkey AS suppkey
        FROM lineitem""",
    "v_wishlist": """
        SELECT c_custkey AS wishlist_id,
               CASE WHEN c_custkey % 5 = 0 THEN 'local' ELSE 'u' || (c_custkey % 4) END AS owner,
               CASE WHEN c_custkey % 3 <> 0 THEN 'Brand#' || (c_custkey % 25 + 1) END AS brand,
               CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 50 + 1 AS DECIMAL(4,1)) END AS size_min,
               CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 50 + 1 AS DECIMAL(4,1)) END AS size_max,
               CASE WHEN c_custkey % 6 <> 0 THEN 950 END AS max_price, CAST(0.2 AS DOUBLE) AS min_score,
               c_custkey % 10 <> 9 AS active, c_custkey % (SELECT count(*) FROM embeddings) AS vec_id
        FROM customer""",
    "v_wishlist_vec": """
        SELECT w.*, CAST(e.embedding AS DOUBLE[]) AS query_vec
        FROM v_wishlist w JOIN embeddings e ON w.vec_id = e.vec_id""",
    "v_calls": """
        SELECT event_id AS call_id, user_id AS post_id, CAST(dayofyear(ts) AS INTEGER) AS segment_idx,
               'v' || (user_id % 2) AS prompt_version, ts, CAST(ts AS DATE) AS day,
               CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'bad_json' WHEN 'purchase' THEN 'timeout'
                    WHEN 'signup' THEN 'reserved' ELSE 'http_error' END AS status,
               round(value / 1000, 6) AS cost, value, props, 'model-' || (user_id % 3) AS model
        FROM events""",
    "v_beats": """
        SELECT user_id AS source, ts, event_id AS beat_id,
               CASE event_type WHEN 'signup' THEN 'open' WHEN 'error' THEN 'logged_out' WHEN 'click' THEN 'replaced'
                    ELSE 'connecting' END AS state,
               CASE WHEN value < 5 THEN 'shutdown' END AS detail, CASE WHEN value > 50 THEN ts END AS last_message_at
        FROM events""",
    "v_image": """
        SELECT event_id AS image_id, user_id AS post_id, CAST(dayofyear(ts) AS INTEGER) AS segment_idx, event_id AS seq,
               640 AS width, 480 AS height,
               list_transform(range(event_id % 5), lambda i: {
                 'x1': CAST(floor(value) + i * 20 AS DOUBLE), 'y1': CAST(event_id % 50 + i * 10 AS DOUBLE),
                 'x2': CAST(floor(value) + i * 20 + 60 + (event_id + i) % 9 * 7 AS DOUBLE),
                 'y2': CAST(event_id % 50 + i * 10 + 40 + (event_id * 3 + i) % 7 * 5 AS DOUBLE),
                 'conf': ((event_id * 7 + i * 31) % 100) / 100.0::DOUBLE}) AS dets,
               CASE WHEN event_id % 6 = 1 THEN event_id % 10 + 36 END AS tag_size,
               CASE WHEN event_id % 5 = 2 THEN 'Brand#' || (event_id % 25 + 1) END AS tag_brand
        FROM events""",
    "v_boxed": """
        SELECT *, list_max(list_transform(dets, lambda d: d.conf)) AS best_conf, len(dets) > 2 AS multi_item,
               CASE WHEN len(b) > 0 THEN [
                 greatest(0, trunc(b[1] - (b[3] - b[1]) * 0.08)), greatest(0, trunc(b[2] - (b[4] - b[2]) * 0.08)),
                 least(width, round_even(b[3] + (b[3] - b[1]) * 0.08, 0)),
                 least(height, round_even(b[4] + (b[4] - b[2]) * 0.08, 0))] END AS box
        FROM (SELECT *, CASE
                WHEN len(dets) = 0 THEN []
                WHEN len(dets) <= 2 THEN [list_min(list_transform(dets, lambda d: d.x1)),
                  list_min(list_transform(dets, lambda d: d.y1)), list_max(list_transform(dets, lambda d: d.x2)),
                  list_max(list_transform(dets, lambda d: d.y2))]
                ELSE [dets[big].x1, dets[big].y1, dets[big].x2, dets[big].y2] END AS b
              FROM (SELECT *, list_position(areas, list_max(areas)) AS big
                    FROM (SELECT *, list_transform(dets, lambda d: (d.x2 - d.x1) * (d.y2 - d.y1)) AS areas
                          FROM v_image)))""",
    "v_text": """
        SELECT 'd' || doc_id AS id, text FROM documents
        UNION ALL SELECT 'p' || page_id, html FROM pages
        UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations""",
    "v_hash": """
        SELECT doc_id, CAST(hi AS BIGINT) * 4294967296 + CAST(lo AS BIGINT) AS unsigned_hash, hi, lo
        FROM (SELECT doc_id,
                     {hi} AS hi, {lo} AS lo
              FROM (SELECT doc_id, CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) AS h0,
                           CAST('0x' || substring(md5(w), 9, 8) AS BIGINT) AS h1
                    FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents))
              GROUP BY doc_id)""",
}


def _vote_bits(column: str) -> str:
    parts = [f"(CASE WHEN sum((({column} >> {b}) & 1) * 2 - 1) > 0 THEN {1 << b} ELSE 0 END)" for b in range(32)]
    return " + ".join(parts)


# The oracle keeps the hash as two unsigned halves: DuckDB has no wrapping shift on signed 64-bit values.
VIEWS["v_hash"] = VIEWS["v_hash"].format(hi=_vote_bits("h0"), lo=_vote_bits("h1")).replace(
    "CAST(hi AS BIGINT) * 4294967296 + CAST(lo AS BIGINT) AS unsigned_hash, hi, lo", "hi, lo")
VIEWS["v_doc_image"] = """
        SELECT h.doc_id AS post_id, h.hi, h.lo, h.doc_id AS listing_id,
               d.source AS seller
        FROM v_hash h JOIN documents d ON d.doc_id = h.doc_id"""

NEEDS = {
    "v_listing_vec": ("v_listing",),
    "v_wishlist_vec": ("v_wishlist",),
    "v_doc_image": ("v_hash",),
    "v_boxed": ("v_image",),
}


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """Prefix the SQL with the views it reads, dependencies first. SQL that starts with WITH keeps its own CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in NEEDS.get(name, ()):
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for v in views:
        add(v)
    if not ordered:
        return sql
    prefix = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in ordered)
    body = sql.strip()
    for opener in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(opener):
            return f"WITH RECURSIVE {prefix},\n{body[len(opener):]}"
    return f"WITH {prefix}\n{body}"
