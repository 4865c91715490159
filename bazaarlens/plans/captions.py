"""Caption queries: normalisation and the attributes of seller captions, buyer queries and size tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.functions import captions as cap
from bazaarlens.functions import text as tx
from bazaarlens.operators import attributes as op
from bazaarlens.plans import caption_texts as ct
from bazaarlens.plans.registry import query
from bazaarlens.sources import tables as t

SELLER_SQL = ct.caption_sql("o_orderkey", "orders", "o_orderkey AS id")


@query("normalise_text", r"""
    SELECT id, md5(lower(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')))) AS clean_md5 FROM v_text
    """, ("v_text",))
def normalise_text(spark, folder):
    return t.texts(spark, folder).select("id", F.md5(tx.normalise_text(F.col("text"))).alias("clean_md5"))


def _clean(spark, folder):
    return ct.seller_captions(spark, folder).withColumn("t", tx.normalise_text(F.col("caption")))


@query("extract_price", f"SELECT id, price, currency, on_request, price_ambiguous AS ambiguous FROM ({SELLER_SQL})")
def extract_price(spark, folder):
    return _clean(spark, folder).select("id", cap.extract_price(F.col("t")).alias("p")).select("id", "p.*")


@query("extract_size", f"""
    SELECT id, size_label AS label, size_value AS value, size_system AS system, size_ambiguous AS ambiguous
    FROM ({SELLER_SQL})""")
def extract_size(spark, folder):
    rows = _clean(spark, folder).select("id", cap.extract_size(F.col("t")).alias("s")).select("id", "s.*")
    return rows.withColumn("value", F.col("value").cast("double"))


@query("extract_brand", f"SELECT id, brand FROM ({SELLER_SQL})")
def extract_brand(spark, folder):
    return _clean(spark, folder).select("id", cap.extract_brand(F.col("t")).alias("brand"))


@query("extract_condition", f"SELECT id, condition, score, is_sold FROM ({SELLER_SQL})")
def extract_condition(spark, folder):
    return _clean(spark, folder).select("id", cap.extract_condition(F.col("t")).alias("c")).select("id", "c.*")


UK_ROWS = ", ".join(f"({uk}, {eu})" for uk, eu in cap.UK_TO_EU.items())


@query("size_to_eu", f"""
    SELECT r.id, CAST(CASE WHEN system = 'EU' THEN value ELSE c.eu END AS DOUBLE) AS size_eu, c.eu IS NOT NULL AS approx
    FROM (SELECT *, CASE WHEN system IN ('UK', 'US') THEN value - CASE WHEN system = 'US' THEN
                 CASE WHEN women THEN 2 ELSE 0.5 END ELSE 0 END END AS uk
          FROM (SELECT o_orderkey AS id, CAST(o_orderkey % 35 / 2.0 + 1 AS DECIMAL(4,1)) AS value,
                       ['EU', 'UK', 'US', 'CM', NULL][o_orderkey // 35 % 5 + 1] AS system, o_orderkey % 2 = 0 AS women
                FROM orders)) r
    LEFT JOIN (VALUES {UK_ROWS}) c(uk, eu) ON c.uk = r.uk""")
def size_to_eu(spark, folder):
    n = F.col("o_orderkey")
    system = F.element_at(F.array(*[F.lit(s) for s in ("EU", "UK", "US", "CM", None)]),
                          (F.floor(n / 35) % 5 + 1).cast("int"))
    eu = cap.size_to_eu(n % 35 / 2 + 1, system, n % 2 == 0)
    rows = t.load_table(spark, folder, "orders").select(n.alias("id"), eu.alias("e"))
    return rows.select("id", F.col("e.size_eu").cast("double").alias("size_eu"), "e.approx")


@query("parse_size_tag", f"""
    WITH lines AS (SELECT * FROM ({ct.TAG_LINES_SQL}) WHERE conf >= 0.6),
    sizes AS (
      SELECT image_id, system, CASE WHEN lo = hi THEN lo END AS value
      FROM (SELECT image_id, system, min(value) AS lo, max(value) AS hi,
                   row_number() OVER (PARTITION BY image_id ORDER BY list_position(['EU', 'UK', 'US'], system)) AS rn
            FROM lines WHERE system IS NOT NULL GROUP BY image_id, system) WHERE rn = 1),
    joined AS (SELECT image_id, string_agg(words, ' ' ORDER BY line_no) AS words FROM lines GROUP BY image_id),
    brands AS (SELECT image_id, CASE
        WHEN strpos(words, 'nike') > 0 AND (strpos(words, 'new balance') = 0
             OR strpos(words, 'nike') < strpos(words, 'new balance')) THEN 'Nike'
        WHEN strpos(words, 'new balance') > 0 THEN 'New Balance' END AS tag_brand FROM joined)
    SELECT b.image_id, CASE WHEN value IS NOT NULL THEN system END AS size_system, value AS size_value, tag_brand
    FROM brands b LEFT JOIN sizes s ON s.image_id = b.image_id
    WHERE value IS NOT NULL OR tag_brand IS NOT NULL""")
def parse_size_tag(spark, folder):
    tags = op.parse_size_tag(ct.tag_lines(spark, folder), ["image_id"])
    return tags.withColumn("size_value", F.col("size_value").cast("double"))


E_SQL = ct.caption_sql("(o_orderkey * 7 + 3)", "orders", "o_orderkey AS e_id", "e_")


@query("caption_fallback", f"""
    SELECT id, coalesce(brand, e_brand) AS brand, coalesce(condition, e_condition) AS condition,
           CASE WHEN own_size THEN size_label ELSE e_size_label END AS size_label,
           CASE WHEN own_size THEN size_eu ELSE e_size_eu END AS size_eu,
           CASE WHEN own_price THEN price ELSE e_price END AS price_amount,
           CASE WHEN (CASE WHEN own_price THEN price ELSE e_price END) IS NOT NULL THEN
             coalesce(CASE WHEN own_price THEN currency ELSE e_currency END, 'PKR') END AS currency,
           CASE WHEN own_price THEN on_request ELSE e_on_request END AS price_on_request,
           (CASE WHEN own_price THEN price_ambiguous ELSE e_price_ambiguous END)
           OR (CASE WHEN own_size THEN size_ambiguous ELSE e_size_ambiguous END) AS ambiguous
    FROM (SELECT *, price IS NOT NULL OR on_request OR price_ambiguous AS own_price,
                 size_label IS NOT NULL OR size_ambiguous AS own_size
          FROM ({SELLER_SQL}) a JOIN ({E_SQL}) b ON a.id = b.e_id)""")
def caption_fallback(spark, folder):
    rows = op.caption_attributes(ct.seller_captions(spark, folder), "caption", "c")
    rows = op.caption_fallback(op.caption_attributes(rows, "extra", "e"), "c", "e", default_currency="PKR")
    return rows.select("id", "brand", "condition", "size_label", F.col("size_eu").cast("double").alias("size_eu"),
                       "price_amount", "currency", "price_on_request", "ambiguous")


@query("query_filters", f"SELECT id, f_brand, f_size_min, f_size_min AS f_size_max, f_max_price FROM ({ct.BUYER_SQL})")
def query_filters(spark, folder):
    rows = op.query_filters(ct.buyer_queries(spark, folder), "q")
    return rows.select("id", "f_brand", F.col("f_size_min").cast("double").alias("f_size_min"),
                       F.col("f_size_max").cast("double").alias("f_size_max"), "f_max_price")


@query("semantic_residue", f"SELECT id, residue FROM ({ct.BUYER_SQL})")
def semantic_residue(spark, folder):
    clean = ct.buyer_queries(spark, folder).withColumn("t", tx.normalise_text(F.col("q")))
    return clean.select("id", cap.semantic_residue(F.col("t")).alias("residue"))


@query("filters_only_gate", f"SELECT id, min_score FROM ({ct.BUYER_SQL})")
def filters_only_gate(spark, folder):
    return op.query_filters(ct.buyer_queries(spark, folder), "q").select("id", "min_score")
