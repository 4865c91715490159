"""Seller captions, buyer queries, tag lines and model answers composed from the test tables.

A text is put together from parts chosen by a row's id, so the oracle knows what a parser must find without parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.sources import tables as t

BRAND_WORDS = ("Nike", "ADIDAS", "aj1", "samba", "new balance", "plain")
BRAND_NAMES = ("Nike", "Adidas", "Jordan", "Adidas", "New Balance", None)


def _pick(n: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def caption(n: Column) -> Column:
    s = lambda c: c.cast("string")
    size = (F.when(n % 5 == 0, F.concat(F.lit("size "), s(35 + n % 14))).when(n % 5 == 1, "uk 8")
            .when(n % 5 == 2, "EUR 42.5").when(n % 5 == 3, "size 40-42"))
    price = (F.when(n % 7 == 0, F.concat(F.lit("Rs "), s(1 + n % 9), F.lit(",500")))
             .when(n % 7 == 1, F.concat(s(1000 + n % 9000), F.lit("/-")))
             .when(n % 7 == 2, F.concat(s(1 + n % 20), F.lit("k")))
             .when(n % 7 == 3, F.concat(F.lit("price "), s(2000 + n % 1000), F.lit(" final "), s(1500 + n % 400)))
             .when(n % 7 == 4, "Rs 4500 Rs 6000").when(n % 7 == 5, "DM for price"))
    condition = F.when(n % 4 == 0, "BNIB").when(n % 4 == 1, "like new").when(n % 4 == 2, "used 8/10 sold")
    return F.concat_ws(" | ", _pick(n, BRAND_WORDS), size, price, condition)


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def caption_sql(n: str, table: str, keep: str, p: str = "") -> str:
    """A SELECT with the attributes that `caption` writes, column names prefixed by `p`."""
    return f"""
    SELECT {keep}, {_sql_list(BRAND_NAMES)}[{n} % 6 + 1] AS {p}brand,
           CASE {n} % 5 WHEN 0 THEN 'EU ' || (35 + {n} % 14) WHEN 1 THEN 'UK 8' WHEN 2 THEN 'EU 42.5' END AS {p}size_label,
           CASE {n} % 5 WHEN 0 THEN 35.0 + {n} % 14 WHEN 1 THEN 8 WHEN 2 THEN 42.5 END::DOUBLE AS {p}size_value,
           CASE {n} % 5 WHEN 0 THEN 'EU' WHEN 1 THEN 'UK' WHEN 2 THEN 'EU' END AS {p}size_system,
           CASE {n} % 5 WHEN 0 THEN 35.0 + {n} % 14 WHEN 1 THEN 42 WHEN 2 THEN 42.5 END::DOUBLE AS {p}size_eu,
           {n} % 5 = 1 AS {p}size_approx, {n} % 5 = 3 AS {p}size_ambiguous,
           CASE {n} % 7 WHEN 0 THEN (1 + {n} % 9) * 1000 + 500 WHEN 1 THEN 1000 + {n} % 9000
                        WHEN 2 THEN (1 + {n} % 20) * 1000 WHEN 3 THEN 1500 + {n} % 400 END AS {p}price,
           CASE WHEN {n} % 7 = 0 THEN 'PKR' END AS {p}currency, {n} % 7 = 5 AS {p}on_request,
           {n} % 7 = 4 AS {p}price_ambiguous,
           CASE {n} % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'like_new' WHEN 2 THEN 'used' END AS {p}condition,
           CASE WHEN {n} % 4 = 2 THEN 8.0::DOUBLE END AS {p}score, {n} % 4 = 2 AS {p}is_sold
    FROM {table}"""


def seller_captions(spark, folder: str) -> DataFrame:
    orders = t.dealt(t.load_table(spark, folder, "orders").select(F.col("o_orderkey").alias("id")), "id")
    return orders.withColumn("caption", caption(F.col("id"))).withColumn("extra", caption(F.col("id") * 7 + 3))


def buyer_queries(spark, folder: str) -> DataFrame:
    n = F.col("o_orderkey")
    words = _pick(n, ("white", "red suede", None, None))
    size = F.when(n % 5 == 0, F.concat(F.lit("size "), (35 + n % 14).cast("string"))).when(n % 5 == 1, "uk 8").when(
        n % 5 == 2, "size 40-42")
    money = F.when(n % 6 == 0, F.concat(F.lit("under "), (1000 + n % 900).cast("string"))).when(
        n % 6 == 1, "below rs 4.5k").when(n % 6 == 2, "budget 3k").when(n % 6 == 3, "price 4000")
    text = F.concat_ws(" ", words, _pick(n, ("nike", "Adidas", "jordan")), F.lit("shoes"), size, money)
    return t.dealt(t.load_table(spark, folder, "orders").select("o_orderkey"), "o_orderkey").select(n.alias("id"), text.alias("q"))


BUYER_SQL = """
    SELECT o_orderkey AS id, ['Nike', 'Adidas', 'Jordan'][o_orderkey % 3 + 1] AS f_brand,
           CASE o_orderkey % 5 WHEN 0 THEN 35 + o_orderkey % 14 WHEN 1 THEN 42 END::DOUBLE AS f_size_min,
           CASE o_orderkey % 6 WHEN 0 THEN 1000 + o_orderkey % 900 WHEN 1 THEN 4500 WHEN 2 THEN 3000 WHEN 3 THEN 4000
           END AS f_max_price, ['white', 'red suede', NULL, NULL][o_orderkey % 4 + 1] AS residue,
           CASE WHEN o_orderkey % 4 < 2 THEN 0.08 ELSE -1.0 END::DOUBLE AS min_score
    FROM orders"""


def tag_lines(spark, folder: str) -> DataFrame:
    e = t.dealt(t.load_table(spark, folder, "events").select("event_id", "user_id", "ts"), "event_id")
    n = F.col("event_id")
    text = (F.when(n % 7 == 0, F.concat(F.lit("EUR "), (38 + n % 3).cast("string"))).when(n % 7 == 1, "uk 8,5")
            .when(n % 7 == 2, "US: 9").when(n % 7 == 3, "ART 123456 7 8").when(n % 7 == 4, "NIKE Air")
            .when(n % 7 == 5, "made by new").otherwise("balance"))
    return e.select((F.col("user_id") * 1000 + F.dayofyear("ts")).alias("image_id"), n.alias("line_no"),
                    text.alias("text"), (n % 10 / 10).alias("conf"))


TAG_LINES_SQL = """
    SELECT user_id * 1000 + dayofyear(ts) AS image_id, event_id AS line_no, event_id % 10 / 10.0 AS conf,
           CASE event_id % 7 WHEN 0 THEN 'EU' WHEN 1 THEN 'UK' WHEN 2 THEN 'US' END AS system,
           CASE event_id % 7 WHEN 0 THEN 38 + event_id % 3 WHEN 1 THEN 8.5 WHEN 2 THEN 9 END::DOUBLE AS value,
           ['eur', 'uk', 'us', 'art', 'nike air', 'made by new', 'balance'][event_id % 7 + 1] AS words
    FROM events"""


def model_answers(spark, folder: str) -> DataFrame:
    """Answers of an extraction model: one to three items, bare, fenced or in prose; some broken or out of schema."""
    n = F.col("o_orderkey")

    def item(k: int) -> Column:
        m = n + k
        brand = F.when(m % 6 == 5, F.lit("null")).otherwise(
            F.concat(F.lit('"'), _pick(m, ("air jordan", "NIKE", "puma king", "o'malley shoes", "Adidas")), F.lit('"')))
        size = F.when(m % 4 == 0, '{"value": 8, "system": "UK"}').when(m % 4 == 1, '{"value": 9, "system": "US"}').when(
            m % 4 == 2, '{"value": 42.5, "system": "EU"}').otherwise('{"value": null, "system": null}')
        currency = F.element_at(F.array(*[F.lit(x) for x in ('"PKR"', "null", '"EUR"', '"rs."')]),
                                (m % 4 + 1).cast("int"))
        return F.concat(
            F.lit('{"brand": '), brand, F.lit(', "model": "M'), (m % 10).cast("string"),
            F.lit('", "colour": null, "size": '), size, F.lit(', "price": {"amount": '),
            (m * 37 % 6000).cast("string"), F.lit(', "currency": '), currency,
            F.lit('}, "condition": "used", "gender": '), F.when(m % 3 == 0, '"women"').otherwise('"men"'),
            F.lit(', "image_indices": [0], "confidence": '), F.when(m % 8 == 7, "0.1").otherwise("0.9"), F.lit("}"))

    count = n % 3 + 1
    items = F.concat_ws(", ", item(0), F.when(count > 1, item(1)), F.when(count > 2, item(2)))
    doc = F.concat(F.lit('{"is_shoe_listing": '), F.when(n % 9 == 8, "false").otherwise("true"),
                   F.lit(', "items": ['), items, F.lit("]"), F.when(n % 11 == 10, ",}").otherwise("}"))
    text = (F.when(n % 4 == 0, doc).when(n % 4 == 1, F.concat(F.lit("```json\n"), doc, F.lit("\n```")))
            .when(n % 4 == 2, F.concat(F.lit("Here you go: "), doc, F.lit(" thanks")))
            .otherwise(F.when(n % 13 == 0, "no json at all").otherwise(doc)))
    multi = n % 10 < 3
    missing = F.when(n % 5 == 0, F.array().cast("array<string>")).when(n % 5 < 3, F.array(F.lit("size")))
    return t.dealt(t.load_table(spark, folder, "orders").select("o_orderkey"), "o_orderkey").select(
        n.alias("id"), text.alias("answer"), multi.alias("multi_flag"), missing.alias("missing"))


ANSWERS_SQL = """
    answers AS (
      SELECT o_orderkey AS id, o_orderkey % 3 + 1 AS n, o_orderkey % 9 <> 8 AS is_listing,
             NOT (o_orderkey % 11 = 10 OR (o_orderkey % 4 = 3 AND o_orderkey % 13 = 0)) AS ok,
             o_orderkey % 10 < 3 OR o_orderkey % 5 = 0 AS many_allowed
      FROM orders),
    raw_items AS (SELECT id, n, ok, is_listing, many_allowed, unnest(range(n)) AS k FROM answers),
    items AS (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS item_idx, count(*) OVER (PARTITION BY id) AS n_items,
             id + k AS m
      FROM raw_items WHERE (id + k) % 8 <> 7),
    attrs AS (
      SELECT id, item_idx, n_items, ok, is_listing, many_allowed,
             CASE WHEN m % 6 = 5 THEN NULL
                  ELSE ['Jordan', 'Nike', 'Puma', 'O''Malley Shoes', 'Adidas'][m % 5 + 1] END AS brand,
             'M' || (m % 10) AS model,
             CASE m % 4 WHEN 0 THEN 'UK 8' WHEN 1 THEN 'US 9' WHEN 2 THEN 'EU 42.5' END AS size_label,
             CASE m % 4 WHEN 0 THEN 42 WHEN 1 THEN CASE WHEN m % 3 = 0 THEN 40.5 ELSE 42.5 END WHEN 2 THEN 42.5
             END::DOUBLE AS size_eu,
             m % 4 < 2 AS size_approx,
             CASE WHEN m % 4 <> 2 AND m * 37 % 6000 >= 500 THEN m * 37 % 6000 END AS price_amount
      FROM items WHERE ok AND is_listing)
"""
