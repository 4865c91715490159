"""Attribute queries: model answers, items and precedence between sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.operators import attributes as op
from bazaarlens.plans import caption_texts as ct
from bazaarlens.plans.registry import query
from bazaarlens.sources import tables as t


def _parsed(spark, folder):
    return op.parse_model_json(ct.model_answers(spark, folder), "answer")


def _items(spark, folder):
    return op.model_items(ct.model_answers(spark, folder), "answer", ["id", "multi_flag", "missing"])


@query("parse_model_json", f"""
    WITH {ct.ANSWERS_SQL}
    SELECT a.id, a.ok, CASE WHEN a.ok THEN a.is_listing END AS is_listing,
           CASE WHEN a.ok THEN coalesce(i.n_items, 0) END AS n_items
    FROM answers a LEFT JOIN (SELECT DISTINCT id, n_items FROM items) i ON i.id = a.id""")
def parse_model_json(spark, folder):
    return _parsed(spark, folder).select("id", "ok", "is_listing", F.size("items").alias("n_items"))


@query("item_attributes", f"""
    WITH {ct.ANSWERS_SQL}
    SELECT id, item_idx, brand, model, size_label, size_eu, size_label IS NOT NULL AND size_approx AS size_approx,
           price_amount, CASE WHEN price_amount IS NOT NULL THEN 'PKR' END AS currency
    FROM attrs""")
def item_attributes(spark, folder):
    return _items(spark, folder).select(
        "id", "item_idx", "brand", "model", "size_label", F.col("size_eu").cast("double").alias("size_eu"),
        "size_approx", "price_amount", "currency")


@query("explode_items", f"""
    WITH {ct.ANSWERS_SQL}
    SELECT id, item_idx, brand, price_amount FROM attrs WHERE item_idx = 0 OR many_allowed""")
def explode_items(spark, folder):
    return op.explode_items(_items(spark, folder)).select("id", "item_idx", "brand", "price_amount")


def _evidence(spark, folder):
    """Evidence from events: a user is a listing, each event one source's reading."""
    n = F.col("event_id")
    source = F.element_at(F.array(*[F.lit(s) for s in ("vlm", "ocr", "siglip", "caption", "knn", "seed", "other")]),
                          (F.floor(n / 3) % 7 + 1).cast("int"))
    text = lambda c: c.cast("string")
    rows = t.load_table(spark, folder, "events").select(
        (F.col("user_id") * 100 + F.dayofyear("ts")).alias("listing_id"), n.alias("arrival"), source.alias("source"),
        F.when(n % 3 == 0, F.concat(F.lit("B"), text(n % 9))).alias("brand"),
        F.when(n % 4 == 0, F.concat(F.lit("M"), text(n % 9))).alias("model"),
        F.when(n % 5 == 0, F.concat(F.lit("C"), text(n % 9))).alias("colour"),
        F.when(n % 6 == 0, "men").alias("gender"), F.when(n % 7 == 0, "used").alias("condition"),
        F.when(n % 3 == 1, n % 9000).alias("price_amount"), F.when(n % 8 == 0, "PKR").alias("currency"),
        (n % 10 == 9).alias("price_on_request"), F.when(n % 3 == 2, F.concat(F.lit("EU "), text(36 + n % 10)))
        .alias("size_label"), F.when(n % 3 == 2, (36 + n % 10).cast("decimal(4,1)")).alias("size_eu"),
        (n % 2 == 0).alias("size_approx"))
    return rows.withColumns({f"{g}_source": F.col("source") for g in op.PRECEDENCE})


def _rank_sql(group: str) -> str:
    order = ", ".join(f"'{s}'" for s in op.PRECEDENCE[group])
    return f"coalesce(list_position([{order}], source), 99)"


def _best_sql(group: str, column: str, has: str) -> str:
    return f"first({column} ORDER BY {_rank_sql(group)}, arrival) FILTER ({has})"


SIMPLE = ("brand", "model", "colour", "gender", "condition")


@query("merge_attributes", f"""
    WITH ev AS (
      SELECT user_id * 100 + dayofyear(ts) AS listing_id, event_id AS arrival,
             ['vlm', 'ocr', 'siglip', 'caption', 'knn', 'seed', 'other'][event_id // 3 % 7 + 1] AS source,
             CASE WHEN event_id % 3 = 0 THEN 'B' || (event_id % 9) END AS brand,
             CASE WHEN event_id % 4 = 0 THEN 'M' || (event_id % 9) END AS model,
             CASE WHEN event_id % 5 = 0 THEN 'C' || (event_id % 9) END AS colour,
             CASE WHEN event_id % 6 = 0 THEN 'men' END AS gender, CASE WHEN event_id % 7 = 0 THEN 'used' END AS condition,
             CASE WHEN event_id % 3 = 1 THEN event_id % 9000 END AS price_amount,
             CASE WHEN event_id % 8 = 0 THEN 'PKR' END AS currency, event_id % 10 = 9 AS price_on_request,
             CASE WHEN event_id % 3 = 2 THEN 'EU ' || (36 + event_id % 10) END AS size_label
      FROM events)
    SELECT listing_id, {", ".join(f"{_best_sql(g, g, f'{g} IS NOT NULL')} AS {g}" for g in SIMPLE)},
           {", ".join(f"{_best_sql(g, 'source', f'{g} IS NOT NULL')} AS {g}_source" for g in SIMPLE)},
           {_best_sql("size", "size_label", "size_label IS NOT NULL")} AS size_label,
           {_best_sql("price", "price_amount", "price_amount IS NOT NULL OR price_on_request")} AS price_amount,
           coalesce({_best_sql("price", "currency", "price_amount IS NOT NULL OR price_on_request")},
                    first(currency ORDER BY arrival) FILTER (currency IS NOT NULL)) AS currency
    FROM ev GROUP BY listing_id""")
def merge_attributes(spark, folder):
    merged = op.merge_attributes(_evidence(spark, folder), ["listing_id"], "arrival")
    return merged.select("listing_id", *SIMPLE, *[f"{g}_source" for g in SIMPLE], "size_label", "price_amount",
                         "currency")
