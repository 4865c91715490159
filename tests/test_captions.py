"""Caption, query, tag and model-answer parsing on typed cases; one job per table of cases."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bazaarlens.functions import captions as cap
from bazaarlens.functions import text as tx
from bazaarlens.operators import attributes as op

PRICES = [  # text, price, currency, on request, ambiguous
    ("Rs 3,200", 3200, "PKR", False, False), ("rs. 5100", 5100, "PKR", False, False),
    ("PKR7000", 7000, "PKR", False, False), ("₨ 2750", 2750, "PKR", False, False),
    ("6,400/-", 6400, None, False, False), ("5200 rs", 5200, "PKR", False, False),
    ("3.5k", 3500, None, False, False), ("14k firm", 14000, None, False, False),
    ("demand 8000", 8000, None, False, False), ("price: pkr 9000", 9000, "PKR", False, False),
    ("price 5000 final 4400", 4400, None, False, False), ("was 6000 now 5500", 5500, None, False, False),
    ("rs 1000 rs 2000", None, None, False, True), ("dm for price", None, None, True, False),
    ("Inbox please", None, None, True, False), ("Rs ۳۲۰۰", 3200, "PKR", False, False),
    ("Rs 3​200", 3200, "PKR", False, False), ("size 43", None, None, False, False),
    ("call 0311 7654321", None, None, False, False), ("", None, None, False, False),
]
SIZES = [  # text, label, system, ambiguous
    ("size 41", "EU 41", "EU", False), ("Size: 44", "EU 44", "EU", False), ("eur 43.5", "EU 43.5", "EU", False),
    ("41 eu", "EU 41", "EU", False), ("uk 9", "UK 9", "UK", False), ("UK7.5", "UK 7.5", "UK", False),
    ("sz:10 us", "US 10", "US", False), ("size 8", "8", None, False), ("26 cm insole", "CM 26", "CM", False),
    ("size 41-43", None, None, True), ("eu 41 eu 42", None, None, True), ("EUR 43 UK 9 US 10", "EU 43", "EU", False),
    ("size 8 eu 42", None, None, True), ("Rs 5200", None, None, False), ("contact 03117654321", None, None, False),
]
BRANDS = [
    ("nike vomero", "Nike"), ("AJ 3 cement", "Jordan"), ("aj11 concord", "Jordan"), ("NB574", "New Balance"),
    ("gazelle indoor", "Adidas"), ("af1 low", "Nike"), ("sk8 hi", "Vans"), ("doc martens", "Dr. Martens"),
    ("puma x nike", "Puma"), ("under armor flow", "Under Armour"), ("batao na", None), ("caravan park", None),
]
CONDITIONS = [
    ("BNIB", "new", None, False), ("like new 9/10", "like_new", 9.0, False), ("worn once", "used", None, False),
    ("8.5/10", None, 8.5, False), ("11/10", None, None, False), ("SOLD", None, None, True),
    ("soldier boots", None, None, False),
]


def parsed(spark, rows, column):
    """One column computed over the texts of a case table, in order."""
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, s string")
    got = df.withColumn("t", tx.normalise_text(F.col("s"))).select("i", column(F.col("t")).alias("x"))
    return [r.x for r in got.orderBy("i").collect()]


def test_prices(spark):
    got = parsed(spark, PRICES, cap.extract_price)
    assert [(c[0], *g) for c, g in zip(PRICES, got)] == PRICES


def test_sizes(spark):
    got = parsed(spark, SIZES, cap.extract_size)
    assert [(c[0], g.label, g.system, g.ambiguous) for c, g in zip(SIZES, got)] == SIZES


def test_brands(spark):
    assert list(zip([c[0] for c in BRANDS], parsed(spark, BRANDS, cap.extract_brand))) == BRANDS


def test_conditions(spark):
    got = parsed(spark, CONDITIONS, cap.extract_condition)
    assert [(c[0], *g) for c, g in zip(CONDITIONS, got)] == CONDITIONS


def test_size_chart(spark):
    rows = [("42.5", "EU", False, "42.5", False), ("8", "UK", False, "42.0", True), ("8.5", "US", False, "42.0", True),
            ("9", "US", True, "40.5", True), ("9", "US", False, "42.5", True), ("27", "CM", False, None, False),
            ("30", "UK", False, None, False), ("9", None, False, None, False)]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, v string, s string, w boolean")
    got = df.select("i", cap.size_to_eu(F.col("v"), F.col("s"), F.col("w")).alias("e")).orderBy("i").collect()
    assert [(None if g.e.size_eu is None else str(g.e.size_eu), g.e.approx) for g in got] == [r[3:] for r in rows]


def test_queries(spark):
    rows = [  # text, brand, size, ceiling, residue, gate
        ("nike air force size 43 under 6000", "Nike", Decimal("43.0"), 6000, "air force", 0.08),
        ("nike size 42", "Nike", Decimal("42.0"), None, None, -1.0), ("below rs 3.5k", None, None, 3500, None, -1.0),
        ("budget 4k adidas", "Adidas", None, 4000, None, -1.0), ("size 40-42 shoes", None, None, None, None, -1.0),
        ("black boots uk 8", None, Decimal("42.0"), None, "black boots", 0.08),
        ("red jordan 4", "Jordan", None, None, "red 4", 0.08), ("price 2500", None, None, 2500, None, -1.0)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, q string")
    got = op.query_filters(df, "q").orderBy("i").collect()
    assert [(g.q, g.f_brand, g.f_size_min, g.f_max_price, g.residue, g.min_score) for g in got] == rows
    explicit = op.query_filters(df, "q", size=F.lit(40), max_price=F.lit(100), brand=F.lit("Puma")).first()
    assert (explicit.f_brand, explicit.f_size_max, explicit.f_max_price) == ("Puma", Decimal("40.0"), 100)


def item(**changes):
    base = {"brand": "nike", "model": "Air", "colour": None, "size": {"value": 42, "system": "EU"},
            "price": {"amount": 4500, "currency": "PKR"}, "condition": "used", "gender": None, "image_indices": [0],
            "confidence": 0.9}
    return {**base, **changes}


def answer(*items):
    return json.dumps({"is_shoe_listing": True, "items": list(items)})


def test_model_answers(spark):
    good = answer(item())
    cases = [
        (good, True, 1), (f"```json\n{good}\n```", True, 1), (f"Sure: {good} bye", True, 1),
        (answer(*[item()] * 7), True, 6), (answer(item(confidence=0.1), item()), True, 1),
        ('{"is_shoe_listing": true}', True, 0), ('{"is_shoe_listing": true, "items": [],}', False, None),
        (answer(item(price={"amount": "many", "currency": None})), False, None),
        (answer(item(price={"amount": 10 ** 9, "currency": None})), False, None),
        (answer(item(condition="mint")), False, None), (answer(item(size=None)), False, None),
        (answer(item(price={"amount": 10.5, "currency": None})), False, None), (f"[{good}]", False, None),
        ("no answer", False, None), ("", False, None), (None, False, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, a string")
    got = op.parse_model_json(df, "a").select(
        "i", "ok", F.when(F.col("ok"), F.size("items")).alias("n"), "excerpt").orderBy("i").collect()
    assert [(g.ok, g.n) for g in got] == [c[1:] for c in cases]
    assert all((g.excerpt is None) == g.ok for g in got)


def test_item_prices(spark):
    cases = [(4500, "PKR", 4500), (4500, None, 4500), (4500, "inr", 4500), (119, "EUR", None), (300, "PKR", None),
             (13400, "JPY", None)]
    df = spark.createDataFrame([(i, answer(item(price={"amount": a, "currency": c})))
                                for i, (a, c, _) in enumerate(cases)], "i int, a string")
    got = op.model_items(df, "a", ["i"]).orderBy("i").collect()
    assert [g.price_amount for g in got] == [c[2] for c in cases]
    assert got[0].brand == "Nike" and got[0].size_label == "EU 42" and got[3].currency is None


def test_size_tags(spark):
    cases = [([("EUR 42 UK 8 US 9", .95)], "EU", Decimal("42.0"), None), ([("US 9", .9), ("UK 8.5", .9)], "UK",
             Decimal("8.5"), None), ([("EUR 42", .9), ("EUR 43", .9), ("UK 8", .9)], None, None, None),
             ([("EUR 42", .3)], None, None, None), ([("EU 42,5", .9)], "EU", Decimal("42.5"), None),
             ([("made by new", .9), ("balance", .9)], None, None, "New Balance")]
    rows = [(i, n, text, conf) for i, c in enumerate(cases) for n, (text, conf) in enumerate(c[0])]
    df = spark.createDataFrame(rows, "image int, line_no long, text string, conf double")
    got = {r.image: (r.size_system, r.size_value, r.tag_brand) for r in op.parse_size_tag(df, ["image"]).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases) if any(c[1:])}


def test_merge_precedence(spark):
    columns = ["listing", "arrival", "source", "brand", "price_amount", "currency", "size_label"]
    rows = [(1, 0, "caption", "Nike", 4500, "PKR", None), (1, 1, "vlm", "Adidas", 9999, "USD", "EU 43"),
            (2, 0, "knn", "Puma", None, "PKR", "EU 42"), (2, 1, "vlm", "Adidas", 700, None, None),
            (3, 0, "ocr", None, None, None, "EU 42"), (3, 1, "vlm", "", None, None, "EU 43")]
    df = spark.createDataFrame(rows, "listing int, arrival int, source string, brand string, price_amount long, "
                                     "currency string, size_label string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("model", "colour", "gender", "condition")})
    df = df.withColumns({"price_on_request": F.lit(False), "size_eu": F.lit(None).cast("decimal(4,1)"),
                         "size_approx": F.lit(False)}).withColumns({f"{g}_source": F.col("source") for g in op.PRECEDENCE})
    got = {r.listing: r for r in op.merge_attributes(df, ["listing"], "arrival").collect()}
    assert len(columns) == 7
    assert (got[1].brand, got[1].price_amount, got[1].currency, got[1].size_label) == ("Nike", 4500, "PKR", "EU 43")
    assert (got[2].brand, got[2].brand_source, got[2].price_amount, got[2].currency) == ("Adidas", "vlm", 700, "PKR")
    assert (got[3].brand, got[3].size_label, got[3].size_source) == (None, "EU 42", "ocr")


@pytest.mark.parametrize("text,masked", [("call 03001234567 now", "call 03********* now"), ("1234567 and 12345678901",
                                         "12***** and 12*********"), ("123456", "123456")])
def test_mask(spark, text, masked):
    assert spark.range(1).select(tx.mask_digits(F.lit(text)).alias("m")).first().m == masked
