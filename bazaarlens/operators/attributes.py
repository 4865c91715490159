"""Attributes of listings: from captions, buyer queries, size tags and model answers; precedence between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import captions as cap
from bazaarlens.functions import text as tx
from bazaarlens.operators import chunked

# Which source wins for each attribute group, best first.
PRECEDENCE = {
    "price": ("caption", "seed", "vlm"),
    "size": ("caption", "seed", "ocr", "vlm"),
    "brand": ("caption", "seed", "ocr", "vlm", "siglip", "knn"),
    "model": ("seed", "vlm", "caption"),
    "colour": ("seed", "vlm", "caption"),
    "gender": ("seed", "vlm", "caption"),
    "condition": ("caption", "seed", "vlm"),
}
GROUP_COLUMNS = {
    "price": ("price_amount", "price_on_request"),
    "size": ("size_label", "size_eu", "size_approx"),
    "brand": ("brand",), "model": ("model",), "colour": ("colour",), "gender": ("gender",),
    "condition": ("condition",),
}

# Model answers and size tags.
MAX_ITEMS, MIN_CONFIDENCE, MAX_PRICE, MIN_PRICE = 6, 0.3, 10_000_000, 500
RUPEE_NAMES = ("PKR", "INR", "RS", "RS.", "RUPEES", "RUPEE")
ITEM_SYSTEMS = ("EU", "UK", "US", "CM")
CONDITIONS = ("new", "like_new", "used")
GENDERS = ("men", "women", "unisex", "kids")
EXCERPT = 2048
MIN_LINE_CONF = 0.6
TAG_SYSTEMS = ("EU", "UK", "US", "CM", "JP")
SIZE_TAG = r"\b(EUR?|UK|US|CM|JP)\s*[:.]?\s*(\d{1,2}(?:[.,]5)?)\b"
FILTERS_ONLY_MIN_SCORE = -1.0


def caption_attributes(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds the structs `<out>_price`, `<out>_size`, `<out>_condition` and the string `<out>_brand`, read from a text
    column; null text reads as an empty caption."""
    t = F.col("_t")
    staged = df.withColumn("_t", tx.normalise_text(F.coalesce(F.col(text_col), F.lit(""))))
    return staged.withColumns({
        f"{out}_price": cap.extract_price(t), f"{out}_size": cap.extract_size(t), f"{out}_brand": cap.extract_brand(t),
        f"{out}_condition": tx.let(t, cap.extract_condition)}).drop("_t")


def caption_fallback(df: DataFrame, caption: str, extra: str, default_currency: str | None = None) -> DataFrame:
    """Attributes of a segment from its own caption, group by group, else from the post's extra text. Evidence counts
    even when ambiguous: an ambiguous price in the caption is not replaced by one from elsewhere.

    Adds brand, condition, size_label, size_eu, size_approx, price_amount, currency, price_on_request, sources MAP and
    ambiguous. `caption` and `extra` are prefixes given to `caption_attributes`."""
    p, s = F.col(f"{caption}_price"), F.col(f"{caption}_size")
    price = F.when(p["price"].isNotNull() | p["on_request"] | p["ambiguous"], p).otherwise(F.col(f"{extra}_price"))
    size = F.when(s["value"].isNotNull() | s["label"].isNotNull() | s["ambiguous"], s).otherwise(
        F.col(f"{extra}_size"))
    staged = df.withColumn("_p", price).withColumn("_s", size)
    staged = staged.withColumn("_eu", cap.size_to_eu(F.col("_s.value"), F.col("_s.system")))
    amount = F.col("_p.price")
    currency = F.coalesce(F.col("_p.currency"), F.lit(default_currency or None).cast("string"))
    out = (staged
           .withColumn("brand", F.coalesce(F.col(f"{caption}_brand"), F.col(f"{extra}_brand")))
           .withColumn("condition", F.coalesce(F.col(f"{caption}_condition.condition"),
                                               F.col(f"{extra}_condition.condition")))
           .withColumn("size_label", F.col("_s.label"))
           .withColumn("size_eu", F.col("_eu.size_eu")).withColumn("size_approx", F.col("_eu.approx"))
           .withColumn("price_amount", amount).withColumn("currency", F.when(amount.isNotNull(), currency))
           .withColumn("price_on_request", F.col("_p.on_request"))
           .withColumn("ambiguous", F.col("_p.ambiguous") | F.col("_s.ambiguous")))
    has = {"brand": F.col("brand").isNotNull(), "size": F.col("size_label").isNotNull(),
           "price": F.col("price_amount").isNotNull() | F.col("price_on_request"),
           "condition": F.col("condition").isNotNull()}
    entries = F.array_compact(F.array(*[F.when(h, F.struct(F.lit(g), F.lit("caption"))) for g, h in has.items()]))
    return out.withColumn("sources", F.map_from_entries(entries)).drop("_p", "_s", "_eu")


def query_filters(df: DataFrame, text_col: str, *, size: Column | None = None, max_price: Column | None = None,
                  brand: Column | None = None, default_min_score: float = 0.08) -> DataFrame:
    """Buyer text to filters: adds f_brand, f_size_min, f_size_max, f_max_price, residue and min_score. Explicit values
    win over the text; a budget wins over a price; a query without descriptive words has its score gate off."""
    clean = tx.normalise_text(F.coalesce(F.col(text_col), F.lit("")))
    staged = df.withColumn("_t", clean)
    t = F.col("_t")
    staged = (staged.withColumn("_price", cap.extract_price(t)).withColumn("_size", cap.extract_size(t)))
    read = cap.size_to_eu(F.col("_size.value"), F.coalesce(F.col("_size.system"), F.lit("EU")))["size_eu"]
    eu = read if size is None else F.coalesce(size.cast("decimal(4,1)"), read)
    asked = F.coalesce(*([max_price.cast("long")] if max_price is not None else []), cap.budget(t),
                       F.col("_price.price"))
    name = cap.extract_brand(t) if brand is None else F.coalesce(brand, cap.extract_brand(t))
    residue = cap.semantic_residue(t)
    return (staged.withColumn("f_brand", name).withColumn("f_size_min", eu).withColumn("f_size_max", eu)
            .withColumn("f_max_price", asked).withColumn("residue", residue)
            .withColumn("min_score", filters_only_gate(residue, F.lit(default_min_score)))
            .drop("_t", "_price", "_size"))


def filters_only_gate(residue: Column, default: Column) -> Column:
    return F.when(residue.isNull(), F.lit(FILTERS_ONLY_MIN_SCORE)).otherwise(default)


def parse_size_tag(lines: DataFrame, image: list[str], min_conf: float = MIN_LINE_CONF) -> DataFrame:
    """Size and brand per photo from its recognised lines. Expects line_no, text, conf.

    The preferred system present decides; two values in it give no size. Distinctness is min = max, so a photo's
    readings combine in the partial aggregate."""
    good = lines.where(F.col("conf") >= min_conf)
    upper = F.upper("text")
    found = F.arrays_zip(F.regexp_extract_all(upper, F.lit(tx.U + SIZE_TAG), F.lit(1)).alias("system"),
                         F.regexp_extract_all(upper, F.lit(tx.U + SIZE_TAG), F.lit(2)).alias("value"))
    hits = good.select(*image, F.explode(found).alias("h")).select(
        *image, F.when(F.col("h.system").startswith("EU"), "EU").otherwise(F.col("h.system")).alias("system"),
        F.replace(F.col("h.value"), F.lit(","), F.lit(".")).cast("decimal(4,1)").alias("value"))
    order = F.array_position(F.array(*[F.lit(s) for s in TAG_SYSTEMS]), F.col("system"))
    sizes = (hits.groupBy(*image, "system").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
             .groupBy(*image).agg(F.min_by(F.struct("system", "lo", "hi"), order).alias("p"))
             .where("p.lo = p.hi").select(*image, F.col("p.system").alias("size_system"),
                                          F.col("p.lo").alias("size_value")))
    return sizes.join(_line_brands(good, image), image, "full_outer")


def _line_brands(good: DataFrame, image: list[str]) -> DataFrame:
    """The first brand of a photo's lines read as one text. A name may run over a line end, so each line is read
    together with the one before; the first line with a match decides."""
    clean = good.withColumn("_t", tx.normalise_text(F.col("text")))
    line = chunked.Line(image, [F.col("line_no")], chunked.by_rows(F.col("line_no")))
    paired = chunked.previous(clean, line, F.col("_t"), "_before")
    named = paired.withColumn("_b", cap.alias_brand(F.concat_ws(" ", "_before", "_t"))).where(F.col("_b").isNotNull())
    return named.groupBy(*image).agg(F.min_by("_b", "line_no").alias("tag_brand"))


def _text_or_null(v: Column, path: str) -> tuple[Column, Column]:
    """(value, bad) of an optional string field."""
    kind = F.schema_of_variant(F.variant_get(v, path, "variant"))
    return (F.try_variant_get(v, path, "string"), F.coalesce(~kind.isin("STRING", "VOID"), F.lit(False)))


def _number_or_null(v: Column, path: str) -> tuple[Column, Column]:
    kind = F.schema_of_variant(F.variant_get(v, path, "variant"))
    value = F.try_variant_get(v, path, "double")
    return value, F.coalesce((kind != "VOID") & value.isNull(), F.lit(False))


def _object_or_absent(v: Column, path: str) -> Column:
    """Bad when the field is there and not an object."""
    return F.coalesce(~F.schema_of_variant(F.variant_get(v, path, "variant")).startswith("OBJECT"), F.lit(False))


def _model_item(v: Column) -> Column:
    """One raw item as STRUCT<item, bad>."""
    texts = {f: _text_or_null(v, f"$.{f}") for f in ("brand", "model", "colour", "condition", "gender")}
    system, system_bad = _text_or_null(v, "$.size.system")
    currency, currency_bad = _text_or_null(v, "$.price.currency")
    size, size_bad = _number_or_null(v, "$.size.value")
    amount, amount_bad = _number_or_null(v, "$.price.amount")
    confidence, confidence_bad = _number_or_null(v, "$.confidence")
    indices = F.variant_get(v, "$.image_indices", "variant")
    bad = (~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
           | _object_or_absent(v, "$.size") | _object_or_absent(v, "$.price") | system_bad | currency_bad | size_bad
           | amount_bad | confidence_bad
           | F.coalesce(F.is_variant_null(F.variant_get(v, "$.confidence", "variant")), F.lit(False))
           | F.coalesce(~F.schema_of_variant(indices).startswith("ARRAY"), F.lit(False))
           | (indices.isNotNull() & F.try_variant_get(v, "$.image_indices", "array<double>").isNull())
           | F.coalesce(~system.isin(*ITEM_SYSTEMS), F.lit(False))
           | F.coalesce(~texts["condition"][0].isin(*CONDITIONS), F.lit(False))
           | F.coalesce(~texts["gender"][0].isin(*GENDERS), F.lit(False))
           | F.coalesce((amount != F.floor(amount)) | ~amount.between(0, MAX_PRICE), F.lit(False)))
    for _, wrong in texts.values():
        bad = bad | wrong
    positive = F.coalesce(size > 0, F.lit(True))
    return F.struct(F.struct(
        *[value.alias(f) for f, (value, _) in texts.items()],
        F.when(positive, size).cast("decimal(6,1)").alias("size_value"), F.when(positive, system).alias("size_system"),
        amount.cast("long").alias("price_amount"), currency.alias("price_currency"),
        F.coalesce(confidence, F.lit(0.0)).alias("confidence")).alias("item"), bad.alias("bad"))


def parse_model_json(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ok, is_listing, items and, for a refused answer, excerpt.

    Code fences are stripped; the whole text is tried, else its first object. One bad field refuses the answer. The
    first six items are kept, then those of low confidence leave."""
    raw = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), tx.U + r"^\s+|\s+$", "")

    def document(body: Column) -> Column:
        start = F.instr(body, "{")
        first = F.when(start > 0, F.try_parse_json(F.substring(body, start, F.length(body))))
        return tx.let(F.try_parse_json(body), lambda whole: tx.let(F.schema_of_variant(whole), lambda kind: (
            F.when(F.coalesce(kind.startswith("OBJECT"), F.lit(False)), whole)
            .when(~F.coalesce(kind.startswith("ARRAY"), F.lit(False)), first))))

    def checked(doc: Column) -> Column:
        items = F.variant_get(doc, "$.items", "variant")
        listed = F.try_variant_get(doc, "$.items", "array<variant>")
        read = F.transform(F.coalesce(listed, F.array().cast("array<variant>")), lambda v: tx.let(v, _model_item))
        sound = (doc.isNotNull() & (items.isNull() | listed.isNotNull())
                 & ~F.coalesce(F.is_variant_null(items), F.lit(False)))
        flag = F.try_variant_get(doc, "$.is_shoe_listing", "boolean")
        return tx.let(F.struct(read.alias("items"), sound.alias("sound"), flag.alias("flag")), judged)

    def judged(c: Column) -> Column:
        ok = F.coalesce(c["sound"] & c["flag"].isNotNull() & ~F.exists(c["items"], lambda i: i["bad"]), F.lit(False))
        kept = F.filter(F.transform(F.slice(c["items"], 1, MAX_ITEMS), lambda i: i["item"]),
                        lambda i: i["confidence"] >= MIN_CONFIDENCE)
        return F.struct(ok.alias("ok"), F.when(ok, c["flag"]).alias("is_listing"), F.when(ok, kept).alias("items"))

    body = F.regexp_replace(raw, r"^```(?:json)?\s*|\s*```$", "")
    staged = df.withColumn("_a", tx.let(tx.let(body, document), checked))
    return staged.select("*", "_a.*", F.when(~F.col("_a.ok"), F.substring(raw, 1, EXCERPT)).alias("excerpt")).drop("_a")


def model_items(answers: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """One row per kept item of a good answer that is a listing: its position and its listing attributes.

    The outer explode keeps the optimizer from testing the parsed array a second time below it."""
    parsed = parse_model_json(answers, text_col)
    shown = F.when(F.col("ok") & F.col("is_listing"), F.col("items"))
    rows = (parsed.select(*keep, shown.alias("_items"))
            .select(*keep, F.size("_items").alias("n_items"), F.posexplode_outer("_items").alias("item_idx", "item"))
            .where(F.col("item_idx").isNotNull()))
    rows = rows.withColumn("_b", tx.normalise_text(F.coalesce(F.col("item.brand"), F.lit(""))))
    return item_attributes(rows.withColumn("brand", cap.normalise_brand(F.col("item.brand"), F.col("_b"))).drop("_b"))


def item_attributes(rows: DataFrame) -> DataFrame:
    """Listing attributes of `item`: the size by chart, the price only in rupees and only if plausible."""
    i = F.col("item")
    rows = rows.withColumn("_eu", cap.size_to_eu(i["size_value"], i["size_system"], i["gender"] == "women"))
    eu = F.col("_eu")
    sized = i["size_value"].isNotNull() & (F.coalesce(i["size_system"], F.lit("")) != "")
    name = F.upper(F.trim(F.coalesce(i["price_currency"], F.lit(""))))
    price = F.when((name.isin(*RUPEE_NAMES) | (name == "")) & (i["price_amount"] >= MIN_PRICE), i["price_amount"])
    return (rows.withColumn("model", i["model"]).withColumn("colour", i["colour"])
            .withColumn("condition", i["condition"]).withColumn("gender", i["gender"])
            .withColumn("size_label", F.when(sized, cap.size_label(i["size_system"], i["size_value"])))
            .withColumn("size_eu", F.when(sized, eu["size_eu"]))
            .withColumn("size_approx", sized & eu["approx"])
            .withColumn("price_amount", price).withColumn("currency", F.when(price.isNotNull(), "PKR")).drop("item", "_eu"))


def explode_items(items: DataFrame) -> DataFrame:
    """The first item updates its segment's listing; further items become listings only where a photo shows several
    objects or several items were all that was asked for. Expects item_idx, n_items, multi_flag, missing ARRAY."""
    asked = F.coalesce(F.col("missing").isNotNull() & (F.size("missing") == 0), F.lit(False))
    return items.where((F.col("item_idx") == 0) | F.coalesce(F.col("multi_flag"), F.lit(False)) | asked)


def source_rank(group: str, source: Column) -> Column:
    order = PRECEDENCE[group]
    at = F.array_position(F.array(*[F.lit(s) for s in order]), source)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(order)))


def present(group: str) -> Column:
    if group == "price":
        return F.col("price_amount").isNotNull() | F.coalesce(F.col("price_on_request"), F.lit(False))
    if group == "size":
        return F.col("size_label").isNotNull()
    return F.coalesce(F.col(group), F.lit("")) != ""


def merge_attributes(evidence: DataFrame, listing: list[str], arrival: str) -> DataFrame:
    """One row per listing from any number of evidence rows: per attribute group the best-ranked source that has a
    value wins, the earlier one on a tie. A missing value never overwrites; a winning price without a currency takes
    the first known one. Expects the listing columns and, per group, a `<group>_source`."""
    best = []
    for group, cols in GROUP_COLUMNS.items():
        source = F.col(f"{group}_source")
        place = F.when(present(group), F.struct(source_rank(group, source), F.col(arrival)))
        extra = [F.col("currency")] if group == "price" else []
        payload = F.struct(*[F.col(c) for c in cols], *extra, source.alias("source"))
        best.append(F.min_by(payload, place).alias(f"_{group}"))
    best.append(F.min_by("currency", F.when(F.coalesce(F.col("currency"), F.lit("")) != "", F.col(arrival)))
                .alias("_currency"))
    merged = evidence.groupBy(*listing).agg(*best)
    out = [F.col(f"_{g}.{c}").alias(c) for g, cols in GROUP_COLUMNS.items() for c in cols]
    out += [F.col(f"_{g}.source").alias(f"{g}_source") for g in GROUP_COLUMNS]
    currency = F.coalesce(F.when(F.col("_price.currency") != "", F.col("_price.currency")), F.col("_currency"))
    return merged.select(*listing, *out, currency.alias("currency"))
