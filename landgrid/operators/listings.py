"""Market listings: three kinds of pages, one schema, comparison of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgrid.functions.text import digits, extract
from landgrid.operators.objects import first_of

# Patterns of listing titles and cards.
RUB = "₽"
TITLE = r"(?Ui)^(?:(\d+|студия)-?к\.\s*квартира|студия)(?:[,\s]+([\d.,]+)\s*м[²2])?(?:[,\s]+(\d+)/(\d+)\s*эт\.)?"
CARD = r'(?s)data-test="OffersSerpItem"(.*?)(?=data-test="OffersSerpItem"|</body>|<footer)'
CARD_PER_M2 = r"(?U)(\d[\d\s ]+)\s*" + RUB + r"\s*за\s*м[²2]"
CARD_PRICE = r"(?U)(\d[\d\s ]{4,})\s*" + RUB + r"(?!\s*за)"
CARD_AREA = r"(?U)(\d+(?:[.,]\d+)?)\s*м[²2]"
CARD_ROOMS = r"(?Ui)(\d+-комнатная\s*квартира|студия)"
CARD_FLOOR = r"(?U)(\d+)\s*этаж\s*из\s*(\d+)|(\d+)\s*из\s*(\d+)\s*эт"
CARD_LINK = r'href="(/offer/\d+/?[^"]*)"'

LISTING = "listing_id string, source string, city string, price_rub double, total_area_m2 double, rooms_str string, floor double, floors_count double, rooms_count bigint, build_year bigint, material_type string, lat double, lon double, url string, page_file string"
OFFER = "array<struct<id: string, formattedFullPrice: string, fullUrl: string, roomsCount: bigint, totalArea: string, totalAreaM2: string, floorNumber: double, building: struct<buildYear: bigint, floorsCount: double, materialType: string>, geo: struct<coordinates: struct<lat: double, lng: double>>>>"
LD = "offers struct<`@type`: string, offers: array<struct<name: string, url: string, price: string>>>, `@type`: string"


def number(c):
    """Text with spaces and a decimal comma as a number; null if it isn't one."""
    return F.translate(F.regexp_replace(c.cast("string"), "[  ]", ""), ",", ".").try_cast("double")


def _shaped(df: DataFrame, source: str) -> DataFrame:
    fields = [f.strip().rsplit(" ", 1) for f in LISTING.split(",")]
    df = df.withColumn("source", F.lit(source))
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def from_embedded_json(pages: DataFrame) -> DataFrame:
    """Offers of pages (page_file, city, html) that embed an array "offers":[...]; the text after it is left to the parser, which reads the
    array and stops at its end. Pages without one, or with a broken one, give nothing."""
    tail = F.when(F.col("html").contains('"offers":['), F.expr("substring(html, instr(html, '\"offers\":[') + 9)"))
    o = pages.select("page_file", "city", F.explode(F.from_json(tail, OFFER)).alias("o")).where("o is not null")
    return _shaped(o.select("page_file", "city", F.col("o.id").alias("listing_id"), digits(F.col("o.formattedFullPrice")).alias("price_rub"), number(F.coalesce("o.totalArea", "o.totalAreaM2")).alias("total_area_m2"), F.col("o.floorNumber").alias("floor"), F.col("o.building.floorsCount").alias("floors_count"), F.col("o.roomsCount").alias("rooms_count"), F.col("o.building.buildYear").alias("build_year"), F.col("o.building.materialType").alias("material_type"), F.col("o.geo.coordinates.lat").alias("lat"), F.col("o.geo.coordinates.lng").alias("lon"), F.col("o.fullUrl").alias("url")), "cian")


def from_linked_data(pages: DataFrame) -> DataFrame:
    """Offers of the Products in all ld+json scripts of pages, at the top or within a @graph."""
    scripts = pages.select("page_file", "city", F.explode(F.regexp_extract_all("html", F.lit(r'(?s)<script[^>]+type="application/ld\+json"[^>]*>(.+?)</script>'), F.lit(1))).alias("j"))
    items = scripts.select("page_file", "city", F.from_json("j", f"`@graph` array<struct<{LD.replace('offers struct', 'offers: struct', 1).replace(', `@type` string', ', `@type`: string').replace(', `@type`: string', ', `@type`: string')}>>").getField("@graph").alias("graph"), F.from_json("j", LD.replace(", `@type`: string", ", `@type` string")).alias("top"))
    item = F.explode(F.coalesce("graph", F.array("top")))
    offers = items.select("page_file", "city", item.alias("p")).where("p.`@type` = 'Product' and p.offers.`@type` = 'AggregateOffer'").select("page_file", "city", F.explode("p.offers.offers").alias("o"))
    t = F.col("o.name")
    return _shaped(offers.select("page_file", "city", extract(F.col("o.url"), r"_(\d+)(?:[/?#]|$)").alias("listing_id"), number(F.col("o.price")).alias("price_rub"), number(extract(t, TITLE, 2)).alias("total_area_m2"), extract(t, TITLE, 1).alias("rooms_str"), extract(t, TITLE, 3).alias("floor"), extract(t, TITLE, 4).alias("floors_count"), F.col("o.url").alias("url")), "avito")


def from_cards(pages: DataFrame) -> DataFrame:
    """Offers of pages whose cards are plain markup, by patterns over each card's text."""
    cards = pages.select("page_file", "city", F.explode(F.regexp_extract_all("html", F.lit(CARD), F.lit(1))).alias("card"))
    text = F.regexp_replace("card", "<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&#8381;", RUB), ("&sup2;", "²"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    c = cards.withColumn("t", F.trim(F.regexp_replace(text, "[ \t]+", " ")))
    t = F.col("t")
    c = c.select("page_file", "city", extract(F.col("card"), CARD_LINK).alias("href"), digits(extract(t, CARD_PRICE)).alias("price_rub"), number(extract(t, CARD_AREA)).alias("total_area_m2"), extract(t, CARD_ROOMS).alias("rooms_str"), F.coalesce(extract(t, CARD_FLOOR, 1), extract(t, CARD_FLOOR, 3)).alias("floor"), F.coalesce(extract(t, CARD_FLOOR, 2), extract(t, CARD_FLOOR, 4)).alias("floors_count"))
    return _shaped(c.withColumns({"listing_id": extract(F.col("href"), r"/offer/(\d+)"), "url": F.col("href")}), "yandex_realty")


def unified(*sources: DataFrame) -> DataFrame:
    """One row a listing of each source (the first by page), with rooms, price a square metre and the floor as a share."""
    both = sources[0]
    for s in sources[1:]:
        both = both.unionByName(s)
    known, unknown = both.where("listing_id is not null"), both.where("listing_id is null")
    rows = first_of(known, ["source", "listing_id"], [F.col("page_file")]).unionByName(first_of(unknown, ["source", "url"], [F.col("page_file")]))
    rooms = F.coalesce("rooms_count", F.when(F.lower("rooms_str").contains("студ"), F.lit(0).cast("bigint")).otherwise(extract(F.col("rooms_str"), r"(\d+)").try_cast("bigint")))
    return rows.withColumns({"rooms": rooms, "price_per_sqm_rub": F.try_divide("price_rub", "total_area_m2"), "floor_share": F.try_divide("floor", "floors_count")})


def listing_summary(listings: DataFrame) -> DataFrame:
    return listings.groupBy("source", "city").agg(F.count("*").alias("rows"), F.median("price_rub").alias("med_price"), F.median("price_per_sqm_rub").alias("med_ppsqm"))


def plausible(listings: DataFrame) -> DataFrame:
    """Listings of 30 thousand to a million roubles a square metre and 15 to 500 square metres, bounds excluded."""
    return listings.where("price_per_sqm_rub > 30000 and price_per_sqm_rub < 1000000 and total_area_m2 > 15 and total_area_m2 < 500")


def compare_sources(raw: DataFrame, listings: DataFrame, anchors: DataFrame, fields: list[str]) -> DataFrame:
    """Of each source and city: rows before and after dedup, completeness of fields in per cent, quantiles of the price a square metre (of
    plausible prices; quartiles are values that occur), and how far its median is from the city's official anchor (city, anchor)."""
    ok = (F.col("price_per_sqm_rub") > 30_000) & (F.col("price_per_sqm_rub") < 1_000_000)
    v = F.when(ok, F.col("price_per_sqm_rub"))
    got = listings.groupBy("source", "city").agg(
        F.count("*").alias("rows_unique"), F.median("price_rub").alias("median_price_rub"), F.median(v).alias("median_ppsqm_rub"), F.count(v).alias("n_valid_ppsqm"),
        F.expr("percentile_disc(0.25) within group (order by case when price_per_sqm_rub > 30000 and price_per_sqm_rub < 1000000 then price_per_sqm_rub end)").alias("p25_ppsqm_rub"),
        F.expr("percentile_disc(0.75) within group (order by case when price_per_sqm_rub > 30000 and price_per_sqm_rub < 1000000 then price_per_sqm_rub end)").alias("p75_ppsqm_rub"),
        *[F.round(100 * F.count(f) / F.count("*"), 1).alias(f"compl_{f}_pct") for f in fields],
    )
    before = raw.groupBy("source", "city").agg(F.count("*").alias("rows_raw"))
    out = got.join(before, ["source", "city"]).join(anchors, "city", "left")
    return out.withColumns({"dedup_ratio": F.round(1 - F.col("rows_unique") / F.col("rows_raw"), 2), "anchor_delta_pct": F.round(100 * (F.col("median_ppsqm_rub") - F.col("anchor")) / F.col("anchor"), 1)}).drop("anchor")
