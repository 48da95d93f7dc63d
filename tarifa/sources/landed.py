"""Landed payloads: JSON envelopes of product lists, product cards in HTML, and report files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifa.sources.markup import Page, Selectors

_ITEM = "struct<id:string,sku:string,name:string,price:string,sale_price:string,quantity:string>"
#: Where the envelopes of different shops keep their list.
ENVELOPES = ("data", "products", "results", "items")
# Where pages of each kind of shop have their cards, and what is in them.
PROFILES = {
    "salla": {
        "card": (".product-card", ".product-item", "[data-product]", ".s-product-card-entry"), "name": (".product-card__title", ".product-name", "h3", "h2", ".s-product-card-entry__title"),
        "price": (".product-price", ".price", "[data-price]", ".s-product-card-entry__price"), "orig": (".product-price--compare", ".compare-price", "s", "del"), "image": ("img.product-card__image", ".product-image img", "img"),
    },
    "zid": {
        "card": (".product-item", ".zid-product", ".product-card"), "name": (".item-title", ".product-title", "h3"), "price": (".item-price", ".product-price", ".price-current"),
        "orig": (".item-price-old", ".price-old", "del"), "image": (".item-image img", ".product-img img", "img"),
    },
    "shopify": {
        "card": (".product-card", ".grid-product", "[data-product-card]"), "name": (".product-card__title", ".grid-product__title", "h3"), "price": (".product-card__price", ".grid-product__price", ".price"),
        "orig": (".price--compare", "del", "s"), "image": ("img.product-card__image", ".grid-product__image-wrap img", "img"),
    },
}
SIGNED_IN = {
    "card": (".product-card", ".product-item", "[data-product]", ".product-entry", ".product"), "name": (".product-title", ".product-name", "h3", "h4", "[data-product-title]"), "member_price": (".member-price", ".loyalty-price", "[data-member-price]", ".special-price"),
    "price": (".price", "[data-price]", ".product-price"), "flash": (".flash-sale", ".countdown", "[data-flash]", ".sale-badge"), "flash_price": (".flash-price", ".sale-price"), "qty": (".stock-count", "[data-quantity]", ".availability"), "oos": (".out-of-stock", ".sold-out", "[data-oos]"),
}
#: A profile counts from this many cards; below this many products a page's linked data is read.
LEAST_CARDS, LINKED_BELOW = 3, 5


def enveloped(payload: Column) -> Column:
    """The products of a JSON payload, from whichever envelope holds a list, be it one within another; a bare list is its own. Null without any list."""
    listed = lambda text: F.from_json(F.when(F.ltrim(text).startswith("["), text), f"array<{_ITEM}>")  # noqa: E731  an object would count as a list of one
    nested = [f"$.{name}{inner}" for inner in ("", ".products.data", ".data") for name in ENVELOPES]
    return F.coalesce(*(listed(F.get_json_object(payload, path)) for path in nested), listed(payload))


def catalogue(payloads: DataFrame) -> DataFrame:
    """One row a product id of payloads (payload, page where there is one): the one on the latest page, ties by its values."""
    page = F.col("page") if "page" in payloads.columns else F.lit(0)
    rows = payloads.select(page.alias("page"), F.explode(enveloped(F.col("payload"))).alias("p")).select("page", "p.*")
    price = F.coalesce(F.regexp_replace("price", r"[^0-9.]", "").try_cast("double"), F.lit(0.0))
    rows = rows.withColumn("price", price)
    rest = [c for c in rows.columns if c not in ("id", "page")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("page", *rest)).alias("r")).select("id", *(f"r.{c}" for c in rest))


_SCRIPT = "script"
_ALL = Selectors([_SCRIPT, *(x for profile in (*PROFILES.values(), SIGNED_IN) for own in profile.values() for x in own)])


def _linked(page: Page) -> list[dict[str, str]]:
    out = []
    for node in page.hits.get(_SCRIPT, ()):
        if page.attrs[node].get("type") != "application/ld+json":
            continue
        try:
            data = json.loads(page.attrs[node].get("#") or "")
        except (ValueError, RecursionError):
            continue
        for one in data if isinstance(data, list) else data.get("itemListElement", [data]) if isinstance(data, dict) else []:
            one = one.get("item", one) if isinstance(one, dict) else {}
            if isinstance(one, dict) and one.get("@type") == "Product" and one.get("name"):
                offer = one.get("offers") or {}
                offer = offer[0] if isinstance(offer, list) and offer else offer
                out.append({"name": str(one["name"]), "price": str(offer.get("price", "")) if isinstance(offer, dict) else "", "original": "", "image": str(one.get("image") or "")})
    return out


def cards(html: str | None, platform: str | None = None, profiles: dict[str, dict[str, tuple[str, ...]]] = PROFILES, selectors: Selectors = _ALL) -> list[dict[str, str]]:
    """Names, price texts and images of a page's cards by the first profile with enough of them, that of the platform before others; of its linked data too, where there are few."""
    page = Page(html, selectors)
    found: list[dict[str, str]] = []
    for name in sorted(profiles, key=lambda p: p != platform):
        profile = profiles[name]
        for selector in profile["card"]:
            nodes = page.hits.get(selector, ())
            if len(nodes) < LEAST_CARDS:
                continue
            for node in nodes:
                one = {field: page.text(page.first(node, profile[own])) for field, own in (("name", "name"), ("price", "price"), ("original", "orig"))}
                if one["name"]:
                    found.append(one | {"image": page.attribute(node, profile["image"], ("src", "data-src"))})
            if found:
                return found if len(found) >= LINKED_BELOW else found + _linked(page)
    return _linked(page)


def signed_in_cards(html: str | None) -> list[dict]:
    """What cards show to a signed-in customer: member and flash prices, the exact quantity, whether it is sold out."""
    page, out = Page(html, _ALL), []
    for node in page.all(SIGNED_IN["card"]):
        one = {f: page.text(page.first(node, SIGNED_IN[f])) for f in ("name", "price", "member_price", "flash_price", "qty")}
        if one["name"] or one["price"]:
            flash = page.first(node, SIGNED_IN["flash"]) is not None
            out.append(one | {"flash": flash, "flash_price": one["flash_price"] if flash else "", "in_stock": page.first(node, SIGNED_IN["oos"]) is None})
    return out


def _number(name: str) -> Column:
    return F.regexp_extract(F.regexp_replace(name, ",", ""), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def page_cards(pages: DataFrame, profiles: dict[str, dict[str, tuple[str, ...]]] = PROFILES) -> DataFrame:
    """page_id, name, price, original, sale_price, image of every product that a page (page_id, html; platform where there is one) shows.

    The original price is not below the price; there is a sale price where the price is below it. Null and empty pages show nothing; unclosed and very deep markup is read as any other.
    """
    selectors = Selectors([_SCRIPT, *(x for profile in profiles.values() for own in profile.values() for x in own)])
    platform = F.lower("platform") if "platform" in pages.columns else F.lit(None).cast("string")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = zip(*(batch.column(c).to_pylist() for c in ("page_id", "html", "platform")))
            rows = [(page, c["name"], c["price"], c["original"], c["image"]) for page, html, kind in given for c in cards(html, kind, profiles, selectors)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), *[pa.string()] * 4))], ["page_id", "name", "price_text", "original_text", "image"])

    found = pages.select("page_id", "html", platform.alias("platform")).mapInArrow(extract, "page_id bigint, name string, price_text string, original_text string, image string")
    rows = found.select("page_id", "name", _number("price_text").alias("price"), _number("original_text").alias("original"), "image").withColumn("original", F.greatest("original", "price"))
    return rows.select("page_id", "name", "price", "original", F.when(F.col("price") < F.col("original"), F.col("price")).alias("sale_price"), "image")


def page_elements(pages: DataFrame, fields: dict[str, tuple[tuple[str, ...], str | None]]) -> DataFrame:
    """page_id, field, place (from 1), text, number, value of all elements that a page (page_id, html) has for each field.

    fields: selectors, of which the first that finds anything on a page counts, and the attribute whose value is wanted. number: the first number of the text.
    """
    selectors = Selectors([x for own, _ in fields.values() for x in own])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                page = Page(html, selectors)
                for field, (own, attribute) in fields.items():
                    found = next((page.hits[s] for s in own if s in page.hits), ())
                    rows += [(page_id, field, place, page.text(n), page.attrs[n].get(attribute) if attribute else None) for place, n in enumerate(found, 1)]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["page_id", "field", "place", "text", "value"])

    found = pages.select("page_id", "html").mapInArrow(extract, "page_id bigint, field string, place int, text string, value string")
    return found.select("page_id", "field", "place", "text", _number("text").alias("number"), "value")


def page_signed_in_cards(pages: DataFrame) -> DataFrame:
    """page_id, name, price, member_price, flash, flash_price, qty, in_stock of every product that a page shows to a signed-in customer."""
    texts = ("name", "price", "member_price", "flash_price", "qty")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(page, *(c[f] for f in texts), c["flash"], c["in_stock"]) for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()) for c in signed_in_cards(html)]
            kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["page_id", *texts, "flash", "in_stock"])

    found = pages.select("page_id", "html").mapInArrow(extract, "page_id bigint, name string, price string, member_price string, flash_price string, qty string, flash boolean, in_stock boolean")
    return found.select("page_id", "name", *(_number(c).alias(c) for c in ("price", "member_price")), "flash", _number("flash_price").alias("flash_price"), _number("qty").cast("int").alias("qty"), "in_stock")


def write_report(rows: DataFrame, path: str) -> None:
    """A CSV report with a header; arrays are joined by semicolons."""
    flat = [F.array_join(c, ";").alias(c) if kind.startswith("array") else F.col(c) for c, kind in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)
