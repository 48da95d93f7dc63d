"""Raw order payloads of shops, as JSON texts, in the shape of the own orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The statuses that don't count, and where payloads keep totals, dates and the marks of a bundle's parts.
EXCLUDED_STATUSES = ("cancelled", "canceled", "refunded", "reversed", "reverse_in_progress", "rejected", "returned", "draft", "payment_failed", "expired", "deleted")
TOTALS = ("order_total", "grand_total", "total", "totals")
DATES = ("created_at", "issue_date", "created_at_str", "date", "updated_at")
PART_OF_BUNDLE = ("parent_id", "parent_product_id", "parent_order_product_id", "bundle_id", "bundle_parent_id")
_LINE = "struct<sku:string,quantity:string,qty:string,price:string,total:string,is_bundle:string," + ",".join(f"{m}:string" for m in PART_OF_BUNDLE) + ">"


def _filled(value: Column) -> Column:
    """Null for what a payload means by nothing."""
    return F.when(~value.isin("", "0", "false", "null"), value)


def money(value: Column) -> Column:
    """A number, a money text, or an object with value, amount or total; null where there is no number."""
    inner = F.coalesce(*(F.get_json_object(value, f"$.{k}") for k in ("value", "amount", "total")))
    flat = F.when(F.ltrim(value).startswith("{"), inner).otherwise(value)
    return F.regexp_replace(flat, r"[^0-9.\-]", "").try_cast("double")


def instant(value: Column) -> Column:
    """A UTC instant; a time without an offset is the shop's, at UTC+3."""
    has_offset = value.rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$") & value.rlike(r"[T ][0-9]{2}:")
    plain = F.try_to_timestamp(F.regexp_replace(value, "T", " ")) - F.expr("INTERVAL 3 HOURS")
    return F.when(has_offset, F.try_to_timestamp(value)).otherwise(plain)


def normalised(payloads: DataFrame) -> DataFrame:
    """order_id, status, excluded, created_at, total, units, items of payloads (payload); a payload without an id gives no row.

    Parts of a bundle are dropped: their parent's line has the sale. A line without a total has price times quantity.
    """
    get = lambda *names: F.coalesce(*(_filled(F.get_json_object("payload", f"$.{n}")) for n in names))
    status = get("order_status.code", "order_status.slug", "order_status.name", "order_status", "status.code", "status.slug", "status.name", "status")
    lines = F.from_json(get("products", "items"), f"array<{_LINE}>")
    whole = F.filter(lines, lambda x: ~reduce(lambda a, b: a | b, (_filled(x[m]).isNotNull() for m in PART_OF_BUNDLE)))

    def item(x: Column) -> Column:
        qty = F.coalesce(F.coalesce(_filled(x["quantity"]), x["qty"]).try_cast("double").cast("int"), F.lit(0))
        return F.struct(F.trim(F.coalesce(x["sku"], F.lit(""))).alias("sku"), qty.alias("qty"), F.coalesce(money(x["total"]), F.round(money(x["price"]) * qty, 2)).alias("line_total"), _filled(x["is_bundle"]).isNotNull().alias("is_bundle"))

    rows = payloads.select(
        get("id", "order_id", "code").alias("order_id"), F.replace(F.lower(F.trim(F.coalesce(status, F.lit("")))), F.lit(" "), F.lit("_")).alias("status"),
        F.coalesce(*(instant(F.get_json_object("payload", f"$.{n}")) for n in DATES)).alias("created_at"),
        F.coalesce(*(money(F.get_json_object("payload", f"$.{n}")) for n in TOTALS), F.lit(0.0)).alias("total"), F.coalesce(F.transform(whole, item), F.array()).alias("items"),
    )
    units = F.aggregate("items", F.lit(0), lambda a, x: a + F.greatest(x["qty"], F.lit(0)))
    return rows.where("order_id IS NOT NULL").withColumn("excluded", F.col("status").isin(*EXCLUDED_STATUSES)).withColumn("units", units)
