"""Money, stock and calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarifa.model import VAT


def discount_pct(price: Column, original: Column) -> Column:
    """Whole percent off; 0 unless original > price > 0."""
    return F.when((original > price) & (price > 0), F.round((1 - price / original) * 100)).otherwise(0).cast("int")


def number_in(text: Column) -> Column:
    """A money text as a number; null on failure."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")


def with_vat(price: Column, taxable: Column) -> Column:
    """The shelf price of a net price; only what is known to be taxable is grossed up."""
    return F.when(F.coalesce(taxable, F.lit(False)), F.round(price * (1 + VAT), 2)).otherwise(price)


def stock_signal(in_stock: Column, qty: Column) -> Column:
    """OOS, AVAIL (no count), LOW below 10, MEDIUM to 30, HIGH."""
    count = F.coalesce(qty, F.lit(0))
    return F.when(in_stock == F.lit(False), "OOS").when(count <= 0, F.when(F.coalesce(in_stock, F.lit(False)), "AVAIL").otherwise("OOS")).when(count < 10, "LOW").when(count <= 30, "MEDIUM").otherwise("HIGH")


def ksa_day(at: Column) -> Column:
    """The day at UTC+3, which has no daylight saving."""
    return F.to_date(at + F.expr("INTERVAL 3 HOURS"))


def year_iso_week(at: Column) -> Column:
    """Calendar year with ISO week, as the labels have it."""
    return F.concat(F.year(at).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))


def monday_week(at: Column) -> Column:
    """Weeks of the year that start on Monday; days before the first are week 00."""
    week = F.floor((F.dayofyear(at) - 1 + 7 - F.weekday(at)) / 7)
    return F.concat(F.year(at).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
