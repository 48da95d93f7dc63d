"""Workbooks (.xlsx) as rows: read as whole files by Spark, so from any store that Spark reads, and unpacked sheet by sheet in tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_ROWS = "path string, sheet string, active boolean, row int, cells array<string>"
#: Rows that a task passes on at a time.
BATCH = 5_000


def _place(reference: str) -> int:
    """The column that a cell's name stands for, from 0."""
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _number(value: str) -> str:
    """A number as it is written, whole ones without a fraction or an exponent."""
    try:
        return str(int(float(value))) if re.search("[.eE]", value) and float(value).is_integer() else value
    except (ValueError, OverflowError):
        return value


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _cell(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind, value = cell.get("t", "n"), cell.findtext(f"{_MAIN}v")
    if kind == "inlineStr":
        return _texts(cell)
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    return {"1": "true", "0": "false"}.get(value) if kind == "b" else (value if kind in ("str", "d") else _number(value))


def sheets(content: bytes) -> Iterator[tuple[str, bool, int, list[str | None]]]:
    """Sheet, whether it is the one that opens first, row (from 1) and cells of all rows of a workbook; rows are read one by one."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = [_texts(item) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        first = next((int(v.get("activeTab", 0)) for v in root.iter(f"{_MAIN}workbookView")), 0)
        for n, sheet in enumerate(root.iter(f"{_MAIN}sheet")):
            target = targets[sheet.get(_REL)]
            with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as data:
                at = 0
                for _, row in ElementTree.iterparse(data):
                    if row.tag != f"{_MAIN}row":
                        continue
                    at = int(row.get("r", at + 1))
                    cells: list[str | None] = []
                    for cell in row.iter(f"{_MAIN}c"):
                        place = _place(cell.get("r")) if cell.get("r") else len(cells)
                        cells += [None] * (place - len(cells))
                        cells.append(_cell(cell, shared))
                    yield sheet.get("name"), n == first, at, cells
                    row.clear()


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, active, row, cells of all workbooks at a path."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                held = []
                for row in sheets(content.as_py()):
                    held.append((name, *row))
                    if len(held) == BATCH:
                        yield _batch(held)
                        held = []
                yield _batch(held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, _ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "sheet", "active", "row", "cells"])


def headed(rows: DataFrame, sheet: str | None = None, header: int = 1) -> DataFrame:
    """A sheet (or the one that opens first) as a table of texts, its columns named by the header row in small letters; rows that are empty throughout are left out.

    Raises where the sheet has no such row. Columns without a name are left out, as are later ones of a name.
    """
    own = rows.where(F.col("sheet") == sheet if sheet else F.col("active"))
    head = own.where(F.col("row") == header).select("cells").first()  # one row
    if head is None:
        raise ValueError("the sheet has no header row")
    names = [(c or "").strip().lower() for c in head.cells]
    places = {name: i for i, name in reversed(list(enumerate(names))) if name}
    filled = F.exists("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    kept = own.where((F.col("row") > header) & filled)
    return kept.select(*(F.get("cells", F.lit(i)).alias(name) for name, i in sorted(places.items(), key=lambda x: x[1])))


def _text(place: int) -> Column:
    return F.coalesce(F.trim(F.get("cells", F.lit(place))), F.lit(""))


def _amount(place: int) -> Column:
    return F.coalesce(_text(place).try_cast("double"), F.lit(0.0))


def _percent(place: int) -> Column:
    """A percentage with or without its sign; 0 where it is no number."""
    return F.coalesce(F.regexp_replace(_text(place), "[%+]", "").try_cast("double"), F.lit(0.0))


def baseline(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of a market baseline's sheets, which have their values at fixed places under their headings; rows without a key are left out."""
    of = lambda sheet, after: rows.where((F.col("sheet") == sheet) & (F.col("row") > after))
    counted = _text(0).rlike("^[0-9]+$")
    stats = of("My_Store_Baseline", 14).where(counted).select(
        _text(0).cast("int").alias("rank"), _text(1).alias("barcode"), _text(2).alias("name_ar"), _amount(3).alias("my_price_sar"), _amount(4).cast("int").alias("est_units_sold"), _amount(5).alias("est_revenue_sar"),
        _amount(6).alias("est_market_size_sar"), _percent(7).alias("est_market_share_pct"), _percent(8).alias("vs_lowest_pct"), _percent(9).alias("vs_median_pct"), _amount(10).cast("int").alias("sellers_count"),
    )
    leaders = of("Market_Leaderboard", 2).where(counted).select(
        _text(0).cast("int").alias("rank"), _text(1).alias("store_domain"), _text(2).alias("relative_size"), _text(3).alias("notes"), (F.upper(_text(4)) == "YES").alias("is_my_store")
    )
    gaps = of("Catalog_Gaps", 2).where((_text(0) != "") & (_text(1) != "")).select(
        _text(0).alias("priority"), _text(1).alias("barcode"), _text(2).alias("product_name"), _amount(3).cast("int").alias("est_units_sold"), _amount(4).alias("est_revenue_sar"),
        _amount(5).cast("int").alias("sellers_count"), _amount(6).alias("avg_price_sar"), _text(7).alias("action"),
    )
    prices = of("Price_Comparisons", 2).where((_text(0) != "") & (_text(5) != "") & (_amount(6) > 0)).select(
        _text(0).alias("sku"), _text(5).alias("store"), F.round(_amount(6) * 100).cast("long").alias("cents"), (F.lower(_text(7)) == "in stock").alias("in_stock"), F.lit(80).alias("confidence"), F.lit(5).alias("source_tier")
    )
    # of a barcode's rows the last one stays
    stats = stats.groupBy("barcode").agg(F.max_by(F.struct(*(c for c in stats.columns if c != "barcode")), "rank").alias("r")).select("barcode", "r.*")
    return {"product_stats": stats, "leaderboard": leaders, "gaps": gaps, "prices": prices}
