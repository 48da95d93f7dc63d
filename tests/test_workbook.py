"""Workbooks that are zipped here, and the report pack."""

import io
import json
import zipfile
from datetime import datetime
from xml.sax.saxutils import escape

import pytest

from tarifa.operators import reports
from tarifa.sources import products, workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def column(n):
    return (column(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)


def book(path, sheets, active=0):
    """sheets: name -> rows (dict of row number to cells, or a list); texts are shared, other values as they are, None is left out."""
    shared = []

    def cell(r, c, v):
        at = f"{column(c)}{r}"
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, tuple):
            return f'<c r="{at}" t="inlineStr"><is><r><t>{escape(v[0])}</t></r><r><t>{escape(v[1])}</t></r></is></c>'
        if isinstance(v, str):
            shared.append(v)
            return f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>'
        return f'<c r="{at}"><v>{v}</v></c>'

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as out:
        for n, rows in enumerate(sheets.values(), 1):
            rows = rows if isinstance(rows, dict) else dict(enumerate(rows, 1))
            body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(cells) if v is not None) + "</row>" for r, cells in rows.items())
            out.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
        out.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>")
        names = "".join(f'<sheet name="{escape(s)}" sheetId="{n}" r:id="rId{n}"/>' for n, s in enumerate(sheets, 1))
        out.writestr("xl/workbook.xml", f'<workbook {NS}><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{names}</sheets></workbook>')
        out.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{n}" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1)) + "</Relationships>")
    path.write_bytes(data.getvalue())


def test_products_of_a_sheet(spark, tmp_path):
    rows = [["SKU ", "name_ar", "Price", None, "barcode"], ["a", "قط", 10.5, None, 5200000000001], ["b", ("Dog ", "Food"), "12 SAR", "x", "5.2E12"], ["c", "free", 0], [None, "no sku", 5], ["a", "later", 11], [None, "  "], [True, "said", 3]]
    book(tmp_path / "p.xlsx", {"other": [["x"]], "Products & more": rows}, active=1)
    read = workbook.read(spark, f"file://{tmp_path}/p.xlsx")
    assert {(r.sheet, r.active) for r in read.select("sheet", "active").distinct().collect()} == {("other", False), ("Products & more", True)}
    table = workbook.headed(read)
    assert table.columns == ["sku", "name_ar", "price", "barcode"]
    got = {r.sku: (r.name_ar, r.price, r.barcode) for r in products.imported_products(table).collect()}
    assert got == {"a": ("later", 11.0, None), "b": ("Dog Food", 12.0, "5.2E12"), "true": ("said", 3.0, None)}
    assert {r.barcode for r in table.collect()} == {"5200000000001", "5.2E12", None}
    with pytest.raises(ValueError, match="missing columns: name_ar, price, sku"):
        products.imported_products(workbook.headed(read, "other"))
    with pytest.raises(ValueError, match="header"):
        workbook.headed(read, "nowhere")
    assert [workbook._number(x) for x in ("1.0", "5.2E12", "1.5", "7", "1E999")] == ["1", "5200000000000", "1.5", "7", "1E999"]


def test_a_baseline_of_five_sheets(spark, tmp_path):
    stats = {1: ["title"], 14: ["1", "heading"], 15: [1, "52", "قط", 10, 3, 30.5, 100, "12.5%", "+5%", "n/a", 4], 16: ["x", "53"], 17: [2, "52", "again", 11]}
    book(tmp_path / "b.xlsx", {
        "My_Store_Baseline": stats, "Market_Leaderboard": [["t"], ["h"], [1, "a.example", "big", None, "yes"], ["n", "b"]], "Catalog_Gaps": [["t"], ["h"], ["High", "54", "toy", 5, 99.5, 3, 20, "add"], ["High", None]],
        "Price_Comparisons": [["t"], ["h"], ["55", "n", "me", 10, "In Stock", "b.example", 9.99, "IN STOCK"], ["56", "n", "me", 10, "", "b.example", 0], ["57", "n", "me", 1, "", "", 5]], "Notes": [["nothing"]],
    })
    found = workbook.baseline(workbook.read(spark, f"file://{tmp_path}/*.xlsx"))
    assert [tuple(r) for r in found["product_stats"].collect()] == [("52", 2, "again", 11.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)]
    assert [tuple(r) for r in found["leaderboard"].collect()] == [(1, "a.example", "big", "", True)]
    assert [tuple(r) for r in found["gaps"].collect()] == [("High", "54", "toy", 5, 99.5, 3, 20.0, "add")]
    assert [tuple(r) for r in found["prices"].collect()] == [("55", "b.example", 999, True, 80, 5)]


def test_the_report_pack(spark, tmp_path):
    newest = spark.createDataFrame([("1", "S", 900, 1000, 10, 5, True, datetime(2024, 1, 9)), ("2", "S", 500, 500, 0, 0, False, datetime(2024, 1, 9)), ("1", "T", 800, 800, 0, 1, None, datetime(2024, 1, 8))], "sku string, store_id string, cents long, list_cents long, discount_pct int, qty int, in_stock boolean, crawled_at timestamp")
    matches = spark.createDataFrame([("m", "1", "S", "cheaper", ["A", "B"]), ("m", "1", "T", "equal", [])], "my_sku string, rival_sku string, store_id string, position string, flags array<string>")
    goods = spark.createDataFrame([("1", "n", "b", "c", datetime(2024, 1, 5)), ("2", "o", "b", "c", datetime(2023, 1, 5))], "sku string, name string, brand string, category string, first_seen_at timestamp")
    stores = spark.createDataFrame([("S", "s.example", "zid"), ("T", "t.example", "salla"), ("U", "u.example", "zid")], "store_id string, domain string, platform string")
    tables = reports.pack(newest, matches, goods, goods.select("sku"), stores, datetime(2024, 1, 10))
    reports.written(tables, f"file://{tmp_path}/out")
    share = {r.store_id: tuple(r)[1:] for r in tables["market_share"].collect()}
    assert share == {"S": ("s.example", "zid", 2, 66.7, 50.0, 50.0, 10.0, 7.0), "T": ("t.example", "salla", 1, 33.3, 0.0, 0.0, 0.0, 8.0)}
    said = json.loads(next((tmp_path / "out/summary").glob("part*")).read_text())
    assert said == {"window_days": 30, "price_position_counts": ["cheaper=1", "equal=1"], "my_skus_matched_to_competitors": 1, "match_rows": 2, "stores_with_data": 2, "competitor_skus_tracked": 3, "competitor_skus_on_discount": 1, "competitor_skus_out_of_stock": 2, "my_products": 2, "products_recently_added": 1, "stores_total": 3}
    text = next((tmp_path / "out/price_comparison").glob("part*")).read_text(encoding="utf-8")
    assert text.startswith("﻿my_sku,rival_sku") and "A;B" in text
    assert next((tmp_path / "out/out_of_stock").glob("part*")).read_text().count("\n") == 3
