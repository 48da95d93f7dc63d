"""Fixed values that results depend on."""

#: Rows below this confidence don't enter aggregates.
MIN_CONFIDENCE = 85
#: Quantities that stand for "plenty"; the largest quantity that is believed.
PLACEHOLDER_QTY = (99, 100, 999, 1000, 9999, 10000, 99999, 100000)
USABLE_QTY = 200
#: Most units a pair of readings may add: by stock, by counter; most units a day; most units a badge step.
MAX_QTY_STEP, MAX_SOLD_STEP, MAX_DAILY_UNITS, MAX_BADGE_STEP = 10, 50, 30, 5000
#: Ranking: weights, hours until a row isn't fresh.
WEIGHTS = {"breadth": 0.25, "price": 0.35, "stock": 0.25, "freshness": 0.15}
FRESH_HOURS = 48
#: Matching: the price ratio from which a barcode match is doubted, the name similarity that clears it, the weight ratio allowed.
DOUBT_RATIO, NAME_CLEARS, WEIGHT_RATIO = 6.0, 0.75, 1.10
#: Scanner: a listing below this share of the largest of its run is a variant; a minimum below this share of the others' median is odd.
VARIANT_SHARE, OUTLIER_SHARE = 0.25, 0.25
#: Observations that a category needs for a pool of its own.
MIN_CATEGORY = 30
#: A day's row is partial below this share of the known products.
PARTIAL_BELOW = 0.5
VAT = 0.15
