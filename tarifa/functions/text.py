"""Text expressions on product names, codes and counters; all are column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and units below decide results and are kept as the domain has them.
WEIGHT = r"(\d+(?:\.\d+)?)\s*(kg|g|gm|gr|grams?|كجم|جم|جرام|ml|l|liter|litre|oz|lb|lbs|كغ|مل|لتر)"
GRAMS = {1000.0: ("kg", "كجم", "كغ", "l", "liter", "litre", "لتر"), 28.35: ("oz",), 453.59: ("lb", "lbs")}
PACK_COUNT_FIRST = (
    r"(?<!\d)(\d{1,3})\s*(?:[-\s]*(?:pieces?|pcs?|packs?|units?|tins?|cans?|sachets?|pouches?)\b|[x×*]\s*\d+(?:\.\d+)?\s*(?:kg|g|gm|gr|ml|l|كجم|جم|جرام|مل|لتر)\b)"
)
PACK_COUNT_FIRST_AR = r"(?<!\d)(\d{1,3})\s*(?:قطعة|قطع|حبة|حبات|كيس|أكياس|ظرف|أظرف)"
PACK_UNIT_FIRST = r"\d+(?:\.\d+)?\s*(?:kg|g|gm|gr|ml|l|كجم|جم|جرام|مل|لتر)\s*[x×*]\s*(\d{1,3})(?!\d)"
PACK_WORD_FIRST = r"(?:pack\s*(?:of\s*)?|carton\s*(?:for\s*)?|box\s*(?:of\s*)?|set\s*(?:of\s*)?|bundle\s*(?:of\s*)?|×\s*)(\d+)"
PACK_WORD_FIRST_AR = r"(?:علبة|عبوة|كرتون|عدد|طقم|مجموعة)\s*(\d+)"
PACK_PATTERNS = (PACK_COUNT_FIRST, PACK_COUNT_FIRST_AR, PACK_UNIT_FIRST, PACK_WORD_FIRST, PACK_WORD_FIRST_AR)
PACK_WORDS = ("pack", "carton", "box", "set", "bundle", "علبة", "كرتون", "عدد", "طقم")
BUNDLE_SUFFIXES = ("pack", "carton", "box", "set", "bundle", "pcs", "multi")
PACK_SPLIT = r"[\s\-_/|,.;:()\[\]×]+"
BOWLS = ("صحن", "صحون", "وعاء", "أوعية", "bowl", "feeder", "مغذية")
FOOD = ("طعام", "غذاء", "food", "دراي", "ويت", "علف", "كيبل", "معلب")
TREATS = ("مكافأة", "مكافآت", "مكافات", "تريتس", "سناك", "snack", "biscuit", "بسكويت", "chew", "مضغ", "أعواد", "جيركي", "jerky", "دنتال", "ليكابل", "lickable")
TREAT_WORD = r"(?U)(?<!\w)(ستيك|تريت|sticks?|treats?)(?!\w)"
WET = ("رطب", "معلب", "ويت فود", "wet", "canned", "pouch", "باوتش", "jelly", "جيلي", "بالجيلي", "gravy", "مرق", "شوربة", "soup", "mousse", "pate", "باتيه")
DRY = ("جاف", "دراي", "dry", "kibble", "كيبل")
BUNDLES = ("بكج", "باكج", "باكيج", "bundle", "package", "combo", "كومبو", "عرض", "عروض", "مجموعة", "+")
FOOD_ANIMALS = (("dog_food", ("كلب", "كلاب", "dog", "عظمة", "عظم", "bone")), ("cat_food", ("قط", "كات", "cat")), ("bird_food", ("طير", "طيور", "ببغاء", "bird")), ("fish_food", ("سمك", "أسماك", "fish")))
OTHER_CATEGORIES = (
    ("litter", ("رمل", "لتر", "litter", "فضلات", "تراب")),
    ("toys", ("لعب", "toy", "ألعاب", "كونغ")),
    ("grooming", ("شامبو", "فرشاة", "shampoo", "brush", "groom", "عناية", "مقص", "تنظيف")),
    ("healthcare", ("بيطر", "vet", "دواء", "علاج", "فيتامين", "مكمل", "برغوث")),
)
ANIMALS = (
    ("cat", ("قط", "كات", "cat", "هر")),
    ("dog", ("كلب", "كلاب", "dog")),
    ("bird", ("طير", "طيور", "ببغاء", "bird", "كناري")),
    ("fish", ("سمك", "أسماك", "fish")),
    ("reptile", ("زواحف", "reptile")),
    ("small", ("أرنب", "هامستر", "rabbit", "hamster")),
)
STOP_WORDS = (
    "في من على إلى عن مع هذا هذه ذلك تلك هو هي هم لا ان أن و ب ال لل كل ما".split()
    + "the a an and or for with from to in of is at by on it its this that".split()
)
CAPPED = r"(?i)(?:\+\s*$)|(?:^\s*\+)|أكثر\s*من|اكثر\s*من|more\s+than|over\s+\d"
BRANDS = (
    "Royal Canin", "رويال كانين", "Whiskas", "ويسكاس", "Pedigree", "بيدقري", "Purina", "بورينا", "Hills", "هيلز", "N&D", "Orijen", "اوريجن", "Acana", "اكانا",
    "Friskies", "فريسكيز", "Me-O", "مي-او", "Kong", "كونغ", "FURminator", "فرمينيتور", "Frontline", "فرونت لاين", "Versele-Laga", "فيرسيل", "Catit", "Oxbow", "Tetra",
    "Virbac", "Ever Clean", "Josera", "Brit", "Schesir", "Gimcat", "Trixie", "Beaphar",
)


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def first_of(cases, text: Column, other: str | None = None) -> Column:
    """The name of the first case that has a word in text."""
    found = reduce(lambda c, case: c.when(has_any(text, case[1]), case[0]), cases[1:], F.when(has_any(text, cases[0][1]), cases[0][0]))
    return found.otherwise(other) if other is not None else found


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def canonical_barcode(value: Column) -> Column:
    """The leading 8 to 14 digits, if what follows is no digit, as 14 digits; null otherwise."""
    return F.lpad(_group(F.lower(F.trim(value)), r"^([0-9]{8,14})(?=[^0-9]|$)"), 14, "0")


def is_barcode(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[0-9]{8,14}$"), F.lit(False))


def valid_gtin(value: Column) -> Column:
    """8, 12, 13 or 14 digits with a right check digit."""
    digits = F.lpad(value, 14, "0")
    total = sum(F.substring(digits, i, 1).try_cast("int") * (3 if i % 2 else 1) for i in range(1, 15))
    return F.coalesce(value.rlike(r"^(?:[0-9]{8}|[0-9]{12,14})$") & (total % 10 == 0), F.lit(False))


def tokens(text: Column) -> Column:
    """Different lower-case words of two letters or more that aren't stop words."""
    words = F.filter(F.split(F.lower(F.regexp_replace(text, r"(?U)[^\w\s]", " ")), r"(?U)\s+"), lambda t: F.length(t) > 1)
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard overlap of two token arrays; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def weight_grams(name: Column) -> Column:
    """The first weight or volume in a name, in grams or millilitres; null without one."""
    number, unit = _group(name, f"(?i){WEIGHT}").try_cast("double"), F.lower(F.regexp_extract(name, f"(?i){WEIGHT}", 2))
    factor = reduce(lambda c, item: c.when(unit.isin(*item[1]), item[0]), list(GRAMS.items())[1:], F.when(unit.isin(*GRAMS[1000.0]), 1000.0)).otherwise(1.0)
    return number * factor


def weights_agree(a: Column, b: Column, ratio: float) -> Column:
    """Unless both weights are known, positive and further apart than the ratio."""
    apart = F.greatest(a, b) / F.least(a, b) > ratio
    return ~F.coalesce((a > 0) & (b > 0) & apart, F.lit(False))


def stated_pack(name: Column) -> Column:
    """The pack count that a name states; null if none."""
    return F.coalesce(*(_group(name, f"(?i){p}") for p in PACK_PATTERNS)).try_cast("int")


def pack_quantity(name: Column) -> Column:
    """The stated pack count; -1 for a pack word without one; else 1."""
    word = F.arrays_overlap(F.split(F.lower(name), PACK_SPLIT), F.array(*map(F.lit, PACK_WORDS)))
    return F.coalesce(stated_pack(name), F.when(word, -1), F.lit(1))


def has_pack(name: Column) -> Column:
    """Whether a name states a pack count, be it 1, or has a pack word as a word of its own."""
    return stated_pack(name).isNotNull() | (pack_quantity(name) == -1)


def is_bundle_sku(sku: Column) -> Column:
    """Whether a sku ends like a bundle's."""
    lowered = F.lower(sku)
    return F.coalesce(reduce(lambda a, b: a | b, (lowered.endswith(x) for x in BUNDLE_SUFFIXES)), F.lit(False))


def packs_agree(a: Column, b: Column) -> Column:
    """Of names: equal counts, or two packs of unknown count."""
    return pack_quantity(a) == pack_quantity(b)


def brand(name: Column) -> Column:
    lowered = F.lower(name)
    return F.coalesce(reduce(lambda c, b: c.when(lowered.contains(b.lower()), b), BRANDS[1:], F.when(lowered.contains(BRANDS[0].lower()), BRANDS[0])), F.lit(""))


# The brands that matching knows, in the order in which they are looked for.
MATCHED_BRANDS = (
    "royal canin", "رويال كانين", "whiskas", "ويسكاس", "pedigree", "بيدقري",
    "purina", "بورينا", "hill's", "hills", "هيلز", "n&d", "orijen", "اوريجن", "acana", "اكانا",
    "friskies", "فريسكيز", "me-o", "مي-او", "kong", "كونغ", "furminator", "فرمينيتور",
    "frontline", "فرونت لاين", "versele-laga", "فيرسيل", "catit", "oxbow", "tetra",
    "virbac", "ever clean", "josera", "brit", "schesir", "gimcat", "trixie", "beaphar",
    "perfect fit", "sheba", "fancy feast", "iams", "wellness", "natural balance",
    "advance", "applaws", "cesar", "felix", "almo nature", "arden grange",
)


def matched_brand(name: Column) -> Column:
    """The brand by which names are compared, in small letters; null where none is known."""
    lowered = F.lower(name)
    return F.get(F.filter(F.array(*map(F.lit, MATCHED_BRANDS)), lambda b: lowered.contains(b)), F.lit(0))


def absolute_url(url: Column, domain: Column) -> Column:
    """A whole address, a path, or a product's short name as an address at a shop's domain; empty without one or without a domain."""
    said = F.trim(F.coalesce(url, F.lit("")))
    at = F.concat(F.lit("https://"), domain)
    found = F.when(said.rlike("^https?://"), said).when(said.startswith("//"), F.concat(F.lit("https:"), said)).when(said.startswith("/"), F.concat(at, said)).otherwise(F.concat(at, F.lit("/products/"), said))
    return F.when((said == "") | (F.coalesce(domain, F.lit("")) == ""), F.lit("")).otherwise(found)


def treat(text: Column) -> Column:
    return has_any(text, TREATS) | text.rlike(TREAT_WORD)


def category(name: Column) -> Column:
    n = F.lower(name)
    food = first_of(FOOD_ANIMALS, n, "pet_food")
    return F.when(has_any(n, BOWLS), "accessories").when(has_any(n, FOOD) | treat(n), food).otherwise(first_of(OTHER_CATEGORIES, n, "accessories"))


def food_form(parent: Column, text: Column) -> Column:
    """dry, wet or treats of cat and dog food; null where the text doesn't say, says both, or names a bundle."""
    t = F.lower(text)
    animal = F.when(parent == "cat_food", "cat").when(parent == "dog_food", "dog")
    wet, dry = has_any(t, WET), has_any(t, DRY)
    return F.when(has_any(t, BUNDLES), None).when(treat(t), F.concat(animal, F.lit("_treats"))).when(wet & dry, None).when(wet, F.concat(animal, F.lit("_food_wet"))).when(dry, F.concat(animal, F.lit("_food_dry")))


def animal(name: Column) -> Column:
    return first_of(ANIMALS, F.lower(name), "other")


def counter(text: Column) -> Column:
    """A sold counter's value, and whether its text only bounds it."""
    value = F.coalesce(F.nullif(F.regexp_replace(text, r"[^0-9.]", ""), F.lit("")).try_cast("double"), F.lit(0.0))
    return F.struct(F.floor(value).cast("long").alias("value"), F.coalesce(text.rlike(CAPPED) & (value > 0), F.lit(False)).alias("capped"))


def price_in(text: Column) -> Column:
    """The first number in a price text; null without one."""
    return _group(F.regexp_replace(text, ",", ""), r"([0-9]+(?:\.[0-9]+)?)").try_cast("double")


def domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^(?:[a-z]+://)?(?:www\.)?([^/?#:]+)", 1))
