"""Matching own products with rivals' listings: by barcode, then by sku, as equi-joins with guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa.functions import text
from tarifa.model import DOUBT_RATIO, NAME_CLEARS, WEIGHT_RATIO
from tarifa.session import stored


def price_sane(mine: Column, theirs: Column, my_name: Column, their_name: Column) -> Column:
    """Whether a barcode match is believed: prices within the ratio, or equal stated packs, or names alike but not the same."""
    return _sane(mine, theirs, text.stated_pack(my_name) == text.stated_pack(their_name), F.sort_array(text.tokens(my_name)), F.sort_array(text.tokens(their_name)))


def _sane(mine: Column, theirs: Column, packs: Column, a: Column, b: Column) -> Column:
    ratio = F.greatest(mine, theirs) / F.least(mine, theirs)
    names = (a != b) & (text.name_similarity(a, b) >= NAME_CLEARS)
    return F.coalesce(ratio < DOUBT_RATIO, F.lit(True)) | F.coalesce(packs, F.lit(False)) | F.coalesce(names, F.lit(False))


#: Fields that hold a product's code: the shop's reading of it, and what catalogues say.
CODES = ("barcode", "seen_barcode", "gtin", "mpn")
#: Rows of one key that a task joins with as many of the other side; keys with more are dealt over several, or their pairs are not made at all.
KEY_ROWS = 1_000
#: Bands of prices, from one to its double, by which the rivals of a crowded key are numbered.
BANDS = 8
#: Different names up to which what they say is sent to every task.
BROADCAST_NAMES = 100_000


def with_keys(rows: DataFrame) -> DataFrame:
    """rows with `keys`, the 14-digit forms by which a product can be met, and `literals`, the codes as they are written.

    A code field may have something after its 8 to 14 digits; a sku counts only if the whole of it is a code, so a shop's own numbering meets nothing.
    """
    codes = [F.lower(F.trim(c)) for c in CODES if c in rows.columns]
    sku = F.lower(F.trim(F.col("sku").cast("string")))
    plain = [F.when(text.is_barcode(c), c) for c in (*codes, sku)]
    known = [*(text.canonical_barcode(c) for c in codes), text.canonical_barcode(F.when(text.is_barcode(sku), sku))]
    return rows.withColumn("keys", F.array_distinct(F.array_compact(F.array(*known)))).withColumn("literals", F.array_distinct(F.array_compact(F.array(*plain))))


def crowded_keys(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """key: those that over KEY_ROWS rows of mine (my_keys) or of theirs (their_keys) have."""
    counted = lambda rows, keys: rows.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > KEY_ROWS).select("key")
    return counted(mine, "my_keys").unionByName(counted(theirs, "their_keys")).distinct()


def joined_on_keys(mine: DataFrame, theirs: DataFrame, but: DataFrame | None = None) -> DataFrame:
    """Pairs of rows of mine and theirs that have a key in common, once each; keys: arrays my_keys and their_keys, no other column of both.

    but: crowded_keys(); pairs that would meet there are left out.

    A placeholder code may stand on a third of all rows: the rows of a key beyond KEY_ROWS are dealt over
    parts of it, on either side, and each part of one side meets each of the other, so a task has KEY_ROWS * KEY_ROWS pairs of a key at most to look at.
    """

    # rows that share several keys meet at the first of those that both have
    first = F.array_min(F.array_intersect("my_keys", "their_keys"))
    if but is not None:
        a, b = (rows.withColumn("key", F.explode(keys)).join(F.broadcast(but), "key", "left_anti") for rows, keys in ((mine, "my_keys"), (theirs, "their_keys")))
        return a.join(b, "key").where(F.col("key") == first).drop("key")

    def dealt(rows: DataFrame, keys: str, at: str) -> tuple[DataFrame, DataFrame]:
        rows = rows.withColumn(at, F.monotonically_increasing_id())
        each = rows.select(at, F.explode(keys).alias("key"))
        counts = each.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > KEY_ROWS).select("key", F.ceil(F.col("n") / KEY_ROWS).cast("int").alias(f"{at}_parts"))
        return rows.withColumn("key", F.explode(keys)), counts

    a, many_a = dealt(mine, "my_keys", "_at_my")
    b, many_b = dealt(theirs, "their_keys", "_at_their")
    hot = many_a.join(many_b, "key", "full")  # a row for each key of over KEY_ROWS rows: at most the rows by KEY_ROWS

    def placed(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(F.broadcast(hot), "key", "left").withColumn(f"{own}_part", F.pmod(F.xxhash64(own, "key"), F.coalesce(f"{own}_parts", F.lit(1))))
        return rows.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"{other}_parts"), F.lit(1)) - 1).cast("array<bigint>"))).drop(f"{own}_parts", f"{other}_parts")

    pairs = placed(a, "_at_my", "_at_their").join(placed(b, "_at_their", "_at_my"), ["key", "_at_my_part", "_at_their_part"])
    return pairs.where(F.col("key") == first).drop("key", "_at_my_part", "_at_their_part", "_at_my", "_at_their")


def key_matches(own: DataFrame, rivals: DataFrame, blacklist: DataFrame | None = None, confirmed: DataFrame | None = None) -> DataFrame:
    """matches() by all keys of a product: own (sku, name, cents and any of CODES), rivals (sku, store_id, name, cents and any of CODES).

    barcode_key says how codes met: 'literal' as they are written, or as theirs is in 14 digits, else 'gtin14'. Products without such a match are looked up by sku.
    """
    return _matched(with_keys(own), with_keys(rivals), blacklist, confirmed)


def matches(own: DataFrame, rivals: DataFrame, blacklist: DataFrame | None = None, confirmed: DataFrame | None = None) -> DataFrame:
    """One match a product and store: own (sku, barcode, name, cents), rivals (sku, store_id, barcode, name, cents).

    Barcodes meet in their 14-digit form. A product without any barcode match is looked up by sku. Rejected pairs (my_sku, rival_sku)
    hold at every store; a confirmed rival_sku has confidence 100 and isn't asked for a sane price.
    """
    keyed = lambda rows: rows.withColumn("keys", F.array_compact(F.array(text.canonical_barcode(F.col("barcode"))))).withColumn("literals", F.array("barcode"))
    return _matched(keyed(own), keyed(rivals), blacklist, confirmed).drop("barcode_key")


def first_offers(asks: DataFrame, offers: DataFrame) -> DataFrame:
    """Each of asks (group, least, spare, ...) with the first of its group's offers (group, rival_cents, rival_sku, ...) that costs `least` or more, and the `spare` next ones.

    Offers are in order of price, then sku. They are numbered band of prices by band, so that no task gets a whole group, whatever its rows.
    """
    band = lambda cents: F.floor(F.log2(cents) * BANDS)
    wanted = asks.select("group", "least").distinct().select("group", "least", F.lit(0).alias("counted"))
    marks = offers.withColumn("least", F.col("rival_cents")).withColumn("counted", F.lit(1)).unionByName(wanted, allowMissingColumns=True).withColumn("band", band(F.col("least")))
    lower = Window.partitionBy("group").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)  # a row a band
    before = marks.groupBy("group", "band").agg(F.sum("counted").alias("n")).select("group", "band", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("before"))
    within = Window.partitionBy("group", "band").orderBy("least", "counted", "rival_sku").rowsBetween(Window.unboundedPreceding, 0)
    placed = marks.withColumn("at", F.sum("counted").over(within)).join(before, ["group", "band"]).withColumn("place", F.col("before") + F.col("at")).drop("band", "before", "at")
    starts = placed.where("counted = 0").select("group", "least", (F.col("place") + 1).alias("start"))
    found = asks.join(starts, ["group", "least"]).withColumn("place", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("spare")))).drop("start")
    return found.join(placed.where("counted = 1").drop("least", "counted"), ["group", "place"]).drop("group", "place")


def said(names: DataFrame) -> DataFrame:
    """What each of names (name) says, once each: name, pack, stated, grams, words; stated and grams are -1 where it says nothing. It takes some thirty patterns to read a name."""
    name = F.col("name")
    return names.distinct().select(name, text.pack_quantity(name).alias("pack"), F.coalesce(text.stated_pack(name), F.lit(-1)).alias("stated"), F.coalesce(text.weight_grams(name), F.lit(-1.0)).alias("grams"), F.sort_array(text.tokens(name)).alias("words"))


def _fits() -> Column:
    """Whether the names of a pair agree on pack and weight."""
    return (F.col("my_pack") == F.col("their_pack")) & text.weights_agree(F.col("my_grams"), F.col("their_grams"), WEIGHT_RATIO)


def _same_stated() -> Column:
    return (F.col("my_stated") == F.col("their_stated")) & (F.col("my_stated") >= 0)


def alike_names(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Pairs (my_name, rival_name) of names that are alike but not the same, and agree on pack and weight.

    Names meet where they share one of their first words, in one order for all: two that are alike share one among so many.
    """

    def firsts(rows: DataFrame, of: str, name: str) -> DataFrame:
        words = F.col(f"{of}_words")
        least = F.ceil(F.size(words) * NAME_CLEARS - 1e-9).cast("int")  # that it shares with any name that is alike
        return rows.select(name, *(f"{of}_{c}" for c in ("pack", "grams", "words"))).distinct().withColumn("word", F.explode(F.slice(words, F.lit(1), F.size(words) - least + 1)))

    pairs = firsts(mine, "my", "my_name").join(firsts(theirs, "their", "rival_name"), "word")
    alike = (F.col("my_words") != F.col("their_words")) & (text.name_similarity(F.col("my_words"), F.col("their_words")) >= NAME_CLEARS)
    return pairs.where(_fits() & alike).select("my_name", "rival_name").distinct()


def best_of_crowd(mine: DataFrame, theirs: DataFrame, crowded: DataFrame, blacklist: DataFrame | None) -> DataFrame:
    """Pairs with a key of crowded in common that pass all guards; of each product, key and store the best is among them, the others are not looked at.

    What a name says of pack and weight, and not the name, decides whether a pair passes and at what prices; names that are alike come on top. Rivals of one key, store and kind
    stand in order of price, and those that pass lie side by side there: the first is looked up, after as many as the blacklist may take away. So the work grows with the rows by the kinds
    of names, not with the pairs, which a placeholder code has by the square.
    """
    within = lambda rows, keys: rows.withColumn("key", F.explode(keys)).join(F.broadcast(crowded), "key")
    asks, offers = within(mine, "my_keys").drop("my_keys"), within(theirs, "their_keys")
    no = F.lit(None)
    by_kind = F.struct("key", "store_id", "sure", "their_pack", "their_stated", "their_grams", no.cast("string").alias("name"))
    by_name = F.struct("key", "store_id", "sure", no.cast("int").alias("their_pack"), no.cast("int").alias("their_stated"), no.cast("double").alias("their_grams"), F.col("rival_name").alias("name"))
    alike = alike_names(asks, offers.where("NOT sure"))
    named = offers.where("NOT sure").join(alike.select("rival_name").distinct(), "rival_name", "left_semi")

    groups = offers.withColumn("group", by_kind).select("key", "store_id", "sure", "their_pack", "their_stated", "their_grams", "group").distinct()
    kinds = asks.select("key", "my_pack", "my_stated", "my_grams").distinct().join(groups, "key").where(_fits())
    at_any_price = F.col("sure") | _same_stated()
    kinds = kinds.select("key", "store_id", "my_pack", "my_stated", "my_grams", "group", at_any_price.alias("any"))
    asked = asks.join(kinds, ["key", "my_pack", "my_stated", "my_grams"])
    by_names = asks.join(alike, "my_name").join(named.select("key", "store_id", "rival_name", by_name.alias("group")).distinct(), ["key", "rival_name"]).withColumn("any", F.lit(True))
    asked = asked.unionByName(by_names.select(*asked.columns))
    any_price = F.col("any") | F.coalesce(F.col("my_cents") <= 0, F.lit(True))
    asked = asked.select(
        "key", "store_id", "my_sku", "my_cents", "my_literals", "group", F.when(any_price, F.lit(1).cast("long")).otherwise(F.floor(F.col("my_cents") / DOUBT_RATIO) + 1).alias("least"), F.when(~any_price, F.col("my_cents") * DOUBT_RATIO).alias("below")
    )
    if blacklist is None:
        asked = asked.withColumn("spare", F.lit(0).cast("long"))
    else:
        no_pairs = blacklist.select("my_sku", "rival_sku").distinct()
        spare = offers.select("key", "store_id", "rival_sku").join(no_pairs, "rival_sku").groupBy("key", "store_id", "my_sku").agg(F.count("*").alias("spare"))
        asked = asked.join(spare, ["key", "store_id", "my_sku"], "left").withColumn("spare", F.coalesce("spare", F.lit(0).cast("long")))
    standing = [offers.withColumn("group", by_kind), named.withColumn("group", by_name)]
    columns = ["group", "rival_cents", "rival_sku", "their_keys", "their_literals", "sure"]
    found = first_offers(asked.drop("key"), standing[0].select(*columns).unionByName(standing[1].select(*columns)))
    found = found.where(F.coalesce(F.col("rival_cents") < F.col("below"), F.lit(True))).drop("least", "below", "spare")
    return found if blacklist is None else found.join(no_pairs, ["my_sku", "rival_sku"], "left_anti")


def _matched(own: DataFrame, rivals: DataFrame, blacklist: DataFrame | None, confirmed: DataFrame | None) -> DataFrame:
    """Both sides, what their names say and the crowded keys are written first: they are read several times."""
    named = F.coalesce("name", F.lit(""))
    mine = stored(own.select(F.col("sku").alias("my_sku"), F.col("keys").alias("my_keys"), F.col("literals").alias("my_literals"), named.alias("my_name"), F.col("cents").alias("my_cents")), "matching-own")
    theirs = stored(rivals.where("cents > 0").select(F.col("sku").alias("rival_sku"), "store_id", F.col("keys").alias("their_keys"), F.col("literals").alias("their_literals"), named.alias("rival_name"), F.col("cents").alias("rival_cents")), "matching-rivals")
    if confirmed is None:
        theirs = theirs.withColumn("sure", F.lit(False))
    else:
        theirs = theirs.join(confirmed.select("rival_sku").distinct().withColumn("sure", F.lit(True)), "rival_sku", "left").withColumn("sure", F.coalesce("sure", F.lit(False)))
    crowded = stored(crowded_keys(mine, theirs), "matching-crowded")
    names = stored(said(mine.select(F.col("my_name").alias("name")).union(theirs.select("rival_name"))), "matching-names")
    names = F.broadcast(names) if names.count() <= BROADCAST_NAMES else names
    saying = lambda of, name: names.select(F.col("name").alias(name), *(F.col(c).alias(f"{of}_{c}") for c in ("pack", "stated", "grams", "words")))
    mine, theirs = mine.join(saying("my", "my_name"), "my_name"), theirs.join(saying("their", "rival_name"), "rival_name")

    def ruled(pairs: DataFrame) -> DataFrame:
        if blacklist is not None:
            pairs = pairs.join(blacklist.select("my_sku", "rival_sku").distinct(), ["my_sku", "rival_sku"], "left_anti")
        return pairs.where(_fits())

    sane = F.col("sure") | _sane(F.col("my_cents"), F.col("rival_cents"), _same_stated(), F.col("my_words"), F.col("their_words"))
    literal = F.arrays_overlap("my_literals", F.array_union("their_literals", "their_keys"))
    shown = ("my_sku", "rival_sku", "store_id", "my_cents", "rival_cents")
    keyed = ruled(joined_on_keys(mine, theirs, crowded)).where(sane)
    keyed = keyed.select(*shown, "sure", literal.alias("literal")).unionByName(stored(best_of_crowd(mine, theirs, crowded, blacklist).select(*shown, "sure", literal.alias("literal")), "matching-crowd"))
    by_barcode = keyed.select(*shown, F.when(F.col("sure"), 100).otherwise(99).alias("confidence"), F.lit("barcode").alias("method"), F.when(F.coalesce("literal", F.lit(False)), "literal").otherwise("gtin14").alias("barcode_key"))
    by_sku = ruled(mine.join(theirs, F.col("my_sku").cast("string") == F.col("rival_sku").cast("string")))
    by_sku = by_sku.select(*shown, F.when(F.col("sure"), 100).otherwise(95).alias("confidence"), F.lit("sku").alias("method"), F.lit(None).cast("string").alias("barcode_key"))
    # products without any match by barcode are those that are looked up by sku
    coded = F.max(F.col("method") == "barcode").over(Window.partitionBy("my_sku"))
    rows = by_barcode.unionByName(by_sku).withColumn("coded", coded).where(~F.col("coded") | (F.col("method") == "barcode")).drop("coded")
    best = F.row_number().over(Window.partitionBy("my_sku", "store_id").orderBy(F.desc("confidence"), F.asc("rival_cents"), "rival_sku"))
    diff = F.round((F.col("rival_cents") - F.col("my_cents")) * 100 / F.col("my_cents"), 1)
    position = F.when(F.col("rival_cents") > F.col("my_cents"), "cheaper").when(F.col("rival_cents") == F.col("my_cents"), "equal").otherwise("expensive")
    rows = rows.withColumn("best", best).where("best = 1").drop("best")
    rows = rows.withColumn("diff_pct", diff).withColumn("position", position)
    return rows.withColumn("flags", F.when((F.col("method") == "sku") & (F.abs("diff_pct") > 40), "SUSPICIOUS_PRICE").otherwise(""))


def seller_set(pairs: DataFrame) -> DataFrame:
    """my_sku, other_sku: what matches (my_sku, rival_sku) join in two hops; itself aside."""
    direct = pairs.select(F.col("my_sku").alias("a"), F.col("rival_sku").alias("b")).distinct()
    reverse = direct.select(F.col("b").alias("a"), F.col("a").alias("b"))
    siblings = direct.alias("x").join(direct.alias("y"), F.col("x.b") == F.col("y.b")).select(F.col("x.a").alias("a"), F.col("y.a").alias("b"))
    return direct.unionByName(reverse).unionByName(siblings).where("a <> b").distinct().select(F.col("a").alias("my_sku"), F.col("b").alias("other_sku"))


def seller_hubs(pairs: DataFrame) -> DataFrame:
    """my_sku, other_sku, relation: all that seller_set() joins, without a row for each two products of a hub.

    'direct' rows are matches (my_sku, rival_sku) and 'reverse' rows their reverses, itself aside; 'hub' rows say that my_sku belongs to the
    hub other_sku. Products with a hub in common are siblings. The rows grow with the matches, however many share a hub. Nulls match nothing.
    """
    a, b = F.col("my_sku"), F.col("rival_sku")
    edges = pairs.select(a, b).where(a.isNotNull() & b.isNotNull()).distinct()
    row = lambda x, y, relation: F.struct(x.alias("my_sku"), y.alias("other_sku"), F.lit(relation).alias("relation"))
    rows = edges.select(F.inline(F.array(row(a, b, "direct"), row(b, a, "reverse"), row(a, b, "hub"))))
    return rows.where("relation = 'hub' OR my_sku <> other_sku")


def partners(hubs: DataFrame, asked: DataFrame) -> DataFrame:
    """my_sku, other_sku of the asked products (my_sku): their rows of seller_set(), from seller_hubs()."""
    mine = hubs.join(asked.select("my_sku").distinct(), "my_sku", "left_semi")
    members = hubs.where("relation = 'hub'").select(F.col("other_sku").alias("hub"), F.col("my_sku").alias("sibling"))
    siblings = mine.where("relation = 'hub'").select("my_sku", F.col("other_sku").alias("hub")).join(members, "hub").select("my_sku", F.col("sibling").alias("other_sku"))
    return mine.where("relation <> 'hub'").select("my_sku", "other_sku").unionByName(siblings).where("my_sku <> other_sku").distinct()


def price_alerts(pairs: DataFrame, least_pct: float = 15.0) -> DataFrame:
    """Per own product its cheapest match, where that is cheaper by the percentage."""
    cheapest = pairs.groupBy("my_sku").agg(F.min_by(F.struct("store_id", "rival_cents", "my_cents"), F.struct("rival_cents", "store_id")).alias("m"))
    gap = F.round((F.col("m.my_cents") - F.col("m.rival_cents")) * 100 / F.col("m.rival_cents"), 1)
    return cheapest.select("my_sku", "m.store_id", "m.rival_cents", "m.my_cents", gap.alias("gap_pct")).where(F.col("gap_pct") > least_pct)
