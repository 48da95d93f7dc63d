"""Mixing sources to target weights, by hash-threshold histograms. DataFrame functions only.

Every row has a hash, of its id, source and text. A source that shall give more or fewer words than it has takes each of its
documents a whole number of times, and those with a hash below the source's threshold once more. The threshold
is found from sums of words by source and hash bucket; only the bucket in which the budget ends is looked at again,
with finer buckets. Nothing is sorted by document, and a document's copies are nested: who is in a
smaller mix is in a larger one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarifa.llm.shared import join_small, seen, stored, word_count

#: Bits of the hash that each of the LEVELS histograms resolves.
BITS, LEVELS = 12, 3
KEYS = ["no_source", "source_key"]


def _measured() -> list:
    """Source, size in words, and a print of id, source and text, as columns over documents."""
    return [
        F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"), word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\x01"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), F.lit("\x01"), F.coalesce("text", F.lit("")))).alias("print"),
    ]


def _bits(md5):
    """The first BITS * LEVELS bits of a digest."""
    return F.conv(F.substring(md5, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def hashed(rows: DataFrame) -> DataFrame:
    """rows (print, ...) with `hash` in place of `print`: a row's own, though others have its id or its text.

    Repeats of one row (id, source and text) are numbered, and all but the first are hashed with their number. Which of them is first doesn't
    matter: they are alike. They are numbered part by part, so a row that a third of all rows repeat isn't one task's.
    """
    repeated = stored(rows.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "mix-repeats")
    if not seen(repeated)["rows"]:
        return rows.withColumn("hash", _bits("print")).drop("print")
    rows = stored(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "mix-numbered")
    rows = join_small(rows, repeated.withColumn("again", F.lit(True)), ["print"], "left", seen(repeated)["rows"])
    many = rows.where("again")
    before = Window.partitionBy("print").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = many.groupBy("print", "part").agg(F.count("*").alias("n")).select("print", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("print", "part").orderBy("at"))
    many = many.withColumn("number", within).join(parts, ["print", "part"]).withColumn("number", F.col("number") + F.col("before"))
    own = F.when(F.col("number") == 1, F.col("print")).otherwise(F.md5(F.concat("print", F.lit(":"), F.col("number").cast("string"))))
    rest = [c for c in rows.columns if c not in ("print", "part", "at", "again")]
    once = rows.where("again IS NULL").select(*rest, _bits("print").alias("hash"))
    return once.unionByName(many.select(*rest, _bits(own).alias("hash")))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a hash of BITS * LEVELS bits."""
    return hashed(docs.select("doc_id", "source", *_measured()))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """A target for each source: share of all words by weight, at most `most` times what the source has.

    Sources stand in code-point order, null last, and take the weights in turn. What capped sources leave is dealt
    to the others by weight until none is above: the level at which `weight * level` fills the budget. sources has
    a row for each source (a small dimension: one window orders it).
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(*KEYS)
    by_ratio = Window.orderBy("ratio", *KEYS)
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sources.withColumn("n", F.row_number().over(by_name)).withColumn("weight", w)
    ranked = ranked.withColumn("ratio", F.lit(most) * F.col("source_size") / F.col("weight")).withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
    ranked = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(after))
    ranked = ranked.withColumn("fits", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", *KEYS, "level"))).over(whole)["level"])
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.coalesce(F.col("fits"), F.lit(float("inf"))) * F.col("weight"))
    return ranked.select(*KEYS, "source_size", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source: copies that every document has, and the hash below which documents have one more."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    state = stored(state.withColumn("prefix", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long")), "mix-goals")
    sources, inside = seen(state)["rows"], rows  # each level has as many
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        if level > 1:  # only the bucket in which the budget ends
            at = state.select(*KEYS, "prefix")
            inside = join_small(rows, at, KEYS, rows=sources).where(F.shiftright("hash", shift + BITS) == F.col("prefix")).drop("prefix")
        sums = inside.where("size > 0").groupBy(*KEYS, F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("in_bucket"))
        up_to = Window.partitionBy(*KEYS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("after", F.sum("in_bucket").over(up_to)).join(state, KEYS)
        sums = sums.withColumn("after", F.col("after") + F.col("before"))
        ends = sums.where(F.col("after") > F.col("rest")).groupBy(*KEYS).agg(F.min(F.struct("bucket", "after", "in_bucket")).alias("end"))
        state = state.join(ends, KEYS, "left").select(
            *KEYS, "source_size", "target", "full", "rest",
            F.coalesce("end.bucket", F.shiftleft("prefix", BITS)).alias("prefix"),
            F.coalesce(F.col("end.after") - F.col("end.in_bucket"), F.col("before")).alias("before"),
            F.col("end.after").alias("after"),
        )
        state = stored(state, f"mix-level{level}")
        if level < LEVELS:
            state = state.drop("after")
    nearer = F.coalesce(F.col("after") - F.col("rest") < F.col("rest") - F.col("before"), F.lit(False))
    return state.select(*KEYS, "source_size", "target", "full", (F.col("prefix") + nearer.cast("long")).alias("below"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs.

    Null texts and texts without words have size 0 and are taken as often as their hash says, for 0 words. A very long text counts with
    all its words. Rows are taken one by one: null and shared ids are told apart by their texts, repeated rows by their number, so
    each source comes within its largest document of its target. A null source is a source of its own, last in order. An empty table
    gives an empty result. Extra columns of docs are not read.
    """
    rows, bounds = _bounds(docs, weights, share, most)
    return join_small(rows, bounds, KEYS).select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies"), (_copies() * F.col("size")).alias("taken"))


def _bounds(docs: DataFrame, weights: tuple[int, ...], share: float, most: int) -> tuple[DataFrame, DataFrame]:
    """sized(docs), and each source's full copies and threshold."""
    rows = stored(sized(docs), "mix-sizes")
    goals = targets(rows.groupBy(*KEYS).agg(F.sum("size").alias("source_size")), weights, share, most)
    return rows, stored(thresholds(rows, goals), "mix-bounds")


def _copies():
    return F.col("full") + (F.col("hash") < F.col("below")).cast("long")


def repeated(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """Each row of docs, with all its columns, as often as mix() takes it; rows without words, taken for no words, go.

    Only the sources' thresholds are joined, so null, repeated and shared ids are taken as mix() says row by row, whatever docs' columns
    are called.
    """
    _, bounds = _bounds(docs, weights, share, most)
    rows = hashed(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *_measured()).where("size > 0"))
    rows = join_small(rows, bounds, KEYS).select("doc", _copies().alias("copies")).where("copies > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


ORACLE = r"""
WITH printed AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || chr(1) || coalesce('=' || source, '') || chr(1) || coalesce(text, '')) AS print FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY print) AS number FROM printed),
sized AS (
  SELECT doc_id, source, size, ('0x' || substr(CASE WHEN number = 1 THEN print ELSE md5(print || ':' || number) END, 1, 9))::BIGINT AS hash
  FROM numbered),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
         sum(source_size) OVER ()::DOUBLE AS total FROM sources),
ratios AS (SELECT *, (3 * source_size) / weight::DOUBLE AS ratio FROM ranked),
levels AS (
  SELECT *, (total - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM ratios),
fits AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
goals AS (
  SELECT source, source_size,
    CASE WHEN source_size > 0 THEN least(3.0::DOUBLE * source_size, coalesce((SELECT level FROM fits), 'Infinity'::DOUBLE) * weight) ELSE 0.0::DOUBLE END AS target
  FROM levels),
rests AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM goals),
cells AS (SELECT source, hash, sum(size) AS words FROM sized WHERE size > 0 GROUP BY source, hash),
running AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY hash) AS after FROM cells),
extra AS (
  SELECT c.source, c.hash FROM running c JOIN rests r ON c.source IS NOT DISTINCT FROM r.source
  WHERE c.after <= r.target - r.copies * r.source_size
     OR (c.after - c.words <= r.target - r.copies * r.source_size
         AND c.after - (r.target - r.copies * r.source_size) < (r.target - r.copies * r.source_size) - (c.after - c.words)))
SELECT s.doc_id, s.size, r.source_size, r.target, (s.size * (r.copies + (e.hash IS NOT NULL)::INT))::BIGINT AS taken
FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source
LEFT JOIN extra e ON s.size > 0 AND e.source IS NOT DISTINCT FROM s.source AND e.hash = s.hash
"""


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
