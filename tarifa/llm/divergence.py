"""How far the sources of a language differ in their words: count-min prefilter, exact counts, sparse pair joins.

A term counts where at least `least` documents of its language have it; most terms have far fewer. A first pass counts documents by term
in a count-min sketch: each task adds up its own documents in ROWS rows of cells and sends its full cells, range by range; the owner of a
range adds them, and one bit a cell is left: whether it reached `least`. Cells never count too little, so a term one of whose bits is
missing is in too few documents. A second pass counts the other terms by language and source, summed in each task before anything is
shuffled; the sums give the terms that are kept, exactly.

Most terms are missing from most sources. With z the share of a missing term, and p of one that is there, the distance of two sources is that of
their z over all kept terms, changed by what either has (found from how often each p occurs in a source) and again by what
both have (a join of the sources that hold a term).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa.llm import terms
from tarifa.llm.shared import BROADCAST_ROWS, forget, join_small, mix64, seen, stored, top

#: Rows of the sketch; log2 of a row's cells: least, most, and cells for each document in between; ranges in which it is merged.
ROWS, LEAST_BITS, MOST_BITS, CELLS_A_DOC, RANGES = 3, 16, 27, 16, 64
#: Counters that a task holds before it passes on what it has.
HELD = 400_000
#: Shares are parts of a milliard; SMOOTH is added to each count.
UNIT, SMOOTH = 1_000_000_000, 5


def _cells(found: list[bytes], lang: str, bits: int) -> np.ndarray:
    """The cell of each term in each row of the sketch, rows one after another."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    own = np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in found), np.uint64, len(found))
    rows = np.arange(1, ROWS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    cells = mix64(own[None, :] + rows) >> np.uint64(64 - bits)
    return cells.astype(np.int64) + (np.arange(ROWS)[:, None] << bits)


def _sent(bits: int, least: int):
    """A task's part of the sketch: its full cells by range, and how many documents each has, `least` at most."""
    width = (ROWS << bits) // RANGES

    def part(held: dict[str, Counter]) -> pa.RecordBatch:
        cells, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lang, counts in held.items():
            cells.append(_cells(list(counts), lang, bits).ravel())
            times.append(np.tile(np.fromiter(counts.values(), np.int64, len(counts)), ROWS))
        cells, times = np.concatenate(cells), np.concatenate(times)
        order = np.argsort(cells)
        cells, times = cells[order], times[order]
        first = np.flatnonzero(np.diff(cells, prepend=-1))
        cells, times = cells[first], np.minimum(np.add.reduceat(times, first) if len(first) else times, least).astype("<u4")
        cuts = np.searchsorted(cells, np.arange(RANGES + 1) * width)
        some = np.flatnonzero(np.diff(cuts)).tolist()
        rows = [(cells[cuts[i] : cuts[i + 1]] - i * width, times[cuts[i] : cuts[i + 1]]) for i in some]
        steps = [np.diff(c, prepend=0).astype("<u4").tobytes() for c, _ in rows]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(steps, pa.binary()), pa.array([t.tobytes() for _, t in rows], pa.binary())], ["range", "cells", "times"])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, size = defaultdict(Counter), 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), terms.texts(batch.column("text"))):
                own, before = held[lang], len(held[lang])
                own.update({w for words in terms.split(text, terms.LETTERS) for w in words})
                size += len(own) - before
                if size >= HELD:
                    yield part(held)
                    held, size = defaultdict(Counter), 0
        if size:
            yield part(held)

    return sent


def _merged(bits: int, least: int):
    """Of each range, whether its cells reach `least`; rows come in one at a time, and a range is held as its cells."""
    width = (ROWS << bits) // RANGES

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, steps, times in zip(*(batch.column(c).to_pylist() for c in ("range", "cells", "times"))):
                full = held.setdefault(at, np.zeros(width, np.uint32))
                cells = np.cumsum(np.frombuffer(steps, "<u4").astype(np.int64))
                full[cells] = np.minimum(full[cells] + np.frombuffer(times, "<u4"), least)
        packed = [np.packbits(x >= least).tobytes() for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary())], ["range", "bits"])

    return merged


def sketch(docs: DataFrame, least: int) -> tuple[int, np.ndarray]:
    """log2 of a row's cells, and a bit for each cell of the sketch of docs (lang, text): may a term in it be in `least` documents?"""
    rows = docs.count()
    bits = min(max((rows * CELLS_A_DOC).bit_length(), LEAST_BITS), MOST_BITS)
    sent = docs.select("lang", "text").mapInArrow(_sent(bits, least), "range int, cells binary, times binary")
    parts = sent.repartition(RANGES, "range").mapInArrow(_merged(bits, least), "range int, bits binary").collect()  # ROWS << bits bits together
    out = np.zeros((ROWS << bits) // 8, np.uint8)
    wide = len(out) // RANGES
    for row in parts:
        out[row["range"] * wide : (row["range"] + 1) * wide] = np.frombuffer(row["bits"], np.uint8)
    return bits, out


def _counted(bits: int, shared):
    """A task's occurrences and documents of the terms that the sketch lets through, by language and source."""

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, documents) in held.items():
            found = list(times)
            cells = _cells(found, lang, bits)
            able = (shared.value[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).all(0)
            passed = [found[i] for i in np.flatnonzero(able).tolist()]
            if passed:
                columns = [pa.array([key] * len(passed), pa.string()) for key in (lang, source)]
                columns += [pa.array(passed, pa.binary()).cast(pa.string()), *(pa.array([counts[w] for w in passed], pa.int64()) for counts in (times, documents))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "times", "documents"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, size = defaultdict(lambda: (Counter(), Counter())), 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), terms.texts(batch.column("text"))):
                times, documents = held[lang, source]
                before, once = len(times), set()
                for words in terms.split(text, terms.LETTERS):
                    times.update(words)
                    once.update(words)
                documents.update(once)
                size += len(times) - before
                if size >= HELD:
                    yield from rows(held)
                    held.clear()
                    size = 0
        yield from rows(held)

    return counted


def counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, source, term, times, documents: exact counts of all terms that may be in `least` documents of their language."""
    bits, full = sketch(docs, least)
    shared = docs.sparkSession.sparkContext.broadcast(full)  # ROWS << MOST_BITS bits at most
    found = docs.select("lang", "source", "text").mapInArrow(_counted(bits, shared), "lang string, source string, term string, times bigint, documents bigint")
    keys = ["lang", "source", "term"]
    return found.repartition(*keys).groupBy(*keys).agg(  # tasks have summed what is theirs, so summing again before the shuffle would find nothing
        F.sum("times").alias("times"), F.sum("documents").alias("documents")
    )


def _share(times: Column, size: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (times + SMOOTH) / (size + SMOOTH * kept)), in decimals as wide as it takes; 0 where nothing is kept."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (times + SMOOTH).cast("decimal(20,0)")
    below = (size + SMOOTH * kept).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", above, below)).otherwise(F.lit(0)).cast("long")


def audit(docs: DataFrame, least: int = 30, most_terms: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank over docs (text, lang, source).

    Part `pair` has every other source of the language as item, and as value the sum over the language's kept terms of how far the two
    sources' shares of it are apart; part `term` has the `most_terms` kept terms that the source has in larger shares than its
    language, and by how much. Null text, lang and source are ''; so null and empty are one group. Whole texts are read; repeated rows count as often as they stand. Equal values are ranked by
    item. A group without terms takes part in pairs; where no term is kept all values of `pair` are 0 and `term` has no rows. An empty
    table gives an empty result; extra columns are not read.
    """
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), "text")
    found = stored(counts(docs, least), "divergence-counts")
    kept = found.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("times").alias("lang_times")).where(F.col("documents") >= least)
    cells = stored(found.join(kept.drop("documents"), ["lang", "term"]).drop("documents"), "divergence-cells")

    langs = cells.groupBy("lang", "term").agg(F.sum("times").alias("times")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("times").alias("lang_size"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("times").alias("size"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["size", "kept", "lang_size"])
    groups = stored(groups.withColumn("z", _share(F.lit(0).cast("long"), F.col("size"), F.col("kept"))), "divergence-groups")

    shares = join_small(cells, groups, ["lang", "source"]).select("lang", "source", "term", "z", _share(F.col("times"), F.col("size"), F.col("kept")).alias("p"), _share(F.col("lang_times"), F.col("lang_size"), F.col("kept")).alias("q"))
    shares = stored(shares, "divergence-shares")
    above = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    above = top(above, ["lang", "source"], [F.desc("value"), "item"], most_terms)

    few = seen(groups)["rows"] <= BROADCAST_ROWS
    others = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("other_z"))
    others = F.broadcast(others) if few else others
    apart = F.abs(F.col("z") - F.col("other_z"))
    missing = groups.join(others, "lang").where("source < other").select("lang", "source", "other", (F.col("kept") * apart).alias("value"))
    often = shares.groupBy("lang", "source", "z", "p").agg(F.count("*").alias("n"))
    either = often.join(others, "lang").where("source != other").select("lang", F.least("source", "other").alias("source"), F.greatest("source", "other").alias("other"), (F.col("n") * (F.abs(F.col("p") - F.col("other_z")) - apart)).alias("value"))
    second = shares.select("lang", "term", F.col("source").alias("other"), F.col("z").alias("other_z"), F.col("p").alias("other_p"))
    p, other_p = F.col("p"), F.col("other_p")
    both = shares.join(second, ["lang", "term"]).where("source < other").select("lang", "source", "other", (F.abs(p - other_p) - F.abs(p - F.col("other_z")) - F.abs(F.col("z") - other_p) + apart).alias("value"))
    summed = [x.groupBy("lang", "source", "other").agg(F.sum("value").alias("value")) for x in (missing, either, both)]
    pairs = summed[0].unionByName(summed[1]).unionByName(summed[2]).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))).alias("side")
    pairs = pairs.select("lang", sides, "value").select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pairs.unionByName(above)


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
words AS (SELECT doc, lang, source, unnest(terms) AS term FROM docs),
counted AS (SELECT lang, source, term, count(*) AS times FROM words GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS lang_times FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
found AS (SELECT DISTINCT lang, source FROM docs),
cells AS (
    SELECT g.lang, g.source, k.term, k.lang_times, CAST(coalesce(c.times, 0) AS HUGEINT) AS times
    FROM found AS g JOIN kept AS k ON k.lang = g.lang LEFT JOIN counted AS c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sized AS (
    SELECT *, sum(times) OVER (PARTITION BY lang, source) AS size, count(*) OVER (PARTITION BY lang, source) AS kept, sum(times) OVER (PARTITION BY lang) AS lang_size FROM cells),
shares AS (
    SELECT lang, source, term, times, CAST(1 + (1000000000 * (times + 5)) // CAST(size + 5 * kept AS HUGEINT) AS BIGINT) AS p,
        CAST(1 + (1000000000 * CAST(lang_times + 5 AS HUGEINT)) // CAST(lang_size + 5 * kept AS HUGEINT) AS BIGINT) AS q
    FROM sized),
apart AS (
    SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
    FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
    FROM found AS a JOIN found AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart AS x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
parts AS (
    SELECT lang, source, part, item, value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE times > 0 AND p > q),
ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranks WHERE part = 'pair' OR rank <= 50
"""
