"""Ranked lexical search: a hierarchical max tree over document ranges for each term, searched best-first.

One pass over the documents keeps, of each, its length in terms and how often it has each term that some item asks for; that table is
written to the shared folder, and gives the corpus counts. A shard is a run of about SHARD_DOCS documents of one of its parts. In a
shard, documents are ordered by the least hash of their terms, which puts similar ones together, and by length, and cut into ranges of FAN, those
into ranges of FAN ranges, and so on; each term has, for each range that holds it, the most that it can add to a score there. The sum of these over an item's terms bounds every score in a range. The search opens
the range with the highest bound, until the bounds left are below the k-th score; ranges whose bound equals it are
opened, because ties go to the least doc_id.

First every task dives: for each item and shard it follows the highest bound down to one range of documents. The k-th best of all
scores found so is a floor, below which no range is opened in the search proper. Floors only save work.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.llm import terms
from tarifa.llm.shared import forget, lower_ascii, mix64, stored, top

#: Ranges in a range; documents and postings of a shard.
FAN, SHARD_DOCS, SHARD_POSTINGS = 16, 4096, 2_000_000
#: Characters of items that are searched together: their terms and floors are sent to every task.
BLOCK_CHARS = 2_000_000
_NODES = np.int64(32)  # a posting's key: term, and below these bits its node


@dataclass
class Items:
    """Items searched together: the number of each term, and of each item its terms' numbers."""

    numbers: dict[bytes, int]
    terms: list[np.ndarray]


class Tree:
    """The maxima of a shard: at each level, sorted keys (term, node) and the most that the term adds to a score in that node, without its weight.

    Level 0 has the documents themselves.
    """

    def __init__(self, document: np.ndarray, term: np.ndarray, value: np.ndarray, documents: int):
        keys = term.astype(np.int64) << _NODES | document
        order = np.argsort(keys)
        self.levels, self.sizes = [(keys[order], value[order])], [documents]
        while self.sizes[-1] > 1:
            keys, value = self.levels[-1]
            above = keys >> _NODES << _NODES | (keys & ((1 << _NODES) - 1)) // FAN
            first = np.flatnonzero(np.diff(above, prepend=-1))
            self.levels.append((above[first], np.maximum.reduceat(value, first) if len(first) else value))
            self.sizes.append(-(-self.sizes[-1] // FAN))

    def bounds(self, level: int, first: int, last: int, asked: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The bounds of the nodes from first to last, for terms (sorted) with these weights; at level 0 they are the scores."""
        keys, value = self.levels[level]
        base = asked << _NODES
        low = keys.searchsorted(base | first)
        n = keys.searchsorted(base | last) - low
        ends = n.cumsum()
        at = (low - ends + n).repeat(n)
        at += np.arange(ends[-1])
        out = np.zeros(last - first, np.int64)
        np.add.at(out, (keys[at] & ((1 << _NODES) - 1)) - first, weights.repeat(n) * value[at])
        return out

    def children(self, level: int, node: int) -> tuple[int, int]:
        """The nodes one level below."""
        return node * FAN, min(node * FAN + FAN, self.sizes[level - 1])

    def dive(self, asked: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The scores of one range of documents, that of the highest bound at each level."""
        level, first, last = len(self.levels) - 1, 0, 1
        while level:
            node = first + int(self.bounds(level, first, last, asked, weights).argmax())
            first, last = self.children(level, node)
            level -= 1
        return self.bounds(0, first, last, asked, weights)

    def search(self, asked: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Offer to best every document that may be among its k."""
        top = len(self.levels) - 1
        queue = [(-int(self.bounds(top, 0, 1, asked, weights)[0]), top, 0)]
        while queue:
            bound, level, node = heapq.heappop(queue)
            if -bound < best.least():
                return
            first, last = self.children(level, node) if level else (node, node + 1)  # a single document is the whole tree
            below = self.bounds(max(level - 1, 0), first, last, asked, weights)
            for i in (below >= best.least()).nonzero()[0].tolist():
                if level > 1:
                    heapq.heappush(queue, (-int(below[i]), level - 1, first + i))
                else:
                    best.offer(int(below[i]), first + i)


class Best:
    """The k best documents of an item so far, over a task's shards: by score, then by ascending doc_id, null last."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor, self.heap, self.ids = k, max(floor, 1), [], None

    def least(self) -> int:
        """A score below this is not wanted."""
        return max(self.floor, self.heap[0][0]) if len(self.heap) == self.k else self.floor

    def offer(self, score: int, document: int) -> None:
        doc_id = self.ids[document]
        entry = (score, -math.inf if doc_id is None else -doc_id)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        else:
            heapq.heappushpop(self.heap, entry)


def _counted(numbers: dict[bytes, int]) -> Callable:
    """Of each text, its length in terms, and the numbers and occurrences of the asked terms in it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        get = numbers.get
        for batch in batches:
            length, ends, found, times = array("q"), array("i", [0]), array("i"), array("q")
            for text in terms.texts(batch.column("text")):
                n, counts = 0, Counter()
                for words in terms.split(text, terms.ALPHANUMERIC):
                    n += len(words)
                    counts.update(map(get, words))
                counts.pop(None, None)
                length.append(n)
                found.extend(counts.keys())
                times.extend(counts.values())
                ends.append(len(found))
            at = pa.array(np.frombuffer(ends, np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(np.frombuffer(x, t), kind)) for x, t, kind in ((found, np.int32, pa.int32()), (times, np.int64, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.frombuffer(length, np.int64)), *lists], ["doc_id", "n", "terms", "times"])

    return counted


def _shards(batches: Iterator[pa.RecordBatch], documents: int, total: int) -> Iterator[tuple[list, Tree]]:
    """Doc ids and tree of each shard; documents with none of the terms are left out."""
    ids, parts, held = [], [], 0

    def made() -> tuple[list, Tree]:
        n, size, term, times = (np.concatenate(x) for x in zip(*parts))
        least = np.minimum.reduceat(mix64(term.astype(np.uint64)), np.cumsum(size) - size)
        order = np.lexsort((n, least))
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        m = 10 + (90 * n * documents) // max(total, 1)
        value = (1_000_000_000 * times) // (1000 * times + 8 * np.repeat(m, size))
        return [ids[i] for i in order.tolist()], Tree(np.repeat(place, size), term, value, len(n))

    for batch in batches:
        offsets = batch.column("terms").offsets.to_numpy()
        size = np.diff(offsets)
        n, term, times = batch.column("n").to_numpy(), batch.column("terms").values.to_numpy(), batch.column("times").values.to_numpy()
        doc, at = batch.column("doc_id").to_pylist(), 0
        while at < len(batch):
            last = min(at + SHARD_DOCS - len(ids), len(batch), max(at + 1, int(offsets.searchsorted(offsets[at] + SHARD_POSTINGS - held, "right")) - 1))
            some = np.flatnonzero(size[at:last]) + at
            if len(some):
                parts.append((n[some], size[some], term[offsets[at] : offsets[last]], times[offsets[at] : offsets[last]]))
                ids += [doc[i] for i in some.tolist()]
                held += int(offsets[last] - offsets[at])
            at = last
            if len(ids) >= SHARD_DOCS or held >= SHARD_POSTINGS:
                yield made()
                ids, parts, held = [], [], 0
    if ids:
        yield made()


def _searched(items: Items, weights: np.ndarray, documents: int, total: int, k: int, floors: list[int] | None) -> Callable:
    """Over a part's shards: the k best documents of each item, or without floors the k best scores of the dives."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        best = [Best(k, floors[i] if floors else 1) for i in range(len(items.terms))]
        for ids, tree in _shards(batches, documents, total):
            for own, asked in zip(best, items.terms):
                if not len(asked):
                    continue
                own.ids = ids
                if floors:
                    tree.search(asked, weights[asked], own)
                    continue
                scores = tree.dive(asked, weights[asked])
                for score in scores[scores >= own.least()].tolist():
                    own.offer(score, 0)
        for i, own in enumerate(best):
            if own.heap:
                ids = [None if x == -math.inf else -x for _, x in own.heap]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array([x for x, _ in own.heap], pa.int64())], ["item", "doc_id", "score"])

    return searched


def _blocks(items: DataFrame) -> Iterator[list]:
    """Distinct items (item_id, text) in blocks of about BLOCK_CHARS characters."""
    items = items.select("item_id", lower_ascii(F.col("text")).alias("text")).distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-size // BLOCK_CHARS)
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield sorted(((r.item_id, r.text) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))  # a block's items


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: of each item (item_id, text) the k rows of docs (doc_id, text) with the highest scores above 0.

    Whole texts are read. A term weighs floor(1000*ln((2*N+2)/(2*df+1))); a document's score adds, for each of the item's terms that it has, that
    weight times its occurrences against the document's length. Every row of docs is a document, repeated rows too; null texts and
    texts without terms have no score and count in no N. Equal scores stand by ascending doc_id, null ids last. Items are distinct pairs of
    item_id and text: repeats are searched once, texts under one id each have their list. Items without terms, and all items where docs is
    empty, have no rows; extra columns are not read.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    found = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in _blocks(items):
        asked = [sorted({w for words in terms.split(text.encode(), terms.ALPHANUMERIC) for w in words}) for _, text in block]
        numbers = {w: i for i, w in enumerate(sorted({w for words in asked for w in words}))}
        own = Items(numbers, [np.array([numbers[w] for w in words], np.int64) for words in asked])
        # Strings are valid Unicode, so their UTF-8 tells terms apart as their characters do.
        index = stored(docs.mapInArrow(_counted(numbers), "doc_id bigint, n bigint, terms array<int>, times array<bigint>"), "search-index")
        documents, total = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row for each term of the block
        weights = np.zeros(len(numbers), np.int64)
        for row in holding:
            weights[row["term"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * row["count"] + 1)))
        kind = "item int, doc_id bigint, score bigint"
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        dives = top(index.mapInArrow(_searched(own, weights, documents, total, k, None), kind), ["item"], order, k)
        floors = [1] * len(block)
        for row in dives.where(F.col("rank") == k).select("item", "score").collect():  # a row for each item of the block
            floors[row["item"]] = row["score"]
        best = top(index.mapInArrow(_searched(own, weights, documents, total, k, floors), kind), ["item"], order, k)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id bigint")
        found = found.unionByName(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return found


def query(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, {_TERMS} AS terms FROM documents),
sized AS (SELECT doc, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS total FROM sized),
items AS (SELECT row_number() OVER () AS item, item_id, terms FROM (SELECT DISTINCT item_id, {_TERMS} AS terms FROM benchmark)),
asked AS (SELECT DISTINCT item, item_id, unnest(terms) AS term FROM items),
postings AS (
    SELECT doc, doc_id, n, term, count(*) AS times FROM (SELECT doc, doc_id, n, unnest(terms) AS term FROM sized)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * documents + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
    FROM postings, totals GROUP BY term, documents),
scores AS (
    SELECT item, item_id, doc, doc_id,
        CAST(sum(weight * ((1000000000 * times) // (1000 * times + 8 * (10 + (90 * n * documents) // total)))) AS BIGINT) AS score
    FROM asked JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY ALL),
ranks AS (
    SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank
    FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 10
"""
