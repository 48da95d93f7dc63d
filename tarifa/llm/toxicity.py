"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms and of their beginnings, each hashed to one of 2**BITS features. Its logit is a bias, a weight for each
feature that it has, and for each pair of these the product of two learned vectors: so two terms together, such as an insult and the
mention of a group, can count for more, or less, than both alone. No pair is enumerated: their sum is found from the sums of the vectors and
of their squares.

The model is fitted on a bounded sample: the first TRAINING labelled documents by hash of those outside the held-out quarter, whole texts.
Of the features of LEAST_DOCS of them or more, the FEATURES that go furthest from the base rate are learned; the driver gets those only.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifa.llm import terms
from tarifa.llm.shared import REMEMBERED, forget, stored

TRAINING, FEATURES, LEAST_DOCS, THRESHOLD = 40_000, 4096, 3, 0.3
#: log2 of the features that terms are hashed to; characters of the beginnings; terms that a worker remembers.
BITS, BEGINNINGS, MOST_KNOWN = 20, (3, 4, 5), 300_000


def hashed(term: bytes) -> tuple[int, ...]:
    """The features of a term: its own and those of its beginnings."""
    found = [zlib.crc32(term) >> (32 - BITS)]
    chars = term.decode("utf-8", "replace")
    for n in BEGINNINGS:
        if len(chars) > n:
            found.append(zlib.crc32(b"^" + chars[:n].encode("utf-8", "replace")) >> (32 - BITS))
    return tuple(found)


def features(text: bytes, known: dict[bytes, tuple], wanted: dict[int, int] | None = None) -> set[int]:
    """The features of a whole text; with wanted, the numbers that it gives them, and no others. known: what terms have come to so far."""
    if len(known) > MOST_KNOWN:
        known.clear()
    found: set[int] = set()
    for term in {w for words in terms.split(text, terms.LETTERS) for w in words}:
        own = known.get(term)
        if own is None:
            own = hashed(term)
            own = known[term] = own if wanted is None else tuple(wanted[f] for f in own if f in wanted)
        if own:
            found.update(own)
    return found


def logits(model: dict, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logits of documents whose features stand end to end, sorted or not, and the sums of their vectors."""
    own = model["v"][at]
    begin = ends - np.diff(ends, prepend=0)
    linear, total, square = (_sums(x, begin, ends) for x in (model["w"][at], own, own * own))
    return model["b"] + linear + 0.5 * (total * total - square).sum(1), total


def _sums(x: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of x over each document; 0 for one without features."""
    out = np.zeros((len(begin), *x.shape[1:]))
    some = begin < ends
    if some.any():
        out[some] = np.add.reduceat(x, begin[some])
    return out


def gradients(model: dict, at: np.ndarray, ends: np.ndarray, labels: np.ndarray) -> dict:
    """Of the mean cross-entropy, by what is learned."""
    logit, total = logits(model, at, ends)
    g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / len(labels)
    size = np.diff(ends, prepend=0)
    each = np.repeat(g, size)
    n = len(model["w"])
    gv = each[:, None] * (np.repeat(total, size, axis=0) - model["v"][at])
    return {"b": g.sum(), "w": np.bincount(at, each, n), "v": np.stack([np.bincount(at, gv[:, i], n) for i in range(gv.shape[1])], 1)}


def fit(bags: list[np.ndarray], labels: np.ndarray, n: int, width: int = 8, epochs: int = 12, rate: float = 0.05, decay: float = 1e-4, seed: int = 11) -> dict:
    """The model, by Adam over documents (arrays of their features, each below n); without two classes it is the base rate."""
    rng = np.random.default_rng(seed)
    mean = (labels.sum() + 0.5) / (len(labels) + 5)  # where nothing is known, a document is rather clean
    model = {"b": float(np.log(mean / (1 - mean))), "w": np.zeros(n), "v": rng.normal(0, 0.05, (n, width))}
    if not len(labels) or labels.min() == labels.max() or not n:
        return model | {"v": np.zeros((n, width))}
    first, second, t = {k: np.zeros_like(x) for k, x in model.items()}, {k: np.zeros_like(x) for k, x in model.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), 256):
            docs = order[a : a + 256]
            ends = np.cumsum([len(bags[d]) for d in docs])
            grads, t = gradients(model, np.concatenate([bags[d] for d in docs]).astype(np.int64), ends, labels[docs]), t + 1
            for k, g in grads.items():
                g = g + decay * model[k] if k != "b" else g
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model[k] = model[k] - rate * 0.8**epoch * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether the id's CRC-32 puts it in the held-out quarter; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    known: dict[bytes, tuple] = {}
    for batch in batches:
        own = [sorted(features(text, known)) for text in terms.texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("print"), pa.array(own, pa.list_(pa.int32()))], ["label", "print", "features"])


def _numbered(wanted: dict[int, int]) -> Callable:
    """The numbers of the learned features of each row."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.array(sorted(wanted[f] for f in row if f in wanted), np.int32).tobytes() for row in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("print"), pa.array(own, pa.binary())], ["label", "print", "features"])

    return numbered


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING, most_features: int = FEATURES) -> dict:
    """Fit on the first `most` labelled documents by hash of their id; a doc_id with several texts gives each of them, up to `most`.

    Of several labels of an id the greatest holds; null ids and labels are left out. The driver gets, of `most` documents, the features that are learned.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # `most` rows at most
    texts = texts.select("label", F.xxhash64("doc_id", "text").alias("print"), "text")
    prints = texts.select("print").distinct().orderBy("print").limit(most)  # fewer only where ids have several texts
    texts = texts.join(F.broadcast(prints), "print")
    found = stored(texts.mapInArrow(_with_features, "label double, print bigint, features array<int>").dropDuplicates(["print"]), "toxicity-sample")
    whole = found.agg(F.avg("label"), F.count("*")).first()
    if not whole[1]:
        return {"wanted": {}} | fit([], np.zeros(0), 0)
    rate = min(max(whole[0], 1e-6), 1 - 1e-6)
    each = found.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS)
    far = F.abs(F.col("toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    chosen = [r.feature for r in each.orderBy(far.desc(), "feature").limit(most_features).select("feature").collect()]  # most_features rows
    wanted = {f: i for i, f in enumerate(sorted(chosen))}
    rows = found.mapInArrow(_numbered(wanted), "label double, print bigint, features binary").collect()  # `most` rows of learned features
    rows.sort(key=lambda r: r.print)
    bags = [np.frombuffer(r.features, np.int32) for r in rows]
    return {"wanted": wanted} | fit(bags, np.array([r.label for r in rows]), len(wanted))


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); nothing is shuffled.

    Whole texts are scored. Null and empty texts and those without a learned feature have the score of the bias; repeated rows are scored alike, so ties don't matter; a null
    doc_id stays null and isn't held out; an empty table gives an empty result; extra columns are not read.
    """
    wanted, learned = model["wanted"], {k: model[k] for k in ("b", "w", "v")}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("toxicity")
        mine = REMEMBERED.setdefault("toxicity", {})
        if mine.get("wanted") != wanted:  # what terms come to under another model
            mine.clear()
            mine.update(wanted=wanted, known={})
        for batch in batches:
            found = [np.fromiter(own, np.int64, len(own)) for own in (features(text, mine["known"], wanted) for text in terms.texts(batch.column("text")))]
            ends = np.cumsum([len(x) for x in found], dtype=np.int64)
            logit = logits(learned, np.concatenate([np.zeros(0, np.int64), *found]), ends)[0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], ["doc_id", "score"])

    scores = docs.select("doc_id", "text").mapInArrow(scored, "doc_id bigint, score double")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels))
