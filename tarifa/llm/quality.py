"""A quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE words. Each passage is encoded from its characters and words; gated attention, learned
from the labels of whole documents, weighs the encodings, and their weighted sum is scored. Every passage of every
text counts. The model is fitted on the driver, on a bounded sample: the first TRAINING labelled documents by hash of those outside the
held-out fifth, as far as TRAINING_PASSAGES passages go, a document having DOCUMENT_PASSAGES at most, evenly spaced over its whole text. No
label, language, source or id is an input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa.llm.shared import WORD, blocks, hashes, rolling, utf8, word_ranges

PASSAGE, TRAINING, TRAINING_PASSAGES, DOCUMENT_PASSAGES, THRESHOLD = 64, 4_000, 60_000, 512, 0.3
BLOCK_BYTES = 2 << 20
#: Hashed pairs of neighbouring bytes, after the plain features.
PAIRS = 48
_CLASSES = ("upper", "lower", "digit", "space", "line", "symbol", "bang", "bar", "stop", "mark", "wide")


def _class_of(byte: int) -> int:
    char = chr(byte)
    if byte >= 128:
        return 10
    for n, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\v\f\r", "\n", "#*$%&<>", "!", "|", ".,")):
        if char in chars:
            return n
    return 9


_CLASS = np.array([_class_of(b) for b in range(256)], np.int64)
FEATURES = len(_CLASSES) + 5 + PAIRS


def encode(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of texts laid end to end, and how many passages precede each text (one more than texts)."""
    starts, ends, words_before = word_ranges(offsets, data)
    n_words = np.diff(words_before)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))  # a text without words has one passage
    before = np.concatenate([[0], np.cumsum(n_passages)])
    total = int(before[-1])
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    passage_of = before[text_of] + (np.arange(len(starts)) - words_before[text_of]) // PASSAGE
    out = np.zeros((total, FEATURES), np.float32)
    byte_text = np.repeat(np.arange(len(n_words)), np.diff(offsets))
    last_word = np.searchsorted(starts, np.arange(len(data)), "right") - 1
    byte_passage = np.maximum(before[byte_text], np.where(last_word >= 0, passage_of[np.maximum(last_word, 0)] if len(starts) else 0, 0))
    k = len(_CLASSES)
    by_class = np.bincount(byte_passage * k + _CLASS[data], minlength=total * k).reshape(total, k)
    size = np.maximum(by_class.sum(1, keepdims=True), 1)
    out[:, :k] = by_class / size
    in_passage = np.bincount(passage_of, minlength=total)
    some = np.maximum(in_passage, 1)
    own = hashes(rolling(data), starts, ends)
    pairs = np.unique(np.stack([passage_of.astype(np.uint64), own]), axis=1) if len(own) < 2 else _distinct(passage_of, own)
    out[:, k] = np.bincount(pairs[0].astype(np.int64), minlength=total) / some  # different words
    again = np.zeros(len(own), bool)
    again[1:] = (own[1:] == own[:-1]) & (passage_of[1:] == passage_of[:-1])
    out[:, k + 1] = np.bincount(passage_of[again], minlength=total) / some
    out[:, k + 2] = np.bincount(passage_of, weights=ends - starts, minlength=total) / some / 16
    out[:, k + 3] = in_passage / PASSAGE
    out[:, k + 4] = np.log1p(np.repeat(n_words, n_passages)) / 10
    if len(data) > 1:
        pair = (data[:-1].astype(np.int64) * 31 + data[1:]) * 2654435761 >> 7
        counts = np.bincount(byte_passage[:-1] * PAIRS + pair % PAIRS, minlength=total * PAIRS).reshape(total, PAIRS)
        out[:, k + 5 :] = counts / size * 8
    return out, before


def _distinct(passage: np.ndarray, word: np.ndarray) -> np.ndarray:
    order = np.lexsort((word, passage))
    p, w = passage[order], word[order]
    first = np.ones(len(p), bool)
    first[1:] = (p[1:] != p[:-1]) | (w[1:] != w[:-1])
    return np.stack([p[first].astype(np.uint64), w[first]])


def _standard(model: dict, x: np.ndarray) -> np.ndarray:
    return (x - model["mean"].astype(np.float32)) / model["scale"].astype(np.float32)


def _forward(model: dict, x: np.ndarray, before: np.ndarray) -> dict:
    """x: features as _standard() gives them."""
    starts = before[:-1]
    h = np.tanh(x @ model["W"] + model["b"])
    v, u = np.tanh(h @ model["V"]), 1 / (1 + np.exp(-(h @ model["U"])))
    e = (v * u) @ model["a"]
    n = np.diff(before)
    weight = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
    weight /= np.repeat(np.add.reduceat(weight, starts), n)
    z = np.add.reduceat(weight[:, None] * h, starts)
    logit = z @ model["c"] + model["d"]
    return {"h": h, "v": v, "u": u, "weight": weight, "z": z, "logit": logit, "score": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}


def gradients(model: dict, x: np.ndarray, before: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict:
    """Of the weighted cross-entropy of documents, by what is learned."""
    f, n = _forward(model, x, before), np.diff(before)
    g = (f["score"] - labels) * weight
    gz = np.repeat(g[:, None] * model["c"], n, axis=0)
    ga = (gz * f["h"]).sum(1)
    ge = f["weight"] * (ga - np.repeat(np.add.reduceat(f["weight"] * ga, before[:-1]), n))
    gv, gu = ge[:, None] * model["a"] * f["u"] * (1 - f["v"] ** 2), ge[:, None] * model["a"] * f["v"] * f["u"] * (1 - f["u"])
    gh = (f["weight"][:, None] * gz + gv @ model["V"].T + gu @ model["U"].T) * (1 - f["h"] ** 2)
    return {"W": x.T @ gh, "b": gh.sum(0), "V": f["h"].T @ gv, "U": f["h"].T @ gu, "a": (f["v"] * f["u"]).T @ ge, "c": f["z"].T @ g, "d": np.array([g.sum()])}


def fit(x: np.ndarray, before: np.ndarray, labels: np.ndarray, width: int = 32, gates: int = 16, epochs: int = 14, seed: int = 7) -> dict:
    """The model, by Adam on whole documents."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    model = {"W": normal(FEATURES, width), "b": np.zeros(width), "V": normal(width, gates), "U": normal(width, gates), "a": np.zeros(gates), "c": normal(width), "d": np.zeros(1)}
    learned = list(model)
    model |= {"mean": x.mean(0) if len(x) else np.zeros(FEATURES), "scale": x.std(0) + 1e-3 if len(x) else np.ones(FEATURES)}
    if len(labels) == 0 or labels.min() == labels.max():  # nothing to tell apart
        model["c"] = np.zeros(width)
        model["d"] = np.array([0.0 if len(labels) == 0 else (2.0 if labels.max() > 0 else -2.0)])
        return model
    x = _standard(model, x)
    m1, m2, t = {k: np.zeros_like(model[k]) for k in learned}, {k: np.zeros_like(model[k]) for k in learned}, 0
    balance = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 128):
            docs = order[at : at + 128]
            rows = np.concatenate([np.arange(before[d], before[d + 1]) for d in docs])
            own = np.concatenate([[0], np.cumsum([before[d + 1] - before[d] for d in docs])])
            xs = x[rows]
            grads = gradients(model, xs, own, labels[docs], balance[docs] / len(docs))
            t += 1
            for k in learned:
                grad = grads[k] + 1e-4 * model[k]
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
                model[k] = model[k] - 0.01 * 0.9**epoch * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether the id's CRC-32 puts it in the held-out fifth; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _encoded(most: int):
    """Encodings of each text's passages, `most` of them where there are more."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            found = []
            for a, b in blocks(offsets, BLOCK_BYTES):
                x, before = encode(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                for i, j in zip(before, before[1:]):
                    found.append(x[np.unique(np.linspace(i, j - 1, min(most, j - i)).round().astype(int))].tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "label", "print")), pa.array(found, pa.binary())], ["doc_id", "label", "print", "x"])

    return encoded


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING, most_passages: int = TRAINING_PASSAGES, each: int = DOCUMENT_PASSAGES) -> dict:
    """Fit on the first `most` labelled documents by hash of id and text, as far as `most_passages` go; `each` is the most of one document.

    A doc_id with several texts gives each of them; repeated rows and null ids are fitted once or not at all; of several labels the greatest holds.
    The driver gets at most `most_passages` encodings.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("print")).join(F.broadcast(sample), "doc_id")  # `most` rows at most
    passages = F.least(F.greatest(F.ceil(F.regexp_count("text", F.lit(WORD)) / PASSAGE), F.lit(1)), F.lit(each))
    order = [F.xxhash64("doc_id"), "doc_id", "print"]
    first = texts.select("doc_id", "label", "print", passages.alias("passages")).distinct().orderBy(*order).limit(most)
    chosen = first.withColumn("so_far", F.sum("passages").over(Window.orderBy(*order))).where(F.col("so_far") <= most_passages)  # `most` rows
    texts = texts.join(F.broadcast(chosen.select("doc_id", "print")), ["doc_id", "print"])
    found = texts.select("doc_id", "label", "print", "text").mapInArrow(_encoded(each), "doc_id bigint, label double, print bigint, x binary")
    rows = found.groupBy("doc_id", "print").agg(F.first("label").alias("label"), F.first("x").alias("x")).collect()  # most_passages encodings
    rows.sort(key=lambda r: (r.doc_id, r.print))
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in rows]
    x = np.concatenate(bags) if bags else np.zeros((0, FEATURES), np.float32)
    before = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    return fit(x, before, np.array([r.label for r in rows]))


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); nothing is shuffled.

    Null and empty texts are one passage without words and get a score like any other; a very long text is scored over all its passages. Repeated rows are scored alike; a null
    doc_id stays null and isn't held out; an empty table gives an empty result; extra columns are not read.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            found = [np.zeros(0)]
            for a, b in blocks(offsets, BLOCK_BYTES):
                x, before = encode(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                found.append(_forward(model, _standard(model, x), before)["score"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found))], ["doc_id", "score"])

    scores = docs.select("doc_id", "text").mapInArrow(scored, "doc_id bigint, score double")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels))
