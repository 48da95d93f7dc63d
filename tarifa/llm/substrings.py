"""Suffix-array deduplication by a common-prefix-aware distributed merge sort.

A string of SPAN bytes is judged by the suffix that starts at its anchor: of its KGRAM-byte pieces the one with the least hash,
so equal strings have equal anchors at equal places. Anchors whose piece no other text holds are left out by the bitmap of
shared hashes. Each task sorts the suffixes at its remaining anchors and sends them as runs, front-coded: what a suffix
shares with the one before is a length. Owners merge the runs with loser trees that carry the known common prefixes: unequal
ones decide without looking at a byte, equal ones compare from there on. Where neighbours share enough bytes, and
agree on the bytes before the anchor, the strings are the same; all but those of the least doc_id go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.llm.common import BLOCK_BYTES, RANGES, ROWS_A_RANGE, bitmaps, marked
from tarifa.llm.shared import blocks, hashes, mix64, rolling, utf8

#: Bytes of the strings that count, bytes of the pieces that anchor them; offsets that an anchor can have.
SPAN, KGRAM = 50, 20
OFFSETS = SPAN - KGRAM + 1
#: Suffixes that a task sorts at a time.
RUN_ROWS = 300_000
_NO_ID = (1 << 63) - 1
_SENT = "range int, kind int, payload binary"
_MARKS = "doc_id bigint, print bigint, marks binary"
#: print: 64 bits of the text, which tell apart texts under one id; at: a string has less than 2**31 bytes.
_SUFFIX = np.dtype([("doc", "<i8"), ("print", "<i8"), ("at", "<u4"), ("low", "u1"), ("high", "u1"), ("length", "u1"), ("common", "u1")])
_MARK = np.dtype([("at", "<u4"), ("mask", "<u4")])
_MADE = np.dtype([("doc", "<i8"), ("print", "<i8"), ("at", "<u4"), ("mask", "<u4")])


def anchors(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, first and last start of the strings of each anchor of texts laid end to end, in order of place."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none.astype(np.uint64), none, none, none
    pieces = hashes(rolling(data), slice(0, len(data) - KGRAM + 1), slice(KGRAM, len(data) + 1))
    least = pieces & np.uint64(0xFFFFFFFF00000000) | np.arange(len(pieces), dtype=np.uint64)
    width = 1
    while 2 * width <= OFFSETS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < OFFSETS:
        least = np.minimum(least[: len(data) - SPAN + 1], least[OFFSETS - width :][: len(data) - SPAN + 1])
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + SPAN <= ends)
    place = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    return mix64(pieces[place[first]]), place[first], starts[first], starts[last]


def anchor_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place, _, _ = anchors(offsets, data)
    return found, np.searchsorted(offsets, place, "right") - 1


def _matrix(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Rows of bytes, zero beyond their lengths."""
    columns = np.arange(width)
    out = data[np.minimum(starts[:, None] + columns, len(data) - 1)]
    out[columns >= lengths[:, None]] = 0
    return out


def _in_order(suffixes: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Indexes that sort rows of SPAN bytes; more: less important keys."""
    padded = np.zeros((len(suffixes), -(-SPAN // 8) * 8), np.uint8)
    padded[:, :SPAN] = suffixes
    words = padded.view(">u8").astype(np.uint64)
    return np.lexsort((*reversed(more), *(words[:, i] for i in reversed(range(words.shape[1])))))


def _common(suffixes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before."""
    out = np.zeros(len(suffixes), np.int64)
    differs = suffixes[1:] != suffixes[:-1]
    out[1:] = np.where(differs.any(1), differs.argmax(1), SPAN)
    out[1:] = np.minimum(out[1:], np.minimum(lengths[1:], lengths[:-1]))
    return out


def coded(rows: np.ndarray, suffixes: np.ndarray, lefts: np.ndarray) -> bytes:
    """A sorted run: records, then what each suffix has beyond the common prefix, then the bytes before the anchors."""
    columns = np.arange(SPAN)
    rest = suffixes[(columns >= rows["common"][:, None]) & (columns < rows["length"][:, None])]
    before = lefts[np.arange(lefts.shape[1]) < rows["high"][:, None]]
    head = np.array([len(rows), len(rest), len(before)], "<u4").tobytes()
    planes = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), _SUFFIX.itemsize).T  # byte by byte: most of these are zeros, which shuffles compress
    return head + planes.tobytes() + rest.tobytes() + before.tobytes()


def decoded(payload: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    n, rest, before = np.frombuffer(payload[:12], "<u4").tolist()
    at = 12 + n * _SUFFIX.itemsize
    rows = np.ascontiguousarray(np.frombuffer(payload[12:at], np.uint8).reshape(_SUFFIX.itemsize, n).T).view(_SUFFIX).reshape(n)
    strings, last, own = [], b"", at
    for common, length in zip(rows["common"].tolist(), rows["length"].tolist()):
        last = last[:common] + payload[own : own + length - common]
        own += length - common
        strings.append(last)
    lefts = np.zeros((n, OFFSETS - 1), np.uint8)
    lefts[np.arange(OFFSETS - 1) < rows["high"][:, None]] = np.frombuffer(payload[at + rest :], np.uint8)
    return rows, strings, lefts


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Run, index and common prefix with the string before, of all strings of sorted runs (strings, common prefixes), in order.

    known[r] is what the head of run r shares with the string put out last. Of two heads the one that shares more comes first;
    if they share as much, they are compared from there on, and what the loser shares with the winner is remembered.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    heads, known = [0] * leaves, [0] * leaves
    current: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (leaves - len(runs))

    def beats(a: int, b: int) -> bool:
        x, y = current[a], current[b]
        if y is None:
            return True
        if x is None:
            return False
        if known[a] != known[b]:
            return known[a] > known[b]
        n, most = known[a], min(len(x), len(y))
        if x[n:most] == y[n:most]:
            n = most
            first = (len(x), a) < (len(y), b)
        else:
            while x[n] == y[n]:
                n += 1
            first = x[n] < y[n]
        known[b if first else a] = n
        return first

    losers = [0] * leaves
    winners = [0] * leaves + list(range(leaves))
    for node in range(leaves - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    winner = winners[1]
    order, index, common = [], [], []
    while current[winner] is not None:
        i = heads[winner]
        order.append(winner)
        index.append(i)
        common.append(known[winner])
        strings, prefixes = runs[winner]
        heads[winner] = i = i + 1
        if i < len(strings):
            current[winner], known[winner] = strings[i], prefixes[i]
        else:
            current[winner] = None
        node = (winner + leaves) >> 1
        while node:
            other = losers[node]
            if beats(other, winner):
                losers[node], winner = winner, other
            node >>= 1
    return order, index, common


def _pack_marks(doc: np.ndarray, prints: np.ndarray, at: np.ndarray, mask: np.ndarray) -> tuple[list, list, list]:
    """One row a text."""
    order = np.lexsort((prints, doc))
    doc, prints = doc[order], prints[order]
    marks = np.empty(len(order), _MARK)
    marks["at"], marks["mask"] = at[order], mask[order]
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (prints[1:] != prints[:-1])
    cuts = np.append(np.flatnonzero(new), len(order)).tolist()
    return doc[new].tolist(), prints[new].tolist(), [marks[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def _owned(rows: pd.DataFrame) -> pd.DataFrame:
    """Marks of one range: those that tasks have made, and those that its merged runs show."""
    ids, prints, marks = [], [], []
    for payload in rows.loc[rows["kind"] == 1, "payload"]:
        made = np.frombuffer(payload, _MADE)
        for out, part in zip((ids, prints, marks), _pack_marks(made["doc"], made["print"], made["at"], made["mask"])):
            out += part
    runs = [decoded(p) for p in rows.loc[rows["kind"] == 0, "payload"]]
    if runs:
        order, index, common = merge([(strings, table["common"].tolist()) for table, strings, _ in runs])
        before = np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])])
        place = before[np.array(order)] + np.array(index)
        table = np.concatenate([r[0] for r in runs])[place]
        lefts = np.concatenate([r[2] for r in runs])[place]
        common = np.array(common)
        mask = np.zeros(len(table), np.uint32)
        left = np.zeros(len(table), np.uint64)
        for r in range(OFFSETS):
            if r:
                left = mix64(left * np.uint64(257) + lefts[:, r - 1] + np.uint64(1))
            own = np.flatnonzero((table["low"] <= r) & (r <= table["high"]) & (table["length"] >= SPAN - r))
            if len(own) < 2:
                continue
            key = mix64(np.cumsum(common < SPAN - r).astype(np.uint64)[own]) + left[own] * np.uint64(0x9E3779B97F4A7C15)
            by_key = np.argsort(key, kind="stable")
            key, doc = key[by_key], table["doc"][own][by_key]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(key))))
            mask[own[by_key[doc > least]]] |= np.uint32(1 << r)
        gone = np.flatnonzero(mask)
        for out, part in zip((ids, prints, marks), _pack_marks(table["doc"][gone], table["print"][gone], table["at"][gone], mask[gone])):
            out += part
    return pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "print": pd.Series(prints, dtype="int64"), "marks": pd.Series(marks, dtype=object)})


def _removed(size: int, marks: np.ndarray) -> np.ndarray:
    """Which bytes of a text go."""
    bits = marks["mask"][:, None] >> np.arange(OFFSETS, dtype=np.uint32) & 1
    row, offset = np.nonzero(bits)
    starts = marks["at"][row].astype(np.int64) - offset
    steps = np.bincount(starts, minlength=size + 1) - np.bincount(starts + SPAN, minlength=size + 1)
    return np.cumsum(steps[:size]) > 0


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = utf8(batch.column("text"))
        rows = []
        for i, chunks in enumerate(batch.column("marks").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]]
            gone, spans = 0, 0
            if chunks:
                removed = _removed(len(text), np.frombuffer(b"".join(chunks), _MARK))
                gone, spans = int(removed.sum()), int(removed[0]) + int((removed[1:] & ~removed[:-1]).sum())
                text = text[~removed]
            rows.append((len(text) + gone, gone, spans, hashlib.sha256(text.tobytes()).hexdigest(), text.tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes for every row of docs (doc_id, text).

    A byte goes when a string of SPAN bytes covers it that also starts in a text with a smaller doc_id. Null counts as
    empty; texts shorter than SPAN keep everything; a very long text is judged whole, block by block. Rows with one doc_id, repeated
    rows too, don't take from each other, and each is judged by its own text; a null doc_id counts as larger than any. What stays
    may cut a character in two, so it is bytes. An empty table gives an empty result; extra columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    bits = spark.sparkContext.broadcast(bitmaps(docs, anchor_hashes)[0])  # fixed size
    ranges = RANGES[0]
    rows = docs.count()
    while ranges < RANGES[1] and ranges * ROWS_A_RANGE < rows:
        ranges *= 2
    shift = np.uint64(64 - (ranges.bit_length() - 1))

    def runs_of(parts: list[tuple]) -> Iterator[tuple[int, int, bytes]]:
        """The sorted runs of a task, and what it can decide itself: of equal suffixes in equal surroundings the least doc_id stays."""
        owner, table, suffixes, lefts, around = (np.concatenate(x) for x in zip(*parts))
        order = _in_order(suffixes, table["length"], around, table["low"], table["high"], table["doc"])
        owner, table, suffixes, lefts, around = owner[order], table[order], suffixes[order], lefts[order], around[order]
        new = np.ones(len(table), bool)
        new[1:] = (suffixes[1:] != suffixes[:-1]).any(1) | (around[1:] != around[:-1])
        for name in ("length", "low", "high"):
            new[1:] |= table[name][1:] != table[name][:-1]
        least = table["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]
        later = table["doc"] > least
        made = np.empty(int(later.sum()), _MADE)
        for name in ("doc", "print", "at"):
            made[name] = table[name][later]
        low, high = table["low"][later].astype(np.uint64), table["high"][later].astype(np.uint64)
        made["mask"] = ((np.uint64(1) << (high + np.uint64(1))) - (np.uint64(1) << low)).astype(np.uint32)
        if len(made):
            yield int(owner[0]), 1, made.tobytes()
        stays = np.flatnonzero(~later)
        stays = stays[np.argsort(owner[stays], kind="stable")]
        cuts = np.searchsorted(owner[stays], np.arange(ranges + 1))
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            own = stays[cuts[i] : cuts[i + 1]]
            rows = table[own]
            rows["common"] = _common(suffixes[own], rows["length"].astype(np.int64))
            yield i, 0, coded(rows, suffixes[own], lefts[own])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[tuple]) -> pa.RecordBatch:
            out = list(runs_of(parts)) if parts else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["range", "kind", "payload"])

        parts, held = [], 0
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            ids = np.array([_NO_ID if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
            for a, b in blocks(offsets, BLOCK_BYTES):
                at, own = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
                found, place, first, last = anchors(at, own)
                some = np.flatnonzero(marked(bits.value, found))
                if not len(some):
                    continue
                found, place, first, last = found[some], place[some], first[some], last[some]
                text = np.searchsorted(at, place, "right") - 1
                prints = np.array([xxhash.xxh64_intdigest(own[at[i] : at[i + 1]].tobytes(), 42) for i in range(b - a)], np.uint64).view(np.int64)  # as xxhash64() of Spark
                table = np.zeros(len(some), _SUFFIX)
                table["doc"], table["print"], table["at"] = ids[a + text], prints[text], place - at[text]
                table["low"], table["high"] = place - last, place - first
                length = np.minimum(SPAN, at[text + 1] - place)
                table["length"] = length
                lefts = _matrix(own[::-1], len(own) - place, place - first, OFFSETS - 1)  # nearest byte first
                around = hashes(rolling(own), first, place)
                parts.append(((found >> shift).astype(np.int64), table, _matrix(own, place, length, SPAN), lefts, around))
                held += len(some)
                if held >= RUN_ROWS:
                    yield flush(parts)
                    parts, held = [], 0
        yield flush(parts)

    merged = docs.mapInArrow(sent, _SENT).groupBy("range").applyInPandas(_owned, _MARKS)
    marks = merged.groupBy("doc_id", "print").agg(F.collect_list("marks").alias("marks"))
    key = F.coalesce("doc_id", F.lit(_NO_ID)).alias("key")
    texts = docs.select(key, "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"))
    joined = texts.join(marks.withColumnRenamed("doc_id", "key"), ["key", "print"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(_applied, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
