"""Which hashes occur in two texts or more, over all texts: a bitmap of fixed size.

Each task sends, for each range of hashes, those of its texts as one sorted run of differences, and whether two of its own texts
share them. The owner of a range merges the runs and sets a bit for each hash that two texts have. A hash without its bit is in
one text only; a hash with its bit may also be in one only, when another hash set the bit. So the bitmap prunes, and never
loses anything. Its size doesn't grow with the data: where the corpus outgrows it, it prunes less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tarifa.llm.shared import blocks, forget, stored, utf8

#: log2 of the bitmap's bits (16 MB), bits of a hash that are compared, bytes of text hashed at a time.
BITS, COMPARED, BLOCK_BYTES = 27, 48, 1 << 20
#: Hashes and texts of a run: a text's number in its run stands in the bits below those that are compared.
RUN_HASHES, RUN_TEXTS = 2_000_000, 1 << (64 - COMPARED)
#: Sightings from which a hash is common: one for each run that holds it, two where the run's texts share it.
COMMON = 6
#: Hash ranges: a power of two, one for about ROWS_A_RANGE rows.
RANGES, ROWS_A_RANGE = (64, 1 << 16), 4_000

#: offsets and bytes of texts laid end to end -> hashes, and the text of each.
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def run(values: np.ndarray) -> bytes:
    """A sorted run of different values, as differences of four bytes, or of eight where those are too few."""
    steps = np.diff(values, prepend=values[:1])
    wide = len(steps) and int(steps.max()) >> 32
    head = np.array([values[0] if len(values) else 0, bool(wide)], "<u8").tobytes()
    return head + steps.astype("<u8" if wide else "<u4").tobytes()


def unrun(data: bytes) -> np.ndarray:
    first, wide = np.frombuffer(data[:16], "<u8")
    steps = np.frombuffer(data[16:], "<u8" if wide else "<u4").astype(np.uint64)
    return first + np.cumsum(steps, dtype=np.uint64)


def bitmaps(docs: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """Two bitmaps of docs (text), as bytes: hashes of two texts or more, and those that tasks have seen COMMON times or more."""
    ranges = RANGES[0]
    rows = docs.count()
    while ranges < RANGES[1] and ranges * ROWS_A_RANGE < rows:
        ranges *= 2
    width = ranges.bit_length() - 1

    def runs_of(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate([np.zeros(0, np.uint64), *parts])
        parts.clear()
        keys.sort()
        found = keys >> np.uint64(64 - COMPARED)
        first = np.ones(len(keys), bool)
        first[1:] = found[1:] != found[:-1]
        at = np.flatnonzero(first)
        twice = np.zeros(len(keys), bool)
        twice[1:] = ~first[1:] & (keys[1:] != keys[:-1])  # the same hash in another text
        many = np.logical_or.reduceat(twice, at) if len(at) else np.zeros(0, bool)
        found = found[at]
        cuts = np.searchsorted(found, np.arange(ranges, dtype=np.uint64) << np.uint64(COMPARED - width)).tolist() + [len(found)]
        full = [i for i in range(ranges) if cuts[i] < cuts[i + 1]]
        runs = [run(found[cuts[i] : cuts[i + 1]]) for i in full]
        marks = [np.packbits(many[cuts[i] : cuts[i + 1]]).tobytes() for i in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(runs, pa.binary()), pa.array(marks, pa.binary())], ["range", "run", "many"])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        parts, held, texts = [], 0, 0
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            for a, b in blocks(offsets, BLOCK_BYTES):
                while a < b:
                    if texts == RUN_TEXTS or held >= RUN_HASHES:
                        yield runs_of(parts)
                        parts, held, texts = [], 0, 0
                    c = min(b, a + RUN_TEXTS - texts)
                    found, text = features(offsets[a : c + 1] - offsets[a], data[offsets[a] : offsets[c]])
                    parts.append(found >> np.uint64(64 - COMPARED) << np.uint64(64 - COMPARED) | (text + texts).astype(np.uint64))
                    held, texts, a = held + len(found), texts + c - a, c
        yield runs_of(parts)

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        runs = [unrun(x) for x in rows["run"]]
        many = [r[np.unpackbits(np.frombuffer(m, np.uint8), count=len(r)).astype(bool)] for m, r in zip(rows["many"], runs)]
        values = np.concatenate([*runs, *many])
        values.sort()
        number, out = int(rows["range"].iloc[0]), []
        for least in (2, COMMON):  # a value that stands as often as `least` is its own neighbour at that distance
            seen = values[least - 1 :][values[least - 1 :] == values[: max(0, len(values) - least + 1)]]
            bits = np.zeros((1 << BITS) // ranges, bool)
            bits[(seen >> np.uint64(COMPARED - BITS)).astype(np.int64) - number * len(bits)] = True
            out.append(np.packbits(bits).tobytes())
        return pd.DataFrame({"range": [number], "shared": out[:1], "common": out[1:]})

    runs = docs.select("text").mapInArrow(sent, "range int, run binary, many binary")
    slices = stored(runs.groupBy("range").applyInPandas(merged, "range int, shared binary, common binary"), "bitmap-slices")
    out = np.zeros((2, (1 << BITS) // 8), np.uint8)
    wide = out.shape[1] // ranges
    for row in slices.toLocalIterator():  # 2 * 2**BITS bits together; collected at once, they stand in the driver several times over
        for bits, name in zip(out, ("shared", "common")):
            bits[row["range"] * wide : (row["range"] + 1) * wide] = np.frombuffer(row[name], np.uint8)
    return out[0], out[1]


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash has its bit."""
    slot = hashes >> np.uint64(64 - BITS)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
