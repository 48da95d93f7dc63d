"""Exact deduplication by an extendible-hash index on shared files.

The index is keyed by 64 bits of the normalised text's SHA-256. A key that one row has needs no comparison; the others are indexed: a bit
for each prefix of a shared key, some SPREAD bits a key, tells tasks which texts to send. Few others come along, more where the bits have reached their limit.
Their directory starts with one bucket and doubles while a bucket holds more than BUCKET_BYTES of text and more than one key: LEVEL
doublings are worked out at a time, from bytes by key prefix, and go on below the prefixes that are overfull still, until nothing is. Each
task sends one entry for the equal texts it has seen. Owners get ranges of keys, made up of whole buckets, read the entries in key order,
chain those that share a key and compare their bytes. Directory and index are tables in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.llm.shared import forget, join_small, seen, stored

#: Bytes of text that a bucket, an owner's range, and a task between two sendings hold.
BUCKET_BYTES, OWNER_BYTES, HELD_BYTES = 4 << 20, 16 << 20, 16 << 20
#: Doublings that are worked out at a time; the key has 64 bits.
LEVEL = 16
#: Bits for each key that rows share, log2 of the fewest and of the most bits, and the ranges in which they are set.
SPREAD, LEAST_BITS, MOST_BITS, RANGES = 16, 16, 28, 64
#: Groups with more rows than this are joined by broadcast or salt: one of them may hold a third of all rows.
HOT_GROUP = 10_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ROWS = "doc_id bigint, key bigint, text_sha256 string, n_bytes bigint"
_ENTRIES = "key bigint, text_sha256 string, text binary, keep_id bigint, group_size bigint"
_SLOTS = "slot bigint, first bigint, local int, owner int, overfull boolean"
_INDEX = "slot int, key bigint, chain int, text_sha256 string, keep_id bigint, group_size bigint"


def normal(text: bytes) -> bytes:
    return text.translate(_LOWER)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [normal(x.as_py()) for x in pc.fill_null(batch.column("text"), "").cast(pa.binary())]


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        texts = _texts(batch)
        digests = [hashlib.sha256(x).digest() for x in texts]
        columns = [batch.column("doc_id"), pa.array(map(_key, digests), pa.int64()), pa.array([x.hex() for x in digests], pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "text_sha256", "n_bytes"])


def directory(sizes: dict[int, int], bucket_bytes: int = BUCKET_BYTES, depth: int = LEVEL) -> np.ndarray:
    """The bucket of each of the 2**depth key prefixes, by splitting overfull buckets; sizes: bytes by prefix."""
    held = np.zeros(1 << depth, np.int64)
    held[list(sizes)] = list(sizes.values())
    sums = np.concatenate([[0], np.cumsum(held)])
    bucket_of = np.zeros(1 << depth, np.int32)
    buckets, open_ = 0, [(0, 0)]  # first slot and local depth
    while open_:
        first, local = open_.pop()
        wide = 1 << (depth - local)
        if local < depth and sums[first + wide] - sums[first] > bucket_bytes:
            open_ += [(first + wide // 2, local + 1), (first, local + 1)]
        else:
            bucket_of[first : first + wide] = buckets
            buckets += 1
    return bucket_of


def _split(depth: int, level: int, bucket_bytes: int, owner_bytes: int):
    """The buckets below one prefix of `depth` bits, from its slots of `level` bits more."""

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        slot, held = rows["slot"].to_numpy(), rows["bytes"].to_numpy()
        base = (int(slot.min()) >> level) << level if depth else -(1 << (level - 1))
        own = (slot - base).astype(np.int64)
        bucket_of = directory(dict(zip(own.tolist(), held.tolist())), bucket_bytes, level)
        first = np.searchsorted(bucket_of, bucket_of[own])
        wide = np.searchsorted(bucket_of, bucket_of[own], "right") - first
        sums = np.zeros(len(bucket_of) + 1, np.int64)
        np.add.at(sums, own + 1, held)
        owner = np.cumsum(sums)[first] // owner_bytes
        shift = np.int64(64 - depth - level)
        return pd.DataFrame({"slot": slot, "first": (first + base) << shift, "local": depth + level - np.log2(wide).astype(int), "owner": owner, "overfull": (wide == 1) & (held > bucket_bytes) & (rows["keys"].to_numpy() > 1)})

    return split


def buckets(sizes: DataFrame, bucket_bytes: int = BUCKET_BYTES, level: int = LEVEL) -> list[tuple[int, DataFrame]]:
    """The directory of keys (key, bytes), a row a key: for each depth a table of its slots' buckets, as their first key and local depth.

    A slot that is overfull at one depth is split again in the next table. Keys are read as signed numbers, so prefixes are in their order.
    """
    found, depth, left = [], 0, sizes
    while True:
        fine = depth + level
        parent = F.shiftright("key", 64 - depth) if depth else F.lit(0).cast("long")
        sums = left.groupBy(parent.alias("parent"), F.shiftright("key", 64 - fine).alias("slot")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("keys"))
        table = stored(sums.groupBy("parent").applyInPandas(_split(depth, level, bucket_bytes, max(OWNER_BYTES, bucket_bytes)), _SLOTS), f"dedup-directory{fine}", overfull=F.count_if("overfull"))
        found.append((fine, table))
        over = table.where("overfull").select("slot")
        if fine + level > 64 or not seen(table)["overfull"]:
            return found
        left = join_small(left.withColumn("slot", F.shiftright("key", 64 - fine)), stored(over, "dedup-overfull"), ["slot"]).drop("slot")
        depth = fine


def _marked(width: int):
    """The bits of the keys in each range of keys, packed; rows (range, slot) come in one at a time."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at, slot = (batch.column(c).to_numpy() for c in ("range", "slot"))
            for n in np.unique(at).tolist():
                held.setdefault(n, np.zeros(width, bool))[slot[at == n] - n * width] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], ["range", "bits"])

    return marked


def shared_keys(several: DataFrame, rows: int | None = None) -> tuple[int, np.ndarray]:
    """log2 of the bits, and a bit for each prefix of a key that several rows have: some SPREAD bits a key, within limits. It loses no such key; a key of one row may share a bit. rows: how many they are, if known."""
    bits = min(max(((several.count() if rows is None else rows) * SPREAD).bit_length(), LEAST_BITS), MOST_BITS)
    width = (1 << bits) // RANGES
    slots = several.select(F.shiftrightunsigned("key", 64 - bits).alias("slot"))
    slots = slots.select(F.floor(F.col("slot") / width).alias("range"), "slot")
    parts = slots.repartition(RANGES, "range").mapInArrow(_marked(width), "range bigint, bits binary").collect()  # 2**bits bits together
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in parts:
        out[row["range"] * width // 8 : (row["range"] + 1) * width // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits, out


def _entries(bits: int, shared):
    """Of the texts whose key may be shared, equal ones of a task become one entry, as long as what it holds is small: chained by key, compared byte by byte."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: dict[int, list[list]] = {}
        held, marks = 0, shared.value

        def flush() -> pa.RecordBatch:
            flat = [x for chain in seen.values() for x in chain]
            columns = [pa.array([k for k, chain in seen.items() for _ in chain], pa.int64())]
            columns += [pa.array([x[i] for x in flat], t) for i, t in enumerate([pa.string(), pa.binary(), pa.int64(), pa.int64()])]
            return pa.RecordBatch.from_arrays(columns, ["key", "text_sha256", "text", "keep_id", "group_size"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch)):
                digest = hashlib.sha256(text).digest()
                slot = int.from_bytes(digest[:8], "big") >> (64 - bits)
                if not marks[slot >> 3] >> (7 - (slot & 7)) & 1:
                    continue
                chain = seen.setdefault(_key(digest), [])
                entry = next((x for x in chain if x[1] == text), None)
                if entry is None:
                    chain.append([digest.hex(), text, doc_id, 1])
                    held += len(text)
                else:
                    entry[2] = doc_id if entry[2] is None else max(entry[2], doc_id if doc_id is not None else entry[2])
                    entry[3] += 1
            if held > HELD_BYTES:
                yield flush()
                seen, held = {}, 0
        yield flush()

    return entries


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in key order; a key's chain holds each different text once."""
    chain: list[list] = []

    def rows(done: list[list]) -> pa.RecordBatch:
        columns = [pa.array([x[i] for x in done], t) for i, t in enumerate([pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()])]
        return pa.RecordBatch.from_arrays(columns, ["slot", "key", "chain", "text_sha256", "keep_id", "group_size"])

    for batch in batches:
        done: list[list] = []
        texts = batch.column("text")
        names = ["slot", "key", "text_sha256", "keep_id", "group_size"]
        for i, (slot, key, sha, keep, size) in enumerate(zip(*(batch.column(n).to_pylist() for n in names))):
            if chain and chain[0][1] != key:
                done += [x[:6] for x in chain]
                chain = []
            text = texts[i].as_py()
            same = next((x for x in chain if x[6] == text), None)
            if same is None:
                chain.append([slot, key, len(chain), sha, keep, size, text])
            else:
                same[4] = keep if same[4] is None else max(same[4], keep if keep is not None else same[4])
                same[5] += size
        if done:
            yield rows(done)
    if chain:
        yield rows([x[:6] for x in chain])


def index(docs: DataFrame, rows: DataFrame, bucket_bytes: int = BUCKET_BYTES, level: int = LEVEL) -> DataFrame:
    """The index of keys that several of rows (key, n_bytes) have: slot, key, place in the chain, text_sha256, keep_id, group_size of every different text.

    Only texts whose key may be shared travel, by shared_keys(); a text of one row that comes along is a chain of its own.
    """
    several = stored(rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes")).where("n > 1").drop("n"), "dedup-several")
    bits, marks = shared_keys(several, seen(several)["rows"])
    sizes, entries = several, docs.select("doc_id", "text").mapInArrow(_entries(bits, docs.sparkSession.sparkContext.broadcast(marks)), _ENTRIES)  # 2**MOST_BITS bits at most
    (fine, table), *deeper = buckets(sizes, bucket_bytes, level)
    placed = join_small(entries.withColumn("slot", F.shiftright("key", 64 - fine)), table.select("slot", "first", "owner"), ["slot"], rows=seen(table)["rows"]).withColumnRenamed("slot", "top")
    for fine, table in deeper:
        slots = table.select("slot", F.col("first").alias("f"), F.col("owner").alias("o"))
        placed = join_small(placed.withColumn("slot", F.shiftright("key", 64 - fine)), slots, ["slot"], "left", seen(table)["rows"]).drop("slot")
        placed = placed.withColumns({"first": F.coalesce("f", "first"), "owner": F.when(F.col("o").isNull(), F.col("owner")).otherwise(F.hash("top", "o"))}).drop("f", "o")
    owners = placed.repartition("owner").sortWithinPartitions("owner", "first", "key")
    return stored(owners.select(F.col("top").cast("int").alias("slot"), "key", "text_sha256", "text", "keep_id", "group_size").mapInArrow(_owned, _INDEX), "dedup-index")


def exact_duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, level: int = LEVEL) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text).

    Texts are equal when identical after lower-casing A-Z, compared whole; null counts as empty, and empty texts are equal. A very long
    text is one entry of a bucket, however large. The largest doc_id of a group stays; a null one is less than any. Repeated rows with
    that doc_id count in group_size and are all marked as kept. An empty table gives an empty result; extra columns are not read.
    level (4, 8 or 16) is how many doublings of the directory are worked out at a time; it doesn't change results.
    """
    rows = stored(docs.select("doc_id", "text").mapInArrow(_keyed, _ROWS), "dedup-keys")
    found = index(docs, rows, bucket_bytes, level).where("group_size > 1").select("text_sha256", "keep_id", "group_size")
    hot = stored(found.where(F.col("group_size") > HOT_GROUP).withColumnsRenamed({"keep_id": "hot_keep", "group_size": "hot_size"}), "dedup-hot")
    rows = join_small(rows.drop("key", "n_bytes"), hot, ["text_sha256"], "left")
    rows = rows.withColumn("cold", F.when(F.col("hot_size").isNull(), F.col("text_sha256")).otherwise(F.concat(F.lit("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(4096)).cast("string"))))
    cold = found.where(F.col("group_size") <= HOT_GROUP).withColumnRenamed("text_sha256", "cold")
    rows = rows.join(cold, "cold", "left")
    size = F.coalesce("hot_size", "group_size", F.lit(1)).cast("long")
    keep = F.when(F.col("hot_size").isNotNull(), F.col("hot_keep")).when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


ORACLE = """
WITH normal AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
groups AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY text)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.text) AS text_sha256
FROM normal n JOIN groups g USING (text)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
