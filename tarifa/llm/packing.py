"""Packing documents into sequences by the sum-of-squares rule.

Tokenizing a word is the same anywhere in a text, so a worker tokenizes its parts once while it remembers them: the different parts
of a block of texts are looked up, and each text's ids are gathered from theirs. Pieces are dealt to groups of about GROUP
pieces; in a group, largest first, each piece goes where the squared counts of open sequences by remaining room become
smallest. A group ends with a few open sequences, whatever its size.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.llm.shared import REMEMBERED, blocks, forget, seen, stored, utf8, word_ranges

SIZE, GROUP = 2048, 1 << 16
#: Bytes of parts of words and ids that a worker remembers in each of two generations; the longest part that it remembers; bytes of text
#: that it tokenizes at a time.
GENERATION_BYTES, LONGEST, BLOCK_BYTES = 24 << 20, 64, 2 << 20
#: What a remembered part takes besides its bytes and ids.
ENTRY_BYTES = 160
#: Letters that a worker folds and gives to the model as they are, once folded.
_LETTERS = re.compile("[a-zàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß]+").fullmatch
_LETTER, _MARK, _OTHER = 1, 2, 4
#: Of bytes: ASCII letters; ASCII marks that stay together after letters (an apostrophe may not, and < may begin a special token); all others.
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<"]] = _MARK
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
_PLACED = "row bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def parts(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, starts and ends of the parts that words are tokenized in, and how many precede each text (one more than texts).

    A word of Latin letters and then marks is folded and is two parts; any other word is one part, as it stands.
    """
    starts, ends, _ = word_ranges(offsets, data)
    kind = _KIND[data]
    wide = np.flatnonzero(data == 0xC3)  # À to ÿ, but for × and ÷
    second = data[wide + 1]
    wide = wide[(second != 0x97) & (second != 0xB7)]
    kind[wide] = kind[wide + 1] = _LETTER
    letter, mark = kind == _LETTER, kind == _MARK
    odd = np.concatenate([[0], np.cumsum(kind == _OTHER, dtype=np.int32)])
    back = np.concatenate([[0, 0], np.cumsum(mark[:-1] & letter[1:], dtype=np.int32)])  # letters again after marks
    plain = (odd[ends] == odd[starts]) & (back[ends] == back[np.minimum(starts + 1, len(data))])
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts[plain]] += 1
    edges[ends[plain]] -= 1  # a word may begin where one of another text ends
    inside = np.cumsum(edges[:-1], dtype=np.int8) > 0
    folded = data.copy()
    folded[inside & (data >= 65) & (data <= 90)] += 32
    wide = wide[inside[wide]] + 1
    folded[wide[data[wide] < 0x9F]] += 32
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = letter[:-1] & mark[1:] & inside[1:]
    cut[starts] = False
    cut = np.flatnonzero(cut)
    starts, ends = np.concatenate([starts, cut]), np.concatenate([ends, cut])
    starts.sort()
    ends.sort()
    return folded, starts, ends, np.searchsorted(starts, offsets)


class Words:
    """Ids of whole texts, as the tokenizer gives them, from remembered parts of words.

    A tokenizer that drops white space, never looks across it, folds case and splits letters from marks gives a text the ids of its parts
    in turn; whether it does is read from its file, and any other one is given whole texts.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        made = json.loads(self.tokenizer.to_str())
        split = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        steps = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        normal = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
        self.by_part = steps[0].get("pattern") == {"Regex": split} and steps[0].get("invert") and normal == ["NFC", "Replace", "Lowercase"]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0
        shown = sorted({*range(33, 127), *range(161, 173), *range(174, 256)})  # byte-level alphabet: these bytes as they are, the others from 256 on
        others = [b for b in range(256) if b not in set(shown)]
        self.visible = {b: 256 + n for n, b in enumerate(others)}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts that aren't remembered: from the model where a part is letters, else from the whole tokenizer."""
        out, rest = [], []
        for n, part in enumerate(parts):
            text = part.decode()
            if _LETTERS(text):
                shown = text if len(text) == len(part) else part.decode("latin-1").translate(self.visible)
                out.append(array("I", [x.id for x in self.tokenizer.model.tokenize(shown)]).tobytes())
            else:
                rest.append(n)
                out.append(text)
        for n, ids in zip(rest, self.encode([out[n] for n in rest])):
            out[n] = ids
        return out

    def of(self, parts: list[bytes]) -> list[bytes]:
        """Ids of different parts. What isn't asked for while a generation grows is forgotten with the next one."""
        if self.held > GENERATION_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        out = list(map(young.get, parts))
        missing = [n for n, ids in enumerate(out) if ids is None]
        again = [old.get(parts[n]) for n in missing]
        new = [n for n, ids in zip(missing, again) if ids is None]
        learnt = iter(self.learn([parts[n] for n in new]))
        for n, ids in zip(missing, again):
            part, ids = parts[n], next(learnt) if ids is None else ids
            out[n] = ids
            if len(part) <= LONGEST:
                young[part] = ids
                self.held += len(part) + len(ids) + ENTRY_BYTES
        return out

    def ids(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, and how many precede each text (one more than texts)."""
        if not self.by_part:
            found = [np.frombuffer(x, "<u4") for x in self.encode([data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])])]
            return np.concatenate([np.zeros(0, "<u4"), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        folded, starts, ends, before = parts(offsets, data)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        letters = folded[np.cumsum(inside[:-1], dtype=np.int8) > 0]
        edges = np.concatenate([[0], np.cumsum(ends - starts)])
        own = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(letters)]).dictionary_encode()
        codes, own = own.indices.to_numpy(), self.of(own.dictionary.to_pylist())
        sizes = np.fromiter(map(len, own), np.int64, len(own)) >> 2
        flat, first = np.frombuffer(b"".join(own), "<u4"), np.cumsum(sizes) - sizes
        counts = sizes[codes]
        after = np.concatenate([[0], np.cumsum(counts)])
        return flat[np.repeat(first[codes] - after[:-1], counts) + np.arange(after[-1])], after[before]


_MADE: dict[str, Words] = REMEMBERED.setdefault("packing", {})


def words_of(file: str) -> Words:
    if file not in _MADE:
        _MADE[file] = Words(file)
    return _MADE[file]


def pieces(docs: DataFrame, tokenizer_file: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids of each piece of each document (doc_id, text); ids are unsigned 32-bit little-endian."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("packing")
        words = words_of(tokenizer_file)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            offsets, data = utf8(pc.fill_null(batch.column("text"), ""))
            doc_ids = batch.column("doc_id").to_pylist()
            for a, b in blocks(offsets, BLOCK_BYTES):
                rows = []
                ids, before = words.ids(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                for doc_id, i, j in zip(doc_ids[a:b], before.tolist(), before[1:].tolist()):
                    whole = ids[i:j].tobytes() + end
                    for n, at in enumerate(range(0, len(whole), 4 * size)):
                        part = whole[at : at + 4 * size]
                        rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part), part))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (from 0) and the offset of each piece, placed in the order given."""
    counts = np.zeros(size + 1, np.int64)  # open sequences by room; full ones don't count
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made, never = 0, np.int64(1) << 60
    for i, length in enumerate(lengths.tolist()):
        room = size
        if length < size:
            here = counts[length:size]
            change = np.where(here > 0, 2 * (counts[: size - length] - here + 1), never)  # one less here, one more there
            if here[0]:
                change[0] = 1 - 2 * here[0]  # it gets full
            best = int(change.argmin())
            if change[best] <= 2 * counts[size - length] + 1 and here[best]:
                room = best + length
        if room == size:
            sequence[i], made = made, made + 1
        else:
            sequence[i] = stacks[room].pop()
            counts[room] -= 1
        offset[i] = size - room
        if left := room - length:
            counts[left] += 1
            stacks[left].append(int(sequence[i]))
    return sequence, offset


def _placed(size: int):
    def place(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows["group"].iloc[0])
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), size)
        return rows.drop(columns="group").assign(sequence_id=sequence + (group << 32), offset=offset)

    return place


def pack(docs: DataFrame, tokenizer_file: str, size: int = SIZE, end_id: int = 0, group: int = GROUP, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text); with `ids`, the ids as well.

    A document is its ids and end_id; one longer than size is cut into pieces of size, the last may be shorter. Null and empty
    texts are end_id alone; a very long text is tokenized whole, in memory a few times its own size. Repeated rows are packed each and
    dealt to groups like any others; a null doc_id stays null; ties in length go by doc_id and piece. An empty table gives an empty
    result; extra columns are not read. ids are unsigned 32-bit little-endian, in the order of the piece.
    """
    cut = pieces(docs, tokenizer_file, size, end_id).withColumn("row", F.monotonically_increasing_id())
    cut = stored(cut if ids else cut.drop("ids"), "pack-pieces")  # row is fixed from here on
    groups = max(1, -(-seen(cut)["rows"] // group))
    dealt = cut.drop("ids").withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    placed = dealt.groupBy("group").applyInPandas(_placed(size), _PLACED)
    return (placed.join(cut.select("row", "ids"), "row") if ids else placed).drop("row")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
