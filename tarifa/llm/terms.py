"""Terms of texts: maximal runs of letters (and digits, where asked for) and of all characters beyond ASCII, only A-Z lower-cased.

Texts are UTF-8 bytes. One table turns whatever ends a term into a space and lower-cases the rest, so that splitting at spaces gives
the terms. A long text is split block by block, at the ends of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a text that are split at a time.
BLOCK_BYTES = 1 << 20


def _table(digits: bool) -> bytes:
    def kept(byte: int) -> int:
        char = chr(byte)
        if byte >= 128 or "a" <= char <= "z" or digits and "0" <= char <= "9":
            return byte
        return byte + 32 if "A" <= char <= "Z" else 32

    return bytes(map(kept, range(256)))


#: `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`, and `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`.
ALPHANUMERIC, LETTERS = _table(True), _table(False)


def split(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, a block at a time."""
    text, a = text.translate(table), 0
    while a < len(text):
        b = text.find(b" ", a + BLOCK_BYTES) if a + BLOCK_BYTES < len(text) else len(text)
        b = len(text) if b < 0 else b
        yield text[a:b].split()
        a = b


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 of a string column's values, one at a time; null counts as empty."""
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_py() or b""
