"""Quality rules, line first: each line is judged, failing lines go, then documents that lost too much go.

A line fails for navigation (three bars or more, and a bar for every four words), for punctuation (12 visible
characters or more, over a quarter of them neither letter, digit nor mark of a letter), and for boilerplate (a notice
that PHRASES lists). A document goes when failing lines hold more than MOST_LOST of a hundred of its visible characters,
or when it fails one of the whole-text limits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.llm.shared import forget

MOST_LOST, LEAST_WORDS, MOST_REPEATED = 50, 50, 50
PHRASES = ("accept all cookies", "all rights reserved", "click here to", "enable javascript", "privacy policy", "sign up for our newsletter", "skip to content", "terms of use", "terms of service")
SYMBOLS = b"#*$%&|<>"
#: What doesn't count as odd punctuation: the ASCII that is no letter or digit is odd; every other character is not.
ODD = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "n_lines bigint, n_bad_lines bigint, visible_chars bigint, lost_chars bigint, kept boolean, clean_text string"
)
_NOTICE = re.compile("|".join(map(re.escape, PHRASES)).encode())


def visible(raw: bytes, marks: int) -> int:
    """Code points that are in words; marks: bytes of raw that continue a character."""
    return len(raw) - marks


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    if len(words) < 4:
        return 0
    windows = Counter(zip(words, words[1:], words[2:]))
    if len(windows) == len(words) - 2:
        return 0
    found, end = 0, 0
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            found += i + 3 - max(end, i)
            end = i + 3
    return found


def bad_line(line: bytes, words: list[bytes], chars: int) -> bool:
    bars = line.count(b"|")
    if bars >= 3 and 4 * bars >= len(words):
        return True
    if chars >= 12 and 4 * (len(line) - len(line.translate(None, ODD))) > chars:
        return True
    return _NOTICE.search(line.lower()) is not None


_CONTINUES = bytes(range(0x80, 0xC0))


def judge(raw: bytes) -> tuple:
    """The row of one text, but for its id and its clean text."""
    return cleaned(raw)[0]


def cleaned(raw: bytes) -> tuple[tuple, bytes]:
    """judge(raw), and the text without its failing lines; the other lines, blank ones too, stay as they are."""
    lines = raw.split(b"\n")
    split = [x.split() for x in lines]
    words = list(chain.from_iterable(split))
    total = lost = filled = 0
    bad = set()
    for i, (line, own) in enumerate(zip(lines, split)):
        if own:
            joined = b"".join(own)
            chars = len(joined) - (0 if joined.isascii() else len(joined) - len(joined.translate(None, _CONTINUES)))
            filled += 1
            total += chars
            if bad_line(line, own, chars):
                bad.add(i)
                lost += chars
    repeat = repeated_words(words)
    full = [x for x, own in zip(lines, split) if own]
    failed = len(words) < LEAST_WORDS or 100 * repeat > MOST_REPEATED * len(words)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    row = len(words), total, symbols, len(full) - len(set(full)), repeat, failed, filled, len(bad), total, lost, not failed and 100 * lost <= MOST_LOST * total
    return row, b"\n".join(x for i, x in enumerate(lines) if i not in bad) if bad else raw


def strings(texts: list[bytes | None], kind: pa.DataType) -> pa.Array:
    """A string column of UTF-8 texts; nothing is decoded."""
    return pa.array(texts, pa.binary()).view(pa.string()).cast(kind)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "").cast(pa.binary())
        found = [cleaned(x.as_py()) for x in texts]
        columns = zip(*(row for row, _ in found)) if found else [[] for _ in names[1:-1]]
        kinds = [pa.bool_() if n in ("base_failed", "kept") else pa.int64() for n in names[1:-1]]
        clean = strings([x if there else None for (_, x), there in zip(found, batch.column("text").is_valid().to_pylist())], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds)), clean], names)


def line_rules(docs: DataFrame) -> DataFrame:
    """Counts, verdict and clean_text, the text without its failing lines, for every row of docs (doc_id, text); nothing is shuffled.

    Null and empty texts have no words and fail; a null text has a null clean_text. A line's equal is looked for among the earlier lines of its
    own text. A very long text is judged whole, line by line. The verdict is on the text as it came. Repeated rows are judged alike; a null doc_id stays null; an empty table gives
    an empty result. Extra columns are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(_judged, SCHEMA)


ORACLE = r"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
lines AS (
  SELECT rid, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM (SELECT rid, string_split(text, chr(10)) AS parts FROM texts)),
judged AS (
  SELECT rid, line, i, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, length(line) - length(replace(line, '|', '')) AS bars,
         len(regexp_extract_all(line, '[!-/:-@\[-`{-~]')) AS odd FROM lines),
marked AS (
  SELECT *, n > 0 AND ((bars >= 3 AND 4 * bars >= n) OR (chars >= 12 AND 4 * odd > chars)
    OR regexp_matches(lower(line), 'accept all cookies|all rights reserved|click here to|enable javascript|privacy policy|sign up for our newsletter|skip to content|terms of use|terms of service')) AS bad
  FROM judged),
by_doc AS (
  SELECT rid, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines, sum(chars) AS visible, coalesce(sum(chars) FILTER (bad), 0) AS lost,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad), '')) AS cleaned_sha256 FROM marked GROUP BY rid),
positions AS (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM worded WHERE len(words) >= 3),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS times FROM positions),
repeats AS (SELECT rid, count(DISTINCT i + k) AS n FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY rid),
counted AS (
  SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(b.visible, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(w.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(b.n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(b.lost, 0) AS lost, b.cleaned_sha256
  FROM worded w LEFT JOIN by_doc b USING (rid) LEFT JOIN repeats r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 50 * word_chars AS kept, cleaned_sha256
FROM counted
"""


def query(spark, sf_dir: str) -> DataFrame:
    judged = line_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("cleaned_sha256"))
