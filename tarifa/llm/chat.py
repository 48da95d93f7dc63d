"""Chat formatting by incremental black-box rendering.

The template is a function from turns to a string, and nothing else is known of it. Each prefix of a conversation's turns is
rendered; what an output adds to the one before is the new turn's span. A template that changes what it had
rendered before is found by the same comparison. A rendering with a marker in place of the last text shows where in its
span that text stands. Rendering every prefix takes time with the square of a conversation's length.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]
#: How control strings stand inside a text.
ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t"}
_PLAIN = {v[1]: k for k, v in ESCAPES.items()} | {"c": ":"}
_CODE = re.compile(r"\\(.)", re.DOTALL)
_ROWS = "conv_id bigint, formatted string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, loss_spans string, formatted_chars bigint, rewritten boolean"


def escape(text: str) -> str:
    for plain, coded in ESCAPES.items():  # the backslash first
        text = text.replace(plain, coded)
    return text


def unescape(text: str) -> str:
    return _CODE.sub(lambda m: _PLAIN[m[1]], text)


def template(turns: Turns) -> str:
    """### role: text </turn>, a line each; control strings inside roles and texts are escaped."""
    return "".join(f"### {escape(role).replace(':', '\\c')}: {escape(text)} </turn>\n" for role, text in turns)


def read_back(formatted: str) -> Turns:
    """The turns that `template` was given."""
    turns, at = [], 0
    while at < len(formatted):
        colon = formatted.index(": ", at)
        end = formatted.index(" </turn>\n", colon + 2)
        turns.append((unescape(formatted[at + 4 : colon]), unescape(formatted[colon + 2 : end])))
        at = end + 9
    return turns


class Rendered(NamedTuple):
    text: str
    turn_spans: list[tuple[int, int]]
    loss_spans: list[tuple[int, int]]  # where each trained text stands
    rewritten: list[int]  # turns after which an earlier part of the output was different


def render(turns: Turns, template: Template = template, trained: str = "assistant") -> Rendered:
    before, spans, losses, rewritten = "", [], [], []
    for n, (role, text) in enumerate(turns, 1):
        out = template(turns[:n])
        if out.startswith(before):
            start = len(before)
        else:
            start = len(os.path.commonprefix([before, out]))
            rewritten.append(n - 1)
        spans.append((start, len(out)))
        if role == trained:
            marker = "\x00"
            while marker in out:
                marker += "\x00"
            probe = template([*turns[: n - 1], (role, marker)])
            at = probe.rindex(marker)
            losses.append((at, len(out) - (len(probe) - at - len(marker))))
        before = out
    return Rendered(before, spans, losses, rewritten)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _row(conv_id, turns: Turns, template: Template, trained: str) -> tuple:
    done = render(turns, template, trained)
    read = read_back(done.text)
    loss = "".join(unescape(done.text[a:b]) for a, b in done.loss_spans)
    spans = ",".join(f"{a}:{b}" for a, b in done.loss_spans)
    return conv_id, done.text, len(read), _sha("".join(f"{r}\n{t}\n" for r, t in read)), len(loss), _sha(loss), spans, len(done.text), bool(done.rewritten)


def format_conversations(conversations: DataFrame, template: Template = template, trained: str = "assistant") -> DataFrame:
    """One row a conversation of (conv_id, turn, role, text): the formatted text, digests read back from it, and the loss mask.

    Turns stand by turn number, then role and text, so ties and repeated rows have one order; null turns come first. Null roles
    and texts are empty; rows with a null conv_id are one conversation. An empty table gives an empty result; extra columns
    are not read. A task holds one conversation at a time. loss_spans are start:end in code points of formatted. A template of
    one's own must read back by read_back().
    """

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, turns, rows, size = None, [], [], 0

        def flush() -> pa.RecordBatch:
            schema = [("conv_id", pa.int64()), ("formatted", pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("loss_spans", pa.string()), ("formatted_chars", pa.int64()), ("rewritten", pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], [n for n, _ in schema])

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if turns and conv_id != own:
                    rows.append(_row(own, turns, template, trained))
                    size += len(rows[-1][1])
                    turns = []
                    if size > 8 << 20:
                        yield flush()
                        rows, size = [], 0
                own = conv_id
                turns.append((role or "", text or ""))
        if turns:
            rows.append(_row(own, turns, template, trained))
        if rows:
            yield flush()

    filled = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return filled.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(formatted, _ROWS)


#: A conversation that holds the template's own control strings; the query adds it to the table.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]

ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
sized AS (
  SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c'))
    + length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t')) + 15 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return format_conversations(turns.unionByName(probe)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
