"""Formatting of conversations by a compiled template, with the spans to train on, and reading back.

Turns are dealt out by conversation and sorted; each task then streams over its turns: no more than a turn
and a part of the output are held, however long a conversation is. Long conversations come out in several
parts, which joined in order are the whole text; spans count code points within their part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import table
from quillon.llm.templates import compile_template, unescape

TEMPLATE = (
    "{% for m in messages %}<|turn|>{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.content | escape }}{% endgeneration %}"
    "{% else %}{{ m.content | escape }}{% endif %}<|end|>\n{% endfor %}"
)
#: A part is closed after the piece that brings it to so many code points.
PART_CHARS = 1 << 20
#: Rows or code points handed on together.
OUT_ROWS, OUT_CHARS = 1_000, 4 << 20
FORMATTED = "conv_id long, part int, text string, spans array<struct<start:bigint,end:bigint>>"
_TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)


def parts_of(pieces: Iterator[tuple[str, bool]], part_chars: int = PART_CHARS) -> Iterator[tuple[str, list[dict]]]:
    """Texts and spans of the parts; neighbouring marked pieces make one span."""
    texts: list[str] = []
    spans: list[dict] = []
    at, was = 0, False
    for text, marked in pieces:
        if marked and text:
            if was and spans and spans[-1]["end"] == at:
                spans[-1]["end"] = at + len(text)
            else:
                spans.append({"start": at, "end": at + len(text)})
        was = marked
        texts.append(text)
        at += len(text)
        if at >= part_chars:
            yield "".join(texts), spans
            texts, spans, at = [], [], 0
    if texts:
        yield "".join(texts), spans


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(0, b.num_rows, 512):
            yield from b.slice(k, 512).to_pylist()


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, text, spans) of every conversation, parts in order within each partition.

    Turns go by number, then role, then text, nulls first; a null role or text is empty, a null conv_id is a
    conversation of its own. Repeated turns are turns. An empty table gives none; other columns are ignored.
    Pieces are never split: an escaped text and a span lie in one part."""
    compile_template(template)  # errors in it show here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        out: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "part", "text", "spans"])

        for conv, turns in groupby(_rows(batches), lambda r: r["conv_id"]):
            messages = ({"role": r["role"] or "", "content": r["text"] or ""} for r in turns)
            for k, (text, spans) in enumerate(parts_of(render(messages), part_chars)):
                out.append((conv, k, text, spans))
                held += len(text)
                if len(out) >= OUT_ROWS or held >= OUT_CHARS:
                    yield batch()
                    out, held = [], 0
        yield batch()

    turns = conversations.select("conv_id", "turn", "role", "text")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the conversations, parsed from the formatted texts of ``TEMPLATE``: turns, and what the spans mark.

    Takes the parts in the order that ``format_conversations`` leaves them in. Raises ValueError on text that
    is not a sequence of turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _digests(_rows(batches)):
            yield b

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digest_of(parts: Iterator[dict]) -> tuple:
    n_turns = loss_chars = formatted = 0
    turns, loss, rest = hashlib.sha256(), hashlib.sha256(), ""
    for p in parts:
        formatted += len(p["text"])
        for s in p["spans"]:
            marked = unescape(p["text"][s["start"] : s["end"]])
            loss_chars += len(marked)
            loss.update(marked.encode())
        rest, at = rest + p["text"], 0
        while m := _TURN.match(rest, at):
            turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            n_turns, at = n_turns + 1, m.end()
        rest = rest[at:]
    if rest:
        raise ValueError(f"not a turn: {rest[:40]!r}")
    return n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted


def _digests(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], names=names)

    for conv, parts in groupby(rows, lambda r: r["conv_id"]):
        out.append((conv, *digest_of(parts)))
        if len(out) >= OUT_ROWS:
            yield batch()
            out.clear()
    yield batch()


#: Fixed value: the conversation that the query adds.
EXTRA = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(turns.unionByName(spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string"))))


_EXTRA_SQL = " UNION ALL ".join(f"SELECT {c}, {t}, '{r}', '{x}'" for c, t, r, x in EXTRA)
OP2_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL {_EXTRA_SQL}),
t AS (SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
n AS (SELECT *, length(text) + length(text) - length(replace(text, '\\', '')) + (length(text) - length(replace(text, '<|', ''))) // 2
    + length(role) + length(role) - length(replace(role, '\\', '')) + length(role) - length(replace(role, chr(10), ''))
    + (length(role) - length(replace(role, '<|', ''))) // 2 + 17 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
