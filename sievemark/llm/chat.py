"""Chat formatting: conversations rendered by a compiled template, and read back from what was rendered."""

from __future__ import annotations

from collections.abc import Iterator
import hashlib
from itertools import groupby
from operator import itemgetter
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.chat_template import TURN, TURN_END, Template, unescaped, unescaped_line
from sievemark.llm.common import batch_of, column_of

#: Marks turns, escapes control strings in what they say, and marks assistants' texts for the loss.
TURNS = (
    "{% for m in messages %}" + TURN + " {{ m.role | line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    + TURN_END + "\n{% endfor %}"
)
_ONE_TURN = re.compile(re.escape(TURN) + r" ((?:[^\\\n]|\\.)*+)\n((?:[^\\<]|\\.|<(?!/turn>))*+)" + re.escape(TURN_END) + r"\n", re.S)

PIECE_CHARS = 1 << 20
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FORMATTED = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("text", pa.string()), ("loss", SPANS)])
FORMATTED_DDL = "conv_id long, piece long, text string, loss array<struct<start:bigint,end:bigint>>"
DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])
DIGESTS_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column_of(batch, c) for c in columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of at most 4,096 rows, or of about a piece of text in column ``weight``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight]) if weight is not None else 0
        if len(held) == 4096 or size >= PIECE_CHARS:
            yield batch_of(schema, **dict(zip(schema.names, zip(*held, strict=True), strict=True)))
            held, size = [], 0
    if held:
        yield batch_of(schema, **dict(zip(schema.names, zip(*held, strict=True), strict=True)))


def format_conversations(turns: DataFrame, template: str = TURNS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """conv_id, piece, text, loss: each conversation's formatted text, and the spans of each piece that a model is to learn.

    A conversation's rows go by turn (NULL last), then role and text; NULL
    roles and texts are empty, repeated rows are turns like others, and rows
    without a conversation make one of their own. Rows are shuffled once by
    conversation and sorted; a task holds a turn and the piece it writes, not
    a conversation, if the template reads ``messages`` in one outer loop.
    Pieces of ``piece_chars`` code points or more end between turns and,
    joined in order, are the formatted text; most conversations are one piece.
    The pieces of a conversation stand in order in one partition. An empty
    table gives no row; other columns are ignored. The order of a conversation makes it one
    task's work however long it is.
    """
    compiled = Template(template)

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple]:
            for conv_id, rows in groupby(_rows(batches, "conv_id", "role", "text"), key=itemgetter(0)):
                messages = ({"role": role, "text": text} for _, role, text in rows)
                for k, (text, spans) in enumerate(compiled.stream(messages, piece_chars)):
                    yield conv_id, k, text, [{"start": a, "end": b} for a, b in spans]

        return _batches(pieces(), FORMATTED, 2)

    def plain(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)

    chosen = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), plain("role"), plain("text"))
    ordered = chosen.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return ordered.mapInArrow(rendered, FORMATTED_DDL)


def turns_of(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a text that ``TURNS`` has formatted; another text is an error."""
    out, at = [], 0
    while at < len(text):
        m = _ONE_TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}: {text[at : at + 40]!r}")
        out.append((unescaped_line(m[1]), unescaped(m[2])))
        at = m.end()
    return out


def read_back(formatted: DataFrame, arranged: bool = False) -> DataFrame:
    """Per conversation, from formatted texts alone: its turns and their digest, what lies under the loss mask, its size.

    ``arranged`` says that a conversation's pieces stand in order in one
    partition, as ``format_conversations`` leaves them; rows read from
    storage are shuffled first. NULL ids are one conversation, an empty table gives no row.
    """

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for conv_id, pieces in groupby(_rows(batches, "conv_id", "text", "loss"), key=itemgetter(0)):
                said, learned, n_turns, n_loss, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for _, text, spans in pieces:
                    for role, words in turns_of(text):
                        said.update(f"{role}\n{words}\n".encode())
                        n_turns += 1
                    for span in spans:
                        words = unescaped(text[span["start"] : span["end"]])
                        learned.update(words.encode())
                        n_loss += len(words)
                    size += len(text)
                yield conv_id, n_turns, said.hexdigest(), n_loss, learned.hexdigest(), size

        return _batches(rows(), DIGESTS)

    if not arranged:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return formatted.mapInArrow(digested, DIGESTS_DDL)
