"""Chat formatting at token level.

A turn is a sequence of segments: turn mark, role, body mark, text, end mark. Role and text are encoded each by itself;
the marks are reserved ids behind the vocabulary, which no text can produce. The loss mask follows from the segment
lengths: +1 where an assistant's text begins, -1 where it ends, summed up. Control strings in content are escaped with
backslashes, reversibly, so that the rendered text shows a control string only where there is a mark.

Null roles and texts count as empty. Turns of a conversation are ordered by turn, then role, then text; repeated rows
are repeated turns. Rows without a conversation id form one conversation without an id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fanchart.llm.arrow import map_rows, ship_package
from fanchart.llm.bpe import Tokenizer, read_ranks, sentencepiece_model, tokenizer

# The template. The marks take the ids behind the vocabulary in this order.
MARKS = ["<|turn|>", "<|body|>", "</turn>"]
TURN, BODY, END = range(3)
CONTROL = [*MARKS, "<|endoftext|>", "### System:", "### User:", "### Assistant:"]
LOSS_ROLE = "assistant"

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)) + r"|\\")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Double every backslash, and put one behind the first character of every control string."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Template:
    """Assembles turns of ids, and reads them back."""

    def __init__(self, own: Tokenizer):
        self.own = own
        self.first_mark = len(own.token_bytes)

    def assemble(self, roles: list[str], texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, loss mask) of each turn."""
        encoded = list(self.own.encode_all([escape(t) for t in roles + texts]))
        for role, role_ids, text_ids in zip(roles, encoded, encoded[len(roles) :]):
            first = self.first_mark
            ids = [first + TURN, *role_ids, first + BODY, *text_ids, first + END]
            steps = np.zeros(len(ids), dtype=np.int8)
            if role == LOSS_ROLE and text_ids:
                steps[len(role_ids) + 2] += 1
                steps[-1] -= 1
            yield np.array(ids, dtype=np.int32), np.cumsum(steps, dtype=np.int8)

    def render(self, ids: np.ndarray) -> str:
        """The formatted text of a turn, marks included."""
        parts = [MARKS[i - self.first_mark].encode() if i >= self.first_mark else self.own.token_bytes[i] for i in ids.tolist()]
        return b"".join(parts).decode()

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """(role, text) of a turn, by its marks."""
        body, end = (int(np.flatnonzero(ids == self.first_mark + mark)[0]) for mark in (BODY, END))
        return self.text_of(ids[1:body]), self.text_of(ids[body + 1 : end])

    def text_of(self, ids: np.ndarray) -> str:
        return unescape(self.own.decode(ids.tolist()).decode())


def format_turns(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with ``ids`` (32-bit little-endian) and ``loss`` (a byte per id), row by row."""
    model = turns.sparkSession.sparkContext.broadcast(sentencepiece_model(read_ranks(path)))

    def start():
        template = Template(tokenizer(model.value, pattern))

        def formatted(roles: list[str | None], texts: list[str | None]) -> list[tuple]:
            made = template.assemble([r or "" for r in roles], [t or "" for t in texts])
            return [(ids.tobytes(), mask.tobytes()) for ids, mask in made]

        return formatted

    return map_rows(turns, ["role", "text"], {"ids": "binary", "loss": "binary"}, start, sliced=True)


SUMMARY = {
    "conv_id": pa.int64(),
    "n_turns": pa.int64(),
    "turns_sha256": pa.string(),
    "loss_chars": pa.int64(),
    "loss_sha256": pa.string(),
    "formatted_chars": pa.int64(),
    "n_tokens": pa.int64(),
    "loss_tokens": pa.int64(),
}


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per conversation, from ids and masks alone: the digests of what they decode to.

    Conversations stream through a task in order of their turns with a running digest, so a very long one takes no more
    memory. A digest is sequential by nature: one conversation is one task's work, but its turns were formatted anywhere.
    """
    ship_package(formatted.sparkSession)
    model = formatted.sparkSession.sparkContext.broadcast(sentencepiece_model(read_ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, nothing = Template(tokenizer(model.value, pattern)), object()
        current, done, state = nothing, [], None
        for batch in batches:
            for conv_id, ids, mask in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if current is nothing or conv_id != current:
                    if state:
                        done.append(state.row(current))
                    current, state = conv_id, _Reading(template)
                state.add(np.frombuffer(ids, dtype=np.int32), np.frombuffer(mask, dtype=np.int8))
            if len(done) > 1000:
                yield _batch(done)
                done = []
        if state:
            done.append(state.row(current))
        yield _batch(done)

    kinds = {"int64": "bigint", "string": "string"}
    schema = ", ".join(f"{name} {kinds[str(kind)]}" for name, kind in SUMMARY.items())
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "ids", "loss").mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in SUMMARY]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, SUMMARY.values())], names=list(SUMMARY))


class _Reading:
    """Running digests of one conversation."""

    def __init__(self, template: Template):
        self.template = template
        self.turns = self.loss_chars = self.chars = self.tokens = self.loss_tokens = 0
        self.turns_digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray, mask: np.ndarray) -> None:
        role, text = self.template.read(ids)
        self.turns += 1
        self.tokens += len(ids)
        self.chars += len(self.template.render(ids))
        self.turns_digest.update(f"{role}\n{text}\n".encode())
        under = ids[mask == 1]
        loss = self.template.text_of(under)
        self.loss_tokens += len(under)
        self.loss_chars += len(loss)
        self.loss_digest.update(loss.encode())

    def row(self, conv_id: int | None) -> tuple:
        return (
            conv_id, self.turns, self.turns_digest.hexdigest(), self.loss_chars, self.loss_digest.hexdigest(),
            self.chars, self.tokens, self.loss_tokens,
        )
