"""Chat formatting by token-level assembly.

Each turn is <|im_start|> role newline text <|im_end|> newline. Its segments are encoded apart and spliced between
reserved ids, which no text can produce; the loss mask and each turn's place in its conversation come from prefix sums
of segment lengths. A control string inside a text is escaped reversibly: a backslash goes into every ``<|`` after the
``<`` (and one more into every ``<\\|``), so the formatted string is unambiguous as well.

Conversations are streamed in turn order: a task holds one batch of rows, however long a conversation is.

Defined results: a null or empty text is an empty turn; a null role is an empty role; turns of one number are ordered
by role, then text; repeated rows are repeated turns; a null conv_id is a conversation of its own; an empty table gives
an empty result; extra columns stay, and give way to an output of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.llm.common import ROWS_AT_ONCE, quoted, table

START, END = "<|im_start|>", "<|im_end|>"
#: Longer segments are encoded in parts; ids are decoded as bytes, so a cut changes no text.
PART = 20_000


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


class Codec:
    """A byte-level vocabulary of ranks with two reserved ids after it."""

    _own: dict[str, Codec] = {}

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.start, self.end = max(ranks.values()) + 1, max(ranks.values()) + 2
        self.newline = self.encode("\n")

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if path not in cls._own:
            cls._own[path] = cls(path, pattern)
        return cls._own[path]

    def encode(self, text: str) -> list[int]:
        return [i for at in range(0, len(text), PART) for i in self.encoding.encode_ordinary(text[at : at + PART])]

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8")

    def turn(self, role: str | None, text: str | None) -> tuple[list[int], int, int]:
        """A turn's ids, and where the text's ids begin and end: prefix sums of the segments' lengths."""
        segments = [[self.start], self.encode(_escape_role(role or "")), self.newline, self.encode(escape(text or "")), [self.end], self.newline]
        ends = np.cumsum([len(s) for s in segments])
        return [i for s in segments for i in s], int(ends[2]), int(ends[3])

    def formatted(self, ids: list[int]) -> str:
        """The string of ids, with the reserved ones as control strings."""
        out, part = [], []
        for i in ids:
            if i in (self.start, self.end):
                out += [self.decode(part), START if i == self.start else END]
                part = []
            else:
                part.append(i)
        return "".join([*out, self.decode(part)])

    def read(self, ids: list[int]) -> tuple[str, str]:
        """Role and text of a turn's ids."""
        role, _, text = self.decode(ids[ids.index(self.start) + 1 : ids.index(self.end)]).partition("\n")
        return _unescape_role(role), unescape(text)


FORMATTED = "position long, ids binary, n_tokens long, start_token long, loss_start long, loss_end long"


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def format_chats(turns: DataFrame, vocabulary: tuple[str, str], conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each turn, in order within its partition: the columns of ``turns``, the turn's position in its
    conversation, its ids (little-endian unsigned 32-bit), and as token offsets in the conversation its start and the
    loss mask, which is empty (loss_start = loss_end) but for assistants."""
    new = T._parse_datatype_string(FORMATTED)
    names = {f.name for f in new}
    kept = [c for c in turns.columns if c.lower() not in names]
    schema = T.StructType([turns.schema[c] for c in kept] + list(new.fields))
    out_names = to_arrow_schema(schema).names
    extra = [F.col(quoted(c)).cast("string").alias(f"__{i}__") for i, c in enumerate((role, text))]
    source = turns.select(*[F.col(quoted(c)) for c in kept], F.to_json(F.struct(F.col(quoted(conv)))).alias("__key__"), *extra, F.col(quoted(turn)).alias("__turn__"))
    ordered = source.repartition(F.col("__key__")).sortWithinPartitions("__key__", "__turn__", "__0__", "__1__").drop("__turn__")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(*vocabulary)
        now, position, tokens = None, 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                made: list[list] = [[] for _ in new]
                for key, who, said in zip(*(batch.column(batch.num_columns - k).to_pylist() for k in (3, 2, 1)), strict=True):
                    if key != now:
                        now, position, tokens = key, 0, 0
                    ids, first, last = codec.turn(who, said)
                    first = first if who == "assistant" else last
                    row = (position, np.array(ids, "<u4").tobytes(), len(ids), tokens, tokens + first, tokens + last)
                    for column, value in zip(made, row, strict=True):
                        column.append(value)
                    position, tokens = position + 1, tokens + len(ids)
                columns = [pa.array(c, f.type) for c, f in zip(made, to_arrow_schema(new), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *columns], names=out_names)

    return ordered.mapInArrow(run, schema)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(formatted: DataFrame, vocabulary: tuple[str, str]) -> DataFrame:
    """Digests of what format_chats() made, read back from its ids and mask. Rows must still be in its order."""
    schema = T._parse_datatype_string(DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(*vocabulary)
        state = None
        for batch in batches:
            done = []
            for conv, position, raw, start, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if position == 0:
                    done += [state] if state else []
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(raw, "<u4").tolist()
                role, text = codec.read(ids)
                loss = unescape(codec.decode(ids[first - start : last - start]))
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(codec.formatted(ids))
            if done:
                yield _digests(done, schema)
        if state:
            yield _digests([state], schema)

    return formatted.select("conv_id", "position", "ids", "start_token", "loss_start", "loss_end").mapInArrow(run, schema)


def _digests(states: list[list], schema: T.StructType) -> pa.RecordBatch:
    rows = [(c, n, a.hexdigest(), chars, b.hexdigest(), total) for c, n, a, chars, b, total in states]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), to_arrow_schema(schema), strict=True)], schema=to_arrow_schema(schema))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = f"{END}{START}assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    vocabulary = default_vocabulary()
    return digest(format_chats(turns, vocabulary), vocabulary)
