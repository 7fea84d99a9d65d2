"""Chat formatting by columnar byte assembly.

Turns are ordered by (conv_id, turn) through a range exchange, so a conversation of any length spreads over tasks. Of a
batch of turns the segment lengths, their offsets and the scatter indices are computed in numpy, and marks, roles and
texts are copied into one preallocated Arrow buffer. A batch gives one row for each conversation that it holds part of;
only the first and the last of a batch can go on in another one, and only these meet again to be digested whole.

Template: <|im_start|>role LF text <|im_end|> LF. Inside texts and roles every `<`, backslashes, `|` gets one more
backslash before the `|`, so marks never occur there and taking one away restores the text; roles also write a
backslash and a line feed as two characters each. The loss mask covers the texts of assistant turns.

Null texts and roles count as empty. Rows of one turn number follow by role, then text; a null number comes first, and
a null conv_id is a conversation of its own. Equal rows are separate turns. A very long text is one row of the one
batch that it fills. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, lengths, slices

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"
GUARDED = re.compile(r"<\\(\\*)\|")


def escape(text: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(text, r"<(\\*)\|", r"<\\\1|")


def unescape(text: str) -> str:
    return GUARDED.sub(r"<\1|", text)


def escape_role(role: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(role, "\\", "\\\\"), "\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def pool(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and the size of each."""
    sizes = lengths(text)
    begin = np.frombuffer(text.buffers()[1], np.int32, 1, text.offset * 4)[0]
    data = np.frombuffer(text.buffers()[2], np.uint8, sizes.sum(), begin) if sizes.sum() else np.zeros(0, np.uint8)
    return data, sizes


def assemble(role: pa.Array, text: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted texts of the groups of rows that begin at `first`; of each row where its text begins and ends there, in characters."""
    n = len(text)
    marks = [np.frombuffer(m.encode(), np.uint8) for m in (START, MIDDLE, END)]
    (roles, role_sizes), (texts, text_sizes) = pool(role), pool(text)
    source = np.concatenate([*marks, roles, texts])
    sizes = np.empty((n, 5), np.int64)
    sizes[:] = len(marks[0]), 0, len(marks[1]), 0, len(marks[2])
    sizes[:, 1], sizes[:, 3] = role_sizes, text_sizes
    begins = np.cumsum([0, *map(len, marks)])
    at = np.empty((n, 5), np.int64)
    at[:, 0], at[:, 2], at[:, 4] = begins[:3]
    at[:, 1] = begins[3] + np.cumsum(role_sizes) - role_sizes
    at[:, 3] = begins[3] + len(roles) + np.cumsum(text_sizes) - text_sizes
    ends = np.cumsum(sizes.ravel())
    total = int(ends[-1]) if n else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    # of each byte of the output, which byte of the source it is
    np.take(source, np.arange(total) + np.repeat(at.ravel() - (ends - sizes.ravel()), sizes.ravel()), out=out)
    row_ends = ends.reshape(n, 5)[:, 4]
    offsets = np.append(np.append(0, row_ends)[first], total).astype(np.int32)
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), buffer)
    heads = len(START) + len(MIDDLE) + np.asarray(pc.utf8_length(role)).astype(np.int64)
    chars = np.asarray(pc.utf8_length(text)).astype(np.int64)
    row = heads + chars + len(END)
    before = np.cumsum(row) - row
    group = np.searchsorted(first, np.arange(n), "right") - 1
    begin = before - before[first][group] + heads
    return formatted, begin, begin + chars


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, part (ascending in a conversation), whole (no other part), n_turns, formatted, loss (array of start, end in characters)."""
    spark = turns.sparkSession
    kind = turns.schema["conv_id"].dataType.simpleString()
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    picked = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    ordered = picked.repartitionByRange("conv_id", "turn", F.xxhash64("role", "text")).sortWithinPartitions("conv_id", "turn", "role", "text")
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text"):
            conv, role = column(batch, "conv_id"), column(batch, "role")
            ids = conv.dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.append(0, np.flatnonzero(np.diff(ids)) + 1)
            formatted, begin, end = assemble(escape_role(role), escape(column(batch, "text")), first)
            trained = np.asarray(pc.equal(role, TRAINED))
            counts = np.add.reduceat(trained.astype(np.int64), first)
            flat = pa.StructArray.from_arrays([pa.array(begin[trained], pa.int32()), pa.array(end[trained], pa.int32())], ["start", "end"])
            whole = np.ones(len(first), bool)
            whole[[0, -1]] = False
            yield pa.RecordBatch.from_pydict({
                "conv_id": conv.take(pa.array(first)), "part": pa.array(part + np.arange(len(first))), "whole": pa.array(whole),
                "n_turns": pa.array(np.diff(np.append(first, len(ids)))), "formatted": formatted,
                "loss": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), flat).cast(spans),
            })
            part += len(first)

    return ordered.mapInArrow(run, f"conv_id {kind}, part bigint, whole boolean, n_turns bigint, formatted string, loss array<struct<start:int,end:int>>")


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn."""
    for turn in formatted.split(START)[1:]:
        role, text = turn.removesuffix(END).split(MIDDLE, 1)
        yield unescape_role(role), unescape(text)


class Reader:
    """What is read back from the formatted parts of one conversation, in order."""

    def __init__(self, conv: object):
        self.conv, self.turns, self.chars, self.loss_chars = conv, 0, 0, 0
        self.every, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict]) -> None:
        for role, text in parse(formatted):
            self.turns += 1
            self.every.update(f"{role}\n{text}\n".encode())
        for span in loss:
            text = unescape(formatted[span["start"] : span["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.turns, self.every.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def table(rows: list[tuple], conv: pa.DataType) -> dict[str, pa.Array]:
    each = list(zip(*rows, strict=True)) or [()] * (1 + len(DIGEST))
    return {n: pa.array(list(x), k) for (n, k), x in zip([("conv_id", conv), *DIGEST.items()], each, strict=True)}


def digest(parts: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted parts.

    A part that is whole is digested by the task that formatted it. Only the others are stored, and meet again by
    conversation and part; as a digest goes on from byte to byte, a long conversation is streamed through one task.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    carried = ["part", "formatted", "loss"]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole, conv = column(batch, "whole"), column(batch, "conv_id")
            done = batch.filter(whole)
            rows = []
            for name, formatted, loss in zip(*(column(done, c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                reader = Reader(name)
                reader.add(formatted, loss)
                rows.append(reader.row())
            if rows:
                yield pa.RecordBatch.from_pydict(table(rows, conv.type) | {c: pa.nulls(len(rows), column(batch, c).type) for c in carried})
            rest = batch.filter(pc.invert(whole))
            if rest.num_rows:
                yield pa.RecordBatch.from_pydict({"conv_id": column(rest, "conv_id")} | {n: pa.nulls(rest.num_rows, k) for n, k in DIGEST.items()} | {c: column(rest, c) for c in carried})

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, conv = None, None
        for batch in slices(batches, "formatted"):
            rows, conv = [], column(batch, "conv_id").type
            for name, formatted, loss in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                if reader is None or name != reader.conv:
                    rows += [reader.row()] if reader else []
                    reader = Reader(name)
                reader.add(formatted, loss)
            if rows:
                yield pa.RecordBatch.from_pydict(table(rows, conv))
        if reader:
            yield pa.RecordBatch.from_pydict(table([reader.row()], conv))

    stored = cut(parts.mapInArrow(inside, f"{out}, part bigint, formatted string, loss array<struct<start:int,end:int>>"))
    names = out.replace(",", "").split()[::2]
    rest = stored.filter("formatted is not null").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return stored.filter("formatted is null").select(*names).unionByName(rest.select("conv_id", "formatted", "loss").mapInArrow(across, out))


def duck_sql() -> str:
    """The digest of all conversations and conversation -1 in DuckDB."""
    line = "chr(10)"
    guarded = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
    role = guarded.format(rf"replace(replace(role, '\', '\\'), {line}, '\n')")
    loss = f"coalesce(string_agg(CASE WHEN role = '{TRAINED}' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || {line} || text || {line}, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  length({loss}) AS loss_chars, sha256({loss}) AS loss_sha256,
  sum({len(START) + len(MIDDLE) + len(END)} + length({role}) + length({guarded.format("text")}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""
