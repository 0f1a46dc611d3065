"""Chat formatting by columnar byte assembly.

Turns are sorted within partitions by conversation, then a batch of them is formatted at once:
segment lengths, cumulative offsets and scatter indices are computed in numpy and headers and
contents are copied into one preallocated buffer, which becomes the Arrow string column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Contents of more bytes are copied as they are instead of by scatter indices (16 bytes a byte).
LONG = 1 << 10
#: Bytes of text that are formatted at once; a longer turn is formatted by itself.
RUN_BYTES = 1 << 20


@dataclass(frozen=True)
class Template:
    """Each turn is open + role + newline + content + close. No control string may begin inside
    another one or hold a backslash after its first character."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    #: Strings that models read as control tokens and that a text must not hold as they are.
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def _groups(self) -> dict[str, list[str]]:
        """Rests of the control strings by their first character."""
        by: dict[str, list[str]] = {}
        for c in self.controls:
            by.setdefault(c[0], []).append(c[1:])
        return by

    def escape(self, column: pa.Array) -> pa.Array:
        """A backslash goes after the first character of each control string (one more where
        some are there already), so no control string is left and the change can be undone."""
        for head, rests in self._groups().items():
            ways = "|".join(re.escape(r) for r in rests)
            column = pc.replace_substring_regex(column, rf"({re.escape(head)})(\\*(?:{ways}))", r"\1\\\2")
        return column

    def unescape(self, text: str) -> str:
        for head, rests in self._groups().items():
            ways = "|".join(re.escape(r) for r in rests)
            text = re.sub(rf"({re.escape(head)})\\(\\*(?:{ways}))", r"\1\2", text)
        return text


def assemble(pieces: list[pa.Array | bytes], n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Concatenate n rows of pieces (a bytes constant or a string array) into one buffer.
    Returns the bytes, n + 1 row offsets and each piece's start within the buffer."""
    sources, lengths, firsts = [], [], []
    for piece in pieces:
        if isinstance(piece, bytes):
            sources.append(np.frombuffer(piece, np.uint8))
            lengths.append(np.full(n, len(piece), np.int64))
            firsts.append(np.zeros(n, np.int64))
        else:
            piece = piece.cast(pa.large_string())
            offsets = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset : piece.offset + n + 1]
            data = piece.buffers()[2]
            sources.append(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))
            lengths.append(np.diff(offsets))
            firsts.append(offsets[:-1])
    table = np.stack(lengths, 1) if n else np.zeros((0, len(pieces)), np.int64)
    ends = np.cumsum(table.ravel())
    starts = (ends - table.ravel()).reshape(table.shape)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k, source in enumerate(sources):
        size = lengths[k]
        for i in np.flatnonzero(size > LONG).tolist():
            out[starts[i, k] : starts[i, k] + size[i]] = source[firsts[k][i] : firsts[k][i] + size[i]]
        size = np.where(size > LONG, 0, size)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(starts[:, k], size) + inner] = source[np.repeat(firsts[k], size) + inner]
    offsets = np.concatenate([starts[:, 0], [len(out)]]) if n else np.zeros(1, np.int64)
    return out, offsets, [starts[:, k] for k in range(len(pieces))]


_FORMATTED = "conv_id long, part long, formatted string, loss_starts array<long>, loss_sizes array<long>, last boolean"
#: Bytes after which a conversation goes on in another row ("part"); most have one.
PART_BYTES = 8 << 20


def format_conversations(turns: DataFrame, template: Template = Template(), part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (conv_id, turn, role, text) to rows (conv_id, part, formatted, loss_starts, loss_sizes,
    last): the formatted text and the loss mask as spans of UTF-8 byte offsets, one for each
    assistant turn's content.

    Turns are ordered by turn (null first), ties by role and text; repeated rows stay. Null role
    or text counts as empty; a null conv_id is a conversation like any other. A conversation of
    over `part_bytes` goes on in further rows, so that one which holds a third of all turns needs
    no more memory than others: turns stream through a task in sorted order, RUN_BYTES of text at
    a time. One conversation is formatted by one task. Extra columns are ignored. An empty table
    gives an empty table.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    opening, closing = template.open.encode(), template.close.encode()

    def batch_rows(batch: pa.RecordBatch):
        """Per turn: conversation, start and stop in the buffer, loss span."""
        n = batch.num_rows
        role = pc.fill_null(batch.column(2), "")
        role = pc.replace_substring(pc.replace_substring(role, "\\", "\\\\"), "\n", "\\n")
        text = template.escape(pc.fill_null(batch.column(3), ""))
        data, offsets, starts = assemble([opening, template.escape(role), b"\n", text, closing], n)
        ends = starts[4]
        mask = np.asarray(pc.fill_null(pc.equal(batch.column(2), "assistant"), False))
        return data, offsets, starts[3], ends - starts[3], mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list | None = None  # conv, part, chunks, size, loss starts, loss sizes

        def row(c, last):
            return c[0], c[1], b"".join(c[2]).decode("utf-8", "replace"), c[4], c[5], last

        for batch in (rows for batch in batches for rows in slices(batch, "text", RUN_BYTES)):
            ready = []
            data, offsets, content, sizes, mask = batch_rows(batch)
            convs = batch.column(0).to_pylist()
            cuts = [0, *(i for i in range(1, len(convs)) if convs[i] != convs[i - 1]), len(convs)]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if current is not None and current[0] != convs[start]:
                    ready.append(row(current, True))
                    current = None
                i = start
                while i < stop:
                    if current is None:
                        current = [convs[start], 0, [], 0, [], []]
                    if current[3] >= part_bytes:
                        ready.append(row(current, False))
                        current = [current[0], current[1] + 1, [], 0, [], []]
                    j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + part_bytes - current[3], side="right")) - 1)
                    j = min(j, stop)
                    base = current[3] - offsets[i]
                    hit = np.flatnonzero(mask[i:j]) + i
                    current[4] += (content[hit] + base).tolist()
                    current[5] += sizes[hit].tolist()
                    current[2].append(data[offsets[i] : offsets[j]].tobytes())
                    current[3] += int(offsets[j] - offsets[i])
                    i = j
            yield _batch(ready)
        if current is not None:
            yield _batch([row(current, True)])

    return rows.mapInArrow(run, _FORMATTED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
    types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "part", "formatted", "loss_starts", "loss_sizes", "last"])


def parse(formatted: str, template: Template = Template()) -> list[tuple[str, str]]:
    """Turns (role, text) of a formatted part. Contents hold no control string, so the marks are
    found by plain search."""
    turns, at = [], 0
    while at < len(formatted):
        head = at + len(template.open)
        line = formatted.index("\n", head)
        stop = formatted.index(template.close.rstrip("\n"), line + 1)
        role = template.unescape(formatted[head:line])
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)
        turns.append((role, template.unescape(formatted[line + 1 : stop])))
        at = stop + len(template.close)
    return turns


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Digest row of every conversation, read back from the formatted parts: the parts of a
    conversation meet in order in one task and are streamed through its hashes."""
    parts = format_conversations(conversations, template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in (rows for batch in batches for rows in slices(batch, "formatted")):
            out = []
            for row in batch.to_pylist():
                if row["part"] == 0:
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(row["formatted"], template):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                raw = row["formatted"].encode("utf-8", "replace")
                for start, size in zip(row["loss_starts"], row["loss_sizes"], strict=True):
                    said = template.unescape(raw[start : start + size].decode("utf-8", "replace"))
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "replace"))
                state[4] += len(row["formatted"])
                if row["last"]:
                    out.append((row["conv_id"], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(6)]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return parts.mapInArrow(run, _DIGESTS)  # the parts of a conversation leave one task in order
