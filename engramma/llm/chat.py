"""Chat formatting by columnar byte assembly.

A conversation becomes one string: for each turn ``### role: text</turn>\\n``. Inside roles and texts the bytes ``\\``,
``#``, ``<`` and ``:`` (roles only) get a backslash before them, so that no text can forge a header or an end mark and
the original can be read back exactly. The formatted column is one preallocated buffer: segment lengths give cumulative
offsets, the offsets give scatter indices, and headers and contents are copied by numpy into place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramma.llm.bytekit import buffers, table_of

OPEN, COLON, CLOSE = b"### ", b": ", b"</turn>\n"
ESCAPED = table_of(b"\\#<")
ESCAPED_ROLE = table_of(b"\\#<:")
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.)*+)</turn>\n", re.S)
_UNESCAPE = re.compile(r"\\(.)", re.S)


def _escape(data: np.ndarray, offs: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a backslash before each special one, and the new offsets."""
    hit = special[data]
    grown = np.zeros(len(data) + 1, np.int64)
    np.cumsum(1 + hit, out=grown[1:])
    out = np.full(grown[-1], 92, np.uint8)
    out[grown[1:] - 1] = data
    return out, grown[offs]


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offs: np.ndarray) -> None:
    """Copies segment i of ``data`` to ``out[at[i]:]``, all segments in one assignment."""
    lens = np.diff(offs)
    if len(data):
        out[np.repeat(at - offs[:-1], lens) + np.arange(len(data))] = data


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array, trained_role: str = "assistant") -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Conversation bounds (row indices), the formatted strings, and the loss spans in code points of each conversation.

    Rows come ordered by conversation and turn. Null roles and texts are empty.
    """
    n = len(conv)
    bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]])), [n]]) if n else np.zeros(1, np.int64)
    rd, ro = _escape(*buffers(roles), ESCAPED_ROLE)
    td, to = _escape(*buffers(texts), ESCAPED)
    fixed = [np.frombuffer(x, np.uint8) for x in (OPEN, COLON, CLOSE)]
    lens = [np.full(n, len(fixed[0])), np.diff(ro), np.full(n, len(fixed[1])), np.diff(to), np.full(n, len(fixed[2]))]
    turn = np.zeros(n + 1, np.int64)
    np.cumsum(sum(lens), out=turn[1:])
    out = np.empty(turn[-1], np.uint8)
    at = turn[:-1].copy()
    for k, part in enumerate((fixed[0], (rd, ro), fixed[1], (td, to), fixed[2])):
        if k == 3:
            text_at = at.copy()
        if isinstance(part, tuple):
            _scatter(out, at, *part)
        else:
            _scatter(out, at, np.tile(part, n), np.arange(n + 1) * len(part))
        at = at + lens[k]
    chars = np.zeros(len(out) + 1, np.int64)  # code points before each byte
    np.cumsum((out & 0xC0) != 0x80, out=chars[1:])
    conv_at = turn[bounds]
    formatted = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(conv_at.astype(np.int64)), pa.py_buffer(out))
    trained = np.array([r == trained_role for r in roles.to_pylist()], bool) if n else np.zeros(0, bool)
    base = np.repeat(chars[conv_at[:-1]], np.diff(bounds))
    start, stop = chars[text_at] - base, chars[text_at + lens[3]] - base
    rows = np.flatnonzero(trained)
    span_offs = np.searchsorted(rows, bounds).astype(np.int32)
    spans = pa.ListArray.from_arrays(pa.array(span_offs), pa.StructArray.from_arrays([pa.array(start[rows]), pa.array(stop[rows])], ["start", "stop"]))
    return bounds, formatted.cast(pa.string()), spans


def format_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and stop in code points, of the trained role's texts).

    Rows go by turn, nulls first, ties by role and text; a null conversation id is a conversation; null role or text
    is empty; equal turns of a conversation all stay; columns besides the four are not read, whatever their names; an
    empty table gives no rows. A conversation is held in memory by one task, as its output row must be.
    """
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            ids = t.column("conv_id").combine_chunks()
            null, known = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy(zero_copy_only=False)
            key = np.concatenate([[0], np.cumsum((null[1:] != null[:-1]) | (known[1:] != known[:-1]))])
            bounds, formatted, spans = assemble(key, t.column("role").combine_chunks(), t.column("text").combine_chunks(), trained_role)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(bounds[:-1])), formatted, spans], ["conv_id", "formatted", "loss_spans"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.table(b)
            ids = t.column("conv_id").to_pylist()
            cut = len(ids)  # the last conversation may go on in the next batch
            while cut and ids[cut - 1] == ids[-1]:
                cut -= 1
            if cut:
                yield done(pa.concat_tables([*held, t.slice(0, cut)]))
                held = [t.slice(cut)]
            elif held and held[-1].column("conv_id")[0].as_py() != ids[0]:
                yield done(pa.concat_tables(held))
                held = [t]
            else:
                held.append(t)
        if held:
            yield done(pa.concat_tables(held))

    return rows.mapInArrow(run, "conv_id bigint, formatted string, loss_spans array<struct<start: bigint, stop: bigint>>")


def parse_formatted(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        turns.append((_UNESCAPE.sub(r"\1", m[1]), _UNESCAPE.sub(r"\1", m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from nothing but the formatted strings and their loss spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for cid, s, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse_formatted(s)
                loss = "".join(_UNESCAPE.sub(r"\1", s[x["start"] : x["stop"]]) for x in spans)
                sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                rows.append((cid, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(s)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
