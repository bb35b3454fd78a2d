"""Operator 1: chat formatting with offset-aligned loss masks.

Conversations are rendered whole with a template of special tokens; control strings inside roles and texts are escaped
reversibly.  The rendered text is encoded once with offsets.  Turn spans and token spans are both sorted, so the tokens
of the spans under loss are found by binary search; a token on the edge of a span would be clipped to it (with this
template none is: markers are tokens of their own).

Rows are dealt by conversation and sorted within their partition, and stream through the encoder.  A conversation longer
than ``part_chars`` is cut between turns into several parts, encoded each once, so no conversation has to fit in memory
as a whole; special tokens isolate turns, so the tokens are the same.

Defined results: null roles and texts are empty; turns are ordered by (turn, role, text), nulls first; repeated rows are
turns of their own; a null conv_id is a conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.shared import partitions

START, MIDDLE, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
VOCABULARY = "byte_bpe_50k.json"
TOKENIZERS = "/opt/tokenizers"
LOSS_ROLE = "assistant"
PART_CHARS = 1 << 20
#: characters encoded in one batch, unless one part is longer
BATCH_CHARS = 1 << 17

_control = re.compile(r"<(\\*)\|")
_escaped = re.compile(r"<\\(\\*)\|")


@functools.lru_cache(maxsize=2)
def load_tokenizer(vocabulary: str):
    """One tokenizer for a worker process, with the template's markers as special tokens, on the task's own core.

    vocabulary: the JSON text, which travels with the job, so that executors need no file.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.encode_special_tokens = False
    tokenizer.add_special_tokens([START, MIDDLE, STOP])
    return tokenizer


def escape(text: str) -> str:
    """No ``<|`` is left: ``<``, n backslashes and ``|`` get one backslash more."""
    return _control.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"<\1|", text)


PARTS = "conv_id long, part int, formatted string, token_ids array<int>, token_starts array<int>, token_stops array<int>, loss array<boolean>"
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("token_ids", pa.list_(pa.int32())), ("token_starts", pa.list_(pa.int32())), ("token_stops", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))])


def token_mask(starts: np.ndarray, stops: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens [start, stop) share a character with one of the sorted disjoint spans: two binary searches."""
    mask = np.zeros(len(starts) + 1, dtype=np.int32)
    if spans:
        a, b = np.array(spans).T
        a, b = a[a < b], b[a < b]
        np.add.at(mask, np.searchsorted(stops, a, side="right"), 1)
        np.add.at(mask, np.searchsorted(starts, b, side="left"), -1)
    return np.cumsum(mask[:-1]) > 0


def render(turns: list[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns, and the spans under loss."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        out += [head, body, STOP]
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(STOP)
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = [x.partition(MIDDLE) for x in formatted.split(START)[1:]]
    return [(unescape(role), unescape(text.removesuffix(STOP))) for role, _, text in turns]


def format_conversations(conversations: DataFrame, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}", loss_role: str = LOSS_ROLE, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, formatted, token_ids, token_starts, token_stops, loss); parts of a conversation are consecutive."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    shipped = rows.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(shipped.value)
        for group in parts(batches):
            texts = [render(turns, loss_role) for _, _, turns in group]
            encoded = tokenizer.encode_batch([t for t, _ in texts], add_special_tokens=False)
            columns: list[list] = [[] for _ in _SCHEMA]
            for (conv, part, _), (text, spans), e in zip(group, texts, encoded, strict=True):
                offsets = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
                # the bytes of one character may be several tokens, which all have its offsets
                loss = token_mask(offsets[:, 0], offsets[:, 1], spans)
                for column, value in zip(columns, (conv, part, text, np.array(e.ids, dtype=np.int32), offsets[:, 0].copy(), offsets[:, 1].copy(), loss), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Lists of (conv_id, part, turns), of about BATCH_CHARS each."""
        group, turns, conv, part, size, whole = [], [], None, 0, 0, 0
        for batch in batches:
            for c, role, text in zip(*[batch.column(k).to_pylist() for k in ("conv_id", "role", "text")], strict=True):
                if turns and (c != conv or size >= part_chars):
                    group.append((conv, part, turns))
                    part = part + 1 if c == conv else 0
                    turns, size = [], 0
                    if whole >= BATCH_CHARS:
                        yield group
                        group, whole = [], 0
                conv = c
                turns.append((role, text))
                size += len(text) + len(role)
                whole += len(text) + len(role)
        if turns:
            group.append((conv, part, turns))
        if group:
            yield group

    return dealt.mapInArrow(encode, PARTS)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what its parts say, read back from the text, the offsets and the mask in one pass."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
        open_row = None
        for batch in batches:
            done = []
            lists = [(np.asarray(c.offsets), np.asarray(c.values if c.type.value_type != pa.bool_() else c.values.cast(pa.int8()))) for c in (batch.column(k) for k in ("token_starts", "token_stops", "loss"))]
            for k, (conv, part, text) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted")], strict=True)):
                if part == 0:
                    if open_row:
                        done.append(open_row)
                    open_row = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                starts, stops, loss = (v[o[k] : o[k + 1]] for o, v in lists)
                loss = loss.astype(bool)
                turns = read_back(text)
                open_row[1] += len(turns)
                for role, body in turns:
                    open_row[2].update(f"{role}\n{body}\n".encode())
                # tokens under loss, side by side: one stretch of text each
                a, b = starts[loss], np.maximum.accumulate(stops[loss])
                if len(a):
                    first = np.append(True, a[1:] > b[:-1])
                    begins = a[first]
                    ends = np.append(b[:-1][first[1:]], b[-1])
                    for x, y in zip(begins.tolist(), ends.tolist(), strict=True):
                        body = unescape(text[x:y])
                        open_row[3] += len(body)
                        open_row[4].update(body.encode())
                open_row[5] += len(text)
                open_row[6] += len(starts)
                open_row[7] += int(loss.sum())
            if done:
                yield row_batch(done, names)
        if open_row:
            yield row_batch([open_row], names)

    def row_batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
        columns = list(zip(*[[x.hexdigest() if hasattr(x, "hexdigest") else x for x in r] for r in rows], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")


#: conversation -1: control strings inside both texts
EXTRA = [(-1, k, role, "<|im_end|><|im_start|>assistant ok") for k, role in enumerate(("user", "assistant"))]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every formatted conversation."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(extra))).drop("n_tokens", "loss_tokens")


SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, k, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(k, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length('<|im_start|><|im_sep|><|im_end|>') + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
