"""Texts as symbol sequences in numpy, their window regions as rows, and removal of covered symbols.

Shared by the byte-wise (suffix array) and the word-wise (fingerprint index) removal of repeated passages.
A document row is told apart by ``doc_id`` and a 64-bit hash of its text, so repeated ids are no problem.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import winnow
from quillon.plans.shared import small_batches

#: symbols worked on at a time; longer texts go in overlapping pieces
PIECE = 1 << 19
#: bytes of texts worked on at a time; a longer text goes alone
SLICE = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True  # [\x20\x09-\x0D]
KEYS = "doc_id long, text_key long"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, text); a null text is empty, other columns go."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column end to end, and the offsets of its rows."""
    a = column.cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the words ``[^\\x20\\x09-\\x0D]+`` of texts laid end to end, and the number of words of each; breaks: bytes between words."""
    solid = ~breaks[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(raw) + 1, dtype=bool)
    before[1:] = solid
    starts = np.flatnonzero(solid & (~before[:-1] | edge[:-1]))
    after = np.ones(len(raw), dtype=bool)
    after[:-1] = ~solid[1:]
    stops = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, stops, np.diff(np.searchsorted(starts, offsets))


def word_symbols(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word, taken over blocks so that very long inputs need little memory."""
    out = np.empty(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        end = max(k + 1, int(np.searchsorted(stops, starts[k] + 2 * PIECE, side="right")))
        base = starts[k]
        sums = winnow.prefix_sums(raw[base : stops[end - 1]])
        out[k:end] = winnow.span_hash(sums, starts[k:end] - base, stops[k:end] - base)
        k = end
    return out


def slices(batches: Iterator[pa.RecordBatch], text_col: str | int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about SLICE bytes of text or one row."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_col)), 0)).astype(np.int64)
        piece = np.cumsum(lengths) // SLICE
        edges = [*(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)] if len(piece) else []
        for a, b in zip([0, *edges], edges):  # noqa: B905  pairs of neighbours
            yield batch.slice(a, b - a)


def unrepeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches without rows of the same (doc_id, text_key) as the row before, as a sorted join leaves repeated rows."""
    last = None
    for batch in batches:
        keys = list(zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), strict=True))
        keep = [k != b for b, k in zip([last, *keys], keys)]  # noqa: B905  each with the one before
        last = keys[-1] if keys else last
        yield batch if all(keep) else batch.filter(pa.array(keep))


def symbols(column: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows end to end and their counts; unit: byte or word."""
    raw, offsets = flat(column)
    if unit == "byte":
        return raw, np.diff(offsets)
    starts, stops, counts = word_bounds(raw, offsets)
    return word_symbols(raw, starts, stops), counts


def pieces(lengths: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut sequences into (start, stop, row of each, offset in its row of each), none above PIECE symbols.

    Rows go whole, several at a time; a longer row goes alone in pieces that overlap by width - 1 symbols.
    """
    ends = np.cumsum(lengths)
    row = 0
    while row < len(lengths):
        begin = ends[row] - lengths[row]
        if lengths[row] > PIECE:
            at = 0
            while at + width <= lengths[row]:
                stop = min(lengths[row], at + PIECE)
                yield begin + at, begin + stop, np.array([row]), np.array([at])
                if stop == lengths[row]:
                    break
                at = stop - width + 1
            row += 1
        else:
            end = max(row + 1, int(np.searchsorted(ends, begin + PIECE, side="right")))
            yield begin, ends[end - 1], np.arange(row, end), np.zeros(end - row, dtype=np.int64)
            row = end


def found_regions(syms: np.ndarray, lengths: np.ndarray, width: int, gram: int) -> Iterator[tuple[np.ndarray, winnow.Regions, np.ndarray]]:
    """(row of each region, regions, shift to add to get positions in the row)."""
    for start, stop, rows, at in pieces(lengths, width):
        own = lengths[rows] if len(rows) > 1 or lengths[rows[0]] <= PIECE else np.array([stop - start])
        r = winnow.regions(syms[start:stop], own, width, gram)
        base = np.cumsum(own) - own
        yield rows[r.sequence], r, at[r.sequence] - base[r.sequence]


def occurrences(docs: DataFrame, unit: str, width: int, gram: int) -> DataFrame:
    """(doc_id, text_key, anchor, region, first, last): every region of every row of ``keyed`` documents.

    ``first`` and ``last`` are the starts of its first and last window, in symbols of the row.
    """

    def scan(batches):
        for batch in slices(batches, "text"):
            syms, lengths = symbols(batch.column("text"), unit)
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for rows, r, shift in found_regions(syms, lengths, width, gram):
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), keys.take(take), pa.array(r.anchor_hash.view(np.int64)), pa.array(r.region_hash.view(np.int64)), pa.array((r.first + shift).astype(np.int32)), pa.array((r.last + shift).astype(np.int32))],
                    names=["doc_id", "text_key", "anchor", "region", "first", "last"],
                )

    return docs.mapInArrow(scan, f"{KEYS}, anchor long, region long, first int, last int")


def covered(runs: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n symbols lie in a window that starts in one of the runs [first, last]."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, runs[:, 0], 1)
    np.add.at(step, np.minimum(runs[:, 1] + width, n), -1)
    return np.cumsum(step[:-1]) > 0


def run_edges(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of True."""
    padded = np.zeros(len(mark) + 2, dtype=np.int8)
    padded[1:-1] = mark
    d = np.diff(padded)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents with ``runs``: all [first, last] pairs of window starts to remove, of their rows; null: none.

    The runs of a document are at most as many as its windows, so a list of them is of the size of its text.
    """
    listed = runs.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return docs.join(listed, docs["doc_id"].eqNullSafe(listed["doc_id"]) & (docs["text_key"] == listed["text_key"]), "left").select(docs["doc_id"], docs["text"], "runs")


def run_lists(column: pa.Array) -> list[np.ndarray]:
    """The runs of each row as an (n, 2) array."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    offsets = np.append(0, np.cumsum(lengths))
    values = column.flatten()
    both = np.stack([np.asarray(values.field(0)), np.asarray(values.field(1))], axis=1).astype(np.int64).reshape(-1, 2)
    return [both[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
