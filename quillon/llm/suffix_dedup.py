"""Operator 9: removal of every byte that a repeated 200-byte string covers, by suffix arrays.

1.  Every window of ``width`` bytes has an anchor (``winnow``); windows can only be equal where anchors are.  Regions, the
    bytes of consecutive windows of one anchor, are counted with map-side sums, so copies of a region are one string with
    its number; a string with several places is repeated throughout.
2.  Where an anchor stands in several different regions, one copy of each region is fetched, and regions of the same
    anchors meet in one task, in slabs of bounded size.  There a suffix array (``lyndon``: linear grouping by Lyndon
    prefixes) over content-defined tokens orders what follows every window's first bytes, and the common prefixes of
    neighbours in it, in bytes, say which windows are equal: those that begin alike up to the next token (compared byte
    by byte) and whose rest is an interval of suffixes with a common prefix of the bytes that are missing.
    An anchor with more than ``hot`` different regions is left out of that and counted window by window instead, so no
    task gets an unbounded group; both ways are exact.
3.  The runs of repeated windows are joined back to the documents, which drop what they cover.

Defined results: null text is empty; a text shorter than a window keeps all; repeated rows (even with one id) are
different documents, so all of a repeated row of ``width`` bytes or more goes; an empty table gives no rows; other
columns are ignored.  Kept bytes need not be valid UTF-8 and are binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import spans, winnow
from quillon.llm.lyndon import RangeMinimum, common_prefixes, suffix_array
from quillon.plans.shared import partitions, staged

WIDTH = 200
GRAM = 48
#: different regions of one anchor that may meet in one task
HOT = 20_000
#: bytes of regions in one suffix array, unless one anchor's regions alone are more
SLAB = 1 << 20
#: a token starts where the two bytes around its start hash to 0 modulo this
TOKEN = 40

_pair = np.arange(65536, dtype=np.uint64)
STARTS_TOKEN = (winnow.finalize(_pair + np.uint64(977)) % np.uint64(TOKEN)) == 0


def equal_windows(raw: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Marks window starts whose ``width`` bytes also start elsewhere in the texts laid end to end in ``raw``.

    Two equal windows have their tokens at the same places, as two bytes decide where a token starts.  So both consist of
    the same bytes up to the first token that starts inside, and of the beginnings of two suffixes of the sequence of tokens.
    """
    n = len(raw)
    mark = np.zeros(n, dtype=bool)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    row = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.flatnonzero(np.arange(n) + width <= ends[row]) if n else np.zeros(0, dtype=np.int64)
    if not len(starts):
        return mark
    # pieces: from a text's start or a token to the next token or the text's end
    opens = np.zeros(n, dtype=bool)
    opens[1:] = STARTS_TOKEN[raw[:-1].astype(np.int64) * 256 + raw[1:]]
    opens[begins[lengths > 0]] = True
    pieces = np.flatnonzero(opens)
    stops = np.append(pieces[1:], n)
    data = raw.tobytes()
    strings = [data[a:b] for a, b in zip(pieces.tolist(), stops.tolist(), strict=True)]
    names = {w: k for k, w in enumerate(sorted(set(strings)))}
    which = np.array([names[w] for w in strings], dtype=np.int64)
    # the sequence of names from 1, and a 0 after each text
    seq = np.zeros(len(pieces) + len(lengths), dtype=np.int64)
    where = np.arange(len(pieces)) + row[pieces]
    seq[where] = which + 1
    text = seq.tolist()
    order = suffix_array(text)
    rank = np.empty(len(seq), dtype=np.int64)
    rank[order] = np.arange(len(seq))
    alike = RangeMinimum(_common_bytes(text, order, list(names)))
    # what a window has before the next piece, named by its bytes
    tails = {}
    firsts = np.cumsum([0, *(len(w) for w in names)])[:-1]
    tail_names = np.array([tails.setdefault(w[k : k + width], len(tails)) for w in names for k in range(len(w))], dtype=np.int64)
    piece = np.searchsorted(pieces, starts, side="right") - 1
    head = tail_names[firsts[which[piece]] + starts - pieces[piece]]
    missing = width - np.minimum(stops[piece] - starts, width)
    follow = np.where(missing > 0, rank[where[np.minimum(piece + 1, len(pieces) - 1)]], -1)
    by = np.lexsort((follow, head))
    a, b = by[:-1], by[1:]
    same = head[a] == head[b]
    rest = np.flatnonzero(same & (missing[a] > 0))
    same[rest] = alike(follow[a[rest]] + 1, follow[b[rest]]) >= missing[a[rest]]
    mark[starts[a[same]]] = True
    mark[starts[b[same]]] = True
    return mark


def _common_bytes(text: list[int], order: list[int], strings: list[bytes]) -> np.ndarray:
    """For each place of the suffix array the bytes that its suffix shares with the one before, within one text."""
    shared = common_prefixes(text, order, 0)
    size = np.concatenate([[0], np.cumsum([len(strings[x - 1]) if x else 0 for x in text])])
    at = np.array(order, dtype=np.int64)
    out = size[at + shared] - size[at]
    # the first names that differ may begin alike
    for k in range(1, len(order)):
        i, j = order[k - 1] + int(shared[k]), order[k] + int(shared[k])
        if i < len(text) and j < len(text) and text[i] and text[j]:
            out[k] += _begin_alike(strings[text[i] - 1], strings[text[j] - 1])
    return out


def _begin_alike(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return next(k for k in range(n) if x[k] != y[k])


def _fetched(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """One row with its bytes for each wanted region (anchor, n, doc_id, text_key, first, last)."""
    lists = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "n", "first", "last")).alias("wanted"))
    both = docs.join(lists, docs["doc_id"].eqNullSafe(lists["doc_id"]) & (docs["text_key"] == lists["text_key"])).select(docs["doc_id"], docs["text_key"], "text", "wanted")

    def cut(batches):
        for batch in spans.slices(spans.unrepeated(batches), "text"):
            raw, offsets = spans.flat(batch.column("text"))
            data = raw.tobytes()
            wants = batch.column("wanted")
            rows = np.repeat(np.arange(len(batch)), np.asarray(pc.list_value_length(wants)))
            fields = wants.flatten()
            first, last = np.asarray(fields.field(2)).astype(np.int64), np.asarray(fields.field(3)).astype(np.int64)
            base = offsets[rows]
            take = pa.array(rows)
            for k in range(0, len(rows), 8192):
                part = slice(k, k + 8192)
                yield pa.RecordBatch.from_arrays(
                    [fields.field(0)[part], fields.field(1)[part], batch.column("doc_id").take(take[part]), batch.column("text_key").take(take[part]), fields.field(2)[part], pa.array([data[a:b] for a, b in zip((base + first)[part].tolist(), (base + last + width)[part].tolist(), strict=True)], pa.binary())],
                    names=["anchor", "n", "doc_id", "text_key", "first", "bytes"],
                )

    return both.mapInArrow(cut, f"anchor long, n long, {spans.KEYS}, first int, bytes binary")


def _by_suffix_arrays(regions: DataFrame, width: int) -> DataFrame:
    """Runs of repeated windows of the regions that occur once, from suffix arrays over all regions of their anchors."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        # repeated rows fetch a region again
        places = np.stack([np.asarray(pc.fill_null(table.column(c).combine_chunks(), 0)).astype(np.int64) for c in ("anchor", "doc_id", "text_key", "first")] + [np.asarray(pc.is_null(table.column("doc_id")).combine_chunks()).astype(np.int64)])
        own = np.unique(places, axis=1, return_index=True)[1]
        if len(own) < len(table):
            table = table.take(pa.array(np.sort(own)))
        raw, offsets = spans.flat(table.column("bytes").combine_chunks())
        lengths = np.diff(offsets)
        mark = equal_windows(raw, lengths, width)
        once = np.asarray(table.column("n").combine_chunks()) == 1
        mark &= np.repeat(once, lengths)
        row = np.repeat(np.arange(len(lengths)), lengths)
        # runs do not cross rows: the last bytes of a row start no window
        a, b = spans.run_edges(mark)
        rows = row[a]
        first = np.asarray(table.column("first").combine_chunks())[rows] - offsets[rows]
        take = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [table.column("doc_id").combine_chunks().take(take), table.column("text_key").combine_chunks().take(take), pa.array((first + a).astype(np.int32)), pa.array((first + b - 1).astype(np.int32))],
            names=["doc_id", "text_key", "first", "last"],
        )

    def slabs(batches):
        held, size, open_anchor = [], 0, None
        for batch in batches:
            if not len(batch):
                continue
            anchors = np.asarray(batch.column("anchor"))
            edges = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1])).tolist()
            for a, b in zip(edges, edges[1:] + [len(batch)], strict=True):
                if anchors[a] != open_anchor and size > SLAB:
                    yield solve(pa.Table.from_batches(held))
                    held, size = [], 0
                open_anchor = anchors[a]
                part = batch.slice(a, b - a)
                held.append(part)
                size += int(pc.sum(pc.binary_length(part.column("bytes"))).as_py())
        if held:
            yield solve(pa.Table.from_batches(held))

    dealt = regions.repartition(partitions(regions.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(slabs, f"{spans.KEYS}, first int, last int")


def _by_windows(regions: DataFrame, width: int) -> DataFrame:
    """The same for hot anchors: every window is a row, and equal ones are counted with map-side sums."""

    def windows(batches):
        for batch in batches:
            raw, offsets = spans.flat(batch.column("bytes"))
            lengths = np.diff(offsets)
            if not len(raw):
                continue
            sums = winnow.prefix_sums(raw)
            count = lengths - width + 1
            rows = np.repeat(np.arange(len(lengths)), count)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            starts = at + offsets[rows]
            take = pa.array(rows)
            first = np.asarray(batch.column("first"))[rows] + at
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in ("anchor", "n", "doc_id", "text_key")] + [pa.array(first.astype(np.int32)), pa.array(winnow.span_hash(sums, starts, starts + width).view(np.int64))],
                names=["anchor", "n", "doc_id", "text_key", "first", "window"],
            )

    rows = staged(regions.mapInArrow(windows, f"anchor long, n long, {spans.KEYS}, first int, window long"), "hot-windows")
    repeated = staged(rows.groupBy("anchor", "window").agg(F.sum("n").alias("total")).filter("total > 1").select("anchor", "window"), "hot-repeats")
    return rows.filter("n = 1").join(repeated, ["anchor", "window"]).select("doc_id", "text_key", "first", F.col("first").alias("last"))


def repeated_runs(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, text_key, first, last): runs of starts of windows that also start elsewhere, of ``spans.keyed`` documents."""
    found = spans.occurrences(docs, "byte", width, gram)
    # most anchors stand in one place and go no further; the places of the others are kept, so texts are scanned twice
    summed = found.groupBy("anchor").agg((F.min("region") < F.max("region")).alias("several"), (F.count(F.lit(1)) > 1).alias("again"))
    # written first: a join of two plain exchanges lets Spark split the places of a hot anchor
    wanted = staged(summed.filter("again").select("anchor", "several"), "repeated-anchors")
    places = staged(found.join(wanted, "anchor"), "places")
    # first() of one group comes from one row: an occurrence of the region
    grouped = places.groupBy("anchor", "region").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("several", "doc_id", "text_key", "first", "last")))
    regions = staged(grouped, "regions")
    several = regions.filter("several")
    crowded = staged(several.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants")).filter(F.col("variants") > hot).select("anchor"), "hot-anchors")
    if crowded.isEmpty():
        once = _by_suffix_arrays(_fetched(docs, several, width), width)
    else:
        once = _by_suffix_arrays(_fetched(docs, several.join(crowded, "anchor", "left_anti"), width), width)
        once = once.unionByName(_by_windows(_fetched(docs, several.join(crowded, "anchor", "left_semi"), width), width))
    once = staged(once, "runs")
    whole = places.join(regions.filter("n > 1").select("anchor", "region"), ["anchor", "region"]).select("doc_id", "text_key", "first", "last")
    return whole.unionByName(once)


def remove_repeats(documents: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept): per document the removed byte spans [start, stop) and what is left."""
    docs = spans.keyed(documents, id_col, text_col)
    marked = spans.with_runs(docs, repeated_runs(docs, width, gram, hot))

    def apply(batches):
        for batch in spans.slices(batches, "text"):
            raw, offsets = spans.flat(batch.column("text"))
            n_bytes, n_removed, removed, kept = np.diff(offsets), [], [], []
            for k, runs in enumerate(spans.run_lists(batch.column("runs"))):
                body = raw[offsets[k] : offsets[k + 1]]
                if not len(runs):
                    n_removed.append(0), removed.append([]), kept.append(body.tobytes())
                    continue
                gone = spans.covered(runs, width, len(body))
                a, b = spans.run_edges(gone)
                n_removed.append(int(gone.sum()))
                removed.append([{"start": int(x), "stop": int(y)} for x, y in zip(a, b, strict=True)])
                kept.append(body[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "removed", "kept"],
            )

    return marked.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, removed array<struct<start:int,stop:int>>, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the operator's output for every document."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
