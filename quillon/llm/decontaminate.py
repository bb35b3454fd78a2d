"""Operator 2: benchmark decontamination by greedy string tiling.

Texts are words: maximal runs of ASCII letters, digits and non-ASCII characters, lower-cased.  Documents and test items
that share a seed (``min_match`` equal words in a row) are joined on hashes of it.  Each pair is then tiled: again and again
the longest common substring of unmarked words is marked (ties: first in the item, then in the document), until none of
``min_match`` words is left.  Running Karp-Rabin hashes of falling length find the matches; one that others have marked in
part goes back in order with what is left of it.  A document leaks an item if its tiles cover at least ``threshold`` of the item's
words, in whatever order they stand.

The test items go to the executors in blocks of bounded size, one pass over the documents for each block; the usual
benchmark is one block, and between blocks documents are written, so that a task holds one block at a time.  Equal items
are one with their number.  Documents are not shuffled and no pair of rows is formed without a seed.

Defined results: null texts have no words; items below ``min_match`` words never leak; items are told apart by row, so
repeated items give repeated rows; documents too; an empty table gives no rows; other columns are ignored
(``clean_documents`` keeps them all).
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import spans, winnow
from quillon.plans.shared import small_batches, staged

MIN_MATCH = 5
THRESHOLD = 0.8
#: characters of test items in one broadcast
BLOCK = 1 << 24

BREAK = np.ones(256, dtype=bool)
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts end to end, and the number of words of each."""
    raw, offsets = spans.flat(pc.utf8_lower(texts.fill_null("").cast(pa.large_string())))
    starts, stops, counts = spans.word_bounds(raw, offsets, BREAK)
    return spans.word_symbols(raw, starts, stops), counts


def tile(pattern: list[int], text: list[int], minimum: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in pattern, start in text, length) of the tiles, none below ``minimum``."""
    base, mod = 1_000_003, (1 << 61) - 1
    marked_p, marked_t = [False] * len(pattern), [False] * len(text)
    tiles: list[tuple[int, int, int]] = []

    def hashes(seq: list[int], marked: list[bool], length: int):
        """(start, running hash) of each unmarked substring of this length."""
        top = pow(base, length - 1, mod)
        value, run = 0, 0
        for k, (x, m) in enumerate(zip(seq, marked, strict=True)):
            if m:
                value, run = 0, 0
                continue
            if run == length:
                value = (value - seq[k - length] * top) % mod
                run -= 1
            value = (value * base + x) % mod
            run += 1
            if run == length:
                yield k - length + 1, value

    search = min(len(pattern), len(text))
    while search >= minimum:
        at: dict[int, list[int]] = {}
        for k, value in hashes(text, marked_t, search):
            at.setdefault(value, []).append(k)
        # all matches of at least the search length that cannot be longer on either side
        matches = []
        for p, value in hashes(pattern, marked_p, search) if at else ():
            for t in at.get(value, ()):
                if p and t and pattern[p - 1] == text[t - 1] and not marked_p[p - 1] and not marked_t[t - 1]:
                    continue
                n = 0
                while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and not marked_p[p + n] and not marked_t[t + n]:
                    n += 1
                if n >= search:
                    matches.append((-n, p, t))
        heapq.heapify(matches)
        while matches:
            n, p, t = heapq.heappop(matches)
            left = [k for k in range(-n) if not marked_p[p + k] and not marked_t[t + k]]
            if len(left) == -n:
                tiles.append((p, t, -n))
                marked_p[p : p - n] = [True] * -n
                marked_t[t : t - n] = [True] * -n
                continue
            for _, part in groupby(enumerate(left), lambda x: x[1] - x[0]):
                part = [k for _, k in part]
                if len(part) >= search:
                    heapq.heappush(matches, (-len(part), p + part[0], t + part[0]))
        search = minimum if minimum < search <= 2 * minimum else search // 2 if search > minimum else 0
    return tiles


class Block:
    """Test items with an index of their seeds."""

    def __init__(self, ids: list[int], texts: list[str], times: list[int], min_match: int):
        words, counts = words_of(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        self.ids, self.times, self.min_match = ids, times, min_match
        self.words = [words[e - n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        seeds, items = seeds_of(words, counts, min_match)
        by = np.argsort(seeds, kind="stable")
        self.seeds, self.items = seeds[by], items[by]
        self.filter = np.zeros(1 << 22, dtype=bool)
        self.filter[(self.seeds & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def leaks(self, texts: pa.Array, threshold: float) -> list[tuple[int, int, int, list]]:
        """(row, item, covered words, tiles) of the leaks; tiles: start in the item, in the text, words."""
        out = []
        words, counts = words_of(texts)
        starts = np.cumsum(counts) - counts
        seeds, rows, at = seeds_of(words, counts, self.min_match, places=True)
        some = np.flatnonzero(self.filter[(seeds & np.uint64((1 << 22) - 1)).astype(np.int64)])
        low, high = np.searchsorted(self.seeds, seeds[some], side="left"), np.searchsorted(self.seeds, seeds[some], side="right")
        n = high - low
        hit = np.repeat(some, n)
        item = self.items[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        pairs = np.unique(np.stack([rows[hit], item, at[hit]], axis=1), axis=0)  # sorted by row, item, place
        edges = np.flatnonzero(np.append(True, (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1))) if len(pairs) else np.zeros(0, dtype=np.int64)
        bounds = np.append(edges, len(pairs)).tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            row, k = int(pairs[a, 0]), int(pairs[a, 1])
            # only words of seeds can be in tiles; a break (-1) stands between stretches of them
            places = pairs[a:b, 2]
            inside = np.unique(places[:, None] + np.arange(self.min_match)[None])
            gap = np.flatnonzero(np.diff(inside) > 1) + 1
            own = np.insert(inside, gap, -1)
            body = words[starts[row] : starts[row] + counts[row]]
            text = [int(body[x]) if x >= 0 else -1 for x in own.tolist()]
            pattern = [int(x) for x in self.words[k]]
            tiles = tile(pattern, text, self.min_match)
            covered = sum(x[2] for x in tiles)
            if covered >= threshold * len(pattern):
                out.append((row, k, covered, [(p, int(own[t]), m) for p, t, m in sorted(tiles)]))
        return out


def seeds_of(words: np.ndarray, counts: np.ndarray, length: int, places: bool = False):
    """Hashes of each ``length`` words in a row within a text, the row of each, and with ``places`` where it starts."""
    row = np.repeat(np.arange(len(counts)), counts)
    if len(words) < length:
        none = np.zeros(0, dtype=np.int64)
        return (none.view(np.uint64), none, none) if places else (none.view(np.uint64), none)
    at = np.flatnonzero(row[: len(row) - length + 1] == row[length - 1 :])
    seeds = winnow.span_hash(winnow.prefix_sums(words), at, at + length)
    if not places:
        return seeds, row[at]
    return seeds, row[at], at - (np.cumsum(counts) - counts)[row[at]]


def blocks(benchmark: DataFrame, min_match: int, id_col: str, text_col: str, size: int):
    """The distinct test items as blocks of about ``size`` characters at most (one item may be more)."""
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("body")).filter("body is not null").groupBy("item", "body").agg(F.count(F.lit(1)).alias("times"))
    total = items.agg(F.sum(F.length("body"))).first()[0] or 0
    count = max(1, math.ceil(2 * total / size)) if total > size else 1
    for k in range(count):
        rows = (items if count == 1 else items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(count)) == k)).orderBy("item", "body").collect()
        if rows:
            yield Block([r["item"] for r in rows], [r["body"] for r in rows], [r["times"] for r in rows], min_match)


LEAK = "item_id long, covered_words long, item_words long, coverage double, tiles array<struct<item_start:int,doc_start:int,words:int>>"


def find_leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, LEAK) for each document and test item that it leaks; starts count the words as defined above."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for items in blocks(benchmark, min_match, item_col, item_text_col, block):
        shared = spark.sparkContext.broadcast(items)

        def scan(batches, shared=shared):
            for batch in spans.slices(batches, 1):
                rows = [r for r in shared.value.leaks(batch.column(1), threshold) for _ in range(shared.value.times[r[1]])]
                if rows:
                    n = [len(shared.value.words[k]) for _, k, _, _ in rows]
                    tiles = [[{"item_start": p, "doc_start": t, "words": m} for p, t, m in x] for *_, x in rows]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([r[0] for r in rows])), pa.array([shared.value.ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(n, pa.int64()), pa.array([r[2] / m for r, m in zip(rows, n, strict=True)]), pa.array(tiles, pa.list_(pa.struct([(f, pa.int32()) for f in ("item_start", "doc_start", "words")])))],
                        names=["doc_id", "item_id", "covered_words", "item_words", "coverage", "tiles"],
                    )

        part = docs.mapInArrow(scan, f"doc_id long, {LEAK}")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], f"doc_id long, {LEAK}")


def clean_documents(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The documents that leak no test item, with all their columns."""
    at, schema = documents.columns.index(text_col), documents.schema
    small_batches(documents.sparkSession)
    for k, items in enumerate(blocks(benchmark, min_match, item_col, item_text_col, block)):
        if k:
            documents = staged(documents, "block-clean")
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def scan(batches, shared=shared):
            for batch in spans.slices(batches, at):
                keep = np.ones(len(batch), dtype=bool)
                keep[[r[0] for r in shared.value.leaks(batch.column(at), threshold)]] = False
                yield batch.filter(pa.array(keep))

        documents = documents.mapInArrow(scan, schema)
    return documents


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item in a document."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
