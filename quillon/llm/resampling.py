"""Operator 12: importance resampling towards a target distribution.

Features are the runs of 1 to 2 words of a text, hashed into buckets.  Counts of the buckets over all documents and over the
target texts give each bucket a gain, the log ratio of its smoothed shares; a document's weight is the mean gain of its
features.  With Gumbel noise from a hash of its id added to the weights, the highest scores are a weighted draw without
replacement.

Two passes over the texts: counts (a task adds up its texts in one array, of which the buckets that occur are shuffled) and
scores (gains are an array of one number a bucket; what is staged is five numbers a document).

The draw is a merge of sorted runs.  Each partition sorts its eligible rows into a run.  Scores are integers of a bounded
range, so a histogram of them says which score the last drawn row has, and cuts the scores above it into ranges of about equal
numbers of rows whose ranks are known to begin at a certain one.  Runs are cut into blocks at these ranges; each range's blocks meet in one
task in order of their first keys, and a tournament tree merges them.  A block enters the tree when the merge reaches its first
key, by when the block before it of the same run is used up; so the tree has at most one leaf for each run, and the blocks to come stay
with Spark's sorter, which spills.  Ranks end with the exact draw count.  Rows of one score are one task's at most.

Defined results: a null text has no words; a document without features has weight 0; a null id hashes as an empty string and
sorts before others; ties of score and id (repeated rows) go by weight, then number of features, then any order; every
repeated row is a document of its own; without target texts all gains still follow the formula with t = T = 0; an empty table gives no rows; other
columns are ignored (``resample`` keeps them).
"""

from __future__ import annotations

import bisect
import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import spans
from quillon.plans.shared import partitions, small_batches, staged

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: rows of a run that travel as one block
BLOCK_ROWS = 1024
#: longest word whose place in a two-word feature is found by tables
TABLED = 64

#: bytes between words: all of ASCII but 0-9 and (after lower-casing) a-z
BREAKS = np.ones(256, dtype=bool)
BREAKS[0x30:0x3A] = BREAKS[0x61:0x7B] = BREAKS[0x80:] = False


def crc_table() -> np.ndarray:
    """The register's change for each byte (reflected polynomial EDB88320)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


TABLE = crc_table()


def shift_tables(n: int = TABLED + 1) -> np.ndarray:
    """[length][byte of the crc][its value] -> what it becomes when so many bytes follow; parts of a crc add up by xor."""
    tables = np.empty((n + 1, 4, 256), dtype=np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(1, n + 1):
        tables[k] = TABLE[tables[k - 1] & 255] ^ (tables[k - 1] >> 8)
    return tables


SHIFT = shift_tables()


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The share of crcs in those of their strings with so many bytes after them."""
    flat = SHIFT.reshape(-1)
    base = lengths.astype(np.int64) * 1024
    out = flat[base + (crc & 255)]
    for k in (1, 2, 3):
        out ^= flat[base + (256 * k) + (crc >> np.uint32(8 * k) & 255)]
    return out


def word_crcs(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """crc32 of each word: all words a byte at a time, longest first."""
    lengths = stops - starts
    out = np.zeros(len(starts), dtype=np.uint32)
    order = np.argsort(-lengths, kind="stable")
    long = int(np.searchsorted(-lengths[order], -TABLED, side="left"))
    for k in order[:long].tolist():
        out[k] = zlib.crc32(raw[starts[k] : stops[k]])
    order = order[long:]
    at, negative = starts[order], -lengths[order]
    register = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for j in range(int(-negative[0]) if len(order) else 0):
        n = int(np.searchsorted(negative, -j, side="left"))  # words of more than j bytes
        own = register[:n]
        register[:n] = TABLE[(own ^ raw[at[:n] + j]) & 255] ^ (own >> np.uint32(8))
    out[order] = ~register
    return out


def features(raw: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of texts laid end to end, the text of each, and the number of words of each text."""
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    starts, stops, counts = spans.word_bounds(raw, offsets, BREAKS)
    doc = np.repeat(np.arange(len(counts)), counts)
    one = word_crcs(raw, starts, stops)
    first = np.flatnonzero(doc[1:] == doc[:-1])
    lengths = (stops - starts)[first + 1]
    tabled = lengths <= TABLED
    short = np.minimum(lengths, TABLED)
    space = np.full(len(first), zlib.crc32(b" "), dtype=np.uint32)
    two = shifted(one[first], short + 1) ^ shifted(space, short) ^ one[first + 1]
    for k in np.flatnonzero(~tabled).tolist():
        word = first[k] + 1
        two[k] = zlib.crc32(raw[starts[word] : stops[word]], zlib.crc32(b" ", int(one[first[k]])))
    return np.concatenate([one, two]) % np.uint32(buckets), np.concatenate([doc, doc[first]]), counts


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all texts."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in spans.slices(batches, 0):
            total += np.bincount(features(*spans.flat(batch.column(0).fill_null("")), buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares) of each bucket."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths from a hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each document."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches, 1):
            bucket, doc, words = features(*spans.flat(batch.column(1).fill_null("")), len(shipped.value))
            order = np.argsort(doc, kind="stable")
            sums = np.append(0, np.cumsum(shipped.value[bucket[order]]))
            n = np.bincount(doc, minlength=len(words))
            ends = np.cumsum(n)
            weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
            drawn = np.array([noise(d, seed) for d in batch.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words.astype(np.int64), n.astype(np.int64), weight, weight + drawn))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


class Tournament:
    """A tree of matches between the heads of sorted blocks; the lowest key wins.

    Blocks come and go: a leaf whose block is used up holds ``OUT``, which loses to all, until another block takes it.
    """

    OUT = (1,)

    def __init__(self, leaves: int = 2):
        self.rows: list[Iterator[tuple]] = [iter(())] * leaves
        self.heads: list[tuple] = [self.OUT] * leaves
        self.winner = [0] * leaves  # inner nodes; node k plays the winners of 2 k and 2 k + 1
        self.free = list(range(leaves))
        self.play_all()

    def play(self, node: int) -> None:
        n = len(self.heads)
        a, b = (self.winner[k] if k < n else k - n for k in (2 * node, 2 * node + 1))
        self.winner[node] = a if self.heads[a] <= self.heads[b] else b

    def play_all(self) -> None:
        for node in range(len(self.heads) - 1, 0, -1):
            self.play(node)

    def add(self, block: list[tuple]) -> None:
        if not self.free:
            n = len(self.heads)
            self.heads += [self.OUT] * n
            self.rows += [iter(())] * n
            self.winner = [0] * (2 * n)
            self.free = list(range(n, 2 * n))
            self.play_all()
        leaf = self.free.pop()
        self.rows[leaf] = iter(block)
        self.advance(leaf)

    def advance(self, leaf: int) -> None:
        """The next row of a leaf, and the matches on its way to the root."""
        head = next(self.rows[leaf], None)
        if head is None:
            self.free.append(leaf)
        self.heads[leaf] = self.OUT if head is None else head
        node = (leaf + len(self.heads)) >> 1
        while node:
            self.play(node)
            node >>= 1

    def upto(self, bound: tuple) -> Iterator[tuple]:
        """Rows in order, as far as they are not above ``bound``."""
        while (head := self.heads[leaf := self.winner[1]]) != self.OUT and head <= bound:
            yield head
            self.advance(leaf)


#: more than all keys but less than ``Tournament.OUT``
LAST = (0, math.inf)
RESULT = "doc_id long, n_features long, weight long, score long, rank long"


def keys(batch: pa.RecordBatch) -> list[tuple]:
    """Keys of rows in the order of ranks: high scores first, then small ids, then weight and features."""
    ids, n, weight, score = (batch.column(c).to_pylist() for c in ("doc_id", "n_features", "weight", "score"))
    return [(0, -s, d is not None, d or 0, w, f) for d, f, w, s in zip(ids, n, weight, score, strict=True)]


def result(rows: list[tuple], ranks: list[int | None]) -> pa.RecordBatch:
    columns = [[k[3] if k[2] else None for k in rows], [k[5] for k in rows], [k[4] for k in rows], [-k[1] for k in rows], ranks]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n_features", "weight", "score", "rank"])


def ranges(histogram: dict[int, int], draw: int, n: int) -> tuple[list[int], list[int]]:
    """Scores that end each range (lowest included, highest range first) and the rows above each range.

    The last range ends with the score at which the draw is full.
    """
    ends, before, above, begin = [], [], 0, 0
    for score in sorted(histogram, reverse=True):
        above += histogram[score]
        if above - begin >= draw / n or above >= draw:
            ends.append(score)
            before.append(begin)
            begin = above
        if above >= draw:
            break
    return ends, before


def ranked(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of staged ``scores``; rank is null where a document is not drawn."""
    spark = scored.sparkSession
    eligible = F.col("n_words") >= min_words
    undrawn = F.lit(None).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    # integers of a range that log and hash bound: some ten thousands at most
    histogram = {r["score"]: r["n"] for r in scored.filter(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = percent * sum(histogram.values()) // 100
    if not draw:
        return scored.select(*columns, undrawn)
    n = partitions(spark)
    ends, before = ranges(histogram, draw, n)
    rising = [-e for e in ends]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition's sorted rows in blocks, none over two ranges."""
        run, number, block = TaskContext.get().partitionId(), 0, []

        def row(block: list[tuple]) -> pa.RecordBatch:
            head = block[0]
            names = ["range", "run", "number", "head_score", "head_id", "head_weight", "head_features", "keys"]
            values = [bisect.bisect_left(rising, head[1]), run, number, head[1], head[3] if head[2] else None, *head[4:]]
            packed = pa.array(np.array([k[1:] for k in block], dtype=np.int64).ravel())
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in values), pa.ListArray.from_arrays(pa.array([0, len(packed)], pa.int32()), packed)], names=names)

        for batch in batches:
            for key in keys(batch):
                if block and (len(block) == BLOCK_ROWS or (block[0][1] != key[1] and bisect.bisect_left(rising, block[0][1]) != bisect.bisect_left(rising, key[1]))):
                    yield row(block)
                    number, block = number + 1, []
                block.append(key)
        if block:
            yield row(block)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a range, in order of their heads, to ranked rows."""
        part, tree, rank = None, None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["range"] != part:
                    if tree:
                        yield from give(tree, LAST, rank)
                    part, tree, rank = r["range"], Tournament(), before[r["range"]]
                block = [(0, *map(int, k)) for k in np.array(r["keys"], dtype=np.int64).reshape(-1, 5)]
                for out in give(tree, block[0], rank):
                    rank += len(out)
                    yield out
                tree.add(block)
        if tree:
            yield from give(tree, LAST, rank)

    def give(tree: Tournament, bound: tuple, rank: int) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for key in tree.upto(bound):
            rows.append(key)
            if len(rows) == BLOCK_ROWS:
                yield result(rows, ranks_after(rank, len(rows)))
                rank, rows = rank + len(rows), []
        if rows:
            yield result(rows, ranks_after(rank, len(rows)))

    def ranks_after(rank: int, n: int) -> list[int | None]:
        return [k if k <= draw else None for k in range(rank + 1, rank + n + 1)]

    reach = eligible & (F.col("score") >= ends[-1])
    sorted_runs = scored.filter(reach).select(*columns).sortWithinPartitions(F.desc("score"), F.asc_nulls_first("doc_id"), "weight", "n_features")
    blocks = sorted_runs.mapInArrow(runs, "range long, run long, number long, head_score long, head_id long, head_weight long, head_features long, keys array<long>")
    dealt = blocks.repartitionById(n, F.col("range").cast("int")).sortWithinPartitions("range", "head_score", F.asc_nulls_first("head_id"), "head_weight", "head_features", "run", "number")
    return dealt.mapInArrow(merge, RESULT).unionByName(scored.filter(~reach).select(*columns, undrawn))


def importance(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged ``scores`` of documents for the distribution of the target's texts."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, text_col, buckets))
    return staged(scores(docs, gain, seed, id_col, text_col), "scores")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """The documents drawn, with all their columns; ids are taken to be unique."""
    drawn = ranked(importance(docs, target, seed=seed, id_col=id_col), percent, min_words).filter("rank is not null").select(F.col("doc_id").alias("__drawn"))
    return docs.join(drawn, F.col(id_col).eqNullSafe(F.col("__drawn")), "left_semi")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight for the benchmark's distribution, its score and its rank among a quarter of them."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return ranked(importance(docs, target))


SQL = r"""
WITH texts AS (
    SELECT 0 AS kind, row_number() OVER () AS n, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
    UNION ALL SELECT 1, row_number() OVER (), NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS MATERIALIZED (SELECT kind, n, id, regexp_extract_all(text, '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM texts),
feats AS MATERIALIZED (
    SELECT kind, n, unnest(w) AS f FROM words
    UNION ALL SELECT kind, n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words WHERE len(w) > 1),
bits AS (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS v FROM (SELECT unnest(range(256)) AS i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits),
hashed AS MATERIALIZED (
    SELECT f, xor(4294967295, list_reduce(list_transform(range(0, strlen(f)), lambda k: ('0x' || substr(hex(encode(f)), 2 * k + 1, 2))::BIGINT),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) % 10000 AS bucket
    FROM (SELECT DISTINCT f FROM feats), crc),
counts AS (SELECT b AS bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN (SELECT kind, bucket FROM feats JOIN hashed USING (f)) h ON h.bucket = b GROUP BY b),
gain AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS g
    FROM counts, (SELECT sum(s)::BIGINT AS all_s, sum(t)::BIGINT AS all_t FROM counts)),
weights AS (
    SELECT n, count(*) AS n_features, sum(g)::BIGINT AS total FROM feats JOIN hashed USING (f) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY n),
scored AS (
    SELECT id AS doc_id, n, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
        coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
        ('0x' || substr(sha256('7:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT AS h
    FROM words LEFT JOIN weights USING (n) WHERE kind = 0),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
ordered AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS k, count(*) OVER (PARTITION BY n_words >= 20) AS m FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= 25 * m // 100 THEN k END AS rank FROM ordered
"""
