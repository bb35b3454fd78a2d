"""Operator 6: n-gram Jaccard self-join by a MinHash LSH forest with exact verification.

1.  A text is its set of ``gram``-word shingles (a shorter one is one shingle).  Documents of one set form a node.
2.  Each of ``trees`` prefix tries holds ``max_depth`` MinHashes of every node in a fixed order.  Rows sorted by prefix are
    the trie: a stretch of equal prefixes is one of its nodes.  No pair has to meet above ``depth_for``, the depth at which
    a pair at the threshold shares a prefix with the target recall, so nodes alone in all their stretches there are done.
3.  The others meet from ``max_depth`` upwards: prefixes are shortened by one, and only stretches that this merges from
    different deeper ones are looked at.  A pair is compared on whole signatures where its longest common prefix ends, in
    the first tree that has it; nodes with a likely partner go on to verification.  After each round the pairs found so far, by
    their similarity, tell how many are still missing (as if there were one more at the threshold), and the rounds end when
    the found ones reach the target recall, at the depth of 2. at the latest.
4.  Shingle sets of the nodes that go on are made from the texts, and every likely pair is verified exactly.  A stretch sends
    on counts of links and a spanning forest, never its pairs.  Stretches above ``block`` nodes are dealt over pairs of blocks.
5.  Classes are connected components of links (``components``).

The signature comparison passes pairs at the threshold but for 6 standard deviations.

Defined results: null texts and texts without words are alone and have no links; equal shingle sets are copies: one class,
no link; repeated rows are copies; null ids come last in a class; an empty table gives no rows; other columns are ignored
(``distinct_documents`` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import spans, winnow
from quillon.llm.components import components
from quillon.plans.shared import discard, partitions, staged

GRAM = 5
THRESHOLD = 0.8
TREES = 24
MAX_DEPTH = 8
RECALL = 0.99999
#: nodes of one stretch that are compared in one task
BLOCK = 1024
NO_ID = (1 << 63) - 1


def depth_for(threshold: float, trees: int = TREES, max_depth: int = MAX_DEPTH, recall: float = RECALL) -> int:
    """Shorten the prefix from ``max_depth`` until pairs at the threshold share one often enough."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def found_at(depth: int, similarity, trees: int = TREES):
    """The probability that a pair shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def expected_recall(agreements: np.ndarray, depth: int, threshold: float, trees: int) -> float:
    """The share of links found down to ``depth``; agreements: how many likely pairs found agree in 0, 1, ... MinHashes."""
    similarity = np.arange(len(agreements)) / (len(agreements) - 1)
    at = similarity >= threshold
    n, p, least = agreements[at], found_at(depth, similarity[at], trees), found_at(depth, threshold, trees)
    missing = (n * (1 - p) / p).sum() + (1 - least) / least
    return float(n.sum() / (n.sum() + missing))


def least_agreement(threshold: float, size: int) -> int:
    """Equal MinHashes of ``size`` that a pair at the threshold has but for 6 standard deviations."""
    return max(0, math.floor(size * threshold - 6 * math.sqrt(size * threshold * (1 - threshold))))


def shingles(texts: pa.Array, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, sorted within each, end to end, and the number of each."""
    raw, offsets = spans.flat(texts)
    starts, stops, counts = spans.word_bounds(raw, offsets)
    words = spans.word_symbols(raw, starts, stops)
    sums = winnow.prefix_sums(words)
    own = np.where(counts >= gram, counts - gram + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(len(counts)), own)
    at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(np.cumsum(counts) - counts, own)
    hashes = winnow.span_hash(sums, at, at + np.minimum(gram, counts[row]))
    by = np.lexsort((hashes, row))
    hashes, row = hashes[by], row[by]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.bincount(row[new], minlength=len(counts))


def _multipliers(size: int) -> np.ndarray:
    return winnow.finalize(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(hashes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """(texts, size) MinHashes, of which 16 bits are kept; texts without shingles get zeros."""
    out = np.zeros((len(counts), size), dtype=np.uint16)
    some = np.flatnonzero(counts)
    if len(some):
        begin = (np.cumsum(counts) - counts)[some]
        for k, a in enumerate(_multipliers(size)):
            out[some, k] = np.minimum.reduceat(((hashes * a) >> np.uint64(32)).astype(np.uint32), begin).astype(np.uint16)
    return out


def signed(docs: DataFrame, gram: int, size: int) -> DataFrame:
    """(doc_id, text_key, node, check, n, signature) of ``spans.keyed`` documents; n 0: no words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches, "text"):
            hashes, counts = shingles(batch.column("text"), gram)
            zero = np.zeros(1, dtype=np.uint64)
            with np.errstate(over="ignore"):
                first = np.concatenate([zero, np.cumsum(winnow.finalize(hashes), dtype=np.uint64)])
                second = np.concatenate([zero, np.cumsum(winnow.finalize(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
                ends = np.cumsum(counts)
                node, check = (winnow.finalize(s[ends] - s[ends - counts]).view(np.int64) for s in (first, second))
            sig = signatures(hashes, counts, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(node), pa.array(check), pa.array(counts.astype(np.int32)), pa.array([x.tobytes() for x in sig], pa.binary())],
                names=["doc_id", "text_key", "node", "check", "n", "signature"],
            )

    return docs.mapInArrow(scan, f"{spans.KEYS}, node long, check long, n int, signature binary")


STRETCH = ["depth", "tree", "prefix", "left", "right"]


def _likely(t: Stretches, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, rows, agreements): pairs of rows of a stretch that may be links and belong to this depth and tree."""
    trees, depths = t.signature.shape[1:]
    least = least_agreement(threshold, trees * depths)
    k = 1
    at = np.arange(len(t.group))
    while True:
        at = at[at + k < len(t.group)]
        at = at[t.group[at] == t.group[at + k]]
        if not len(at):
            return
        for part in range(0, len(at), 65536):
            a = at[part : part + 65536]
            b = a + k
            ok = (np.minimum(t.n[a], t.n[b]) >= threshold * np.maximum(t.n[a], t.n[b])) & ((t.side[a] == 0) | (t.side[a] != t.side[b]))
            a, b = a[ok], b[ok]
            same = t.signature[a] == t.signature[b]
            agree = same.sum(axis=(1, 2))
            ok = agree >= least
            a, b, same, agree = a[ok], b[ok], same[ok], agree[ok]
            if not len(a):
                continue
            # the longest common prefix over all trees, and the first tree that has it
            common = np.logical_and.accumulate(same, axis=2).sum(axis=2)
            ok = (common.max(axis=1) == t.depth[a]) & (common.argmax(axis=1) == t.tree[a])
            if ok.any():
                yield a[ok], b[ok], agree[ok]
        k += 1


def _slabs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of whole stretches from batches sorted by STRETCH."""
    held, size, last = [], 0, None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in STRETCH])
        edges = np.append(np.append(0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), len(batch)).tolist()
        # cut where a stretch begins and enough is held
        begin = 0
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(keys[:, a])
            if key != last and size + (a - begin) >= rows:
                if a > begin:
                    held.append(batch.slice(begin, a - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, size, begin = [], 0, a
            last = key
        held.append(batch.slice(begin))
        size += len(batch) - begin
    if held:
        yield pa.Table.from_batches(held)


@dataclass
class Stretches:
    """Rows of whole stretches; side: 0, or 1 and 2 for the two blocks of a split stretch, whose pairs are those across."""

    n: np.ndarray
    signature: np.ndarray  # (rows, trees, depths)
    depth: np.ndarray
    tree: np.ndarray
    group: np.ndarray
    side: np.ndarray

    @staticmethod
    def of(table: pa.Table, trees: int, depths: int) -> Stretches:
        get = lambda c: np.asarray(table.column(c).combine_chunks())
        keys = np.stack([get(c).astype(np.int64) for c in STRETCH])
        group = np.append(0, np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))) if keys.shape[1] else np.zeros(0, dtype=np.int64)
        raw, _ = spans.flat(table.column("signature").combine_chunks())
        return Stretches(get("n"), raw.view(np.uint16).reshape(-1, trees, depths), get("depth"), get("tree"), group, get("side"))


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), *STRETCH).sortWithinPartitions(*STRETCH)


def _common(sets: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    used = np.unique(np.concatenate([a, b]))
    if len(used) * (len(used) - 1) // 8 > len(a) or len(used) < 24:
        return np.array([_meet(sets[offsets[i] : offsets[i + 1]], sets[offsets[j] : offsets[j + 1]]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)
    # many pairs of few sets: a 0/1 matrix over the shingles that two of them have, some columns at a time
    place = np.zeros(len(offsets), dtype=np.int64)
    place[used] = np.arange(len(used))
    rows = np.concatenate([np.full(offsets[i + 1] - offsets[i], place[i]) for i in used.tolist()])
    values = np.concatenate([sets[offsets[i] : offsets[i + 1]] for i in used.tolist()])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    more = times[column] > 1
    rows, column = rows[more], np.unique(column[more], return_inverse=True)[1]
    total = np.zeros((len(used), len(used)), dtype=np.float32)
    for low in range(0, int(column.max(initial=-1)) + 1, 4096):
        here = (column >= low) & (column < low + 4096)
        m = np.zeros((len(used), 4096), dtype=np.float32)
        m[rows[here], column[here] - low] = 1
        total += m @ m.T
    return total[place[a], place[b]].astype(np.int64)


def _meet(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def trie_rows(nodes: DataFrame, trees: int, max_depth: int, floor: int) -> DataFrame:
    """(node, n, signature, tree, p<floor>, ..., p<max_depth>): nodes by tree, with hashes of their prefixes.

    Rows that share no prefix of ``floor`` MinHashes are left out.
    """
    width = 2 * max_depth

    def prefix(depth: int) -> Column:
        return F.xxhash64("tree", F.substring("signature", F.col("tree") * width + 1, F.lit(2 * depth)))

    rows = nodes.filter("n > 0").select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    keys = rows.select("node", "tree", prefix(floor).alias("prefix"))
    shared = staged(keys.groupBy("prefix").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("prefix"), "stretches")
    met = keys.join(shared, "prefix").select("node", "tree")
    full = met.join(nodes.select("node", "n", "signature"), "node")
    return staged(full.select("node", "n", "signature", "tree", *(prefix(d).alias(f"p{d}") for d in range(floor, max_depth + 1))), "trie")


def likely_rows(trie: DataFrame, depth: int, trees: int, max_depth: int, threshold: float, block: int) -> DataFrame:
    """(node, n, signature, STRETCH, side, agreements): rows with a likely partner whose common prefix ends at ``depth``.

    agreements: on one row of a batch, the numbers of its pairs that agree in 0, 1, ... MinHashes.
    """
    here = f"p{depth}"
    deeper = "node" if depth == max_depth else f"p{depth + 1}"
    stretches = trie.groupBy(here).agg(F.count(F.lit(1)).alias("members"), F.min(deeper).alias("a"), F.max(deeper).alias("b")).filter("a < b").select(here, "members")
    rows = trie.join(staged(stretches, "merged-stretches"), here)
    # a stretch of more than ``block`` nodes: blocks by hash, and a task for each pair of blocks
    rows = rows.withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("node", "tree"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.expr("CASE WHEN own = other THEN 0 WHEN own < other THEN 1 ELSE 2 END")
    rows = rows.select("node", "n", "signature", F.lit(depth).alias("depth"), "tree", F.col(here).alias("prefix"), F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), side.alias("side"))

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slabs(batches, 8192):
            t = Stretches.of(table, trees, max_depth)
            keep = np.zeros(len(table), dtype=bool)
            agreements = np.zeros(trees * max_depth + 1, dtype=np.int64)
            for a, b, agree in _likely(t, threshold):
                keep[a] = keep[b] = True
                agreements += np.bincount(agree, minlength=len(agreements))
            if keep.any():
                out = table.filter(pa.array(keep)).combine_chunks()
                out = out.append_column("agreements", pa.array([agreements] + [None] * (len(out) - 1), pa.list_(pa.int64())))
                yield from out.to_batches()

    schema = "node long, n int, signature binary, depth int, tree int, prefix long, left int, right int, side int, agreements array<long>"
    return staged(_dealt(rows).mapInArrow(survivors, schema), "likely")


def links(docs: DataFrame, nodes: DataFrame, threshold: float, gram: int, trees: int, max_depth: int, recall: float, block: int) -> DataFrame:
    """(node, root, degree) from every stretch: what each node counts of its links there, and its tree in a spanning forest."""
    floor = depth_for(threshold, trees, max_depth, recall)
    trie = trie_rows(nodes, trees, max_depth, floor)
    agreements = np.zeros(trees * max_depth + 1, dtype=np.int64)
    rounds = []
    for depth in range(max_depth, floor - 1, -1):
        rounds.append(likely_rows(trie, depth, trees, max_depth, threshold, block))
        for r in rounds[-1].select(F.posexplode("agreements").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():  # a row for each k
            agreements[r["k"]] += r["n"]
        if expected_recall(agreements, depth, threshold, trees) >= recall:
            break
    discard(trie)
    likely = reduce(DataFrame.unionByName, rounds).drop("agreements")
    # shingle sets of the nodes that go on, each from one of its documents
    holders = nodes.join(likely.select("node").distinct(), "node").select("node", "doc_id", "text_key")
    texts = docs.join(holders, ["doc_id", "text_key"]).dropDuplicates(["node"]).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches, "text"):
            hashes, counts = shingles(batch.column("text"), gram)
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([hashes[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary())], names=["node", "shingles"])

    full = likely.join(texts.mapInArrow(sets, "node long, shingles binary"), "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slabs(batches, 2048):
            t = Stretches.of(table, trees, max_depth)
            n, groups = t.n, t.group
            raw, offsets = spans.flat(table.column("shingles").combine_chunks())
            values, offsets = np.frombuffer(raw.tobytes(), dtype=np.uint64), offsets // 8
            degree = np.zeros(len(n), dtype=np.int64)
            root = list(range(len(n)))

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            pairs = list(_likely(t, threshold))
            if not pairs:
                continue
            a, b, _ = (np.concatenate(x) for x in zip(*pairs, strict=True))
            # by group, so that the pairs of a large stretch are counted together
            by = np.argsort(groups[a], kind="stable")
            a, b = a[by], b[by]
            cuts = np.append(np.append(0, np.flatnonzero(np.diff(groups[a])) + 1), len(a)).tolist()
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                x, y = a[low:high], b[low:high]
                common = _common(values, offsets, x, y)
                link = common >= threshold * (n[x] + n[y] - common) - 1e-9
                x, y = x[link], y[link]
                np.add.at(degree, x, 1)
                np.add.at(degree, y, 1)
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    i, j = find(i), find(j)
                    if i != j:
                        root[max(i, j)] = min(i, j)
            some = np.flatnonzero(degree)
            if len(some):
                node = np.asarray(table.column("node").combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[[find(int(k)) for k in some]]), pa.array(degree[some])], names=["node", "root", "degree"])

    return staged(_dealt(full).mapInArrow(verify, "node long, root long, degree long"), "links")


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, trees: int = TREES, recall: float = RECALL, max_depth: int = MAX_DEPTH, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, class_key, class_id, n_copies, n_links) for each document row.

    class_id: smallest id of the documents it is linked with, directly or not, and of their copies; class_key tells classes
    apart that have this in common; n_copies: documents with its shingle set, itself included; n_links: other sets at or
    above the threshold.
    """
    docs = spans.keyed(documents.withColumn(id_col, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))), id_col, text_col)
    rows = staged(signed(docs, gram, trees * max_depth), "signed")
    # node and check are 128 bits of one set; a text without words is a node of its own
    rows = rows.withColumn("node", F.when(F.col("n") > 0, F.xxhash64("node", "check")).otherwise(F.xxhash64("doc_id", "text_key", F.lit(0)))).drop("check")
    nodes = staged(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"), *(F.first(c).alias(c) for c in ("doc_id", "text_key", "n", "signature"))), "nodes")
    found = links(docs, nodes, threshold, gram, trees, max_depth, recall, block)
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    degrees = found.groupBy("node").agg(F.sum("degree").alias("n_links"))
    linked = staged(nodes.select("node", "least").join(roots, "node").join(degrees, "node", "left"), "linked")
    classes = linked.groupBy("root").agg(F.min("least").alias("class_id"))
    linked = linked.join(classes, "root").select("node", "root", "class_id", "n_links")
    whole = nodes.select("node", "least", "n_copies").join(linked, "node", "left")
    whole = staged(whole.select("node", F.coalesce("root", "node").alias("class_key"), F.coalesce("class_id", "least").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "classes")
    out = rows.select("doc_id", "text_key", "node", "n").join(whole, "node")
    alone = F.col("n") == 0
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "text_key", "class_key", F.nullif(F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")), F.lit(NO_ID)).alias("class_id"), F.when(alone, 1).otherwise(F.col("n_copies")).alias("n_copies"), "n_links")


def distinct_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, that with the smallest id (ties: smallest hash of the text), with all its columns.

    A document without words is a class of its own; of repeated rows (one id and one text) one stays.
    """
    place = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    classes = near_duplicates(documents, id_col=id_col, text_col=text_col, **options)
    classes = classes.select("class_key", F.coalesce("doc_id", F.lit(NO_ID)).alias("__near_id"), F.col("text_key").alias("__near_text"))
    kept = classes.groupBy("class_key").agg(F.min(F.struct("__near_id", "__near_text")).alias("kept")).select("kept.*")
    out = documents.withColumn("__near_id", place).withColumn("__near_text", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return out.join(kept, ["__near_id", "__near_text"], "left_semi").dropDuplicates(["__near_id", "__near_text"]).select(*documents.columns)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, copies and links of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key", "class_key")
