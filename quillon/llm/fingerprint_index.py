"""Operator 10: incremental removal of repeated 50-word passages with a log-structured fingerprint index.

The index holds fingerprints of historical windows in immutable runs: per anchor and region (``winnow``, over word
hashes) the smallest and largest document id and one occurrence.  A run is a table bucketed and sorted by anchor, so runs
are merge-joined bucket by bucket and history is never shuffled again.  Documents come in batches of ascending id:

1.  The batch's own fingerprints are written as a new run.
2.  That run is merge-joined with each historical run.  A region that a smaller document has is repeated throughout; it is
    told by two 64-bit hashes, of its anchor and of all its words.  An anchor that also stands in other regions makes
    these candidates.
3.  The new run joins the index; once ``fanout`` runs are of one level they are compacted into one of the next level.
4.  Candidates are verified: the words of their regions are read from the texts, once for all batches at hand; windows of
    one anchor are paired by hash and then compared word by word.

Defined results: a null text has no words; texts below a window keep all; a null id counts as larger than any other;
documents of one id never repeat each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import spans, winnow
from quillon.plans.shared import delete, discard, partitions, scratch_dir, staged

WIDTH = 50
GRAM = 12
BATCHES = 4
FANOUT = 3
NO_ID = (1 << 63) - 1
OCCURRENCE = ("doc_id", "text_key", "first", "last")


class FingerprintIndex:
    """Immutable runs of fingerprints: tables bucketed and sorted by anchor, below one folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}"
        self.buckets = partitions(spark)
        self.runs: list[tuple[int, str]] = []

    def write(self, entries: DataFrame) -> str:
        """A new run of entries (anchor, region, least, most, OCCURRENCE)."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        dealt = entries.repartition(self.buckets, "anchor")
        dealt.write.format("parquet").bucketBy(self.buckets, "anchor").sortBy("anchor", "region").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def read(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def append(self, name: str) -> None:
        self.runs.append((0, name))
        level = 0
        while len(same := [x for k, x in self.runs if k == level]) >= self.fanout:
            merged = self.write(merge(reduce(DataFrame.unionByName, map(self.read, same))))
            self.runs = [r for r in self.runs if r[1] not in same] + [(level + 1, merged)]
            self.drop(*same)
            level += 1

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            delete(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        """Drop all runs."""
        self.drop(*[name for _, name in self.runs])
        self.runs = []


def merge(entries: DataFrame) -> DataFrame:
    """One entry for each anchor and region; first() of one group comes from one row, an occurrence of the region."""
    return entries.groupBy("anchor", "region").agg(F.min("least").alias("least"), F.max("most").alias("most"), *(F.first(c).alias(c) for c in OCCURRENCE))


def _span(entries: DataFrame, prefix: str) -> DataFrame:
    """Per anchor the range of its regions and documents."""
    return entries.groupBy("anchor").agg(F.min("region").alias(f"{prefix}r0"), F.max("region").alias(f"{prefix}r1"), F.min("least").alias(f"{prefix}d0"), F.max("most").alias(f"{prefix}d1"))


def batch_hits(index: FingerprintIndex, found: DataFrame) -> DataFrame:
    """(anchor, region, several, least, most, OCCURRENCE): what the batch's fingerprints meet, in itself and in history.

    several: the anchor stands in other regions too.  found: ``spans.occurrences`` of the batch, which is in the index afterwards.
    """
    name = index.write(merge(found.withColumns({"least": F.col("doc_id"), "most": F.col("doc_id")})))
    new = index.read(name)
    met = [index.read(run).join(new, "anchor", "left_semi") for _, run in index.runs]
    old = staged(reduce(DataFrame.unionByName, met) if met else new.limit(0), "history-met")
    both = _span(new, "n").join(_span(old, "o"), "anchor", "left")
    several = F.least("nr0", "or0") < F.greatest("nr1", "or1")
    wanted = staged(both.select("anchor", several.alias("several"), (F.least("nd0", "od0") < F.greatest("nd1", "od1")).alias("shared")).filter("several or shared"), "wanted")
    entries = merge(new.join(wanted.select("anchor"), "anchor").unionByName(old.join(wanted.select("anchor"), "anchor")))
    hits = staged(entries.join(wanted.select("anchor", "several"), "anchor").filter("several or least < most"), "hits")
    discard(old, wanted)
    index.append(name)
    return hits


def _bodies(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(anchor, region, least, body): the words of the wanted regions, one space between two, from the texts."""
    fields = ("anchor", "region", "least", "first", "last")
    lists = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(*fields)).alias("wanted"))
    both = docs.join(lists, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "wanted")

    def scan(batches):
        for batch in spans.slices(spans.unrepeated(batches), "text"):
            raw, offsets = spans.flat(batch.column("text"))
            starts, stops, counts = spans.word_bounds(raw, offsets)
            base = np.cumsum(counts) - counts
            rows = np.repeat(np.arange(len(batch)), np.asarray(pc.list_value_length(batch.column("wanted"))))
            if not len(rows):
                continue
            data = raw.tobytes()
            anchor, region, least, first, last = batch.column("wanted").flatten().flatten()
            a, b = base[rows] + np.asarray(first), base[rows] + np.asarray(last) + width
            for k in range(0, len(rows), 4096):
                words = [b" ".join([data[x:y] for x, y in zip(starts[i:j].tolist(), stops[i:j].tolist(), strict=True)]) for i, j in zip(a[k : k + 4096].tolist(), b[k : k + 4096].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([x[k : k + 4096] for x in (anchor, region, least)] + [pa.array(words, pa.binary())], names=["anchor", "region", "least", "body"])

    # repeated rows may have been read apart
    return both.mapInArrow(scan, "anchor long, region long, least long, body binary").dropDuplicates(["anchor", "region"])


def _windows(bodies: DataFrame, width: int) -> DataFrame:
    """(anchor, region, least, at, window): the hash of each window of the bodies."""

    def scan(batches):
        for batch in spans.slices(batches, "body"):
            syms, counts = spans.symbols(batch.column("body"), "word")
            base = np.cumsum(counts) - counts
            many = np.maximum(counts - width + 1, 0)
            which = np.repeat(np.arange(len(batch)), many)
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            hashes = winnow.span_hash(winnow.prefix_sums(syms), at + base[which], at + base[which] + width).view(np.int64)
            take = pa.array(which)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("anchor", "region", "least")] + [pa.array(at.astype(np.int32)), pa.array(hashes)], names=["anchor", "region", "least", "at", "window"])

    return bodies.mapInArrow(scan, "anchor long, region long, least long, at int, window long")


def verified(docs: DataFrame, hits: DataFrame, width: int = WIDTH) -> DataFrame:
    """(anchor, region, least, most, offsets): hits whose windows a smaller document has; offsets: those that one has of ``least`` too."""
    hits = staged(hits.groupBy("anchor", "region").agg(F.bool_or("several").alias("several"), F.min("least").alias("least"), F.max("most").alias("most"), *(F.first(c).alias(c) for c in OCCURRENCE)), "all-hits")
    bodies = staged(_bodies(docs, hits.filter("several"), width), "bodies")
    windows = staged(_windows(bodies, width), "windows")
    smallest = windows.groupBy("anchor", "window").agg(F.min("least").alias("smallest"), F.max("least").alias("largest"), F.min_by("region", "least").alias("source"), F.min_by("at", "least").alias("source_at"))
    smallest = staged(smallest.filter("smallest < largest").drop("largest"), "smallest")
    # equal windows have their anchor at one place, so two regions are compared at one shift
    later = windows.join(smallest, ["anchor", "window"]).filter("smallest < least").withColumn("shift", F.col("source_at") - F.col("at"))
    pairs = later.groupBy("anchor", "region", "source", "shift").agg(F.collect_list("at").alias("ats"))
    texts = pairs.join(bodies.select("anchor", "region", "body"), ["anchor", "region"]).join(bodies.select("anchor", F.col("region").alias("source"), F.col("body").alias("other")), ["anchor", "source"])

    def compare(batches):
        for batch in batches:
            keep = []
            for ats, shift, body, other in zip(*[batch.column(c).to_pylist() for c in ("ats", "shift", "body", "other")], strict=True):
                x, y = body.split(b" "), other.split(b" ")
                keep.append([k for k in ats if x[k : k + width] == y[k + shift : k + shift + width]])
            yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("region"), pa.array(keep, pa.list_(pa.int32()))], names=["anchor", "region", "ats"])

    equal = texts.select("anchor", "region", "ats", "shift", "body", "other").mapInArrow(compare, "anchor long, region long, ats array<int>")
    offsets = equal.groupBy("anchor", "region").agg(F.array_sort(F.flatten(F.collect_list("ats"))).alias("offsets")).filter("size(offsets) > 0")
    return staged(hits.select("anchor", "region", "least", "most").join(offsets, ["anchor", "region"], "left").filter("least < most or offsets is not null"), "known")


def repeated_runs(found: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text_key, first, last): runs of starts of windows that a smaller document has."""
    # a later document's copy of a region goes whole; in the smallest document itself only the verified windows go
    marked = found.join(known, ["anchor", "region"]).withColumn("own", F.expr("if(doc_id > least, array(struct(first, last)), transform(offsets, x -> struct(first + x AS first, first + x AS last)))"))
    return marked.select("doc_id", "text_key", F.inline("own"))


def batches_of(docs: DataFrame, count: int) -> list[tuple[int, int]]:
    """Ranges [low, high] of ids with about equally many documents."""
    cuts = docs.agg(F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [k / count for k in range(1, count)] or [0.5])).first()
    if cuts[0] is None:
        return []
    highs = sorted({*(cuts[2] if count > 1 else ()), cuts[1]})
    return list(zip([cuts[0], *(h + 1 for h in highs[:-1])], highs, strict=True))


def remove_repeats(documents: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, fanout: int = FANOUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): per document its words without those that a smaller document's window covers."""
    spark = documents.sparkSession
    docs = spans.keyed(documents.withColumn(id_col, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))), id_col, text_col)
    index = FingerprintIndex(spark, fanout=fanout)
    found = staged(spans.occurrences(docs, "word", width, gram), "fingerprints")
    hits = [batch_hits(index, found.filter(F.col("doc_id").between(low, high))) for low, high in batches_of(docs, batches)]
    index.close()
    if not hits:
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept")).limit(0)
    runs = staged(repeated_runs(found, verified(docs, reduce(DataFrame.unionByName, hits), width)), "runs")
    marked = spans.with_runs(docs, runs)

    def apply(parts):
        for batch in spans.slices(parts, "text"):
            raw, offsets = spans.flat(batch.column("text"))
            starts, stops, counts = spans.word_bounds(raw, offsets)
            ends = np.cumsum(counts)
            n_removed, kept = [], []
            data = raw.tobytes()
            for k, own in enumerate(spans.run_lists(batch.column("runs"))):
                a, b = starts[ends[k] - counts[k] : ends[k]], stops[ends[k] - counts[k] : ends[k]]
                if len(own):
                    stay = ~spans.covered(own, width, len(a))
                    a, b = a[stay], b[stay]
                n_removed.append(int(counts[k]) - len(a))
                kept.append(b" ".join([data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    out = marked.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op10_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the operator's output for every document."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
