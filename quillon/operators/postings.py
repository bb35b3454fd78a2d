"""Search by an inverted index: postings of words in sorted buckets, intersected by galloping.

The index has a dictionary (each word, in how many items it is) and postings: for each word and shard of 65,536 ids, the sorted ids that have
the word.  A row of postings is of bounded size, however frequent its word.  Postings are dealt into buckets by a hash of the word and
sorted by it, so a search reads the row groups of the words it wants.

A term is found wherever it stands in a text, as part of a word too.  Terms have no white space, so a place where one stands lies in one
word: the dictionary says which words hold the term, and their ids together are the term's.  Items with all terms come from the
intersection shard by shard, shortest list first.  The result is that of ``ranking.search``, which reads all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD = 1 << 16
BUCKETS = 32
#: so many words at most are named in the filter that reaches the scan; more are joined
NAMED = 2000


@dataclass(frozen=True)
class Index:
    """Folders of an index: ``words``, ``postings`` (by bucket) and ``items`` (id and what results show or are filtered by)."""

    folder: str
    buckets: int = BUCKETS

    def words(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("word string, n long").parquet(f"{self.folder}/words")

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("word string, shard long, ids array<int>, bucket int").parquet(f"{self.folder}/postings")

    def items(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/items")


def bucket_of(word, buckets: int):
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def build(items: DataFrame, folder: str, texts: tuple[str, ...] = ("title", "method", "finding"), shown: tuple[str, ...] = ("id", "title", "status", "kind"), buckets: int = BUCKETS, source: DataFrame | None = None) -> Index:
    """Write the index of items with a whole-number ``id``; null texts are empty.  source: (id, texts), where items should not be read for them."""
    index = Index(folder.rstrip("/"), buckets)
    words = F.explode(F.array_distinct(F.split(F.lower(F.concat_ws(" ", *texts)), r"\s+")))
    pairs = (items if source is None else source).select(F.col("id").cast("long").alias("id"), words.alias("word")).filter("word <> ''")
    shard = F.floor(F.col("id") / SHARD)
    grouped = pairs.groupBy("word", shard.alias("shard")).agg(F.array_sort(F.collect_set((F.col("id") - shard * SHARD).cast("int"))).alias("ids"))  # SHARD at most
    dealt = grouped.withColumn("bucket", bucket_of(F.col("word"), buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "word", "shard")
    dealt.write.partitionBy("bucket").parquet(f"{index.folder}/postings")
    spark = items.sparkSession
    index.postings(spark).groupBy("word").agg(F.sum(F.size("ids")).cast("long").alias("n")).write.parquet(f"{index.folder}/words")
    items.select(*shown).repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{index.folder}/items")
    return index


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The values of one sorted array that another has: each is looked for by doubling steps from where the last one was found, then halving."""
    low = np.zeros(len(short), dtype=np.int64)
    if not len(short) or not len(long):
        return short[:0]
    # all values step together; a value's steps start where the array is about to be, in proportion to its place
    low = np.minimum(np.arange(len(short), dtype=np.int64) * len(long) // len(short), len(long) - 1)
    low = np.where(long[low] <= short, low, 0)
    step = np.ones(len(short), dtype=np.int64)
    while True:
        ahead = np.minimum(low + step, len(long) - 1)
        moves = (long[ahead] <= short) & (ahead > low)
        if not moves.any():
            break
        low = np.where(moves, ahead, low)
        step = np.where(moves, step * 2, step)
    high = np.minimum(low + step, len(long) - 1)
    while (open_ := high - low > 1).any():
        middle = (low + high) // 2
        below = long[middle] <= short
        low, high = np.where(open_ & below, middle, low), np.where(open_ & ~below, middle, high)
    return short[(long[low] == short) | (long[high] == short)]


def found(spark: SparkSession, index: Index, terms: list[str]) -> DataFrame:
    """(id) of the items that have all terms."""
    dictionary = index.words(spark)
    which = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.col("word"), t))
    matched = dictionary.select("word", F.explode(which).alias("term"))
    named = [r["word"] for r in matched.select("word").distinct().limit(NAMED + 1).collect()]
    postings = index.postings(spark)
    if len(named) <= NAMED:
        rows = spark.createDataFrame([(w,) for w in named], "word string").select(bucket_of(F.col("word"), index.buckets).alias("b")).distinct().collect()  # as many as buckets
        postings = postings.filter(F.col("bucket").isin([r["b"] for r in rows]) & F.col("word").isin(named))
    lists = postings.join(matched, "word").select("term", "shard", F.explode("ids").alias("at")).groupBy("term", "shard").agg(F.array_sort(F.collect_set("at")).alias("ids"))

    def intersect(table: pa.Table) -> pa.Table:
        """One shard: as many lists as there are terms, of SHARD ids at most."""
        ids = sorted((np.asarray(x.values) for x in table.column("ids")), key=len)
        left = ids[0] if len(ids) == len(terms) else ids[0][:0]
        for other in ids[1:]:
            left = gallop(left, other)
        return pa.table({"id": pa.array(left.astype(np.int64) + int(table.column("shard")[0].as_py()) * SHARD)})

    return lists.groupBy("shard").applyInArrow(intersect, "id long")


def search(spark: SparkSession, index: Index, words: str = "", status: str = "", kind: str = "", limit: int = 20) -> DataFrame:
    """Items that hold all terms, by status and kind, the smallest ids first."""
    terms = sorted(set(words.lower().split()))
    items = index.items(spark)
    if status:
        items = items.filter(F.col("status") == status.upper())
    if kind:
        items = items.filter(F.col("kind") == kind.lower())
    if terms:
        items = items.join(found(spark, index, terms), "id", "left_semi")
    return items.orderBy("id").limit(limit)
