"""Operator 7 [native]: deletion of later copies of repeated line runs, by a suffix array over line ids.

1.  Lines that hold a word are exploded to (document, place, line id); only lines that stand in several places go on.
2.  Distributed prefix doubling: the rank of the h lines from a place orders them among all, and the rank of 2h lines is
    that of the pair (rank of h lines here, rank of h lines h places on).  A round joins the pairs by place, counts equal
    ones with map-side sums and sorts the distinct pairs by range over all tasks; a place in that order is the new rank
    (``monotonically_increasing_id``, which grows along sorted partitions).  Places whose pair stands once have a rank of
    their own and drop out; rounds end when none is left, after the logarithm of the longest repeated run.
3.  The places of one rank of h lines are an interval of the suffix array whose longest common prefix is h or more.  Its
    first place in the order of documents is the original, the others are copies.  Each copy's deepest interval says how
    long its run is at least; a length between powers of two takes two overlapping ranks.  Copies side by side make up
    the maximal repeated runs, which are deleted.

A run counts from ``min_lines`` lines, or as a single line of ``min_words`` words, so that a long passage that is one line
goes whatever stands around it.  No group is gathered anywhere: a line that millions of documents have is one row of the
distinct pairs, and the joins that bring ranks back to places may be split by Spark, as one side is unique.

Defined results: a null text is empty; lines are equal if all their characters are; lines without a word never start a
run and share the fate of the line with words before them; copies are ordered by (doc_id, line), null ids last, and
equal places (repeated rows) are not later than each other; an empty table gives no rows; other columns are returned as
they are, and the added column gets underscores after its name if the input has one of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.plans.shared import staged, unused

MIN_LINES = 2
MIN_WORDS = 50
HAS_WORD = r"[^\x20\x09-\x0D]"
WORD = HAS_WORD + "+"
NO_ID = (1 << 63) - 1
P = "__line_dedup_"


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select("*", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias(f"{P}id"), F.xxhash64(text).alias(f"{P}key"))


def _places(text: Column) -> tuple[Column, Column]:
    """All lines of a text and the indexes (from 0) of those with a word."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    flagged = F.transform(lines, lambda x, i: F.when(x.rlike(HAS_WORD), i))
    return lines, F.filter(flagged, lambda i: i.isNotNull())


SUFFIX = [f"{P}id", f"{P}key", "at"]


def _place() -> Column:
    """The order of all places as one number: document, then line."""
    return (F.col(f"{P}id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("at")).cast("decimal(38,0)")


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, first, order): the values of ``by`` that stand in several places, in order, and the first of these places."""
    groups = rows.groupBy(*by).agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first < last").drop("last")
    ordered = groups.repartitionByRange(*by).sortWithinPartitions(*by)
    return staged(ordered.withColumn("order", F.monotonically_increasing_id()), "line-ranks")


def _joined(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Places with the rank of their group; copy: another place of the group comes before."""
    return rows.join(groups, by).select(*SUFFIX, "place", F.col("order").alias("rank"), "long", (F.col("place") > F.col("first")).alias("copy"))


def suffix_intervals(docs: DataFrame, text_col: str, min_words: int | None = None) -> Iterator[tuple[int, DataFrame]]:
    """(h, places) for h = 1, 2, 4, ...: (SUFFIX, place, rank, long, copy) of the places whose next h lines stand elsewhere too.

    Ranks order the h lines as the sequences of their ids are ordered; long: the line has ``min_words`` words.
    """
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: x.rlike(HAS_WORD))

    def is_long(x: Column) -> Column:
        # n words have 2 n - 1 characters at least, so that few lines are counted
        return F.lit(False) if min_words is None else (F.length(x) >= 2 * min_words - 1) & (F.regexp_count(x, F.lit(WORD)) >= min_words)

    ids = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), is_long(x).alias("long")))
    rows = docs.select(f"{P}id", f"{P}key", F.posexplode(ids).alias("at", "line")).select(*SUFFIX, "line.*").withColumn("place", _place())
    # repeated rows are one document here
    now = staged(_joined(rows, _ranked(rows, ["a", "b"]), ["a", "b"]).distinct(), "line-suffixes")
    h = 1
    while not now.isEmpty():
        yield h, now
        pairs = staged(_ahead(now, h), "line-pairs")
        now = staged(_joined(pairs, _ranked(pairs, ["rank", "next"]), ["rank", "next"]), "line-suffixes")
        h *= 2


def _ahead(places: DataFrame, h: int) -> DataFrame:
    """Places with the rank of the place h lines on."""
    return places.drop("copy").join(places.select(f"{P}id", f"{P}key", (F.col("at") - h).alias("at"), F.col("rank").alias("next")), SUFFIX)


def copied_runs(docs: DataFrame, min_lines: int, text_col: str, min_words: int | None = MIN_WORDS) -> DataFrame:
    """(id, key, runs): maximal runs [start, stop) of copied lines of each document that has some, in lines with words."""
    found: list[DataFrame] = []
    deepest: tuple[int, DataFrame] | None = None  # copies of the last depth, which stand for their run unless they are in the next

    def copies(places: DataFrame) -> DataFrame:
        return places.filter("copy").select(*SUFFIX)

    def deepen(n: int, rows: DataFrame) -> tuple[int, DataFrame]:
        if deepest:
            found.append(deepest[1].join(rows, SUFFIX, "left_anti").withColumn("n", F.lit(deepest[0])))
        return n, rows

    for h, places in suffix_intervals(docs, text_col, min_words):
        if h == 1 and min_lines > 1 and min_words is not None:
            found.append(copies(places.filter("long")).withColumn("n", F.lit(1)))
        if h >= min_lines:
            deepest = deepen(h, copies(places))
        elif 2 * h > min_lines:
            # min_lines is between two powers: two ranks of h lines that overlap
            pairs = staged(_ahead(places, min_lines - h), "line-pairs")
            deepest = deepen(min_lines, copies(staged(_joined(pairs, _ranked(pairs, ["rank", "next"]), ["rank", "next"]), "line-suffixes")))
    if deepest:
        found.append(deepest[1].withColumn("n", F.lit(deepest[0])))
    if not found:
        return docs.select(f"{P}id", f"{P}key", F.expr("CAST(NULL AS array<struct<start:int,stop:int>>)").alias("runs")).limit(0)
    covers = found[0]
    for part in found[1:]:
        covers = covers.unionByName(part)
    # stretches that touch become one run; a window holds one document's places
    order = Window.partitionBy(f"{P}id", f"{P}key").orderBy("at", "n")
    before = F.max(F.col("at") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    covers = covers.withColumn("opens", F.when(F.col("at") <= before, 0).otherwise(1))
    covers = covers.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = covers.groupBy(f"{P}id", f"{P}key", "run").agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("n")).alias("stop"))
    return runs.groupBy(f"{P}id", f"{P}key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = MIN_WORDS, runs_col: str | None = "removed_runs") -> DataFrame:
    """The documents with later copies of line runs deleted, all columns, and ``runs_col`` (None: without) as an extra last column.

    It holds (first line, number of lines) of what was deleted, in lines of the input text.
    """
    columns = docs.columns
    docs = _prepared(docs, id_col, text_col)
    listed = copied_runs(docs, min_lines, text_col, min_words).withColumnRenamed("runs", f"{P}found")
    joined = docs.join(listed, [f"{P}id", f"{P}key"], "left")
    found = F.col(f"{P}found")
    lines, content = _places(F.col(text_col))
    joined = joined.withColumn(f"{P}lines", F.when(found.isNotNull(), lines)).withColumn(f"{P}content", F.when(found.isNotNull(), content))
    lines, content = F.col(f"{P}lines"), F.col(f"{P}content")
    # [first, stop) in lines: blank lines after a run go with it
    runs = F.transform(found, lambda r: F.struct(F.element_at(content, r["start"] + 1).alias("first"), F.coalesce(F.try_element_at(content, r["stop"] + 1), F.size(lines)).alias("stop")))
    joined = joined.withColumn(f"{P}runs", runs)
    runs = F.col(f"{P}runs")
    # what stays: from the stop of one run to the start of the next
    froms = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["stop"]))
    tos = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(lines)))
    stays = F.flatten(F.zip_with(froms, tos, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0)))))
    text = F.when(found.isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(stays, "\n"))
    joined = joined.withColumn(text_col, text)
    if not runs_col:
        return joined.select(*columns)
    removed = F.coalesce(F.transform(runs, lambda r: F.struct(r["first"].alias("first"), (r["stop"] - r["first"]).alias("lines"))), F.array().cast("array<struct<first:int,lines:int>>"))
    return joined.select(*columns, removed.alias(unused(columns, runs_col)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document after line dedup."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")))
    return out.select("doc_id", "n_lines", F.aggregate("removed_runs", F.lit(0).cast("long"), lambda a, r: a + r["lines"]).alias("n_removed"), F.size("removed_runs").cast("long").alias("n_runs"), F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
content AS (
    SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next_line
    FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
starts AS (
    SELECT *, first_value(doc_id) OVER w = doc_id AND first_value(k) OVER w = k AS is_first
    FROM content WHERE next_line IS NOT NULL WINDOW w AS (PARTITION BY line, next_line ORDER BY doc_id, k)),
singles AS (
    SELECT *, first_value(doc_id) OVER w = doc_id AND first_value(k) OVER w = k AS is_first
    FROM content WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50 WINDOW w AS (PARTITION BY line ORDER BY doc_id, k)),
gone AS (
    SELECT DISTINCT doc_id, k FROM (
        SELECT doc_id, k FROM starts WHERE NOT is_first UNION ALL SELECT doc_id, k + 1 FROM starts WHERE NOT is_first
        UNION ALL SELECT doc_id, k FROM singles WHERE NOT is_first)),
fate AS (
    SELECT l.doc_id, l.i, l.line, coalesce(last_value(CASE WHEN c.k IS NOT NULL THEN g.k IS NOT NULL END IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.i), false) AS gone
    FROM lines l LEFT JOIN content c ON c.doc_id = l.doc_id AND c.i = l.i LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.k = c.k),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM fate)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_runs,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM runs GROUP BY doc_id
"""
