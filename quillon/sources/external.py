"""Feeds that come as files or raw text: price series, factors, paged catalogues, commit logs, mentions and wealth paths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MENTION = "array<struct<number:long,title:string,body:string,url:string,createdAt:string>>"


def price_panel(rows: DataFrame, start: str | None = None) -> DataFrame:
    """(symbol, date, adjusted, nominal) of (symbol, date, field, value), field being adjclose or close.

    Missing and zero values are no observations.  A symbol without adjusted prices is left out; one without any nominal
    price has its adjusted ones for both.
    """
    wide = rows.filter("value is not null and value <> 0").groupBy("symbol", "date").pivot("field", ["adjclose", "close"]).agg(F.max("value"))
    known = wide.groupBy("symbol").agg(F.count("adjclose").alias("__a"), F.count("close").alias("__n")).filter("__a > 0")
    nominal = F.when(F.col("__n") > 0, F.col("close")).otherwise(F.col("adjclose"))
    out = wide.join(known, "symbol").select("symbol", "date", F.col("adjclose").alias("adjusted"), nominal.alias("nominal"))
    return out if start is None else out.filter(F.col("date") >= F.lit(start).cast("date"))


def dead_symbols(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(symbol) of ``wanted`` for which there is no adjusted price at all: a finding, not an error."""
    have = rows.filter("field = 'adjclose' and value is not null and value <> 0").select("symbol")
    return wanted.select("symbol").distinct().join(have, "symbol", "left_anti")


def named_panel(rows: DataFrame, names: list[str]) -> DataFrame:
    """(date, one column a name) of (symbol, date, close); dates on which none of them has a price are left out."""
    return rows.filter(F.col("symbol").isin(names)).groupBy("date").pivot("symbol", names).agg(F.max("close")).dropna("all", subset=names)


def factor_series(rows: DataFrame, field: str) -> DataFrame:
    """(date, value) of one field of a factor library's rows (field, observed_at, value), which may be text."""
    picked = rows.filter(F.col("field") == field).select(F.col("observed_at").try_cast("date").alias("date"), F.col("value").try_cast("double").alias("value"))
    return picked.dropna()


def commits(log: Column) -> Column:
    """Array of (sha, ts, subject, body) of a log whose records end in \\x1e and whose fields are divided by tabs.

    A body may hold tabs; records of fewer than three fields are left out; a null log has none.
    """
    bare = F.transform(F.split(F.coalesce(log, F.lit("")), "\x1e"), lambda r: F.regexp_replace(r, r"^\s+|\s+$", ""))
    fields = F.filter(F.transform(bare, lambda r: F.split(r, "\t", 4)), lambda f: F.size(f) >= 3)
    return F.transform(fields, lambda f: F.struct(f[0].alias("sha"), f[1].alias("ts"), f[2].alias("subject"), F.coalesce(F.get(f, F.lit(3)), F.lit("")).alias("body")))


def mentions(listing: DataFrame, source: str = "github_issue", column: str = "json") -> DataFrame:
    """(source, source_url, raw_text) of JSON lists of issues; a list that cannot be read has none."""
    item = F.explode(F.from_json(column, MENTION)).alias("i")
    text = F.concat(F.coalesce("i.title", F.lit("")), F.lit("\n\n"), F.coalesce("i.body", F.lit("")))
    return listing.select(item).select(F.lit(source).alias("source"), F.col("i.url").alias("source_url"), text.alias("raw_text"))


def wealth_paths(rows: DataFrame) -> DataFrame:
    """(path, wealth array in order of t) of (path, t, wealth); an array is as long as its one series."""
    return rows.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "wealth"))), lambda x: x["wealth"]).alias("wealth"))


def paged_source(fetch: Callable[[str, str], dict], name: str = "paged", schema: str = "query string, record string") -> type[DataSource]:
    """A Spark data source of cursor-paged listings, to be registered by ``spark.dataSource.register``.

    fetch(query, cursor) returns {"results": [text, ...], "next_cursor": text or None}, beginning at cursor ``*``.  Option
    ``queries`` holds the queries, one a line; each is one task, which keeps one page in memory at a time.  A chain ends
    without a next cursor or with an empty page; a lost task reads its chain again.
    """

    class Chain(InputPartition):
        def __init__(self, query: str):
            self.query = query

    class Reader(DataSourceReader):
        def __init__(self, queries: list[str]):
            self.queries = queries

        def partitions(self) -> list[InputPartition]:
            return [Chain(q) for q in self.queries]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            cursor = "*"
            while cursor:
                page = fetch(partition.query, cursor)
                yield from ((partition.query, r) for r in page["results"])
                cursor = page.get("next_cursor") if page["results"] else None

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader([q for q in self.options.get("queries", "").split("\n") if q])

    return Paged
