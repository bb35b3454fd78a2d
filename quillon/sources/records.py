"""Readers, record mappers and sinks: works, fundamentals, filings, feeds, logs and catalogues.

All readers take paths that Spark resolves, so they may be in any store that it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: one schema for every feed
PAPER = "source string, external_id string, title string, abstract string, authors string, published_at timestamp, pdf_url string, landing_url string, categories string, raw string"
WORK = (
    "id string, doi string, title string, publication_date string, publication_year int, type string, cited_by_count int, fwci double, citation_normalized_percentile struct<value:double>, counts_by_year array<struct<year:int,cited_by_count:int>>, "
    "referenced_works_count int, authorships array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string>>,countries:array<string>>>, open_access struct<is_oa:boolean,oa_url:string>, "
    "primary_location struct<source:struct<id:string,display_name:string>>, primary_topic struct<id:string,display_name:string>, topics array<struct<display_name:string>>, keywords array<struct<display_name:string>>, "
    "grants array<struct<funder_display_name:string>>, referenced_works array<string>, abstract_inverted_index map<string,array<int>>"
)
FUNDAMENTALS = "General struct<Code:string,Exchange:string,IsDelisted:boolean,DelistedDate:string>, Financials map<string,struct<quarterly:map<string,map<string,string>>,yearly:map<string,map<string,string>>>>"
METRICS = "timestamp string, ts string, verdict_accuracy double, sharpe_in_range_rate double, asymmetric_loss double, n_false_negatives long"


def read_json(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """JSON (lines, or one document a file) with a fixed schema; unreadable records are dropped; gzip is transparent."""
    full = f"{schema}, _corrupt string"
    df = spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", whole).json(path)
    # the corrupt column may not be the only one read
    return df.withColumn("__bad", F.col("_corrupt").isNotNull()).filter("not __bad").drop("__bad", "_corrupt")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """CSV of strings with a header that may begin with a byte order mark."""
    df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A metrics log of both row shapes, with one time column and null-safe measures."""
    return read_json(spark, path, METRICS).withColumn("ts", F.coalesce("ts", "timestamp")).drop("timestamp")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both with the last write of each key."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("__r = 1").drop("__r")


def by_priority(rows: DataFrame, keys: list[str], rank: str, *ties: str) -> DataFrame:
    """The row of the best (lowest) rank for each key, as when candidate paths are tried in order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, *ties))).filter("__r = 1").drop("__r")


def published_portfolio(rows: DataFrame, signal: str, port: str = "LS") -> DataFrame:
    """(date, theirs) of one published predictor's portfolio, in percent a month, at calendar month ends."""
    return rows.filter((F.col("signalname") == signal) & (F.col("port") == port)).select(F.last_day("date").alias("date"), F.col("ret").alias("theirs"))


def with_counts(papers: DataFrame, counts: DataFrame, key: str = "id") -> DataFrame:
    """Papers with citation counts of another table; papers it lacks have none."""
    return papers.join(counts.groupBy(key).agg(F.max("citations").alias("citations")), key, "left").withColumn("citations", F.coalesce("citations", F.lit(0)))


def paper_record(works: DataFrame) -> DataFrame:
    """Flat works as paper records: link and date by fallback, the first three authors."""
    names = F.split("authors", ", ")
    short = F.when(F.size(names) > 3, F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.lit(" et al."))).otherwise(F.col("authors"))
    link = F.coalesce(F.nullif("oa_url", F.lit("")), F.when(F.col("doi") != "", F.concat(F.lit("https://doi.org/"), "doi")), F.concat(F.lit("https://openalex.org/"), "id"))
    return works.select("id", "title", short.alias("authors"), link.alias("url"), F.coalesce(F.nullif("date", F.lit("")), F.concat("year", F.lit("-01-01"))).alias("published"), "abstract", "citations", "venue")


def load_universe(spark, path: str, other: list[str], name: str | None = None) -> DataFrame:
    """(symbol) of a JSON list, or of the list ``name`` of a map of them, or of ``other`` where there is no file."""
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:  # noqa: BLE001  only a missing file stands for the others
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([(x,) for x in other], "symbol string")
    lists = F.from_json("value", "array<string>")
    if name is not None:
        some = lambda c: F.try_element_at(c, F.lit(name))
        flat = F.from_json("value", "map<string,string>")
        lists = F.from_json(F.coalesce(some(F.from_json(F.try_element_at(flat, F.lit("universes")), "map<string,string>")), some(flat)), "array<string>")
    return text.select(F.explode(lists).alias("symbol")).filter("symbol is not null").distinct()


def abstract_of(index: Column) -> Column:
    """Text from a map of words to their positions."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " "), F.lit(""))


def last_segment(url: Column) -> Column:
    return F.substring_index(F.coalesce(url, F.lit("")), "/", -1)


def flat_works(raw: DataFrame) -> DataFrame:
    """27 flat columns of nested works: trajectories, joined lists and bare ids."""
    counts = F.array_sort(F.coalesce("counts_by_year", F.array().cast("array<struct<year:int,cited_by_count:int>>")))
    n = F.size(counts)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["cited_by_count"])
    recent = total(F.slice(counts, F.greatest(n - 1, F.lit(1)), F.lit(2)))
    prior = F.when(n > 2, total(F.slice(counts, F.greatest(n - 3, F.lit(1)), F.least(n - 2, F.lit(2)))) ).otherwise(0)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    names = lambda a, f, k, sep: F.coalesce(F.array_join(F.slice(F.transform(a, f), 1, k), sep), F.lit(""))
    spread = lambda a, k: F.coalesce(F.array_join(F.slice(F.array_sort(F.array_distinct(a)), 1, k), " | "), F.lit(""))
    shown = lambda x: F.coalesce(x["display_name"], F.lit(""))
    a = F.coalesce("authorships", F.array().cast("array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string>>,countries:array<string>>>"))
    return raw.select(
        last_segment(F.col("id")).alias("id"), F.regexp_replace(text("doi"), "^https://doi.org/", "").alias("doi"), text("title").alias("title"), text("publication_date").alias("date"), F.coalesce("publication_year", F.lit(0)).alias("year"), text("type").alias("type"),
        F.coalesce("cited_by_count", F.lit(0)).alias("citations"), "fwci", F.col("citation_normalized_percentile.value").alias("pctile"), recent.alias("cites_recent2"), prior.alias("cites_prior2"), F.coalesce("referenced_works_count", F.lit(0)).alias("references_"),
        F.size(a).alias("n_authors"), F.coalesce("open_access.is_oa", F.lit(False)).alias("is_oa"), text("open_access.oa_url").alias("oa_url"), text("primary_location.source.display_name").alias("venue"), last_segment(F.col("primary_location.source.id")).alias("venue_id"),
        text("primary_topic.display_name").alias("topic"), last_segment(F.col("primary_topic.id")).alias("topic_id"), names(a, lambda x: shown(x["author"]), 12, ", ").alias("authors"), abstract_of(F.col("abstract_inverted_index")).alias("abstract"),
        names(F.col("topics"), shown, 3, " | ").alias("topics"), names(F.col("keywords"), shown, 6, " | ").alias("keywords"), spread(F.flatten(F.transform(a, lambda x: F.transform(x["institutions"], shown))), 6).alias("institutions"),
        spread(F.flatten(F.transform(a, lambda x: x["countries"])), 6).alias("countries"), spread(F.transform("grants", lambda x: F.coalesce(x["funder_display_name"], F.lit(""))), 4).alias("funders"), F.coalesce(F.array_join(F.transform("referenced_works", last_segment), " "), F.lit("")).alias("refs"),
    )


def fundamentals_panel(documents: DataFrame, statement: str, frequency: str, fields: list[str]) -> DataFrame:
    """(ticker, fiscal_date, filing_date, fields...) of nested statements: explode fiscal entries, coerce, date the undated."""
    entries = documents.select(F.col("General.Code").alias("ticker"), F.explode(F.col("Financials")[statement][frequency]).alias("fiscal", "entry"))
    fiscal = F.col("fiscal").try_cast("date")
    filed = F.coalesce(F.col("entry")["filing_date"].try_cast("date"), F.date_add(fiscal, 45))
    return entries.select(F.upper(F.regexp_replace("ticker", r"\.[A-Za-z]+$", "")).alias("ticker"), fiscal.alias("fiscal_date"), filed.alias("filing_date"), *[F.col("entry")[f].try_cast("double").alias(f) for f in fields]).filter("fiscal_date is not null")


def stripped(html: Column) -> Column:
    """Text of marked-up text: scripts, styles and tags out, the common entities resolved, white space folded."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]+>", " ")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def slug(text: Column, length: int = 80, default: str = "untitled") -> Column:
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.substring(s, 1, length), F.lit("")), F.lit(default))


def clip(text: Column, length: int) -> Column:
    """Cut at a word, with an ellipsis."""
    return F.when(F.length(text) <= length, text).otherwise(F.concat(F.rtrim(F.regexp_extract(text, rf"(?s)^(.{{0,{length}}})\s", 1)), F.lit("…")))


def standard_record(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    """A feed's rows in the common schema; what it lacks is null."""
    names = [x.split()[0] for x in PAPER.split(", ")]
    types = dict(x.split() for x in PAPER.split(", "))
    return df.select(*[(F.lit(source) if n == "source" else columns.get(n, F.lit(None))).cast(types[n]).alias(n) for n in names])


def openap_fixture(rows: DataFrame) -> DataFrame:
    """Derived expectations of predictor rows (all strings): sign label, Sharpe range from t, verdict label and horizon."""
    num = lambda c: F.col(c).try_cast("double")
    t = num("`T-Stat`")
    first, last = num("SampleStartYear"), num("SampleEndYear")
    months = (last - first + 1) * 12
    n = F.when((months < 12) | months.isNull(), 240.0).otherwise(months)
    centre = t / F.sqrt(n / 12) * 0.7
    sign = num("Sign")
    label = F.create_map(*[F.lit(x) for x in ("1_clear", "ship", "2_likely", "iterate", "4_not", "kill", "3_maybe", "iterate", "9_drop", "kill")])
    verdict = F.when(F.col("`Cat.Signal`") == "Placebo", "kill").otherwise(F.coalesce(F.try_element_at(label, F.col("`Predictability in OP`")), F.lit("iterate")))
    return rows.select(
        "Acronym", F.when(sign > 0, "+").when(sign < 0, "-").otherwise("both").alias("sign"), F.when(t.isNull(), F.struct(F.lit(0.0).alias("lo"), F.lit(0.6).alias("hi"))).otherwise(F.struct(F.greatest(F.lit(0.0), centre - 0.3).alias("lo"), (centre + 0.3).alias("hi"))).alias("sharpe_range"),
        verdict.alias("verdict"), F.greatest(F.lit(1), F.coalesce((num("`Portfolio Period`") * 21).cast("int"), F.lit(1))).alias("horizon_days"), (num("`Mean Return`") / 100 * 12).alias("annual_return"), F.make_date(last.cast("int") + 1, F.lit(1), F.lit(1)).alias("window_start"),
    )


def post_sample(end_year: Column, as_of: Column) -> Column:
    """(start, end) of the years a paper never saw: from the January after its sample to ``as_of``; null if there are none yet."""
    start = F.make_date(end_year.cast("int") + 1, F.lit(1), F.lit(1))
    return F.when((end_year != 0) & (start < as_of), F.struct(start.alias("start"), as_of.alias("end")))


def offline_spec(text: Column) -> Column:
    """What patterns alone say about a signal: Sharpe, universe, rebalancing and shape."""
    monthly = text.rlike(r"(?i)\bmonthly\b.*\brebalanc")
    return F.struct(
        F.nullif(F.regexp_extract(text, r"(?i)sharpe(\s+ratio)?[:\s]+(\d+\.\d+)", 2), F.lit("")).cast("double").alias("claimed_sharpe"), F.when(text.rlike(r"(?i)\bs&p\s*500\b|\bsp\s*500\b|\bsp500\b"), "sp500").alias("universe"),
        F.when(monthly, "monthly").alias("rebalance_freq"), F.when(monthly, 21).alias("horizon_days"), F.when(text.rlike(r"(?i)\b(cross[- ]?section)\b"), True).alias("is_cross_sectional"),
    )


KEYS = ("formula", "horizon_days", "universe", "rebalance_freq", "expected_sign", "is_cross_sectional", "is_long_short")


def agreement(a: str, b: str, columns: dict[str, str]) -> Column:
    """Share of fields of two structs that agree: both null, equal, or one string within the other.

    columns: field to type, of those of KEYS that the structs have; the others are null in both.
    """
    hits = F.lit(len(KEYS) - len(columns)).cast("double")
    for name, kind in columns.items():
        x, y = F.col(f"{a}.{name}"), F.col(f"{b}.{name}")
        if kind == "string":
            lx, ly = F.lower(F.trim(x)), F.lower(F.trim(y))
            same = F.contains(lx, ly) | F.contains(ly, lx)
        else:
            same = x == y
        hits = hits + F.when((x.isNull() & y.isNull()) | F.coalesce(same, F.lit(False)), 1.0).otherwise(0.0)
    return hits / len(KEYS)
