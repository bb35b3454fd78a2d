"""Corpus ranking, trends and catalogue queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.shared import partitions, staged

LEAST_CITATIONS = 10


def momentum_ratio(recent: Column, prior: Column) -> Column:
    return F.when(prior + recent == 0, 0.0).otherwise(recent.cast("double") / F.greatest(prior, F.lit(3)))


def percent_ranks(df: DataFrame, columns: dict[str, str], pieces: int | None = None) -> DataFrame:
    """Percent rank of each column (double) over the whole table, nulls first, without a window over all rows.

    Values of all columns are counted in one pass, cut into ``pieces`` of about equal numbers of values by column, summed up
    in order inside each piece and over the pieces (a handful of rows), and joined back by value.  pieces: as many as tasks.
    """
    pieces = pieces or max(2, partitions(df.sparkSession))
    df = staged(df, "ranked")
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])))
    counts = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    cuts = counts.groupBy("c").agg(F.percentile_approx("v", [k / pieces for k in range(1, pieces)], 1000).alias("cuts"))  # a row for each column
    piece = F.when(F.col("v").isNull(), -1).otherwise(F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda x: x < F.col("v"))))
    parted = staged(counts.join(F.broadcast(cuts), "c").select("c", "v", "n", piece.alias("piece")), "pieces")
    sizes = parted.groupBy("c", "piece").agg(F.sum("n").alias("m"))
    before = sizes.select("c", "piece", (F.sum("m").over(Window.partitionBy("c").orderBy("piece")) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy("c")).alias("total"))
    below = F.sum("n").over(Window.partitionBy("c", "piece").orderBy("v")) - F.col("n")
    ranks = parted.withColumn("below", below).join(F.broadcast(before), ["c", "piece"])
    ranks = staged(ranks.select("c", "v", F.when(F.col("total") > 1, (F.col("below") + F.col("before")) / (F.col("total") - 1)).otherwise(0.0).alias("rank")), "ranks")
    for column, name in columns.items():
        own = ranks.filter(F.col("c") == column).select(F.col("v").alias("__v"), F.col("rank").alias(name))
        df = df.join(own, F.col(column).cast("double").eqNullSafe(F.col("__v"))).drop("__v")
    return df


def rank_works(works: DataFrame, weights: dict[str, float], since: int = 1990, least: int = LEAST_CITATIONS, dropped: tuple[str, ...] = ()) -> DataFrame:
    """Works with percent-ranked scores and their weighted sum; works: id, year, topic, citations, fwci, pctile, cites_recent2, cites_prior2, is_oa."""
    base = works.filter((F.col("year") >= since) & (F.col("citations") >= least))
    if dropped:
        base = base.filter(~F.col("topic").isin(*dropped))
    base = base.withColumn("mom_raw", momentum_ratio(F.col("cites_recent2"), F.col("cites_prior2"))).withColumn("reach_raw", F.log(1 + F.col("citations")))
    ranked = percent_ranks(base, {"fwci": "s_impact", "pctile": "s_standing", "reach_raw": "s_reach", "mom_raw": "s_momentum"}).withColumn("s_access", F.when(F.col("is_oa"), 1.0).otherwise(0.0))
    score = F.lit(0.0)
    for name, w in weights.items():
        score = score + w * F.col(f"s_{name}")
    return ranked.withColumn("score", 100.0 * score)


def year_percentile(works: DataFrame) -> DataFrame:
    """Mid-rank percentile by citations within the year: 1 - (i + 0.5) / n, and 0.5 for an only work."""
    n = F.count(F.lit(1)).over(Window.partitionBy("year"))
    i = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("citations"), "id")) - 1
    return works.withColumn("percentile", F.when(n == 1, 0.5).otherwise(1 - (i + 0.5) / n))


def per_month(citations: Column, published: Column, as_of: str) -> Column:
    return citations / F.greatest(F.datediff(F.lit(as_of).cast("date"), published) / 30.44, F.lit(1.0))


def quota(works: DataFrame, windows: list[tuple[str, int, int]]) -> DataFrame:
    """Top works by citations of each (window, days, rows), age in days in ``age``; a work may be in several windows.

    Each window is a top-k of its own: every task keeps its best rows, and only these meet.
    """
    out = None
    for name, days, rows in windows:
        best = works.filter(F.col("age") <= days).orderBy(F.desc("citations"), "id").limit(rows).withColumn("window", F.lit(name))
        out = best if out is None else out.unionByName(best)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("window").orderBy(F.desc("citations"), "id")))


def trending(tagged: DataFrame, least: int = 4, least_prior: int = 20, top: int = 8) -> DataFrame:
    """Tags whose recent citations outgrow the prior ones, of (tag, recent, prior)."""
    t = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("papers"), F.sum("recent").alias("recent"), F.sum("prior").alias("prior"))
    t = t.filter((F.col("papers") >= least) & (F.col("prior") >= least_prior)).withColumn("ratio", F.col("recent") / F.greatest("prior", F.lit(1)))
    return t.filter("ratio > 1").orderBy(F.desc("ratio"), "tag").limit(top)


def lift(tagged: DataFrame, least: int = 2, top: int = 7) -> DataFrame:
    """Share of a tag among recent papers over its share among all, of (tag, is_recent)."""
    total = tagged.agg(F.count(F.lit(1)).alias("all_n"), F.count_if("is_recent").alias("all_recent"))
    t = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_recent").alias("recent")).filter(F.col("recent") >= least).crossJoin(F.broadcast(total))
    return t.select("tag", "n", "recent", ((F.col("recent") / F.col("all_recent")) / (F.col("n") / F.col("all_n"))).alias("lift")).orderBy(F.desc("lift"), "tag").limit(top)


def most_common(df: DataFrame, column: str, top: int) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(top)


def search(catalogue: DataFrame, words: str = "", status: str = "", kind: str = "", limit: int = 20) -> DataFrame:
    """Items that hold all terms in title, method or finding, by status and kind."""
    hay = F.lower(F.concat_ws(" ", "title", "method", "finding"))
    out = catalogue
    for term in words.lower().split():
        out = out.filter(F.contains(hay, F.lit(term)))
    if status:
        out = out.filter(F.col("status") == status.upper())
    if kind:
        out = out.filter(F.col("kind") == kind.lower())
    return out.orderBy("id").limit(limit)


def described(catalogue: DataFrame, idea: str) -> DataFrame:
    """The one item that an idea names: by id or title, else the first whose title holds it; no row if there is none."""
    key = F.lit(idea.strip().lower())
    title, id_ = F.lower("title"), F.lower(F.col("id").cast("string"))
    place = F.when(id_ == key, 0).when(title == key, 1).when(F.contains(title, key), 2)
    return catalogue.withColumn("__place", place).filter("__place is not null").orderBy("__place", "id").limit(1).drop("__place")


def implementations(items: DataFrame, modules: DataFrame, files: DataFrame) -> DataFrame:
    """(id, module): the module of an item's slug, else of its archive number without dots, if its file exists.

    items: (id, name); modules: (key, module), a declared table; files: (module).
    """
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim("name")), "[^a-z0-9]+", "-"), "^-|-$", "")
    number = F.replace(F.regexp_extract("name", ARCHIVE_NUMBER, 1), F.lit("."), F.lit(""))
    keys = items.select("id", F.posexplode(F.array(slug, number)).alias("place", "key")).filter("key <> ''")
    found = keys.join(modules.join(files.select("module").distinct(), "module", "left_semi"), "key")
    return found.groupBy("id").agg(F.min_by("module", F.struct("place", "module")).alias("module"))


def status(runs: DataFrame) -> DataFrame:
    """VERIFIED, ATTEMPTED or CATALOGUED of (id, has_run, verification, families ARRAY<STRUCT<got, want>>)."""
    ok = F.forall("families", lambda f: f["got"] == f["want"])
    many = F.coalesce(F.size("families"), F.lit(0)) > 0
    s = F.when(~F.col("has_run"), "CATALOGUED").when(F.col("verification") == "VERIFIED", "VERIFIED").when(F.col("verification").isNotNull(), "ATTEMPTED").when(many & ok, "VERIFIED").otherwise("ATTEMPTED")
    return runs.withColumn("status", s)


#: an alias may be written as a name, as a slug or with an archive's number in it; the first two always exist
NAME, SLUG, NUMBER = "name", "slug", "number"
ARCHIVE_NUMBER = r"([0-9]{4}\.[0-9]{4,5})"


def alias_keys(alias: Column) -> Column:
    """The keys of an alias, best first: its name without version, its slug, and the archive number it holds."""
    name = F.regexp_replace(F.lower(F.trim(alias)), r"v[0-9]+$", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(alias)), "[^a-z0-9]+", "-"), "^-|-$", "")
    number = F.nullif(F.regexp_extract(alias, ARCHIVE_NUMBER, 1), F.lit(""))
    return F.filter(F.array_distinct(F.array(name, slug, number)), lambda k: k.isNotNull() & (k != ""))


def resolve_aliases(records: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, run): the run of the first alias of a record that has one; records: id, aliases; runs: key, run.

    Both sides answer to all three forms of their aliases; of several runs of a key the smallest counts.
    """
    a = records.select("id", F.posexplode("aliases").alias("place", "alias")).select("id", "place", F.posexplode(alias_keys(F.col("alias"))).alias("form", "key"))
    r = runs.select(F.explode(alias_keys(F.col("key"))).alias("key"), "run").groupBy("key").agg(F.min("run").alias("run"))
    return a.join(r, "key").groupBy("id").agg(F.min_by("run", F.struct("place", "form")).alias("run"))
