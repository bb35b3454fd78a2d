"""Analytic views of the star schema: price panels, market and macro series, filings, works and citation edges.

Each is a DataFrame function of (spark, folder) and, for oracles, a SQL common table expression of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def brand_month(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly closes of brands (asset, date, close)."""
    line = table(spark, folder, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    part = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("asset"))
    return line.join(part, line.l_partkey == part.p_partkey).groupBy("asset", F.last_day("l_shipdate").alias("date")).agg((100 + F.avg("l_extendedprice") / 1000).alias("close"))


def brand_day(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse daily closes of brands (asset, date, close)."""
    line = table(spark, folder, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    part = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("asset"))
    return line.join(part, line.l_partkey == part.p_partkey).groupBy("asset", F.to_date("l_shipdate").alias("date")).agg((100 + F.avg("l_extendedprice") / 1000).alias("close"))


def supplier_month(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly closes and volumes of suppliers (asset, date, close, volume)."""
    line = table(spark, folder, "lineitem")
    return line.groupBy(F.col("l_suppkey").alias("asset"), F.last_day("l_shipdate").alias("date")).agg((100 + F.avg("l_extendedprice") / 1000).alias("close"), F.sum("l_quantity").alias("volume"))


def market_day(spark: SparkSession, folder: str) -> DataFrame:
    """One daily level series (date, level)."""
    return table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg((1000 + F.avg("o_totalprice") / 1000).alias("level"))


def sector_map(spark: SparkSession, folder: str) -> DataFrame:
    """(asset, sector): suppliers and their regions."""
    s, n, r = (table(spark, folder, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("asset"), F.col("r_name").alias("sector"))


def filings(spark: SparkSession, folder: str) -> DataFrame:
    """Bitemporal fundamentals (ticker, fiscal_date, filing_date, gross_profit, total_assets); some filing dates are missing."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    fiscal = F.to_date("o_orderdate")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("filing_id"),
        F.col("o_custkey").alias("ticker"),
        fiscal.alias("fiscal_date"),
        F.when(F.col("o_orderkey") % 7 != 0, F.date_add(fiscal, 30)).alias("filing_date"),
        (F.col("o_totalprice") * 0.3).alias("gross_profit"),
        F.col("c_acctbal").alias("total_assets"),
    )


def macro_month(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly market return, risk-free rate and predictors lagged one month (date, mkt, rf, discount, tax, quantity, urgent)."""
    from pyspark.sql import Window

    o, li = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    level = o.groupBy(F.last_day("o_orderdate").alias("date")).agg((1000 + F.avg("o_totalprice") / 1000).alias("level"), F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)).alias("urgent"))
    lines = li.groupBy(F.last_day("l_shipdate").alias("date")).agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.avg("l_quantity").alias("quantity"))
    w = Window.orderBy("date")  # one row a month
    both = level.join(lines, "date")
    return both.select("date", (F.col("level") / F.lag("level").over(w) - 1).alias("mkt"), F.lit(0.002).alias("rf"), *(F.lag(c).over(w).alias(c) for c in ("discount", "tax", "quantity", "urgent"))).dropna()


def ratio_predictors(rows: DataFrame) -> DataFrame:
    """(date, mkt, rf, xs, dp, dfy, tms, dfr, tbl, ltr, ntis, infl) of a published monthly table, all of whose columns may be text.

    rows: yyyymm, CRSP_SPvw, Rfree, D12, Index, BAA, AAA, lty, tbl, corpr, ltr, ntis, infl.  Predictors are those of the month before; months without one of
    the values are left out first, so the month before is the one that is left.
    """
    from pyspark.sql import Window

    x = lambda c: F.col(c).try_cast("double")
    log = lambda c: F.ln(F.when(x(c) > 0, x(c)))
    date = F.last_day(F.to_date(F.concat(F.col("yyyymm").cast("string"), F.lit("01")), "yyyyMMdd"))
    predictors = {"dp": log("D12") - log("Index"), "dfy": x("BAA") - x("AAA"), "tms": x("lty") - x("tbl"), "dfr": x("corpr") - x("ltr"), **{c: x(c) for c in ("tbl", "ltr", "ntis", "infl")}}
    full = rows.select(date.alias("date"), x("CRSP_SPvw").alias("mkt"), x("Rfree").alias("rf"), *[c.alias(n) for n, c in predictors.items()]).dropna()
    w = Window.orderBy("date")  # one row a month
    return full.select("date", "mkt", "rf", (F.col("mkt") - F.col("rf")).alias("xs"), *[F.lag(n).over(w).alias(n) for n in predictors]).dropna()


def works(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as works (id, title, abstract, venue, topic, citations, year, fwci)."""
    d = table(spark, folder, "documents")
    means = d.groupBy(F.col("lang").alias("__lang")).agg(F.avg("n_chars").alias("__mean"))  # a row for each language: texts are not shuffled
    return d.join(F.broadcast(means), F.col("lang").eqNullSafe(F.col("__lang")), "left").select(
        F.col("doc_id").alias("id"),
        F.split("text", "\n").getItem(0).alias("title"),
        F.col("text").alias("abstract"),
        F.col("source").alias("venue"),
        F.col("lang").alias("topic"),
        F.col("n_chars").alias("citations"),
        (F.lit(1990) + F.col("doc_id") % 35).cast("int").alias("year"),
        (F.col("n_chars") / F.col("__mean")).alias("fwci"),
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(id, verdict, confidence) from labels."""
    return table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("verdict"), ((1 + F.col("toxic")) / 2).alias("confidence"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Citation edges (src, dst), each once; both ends are of one id space."""
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def votes(spark: SparkSession, folder: str) -> DataFrame:
    """(submission, faction, vote, weight) from conversations."""
    n = F.length("text")
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("submission"), F.col("role").alias("faction"), F.when(n % 2 == 0, "agree").otherwise("disagree").alias("vote"), F.least(F.sqrt(n.cast("double")), F.lit(10.0)).alias("weight"))


SQL = {
    "brand_month": "SELECT p_brand AS asset, last_day(l_shipdate::DATE) AS date, 100 + avg(l_extendedprice) / 1000 AS close FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2",
    "brand_day": "SELECT p_brand AS asset, l_shipdate::DATE AS date, 100 + avg(l_extendedprice) / 1000 AS close FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2",
    "supplier_month": "SELECT l_suppkey AS asset, last_day(l_shipdate::DATE) AS date, 100 + avg(l_extendedprice) / 1000 AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2",
    "market_day": "SELECT o_orderdate::DATE AS date, 1000 + avg(o_totalprice) / 1000 AS level FROM orders GROUP BY 1",
    "sector_map": "SELECT s_suppkey AS asset, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "filings": "SELECT o_orderkey AS filing_id, o_custkey AS ticker, o_orderdate::DATE AS fiscal_date, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE + 30 END AS filing_date, o_totalprice * 0.3::DOUBLE AS gross_profit, c_acctbal AS total_assets FROM orders JOIN customer ON o_custkey = c_custkey",
    "macro_month": """SELECT * FROM (SELECT date, level / lag(level) OVER w - 1 AS mkt, 0.002::DOUBLE AS rf, lag(discount) OVER w AS discount, lag(tax) OVER w AS tax, lag(quantity) OVER w AS quantity, lag(urgent) OVER w AS urgent
        FROM (SELECT last_day(o_orderdate::DATE) AS date, 1000 + avg(o_totalprice) / 1000 AS level, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS urgent FROM orders GROUP BY 1)
        JOIN (SELECT last_day(l_shipdate::DATE) AS date, avg(l_discount) AS discount, avg(l_tax) AS tax, avg(l_quantity) AS quantity FROM lineitem GROUP BY 1) USING (date) WINDOW w AS (ORDER BY date)) WHERE mkt IS NOT NULL AND discount IS NOT NULL""",
    "works": "SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, text AS abstract, source AS venue, lang AS topic, n_chars AS citations, (1990 + doc_id % 35)::INTEGER AS year, n_chars / avg(n_chars) OVER (PARTITION BY lang) AS fwci FROM documents",
    "ledger": "SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'keep' ELSE 'drop' END AS verdict, (1 + toxic) / 2.0::DOUBLE AS confidence FROM labels",
    "edges": "SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem",
    "votes": "SELECT conv_id AS submission, role AS faction, CASE WHEN length(text) % 2 = 0 THEN 'agree' ELSE 'disagree' END AS vote, least(sqrt(length(text)::DOUBLE), 10.0::DOUBLE) AS weight FROM conversations",
    # derived panels
    "dense_brand": "SELECT a.asset, d.date, b.close FROM (SELECT DISTINCT asset FROM brand_month) a CROSS JOIN (SELECT DISTINCT date FROM brand_month) d LEFT JOIN brand_month b ON b.asset = a.asset AND b.date = d.date",
    "dense_supplier": "SELECT a.asset, d.date, b.close, b.volume FROM (SELECT DISTINCT asset FROM supplier_month) a CROSS JOIN (SELECT DISTINCT date FROM supplier_month) d LEFT JOIN supplier_month b ON b.asset = a.asset AND b.date = d.date",
    "dense_day": "SELECT a.asset, d.date, b.close FROM (SELECT DISTINCT asset FROM brand_day) a CROSS JOIN (SELECT DISTINCT date FROM brand_day) d LEFT JOIN brand_day b ON b.asset = a.asset AND b.date = d.date",
    "momentum": "SELECT asset, date, score FROM (SELECT asset, date, lag(close, 1) OVER w / lag(close, 12) OVER w - 1 AS score FROM dense_supplier WINDOW w AS (PARTITION BY asset ORDER BY date)) WHERE score IS NOT NULL",
    "returns": "SELECT asset, date, close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1 AS ret FROM dense_supplier",
    "forward": "SELECT asset, date, lead(close) OVER (PARTITION BY asset ORDER BY date) / close - 1 AS fwd FROM dense_supplier",
    "brand_returns": "SELECT asset, date, close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1 AS ret FROM dense_brand",
    "market_returns": "SELECT date, level / lag(level) OVER (ORDER BY date) - 1 AS ret FROM market_day",
    "brand_market": "SELECT date, avg(ret) AS mkt FROM brand_returns GROUP BY date",
}
NEEDS = {
    "dense_brand": ("brand_month",), "dense_supplier": ("supplier_month",), "dense_day": ("brand_day",), "momentum": ("dense_supplier",), "returns": ("dense_supplier",),
    "forward": ("dense_supplier",), "brand_returns": ("dense_brand",), "market_returns": ("market_day",), "brand_market": ("brand_returns",),
}


def sql(names: str, body: str) -> str:
    """``body`` with the named views (space separated) and all that they need in front; body may begin with more of them."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for n in names.split():
        add(n)
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    body = body.strip()
    return f"WITH {ctes},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {ctes}\n{body}"
