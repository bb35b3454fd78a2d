"""Queries over price panels: scans, alignment, returns, signals and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import panel as P
from quillon.operators import signals as S
from quillon.plans.registry import query
from quillon.sources import views as V
from quillon.sources.views import sql


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places (adding 0 turns -0 into 0), so that sums in another order compare equal."""
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names})


def brands(spark: SparkSession, folder: str) -> DataFrame:
    return P.dense(V.brand_month(spark, folder))


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return P.dense(V.supplier_month(spark, folder))


def days(spark: SparkSession, folder: str) -> DataFrame:
    return P.dense(V.brand_day(spark, folder))


R = "round({}, 6) + 0.0 AS {}"


@query(sql("brand_month", "SELECT date, asset, round(close, 9) AS close FROM brand_month WHERE asset IN ('Brand#11', 'Brand#12', 'Brand#1', 'Brand#2') AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"))
def panel_scan(spark, folder):
    return rounded(P.scan(V.brand_month(spark, folder), ["Brand#11", "Brand#12", "Brand#1", "Brand#2"], "1996-01-01", "1999-12-31"), digits=9)


@query(sql("brand_day", "SELECT asset, last_day(date) AS date, round(arg_max(close, date), 9) AS close FROM brand_day WHERE close IS NOT NULL GROUP BY 1, 2"))
def monthly_panel(spark, folder):
    return rounded(P.month_end(V.brand_day(spark, folder)), digits=9)


@query(sql("dense_brand", "SELECT asset, date, round(close / lag(close) OVER w - 1, 6) + 0.0::DOUBLE AS simple, round(ln(close / lag(close) OVER w), 6) + 0.0::DOUBLE AS logarithmic FROM dense_brand WINDOW w AS (PARTITION BY asset ORDER BY date)"))
def monthly_returns(spark, folder):
    p = brands(spark, folder)
    return rounded(P.returns(p).withColumnRenamed("ret", "simple").join(P.returns(p, log=True).withColumnRenamed("ret", "logarithmic"), ["asset", "date"]))


@query(sql("dense_day", """WITH f AS (SELECT asset, date, last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM dense_day)
SELECT asset, date, round(v / lag(v) OVER (PARTITION BY asset ORDER BY date) - 1, 6) + 0.0::DOUBLE AS ret FROM f"""))
def padded_returns(spark, folder):
    return rounded(P.returns(days(spark, folder), pad=True))


@query(sql("dense_day", "SELECT asset, date, round(last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 9) AS close FROM dense_day"))
def ffill_panel(spark, folder):
    return rounded(P.filled(days(spark, folder)), digits=9)


@query(sql("brand_day", "SELECT DISTINCT date FROM brand_day WHERE date = last_day(date)"))
def rebalance_calendar(spark, folder):
    return P.calendar_month_ends(V.brand_day(spark, folder))


def _lag_sql(name: str, a: str, b: str) -> str:
    return sql(name, f"SELECT asset, date, round({a} / {b} - 1, 6) + 0.0::DOUBLE AS score FROM {name} WINDOW w AS (PARTITION BY asset ORDER BY date)")


@query(_lag_sql("dense_brand", "lag(close, 1) OVER w", "lag(close, 12) OVER w"))
def momentum_12_1(spark, folder):
    return rounded(S.momentum(brands(spark, folder), 1, 12))


@query(_lag_sql("dense_brand", "lag(close, 1) OVER w", "lag(close, 6) OVER w"))
def momentum_6_1(spark, folder):
    return rounded(S.momentum(brands(spark, folder), 1, 6))


@query(_lag_sql("dense_brand", "close", "lag(close, 1) OVER w"))
def reversal_1m(spark, folder):
    return rounded(S.reversal(brands(spark, folder), 1))


@query(_lag_sql("dense_brand", "lead(close, 1) OVER w", "close").replace("AS score", "AS fwd"))
def forward_returns(spark, folder):
    return rounded(P.forward_return(brands(spark, folder)))


@query(sql("brand_returns", """SELECT asset, date, round(CASE WHEN count(ret) OVER w = 12 THEN stddev_samp(ret) OVER w END, 6) AS vol, round(CASE WHEN count(ret) OVER w = 12 THEN max(ret) OVER w END, 6) AS best,
round(CASE WHEN count(ret) OVER w >= 6 THEN avg(ret) OVER w END, 6) + 0.0::DOUBLE AS mean FROM brand_returns WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 11 PRECEDING)"""))
def rolling_statistics(spark, folder):
    r = P.returns(brands(spark, folder))
    parts = [S.rolling(r, 12, "std").withColumnRenamed("score", "vol"), S.max_return(r, 12).withColumnRenamed("score", "best"), S.rolling(r, 12, "mean", 6).withColumnRenamed("score", "mean")]
    return rounded(parts[0].join(parts[1], ["asset", "date"]).join(parts[2], ["asset", "date"]))


_BETA = """WITH b AS (SELECT r.asset, r.date, ret, mkt FROM brand_returns r JOIN brand_market m USING (date)),
s AS (SELECT asset, date, ret, mkt, CASE WHEN count(CASE WHEN ret IS NOT NULL AND mkt IS NOT NULL THEN 1 END) OVER w = 24 THEN covar_samp(ret, mkt) OVER w / CASE WHEN count(mkt) OVER w = 24 THEN var_samp(mkt) OVER w END END AS score FROM b WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 23 PRECEDING))"""


@query(sql("brand_market", _BETA + " SELECT asset, date, round(score, 6) + 0.0::DOUBLE AS score FROM s"))
def rolling_beta(spark, folder):
    return rounded(S.beta(P.returns(brands(spark, folder)), 24).select("asset", "date", "score"))


@query(sql("brand_market", _BETA + ", e AS (SELECT asset, date, ret - score * mkt AS x FROM s) SELECT asset, date, round(CASE WHEN count(x) OVER w = 24 THEN stddev_samp(x) OVER w END, 6) AS score FROM e WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 23 PRECEDING)"))
def idio_vol(spark, folder):
    return rounded(S.idio_vol(P.returns(brands(spark, folder)), 24))


@query(sql("dense_supplier", "SELECT asset, date, round(CASE WHEN count(volume) OVER w = 36 THEN stddev_samp(volume) OVER w / CASE WHEN avg(volume) OVER w > 0 THEN avg(volume) OVER w END END, 6) AS score FROM dense_supplier WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 35 PRECEDING)"))
def rolling_cv(spark, folder):
    return rounded(S.coefficient_of_variation(suppliers(spark, folder), 36, "volume"))


_DAY = """WITH r AS (SELECT asset, date, close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1 AS ret FROM dense_day)"""


@query(sql("dense_day", _DAY + " SELECT asset, last_day(date) AS date, round(CASE WHEN count(ret) >= 8 THEN -stddev_samp(ret) END, 6) + 0.0::DOUBLE AS vol, round(CASE WHEN count(ret) >= 8 THEN -skewness(ret) END, 5) + 0.0::DOUBLE AS skew FROM r GROUP BY 1, 2"))
def month_vol_skew(spark, folder):
    return rounded(rounded(S.monthly_moments(P.returns(days(spark, folder)), 8), "vol"), "skew", digits=5)


@query(
    sql(
        "dense_day",
        _DAY
        + """, m AS (SELECT date, avg(ret) AS mkt FROM r GROUP BY date), b AS (SELECT asset, date, last_day(date) AS month, ret, mkt FROM r JOIN m USING (date) WHERE mkt IS NOT NULL),
v AS (SELECT month, var_samp(mkt) AS var FROM (SELECT DISTINCT month, date, mkt FROM b) GROUP BY month HAVING count(*) >= 8 AND var_samp(mkt) > 0),
c AS (SELECT asset, month, covar_samp(ret, mkt) / any_value(var) AS slope FROM b JOIN v USING (month) GROUP BY ALL)
SELECT asset, month AS date, round(-skewness(ret - slope * mkt), 5) + 0.0::DOUBLE AS score FROM b JOIN c USING (asset, month) WHERE ret IS NOT NULL GROUP BY 1, 2 HAVING count(ret) >= 8""",
    )
)
def idio_skew(spark, folder):
    return rounded(S.idio_skew(P.returns(days(spark, folder)), 8), digits=5)


@query(
    sql(
        "brand_market",
        """WITH b AS (SELECT r.asset, r.date, ret, mkt FROM brand_returns r JOIN brand_market m USING (date)),
f AS (SELECT asset, date, row_number() OVER (PARTITION BY asset ORDER BY date) AS k, count(ret) OVER w AS nr, count(mkt) OVER w AS nm, regr_slope(ret, mkt) OVER w AS slope, regr_intercept(ret, mkt) OVER w AS cut, ret, mkt FROM b WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 35 PRECEDING)),
e AS (SELECT f.asset, f.date, g.ret - f.cut - f.slope * g.mkt AS x FROM f JOIN f g ON g.asset = f.asset AND g.k BETWEEN f.k - 11 AND f.k - 1 WHERE f.nr = 36 AND f.nm = 36 AND f.k > 36)
SELECT asset, date, round(avg(x) / CASE WHEN stddev_samp(x) > 0 THEN stddev_samp(x) END, 5) + 0.0::DOUBLE AS score FROM e GROUP BY 1, 2""",
    )
)
def residual_momentum(spark, folder):
    return rounded(S.residual_momentum(P.returns(brands(spark, folder))), digits=5)


@query(
    sql(
        "dense_supplier",
        """WITH s AS (SELECT s_suppkey AS asset, (SELECT min(date) FROM supplier_month) AS date, abs(s_acctbal) * 100 + 1000 AS shares FROM supplier),
t AS (SELECT asset, date, volume / last_value(shares IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS ret FROM dense_supplier LEFT JOIN s USING (asset, date))
SELECT asset, date, round(ret, 9) AS ret, round(CASE WHEN count(ret) OVER w = 36 THEN stddev_samp(ret) OVER w / CASE WHEN avg(ret) OVER w > 0 THEN avg(ret) OVER w END END, 6) AS score FROM t WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 35 PRECEDING)""",
    )
)
def share_turnover(spark, folder):
    p = suppliers(spark, folder)
    first = V.supplier_month(spark, folder).agg(F.min("date").alias("date"))  # one row
    shares = V.table(spark, folder, "supplier").crossJoin(F.broadcast(first)).select(F.col("s_suppkey").alias("asset"), "date", (F.abs("s_acctbal") * 100 + 1000).alias("shares"))
    t = S.share_turnover(p, shares)
    return rounded(rounded(t.join(S.coefficient_of_variation(t, 36), ["asset", "date"]), "score"), "ret", digits=9)


@query(sql("dense_supplier", "WITH t AS (SELECT asset, date, close * volume AS v FROM dense_supplier) SELECT asset, date, round(CASE WHEN count(v) OVER w >= 6 THEN var_samp(v) OVER w END, 3) + 0.0::DOUBLE AS score FROM t WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 11 PRECEDING)"))
def dollar_volume_variance(spark, folder):
    return rounded(S.dollar_volume_variance(suppliers(spark, folder), 12, 6), digits=3)


def ewm_sql(name: str, source: str, column: str, span: int) -> str:
    """CTEs that carry an exponentially weighted mean from row to row: (asset, date, k, m, w)."""
    a = f"{2 / (span + 1)!r}::DOUBLE"
    kept = f"r.w * (1 - {a})"
    return f"""{name}_rows AS (SELECT asset, date, {column}::DOUBLE AS x, row_number() OVER (PARTITION BY asset ORDER BY date) AS k FROM {source}),
{name} AS (SELECT asset, date, k, x AS m, 1.0::DOUBLE AS w FROM {name}_rows WHERE k = 1 UNION ALL
SELECT n.asset, n.date, n.k, CASE WHEN r.m IS NULL THEN n.x WHEN n.x IS NULL THEN r.m ELSE ({kept} * r.m + {a} * n.x) / ({kept} + {a}) END, CASE WHEN r.m IS NULL OR n.x IS NOT NULL THEN 1.0::DOUBLE ELSE {kept} END
FROM {name} r JOIN {name}_rows n ON n.asset = r.asset AND n.k = r.k + 1)"""


def recursive(names: str, body: str) -> str:
    return sql(names, body).replace("WITH", "WITH RECURSIVE", 1)


@query(recursive("market_day", f"WITH one AS (SELECT 'market' AS asset, date, level FROM market_day), {ewm_sql('e', 'one', 'level', 12)} SELECT date, round(m, 6) AS ewm FROM e"))
def ewm_series(spark, folder):
    return rounded(S.ewm(V.market_day(spark, folder).withColumn("asset", F.lit("market")), 12, "level").select("date", "ewm"))


@query(
    recursive(
        "dense_brand",
        f"""WITH d AS (SELECT asset, date, close, close - lag(close) OVER (PARTITION BY asset ORDER BY date) AS d FROM dense_brand),
t AS (SELECT asset, date, close * CASE WHEN count(d) OVER n >= 2 THEN stddev_samp(abs(d)) OVER n END / nullif(close, 0) * sign(d) AS t FROM d WINDOW n AS (PARTITION BY asset ORDER BY date ROWS 11 PRECEDING)),
star AS (SELECT asset, date, CASE WHEN count(t) OVER n >= 6 THEN sum(t) OVER n / 12 END AS x FROM t WINDOW n AS (PARTITION BY asset ORDER BY date ROWS 11 PRECEDING)),
{ewm_sql('fast', 'star', 'x', 12)}, {ewm_sql('slow', 'star', 'x', 26)}, line AS (SELECT asset, date, f.m - s.m AS x FROM fast f JOIN slow s USING (asset, date)), {ewm_sql('mean', 'line', 'x', 9)}
SELECT asset, date, round(l.x - 0.9::DOUBLE * a.m, 6) + 0.0::DOUBLE AS score FROM line l JOIN mean a USING (asset, date)""",
    )
)
def macd_score(spark, folder):
    return rounded(S.macd(brands(spark, folder), 12))


@query(sql("dense_brand", "SELECT asset, date, CASE WHEN close IS NOT NULL THEN (('0x' || substr(md5(asset || '|' || date::VARCHAR || '|0'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE END AS score FROM dense_brand"))
def random_signal(spark, folder):
    return S.random_signal(brands(spark, folder))


@query(sql("market_day", "SELECT date, CASE WHEN month(date) >= 11 OR month(date) <= 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS position FROM market_day"))
def sell_in_may(spark, folder):
    return S.sell_in_may(V.market_day(spark, folder)).select("date", "position")


@query(
    sql(
        "market_day",
        """SELECT date, CASE WHEN count(*) OVER f = 50 AND count(*) OVER s = 200 AND avg(level) OVER f > avg(level) OVER s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS position FROM market_day
WINDOW f AS (ORDER BY date ROWS 49 PRECEDING), s AS (ORDER BY date ROWS 199 PRECEDING)""",
    )
)
def ma_cross(spark, folder):
    return S.average_cross()(V.market_day(spark, folder)).select("date", "position")


@query(sql("filings", "SELECT * EXCLUDE (r) FROM (SELECT filing_id, ticker, fiscal_date, filing_date, round(gross_profit, 6) AS gross_profit, total_assets, coalesce(filing_date, fiscal_date + 45) AS visible, row_number() OVER (PARTITION BY ticker ORDER BY coalesce(filing_date, fiscal_date + 45) DESC, fiscal_date DESC, filing_id DESC) AS r FROM filings WHERE coalesce(filing_date, fiscal_date + 45) <= DATE '1998-06-30') WHERE r = 1"))
def asof_filing(spark, folder):
    return rounded(P.as_of(V.filings(spark, folder), "1998-06-30"), "gross_profit")


_ASOF = """WITH d AS (SELECT t.ticker, m.date FROM (SELECT DISTINCT ticker FROM filings) t CROSS JOIN (SELECT DISTINCT last_day(fiscal_date) AS date FROM filings WHERE month(fiscal_date) IN (6, 12)) m),
v AS (SELECT *, coalesce(filing_date, fiscal_date + 45) AS visible FROM filings),
r AS (SELECT d.ticker, d.date, v.fiscal_date, v.filing_id, v.gross_profit, v.total_assets, row_number() OVER (PARTITION BY d.ticker, d.date ORDER BY visible DESC, v.fiscal_date DESC, filing_id DESC) AS k FROM d LEFT JOIN v ON v.ticker = d.ticker AND visible {} d.date)"""


def _asof(spark: SparkSession, folder: str, strict: bool) -> DataFrame:
    f = V.filings(spark, folder).withColumn("visible", P.visible_from())
    months = f.filter(F.month("fiscal_date").isin(6, 12)).agg(F.collect_set(F.last_day("fiscal_date")).alias("dates"))  # one row
    dates = f.select("ticker").distinct().crossJoin(F.broadcast(months)).select("ticker", F.explode("dates").alias("date"))
    return P.as_of_join(dates, f.select("ticker", "visible", "fiscal_date", "filing_id", "gross_profit", "total_assets"), "ticker", "date", "visible", ["fiscal_date", "filing_id"], strict)


@query(sql("filings", _ASOF.format("<=") + " SELECT ticker, date, fiscal_date, filing_id FROM r WHERE k = 1"))
def asof_monthend(spark, folder):
    return _asof(spark, folder, False).select("ticker", "date", "fiscal_date", "filing_id")


@query(sql("filings", _ASOF.format("<") + " SELECT ticker, date, fiscal_date, filing_id FROM r WHERE k = 1"))
def asof_strict(spark, folder):
    return _asof(spark, folder, True).select("ticker", "date", "fiscal_date", "filing_id")


@query(
    sql(
        "filings",
        _ASOF.format("<=")
        + """, g AS (SELECT ticker, date, gross_profit / total_assets AS gpa FROM r WHERE k = 1 AND total_assets > 0 AND gross_profit IS NOT NULL),
p AS (SELECT ticker, date, gpa, (rank() OVER (PARTITION BY date ORDER BY gpa) + (count(*) OVER (PARTITION BY date, gpa) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date) AS pct, count(*) OVER (PARTITION BY date) AS n FROM g)
SELECT ticker, date, round(gpa, 6) AS gpa, round(pct, 9) AS pct, CASE WHEN pct > 2.0::DOUBLE / 3 THEN 'long' WHEN pct <= 1.0::DOUBLE / 3 THEN 'short' ELSE 'flat' END AS side FROM p WHERE n >= 6""",
    )
)
def gross_profitability(spark, folder):
    """Point-in-time profitability with average percent ranks in each month, cut into terciles."""
    g = _asof(spark, folder, False).filter("total_assets > 0 AND gross_profit IS NOT NULL").select("ticker", "date", (F.col("gross_profit") / F.col("total_assets")).alias("gpa"))
    by = Window.partitionBy("date")
    ties = F.count(F.lit(1)).over(Window.partitionBy("date", "gpa"))
    g = g.withColumn("pct", (F.rank().over(by.orderBy("gpa")) + (ties - 1) / 2) / F.count(F.lit(1)).over(by)).withColumn("n", F.count(F.lit(1)).over(by)).filter("n >= 6")
    side = F.when(F.col("pct") > 2 / 3, "long").when(F.col("pct") <= 1 / 3, "short").otherwise("flat")
    return rounded(rounded(g.select("ticker", "date", "gpa", "pct", side.alias("side")), "gpa"), "pct", digits=9)


@query(sql("filings", "SELECT ticker, count(*) AS n, min(fiscal_date) AS first_fiscal, max(fiscal_date) AS last_fiscal, bool_or(filing_date IS NOT NULL) AS has_filing_date FROM filings GROUP BY 1"))
def filing_coverage(spark, folder):
    return V.filings(spark, folder).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("fiscal_date").alias("first_fiscal"), F.max("fiscal_date").alias("last_fiscal"), F.max(F.col("filing_date").isNotNull()).alias("has_filing_date"))


@query(
    sql(
        "filings",
        """WITH i AS (SELECT ticker, fiscal_date, sum(gross_profit) AS gross_profit FROM filings GROUP BY ALL), b AS (SELECT ticker, fiscal_date, max(total_assets) AS total_assets FROM filings WHERE total_assets > 0 GROUP BY ALL)
SELECT ticker, fiscal_date, round(gross_profit, 6) AS gross_profit, total_assets FROM i JOIN b USING (ticker, fiscal_date)""",
    )
)
def statements_join(spark, folder):
    """Income joined with balance sheet on (ticker, fiscal date), incomplete rows dropped."""
    f = V.filings(spark, folder)
    income = f.groupBy("ticker", "fiscal_date").agg(F.sum("gross_profit").alias("gross_profit"))
    balance = f.filter("total_assets > 0").groupBy("ticker", "fiscal_date").agg(F.max("total_assets").alias("total_assets"))
    return rounded(income.join(balance, ["ticker", "fiscal_date"]).dropna(subset=["gross_profit", "total_assets"]), "gross_profit")


@query(
    sql(
        "market_returns",
        """WITH f AS (SELECT date, ret > 0 AS up, row_number() OVER (ORDER BY date) AS i FROM market_returns),
g AS (SELECT date, i - row_number() OVER (ORDER BY date) AS k FROM f WHERE up)
SELECT min(date) AS start, max(date) AS stop, count(*) AS rows FROM g GROUP BY k""",
    )
)
def up_runs(spark, folder):
    """Gaps and islands: stretches of rising days."""
    m = V.market_day(spark, folder).withColumn("asset", F.lit(1)).withColumnRenamed("level", "close")
    return P.runs(P.returns(m).select("date", (F.col("ret") > 0).alias("up")), "up", "date")
