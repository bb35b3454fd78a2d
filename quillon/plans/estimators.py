"""Queries over rolling estimators, exhibits and signal code."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import exhibits as X
from quillon.operators import models as M
from quillon.operators import panel as P
from quillon.plans.panels import rounded
from quillon.plans.registry import query
from quillon.sources import views as V
from quillon.sources.views import sql

PREDICTORS = ["discount", "tax", "quantity", "urgent"]
WINDOW = 36


def frame(spark, folder):
    return V.macro_month(spark, folder).withColumn("xs", F.col("mkt") - F.col("rf"))


@query(sql("macro_month", f"WITH f AS (SELECT date, mkt - rf AS actual, CASE WHEN count(*) OVER w = {WINDOW} THEN avg(mkt - rf) OVER w END AS forecast FROM macro_month WINDOW w AS (ORDER BY date ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING)) SELECT date, 'mean' AS model, round(actual, 6) + 0.0::DOUBLE AS actual, round(forecast, 6) + 0.0::DOUBLE AS forecast FROM f WHERE forecast IS NOT NULL"))
def rolling_mean_forecast(spark, folder):
    return rounded(M.forecast(frame(spark, folder), PREDICTORS, WINDOW, [("mean", "mean", {})]))


@query(sql("macro_month", f"WITH f AS (SELECT date, mkt - rf AS actual, discount, count(*) OVER w AS n, regr_slope(mkt - rf, discount) OVER w AS b, regr_intercept(mkt - rf, discount) OVER w AS a FROM macro_month WINDOW w AS (ORDER BY date ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING)) SELECT date, 'one' AS model, round(actual, 6) + 0.0::DOUBLE AS actual, round(a + b * discount, 6) + 0.0::DOUBLE AS forecast FROM f WHERE n = {WINDOW}"))
def rolling_linear_forecast(spark, folder):
    return rounded(M.forecast(frame(spark, folder), ["discount"], WINDOW, [("one", "linear", {})]))


MODELS = [("mean", "mean", {}), ("linear", "linear", {}), *[(f"subsets {k}", "subsets", {"k": k}) for k in (1, 2, 3)], ("decomposed", "decomposed", {}), *[(f"copula {c}", "copula", {"family": c}) for c in M.COPULAS]]


@query()
def model_forecasts(spark, folder):
    return rounded(M.forecast(frame(spark, folder), PREDICTORS, WINDOW, MODELS))


@query()
def subset_selection(spark, folder):
    return rounded(M.select_subset(frame(spark, folder), PREDICTORS, WINDOW, 2, "sign").unionByName(M.select_subset(frame(spark, folder), PREDICTORS, WINDOW, 2)))


@query()
def model_confidence_set(spark, folder):
    return rounded(M.confidence_sets(M.forecast(frame(spark, folder), PREDICTORS, WINDOW, MODELS)))


@query("SELECT item_id AS paper, 1 AS page, 'Table ' || item_id AS label, left(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g'), 260) AS caption FROM benchmark")
def captions(spark, folder):
    return captioned(V.table(spark, folder, "benchmark"))


def captioned(b):
    return X.captions(b.select(F.col("item_id").alias("paper"), F.lit(1).alias("page"), F.concat(F.lit("x\nTable "), "item_id", F.lit(": "), "text").alias("text")))


@query("SELECT item_id, item_id % 3 <> 2 AS accepted, CASE WHEN item_id % 3 = 0 THEN 'Journal of Testing' ELSE '' END AS journal, CASE WHEN item_id % 3 = 1 THEN '10.1016/j.jt.2024.' || item_id || '01' ELSE '' END AS doi, CASE WHEN item_id % 3 = 1 THEN 2024 END AS year FROM benchmark")
def acceptance(spark, folder):
    i = F.col("item_id")
    front = F.when(i % 3 == 0, "Accepted for publication in the Journal of Testing. 2024").when(i % 3 == 1, F.concat(F.lit("see doi 10.1016/j.jt.2024."), i, F.lit("01 and more"))).otherwise("a preprint")
    return V.table(spark, folder, "benchmark").select("item_id", X.acceptance(front).alias("a")).select("item_id", "a.*")


CODE = """import pandas as pd
import numpy as np


def signal(prices: pd.DataFrame) -> pd.DataFrame:
    return prices.shift(1) / prices.shift(12) - 1.0 + 0 * prices.diff()
"""


@query(sql("dense_brand", "SELECT asset, date, round(lag(close, 1) OVER w / lag(close, 12) OVER w - 1 + 0 * (close - lag(close) OVER w), 6) + 0.0::DOUBLE AS score FROM dense_brand WINDOW w AS (PARTITION BY asset ORDER BY date)"))
def user_signal(spark, folder):
    """Checked pandas source run for each asset."""
    out = X.apply_signal(P.dense(V.brand_month(spark, folder)), CODE)
    return rounded(P.normalized(out))


_MONTHS = "m AS (SELECT last_day(o_orderdate) AS date, avg(o_totalprice) AS p, count(*) AS n, avg((o_orderstatus = 'F')::INTEGER) AS f, avg(o_shippriority_) AS s FROM (SELECT *, o_custkey % 7 AS o_shippriority_ FROM orders) GROUP BY 1)"


@query(f"""WITH {_MONTHS}, x AS (SELECT date, p / 1e7::DOUBLE AS mkt, f / 100 AS rf, ln(n::DOUBLE) - ln(p) AS dp, s / 10 - f / 5 AS dfy, s / 7 - f / 9 AS tms, f - s / 3 AS dfr, f / 9 AS tbl, s / 3 AS ltr, CASE WHEN month(date) <> 6 THEN n / 1000.0::DOUBLE END AS ntis, s / 50 AS infl FROM m), k AS (SELECT * FROM x WHERE ntis IS NOT NULL),
l AS (SELECT date, mkt, rf, mkt - rf AS xs, {", ".join(f"lag({c}) OVER (ORDER BY date) AS {c}" for c in ("dp", "dfy", "tms", "dfr", "tbl", "ltr", "ntis", "infl"))} FROM k)
SELECT date, {", ".join(f"round({c}, 7) + 0.0::DOUBLE AS {c}" for c in ("mkt", "rf", "xs", "dp", "dfy", "tms", "dfr", "tbl", "ltr", "ntis", "infl"))} FROM l WHERE dp IS NOT NULL""")
def ratio_predictors(spark, folder):
    """Ratio predictors of a monthly table of text, in which every June lacks a value."""
    o = V.table(spark, folder, "orders").groupBy(F.last_day("o_orderdate").alias("date"))
    m = o.agg(F.avg("o_totalprice").alias("p"), F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("f"), F.avg(F.col("o_custkey") % 7).alias("s"))
    p, n, f, s = (F.col(c) for c in "pnfs")
    columns = {"CRSP_SPvw": p / 1e7, "Rfree": f / 100, "D12": n, "Index": p, "BAA": s / 10, "AAA": f / 5, "lty": s / 7, "tbl": f / 9, "corpr": f, "ltr": s / 3, "ntis": F.when(F.month("date") != 6, n / 1000), "infl": s / 50}
    text = m.select(F.date_format("date", "yyyyMM").alias("yyyymm"), *[F.coalesce(c.cast("string"), F.lit("NaN ?")).alias(name) for name, c in columns.items()])
    return rounded(V.ratio_predictors(text), digits=7)
