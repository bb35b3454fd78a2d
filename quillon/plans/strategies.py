"""Queries over tables of switching strategies by model, subset size and period."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from quillon.operators import moments as M
from quillon.operators import strategy_tables as T
from quillon.plans.estimators import PREDICTORS, WINDOW, frame
from quillon.plans.panels import rounded
from quillon.plans.registry import query
from quillon.plans.regressions import determinant, pair_forecast, single_forecasts
from quillon.sources.views import sql

KS = (1, 2)
SPANS = (("first crisis", "1998-06-01", "1999-03-31"), ("second crisis", "2000-01-01", "2001-06-30"))
MOMENTUM = (3, 6, 12)
BENCH = "Historical average"
ROWS = ("Buy and hold", *(f"Momentum {n}-month" for n in MOMENTUM), "Linear model", "CSR approach", "GARCH-M model", "MS model")


def forecasts(spark, folder):
    """(model, k, date, forecast) of all models that have a closed form, and their market."""
    market = frame(spark, folder)
    p = len(PREDICTORS)
    kinds = [("Linear model", "linear", {}), (BENCH, "mean", {}), *[(f"CSR approach {k}", "subsets", {"k": k}) for k in KS]]
    rows = M.forecasts(M.running(market, PREDICTORS, WINDOW), p, kinds).select("model", "date", "forecast")
    csr = rows.filter("model like 'CSR%'").select(F.lit("CSR approach").alias("model"), "date", "forecast", F.substring_index("model", " ", -1).cast("int").alias("k"))
    start = rows.agg(F.min("date").alias("start"))
    alone = rows.filter("model not like 'CSR%'").unionByName(market.select(F.lit("Buy and hold").alias("model"), "date", F.lit(1.0).alias("forecast"))).unionByName(T.momentum_forecasts(market, MOMENTUM))
    alone = alone.crossJoin(F.broadcast(start)).filter("date >= start").drop("start")  # one row
    return T.repeated(alone, KS).unionByName(csr), market


def strategy_figures(spark, folder):
    f, market = forecasts(spark, folder)
    return T.table(T.paths(f.filter(F.col("model") != BENCH), market, SPANS))


def _linear(names: list[str], y: str) -> str:
    """All predictors at once, by Cramer's rule on covariances over window w, as SQL."""
    values = [f"covar_pop({a}, {b}) OVER w AS v_{a}_{b}" for a in names for b in [*names, y]]
    means = [f"avg({c}) OVER w AS m_{c}" for c in [*names, y]]
    slopes = [f"{determinant(names, names, c, y)} / {determinant(names, names, None, y)} * ({c} - m_{c})" for c in names]
    return f"SELECT date, m_{y} + {' + '.join(slopes)} AS forecast FROM (SELECT date, {', '.join(names)}, {', '.join([*values, *means])} FROM f WINDOW w AS (ORDER BY date ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING))"


_FORECASTS = (
    f"""WITH f AS (SELECT *, mkt - rf AS y FROM macro_month), lin AS ({_linear(PREDICTORS, "y")}),
g AS (SELECT date, mkt, rf, y, count(*) OVER w AS n, avg(y) OVER w AS ha, ({single_forecasts("y")}) / {len(PREDICTORS)} AS csr1, ({" + ".join(pair_forecast(a, b, "y") for a, b in itertools.combinations(PREDICTORS, 2))}) / 6 AS csr2,
    """
    + ", ".join(f"exp(sum(ln(1 + mkt)) OVER (ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)) - 1 AS mom{n}" for n in MOMENTUM)
    + f""" FROM f WINDOW w AS (ORDER BY date ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING)),
o AS (SELECT g.*, lin.forecast AS linear FROM g JOIN lin USING (date) WHERE n = {WINDOW}),
fc AS ("""
    + " UNION ALL ".join(f"SELECT '{m}' AS model, {k} AS k, date, {c} AS forecast FROM o" for k in KS for m, c in [(BENCH, "ha"), ("Buy and hold", "1.0::DOUBLE"), ("Linear model", "linear"), ("CSR approach", f"csr{k}"), *((f"Momentum {n}-month", f"mom{n}") for n in MOMENTUM)])
    + ")"
)
_FIGURES = (
    _FORECASTS
    + ", sp AS (SELECT * FROM (VALUES ('all', NULL::DATE, NULL::DATE), "
    + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in SPANS)
    + f""") AS t(span, first, last)),
p AS (SELECT model, k, span, date, mkt, rf, forecast > 0 AS equity FROM fc JOIN o USING (date), sp WHERE model <> '{BENCH}' AND (first IS NULL OR date BETWEEN first AND last)),
q AS (SELECT *, coalesce(equity <> lag(equity) OVER (PARTITION BY model, k, span ORDER BY date), false) AS switched, CASE WHEN equity THEN mkt ELSE rf END AS ret FROM p),
h AS (SELECT *, exp(sum(ln(1 + ret) + CASE WHEN switched THEN ln(1 - 0.001::DOUBLE) ELSE 0 END) OVER (PARTITION BY model, k, span ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wealth FROM q),
d AS (SELECT *, 1 - wealth / max(wealth) OVER (PARTITION BY model, k, span ORDER BY date ROWS UNBOUNDED PRECEDING) AS fall FROM h),
t AS (SELECT model, k, span, count(*) AS n, arg_max(wealth, date) AS "TW", 1200 * avg(ret) AS "AV", 100 * sqrt(12) * stddev_samp(ret) AS "SD", CASE WHEN stddev_samp(ret) > 0 THEN avg(ret - rf) / stddev_samp(ret) END AS "SR", max(fall) AS "MDD", count(*) FILTER (switched) AS switches FROM d GROUP BY model, k, span)"""
)
_ROUNDED = ", ".join(f'round("{c}", 5) + 0.0::DOUBLE AS "{c}"' for c in T.COLUMNS)


@query(sql("macro_month", f"{_FIGURES} SELECT model, k, span, n, {_ROUNDED}, switches FROM t"))
def strategy_table(spark, folder):
    """Figures of every strategy for each subset size, over the whole sample and in each crisis, where wealth restarts."""
    return rounded(strategy_figures(spark, folder), digits=5)


@query(
    sql(
        "macro_month",
        f"{_FIGURES}, r AS (SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{r}{chr(39)})' for i, r in enumerate(ROWS))}) AS x(place, model)) SELECT place::INTEGER AS place, model, "
        + ", ".join(f'round(max("{c}") FILTER (k = {k}), 5) + 0.0::DOUBLE AS "k{k}_{c}"' for k in KS for c in T.COLUMNS)
        + " FROM r LEFT JOIN (SELECT * FROM t WHERE span = 'all') t USING (model) GROUP BY place, model",
    )
)
def strategy_table_shaped(spark, folder):
    """The printed layout: rows in order, five columns for each k, blanks for what is not computed."""
    return rounded(T.shaped(strategy_figures(spark, folder), ROWS, KS), digits=5)


@query(
    sql(
        "macro_month",
        f"{_FORECASTS}, e AS (SELECT model, k, y - forecast AS e, y - ha AS b FROM fc JOIN o USING (date)) SELECT model, k, count(*) AS n, round(100 * (1 - sum(e * e) / sum(b * b)), 5) + 0.0::DOUBLE AS r2_squared, round(100 * (1 - sum(abs(e)) / sum(abs(b))), 5) + 0.0::DOUBLE AS r2_absolute, round(100 * avg(e * e), 5) AS mse, round(100 * avg(abs(e)), 5) AS mae FROM e WHERE model NOT IN ('Buy and hold') AND model NOT LIKE 'Momentum%' GROUP BY model, k",
    )
)
def loss_table(spark, folder):
    """Out-of-sample R2 and mean losses of each model and subset size, under both losses."""
    f, market = forecasts(spark, folder)
    models = f.filter("model <> 'Buy and hold' and model not like 'Momentum%'")
    return rounded(T.errors(models, market.select("date", F.col("xs").alias("actual")), BENCH), digits=5)
