"""Queries over regressions from running moments, bootstrap intervals of any statistic, and many confidence sets at once."""

from __future__ import annotations

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import moments as M
from quillon.operators import resamples as R
from quillon.plans.estimators import PREDICTORS, WINDOW, frame
from quillon.plans.panels import rounded
from quillon.plans.registry import query
from quillon.plans.statistics import bootstrap_sql, sharpe_sql
from quillon.sources import views as V
from quillon.sources.views import sql


def determinant(rows: list[str], columns: list[str], swap: str | None, y: str) -> str:
    """Of the matrix of columns v_<row>_<column>, with the covariances with y in place of one column, as SQL."""
    n, terms = len(rows), []
    for order in itertools.permutations(range(n)):
        sign = "-" if sum(order[i] > order[j] for i in range(n) for j in range(i + 1, n)) % 2 else "+"
        terms.append(sign + " * ".join(f"v_{rows[i]}_{y if columns[j] == swap else columns[j]}" for i, j in enumerate(order)))
    return f"({' '.join(terms)})"


def pair_forecast(a: str, b: str, y: str) -> str:
    """Normal equations of two predictors over window w, as SQL."""
    det = f"(var_pop({a}) OVER w * var_pop({b}) OVER w - covar_pop({a}, {b}) OVER w * covar_pop({a}, {b}) OVER w)"
    one = f"(covar_pop({y}, {a}) OVER w * var_pop({b}) OVER w - covar_pop({y}, {b}) OVER w * covar_pop({a}, {b}) OVER w) / {det}"
    two = f"(covar_pop({y}, {b}) OVER w * var_pop({a}) OVER w - covar_pop({y}, {a}) OVER w * covar_pop({a}, {b}) OVER w) / {det}"
    return f"avg({y}) OVER w + {one} * ({a} - avg({a}) OVER w) + {two} * ({b} - avg({b}) OVER w)"


def single_forecasts(y: str) -> str:
    """Sum of the forecasts of the regressions on one predictor, as SQL."""
    return " + ".join(f"regr_intercept({y}, {c}) OVER w + regr_slope({y}, {c}) OVER w * {c}" for c in PREDICTORS)


_PAIRS = " + ".join(pair_forecast(a, b, "y") for a, b in itertools.combinations(PREDICTORS, 2))


@query(
    sql(
        "macro_month",
        f"""WITH f AS (SELECT *, mkt - rf AS y FROM macro_month),
g AS (SELECT date, y, count(*) OVER w AS n, avg(y) OVER w AS m0, ({single_forecasts('y')}) / {len(PREDICTORS)} AS m1, ({_PAIRS}) / {len(PREDICTORS) * (len(PREDICTORS) - 1) // 2} AS m2 FROM f WINDOW w AS (ORDER BY date ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING))
SELECT date, model, round(y, 6) + 0.0::DOUBLE AS actual, round(forecast, 6) + 0.0::DOUBLE AS forecast FROM (
    SELECT date, y, n, 'mean' AS model, m0 AS forecast FROM g UNION ALL SELECT date, y, n, 'subsets 1', m1 FROM g UNION ALL SELECT date, y, n, 'subsets 2', m2 FROM g) WHERE n = {WINDOW}""",
    )
)
def subset_forecasts(spark, folder):
    """Mean forecasts of all regressions on one and on two predictors, from the moments of rolling windows."""
    sums = M.running(frame(spark, folder), PREDICTORS, WINDOW)
    return rounded(M.forecasts(sums, len(PREDICTORS), [("mean", "mean", {}), ("subsets 1", "subsets", {"k": 1}), ("subsets 2", "subsets", {"k": 2})]))


EVENT_WINDOW = 60


def event_frame(spark, folder):
    """Events with two numeric columns to explain their value: the hour, and a field of their properties."""
    e = V.table(spark, folder, "events")
    return e.select("event_id", "event_type", F.hour("ts").cast("double").alias("hour"), F.get_json_object("props", "$.k").try_cast("double").alias("k"), "value")


_EVENTS = "f AS (SELECT event_id, event_type, date_part('hour', ts)::DOUBLE AS h, try_cast(props->>'$.k' AS DOUBLE) AS k, value AS y FROM events)"


@query(
    f"""WITH {_EVENTS},
g AS (SELECT event_id, event_type, h, k, y, count(y) OVER w AS n, avg(h) OVER w AS mh, avg(k) OVER w AS mk, avg(y) OVER w AS my, var_pop(h) OVER w AS vh, var_pop(k) OVER w AS vk, var_pop(y) OVER w AS vy,
    covar_pop(h, k) OVER w AS hk, covar_pop(y, h) OVER w AS yh, covar_pop(y, k) OVER w AS yk FROM f WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN {EVENT_WINDOW} PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, vh * vk - hk * hk AS det, (yh * vk - yk * hk) / (vh * vk - hk * hk) AS b1, (yk * vh - yh * hk) / (vh * vk - hk * hk) AS b2 FROM g WHERE n = {EVENT_WINDOW}),
s AS (SELECT *, sqrt(n * (vy - b1 * yh - b2 * yk) / (n - 3)) AS sigma FROM b)
SELECT event_type, event_id, n, round(my - b1 * mh - b2 * mk, 5) + 0.0::DOUBLE AS intercept, round(b1, 5) + 0.0::DOUBLE AS slope_hour, round(b2, 5) + 0.0::DOUBLE AS slope_k, round(b1 / (sigma * sqrt(vk / (n * det))), 5) + 0.0::DOUBLE AS t_hour,
    round(b2 / (sigma * sqrt(vh / (n * det))), 5) + 0.0::DOUBLE AS t_k, round((b1 * yh + b2 * yk) / vy, 5) + 0.0::DOUBLE AS r2, round(sigma, 5) + 0.0::DOUBLE AS sigma, round(my + b1 * (h - mh) + b2 * (k - mk), 5) + 0.0::DOUBLE AS forecast FROM s"""
)
def event_regressions(spark, folder):
    """Rolling regressions with t values for each type of event, all types side by side."""
    sums = M.running(event_frame(spark, folder), ["hour", "k"], EVENT_WINDOW, "value", by=["event_type"], order="event_id", own=True, pairwise=True)
    r = M.regressions(sums, 2, ["event_type", "event_id"], pairwise=True)
    item = lambda c, k: F.get(c, F.lit(k))
    columns = {"slope_hour": item("slopes", 0), "slope_k": item("slopes", 1), "t_hour": item("t_values", 0), "t_k": item("t_values", 1)}
    return rounded(r.select("event_type", "event_id", "n", "intercept", *[c.alias(n) for n, c in columns.items()], "r2", "sigma", "forecast"), digits=5)


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS span, event_id, n, round(b, 6) + 0.0::DOUBLE AS slope, round(a + b * k, 6) + 0.0::DOUBLE AS forecast FROM (WITH {_EVENTS} SELECT event_id, k, count(y) OVER w AS n, regr_slope(y, k) OVER w AS b, regr_intercept(y, k) OVER w AS a FROM f WINDOW w AS (ORDER BY event_id ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)) WHERE n >= 200"
        for name, rows in (("rolling", 200), ("expanding", "UNBOUNDED"))
    )
)
def event_stream_regression(spark, folder):
    """One long series: rolling and expanding regressions over all events in order, summed chunk by chunk."""
    out = []
    for name, expanding in (("rolling", False), ("expanding", True)):
        sums = M.running(event_frame(spark, folder), ["k"], 200, "value", expanding, order="event_id", chunk=F.floor(F.col("event_id") / 1000))
        r = M.regressions(sums, 1, ["event_id"])
        out.append(r.select(F.lit(name).alias("span"), "event_id", "n", F.get("slopes", F.lit(0)).alias("slope"), "forecast"))
    return rounded(out[0].unionByName(out[1]))


DRAWN = 300


@query(
    sql(
        "dense_brand macro_month",
        f"""WITH r AS (SELECT asset, date, close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1 AS a FROM dense_brand), p AS (SELECT asset, r.date, a, mkt AS b, lag(mkt) OVER (PARTITION BY asset ORDER BY r.date) AS c FROM r JOIN macro_month m ON m.date = r.date WHERE a IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS spot, count(*) OVER (PARTITION BY asset) AS n FROM p WHERE c IS NOT NULL), {bootstrap_sql("s", DRAWN, 6, 7)},
g AS (SELECT asset, draw, {sharpe_sql("a", 12)} - ({sharpe_sql("b", 12)}) AS sharpe_gap, exp(sum(w * ln(1 + a)) * 12 / sum(w)) - 1 AS growth, 100 * (1 - sum(w * (a - b) * (a - b)) / sum(w * (a - c) * (a - c))) AS r2 FROM s JOIN weights USING (n, spot) GROUP BY asset, draw),
l AS (SELECT asset, draw, pos, sum(ln(1 + a)) OVER (PARTITION BY asset, draw ORDER BY pos ROWS UNBOUNDED PRECEDING) AS x FROM s JOIN positions USING (n, spot)),
d AS (SELECT asset, draw, min(exp(x - peak) - 1) AS drawdown FROM (SELECT *, greatest(max(x) OVER (PARTITION BY asset, draw ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS peak FROM l) GROUP BY asset, draw),
u AS (SELECT asset, 'sharpe_gap' AS statistic, sharpe_gap AS v FROM g UNION ALL SELECT asset, 'growth', growth FROM g UNION ALL SELECT asset, 'r2', r2 FROM g UNION ALL SELECT asset, 'drawdown', drawdown FROM d)
SELECT asset, statistic, round(quantile_cont(v, 0.025), 6) + 0.0::DOUBLE AS lo, round(quantile_cont(v, 0.975), 6) + 0.0::DOUBLE AS hi FROM u GROUP BY asset, statistic""",
    )
)
def bootstrap_intervals(spark, folder):
    """Sharpe gap, growth, R2 and drawdown of each brand against the market, all from one table of draws."""
    from quillon.operators import panel as P

    ret = P.returns(P.dense(V.brand_month(spark, folder))).filter("ret is not null").withColumnRenamed("ret", "a")
    market = V.macro_month(spark, folder).select("date", F.col("mkt").alias("b"))
    rows = ret.join(market, "date").withColumn("c", F.lag("b").over(Window.partitionBy("asset").orderBy("date"))).filter("c is not null")
    series = R.numbered(rows, ["asset"])
    places = R.positions(series.select("n"), DRAWN, 6)
    statistics = {
        "sharpe_gap": lambda w: R.weighted_sharpe("a", w, 12) - R.weighted_sharpe("b", w, 12),
        "growth": lambda w: R.weighted_growth("a", w, 12),
        "r2": lambda w: R.weighted_r2("a", "b", "c", w),
    }
    aggregates = R.intervals(R.drawn(series, R.weights(places), statistics, ["asset"]), list(statistics), ["asset"])
    paths = R.intervals(R.drawn_drawdowns(series, places, "a", ["asset"]), ["drawdown"], ["asset"])
    return rounded(aggregates.unionByName(paths))


#: horizons of the mean forecasts that each brand's confidence set compares, and no forecast at all
HORIZONS = (3, 6, 12)
_MODELS = [f"mean {h:02d}" for h in HORIZONS] + ["zero"]
_STEP = """
t{k} AS (SELECT asset, model, max(e) AS e, sqrt(greatest(var_samp(x), 1e-18)) AS s FROM (SELECT asset, model, draw, mse, mse - avg(mse) OVER (PARTITION BY asset, draw) AS e, d - avg(d) OVER (PARTITION BY asset, draw) AS x FROM d{k}) GROUP BY asset, model),
o{k} AS (SELECT asset, arg_max(model, e / s) AS leaves, max(e / s) AS top FROM t{k} GROUP BY asset),
p{k} AS (SELECT asset, avg((best >= top)::INTEGER) AS p FROM (SELECT x.asset, x.draw, max((x.d - x.all_d) / s) AS best FROM (SELECT *, avg(d) OVER (PARTITION BY asset, draw) AS all_d FROM d{k}) x JOIN t{k} USING (asset, model) GROUP BY x.asset, x.draw) JOIN o{k} USING (asset) GROUP BY asset),
d{next} AS (SELECT d.* FROM d{k} d JOIN o{k} o USING (asset) WHERE model <> leaves)"""


@query(
    sql(
        "dense_brand",
        f"""WITH r AS (SELECT asset, date, close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1 AS y FROM dense_brand), k AS (SELECT * FROM r WHERE y IS NOT NULL),
f AS (SELECT asset, date, y, {", ".join(f"CASE WHEN count(*) OVER w{h} = {h} THEN avg(y) OVER w{h} END AS f{h}" for h in HORIZONS)} FROM k WINDOW {", ".join(f"w{h} AS (PARTITION BY asset ORDER BY date ROWS BETWEEN {h} PRECEDING AND 1 PRECEDING)" for h in HORIZONS)}),
s AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS spot, count(*) OVER (PARTITION BY asset) AS n FROM f WHERE f{max(HORIZONS)} IS NOT NULL),
l AS ({" UNION ALL ".join(f"SELECT asset, date, n, spot, '{m}' AS model, (y - {f'f{h}' if h else '0'}) * (y - {f'f{h}' if h else '0'}) AS loss FROM s" for m, h in zip(_MODELS, (*HORIZONS, 0), strict=True))}), {bootstrap_sql("s", 1000, 2, 11)},
means AS (SELECT asset, model, avg(loss) AS mse FROM l GROUP BY asset, model),
d0 AS MATERIALIZED (SELECT asset, model, draw, mse, sum(w * loss) / sum(w) - mse AS d FROM l JOIN weights USING (n, spot) JOIN means USING (asset, model) GROUP BY asset, model, draw, mse),{",".join(_STEP.format(k=k, next=k + 1) for k in range(len(_MODELS) - 1))},
steps AS ({" UNION ALL ".join(f"SELECT asset, {k} AS k, leaves AS model, p FROM o{k} JOIN p{k} USING (asset)" for k in range(len(_MODELS) - 1))} UNION ALL SELECT DISTINCT asset, {len(_MODELS)}, model, 1.0::DOUBLE FROM d{len(_MODELS) - 1})
SELECT asset, model, round(mse, 8) + 0.0::DOUBLE AS mse, round(max(p) OVER (PARTITION BY asset ORDER BY k), 6) + 0.0::DOUBLE AS p_value FROM steps JOIN means USING (asset, model)""",
    )
)
def confidence_sets_by_brand(spark, folder):
    """A confidence set of mean forecasts for each brand, all eliminations from two aggregates over the draws."""
    from quillon.operators import panel as P

    ret = P.returns(P.dense(V.brand_month(spark, folder))).filter("ret is not null").withColumn("zero", F.lit(0.0))
    parts = [M.running(ret, ["zero"], h, "ret", by=["asset"]).select("asset", "date", "actual", F.lit(m).alias("model"), M.mean_forecast(1).alias("forecast")) for h, m in zip(HORIZONS, _MODELS, strict=False)]
    none = ret.select("asset", "date", F.col("ret").alias("actual"), F.lit("zero").alias("model"), F.lit(0.0).alias("forecast"))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(none)
    error = F.col("actual") - F.col("forecast")
    sets = R.confidence_sets(rows.select("asset", "model", "date", (error * error).alias("loss")), ["asset"], 1000)
    return rounded(rounded(sets, "mse", digits=8), "p_value")
