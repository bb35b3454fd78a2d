"""Queries over queued published signals."""

from __future__ import annotations

from quillon.operators import panel as P
from quillon.operators import published as S
from quillon.plans.panels import rounded, suppliers
from quillon.plans.registry import query
from quillon.plans.regressions import determinant
from quillon.plans.shared import staged
from quillon.sources import views as V
from quillon.sources.views import sql

ROWS = """WITH v AS (SELECT asset, date, close, close * volume AS value, close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1 AS ret FROM dense_supplier), r AS (SELECT *, abs(ret) / nullif(value, 0) AS impact FROM v)"""


@query(
    sql(
        "dense_supplier",
        ROWS
        + """, s AS (SELECT *, lag(close, 6) OVER w / lag(close, 12) OVER w - 1 AS intermediate, 1 - lag(close, 13) OVER w / lag(close, 60) OVER w AS long_reversal, lag(ret, 23) OVER w + lag(ret, 35) OVER w + lag(ret, 47) OVER w + lag(ret, 59) OVER w AS four,
CASE WHEN count(ret) OVER o = 48 THEN sum(ret) OVER o END AS others, CASE WHEN count(close) OVER y = 12 THEN close / max(close) OVER y END AS high, CASE WHEN count(impact) OVER y = 12 THEN avg(impact) OVER y END AS illiquid,
-ln(lag(value, 2) OVER w) AS quiet, CASE WHEN count(ret) OVER b = 12 THEN ret / nullif(var_samp(ret) OVER b, 0) END AS managed FROM r
WINDOW w AS (PARTITION BY asset ORDER BY date), o AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 59 PRECEDING AND 12 PRECEDING), y AS (PARTITION BY asset ORDER BY date ROWS 11 PRECEDING), b AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT asset, date, round(intermediate, 6) + 0.0::DOUBLE AS intermediate, round(long_reversal, 6) + 0.0::DOUBLE AS long_reversal, round(four / 4, 6) + 0.0::DOUBLE AS season, round(-(others - four) / 44, 6) + 0.0::DOUBLE AS off_season, round(-ln(close), 6) AS cheap,
round(high, 6) AS high, round(illiquid * 1e6::DOUBLE, 6) AS illiquid, round(quiet, 6) AS quiet, round(managed, 5) + 0.0::DOUBLE AS managed FROM s""",
    )
)
def queued_signals(spark, folder):
    from pyspark.sql import functions as F

    scores = S.by_history(suppliers(spark, folder)).withColumn("illiquid", F.col("illiquid") * 1e6)
    return rounded(rounded(scores, *[c for c in scores.columns if c not in ("asset", "date", "managed")]), "managed", digits=5)


Z = "({0} - avg({0}) OVER d) / nullif(stddev_samp({0}) OVER d, 0)"


@query(sql("dense_supplier", f"WITH m AS (SELECT asset, date, close / lag(close, 6) OVER w - 1 AS near, lag(close, 13) OVER w / lag(close, 60) OVER w - 1 AS far FROM dense_supplier WINDOW w AS (PARTITION BY asset ORDER BY date)) SELECT asset, date, round({Z.format('near')} - {Z.format('far')}, 6) + 0.0::DOUBLE AS score FROM m WINDOW d AS (PARTITION BY date)"))
def momentum_and_reversal(spark, folder):
    return rounded(S.momentum_and_reversal(suppliers(spark, folder)))


@query(sql("dense_supplier sector_map", "WITH m AS (SELECT asset, date, close / lag(close, 6) OVER (PARTITION BY asset ORDER BY date) - 1 AS near FROM dense_supplier) SELECT asset, date, round(avg(near) OVER (PARTITION BY sector, date), 6) + 0.0::DOUBLE AS score FROM m JOIN sector_map USING (asset)"))
def industry_momentum(spark, folder):
    return rounded(S.industry_momentum(suppliers(spark, folder), V.sector_map(spark, folder)))


@query(
    sql(
        "returns",
        """WITH k AS (SELECT date, avg(ret) AS m FROM returns GROUP BY date), b AS (SELECT asset, date, CASE WHEN m IS NOT NULL THEN ret END AS r, CASE WHEN ret IS NOT NULL THEN m END AS m FROM returns JOIN k USING (date)),
a AS (SELECT asset, date, count(r) OVER w AS n, avg(r) OVER w AS r1, avg(m) OVER w AS m1, avg(r * r) OVER w AS r2, avg(m * m) OVER w AS m2, avg(r * m) OVER w AS rm, avg(r * m * m) OVER w AS rmm FROM b WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 35 PRECEDING))
SELECT asset, date, round(CASE WHEN n = 36 THEN -(rmm - r1 * m2 - 2 * m1 * rm + 2 * r1 * m1 * m1) / (sqrt(r2 - r1 * r1) * (m2 - m1 * m1)) END, 5) + 0.0::DOUBLE AS score FROM a""",
    )
)
def coskewness(spark, folder):
    return rounded(S.coskewness(P.returns(suppliers(spark, folder))), digits=5)


_STATES = """v AS (SELECT r.asset, r.date, ret, close * volume AS value FROM returns r JOIN dense_supplier USING (asset, date) WHERE ret IS NOT NULL), q AS (SELECT date, quantile_cont(ret, 0.05) AS edge FROM v GROUP BY date),
dt AS (SELECT date, avg(ret) AS m, avg(abs(ret) / nullif(value, 0)) AS impact, avg(CASE WHEN ret < edge AND edge < 0 THEN ln(ret / edge) END) AS tail FROM v JOIN q USING (date) GROUP BY date),
dv AS (SELECT *, CASE WHEN count(m) OVER y = 12 THEN stddev_samp(m) OVER y END AS deviation FROM dt WINDOW y AS (ORDER BY date ROWS 11 PRECEDING)),
st AS (SELECT date, m, lag(m, 1) OVER w AS m1, lag(m, 2) OVER w AS m2, lag(m, 3) OVER w AS m3, lag(m, 4) OVER w AS m4, ln(impact) - lag(ln(impact)) OVER w AS liquidity, deviation - lag(deviation) OVER w AS volatility, lag(tail) OVER w AS tail FROM dv WINDOW w AS (ORDER BY date)),
f AS (SELECT returns.asset, returns.date, ret AS y, st.* EXCLUDE (date) FROM returns JOIN st ON st.date = returns.date)"""


def _beside(name: str) -> str:
    """The slope beside the market's over the 36 rows before, as SQL."""
    c = lambda a, b: f"covar_pop({a}, {b}) OVER w"
    return f"CASE WHEN count(y + m + {name}) OVER w = 36 THEN ({c('y', name)} * {c('m', 'm')} - {c('y', 'm')} * {c('m', name)}) / ({c('m', 'm')} * {c(name, name)} - {c('m', name)} * {c('m', name)}) END"


_LAGS = ["m", "m1", "m2", "m3", "m4"]


@query(
    sql(
        "dense_supplier returns",
        f"""WITH {_STATES}, c AS (SELECT asset, date, count(y + m) OVER w AS n1, count(y + m4) OVER w AS n4, {", ".join(f"covar_pop({a}, {b}) OVER w AS v_{a}_{b}" for a in _LAGS for b in [*_LAGS, "y"])}, var_pop(y) OVER w AS vy, {_beside("liquidity")} AS liquidity, -{_beside("volatility")} AS volatility, {_beside("tail")} AS tail
FROM f WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING))
SELECT asset, date, round(1 - (v_m_y * v_m_y / v_m_m / vy) / (({" + ".join(f"{determinant(_LAGS, _LAGS, x, 'y')} / {determinant(_LAGS, _LAGS, None, 'y')} * v_{x}_y" for x in _LAGS)}) / vy), 4) + 0.0::DOUBLE AS delay,
    round(liquidity, 4) + 0.0::DOUBLE AS liquidity, round(volatility, 4) + 0.0::DOUBLE AS volatility, round(tail, 4) + 0.0::DOUBLE AS tail FROM c WHERE n1 = 36 AND n4 = 36""",
    )
)
def market_exposures(spark, folder):
    """Price delay, and betas to liquidity, volatility and tail risk, of returns that are staged once."""
    rows = staged(S.traded(suppliers(spark, folder)), "traded")
    return rounded(S.exposures(rows, staged(S.market_states(rows), "states")), digits=4)


@query(
    sql(
        "dense_supplier sector_map",
        """WITH r AS (SELECT asset, date, close, close * volume AS value, close / lag(close, 6) OVER w - 1 AS six, close / lag(close, 12) OVER w - 1 AS twelve, close / lag(close) OVER w - 1 AS ret, count(close) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS age FROM dense_supplier WINDOW w AS (PARTITION BY asset ORDER BY date)),
u AS (SELECT *, CASE WHEN count(ret) OVER e = 11 THEN avg(ret) OVER e END AS unseasonal FROM r WINDOW e AS (PARTITION BY asset ORDER BY date ROWS 10 PRECEDING)),
t AS (SELECT u.*, sector, 3 * row_number() OVER (PARTITION BY date ORDER BY value DESC, asset) <= count(*) OVER (PARTITION BY date) AS top, 3 * row_number() OVER (PARTITION BY sector, date ORDER BY value DESC, asset) <= count(*) OVER (PARTITION BY sector, date) AS big, quantile_cont(age, 0.5) OVER (PARTITION BY date) AS middle FROM u JOIN sector_map USING (asset) WHERE value IS NOT NULL)
SELECT asset, date, round(CASE WHEN top THEN six END, 6) + 0.0::DOUBLE AS busy, round(CASE WHEN age <= middle THEN twelve END, 6) + 0.0::DOUBLE AS young, round(CASE WHEN NOT big THEN avg(ret) FILTER (big) OVER (PARTITION BY sector, date) END, 6) + 0.0::DOUBLE AS leaders, round(unseasonal, 6) + 0.0::DOUBLE AS unseasonal FROM t""",
    )
)
def conditional_momentum(spark, folder):
    """Momentum of busy and of young assets, of a sector's leaders, and without the season."""
    return rounded(S.conditional_momentum(suppliers(spark, folder), V.sector_map(spark, folder)))
