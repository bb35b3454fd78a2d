"""Queries over claims, forecast tables, studies of rules, ingest counts and column positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import exhibits as X
from quillon.operators import models as M
from quillon.operators import panel as P
from quillon.operators import screens as C
from quillon.operators import signals as S
from quillon.operators import statistics as T
from quillon.operators import studies as Y
from quillon.plans.estimators import PREDICTORS, WINDOW, frame
from quillon.plans.panels import rounded
from quillon.plans.registry import query
from quillon.plans.shared import spread
from quillon.plans.statistics import bootstrap_sql, sharpe_sql
from quillon.sources import views as V
from quillon.sources.views import sql


@query(
    sql(
        "macro_month",
        """WITH c AS (SELECT date, mkt, rf, CASE WHEN count(mkt) OVER w = 11 THEN exp(sum(ln(1 + mkt)) OVER w) - 1 END AS compound FROM macro_month WINDOW w AS (ORDER BY date ROWS 10 PRECEDING)),
p AS (SELECT date, mkt, rf, lag(compound) OVER (ORDER BY date) AS b FROM c), h AS (SELECT *, (b > 0)::INTEGER::DOUBLE AS position FROM p WHERE b IS NOT NULL)
SELECT date, position, round((1 + position * mkt + (1 - position) * rf) * (1 - 0.001::DOUBLE * coalesce(abs(position - lag(position) OVER (ORDER BY date)), 0)) - 1, 6) + 0.0::DOUBLE AS ret FROM h""",
    )
)
def momentum_switch(spark, folder):
    """Hold the market when its last 11 months were up."""
    return rounded(S.momentum_switch(V.macro_month(spark, folder), 11, 0.001))


@query(sql("macro_month", f"WITH f AS (SELECT date, mkt - rf AS actual, count(*) OVER w AS n, avg(mkt - rf) OVER w AS forecast FROM macro_month WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT date, 'mean' AS model, round(actual, 6) + 0.0::DOUBLE AS actual, round(forecast, 6) + 0.0::DOUBLE AS forecast FROM f WHERE n >= {WINDOW}"))
def expanding_mean_forecast(spark, folder):
    return rounded(M.forecast(frame(spark, folder), PREDICTORS, WINDOW, [("mean", "mean", {})], expanding=True))


@query(sql("macro_month", f"WITH f AS (SELECT date, mkt - rf AS actual, discount, count(*) OVER w AS n, regr_slope(mkt - rf, discount) OVER w AS b, regr_intercept(mkt - rf, discount) OVER w AS a FROM macro_month WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT date, 'one' AS model, round(actual, 6) + 0.0::DOUBLE AS actual, round(a + b * discount, 6) + 0.0::DOUBLE AS forecast FROM f WHERE n >= {WINDOW}"))
def expanding_linear_forecast(spark, folder):
    return rounded(M.forecast(frame(spark, folder), ["discount"], WINDOW, [("one", "linear", {})], expanding=True))


#: subset sizes for both ways of forecasting, and the two forms of the decomposed model
SWEEP = [("mean", "mean", {}), *[(f"subsets {k}", "subsets", {"k": k}) for k in range(1, 5)], *[(f"log decomposed {k}", "log decomposed", {"k": k}) for k in range(1, 5)], ("decomposed", "decomposed", {}), ("decomposed poly", "decomposed", {"poly": True})]


@query()
def forecast_sweep(spark, folder):
    """The table of errors over subset sizes and models, by rolling windows."""
    return rounded(T.forecast_table(M.forecast(frame(spark, folder), PREDICTORS, WINDOW, SWEEP)))


_X = PREDICTORS
_CELLS = [("A", "r", c, "r", c) for c in _X] + [("B", "s", "m", "s", "m")] + [("B", n, c, n, c) for n in ("s", "m") for c in _X] + [("C", a, b, a, b) for k, a in enumerate(_X) for b in _X[k + 1 :]]


@query(sql("macro_month", "WITH f AS (SELECT *, mkt - rf AS r, CASE WHEN mkt - rf > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s, abs(mkt - rf) AS m FROM macro_month) " + " UNION ALL ".join(f"SELECT '{p}' AS panel, '{a}' AS row, '{b}' AS col, round(corr({x}, {y}), 6) + 0.0::DOUBLE AS corr FROM f" for p, a, b, x, y in _CELLS)))
def correlation_panels(spark, folder):
    return rounded(T.correlation_panels(frame(spark, folder), "xs", PREDICTORS))


@query("""SELECT 'openap_' || lower(p_name) AS paper_id, 'predictor catalogue, from ' || coalesce(nullif(trim(p_brand), ''), '?') || ' (' || (1990 + p_size)::VARCHAR || ')' AS source, CASE WHEN p_size % 4 <> 0 THEN p_size / 10.0::DOUBLE END AS claimed_t,
round(p_retailprice / 100 * 12 / 1000, 9) AS claimed_annual_return, 1960 + p_size AS sample_start_year, 1990 + p_size AS sample_end_year, '1_clear' AS notes FROM part""")
def catalogue_claims(spark, folder):
    """Claims from a predictor catalogue, all of whose columns are text."""
    z = F.col("p_size")
    text = {"Acronym": F.concat(F.lit(" "), "p_name"), "Authors": F.col("p_brand"), "Year": (1990 + z).cast("string"), "T-Stat": F.when(z % 4 != 0, (z / 10).cast("string")).otherwise("n.a."), "Mean Return": (F.col("p_retailprice") / 1000).cast("string"), "SampleStartYear": (1960 + z).cast("string"), "SampleEndYear": (1990 + z).cast("string"), "Predictability in OP": F.lit("1_clear ")}
    rows = V.table(spark, folder, "part").select(*[c.alias(n) for n, c in text.items()])
    return rounded(T.catalogue_claims(rows), "claimed_annual_return", digits=9)


@query(sql("brand_returns", "WITH n AS (SELECT asset, count(*)::DOUBLE AS n, 1 - count(*) FILTER (ret > 0) / count(*) AS lost FROM brand_returns WHERE ret IS NOT NULL GROUP BY asset), g(gate, threshold) AS (VALUES ('least_rows', 60.0::DOUBLE), ('least_split', 120.0::DOUBLE), ('pbo_ceiling', 0.5::DOUBLE)) SELECT asset, gate, threshold, round(CASE WHEN gate = 'pbo_ceiling' THEN lost ELSE n END, 6) AS value, CASE WHEN gate = 'pbo_ceiling' THEN lost <= threshold ELSE n >= threshold END AS passes FROM n, g"))
def frozen_gates(spark, folder):
    """The frozen gates on the length of each brand's history and on its share of months that do not rise."""
    ret = P.returns(P.dense(V.brand_month(spark, folder))).filter("ret is not null")
    n = ret.groupBy("asset").agg(F.count(F.lit(1)).cast("double").alias("n"), (1 - F.count_if(F.col("ret") > 0) / F.count(F.lit(1))).alias("lost"))
    each = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(c).alias("value")) for g, c in (("least_rows", "n"), ("least_split", "n"), ("pbo_ceiling", "lost"))])
    return rounded(T.gate_checks(n.select("asset", F.inline(each))), "value")


def family_sql(rules: dict[str, str], lo: float, hi: float, gate: str, delta: float = 0.05) -> str:
    """A family of rules as SQL: positions by name (the rule itself is ``rule``), and the published interval and gate."""
    positions = " UNION ALL ".join(f"SELECT '{name}' AS label, date, level, {position} AS position FROM market_day" for name, position in rules.items())
    return sql(
        "market_day",
        f"""WITH pos AS ({positions} UNION ALL SELECT run::VARCHAR, date, level, CASE WHEN (('0x' || substr(md5(run::VARCHAR || '|' || date::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE < 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM market_day, (SELECT unnest(range(1, 13)) AS run)),
h AS (SELECT label, date, level / lag(level) OVER w - 1 AS r, coalesce(lag(position) OVER w, 0) AS held FROM pos WINDOW w AS (PARTITION BY label ORDER BY date)),
net AS (SELECT label, date, r, held, held * r - coalesce(abs(held - lag(held) OVER (PARTITION BY label ORDER BY date)), abs(held)) * 0.0005::DOUBLE AS a FROM h),
ex AS (SELECT label, avg(held) AS exposure FROM net WHERE a IS NOT NULL GROUP BY label),
pair AS (SELECT label, date, a, r * exposure AS b FROM net JOIN ex USING (label) WHERE a IS NOT NULL AND r IS NOT NULL),
gap AS (SELECT label, count(*) AS obs, {plain_sharpe("a")} - {plain_sharpe("b")} AS sharpe_gap FROM pair GROUP BY label),
series AS (SELECT label, a, b, row_number() OVER (PARTITION BY label ORDER BY date) - 1 AS spot, count(*) OVER (PARTITION BY label) AS n FROM pair WHERE try_cast(label AS INTEGER) IS NULL), {bootstrap_sql("series", 2000, 20, 7)},
g AS (SELECT label, draw, {sharpe_sql("a", 252)} - ({sharpe_sql("b", 252)}) AS gap FROM series JOIN weights USING (n, spot) GROUP BY label, draw),
ci AS (SELECT label, quantile_cont(gap, 0.025) AS lo, quantile_cont(gap, 0.975) AS hi FROM g GROUP BY label),
f AS (SELECT gap.*, lo, hi, CASE WHEN lo IS NULL THEN NULL WHEN hi < 0 OR hi <= {delta} THEN 'REFUTED' WHEN lo > {delta} THEN 'SUPPORTED' ELSE 'INCONCLUSIVE' END AS gate FROM gap LEFT JOIN ci USING (label))
SELECT CASE WHEN label = 'rule' THEN 'rule' WHEN lo IS NULL THEN 'coin' ELSE 'neighbour' END AS kind, label, obs, round(sharpe_gap, 6) + 0.0::DOUBLE AS sharpe_gap, round(lo, 6) + 0.0::DOUBLE AS lo, round(hi, 6) + 0.0::DOUBLE AS hi, gate,
    CASE WHEN label = 'rule' THEN CASE WHEN gate <> '{gate}' THEN 'DIVERGES' WHEN hi < {lo} OR {hi} < lo THEN 'GATE ONLY' ELSE 'REPLICATED' END END AS verdict FROM f""",
    )


def plain_sharpe(x: str) -> str:
    return f"avg({x}) / stddev_samp({x}) * sqrt(252)"


def _months(first: int, last: int) -> str:
    return f"CASE WHEN month(date) >= {first} OR month(date) <= {last} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _cross(fast: int, slow: int) -> str:
    over = lambda n: f"OVER (ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count(*) {over(fast)} = {fast} AND count(*) {over(slow)} = {slow} AND avg(level) {over(fast)} > avg(level) {over(slow)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


PUBLISHED = (-0.4, 0.2, "INCONCLUSIVE")
CALENDAR = {"Oct-Apr": (10, 4), "Nov-May": (11, 5), "Dec-Mar": (12, 3)}
TREND = {"20/100": (20, 100), "100/300": (100, 300), "10/50": (10, 50)}


@query(family_sql({"rule": _months(11, 4), **{n: _months(*m) for n, m in CALENDAR.items()}}, *PUBLISHED))
def family_calendar(spark, folder):
    """The calendar rule, its neighbours and coin flips."""
    return rounded(Y.family(V.market_day(spark, folder), Y.months_rule(11, 4), {n: Y.months_rule(*m) for n, m in CALENDAR.items()}, PUBLISHED))


@query(family_sql({"rule": _cross(50, 200), **{n: _cross(*m) for n, m in TREND.items()}}, *PUBLISHED))
def family_trend(spark, folder):
    """The moving average rule, its neighbours and coin flips."""
    return rounded(Y.family(V.market_day(spark, folder), S.average_cross(50, 200), {n: S.average_cross(*m) for n, m in TREND.items()}, PUBLISHED))


@query("SELECT source, count(*) FILTER (r = 1 AND NOT known) AS new, count(*) - count(*) FILTER (r = 1 AND NOT known) AS dup, count(*) AS total FROM (SELECT source, md5(coalesce(text, '')) IN (SELECT md5(coalesce(text, '')) FROM documents WHERE doc_id % 10 = 0) AS known, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS r FROM documents WHERE doc_id % 10 <> 0) GROUP BY source")
def ingest_counts(spark, folder):
    """New and duplicate records by source, when every tenth document is known already."""
    d = V.table(spark, folder, "documents").select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    return C.ingest_counts(d.filter("doc_id % 10 <> 0"), d.filter("doc_id % 10 = 0"), ["key"], "doc_id")


@query("""WITH c AS (SELECT l_orderkey AS sheet, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::INTEGER AS col, l_linenumber * 10.0::DOUBLE + 2 AS centre FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
h AS (SELECT o_orderkey AS sheet, k AS line, k * 7.0::DOUBLE + o_custkey % 5 AS x0, k * 7.0::DOUBLE + o_custkey % 5 + 8 AS x1, 'w' || k AS text FROM orders, (SELECT unnest([1, 2, 3, 4]) AS k)),
b AS (SELECT c.sheet, c.col, arg_min(text, ((x0 > centre OR centre > x1)::INTEGER, abs((x0 + x1) / 2 - centre), x0)) AS name FROM c JOIN h ON c.sheet = h.sheet GROUP BY ALL) SELECT * FROM b""")
def columns_by_position(spark, folder):
    """Header words over or next to the centres of a sheet's columns."""
    lines = spread(V.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("sheet"), "l_linenumber"), 250_000, "sheet")  # a task holds its sheets
    numbers = lines.select("sheet", F.lit(9).alias("line"), (F.col("l_linenumber") * 10.0).alias("x0"), (F.col("l_linenumber") * 10.0 + 4).alias("x1"), F.concat("l_linenumber", F.lit(".5")).alias("text")).distinct()
    k = F.col("k")
    at = k * 7.0 + F.col("o_custkey") % 5
    heads = V.table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("k"))
    heads = heads.select(F.col("o_orderkey").alias("sheet"), F.lit(1).alias("line"), at.alias("x0"), (at + 8).alias("x1"), F.concat(F.lit("w"), k).alias("text"))
    return X.named_by_position(heads, X.column_centres(numbers))
