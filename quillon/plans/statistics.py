"""Queries over statistics of return series and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import mathx
from quillon.operators import books as B
from quillon.operators import panel as P
from quillon.operators import resamples as R
from quillon.operators import signals as S
from quillon.operators import statistics as T
from quillon.plans.books import NET, RANKED, RULE, forward, market_returns, scores
from quillon.plans.panels import rounded, suppliers
from quillon.plans.registry import query
from quillon.sources import views as V
from quillon.sources.views import sql

def bootstrap_sql(lengths: str, draws: int, block: float, seed: int) -> str:
    """The stationary bootstrap of each of some lengths as SQL: tables ``positions`` and ``weights``."""
    return f"""
places AS (SELECT n, draw, pos, md5(concat_ws('|', '{seed}', n::VARCHAR, draw::VARCHAR, pos::VARCHAR)) AS h FROM (SELECT n, draw, unnest(range(n)) AS pos FROM (SELECT DISTINCT n FROM {lengths}), (SELECT unnest(range({draws})) AS draw))),
jumps AS (SELECT n, draw, pos, CASE WHEN pos = 0 OR (('0x' || substr(h, 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE < 1.0::DOUBLE / {block}
    THEN floor((('0x' || substr(h, 14, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE * n)::BIGINT - pos END AS jump FROM places),
shifts AS (SELECT n, draw, pos, last_value(jump IGNORE NULLS) OVER (PARTITION BY n, draw ORDER BY pos ROWS UNBOUNDED PRECEDING) + pos AS k FROM jumps),
positions AS (SELECT n, draw, pos, (k % n + n) % n AS spot FROM shifts),
weights AS (SELECT n, draw, spot, count(*) AS w FROM positions GROUP BY n, draw, spot)"""


def sharpe_sql(x: str, periods: int) -> str:
    return f"sum(w * {x}) / sum(w) / sqrt((sum(w * {x} * {x}) - sum(w * {x}) * sum(w * {x}) / sum(w)) / (sum(w) - 1)) * sqrt({periods}.0::DOUBLE)"


def integral(density: str, end: str, panels: int = 2000) -> str:
    """Simpson's rule for a density, a format string of its argument, from zero to ``end``."""
    at = lambda k: density.format(f"(({end}) * (i + {k}) / {panels})")
    return f"(({end}) / {6 * panels} * list_sum(list_transform(range({panels}), lambda i: {at('0')} + 4 * {at('0.5::DOUBLE')} + {at('1')})))"


#: the normal distribution function of a column z, and the T's two-sided tail of (t, df)
PHI = "(0.5::DOUBLE + {})".format(integral("exp(-0.5::DOUBLE * {0} * {0})", "z")).replace("list_sum", "1 / sqrt(2 * pi()) * list_sum")
TAIL = "(1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * {})".format(integral("pow(1 + {0} * {0} / df, -(df + 1) / 2)", "abs(t)"))
#: (trials, best): the expected maximum of so many Sharpe ratios without skill; quantiles by bisection
BEST = """p AS (SELECT n AS trials, unnest([1 - 1 / n, 1 - 1 / (n * exp(1))]) AS p, unnest([1 - 0.5772156649::DOUBLE, 0.5772156649::DOUBLE]) AS share FROM (SELECT unnest([{trials}])::DOUBLE AS n)),
cut AS (SELECT trials, p, share, -9.0::DOUBLE AS low, 9.0::DOUBLE AS high, 0 AS k FROM p UNION ALL SELECT trials, p, share, CASE WHEN phi < p THEN z ELSE low END, CASE WHEN phi < p THEN high ELSE z END, k + 1 FROM (SELECT *, {phi} AS phi FROM (SELECT *, (low + high) / 2 AS z FROM cut WHERE k < 56))),
best AS (SELECT trials::INTEGER AS trials, sum(share * (low + high) / 2) AS best FROM cut WHERE k = 56 GROUP BY 1)"""


def recursive(names: str, body: str) -> str:
    return (sql(names, body) if names else body).replace("WITH", "WITH RECURSIVE", 1)


PATH = "WITH i AS (SELECT date, ret FROM market_returns WHERE ret IS NOT NULL), x AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wealth FROM i), d AS (SELECT *, wealth / max(wealth) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM x)"
FLAGSHIP = RANKED + NET + """, x AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wealth FROM net), d AS (SELECT *, wealth / max(wealth) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM x)
SELECT count(*) AS n, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe, round(pow(1 + avg(ret), 252) - 1, 6) AS ann_return, round(stddev_samp(ret) * sqrt(252), 6) AS ann_vol, round(min(dd), 6) AS max_drawdown, round((pow(1 + avg(ret), 252) - 1) / -min(dd), 6) AS calmar FROM d"""


@query(sql("momentum", FLAGSHIP))
def momentum_backtest(spark, folder):
    """Flagship: panel, 12-1 momentum, quintile book, costs, performance."""
    return rounded(T.performance(B.net_returns(suppliers(spark, folder), B.quintile_long_short(scores(spark, folder)), 5.0)))


@query(sql("market_returns", PATH + " SELECT count(*) AS n, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe, round(pow(1 + avg(ret), 252) - 1, 4) AS ann_return, round(stddev_samp(ret) * sqrt(252), 6) AS ann_vol, round(min(dd), 6) AS max_drawdown, round((pow(1 + avg(ret), 252) - 1) / -min(dd), 4) AS calmar FROM d"))
def perf_stats(spark, folder):
    return rounded(rounded(T.performance(market_returns(spark, folder)), "sharpe", "ann_vol", "max_drawdown"), "ann_return", "calmar", digits=4)


@query(sql("market_day", "WITH x AS (SELECT *, level / lag(level) OVER (ORDER BY date) - 1 AS ret, level / max(level) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM market_day) SELECT round(100 * (pow(arg_max(level, date) / arg_min(level, date), 365.25::DOUBLE / (max(date) - min(date))) - 1), 6) AS cagr, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe, round(100 * min(dd), 6) AS max_drawdown FROM x"))
def equity_stats(spark, folder):
    return rounded(T.equity_stats(V.market_day(spark, folder), "level"))


@query(sql("market_returns", "SELECT count(ret) AS n, round(avg((ret > 0)::INTEGER), 6) AS hit_rate, round(avg(ret) / stddev_samp(ret) * sqrt(count(ret)), 6) AS t, round(exp(sum(ln(1 + ret)) * 252 / count(ret)) - 1, 5) AS cagr FROM market_returns"))
def hit_rate(spark, folder):
    m = market_returns(spark, folder)
    row = m.agg(F.count("ret").alias("n"), F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"), T.t_stat().alias("t"), T.cagr().alias("cagr"))
    return rounded(rounded(row, "hit_rate", "t"), "cagr", digits=5)


ERAS = [("early", None, 1996), ("middle", 1996, 1998), ("late", 1999, None), ("all", None, None), ("none", 1900, 1901)]


@query(sql("market_returns", "WITH e(era, a, b) AS (VALUES ('early', 0, 1996), ('middle', 1996, 1998), ('late', 1999, 9999), ('all', 0, 9999), ('none', 1900, 1901)) SELECT era, count(ret) AS months, round(100 * avg(ret), 4) + 0.0::DOUBLE AS mean_pct, round(avg(ret) / stddev_samp(ret) * sqrt(count(ret)), 3) + 0.0::DOUBLE AS t FROM market_returns JOIN e ON year(date) BETWEEN a AND b GROUP BY era HAVING count(ret) > 12"))
def era_stats(spark, folder):
    return T.eras(market_returns(spark, folder), ERAS)


IC = """WITH b AS (SELECT {by}, score, fwd FROM momentum m JOIN forward f USING (asset, date) {join} WHERE fwd IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY {by} ORDER BY fwd) + (count(*) OVER (PARTITION BY {by}, fwd) - 1) / 2.0::DOUBLE AS y FROM b),
ics AS (SELECT {by}, corr(x, y) AS ic, count(*) AS n FROM r GROUP BY {by} HAVING count(*) >= 5)"""


@query(sql("momentum forward", IC.format(by="date", join="") + " SELECT date, round(ic, 6) + 0.0::DOUBLE AS ic, n FROM ics"))
def spearman_ic(spark, folder):
    return rounded(T.rank_ic(scores(spark, folder), forward(spark, folder)))


@query(sql("momentum forward", IC.format(by="date", join="") + " SELECT count(ic) AS n_periods, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), 5) AS icir, CASE WHEN abs(avg(ic)) > 0.1 THEN 'suspicious (overfit?)' WHEN abs(avg(ic)) > 0.05 THEN 'strong' WHEN abs(avg(ic)) > 0.02 THEN 'decent' WHEN abs(avg(ic)) > 0 THEN 'marginal' ELSE 'negative or noise' END AS grade FROM ics"))
def ic_summary(spark, folder):
    row = T.ic_summary(T.rank_ic(scores(spark, folder), forward(spark, folder))).drop("p_value", "significant")
    return rounded(rounded(row, "ic_mean", "ic_std"), "icir", digits=5)


@query(sql("momentum forward", IC.format(by="date", join="") + f", moments AS (SELECT count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) AS sd FROM ics), tested AS (SELECT *, mean / sd * sqrt(n) AS t, (n - 1)::DOUBLE AS df FROM moments), f AS (SELECT *, {TAIL} AS p FROM tested) SELECT n AS n_periods, round(mean, 6) + 0.0::DOUBLE AS ic_mean, round(sd, 6) AS ic_std, round(t, 6) + 0.0::DOUBLE AS icir, round(p, 6) AS p_value, t > 2 AND p < 0.05::DOUBLE AS significant, CASE WHEN abs(mean) > 0.1 THEN 'suspicious (overfit?)' WHEN abs(mean) > 0.05 THEN 'strong' WHEN abs(mean) > 0.02 THEN 'decent' WHEN abs(mean) > 0 THEN 'marginal' ELSE 'negative or noise' END AS grade FROM f"))
def ic_p_value(spark, folder):
    return rounded(T.ic_summary(T.rank_ic(scores(spark, folder), forward(spark, folder))))


@query(sql("momentum forward sector_map", IC.format(by="sector, date", join="JOIN sector_map USING (asset)") + " SELECT sector, round(avg(ic), 6) + 0.0::DOUBLE AS ic_mean, count(*) AS periods FROM ics GROUP BY sector"))
def ic_by_sector(spark, folder):
    s = scores(spark, folder).join(V.sector_map(spark, folder), "asset")
    return rounded(T.rank_ic(s, forward(spark, folder), ("sector", "date")).groupBy("sector").agg(F.avg("ic").alias("ic_mean"), F.count(F.lit(1)).alias("periods")))


@query(
    sql(
        "momentum",
        """WITH f AS (SELECT asset, date, h, lead(close, h) OVER (PARTITION BY asset, h ORDER BY date) / close - 1 AS fwd FROM dense_supplier, (SELECT unnest([1, 3, 6]) AS h)),
b AS (SELECT h, date, score, fwd FROM momentum JOIN f USING (asset, date) WHERE fwd IS NOT NULL),
r AS (SELECT h, date, rank() OVER (PARTITION BY h, date ORDER BY score) + (count(*) OVER (PARTITION BY h, date, score) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY h, date ORDER BY fwd) + (count(*) OVER (PARTITION BY h, date, fwd) - 1) / 2.0::DOUBLE AS y FROM b),
i AS (SELECT h, date, corr(x, y) AS ic FROM r GROUP BY ALL HAVING count(*) >= 5)
SELECT h AS horizon, round(avg(ic), 6) + 0.0::DOUBLE AS ic_mean FROM i GROUP BY h""",
    )
)
def ic_decay(spark, folder):
    p, s = suppliers(spark, folder), scores(spark, folder)
    parts = [T.rank_ic(s, P.forward_return(p, h)).agg(F.avg("ic").alias("ic_mean")).select(F.lit(h).alias("horizon"), "ic_mean") for h in (1, 3, 6)]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(
    recursive(
        "market_returns",
        f"""WITH {BEST.format(trials=12, phi=PHI)}, i AS (SELECT ret, avg(ret) OVER () AS mean FROM market_returns WHERE ret IS NOT NULL),
m AS (SELECT count(*) AS n, avg(ret) / stddev_samp(ret) AS raw, avg(pow(ret - mean, 2)) AS m2, avg(pow(ret - mean, 3)) AS m3, avg(pow(ret - mean, 4)) AS m4 FROM i), k AS (SELECT n, raw, m3 / pow(m2, 1.5::DOUBLE) AS skew, m4 / (m2 * m2) AS kurtosis FROM m),
d AS (SELECT *, sqrt((1 - skew * raw + (kurtosis - 1) / 4 * raw * raw) / (n - 1)) AS sd FROM k), f AS (SELECT *, (raw - best * sd) / sd AS z FROM d, best)
SELECT n, round(raw * sqrt(252), 6) AS sr_observed, round(best * sd * sqrt(252), 6) AS expected_max_sr, round(sd * sqrt(252), 6) AS sr_std, round(skew, 6) + 0.0::DOUBLE AS skew, round(kurtosis, 6) AS kurtosis, round(z, 6) + 0.0::DOUBLE AS z_score, round({PHI}, 6) + 0.0::DOUBLE AS dsr FROM f""",
    )
)
def deflated_sharpe(spark, folder):
    return rounded(T.deflated_sharpe(market_returns(spark, folder), 12))


_COUNTED = "b AS (SELECT asset, avg(ret) / stddev_samp(ret) * sqrt(12) AS sharpe FROM brand_returns WHERE ret IS NOT NULL GROUP BY asset), c AS (SELECT p_brand AS asset, count(DISTINCT p_type) AS trials FROM part GROUP BY 1), counted AS (SELECT asset, trials, sharpe FROM c JOIN b USING (asset))"
_BEST = BEST.replace("(SELECT unnest([{trials}])::DOUBLE AS n)", "(SELECT DISTINCT trials::DOUBLE AS n FROM counted WHERE trials > 1)").format(phi=PHI)


@query(recursive("brand_returns", f"WITH {_COUNTED}, {_BEST} SELECT asset, trials, round(sharpe, 6) + 0.0::DOUBLE AS sharpe, round(coalesce(best, 0), 6) + 0.0::DOUBLE AS expected_max, CASE WHEN sharpe > 0 THEN round(pow(coalesce(best, 0) / sharpe, 2), 4) + 0.0::DOUBLE END AS years_needed FROM counted LEFT JOIN best USING (trials)"))
def expected_max_sharpe(spark, folder):
    """For each brand the Sharpe ratio that as many tries as it has types of parts would reach by luck, and the years its own needs."""
    ret = P.returns(P.dense(V.brand_month(spark, folder))).filter("ret is not null").groupBy("asset").agg((F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(12))).alias("sharpe"))
    tries = V.table(spark, folder, "part").groupBy(F.col("p_brand").alias("asset")).agg(F.countDistinct("p_type").alias("trials"))
    out = T.luck(tries.join(ret, "asset")).select("asset", "trials", "sharpe", "expected_max", "years_needed")
    return rounded(rounded(out, "sharpe", "expected_max"), "years_needed", digits=4)


@query(
    sql(
        "market_returns",
        """WITH s AS (SELECT date, ret - (SELECT avg(ret) FROM market_returns) AS e FROM market_returns WHERE ret IS NOT NULL), c AS (SELECT count(*)::DOUBLE AS n, floor(4 * pow(count(*) / 100.0::DOUBLE, 2.0::DOUBLE / 9))::INTEGER AS k, sum(e * e) AS g0 FROM s),
o AS (SELECT e, row_number() OVER (ORDER BY date) AS i FROM s),
g AS (SELECT y.i - x.i AS j, sum(x.e * y.e) AS g FROM o x JOIN o y ON y.i - x.i BETWEEN 1 AND (SELECT k FROM c) GROUP BY 1),
v AS (SELECT (SELECT g0 / n FROM c) + sum(2 * (1 - j / ((SELECT k FROM c) + 1.0::DOUBLE)) * g / (SELECT n FROM c)) AS v FROM g)
SELECT n::BIGINT AS n, k AS lags, round((SELECT avg(ret) FROM market_returns) / sqrt(v / n), 5) AS newey_west_t, round((SELECT avg(ret) FROM market_returns) / sqrt(g0 / (n - 1) / n), 5) AS unadjusted_t FROM c, v""",
    )
)
def newey_west(spark, folder):
    return rounded(T.newey_west(market_returns(spark, folder)), digits=5)


PATHS = """WITH s AS (SELECT ret, floor((row_number() OVER (ORDER BY date) - 1) * 6 / count(*) OVER ())::INTEGER AS b FROM market_returns WHERE ret IS NOT NULL),
p AS (SELECT (row_number() OVER (ORDER BY x, y) - 1)::INTEGER AS path, x, y FROM (SELECT unnest(range(6)) AS x), (SELECT unnest(range(6)) AS y) WHERE x < y),
paths AS (SELECT path, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, count(*) AS n FROM p JOIN s ON b IN (x, y) GROUP BY path)"""


@query(sql("market_returns", PATHS + " SELECT path, round(sharpe, 5) + 0.0::DOUBLE AS sharpe, n FROM paths"))
def cpcv_paths(spark, folder):
    return rounded(T.path_sharpes(market_returns(spark, folder)), digits=5)


@query(sql("market_returns", PATHS + ", l AS (SELECT list(sharpe ORDER BY sharpe) AS s, count(*) AS paths, avg((sharpe > 0)::INTEGER) AS share FROM paths) SELECT paths, round(s[1], 3) + 0.0::DOUBLE AS worst, round(s[paths // 2 + 1], 3) + 0.0::DOUBLE AS median, round(s[-1], 3) + 0.0::DOUBLE AS best, round(share, 3) AS share_positive FROM l"))
def cpcv_summary(spark, folder):
    return rounded(T.path_summary(T.path_sharpes(market_returns(spark, folder))))


def rules(spark: SparkSession, folder: str) -> DataFrame:
    """Competing timing rules (name, date, ret)."""
    m = V.market_day(spark, folder)
    out = B.rule_returns(S.sell_in_may(m)).select(F.lit("calendar").alias("name"), "date", "ret")
    for fast, slow in ((5, 20), (10, 50), (50, 200)):
        out = out.unionByName(B.rule_returns(S.average_cross(fast, slow)(m)).select(F.lit(f"cross {fast}/{slow}").alias("name"), "date", "ret"))
    return out


CROSS = """SELECT 'cross {0}/{1}' AS name, date, level, CASE WHEN count(*) OVER f = {0} AND count(*) OVER s = {1} AND avg(level) OVER f > avg(level) OVER s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS position FROM market_day WINDOW f AS (ORDER BY date ROWS {0} - 1 PRECEDING), s AS (ORDER BY date ROWS {1} - 1 PRECEDING)"""
RULES = f"""WITH pos AS (SELECT 'calendar' AS name, date, level, CASE WHEN month(date) >= 11 OR month(date) <= 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS position FROM market_day UNION ALL {" UNION ALL ".join(f"({CROSS.format(*c)})" for c in ((5, 20), (10, 50), (50, 200)))}),
hd AS (SELECT name, date, level / lag(level) OVER w - 1 AS r, coalesce(lag(position) OVER w, 0) AS held FROM pos WINDOW w AS (PARTITION BY name ORDER BY date)),
rules AS (SELECT name, date, held * r - coalesce(abs(held - lag(held) OVER (PARTITION BY name ORDER BY date)), abs(held)) * 0.0005::DOUBLE AS ret FROM hd)"""
SPLITS = """, c AS (SELECT date FROM rules WHERE ret IS NOT NULL GROUP BY date HAVING count(*) = (SELECT count(DISTINCT name) FROM rules)), b AS (SELECT date, floor((row_number() OVER (ORDER BY date) - 1) * 8 / count(*) OVER ())::INTEGER AS block FROM c),
sums AS (SELECT name, block, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM rules JOIN b USING (date) GROUP BY ALL),
halves AS (SELECT m AS half, k AS block, (m >> k) & 1 = 1 AS inside FROM (SELECT unnest(range(256)) AS m), (SELECT unnest(range(8)) AS k) WHERE bit_count(m::INTEGER) = 4),
t AS (SELECT half, name, inside, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM halves JOIN sums USING (block) GROUP BY ALL), v AS (SELECT *, (q - s * s / n) / (n - 1) AS var FROM t),
x AS (SELECT half, name, inside, CASE WHEN var > 0 THEN s / n / sqrt(var) ELSE 0 END AS sharpe FROM v), y AS (SELECT half, name, max(sharpe) FILTER (inside) AS seen, max(sharpe) FILTER (NOT inside) AS unseen FROM x GROUP BY ALL),
z AS (SELECT half, rank() OVER (PARTITION BY half ORDER BY unseen) + (count(*) OVER (PARTITION BY half, unseen) - 1) / 2 AS place, row_number() OVER (PARTITION BY half ORDER BY seen DESC, name) AS best, count(*) OVER (PARTITION BY half) AS names FROM y)
SELECT round(avg((place / (names + 1) <= 0.5::DOUBLE)::INTEGER), 4) AS pbo, any_value(names)::INTEGER AS configurations, count(*) AS halves FROM z WHERE best = 1"""


@query(sql("market_day", RULES + SPLITS))
def overfitting(spark, folder):
    return T.overfitting(rules(spark, folder))


@query()
def claim_check(spark, folder):
    got = T.check_claim(market_returns(spark, folder), 3.0, 12, rules(spark, folder))
    return spark.createDataFrame([(got["status"], got["reasons"], got["years"], got["newey_west_t"])], "status string, reasons array<string>, years double, newey_west_t double")


@query(
    sql(
        "market_day",
        RULE
        + f""", x AS (SELECT date, ret AS a FROM s WHERE ret IS NOT NULL), y AS (SELECT date, r * (SELECT avg(held) FROM s WHERE ret IS NOT NULL) AS b FROM p WHERE r IS NOT NULL),
series AS (SELECT a, b, row_number() OVER (ORDER BY date) - 1 AS spot, count(*) OVER () AS n FROM x JOIN y USING (date)), {bootstrap_sql("series", 2000, 20, 7)},
g AS (SELECT draw, {sharpe_sql("a", 252)} - ({sharpe_sql("b", 252)}) AS gap FROM series JOIN weights USING (n, spot) GROUP BY draw),
ci AS (SELECT quantile_cont(gap, 0.025) AS lo, quantile_cont(gap, 0.975) AS hi FROM g)
SELECT round(lo, 6) + 0.0::DOUBLE AS lo, round(hi, 6) + 0.0::DOUBLE AS hi, CASE WHEN hi < 0 OR hi <= 0.05 THEN 'REFUTED' WHEN lo > 0.05 THEN 'SUPPORTED' ELSE 'INCONCLUSIVE' END AS gate, NOT (hi < 0 OR 0 < lo) AS overlaps_zero FROM ci""",
    )
)
def bootstrap_ci(spark, folder):
    m = V.market_day(spark, folder)
    ours = B.rule_returns(S.sell_in_may(m))
    hold = B.exposure_matched(m, ours.agg(F.avg("held").alias("exposure")))
    gaps = R.bootstrap_gaps(ours.select("date", F.col("ret").alias("a")).join(hold.select("date", F.col("ret").alias("b")), "date"))
    ci = T.interval(gaps, "sharpe_gap")
    return rounded(ci.withColumn("gate", T.gate(F.col("lo"), F.col("hi"), 0.05)).withColumn("overlaps_zero", T.overlaps(F.col("lo"), F.col("hi"), F.lit(0.0), F.lit(0.0))))


@query(sql("market_day", "WITH d AS (SELECT date, lag(date) OVER (ORDER BY date) AS b, level / lag(level) OVER (ORDER BY date) - 1 AS r FROM market_day), p AS (SELECT run, date, CASE WHEN (('0x' || substr(md5(run::VARCHAR || '|' || b::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE < 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS held, r FROM d, (SELECT unnest(range(1, 13)) AS run) WHERE r IS NOT NULL) SELECT run, round(avg(held * r), 8) + 0.0::DOUBLE AS mean_ret, round(avg(held), 6) AS exposure FROM p GROUP BY run"))
def placebo_runs(spark, folder):
    """Coin-flip rules on the same days: a control without skill."""
    m = V.market_day(spark, folder)
    w = Window.orderBy("date")
    d = m.select("date", F.lag("date").over(w).alias("b"), (F.col("level") / F.lag("level").over(w) - 1).alias("r")).filter("r is not null")
    p = d.withColumn("run", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long")))).withColumn("held", F.when(S.hashed_uniform("run", "b") < 0.5, 1.0).otherwise(0.0))
    return rounded(rounded(p.groupBy("run").agg(F.avg(F.col("held") * F.col("r")).alias("mean_ret"), F.avg("held").alias("exposure")), "exposure"), "mean_ret", digits=8)


@query(sql("macro_month", "WITH f AS (SELECT date, mkt AS actual, lag(mkt) OVER (ORDER BY date) AS model, avg(mkt) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bench FROM macro_month) SELECT round(100 * (1 - sum((actual - model) ** 2) / sum((actual - bench) ** 2)), 5) + 0.0::DOUBLE AS r2_squared, round(100 * (1 - sum(abs(actual - model)) / sum(abs(actual - bench))), 5) + 0.0::DOUBLE AS r2_absolute FROM f WHERE model IS NOT NULL AND bench IS NOT NULL"))
def r2_oos(spark, folder):
    w = Window.orderBy("date")
    f = V.macro_month(spark, folder).select(F.col("mkt").alias("actual"), F.lag("mkt").over(w).alias("model"), F.avg("mkt").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("bench"))
    return rounded(T.r2_oos(f.dropna()), digits=5)


@query(sql("macro_month", "SELECT round(avg(mkt) - 2.5::DOUBLE * var_samp(mkt), 8) + 0.0::DOUBLE AS cer_mean_variance, round(pow(avg(pow(1 + mkt, -4)), -0.25::DOUBLE) - 1, 8) + 0.0::DOUBLE AS cer_crra FROM macro_month"))
def certainty_equivalents(spark, folder):
    return rounded(T.certainty_equivalents(V.macro_month(spark, folder).withColumnRenamed("mkt", "ret")), digits=8)


@query(sql("ledger", "WITH s AS (SELECT n_chars AS score, verdict = 'keep' AS positive FROM ledger JOIN documents ON doc_id = id), r AS (SELECT positive, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM s) SELECT round((sum(r) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2.0::DOUBLE) / (count(*) FILTER (positive) * count(*) FILTER (NOT positive)), 9) AS auc FROM r"))
def auc(spark, folder):
    d = V.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    return rounded(T.auc(V.ledger(spark, folder).join(d, "id").select("score", (F.col("verdict") == "keep").alias("positive"))), digits=9)


NAMES = ["mkt", "discount", "tax", "quantity", "urgent"]


@query(sql("macro_month", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0::DOUBLE AS corr FROM macro_month" for k, a in enumerate(NAMES) for b in NAMES[k + 1 :])))
def correlation_table(spark, folder):
    return rounded(T.correlations(V.macro_month(spark, folder), NAMES))


@query(sql("macro_month", "WITH i AS (SELECT date, mkt AS ret, rf, exp(sum(ln(1 + mkt)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS w FROM macro_month), d AS (SELECT *, w / max(w) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM i) SELECT round(100 * exp(sum(ln(1 + ret))), 5) AS tw, round(1200 * avg(ret), 5) + 0.0::DOUBLE AS av, round(100 * sqrt(12) * stddev_samp(ret), 5) AS sd, round(avg(ret - rf) / stddev_samp(ret - rf) * sqrt(12), 5) + 0.0::DOUBLE AS sr, round(-100 * min(dd), 5) + 0.0::DOUBLE AS mdd FROM d"))
def strategy_summary(spark, folder):
    return rounded(T.strategy_summary(V.macro_month(spark, folder).withColumnRenamed("mkt", "ret")), digits=5)


@query(sql("momentum", RANKED + NET + ", r AS (SELECT count(*) AS months, avg(ret) AS m, stddev_samp(ret) AS s FROM net) SELECT months, round(100 * m, 4) + 0.0::DOUBLE AS monthly_pct, round(m / s * sqrt(months), 3) + 0.0::DOUBLE AS t, round(m / s * sqrt(12), 3) + 0.0::DOUBLE AS sharpe, m > 0 AS same_sign, abs(round(m / s * sqrt(months), 3)) >= 2 AS still_significant, NULL::VARCHAR AS error FROM r"))
def retest_score(spark, folder):
    return T.score_series(B.net_returns(suppliers(spark, folder), B.quintile_long_short(scores(spark, folder)), 5.0), 3.1)


@query(sql("market_day", RULE + ", mo AS (SELECT last_day(date) AS date, 100 * (exp(sum(ln(1 + ret))) - 1) AS ours FROM s WHERE ret IS NOT NULL GROUP BY 1), th AS (SELECT last_day(date) AS date, 100 * (exp(sum(ln(1 + r))) - 1) AS theirs FROM h WHERE r IS NOT NULL GROUP BY 1) SELECT count(*) AS months, min(date) AS first, max(date) AS last, round(corr(ours, theirs), 3) AS correlation, round(avg(ours), 4) + 0.0::DOUBLE AS ours_mean, round(avg(theirs), 4) + 0.0::DOUBLE AS theirs_mean FROM mo JOIN th USING (date)"))
def compare_published(spark, folder):
    m = market_returns(spark, folder)
    theirs = m.groupBy(F.last_day("date").alias("date")).agg((100 * (F.exp(F.sum(F.log1p("ret"))) - 1)).alias("theirs"))
    return T.compare_monthly(B.rule_returns(S.sell_in_may(V.market_day(spark, folder))), theirs)


@query()
def signal_backtest(spark, folder):
    """End to end: book, costs, IC, deflated Sharpe, out-of-sample split, replication score and verdict."""
    p, s = suppliers(spark, folder), scores(spark, folder)
    weights = B.quintile_long_short(s)
    net = B.net_returns(p, weights, 5.0)
    row = T.performance(net).crossJoin(F.broadcast(T.ic_summary(T.rank_ic(s, forward(spark, folder))))).crossJoin(F.broadcast(T.deflated_sharpe(net, 12).select("dsr", "z_score")))
    late = net.filter("date >= '1999-01-01'").agg(F.when(F.count("ret") > 30, T.sharpe()).alias("sharpe_oos"))
    row = row.crossJoin(F.broadcast(late)).crossJoin(F.broadcast(B.turnover(weights).agg(F.avg("turnover").alias("turnover"))))
    return rounded(T.verdict(row).withColumn("replication_score", F.col("sharpe") / ((0.2 + 0.8) / 2)))
