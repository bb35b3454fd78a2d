"""Queries over portfolios: weights, turnover, net returns and timing rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import books as B
from quillon.operators import panel as P
from quillon.operators import signals as S
from quillon.plans.panels import rounded, suppliers
from quillon.plans.registry import query
from quillon.sources import views as V
from quillon.sources.views import sql


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return S.momentum(suppliers(spark, folder), 1, 12).filter("score is not null")


def forward(spark: SparkSession, folder: str) -> DataFrame:
    return P.forward_return(suppliers(spark, folder))


RANKED = """WITH k AS (SELECT date, asset, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, asset) AS high, row_number() OVER (PARTITION BY date ORDER BY score, asset) AS low, count(*) OVER (PARTITION BY date) AS n FROM momentum),
ls AS (SELECT date, asset, CASE WHEN n < 10 THEN 0.0::DOUBLE WHEN low <= greatest(5, floor(n * 0.2::DOUBLE)) THEN -0.5::DOUBLE / greatest(5, floor(n * 0.2::DOUBLE)) WHEN high <= greatest(5, floor(n * 0.2::DOUBLE)) THEN 0.5::DOUBLE / greatest(5, floor(n * 0.2::DOUBLE)) ELSE 0.0::DOUBLE END AS w FROM k)"""


@query(sql("momentum", RANKED + " SELECT * FROM ls"))
def quintile_weights(spark, folder):
    return B.quintile_long_short(scores(spark, folder))


@query(sql("momentum", RANKED + " SELECT date, asset, CASE WHEN n >= 5 AND high <= greatest(5, floor(n * 0.2::DOUBLE)) THEN 1.0::DOUBLE / greatest(5, floor(n * 0.2::DOUBLE)) ELSE 0.0::DOUBLE END AS w FROM k"))
def quintile_long_only(spark, folder):
    return B.quintile_long_only(scores(spark, folder))


TURNOVER = """, d AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM ls)),
t AS (SELECT d.date, CASE WHEN d.before IS NULL THEN 0.0::DOUBLE ELSE sum(abs(coalesce(n.w, 0) - coalesce(o.w, 0))) END AS turnover
FROM d CROSS JOIN (SELECT DISTINCT asset FROM ls) a LEFT JOIN ls n ON n.date = d.date AND n.asset = a.asset LEFT JOIN ls o ON o.date = d.before AND o.asset = a.asset GROUP BY d.date, d.before)"""


@query(sql("momentum", RANKED + TURNOVER + " SELECT date, round(turnover, 6) AS turnover FROM t"))
def turnover_l1(spark, folder):
    return rounded(B.turnover(B.quintile_long_short(scores(spark, folder))))


NET = """, g AS (SELECT p.asset, p.date, p.close / lag(p.close) OVER (PARTITION BY p.asset ORDER BY p.date) - 1 AS r,
    last_value(CASE WHEN r.date IS NOT NULL THEN coalesce(ls.w, 0.0::DOUBLE) END IGNORE NULLS) OVER (PARTITION BY p.asset ORDER BY p.date ROWS UNBOUNDED PRECEDING) AS target
    FROM dense_supplier p LEFT JOIN (SELECT DISTINCT date FROM ls) r ON r.date = p.date LEFT JOIN ls ON ls.date = p.date AND ls.asset = p.asset),
h AS (SELECT asset, date, coalesce(r, 0) AS r, coalesce(lag(coalesce(target, 0)) OVER (PARTITION BY asset ORDER BY date), 0) AS held FROM g),
c AS (SELECT *, abs(held - coalesce(lag(held) OVER (PARTITION BY asset ORDER BY date), held)) AS change FROM h),
net AS (SELECT date, sum(held * r) - sum(change) * 0.0005::DOUBLE AS ret FROM c GROUP BY date)"""


@query(sql("momentum", RANKED + NET + " SELECT date, round(ret, 6) + 0.0::DOUBLE AS ret FROM net"))
def ls_returns_net(spark, folder):
    return rounded(B.net_returns(suppliers(spark, folder), B.quintile_long_short(scores(spark, folder)), 5.0))


DECILES = """WITH r AS (SELECT m.date, m.asset, fwd, row_number() OVER (PARTITION BY m.date ORDER BY score, m.asset) AS low, count(*) OVER (PARTITION BY m.date) AS n FROM momentum m JOIN forward f ON f.date = m.date AND f.asset = m.asset WHERE fwd IS NOT NULL),
b AS (SELECT date, asset, fwd, CASE WHEN low <= greatest(2, floor(n * 0.1::DOUBLE)) THEN -1 WHEN low > n - greatest(2, floor(n * 0.1::DOUBLE)) THEN 1 END AS side FROM r WHERE n >= 20),
m AS (SELECT date, asset, fwd, side FROM b WHERE side IS NOT NULL),
gr AS (SELECT date, avg(fwd) FILTER (side = 1) - avg(fwd) FILTER (side = -1) AS gross, lag(date) OVER (ORDER BY date) AS before FROM m GROUP BY date),
ch AS (SELECT gr.date, gross, (SELECT count(*) FROM m n WHERE n.date = gr.date) AS a, (SELECT count(*) FROM m n WHERE n.date = gr.before) AS o,
    (SELECT count(*) FROM m n JOIN m q ON q.asset = n.asset AND q.date = gr.before WHERE n.date = gr.date) AS both_sides FROM gr),
tj AS (SELECT date, gross, (a + o - 2 * both_sides)::DOUBLE / (a + o - both_sides) AS turnover FROM ch)"""


@query(sql("momentum forward", DECILES + " SELECT date, asset, side FROM m"))
def decile_members(spark, folder):
    f = forward(spark, folder)
    ranked = B._ranked(scores(spark, folder).join(f.filter("fwd is not null").select("date", "asset"), ["date", "asset"])).filter("n >= 20")
    k = F.greatest(F.lit(2), F.floor(F.col("n") * B.DECILE))
    return ranked.withColumn("side", F.when(F.col("low") <= k, -1).when(F.col("low") > F.col("n") - k, 1)).filter("side is not null").select("date", "asset", "side")


@query(sql("momentum forward", DECILES + " SELECT date, round(gross, 6) + 0.0::DOUBLE AS gross, round(turnover, 6) AS turnover, round(gross - turnover * 0.001::DOUBLE, 6) + 0.0::DOUBLE AS ret FROM tj"))
def turnover_jaccard(spark, folder):
    return rounded(B.decile_long_short(scores(spark, folder), forward(spark, folder)))


@query(
    sql(
        "momentum forward",
        """WITH r AS (SELECT m.date, m.asset, row_number() OVER (PARTITION BY m.date ORDER BY score, m.asset) AS low, count(*) OVER (PARTITION BY m.date) AS n FROM momentum m JOIN supplier_month s ON s.asset = m.asset AND s.date = m.date AND s.close >= 120),
z AS (SELECT *, greatest(1, round_even(n * 0.1::DOUBLE, 0))::INTEGER AS k FROM r WHERE n >= 20),
c AS (SELECT date, asset, CASE WHEN low <= k THEN -0.5::DOUBLE / k WHEN low > n - k THEN 0.5::DOUBLE / k ELSE 0 END AS w FROM z),
fm AS (SELECT date, row_number() OVER (ORDER BY date) AS cohort FROM (SELECT DISTINCT date FROM c)),
mo AS (SELECT d.date, max(cohort) OVER (ORDER BY d.date ROWS UNBOUNDED PRECEDING) AS latest FROM (SELECT DISTINCT date FROM forward) d LEFT JOIN fm ON fm.date = d.date),
mk AS (SELECT date, latest, least(latest, 3) AS live, row_number() OVER (ORDER BY date) AS k FROM mo WHERE latest IS NOT NULL),
bk AS (SELECT mk.date, mk.k, asset, sum(w) / any_value(live) AS w FROM mk JOIN fm ON cohort BETWEEN latest - live + 1 AND latest JOIN c ON c.date = fm.date GROUP BY ALL),
x AS (SELECT b.date, sum(b.w * coalesce(fwd, 0)) AS gross, sum(abs(b.w - coalesce(o.w, 0))) AS turnover FROM bk b LEFT JOIN bk o ON o.k = b.k - 1 AND o.asset = b.asset LEFT JOIN forward f ON f.date = b.date AND f.asset = b.asset GROUP BY b.date)
SELECT last_day(date + INTERVAL 1 MONTH) AS date, round(gross, 6) + 0.0::DOUBLE AS gross, round(turnover, 6) AS turnover, round(gross - turnover * 0.001::DOUBLE, 6) + 0.0::DOUBLE AS ret FROM x""",
    )
)
def cohort_book(spark, folder):
    """Three overlapping cohorts with a price screen."""
    return rounded(B.cohort_book(scores(spark, folder), forward(spark, folder), V.supplier_month(spark, folder), 120.0))


#: the book of the row before's scores as SQL, of {scores}; its returns are ``res``
PRIOR = (
    """WITH sc AS ({scores}), dm AS (SELECT d.asset, d.date, m.score FROM dense_supplier d LEFT JOIN sc m USING (asset, date)),
l AS (SELECT date, asset, lag(score) OVER (PARTITION BY asset ORDER BY date) AS score FROM dm),
q AS (SELECT date, asset, row_number() OVER (PARTITION BY date ORDER BY score DESC, asset) AS high, count(*) OVER (PARTITION BY date) AS n FROM l WHERE score IS NOT NULL),
ls AS (SELECT date, asset, CASE WHEN high > n - greatest(2, floor(n * 0.2::DOUBLE)) THEN -0.5::DOUBLE / greatest(2, floor(n * 0.2::DOUBLE)) WHEN high <= greatest(2, floor(n * 0.2::DOUBLE)) THEN 0.5::DOUBLE / greatest(2, floor(n * 0.2::DOUBLE)) ELSE 0 END AS w FROM q WHERE n >= 10)"""
    + TURNOVER
    + NET.replace("sum(change) * 0.0005::DOUBLE", "0")
    + """, s AS (SELECT date, sum(abs(w)) AS size FROM ls GROUP BY date), ft AS (SELECT t.date, CASE WHEN t.date = (SELECT min(date) FROM ls) THEN size ELSE turnover END AS turnover FROM t JOIN s USING (date)),
res AS (SELECT net.date, ret - coalesce(turnover, 0) * 0.001::DOUBLE AS ret FROM net LEFT JOIN ft ON ft.date = net.date)"""
)


@query(sql("momentum", PRIOR.format(scores="SELECT asset, date, score FROM momentum") + " SELECT date, round(ret, 6) + 0.0::DOUBLE AS ret FROM res"))
def prior_score_book(spark, folder):
    p = suppliers(spark, folder)
    return rounded(B.prior_score_book(S.momentum(p, 1, 12), p))


@query(
    sql(
        "momentum forward",
        """WITH b AS (SELECT m.date, m.asset, fwd, (rank() OVER (PARTITION BY m.date ORDER BY score) + (count(*) OVER (PARTITION BY m.date, score) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY m.date) AS pct FROM momentum m JOIN forward f ON f.date = m.date AND f.asset = m.asset WHERE fwd IS NOT NULL)
SELECT date, round(avg(fwd) FILTER (pct > 2.0::DOUBLE / 3) - avg(fwd) FILTER (pct <= 1.0::DOUBLE / 3), 6) + 0.0::DOUBLE AS ret, count(*) AS n FROM b GROUP BY date HAVING count(*) >= 6""",
    )
)
def tercile_ls(spark, folder):
    return rounded(B.tercile_long_short(scores(spark, folder), forward(spark, folder)))


RULE = """WITH p AS (SELECT date, level / lag(level) OVER (ORDER BY date) - 1 AS r, CASE WHEN month(date) >= 11 OR month(date) <= 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS position FROM market_day),
h AS (SELECT date, r, coalesce(lag(position) OVER (ORDER BY date), 0) AS held FROM p),
s AS (SELECT date, held, held * r - coalesce(abs(held - lag(held) OVER (ORDER BY date)), abs(held)) * 0.0005::DOUBLE AS ret FROM h)"""


@query(sql("market_day", RULE + " SELECT date, round(ret, 6) + 0.0::DOUBLE AS ret FROM s WHERE ret IS NOT NULL"))
def rule_returns(spark, folder):
    return rounded(B.rule_returns(S.sell_in_may(V.market_day(spark, folder))).select("date", "ret"))


@query(sql("market_day", RULE + " SELECT date, round(r * (SELECT avg(held) FROM s WHERE ret IS NOT NULL), 6) + 0.0::DOUBLE AS ret FROM p WHERE r IS NOT NULL"))
def exposure_matched(spark, folder):
    m = V.market_day(spark, folder)
    exposure = B.rule_returns(S.sell_in_may(m)).agg(F.avg("held").alias("exposure"))
    return rounded(B.exposure_matched(m, exposure))


@query(
    sql(
        "macro_month",
        """WITH s AS (SELECT date, mkt, rf, CASE WHEN lag(mkt) OVER (ORDER BY date) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS position FROM macro_month),
r AS (SELECT *, CASE WHEN position > 0 THEN mkt ELSE rf END AS ret, coalesce(abs(position - lag(position) OVER (ORDER BY date)), 0) AS change FROM s)
SELECT date, position, round(ret, 6) + 0.0::DOUBLE AS ret, round((1 + ret) * (1 - change * 0.001::DOUBLE) - 1, 6) + 0.0::DOUBLE AS net FROM r""",
    )
)
def switching_rule(spark, folder):
    m = V.macro_month(spark, folder).withColumn("forecast", F.lag("mkt").over(Window.orderBy("date")))
    return rounded(B.switching(m))


@query(
    sql(
        "brand_returns",
        """WITH w AS (SELECT asset, 1.0::DOUBLE / count(*) OVER () AS w FROM (SELECT DISTINCT asset FROM brand_returns)),
d AS (SELECT date, sum(w * coalesce(ret, 0)) AS ret FROM brand_returns JOIN w USING (asset) GROUP BY date)
SELECT date, round(ret, 6) + 0.0::DOUBLE AS ret, round(exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)), 6) AS wealth FROM d""",
    )
)
def fixed_hold(spark, folder):
    r = P.returns(P.dense(V.brand_month(spark, folder)))
    names = r.select("asset").distinct()
    weights = names.crossJoin(F.broadcast(names.agg(F.count(F.lit(1)).alias("n")))).select("asset", (1.0 / F.col("n")).alias("w"))
    return rounded(B.fixed_hold(r, weights))


DD = """, x AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY name ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wealth FROM i)
SELECT name, date, round(wealth, 6) AS wealth, round(wealth / max(wealth) OVER (PARTITION BY name ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) + 0.0::DOUBLE AS drawdown FROM x"""
SPANS = [("early", "1995-06-01", "1996-12-31"), ("late", "1999-01-01", "2000-06-30"), ("both", "1996-06-01", "1999-06-30")]


@query(sql("market_returns", "WITH i AS (SELECT 'all' AS name, date, ret FROM market_returns WHERE ret IS NOT NULL)" + DD))
def drawdown_path(spark, folder):
    return rounded(B.drawdown(market_returns(spark, folder)).select(F.lit("all").alias("name"), "date", "wealth", "drawdown"))


@query(sql("market_returns", "WITH sp(name, a, b) AS (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in SPANS) + "), i AS (SELECT name, date, ret FROM market_returns JOIN sp ON date BETWEEN a AND b WHERE ret IS NOT NULL)" + DD))
def crisis_windows(spark, folder):
    spans = spark.createDataFrame(SPANS, "name string, start string, stop string").select("name", F.to_date("start").alias("start"), F.to_date("stop").alias("stop"))
    return rounded(B.windows(market_returns(spark, folder), spans).select("name", "date", "wealth", "drawdown"))


def market_returns(spark: SparkSession, folder: str) -> DataFrame:
    m = V.market_day(spark, folder)
    return m.select("date", (F.col("level") / F.lag("level").over(Window.orderBy("date")) - 1).alias("ret")).filter("ret is not null")
