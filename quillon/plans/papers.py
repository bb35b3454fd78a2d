"""Queries over papers that are replicated as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import panel as P
from quillon.operators import replications as R
from quillon.plans.panels import rounded
from quillon.plans.registry import query
from quillon.sources import views as V
from quillon.sources.views import sql

RULE = "lookback, skip, sign"


def papers(spark, folder):
    """Documents as papers, each with a rule and a claim of its own; some rules cannot be computed."""
    i = F.col("doc_id")
    lookback = F.when(i % 17 == 0, 1).otherwise((3 * (1 + i % 4)).cast("int"))
    skip = F.when(i % 17 == 0, 2).otherwise((F.floor(i / 4) % 3).cast("int"))
    return V.table(spark, folder, "documents").select(i.alias("paper"), "text", lookback.alias("lookback"), skip.alias("skip"), F.when(i % 5 < 3, -1).otherwise(1).alias("sign"), ((i % 50) / 10).alias("claimed_t"))


@query(
    sql(
        "dense_supplier",
        f"""WITH p AS (SELECT doc_id AS paper, text, CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 3 * (1 + doc_id % 4) END AS lookback, CASE WHEN doc_id % 17 = 0 THEN 2 ELSE (doc_id // 4) % 3 END AS skip, CASE WHEN doc_id % 5 < 3 THEN -1 ELSE 1 END AS sign, (doc_id % 50) / 10 AS claimed FROM documents),
k AS (SELECT *, coalesce(length(text) >= 500 AND lookback > skip, false) AS ok FROM p),
s AS (SELECT {RULE}, asset, date, sign * (lag(close, skip) OVER w / lag(close, lookback) OVER w - 1) AS score, lead(close) OVER w / close - 1 AS nxt FROM dense_supplier, (SELECT DISTINCT {RULE} FROM k WHERE ok) WINDOW w AS (PARTITION BY {RULE}, asset ORDER BY date)),
r AS (SELECT *, row_number() OVER (PARTITION BY {RULE}, date ORDER BY score, asset) AS r, count(*) OVER (PARTITION BY {RULE}, date) AS n FROM s WHERE score IS NOT NULL),
x AS (SELECT * FROM (SELECT {RULE}, date, avg(nxt) FILTER (r > n - n // 5) - avg(nxt) FILTER (r <= n // 5) AS ret FROM r GROUP BY {RULE}, date) WHERE ret IS NOT NULL),
e AS (SELECT *, ret - avg(ret) OVER (PARTITION BY {RULE}) AS e FROM x),
l AS (SELECT *, {", ".join(f"e * lag(e, {j}) OVER w AS p{j}" for j in range(1, 5))} FROM e WINDOW w AS (PARTITION BY {RULE} ORDER BY date)),
f AS (SELECT {RULE}, count(*) AS n, avg(ret) AS m, avg(ret) / stddev_samp(ret) * sqrt(12) AS sharpe, sum(e * e) + {" + ".join(f"2 * (1 - {j} / 5.0::DOUBLE) * sum(p{j})" for j in range(1, 5))} AS v FROM l GROUP BY {RULE}),
g AS (SELECT k.*, n, sharpe, CASE WHEN v > 0 THEN m / (sqrt(v) / n) END AS t FROM k LEFT JOIN f ON ok AND f.lookback = k.lookback AND f.skip = k.skip AND f.sign = k.sign)
SELECT paper, CASE WHEN NOT ok THEN 'spec_failed' WHEN n IS NULL THEN 'backtest_failed' ELSE 'done' END AS status,
    CASE WHEN n IS NOT NULL THEN CASE WHEN n < 60 THEN 'INSUFFICIENT' WHEN t IS NULL OR t < 2 THEN 'FAILS' WHEN claimed > 0 AND (claimed - t) / claimed > 0.3 THEN 'WEAKER' ELSE 'HOLDS' END END AS claim,
    round(t, 4) + 0.0::DOUBLE AS t, round(sharpe, 4) + 0.0::DOUBLE AS sharpe FROM g""",
    )
)
def replicated_papers(spark, folder):
    """Every paper's rule back-tested, rules side by side, and its claim judged."""
    return rounded(R.replicated(papers(spark, folder), P.dense(V.supplier_month(spark, folder))), digits=4)
