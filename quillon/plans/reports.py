"""Queries over universes, evaluations, pivots and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import books as B
from quillon.operators import panel as P
from quillon.operators import reports as R
from quillon.operators import signals as S
from quillon.operators import statistics as T
from quillon.plans import shared
from quillon.plans.books import PRIOR, market_returns
from quillon.plans.estimators import CODE
from quillon.plans.panels import rounded
from quillon.plans.registry import query
from quillon.plans.scores import SCORED, scored
from quillon.plans.screens import p, papers
from quillon.sources import records
from quillon.sources import views as V
from quillon.sources.views import sql


@query("SELECT c_name AS symbol FROM (SELECT DISTINCT c_name FROM customer) ORDER BY md5('7|' || c_name), c_name LIMIT 40")
def universe_sample(spark, folder):
    return R.seeded_sample(V.table(spark, folder, "customer").select(F.col("c_name").alias("symbol")), 40, 7)


@query("SELECT DISTINCT upper(regexp_extract(n_name || '.us.json.gz', '^([^.]+)', 1)) AS key FROM nation")
def cached_keys(spark, folder):
    return R.cached_keys(V.table(spark, folder, "nation").select(F.concat(F.lit("/cache/x/"), "n_name", F.lit(".us.json.gz")).alias("path")))


@query("SELECT * EXCLUDE (r) FROM (SELECT user_id, ts::DATE AS date, value, event_type, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC) AS r FROM events) WHERE r = 1")
def last_of_day(spark, folder):
    return R.last_of_day(V.table(spark, folder, "events").select("user_id", "ts", "value", "event_type"), ["user_id"], "ts")


FIX = "fx AS (SELECT p_partkey AS id, p_retailprice / 1000 AS sharpe, 0.9::DOUBLE AS lo, 1.4::DOUBLE AS hi, (p_size - 25) / 1000.0::DOUBLE AS ic_mean, CASE p_partkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE 'both' END AS expected_sign, 0.005::DOUBLE AS least_ic, CASE p_size % 3 WHEN 0 THEN 'ship' WHEN 1 THEN 'kill' ELSE 'iterate' END AS verdict, CASE p_partkey % 3 WHEN 0 THEN 'ship' WHEN 1 THEN 'kill' ELSE 'iterate' END AS expected_verdict FROM part), fl AS (SELECT *, sharpe BETWEEN lo AND hi AS sharpe_in_range, CASE WHEN expected_sign = '-' THEN -ic_mean ELSE ic_mean END >= least_ic AS ic_pass, CASE expected_sign WHEN '+' THEN ic_mean > 0 WHEN '-' THEN ic_mean < 0 ELSE true END AS sign_match, verdict = expected_verdict AS verdict_match FROM fx)"


def fixtures(spark, folder):
    k, z = F.col("p_partkey"), F.col("p_size")
    third = lambda c, *v: F.when(c % 3 == 0, v[0]).when(c % 3 == 1, v[1]).otherwise(v[2])
    rows = V.table(spark, folder, "part").select(k.alias("id"), (F.col("p_retailprice") / 1000).alias("sharpe"), F.lit(0.9).alias("lo"), F.lit(1.4).alias("hi"), ((z - 25) / 1000).alias("ic_mean"), third(k, "+", "-", "both").alias("expected_sign"), F.lit(0.005).alias("least_ic"), third(z, "ship", "kill", "iterate").alias("verdict"), third(k, "ship", "kill", "iterate").alias("expected_verdict"))
    return R.fixture_flags(rows)


@query(f"WITH {FIX} SELECT id, sharpe_in_range, ic_pass, sign_match, verdict_match, list_filter([CASE WHEN NOT sharpe_in_range THEN 'sharpe_in_range' END, CASE WHEN NOT ic_pass THEN 'ic_pass' END, CASE WHEN NOT sign_match THEN 'sign_match' END, CASE WHEN NOT verdict_match THEN 'verdict_match' END], lambda x: x IS NOT NULL) AS reasons FROM fl")
def fixture_flags(spark, folder):
    return fixtures(spark, folder).select("id", "sharpe_in_range", "ic_pass", "sign_match", "verdict_match", "reasons")


@query(f"WITH {FIX} SELECT count(*) AS fixtures, round(avg(verdict_match::INTEGER), 6) AS verdict_accuracy, round(avg(sharpe_in_range::INTEGER), 6) AS sharpe_in_range_rate, round(avg(sign_match::INTEGER), 6) AS sign_match_rate, count(*) FILTER (expected_verdict = 'ship' AND verdict = 'kill') AS n_false_negatives, count(*) FILTER (expected_verdict = 'kill' AND verdict = 'ship') AS n_false_positives, 5 * count(*) FILTER (expected_verdict = 'ship' AND verdict = 'kill') + count(*) FILTER (expected_verdict = 'kill' AND verdict = 'ship') AS asymmetric_loss FROM fl")
def evaluation_summary(spark, folder):
    return rounded(R.evaluation_summary(fixtures(spark, folder)))


@query(sql("market_returns", "WITH c AS (SELECT count(ret) AS days, avg(ret) / stddev_samp(ret) * sqrt(count(ret)) AS t FROM market_returns WHERE year(date) BETWEEN 1995 AND 2000) SELECT days, round(t, 3) + 0.0::DOUBLE AS t, CASE WHEN days / 252 < 5 THEN 'no_overlap' WHEN t >= 1.5 AND abs(t - 2.4) <= 0.6 * 2.4 THEN 'calibrated' ELSE 'miscalibrated' END AS label FROM c"))
def calibrate(spark, folder):
    return R.calibrate(market_returns(spark, folder), 1995, 2000, 2.4)


@query(sql("market_returns", "WITH c AS (SELECT count(ret) AS days, avg(ret) / stddev_samp(ret) AS m FROM market_returns WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31') SELECT days, CASE WHEN days >= 300 THEN round(m * sqrt(252), 6) + 0.0::DOUBLE END AS sharpe, CASE WHEN days >= 300 THEN round(m * sqrt(days), 6) + 0.0::DOUBLE END AS t, CASE WHEN days < 300 THEN 'only ' || days || ' trading days available in 1997-01-01..1998-12-31' END AS note FROM c"))
def scored_window(spark, folder):
    return R.scored_window(market_returns(spark, folder), "1997-01-01", "1998-12-31")


LADDER = """WITH u AS (SELECT asset, part FROM (SELECT DISTINCT asset FROM dense_supplier), (SELECT unnest([1, 2, 4]) AS part) WHERE ('0x' || substr(md5(asset::VARCHAR), 1, 8))::BIGINT % part = 0),
k AS (SELECT part, date, asset, row_number() OVER (PARTITION BY part, date ORDER BY score DESC, asset) AS high, row_number() OVER (PARTITION BY part, date ORDER BY score, asset) AS low, count(*) OVER (PARTITION BY part, date) AS n FROM momentum JOIN u USING (asset)),
ls AS (SELECT part, date, asset, CASE WHEN n < 10 THEN 0.0::DOUBLE WHEN low <= greatest(5, floor(n * 0.2::DOUBLE)) THEN -0.5::DOUBLE / greatest(5, floor(n * 0.2::DOUBLE)) WHEN high <= greatest(5, floor(n * 0.2::DOUBLE)) THEN 0.5::DOUBLE / greatest(5, floor(n * 0.2::DOUBLE)) ELSE 0.0::DOUBLE END AS w FROM k),
g AS (SELECT u.part, p.asset, p.date, p.close / lag(p.close) OVER o - 1 AS r, last_value(CASE WHEN r.date IS NOT NULL THEN coalesce(ls.w, 0.0::DOUBLE) END IGNORE NULLS) OVER (PARTITION BY u.part, p.asset ORDER BY p.date ROWS UNBOUNDED PRECEDING) AS target
    FROM dense_supplier p JOIN u ON u.asset = p.asset LEFT JOIN (SELECT DISTINCT part, date FROM ls) r ON r.part = u.part AND r.date = p.date LEFT JOIN ls ON ls.part = u.part AND ls.date = p.date AND ls.asset = p.asset WINDOW o AS (PARTITION BY u.part, p.asset ORDER BY p.date)),
h AS (SELECT part, asset, date, coalesce(r, 0) AS r, coalesce(lag(coalesce(target, 0)) OVER (PARTITION BY part, asset ORDER BY date), 0) AS held FROM g),
c AS (SELECT *, abs(held - coalesce(lag(held) OVER (PARTITION BY part, asset ORDER BY date), held)) AS change FROM h),
net AS (SELECT part, date, sum(held * r) - sum(change) * 0.001::DOUBLE AS ret FROM c GROUP BY ALL),
x AS (SELECT n.part, covar_samp(n.ret, a.ret) / nullif(stddev_samp(n.ret) * stddev_samp(a.ret), 0) AS corr FROM net n JOIN net a ON a.date = n.date AND a.part = 1 GROUP BY n.part),
l AS (SELECT names, corr FROM x JOIN (SELECT part, count(*) AS names FROM u GROUP BY part) USING (part)), v AS (SELECT (list(corr ORDER BY names DESC))[1] - (list(corr ORDER BY names))[1] AS change FROM l)
SELECT round(change, 6) AS change, CASE WHEN change >= 0.08::DOUBLE THEN 'universe size was the limit' WHEN change <= -0.03::DOUBLE THEN 'more names made it worse' ELSE 'universe size is not the limit' END AS verdict FROM v"""


@query(sql("momentum", LADDER))
def universe_ladder(spark, folder):
    """Correlation of the book's returns on nested universes with those on all names."""
    panel = P.dense(V.supplier_month(spark, folder))

    def book(some):
        return B.net_returns(some, B.quintile_long_short(S.momentum(some, 1, 12).filter("score is not null")), 10.0)

    full = book(panel).withColumnRenamed("ret", "all")
    dealt = F.conv(F.substring(F.md5(F.col("asset").cast("string")), 1, 8), 16, 10).cast("long")
    out = None
    for parts in (4, 2, 1):
        some = panel.filter(dealt % parts == 0)
        row = book(some).join(full, "date").agg(T.correlation("ret", "all").alias("corr")).select("corr").crossJoin(F.broadcast(some.agg(F.countDistinct("asset").cast("int").alias("names")))).select("names", "corr")
        out = row if out is None else out.unionByName(row)
    return R.lift_verdict(out)


@query(f"WITH {SCORED} SELECT string_split(cell, '/')[1] AS exhibit, count(*) FILTER (state = 'REPRODUCED') AS \"REPRODUCED\", count(*) FILTER (state = 'MISSED') AS \"MISSED\", count(*) FILTER (state = 'NOT_ATTEMPTED') AS \"NOT_ATTEMPTED\", round(count(*) FILTER (state = 'REPRODUCED') / nullif(count(*) FILTER (state <> 'NOT_ATTEMPTED'), 0), 6) AS rate FROM scored GROUP BY 1")
def state_pivot(spark, folder):
    return R.state_pivot(scored(spark, folder), ["REPRODUCED", "MISSED", "NOT_ATTEMPTED"])


@query(f"WITH {SCORED}, e AS (SELECT string_split(cell, '/')[1] AS exhibit, cell, state FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY exhibit ORDER BY (state <> 'NOT_ATTEMPTED')::INTEGER DESC, cell) AS place, count(*) OVER (PARTITION BY exhibit) AS total FROM e) SELECT exhibit, cell, state, place, total FROM r WHERE place <= 3")
def evidence(spark, folder):
    return R.evidence(scored(spark, folder), 3).select("exhibit", "cell", "state", "place", "total")


@query("SELECT o_orderpriority AS row, max(o_totalprice) FILTER (o_orderstatus = 'F') AS \"F\", max(o_totalprice) FILTER (o_orderstatus = 'O') AS \"O\", max(o_totalprice) FILTER (o_orderstatus = 'P') AS \"P\", min(o_orderkey) AS position FROM orders GROUP BY 1")
def page_order_pivot(spark, folder):
    o = V.table(spark, folder, "orders")
    cells = o.groupBy(F.col("o_orderpriority").alias("row"), F.col("o_orderstatus").alias("col")).agg(F.max("o_totalprice").alias("value"), F.min("o_orderkey").alias("position"))
    return R.page_order_pivot(cells, ["F", "O", "P"])


@query("WITH c AS (SELECT source, CASE lang WHEN 'en' THEN 'covered' WHEN 'de' THEN 'not_covered' ELSE 'unknown' END AS coverage, n_chars AS weight FROM documents), t AS (SELECT source, sum(weight)::DOUBLE AS total FROM c GROUP BY 1) SELECT source, round(coalesce(sum(weight) FILTER (coverage = 'covered'), 0) / total, 6) AS covered, round(coalesce(sum(weight) FILTER (coverage = 'not_covered'), 0) / total, 6) AS not_covered, round(coalesce(sum(weight) FILTER (coverage = 'unknown'), 0) / total, 6) AS unknown FROM c JOIN t USING (source) GROUP BY source, total")
def weighted_coverage(spark, folder):
    c = F.when(F.col("lang") == "en", "covered").when(F.col("lang") == "de", "not_covered").otherwise("unknown")
    return R.weighted_coverage(V.table(spark, folder, "documents").select("source", c.alias("coverage"), F.col("n_chars").alias("weight")), "source", ["covered", "not_covered", "unknown"])


@query(p("SELECT split_part(reason || ' (' || id || ')', ' (', 1) AS reason, count(*) AS n FROM papers GROUP BY 1"))
def reason_histogram(spark, folder):
    return R.reason_histogram(papers(spark, folder).withColumn("reason", F.concat("reason", F.lit(" ("), "id", F.lit(")"))))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 10 END AS appeal, (doc_id % 7) / 7.0::DOUBLE AS confidence, CASE doc_id % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'M' ELSE 'L' END AS tier FROM documents ORDER BY appeal DESC NULLS LAST, confidence DESC NULLS LAST, tier = 'L', tier = 'M', id LIMIT 25")
def shortlist(spark, folder):
    i = F.col("id")
    d = V.table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    return R.shortlist(d.select("id", F.when(i % 11 != 0, i % 10).alias("appeal"), ((i % 7) / 7).alias("confidence"), F.when(i % 3 == 0, "S").when(i % 3 == 1, "M").otherwise("L").alias("tier"))).limit(25)


@query("WITH l AS (SELECT doc_id AS doc, unnest(range(len(x))) AS line, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) SELECT doc, line, last_value(CASE WHEN length(text) < 20 THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM l")
def carry_labels(spark, folder):
    d = V.table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return R.carry_labels(d.withColumn("is_label", F.length("text") < 20)).select("doc", F.col("line").cast("long").alias("line"), "section")


@query("SELECT doc_id AS id, try_cast(nullif(regexp_extract(text, '(?i)sharpe(\\s+ratio)?[:\\s]+(\\d+\\.\\d+)', 2), '') AS DOUBLE) AS claimed_sharpe, CASE WHEN regexp_matches(x, '(?i)\\bs&p\\s*500\\b|\\bsp\\s*500\\b|\\bsp500\\b') THEN 'sp500' END AS universe, CASE WHEN regexp_matches(x, '(?i)\\bmonthly\\b.*\\brebalanc') THEN 'monthly' END AS rebalance_freq, CASE WHEN regexp_matches(x, '(?i)\\bmonthly\\b.*\\brebalanc') THEN 21 END AS horizon_days, CASE WHEN regexp_matches(x, '(?i)\\b(cross[- ]?section)\\b') THEN true END AS is_cross_sectional FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Sharpe ratio: 1.' || doc_id || ' on the S&P 500' WHEN 1 THEN 'a monthly book that is rebalanced, cross-section' ELSE text END AS text, CASE doc_id % 3 WHEN 0 THEN 'Sharpe ratio: 1.' || doc_id || ' on the S&P 500' WHEN 1 THEN 'a monthly book that is rebalanced, cross-section' ELSE text END AS x FROM documents)")
def offline_spec(spark, folder):
    i = F.col("doc_id")
    text = F.when(i % 3 == 0, F.concat(F.lit("Sharpe ratio: 1."), i, F.lit(" on the S&P 500"))).when(i % 3 == 1, "a monthly book that is rebalanced, cross-section").otherwise(F.col("text"))
    return V.table(spark, folder, "documents").select(i.alias("id"), records.offline_spec(text).alias("s")).select("id", "s.*")


@query("SELECT l_orderkey AS id, l_linenumber AS line, (5 + (l_returnflag = 'R')::INTEGER + (l_quantity = 5)::INTEGER) / 7.0::DOUBLE AS agreement FROM lineitem")
def spec_agreement(spark, folder):
    return agreements(V.table(spark, folder, "lineitem"))


def agreements(li):
    a = F.struct(F.col("l_returnflag").alias("universe"), F.col("l_quantity").alias("horizon_days"))
    b = F.struct(F.lit("r ").alias("universe"), F.lit(5.0).alias("horizon_days"))
    return li.select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b")).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), records.agreement("a", "b", {"universe": "string", "horizon_days": "double"}).alias("agreement"))


@query()
def replication(spark, folder):
    """The whole way of every document as a paper: text, checked code, book, performance, claim."""
    panel = shared.staged(P.dense(V.supplier_month(spark, folder)), "panel")

    def backtest(scores):
        # dates, ranks and holdings read the scores, which are dear
        scores = shared.staged(scores, "scores")
        return B.net_returns(panel, B.quintile_long_short(P.normalized(scores).filter("score is not null")), 5.0)

    papers = V.table(spark, folder, "documents").select(F.col("doc_id").alias("paper"), "text")
    return rounded(R.replicate_all(papers, CODE, panel, backtest, 2.0, 3))


_RET = "b AS (SELECT asset, date, ret, avg(ret) OVER (PARTITION BY date) AS mkt FROM returns), z AS (SELECT *, CASE WHEN count(ret) OVER w = 24 THEN covar_samp(ret, mkt) OVER w / CASE WHEN count(mkt) OVER w = 24 THEN var_samp(mkt) OVER w END END AS beta FROM b WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 23 PRECEDING))"
_LAGGED = "SELECT asset, date, {} AS score FROM dense_supplier WINDOW w AS (PARTITION BY asset ORDER BY date)"
_TRAILING = "SELECT asset, date, -CASE WHEN count(ret) OVER w = 12 THEN {}(ret) OVER w END AS score FROM returns WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 11 PRECEDING)"
#: the registered signals in their published direction, as SQL
_SCORES = {
    "mom12m": _LAGGED.format("lag(close, 1) OVER w / lag(close, 12) OVER w - 1"), "mom6m": _LAGGED.format("lag(close, 1) OVER w / lag(close, 6) OVER w - 1"), "strev": _LAGGED.format("-(close / lag(close, 1) OVER w - 1)"),
    "maxret": _TRAILING.format("max"), "retvol": _TRAILING.format("stddev_samp"),
    "idiovol": f"WITH {_RET}, x AS (SELECT asset, date, ret - beta * mkt AS x FROM z) SELECT asset, date, -CASE WHEN count(x) OVER w = 24 THEN stddev_samp(x) OVER w END AS score FROM x WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 23 PRECEDING)",
    "beta": f"WITH {_RET} SELECT asset, date, beta AS score FROM z",
}
_BOOK = PRIOR + ", wealth AS (SELECT date, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS w FROM res WHERE ret IS NOT NULL), falls AS (SELECT *, w / max(w) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM wealth) SELECT count(*) AS n, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, min(dd) AS max_drawdown FROM falls"


@query(sql("dense_supplier returns", " UNION ALL ".join(f"SELECT '{name}' AS signal, n, round(sharpe, 6) + 0.0::DOUBLE AS sharpe, round(max_drawdown, 6) + 0.0::DOUBLE AS max_drawdown FROM ({_BOOK.format(scores=scores)})" for name, scores in _SCORES.items())))
def predictors_postsample(spark, folder):
    """Every registered signal in its published direction, with its performance."""
    panel = shared.staged(P.dense(V.supplier_month(spark, folder)), "panel")
    out = None
    for name in S.SIGNALS:
        net = B.prior_score_book(S.directed(name, panel), panel)
        row = T.performance(net).select(F.lit(name).alias("signal"), "n", "sharpe", "max_drawdown")
        out = row if out is None else out.unionByName(row)
    return rounded(out)
