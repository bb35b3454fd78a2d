"""Replication of many papers at once: specifications, back-tests and verdicts are rows.

A paper names a momentum rule (lookback, skip, sign) and claims a t statistic.  Papers that name the same rule share its back-test: distinct rules
meet the panel, quintile books and their monthly returns are made for all rules side by side, one aggregation gives each
rule's figures, and these join the papers again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.panel import by_asset
from quillon.operators.reports import LEAST_TEXT
from quillon.operators.statistics import GATES

RULE = ["lookback", "skip", "sign"]
QUINTILE = 5
#: longest lookback, in rows: prices that a row carries with it
LONGEST = 36


def specified(papers: DataFrame) -> DataFrame:
    """Papers with ``spec_ok``: text enough to have been read, and a rule that can be computed."""
    rule = (F.col("lookback") > F.col("skip")) & (F.col("skip") >= 0) & (F.col("lookback") <= LONGEST) & F.col("sign").isin(1, -1)
    return papers.withColumn("spec_ok", F.coalesce((F.length("text") >= LEAST_TEXT) & rule, F.lit(False)))


def rule_scores(panel: DataFrame, rules: DataFrame) -> DataFrame:
    """(RULE, asset, date, score, next): each rule's score, and the return of the row after it."""
    back = F.reverse(F.collect_list(F.struct("close")).over(by_asset().rowsBetween(-LONGEST, 0)))  # nulls keep their places
    rows = panel.select("asset", "date", back.alias("back"), (F.try_divide(F.lead("close").over(by_asset()), F.col("close")) - 1).alias("next"))
    met = rows.crossJoin(F.broadcast(rules.select(*RULE)))  # rules are a bounded grid
    close = lambda k: F.get("back", F.col(k))["close"]
    return met.select(*RULE, "asset", "date", (F.col("sign") * (F.try_divide(close("skip"), close("lookback")) - 1)).alias("score"), "next")


def rule_returns(scores: DataFrame) -> DataFrame:
    """(RULE, date, ret): the mean next return of the top quintile less that of the bottom one."""
    date = Window.partitionBy(*RULE, "date")
    ranked = scores.filter("score is not null").withColumn("r", F.row_number().over(date.orderBy("score", "asset"))).withColumn("n", F.count(F.lit(1)).over(date)).withColumn("m", F.floor(F.col("n") / QUINTILE))
    mean = lambda c: F.avg(F.when(c, F.col("next")))
    return ranked.groupBy(*RULE, "date").agg((mean(F.col("r") > F.col("n") - F.col("m")) - mean(F.col("r") <= F.col("m"))).alias("ret")).filter("ret is not null")


def rule_figures(returns: DataFrame, lags: int = 4) -> DataFrame:
    """(RULE, n, sharpe, t): monthly Sharpe ratio a year, and t with Bartlett weights over ``lags`` autocovariances."""
    rule = Window.partitionBy(*RULE)
    ordered = rule.orderBy("date")
    e = returns.withColumn("e", F.col("ret") - F.avg("ret").over(rule))
    lagged = e.select(*RULE, "ret", "e", *[(F.col("e") * F.lag("e", k).over(ordered)).alias(f"p{k}") for k in range(1, lags + 1)])
    row = lagged.groupBy(*RULE).agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.sum(F.col("e") * F.col("e")).alias("g0"), *[F.coalesce(F.sum(f"p{k}"), F.lit(0.0)).alias(f"g{k}") for k in range(1, lags + 1)])
    v = F.col("g0") + sum((2 * (1 - k / (lags + 1)) * F.col(f"g{k}") for k in range(1, lags + 1)), F.lit(0.0))
    return row.select(*RULE, "n", F.when(F.col("s") > 0, F.col("m") / F.col("s") * F.sqrt(F.lit(12.0))).alias("sharpe"), F.when(v > 0, F.col("m") / (F.sqrt(v) / F.col("n"))).alias("t"))


def replicated(papers: DataFrame, panel: DataFrame) -> DataFrame:
    """(paper, status, claim, t, sharpe) of (paper, text, RULE, claimed_t).

    status: spec_failed, backtest_failed or done.  claim, where it is done: INSUFFICIENT below the least number of rows, FAILS below the gate of t, WEAKER
    where too much of the published t is lost, else HOLDS.
    """
    read = specified(papers)
    rules = read.filter("spec_ok").select(*RULE).distinct()
    figures = rule_figures(rule_returns(rule_scores(panel, rules))).withColumnsRenamed({c: f"__{c}" for c in RULE})
    same = F.col("spec_ok")
    for c in RULE:
        same = same & (F.col(c) == F.col(f"__{c}"))
    both = read.join(figures, same, "left")
    done = F.col("spec_ok") & (F.col("n") > 0)
    lost = (F.col("claimed_t") > 0) & ((F.col("claimed_t") - F.col("t")) / F.col("claimed_t") > GATES.t_erosion_fraction)
    claim = F.when(F.col("n") < GATES.least_rows, "INSUFFICIENT").when(F.col("t").isNull() | (F.col("t") < GATES.newey_west_t), "FAILS").when(lost, "WEAKER").otherwise("HOLDS")
    status = F.when(~F.col("spec_ok"), "spec_failed").when(~F.coalesce(done, F.lit(False)), "backtest_failed").otherwise("done")
    return both.select("paper", status.alias("status"), F.when(done, claim).alias("claim"), F.when(done, F.col("t")).alias("t"), F.when(done, F.col("sharpe")).alias("sharpe"))
