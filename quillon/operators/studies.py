"""Studies of rule families: a rule against holding as much of the market, its neighbours, and coin flips."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import books, resamples, signals, statistics

Rule = Callable[[DataFrame], DataFrame]


def paired(series: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """((date, a, b), one row with the exposure): net returns of the rule and of holding its mean exposure all the time."""
    ours = books.rule_returns(rule(series))
    exposure = ours.agg(F.avg("held").alias("exposure"))
    hold = books.exposure_matched(series, exposure)
    return ours.select("date", F.col("ret").alias("a")).join(hold.select("date", F.col("ret").alias("b")), "date"), exposure


def gaps(pairs: DataFrame) -> DataFrame:
    """One row: observations and the rule's Sharpe ratio and annual growth less those of holding."""
    both = pairs.filter("a is not null and b is not null")
    return both.agg(F.count(F.lit(1)).alias("obs"), (statistics.sharpe("a") - statistics.sharpe("b")).alias("sharpe_gap"), (statistics.cagr("a") - statistics.cagr("b")).alias("cagr_gap"))


def evaluate(series: DataFrame, rule: Rule, delta: float, draws: int = 2000) -> DataFrame:
    """(obs, exposure, sharpe_gap, cagr_gap, lo, hi, gate): the gaps, and the interval of the Sharpe gap with its gate."""
    pairs, exposure = paired(series, rule)
    interval = statistics.interval(resamples.bootstrap_gaps(pairs, draws), "sharpe_gap")
    row = gaps(pairs).crossJoin(F.broadcast(exposure)).crossJoin(F.broadcast(interval))
    return row.withColumn("gate", statistics.gate(F.col("lo"), F.col("hi"), delta)).select("obs", "exposure", "sharpe_gap", "cagr_gap", "lo", "hi", "gate")


def coin(seed: int) -> Rule:
    """Long or flat by a hash of the date."""
    return lambda series: series.withColumn("position", F.when(signals.hashed_uniform(F.lit(seed), "date") < 0.5, 1.0).otherwise(0.0))


def months_rule(first: int, last: int) -> Rule:
    """Long from month ``first`` over the turn of the year to month ``last``."""
    m = F.month("date")
    return lambda series: series.withColumn("position", F.when((m >= first) | (m <= last), 1.0).otherwise(0.0))


def family(series: DataFrame, rule: Rule, neighbours: dict[str, Rule], published: tuple[float, float, str], delta: float = 0.05, draws: int = 2000, placebos: int = 12) -> DataFrame:
    """(kind, label, obs, sharpe_gap, lo, hi, gate, verdict): the rule, its neighbours, and coin flips.

    published: interval and gate of the paper.  The verdict on the rule: REPLICATED if gate and interval agree, GATE ONLY if the
    intervals do not overlap, else DIVERGES.  Coin flips have gaps only: they show what trading every other day costs.
    """
    lo, hi, gate = published
    base = evaluate(series, rule, delta, draws)
    overlap = statistics.overlaps(F.col("lo"), F.col("hi"), F.lit(lo), F.lit(hi))
    verdict = F.when(F.col("gate") != gate, "DIVERGES").when(overlap, "REPLICATED").otherwise("GATE ONLY")
    columns = ["kind", "label", "obs", "sharpe_gap", "lo", "hi", "gate", "verdict"]
    none = F.lit(None).cast("string")
    out = base.withColumns({"kind": F.lit("rule"), "label": F.lit("rule"), "verdict": verdict}).select(*columns)
    for label, other in neighbours.items():
        row = evaluate(series, other, delta, draws)
        out = out.unionByName(row.withColumns({"kind": F.lit("neighbour"), "label": F.lit(label), "verdict": none}).select(*columns))
    return out.unionByName(placebo(series, placebos).select(F.lit("coin").alias("kind"), F.col("run").cast("string").alias("label"), "obs", "sharpe_gap", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), none.alias("gate"), none.alias("verdict")))


def placebo(series: DataFrame, runs: int) -> DataFrame:
    """(run, obs, sharpe_gap) of coin-flip rules, all in one pass: runs are rows."""
    w = Window.partitionBy("run").orderBy("date")
    coins = series.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).withColumn("position", F.when(signals.hashed_uniform("run", "date") < 0.5, 1.0).otherwise(0.0))
    r = F.col("level") / F.lag("level").over(w) - 1
    held = coins.withColumn("r", r).withColumn("held", F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    change = F.coalesce(F.abs(F.col("held") - F.lag("held").over(w)), F.abs("held"))
    net = held.withColumn("a", F.col("held") * F.col("r") - change * (5.0 / books.BPS)).filter("a is not null")
    rates = net.groupBy("run").agg(F.avg("held").alias("exposure"))
    both = net.join(F.broadcast(rates), "run").withColumn("b", F.col("r") * F.col("exposure"))
    return both.groupBy("run").agg(F.count(F.lit(1)).alias("obs"), (statistics.sharpe("a") - statistics.sharpe("b")).alias("sharpe_gap"))
