"""Portfolios: ranks to weights, holdings to turnover and costs, and net return series.

Selections break ties by asset, so every book is a total order.  All books are (date, asset, w).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.panel import by_asset, earned_month

TOP = 0.20
DECILE = 0.10
HOLD = 3
BPS = 10_000.0


def average_rank(value: str, *by: str) -> Column:
    """Rank with ties at their mean, as rank correlation takes it."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def _ranked(scores: DataFrame) -> DataFrame:
    up = Window.partitionBy("date").orderBy("score", "asset")
    down = Window.partitionBy("date").orderBy(F.desc("score"), "asset")
    n = F.count(F.lit(1)).over(Window.partitionBy("date"))
    return scores.filter("score is not null").select("date", "asset", "score", F.row_number().over(down).alias("high"), F.row_number().over(up).alias("low"), n.alias("n"))


def quintile_long_short(scores: DataFrame, top: float = TOP, least: int = 10) -> DataFrame:
    """Half of the book long the top, half short the bottom; a name in both is short; dates below ``least`` names hold nothing."""
    k = F.greatest(F.lit(5), F.floor(F.col("n") * top))
    w = F.when(F.col("n") < least, 0.0).when(F.col("low") <= k, -0.5 / k).when(F.col("high") <= k, 0.5 / k).otherwise(0.0)
    return _ranked(scores).select("date", "asset", w.alias("w"))


def quintile_long_only(scores: DataFrame, top: float = TOP, least: int = 5) -> DataFrame:
    k = F.greatest(F.lit(5), F.floor(F.col("n") * top))
    return _ranked(scores).select("date", "asset", F.when((F.col("n") >= least) & (F.col("high") <= k), 1.0 / k).otherwise(0.0).alias("w"))


def turnover(weights: DataFrame) -> DataFrame:
    """(date, turnover): sum of absolute changes from the date before over all assets of either; the first date counts 0."""
    dates = weights.select("date").distinct().withColumn("before", F.lag("date").over(Window.orderBy("date")))
    now = weights.join(dates, "date").select("date", "asset", "before", "w")
    was = weights.select(F.col("date").alias("before"), "asset", F.col("w").alias("v")).join(dates.filter("before is not null"), "before")
    both = now.join(was.select("date", "asset", "v"), ["date", "asset"], "full")
    first = dates.filter("before is null").select("date", F.lit(True).alias("first"))
    change = F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("v", F.lit(0.0)))
    return both.join(F.broadcast(first), "date", "left").groupBy("date").agg(F.sum(F.when(F.col("first"), 0.0).otherwise(change)).alias("turnover"))


def net_returns(panel: DataFrame, weights: DataFrame, cost_bps: float) -> DataFrame:
    """(date, ret): weights hold from the row after they are set until the next, on the dense calendar, less turnover costs.

    Assets that a rebalance date does not name hold nothing after it.
    """
    dates = weights.select("date").distinct().withColumn("rebalance", F.lit(True))
    grid = panel.select("asset", "date", "close").join(F.broadcast(dates), "date", "left").join(weights, ["date", "asset"], "left")
    known = F.last(F.when(F.col("rebalance"), F.coalesce("w", F.lit(0.0))), ignorenulls=True).over(by_asset().rowsBetween(Window.unboundedPreceding, 0))
    held = grid.withColumn("target", F.coalesce(known, F.lit(0.0)))
    held = held.withColumn("held", F.coalesce(F.lag("target").over(by_asset()), F.lit(0.0)))
    held = held.withColumn("change", F.abs(F.col("held") - F.coalesce(F.lag("held").over(by_asset()), F.col("held"))))
    ret = F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(by_asset())) - 1, F.lit(0.0))
    return held.withColumn("r", ret).groupBy("date").agg((F.sum(F.col("held") * F.col("r")) - F.sum("change") * (cost_bps / BPS)).alias("ret"))


def decile_long_short(scores: DataFrame, forward: DataFrame, decile: float = DECILE, least: int = 20, cost_bps: float = 10.0) -> DataFrame:
    """(date, gross, turnover, ret): means of the top and bottom names' next returns; turnover is the share of names changed."""
    ranked = _ranked(scores.join(forward.filter("fwd is not null").select("date", "asset"), ["date", "asset"])).filter(F.col("n") >= least)
    k = F.greatest(F.lit(2), F.floor(F.col("n") * decile))
    # the top of an ascending sort: ties at the top go to the later asset
    side = F.when(F.col("low") <= k, -1).when(F.col("low") > F.col("n") - k, 1)
    book = ranked.withColumn("side", side).filter("side is not null").join(forward, ["date", "asset"]).select("date", "asset", "side", "fwd")
    gross = book.groupBy("date").agg((F.avg(F.when(F.col("side") == 1, F.col("fwd"))) - F.avg(F.when(F.col("side") == -1, F.col("fwd")))).alias("gross"))
    return gross.join(changed_share(book), "date").select("date", "gross", "turnover", (F.col("gross") - F.col("turnover") * (cost_bps / BPS)).alias("ret"))


def changed_share(members: DataFrame) -> DataFrame:
    """(date, turnover): names in one of this and the previous set over names in either; 1 for the first set."""
    dates = members.select("date").distinct().withColumn("after", F.lead("date").over(Window.orderBy("date")))
    now = members.select("date", "asset").distinct()
    was = now.join(dates.filter("after is not null"), "date").select(F.col("after").alias("date"), "asset", F.lit(1).alias("old"))
    both = now.withColumn("new", F.lit(1)).join(was, ["date", "asset"], "full")
    return both.groupBy("date").agg((F.count_if(F.col("new").isNull() | F.col("old").isNull()) / F.count(F.lit(1))).alias("turnover"))


def cohort_book(scores: DataFrame, forward: DataFrame, nominal: DataFrame | None = None, least_price: float = 5.0, decile: float = DECILE, hold: int = HOLD, least: int = 20, cost_bps: float = 10.0) -> DataFrame:
    """(date, gross, turnover, ret) of overlapping cohorts: the book is the mean of the last ``hold`` cohorts formed.

    Decile sizes round half to even.  A month too thin to form a cohort keeps the old ones.  Turnover counts the names
    of the current book.  Returns are stamped with the month earned.
    """
    if nominal is not None:
        scores = scores.join(nominal.filter(F.col("close") >= least_price).select("date", "asset"), ["date", "asset"], "left_semi")
    ranked = _ranked(scores).filter(F.col("n") >= least)
    k = F.greatest(F.lit(1), F.bround(F.col("n") * decile).cast("int"))
    w = F.when(F.col("low") <= k, -0.5 / k).when(F.col("low") > F.col("n") - k, 0.5 / k).otherwise(0.0)
    cohorts = ranked.select("date", "asset", w.alias("w"))
    # months of the calendar and the number of cohorts formed by then
    months = forward.select("date").distinct()
    formed = cohorts.select("date").distinct().withColumn("cohort", F.row_number().over(Window.orderBy("date")))
    months = months.join(formed, "date", "left").withColumn("latest", F.max("cohort").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))).filter("latest is not null")
    months = months.withColumn("live", F.least("latest", F.lit(hold))).withColumn("k", F.row_number().over(Window.orderBy("date")))
    numbered = cohorts.join(formed, "date").select("cohort", "asset", "w")
    alive = months.select("date", "k", "live", F.explode(F.sequence(F.col("latest") - F.col("live") + 1, F.col("latest"))).alias("cohort"))
    book = alive.join(numbered, "cohort").groupBy("date", "k", "asset").agg((F.sum("w") / F.first("live")).alias("w"))
    was = book.select((F.col("k") + 1).alias("k"), "asset", F.col("w").alias("v"))
    rows = book.join(was, ["k", "asset"], "left").join(forward, ["date", "asset"], "left")
    out = rows.groupBy("date").agg(F.sum(F.col("w") * F.coalesce("fwd", F.lit(0.0))).alias("gross"), F.sum(F.abs(F.col("w") - F.coalesce("v", F.lit(0.0)))).alias("turnover"))
    return out.select(earned_month(F.col("date")).alias("date"), "gross", "turnover", (F.col("gross") - F.col("turnover") * (cost_bps / BPS)).alias("ret"))


def prior_score_book(scores: DataFrame, panel: DataFrame, top: float = TOP, cost_bps: float = 10.0, least: int = 10) -> DataFrame:
    """(date, ret): at each row the book ranks the row before's scores; names without a return count 0; costs on changes."""
    w = by_asset()
    lagged = scores.withColumn("score", F.lag("score").over(w))
    ranked = _ranked(lagged).filter(F.col("n") >= least)
    k = F.greatest(F.lit(2), F.floor(F.col("n") * top))
    weight = F.when(F.col("high") > F.col("n") - k, -0.5 / k).when(F.col("high") <= k, 0.5 / k).otherwise(0.0)
    book = ranked.select("date", "asset", weight.alias("w"))
    first = book.agg(F.min("date").alias("first"))  # one row
    change = turnover(book).join(F.broadcast(first)).join(book.groupBy("date").agg(F.sum(F.abs("w")).alias("size")), "date")
    change = change.select("date", F.when(F.col("date") == F.col("first"), F.col("size")).otherwise(F.col("turnover")).alias("turnover"))
    gross = net_returns(panel, book, 0.0)
    return gross.join(change, "date", "left").select("date", (F.col("ret") - F.coalesce("turnover", F.lit(0.0)) * (cost_bps / BPS)).alias("ret"))


def tercile_long_short(ranked: DataFrame, forward: DataFrame) -> DataFrame:
    """(date, ret, n): next returns of the top third less the bottom third by average percent rank."""
    both = ranked.join(forward.filter("fwd is not null"), ["date", "asset"])
    pct = average_rank("score", "date") / F.count(F.lit(1)).over(Window.partitionBy("date"))
    sided = both.filter("score is not null").withColumn("pct", pct)
    out = sided.groupBy("date").agg(F.avg(F.when(F.col("pct") > 2 / 3, F.col("fwd"))).alias("up"), F.avg(F.when(F.col("pct") <= 1 / 3, F.col("fwd"))).alias("down"), F.count(F.lit(1)).alias("n"))
    return out.filter("n >= 6").select("date", (F.col("up") - F.col("down")).alias("ret"), "n")


def rule_returns(series: DataFrame, cost_bps: float = 5.0, value: str = "level") -> DataFrame:
    """(date, ret) of a long/flat rule, held from the next row, with costs on every change; the first change is the position."""
    w = Window.orderBy("date")
    held = series.withColumn("r", F.col(value) / F.lag(value).over(w) - 1).withColumn("held", F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    change = F.coalesce(F.abs(F.col("held") - F.lag("held").over(w)), F.abs("held"))
    return held.select("date", "held", (F.col("held") * F.col("r") - change * (cost_bps / BPS)).alias("ret")).filter("ret is not null")


def exposure_matched(series: DataFrame, exposure: DataFrame, value: str = "level") -> DataFrame:
    """Buy and hold scaled to an average exposure (one row ``exposure``)."""
    r = F.col(value) / F.lag(value).over(Window.orderBy("date")) - 1
    return series.select("date", r.alias("r")).filter("r is not null").crossJoin(F.broadcast(exposure)).select("date", (F.col("r") * F.col("exposure")).alias("ret"))


def switching(series: DataFrame, cost_bps: float = 10.0) -> DataFrame:
    """(date, position, ret, net) of holding the market where the forecast is positive, else cash; costs multiply wealth."""
    w = Window.orderBy("date")
    s = series.withColumn("position", F.when(F.col("forecast") > 0, 1.0).otherwise(0.0))
    s = s.withColumn("change", F.coalesce(F.abs(F.col("position") - F.lag("position").over(w)), F.lit(0.0)))
    s = s.withColumn("ret", F.when(F.col("position") > 0, F.col("mkt")).otherwise(F.col("rf")))
    return s.select("date", "position", "ret", ((1 + F.col("ret")) * (1 - F.col("change") * (cost_bps / BPS)) - 1).alias("net"))


def fixed_hold(rets: DataFrame, weights: DataFrame) -> DataFrame:
    """(date, ret, wealth) of fixed weights rebalanced every row; missing returns count 0."""
    daily = rets.join(F.broadcast(weights), "asset").groupBy("date").agg(F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("ret"))
    return daily.select("date", "ret", wealth().alias("wealth"))


def wealth(by: str | None = None, ret: str = "ret") -> Column:
    w = (Window.partitionBy(by).orderBy("date") if by else Window.orderBy("date")).rowsBetween(Window.unboundedPreceding, 0)
    return F.exp(F.sum(F.log1p(ret)).over(w))


def drawdown(series: DataFrame, by: str | None = None) -> DataFrame:
    """Wealth path and its fall from the highest wealth so far, which starts at the first value."""
    w = (Window.partitionBy(by).orderBy("date") if by else Window.orderBy("date")).rowsBetween(Window.unboundedPreceding, 0)
    path = series.withColumn("wealth", wealth(by))
    return path.withColumn("drawdown", F.col("wealth") / F.max("wealth").over(w) - 1)


def windows(series: DataFrame, spans: DataFrame) -> DataFrame:
    """Wealth restarted in each named span (name, start, stop)."""
    inside = series.join(F.broadcast(spans), series["date"].between(spans["start"], spans["stop"]))
    return drawdown(inside.select("name", "date", "ret"), "name")
