"""Queued published signals, each in its published direction: higher is more bullish.

Panels are monthly and dense (asset, date, close, volume); a score is null where its window is not full.  All windows of
``by_history`` run over one exchange by asset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import moments
from quillon.operators.panel import by_asset, trailing

YEAR = 12
SEASONS = tuple(YEAR * k - 1 for k in range(2, 6))


def _moved(skip: int, lookback: int) -> Column:
    return F.try_divide(F.lag("close", skip).over(by_asset()), F.lag("close", lookback).over(by_asset())) - 1


def _logarithm(x: Column) -> Column:
    return F.ln(F.when(x > 0, x))


def by_history(panel: DataFrame) -> DataFrame:
    """(asset, date, one column a signal) from each asset's own prices and volumes.

    intermediate: return from twelve to six rows ago; long_reversal: less that from 60 to 13 rows ago; season: mean
    return of the coming calendar month in years two to five; off_season: less the mean of those years' other rows;
    cheap: less the log price; high: price over the year's highest; illiquid: the year's mean of absolute return over
    traded value; quiet: less the log of traded value two rows ago; managed: return over the year's variance before it.
    """
    w, year = by_asset(), trailing(YEAR)
    value = F.col("close") * F.col("volume")
    rows = panel.select("asset", "date", "close", value.alias("value"), (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("ret"))
    rows = rows.withColumn("impact", F.try_divide(F.abs("ret"), "value"))
    seasons = sum((F.lag("ret", k).over(w) for k in SEASONS[1:]), F.lag("ret", SEASONS[0]).over(w))
    span = by_asset().rowsBetween(-SEASONS[-1], -YEAR)
    length = SEASONS[-1] - YEAR + 1
    before = by_asset().rowsBetween(-YEAR, -1)
    full = lambda column, over, n, score: F.when(F.count(column).over(over) == n, score)
    return rows.select(
        "asset", "date", _moved(YEAR // 2, YEAR).alias("intermediate"), (-_moved(13, 60)).alias("long_reversal"), (seasons / len(SEASONS)).alias("season"),
        full("ret", span, length, -(F.sum("ret").over(span) - seasons) / (length - len(SEASONS))).alias("off_season"), (-_logarithm(F.col("close"))).alias("cheap"),
        full("close", year, YEAR, F.try_divide(F.col("close"), F.max("close").over(year))).alias("high"), full("impact", year, YEAR, F.avg("impact").over(year)).alias("illiquid"),
        (-_logarithm(F.lag("value", 2).over(w))).alias("quiet"), full("ret", before, YEAR, F.try_divide(F.col("ret"), F.var_samp("ret").over(before))).alias("managed"),
    )


def standardized(column: str) -> Column:
    """z-score within a date; null where the date's scores do not vary."""
    w = Window.partitionBy("date")
    return F.try_divide(F.col(column) - F.avg(column).over(w), F.stddev_samp(column).over(w))


def momentum_and_reversal(panel: DataFrame) -> DataFrame:
    """Winners of six rows that lost over the long run: z-score of the one less that of the other."""
    both = panel.select("asset", "date", _moved(0, 6).alias("near"), _moved(13, 60).alias("far"))
    return both.select("asset", "date", (standardized("near") - standardized("far")).alias("score"))


def industry_momentum(panel: DataFrame, sectors: DataFrame) -> DataFrame:
    """The mean six-row return of an asset's sector, skipping none; sectors: (asset, sector), small enough to broadcast by Spark's own rule."""
    moved = panel.select("asset", "date", _moved(0, 6).alias("near")).join(sectors, "asset")
    return moved.select("asset", "date", F.avg("near").over(Window.partitionBy("sector", "date")).alias("score"))


def coskewness(rets: DataFrame, n: int = 36) -> DataFrame:
    """Less the standardized covariance of return and squared market, both centred in n rows; rets: (asset, date, ret)."""
    w = trailing(n)
    market = rets.groupBy("date").agg(F.avg("ret").alias("m"))
    both = rets.join(market, "date").select("asset", "date", F.when(F.col("m").isNotNull(), F.col("ret")).alias("r"), F.when(F.col("ret").isNotNull(), F.col("m")).alias("m"))
    mean = lambda x: F.avg(x).over(w)
    r, m = F.col("r"), F.col("m")
    third = mean(r * m * m) - mean(r) * mean(m * m) - 2 * mean(m) * mean(r * m) + 2 * mean(r) * mean(m) * mean(m)
    var_r, var_m = mean(r * r) - mean(r) * mean(r), mean(m * m) - mean(m) * mean(m)
    score = F.when((var_r > 0) & (var_m > 0), -third / (F.sqrt(var_r) * var_m))
    return both.select("asset", "date", F.when(F.count("r").over(w) == n, score).alias("score"))


def traded(panel: DataFrame) -> DataFrame:
    """(asset, date, ret, value): return from the row before and traded value."""
    return panel.select("asset", "date", (F.try_divide(F.col("close"), F.lag("close").over(by_asset())) - 1).alias("ret"), (F.col("close") * F.col("volume")).alias("value"))


def market_states(rows: DataFrame) -> DataFrame:
    """(date, m, m1 .. m4, liquidity, volatility, tail) of ``traded`` rows: the market's return and its lags, and what betas are taken to.

    liquidity: change of the log of the mean of absolute return over traded value; volatility: change of the year's deviation of the market;
    tail: mean log of how far the lowest twentieth of the returns of the row before lay beyond their edge.
    """
    rows = rows.filter("ret is not null")
    edges = rows.groupBy("date").agg(F.percentile("ret", F.lit(0.05)).alias("edge"))
    beyond = F.when((F.col("ret") < F.col("edge")) & (F.col("edge") < 0), F.ln(F.col("ret") / F.col("edge")))
    # one row a date
    dates = rows.join(F.broadcast(edges), "date").groupBy("date").agg(F.avg("ret").alias("m"), F.avg(F.try_divide(F.abs("ret"), "value")).alias("impact"), F.avg(beyond).alias("tail"))
    w = Window.orderBy("date")
    year = w.rowsBetween(-(YEAR - 1), 0)
    rows = dates.withColumn("deviation", F.when(F.count("m").over(year) == YEAR, F.stddev_samp("m").over(year)))
    change = lambda x: x - F.lag(x).over(w)
    return rows.select("date", "m", *[F.lag("m", k).over(w).alias(f"m{k}") for k in range(1, 5)], change(_logarithm(F.col("impact"))).alias("liquidity"), change(F.col("deviation")).alias("volatility"), F.lag("tail").over(w).alias("tail"))


#: models of ``exposures``
MODELS = {"lagged": ["m", "m1", "m2", "m3", "m4"], "one": ["m"], "liquidity": ["m", "liquidity"], "volatility": ["m", "volatility"], "tail": ["m", "tail"]}


def exposures(rets: DataFrame, states: DataFrame, n: int = 36) -> DataFrame:
    """(asset, date, delay, liquidity, volatility, tail) from regressions over the n rows before each date.

    delay: less the part of what the market and its four lags explain that the market alone does; the others are the slopes beside the market's, those of volatility
    with the opposite sign.  rets has every asset on every date, so assets share their predictors: a model's normal equations are solved once a date,
    and of an asset only the products of its returns with the states are summed, in one pass.
    """
    models = states.select("date")
    for name, predictors in MODELS.items():
        solved = moments.inverses(moments.running(states, predictors, n, "m", own=True), len(predictors)).withColumnRenamed("inverse", f"{name}_inverse")
        models = models.join(solved, "date", "left")
    used = sorted({x for predictors in MODELS.values() for x in predictors})
    # about their means over all dates, so that little is lost where a window's mean is taken off the sums
    near = states.crossJoin(F.broadcast(states.agg(*[F.avg(x).alias(f"__{x}") for x in used]))).select("date", *[(F.col(x) - F.col(f"__{x}")).alias(x) for x in used])
    models = models.join(near.select("date", *[F.avg(x).over(Window.orderBy("date").rowsBetween(-n, -1)).alias(f"mean_{x}") for x in used]), "date")
    over = by_asset().rowsBetween(-n, -1)
    rows = rets.select("asset", "date", F.when(~F.isnan("ret"), F.col("ret")).alias("y")).join(F.broadcast(near), "date")
    rows = rows.select("asset", "date", "y", *[(F.col("y") * F.col(x)).alias(f"y_{x}") for x in used])
    sums = rows.select("asset", "date", F.count("y").over(over).alias("n"), F.sum("y").over(over).alias("y"), (n * F.var_pop("y").over(over)).alias("yy"), *[F.sum(f"y_{x}").over(over).alias(f"y_{x}") for x in used])
    fitted = sums.filter(F.col("n") == n).join(F.broadcast(models.filter("lagged_inverse is not null")), "date")
    fitted = fitted.withColumns({f"y_{x}": F.col(f"y_{x}") - F.col(f"mean_{x}") * F.col("y") for x in used})

    def slope(model: str, k: int) -> Column:
        return sum((F.get(F.get(f"{model}_inverse", F.lit(k)), F.lit(j)) * F.col(f"y_{x}") for j, x in enumerate(MODELS[model])), F.lit(0.0))

    def r2(model: str) -> Column:
        return F.when(F.col("yy") > 0, sum((slope(model, k) * F.col(f"y_{x}") for k, x in enumerate(MODELS[model])), F.lit(0.0)) / F.col("yy"))

    return fitted.select("asset", "date", (1 - F.try_divide(r2("one"), r2("lagged"))).alias("delay"), slope("liquidity", 1).alias("liquidity"), (-slope("volatility", 1)).alias("volatility"), slope("tail", 1).alias("tail"))


def conditional_momentum(panel: DataFrame, sectors: DataFrame) -> DataFrame:
    """(asset, date, busy, young, leaders, unseasonal): momentum among some assets only, of others, or without a month.

    busy: the six-row return where traded value is in the date's top third; young: the twelve-row one where the asset has no more rows than the
    date's median; leaders: the last return of the largest third of the asset's sector by traded value, for assets outside it; unseasonal: mean return of the last eleven
    rows, which leaves out the month a year before the next.
    """
    w, date = by_asset(), Window.partitionBy("date")
    rows = panel.select("asset", "date", "close", (F.col("close") * F.col("volume")).alias("value"), _moved(0, 6).alias("six"), _moved(0, YEAR).alias("twelve"), (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("ret"))
    rows = rows.withColumn("age", F.count("close").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    eleven = by_asset().rowsBetween(-(YEAR - 2), 0)
    rows = rows.withColumn("unseasonal", F.when(F.count("ret").over(eleven) == YEAR - 1, F.avg("ret").over(eleven))).filter("value is not null").join(sectors, "asset")
    place = lambda over: F.row_number().over(over.orderBy(F.desc("value"), "asset")) * 3 <= F.count(F.lit(1)).over(over)
    sector = Window.partitionBy("sector", "date")
    rows = rows.withColumn("top", place(date)).withColumn("big", place(sector)).withColumn("median_age", F.percentile("age", F.lit(0.5)).over(date))
    leaders = F.avg(F.when(F.col("big"), F.col("ret"))).over(sector)
    return rows.select("asset", "date", F.when(F.col("top"), F.col("six")).alias("busy"), F.when(F.col("age") <= F.col("median_age"), F.col("twelve")).alias("young"), F.when(~F.col("big"), leaders).alias("leaders"), "unseasonal")
