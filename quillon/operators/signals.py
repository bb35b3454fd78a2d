"""Signals: (asset, date, score), higher is more bullish; windows count rows of the dense calendar."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillon.operators.panel import by_asset, trailing
from quillon.plans.shared import partitions

MIN_DAYS = 15


def momentum(panel: DataFrame, skip: int = 21, lookback: int = 252) -> DataFrame:
    w = by_asset()
    return panel.select("asset", "date", (F.try_divide(F.lag("close", skip).over(w) if skip else F.col("close"), F.lag("close", lookback).over(w)) - 1).alias("score"))


def reversal(panel: DataFrame, lookback: int = 21) -> DataFrame:
    return momentum(panel, 0, lookback)


def _full(value: Column, column: str, n: int, least: int | None = None) -> Column:
    return F.when(F.count(column).over(trailing(n)) >= (n if least is None else least), value)


def rolling(rets: DataFrame, n: int, how: str, least: int | None = None, column: str = "ret") -> DataFrame:
    """Trailing statistic of n rows: mean, std, var, max, min, sum; null below ``least`` values (default: all)."""
    f = {"mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "max": F.max, "min": F.min, "sum": F.sum}[how]
    return rets.select("asset", "date", _full(f(column).over(trailing(n)), column, n, least).alias("score"))


def max_return(rets: DataFrame, n: int = 21) -> DataFrame:
    return rolling(rets, n, "max")


def return_vol(rets: DataFrame, n: int = 252) -> DataFrame:
    return rolling(rets, n, "std")


def market(rets: DataFrame) -> DataFrame:
    """Equal-weighted mean over the assets that have a return."""
    return rets.groupBy("date").agg(F.avg("ret").alias("mkt"))


def beta(rets: DataFrame, n: int = 252, least: int | None = None) -> DataFrame:
    """Covariance of the pairs over the variance of the market in n rows."""
    w = trailing(n)
    both = rets.join(market(rets), "date")
    pair = F.when(F.col("ret").isNotNull() & F.col("mkt").isNotNull(), 1)
    slope = F.try_divide(F.covar_samp("ret", "mkt").over(w), F.when(F.count("mkt").over(w) >= (n if least is None else least), F.var_samp("mkt").over(w)))
    return both.select("asset", "date", "ret", "mkt", F.when(F.count(pair).over(w) >= (n if least is None else least), slope).alias("score"))


def idio_vol(rets: DataFrame, n: int = 252) -> DataFrame:
    """Volatility of what the trailing beta leaves."""
    resid = beta(rets, n).select("asset", "date", (F.col("ret") - F.col("score") * F.col("mkt")).alias("ret"))
    return rolling(resid, n, "std")


def coefficient_of_variation(level: DataFrame, n: int = 36, column: str = "ret") -> DataFrame:
    w = trailing(n)
    mean = F.avg(column).over(w)
    return level.select("asset", "date", _full(F.try_divide(F.stddev_samp(column).over(w), F.when(mean > 0, mean)), column, n).alias("score"))


def adjusted_skew(column: str) -> Column:
    """Sample skewness with the small-sample correction; null below three values."""
    n = F.count(column)
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def monthly_moments(rets: DataFrame, least: int = MIN_DAYS) -> DataFrame:
    """Within-month volatility and skewness of daily returns, negated, where a month has enough days."""
    some = F.count("ret") >= least
    return rets.groupBy("asset", F.last_day("date").alias("date")).agg(F.when(some, -F.stddev_samp("ret")).alias("vol"), F.when(some, -adjusted_skew("ret")).alias("skew"))


def idio_skew(rets: DataFrame, least: int = MIN_DAYS) -> DataFrame:
    """Skewness of what a within-month beta on the equal-weighted market leaves, negated."""
    both = rets.join(market(rets), "date").filter("mkt is not null").withColumn("month", F.last_day("date"))
    days = both.groupBy("month").agg(F.countDistinct("date").alias("days"), F.lit(1).alias("one"))
    var = both.select("month", "date", "mkt").distinct().groupBy("month").agg(F.var_samp("mkt").alias("var"))
    cov = both.groupBy("asset", "month").agg(F.covar_samp("ret", "mkt").alias("cov"))
    slope = cov.join(var.join(days, "month").filter(F.col("days") >= least).filter("var > 0"), "month").select("asset", "month", (F.col("cov") / F.col("var")).alias("slope"))
    resid = both.join(slope, ["asset", "month"]).select("asset", "month", (F.col("ret") - F.col("slope") * F.col("mkt")).alias("resid"))
    return resid.groupBy("asset", F.col("month").alias("date")).agg(F.when(F.count("resid") >= least, -adjusted_skew("resid")).alias("score")).filter("score is not null")


def residual_momentum(rets: DataFrame, form: int = 36, skip: int = 1, span: int = 12) -> DataFrame:
    """Mean over deviation of market-model residuals of months t-11 to t-1, the model fitted on the last ``form`` months."""
    both = rets.join(market(rets), "date")
    w = trailing(form)
    full = (F.count("ret").over(w) == form) & (F.count("mkt").over(w) == form)
    fitted = both.withColumn("slope", F.regr_slope("ret", "mkt").over(w)).withColumn("cut", F.regr_intercept("ret", "mkt").over(w))
    recent = F.collect_list(F.struct("ret", "mkt")).over(by_asset().rowsBetween(-(span - 1), -skip))
    fitted = fitted.withColumn("recent", recent).withColumn("full", full).withColumn("__row", F.row_number().over(by_asset()))
    # residuals of the window under this month's coefficients; the first full window is not scored
    resid = F.transform("recent", lambda x: x["ret"] - F.col("cut") - F.col("slope") * x["mkt"])
    n = span - skip
    fitted = fitted.filter("full").filter(F.col("__row") > form).withColumn("r", resid)
    mean = F.aggregate("r", F.lit(0.0), lambda a, x: a + x) / n
    fitted = fitted.withColumn("m", mean).withColumn("sd", F.sqrt(F.aggregate("r", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / (n - 1)))
    return fitted.select("asset", "date", F.try_divide("m", F.when(F.col("sd") > 0, F.col("sd"))).alias("score"))


def dollar_volume_variance(panel: DataFrame, n: int = 36, least: int | None = None) -> DataFrame:
    """Sample variance of the traded value (price times volume) over n rows; null below ``least`` values (default: all)."""
    return rolling(panel.select("asset", "date", (F.col("close") * F.col("volume")).alias("ret")), n, "var", least)


def share_turnover(panel: DataFrame, shares: DataFrame) -> DataFrame:
    """Volume over the share count known at the time: the last one on or before the date, without limit."""
    known = F.last("shares", ignorenulls=True).over(by_asset().rowsBetween(Window.unboundedPreceding, 0))
    both = panel.select("asset", "date", "volume").join(shares, ["asset", "date"], "left").withColumn("shares", known)
    return both.select("asset", "date", F.try_divide("volume", "shares").alias("ret"))


def ewm(values: DataFrame, span: int, column: str = "ret", name: str = "ewm") -> DataFrame:
    """Exponentially weighted mean with the recursive rule, null until the first value, nulls passed over.

    Weights of passed-over rows still decay.  Rows are dealt by asset and sorted; one pass carries each asset's mean and
    weight from row to row, so the work is linear and the state two numbers.
    """
    alpha = 2.0 / (span + 1)
    dealt = values.repartition(partitions(values.sparkSession), "asset").sortWithinPartitions("asset", "date")

    def run(batches):
        asset, mean, weight = object(), None, 1.0
        for batch in batches:
            out = []
            for a, x in zip(batch.column("asset").to_pylist(), batch.column(column).to_pylist(), strict=True):
                if a != asset:
                    asset, mean, weight = a, None, 1.0
                if mean is None:
                    mean = None if x is None else float(x)
                else:
                    weight *= 1 - alpha
                    if x is not None:
                        mean, weight = (weight * mean + alpha * x) / (weight + alpha), 1.0
                out.append(mean)
            yield batch.append_column(name, pa.array(out, pa.float64()))

    return dealt.mapInArrow(run, StructType([*dealt.schema.fields, StructField(name, DoubleType())]))


def macd(panel: DataFrame, n: int = 20, sensitivity: float = 0.9) -> DataFrame:
    """Volatility-weighted price oscillator: fast minus slow mean of a weighted price, against its own mean."""
    w = by_asset()
    diff = panel.select("asset", "date", "close", (F.col("close") - F.lag("close").over(w)).alias("d"))
    sigma = F.when(F.count(F.abs("d")).over(trailing(n)) >= 2, F.stddev_samp(F.abs("d")).over(trailing(n))) / F.nullif("close", F.lit(0.0))
    term = diff.withColumn("t", F.col("close") * sigma * F.signum("d"))
    star = term.select("asset", "date", F.when(F.count("t").over(trailing(n)) >= n // 2, F.sum("t").over(trailing(n)) / n).alias("ret"))
    line = ewm(ewm(star, 12, name="fast"), 26, name="slow").select("asset", "date", (F.col("fast") - F.col("slow")).alias("ret"))
    return ewm(line, 9, name="mean").select("asset", "date", (F.col("ret") - sensitivity * F.col("mean")).alias("score"))


def hashed_uniform(*parts: Column | str) -> Column:
    """A uniform number in (0, 1) that depends on the parts alone."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def random_signal(panel: DataFrame, seed: int = 0) -> DataFrame:
    """An adversarial control: noise wherever there is a price."""
    return panel.select("asset", "date", F.when(F.col("close").isNotNull(), hashed_uniform("asset", "date", F.lit(seed))).alias("score"))


def sell_in_may(series: DataFrame) -> DataFrame:
    """Long November to April."""
    m = F.month("date")
    return series.withColumn("position", F.when((m >= 11) | (m <= 4), 1.0).otherwise(0.0))


def average_cross(fast: int = 50, slow: int = 200, value: str = "level") -> Callable[[DataFrame], DataFrame]:
    """Long while the fast moving average is above the slow one; both need full windows."""

    def rule(series: DataFrame) -> DataFrame:
        def mean(n: int) -> Column:
            w = Window.orderBy("date").rowsBetween(-(n - 1), 0)
            return F.when(F.count(value).over(w) == n, F.avg(value).over(w))

        return series.withColumn("position", F.coalesce(F.when(mean(fast) > mean(slow), 1.0), F.lit(0.0)))

    return rule


def rolling_product(series: DataFrame, months: int, ret: str = "ret") -> DataFrame:
    """Compound return of the last ``months`` rows, null before there are as many; series: (date, ret)."""
    w = Window.orderBy("date").rowsBetween(-(months - 1), 0)
    return series.withColumn("compound", F.when(F.count(ret).over(w) == months, F.exp(F.sum(F.log1p(ret)).over(w)) - 1))


def momentum_switch(series: DataFrame, months: int, cost: float = 0.0) -> DataFrame:
    """(date, position, ret) of holding the market when the last ``months`` rows before were up, else cash; series: (date, mkt, rf)."""
    w = Window.orderBy("date")
    held = rolling_product(series, months, "mkt").withColumn("before", F.lag("compound").over(w)).filter("before is not null").withColumn("position", (F.col("before") > 0).cast("double"))
    switched = F.coalesce(F.abs(F.col("position") - F.lag("position").over(w)), F.lit(0.0))
    gross = F.col("position") * F.col("mkt") + (1 - F.col("position")) * F.col("rf")
    return held.withColumn("switched", switched).select("date", "position", ((1 + gross) * (1 - cost * F.col("switched")) - 1).alias("ret"))


def _of_returns(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A signal of the panel from a function of its returns."""

    def run(panel: DataFrame) -> DataFrame:
        rets = panel.select("asset", "date", (F.col("close") / F.lag("close").over(by_asset()) - 1).alias("ret"))
        return f(rets).select("asset", "date", "score")

    return run


#: registry by name: a function of the dense panel and the published direction; windows are counted in the panel's rows
SIGNALS: dict[str, tuple[Callable[[DataFrame], DataFrame], int]] = {
    "mom12m": (lambda p: momentum(p, 1, 12), 1),
    "mom6m": (lambda p: momentum(p, 1, 6), 1),
    "strev": (lambda p: reversal(p, 1), -1),
    "maxret": (_of_returns(lambda r: max_return(r, 12)), -1),
    "retvol": (_of_returns(lambda r: return_vol(r, 12)), -1),
    "idiovol": (_of_returns(lambda r: idio_vol(r, 24)), -1),
    "beta": (_of_returns(lambda r: beta(r, 24)), 1),
}


def directed(name: str, panel: DataFrame, sign: int | None = None) -> DataFrame:
    """A registered signal times its published sign; sign 0 or none counts as 1."""
    f, own = SIGNALS[name]
    s = own if sign is None else sign
    return f(panel).withColumn("score", F.col("score") * (s or 1))
