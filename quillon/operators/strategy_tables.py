"""Tables of switching strategies by model, subset size and period, from one long table of forecasts.

A strategy holds the market where its forecast is positive, else cash.  All strategies are rows (model, k, date); all periods that a table reports,
the whole sample and named windows in it, are rows too.  Wealth, its peak and the switches are running sums within (model, k, span), so they begin
anew in each span, and one aggregation gives the figures of all cells.  The first decision of a span is no switch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import resamples
from quillon.operators.books import BPS

COST_BPS = 10.0
MONTHS = 12
COLUMNS = ("TW", "AV", "SD", "SR", "MDD")
WHOLE = "all"


def momentum_forecasts(market: DataFrame, spans: Sequence[int], value: str = "mkt", order: str = "date") -> DataFrame:
    """(model, date, forecast): for each date the return of the ``n`` rows before it, compounded."""
    rows = market.select(order, *[_compounded(value, n, order).alias(f"m{n}") for n in spans])
    cells = F.array(*[F.struct(F.lit(f"Momentum {n}-month").alias("model"), F.col(f"m{n}").alias("forecast")) for n in spans])
    return rows.select(F.col(order).alias("date"), F.explode(cells).alias("c")).select("c.model", "date", "c.forecast")


def _compounded(value: str, n: int, order: str) -> Column:
    w = Window.orderBy(order).rowsBetween(-n, -1)
    return F.when(F.count(value).over(w) == n, F.exp(F.sum(F.log1p(value)).over(w)) - 1)


def repeated(benchmarks: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Benchmarks, which have no subset size, in the panel of each."""
    return benchmarks.withColumn("k", F.explode(F.array(*map(F.lit, ks))))


def paths(forecasts: DataFrame, market: DataFrame, spans: Sequence[tuple[str, str, str]] = (), cost_bps: float = COST_BPS) -> DataFrame:
    """(model, k, span, date, rf, equity, switched, ret, wealth, fall) of forecasts (model, k, date, forecast) and (date, mkt, rf).

    spans: (name, first date, last date); the whole sample is span ``all``.  Dates without a forecast are in no path.
    """
    named = [F.struct(F.lit(WHOLE).alias("span"), F.lit(None).cast("date").alias("first"), F.lit(None).cast("date").alias("last"))]
    named += [F.struct(F.lit(n).alias("span"), F.lit(a).cast("date").alias("first"), F.lit(b).cast("date").alias("last")) for n, a, b in spans]
    rows = forecasts.filter("forecast is not null").join(market.select("date", "mkt", "rf"), "date").select("*", F.explode(F.array(*named)).alias("s"))
    rows = rows.filter("s.first is null or date between s.first and s.last").select("model", "k", "s.span", "date", "mkt", "rf", (F.col("forecast") > 0).alias("equity"))
    w = Window.partitionBy("model", "k", "span").orderBy("date")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    step = rows.withColumn("switched", F.coalesce(F.col("equity") != F.lag("equity").over(w), F.lit(False))).withColumn("ret", F.when(F.col("equity"), F.col("mkt")).otherwise(F.col("rf")))
    cost = F.when(F.col("switched"), F.log1p(F.lit(-cost_bps / BPS))).otherwise(F.lit(0.0))
    held = step.withColumn("wealth", F.exp(F.sum(F.log1p("ret") + cost).over(up_to)))
    return held.select("model", "k", "span", "date", "rf", "equity", "switched", "ret", "wealth", (1 - F.col("wealth") / F.max("wealth").over(up_to)).alias("fall"))


def table(wealth_paths: DataFrame, months: int = MONTHS) -> DataFrame:
    """(model, k, span, n, TW, AV, SD, SR, MDD, switches): terminal wealth of 1, mean and deviation in percent a year, mean excess
    over deviation a row (null where nothing varies, as when only cash is held), deepest fall as a fraction."""
    deviation = F.stddev_samp("ret")
    return wealth_paths.groupBy("model", "k", "span").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("wealth", "date").alias("TW"), (F.avg("ret") * months * 100).alias("AV"), (deviation * F.sqrt(F.lit(months)) * 100).alias("SD"),
        F.when(deviation > 0, F.avg(F.col("ret") - F.col("rf")) / deviation).alias("SR"), F.max("fall").alias("MDD"), F.count_if("switched").alias("switches"),
    )


def shaped(figures: DataFrame, rows: Sequence[str], ks: Sequence[int], span: str = WHOLE, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """The printed layout: the named rows in order, five columns for each k; a row that is not computed is there and empty."""
    spark = figures.sparkSession
    cells = figures.filter((F.col("span") == span) & F.col("k").isin(list(ks))).groupBy("model").pivot("k", list(ks)).agg(*[F.first(c).alias(c) for c in columns])
    cells = cells.select("model", *[F.col(f"{k}_{c}").alias(f"k{k}_{c}") for k in ks for c in columns])
    names = spark.createDataFrame([(place, r) for place, r in enumerate(rows)], "place int, model string")
    return names.join(cells, "model", "left").select("place", "model", *[f"k{k}_{c}" for k in ks for c in columns])


def errors(forecasts: DataFrame, actuals: DataFrame, bench: str) -> DataFrame:
    """(model, k, n, r2_squared, r2_absolute, mse, mae): out-of-sample R2 in percent against a model of each k, and mean losses times 100.

    actuals: (date, actual).  Only dates of the benchmark count.
    """
    both = forecasts.join(actuals, "date").filter("forecast is not null and actual is not null")
    base = both.filter(F.col("model") == bench).select("k", "date", (F.col("actual") - F.col("forecast")).alias("b"))
    e, b = F.col("actual") - F.col("forecast"), F.col("b")
    r2 = lambda f: 100 * (1 - F.try_divide(F.sum(f(e)), F.sum(f(b))))
    square = lambda x: x * x
    return both.join(base, ["k", "date"]).groupBy("model", "k").agg(F.count(F.lit(1)).alias("n"), r2(square).alias("r2_squared"), r2(F.abs).alias("r2_absolute"), (100 * F.avg(e * e)).alias("mse"), (100 * F.avg(F.abs(e))).alias("mae"))


def loss_sets(forecasts: DataFrame, actuals: DataFrame, draws: int = 5000) -> DataFrame:
    """(k, loss, model, mse, p_value): a confidence set for each subset size under squared and absolute loss, all at once."""
    e = F.col("actual") - F.col("forecast")
    each = F.array(F.struct(F.lit("squared").alias("kind"), (e * e).alias("value")), F.struct(F.lit("absolute").alias("kind"), F.abs(e).alias("value")))
    rows = forecasts.join(actuals, "date").select("k", "model", "date", F.explode(each).alias("c"))
    return resamples.confidence_sets(rows.select("k", F.col("c.kind").alias("kind"), "model", "date", F.col("c.value").alias("loss")), ["k", "kind"], draws)
