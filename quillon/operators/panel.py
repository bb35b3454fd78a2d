"""Panels in long form (date, asset, value): calendars, alignment, returns, resampling and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows a missing price may be carried forward
FILL_LIMIT = 5
#: days after the fiscal date on which a filing without a date is taken to be known
FILING_LAG = 45


def by_asset(asset: str = "asset", date: str = "date"):
    return Window.partitionBy(asset).orderBy(date)


def trailing(n: int, asset: str = "asset", date: str = "date"):
    """The last n rows with this one."""
    return by_asset(asset, date).rowsBetween(-(n - 1), 0)


def scan(panel: DataFrame, assets: list, start: str, end: str, field: str = "close") -> DataFrame:
    """Filter by assets and dates on raw columns, so that both reach the scan, and keep one field."""
    return panel.filter(F.col("asset").isin(assets) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("date", "asset", field)


def dense(panel: DataFrame) -> DataFrame:
    """Every asset on every date of the panel's calendar, null where it has no row.

    The calendar is one row with an array, whose size is bounded by the number of dates, not of assets.
    """
    calendar = panel.agg(F.array_sort(F.collect_set("date")).alias("dates"))
    grid = panel.select("asset").distinct().crossJoin(F.broadcast(calendar)).select("asset", F.explode("dates").alias("date"))
    return grid.join(panel, ["asset", "date"], "left")


def normalized(df: DataFrame) -> DataFrame:
    """NaN to null in all floating columns: aggregates skip null but not NaN."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def filled(panel: DataFrame, limit: int | None = FILL_LIMIT, value: str = "close") -> DataFrame:
    """Carry values forward over at most ``limit`` rows; assets without any value go."""
    w = by_asset().rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    some = F.max(F.col(value).isNotNull()).over(Window.partitionBy("asset"))
    return panel.withColumn("__some", some).filter("__some").drop("__some").withColumn(value, F.last(value, ignorenulls=True).over(w))


def returns(panel: DataFrame, log: bool = False, pad: bool = False, value: str = "close") -> DataFrame:
    """(asset, date, ret) from one row to the next; ``pad`` carries missing prices forward first."""
    v = F.last(value, ignorenulls=True).over(by_asset().rowsBetween(Window.unboundedPreceding, 0)) if pad else F.col(value)
    padded = panel.withColumn("__v", v)
    before = F.lag("__v").over(by_asset())
    return padded.select("asset", "date", (F.log(F.col("__v") / before) if log else F.try_divide(F.col("__v"), before) - 1).alias("ret"))


def month_end(panel: DataFrame, value: str = "close") -> DataFrame:
    """The last value of each month that is not null, labelled with the calendar month end."""
    return panel.filter(F.col(value).isNotNull()).groupBy("asset", F.last_day("date").alias("date")).agg(F.max_by(value, "date").alias(value))


def calendar_month_ends(panel: DataFrame) -> DataFrame:
    """Dates of the panel that are calendar month ends: a month that ends on no panel date has none."""
    return panel.filter(F.col("date") == F.last_day("date")).select("date").distinct()


def forward_return(panel: DataFrame, horizon: int = 1, value: str = "close") -> DataFrame:
    """Return over the next ``horizon`` rows of the calendar."""
    return panel.select("asset", "date", (F.try_divide(F.lead(value, horizon).over(by_asset()), F.col(value)) - 1).alias("fwd"))


def earned_month(date: Column) -> Column:
    """The month end after a formation month: when the return is earned."""
    return F.last_day(F.add_months(date, 1))


def visible_from(filing_date: str = "filing_date", fiscal_date: str = "fiscal_date") -> Column:
    return F.coalesce(F.col(filing_date), F.date_add(fiscal_date, FILING_LAG))


def as_of(filings: DataFrame, date: str) -> DataFrame:
    """The latest filing of each ticker that is visible on a date; ties go to the later fiscal date, then the later id."""
    seen = filings.withColumn("visible", visible_from()).filter(F.col("visible") <= F.lit(date).cast("date"))
    w = Window.partitionBy("ticker").orderBy(F.desc("visible"), F.desc("fiscal_date"), F.desc("filing_id"))
    return seen.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def as_of_join(dates: DataFrame, facts: DataFrame, key: str, on: str, valid_from: str, order: list[str], strict: bool = False) -> DataFrame:
    """Latest fact of each key at each date: one sorted pass over the union of both, no range join.

    dates: (key, on, ...); facts: (key, valid_from, ...).  strict: facts of the same day are not seen yet.
    """
    struct = F.struct(*[c for c in facts.columns if c != key])
    left = dates.select(F.col(key), F.col(on).alias("__at"), F.lit(0 if strict else 1).alias("__kind"), F.struct(*dates.columns).alias("__row"), F.lit(None).cast(facts.select(struct.alias("s")).schema["s"].dataType).alias("__fact"))
    right = facts.select(F.col(key), F.col(valid_from).alias("__at"), F.lit(1 if strict else 0).alias("__kind"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), struct.alias("__fact"))
    keys = [F.col(f"__fact.{c}").asc_nulls_last() for c in order]
    w = Window.partitionBy(key).orderBy("__at", "__kind", *keys).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("__seen", F.last("__fact", ignorenulls=True).over(w)).filter("__row is not null")
    return both.select("__row.*", *[F.col(f"__seen.{c}") for c in facts.columns if c != key and c not in dates.columns])


def wide(panel: DataFrame, value: str = "close", assets: list | None = None) -> DataFrame:
    """Export shape: one column for each asset."""
    return panel.groupBy("date").pivot("asset", assets).agg(F.first(value)).orderBy("date")


def runs(df: DataFrame, flag: str, order: str, by: str | None = None) -> DataFrame:
    """Stretches of rows in a row where the flag holds: (start, stop, rows)."""
    key = [by] if by else []
    w = Window.partitionBy(*key).orderBy(order) if by else Window.orderBy(order)
    islands = df.withColumn("__i", F.row_number().over(w)).filter(F.col(flag)).withColumn("__g", F.col("__i") - F.row_number().over(w))
    return islands.groupBy(*key, "__g").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count(F.lit(1)).alias("rows")).drop("__g")
