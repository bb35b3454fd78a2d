"""Live forms of what the batch operators do over whole tables: bounded staleness, and changes joined to the snapshots around them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from quillon.operators.panel import FILL_LIMIT
from quillon.operators.scoring import judged

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class CarryForward(StatefulProcessor):
    """One asset's rows in order of dates, each with the last price if that is at most ``limit`` rows old.

    Rows wait until the watermark has passed their date, as earlier ones may still come.  A timer on the first waiting date hands
    them out; several rows of a date are one, with the last price that is not null.  State is the waiting rows and one price with its age;
    the price is dropped as soon as it is too old, so an asset that trades no more keeps nothing.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("value", T.DoubleType()), T.StructField("age", T.IntegerType())]))
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("at", T.LongType()), T.StructField("value", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for frame in rows:
            at = (pd.to_datetime(frame["time"]).dt.tz_localize(None) - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1)
            fresh += [(int(t), None if pd.isna(v) else float(v)) for t, v in zip(at, frame["value"], strict=True)]
        if fresh:
            self.waiting.appendList(fresh)
            self.arm(min(t for t, _ in fresh), timerValues.getCurrentWatermarkInMs())
        yield from ()

    def arm(self, first: int, watermark: int) -> None:
        """One timer, for the first row that waits."""
        timers = list(self.handle.listTimers())
        at = max(first, watermark + 1)
        if not timers or at < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        due: dict[int, float | None] = {}
        later = []
        for at, value in self.waiting.get():
            if at > watermark:
                later.append((at, value))
            elif value is not None or at not in due:
                due[at] = value
        held = self.last.get() if self.last.exists() else None
        value, age = (held[0], held[1]) if held else (None, 0)
        out = []
        for at in sorted(due):
            value, age = (due[at], 0) if due[at] is not None else (value, age + 1)
            if age > self.limit:
                value = None
            out.append((key[0], pd.Timestamp(at, unit="ms"), value))
        if value is None:
            self.last.clear()
        else:
            self.last.update((value, age))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(max(min(t for t, _ in later), watermark + 1))
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=["asset", "time", "value"])

    def close(self) -> None:
        pass


def carried(ticks: DataFrame, limit: int = FILL_LIMIT, asset: str = "asset", time: str = "date", value: str = "close", late: str = "2 days") -> DataFrame:
    """(asset, time, value) of a stream of rows of a calendar, whose value is null where there is no price.

    Rows that come after the watermark has passed their date are dropped, as their date has been given out.
    """
    spark = ticks.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)  # the state that has timers is kept there only
    rows = ticks.select(F.col(asset).cast("string").alias("asset"), F.col(time).cast("timestamp").alias("time"), F.col(value).cast("double").alias("value")).withWatermark("time", late)
    return rows.groupBy("asset").transformWithStateInPandas(CarryForward(limit), "asset string, time timestamp, value double", "append", "eventTime")


def around(changes: DataFrame, log: DataFrame, before: int, after: int, late: str = "1 day", keep: int = 3) -> DataFrame:
    """(change_ts, ref, pre, post) of streams of changes (ts, ref) and of log rows (ts, loss).

    An interval join brings each change the snapshots that lie up to ``before`` days earlier (or at the same time) and up to ``after`` days
    later; an aggregate then keeps the last one before and the first ``keep`` after it.  Both sides are dealt by blocks of time, of which a change
    meets two or three.  Watermarks bound the state: a side waits for as long as the interval says, and a change is given out once no snapshot of
    its interval can come any more.  Changes without any snapshot on one of the sides are left out.
    """
    day = 86_400
    size = (before + after) * day
    seconds = F.col("ts").cast("timestamp").cast("double")
    block = lambda at: F.floor(at / size)
    left = changes.select(F.col("ts").alias("change_ts"), "ref", F.explode(F.sequence(block(seconds - before * day), block(seconds + after * day))).alias("change_block")).withWatermark("change_ts", late)
    right = log.select(F.col("ts").alias("log_ts"), "loss", block(seconds).alias("log_block")).withWatermark("log_ts", late)
    near = (F.col("log_ts") >= F.col("change_ts") - F.expr(f"INTERVAL {before} DAYS")) & (F.col("log_ts") <= F.col("change_ts") + F.expr(f"INTERVAL {after} DAYS"))
    met = left.join(right, (F.col("change_block") == F.col("log_block")) & near)
    # snapshots without a loss are left out here: a filter would reach below the watermark, which their time should move
    known = F.col("loss").isNotNull()
    earlier, follows = known & (F.col("log_ts") <= F.col("change_ts")), known & (F.col("log_ts") > F.col("change_ts"))
    pre = F.max_by("loss", F.when(earlier, F.col("log_ts")))
    # as many as the interval has snapshots
    later = F.array_sort(F.collect_list(F.when(follows, F.struct("log_ts", "loss"))))
    grouped = met.groupBy("change_ts", "ref").agg(pre.alias("pre"), F.count_if(earlier).alias("earlier"), F.transform(F.slice(later, 1, keep), lambda x: x["loss"]).alias("post"))
    return grouped.filter((F.col("earlier") > 0) & (F.size("post") > 0)).drop("earlier")


def attributed(met: DataFrame) -> DataFrame:
    """(ref, fired, mean_delta, verdict) of what ``around`` gave out."""
    delta = F.aggregate("post", F.lit(0.0), lambda a, x: a + x) / F.size("post") - F.col("pre")
    return judged(met.select("ref", delta.alias("delta")))


def refs(message: Column) -> Column:
    """The rules that a change's message cites."""
    return F.explode(F.regexp_extract_all(message, F.lit(r"critique:([A-Za-z0-9_-]+)"), F.lit(1)))
