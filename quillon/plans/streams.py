"""Queries over streams, drained to the end."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import panel as P
from quillon.plans import shared
from quillon.plans.panels import rounded
from quillon.plans.registry import query
from quillon.plans.scores import LOG, log
from quillon.sources import upserts
from quillon.sources import views as V
from quillon.sources.views import sql
from quillon.streaming import feeds, live


def stream(spark, folder, name):
    """A table as a stream: a folder of part files, or one file picked out of the folder of tables."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


BARS = "SELECT date_trunc('day', ts)::DATE AS day, event_type, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, round(sum(value), 4) AS volume, count(*) AS n FROM events GROUP BY 1, 2"


def events(spark, folder):
    return V.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(BARS)
def event_bars_stream(spark, folder):
    e = stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    bars = feeds.drained(feeds.bars(feeds.closed(e, events(spark, folder), "ts", "4 DAYS")), "bars")
    return rounded(bars.withColumn("day", F.to_date("start")).drop("start"), "volume", digits=4)


@query("SELECT event_type, count(DISTINCT user_id) AS new, count(*) - count(DISTINCT user_id) AS dup, count(*) AS total FROM events GROUP BY 1")
def ingest_stream(spark, folder):
    """Users of each type of event that the feed lets through, each once, and the rows it drops."""
    e = stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    taken = feeds.drained(feeds.ingest_stream(e.select("event_type", "user_id", "ts"), ["event_type", "user_id"], "ts", "3650 days"), "ingest")
    total = events(spark, folder).groupBy("event_type").agg(F.count(F.lit(1)).alias("total"))
    new = taken.groupBy("event_type").agg(F.count(F.lit(1)).alias("new"))
    return total.join(new, "event_type").select("event_type", "new", (F.col("total") - F.col("new")).alias("dup"), "total")


@query(BARS)
def event_bars(spark, folder):
    e = V.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(feeds.bars(e).withColumn("day", F.to_date("start")).drop("start"), "volume", digits=4)


@query("WITH g AS (SELECT user_id, ts, value, (ts > lag(ts) OVER w + INTERVAL 6 HOURS OR lag(ts) OVER w IS NULL)::INTEGER AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts)::TIMESTAMP AS start, max(ts)::TIMESTAMP + INTERVAL 6 HOURS AS stop, count(*) AS n, round(sum(value), 6) + 0.0::DOUBLE AS value FROM s GROUP BY user_id, k")
def user_sessions(spark, folder):
    return rounded(feeds.sessions(events(spark, folder), "6 hours"))


def in_order(spark, df, name, parts, by, end=None):
    """A folder of files written one after the other, each later in ``by`` than the one before, as a stream of one file at a time.

    end: a last file has a row of nulls so much later, which passes the watermark over all others.
    """
    folder = f"{shared.scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    kept = shared.staged(df, name)
    edges = kept.agg(F.percentile_approx(F.col(by).cast("timestamp").cast("long"), F.array(*[F.lit(k / parts) for k in range(1, parts)])).alias("e")).first()["e"]
    at = F.col(by).cast("timestamp").cast("long")
    edges = sorted(set(edges or []))
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = kept.filter((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        part.coalesce(1).write.mode("append").parquet(folder)
    if end:
        last = kept.agg((F.max(by) + F.expr(f"INTERVAL {end}")).alias(by))
        last.select(*[F.col(by) if f.name == by else F.lit(None).cast(f.dataType).alias(f.name) for f in kept.schema]).write.mode("append").parquet(folder)
    return spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query(sql("dense_day", "SELECT asset, date, round(last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 9) AS close FROM dense_day"))
def live_fill(spark, folder):
    """Prices carried over five dates by keyed state, from a stream of the calendar in six files."""
    ticks = P.dense(V.brand_day(spark, folder)).withColumn("date", F.col("date").cast("timestamp"))
    filled = feeds.drained(live.carried(in_order(spark, ticks, "ticks", 6, "date", "30 DAYS")), "live-fill")
    return rounded(filled.filter("asset is not null").select("asset", F.to_date("time").alias("date"), F.col("value").alias("close")), digits=9)


@query(f"WITH {LOG}, n AS (SELECT *, row_number() OVER (ORDER BY ts) AS k FROM log), c AS (SELECT ts, k, 'c' || (k % 3)::VARCHAR AS ref FROM n WHERE k % 4 = 0), d AS (SELECT ref, (SELECT avg(p.asymmetric_loss) FROM n p WHERE p.k BETWEEN c.k + 1 AND c.k + 3) - (SELECT p.asymmetric_loss FROM n p WHERE p.k = c.k) AS delta FROM c) SELECT ref, count(delta) AS fired, round(avg(delta), 3) + 0.0::DOUBLE AS mean_delta, CASE WHEN count(delta) >= 5 THEN CASE WHEN avg(delta) < -2 THEN 'promote' WHEN avg(delta) > 2 THEN 'demote' ELSE 'low_signal' END ELSE 'needs_more_data' END AS verdict FROM d GROUP BY ref")
def live_attribution(spark, folder):
    """Rules judged by an interval join of a stream of changes with a stream of log rows."""
    runs = log(spark, folder).withColumn("k", F.row_number().over(Window.orderBy("ts"))).withColumn("ts", F.col("ts").cast("timestamp"))
    kept = shared.staged(runs, "runs")
    message = F.concat(F.lit("amend critique:c"), F.col("k") % 3)
    changes = kept.filter("k % 4 = 0").select("ts", live.refs(message).alias("ref"))
    rows = kept.select("ts", F.col("asymmetric_loss").alias("loss"))
    sides = [in_order(spark, side, name, 4, "ts", "400 DAYS") for name, side in (("changes", changes), ("rows", rows))]
    return rounded(live.attributed(feeds.drained(live.around(*sides, 60, 60), "live-attribution").filter("ref is not null")), "mean_delta", digits=3)


@query("WITH a AS (SELECT o_custkey AS id, o_orderkey AS t, o_totalprice AS v FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC) AS place FROM a) SELECT id, t, v FROM r WHERE place = 1")
def upsert_table(spark, folder):
    """The last order of each customer, upserted by a stream of four files into a bucketed table."""
    rows = V.table(spark, folder, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("t"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("d"))
    s = in_order(spark, rows, "orders", 4, "d")
    base = f"{shared.scratch_dir(spark)}/upserts-{uuid.uuid4().hex}"
    table = upserts.BucketedTable(spark, f"{base}/table", ["id"], "t", 16)
    table.sink(s.drop("d"), "orders", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    table.vacuum()
    return table.read()
