"""Report-shaped operators: universes, caches, evaluations of fixtures, pivots, evidence, calibration and pipeline states."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import statistics as T
from quillon.plans.shared import staged

MIN_T = 1.5
T_TOLERANCE = 0.6
MIN_YEARS = 5.0
LEAST_TEXT = 500


def seeded_sample(symbols: DataFrame, n: int, seed: int, column: str = "symbol") -> DataFrame:
    """``n`` symbols in an order hashed from the seed: the same on any cluster (another order than a shuffle's)."""
    return symbols.select(column).distinct().orderBy(F.md5(F.concat_ws("|", F.lit(seed), column)), column).limit(n)


def cached_keys(paths: DataFrame, column: str = "path") -> DataFrame:
    """Distinct upper-case keys of files, without folder, extensions and exchange suffix, sorted."""
    name = F.substring_index(column, "/", -1)
    return paths.select(F.upper(F.regexp_extract(name, r"^([^.]+)", 1)).alias("key")).filter("key <> ''").distinct().orderBy("key")


def cached_panel(spark: SparkSession, path: str, columns: list[str], build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """A panel read from a Parquet cache, built and written again if a wanted column is missing from it."""
    if not refresh:
        try:
            have = spark.read.parquet(path)
            if set(columns) <= set(have.columns):
                return have.select(*columns)
        except Exception as e:  # noqa: BLE001  only a missing cache is built
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select(*columns)


def last_of_day(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row for each key and day, the last by time; labelled with the day."""
    day = F.to_date(at)
    return rows.withColumn("date", day).withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "date").orderBy(F.desc(at)))).filter("__r = 1").drop("__r", at)


def keep_predictors(rows: DataFrame) -> DataFrame:
    """Predictors on accounting, price or trading data with a clear record."""
    return rows.filter(F.col("`Cat.Data`").isin("Accounting", "Price", "Trading") & (F.col("`Predictability in OP`") == "1_clear"))


def targets(windows: list[tuple[str, dict[str, float]]], tolerances: dict[str, float]) -> list[tuple[str, str, float, float]]:
    """Frozen scalar targets (window, statistic, published, tolerance)."""
    return [(w, s, v, tolerances[s]) for w, stats in windows for s, v in stats.items()]


def target_checks(frozen: DataFrame, spans: DataFrame, returns: DataFrame) -> DataFrame:
    """(span, statistic, published, tolerance, measured, lands) of frozen targets in periods (span, first, last) of one series (date, ret)."""
    inside = returns.filter("ret is not null").join(F.broadcast(spans), F.col("date").between(F.col("first").cast("date"), F.col("last").cast("date")))
    up_to = Window.partitionBy("span").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    path = inside.withColumn("__x", F.sum(F.log1p("ret")).over(up_to))
    fallen = path.withColumn("__fall", F.exp(F.col("__x") - F.max("__x").over(up_to)) - 1)
    row = fallen.groupBy("span").agg(T.cagr().alias("cagr"), T.sharpe().alias("sharpe"), F.min("__fall").alias("max_drawdown"))
    long = row.select("span", F.inline(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).alias("measured")) for c in ("cagr", "sharpe", "max_drawdown")])))
    both = frozen.join(long, ["span", "statistic"], "left")
    return both.select("span", "statistic", "published", "tolerance", "measured", F.coalesce(F.abs(F.col("measured") - F.col("published")) <= F.col("tolerance"), F.lit(False)).alias("lands"))


def fixture_flags(rows: DataFrame) -> DataFrame:
    """Flags of (sharpe, lo, hi, ic_mean, expected_sign, least_ic, verdict, expected_verdict)."""
    sign_ok = F.when(F.col("expected_sign") == "+", F.col("ic_mean") > 0).when(F.col("expected_sign") == "-", F.col("ic_mean") < 0).otherwise(True)
    ic = F.when(F.col("expected_sign") == "-", -F.col("ic_mean")).otherwise(F.col("ic_mean"))
    out = rows.withColumn("sharpe_in_range", F.coalesce(F.col("sharpe").between(F.col("lo"), F.col("hi")), F.lit(False)))
    out = out.withColumn("ic_pass", F.coalesce(ic >= F.col("least_ic"), F.lit(False))).withColumn("sign_match", F.coalesce(sign_ok, F.lit(False)))
    out = out.withColumn("verdict_match", F.coalesce(F.col("verdict") == F.col("expected_verdict"), F.lit(False)))
    fails = [(F.col(c), c) for c in ("sharpe_in_range", "ic_pass", "sign_match", "verdict_match")]
    return out.withColumn("reasons", F.filter(F.array(*[F.when(~c, F.lit(n)) for c, n in fails]), lambda x: x.isNotNull()))


def evaluation_summary(flags: DataFrame) -> DataFrame:
    """Verdict accuracy, rates and the asymmetric loss over fixtures: a shipped fixture missed costs five, a dud shipped one."""
    e, v = F.col("expected_verdict"), F.col("verdict")
    fn, fp = F.count_if((e == "ship") & (v == "kill")), F.count_if((e == "kill") & (v == "ship"))
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return flags.agg(F.count(F.lit(1)).alias("fixtures"), rate("verdict_match").alias("verdict_accuracy"), rate("sharpe_in_range").alias("sharpe_in_range_rate"), rate("sign_match").alias("sign_match_rate"), fn.alias("n_false_negatives"), fp.alias("n_false_positives"), (5 * fn + fp).alias("asymmetric_loss"))


def calibrate(series: DataFrame, first: int, last: int, claimed_t: float) -> DataFrame:
    """Own-sample t of a daily series against the published one: calibrated, miscalibrated or no_overlap."""
    own = series.filter(F.year("date").between(first, last)).agg(F.count("ret").alias("days"), T.t_stat().alias("t"))
    years = F.col("days") / 252
    close = (F.col("t") >= MIN_T) & (F.abs(F.col("t") - claimed_t) <= T_TOLERANCE * claimed_t)
    return own.select("days", F.round("t", 3).alias("t"), F.when(years < MIN_YEARS, "no_overlap").when(close, "calibrated").otherwise("miscalibrated").alias("label"))


def scored_window(series: DataFrame, start: str, end: str, least: int = 300) -> DataFrame:
    """Sharpe and t of a window with enough days, else the reason."""
    row = series.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).agg(F.count("ret").alias("days"), T.sharpe().alias("s"), T.t_stat().alias("t"))
    some = F.col("days") >= least
    return row.select("days", F.when(some, F.round("s", 6)).alias("sharpe"), F.when(some, F.round("t", 6)).alias("t"), F.when(~some, F.concat(F.lit("only "), "days", F.lit(f" trading days available in {start}..{end}"))).alias("note"))


def lift_verdict(ladder: DataFrame) -> DataFrame:
    """What a ladder of universe sizes (names, corr) says: more names help, hurt, or change little."""
    row = ladder.agg((F.max_by("corr", "names") - F.min_by("corr", "names")).alias("change"))
    return row.select(F.round("change", 6).alias("change"), F.when(F.col("change") >= 0.08, "universe size was the limit").when(F.col("change") <= -0.03, "more names made it worse").otherwise("universe size is not the limit").alias("verdict"))


def state_pivot(scored: DataFrame, states: list[str]) -> DataFrame:
    """Exhibits by states, zero-filled, with the share reproduced of what was checked."""
    p = scored.groupBy(F.split("cell", "/")[0].alias("exhibit")).pivot("state", states).count().na.fill(0)
    return p.withColumn("rate", F.round(F.try_divide("REPRODUCED", F.col("REPRODUCED") + F.col("MISSED")), 6))


def page_order_pivot(cells: DataFrame, columns: list[str]) -> DataFrame:
    """A table as printed: rows by first appearance, one column for each name; cells: (row, col, value, position)."""
    rows = cells.groupBy("row").agg(F.min("position").alias("position"))
    return cells.groupBy("row").pivot("col", columns).agg(F.first("value")).join(rows, "row")


def evidence(scored: DataFrame, cap: int = 16) -> DataFrame:
    """At most ``cap`` rows of each exhibit, attempted ones first: a display limit, the tally counts all."""
    exhibit = F.split("cell", "/")[0]
    attempted = F.col("state").isin("REPRODUCED", "MISSED")
    w = Window.partitionBy("exhibit").orderBy(F.desc(attempted.cast("int")), "cell")
    return scored.withColumn("exhibit", exhibit).withColumn("place", F.row_number().over(w)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("exhibit"))).filter(F.col("place") <= cap)


def share_band(share: Column) -> Column:
    return F.when(share >= 95, "nearly all of it lands").when(share >= 60, "most of it lands").when(share >= 25, "some of it lands").otherwise("little of it lands")


def weighted_coverage(rows: DataFrame, by: str, classes: list[str]) -> DataFrame:
    """Shares of coverage classes, weighted, for each group: (by, coverage, weight)."""
    total = F.sum("weight").over(Window.partitionBy(by))
    shares = rows.groupBy(by, "coverage").agg(F.sum("weight").alias("weight")).withColumn("share", F.col("weight") / total)
    return shares.groupBy(by).pivot("coverage", classes).agg(F.round(F.sum("share"), 6)).na.fill(0.0)


def reason_histogram(rows: DataFrame, column: str = "reason") -> DataFrame:
    """Reasons without what stands in parentheses."""
    return rows.groupBy(F.split(column, r" \(")[0].alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def shortlist(rows: DataFrame) -> DataFrame:
    """Best first: appeal, confidence, cheapest tier, then id; nulls last."""
    order = F.when(F.col("tier") == "S", 0).when(F.col("tier") == "M", 1).otherwise(2)
    return rows.orderBy(F.col("appeal").desc_nulls_last(), F.col("confidence").desc_nulls_last(), order, "id")


def carry_labels(lines: DataFrame) -> DataFrame:
    """Lines (doc, line, text, is_label) with the last label above each."""
    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(F.when(F.col("is_label"), F.col("text")), ignorenulls=True).over(w))


@dataclass
class Report:
    """Outcome of one replication run and the state it ended in."""

    paper: str
    status: str = "started"
    errors: list[str] = field(default_factory=list)
    spec: dict = field(default_factory=dict)
    result: dict = field(default_factory=dict)
    claim: dict = field(default_factory=dict)

    def as_dict(self) -> dict:
        return asdict(self)


def _run_code(code: str, panel: DataFrame, backtest: Callable[[DataFrame], DataFrame], claimed_t: float | None, trials: int) -> Report:
    """What a signal's code comes to, whatever paper it is of; the series stays on the executors."""
    from quillon.operators import exhibits

    out = Report("", "done")
    errors, _ = exhibits.check_code(code)
    if errors:
        out.status, out.errors = "code_failed", errors
        return out
    # performance and claim both read the series, which is a row a date; the code is run once for them
    net = staged(backtest(exhibits.apply_signal(panel, code)), "net")
    row = T.performance(net).first()
    if row is None or row["n"] == 0:
        out.status, out.errors = "backtest_failed", ["no returns"]
        return out
    out.result = {k: v if v is None or isinstance(v, int) or math.isfinite(v) else None for k, v in row.asDict().items()}
    out.claim = T.check_claim(net, claimed_t, trials)
    return out


def replicate(paper: str, text: str, spec: dict, code: str, panel: DataFrame, backtest: Callable[[DataFrame], DataFrame], claimed_t: float | None = None, trials: int = 1) -> Report:
    """Text to verdict: spec_failed, code_failed, backtest_failed or done.

    backtest: scores to a daily (date, ret) series.
    """
    if len(text or "") < LEAST_TEXT:
        return Report(paper, "spec_failed", ["text is too short"], spec)
    out = _run_code(code, panel, backtest, claimed_t, trials)
    out.paper, out.spec = paper, spec
    return out


def replicate_all(papers: DataFrame, code: str, panel: DataFrame, backtest: Callable[[DataFrame], DataFrame], claimed_t: float | None = None, trials: int = 1) -> DataFrame:
    """``replicate`` for every (paper, text) that shares one code: (paper, status, claim, sharpe).

    The code is run once and its outcome, one row, meets the papers as literals; texts never leave the executors.
    """
    out = _run_code(code, panel, backtest, claimed_t, trials)
    enough = F.length(F.coalesce("text", F.lit(""))) >= LEAST_TEXT
    value = lambda v, kind: F.when(enough, F.lit(v)).cast(kind)
    status = F.when(enough, F.lit(out.status)).otherwise("spec_failed")
    return papers.select("paper", status.alias("status"), value(out.claim.get("status"), "string").alias("claim"), value(out.result.get("sharpe"), "double").alias("sharpe"))
