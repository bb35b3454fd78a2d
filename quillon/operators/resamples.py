"""The stationary bootstrap as rows, statistics of any kind over it, and model confidence sets.

A draw is numbered, and where its blocks start and how long they are comes from a hash of (seed, draw, place), so any task makes
the same draw.  ``positions`` has one row for each place of each draw; ``weights`` says how often a draw has each row of the
series.  Statistics that are aggregates become weighted aggregates, joined to the series by row number; statistics of a path
(wealth, drawdown) read ``positions``.  Draws of different lengths are made once for each length and serve all series of it.

Series are told apart by ``by``.  Rows with a null in a column that is drawn have to be dropped before; rows are numbered by date.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.statistics import YEAR
from quillon.plans.shared import partitions, staged

DRAWS = 2000
BLOCK = 20
SEED = 7
TWO_52 = float(1 << 52)


def numbered(series: DataFrame, by: Sequence[str] = (), order: str = "date") -> DataFrame:
    """The series with ``at`` (row number from 0) and ``n`` (rows of its series)."""
    w = Window.partitionBy(*by)
    return series.withColumn("at", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count(F.lit(1)).over(w).cast("int"))


def positions(lengths: DataFrame, draws: int = DRAWS, block: float = BLOCK, seed: int = SEED) -> DataFrame:
    """(n, draw, pos, at): for each length n and draw, the row that stands at each place.

    A block goes on with probability 1 - 1 / block, and around the end to the first row.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("n"), F.col("draw"), F.col("pos")))
    part = lambda first: (F.conv(F.substring(digest, first, 13), 16, 10).cast("double") + 0.5) / TWO_52
    each = lengths.select(F.col("n").cast("int").alias("n")).distinct().filter("n > 0").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    dealt = each.repartition(partitions(lengths.sparkSession), "n", "draw")
    places = dealt.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    starts = places.withColumn("start", F.when((F.col("pos") == 0) | (part(1) < 1 / block), F.floor(part(14) * F.col("n")) - F.col("pos")))
    shift = F.last("start", ignorenulls=True).over(Window.partitionBy("n", "draw").orderBy("pos"))
    return starts.select("n", "draw", "pos", F.pmod(shift + F.col("pos"), F.col("n")).cast("int").alias("at"))


def weights(places: DataFrame) -> DataFrame:
    """(n, draw, at, w): how often each draw has each row."""
    return places.groupBy("n", "draw", "at").agg(F.count(F.lit(1)).alias("w"))


def weighted_mean(x: str, w: Column) -> Column:
    return F.sum(w * F.col(x)) / F.sum(w)


def weighted_deviation(x: str, w: Column) -> Column:
    """Sample deviation of the rows with their multiplicities."""
    total, s = F.sum(w), F.sum(w * F.col(x))
    spread = F.sum(w * F.col(x) * F.col(x)) - s * s / total
    return F.when(total > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (total - 1)))


def weighted_sharpe(x: str, w: Column, periods: int = YEAR) -> Column:
    deviation = weighted_deviation(x, w)
    return F.when(deviation > 0, weighted_mean(x, w) / deviation * math.sqrt(periods))


def weighted_growth(x: str, w: Column, periods: int = YEAR) -> Column:
    return F.exp(F.sum(w * F.log1p(F.col(x))) * periods / F.sum(w)) - 1


def weighted_r2(actual: str, model: str, bench: str, w: Column) -> Column:
    """Out-of-sample R2 in percent."""
    e, b = F.col(actual) - F.col(model), F.col(actual) - F.col(bench)
    return 100 * (1 - F.try_divide(F.sum(w * e * e), F.sum(w * b * b)))


Statistic = Callable[[Column], Column]


def drawn(series: DataFrame, times: DataFrame, statistics: dict[str, Statistic], by: Sequence[str] = ()) -> DataFrame:
    """(by, draw, statistics): each statistic, a function from the weight to an aggregate, over each draw of ``numbered`` series."""
    return series.join(times, ["n", "at"]).groupBy(*by, "draw").agg(*[f(F.col("w")).alias(name) for name, f in statistics.items()])


def bootstrap_gaps(pairs: DataFrame, draws: int = DRAWS, block: float = BLOCK, seed: int = SEED) -> DataFrame:
    """(draw, sharpe_gap, cagr_gap) of a paired bootstrap of (date, a, b)."""
    both = staged(numbered(pairs.filter("a is not null and b is not null").select("date", "a", "b")), "pairs")
    times = weights(positions(both.select("n"), draws, block, seed))
    gap = lambda f: lambda w: f("a", w) - f("b", w)
    return drawn(both, times, {"sharpe_gap": gap(weighted_sharpe), "cagr_gap": gap(weighted_growth)})


def drawn_drawdowns(series: DataFrame, places: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, draw, drawdown): the deepest fall of wealth along each draw's own path."""
    path = Window.partitionBy(*by, "draw").orderBy("pos")
    wealth = series.join(places, ["n", "at"]).select(*by, "draw", "pos", F.sum(F.log1p(F.col(column))).over(path).alias("log_wealth"))
    peak = F.greatest(F.max("log_wealth").over(path), F.lit(0.0))
    return wealth.select(*by, "draw", (F.exp(F.col("log_wealth") - peak) - 1).alias("down")).groupBy(*by, "draw").agg(F.min("down").alias("drawdown"))


def intervals(drawn_rows: DataFrame, names: Sequence[str], by: Sequence[str] = (), coverage: float = 0.95) -> DataFrame:
    """(by, statistic, lo, hi): percentiles with linear interpolation over the draws, from one aggregation."""
    tails = F.array(F.lit((1 - coverage) / 2), F.lit((1 + coverage) / 2))
    row = drawn_rows.groupBy(*by).agg(*[F.percentile(c, tails).alias(c) for c in names])
    return row.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("statistic"), F.get(c, F.lit(0)).alias("lo"), F.get(c, F.lit(1)).alias("hi")) for c in names])))


def confidence_sets(losses: DataFrame, by: Sequence[str] = (), draws: int = 5000, block: float = 2, seed: int = 11) -> DataFrame:
    """(by, model, mse, p_value) of (by, model, date, loss): model confidence sets by the largest t of a model's loss above the
    mean loss of those left.

    All sets are worked on at once, and draws are rows: their mean losses come from one weighted aggregate.  The deviation of a
    difference of such means follows from their covariances, so the order in which models leave is known after one aggregate over draws, without
    drawing again; a second one counts for all steps how often a draw's largest t reaches the observed one.  Only dates at which all
    models of a set have a loss count.
    """
    by = list(by)
    models = losses.filter("loss is not null").groupBy(*by, "date").agg(F.array_sort(F.collect_list(F.struct("model", "loss"))).alias("cells"))  # as many as models
    rows = models.withColumn("m", F.max(F.size("cells")).over(Window.partitionBy(*by))).filter(F.size("cells") == F.col("m"))
    lined = staged(numbered(rows.select(*by, "date", "m", F.transform("cells", lambda c: c["model"]).alias("models"), F.transform("cells", lambda c: c["loss"]).alias("losses")), by), "losses")
    most = lined.agg(F.max("m").alias("m")).first()["m"] or 0
    if not most:
        return lined.select(*by, F.lit("").alias("model"), F.lit(0.0).alias("mse"), F.lit(0.0).alias("p_value")).limit(0)
    loss = lambda j: F.get("losses", F.lit(j))
    about = lined.groupBy(*by).agg(F.first("m").alias("m"), F.first("models").alias("models"), *[F.avg(loss(j)).alias(f"a{j}") for j in range(most)])
    about = about.select(*by, "m", "models", F.slice(F.array(*[F.col(f"a{j}") for j in range(most)]), F.lit(1), F.col("m")).alias("means"))
    times = weights(positions(lined.select("n"), draws, block, seed))
    means = lined.join(times, ["n", "at"]).groupBy(*by, "draw").agg(*[(F.sum(F.col("w") * loss(j)) / F.sum("w")).alias(f"d{j}") for j in range(most)])
    joined = means.join(about, by) if by else means.crossJoin(F.broadcast(about))
    noise = staged(joined.select(*by, "draw", *[(F.col(f"d{j}") - F.get("means", F.lit(j))).alias(f"d{j}") for j in range(most)]), "drawn-means")
    pairs = list(itertools.combinations_with_replacement(range(most), 2))
    spread = noise.groupBy(*by).agg(*[F.covar_samp(f"d{i}", f"d{j}").alias(f"c{i}_{j}") for i, j in pairs])
    matrix = F.array(*[F.array(*[F.col(f"c{min(i, j)}_{max(i, j)}") for j in range(most)]) for i in range(most)])
    spread = spread.select(*by, matrix.alias("cov"))
    # one row a set, read by three parts of the result
    paths = staged((about.join(spread, by) if by else about.crossJoin(F.broadcast(spread))).withColumn("steps", _eliminations()), "eliminations")
    noise = noise.withColumn("noise", F.array(*[F.col(f"d{j}") for j in range(most)])).select(*by, "noise")
    met = noise.join(paths.select(*by, "steps"), by) if by else noise.crossJoin(F.broadcast(paths.select("steps")))
    reached = met.select(*by, F.posexplode(F.transform("steps", lambda s: _reaches(F.col("noise"), s)))).groupBy(*by, "pos").agg(F.avg(F.col("col").cast("double")).alias("p"))
    order = Window.partitionBy(*by).orderBy("pos")
    p_values = reached.select(*by, "pos", F.max("p").over(order).alias("p_value"))
    left = paths.select(*by, "m", F.posexplode("steps").alias("pos", "step"), "models", "means").select(*by, "pos", F.get("models", F.col("step.leaves")).alias("model"), F.get("means", F.col("step.leaves")).alias("mse"))
    gone = left.join(p_values, [*by, "pos"]).select(*by, "model", "mse", "p_value")
    stays = F.when(F.size("steps") == 0, F.lit(0)).otherwise(F.get(F.array_except(F.transform("models", lambda _, i: i), F.transform("steps", lambda s: s["leaves"])), F.lit(0)))
    last = paths.withColumn("__stays", stays).select(*by, F.get("models", F.col("__stays")).alias("model"), F.get("means", F.col("__stays")).alias("mse"), F.lit(1.0).alias("p_value"))
    return gone.unionByName(last)


def _eliminations() -> Column:
    """Steps (leaves, t, alive, scale) of one set from its means and covariances: in each the model with the largest t leaves."""

    def among(values: Column, alive: Column) -> Column:
        """The mean over the models that are left."""
        return F.aggregate(alive, F.lit(0.0), lambda a, k: a + F.get(values, k)) / F.size(alive)

    def step(state: Column, _: Column) -> Column:
        alive = state["alive"]
        rows = F.transform(alive, lambda j: among(F.get("cov", j), alive))  # mean covariance of each with those left
        whole = F.aggregate(rows, F.lit(0.0), lambda a, v: a + v) / F.size(alive)
        variance = F.zip_with(alive, rows, lambda j, r: F.get(F.get("cov", j), j) - 2 * r + whole)
        scale = F.transform(variance, lambda v: F.sqrt(F.greatest(v, F.lit(1e-18))))
        centre = among(F.col("means"), alive)
        t = F.zip_with(alive, scale, lambda j, s: (F.get("means", j) - centre) / s)
        place = F.array_position(t, F.array_max(t)).cast("int") - 1
        leaves = F.get(alive, place)
        done = F.struct(leaves.alias("leaves"), F.array_max(t).alias("t"), alive.alias("alive"), scale.alias("scale"))
        return F.struct(F.filter(alive, lambda j: j != leaves).alias("alive"), F.concat(state["steps"], F.array(done)).alias("steps"))

    kind = "struct<alive:array<int>,steps:array<struct<leaves:int,t:double,alive:array<int>,scale:array<double>>>>"
    start = F.struct(F.transform("models", lambda _, i: i).alias("alive"), F.array().cast("array<struct<leaves:int,t:double,alive:array<int>,scale:array<double>>>").alias("steps")).cast(kind)
    turns = F.filter(F.sequence(F.lit(1), F.col("m")), lambda k: k < F.col("m"))
    return F.aggregate(turns, start, lambda s, k: step(s, k).cast(kind), lambda s: s["steps"])


def _reaches(noise: Column, step: Column) -> Column:
    """Whether a draw's largest t of a step is as large as the observed one."""
    mean = F.aggregate(step["alive"], F.lit(0.0), lambda a, j: a + F.get(noise, j)) / F.size(step["alive"])
    return F.array_max(F.zip_with(step["alive"], step["scale"], lambda j, s: (F.get(noise, j) - mean) / s)) >= step["t"]
