"""Citation graphs: document frequency of seeds, scored expansion round by round, and parameter sweeps."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.shared import staged

LEAST_HITS = 3
LEAST_SCORE = 1.5
PROMOTE = 3.0
DECAY = 0.6
ROUNDS = 6
LEAST_FRESH = 25


def edges_from_refs(works: DataFrame, refs: str = "refs") -> DataFrame:
    """(src, dst) of space-joined references, each once."""
    return works.select(F.col("id").alias("src"), F.explode(F.split(F.trim(refs), r"\s+")).alias("dst")).filter("dst <> ''").distinct()


def seed_weights(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(dst, df, idf): how many sources cite each seed, and its inverse frequency times its weight.  seeds: (id, weight)."""
    total = edges.agg(F.countDistinct("src").alias("sources"))  # one row
    hits = edges.join(seeds.withColumnRenamed("id", "dst"), "dst").groupBy("dst").agg(F.count(F.lit(1)).alias("df"), F.first("weight").alias("weight"))
    return hits.crossJoin(F.broadcast(total)).select("dst", "df", (F.log(F.col("sources") / F.greatest("df", F.lit(1))) * F.col("weight")).alias("idf"))


def score_round(edges: DataFrame, seeds: DataFrame, least_hits: int = LEAST_HITS, least_score: float = LEAST_SCORE) -> DataFrame:
    """(id, hits, signal) of the sources that cite enough seeds: sum of their frequencies over the mean of all seeds."""
    weights = seed_weights(edges, seeds)
    mean = weights.agg(F.avg("idf").alias("mean"))  # one row
    hits = edges.join(weights, "dst").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("hits"), F.sum("idf").alias("total"))
    return hits.crossJoin(F.broadcast(mean)).select("id", "hits", F.try_divide("total", "mean").alias("signal")).filter((F.col("hits") >= least_hits) & (F.col("signal") >= least_score))


def expand(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, promote: float = PROMOTE, decay: float = DECAY, least_hits: int = LEAST_HITS, least_score: float = LEAST_SCORE, least_fresh: int = LEAST_FRESH) -> DataFrame:
    """(id, hits, signal, round) of everything found from the seeds, each at its first round.

    What scores ``promote`` becomes a seed of the next round with weight decay ** round.  Ends when nothing is promoted
    or a round finds fewer than ``least_fresh``.  Each round is written to the shared folder.
    """
    edges = staged(edges, "edges")
    pool = staged(seeds.select("id").distinct().withColumn("weight", F.lit(1.0)), "seeds")
    found = None
    for k in range(rounds):
        fresh = score_round(edges, pool, least_hits, least_score).join(pool.select("id"), "id", "left_anti")
        if found is not None:
            fresh = fresh.join(found.select("id"), "id", "left_anti")
        fresh = staged(fresh.withColumn("round", F.lit(k)), "fresh")
        found = fresh if found is None else found.unionByName(fresh)
        up = fresh.filter(F.col("signal") >= promote)
        row = fresh.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("signal") >= promote).alias("up")).first()
        if not row["up"] or row["n"] < least_fresh:
            break
        pool = staged(pool.unionByName(up.select("id", F.lit(decay ** (k + 1)).alias("weight"))), "seeds")
    return found


def holdout_recovery(edges: DataFrame, seeds: DataFrame, hidden: DataFrame, negatives: DataFrame, **options) -> DataFrame:
    """Share of hidden seeds found again and of negatives that leak in, and the objective: their difference."""
    found = expand(edges, seeds.join(hidden, "id", "left_anti"), **options).select("id")
    share = lambda s: s.join(found.withColumn("f", F.lit(1)), "id", "left").agg(F.round(F.avg(F.coalesce("f", F.lit(0))), 6).alias("x"))
    return share(hidden).withColumnRenamed("x", "recall").crossJoin(F.broadcast(share(negatives).withColumnRenamed("x", "leak"))).withColumn("objective", F.round(F.col("recall") - F.col("leak"), 6))


def sweep(edges: DataFrame, seeds: DataFrame, negatives: DataFrame, folds: int, grid: dict[str, list], rounds: int = ROUNDS, least_fresh: int = LEAST_FRESH) -> DataFrame:
    """Mean recall, leak and objective over folds for each setting of the grid.

    grid: values of any of least_hits, least_score, promote and decay.  Settings and folds are parameter rows: all their
    expansions go through the same joins, round by round, and those that have ended drop out.
    """
    spark = edges.sparkSession
    values = {"least_hits": [LEAST_HITS], "least_score": [LEAST_SCORE], "promote": [PROMOTE], "decay": [DECAY]} | grid
    settings = [(k, *map(float, v)) for k, v in enumerate(itertools.product(*values.values()))]
    if not settings:
        return spark.createDataFrame([], ", ".join(f"{c} double" for c in (*values, "recall", "leak", "objective")))
    table = spark.createDataFrame(settings, "setting int, " + ", ".join(f"{c} double" for c in values))
    runs = F.broadcast(table.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("run", F.col("setting") * folds + F.col("fold")))
    edges = staged(edges, "edges")
    apart = lambda df: df.hint("merge")  # noqa: E731  a run's rows are small on disk only, so nothing of a run's is broadcast
    degrees = staged(edges.groupBy("dst").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(edges.agg(F.countDistinct("src").alias("sources")))).select("dst", F.log(F.col("sources") / F.col("df")).alias("idf")), "degrees")
    dealt = staged(seeds.select("id").distinct().withColumn("hidden", F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int")), "dealt")
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("hidden"))).alias("fold")
    weights = dealt.join(apart(degrees), dealt["id"] == degrees["dst"]).select("dst", "hidden", "idf")
    # what seeds give depends on the fold only, and is kept once for all settings; a run adds what it has promoted
    hits = edges.join(apart(weights), "dst").select(F.col("src").alias("id"), "idf", others).groupBy("fold", "id").agg(F.count(F.lit(1)).alias("hits"), F.sum("idf").alias("total"))
    known = dealt.select("id", others)
    base = staged(hits.join(apart(known), ["fold", "id"], "left_anti"), "from-seeds")
    sums = weights.select("idf", others).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("idf").alias("idfs"))  # a row for each fold
    going = staged(runs.join(F.broadcast(sums), "fold").withColumns({"mean": F.col("idfs") / F.col("n"), "least": F.lit(None).cast("double")}), "runs")
    signal = F.try_divide("total", "mean")
    passed = (F.col("hits") >= F.col("least_hits")) & (signal >= F.col("least_score"))
    columns = ["run", "fold", "id", (signal >= F.col("promote")).alias("up"), "decay"]
    found = promoted = None
    for k in range(rounds):
        # sources that only cite seeds have the same total in all rounds, so the least mean so far tells whether they were found
        before = F.coalesce(F.try_divide("total", "least") >= F.col("least_score"), F.lit(False))
        fresh = base.join(F.broadcast(going), "fold").filter(passed & ~before).select(*columns)
        if promoted is not None:
            added = staged(edges.join(apart(promoted), "dst").groupBy("run", "fold", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("more"), F.sum("idf").alias("rest")), "from-promoted")
            both = added.join(apart(base), ["fold", "id"], "left").withColumns({"hits": F.col("more") + F.coalesce("hits", F.lit(0)), "total": F.col("rest") + F.coalesce("total", F.lit(0.0))})
            both = both.join(F.broadcast(going.drop("fold")), "run").filter(passed).select(*columns)
            both = both.join(apart(known), ["fold", "id"], "left_anti").join(apart(found), ["run", "id"], "left_anti")
            fresh = fresh.join(apart(added.select("run", "id")), ["run", "id"], "left_anti").unionByName(both)
        fresh = staged(fresh, "fresh")
        found = fresh.select("run", "id") if found is None else found.unionByName(fresh.select("run", "id"))
        go = fresh.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if("up").alias("ups")).filter(F.col("n") >= least_fresh).filter("ups > 0").select("run")
        going = staged(going.join(F.broadcast(go), "run"), "runs")  # a row for each run
        if k == rounds - 1 or going.isEmpty():
            break
        up = fresh.filter("up").join(apart(degrees), fresh["id"] == degrees["dst"]).select("run", "fold", "dst", (F.col("idf") * F.pow("decay", F.lit(k + 1))).alias("idf"))
        promoted = staged((up if promoted is None else promoted.unionByName(up)).join(F.broadcast(going.select("run")), "run"), "promoted")
        extra = promoted.groupBy("run").agg(F.count(F.lit(1)).alias("m"), F.sum("idf").alias("extra"))
        going = going.join(F.broadcast(extra), "run", "left").withColumn("least", F.least("least", "mean"))
        going = staged(going.withColumn("mean", (F.col("idfs") + F.coalesce("extra", F.lit(0.0))) / (F.col("n") + F.coalesce("m", F.lit(0)))).drop("m", "extra"), "runs")
    recalled = found.join(apart(dealt), "id").join(runs, "run").filter("hidden = fold").groupBy("run").agg(F.count(F.lit(1)).alias("recalled"))
    leaked = found.join(apart(negatives.select("id").distinct()), "id").groupBy("run").agg(F.count(F.lit(1)).alias("leaked"))
    wanted = dealt.groupBy(F.col("hidden").alias("fold")).agg(F.count(F.lit(1)).alias("wanted"))
    share = lambda part, whole: F.round(F.try_divide(F.coalesce(part, F.lit(0)), whole), 6)
    rated = runs.join(F.broadcast(wanted), "fold", "left").join(recalled, "run", "left").join(leaked, "run", "left").crossJoin(F.broadcast(negatives.agg(F.countDistinct("id").alias("bad"))))
    rated = rated.withColumns({"recall": share("recalled", "wanted"), "leak": share("leaked", "bad")}).withColumn("objective", F.round(F.col("recall") - F.col("leak"), 6))
    return rated.groupBy(*values).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("recall", "leak", "objective")])


def resolve_seeds(wanted: DataFrame, works: DataFrame) -> DataFrame:
    """Seeds by DOI, else by title key and first author's surname; the most cited work of several."""
    by_doi = wanted.filter("doi is not null").join(works.select(F.col("id").alias("work"), "doi", "citations"), "doi")
    rest = wanted.join(by_doi.select("name"), "name", "left_anti")
    by_title = rest.join(works.select(F.col("id").alias("work"), "key", "surname", "citations"), ["key", "surname"])
    both = by_doi.select("name", "work", "citations").unionByName(by_title.select("name", "work", "citations"))
    return both.groupBy("name").agg(F.max_by("work", F.struct("citations", "work")).alias("work"))


def surname(authors):
    """Last word of the first author."""
    first = F.trim(F.split(F.coalesce(authors, F.lit("")), r",|;| and |&")[0])
    return F.lower(F.element_at(F.split(first, r"\s+"), -1))
