"""Queries over printed cells, criteria, votes and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import scoring as S
from quillon.plans.panels import rounded
from quillon.plans.registry import query
from quillon.sources import views as V
from quillon.sources.views import sql

CELLS = "cells AS (SELECT 'T' || (item_id % 8)::VARCHAR || '/row/' || item_id::VARCHAR || '/' || CASE WHEN item_id % 3 = 0 THEN 'TW' ELSE 'R2' END AS cell, round(length(text) / 7.0::DOUBLE, 2) AS published, item_id FROM benchmark), computed AS (SELECT upper(replace(cell, '/', ' / ')) AS cell, published + ((item_id % 5) - 2) * 0.004::DOUBLE AS observed FROM cells WHERE item_id % 6 <> 0)"
SCORED = CELLS + ", scored AS (SELECT c.cell, published, round_even(observed, 6) AS observed, CASE WHEN c.cell LIKE '%/TW' THEN 0.005::DOUBLE ELSE 0.0005::DOUBLE END AS tolerance, round_even(abs(observed - published), 6) AS gap, CASE WHEN observed IS NULL THEN 'NOT_ATTEMPTED' WHEN abs(observed - published) <= CASE WHEN c.cell LIKE '%/TW' THEN 0.005::DOUBLE ELSE 0.0005::DOUBLE END THEN 'REPRODUCED' ELSE 'MISSED' END AS state FROM cells c LEFT JOIN computed o ON lower(regexp_replace(o.cell, '\\s', '', 'g')) = lower(regexp_replace(c.cell, '\\s', '', 'g')))"


def cells(spark: SparkSession, folder: str) -> DataFrame:
    b = V.table(spark, folder, "benchmark")
    i = F.col("item_id")
    return b.select(F.concat(F.lit("T"), i % 8, F.lit("/row/"), i, F.lit("/"), F.when(i % 3 == 0, "TW").otherwise("R2")).alias("cell"), F.round(F.length("text") / 7, 2).alias("published"), "item_id")


def computed(spark: SparkSession, folder: str) -> DataFrame:
    c = cells(spark, folder).filter("item_id % 6 <> 0")
    return c.select(F.upper(F.regexp_replace("cell", "/", " / ")).alias("cell"), (F.col("published") + (F.col("item_id") % 5 - 2) * 0.004).alias("observed"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return S.score_cells(cells(spark, folder), computed(spark, folder))


@query(f"WITH {SCORED} SELECT cell, published, round(observed, 6) AS observed, tolerance, round(gap, 6) AS gap, state FROM scored")
def tolerance_scoring(spark, folder):
    return rounded(scored(spark, folder), "observed", "gap")


@query(f"WITH {SCORED} SELECT string_split(cell, '/')[1] AS exhibit, count(*) AS printed, count(*) FILTER (state = 'REPRODUCED') AS matched, count(*) FILTER (state = 'MISSED') AS missed, count(*) FILTER (state = 'NOT_ATTEMPTED') AS not_built, round(count(*) FILTER (state = 'REPRODUCED') / nullif(count(*) FILTER (state <> 'NOT_ATTEMPTED'), 0), 6) AS rate FROM scored GROUP BY 1")
def exhibit_counts(spark, folder):
    return S.exhibit_counts(scored(spark, folder))


@query(f"WITH {SCORED}, t AS (SELECT count(*) AS printed, count(*) FILTER (state <> 'NOT_ATTEMPTED') AS checks, count(*) FILTER (state = 'REPRODUCED') AS lands, count(*) FILTER (state = 'MISSED') AS differs, count(*) FILTER (state = 'UNOBTAINABLE') AS blocked, count(DISTINCT string_split(cell, '/')[1]) AS exhibits FROM scored) SELECT *, CASE WHEN checks = 0 THEN CASE WHEN blocked > 0 THEN 'blocked' ELSE 'queued' END WHEN differs = 0 THEN 'reproduced' WHEN lands = 0 THEN 'diverges' ELSE 'holds in part' END AS verdict FROM t")
def coverage_score(spark, folder):
    return S.coverage(scored(spark, folder))


@query(f"WITH {SCORED}, t AS (SELECT count(*) AS n, count(*) FILTER (state = 'REPRODUCED') AS r, count(*) FILTER (state = 'MISSED') AS m, count(*) FILTER (state = 'NOT_ATTEMPTED') AS a FROM scored) SELECT r || ' of ' || n || ' published numbers reproduced' || CASE WHEN m > 0 THEN ', ' || m || ' missed' ELSE '' END || CASE WHEN a > 0 THEN ', ' || a || ' not built yet' ELSE '' END AS headline, n > 0 AND r = n AS complete FROM t")
def headline(spark, folder):
    return S.headline(scored(spark, folder))


@query(f"WITH {CELLS} SELECT item_id, CASE WHEN item_id % 7 = 0 THEN 'UNOBTAINABLE' WHEN item_id % 6 = 0 THEN 'NOT_ATTEMPTED' WHEN abs(((item_id % 5) - 2) * 0.004::DOUBLE) <= 0.005 THEN 'REPRODUCED' ELSE 'MISSED' END AS state FROM cells")
def artifact_state(spark, folder):
    i = F.col("item_id")
    observed = F.when(i % 6 != 0, (i % 5 - 2) * 0.004)
    return cells(spark, folder).select("item_id", S.state(F.lit(0.0), observed, F.lit(0.005), F.when(i % 7 == 0, "paid data")).alias("state"))


@query(f"WITH {CELLS} SELECT a.item_id::VARCHAR AS name, b.cell FROM cells a JOIN cells b ON string_split(a.cell, '/')[1] = string_split(b.cell, '/')[1] AND abs(a.published - b.published) <= 0.5")
def cell_suggestions(spark, folder):
    c = cells(spark, folder).withColumn("exhibit", F.split("cell", "/")[0])
    return S.suggestions(c.select(F.col("item_id").cast("string").alias("name"), "exhibit", "published"), c.select("cell", "exhibit", F.col("published").alias("value")), 0.5)


@query(f"WITH {CELLS} SELECT 'X' || cell AS cell, observed FROM (SELECT cell, round(observed, 6) AS observed FROM computed WHERE length(cell) % 2 = 0)")
def unknown_cells(spark, folder):
    c = computed(spark, folder)
    more = c.filter(F.length("cell") % 2 == 0).select(F.concat(F.lit("X"), "cell").alias("cell"), F.round("observed", 6).alias("observed"))
    return S.unknown_cells(cells(spark, folder), c.unionByName(more))


@query(f"WITH {CELLS} SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'FIXTURE_UNAVAILABLE' WHEN item_id % 6 <> 0 AND published >= 30 THEN 'VERIFIED' ELSE 'NOT_VERIFIED' END AS criterion, CASE WHEN item_id % 6 <> 0 AND abs(published - 33) <= 5 THEN 'VERIFIED' ELSE 'NOT_VERIFIED' END AS target FROM cells")
def verification(spark, folder):
    i = F.col("item_id")
    observed = F.when(i % 6 != 0, F.col("published"))
    return cells(spark, folder).select("item_id", S.judge_criterion(observed, F.lit(30.0), i % 4 != 0).alias("criterion"), S.judge_target(observed, F.lit(33.0), F.lit(5.0)).alias("target"))


@query("WITH t AS (SELECT doc_id, unnest(string_split(concat_ws(' ', text, '(−' || (n_chars / 4)::VARCHAR || ')**'), ' ')) AS token FROM documents), c AS (SELECT doc_id, trim(translate(token, '−–', '--')) AS raw FROM t), m AS (SELECT *, regexp_extract(raw, '^\\(?(-?)\\$?(\\d[\\d,]*(\\.\\d+)?)\\)?(%?)([*†‡]{0,3})$', ['sign', 'body', 'frac', 'pct', 'stars']) AS g FROM c WHERE regexp_matches(raw, '^\\(?(-?)\\$?(\\d[\\d,]*(\\.\\d+)?)\\)?(%?)([*†‡]{0,3})$')) SELECT raw, round(CASE WHEN g.sign = '-' THEN -1 ELSE 1 END * replace(g.body, ',', '')::DOUBLE, 6) AS value, g.pct = '%' AS percent, length(g.stars)::INTEGER AS stars, starts_with(raw, '(') AS parenthesised, count(*) AS n FROM m WHERE contains(g.body, '.') OR g.pct = '%' GROUP BY ALL")
def parse_cells(spark, folder):
    d = V.table(spark, folder, "documents").select(F.explode(F.split(F.concat_ws(" ", "text", F.concat(F.lit("(−"), F.col("n_chars") / 4, F.lit(")**"))), " ")).alias("token"))
    return rounded(d.select(S.parse_cell(F.col("token")).alias("c")).filter("c is not null").select("c.*").groupBy("raw", "value", "percent", "stars", "parenthesised").agg(F.count(F.lit(1)).alias("n")), "value")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Taken as ordered' ELSE 'New' END || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE ' part-' || l_partkey END || CASE WHEN l_linenumber % 2 = 0 THEN ' ' || l_linenumber ELSE '' END AS label,
[CASE WHEN l_returnflag = 'R' THEN '-' ELSE '' END || printf('%.2f', l_quantity) || CASE l_orderkey % 3 WHEN 0 THEN '*' WHEN 1 THEN '**' ELSE '' END, '(' || printf('%.2f', l_extendedprice) || ')', printf('%.0f', l_discount * 100) || '%', l_partkey::VARCHAR] AS numbers FROM lineitem)
SELECT l_orderkey AS id, label, CASE WHEN l_orderkey % 4 = 0 THEN []::VARCHAR[] ELSE numbers END AS numbers FROM t""")
def split_rows(spark, folder):
    """Lines made of every order line's own values, with labels of several words and signs, stars, brackets and percentages; some have no numbers."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    kind = F.when(F.col("l_returnflag") == "R", "Returned").when(F.col("l_returnflag") == "A", "Taken  as ordered").otherwise("New")
    label = F.concat(kind, F.when(line % 3 == 0, "").otherwise(F.concat(F.lit("  part-"), "l_partkey")), F.when(line % 2 == 0, F.concat(F.lit("  "), line)).otherwise(""))
    two = lambda c: F.format_string("%.2f", c)
    numbers = [F.concat(F.when(F.col("l_returnflag") == "R", "-").otherwise(""), two("l_quantity"), F.when(key % 3 == 0, "*").when(key % 3 == 1, "**").otherwise("")), F.concat(F.lit("("), two("l_extendedprice"), F.lit(")")), F.concat(F.format_string("%.0f", F.col("l_discount") * 100), F.lit("%")), F.col("l_partkey").cast("string")]
    text = F.concat(F.lit(" "), label, F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("   "), F.concat_ws(" ", *numbers))))
    return V.table(spark, folder, "lineitem").select(key.alias("id"), S.split_row(text).alias("r")).select("id", F.regexp_replace("r.label", r"\s+", " ").alias("label"), "r.numbers")


@query(f"WITH {SCORED} SELECT exhibit, checks, lands, round(lands / nullif(checks, 0), 6) AS rate, coalesce(f, []) AS failed FROM (SELECT string_split(cell, '/')[1] AS exhibit, count(*) FILTER (state IN ('REPRODUCED', 'MISSED')) AS checks, count(*) FILTER (state = 'REPRODUCED') AS lands, list(cell ORDER BY gap DESC, cell) FILTER (state = 'MISSED') AS f FROM scored GROUP BY 1)")
def coverage_failures(spark, folder):
    """Cells of each exhibit that do not land, the widest gap first."""
    rows = S.failures(scored(spark, folder))
    return rounded(rows.select("exhibit", "checks", "lands", "rate", F.transform("failures", lambda x: x["cell"]).alias("failed")), "rate")


@query(f"WITH {SCORED} SELECT exhibit, CASE WHEN r = n THEN 'VERIFIED' WHEN r > 0 THEN 'ATTEMPTED' ELSE 'CATALOGUED' END AS status, r || ' of ' || n || ' published numbers reproduced' AS headline FROM (SELECT string_split(cell, '/')[1] AS exhibit, count(*) AS n, count(*) FILTER (state = 'REPRODUCED') AS r FROM scored GROUP BY 1)")
def artifact_status(spark, folder):
    return S.artifact_status(scored(spark, folder).withColumn("exhibit", F.split("cell", "/")[0]), "exhibit")


@query(sql("votes", "WITH s AS (SELECT submission, faction, sum(weight) AS w FROM votes WHERE vote = 'agree' AND faction <> 'unknown' GROUP BY ALL), t AS (SELECT submission, count(*) AS factions, sum(w) AS weight FROM s GROUP BY 1) SELECT submission, coalesce(factions, 0) AS factions, round(coalesce(weight, 0), 6) AS weight, coalesce(factions, 0) >= 2 AS passed FROM (SELECT DISTINCT submission FROM votes) LEFT JOIN t USING (submission)"))
def faction_votes(spark, folder):
    return rounded(S.bipartisan(V.votes(spark, folder)))


@query("SELECT c_custkey AS id, round(least(sqrt(greatest(floor(c_acctbal), 0)::DOUBLE), 10.0::DOUBLE), 6) AS weight FROM customer")
def vote_weight(spark, folder):
    return rounded(V.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), S.vote_weight(F.floor("c_acctbal")).alias("weight")))


@query(sql("votes", "WITH h AS (SELECT submission % 20 AS user_id, CASE WHEN faction = 'user' THEN 'challenge' ELSE 'other' END AS kind, vote FROM votes), t AS (SELECT user_id, count(*) FILTER (kind = 'challenge') AS votes, count(*) FILTER (kind = 'challenge' AND vote = 'agree') AS yes FROM h GROUP BY 1) SELECT user_id, votes, CASE WHEN votes < 10 THEN 'unknown' WHEN yes / votes > 0.7 THEN 'ai_skeptic' WHEN yes / votes < 0.3 THEN 'ai_truster' ELSE 'neutral' END AS faction FROM t"))
def faction_infer(spark, folder):
    h = V.votes(spark, folder).select((F.col("submission") % 20).alias("user_id"), F.when(F.col("faction") == "user", "challenge").otherwise("other").alias("submission_type"), "vote")
    return S.infer_faction(h, "user_id")


@query("WITH k AS (SELECT list_value('submission_accepted_t1', 'submission_rejected_spam', 'vote_with_majority', 'vote_against_majority', 'comment_helpful', 'comment_spam', 'nothing') AS e, list_value(5, -10, 1, -1, 3, -5, 0) AS d), x AS (SELECT user_id, list(d[event_id % 7 + 1] ORDER BY event_id) AS l FROM events, k GROUP BY 1) SELECT user_id, list_reduce(list_prepend(10, l), lambda a, b: greatest(0, a + b))::INTEGER AS reputation FROM x")
def reputation_fold(spark, folder):
    names = F.array(*map(F.lit, ("submission_accepted_t1", "submission_rejected_spam", "vote_with_majority", "vote_against_majority", "comment_helpful", "comment_spam", "nothing")))
    e = V.table(spark, folder, "events").select("user_id", F.col("event_id").alias("seq"), F.get(names, (F.col("event_id") % 7).cast("int")).alias("event"))
    return S.reputation(e, "user_id")


LOG = "log AS (SELECT date AS ts, avg_ok AS verdict_accuracy, loss AS asymmetric_loss, fn AS n_false_negatives FROM (SELECT o_orderdate::DATE AS date, avg((o_orderstatus = 'F')::INTEGER)::DOUBLE AS avg_ok, sum((o_orderstatus = 'P')::INTEGER)::DOUBLE AS loss, count(*) FILTER (o_orderstatus = 'O') AS fn FROM orders GROUP BY 1))"


def log(spark: SparkSession, folder: str) -> DataFrame:
    """Runs by day."""
    s = F.col("o_orderstatus")
    return V.table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("ts")).agg(F.avg((s == "F").cast("double")).alias("verdict_accuracy"), F.sum((s == "P").cast("double")).alias("asymmetric_loss"), F.count_if(s == "O").alias("n_false_negatives"))


@query(f"WITH {LOG}, l AS (SELECT * FROM log ORDER BY ts DESC LIMIT 10) SELECT count(*) AS runs, round(avg(verdict_accuracy), 6) AS mean_verdict_accuracy, round(avg(asymmetric_loss), 6) AS mean_asymmetric_loss, arg_max(asymmetric_loss, ts) - arg_min(asymmetric_loss, ts) AS trend, max(ts) AS latest_run FROM l")
def platform_metrics(spark, folder):
    return rounded(S.platform_metrics(log(spark, folder)), "mean_verdict_accuracy", "mean_asymmetric_loss")


@query(f"WITH {LOG} SELECT ts, CASE WHEN lag(ts) OVER w IS NULL THEN [] ELSE list_filter([CASE WHEN verdict_accuracy < lag(verdict_accuracy) OVER w - 0.05::DOUBLE THEN 'verdict_accuracy dropped' END, CASE WHEN n_false_negatives > lag(n_false_negatives) OVER w THEN 'false_negatives rose' END, CASE WHEN asymmetric_loss > lag(asymmetric_loss) OVER w * 1.2::DOUBLE THEN 'asymmetric_loss jumped' END], lambda x: x IS NOT NULL) END AS alerts FROM log WINDOW w AS (ORDER BY ts)")
def regression_alerts(spark, folder):
    return S.regression_alerts(log(spark, folder))


@query(f"WITH {LOG}, n AS (SELECT *, row_number() OVER (ORDER BY ts) AS k FROM log), c AS (SELECT ts, k, 'c' || (k % 3)::VARCHAR AS ref FROM n WHERE k % 4 = 0), d AS (SELECT ref, (SELECT avg(p.asymmetric_loss) FROM n p WHERE p.k BETWEEN c.k + 1 AND c.k + 3) - (SELECT p.asymmetric_loss FROM n p WHERE p.k = c.k) AS delta FROM c) SELECT ref, count(delta) AS fired, round(avg(delta), 3) + 0.0::DOUBLE AS mean_delta, CASE WHEN count(delta) >= 5 THEN CASE WHEN avg(delta) < -2 THEN 'promote' WHEN avg(delta) > 2 THEN 'demote' ELSE 'low_signal' END ELSE 'needs_more_data' END AS verdict FROM d GROUP BY ref")
def rule_attribution(spark, folder):
    return attributed(log(spark, folder))


def attributed(runs: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    n = runs.withColumn("k", F.row_number().over(Window.orderBy("ts")))
    changes = n.filter("k % 4 = 0").select("ts", F.concat(F.lit("amend critique:c"), F.col("k") % 3).alias("message"))
    return rounded(S.attribute(changes, n), "mean_delta", digits=3)


@query("SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'high' ELSE 'low' END AS severity, o_orderstatus AS category, count(*) AS n FROM orders GROUP BY 1, 2")
def severity_histogram(spark, folder):
    o = V.table(spark, folder, "orders")
    c = o.groupBy("o_custkey").agg(F.collect_list(F.struct(F.when(F.col("o_orderpriority").startswith("1"), "high").otherwise("low").alias("severity"), F.col("o_orderstatus").alias("category"))).alias("findings"))
    return S.severity_histogram(c)


@query("WITH p(model, a, b) AS (VALUES ('small', 0.25::DOUBLE, 1.25::DOUBLE), ('large', 3.0::DOUBLE, 15.0::DOUBLE)), c AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'other' END AS model, event_id * 10 AS x, event_id * 3 AS y FROM events) SELECT event_id, c.model, round(x / 1e6 * a + y / 1e6 * b, 9) AS cost FROM c LEFT JOIN p USING (model)")
def call_cost(spark, folder):
    prices = spark.createDataFrame([("small", 0.25, 1.25), ("large", 3.0, 15.0)], "model string, price_in double, price_out double")
    i = F.col("event_id")
    calls = V.table(spark, folder, "events").select("event_id", F.when(i % 3 == 0, "small").when(i % 3 == 1, "large").otherwise("other").alias("model"), (i * 10).alias("tokens_in"), (i * 3).alias("tokens_out"))
    return rounded(S.call_cost(calls, prices).select("event_id", "model", "cost"), digits=9)
