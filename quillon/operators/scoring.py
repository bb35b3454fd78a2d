"""Printed numbers against computed ones: parsing, states, tolerances, coverage, criteria, votes and logs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: half of the last printed digit by metric
TOLERANCES = {"TW": 0.005, "AV": 0.005, "SD": 0.005, "SR": 0.005, "MDD": 0.005, "MSE": 0.0005, "MCS p-value": 0.0005}
DEFAULT_TOLERANCE = 0.0005
TRANSCRIPTION = 0.005
# fixed values: reputation events
EVENTS = {"submission_accepted_t1": 5, "submission_accepted_t2": 20, "submission_accepted_t3": 100, "submission_rejected_spam": -10, "submission_rejected_vote": 0, "vote_with_majority": 1, "vote_against_majority": -1, "comment_helpful": 3, "comment_spam": -5}
CELL = r"^\(?(-?)\$?(\d[\d,]*(\.\d+)?)\)?(%?)([*†‡]{0,3})$"

STARS = "*†‡"
#: what stands around the digits of a cell
ENDS = "()%*†‡\n\r\x85\u2028\u2029"

#: a line from its first token that ``parse_cell`` takes on
PRINTED = r"(?s)(?<!\S)\(?[-−–]?\$?\d[\d,]*(?:\.\d+\)?%?|\)?%)[*†‡]{0,3}[\x{85}\x{2028}\x{2029}]?(?!\S).*"


def clean(token: Column) -> Column:
    """Typographic minus signs to ASCII."""
    return F.trim(F.when(F.contains(token, F.lit("−")) | F.contains(token, F.lit("–")), F.translate(token, "−–", "--")).otherwise(token))


def is_cell(raw: Column) -> Column:
    """Whether a cleaned token is a printed number; a bare integer is a count, not a result."""
    return raw.rlike(CELL) & (F.contains(raw, F.lit(".")) | F.contains(raw, F.lit("%")))


def parse_cell(token: Column) -> Column:
    """(value, raw, percent, stars, parenthesised) of a printed number, or null."""
    raw = clean(token)
    return F.when(is_cell(raw), cell_parts(raw))


def cell_parts(raw: Column) -> Column:
    """``parse_cell`` of a cleaned token that is a cell."""
    # what a number of this form is made of can be told by its characters, so no other regular expression is needed
    without = lambda marks: F.translate(raw, marks, "")
    some = lambda marks: functools.reduce(Column.__or__, [F.contains(raw, F.lit(m)) for m in marks])
    # marks inside of a number are rare, and those at its ends are cheaper to take off
    value = F.when(some("$,"), without(f"$,{ENDS}")).otherwise(F.btrim(raw, F.lit(ENDS))).try_cast("double")
    stars = F.when(some(STARS), F.length(raw) - F.length(without(STARS))).otherwise(F.lit(0))
    return F.struct(value.alias("value"), raw.alias("raw"), F.contains(raw, F.lit("%")).alias("percent"), stars.alias("stars"), F.startswith(raw, F.lit("(")).alias("parenthesised"))


def split_row(line: Column) -> Column:
    """(label, numbers): all before the first token that is a printed number, and the tokens from it on."""
    rest = numbers_of(line)
    return F.struct(label_of(line, rest).alias("label"), F.coalesce(tokens(rest), F.array().cast("array<string>")).alias("numbers"))


def numbers_of(line: Column) -> Column:
    """The line from its first token that is a printed number on, else nothing."""
    return F.regexp_extract(line, PRINTED, 0)


def label_of(line: Column, rest: Column) -> Column:
    """What is before the ``numbers_of`` a line."""
    before = F.substring(line, F.lit(1), F.length(line) - F.length(rest))
    return F.when(rest != "", F.trim(F.regexp_replace(before, r"\s+", " "))).otherwise(F.trim(line))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), 0)


def tolerance(cell: Column) -> Column:
    """By the last segment of the cell's path."""
    table = F.create_map(*[x for k, v in TOLERANCES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, F.element_at(F.split(cell, "/"), -1)), F.lit(DEFAULT_TOLERANCE))


def cell_key(cell: Column) -> Column:
    """An address without white space and case."""
    return F.lower(F.regexp_replace(cell, r"\s", ""))


def state(published: Column, observed: Column, within: Column, blocker: Column) -> Column:
    return F.when(F.coalesce(blocker, F.lit("")) != "", "UNOBTAINABLE").when(observed.isNull(), "NOT_ATTEMPTED").when(F.abs(observed - published) <= within, "REPRODUCED").otherwise("MISSED")


def gap(published: Column, observed: Column) -> Column:
    return F.bround(F.abs(observed - published), 6)


def score_cells(printed: DataFrame, computed: DataFrame) -> DataFrame:
    """(cell, published, observed, tolerance, gap, state): printed (cell, published) joined by key to computed (cell, observed)."""
    c = computed.select(cell_key(F.col("cell")).alias("__key"), "observed")
    both = printed.withColumn("__key", cell_key(F.col("cell"))).join(c, "__key", "left")
    t = tolerance(F.col("cell"))
    return both.select("cell", "published", F.bround("observed", 6).alias("observed"), t.alias("tolerance"), gap(F.col("published"), F.col("observed")).alias("gap"), state(F.col("published"), F.col("observed"), t, F.lit(None).cast("string")).alias("state"))


def unknown_cells(printed: DataFrame, computed: DataFrame) -> DataFrame:
    """Computed cells that are not printed."""
    return computed.withColumn("__key", cell_key(F.col("cell"))).join(printed.select(cell_key(F.col("cell")).alias("__key")), "__key", "left_anti").drop("__key")


def exhibit_counts(scored: DataFrame) -> DataFrame:
    """Per exhibit: printed, matched, missed, not built, and the matched share of what was checked."""
    s = F.col("state")
    out = scored.groupBy(F.split("cell", "/")[0].alias("exhibit")).agg(F.count(F.lit(1)).alias("printed"), F.count_if(s == "REPRODUCED").alias("matched"), F.count_if(s == "MISSED").alias("missed"), F.count_if(s == "NOT_ATTEMPTED").alias("not_built"))
    return out.withColumn("rate", F.round(F.try_divide("matched", F.col("matched") + F.col("missed")), 6))


def coverage_verdict(lands: Column, differs: Column, blocked: Column, checked: Column) -> Column:
    return F.when((checked == 0) & (blocked > 0), "blocked").when(checked == 0, "queued").when(differs == 0, "reproduced").when(lands == 0, "diverges").otherwise("holds in part")


def coverage(scored: DataFrame) -> DataFrame:
    """One row of totals with the verdict."""
    s = F.col("state")
    row = scored.agg(F.count(F.lit(1)).alias("printed"), F.count_if(s.isin("REPRODUCED", "MISSED")).alias("checks"), F.count_if(s == "REPRODUCED").alias("lands"), F.count_if(s == "MISSED").alias("differs"), F.count_if(s == "UNOBTAINABLE").alias("blocked"), F.countDistinct(F.split("cell", "/")[0]).alias("exhibits"))
    return row.withColumn("verdict", coverage_verdict(F.col("lands"), F.col("differs"), F.col("blocked"), F.col("checks")))


def failures(scored: DataFrame) -> DataFrame:
    """(exhibit, checks, lands, rate, failures) of each exhibit: its share of checked cells that land, and those that do not.

    failures: (cell, published, observed, gap), the widest gap first; an exhibit has as many cells as are printed in it.
    """
    missed = F.when(F.col("state") == "MISSED", F.struct((-F.col("gap")).alias("order"), F.col("cell"), F.col("published"), F.col("observed"), F.col("gap")))
    row = scored.groupBy(F.split("cell", "/")[0].alias("exhibit")).agg(F.count_if(F.col("state").isin("REPRODUCED", "MISSED")).alias("checks"), F.count_if(F.col("state") == "REPRODUCED").alias("lands"), F.array_sort(F.collect_list(missed)).alias("f"))
    return row.select("exhibit", "checks", "lands", F.try_divide("lands", "checks").alias("rate"), F.transform("f", lambda x: F.struct(x["cell"].alias("cell"), x["published"].alias("published"), x["observed"].alias("observed"), x["gap"].alias("gap"))).alias("failures"))


def artifact_status(scored: DataFrame, by: str = "paper") -> DataFrame:
    """(by, status, headline) of scored cells: VERIFIED if all printed numbers are reproduced, ATTEMPTED if some are, else CATALOGUED."""
    s = F.col("state")
    row = scored.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(s == "REPRODUCED").alias("r"))
    status = F.when(F.col("r") == F.col("n"), "VERIFIED").when(F.col("r") > 0, "ATTEMPTED").otherwise("CATALOGUED")
    return row.select(by, status.alias("status"), F.concat("r", F.lit(" of "), "n", F.lit(" published numbers reproduced")).alias("headline"))


def headline(scored: DataFrame) -> DataFrame:
    s = F.col("state")
    row = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(s == "REPRODUCED").alias("r"), F.count_if(s == "MISSED").alias("m"), F.count_if(s == "UNOBTAINABLE").alias("u"), F.count_if(s == "NOT_ATTEMPTED").alias("a"))
    part = lambda c, words: F.when(F.col(c) > 0, F.concat(F.col(c), F.lit(words)))
    return row.select(F.concat_ws(", ", F.concat("r", F.lit(" of "), "n", F.lit(" published numbers reproduced")), part("m", " missed"), part("u", " uncheckable"), part("a", " not built yet")).alias("headline"), ((F.col("n") > 0) & (F.col("r") == F.col("n"))).alias("complete"))


def suggestions(artifacts: DataFrame, cells: DataFrame, eps: float = TRANSCRIPTION) -> DataFrame:
    """(name, cell): cells of the artifact's exhibit whose printed value is within ``eps``; an equi-join on buckets of eps."""
    bucket = lambda c: F.floor(c / eps)
    a = artifacts.select("name", "exhibit", F.col("published").alias("__p"), F.explode(F.array(bucket(F.col("published")) - 1, bucket(F.col("published")), bucket(F.col("published")) + 1)).alias("__b"))
    c = cells.select("cell", "exhibit", F.col("value").alias("__v"), bucket(F.col("value")).alias("__b"))
    return a.join(c, ["exhibit", "__b"]).filter(F.abs(F.col("__p") - F.col("__v")) <= eps).select("name", "cell").distinct()


def judge_target(observed: Column, published: Column, within: Column) -> Column:
    return F.when(observed.isNull(), "NOT_VERIFIED").when(F.abs(observed - published) <= within, "VERIFIED").otherwise("NOT_VERIFIED")


def judge_criterion(observed: Column, threshold: Column, fetchable: Column) -> Column:
    return F.when(~fetchable, "FIXTURE_UNAVAILABLE").when(observed >= threshold, "VERIFIED").otherwise("NOT_VERIFIED")


def bipartisan(votes: DataFrame, direction: str = "agree", least: int = 2) -> DataFrame:
    """(submission, factions, weight, passed): weights of known factions in one direction."""
    sides = votes.filter((F.col("vote") == direction) & (F.coalesce("faction", F.lit("unknown")) != "unknown")).groupBy("submission", "faction").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("w"))
    tally = sides.groupBy("submission").agg(F.count(F.lit(1)).alias("factions"), F.sum("w").alias("weight"))
    out = votes.select("submission").distinct().join(tally, "submission", "left").select("submission", F.coalesce("factions", F.lit(0)).cast("long").alias("factions"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    return out.withColumn("passed", F.col("factions") >= least)


def vote_weight(reputation: Column) -> Column:
    return F.least(F.sqrt(F.greatest(reputation, F.lit(0)).cast("double")), F.lit(10.0))


def infer_faction(history: DataFrame, by: str = "user") -> DataFrame:
    """(user, votes, faction) from votes on challenges."""
    c = F.col("submission_type") == "challenge"
    share = F.count_if(c & (F.col("vote") == "agree")) / F.count_if(c)
    return history.groupBy(by).agg(F.count_if(c).alias("votes"), F.when(F.count_if(c) < 10, "unknown").when(share > 0.7, "ai_skeptic").when(share < 0.3, "ai_truster").otherwise("neutral").alias("faction"))


def reputation(events: DataFrame, by: str = "user", start: int = 10) -> DataFrame:
    """Ordered fold of event deltas with a floor at 0, which no sum can express; an unknown event counts 0.

    events: (user, seq, event).
    """
    deltas = F.create_map(*[x for k, v in EVENTS.items() for x in (F.lit(k), F.lit(v))])
    steps = F.array_sort(F.collect_list(F.struct("seq", F.coalesce(F.try_element_at(deltas, F.col("event")), F.lit(0)).alias("d"))))
    return events.groupBy(by).agg(F.aggregate(steps, F.lit(start), lambda a, x: F.greatest(F.lit(0), a + x["d"])).alias("reputation"))


def platform_metrics(log: DataFrame, window: int = 10) -> DataFrame:
    """Means over the last rows of a log (ts, verdict_accuracy, asymmetric_loss), and the change of the loss over them."""
    w = Window.orderBy(F.desc("ts"))
    last = log.filter("verdict_accuracy is not null").withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= window)
    return last.agg(F.count(F.lit(1)).alias("runs"), F.avg("verdict_accuracy").alias("mean_verdict_accuracy"), F.avg("asymmetric_loss").alias("mean_asymmetric_loss"), (F.max_by("asymmetric_loss", "ts") - F.min_by("asymmetric_loss", "ts")).alias("trend"), F.max("ts").alias("latest_run"))


def regression_alerts(log: DataFrame) -> DataFrame:
    """(ts, alerts) of each row against the row before it."""
    w = Window.orderBy("ts")
    before = lambda c: F.lag(c).over(w)
    hits = [("verdict_accuracy dropped", F.col("verdict_accuracy") < before("verdict_accuracy") - 0.05), ("false_negatives rose", F.col("n_false_negatives") > F.coalesce(before("n_false_negatives"), F.lit(0))), ("asymmetric_loss jumped", F.col("asymmetric_loss") > before("asymmetric_loss") * 1.2)]
    first = F.row_number().over(w) == 1
    return log.select("ts", F.when(first, F.array().cast("array<string>")).otherwise(F.filter(F.array(*[F.when(c, F.lit(m)) for m, c in hits]), lambda x: x.isNotNull())).alias("alerts"))


def attribute(changes: DataFrame, log: DataFrame) -> DataFrame:
    """(ref, fired, mean_delta, verdict): loss of the three rows after a change less that of the last one before.

    changes: (ts, message), which cites refs as critique:<name>.  Both sides come from one ordered pass over the log.
    """
    refs = changes.select("ts", F.explode(F.regexp_extract_all("message", F.lit(r"critique:([A-Za-z0-9_-]+)"), F.lit(1))).alias("ref"))
    both = log.select("ts", F.col("asymmetric_loss").alias("loss"), F.lit(0).alias("kind")).unionByName(changes.select("ts", F.lit(None).cast("double").alias("loss"), F.lit(1).alias("kind")).distinct())
    w = Window.orderBy("ts", "kind")
    rows = both.withColumn("pre", F.last("loss", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    after = F.collect_list(F.struct("ts", "loss")).over(w.rowsBetween(1, 64))
    rows = rows.withColumn("post", F.slice(F.filter(F.transform(F.filter(after, lambda x: x["loss"].isNotNull()), lambda x: x["loss"]), lambda x: x.isNotNull()), 1, 3)).filter("kind = 1 and pre is not null and size(post) > 0")
    rows = rows.withColumn("delta", F.aggregate("post", F.lit(0.0), lambda a, x: a + x) / F.size("post") - F.col("pre"))
    return judged(refs.join(rows.select("ts", "delta"), "ts"))


def judged(deltas: DataFrame) -> DataFrame:
    """(ref, fired, mean_delta, verdict) of (ref, delta): the change of loss at each time a rule fired."""
    out = deltas.groupBy("ref").agg(F.count(F.lit(1)).alias("fired"), F.round(F.avg("delta"), 3).alias("mean_delta"), F.avg("delta").alias("m"))
    some, m = F.col("fired") >= 5, F.col("m")
    return out.select("ref", "fired", "mean_delta", F.when(some & (m < -2), "promote").when(some & (m > 2), "demote").when(some, "low_signal").otherwise("needs_more_data").alias("verdict"))


def severity_histogram(critiques: DataFrame) -> DataFrame:
    """(severity, category, n) of findings ARRAY<STRUCT<severity, category, ...>>."""
    return critiques.select(F.explode("findings").alias("f")).groupBy("f.severity", "f.category").agg(F.count(F.lit(1)).alias("n"))


def call_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Dollars of each call (model, tokens_in, tokens_out) at prices for a million tokens; null for an unknown model."""
    both = calls.join(F.broadcast(prices), "model", "left")
    return both.withColumn("cost", F.col("tokens_in") / 1e6 * F.col("price_in") + F.col("tokens_out") / 1e6 * F.col("price_out")).drop("price_in", "price_out")
