"""Small columns and lookups around papers: clean text, keys, tags, notes, checklists, queues and declared criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fields without which a specification cannot be run
REQUIRED = ("formula", "data_required", "universe", "horizon_days", "expected_sign")


def normalised(text: Column) -> Column:
    """One kind of line break, one blank line at most, one space at most, nothing around."""
    lines = F.regexp_replace(F.translate(text, "\r", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(lines, r"[ \t]+", " "), r"^\s+|\s+$", "")


def is_complete(spec: DataFrame) -> Column:
    """Whether all required fields are there; an empty list of data is none."""
    out = F.lit(True)
    for c in REQUIRED:
        out = out & F.col(c).isNotNull()
    return out & (F.coalesce(F.size("data_required"), F.lit(0)) > 0) if "array" in dict(spec.dtypes)["data_required"] else out


def evaluate(observed: DataFrame, criteria: DataFrame) -> DataFrame:
    """(paper, status, reason): each result against the criterion declared for its paper.

    observed: (paper, value); criteria: (paper, statistic, threshold, fetchable).  No criterion: nothing can be verified.
    """
    both = observed.join(criteria, "paper", "left")
    status = F.when(F.col("statistic").isNull(), "NOT_VERIFIED").when(~F.col("fetchable"), "FIXTURE_UNAVAILABLE").when(F.col("value") >= F.col("threshold"), "VERIFIED").otherwise("NOT_VERIFIED")
    reason = (
        F.when(F.col("statistic").isNull(), "no criterion is declared").when(~F.col("fetchable"), "the data cannot be fetched").when(F.col("value").isNull(), "nothing was observed")
        .otherwise(F.concat(F.col("statistic"), F.when(F.col("value") >= F.col("threshold"), " reaches ").otherwise(" is below "), F.col("threshold").cast("string")))
    )
    return both.select("paper", status.alias("status"), reason.alias("reason"))


def tags(first: Column, second: Column, other: Column, most: int = 5) -> Column:
    """Distinct entries of two lists joined by ``|``, in order, at most ``most``; without any the other column."""
    parts = F.transform(F.split(F.concat_ws("|", first, second), r"\|", -1), lambda x: F.trim(x))
    found = F.slice(F.array_distinct(F.filter(parts, lambda x: x != "")), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(other))


def paper_key(*names: Column, url: Column) -> Column:
    """The first name that is there, else the last part of the address without its version."""
    last = F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"([^/?#]+)/?(?:[?#].*)?$", 1), r"v[0-9]+$", "")
    return F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names], F.nullif(last, F.lit("")))


def notes(text: Column) -> Column:
    """A JSON object of notes as a map; what is none is empty."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def profile_likeness(x: str, y: str) -> Column:
    """Correlation of two profiles within [0, 1]; 0 where one does not vary."""
    both = F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.covar_samp(x, y), both), F.lit(0.0))))


def checklist_cells(checklists: DataFrame) -> DataFrame:
    """(paper, id, cell) of checklists (paper, exhibits ARRAY<STRUCT<name, cells ARRAY<STRUCT<id, cell>>>>)."""
    exhibits = checklists.select("paper", F.explode("exhibits").alias("e"))
    return exhibits.select("paper", F.explode("e.cells").alias("c")).select("paper", "c.id", "c.cell")


def kept_files(files: DataFrame, keep: DataFrame) -> DataFrame:
    """Files whose name, without folder, extension and case, is one of ``keep`` (key)."""
    name = F.lower(F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""))
    return files.withColumn("__key", name).join(keep.select(F.lower("key").alias("__key")).distinct(), "__key", "left_semi").drop("__key")


def drained(queue: DataFrame, limit: int, judge: Column) -> DataFrame:
    """The queue with its oldest pending papers judged: (id, inserted, status); at most ``limit`` of them at a time."""
    due = queue.filter("status = 'pending'").orderBy("inserted", "id").limit(limit).select("id", judge.alias("__new"))
    return queue.join(F.broadcast(due), "id", "left").withColumn("status", F.coalesce("__new", "status")).drop("__new")


def newest(rows: DataFrame, by: str, time: str, n: int) -> DataFrame:
    """The newest ``n`` rows of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(time)))).filter(F.col("__r") <= n).drop("__r")


def first_object(text: Column) -> Column:
    """The first JSON object in a text, by its braces outside of strings; null if none is closed.

    One pass over the characters in the JVM: depth of braces, whether inside a string, and whether the last character was an escape.
    """
    # state: 0 looking, 1 inside braces, 2 inside a string, 3 after an escape in a string, 4 found
    kind = "struct<at:int,state:int,depth:int,start:int,stop:int>"

    def step(s: Column, c: Column) -> Column:
        state, depth = s["state"], s["depth"]
        opens, closes = c == "{", (c == "}") & (state == 1)
        after = (
            F.when(state == 4, 4).when(state == 3, 2).when((state == 2) & (c == "\\"), 3).when((state == 2) & (c == '"'), 1).when(state == 2, 2)
            .when(opens, 1).when(closes & (depth == 1), 4).when((state == 1) & (c == '"'), 2).otherwise(state)
        )
        outside = state < 2
        return F.struct(
            (s["at"] + 1).alias("at"), after.alias("state"), (depth + F.when(outside & opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.when((state == 0) & opens, s["at"]).otherwise(s["start"]).alias("start"), F.when(closes & (depth == 1), s["at"]).otherwise(s["stop"]).alias("stop"),
        ).cast(kind)

    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("state"), F.lit(0).alias("depth"), F.lit(0).alias("start"), F.lit(0).alias("stop")).cast(kind)
    done = F.aggregate(F.split(text, ""), start, step)
    return F.when(done["stop"] > 0, F.substr(text, done["start"], done["stop"] - done["start"] + 1))


def sanity(observed: DataFrame, checks: DataFrame) -> DataFrame:
    """(paper, name, against, observed, description, verifies) of weaker comparisons, which inform and never verify.

    observed: (paper, value); checks: (paper, name, against, statistic, note).  Papers without a check have no row.
    """
    value = F.coalesce(F.format_string("%.4f", "value"), F.lit("not computed"))
    said = F.concat(F.col("statistic"), F.lit(" vs "), F.col("against"), F.lit(": "), F.when(F.col("value").isNull(), "not computed").otherwise(value), F.lit(". "), F.col("note"))
    return observed.join(checks, "paper").select("paper", "name", "against", F.col("value").alias("observed"), said.alias("description"), F.lit(False).alias("verifies"))


def applied(config: DataFrame, proposals: DataFrame) -> DataFrame:
    """(name, path, value, state) of a configuration (name, path, value) with proposals (name, path, value, at) set at their dotted paths.

    Of several proposals for a path the latest counts (ties: the larger value).  One whose path lies below a value, or above one, of the same name is refused, as a
    value can't have parts.  state: kept, set, added or refused.
    """
    last = proposals.groupBy("name", "path").agg(F.max_by("value", F.struct("at", "value")).alias("new"))
    above = lambda df, c: df.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", r"\."))), lambda k: F.array_join(F.slice(F.split("path", r"\."), F.lit(1), k), "."))).alias(c), "path").filter(F.col(c) != F.col("path"))
    below_value = above(last, "leaf").join(config.select("name", F.col("path").alias("leaf")), ["name", "leaf"], "left_semi").select("name", "path")
    over_value = above(config, "top").select("name", F.col("top").alias("path")).join(last.select("name", "path"), ["name", "path"], "left_semi")
    refused = below_value.unionByName(over_value).distinct().withColumn("refused", F.lit(True))
    both = config.select("name", "path", "value").join(last, ["name", "path"], "full").join(refused, ["name", "path"], "left")
    state = F.when(F.col("refused"), "refused").when(F.col("new").isNull(), "kept").when(F.col("value").isNull(), "added").otherwise("set")
    return both.select("name", "path", F.coalesce("new", "value").alias("value"), state.alias("state"))


def nested(config: DataFrame, depth: int = 4) -> DataFrame:
    """(name, json) of configuration rows: objects built from the deepest level of paths, at most ``depth``, upwards; keys in order."""
    rows = config.select("name", F.split("path", r"\.").alias("parts"), F.to_json(F.struct(F.col("value").alias("v"))).alias("j")).select("name", "parts", F.expr("substring(j, 6, length(j) - 6)").alias("json"))
    for level in range(depth, 0, -1):
        deep = F.size("parts") == level
        key = F.element_at("parts", -1)
        made = rows.filter(deep).groupBy("name", F.slice("parts", 1, level - 1).alias("parts")).agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), "json"))).alias("x"))  # as many as an object has keys
        rows = rows.filter(~deep).unionByName(made.select("name", "parts", F.concat(F.lit("{"), F.array_join(F.transform("x", lambda x: F.concat(F.lit('"'), x["k"], F.lit('":'), x["json"])), ","), F.lit("}")).alias("json")))
    return rows.filter(F.size("parts") == 0).select("name", "json")
