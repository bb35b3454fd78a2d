"""Operator 3 [native]: licences of files by TF-IDF cosine to templates, inherited from the nearest ancestor directory.

Units of text are compared with templates (``license_texts``: full texts, notices, SPDX tags): every line of a file that
bears a licence term, every header block (lines without a blank line between them) that bears one, and the whole text of a
licence file (by name).  Equal units are scored once, with their number: document frequencies are over all units.  A
unit's licence is that of the template of the highest cosine at or above ``threshold`` (ties: smallest name), a file's that
of its best unit.  A licence file speaks for its directory.  Files without a licence of their own take that of the nearest
directory above that has one: distinct directories are exploded into their ancestors and joined by path, and the files
join their directory.

Only joins on equality; sparse vectors are rows (unit key, word, weight); hot lines and hot directories are one row each
until the files join them, where a large side may be split.  A word that most units have is one row of the document
frequencies, and the units' words beside it are a written table whose side may be split too; template words are broadcast
if they are few, which is counted.

Defined results: null paths and texts are empty; a file without ``/`` is in the directory ``""``, which is above all;
several licence files of a directory: the best score, then the smallest name; repeated rows are files of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import license_texts
from quillon.plans.shared import staged

TERMS = r"(?i)(licen[cs]e|copyright|spdx|permission is hereby|redistribution and use|source code form|public domain|creative commons)"
BLANK = r"\n[ \t\r]*\n"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.\-].*)?$"
THRESHOLD = 0.8
#: rows of template words up to which they are broadcast
BROADCAST_WORDS = 1_000_000


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda w: w != "")


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def vectors(units: DataFrame) -> DataFrame:
    """(unit, word, tf) of units (unit, body); ``unit`` is a key, so that rows stay short."""
    return units.select("unit", F.explode(words(F.col("body"))).alias("word")).groupBy("unit", "word").agg(F.count(F.lit(1)).alias("tf"))


def score_units(units: DataFrame, templates: DataFrame, threshold: float) -> DataFrame:
    """(unit, license, score) at or above the threshold of distinct units (unit, body, times); templates: name, body."""
    tf = staged(vectors(units), "unit-words")
    total = units.agg(F.sum("times").alias("total"))  # one row
    df = tf.join(units.select("unit", "times"), "unit").groupBy("word").agg(F.sum("times").alias("df"))
    idf = staged(df.crossJoin(F.broadcast(total)).select("word", "total", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    # words that no unit has weigh most, so that a unit must have most of a template
    keyed = templates.select("name", F.concat_ws("|", "name", F.md5("body")).alias("unit"), "body").distinct()
    base = vectors(keyed).withColumnRenamed("unit", "template")
    known = base.join(idf.select("word", "idf"), "word", "left").crossJoin(F.broadcast(total)).select("template", "word", (F.col("tf") * F.coalesce("idf", F.log(1 + F.col("total")) + 1)).alias("v"))
    known = staged(known, "template-weights")
    few = F.broadcast if known.count() <= BROADCAST_WORDS else (lambda x: x)
    weighted = tf.join(idf, "word").select("unit", "word", (F.col("tf") * F.col("idf")).alias("w"))
    sizes = known.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("template_norm")).join(keyed.select(F.col("unit").alias("template"), "name"), "template")
    norms = weighted.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("unit_norm"))
    dots = weighted.join(few(known), "word").groupBy("unit", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("unit_norm") * F.col("template_norm")), 6)
    scored = dots.join(norms, "unit").join(few(sizes), "template").select("unit", "name", cosine.alias("score")).filter(F.col("score") >= threshold)
    return scored.groupBy("unit").agg(F.max("score").alias("score"), F.min_by("name", F.struct(-F.col("score"), "name")).alias("license"))


def scan_licenses(files: DataFrame, templates: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(doc_id, path, own_license, own_score, license, license_dir) for each file.

    license: its own, else the nearest directory's, else null; license_dir: that directory, null if its own.
    """
    path = F.coalesce(F.col(path_col), F.lit(""))
    files = files.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # files of one id and one path may be different: the text tells them apart
    files = files.withColumn("dir", directory(F.col("path"))).withColumn("is_license", F.substring_index("path", "/", -1).rlike(LICENSE_FILE)).withColumn("file", F.unhex(F.md5(F.concat_ws("|", F.md5("path"), F.md5("text")))))
    parts = F.concat(F.split("text", "\n", -1), F.split("text", BLANK, -1))
    parts = F.when(F.col("text").rlike(TERMS), F.filter(parts, lambda x: x.rlike(TERMS))).otherwise(F.array().cast("array<string>"))
    units = F.array_distinct(F.when(F.col("is_license"), F.concat(parts, F.array("text"))).otherwise(parts))
    named = files.select("doc_id", "file", "dir", "is_license", F.explode(units).alias("body")).withColumn("unit", F.unhex(F.md5("body")))
    distinct = staged(named.groupBy("unit").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("times")), "license-units")
    scores = staged(score_units(distinct, templates, threshold), "license-scores")
    files = files.select("doc_id", "path", "file", "dir")
    best = named.drop("body").join(scores, "unit").groupBy("doc_id", "file", "dir", "is_license").agg(F.max("score").alias("own_score"), F.min_by("license", F.struct(-F.col("score"), "license")).alias("own_license"))
    best = staged(best, "license-files")
    spoken = best.filter("is_license").groupBy("dir").agg(F.min_by("own_license", F.struct(-F.col("own_score"), "own_license")).alias("license"))
    # the directory itself, then its parents up to ""
    parts = F.split("dir", "/", -1)
    up = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")), F.array(F.lit(""))))
    above = files.select("dir").distinct().select("dir", F.explode(F.array_distinct(up)).alias("above"))
    nearest = above.join(spoken.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by(F.struct("license", "above"), F.length("above")).alias("near"))
    nearest = nearest.select("dir", F.col("near.license").alias("dir_license"), F.col("near.above").alias("above"))
    own = best.select("doc_id", "file", "own_score", "own_license")
    rows = files.join(own, files["doc_id"].eqNullSafe(own["doc_id"]) & (files["file"] == own["file"]), "left").select(files["doc_id"], files["path"], files["dir"], "own_license", "own_score")
    out = rows.join(nearest, "dir", "left")
    mine = F.col("own_license").isNotNull()
    return out.select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"), F.when(~mine, F.col("above")).alias("license_dir"))


PATH = "concat(coalesce(source, 'none'), '/', doc_id % 3, '/', doc_id % 12, '/', CASE WHEN doc_id % 40 = 0 THEN 'LICENSE' ELSE concat(doc_id, '.txt') END)"


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, taken as files in directories of their source."""
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(PATH).alias("path"), "text")
    return scan_licenses(files, spark.createDataFrame(license_texts.templates(), "name string, body string"))


_VALUES = ", ".join("('{}', '{}')".format(name, body.replace("'", "''")) for name, body in license_texts.templates())
SQL = rf"""
WITH templates(name, body) AS (VALUES {_VALUES}),
files AS (SELECT doc_id, {PATH} AS path, coalesce(text, '') AS text FROM documents),
dirs AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_matches(path, '/LICENSE$') AS is_license FROM files),
named AS (
    SELECT DISTINCT doc_id, path, dir, is_license, unit FROM (
        SELECT doc_id, path, dir, is_license, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '\n[ \t\r]*\n'))) AS unit FROM dirs)
    WHERE regexp_matches(unit, '{TERMS}')
    UNION SELECT doc_id, path, dir, is_license, text FROM dirs WHERE is_license),
units AS (SELECT unit, count(*) AS times FROM named GROUP BY unit),
uw AS (SELECT unit, word, count(*) AS tf FROM (SELECT unit, unnest(regexp_extract_all(lower(unit), '[a-z0-9]+')) AS word FROM units) GROUP BY ALL),
total AS (SELECT sum(times)::DOUBLE AS total FROM units),
idf AS (SELECT word, ln((1 + (SELECT total FROM total)) / (1 + sum(times))) + 1 AS idf FROM uw JOIN units USING (unit) GROUP BY word),
bodies AS (SELECT name, name || '|' || md5(body) AS template, body FROM templates),
tw AS (SELECT name, template, word, tf * coalesce(idf, ln(1 + (SELECT total FROM total)) + 1) AS w FROM (
    SELECT name, template, word, count(*) AS tf FROM (SELECT name, template, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS word FROM bodies) GROUP BY ALL) LEFT JOIN idf USING (word)),
ww AS (SELECT unit, word, tf * idf AS w FROM uw JOIN idf USING (word)),
scored AS (
    SELECT unit, name, max(round(dot / (un * tn), 6)) AS score
    FROM (SELECT unit, name, template, sum(ww.w * tw.w) AS dot FROM ww JOIN tw USING (word) GROUP BY ALL)
    JOIN (SELECT unit, sqrt(sum(w * w)) AS un FROM ww GROUP BY unit) USING (unit) JOIN (SELECT template, sqrt(sum(w * w)) AS tn FROM tw GROUP BY template) USING (template)
    WHERE round(dot / (un * tn), 6) >= 0.8 GROUP BY unit, name),
best AS (
    SELECT * FROM (SELECT doc_id, path, dir, is_license, name, score, row_number() OVER (PARTITION BY doc_id, path ORDER BY score DESC, name) AS r FROM named JOIN scored USING (unit)) WHERE r = 1),
spoken AS (SELECT * FROM (SELECT dir, name, row_number() OVER (PARTITION BY dir ORDER BY score DESC, name) AS r FROM best WHERE is_license) WHERE r = 1),
near AS (
    SELECT * FROM (SELECT d.dir, s.name, s.dir AS above, row_number() OVER (PARTITION BY d.dir ORDER BY length(s.dir) DESC) AS r
    FROM (SELECT DISTINCT dir FROM dirs) d JOIN spoken s ON d.dir = s.dir OR starts_with(d.dir, s.dir || '/')) WHERE r = 1)
SELECT d.doc_id, d.path, b.name AS own_license, b.score AS own_score, coalesce(b.name, n.name) AS license, CASE WHEN b.name IS NULL THEN n.above END AS license_dir
FROM dirs d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.path = d.path LEFT JOIN near n ON n.dir = d.dir
"""
