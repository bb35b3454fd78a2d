"""Operator 4 [native]: URL verdicts by a sort-merge range join with nested rules of hosts and paths.

A canonical key is the host's labels in reverse order, each ended by one character, then another character and the path.
The keys that begin with a rule's key are one interval, and the intervals of two rules are nested or disjoint.  A rule
holds for subdomains too, so a URL looks itself up once for each of its host's endings, as far as rules have labels.
These keys and the starts and ends of the intervals are sorted together, and one sweep finds the open intervals of every
key.  They are a stack, as they nest: a start pushes its rule, an end pops it, which uncovers the rule around it.  What is
uncovered depends on the rules alone and is joined to each end beforehand, so the top of the stack is a running ``last`` and
costs the same however many rules a host has.  The top has the longest path; of a URL's endings the longest decides.  With
equal host and path the first in the order of the rules counts.

Only distinct pairs of host and path (as far as rules can see) are swept, so repeated URLs cost one row.  Sweeps run per
bucket (the last label of the host); a bucket with more than its share is dealt over several salts, to each of which the
bucket's rules are copied.  There are at most as many such buckets as twice the shuffle partitions, so their list may be
broadcast.

Defined results: a null URL or one without ``://`` has an empty host and path and gets the default verdict unless a rule
of the empty host fits; repeated rows are judged each; an empty table gives no rows; without rules all get the default;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.plans.shared import partitions

#: (action, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
DEFAULT = "allow"
RULE = "action string, host string, path string, rank int"
#: pieces of an even share that a bucket is cut into
FINER = 4


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(host: Column, path: Column) -> Column:
    """Bytes whose order keeps together what begins alike; characters that separate are escaped in labels."""
    labels = F.split(host, r"\.", -1)
    safe = F.transform(labels, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "\x00", "\x000"), "\x01", "\x001"), "\x02", "\x002"))
    return F.concat(F.array_join(F.reverse(safe), "\x01"), F.lit("\x01\x02"), path).cast("binary")


def bucket_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def ending(host: Column, labels: Column) -> Column:
    """The host's last ``labels`` labels."""
    parts = F.split(host, r"\.", -1)
    return F.array_join(F.slice(parts, F.size(parts) - labels + 1, labels), ".")


def rule_events(rules: DataFrame) -> DataFrame:
    """(bucket, key, top): the starts and ends of the rules' intervals, with the rule that is on top of the stack then."""
    own = rules.groupBy("host", "path").agg(F.min_by("action", "rank").alias("action"))
    # the rule around another: its path is the longest proper beginning that is a rule of the same host
    begins = own.filter("path <> ''").select("host", F.col("path").alias("inner"), F.explode(F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda n: F.substring("path", F.lit(1), n))).alias("path"))
    around = begins.join(own, ["host", "path"]).groupBy("host", "inner").agg(F.max_by(F.struct("host", "path", "action"), F.length("path")).alias("top"))
    nowhere = F.struct(*(F.lit(None).cast("string").alias(c) for c in ("host", "path", "action")))
    key, bucket = key_of(F.col("host"), F.col("path")).alias("key"), bucket_of(F.col("host")).alias("bucket")
    starts = own.select(bucket, key, F.struct("host", "path", "action").alias("top"))
    ends = own.withColumnRenamed("path", "inner").join(around, ["host", "inner"], "left").select(bucket, F.concat(key_of(F.col("host"), F.col("inner")), F.unhex(F.lit("FF"))).alias("key"), F.coalesce("top", nowhere).alias("top"))
    return starts.unionByName(ends)


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each URL; rules: action, host, path, rank."""
    n = partitions(urls.sparkSession)
    pages = urls.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    most = rules.agg(F.max(F.size(F.split("host", r"\.", -1))), F.max(F.length("path"))).first()  # one row
    if most[0] is None:
        return pages.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    pages = pages.withColumn("seen", F.substring("path", 1, most[1]))
    points = pages.select("host", "seen").distinct().withColumn("bucket", bucket_of(F.col("host")))
    counts = points.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # a bucket is salted only if it has more than 1 / (2 n) of all rows, so there are fewer than 2 n of them
    hot = counts.crossJoin(F.broadcast(total)).filter(F.col("n") * (2 * n) > F.col("total")).select("bucket", F.ceil(F.col("n") * FINER * n / F.col("total")).cast("int").alias("salts"))
    hot = F.broadcast(hot)
    salts = F.coalesce("salts", F.lit(1))
    points = points.join(hot, "bucket", "left").withColumn("salt", F.pmod(F.xxhash64("host", "seen"), salts).cast("int")).drop("salts")
    labels = F.least(F.size(F.split("host", r"\.", -1)), F.lit(most[0]))
    points = points.withColumn("labels", F.explode(F.sequence(F.lit(1), labels)))
    points = points.withColumn("key", key_of(ending(F.col("host"), F.col("labels")), F.col("seen")))
    events = rule_events(rules).join(hot, "bucket", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    rows = points.withColumn("kind", F.lit(1)).unionByName(events.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy("bucket", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.withColumn("open", F.last("top", ignorenulls=True).over(sweep)).filter("kind = 1 and open.action is not null")
    judged = swept.groupBy("host", "seen").agg(F.max_by("open", "labels").alias("best"))
    out = pages.join(judged, ["host", "seen"], "left")
    return out.select("page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages under the fixed rules."""
    rules = spark.createDataFrame([(*r, k) for k, r in enumerate(RULES)], RULE)
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


SQL = r"""
WITH parts AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages),
rules(action, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
    SELECT p.page_id, p.host, p.path, arg_max(r.host || r.path, length(r.host) * 10000 + length(r.path)) AS rule, arg_max(r.action, length(r.host) * 10000 + length(r.path)) AS action
    FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    GROUP BY p.page_id, p.host, p.path)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits
"""
