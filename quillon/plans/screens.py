"""Queries over text screens: papers are documents with a phrase of the trade added, so that every rule is met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import rules as R
from quillon.operators import screens as S
from quillon.plans.panels import rounded
from quillon.plans.registry import query
from quillon.sources import views as V
from quillon.sources.views import sql

PHRASES = [
    "momentum in the cross-section of stock returns", "we prove existence and uniqueness of a viscosity solution", "a simulation study on synthetic data", "using data from 1990 to 2015 on the S&P 500", "climate disclosure and corporate governance",
    "garch volatility forecast and implied volatility surface", "an LSTM on 300 stocks with order book data", "hedging bitcoin with options", "the yield curve and inflation", "pure theory of markets", "news sentiment and textual analysis", "risk parity portfolio weights",
    "theorem with Monte Carlo experiments", "copula filter for tail risk", "not available: Wikipedia pageviews are unavailable to us", "trend following backtest on ETFs", "a general equilibrium model of portfolio choice",
]
N = len(PHRASES)
_LIST = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
PAPERS = f"papers AS (SELECT doc_id AS id, 'On ' || ({_LIST})[doc_id % {N} + 1] AS title, text || ' ' || ({_LIST})[(doc_id * 5 + 3) % {N} + 1] || '.' AS abstract, ({_LIST})[(doc_id * 3 + 1) % {N} + 1] AS reason, source, n_chars FROM documents)"


def papers(spark: SparkSession, folder: str) -> DataFrame:
    phrases = F.array(*map(F.lit, PHRASES))
    at = lambda c: F.get(phrases, (c % N).cast("int"))
    d = V.table(spark, folder, "documents")
    return d.select(F.col("doc_id").alias("id"), F.concat(F.lit("On "), at(F.col("doc_id"))).alias("title"), F.concat("text", F.lit(" "), at(F.col("doc_id") * 5 + 3), F.lit(".")).alias("abstract"), at(F.col("doc_id") * 3 + 1).alias("reason"), "source", "n_chars")


def p(body: str) -> str:
    body = body.strip()
    return f"WITH {PAPERS}, {body[5:]}" if body.startswith("WITH ") else f"WITH {PAPERS} {body}"


def rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '(?i){pattern}')"


def case(column: str, table, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {rx(column, pattern)} THEN '{label}'" for label, pattern in table) + f" ELSE '{default}' END"


def listed(column: str, table, limit: int | None = None) -> str:
    items = "list_filter([" + ", ".join(f"CASE WHEN {rx(column, pattern)} THEN '{label}' END" for label, pattern in table) + "], lambda x: x IS NOT NULL)"
    return items if limit is None else f"({items})[1:{limit}]"


TEXT = "title || ' ' || abstract"


@query(
    p(
        f"""WITH t AS (SELECT *, {TEXT} AS x FROM papers),
g AS (SELECT id, CASE WHEN {rx('x', R.ESSAY)} THEN 'essay, governance, policy or disclosure, no mechanism'
WHEN NOT ({rx('title', R.STRATEGY)} OR (length(abstract) >= 260 AND {rx('abstract', R.STRATEGY)})) THEN 'no mechanism named in title or abstract'
WHEN {rx('x', R.UNOBTAINABLE)} THEN 'needs data we cannot fetch (' || lower(regexp_extract(x, '(?i)({R.UNOBTAINABLE})', 1)) || ')'
WHEN {rx('x', R.THEORY_ONLY)} THEN 'theory, not a position (' || lower(regexp_extract(x, '(?i)({R.THEORY_ONLY})', 1)) || ')' ELSE 'runnable' END AS reason FROM t)
SELECT id, reason = 'runnable' AS ok, reason FROM g"""
    )
)
def practical_gate(spark, folder):
    return papers(spark, folder).select("id", S.practical(F.col("title"), F.col("abstract")).alias("g")).select("id", "g.*")


@query(p(f"SELECT id, CASE WHEN {rx(TEXT, R.NEEDS_MORE)} THEN 'blocked' WHEN {rx(TEXT, R.TESTABLE)} THEN 'queued' ELSE 'triage' END AS state FROM papers"))
def testability(spark, folder):
    return papers(spark, folder).select("id", S.testability(F.concat_ws(" ", "title", "abstract")).alias("state"))


_TAXONOMY = case("title || ' ' || reason", S.NARROW + S.WIDE, "|".join(R.CATCH_ALL))


@query(p(f"WITH c AS (SELECT id, string_split({_TAXONOMY}, '|') AS k FROM papers) SELECT id, k[1] AS area, k[2] AS task FROM c"))
def taxonomy_tag(spark, folder):
    return papers(spark, folder).select("id", S.taxonomy(F.concat_ws(" ", "title", "reason")).alias("k")).select("id", "k.*")


@query(p(f"SELECT id, {listed('reason', [(t, q) for _, t, q in R.TASKS], 4)} AS tasks, CASE WHEN len({listed('reason', R.TAGS)}) = 0 THEN ['quant-finance'] ELSE {listed('reason', R.TAGS, 3)} END AS tags FROM papers"))
def topical_tags(spark, folder):
    return papers(spark, folder).select("id", S.task_tags(F.col("reason")).alias("tasks"), S.tags(F.col("reason")).alias("tags"))


@query(p(f"WITH c AS (SELECT string_split({_TAXONOMY}, '|') AS k FROM papers) SELECT k[1] AS area, k[2] AS task, count(*) AS n FROM c GROUP BY ROLLUP (k[1], k[2]) HAVING area IS NOT NULL"))
def area_rollup(spark, folder):
    k = papers(spark, folder).select(S.taxonomy(F.concat_ws(" ", "title", "reason")).alias("k")).select("k.*")
    return k.rollup("area", "task").agg(F.count(F.lit(1)).alias("n")).filter("area is not null")


_SCREEN = f"""t AS (SELECT id, title || chr(10) || abstract AS x FROM papers), s AS (SELECT id, CASE WHEN {rx('x', R.EMPIRICAL)} THEN 'read|names real data or an out-of-sample test'
WHEN {rx('x', R.THEORY)} AND {rx('x', R.SYNTHETIC)} THEN 'skip|theory and simulation only (' || left(trim(regexp_extract(x, '(?i)({R.THEORY})', 1)), 28) || ')'
WHEN {rx('x', R.THEORY)} THEN 'skip|analytical contribution only (' || left(trim(regexp_extract(x, '(?i)({R.THEORY})', 1)), 28) || ')'
WHEN {rx('x', R.SYNTHETIC)} THEN 'skip|simulation only (' || left(trim(regexp_extract(x, '(?i)({R.SYNTHETIC})', 1)), 28) || ')' ELSE 'read|abstract is not explicit, resolve by reading' END AS v FROM t)"""


@query(p("WITH " + _SCREEN + " SELECT id, split_part(v, '|', 1) AS verdict, split_part(v, '|', 2) AS why FROM s"))
def prefilter_screen(spark, folder):
    return papers(spark, folder).select("id", S.abstract_screen(F.col("title"), F.col("abstract")).alias("s")).select("id", "s.*")


@query(p("WITH " + _SCREEN + f", l AS ({V.SQL['ledger']}), j AS (SELECT split_part(v, '|', 1) AS verdict, l.verdict AS label FROM s JOIN l USING (id)) SELECT count(*) FILTER (label = 'keep') AS keeps, count(*) FILTER (label = 'keep' AND verdict <> 'skip') AS kept_and_read, count(*) FILTER (label <> 'keep') AS drops, count(*) FILTER (label <> 'keep' AND verdict = 'skip') AS drops_skipped, round(count(*) FILTER (label = 'keep' AND verdict <> 'skip') / count(*) FILTER (label = 'keep'), 6) AS recall, round(count(*) FILTER (verdict = 'skip') / count(*), 6) AS saved FROM j"))
def screen_eval(spark, folder):
    s = papers(spark, folder).select("id", S.abstract_screen(F.col("title"), F.col("abstract"))["verdict"].alias("verdict"))
    return S.recall_of_screen(s.join(V.ledger(spark, folder).select("id", F.col("verdict").alias("label")), "id"))


@query(p(f"SELECT {case('reason', R.GAPS, 'other')} AS gap, count(*) AS n FROM papers GROUP BY 1"))
def gap_counts(spark, folder):
    return papers(spark, folder).groupBy(S.gap(F.col("reason")).alias("gap")).agg(F.count(F.lit(1)).alias("n"))


_UNIVERSE = f"coalesce(try_cast(nullif(regexp_extract(reason, '(?i){R.BIG_UNIVERSE}', 1), '') AS INTEGER), 0)"


@query(p(f"WITH m AS (SELECT id, reason, {_UNIVERSE} AS u, (id % 6)::INTEGER AS k FROM papers), w AS (SELECT *, reason || ' ' || array_to_string(list_transform(range(k), lambda i: 'source ' || i::VARCHAR), ' ') AS x FROM m) SELECT id, CASE WHEN {rx('x', R.TRAINED)} THEN 'L' WHEN u >= 100 OR k >= 4 THEN 'M' WHEN {rx('x', R.FITTED)} THEN 'M' ELSE 'S' END AS tier, CASE WHEN {rx('x', R.TRAINED)} THEN 'a model has to be trained, so results move with the seed' WHEN u >= 100 OR k >= 4 THEN CASE WHEN u > 0 THEN u || ' names' ELSE k || ' separate sources' END WHEN {rx('x', R.FITTED)} THEN 'an estimator has to be fitted and checked' ELSE 'closed-form on a small universe' END AS why FROM w"))
def effort_tier(spark, folder):
    k = F.col("id") % 6
    needs = F.when(k > 0, F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.concat(F.lit("source "), i))).otherwise(F.array().cast("array<string>"))
    return papers(spark, folder).select("id", S.effort(F.col("reason"), needs).alias("e")).select("id", "e.*")


@query("SELECT doc_id AS id, sum(length(regexp_replace(l, '[^0-9]', '', 'g')))::INTEGER AS digits, (doc_id % 10) / 10.0::DOUBLE >= 0.8 AND sum(length(regexp_replace(l, '[^0-9]', '', 'g'))) >= 40 AS worth FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id")
def numeracy(spark, folder):
    d = V.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), S.numeracy(F.split("text", "\n")).alias("digits"))
    return d.withColumn("worth", S.worth_building((F.col("id") % 10) / 10, F.col("digits")))


@query(p(f"SELECT id, CASE WHEN NOT {rx('reason', R.PAID)} AND {rx('reason', R.UNAVAILABLE)} AND NOT {rx('reason', R.CONCEDED)} THEN {listed('reason', R.FREE)} ELSE [] END AS sources FROM papers"))
def contradictions(spark, folder):
    return papers(spark, folder).select("id", S.contradictions(F.col("reason")).alias("sources"))


@query(sql("works", "SELECT lower(regexp_replace(id::VARCHAR || 'v' || (id % 4)::VARCHAR, 'v[0-9]+$', '')) AS base, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key, left(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), 90) AS key90 FROM works"))
def title_keys(spark, folder):
    w = V.works(spark, folder)
    return w.select(S.base_id(F.concat(F.col("id"), F.lit("v"), F.col("id") % 4)).alias("base"), S.title_key(F.col("title")).alias("key"), S.title_key(F.col("title"), 90).alias("key90"))


@query(sql("works", "SELECT * EXCLUDE (r) FROM (SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key, citations, row_number() OVER (PARTITION BY trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) ORDER BY citations DESC, id) AS r FROM works) WHERE r = 1"))
def dedupe_papers(spark, folder):
    w = V.works(spark, folder).select("id", S.title_key(F.col("title")).alias("key"), "citations")
    return S.dedupe(w, F.col("key"), F.desc("citations"), F.col("id"))


@query("WITH n AS (SELECT source, text, min(doc_id) AS doc_id FROM documents WHERE doc_id % 3 <> 0 GROUP BY ALL) SELECT doc_id, source, text FROM n WHERE NOT EXISTS (SELECT 1 FROM documents k WHERE k.doc_id % 3 = 0 AND k.source = n.source AND k.text = n.text)")
def ingest_antijoin(spark, folder):
    """New records by (source, text), against those that are known."""
    d = V.table(spark, folder, "documents").select("doc_id", "source", "text")
    return S.ingest(d.filter("doc_id % 3 <> 0"), d.filter("doc_id % 3 = 0"), ["source", "text"], "doc_id")


@query(
    p(
        r"""WITH b AS (SELECT id, trim(regexp_replace(coalesce(abstract, ''), '(?i)^[ \t\n\x0B\f\r]*(abstract|this (paper|study|article)|in this (paper|study|article),?( we)?)[:.]?[ \t\n\x0B\f\r]*', '')) AS body FROM papers),
s AS (SELECT id, list_prepend('', string_split(regexp_replace(body, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1))) AS parts FROM b),
t AS (SELECT id, list_reduce(parts, lambda a, x: CASE WHEN a = '' OR length(a) + 1 + length(x) <= 200 THEN trim(a || ' ' || x) ELSE a END) AS taken FROM s)
SELECT id, CASE WHEN length(taken) <= 200 THEN taken ELSE regexp_extract(taken, '(?s)^(.{0,200})([ \t\n\x0B\f\r]|$)', 1) || chr(8230) END AS idea FROM t"""
    )
)
def leading_idea(spark, folder):
    return papers(spark, folder).select("id", S.idea(F.col("abstract")).alias("idea"))


PAIRS = "WITH j AS (SELECT l.verdict AS expected, CASE WHEN n_chars >= 300 THEN 'keep' ELSE 'drop' END AS actual FROM ledger l JOIN documents ON doc_id = id)"


@query(sql("ledger", PAIRS + ", c AS (SELECT c AS class, count(*) FILTER (expected = c AND actual = c) AS tp, count(*) FILTER (expected <> c AND actual = c) AS fp, count(*) FILTER (expected = c AND actual <> c) AS fn FROM j, (SELECT unnest(['keep', 'drop']) AS c) GROUP BY c) SELECT class, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c"))
def confusion_f1(spark, folder):
    d = V.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") >= 300, "keep").otherwise("drop").alias("actual"))
    return rounded(S.confusion(V.ledger(spark, folder).join(d, "id").select(F.col("verdict").alias("expected"), "actual"), ["keep", "drop"]))


@query(sql("ledger", "SELECT source, 5 * count(*) FILTER (verdict = 'keep' AND n_chars < 300) + count(*) FILTER (verdict = 'drop' AND n_chars >= 300) AS loss FROM ledger JOIN documents ON doc_id = id GROUP BY source"))
def asym_loss(spark, folder):
    d = V.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "n_chars", "source")
    k = F.col("verdict") == "keep"
    counts = V.ledger(spark, folder).join(d, "id").groupBy("source").agg(F.count_if(k & (F.col("n_chars") < 300)).alias("fn"), F.count_if(~k & (F.col("n_chars") >= 300)).alias("fp"))
    return counts.select("source", S.asymmetric_loss(F.col("fn"), F.col("fp")).alias("loss"))


@query("WITH t AS (SELECT doc_id AS id, lang AS token, CASE WHEN lang IN ('en', 'fr') THEN 'covered' WHEN lang = 'de' THEN 'not_covered' ELSE 'unknown' END AS c, source FROM documents) SELECT source, CASE WHEN bool_or(c = 'not_covered') THEN 'blocked' WHEN bool_and(c = 'covered') THEN 'full' WHEN bool_or(c = 'covered') THEN 'partial' ELSE 'unknown' END AS coverage FROM t GROUP BY source")
def token_coverage(spark, folder):
    d = V.table(spark, folder, "documents").select("source", S.coverage_class(F.col("lang"), ["en", "fr"], ["de"]).alias("coverage"))
    return S.paper_coverage(d, "source")
