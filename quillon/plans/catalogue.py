"""Queries over works, ranks, marked-up text, nested records and the catalogue."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import postings as I
from quillon.operators import ranking as K
from quillon.plans import shared
from quillon.plans.panels import rounded
from quillon.plans.registry import query
from quillon.sources import paged
from quillon.sources import records as R
from quillon.sources import views as V
from quillon.sources.views import sql

WEIGHTS = {"impact": 0.4, "standing": 0.3, "reach": 0.15, "momentum": 0.1, "access": 0.05}
EXTRA = "extra AS (SELECT *, CASE WHEN id % 9 <> 0 THEN (id * 7919 % 1000) / 1000.0::DOUBLE END AS pctile, (id * 31 % 40)::INTEGER AS cites_recent2, (id * 17 % 30)::INTEGER AS cites_prior2, id % 2 = 0 AS is_oa FROM works)"


def works(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("id")
    return V.works(spark, folder).withColumns({"pctile": F.when(i % 9 != 0, (i * 7919 % 1000) / 1000.0), "cites_recent2": (i * 31 % 40).cast("int"), "cites_prior2": (i * 17 % 30).cast("int"), "is_oa": i % 2 == 0})


@query(
    sql(
        "works",
        f"WITH {EXTRA}, b AS (SELECT *, CASE WHEN cites_prior2 + cites_recent2 = 0 THEN 0.0::DOUBLE ELSE cites_recent2::DOUBLE / greatest(cites_prior2, 3) END AS mom_raw, ln(1 + citations) AS reach_raw FROM extra WHERE year >= 1990 AND citations >= 10 AND topic NOT IN ('xx'))"
        ", s AS (SELECT id, percent_rank() OVER (ORDER BY fwci NULLS FIRST) AS s_impact, percent_rank() OVER (ORDER BY pctile NULLS FIRST) AS s_standing, percent_rank() OVER (ORDER BY reach_raw) AS s_reach, percent_rank() OVER (ORDER BY mom_raw) AS s_momentum, CASE WHEN is_oa THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s_access FROM b)"
        " SELECT id, round(s_standing, 6) AS s_standing, round(s_momentum, 6) AS s_momentum, round(100 * (0.4::DOUBLE * s_impact + 0.3::DOUBLE * s_standing + 0.15::DOUBLE * s_reach + 0.1::DOUBLE * s_momentum + 0.05::DOUBLE * s_access), 6) AS score FROM s",
    )
)
def percent_rank_corpus(spark, folder):
    return rounded(K.rank_works(works(spark, folder).drop("title", "abstract", "venue"), WEIGHTS, dropped=("xx",)).select("id", "s_standing", "s_momentum", "score"))


@query(sql("works", "SELECT id, year, CASE WHEN count(*) OVER (PARTITION BY year) = 1 THEN 0.5::DOUBLE ELSE 1 - (row_number() OVER (PARTITION BY year ORDER BY citations DESC, id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY year) END AS percentile FROM works"))
def year_midrank(spark, folder):
    return K.year_percentile(V.works(spark, folder)).select("id", "year", "percentile")


@query(sql("works", "SELECT id, round(citations / greatest((DATE '2026-01-01' - make_date(year, 6, 15)) / 30.44::DOUBLE, 1.0::DOUBLE), 6) AS per_month FROM works"))
def citations_per_month(spark, folder):
    return rounded(V.works(spark, folder).select("id", K.per_month(F.col("citations"), F.make_date("year", F.lit(6), F.lit(15)), "2026-01-01").alias("per_month")))


@query(sql("works", "WITH w(win, days, quota) AS (VALUES ('30d', 30, 5), ('12m', 365, 12), ('5y', 1825, 40), ('all', 100000, 60)), a AS (SELECT id, citations, (2026 - year) * 365 + id % 60 AS age FROM works), r AS (SELECT win AS \"window\", id, citations, age, row_number() OVER (PARTITION BY win ORDER BY citations DESC, id) AS place, quota FROM a JOIN w ON age <= days) SELECT \"window\", id, citations, age, place FROM r WHERE place <= quota"))
def window_quotas(spark, folder):
    w = V.works(spark, folder).select("id", "citations", ((2026 - F.col("year")) * 365 + F.col("id") % 60).alias("age"))
    return K.quota(w, [("30d", 30, 5), ("12m", 365, 12), ("5y", 1825, 40), ("all", 100000, 60)])


@query(sql("works", f"WITH {EXTRA}, t AS (SELECT venue AS tag, count(*) AS papers, sum(cites_recent2) AS recent, sum(cites_prior2) AS prior FROM extra GROUP BY 1) SELECT tag, papers, recent::BIGINT AS recent, prior::BIGINT AS prior, round(recent / greatest(prior, 1), 6) AS ratio FROM t WHERE papers >= 4 AND prior >= 20 AND recent / greatest(prior, 1) > 1 ORDER BY ratio DESC, tag LIMIT 8"))
def trending_topics(spark, folder):
    w = works(spark, folder)
    return rounded(K.trending(w.select(F.col("venue").alias("tag"), F.col("cites_recent2").alias("recent"), F.col("cites_prior2").alias("prior"))))


@query(sql("works", "WITH t AS (SELECT venue AS tag, count(*) AS n, count(*) FILTER (year >= 2015) AS recent FROM works GROUP BY 1) SELECT tag, n, recent, round((recent / (SELECT count(*) FROM works WHERE year >= 2015)) / (n / (SELECT count(*) FROM works)), 6) AS lift FROM t WHERE recent >= 2 ORDER BY (recent / (SELECT count(*) FROM works WHERE year >= 2015)) / (n / (SELECT count(*) FROM works)) DESC, tag LIMIT 7"))
def topic_lift(spark, folder):
    return rounded(K.lift(V.works(spark, folder).select(F.col("venue").alias("tag"), (F.col("year") >= 2015).alias("is_recent"))))


@query(sql("works", "SELECT venue, count(*) AS n FROM works GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12"))
def common_venues(spark, folder):
    return K.most_common(V.works(spark, folder), "venue", 12)


HTML = r"""regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"""


@query(rf"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace({HTML}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text, regexp_extract(coalesce(url, ''), '([^/]*)$', 1) AS last_segment FROM pages")
def html_strip(spark, folder):
    return V.table(spark, folder, "pages").select("page_id", R.stripped(F.col("html")).alias("text"), R.last_segment(F.col("url")).alias("last_segment"))


@query(sql("works", "SELECT id, coalesce(nullif(left(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 80), ''), 'untitled') AS slug FROM works"))
def title_slug(spark, folder):
    return V.works(spark, folder).select("id", R.slug(F.col("title")).alias("slug"))


@query("SELECT doc_id AS id, text AS abstract FROM documents WHERE text IS NOT NULL")
def abstract_rebuild(spark, folder):
    """Text through an inverted index and back."""
    return rebuilt(V.table(spark, folder, "documents"))


#: texts whose indexes are held at a time
TEXTS = 50


def inverted(batches):
    """(id, index): maps of the words between single spaces to their places, for a few texts at a time however large a batch is."""
    kind = pa.map_(pa.string(), pa.list_(pa.int32()))
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part, maps = batch.slice(at, TEXTS), []
            for text in part.column(1):
                places: dict[str, list[int]] = {}
                for k, w in enumerate(text.as_py().split(" ")):
                    places.setdefault(w, []).append(k)
                maps.append(list(places.items()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(maps, kind)], ["id", "index"])


def rebuilt(documents: DataFrame) -> DataFrame:
    """Each document's words as an inverted index and then as text again; a row stays one row, unshuffled."""
    texts = documents.filter("text is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    return texts.mapInArrow(inverted, "id long, index map<string, array<int>>").select("id", R.abstract_of(F.col("index")).alias("abstract"))


@query("SELECT event_id, try_cast(props->>'$.k' AS BIGINT) AS k, event_type FROM events WHERE try_cast(props->>'$.k' AS BIGINT) IS NOT NULL")
def json_fields(spark, folder):
    return V.table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), "event_type").filter("k is not null")


@query(sql("works ledger", "WITH c AS (SELECT w.id, title, abstract AS method, venue AS finding, CASE WHEN l.verdict IS NULL THEN 'CATALOGUED' WHEN l.verdict = 'keep' AND confidence = 1 THEN 'VERIFIED' ELSE 'ATTEMPTED' END AS status, CASE WHEN w.id % 2 = 0 THEN 'paper' ELSE 'spec' END AS kind FROM works w LEFT JOIN ledger l USING (id)) SELECT id, title, status FROM c WHERE contains(lower(title || ' ' || method || ' ' || finding), 'the') AND contains(lower(title || ' ' || method || ' ' || finding), 'src') AND status = 'ATTEMPTED' AND kind = 'paper' ORDER BY id LIMIT 20"))
def search_catalogue(spark, folder):
    return K.search(catalogue(spark, folder), "the SRC", "attempted", "Paper").select("id", "title", "status")


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    w, led = V.works(spark, folder), V.ledger(spark, folder)
    s = F.when(F.col("verdict").isNull(), "CATALOGUED").when((F.col("verdict") == "keep") & (F.col("confidence") == 1), "VERIFIED").otherwise("ATTEMPTED")
    return w.join(led, "id", "left").select("id", "title", F.col("abstract").alias("method"), F.col("venue").alias("finding"), s.alias("status"), F.when(F.col("id") % 2 == 0, "paper").otherwise("spec").alias("kind"))


@query("SELECT o_custkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'CATALOGUED' WHEN o_custkey % 7 = 0 THEN 'VERIFIED' WHEN o_custkey % 7 = 1 THEN 'ATTEMPTED' WHEN bool_and(o_orderstatus = 'F') THEN 'VERIFIED' ELSE 'ATTEMPTED' END AS status FROM orders GROUP BY 1")
def catalogue_status(spark, folder):
    o = V.table(spark, folder, "orders")
    i = F.col("id")
    runs = o.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.struct(F.col("o_orderstatus").alias("got"), F.lit("F").alias("want"))).alias("families"))
    runs = runs.withColumn("has_run", i % 5 != 0).withColumn("verification", F.when(i % 7 == 0, "VERIFIED").when(i % 7 == 1, "NOT_VERIFIED"))
    return K.status(runs).select("id", "status")


@query("WITH a AS (SELECT doc_id AS id, unnest([1, 2, 3]) AS place FROM documents), k AS (SELECT id, place, 'k' || ((id * place) % 97)::VARCHAR AS key FROM a), r AS (SELECT 'k' || p_partkey AS key, 'run ' || p_partkey AS run FROM part) SELECT id, arg_min(run, place) AS run FROM k JOIN r USING (key) GROUP BY id")
def alias_join(spark, folder):
    return aliased(spark, folder, V.table(spark, folder, "part"))


def aliased(spark: SparkSession, folder: str, parts: DataFrame) -> DataFrame:
    i = F.col("id")
    d = V.table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    records = d.withColumn("aliases", F.array(*[F.concat(F.lit(" K"), (i * k) % 97, F.lit("v2")) for k in (1, 2, 3)]))
    runs = parts.select(F.concat(F.lit("k"), "p_partkey").alias("key"), F.concat(F.lit("run "), "p_partkey").alias("run"))
    return K.resolve_aliases(records, runs)


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def source_counts(spark, folder):
    return V.table(spark, folder, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(sql("works", "SELECT id, 'y' || year AS key FROM works WHERE id % 2 = 0 UNION ALL (SELECT id, 'y' || year FROM works WHERE id % 3 = 0 EXCEPT ALL SELECT id, 'y' || year FROM works WHERE id % 2 = 0)"))
def set_operations(spark, folder):
    """Union of one set with what another has beyond it."""
    w = V.works(spark, folder).select("id", F.concat(F.lit("y"), "year").alias("key"))
    return w.filter("id % 2 = 0").unionByName(w.filter("id % 3 = 0").exceptAll(w.filter("id % 2 = 0")))


@query(sql("works", "SELECT id, 'y' || year AS key FROM works WHERE id % 2 = 0 INTERSECT SELECT id, 'y' || year FROM works WHERE id % 3 = 0"))
def common_keys(spark, folder):
    """What two sets have in common."""
    w = V.works(spark, folder).select("id", F.concat(F.lit("y"), "year").alias("key"))
    return w.filter("id % 2 = 0").intersect(w.filter("id % 3 = 0"))


@query("SELECT doc_id, CASE WHEN y <> 0 AND y < 2023 THEN make_date(y + 1, 1, 1) END AS start, CASE WHEN y <> 0 AND y < 2023 THEN DATE '2024-01-01' END AS stop FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN NULL ELSE 1990 + (doc_id % 37)::INTEGER END AS y FROM documents)")
def post_sample_windows(spark, folder):
    """The years after each paper's sample, none where the sample ends too late or is not known."""
    i = F.col("doc_id")
    year = F.when(i % 11 == 0, 0).when(i % 13 == 0, None).otherwise((1990 + i % 37).cast("int"))
    return V.table(spark, folder, "documents").select("doc_id", R.post_sample(year, F.lit("2024-01-01").cast("date")).alias("w")).select("doc_id", "w.start", F.col("w.end").alias("stop"))


#: searches that the index answers, as (words, status, kind)
SEARCHES = [("the src", "attempted", "paper"), ("a", "", ""), ("ing", "catalogued", ""), ("the", "", "spec"), ("on re", "", ""), ("zzzzqqq", "", ""), ("", "verified", "")]


def _scan(k: int, words: str, status: str, kind: str) -> str:
    parts = [f"contains(hay, '{t}')" for t in words.split()] + ([f"status = '{status.upper()}'"] if status else []) + ([f"kind = '{kind}'"] if kind else [])
    return f"(SELECT {k} AS search, id, title, status FROM c WHERE {' AND '.join(parts)} ORDER BY id LIMIT 50)"


@query(sql("works ledger", "WITH c AS (SELECT w.id, title, lower(concat_ws(' ', title, abstract, venue)) AS hay, CASE WHEN l.verdict IS NULL THEN 'CATALOGUED' WHEN l.verdict = 'keep' AND confidence = 1 THEN 'VERIFIED' ELSE 'ATTEMPTED' END AS status, CASE WHEN w.id % 2 = 0 THEN 'paper' ELSE 'spec' END AS kind FROM works w LEFT JOIN ledger l USING (id)) " + " UNION ALL ".join(_scan(k, *s) for k, s in enumerate(SEARCHES))))
def search_index(spark, folder):
    """Searches of several kinds by one inverted index over the whole texts."""
    # words come from the works, so that only what results show meets the ledger
    texts = V.works(spark, folder).select("id", "title", F.col("abstract").alias("method"), F.col("venue").alias("finding"))
    index = I.build(catalogue(spark, folder), f"{shared.scratch_dir(spark)}/index-{uuid.uuid4().hex}", source=texts)
    out = None
    for k, (words, status, kind) in enumerate(SEARCHES):
        part = I.search(spark, index, words, status, kind, 50).select(F.lit(k).alias("search"), "id", "title", "status")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT split_part(split_part(url, '://', 1), ':', 1) AS query, strftime(DATE '2024-01-01' + (page_id % 90)::INTEGER, '%Y-%m-%d') AS day, page_id AS key, url FROM pages WHERE url LIKE '%://%'")
def paged_feed(spark, folder):
    """All pages through a streaming source of cursor-paged listings, in two runs of one stream."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 90).cast("int")), "yyyy-MM-dd")
    pages = V.table(spark, folder, "pages").filter("url like '%://%'").select(F.split("url", "://")[0].alias("query"), day.alias("day"), F.col("page_id").alias("key"), F.to_json(F.struct(day.alias("day"), F.col("page_id").alias("key"), "url")).alias("record"))
    kept = shared.staged(pages.withColumn("query", F.split("query", ":")[0]), "listing")
    queries = "\n".join(r["query"] for r in kept.select("query").distinct().collect() if r["query"])  # protocols
    base = f"{shared.scratch_dir(spark)}/feed-{uuid.uuid4().hex}"
    for until in ("2024-02-10", "2024-04-10"):
        spark.dataSource.register(paged.feed(paged.listing(kept.staged_in), lambda until=until: until, name="pages_feed"))
        stream = spark.readStream.format("pages_feed").option("queries", queries).option("since", "2024-01-01").load()
        stream.writeStream.format("parquet").option("path", f"{base}/data").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("query string, record string").parquet(f"{base}/data")
    return rows.select("query", F.from_json("record", "day string, key long, url string").alias("r")).select("query", "r.day", "r.key", "r.url")
