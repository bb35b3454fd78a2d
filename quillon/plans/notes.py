"""Queries over clean text, keys, tags, notes, checklists, queues and declared criteria."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import notes as N
from quillon.plans.panels import rounded
from quillon.plans.registry import query
from quillon.sources import views as V
from quillon.sources.views import sql


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(html, ''), chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM pages")
def normalised_text(spark, folder):
    return V.table(spark, folder, "pages").select("page_id", F.md5(N.normalised(F.coalesce("html", F.lit("")))).alias("digest"))


@query("SELECT p_partkey AS id, p_size % 5 <> 0 AND p_size % 7 <> 0 AND p_size % 3 <> 0 AS complete FROM part")
def spec_complete(spark, folder):
    z = F.col("p_size")
    given = lambda k, value: F.when(z % k != 0, value)
    spec = V.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), given(5, F.col("p_name")).alias("formula"), F.when(z % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("close"))).alias("data_required"), F.col("p_brand").alias("universe"), given(3, z).alias("horizon_days"), F.lit(1).alias("expected_sign"))
    return spec.select("id", N.is_complete(spec).alias("complete"))


@query("""SELECT s_suppkey AS paper, CASE WHEN s_suppkey % 4 = 0 THEN 'NOT_VERIFIED' WHEN s_suppkey % 4 = 1 THEN 'FIXTURE_UNAVAILABLE' WHEN s_acctbal >= 3000 THEN 'VERIFIED' ELSE 'NOT_VERIFIED' END AS status,
CASE WHEN s_suppkey % 4 = 0 THEN 'no criterion is declared' WHEN s_suppkey % 4 = 1 THEN 'the data cannot be fetched' WHEN s_acctbal >= 3000 THEN 'sharpe reaches 3000.0' ELSE 'sharpe is below 3000.0' END AS reason FROM supplier""")
def criteria_evaluated(spark, folder):
    s = V.table(spark, folder, "supplier")
    k = F.col("s_suppkey")
    criteria = s.filter(k % 4 != 0).select(k.alias("paper"), F.lit("sharpe").alias("statistic"), F.lit(3000.0).alias("threshold"), (k % 4 != 1).alias("fetchable"))
    return N.evaluate(s.select(k.alias("paper"), F.col("s_acctbal").alias("value")), criteria)


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN [coalesce(lang, 'none')] WHEN doc_id % 4 = 1 THEN ['a', 'b'] WHEN doc_id % 4 = 2 THEN ['a', 'b', 'c', 'd', 'e'] ELSE ['x'] END AS tags FROM documents")
def paper_tags(spark, folder):
    k = F.col("doc_id") % 4
    first = F.when(k == 1, "a| b|a").when(k == 2, "a|b|c").when(k == 3, " | ")
    second = F.when(k == 1, "b").when(k == 2, "d|c|e|f").when(k == 3, "x")
    return V.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), N.tags(first, second, F.coalesce("lang", F.lit("none"))).alias("tags"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'p' || page_id WHEN page_id % 3 = 1 THEN 'q' || page_id ELSE '24.' || page_id END AS key FROM pages")
def paper_keys(spark, folder):
    i = F.col("page_id")
    url = F.concat(F.lit("https://host/abs/24."), i, F.lit("v2?x=1#y"))
    return V.table(spark, folder, "pages").select("page_id", N.paper_key(F.when(i % 3 == 0, F.concat(F.lit("p"), i)), F.when(i % 3 == 1, F.concat(F.lit(" q"), i)).otherwise(" "), url=url).alias("key"))


@query("SELECT event_id, try_cast(props->>'$.k' AS VARCHAR) AS k, CASE WHEN props IS NULL OR event_id % 5 = 0 THEN 0 ELSE len(json_keys(props)) END AS n FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS props FROM events)")
def parsed_notes(spark, folder):
    e = V.table(spark, folder, "events").select("event_id", N.notes(F.when(F.col("event_id") % 5 == 0, "no json").otherwise(F.col("props"))).alias("m"))
    return e.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.size("m").cast("long").alias("n"))


@query(sql("brand_returns", "WITH m AS (SELECT date, avg(ret) AS mkt FROM brand_returns GROUP BY date) SELECT asset, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(corr(ret, mkt), 0.0::DOUBLE))), 6) AS likeness FROM brand_returns JOIN m USING (date) WHERE ret IS NOT NULL GROUP BY asset"))
def profile_likeness(spark, folder):
    from quillon.operators import panel as P

    r = P.returns(P.dense(V.brand_month(spark, folder))).filter("ret is not null")
    both = r.join(r.groupBy("date").agg(F.avg("ret").alias("mkt")), "date")
    return rounded(both.groupBy("asset").agg(N.profile_likeness("ret", "mkt").alias("likeness")))


@query("SELECT o_custkey AS paper, l_orderkey * 10 + l_linenumber AS id, l_returnflag AS cell FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def checklist_cells(spark, folder):
    li, o = V.table(spark, folder, "lineitem"), V.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    cell = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("cell"))
    exhibits = li.groupBy("l_orderkey").agg(F.collect_list(cell).alias("cells")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    lists = exhibits.groupBy(F.col("o_custkey").alias("paper")).agg(F.collect_list(F.struct(F.col("l_orderkey").cast("string").alias("name"), "cells")).alias("exhibits"))
    return N.checklist_cells(lists)


@query("SELECT 'x/' || n_name || '.PNG' AS path FROM nation WHERE n_regionkey = 1")
def kept_files(spark, folder):
    n = V.table(spark, folder, "nation")
    return N.kept_files(n.select(F.concat(F.lit("x/"), "n_name", F.lit(".PNG")).alias("path")), n.filter("n_regionkey = 1").select(F.upper("n_name").alias("key")))


@query("WITH q AS (SELECT o_orderkey AS id, o_orderdate AS inserted, CASE o_orderstatus WHEN 'O' THEN 'pending' ELSE 'done' END AS status, o_totalprice FROM orders), d AS (SELECT id FROM q WHERE status = 'pending' ORDER BY inserted, id LIMIT 50) SELECT id, inserted, CASE WHEN id IN (SELECT id FROM d) THEN CASE WHEN o_totalprice > 150000 THEN 'keep' ELSE 'drop' END ELSE status END AS status FROM q")
def pending_queue(spark, folder):
    """Fifty papers of the queue are judged, the oldest first."""
    o = V.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("inserted"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"), "o_totalprice")
    return N.drained(o, 50, F.when(F.col("o_totalprice") > 150000, "keep").otherwise("drop")).select("id", "inserted", "status")


@query("SELECT s_suppkey AS paper, 'curve of balances' AS name, 'nation ' || s_nationkey AS against, round(CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END, 4) AS observed, 'correlation vs nation ' || s_nationkey || ': ' || CASE WHEN s_suppkey % 5 <> 0 THEN printf('%.4f', s_acctbal) ELSE 'not computed' END || '. weaker than a fixture' AS description, false AS verifies FROM supplier WHERE s_suppkey % 3 <> 0")
def sanity_checks(spark, folder):
    """Weaker comparisons of some papers, which inform and never verify."""
    s = V.table(spark, folder, "supplier")
    k = F.col("s_suppkey")
    checks = s.filter(k % 3 != 0).select(k.alias("paper"), F.lit("curve of balances").alias("name"), F.concat(F.lit("nation "), "s_nationkey").alias("against"), F.lit("correlation").alias("statistic"), F.lit("weaker than a fixture").alias("note"))
    return N.sanity(s.select(k.alias("paper"), F.when(k % 5 != 0, F.round("s_acctbal", 4)).alias("value")), checks)


@query("""WITH c AS (SELECT c_nationkey::VARCHAR AS name, 'group.' || c_mktsegment || '.' || c_custkey AS path, c_acctbal AS value FROM customer), p AS (SELECT c_nationkey::VARCHAR AS name, CASE o_orderkey % 3 WHEN 0 THEN 'group.' || c_mktsegment || '.' || c_custkey WHEN 1 THEN 'orders.k' || c_custkey ELSE 'group.' || c_mktsegment || '.' || c_custkey || '.deep' END AS path, o_totalprice AS value, o_orderkey AS moment, o_orderkey % 3 AS kind FROM orders JOIN customer ON c_custkey = o_custkey),
l AS (SELECT name, path, arg_max(value, moment) AS new, max(kind) AS kind FROM p GROUP BY name, path)
SELECT name, path, coalesce(new, value) AS value, CASE WHEN kind = 2 THEN 'refused' WHEN new IS NULL THEN 'kept' WHEN value IS NULL THEN 'added' ELSE 'set' END AS state FROM c FULL JOIN l USING (name, path)""")
def configuration_applied(spark, folder):
    """Customers' balances as a configuration by nation, with orders as proposals for its paths, some of which can't be."""
    c = V.table(spark, folder, "customer")
    own = F.concat_ws(".", F.lit("group"), "c_mktsegment", F.col("c_custkey").cast("string"))
    name = F.col("c_nationkey").cast("string").alias("name")
    kind = F.col("o_orderkey") % 3
    path = F.when(kind == 0, own).when(kind == 1, F.concat(F.lit("orders.k"), "c_custkey")).otherwise(F.concat(own, F.lit(".deep")))
    proposals = V.table(spark, folder, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(name, path.alias("path"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("at"))
    return N.applied(c.select(name, own.alias("path"), F.col("c_acctbal").alias("value")), proposals)
