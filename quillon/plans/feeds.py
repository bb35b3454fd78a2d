"""Queries over record mappers, price and factor feeds, commit logs, catalogues in files and citation seeds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.functions import rules
from quillon.operators import exhibits as X
from quillon.operators import graphs as G
from quillon.operators import ranking as K
from quillon.operators import reports as R
from quillon.operators import screens as S
from quillon.plans.books import market_returns
from quillon.plans.panels import rounded
from quillon.plans.registry import query
from quillon.plans.screens import TEXT, p, papers, rx
from quillon.plans.shared import scratch_dir, staged
from quillon.sources import external as E
from quillon.sources import records
from quillon.sources import views as V
from quillon.sources.views import sql
from quillon.streaming import loop


def mod(column: str, k: int):
    return F.col(column) % k


# prices by symbol, some of which lack one field or both
PRICES = """r AS (SELECT 'S' || l_suppkey AS symbol, l_shipdate::DATE AS date, CASE WHEN l_suppkey % 5 <> 0 AND l_linenumber > 1 THEN l_extendedprice END AS adj, CASE WHEN l_suppkey % 3 <> 0 AND l_linenumber < 6 THEN l_quantity END AS nom FROM lineitem),
g AS (SELECT symbol, date, max(adj) AS adj, max(nom) AS nom FROM r GROUP BY 1, 2 HAVING max(adj) IS NOT NULL OR max(nom) IS NOT NULL), k AS (SELECT symbol, count(nom) AS n FROM g GROUP BY 1 HAVING count(adj) > 0)"""


def price_rows(spark, folder):
    li = V.table(spark, folder, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity")
    adjusted = F.struct(F.lit("adjclose").alias("field"), F.when((mod("l_suppkey", 5) != 0) & (F.col("l_linenumber") > 1), F.col("l_extendedprice")).alias("value"))
    nominal = F.struct(F.lit("close").alias("field"), F.when((mod("l_suppkey", 3) != 0) & (F.col("l_linenumber") < 6), F.col("l_quantity")).alias("value"))
    return li.select("symbol", "date", F.explode(F.array(adjusted, nominal)).alias("x")).select("symbol", "date", "x.field", "x.value")


@query(f"WITH {PRICES} SELECT symbol, date, adj AS adjusted, CASE WHEN n > 0 THEN nom ELSE adj END AS nominal FROM g JOIN k USING (symbol) WHERE date >= DATE '1995-06-01'")
def price_panel(spark, folder):
    return E.price_panel(price_rows(spark, folder), "1995-06-01")


@query(f"WITH {PRICES} SELECT 'S' || s_suppkey AS symbol FROM supplier WHERE 'S' || s_suppkey NOT IN (SELECT symbol FROM g WHERE adj IS NOT NULL)")
def dead_symbols(spark, folder):
    wanted = V.table(spark, folder, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"))
    return E.dead_symbols(price_rows(spark, folder), wanted)


NAMES = [f"N{k}" for k in range(7)]


@query("SELECT o_orderdate::DATE AS date, " + ", ".join(f"max(o_totalprice) FILTER (c_nationkey = {k}) AS N{k}" for k in range(7)) + " FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 7 GROUP BY 1")
def named_panel(spark, folder):
    o, c = V.table(spark, folder, "orders"), V.table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("N"), "c_nationkey").alias("symbol"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("close"))
    return E.named_panel(rows, NAMES)


@query("SELECT o_orderdate::DATE AS date, o_custkey / 10.0::DOUBLE AS value FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def factor_series(spark, folder):
    """One field of a factor library whose dates and values are text, some of it unreadable."""
    o = V.table(spark, folder, "orders")
    observed = F.when(mod("o_orderkey", 5) != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("n.a.")
    value = F.when(mod("o_orderkey", 7) != 0, F.concat(F.floor(F.col("o_custkey") / 10), F.lit("."), mod("o_custkey", 10))).otherwise("-")
    return E.factor_series(o.select(F.col("o_orderstatus").alias("field"), observed.alias("observed_at"), value.alias("value")), "F")


@query("SELECT o_custkey AS repo, 'c' || o_orderkey AS sha, strftime(o_orderdate, '%Y-%m-%d') AS ts, o_orderpriority AS subject, CASE WHEN o_orderkey % 3 = 0 THEN 'a' || chr(9) || 'b' ELSE '' END AS body FROM orders WHERE o_orderkey % 4 <> 0")
def commit_log(spark, folder):
    i = mod("o_orderkey", 4)
    tail = F.when(i != 0, F.concat(F.lit("\t"), "o_orderpriority", F.lit("\t"), F.when(mod("o_orderkey", 3) == 0, "a\tb\n").otherwise(""))).otherwise("")
    record = F.concat(F.lit("c"), "o_orderkey", F.lit("\t"), F.date_format("o_orderdate", "yyyy-MM-dd"), tail, F.lit("\x1e\n"))
    logs = V.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("repo")).agg(F.array_join(F.collect_list(record), "").alias("log"))
    return logs.select("repo", F.explode(E.commits(F.col("log"))).alias("c")).select("repo", "c.*")


@query("SELECT 'github_issue' AS source, 'https://host/' || page_id AS source_url, coalesce(url, '') || chr(10) || chr(10) || CASE WHEN page_id % 3 = 0 THEN '' ELSE md5(coalesce(html, '')) END AS raw_text FROM pages WHERE page_id % 5 <> 0")
def issue_mentions(spark, folder):
    item = F.struct(F.col("page_id").alias("number"), F.col("url").alias("title"), F.when(mod("page_id", 3) != 0, F.md5(F.coalesce("html", F.lit("")))).alias("body"), F.concat(F.lit("https://host/"), "page_id").alias("url"))
    return E.mentions(V.table(spark, folder, "pages").select(F.when(mod("page_id", 5) != 0, F.to_json(F.array(item))).otherwise("not json").alias("json")))


@query("WITH d AS (SELECT l_suppkey AS path, l_shipdate::DATE AS t, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), w AS (SELECT path, t, sum(q) OVER (PARTITION BY path ORDER BY t ROWS UNBOUNDED PRECEDING) AS wealth FROM d) SELECT path, list(wealth ORDER BY t) AS wealth FROM w GROUP BY 1")
def wealth_paths(spark, folder):
    """Running holdings of every supplier, an array each, through Parquet."""
    from pyspark.sql import Window

    day = V.table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("path"), F.to_date("l_shipdate").alias("t")).agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("path").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return staged(E.wealth_paths(day.select("path", "t", F.sum("q").over(w).alias("wealth"))), "wealth-paths")


@query("SELECT DISTINCT n_name AS symbol FROM nation WHERE n_regionkey = 2")
def universe_file(spark, folder):
    """The list of one region out of a JSON file of all."""
    n = V.table(spark, folder, "nation").groupBy(F.concat(F.lit("R"), "n_regionkey").alias("k")).agg(F.collect_list("n_name").alias("v"))
    whole = n.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("universes"))).alias("value"))  # 25 names
    path = f"{scratch_dir(spark)}/universe-{uuid.uuid4().hex}"
    whole.coalesce(1).write.text(path)
    return records.load_universe(spark, path, [], "R2")


@query("SELECT l_orderkey AS src, 'W' || l_partkey AS dst FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def work_edges(spark, folder):
    refs = F.array_join(F.collect_list(F.concat(F.lit("W"), "l_partkey")), "  ")
    return G.edges_from_refs(V.table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(refs.alias("refs")))


@query("""WITH w AS (SELECT p_partkey AS work, CASE WHEN p_partkey % 3 = 0 THEN '10.1/' || p_partkey END AS doi, p_name AS key, lower(p_brand) AS surname, p_size AS citations FROM part),
s AS (SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN '10.1/' || s_suppkey END AS doi, NULL AS key, NULL AS surname FROM supplier UNION ALL SELECT DISTINCT p_name || '|' || p_brand, NULL, p_name, lower(p_brand) FROM part),
b AS (SELECT s.name, w.work, w.citations FROM s JOIN w ON s.doi = w.doi), t AS (SELECT s.name, w.work, w.citations FROM s JOIN w ON s.key = w.key AND s.surname = w.surname WHERE s.name NOT IN (SELECT name FROM b)),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY citations DESC, work DESC) AS place FROM (SELECT * FROM b UNION ALL SELECT * FROM t)) SELECT name, work FROM r WHERE place = 1""")
def seeds_resolved(spark, folder):
    part = V.table(spark, folder, "part")
    author = G.surname(F.concat(F.lit("Jo "), "p_brand", F.lit(", A Other")))
    works = part.select(F.col("p_partkey").alias("id"), F.when(mod("p_partkey", 3) == 0, F.concat(F.lit("10.1/"), "p_partkey")).alias("doi"), F.col("p_name").alias("key"), author.alias("surname"), F.col("p_size").alias("citations"))
    none = F.lit(None).cast("string")
    by_doi = V.table(spark, folder, "supplier").select(F.col("s_name").alias("name"), F.when(mod("s_suppkey", 2) == 0, F.concat(F.lit("10.1/"), "s_suppkey")).alias("doi"), none.alias("key"), none.alias("surname"))
    by_title = part.select(F.concat("p_name", F.lit("|"), "p_brand").alias("name"), none.alias("doi"), F.col("p_name").alias("key"), F.lower("p_brand").alias("surname")).distinct()
    return G.resolve_seeds(by_doi.unionByName(by_title), works)


CLASSES = ("1_clear", "2_likely", "3_maybe", "4_not", "9_drop")


def predictor_rows(spark, folder):
    """Parts as rows of a predictor catalogue, all text."""
    pick = lambda c, names: F.element_at(F.array(*map(F.lit, names)), (c % len(names) + 1).cast("int"))
    k, z = F.col("p_partkey"), F.col("p_size").cast("string")
    last = F.when(k % 4 != 0, (1970 + k % 20).cast("string"))
    return V.table(spark, folder, "part").select(
        F.concat(F.lit("P"), k).alias("Acronym"), pick(k, ("Accounting", "Price", "Trading", "Options")).alias("Cat.Data"), pick(k, CLASSES).alias("Predictability in OP"), F.when(k % 7 == 0, "Placebo").otherwise("Predictor").alias("Cat.Signal"),
        F.when(k % 5 != 0, z).alias("T-Stat"), pick(k, ("1", "-1", "")).alias("Sign"), F.lit("1965").alias("SampleStartYear"), last.alias("SampleEndYear"), (k % 13).cast("string").alias("Portfolio Period"), z.alias("Mean Return"),
    )


PREDICTORS = """c AS (SELECT 'P' || p_partkey AS acronym, p_partkey AS k, p_size AS z, ['Accounting', 'Price', 'Trading', 'Options'][1 + p_partkey % 4] AS data, ['1_clear', '2_likely', '3_maybe', '4_not', '9_drop'][1 + p_partkey % 5] AS class FROM part)"""


@query(f"WITH {PREDICTORS} SELECT acronym AS \"Acronym\", data FROM c WHERE class = '1_clear' AND data <> 'Options'")
def predictors_kept(spark, folder):
    return R.keep_predictors(predictor_rows(spark, folder)).select("Acronym", F.col("`Cat.Data`").alias("data"))


@query(f"""WITH {PREDICTORS}, n AS (SELECT *, CASE WHEN k % 5 <> 0 THEN z / sqrt(CASE WHEN k % 4 = 0 THEN 240 ELSE (1970 + k % 20 - 1965 + 1) * 12 END / 12.0::DOUBLE) * 0.7::DOUBLE END AS centre FROM c)
SELECT acronym, ['+', '-', 'both'][1 + k % 3] AS sign, round(CASE WHEN centre IS NULL THEN 0 ELSE greatest(0, centre - 0.3::DOUBLE) END, 6) AS lo, round(CASE WHEN centre IS NULL THEN 0.6::DOUBLE ELSE centre + 0.3::DOUBLE END, 6) AS hi,
CASE WHEN k % 7 = 0 THEN 'kill' ELSE ['ship', 'iterate', 'iterate', 'kill', 'kill'][1 + k % 5] END AS verdict, greatest(1, k % 13 * 21)::INTEGER AS horizon_days, round(z / 100.0::DOUBLE * 12, 6) AS annual_return, CASE WHEN k % 4 <> 0 THEN make_date(1971 + k % 20, 1, 1) END AS window_start FROM n""")
def fixture_rows(spark, folder):
    """Expectations derived of a predictor catalogue: sign, Sharpe range, verdict, horizon and first day after the sample."""
    out = records.openap_fixture(predictor_rows(spark, folder))
    return rounded(out.select(F.col("Acronym").alias("acronym"), "sign", "sharpe_range.lo", "sharpe_range.hi", "verdict", "horizon_days", "annual_return", "window_start"))


@query(f"WITH {PREDICTORS} SELECT acronym AS \"Acronym\", z::VARCHAR AS \"Mean Return\" FROM c")
def catalogue_file(spark, folder):
    """A catalogue of text through CSV."""
    path = f"{scratch_dir(spark)}/catalogue-{uuid.uuid4().hex}"
    predictor_rows(spark, folder).write.option("escape", '"').csv(path, header=True)
    return records.read_catalogue(spark, path).select("Acronym", "Mean Return")


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END || o_orderkey AS ts, o_totalprice AS verdict_accuracy FROM orders")
def log_file(spark, folder):
    """A log of two row shapes, appended in two steps and read back as one."""
    path = f"{scratch_dir(spark)}/log-{uuid.uuid4().hex}"
    o = V.table(spark, folder, "orders")
    records.append_log(o.filter("o_orderkey % 2 = 0").select(F.concat(F.lit("a"), "o_orderkey").alias("timestamp"), F.col("o_totalprice").alias("verdict_accuracy")), path)
    records.append_log(o.filter("o_orderkey % 2 <> 0").select(F.concat(F.lit("b"), "o_orderkey").alias("ts"), F.col("o_totalprice").alias("verdict_accuracy"), F.lit(1).alias("triaged")), path)
    return records.read_log(spark, path).select("ts", "verdict_accuracy")


_TARGETS = [("early", "1992-01-01", "1996-12-31", {"cagr": 0.08, "sharpe": 0.5}), ("late", "1997-01-01", "2002-12-31", {"cagr": 0.04, "sharpe": 0.3}), ("hold", "1990-01-01", "2010-12-31", {"cagr": 0.0, "max_drawdown": -0.5})]
_TOLERANCES = {"cagr": 0.5, "sharpe": 0.4, "max_drawdown": 0.25}


@query(
    sql(
        "market_returns",
        "WITH t(span, a, b, statistic, published, tolerance) AS (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}', '{k}', {v}::DOUBLE, {_TOLERANCES[k]}::DOUBLE)" for n, a, b, stats in _TARGETS for k, v in stats.items()) + """),
i AS (SELECT span, date, ret FROM market_returns, (SELECT DISTINCT span, a, b FROM t) WHERE date BETWEEN a AND b AND ret IS NOT NULL), w AS (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY span ORDER BY date ROWS UNBOUNDED PRECEDING) AS x FROM i),
d AS (SELECT *, exp(x - max(x) OVER (PARTITION BY span ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS fall FROM w),
m AS (SELECT span, exp(sum(ln(1 + ret)) * 252 / count(*)) - 1 AS cagr, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, min(fall) AS max_drawdown FROM d GROUP BY span),
u AS (SELECT span, 'cagr' AS statistic, cagr AS v FROM m UNION ALL SELECT span, 'sharpe', sharpe FROM m UNION ALL SELECT span, 'max_drawdown', max_drawdown FROM m)
SELECT span, statistic, published, tolerance, round(v, 5) + 0.0::DOUBLE AS measured, coalesce(abs(v - published) <= tolerance, false) AS lands FROM t LEFT JOIN u USING (span, statistic)""",
    )
)
def frozen_targets(spark, folder):
    """Published figures of periods, and of holding the market over all of them, against what the market did."""
    rows = R.targets([(n, stats) for n, _, _, stats in _TARGETS], _TOLERANCES)
    frozen = spark.createDataFrame(rows, "span string, statistic string, published double, tolerance double")
    spans = spark.createDataFrame([(n, a, b) for n, a, b, _ in _TARGETS], "span string, first string, last string")
    return rounded(R.target_checks(frozen, spans, market_returns(spark, folder)), "measured", digits=5)


def flat(spark, folder):
    """Documents as nested works, flattened; through JSON, as they come."""
    i = F.col("doc_id")
    year = lambda y, k: F.struct(F.lit(y).alias("year"), (i * k).alias("cited_by_count"))
    person = lambda name, *lands: F.struct(F.struct(F.lit(name).alias("display_name")).alias("author"), F.array(*map(F.lit, lands)).alias("countries"))
    people = F.when(i % 3 == 0, F.array(person("A B", "US"), person("C", "FR", "US"), person("D"), person("E"))).otherwise(F.array(person("Z", "DE")))
    work = F.struct(
        F.concat(F.lit("https://host/W"), i).alias("id"), F.when(i % 4 != 0, F.concat(F.lit("https://doi.org/10.1/"), i)).alias("doi"), F.col("source").alias("title"), (1990 + i % 30).alias("publication_year"), F.col("n_chars").alias("cited_by_count"),
        F.when(i % 2 == 0, F.array(year(2022, 4), year(2019, 1), year(2021, 3), year(2020, 2))).otherwise(F.array(year(2022, 4))).alias("counts_by_year"), people.alias("authorships"), F.array(F.concat(F.lit("https://host/W"), i + 1), F.concat(F.lit("https://host/W"), i + 2)).alias("referenced_works"),
        F.struct(F.when(i % 5 == 0, F.concat(F.lit("https://oa/"), i)).alias("oa_url")).alias("open_access"),
    )
    raw = V.table(spark, folder, "documents").select(F.from_json(F.to_json(work), records.WORK).alias("w")).select("w.*")
    return records.flat_works(raw)


FLAT = """f AS (SELECT 'W' || doc_id AS id, doc_id AS i, CASE WHEN doc_id % 4 <> 0 THEN '10.1/' || doc_id ELSE '' END AS doi, coalesce(source, '') AS title, (1990 + doc_id % 30)::INTEGER AS year, n_chars::INTEGER AS citations FROM documents)"""


@query(f"""WITH {FLAT} SELECT id, doi, title, year, citations, (CASE WHEN i % 2 = 0 THEN 7 * i ELSE 4 * i END)::INTEGER AS cites_recent2, (CASE WHEN i % 2 = 0 THEN 3 * i ELSE 0 END)::INTEGER AS cites_prior2, (CASE WHEN i % 3 = 0 THEN 4 ELSE 1 END)::INTEGER AS n_authors,
CASE WHEN i % 3 = 0 THEN 'A B, C, D, E' ELSE 'Z' END AS authors, CASE WHEN i % 3 = 0 THEN 'FR | US' ELSE 'DE' END AS countries, 'W' || (i + 1) || ' W' || (i + 2) AS refs FROM f""")
def works_flat(spark, folder):
    return flat(spark, folder).select("id", "doi", "title", "year", "citations", "cites_recent2", "cites_prior2", "n_authors", "authors", "countries", "refs")


@query(f"""WITH {FLAT} SELECT id, title, CASE WHEN i % 3 = 0 THEN 'A B, C, D et al.' ELSE 'Z' END AS authors, CASE WHEN i % 5 = 0 THEN 'https://oa/' || i WHEN doi <> '' THEN 'https://doi.org/' || doi ELSE 'https://openalex.org/' || id END AS url, year || '-01-01' AS published, citations FROM f""")
def paper_records(spark, folder):
    return records.paper_record(flat(spark, folder)).select("id", "title", "authors", "url", "published", "citations")


@query("SELECT CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, page_id::VARCHAR AS external_id, url AS landing_url, NULL::VARCHAR AS categories, NULL::TIMESTAMP AS published_at FROM pages")
def standard_records(spark, folder):
    """Two feeds in the one schema of papers."""
    pages = V.table(spark, folder, "pages")
    even = records.standard_record(pages.filter("page_id % 2 = 0"), "even", external_id=F.col("page_id"), landing_url=F.col("url"))
    odd = records.standard_record(pages.filter("page_id % 2 <> 0"), "odd", external_id=F.col("page_id"), landing_url=F.col("url"), raw=F.col("html"))
    return even.unionByName(odd).select("source", "external_id", "landing_url", "categories", "published_at")


@query("SELECT 'C' || o_custkey AS ticker, o_orderdate::DATE AS fiscal_date, CASE WHEN max(o_orderkey) % 3 = 0 THEN o_orderdate::DATE + 45 ELSE o_orderdate::DATE + 20 END AS filing_date, CASE WHEN max(o_orderkey) % 5 <> 0 THEN max(o_orderkey)::DOUBLE END AS \"grossProfit\" FROM orders GROUP BY o_custkey, o_orderdate")
def fundamentals_rows(spark, folder):
    """Nested statements with missing filing dates and unreadable values, exploded."""
    day = V.table(spark, folder, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("k"))
    filed = F.when(F.col("k") % 3 != 0, F.date_format(F.date_add("o_orderdate", 20), "yyyy-MM-dd"))
    profit = F.when(F.col("k") % 5 != 0, F.col("k").cast("string")).otherwise("n/a")
    entry = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("key"), F.map_from_arrays(F.array(F.lit("filing_date"), F.lit("grossProfit")), F.array(filed, profit)).alias("value"))
    quarterly = day.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(entry)).alias("quarterly"))
    statement = F.create_map(F.lit("Income_Statement"), F.struct("quarterly"))
    whole = F.struct(F.struct(F.concat(F.lit("c"), "o_custkey", F.lit(".US")).alias("Code")).alias("General"), statement.alias("Financials"))
    documents = quarterly.select(F.from_json(F.to_json(whole), records.FUNDAMENTALS).alias("d")).select("d.*")
    return records.fundamentals_panel(documents, "Income_Statement", "quarterly", ["grossProfit"])


@query("WITH a AS (SELECT o_custkey AS id, o_orderkey AS t, o_totalprice AS v FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC) AS place FROM a) SELECT id, t, v FROM r WHERE place = 1")
def upserted(spark, folder):
    rows = V.table(spark, folder, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("t"), F.col("o_totalprice").alias("v"))
    return records.upsert(rows.filter("t % 2 = 0"), rows.filter("t % 2 <> 0"), ["id"], "t")


@query("WITH r AS (SELECT l_orderkey AS model, l_suppkey % 8 AS k, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS rank, l_quantity AS value FROM lineitem WHERE l_quantity > 3), o AS (SELECT *, row_number() OVER (PARTITION BY model, k ORDER BY rank, value) AS place FROM r) SELECT model, k, rank, value FROM o WHERE place = 1")
def series_over_k(spark, folder):
    """A model's value at each k from the first of several tables that prints it."""
    rank = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    cells = V.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("model"), (F.col("l_suppkey") % 8).alias("k"), rank.alias("rank"), F.when(F.col("l_quantity") > 3, F.col("l_quantity")).alias("value"))
    return records.by_priority(cells.filter("value is not null"), ["model", "k"], "rank", "value")


@query("SELECT p_partkey AS id, coalesce(c, 0) AS citations FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity)::INTEGER AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey")
def counts_joined(spark, folder):
    counts = V.table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"), F.col("l_quantity").cast("int").alias("citations"))
    return records.with_counts(V.table(spark, folder, "part").select(F.col("p_partkey").alias("id")), counts)


@query(sql("brand_returns", "SELECT last_day(date) AS date, round(ret, 6) AS theirs FROM brand_returns WHERE asset = 'Brand#1'"))
def published_portfolio(spark, folder):
    from quillon.operators import panel as P

    r = P.returns(P.dense(V.brand_month(spark, folder)))
    rows = r.select(F.col("asset").alias("signalname"), "date", F.explode(F.array(F.struct(F.lit("LS").alias("port"), "ret"), F.struct(F.lit("01").alias("port"), (-F.col("ret")).alias("ret")))).alias("x")).select("signalname", "date", "x.*")
    return rounded(records.published_portfolio(rows, "Brand#1"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 101 >= 95 THEN 'nearly all of it lands' WHEN doc_id % 101 >= 60 THEN 'most of it lands' WHEN doc_id % 101 >= 25 THEN 'some of it lands' ELSE 'little of it lands' END AS band FROM documents")
def share_bands(spark, folder):
    return V.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), R.share_band(F.col("doc_id") % 101).alias("band"))


@query(r"SELECT doc_id AS id, CASE WHEN length(text) <= 80 THEN text ELSE rtrim(regexp_extract(text, '(?s)^(.{0,80})[ \t\n\x0B\f\r]', 1)) || chr(8230) END AS shown FROM documents")
def clipped(spark, folder):
    return V.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), records.clip(F.col("text"), 80).alias("shown"))


@query("SELECT l_orderkey AS paper, CASE l_linenumber % 3 WHEN 0 THEN 'Table ' WHEN 1 THEN 'Figure B' ELSE 'X ' END || l_linenumber AS label, min(l_suppkey) AS page FROM lineitem GROUP BY l_orderkey, l_linenumber")
def exhibit_pages(spark, folder):
    """The first page of each exhibit of a checklist, with its label."""
    kind = F.when(F.col("l_linenumber") % 3 == 0, "T").when(F.col("l_linenumber") % 3 == 1, "FB").otherwise("X")
    cells = V.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("paper"), F.concat(kind, "l_linenumber", F.lit("/row/"), "l_partkey").alias("id"), F.col("l_suppkey").alias("page"))
    return X.first_pages(cells).select("paper", X.exhibit_label(F.col("exhibit")).alias("label"), "page")


@query("WITH c AS (SELECT l_orderkey AS paper, 'T' || l_linenumber AS exhibit, l_suppkey AS page, l_partkey AS top, 'caption ' || l_partkey AS caption FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY paper, exhibit ORDER BY page, top, caption) AS place FROM c) SELECT paper, exhibit, page, caption FROM r WHERE place = 1")
def first_captions(spark, folder):
    found = V.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("paper"), F.concat(F.lit("T"), "l_linenumber").alias("exhibit"), F.col("l_suppkey").alias("page"), F.col("l_partkey").alias("top"), F.concat(F.lit("caption "), "l_partkey").alias("caption"))
    return X.first_captions(found)


@query("SELECT l_suppkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")
def cached_panel(spark, folder):
    """A panel through a cache that is written once, read for its columns, and not built again."""
    path = f"{scratch_dir(spark)}/cache-{uuid.uuid4().hex}"
    build = lambda: V.table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))
    R.cached_panel(spark, path, ["l_suppkey"], build)
    return R.cached_panel(spark, path, ["l_suppkey", "quantity"], build)


@query("WITH n AS (SELECT o_orderkey AS id, o_custkey AS ext, o_orderdate AS inserted, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0), k AS (SELECT o_custkey AS ext FROM orders WHERE o_orderkey % 3 = 0), f AS (SELECT ext, min(id) AS id, arg_min(inserted, id) AS inserted, arg_min(price, id) AS price FROM n WHERE ext NOT IN (SELECT ext FROM k) GROUP BY ext), t AS (SELECT * FROM f ORDER BY inserted, id LIMIT 20), d AS (SELECT * FROM t WHERE price > 150000 ORDER BY id DESC LIMIT 5) SELECT (SELECT count(*) FROM f) AS polled, (SELECT count(*) FROM t) AS triaged, (SELECT count(*) FROM t WHERE price > 150000) AS tradable, (SELECT count(*) FROM d) AS replicated, 0::BIGINT AS errors")
def loop_round(spark, folder):
    """One round of the loop over a feed of orders, one paper a customer, of whom some are known."""
    o = V.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("external_id"), F.col("o_orderdate").alias("inserted"), F.col("o_totalprice").alias("price"))
    known = o.filter("id % 3 = 0").withColumn("status", F.lit("done"))
    run = loop.Loop(F.when(F.col("price") > 150000, "tradable").otherwise("rejected"), lambda due: due.select("external_id", F.lit("done").alias("status")))
    state = run.round(loop.State(known, None), o.filter("id % 3 <> 0"))
    return spark.createDataFrame([state.counts()], "polled long, triaged long, tradable long, replicated long, errors long")


@query(p(f"SELECT id // 2 AS base, title, CASE WHEN {rx(TEXT, rules.NEEDS_MORE)} THEN 'blocked' WHEN {rx(TEXT, rules.TESTABLE)} THEN 'queued' ELSE 'triage' END AS state FROM papers WHERE id % 2 = 1 AND id // 2 % 5 <> 0 AND NOT {rx(TEXT, rules.ESSAY)} AND ({rx('title', rules.STRATEGY)} OR (length(abstract) >= 260 AND {rx('abstract', rules.STRATEGY)})) AND NOT {rx(TEXT, rules.UNOBTAINABLE)} AND NOT {rx(TEXT, rules.THEORY_ONLY)}"))
def gated_listing(spark, folder):
    """Every two documents are versions of one paper; every fifth paper was dropped before."""
    rows = papers(spark, folder)
    base = F.floor(F.col("id") / 2)
    listing = rows.select(F.concat(base, F.lit("v"), F.col("id") % 2 + 1).alias("id"), "title", "abstract", F.col("id").alias("published"))
    # a pair whose second document is missing has only its first version
    ledger = rows.select(base.cast("string").alias("base"), F.when(base % 5 == 0, "drop").otherwise("keep").alias("verdict")).distinct()
    return S.gated(listing, ledger).select(F.col("base").cast("long").alias("base"), "title", "state")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'm' || p_partkey || '.py' ELSE 'n' || p_partkey || '.py' END AS module FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 <> 2")
def implementations(spark, folder):
    """Slugs of even parts and archive numbers of others; some have no declared module, some no file."""
    part, k = V.table(spark, folder, "part"), F.col("p_partkey")
    # an archive number has five digits after its point, so what is beyond them goes before it
    before, after = F.expr("2401 + p_partkey div 100000").cast("string"), F.lpad((k % 100000).cast("string"), 5, "0")
    items = part.select(k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit(" Part "), k)).otherwise(F.concat(F.lit("arXiv "), before, F.lit("."), after, F.lit("v2"))).alias("name"))
    module = F.concat(F.when(k % 2 == 0, "m").otherwise("n"), k, F.lit(".py"))
    modules = part.filter(k % 5 != 0).select(F.when(k % 2 == 0, F.concat(F.lit("part-"), k)).otherwise(F.concat(before, after)).alias("key"), module.alias("module"))
    return K.implementations(items, modules, part.filter(k % 3 != 2).select(module.alias("module")))
