"""Queries over the citation graph of orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import graphs as G
from quillon.plans.panels import rounded
from quillon.plans.registry import query
from quillon.sources import views as V
from quillon.sources.views import sql


def seeds(spark, folder):
    return V.table(spark, folder, "part").filter("p_size <= 3").select(F.col("p_partkey").alias("id"), F.lit(1.0).alias("weight"))


def negatives(spark, folder):
    return V.table(spark, folder, "part").filter("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("id"))


IDF = """WITH seeds AS (SELECT p_partkey AS id, 1.0::DOUBLE AS weight FROM part WHERE p_size <= 3), total AS (SELECT count(DISTINCT src)::DOUBLE AS n FROM edges)"""


def one_round(k: int, pool: str, known: str, least: int = 2, score: float = 1.5) -> str:
    return f"""w{k} AS (SELECT dst, ln((SELECT n FROM total) / count(*)) * any_value(weight) AS idf FROM edges JOIN {pool} p ON p.id = dst GROUP BY dst),
s{k} AS (SELECT src AS id, count(*) AS hits, sum(idf) / (SELECT avg(idf) FROM w{k}) AS signal FROM edges JOIN w{k} USING (dst) GROUP BY src),
f{k} AS (SELECT id, hits, signal, {k} AS round FROM s{k} WHERE hits >= {least} AND signal >= {score} AND id NOT IN (SELECT id FROM {pool}) {known})"""


@query(sql("edges", IDF + " SELECT dst, count(*) AS df, round(ln((SELECT n FROM total) / count(*)), 6) AS idf FROM edges JOIN seeds ON id = dst GROUP BY dst"))
def edges_idf(spark, folder):
    return rounded(G.seed_weights(V.edges(spark, folder), seeds(spark, folder)))


@query(sql("edges", IDF + ", " + one_round(0, "seeds", "") + " SELECT id, hits, round(signal, 6) AS signal FROM f0"))
def signal_round(spark, folder):
    s = seeds(spark, folder)
    return rounded(G.score_round(V.edges(spark, folder), s, 2).join(s.select("id"), "id", "left_anti"))


def all_rounds(rounds: int, promote: float = 2.5, least_fresh: int = 5, decay: float = 0.6) -> str:
    """The rounds one after the other; a round that is not reached is empty, and so are those after it."""
    parts = [one_round(0, "seeds", "")]
    for k in range(1, rounds):
        known = " ".join(f"AND id NOT IN (SELECT id FROM f{j})" for j in range(k))
        reached = f"AND (SELECT count(*) >= {least_fresh} AND coalesce(bool_or(signal >= {promote}), false) FROM f{k - 1})"
        before = "seeds" if k == 1 else f"p{k - 1}"
        parts.append(f"p{k} AS (SELECT * FROM {before} UNION ALL SELECT id, {decay**k!r}::DOUBLE FROM f{k - 1} WHERE signal >= {promote})")
        parts.append(one_round(k, f"p{k}", f"{known} {reached}"))
    return ", ".join(parts) + ", found AS (" + " UNION ALL ".join(f"SELECT id, hits, signal, round FROM f{k}" for k in range(rounds)) + ")"


@query(sql("edges", IDF + ", " + all_rounds(G.ROUNDS) + " SELECT id, hits, round(signal, 6) AS signal, round FROM found"))
def signal_expand(spark, folder):
    return rounded(G.expand(V.edges(spark, folder), seeds(spark, folder), promote=2.5, least_hits=2, least_fresh=5))


SHARED = """, shares AS (SELECT (SELECT round(avg((id IN (SELECT id FROM found))::INTEGER), 6) FROM (SELECT p_partkey AS id FROM part WHERE p_size <= 3 AND p_partkey % 5 = 0)) AS recall,
(SELECT round(avg((id IN (SELECT id FROM found))::INTEGER), 6) FROM (SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#1')) AS leak)"""
@query(sql("edges", IDF.replace("p_size <= 3", "p_size <= 3 AND p_partkey % 5 <> 0") + ", " + all_rounds(G.ROUNDS, least_fresh=G.LEAST_FRESH) + SHARED + " SELECT recall, leak, round(recall - leak, 6) AS objective FROM shares"))
def holdout_recovery(spark, folder):
    s = seeds(spark, folder)
    return G.holdout_recovery(V.edges(spark, folder), s, s.filter("id % 5 = 0").select("id"), negatives(spark, folder), promote=2.5, least_hits=2)


# fixed values: the grid of settings
GRID = {"least_hits": [2, 3, 4], "least_score": [1.0, 1.5, 2.5, 4.0], "promote": [2.5, 3.0, 4.5, 99.0], "decay": [0.4, 0.6, 0.8]}


@query()
def signal_sweep(spark, folder):
    return G.sweep(V.edges(spark, folder), seeds(spark, folder), negatives(spark, folder), 4, GRID)
