"""Operator 11: centroid clustering with exact assignments from float32 products.

Components become integers floor(scale * x), so distances, sums and centroids are exact.  A vector's centroid is found by
screening: float32 matrix products give c.c - 2 x.c for all centroids, each with an interval that holds the exact value
whatever the order of the sums (|error of x.c| <= g |x||c| with g = m u / (1 - m u), m = dimensions + 2, u = 2**-24; the two
more are the conversions to float32).  Centroids whose interval reaches below the lowest upper end are the shortlist.  One
of them: it is nearest.  Several: their distances are computed again in integers, ties go to the smallest number.

Vectors are made integers in the JVM and staged once.  Each round is a pass without a shuffle of vectors: tasks add up
their vectors by centroid, and (centroids x dimensions) sums come together by key and go to the driver.  Centroids travel with the job; their
number is a parameter.  A round that changes no centroid ends the fit, as further rounds would not either.

Defined results: vectors that are null, of another length or with a null or non-finite component are left out; components
beyond +-2**26 after scaling are held there, so that a distance in 64 dimensions fits 64 bits; a null id hashes as an empty string;
repeated rows are vectors of their own (the first centroids may be equal; then the smaller number wins and the other stays as it is); with
fewer vectors than centroids there are as many centroids as vectors; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.shared import discard, staged

DIMENSIONS = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SEED = 3
BOUND = 1 << 26
#: vectors times centroids worked on at a time
BLOCK = 1 << 18
#: unit roundoff of float32
UNIT = 2.0**-24


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): the vectors that are kept, as integers."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(v, lambda x: F.least(F.greatest(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(-BOUND)), F.lit(BOUND)).cast("int"))
    return vectors.filter((F.size(v) == dimensions) & finite).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("q"))


def first_centroids(whole: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The k vectors whose hashes of seed and id are smallest, in this order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = whole.orderBy(key, "q").limit(k).select("q").collect()
    return np.array([r["q"] for r in rows], dtype=np.int64)


def shortlist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(vectors, centroids): whether the centroid may be nearest, by float32 products and the bounds of their errors."""
    m = x.shape[1] + 2
    g = m * UNIT / (1 - m * UNIT)
    product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    squares = (c * c).sum(axis=1).astype(np.float64)
    length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(squares)[None]
    middle = squares[None] - 2 * product
    # the last term is more than all roundings of these float64 lines
    radius = 2 * g * length * (1 + 2.0**-30) + 2.0**-48 * (squares[None] + 2 * np.abs(product))
    return middle - radius <= (middle + radius).min(axis=1)[:, None]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of each vector's nearest centroid, exactly."""
    out = np.empty(len(x), dtype=np.int64)
    step = max(1, BLOCK // max(1, len(c)))
    for k in range(0, len(x), step):
        part = x[k : k + step]
        may = shortlist(part, c)
        cluster = may.argmax(axis=1)
        rows, numbers = np.nonzero(may & (may.sum(axis=1) > 1)[:, None])
        if len(rows):
            exact = squared(part[rows], c[numbers])
            order = np.lexsort((numbers, exact, rows))
            rows, numbers = rows[order], numbers[order]
            first = np.append(True, rows[1:] != rows[:-1])
            cluster[rows[first]] = numbers[first]
        out[k : k + step] = cluster
    return out


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(axis=1)


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), dimensions)


def cluster_sums(whole: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """(centroid, dimension) -> sum over its vectors; dimension -1: their number."""
    shipped = whole.sparkSession.sparkContext.broadcast(centroids)
    k, d = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sums, counts = shipped.value, np.zeros((k, d), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            x = matrix(batch.column(0), d)
            cluster = nearest(x, c)
            counts += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            own, starts = np.unique(cluster[order], return_index=True)
            if len(own):
                sums[own] += np.add.reduceat(x[order], starts, axis=0)
        used = np.flatnonzero(counts)
        cells = np.concatenate([counts[used, None], sums[used]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, d + 1)), pa.array(np.tile(np.arange(-1, d), len(used))), pa.array(cells.ravel())], names=["cluster", "dimension", "value"])

    parts = whole.select("q").mapInArrow(add, "cluster long, dimension long, value long")
    rows = parts.groupBy("cluster", "dimension").agg(F.sum("value").alias("value")).collect()  # centroids x (dimensions + 1)
    shipped.destroy()
    return {(r["cluster"], r["dimension"]): r["value"] for r in rows}


def fit(whole: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids after so many rounds over ``integer_vectors``."""
    centroids = first_centroids(whole, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        sums = cluster_sums(whole, centroids)
        after = centroids.copy()
        for (j, dimension), value in sums.items():
            if dimension >= 0:
                after[j, dimension] = value // sums[j, -1]
        if (after == centroids).all():
            break
        centroids = after
    return centroids


def assign(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) for each of ``integer_vectors``."""
    shipped = whole.sparkSession.sparkContext.broadcast(centroids)
    d = centroids.shape[1]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shipped.value
        for batch in batches:
            x = matrix(batch.column(1), d)
            cluster = nearest(x, c)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(squared(x, c[cluster]))], names=["vec_id", "cluster", "distance"])

    return whole.select("vec_id", "q").mapInArrow(near, "vec_id long, cluster int, distance long")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that is kept."""
    spark = vectors.sparkSession
    whole = staged(integer_vectors(vectors, id_col, vector_col, dimensions, scale), "integer-vectors")
    centroids = fit(whole, k, rounds, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    placed = staged(assign(whole, centroids), "placed-vectors")
    discard(whole)
    inertia = {r["cluster"]: r["inertia"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # one row a centroid
    total = sum(inertia.values())
    about = spark.createDataFrame([(j, s, total, digest(centroids[j])) for j, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in eight clusters after ten rounds."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """All rounds one after the other, every distance computed."""
    assigned = """
a{r} AS MATERIALIZED (SELECT n, vec_id, v.q, arg_min(c.c, d.d * {k} + c.c) AS c, min(d.d) AS d
    FROM v, c{r} c, LATERAL (SELECT list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT AS d) d GROUP BY n, vec_id, v.q)"""
    updated = """
c{s} AS MATERIALIZED (SELECT c.c, coalesce(u.q, c.q) AS q FROM c{r} c LEFT JOIN (
    SELECT c, list((x - ((x % m) + m) % m) // m ORDER BY i) AS q
    FROM (SELECT c, i, sum(q[i])::BIGINT AS x, count(*) AS m FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i) GROUP BY c) u ON u.c = c.c)"""
    steps = [assigned.format(r=r, k=k) + ("," + updated.format(r=r, s=r + 1) if r < rounds else "") for r in range(rounds + 1)]
    return f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (
    SELECT c, q FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS c, q FROM v) WHERE c < {k}),{",".join(steps)}
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c
"""


SQL = _sql()
