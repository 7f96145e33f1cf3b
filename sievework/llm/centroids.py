"""Exact Lloyd clustering of integer vectors with geometric drift tightening (operator 13).

Every vector keeps its cluster and a lower bound on its distance to all other centroids. In a round its distance to its own
centroid is computed; if that is under the bound, the vector stays, else it is ambiguous and is compared with
all centroids exactly. When centroids move, the bound must shrink by as much as another centroid can have come nearer.
That is at most the centroid's drift (the bound of Hamerly, 2010), but less for most clusters, as only the sphere that
holds the cluster's vectors matters (geometric tightening; Rysavy and Hamerly, 2016): in the plane through the sphere's centre
and the old and new place of the other centroid, the points that it came nearer to by v or more lie beside one branch of a
hyperbola with the two places as foci, inside the cone of its asymptotes, whose half angle has the cosine v / drift.
So v is at most drift times the cosine of the least angle at which the sphere is seen from the middle of the two places,
off the direction of the move, and 0 from a right angle on. A cluster's vectors lose the largest such v of the other centroids.

Components become floor(scale * x) and all distances, sums and updates are exact integers; the bounds are floating and are
kept a little too small. A round is one pass that assigns and writes the vectors, and one aggregation by cluster; the driver
holds only the centroids, spheres and sums, as many as there are clusters.

Vectors that are null, have another number of components, or a null or non-finite one, are left out; so an empty table
gives an empty result. Ties go to the smaller number of a centroid. Rows that repeat an id are clustered each; rows
with a null id take part, but come last in the choice of the first centroids, equal hashes are ordered by components.
With fewer vectors than clusters every vector begins one. Components beyond 2^26 are an error, since squared distances would not
fit 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, stored, table

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2"
#: Relative error allowed for in a bound; far above that of a few operations in double precision.
SLACK = 1e-9
LIMIT = 1 << 26
STATE = "vec_id long, point array<int>, cluster int, distance long, lower double, scanned boolean"


def points(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, point): the usable vectors as integers."""
    x = lambda c: c.cast("double")
    usable = (F.size("embedding") == dim) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")))
    integer = F.floor(x(F.col("embedding")[0]) * scale)  # for the message below
    whole = F.transform("embedding", lambda c: F.floor(x(c) * scale))
    fits = F.forall("embedding", lambda c: F.abs(x(c) * scale) < LIMIT)
    checked = F.when(fits, whole).otherwise(F.raise_error(F.concat(F.lit("component too large for exact 64-bit distances in a vector beginning with "), integer.cast("string"))))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), checked.cast("array<int>").alias("point"))


def first_centroids(found: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = found.orderBy(key.asc_nulls_last(), "point").limit(clusters).select("point").collect()
    return np.array([r["point"] for r in rows], np.int64)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x and c; by floating products where every partial sum is an integer they hold."""
    big = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * big * big < 1 << 53 else np.int64
    y, z = x.astype(kind), c.astype(kind)
    if kind is np.int64:  # differences: sums of squares of such numbers would not fit
        return np.stack([((y - row) ** 2).sum(1) for row in z], 1)
    return ((y * y).sum(1)[:, None] - 2 * (y @ z.T) + (z * z).sum(1)).astype(np.int64)


def assign(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray | None = None, lower: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(cluster, squared distance, lower bound on the distance to other centroids, compared with all?) of each row of x.

    cluster and lower: what held under these centroids before; without them all rows are compared with all centroids.
    """
    n = len(x)
    distance = np.zeros(n, np.int64)
    if cluster is None:
        cluster, lower, ambiguous = np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
    else:
        cluster, lower = cluster.copy(), lower.copy()
        for a in np.unique(cluster):
            mine = cluster == a
            distance[mine] = squared_distances(x[mine], centroids[a : a + 1])[:, 0]
        ambiguous = np.sqrt(distance) * (1 + SLACK) >= lower
    some = np.flatnonzero(ambiguous)
    if len(some):
        d = squared_distances(x[some], centroids)
        best = d.argmin(1)  # the first of equals
        cluster[some], distance[some] = best, d[np.arange(len(some)), best]
        if len(centroids) > 1:
            d[np.arange(len(some)), best] = np.iinfo(np.int64).max
            lower[some] = np.sqrt(d.min(1)) * (1 - SLACK)
        else:
            lower[some] = np.inf
    return cluster, distance, lower, ambiguous


def tightened(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How much nearer another centroid can have come to a vector of each cluster, at most.

    radius: of the sphere about the cluster's old centroid that holds all its vectors.
    """
    old, new = old.astype(float), new.astype(float)
    move = new - old
    drift = np.sqrt((move * move).sum(1))
    most = np.zeros(len(old))
    for a in range(len(old)):
        to = old[a] - (old + new) / 2  # from the middles of the moves to the sphere's centre
        far = np.sqrt((to * to).sum(1))
        with np.errstate(invalid="ignore", divide="ignore"):
            off = np.arccos(np.clip((to * move).sum(1) / (far * drift), -1, 1))
            angle = np.maximum(off - np.arcsin(np.clip(radius[a] * (1 + SLACK) / far, 0, 1)), 0)
            nearer = drift * np.clip(np.cos(angle) + SLACK, 0, 1)
        nearer = np.where(radius[a] * (1 + SLACK) >= far, drift, nearer)
        nearer[drift == 0] = 0
        nearer[a] = 0
        most[a] = nearer.max(initial=0) * (1 + SLACK)
    return most


def assigned(state: DataFrame, centroids: np.ndarray, loosen: np.ndarray | None) -> DataFrame:
    """The next state; loosen: what the bounds of each cluster's vectors lose first. Without it, state has only points."""
    dim = centroids.shape[1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
            if loosen is None:
                cluster, distance, lower, ambiguous = assign(x, centroids)
            else:
                before = b.column(2).to_numpy(zero_copy_only=False)
                cluster, distance, lower, ambiguous = assign(x, centroids, before, b.column(4).to_numpy(zero_copy_only=False) - loosen[before])
            cols = [b.column(0), b.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(lower), pa.array(ambiguous)]
            yield pa.record_batch(cols, ["vec_id", "point", "cluster", "distance", "lower", "scanned"])

    return state.mapInArrow(run, STATE)


def summed(state: DataFrame, clusters: int, dim: int = DIM) -> tuple[np.ndarray, list[list[int]], np.ndarray, np.ndarray]:
    """By cluster: number of vectors, sums of the components, radius of the sphere, sum of the distances."""
    sums = [F.sum(F.col("point")[i].cast("long")) for i in range(dim)]
    rows = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*sums).alias("sums"), F.max("distance").alias("far"), F.sum("distance").alias("inertia")).collect()  # a row for each cluster
    count, total, radius, inertia = np.zeros(clusters, np.int64), [[0] * dim for _ in range(clusters)], np.zeros(clusters), np.zeros(clusters, np.int64)
    for r in rows:
        count[r["cluster"]], total[r["cluster"]], radius[r["cluster"]], inertia[r["cluster"]] = r["n"], list(r["sums"]), r["far"] ** 0.5, r["inertia"]
    return count, total, radius, inertia


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(one row per vector: vec_id, point, cluster, distance, lower, scanned; the final centroids; inertia by cluster).

    scanned tells whether the last assignment compared the vector with all centroids.
    """
    found = stored(points(vectors, dim, scale), "points")
    centroids = first_centroids(found, clusters, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], STATE), centroids.reshape(0, dim), np.zeros(0, np.int64)
    state = stored(assigned(found, centroids, None), "assigned")
    drop_stored(found)
    for _ in range(rounds):
        count, total, radius, _ = summed(state, len(centroids), dim)
        moved = np.array([[s // int(count[a]) for s in total[a]] if count[a] else centroids[a] for a in range(len(centroids))], np.int64)
        loosen = tightened(centroids, moved, radius)
        after = stored(assigned(state, moved, loosen), "assigned")
        drop_stored(state)
        state, centroids = after, moved
    return state, centroids, summed(state, len(centroids), dim)[3]


def clustered(vectors: DataFrame, **how) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    state, centroids, inertia = cluster(vectors, **how)
    total = sum(map(int, inertia))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = [(a, int(inertia[a]), total, digests[a]) for a in range(len(centroids))]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each cluster


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def oracle_sql() -> str:
    """The same result in DuckDB SQL: every vector against every centroid in every round."""
    rounds = []
    for i in range(ROUNDS + 1):
        rounds.append(f"""a{i} AS MATERIALIZED (SELECT r, cluster, distance FROM (SELECT r, cluster, sum((v - c) * (v - c))::BIGINT AS distance FROM x JOIN c{i} USING (i) GROUP BY r, cluster)
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)""")
        rounds.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, c{i}.i, CASE WHEN n IS NULL THEN c ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS c
    FROM c{i} LEFT JOIN (SELECT cluster, i, sum(v) AS s, count(*) AS n FROM a{i} JOIN x USING (r) GROUP BY cluster, i) m ON m.cluster = c{i}.cluster AND m.i = c{i}.i)""")
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS point FROM embeddings
    WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {DIM}),
x AS MATERIALIZED (SELECT r, unnest(range({DIM})) AS i, unnest(point)::BIGINT AS v FROM e),
f AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, point) - 1 AS cluster FROM e QUALIFY cluster < {CLUSTERS}),
c0 AS MATERIALIZED (SELECT cluster, i, v AS c FROM x JOIN f USING (r)),
{", ".join(rounds[:-1])},
digest AS (SELECT cluster, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN e USING (r) JOIN digest USING (cluster)"""
