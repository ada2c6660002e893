"""Centroid clustering in whole numbers, with Hamerly's bounds.

Vectors become integers, floor(1024 * x). Every vector keeps its centroid, an upper bound of the
distance to it and one lower bound of the distance to any other. When centroids move, the upper
bound grows by the drift of the own one, the lower bound shrinks by the largest drift of the
others. A vector whose upper bound stays below its lower bound, or below half the distance from its
centroid to the next, can't change; others get their exact distance, and where that doesn't
decide, an exact scan of all centroids in whole numbers. Bounds are widened by a part in 10^9, and
equal bounds count as undecided, so that rounding decides nothing.

Vectors with their bounds are written once a round in the shared folder and the round before is
removed; each task needs only the centroids. Sums change by the vectors that moved and are
gathered by Spark; the driver holds one sum a centroid and component.

Defined results: vectors that are null, of another width, or hold null, NaN or infinite components
take no part; fewer vectors than centroids make fewer centroids; a vector with a null id is
clustered but starts no centroid (if no vector has an id, there are no rows); rows repeated with
one id are vectors of their own, and of equal hashes the smaller vector comes first; of equal
distances the smaller number wins; components, distances and sums beyond 64 bits count as the
nearest number of 64 bits; empty tables give no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, map_batches, materialize

CENTROIDS = 8
ROUNDS = 10
WIDTH = 64
SEED = 3
#: Products of numbers below this, and their sums over WIDTH, fit into 64 bits.
SMALL = 1 << 27
MARGIN = 1e-9
MOST = (1 << 63) - 1


def integers(vectors: DataFrame, width: int, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array of long) of the vectors that take part."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine = (F.size(vec_col) == width) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 1024)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids, as an integer or object array."""
    if max(np.abs(v.astype(float)).max(initial=0), np.abs(c.astype(float)).max(initial=0)) < SMALL and v.shape[1] <= WIDTH:
        return np.stack([((v - own) ** 2).sum(axis=1) for own in c], axis=1)
    wide, out = v.astype(object), np.empty((len(v), len(c)), object)
    for k, own in enumerate(c.astype(object)):
        out[:, k] = ((wide - own) ** 2).sum(axis=1)
    return out


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float))


class Bounds:
    """One round: the centroids, and what has moved since the round before."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None) -> None:
        self.c = centroids
        n = len(centroids)
        apart = roots(squares(centroids, centroids))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1) / 2 * (1 - MARGIN)
        self.drift = np.zeros(n) if before is None else np.array([roots(squares(a[None], b[None]))[0, 0] for a, b in zip(centroids, before, strict=True)])
        self.drift *= 1 + MARGIN
        self.others = np.array([np.delete(self.drift, k).max(initial=0) for k in range(n)])

    def assign(self, v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Centroid, upper and lower bound of every vector; how many had a full scan."""
        own, new = own.copy(), own < 0
        safe = np.where(new, 0, own)
        upper = np.where(new, np.inf, (upper + self.drift[safe]) * (1 + MARGIN))
        lower = np.where(new, 0.0, np.maximum(0.0, lower - self.others[safe]) * (1 - MARGIN))
        doubt = np.flatnonzero(new | ~(upper < np.maximum(lower, self.half[safe])))
        # the exact distance may be enough
        old = doubt[~new[doubt]]
        for k in np.unique(own[old]):
            rows = old[own[old] == k]
            upper[rows] = roots(squares(v[rows], self.c[k : k + 1])[:, 0]) * (1 + MARGIN)
        scan = doubt[new[doubt] | ~(upper[doubt] < np.maximum(lower, self.half[safe])[doubt])]
        if len(scan):
            d = squares(v[scan], self.c)
            own[scan] = d.argmin(axis=1)
            at = np.arange(len(scan))
            upper[scan] = roots(d[at, own[scan]]) * (1 + MARGIN)
            rest = roots(d)
            rest[at, own[scan]] = np.inf
            lower[scan] = rest.min(axis=1) * (1 - MARGIN)
        return own, upper, lower, len(scan)


def _round(state: DataFrame, bounds: Bounds, width: int) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(bounds)

    def run(batch: pa.RecordBatch) -> pa.Table:
        v = _matrix(batch.column("v"), width)
        before = np.asarray(batch.column("own"), np.int32)
        own, upper, lower, _ = shared.value.assign(v, before, np.asarray(batch.column("upper"), float), np.asarray(batch.column("lower"), float))
        return pa.table([batch.column("vec_id"), batch.column("v"), pa.array(own, pa.int32()), pa.array(before, pa.int32()), pa.array(upper), pa.array(lower)], names=list(STATE))

    return map_batches(state.select(*STATE), run, ", ".join(f"{c} {t}" for c, t in STATE.items()))


STATE = {"vec_id": "long", "v": "array<bigint>", "own": "int", "before": "int", "upper": "double", "lower": "double"}


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
    spark = vectors.sparkSession
    rows = integers(vectors, width, id_col, vec_col)
    none = F.lit(-1)
    state = materialize(rows.select("vec_id", "v", none.alias("own"), none.alias("before"), F.lit(math.inf).alias("upper"), F.lit(0.0).alias("lower")), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = [r["v"] for r in state.where("vec_id IS NOT NULL").orderBy(key, "v").limit(centroids).collect()]
    kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], kinds)
    at, before = np.array(start, np.int64), None
    largest = state.agg(F.max(F.greatest(F.abs(F.array_max("v").cast("decimal(38,0)")), F.abs(F.array_min("v").cast("decimal(38,0)")))), F.count("*")).first()
    kind = "long" if int(largest[0]) * largest[1] < 1 << 62 else "decimal(38,0)"
    sums, counts = [[0] * width for _ in start], [0] * len(start)
    for r in range(rounds + 1):
        last, state = state, materialize(_round(state, Bounds(at, before), width), f"round{r}")
        drop_scratch(last)
        if r == rounds:
            break
        for k, n, moved in _moves(state, width, kind):
            counts[k] += n
            sums[k] = [a + int(b) for a, b in zip(sums[k], moved, strict=True)]
        before, at = at, np.array([[a // n for a in s] if n else list(c) for s, n, c in zip(sums, counts, at.tolist(), strict=True)], np.int64)
    return _result(state, at, width)


def _moves(state: DataFrame, width: int, kind: str) -> list[tuple[int, int, list[int]]]:
    """centroid, change of its count and of its sums: a row a centroid."""
    sides = F.array(F.struct(F.col("own").alias("k"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("k"), F.lit(-1).alias("sign")))
    moved = state.where("own <> before").select(F.explode(sides).alias("s"), "v").where("s.k >= 0")
    sums = [F.sum(F.col("v")[i].cast(kind) * F.col("s.sign").cast(kind)).alias(f"c{i}") for i in range(width)]
    by = moved.groupBy("s.k").agg(F.sum("s.sign").alias("n"), F.array(*sums).alias("sums"))
    return [(r["k"], r["n"], r["sums"]) for r in by.collect()]


def _result(state: DataFrame, at: np.ndarray, width: int) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(at)

    def run(batch: pa.RecordBatch) -> pa.Table:
        v, own = _matrix(batch.column("v"), width), np.asarray(batch.column("own"), np.int32)
        d = np.zeros(len(v), np.int64)
        for k in np.unique(own):
            d[own == k] = np.minimum(squares(v[own == k], shared.value[k : k + 1])[:, 0], MOST).astype(np.int64)
        return pa.table([batch.column("vec_id"), pa.array(own, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    found = materialize(map_batches(state.select("vec_id", "v", "own"), run, "vec_id long, cluster int, distance long"), "clusters")
    drop_scratch(state)
    inertia = {r["cluster"]: int(r["n"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}  # a row a centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()]
    of = [(k, min(n, MOST), min(sum(inertia.values()), MOST), digest[k]) for k, n in sorted(inertia.items())]
    about = found.sparkSession.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(centroids: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED) -> str:
    """The rounds written out, each with all distances."""
    steps = [f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM e WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {centroids}))"""]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT e.r, c.k, list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM e, c{r} c),
a{r} AS MATERIALIZED (SELECT r, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if r < rounds:
            steps.append(f"""u{r} AS (SELECT a.k, i.i, sum(e.v[i.i])::BIGINT AS s, count(*) AS n FROM a{r} a JOIN e USING (r), range(1, {width + 1}) i(i) GROUP BY ALL),
n{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM u{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN n{r} n USING (k))""")
    return ",\n".join(steps) + f"""
SELECT e.vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN e USING (r) JOIN c{rounds} c USING (k)"""
