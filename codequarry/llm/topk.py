"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, floor(1024 * x), and are written once, in folders by length (an exponent
bucket of the norm, quarters of powers of two). A bucket's greatest norm gives each query a local
cosine threshold from its k-th best score so far: buckets whose threshold is above 1 for all
queries of a block are not read, and in others queries with such a threshold skip the bucket;
otherwise high thresholds prune by coordinates (the product over the query's greatest coordinates
plus the bound of the rest), low ones by length alone; what is left is verified with the whole
product.

First scores come from the SEEDS longest vectors, which are broadcast; they give each query the
least norm that can still matter. Queries are put into blocks of about QUERY_BLOCK, those of a
like least norm together, and each block is one job: its vectors are broadcast (a bound of its
own) against the folders it needs; each task keeps k a query, so that few rows are shuffled.

Defined results: vectors that are null or hold null, NaN or infinite components take no part;
shorter vectors count as filled with zeros; components and scores beyond 64 bits count as the
nearest number of 64 bits; candidates of the query's own id are left out; of query rows repeated
with one id the greatest vector asks; candidate rows repeated come repeatedly; of equal scores
the smaller id comes first; empty tables give no rows; other columns are left out, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, gone_at_exit, map_arrow, materialize, scratch_dir

QUERY_BLOCK = 4096
SEEDS = 256
#: Local cosine threshold from which coordinates prune before the whole product.
COORDINATES_FROM = 0.6
COORDINATES = 16
#: Products of one step: queries times candidates.
STEP_CELLS = 4_000_000


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array of long) and norm of the rows that take part."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine = F.col(vec_col).isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    whole = vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 1024)).alias("v"))
    return whole.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.int64)
    lens = np.asarray(pa.compute.list_value_length(column), np.int64)
    if len(lens) and (lens == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lens), width), np.int64)
    keep = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    rows = np.repeat(np.arange(len(lens)), lens)
    inside = keep < width
    out[rows[inside], keep[inside]] = flat[inside]
    return out


class Best:
    """The k best of every query of a block so far."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> None:
        self.q, self.ids, self.k = queries, ids, k
        self.norm = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
        self.floor = floor.astype(float)
        order = np.argsort(-np.abs(queries), axis=1)
        self.lead = order[:, : min(COORDINATES, queries.shape[1])]
        self.found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in ids]
        self.held = np.zeros(len(ids), np.int64)

    def product(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        top = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(v.astype(float)).max(initial=0)) * q.shape[1]
        if top < 2**52:
            return np.rint(q.astype(float) @ v.T.astype(float)).astype(np.int64)
        if top < 2**62:
            return q @ v.T
        return np.clip((q.astype(object) @ v.T.astype(object)), -(2**63), 2**63 - 1).astype(np.int64)

    def bucket(self, ids: np.ndarray, v: np.ndarray, norms: np.ndarray) -> None:
        """All candidates of one bucket, longest first."""
        order = np.argsort(-norms, kind="stable")
        ids, v, norms = ids[order], v[order], norms[order]
        step = max(1, STEP_CELLS // max(1, len(self.ids)))
        for a in range(0, len(ids), step):
            part, part_ids, part_norms = v[a : a + step], ids[a : a + step], norms[a : a + step]
            theta = self.floor / np.maximum(self.norm * part_norms[0], 1e-9)
            theta[self.norm * part_norms[0] == 0] = np.where(self.floor[self.norm * part_norms[0] == 0] > 0, 2.0, -1.0)
            live = np.flatnonzero(theta <= 1 + 1e-9)
            high = live[theta[live] >= COORDINATES_FROM]
            low = live[theta[live] < COORDINATES_FROM]
            if len(low):
                self.take(low, self.product(self.q[low], part), part_ids)
            for i in high.tolist():
                n = int(np.searchsorted(-part_norms, -(self.floor[i] / max(self.norm[i], 1e-9)) * (1 - 1e-9), side="right"))
                some = part[:n]
                lead = self.lead[i]
                q = self.q[i, lead].astype(float)
                x = some[:, lead].astype(float)
                rest_q = max(0.0, self.norm[i] ** 2 - float((q * q).sum()))
                rest_x = np.maximum(0.0, part_norms[:n] ** 2 - (x * x).sum(axis=1))
                keep = np.flatnonzero(x @ q + np.sqrt(rest_q * rest_x) * (1 + 1e-9) + 1e-6 >= self.floor[i])
                if len(keep):
                    self.take(np.array([i]), self.product(self.q[i : i + 1], some[keep]), part_ids[keep])

    def take(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        for r, i in enumerate(rows.tolist()):
            s = scores[r]
            own = np.flatnonzero((s >= self.floor[i]) & (ids != self.ids[i]))
            if len(own):
                self.found[i].append((s[own], ids[own]))
                self.held[i] += len(own)
                if self.held[i] >= 4 * self.k:
                    self.squeeze(i)

    def squeeze(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.found[i]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        s = np.concatenate([x for x, _ in self.found[i]])
        ids = np.concatenate([x for _, x in self.found[i]])
        best = np.lexsort((ids, -s))[: self.k]
        s, ids = s[best], ids[best]
        self.found[i], self.held[i] = [(s, ids)], len(s)
        if len(s) == self.k:
            self.floor[i] = max(self.floor[i], float(s[-1]))
        return s, ids


def _bucket(norm: Column) -> Column:
    """Quarters of powers of two; null vectors have a bucket of their own."""
    return F.when(norm > 0, F.floor(F.log2(norm) * 4)).otherwise(-1).cast("int")


def search(vectors: DataFrame, asks: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query (rows where ``asks`` holds)."""
    spark = vectors.sparkSession
    path = scratch_dir(spark, "vectors")
    integers(vectors, id_col, vec_col).withColumn("bucket", _bucket(F.col("norm"))).write.partitionBy("bucket").parquet(path)
    gone_at_exit(spark, path)
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kinds = "vec_id long, v array<bigint>, norm double, bucket int"
    rows = spark.read.schema(kinds).parquet(path)
    by = rows.groupBy("bucket").agg(F.max("norm").alias("norm"), F.max(F.size("v")).alias("width"), F.count("*").alias("n")).orderBy(F.desc("norm")).collect()  # some hundreds at most
    if not by:
        return none
    width = max(r["width"] for r in by)
    # the longest vectors: of the first buckets that hold SEEDS
    reach, held = [], 0
    for r in by:
        reach.append(r["bucket"])
        held += r["n"]
        if held >= SEEDS:
            break
    seeds = rows.where(F.col("bucket").isin(reach)).orderBy(F.desc("norm"), "vec_id").limit(SEEDS).toArrow()
    seed = spark.sparkContext.broadcast((_matrix(seeds["v"].combine_chunks(), width), np.asarray(seeds["vec_id"], np.int64)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed_v, seed_ids = seed.value
        for whole in batches:
            for at in range(0, len(whole), 1_000):
                batch = whole.slice(at, 1_000)
                best = Best(_matrix(batch.column(1), width), np.asarray(batch.column(0), np.int64), k, np.full(len(batch), -np.inf))
                best.take(np.arange(len(batch)), best.product(best.q, seed_v), seed_ids)
                for i in range(len(batch)):
                    best.squeeze(i)
                # below this norm no candidate can reach the floor
                need = np.where((best.norm > 0) & (best.floor > 0), best.floor / np.maximum(best.norm, 1e-9), 0.0)
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "v": batch.column(1), "floor": best.floor, "need": need * (1 - 1e-9)})

    asked = integers(vectors.where(asks), id_col, vec_col).groupBy("vec_id").agg(F.max("v").alias("v"))
    queries = materialize(map_arrow(asked, first, "vec_id long, v array<bigint>, floor double, need double"), "queries")
    n = queries.count()
    blocks = -(-n // QUERY_BLOCK)
    # like least norms together: ranges of them, in blocks of about one size
    cuts = queries.approxQuantile("need", [i / blocks for i in range(1, blocks)], 0.25 / blocks) if blocks > 1 else []
    queries = queries.withColumn("block", reduce(lambda a, b: a + b, ((F.col("need") > c).cast("int") for c in cuts), F.lit(0)))
    # needs of many queries may be equal: what exceeds a block is dealt by hash
    sizes = queries.groupBy("block").agg(F.count("*").alias("n"), F.min("need").alias("need")).orderBy("block").collect()
    found = []
    for r in sizes:
        parts = -(-r["n"] // QUERY_BLOCK)
        folders = [x["bucket"] for x in by if x["norm"] >= r["need"]]
        for part in range(parts):
            own = queries.where((F.col("block") == r["block"]) & (F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part)).orderBy("vec_id").toArrow().combine_chunks()
            if not own.num_rows:
                continue
            shared = spark.sparkContext.broadcast((_matrix(own["v"].combine_chunks(), width), np.asarray(own["vec_id"], np.int64), np.asarray(own["floor"], float)))
            found.append(materialize(_scan(rows.where(F.col("bucket").isin(folders)), shared, k, width), "top"))
            shared.unpersist()
    drop_scratch(queries)
    drop_scratch(rows)
    if not found:
        return none
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _scan(rows: DataFrame, shared, k: int, width: int) -> DataFrame:
    """The k best of each query of a block in every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shared.value[0], shared.value[1], k, shared.value[2].copy())
        for batch in batches:
            v, norms, exponent = _matrix(batch.column(1), width), np.asarray(batch.column(2), float), np.asarray(batch.column(3))
            cand = np.asarray(batch.column(0), np.int64)
            for e in np.unique(exponent)[::-1]:
                own = exponent == e
                best.bucket(cand[own], v[own], norms[own])
        out = [best.squeeze(i) for i in range(len(best.ids))]
        n = [len(s) for s, _ in out]
        empty = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_pydict({"query_id": np.repeat(best.ids, n), "vec_id": np.concatenate([*(x for _, x in out), empty]), "score": np.concatenate([*(s for s, _ in out), empty])})

    return map_arrow(rows.select("vec_id", "v", "norm", "bucket"), run, "query_id long, vec_id long, score long")


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
