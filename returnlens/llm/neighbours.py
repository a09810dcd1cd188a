"""Approximate nearest neighbours by balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from returnlens.llm.shared import documents, stored

MOST_SAMPLE = 16_384
MOST_LISTS = 256
VECTORS_PER_LIST = 32
REPLICAS = 8
BOUNDARY = 0.10
RECALL = 0.97
DEGREE = 16
LIST_BLOCK = 2_000
QUERY_BLOCK = 500
SEARCH_BLOCK = 512


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of parts of equal size: every part is halved at the median along the line between two
    means, until there are as many as asked for."""
    random = np.random.default_rng(6)
    parts = [sample]
    while len(parts) * 2 <= lists:
        halves = []
        for part in parts:
            a, b = part[random.choice(len(part), 2, replace=False)]
            for _ in range(5):
                side = part @ (b - a)
                order = np.argsort(side, kind="stable")
                low, high = order[:len(part) // 2], order[len(part) // 2:]
                a, b = part[low].mean(axis=0), part[high].mean(axis=0)
            halves += [part[low], part[high]]
        parts = halves
    return np.stack([p.mean(axis=0) for p in parts])


class Lists:
    """Centroids and the graph that finds them: every centroid knows its nearest ones, and the next."""

    def __init__(self, sample: np.ndarray):
        many = max(1, min(MOST_LISTS, len(sample) // VECTORS_PER_LIST))
        self.centroids = balanced_centroids(sample, 1 << (many.bit_length() - 1))
        k = len(self.centroids)
        between = ((self.centroids[:, None] - self.centroids[None]) ** 2).sum(axis=2)
        links = np.zeros((k, k), dtype=np.float32)
        links[np.arange(k), (np.arange(k) + 1) % k] = 1
        np.put_along_axis(links, np.argsort(between, axis=1, kind="stable")[:, :DEGREE + 1], 1, axis=1)
        self.links = np.maximum(links, links.T)
        self.entries = np.unique(np.linspace(0, k - 1, 8).astype(int))
        self.ratio = self.calibrated(sample)

    def search(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """Distances of the centroids within (1 + ratio) of the nearest found, infinite elsewhere.

        Vectors go through in blocks, which bounds the memory whatever their number.
        """
        parts = [self._search(x[at:at + SEARCH_BLOCK], ratio) for at in range(0, len(x), SEARCH_BLOCK)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.centroids)))

    def _search(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """Best-first over the graph for a block of vectors at once: what lies within the bound is
        expanded until nothing new does."""
        found = np.full((len(x), len(self.centroids)), np.inf)
        fresh = np.zeros(found.shape, dtype=bool)
        fresh[:, self.entries] = True
        open_ = np.zeros(found.shape, dtype=bool)
        while fresh.any():
            row, node = np.nonzero(fresh)
            found[row, node] = np.sqrt(((x[row] - self.centroids[node]) ** 2).sum(axis=1))
            open_ |= fresh
            bound = found.min(axis=1, keepdims=True) * (1 + ratio) + 1e-12
            expand = open_ & ((found <= bound) | (found == found.min(axis=1, keepdims=True)))
            open_ &= ~expand
            fresh = ((expand.astype(np.float32) @ self.links) > 0) & np.isinf(found)
        found[found > found.min(axis=1, keepdims=True) * (1 + ratio) + 1e-12] = np.inf
        return found

    def homes(self, x: np.ndarray) -> np.ndarray:
        """Lists a vector stands in: the nearest, and up to seven more within the boundary ratio."""
        found = self.search(x, BOUNDARY)
        rank = np.argsort(np.argsort(found, axis=1, kind="stable"), axis=1, kind="stable")
        return np.isfinite(found) & (rank < REPLICAS)

    def calibrated(self, sample: np.ndarray) -> float:
        """The smallest ratio of a grid with which the sample's vectors find their five nearest."""
        asked = sample[:min(len(sample), 256)]
        near = asked @ sample.T
        near[np.arange(len(asked)), np.arange(len(asked))] = -2
        best = np.argsort(-near, axis=1, kind="stable")[:, :5]
        homes = self.homes(sample)
        for ratio in (0.02, 0.05, 0.08, 0.11, 0.14, 0.17, 0.2, 0.25, 0.3, 0.4, 0.6):
            lists = np.isfinite(self.search(asked, ratio))
            if (homes[best] & lists[:, None, :]).any(axis=2).mean() >= RECALL:
                return ratio
        return 1e9


def _place(shared, query: bool):
    """(list, id, vector) of every list a vector stands in, or a query asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                flat = piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
                x = unit(flat.reshape(piece.num_rows, -1))
                row, lists = np.nonzero(np.isfinite(index.search(x, index.ratio)) if query else index.homes(x))
                take = piece.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *take.columns], ["list", *batch.schema.names])

    return run


def _matches(k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        """The k best vectors of a block for every query of a block."""
        if not len(queries) or not len(vectors):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        q, v = np.stack(queries["vector"]).astype(float), np.stack(vectors["vector"]).astype(float)
        ids, own = vectors["id"].to_numpy(), queries["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        v, ids = v[order], ids[order]
        score = np.einsum("qd,vd->qv", q, v) / (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))[None])
        score[own[:, None] == ids[None]] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"query_id": np.repeat(own, best.shape[1]), "vec_id": ids[best].ravel(),
                            "score": np.take_along_axis(score, best, axis=1).ravel()})
        return out[np.isfinite(out["score"])]

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, most_sample: int = MOST_SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest vectors (vec_id, embedding) by cosine.

    The index is fitted on at most ``most_sample`` vectors, those with the smallest hash of their
    id, and holds every vector. Lists and the queries that ask them meet in blocks: a list of any
    length is dealt out over blocks, as are its queries. Null ids and vectors that are null, zero,
    not finite, or not of the commonest length take no part; vectors that repeat an id count once, by the
    nearer; ties go to the smaller id; a query is never its own neighbour; other columns play no
    part; empty tables give no rows.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    every = clean(vectors)
    length = every.groupBy(F.size("vector").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = every.where(F.size("vector") == length.n)
    rows = every.orderBy(F.xxhash64("id"), "id").limit(most_sample).toPandas()
    index = spark.sparkContext.broadcast(Lists(unit(np.stack(rows["vector"]).astype(float))))
    kinds = "list int, id long, vector array<double>"
    lists = stored(every.mapInArrow(_place(index, False), kinds), "lists")
    asked = stored(clean(queries).where(F.size("vector") == length.n).mapInArrow(_place(index, True), kinds), "asked")
    blocks = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = F.broadcast(blocks(lists, LIST_BLOCK, "parts").join(blocks(asked, QUERY_BLOCK, "turns"), "list"))  # a row per list
    own = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = asked.join(sizes, "list").select("list", "id", "vector", own("turns").alias("turn"), each("parts").alias("part"))
    right = lists.join(sizes, "list").select("list", "id", "vector", own("parts").alias("part"), each("turns").alias("turn"))
    keys = ["list", "part", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_matches(k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = documents(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
