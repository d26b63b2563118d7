"""Exact top-k search by inner product with an impact-ordered index.

The components of integer vectors are quantised to levels of impact. A posting segment lists the vectors of a shard that
have one signed level in one component. For a block of queries the segments are processed by descending level: each
multiplies its impact with the queries' component once, and adds the product to the accumulators of its vectors. What is
left of a vector is bounded by the product of the query's norm and the norm of its unprocessed rest; processing stops
only when that bound proves that few vectors can still be among the k best, or when no segment is left. All possible
members are then scored exactly.

A shard's rows come to one task, which builds their index once and then reads the queries in blocks, as a stream.
Each shard returns k rows a query. Vectors that are null, empty, or hold null or non-finite components take no part,
nor do rows without vec_id. A query never meets rows with its own vec_id; of query rows that share a vec_id the one with
the least vector is asked. Repeated rows each count. Vectors of different lengths count as padded with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Queries that are processed at once; the most rows of a shard; as long as they have fewer, there are MANY shards of at least SMALL rows.
BLOCK, SHARD, MANY, SMALL = 64, 32768, 128, 4096
LEVELS = 10


class ImpactIndex:
    """Impact-ordered posting segments of a shard. products counts the multiplications made so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        most = int(np.abs(self.vectors).max(initial=0))
        self.step = max(1, -(-most // LEVELS))
        signed = np.sign(self.vectors) * ((np.abs(self.vectors) + self.step // 2) // self.step)
        #: Sums of products are integers; single precision is exact below 2**24, double below 2**53.
        largest = most * (most + self.step) * self.vectors.shape[1]
        self.kind = np.float32 if largest < 2**20 else np.float64
        self.exact_only = largest >= 2**50
        self.products = 0
        level = np.abs(signed)
        self.levels = list(range(int(level.max(initial=0)), 0, -1))
        #: For each level the segments (component, signed impact, places of vectors), and the norms of what then is left of the vectors.
        self.segments: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        self.rest: dict[int, np.ndarray] = {}
        left = (self.vectors.astype(np.float64) ** 2).sum(1)
        for at in self.levels:
            component, place = np.nonzero((level == at).T)
            value = signed[place, component]
            key = component * 2 + (value < 0)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order], prepend=-1))
            self.segments[at] = [(int(component[run[0]]), int(value[run[0]]) * self.step, place[run]) for run in np.split(order, cuts[1:]) if len(run)]
            whole = self.vectors[place, component].astype(np.float64)
            left = left + np.bincount(place, weights=(whole - value * self.step) ** 2 - whole**2, minlength=len(self.ids))
            self.rest[at] = np.sqrt(np.maximum(left, 0))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, vec_id, score) of the k best rows with other ids than the query's, ties to smaller ids."""
        n, width = self.vectors.shape
        asked = np.zeros((len(queries), width), np.int64)
        asked[:, : queries.shape[1]] = queries[:, :width]
        others = self.ids[:, None] != own[None, :]
        possible = others
        if n > k and not self.exact_only:
            norm = np.sqrt((asked.astype(np.float64) ** 2).sum(1))
            weights = np.ascontiguousarray(asked.T.astype(self.kind))
            score = np.zeros((n, len(queries)), self.kind)
            for level in self.levels:
                for component, impact, places in self.segments[level]:
                    score[places] += weights[component] * self.kind(impact)
                self.products += len(self.segments[level]) * len(queries)
                if level > 3:  # no bound is tight enough yet to be worth its test
                    continue
                bound = (self.rest[level][:, None] * norm[None, :] * (1 + 1e-5) + 1).astype(self.kind)
                reached = np.partition(np.where(others, score - bound, -np.inf), n - k, axis=0)[n - k]
                possible = others & (score + bound >= reached[None, :])
                if possible.sum(0).max() <= 4 * k:
                    break
        row, q = np.nonzero(possible)
        exact = np.zeros(len(q), np.int64)
        for at in range(0, len(q), 65536):
            exact[at : at + 65536] = np.einsum("ij,ij->i", asked[q[at : at + 65536]], self.vectors[row[at : at + 65536]])
        self.products += len(q) * width
        order = np.lexsort((row, -exact, q))
        q, row, exact = q[order], row[order], exact[order]
        best = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
        return q[best], self.ids[row[best]], exact[best]


def _matrix(vectors: pd.Series) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors))), np.int64)
    for at, v in enumerate(vectors):
        out[at, : len(v)] = v
    return out


def _search(k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come shard by shard, those of the index before the queries."""
        shard, index, rows = None, None, []
        for batch in batches:
            for (at, asks), part in batch.groupby(["shard", "asks"], sort=True):
                if at != shard:
                    shard, index, rows = at, None, []
                if not asks:
                    rows.append(part)
                    continue
                if index is None:
                    if not rows:
                        continue
                    held = pd.concat(rows)
                    index, rows = ImpactIndex(held["vec_id"].to_numpy(), _matrix(held["v"])), []
                    del held
                for first in range(0, len(part), BLOCK):
                    asked = part.iloc[first : first + BLOCK]
                    own = asked["vec_id"].to_numpy()
                    q, ids, score = index.search(_matrix(asked["v"]), own, k)
                    yield pd.DataFrame({"query_id": own[q], "vec_id": ids, "score": score})

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products for each row of queries.

    vectors and queries have columns vec_id and v, an array of long.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    # Of equal rows k are enough for any answer; so a row that makes up much of the table fills no shard.
    rows = vectors.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))))
    n = vectors.count()
    shards = max(1, -(-n // SHARD), min(MANY, -(-n // SMALL)))
    rows = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).alias("shard"), F.lit(False).alias("asks"), "vec_id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v")
    dealt = rows.unionByName(asked).repartition(2 * shards, "shard").sortWithinPartitions("shard", "asks")
    found = dealt.mapInPandas(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, with floor(64 x) for each component, of the rows that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    whole = F.col("vec_id").isNotNull() & (F.size("e") > 0) & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(whole).select("vec_id", F.transform("e", lambda x: F.floor(x * 64).cast("long")).alias("v"))


def op6_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products for every vector whose id is divisible by 20."""
    rows = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter(F.col("vec_id") % 20 == 0), 20)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 20"""
