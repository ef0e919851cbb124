"""Nearest neighbours by inner product with a vantage-point tree per shard.

One extra coordinate, sqrt(longest norm² - norm²), makes all stored vectors equally long; with a 0 there for queries, the
largest inner product is the smallest Euclidean distance, and the triangle inequality holds. A tree node keeps a vantage
point and the range of distances from it inside each half. A half is skipped when the least distance that the inequality
allows, times ``factor``, exceeds the current k-th distance: factor one is exact search, a larger one skips more.

Matrix products only preselect: whatever lies within their rounding error of the k-th score is scored again component by
component, so that equal vectors have equal scores in every block. Squared distances are compared with a slack for rounding.
Both margins are relative to the norms, hence the scale of the vectors does not matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rackpulse.session import materialise

SHARD_ROWS, QUERY_BLOCK, LEAF = 8_192, 1_024, 256
EPSILON = float(np.finfo(np.float64).eps)
#: Room for products below the smallest normal number, where errors are no longer relative.
TINY = float(np.finfo(np.float64).tiny)


def usable(vector: str) -> Column:
    """Vectors that take part: not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class VantageTree:
    """Points in tree order; a node is (start, end, middle, ranges of the inner and outer half, children)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, longest: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points, self.longest = ids[order], points[order].astype(np.float64), longest
        # The extra coordinate is computed once per point, so distances are those of fixed points and the inequality holds.
        self.tails = np.sqrt(np.maximum(longest**2 - (self.points**2).sum(1), 0)) if len(ids) else np.zeros(0)
        self.nodes: list[tuple] = []
        if len(ids):
            self._split(0, len(ids))

    def _squared(self, place: int, start: int, end: int) -> np.ndarray:
        """Squared distances, extra coordinate included, from the point at ``place``."""
        return ((self.points[start:end] - self.points[place]) ** 2).sum(1) + (self.tails[start:end] - self.tails[place]) ** 2

    def _split(self, start: int, end: int) -> int:
        number = len(self.nodes)
        self.nodes.append((start, end))
        if end - start <= LEAF:
            return number
        # The point farthest from an arbitrary one lies at the rim, where distances spread most.
        rim = start + int(np.argmax(self._squared(start, start, end)))
        stores = (self.ids, self.points, self.tails)
        for store in stores:
            store[[start, rim]] = store[[rim, start]]
        distance = np.sqrt(self._squared(start, start + 1, end))
        order = np.argsort(distance, kind="stable")
        for store in stores:
            store[start + 1 : end] = store[start + 1 : end][order]
        distance = distance[order]
        half = len(distance) // 2
        ranges = (distance[0], distance[half - 1], distance[half], distance[-1])
        middle = start + 1 + half
        inner = self._split(start + 1, middle)
        outer = self._split(middle, end)
        self.nodes[number] = (start, end, ranges, inner, outer)
        return number

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k nearest per query (-inf where fewer), and how many points were compared.

        Scores are added up in the order of the components; equal ones go by the id.
        """
        n = len(queries)
        queries = queries.astype(np.float64)
        best = np.full((n, k), -np.inf)
        best_ids = np.full((n, k), np.iinfo(np.int64).max)
        own_squared = (queries**2).sum(1)
        reach = own_squared + self.longest**2
        # Bounds of the rounding errors: of a product, relative of a distance in the tree, of a squared distance to a query.
        relative = (self.points.shape[-1] + 4) * EPSILON
        margin = 2 * relative * np.sqrt(own_squared) * self.longest + self.points.shape[-1] * TINY
        slack = 8 * relative * reach + self.points.shape[-1] * TINY
        compared = 0

        by_id = np.argsort(self.ids, kind="stable")
        first = np.searchsorted(self.ids[by_id], query_ids, side="left")
        last = np.searchsorted(self.ids[by_id], query_ids, side="right")
        # Places of the queries' own rows in tree order.
        own_query = np.repeat(np.arange(n), last - first)
        own_place = by_id[np.repeat(first - np.cumsum(last - first) + (last - first), last - first) + np.arange(len(own_query))]

        def take(rows: np.ndarray, start: int, end: int) -> np.ndarray:
            nonlocal compared
            scores = queries[rows] @ self.points[start:end].T
            compared += scores.size
            plain = scores[:, 0].copy()
            inside = np.flatnonzero((own_place >= start) & (own_place < end))
            if len(inside):
                row_of = np.full(n, -1)
                row_of[rows] = np.arange(len(rows))
                at = row_of[own_query[inside]]
                scores[at[at >= 0], own_place[inside][at >= 0] - start] = -np.inf
            better = np.flatnonzero((top := scores.max(axis=1)) >= best[rows, -1] - margin[rows])
            better = better[top[better] > -np.inf]
            if len(better):
                at, shown = rows[better], scores[better]
                limit = best[at, -1] - margin[at]
                if shown.shape[1] > k:
                    # k points score at least the k-th product less the margin; others that do are off by another margin.
                    limit = np.maximum(limit, np.partition(shown, -k, axis=1)[:, -k] - 2 * margin[at])
                row, place = np.nonzero((shown >= limit[:, None]) & (shown > -np.inf))
                exact = np.zeros(len(row))
                for d in range(queries.shape[1]):  # in the order of the components
                    exact += queries[at[row], d] * self.points[start + place, d]
                count = np.bincount(row, minlength=len(at))
                column = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                merged = np.full((len(at), k + int(count.max())), -np.inf)
                names = np.full(merged.shape, np.iinfo(np.int64).max)
                merged[:, :k], names[:, :k] = best[at], best_ids[at]
                merged[row, k + column], names[row, k + column] = exact, self.ids[start + place]
                order = np.lexsort((names, -merged), axis=1)[:, :k]
                best[at] = np.take_along_axis(merged, order, 1)
                best_ids[at] = np.take_along_axis(names, order, 1)
            return plain

        def visit(number: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            node = self.nodes[number]
            if len(node) == 2:
                take(rows, *node)
                return
            start, _, (inner_low, inner_high, outer_low, outer_high), inner, outer = node
            score = take(rows, start, start + 1)
            squared = reach[rows] - 2 * score
            nearest, distance, farthest = (np.sqrt(np.maximum(squared + s, 0)) for s in (-slack[rows], 0.0, slack[rows]))
            wide, tight = 1 + relative, 1 - relative
            halves = (
                (inner, np.maximum(np.maximum(nearest - inner_high * wide, inner_low * tight - farthest), 0)),
                (outer, np.maximum(np.maximum(nearest - outer_high * wide, outer_low * tight - farthest), 0)),
            )

            def near(least: np.ndarray, some: np.ndarray) -> np.ndarray:
                kth = best[rows[some], -1]
                radius = np.sqrt(np.maximum(reach[rows[some]] - 2 * kth + slack[rows[some]], 0))
                return some[~(least[some] * factor > radius * wide)]

            inward = distance <= (inner_high + outer_low) / 2
            for first, group in ((0, np.flatnonzero(inward)), (1, np.flatnonzero(~inward))):
                for child, least in (halves[first], halves[1 - first]):
                    visit(child, rows[near(least, group)])

        if self.nodes:
            visit(0, np.arange(n))
        return best_ids, best, compared


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per shard: (shard, dims, tree). All usable vectors with a key are indexed, repeated rows included.

    A shard holds about SHARD_ROWS vectors of one length, so that a task is bounded and the work per shard constant.
    """
    good = vectors.filter(usable(vector) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.size(vector).alias("dims")
    )
    good = materialise(good, "vectors")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    # One row per vector length.
    sizes = good.groupBy("dims").agg(F.max(norm).alias("longest"), F.ceil(F.count("*") / SHARD_ROWS).alias("shards"))
    dealt = good.join(F.broadcast(sizes), "dims").withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "shards"))

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        points = np.array(rows["vector"].tolist(), np.float64)
        tree = VantageTree(rows["id"].to_numpy(np.int64).copy(), points, float(rows["longest"].iloc[0]) * (1 + 1e-12))
        return pd.DataFrame({"dims": [key[0]], "part": [key[1]], "tree": [pickle.dumps(tree)]})

    return materialise(dealt.groupBy("dims", "part").applyInPandas(grow, "dims int, part long, tree binary"), "trees")


def search(index: DataFrame, queries: DataFrame, k: int, factor: float = 1.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank from 1, vec_id, score) of the ``k`` nearest per query row.

    Queries travel in blocks to every shard of their vector length. A row never finds its own id. ``score`` is the inner
    product of the original vectors, added up component by component in double precision; ties go to the smaller id. Queries
    that are not usable give no rows, and an empty index gives none. Repeated query rows are one query.
    """
    rows = queries.filter(usable(vector) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.size(vector).alias("dims")
    ).distinct()
    blocks = max(1, -(-rows.count() // QUERY_BLOCK))

    def gather(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id", kind="stable")
        raw = np.array(block["vector"].tolist(), np.float64).tobytes()
        return pd.DataFrame({"dims": [key[0]], "block": [key[1]], "ids": [block["id"].to_numpy("<i8").tobytes()], "raw": [raw]})

    packed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("dims", "block").applyInPandas(
        gather, "dims int, block long, ids binary, raw binary"
    )
    pairs = packed.join(index, "dims").repartition(F.col("block"), F.col("part"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                tree: VantageTree = pickle.loads(r.tree)
                ids = np.frombuffer(r.ids, "<i8")
                vectors = np.frombuffer(r.raw, np.float64).reshape(len(ids), -1)
                found, best, _ = tree.search(ids, vectors, k, factor)
                query, place = np.nonzero(best > -np.inf)
                yield pd.DataFrame({"query_id": ids[query], "vec_id": found[query, place], "score": best[query, place]})

    near = pairs.select("ids", "raw", "tree").mapInPandas(run, "query_id long, vec_id long, score double")
    by_query = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs
)
select query_id, cast(rank as int) as rank, vec_id, score from ranked where rank <= 20
"""
