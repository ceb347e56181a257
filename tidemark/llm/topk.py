"""Exact top-k by inner product: ball-tree branch and bound in shards.

Vectors are dealt to shards by the top levels of one ball tree, built on a sample: a shard is a ball too, with its
radius over all its vectors. A task builds the lower levels over its shard and streams queries past
them, visiting nodes by falling upper bound q.c + |q| r and stopping where the bound falls below the k-th
score so far. Every query begins in the shard of the highest bound; later rounds start from the k-th
scores of all rounds before and send a query only to shards whose bound reaches its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, table, written

SHARD_ROWS = 16_384
LEAF = 128
ROUNDS = (1, 8, None)
"""How many of its best balls a query may have visited after each round; at last all that its k-th score doesn't rule out."""
SAMPLE_PER_BALL = 64
SAMPLE_VALUES = 1 << 22
"""Components of sampled vectors on the driver at most. The sample decides where balls lie, never what is found."""
EXACT = 2.0**53
LONG = 2**63 - 1


class BallTree:
    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        centers, radii = [], []
        stack = [(0, len(points), -1)]
        while stack:
            a, b, parent = stack.pop()
            own = points[self.order[a:b]]
            node, center = len(self.spans), own.mean(axis=0)
            centers.append(center)
            radii.append(np.sqrt(((own - center) ** 2).sum(axis=1).max()))
            self.spans.append((a, b))
            self.children.append(None)
            if parent >= 0:
                self.children[parent] = (*(self.children[parent] or ()), node)
            spread = own.max(axis=0) - own.min(axis=0)
            if b - a > LEAF and spread.any():
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, spread.argmax()], middle)]
                stack += [(a, a + middle, node), (a + middle, b, node)]
        self.centers, self.radii = np.array(centers), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of every query with every node's points, rounded up."""
        b = queries @ self.centers.T + np.sqrt((queries**2).sum(axis=1))[:, None] * self.radii
        return b + 1e-9 * np.abs(b) + 1e-6


class Balls:
    """The top levels: the largest part of a sample is split at the mean of its widest component, which falls between
    clusters, until there are as many leaves as asked for."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.splits: list[tuple[int, float, int, int] | None] = [None]
        parts = [(0, np.arange(len(sample)))]
        while len(parts) < leaves:
            at = max(range(len(parts)), key=lambda i: len(parts[i][1]))
            node, rows = parts[at]
            own = sample[rows]
            spread = own.max(axis=0) - own.min(axis=0) if len(own) > 1 else np.zeros(1)
            if not (np.isfinite(spread).all() and spread.any()):
                break  # nothing left to tell apart
            d = int(spread.argmax())
            cut = float(own[:, d].mean())
            low = own[:, d] <= cut
            if low.all():
                low = own[:, d] < cut
                cut = float(own[low, d].max())
            left, right = len(self.splits), len(self.splits) + 1
            self.splits[node] = (d, cut, left, right)
            self.splits += [None, None]
            parts[at : at + 1] = [(left, rows[low]), (right, rows[~low])]
        self.leaf = {node: i for i, (node, _) in enumerate(parts)}
        self.centers = np.stack([sample[rows].mean(axis=0) if len(rows) else np.zeros(sample.shape[1]) for _, rows in parts])

    def of(self, points: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if self.splits[node] is None:
                out[rows] = self.leaf[node]
            elif len(rows):
                d, cut, left, right = self.splits[node]
                low = points[rows, d] <= cut
                stack += [(left, rows[low]), (right, rows[~low])]
        return out

    def distances(self, points: np.ndarray, ball: np.ndarray) -> np.ndarray:
        return np.sqrt(((points - self.centers[ball]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-6


def placed(batches: Iterator[pa.RecordBatch], width: int, balls: Balls) -> Iterator[pa.RecordBatch]:
    """Ball of each vector and its distance from the centre."""
    for batch in batches:
        points = matrix(batch.column(1), width)
        with np.errstate(all="ignore"):
            ball = balls.of(points)
            far = balls.distances(points, ball)
        columns = [batch.column(0), batch.column(1), pa.array(ball), pa.array(np.where(np.isnan(far), np.inf, far))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "ball", "far"])


def visits(batches: Iterator[pa.RecordBatch], width: int, balls: Balls, radii: np.ndarray, held: list[range], a: int, b: int | None) -> Iterator[pa.RecordBatch]:
    """(shard, id, v, floor): the a-th to b-th best balls of each query, of those whose bound reaches its k-th score."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            queries = matrix(part.column(1), width)
            with np.errstate(all="ignore"):
                bound = queries @ balls.centers.T + np.sqrt((queries**2).sum(axis=1))[:, None] * radii
                bound = np.nan_to_num(bound + 1e-9 * np.abs(bound) + 1e-6, nan=np.inf, posinf=np.inf)
            bound = np.maximum(bound, -float(LONG))  # scores stop there
            order = np.argsort(-bound, axis=1, kind="stable")[:, a:b]
            row, shard = [], []
            for i, floor in enumerate(part.column(2).to_pylist()):
                for c in order[i].tolist():
                    if floor is not None and bound[i, c] < floor:
                        break
                    row += [i] * len(held[c])
                    shard += held[c]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *part.take(pa.array(row, pa.int64())).columns], names=["shard", "id", "v", "floor"])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer components floor(1024 x) as doubles, one row a vector, missing trailing components 0."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values, out = pc.list_flatten(column).to_numpy(zero_copy_only=False), np.zeros((len(column), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return np.floor(out * 1024.0)


def whole(numbers: np.ndarray) -> np.ndarray:
    return np.vectorize(int, otypes=[object])(numbers) if numbers.size else numbers.astype(object)


def search(points: np.ndarray, tree: BallTree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, floor: list[int | None], k: int):
    """Yield (query number, ids, scores) of the points that can be among each query's k best; ``floor`` is a k-th score
    found elsewhere. Points whose id is the query's own take no part. Scores stop at the ends of 64 bits."""
    exact = np.abs(points).max(initial=0) * np.abs(queries).max(initial=0) * points.shape[1] < EXACT
    bounds = np.maximum(np.nan_to_num(tree.bounds(queries), nan=np.inf, posinf=np.inf), -float(LONG))  # overflow: visit
    if not exact:  # beyond what doubles add exactly
        points, queries = whole(points), whole(queries)
    for i in range(len(queries)):
        least = -np.inf if floor[i] is None else floor[i]
        heap, best_i, best_s = [(-bounds[i, 0], 0)], np.empty(0, np.int64), np.empty(0, points.dtype)
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < least:
                break
            if tree.children[node]:
                for c in tree.children[node]:
                    heapq.heappush(heap, (-bounds[i, c], c))
                continue
            a, b = tree.spans[node]
            at = tree.order[a:b]
            score = points[at] @ queries[i]
            if not exact:
                score = np.minimum(np.maximum(score, -LONG), LONG)
            keep = (score >= least) & (ids[at] != own[i])
            if not keep.any():
                continue
            best_i, best_s = np.r_[best_i, ids[at][keep]], np.r_[best_s, score[keep]]
            if len(best_s) > k:
                first = np.lexsort((best_i, -best_s))[:k]
                best_i, best_s = best_i[first], best_s[first]
            if len(best_s) == k:
                least = max(least, int(best_s.min()))
        yield i, best_i, best_s


def answered(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (shard, kind): a tree over each shard's points (kind 0), then its queries (kind 1), batch by batch."""
    now, parts, shard = None, [], None
    for batch in batches:
        of, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "kind"))
        turns = np.flatnonzero((np.diff(of) != 0) | (np.diff(kind) != 0)) + 1
        for a, b in zip([0, *turns], [*turns, batch.num_rows]):
            if b == a:
                continue
            rows = batch.slice(a, b - a)
            ids, vectors = rows.column("id").to_numpy(), matrix(rows.column("v"), width)
            if of[a] != shard:
                now, parts, shard = None, [], of[a]
            if kind[a] == 0:
                parts.append((ids, vectors))
                continue
            if now is None and parts:
                points = np.concatenate([p[1] for p in parts])
                now, parts = (points, BallTree(points), np.concatenate([p[0] for p in parts])), []
            if now is None:  # queries of an empty shard
                continue
            out: list[list] = [[], [], []]
            for i, found, scores in search(*now, vectors, ids, rows.column("floor").to_pylist(), k):
                out[0] += [int(ids[i])] * len(found)
                out[1] += found.tolist()
                out[2] += [int(s) for s in scores]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to smaller ids.

    Vectors (and queries) without an id, null, or with null or non-finite components take no part; of
    repeated query ids the smallest vector asks. Vectors of different length are filled up with zeros.
    Rows with the query's id are its own and no candidates; repeated rows are candidates each. Scores beyond
    64 bits count as the largest (or smallest) long. Empty tables give no rows.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 1024) != float("inf"))
    usable = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite)
    )
    points = usable(vectors)
    asked = usable(queries).groupBy("id").agg(F.min("v").alias("v"))
    n, width = points.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    wide = asked.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    width, leaves = max(width, wide, 1), -(-n // SHARD_ROWS) or 1
    if leaves > 1:
        some = min(SAMPLE_PER_BALL * leaves, max(2 * leaves, SAMPLE_VALUES // width))
        sample = points.orderBy(F.xxhash64("id"), "id", "v").limit(some).select("v").toArrow()
        balls = Balls(matrix(sample.column("v").combine_chunks(), width), leaves)
    else:
        balls = Balls(np.zeros((1, width)), 1)
    kind = "array<double>"
    dealt = written(points.mapInArrow(lambda rows: placed(rows, width, balls), f"id long, v {kind}, ball int, far double"))
    found_balls = {r.ball: (r.n, r.far) for r in dealt.groupBy("ball").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # a row a ball
    # a ball of very many vectors, as of copies of one, is several shards
    radii, held, shards, rows = np.full(len(balls.centers), -np.inf), [], 0, []
    for i in range(len(balls.centers)):
        count, radius = found_balls.get(i, (0, -np.inf))
        parts = -(-count // SHARD_ROWS)
        radii[i] = radius
        held.append(range(shards, shards + parts))
        rows.append((i, shards, max(parts, 1)))
        shards += parts
    seats = points.sparkSession.createDataFrame(rows, "ball int, first int, parts int")
    shard = (F.col("first") + F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts"))).cast("int")
    dealt = dealt.join(small(seats, len(rows)), "ball").select(shard.alias("shard"), "id", "v")

    def answers(a: int, b: int | None, floor: DataFrame) -> DataFrame:
        ask = asked.join(floor, "id", "left").select("id", "v", "floor")
        ask = written(ask.mapInArrow(lambda rows: visits(rows, width, balls, radii, held, a, b), f"shard int, id long, v {kind}, floor long"))
        visited = ask.select("shard").distinct()
        own = dealt.join(small(visited), "shard", "left_semi").select("shard", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("long").alias("floor"))
        both = own.unionByName(ask.select("shard", F.lit(1).alias("kind"), "id", "v", "floor"))
        both = both.repartitionById(max(shards, 1), "shard").sortWithinPartitions("shard", "kind")  # the shard's number is its partition
        return written(both.mapInArrow(lambda batches: answered(batches, width, k), "query_id long, vec_id long, score long"))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found, before = None, 0
    for upto in ROUNDS:
        if found is None:
            floor = asked.select("id", F.lit(None).cast("long").alias("floor")).limit(0)
        else:  # the k-th best so far
            ranked = found.withColumn("place", F.row_number().over(order)).where(F.col("place") == k)
            floor = ranked.select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        more = answers(before, upto, floor)
        found = more if found is None else found.union(more)
        if upto is None or upto >= len(balls.centers):
            break
        before = upto
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best candidates of each vector whose id is divisible by 100; nulls, ties and repeats as in ``top_k``."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


ORACLE = {
    "op3_top_k": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
WHERE rank <= 10"""
}


def registered() -> dict:
    return {"op3_top_k": op3_top_k}
