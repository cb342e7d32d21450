"""Exact top-k by inner product with one KD-tree per shard of vectors.

A shard is a bounded number of vectors dealt out by a digest of the id. Its tree is made by median splits
of the widest dimension; each node has the tight bounding box of its vectors, and the whole tree is one
packed row. For a query q and a box, the sum over dimensions of max(q * low, q * high) is an upper bound of
the score; nodes are visited best first, and a node is skipped once its bound cannot reach the kth
best score so far (at equal score: cannot hold a smaller id). Queries go in blocks against shards, in two rounds: the
first asks one shard per block, and its kth scores go with the queries to the other shards, so
those start with a bound to prune by.

Components are turned to integers before anything else, so scores and ties are exact.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import written

LEAF = 32
SHARD_ROWS = 4096
QUERY_ROWS = 256


# --- one tree ---------------------------------------------------------------------------------

class Tree:
    """Arrays of a tree: vectors in leaf order; per node its range of rows, box, smallest id and children."""

    FIELDS = ("ids", "vectors", "begin", "end", "low", "high", "least", "left", "right")

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids,))
        begin, end, low, high, least, left, right = [], [], [], [], [], [], []
        stack = [(0, len(order), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            node, own = len(begin), vectors[order[a:b]]
            begin.append(a)
            end.append(b)
            low.append(own.min(0))
            high.append(own.max(0))
            least.append(ids[order[a:b]].min())
            left.append(-1)
            right.append(-1)
            if parent >= 0:
                (right if side else left)[parent] = node
            width = high[node].astype(np.int64) - low[node]
            # Vectors of no components are all alike and stay in one leaf.
            if b - a > leaf and vectors.shape[1]:
                # Half of the rows go to each side, also where all values are equal; ids then decide.
                axis = int(width.argmax())
                rows = order[a:b]
                order[a:b] = rows[np.lexsort((ids[rows], own[:, axis]))]
                middle = (a + b) // 2
                stack += [(middle, b, node, 1), (a, middle, node, 0)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.begin, self.end = np.array(begin, np.int32), np.array(end, np.int32)
        self.low, self.high = np.array(low), np.array(high)
        self.least, self.left, self.right = np.array(least), np.array(left, np.int32), np.array(right, np.int32)

    def pack(self) -> bytes:
        with pa.BufferOutputStream() as out:
            for name in self.FIELDS:
                pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(getattr(self, name))), out)
            return out.getvalue().to_pybytes()

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        tree, source = cls.__new__(cls), pa.BufferReader(data)
        for name in cls.FIELDS:
            setattr(tree, name, pa.ipc.read_tensor(source).to_numpy())
        return tree

    def search(self, query: np.ndarray, own_id: int | None, k: int, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best (score, -id) of ``found`` and this tree, as a heap; ``own_id`` itself takes no part."""
        if k <= 0:
            return found
        # The bound of every node at once: one product per sign of the query's components.
        bounds = self.high @ np.maximum(query, 0) + self.low @ np.minimum(query, 0)
        queue = [(-int(bounds[0]), int(self.least[0]), 0)]
        while queue:
            bound, least, node = heapq.heappop(queue)
            if len(found) == k:
                if -bound < found[0][0]:
                    break
                if -bound == found[0][0] and least > -found[0][1]:
                    continue
            if self.left[node] >= 0:
                for child in (int(self.left[node]), int(self.right[node])):
                    if len(found) < k or bounds[child] >= found[0][0]:
                        heapq.heappush(queue, (-int(bounds[child]), int(self.least[child]), child))
                continue
            a, b = self.begin[node], self.end[node]
            scores = self.vectors[a:b] @ query
            rows = np.arange(a, b)
            if len(found) == k:
                near = scores >= found[0][0]
                scores, rows = scores[near], rows[near]
            for score, row in zip(scores.tolist(), rows.tolist(), strict=True):
                pair = (score, -int(self.ids[row]))
                if -pair[1] == own_id:
                    continue
                if len(found) < k:
                    heapq.heappush(found, pair)
                elif pair > found[0]:
                    heapq.heapreplace(found, pair)
        return found


# --- the jobs ------------------------------------------------------------------------------------

def integer_vectors(df: DataFrame, id_col: str, vector: str, scale: float) -> DataFrame:
    """(_id, _v): floor(scale * x) of each component; rows with a null id, vector or component, or a component
    that is not finite, take no part. Of vectors of several lengths, each meets those of its own only."""
    x = F.col(vector)
    whole = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    return df.filter(whole).select(
        F.col(id_col).cast("long").alias("_id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("_v"))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(rows, -1)


def _exact(matrix: np.ndarray) -> np.ndarray:
    """float64 gives exact integers while every sum stays below 2**53, and is the fastest product; else Python integers."""
    top = int(np.abs(matrix).max(initial=0))
    return matrix.astype(np.float64 if top * top * max(1, matrix.shape[1]) < 1 << 53 else object)


def build_trees(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(dim, shard, tree): one row per shard of about ``shard_rows`` vectors of one length."""
    counts = vectors.groupBy(F.size("_v").alias("_dim")).count().withColumn(
        "_shards", F.ceil(F.col("count") / shard_rows).cast("int")).drop("count")
    # With the row's number, so that equal rows, however many, are dealt out too; the trees are written once.
    dealt = vectors.withColumns({"_dim": F.size("_v"), "_row": F.monotonically_increasing_id()}).join(counts, "_dim").withColumn(
        "_shard", F.pmod(F.xxhash64("_id", "_row"), F.col("_shards")).cast("int")).drop("_row")

    def grow(key, table):
        vectors = _matrix(table["_v"].combine_chunks(), len(table))
        ids = table["_id"].to_numpy().astype(np.int64)
        small = vectors.astype(np.int32) if np.abs(vectors).max(initial=0) < 1 << 31 else vectors
        return pa.table({
            "dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()),
            "tree": pa.array([Tree(ids, small).pack()], pa.binary())})

    return dealt.groupBy("_dim", "_shard").applyInArrow(grow, "dim int, shard int, tree binary")


def _search_blocks(k: int):
    """Each row holds a tree and a block of queries with what they have found so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                tree = Tree.unpack(batch.column("tree")[row].as_py())
                dim = tree.vectors.shape[1]
                queries = batch.column("queries")[row].values
                ids = queries.field("_id").to_pylist()
                matrix = _matrix(queries.field("_v"), len(ids))
                both = _exact(np.concatenate((tree.vectors.reshape(len(tree.ids), dim), matrix.reshape(len(ids), dim))))
                tree.vectors, matrix = both[: len(tree.ids)], both[len(tree.ids) :]
                tree.low, tree.high = tree.low.astype(both.dtype), tree.high.astype(both.dtype)
                out = []
                for i, seen in enumerate(queries.field("_found").to_pylist()):
                    # What was found before comes in as a bound and goes out again only from the first round.
                    before = [(p["score"], -p["vec_id"]) for p in seen or []]
                    heap = list(before)
                    heapq.heapify(heap)
                    # Equal pairs are rows of their own: of those in the heap, as many as came in are taken away.
                    new = Counter(tree.search(matrix[i], ids[i], k, heap)) - Counter(before)
                    out.append([{"score": int(s), "vec_id": -n} for s, n in new.elements()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())])))],
                    ["query_id", "found"])
    return run


FOUND = "array<struct<score: bigint, vec_id: bigint>>"


def top_k(
    df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: float = 256.0,
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with the other rows.

    Queries are the rows of ``df`` for which ``is_query`` holds; candidates are all rows but those with the query's own id. Ties
    go to the smaller id. With fewer candidates than k, all are returned; a query without any has no row. A repeated
    id is repeated among candidates and asked once as a query (with its smallest vector). Vectors of no components score 0 with each
    other. Results are exact: bounds only skip what cannot be among the k. Other columns of ``df`` are not looked at, whatever their
    names; an empty table, or one without queries, gives an empty one.
    """
    vectors = written(integer_vectors(df, id_col, vector, scale), "kd-vectors")
    asked = integer_vectors(df.filter(is_query), id_col, vector, scale).groupBy("_id").agg(F.min("_v").alias("_v"))
    trees = written(build_trees(vectors, shard_rows), "kd-trees")
    shards = trees.groupBy("dim").agg(F.count(F.lit(1)).cast("int").alias("_shards"), F.array_sort(F.collect_list("shard")).alias("_all"))
    # Blocks of bounded size: one per (length, digest); the digest also names the shard of the first round.
    n = asked.groupBy(F.size("_v").alias("dim")).count().withColumn("_blocks", F.ceil(F.col("count") / query_rows)).drop("count")
    blocked = written(
        asked.withColumn("dim", F.size("_v")).join(n, "dim")
        .withColumn("_block", F.pmod(F.xxhash64(F.lit("query"), "_id"), F.col("_blocks"))).drop("_blocks"), "kd-queries")

    def round_of(queries: DataFrame, shard: Column) -> DataFrame:
        blocks = (
            queries.groupBy("dim", "_block").agg(F.collect_list(F.struct("_id", "_v", "_found")).alias("queries"))
            .join(shards, "dim").select("dim", F.explode(shard).alias("shard"), "queries")
        )
        return blocks.join(trees, ["dim", "shard"]).select("queries", "tree").mapInArrow(
            _search_blocks(k), f"query_id bigint, found {FOUND}")

    home = F.pmod(F.xxhash64("dim", "_block"), F.col("_shards")).cast("int")
    first = written(
        round_of(blocked.withColumn("_found", F.lit(None).cast(FOUND)), F.slice("_all", home + 1, 1)), "kd-first")
    second = round_of(
        blocked.join(first.select(F.col("query_id").alias("_id"), F.col("found").alias("_found")), "_id"),
        F.filter("_all", lambda s: s != F.element_at(F.col("_all"), home + 1)))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        first.unionByName(second).select("query_id", F.explode("found").alias("p"))
        .select("query_id", "p.score", "p.vec_id")
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
