"""Exact top-k search with a KD-tree per shard.

Vectors are dealt by id into shards of bounded size; each shard's tree splits at the median of the widest side of its
tight box, is built once and kept as a row of a table. Queries go out in blocks of bounded size, which are broadcast; trees
stay where they are, and only hits are shuffled. A block first searches the shard that each query lies in, which gives
every query a kth score; that bound goes along to the other shards. A tree is traversed best first, by the bound of a
box: the largest inner product that a point in it can have.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaframe.llm.common import materialise

SCALE = 1024
SHARD_ROWS = 8192
#: Queries that are broadcast at a time, of at most BLOCK_NUMBERS components in all.
BLOCK_ROWS, BLOCK_NUMBERS = 16_384, 4_000_000
LEAF = 128
LONG = 2**63


class Tree:
    """Rows sorted by leaf, and by node: box, rows, children, smallest id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        order = order[np.concatenate(([True], ids[order][1:] != ids[order][:-1]))] if len(ids) else order
        self.ids, self.x = ids[order], x[order]
        spans, low, high, kids = [(0, len(self.ids))], [], [], []
        i = 0
        while i < len(spans):
            a, b = spans[i]
            rows = self.x[a:b]
            low.append(rows.min(0))
            high.append(rows.max(0))
            if b - a > leaf:
                mid = (b - a) // 2
                part = np.argpartition(rows[:, int((high[-1] - low[-1]).argmax())], mid)
                self.x[a:b], self.ids[a:b] = rows[part], self.ids[a:b][part]
                kids.append(len(spans))
                spans += [(a, a + mid), (a + mid, b)]
            else:
                kids.append(-1)
            i += 1
        self.spans, self.kids = spans, kids
        self.low, self.high = np.array(low), np.array(high)
        self.least = [int(self.ids[a:b].min()) for a, b in spans]
        self.most = max(abs(int(self.low.min())), abs(int(self.high.max()))) if len(self.ids) else 0

    @classmethod
    def kept(cls, raw: bytes) -> Tree:
        tree = cls.__new__(cls)
        vars(tree).update(pickle.loads(raw))
        return tree

    def scores(self, rows: slice, q: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles or longs where these can't overflow, else in Python's integers."""
        if self.most * int(np.abs(q).max(initial=0)) * len(q) < 2**53:
            return (self.x[rows].astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
        if self.most * max(map(abs, q.tolist()), default=0) * len(q) < LONG:
            return self.x[rows] @ q
        return self.x[rows].astype(object) @ q.astype(object)

    def search(self, q: np.ndarray, qids: np.ndarray, k: int, bound: list) -> list[list[tuple[int, int]]]:
        """Per query the best (score, id) of this tree, at most k and none under its bound (None: no bound); ties to smaller ids."""
        low, high, f = self.low.astype(np.float64), self.high.astype(np.float64), q.astype(np.float64)
        tops = np.maximum(f, 0) @ high.T + np.minimum(f, 0) @ low.T
        # Room for what doubles round off, so that no box is left out wrongly.
        tops += (np.abs(f) @ np.maximum(np.abs(low), np.abs(high)).T) * (4 * q.shape[1] * 2.0**-53)
        out = []
        for i in range(len(q)):
            top, own, kth = tops[i].tolist(), int(qids[i]), -np.inf if bound[i] is None else bound[i]
            best: list[tuple[int, int]] = []  # a heap of (score, -id): its least entry is the worst
            todo = [(-top[0], self.least[0], 0)]
            while todo:
                t, _, node = heapq.heappop(todo)
                if -t < kth:
                    break
                if (kid := self.kids[node]) >= 0:
                    for c in (kid, kid + 1):
                        if top[c] >= kth:
                            heapq.heappush(todo, (-top[c], self.least[c], c))
                    continue
                a, b = self.spans[node]
                scores = self.scores(slice(a, b), q[i])
                at = np.flatnonzero(scores >= kth)
                if len(at) > k + 1:
                    at = np.array(sorted(at.tolist(), key=lambda j: (-int(scores[j]), int(self.ids[a + j])))[: k + 1])
                for j in at.tolist():
                    cand = (int(scores[j]), -int(self.ids[a + j]))
                    if cand[1] == -own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, cand)
                    elif cand > best[0]:
                        heapq.heapreplace(best, cand)
                if len(best) == k:
                    kth = max(kth, best[0][0])
            out.append([(s, -i) for s, i in best])
        return out


def _build(group):
    import pandas as pd

    x = np.array(group["x"].tolist(), dtype=np.int64)
    tree = Tree(group["vec_id"].to_numpy(np.int64), x)
    return pd.DataFrame({"dim": [x.shape[1]], "shard": [group["shard"].iloc[0]], "tree": [pickle.dumps(vars(tree))]})


def _search(block, k: int, own: bool):
    """Hits of the block's queries, arrays (dim, shard, id, x, bound) in the broadcast `block`, in their own shards or in the others."""

    def run(batches):
        dims, shards, ids, xs, bounds = block.value
        for batch in batches:
            for dim, shard, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.flatnonzero((dims == dim) & ((shards == shard) == own))
                if not len(at):
                    continue
                hits = Tree.kept(raw).search(np.array([xs[i] for i in at], np.int64), ids[at], k, [bounds[i] for i in at])
                rows = [(int(ids[i]), v, s) for i, found in zip(at.tolist(), hits, strict=True) for s, v in found]
                if rows:
                    q, v, s = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array([str(x) for x in s], pa.string())], names=["query_id", "vec_id", "exact"])

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query (vec_id divisible by `every`) with the others.

    Components become floor(scale * x). Vectors that are null or hold null or non-finite components, and null ids, take
    no part; vectors meet only those of their own length. One row of each vec_id counts: the least vector among repeated
    ones. Ties go to smaller vec_ids; ranks run from 1. Scores are exact; one beyond a long is ranked by its exact value and
    returned as the nearest long. Components beyond a long are the nearest long. Queries without partners and empty
    tables: no rows. Other columns have no influence.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = vectors.where(x.isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) > 0)).where(fine)
    whole = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("x"))
    whole = materialise(whole.groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("dim", F.size("x")))
    n = whole.count()
    dealt = whole.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // SHARD_ROWS)))))
    trees = materialise(dealt.groupBy("dim", "shard").applyInPandas(_build, "dim int, shard long, tree binary"))
    asked = materialise(dealt.where(F.col("vec_id") % every == 0))
    m = asked.count()
    widest = asked.agg(F.max("dim")).first()[0] or 1
    blocks = max(1, -(-m // max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // widest))))
    out, found = "query_id long, vec_id long, exact string", None
    for i in range(blocks if m else 0):
        rows = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)) == i).collect()
        dims, shards, ids = (np.array([r[c] for r in rows], np.int64) for c in ("dim", "shard", "vec_id"))
        xs = [r["x"] for r in rows]
        block = spark.sparkContext.broadcast((dims, shards, ids, xs, [None] * len(rows)))
        near = materialise(trees.mapInArrow(_search(block, k, True), out))
        least = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min(F.col("exact").cast("decimal(38,0)")).alias("kth")).where(F.col("n") >= k).collect()
        kth = {r["query_id"]: int(r["kth"]) for r in least}
        block = spark.sparkContext.broadcast((dims, shards, ids, xs, [kth.get(i) for i in ids.tolist()]))
        both = near.union(materialise(trees.mapInArrow(_search(block, k, False), out)))
        found = both if found is None else found.union(both)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    exact = F.col("exact").cast("decimal(38,0)")
    ranked = found.select("query_id", "vec_id", exact.alias("exact")).selectExpr("*", "row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, vec_id) AS rank")
    score = F.greatest(F.least("exact", F.lit(LONG - 1).cast("decimal(38,0)")), F.lit(-LONG).cast("decimal(38,0)")).cast("long")
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
