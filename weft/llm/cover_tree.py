"""Exact top-k inner-product search with cover trees over queries and data.

Queries are taken in groups of bounded size, each sent to all tasks as a cover tree; no data row moves. A task builds cover trees over
blocks of its own rows and searches both trees together. A node has a centre, covers all its vectors within an angle and a
distance of it, and knows their least and greatest norms; its children cover theirs within a fraction of that. A pair of nodes
whose greatest possible inner product is under the worst k-th score of the query node's queries is pruned with all below it.
That product is the smaller of two bounds: by distances, ``<a, b> + |a| r_b + |b| r_a + r_a r_b`` of the centres and radii, and by
angles, the greatest norms' product times the cosine of the centres' angle less both covering angles. At a leaf of queries, nodes
are bounded again for each query alone; what is left is scored by matrix products, best bound first.

K-th scores pass from block to block of a task, and all tasks start from those that the group's queries reach among
themselves, as they are rows of the data too. Vectors without clusters can't be pruned by any such bound: of independent directions in 64
dimensions every pair is scored.

Components become ``floor(256 * x)``; scores are integers, by doubles where these are exact and by 64-bit integers or Python's
beyond; a score that 64 bits can't hold is an error.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor do rows with a
null id; vectors are compared with those of the same length only; a query's own id is no candidate, in whatever
row; repeated rows are candidates each; ties go to the smaller id; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE = 256
K = 5
EVERY = 50
#: Queries that are sent to all tasks at once, about, and vectors that a tree is built over.
QUERY_GROUP = 8192
DATA_BLOCK = 8192
LEAF = 32
#: Rows that a matrix product scores at least, if so many are left.
CHUNK = 256
#: A node's children cover within this part of its radius.
SHRINK = 0.7
#: Radians by which rounding may not narrow a bound.
SLACK = 1e-6
LEAST = np.iinfo(np.int64).min


class Tree:
    """A cover tree over the rows of x (whole numbers), its nodes numbered from the root on."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.real = x.astype(np.float64)
        self.norms = np.sqrt((self.real**2).sum(1))
        self.unit = self.real / np.maximum(self.norms, 1e-300)[:, None]
        self.centres, self.angles, self.radii, self.low, self.high, self.rows, self.children = [], [], [], [], [], [], []
        self._node(np.arange(len(x)), 0)
        self.centres = np.array(self.centres)
        self.directions = self.unit[self.centres]
        self.points = self.real[self.centres]
        self.angles, self.radii, self.low, self.high = (np.array(a) for a in (self.angles, self.radii, self.low, self.high))
        self.inner = np.array([bool(c) for c in self.children])

    def _chords(self, rows, centre):
        return np.sqrt(np.maximum(2 - 2 * (self.unit[rows] @ self.unit[centre]), 0))

    def _node(self, rows: np.ndarray, centre: int) -> int:
        number = len(self.rows)
        far, norms = self._chords(rows, centre), self.norms[rows]
        far[norms == 0] = 0  # no direction: its products are 0, which the least norm sees to
        self.centres.append(centre)
        self.angles.append(2 * np.arcsin(min(far.max() / 2, 1.0)) + SLACK)
        self.radii.append(np.sqrt(((self.real[rows] - self.real[centre]) ** 2).sum(1)).max())
        self.low.append(norms.min())
        self.high.append(norms.max())
        self.rows.append(rows)
        self.children.append([])
        if len(rows) <= LEAF or far.max() == 0:
            return number
        # centres in turn, each the row farthest from those before, until all rows are covered; a node whose children would be
        # nearly as many as its rows is cut into a few that cover less well
        most = max(2, len(rows) // 16)
        near, owner, at = far.copy(), np.zeros(len(rows), np.int64), [centre]
        while near.max() > SHRINK * far.max() and len(at) < most:
            new = int(rows[np.argmax(near)])
            d = self._chords(rows, new)
            closer = d < near
            owner[closer], near[closer] = len(at), d[closer]
            at.append(new)
        for k, c in enumerate(at):
            own = rows[owner == k]
            if 0 < len(own) < len(rows):
                self.children[number].append(self._node(own, c))
        return number

    def bounds(self, node: int, other: Tree, nodes: np.ndarray) -> np.ndarray:
        """The greatest inner products of the node's rows with those of the other tree's nodes."""
        cosine = np.clip(other.directions[nodes] @ self.directions[node], -1, 1)
        spread = np.cos(np.clip(np.arccos(cosine) - self.angles[node] - other.angles[nodes] - SLACK, 0, np.pi))
        by_angle = np.where(spread >= 0, self.high[node] * other.high[nodes], self.low[node] * other.low[nodes]) * spread
        a, b = np.sqrt((self.points[node] ** 2).sum()), other.norms[other.centres[nodes]]
        by_distance = other.points[nodes] @ self.points[node] + a * other.radii[nodes] + b * self.radii[node] + self.radii[node] * other.radii[nodes]
        return np.minimum(by_angle, by_distance) + 1e-9 * (self.high[node] * other.high[nodes] + 1)  # rounding never prunes


    def row_bounds(self, rows: np.ndarray, other: Tree, nodes: np.ndarray) -> np.ndarray:
        """The greatest inner products of each of the rows with those of the other tree's nodes."""
        norms = self.norms[rows][:, None]
        cosine = np.clip(self.unit[rows] @ other.directions[nodes].T, -1, 1)
        spread = np.cos(np.clip(np.arccos(cosine) - other.angles[nodes] - SLACK, 0, np.pi))
        by_angle = norms * np.where(spread >= 0, other.high[nodes], other.low[nodes]) * spread
        by_distance = self.real[rows] @ other.points[nodes].T + norms * other.radii[nodes]
        return np.minimum(by_angle, by_distance) + 1e-9 * (norms * other.high[nodes] + 1)


class Best:
    """The k best (score, id) of each query so far, and the scores that they need."""

    def __init__(self, n: int, k: int, needed: np.ndarray | None = None):
        self.k, self.scored = k, 0
        self.scores = np.full((n, k), LEAST, np.int64)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.needed = np.full(n, LEAST, np.int64) if needed is None else needed.copy()

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = (scores >= self.needed[rows][:, None]).any(0)
        scores, ids = scores[:, keep], ids[keep]
        if not len(ids):
            return
        if scores.shape[1] > 8 * self.k:  # all that may be among the best, ties included
            kth = np.partition(scores, -self.k, axis=1)[:, -self.k]
            keep = (scores >= kth[:, None]).any(0)
            scores, ids = scores[:, keep], ids[keep]
        both = np.concatenate((self.scores[rows], scores), axis=1)
        names = np.concatenate((self.ids[rows], np.broadcast_to(ids, scores.shape)), axis=1)
        # ~x: the order of -x, for the least number too
        order = np.lexsort((names, ~both), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(both, order, 1)
        self.ids[rows] = np.take_along_axis(names, order, 1)
        self.needed[rows] = np.maximum(self.needed[rows], self.scores[rows, -1])


def _products(a: Tree, b: Tree):
    """products(rows of a, rows of b) as 64-bit integers."""
    most = float(np.abs(a.real).max()) * float(np.abs(b.real).max()) * a.x.shape[1]
    if most < 2**53:
        return lambda i, j: (a.real[i] @ b.real[j].T).astype(np.int64)
    if most < 2**62:
        return lambda i, j: (a.x[i][:, None, :] * b.x[j][None]).sum(2)

    def exact(i, j):
        out = a.x[i].astype(object) @ b.x[j].astype(object).T
        if any(abs(v) >= 1 << 63 for v in out.ravel()):
            raise OverflowError("a score needs more than 64 bits")
        return out.astype(np.int64)

    return exact


def dual_search(left: Tree, q_ids: np.ndarray, right: Tree, x_ids: np.ndarray, best: Best) -> Best:
    """Takes into ``best`` the candidates of greatest inner product for each query, ties to smaller ids, a query's own id left out."""
    products = _products(left, right)

    def visit(a: int, nodes: np.ndarray) -> None:
        own = left.rows[a]
        bounds = left.bounds(a, right, nodes)
        while True:
            able = bounds >= best.needed[own].min()
            nodes, bounds = nodes[able], bounds[able]
            # a data node is taken apart if it is wider than the query node, or this is a leaf
            split = right.inner[nodes] & (~left.inner[a] | (right.angles[nodes] >= left.angles[a]))
            if not split.any():
                break
            below = np.array([c for n in nodes[split] for c in right.children[n]])
            nodes, bounds = np.concatenate((nodes[~split], below)), np.concatenate((bounds[~split], left.bounds(a, right, below)))
        if left.inner[a]:
            for child in left.children[a]:
                visit(child, nodes)
            return
        # each query's own bounds: those of one leaf may look in different directions
        single = left.row_bounds(own, right, nodes)
        needs = single >= best.needed[own][:, None]
        if needs.mean() > 0.5:
            score(own, nodes[needs.any(0)], single[:, needs.any(0)].max(0))
        else:
            for k in range(len(own)):
                score(own[k : k + 1], nodes[needs[k]], single[k, needs[k]])

    def score(own: np.ndarray, nodes: np.ndarray, bounds: np.ndarray) -> None:
        order = np.argsort(-bounds, kind="stable")
        at = 0
        while at < len(order) and bounds[order[at]] >= best.needed[own].min():
            end, rows = at, 0
            while end < len(order) and rows < CHUNK:
                rows += len(right.rows[nodes[order[end]]])
                end += 1
            found = np.concatenate([right.rows[n] for n in nodes[order[at:end]]])
            s = products(own, found)
            best.scored += s.size
            s[q_ids[own][:, None] == x_ids[found][None]] = LEAST
            best.add(own, s, x_ids[found])
            at = end

    visit(0, np.zeros(1, np.int64))
    return best


class Queries:
    """A group's queries of one length: rows, ids, their tree, and the k-th scores that they reach among themselves."""

    def __init__(self, rows, ids, x, k: int):
        self.rows, self.ids, self.tree, self.k = np.array(rows, np.int64), np.array(ids, np.int64), Tree(x), k
        self.needed = dual_search(self.tree, self.ids, self.tree, self.ids, Best(len(x), k)).needed


def _search(sent, block: int):
    def run(batches):
        best = {n: Best(len(q.ids), q.k, q.needed) for n, q in sent.value.items()}

        def take(held):
            data = pd.concat(held)
            for n, own in data.groupby(data["v"].map(len)):
                if n in best:
                    q = sent.value[n]
                    dual_search(q.tree, q.ids, Tree(np.stack(own["v"].to_list()).astype(np.int64)), own["id"].to_numpy(np.int64), best[n])

        held, rows = [], 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= block:
                take(held)
                held, rows = [], 0
        if rows:
            take(held)
        for n, b in best.items():
            q, at = sent.value[n], b.scores > LEAST
            yield pd.DataFrame({"query_row": np.repeat(q.rows, at.sum(1)), "query_id": np.repeat(q.ids, at.sum(1)), "vec_id": b.ids[at], "score": b.scores[at]})

    return run


FOUND = "query_row long, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, query_group: int = QUERY_GROUP, data_block: int = DATA_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all vectors."""
    spark = vectors.sparkSession
    common.tune(spark)
    scaled = F.transform(F.col("embedding"), lambda v: F.floor(v.cast("double") * SCALE))
    whole = F.size("embedding") > 0
    sound = F.forall(F.col("embedding"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    own = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole & sound).select(F.col("vec_id").cast("long").alias("id"), scaled.alias("v"))
    own = common.materialise(own.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = own.where(F.col("id") % every == 0)
    groups = -(-asked.count() // query_group)
    path = f"{common.shared_dir(spark)}/weft-{uuid.uuid4().hex}-top-k"
    spark.createDataFrame([], FOUND).write.parquet(path)
    common.swept(spark, path)
    for g in range(groups):  # a group's queries are as many as the hash deals it, about query_group
        lengths: dict = {}
        for r in asked.where(F.pmod(F.xxhash64("id", "row"), F.lit(groups)) == g).orderBy("row").collect():
            lengths.setdefault(len(r["v"]), []).append(r)
        sent = spark.sparkContext.broadcast({n: Queries([r["row"] for r in rows], [r["id"] for r in rows], np.array([r["v"] for r in rows], np.int64), k) for n, rows in lengths.items()})
        own.select("id", "v").mapInPandas(_search(sent, data_block), FOUND).write.mode("append").parquet(path)
        sent.unpersist()
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(FOUND).parquet(path)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_cover_tree(spark, sf_dir):
    return top_k(common.table(spark, sf_dir, "embeddings"))
