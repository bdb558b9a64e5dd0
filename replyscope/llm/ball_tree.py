"""Exact top-k search by inner product: ball-tree branch and bound per shard.

Vectors are dealt to shards by space: the first splits of a ball tree, fitted on a bounded sample, lead every row to a leaf, and a leaf's rows
to shards of about equal size. Each shard has a ball tree. A node's inner products with a query are at most the product with
its centre plus the query's length times its radius. Queries pass a tree in blocks; children are visited by that bound, largest first,
and a node is left out for the queries whose k-th score so far is above it. Each query first searches the shard that it lies in itself;
with the k-th score found there it goes to those other shards whose leaf's ball can reach it.

Scores are exact integers. Vectors come in three classes by length, kept in shards of their own: products of short ones are exact in
doubles, those of middle ones in 64-bit integers, and those with a long one are computed in Python's integers, without pruning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replyscope.llm.common import save

LEAF = 128
BLOCK = 512
#: Squared lengths below which a vector is of class 0 (products below 2**52) and of class 1 (below 2**62); the others are of class 2.
SHORT, MIDDLE = 2.0**52, 2.0**62
LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: Components of the sample that fits the first splits, at most: vectors of many dimensions give fewer rows.
SAMPLE_COMPONENTS = 1 << 21
#: Shards that one leaf can have, in the numbering of shards.
PARTS = 1 << 32


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rows: np.ndarray | None = None
    children: tuple[Node, Node] | None = None
    axis: int = 0
    at: float = 0.0


def build(x: np.ndarray, rows: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Ball tree of the rows of ``x``, split at the median of the widest direction into leaves of at most ``leaf`` rows."""
    rows = np.arange(len(x)) if rows is None else rows
    own = x[rows]
    centre = own.mean(axis=0)
    node = Node(centre, float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
    spread = own.max(axis=0) - own.min(axis=0) if len(rows) > leaf else np.zeros(1)
    if not spread.max() > 0:
        node.rows = rows
        return node
    node.axis = int(spread.argmax())
    along = own[:, node.axis]
    order = np.argsort(along, kind="stable")
    half = len(rows) // 2
    node.at = float(along[order[half]])
    node.children = (build(x, rows[order[:half]], leaf), build(x, rows[order[half:]], leaf))
    return node


def leaves(node: Node) -> list[Node]:
    return [node] if node.children is None else leaves(node.children[0]) + leaves(node.children[1])


def place(node: Node, x: np.ndarray) -> np.ndarray:
    """The number of the leaf, in the order of ``leaves``, that each row of ``x`` falls into."""
    out = np.zeros(len(x), np.int64)

    def visit(node: Node, rows: np.ndarray, first: int) -> int:
        if node.children is None:
            out[rows] = first
            return first + 1
        low = x[rows, node.axis] < node.at
        return visit(node.children[1], rows[~low], visit(node.children[0], rows[low], first))

    visit(node, np.arange(len(x)), 0)
    return out


class Best:
    """The k best (score, id) of each query of a block, ties to the smaller id; scores are integers."""

    def __init__(self, kth: np.ndarray, k: int) -> None:
        self.k, self.kth = k, kth.copy()
        self.q, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = (np.concatenate(p) for p in ((self.q, q), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = np.flatnonzero(rank == self.k - 1)
        self.kth[q[last]] = np.maximum(self.kth[q[last]], score[last])
        self.q, self.score, self.id = (a[rank < self.k] for a in (q, score, ids))


def reach(queries: np.ndarray, length: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    """The largest inner product that each query can have with a vector of the ball, with room for rounding."""
    return queries @ centre + length * radius + 1e-12 * length * (np.sqrt(centre @ centre) + radius) + 1e-6


def search(tree: Node, x: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int, exact: type = float) -> Best:
    """The k best rows of ``x`` for each query among those that reach its ``kth``, rows of the query's ``own`` id left out. Products are
    computed in the type ``exact``, in which they must be exact."""
    best = Best(kth, k)
    length = np.sqrt((queries**2).sum(axis=1))
    of_type = queries.astype(exact)

    def visit(node: Node, at: np.ndarray) -> None:
        if node.rows is not None:
            score = (of_type[at] @ x[node.rows].astype(exact).T).astype(np.int64)
            hit, row = np.nonzero((score >= best.kth[at][:, None]) & (ids[node.rows][None, :] != own[at][:, None]))
            if len(hit):
                best.add(at[hit], score[hit, row], ids[node.rows[row]])
            return
        bounds = [reach(queries[at], length[at], c.centre, c.radius) for c in node.children]
        for i in (0, 1) if bounds[0].mean() >= bounds[1].mean() else (1, 0):
            now = bounds[i] >= best.kth[at]
            if now.any():
                visit(node.children[i], at[now])

    visit(tree, np.arange(len(queries)))
    return best


def search_long(x: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of one query over all rows of ``x``, in integers of any size."""
    q = [int(c) for c in query]
    scores = [(sum(a * int(b) for a, b in zip(q, row, strict=True)), int(i)) for row, i in zip(x, ids, strict=True) if i != own]
    return sorted(scores, key=lambda s: (-s[0], s[1]))[:k]


def beyond(score: int) -> bytes | None:
    """For a score at or beyond the ends of long, a key that orders such scores."""
    return (score + (1 << 2175)).to_bytes(272, "big") if not LOWEST < score < HIGHEST else None


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


FOUND = "query_id long, qh long, vec_id long, score long, beyond binary"


def shard_search(rows: DataFrame, k: int) -> DataFrame:
    """``FOUND`` from rows (dim, class, shard, kind, vec_id, h, kth, asker, v) where a shard's vectors have kind 0 and the queries that it is
    asked have kind 1 and their own class as ``asker``."""
    names = ["query_id", "qh", "vec_id", "score", "beyond"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, x, ids, tree = None, [], [], None
        for b in batches:
            dim, cls, shard, kind, asker = (b.column(c).to_numpy() for c in ("dim", "class", "shard", "kind", "asker"))
            change = np.zeros(max(b.num_rows - 1, 0), bool)
            for c in (dim, cls, shard, kind, asker):
                change |= c[1:] != c[:-1]
            cuts = (np.flatnonzero(change) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if hi == lo:
                    continue
                part = b.slice(lo, hi - lo)
                if (dim[lo], cls[lo], shard[lo]) != key:
                    key, x, ids, tree = (dim[lo], cls[lo], shard[lo]), [], [], None
                v, vec = _rows(part.column("v")), part.column("vec_id").to_numpy()
                if kind[lo] == 0:
                    x.append(v)
                    ids.append(vec)
                    continue
                if not x:
                    continue
                x, ids = [np.concatenate(x)], [np.concatenate(ids)]
                h, kth, level = part.column("h").to_numpy(), part.column("kth").to_numpy(), max(cls[lo], asker[lo])
                if level == 2:
                    for i in range(len(v)):
                        top = search_long(x[0], ids[0], v[i], vec[i], k)
                        n = len(top)
                        ends = [min(max(s, LOWEST), HIGHEST) for s, _ in top]
                        cols = [[vec[i]] * n, [h[i]] * n, [i for _, i in top], ends]
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([beyond(s) for s, _ in top], pa.binary())], names)
                    continue
                tree = tree or build(x[0])
                for s in range(0, len(v), BLOCK):
                    q = slice(s, s + BLOCK)
                    best = search(tree, x[0], ids[0], v[q], vec[q], kth[q], k, np.int64 if level else float)
                    cols = [vec[q][best.q], h[q][best.q], best.id, best.score]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.nulls(len(best.q), pa.binary())], names)

    keys = ["dim", "class", "shard"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "kind", "asker").mapInArrow(run, FOUND)


def integer_vector(v: Column, scale: float) -> Column:
    """floor(scale * x) of each component, as doubles, in which it is exact; null for empty vectors and for those with a component that is null or not
    finite, scaled or not."""
    scaled = F.transform(v, lambda x: x.cast("double") * scale)
    fine = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size(v) > 0)
    # The JVM's floor ends at the range of long; components beyond 2**53 are whole already.
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    return F.when(F.coalesce(v.isNotNull() & fine, F.lit(False)), whole)


def fit_trees(base: DataFrame, shard_rows: int, max_leaves: int, sample: int) -> dict[tuple[int, int], Node]:
    """By (dim, class) of more than ``shard_rows`` rows the first splits of their ball tree, at most ``max_leaves`` leaves together, from at most
    ``sample`` rows (SAMPLE_COMPONENTS components): those with the smallest hashes. Long vectors are not pruned and get none."""
    sizes = base.where(F.col("class") < 2).groupBy("dim", "class").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows)
    few = sizes.orderBy(F.desc("n"), "dim", "class").limit(max_leaves).collect()
    if not few:
        return {}
    rows = base.join(F.broadcast(base.sparkSession.createDataFrame([(r["dim"], r["class"]) for r in few], "dim int, class int")), ["dim", "class"])
    sample = min(sample, max(SAMPLE_COMPONENTS // max(r["dim"] for r in few), 1))
    held: dict[tuple[int, int], list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id", "h"), "vec_id").limit(sample).select("dim", "class", "v").collect():
        held.setdefault((r["dim"], r["class"]), []).append(r["v"])
    total, out = sum(r["n"] for r in few), {}
    for r in few:
        x = np.array(held.get((r["dim"], r["class"]), []), float)
        n = min(-(-r["n"] // shard_rows), max(max_leaves * r["n"] // total, 1))
        if n > 1 and len(x):
            out[r["dim"], r["class"]] = build(x, leaf=max(-(-len(x) // n), 1))
    return out


def placed(base: DataFrame, trees: dict[tuple[int, int], Node]) -> DataFrame:
    """``base`` with each row's ``leaf`` and its distance (``far``) to the leaf's centre; rows of a (dim, class) without a tree lie in leaf 0."""
    centres = {key: np.array([leaf.centre for leaf in leaves(t)]) for key, t in trees.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, cls = b.column("dim").to_numpy(), b.column("class").to_numpy()
            leaf, far = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for key in set(zip(dim.tolist(), cls.tolist(), strict=True)) & trees.keys():
                at = np.flatnonzero((dim == key[0]) & (cls == key[1]))
                x = _rows(b.column("v").take(pa.array(at)))
                leaf[at] = place(trees[key], x)
                far[at] = np.sqrt(((x - centres[key][leaf[at]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array(far)], [*b.schema.names, "leaf", "far"])

    return base.mapInArrow(run, base.schema.simpleString()[len("struct<") : -1] + ", leaf long, far double")


def away_rows(asked: DataFrame, trees: dict[tuple[int, int], Node], balls: list) -> DataFrame:
    """The queries ``asked`` (dim, class, shard, vec_id, h, kth, v) as rows for every other shard of their dimension that can hold a vector of
    their k-th score. ``balls`` are the leaves' (dim, class, leaf, parts, radius): one row for a leaf of the fitted trees or a dimension's class."""
    centres = {key: np.array([leaf.centre for leaf in leaves(t)]) for key, t in trees.items()}
    by_dim: dict[int, list] = {}
    for r in balls:
        centre = centres[r["dim"], r["class"]][r["leaf"]] if (r["dim"], r["class"]) in centres else None
        by_dim.setdefault(r["dim"], []).append((r["class"], r["leaf"], r["parts"], centre, r["radius"]))
    names = ["dim", "class", "shard", "kind", "vec_id", "h", "kth", "asker", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, cls, home, kth = (b.column(c).to_numpy() for c in ("dim", "class", "shard", "kth"))
            for d, asker in sorted(set(zip(dims.tolist(), cls.tolist(), strict=True))):
                at = np.flatnonzero((dims == d) & (cls == asker))
                v = _rows(b.column("v").take(pa.array(at)))
                length = np.sqrt((v**2).sum(axis=1)) if asker < 2 else None
                for c, leaf, parts, centre, radius in by_dim.get(d, []):
                    go = at
                    if centre is not None and asker < 2:
                        go = at[reach(v, length, centre, radius) >= kth[at]]
                    for part in range(parts):
                        shard = leaf * PARTS + part
                        now = go[(cls[go] != c) | (home[go] != shard)]
                        if len(now):
                            n, rows = len(now), b.take(pa.array(now))
                            cols = [pa.array(np.full(n, x, t)) for x, t in ((d, np.int32), (c, np.int32), (shard, np.int64), (1, np.int32))]
                            cols += [rows.column("vec_id"), rows.column("h"), rows.column("kth"), pa.array(np.full(n, asker, np.int32)), rows.column("v")]
                            yield pa.RecordBatch.from_arrays(cols, names)

    return asked.mapInArrow(run, "dim int, class int, shard long, kind int, vec_id long, h long, kth long, asker int, v array<double>")


def top_k(
    vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, shard_rows: int = 8192, max_leaves: int = 4096, sample: int = 20_000
) -> DataFrame:
    """The ``k`` largest inner products of each row of ``vectors`` (vec_id, embedding, any further columns) that ``queries`` selects with
    every other row: query_id, rank (from 1), vec_id, score. Vectors count as floor(scale * x), ties go to the smaller vec_id.

    Null or empty vectors, vectors with null or non-finite components (scaled or not) and rows without vec_id take no part; a zero
    vector does. Only vectors of the query's dimension are its candidates, rows with its vec_id are not, and a query with fewer than ``k``
    candidates returns all. Rows equal in id and vector count once; a vec_id with several vectors is searched for each. Scores
    are exact integers and ranked as such; one beyond the range of long is returned as the end of that range. An empty table gives no row.

    The shards' first splits are fitted on at most ``sample`` rows; their balls, at most ``max_leaves`` and one for each dimension and class, go
    through the driver. Every row is indexed, and its exact distance counts in its ball."""
    v = integer_vector(F.col("embedding"), scale)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    base = base.where("vec_id is not null and v is not null").dropDuplicates(["vec_id", "v"])
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    cls = F.when(squares < SHORT, 0).when(squares < MIDDLE, 1).otherwise(2).alias("class")
    base = save(base.select("vec_id", "v", "asked", F.size("v").alias("dim"), cls, F.xxhash64("v").alias("h")))
    trees = fit_trees(base, shard_rows, max_leaves, sample)
    base = save(placed(base, trees))
    parts = F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("parts")
    balls = save(base.groupBy("dim", "class", "leaf").agg(parts, F.max("far").alias("radius")))
    part = F.pmod(F.xxhash64("vec_id", "h"), F.col("parts"))
    base = base.join(balls.drop("radius"), ["dim", "class", "leaf"]).withColumn("shard", F.col("leaf") * PARTS + part)
    cols = ["dim", "class", "shard", F.lit(0).alias("kind"), "vec_id", "h", F.lit(LOWEST).alias("kth"), F.lit(0).alias("asker"), "v"]
    store, asked = base.select(*cols), base.where("asked")

    home = asked.select("dim", "class", "shard", F.lit(1).alias("kind"), "vec_id", "h", F.lit(LOWEST).alias("kth"), F.col("class").alias("asker"), "v")
    first = save(shard_search(store.unionByName(home), k))
    found = first.groupBy("query_id", "qh").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    bound = found.where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), F.col("qh").alias("h"), F.col("low").alias("kth"))
    asked = asked.join(bound, ["vec_id", "h"], "left").select("dim", "class", "shard", "vec_id", "h", F.coalesce("kth", F.lit(LOWEST)).alias("kth"), "v")
    away = away_rows(asked, trees, balls.collect())
    every = first.unionByName(shard_search(store.unionByName(away), k))
    order = W.partitionBy("query_id", "qh").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
