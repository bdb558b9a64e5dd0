"""Embedding near-dedup by cross-polytope hashing.

A hash rotates a unit vector (three rounds of random signs and a fast Hadamard transform) and takes the signed axis closest
to it. A table's code joins ``hashes`` of them; besides its own code a vector also enters the ``probes - 1`` codes that
lose least. Vectors that share a code in some table are candidates, and each candidate pair is verified by its cosine in double
precision. A pair is counted only in the first bucket that both vectors enter, so its links are exact without any list of pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyscope.llm.common import save, spanning_labels, whole_groups
from replyscope.llm.components import connected_components


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (their length a power of two), scaled to keep norms."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def codes(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """Codes of unit vectors, shape (rows, tables * probes); a code names its table too."""
    n, dim = x.shape
    d = 1 << max(dim - 1, 1).bit_length()
    x = np.pad(x, ((0, 0), (0, d - dim)))
    near = min(4, d)
    choice = [c for c in itertools.product(range(near), repeat=hashes) if sum(c) < near]
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        cost = np.zeros((n, len(choice)))
        code = np.full((n, len(choice)), t, np.int64)
        for j in range(hashes):
            sign = np.random.default_rng([seed, dim, t, j]).choice([-1.0, 1.0], (3, d))
            y = x
            for s in sign:
                y = hadamard(y * s)
            axis = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :near]
            value = np.take_along_axis(y, axis, 1)
            own = axis * 2 + (value < 0)
            loss = (np.abs(value[:, :1]) - np.abs(value)) ** 2
            pick = [c[j] for c in choice]
            cost += loss[:, pick]
            code = code * (2 * d) + own[:, pick]
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        best = np.pad(best, ((0, 0), (0, probes - best.shape[1])), mode="edge")  # few dimensions have fewer codes
        out[:, t] = np.take_along_axis(code, best, 1)
    return out.reshape(n, -1)


def usable(v: str | Column) -> Column:
    """True for vectors with only finite components and a length above zero."""
    v = F.col(v) if isinstance(v, str) else v
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows: list[np.ndarray] | np.ndarray) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def hashed(classes: DataFrame, tables: int, hashes: int, probes: int, seed: int) -> DataFrame:
    """``classes`` (h, h2, low, n, v) with ``codes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                part = b.take(pa.array(np.flatnonzero(size == dim)))
                found = codes(unit(_matrix(part.column("v"))), tables, hashes, probes, seed)
                col = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], found.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, col], [*part.schema.names, "codes"])

    return classes.mapInArrow(run, "h long, h2 long, low long, n long, v array<double>, codes array<long>")


def first_shared(a: np.ndarray, b: np.ndarray, tables: int) -> np.ndarray:
    """First code (in table order, then by value) that the rows of ``a`` and ``b`` share; each pair shares one."""
    probes = a.shape[1] // tables
    out = np.full(len(a), -1, np.int64)
    open_ = np.arange(len(a))
    for t in range(tables):
        x, y = (m[open_, t * probes : (t + 1) * probes] for m in (a, b))
        same = (x[:, :, None] == y[:, None, :]).any(axis=2)
        least = np.where(same, x, np.iinfo(np.int64).max).min(axis=1)
        hit = same.any(axis=1)
        out[open_[hit]] = least[hit]
        open_ = open_[~hit]
        if not len(open_):
            break
    return out


def verify(rows: DataFrame, threshold: float, tables: int) -> DataFrame:
    """(h, h2, low, links, root) for the vectors that link with others, from bucket rows (code, i, j, side, class columns)."""
    keys = ["code", "i", "j"]

    def group(t: pa.Table, code: int, i: int, j: int) -> pa.RecordBatch | None:
        vectors = t.column("v").combine_chunks()
        size = vectors.value_lengths().to_numpy(zero_copy_only=False)
        if not len(size) or (size != size[0]).any():  # a code is of one dimension but for chance
            out = [group(t.take(np.flatnonzero(size == d)), code, i, j) for d in np.unique(size)]
            out = [x for x in out if x is not None]
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None
        x, all_codes = unit(_matrix(vectors)), _matrix(t.column("codes").combine_chunks())
        weight, low, side = (t.column(c).to_numpy() for c in ("n", "low", "side"))
        n = len(x)
        links = np.zeros(n, np.int64)
        for lo in range(0, n, 256):
            cos = x[lo : lo + 256] @ x.T
            p, q = np.nonzero(cos >= threshold)
            p = p + lo
            keep = p < q
            if i != j:
                keep &= side[p] != side[q]
            p, q = p[keep], q[keep]
            for s in range(0, len(p), 1 << 16):
                a, b = p[s : s + (1 << 16)], q[s : s + (1 << 16)]
                own = first_shared(all_codes[a], all_codes[b], tables) == code
                np.add.at(links, a[own], weight[b[own]])
                np.add.at(links, b[own], weight[a[own]])
        label = spanning_labels(n, lambda k, rest: x[rest] @ x[k] >= threshold)
        root = low[label]
        on = np.flatnonzero((links > 0) | (label != np.arange(n)))
        if not len(on):
            return None
        cols = [t.column(c).combine_chunks().take(pa.array(on)) for c in ("h", "h2", "low")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(links[on]), pa.array(root[on])], ["h", "h2", "low", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, keys):
            ids = [table.column(c).to_numpy() for c in keys]
            for g in np.flatnonzero(np.diff(at) > 1):
                out = group(table.slice(at[g], at[g + 1] - at[g]), *(int(c[at[g]]) for c in ids))
                if out is not None:
                    yield out

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "h long, h2 long, low long, links long, root long")


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, tables: int = 4, hashes: int = 3, probes: int = 6, block: int = 512, seed: int = 17
) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, any further columns): vec_id, n_links, component_id, kept.

    Equal vectors form one class first; a class links its own rows and counts in full for those it links with. A bucket
    of more than ``block`` classes is split into blocks whose pairs are tasks of their own. With the defaults a
    pair at the threshold shares a bucket with a chance of about 0.999 in 64 dimensions.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do rows without a vec_id
    (component_id null, kept false). Vectors of different dimension never link. Rows that share a vec_id are one
    node of a component and link with each other only by their vectors. An empty table gives no row."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double") + F.lit(0.0))
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable("embedding") & F.col("vec_id").isNotNull(), v).alias("v"))
    src = src.select("vec_id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("h2"), F.size("v").alias("dim"))
    classes = (
        src.where("v is not null")
        .groupBy("h", "h2")
        .agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    )
    c = save(hashed(classes.select("h", "h2", "low", "n", "v"), tables, hashes, probes, seed))
    entries = c.select("h", "h2", F.explode(F.array_distinct("codes")).alias("code"))
    buckets = entries.groupBy("code").agg(F.count(F.lit(1)).alias("s")).where("s > 1")
    parts = F.ceil(F.col("s") / block).cast("int")
    mine = F.pmod(F.col("h"), parts).cast("int")
    live = entries.join(buckets, "code").select("h", "h2", "code", mine.alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    live = live.select("h", "h2", "code", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.col("mine").alias("side"))
    found = save(verify(live.join(c, ["h", "h2"]), threshold, tables))
    roots = connected_components(found.select(F.col("low").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("h", "h2").agg(F.sum("links").alias("links"))
    per = c.select("h", "h2", "low", "n").join(links, ["h", "h2"], "left").join(roots.withColumnRenamed("node", "low"), "low", "left")
    per = per.select("h", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("m"), F.coalesce("root", "low").alias("c"))
    alone = F.col("v").isNull()
    out = src.drop("dim").join(per, ["h", "h2"], "left").select(
        "vec_id",
        F.when(alone, F.lit(0)).otherwise(F.col("m")).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("c")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
