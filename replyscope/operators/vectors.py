"""Embedding statistics: encode texts through a caller's encoder (E1), per-dataset standardisation (E2), exact and
approximate cosine k-nearest-neighbour graph per dataset (E3), 2-D projection (E4) and scatter data (E5).

E3 is exact without materialising vector pairs as rows: each dataset's vectors are cut into hash blocks of bounded
size; every pair of blocks (i <= j) is one group, of which numpy multiplies the two blocks, a stretch at a time, and keeps only each row's k
best candidates; a final top-k per row merges the blocks. Work is the unavoidable n^2 * d of exact kNN, but shuffled
data is n * blocks * d and the candidate rows are n * k * blocks. Where n^2 is too much, ``cosine_knn_lsh`` compares only vectors
that share a bucket of random hyperplanes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from replyscope.operators.sampling import hash60

# ------------------------------------------------------------------------------------------------ E1


def embed(df: DataFrame, text_col: str, encoder: Callable[[list], list] | None = None, out: str = "embedding",
          batch_size: int = 32, encoder_factory: Callable[[], Callable[[list], list]] | None = None) -> DataFrame:
    """``out`` = encoder(texts) in batches of ``batch_size`` inside an iterator pandas UDF. ``encoder`` maps a
    list of strings to a list of float vectors; with ``encoder_factory`` instead, the encoder (e.g. a loaded model)
    is built once per Python worker."""
    if (encoder is None) == (encoder_factory is None):
        raise ValueError("pass exactly one of encoder and encoder_factory")

    name = uuid.uuid4().hex

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def enc(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from replyscope.streaming.inference import per_worker

        fn = encoder if encoder is not None else per_worker(encoder_factory, name)
        for s in it:
            vals = []
            texts = s.tolist()
            for i in range(0, len(texts), batch_size):
                vals.extend(fn([t if t is not None else "" for t in texts[i:i + batch_size]]))
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in vals])

    return df.withColumn(out, enc(F.col(text_col)))


# ------------------------------------------------------------------------------------------------ E2


def standardize(df: DataFrame, vec: str = "embedding", group: str = "label", out: str = "scaled") -> DataFrame:
    """Per group, subtract the mean and divide by the population standard deviation of every dimension (a
    zero deviation divides by 1). Group statistics come from one vectorised aggregate (``Summarizer``), not from
    exploding the vectors; the per-group table (groups x dim) is joined back."""
    v = array_to_vector(F.col(vec))
    stats = df.where(F.col(vec).isNotNull()).groupBy(group).agg(
        Summarizer.metrics("mean", "variance", "count").summary(v).alias("s")
    ).select(
        F.col(group).alias("__g"),
        vector_to_array(F.col("s.mean")).alias("__mean"),
        vector_to_array(F.col("s.variance")).alias("__var"),
        F.col("s.count").alias("__n"),
    )
    # Population variance from the sample variance: var * (n - 1) / n.
    stats = stats.select(
        "__g", "__mean",
        F.transform("__var", lambda x: F.sqrt(x * (F.col("__n") - 1) / F.col("__n"))).alias("__std"),
    )
    joined = df.join(stats, df[group] == F.col("__g"), "left")
    scaled = F.zip_with(
        F.zip_with(F.col(vec), F.col("__mean"), lambda x, m: x - m), F.col("__std"),
        lambda d, s: d / F.when(s == 0, F.lit(1.0)).otherwise(s),
    )
    return joined.withColumn(out, scaled).drop("__g", "__mean", "__std")


def normalize(vec) -> F.Column:
    c = F.col(vec) if isinstance(vec, str) else vec
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(c, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


# ------------------------------------------------------------------------------------------------ E3

#: Similarities held at a time, and rows of a block of ``cosine_knn``: a task holds two blocks and so many similarities.
CHUNK = 1 << 21
BLOCK_ROWS = 4096


def best_columns(s: np.ndarray, k: int, starts: np.ndarray, eps: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest numbers of each row of ``s``. The columns are in order of their ids, ``starts`` says where an id begins;
    of numbers within ``eps`` of the k-th the smallest ids stay, all columns of an id together."""
    s = np.where(np.isnan(s), -np.inf, s)
    m = s.shape[1]
    kth = np.partition(s, m - k, axis=1)[:, m - k] if k < m else s.min(axis=1)
    hit = s >= (kth - eps)[:, None]
    crowded = np.flatnonzero(hit.sum(axis=1) > k)
    if len(crowded):
        ties = hit[crowded] & (s[crowded] <= (kth[crowded] + eps)[:, None])
        room = k - (hit[crowded] & ~ties).sum(axis=1)
        of_id = np.logical_or.reduceat(ties, starts, axis=1)
        kept = of_id & (np.cumsum(of_id, axis=1) <= room[:, None])
        hit[crowded] &= ~ties | np.repeat(kept, np.diff(starts, append=m), axis=1)
    return np.nonzero(hit & np.isfinite(s))


def _side(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The ids of one block in order, its vectors, and where each id begins."""
    table = table.sort_by("id")
    ids, v = table["id"].combine_chunks(), table["v"].combine_chunks()
    lengths = pc.min_max(pc.list_value_length(v)).as_py()
    if lengths["min"] != lengths["max"]:
        raise ValueError(f"vectors of {lengths['min']} and of {lengths['max']} components in one group")
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(ids), -1)
    new = np.concatenate([[True], pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)])
    return ids, x, np.flatnonzero(new)


def _pair_topk(k: int, schema: pa.Schema):
    """From the rows (grp, id, v, second) of one pair of blocks (or of one block, if none is ``second``) each row's ``k`` best of the other."""
    def run(table: pa.Table) -> pa.Table:
        a, second = _side(table.filter(pc.invert(table["second"]))), table.filter(table["second"])
        b = _side(second) if len(second) else None
        found = []
        for q, c in ([(a, a)] if b is None else [(a, b), (b, a)]):
            kk = min(k, len(c[0]) - (b is None))
            step = max(1, CHUNK // len(c[0]))
            for at in range(0, len(q[0]) if kk > 0 else 0, step):
                sims = q[1][at:at + step] @ c[1].T
                if b is None:
                    own = np.arange(len(sims))
                    sims[own, at + own] = -np.inf
                # A matrix product rounds equal pairs unequally, by place; those kept are computed again, each alike.
                qi, ci = best_columns(sims, kk, c[2], c[1].shape[1] * 2.0 ** -52)
                qi = at + qi
                exact = np.einsum("ij,ij->i", q[1][qi], c[1][ci])
                found.append(pa.table([pa.repeat(table["grp"][0], len(qi)), pc.array_take(q[0], pa.array(qi)), pc.array_take(c[0], pa.array(ci)), pa.array(exact)], schema=schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    return run


def _unit_rows(df: DataFrame, vec: str, group: str, key: str) -> DataFrame:
    """(grp, id, v): the vectors scaled to length 1."""
    return df.where(F.col(vec).isNotNull() & F.col(group).isNotNull()).select(
        F.col(group).alias("grp"), F.col(key).alias("id"), normalize(vec).alias("v"))


def _cell_candidates(base: DataFrame, cell: Sequence[str], k: int, large: DataFrame) -> DataFrame:
    """(grp, vec_id, neighbor_id, sim): for each row of ``base`` (grp, id, v and the columns of ``cell``) at least its ``k`` most
    similar other rows of the same cell. A cell named in ``large`` (its columns and ``nb``, see ``_large_cells``) is cut into ``nb`` hash blocks, and
    each pair of its blocks is one group, multiplied in numpy: no cell, however large, meets in one task. A row moves once for each
    block of its cell, so once if the cell is one block."""
    by = list(cell)
    nb = F.coalesce(F.col("nb"), F.lit(1).cast("long"))
    blocked = base.join(F.broadcast(large), by, "left").withColumn("nb", nb).withColumn("b", F.pmod(hash60(F.col("id")), F.col("nb")))
    # The block is the first of the pairs (b, j >= b) and the second of the pairs (i < b, b).
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("o")
    sent = blocked.select(*by, "b", "id", "v", other).select(
        *by, F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "id", "v", (F.col("o") < F.col("b")).alias("second"))
    kinds = [base.schema[c].dataType for c in ("grp", "id", "id")] + [T.DoubleType()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(("grp", "vec_id", "neighbor_id", "sim"), kinds)])
    return sent.groupBy(*by, "bi", "bj").applyInArrow(_pair_topk(k, to_arrow_schema(schema)), schema)


def _large_cells(ids: DataFrame, cell: Sequence[str], block_rows: int) -> DataFrame:
    """The cells of more than ``block_rows`` rows and the number of their blocks: at most one row for every ``block_rows`` of ``ids``."""
    sizes = ids.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    return sizes.select(*cell, F.ceil(F.col("n") / F.lit(block_rows)).cast("long").alias("nb"))


def _ranked(candidates: DataFrame, group: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy("grp", "vec_id").orderBy(F.col("sim").desc(), F.col("neighbor_id"))
    ranked = candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("grp").alias(group), F.col("vec_id").alias(key), "rank", "neighbor_id", "sim")


def cosine_knn(df: DataFrame, vec: str = "scaled", group: str = "label", key: str = "vec_id", k: int = 15,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For every vector its k most cosine-similar other vectors of the same group: ``(group, key, rank,
    neighbor_id, sim)``, ties broken by the smaller neighbour id."""
    base = _unit_rows(df, vec, group, key)
    return _ranked(_cell_candidates(base, ["grp"], k, _large_cells(base, ["grp"], block_rows)), group, key, k)


def hyperplane(table: int, bit: int, dim: int, seed: int) -> np.ndarray:
    """The normal of one random hyperplane: Gaussian, the same wherever it is drawn."""
    return np.random.default_rng([seed, table, bit, dim]).standard_normal(dim)


def _bucket_codes(tables: int, probes: int, seed: int):
    """From (grp, bits, id, v) each row with its buckets: (grp, id, v, cells), a ``table`` and ``code`` for each table and probed bucket. A vector's
    own bucket has the signs of ``bits`` hyperplanes; its further ones have the least certain signs turned, one at a time."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict = {}
        for pdf in it:
            dims = pdf["v"].map(len).to_numpy()
            for (bits, dim), rows in pdf.groupby([pdf["bits"].to_numpy(), dims]):
                x = np.vstack(rows["v"].to_numpy()).astype(np.float64)
                numbers, codes = [], []
                for t in range(tables if bits else 1):
                    if (t, bits, dim) not in planes:
                        planes[t, bits, dim] = np.array([hyperplane(t, i, dim, seed) for i in range(bits)]).reshape(bits, dim)
                    side = x @ planes[t, bits, dim].T
                    own = (side > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), np.int64)
                    unsure = np.argsort(np.abs(side), axis=1, kind="stable")[:, :probes]
                    for code in [own, *(own ^ (1 << unsure[:, p]) for p in range(unsure.shape[1]))]:
                        numbers.append(t)
                        codes.append(code.astype(np.int64))
                tables_of = np.array(numbers, dtype=np.int32)
                yield pd.DataFrame({"grp": rows["grp"], "id": rows["id"], "v": rows["v"], "tables": [tables_of] * len(rows), "codes": list(np.stack(codes, axis=1))})

    return run


def cosine_knn_lsh(df: DataFrame, vec: str = "scaled", group: str = "label", key: str = "vec_id", k: int = 15,
                   bucket_rows: int = 1024, tables: int = 8, probes: int = 3, seed: int = 0) -> DataFrame:
    """E3 for groups too large for all pairs: the output of ``cosine_knn``, neighbours sought in random-hyperplane buckets only.

    A group of n vectors gets log2(n / bucket_rows) hyperplanes per table, so that buckets hold about ``bucket_rows`` whatever n is, and each
    vector lies in 1 + ``probes`` buckets of each of ``tables`` tables: the work is n * bucket_rows * tables * (1 + probes)^2 similarities instead
    of n^2. A bucket that is larger (many vectors on one spot) is cut into blocks like a group of ``cosine_knn``, so no task holds
    it whole. Similarities of all candidates are exact; a neighbour that shares no bucket is missed, so rows of few or no
    candidates may come short of ``k``. More tables and probes find more. A group of at most ``bucket_rows`` vectors is one bucket, and exact."""
    base = _unit_rows(df, vec, group, key)
    sizes = base.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(bucket_rows)))).cast("int")
    rows = base.join(sizes.select("grp", bits.alias("bits")), "grp").select("grp", "bits", "id", "v")
    schema = T.StructType([
        *[T.StructField(c, base.schema[c].dataType) for c in ("grp", "id")], T.StructField("v", T.ArrayType(T.DoubleType())),
        T.StructField("tables", T.ArrayType(T.IntegerType())), T.StructField("codes", T.ArrayType(T.LongType())),
    ])
    placed = rows.mapInPandas(_bucket_codes(tables, probes, seed), schema)
    cell = ["grp", "table", "code"]
    cells = placed.select("grp", "id", "v", F.explode(F.arrays_zip(F.col("tables").alias("table"), F.col("codes").alias("code"))).alias("c"))
    cells = cells.select("grp", "c.table", "c.code", "id", "v")
    # Probing fills a bucket (1 + probes)-fold: blocks of twice that, so that the vectors of nearly all buckets move once.
    found = _cell_candidates(cells, cell, k, _large_cells(cells, cell, 2 * (1 + probes) * bucket_rows))
    # A pair may meet in several buckets. Dealt by the vector, its candidates move once for both steps.
    found = found.where(F.col("vec_id") != F.col("neighbor_id")).repartition("grp", "vec_id")
    found = found.groupBy("grp", "vec_id", "neighbor_id").agg(F.max("sim").alias("sim"))
    return _ranked(found, group, key, k)


# ------------------------------------------------------------------------------------------------ E4

def _partial_moments():
    """Per partition and group: count, sums and cross-products, flattened as (grp, index, value) rows. The
    dimension is read from the vectors themselves."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for pdf in it:
            for g, sub in pdf.groupby("grp"):
                x = np.vstack(sub["v"].to_numpy()).astype(np.float64)
                d = x.shape[1]
                n, s, xx = acc.get(g, (0, np.zeros(d), np.zeros((d, d))))
                acc[g] = (n + len(x), s + x.sum(axis=0), xx + x.T @ x)
        for g, (n, s, xx) in acc.items():
            vals = np.concatenate([[n], s, xx.ravel()])
            yield pd.DataFrame({"grp": g, "i": np.arange(len(vals), dtype=np.int32), "v": vals})

    return run


def _summed_moments(df: DataFrame, vec: str, group: str) -> DataFrame:
    """(grp, i, v): per group the count, sums and cross-products, from per-partition partials (groups x dim^2 numbers)."""
    base = df.where(F.col(vec).isNotNull()).select(F.col(group).alias("grp"), F.col(vec).alias("v"))
    grp = df.schema[group].dataType.simpleString()
    return base.mapInPandas(_partial_moments(), f"grp {grp}, i int, v double").groupBy("grp", "i").agg(F.sum("v").alias("v"))


def _covariance(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance of one group's moments."""
    vals = pdf.sort_values("i")["v"].to_numpy()
    dim = int(round((np.sqrt(4 * len(vals) - 3) - 1) / 2))  # len = 1 + dim + dim^2
    n, s, xx = vals[0], vals[1:1 + dim], vals[1 + dim:].reshape(dim, dim)
    mean = s / n
    return mean, (xx - n * np.outer(mean, mean)) / max(n - 1, 1)


def group_covariance(df: DataFrame, vec: str = "scaled", group: str = "label") -> DataFrame:
    """The input of E4: (group, i, j, cov) of every pair of dimensions i <= j, per group (sample covariance)."""
    def cells(pdf: pd.DataFrame) -> pd.DataFrame:
        _, cov = _covariance(pdf)
        i, j = np.triu_indices(len(cov))
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "i": i.astype(np.int32), "j": j.astype(np.int32), "cov": cov[i, j]})

    grp = df.schema[group].dataType.simpleString()
    out = _summed_moments(df, vec, group).groupBy("grp").applyInPandas(cells, f"grp {grp}, i int, j int, cov double")
    return out.withColumnRenamed("grp", group)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def principal_components(df: DataFrame, vec: str = "scaled", group: str = "label") -> DataFrame:
    """(group, mean, c1, c2): the mean and the two leading principal components of each group, from its summed moments: one dim x dim
    matrix per group, however many rows it has. Each component's largest loading is positive."""
    grp = df.schema[group].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, cov = _covariance(pdf)
        dim = len(mean)
        w, v = np.linalg.eigh(cov)
        comps = v[:, np.argsort(w)[::-1][:2]].T
        comps = comps * np.sign(comps[np.arange(len(comps)), np.abs(comps).argmax(axis=1)])[:, None]
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "mean": [mean.tolist()],
                             "c1": [comps[0].tolist()], "c2": [comps[1].tolist() if len(comps) > 1 else [0.0] * dim]})

    out = _summed_moments(df, vec, group).groupBy("grp").applyInPandas(solve, f"grp {grp}, mean array<double>, c1 array<double>, c2 array<double>")
    return out.withColumnRenamed("grp", group)


def project_2d(df: DataFrame, vec: str = "scaled", group: str = "label", key: str = "vec_id") -> DataFrame:
    """E4 (stands in for the single-machine layout step): per group, the projection of the centred vectors on the two leading principal
    components: (group, key, pc1, pc2). Moments are summed from per-partition partials (groups x dim^2 numbers), the 2 x dim
    components per group come from that small table and are joined back with the means."""
    base = df.where(F.col(vec).isNotNull()).select(
        F.col(group).alias("grp"), F.col(key).alias("__k"), F.col(vec).alias("v"))
    parts = principal_components(df, vec, group).withColumnRenamed(group, "grp")
    j = base.join(parts, "grp")
    centered = F.zip_with(F.col("v"), F.col("mean"), lambda x, m: x - m)
    return j.select(F.col("grp").alias(group), F.col("__k").alias(key), _dot(centered, F.col("c1")).alias("pc1"), _dot(centered, F.col("c2")).alias("pc2"))
