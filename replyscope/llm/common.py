"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. A local session without one gets a temporary folder; any other
    master must name a folder that all executors share."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="llm-shared-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder under the shared one that nothing else uses; not made yet."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and read it back: lineage ends there, and a lost
    executor only costs its own unfinished tasks."""
    path = f"{shared_dir(df.sparkSession)}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Like ``save``, in buckets by ``keys``: later joins on exactly these keys only shuffle their other side."""
    spark = df.sparkSession
    name = f"llm_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", f"{shared_dir(spark)}/llm/{name}")
    by.option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Key of a row as (``k`` long, ``k2`` int): rows that agree in id and text share it and get the same result, rows
    that share only the id (or have none) stay apart."""
    return [F.xxhash64(doc_id, text).alias("k"), F.hash(text, doc_id).alias("k2")]


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as (doc, k, k2): all columns in one struct, so that none clashes with those added."""
    return docs.select(F.struct("*").alias("doc"), *row_key(F.col("doc_id"), F.col("text")))


def text_bytes(text: str | Column = "text") -> Column:
    """Text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def groups(keys: list[np.ndarray]) -> np.ndarray:
    """Start offsets of runs of equal key tuples, with the end appended."""
    n = len(keys[0])
    change = np.zeros(max(n - 1, 0), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]]) if n else np.zeros(1, np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by ``keys`` make tables that end at the end of a group, each with its group offsets."""
    held: list[pa.RecordBatch] = []

    def out(part: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(part).combine_chunks()
        return t, groups([t.column(k).to_numpy() for k in keys])

    for b in batches:
        if not b.num_rows:
            continue
        last = groups([b.column(k).to_numpy(zero_copy_only=False) for k in keys])[-2]
        if last == 0 and held and all(held[-1].column(k)[-1] == b.column(k)[0] for k in keys):
            held.append(b)
            continue
        head = b.slice(0, last)
        rest = b.slice(last)
        if held and last and all(held[-1].column(k)[-1] == b.column(k)[0] for k in keys):
            yield out([*held, head])
        else:
            if held:
                yield out(held)
            if last:
                yield out([head])
        held = [rest]
    if held:
        yield out(held)


def spanning_labels(n: int, near) -> np.ndarray:
    """Component label (smallest member index) of ``n`` items; ``near(i, others)`` is the mask of those of ``others``
    linked to ``i``. Each item is expanded once against the items not yet reached."""
    label = np.full(n, -1, np.int64)
    rest = np.arange(n)
    while len(rest):
        root, rest = rest[0], rest[1:]
        label[root] = root
        queue = [root]
        while queue and len(rest):
            hit = near(queue.pop(), rest)
            if hit.any():
                found = rest[hit]
                label[found] = root
                queue.extend(found.tolist())
                rest = rest[~hit]
    return label
