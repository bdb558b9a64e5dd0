"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint bit is set if it is set in more than half of the document's shingle hashes. Fingerprints are linked at
``radius`` or fewer differing bits. Every bit position is given a nonzero vector of ``radius + 1`` bits; table ``v``
(one for each nonzero ``v``) keeps the bits whose vector has an odd product with ``v``. Any ``radius`` positions span too few
dimensions to rule out every ``v``, so some table keeps none of the differing bits: every pair within the radius collides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replyscope.llm.common import keyed, row_key, save, spanning_labels, text_bytes, whole_groups
from replyscope.llm.components import connected_components

BITS = 64


def covering_masks(radius: int, bits: list[int] | range = range(BITS)) -> list[int]:
    """The masks of the covering family over the given bit positions."""
    size = (1 << (radius + 1)) - 1
    vector = {b: i % size + 1 for i, b in enumerate(bits)}
    return [sum(1 << b for b, m in vector.items() if (m & v).bit_count() & 1) for v in range(1, size + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, words: int = 3) -> int:
    """Fingerprint of one text: A-Z lower-cased, words parted at ASCII white space, shingles of ``words`` words (the
    whole sequence if shorter), XXH64 with seed 42. No word: 0."""
    w = text.lower().split()
    if not w:
        return 0
    whole = b" ".join(w)
    if len(w) <= words:
        spans = [whole]
    else:
        size = np.fromiter(map(len, w), np.int64, len(w)) + 1
        end = np.cumsum(size)
        spans = [whole[a:b] for a, b in zip((end - size)[: 1 - words or None].tolist(), (end - 1)[words - 1 :].tolist(), strict=True)]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(s, 42) for s in spans], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id long, k, k2, fp long) of every row of ``docs``; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(3).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fp)], ["doc_id", "k", "k2", "fp"])

    keys = row_key(F.col("doc_id"), F.col("text"))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, text_bytes().alias("t"))
    return src.mapInArrow(run, "doc_id long, k long, k2 int, fp long")


def link_fingerprints(fps: DataFrame, radius: int = 3, hot: int = 1024) -> DataFrame:
    """(a, b) edges that join every two of the distinct longs ``fps.fp`` within ``radius`` bits, through a spanning forest
    of each bucket. Buckets of more than ``hot`` fingerprints are dealt again by a covering family over the bits that
    their mask leaves out, so no bucket holds more fingerprints than those bits have values left."""
    masks = covering_masks(radius)
    again = [covering_masks(radius, [b for b in range(BITS) if not m >> b & 1]) for m in masks]
    first = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(first).alias("r")).select("fp", "r.t", "r.key")
    big = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    rows = rows.join(big, ["t", "key"], "left")
    finer = F.lit(None)
    for t, m2 in enumerate(again):
        sub = F.array(*[F.struct(F.lit(s).alias("s"), F.col("fp").bitwiseAND(F.lit(signed(x))).alias("key2")) for s, x in enumerate(m2)])
        finer = F.when(F.col("t") == t, sub).otherwise(finer)
    plain = F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).cast("long").alias("key2")))
    rows = rows.select("fp", "t", "key", F.explode(F.when(F.col("n").isNull(), plain).otherwise(finer)).alias("r")).select("t", "key", "r.s", "r.key2", "fp")
    keys = ["t", "key", "s", "key2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, keys):
            fp = table.column("fp").to_numpy().view(np.uint64)
            a, b = [], []
            for g in np.flatnonzero(np.diff(at) > 1):
                own = fp[at[g] : at[g + 1]]
                label = spanning_labels(len(own), lambda i, rest, own=own: np.bitwise_count(own[rest] ^ own[i]) <= radius)
                far = np.flatnonzero(label != np.arange(len(own)))
                a.append(own[far])
                b.append(own[label[far]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, any further columns): doc_id, fingerprint (16 hex digits), component_id, and
    the row's key (k, k2; see ``row_key``) and component by its smallest fingerprint (root).

    Equal fingerprints form one class first, so copies are never paired. Null and empty texts have fingerprint zero and
    are linked like any others. Rows that share a doc_id are fingerprinted one by one; a null doc_id is never the
    smallest id of a component unless it has no other (then component_id is null). An empty table gives no row."""
    fps = save(fingerprints(docs, words))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = connected_components(link_fingerprints(classes.select("fp"), radius))
    c = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = c.groupBy("root").agg(F.min("low").alias("component_id"))
    named = c.join(low, "root").select("fp", "component_id", "root")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fps.join(named, "fp").select("doc_id", hexed, "component_id", "k", "k2", "root")


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (null ids last), then the smallest key; of rows equal in id
    and text one stays."""
    parts = simhash_components(docs, words, radius)
    first = parts.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k", "k2")).alias("one"))
    copy = W.partitionBy("k", "k2").orderBy(F.lit(0))
    kept = keyed(docs).join(first.select("one.k", "one.k2"), ["k", "k2"]).withColumn("i", F.row_number().over(copy))
    return kept.where("i = 1").select("doc.*")
