"""Removal of repeated lines by hashing.

A text's units are its lines. Each unit is normalised (A-Z lower-cased, runs of ASCII white space made one blank) and named by a
128-bit digest. Digests are grouped over all texts; the earliest unit of a digest, by doc_id and then by place in the text, stays and
all others are removed with their line feeds, their places in the original text kept. Runs of neighbouring lines that all stand elsewhere in the table
are passages if they have over 20 words together: what they cover is counted apart from single short lines, in the earliest text too, from which it is not
removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyscope.llm.common import row_key, save, text_bytes


#: Neighbouring repeated lines of more words than this are a passage: one of over 50 words that begins and ends inside of lines still has so
#: many in whole lines.
PASSAGE_WORDS = 20


def units(text: bytes, min_bytes: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, stop, normalised) of each line of at least ``min_bytes`` normalised bytes; stop is behind the line feed."""
    at = 0
    for line in text.split(b"\n"):
        stop = min(at + len(line) + 1, len(text))
        norm = b" ".join(line.lower().split())
        if len(norm) >= min_bytes:
            yield at, stop, norm
        at = stop


def unit_table(docs: DataFrame, min_bytes: int) -> DataFrame:
    """(h1, h2, doc_id, k, p, size, words): every unit's digest and place; ``p`` holds k2 and the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, digest, start, size, words = [], [], [], [], []
            for i, t in enumerate(b.column(3)):
                for lo, hi, norm in units(t.as_py(), min_bytes):
                    row.append(i)
                    digest.append(xxhash.xxh3_128_digest(norm))
                    start.append(lo)
                    size.append(hi - lo)
                    words.append(norm.count(b" ") + 1)
            h = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            at = pa.array(row, pa.int32())
            p = b.column(2).take(at).to_numpy().astype(np.int64) << 32 | np.array(start, np.int64)
            cols = [pa.array(h[:, 0]), pa.array(h[:, 1]), b.column(0).take(at), b.column(1).take(at), pa.array(p), pa.array(size, pa.int32()), pa.array(words, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["h1", "h2", "doc_id", "k", "p", "size", "words"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc_id long, k long, p long, size int, words int")


def remove_lines(docs: DataFrame, min_bytes: int = 1) -> DataFrame:
    """Remove the lines of ``docs`` (doc_id, text, any further columns) that an earlier line of the table equals when normalised.

    One row per row: doc_id, k, k2 (the row's key, see ``row_key``), n_bytes, n_units, removed (array of (start, stop) in bytes of
    the input, ascending), kept (the rest, binary), shared_passages (bytes of its runs of neighbouring lines that all stand elsewhere in the
    table too, removed or not, with over PASSAGE_WORDS words together) and removed_passages (those of them that are removed). Lines of fewer than ``min_bytes`` normalised bytes stay: with
    1 only empty ones. Null ids rank last. Rows with one id rank by place in the text and then by key; rows equal in id and text
    count as one text, so they keep the same. Null texts count as empty."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(F.col("doc_id"), F.col("text")), text_bytes().alias("t"))
    u = save(unit_table(src, min_bytes))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col("p").bitwiseAND(F.lit((1 << 32) - 1)).alias("start"), "k", "p")
    keep = u.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("one")).where("n > 1")
    keep = save(keep.select("h1", "h2", F.col("one.k").alias("k_"), F.col("one.p").alias("p_")))
    gone = F.col("k") != F.col("k_")
    shared = u.join(keep, ["h1", "h2"]).withColumn("gone", gone | (F.col("p") != F.col("p_")))
    start = F.col("p").bitwiseAND(F.lit((1 << 32) - 1))
    # A set: a place counts once in its text, also where rows repeat.
    unit = F.struct(start.alias("start"), (start + F.col("size")).alias("stop"), "words", "gone")
    by = shared.groupBy("k", F.shiftright("p", 32).cast("int").alias("k2")).agg(F.array_sort(F.collect_set(unit)).alias("units"))

    def counted(at: Column) -> list[Column]:
        """The totals with the run that ends at ``at`` counted, if it is a passage."""
        passage = at["words"] > PASSAGE_WORDS
        return [F.when(passage, at[t] + at[n]).otherwise(at[t]).alias(t) for t, n in (("shared", "bytes"), ("removed", "gone"))]

    def step(at: Column, x: Column) -> Column:
        size = x["stop"] - x["start"]
        gone = F.when(x["gone"], size).otherwise(F.lit(0).cast("long"))
        longer = [x["stop"].alias("stop"), (at["words"] + x["words"]).alias("words"), (at["bytes"] + size).alias("bytes"), (at["gone"] + gone).alias("gone")]
        new = [x["stop"].alias("stop"), x["words"].cast("long").alias("words"), size.alias("bytes"), gone.alias("gone")]
        return F.when(x["start"] == at["stop"], F.struct(*longer, at["shared"].alias("shared"), at["removed"].alias("removed"))).otherwise(F.struct(*new, *counted(at)))

    none = F.struct(F.lit(-1).cast("long").alias("stop"), *[F.lit(0).cast("long").alias(n) for n in ("words", "bytes", "gone", "shared", "removed")])
    totals = F.aggregate("units", none, step, lambda at: F.struct(*counted(at)))
    spans = by.select(
        "k", "k2", F.transform(F.filter("units", lambda x: x["gone"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))).alias("spans"),
        totals["shared"].alias("shared_passages"), totals["removed"].alias("removed_passages"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_units, kept = [], []
            for t, spans in zip(b.column("t"), b.column("removed"), strict=True):
                t = t.as_py()
                edges = [0, *(x for s in spans for x in (s["start"].as_py(), s["stop"].as_py())), len(t)]
                kept.append(b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                n_units.append(t.count(b"\n") + 1 if t else 0)
            size = pa.array([len(t.as_py()) for t in b.column("t")], pa.int64())
            cols = [*(b.column(c) for c in ("doc_id", "k", "k2")), size, pa.array(n_units, pa.int64()), b.column("removed"), pa.array(kept, pa.binary())]
            cols += [b.column("shared_passages"), b.column("removed_passages")]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "k", "k2", "n_bytes", "n_units", "removed", "kept", "shared_passages", "removed_passages"])

    empty = F.array().cast("array<struct<start:long,stop:long>>")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("shared_passages", "removed_passages")]
    joined = src.join(spans, ["k", "k2"], "left").select("doc_id", "k", "k2", "t", F.coalesce("spans", empty).alias("removed"), *counts)
    out = "doc_id long, k long, k2 int, n_bytes long, n_units long, removed array<struct<start:long,stop:long>>, kept binary"
    return joined.mapInArrow(run, f"{out}, shared_passages long, removed_passages long")


def digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_units, n_removed (bytes), n_spans, removed ([start, stop] pairs), kept_sha256, shared_passages and removed_passages of
    ``remove_lines``."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, r: acc + r["stop"] - r["start"])
    spans = F.size("removed").cast("long").alias("n_spans")
    pairs = F.transform("removed", lambda r: F.array(r["start"], r["stop"])).alias("removed")
    return removed.select("doc_id", "n_bytes", "n_units", gone.alias("n_removed"), spans, pairs, F.sha2("kept", 256).alias("kept_sha256"), "shared_passages", "removed_passages")
