"""Removal of byte strings that occur more than once, by bucket-pointer refinement of suffix buckets.

A suffix's bucket identifier at depth 1 is a fixed number for its byte. The bucket at depth 2h is named by the pair of
identifiers at depth h of the suffix itself and of the suffix h bytes later, so every refinement reuses the
identifiers that the one before it updated, for all suffixes of a text at once. Because an identifier is a
64-bit hash of the pair, equal strings get equal identifiers in any document and on any worker, and sorting on
identifiers needs no shuffle until the depth is worth one. Three global refinements follow, each over the blocks of
neighbouring suffixes that the one before could not settle:

1. Every start of a ``length``-byte string belongs to the leftmost smallest 16-byte bucket among the ``spread`` positions from
   it; the consecutive starts of one such minimizer are a block.
2. Blocks of at most ``step`` starts, cut at fixed distances from the minimizer.
3. Single starts.

A block's bucket is the identifier of the bytes that all its strings hold. A bucket with one block is left out: nothing
in it repeats. Blocks of one bucket with the same identifier for all of their bytes repeat entirely. Buckets that hold different
blocks go on to the next refinement, each different block once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyscope.llm.common import groups, keyed, save, save_by_key, text_bytes

GRAM = 16
SEGMENT = 1 << 18
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of the bucket of pairs (a, b)."""
    x = a * _M1
    x += b
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def refine(data: np.ndarray, depths: set[int]) -> dict[int, np.ndarray]:
    """Bucket identifiers of every suffix of ``data`` (uint8) at the given depths (powers of two), where it is that long."""
    ids, h, out = _BYTE[data], 1, {}
    top = max(depths)
    while True:
        if h in depths:
            out[h] = ids
        if h >= top or len(ids) <= h:
            break
        ids = pair(ids[:-h], ids[h:])
        h *= 2
    return {d: out.get(d, np.zeros(0, np.uint64)) for d in depths}


def powers(depth: int) -> list[int]:
    return [1 << i for i in reversed(range(depth.bit_length())) if depth >> i & 1]


def at_depth(ids: dict[int, np.ndarray], depth: int, at: np.ndarray) -> np.ndarray:
    """Identifiers at any depth of the suffixes ``at``, from those at its powers of two."""
    out, done = None, 0
    for p in powers(depth):
        part = ids[p][at + done]
        out = part if out is None else pair(out, part)
        done += p
    return out


def segments(texts: Iterator[tuple[int, bytes]], length: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Texts joined to arrays of about SEGMENT bytes, each with (row, offset in the array, offset in the text, number of
    starts); a longer text is cut into segments that overlap by ``length - 1`` bytes, so each start lies in one."""
    parts, where, size = [], [], 0
    for row, t in texts:
        starts = len(t) - length + 1
        for lo in range(0, max(starts, 0), SEGMENT):
            n = min(SEGMENT, starts - lo)
            parts.append(t[lo : lo + n + length - 1])
            where.append((row, size, lo, n))
            size += n + length - 1
            if size >= SEGMENT:
                yield np.frombuffer(b"".join(parts), np.uint8), where
                parts, where, size = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), where


def blocks(data: np.ndarray, where: list[tuple[int, int, int, int]], length: int, spread: int) -> tuple[np.ndarray, ...]:
    """Blocks of one segment array: index into ``where``, first start, shape, bucket, identifier of the whole block."""
    behind = length - spread + 1
    ids = refine(data, {GRAM, *powers(behind), *powers(length)})
    n = len(data) - length + 1
    bits = np.uint64(max(len(data).bit_length(), 1))
    low = (ids[GRAM] >> bits << bits) | np.arange(len(ids[GRAM]), dtype=np.uint64)
    window, h = low, 1
    while 2 * h <= spread:
        window = np.minimum(window[:-h], window[h:])
        h *= 2
    if h < spread:
        window = np.minimum(window[: len(window) - (spread - h)], window[spread - h :])
    least = (window[:n] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)
    offset = np.array([w[1] for w in where])
    count = np.array([w[3] for w in where])
    np.add.at(valid, offset, 1)
    np.add.at(valid, offset + count, -1)
    inside = np.cumsum(valid[:n]) > 0
    new = np.ones(n, bool)
    new[1:] = least[1:] != least[:-1]
    new[offset] = True
    first = np.flatnonzero(new & inside)
    edge = np.flatnonzero(new | ~inside)
    nxt = np.append(edge, n)[np.searchsorted(edge, first, "right")]
    size = nxt - first
    bucket = at_depth(ids, behind, least[first])
    whole = pair(pair(at_depth(ids, length, first), at_depth(ids, length, nxt - 1)), size.astype(np.uint64))
    return np.searchsorted(offset, first, "right") - 1, first, (least[first] - first) << 16 | size, bucket, whole


def _pack(k2: np.ndarray, start: np.ndarray) -> np.ndarray:
    return (k2.astype(np.int64) << 32) | start


NAMES = ["bucket", "whole", "k", "p", "shape"]
TABLE = "bucket long, whole long, k long, p long, shape int"


def regions(spans: pa.ListArray, length: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's spans of repeated starts of ``length``-byte strings the maximal runs of bytes that they cover, those of at least ``least`` bytes:
    (row and start in one number, stop), ascending."""
    at, flat = spans.offsets.to_numpy(), spans.flatten()
    start, n = flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy()
    keys, stops = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(spans)):
        lo, hi = at[i] - at[0], at[i + 1] - at[0]
        if hi > lo:
            a, b = merged(start[lo:hi], start[lo:hi] + n[lo:hi] + length - 1)
            wide = b - a >= least
            keys.append((i << 32) + a[wide])
            stops.append(b[wide])
    return np.concatenate(keys), np.concatenate(stops)


def block_table(docs: DataFrame, length: int, spread: int, shorter: int | None = None) -> DataFrame:
    """The blocks of ``docs`` (k, k2, t): bucket, whole, k, ``p`` (k2 and the first start) and ``shape`` (the minimizer's distance
    from the first start, and the number of starts). With ``shorter``, ``docs`` also has the ``spans`` of repeated strings of that length: what repeats
    lies inside of what they cover, so blocks without a start there are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            texts = ((i, t.as_py()) for i, t in enumerate(b.column(2)))
            key, stop = regions(b.column(3), shorter, length) if shorter else (None, None)
            for data, where in segments(texts, length):
                w, first, shape, bucket, whole = blocks(data, where, length, spread)
                row, offset, lo = (np.array(x)[w] for x in list(zip(*where, strict=True))[:3])
                if shorter:
                    # The last region that starts before the block's last start is the one to look at: it reaches farthest.
                    own = (row.astype(np.int64) << 32) + first - offset + lo
                    last = own + (shape & 0xFFFF) - 1
                    i = np.searchsorted(key, last, "right") - 1
                    keep = np.flatnonzero(i >= 0)
                    i, own = i[keep], own[keep]
                    keep = keep[(key[i] >> 32 == own >> 32) & (np.maximum(key[i], own) & 0xFFFFFFFF <= stop[i] - length)]
                    first, shape, bucket, whole, row, offset, lo = (x[keep] for x in (first, shape, bucket, whole, row, offset, lo))
                cols = [bucket.view(np.int64), whole.view(np.int64), k[row], _pack(k2[row], first - offset + lo), shape.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], NAMES)

    return docs.mapInArrow(run, TABLE)


def finer(text: np.ndarray, bucket: np.ndarray, start: np.ndarray, shape: np.ndarray, length: int, step: int) -> tuple[np.ndarray, ...]:
    """Blocks of at most ``step`` starts that make up the given blocks of one text: bucket, whole, first start, shape."""
    gap, size = shape >> 16, (shape & 0xFFFF).astype(np.int64)
    lo = int(start.min())
    ids = refine(text[lo : int((start + size).max()) + length - 1], {*powers(length - step + 1), *powers(length)})
    of = np.repeat(np.arange(len(start)), size)
    each = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
    left = start[of] + gap[of] - each  # distance to the minimizer
    part = left // step
    edge = groups([of, part])
    first, last = edge[:-1], edge[1:] - 1
    common = at_depth(ids, length - step + 1, each[first] + left[first] - part[first] * step - lo)
    own = pair(pair(bucket[of[first]].view(np.uint64), part[first].astype(np.uint64)), common)
    n = last - first + 1
    whole = pair(pair(at_depth(ids, length, each[first] - lo), at_depth(ids, length, each[last] - lo)), n.astype(np.uint64))
    return own, whole, each[first], left[first] << 16 | n


def finer_table(docs: DataFrame, wanted: DataFrame, length: int, step: int) -> DataFrame:
    """The finer blocks of the blocks ``wanted`` (k, k2, blocks: array of bucket, start, shape) of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            at, flat = lists.offsets.to_numpy(), lists.flatten()
            bucket, start, shape = (flat.field(f).to_numpy() for f in ("bucket", "start", "shape"))
            for i in range(batch.num_rows):
                text = np.frombuffer(batch.column(2)[i].as_py(), np.uint8)
                own = np.arange(at[i] - at[0], at[i + 1] - at[0])
                own = own[np.argsort(start[own], kind="stable")]
                while len(own):  # a stretch of a long text at a time
                    here = np.searchsorted(start[own], int(start[own[0]]) + SEGMENT)
                    now, own = own[:here], own[here:]
                    b, w, first, new = finer(text, bucket[now], start[now].astype(np.int64), shape[now], length, step)
                    cols = [b.view(np.int64), w.view(np.int64), np.full(len(b), k[i]), _pack(np.full(len(b), k2[i]), first), new.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], NAMES)

    return docs.join(wanted, ["k", "k2"]).select("k", "k2", "t", "blocks").mapInArrow(run, TABLE)


def split_p() -> list:
    return [F.shiftright("p", 32).cast("int").alias("k2"), F.col("p").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("start")]


def settle(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of saved blocks: those that repeat entirely (k, p, shape), and for the next refinement one of each different
    block in buckets that hold several (k, k2, blocks)."""
    shared = (
        a.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi"))
        .where("n > 1")
        .select("bucket", (F.col("lo") != F.col("hi")).alias("mixed"))
    )
    # Aggregates are saved before they are joined: a join of two plain shuffles can be split at a hot bucket.
    b = save(a.join(save(shared), "bucket"))
    mixed = b.where("mixed")
    whole = save(mixed.groupBy("bucket", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "p", "shape")).alias("one")))
    equal = mixed.join(whole.where("n > 1"), ["bucket", "whole"], "left_semi")
    done = b.where("not mixed").select("k", "p", "shape").unionByName(equal.select("k", "p", "shape"))
    rest = whole.select("bucket", "one.*").select("bucket", "k", "shape", *split_p())
    return done, rest.groupBy("k", "k2").agg(F.collect_list(F.struct("bucket", "start", "shape")).alias("blocks"))


def repeated_spans(docs: DataFrame, length: int, spread: int, step: int, shorter: int | None = None) -> DataFrame:
    """(k, k2, spans: array of (start, n)): runs of starts in ``docs`` (k, k2, t binary; ``spans`` too with ``shorter``, see ``block_table``) whose
    ``length`` bytes also start elsewhere; runs may touch. Rows equal in key share one list, in which each run stands once."""
    done, rest = settle(save(block_table(docs, length, spread, shorter)))
    for s in (step, 1):
        more, rest = settle(save(finer_table(docs.select("k", "k2", "t"), rest, length, s)))
        done = done.unionByName(more)
    size = F.col("shape").bitwiseAND(F.lit(0xFFFF))
    return done.select("k", *split_p(), size.alias("n")).groupBy("k", "k2").agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the intervals."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def remove_repeats(
    docs: DataFrame, length: int = 400, spread: int = 257, step: int = 16, as_text: bool = False, shorter: int | None = None, shorter_spread: int = 129
) -> DataFrame:
    """Remove from each text (as UTF-8 bytes; null: empty) every byte covered by a ``length``-byte string that also starts
    anywhere else in the table, the same text included.

    One row per row of ``docs`` (doc_id, text, any further columns): ``doc`` (the row as a struct), ``n_bytes``, ``removed`` (array of
    (start, stop), the maximal removed runs in offsets of the input) and ``kept`` (the rest, binary; ``as_text``: decoded, without
    characters of which only a part is left). Repeated rows count as
    occurrences of each other, so both lose what they share; rows that share only an id, or have none, are texts of their own. Texts
    shorter than ``length`` are kept whole. An empty table gives no row.

    With ``shorter``, a smaller length, the bytes that repeated strings of that length cover are counted too, as ``n_shorter`` (else null); only what
    they cover is then searched for the longer ones."""
    rows = keyed(docs).withColumn("t", text_bytes("doc.text")).withColumn("doc", F.col("doc").dropFields("text"))
    # Rows equal in id and text are one text until the end, so that no key of a join or bucket has more than one text.
    often = save(rows.groupBy("k", "k2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    copies = rows.join(often, ["k", "k2"]).groupBy("k", "k2").agg(F.any_value("t").alias("t"), F.max("copies").alias("copies"))
    texts = rows.join(often, ["k", "k2"], "left_anti").withColumn("copies", F.lit(1).cast("long"))
    src = save_by_key(texts.unionByName(copies, allowMissingColumns=True), ["k", "k2"])
    texts = src.select("k", "k2", "t")
    if shorter:
        near = save(repeated_spans(texts, shorter, shorter_spread, step))
        spans = repeated_spans(texts.join(near, ["k", "k2"]).select("k", "k2", "t", "spans"), length, spread, step, shorter)
        spans = spans.join(near.withColumnRenamed("spans", "near"), ["k", "k2"], "right")
    else:
        spans = repeated_spans(texts, length, spread, step).withColumn("near", F.lit(None).cast("array<struct<start:int,n:int>>"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept, n_bytes = [], [], []
            lists, copies = batch.column("spans"), batch.column("copies").to_numpy()
            at, flat = lists.offsets.to_numpy(), lists.flatten()
            start, n = flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy()
            covered = np.zeros(batch.num_rows, np.int64)
            if shorter:
                key, stop = regions(batch.column("near"), shorter, 0)
                np.add.at(covered, key >> 32, stop - (key & 0xFFFFFFFF))
            for i, t in enumerate(batch.column("t")):
                t = t.as_py()
                if shorter and copies[i] > 1 and len(t) >= shorter:
                    covered[i] = len(t)
                lo, hi = at[i] - at[0], at[i + 1] - at[0]
                n_bytes.append(len(t))
                if copies[i] > 1 and len(t) >= length:
                    removed.append([{"start": 0, "stop": len(t)}])
                    kept.append(b"")
                    continue
                if hi == lo:
                    removed.append([])
                    kept.append(t)
                    continue
                a, b = merged(start[lo:hi], start[lo:hi] + n[lo:hi] + length - 1)
                removed.append([{"start": int(x), "stop": int(y)} for x, y in zip(a, b, strict=True)])
                kept.append(b"".join(t[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(t)], strict=True)))
            rest = pa.array([t.decode("utf-8", "ignore") for t in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            cols = [*(batch.column(c) for c in ("k", "k2", "doc")), pa.array(n_bytes, pa.int64()), pa.array(removed, kind), rest]
            cols.append(pa.array(covered) if shorter else pa.nulls(batch.num_rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, ["k", "k2", "doc", "n_bytes", "removed", "kept", "n_shorter"])

    empty = F.array().cast("array<struct<start:int,n:int>>")
    spans = save(spans)
    out = f"k long, k2 int, doc {src.schema['doc'].dataType.simpleString()}, n_bytes long, removed array<struct<start:long,stop:long>>"

    def cleaned(part: DataFrame) -> DataFrame:
        lists = [F.coalesce(c, empty).alias(c) for c in ("spans", "near")]
        joined = part.join(spans, ["k", "k2"], "left").select("k", "k2", "doc", "t", "copies", *lists)
        return joined.mapInArrow(run, f"{out}, kept {'string' if as_text else 'binary'}, n_shorter long")

    result = ["doc", "n_bytes", "removed", "kept", "n_shorter"]
    again = save(cleaned(src.where("copies > 1")).drop("doc")).join(rows.join(often, ["k", "k2"], "left_semi").select("k", "k2", "doc"), ["k", "k2"])
    return cleaned(src.where("copies = 1")).select(result).unionByName(again.select(result))


def digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_shorter of ``remove_repeats``."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, r: acc + r["stop"] - r["start"])
    spans = F.size("removed").cast("long").alias("n_spans")
    return removed.select("doc.doc_id", "n_bytes", gone.alias("n_removed"), spans, F.sha2("kept", 256).alias("kept_sha256"), "n_shorter")


def clean_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the texts that ``remove_repeats`` leaves, and n_chars, if there is one, to match. A character cut by a removed run
    goes with it; null texts become empty."""
    new = remove_repeats(docs, as_text=True, **options).select("doc", F.col("kept").alias("text"))
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    cols = {"text": F.col("text"), "n_chars": n_chars}
    return new.select(*[(cols[c] if c in cols else F.col("doc").getField(c)).alias(c) for c in docs.columns])
