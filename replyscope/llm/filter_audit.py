"""Interaction of filters, audited over every order of them by wide packed counters.

A row fails some of the filters; which ones is its mask. For each mask one big integer is built whose 64-bit fields hold the outcome (0 or 1)
of every step of every order: with five filters 600 steps. A row's integer is added to its part's, so that one addition counts all steps;
tasks add up their rows, the tasks' integers are added in two rounds, and the fields are unpacked at the end. A field
counts rows, whose number stays below 2**63, so no field runs over into the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyscope.llm.common import save

WORD = r"([^\x20\x09-\x0D]+)"
#: What a step counts, in the order of its fields.
OUTCOMES = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
FIELD_BYTES = 8
#: Parts whose integers a task holds at once, and groups that the first round of additions deals a part's integers to.
PARTS_HELD, SALTS = 256, 64


def text_filters(text: Column) -> list[Column]:
    """The failure conditions A to D, which a text decides alone."""
    words, size = F.regexp_extract_all(text, F.lit(WORD), F.lit(1)), F.length(text)
    capitals = size - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        F.size(words) < 200,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        capitals * 100 > size * 3,
        text.rlike("[#$%&*|]"),
    ]


def _bits(conditions: list[Column], first: int) -> Column:
    bits = F.lit(0)
    for i, c in enumerate(conditions):
        bits = bits + F.when(c, F.lit(1 << (first + i))).otherwise(F.lit(0))
    return bits


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask) of each row of ``docs`` (doc_id, text, lang): bits 0 to 4 for the filters it fails, then one for quality 1, one for toxic 1.

    A null text counts as empty, a null lang as the part ''. A row without id fails E never and hides no other row; of rows with one id and one
    text none fails E by the others. A doc_id labelled more than once is good or toxic if any of its labels says so."""
    text = F.coalesce("text", F.lit(""))
    part, digest = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    rows = save(docs.select("doc_id", part, digest, _bits(text_filters(text), 0).alias("own")))
    # Saved before the joins, so that Spark can split a hot text or id there.
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first_id")
    good, toxic = (F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)) for c in ("quality", "toxic"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(_bits([good, toxic], 5).alias("marks")).where("marks > 0")
    joined = rows.join(save(first), "digest", "left").join(save(marks), F.col("doc_id") == F.col("label_id"), "left")
    later = F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))  # filter E
    return joined.select("part", (F.col("own") + _bits([later], 4) + F.coalesce("marks", F.lit(0))).cast("int").alias("mask"))


def packed(mask: int, letters: str) -> int:
    """The big integer of a mask: a field for each order, step and outcome, then a field for each filter that alone fails."""
    n = len(letters)
    fails = {x: mask >> i & 1 for i, x in enumerate(letters)}
    good, toxic = mask >> n & 1, mask >> (n + 1) & 1
    fields = []
    for order in permutations(letters):
        gone = 0
        for x in order:
            now = fails[x] and not gone
            redundant = fails[x] and gone
            gone = gone or fails[x]
            fields += [1 - gone, now, redundant, now and good, now and toxic]
    fields += [int(mask & ((1 << n) - 1) == 1 << i) for i in range(n)]
    return int.from_bytes(b"".join(int(f).to_bytes(FIELD_BYTES, "little") for f in fields), "little")


def part_sums(rows: DataFrame, letters: str) -> DataFrame:
    """(part, sum): each task's sums of its rows' integers, as bytes."""
    classes = 1 << (len(letters) + 2)
    width = FIELD_BYTES * (len(OUTCOMES) * len(letters) * len(list(permutations(letters))) + len(letters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        sums: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), pa.array([v.to_bytes(width, "little") for v in sums.values()], pa.binary())], ["part", "sum"])

        for b in batches:
            part = b.column("part").dictionary_encode()
            name = part.dictionary.to_pylist()
            code = part.indices.to_numpy().astype(np.int64) * classes + b.column("mask").to_numpy()
            for c, times in zip(*map(np.ndarray.tolist, np.unique(code, return_counts=True)), strict=True):
                mask = c % classes
                if mask not in known:
                    known[mask] = packed(mask, letters)
                p = name[c // classes]
                sums[p] = sums.get(p, 0) + times * known[mask]
                if len(sums) == PARTS_HELD:
                    yield out()
                    sums.clear()
        if sums:
            yield out()

    return rows.mapInArrow(run, "part string, sum binary")


def added(sums: DataFrame, keys: list[str]) -> DataFrame:
    """One row of (part, sum) for each value of ``keys``, its integers added one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, width = None, 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.string()), pa.array([total.to_bytes(width, "little")], pa.binary())], ["part", "sum"])

        for b in batches:
            for key, s in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), b.column("sum"), strict=True):
                if key != held and held is not None:
                    yield out()
                    total = 0
                held, s = key, s.as_py()
                total, width = total + int.from_bytes(s, "little"), len(s)
        if held is not None:
            yield out()

    return sums.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "part string, sum binary")


def unpacked(sums: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order and step, zeros included, from one integer a part."""
    orders = ["".join(o) for o in permutations(letters)]
    n, steps = len(letters), len(letters) * len(orders)
    at = np.array([[letters.index(x) for x in o] for o in orders]).ravel()
    names = [*OUTCOMES[:3], "unique_fails", *OUTCOMES[3:], "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, s in zip(b.column("part").to_pylist(), b.column("sum").to_pylist(), strict=True):
                fields = np.frombuffer(s, "<u8").astype(np.int64)
                by = dict(zip(OUTCOMES, fields[: -n].reshape(steps, len(OUTCOMES)).T, strict=True))
                by["unique_fails"] = fields[-n:][at]
                by["shapley"] = np.array([by["removed"][at == i].sum() for i in range(n)])[at]
                order, step = np.repeat(np.array(orders, object), n), np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))
                cols = [pa.array([p] * steps), pa.array(order), pa.array(step), *(pa.array(by[c]) for c in names)]
                yield pa.RecordBatch.from_arrays(cols, ["part", "filter_order", "step", *names])

    return sums.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names))


def filter_audit(rows: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """The steps of all orders of the filters ``letters`` over ``rows`` (part, mask), masks as made by ``masks``.

    A row for each part, filter_order and step (from 1; its filter is that letter), with the part's rows kept after the step, removed by it,
    redundant (failing its filter, but removed before), unique_fails (failing this filter only), good_lost and toxic_lost (removed by it and
    marked so) and shapley (all that its filter removes, at any step, over all orders). Rows that are equal count as often as they are there; an
    empty table has no part and gives no row."""
    sums = part_sums(rows, letters).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return unpacked(added(added(sums, ["part", "salt"]), ["part"]), letters)
