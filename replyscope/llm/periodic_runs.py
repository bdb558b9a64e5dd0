"""Periodic runs of words by block convolution.

A run of period q holds at least four periods, so at the scale B (a power of two) with B <= q < 2 B it contains a whole block of B words,
one of the blocks that start at multiples of B, and that block's copy q words later. For all blocks of a scale the sum of squared
differences with each place of the following window, sum (u[i] - w[d + i])^2, comes from a number-theoretic transform modulo a prime, in
whole numbers without rounding; it is zero where the block occurs again. Each such distance d seeds an extension, which compares words
themselves: so a sum that is only zero modulo the prime finds nothing, and no occurrence is missed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The modulus of the transforms, 2**16 + 1, and a generator of its units; transforms have up to 2**16 terms.
PRIME, GENERATOR = 65537, 3
#: Terms that one matrix product transforms. RADIX * PRIME**2 is far below 2**53, so the products' sums are exact integers in doubles.
RADIX = 16
#: Words of a block that are compared: a longer block is sought by its first so many words, and the extension compares the rest.
BLOCK = 1 << 15
#: Words of one pass over the scales, and terms transformed at once.
PASS_WORDS, TERMS = 1 << 16, 1 << 16


def reduced(x: np.ndarray) -> np.ndarray:
    """Whole numbers modulo the prime, in doubles: between 0 and the prime itself, which stands for 0 where the quotient is rounded down."""
    return x - np.floor(x * (1 / PRIME)) * PRIME


@lru_cache(maxsize=64)
def _powers(n: int, rows: int, cols: int, inverse: bool) -> np.ndarray:
    """w ** (i * j) for i < rows and j < cols, w a root of unity of order n or its inverse."""
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    powers = np.array([pow(root, e, PRIME) for e in range(n)], float)
    return powers[np.outer(np.arange(rows), np.arange(cols)) % n]


def transform(a: np.ndarray) -> np.ndarray:
    """Number-theoretic transform along the last axis but one (a power of two of terms), its terms in an order of their own."""
    *lead, n, r = a.shape
    if n <= RADIX:
        return reduced(_powers(n, n, n, False) @ a)
    m = n // RADIX
    a = reduced(_powers(RADIX, RADIX, RADIX, False) @ a.reshape(*lead, RADIX, m * r))
    a = reduced(a.reshape(*lead, RADIX, m, r) * _powers(n, RADIX, m, False)[:, :, None])
    return transform(a).reshape(*lead, n, r)


def inverse(a: np.ndarray) -> np.ndarray:
    """What ``transform`` made ``a`` of, times the number of terms."""
    *lead, n, r = a.shape
    if n <= RADIX:
        return reduced(_powers(n, n, n, True) @ a)
    m = n // RADIX
    a = reduced(inverse(a.reshape(*lead, RADIX, m, r)) * _powers(n, RADIX, m, True)[:, :, None])
    return reduced(_powers(RADIX, RADIX, RADIX, True) @ a.reshape(*lead, RADIX, m * r)).reshape(*lead, n, r)


def mismatch(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Per column the sums of squared differences, modulo the prime, of a block of b terms with the places 0 to b - 1 of its window of 2 b terms."""
    b = len(blocks)
    turned = np.zeros_like(windows)
    turned[0], turned[b + 1 :] = blocks[0], blocks[:0:-1]
    products = reduced(inverse(reduced(transform(turned) * transform(windows)))[:b] * (2 * pow(2 * b, PRIME - 2, PRIME) % PRIME))
    sums = np.concatenate([np.zeros((1, windows.shape[1])), np.cumsum(reduced(windows * windows), axis=0)])
    own = reduced(blocks * blocks).sum(axis=0)
    total = reduced(own + (sums[b : 2 * b] - sums[:b]) + (PRIME - products))
    return np.where(total == PRIME, 0, total)


def seeds(words: np.ndarray, ends: np.ndarray, starts: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, d): the blocks of ``b`` words at ``x`` that occur again ``d`` words later, b <= d < 2 b, in texts that have room for a run there.
    ``starts`` and ``ends`` bound the texts in ``words``."""
    room = np.maximum((ends - starts - 2 * b - 1) // b, 0)  # blocks x with x + 3 b < end
    x = np.repeat(starts, room) + b * (np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room))
    end = np.repeat(ends, room)
    size = min(b, BLOCK)
    found, some = [], max(TERMS // (2 * size), 1)
    terms = (words % PRIME).astype(float)
    for lo in range(0, len(x), some):
        at, stop = x[lo : lo + some], end[lo : lo + some]
        blocks = terms[at + np.arange(size)[:, None]]
        for first in range(b, 2 * b, size):
            windows = terms[np.minimum(at + first + np.arange(2 * size)[:, None], len(words) - 1)]
            d, col = np.nonzero(mismatch(blocks, windows) == 0)
            d += first
            # The first block of a run starts less than b words after the run, which holds four periods.
            fits = at[col] + 4 * d - b < stop[col]
            found.append((at[col[fits]], d[fits]))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (x, x)


def _same(words: np.ndarray, i: int, d: int, edge: int, step: int) -> int:
    """The first place from ``i`` on, in direction ``step``, up to ``edge``, whose word differs from the one ``d`` later."""
    size = 32
    while i != edge:
        n = min(size, abs(edge - i))
        lo = i if step > 0 else i - n + 1
        differ = np.flatnonzero(words[lo : lo + n] != words[lo + d : lo + d + n])
        if len(differ):
            return int(lo + (differ[0] if step > 0 else differ[-1]))
        i, size = i + step * n, size * 2
    return i


def _prime_factors(n: int) -> Iterator[int]:
    f = 2
    while f * f <= n:
        if n % f == 0:
            yield f
            while n % f == 0:
                n //= f
        f += 1
    if n > 1:
        yield n


def find_runs(words: np.ndarray, bounds: np.ndarray, periods: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, by start and then period: text i is words[bounds[i]:bounds[i + 1]], as numbers.

    A run is a stretch with smallest period q of at least ``periods`` (four or more) times q and ``least`` words that cannot be longer."""
    if periods < 4:
        raise ValueError("blocks of a scale are sure to repeat inside a run only from four periods on")
    starts, ends = bounds[:-1], bounds[1:]
    runs: list[tuple[int, int, int]] = []  # (start, end, period)
    b = 1
    while len(words) and 4 * b <= (ends - starts).max():
        x, d = seeds(words, ends, starts, b)
        if runs and len(x):
            # A distance inside a run of a smaller period is a multiple of that. Two such runs cannot both hold the pair, so the run
            # that reaches farthest of those that start before is the one to look at.
            by = sorted(runs)
            far, reach = [], (0, 0, 1)
            for r in by:
                reach = max(reach, r, key=lambda y: y[1])
                far.append(reach)
            far = np.array(far)
            i = np.searchsorted([r[0] for r in by], x, "right") - 1
            inside = (i >= 0) & (far[i, 0] <= x) & (far[i, 1] >= x + d + b) & (d % far[i, 2] == 0)
            x, d = x[~inside], d[~inside]
        text = np.searchsorted(starts, x, "right") - 1
        order = np.lexsort((x, d))
        x, d, text = x[order], d[order], text[order]
        i = 0
        while i < len(x):
            q, lo, hi = int(d[i]), int(starts[text[i]]), int(ends[text[i]])
            stop = _same(words, int(x[i]) + b, q, hi - q, 1) if (words[x[i] : x[i] + b] == words[x[i] + q : x[i] + q + b]).all() else int(x[i])
            if stop > x[i]:
                start = _same(words, int(x[i]) - 1, q, lo - 1, -1) + 1
                length = stop + q - start
                if length >= max(least, periods * q) and not any((words[start : start + length - q // f] == words[start + q // f : start + length]).all() for f in _prime_factors(q)):
                    runs.append((start, stop + q, q))
            # The next seed of this distance that the stretch does not hold.
            same = np.searchsorted(d, q, "right")
            i = max(i + 1, i + int(np.searchsorted(x[i:same], stop)))
        b *= 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in starts]
    for s, e, q in sorted(runs, key=lambda r: (r[0], r[2])):
        t = int(np.searchsorted(starts, s, "right")) - 1
        out[t].append((s - int(starts[t]), e - s, q))
    return out


def repeated(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Mask of the ``n`` words that a run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        step[s + q] += 1
        step[s + length] -= 1
    return np.cumsum(step[:-1]) > 0


def with_planted_run(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repetition that the contract plants in every tenth document by its id's CRC; others, and those without id, as they are."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _ends(edges: np.ndarray) -> list[int]:
    """Groups of consecutive texts of about PASS_WORDS words, as indices of their first texts."""
    out = [0]
    for i in range(1, len(edges)):
        if edges[i] - edges[out[-1]] >= PASS_WORDS or i == len(edges) - 1:
            out.append(i)
    return out


def periodic_runs(docs: DataFrame, planted: bool = False, periods: int = 4, least: int = 6) -> DataFrame:
    """The periodic runs of each text of ``docs`` (doc_id, text, any further columns), one row per row: doc_id, n_words, runs (array of start,
    length, period in words, by start and then period) and collapsed (the words that no run holds after its first period, joined by one blank).

    Words are what ASCII white space parts. Null, empty and blank texts have no word, no run and an empty ``collapsed``. Rows without an id, or
    with an id or text that others have, are rows of their own; an empty table gives none. ``planted`` first puts the contract's repetitions into the
    texts. A task works on its own rows alone: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            texts = [(t.as_py() or "").encode().split() for t in b.column("text")]
            if planted:
                texts = [with_planted_run(w, i) for w, i in zip(texts, ids, strict=True)]
            edges = np.cumsum([0, *map(len, texts)])
            groups = _ends(edges)
            for lo, hi in zip(groups, groups[1:], strict=False):
                words = [w for t in texts[lo:hi] for w in t]
                number = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.uint64)
                found = find_runs(number, edges[lo : hi + 1] - edges[lo], periods, least)
                kept = [b" ".join([w for w, gone in zip(t, repeated(r, len(t)), strict=True) if not gone] if r else t) for t, r in zip(texts[lo:hi], found, strict=True)]
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
                cols = [pa.array(ids[lo:hi], pa.int64()), pa.array(np.diff(edges[lo : hi + 1])), pa.array(runs, RUNS), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the start, length, period and exponent_milli of the run with the greatest length for its period (then the smallest start, then
    period; null without a run), runs_sha256 (a line ``start,length,period`` for each run) and collapsed_sha256 of ``periodic_runs``."""
    # Lengths and periods stay far below 2**31, so the cross products that compare two exponents exactly fit in a long. Of equal ones the first
    # stays: runs come by start and then period.
    greater = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate("runs", F.get("runs", 0), lambda a, b: F.when(greater(b, a), b).otherwise(a))
    best = F.when(F.size("runs") > 0, best)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
