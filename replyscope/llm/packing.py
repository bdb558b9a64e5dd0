"""Harmonic packing of tokenized documents into sequences.

A piece whose length lies in ``(capacity / (j + 1), capacity / j]`` is of class ``j``, and a bin of class ``j`` takes exactly ``j`` of
them, so a worker fills each class's bins without looking at others. Documents may be cut, so each is cut to lengths that are
the longest of their class: ``capacity // j`` for some ``j``, the largest that fits first. Such bins lack fewer than ``j`` tokens.
What a task has left (fewer than ``j`` pieces per class) is numbered over all tasks and fills bins by the same rule; what is left
then is bounded by the classes alone and is laid end to end, cut where a sequence is full.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replyscope.llm.common import save, text_bytes

#: Texts of so many bytes are tokenized together.
BATCH_BYTES = 1 << 25
SIGNS = ".,;:!?"
_WORKER: dict = {}


def ragged(values: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists ``at`` of the ragged array (values, offsets), joined, and their offsets."""
    size = (offsets[1:] - offsets[:-1])[at]
    new = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(new[-1]) + np.repeat(offsets[at] - new[:-1], size)
    return values[place], new


class WordTokenizer:
    """Ids of texts by a word-level BPE file: white space only parts words, so a text's ids are those of its words, and each word
    that differs in a batch is tokenized once. Words of plain Latin letters and signs are lower-cased and cut by the file's
    pattern here, so that the library is left with the pieces that differ; it gets all other words as they are."""

    # The lower case of the letter left out is two.
    plain = re.compile(r"[\n!-~¡-įı-ſ]*")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(Path(path).read_text())
        self.whole = Tokenizer.from_str(json.dumps(spec))
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.last = np.zeros(1 << 16, bool)
        end = spec["model"]["end_of_word_suffix"]
        self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(end)]] = True
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "WhitespaceSplit"}
        self.pieces = Tokenizer.from_str(json.dumps(spec))
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_level = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xA1, 0x180)}

    def _cut(self, words: list[str]) -> tuple[list[str | None], list[int]]:
        """Pieces of the words, one after the other, and each word's number of them; None where only the library can tell."""
        text = "\n".join(words)
        hard = any(t in text for t in self.special) or not self.plain.fullmatch(text)
        pieces, size = [], []
        for w, s in zip(words, text.lower().split("\n") if words and not hard else words, strict=True):
            if hard:
                if not self.plain.fullmatch(w) or any(t in w for t in self.special):
                    pieces.append(None)
                    size.append(1)
                    continue
                s = w.lower()
            if s.isalpha():
                pieces.append(s)
                size.append(1)
            elif s and s[-1] in SIGNS and s[:-1].isalpha():
                pieces += s[:-1], s[-1]
                size.append(2)
            else:
                found = self.pattern.findall(s)
                pieces += found
                size.append(len(found))
        return pieces, size

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces of plain words, as a ragged array."""
        values, stops, n = [], [np.zeros(1, np.int64)], 0
        for i in range(0, len(pieces), 20_000):
            text = " ".join(pieces[i : i + 20_000])
            text = text if text.isascii() else text.translate(self.byte_level)
            ids = np.array(self.pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)
            values.append(ids)
            stops.append(np.flatnonzero(self.last[ids]) + 1 + n)
            n += len(ids)
        return np.concatenate(values) if values else np.zeros(0, np.uint16), np.concatenate(stops)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, as a ragged array."""
        pieces, size = self._cut(words)
        first = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        number = dict.fromkeys(pieces)
        number.pop(None, None)
        values, offsets = self._encode(list(number))
        number = dict(zip(number, range(len(number)), strict=True))
        odd = [i for i, p in enumerate(pieces) if p is None]
        other = [np.array(self.whole.encode(words[w], add_special_tokens=False).ids, np.uint16) for w in np.searchsorted(first, odd, "right") - 1]
        values = np.concatenate([values, *other])
        offsets = np.concatenate([offsets, offsets[-1] + np.cumsum([len(o) for o in other], dtype=np.int64)])
        free = itertools.count(len(number))
        flat = np.fromiter((next(free) if p is None else number[p] for p in pieces), np.int64, len(pieces))
        values, offsets = ragged(values, offsets, flat)
        return values, offsets[first]

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        coded = lists.flatten().dictionary_encode()
        ids, offsets = ragged(*self._words(coded.dictionary.to_pylist()), coded.indices.to_numpy())
        stops = offsets[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file, made once."""
    if path not in _WORKER:
        _WORKER[path] = WordTokenizer(path)
    return _WORKER[path]


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: the longest of a class that fits, again and again."""
    out = []
    while n:
        c = capacity // -(-capacity // n) if n < capacity else capacity
        out.append(c)
        n -= c
    return out


def _bytes(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, seq long, offset long, task int, nth long"


def task_pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of (doc_id, t); those in a bin that its task filled have ``seq`` and ``offset``, the rest are the ``nth`` left
    over of their length in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, bins, open_ = TaskContext.get().partitionId(), 0, {}
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        names = [c.split()[0] for c in PIECE.split(", ")]

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        def some(out: list, part: list[tuple]) -> None:
            nonlocal bins
            for (doc, _), ids in zip(part, tokenizer(path)([t for _, t in part]), strict=True):
                ids = np.append(ids, np.uint16(end_id))
                at = 0
                for n in cuts(len(ids), capacity):
                    held = open_.setdefault(n, [])
                    held.append((doc, at, n, _bytes(ids[at : at + n]), len(ids)))
                    at += n
                    if len(held) == capacity // n:
                        out += [(*p, task << 32 | bins, i * n, task, None) for i, p in enumerate(held)]
                        open_[n] = []
                        bins += 1

        for b in batches:
            part, size = [], 0
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part.append((doc, t.as_py()))
                size += len(part[-1][1])
                if size >= BATCH_BYTES:
                    some(out := [], part)
                    if out:
                        yield rows(out)
                    part, size = [], 0
            some(out := [], part)
            if out:
                yield rows(out)
        left = [(*p, None, None, task, i) for held in open_.values() for i, p in enumerate(held)]
        if left:
            yield rows(left)

    return docs.mapInArrow(run, PIECE)


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text, any further columns): doc_id, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset.

    A row's ids are those of its text by the tokenizer file ``path``, then ``end_id``; null and empty texts give the end alone.
    Each id lies in one piece, each sequence holds at most ``capacity`` ids without gaps. Rows that share an id, have none or are
    equal in all are packed one by one. An empty table gives no row."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t"))
    p = save(task_pieces(src, path, end_id, capacity))
    cols = ["doc_id", "start", "length", "ids", "doc_tokens"]
    done = p.where("seq is not null").select(*cols, F.col("seq").alias("sequence_id"), "offset")

    left = p.where("seq is null").drop("seq", "offset")
    counts = left.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("n", F.sum("n").over(W.partitionBy("length")))
    left = left.join(offsets, ["length", "task"])
    left = left.withColumn("rank", F.col("base") + F.col("nth")).withColumn("each", F.floor(F.lit(capacity) / F.col("length")))
    full = F.floor(F.col("n") / F.col("each")) * F.col("each")
    seq = F.lit(1 << 60) + F.shiftleft("length", 40) + F.floor(F.col("rank") / F.col("each"))
    again = left.where(F.col("rank") < full).select(*cols, seq.alias("sequence_id"), (F.col("rank") % F.col("each") * F.col("length")).alias("offset"))

    # Fewer than ``each`` pieces per class: their number depends on the capacity alone.
    rest = left.where(F.col("rank") >= full)
    line = W.orderBy(F.desc("length"), "rank").rowsBetween(W.unboundedPreceding, -1)
    rest = rest.withColumn("at", F.coalesce(F.sum("length").over(line), F.lit(0)))
    first, last = F.floor(F.col("at") / capacity), F.floor((F.col("at") + F.col("length") - 1) / capacity)
    rest = rest.withColumn("bin", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("at"), F.col("bin") * capacity)
    n = F.least(F.col("at") + F.col("length"), (F.col("bin") + 1) * capacity) - lo
    skip = lo - F.col("at")
    ids = F.substring("ids", (skip * 4 + 1).cast("int"), (n * 4).cast("int"))
    end = rest.select(
        "doc_id", (F.col("start") + skip).alias("start"), n.alias("length"), ids.alias("ids"), "doc_tokens",
        (F.lit(1 << 61) + F.col("bin")).alias("sequence_id"), (lo - F.col("bin") * capacity).alias("offset"),
    )
    kinds = [F.col(c).cast("long") if c != "ids" else F.col(c) for c in [*cols, "sequence_id", "offset"]]
    return done.unionByName(again).unionByName(end).select(*kinds)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of them."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
