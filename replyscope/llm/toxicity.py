"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text. The toxic one is trained on what
the ordinary sample does not share: words of several toxic texts that are either made of 5-byte strings that it lacks, or far
more frequent than in it. A text is cut into windows of a few words; each window is
compressed with the ordinary dictionary alone and with the toxic one before it, so that the difference of the two lengths is what the
toxic dictionary saves. A text is judged by its largest savings and its number of windows; the rule for these words, the sizes of the toxic
dictionary's parts and the plane that parts the classes are calibrated on labelled texts that trained no dictionary.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyscope.llm.common import text_bytes

#: Lower-cases A-Z and turns ASCII signs into blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
GRAM, TOP = 5, 3
#: A word of the toxic dictionary's samples is in so many toxic texts at least, and by the second rule in so many times the share of
#: texts that it has among ordinary ones.
SUPPORT, EXCESS = 3, 8
ORDINARY_BYTES = 1 << 14
TOXIC_BYTES = (512, 768, 1024, 1536, 2048, 4096)
SEGMENT_BYTES = (16, 24, 32)


@dataclass(frozen=True)
class Model:
    """Dictionary contents, words in a window, and the logistic function of a text's features that is its score."""

    ordinary: bytes
    toxic: bytes
    words: int
    base: float
    plane: tuple[float, ...] = ()

    def compressors(self) -> tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]:
        params = zstd.ZstdCompressionParameters(
            window_log=17, hash_log=17, chain_log=17, search_log=1, min_match=6, strategy=zstd.STRATEGY_DFAST,
            format=zstd.FORMAT_ZSTD1_MAGICLESS, write_checksum=0, write_content_size=0, write_dict_id=0,
        )
        out = []
        # zstandard indexes every third place of a dictionary: equal places of the ordinary part make clean windows compress alike.
        front = b"\0" * (-len(self.toxic) % 24) + self.toxic
        for content in (self.ordinary, front + self.ordinary):
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            if len(content) >= 8:
                d.precompute_compress(compression_params=params)
            out.append(zstd.ZstdCompressor(dict_data=d, compression_params=params) if len(content) >= 8 else zstd.ZstdCompressor(compression_params=params))
        return out[0], out[1]

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Each text's TOP largest savings, in order, and the logarithm of its number of windows."""
        plain, toxic = (c.compress for c in self.compressors())
        out = np.zeros((len(texts), TOP + 1))
        for i, t in enumerate(texts):
            saved = np.array([len(plain(w)) - len(toxic(w)) for w in windows(t, self.words)])
            best = -np.sort(-saved)[:TOP]
            out[i, : len(best)] = np.maximum(best, 0)
            out[i, TOP] = np.log1p(len(saved))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.plane:
            return np.full(len(texts), self.base)
        return logistic(self.features(texts), np.array(self.plane))


def windows(text: bytes, words: int) -> Iterator[bytes]:
    w = text.translate(FOLD).split()
    for i in range(0, len(w), words):
        yield b" " + b" ".join(w[i : i + words]) + b" "


def spaced(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a dictionary trained on the samples; of few samples, their last bytes."""
    try:
        raw = zstd.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]
    offsets = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))  # end of the entropy tables
    return raw[raw.find(offsets) + len(offsets) :]


def grams(text: bytes) -> set[bytes]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def fit(toxic: list[bytes], ordinary: list[bytes], share: float | None = None, words: int = 8) -> Model:
    """Fit on bounded samples of whole texts. Two thirds of each train dictionaries, the rest calibrates them; ``share`` is that of
    toxic texts among all labelled ones."""
    base = len(toxic) / max(1, len(toxic) + len(ordinary))
    share = base if share is None else share
    cut = [[(i % 3 < 2, t.translate(FOLD).split()) for i, t in enumerate(ts)] for ts in (toxic, ordinary)]
    train, hold = ([[w for k, w in c if k is part and w] for c in cut] for part in (True, False))
    plain = Model(b"", b"", words, min(base, 0.499))
    if not (train[0] and train[1] and hold[0] and hold[1]):
        return plain
    known: set[bytes] = set()
    for t in train[1]:
        known |= grams(spaced(t))
    seen: dict[bytes, bool] = {}

    def unshared(w: bytes) -> bool:
        if w not in seen:
            g = grams(spaced([w]))
            seen[w] = 2 * len(g - known) > len(g)
        return seen[w]

    often, usual = (Counter(w for t in ts for w in set(t)) for ts in train)

    def frequent(w: bytes) -> bool:
        return often[w] / len(train[0]) >= EXCESS * (usual[w] + 1) / len(train[1])

    kept = [[x for x in ([w for w in t if often[w] >= SUPPORT and rule(w)] for t in train[0]) if x] for rule in (unshared, frequent)]
    common = dictionary([spaced(t) for t in train[1]], ORDINARY_BYTES, 64)
    label = np.repeat([1, 0], [len(hold[0]), len(hold[1])])
    texts = [b" ".join(t) for part in hold for t in part]
    weight = np.where(label == 1, share / label.mean(), (1 - share) / (1 - label.mean()))
    best, least = plain, np.inf
    for left, size, segment in itertools.product(kept, TOXIC_BYTES, SEGMENT_BYTES):
        model = replace(plain, ordinary=common, toxic=dictionary([spaced(t) for t in left], size, segment))
        if not model.toxic:
            continue
        x = model.features(texts)
        plane = part(x, label, weight)
        p = logistic(x, plane)
        loss = float(-(weight * np.log(np.where(label == 1, p, 1 - p) + 1e-9)).mean())
        if loss < least:
            best, least = replace(model, plane=tuple(plane.tolist())), loss
    return best


def logistic(x: np.ndarray, plane: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ plane[:-1] + plane[-1], -50, 50)))


def part(x: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the constant comes last."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    keep = ridge * np.eye(len(w))
    for _ in range(40):
        p = logistic(x, w)
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + keep, a.T @ (weight * (label - p)) - keep @ w)
        w = w + step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return w


def held_out(doc_id: Column) -> Column:
    """True for ids outside the learning part: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, max_bytes: int = 16_384, words: int = 8) -> Model:
    """Fit on ``docs`` with ``labels`` (doc_id, toxic), rows of the held-out part left out. The sample is bounded: the first
    ``per_class`` labelled ids of each class by hash, and of each the text of at most ``max_bytes`` bytes that comes first by hash. Conflicting or null
    labels of an id are left out."""
    lab = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    lab = lab.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pick = lab.where("toxic = 1").orderBy(*order).limit(per_class).unionByName(lab.where("toxic = 0").orderBy(*order).limit(per_class))
    text = docs.select("doc_id", text_bytes().alias("t")).where(F.octet_length("t").between(1, max_bytes))
    count = lab.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).where("toxic in (0, 1)").collect()
    n = {r.toxic: r.n for r in count}
    one = F.min(F.struct(F.xxhash64("t"), "t"))["t"].alias("t")
    rows = text.join(F.broadcast(pick), "doc_id").groupBy("doc_id", "toxic").agg(one).collect()  # at most 2 * per_class rows
    rows.sort(key=lambda r: r.doc_id)
    toxic, ordinary = ([bytes(r.t) for r in rows if r.toxic == c] for c in (1, 0))
    return fit(toxic, ordinary, n.get(1, 0) / max(1, sum(n.values())), words)


def toxicity(model: Model, text: str = "text") -> Column:
    """Score of a text column, 0 to 1; null and empty texts score as texts without any window."""

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(model.scores(part.to_pylist()))

    return score(text_bytes(text))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, any further columns): doc_id, held_out, score, predicted (1 from 0.5 on).

    Null and empty texts score as low as a text without a window can. Equal texts score alike whatever their id; a null id is
    not held out. Without labels of both classes every text gets the share of toxic labels, below 0.5."""
    model = train(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
