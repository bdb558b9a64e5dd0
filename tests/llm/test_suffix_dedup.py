import hashlib
import random
from collections import Counter

import numpy as np
from cases import documents, empty_documents, odd_rows

from replyscope.llm import suffix_dedup as S


def brute(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, length=40, spread=17, step=4):
    docs = documents(spark, rows)
    got = [tuple(r) for r in S.digest(S.remove_repeats(docs, length, spread, step)).drop("n_shorter").collect()]
    texts = [(r[1] or "").encode() for r in rows]
    want = [(r[0], *w) for r, w in zip(rows, brute(texts, length))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    # With a shorter length counted too: the same, and the bytes that it covers.
    got = [tuple(r) for r in S.digest(S.remove_repeats(docs, length, spread, step, shorter=30, shorter_spread=9)).collect()]
    want = [(*w, short[1]) for w, short in zip(want, brute(texts, 30))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_random_texts_with_shared_passages(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzé "
    passages = ["".join(rng.choice(letters) for _ in range(n)) for n in (39, 40, 41, 60, 200, 700)]
    rows = []
    for i in range(150):
        parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 90)))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            lo = rng.randrange(len(p))
            parts += [p if rng.random() < 0.5 else p[lo:], "".join(rng.choice(letters) for _ in range(rng.randrange(0, 30)))]
        rows.append((i, "".join(parts)))
    check(spark, rows + rows[:3])


def test_low_entropy_and_odd_rows(spark):
    rows = [(1, "a" * 500), (2, "ab" * 100), (3, "a" * 39), (4, "b" * 40 + "c"), (5, "abc" * 60 + "x" + "abc" * 60)]
    check(spark, rows + odd_rows())


def test_spans_of_a_repeated_row_are_those_of_one_text(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(1, text)] * 60 + [(2, text[:100] + "#" + text[101:]), (3, text)]
    src = documents(spark, rows).select("doc_id", F.xxhash64("doc_id", "text").alias("k"), F.hash("text", "doc_id").alias("k2"), F.col("text").cast("binary").alias("t"))
    spans = {r.k: [tuple(s) for s in r.spans] for r in S.repeated_spans(src.select("k", "k2", "t"), 40, 17, 4).collect()}
    assert len(spans) == 3 and all(len(s) == len(set(s)) <= 300 for s in spans.values())
    check(spark, rows)


def test_default_parameters(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    near = base[:900] + "#" + base[901:1500] + "##" + base[1502:]
    check(spark, [(1, base), (2, near), (3, base[100:499]), (4, "x" + base[2000:2400] + "y"), (5, base[5:404])], 400, 257, 16)


def test_long_text_is_cut_into_segments(spark):
    rng = np.random.default_rng(1)
    long = rng.integers(97, 123, S.SEGMENT + 5000).astype(np.uint8).tobytes().decode()
    text = long + long[S.SEGMENT - 700 : S.SEGMENT + 500]
    got = S.digest(S.remove_repeats(documents(spark, [(1, text), (2, "short")]))).where("doc_id = 1").drop("n_shorter").first()
    want = brute([text.encode()], 400)[0]
    assert tuple(got)[1:] == want


def test_empty_table_and_clean_documents(spark):
    assert S.digest(S.remove_repeats(empty_documents(spark))).count() == 0
    shared = "é" * 300
    docs = documents(spark, [(1, "x" + shared + "y"), (2, shared), (3, None)])
    out = {r.doc_id: r for r in S.clean_documents(docs).collect()}
    assert [out[i].text for i in (1, 2, 3)] == ["xy", "", ""]
    assert S.clean_documents(docs).columns == docs.columns and out[1].n_chars == 2


def test_identifiers_name_contents():
    data = np.frombuffer(b"abcabcab" * 20, np.uint8)
    ids = S.refine(data, {1, 8, 16})
    assert len(set(ids[8][:3].tolist())) == 3 and ids[16][0] == ids[16][8]
    a = S.at_depth(S.refine(data, set(S.powers(25))), 25, np.array([0, 8, 1]))
    assert a[0] == a[1] != a[2]


def test_half_of_all_rows_equal(spark):
    """A text in hundreds of equal rows, one shorter than the length too, with columns of their own, and texts that share parts of it."""
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(1, text)] * 300 + [(2, text[:30])] * 100 + [(None, None)] * 50 + [(3, text[40:90] + "#"), (4, text[:39] + "%"), (5, "zzz" + text[:30])]
    check(spark, rows)
    docs = documents(spark, [(d, t, f"s{i}") for i, (d, t) in enumerate(rows)])
    out = S.clean_documents(docs, length=40, spread=17, step=4)
    assert out.columns == docs.columns and sorted(r.source for r in out.collect()) == sorted(f"s{i}" for i in range(len(rows)))
    # The table that the refinements work on holds each text once.
    texts = []
    plain = S.repeated_spans
    S.repeated_spans = lambda src, *a: texts.append(src.count()) or plain(src, *a)
    try:
        S.remove_repeats(docs, 40, 17, 4).count()
    finally:
        S.repeated_spans = plain
    assert texts == [6]
