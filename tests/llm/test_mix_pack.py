import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import documents, empty_documents, odd_rows, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from replyscope.llm import bfd_packing, mixing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def mixed(spark, rows, **options):
    docs = documents(spark, rows)
    placed, pieces = mixing.mix_sources(docs, **options)
    return docs, placed, pieces


def rows_of_sources(n=200):
    import random

    rng = random.Random(6)
    return [(i, words(rng, rng.randrange(0, 80)), rng.choice(["a", "b", "b", "b", "Z", None, "é"])) for i in range(n)] + odd_rows()


def expected_targets(rows):
    size = defaultdict(int)
    for r in rows:
        size[r[2]] += len((r[1] or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        by = sum(weight[s] for s in order if s not in full)
        target = {s: 2 * size[s] if s in full else rest * weight[s] / by for s in order}
        over = {s for s in order if s not in full and target[s] > 2 * size[s]}
        if not over:
            return size, target
        full |= over


def test_targets_and_takes(spark):
    rows = rows_of_sources()
    _, placed, pieces = mixed(spark, rows, block=16)
    size, target = expected_targets(rows)
    got = mixing.taken(placed, pieces).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len((r[1] or "").encode().split())) for r in rows)
    source = {r["no"]: r.source for r in placed.select("no", "source").distinct().collect()}
    words_of = defaultdict(int)
    for r in pieces.collect():
        words_of[source[r["no"]]] += r.words
        assert 0 < r.words <= 16
    # As many words as the slots hold, which is the target but for a few blocks, and at most twice the source.
    hits = Counter(r["no"] for r in mixing.schedule(placed.select("no", "target").distinct(), 16).collect())
    assert {s: words_of[s] for s in size} == {s: min(hits[n] * 16, 2 * size[s]) for n, s in source.items()}
    assert all(abs(words_of[s] - t) <= 2 * 16 for s, t in target.items())
    assert all(0 <= r.taken <= 2 * r.size for r in got) and sum(r.taken for r in got) == sum(words_of.values())
    first, n = defaultdict(list), Counter()
    for r in pieces.collect():
        first[r["no"], r["at"]].append(r.slot)
        n[r["no"], r["at"]] += 1
    assert Counter((min(v), len(v)) for v in first.values()) == Counter((r.first_slot, r.n_slots) for r in got if r.taken)
    assert all(r.first_slot is None and r.n_slots == 0 for r in got if not r.taken)
    by = {source[r["no"]]: r for r in placed.collect()}
    assert all(abs(by[s].target - t) < 1e-6 and by[s].source_size == size[s] for s, t in target.items())


def test_another_generator_makes_another_mix(spark):
    rows = rows_of_sources(300)
    docs, placed, pieces = mixed(spark, rows, block=4)
    other = mixing.mix_pieces(placed, 2.0, 4, multiplier=3 * mixing.GOLDEN % mixing.CIRCLE)
    a, b = ({(r.doc_id, r.size, r.first_slot, r.n_slots) for r in mixing.taken(placed, p).collect()} for p in (pieces, other))
    assert a != b and {x[:2] for x in a} == {x[:2] for x in b}
    for p in (pieces, other):
        got = {r["no"]: r.words for r in p.groupBy("no").agg({"words": "sum"}).withColumnRenamed("sum(words)", "words").collect()}
        assert all(abs(got.get(r["no"], 0) - r.target) <= 4 * 4 for r in placed.select("no", "target").distinct().collect())


def test_points_are_exact_at_large_numbers(spark):
    """The parts of the circle and the points in whole numbers: against Python's integers."""
    per = spark.createDataFrame([(0, 5.0e4), (1, 1.0), (2, 0.0), (3, 3.1e4)], "no int, target double")
    got = {r.slot: (r["no"], r.block) for r in mixing.schedule(per, 3).collect()}
    need = [-(-int(t) // 3) if t == int(t) else 0 for t in (5.0e4, 1.0, 0.0, 3.1e4)]
    total, lo, want, rank = sum(need), 0, {}, Counter()
    edges = []
    for n in need:
        edges.append((lo * mixing.CIRCLE // total, (lo + n) * mixing.CIRCLE // total))
        lo += n
    for slot in range(total):
        u = slot * mixing.GOLDEN % mixing.CIRCLE
        no = next(i for i, (a, b) in enumerate(edges) if a <= u < b)
        want[slot] = (no, rank[no])
        rank[no] += 1
    assert got == want


def test_a_row_repeated_often(spark):
    rows = [(7, "one two three", "a")] * 500 + [(i, f"w{i} x y z", "b") for i in range(500)]
    docs, placed, pieces = mixed(spark, rows, block=5)
    got = mixing.taken(placed, pieces).collect()
    assert len(got) == 1000 and all(r.taken <= 2 * r.size for r in got)
    out = Counter(r.text for r in mixing.mixed_documents(docs, block=5).collect() if r.doc_id == 7 and r.text == "one two three")
    assert abs(out["one two three"] * 3 - next(r.target for r in got if r.doc_id == 7)) <= 15


def test_slots_are_a_permutation_and_follow_the_shares(spark):
    rows = [(i, words(__import__("random").Random(i), 50), "abc"[i % 3]) for i in range(600)]
    _, placed, pieces = mixed(spark, rows, block=10)
    slots = mixing.schedule(placed.select("no", "target").distinct(), 10).orderBy("slot").collect()
    assert len({s.slot for s in slots}) == len(slots)
    share = Counter(s["no"] for s in slots)
    for part in range(100, len(slots), 100):
        seen = Counter(s["no"] for s in slots[:part])
        assert all(abs(seen[n] - part * share[n] / len(slots)) < 8 for n in share)
    for n in share:
        assert [s.block for s in slots if s["no"] == n] == list(range(share[n]))


def test_reruns_agree_and_documents_follow(spark):
    rows = rows_of_sources(60)
    docs, placed, pieces = mixed(spark, rows, block=8)
    key = lambda: sorted(map(tuple, pieces.select("slot", "block", "doc_id", "first", "words").collect()), key=repr)
    assert key() == key()
    out = mixing.mixed_documents(docs, block=8)
    assert out.columns == docs.columns
    total = sum(len(r.text.encode().split()) for r in out.collect())
    assert total == pieces.agg({"words": "sum"}).first()[0]
    assert all(r.n_chars == len(r.text) for r in out.collect())
    # Rows come in the order of their first slots.
    part = pieces.groupBy("no", "at", "pass").agg(F.min("slot").alias("slot"), F.first("doc_id").alias("doc_id")).collect()
    by_slot = defaultdict(set)
    for r in part:
        by_slot[r.slot].add(r.doc_id)
    order = [d for s in sorted(by_slot) for d in [by_slot[s]] for _ in range(sum(r.slot == s for r in part))]
    assert len(order) == out.count() and all(r.doc_id in ids for r, ids in zip(out.collect(), order))


def test_mix_of_nothing(spark):
    for docs in (empty_documents(spark), documents(spark, [(1, None), (2, "")])):
        rows, pieces = mixing.mix_sources(docs)
        assert pieces.count() == 0 and {r.taken for r in mixing.taken(rows, pieces).collect()} <= {0}
        assert mixing.mixed_documents(docs).count() == 0


TEXTS = ["It's <|endoftext|>x a<|startoftext|>", "İstanbul ΣΑΣ ſ µ ª² ½don't we'll ''s", "a\x1cb\x85c d \xa0e", "日本語 text, (ok) 12ab3. é ̈x 'S 'Re", "", " ", "CAFÉ café. Straße!!"]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def test_word_tokenizer_equals_the_file(whole):
    t = packing.tokenizer(PATH)
    assert [x.tolist() for x in t([s.encode() for s in TEXTS])] == [whole.encode(s, add_special_tokens=False).ids for s in TEXTS]


@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=30), max_size=4))
@settings(max_examples=150, deadline=None)
def test_word_tokenizer_on_any_text(texts):
    t, w = packing.tokenizer(PATH), Tokenizer.from_file(PATH)
    assert [x.tolist() for x in t([s.encode() for s in texts])] == [w.encode(s, add_special_tokens=False).ids for s in texts]


def ids_of(whole, rows):
    return [np.array(whole.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4") for r in rows]


def test_harmonic_pieces_round_trip(spark, whole):
    rows = rows_of_sources() + [(5000, " ".join(TEXTS))]
    pieces = packing.pack_documents(documents(spark, rows), PATH, capacity=256).collect()
    seqs, docs = defaultdict(list), Counter()
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        seqs[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id] += p.length
    total = padded = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
        total += at
        padded += 0 if at & (at - 1) == 0 else 256 - at
    want = Counter()
    for r, ids in zip(rows, ids_of(whole, rows)):
        want[r[0]] += len(ids)
    assert docs == want and padded < 0.05 * total + 256
    # Documents of an id of their own come back id by id.
    once = {r[0]: ids for r, ids in zip(rows, ids_of(whole, rows)) if sum(x[0] == r[0] for x in rows) == 1 and r[0] is not None}
    for d, ids in once.items():
        own = sorted((p.start, bytes(p.ids)) for p in pieces if p.doc_id == d)
        assert b"".join(b for _, b in own) == ids.tobytes() and {p.doc_tokens for p in pieces if p.doc_id == d} == {len(ids)}
    crc = packing.digest(packing.pack_documents(documents(spark, rows[:20]), PATH)).first()
    assert 0 <= crc.ids_crc32 < 1 << 32 and zlib.crc32(b"") == 0


@given(st.integers(1, 20_000), st.sampled_from([64, 256, 4096]))
@settings(max_examples=200, deadline=None)
def test_cuts_are_longest_of_their_class(n, capacity):
    cuts = packing.cuts(n, capacity)
    assert sum(cuts) == n and all(c == capacity // (capacity // c) for c in cuts) and len(cuts) <= n // capacity + 6


@given(st.lists(st.integers(1, 64), max_size=120))
@settings(max_examples=200, deadline=None)
def test_best_fit_decreasing_against_a_plain_search(lengths):
    got = bfd_packing.best_fit_decreasing(lengths, 64)
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms[rooms.index(min(fit))] -= n
        else:
            rooms.append(64 - n)
    assert sorted(64 - sum(lengths[i] for i in b) for b in got) == sorted(rooms)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))


def test_id_matrix_round_trip(spark, whole):
    rows = rows_of_sources() + [(5000, " ".join(TEXTS))]
    out = bfd_packing.pack_rows(documents(spark, rows), PATH, capacity=256, part_tokens=3000).collect()
    found = defaultdict(list)
    for r in out:
        ids = np.frombuffer(r.input_ids, "<u4")
        assert len(ids) == 256 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1] and not ids[r.n_tokens :].any()
        for lo, hi, d, s, n in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.starts, r.doc_tokens):
            found[d, n].append((s, ids[lo:hi].tobytes()))
    want = defaultdict(list)
    for r, ids in zip(rows, ids_of(whole, rows)):
        want[r[0], len(ids)] += [(at, ids[at : at + 256].tobytes()) for at in range(0, len(ids), 256)]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert len({r.sequence_id for r in out}) == len(out)


def test_packing_nothing(spark):
    assert packing.pack_documents(empty_documents(spark), PATH).count() == 0
    assert bfd_packing.pack_rows(empty_documents(spark), PATH).count() == 0
