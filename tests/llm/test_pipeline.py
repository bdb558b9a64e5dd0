"""The pipeline against plain versions of its stages, and the registered queries against their SQL."""

import os
import subprocess
import sys
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from cases import documents, empty_documents, odd_rows
from test_mix_pack import expected_targets
from test_simhash import components, slow_fingerprint
from tokenizers import Tokenizer

from replyscope.llm import registry
from replyscope.llm.common import save

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = save(stages["toxicity"](spark, docs, SF))
    assert clean.schema == docs.schema and clean.exceptAll(docs).count() == 0 and clean.count() > 0.8 * docs.count()

    rows = [(r.doc_id, r.text) for r in clean.collect()]
    comp = components([r[0] for r in rows], [slow_fingerprint(r[1]) for r in rows])
    kept = save(stages["simhash_dedup"](spark, clean, SF))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comp)) and kept.exceptAll(clean).count() == 0

    texts = {r.doc_id: r.text.encode() for r in kept.collect()}
    size = 250
    seen = Counter(t[i : i + size] for t in texts.values() for i in range(len(t) - size + 1))
    left = save(stages["suffix_dedup"](spark, kept, SF))
    for r in left.collect():
        t, gone = texts[r.doc_id], bytearray(len(texts[r.doc_id]))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        want = bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore")
        assert r.text == want and r.n_chars == len(want)
    assert left.count() == kept.count() and left.columns == docs.columns

    mix = save(stages["mix_sources"](spark, left, SF))
    by = {r.doc_id: r for r in left.collect()}
    got = defaultdict(int)
    for r in mix.collect():
        got[by[r.doc_id].source] += len(r.text.encode().split())
        assert r.text.encode().split() == by[r.doc_id].text.encode().split()[: len(r.text.encode().split())]
    _, target = expected_targets([(r.doc_id, r.text, r.source) for r in by.values()])
    assert all(abs(got[s] - t) <= 4 for s, t in target.items())  # within four blocks, of one word each here

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in mix.collect())
    packed = stages["harmonic_packing"](spark, mix, SF)
    assert packed.agg({"length": "sum"}).first()[0] == want
    assert np.all(np.array([r.length for r in packed.collect()]) <= 4096)


def test_stages_bear_odd_rows(spark, tmp_path):
    """Two labels train no model, so all rows pass the first stage; null, empty and blank texts are one component of the second, of which the
    smallest id stays; what is left of it and of texts removed whole has no words and is not in the mix."""
    spark.createDataFrame([(4, 1), (8, 0)], "doc_id long, quality int").selectExpr("*", "quality as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    rows = odd_rows()
    for start in (documents(spark, rows), empty_documents(spark)):
        docs, kept = start, {}
        for name, stage in corpus_pipeline.STAGES:
            docs = save(stage(spark, docs, str(tmp_path)))
            if name != "harmonic_packing":
                assert docs.columns == start.columns
            kept[name] = docs.collect()
        if start.isEmpty():
            assert not any(kept.values())
            continue
        assert len(kept["toxicity"]) == len(rows)
        blank = [r for r in kept["simhash_dedup"] if not (r.text or "").split()]
        assert [r.doc_id for r in blank] == [1] and len(kept["simhash_dedup"]) < len(rows)
        assert len(kept["suffix_dedup"]) == len(kept["simhash_dedup"]) and all(r.text is not None for r in kept["suffix_dedup"])
        assert all(r.text.split() for r in kept["mix_sources"]) and {r.doc_id for r in kept["mix_sources"]} <= {r.doc_id for r in kept["suffix_dedup"]}
        assert {r.doc_id for r in kept["harmonic_packing"]} == {r.doc_id for r in kept["mix_sources"]}


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[0] == "doc_id" and out.count() > 0


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in registry.QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_entry_without_this_subpackage():
    """With the folders away the entry still imports; the finder hides them."""
    code = (
        "import sys\n"
        "class Hide:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('replyscope.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Hide())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries()) and e.oracle_sql()\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
