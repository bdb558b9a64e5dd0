"""Training-data pipeline: toxic texts out, near copies out, repeated passages out, sources mixed to their weights, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. ``run`` writes
each stage's result as Parquet in the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from replyscope.llm.common import save
from replyscope.llm.mixing import mixed_documents
from replyscope.llm.packing import digest, pack_documents
from replyscope.llm.simhash import one_of_each
from replyscope.llm.suffix_dedup import clean_documents
from replyscope.llm.toxicity import toxicity, train


#: A passage of over 50 words that repeats across documents has to go: 95 of 100 stretches of 51 words that do have 254 bytes or
#: more (sf0.1). Strings of 400 bytes, op1's length, would leave half of them.
PASSAGE_BYTES = 250


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this input's labelled rows, scores below 0.5. Null and empty texts score low and stay."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity(model) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: three-word shingles, at most three differing bits. Null, empty and blank texts have fingerprint
    zero and are one component, of which one row stays."""
    return one_of_each(docs, words=3, radius=3)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of PASSAGE_BYTES bytes that occur more than once. No row goes; a text that repeats whole is left empty, and a null
    text becomes empty."""
    return clean_documents(docs, length=PASSAGE_BYTES, spread=129)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources, a row for each pass over a document, in the order of the schedule. Texts without words take no part; other clean
    documents are left out only where their source's target is smaller than the source."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of at most 4096 ids; every id of every row lies in one piece."""
    return digest(pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("suffix_dedup", drop_passages),
    ("mix_sources", mix),
    ("harmonic_packing", pack),
]
#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
