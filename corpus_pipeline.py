"""A corpus cleaned for training in five stages; each stage's rows are written as Parquet and read by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return the
columns of ``documents``:

1. language ID learns from the labelled rows of its input and leaves out what it rejects;
2. line dedup takes repeated and near-repeated lines out of the texts;
3. the n-gram Jaccard join leaves one document of each group of near duplicates;
4. mixing repeats or leaves out documents so that sources come near their target weights;
5. byte-level BPE encodes the texts and decodes the ids again.

Odd input: a null text and one without letters go at stage 1, unless there is nothing to learn from, then all rows stay.  An empty text that
later stages make (all lines of a document repeated earlier ones) stays a row with an empty text.  Rows without an id are
judged like others at stage 1, keep all their lines at stage 2, and at stage 3 are held by their texts; of fully repeated rows one
passes stage 3.  Ties go to the smaller id everywhere.  An empty table gives an empty table.  Other columns, whatever their names,
go through to stage 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.byte_bpe import decode, encode
from tandem.llm.common import written
from tandem.llm.language_id import accepted_only, train
from tandem.llm.line_dedup import deduped
from tandem.llm.mixing import mix
from tandem.llm.ngram_join import one_per_component


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted_only(docs, train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduped(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_component(docs, k=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): a row a document that the mix took, copies repeated."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = decode(encode(docs, path), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mixing),
    ("byte-level BPE", byte_bpe),
]

#: The first stage is a learnt model, which SQL can't express; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
