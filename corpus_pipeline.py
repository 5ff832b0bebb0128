"""A training corpus from documents: five stages, each of them one operator of sparktrace.llm over all that the one before kept.

Every stage is written to the folder that driver and executors share and read again, so a lost
executor costs no more than the stage under way. Tables that a stage needed for itself are deleted
once it is written.

In every stage a null or empty text is a document without words, rows of equal or null doc_ids are
judged each by its own text, further columns (whatever their names) are carried along, and an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrace.llm import byte_bpe, lsa_decontaminate, simhash_dedup, substring_dedup, toxicity
from sparktrace.llm.common import freed, scratch, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go, equal texts alike; without labels of both classes none goes."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id; all texts without words are one group."""
    return simhash_dedup.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; a document that loses all keeps its row, with an empty text."""
    kept = substring_dedup.without_repeats(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select([F.col(f"`{c}`") for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or paraphrased, go; items of null, empty or very short text match nothing."""
    return lsa_decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text that they decode to."""
    import public_tokenizers

    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("simhash_dedup", drop_near_copies), ("substring_dedup", drop_repeats), ("decontamination", drop_leaks), ("byte_bpe", tokenize)]

#: The toxicity network can't be expressed in SQL; the stages are tested one by one instead: near copies, repeats and ids
#: against brute force, toxicity by held-out accuracy, leaks by planted items.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for _, stage in STAGES:
        with scratch() as made:
            docs = stored(stage(spark, docs, sf_dir))
        freed(spark, before + made[:-1])
        before = made[-1:]
    return docs
