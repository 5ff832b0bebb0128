"""Nulls beside large ids, repeated ids, ties and clashing names, for every operator and pipeline stage."""

import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparktrace.llm import byte_bpe, html_extract, lm_score, lsa_decontaminate, ogg_media, simhash_dedup, substring_dedup, suffix_dedup, toxicity
from sparktrace.llm.common import shared_dir

BIG = 2**53 + 1
RNG = random.Random(21)
LONG = " ".join(f"w{RNG.randrange(10**5)}" for _ in range(30_000))
ROWS = [(BIG, "alpha beta"), (None, "gamma delta"), (BIG + 2, None), (None, None), (BIG, "epsilon zeta"), (BIG, "alpha beta"), (5, ""), (6, LONG)]


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    clash = F.when(F.col("doc_id") == BIG, F.lit(BIG))
    return df.withColumns({"unit_of_rows": clash, "n_chars": F.length("text"), "fp": clash, "key": F.lit("k"), "leak_key": F.lit("l"), "kept_id": clash})


@pytest.fixture
def marks(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(BIG, LONG[:400]), (None, LONG[2000:2400]), (3, None)], "item_id long, text string")


def bpe():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


OPERATORS = {
    "op3": lambda d, m: simhash_dedup.near_duplicates(d),
    "op4": lambda d, m: suffix_dedup.without_repeats(d, digest=True),
    "op5": lambda d, m: toxicity.score(d, m),
    "op6": lambda d, m: byte_bpe.encode(d, *bpe()),
    "op7": lambda d, m: ogg_media.media(d),
    "op8": lambda d, m: html_extract.extract(d.selectExpr("doc_id page_id", "'u' url", "text html", "fp text")).withColumnRenamed("page_id", "doc_id"),
    "op9": lambda d, m: substring_dedup.without_repeats(d, digest=True),
    "op9 with columns": lambda d, m: substring_dedup.without_repeats(d),
    "op10": lambda d, m: lm_score.score(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_large_ids_beside_nulls(spark, marks, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = OPERATORS[name](documents(spark), marks).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(d for d, _ in ROWS)
    if "held_out" in got[0].asDict():
        by = {"op5": (5, 0), "op10": (7, 2)}[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % by[0] == by[1]) for r in got)
    if name == "op9 with columns":
        assert all((r.fp, r.unit_of_rows) == ((BIG, BIG) if r.doc_id == BIG else (None, None)) for r in got)


@pytest.mark.parametrize("kind,ids", [("string", ["007", "d8", None, ""]), ("double", [1.5, 40.0, None]), ("int", [3, -4, None])])
def test_scores_keep_ids_of_other_types(spark, kind, ids):
    docs = spark.createDataFrame([(i, None) for i in ids], f"doc_id {kind}, text string")
    for df in (docs, docs.withColumn("text", F.lit(None).cast("int"))):  # a column of nulls alone may be read as numbers
        out = lm_score.score(df)
        assert out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        got = collections.Counter((r.doc_id, r.held_out, r.n_tokens) for r in out.collect())
        assert got == collections.Counter((i, zlib.crc32(str(i).encode()) % 7 == 2, 1) for i in ids)


def test_leaks_with_large_ids(spark, bench):
    got = {(r.doc_id, r.item_id) for r in lsa_decontaminate.leaks(documents(spark, [(BIG, LONG[:500]), (None, LONG[1900:2500]), (4, "other words")]), bench).collect()}
    assert got == {(BIG, BIG), (None, None)}


def test_leaks_go_row_by_row(spark, bench):
    rows = [(1, LONG[:500]), (1, "one two"), (None, LONG[:500]), (None, "three"), (2, None), (2, None), (BIG, "")]
    left = lsa_decontaminate.decontaminated(documents(spark, rows), bench)
    assert collections.Counter((r.doc_id, r.text) for r in left.collect()) == collections.Counter([(1, "one two"), (None, "three"), (2, None), (2, None), (BIG, "")])
    assert left.columns == documents(spark).columns


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, tmp_path, stage):
    """Columns stay, rows of equal or null ids are judged each by its own text, an empty table stays empty."""
    spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, LONG[:400])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = documents(spark)
    out = run(spark, docs, str(tmp_path))
    got = collections.Counter(r.doc_id for r in out.collect())
    want = collections.Counter(d for d, _ in ROWS)
    if stage == "simhash_dedup":  # equal rows leave one, and texts without words are copies of each other
        want = collections.Counter({BIG: 2, None: 1, 5: 1, 6: 1})
    if stage == "decontamination":
        want[6] = 0
    assert +got == +want
    if stage != "byte_bpe":
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(Session())
