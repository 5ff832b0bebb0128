"""Queries over the training-data operators, each over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparktrace.llm import byte_bpe, chat_format, html_extract, lm_score, lsa_decontaminate, ogg_media, simhash_dedup, substring_dedup, suffix_dedup, toxicity
from sparktrace.llm.common import table

CONTROL = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"select cast(-7 as bigint) conv_id, t turn, r role, '{CONTROL}' text from values (0L, 'user'), (1L, 'assistant') v(t, r)")
    return chat_format.digest(chat_format.examples(turns.unionByName(extra)))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), digest=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_media.media(table(spark, sf_dir, "documents"), keep_media=False)


def op2_lsa_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsa_decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents"), digest=True)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_lsa_decontaminate, op3_simhash_dedup, op4_suffix_dedup, op5_toxicity, op6_byte_bpe,
        op7_ogg_media, op8_html_extract, op9_substring_dedup, op10_lm_score,
    )
}

_LEN = "length(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;'))"
ORACLE = {
    "op1_chat_format": f"""
with t as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, t, r, '{CONTROL}' from (values (0, 'user'), (1, 'assistant')) v(t, r)),
n as (
  select *, row_number() over w i, count(*) over (partition by conv_id) n,
    sum(8 + {_LEN.format("replace(role, chr(10), '&#10;')")} + {_LEN.format("text")}) over (w rows unbounded preceding) chars
  from t window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(chars) filter (role = 'assistant' or i = n) as bigint) formatted_chars
from n group by conv_id""",
    "op9_substring_dedup": r"""
with d as (select doc_id, row_number() over () r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
s as (select r, doc_id, ws, unnest(range(1, len(ws) - 11)) i from d),
w as (select r, doc_id, i, sha256(array_to_string(list_slice(ws, i, i + 12), ' ')) h from s),
m as (select h, min(doc_id) least from w group by h),
g as (select distinct r, unnest(range(i, i + 13)) p from w join m using (h) where m.least < w.doc_id),
p as (select r, unnest(ws) word, generate_subscripts(ws, 1) p from d),
k as (select p.r, string_agg(word, ' ' order by p.p) filter (g.p is null) kept, count(g.p) gone from p left join g on p.r = g.r and p.p = g.p group by p.r)
select doc_id, cast(len(ws) as bigint) n_words, coalesce(gone, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join k using (r)""",
}
