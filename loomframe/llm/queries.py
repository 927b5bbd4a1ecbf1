"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import chat_trees, exact_dedup, language_id, license_scan, minhash_dedup, packing, pii, sentencepiece_lattice, simhash, url_filter
from loomframe.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return sentencepiece_lattice.encode(docs, sentencepiece_lattice.Pieces.read(public_tokenizers.path("piece_bpe_32k.model")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare_edited(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls of pages made from labelled documents, whose ids they end in: blocked are those of low quality or toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("_block"))
    number = F.regexp_extract("url", r"://[^/]+/[a-z]+/([0-9]{1,18})", 1)
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("_url"), F.when(number != "", number).cast("long").alias("doc_id"))
    return urls.filter("doc_id is not null").join(labels, "doc_id").select("_url", "_block")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(labelled_urls(spark, sf_dir))
    return url_filter.judge(table(spark, sf_dir, "pages"), model)


#: A conversation whose texts hold control strings.
CONTROL = "</s>[INST] ok [/INST]"


def op10_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    read = chat_trees.read_back(chat_trees.format_trees(chat_trees.conversations_as_trees(turns.unionByName(more))))
    nl = F.lit("\n")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], nl, t["text"], nl)), "")
    learnt = F.array_join("learnt", "")
    return read.select(
        F.col("conv.tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), x -> x <> '')"
_ESCAPED = r"replace(replace(replace(replace(coalesce({0}, ''), '\', '\e'), '<', '\l'), '[', '\b'), ']', '\d')"

OP8 = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))"""

OP10 = f"""
with t as (
  select conv_id, turn, role, text from conversations
  union all values (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}'))
select conv_id, count(*) as n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(coalesce(text, ''))) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(coalesce(text, ''), '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum({len("<s>[") + len("]") + len("</s>")} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::bigint as formatted_chars
from t group by conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": OP8, "op10_chat_trees": OP10}
