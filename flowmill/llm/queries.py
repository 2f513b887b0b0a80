"""The registered queries of the training-data operators, with their production parameters.

Each ``opN_*`` query applies its operator to the whole table and returns the digest columns; the
operator modules keep the general interfaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowmill.llm.common import table

ORACLE: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_decontaminate(spark, sf_dir):
    from flowmill.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


@query
def op8_token_files(spark, sf_dir):
    from flowmill.llm.token_files import tokenized

    return tokenized(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


@query
def op2_mixing(spark, sf_dir):
    from pyspark.sql import functions as F

    from flowmill.llm.mixing import with_probabilities

    rows = with_probabilities(table(spark, sf_dir, "documents"), share=0.5, rounds=12, keep=["doc_id"])
    mix = F.col("mix")
    return rows.select("doc_id", mix.source.alias("source"), mix.lang.alias("lang"), mix.topic.alias("topic"), mix.n_tokens.alias("n_tokens"), F.round(mix.probability, 6).alias("probability"), mix.sampled.alias("sampled"))


@query
def op3_near_duplicates(spark, sf_dir):
    from flowmill.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=75, words=5)


@query
def op4_language(spark, sf_dir):
    from pyspark.sql import functions as F

    from flowmill.llm.langid import fit, with_language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = fit(docs.where(~held_out))
    rows = with_language(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


@query
def op5_quality(spark, sf_dir):
    from flowmill.llm.quality import fit, judged

    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels")))


@query
def op6_secrets(spark, sf_dir):
    from flowmill.llm.secrets import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


@query
def op7_token_counts(spark, sf_dir):
    from flowmill.llm.token_counts import with_token_counts

    rows = with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.tiktoken"))
    return rows.select("doc_id", "tokens.n_pretokens", "tokens.n_tokens")


@query
def op9_warc(spark, sf_dir):
    from flowmill.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"), shard_bytes=64 << 20, file_bytes=16 << 20)


@query
def op10_tool_calls(spark, sf_dir):
    from flowmill.llm.tool_calls import formatted

    return formatted(table(spark, sf_dir, "conversations"), schemas={}, pair_turns=True)


@query
def op11_spelling_variants(spark, sf_dir):
    from flowmill.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents"))


@query
def op12_exact_duplicates(spark, sf_dir):
    from flowmill.llm.exact import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


@query
def op13_vector_codes(spark, sf_dir):
    from flowmill.llm.vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


def _oracles():
    from flowmill.llm import exact, mixing, tool_calls, vector_codes

    ORACLE["op12_exact_duplicates"] = exact.ORACLE
    ORACLE["op13_vector_codes"] = vector_codes.oracle()

    ORACLE["op10_tool_calls"] = tool_calls.ORACLE
    ORACLE["op2_mixing"] = mixing.oracle(share=0.5, rounds=12)


_oracles()
