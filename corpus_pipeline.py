"""A training corpus from raw documents: the stages, in order.

Each stage takes all that the one before it kept; its result is written as Parquet and read again.
The first four return the columns of ``documents``, extra ones of any name included; the last returns
the token files' documents. An empty table passes through all stages and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.llm.common import fresh_name, saved, table
from flowmill.llm.decontaminate import decontaminated
from flowmill.llm.langid import fit, with_language
from flowmill.llm.minhash import deduplicated
from flowmill.llm.mixing import mixed
from flowmill.llm.queries import tokenizer_path
from flowmill.llm.token_files import tokenized

#: A document is rejected if it has no letter or no language holds this share of its letters.
LEAST_LANGUAGE_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets ``lang`` to the predicted language; documents without a clear one go.

    Learns from the texts whose ``lang`` is not null. Null, empty and letterless texts have no language
    and go, as does a text of which no language holds half of the letters; without any label all go.
    Ties take the language that sorts first; repeated rows and null ids are judged like any other; long
    texts are read whole.
    """
    name = fresh_name(docs, "language")
    rows = with_language(docs, fit(docs), out=name).where((F.col(f"{name}.lang") != "und") & (F.col(f"{name}.score") >= LEAST_LANGUAGE_SHARE))
    return rows.select(*(F.col(f"{name}.lang").alias("lang") if c == "lang" else F.col(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id.

    Null, empty and blank texts are like nothing else and stay; a null id can't be linked and stays; rows
    that share an id are one document and stay or go together; long texts are compared whole.
    """
    return deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a test item go.

    Null and empty texts hold none and stay; null ids and repeated rows are judged like any other; null
    and wordless items have no window, and without items all documents stay; long texts are read whole.
    """
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by calibrated probabilities.

    Null labels are the label ``unknown``. Null, empty and blank texts have no tokens, probability 0
    and go; repeated rows are decided alike, null ids like the empty string; long texts count whole.
    """
    return mixed(docs, share=0.8)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and their documents as read back.

    Null and empty texts are the end id alone; null ids come first, rows that share an id follow one
    another by text; long texts are encoded whole.
    """
    return tokenized(docs, tokenizer_path(), end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]
#: SQL can't express the first stage; tests/llm/test_pipeline.py holds a brute-force chain.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
