"""A corpus pipeline of five stages, each one operator on all that the stage before kept.

Rows without a doc_id are documents like any other that are nobody's near duplicate.
Repeated rows are repeated documents; ties go to the smaller doc_id. An empty table stays
empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.llm import jaccard_join, language_id, mixing, packing, substring_dedup
from rippletrace.llm.common import stored
from rippletrace.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is rejected if no language labels this share of its letters.
LEAST_SHARE = 0.34


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters or without a leading language; a missing lang becomes the predicted one.

    Null and empty texts have no letters and go; a null doc_id and repeated rows stay as they are.
    """
    model = language_id.train(docs)
    found = language_id.identify(docs.select(*COLUMNS), model, spans=False)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by word 5-gram Jaccard similarity 0.8 the least doc_id stays.

    Texts without a doc_id all stay, as do null and empty texts, which link with nothing; rows
    that repeat the least doc_id stay with it.
    """
    found = jaccard_join.jaccard_components(docs, k=5, percent=80)
    stay = found.filter("doc_id = component_id").select("doc_id").distinct()
    known = docs.select(*COLUMNS).filter("doc_id IS NOT NULL").join(stay.hint("merge"), "doc_id", "left_semi")
    return known.unionByName(docs.select(*COLUMNS).filter("doc_id IS NULL"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 50 words that also start earlier (smaller doc_id, then place); texts of which nothing is left go.

    Null and empty texts have no words and stay; rows that repeat a doc_id at the same place take nothing from each other.
    """
    out = substring_dedup.dedup(docs, window=50, carry=COLUMNS[1:])
    return (
        out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
        .filter("n_removed = 0 OR n_removed < n_words")
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .select(*COLUMNS)
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights.

    A null source is a source; documents without words weigh nothing and stay out.
    """
    return mixing.mixed_rows(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack into sequences of 2048 tokens; every row is placed, a null text as an empty one."""
    return packing.pack(stored(packing.pieces(docs, tokenizer_path()), "pieces"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the language model, the random order of the mix or the packing; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
