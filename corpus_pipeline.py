"""A corpus from raw documents to token ids: five stages, each one operator.

Each stage takes all that its predecessor kept and returns the columns of
documents, but for the last, which returns token ids.  Between stages the rows
are written as Parquet and read again.

* language ID drops documents without a language, or hardly like the nearest;
* quality rules remove failed lines and drop documents that fail;
* near-dedup keeps one row of each group, that of the least id, whether or not ids
  repeat or are missing;
* mixing drops documents that the mix doesn't take, repeats those that it takes
  more than once, and cuts the last one of a source to the words it takes (their
  white space becomes single spaces);
* SentencePiece turns texts to ids, checks each batch's against the library's of the
  whole texts, and decodes them again; the digest of the decoded text tells what the
  ids stand for.

Null and empty texts have no language and go in the first stage; a null lang isn't learned
from but its text may stay; a null source is a source.  Very long texts are treated whole,
repeated rows are rows of their own until near-dedup keeps one of them.  Columns that
documents haven't are ignored, whatever their names.  An empty table stays empty through all stages.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import langid, line_rules, minhash, mixing, pieces
from docketry.llm.common import held_out, stored, table, words

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose cosine with every language is smaller has no language: four standard deviations of the cosine of unrelated texts.
LEAST_COSINE = 4 / math.sqrt(langid.DIM)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    langs, prototypes = langid.learn(docs.filter(~held_out()))
    found = langid.identify(docs, langs, prototypes)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_COSINE)).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_rules.clean_lines(docs.select(*COLUMNS)).filter("kept")
    return kept.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = minhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row")
    kept = found.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(first).select("row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(docs.select(*COLUMNS)).filter("taken > 0")
    copies = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")))))
    left = F.least("size", F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    cut = F.array_join(F.slice(words("text"), F.lit(1), left.cast("int")), " ")
    text = F.when(left == F.col("size"), F.col("text")).otherwise(cut)
    return copies.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = docs.select("doc_id", "lang", "source", "text")
    return pieces.encode_texts(docs, path, ("ids", "n_tokens", "ids_sha256", "decoded_sha256"), check="texts", keep=("doc_id", "lang", "source"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mix_sources", mix),
    ("sentencepiece", sentencepiece),
]

#: Hyperdimensional profiles and SentencePiece have no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
