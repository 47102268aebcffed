"""A corpus pipeline of training-data operators over the table documents.

STAGES are (name, function); each function takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame.  run() writes each stage's result as Parquet and reads it back as the next one's docs.  All
stages but the last return the columns of documents.

language         documents whose text is null or has no letter, or of which no known language is likelier than
                 LEAST_SCORE, go
near_duplicates  of each class of linked documents the one with the smallest doc_id stays
personal_data    spans of personal data give way to their kind in brackets
mixing           words are taken from the sources by target weights; a document may come once or twice, whole or cut
pieces           doc_id, source, lang, n_pieces, piece_ids of every document

Null texts and repeated rows: see the operators.  An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import jaccard_join, language_id, mixing, personal_data, piece_codec
from lexloom.llm.common import dropped, free, stored

#: Four languages and no evidence give 0.25; clean texts, mixed ones included, stay far above.
LEAST_SCORE = 0.3
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lang, score = free(docs.columns, "lang_pred"), free(docs.columns, "score")
    judged = language_id.predict(docs, language_id.fit(docs), to=(lang, score))
    return judged.where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each_class(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal_data.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = piece_codec.encode_pieces(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "source", "lang", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", private), ("mixing", mixed), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(before)  # of the stage before, not the input
    return docs
