"""The queries of this subpackage by name, and the SQL that some of them can be held against."""

from __future__ import annotations

import public_tokenizers

from lexloom.llm import conversation_repair, graph_search, jaccard_join, language_id, mixing, near_vectors, personal_data, piece_codec, repeated_passages, threshold_search, token_store, url_reputation, weak_quality
from lexloom.llm.common import table


def op1_piece_codec(spark, sf_dir):
    return piece_codec.piece_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_personal_data(spark, sf_dir):
    return personal_data.find_personal_data(table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op2_near_vectors(spark, sf_dir):
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_graph_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return graph_search.nearest(rows, rows.where("vec_id % 100 = 0"))


def op3_token_store(spark, sf_dir):
    return token_store.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_url_reputation(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    keyed = pages.select("page_id", "url", url_reputation.label_key_of(pages["url"]).alias("label_key"))
    return url_reputation.judge_urls(keyed, url_reputation.bad_outcomes(table(spark, sf_dir, "labels")))


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op9_weak_quality(spark, sf_dir):
    return weak_quality.quality(table(spark, sf_dir, "documents"))


def op11_repeated_passages(spark, sf_dir):
    return repeated_passages.repeated_digest(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark, sf_dir):
    return conversation_repair.repair_digest(table(spark, sf_dir, "conversations"))


def op13_threshold_search(spark, sf_dir):
    return threshold_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_piece_codec": op1_piece_codec, "op3_token_store": op3_token_store, "op2_near_vectors": op2_near_vectors, "op4_graph_search": op4_graph_search, "op5_personal_data": op5_personal_data, "op6_language_id": op6_language_id, "op7_mixing": op7_mixing, "op8_url_reputation": op8_url_reputation, "op9_weak_quality": op9_weak_quality, "op10_jaccard_join": op10_jaccard_join, "op11_repeated_passages": op11_repeated_passages, "op12_conversation_repair": op12_conversation_repair, "op13_threshold_search": op13_threshold_search}
ORACLE_SQL = {"op8_url_reputation": url_reputation.ORACLE, "op11_repeated_passages": repeated_passages.ORACLE, "op13_threshold_search": threshold_search.ORACLE}
