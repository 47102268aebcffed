"""Row types of the tables that the engine reads and makes."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(text: str) -> T.StructType:
    """A row type from `name type, name type`; needs no session."""
    fields = [f.strip().rsplit(" ", 1) for f in text.split(",")]
    return T.StructType([T.StructField(name.strip("`"), _TYPES[kind]) for name, kind in fields])


RAW_CORPUS = _struct("_id string, title string, text string")
CHUNKS = _struct("chunk_id bigint, corpus_id string, type string, number string, year string, suffix string, content string, word_count int, preview string")
SEGMENTS = _struct("faiss_id bigint, chunk_id bigint, corpus_id string, type string, number string, year string, suffix string, part int, span_token_start int, span_token_end int")
RAW_QUERIES = _struct("_id string, `query-id` string, query_id string, text string, query string, query_text string")
RAW_PAIRS = _struct("`query-id` string, query_id string, `corpus-id` string, corpus_id string, score double")
ENRICHED_PAIRS = _struct("query_id string, query_text string, corpus_id string, score double, doc_type string, doc_number string, doc_year string, doc_suffix string")
TRIPLETS = _struct("query_id string, query_text string, positive_id string, positive_text string, negative_ids array<string>, negative_texts array<string>")
REGISTRY = _struct("act_code string, act_name string, official_title string, year int, act_type string, issuer string")
RAW_REGISTRY = _struct("act_code string, so_hieu string, act_name string, official_title string, trich_yeu string, year int, act_type string, loai_van_ban string, issuer string, co_quan_ban_hanh string")
CITATIONS = _struct("article int, clause int, point string, act_code_raw string, act_code_norm string, method string, ambiguity boolean, span_start int, span_end int, text_window string")
SMART_CHUNKS = _struct("chunk_id bigint, doc_file string, doc_title string, chapter string, section string, article string, article_heading string, clause string, point string, chunk_index int, content string, word_count int, chunk_type string")
