"""Vectors, rankings and answers over retrieved chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import legal_text as L
from lexloom.operators import bm25_index, encoding, retrieval, tables, vectors
from lexloom.plans import aggregates, joins
from lexloom.plans import sql as S
from lexloom.plans.fixtures import base, fx
from lexloom.plans.named import query

C = F.col


@query("v01_normalised", "SELECT vec_id, array_to_string(list_transform(e, lambda x: printf('%.4f', abs(round(x / CASE WHEN n = 0 THEN 1 ELSE n END, 4)))), ' ') AS v FROM (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e FROM embeddings))")
def v01(spark, d):
    rows = base(spark, d, "embeddings").select("vec_id", vectors.normalised(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return rows.select("vec_id", F.array_join(F.transform("v", lambda x: F.format_string("%.4f", F.abs(F.round(x, 4)))), " ").alias("v"))


@query("v03_self_products", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM embeddings")
def v03(spark, d):
    return base(spark, d, "embeddings").select("vec_id", F.round(vectors.dot(C("embedding"), C("embedding")), 6).alias("score"))


def _latent(docs):
    return encoding.latent(docs, size=32, bits=14, rounds=6, near=1e-3)[0]


@query("v04_encoded_texts")
def v04(spark, d):
    docs = base(spark, d, "documents").select("doc_id", "text")
    return vectors.encoded(docs, _latent(docs)).select("doc_id", "embedding")


@query("v05_encoded_search")
def v05(spark, d):
    import public_tokenizers

    docs = base(spark, d, "documents").select(C("doc_id").alias("faiss_id"), "text")
    encode = _latent(docs)
    asking = vectors.careful(encode, public_tokenizers.path("byte_bpe_50k.json"))
    chunks = vectors.encoded(docs, encode).select("faiss_id", vectors.normalised(C("embedding")).alias("embedding"))
    asked = vectors.encoded(base(spark, d, "benchmark").select(C("item_id").alias("query_id"), "text"), asking, to="q").select("query_id", "q")
    return vectors.top_k(asked, chunks, 10)


@query("ml01_training")
def ml01(spark, d):
    """Epochs of training on the documents' beginnings and the train items' positives, judged on the dev items."""
    docs, items = base(spark, d, "documents").select("doc_id", "text"), base(spark, d, "benchmark")
    dev = tables.hash_split(items.select("item_id"), "item_id", 0.1)
    relevant = tables.written(joins.positives(spark, d).select("query_id", "doc_id"), "relevant")
    named = items.select(C("item_id").alias("query_id"), "text")
    known = relevant.join(dev.where("NOT dev").select(C("item_id").alias("query_id")), "query_id").join(named, "query_id").withColumnRenamed("text", "query").join(docs, "doc_id")
    words = F.split(F.trim(F.regexp_replace("text", "\\s+", " ")), " ")
    begun = docs.where(F.size(words) >= 48).select(F.array_join(F.slice(words, 1, 24), " ").alias("query"), F.array_join(F.slice(words, 25, 2_000_000_000), " ").alias("positive"))
    pairs = begun.unionByName(known.select("query", C("text").alias("positive")))
    asked = named.join(dev.where("dev").select(C("item_id").alias("query_id")), "query_id", "left_semi")
    start = encoding.unlearnt(docs, size=32, bits=14)
    rows = tables.written(encoding.weighed(docs, start, x="text"), "rows")
    _, history = encoding.train(pairs, start, encoding.Plan(epochs=3, steps=3), lambda e: encoding.recall_of(e, asked, rows, relevant))
    tables.forgotten(rows)
    return spark.createDataFrame(history, "epoch int, loss double, recall double, best boolean")


@query("v06_score_matrix", f"SELECT query_id AS a, vec_id AS b, {S.dot('q', 'embedding')} AS score FROM fx_query_vecs CROSS JOIN embeddings")
def v06(spark, d):
    found = vectors.inner_products(fx(spark, d, "query_vecs"), base(spark, d, "embeddings"), "vec_id")
    return found.select(C("query_id").alias("a"), C("vec_id").alias("b"), "score")


_FOUND = "SELECT query_id, rank, chunk_id, score, score_max, score_mean, n_segments FROM found"


@query("t01_retrieve", f"WITH {S.found(5)} {_FOUND}")
def t01(spark, d):
    return retrieval.retrieve(fx(spark, d, "query_vecs"), fx(spark, d, "segments"), 5)


@query("t02_bm25_top", f"WITH {S.BM25} SELECT query_id, doc_id, score, rank FROM bm")
def t02(spark, d):
    return joins.ranked(spark, d)[2]


@query("t03_chunk_ranking", f"WITH {S.found(20)} {_FOUND}")
def t03(spark, d):
    return retrieval.retrieve(fx(spark, d, "query_vecs"), fx(spark, d, "segments"), 20)


@query("t02_bm25_stored", f"WITH {S.BM25} SELECT query_id, doc_id, score, rank FROM bm")
def t02s(spark, d):
    """The same ranking out of an index that is written first."""
    from lexloom.session import scratch

    path = scratch(spark, "bm25")
    bm25_index.build(base(spark, d, "documents"), path)
    asked = base(spark, d, "benchmark").select(C("item_id").alias("query_id"), C("text").alias("query_text"))
    return bm25_index.ranking(spark, path, asked).withColumnRenamed("key", "doc_id")


@query("t04_batch_top_k", f"WITH s AS (SELECT query_id, faiss_id, {S.dot('q', 'embedding')} AS score FROM fx_query_vecs CROSS JOIN fx_segments) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, faiss_id) AS rank FROM s) WHERE rank <= 100")
def t04(spark, d):
    return joins.vector_hits(spark, d, 100).select("query_id", "faiss_id", "score", "rank")


@query("t05_best_articles", f"WITH {S.entries(30)} SELECT query_id, act_code, article, score, n AS place FROM (SELECT query_id, act_code, article, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, act_code, article) AS n FROM entries) WHERE n <= 5")
def t05(spark, d):
    from pyspark.sql import Window

    rows = retrieval.articles(aggregates.chunk_hits(spark, d, 30))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(C("score").desc(), "act_code", "article"))
    return rows.select("query_id", "act_code", "article", "score", place.alias("place")).where("place <= 5")


@query("t07_ordered_limit", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def t07(spark, d):
    return base(spark, d, "documents").select("doc_id", "n_chars").orderBy(C("n_chars").desc(), "doc_id").limit(25)


@query("t08_head_lines", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:3], '|') AS head FROM documents")
def t08(spark, d):
    return base(spark, d, "documents").select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 1, 3), "|").alias("head"))


# ---------------------------------------------------------------- contexts and answers


_PIECES = f"""{S.entries(30)}, ranked AS (SELECT query_id, act_code, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, max(best) DESC, act_code) AS act_rank FROM entries GROUP BY 1, 2),
texts AS (SELECT {S.lookup_key(S.code_of('corpus_id'))} AS key, cast({S.parts('corpus_id')['suffix']} AS INT) AS article, string_agg({S.shown('content')}, chr(10) || chr(10) ORDER BY chunk_id) AS text FROM fx_chunks WHERE {S.parts('corpus_id')['suffix']} <> '' AND {S.shown('content')} <> '' GROUP BY 1, 2),
pieces AS (SELECT e.query_id, act_rank, 'Văn bản: ' || e.act_code AS header, row_number() OVER (PARTITION BY e.query_id, e.act_code ORDER BY e.score DESC, e.article) AS article_rank, e.article, t.text FROM entries e JOIN ranked r USING (query_id, act_code) JOIN texts t ON t.key = {S.lookup_key('e.act_code')} AND t.article = e.article)"""
_CONTEXT = f"""{_PIECES}, cut AS (SELECT *, substring(text, 1, greatest(0, least(length(text), 4000 - before))::INT) AS taken FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY query_id, act_rank ORDER BY article_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pieces)),
blocks AS (SELECT query_id, act_rank, header || chr(10) || string_agg('Điều ' || article || chr(10) || taken, chr(10) || chr(10) ORDER BY article_rank) AS b FROM cut WHERE taken <> '' GROUP BY 1, 2, header),
ctx AS (SELECT query_id, substring(string_agg(b, chr(10) || chr(10) ORDER BY act_rank), 1, 20000) AS context FROM blocks GROUP BY 1)"""


#: Characters of an act in a context.
ACT_CHARS = 4000


def contexts(spark, d):
    from pyspark.sql import Window

    from lexloom.operators import citations

    # read three times
    entries = tables.written(retrieval.articles(aggregates.chunk_hits(spark, d, 30)), "entries")
    ranks = retrieval.acts(entries).select("query_id", "act_code", C("rank").alias("act_rank"))
    place = F.row_number().over(Window.partitionBy("query_id", "act_code").orderBy(C("score").desc(), "article"))
    rows = entries.join(ranks, ["query_id", "act_code"]).withColumn("article_rank", place).withColumn("key", L.lookup_key(C("act_code")))
    # an act's articles share ACT_CHARS, so no more of a text goes to the queries that found it
    texts = citations.article_texts(fx(spark, d, "chunks"), ACT_CHARS, rows).withColumn("text", F.substring("text", 1, ACT_CHARS))
    pieces = rows.join(texts, ["key", "article"]).select("query_id", "act_rank", F.concat(F.lit("Văn bản: "), "act_code").alias("header"), "article_rank", "article", "text")
    return retrieval.contexts(pieces, ACT_CHARS, 20_000)


@query("x15_contexts", f"WITH {_CONTEXT} SELECT * FROM ctx")
def x15(spark, d):
    return contexts(spark, d)


@query("llm1_prompts", f"WITH {_CONTEXT} SELECT query_id, {S.lit(retrieval.INSTRUCTION)} || 'Ngữ cảnh:' || chr(10) || context || chr(10) || chr(10) || 'Câu hỏi: q' || query_id AS prompt FROM ctx")
def llm1(spark, d):
    return contexts(spark, d).select("query_id", retrieval.prompt(F.concat(F.lit("q"), C("query_id").cast("string")), C("context")).alias("prompt"))


_SIMILAR = "likeness AS (SELECT query_id, act_code, article, round(greatest(0.0, least((score + 1) / 2, 1.0)), 9) AS score FROM entries)"


@query("llm1_answers", f"WITH {_CONTEXT} SELECT query_id, upper(md5({S.lit(retrieval.INSTRUCTION)} || 'Ngữ cảnh:' || chr(10) || context || chr(10) || chr(10) || 'Câu hỏi: q' || query_id)) AS answer, 1::BIGINT AS tries FROM ctx")
def llm1a(spark, d):
    """Prompts that a plugged generator answers, here with a digest of what it was asked."""
    import hashlib

    from lexloom.operators import calls
    from lexloom.session import scratch

    generate = lambda prompt: hashlib.md5(prompt.encode()).hexdigest().upper()
    found = calls.run_pending(tables.written(llm1(spark, d), "prompts"), scratch(spark, "answers"), generate, "query_id", "prompt", calls.Policy(slices=2))
    return found.select("query_id", C("value").alias("answer"), "tries")


@query("f06_above_threshold", f"WITH {S.entries(30)}, {_SIMILAR}, {aggregates.threshold_sql('likeness', *retrieval.LEVELS['moderate'])} SELECT s.query_id, s.act_code, s.article FROM likeness s JOIN (SELECT DISTINCT query_id, threshold_used FROM passed) p ON p.query_id = s.query_id AND s.score >= p.threshold_used")
def f06(spark, d):
    """Articles that reach the threshold at which the query's own search for it ended."""
    rows = retrieval.articles(aggregates.chunk_hits(spark, d, 30)).withColumn("score", F.round(L.similarity(C("score")), 9))
    used = retrieval.adaptive_threshold(rows).select("query_id", "threshold_used").distinct()
    return rows.join(used, "query_id").where("score >= threshold_used").select("query_id", "act_code", "article")


@query("api1_sources", "SELECT chunk_id, corpus_id, content FROM fx_chunks WHERE chunk_id IN (SELECT item_id FROM benchmark)")
def api1(spark, d):
    asked = base(spark, d, "benchmark").select(C("item_id").alias("chunk_id"))
    return fx(spark, d, "chunks").join(asked, "chunk_id", "left_semi").select("chunk_id", "corpus_id", "content")
