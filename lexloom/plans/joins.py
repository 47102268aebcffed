"""Joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions import legal_text as L
from lexloom.operators import bm25, citations, containment, evaluation, retrieval, tables, vectors
from lexloom.plans import corpus
from lexloom.plans import sql as S
from lexloom.plans.fixtures import base, fx
from lexloom.plans.named import query

C = F.col

FIRST = "first_q AS (SELECT query_id, query_text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM fx_queries) WHERE n = 1)"


def first_queries(spark, d):
    return tables.dedup_first(fx(spark, d, "queries"), "query_id", "pos").select("query_id", "query_text")


@query("j01_enriched_pairs", f"WITH {FIRST}, p AS (SELECT query_id, corpus_id FROM fx_qrels JOIN fx_chunks ON corpus_doc = chunk_id) SELECT query_id, query_text, corpus_id, 1.0::DOUBLE AS score, type AS doc_type, number AS doc_number, year AS doc_year, suffix AS doc_suffix FROM (SELECT *, {S.parts_list('corpus_id')} FROM p JOIN first_q USING (query_id))")
def j01(spark, d):
    pairs = fx(spark, d, "qrels").join(fx(spark, d, "chunks"), C("corpus_doc") == C("chunk_id")).select("query_id", "corpus_id", F.lit(None).cast("double").alias("score"))
    return tables.enriched_pairs(pairs, first_queries(spark, d))


@query("j02_segment_chunks", "SELECT vec_id AS faiss_id, coalesce(chunk_id, vec_id) AS chunk_id, coalesce(part, 0) AS part FROM embeddings LEFT JOIN (SELECT faiss_id, chunk_id, part FROM fx_segments WHERE faiss_id % 7 <> 0) ON vec_id = faiss_id")
def j02(spark, d):
    known = fx(spark, d, "segments").where("faiss_id % 7 <> 0").select("faiss_id", "chunk_id", "part")
    rows = base(spark, d, "embeddings").select(C("vec_id").alias("faiss_id")).join(known, "faiss_id", "left")
    return rows.select("faiss_id", F.coalesce("chunk_id", "faiss_id").alias("chunk_id"), F.coalesce("part", F.lit(0)).alias("part"))


@query("j03_chunk_records", f"WITH {S.found(5)} SELECT query_id, rank, chunk_id, corpus_id, md5(content) AS content FROM found LEFT JOIN (SELECT chunk_id, corpus_id, CASE WHEN chunk_id % 2 = 0 THEN 'later' ELSE content END AS content FROM fx_chunks) USING (chunk_id)")
def j03(spark, d):
    found = retrieval.retrieve(fx(spark, d, "query_vecs"), fx(spark, d, "segments"), 5).select("query_id", "rank", "chunk_id")
    chunks = fx(spark, d, "chunks").withColumn("pos", F.lit(0))
    twice = chunks.unionByName(chunks.where("chunk_id % 2 = 0").withColumns({"content": F.lit("later"), "pos": F.lit(1)}))
    return retrieval.chunk_records(found, twice, "pos").select("query_id", "rank", "chunk_id", "corpus_id", F.md5("content").alias("content"))


NEG = f"""{S.BM25},
pos AS (SELECT DISTINCT query_id, corpus_doc AS doc_id FROM fx_qrels),
neg AS (SELECT query_id, doc_id, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM bm ANTI JOIN pos USING (query_id, doc_id)) WHERE n <= 10)"""


def ranked(spark, d):
    docs = base(spark, d, "documents").select("doc_id", "text")
    queries = base(spark, d, "benchmark").select(C("item_id").alias("query_id"), C("text").alias("query_text"))
    return queries, docs, bm25.ranking(queries, bm25.tokenised(docs))


def positives(spark, d):
    held = containment.holding(base(spark, d, "documents"), base(spark, d, "benchmark"))
    return held.select(C("item_id").alias("query_id"), "doc_id").distinct()


@query("j04_triplets", f"WITH {NEG} SELECT query_id, q.query_text, pos.doc_id AS positive_id, d.text AS positive_text, l.ids AS negative_ids, md5(l.texts) AS negatives FROM pos JOIN q USING (query_id) JOIN documents d USING (doc_id) JOIN (SELECT query_id, string_agg(cast(doc_id AS string), ',' ORDER BY rank) AS ids, string_agg(text, '|' ORDER BY rank) AS texts FROM neg JOIN documents USING (doc_id) GROUP BY 1) l USING (query_id)")
def j04(spark, d):
    queries, docs, found = ranked(spark, d)
    pos = positives(spark, d)
    rows = bm25.triplets(queries, pos, bm25.hard_negatives(found, pos), docs)
    return rows.select("query_id", "query_text", "positive_id", "positive_text", F.array_join(F.transform("negative_ids", lambda x: x.cast("string")), ",").alias("negative_ids"), F.md5(F.array_join("negative_texts", "|")).alias("negatives"))


@query("j05_hard_negatives", f"WITH {NEG} SELECT * FROM neg")
def j05(spark, d):
    return bm25.hard_negatives(ranked(spark, d)[2], positives(spark, d))


@query("j06_resolved_acts", f"WITH {corpus.REGISTRY_SQL}, c AS (SELECT chunk_id, {S.act_code(S.code_of('corpus_id'))} AS code FROM fx_chunks) SELECT chunk_id, code, official_title, issuer FROM c LEFT JOIN registry ON code = act_code")
def j06(spark, d):
    rows = fx(spark, d, "chunks").select("chunk_id", L.act_code(L.code_of(C("corpus_id"))).alias("code"))
    return tables.resolved(rows, corpus.s08(spark, d), "code").select("chunk_id", "code", "official_title", "issuer")


@query("j06_missing_acts", f"WITH {corpus.REGISTRY_SQL} SELECT DISTINCT {S.act_code(S.code_of('corpus_id'))} AS code FROM fx_chunks WHERE {S.act_code(S.code_of('corpus_id'))} NOT IN (SELECT act_code FROM registry WHERE act_code NOT LIKE '%/QH13')")
def j06b(spark, d):
    codes = fx(spark, d, "chunks").select(L.act_code(L.code_of(C("corpus_id"))).alias("code")).distinct()
    known = corpus.s08(spark, d).where("act_code NOT LIKE '%/QH13'")
    return codes.join(known.select(C("act_code").alias("code")), "code", "left_anti")


@query("j07_still_to_do", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels UNION SELECT page_id FROM pages)")
def j07(spark, d):
    done = base(spark, d, "labels").select("doc_id").union(base(spark, d, "pages").select("page_id")).distinct()
    return base(spark, d, "documents").select("doc_id").join(done, "doc_id", "left_anti")


_SUFFIX = S.parts("corpus_id")["suffix"]


@query("j08_article_chunks", f"SELECT {S.lookup_key(S.code_of('corpus_id'))} AS key, cast({_SUFFIX} AS INT) AS article, string_agg(cast(chunk_id AS string), ',' ORDER BY chunk_id) AS chunk_ids FROM fx_chunks WHERE {_SUFFIX} <> '' GROUP BY 1, 2")
def j08(spark, d):
    rows = fx(spark, d, "chunks").select("chunk_id", "corpus_id", L.parse_corpus_id(C("corpus_id"))["suffix"].alias("suffix"))
    return tables.reverse_index(rows).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query("j09_judged_hits", f"WITH {S.hits(20)} SELECT h.query_id, faiss_id, rank, (s.label = v.label)::INT AS rel FROM hits h JOIN fx_segments s USING (faiss_id) JOIN fx_query_vecs v ON v.query_id = h.query_id")
def j09(spark, d):
    return judged_hits(spark, d, 20).select("query_id", "faiss_id", "rank", "rel")


def vector_hits(spark, d, k):
    return vectors.top_k(fx(spark, d, "query_vecs"), fx(spark, d, "segments"), k)


def labels(spark, d):
    """The labels of query vectors and of segments: a segment is relevant to the queries that have its label."""
    return fx(spark, d, "query_vecs").select("query_id", "label"), fx(spark, d, "segments").select("faiss_id", "label")


def judged_hits(spark, d, k):
    return evaluation.judged_by_label(vector_hits(spark, d, k), *labels(spark, d), "faiss_id")


@query("j10_inner_products", f"SELECT query_id, faiss_id, {S.dot('q', 'embedding')} AS score FROM fx_query_vecs CROSS JOIN fx_segments")
def j10(spark, d):
    return vectors.inner_products(fx(spark, d, "query_vecs"), fx(spark, d, "segments"))


@query("j11_bm25_scores", f"WITH {S.BM25} SELECT query_id, doc_id, score FROM bms")
def j11(spark, d):
    queries = base(spark, d, "benchmark").select(C("item_id").alias("query_id"), C("text").alias("query_text"))
    return bm25.scores(queries, bm25.tokenised(base(spark, d, "documents").select("doc_id", "text")))


_NAMES = "SELECT p_partkey AS pos, 'act' || p_partkey AS act_code, 2000 + p_partkey % 20 AS year, CASE p_partkey % 4 WHEN 0 THEN 'luat ' WHEN 1 THEN 'bo luat ' WHEN 2 THEN 'nghi dinh ' ELSE 'thong tu ' END || lower(p_type) || ' ' || p_size AS name FROM part"
_MENTIONS = "SELECT s_suppkey AS mention_id, 2000 + s_suppkey % 20 AS year_hint, CASE s_suppkey % 3 WHEN 0 THEN 'luat' WHEN 1 THEN 'nghi dinh' END AS kind, (SELECT any_value(lower(p_type)) FROM part WHERE p_partkey = s_suppkey) || ' ' || s_suppkey % 50 AS core FROM supplier"


@query("j12_named_acts", f"""WITH acts AS ({_NAMES}), m AS ({_MENTIONS}),
k AS (SELECT *, CASE WHEN starts_with(name, 'bo luat') THEN 'bo luat' WHEN starts_with(name, 'luat') THEN 'luat' WHEN starts_with(name, 'nghi dinh') THEN 'nghi dinh' ELSE 'thong tu' END AS name_kind FROM acts),
p AS (SELECT mention_id, act_code, year, year_hint, core, name, len(list_intersect(list_distinct(string_split(core, ' ')), list_distinct(string_split(name, ' ')))) AS common FROM m JOIN k ON m.kind IS NULL OR m.kind = name_kind OR (m.kind = 'luat' AND name_kind = 'bo luat')),
s AS (SELECT *, CASE WHEN contains(name, core) THEN length(core) WHEN contains(core, name) THEN length(name) ELSE common END - CASE WHEN year <> year_hint THEN 1 ELSE 0 END AS score FROM p WHERE common > 0)
SELECT mention_id, act_code, score FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, year DESC, act_code) AS n FROM s) WHERE n = 1""")
def j12(spark, d):
    part, supplier = base(spark, d, "part"), base(spark, d, "supplier")
    kind = F.element_at(F.array(*map(F.lit, ("Luật ", "Bộ luật ", "Nghị dinh ", "Thông tư "))), (C("p_partkey") % 4 + 1).cast("int"))
    acts = part.select(F.concat(F.lit("act"), C("p_partkey").cast("string")).alias("act_code"), (2000 + C("p_partkey") % 20).alias("year"), F.concat(kind, C("p_type"), F.lit(" "), C("p_size").cast("string")).alias("act_name"), F.lit("").alias("official_title"))
    said = F.when(C("s_suppkey") % 3 == 0, "Luật ").when(C("s_suppkey") % 3 == 1, "Nghị dinh về ").otherwise("")
    mentions = supplier.join(part, C("p_partkey") == C("s_suppkey")).select(C("s_suppkey").alias("mention_id"), (2000 + C("s_suppkey") % 20).alias("year_hint"), F.concat(said, C("p_type"), F.lit(" "), (C("s_suppkey") % 50).cast("string"), F.lit(" năm")).alias("window"))
    return citations.name_matches(mentions, acts)


# ---------------------------------------------------------------- windows


@query("w01_dense_ids", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents")
def w01(spark, d):
    return tables.numbered(base(spark, d, "documents").select("doc_id"), "doc_id", "n", rows=64)


@query("w02_part_numbers", "SELECT chunk_id, faiss_id, row_number() OVER (PARTITION BY chunk_id ORDER BY faiss_id) AS part FROM fx_segments")
def w02(spark, d):
    own = fx(spark, d, "segments").groupBy("chunk_id").agg(F.array_sort(F.collect_list("faiss_id")).alias("ids"))
    return own.select("chunk_id", F.posexplode("ids").alias("i", "faiss_id")).select("chunk_id", "faiss_id", (C("i") + 1).alias("part"))


@query("w03_first_and_last", "SELECT query_id, arg_min(query_text, pos) AS first_text, arg_max(query_text, pos) AS last_text FROM fx_queries GROUP BY 1")
def w03(spark, d):
    q = fx(spark, d, "queries")
    first, last = (f(q, "query_id", "pos").select("query_id", C("query_text").alias(n)) for f, n in ((tables.dedup_first, "first_text"), (tables.dedup_last, "last_text")))
    return first.join(last, "query_id")


@query("w04_budget", "SELECT conv_id, turn, substring(text, 1, greatest(0, least(length(text), 500 - before))::INT) AS taken FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)")
def w04(spark, d):
    return retrieval.budgeted(base(spark, d, "conversations"), ["conv_id"], ["turn"], "text", 500).select("conv_id", "turn", "taken")


@query("w08_ranks", f"WITH {S.hits(10)} SELECT query_id, faiss_id, score, rank FROM hits")
def w08(spark, d):
    return vector_hits(spark, d, 10).select("query_id", "faiss_id", "score", "rank")


@query("w09_first_relevant", f"WITH {S.hits(50)} SELECT h.query_id, min(CASE WHEN s.label = v.label THEN rank END) AS first_rank FROM hits h JOIN fx_segments s USING (faiss_id) JOIN fx_query_vecs v ON v.query_id = h.query_id GROUP BY 1")
def w09(spark, d):
    judged = judged_hits(spark, d, 50)
    return judged.groupBy("query_id").agg(F.min(F.when(C("rel") == 1, C("rank"))).alias("first_rank"))


@query("w10_trailing_counts", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM fx_requests")
def w10(spark, d):
    rows = fx(spark, d, "requests").withColumn("us", F.unix_micros(C("ts").cast("timestamp")))
    return rows.select("event_id", "user_id", F.count("*").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)).alias("n"))


# ---------------------------------------------------------------- sets


@query("u01_union_ids", "SELECT doc_id FROM labels UNION SELECT page_id FROM pages")
def u01(spark, d):
    return base(spark, d, "labels").select("doc_id").union(base(spark, d, "pages").select("page_id")).distinct()


@query("u02_appended", "SELECT doc_id, coalesce(quality, -1) AS quality FROM (SELECT doc_id, quality FROM labels UNION ALL SELECT page_id, NULL FROM pages)")
def u02(spark, d):
    return base(spark, d, "labels").select("doc_id", "quality").unionByName(base(spark, d, "pages").select(C("page_id").alias("doc_id")), allowMissingColumns=True).fillna(-1, ["quality"])


@query("u03_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u03(spark, d):
    return base(spark, d, "documents").select("doc_id").exceptAll(base(spark, d, "labels").select("doc_id").distinct())


@query("u04_shared_tokens", f"SELECT conv_id, turn, len(list_intersect(list_distinct({S.tokens('answer')}), list_distinct({S.tokens('context')}))) AS n FROM fx_answers WHERE context IS NOT NULL")
def u04(spark, d):
    rows = fx(spark, d, "answers").where("context IS NOT NULL")
    return rows.select("conv_id", "turn", F.size(F.array_intersect(L.tokens(C("answer")), L.tokens(C("context")))).alias("n"))


@query("u05_ordered_distinct", f"SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS tokens FROM (SELECT doc_id, t, min(i) AS i FROM (SELECT doc_id, unnest({S.tokens('text')}) AS t, generate_subscripts({S.tokens('text')}, 1) AS i FROM documents) GROUP BY 1, 2) GROUP BY 1")
def u05(spark, d):
    rows = base(spark, d, "documents").select("doc_id", L.tokens(C("text")).alias("t")).where(F.size("t") > 0)
    return rows.select("doc_id", F.array_join(F.array_distinct("t"), " ").alias("tokens"))


@query("u06_sorted_ids", f"SELECT DISTINCT {S.code_of('corpus_id')} AS code FROM fx_chunks ORDER BY 1")
def u06(spark, d):
    return fx(spark, d, "chunks").select(L.code_of(C("corpus_id")).alias("code")).distinct().orderBy("code")
