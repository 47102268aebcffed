"""Aggregations, metrics and rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import legal_text as L
from lexloom.operators import bm25, evaluation, retrieval, structure, tables
from lexloom.plans import extraction, joins
from lexloom.plans import sql as S
from lexloom.plans.fixtures import base, fx
from lexloom.plans.named import query
from lexloom.streaming import rate_limit

C = F.col


def hits_with_parts(spark, d, k):
    return joins.vector_hits(spark, d, k).join(fx(spark, d, "segments").select("faiss_id", "chunk_id", "part"), "faiss_id")


_STRATEGIES = {"topm_mean": S.topm("list(score)", 2), "max": "max(score)", "mean": "avg(score)"}


@query("a01_chunk_scores", f"WITH {S.hits(50)} SELECT query_id, chunk_id, " + ", ".join(f"round({v}, 9) AS {k}" for k, v in _STRATEGIES.items()) + " FROM hits GROUP BY 1, 2")
def a01(spark, d):
    rows = hits_with_parts(spark, d, 50).groupBy("query_id", "chunk_id").agg(F.collect_list("score").alias("s"))
    return rows.select("query_id", "chunk_id", *[F.round(retrieval.combined(C("s"), k), 9).alias(k) for k in _STRATEGIES])


@query("a02_segment_lists", f"WITH {S.hits(50)} SELECT query_id, chunk_id, string_agg(faiss_id || ':' || part, ' ' ORDER BY score DESC, faiss_id) AS segments FROM hits GROUP BY 1, 2")
def a02(spark, d):
    rows = retrieval.segment_lists(hits_with_parts(spark, d, 50))
    return rows.select("query_id", "chunk_id", F.array_join(F.transform("segments", lambda s: F.concat(s["faiss_id"].cast("string"), F.lit(":"), s["part"].cast("string"))), " ").alias("segments"))


def chunk_hits(spark, d, k):
    found = retrieval.retrieve(fx(spark, d, "query_vecs"), fx(spark, d, "segments"), k)
    return found.join(fx(spark, d, "chunks").select("chunk_id", "corpus_id"), "chunk_id").select("query_id", "rank", "chunk_id", "corpus_id", "score")


@query("a03_article_entries", f"WITH {S.entries(30)} SELECT query_id, act_code, article, best, n FROM entries")
def a03(spark, d):
    return retrieval.articles(chunk_hits(spark, d, 30)).select("query_id", "act_code", "article", "best", "n")


@query("a04_article_scores", f"WITH {S.entries(30)} SELECT query_id, act_code, article, score FROM entries")
def a04(spark, d):
    return retrieval.articles(chunk_hits(spark, d, 30)).select("query_id", "act_code", "article", "score")


@query("a05_acts", f"""WITH {S.entries(30)}, g AS (SELECT query_id, act_code, max(score) AS doc_score, max(best) AS best_score, arg_min(corpus_id, (-score, article)) AS corpus_id, string_agg(cast(article AS string), ',' ORDER BY article) AS articles, count(*) AS article_count FROM entries GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_score DESC, best_score DESC, act_code) AS rank FROM g""")
def a05(spark, d):
    return retrieval.acts(retrieval.articles(chunk_hits(spark, d, 30))).withColumn("articles", F.array_join(F.transform("articles", lambda a: a.cast("string")), ","))


def _groups_sql(score: str, k: int) -> str:
    return f"""WITH {S.found(30)}, named AS (SELECT query_id, score, {S.act_code(S.code_of('corpus_id'))} AS act_code, {S.parts('corpus_id')['suffix']} AS suffix FROM found JOIN fx_chunks USING (chunk_id)),
g AS (SELECT query_id, act_code, round({score}, 9) AS group_score, max(score) AS best_score, count(DISTINCT nullif(suffix, '')) AS article_count FROM named GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY group_score DESC, best_score DESC, act_code) AS rank FROM g) WHERE rank <= {k}"""


def _groups(strategy):
    def run(spark, d):
        rows = retrieval.act_groups(chunk_hits(spark, d, 30), 5, strategy)
        return rows.select("query_id", "act_code", "group_score", "best_score", F.size("articles").cast("long").alias("article_count"), "rank")

    return run


for _name, _score in (("mean", "avg(score)"), ("max", "max(score)"), ("topm_mean", S.topm("list(score)", 3))):
    query(f"a06_act_groups_{_name}", _groups_sql(_score, 5))(_groups(_name))


@query("a07_limited_articles", f"WITH {S.entries(30)} SELECT query_id, act_code, array_to_string(list_sort(list(DISTINCT article))[1:2], ',') AS articles FROM entries GROUP BY 1, 2")
def a07(spark, d):
    rows = retrieval.limited_articles(retrieval.acts(retrieval.articles(chunk_hits(spark, d, 30))), 2)
    return rows.select("query_id", "act_code", F.array_join(F.transform("articles", lambda a: a.cast("string")), ",").alias("articles"))


_TOP_ACTS = "ranked AS (SELECT query_id, act_code, doc_score, articles, corpus_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_score DESC, best_score DESC, act_code)::INT AS rank FROM per_act) SELECT query_id, act_code, doc_score, corpus_id, array_to_string(articles[1:2], ',') AS articles, rank FROM ranked"


def _acts_shown(rows):
    return retrieval.limited_articles(rows, 2).select("query_id", "act_code", "doc_score", "corpus_id", F.array_join(F.transform("articles", lambda a: a.cast("string")), ",").alias("articles"), "rank")


def _top_acts(strategy):
    return lambda spark, d: _acts_shown(retrieval.selected_acts(retrieval.articles(chunk_hits(spark, d, 30)), 3, strategy))


for _name, _score in (("mean", "list_avg(list(score))"), ("topm_mean", S.topm("list(score)", 3))):
    query(f"a07_top_acts_{_name}", f"WITH {S.entries(30)}, per_act AS (SELECT query_id, act_code, round({_score}, 9) AS doc_score, max(score) AS best_score, arg_min(corpus_id, {{'s': -score, 'a': article}}) AS corpus_id, list_sort(list(DISTINCT article)) AS articles FROM entries GROUP BY 1, 2), {_TOP_ACTS} WHERE rank <= 3")(_top_acts(_name))


@query("a07_acts_of_best_articles", f"WITH {S.entries(30)}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, act_code, article) AS place FROM entries), per_act AS (SELECT query_id, act_code, max(score) AS doc_score, max(score) AS best_score, arg_min(corpus_id, place) AS corpus_id, list_sort(list(DISTINCT article)) AS articles FROM best WHERE place <= 6 GROUP BY 1, 2), {_TOP_ACTS}")
def a07b(spark, d):
    return _acts_shown(retrieval.acts_of_best_articles(retrieval.articles(chunk_hits(spark, d, 30)), 6))


def threshold_sql(source: str, start: float, most: int) -> str:
    n = lambda t: f"len(list_filter(scores, lambda x: x >= {t}))"
    steps = [f"t0 AS (SELECT query_id, list(score) AS scores, {start}::DOUBLE AS t, false AS done, false AS stop FROM {source} GROUP BY 1)"]
    for i in range(5):
        down, up = f"({n('t')} < 3 AND t > 0.4)", f"({n('t')} > {most} AND t < 0.8)"
        fits = f"{n('t')} BETWEEN 3 AND {most}"
        moved = f"CASE WHEN {down} THEN greatest(0.4::DOUBLE, t - 0.05::DOUBLE) WHEN {up} THEN least(0.8::DOUBLE, t + 0.05::DOUBLE) ELSE t END"
        going = "NOT done AND NOT stop"
        steps.append(f"t{i + 1} AS (SELECT query_id, scores, CASE WHEN {going} AND NOT ({fits}) THEN {moved} ELSE t END AS t, done OR ({going} AND {fits}) AS done, stop OR ({going} AND NOT ({fits}) AND NOT {down} AND NOT {up}) AS stop FROM t{i})")
    last = f"passed AS (SELECT *, t AS threshold_used FROM (SELECT e.*, t, done, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, act_code, article) AS place FROM {source} e JOIN t5 USING (query_id)) WHERE CASE WHEN done THEN score >= t ELSE place <= {most} END)"
    return ", ".join([*steps, last])


def _threshold(level):
    def run(spark, d):
        rows = retrieval.articles(chunk_hits(spark, d, 30)).withColumn("score", F.round(L.similarity(C("score")) * 1.1, 9))
        out = retrieval.adaptive_threshold(rows, level)
        return out.select("query_id", "act_code", "article", "score", F.round("threshold_used", 6).alias("threshold_used"))

    return run


for _name, (_start, _most) in retrieval.LEVELS.items():
    _scaled = f"scaled AS (SELECT query_id, act_code, article, round(greatest(0.0, least((score + 1) / 2, 1.0)) * 1.1, 9) AS score FROM entries)"
    query(f"a08_threshold_{_name}", f"WITH {S.entries(30)}, {_scaled}, {threshold_sql('scaled', _start, _most)} SELECT query_id, act_code, article, score, round(threshold_used, 6) AS threshold_used FROM passed")(_threshold(_name))


@query("a09_confidence", f"WITH {S.found(10)} SELECT query_id, round(avg(greatest(0.0, least((score + 1) / 2, 1.0))), 6) AS confidence FROM found GROUP BY 1")
def a09(spark, d):
    return retrieval.confidence(chunk_hits(spark, d, 10))


_ACTS = f"SELECT {S.act_code(S.code_of('corpus_id'))} AS act_code, count(*) AS articles, min(chunk_id) AS first FROM fx_chunks GROUP BY 1"


@query("a10_articles_per_act", f"SELECT act_code, articles FROM ({_ACTS})")
def a10(spark, d):
    return act_counts(spark, d).select("act_code", "articles")


def act_counts(spark, d):
    return fx(spark, d, "chunks").groupBy(L.act_code(L.code_of(C("corpus_id"))).alias("act_code")).agg(F.count("*").alias("articles"), F.min("chunk_id").alias("first"))


@query("a10_act_totals", f"SELECT count(*) AS acts, cast(sum(articles) AS BIGINT) AS lines FROM ({_ACTS})")
def a10b(spark, d):
    return act_counts(spark, d).agg(F.count("*").alias("acts"), F.sum("articles").alias("lines"))


@query("t06_most_common_acts", f"SELECT act_code, articles FROM ({_ACTS}) ORDER BY articles DESC, first LIMIT 10")
def t06(spark, d):
    return act_counts(spark, d).orderBy(C("articles").desc(), "first").limit(10).select("act_code", "articles")


@query("a11_first_queries", f"WITH {joins.FIRST} SELECT * FROM first_q")
def a11(spark, d):
    return joins.first_queries(spark, d)


@query("a11_duplicates", "SELECT count(*) - count(DISTINCT query_id) AS duplicates FROM fx_queries")
def a11b(spark, d):
    return fx(spark, d, "queries").agg((F.count("*") - F.countDistinct("query_id")).alias("duplicates"))


@query("a12_registry_choice", "SELECT act_code, arg_max(pos, (length(official_title), -pos)) AS pos FROM (SELECT pos, upper(so_hieu) AS code, trich_yeu AS official_title, " + S.act_code("so_hieu") + " AS act_code FROM fx_registry) GROUP BY 1")
def a12(spark, d):
    return tables.registry(tables.registry_entries(fx(spark, d, "registry"))).select("act_code", "pos")


@query("a13_positives", "SELECT query_id, count(DISTINCT corpus_doc) AS n, count(*) AS rows, string_agg(DISTINCT cast(corpus_doc AS string), ',' ORDER BY cast(corpus_doc AS string)) AS positives FROM fx_qrels GROUP BY 1")
def a13(spark, d):
    rows = fx(spark, d, "qrels").groupBy("query_id").agg(F.countDistinct("corpus_doc").alias("n"), F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set(C("corpus_doc").cast("string"))), ",").alias("positives"))
    return rows


@query("a14_negative_statistics", f"WITH {joins.NEG}, c AS (SELECT coalesce(n, 0) AS n FROM q LEFT JOIN (SELECT query_id, count(*) AS n FROM neg GROUP BY 1) USING (query_id)) SELECT count(*) AS total, count_if(n >= 8)::BIGINT AS enough, round(count_if(n >= 8) / count(*), 6) AS ratio, round(avg(n), 6) AS mean, median(n)::DOUBLE AS median, min(n) AS least, max(n) AS most, count_if(n < 8)::BIGINT AS insufficient FROM c")
def a14(spark, d):
    queries, _, found = joins.ranked(spark, d)
    return bm25.negative_statistics(bm25.hard_negatives(found, joins.positives(spark, d)), queries)


def _judged_sql(k: int) -> str:
    return f"""{S.hits(k)}, rel AS (SELECT query_id, faiss_id FROM fx_query_vecs v JOIN fx_segments s ON s.label = v.label),
npos AS (SELECT query_id, count(*) AS npos FROM rel GROUP BY 1),
marks AS (SELECT h.* FROM hits h SEMI JOIN rel r ON h.query_id = r.query_id AND h.faiss_id = r.faiss_id),
per AS (SELECT query_id, npos, {', '.join(f'coalesce(found_{k}, 0) / npos AS recall_{k}, (coalesce(found_{k}, 0) > 0)::INT AS hit_{k}' for k in evaluation.RECALL_AT)}, CASE WHEN first_rank <= 10 THEN 1.0 / first_rank ELSE 0 END AS rr, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(npos, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, first_rank
 FROM npos LEFT JOIN (SELECT query_id, {', '.join(f'count_if(rank <= {k}) AS found_{k}' for k in evaluation.RECALL_AT)}, min(rank) AS first_rank, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS dcg FROM marks GROUP BY 1) USING (query_id))"""


def judged_queries(spark, d):
    return evaluation.scored(joins.judged_hits(spark, d, 50), evaluation.positives_by_label(*joins.labels(spark, d), "faiss_id"))


_ROUNDED = ", ".join(f"round(recall_{k}, 6) AS recall_{k}, hit_{k}" for k in evaluation.RECALL_AT)


@query("a15_recall_per_query", f"WITH {_judged_sql(50)} SELECT query_id, npos, {_ROUNDED} FROM per")
def a15(spark, d):
    own = [c for k in evaluation.RECALL_AT for c in (F.round(f"recall_{k}", 6).alias(f"recall_{k}"), f"hit_{k}")]
    return judged_queries(spark, d).select("query_id", "npos", *own)


@query("a16_mrr_ndcg", f"WITH {_judged_sql(50)} SELECT query_id, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM per")
def a16(spark, d):
    return judged_queries(spark, d).select("query_id", F.round("rr", 6).alias("rr"), F.round("ndcg", 6).alias("ndcg"))


_MEANS = ", ".join(f"round(avg(recall_{k}), 6) AS recall_{k}, round(avg(hit_{k}), 6) AS hit_{k}" for k in evaluation.RECALL_AT)


@query("a16_summary", f"WITH {_judged_sql(50)} SELECT count(*) AS queries, {_MEANS}, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM per")
def a16b(spark, d):
    return evaluation.summary(judged_queries(spark, d))


@query("a17_hit_summary", f"WITH {_judged_sql(50)} SELECT {', '.join(f'round(avg(coalesce(first_rank <= {k}, false)::INT), 6) AS recall_{k}' for k in (5, 10, 20))}, round(avg(CASE WHEN first_rank <= 20 THEN 1.0 / first_rank END), 6) AS mrr FROM per")
def a17(spark, d):
    return evaluation.hit_summary(judged_queries(spark, d))


_P90 = "CASE WHEN n >= 10 THEN (s[j] * (10 - (9 * (n + 1) - 10 * j)) + s[j + 1] * (9 * (n + 1) - 10 * j)) / 10 ELSE s[n] END"


@query("a18_latencies", f"SELECT stage, n, round(list_avg(s), 6) AS mean, round(list_median(s), 6) AS p50, round({_P90}, 6) AS p90, round(s[n], 6) AS max FROM (SELECT *, greatest(1, least(9 * (n + 1) // 10, n - 1)) AS j FROM (SELECT stage, count(*) AS n, list(ms ORDER BY ms) AS s FROM fx_latency GROUP BY 1))")
def a18(spark, d):
    return evaluation.latencies(fx(spark, d, "latency"), "stage", "ms")


_OVERLAP = f"SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 0.0 ELSE round(len(list_intersect(a, c)) / len(a), 6) END AS overlap FROM (SELECT *, list_distinct(list_filter({S.tokens('answer')}, lambda x: length(x) >= 3)) AS a, list_distinct(list_filter({S.tokens('context')}, lambda x: length(x) >= 3)) AS c FROM fx_answers WHERE role = 'assistant' AND context IS NOT NULL)"


def overlaps(spark, d):
    return evaluation.lexical_overlap(fx(spark, d, "answers").where("role = 'assistant' AND context IS NOT NULL"), "answer", "context")


@query("lx01_lexical_overlap", f"SELECT *, overlap < 0.2 AS hallucinated FROM ({_OVERLAP})")
def lx01(spark, d):
    return overlaps(spark, d).select("conv_id", "turn", "overlap", "hallucinated")


@query("a19_hallucination_rate", f"SELECT round(avg((overlap < 0.2)::INT), 6) AS rate FROM ({_OVERLAP})")
def a19(spark, d):
    return overlaps(spark, d).agg(F.round(F.avg(C("hallucinated").cast("int")), 6).alias("rate"))


@query("a21_corpus_stats", f"SELECT count(*) AS documents, sum(w)::BIGINT AS words, round(sum(w) / count(*), 6) AS mean FROM (SELECT len({S.words('content')}) AS w FROM fx_chunks)")
def a21(spark, d):
    rows = fx(spark, d, "chunks").select(L.n_words(C("content")).cast("long").alias("w"))
    return rows.agg(F.count("*").alias("documents"), F.sum("w").alias("words"), F.round(F.try_divide(F.sum("w"), F.count("*")), 6).alias("mean"))


@query("a22_structure_counts", f"WITH {extraction.LINES} SELECT doc_id, " + ", ".join(f"count_if(kind = '{n}')::BIGINT AS {n}s" for n in structure.ORDER) + " FROM lines GROUP BY 1")
def a22(spark, d):
    return structure.counts(extraction.parsed(spark, d), "doc_id")


@query("a23_index_totals", "SELECT count(DISTINCT chunk_id) AS chunks, count(*) AS segments, max(part) AS most FROM fx_segments")
def a23(spark, d):
    return fx(spark, d, "segments").agg(F.countDistinct("chunk_id").alias("chunks"), F.count("*").alias("segments"), F.max("part").alias("most"))


@query("a24_bm25_terms", f"""WITH posted AS MATERIALIZED (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest({S.tokens('text')}) AS token FROM documents)),
n AS (SELECT count(DISTINCT doc_id) AS n FROM posted), raw AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT token, count(*) AS df FROM posted GROUP BY 1) CROSS JOIN n)
SELECT token, df, round(CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END, 6) AS idf FROM raw""")
def a24(spark, d):
    documents = bm25.tokenised(base(spark, d, "documents").select("doc_id", "text"))
    return bm25.statistics(documents)[2].select("token", "df", F.round("idf", 6).alias("idf"))


# ---------------------------------------------------------------- rate limits


_KEPT_LOG = "list_filter(log, lambda x: r.us - x <= 3600000000)"
_REPLAY = f"""WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM fx_requests),
go AS (SELECT user_id, i, event_id, true AS accepted, 0.0::DOUBLE AS retry_after, [us] AS log FROM r WHERE i = 1
UNION ALL SELECT r.user_id, r.i, r.event_id, len({_KEPT_LOG}) < 3, CASE WHEN len({_KEPT_LOG}) < 3 THEN 0.0 ELSE round((3600000000 - (r.us - {_KEPT_LOG}[1])) / 1e6, 6) END, CASE WHEN len({_KEPT_LOG}) < 3 THEN list_append({_KEPT_LOG}, r.us) ELSE {_KEPT_LOG} END FROM go JOIN r ON r.user_id = go.user_id AND r.i = go.i + 1)"""


@query("st01_rate_limit", f"{_REPLAY} SELECT user_id, event_id, accepted FROM go")
def st01(spark, d):
    return rate_limit.replay(fx(spark, d, "requests"), window=3600.0, most=3).select("user_id", "event_id", "accepted")


@query("st01_retry_after", f"{_REPLAY} SELECT user_id, event_id, accepted, retry_after FROM go")
def st01b(spark, d):
    return rate_limit.replay(fx(spark, d, "requests"), window=3600.0, most=3)
