"""Citations, their graph, article texts, structure, and training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import citation_patterns as P
from lexloom.functions import legal_text as L
from lexloom.operators import citations, segments, structure
from lexloom.plans import joins
from lexloom.plans import sql as S
from lexloom.plans.fixtures import base, fx
from lexloom.plans.named import query

C = F.col

_CODES = f"regexp_extract_all(content, {S.lit('(?:^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])(' + P.CODE + ')(?:[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]|$)')}, 1)"
_LAST = lambda *patterns: "coalesce(" + ", ".join(f"regexp_extract_all(content, {S.lit('(?i)(?:^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])' + p)}, 1)[-1]" for p in patterns) + ")::INT"
_ARTICLE, _CLAUSE = _LAST(P.ARTICLE_ASCII, P.ARTICLE), _LAST(P.CLAUSE_ASCII, P.CLAUSE)


@query("x10_codes", f"SELECT chunk_id, code, {S.folded('code')} AS code_norm FROM (SELECT chunk_id, unnest({_CODES}) AS code FROM fx_citing)")
def x10(spark, d):
    rows = fx(spark, d, "citing").select("chunk_id", F.explode(citations.codes(C("content"))).alias("code"))
    return rows.withColumn("code_norm", L.ascii_code(C("code")))


def acts_of(spark, d):
    """A registry whose acts the citing texts name."""
    rows = [("91/2015/QH13", "Bộ luật Dân sự", "", 2015), ("33/2005/QH11", "Bộ luật Dân sự", "", 2005), ("101/2015/QH13", "Bộ luật Hình sự", "", 2015), ("52/2014/QH13", "Luật Hôn nhân và gia đình", "", 2014)]
    return spark.createDataFrame(rows, "act_code string, act_name string, official_title string, year int")


@query("x10_citations")
def x10b(spark, d):
    return citations.extract(fx(spark, d, "citing"), "chunk_id", "content", by_name=False)


@query("x10_all_hits")
def x10c(spark, d):
    return citations.extract(fx(spark, d, "citing"), "chunk_id", "content")


@query("x10_resolved_names")
def x10d(spark, d):
    return citations.extract(fx(spark, d, "citing"), "chunk_id", "content", acts=acts_of(spark, d))


@query("w05_nearest_articles")
def w05(spark, d):
    return citations.extract(fx(spark, d, "citing"), "chunk_id", "content", by_name=False).select("chunk_id", "act_code_norm", "article").distinct()


@query("x11_location", f"SELECT chunk_id, {_ARTICLE} AS article, {_CLAUSE} AS clause FROM fx_citing")
def x11(spark, d):
    place = citations.location(C("content"))
    return fx(spark, d, "citing").select("chunk_id", place["article"].alias("article"), place["clause"].alias("clause"))


_MINE = f"SELECT chunk_id, {S.act_code(S.code_of('corpus_id'))} AS citing, cast(nullif({S.parts('corpus_id')['suffix']}, '') AS INT) AS citing_article FROM fx_chunks"
_HITS = f"SELECT citing, citing_article, {S.folded('code')} AS cited, article FROM (SELECT chunk_id, unnest({_CODES}) AS code, {_ARTICLE} AS article FROM fx_citing) JOIN ({_MINE}) USING (chunk_id) WHERE article IS NOT NULL"


def citation_hits(spark, d):
    parts = L.parse_corpus_id(C("corpus_id"))
    mine = fx(spark, d, "chunks").withColumn("s", parts["suffix"]).select("chunk_id", L.act_code(L.code_of(C("corpus_id"))).alias("citing"), F.expr("try_cast(nullif(s, '') AS int)").alias("citing_article"))
    place = citations.location(C("content"))
    cited = fx(spark, d, "citing").select("chunk_id", F.explode(citations.codes(C("content"))).alias("code"), place["article"].alias("article"))
    return cited.join(mine, "chunk_id").select("citing", "citing_article", L.ascii_code(C("code")).alias("cited"), "article")


_LIST = "array_to_string(list_sort(list_distinct(list({0}))), ',')"
_GRAPH = f"SELECT cited, citing, {_LIST.format('citing_article')} AS citing_articles, {_LIST.format('article')} AS cited_articles FROM ({_HITS}) GROUP BY 1, 2"


def _joined(df, *columns):
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in columns})


@query("a20_citation_graph", _GRAPH)
def a20(spark, d):
    return _joined(citations.graph(citation_hits(spark, d)), "citing_articles", "cited_articles")


@query("j13_citation_edges", f"SELECT DISTINCT cited, citing FROM ({_HITS})")
def j13(spark, d):
    return citations.graph(citation_hits(spark, d)).select("cited", "citing")


@query("a25_cited_articles", f"SELECT cited, {_LIST.format('article')} AS articles FROM ({_HITS}) GROUP BY 1")
def a25(spark, d):
    return _joined(citations.cited_articles(citation_hits(spark, d)), "articles")


@query("f07_allowed_citations", f"SELECT cited, citing, {_LIST.format('citing_article')} AS citing_articles, {_LIST.format('article')} AS cited_articles FROM ({_HITS}) WHERE cited LIKE '1%' GROUP BY 1, 2")
def f07(spark, d):
    hits = citation_hits(spark, d)
    return _joined(citations.graph(hits, hits.where("cited LIKE '1%'").select(C("cited").alias("act"))), "citing_articles", "cited_articles")


_NOT_WORD = "(?:[^\\p{L}\\p{N}_]|$)"
_FROM_2 = f"regexp_extract(content, {S.lit('(?is)Điều' + chr(92) + 's+0*2(?:[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_].*)?$')}, 0)"


@query("x12_article_cut", f"SELECT doc_id, {S.strip(f'regexp_extract({_FROM_2}, ' + S.lit('(?is)^(.*?)(?:' + chr(10) + chr(92) + 's*Điều' + chr(92) + 's+0*[0-9]+' + _NOT_WORD + '|$)') + ', 1)')} AS text FROM fx_statutes")
def x12(spark, d):
    return fx(spark, d, "statutes").select("doc_id", citations.article_cut(C("content"), 2).alias("text"))


_TEXTS = f"SELECT {S.lookup_key(S.code_of('corpus_id'))} AS key, cast({S.parts('corpus_id')['suffix']} AS INT) AS article, string_agg({S.shown('content')}, chr(10) || chr(10) ORDER BY chunk_id) AS text FROM fx_chunks WHERE {S.parts('corpus_id')['suffix']} <> '' AND {S.shown('content')} <> '' GROUP BY 1, 2"


@query("x13_article_texts", _TEXTS)
def x13(spark, d):
    return citations.article_texts(fx(spark, d, "chunks"))


@query("x13_act_texts", f"SELECT {S.lookup_key(S.code_of('corpus_id'))} AS key, string_agg({S.shown('content')}, chr(10) || chr(10) ORDER BY coalesce(cast(nullif({S.parts('corpus_id')['suffix']}, '') AS INT), 0), chunk_id) AS text FROM fx_chunks WHERE {S.shown('content')} <> '' GROUP BY 1")
def x13b(spark, d):
    return citations.act_texts(fx(spark, d, "chunks"))


@query("x14_bulk_articles", f"WITH t AS ({_TEXTS}), a AS (SELECT DISTINCT {S.code_of('corpus_id')} AS act_code FROM fx_chunks), r AS (SELECT act_code, unnest([3, 1, 2]) AS article, unnest([1, 2, 4]) AS pos FROM a) SELECT act_code, string_agg('Điều ' || r.article || chr(10) || text, chr(10) || chr(10) ORDER BY pos) AS text FROM r JOIN t ON t.key = {S.lookup_key('act_code')} AND t.article = r.article GROUP BY 1")
def x14(spark, d):
    chunks = fx(spark, d, "chunks")
    asked = chunks.select(L.code_of(C("corpus_id")).alias("act_code")).distinct().withColumn("articles", F.lit("3, 1,x,2"))
    return citations.bulk_lookup(asked, lambda wanted: citations.article_texts(chunks, asked=wanted))


# ---------------------------------------------------------------- structure


def parsed(spark, d):
    return structure.lines(fx(spark, d, "statutes"), "doc_id", "content")


def _level_sql(name: str) -> str:
    """A level's pattern as RE2 has it: what must not follow a number is what may follow it turned round."""
    pattern = structure.LEVELS[name].replace("(?iud)", "(?i)").replace("(?d)", "")
    return S.lit(pattern.replace("(?![\\p{L}\\p{N}_])" + L.BLANK + "*(.*)$", "(?:[^\\p{L}\\p{N}_].*)?$"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(t, {_level_sql(n)}) THEN '{n}'" for n in structure.ORDER) + " ELSE 'text' END"
_NUMBER = "CASE kind " + " ".join(f"WHEN '{n}' THEN regexp_extract(text, {_level_sql(n)}, 1)" for n in structure.ORDER) + " END"
_NAME = "CASE " + " ".join(f"WHEN kind = '{n}' THEN {S.strip(f'regexp_extract(text, {_level_sql(n)}, 2)')}" for n in ("article", "clause", "point")) + " END"
_AT = ", ".join(f"max(CASE WHEN kind = '{n}' THEN line END) OVER w AS {n}_line, last_value(CASE WHEN kind = '{n}' THEN number END IGNORE NULLS) OVER w AS cur_{n}" for n in structure.ORDER)
_HOLDS = ", ".join(f"CASE WHEN {n}_line > greatest(-1, {', '.join([f'coalesce({m}_line, -1)' for m in structure.ORDER[:i]] or ['-1'])}) THEN cur_{n} END AS {n}" for i, n in enumerate(structure.ORDER))
LINES = f"""split AS (SELECT doc_id, unnest(string_split(coalesce(content, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(content, ''), chr(10)), 1) AS i FROM fx_statutes),
kinds AS (SELECT doc_id, i - 1 AS line, t AS text, {_KIND} AS kind FROM split WHERE {S.strip('t')} <> ''),
named AS (SELECT *, {_NUMBER} AS number, {_NAME} AS name FROM kinds),
carried AS (SELECT *, {_AT}, last_value(CASE WHEN kind = 'article' THEN name END IGNORE NULLS) OVER w AS cur_article_name FROM named WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING)),
lines AS (SELECT doc_id, line, text, kind, number, name, {_HOLDS}, CASE WHEN article_line > greatest(coalesce(chapter_line, -1), coalesce(section_line, -1)) THEN cur_article_name END AS article_name FROM carried)"""
_HEADING = "CASE WHEN concat_ws(' – ', nullif(chapter, ''), nullif(section, '')) = '' THEN '' ELSE concat_ws(' – ', nullif(chapter, ''), nullif(section, '')) || chr(10) END || 'Điều ' || article || CASE WHEN coalesce(article_name, '') = '' THEN '' ELSE '. ' || article_name END"
_CHUNKS = f"""{LINES},
starts AS (SELECT *, last_value(CASE WHEN kind <> 'text' THEN CASE WHEN kind IN ('article', 'clause', 'point') THEN line ELSE -1 END END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS start FROM lines),
grouped AS (SELECT doc_id, start, arg_min(kind, line) AS kind, {', '.join(f"first({c} ORDER BY line) AS {c}" for c in (*structure.ORDER, 'article_name'))},
 string_agg(CASE WHEN kind = 'text' THEN {S.strip('text')} ELSE name END, chr(10) ORDER BY line) AS body FROM starts WHERE start >= 0 AND article IS NOT NULL GROUP BY 1, 2),
headed AS (SELECT *, {_HEADING} AS head FROM grouped),
chunks AS (SELECT doc_id, start, kind, CASE kind
 WHEN 'article' THEN {S.strip("CASE WHEN ends_with(head, '..') THEN rtrim(head, '.') ELSE head END || chr(10) || " + S.strip('substring(body, length(article_name) + 1)'))}
 WHEN 'clause' THEN {S.strip("head || ' - Khoản ' || clause || '. ' || body")}
 ELSE {S.strip("head || ' - Khoản ' || coalesce(clause, '') || ' - Điểm ' || point || ') ' || body")} END AS content FROM headed)"""


@query("x08_structure", f"WITH {LINES} SELECT doc_id, line, text, kind, number FROM lines")
def x08(spark, d):
    return parsed(spark, d).select("doc_id", F.col("line").cast("long").alias("line"), "text", "kind", "number")


@query("w06_carried_headings", f"WITH {LINES} SELECT doc_id, line, {', '.join(structure.ORDER)}, article_name FROM lines")
def w06(spark, d):
    return parsed(spark, d).select("doc_id", F.col("line").cast("long").alias("line"), *structure.ORDER, "article_name")


@query("w07_chunk_index", f"WITH {_CHUNKS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, kind AS chunk_type FROM chunks")
def w07(spark, d):
    return structure.chunks(parsed(spark, d), "doc_id").select("doc_id", C("chunk_index").cast("long").alias("chunk_index"), "chunk_type")


@query("x09_structure_chunks", f"WITH {_CHUNKS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, content FROM chunks")
def x09a(spark, d):
    return structure.chunks(parsed(spark, d), "doc_id").select("doc_id", C("chunk_index").cast("long").alias("chunk_index"), "content")


@query("x09_smart_chunks")
def x09(spark, d):
    return structure.smart_chunks(fx(spark, d, "statutes"), "doc_id", "content").select("doc_id", C("chunk_index").cast("long").alias("chunk_index"), "chunk_type", "content")


# ---------------------------------------------------------------- training rows


@query("x04_training_windows", "SELECT chunk_id, (SELECT count(*) FROM range(0, CASE WHEN n <= 128 THEN 1 ELSE 1 + cast(ceil((n - 128) / 96.0) AS INT) END)) AS windows FROM (SELECT chunk_id, len(" + S.tokens("content") + ") AS n FROM fx_chunks) WHERE n > 0")
def x04(spark, d):
    tokens = L.tokens(C("content"))
    rows = fx(spark, d, "chunks").where(F.size(tokens) > 0)
    return rows.select("chunk_id", F.size(segments.windows(tokens, 128, 32)).cast("long").alias("windows"))


@query("x01_model_windows")
def x01m(spark, d):
    import public_tokenizers

    return segments.model_windows(fx(spark, d, "chunks"), "chunk_id", "content", public_tokenizers.path("byte_bpe_50k.json"))


@query("sp03_training_rows", f"""WITH {joins.NEG}, w AS (SELECT doc_id, i, array_to_string(t[(i - 1) * 192 + 1:least(n, (i - 1) * 192 + 256)], ' ') AS s FROM (SELECT *, unnest(range(1, CASE WHEN n <= 256 THEN 1 ELSE 1 + cast(ceil((n - 256) / 192.0) AS INT) END + 1)) AS i FROM (SELECT doc_id, {S.tokens('text')} AS t, len({S.tokens('text')}) AS n FROM documents))),
l AS (SELECT query_id, string_agg(s, '|' ORDER BY rank, i) AS negatives FROM neg JOIN w USING (doc_id) WHERE rank <= 4 AND s <> '' GROUP BY 1)
SELECT query_id, s AS positive, md5(negatives) AS negatives FROM pos JOIN w USING (doc_id) JOIN l USING (query_id) JOIN q USING (query_id) WHERE s <> ''""")
def sp03(spark, d):
    from lexloom.operators import bm25

    queries, docs, found = joins.ranked(spark, d)
    pos = joins.positives(spark, d)
    rows = segments.training_rows(bm25.triplets(queries, pos, bm25.hard_negatives(found, pos), docs))
    return rows.select("query_id", "positive", F.md5(F.array_join("negatives", "|")).alias("negatives"))
