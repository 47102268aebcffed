"""Scans, projections and filters over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import legal_text as L
from lexloom.functions import repair
from lexloom.operators import calls, retrieval, segments, tables, wordseg
from lexloom.plans import sql as S
from lexloom.plans.fixtures import base, fx
from lexloom.plans.named import query
from lexloom.session import scratch
from lexloom.sources import files

C = F.col


def own(df, key, /, **columns):
    return df.select(key, *[c.alias(n) for n, c in columns.items()])


# ---------------------------------------------------------------- scans and sinks


_WORDS = f"len({S.words('content')})"


@query("s01_chunk_table", f"""SELECT row_number() OVER (ORDER BY chunk_id) - 1 AS chunk_id, corpus_id, {S.parts_list('corpus_id')}, content, {_WORDS} AS word_count, substring(content, 1, 200) AS preview
FROM fx_chunks WHERE coalesce(corpus_id, '') <> '' AND coalesce(content, '') <> ''""")
def s01(spark, d):
    return tables.chunk_table(fx(spark, d, "chunks").withColumnRenamed("chunk_id", "pos"), "pos")


_RAW_PAIRS = "SELECT CASE WHEN doc_id % 2 = 0 THEN cast(doc_id AS string) ELSE '' END AS {0}query-id{0}, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE cast(doc_id + 1 AS string) END AS query_id, CASE WHEN doc_id % 5 = 0 THEN cast(doc_id AS string) END AS {0}corpus-id{0}, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS corpus_id, cast(n_chars AS double) AS score FROM {1}"


@query("s05_tolerant_pairs", f"WITH r AS ({_RAW_PAIRS.format(chr(34), 'documents')}), p AS (SELECT coalesce(nullif(\"query-id\", ''), nullif(query_id, '')) AS query_id, coalesce(nullif(\"corpus-id\", ''), nullif(corpus_id, '')) AS corpus_id, score FROM r) SELECT * FROM p WHERE query_id IS NOT NULL AND corpus_id IS NOT NULL")
def s05(spark, d):
    return files.pairs_of(spark.sql(_RAW_PAIRS.format("`", "{documents}"), documents=base(spark, d, "documents")))


@query("s06_tolerant_queries", "SELECT cast(query_id AS string) AS query_id, arg_max(query_text, pos) AS query_text FROM fx_queries GROUP BY query_id")
def s06(spark, d):
    text = lambda c: C(c).cast("string")
    raw = fx(spark, d, "queries").select(F.when(C("pos") % 2 == 0, text("query_id")).alias("_id"), text("query_id").alias("query-id"), F.lit("").alias("query_id"), F.lit(None).cast("string").alias("text"), F.when(C("pos") % 4 == 0, C("query_text")).alias("query"), "query_text", "pos")
    return files.queries_of(raw)


@query("s07_limited_queries", "SELECT CASE WHEN item_id % 4 = 0 THEN 'idx-' || (n - 1) ELSE cast(item_id AS string) END AS query_id, text AS query_text, n - 1 AS n FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS n FROM benchmark WHERE item_id % 9 <> 1) WHERE n <= 20")
def s07(spark, d):
    raw = base(spark, d, "benchmark").select(F.when(C("item_id") % 4 == 0, "").otherwise(C("item_id").cast("string")).alias("_id"), F.when(C("item_id") % 9 == 1, "").otherwise(C("text")).alias("text"), C("item_id").alias("pos"))
    return files.limited_queries(raw, 20)


REGISTRY_SQL = f"""entries AS (SELECT pos, {S.act_code('so_hieu')} AS act_code, '' AS act_name, coalesce(trich_yeu, '') AS official_title, nullif(loai_van_ban, '') AS act_type, nullif(co_quan_ban_hanh, '') AS issuer FROM fx_registry WHERE so_hieu <> ''),
registry AS (SELECT *, try_cast(string_split(act_code, '/')[2] AS INT) AS year FROM (SELECT *, row_number() OVER (PARTITION BY act_code ORDER BY 2 * length(act_name) + length(official_title) DESC, pos) AS n FROM entries) WHERE n = 1)"""


@query("s08_registry", f"WITH {REGISTRY_SQL} SELECT act_code, act_name, official_title, year, act_type, issuer FROM registry")
def s08(spark, d):
    return tables.registry(tables.registry_entries(fx(spark, d, "registry"))).select("act_code", "act_name", "official_title", "year", "act_type", "issuer")


@query("s10_within_size", "SELECT doc_id, length(text) <= 5000 AS kept FROM documents")
def s10(spark, d):
    good, bad = tables.within_size(base(spark, d, "documents"), "text", 5000)
    return good.select("doc_id", F.lit(True).alias("kept")).unionByName(bad.select("doc_id", F.lit(False).alias("kept")))


@query("s11_ordered_scan", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def s11(spark, d):
    return base(spark, d, "documents").select("doc_id", "source").orderBy("doc_id").limit(100)


@query("s14_page_fields", "SELECT page_id, page_id || '/2020/NĐ-CP' AS so_hieu, 'Nghị định' AS loai_van_ban, CAST(NULL AS VARCHAR) AS co_quan_ban_hanh, 'Về việc ' || page_id AS trich_yeu FROM pages")
def s14(spark, d):
    return files.page_record(fx(spark, d, "rows"), "page_id", "html")


@query("s14_page_titles", "SELECT page_id, " + S.strip("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)") + " AS title FROM pages")
def s14b(spark, d):
    return own(base(spark, d, "pages"), "page_id", title=L.strip(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)))


_TITLE = S.strip("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")


@query("s15_fetched_pages", f"SELECT page_id, CASE WHEN page_id % 31 <> 30 THEN {_TITLE} END AS title, (CASE WHEN page_id % 31 = 30 THEN 4 WHEN page_id % 7 = 3 THEN 3 ELSE 1 END)::BIGINT AS tries FROM pages")
def s15f(spark, d):
    """Pages served through calls that may fail: what failed in a first run is called again in a second."""
    from lexloom.session import scratch

    pages = base(spark, d, "pages").select("page_id", F.concat_ws("|", "page_id", "html").alias("served"))

    def site(closed):
        def fetch(served):
            number, _, html = served.partition("|")
            if int(number) % 31 == 30 or closed and int(number) % 7 == 3:
                raise ConnectionError("closed")
            return html

        return fetch

    path, policy = scratch(spark, "fetched"), calls.Policy(tries=2, wait=0.0, slices=2)
    calls.run_pending(pages, path, site(True), "page_id", "served", policy)
    found = calls.run_pending(pages, path, site(False), "page_id", "served", policy)
    return found.select("page_id", L.strip(F.regexp_extract("value", "(?is)<title>(.*?)</title>", 1)).alias("title"), "tries")


_SLUG = S.mapped("regexp_extract(upper(split_part(c, '/', -1)), '^([A-Z]+)', 1)", {k: v for k, v in L.SLUGS.items() if k.isascii()}, "NULL")


@query("s15_slug_url", f"SELECT chunk_id, {S.lit(L.SLUG_BASE + '/van-ban/')} || ({_SLUG}) || '-' || lower(replace(c, '/', '-')) || '.aspx' AS url FROM (SELECT chunk_id, {S.code_of('corpus_id')} AS c FROM fx_chunks)")
def s15(spark, d):
    return own(fx(spark, d, "chunks"), "chunk_id", url=L.slug_url(L.code_of(C("corpus_id"))))


@query("k01_jsonl_round_trip", f"SELECT row_number() OVER (ORDER BY chunk_id) - 1 AS chunk_id, corpus_id, {S.parts_list('corpus_id')}, {_WORDS} AS word_count FROM fx_chunks WHERE coalesce(content, '') <> ''")
def k01(spark, d):
    path = scratch(spark, "k01")
    raw = fx(spark, d, "chunks").select(C("chunk_id").alias("pos"), C("corpus_id").alias("_id"), C("content").alias("text"))
    files.write_jsonl(raw, path)
    back = files.read_jsonl(spark, path, raw.schema)
    return tables.chunk_table(back, "pos", "_id", "text").drop("content", "preview")


@query("k04_index_metadata", "SELECT count(DISTINCT chunk_id) AS total_chunks, count(*) AS total_segments, 'chunk_id,embedding,faiss_id,label,part' AS fields FROM fx_segments")
def k04(spark, d):
    return files.index_metadata(fx(spark, d, "segments"))


@query("k05_joined_texts", f"SELECT source, cast(floor(doc_id / {tables.PART}.0) AS BIGINT) AS part, string_agg({S.shown('text')}, chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents WHERE {S.shown('text')} <> '' GROUP BY 1, 2")
def k05(spark, d):
    return tables.joined_texts(base(spark, d, "documents"), "source", "doc_id", "text")


# ---------------------------------------------------------------- projections


@query("p01_corpus_id", f"SELECT chunk_id, corpus_id, {S.parts_list('corpus_id')} FROM fx_chunks")
def p01(spark, d):
    return own(fx(spark, d, "chunks"), "chunk_id", corpus_id=C("corpus_id"), **L.parse_corpus_id(C("corpus_id")))


@query("p02_projection", f"SELECT row_number() OVER (ORDER BY chunk_id) - 1 AS chunk_id, {_WORDS} AS word_count, substring(content, 1, 200) AS preview FROM fx_chunks")
def p02(spark, d):
    return tables.chunk_table(fx(spark, d, "chunks").withColumnRenamed("chunk_id", "pos"), "pos").select("chunk_id", "word_count", "preview")


@query("p03_lenient_code", "SELECT chunk_id, CASE WHEN len(p) >= 3 THEN p[1] || '/' || p[2] END AS number_year, CASE WHEN len(p) >= 3 THEN p[3] END AS type FROM (SELECT chunk_id, string_split(split_part(corpus_id, '+', 1), '/') AS p FROM fx_chunks)")
def p03(spark, d):
    return own(fx(spark, d, "chunks"), "chunk_id", **L.lenient_parts(C("corpus_id")))


@query("p04_act_code", f"SELECT pos, {S.act_code('so_hieu')} AS act_code FROM fx_registry")
def p04(spark, d):
    return own(fx(spark, d, "registry"), "pos", act_code=L.act_code(C("so_hieu")))


@query("p05_act_code_wide", f"SELECT pos, {S.act_code('so_hieu', L.TYPE_CODES_WIDE)} AS act_code FROM fx_registry")
def p05(spark, d):
    return own(fx(spark, d, "registry"), "pos", act_code=L.act_code(C("so_hieu"), L.TYPE_CODES_WIDE))


@query("p06_lookup_key", f"SELECT chunk_id, CASE WHEN chunk_id % 3 = 0 THEN 'fisso 2' ELSE '' END || {S.lookup_key('corpus_id')} AS key FROM fx_chunks")
def p06(spark, d):
    odd = F.when(C("chunk_id") % 3 == 0, "\u2003ﬁßº\u00a0²").otherwise("")
    return own(fx(spark, d, "chunks"), "chunk_id", key=L.lookup_key(F.concat(odd, "corpus_id")))


@query("p07_ascii_code", f"SELECT chunk_id, {S.folded('content')} AS code FROM fx_citing")
def p07(spark, d):
    return own(fx(spark, d, "citing"), "chunk_id", code=L.ascii_code(C("content")))


@query("p08_name_form", f"SELECT chunk_id, {S.name_form('content')} AS name FROM fx_citing")
def p08(spark, d):
    return own(fx(spark, d, "citing"), "chunk_id", name=L.name_form(C("content")))


@query("p09_crawler_id", "SELECT chunk_id, upper(replace(replace(content, ' ', ''), 'ß', 'SS')) AS id FROM fx_citing")
def p09(spark, d):
    return own(fx(spark, d, "citing"), "chunk_id", id=L.crawler_id(C("content")))


@query("p10_title", f"SELECT chunk_id, {S.title('type', 'number')} AS title FROM (SELECT chunk_id, {S.parts_list('corpus_id')} FROM fx_chunks)")
def p10(spark, d):
    p = L.parse_corpus_id(C("corpus_id"))
    return own(fx(spark, d, "chunks"), "chunk_id", title=L.title(p["type"], p["number"]))


@query("p11_display", f"WITH {REGISTRY_SQL} SELECT act_code, coalesce(nullif(act_name, ''), nullif(official_title, ''), act_code) AS whole, coalesce(nullif(act_name, ''), act_code) || ' — Điều ' || year AS article FROM registry")
def p11(spark, d):
    shape = lambda a: L.display(C("act_code"), C("act_name"), C("official_title"), a)
    return own(s08(spark, d), "act_code", whole=shape(F.lit(None).cast("int")), article=shape(C("year")))


@query("p12_similarity", "SELECT l_orderkey, l_linenumber, round(greatest(0.0, least((l_discount * 30 - 2 + 1) / 2, 1.0)), 6) AS similarity FROM lineitem")
def p12(spark, d):
    return base(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(L.similarity(C("l_discount") * 30 - 2), 6).alias("similarity"))


@query("p13_registry_entry", f"WITH {REGISTRY_SQL} SELECT pos, act_code, act_name, official_title, try_cast(string_split(act_code, '/')[2] AS INT) AS year, act_type, issuer FROM entries")
def p13(spark, d):
    return tables.registry_entries(fx(spark, d, "registry")).select("pos", "act_code", "act_name", "official_title", "year", "act_type", "issuer")


@query("p14_doc_text", f"SELECT chunk_id, concat_ws(chr(10), nullif({S.strip('CASE WHEN chunk_id % 3 = 0 THEN chr(160) ELSE corpus_id END')}, ''), nullif({S.strip('content')}, '')) AS text FROM fx_chunks")
def p14(spark, d):
    return own(fx(spark, d, "chunks"), "chunk_id", text=L.doc_text(F.when(C("chunk_id") % 3 == 0, "\u00a0").otherwise(C("corpus_id")), C("content")))


@query("p15_tokens", f"SELECT doc_id, len({S.tokens('text')}) AS n, len(list_distinct({S.tokens('text')})) AS n_distinct, array_to_string({S.tokens('text')}, ' ') AS tokens FROM documents")
def p15(spark, d):
    return own(base(spark, d, "documents").withColumn("t", L.tokens(C("text"))), "doc_id", n=F.size("t"), n_distinct=F.size(F.array_distinct("t")), tokens=F.array_join("t", " "))


@query("p16_repaired_text", "SELECT doc_id, nfc_normalize(t) AS text, nfc_normalize(t) <> t OR (doc_id % 4 <> 3 AND regexp_matches(text, '[^\\x00-\\x7f]')) AS changed FROM (SELECT doc_id, text, CASE WHEN doc_id % 4 = 1 THEN '日本 ' || text || ' 日本' ELSE text END AS t FROM documents)")
def p16(spark, d):
    """Texts that were wrongly read as a whole, in part (between signs that no one-byte encoding has), or not at all."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    parted = F.concat(F.lit("日本 "), broken, F.lit(" 日本"))
    return repair.repaired(base(spark, d, "documents").select("doc_id", F.when(C("doc_id") % 4 == 1, parted).when(C("doc_id") % 4 == 3, C("text")).otherwise(broken).alias("text")), "text")


@query("p17_shown", f"SELECT doc_id, {S.shown('replace(text, chr(32), chr(95))')} AS text FROM documents")
def p17(spark, d):
    return own(base(spark, d, "documents"), "doc_id", text=L.shown(F.replace("text", F.lit(" "), F.lit("_"))))


_PUNCT = S.lit("""([,;:.!?)(\\[\\]"'])""")
_CLEAN = f"regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
_CLEAN = f"regexp_replace(regexp_replace({_CLEAN}, '[ \\t]+', ' ', 'g'), {_PUNCT}, ' \\1 ', 'g')"
_CLEAN = S.strip(f"regexp_replace({_CLEAN}, {S.lit(L.KEPT)}, '', 'g')")


@query("p18_cleaned", f"SELECT page_id, {_CLEAN} AS text FROM (SELECT page_id, html AS text FROM pages)")
def p18(spark, d):
    return own(base(spark, d, "pages"), "page_id", text=L.clean(C("html")))


@query("p18_segmented")
def p18s(spark, d):
    docs = base(spark, d, "documents").select("doc_id", "text")
    return wordseg.cleaned(docs, wordseg.learnt(docs, rounds=2))


_HEAD_LINES = f"list_transform(string_split(content, chr(10))[1:10], lambda s: {S.strip('s')})"
_KIND_WORDS = f"regexp_matches(lower(s), {S.lit('|'.join(L.TITLE_WORDS))}) AND NOT starts_with(s, '<')"


def _head_sql(pattern: str) -> str:
    """First value after a label that begins a word, in the first 120 lines."""
    return f"nullif({S.strip('regexp_extract(array_to_string(string_split(content, chr(10))[1:120], chr(10)), ' + S.lit('(?i)(?:^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])' + pattern) + ', 1)')}, '')"


@query("p19_head", f"SELECT doc_id, coalesce(list_filter({_HEAD_LINES}, lambda s: {_KIND_WORDS})[1], 'Unknown') AS title, " + ", ".join(f"{_head_sql(L.HEAD_FIELDS[n])} AS {n}" for n in L.HEAD_FIELDS) + " FROM fx_statutes")
def p19(spark, d):
    return own(fx(spark, d, "statutes"), "doc_id", title=L.head_title(C("content")), **{n: L.head_field(C("content"), p) for n, p in L.HEAD_FIELDS.items()})


@query("p20_squeezed", f"SELECT chunk_id AS doc_id, substring(content, 1, 200) AS title, {S.strip('regexp_replace(content, ' + S.lit(L.BLANK + '+') + ', chr(32), chr(103))')} AS content FROM fx_chunks")
def p20(spark, d):
    rows = fx(spark, d, "chunks").withColumnRenamed("chunk_id", "doc_id")
    return own(rows, "doc_id", title=F.substring("content", 1, 200), content=L.squeeze(C("content")))


_HEAD = "CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang || ' – ' || source || chr(10) END || 'Điều ' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '. Tên' END"


@query("p21_headings", f"SELECT doc_id, md5(coalesce({_HEAD} || chr(10) || text, '')) AS article, md5(coalesce({_HEAD} || ' - Khoản 2. ' || text, '')) AS clause, md5(coalesce({_HEAD} || ' - Khoản 2 - Điểm a) ' || text, '')) AS point FROM documents")
def p21(spark, d):
    rows = base(spark, d, "documents")
    some = lambda c: F.when(C("doc_id") % 4 == 0, None).otherwise(C(c))
    head = (some("lang"), some("source"), C("doc_id").cast("string"), F.when(C("doc_id") % 3 == 0, "").otherwise("Tên"))
    made = {"article": L.article_text(*head, C("text")), "clause": L.clause_text(*head, F.lit("2"), C("text")), "point": L.point_text(*head, F.lit("2"), F.lit("a"), C("text"))}
    return own(rows, "doc_id", **{n: F.md5(F.coalesce(c, F.lit(""))) for n, c in made.items()})


@query("p22_formatted", f"""WITH {S.found(5)}, r AS (SELECT query_id, rank, score, corpus_id, content, {S.parts_list('corpus_id')} FROM found JOIN fx_chunks USING (chunk_id))
SELECT query_id, string_agg('[Nguồn ' || rank || '] ' || ({S.title('type', 'number')}) || CASE WHEN suffix <> '' THEN ' - Điều ' || suffix ELSE '' END || ' — `' || corpus_id || '`' || chr(10) || {S.shown('content')} || chr(10) || '(điểm: ' || printf('%.2f', round(score, 1)) || ')', chr(10) || chr(10) ORDER BY rank) AS text FROM r GROUP BY query_id""")
def p22(spark, d):
    found = retrieval.retrieve(fx(spark, d, "query_vecs"), fx(spark, d, "segments"), 5).join(fx(spark, d, "chunks"), "chunk_id")
    return retrieval.formatted(found.withColumn("score", F.round("score", 1)))


@query("p23_masked", "SELECT doc_id, md5(replace(text, secret, repeat('*', 3))) AS text FROM (SELECT doc_id, text, regexp_extract(text, '[^ ]+', 0) AS secret FROM documents WHERE regexp_matches(text, '[^ ]'))")
def p23(spark, d):
    """Each text without its first word, wherever that stands."""
    rows = base(spark, d, "documents").withColumn("secret", F.regexp_extract("text", "[^ ]+", 0)).where("secret <> ''")
    return own(rows, "doc_id", text=F.md5(L.masked(C("text"), C("secret"))))


@query("p24_captions", f"""WITH {REGISTRY_SQL}, c AS (SELECT chunk_id, {S.act_code(S.code_of('corpus_id'))} AS code, {S.parts('corpus_id')['suffix']} AS suffix FROM fx_chunks)
SELECT chunk_id, CASE WHEN suffix = '' THEN coalesce(nullif(official_title, ''), code) ELSE code || ' — Điều ' || suffix END AS caption FROM c LEFT JOIN registry ON code = act_code""")
def p24(spark, d):
    rows = fx(spark, d, "chunks").select("chunk_id", L.act_code(L.code_of(C("corpus_id"))).alias("code"), L.parse_corpus_id(C("corpus_id"))["suffix"].alias("suffix"))
    shown = rows.join(s08(spark, d), C("code") == C("act_code"), "left")
    return own(shown, "chunk_id", caption=L.display(C("code"), F.coalesce("act_name", F.lit("")), F.coalesce("official_title", F.lit("")), F.nullif("suffix", F.lit(""))))


# ---------------------------------------------------------------- filters


@query("f01_accepted", "SELECT doc_id FROM documents WHERE CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END <> '' AND coalesce(text, '') <> ''")
def f01(spark, d):
    rows = base(spark, d, "documents").withColumn("source", F.when(C("doc_id") % 4 != 0, C("source")))
    return tables.accepted(rows, "source", "text").select("doc_id")


@query("f02_required", "SELECT query_id, query_text FROM fx_queries")
def f02(spark, d):
    return tables.required(fx(spark, d, "queries"), "query_id", "query_text").select("query_id", "query_text")


@query("f03_with_tokens", f"SELECT doc_id FROM documents WHERE len({S.tokens('text')}) > 0")
def f03(spark, d):
    return base(spark, d, "documents").where(F.size(L.tokens(C("text"))) > 0).select("doc_id")


@query("f04_nonempty_chunks", f"SELECT chunk_id FROM (SELECT chunk_id, CASE WHEN chunk_id % 5 = 0 THEN {S.lit(L.BLANKS)} ELSE content END AS c FROM fx_chunks) WHERE {S.strip('c')} <> ''")
def f04(spark, d):
    rows = fx(spark, d, "chunks").withColumn("content", F.when(C("chunk_id") % 5 == 0, L.BLANKS).otherwise(C("content")))
    return tables.accepted(rows.withColumn("content", L.strip(C("content"))), "content").select("chunk_id")


@query("f05_numeric_suffix", f"SELECT chunk_id FROM fx_chunks WHERE regexp_full_match({S.parts('corpus_id')['suffix']}, '[0-9]+')")
def f05(spark, d):
    return fx(spark, d, "chunks").where(L.is_number(L.parse_corpus_id(C("corpus_id"))["suffix"])).select("chunk_id")


@query("f08_long_pieces", f"SELECT doc_id FROM documents WHERE len({S.words('text')}) >= 20")
def f08(spark, d):
    return base(spark, d, "documents").where(L.n_words(C("text")) >= 20).select("doc_id")


@query("f09_valid_requests", "SELECT conv_id, turn, length(text) BETWEEN 1 AND 1024 AND turn * 20 BETWEEN 1 AND 50 AS valid FROM conversations")
def f09(spark, d):
    rows = base(spark, d, "conversations").select("conv_id", "turn", C("text").alias("question"), (C("turn") * 20).alias("top_k"))
    return tables.valid_requests(rows).select("conv_id", "turn", "valid")


@query("f10_long_tokens", f"SELECT doc_id, len(list_filter({S.tokens('text')}, lambda x: length(x) >= 3)) AS n FROM documents")
def f10(spark, d):
    return own(base(spark, d, "documents"), "doc_id", n=F.size(F.filter(L.tokens(C("text")), lambda t: F.length(t) >= 3)))


_RANKED = "SELECT item_id, row_number() OVER (ORDER BY md5(item_id || '|42'), item_id) AS r, count(*) OVER () AS n FROM benchmark"


@query("f11_query_subset", f"SELECT q.query_id, q.query_text FROM fx_queries q JOIN ({_RANKED}) s ON q.query_id = s.item_id WHERE r > greatest(1, least(n - 1, round(n * 0.1)))")
def f11(spark, d):
    split = tables.hash_split(base(spark, d, "benchmark").select(C("item_id").alias("query_id")), "query_id", 0.1)
    return fx(spark, d, "queries").join(split.where("NOT dev"), "query_id", "left_semi").select("query_id", "query_text")


# ---------------------------------------------------------------- segmentation


def _windows(c: str, length: int, overlap: int) -> str:
    stride = length - overlap
    return f"SELECT *, CASE WHEN n <= {length} THEN 1 ELSE 1 + cast(ceil((n - {length}) / {stride}.0) AS INT) END AS w FROM (SELECT *, len(t) AS n FROM (SELECT *, {S.tokens(c)} AS t FROM fx_chunks)) WHERE n > 0"


_SEGMENTS = f"SELECT chunk_id, corpus_id, i AS part, (i - 1) * 192 AS b, least(n, (i - 1) * 192 + 256) AS e, array_to_string(t[(i - 1) * 192 + 1:least(n, (i - 1) * 192 + 256)], ' ') AS text FROM (SELECT *, unnest(range(1, w + 1)) AS i FROM ({_windows('content', 256, 64)}))"


@query("x01_windows", f"SELECT chunk_id, part, b AS span_start, e AS span_end, text FROM ({_SEGMENTS})")
def x01(spark, d):
    rows = fx(spark, d, "chunks").select("chunk_id", F.explode(segments.windows(L.tokens(C("content")))).alias("w")).where(F.size("w.tokens") > 0)
    return rows.select("chunk_id", C("w.part").alias("part"), C("w.begin").alias("span_start"), C("w.upto").alias("span_end"), F.array_join("w.tokens", " ").alias("text"))


@query("x02_char_windows", f"SELECT chunk_id, i AS part, {S.strip('substring(content, (i - 1) * 768 + 1, 1024)')} AS text FROM (SELECT *, unnest(range(1, CASE WHEN length(content) <= 1024 THEN 1 ELSE 1 + cast(ceil((length(content) - 1024) / 768.0) AS INT) END + 1)) AS i FROM fx_chunks) WHERE {S.strip('substring(content, (i - 1) * 768 + 1, 1024)')} <> ''")
def x02(spark, d):
    return fx(spark, d, "chunks").select("chunk_id", F.explode(segments.char_windows(C("content"))).alias("w")).select("chunk_id", "w.part", "w.text")


@query("x05_segment_table", f"SELECT row_number() OVER (ORDER BY chunk_id, part) - 1 AS faiss_id, chunk_id, corpus_id, {S.parts_list('corpus_id')}, part, b AS span_token_start, e AS span_token_end, text FROM ({_SEGMENTS})")
def x05(spark, d):
    return segments.segment_table(fx(spark, d, "chunks"))


@query("x06_chunk_segments", f"SELECT chunk_id, part, text FROM ({_SEGMENTS}) WHERE part <= 2")
def x06(spark, d):
    return segments.chunk_segments(fx(spark, d, "chunks"), 2)


@query("x07_sentence_pieces")
def x07(spark, d):
    return segments.split_pieces(base(spark, d, "documents"), "doc_id", "text")


# ---------------------------------------------------------------- samples


@query("sp01_dev_split", f"SELECT item_id, r <= greatest(1, least(n - 1, round(n * 0.1))) AS dev FROM ({_RANKED})")
def sp01(spark, d):
    return tables.hash_split(base(spark, d, "benchmark").select("item_id"), "item_id", 0.1)


@query("sp02_three_splits", "SELECT doc_id, CASE WHEN h < 0.8 THEN 'train' WHEN h < 0.9 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substring(md5(doc_id || '|42'), 1, 8))::BIGINT / 4294967296.0 AS h FROM documents)")
def sp02(spark, d):
    return tables.split_shares(base(spark, d, "documents").select("doc_id"), "doc_id", {"train": 0.8, "dev": 0.1, "test": 0.1})
