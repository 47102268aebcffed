"""Pieces of DuckDB SQL that say what the column functions say."""

from __future__ import annotations

from lexloom.functions import legal_text as L


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"trim({c}, {lit(L.BLANKS)})"


def words(c: str) -> str:
    """List of a text's words."""
    return f"list_filter(string_split_regex({c}, {lit(L.BLANK + '+')}), lambda x: x <> '')"


def mapped(value: str, table: dict[str, str], otherwise: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {otherwise} END"


def part(c: str, i: int) -> str:
    return f"coalesce(regexp_extract({c}, {lit(L.CORPUS_ID)}, {i}), '')"


def parts(c: str) -> dict[str, str]:
    return {"type": f"lower({part(c, 2)})", "number": part(c, 1), "year": f"split_part({part(c, 1)}, '/', -1)", "suffix": f"ltrim({part(c, 3)}, '+')"}


def parts_list(c: str) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in parts(c).items())


def code_of(c: str) -> str:
    return strip(f"split_part({c}, '+', 1)")


def act_code(c: str, table: dict[str, str] = L.TYPE_CODES) -> str:
    p = f"string_split({strip(c)}, '/')"
    return f"CASE WHEN len({p}) < 3 THEN upper({strip(c)}) ELSE {p}[1] || '/' || {p}[2] || '/' || ({mapped(f'lower({p}[3])', table, f'upper({p}[3])')}) END"


def folded(c: str, fold=L.FOLD_D) -> str:
    return f"translate({c}, {lit(fold[0])}, {lit(fold[1])})"


def lookup_key(c: str) -> str:
    return f"lower({folded(strip(c))})"


def name_form(c: str) -> str:
    return strip(f"regexp_replace(lower({folded(c, L.FOLD)}), {lit(L.BLANK + '+')}, ' ', 'g')")


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"


def title(kind: str, number: str) -> str:
    return f"CASE WHEN {kind} = '' THEN CASE WHEN {number} = '' THEN {lit(L.UNTITLED)} ELSE {number} END ELSE ({mapped(f'lower({kind})', L.TYPE_TITLES, f'upper({kind})')}) || ' ' || {number} || '/' || upper({kind}) END"


def shown(c: str) -> str:
    return strip(f"replace({c}, '_', ' ')")


#: Inner product in double precision, rounded as the engine rounds it.
def dot(a: str, b: str) -> str:
    return f"round(list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


#: Every query vector's segments in order: hits(query_id, faiss_id, chunk_id, part, score, rank).
def hits(k: int) -> str:
    return f"""scored AS (SELECT query_id, faiss_id, chunk_id, part, {dot('q', 'embedding')} AS score FROM fx_query_vecs CROSS JOIN fx_segments),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, faiss_id) AS rank FROM scored) WHERE rank <= {k})"""


def topm(scores: str, m: int) -> str:
    """Mean of the m largest of a list."""
    return f"list_avg(list_reverse_sort({scores})[1:{m}])"


#: Retrieved chunks: found(query_id, chunk_id, score, rank), the k best of k * 5 segments.
def found(k: int) -> str:
    return f"""{hits(k * 5)},
grouped AS (SELECT query_id, chunk_id, round({topm('list(score)', 2)}, 9) AS score, round(max(score), 6) AS score_max, round(avg(score), 9) AS score_mean, count(*) AS n_segments, min(rank) AS first FROM hits GROUP BY 1, 2),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM grouped) WHERE rank <= {k})"""


#: Article entries of retrieved chunks: entries(query_id, act_code, article, score, best, n, corpus_id).
def entries(k: int) -> str:
    return f"""{found(k)},
named AS (SELECT query_id, f.rank, f.score, corpus_id, {act_code(code_of('corpus_id'))} AS act_code, {parts('corpus_id')['suffix']} AS suffix FROM found f JOIN fx_chunks USING (chunk_id)),
entries AS (SELECT query_id, act_code, suffix::INT AS article, round({topm('list(score)', 5)}, 9) AS score, max(score) AS best, count(*) AS n, arg_min(corpus_id, rank) AS corpus_id FROM named WHERE regexp_full_match(suffix, '[0-9]+') AND act_code <> '' GROUP BY 1, 2, 3)"""


#: Documents ranked by BM25: bm(query_id, doc_id, score, rank) with the top 50, zero scores filling up.
BM25 = f"""q AS (SELECT item_id AS query_id, text AS query_text FROM benchmark),
toks AS (SELECT doc_id, unnest({tokens('text')}) AS token FROM documents),
posted AS (SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl FROM toks JOIN (SELECT doc_id, count(*) AS dl FROM toks GROUP BY 1) USING (doc_id) GROUP BY 1, 2),
whole AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT doc_id, any_value(dl) AS dl FROM posted GROUP BY 1)),
raw AS (SELECT token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posted CROSS JOIN whole GROUP BY 1),
terms AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({tokens('query_text')}) AS token FROM q) GROUP BY 1, 2),
bms AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN terms USING (token) JOIN posted USING (token) CROSS JOIN whole GROUP BY 1, 2),
alls AS (SELECT query_id, doc_id, coalesce(score, 0) AS score FROM (SELECT query_id, doc_id FROM q CROSS JOIN (SELECT DISTINCT doc_id FROM posted)) LEFT JOIN bms USING (query_id, doc_id)),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM alls) WHERE rank <= 50)"""
