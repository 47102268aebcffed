"""Views over the driver's tables that look like a statute corpus.

One SQL text serves both engines: {name} stands for a base table, which Spark gets as a DataFrame and DuckDB by name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FX = {
    "chunks": """SELECT doc_id AS chunk_id,
 concat(cast(10 + a % 190 AS string), '/', cast(2005 + a % 18 AS string), '/',
  CASE a % 5 WHEN 0 THEN 'nđ-cp' WHEN 1 THEN 'tt-bca' WHEN 2 THEN 'tt-btp' WHEN 3 THEN 'qh13' ELSE 'ttlt-bca-btp' END,
  CASE WHEN doc_id % 11 = 10 THEN '' ELSE concat('+', cast(doc_id % 8 + 1 AS string)) END) AS corpus_id,
 CASE WHEN doc_id % 4 = 1 THEN concat(chr(9), ' ', replace(text, ', ', ',　'), chr(10), ' ') ELSE text END AS content
FROM (SELECT *, cast(floor(doc_id / 8.0) AS int) AS a FROM {documents}) d""",
    "segments": "SELECT vec_id AS faiss_id, cast(floor(vec_id / 3.0) AS bigint) AS chunk_id, cast(vec_id % 3 + 1 AS int) AS part, embedding, label FROM {embeddings}",
    "query_vecs": "SELECT vec_id AS query_id, embedding AS q, label FROM {embeddings} WHERE vec_id % 20 = 0",
    "qrels": "SELECT b.item_id AS query_id, d.doc_id AS corpus_doc FROM {benchmark} b JOIN {documents} d ON contains(d.text, b.text)",
    "queries": "SELECT item_id AS query_id, text AS query_text, item_id AS pos FROM {benchmark} UNION ALL SELECT item_id, concat(text, ' dup'), item_id + 100000 FROM {benchmark} WHERE item_id % 3 = 0",
    "citing": """SELECT doc_id AS chunk_id, concat(
 CASE doc_id % 5 WHEN 0 THEN concat('Theo khoản ', k, ' Điều ', n, ' Nghị định ', c1, ' quy định.') WHEN 1 THEN concat('Căn cứ các Điều ', n, ', ', n2, ' và 7 Thông tư ', c1, '; xem ', c2, ', điều ', n2, '.')
  WHEN 2 THEN concat('theo khoan ', k, ' dieu ', n, ' Luat Dan su 2015') WHEN 3 THEN concat('Bộ luật Dân sự, Điều ', n) ELSE concat('Nghị định ', c1, ', Điều ', n, ' khoản ', k) END,
 ' ', text, chr(10), CASE WHEN doc_id % 3 = 0 THEN concat('Thông tư ', c2, ' bãi bỏ khoản ', k, ' điều ', n2) ELSE '' END) AS content
FROM (SELECT doc_id, text, cast(doc_id % 4 + 1 AS string) AS k, cast(doc_id % 30 + 1 AS string) AS n, cast(doc_id % 7 + 40 AS string) AS n2,
 concat(cast(10 + doc_id % 40 AS string), '/', cast(2005 + doc_id % 18 AS string), '/', CASE doc_id % 3 WHEN 0 THEN 'NĐ-CP' WHEN 1 THEN 'TT-BCA' ELSE 'QĐ-TTG' END) AS c1,
 concat(cast(100 + doc_id % 25 AS string), '/', cast(1990 + doc_id % 25 AS string), '/', CASE doc_id % 2 WHEN 0 THEN 'TT-BTP' ELSE 'QH13' END) AS c2 FROM {documents}) c""",
    "registry": """SELECT p_partkey AS pos, concat(cast(10 + p_partkey % 190 AS string), '/', cast(2005 + p_partkey % 18 AS string), '/',
 CASE p_partkey % 5 WHEN 0 THEN 'nd-cp' WHEN 1 THEN 'tt-bca' WHEN 2 THEN 'TT-BTP' WHEN 3 THEN 'qh13' ELSE 'ttlt-bca-btp' END) AS so_hieu,
 p_type AS loai_van_ban, p_brand AS co_quan_ban_hanh, p_name AS trich_yeu FROM {part}""",
    "requests": "SELECT event_id, user_id, ts FROM {events}",
    "latency": "SELECT event_id AS query_id, event_type AS stage, value AS ms FROM {events}",
    "answers": "SELECT conv_id, turn, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context, role FROM {conversations}",
    "statutes": """SELECT doc_id, CASE doc_id % 5
 WHEN 0 THEN concat('Nghị định số ', cast(doc_id AS string), chr(10), 'Số: ', cast(doc_id AS string), '/2020', chr(10), 'CHƯƠNG I Quy định chung', chr(10), 'Mục 1 Phạm vi', chr(10), 'Điều 1. Đối tượng', chr(10), text, chr(10), '1. Khoản một', chr(10), 'a) điểm a', chr(10), 'b) điểm b', chr(10), '2. Khoản hai', chr(10), 'chương II Thi hành', chr(10), 'Điều 2. Hiệu lực', chr(10), '1. Từ ngày ký')
 WHEN 1 THEN concat(' THÔNG TƯ ', source, chr(10), '1. Khoản ngoài điều', chr(10), 'Điều 3.', chr(10), '(c) điểm không khoản', chr(10), text, chr(10), 'CHƯƠNG 2', chr(10), 'a) điểm sau chương', chr(10), 'Cơ quan ban hành: ', lang, ' ')
 WHEN 2 THEN concat(text, chr(10), '　Mục 2 Riêng', chr(10), '  Điều 10 . Tên　', chr(10), '2.', chr(9), 'Khoản', chr(10), text, chr(10), 'CHƯƠNGX không phải', chr(10), 'Điều 11. Tiếp')
 WHEN 3 THEN concat('Điều 2. Trước', chr(10), text, chr(10), chr(10), 'Mục 3', chr(10), 'Điều 2. Lặp', chr(10), '1. một', chr(10), text, chr(13), chr(10), '1. một nữa')
 ELSE text END AS content FROM {documents}""",
    "rows": """SELECT page_id, url, concat(html, '<table><tr><td>Số ký hiệu:</td><td> ', cast(page_id AS string), '/2020/NĐ-CP</td></tr><tr><td>Loại <b>văn bản</b></td><td>Nghị định</td></tr>',
 '<tr><td>Trích yếu</td><td>Về việc ', cast(page_id AS string), '</td></tr></table>') AS html FROM {pages}""",
}


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", FX[name]))}
    return spark.sql(FX[name], **tables)


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str) -> str:
    """SQL with the views that it names (fx_...) put before it."""
    names = list(dict.fromkeys(re.findall(r"\bfx_(\w+)", sql)))
    views = ", ".join(f"fx_{n} AS ({re.sub(r'[{}]', '', FX[n])})" for n in names)
    if not views:
        return sql
    head = re.match(r"\s*WITH (RECURSIVE )?", sql)
    if head:
        return f"WITH {head[1] or ''}{views}, {sql[head.end():]}"
    return f"WITH {views} {sql}"
