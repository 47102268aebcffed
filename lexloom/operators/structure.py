"""Structure of a statute's text: chapters, sections, articles, clauses and points, and chunks by structure.

Lines are exploded, each level's last heading is carried down by windows, so parents always come before children.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import legal_text as L
from lexloom.operators import segments

# How lines of a level begin.
_LEVELS = {
    "chapter": r"(?iud)^\s*CHƯƠNG\s+([IVXLCDM]+|[0-9]+)(?![\p{L}\p{N}_])\s*(.*)$",
    "section": r"(?iud)^\s*Mục\s+(\d+)(?![\p{L}\p{N}_])\s*(.*)$",
    "article": r"(?d)^\s*Điều\s+(\d+)\s*\.\s*(.*)$",
    "clause": r"(?d)^\s*(\d+)\s*\.\s+(.*)$",
    "point": r"(?d)^\s*\(?([a-z])\)\s+(.*)$",
}
#: The same with blanks of Unicode; only a line feed ends a line.
LEVELS = {n: p.replace(r"\s", L.BLANK) for n, p in _LEVELS.items()}
ORDER = list(LEVELS)


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, text, kind (level or 'text'), number, name, and the number of each level that holds the line."""
    rows = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "text")).where(L.strip(F.col("text")) != "")
    kind = F.coalesce(*[F.when(F.col("text").rlike(p), n) for n, p in LEVELS.items()], F.lit("text"))
    rows = rows.withColumn("kind", kind)
    part = lambda i: F.coalesce(*[F.when(F.col("kind") == n, F.regexp_extract("text", p, i)) for n, p in LEVELS.items()])
    rows = rows.withColumns({"number": part(1), "name": L.strip(part(2))})
    order = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {n: F.last(F.when(F.col("kind") == n, F.col("line")), ignorenulls=True).over(order) for n in ORDER}
    rows = rows.withColumns({f"{n}_line": c for n, c in last.items()})
    value = {n: F.last(F.when(F.col("kind") == n, F.col("number")), ignorenulls=True).over(order) for n in ORDER} | {"article_name": F.last(F.when(F.col("kind") == "article", F.col("name")), ignorenulls=True).over(order)}
    rows = rows.withColumns({f"cur_{n}": c for n, c in value.items()})
    # a level holds only until a higher one begins anew
    for i, n in enumerate(ORDER):
        above = [F.col(f"{m}_line") for m in ORDER[:i]]
        holds = F.lit(True) if not above else F.coalesce(F.col(f"{n}_line") > F.greatest(F.lit(-1), *above), F.lit(False))
        rows = rows.withColumn(n, F.when(holds, F.col(f"cur_{n}")))
    rows = rows.withColumn("article_name", F.when(F.col("article").isNotNull(), F.col("cur_article_name")))
    return rows.select(key, "line", "text", "kind", "number", "name", *ORDER, "article_name")


def counts(parsed: DataFrame, key: str) -> DataFrame:
    return parsed.groupBy(key).agg(*[F.count_if(F.col("kind") == n).alias(f"{n}s") for n in ORDER])


def chunks(parsed: DataFrame, key: str) -> DataFrame:
    """key, chunk_index, chunk_type, article, clause, point, content: a chunk for each article, clause and point.

    A chunk's body is its own line's name and the plain lines that follow it.
    """
    order = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = F.col("kind").isin("article", "clause", "point")
    start = F.last(F.when(F.col("kind") != "text", F.when(inner, F.col("line")).otherwise(-1)), ignorenulls=True).over(order)
    rows = parsed.withColumn("start", start).where("start >= 0 AND article IS NOT NULL")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.when(F.col("kind") == "text", L.strip(F.col("text"))).otherwise(F.col("name")).alias("t")))), lambda x: x["t"]), "\n")
    first = lambda c: F.min_by(c, "line").alias(c)
    own = rows.groupBy(key, "start").agg(*[first(c) for c in ("kind", *ORDER, "article_name")], body.alias("body"))
    body_of_article = L.strip(F.substring("body", F.length("article_name") + 1, F.length("body")))
    content = (
        F.when(F.col("kind") == "article", L.article_text("chapter", "section", F.col("article"), F.col("article_name"), body_of_article))
        .when(F.col("kind") == "clause", L.clause_text("chapter", "section", F.col("article"), F.col("article_name"), F.col("clause"), F.col("body")))
        .otherwise(L.point_text("chapter", "section", F.col("article"), F.col("article_name"), F.coalesce("clause", F.lit("")), F.col("point"), F.col("body")))
    )
    index = F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1
    return own.select(key, index.alias("chunk_index"), F.col("kind").alias("chunk_type"), "article", "clause", "point", content.alias("content"))


def smart_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """chunks() of docs; a text without an article heading is cut into overlapping pieces, of chunk_type 'fallback'."""
    own = chunks(lines(docs, key, text), key)
    bare = docs.where(~F.exists(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(LEVELS["article"])))
    none = [F.lit(None).cast("string").alias(c) for c in ("article", "clause", "point")]
    content = L.squeeze(F.col("piece"))
    pieces = segments.split_pieces(bare, key, text).select(key, F.col("part").alias("chunk_index"), F.lit("fallback").alias("chunk_type"), *none, content.alias("content"))
    return own.unionByName(pieces)
