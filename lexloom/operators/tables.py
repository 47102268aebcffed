"""Relational operators: ids in order, first and last of a key, checked joins, set operations, splits.

Order never comes from a file: every operator that says first, last or n-th takes the column that orders the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import legal_text as L
from lexloom.session import scratch


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, so that what loops over it works it out once; see forgotten()."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forgotten(df: DataFrame) -> None:
    """Delete the table of a frame that written() gave; nothing may read it any more."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, order: str, to: str, rows: int = 65_536, width: int | None = None) -> DataFrame:
    """df with dense numbers from 0 in the order of a bigint column of distinct values.

    Rows are numbered inside ranges of the column and the ranges' counts are added up, so no task meets all rows.
    Unless the ranges' width is given, it comes from the column's bounds so that a range has about `rows` rows, and
    there are as many ranges as that makes, whether the values are dense or spread out.
    """
    if width is None:
        low, high, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
        width = max(1, -(-(high - low + 1) * rows // n)) if n and low is not None else 1
    rows = df.withColumn("__part", F.floor(F.col(order) / F.lit(float(width))))
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return rows.withColumn("__i", inside).join(counts, "__part").withColumn(to, F.col("__before") + F.col("__i") - 1).drop("__part", "__i", "__before")


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in the given order."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")


def dedup_first(df: DataFrame, key: str, order: str) -> DataFrame:
    return first_of(df, [key], F.col(order).asc())


def dedup_last(df: DataFrame, key: str, order: str) -> DataFrame:
    return first_of(df, [key], F.col(order).desc())


def required(df: DataFrame, *columns: str) -> DataFrame:
    """df; a row whose column is null or empty ends the query with an error."""
    checked = {c: F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.raise_error(F.lit(f"missing {c}"))).otherwise(F.col(c)) for c in columns}
    return df.withColumns(checked)


def accepted(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are neither null nor empty."""
    for c in columns:
        df = df.where(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return df


def within_size(df: DataFrame, text: str = "text", most: int = 10 * 1024 * 1024) -> tuple[DataFrame, DataFrame]:
    """(rows whose text has at most `most` characters, the others with an error column)."""
    fits = F.coalesce(F.length(text) <= most, F.lit(True))
    return df.where(fits), df.where(~fits).withColumn("error", F.lit(f"longer than {most} characters"))


def valid_requests(df: DataFrame, question: str = "question", top_k: str = "top_k") -> DataFrame:
    """df with `valid`: a question of 1 to 1024 characters and a top_k of 1 to 50."""
    ok = F.length(question).between(1, 1024) & F.col(top_k).between(1, 50)
    return df.withColumn("valid", F.coalesce(ok, F.lit(False)))


def chunk_table(corpus: DataFrame, order: str, key: str = "corpus_id", text: str = "content") -> DataFrame:
    """Accepted rows of a raw corpus as chunks: dense id, parts of the id, words, preview of 200 characters."""
    rows = numbered(accepted(corpus, key, text), order, "chunk_id")
    return rows.select(
        "chunk_id", F.col(key).alias("corpus_id"), *[c.alias(n) for n, c in L.parse_corpus_id(F.col(key)).items()],
        F.col(text).alias("content"), L.n_words(F.col(text)).alias("word_count"), F.substring(text, 1, 200).alias("preview"),
    )


def enriched_pairs(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs with their query's text and their document's id parts; a pair without its query ends the run."""
    lost = pairs.join(queries, "query_id", "left_anti")
    if not lost.isEmpty():
        raise ValueError("pairs without a query: " + ", ".join(str(r["query_id"]) for r in lost.select("query_id").distinct().limit(5).collect()))
    parts = L.parse_corpus_id(F.col("corpus_id"))
    joined = pairs.join(queries.select("query_id", "query_text"), "query_id")
    return joined.select(
        "query_id", "query_text", "corpus_id", F.coalesce("score", F.lit(1.0)).alias("score"),
        parts["type"].alias("doc_type"), parts["number"].alias("doc_number"), parts["year"].alias("doc_year"), parts["suffix"].alias("doc_suffix"),
    )


def registry_entries(raw: DataFrame) -> DataFrame:
    """Entries of either register's schema in one: code, name, title, year, type, issuer, with pos; without a code none."""
    own = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in raw.columns], F.lit(None).cast("string"))
    code = L.act_code(own("act_code", "so_hieu"))
    official = F.coalesce(own("official_title", "trich_yeu"), F.lit(""))
    kind = own("act_type", "loai_van_ban")
    capitals = (F.lower(own("loai_van_ban", "act_type")) == "luật") & (official != "") & (F.upper(official) == official)
    name = F.coalesce(own("act_name"), F.when(capitals, F.initcap(official)), F.lit(""))
    year = F.expr("try_cast(regexp_extract(act_code, '^[^/]*/([0-9]+)(/|$)', 1) AS int)")
    given = F.col("year").cast("int") if "year" in raw.columns else F.lit(None).cast("int")
    out = raw.select("pos", code.alias("act_code"), name.alias("act_name"), official.alias("official_title"), given.alias("__year"), kind.alias("act_type"), own("issuer", "co_quan_ban_hanh").alias("issuer"))
    return out.where("act_code <> ''").withColumn("year", F.coalesce("__year", year)).drop("__year")


def registry(entries: DataFrame) -> DataFrame:
    """Of entries with one code, that with the most text (name twice, title once), the earlier of two alike."""
    size = 2 * F.length("act_name") + F.length("official_title")
    return first_of(entries, ["act_code"], size.desc(), F.col("pos").asc())


def resolved(df: DataFrame, acts: DataFrame, code: str = "act_code") -> DataFrame:
    """df with the act's registry columns; nulls where the registry lacks it."""
    return df.join(acts.drop("pos"), df[code] == acts["act_code"], "left").drop(acts["act_code"])


def reverse_index(chunks: DataFrame) -> DataFrame:
    """key, article, chunk_ids: the chunks of each article of each act, in the order of chunk ids."""
    rows = chunks.where(L.is_number(F.col("suffix"))).select(L.lookup_key(L.code_of(F.col("corpus_id"))).alias("key"), F.col("suffix").cast("int").alias("article"), "chunk_id")
    return rows.groupBy("key", "article").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))


def hash_split(ids: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """ids with `dev`: about ratio of them (at most half, at least one, never all), by rank of a seeded hash."""
    n = ids.count()
    take = max(1, min(n - 1, round(n * min(0.5, max(0.0, ratio))))) if n > 1 else 0
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), 1, 15), 16, 10).cast("long")
    # about ten thousand ids share a range of hashes, so ranks need no sort of all ids in one task
    ranked = numbered(ids.withColumn("__h", h), "__h", "__rank", width=(1 << 60) // max(1, n // 10_000))
    return ranked.withColumn("dev", F.col("__rank") < take).drop("__h", "__rank")


def split_shares(ids: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """ids with `split`, by where a seeded hash of the key falls among the shares."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    out, upto = None, 0.0
    for name, share in list(shares.items())[:-1]:
        upto += share
        out = F.when(h < upto, name) if out is None else out.when(h < upto, name)
    last = list(shares)[-1]
    return ids.withColumn("split", F.lit(last) if out is None else out.otherwise(last))


#: Values of the order column that share a part of a key's joined text.
PART = 4096


def joined_texts(df: DataFrame, key: str, order: str, text: str, part: int = PART) -> DataFrame:
    """key, part, text: the texts of a key in order, blanks dropped, underscores as spaces, an empty line between.

    order is a bigint column; each range of `part` of its values is a row of its own, so no row grows with the key.
    """
    rows = df.select(key, F.col(order).alias("__order"), L.shown(F.col(text)).alias("t")).where("t <> ''")
    rows = rows.withColumn("part", F.floor(F.col("__order") / part))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("__order", "t"))), lambda x: x["t"])
    return rows.groupBy(key, "part").agg(F.array_join(listed, "\n\n").alias("text"))
