"""Readers and writers of the engine's files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom import schemas
from lexloom.functions import legal_text as L
from lexloom.operators import tables


def read_lines(spark: SparkSession, path: str, to: str = "pos") -> DataFrame:
    """file, line (from 1), value, and a number that is dense over all files in the order of their names.

    Lines are numbered inside each part of a file that a task reads; the parts' counts are added up in the order of
    where they begin, so that no task meets a whole file, and only a row a part meets in one.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("at"), "value")
    inside = F.row_number().over(Window.partitionBy("file", "begin").orderBy("at"))
    counts = rows.groupBy("file", "begin").agg(F.count("*").alias("n"))
    before = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("file", "begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("file", "begin", before("file").alias("in_file"), before(F.lit(0)).alias("in_all"))
    numbered = rows.withColumn("i", inside).join(counts, ["file", "begin"])
    return numbered.select("file", (F.col("in_file") + F.col("i")).alias("line"), "value", (F.col("in_all") + F.col("i") - 1).alias(to))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Rows of a JSON Lines file; malformed lines are skipped, or end the run with their file and line where strict."""
    if not strict:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    bad = "malformed line"
    lines = read_lines(spark, path).where(L.strip(F.col("value")) != "")
    whole = T.StructType([*schema, T.StructField(bad, T.StringType())])
    rows = lines.select("file", "line", F.from_json("value", whole, {"columnNameOfCorruptRecord": bad}).alias("r"))
    told = F.raise_error(F.concat(F.lit("malformed JSON in "), "file", F.lit(", line "), F.col("line").cast("string")))
    checked = F.when(F.col("r").isNull() | F.col(f"r.`{bad}`").isNotNull(), told).otherwise(F.lit(True))
    return rows.where(checked).select(*[F.col(f"r.`{c}`") for c in schema.names])


def read_jsonl_repaired(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON Lines with undecodable bytes replaced."""
    raw = spark.read.text(path).select(F.make_valid_utf8("value").alias("line")).where(L.strip(F.col("line")) != "")
    return raw.select(F.from_json("line", schema).alias("r")).select("r.*")


def with_position(df: DataFrame, to: str = "pos") -> DataFrame:
    """df with a number that follows the order in which files are read: file by file, line by line.

    The numbers are not dense; order by them, or number them anew.
    """
    return df.withColumn(to, F.monotonically_increasing_id())


def read_corpus(spark: SparkSession, path: str, key: str = "_id", text: str = "text") -> DataFrame:
    """Raw corpus as the chunk table, numbered in the order of files and lines; malformed lines are skipped."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField(text, T.StringType())])
    rows = read_lines(spark, path).select("pos", F.from_json("value", schema).alias("r")).select("pos", "r.*")
    return tables.chunk_table(rows, "pos", key, text)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk table with its content trimmed; empty content stays."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else read_jsonl(spark, path, schemas.CHUNKS)
    return df.withColumn("content", L.strip(F.coalesce("content", F.lit(""))))


def _either(*names: str):
    return F.coalesce(*[F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names])


def pairs_of(raw: DataFrame) -> DataFrame:
    """query_id, corpus_id, score of pairs whose ids go by either spelling; pairs that lack one are left out."""
    rows = raw.select(_either("query-id", "query_id").alias("query_id"), _either("corpus-id", "corpus_id").alias("corpus_id"), F.col("score"))
    return rows.where("query_id IS NOT NULL AND corpus_id IS NOT NULL")


def queries_of(raw: DataFrame, order: str = "pos") -> DataFrame:
    """query_id, query_text by any of three spellings each; of one id the last row counts."""
    rows = raw.select(_either("_id", "query-id", "query_id").alias("query_id"), _either("text", "query", "query_text").alias("query_text"), order)
    return rows.where("query_id IS NOT NULL AND query_text IS NOT NULL").groupBy("query_id").agg(F.max_by("query_text", order).alias("query_text"))


def limited_queries(raw: DataFrame, limit: int, order: str = "pos") -> DataFrame:
    """The first `limit` rows with a text; without an id, idx- and the row's number among them."""
    rows = tables.numbered(raw.where("coalesce(text, '') <> ''"), order, "n").where(F.col("n") < limit)
    return rows.select(F.coalesce(F.nullif(F.col("_id"), F.lit("")), F.concat(F.lit("idx-"), F.col("n").cast("string"))).alias("query_id"), F.col("text").alias("query_text"), "n")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry of a JSON list; empty where the file is missing or no list."""
    empty = spark.createDataFrame([], schemas.REGISTRY)
    try:
        raw = spark.read.text(path, wholetext=True)
        entries = raw.select(F.posexplode(F.from_json("value", T.ArrayType(schemas.RAW_REGISTRY))).alias("pos", "r")).select("pos", "r.*")
    except AnalysisException:
        return empty
    return tables.registry(tables.registry_entries(entries)).select(*schemas.REGISTRY.fieldNames())


def read_legacy(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """name, text of a folder of XML texts, of JSON Lines, or of Parquet; texts that are too long are left out."""
    if kind == "xml":
        df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    elif kind == "jsonl":
        df = read_jsonl(spark, path, schemas.RAW_CORPUS).select(F.col("_id").alias("name"), "text")
    else:
        df = spark.read.parquet(path)
        df = df.select(F.col(df.columns[0]).cast("string").alias("name"), "text")
    return tables.within_size(df)[0]


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_parquet(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Parquet with zstd; only the listed columns that df has."""
    kept = [c for c in (columns or df.columns) if c in df.columns]
    df.select(*kept).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_table(df: DataFrame, name: str, integers: list[str] = ()) -> None:
    """Replace a table; texts in integer columns that are no numbers become nulls."""
    casts = {c: F.expr(f"try_cast(`{c}` AS int)") for c in integers if c in df.columns}
    df.withColumns(casts).write.mode("overwrite").saveAsTable(name)


def write_texts(df: DataFrame, path: str, key: str, order: str, text: str) -> None:
    """One folder of text for each key, in it one for each part of the key's joined text (see tables.joined_texts)."""
    tables.joined_texts(df, key, order, text).write.mode("overwrite").partitionBy(key, "part").text(path)


def write_index(segments: DataFrame, path: str) -> None:
    """Segments with raw and normalised vectors in the order of their ids, and one row about them."""
    from lexloom.operators import vectors

    ordered = segments.withColumn("vec_norm", vectors.normalised(F.col("embedding"))).repartitionByRange("faiss_id").sortWithinPartitions("faiss_id")
    ordered.write.mode("overwrite").parquet(f"{path}/segments")
    index_metadata(segments).write.mode("overwrite").json(f"{path}/metadata")


def read_index(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """Segments of a written index; with ids those alone: files hold ranges of ids, so others are not opened."""
    segments = spark.read.parquet(f"{path}/segments")
    return segments if ids is None else segments.where(F.col("faiss_id").isin(ids))


def search_index(queries: DataFrame, path: str, k: int) -> DataFrame:
    """query_id, faiss_id, score, rank of the k largest inner products of each query (query_id, q) with unit vectors of an index."""
    from lexloom.operators import vectors

    return vectors.top_k(queries, read_index(queries.sparkSession, path).select("faiss_id", "vec_norm"), k, vector="vec_norm")


def index_metadata(segments: DataFrame) -> DataFrame:
    fields = ",".join(sorted(segments.columns))
    return segments.agg(F.countDistinct("chunk_id").alias("total_chunks"), F.count("*").alias("total_segments")).withColumn("fields", F.lit(fields))


def write_metrics(df: DataFrame, path: str) -> None:
    """A few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def page_record(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key and the register's fields of each page; a page without a number gives nulls."""
    return pages.select(key, *[L.page_field(F.col(html), label).alias(name) for name, label in L.PAGE_FIELDS.items()])


LOSSES = "global_step bigint, epoch int, epoch_step bigint, loss double"


def append_losses(losses: DataFrame, path: str) -> None:
    """Add rows of LOSSES to a training log; each file has the header, and a repeated run adds files, no rows change."""
    losses.select(*[c.split(" ")[0] for c in LOSSES.split(", ")]).write.mode("append").option("header", True).csv(path)


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOSSES).option("header", True).csv(path)


def pending(df: DataFrame, path: str, key: str) -> DataFrame:
    """Rows whose key no earlier run has marked as done under path; all rows where there is no earlier run."""
    try:
        done = df.sparkSession.read.parquet(path)
    except AnalysisException:
        return df
    return df.join(done.select(key).distinct(), key, "left_anti")


def mark_done(df: DataFrame, path: str, key: str) -> None:
    """Remember the keys of df as done; Spark's commit makes them visible together or not at all."""
    df.select(key).distinct().write.mode("append").parquet(path)


# The rows that stand for a question set which can't be fetched, and how often each split has its row.
PLACEHOLDERS = {
    "train": (50, "Điều 1... Mọi người đều bình đẳng về quyền lợi và nghĩa vụ công dân...", "Mọi người đều bình đẳng về điều gì?", "quyền lợi và nghĩa vụ công dân", 15),
    "validation": (10, "Điều 3... Quyền con người, quyền công dân chỉ có thể bị hạn chế...", "Quyền con người có thể bị hạn chế khi nào?", "theo quy định của luật trong trường hợp cần thiết", 58),
    "test": (10, "Điều 4... quyền bất khả xâm phạm về thân thể...", "Mọi người có những quyền gì về thân thể?", "quyền sống, quyền bất khả xâm phạm về thân thể", 15),
}


def question_set(spark: SparkSession, path: str | None = None) -> DataFrame:
    """split, context, question, answer, answer_start of a question set; placeholders where path has none to read.

    path: a folder of {split}.json, each a list of rows with context, question and answers (text, answer_start).
    """
    if path is not None:
        kind = "context string, question string, answers struct<text:array<string>,answer_start:array<int>>"
        try:
            rows = [spark.read.schema(kind).option("multiLine", True).json(f"{path}/{split}.json").withColumn("split", F.lit(split)) for split in PLACEHOLDERS]
            found = rows[0].unionByName(rows[1]).unionByName(rows[2])
            return found.select("split", "context", "question", F.get("answers.text", 0).alias("answer"), F.get("answers.answer_start", 0).alias("answer_start"))
        except AnalysisException:
            pass
    rows = spark.createDataFrame([(split, *v) for split, v in PLACEHOLDERS.items()], "split string, n int, context string, question string, answer string, answer_start int")
    return rows.select("split", "context", "question", "answer", "answer_start", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("__i")).drop("__i")
