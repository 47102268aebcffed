"""Retrieval over segments: chunks of the best segments, articles, acts, adaptive thresholds, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import legal_text as L
from lexloom.operators import vectors


#: Means of scores with six digits keep three more, so that rounding meets no ties.
DIGITS = 9


def combined(scores: Column, strategy: str = "topm_mean", m: int = 2) -> Column:
    """One score of an array of scores: `max`, `mean`, or the mean of the m largest (also for any other name)."""
    if strategy == "max":
        return F.array_max(scores)
    if strategy == "mean":
        return F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores)
    top = F.slice(F.sort_array(scores, asc=False), 1, max(1, m))
    return F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.size(top)


def retrieve(queries: DataFrame, segments: DataFrame, k: int = 5, oversample: int = 5, strategy: str = "topm_mean", m: int = 2) -> DataFrame:
    """query_id, rank, chunk_id, score, score_max, score_mean, n_segments of each query's k best chunks.

    The k * oversample best segments of a query are grouped by chunk; chunks rank by their combined score, ties by
    their best segment.
    """
    return ranked_chunks(segment_hits(queries, segments, k, oversample), max(1, k), strategy, m)


def segment_hits(queries: DataFrame, segments: DataFrame, k: int = 5, oversample: int = 5) -> DataFrame:
    """query_id, faiss_id, score, rank, chunk_id, part of each query's max(1, k) * oversample best segments."""
    k = max(1, k)
    hits = vectors.top_k(queries, segments.select("faiss_id", "embedding"), max(k, k * oversample))
    return hits.join(segments.select("faiss_id", F.coalesce("chunk_id", "faiss_id").alias("chunk_id"), "part"), "faiss_id")


def ranked_chunks(hits: DataFrame, k: int, strategy: str = "topm_mean", m: int = 2) -> DataFrame:
    """hits: query_id, chunk_id, rank, score, and what describes a segment."""
    grouped = hits.groupBy("query_id", "chunk_id").agg(F.collect_list("score").alias("scores"), F.min("rank").alias("first"))
    scored = grouped.select(
        "query_id", "chunk_id", "first", F.round(combined(F.col("scores"), strategy, m), DIGITS).alias("score"), F.round(F.array_max("scores"), 6).alias("score_max"),
        F.round(combined(F.col("scores"), "mean"), DIGITS).alias("score_mean"), F.size("scores").alias("n_segments"),
    )
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("first"))
    return scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).drop("first")


def segment_lists(hits: DataFrame) -> DataFrame:
    """query_id, chunk_id, segments: a chunk's hits, best first."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "faiss_id", "part"))), lambda x: F.struct(x["faiss_id"].alias("faiss_id"), (-x["s"]).alias("score"), x["part"].alias("part")))
    return hits.groupBy("query_id", "chunk_id").agg(listed.alias("segments"))


def chunk_records(hits: DataFrame, chunks: DataFrame, order: str) -> DataFrame:
    """hits with their chunk's columns; of chunks with one id the last counts."""
    last = chunks.groupBy("chunk_id").agg(F.max_by(F.struct(*[c for c in chunks.columns if c not in ("chunk_id", order)]), order).alias("r"))
    return hits.join(last.select("chunk_id", "r.*"), "chunk_id", "left")


def articles(hits: DataFrame, strategy: str = "top_mean", m: int = 5) -> DataFrame:
    """query_id, act_code, article, score, best, n, corpus_id of the articles that hits (query_id, rank, corpus_id, score) name."""
    code, suffix = L.act_code(L.code_of(F.col("corpus_id"))), L.parse_corpus_id(F.col("corpus_id"))["suffix"]
    rows = hits.withColumns({"act_code": code, "article": F.when(L.is_number(suffix), suffix.cast("int"))}).where("act_code <> '' AND article IS NOT NULL")
    grouped = rows.groupBy("query_id", "act_code", "article").agg(F.collect_list("score").alias("scores"), F.max("score").alias("best"), F.count("*").alias("n"), F.min_by("corpus_id", "rank").alias("corpus_id"))
    return grouped.withColumn("score", F.round(combined(F.col("scores"), {"top_mean": "topm_mean"}.get(strategy, strategy), m), DIGITS)).drop("scores")


# Fixed values.
#: Start of the threshold and the most articles, by detail level; then what all levels share.
LEVELS = {"brief": (0.70, 5), "moderate": (0.60, 15), "comprehensive": (0.45, 30)}
LEAST_ARTICLES, FLOOR, CEILING, STEP, TRIES = 3, 0.40, 0.80, 0.05, 5
#: Articles that a level aims at; three segments an article, and at least fifteen chunks, are retrieved.
WIDTH = {"brief": 10, "moderate": 20, "comprehensive": 50}


def scan_width(level: str, per_article: int = 3) -> int:
    return max(15, WIDTH.get(level, WIDTH["moderate"]) * per_article)


def adaptive_threshold(scored: DataFrame, level: str = "moderate", key: str = "query_id", tie: tuple = ("act_code", "article")) -> DataFrame:
    """The articles that pass each query's own threshold, with threshold_used.

    The threshold moves by STEP, down while it lets too few articles pass and up while it lets too many, within its
    bounds and at most TRIES times; if no try fits, the best articles up to the level's most are taken.
    """
    start, most = LEVELS.get(level, LEVELS["moderate"])
    queries = scored.groupBy(key).agg(F.collect_list("score").alias("scores"))
    t, done = F.lit(start), F.lit(False)
    queries = queries.withColumns({"t": t, "done": done, "stop": F.lit(False)})
    for _ in range(TRIES):
        n = F.size(F.filter("scores", lambda x: x >= F.col("t")))
        going = ~F.col("done") & ~F.col("stop")
        down, up = (n < LEAST_ARTICLES) & (F.col("t") > FLOOR), (n > most) & (F.col("t") < CEILING)
        fits = n.between(LEAST_ARTICLES, most)
        moved = F.when(down, F.greatest(F.lit(FLOOR), F.col("t") - STEP)).when(up, F.least(F.lit(CEILING), F.col("t") + STEP)).otherwise(F.col("t"))
        queries = queries.withColumns({"done": F.col("done") | (going & fits), "stop": F.col("stop") | (going & ~fits & ~down & ~up), "t": F.when(going & ~fits, moved).otherwise(F.col("t"))})
    found = scored.join(queries.select(key, F.col("t").alias("threshold_used"), "done"), key)
    place = Window.partitionBy(key).orderBy(F.col("score").desc(), *tie)
    chosen = F.when(F.col("done"), F.col("score") >= F.col("threshold_used")).otherwise(F.col("place") <= most)
    return found.withColumn("place", F.row_number().over(place)).where(chosen).drop("place", "done")


def acts(entries: DataFrame) -> DataFrame:
    """query_id, act_code, doc_score, best_score, corpus_id, articles, article_count, rank of the acts of article entries."""
    grouped = entries.groupBy("query_id", "act_code").agg(
        F.max("score").alias("doc_score"), F.max("best").alias("best_score"), F.min_by("corpus_id", F.struct((-F.col("score")).alias("s"), "article")).alias("corpus_id"), F.array_sort(F.collect_set("article")).alias("articles")
    )
    place = Window.partitionBy("query_id").orderBy(F.col("doc_score").desc(), F.col("best_score").desc(), "act_code")
    return grouped.withColumn("article_count", F.size("articles")).withColumn("rank", F.row_number().over(place))


def act_groups(hits: DataFrame, k: int, strategy: str = "mean", m: int = 3) -> DataFrame:
    """Acts of chunk hits by a strategy (`mean`, `max`, `topm_mean`), the k best of each query."""
    code, suffix = L.act_code(L.code_of(F.col("corpus_id"))), L.parse_corpus_id(F.col("corpus_id"))["suffix"]
    rows = hits.withColumns({"act_code": code, "article": F.when(L.is_number(suffix), suffix.cast("int"))}).where("act_code <> ''")
    grouped = rows.groupBy("query_id", "act_code").agg(F.collect_list("score").alias("scores"), F.max("score").alias("best_score"), F.array_sort(F.collect_set("article")).alias("articles"), F.min_by("corpus_id", "rank").alias("corpus_id"))
    scored = grouped.withColumn("group_score", F.round(combined(F.col("scores"), strategy, m), DIGITS)).drop("scores")
    place = Window.partitionBy("query_id").orderBy(F.col("group_score").desc(), F.col("best_score").desc(), "act_code")
    return scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= max(1, k))


def selected_acts(entries: DataFrame, k: int, strategy: str = "mean", m: int = 3) -> DataFrame:
    """The k best acts of article entries, scored by all their articles: query_id, act_code, doc_score, best_score, corpus_id, articles, rank."""
    grouped = entries.groupBy("query_id", "act_code").agg(F.collect_list("score").alias("scores"), F.max("score").alias("best_score"), F.min_by("corpus_id", F.struct((-F.col("score")).alias("s"), "article")).alias("corpus_id"), F.array_sort(F.collect_set("article")).alias("articles"))
    scored = grouped.withColumn("doc_score", F.round(combined(F.col("scores"), strategy, m), DIGITS)).drop("scores")
    return _ranked_acts(scored).where(F.col("rank") <= max(1, k))


def acts_of_best_articles(entries: DataFrame, k: int) -> DataFrame:
    """The acts of each query's k best articles, with those articles alone; an act scores as its best one."""
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "act_code", "article")
    best = entries.withColumn("place", F.row_number().over(place)).where(F.col("place") <= max(1, k))
    grouped = best.groupBy("query_id", "act_code").agg(F.max("score").alias("doc_score"), F.max("score").alias("best_score"), F.min_by("corpus_id", "place").alias("corpus_id"), F.array_sort(F.collect_set("article")).alias("articles"))
    return _ranked_acts(grouped)


def _ranked_acts(acts: DataFrame) -> DataFrame:
    place = Window.partitionBy("query_id").orderBy(F.col("doc_score").desc(), F.col("best_score").desc(), "act_code")
    return acts.withColumn("rank", F.row_number().over(place))


def limited_articles(found: DataFrame, most: int = -1) -> DataFrame:
    """Acts with at most `most` articles each; all for a negative number."""
    return found if most < 0 else found.withColumn("articles", F.slice("articles", 1, most))


def confidence(hits: DataFrame) -> DataFrame:
    """query_id, confidence: mean similarity of a query's hits."""
    return hits.groupBy("query_id").agg(F.round(F.avg(L.similarity(F.col("score"))), 6).alias("confidence"))


# Fixed values.
CONTEXT_CHARS, ACT_CHARS, CITED_CHARS, SEGMENTS = 200_000, 40_000, 20_000, 10
OWN_PART, CITED_PART = "[Tài liệu tham khảo (toàn văn) – đã được hệ thống RAG chọn lọc]", "\n[Tài liệu trích dẫn]"


def budgeted(df: DataFrame, group: list[str], order: list[str], text: str, quota: int | Column) -> DataFrame:
    """df with `taken`: texts of a group in order until its quota of characters is spent, the last one cut."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    quota = F.lit(quota) if isinstance(quota, int) else quota
    spent = F.coalesce(F.sum(F.length(text)).over(before), F.lit(0))
    left = F.greatest(F.lit(0), F.least(F.length(text), quota - spent)).cast("int")
    return df.withColumn("__left", left).withColumn("taken", F.substring(F.col(text), F.lit(1), F.col("__left"))).drop("__left")


def contexts(pieces: DataFrame, act_chars: int = ACT_CHARS, total_chars: int = CONTEXT_CHARS) -> DataFrame:
    """query_id, context: acts in rank order, each with a header and its articles' texts within its budget, cut to the total.

    pieces: query_id, act_rank, header, article_rank, article, text.
    """
    cut = budgeted(pieces, ["query_id", "act_rank"], ["article_rank"], "text", act_chars).where("taken <> ''")
    section = F.concat(F.lit("Điều "), F.col("article").cast("string"), F.lit("\n"), F.col("taken"))
    blocks = cut.withColumn("s", section).groupBy("query_id", "act_rank", "header").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("article_rank", "s"))), lambda x: x["s"]), "\n\n").alias("body"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("act_rank", F.concat("header", F.lit("\n"), "body").alias("b")))), lambda x: x["b"]), "\n\n")
    return blocks.groupBy("query_id").agg(F.substring(whole, 1, total_chars).alias("context"))


def article_segments(articles: DataFrame, segments: DataFrame, hits: DataFrame, most: int = SEGMENTS) -> DataFrame:
    """articles (with query_id and chunk_id) with `segments`: a chunk's first `most` parts, those that were hit first.

    segments: chunk_id, part, text.  hits: query_id, chunk_id, part, score; hit parts stand best first, others by number.
    """
    rows = articles.select("query_id", "chunk_id").distinct().join(segments.where(F.col("part") <= most), "chunk_id")
    best = hits.groupBy("query_id", "chunk_id", "part").agg(F.max("score").alias("hit"))
    rows = rows.withColumn("text", L.shown(F.col("text"))).where("text <> ''").join(best, ["query_id", "chunk_id", "part"], "left")
    order = F.struct(F.col("hit").isNull().alias("late"), F.coalesce(-F.col("hit"), F.lit(0.0)).alias("s"), "part", "text")
    listed = rows.groupBy("query_id", "chunk_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["text"]).alias("segments"))
    return articles.join(listed, ["query_id", "chunk_id"], "left")


def _within(texts: Column, quota: Column) -> Column:
    """Texts in order until a quota of characters is spent, the last one cut, an empty line between."""
    begin = F.struct(quota.cast("int").alias("left"), F.array().cast("array<string>").alias("out"))

    def step(acc, t):
        own = F.substring(t, F.lit(1), F.greatest(F.lit(0), acc["left"]))
        return F.struct((acc["left"] - F.length(own)).alias("left"), F.concat(acc["out"], F.array(own)).alias("out"))

    return F.array_join(F.filter(F.aggregate(texts, begin, step, lambda acc: acc["out"]), lambda t: t != ""), "\n\n")


def _left(size: Column, quota: int | Column, group: list[str], *order: str) -> Column:
    """What is left of a quota before each row of a group."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (F.lit(quota) if isinstance(quota, int) else quota) - F.coalesce(F.sum(size).over(before), F.lit(0))


def _listed(order: str, text: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n")


def assembled(own: DataFrame, cited: DataFrame, act_chars: int = ACT_CHARS, total_chars: int = CONTEXT_CHARS, cited_chars: int = CITED_CHARS) -> DataFrame:
    """query_id, context under three budgets: acts in rank order, then what the hits cite, each kind under its heading.

    own: query_id, act_rank, header, article_rank, article, segments (texts in the order they are wanted).  An act's
    articles share its budget, headings counted; an act whose articles are null is given by its segments as they are.
    cited: query_id, act_rank, act_code, article, text; they share what the acts leave, cited_chars at most.
    """
    one = F.col("article").isNotNull()
    head = F.when(one, F.concat(F.lit("Điều "), F.col("article").cast("string"), F.lit("\n"))).otherwise("")
    rows = own.withColumn("head", head).where(F.size(F.filter("segments", lambda t: t != "")) > 0)
    size = F.length("head") + F.length(F.array_join("segments", "\n\n"))
    rows = rows.withColumn("left", _left(size, act_chars, ["query_id", "act_rank"], "article_rank")).where("left > 0")
    rows = rows.withColumn("section", F.concat("head", _within(F.col("segments"), F.col("left"))))
    blocks = rows.groupBy("query_id", "act_rank", "header").agg(_listed("article_rank", "section").alias("body")).withColumn("block", F.concat("header", F.lit("\n"), "body"))
    blocks = blocks.withColumn("left", _left(F.length("block"), total_chars, ["query_id"], "act_rank")).where("left > 0")
    blocks = blocks.withColumn("block", F.substring(F.col("block"), F.lit(1), F.col("left").cast("int")))
    whole = blocks.groupBy("query_id").agg(_listed("act_rank", "block").alias("own"), F.sum(F.length("block")).alias("spent"))
    # articles of a cited act share cited_chars, headings counted; its blocks share what is left of all
    c = cited.where("coalesce(text, '') <> ''").withColumn("section", F.concat(head, "text")).withColumn("article", F.coalesce("article", F.lit(0)))
    c = c.withColumn("left", _left(F.length("section"), cited_chars, ["query_id", "act_rank"], "article")).where("left > 0")
    c = c.withColumn("section", F.substring(F.col("section"), F.lit(1), F.col("left").cast("int")))
    c = c.groupBy("query_id", "act_rank", "act_code").agg(_listed("article", "section").alias("body"))
    c = c.withColumn("block", F.concat(F.lit("Văn bản được trích dẫn `"), "act_code", F.lit("`\n"), "body")).join(whole.select("query_id", "spent"), "query_id")
    c = c.withColumn("left", _left(F.length("block"), F.least(F.lit(cited_chars), total_chars - F.col("spent")), ["query_id"], "act_rank")).where("left > 0")
    c = c.withColumn("block", F.substring(F.col("block"), F.lit(1), F.col("left").cast("int")))
    c = c.groupBy("query_id").agg(_listed("act_rank", "block").alias("cited"))
    both = F.concat_ws("\n\n", F.lit(OWN_PART), "own", F.when(F.col("cited").isNotNull(), F.lit(CITED_PART)), "cited")
    return whole.join(c, "query_id", "left").select("query_id", F.substring(both, 1, total_chars).alias("context"))


def formatted(hits: DataFrame) -> DataFrame:
    """query_id, text: a block for each hit in rank order: number, title, article, id, text, score with two digits."""
    parts = L.parse_corpus_id(F.col("corpus_id"))
    article = F.when(L.is_number(parts["suffix"]), F.concat(F.lit(" - Điều "), parts["suffix"])).otherwise("")
    head = F.concat(F.lit("[Nguồn "), F.col("rank").cast("string"), F.lit("] "), L.title(parts["type"], parts["number"]), article, F.lit(" — `"), F.col("corpus_id"), F.lit("`\n"))
    block = F.concat(head, L.shown(F.col("content")), F.lit("\n(điểm: "), F.format_string("%.2f", "score"), F.lit(")"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"])
    return hits.groupBy("query_id").agg(F.array_join(listed, "\n\n").alias("text"))


# Fixed value: the instruction that precedes context and question.
INSTRUCTION = "Bạn là trợ lý pháp lý tiếng Việt. Trả lời ngắn gọn dựa hoàn toàn vào ngữ cảnh.\nNếu ngữ cảnh không đủ, hãy nói rõ.\n\n"


def prompt(question: Column, context: Column) -> Column:
    """Prompt of a question and its context for a user-supplied generator."""
    return F.concat(F.lit(INSTRUCTION + "Ngữ cảnh:\n"), context, F.lit("\n\nCâu hỏi: "), question)
