"""The engine's verbs over an index: ask, look up sources and citations, statistics, health.

Each verb takes and returns DataFrames, so many questions are answered by one plan.  Generation is a plug: a column
function of the prompt; without one the answer is the content of the best hit.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import legal_text as L
from lexloom.operators import citations, retrieval, segments, tables, vectors


def opened(make: Callable[[], Service], tries: int = 3, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> Service:
    """make(), tried again after a pause while it fails; the last error is raised."""
    for attempt in range(1, tries + 1):
        try:
            service = make()
            service.warm_up().first()
            return service
        except Exception:
            if attempt == tries:
                raise
            sleep(wait)
    raise ValueError("tries must be positive")


class Service:
    """chunks: chunk_id, corpus_id, content.  segments: faiss_id, chunk_id, part, embedding.  encoder: texts to vectors."""

    def __init__(self, chunks: DataFrame, segments: DataFrame, encoder: vectors.Encoder, registry: DataFrame | None = None, generate: Callable[[Column], Column] | None = None):
        self.chunks, self.segments, self.encoder, self.registry, self.generate = chunks, segments, encoder, registry, generate

    def retrieved(self, questions: DataFrame, k: int) -> DataFrame:
        """query_id, rank, chunk_id, corpus_id, content, score, segments and the rest of a hit.  questions: query_id, question.

        Questions of 1 to 1024 characters only; others are left out.
        """
        asked = tables.valid_requests(questions.withColumn("top_k", F.lit(1))).where("valid").drop("valid", "top_k")
        encoded = vectors.encoded(asked, self.encoder, "question", "q").select("query_id", "q")
        hits = retrieval.segment_hits(encoded, self.segments, k)
        found = retrieval.ranked_chunks(hits, k).join(retrieval.segment_lists(hits), ["query_id", "chunk_id"])
        return found.join(self.chunks, "chunk_id", "left")

    def warm_up(self) -> DataFrame:
        """Read the index once, so that later questions find its files near; the row of health()."""
        return self.health()

    def renewed(self, chunks: DataFrame | None = None, segments: DataFrame | None = None, registry: DataFrame | None = None) -> Service:
        """The service over a new index or registry; what isn't given stays."""
        return Service(chunks or self.chunks, segments or self.segments, self.encoder, registry or self.registry, self.generate)

    def ask(self, questions: DataFrame, level: str = "moderate") -> DataFrame:
        """query_id, answer, prompt, threshold_used, confidence, n_articles, acts, citations."""
        hits = self.retrieved(questions, retrieval.scan_width(level)).withColumn("score", L.similarity(F.col("score")))
        entries = retrieval.adaptive_threshold(retrieval.articles(hits), level)
        ranked = retrieval.acts(entries)
        found = self.cited_acts(hits)
        contexts = retrieval.assembled(self.pieces(hits, entries, ranked), self.cited_texts(found))
        best = hits.where("rank = 1").select("query_id", L.shown(F.col("content")).alias("best"))
        totals = entries.groupBy("query_id").agg(F.count("*").alias("n_articles"), F.max("threshold_used").alias("threshold_used"))
        listed = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "act_code", "articles", "doc_score"))), lambda a: a.dropFields("rank")).alias("acts"))
        sure = hits.groupBy("query_id").agg(F.round(F.avg("score"), 6).alias("confidence"))
        out = questions.join(contexts, "query_id").join(best, "query_id").join(totals, "query_id").join(listed, "query_id").join(sure, "query_id")
        prompt = retrieval.prompt(F.col("question"), F.col("context"))
        answer = self.generate(prompt) if self.generate else F.col("best")
        edges = self.cited(found)
        return out.withColumn("prompt", prompt).select("query_id", answer.alias("answer"), "prompt", "threshold_used", "confidence", "n_articles", "acts").join(edges, "query_id", "left")

    def pieces(self, hits: DataFrame, entries: DataFrame, ranked: DataFrame) -> DataFrame:
        """What a context is made of: for each article chosen its parts, hit ones first, or else its whole text."""
        order = Window.partitionBy("query_id", "act_code").orderBy(F.col("score").desc(), "article")
        rows = entries.join(ranked.select("query_id", "act_code", F.col("rank").alias("act_rank")), ["query_id", "act_code"]).withColumn("article_rank", F.row_number().over(order))
        rows = rows.join(hits.groupBy("query_id", "corpus_id").agg(F.min_by("chunk_id", "rank").alias("chunk_id")), ["query_id", "corpus_id"], "left")
        asked = hits.select("chunk_id").distinct()
        parts = segments.chunk_segments(self.chunks.join(asked, "chunk_id", "left_semi"), retrieval.SEGMENTS)
        rows = retrieval.article_segments(rows, parts, self.hit_parts(hits))
        rows = rows.withColumn("key", L.lookup_key(F.col("act_code")))
        rows = rows.join(citations.article_texts(self.chunks, retrieval.ACT_CHARS, rows), ["key", "article"], "left")
        whole = F.when(F.size("segments") > 0, F.col("segments")).otherwise(F.array(F.coalesce("text", F.lit(""))))
        return rows.withColumns({"segments": whole, "header": F.concat(F.lit("Văn bản: "), "act_code")})

    @staticmethod
    def hit_parts(hits: DataFrame) -> DataFrame:
        """query_id, chunk_id, part, score of the parts that a hit's list of segments names."""
        rows = hits.select("query_id", "chunk_id", F.explode("segments").alias("s"))
        return rows.select("query_id", "chunk_id", F.col("s.part").alias("part"), F.col("s.score").alias("score"))

    def cited_acts(self, hits: DataFrame) -> DataFrame:
        """query_id, act_code_norm, article, first: what a query's hits cite by code, or by a name that the registry has."""
        known = self.registry is not None
        rows = hits.select(F.struct("query_id", "rank").alias("hit"), "content")
        found = citations.extract(rows, "hit", "content", by_name=known, article_only=True, acts=self.registry).where("act_code_norm IS NOT NULL")
        return found.groupBy(F.col("hit.query_id").alias("query_id"), "act_code_norm", "article").agg(F.min(F.struct("hit.rank", "span_start")).alias("first"))

    @staticmethod
    def cited(found: DataFrame) -> DataFrame:
        """query_id, citations: the acts that are cited with an article, with their articles."""
        acts = found.where("article IS NOT NULL").groupBy("query_id", "act_code_norm").agg(F.array_sort(F.collect_set("article")).alias("articles"))
        return acts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("act_code_norm", "articles"))).alias("citations"))

    def cited_texts(self, found: DataFrame) -> DataFrame:
        """query_id, act_rank (in the order of mention), act_code, article, text of what is cited; all of an act where no cited article is there."""
        acts = found.groupBy("query_id", "act_code_norm").agg(F.min("first").alias("first"), F.collect_set("article").alias("articles"))
        acts = acts.withColumn("act_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "act_code_norm"))).withColumn("key", L.lookup_key(F.col("act_code_norm")))
        acts = acts.select("query_id", "act_rank", "key", F.col("act_code_norm").alias("act_code"), "articles")
        each = acts.withColumn("article", F.explode("articles"))
        some = each.join(citations.article_texts(self.chunks, retrieval.CITED_CHARS, each), ["key", "article"]).select("query_id", "act_rank", "act_code", "article", "text")
        rest = acts.join(some.select("query_id", "act_rank").distinct(), ["query_id", "act_rank"], "left_anti")
        rest = rest.join(citations.act_texts(self.chunks, retrieval.CITED_CHARS, rest), "key")
        return some.unionByName(rest.select("query_id", "act_rank", "act_code", F.lit(None).cast("int").alias("article"), "text"))

    def source(self, chunk_ids: DataFrame) -> DataFrame:
        """Chunks of the given ids; an unknown id gives no row."""
        return self.chunks.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi")

    def citation(self, requests: DataFrame) -> DataFrame:
        """act_code, text of requested articles (act_code, articles: a comma-separated list); all of an act for a null list."""
        some = citations.bulk_lookup(requests.where("articles IS NOT NULL"), lambda asked: citations.article_texts(self.chunks, asked=asked))
        whole = requests.where("articles IS NULL").select("act_code", L.lookup_key(F.col("act_code")).alias("key"))
        whole = whole.join(citations.act_texts(self.chunks, asked=whole), "key").select("act_code", "text")
        return some.unionByName(whole)

    def captions(self, codes: DataFrame) -> DataFrame:
        """act_code, caption by the registry; the code itself where it has no entry."""
        if self.registry is None:
            return codes.select("act_code", F.col("act_code").alias("caption"))
        rows = codes.join(self.registry.select("act_code", "act_name", "official_title"), "act_code", "left")
        return rows.select("act_code", L.display(F.col("act_code"), F.coalesce("act_name", F.lit("")), F.coalesce("official_title", F.lit("")), F.lit(None).cast("int")).alias("caption"))

    def stats(self) -> DataFrame:
        words = self.chunks.select(L.n_words(F.col("content")).cast("long").alias("w"))
        return words.agg(F.count("*").alias("documents"), F.sum("w").alias("words"), F.round(F.try_divide(F.sum("w"), F.count("*")), 6).alias("mean"))

    def health(self) -> DataFrame:
        """One row: chunks, segments, and segments whose chunk is missing."""
        lost = self.segments.join(self.chunks.select("chunk_id"), "chunk_id", "left_anti").agg(F.count("*").alias("lost"))
        counts = self.chunks.agg(F.count("*").alias("chunks")).crossJoin(self.segments.agg(F.count("*").alias("segments")))  # one row each
        return counts.crossJoin(lost).withColumn("healthy", (F.col("chunks") > 0) & (F.col("segments") > 0) & (F.col("lost") == 0))
