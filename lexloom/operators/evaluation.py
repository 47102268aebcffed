"""Scores of rankings, latencies and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import legal_text as L

# Fixed values.
RECALL_AT, MRR_AT, NDCG_AT, OVERLAP = (5, 10, 20, 50), 10, 10, 0.2


def judged(hits: DataFrame, relevant: DataFrame, key: str) -> DataFrame:
    """hits (query_id, key, rank) with rel (0 or 1).  relevant: query_id, key."""
    marks = relevant.select("query_id", key).distinct().withColumn("rel", F.lit(1))
    return hits.join(marks, ["query_id", key], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def per_query(hits: DataFrame, relevant: DataFrame, key: str, at=RECALL_AT, mrr_at: int = MRR_AT, ndcg_at: int = NDCG_AT) -> DataFrame:
    """query_id, npos, recall_k and hit_k for each k, rr, ndcg, first_rank, for every query that has a positive."""
    positives = relevant.select("query_id", key).distinct().groupBy("query_id").agg(F.count("*").alias("npos"))
    return scored(judged(hits, relevant, key), positives, at, mrr_at, ndcg_at)


def judged_by_label(hits: DataFrame, queries: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """judged() where an item is relevant to the queries (query_id, label) that have its label (key, label).

    Hits look labels up; the pairs of queries and items with one label, which grow with its square, are never made.
    """
    own = items.select(key, F.col("label").alias("__item")).where("__item IS NOT NULL").distinct()
    asked = queries.select("query_id", F.col("label").alias("__asked")).where("__asked IS NOT NULL").distinct()
    wanted = hits.select("query_id", key).distinct().join(own, key).join(asked, "query_id").where("__item = __asked").select("query_id", key)
    return judged(hits, wanted, key)


def positives_by_label(queries: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """query_id, npos: how many items have a label of the query's; queries without one are left out."""
    many = items.select(key, "label").where("label IS NOT NULL").distinct().groupBy("label").agg(F.count("*").alias("n"))
    return queries.select("query_id", "label").distinct().join(many, "label").groupBy("query_id").agg(F.sum("n").alias("npos"))


def scored(marked: DataFrame, positives: DataFrame, at=RECALL_AT, mrr_at: int = MRR_AT, ndcg_at: int = NDCG_AT) -> DataFrame:
    """What per_query() gives, of judged hits and of how many positives (query_id, npos) each query has."""
    marks = marked.where("rel = 1")
    found = [F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"found_{k}") for k in at]
    sums = marks.groupBy("query_id").agg(*found, F.min("rank").alias("first_rank"), F.sum(F.when(F.col("rank") <= ndcg_at, 1 / F.log2(F.col("rank") + 1))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("npos"), F.lit(ndcg_at)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    rows = positives.join(sums, "query_id", "left")
    own = []
    for k in at:
        n = F.coalesce(f"found_{k}", F.lit(0))
        own += [(n / F.col("npos")).alias(f"recall_{k}"), (n > 0).cast("int").alias(f"hit_{k}")]
    rr = F.when(F.col("first_rank") <= mrr_at, 1 / F.col("first_rank")).otherwise(0.0)
    return rows.select("query_id", "npos", *own, rr.alias("rr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"), "first_rank")


def summary(scored: DataFrame, at=RECALL_AT) -> DataFrame:
    """One row: means over all queries."""
    return scored.agg(F.count("*").alias("queries"), *[F.round(F.avg(f"{n}_{k}"), 6).alias(f"{n}_{k}") for k in at for n in ("recall", "hit")], F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


def hit_summary(scored: DataFrame, at=(5, 10, 20)) -> DataFrame:
    """One row: shares of queries with a hit, and the mean reciprocal rank over the queries that have one."""
    inside = F.col("first_rank") <= max(at)
    return scored.agg(*[F.round(F.avg((F.coalesce(F.col("first_rank") <= k, F.lit(False))).cast("int")), 6).alias(f"recall_{k}") for k in at], F.round(F.avg(F.when(inside, 1 / F.col("first_rank"))), 6).alias("mrr"))


def latencies(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, mean, p50, p90, max.  p90 is the ninth exclusive decile from ten values on, else the largest.

    The decile lies between two order statistics, so ranks inside the group are enough and no group is collected.
    """
    rows = df.where(F.col(value).isNotNull())
    place = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("p50"), F.max(value).alias("max"))
    ranked = rows.select(by, value, F.count("*").over(place).alias("r")).join(sizes.select(by, "n"), by)
    m = F.col("n") + 1
    j = F.greatest(F.lit(1), F.least(F.floor(9 * m / 10), F.col("n") - 1))
    weight = F.when(F.col("r") == j, 10 - (9 * m - 10 * j)).when(F.col("r") == j + 1, 9 * m - 10 * j)
    deciles = ranked.groupBy(by).agg((F.sum(F.col(value) * weight) / 10).alias("d9"))
    out = sizes.join(deciles, by)
    r = lambda c: F.round(c, 6)
    return out.select(by, "n", r("mean").alias("mean"), r("p50").alias("p50"), r(F.when(F.col("n") >= 10, F.col("d9")).otherwise(F.col("max"))).alias("p90"), r("max").alias("max"))


def lexical_overlap(df: DataFrame, answer: str, context: str, threshold: float = OVERLAP) -> DataFrame:
    """df with overlap (share of the answer's distinct tokens of three or more letters that the context has) and hallucinated."""
    words = lambda c: F.array_distinct(F.filter(L.tokens(F.col(c)), lambda w: F.length(w) >= 3))
    a, c = words(answer), words(context)
    share = F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, c)) / F.size(a))
    return df.withColumn("overlap", F.round(share, 6)).withColumn("hallucinated", F.col("overlap") < threshold)
