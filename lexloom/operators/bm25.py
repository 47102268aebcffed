"""BM25 over an inverted index, and hard negatives for training.

idf = ln(N - df + 0.5) - ln(df + 0.5); where that is negative, EPSILON times the mean idf of the vocabulary.  A term
counts as often as it stands in the query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import legal_text as L

# Fixed values.
K1, B, EPSILON = 1.5, 0.75, 0.25
TOP, NEGATIVES, LEAST = 50, 10, 8


def tokenised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tokens, dl (their number) of the documents that have any.

    Whoever reads dl or keys alone makes no tokens: they are counted, and a text with a letter, digit or underscore
    has one.
    """
    docs = docs.select(key, text)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # a table of few row groups would leave cores idle
        docs = docs.repartition(cores)
    some = docs.where(F.col(text).rlike(L.WORD))
    return some.select(key, L.tokens(F.col(text)).alias("tokens"), F.regexp_count(F.lower(text), F.lit(L.WORD + "+")).alias("dl"))


def postings(documents: DataFrame, only: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key, token, dl, tf; with only (token), of those tokens, so that others never reach a shuffle."""
    rows = documents.select(key, F.size("tokens").alias("dl"), F.explode("tokens").alias("token"))
    if only is not None:
        rows = rows.join(only, "token", "left_semi")
    return rows.groupBy(key, "token", "dl").agg(F.count("*").alias("tf"))


def statistics(documents: DataFrame) -> tuple[int, float, DataFrame]:
    """(number of documents, their mean length, (token, df, idf) a row a token).

    The two numbers are taken first, so that no plan counts the documents anew for each use of them; a document counts
    a token once before anything moves.
    """
    n, mean_length = documents.agg(F.count("*"), F.avg("dl")).first()
    terms = documents.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return n, mean_length or 1.0, with_idf(terms, n)


def with_idf(terms: DataFrame, n: int) -> DataFrame:
    """token, df, idf of the tokens (token, df) of n documents."""
    raw = terms.withColumn("raw", F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select("token", "df", idf.alias("idf"))  # mean is one row


def scores(queries: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """query_id, key, score of the documents that share a token with the query.  queries: query_id, query_text."""
    _, mean_length, terms = statistics(documents)
    asked = queries.select("query_id", F.explode(L.tokens(F.col("query_text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    known = asked.join(terms, "token")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean_length)))
    # a frequent token's postings meet few query rows; adaptive planning splits them where they are skewed
    joined = postings(documents, asked.select("token").distinct(), key).join(known, "token")
    return joined.groupBy("query_id", key).agg(F.round(F.sum(F.col("qtf") * part), 6).alias("score"))


#: Up to so many queries, with so many tokens, are scored batch by batch of documents; more join with the postings.
QUERY_BLOCK, QUERY_TOKENS, DOC_BLOCK = 2048, 1_000_000, 1000


def _best_of_batches(queries: DataFrame, documents: DataFrame, top: int, key: str) -> DataFrame:
    """query_id, key, score of every batch's top documents of each query (and what ties with them).

    queries: at most QUERY_BLOCK rows and QUERY_TOKENS tokens.  The workers get a list of (token, query, weight), 12
    bytes each and the vocabulary; a batch's terms meet the list by token, so neither postings nor pairs are shuffled.
    """
    _, mean_length, terms = statistics(documents)
    asked = queries.select("query_id", F.explode(L.tokens(F.col("query_text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    known = asked.join(terms, "token").select("query_id", "token", (F.col("qtf") * F.col("idf")).alias("w")).toArrow()
    ids = sorted(set(known["query_id"].to_pylist()))
    words = pc.unique(known["token"])
    place, column = pc.index_in(known["token"], value_set=words).to_numpy(), pc.index_in(known["query_id"], value_set=pa.array(ids, known.schema.field("query_id").type)).to_numpy()
    order = np.argsort(place, kind="stable")
    lists = np.searchsorted(place[order], np.arange(len(words) + 1)), column[order].astype(np.int32), known["w"].to_numpy()[order]
    id_type, key_type = queries.schema["query_id"].dataType.simpleString(), documents.schema[key].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast((words, *lists))  # bounded by a block's tokens
    many = len(ids)

    def run(batches):
        words, begin, query, weight = shared.value
        asking = np.diff(begin)
        for batch in (whole.slice(at, DOC_BLOCK) for whole in batches for at in range(0, whole.num_rows, DOC_BLOCK)):
            lists = batch.column(1)
            flat, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy())
            dl = np.diff(np.concatenate([[0], ends]))
            at = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy()
            own = np.flatnonzero(at >= 0)
            cell, tf = np.unique(np.searchsorted(ends, own, "right") * len(words) + at[own], return_counts=True)
            if not len(cell):
                continue
            doc, token = np.divmod(cell, len(words))
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / mean_length))
            score, shares = np.zeros(len(dl) * many), np.zeros(len(dl) * many, bool)
            meets = np.cumsum(asking[token])
            for some in np.array_split(np.arange(len(cell)), max(1, int(meets[-1]) // 4_000_000)):
                size = asking[token[some]]
                upto = np.cumsum(size)
                at = np.repeat(begin[token[some]] - upto + size, size) + np.arange(int(upto[-1]) if len(upto) else 0)
                pair = np.repeat(doc[some], size) * many + query[at]
                score += np.bincount(pair, weights=np.repeat(part[some], size) * weight[at], minlength=len(score))
                shares[pair] = True
            score, shares = score.reshape(len(dl), many), shares.reshape(len(dl), many)
            score = np.where(shares, np.round(score, 6), -np.inf)
            take = min(top, len(dl))
            edge = -np.partition(-score, take - 1, axis=0)[take - 1]
            who, which = np.nonzero((score >= edge) & shares)
            keys = batch.column(0).take(pa.array(who))
            yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in which], pa_type), keys, pa.array(score[who, which])], names=["query_id", key, "score"])

    pa_type = pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()
    return documents.select(key, "tokens").mapInArrow(run, f"query_id {id_type}, {key} {key_type}, score double")


def ranking(queries: DataFrame, documents: DataFrame, top: int = TOP, key: str = "doc_id") -> DataFrame:
    """query_id, key, score, rank of the top documents; documents without a common token follow with 0, in key order.

    Any of the first `top` documents by key that do not match fill a short list, so no more are looked at.
    """
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    size = queries.select(F.regexp_count(F.lower("query_text"), F.lit(L.WORD + "+")).alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    block = size[0] <= QUERY_BLOCK and size[1] <= QUERY_TOKENS and queries.schema["query_id"].dataType.simpleString() in ("bigint", "int", "string")
    scored = _best_of_batches(queries, documents, top, key) if block else scores(queries, documents, key)
    found = scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return filled(found.drop("rank"), queries, documents, top, key)


def filled(found: DataFrame, queries: DataFrame, documents: DataFrame, top: int, key: str) -> DataFrame:
    """query_id, key, score, rank of what was found (query_id, key, score), then documents with score 0 up to `top`."""
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    heads = documents.select(key).distinct().orderBy(key).limit(2 * top)
    filler = queries.select("query_id").distinct().crossJoin(F.broadcast(heads)).withColumn("score", F.lit(0.0))  # heads has at most 2 * top rows
    # what was found outdoes its own filler, so the scores are worked out for one branch of the plan alone
    both = found.select("query_id", key, "score").withColumn("own", F.lit(1)).unionByName(filler.withColumn("own", F.lit(0)))
    both = both.groupBy("query_id", key).agg(F.max(F.struct("own", "score"))["score"].alias("score"))
    return both.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)


def hard_negatives(ranked: DataFrame, positives: DataFrame, many: int = NEGATIVES, key: str = "doc_id") -> DataFrame:
    """query_id, key, rank: of each query's ranking, what is not one of its positives, the first `many`."""
    left = ranked.join(positives.select("query_id", key), ["query_id", key], "left_anti")
    place = Window.partitionBy("query_id").orderBy("rank")
    return left.withColumn("n", F.row_number().over(place)).where(F.col("n") <= many).select("query_id", key, F.col("n").alias("rank"))


def triplets(queries: DataFrame, positives: DataFrame, negatives: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each positive that the corpus has: texts of query, positive and the negatives in rank order."""
    texts = docs.select(key, "text")
    listed = lambda field: F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(field).alias("v")))), lambda x: x["v"])
    lists = negatives.join(texts, key).groupBy("query_id").agg(listed(key).alias("negative_ids"), listed("text").alias("negative_texts"))
    own = positives.select("query_id", key).join(texts, key).select("query_id", F.col(key).alias("positive_id"), F.col("text").alias("positive_text"))
    return own.join(queries.select("query_id", "query_text"), "query_id").join(lists, "query_id")


def negative_statistics(negatives: DataFrame, queries: DataFrame, least: int = LEAST) -> DataFrame:
    """One row: queries, those with enough negatives, their share, mean, median, least and most, those with too few."""
    n = queries.select("query_id").distinct().join(negatives.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    enough = F.count_if(F.col("n") >= least)
    return n.agg(
        F.count("*").alias("total"), enough.alias("enough"), F.round(enough / F.count("*"), 6).alias("ratio"), F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"),
        F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("n") < least).alias("insufficient"),
    )
