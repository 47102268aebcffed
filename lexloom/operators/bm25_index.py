"""A stored BM25 index: postings in blocks of documents with their largest impact, so that a search skips blocks.

Documents are dealt to shards by a hash of their key and numbered inside by key.  A block is a token's postings among
BLOCK consecutive documents of a shard, a row of the table `postings`; its impacts are what BM25 gives a term before
its idf, and `most` is the largest.  A search adds up, for each block of documents, the most that a query's tokens can
give; blocks are scored from the highest bound down until the bound falls below the top-th best score, so the rest need
not be looked at.  The tables outlive the search, the corpus is not read again.  Scores and ranks are those of
bm25.ranking.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import legal_text as L
from lexloom.operators import bm25

#: Documents of a block and, about, of a shard.
BLOCK, SHARD = 256, 8192
#: Tokens of blocks of queries that are sent to all tasks; more join with the postings by token.
WANTED = 100_000


def block_postings(shard: int, first: int, lists: pa.Array, mean_length: float) -> pa.RecordBatch:
    """The postings of the tokens of at most BLOCK documents, placed from `first` on: a row a token."""
    sizes = pc.list_value_length(lists).to_numpy()
    coded = lists.flatten().dictionary_encode()
    cell, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * BLOCK + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
    token, own = np.divmod(cell, BLOCK)
    impact = tf * (bm25.K1 + 1) / (tf + (bm25.K1 * (1 - bm25.B) + bm25.K1 * bm25.B / mean_length * sizes[own]))
    many = len(coded.dictionary)
    ends = np.searchsorted(token, np.arange(many + 1))
    listed = lambda values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
    same = lambda value: pa.array(np.full(many, value, np.int32))
    columns = [same(shard), coded.dictionary, same(first // BLOCK), listed((own + first).astype(np.int32)), listed(impact), pa.array(np.maximum.reduceat(impact, ends[:-1]))]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "token", "block", "place", "impact", "most"])


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Write the index of docs under path: documents, postings, terms.

    Texts move once, to the task of their shard, in the order of their places; a block's tokens are counted there, so no
    token of a document is a row and postings do not move.
    """
    spark, documents = docs.sparkSession, bm25.tokenised(docs, key, text)
    shards = max(1, -(-docs.count() // SHARD))
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard")
    own = documents.select(F.col(key).alias("key"), "dl", shard)
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.asc_nulls_first("key"))) - 1
    own.withColumn("place", place).write.parquet(f"{path}/documents")
    many, mean_length = spark.read.parquet(f"{path}/documents").agg(F.count("*"), F.avg("dl")).first()

    def blocks(batches):
        shard, place, waiting = None, 0, []
        for batch in batches:
            shards, at = batch.column(0).to_numpy(), 0
            while at < len(shards):
                if waiting and shards[at] != shard:
                    yield block_postings(shard, place - sum(map(len, waiting)), pa.concat_arrays(waiting), mean_length)
                    waiting = []
                if shards[at] != shard:
                    shard, place = int(shards[at]), 0
                upto = min(int(np.searchsorted(shards, shard, "right")), at + BLOCK - place % BLOCK)
                waiting.append(batch.column(1).slice(at, upto - at))
                at, place = upto, place + upto - at
                if place % BLOCK == 0:
                    yield block_postings(shard, place - BLOCK, pa.concat_arrays(waiting), mean_length)
                    waiting = []
        if waiting:
            yield block_postings(shard, place - sum(map(len, waiting)), pa.concat_arrays(waiting), mean_length)

    # the documents and the order that places were given for
    dealt = docs.where(F.col(text).rlike(L.WORD)).select(F.col(key).alias("key"), text, shard).repartitionById(shards, "shard").sortWithinPartitions("shard", F.asc_nulls_first("key"))
    postings = dealt.select("shard", L.tokens(F.col(text)).alias("tokens")).mapInArrow(blocks, "shard int, token string, block int, place array<int>, impact array<double>, most double")
    # sorted by token, so that a scan reads the row groups of the tokens asked for
    postings.sortWithinPartitions("shard", "token", "block").write.parquet(f"{path}/postings")
    terms = spark.read.parquet(f"{path}/postings").groupBy("token").agg(F.sum(F.size("place")).alias("df"))
    bm25.with_idf(terms, many).write.parquet(f"{path}/terms")


def best_blocks(asked: list[tuple[float, dict]], blocks: int, top: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores) of a shard's best documents for a query and how many blocks of documents were scored.

    asked: of each token its weight and its blocks, {block: (places, impacts, most)}.  All that tie with the top-th stay.
    """
    bound, some = np.zeros(blocks), np.zeros(blocks, bool)
    for weight, own in asked:
        for b, (_, _, most) in own.items():
            bound[b] += max(weight, 0.0) * most
            some[b] = True
    held: list[tuple[np.ndarray, np.ndarray]] = []
    least, scored, many = -np.inf, 0, 0
    for b in np.argsort(-bound, kind="stable"):
        # scores are rounded to six digits
        if not some[b] or many >= top and bound[b] < least - 1e-6:
            if some[b]:
                break
            continue
        score, shares = np.zeros(BLOCK), np.zeros(BLOCK, bool)
        for weight, own in asked:
            if b in own:
                at = own[b][0] - b * BLOCK
                score[at] += weight * own[b][1]
                shares[at] = True
        at = np.flatnonzero(shares)
        held.append((at + b * BLOCK, np.round(score[at], 6)))
        scored, many = scored + 1, many + len(at)
        if many >= top:
            every = np.concatenate([s for _, s in held])
            least = -np.partition(-every, top - 1)[top - 1]
    if not held:
        return np.zeros(0, np.int64), np.zeros(0), scored
    places, scores = (np.concatenate(x) for x in zip(*held, strict=True))
    keep = scores >= least
    return places[keep], scores[keep], scored


def search(spark: SparkSession, path: str, queries: DataFrame, top: int = bm25.TOP) -> DataFrame:
    """query_id, key, score, rank: the top documents of each query (query_id, query_text) among those that share a token."""
    terms, postings, documents = (spark.read.parquet(f"{path}/{t}") for t in ("terms", "postings", "documents"))
    asked = queries.select("query_id", F.explode(L.tokens(F.col("query_text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    weights = asked.join(terms, "token").select("query_id", "token", (F.col("qtf") * F.col("idf")).alias("weight"))
    # blocks of queries meet the postings by token, then a shard's postings of a block's tokens meet in one group
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // bm25.QUERY_BLOCK)))).cast("int")
    weights = weights.withColumn("queries", block)
    wanted = weights.select("queries", "token").distinct()
    if wanted.limit(WANTED + 1).count() <= WANTED:  # else the whole index would be dealt out by token
        wanted = F.broadcast(wanted)
    found = postings.join(wanted, "token").select("queries", "shard", "token", "block", "place", "impact", "most")
    id_type = queries.schema["query_id"].dataType.simpleString()
    # every shard is asked all queries
    last = documents.agg(F.max("shard")).first()[0] or 0
    own = weights.select(F.col("queries").alias("asked_by"), F.explode(F.sequence(F.lit(0), F.lit(last))).alias("asked_of"), "query_id", "token", "weight")

    def best(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"query_id": [], "shard": [], "place": [], "score": []})
        held: dict[str, dict] = {}
        for token, b, place, impact, most in rows[["token", "block", "place", "impact", "most"]].itertuples(index=False):
            held.setdefault(token, {})[b] = np.asarray(place), np.asarray(impact), most
        blocks, out = int(rows["block"].max()) + 1, []
        for query, own in asking.groupby("query_id"):
            places, scores, _ = best_blocks([(w, held[t]) for t, w in zip(own["token"], own["weight"], strict=True) if t in held], blocks, top)
            out.append(pd.DataFrame({"query_id": query, "shard": int(rows["shard"].iloc[0]), "place": places, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "shard": [], "place": [], "score": []})

    hits = found.groupBy("queries", "shard").cogroup(own.groupBy("asked_by", "asked_of")).applyInPandas(best, f"query_id {id_type}, shard int, place int, score double")
    hits = hits.join(documents.select("shard", "place", "key"), ["shard", "place"])
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.asc_nulls_first("key"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "key", "score", "rank")


def ranking(spark: SparkSession, path: str, queries: DataFrame, top: int = bm25.TOP) -> DataFrame:
    """search(), with documents without a common token behind, with score 0 in key order, until there are top."""
    documents = spark.read.parquet(f"{path}/documents").select("key")
    return bm25.filled(search(spark, path, queries, top), queries, documents, top, "key")
