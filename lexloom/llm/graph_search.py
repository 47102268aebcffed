"""Nearest neighbours by a robust-pruned directed graph a shard.

The distinct vectors are dealt by hash to shards of bounded size.  Each shard builds a graph: nodes enter in batches;
a greedy beam search from the shard's central node proposes neighbours, and pruning keeps a neighbour only if no
kept one is nearer to it by the factor ALPHA; links go both ways, and full lists are pruned again.  A batch's
searches run side by side as array operations.

Queries meet every shard in blocks; a beam search over the shard's graph gives its best, distances are then taken
from the original vectors, of either precision, in double precision, and the best of all shards are kept.  Queries are a stated set, a
fixed share of the rows.

Vectors that are null or zero or hold null or non-finite components take no part, neither as queries nor as
candidates; nor does a null vec_id.  Rows that repeat a vec_id are one vector (the smallest of its rows).  Only vectors
of one length meet.  Equal vectors are one node of the graph, which knows the smallest vec_ids that it stands for, one
more than k: no more can be among a query's k nearest.  Without rows or queries there is no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import lean, stored
from lexloom.llm.near_vectors import usable

#: Components beyond these have squares that single precision can't hold; then the search runs in double precision.
TAME = (1e-15, 1e15)
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 48, 64, 128, 1.1
SHARD, QUERY_BLOCK, MOST_TASKS = 8192, 1024, 20_000


def _gaps(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own list of nodes; lists hold -1 where they have none."""
    d = x[np.maximum(ids, 0)] - q[:, None, :]
    out = np.einsum("bkd,bkd->bk", d, d)
    out[ids < 0] = np.inf
    return out


def beam_search(x: np.ndarray, links: np.ndarray, entry: int, q: np.ndarray, beam: int):
    """Best nodes and squared distances of each query (ascending, -1 and inf where missing) after a greedy search.

    Every step opens the nearest node not yet opened of each query that still has one.
    """
    b = len(q)
    ids = np.full((b, beam), -1, np.int64)
    gap = np.full((b, beam), np.inf, x.dtype)
    opened = np.ones((b, beam), bool)
    ids[:, 0], gap[:, 0], opened[:, 0] = entry, _gaps(x, q, np.full((b, 1), entry))[:, 0], False
    going = np.arange(b)
    while len(going):
        closed = opened[going]
        first = (~closed).argmax(axis=1)
        left = ~closed[np.arange(len(going)), first]
        going, first = going[left], first[left]
        if not len(going):
            break
        opened[going, first] = True
        fresh = links[ids[going, first]].astype(np.int64)
        known = (fresh[:, :, None] == ids[going][:, None, :]).any(axis=2)
        fresh[known] = -1
        g = _gaps(x, q[going], fresh)
        all_ids, all_gap = np.concatenate([ids[going], fresh], axis=1), np.concatenate([gap[going], g], axis=1)
        all_open = np.concatenate([opened[going], fresh < 0], axis=1)
        order = np.argsort(all_gap, axis=1, kind="stable")[:, :beam]
        ids[going], gap[going], opened[going] = (np.take_along_axis(a, order, axis=1) for a in (all_ids, all_gap, all_open))
    return ids, gap


def prune(x: np.ndarray, node: np.ndarray, ids: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each node's candidates (-1: none), the nearest first and each only if no kept one is alpha times nearer to it."""
    ids = np.sort(np.where(ids == node[:, None], -1, ids), axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    gap = _gaps(x, x[node], ids)
    order = np.argsort(gap, axis=1, kind="stable")
    ids, gap = np.take_along_axis(ids, order, axis=1), np.take_along_axis(gap, order, axis=1)
    own = x[np.maximum(ids, 0)]
    square = np.einsum("bkd,bkd->bk", own, own)
    apart = np.maximum(square[:, :, None] + square[:, None, :] - 2 * own @ own.transpose(0, 2, 1), 0)
    alive, out = ids >= 0, np.full((len(node), degree), -1, np.int32)
    rows, kept = np.arange(len(node)), np.zeros(len(node), np.int64)
    while alive.any():
        pick = alive.argmax(axis=1)
        some = alive[rows, pick] & (kept < degree)
        if not some.any():
            break
        out[rows[some], kept[some]] = ids[rows[some], pick[some]]
        kept += some
        alive &= alpha * alpha * apart[rows, pick] > gap
        alive[rows, pick] = False
        alive[kept >= degree] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = 512):
    """(links, entry): for each node its neighbours, -1 where it has fewer than degree."""
    n = len(x)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    links = np.full((n, degree), -1, np.int32)
    order = np.concatenate([[entry], np.setdiff1d(np.arange(n), [entry])])
    at = 1
    while at < n:
        new = order[at : at + min(batch, max(1, at // 2))]
        proposed, _ = beam_search(x, links, entry, x[new], beam)
        links[new] = prune(x, new, proposed, degree, alpha)
        # links back, and pruning where a list overflows
        source, slot = np.nonzero(links[new] >= 0)
        target, source = links[new][source, slot].astype(np.int64), new[source]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        heads, begin, many = np.unique(target, return_index=True, return_counts=True)
        width = int(many.max()) if len(many) else 0
        back = np.full((len(heads), width), -1, np.int64)
        back[np.repeat(np.arange(len(heads)), many), np.arange(len(target)) - np.repeat(begin, many)] = source
        merged = np.concatenate([links[heads].astype(np.int64), back], axis=1)
        full = (merged >= 0).sum(axis=1) > degree
        for part in np.array_split(np.flatnonzero(full), max(1, int(full.sum()) * merged.shape[1] // 40_000)):
            if len(part):
                links[heads[part]] = prune(x, heads[part], merged[part], degree, alpha)
        roomy = np.flatnonzero(~full)
        links[heads[roomy]] = -np.sort(-merged[roomy], axis=1)[:, :degree]
        at += len(new)
    return links, entry


def _tame(x: np.ndarray) -> bool:
    size = np.abs(x[x != 0])
    return not len(size) or (size.max() < TAME[1] and size.max() > TAME[0])


def raw_type(df: DataFrame, vector: str):
    """Numpy's type of the components of a column of vectors."""
    return np.float32 if df.schema[vector].dataType.elementType.simpleString() == "float" else np.float64


def index_shards(nodes: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row a shard: dim, shard, x (raw, in the vectors' own type), links (raw int32), entry, ids and id_counts.  nodes: v, ids."""
    many, raw = max(1, -(-nodes.count() // shard)), raw_type(nodes, "v")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy()).astype(raw)
        links, entry = build_graph(x.astype(np.float32 if _tame(x) else np.float64))
        counts = pdf["ids"].map(len).to_numpy(np.int32)
        row = {"dim": pdf["dim"].iloc[0], "shard": pdf["shard"].iloc[0], "entry": entry, "x": x.tobytes(), "links": links.tobytes()}
        return pd.DataFrame([row | {"ids": np.concatenate(pdf["ids"].to_numpy()).astype(np.int64).tobytes(), "id_counts": counts.tobytes()}])

    dealt = nodes.select("v", "ids", F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(many)).cast("int").alias("shard"))
    return dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, entry int, x binary, links binary, ids binary, id_counts binary")


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest found of each query, other than itself."""

    def fit(d):
        rows = d.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x + F.lit(0).cast("float")).alias("v"))
        return rows.groupBy("id").agg(F.min("v").alias("v"))

    place = Window.partitionBy("h", "g").orderBy("id")
    ranked = fit(df).withColumns({"h": F.xxhash64("v"), "g": F.xxhash64("v", F.lit(1))}).withColumn("n", F.row_number().over(place)).where(F.col("n") <= k + 1)
    nodes = stored(ranked.groupBy("h", "g").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min_by("v", "id").alias("v")).select("v", "ids"), "nodes")
    shards = stored(index_shards(nodes, shard), "graph")
    asked = fit(queries)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("asked"))
    # each block of queries goes to each shard of its length: pairs of small numbers first, then shards and blocks by them
    pairs = asked.select("dim", "block").join(shards.groupBy("dim").agg(F.collect_list("shard").alias("shards")), "dim").select("dim", "block", F.explode("shards").alias("shard"))
    # a task a shard or so, which adaptive execution leaves as they are: searching costs far more than its bytes tell
    tasks = min(MOST_TASKS, max(1, 4 * shards.count()))
    pairs = pairs.join(asked, ["dim", "block"]).join(shards.repartition(tasks, "dim", "shard").hint("merge"), ["dim", "shard"])

    raw = raw_type(nodes, "v")

    def search(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x = np.frombuffer(r.x, raw).reshape(-1, r.dim)
                links = np.frombuffer(r.links, np.int32).reshape(len(x), -1)
                counts, ids = np.frombuffer(r.id_counts, np.int32), np.frombuffer(r.ids, np.int64)
                begin = np.cumsum(counts) - counts
                query = np.array([a["id"] for a in r.asked], np.int64)
                q = np.array([a["v"] for a in r.asked], np.float64)  # what single precision held stays as it was
                kind = np.float32 if _tame(x) and _tame(q) else np.float64
                found, _ = beam_search(x.astype(kind), links, r.entry, q.astype(kind), max(SEARCH_BEAM, 2 * k))
                rows = []
                for own, v, hits in zip(query, q, found, strict=True):
                    hits = hits[hits >= 0][: max(k + 1, SEARCH_BEAM // 2)]
                    gap = np.sqrt(((x[hits].astype(np.float64) - v.astype(np.float64)) ** 2).sum(axis=1))
                    many = counts[hits]
                    who = ids[np.repeat(begin[hits] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
                    score = np.repeat(gap, many)
                    other = who != own
                    who, score = who[other], score[other]
                    best = np.lexsort((who, score))[:k]
                    rows.append(pd.DataFrame({"query_id": own, "vec_id": who[best], "score": score[best]}))
                if rows:
                    yield pd.concat(rows)

    hits = pairs.mapInPandas(lean(search), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
