"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are chosen far from each other out of a bounded sample, the more of them the more vectors
there are.  Each vector is described by its nearest pivots, nearest first.  Two vectors are compared if they share at
least two of these: the inverted lists are those of pairs of pivots, so that what stands in a list shares two, and a
list's length stays about LIST on average while the number of pivots can grow.  How many pivots describe a vector is
measured: vectors of the sample are moved in random directions until they just link with themselves, and the least of
PREFIXES counts with which at most LOSS of these pairs would be missed (the more pivots there are, and the more all
vectors point one way, the more it takes).  With exact=True, all vectors of a label and length are compared.  In a list, the
shared pivots of two vectors are counted, and the list of their two smallest answers for the pair, so each pair counts
once.  Short lists are dealt out together; long ones as pairs of blocks, which tasks take one by one.

Vectors that are null or zero, that hold null or non-finite components, or whose label is null link with nothing.
Only vectors of one length are compared.  Equal vectors are compared once and counted as often as they occur.  Rows
that repeat a vec_id are one vector (the smallest of its rows).  A null vec_id is kept and links with nothing.  An
empty table has no links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import cut, dropped, give_back, lean
from lexloom.llm.links import components

THRESHOLD = 0.98
#: How many pivots may describe a vector, the share of pairs that may be missed, and pairs that are tried.
PREFIXES, LOSS, TRIED = (6, 8, 10, 12, 16, 20), 0.001, 4000
#: Bounds of the number of all pivots.
PIVOTS = (32, 4096)
#: Largest cosine of two pivots.
APART = 0.9
#: The pivots come from a sample of so many vectors a pivot.
SAMPLE = 4
#: Members of an average list, of a block of a long one, and rows of short lists that are dealt to a task at once.
LIST, BLOCK, DEALT = 512, 1024, 8192


def usable(v: Column) -> Column:
    """Not null, all components finite, one of them not zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(v.isNotNull() & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows: pd.Series) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square over- or underflows."""
    x = np.stack(rows.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(vectors: np.ndarray, many: int) -> np.ndarray:
    """Rows of unit vectors, each the farthest from those before it, while one is left with a cosine up to APART.

    Pivots that lie closer together than vectors that link would be ranked by chance.
    """
    chosen, nearest = [0], vectors @ vectors[0]
    while len(chosen) < min(many, len(vectors)) and nearest.min() <= APART:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    return vectors[chosen]


def _within(hits: np.ndarray) -> np.ndarray:
    """Smallest index that each row of a symmetric relation reaches."""
    name = np.arange(len(hits))
    if not len(hits):
        return name
    while True:
        new = np.minimum(np.where(hits, name[None, :], len(hits)).min(axis=1), name)
        new = new[new]
        if (new == name).all():
            return name
        name = new


def pivots_for(members: int) -> int:
    """A power of two of pivots with which the pairs of pivots have lists of about LIST, of so many vectors of a label."""
    pairs = PREFIXES[0] * (PREFIXES[0] - 1) / 2
    return int(min(max(PIVOTS[0], 2 ** np.ceil(np.log2(max(1.0, 2 * pairs * members / LIST) ** 0.5))), PIVOTS[1]))


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, many: int) -> np.ndarray:
    """The numbers of each unit vector's nearest pivots, nearest first."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :many].astype(np.int32)


def prefix_for(vectors: np.ndarray, pivots: np.ndarray, threshold: float) -> int:
    """The least of PREFIXES with which pairs at the threshold share two pivots, but for a share of LOSS."""
    if len(pivots) <= PREFIXES[0] or threshold >= 1:
        return min(PREFIXES[0], len(pivots))
    rng = np.random.default_rng(len(pivots))
    a = vectors[np.arange(TRIED) % len(vectors)]
    off = rng.standard_normal(a.shape)
    off -= (off * a).sum(axis=1, keepdims=True) * a
    off /= np.maximum(np.sqrt((off * off).sum(axis=1, keepdims=True)), 1e-12)
    most = min(PREFIXES[-1], len(pivots))
    one, two = (nearest_pivots(x, pivots, most) for x in (a, threshold * a + np.sqrt(1 - threshold**2) * off))
    # where in the other's order each of a vector's pivots stands
    place = np.full((TRIED, len(pivots)), most, np.int32)
    np.put_along_axis(place, two, np.arange(most, dtype=np.int32)[None, :].repeat(TRIED, 0), axis=1)
    meets = np.maximum(np.take_along_axis(place, one, axis=1), np.arange(most))
    second = np.sort(meets, axis=1)[:, 1] if most > 1 else meets[:, 0]  # from which length on two are shared
    return next((k for k in PREFIXES if k >= most or np.mean(second >= k) <= LOSS), most)


def pair_keys(prefix: np.ndarray) -> np.ndarray:
    """For each row of pivots (distinct) a number for each pair of them; one pivot alone is paired with itself."""
    ordered = np.sort(prefix.astype(np.int64), axis=1)
    if ordered.shape[1] == 1:
        return ordered * 65536 + ordered
    i, j = np.triu_indices(ordered.shape[1], 1)
    return ordered[:, i] * 65536 + ordered[:, j]


def _linked(own: pd.DataFrame, threshold: float) -> pd.DataFrame | None:
    """Links that a list, or a pair of its blocks, answers for."""
    i, j, low, high = int(own["i"].iloc[0]), int(own["j"].iloc[0]), *divmod(int(own["key"].iloc[0]), 65536)
    v, copies, node = unit(own["v"]), own["copies"].to_numpy(np.int64), own["node"].to_numpy(np.int64)
    prefix = np.stack(own["prefix"].to_numpy())
    seen, place = np.unique(prefix, return_inverse=True)
    has = np.zeros((len(v), len(seen)), np.float32)
    has[np.arange(len(v))[:, None], place.reshape(prefix.shape)] = 1
    shared = has @ has.T
    before = has[:, : np.searchsorted(seen, high)]
    # the list's own two pivots are shared; it answers if no other shared one comes before its second
    hits = (shared >= min(2, prefix.shape[1])) & (before @ before.T == (low != high))
    if i != j:
        side = own["own"].to_numpy()
        hits &= side[:, None] != side[None, :]
    hits &= v @ v.T >= threshold
    np.fill_diagonal(hits, False)
    found = np.flatnonzero(hits.any(axis=1))
    if not len(found):
        return None
    hits = hits[np.ix_(found, found)]
    return pd.DataFrame({"node": node[found], "links": (hits @ copies[found].astype(np.float64)).astype(np.int64), "other": node[found][_within(hits)]})


def near_links(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, members: int | None = None, exact: bool = False) -> DataFrame:
    """node, links, other: how many copies of other vectors a block pair found near node, and a node it is linked with.

    vectors: node, label, v (usable, no two equal with the same label), copies.  members: the largest label's vectors.
    exact: no pivots, all vectors of a label and length stand in one list.
    """
    if members is None:
        members = vectors.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    many = pivots_for(members)
    # a bounded sample in hash order, the same whatever the partitions
    drawn = vectors.select("v", F.size("v").alias("dim"), F.xxhash64("v").alias("h")).orderBy("h").limit(SAMPLE * many).toPandas()
    chosen = {}
    for d, own in drawn.groupby("dim") if not exact else ():
        sample = unit(own["v"])
        picked = choose_pivots(sample, many)
        chosen[int(d)] = picked, prefix_for(sample, picked, threshold)
    pivots = vectors.sparkSession.sparkContext.broadcast(chosen)  # PIVOTS at most

    def describe(batches):
        for pdf in batches:
            for d, own in pdf.groupby("dim"):
                if int(d) in pivots.value:
                    order = nearest_pivots(unit(own["v"]), *pivots.value[int(d)])
                else:  # exact, or a length that the sample lacks: one list for all of it
                    order = np.zeros((len(own), 1), np.int32)
                yield own.assign(prefix=list(order), keys=list(pair_keys(order)))

    rows = vectors.withColumn("dim", F.size("v"))
    kinds = dict(rows.dtypes)
    rows = rows.mapInPandas(lean(describe), ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", prefix array<int>, keys array<bigint>")
    rows = cut(rows)
    post = rows.withColumn("key", F.explode("keys")).drop("keys")
    lists = post.groupBy("label", "dim", "key").agg(F.count("*").alias("members")).where("members > 1")
    lists = cut(lists.withColumn("blocks", F.ceil(F.col("members") / block).cast("int")))
    dealt = max(1, -(-(lists.where("blocks = 1").agg(F.sum("members")).first()[0] or 0) // DEALT))
    post = post.join(lists, ["label", "dim", "key"])
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    post = post.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    post = post.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "list": F.xxhash64("label", "dim", "key"), "short": F.col("blocks") == 1})
    # long lists go to tasks block pair by block pair, short ones many at once
    post = post.withColumns({"g": F.when(F.col("short"), F.pmod("list", F.lit(dealt))).otherwise(-1), "l": F.when(F.col("short"), 0).otherwise(F.col("list"))})
    columns = ["node", "v", "copies", "prefix", "label", "dim", "key", "own", "i", "j"]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_linked(own, threshold) for _, own in pdf.groupby(["label", "dim", "key"], sort=False) if len(own) > 1]
        give_back()
        parts = [x for x in parts if x is not None]
        return pd.concat(parts) if parts else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("node", "links", "other")})

    return post.select("g", "l", *columns).groupBy("g", "l", "i", "j").applyInPandas(lambda pdf: compare(pdf[columns]), "node bigint, links bigint, other bigint")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept, a row a vector; exact: without pivots, every pair is compared."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    linkable = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))
    # vectors that point the same way to the bit: -0.0 is 0.0
    v = F.transform("v", lambda x: x + F.lit(0).cast("float"))
    rows = rows.withColumn("v", F.when(linkable, v)).withColumns({"h": F.when(linkable, F.xxhash64("v")), "g": F.when(linkable, F.xxhash64("v", F.lit(1)))})
    distinct = rows.where("v IS NOT NULL").groupBy("label", "h", "g").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.min_by("v", "id").alias("v"))
    distinct = cut(distinct)
    found = cut(near_links(distinct.select("node", "label", "v", "copies"), threshold, exact=exact))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = distinct.select("label", "h", "g", "node", "copies").join(linked, "node", "left").join(named, "node", "left")
    # a row that nothing can equal has no class
    out = rows.select("id", "label", "h", "g").join(classes, ["label", "h", "g"], "left")
    component = F.coalesce("component", "node", "id")
    n = F.when(F.col("node").isNull(), F.lit(0).cast("long")).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    return out.select(F.col("id").alias(key), n.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
