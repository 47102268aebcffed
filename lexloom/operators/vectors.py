"""Vectors: normal form, inner products, exact top-k, and encoders."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    # the norm is bound to a variable, else each component would sum anew
    by = lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))
    return F.get(F.transform(F.array(norm(v)), by), 0)


#: Queries scored against one batch of vectors at a time.
QUERY_BLOCK, VECTOR_BLOCK = 2048, 8192
#: Vectors whose products with a block of queries are held at a time.
TILE = 1024
#: Queries of which the products with TILE vectors make a batch of rows.
QUERY_TILE = 64
#: What Parquet's writer needs to keep scores of six digits as a dictionary: room for the two million between -1 and 1,
#: and pages long enough for the first, by which it decides, to repeat many.
COMPACT = {"parquet.dictionary.page.size": 1 << 24, "parquet.page.size": 1 << 23, "parquet.page.row.count.limit": 1 << 22}


def _matrix(lists: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the lists of a size, their values as the rows of a matrix)."""
    fit = np.flatnonzero(pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False) == size)
    return fit, lists.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).reshape(len(fit), size)


def nearest(ids: pa.Array, vs: pa.Array, query_ids: pa.Array, qs: pa.Array, k: int, key: str, digits: int | None) -> Iterator[pa.RecordBatch]:
    """query_id, key, score of the k vectors with the largest products with each query, and of all that tie with the last.

    Only vectors of a query's size meet it.  The products of TILE vectors are held at a time, and of each query the k
    best scores so far: what falls below them is let go.
    """
    for size in pc.unique(pc.list_value_length(qs)).drop_null().to_pylist():
        (asked, q), (own, x) = _matrix(qs, size), _matrix(vs, size)
        q = q.astype(np.float64)
        top, found = np.full((len(q), 0), -np.inf), []
        for at in range(0, len(x), TILE):
            s = q @ x[at : at + TILE].astype(np.float64).T
            if digits is not None:
                np.round(s, digits, out=s)
            s[np.isnan(s)] = -np.inf
            top = np.concatenate([top, s], axis=1)
            if top.shape[1] > k:
                top = np.partition(top, top.shape[1] - k, axis=1)[:, -k:]
            who, where = np.nonzero((s >= top.min(axis=1)[:, None]) & (s > -np.inf))
            found.append((who.astype(np.int32), (where + at).astype(np.int32), s[who, where]))
        if found:
            edge = top.min(axis=1)
            found = [(who[keep], where[keep], score[keep]) for who, where, score in found for keep in [score >= edge[who]]]
            who, where, score = (np.concatenate(part) for part in zip(*found, strict=True))
            for at in range(0, len(who), 65_536):
                some = slice(at, at + 65_536)
                columns = [query_ids.take(pa.array(asked[who[some]])), ids.take(pa.array(own[where[some]])), pa.array(score[some])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", key, "score"])


def _rounded(s: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as SQL rounds: halves go away from zero; a number too large to be scaled stays."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = s * 10.0**digits
        whole = np.rint(scaled)
        half = np.abs(scaled - whole) == 0.5
        if half.any():
            whole = np.where(half, np.trunc(scaled) + np.copysign(1.0, scaled), whole)
        whole /= 10.0**digits
        return whole if np.isfinite(scaled).all() else np.where(np.isfinite(scaled), whole, s)


def _scores(q: np.ndarray, x: np.ndarray, digits: int | None) -> np.ndarray:
    """The products of rows with columns, rounded to the digits that sums component by component round to, as in SQL.

    A matrix product adds up in another order; where that could lead to the other side of a half or out of the numbers,
    sums are made again.
    """
    score = q @ x
    if digits is None:
        return score
    largest = [float(n[np.isfinite(n)].max(initial=0.0)) for n in (np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=0)))]
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.multiply(score, 10.0**digits, out=score)
        whole = np.rint(scaled)
        off = np.abs(np.subtract(scaled, whole, out=scaled), out=scaled)
        whole /= 10.0**digits
        sure = 0.5 - 4 * (len(x) + 2) * np.finfo(float).eps * largest[0] * largest[1] * 10.0**digits
        # what is not a number is not below either
        who, where = ((), ()) if off.max(initial=0.0) < sure else np.nonzero(~(off < sure))
    for at in range(0, len(who), 4096):
        some = who[at : at + 4096], where[at : at + 4096]
        again = np.zeros(len(some[0]))
        for i in range(len(x)):
            again += q[some[0], i] * x[i, some[1]]
        whole[some] = _rounded(again, digits)
    return whole


def products(ids: pa.Array, vs: pa.Array, query_ids: pa.Array, qs: pa.Array, digits: int | None) -> Iterator[pa.RecordBatch]:
    """query_id, keys, scores of every query with every vector; the score of null vectors and of unequal sizes is null.

    A row has the scores of a query with up to TILE vectors, and a few queries meet them at a time.
    """
    sizes, own_sizes = (pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False) for x in (qs, vs))
    for size in np.unique(sizes):
        asked, alike = np.flatnonzero(sizes == size), (own_sizes == size) & (size >= 0)
        for own, known in ((np.flatnonzero(alike), True), (np.flatnonzero(~alike), False)):
            for at in range(0, len(own), TILE):
                there = pa.array(own[at : at + TILE])
                x = _matrix(vs.take(there), size)[1].astype(np.float64).T.copy() if known else None
                ends = pa.array(np.arange(QUERY_TILE + 1, dtype=np.int32) * len(there))
                keys = pa.ListArray.from_arrays(ends, pa.concat_arrays([ids.take(there)] * QUERY_TILE))
                for first in range(0, len(asked), QUERY_TILE):
                    those = pa.array(asked[first : first + QUERY_TILE])
                    if known:
                        scores = pa.array(_scores(_matrix(qs.take(those), size)[1].astype(np.float64), x, digits).ravel())
                    else:
                        scores = pa.nulls(len(those) * len(there), pa.float64())
                    columns = [query_ids.take(those), keys.slice(0, len(those)), pa.ListArray.from_arrays(ends.slice(0, len(those) + 1), scores)]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "keys", "scores"])


def compact(spark: SparkSession) -> None:
    """Set COMPACT for what the session writes; a setting that the cluster makes itself is kept."""
    own = spark.sparkContext.getConf()
    for key, value in COMPACT.items():
        if not any(own.contains(x) for x in (key, f"spark.hadoop.{key}")) and spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


def inner_products(queries: DataFrame, vectors: DataFrame, key: str = "faiss_id", query: str = "q", vector: str = "embedding", digits: int | None = 6) -> DataFrame:
    """query_id, key, score of every query (query_id, q) with every vector (key, embedding), in double precision.

    Vectors that are null or hold a null have null scores.  Batches of vectors meet a block of queries; beyond one block,
    blocks of vectors meet blocks of queries, each pair of them once, so a task holds two blocks and what comes of a tile.
    What comes of it leaves Python as lists of scores, and Spark makes the rows; compact() sets how those are written.
    """
    spark = queries.sparkSession
    compact(spark)
    cores = spark.sparkContext.defaultParallelism
    entire = lambda v: F.when(~F.exists(v, lambda x: x.isNull()), F.col(v))
    asked, rows = queries.select("query_id", entire(query).alias("q")), vectors.select(F.col(key).alias("id"), entire(vector).alias("v"))
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, keys array<{rows.schema['id'].dataType.simpleString()}>, scores array<double>"
    single = lambda found: found.select("query_id", "keys", F.posexplode("scores").alias("at", "score")).select("query_id", F.get("keys", "at").alias(key), "score")
    many = asked.count()
    if many <= QUERY_BLOCK:  # only a block of queries goes to the driver
        own = asked.toArrow().combine_chunks()
        part = [c.combine_chunks() for c in own.columns]
        return single(rows.repartition(cores).mapInArrow(lambda batches: (x for b in batches for x in products(b.column(0), b.column(1), *part, digits)), schema))
    packed = lambda df, by, size, to: df.groupBy(F.pmod(F.xxhash64(by), F.lit(size)).alias("block")).agg(F.collect_list(F.struct("*")).alias(to))
    size = max(1, -(-rows.count() // QUERY_BLOCK))
    # the number of parts is given, as adaptive planning would go by bytes, of which blocks have few for their work;
    # ranges of blocks are alike, where single blocks dealt in turn by each task leave parts with many and parts with none
    held = packed(rows, "id", size, "own").repartitionByRange(min(size, 32 * cores), "block").select("own")
    asking = packed(asked, "query_id", -(-many // QUERY_BLOCK), "asked").select("asked").hint("shuffle_replicate_nl")

    def pairs(batches):
        for b in batches:
            for own, asked in zip(*b.columns, strict=True):
                yield from products(own.values.field("id"), own.values.field("v"), asked.values.field("query_id"), asked.values.field("q"), digits)

    return single(held.crossJoin(asking).mapInArrow(pairs, schema))


def top_k(queries: DataFrame, vectors: DataFrame, k: int, key: str = "faiss_id", vector: str = "embedding", digits: int | None = 6) -> DataFrame:
    """query_id, key, score, rank of the k largest inner products of each query; ties go to the smaller key.

    Batches of vectors meet blocks of queries as matrix products; each batch keeps the k best of a query, and the
    best of all batches are ranked.  A block of queries travels as one row, so no table has to fit into memory.
    """
    many = queries.count()
    blocks = max(1, -(-many // QUERY_BLOCK))
    packed = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", F.col("q").cast("array<double>").alias("q"))).alias("asked"))
    id_type, key_type = queries.schema["query_id"].dataType, vectors.schema[key].dataType
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))

    schema = f"query_id {id_type.simpleString()}, {key} {key_type.simpleString()}, score double"
    if blocks == 1:  # one block: its size is bounded by QUERY_BLOCK
        asked = packed.select("asked").toArrow()
        if not asked.num_rows:
            return queries.sparkSession.createDataFrame([], f"query_id {id_type.simpleString()}, {key} {key_type.simpleString()}, score double, rank int")
        own = asked.column(0).combine_chunks().flatten()
        part = own.field("query_id"), own.field("q")
        hits = rows.mapInArrow(lambda batches: (x for b in batches for x in nearest(b.column(0), b.column(1), *part, k, key, digits)), schema)
    else:
        # vectors stay where their part is, and every block of queries goes to each part; a part has many blocks
        size = max(1, -(-rows.count() // VECTOR_BLOCK))
        parts_of = min(size, 4 * queries.sparkSession.sparkContext.defaultParallelism)
        held = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(size)).alias("own")).agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vs"))
        held = held.withColumn("part", F.pmod("own", F.lit(parts_of)).cast("int"))
        asked = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts_of - 1))))

        # blocks of vectors and blocks of queries, each pair of them once
        def pairs(batches):
            for b in batches:
                for ids, vs, asked in zip(*b.columns, strict=True):
                    yield from nearest(ids.values, vs.values, asked.values.field("query_id"), asked.values.field("q"), k, key, digits)

        hits = asked.join(held.hint("merge"), "part").select("ids", "vs", "asked").mapInArrow(pairs, schema)
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    return hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


Encoder = Callable[[list[str]], np.ndarray]


def hashed_words(dim: int = 64) -> Encoder:
    """An encoder that needs no model: signed hashed counts of words, of unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h & 0x80000000 else -1
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(size == 0, 1, size)

    return encode


#: Lengths of a model's input: the least, the usual, and the one tried after an input was too long.
LEAST_INPUT, USUAL_INPUT, SHORT_INPUT = 8, 512, 128


def shortened(texts: list[str], tokenizer, length: int) -> list[str]:
    """Texts cut to a number of ids and decoded again; as they are where the tokenizer fails."""
    try:
        return [tokenizer.decode(e.ids[:length], skip_special_tokens=True) for e in tokenizer.encode_batch(texts)]
    except Exception:  # noqa: BLE001 - any tokenizer may be plugged in
        return texts


def _too_long(error: Exception) -> bool:
    return any(x in str(error).lower() for x in ("index out of range", "position"))


@lru_cache(2)
def tokenizer_at(path: str):
    """The tokenizer of a file that every machine has, read once by a Python worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def careful(encoder: Encoder, tokenizer_file: str, length: int = USUAL_INPUT, fallback: Encoder | None = None) -> Encoder:
    """An encoder of queries: inputs are cut to a number of ids; too long ones are cut shorter; then another encoder.

    A first error that speaks of positions leads to a second try with at most SHORT_INPUT ids; if that fails as well,
    the fallback encodes what is as short.  Other errors stay errors.  Rows are brought to unit length.
    """
    length = max(LEAST_INPUT, length)

    def encode(texts: list[str]) -> np.ndarray:
        tokenizer = tokenizer_at(tokenizer_file)
        short = shortened(texts, tokenizer, length)
        try:
            x = encoder(short)
        except Exception as first:
            if not _too_long(first):
                raise
            short = shortened(short, tokenizer, max(16, min(length, SHORT_INPUT)))
            try:
                x = encoder(short)
            except Exception:
                if fallback is None:
                    raise
                x = fallback(shortened(short, tokenizer, SHORT_INPUT))
        x = np.asarray(x, np.float32)
        size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
        return (x / np.where(size == 0, 1, size)).astype(np.float32)

    return encode


def encoded(df: DataFrame, encoder: Encoder, text: str = "text", to: str = "embedding", batch: int = 256) -> DataFrame:
    """df with the vectors of its texts, encoded a batch at a time; null texts count as empty."""
    kept = [c for c in df.columns if c != to]
    from pyspark.sql import types as T

    schema = df.select(*kept).schema.add(to, T.ArrayType(T.FloatType()))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                own = b.slice(at, batch)
                x = encoder([t or "" for t in own.column(len(kept)).to_pylist()])
                lists = pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*(own.column(i) for i in range(len(kept))), lists], names=[*kept, to])

    return df.select(*kept, F.col(text).alias(f"text of {to}")).mapInArrow(run, schema)
