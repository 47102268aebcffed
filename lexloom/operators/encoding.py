"""Linear encoders that are learnt from a corpus: latent vectors by block power iteration, and training by contrast.

A text is a sparse row: its words, lower-cased, hashed to 2^bits places, weigh (1 + ln tf) * idf, and the row has unit
length (a text without words is a row of zeros).  An encoder is a matrix of 2^bits rows; a text's vector is the product
of its row with it.  Whatever is summed over a corpus has that shape, or one column: tasks add up what their rows give,
their sums meet by blocks of places, and only the total, whose size the parameters fix, comes to the driver.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.operators import tables, vectors

#: Places that words are hashed to, as a power of two, and components of a vector.
BITS, SIZE = 15, 64
#: Places whose sums travel together, and the entries of sparse rows that are multiplied at a time.
BLOCK, ENTRIES = 1024, 100_000
_WORD = re.compile(r"\w+")


@lru_cache(1 << 18)
def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


@dataclass
class Rows:
    """Sparse rows one after the other: places, weights, and how many entries each has."""

    ids: np.ndarray
    weights: np.ndarray
    sizes: np.ndarray

    def portions(self):
        """(first row, rows) with a bounded number of entries; one row stands alone at the least."""
        ends, at = np.cumsum(self.sizes), 0
        while at < len(self.sizes):
            begin = int(ends[at] - self.sizes[at])
            upto = max(at + 1, int(np.searchsorted(ends, begin + ENTRIES, "right")))
            yield at, Rows(self.ids[begin : ends[upto - 1]], self.weights[begin : ends[upto - 1]], self.sizes[at:upto])
            at = upto

    def times(self, matrix: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.sizes), matrix.shape[1]))
        for at, own in self.portions():
            held = np.flatnonzero(own.sizes)
            if len(held):
                first = (np.cumsum(own.sizes) - own.sizes)[held]
                out[at + held] = np.add.reduceat(own.weights[:, None] * matrix[own.ids], first, axis=0)
        return out

    def transposed_times(self, matrix: np.ndarray, into: np.ndarray) -> None:
        """Add the product of the rows' transpose with a matrix to `into`."""
        for at, own in self.portions():
            if len(own.ids):
                order = np.argsort(own.ids, kind="stable")
                row = np.repeat(np.arange(at, at + len(own.sizes)), own.sizes)[order]
                places, first = np.unique(own.ids[order], return_index=True)
                into[places] += np.add.reduceat(own.weights[order][:, None] * matrix[row], first, axis=0)


def counted(texts: Iterable[str | None], bits: int = BITS) -> Rows:
    """Sparse rows of how often a text has the words of each place."""
    mask, ids, counts, sizes = (1 << bits) - 1, [], [], []
    for text in texts:
        own: Counter = Counter()
        for word, n in Counter(_WORD.findall((text or "").lower())).items():
            own[_hash(word) & mask] += n
        ids += own.keys()
        counts += own.values()
        sizes.append(len(own))
    return Rows(np.array(ids, np.int64), np.array(counts, np.float64), np.array(sizes, np.int64))


@dataclass
class Encoder:
    """A linear encoder; called with texts it gives their vectors, not brought to unit length."""

    bits: int
    idf: np.ndarray
    matrix: np.ndarray

    def rows(self, texts: Iterable[str | None]) -> Rows:
        own = counted(texts, self.bits)
        weights = (1 + np.log(own.weights)) * self.idf[own.ids]
        of = np.repeat(np.arange(len(own.sizes)), own.sizes)
        length = np.sqrt(np.bincount(of, weights=weights**2, minlength=len(own.sizes)))
        return Rows(own.ids, weights / np.where(length == 0, 1, length)[of], own.sizes)

    def __call__(self, texts: list[str]) -> np.ndarray:
        return self.rows(texts).times(self.matrix).astype(np.float32)


# ---------------------------------------------------------------- sums over a corpus


def summed(df: DataFrame, add: Callable, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all batches of df of what add(batch, into) adds to an array of a shape.

    A task sums up its own batches, then the tasks' sums meet by blocks of places, a task again holding one sum a block.
    """
    schema, names = "block int, sums binary", ["block", "sums"]

    def own(batches):
        into = np.zeros(shape)
        for batch in batches:
            add(batch, into)
        for block in range(0, shape[0], BLOCK):
            part = into[block : block + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=names)

    def total(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(sums.as_buffer(), np.float64)
                held[block] = held[block] + part if block in held else part
        for block, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=names)

    out = np.zeros(shape)
    # at most as many rows as blocks, whose number the shape fixes
    for block, sums in df.mapInArrow(own, schema).repartition("block").mapInArrow(total, schema).collect():
        out[block : block + BLOCK] = np.frombuffer(sums, np.float64).reshape(-1, shape[1])
    return out


def _entries(batch: pa.RecordBatch, ids: str, weights: str) -> Rows:
    lists = batch.column(ids)
    sizes = np.diff(lists.offsets.to_numpy())
    return Rows(lists.flatten().to_numpy().astype(np.int64), batch.column(weights).flatten().to_numpy().astype(np.float64), sizes)


def unlearnt(df: DataFrame, text: str = "text", size: int = SIZE, bits: int = BITS, seed: int = 42) -> Encoder:
    """An encoder with the corpus's idf, ln((1 + N) / (1 + df)) + 1, and a random matrix."""

    def add(batch, into):
        own = counted(batch.column(0).to_pylist(), bits)
        into[:, 0] += np.bincount(own.ids, minlength=1 << bits)

    rows = df.select(F.col(text))
    idf = np.log((1 + rows.count()) / (1 + summed(rows, add, (1 << bits, 1))[:, 0])) + 1
    return Encoder(bits, idf, np.random.default_rng(seed).standard_normal((1 << bits, size)) / math.sqrt(size))


def weighed(df: DataFrame, encoder: Encoder, **texts: str) -> DataFrame:
    """For each name = column the sparse rows of that column's texts: name_ids, name_weights; other columns stay."""
    kept = [c for c in df.columns if c not in texts.values()]
    schema = df.select(*kept).schema
    for name in texts:
        schema = schema.add(f"{name}_ids", T.ArrayType(T.IntegerType())).add(f"{name}_weights", T.ArrayType(T.DoubleType()))

    def run(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(len(kept))]
            for i in range(len(texts)):
                own = encoder.rows(batch.column(len(kept) + i).to_pylist())
                ends = pa.array(np.concatenate([[0], np.cumsum(own.sizes)]).astype(np.int32))
                columns += [pa.ListArray.from_arrays(ends, pa.array(own.ids.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(own.weights))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(*kept, *[F.col(c).alias(f"text of {n}") for n, c in texts.items()]).mapInArrow(run, schema)


# ---------------------------------------------------------------- latent vectors


def latent(df: DataFrame, text: str = "text", size: int = SIZE, bits: int = BITS, more: int = 8, rounds: int = 12, near: float = 1e-4, seed: int = 42) -> tuple[Encoder, np.ndarray]:
    """(encoder, singular values) of the truncated singular value decomposition of the corpus's sparse rows.

    Block power iteration: a round multiplies the rows' Gram matrix with an orthonormal block of size + more columns,
    one pass over the rows; the Ritz values of the block tell when it has settled.
    """
    start = unlearnt(df, text, size + more, bits, seed)
    rows = tables.written(weighed(df.select(text), start, x=text), "rows")
    context = df.sparkSession.sparkContext
    block, known = np.linalg.qr(start.matrix)[0], None
    for _ in range(rounds):
        sent = context.broadcast(block)

        def add(batch, into, sent=sent):
            own = _entries(batch, "x_ids", "x_weights")
            own.transposed_times(own.times(sent.value), into)

        image = summed(rows, add, block.shape)
        sent.destroy()
        values, turn = np.linalg.eigh(block.T @ image)
        order = np.argsort(-values)
        values, ritz = np.maximum(values[order], 0)[:size], block @ turn[:, order]
        settled = known is not None and np.all(np.abs(values - known) <= near * np.maximum(known, 1e-12))
        known = values
        if settled:
            break
        block = np.linalg.qr(image)[0]
    tables.forgotten(rows)
    return replace(start, matrix=ritz[:, :size]), np.sqrt(known)


# ---------------------------------------------------------------- training by contrast


def contrast(matrix: np.ndarray, queries: Rows, candidates: Rows, scale: float, into: np.ndarray) -> float:
    """Summed loss of a batch, whose gradient by the matrix is added to `into`.

    Candidate i is query i's positive; all others of the batch, the further ones included, are negatives.  The loss of
    a query is its negative log share in the softmax over scale * cosine.
    """

    def unit(z):
        length = np.sqrt((z * z).sum(axis=1, keepdims=True))
        length[length == 0] = 1
        return z / length, length

    (u, a), (v, b) = unit(queries.times(matrix)), unit(candidates.times(matrix))
    s = scale * u @ v.T
    s -= s.max(axis=1, keepdims=True)
    p = np.exp(s)
    p /= p.sum(axis=1, keepdims=True)
    own = np.arange(len(u))
    loss = -np.log(np.maximum(p[own, own], 1e-300)).sum()
    p[own, own] -= 1
    du, dv = scale * p @ v, scale * p.T @ u
    queries.transposed_times((du - (du * u).sum(axis=1, keepdims=True) * u) / a, into)
    candidates.transposed_times((dv - (dv * v).sum(axis=1, keepdims=True) * v) / b, into)
    return float(loss)


@dataclass
class Plan:
    """How training goes: passes, updates in each, pairs of a batch, rates, and when it stops."""

    epochs: int = 4
    steps: int = 4
    batch: int = 32
    rate: float = 0.02
    warmup: float = 0.1
    clip: float = 1.0
    decay: float = 0.0
    scale: float = 20.0
    patience: int = 0

    def rate_at(self, step: int) -> float:
        """Linear up over the warm-up, then linear down to nothing."""
        total = self.epochs * self.steps
        warm = int(total * max(0.0, min(self.warmup, 0.5)))
        return self.rate * ((step + 1) / (warm + 1) if step < warm else (total - step) / max(1, total - warm))


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """query, positive, negatives, once each; negatives, an array of texts, may be missing."""
    if "negatives" not in pairs.columns:
        pairs = pairs.withColumn("negatives", F.array().cast("array<string>"))
    return pairs.select("query", "positive", "negatives").where("query IS NOT NULL AND positive IS NOT NULL").dropDuplicates(["query", "positive"])


def batches_of(pairs: DataFrame, encoder: Encoder, plan: Plan) -> DataFrame:
    """batch, and the sparse rows of its queries, positives and negatives (pairs: query, positive, negatives).

    Pairs are dealt to batches by a hash; pairs that repeat count once.  negatives, an array of texts, may be missing.
    """
    return _dealt(distinct_pairs(pairs), encoder, plan)


def _dealt(pairs: DataFrame, encoder: Encoder, plan: Plan) -> DataFrame:
    many = max(1, -(-pairs.count() // plan.batch))
    dealt = pairs.groupBy(F.pmod(F.xxhash64("query", "positive"), F.lit(many)).cast("int").alias("batch"))
    grouped = dealt.agg(F.array_sort(F.collect_list(F.struct("query", "positive", F.coalesce("negatives", F.array().cast("array<string>")).alias("negatives")))).alias("own"))
    schema = "batch int, q_ids array<int>, q_weights array<double>, q_sizes array<bigint>, c_ids array<int>, c_weights array<double>, c_sizes array<bigint>"

    def run(batches):
        for batch in batches:
            for number, own in zip(batch.column("batch").to_pylist(), batch.column("own").to_pylist(), strict=True):
                q = encoder.rows([x["query"] for x in own])
                c = encoder.rows([x["positive"] for x in own] + [n for x in own for n in x["negatives"]])
                columns = [pa.array([number], pa.int32())]
                for rows in (q, c):
                    columns += [pa.array([rows.ids.astype(np.int32)], pa.list_(pa.int32())), pa.array([rows.weights], pa.list_(pa.float64())), pa.array([rows.sizes], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["batch", "q_ids", "q_weights", "q_sizes", "c_ids", "c_weights", "c_sizes"])

    return grouped.mapInArrow(run, schema)


def gradient(batches: DataFrame, matrix: np.ndarray, scale: float) -> tuple[np.ndarray, float, int]:
    """(summed gradient, summed loss, queries) of the batches of a frame."""
    sent = batches.sparkSession.sparkContext.broadcast(matrix)
    places, size = matrix.shape

    def add(batch, into):
        for i in range(batch.num_rows):
            q, c = (Rows(*(batch.column(f"{x}_{part}")[i].values.to_numpy() for part in ("ids", "weights", "sizes"))) for x in "qc")
            # the row behind the last place has the loss and the number of queries
            into[places, 0] += contrast(sent.value, q, c, scale, into[:places])
            into[places, 1] += len(q.sizes)

    total = summed(batches, add, (places + 1, max(2, size)))
    sent.destroy()
    return total[:places, :size], float(total[places, 0]), int(total[places, 1])


def train(pairs: DataFrame, start: Encoder, plan: Plan, recall: Callable[[Encoder], float]) -> tuple[Encoder, list[dict]]:
    """(the encoder with the best recall, a row for each epoch: epoch, loss, recall, best); epoch 0 is the start.

    An update takes the batches of one of plan.steps parts of all batches: their gradients are summed where the batches
    lie, the mean is cut to a norm of plan.clip, and the matrix moves by decoupled-decay moments (0.9 and 0.999).
    Training ends early after plan.patience epochs without a better recall (0: never).
    """
    pairs = tables.written(distinct_pairs(pairs), "pairs")  # counted, then dealt out
    batches = tables.written(_dealt(pairs, start, plan), "batches")
    tables.forgotten(pairs)
    matrix = start.matrix.copy()
    first, second = np.zeros_like(matrix), np.zeros_like(matrix)
    best, top, idle, step = start, recall(start), 0, 0
    history = [{"epoch": 0, "loss": None, "recall": top, "best": True}]
    for epoch in range(1, plan.epochs + 1):
        losses = queries = 0.0
        for part in range(plan.steps):
            total, loss, n = gradient(batches.where(F.pmod("batch", F.lit(plan.steps)) == part), matrix, plan.scale)
            rate, losses, queries = plan.rate_at(step), losses + loss, queries + n
            step += 1
            if not n:
                continue
            mean = total / n
            mean *= min(1.0, plan.clip / max(1e-12, float(np.sqrt((mean * mean).sum()))))
            first, second = 0.9 * first + 0.1 * mean, 0.999 * second + 0.001 * mean * mean
            move = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            matrix = matrix - rate * (move + plan.decay * matrix)
        now = replace(start, matrix=matrix)
        reached = recall(now)
        better = reached > top
        history.append({"epoch": epoch, "loss": losses / queries if queries else None, "recall": reached, "best": better})
        if better:
            best, top, idle = now, reached, 0
        else:
            idle += 1
            if plan.patience and idle >= plan.patience:
                break
    tables.forgotten(batches)
    return best, history


def multiplied(rows: DataFrame, encoder: Encoder, name: str, to: str) -> DataFrame:
    """The sparse rows of weighed(), with the vectors of unit length that the encoder's matrix makes of them."""
    kept = [c for c in rows.columns if c not in (f"{name}_ids", f"{name}_weights")]
    schema = rows.select(*kept).schema.add(to, T.ArrayType(T.FloatType()))
    sent = rows.sparkSession.sparkContext.broadcast(encoder.matrix)  # of a size that the parameters fix

    def run(batches):
        for batch in batches:
            x = _entries(batch, f"{name}_ids", f"{name}_weights").times(sent.value).astype(np.float32)
            ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=schema.names)

    return rows.mapInArrow(run, schema).withColumn(to, vectors.normalised(F.col(to)))


def recall_of(encoder: Encoder, queries: DataFrame, docs: DataFrame, relevant: DataFrame, k: int = 10) -> float:
    """Mean share of a query's relevant documents among its k nearest by cosine.

    queries (query_id, text), docs (doc_id, text), relevant (query_id, doc_id); queries without a relevant one count
    for nothing.  In place of its text a document may have its sparse row, as weighed(docs, encoder, x="text") gives it:
    training changes the matrix alone, so texts need no second look.
    """
    wanted = relevant.join(queries.select("query_id"), "query_id", "left_semi").distinct()
    asked = queries.join(wanted.select("query_id").distinct(), "query_id", "left_semi")
    rows = docs if "x_ids" in docs.columns else weighed(docs.select("doc_id", "text"), encoder, x="text")
    q = multiplied(weighed(asked.select("query_id", "text"), encoder, x="text"), encoder, "x", "q")
    found = vectors.top_k(q, multiplied(rows, encoder, "x", "embedding"), k, key="doc_id")
    hits = wanted.join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    share = hits.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("share"))
    return share.agg(F.avg("share")).first()[0] or 0.0
