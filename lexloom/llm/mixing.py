"""Mixing sources to target weights through blocks of words.

Each source's documents stand in a fixed order; their words are packed into blocks of a fixed number of words, so a
document covers a range of blocks.  A source's target fixes its number of slots.  The slots of all sources are dealt
to output shards of a fixed number of slots: every shard draws multinomial counts of its slots among the sources,
given that the sources' totals come out (which makes the draws multivariate hypergeometric).  The draws form a tree
over the shards: a node draws what its left half takes of each source, so that a shard finds its own counts, and which
ordinals of each source are its own, along one path from the root, without any other shard's.  Inside a shard a
permutation puts the sources' slots in order.  The j-th slot of a source takes the block that a pseudorandom
permutation of the source's block indexes gives for j, a new permutation each time round.  Slots and blocks then join
by index.  The last slot of a source takes only the words that its target still lacks.

Sources in code-point order, null last, take the weights in turn.  Targets share `times` the words of all documents
by weight; a target above `most` times its source's words stops there, and the excess is shared again by weight.  No
block is taken more often than `most` times, so neither is any document.

Null texts have no words; documents without words are never taken, and a source without words has target 0.  Repeated
rows are documents of their own.  All draws depend on seed, source and shard only, so reruns agree.  An empty table
gives an empty mix.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import WORD, lean, mix64, small_batches, text_of

WEIGHTS, TIMES, MOST = (5, 2, 1), 1.5, 2
BLOCK_WORDS, SHARD_SLOTS = 512, 4096
#: Up to so many sources, their table is broadcast; beyond, it joins by shuffle.
BROADCAST_SOURCES = 10_000
#: Largest population that is drawn from exactly; the draws from larger ones take the normal limit.
EXACT_DRAWS = 10**9


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


# ---------------------------------------------------------------- permutations of 0 .. n - 1


def _rounds(x: np.ndarray, n: int, seed: int, order) -> np.ndarray:
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(v):
        left, right = v >> np.uint64(half), v & mask
        for r in order:
            if order[0] == 0:
                left, right = right, left ^ (mix64(right, seed * 8 + r) & mask)
            else:
                left, right = right ^ (mix64(left, seed * 8 + r) & mask), left
        return (left << np.uint64(half)) | right

    out = once(x.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def permuted(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Images of x under a seeded permutation of 0 .. n - 1: four Feistel rounds, walked until inside the range."""
    return _rounds(x, n, seed, (0, 1, 2, 3))


def unpermuted(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    return _rounds(x, n, seed, (3, 2, 1, 0))


def _seed(seed: int, source: int, epoch: int) -> int:
    return (seed * 1_000_003 + source) * 64 + epoch


# ---------------------------------------------------------------- targets


def targets(sizes: list[int], weights=WEIGHTS, times: float = TIMES, most: int = MOST) -> list[float]:
    """Shares of times * sum(sizes) by weight, none above most times its size."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    goal, out, free = Fraction(times) * sum(sizes), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while free:
        left = goal - sum(out[i] for i in range(len(sizes)) if i not in free)
        total = sum(weight[i] for i in free)
        above = {i for i in free if left * weight[i] > most * sizes[i] * total}
        if not above:
            for i in free:
                out[i] = left * weight[i] / total
            break
        for i in above:
            out[i] = Fraction(most * sizes[i])
        free -= above
    return [float(x) for x in out]


def _plan(totals: list, seed: int, block_words: int, weights, times, most) -> list[tuple]:
    """A row a source: its number of blocks, its slots, and the words its last slot takes."""
    rows = []
    for s, ((source, size), target) in enumerate(zip(totals, targets([t for _, t in totals], weights, times, most), strict=True)):
        blocks, goal = -(-size // block_words), min(round(target), most * size)
        slots = last = 0
        if goal:
            epoch, rest = divmod(goal, size)
            short = size - (blocks - 1) * block_words
            slots, last = epoch * blocks, block_words
            if rest:
                where = int(unpermuted(np.array([blocks - 1]), blocks, _seed(seed, s, epoch))[0])
                upto = lambda r: r * block_words - (block_words - short) * (where < r)  # noqa: E731, B023
                r = next(r for r in range(max(1, rest // block_words), blocks + 1) if upto(r) >= rest)
                slots, last = slots + r, rest - upto(r - 1)
        rows.append((s, source, size, target, blocks, slots, last))
    return rows


PLAN = "s int, source string, source_size bigint, target double, blocks bigint, slots bigint, last bigint"


def mix_plan(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, weights=WEIGHTS, times: float = TIMES, most: int = MOST) -> list[tuple]:
    """A row of PLAN for each source.  docs has source and size; the driver gets as many rows as there are sources."""
    totals = docs.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.col("source").asc_nulls_last()).collect()
    return _plan([(r["source"], r["size"]) for r in totals], seed, block_words, weights, times, most)


# ---------------------------------------------------------------- places of documents


def placed(docs: DataFrame, plan: list[tuple], key: str = "doc_id") -> DataFrame:
    """docs with s, source_size, target, start (the words of the source's documents before it), bucket and place.

    The order within a source is by a hash bucket, then by key.  There are about as many buckets as documents in
    each, so neither the sums inside a bucket nor those over buckets meet more than the square root of all rows.
    s, bucket and place tell every row from every other, rows that repeat included.
    """
    n = docs.count()
    buckets = max(1, math.isqrt(n))
    about = docs.sparkSession.createDataFrame(plan, PLAN).select("s", F.col("source").alias("__source"), "source_size", "target")
    if len(plan) <= BROADCAST_SOURCES:
        about = F.broadcast(about)
    rows = docs.join(about, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy("s", "bucket").orderBy(F.col(key), F.col("__tie"), F.col("size"))
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"place": F.row_number().over(inside), "inside": F.coalesce(F.sum("size").over(before), F.lit(0))})
    over = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("s", "bucket").agg(F.sum("size").alias("of_bucket"))
    base = base.select("s", "bucket", F.coalesce(F.sum("of_bucket").over(over), F.lit(0)).alias("base"))
    return rows.join(base, ["s", "bucket"]).withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside")


def in_blocks(rows: DataFrame, block_words: int) -> DataFrame:
    """A row for each block that a placed document has words in: block, at (first word in it), words.  Without words: -1."""
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    rows = rows.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return rows.withColumns({"at": begin - F.col("block") * block_words, "words": F.when(F.col("block") >= 0, end - begin).otherwise(0)})


# ---------------------------------------------------------------- slots


def _half(rng: np.random.Generator, left: np.ndarray, many: int) -> np.ndarray:
    """How many of `many` draws without replacement fall on each source, of which left[s] are there."""
    out, rest = np.zeros(len(left), np.int64), int(left.sum())
    for s, n in enumerate(left.tolist()):
        rest -= n
        if n == 0 or many == 0:
            continue
        low, high = max(0, many - rest), min(n, many)
        if n + rest < EXACT_DRAWS:
            x = int(rng.hypergeometric(n, rest, many)) if low < high else low
        else:
            total = n + rest
            spread = many * (n / total) * (rest / total) * ((total - many) / max(1, total - 1))
            x = min(high, max(low, round(rng.normal(many * (n / total), math.sqrt(max(0.0, spread))))))
        out[s], many = x, many - x
    return out


def shard_draws(wanted: np.ndarray, shards: int, shard_slots: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first ordinal, number of slots) of each source in one shard, along the path to it through the tree of draws."""
    first, left = np.zeros(len(wanted), np.int64), np.asarray(wanted, np.int64).copy()
    low, high, node = 0, shards, 1
    while high - low > 1:
        middle = (low + high) // 2
        drawn = _half(np.random.default_rng([seed, node]), left, (middle - low) * shard_slots)
        if shard < middle:
            left, high, node = drawn, middle, 2 * node
        else:
            first, left, low, node = first + drawn, left - drawn, middle, 2 * node + 1
    return first, left


def slots(spark, plan: list[tuple], seed: int = 0, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, draws: int | None = None) -> DataFrame:
    """shard, slot, s, epoch, block, upto (words of the block that the slot takes at most), a row a slot.

    draws is the seed of the shards' draws, that of the permutations unless given.  Each shard is made by itself.
    """
    wanted = np.array([r[5] for r in plan], np.int64)
    blocks, last = [r[4] for r in plan], [r[6] for r in plan]
    total = int(wanted.sum())
    shards = -(-total // shard_slots)
    own = seed if draws is None else draws

    def fill(batches):
        for pdf in batches:
            for shard in pdf["id"].tolist():
                first, many = shard_draws(wanted, shards, shard_slots, shard, own)
                begin, n = np.cumsum(many) - many, int(many.sum())
                slot = permuted(np.arange(n), n, _seed(own, shard, 63)) if n else np.zeros(0, np.int64)
                for s in np.flatnonzero(many):
                    j = np.arange(first[s], first[s] + many[s])
                    epoch, block = j // blocks[s], np.empty(len(j), np.int64)
                    for e in np.unique(epoch):
                        here = epoch == e
                        block[here] = permuted(j[here] % blocks[s], blocks[s], _seed(seed, int(s), int(e)))
                    upto = np.where(j == wanted[s] - 1, last[s], block_words)
                    yield pd.DataFrame({"shard": shard, "slot": slot[begin[s] : begin[s] + many[s]].astype(np.int32), "s": np.int32(s), "epoch": epoch.astype(np.int32), "block": block, "upto": upto.astype(np.int64)})

    parts = max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))
    made = spark.range(0, shards, 1, parts).mapInPandas(lean(fill), "shard bigint, slot int, s int, epoch int, block bigint, upto bigint")
    # a shard is one row of the range but thousands of slots: by the range's size they would be broadcast
    return made.hint("merge")


# ---------------------------------------------------------------- the mix


def _sized(docs: DataFrame, key: str, *also: str) -> DataFrame:
    return docs.select(F.col(key).alias("__key"), *also, F.col("source").cast("string").alias("source"), n_words(text_of()).alias("size"), F.xxhash64("text").alias("__tie"))


def mix_counts(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, key: str = "doc_id", shard_slots: int = SHARD_SLOTS, draws: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted), first_shard and last_shard.

    A row a document; the shards are the first and the last that take words of it (null where none does).
    """
    sized = _sized(docs, key)
    plan = mix_plan(sized, seed, block_words)
    pieces = in_blocks(placed(sized, plan, "__key"), block_words)
    joined = pieces.join(slots(docs.sparkSession, plan, seed, block_words, shard_slots, draws), ["s", "block"], "left")
    # least() passes over nulls, which stand for no slot here
    part = F.when(F.col("upto").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.col("words"), F.col("upto") - F.col("at"))))
    joined = joined.withColumn("part", part).withColumn("shard", F.when(F.col("part") > 0, F.col("shard")))
    once = [F.first(c).alias(c) for c in ("__key", "size", "source_size", "target")]
    out = joined.groupBy("s", "bucket", "place").agg(*once, F.sum("part").cast("long").alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    return out.select(F.col("__key").alias(key), "size", "source_size", "target", "taken", "first_shard", "last_shard")


_FIND = re.compile(r"[^\x20\x09-\x0D]+").finditer


def _cut_words(text: str, ranges: list) -> list[str]:
    """For each range of words (sorted, apart) the text from the first to the last of them."""
    spans, at = [], 0
    for i, m in enumerate(_FIND(text)):
        if at < len(ranges) and i == ranges[at][0]:
            begin = m.start()
        if at < len(ranges) and i == ranges[at][1] - 1:
            spans.append(text[begin : m.end()])
            at += 1
    return spans


def _merged(ranges: list) -> list:
    """Sorted ranges, those that touch made one."""
    joined = []
    for a, b in sorted(ranges):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    return joined


def mix_blocks(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, key: str = "doc_id", shard_slots: int = SHARD_SLOTS, draws: int | None = None) -> DataFrame:
    """The mix itself: shard, slot, source, epoch, block, n_words and text, a row a slot.

    A slot's text joins by newlines the words that its block has of each document, as they stand in the document.
    """
    sized = _sized(docs, key, "text")
    plan = mix_plan(sized, seed, block_words)
    cut_at = in_blocks(placed(sized, plan, "__key"), block_words).where("words > 0")
    # each document is cut once into what its blocks hold
    ranges = cut_at.groupBy("s", "bucket", "place").agg(F.first("text").alias("text"), F.first("start").alias("start"), F.sort_array(F.collect_list(F.struct("block", "at", "words"))).alias("parts"))
    schema = "s int, block bigint, at bigint, words bigint, piece string"

    def cut(batches):
        for batch in batches:
            starts = batch.column(1).to_pylist()
            out = {"block": [], "at": [], "words": [], "piece": []}
            many = []
            for text, start, parts in zip(batch.column(2).to_pylist(), starts, batch.column(3).to_pylist(), strict=True):
                low = [p["block"] * block_words + p["at"] - start for p in parts]
                out["piece"] += _cut_words(text, [(a, a + p["words"]) for a, p in zip(low, parts, strict=True)])
                for c in ("block", "at", "words"):
                    out[c] += [p[c] for p in parts]
                many.append(len(parts))
            s = np.repeat(batch.column(0).to_numpy(), many).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(s), *(pa.array(out[c], pa.int64()) for c in ("block", "at", "words")), pa.array(out["piece"], pa.string())], names=["s", "block", "at", "words", "piece"])

    pieces = small_batches(ranges.select("s", "start", "text", "parts")).mapInArrow(lean(cut), schema)
    # a block holds at most block_words pieces
    blocks = pieces.groupBy("s", "block").agg(F.sort_array(F.collect_list(F.struct("at", "words", "piece"))).alias("pieces"))
    names = docs.sparkSession.createDataFrame(plan, PLAN).select("s", "source")
    filled = slots(docs.sparkSession, plan, seed, block_words, shard_slots, draws).join(blocks, ["s", "block"]).join(F.broadcast(names) if len(plan) <= BROADCAST_SOURCES else names, "s")
    # of a slot that its target cuts short, the first words
    left = lambda p: F.col("upto") - p["at"]
    taken = F.filter("pieces", lambda p: left(p) > 0)
    head = lambda p: F.when(left(p) >= p["words"], p["piece"]).otherwise(F.regexp_substr(p["piece"], F.concat(F.lit(r"^(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){"), left(p).cast("string"), F.lit("}"))))
    words = F.aggregate(taken, F.lit(0).cast("long"), lambda a, p: a + F.least(p["words"], left(p)))
    return filled.select("shard", "slot", "source", "epoch", "block", words.alias("n_words"), F.array_join(F.transform(taken, head), "\n").alias("text"))


def mix_documents(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, key: str = "doc_id") -> DataFrame:
    """The mix as documents with the columns of docs: for each time round, a document with the words its slots take.

    A document taken whole keeps its text as it is; of others, each run of taken words stays as it stands in the
    text, runs joined by a newline.  n_chars, where docs has it, is counted anew.
    """
    kept = docs.columns
    # under names of their own, so that columns of docs can't clash
    rows = _sized(docs, key)
    plan = mix_plan(rows, seed, block_words)
    whole_rows = docs.select(F.col(key).alias("__key"), F.struct(*kept).alias("__row"), F.col("source").cast("string").alias("source"), n_words(text_of()).alias("size"), F.xxhash64("text").alias("__tie"))
    rows_placed = placed(whole_rows, plan, "__key").select("__row", "s", "start", "size")
    pieces = in_blocks(placed(rows, plan, "__key").select("s", "start", "size"), block_words).join(slots(docs.sparkSession, plan, seed, block_words), ["s", "block"])
    words = F.least(F.col("words"), F.col("upto") - F.col("at"))
    low = F.greatest(F.col("start"), F.col("block") * block_words) - F.col("start")
    ranges = pieces.where(words > 0).groupBy("s", "start", "epoch").agg(F.collect_list(F.struct(low.alias("a"), (low + words).alias("b"))).alias("ranges"), F.sum(words).alias("n"))
    joined = rows_placed.where("size > 0").join(ranges, ["s", "start"])
    whole = F.col("n") >= F.col("size")
    joined = joined.select("__row", F.when(~whole, F.col("ranges")).alias("ranges"))

    def cut(batches):
        for batch in batches:
            struct, texts = batch.column(0), batch.column(0).field("text").to_pylist()
            for i, ranges in enumerate(batch.column(1).to_pylist()):
                if ranges is not None:
                    texts[i] = "\n".join(_cut_words(texts[i], _merged([(r["a"], r["b"]) for r in ranges])))
            columns = [struct.field(c) for c in kept]
            columns[kept.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in kept:
                columns[kept.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], struct.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names=kept)

    return small_batches(joined).mapInArrow(lean(cut), docs.schema)
