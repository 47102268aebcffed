"""What the training-data operators share: shared scratch space, lineage cuts, ids and hashes."""

from __future__ import annotations

import ctypes
import os
import weakref
from collections.abc import Callable
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import scratch

#: Separators of words: space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Where the tables of stored() and cut() are.
_TABLES: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table in the shared folder, so that a lost executor loses nothing.

    A table rather than checkpoint(): a checkpointed frame keeps what the optimizer inferred about its columns, which
    piles up from round to round of a loop.
    """
    return stored(df, "cut")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it from there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[out] = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the tables behind frames that stored() or cut() gave and that nothing reads any more."""
    for df in frames:
        path = _TABLES.pop(df, None)
        if path is not None:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


# ---------------------------------------------------------------- memory of Python workers

#: What this Python worker remembers, and the stage that it remembers it for.
_HELD: dict = {"stage": None, "own": {}}


def give_back() -> None:
    """Hand memory that was freed back to the system; else a worker keeps what its largest batch took."""
    pa.default_memory_pool().release_unused()
    if os.name == "posix":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def held(name: str, build: Callable):
    """build(), remembered under a name for the tasks of the running stage alone: a task of another stage drops it."""
    drop_older()
    if name not in _HELD["own"]:
        _HELD["own"][name] = build()
    return _HELD["own"][name]


def drop_older() -> None:
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage != _HELD["stage"]:
        _HELD["own"].clear()
        _HELD["stage"] = stage
        give_back()


def lean(run: Callable) -> Callable:
    """run, a function over a task's batches, that leaves no memory behind but what is held for its stage."""

    def own(batches):
        drop_older()
        yield from run(batches)
        give_back()

    return own


def small_batches(df: DataFrame) -> DataFrame:
    """df; Arrow batches to Python hold a few MB from now on, so that texts of any length leave room for models.

    A size that the cluster sets itself is kept.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not df.sparkSession.sparkContext.getConf().contains(key):
        df.sparkSession.conf.set(key, "4m")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def free(columns: list[str], name: str) -> str:
    """name, or the next longer one that none of the columns has; names differ by more than case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalising mixer of the public splitmix64 generator, on uint64 arrays."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def in_portions(texts: list[str], most: int):
    """Slices (from, to) of texts with about `most` characters each; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


class Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class ChunkCoder:
    """Encodes texts chunk by chunk and remembers the ids of the chunks first seen.

    split gives a text's chunks; encode(chunks) gives the ids of new chunks as (flat ids, counts).  At most `limit`
    chunks of LETTERS characters each on average are remembered, the early and so mostly the frequent ones; others live
    as long as their portion.  After `renew` portions the memory starts anew, so that it follows a change of the input.
    """

    LETTERS = 32

    def __init__(self, split, encode, limit: int = 400_000, portion: int = 4_000_000, renew: int = 400):
        self.split, self.encode_new, self.limit, self.portion, self.renew = split, encode, limit, portion, renew
        self.clear()

    def clear(self):
        self.index, self.portions, self.letters = Numbered(), 0, 0
        # of each chunk where its ids begin and how many they are; the ids of all chunks; how much of them is in use
        self.start, self.count, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def _add(self, at: int, flat: np.ndarray, count: np.ndarray) -> None:
        """Put new chunks' ids behind those in use; the arrays at least double when they grow."""
        for name, need in (("start", at + len(count)), ("count", at + len(count)), ("flat", self.used + len(flat))):
            own = getattr(self, name)
            if need > len(own):
                setattr(self, name, np.concatenate([own, np.zeros(max(need - len(own), len(own)), own.dtype)]))
        self.start[at : at + len(count)] = self.used + np.cumsum(count) - count
        self.count[at : at + len(count)] = count
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encode(self, texts: list[str]):
        """(ids, number of ids) for each portion of consecutive texts."""
        for a, b in in_portions(texts, self.portion):
            if self.portions >= self.renew:
                self.clear()
            self.portions += 1
            known = len(self.index)
            chunks = list(map(self.split, texts[a:b]))
            sizes = np.fromiter(map(len, chunks), np.int64, b - a)
            codes = np.fromiter(map(self.index.__getitem__, chain.from_iterable(chunks)), np.int64, int(sizes.sum()))
            new = list(islice(self.index, known, None))
            if new:
                self._add(known, *self.encode_new(new))
            count = self.count[codes]
            ends = np.cumsum(count)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.flat[np.repeat(self.start[codes] - ends + count, count) + np.arange(total)]
            upto = np.concatenate([[0], ends])[np.cumsum(sizes)]
            letters = sum(map(len, new))
            if len(self.index) > self.limit or self.letters + letters > self.LETTERS * self.limit:
                keep = known if self.letters + letters > self.LETTERS * self.limit else max(known, self.limit)
                for chunk in new[keep - known :]:
                    del self.index[chunk]
                self.used = int(self.start[keep - 1] + self.count[keep - 1]) if keep else 0
                letters = sum(map(len, new[: keep - known]))
            self.letters += letters
            yield ids, np.diff(np.concatenate([[0], upto]))
