"""Token-ID output: shards of raw ids, and a minimal perfect hash index from keys to shard offsets.

A store is a folder of two Parquet tables, written by Spark's own committing writers, so a lost or repeated task
leaves no half-written file and any store that Spark can write will do.

payload   a folder a shard, one row a block, in key order: block, id_base and doc_base (ids and documents before the
          block in its shard), keys and lens (arrays, a document each), width, payload (the ids of the block's
          documents, raw little-endian, `width` bytes each).
index     one row a bucket of keys: `mph` (levels of a minimal perfect hash with rank samples), and by slot `fp`
          (32-bit fingerprint), `shard`, `block`, `offset` (in ids, inside the block), `n`, `copies`: raw arrays.

A key's bucket is its hash modulo the number of buckets; its slot comes from the hash function with a few steps
whatever the bucket's size, the stored fingerprint tells keys that were never written from those that were, and the
slot holds where in which block the ids stand.  Reading takes these bytes out of these blocks; where few shards are
asked for, no other shard's folder is opened.

Ids are those of the tokenizers library without special tokens added; a special token that stands in a text gets its
own id, as the library has it.  Null texts count as empty and hold the end id alone.  Rows that repeat a key stand
in the order in which they are read; they are numbered, and each is an entry of its own.  A null key is a key like others.  An empty table gives an empty store.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import ChunkCoder, held, in_portions, lean, mix64, scratch, small_batches, stored

#: White space of Unicode, as the pre-tokenizer's pattern has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Cuts a text only where the byte-level pre-tokenizer cuts as well.
#: A run of plain letters before something else in ASCII ends where a pre-token ends; the rest is cut at spaces.
CHUNK = re.compile(f" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[\\x00-@\\[-`{{-\\x7f]|$)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BLOCK_IDS = 1_000_000
BUCKET_KEYS = 4096
LINES = 500


def coder_of(tokenizer_file: str) -> ChunkCoder:
    """One coder a stage and Python worker: what it remembers serves all the worker's tasks of the stage."""
    return held(f"byte coder {tokenizer_file}", lambda: byte_level_coder(tokenizer_file))


def byte_level_coder(tokenizer_file: str) -> ChunkCoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    added = list(tokenizer.get_added_tokens_decoder().values())
    contents = [t.content for t in added]
    special = re.compile("(" + "|".join(sorted((re.escape(t.content) for t in added), key=len, reverse=True)) + ")") if added else None
    # a token that takes neighbouring spaces along can't be cut out of its text
    greedy = any(t.lstrip or t.rstrip or t.single_word for t in added)

    def split(text: str) -> list[str]:
        if not any(c in text for c in contents):
            return CHUNK.findall(text)
        if greedy:
            return [text]
        parts = special.split(text)
        return [c for i, part in enumerate(parts) for c in ([part] if i % 2 else CHUNK.findall(part))]

    one = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    line = one(["\n"])[0]

    def encode(chunks: list[str]):
        """Chunks without white space but a leading space go many to a text, a line each: the line feed is a token apart."""
        flat, count, spaced, lines = [], np.zeros(len(chunks), np.int64), [], []
        for i, c in enumerate(chunks):
            (spaced if c.isspace() or any(t in c for t in contents) else lines).append(i)
        parts = [lines[i : i + LINES] for i in range(0, len(lines), LINES)]
        ids = {}
        for part, own in zip(parts, one(["\n".join([chunks[i] for i in part]) for part in parts]), strict=True):
            own = np.array(own, np.uint32)
            ends = np.append(np.flatnonzero(own == line[0]), len(own))
            if len(line) != 1 or len(ends) != len(part):
                raise ValueError("a line feed isn't a token of its own")
            count[part] = np.diff(np.concatenate([[-1], ends])) - 1
            flat.append(own[own != line[0]])
        for i, own in zip(spaced, one([chunks[i] for i in spaced]), strict=True):
            ids[i], count[i] = own, len(own)
        if not spaced:
            return np.concatenate([np.zeros(0, np.uint32), *flat]), count
        out, ends = np.zeros(int(count.sum()), np.uint32), np.cumsum(count)
        of_line = np.ones(len(chunks), bool)
        of_line[spaced] = False
        out[np.repeat(of_line, count)] = np.concatenate([np.zeros(0, np.uint32), *flat])
        for i, own in ids.items():
            out[ends[i] - count[i] : ends[i]] = own
        return out, count

    return ChunkCoder(split, encode, limit=1_000_000)


def width_of(tokenizer_file: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer_file).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


# ---------------------------------------------------------------- minimal perfect hash


def _place(h: np.ndarray, g: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(h ^ mix64(g, level), level) % np.uint64(size)).astype(np.int64)


def build_mph(h: np.ndarray, g: np.ndarray, gamma: float = 2.0) -> bytes:
    """Levels of bit arrays over distinct pairs of 64-bit hashes: a pair alone in its place at a level is settled there.

    Its slot is the number of set bits before its place, over all levels, so slots are 0 to n - 1.  All is in 64-bit
    words: the number of levels, their sizes, then of each level the bits, and for each 512 of them the bits before.
    """
    sizes, parts, before = [], [], 0
    while h.size:
        size, level = max(64, int(gamma * h.size)), len(sizes)
        if level > 1000:
            raise ValueError("two keys agree in 128 bits of hash")
        place = _place(h, g, level, size)
        alone = np.zeros(-(-size // 512) * 512, np.uint8)
        alone[:size] = np.bincount(place, minlength=size) == 1
        bits = np.packbits(alone, bitorder="little").view(np.uint64)
        many = np.bitwise_count(bits).reshape(-1, 8).sum(axis=1, dtype=np.uint64)
        parts += [bits, np.uint64(before) + np.cumsum(many) - many]
        sizes.append(size)
        before += int(many.sum())
        left = alone[place] == 0
        h, g = h[left], g[left]
    return np.concatenate([np.array([len(sizes), *sizes], np.uint64), *parts]).astype(np.uint64).tobytes()


def mph_slots(mph: bytes, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Slot of each pair; -1 where no level has a bit (then the pair was never in the set).

    A pair costs a bit test a level, and at the one that has it a sample and the count of at most 512 bits.
    """
    words = np.frombuffer(mph, np.uint64)
    levels = int(words[0])
    slot, left, at = np.full(h.size, -1, np.int64), np.arange(h.size), 1 + levels
    for level in range(levels):
        size = int(words[1 + level])
        blocks = -(-size // 512)
        bits, samples = words[at : at + 8 * blocks], words[at + 8 * blocks : at + 9 * blocks]
        place = _place(h[left], g[left], level, size)
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        hit = (bits[word] >> bit) & np.uint64(1) == 1
        word, bit, block = word[hit], bit[hit], place[hit] >> 9
        own = bits.reshape(-1, 8)[block]
        before = np.where(np.arange(8) < (word & 7)[:, None], np.bitwise_count(own), 0).sum(axis=1, dtype=np.int64)
        inside = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
        slot[left[hit]] = samples[block].astype(np.int64) + before + inside
        left, at = left[~hit], at + 9 * blocks
    return slot


# ---------------------------------------------------------------- writing


def write_store(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, key: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode every text, append end_id, and write payload and index under path."""
    spark, width = docs.sparkSession, width_of(tokenizer_file)
    key_type = docs.schema[key].dataType
    # ties go by the order of reading, so that finding the ranges reads keys alone; a hot key spreads over shards
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = F.col("key").asc_nulls_first(), F.col("tie")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    schema = _payload_schema(key_type)
    kind = np.uint16 if width == 2 else np.uint32

    def encode(batches):
        coder, shard = coder_of(tokenizer_file), TaskContext.get().partitionId()
        block = doc_base = id_base = held_ids = 0
        keys, lens, raw = [], [], []

        def flush():
            k = pa.concat_arrays(keys)
            n = np.concatenate(lens)
            one = lambda v, t: pa.array([v], t)
            out = pa.RecordBatch.from_arrays(
                [
                    one(shard, pa.int32()), one(block, pa.int32()), one(doc_base, pa.int64()), one(id_base, pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(k)], pa.int32()), k),
                    pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.array(n, pa.int64())), one(width, pa.int32()), one(b"".join(raw), pa.binary()),
                ],
                names=schema.names,
            )
            return out, len(k), int(n.sum())

        for batch in batches:
            texts, own, at = batch.column("text").to_pylist(), batch.column("key"), 0
            for ids, sizes in coder.encode(texts):
                ends = np.cumsum(sizes)
                whole = np.insert(ids, ends, end_id).astype(kind)
                keys.append(own.slice(at, len(sizes)))
                lens.append(sizes + 1)
                raw.append(whole.tobytes())
                at, held_ids = at + len(sizes), held_ids + len(whole)
                if held_ids >= block_ids:
                    out, docs_in, ids_in = flush()
                    yield out
                    block, doc_base, id_base, held_ids = block + 1, doc_base + docs_in, id_base + ids_in, 0
                    keys, lens, raw = [], [], []
        if keys:
            yield flush()[0]

    small_batches(rows).mapInArrow(lean(encode), schema).write.option("compression", "zstd").partitionBy("shard").parquet(f"{path}/payload")
    _write_index(spark, path, key_type)


def _payload_schema(key_type: T.DataType = T.LongType()) -> T.StructType:
    """Columns of the payload table; who reads no keys need not know their type."""
    one = T.StructType().add("shard", "integer").add("block", "integer").add("doc_base", "long").add("id_base", "long")
    return one.add("keys", T.ArrayType(key_type)).add("lens", T.ArrayType(T.LongType())).add("width", "integer").add("payload", "binary")


def _payload(spark: SparkSession, path: str, key_type: T.DataType = T.LongType()) -> DataFrame:
    return spark.read.schema(_payload_schema(key_type)).parquet(f"{path}/payload")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, first_doc, first_id: what lies before each shard.  A row a shard, so the window is small."""
    blocks = _payload(spark, path).select("shard", F.size("lens").alias("docs"), F.expr("aggregate(lens, 0L, (a, x) -> a + x)").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("shard").agg(F.sum("docs").alias("docs"), F.sum("ids").alias("ids"))
    return totals.select("shard", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("first_doc"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first_id"))


def _hashed(df: DataFrame, buckets: int) -> DataFrame:
    """df (key, copy) with two hashes of 64 bits, a fingerprint of 32, and the bucket."""
    h = F.xxhash64("key", "copy")
    return df.withColumns({"h": h, "g": F.xxhash64(F.lit(7), "key", "copy"), "fp": F.hash("key", "copy"), "bucket": F.pmod(h, F.lit(buckets)).cast("int")})


def _write_index(spark: SparkSession, path: str, key_type: T.DataType) -> None:
    blocks = _payload(spark, path, key_type).select("shard", "block", "doc_base", "keys", "lens")
    docs = blocks.agg(F.sum(F.size("keys"))).first()[0]
    buckets = max(1, -(-(docs or 0) // BUCKET_KEYS))
    schema = T.StructType([T.StructField("key", key_type)]).add("shard", "integer").add("block", "integer").add("place", "long").add("offset", "long").add("n", "long")

    def entries(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard, block, place = (batch.column(c)[i].as_py() for c in ("shard", "block", "place"))
                keys, lens = batch.column("keys")[i].values, batch.column("lens")[i].values.to_numpy()
                arrays = [keys, *(pa.array(np.full(len(lens), x, np.int32)) for x in (shard, block)), pa.array(place + np.arange(len(lens))), pa.array(np.cumsum(lens) - lens), pa.array(lens)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    placed = blocks.join(_shards(spark, path).select("shard", "first_doc"), "shard").select("shard", "block", (F.col("first_doc") + F.col("doc_base")).alias("place"), "keys", "lens")
    rows = placed.mapInArrow(lean(entries), schema)
    # keys stand in order, so a repeated key's entries count from its first place; no window meets all of them
    runs = rows.groupBy(F.col("key").alias("__key")).agg(F.min("place").alias("first"), F.count("*").alias("many")).where("many > 1")
    rows = rows.join(runs, F.col("key").eqNullSafe(F.col("__key")), "left")
    rows = rows.select("key", F.coalesce(F.col("place") - F.col("first"), F.lit(0)).alias("copy"), F.coalesce("many", F.lit(1)).alias("copies"), "shard", "block", "offset", "n")
    kinds = {"fp": np.int32, **INDEX}
    columns = ", ".join(f"{c} binary" for c in ("mph", *kinds))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h, g = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h", "g"))
        mph = build_mph(h, g)
        by_slot = pdf.iloc[np.argsort(mph_slots(mph, h, g))]
        raw = {c: by_slot[c].to_numpy(t).tobytes() for c, t in kinds.items()}
        return pd.DataFrame([{"bucket": pdf["bucket"].iloc[0], "buckets": buckets, "repeats": bool((pdf["copies"] > 1).any()), "mph": mph} | raw])

    flat = _hashed(rows, buckets).select("bucket", "h", "g", *kinds)
    flat.groupBy("bucket").applyInPandas(build, f"bucket int, buckets int, repeats boolean, {columns}").write.parquet(f"{path}/index")


# ---------------------------------------------------------------- reading

#: What a slot of the index holds beside the fingerprint.
INDEX = {"shard": np.int32, "block": np.int32, "offset": np.int64, "n": np.int64, "copies": np.int64}
#: Up to so many shards are named to the scan of the payload, which then opens their folders alone.
NAMED_SHARDS = 1000


def lookup(keys: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Positions of the given keys: key, copy, shard, block, offset, n.  Keys never written give no row."""
    spark, kind = keys.sparkSession, keys.schema[key].dataType.simpleString()
    index = spark.read.parquet(f"{path}/index")
    buckets, repeats = index.agg(F.max("buckets"), F.max("repeats")).first()
    kinds = ", ".join(f"{c} {'int' if t is np.int32 else 'bigint'}" for c, t in INDEX.items())

    def find(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        out = asked[["key", "copy"]]
        if not len(index) or not len(asked):
            return out.iloc[:0].assign(**{c: np.zeros(0, t) for c, t in INDEX.items()})
        row = index.iloc[0]
        slot = mph_slots(row["mph"], *(asked[c].to_numpy(np.int64).view(np.uint64) for c in ("h", "g")))
        known = (slot >= 0) & (np.frombuffer(row["fp"], np.int32)[slot] == asked["fp"].to_numpy())
        return out[known].assign(**{c: np.frombuffer(row[c], t)[slot[known]] for c, t in INDEX.items()})

    def found(asked: DataFrame) -> DataFrame:
        asked = _hashed(asked, buckets or 1)
        return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, f"key {kind}, copy bigint, {kinds}")

    first = found(keys.select(F.col(key).alias("key"), F.lit(0).cast("long").alias("copy")).distinct())
    if repeats:
        first = stored(first, "found")
        others = first.where("copies > 1").select("key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies") - 1)).alias("copy"))
        first = first.unionByName(found(others))
    return first.drop("copies")


def _slices(found: DataFrame, path: str, value: str, of, all_shards: bool) -> DataFrame:
    """key, start, n_tokens and a value of the ids of each position found.  value: name and type; of: ids to value.

    Positions go to their block, whose bytes are then read once, and each document's are sliced out of them.
    """
    spark, name = found.sparkSession, value.split(" ")[0]
    payload = _payload(spark, path).select("shard", "block", "id_base", "width", "payload")
    if not all_shards:
        found = stored(found, "found")
        asked = [r["shard"] for r in found.select("shard").distinct().limit(NAMED_SHARDS + 1).collect()]
        if len(asked) <= NAMED_SHARDS:
            payload = payload.where(F.col("shard").isin(asked))
    # a block has no more documents than ids; what lies before a shard joins these few rows, the payload moves once
    wanted = found.groupBy("shard", "block").agg(F.collect_list(F.struct("key", "offset", "n")).alias("asked"))
    wanted = wanted.join(_shards(spark, path).select("shard", "first_id"), "shard")
    kind, arrow = (T.LongType(), pa.int64()) if value.endswith(" bigint") else (T.ArrayType(T.LongType()), pa.list_(pa.int64()))
    schema = T.StructType([T.StructField("key", found.schema["key"].dataType)]).add("start", "long").add("n_tokens", "long").add(name, kind)

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                base, width, asked = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(3)[i].values
                ids = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint16 if width == 2 else np.uint32)
                keys, offset, n = asked.field("key"), asked.field("offset").to_numpy(), asked.field("n").to_numpy()
                if len(offset) and int((offset + n).max()) > len(ids):
                    raise ValueError("a document reaches beyond its block")
                for a, b in in_portions([range(x) for x in n], BLOCK_IDS):
                    own = [of(ids[s : s + m]) for s, m in zip(offset[a:b], n[a:b], strict=True)]
                    yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(base + offset[a:b]), pa.array(n[a:b]), pa.array(own, arrow)], names=schema.names)

    base = (F.col("first_id") + F.col("id_base")).alias("base")
    return payload.join(wanted, ["shard", "block"]).select(base, "width", "payload", "asked").mapInArrow(lean(read), schema)


def get(keys: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Keyed access: key, ids, a row for each document that was written with an asked key."""
    out = _slices(lookup(keys, path, key), path, "ids array<bigint>", lambda ids: ids.astype(np.int64).tolist(), False)
    return out.select(F.col("key").alias(key), "ids")


def token_digest(docs: DataFrame, tokenizer_file: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write a store of docs, then find each doc_id through its index and read its ids out of its block."""
    path = path or scratch(docs.sparkSession, "tokens")
    write_store(docs, path, tokenizer_file, end_id)
    out = _slices(lookup(docs, path), path, "ids_crc32 bigint", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), True)
    return out.withColumnRenamed("key", "doc_id")
