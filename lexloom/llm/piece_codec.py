"""Encoding and decoding with a SentencePiece model by suffix-array matching.

The distinct chunks of a batch are laid end to end; a suffix array over that text is searched for every piece of the
vocabulary, which gives each piece's occurrences as a range.  The occurrences are edges (from, to); they are bucketed
by position, and relaxed in the order of the model's scores: of all edges that join two neighbouring symbols of a
chunk, the best scored, leftmost one wins, until none is left.  That is the rule of a BPE model, whose scores rank
merges and do not add up along a path.

Chunks are cut where no piece can reach across: before a space mark that follows something else, and around
characters that no longer piece holds.  Null texts count as empty; an empty text has no ids.  The order and the
number of rows do not matter, and equal texts get equal ids.  Long texts are worked through in portions of chunks; a
single chunk (a run of letters without a space) is worked through whole, at about a hundred bytes a letter.  Decoding
gives U+FFFD for an id that is null or not in the model.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import ChunkCoder, free, held, lean, small_batches

MARK = "▁"
NONE = np.int64(1) << np.int64(40)
#: Chunks longer than this are relaxed one by one with a heap; the others all at once, a merge a round.
LONG = 192


def _fields(buf: bytes):
    """(number, value) of a protocol buffer message's fields: ints, bytes, or 4 raw bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, buf[at : at + n]
            at += n


class PieceModel:
    """A BPE model file with byte fallback and without text normalisation beyond space marks."""

    NORMAL, BYTE = 1, 6

    def __init__(self, model: bytes):
        pieces, self.dummy_prefix, squeeze, charsmap, kind = [], True, True, b"", 1
        for number, value in _fields(model):
            if number == 1:
                piece, score, sort = "", 0.0, self.NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        sort = v
                pieces.append((piece, score, sort))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                charsmap, self.dummy_prefix, squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if kind != 2 or charsmap or squeeze:
            raise ValueError("only BPE models without normalisation rules are supported")
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, s) in enumerate(pieces) if s == self.BYTE}
        matched = [(p, i, score) for i, (p, score, s) in enumerate(pieces) if s in (self.NORMAL, 4)]
        self.most = max(len(p) for p, _, _ in matched)
        if any(MARK in p.lstrip(MARK) for p, _, _ in matched):
            raise ValueError("a piece reaches across a space mark")
        self.single = {p: i for p, i, _ in matched if len(p) == 1}
        longer = [(p, i) for p, i, _ in matched if len(p) > 1]
        self.alphabet = np.array(sorted({ord(c) for p, _ in longer for c in p}), np.uint32)
        self.code = np.zeros(0x110000, np.uint16)
        self.code[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        # keys of the pieces as the suffix array has them: two bytes a character, most significant first
        self.key_type = f"S{2 * self.most}"
        keys = [self.code[np.frombuffer(p.encode("utf-32-le"), np.uint32)].astype(">u2").tobytes() for p, _ in longer]
        self.low = np.array(keys, self.key_type)
        self.high = np.array([k.ljust(2 * self.most, b"\xff") for k in keys], self.key_type)
        self.ids = np.array([i for _, i in longer], np.int64)
        self.lens = np.array([len(p) for p, _ in longer], np.int64)
        score = np.array([s for _, s, _ in pieces])
        levels = np.unique(-score)
        self.priority = np.searchsorted(levels, -score)
        self.decoded = [bytes([int(p[3:5], 16)]) if s == self.BYTE else b"" if s in (2, 3) else p.replace(MARK, " ").encode() for p, _, s in pieces]
        self.split = self._splitter()

    def _splitter(self):
        points, runs = [int(c) for c in self.alphabet if c != ord(MARK)], []
        for c in points:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        inside = "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else "") for a, b in runs)
        find = re.compile(f"{MARK}+[{inside}]*|[{inside}]+|[^{inside}{MARK}]").findall
        prefix = MARK if self.dummy_prefix else ""
        return lambda text: find(prefix + text.replace(" ", MARK)) if text else []

    def _one(self, c: str) -> list[int]:
        i = self.single.get(c)
        return [i] if i is not None else [self.byte_ids[b] for b in c.encode()]

    def encode_chunks(self, chunks: list[str], portion: int = 150_000):
        """Flat ids and the number of ids of each chunk; about `portion` characters share a suffix array."""
        flat, count = [], []
        at = 0
        while at < len(chunks):
            upto, size = at, 0
            while upto < len(chunks) and (upto == at or size + len(chunks[upto]) < portion):
                size += len(chunks[upto]) + 1
                upto += 1
            ids, n = self._encode_portion(chunks[at:upto])
            flat.append(ids)
            count.append(n)
            at = upto
        return np.concatenate([np.zeros(0, np.int64), *flat]), np.concatenate([np.zeros(0, np.int64), *count])

    def edges(self, codes: np.ndarray):
        """Occurrences of every piece in a coded text: (position, length, id), by suffix array and binary search."""
        n = len(codes)
        padded = np.concatenate([codes, np.zeros(self.most, codes.dtype)]).astype(">u2")
        window = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.most)[:n])
        keys = window.view(self.key_type).ravel()
        suffixes = np.argsort(keys, kind="stable")
        ordered = keys[suffixes]
        first = np.searchsorted(ordered, self.low, "left")
        many = np.searchsorted(ordered, self.high, "right") - first
        ends = np.cumsum(many)
        rank = np.repeat(first - ends + many, many) + np.arange(int(ends[-1]) if len(ends) else 0)
        position, length, piece = suffixes[rank], np.repeat(self.lens, many), np.repeat(self.ids, many)
        order = np.argsort(position, kind="stable")
        return position[order], length[order], piece[order]

    def _encode_portion(self, chunks: list[str]):
        text = "\0".join(chunks) + "\0"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        begin = np.cumsum(size + 1) - size - 1
        codes = self.code[points]
        codes[begin + size] = 0
        position, length, piece = self.edges(codes)
        table = np.full((len(codes), self.most + 1), -1, np.int32)
        table[position, length] = piece
        long = np.flatnonzero(size > LONG)
        short = np.flatnonzero((size > 0) & (size <= LONG))
        starts, owner = self._relax(table, begin[short], size[short])
        owner = short[owner]
        if len(long):
            for w in long:
                own = self._relax_long(table, int(begin[w]), int(size[w]))
                starts, owner = np.concatenate([starts, own]), np.concatenate([owner, np.full(len(own), w)])
            order = np.argsort(starts, kind="stable")
            starts, owner = starts[order], owner[order]
        ends = np.concatenate([starts[1:], [0]]) if len(starts) else starts
        last = np.ones(len(starts), bool)
        last[:-1] = owner[1:] != owner[:-1]
        ends[last] = (begin + size)[owner[last]]
        ids = table[starts, np.minimum(ends - starts, self.most)].astype(np.int64)
        alone = np.flatnonzero(ends - starts == 1)
        if not len(alone):
            return ids, np.bincount(owner, minlength=len(chunks))
        seen, which = np.unique(points[starts[alone]], return_inverse=True)
        spelled = [self._one(chr(c)) for c in seen]
        spelled_n = np.array([len(x) for x in spelled])
        many = np.ones(len(starts), np.int64)
        many[alone] = spelled_n[which]
        ends = np.cumsum(many)
        out = np.repeat(ids, many)
        flat = np.array([i for x in spelled for i in x])
        offset = np.cumsum(spelled_n) - spelled_n
        k = many[alone]
        within = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        out[np.repeat(ends[alone] - k, k) + within] = flat[np.repeat(offset[which], k) + within]
        return out, np.bincount(np.repeat(owner, many), minlength=len(chunks))

    def _relax(self, table: np.ndarray, begin: np.ndarray, size: np.ndarray):
        """Starts of the final symbols and the chunk each belongs to; every round joins one pair a chunk."""
        done_starts, done_owner = [], []
        owner = np.repeat(np.arange(len(size)), size)
        starts = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        finish = begin + size
        while len(starts):
            n = len(starts)
            first = np.ones(n, bool)
            first[1:] = owner[1:] != owner[:-1]
            # the end of the symbol after each one; a chunk's last symbol has none
            stop = np.empty(n, np.int64)
            stop[:-2] = starts[2:]
            ends_here = np.empty(n, bool)
            ends_here[:-1], ends_here[-1] = first[1:], True
            before_last = np.empty(n, bool)
            before_last[:-1], before_last[-1] = ends_here[1:], False
            stop[before_last] = finish[owner[before_last]]
            span = np.where(ends_here, self.most + 1, stop - starts)
            fits = span <= self.most
            joined = np.full(n, -1, np.int64)
            joined[fits] = table[starts[fits], span[fits]]
            key = np.where(joined >= 0, self.priority[joined] * (np.int64(1) << np.int64(32)) + np.arange(n), NONE << np.int64(20))
            heads = np.flatnonzero(first)
            best = np.minimum.reduceat(key, heads)
            active = best < (NONE << np.int64(20))
            keep = np.ones(n, bool)
            keep[(best[active] & np.int64(0xFFFFFFFF)) + 1] = False
            going = np.repeat(active, np.diff(np.append(heads, n)))
            done_starts.append(starts[~going])
            done_owner.append(owner[~going])
            keep &= going
            starts, owner = starts[keep], owner[keep]
        starts = np.concatenate([np.zeros(0, np.int64), *done_starts])
        owner = np.concatenate([np.zeros(0, np.int64), *done_owner])
        order = np.argsort(starts, kind="stable")
        return starts[order], owner[order]

    def _relax_long(self, table: np.ndarray, begin: int, size: int) -> np.ndarray:
        after, before, alive = list(range(1, size + 1)), list(range(-1, size - 1)), [True] * size
        heap = []

        def offer(i):
            j = after[i]
            if j < size and after[j] - i <= self.most:
                piece = int(table[begin + i, after[j] - i])
                if piece >= 0:
                    heapq.heappush(heap, (int(self.priority[piece]), i, j, after[j]))

        for i in range(size - 1):
            offer(i)
        while heap:
            _, i, j, end = heapq.heappop(heap)
            if not (alive[i] and after[i] == j and j < size and alive[j] and after[j] == end):
                continue
            alive[j] = False
            after[i] = end
            if end < size:
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return begin + np.flatnonzero(alive)

    def decode(self, ids) -> str:
        many = len(self.decoded)
        text = b"".join(self.decoded[i] if i is not None and 0 <= i < many else b"\xff" for i in ids).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def read_model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


def model_at(path: str) -> PieceModel:
    """The model of a file that every machine has; read once a stage and worker."""
    return held(f"piece model {path}", lambda: read_model(path))


def coder_at(path: str) -> ChunkCoder:
    """One coder a stage and Python worker: what it remembers serves all the worker's tasks of the stage."""
    return held(f"piece coder {path}", lambda: ChunkCoder(model_at(path).split, model_at(path).encode_chunks, limit=250_000, portion=1_000_000, renew=1600))


def encode_pieces(df: DataFrame, model_path: str, text: str = "text", to: str = "piece_ids") -> DataFrame:
    """df with the ids of its texts in a new column `to` (array<int>); a column of that name is replaced."""
    kept = [c for c in df.columns if c != to]
    source = df.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(free(df.columns, "own_text")))
    schema = df.select(*kept).schema.add(to, T.ArrayType(T.IntegerType()))

    def run(batches):
        coder = coder_at(model_path)
        for batch in batches:
            at, texts = 0, batch.column(len(kept)).to_pylist()
            for ids, sizes in coder.encode(texts):
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                own = batch.slice(at, len(sizes))
                yield pa.RecordBatch.from_arrays([*(own.column(i) for i in range(len(kept))), lists], names=[*kept, to])
                at += len(sizes)

    return small_batches(source).mapInArrow(lean(run), schema)


def decode_pieces(df: DataFrame, model_path: str, ids: str = "piece_ids", to: str = "text") -> DataFrame:
    """df with the texts of its ids in a new column `to`; null ids give null."""
    kept = [c for c in df.columns if c != to]
    schema = df.select(*kept).schema.add(to, "string")

    def run(batches):
        model = model_at(model_path)
        for batch in batches:
            own = batch.column(kept.index(ids)).to_pylist()
            texts = pa.array([None if x is None else model.decode(x) for x in own], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), texts], names=[*kept, to])

    return small_batches(df.select(*kept)).mapInArrow(lean(run), schema)


def piece_digest(docs: DataFrame, model_path: str, key: str = "doc_id") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit), round_trip.

    round_trip tells whether decoding the ids gives the text back, space marks of the text read as spaces.
    """
    rows = docs.select(key, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        model = model_at(model_path)
        coder = coder_at(model_path)
        for batch in batches:
            at, texts = 0, batch.column("text").to_pylist()
            for ids, sizes in coder.encode(texts):
                raw, ends = ids.astype("<u4"), np.cumsum(sizes)
                crc, same = [], []
                for text, a, b in zip(texts[at : at + len(sizes)], ends - sizes, ends, strict=True):
                    own = raw[a:b]
                    crc.append(zlib.crc32(own.tobytes()))
                    same.append(model.decode(own.tolist()) == text.replace(MARK, " "))
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(at, len(sizes)), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=[key, "n_pieces", "ids_crc32", "round_trip"])
                at += len(sizes)

    return small_batches(rows).mapInArrow(lean(run), f"{key} {kind}, n_pieces bigint, ids_crc32 bigint, round_trip boolean")
