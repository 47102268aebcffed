"""Windows over tokens or characters, and the segment table of an index."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import legal_text as L
from lexloom.operators import vectors
from lexloom.operators.tables import numbered

# The policy of segment lengths.
LENGTH, OVERLAP, LEAST_LENGTH, CHARS_PER_TOKEN = 256, 64, 32, 4


def policy(model_length: int | None = None, length: int = LENGTH, overlap: int = OVERLAP) -> tuple[int, int]:
    """(length, overlap): the length at least LEAST_LENGTH and at most the model's, the overlap at most half of it."""
    length = max(LEAST_LENGTH, min(length, model_length or length))
    return length, max(0, min(overlap, length // 2))


def n_windows(n: Column, length: int, overlap: int) -> Column:
    stride = max(1, length - overlap)
    return F.when(n <= length, 1).otherwise(1 + F.ceil((n - length) / stride)).cast("int")


def windows(tokens: Column, length: int = LENGTH, overlap: int = OVERLAP) -> Column:
    """Array of (part from 1, begin, upto, tokens): one window if the tokens fit, else overlapping ones to the end."""
    stride = max(1, length - overlap)

    def all_of(own):
        def window(i):
            begin = i * stride
            return F.struct((i + 1).alias("part"), begin.alias("begin"), F.least(F.size(own), begin + length).alias("upto"), F.slice(own, begin + 1, F.lit(length)).alias("tokens"))

        return F.transform(F.sequence(F.lit(0), n_windows(F.size(own), length, overlap) - 1), window)

    # the tokens are bound to a variable, else each window would tokenise the text anew
    return F.get(F.transform(F.array(tokens), all_of), 0)


def char_windows(text: Column, length: int = LENGTH, overlap: int = OVERLAP) -> Column:
    """Array of (part, text): windows of characters where there is no tokenizer; blank ones are dropped."""
    size, step = length * CHARS_PER_TOKEN, max(1, (length - overlap) * CHARS_PER_TOKEN)
    n = F.length(text)
    many = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / step)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.struct((i + 1).alias("part"), L.strip(F.substring(text, i * step + 1, F.lit(size))).alias("text")))
    return F.filter(parts, lambda p: p["text"] != "")


#: Characters of texts that are tokenised at a time; a longer text stands alone.
LOT_CHARS = 1_000_000


def _lots(batch: pa.RecordBatch, texts: list[str]):
    """Slices of a batch and of its texts with about LOT_CHARS characters each: a token's record takes many times its bytes."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > LOT_CHARS:
            yield batch.slice(begin, i - begin), texts[begin:i]
            begin = i
            size = 0
        size += len(t)
    if begin < len(texts):
        yield batch.slice(begin), texts[begin:]


def model_windows(df: DataFrame, key: str, text: str, tokenizer_file: str, length: int = LENGTH, overlap: int = OVERLAP) -> DataFrame:
    """key, part, span_token_start, span_token_end, text: windows over the ids of a model's tokenizer, decoded.

    A text of at most `length` ids is one segment, as it is; of others each window's ids are decoded, and blank ones
    drop out.  Blank and null texts have none.  tokenizer_file is a file of the tokenizers library that every machine has.
    """

    def run(batches):
        tokenizer, stride = vectors.tokenizer_at(tokenizer_file), max(1, length - overlap)
        for whole in batches:
            texts = [(t or "").strip(L.BLANKS) for t in whole.column(1).to_pylist()]
            for batch, own_texts in _lots(whole, texts):
                out = {"place": [], "part": [], "begin": [], "end": [], "text": []}
                for i, (t, own) in enumerate(zip(own_texts, tokenizer.encode_batch_fast(own_texts, add_special_tokens=False), strict=True)):
                    ids = own.ids
                    n = len(ids)
                    many = 1 if n <= length else 1 + -(-(n - length) // stride)
                    spans = [(k * stride, min(n, k * stride + length)) for k in range(many)] if t else []
                    shown = [t] if many == 1 else [x.strip(L.BLANKS) for x in tokenizer.decode_batch([ids[a:b] for a, b in spans], skip_special_tokens=True)]
                    kept = [(a, b, x) for (a, b), x in zip(spans, shown, strict=False) if x]
                    for part, (a, b, x) in enumerate(kept, 1):
                        for name, value in zip(out, (i, part, a, b, x), strict=True):
                            out[name].append(value)
                keys = batch.column(0).take(pa.array(out.pop("place"), pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(v, pa.string() if n == "text" else pa.int32()) for n, v in out.items())], names=[key, "part", "span_token_start", "span_token_end", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, part int, span_token_start int, span_token_end int, text string")


def segment_table(chunks: DataFrame, length: int = LENGTH, overlap: int = OVERLAP) -> DataFrame:
    """A row a segment: faiss_id (dense, by chunk and part), the chunk's id parts, part, span in tokens, text.

    Chunks without tokens have no segments.
    """
    parts = L.parse_corpus_id(F.col("corpus_id"))
    rows = chunks.select("chunk_id", "corpus_id", *[c.alias(n) for n, c in parts.items()], L.tokens(F.col("content")).alias("tokens")).where(F.size("tokens") > 0)
    rows = rows.withColumn("w", F.explode(windows(F.col("tokens"), length, overlap)))
    rows = rows.select("chunk_id", "corpus_id", *parts, F.col("w.part").alias("part"), F.col("w.begin").alias("span_token_start"), F.col("w.upto").alias("span_token_end"), F.array_join("w.tokens", " ").alias("text"))
    # a chunk has fewer than 2^20 parts
    return numbered(rows.withColumn("__pos", F.col("chunk_id") * (1 << 20) + F.col("part")), "__pos", "faiss_id", width=1 << 36).drop("__pos")


def chunk_segments(chunks: DataFrame, most: int, length: int = LENGTH, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, part, text of each chunk's first `most` segments."""
    own = F.slice(windows(L.tokens(F.col("content")), length, overlap), 1, most)
    return chunks.select("chunk_id", F.explode(own).alias("w")).select("chunk_id", F.col("w.part").alias("part"), F.array_join("w.tokens", " ").alias("text")).where("text <> ''")


_ENDS = (". ", "! ", "? ", "; ")


def _last(places: list[int], low: int, high: int) -> int:
    """Distance from low of the last place in low .. high - 1; -1 without one."""
    i = bisect_left(places, high)
    return places[i - 1] - low if i and places[i - 1] >= low else -1


def _spans(paragraph: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Where the pieces of a paragraph begin and end, from the places of all its sentence and line ends.

    A piece is cut behind a sentence end within size + 1 characters: kind by kind, the last end of a kind counts if
    it begins behind the cut so far.  Without one, behind the last line end, else after size characters.
    """
    ends = [[m.start() for m in re.finditer(re.escape(e), paragraph)] for e in _ENDS]
    lines = [m.start() for m in re.finditer("\n", paragraph)]
    out, begin, whole = [], 0, len(paragraph)
    while begin < whole:
        upto = min(begin + size + 1, whole)
        cut = reduce(lambda far, at: at + 2 if at > far else far, (_last(places, begin, upto - 1) for places in ends), -1)  # noqa: B023
        line = _last(lines, begin, upto)
        end = begin + (cut if cut > 0 else line + 1 if line > 0 else min(size, upto - begin))
        out.append((begin, end))
        begin = whole if end >= whole else max(end - overlap, begin + 1)
    return out


def _pieces(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of twenty words or more of each paragraph."""
    pieces = (p[a:b].strip() for p in re.split(r"\n\n+", text.strip()) for a, b in _spans(p, size, overlap))
    return [p for p in pieces if len(p.split()) >= 20]


def split_pieces(df: DataFrame, key: str, text: str, size: int = 512, overlap: int = 128) -> DataFrame:
    """key, part, piece: paragraphs cut at sentence ends into overlapping pieces; those of under 20 words are dropped.

    Where a cut falls depends on the cut before it, so this is a Python function over Arrow batches.
    """

    def run(batches):
        for batch in batches:
            keys, parts, pieces = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, p in enumerate(_pieces(t or "", size, overlap)):
                    keys.append(k)
                    parts.append(i)
                    pieces.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(parts, pa.int32()), pa.array(pieces, pa.string())], names=[key, "part", "piece"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, part int, piece string")


def training_rows(triplets: DataFrame, length: int = LENGTH, overlap: int = OVERLAP, negatives: int = 4) -> DataFrame:
    """query_id, query_text, positive, negatives: a row for each segment of a positive, with all segments of the first few negatives."""
    joined = lambda t: F.transform(windows(L.tokens(t), length, overlap), lambda w: F.array_join(w["tokens"], " "))
    first = F.flatten(F.transform(F.slice("negative_texts", 1, negatives), joined))
    return triplets.select("query_id", "query_text", F.explode(joined(F.col("positive_text"))).alias("positive"), F.filter(first, lambda x: x != "").alias("negatives")).where("positive <> ''")
