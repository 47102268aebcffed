"""Ranked lexical search by Fagin's threshold algorithm over stored shards of impact-sorted lists.

An index is a Parquet table with a row for each shard of consecutive documents.  A shard holds, for each term, its list
of (document, impact) from the largest impact down, and a forward index that has each document's terms and impacts.
Shards end by their number of postings, so a task holds one at a time, and no posting is ever shuffled.

Terms are the maximal runs of letters of ASCII, digits and all characters beyond ASCII, A-Z lower-cased.  With N
documents that have a term and L terms in all, a document of n terms has m = 75 + (25 * n * N) div L, and a term that
it holds tf times has there the impact (1000000000 * tf) div (1000 * tf + 12 * m).  A term of df documents weighs
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))); a document's score is the sum of w * impact over the query's terms,
repeats included.

A search reads a query's lists side by side, some entries of each a round.  Every document met is scored at once from
its row of the forward index; the threshold is what a document not yet met could reach at most, and a shard is done
when it falls strictly below the k-th best score so far (equal scores go by key, so an equal threshold does not end it).
The k best of every shard meet in a window for each query.  Queries go in blocks of bounded size to all shards.

Null texts and texts without terms are in no list; a null or repeated key is a key like others, each row a document of
its own, and null keys come first among equal scores.  Queries without known terms find nothing; queries equal in id
and text are one; equal ids with other texts are ranked each for itself.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import Numbered, lean, small_batches
from lexloom.session import scratch

#: Letters of ASCII (lower-cased), digits and bytes beyond ASCII as they are; all others are separators.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text whose terms are counted at a time.
PIECE = 4_000_000
#: A shard ends when it has so many postings or documents.
SHARD_POSTINGS, SHARD_DOCS = 1_000_000, 65_536
#: Queries of a block, and characters of their texts.
BLOCK_QUERIES, BLOCK_CHARS = 1024, 4_000_000
#: Entries of each list read in the first round; a round reads twice as many as the one before, up to the last.
ROUND = (32, 1024)


def term_counts(text: str | None) -> Counter:
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    counts, at = Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        counts.update(raw[at:end].split())
        at = end
    return counts


# ---------------------------------------------------------------- index

_BINARY = ("terms", "list_end", "list_doc", "list_impact", "doc_end", "doc_term", "doc_impact")


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents that have a term, and all their terms with repeats."""

    def run(batches):
        for batch in batches:
            sizes = [sum(term_counts(t).values()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["docs", "terms"])

    own = small_batches(docs.select(F.col(text))).mapInArrow(lean(run), "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return own[0] or 0, own[1] or 0


class ShardBuilder:
    """The documents of a shard in the making: numbers of their terms and how often they hold each."""

    def __init__(self):
        self.number, self.keys, self.terms, self.tf, self.postings = Numbered(), [], [], [], 0

    def add(self, key: pa.Array, counts: Counter) -> None:
        self.keys.append(key)
        self.terms.append(np.fromiter(map(self.number.__getitem__, counts), np.int32, len(counts)))
        self.tf.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.postings += len(counts)

    def arrays(self, n_docs: int, n_terms: int) -> tuple[pa.Array, dict[str, bytes]]:
        """Keys in order, nulls first, and the binary columns; a document's number is its key's place."""
        keys = pa.concat_arrays(self.keys)
        order = pc.sort_indices(keys, null_placement="at_start").to_numpy()
        keys, terms, tf = keys.take(pa.array(order)), [self.terms[i] for i in order], [self.tf[i] for i in order]
        held = np.fromiter(map(len, terms), np.int64, len(terms))
        # Python's integers: the product may pass 64 bits
        m = np.fromiter((75 + 25 * int(x.sum(dtype=np.int64)) * n_docs // n_terms for x in tf), np.int64, len(tf))
        term, often = np.concatenate(terms), np.concatenate(tf).astype(np.int64)
        doc = np.repeat(np.arange(len(keys), dtype=np.int32), held)
        impact = (1_000_000_000 * often // (1000 * often + 12 * np.repeat(m, held))).astype(np.int32)
        by_list = np.lexsort((doc, -impact, term))
        ends = np.cumsum(np.bincount(term, minlength=len(self.number))).astype(np.int64)
        lists = {"list_end": ends.tobytes(), "list_doc": doc[by_list].tobytes(), "list_impact": impact[by_list].tobytes()}
        return keys, {"terms": b" ".join(self.number), **lists, "doc_end": np.cumsum(held).tobytes(), "doc_term": term.tobytes(), "doc_impact": impact.tobytes()}


def build_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Write an index of docs under path: the shards, and the two totals that its impacts rest on."""
    spark = docs.sparkSession
    n_docs, n_terms = totals(docs, text)
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("keys", T.ArrayType(kind)), *(T.StructField(c, T.BinaryType()) for c in _BINARY)])

    def run(batches):
        def row(shard):
            keys, arrays = shard.arrays(n_docs, n_terms)
            listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            return pa.RecordBatch.from_arrays([listed, *(pa.array([arrays[c]], pa.binary()) for c in _BINARY)], names=schema.names)

        shard = ShardBuilder()
        for batch in batches:
            for i, one in enumerate(batch.column(1)):
                counts = term_counts(one.as_py())
                if counts:
                    shard.add(batch.column(0).slice(i, 1), counts)
                if shard.postings >= SHARD_POSTINGS or len(shard.keys) >= SHARD_DOCS:
                    yield row(shard)
                    shard = ShardBuilder()
        if shard.keys:
            yield row(shard)

    rows = small_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    # a row group a shard: a group is written and read as a whole, and a shard has some 20 MB
    one = rows.mapInArrow(lean(run), schema).write.option("compression", "zstd").option("parquet.block.row.count.limit", 1)
    one.parquet(f"{path}/shards")
    spark.createDataFrame([(n_docs, n_terms)], "docs long, terms long").write.parquet(f"{path}/totals")


# ---------------------------------------------------------------- search


def threshold_best(lists: list[tuple[np.ndarray, np.ndarray]], weights: list[int], score, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best, best first, equal scores by number, by the threshold algorithm.

    lists: of each term the documents and impacts, largest impact first; weights: above 0; score(documents): their
    whole scores, from the forward index.
    """
    met = np.zeros(n_docs, bool)
    best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth, step = 0, ROUND[0]
    while True:
        new = np.concatenate([d[depth : depth + step] for d, _ in lists]) if lists else best
        new = np.unique(new[~met[new]])
        met[new] = True
        depth, step = depth + step, min(2 * step, ROUND[1])
        best, scores = np.concatenate([best, new]), np.concatenate([scores, score(new)])
        order = np.lexsort((best, -scores))[:k]
        best, scores = best[order], scores[order]
        # a document not met yet stands below the depth in every list that holds it
        threshold = sum(w * int(x[depth]) for w, (_, x) in zip(weights, lists, strict=True) if depth < len(x))
        if threshold == 0 or len(best) == k and threshold < scores[-1]:
            above = scores > 0
            return best[above], scores[above]


class Shard:
    """A shard's lists and rows, and what a block's queries find in it."""

    def __init__(self, row: dict[str, bytes]):
        self.list_end, self.doc_end = (np.frombuffer(row[c], np.int64) for c in ("list_end", "doc_end"))
        self.list_doc, self.list_impact, self.doc_term, self.doc_impact = (np.frombuffer(row[c], np.int32) for c in ("list_doc", "list_impact", "doc_term", "doc_impact"))
        self.doc_start = np.concatenate([[0], self.doc_end[:-1]])
        self.terms = bytes(row["terms"]).split()
        self.weight = np.zeros(len(self.terms), np.int64)

    def keep_terms(self, asked: set[bytes]) -> None:
        """Leave out of the rows what no query of a block asks for, so that looking a document up reads little."""
        known = np.fromiter((t in asked for t in self.terms), bool, len(self.terms))
        self.number = {t: i for i, t in enumerate(self.terms) if known[i]}
        kept = known[self.doc_term]
        before = np.concatenate([[0], np.cumsum(kept)])
        self.doc_start, self.doc_end = before[self.doc_start], before[self.doc_end]
        self.doc_term, self.doc_impact = self.doc_term[kept], self.doc_impact[kept]

    def score(self, docs: np.ndarray) -> np.ndarray:
        start, size = self.doc_start[docs], self.doc_end[docs] - self.doc_start[docs]
        ends = np.cumsum(size)
        at = np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
        sums = np.concatenate([[0], np.cumsum(self.weight[self.doc_term[at]] * self.doc_impact[at])])
        return sums[ends] - sums[ends - size]

    def search(self, query: dict[bytes, int], k: int):
        own = {self.number[t]: w for t, w in query.items() if w > 0 and t in self.number}
        if not own:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = np.fromiter(own, np.int64, len(own))
        self.weight[ids] = list(own.values())
        lists = []
        for t in ids:
            a, b = self.list_end[t - 1] if t else 0, self.list_end[t]
            lists.append((self.list_doc[a:b], self.list_impact[a:b]))
        found = threshold_best(lists, list(own.values()), self.score, len(self.doc_end), k)
        self.weight[ids] = 0
        return found


def _blocks(queries: DataFrame, key: str, text: str):
    """Lists of (id, text), few enough and short enough for a task each."""
    own, size = [], 0
    for row in queries.select(key, text).where(F.col(text).isNotNull()).distinct().toLocalIterator():
        if own and (len(own) == BLOCK_QUERIES or size + len(row[1]) > BLOCK_CHARS):
            yield own
            own, size = [], 0
        own.append((row[0], row[1]))
        size += len(row[1])
    if own:
        yield own


def _block_search(spark: SparkSession, path: str, block: list[tuple], n_docs: int, k: int, key_kind: T.DataType, id_kind: T.DataType) -> DataFrame:
    queries = [(i, term_counts(text)) for i, text in block]
    asked = set().union(*(c for _, c in queries))
    shards = spark.read.parquet(f"{path}/shards")

    def sizes(batches):
        for batch in batches:
            for terms, ends in zip(batch.column(0), batch.column(1), strict=True):
                n = np.diff(np.frombuffer(ends.as_buffer(), np.int64), prepend=0)
                own = [(t, int(x)) for t, x in zip(terms.as_py().split(), n, strict=True) if t in asked]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in own], pa.binary()), pa.array([x for _, x in own], pa.int64())], names=["term", "df"])

    # a row for each term of the block, no more
    df = {bytes(r[0]): r[1] for r in shards.select("terms", "list_end").mapInArrow(lean(sizes), "term binary, df long").groupBy("term").agg(F.sum("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    weighed = [(i, {t: q * weight[t] for t, q in counts.items() if t in weight}) for i, counts in queries]
    schema = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("key", key_kind), T.StructField("score", T.LongType())])
    wanted = set(df)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                shard = Shard({c: batch.column(j + 1)[at].as_buffer() for j, c in enumerate(_BINARY)})
                shard.keep_terms(wanted)
                found = [(n, *shard.search(query, k)) for n, (_, query) in enumerate(weighed)]
                number = np.repeat([n for n, _, _ in found], [len(d) for _, d, _ in found]).astype(np.int32)
                docs = np.concatenate([d for _, d, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(number), batch.column(0)[at].values.take(pa.array(docs)), pa.array(np.concatenate([s for _, _, s in found]))], names=schema.names)

    hits = small_batches(shards.select("keys", *_BINARY)).mapInArrow(lean(run), schema)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_first("key"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(queries)], T.StructType([T.StructField("number", T.IntegerType()), T.StructField("id", id_kind)]))
    return ranked.join(F.broadcast(ids), "number").select("id", "rank", "key", "score")  # a block's ids


def search(path: str, queries: DataFrame, key_kind: T.DataType = T.LongType(), k: int = 20, key: str = "item_id", text: str = "text") -> DataFrame:
    """id, rank, key, score: the k documents of the index under path that score highest for each query, above 0."""
    spark, id_kind = queries.sparkSession, queries.schema[key].dataType
    schema = T.StructType([T.StructField("id", id_kind), T.StructField("rank", T.IntegerType()), T.StructField("key", key_kind), T.StructField("score", T.LongType())])
    n_docs = spark.read.parquet(f"{path}/totals").first()["docs"]
    out = spark.createDataFrame([], schema)
    for n, block in enumerate(_blocks(queries, key, text)):
        found = _block_search(spark, path, block, n_docs, k, key_kind, id_kind)
        out = out.unionByName(found) if n else found
    return out


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 20, path: str | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: an index of docs is written, then searched for every query."""
    path = path or scratch(docs.sparkSession, "lists")
    build_index(docs, path)
    found = search(path, queries, docs.schema["doc_id"].dataType, k)
    return found.select(F.col("id").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


#: The same rows in DuckDB's SQL.
ORACLE = r"""WITH cut AS (SELECT item_id AS id, 'q' AS side, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
 UNION ALL SELECT doc_id, 'd', unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM documents),
counted AS (SELECT side, id, term, count(*) AS tf FROM cut GROUP BY ALL),
sized AS (SELECT id AS doc_id, sum(tf)::BIGINT AS n FROM counted WHERE side = 'd' GROUP BY 1),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted, whole WHERE side = 'd' GROUP BY 1),
scored AS (SELECT q.id AS item_id, d.id AS doc_id, sum(q.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
 FROM counted q JOIN weights USING (term) JOIN counted d USING (term) JOIN sized ON sized.doc_id = d.id, whole WHERE q.side = 'q' AND d.side = 'd' GROUP BY 1, 2),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20"""
