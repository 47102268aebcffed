"""Which documents hold which passages as they are: one automaton over the passages, one pass over the documents."""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Passages, and characters of all of them, that a worker holds; more are joined, pair by pair.
PASSAGES, CHARS = 100_000, 20_000_000
#: The automaton of this Python worker, by the broadcast that it was made of.
_HELD: dict = {}


def _automaton(passages: list[tuple]):
    by_text = defaultdict(list)
    for number, (_, text) in enumerate(passages):
        by_text[text].append(number)
    every = by_text.pop("", [])
    found = ahocorasick.Automaton()
    for text, numbers in by_text.items():
        found.add_word(text, numbers)
    if by_text:
        found.make_automaton()
    return found, every, bool(by_text)


def holding(docs: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text", passage: str = "item_id", wording: str = "text") -> DataFrame:
    """passage, key of every document whose text holds a passage's; once for each document row.

    A null text holds nothing, a null passage stands nowhere, an empty one stands in every text.
    """
    known = passages.where(F.col(wording).isNotNull()).select(F.col(passage).alias("p"), F.col(wording).alias("w"))
    many, chars = known.agg(F.count("*"), F.coalesce(F.sum(F.length("w")), F.lit(0))).first()
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    if many > PASSAGES or chars > CHARS:
        return known.join(rows, F.contains("t", "w")).select(F.col("p").alias(passage), F.col("k").alias(key))
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in known.collect()])  # of a checked size
    schema = T.StructType([T.StructField(passage, passages.schema[passage].dataType), T.StructField(key, docs.schema[key].dataType)])
    kind = to_arrow_type(schema[passage].dataType)

    def run(batches):
        if shared not in _HELD:
            _HELD.clear()
            _HELD[shared] = _automaton(shared.value)
        automaton, every, any_word = _HELD[shared]
        for batch in batches:
            at, who = [], []
            for i, one in enumerate(batch.column(1).to_pylist()):
                own = {n for _, numbers in automaton.iter(one) for n in numbers} if any_word else set()
                own = sorted(own.union(every))
                at += [i] * len(own)
                who += [shared.value[n][0] for n in own]
            yield pa.RecordBatch.from_arrays([pa.array(who, kind), batch.column(0).take(pa.array(at, pa.int64()))], names=schema.names)

    return rows.mapInArrow(run, schema)
