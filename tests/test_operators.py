"""Cases that pin single operators."""

import itertools
import json
import math
import os
import random
import statistics
import time
import unicodedata
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom import schemas
from lexloom.functions import legal_text as L
from lexloom.functions.repair import _repair
from lexloom.operators import bm25, bm25_index, calls, citations, containment, encoding, evaluation, names, retrieval, segments, structure, tables, vectors, wordseg
from lexloom.sources import files
from lexloom.streaming import rate_limit

C = F.col


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("corpus_id", "parts"),
    [
        ("01/2009/tt-bnn+1", ("tt-bnn", "01/2009", "2009", "1")), ("159/2020/NĐ-CP+13", ("nđ-cp", "159/2020", "2020", "13")), ("10/2020/nđ-cp", ("nđ-cp", "10/2020", "2020", "")),
        ("100/2023/qh14+5", ("qh14", "100/2023", "2023", "5")), ("invalid", ("", "", "", "")), ("2020/nđ-cp", ("", "", "", "")), ("159/nđ-cp", ("", "", "", "")), ("", ("", "", "", "")), (None, ("", "", "", "")),
    ],
)
def test_parse_corpus_id(spark, corpus_id, parts):
    df = spark.createDataFrame([(corpus_id,)], "c string")
    assert tuple(df.select(*[c.alias(n) for n, c in L.parse_corpus_id(C("c")).items()]).first()) == parts


@pytest.mark.parametrize(("code", "canonical"), [("159/2020/nd-cp", "159/2020/NĐ-CP"), ("47/2011/tt-bca", "47/2011/TT-BCA"), ("01/2015/TT-BTP", "01/2015/TT-BTP"), ("abc", "ABC"), (" ", "")])
def test_act_code(spark, code, canonical):
    assert one(spark, L.act_code(C("c")), c=code) == canonical


def test_lookup_key_joins_both_spellings(spark):
    assert one(spark, L.lookup_key(C("c")), c=" 91/2017/NĐ-CP") == one(spark, L.lookup_key(C("c")), c="91/2017/nd-cp")


def test_display_falls_back_to_code(spark):
    df = spark.createDataFrame([("1/2020/NĐ-CP", None, None, None), ("1/2020/NĐ-CP", None, None, 3)], "c string, n string, o string, a int")
    assert [r[0] for r in df.select(L.display(C("c"), C("n"), C("o"), C("a"))).collect()] == ["1/2020/NĐ-CP", "1/2020/NĐ-CP — Điều 3"]


def test_repair():
    for text in ("Điều 5", "café", "thuế — khoản"):
        assert _repair(text) == text and _repair(text.encode().decode("latin-1")) == text


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 700), st.integers(32, 256), st.integers(0, 128))
def test_window_formula(n, length, overlap):
    overlap = min(overlap, length // 2)
    stride, spans, at = max(1, length - overlap), [], 0
    while True:
        spans.append((at, min(n, at + length)))
        if spans[-1][1] == n:
            break
        at += stride
    many = 1 if n <= length else 1 + -(-(n - length) // stride)
    assert [(i * stride, min(n, i * stride + length)) for i in range(many)] == spans


def test_windows(spark):
    df = spark.range(1).select(F.array(*[F.lit(str(i)) for i in range(300)]).alias("t"))
    got = df.select(F.explode(segments.windows(C("t"))).alias("w")).select("w.part", "w.begin", "w.upto").collect()
    assert [tuple(r) for r in got] == [(1, 0, 256), (2, 192, 300)]


def test_pieces_are_long_and_overlap():
    text = " ".join(f"word{i}." if i % 9 == 0 else f"word{i}" for i in range(400))
    got = segments._pieces(text, 512, 128)
    assert len(got) > 3 and all(len(p.split()) >= 20 and len(p) <= 513 for p in got)
    assert segments._pieces("", 512, 128) == []


def test_latency_decile(spark):
    values = [float((i * 37) % 101) for i in range(37)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", 5.0)], "s string, v double")
    got = {r["s"]: r for r in evaluation.latencies(df, "s", "v").collect()}
    assert got["a"]["p90"] == round(statistics.quantiles(values, n=10)[8], 6)
    assert got["b"]["p90"] == 5.0


@pytest.mark.parametrize("strategy", ["topm_mean", "max", "mean"])
def test_combined(spark, strategy):
    got = spark.range(1).select(retrieval.combined(F.array(*[F.lit(x) for x in (0.1, 0.4, 0.3)]), strategy).alias("x")).first()["x"]
    assert got == pytest.approx({"topm_mean": 0.35, "max": 0.4, "mean": 0.8 / 3}[strategy])


def python_threshold(scores, start, most):
    t = start
    for _ in range(5):
        n = sum(s >= t for s in scores)
        if 3 <= n <= most:
            return t, [s for s in scores if s >= t]
        if n < 3 and t > 0.4:
            t = max(0.4, t - 0.05)
        elif n > most and t < 0.8:
            t = min(0.8, t + 0.05)
        else:
            break
    return t, sorted(scores, reverse=True)[:most]


def test_adaptive_threshold(spark):
    groups = [[0.1] * 4, [0.9 - i / 100 for i in range(40)], [0.7, 0.65, 0.61], [0.5, 0.45, 0.44, 0.43], [0.3]]
    df = spark.createDataFrame([(q, "a", i, float(s)) for q, g in enumerate(groups) for i, s in enumerate(g)], "query_id int, act_code string, article int, score double")
    for level, (start, most) in retrieval.LEVELS.items():
        got = retrieval.adaptive_threshold(df, level).collect()
        for q, g in enumerate(groups):
            t, kept = python_threshold(g, start, most)
            own = [r for r in got if r["query_id"] == q]
            assert sorted(r["score"] for r in own) == sorted(kept) and all(r["threshold_used"] == t for r in own)


def test_numbered_is_dense(spark):
    df = spark.createDataFrame([(i * 7,) for i in range(100)], "pos bigint").repartition(7)
    assert [tuple(r) for r in tables.numbered(df, "pos", "n", 50).orderBy("pos").collect()] == [(i * 7, i) for i in range(100)]


def test_required_ends_the_run(spark):
    with pytest.raises(Exception, match="missing q"):
        tables.required(spark.createDataFrame([("",)], "q string"), "q").collect()


def test_pairs_without_query_end_the_run(spark):
    pairs = spark.createDataFrame([("q9", "1/2020/x", 1.0)], "query_id string, corpus_id string, score double")
    with pytest.raises(ValueError, match="q9"):
        tables.enriched_pairs(pairs, spark.createDataFrame([("q1", "t")], "query_id string, query_text string"))


def test_top_k_in_blocks_equals_one_block(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float((i * j) % 7) for j in range(1, 5)]) for i in range(60)], "faiss_id bigint, embedding array<double>")
    asked = rows.where("faiss_id < 9").select(C("faiss_id").alias("query_id"), C("embedding").alias("q"))
    whole = vectors.top_k(asked, rows, 5).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    assert vectors.top_k(asked, rows, 5).orderBy("query_id", "rank").collect() == whole
    assert vectors.top_k(asked.limit(0), rows, 5).count() == 0


def test_products_are_held_a_tile_at_a_time(monkeypatch):
    """The k best of tiles are those of all products, ties included; vectors of other sizes and with gaps stay out."""
    monkeypatch.setattr(vectors, "TILE", 7)
    rng = np.random.default_rng(5)
    x, q = rng.integers(-2, 3, (60, 4)).astype(float), rng.integers(-2, 3, (9, 4)).astype(float)
    ids, asked = pa.array([*range(60), 98, 99]), pa.array([*range(9), 50])
    vs, qs = pa.array([*x.tolist(), [1.0, 2.0], [None, 1.0, 1.0, 1.0]], pa.list_(pa.float32())), pa.array([*q.tolist(), [1.0]], pa.list_(pa.float64()))
    for k in (1, 5, 100):
        got = sorted((r["query_id"], r["id"], r["score"]) for b in vectors.nearest(ids, vs, asked, qs, k, "id", 6) for r in b.to_pylist())
        s = q @ x.T
        assert got == [(i, j, s[i, j]) for i in range(9) for j in range(60) if s[i, j] >= np.sort(s[i])[-min(k, 60)]]


def test_judging_by_label_equals_judging_by_pairs(spark):
    queries = spark.createDataFrame([(i, i % 4 if i % 5 else None) for i in range(20)], "query_id long, label int")
    items = spark.createDataFrame([(i, i % 3 if i % 7 else None) for i in range(90)], "faiss_id long, label int")
    hits = spark.createDataFrame([(q, (q * 7 + r * 5) % 90, r) for q in range(20) for r in range(1, 13)], "query_id long, faiss_id long, rank int")
    pairs = queries.join(items, "label").select("query_id", "faiss_id")
    marked = evaluation.judged_by_label(hits, queries, items, "faiss_id")
    want = evaluation.judged(hits, pairs, "faiss_id")
    assert sorted(marked.collect()) == sorted(want.select(marked.columns).collect()) and marked.where("rel = 1").count()
    got = evaluation.scored(marked, evaluation.positives_by_label(queries, items, "faiss_id"))
    rows = lambda df: sorted(df.withColumn("ndcg", F.round("ndcg", 9)).collect(), key=repr)
    assert rows(got) == rows(evaluation.per_query(hits, pairs, "faiss_id"))


def test_bm25_fills_short_rankings(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i == 7 else f"word{i}") for i in range(10)], "doc_id int, text string")
    queries = spark.createDataFrame([("q", "alpha")], "query_id string, query_text string")
    got = bm25.ranking(queries, bm25.tokenised(docs), 4).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [7, 0, 1, 2]
    left = bm25.hard_negatives(bm25.ranking(queries, bm25.tokenised(docs), 4), spark.createDataFrame([("q", 7)], "query_id string, doc_id int"))
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 1, 2]


def test_rankings_by_batches_equal_the_join(spark, monkeypatch):
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words[: rng.randrange(2, 31)]) for _ in range(rng.randrange(0, 40)))) for i in range(300)], "doc_id bigint, text string")
    queries = spark.createDataFrame([(i, " ".join(rng.choice([*words, "unknown"]) for _ in range(rng.randrange(0, 6)))) for i in range(25)], "query_id int, query_text string")
    documents = bm25.tokenised(docs)
    rows = lambda: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in bm25.ranking(queries, documents, 7).collect())
    monkeypatch.setattr(bm25, "DOC_BLOCK", 50)
    by_batches = rows()
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 3)
    by_join = rows()
    assert [r[:3] for r in by_batches] == [r[:3] for r in by_join] and len(by_join) == 25 * 7
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(by_batches, by_join, strict=True))
    none = spark.createDataFrame([(1, "nothing known")], "query_id int, query_text string")
    assert [r["doc_id"] for r in bm25.ranking(none, documents, 3).orderBy("rank").collect()] == sorted(r["doc_id"] for r in documents.collect())[:3]


def test_files(spark, tmp_path):
    path = tmp_path / "corpus.jsonl"
    lines = [{"_id": "159/2020/nđ-cp+13", "text": "một hai " * 10}, {"_id": "47/2011/tt-bca", "text": "ba bốn " * 8}, {"_id": "", "text": "x"}]
    path.write_text("\n".join(map(json.dumps, lines)) + "\n\nnot json\n")
    got = files.read_corpus(spark, str(path)).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["type"], r["suffix"], r["word_count"]) for r in got] == [(0, "nđ-cp", "13", 20), (1, "tt-bca", "", 16)]
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(path), schemas.RAW_CORPUS, strict=True).collect()
    registry = tmp_path / "registry.json"
    registry.write_text(json.dumps(indent=1, obj=[{"so_hieu": "1/2020/nd-cp", "trich_yeu": "a"}, {"so_hieu": "1/2020/NĐ-CP", "trich_yeu": "abc"}]))
    assert [(r["act_code"], r["official_title"], r["year"]) for r in files.read_registry(spark, str(registry)).collect()] == [("1/2020/NĐ-CP", "abc", 2020)]
    assert files.read_registry(spark, str(tmp_path / "none.json")).count() == 0
    files.write_parquet(spark.range(3).withColumn("x", F.lit(1)), str(tmp_path / "p"), ["id", "absent"])
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["id"]
    files.write_texts(spark.createDataFrame([("a", 2, "two_x"), ("a", 1, "one"), ("a", 3, " ")], "n string, i int, t string"), str(tmp_path / "t"), "n", "i", "t")
    assert "".join(p.read_text() for p in (tmp_path / "t").rglob("*.txt")).strip() == "one\n\ntwo x"


def test_other_scans_and_sinks(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_bytes(b'{"_id": "a", "text": "x\xff y"}\n\n{"_id": "b", "text": "z"}\n')
    assert {r["_id"]: r["text"] for r in files.read_jsonl_repaired(spark, str(tmp_path / "bad.jsonl"), schemas.RAW_CORPUS).collect()} == {"a": "x\ufffd y", "b": "z"}
    chunks = spark.createDataFrame([(1, " a "), (2, None)], "chunk_id bigint, content string")
    files.write_parquet(chunks, str(tmp_path / "chunks.parquet"))
    files.write_jsonl(chunks, str(tmp_path / "chunks"))
    for path in ("chunks.parquet", "chunks"):
        assert {r["chunk_id"]: r["content"] for r in files.read_chunks(spark, str(tmp_path / path)).collect()} == {1: "a", 2: ""}
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "one.xml").write_text("<a>text\nmore</a>")
    assert [tuple(r) for r in files.read_legacy(spark, str(tmp_path / "xml"), "xml").collect()] == [("one.xml", "<a>text\nmore</a>")]
    assert {r["name"] for r in files.read_legacy(spark, str(tmp_path / "bad.jsonl"), "jsonl").collect()} == {"b"}  # undecodable is malformed
    texts = spark.createDataFrame([(7, "t")], "id int, text string")
    files.write_parquet(texts, str(tmp_path / "texts"))
    assert [tuple(r) for r in files.read_legacy(spark, str(tmp_path / "texts"), "parquet").collect()] == [("7", "t")]
    files.write_table(spark.createDataFrame([("1", "x"), ("no", "y")], "n string, t string"), "smart_chunks", ["n"])
    assert {(r["n"], r["t"]) for r in spark.table("smart_chunks").collect()} == {(1, "x"), (None, "y")}
    segs = spark.createDataFrame([(0, 0, [3.0, 4.0]), (1, 0, [0.0, 0.0])], "faiss_id int, chunk_id int, embedding array<float>")
    files.write_index(segs, str(tmp_path / "index"))
    assert sorted(tuple(r["vec_norm"]) for r in spark.read.parquet(str(tmp_path / "index" / "segments")).collect()) == [(0.0, 0.0), (0.6, 0.8)]
    assert spark.read.json(str(tmp_path / "index" / "metadata")).first()["total_segments"] == 2
    files.write_metrics(segs.agg(F.count("*").alias("n")), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).first()["n"] == 2
    losses = spark.createDataFrame([(1, 0, 1, 0.5)], files.LOSSES)
    for _ in range(2):
        files.append_losses(losses, str(tmp_path / "losses"))
    assert [tuple(r) for r in files.read_losses(spark, str(tmp_path / "losses")).collect()] == [(1, 0, 1, 0.5)] * 2
    todo = spark.range(5)
    assert files.pending(todo, str(tmp_path / "done"), "id").count() == 5
    files.mark_done(todo.where("id < 3"), str(tmp_path / "done"), "id")
    assert {r["id"] for r in files.pending(todo, str(tmp_path / "done"), "id").collect()} == {3, 4}
    asked = files.read_index(spark, str(tmp_path / "index"), [0]).select(F.lit(7).alias("query_id"), C("vec_norm").alias("q"))
    assert [(r["faiss_id"], r["score"]) for r in files.search_index(asked, str(tmp_path / "index"), 2).orderBy("rank").collect()] == [(0, 1.0), (1, 0.0)]
    sets = tmp_path / "sets"
    sets.mkdir()
    for name in files.PLACEHOLDERS:
        (sets / f"{name}.json").write_text(json.dumps([{"context": name, "question": "q", "answers": {"text": ["a", "b"], "answer_start": [3, 4]}}]))
    assert sorted(tuple(r) for r in files.question_set(spark, str(sets)).collect()) == [(n, n, "q", "a", 3) for n in ("test", "train", "validation")]
    assert files.question_set(spark, str(tmp_path / "none")).count() == 70
    assert segments.policy(16, 256, 300) == (32, 16) and segments.policy(None) == (256, 64)


def test_encoded_search_equals_python(spark):
    encode, texts = vectors.hashed_words(32), ["red green blue", "green blue", "blue", "red", ""]
    df = vectors.encoded(spark.createDataFrame(list(enumerate(texts)), "faiss_id int, text string"), encode, batch=2)
    x = encode(texts).astype("float64")
    got = vectors.top_k(df.where("faiss_id = 1").select(C("faiss_id").alias("query_id"), C("embedding").alias("q")), df, 3).orderBy("rank").collect()
    s = (x @ x[1]).round(6)
    assert [r["faiss_id"] for r in got] == sorted(range(5), key=lambda i: (-s[i], i))[:3]


def test_rate_limit_replay(spark):
    start = datetime(2024, 1, 1)
    rows = [(1, i, start + timedelta(seconds=s)) for i, s in enumerate((0, 0.1, 0.2, 0.3, 1.25))] + [(2, 9, start)]
    got = rate_limit.replay(spark.createDataFrame(rows, "user_id int, event_id int, ts timestamp"), window=1.0, most=3).orderBy("event_id").collect()
    assert [r["accepted"] for r in got] == [True, True, True, False, True, True]
    assert got[3]["retry_after"] == pytest.approx(0.7)


def test_rate_limit_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    for n, seconds in enumerate(((0, 0.1, 0.2), (0.3, 1.25))):
        rows = [(1, int(10 * n + i), start + timedelta(seconds=s)) for i, s in enumerate(seconds)]
        spark.createDataFrame(rows, "user_id int, event_id int, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("user_id int, event_id int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = rate_limit.limit(source, window=1.0, most=3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["event_id"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: True, 1: True, 2: True, 10: False, 11: True}


def test_rest_runs_without_training_data_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['lexloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd="/root/repo" if __file__.startswith("/root/repo") else None)


def test_texts_without_articles_are_cut_into_pieces(spark):
    sentence = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod. "
    rows = [(1, "Điều 1. Tên\nnội dung\n1. Khoản"), (2, sentence * 20), (3, "CHƯƠNG I Chung\n1. " + sentence * 3 + "\n\nxem Điều 5. " + sentence * 3), (4, None), (5, "ngắn")]
    docs = spark.createDataFrame(rows, "doc_id bigint, content string")
    got = sorted((r["doc_id"], r["chunk_index"], r["chunk_type"], r["content"]) for r in structure.smart_chunks(docs, "doc_id", "content").collect())
    pieces = [(r["doc_id"], r["part"], "fallback", " ".join(r["piece"].split())) for r in segments.split_pieces(docs.where("doc_id > 1"), "doc_id", "content").collect()]
    assert [x for x in got if x[0] > 1] == sorted(pieces) and {x[0] for x in pieces} == {2, 3} and len(pieces) > 4
    assert [x[:3] for x in got if x[0] == 1] == [(1, 0, "article"), (1, 1, "clause")]


# ---------------------------------------------------------------- learnt encoders


def dense(rows, places):
    out, ends = np.zeros((len(rows.sizes), places)), np.cumsum(rows.sizes)
    for i, (a, b) in enumerate(zip(ends - rows.sizes, ends, strict=True)):
        out[i, rows.ids[a:b]] += rows.weights[a:b]
    return out


def test_sparse_products(monkeypatch):
    monkeypatch.setattr(encoding, "ENTRIES", 7)
    rows = encoding.counted(["a b a", "", "c " * 30, None, " ".join(map(str, range(20))), "é A"], 6)
    x, m = dense(rows, 64), np.random.default_rng(0).random((64, 5))
    assert np.allclose(rows.times(m), x @ m)
    into = np.ones((64, 3))
    z = np.random.default_rng(1).random((6, 3))
    rows.transposed_times(z, into)
    assert np.allclose(into, 1 + x.T @ z)


def test_latent_vectors_equal_a_dense_decomposition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    encoder, singular = encoding.latent(docs, size=4, bits=9, rounds=40, near=1e-9)
    texts = [r["text"] for r in docs.select("text").collect()]
    counts = dense(encoding.counted(texts, 9), 512)
    idf = np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))) + 1
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = x / np.where(length == 0, 1, length)
    _, values, right = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(singular, values[:4], rtol=1e-3)
    # the cosines of the angles between the two subspaces
    assert np.linalg.svd(right[:4] @ encoder.matrix)[1].min() > 0.999
    assert np.allclose(encoder(texts), x @ encoder.matrix, atol=1e-5)
    assert np.array_equal(encoder([None, "", "..."]), np.zeros((3, 4), np.float32))


def test_gradient_by_differences():
    rng = np.random.default_rng(3)
    start = encoding.Encoder(5, np.ones(32), rng.standard_normal((32, 3)))
    q, c = start.rows(["a b", "c d e", "f"]), start.rows(["a x", "c y", "f z", "hard negative", ""])
    got = np.zeros((32, 3))
    loss = encoding.contrast(start.matrix, q, c, 5.0, got)
    for place in (*set(q.ids.tolist()), *set(c.ids.tolist())):
        for j in range(3):
            moved = [start.matrix.copy() for _ in range(2)]
            moved[0][place, j] += 1e-5
            moved[1][place, j] -= 1e-5
            up, down = (encoding.contrast(m, q, c, 5.0, np.zeros((32, 3))) for m in moved)
            assert abs((up - down) / 2e-5 - got[place, j]) < 1e-4
    assert loss > 0


def test_gradients_sum_over_partitions(spark):
    pairs = spark.createDataFrame([(f"word{i} shared", f"word{i} body text {i}", [f"other{i}"]) for i in range(50)] + [("word1 shared", "word1 body text 1", ["other1"]), (None, "x", None), ("y", None, None)], "query string, positive string, negatives array<string>").repartition(4)
    start = encoding.unlearnt(pairs.select(F.col("positive").alias("text")), size=4, bits=8)
    plan = encoding.Plan(batch=8)
    batches = encoding.batches_of(pairs, start, plan).cache()
    got, loss, n = encoding.gradient(batches, start.matrix, 20.0)
    want, each = np.zeros((256, 4)), 0.0
    for r in batches.collect():
        q, c = (encoding.Rows(*(np.array(r[f"{x}_{p}"]) for p in ("ids", "weights", "sizes"))) for x in "qc")
        assert len(c.sizes) == 2 * len(q.sizes)
        each += encoding.contrast(start.matrix, q, c, 20.0, want)
    assert n == 50 and np.allclose(got, want) and abs(loss - each) < 1e-6
    assert [plan.rate_at(i) / plan.rate for i in (0, 1, 15)] == [0.5, 1.0, 1 / 15]


def test_training_keeps_the_best_and_stops(spark):
    rows = [(i, f"query{i} about topic{i}", f"topic{i} text {i % 7} filler filler more") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, query string, positive string")
    docs, queries = df.select(F.col("id").alias("doc_id"), F.col("positive").alias("text")), df.select(F.col("id").alias("query_id"), F.col("query").alias("text"))
    start = encoding.unlearnt(docs, size=8, bits=9)
    relevant = df.select(F.col("id").alias("query_id"), F.col("id").alias("doc_id"))
    recall = lambda e: encoding.recall_of(e, queries, docs, relevant, 3)
    best, history = encoding.train(df.select("query", "positive"), start, encoding.Plan(epochs=3, steps=2, rate=0.1), recall)
    assert history[-1]["loss"] < history[1]["loss"] and max(h["recall"] for h in history) > history[0]["recall"]
    assert recall(best) == max(h["recall"] for h in history)
    told = iter([0.5, 0.4, 0.5, 0.9])
    best, history = encoding.train(df.select("query", "positive").limit(4), start, encoding.Plan(epochs=5, steps=1, patience=2), lambda e: next(told))
    assert len(history) == 3 and best is start


# ---------------------------------------------------------------- words of several syllables


def all_cuts(n, most=wordseg.MOST):
    if n == 0:
        return [[]]
    return [[*head, n] for size in range(1, min(most, n) + 1) for head in all_cuts(n - size, most)]


def cut_score(lexicon, run, ends):
    """Sum of logs of a cut's words; None where one is no word."""
    known, total = dict(zip(lexicon.words, lexicon.logs, strict=True)), 0.0
    for a, b in zip([0, *ends], ends, strict=False):
        word = " ".join(run[a:b])
        if word not in known and b - a > 1:
            return None
        total += known.get(word, lexicon.unknown)
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcde"), min_size=1, max_size=9), st.dictionaries(st.lists(st.sampled_from("abcd"), min_size=1, max_size=4).map(" ".join), st.floats(0.5, 50), max_size=12))
def test_best_cut_and_expected_words_equal_brute_force(run, counts):
    lexicon = wordseg._of(counts)
    scored = [(s, ends) for ends in all_cuts(len(run)) if (s := cut_score(lexicon, run, ends)) is not None]
    assert math.isclose(cut_score(lexicon, run, lexicon.cut(run)), max(s for s, _ in scored), abs_tol=1e-9)
    whole, want = sum(math.exp(s) for s, _ in scored), {}
    for s, ends in scored:
        for a, b in zip([0, *ends], ends, strict=False):
            word = " ".join(run[a:b])
            if word in counts:
                want[word] = want.get(word, 0) + math.exp(s) / whole
    got = {lexicon.words[i]: n for i, n in lexicon.expected(run).items()}
    assert got.keys() == want.keys() and all(math.isclose(got[w], want[w], rel_tol=1e-6) for w in want)


def test_words_are_learnt_and_joined(spark):
    rng = random.Random(1)
    words = ["nghị định", "pháp luật", "cơ quan nhà nước", "và", "của", "theo", "điều"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)) + ". Khoản 5") for i in range(60)] + [(90, None), (91, "")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    lexicon = wordseg.learnt(df, rounds=6, least=8)
    sample = spark.createDataFrame([(1, "Theo Nghị định của cơ quan nhà nước,<b>và</b> pháp luật\r\nlạ"), (2, None)], "id long, text string")
    got = {r["id"]: r["text"] for r in wordseg.cleaned(sample, lexicon).collect()}
    assert "Nghị_định" in got[1] and "cơ_quan_nhà_nước" in got[1] and "pháp_luật" in got[1] and "\nlạ" in got[1] and got[2] == ""
    plain = {r["id"]: r["text"] for r in wordseg.cleaned(sample, lexicon, stopwords=["nghị_định", "của"], keep_underscore=False).collect()}
    assert "Nghị" not in plain[1] and "của" not in plain[1] and "_" not in plain[1] and "cơ quan nhà nước" in plain[1]
    assert wordseg.learnt(df.limit(0)).words == []


def test_stretches_are_counted_in_lots(spark, monkeypatch):
    """What a task holds is bounded by the lot, not by a batch or a text."""
    texts = ["a b c d e", "b c d, a b", " ".join("xyz"[i % 3] for i in range(50)), None, ""]
    want = Counter(" ".join(run[i : i + n]) for t in texts for run in wordseg.runs_of(t) for n in range(1, wordseg.MOST + 1) for i in range(len(run) - n + 1))
    monkeypatch.setattr(wordseg, "LOT", 7)
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    assert {r["word"]: r["n"] for r in wordseg._stretches(df, "text").collect() if r["word"]} == {w: n for w, n in want.items() if w}


def test_texts_are_segmented_and_expected_many_at_a_time(monkeypatch):
    """As one by one; no run of a lot is gone through by itself."""
    rng = random.Random(3)
    letters = ["a", "b", "C", "c", "d", "İ", " ", " ", " ", "  ", "\u3000", ".", "đ", "1", "_", "ΑΣ", "𐐀"]
    for trial in range(60):
        lexicon = wordseg._of({" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))): rng.uniform(0.5, 50) for _ in range(rng.randint(0, 14))})
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(8)]
        want, got = Counter(), np.zeros(len(lexicon.words))
        for text in texts:
            for run in wordseg.runs_of(text):
                want.update(lexicon.expected(run))
        one_by_one = [lexicon.segmented(t) for t in texts]
        with monkeypatch.context() as m:
            m.setattr(wordseg, "LONG", 3 if trial % 2 else 256)
            if trial % 2 == 0:
                m.delattr(wordseg.Lexicon, "cut")
                m.delattr(wordseg.Lexicon, "expected")
            assert lexicon.all_segmented(texts) == one_by_one
            lexicon.add_expected(wordseg.Syllables.of("\n".join((t or "").lower() for t in texts)), got)
        assert np.allclose(got, [want[i] for i in range(len(got))], rtol=1e-9)


def test_long_stretches_are_counted_only_if_their_parts_may_be_kept(spark, monkeypatch):
    """The lexicon is that of all stretches' counts, whatever ties with the last kept."""
    rng, rows, taken = random.Random(4), [], wordseg._stretches
    texts = [(" ".join(rng.choice("aaabbcde") for _ in range(rng.randint(0, 12))),) for _ in range(60)]
    df = spark.createDataFrame(texts, "text string").repartition(2)
    counts = Counter(" ".join(run[i : i + n]) for (t,) in texts for run in wordseg.runs_of(t) for n in range(1, wordseg.MOST + 1) for i in range(len(run) - n + 1))
    monkeypatch.setattr(wordseg, "COHESION", 0.0)
    monkeypatch.setattr(wordseg, "_stretches", lambda *a: rows.append(taken(*a)) or rows[-1])
    for size, held in ((5, 1 << 20), (12, 1 << 20), (40, 1 << 20), (12, 3), (10_000, 1 << 20)):
        monkeypatch.setattr(wordseg, "HELD", held)
        rows.clear()
        best = lambda words, size=size: sorted(words, key=lambda w: (-counts[w], w))[:size]
        want = {*best(w for w in counts if " " not in w), *best(w for w in counts if " " in w and counts[w] >= 2)}
        assert set(wordseg.learnt(df, rounds=0, least=2, size=size).words) == want
        if size == 5:
            assert sum(r.count() for r in rows) < len(counts) / 2


def test_recall_of_rows_is_that_of_texts(spark):
    docs = spark.createDataFrame([(i, f"w{i % 9} v{i % 4} x{i} {'y ' * (i % 5)}") for i in range(40)] + [(40, None), (41, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"w{i} x{i + 1}") for i in range(6)], "query_id long, text string")
    relevant = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(0, 9)], "query_id long, doc_id long")
    encoder = encoding.unlearnt(docs, size=6, bits=8)
    rows = encoding.weighed(docs, encoder, x="text").localCheckpoint()
    assert rows.columns == ["doc_id", "x_ids", "x_weights"]
    texts = docs.fillna("").collect()
    x = encoder([r["text"] for r in texts]).astype(float)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    shares = []
    for i, text in queries.collect():
        q = encoder([text])[0].astype(float)
        best = sorted(range(len(x)), key=lambda j: (-round(float(x[j] @ q / np.sqrt(q @ q)), 6), texts[j]["doc_id"]))[:3]
        wanted = [r["doc_id"] for r in relevant.where(C("query_id") == i).collect()]
        shares.append(sum(texts[j]["doc_id"] in wanted for j in best) / len(wanted))
    assert encoding.recall_of(encoder, queries, rows, relevant, 3) == encoding.recall_of(encoder, queries, docs, relevant, 3) == pytest.approx(statistics.mean(shares))


# ---------------------------------------------------------------- inner products


def test_products_round_as_sums_in_order():
    rng = np.random.default_rng(4)
    for scale, size in ((1, 64), (1e-3, 7), (1e4, 33), (1e300, 2), (1, 0)):
        q, x = (scale * rng.integers(-9, 9, (n, size)) / 64 for n in (30, 40))  # many products are halves of the last digit
        q[0, :1], x[1, :1] = np.nan, np.inf
        with np.errstate(all="ignore"):
            got = vectors._scores(q, x.T.copy(), 6)
            for i, j in itertools.product(range(30), range(40)):
                total = 0.0
                for a, b in zip(q[i], x[j], strict=True):
                    total += a * b
                want = total if not np.isfinite(total * 1e6) else math.copysign(math.floor(abs(total * 1e6) + 0.5), total) / 1e6
                assert got[i, j] == want or np.isnan(got[i, j]) and np.isnan(want)


def test_inner_products_meet_as_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8 if i % 5 else 3).tolist()) for i in range(70)] + [(70, None), (71, [1.0, None, 2.0])]
    df = spark.createDataFrame(rows, "faiss_id int, embedding array<float>")
    asked = df.where("faiss_id % 2 = 1").select(C("faiss_id").cast("string").alias("query_id"), C("embedding").alias("q"))
    pairs = asked.crossJoin(df).select("query_id", "faiss_id", F.round(vectors.dot(C("q"), C("embedding")), 6).alias("score"))
    want = sorted(tuple(r) for r in pairs.collect())
    for block in (2048, 5):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
        found = vectors.inner_products(asked, df)
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr) and found.schema == pairs.schema
        # no plan makes a row of vectors for each pair
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_products_leave_python_as_lists_from_even_parts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    ids, vs = pa.array([f"v{i}" for i in range(2500)]), pa.array([*rng.standard_normal((2498, 4)).tolist(), None, [1.0]])
    rows = pa.Table.from_batches(vectors.products(ids, vs, pa.array(range(70)), vs.slice(0, 70), 6))
    # a row for each query and TILE vectors, beside those of which the sizes differ
    assert rows.num_rows == 70 * (3 + 1)
    singles = {(q, k): s for q, ks, ss in zip(*(rows.column(n).to_pylist() for n in ("query_id", "keys", "scores")), strict=True) for k, s in zip(ks, ss, strict=True)}
    assert len(singles) == 70 * 2500
    for q, k in ((0, 0), (3, 2497), (69, 1024), (64, 1023)):
        assert singles[q, f"v{k}"] == pytest.approx(sum(a * b for a, b in zip(vs[q].as_py(), vs[k].as_py(), strict=True)), abs=1e-6)
    assert singles[5, "v2498"] is None and singles[5, "v2499"] is None

    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    df = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(300)], "faiss_id int, embedding array<float>")
    asked = df.where("faiss_id % 20 = 0").select(C("faiss_id").alias("query_id"), C("embedding").alias("q"))
    blocks = df.groupBy(F.pmod(F.xxhash64("faiss_id"), F.lit(60))).count().agg(F.max("count")).first()[0]
    found = vectors.inner_products(asked, df)
    part = found.groupBy(F.spark_partition_id()).agg(F.countDistinct("faiss_id").alias("n"))
    assert found.count() == 15 * 300 and part.agg(F.max("n")).first()[0] <= blocks  # no part has two blocks


def test_written_products_keep_a_dictionary_of_scores(spark, tmp_path):
    """Plain doubles would take 8 bytes a row, more than a disk holds of all pairs; settings of the cluster's own stay."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4096, 256))
    df = spark.createDataFrame(list(enumerate((x / np.linalg.norm(x, axis=1)[:, None]).tolist())), "faiss_id int, embedding array<float>")
    asked = df.where("faiss_id % 4 = 0").select(C("faiss_id").alias("query_id"), C("embedding").alias("q"))
    vectors.inner_products(asked, df).write.parquet(str(tmp_path / "pairs"))
    files = list((tmp_path / "pairs").glob("*.parquet"))
    assert sum(f.stat().st_size for f in files) < 6 * 1024 * 4096
    chunks = [m.row_group(g).column(2) for f in files for m in [pq.read_metadata(f)] for g in range(m.num_row_groups)]
    assert chunks and all("PLAIN" not in c.encodings for c in chunks)
    key = "parquet.page.size"
    try:
        spark.conf.set(key, "1000000")
        vectors.compact(spark)
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.unset(key)


# ---------------------------------------------------------------- stored BM25 index


def test_blocks_below_the_best_are_skipped():
    rng = np.random.default_rng(2)
    for n, top in ((0, 3), (200, 5), (5000, 10)):
        blocks = -(-n // bm25_index.BLOCK)
        asked, whole, shares = [], np.zeros(n), np.zeros(n, bool)
        for weight, chance in ((0.2, 0.9), (3.0, 0.1), (7.0, 0.004), (-0.1, 0.5)):
            places = np.flatnonzero(rng.random(n) < chance)
            impacts = rng.random(len(places)) ** 6
            own = {}
            for b in np.unique(places // bm25_index.BLOCK):
                some = places // bm25_index.BLOCK == b
                own[int(b)] = places[some], impacts[some], impacts[some].max()
            asked.append((weight, own))
            whole[places] += weight * impacts
            shares[places] = True
        places, scores, scored = bm25_index.best_blocks(asked, blocks, top)
        want = np.round(whole[shares], 6)
        edge = np.sort(want)[-top] if len(want) >= top else -np.inf
        assert sorted(places) == [i for i in np.flatnonzero(shares) if round(whole[i], 6) >= edge]
        assert np.allclose(scores, np.round(whole[places], 6)) and (n < 1000 or scored < blocks)


def test_stored_index_ranks_as_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25_index, "SHARD", 40)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(90001, None), (90002, ""), (90003, "...")], "doc_id long, text string"))
    queries = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("item_id AS query_id", "text AS query_text").unionByName(spark.createDataFrame([(900, "zzzunknown"), (901, None)], "query_id long, query_text string"))
    path = f"file://{tmp_path}/index"
    bm25_index.build(docs, path)
    got = bm25_index.ranking(spark, path, queries, 20).selectExpr("query_id", "key AS doc_id", "score", "rank").collect()
    assert sorted(got) == sorted(bm25.ranking(queries, bm25.tokenised(docs), 20).select("query_id", "doc_id", "score", "rank").collect())
    assert spark.read.parquet(f"{path}/documents").select("shard").distinct().count() > 3


def test_index_moves_texts_once_and_no_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25_index, "SHARD", 600)
    rows = [(None if i == 5 else i - i % 50 if 100 < i < 200 else i, f"a b{i % 7} {'c ' * (i % 4)}") for i in range(1500)]  # some keys repeat, one is null
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"file://{tmp_path}/index"
    bm25_index.build(docs, path)
    documents = {(r["shard"], r["place"]): r for r in spark.read.parquet(f"{path}/documents").collect()}
    of, seen = Counter(), Counter((k, t, n) for k, x in rows for t, n in Counter(x.split()).items())
    length = statistics.mean(len(x.split()) for _, x in rows)
    lengths = {(k, len(x.split())) for k, x in rows}
    for r in spark.read.parquet(f"{path}/postings").collect():
        assert {p // bm25_index.BLOCK for p in r["place"]} == {r["block"]} and r["place"] == sorted(set(r["place"])) and r["most"] == max(r["impact"])
        for place, impact in zip(r["place"], r["impact"], strict=True):
            k = documents[r["shard"], place]["key"]
            fit = [n for a, t, n in seen if (a, t) == (k, r["token"]) and any(math.isclose(impact, n * 2.5 / (n + 1.5 * (0.25 + 0.75 * m / length))) for a, m in lengths if a == k)]
            assert fit
            of[k, r["token"]] += 1
    assert of == Counter((k, t) for k, x in rows for t in set(x.split()))
    assert {r["token"]: r["df"] for r in spark.read.parquet(f"{path}/terms").collect()} == Counter(t for _, x in rows for t in set(x.split()))
    # what moved by shard and place was texts: no file has postings of two shards, and a shard's are in one
    files = spark.read.parquet(f"{path}/postings").select("shard", F.input_file_name().alias("f")).distinct().collect()
    assert len(files) == len({r["shard"] for r in files}) == len({r["f"] for r in files}) == 3


# ---------------------------------------------------------------- repairs in places, lines, names


def test_repair_in_places():
    wrong = lambda t, e="latin-1": t.encode().decode(e, "replace")
    assert _repair("日本 " + wrong("Nghị định số") + " 日本") == "日本 Nghị định số 日本"
    assert _repair("Điều 1: " + wrong("café – crème", "cp1252") + " Điều 2") == "Điều 1: café – crème Điều 2"
    assert _repair("日 " + wrong(wrong("é"))) == "日 é"
    assert _repair("Điều " + wrong("Привет мир")) == "Điều Привет мир"
    for clean in ("«CAFÉ» 日本", "Điều Â. À la carte", "naïve – Ô… 日", "ÉÈÊ ‘À’ Điều", "", "日本 " * 50):
        assert _repair(clean) == clean


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aé ñüÂÃ»–ệđ日", max_size=12), st.text(alphabet="ab éèñüçäößệđ", max_size=12))
def test_repair_leaves_what_stands_around(clean, text):
    assert _repair(f"日{clean}日") == unicodedata.normalize("NFC", f"日{clean}日") or any(x in clean for x in "ÃÂ")
    assert _repair(f"日 {text.encode().decode('latin-1')} 日") == unicodedata.normalize("NFC", f"日 {text} 日")


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    for name, n in (("b.jsonl", 500), ("a.jsonl", 300)):
        (tmp_path / name).write_text("".join(json.dumps({"_id": f"{name}{i}", "text": "x" * (i % 50)}) + "\n" + "\n" * (i % 3 == 0) for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = files.read_lines(spark, str(tmp_path)).orderBy("pos").collect()
        assert len({r["pos"] for r in rows}) == len(rows) == rows[-1]["pos"] + 1
        for name in ("a.jsonl", "b.jsonl"):
            lines = (tmp_path / name).read_text().splitlines()
            assert [(r["line"], r["value"]) for r in rows if r["file"].endswith(name)] == list(enumerate(lines, 1))
        chunks = files.read_corpus(spark, str(tmp_path)).orderBy("chunk_id").collect()
        want = [f"{name}{i}" for name, n in (("a.jsonl", 300), ("b.jsonl", 500)) for i in range(n) if i % 50]
        assert [(c["chunk_id"], c["corpus_id"]) for c in chunks] == list(enumerate(want))
        assert files.read_jsonl(spark, str(tmp_path), schemas.RAW_CORPUS, strict=True).count() == 800
        with open(tmp_path / "a.jsonl", "a") as f:
            f.write('{"_id": "z", \n')
        with pytest.raises(Exception, match=r"malformed JSON in file:.*a\.jsonl, line 401"):
            files.read_jsonl(spark, str(tmp_path), schemas.RAW_CORPUS, strict=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_index_of_names_finds_what_the_join_finds(spark, monkeypatch):
    rng = random.Random(4)
    words = ["luật", "bộ luật", "nghị định", "dân sự", "hình", "sự", "đất đai", "đất", "a", "thuế", "mới"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    acts = spark.createDataFrame([(f"c{i}", text(rng.randrange(1, 5)), "", rng.choice([None, 2000, 2001])) for i in range(150)] + [("x", None, None, 1)], "act_code string, act_name string, official_title string, year int")
    mentions = spark.createDataFrame([(i, text(rng.randrange(1, 5)) + rng.choice(["", " x", "mới"]), rng.choice([None, 2000, 2001])) for i in range(300)] + [(900, None, None), (901, "", 2000), (902, "zzz", None)], "mention_id int, window string, year_hint int")
    got = sorted(citations.name_matches(mentions, acts).collect())
    monkeypatch.setattr(names, "NAMES", 10)
    assert len(got) > 200 and got == sorted(citations.name_matches(mentions, acts).collect())
    monkeypatch.undo()
    assert citations.name_matches(mentions, acts.limit(0)).count() == 0


# ---------------------------------------------------------------- calls outside, sweeping


@pytest.mark.parametrize("most", [4, 0])
def test_acts_of_one_name_and_year_are_one(spark, monkeypatch, most):
    """A registry is held by its different names, however many acts repeat them; mentions worded alike are resolved once."""
    monkeypatch.setattr(names, "NAMES", most)
    acts = spark.createDataFrame([(f"act{i:03}", 2000 + i % 2, "Luật LARGE 1" if i % 4 < 2 else "Nghị định SMALL 2", "") for i in range(40)], "act_code string, year int, act_name string, official_title string")
    mentions = spark.createDataFrame([(i, "Luật large 1" if i % 2 else "small 2", 2001 if i % 3 else None) for i in range(60)], "mention_id long, window string, year_hint int")
    held = []
    monkeypatch.setattr(citations.name_index, "resolved", lambda own, rows, f=names.resolved: held.append(len(rows)) or f(own, rows))
    got = {r["mention_id"]: (r["act_code"], r["score"]) for r in citations.name_matches(mentions, acts).collect()}
    assert got == {i: ("act001", 7) if i % 2 else ("act003", 7) for i in range(60)} and held == ([4] if most else [])


def test_calls_resume_where_they_were_killed(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(60)] + [(60, None)], "id long, prompt string")
    log, path = str(tmp_path / "log"), f"file://{tmp_path}/answers"
    fatal, busy = (df.where(f"id < 60 AND pmod(xxhash64(id), 5) = {part}").first() for part in (2, 0))

    def service(kill):
        fatal_prompt, busy_prompt = fatal["prompt"], busy["prompt"]

        def call(text):
            with open(log, "a") as f:
                f.write(text + "\n")
            if kill and text == fatal_prompt:
                os._exit(1)  # the worker is gone in the middle of its work
            if text == busy_prompt and kill:
                raise ConnectionError("busy")
            return text.upper()

        return call

    policy = calls.Policy(tries=2, wait=0.01, tasks=2, slices=5)
    with pytest.raises(Exception):  # noqa: B017, PT011
        calls.run_pending(df, path, service(True), "id", "prompt", policy)
    done = {r["id"] for r in calls.answers(spark, path, "id").where("error IS NULL").collect()}
    before = Counter(open(log).read().split())
    assert before[busy["prompt"]] == 2 and not {fatal["id"], busy["id"]} & done and 10 < len(done) < 50
    got = {r["id"]: r for r in calls.run_pending(df, path, service(False), "id", "prompt", policy).collect()}
    after = Counter(open(log).read().split()) - before
    assert after == Counter(f"p{i}" for i in range(60) if i not in done)
    assert all(got[i]["value"] == f"P{i}" and got[i]["error"] is None for i in range(60)) and got[60]["error"] == "no payload" and got[60]["tries"] == 0


def test_calls_back_off_and_keep_their_rate(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(8)], "id long, prompt string")
    began = time.perf_counter()
    rows = calls.called(df, lambda text: text, "id", "prompt", calls.Policy(rate=8.0, tasks=1)).collect()
    assert time.perf_counter() - began > 7 / 8 and {r["tries"] for r in rows} == {1}

    def never(text):
        raise ValueError(text)

    began = time.perf_counter()
    rows = calls.called(df.limit(1), never, "id", "prompt", calls.Policy(tries=3, wait=0.2, tasks=1)).collect()
    assert time.perf_counter() - began > 0.6 and [(r["value"], r["error"], r["tries"]) for r in rows] == [(None, "ValueError: 0", 3)]


def test_idle_clients_are_swept_by_the_clock(spark, tmp_path):
    """No request comes after the first ones, and yet the client goes once its log has run out."""
    now = datetime.now()
    spark.createDataFrame([(1, i, now) for i in range(3)], "user_id int, event_id int, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema("user_id int, event_id int, ts timestamp").parquet(str(tmp_path / "in"))
        query = rate_limit.swept_limit(source, window=2.0, most=2, sweep=1.0).writeStream.format("memory").queryName("swept").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
        until, rows = time.time() + 90, []
        while time.time() < until and not any(r["event_id"] is None for r in rows):
            time.sleep(1)
            rows = spark.table("swept").collect()
        query.stop()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r["accepted"] for r in rows if r["event_id"] is not None] == [True, True, False]
    assert [(r["user_id"], r["accepted"]) for r in rows if r["event_id"] is None] == [(1, None)]


def test_documents_that_hold_passages(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.randrange(30))) for i in range(60)] + [(60, None), (None, "ab"), (7, "ab")], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(f"i{i}", text(rng.randrange(4))) for i in range(30)] + [("none", None), ("x", "")], "item_id string, text string")
    got = sorted(containment.holding(docs, items).collect(), key=repr)
    assert got == sorted(((i["item_id"], r["doc_id"]) for i in items.collect() for r in docs.collect() if i["text"] is not None and r["text"] is not None and i["text"] in r["text"]), key=repr)
    monkeypatch.setattr(containment, "PASSAGES", 3)
    assert sorted(containment.holding(docs, items).collect(), key=repr) == got
    monkeypatch.undo()
    assert containment.holding(docs, items.limit(0)).count() == 0
