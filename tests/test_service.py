import pytest
from pyspark.sql import functions as F

from lexloom.operators import vectors
from lexloom.service import Service, opened


def test_verbs(spark):
    texts = {1: "thuế thu nhập cá nhân Theo Điều 5 Nghị định 91/2017/NĐ-CP", 2: "đăng ký kinh doanh hộ gia đình", 3: "hợp đồng lao động thời hạn", 4: "thuế thu nhập doanh nghiệp", 5: "bảo hiểm xã hội bắt buộc"}
    chunks = spark.createDataFrame([(i, f"{10 + i // 3}/2020/nđ-cp+{i}", t) for i, t in texts.items()], "chunk_id bigint, corpus_id string, content string")
    encode = vectors.hashed_words(512)
    segments = vectors.encoded(chunks, encode, "content").select(F.col("chunk_id").alias("faiss_id"), "chunk_id", F.lit(1).alias("part"), "embedding")
    service = Service(chunks, segments, encode)
    questions = spark.createDataFrame([(1, "thuế thu nhập cá nhân theo điều 5"), (2, ""), (3, "x" * 2000)], "query_id int, question string")
    got = service.ask(questions).collect()
    assert [r["query_id"] for r in got] == [1] and got[0]["answer"] == texts[1] and "Câu hỏi: thuế" in got[0]["prompt"]
    assert got[0]["n_articles"] >= 3 and 0 <= got[0]["confidence"] <= 1 and got[0]["acts"][0]["act_code"] == "10/2020/NĐ-CP"
    assert [(c["act_code_norm"], c["articles"]) for c in got[0]["citations"]] == [("91/2017/ND-CP", [5])]
    loud = Service(chunks, segments, encode, generate=lambda p: F.concat(F.lit("! "), F.substring(p, 1, 5))).ask(questions).first()
    assert loud["answer"].startswith("! ")
    assert service.source(spark.createDataFrame([(2,), (99,)], "chunk_id bigint")).count() == 1
    asked = spark.createDataFrame([("10/2020/ND-CP", "2, 1,x"), ("11/2020/nđ-cp", None), ("9/1999/x", "1")], "act_code string, articles string")
    found = {r["act_code"]: r["text"] for r in service.citation(asked).collect()}
    assert found["10/2020/ND-CP"].startswith("Điều 2\n" + texts[2]) and texts[4] in found["11/2020/nđ-cp"] and len(found) == 2
    assert service.stats().first()["documents"] == 5 and service.health().first()["healthy"]
    assert service.captions(spark.createDataFrame([("1/2/X",)], "act_code string")).first()["caption"] == "1/2/X"


def test_opening_is_tried_again(spark):
    chunks = spark.createDataFrame([(1, "1/2020/x+1", "a b")], "chunk_id bigint, corpus_id string, content string")
    segments = spark.createDataFrame([(0, 1, 1, [1.0])], "faiss_id bigint, chunk_id bigint, part int, embedding array<float>")
    calls, pauses = [], []

    def make(fails):
        calls.append(1)
        if len(calls) <= fails:
            raise OSError("not yet")
        return Service(chunks, segments, vectors.hashed_words())

    assert opened(lambda: make(2), sleep=pauses.append).health().first()["healthy"] and pauses == [5.0, 5.0]
    calls.clear()
    with pytest.raises(OSError):
        opened(lambda: make(9), sleep=pauses.append)
    assert len(calls) == 3
    service = opened(lambda: Service(chunks, segments, vectors.hashed_words()))
    assert service.renewed(chunks=chunks.limit(0)).health().first()["healthy"] is False and service.health().first()["healthy"]


def test_context_holds_what_the_hits_cite(spark):
    texts = {1: "thuế thu nhập cá nhân Theo Điều 5 Nghị định 91/2017/NĐ-CP và Bộ luật Dân sự 2015", 2: "nội dung điều năm", 3: "bộ luật dân sự đầy đủ"}
    ids = {1: "10/2020/nđ-cp+1", 2: "91/2017/nđ-cp+5", 3: "91/2015/qh13+1"}
    chunks = spark.createDataFrame([(i, ids[i], t) for i, t in texts.items()], "chunk_id bigint, corpus_id string, content string")
    encode = vectors.hashed_words(512)
    segments = vectors.encoded(chunks, encode, "content").select(F.col("chunk_id").alias("faiss_id"), "chunk_id", F.lit(1).alias("part"), "embedding")
    registry = spark.createDataFrame([("91/2015/QH13", "Bộ luật Dân sự", "", 2015)], "act_code string, act_name string, official_title string, year int")
    service = Service(chunks, segments.where("chunk_id = 1"), encode, registry)
    got = service.ask(spark.createDataFrame([(1, "thuế thu nhập cá nhân")], "query_id int, question string")).first()
    own, cited = got["prompt"].split("[Tài liệu trích dẫn]")
    assert "Văn bản: 10/2020/NĐ-CP\nĐiều 1\n" in own and texts[1][:20] in own
    assert "`91/2017/ND-CP`\nĐiều 5\n" + texts[2] in cited and "`91/2015/QH13`\n" in cited and texts[3] in cited
    assert {c["act_code_norm"] for c in got["citations"]} >= {"91/2017/ND-CP"}
