import json

import pytest

from lexspark import providers
from lexspark.operators import evaluation
from lexspark.plans import pipelines
from lexspark.sources import tables
from lexspark.streaming import questions as stream


def test_eval_set(spark, tmp_path):
    cases = {"cases": [{"question": "q1", "category": "c", "expected": [{"citation": "s. 1"}, {"any_of": [{"citation": "s. 2", "term": "t"}, {"citation": "s. 3"}]}]}, {"question": "q2", "category": "d", "expected": []}]}
    (tmp_path / "e.json").write_text(json.dumps(cases, indent=1))
    df = tables.read_eval_set(spark, str(tmp_path / "e.json"))
    assert df.count() == 2
    flat = evaluation.flatten_expectations(df)
    got = sorted((r["case_id"], r["exp_no"], r["citation"], r["term"]) for r in flat.collect())
    assert [g[:3] for g in got] == [(0, 0, "s. 1"), (0, 1, "s. 2"), (0, 1, "s. 3")]
    assert {r["exp_no"]: r["wanted"] for r in evaluation.describe_expectations(flat).collect()}[1] == "s. 2 [t] or s. 3"
    (tmp_path / "n.json").write_text(json.dumps({"cases": [{"question": "q", "difficulty": "near", "why": "w"}]}))
    assert tables.read_negatives(spark, str(tmp_path / "n.json")).first()["difficulty"] == "near"


def test_binary_documents(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one\n\ntwo")
    parse = lambda data: [(0, 0, 48.0, 10.0 * i, 90.0, t) for i, t in enumerate(data.decode().split("\n"))]
    rows = tables.read_documents(spark, str(tmp_path / "*.bin"), parse).orderBy("seq").collect()
    assert [(r["seq"], r["text"]) for r in rows] == [(0, "one"), (2, "two")]
    assert rows[0]["page_width"] is None and rows[0]["doc_id"] == rows[1]["doc_id"]
    sized = tables.read_documents(spark, str(tmp_path / "*.bin"), lambda data: [(*line, 612.0, 792.0) for line in parse(data)])
    assert tuple(tables.page_sizes(sized).first())[1:] == (612.0, 792.0)


def test_index_by_fingerprint(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, chunk_seq long, text string")
    mark = tables.save_index(df, str(tmp_path), "m", ["doc_id", "chunk_seq"])
    assert tables.load_index(spark, str(tmp_path), mark).count() == 2
    assert tables.load_index(spark, str(tmp_path), "none") is None
    of = lambda d, m="m": tables.fingerprint(d, m, ["doc_id", "chunk_seq"]).first()[0]
    swapped = spark.createDataFrame([(1, 0, "b"), (1, 1, "a")], df.schema)
    assert of(df) == of(df.repartition(3)) == mark and len({of(df), of(swapped), of(df, "n"), of(df.limit(1))}) == 4
    assert of(df.limit(0))


def test_query_cache(spark, tmp_path):
    cache = spark.createDataFrame([("m", "q1", [1.0]), ("n", "q2", [2.0]), ("m", "q3", None)], "model string, question string, embedding array<float>")
    asked = spark.createDataFrame([("q1",), ("q2",), ("q2",), ("q3",)], "question string")
    assert sorted(r[0] for r in tables.missing_questions(asked, cache, "m").collect()) == ["q2", "q2", "q3"]
    with pytest.raises(KeyError):
        tables.cached_vectors(asked, cache, "m")
    embed = lambda df: providers.embed_column(df, "question", providers.hashing_embedder(4))
    part = tables.warm_query_cache(asked, cache, "m", embed, str(tmp_path))
    assert spark.read.parquet(part).count() == 2  # only what was missing
    new = tables.query_cache(spark, str(tmp_path)).unionByName(cache)
    assert tables.warm_query_cache(asked, new, "m", lambda df: 1 / 0, str(tmp_path)) is None
    assert tables.missing_questions(asked, new, "m").count() == 0 and tables.cached_vectors(asked.filter("question = 'q2'"), new, "m").count() == 2


def test_stream_answers_like_the_batch(spark, tmp_path):
    rows = [(1, "The board may issue shares.", "24", "1", None, None, [1]), (2, "A director shall act honestly.", "122", "1", "Duty", "I", [2])]
    keyed = pipelines.with_text(spark.createDataFrame(rows, "id long, text string, section string, subsection string, heading string, part string, pages array<int>"))
    asked = spark.createDataFrame([(5, "who may issue shares?"), (6, "section 122")], "query_id long, question string")
    asked.write.parquet(str(tmp_path / "in"))
    retrieve = lambda df: pipelines.retrieve(df, keyed, None, "query_id")
    q = stream.answer_stream(spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in")), retrieve, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    key = lambda df: sorted((r["query_id"], r["chunk_key"], r["rk"]) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(retrieve(asked))
