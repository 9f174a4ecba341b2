import math

import pytest
from pyspark.sql import functions as F

from lexspark import providers
from lexspark.operators import bm25, evaluation, fusion, grounding, vector
from lexspark.plans import pipelines


def texts(spark, *ts):
    return spark.createDataFrame(list(enumerate(ts)), "id long, text string")


def ask(spark, question, *ts, k=5):
    q = spark.createDataFrame([(7, question)], "query_id long, question string")
    return [(r["id"], r["score"]) for r in bm25.search(q, bm25.build_postings(texts(spark, *ts), ["id"]), "query_id", ["id"], k).orderBy("rk").collect()]


def test_bm25_scores(spark):
    got = ask(spark, "x", "x", "x a b c")
    assert [round(s, 9) for _, s in got] == [0.249755557, 0.143560281]
    once, twice = ask(spark, "x y", "x y", "x", "z"), ask(spark, "x x y", "x y", "x", "z")
    assert twice[0][1] > once[0][1]  # a repeated query term counts again
    assert ask(spark, "unknown", "x") == [] and ask(spark, "", "x") == [] and ask(spark, "x") == []


def test_bm25_with_more_terms_than_are_broadcast(spark, monkeypatch):
    base = bm25.build_postings(texts(spark, "x y", "x", "z"), ["id"])
    q = spark.createDataFrame([(7, "x y x"), (8, "z")], "query_id long, question string")
    get = lambda: sorted((r["query_id"], r["id"], r["score"], r["rk"]) for r in bm25.search(q, base, "query_id", ["id"]).collect())
    want = get()
    monkeypatch.setattr(bm25, "BROADCAST_ROWS", 0)
    assert get() == want and len(want) == 3


@pytest.mark.parametrize("cells,per_pass", [(2_000_000, 512), (7, 512), (30, 1)])
def test_searching_texts_equals_searching_their_postings(spark, monkeypatch, cells, per_pass):
    monkeypatch.setattr(bm25, "CELLS", cells)
    ts = ["x y", None, "x", "", "z z y", "x", "w", "x", "y x x y"] * 3
    base = texts(spark, *ts).withColumn("no", F.when(F.col("id") % 5 > 0, F.col("id") % 7)).withColumn("score", F.lit("clash"))
    q = spark.createDataFrame([(7, "x y x"), (8, "z"), (9, None), (10, "-"), (11, "nowhere"), (12, "X, y!"), (None, "y")], "query_id long, question string")
    get = lambda df: sorted(((r["query_id"], r["no"], r["id"], round(r["score"], 8), r["rk"]) for r in df.collect()), key=repr)
    want = get(bm25.search(q, bm25.build_postings(base, ["no", "id"]), "query_id", ["no", "id"], 4))
    got = get(bm25.search_texts(q, base.coalesce(1), "query_id", ["no", "id"], 4, per_pass=per_pass))
    assert got == want and len(want) == 15
    assert bm25.search_texts(q.limit(0), base, "query_id", ["id"]).count() == 0 == bm25.search_texts(q, base.limit(0), "query_id", ["id"]).count()


def test_a_zero_query_brings_k_rows_and_keys_may_be_strings(spark):
    base = spark.createDataFrame([(f"c{i:03d}", [float(i % 3), 1.0]) for i in range(300)], "key string, v array<double>")
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "qid long, v array<double>")
    raw = vector.cosines(q, base.coalesce(1), "qid", "key", 4)
    assert raw.filter("qid = 1").count() == 4
    got = vector.nearest(q, base, "qid", "key", 4).orderBy("qid", "rk").collect()
    assert [r["key"] for r in got] == ["c000", "c001", "c002", "c003", "c002", "c005", "c008", "c011"]


def test_bm25_ties_go_by_position_and_k_cuts(spark):
    assert [i for i, _ in ask(spark, "x", "x", "x", "x", k=2)] == [0, 1]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [50.0, 0.0])], "id long, v array<float>")
    unit = {r["id"]: r["v"] for r in vector.unit_vectors(df, "id", "v").collect()}
    assert unit[1] == pytest.approx([0.6, 0.8]) and unit[2] == [0.0, 0.0] and 3 not in unit
    q = spark.createDataFrame([(9, [1.0, 0.0])], "qid long, v array<double>")
    near = vector.nearest(q, vector.unit_vectors(df, "id", "v"), "qid", "id", 2)
    assert [(r["id"], r["score"]) for r in near.orderBy("rk").collect()] == [(4, 1.0), (1, 0.6)]
    none = vector.support_score(near.filter("id > 99"), q, "qid").first()
    assert none["support"] == 0.0


def test_fusion(spark):
    rows = [(1, 0, 1, "a"), (1, 0, 2, "both"), (1, 1, 1, "b"), (1, 1, 2, "both")]
    df = spark.createDataFrame(rows, "q long, ranking_no int, rank int, c string")
    got = [(r["c"], r["rrf"]) for r in fusion.reciprocal_rank_fusion(df, "q", "c").orderBy("rk").collect()]
    assert [c for c, _ in got] == ["both", "a", "b"] and math.isclose(got[0][1], 2 / 62, abs_tol=1e-9)
    assert fusion.reciprocal_rank_fusion(df.limit(0), "q", "c").count() == 0


def chunk_rows(spark):
    rows = [(1, "24", "2", None, "two"), (2, "24", None, "I", "whole"), (3, "24", "1", "SCHEDULE", "schedule"), (4, "24", "1", None, "one"), (5, "2.4", None, None, "other"), (6, "24", "x", None, "odd")]
    return spark.createDataFrame(rows, "id long, section string, subsection string, part string, text string")


def test_structured_lookup_keeps_null_parts_and_puts_the_named_first(spark):
    parsed = spark.createDataFrame([(1, "24", None), (2, "24", "2"), (3, "999", None)], "q long, section string, subsection string")
    got = {}
    for r in fusion.structured_lookup(parsed, chunk_rows(spark), "q", ["id"]).orderBy("q", "rk").collect():
        got.setdefault(r["q"], []).append(r["id"])
    assert got == {1: [2, 4, 1, 6], 2: [1, 2, 4, 6]}


def test_structured_lookup_cut_at_k_equals_its_first_rows(spark):
    rows = [(i, "24", [None, "1", "2", "x"][i % 4], None, "t") for i in range(40)]
    chunks = spark.createDataFrame(rows, "id long, section string, subsection string, part string, text string")
    parsed = spark.createDataFrame([(1, "24", None), (2, "24", "2"), (3, "24", "9"), (4, "24", "x")], "q long, section string, subsection string")
    key = lambda df: sorted((r["q"], r["rk"], r["id"]) for r in df.collect())
    for k in (1, 3, 12, 50):
        whole = [x for x in key(fusion.structured_lookup(parsed, chunks, "q", ["id"])) if x[1] <= k]
        assert key(fusion.structured_lookup(parsed, chunks, "q", ["id"], k)) == whole


def test_hybrid_prefers_structured_and_keeps_each_once(spark):
    s = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q long, c string, rk int")
    f = spark.createDataFrame([(1, "y", 1), (1, "z", 2), (2, "z", 1)], "q long, c string, rk int")
    got = [(r["q"], r["c"], r["source"]) for r in fusion.hybrid(s, f, "q", "c", 2).orderBy("q", "rk").collect()]
    assert got == [(1, "x", "structured"), (1, "y", "structured"), (2, "z", "fusion")]


def test_audit(spark):
    answers = spark.createDataFrame([(1, "s. 24(2), s. 24(9), s. 300, s. 45 and s. 2.4"), (2, "I cannot say."), (3, None)], "a long, text string")
    held = spark.createDataFrame([(1, "24", "2", "as in 300 and 2x4"), (1, "24", None, "more")], "a long, section string, subsection string, text string")
    audited = grounding.audit_citations(grounding.extract_citations(answers, ["a"]), held, ["a"])
    got = {r["label"]: r["status"] for r in audited.collect()}
    assert got == {"s. 24(2)": "grounded", "s. 24(9)": "unsupported", "s. 300": "cross_referenced", "s. 45": "unsupported", "s. 2.4": "unsupported"}
    row = grounding.warnings(grounding.audit_lists(audited, ["a"])).first()
    assert row["unsupported"] == "s. 2.4, s. 24(9), s. 45" and row["warning"].endswith("s. 45") and row["note"].endswith("s. 300")
    assert {r["a"]: r["declined"] for r in grounding.refusals(answers, ["a"]).collect()} == {1: False, 2: True, 3: True}


def test_metrics(spark):
    cases = spark.createDataFrame([(1, "p"), (2, "p"), (3, None)], "case_id long, category string")
    expected = spark.createDataFrame([(1, 0, "A", None), (1, 1, "B", "term"), (2, 0, "C", None)], "case_id long, exp_no int, citation string, term string")
    got = spark.createDataFrame([(1, 2, "A", None), (1, 1, "B", "else"), (1, 4, "B", "term"), (2, 9, "C", None)], "case_id long, rk int, citation string, heading string")
    ranks = evaluation.expectation_ranks(expected, got)
    assert {(r["case_id"], r["exp_no"]): r["rank"] for r in ranks.collect()} == {(1, 0): 2, (1, 1): 4, (2, 0): 9}
    m = {r["case_id"]: r for r in evaluation.case_metrics(cases, ranks).collect()}
    assert (m[1]["hit1"], m[1]["hit3"], m[1]["coverage3"], m[1]["coverage5"], m[1]["rr"]) == (0.0, 1.0, 0.5, 1.0, 0.5)
    assert (m[2]["hit5"], m[3]["rr"], m[3]["coverage5"]) == (0.0, 0.0, 0.0)
    summary = evaluation.summarise(evaluation.case_metrics(cases, ranks))
    total = summary.filter("is_total = 1").collect()
    assert len(total) == 1 and total[0]["n"] == 3 and summary.filter("is_total = 0").count() == 2
    assert "OVERALL" in evaluation.report(summary)
    assert evaluation.summarise(evaluation.case_metrics(cases.limit(0), ranks)).count() == 0


def test_upper_median_is_an_order_statistic(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (4, 1, 3, 2)], "grp string, support double")
    row = evaluation.support_distribution(df).first()
    assert (row["min_s"], row["upper_median_s"], row["max_s"]) == (1.0, 3.0, 4.0)


def test_question_to_audited_answer(spark):
    rows = [(1, "The board may issue shares.", "24", "1", None, None, [1]), (2, "A director shall act honestly.", "122", "1", "Duty", "I", [2])]
    keyed = pipelines.with_text(spark.createDataFrame(rows, "id long, text string, section string, subsection string, heading string, part string, pages array<int>"))
    questions = spark.createDataFrame([(5, "what does section 122 ask of a director?")], "query_id long, question string")
    got = pipelines.retrieve(questions, keyed, None, "query_id")
    assert got.orderBy("rk").first()["source"] == "structured"
    generate = lambda p: p.select("query_id", F.lit("Honesty, s. 122(1); see s. 999.").alias("text"))
    answer = pipelines.answer(questions, keyed, got, generate, "query_id").first()
    assert answer["grounded"] == "s. 122(1)" and answer["unsupported"] == "s. 999"


def test_embedding_batches_keep_rows(spark):
    sizes = []

    def embed(ts):
        sizes.append(len(ts))
        return providers.hashing_embedder(8)(ts)

    assert embed(["a b", "a b", ""]).tolist()[0] == embed(["a b"]).tolist()[0]
    df = spark.createDataFrame([(i, f"text {i}") for i in range(250)], "i int, t string").repartition(1)
    rows = providers.embed_column(df, "t", providers.hashing_embedder(8), batch=100).collect()
    want = providers.hashing_embedder(8)([r["t"] for r in rows])
    assert [r["embedding"] for r in rows] == want.tolist()
