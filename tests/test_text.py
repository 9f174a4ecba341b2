from pyspark.sql import functions as F

from lexspark.functions import text as T


def one(spark, column, schema, *row):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


def test_tokens_keep_digits_and_compounds(spark):
    t = T.tokenize(F.col("t"))
    assert one(spark, t, "t string", "Shares of a Corporation.") == ["shares", "of", "a", "corporation"]
    assert one(spark, t, "t string", "subject to the by-laws") == ["subject", "to", "the", "by-laws"]
    assert one(spark, t, "t string", "(a) ... ;") == ["a"]
    assert one(spark, t, "t string", "s. 2.1") == ["s", "2", "1"]
    assert one(spark, t, "t string", None) == []
    assert one(spark, t, "t string", "") == []


def test_citation_labels(spark):
    c = T.citation(F.col("a"), F.col("b"), F.col("p"))
    schema = "a string, b string, p string"
    assert one(spark, c, schema, "24", "1", None) == "s. 24(1)"
    assert one(spark, c, schema, "24", None, "I") == "s. 24"
    assert one(spark, c, schema, "1", None, "SCHEDULE") == "Schedule, item 1"
    assert one(spark, c, schema, None, None, "SCHEDULE") == "Schedule"
    assert one(spark, c, schema, None, None, None) == "(uncited)"


def test_queried_provision(spark):
    both = F.struct(T.queried_section(F.col("q")), T.queried_subsection(F.col("q")))
    ask = lambda q: tuple(one(spark, both, "q string", q))
    assert ask("what does section 122 say?") == ("122", None)
    assert ask("explain subsection 190(1)") == ("190", "1")
    assert ask("S. 146 please") == ("146", None)
    assert ask("section 2.1") == ("2.1", None)
    assert ask("s. 122(1)") == ("122", None)
    assert ask("which section applies?") == (None, None)
    assert ask(None) == (None, None)


def test_subsection_order(spark):
    o = T.subsection_order(F.col("s"))
    assert [one(spark, o, "s string", s) for s in (None, "", "3", "2.1", "x")] == [0, 0, 3, 999, 999]


def test_headings(spark):
    h = T.is_heading(F.col("t"))
    for t, want in (("Issue of shares", True), ("A director shall act honestly.", False), ("shares issued;", False), ("24 (1) A person", False), ("", True), ("x" * 71, False)):
        assert one(spark, h, "t string", t) is want, t


def test_cited_provisions_are_distinct_and_case_sensitive(spark):
    c = T.cited_provisions(F.col("t"))
    rows = one(spark, c, "t string", "See s. 45(2), s. 45(2) and s. 300. S. 9 and section 86 are not cited.")
    assert [(r["section"], r["subsection"]) for r in rows] == [("45", "2"), ("300", None)]


def test_value_key_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", None)], "x string, y string")
    assert df.select(T.value_key("x", "y").alias("k")).distinct().count() == 2
