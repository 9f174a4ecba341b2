import random
import re

from pyspark.sql import functions as F

from lexspark.operators import chunking

PARA = "doc_id long, para_seq long, page int, block int, text string"


def chunks(spark, texts, pages=None):
    rows = [(1, i, (pages or [1] * len(texts))[i], 0, t) for i, t in enumerate(texts)]
    return chunking.chunk_paragraphs(spark.createDataFrame(rows, PARA)).orderBy("chunk_seq").collect()


def test_sections_and_headings(spark):
    got = chunks(spark, ["An Act about companies.", "24 (1) A person may act.", "Issue of shares", "(2) A person shall not.", "25 The register is kept."])
    assert [c["citation"] for c in got] == ["s. 24(1)", "s. 24(2)", "s. 25"]
    assert got[0]["heading"] is None and got[1]["heading"] == "Issue of shares"
    assert got[1]["text"].startswith("Issue of shares\n(2)")


def test_part_schedule_history_repealed_and_end_matter(spark):
    got = chunks(spark, ["PART V", "24 (1) A person may act.", "R.S., 1985, c. 1", "(3) and (4) [Repealed, 2001, c. 14]", "24 [Repealed, 2001]", "SCHEDULE", "1 The following Acts", "RELATED PROVISIONS", "9 Not in force"])
    assert [(c["citation"], c["part"]) for c in got] == [("s. 24(1)", "V"), ("Schedule, item 1", "SCHEDULE")]


def test_definitions(spark):
    got = chunks(spark, ["2 (1) In this Act,", "affiliate means a body corporate", "agent includes a clerk", "(2) Nothing here means anything", "lamp means a light"])
    assert [c["heading"] for c in got] == [None, "affiliate", "agent", None]
    assert {c["citation"] for c in got[:3]} == {"s. 2(1)"} and got[1]["text"] == "affiliate means a body corporate"
    assert got[3]["text"].startswith("(2)")


def merge_in_order(paras):
    out = []
    for page, text in paras:
        if out and page == out[-1][0] + 1 and not re.search(r"[.;:!?]$", out[-1][1]) and text[:1].islower() and not re.match(r"\(([a-z]+)\)\s+\S", text):
            out[-1] = (out[-1][0], out[-1][1] + " " + text)
        else:
            out.append((page, text))
    return out


def test_merge_page_breaks_equals_the_sequential_reading(spark):
    rng = random.Random(11)
    docs = []
    for _ in range(300):
        page, paras = 1, []
        for _ in range(rng.randint(1, 9)):
            page += rng.choice([0, 0, 1, 1, 2])
            paras.append((page, rng.choice(["and goes on", "Ends here.", "Starts but", "more;", "(a) item", "in lower"])))
        docs.append(paras)
    rows = [(d, i, p, 0, t) for d, ps in enumerate(docs) for i, (p, t) in enumerate(ps)]
    got = {}
    for r in chunking.merge_page_breaks(spark.createDataFrame(rows, PARA)).orderBy("doc_id", "para_seq").collect():
        got.setdefault(r["doc_id"], []).append((r["page"], r["text"]))
    assert got == {d: merge_in_order(ps) for d, ps in enumerate(docs)}


def split_in_order(text, limit):
    if len(text) <= limit:
        return [text]
    parts = re.split(r"(?=\([a-z]+(?:\.\d+)?\)\s)", text)
    stem, items = parts[0].strip(), [p.strip() for p in parts[1:] if p.strip()]
    if not items:
        return [text]
    out, open_, n = [], [], len(stem)
    for item in items:
        if open_ and n + len(item) > limit:
            out.append(" ".join([stem, *open_]))
            open_, n = [], len(stem)
        open_.append(item)
        n += len(item)
    return [*out, " ".join([stem, *open_])]


def test_split_items_equals_the_sequential_reading(spark):
    rng = random.Random(5)
    texts = ["", "short", "(a) starts with an item (b) and more " + "x" * 60, "y" * 200]
    for _ in range(100):
        items = [f"({c}) " + "word " * rng.randint(1, 12) for c in "abcdefgh"[: rng.randint(0, 8)]]
        texts.append(rng.choice(["A director may ", "", "Stem of the list "]) + "".join(items))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["p"] for r in df.select("i", chunking.split_items(F.col("text"), 80).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == split_in_order(t, 80), t


def test_null_and_empty_input(spark):
    assert chunking.chunk_paragraphs(spark.createDataFrame([], PARA)).count() == 0
    assert chunks(spark, ["", "only a body text without any section in it that goes on for longer than a heading may do."]) == []
