import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexspark.llm import repeats

LINE = "doc_id long, seq long, text string, source string, medium string"
META = "doc_id long, source string, medium string, text string"


def key(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["k"] for r in df.select("i", repeats.invariant_text(F.col("t")).alias("k")).orderBy("i").collect()]


def test_invariant_text(spark):
    same = [
        ["By Phidas Mivake, July 25, 2015", "* BY GALMI  PHIRELOR, MARCH 14, 2020.", "by domidas tororphi, november 4, 2018"],
        ["Galne Umqui | 10 June 2022 | 4 min read.", "» KERELBRI PHIDOSA | 15 JULY 2016 | 12 MIN READ"],
        ["Reporting by Torva Zeran; editing by Lo Mi", "• reporting  by ran ze; editing by um do"],
        ["Shared 484 times - tell a colleague", "> shared 7 times – tell a colleague!"],
        ["Consolidation current to 7 February 2018 (Valo edition)", "CONSOLIDATION CURRENT TO 15 DECEMBER 2019 (VALO EDITION)"],
        ["Par Anne Roy, 3 août 2020", "par luc petit, 14 mai 2019"],
    ]
    for group in same:
        assert len(set(key(spark, *group))) == 1, key(spark, *group)
    assert len(set(key(spark, "Share this article", "Print this page", "Back to top"))) == 3
    assert key(spark, None, "", " -- ") == [None, "", ""]


def test_chunks_depend_on_content_only():
    a, b = "thispageisgeneralinformationandnotlegaladvice", "subscribetoournewsletterfreeofchargeandgetallthenews"
    alone = repeats.chunk_hashes(pa.array([a, b])).to_pylist()
    mixed = repeats.chunk_hashes(pa.array(["x", None, b, "", a])).to_pylist()
    assert mixed[4] == alone[0] and mixed[2] == alone[1] and mixed[1] == mixed[3] == []
    assert len(alone[1]) > 1 and repeats.chunk_hashes(pa.array([], pa.string())).to_pylist() == []
    long = repeats.chunk_hashes(pa.array([a + b * 2000])).to_pylist()[0]
    assert len(set(long)) < len(long) / 100  # the repeated part is cut alike each time


def site(spark, extra=()):
    rows, meta = [], []
    for d in range(8):
        meta.append((d, "s1", "web", "clash"))
        rows += [(d, 0, f"By Name{'abcdefgh'[d]}a Last{'abcdefgh'[d]}b, May {d + 1}, 2020", "s1", "x"), (d, 1, f"body {'abcdefgh'[d]} of its own", "s1", "x"), (d, 1, f"body {'abcdefgh'[d]} of its own", "s1", "x")]
        if d < 2:
            rows.append((d, 2, "In two documents only", "s1", "x"))
        if d < 3:
            rows.append((d, 3, "In three documents", "s1", "x"))
    for d in range(8, 30):
        meta.append((d, "s2", "web", None))
        rows += [(d, 0, None, "s2", None), (d, 1, "", "s2", None), (d, 2, "in four of twenty-two" if d < 12 else f"own {'abcdefghijklmnopqrstuvwxyzABCD'[d]} text", "s2", None)]
    meta += [(40, "s1", "scan", None), (41, None, "web", None), (42, None, "web", None), (43, None, "web", None), (44, "s1", None, None)]
    rows += [(d, 0, "In three documents", None, None) for d in (40, 41, 42, 43, 44)]
    return spark.createDataFrame(rows + list(extra), LINE), spark.createDataFrame(meta, META)


def found(lines, meta):
    return {tuple(r) for r in repeats.find_repeated_lines(lines, meta).collect()}


def test_found_equals_counting_by_hand(spark):
    lines, meta = site(spark)
    assert found(lines, meta) == {(d, 0) for d in range(8)} | {(d, 3) for d in range(3)}


def test_cut_documents(spark):
    lines, meta = site(spark)
    out = {r["doc_id"]: r for r in repeats.cut_repeated_lines(lines, meta).collect()}
    assert (out[0]["n_lines"], out[0]["n_cut"], out[0]["text"]) == (4, 2, "body a of its own\nIn two documents only")
    assert out[12]["n_cut"] == 0 and len(out) == 35


NOTICE = "This page is general information from the registry and is no legal advice; please ask a lawyer before you rely on any of it in a proceeding, and read the terms of use that are set out below. "
NOTICE += "Copies of the register are made every night, so a filing of today may be missing here until tomorrow morning; certified copies are issued at the counter of the registry office against payment of the fee that the schedule fixes for them."


def wrapped(text, width):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            out.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return [*out, line]


def test_a_notice_wrapped_at_different_places_is_cut(spark):
    rows = []
    for d in range(8):
        own = [f"{'abcdefgh'[d]}{i} {'stuvwxyz'[d]} the board met {d * 7 + i} persons of {'klmnopqr'[d]}{'hgfedcba'[d]}" for i in range(6)]
        rows += [(d, i, t, "s1", None) for i, t in enumerate([*own[:3], *wrapped(NOTICE, 30 + 5 * d), *own[3:]])]
    lines = spark.createDataFrame(rows, LINE)
    meta = spark.createDataFrame([(d, "s1", "web", None) for d in range(8)], META)
    assert not [r for r in found(lines, meta) if r[0] == 3]  # no line of it stands in another document
    for r in repeats.cut_repeated_lines(lines, meta).collect():
        left = sum(w in r["text"] for w in ("general information", "legal advice", "lawyer", "proceeding", "terms of use"))
        assert r["n_chars_cut"] > len(NOTICE) / 2 and left <= 3 and r["text"].count("persons") == 6
    assert repeats.cut_repeated_lines(lines.limit(0), meta).count() == 0


def test_passages_map_back_to_their_texts():
    import numpy as np

    texts = ["Ab, c 12,5 x", "", "é—ö 9th!", "12 12 12"]
    text, low, high, chunk, length = repeats.passage_chunks(np.array([1, 1, 1, 2]), texts)
    assert sorted(set(text.tolist())) == [0, 2, 3] and (low < high).all()
    assert (text[0], low[0]) == (0, 0) and max(high[text == 2]) == 7 and max(high[text == 3]) == 7
    assert [len(x) for x in repeats.passage_chunks(np.array([]), [])] == [0] * 5


def test_empty_tables_and_very_long_lines(spark):
    lines, meta = site(spark)
    assert found(lines.limit(0), meta) == set() and found(lines, meta.limit(0)) == set()
    long = [(d, 9, "word " * 50_000 + str(d), "s1", None) for d in range(8)]
    assert {(d, 9) for d in range(8)} <= found(*site(spark, long))


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_against_a_count_of_whole_lines(spark, sf):
    d = f"/root/testdata/{sf}"
    lines, meta = spark.read.parquet(f"{d}/lines.parquet"), spark.read.parquet(f"{d}/documents_meta.parquet")
    pages = {r["doc_id"]: r["source"] for r in meta.filter("medium = 'web'").collect()}
    rows = lines.select("doc_id", "seq", repeats.invariant_text(F.col("text")).alias("k")).distinct().collect()
    docs, size = {}, {}
    for s in pages.values():
        size[s] = size.get(s, 0) + 1
    for r in rows:
        if r["doc_id"] in pages and re.search(r"\w", r["k"] or ""):
            docs.setdefault((pages[r["doc_id"]], r["k"]), set()).add(r["doc_id"])
    want = {(r["doc_id"], r["seq"]) for r in rows if r["doc_id"] in pages and len(ds := docs.get((pages[r["doc_id"]], r["k"]), ())) >= 3 and len(ds) >= size[pages[r["doc_id"]]] / 4}
    assert found(lines, meta) == want
