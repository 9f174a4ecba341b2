from lexspark.operators import cleanup, layout
from lexspark.plans import pipelines

LINE = "doc_id long, seq long, page int, block int, x0 double, y0 double, text string"
PAGE = "doc_id long, page_width double, page_height double"


def lines(spark, xs, doc=1):
    return spark.createDataFrame([(doc, i, 0, 0, float(x), float(i), f"t{i}") for i, x in enumerate(xs)], LINE)


def detect(spark, xs):
    return layout.detect_layout(lines(spark, xs), spark.createDataFrame([(1, 612.0, 792.0)], PAGE)).first()


def test_two_margins_and_jitter(spark):
    assert tuple(detect(spark, [48] * 50 + [318] * 50 + [75, 500]))[1:3] == (48.0, 318.0)
    assert detect(spark, [47.6, 48.0, 48.4] * 20 + [318] * 50)["left_margin"] == 48.0


def test_bad_layouts_have_a_status(spark):
    assert detect(spark, [108] * 100 + [350 + 5 * i for i in range(30)])["status"] == "a margin is not a column"
    assert detect(spark, [300] * 50 + [330] * 50)["status"] == "the margins are indent levels"
    assert detect(spark, [72] * 100)["status"] == "one half is empty"


def test_column_boundary_is_right_and_order_is_stable(spark):
    pages = spark.createDataFrame([(1, 612.0, 792.0)], PAGE)
    rows = lines(spark, [48] * 20 + [318] * 20 + [182.9, 183.0])
    sided = layout.reading_order(layout.assign_columns(rows, layout.detect_layout(rows, pages)))
    sides = {r["seq"]: r["side"] for r in sided.collect()}
    assert (sides[40], sides[41]) == ("left", "right")
    texts = {r["side"]: r["text"] for r in layout.column_text(sided).collect()}
    assert texts["left"].split("\n")[:2] == ["t0", "t1"]


def test_dehyphenation(spark):
    cases = [
        (["the Business Corpo-", "rations Act"], [], "the Business Corporations Act"),
        (["subject to the by-", "laws of the"], ["by-laws"], "subject to the by-laws of the"),
        (["shares of a", "corporation"], [], "shares of a corporation"),
        (["the Governor-", "General acts"], [], "the Governor- General acts"),
        (["shares", "  ", "issued"], [], "shares issued"),
        ([], [], ""),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, texts array<string>, vocabulary array<string>")
    got = {r["i"]: r["t"] for r in df.select("i", cleanup.joined_lines("texts", "vocabulary").alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, _, w in cases]


def page(n, doc=1, header="STATUTE OF X", body=3):
    rows = [(45.1, header), (49.2, f"sub {header}")] + [(100 + 11.5 * i, f"body {n} {i}") for i in range(body)] + [(758.9, "footer")]
    return [(doc, n * 100 + i, n, i, 48.0, y, t) for i, (y, t) in enumerate(rows)]


def test_headers_fall_with_their_island_and_body_stays(spark):
    rows = spark.createDataFrame([r for n in range(10) for r in page(n)], LINE)
    pages = spark.createDataFrame([(1, 612.0, 792.0)], PAGE)
    kept = cleanup.strip_headers(cleanup.mark_headers(rows, pages)).collect()
    assert {r["text"].split()[0] for r in kept} == {"body"} and len(kept) == 30
    assert {r["status"] for r in kept} == {"ok"}


def test_islands_equal_growth_from_the_seed(spark):
    import random

    rng = random.Random(3)
    rows, want = [], {}
    for doc in range(60):
        ys = sorted(rng.uniform(0, 300) for _ in range(rng.randint(1, 14)))
        seeds = {i for i in range(len(ys)) if rng.random() < 0.2 and ys[i] < 0.15 * 792}
        rows += [(doc, i, 0, 0, 48.0, y, "SEED" if i in seeds else f"{doc} {i}") for i, y in enumerate(ys)]
        rows += [(doc, 1000, 1, 0, 48.0, 400.0, "SEED")] if seeds else [(doc, 1000, 1, 0, 48.0, 400.0, "x")]
        rows += [(doc, 1001 + p, 1 + p, 0, 48.0, 700.0 - 300, f"filler {doc} {p}") for p in range(1, 6)]
        drop = set()
        for s in seeds:
            for step in (1, -1):
                i = s
                drop.add(i)
                while 0 <= i + step < len(ys) and abs(ys[i + step] - ys[i]) <= 20:
                    i += step
                    drop.add(i)
        want[doc] = drop
    df = spark.createDataFrame(rows, LINE)
    pages = spark.createDataFrame([(d, 612.0, 792.0) for d in range(60)], PAGE)
    got = {d: set() for d in range(60)}
    for r in cleanup.mark_headers(df, pages, share=0.2).filter("is_header AND page = 0").collect():
        got[r["doc_id"]].add(r["seq"])
    assert got == want


def test_front_matter(spark):
    rows = [(1, p * 100 + i, p, i, 48.0, float(i), t) for p in range(20) for i, t in enumerate(["3", "Head", "7", "Other"] if p < 3 else ["prose", "goes", "on", "here"])]
    assert cleanup.front_matter(spark.createDataFrame(rows, LINE)).first()["last_page"] == 2
    late = [(1, p * 100 + i, p, i, 48.0, float(i), "9" if p == 18 else "prose") for p in range(20) for i in range(4)]
    assert cleanup.front_matter(spark.createDataFrame(late, LINE)).count() == 0


def test_paragraphs_repair_words_and_empty_input(spark):
    pages = spark.createDataFrame([(1, 612.0, 792.0)], PAGE)
    rows = [r for n in range(10) for r in page(n)]
    rows += [(1, 5000, 11, 0, 48.0, 300.0, "the corpo-"), (1, 5001, 11, 0, 48.0, 311.0, "ration")]
    got = [r["text"] for r in cleanup.to_paragraphs(spark.createDataFrame(rows, LINE), pages).collect()]
    assert "the corporation" in got and not any("STATUTE" in t for t in got)
    assert cleanup.to_paragraphs(spark.createDataFrame([], LINE), pages).count() == 0


def test_bad_documents_keep_every_line_and_have_a_status(spark):
    good = [r for n in range(10) for r in page(n)]
    deep = [(2, n * 100 + i, n, i, 48.0, 45.0 + 10 * i, f"deep {i}" if n else f"other {i}") for n in range(10) for i in range(9)]  # a margin block of 9 lines
    unsized = [r for n in range(10) for r in page(n, doc=3)] + [r for n in range(10) for r in page(n, doc=4)]  # null, and not in the table
    bare = [r for n in range(10) for r in page(n, doc=5, body=0)]  # headers and nothing else
    rows = spark.createDataFrame(good + deep + unsized + bare, LINE)
    pages = spark.createDataFrame([(1, 612.0, 792.0), (2, 612.0, 792.0), (3, None, None), (5, 612.0, 792.0)], PAGE)
    got = cleanup.to_paragraphs(rows, pages).collect()
    want = {1: ("ok", 30), 2: (cleanup.INTO_BODY, 90), 3: (cleanup.NO_PAGE_SIZE, 60), 4: (cleanup.NO_PAGE_SIZE, 60), 5: (cleanup.NOTHING_LEFT, 30)}
    assert {d: ({r["status"] for r in got if r["doc_id"] == d}, sum(r["doc_id"] == d for r in got)) for d in want} == {d: ({s}, n) for d, (s, n) in want.items()}
    kept = cleanup.strip_headers(cleanup.mark_headers(rows, pages)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in kept if r["doc_id"] < 5} == {d: n for d, (_, n) in want.items() if d < 5}
    assert {r["doc_id"]: r["status"] for r in layout.detect_layout(rows, pages).collect()} == dict.fromkeys((1, 2, 5), "one half is empty") | dict.fromkeys((3, 4), "no page size")


def test_no_document_is_lost_on_the_way_to_chunks(spark):
    two = [(1, i, 0, i, 48.0 if i % 2 else 318.0, 300.0 + i, f"{i} A company must keep records.") for i in range(40)]
    rows = spark.createDataFrame(two + [r for n in range(3) for r in page(n, doc=2)] + [r for n in range(3) for r in page(n, doc=3)], LINE)
    pages = spark.createDataFrame([(1, 612.0, 792.0), (2, 612.0, 792.0), (3, None, 792.0)], PAGE)
    got = {r["doc_id"]: (r["status"], r["chunk_seq"] is not None) for r in pipelines.build_chunks(rows, pages).collect()}
    assert got == {1: ("ok", True), 2: ("one half is empty", False), 3: ("no page size", False)}
    assert pipelines.with_text(pipelines.build_chunks(rows, pages)).filter("text IS NULL").count() == 0
