import random
import re

import pytest

from lexspark.llm import pieces

SCHEMA = "doc_id long, chunk_seq long, text string, section string, subsection string, piece_no int"


def marked(text):
    """The boundaries marked by ``|`` and the text without the marks."""
    out, at = [], 0
    for part in text.split("|")[:-1]:
        at += len(part)
        out.append(at)
    return text.replace("|", ""), out


@pytest.mark.parametrize(
    "text",
    [
        "A director acts. |The board meets! |Does it? |(2.1) It does.",
        "See s. 292 and No. 81 of Phinene Timber Corp. v. Relgal Mills Inc. on the debt. |Voir art. 67 et no. 12 de X Ltd. c. Y Inc. sur un acte. |Le R.S.N. 2013, c. 86 vaut.",
        "either |(a) file described in paragraph (a) or subsection (5); |(b) keep: |(i) one, |(ii) two (3), |(iv) last; and |(c) end",
        "Paragraphs (a) to (c) and subparagraph (d)(ii) apply. |Despite paragraph 81(b), it may.",
        "Heading\n|(1) First.\n\n|  not here but the start of the line".replace("|  ", "  |"),
        "Les alinéas (a) à (c) et le sous-alinéa (d)(ii) s'appliquent. |« Oui » dit-il. |À la reprise.",
        "",
        "no boundary at all",
    ],
)
def test_natural_boundaries(text):
    plain, want = marked(text)
    assert pieces.natural_boundaries(plain) == want


def whole(text, limit=1200, least=400, overlap=200):
    bounds = pieces.natural_boundaries(text)
    words = [m.start() for m in re.finditer(r"(?<=\s)\S", text)]
    out, start = [], 0
    while len(text) - start > limit:
        end = max((b for b in bounds if start + least <= b <= start + limit), default=None) or max((w for w in words if start + least <= w <= start + limit), default=None) or start + limit
        out.append((start, end))
        begin = [b for b in bounds if end - overlap <= b < end] or [w for w in words if end - overlap <= w < end] or [end - overlap]
        start = begin[0]
    return [*out, (start, len(text))]


def texts():
    rng = random.Random(4)
    parts = ["The board may act. ", "Voir art. 67 et no. 12. ", "é" * 40 + " ", "(a) file it; ", "\n(2) Next line. ", "x" * 700, "/" * 1300, "mot " * 30, "𝔘nicode stays whole. "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(20, 160))) for _ in range(25)]


@pytest.mark.parametrize("range_bytes", [pieces.RANGE_BYTES, 1500])
def test_ranges_give_what_the_whole_text_gives(spark, range_bytes):
    ts = texts()
    df = spark.createDataFrame([(i, None, t, "1", None, 3) for i, t in enumerate(ts)], SCHEMA)
    got = {}
    for r in pieces.split_oversized(df, range_bytes=range_bytes).orderBy("doc_id", "piece_no").collect():
        got.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"]))
    assert got == {i: whole(t) for i, t in enumerate(ts) if len(t) > 1200}


@pytest.mark.parametrize("range_bytes", [pieces.RANGE_BYTES, 700, 5000])
def test_files_are_cut_by_offset(spark, tmp_path, range_bytes):
    ts = [*texts()[:6], "short", "é" * 900, "one (a) two" + " " * 3000 + "(b) three. " + "word " * 600]
    for i, t in enumerate(ts):
        (tmp_path / f"{i}.txt").write_bytes(t.encode())
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    got = {}
    for r in pieces.split_files(files, range_bytes=range_bytes).orderBy("path", "piece_no").collect():
        got.setdefault(int(r["path"].rsplit("/", 1)[1][:-4]), []).append((r["piece_no"], r["start_pos"], r["end_pos"]))
    assert got == {i: [(n, *p) for n, p in enumerate(whole(t), 1)] for i, t in enumerate(ts) if len(t) > 1200}


def test_white_space_before_a_label_hides_nothing(spark):
    lead = "He may act under paragraph" + " " * 2000
    t = "x " * 300 + lead + "(a) of the Act. " + "word " * 400
    assert t.index("(a)") not in pieces.natural_boundaries(t)
    df = spark.createDataFrame([(1, 1, t, None, None, 0)], SCHEMA)
    for range_bytes in (900, 2000, 2600):
        got = [(r["start_pos"], r["end_pos"]) for r in pieces.split_oversized(df, range_bytes=range_bytes).orderBy("piece_no").collect()]
        assert got == whole(t)


def test_edges(spark):
    rows = [(1, 1, None, "a", "b", 0), (1, 2, "", "a", "b", 0), (1, 3, "x" * 1200, "a", "b", 0), (1, 4, "y" * 1201, "4", None, 0), (1, 4, "y" * 1201, "4", None, 0), (None, 5, "z " * 700, None, "2", 0), (2, 6, "w" * 1_000_000, "9", "1", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = pieces.split_oversized(df)
    assert {(r["doc_id"], r["chunk_seq"]) for r in got.collect()} == {(1, 4), (None, 5), (2, 6)}
    assert [tuple(r)[2:] for r in got.filter("chunk_seq = 4").orderBy("piece_no").collect()] == [(1, 0, 1200), (2, 1000, 1201)]
    assert got.filter("chunk_seq = 6").count() == len(whole("w" * 1_000_000))
    cut = {(r["chunk_seq"], r["piece_no"]): r for r in pieces.cut_text(df, got).collect()}
    assert cut[4, 2]["text"] == "y" * 201 and cut[4, 1]["section"] == "4" and cut[5, 1]["subsection"] == "2"
    assert pieces.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.split_oversized(df, least=100)
