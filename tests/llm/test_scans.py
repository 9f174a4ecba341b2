import random

from lexspark.llm import scans

LINE = "doc_id long, seq long, page int, block int, x0 double, y0 double, text string, source string"
PARA = "doc_id long, para_seq long, page int, block int, text string, source string"
META = "doc_id long, page_height double, medium string, source string"
BODY = "the director may register the certificate at the registered office and the trustee must not amend the debt obligations of the company in good faith"


def tables(spark, extra_lines=(), extra_paras=()):
    rng = random.Random(1)
    words = BODY.split()
    lines = [(9, i, i // 20, 1, 70.0, 90.0 + 15 * (i % 20), " ".join(words[k % len(words)] for k in range(s, s + 8)), "s") for i in range(2400) for s in [rng.randrange(len(words))]]
    lines += [(9, 5000 + i, 200, 1, 70.0, 90.0 + i * 5, "holders of non-voting shares and by-laws", "s") for i in range(60)]
    paras = [(8, i, i, 0, " ".join([BODY, BODY.capitalize() + "."]) + " ", "s") for i in range(40)]
    meta = [(9, 792.0, "scan", "x"), (8, None, "scan", "x"), (1, 792.0, "scan", "x"), (2, 0.0, "scan", "x"), (3, 792.0, "web", "x")]
    return spark.createDataFrame(lines + list(extra_lines), LINE), spark.createDataFrame(paras + list(extra_paras), PARA), spark.createDataFrame(meta, META)


def test_lines(spark):
    page = [
        (45.1, "7   Trusts Act of Ostrel"), (90.0, "the director may reg-"), (105.0, "ister the certificate and non-"), (120.0, "voting shares of the trustee"), (135.0, "510"),
        (150.0, "the certlficate of the cornpany"), (165.0, "Brivel and Form 4D and file NX-3794 under s. 142.3(o) of the direc-"), (762.4, "- l2 -"),
    ]
    rows = [(1, i, 0, i, 70.0, y, t, None) for i, (y, t) in enumerate(page)]
    rows += [(1, 20, 1, 0, 70.0, 45.1, "TITLE IX THE LIQUIDATOR"), (1, 21, 1, 1, 70.0, 90.0, "tor must not amend"), (1, 22, 1, 1, 70.0, 105.0, None), (1, 23, 1, 1, 70.0, 110.0, "  "), (1, 24, 1, 2, 70.0, 762.0, "xiv")]
    rows = [r if len(r) == 8 else (*r, None) for r in rows] + [rows[1]]
    rows += [(2, 0, 0, 0, 70.0, 40.0, "Page 3 of 9", None), (2, 1, 0, 0, 70.0, None, "the trustee", None), (3, 0, 0, 0, 70.0, 40.0, "5", None)]
    got = {(r["doc_id"], r["seq"], r["noise"]) for r in scans.find_noise(*tables(spark, rows)).filter("rec = 'line' AND doc_id < 8").collect()}
    assert got == {(1, 0, "header"), (1, 1, "broken_word"), (1, 5, "misread"), (1, 6, "broken_word"), (1, 7, "page_no"), (1, 20, "header"), (1, 24, "page_no"), (2, 0, "page_no")}


def test_paragraphs(spark):
    rows = [
        (1, 0, 0, 0, "The director may register the 57 certificate at the registered", None), (1, 1, 1, 0, "office and the trus- tee must not amend the pre- and post-closing debt.", None),
        (1, 2, 1, 0, "The trustee must TITLE IX THE LIQUIDATOR AND THE REGISTE - Title IX The liquidator and the registe not amend the cert1ficate.", None),
        (1, 3, 2, 0, "Within 57 days the trustee must [12] not amend the debt oblig¬ations of the company.", None), (1, 4, 2, 0, None, None), (1, 5, 2, 0, "", None),
        (1, 6, 3, 0, "The trustee must 8   Trusts Act of Kelvane not amend the non-voting shares.", None),
    ]
    got = {(r["seq"], r["noise"]) for r in scans.find_noise(*tables(spark, (), rows + rows[:1])).filter("rec = 'paragraph' AND doc_id = 1").collect()}
    assert got == {(0, "page_no"), (0, "continued"), (1, "broken_word"), (2, "header"), (2, "misread"), (3, "page_no"), (3, "broken_word"), (6, "header")}


def test_repair(spark):
    rows = [(1, 0, 0, 0, 70.0, 45.1, "Trusts Act of Ostrel"), (1, 1, 0, 1, 70.0, 90.0, "the director may reg-"), (1, 2, 0, 1, 70.0, 105.0, "ister the certlficate of non-"), (1, 3, 1, 0, 70.0, 90.0, "voting shares."), (1, 4, 1, 1, 70.0, 120.0, "The trustee must not."), (1, 5, 1, 2, 70.0, 762.0, "4")]
    paras = [(1, 0, 0, 0, "The director may register the certificate at the registered", None), (1, 1, 1, 0, "office of the cornpany.", None), (1, 2, 1, 0, "The trustee must [3] not amend.", None)]
    out = scans.repair_scans(*tables(spark, [(*r, None) for r in rows], paras)).filter("doc_id = 1")
    got = {(r["rec"], r["para_no"]): r["text"] for r in out.collect()}
    assert got == {
        ("line", 0): "the director may register the certificate of non-voting shares.", ("line", 1): "The trustee must not.",
        ("paragraph", 0): "The director may register the certificate at the registered office of the company.", ("paragraph", 1): "The trustee must not amend.",
    }


def test_empty_tables(spark):
    lines, paras, meta = tables(spark)
    assert scans.find_noise(lines.limit(0), paras.limit(0), meta).count() == 0
    assert scans.find_noise(lines, paras, meta.limit(0)).count() == 0
    assert scans.repair_scans(lines.limit(0), paras.limit(0), meta).count() == 0


def edit_one(word, vocabulary):
    letters = "abcdefghijklmnopqrstuvwxyz"
    near = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    near |= {word[:i] + meant + word[i + len(read) :] for read, meant in scans.CONFUSIONS for i in range(len(word)) if word.startswith(read, i)}
    return (near & vocabulary) - {word}


def test_retrieval_is_complete():
    rng = random.Random(2)
    vocabulary = {"".join(rng.choice("abcilmnru") for _ in range(rng.randint(1, 6))) for _ in range(1500)}
    trie = scans.Trie(dict.fromkeys(vocabulary, 1))
    for _ in range(300):
        w = "".join(rng.choice("abcilmnru10") for _ in range(rng.randint(1, 6)))
        assert {c for c, _ in trie.candidates(w)} == edit_one(w, vocabulary), w
    assert trie.candidates("") == [] or all(len(c) == 1 for c, _ in trie.candidates(""))


def test_two_confusions_in_a_long_word():
    trie = scans.Trie(dict.fromkeys(["administration", "minister", "determination"], 1))
    twice = {w: trie.candidates(w, 0, 2, 2) for w in ("adrninistratlon", "determinatlon", "administxatlon", "rninlster")}
    assert twice["adrninistratlon"] == [("administration", True)] and twice["determinatlon"] == [("determination", True)]
    assert twice["administxatlon"] == [] and twice["rninlster"] == [("minister", True)]


def test_a_text_that_recurs_at_one_height_is_a_header(spark):
    rows = []
    for page in range(6):
        rows.append((1, 10 * page, page, 0, 150.0 + page % 2, 40.0, f"Fisheries Act {page}"))
        rows += [(1, 10 * page + i, page, 0, 150.0 + 20 * i, 40.0, f"body {'abcdef'[page]}{'uvwxyz'[i]} of the page") for i in range(1, 5)]
        rows.append((1, 10 * page + 6, page, 0, 300.0 + 40 * page, 40.0, "shall apply."))
    lines = spark.createDataFrame(rows, "doc_id long, seq long, page int, block int, y0 double, x0 double, text string")
    meta = spark.createDataFrame([(1, "scan", 792.0)], "doc_id long, medium string, page_height double")
    got = {r["seq"]: r["margin"] for r in scans.read_lines(lines, meta).collect()}
    assert {k for k, v in got.items() if v == "header"} == {0, 10, 20, 30, 40, 50}


def test_words_beside_all_occurrences_decide(spark):
    corpus = scans.Corpus({"form": 900, "farm": 900, "the": 5000, "of": 5000, "land": 800}, {})
    corpus.set_pairs({("the", "farm"): 40, ("farm", "land"): 60, ("form", "of"): 30})
    trie = scans.Trie(corpus.words)
    odd = spark.createDataFrame([("f0rm", None, "of")] * 2 + [("f0rm", None, None)] * 3, "word string, before string, after string")
    assert [tuple(r) for r in scans.misread_words(odd, trie, corpus).collect()] == [("f0rm", "form")]
