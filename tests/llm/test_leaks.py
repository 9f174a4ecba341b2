import random

import pytest

from lexspark.llm import leaks

DOC = "doc_id long, text string, passage string, case_id long"
CASE = "case_id long, passage string, question string, text string"
COMMON = "the board may keep a register of transfers at the registered office in good faith before the first annual meeting".split()


def text(rng, n):
    out = []
    while len(out) < n:
        out += [f"n{rng.randrange(4000)}" for _ in range(rng.randint(1, 3))] + COMMON[(s := rng.randrange(12)) : s + rng.randint(2, 5)]
    return out[:n]


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(1)
    return [(i, " ".join(text(rng, 120)) + ".", " ".join(text(rng, 24)) + "?", "clash") for i in range(40)]


def found(spark, docs, cases, **more):
    df = leaks.find_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(cases, CASE), **more)
    return {tuple(r) for r in df.collect()}


def edited(rng, words, every):
    out = list(words)
    for at in range(every // 2, len(out) - 1, every):
        kind = rng.randrange(3)
        out[at] = "edit" if kind == 0 else out[at] + " added" if kind == 1 else ""
    return " ".join(out).split()


def test_planted(spark, cases):
    rng = random.Random(2)
    docs, want = [], set()
    for d in range(120):
        case = rng.randrange(40)
        passage, question = (leaks.words_of(cases[case][i]) for i in (1, 2))
        before, after = text(rng, rng.randint(0, 300)), text(rng, rng.randint(0, 300))
        kind = d % 6
        if kind == 0:
            part = passage
        elif kind == 1:
            at = rng.randrange(100)
            part = passage[at : at + 20]
        elif kind == 2:
            part = edited(rng, passage[10:74], 11)
        elif kind == 3:
            part = edited(rng, question, 12)
        elif kind == 4:
            at = rng.randrange(100)
            part = passage[at : at + 12]  # too short
        else:
            part = edited(rng, passage, 3)  # too many edits
        if kind < 4:
            want.add((d, case))
        docs.append((d, " ".join(before) + ". " + " ".join(part).upper() + " [3] " + " ".join(after), None, None))
    got = found(spark, docs, cases)
    assert got == want
    assert found(spark, docs, cases, cases_per_pass=7) == want


def test_what_does_not_count(spark, cases):
    words = cases[5][1].split()
    wrapped = "".join(w[:3] + "-\n" + w[3:] + "[12]  " if len(w) > 6 and w.isalpha() else w + ", " for w in words)
    accents = [(100, "L'été dernier, le député a retiré trente-deux dossiers près de la forêt après une réunion très animée où régnait une étonnante sérénité générale.", None, None)]
    damaged = accents[0][1].replace("é", "Ã©").upper().replace("Ã©".upper(), "Ã©")
    got = found(spark, [(1, wrapped, None, None), (2, damaged, None, None)], [*cases, *accents])
    assert got == {(1, 5), (2, 100)}


def test_edges(spark, cases):
    docs = [(1, None, None, None), (2, "", None, None), (3, "a b", None, None), (None, cases[1][1], None, None), (4, " ".join(text(random.Random(9), 60_000)) + cases[2][1], None, None), (4, cases[2][1], None, None)]
    odd = [*cases, (200, None, None, None), (201, "", "", None), (None, cases[3][1], None, None), (202, None, cases[4][2], None)]
    assert found(spark, docs, odd) == {(None, 1), (4, 2)}
    assert found(spark, [(5, cases[4][2], None, None)], odd) == {(5, 4), (5, 202)}
    empty = spark.createDataFrame([], CASE)
    assert leaks.find_leaks(spark.createDataFrame(docs, DOC), empty).count() == 0
    assert leaks.find_leaks(spark.createDataFrame([], DOC), spark.createDataFrame(cases, CASE)).count() == 0


def test_runs():
    t = [f"w{i}" for i in range(40)]
    assert leaks.holds_run(t, ["x", *t[5:25], "y"], 20, False) and not leaks.holds_run(t, ["x", *t[5:22], "y"], 20, False)
    assert leaks.holds_run(t, [*t[:10], "x", *t[11:18], "y", *t[19:21]], 20, False)
    assert leaks.holds_run(t, [*t[:20], "a", *t[20:]], 40, True) and not leaks.holds_run(t, t[:34], 40, True) and leaks.holds_run(t, t[:35], 40, True)
    assert not leaks.holds_run(t, [], 20, False)


def test_passages_and_templates_that_many_cases_share(spark, cases):
    rng = random.Random(6)
    shared = " ".join(text(rng, 60))
    same = [(300 + i, shared, None, None) for i in range(6)]
    stem = text(rng, 40)  # six passages differ in their last words alone
    stems = [(400 + i, " ".join([*stem, *(f"u{i}x{k}" for k in range(30))]), None, None) for i in range(6)]
    two = [(500, " ".join(text(rng, 50)), None, None), (500, " ".join(text(rng, 50)), None, None)]  # two passages of one case
    docs = [(1, " ".join(text(rng, 200)) + " " + shared, None, None), (2, " ".join(text(rng, 90) + stem), None, None), (3, two[0][1], None, None), (4, two[1][1], None, None)]
    want = {(1, 300 + i) for i in range(6)} | {(2, 400 + i) for i in range(6)} | {(3, 500), (4, 500)}
    assert found(spark, docs, [*cases, *same, *stems, *two]) == want


def test_text_without_spaces_and_one_passage_in_many_cases(spark):
    han = "".join(chr(0x4E00 + 37 * i) for i in range(60))
    many = [(10 + i, " ".join(f"shared{j}" for j in range(60)), f"what about {i} here and there then and now word{i}") for i in range(50)]
    rows = [(1, "前" + han[10:45] + "後"), (2, "so " + many[0][1] + " it went"), (3, "".join(reversed(han)))]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame([(1, han, None), *many], "case_id long, passage string, question string")
    got = {tuple(r) for r in leaks.find_leaks(documents, tests).collect()}
    assert got == {(1, 1)} | {(2, 10 + i) for i in range(50)}


def test_no_alignment_where_none_can_hold_a_run(monkeypatch):
    rng = random.Random(11)
    aligned = []
    real = leaks.SequenceMatcher
    monkeypatch.setattr(leaks, "SequenceMatcher", lambda *x, **y: aligned.append(x) or real(*x, **y))
    passage = text(rng, 80)
    shuffled = passage[:]
    rng.shuffle(shuffled)  # all words, but not in order
    assert not leaks.holds_run(passage, shuffled, 20, False) and not leaks.holds_run(passage[:24], shuffled, 24, True)
    assert not aligned
    want = 0
    for n in range(400):
        part = [*text(rng, rng.randint(0, 40)), *edited(rng, passage[(at := rng.randrange(50)) : at + rng.randint(12, 60)], rng.randint(3, 14)), *text(rng, 30)]
        for mine, whole in ((passage, False), (passage[at : at + 30], True)):
            least = len(mine) if whole else 20
            with monkeypatch.context() as m:
                m.setattr(leaks, "may_hold_run", lambda *_: True)
                held = leaks.holds_run(mine, part, least, whole)
            assert held == leaks.holds_run(mine, part, least, whole), (n, whole)
            want += held
    assert 100 < want < 700
