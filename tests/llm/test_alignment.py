import math
import random

import numpy as np

from lexspark.llm import alignment

SCHEMA = "doc_id long, left_sents array<string>, right_sents array<string>, left_lang string, right_lang string, left_no int"
EN, FR = (["".join(random.Random(s * 100 + i).choice("bcdfglmnprstv") + random.Random(s * 100 + i + 7).choice("aeiou") for _ in range(1)) + w + str("abcdefghijklmnopqrstuvwxyz"[i % 26] * (1 + i // 26)) for i in range(60)] for s, w in ((1, "en"), (2, "fr")))


def corpus(n=150, seed=3):
    """Documents of invented words; the translation of a word is the word of the same number."""
    rng = random.Random(seed)
    docs, want = [], {}
    for d in range(n):
        plain = [[rng.randrange(60) for _ in range(9)] for _ in range(rng.randint(4, 9))]
        left = ["the " + " ".join(EN[w] for w in s) + f" of Name{d}x{i}." for i, s in enumerate(plain)]
        right = ["le " + " ".join(FR[w] for w in s) + f" de Name{d}x{i}." for i, s in enumerate(plain)]
        pairs = {(i, i) for i in range(len(plain))}
        if d % 5 == 0:  # two sentences merged on the right
            right[1:3] = [right[1] + " et " + right[2]]
            pairs = {(i, i if i < 2 else i - 1) for i in range(len(plain))}
        elif d % 5 == 1:  # one omitted on the right
            del right[2]
            pairs = {(i, i if i < 2 else i - 1) for i in range(len(plain)) if i != 2}
        elif d % 5 == 2:  # one moved to the end
            right.append(right.pop(0))
            pairs = {(i, i - 1) for i in range(1, len(plain))} | {(0, len(plain) - 1)}
        flip = d % 7 == 0
        docs.append((d, right if flip else left, left if flip else right, None if d % 3 else "en", "de", 1))
        want[d] = {(b, a) for a, b in pairs} if flip else pairs
    return docs, want


def aligned(spark, rows):
    out = {}
    for r in alignment.align_sentences(spark.createDataFrame(rows, SCHEMA)).collect():
        out.setdefault(r["doc_id"], set()).add((r["left_no"], r["right_no"]))
    return out


def test_merged_omitted_moved_and_flipped(spark):
    rows, want = corpus()
    got = aligned(spark, rows + rows[:10])
    right = sum(len(got.get(d, set()) & w) for d, w in want.items())
    assert right >= 0.97 * sum(map(len, want.values())) and right >= 0.97 * sum(map(len, got.values()))


def test_null_and_empty_sides(spark):
    rows, _ = corpus(40)
    odd = [(900, None, ["x"], None, None, 0), (901, [], [], None, None, 0), (902, [None, "a b"], [None], None, None, 0), (None, ["a"], ["a"], None, None, 0), (903, [""], ["", None], None, None, 0)]
    got = aligned(spark, rows + odd)
    assert not {900, 901, 903, None} & got.keys() and all(i > 0 for i, _ in got.get(902, ()))
    assert aligned(spark, odd[:2]) == {} and aligned(spark, rows[:0] or odd[:1]) == {}


def test_long_document(spark):
    rows, _ = corpus(60)
    rng = random.Random(8)
    plain = [[rng.randrange(60) for _ in range(9)] for _ in range(400)]
    rows.append((999, ["the " + " ".join(EN[w] for w in s) for s in plain], ["le " + " ".join(FR[w] for w in s) for s in plain], None, None, 0))
    got = aligned(spark, rows)[999]
    assert len(got & {(i, i) for i in range(400)}) >= 360


def test_every_span_is_compared_over_all_concepts():
    """Sentences whose likeness lies outside their strongest concepts."""
    n = alignment.CONCEPTS
    a, b = np.zeros((1, n), np.float32), np.zeros((3, n), np.float32)
    a[0, :32], b[1, 32:64] = 2.0, 2.0  # the strongest concepts of each are none of the other's
    a[0, 64:], b[1, 64:] = 1.0, 1.0
    b[0, 0], b[2, 63] = 1.0, 1.0

    class Fixed:
        def alike(self, one, two):
            return {}

        def dense(self, side, sentences, alike):
            return {"a": a, "b": b}[side], [{} for _ in sentences]

    document = alignment.Document(Fixed(), [["x"]], [["y"], ["z"], ["w"]])
    assert {(s, t) for s, t, _ in alignment.best_spans(document)} >= {(0, 1)}


def test_blocks_hold_the_same_spans(monkeypatch):
    rng = np.random.default_rng(5)
    a, b = (rng.normal(size=(n, alignment.CONCEPTS)).astype(np.float32) for n in (17, 13))
    b[:10] += 2 * a[2:12]

    class Fixed:
        def alike(self, one, two):
            return {"k": alignment.CONCEPTS}

        def dense(self, side, sentences, alike):
            return {"a": a, "b": b}[side], [{alignment.CONCEPTS: 3.0} if i % 5 == 0 else {} for i in range(len(sentences))]

    document = alignment.Document(Fixed(), [["x"]] * 17, [["y"]] * 13)
    whole = sorted(s[1:] for s in alignment.similar_spans(document))
    token = np.array([[3.0 if i % 5 == 0 else 0.0] for i in range(17)])
    wide = np.hstack([a.astype(float), token]), np.hstack([b.astype(float), token[:13]])
    want = []
    for p, q in [(1, 1), (2, 1), (3, 1), (1, 2), (1, 3)]:
        for x in range(17 - p + 1):
            for y in range(13 - q + 1):
                mine, theirs = range(x, x + p), range(y, y + q)
                u, v = wide[0][mine].sum(axis=0), wide[1][theirs].sum(axis=0)
                dot, one, two = u @ v, u @ u, v @ v
                if dot >= alignment.LEAST_COSINE * math.sqrt(one * two) and dot >= alignment.LEAST_CONTAINED * min(one, two):
                    want.append((x, p, y, q))
    assert whole == sorted(want) and want
    monkeypatch.setattr(alignment, "PRODUCTS_AT_ONCE", 40)
    assert sorted(s[1:] for s in alignment.similar_spans(document)) == whole
