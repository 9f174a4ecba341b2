"""Problem 5: pairs of sentences of a bilingual document that translate each other.

Concepts are groups of whole paired documents, shared by both languages: over the same concept a term and its translation
occur equally often. Spark counts the sentences of every term and concept; a term becomes the vector of its standardised
counts over the concepts, a sentence the weighted sum of its terms, and tokens that both sides of the document write
alike (numbers, names) are concepts of their own. The products of all sentences of both sides of a document are taken
over all concepts, block by block, and with them the cosines of all spans of up to three sentences; the spans are chosen
best first, which keeps the mutually best. A merged sentence gets all its partners.

Defined results: null or empty sides have no pairs; a null sentence keeps its position and has none; the side that has
more of the first language's function words counts as that language, whatever the language columns say; repeated rows
of one doc_id count once (the greatest); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.llm.batches import map_rows
from lexspark.session import partitions, written

CONCEPTS, SPAN = 256, 3
#: Products of sentences that are held at once.
PRODUCTS_AT_ONCE, SENTENCES_AT_ONCE = 2**20, 512
#: Cosines are compared to so many decimals, as their last bits depend on the order of summation.
DECIMALS = 9
#: A term counts by its concepts from this share of the sentences on; at most 4000 terms per term of a sentence do.
LEAST_TERM_SHARE, LEAST_TERM_SENTENCES = 1 / 4000, 4
LEAST_COSINE, LEAST_CONTAINED = 0.28, 0.6

# Words that tell the first language from the second.
FIRST_LANGUAGE = ("the", "a", "an", "of", "and", "is", "to", "not", "or", "in", "must", "may", "for", "by", "with")
SECOND_LANGUAGE = ("le", "la", "les", "un", "une", "des", "du", "de", "est", "pas", "et", "à", "en", "ou", "dans")


def _words(sentences: Column) -> Column:
    return F.transform(sentences, lambda s: F.coalesce(F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>")))


def _lean(words: Column) -> Column:
    """Function words of the first language less those of the second."""
    one, two = F.array(*map(F.lit, FIRST_LANGUAGE)), F.array(*map(F.lit, SECOND_LANGUAGE))
    flat = F.flatten(words)
    return F.size(F.filter(flat, lambda w: F.array_contains(one, w))) - F.size(F.filter(flat, lambda w: F.array_contains(two, w)))


def paired_words(documents: DataFrame, id_col: str, left: str, right: str) -> DataFrame:
    """(doc_id, concept, flipped, a, b): the words of every sentence, ``a`` of the side that leans to the first language."""
    rows = documents.filter(F.col(id_col).isNotNull() & (F.size(left) > 0) & (F.size(right) > 0))
    rows = rows.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.struct(F.col(left).alias("l"), F.col(right).alias("r"))).alias("s"))
    rows = rows.select("doc_id", _words(F.col("s.l")).alias("l"), _words(F.col("s.r")).alias("r"))
    rows = rows.withColumn("flipped", _lean(F.col("l")) < _lean(F.col("r")))
    a, b = F.when(F.col("flipped"), F.col("r")).otherwise(F.col("l")), F.when(F.col("flipped"), F.col("l")).otherwise(F.col("r"))
    return rows.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(CONCEPTS)).cast("int").alias("concept"), "flipped", a.alias("a"), b.alias("b"))


class TermModel:
    """Vectors of the terms of both sides over the concepts, and weights of the rest."""

    def __init__(self, rows, sentences: dict[str, int], least: dict[str, int]):
        self.vectors: dict[str, dict[str, np.ndarray]] = {"a": {}, "b": {}}
        self.weights: dict[str, dict[str, float]] = {"a": {}, "b": {}}
        self.rare = {side: math.log(max(2.0, 2.0 * n / least[side])) for side, n in sentences.items()}
        counts: dict[str, dict[str, np.ndarray]] = {"a": {}, "b": {}}
        for r in rows:
            x = np.zeros(CONCEPTS)
            x[[c["concept"] for c in r["counts"]]] = [c["n"] for c in r["counts"]]
            counts[r["side"]][r["term"]] = x
        self.places: dict[str, dict[str, int]] = {}
        self.matrix: dict[str, np.ndarray] = {}
        for side, terms in counts.items():
            total = sum(terms.values(), np.zeros(CONCEPTS))
            share = total / max(1.0, total.sum())
            for term, x in terms.items():
                idf = math.log(sentences[side] / x.sum() + 1)
                self.weights[side][term] = idf
                if not term.isdigit():
                    expected = x.sum() * share
                    z = np.divide(x - expected, np.sqrt(expected), out=np.zeros(CONCEPTS), where=expected > 0)
                    norm = np.sqrt(z @ z)
                    if norm > 0:
                        self.vectors[side][term] = idf * z / norm
            self.places[side] = {term: i for i, term in enumerate(self.vectors[side])}
            self.matrix[side] = np.array(list(self.vectors[side].values())).reshape(-1, CONCEPTS)

    def dense(self, side: str, sentences, alike: dict[str, int]) -> tuple[np.ndarray, list[dict[int, float]]]:
        """Concept vectors of sentences, and the weights of the tokens in ``alike``, which both sides share."""
        place, weights, rare = self.places[side], self.weights[side], self.rare[side]
        ids, ends, tokens = [], [], []
        for words in sentences:
            mine = {}
            for w in words:
                i = place.get(w)
                if i is not None:
                    ids.append(i)
                elif w in alike:
                    mine[alike[w]] = weights.get(w, rare)
            ends.append(len(ids))
            tokens.append(mine)
        total = np.zeros((len(sentences), CONCEPTS))
        for lo in range(0, len(sentences), SENTENCES_AT_ONCE):  # sums of runs of rows, of a bounded number of terms at once
            some = ends[lo : lo + SENTENCES_AT_ONCE]
            first = ends[lo - 1] if lo else 0
            starts = np.array([first, *some[:-1]]) - first
            held = np.flatnonzero(np.diff([first, *some]))
            if len(held):
                total[lo + held] = np.add.reduceat(self.matrix[side][ids[first : some[-1]]], starts[held], axis=0)
        return total, tokens

    def alike(self, a, b) -> dict[str, int]:
        """Numbers from CONCEPTS on for the tokens both sides of a document share and the concepts don't represent."""
        shared = {w for s in a for w in s} & {w for s in b for w in s}
        return {w: CONCEPTS + i for i, w in enumerate(sorted(shared)) if w not in self.vectors["a"] and w not in self.vectors["b"]}


def learn_terms(pairs: DataFrame) -> TermModel:
    """Sentence counts of terms by concept. Only terms that reach a share of the sentences come to the driver, so their
    number is bounded by the length of sentences, not by the corpus."""
    sides = [pairs.select(F.lit(s).alias("side"), "concept", F.explode(s).alias("words")) for s in "ab"]
    sentences = sides[0].unionByName(sides[1])
    n = {r["side"]: r["count"] for r in sentences.groupBy("side").count().collect()}
    n = {s: n.get(s, 0) for s in "ab"}
    least = {s: max(LEAST_TERM_SENTENCES, math.ceil(k * LEAST_TERM_SHARE)) for s, k in n.items()}
    terms = sentences.select("side", "concept", F.explode(F.array_distinct("words")).alias("term")).groupBy("side", "term", "concept").agg(F.count("*").alias("n"))
    terms = terms.groupBy("side", "term").agg(F.sum("n").alias("df"), F.collect_list(F.struct("concept", "n")).alias("counts"))
    enough = F.when(F.col("side") == "a", F.lit(least["a"])).otherwise(F.lit(least["b"]))
    return TermModel(terms.filter(F.col("df") >= enough).select("side", "term", "counts").collect(), n, least)


class Document:
    """The sentences of one document: concept vectors and shared tokens of both sides, and the numbers in every sentence."""

    def __init__(self, model: TermModel, a, b):
        alike = model.alike(a, b)
        self.sides = [model.dense("a", a, alike), model.dense("b", b, alike)]
        self.numbers = [[{w for w in s if w.isdigit()} for s in side] for side in (a, b)]

    def norms(self, side: int) -> dict[int, np.ndarray]:
        """The squared lengths of the spans of each width."""
        vectors, tokens = self.sides[side]
        out, n = {}, len(tokens)
        for p in range(1, min(SPAN, n) + 1):
            span = sum(vectors[d : n - p + 1 + d] for d in range(p))
            out[p] = np.einsum("nd,nd->n", span, span)
            for x in range(n - p + 1):
                if any(tokens[x : x + p]):
                    total: dict[int, float] = {}
                    for t in tokens[x : x + p]:
                        for k, w in t.items():
                            total[k] = total.get(k, 0.0) + w
                    out[p][x] += sum(w * w for w in total.values())
        return out


def similar_spans(document: Document) -> list[tuple[float, int, int, int, int]]:
    """(cosine, x, p, y, q) of the spans, p sentences from x on and q from y on, that reach the least cosine and containment.

    All pairs of spans are compared; blocks of rows bound the memory.
    """
    (va, ta), (vb, tb) = document.sides
    n_a, n_b = len(ta), len(tb)
    norms = [document.norms(0), document.norms(1)]
    holders: dict[int, list[tuple[int, float]]] = {}
    for j, tokens in enumerate(tb):
        for k, w in tokens.items():
            holders.setdefault(k, []).append((j, w))
    at = {k: (np.array([j for j, _ in held]), np.array([w for _, w in held])) for k, held in holders.items()}
    height, out = max(1, PRODUCTS_AT_ONCE // max(1, n_b)), []
    for lo in range(0, n_a, height):
        block = va[lo : lo + height + SPAN - 1] @ vb.T
        for row, tokens in zip(block, ta[lo : lo + height + SPAN - 1], strict=True):
            for k, w in tokens.items():
                if k in at:
                    row[at[k][0]] += w * at[k][1]
        for p, q in [(1, 1), *((p, 1) for p in range(2, SPAN + 1)), *((1, q) for q in range(2, SPAN + 1))]:
            rows, columns = min(height, len(block) - p + 1), n_b - q + 1
            if rows < 1 or columns < 1:
                continue
            dot = sum(block[d : d + rows, e : e + columns] for d in range(p) for e in range(q))
            one, two = norms[0][p][lo : lo + rows, None], norms[1][q][None, :]
            least, both = np.minimum(one, two), np.sqrt(one * two)
            x, y = np.nonzero((least > 0) & (dot >= LEAST_COSINE * both) & (dot >= LEAST_CONTAINED * least))
            cosine = np.round(dot[x, y] / both[x, y], DECIMALS)
            out += [(c, lo + i, p, j, q) for c, i, j in zip(cosine.tolist(), x.tolist(), y.tolist(), strict=True)]
    return out


def best_spans(document: Document) -> list[tuple[int, int, float]]:
    """Pairs of sentences of the mutually best spans; no sentence is in two spans.

    Two spans are mutually best if neither shares a sentence with a span of a more similar pair that is left; taking the
    most similar pair of all that are left, time and again, gives just those.
    """
    out, used_a, used_b = [], set(), set()
    for cosine, x, p, y, q in sorted(similar_spans(document), key=lambda s: (-s[0], s[1:])):
        mine, theirs = range(x, x + p), range(y, y + q)
        if not used_a.isdisjoint(mine) or not used_b.isdisjoint(theirs):
            continue
        one, two = (set().union(*(document.numbers[side][s] for s in span)) for side, span in ((0, mine), (1, theirs)))
        if one and two and not one & two:
            continue  # near-identical sentences that differ in their numbers
        used_a.update(mine)
        used_b.update(theirs)
        out += [(s, t, cosine) for s in mine for t in theirs]
    return out


def align_sentences(documents: DataFrame, id_col: str = "doc_id", left: str = "left_sents", right: str = "right_sents") -> DataFrame:
    """(doc_id, left_no, right_no, cosine) of the sentences that translate each other, positions from 0."""
    pairs = written(paired_words(documents, id_col, left, right), "paired-words")
    model = learn_terms(pairs)
    rows = pairs.select("doc_id", "flipped", "a", "b").repartition(partitions(pairs.sparkSession), "doc_id")

    def choose(batch: list[dict]) -> list[dict]:
        out = []
        for r in batch:
            found = best_spans(Document(model, r["a"], r["b"]))
            out += [{"doc_id": r["doc_id"], "left_no": t if r["flipped"] else s, "right_no": s if r["flipped"] else t, "cosine": c} for s, t, c in found]
        return out

    numbers = [T.StructField("left_no", T.IntegerType()), T.StructField("right_no", T.IntegerType()), T.StructField("cosine", T.DoubleType())]
    return map_rows(rows, choose, T.StructType([pairs.schema["doc_id"], *numbers]))
