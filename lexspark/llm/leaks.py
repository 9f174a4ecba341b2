"""Problem 7: passages and questions of held-out test cases inside the documents of a corpus.

Test texts are cut into short items (windows of ``ITEM_WORDS`` words), documents into overlapping segments. Both are sets
of three-word shingles. Segments are partitioned by the number of test shingles they hold; a segment class uses as many
MinHash functions as its size needs to find an item that it contains. Candidates are verified by the exact share of the
item's shingles that the segment holds, and then word by word in order. MinHash runs over identifying shingles, those
that few test texts share; the exact containment counts all shingles. Items with too few identifying shingles are
searched exactly: a segment that contains enough of an item holds at least one of its rarest shingles. A text that
several cases share is one text with the list of its cases.

Everything about a document is found where its row is read, so the corpus is never shuffled. The index of the test
items travels to the tasks; it covers at most ``CASES_PER_PASS`` cases, and more cases take more passes over the corpus.

Defined results: null and empty texts hold nothing; a case with a null passage or question is searched by the other one;
a passage of fewer than ``RUN_WORDS`` words counts as a whole; cases without id and texts of fewer than three words are
not searched; repeated rows count once; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate, repeat
from operator import sub

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.session import spread

RUN_WORDS, EDITS_IN = 20, 8  # a run of 20 words, one edit in 8
SHINGLE, ITEM_WORDS, ITEM_STEP, BLOCK = 3, 20, 4, 32
IDENTIFYING_TEXTS = 4
CONTAINMENT = 0.45
CASES_PER_PASS = 5_000
#: (test shingles in a segment up to, MinHash functions): the larger the segment, the smaller the similarity of an item in it.
SIZE_CLASSES = ((4, 8), (8, 14), (16, 22), (10**9, 32))
DOCS_AT_ONCE = 512
EXACT_AT_ONCE = 4096  # shingles whose items are listed together

_MARKS = re.compile(r"\[\d{1,3}\]|[¹²³⁰-⁹*†‡§]+")
_HYPHENS = re.compile(r"[-‐‑­](?<=\w[-‐‑­])\s*(?=\w)|­")  # the sign first, so that other characters are passed over fast
_WORDS = re.compile(r"\w+")
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"  # scripts without spaces between words
_UNSPACED_CHARACTER = re.compile(f"[{_UNSPACED}]")
_CHARACTERS = re.compile(f"[{_UNSPACED}]|[^\\W{_UNSPACED}]+")
_COMBINING = re.compile("[\u0300-\u036f]+")
_DAMAGED = re.compile(r"[ÃÂ][\x80-\xbf©¨ªª´¹§€-™]")


def words_of(text: str | None) -> list[str]:
    """The words that count: no case, accents, punctuation, note marks or hyphens; damaged encoding is repaired. In scripts
    without spaces between words every character is a word."""
    if not text:
        return []
    ascii_only = text.isascii()
    if not ascii_only and _DAMAGED.search(text):
        text = _DAMAGED.sub(_repair, text)
    if not ascii_only or "[" in text or "*" in text:
        text = _MARKS.sub(" ", text)
    if ascii_only:
        return _WORDS.findall((_HYPHENS.sub("", text) if "-" in text else text).lower())
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.replace("\xad", "-"))
        text = _COMBINING.sub("", text)
        if _UNSPACED_CHARACTER.search(text):
            return _CHARACTERS.findall(_HYPHENS.sub("", text).lower())
    return _WORDS.findall(_HYPHENS.sub("", text).lower())


def _repair(m: re.Match) -> str:
    try:
        return m.group().encode("cp1252").decode("utf-8")
    except UnicodeError:
        try:
            return m.group().encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m.group()


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class TestIndex:
    """Items of the test cases with their shingles and MinHash signatures."""

    def __init__(self, cases: list[tuple[int, str | None, str | None]]):
        self.texts = {}  # (number of the text, is a question) -> words
        self.cases = defaultdict(list)  # the same key -> cases
        numbers: dict[tuple[str, ...], int] = {}
        for case, passage, question in cases:
            for is_question, text in ((False, passage), (True, question)):
                if len(words := words_of(text)) >= SHINGLE:
                    key = numbers.setdefault(tuple(words), len(numbers)), is_question
                    self.texts[key] = words
                    self.cases[key].append(case)
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in self.texts.values() for w in t}), 1)}
        base = np.int64(len(self.vocabulary) + 1)
        self.weights = np.array([base**2, base, 1], np.int64)
        self.pair_codes = {k: (c[:-1] * base + c[1:]).tolist() for k, c in ((k, self.codes(t)) for k, t in self.texts.items())}
        in_texts = defaultdict(set)
        coded = {k: self.shingles(self.codes(t)) for k, t in self.texts.items()}
        self.triple_codes = {k: s.tolist() for k, s in coded.items()}
        for key, s in coded.items():
            for x in s.tolist():
                in_texts[x].add(self.cases[key][0])  # a text counts once, by its first case, as do both texts of a case
        self.universe = np.array(sorted(in_texts), np.int64)
        identifying = np.array([len(in_texts[x]) <= IDENTIFYING_TEXTS for x in self.universe.tolist()], bool)
        self.identifying = identifying
        functions = SIZE_CLASSES[-1][1]
        rng = np.random.default_rng(7)
        self.ranks = np.stack([rng.permutation(len(self.universe)) for _ in range(functions)]).astype(np.int32) if len(self.universe) else np.zeros((functions, 0), np.int32)
        self.ranks[:, ~identifying] = np.iinfo(np.int32).max
        self.padded = np.concatenate([self.ranks, np.full((functions, 1), np.iinfo(np.int32).max, np.int32)], axis=1)
        self.keys, sets = [], []
        for key, s in coded.items():
            at = np.searchsorted(self.universe, s)
            n = len(self.texts[key])
            for start in {*range(0, max(1, n - ITEM_WORDS + 1), ITEM_STEP), max(0, n - ITEM_WORDS)}:
                sets.append(np.unique(at[start : start + ITEM_WORDS - SHINGLE + 1]))
                self.keys.append(key)
        width = max(map(len, sets), default=1)
        self.items = np.full((len(sets), width), len(self.universe), np.int32)  # padded with a column that is never set
        for i, s in enumerate(sets):
            self.items[i, : len(s)] = s
        self.need = np.array([max(1, math.ceil(CONTAINMENT * len(s))) for s in sets], np.int32)
        # of every shingle, the items without enough identifying shingles that have it among their rarest
        spread_over = np.array([len(in_texts[x]) for x in self.universe.tolist()], np.int64)
        rarest = []
        for i, s in enumerate(sets):
            if identifying[s].sum() < self.need[i]:
                first = s[np.argsort(spread_over[s], kind="stable")[: len(s) - self.need[i] + 1]]
                rarest += [(x, i) for x in first.tolist()]
        by_shingle = np.array(sorted(rarest), np.int64).reshape(-1, 2)
        self.exact = np.searchsorted(by_shingle[:, 0], np.arange(len(self.universe) + 1)), by_shingle[:, 1]
        # of every function, the items by the identifying shingle that is their minimum
        self.buckets = []
        for f in range(functions):
            ranked = self.padded[f][self.items]
            best = self.items[np.arange(len(sets)), ranked.argmin(axis=1)] if sets else np.empty(0, np.int32)
            best = np.where(ranked.min(axis=1) == np.iinfo(np.int32).max, -1, best) if sets else best
            order = np.argsort(best, kind="stable")
            self.buckets.append((np.searchsorted(best[order], np.arange(len(self.universe) + 1)), order.astype(np.int32)))

    def codes(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def shingles(self, codes: np.ndarray) -> np.ndarray:
        a = self.weights
        return codes[:-2] * a[0] + codes[1:-1] * a[1] + codes[2:] * a[2]

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, item): the segment of two blocks from ``block`` on holds enough of the item's shingles."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(codes) < SHINGLE or not len(self.universe):
            return none
        s = self.shingles(codes)
        at = np.searchsorted(self.universe, s)
        at[at == len(self.universe)] = 0
        found = self.universe[at] == s
        starts = np.arange(0, len(s), BLOCK)
        # a segment that holds fewer test shingles than an item needs is no candidate for it
        held = np.add.reduceat(found.astype(np.int32), starts)
        held = held + np.append(held[1:], 0)
        telling = found & self.identifying[at]
        blocks = np.add.reduceat(telling.astype(np.int32), starts)
        size = blocks + np.append(blocks[1:], 0)
        n = len(size)
        u = np.where(telling, at, -1)
        u = np.append(u, np.full(n * BLOCK - len(u), -1)).reshape(n, BLOCK)
        u2 = np.concatenate([u, np.concatenate([u[1:], np.full((1, BLOCK), -1)])], axis=1)  # segments of two blocks
        pairs, low, least = [], 0, self.need.min(initial=len(self.universe))
        for high, functions in SIZE_CLASSES:
            rows = np.flatnonzero((size > low) & (size <= high) & (held >= least))
            low = high
            if not len(rows):
                continue
            holds = np.sort(u2[rows], axis=1)[:, -high:]  # what isn't there comes first
            for f in range(functions):
                ranks = self.padded[f][holds]  # -1 reads the last
                best = holds[np.arange(len(rows)), ranks.argmin(axis=1)]
                first, order = self.buckets[f]
                count = first[best + 1] - first[best]
                if total := int(count.sum()):
                    offset = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                    seg, items = np.repeat(rows, count), order[np.repeat(first[best], count) + offset]
                    enough = held[seg] >= self.need[items]
                    pairs.append(seg[enough] * np.int64(len(self.keys)) + items[enough])
        first, order = self.exact
        at_exact = np.flatnonzero(found & (first[at + 1] > first[at]) & (np.maximum(held, np.append(0, held[:-1])) >= self.need.min(initial=1))[np.arange(len(s)) // BLOCK])
        for lo in range(0, len(at_exact), EXACT_AT_ONCE):
            where = at_exact[lo : lo + EXACT_AT_ONCE]
            count = first[at[where] + 1] - first[at[where]]
            offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            items, block = order[np.repeat(first[at[where]], count) + offset], np.repeat(where // BLOCK, count)
            for seg in (block, block - 1):
                enough = (seg >= 0) & (held[seg] >= self.need[items])
                pairs.append(distinct(seg[enough] * np.int64(len(self.keys)) + items[enough]))
        if not pairs:
            return none
        pairs = distinct(np.concatenate(pairs))
        seg, item = pairs // len(self.keys), pairs % len(self.keys)
        # exact containment over all shingles of the item
        used = distinct(seg)
        seg_at = np.searchsorted(used, seg)
        keep = np.zeros(len(seg), bool)
        full = np.where(found, at, len(self.universe))
        full = np.append(full, np.full(n * BLOCK - len(full), len(self.universe))).reshape(n, BLOCK)
        full = np.concatenate([full, np.concatenate([full[1:], np.full((1, BLOCK), len(self.universe))])], axis=1)
        for lo in range(0, len(used), 1024):
            some = slice(*np.searchsorted(seg_at, [lo, lo + 1024]))  # pairs are sorted by segment
            there = np.zeros((min(1024, len(used) - lo), len(self.universe) + 1), bool)
            there[np.arange(len(there))[:, None], full[used[lo : lo + 1024]]] = True
            there[:, -1] = False
            inside = there[(seg_at[some] - lo)[:, None], self.items[item[some]]].sum(axis=1)
            keep[some] = inside >= self.need[item[some]]
        return seg[keep], item[keep]

    def leaked(self, words: list[str], codes: np.ndarray) -> set[int]:
        """The cases that a document leaks."""
        spans = defaultdict(list)
        for b, i in zip(*(x.tolist() for x in self.candidates(codes)), strict=True):
            spans[self.keys[i]].append(b)
        return self.verified(words, codes, spans)

    def holds_shingles(self, key: tuple[int, bool], part: np.ndarray) -> bool:
        """Whether ``part`` holds as many pairs and triples of neighbouring words of the text as any run with few enough
        edits keeps."""
        n, (cube, base, _) = len(self.texts[key]), self.weights
        for shingle, mine in ((2, self.pair_codes[key]), (3, self.triple_codes[key])):
            there = set((part[:-1] * base + part[1:] if shingle == 2 else part[:-2] * cube + part[1:-1] * base + part[2:]).tolist())
            kept = [0, *accumulate(map(there.__contains__, mine))]
            if key[1]:
                if kept[-1] < kept_at_least(n, n // EDITS_IN, shingle):
                    return False
            else:
                width = min(RUN_WORDS, n)  # a run has a part of this width with at most one edit more than the width allows
                if max(map(sub, kept[width - shingle + 1 :], kept)) < kept_at_least(width, width // EDITS_IN + 1, shingle):
                    return False
        return True

    def verified(self, words: list[str], codes: np.ndarray, spans: dict) -> set[int]:
        out = set()
        for key, blocks in spans.items():
            if out.issuperset(self.cases[key]):
                continue
            text, is_question = self.texts[key], key[1]
            margin = 8 + (len(text) if is_question else 0)
            groups: list[list[int]] = []
            for b in sorted(set(blocks)):
                if groups and b - groups[-1][1] <= 1:
                    groups[-1][1] = b
                else:
                    groups.append([b, b])
            for first, last in groups:
                cut = slice(max(0, first * BLOCK - margin), (last + 2) * BLOCK + margin)
                part = words[cut]
                if self.holds_shingles(key, codes[cut]) and holds_run(text, part, len(text) if is_question else min(RUN_WORDS, len(text)), is_question):
                    out.update(self.cases[key])
                    break
        return out


def kept_at_least(width: int, edits: int, shingle: int) -> int:
    """Shingles of neighbouring words that a run of ``width`` words keeps at least, as an edit breaks ``shingle`` of them."""
    return width - shingle + 1 - shingle * edits


def common_in_order(text: list[str], part: list[str]) -> int:
    """Words of the longest common subsequence, by bits over ``text``."""
    masks: dict[str, int] = {}
    for n, w in enumerate(text):
        masks[w] = masks.get(w, 0) | 1 << n
    every = (1 << len(text)) - 1
    v = every
    for w in filter(masks.__contains__, part):
        u = v & masks[w]
        v = (v + u | v - u) & every
    return len(text) - v.bit_count()


def may_hold_run(text: list[str], part: list[str], width: int, whole: bool) -> bool:
    """Whether ``part`` has in order as many words of ``text``, or of ``width`` neighbouring ones, as ``holds_run`` asks of
    any alignment: without them none needs to be found."""
    need = width - width // EDITS_IN - (not whole)
    held = [0, *accumulate(map(set(part).__contains__, text))]
    return any(high - low >= need and common_in_order(text[at : at + width], part) >= need for at, (low, high) in enumerate(zip(held, held[width:])))


def holds_run(text: list[str], part: list[str], least: int, whole: bool) -> bool:
    """Whether ``part`` holds, in order, ``least`` or more consecutive words of ``text`` (all, if ``whole``) with at most
    one edit in eight words."""
    if not may_hold_run(text, part, len(text) if whole else min(least, len(text)), whole):
        return False
    m = SequenceMatcher(None, text, part, autojunk=False)
    at = np.full(len(text), -1)
    for a, b, n in m.get_matching_blocks():
        at[a : a + n] = np.arange(b, b + n)
    hits = np.flatnonzero(at >= 0)
    if not len(hits):
        return False
    if whole:
        inner = np.maximum(np.diff(hits), np.diff(at[hits])) - 1
        return int(hits[0]) + (len(text) - 1 - int(hits[-1])) + int(inner.sum()) <= len(text) // EDITS_IN
    held = np.concatenate([[0], np.cumsum(at >= 0)])
    width = min(least, len(text))
    if (held[width:] - held[:-width]).max() < width - width // EDITS_IN - 1:
        return False  # a run with one edit in eight words has a part of this width with no more edits than that
    cost = np.concatenate([[0], np.cumsum(np.maximum(np.diff(hits), np.diff(at[hits])) - 1)])  # edits before each hit
    # runs from hit i to hit j: hits[j] - hits[i] + 1 words of the text, cost[j] - cost[i] edits, padded by edits at the ends
    for i in range(len(hits)):
        length = hits[i:] - hits[i] + 1
        edits = cost[i:] - cost[i]
        room = np.minimum(len(text), np.maximum(least, length))
        if ((edits + (room - length)) * EDITS_IN <= room).any():
            return True
    return False


def find_leaks(
    documents: DataFrame, cases: DataFrame, id_col: str = "doc_id", text_col: str = "text", case_col: str = "case_id",
    passage_col: str = "passage", question_col: str = "question", cases_per_pass: int = CASES_PER_PASS,
) -> DataFrame:
    """(doc_id, case_id) of the cases of which a document holds a passage or question, wholly or partly."""
    tests = cases.select(F.col(case_col).cast("long").alias("case_id"), F.col(passage_col).alias("passage"), F.col(question_col).alias("question")).filter("case_id is not null").distinct()
    passes = max(1, math.ceil(tests.count() / cases_per_pass))
    docs = spread(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text") > 0))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = None
    for n in range(passes):
        index = TestIndex([(r["case_id"], r["passage"], r["question"]) for r in tests.filter(F.pmod(F.xxhash64("case_id"), F.lit(passes)) == n).orderBy("case_id", "passage", "question").collect()])

        def search(batches: Iterator[pd.DataFrame], index: TestIndex = index) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for lo in range(0, len(pdf), DOCS_AT_ONCE):
                    yield search_some(index, pdf.iloc[lo : lo + DOCS_AT_ONCE])

        one = docs.mapInPandas(search, f"doc_id {kind}, case_id long")
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def search_some(index: TestIndex, pdf: pd.DataFrame) -> pd.DataFrame:
    """The leaks of some documents; their words stand in one array, each document from a new pair of blocks on."""
    words = [words_of(t) for t in pdf["text"]]
    parts, first, at = [], [], 0
    for w in words:
        codes = index.codes(w)
        room = (len(codes) // BLOCK + 2) * BLOCK  # an empty block between documents
        parts.append(np.append(codes, np.zeros(room - len(codes), np.int64)))
        first.append(at)
        at += room // BLOCK
    first = np.array(first)
    seg, item = index.candidates(np.concatenate([*parts, np.zeros(SHINGLE, np.int64)]))
    spans: dict = defaultdict(lambda: defaultdict(list))
    for d, b, i in zip((np.searchsorted(first, seg, "right") - 1).tolist(), seg.tolist(), item.tolist(), strict=True):
        spans[d][index.keys[i]].append(b - int(first[d]))
    ids = pdf["doc_id"].tolist()
    rows = [(ids[d], case) for d, s in spans.items() for case in sorted(index.verified(words[d], parts[d], s))]
    return pd.DataFrame(rows, columns=["doc_id", "case_id"])
