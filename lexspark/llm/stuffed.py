"""Problem 8: pages of stuffed keywords, link lists or product tags.

A page is read in units of about a dozen words within its lines. Each unit gets the share of function words of the page's
language, the share of its content words that are top words of the page or belong to word pairs repeated over it, its
link text ratio, its density of separators, whether its line is repeated on the page, and whether it is a short line
numbered or priced like its neighbours, as in a table of contents or a list of fees. The thresholds are calibrated per
language over the whole corpus: those on the function word share are fractions of the upper quartile of all units, those on
links and repetition rise where prose itself has more of them. The function words of two languages are listed; those of any
other language that pages are declared to be in are learned, as the words that most of its pages hold. Units
without enough function words form blocks; a block counts as stuffed if enough of its text repeats keywords or links,
and a page is found if stuffed blocks hold more than half of its characters.

Defined results: null, empty and blank texts are never found; the language is told from the text, as the column may be
wrong or null, as the one of which most function words occur (the first of ``FUNCTION_WORDS`` where none does); repeated rows count once; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.session import spread, written

UNIT_WORDS = 12
#: The share of function words that three quarters of the units stay below: prose, even where half of the text is stuffed.
PROSE_QUANTILE = 0.75
#: Fractions of it: below the first a unit may be evidence, below the second it may be in a block.
STRICT, LOOSE = 0.55, 0.73
REPEATED_SHARE, LINK_SHARE, SEPARATORS_A_WORD, BLOCK_EVIDENCE, PAGE_SHARE = 0.5, 0.3, 0.2, 0.4, 0.5
PROSE_SHARE = 0.4  # a unit with so many function words is prose in any language, its word pairs are no keywords
TOP_WORD_SHARE, TOP_WORD_TIMES = 0.02, 3  # of the page's content words outside prose
#: Learned function words: pages that a declared language needs, the most words of one, and the share of pages that hold each.
LEARN_PAGES, LEARN_WORDS, LEARN_SHARE = 20, 60, 0.3
#: Units of prose that may have so much of a measure, which its threshold then exceeds.
USUAL_QUANTILE = 0.98
LONG_PAGE_WORDS = 120  # word pairs count as repeated from 3 times on; on shorter pages from 2 times on

# Function words by language, and those that may stand inside a keyword.
FUNCTION_WORDS = {
    "en": frozenset(
        "the of to a an in and is are be that must shall may need not if or on at for by with which who from as it its this any each has have been was were "
        "under than when where such unless until before after within other what no".split()
    ),
    "fr": frozenset(
        "le la les l de des d un une du au aux et est sont pas ne n doit peut que qu si à en sur pour par dans ce se s sa son ses leur avec sans sous ou dont "
        "été sauf selon lorsque".split()
    ),
}
INSIDE_KEYWORDS = frozenset("de d du en à la l of".split())

_LINK = re.compile(r"https?://\S+|www\.\S+|\[[^\]]*\]\([^)]*\)|#[\w-]+|<a\s[^>]*>.*?</a>|</?\w[^>]*>")
_LINKED = re.compile(r"[/\[#<]|www\.")
_WORD = re.compile(r"[^\W\d_]+")
_SEPARATOR = re.compile(r">>|[|·•;]|\s/\s|\s»\s|,(?=\s)")
_LISTED = tuple(re.compile(p, re.IGNORECASE) for p in (r"^\s*\d+[.)]?\s", r"^\s*[•*-]?\s*item\s+\d+\s*:\s", r"[\s.]\d+\s*$"))


def page_units(text: str) -> list[tuple[str, bool, int]]:
    """(unit, stands in a listed line, lines that read like its line), about UNIT_WORDS words each, never over the end of a line.

    A line is listed if it is no longer than one unit and a line next to it is numbered or priced in the same way.
    """
    lines = [runs for line in text.split("\n") if (runs := line.split())]
    joined = [" ".join(runs) for runs in lines]
    times = Counter(x.lower() for x in joined)
    forms = [{k for k, p in enumerate(_LISTED) if p.search(x)} for x in joined]
    out = []
    for n, (runs, line) in enumerate(zip(lines, joined, strict=True)):
        alike = forms[n] and any(forms[n] & forms[m] for m in (n - 1, n + 1) if 0 <= m < len(lines))
        listed, i = bool(alike) and len(runs) < UNIT_WORDS + UNIT_WORDS // 2, 0
        while i < len(runs):
            j = i + UNIT_WORDS
            if len(runs) - j < UNIT_WORDS // 2:
                j = len(runs)
            out.append((" ".join(runs[i:j]), listed, times[line.lower()]))
            i = j
    return out


def page_features(text: str | None, known: dict[str, frozenset[str]] = FUNCTION_WORDS) -> tuple[str, list[int], list[float], list[float], list[float]]:
    """Language, and of each unit: characters, share of function words, share in top words and repeated word pairs (0 in
    listed lines, 1 between separators and in repeated lines), link text ratio."""
    units = page_units(text or "")
    words = [_WORD.findall(u.lower()) for u, _, _ in units]
    counts = Counter(w for s in words for w in s)
    lang = max(known, key=lambda k: sum(counts[w] for w in known[k]))
    function = known[lang]
    share = [sum([w in function for w in s]) / len(s) if s else 0.0 for s in words]
    placed = [[] if f >= PROSE_SHARE else _pairs(s, function) for f, s in zip(share, words, strict=True)]
    pairs = Counter(p[0] for here in placed for p in here)
    often = 3 if sum(counts.values()) >= LONG_PAGE_WORDS else 2
    content = Counter(w for f, s in zip(share, words, strict=True) if f < PROSE_SHARE for w in s if w not in function)
    least = max(TOP_WORD_TIMES, TOP_WORD_SHARE * sum(content.values()))
    top = {w for w, n in content.items() if n >= least}
    repeated = [
        (1.0 if times >= TOP_WORD_TIMES and s and not listed else _repeated(u, listed, s, f, here, pairs, often, top)) if f < PROSE_SHARE else 0.0
        for (u, listed, times), s, f, here in zip(units, words, share, placed, strict=True)
    ]
    links = [sum(m.end() - m.start() for m in _LINK.finditer(u)) / len(u) if _LINKED.search(u) else 0.0 for u, _, _ in units]
    return lang, [len(u) for u, _, _ in units], share, repeated, links


def _pairs(words: list[str], function: frozenset[str]) -> list[tuple[tuple[str, str], int, int]]:
    """Neighbouring content words with their places; one word that may stand inside a keyword doesn't part them."""
    out, last = [], -1
    for i, w in enumerate(words):
        if w in function:
            if w not in INSIDE_KEYWORDS:
                last = -1
            continue
        if last >= 0 and i - last <= 2:
            out.append(((words[last], w), last, i))
        last = i
    return out


def _repeated(unit: str, listed: bool, words: list[str], share: float, here: list, pairs: Counter, often: int, top: set[str]) -> float:
    if listed or not words:
        return 0.0
    if len(_SEPARATOR.findall(unit)) >= SEPARATORS_A_WORD * len(words):
        return 1.0
    covered = {i for pair, a, b in here if pairs[pair] >= often for i in (a, b)} | {i for i, w in enumerate(words) if w in top}
    content = round(len(words) * (1 - share))
    return len(covered) / content if content else 0.0


class Usual(NamedTuple):
    """What is usual in a language: the share of function words, and thresholds of link text and repetition above that of prose."""

    share: float = 0.0
    links: float = LINK_SHARE
    repeated: float = REPEATED_SHARE


def stuffed_share(sizes, share, repeated, links, usual: Usual) -> float:
    """The share of the characters that stands in stuffed blocks."""
    stuffed = total = i = 0
    strict, loose = STRICT * usual.share, LOOSE * usual.share
    evidence = [k >= usual.links or (f < strict and r >= usual.repeated) for f, r, k in zip(share, repeated, links, strict=True)]
    inside = [e or f < loose for e, f in zip(evidence, share, strict=True)]
    while i < len(sizes):
        j = i + 1
        if inside[i]:
            while j < len(sizes) and inside[j]:
                j += 1
            block = sum(sizes[i:j])
            if sum(n for n, e in zip(sizes[i:j], evidence[i:j], strict=True) if e) >= BLOCK_EVIDENCE * block:
                stuffed += block
        total += sum(sizes[i:j])
        i = j
    return stuffed / total if total else 0.0


def learned_function_words(documents: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, frozenset[str]]:
    """The function words of the declared languages that aren't listed: a few dozen words a language come to the driver."""
    if lang_col not in documents.columns:
        return {}
    pages = documents.filter(~F.col(lang_col).isin(*FUNCTION_WORDS) & (F.length(lang_col) > 0)).select(F.lower(lang_col).alias("lang"), F.lower(text_col).alias("text"))
    words = pages.select("lang", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)))).alias("word"))
    enough = pages.groupBy("lang").agg(F.count("*").alias("pages")).filter(F.col("pages") >= LEARN_PAGES)
    held = words.groupBy("lang", "word").agg(F.count("*").alias("n")).join(enough, "lang").filter(F.col("n") >= LEARN_SHARE * F.col("pages"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    out: dict[str, set[str]] = {}
    for r in held.withColumn("place", place).filter(F.col("place") <= LEARN_WORDS).select("lang", "word").collect():
        out.setdefault(r["lang"], set()).add(r["word"])
    return {k: frozenset(v) for k, v in out.items()}


def page_table(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, sizes, share, repeated, links) of every page with text, written once."""
    known = FUNCTION_WORDS | learned_function_words(documents, text_col, lang_col)
    docs = spread(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text") > 0))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [page_features(t, known) for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=["lang", "sizes", "share", "repeated", "links"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(docs.mapInPandas(read, f"doc_id {kind}, lang string, sizes array<int>, share array<float>, repeated array<float>, links array<float>"), "pages")


def calibrate(pages: DataFrame) -> dict[str, Usual]:
    """What is usual in each language, over all units (one row per language)."""
    units = pages.select("lang", F.explode(F.arrays_zip("share", "repeated", "links")).alias("u")).select("lang", "u.*")
    usual = units.groupBy("lang").agg(F.percentile_approx("share", PROSE_QUANTILE, 1000).alias("q"))
    at = {r["lang"]: float(r["q"] or 0.0) for r in usual.collect()}
    if not at:
        return {}
    of = F.create_map(*(F.lit(x) for pair in at.items() for x in pair))
    prose = units.filter(F.col("share") >= LOOSE * of[F.col("lang")])
    high = prose.groupBy("lang").agg(*(F.percentile_approx(c, USUAL_QUANTILE, 1000).alias(c) for c in ("links", "repeated")))
    top = {r["lang"]: (float(r["links"]), float(r["repeated"])) for r in high.collect()}
    return {k: Usual(v, *(max(least, min(1.0, x)) for least, x in zip((LINK_SHARE, REPEATED_SHARE), top.get(k, (0.0, 0.0)), strict=True))) for k, v in at.items()}


def score_pages(pages: DataFrame, usual: dict[str, Usual]) -> DataFrame:
    """(doc_id, lang, stuffed): the share of stuffed text of every page."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            columns = (pdf[c] for c in ("lang", "sizes", "share", "repeated", "links"))
            out = pdf[["doc_id", "lang"]].copy()
            out["stuffed"] = [stuffed_share(n.tolist(), f.tolist(), r.tolist(), k.tolist(), usual.get(lang, Usual())) for lang, n, f, r, k in zip(*columns, strict=True)]
            yield out

    kind = pages.schema["doc_id"].dataType.simpleString()
    return pages.mapInPandas(score, f"doc_id {kind}, lang string, stuffed double")


def find_stuffed_pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", page_share: float = PAGE_SHARE) -> DataFrame:
    """(doc_id) of the pages of which stuffed keywords, links or tags make up more than ``page_share``."""
    pages = page_table(documents, id_col, text_col)
    return score_pages(pages, calibrate(pages)).filter(F.col("stuffed") > page_share).select("doc_id").distinct()
