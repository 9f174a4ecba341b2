"""Problem 3: noise in the text of scanned pages, and its repair into continuous readable paragraphs.

Lines: what stands in the top or bottom margin is page furniture, a page number alone or a running header; so is, wherever it
stands, a text whose letters recur at one height on three pages and on half of the pages of its document. Body lines are
read in page order; a word cut at the end of a line is joined with the first word of the next body line and counts as
broken unless the corpus writes the two with a hyphen. Paragraphs have lost the positions: headers are told by their form,
page numbers by their decoration, or where the words around a number follow each other in the corpus but not the number.

Misread words: Spark counts all words of all scanned text. The known words form a trie; every other word, and every known
one, is intersected as a Levenshtein automaton of one edit with the trie, where an edit may also be a confusion of the
scanner such as ``rn`` for ``m``; long words without a candidate are intersected once more for two confusions. The retrieval
is complete; candidates that the corpus writes far more often are ranked by the kind of edit, by the words beside all
occurrences of the misread word and by frequency.

Defined results: documents that are not scans are ignored; null and blank texts have no noise and are no text between two
halves of a word; repeated equal rows count once, and rows of one key that differ are rows of their own; a null page
height counts as 792 points; a null y0 is body; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.session import checked_join, written

PAGE_HEIGHT, TOP, BOTTOM = 792.0, 0.08, 0.85
#: A word is known from this share of all words on, which bounds the trie; pairs of words alike.
KNOWN_SHARE, KNOWN_LEAST, PAIR_SHARE, PAIR_LEAST = 2e-6, 8, 1e-6, 3
#: A word is misread only if the corpus writes the other word so many times as often.
TIMES_AS_OFTEN = 30
#: Letters of a word that may have an edit of any kind, or two confusions.
GENERAL_EDIT_LETTERS, TWO_CONFUSIONS_LETTERS = 5, 8
#: A text that recurs on so many pages, on such a share of the pages of its document and within such a part of their height
#: is a running header.
HEADER_PAGES, HEADER_SHARE, HEADER_DRIFT, HEADER_LETTERS = 3, 0.5, 0.03, 4
SUSPECTS_BROADCAST, KNOWN_BROADCAST = 500_000, 500_000

# What scanners take for what (read, meant), and words that may follow a hanging hyphen.
CONFUSIONS = (
    ("0", "o"), ("0", "u"), ("1", "i"), ("1", "l"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("@", "a"), ("!", "l"), ("!", "i"), ("|", "l"), ("|", "i"), ("$", "s"), ("€", "e"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("i", "l"), ("l", "i"), ("l", "t"), ("v", "y"), ("li", "h"), ("ri", "n"), ("rn", "m"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("rm", "nn"),
    ("m", "in"), ("m", "rn"), ("m", "ni"), ("h", "li"), ("d", "cl"), ("n", "ri"), ("u", "ii"),
)
HANGING = ("and", "or", "et", "ou", "to", "à")

HYPHENS = ("-", "\u2010", "\u00ad", "\u00ac")
SPACE = " \t\n\r\x0b\x0c\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_HYPHEN = r"[-\u2010\u00ad\u00ac]"
_COMPOUND = r"(?<!\p{L})\p{L}+-\p{L}+"
_TOKEN = r"[\p{L}\p{N}@!|$€]+"
_NUMBER = r"[\divxlcIVXLCoO|!]+"
PAGE_NUMBER = rf"^(?i:page|p\.?|-|–|—|\[|\()?\s*{_NUMBER}\s*(?:-|–|—|\]|\)|\.)?(?:\s*(?i:of|de|sur|/)\s*{_NUMBER})?$"

_SECTIONED = r"(?i:d[il1!]v[il1!]s[il1!][o0]n|par[tf]|[tf][il1!][tf][l1i!][ec]|par[tf][il1!][ec]|[tf][il1!][tf]r[ec])\s+[IVXLCl1!|]{1,7}\s+(?=[A-ZÀ-Ý0-9])"
_ENACTED = r"(?:[A-ZÀ-Ý][\w@!|]*\s){1,3}(?i:[a@][ce][tf]|[ce][o0]d[ec]|[ce]h[a@]r[tf][ec]r|[o0]rd[il1!]n[a@]n[ce][ec])\s(?i:[o0][f])\s[A-ZÀ-Ý][\w@!|]+"
_HEADER = re.compile(rf"{_SECTIONED}|{_ENACTED}|(?<!\S)\d{{1,4}}(?:\sc\.\s\d+)?\s{{3}}(?=[A-Z])|(?<=\S)\s{{3}}[\dlO]{{1,4}}(?!\S)")
_HEADER_HEAD = re.compile(r"(?:\d{4}\sc\.\s\d+\s{1,3}|[\dlO]{1,4}\s{3}|\S+(?:\s\S+){0,5}\s-\s)$")
_HEADER_TAIL = re.compile(r"^(?:\s-\s)?(?:\s{3}[\dlO]{1,4}|\s\|\s[\dlO]{1,4})(?!\S)")
_DECORATED = re.compile(rf"(?<!\S)(?:\[{_NUMBER}\]|[-–—]\s{_NUMBER}\s[-–—]|(?:Page|PAGE)\s{_NUMBER}(?:\s(?:of|de|sur)\s{_NUMBER})?|p\.\s{_NUMBER})(?!\S)")
_BARE = re.compile(r"(?<!\S)(?:[lO]?\d[\dlO]{0,3}|[ivxlc]{1,8})(\.?)(?!\S)")
_ROMAN = re.compile(r"c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_PIECE = re.compile(r"[^\W\d_]+|\d+|[.;:!?]")
_CUT = re.compile(r"([^\W_][\w@!|]*)(?:[-‐]\s+|[­¬]\s*)(?=([^\W\d_A-ZÀ-Ý][\w@!|]*))")
_PLAIN_TOKEN = re.compile(r"[^\W_@!|$€]+(?:[@!|$€]+[^\W_]*)*|[@!|$€][^\W_]+")
HEADING_CHARS = 40


def margin_kind(text: Column, y0: Column, height: Column) -> Column:
    """``page_no`` or ``header`` for what stands in a margin, null for the body."""
    h = F.when(height > 0, height).otherwise(F.lit(PAGE_HEIGHT))
    margin = (y0 < TOP * h) | (y0 > BOTTOM * h)
    return F.when(margin & F.trim(text).rlike(PAGE_NUMBER), "page_no").when(margin, "header")


def read_lines(lines: DataFrame, meta: DataFrame) -> DataFrame:
    """Lines of scans with their margin kind, words, and the word that is cut at their end (its halves)."""
    scans = meta.filter("medium = 'scan'").groupBy("doc_id").agg(F.max("page_height").alias("height"))
    text = F.btrim("text", F.lit(SPACE))
    rows = lines.select("doc_id", "seq", "page", "block", "y0", "x0", text.alias("text")).filter(F.length("text") > 0).join(scans, "doc_id")
    rows = rows.repartition("doc_id").distinct()  # one shuffle serves this and all windows within a document
    hyphen = F.right("text", F.lit(1)).isin(*HYPHENS)
    rows = with_recurrence(rows)
    rows = rows.withColumns({
        "margin": F.coalesce(margin_kind(F.col("text"), F.col("y0"), F.col("height")), F.when(F.col("recurs"), "header")),
        "first": F.nullif(F.when(hyphen, F.regexp_extract("text", rf"(?<![\p{{L}}\p{{N}}@!|$€])({_TOKEN}){_HYPHEN}$", 1)), F.lit("")),
        "second": F.nullif(F.regexp_extract("text", rf"^(?=[\p{{Ll}}@]|\d\p{{Ll}})({_TOKEN})", 1), F.lit("")),
    })
    order = Window.partitionBy("doc_id", F.col("margin").isNull()).orderBy("page", "y0", "x0", "seq")
    rows = rows.withColumns({"next": F.lead("second").over(order), "next_seq": F.lead("seq").over(order), "hung": F.lag("first").over(order)})
    body = F.col("margin").isNull()
    hangs, taken = F.col("first").isNotNull() & F.col("next").isNotNull(), F.col("second").isNotNull() & F.col("hung").isNotNull()
    own = F.when(hangs, F.expr("left(text, length(text) - length(first) - 1)")).otherwise(F.col("text"))
    own = F.when(taken, F.substring(own, F.length("second") + 1, F.length("text"))).otherwise(own)
    return rows.select(
        "doc_id", "seq", "page", "block", "y0", "x0", "text", "margin", own.alias("piece"), F.when(body & hangs, F.col("next_seq")).alias("next_seq"),
        F.when(body & hangs, F.col("first")).alias("first"), F.when(body & hangs, F.col("next")).alias("second"),
    ).withColumns({
        "words": F.when(body, F.regexp_extract_all("piece", F.lit(_TOKEN), F.lit(0))),
        "compounds": F.when(body & F.contains("piece", F.lit("-")), F.regexp_extract_all(F.lower("piece"), F.lit(_COMPOUND), F.lit(0))),
    })


def with_recurrence(rows: DataFrame) -> DataFrame:
    """Adds ``recurs``: the letters of the text stand at one height on enough pages of the document."""
    letters = F.regexp_replace(F.lower("text"), r"\P{L}+", "")
    rows = rows.withColumn("letters", F.when(F.length(letters) >= HEADER_LETTERS, F.xxhash64(letters)).otherwise(F.xxhash64("page", "seq", "text")))
    same, document = Window.partitionBy("doc_id", "letters"), Window.partitionBy("doc_id")
    height = F.when(F.col("height") > 0, F.col("height")).otherwise(F.lit(PAGE_HEIGHT))
    pages = lambda w: F.size(F.collect_set("page").over(w))
    rows = rows.withColumns({"n": pages(same), "level": F.max("y0").over(same) - F.min("y0").over(same) <= HEADER_DRIFT * height, "pages": pages(document)})
    return rows.withColumn("recurs", (F.col("n") >= HEADER_PAGES) & (F.col("n") >= HEADER_SHARE * F.col("pages")) & F.col("level")).drop("letters", "n", "level", "pages")


class Corpus:
    """Known words, compounds and pairs of neighbouring words of all scanned text, with their counts."""

    def __init__(self, words: dict[str, int], compounds: dict[str, int]):
        self.words, self.compounds = words, compounds
        self.pairs: dict[tuple[str, str], int] = {}
        self.firsts: Counter = Counter()

    def name(self, piece: str) -> str:
        return "#" if piece[0].isdigit() else "." if piece in ".;:!?" else piece if piece in self.words else "?"

    def set_pairs(self, pairs: dict[tuple[str, str], int]) -> None:
        self.pairs = pairs
        for (a, _), n in pairs.items():
            self.firsts[a] += n

    def divided(self, first: str, second: str) -> bool:
        """Whether two halves of a word belong together without a hyphen."""
        first, second = first.lower(), second.lower()
        if second in HANGING:
            return False
        hyphen = self.compounds.get(f"{first}-{second}", 0)
        return not hyphen or self.words.get(first + second, 0) > hyphen

    def inserted(self, before: str, after: str) -> bool:
        """Whether a number between two words is no part of the text: they follow each other, and not with it."""
        a, b = self.name(before), self.name(after)
        together = self.pairs.get((a, b), 0) / max(1, self.firsts[a])
        with_number = self.pairs.get((a, "#"), 0) / max(1, self.firsts[a]) * self.pairs.get(("#", b), 0) / max(1, self.firsts["#"])
        return together > 3 * with_number and self.pairs.get((a, b), 0) >= 2


def read_paragraph(corpus: Corpus, text: str) -> tuple[bool, bool, bool, list[str], str]:
    """header, page_no, broken_word, the words of the body, and the repaired body of one paragraph."""
    spans, header, page_no = [], False, False
    for m in _HEADER.finditer(text):
        header = True
        start, end = m.span()
        if re.match(_SECTIONED, m.group()):
            end = min(len(text), start + HEADING_CHARS)
            while end < len(text) and end > start and text[end - 1].isalnum() and text[end].isalnum():
                end += 1  # the heading is cut at a fixed length, but a word of the body is not
        if head := _HEADER_HEAD.search(text, max(0, start - 80), start):
            if not head.group().endswith(" - ") or head.group().isupper() or re.search(_ENACTED, head.group()):
                start = head.start()
        if tail := _HEADER_TAIL.search(text[end : end + 12]):
            end += tail.end()
        spans.append((start, end))
    body = _blank(text, spans)
    spans = [m.span() for m in _DECORATED.finditer(body)]
    page_no = bool(spans)
    body = _blank(body, spans)
    spans = []
    for m in _BARE.finditer(body):
        number = m.group().rstrip(".")
        if not any(c.isdigit() for c in number) and not (_ROMAN.fullmatch(number) and number not in ("c", "l", "d", "m") and number not in corpus.words):
            continue
        before = _PIECE.findall(body[max(0, m.start() - 40) : m.start()])
        after = _PIECE.findall(body[m.end() : m.end() + 40])
        if m.group(1) and after and not (after[0][0].islower() or (before and before[-1] in ".;:!?")):
            continue  # a number that ends its sentence
        if after and corpus.inserted(before[-1].lower() if before else ".", after[0].lower()):
            spans.append(m.span())
    page_no = page_no or bool(spans)
    body = _blank(body, spans)
    broken, parts, at = False, [], 0
    for m in _CUT.finditer(body):
        if corpus.divided(m.group(1), m.group(2)):
            broken = True
            parts.append(body[at : m.end(1)])
            at = m.end()
    body = " ".join(("".join(parts) + body[at:]).split())
    return header, page_no, broken, _PLAIN_TOKEN.findall(body), body


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    for a, b in spans:
        text = text[:a] + " " * (b - a) + text[b:]
    return text


class Trie:
    """Vocabulary trie; ``candidates`` runs a Levenshtein automaton of one edit through it."""

    def __init__(self, words: dict[str, int]):
        self.words, self.root = words, {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        self.meant: dict[str, list[tuple[str, str]]] = {}
        for read, meant in CONFUSIONS:
            self.meant.setdefault(meant[0], []).append((read, meant))

    def candidates(self, word: str, general: int = 1, confusions: int = 1, edits: int = 1) -> list[tuple[str, bool]]:
        """All words up to ``edits`` edits away, with whether confusions of scanners alone lead there.

        A state is (position, general edits, confusions, rest); ``rest`` is what a confusion still expects of the
        vocabulary's word. At most ``general`` edits of any kind and ``confusions`` confusions are made.
        """
        n, found = len(word), {}
        begin = {(0, 0, 0, "")} | ({(1, 1, 0, "")} if n and general else set())
        stack = [(self.root, frozenset(begin))]
        while stack:
            node, states = stack.pop()
            for c, child in node.items():
                if not c:
                    for p, g, k, rest in states:
                        if p == n and g + k and not rest:
                            found[child] = found.get(child, False) or not g
                    continue
                after = set()
                for p, g, k, rest in states:
                    if rest:
                        if rest[0] == c:
                            after.add((p, g, k, rest[1:]))
                        continue
                    more = g + k < edits and g < general
                    if p < n and word[p] == c:
                        after.add((p + 1, g, k, ""))
                        if more and p + 2 <= n:
                            after.add((p + 2, g + 1, k, ""))  # the character after this one is too many
                    if more:
                        after.add((p, g + 1, k, ""))  # a character is missing
                        if p < n:
                            after.add((p + 1, g + 1, k, ""))
                    if g + k < edits and k < confusions:
                        for read, meant in self.meant.get(c, ()):
                            if word.startswith(read, p):
                                after.add((p + len(read), g, k + 1, meant[1:]))
                if after:
                    stack.append((child, frozenset(after)))
        return [(w, k) for w, k in found.items() if w != word]


def meant_words(trie: Trie, corpus: Corpus, token: str, count: int) -> list[tuple[str, bool]]:
    """The words that a misread token may stand for, with whether confusions lead there ("" if it is misread beyond
    retrieval); none if it is not misread."""
    word = token.lower()
    digits, letters = sum(c.isdigit() for c in word), sum(c.isalpha() for c in word)
    marks = len(word) - digits - letters
    if not letters or (not marks and digits and (letters <= digits and len(word) > 2 or re.fullmatch(r"\d+[A-Z]{1,2}|[A-Z]+\d+", token))):
        return []
    if len(word) < 2 or (len(word) > 2 and token.isupper() and len(word) < 4 and not marks) or _ROMAN.fullmatch(word):
        return []
    known = corpus.words.get(word, 0)
    lower = token[0].islower() or not token[0].isalpha()
    out = []
    for w, confusion in trie.candidates(word):
        if corpus.words[w] < TIMES_AS_OFTEN * max(count, known, 1):
            continue
        general = lower and not known and len(word) >= GENERAL_EDIT_LETTERS and word.isalpha() and len(w) >= GENERAL_EDIT_LETTERS
        if not (confusion or general or (digits + marks and len(word) > 3)) or (not lower and len(w) < 4):
            continue
        out.append((w, confusion))
    if not out and not known and len(word) >= TWO_CONFUSIONS_LETTERS:
        out = [(w, True) for w, _ in trie.candidates(word, 0, 2, 2) if corpus.words[w] >= TIMES_AS_OFTEN * max(count, 1)]
    if not out:
        inside = re.search(r"(?<=[a-zà-ÿ])[@|$€0156](?=[a-zà-ÿ])", token)
        return [("", False)] if inside and letters >= 3 and digits + marks == 1 and not known else []
    return out


def _count(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(column).alias("word")).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))


def learn_corpus(rows: DataFrame, paragraphs: DataFrame) -> Corpus:
    """The counts that reach their share of all; only those come to the driver, so their number is bounded."""
    lines = rows.select(F.concat("words", F.when(F.col("first").isNotNull(), F.array(F.concat("first", "second"))).otherwise(F.array().cast("array<string>"))).alias("words"), "compounds")
    texts = paragraphs.select(
        F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)).alias("words"), F.regexp_extract_all(F.lower("text"), F.lit(_COMPOUND), F.lit(0)).alias("compounds"),
    )
    both = lines.unionByName(texts)
    counts = written(_count(both, "words"), "words")
    least = max(KNOWN_LEAST, math.ceil(KNOWN_SHARE * (counts.agg(F.sum("n")).first()[0] or 0)))
    known = {r["word"]: r["n"] for r in counts.filter((F.col("n") >= least) & F.col("word").rlike(r"^\p{L}{2,}$")).collect()}
    compounds = {r["word"]: r["n"] for r in _count(both, "compounds").filter(F.col("n") >= max(2, least // 8)).collect()}
    corpus = Corpus(known, compounds)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: Counter = Counter()
            for t in pdf["text"]:
                pieces = [corpus.name(p) for p in _PIECE.findall(t.lower())]
                found.update(zip(pieces, pieces[1:]))
            yield pd.DataFrame([(a, b, n) for (a, b), n in found.items()], columns=["a", "b", "n"])

    near = written(paragraphs.select("text").mapInPandas(pairs, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    least = max(PAIR_LEAST, math.ceil(PAIR_SHARE * (near.agg(F.sum("n")).first()[0] or 0)))
    corpus.set_pairs({(r["a"], r["b"]): r["n"] for r in near.filter(F.col("n") >= least).collect()})
    return corpus


def known_misread(trie: Trie, corpus: Corpus) -> set[str]:
    """Frequent words that are misread all the same, since the corpus writes what they stand for far more often."""
    return {w for w, n in corpus.words.items() if meant_words(trie, corpus, w, n)}


def misread_words(odd: DataFrame, trie: Trie, corpus: Corpus) -> DataFrame:
    """(word, meant) of all distinct words that are misread; ``odd`` has (word, before, after) of the words not known as right.

    Of several candidates the words beside every occurrence decide.
    """
    seen = written(odd.groupBy("word", "before", "after").agg(F.count("*").alias("n")), "odd-contexts")

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, m, k, corpus.words.get(m, 0)) for w, n in zip(pdf["word"], pdf["n"], strict=True) for m, k in meant_words(trie, corpus, w, n)]
            yield pd.DataFrame(rows, columns=["word", "meant", "confusion", "often"])

    words = seen.groupBy("word").agg(F.sum("n").alias("n"))
    candidates = written(words.mapInPandas(look_up, "word string, meant string, confusion boolean, often long"), "candidates")

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = lambda a, b: math.log1p(corpus.pairs.get((a, b), 0)) if a is not None and b is not None else 0.0
        for pdf in batches:
            pdf["context"] = [n * (near(b, m) + near(m, a)) for n, b, m, a in zip(pdf["n"], pdf["before"], pdf["meant"], pdf["after"], strict=True)]
            yield pdf[["word", "meant", "confusion", "often", "context"]]

    placed = checked_join(seen, candidates, "word").select("word", "before", "after", "n", "meant", "confusion", "often")
    weighed = placed.mapInPandas(weigh, "word string, meant string, confusion boolean, often long, context double")
    summed = weighed.groupBy("word", "meant", "confusion", "often").agg(F.round(F.sum("context"), 6).alias("context"))
    return summed.groupBy("word").agg(F.max(F.struct("confusion", "context", "often", "meant")).alias("best")).select("word", "best.meant")


def _odd_words(df: DataFrame, keys: list[str], right: DataFrame, n_right: int) -> DataFrame:
    """A row for every word of ``words`` that is not known as right, with the words beside it."""
    w, i = F.col("words"), F.col("i")
    rows = checked_join(df.select(*keys, "words", F.posexplode("words").alias("i", "word")).withColumn("right", F.lower("word")), right, "right", "left_anti", rows=n_right, limit=KNOWN_BROADCAST)
    return rows.select(*keys, "word", F.lower(F.get(w, i - 1)).alias("before"), F.lower(F.get(w, i + 1)).alias("after"))


def _of(df: DataFrame, rec: str, noise: str, seq: Column | None = None) -> DataFrame:
    return df.select(F.lit(rec).alias("rec"), "doc_id", (F.col("seq") if seq is None else seq).alias("seq"), F.lit(noise).alias("noise"))


class Scans:
    """The scanned text with what was found in it, as written tables: ``rows`` (lines), ``texts`` (paragraphs), ``misread`` words."""

    def __init__(self, lines: DataFrame, paragraphs: DataFrame, meta: DataFrame, keep_text: bool = False):
        self.spark = lines.sparkSession
        rows = read_lines(lines, meta)
        self.rows = written(rows if keep_text else rows.drop("page", "block", "y0", "x0", "piece", "text"), "scan-lines")
        scans = meta.filter("medium = 'scan'").select("doc_id").distinct()
        texts = paragraphs.select("doc_id", F.col("para_seq").alias("seq"), "text").filter(F.length("text") > 0).join(scans, "doc_id", "left_semi").distinct()
        order = Window.partitionBy("doc_id").orderBy("seq", "text")
        texts = written(texts.withColumn("next", F.lead("text").over(order)), "scan-paragraphs")
        self.corpus = corpus = learn_corpus(self.rows, texts)

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = pdf[["doc_id", "seq"]].copy()
                found = [read_paragraph(corpus, t) for t in pdf["text"]]
                for i, c in enumerate(("header", "page_no", "broken_word", "words", "body")):
                    out[c] = [f[i] for f in found]
                out["continued"] = [_goes_on(corpus, b, t) for b, t in zip(out["body"], pdf["next"], strict=True)]
                yield out

        schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, seq long, header boolean, page_no boolean, broken_word boolean, words array<string>, body string, continued boolean"
        self.texts = written(texts.mapInPandas(read, schema), "read-paragraphs")
        first_half = self.rows.filter("first is not null")
        self.joined = first_half.select("doc_id", "seq", "next_seq", "first", "second", F.concat("first", "second").alias("word"))
        trie = Trie(corpus.words)
        right = sorted(corpus.words.keys() - known_misread(trie, corpus))
        known = self.spark.createDataFrame([(w,) for w in right], "right string")  # bounded as the known words are
        line_words = _odd_words(self.rows.filter("margin is null"), ["doc_id", "seq"], known, len(right)).select(F.lit("line").alias("rec"), "*")
        text_words = _odd_words(self.texts, ["doc_id", "seq"], known, len(right)).select(F.lit("paragraph").alias("rec"), "*")
        self.odd = written(line_words.unionByName(text_words), "odd-words")
        nothing = F.lit(None).cast("string")
        tokens = self.odd.select("word", "before", "after").unionByName(self.joined.select("word", nothing.alias("before"), nothing.alias("after")))
        self.misread = written(misread_words(tokens, trie, corpus), "misread-words")
        self.n_misread = self.misread.count()

    def with_meant(self, df: DataFrame) -> DataFrame:
        return checked_join(df, self.misread, "word", rows=self.n_misread, limit=SUSPECTS_BROADCAST)

    def divided(self) -> DataFrame:
        """The cut words at line ends that the corpus writes without a hyphen."""
        corpus = self.corpus
        halves = self.joined.filter(~F.lower("second").isin(*HANGING)).withColumn("compound", F.lower(F.concat_ws("-", "first", "second")))
        kept = [(c,) for c, n in corpus.compounds.items() if corpus.words.get(c.replace("-", ""), 0) <= n]
        compounds = self.spark.createDataFrame(kept, "compound string")  # bounded as the known words are
        return checked_join(halves, compounds, "compound", "left_anti", rows=len(kept)).select(self.joined.columns)

    def noise(self) -> DataFrame:
        found = self.rows.filter("margin is not null").select(F.lit("line").alias("rec"), "doc_id", "seq", F.col("margin").alias("noise"))
        found = found.unionByName(_of(self.divided(), "line", "broken_word"))
        second = (F.col("meant") != "") & F.startswith("meant", F.lower("first"))  # the first half is right
        found = found.unionByName(_of(self.with_meant(self.joined), "line", "misread", F.when(second, F.col("next_seq")).otherwise(F.col("seq"))))
        found = found.unionByName(self.with_meant(self.odd).select("rec", "doc_id", "seq", F.lit("misread").alias("noise")))
        flags = F.array(*(F.when(F.col(c), F.lit(c)) for c in ("header", "page_no", "broken_word", "continued")))
        kinds = self.texts.select(F.lit("paragraph").alias("rec"), "doc_id", "seq", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("noise"))
        return found.unionByName(kinds).distinct()

    def repaired(self) -> DataFrame:
        """(rec, doc_id, para_no, text): continuous paragraphs without furniture, cut words joined, misread words corrected."""
        whole = self.divided().select("doc_id", "seq", F.lit(True).alias("divided"))
        body = self.rows.filter("margin is null").join(whole, ["doc_id", "seq"], "left")
        end = F.when(F.col("first").isNotNull(), F.concat("first", F.when(F.col("divided"), "").otherwise("-"), "second")).otherwise("")
        reading = Window.partitionBy("doc_id").orderBy("page", "y0", "x0", "seq")
        same = (F.lead("page").over(reading) == F.col("page")) & F.lead("block").over(reading).eqNullSafe(F.col("block"))
        over = ~F.col("text").rlike(r"[.!?;:”»]$") & F.lead("text").over(reading).rlike(r"^[\p{Ll}\d@]")
        parts = body.select(
            F.lit("line").alias("rec"), "doc_id", "seq", F.row_number().over(reading).alias("place"), F.concat("piece", end).alias("text"), F.coalesce(same | over, F.lit(False)).alias("continued"),
        )
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "body"))
        parts = parts.unionByName(self.texts.select(F.lit("paragraph").alias("rec"), "doc_id", "seq", place.alias("place"), F.col("body").alias("text"), "continued"))
        wrong = self.odd.select("rec", "doc_id", "seq", "word").unionByName(self.joined.select(F.lit("line").alias("rec"), "doc_id", "seq", "word"))
        wrong = self.with_meant(wrong).filter("meant <> ''").distinct()
        fixes = wrong.groupBy("rec", "doc_id", "seq").agg(F.map_from_entries(F.collect_list(F.struct("word", "meant"))).alias("fixes"))
        parts = parts.join(fixes, ["rec", "doc_id", "seq"], "left").withColumn("text", _corrected("text", "fixes"))
        before = Window.partitionBy("rec", "doc_id").orderBy("place")
        parts = parts.withColumn("para_no", F.sum(F.when(F.lag("continued", 1, False).over(before), 0).otherwise(1)).over(before).cast("int") - 1)
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ")
        return parts.groupBy("rec", "doc_id", "para_no").agg(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")).alias("text"))


def _goes_on(corpus: Corpus, body: str, following: str | None) -> bool:
    """Whether a paragraph goes on in the next one: it ends no sentence, and the body of the next begins none."""
    if not isinstance(following, str) or not body or body.endswith((".", "!", "?", ";", ":", "”", "»")):
        return False
    return bool(re.match(r"[^\W\d_A-ZÀ-Ý]|\d|@", read_paragraph(corpus, following)[4]))


@F.pandas_udf(T.StringType())
def _corrected(text: pd.Series, fixes: pd.Series) -> pd.Series:
    def one(t: str, f: dict | None) -> str:
        if not f:
            return t
        pattern = re.compile(r"(?<![\w@!|$€])(?:" + "|".join(re.escape(w) for w in sorted(f, key=len, reverse=True)) + r")(?![\w@|$€])")
        return pattern.sub(lambda m: f[m.group()].capitalize() if m.group()[0].isupper() else f[m.group()], t)

    return pd.Series([one(t, dict(f) if f is not None else None) for t, f in zip(text, fixes, strict=True)])


def find_noise(lines: DataFrame, paragraphs: DataFrame, meta: DataFrame) -> DataFrame:
    """(rec, doc_id, seq, noise): one row per kind of noise in every line and paragraph of a scan."""
    return Scans(lines, paragraphs, meta).noise()


def repair_scans(lines: DataFrame, paragraphs: DataFrame, meta: DataFrame) -> DataFrame:
    """(rec, doc_id, para_no, text): the scanned documents as continuous readable paragraphs."""
    return Scans(lines, paragraphs, meta, keep_text=True).repaired()
