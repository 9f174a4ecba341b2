"""Problem 4: cut oversized texts at natural boundaries, by byte ranges.

A text, in a column or in a file, is read in byte ranges with halos on both sides; no task needs a whole file. Workers find
the boundaries of their own range. Since a piece depends only on the boundaries within the limit after its start, every
range also knows, for each place at which a piece may enter it, the place at which the pieces leave it and their number.
These tables are stitched from range to range, with the lengths in characters summed, which gives the place and number of
the first piece of every range; then all ranges emit their pieces at once.

Defined results: null texts and texts within the limit have no pieces; repeated rows of one key count once (the longest
text, then the greatest); null keys are keys of their own; an empty table gives an empty result; other columns are ignored.
The halo before a range grows until it holds something other than white space; texts are UTF-8.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.session import partitions, written

LIMIT, LEAST, OVERLAP = 1200, 400, 200
RANGE_BYTES, HALO = 262_144, 512
#: Bytes of a character at most, bytes a halo grows by at once, and where the pieces of a text that has ended go on.
WIDEST_CHARACTER, HALO_STEP, ENDED = 4, 65_536, 2**30

# Abbreviations after which a full stop ends no sentence, words that refer to a label, and words between labels.
ABBREVIATIONS = frozenset("s ss art arts no nos ch c v vs al par para pars subs subpar cl p pp vol ed cf etc mr mrs ms dr st m mm mme mlle me jr sr hon r rev stat".split())
REFERRING = frozenset(
    "paragraph paragraphs subparagraph subparagraphs subsection subsections section sections clause clauses subclause subclauses item items part schedule form "
    "paragraphe paragraphes alinéa alinéas sous-alinéa sous-alinéas article articles disposition division partie annexe formule "
    "to through à au aux".split()
)
CONNECTING = frozenset("and or to through et ou à au of de du des".split())
JOINING = frozenset("and or et ou".split())

_LABEL = re.compile(r"(?<!\S)\((?:[a-z]{1,4}|[a-z]\.\d+|\d+(?:\.\d+)*)\)(?=\s+(\w[\w’'-]*))")
_SENTENCE = re.compile(r"[.!?…]+[)\]\"'”’»]*\s+(?=[\"'“‘«(\[]*\s?\w)")
_BREAK = re.compile(r"[\n\r\x0b\x0c\x85  ]\s*(?=\S)")
_WORD = re.compile(r"(?<=\s)\S")
_LINE_BREAKS = re.compile(r"[\n\r\x0b\x0c\x85  ]")


def _last_word(text: str, end: int) -> str:
    """The word before ``end``, however much white space stands between."""
    while end and text[end - 1].isspace():
        end -= 1
    start = end
    while start and not text[start - 1].isspace() and end - start < HALO:
        start -= 1
    return text[start:end]


def _abbreviates(token: str) -> bool:
    """Whether the token before a full stop is an abbreviation: a known one, initials or a single letter."""
    last = token.lstrip("([\"'“‘«").rsplit("’", 1)[-1].rsplit("'", 1)[-1]
    last = last.rsplit(".", 1)[-1]
    return last.lower() in ABBREVIATIONS or (len(last) == 1 and last.isalpha())


def _is_label(text: str, m: re.Match) -> bool:
    at = m.start()
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    stem = text[max(0, end - HALO) : end]
    if not stem or _LINE_BREAKS.search(text, end, at):
        return True
    follows = m.group(1).lower()
    if follows in CONNECTING and not stem.endswith((".", ";", ":")):
        return False
    if stem.endswith("."):
        return not _abbreviates(_last_word(stem, len(stem) - 1))
    if stem[-1] in ";:,!?—–":
        return True
    word = _last_word(stem, len(stem)).lower()
    word = word.rsplit("’", 1)[-1].rsplit("'", 1)[-1]
    if word in JOINING:
        return stem[: -len(word)].rstrip().endswith((";", ","))
    return word not in REFERRING and not stem.endswith(")")


def natural_boundaries(text: str) -> list[int]:
    """Positions of the first characters of sentences, labels and lines of a text (position 0 is none)."""
    out = {m.end() for m in _BREAK.finditer(text)}
    out.update(m.start() for m in _LABEL.finditer(text) if m.start() and _is_label(text, m))
    for m in _SENTENCE.finditer(text):
        at = m.end()
        first = next((c for c in text[at : at + 4] if c.isalnum()), "")
        if text[at] == "(" and _LABEL.match(text, at):
            continue  # decided as a label
        if first.isupper() and not (text[m.start()] == "." and text[m.start() : m.start() + 2] != ".." and _abbreviates(_last_word(text, m.start()))):
            out.add(at)
    return sorted(out)


def _range_boundaries(data: bytes, lead: int, own: int) -> tuple[int, np.ndarray, np.ndarray, int]:
    """Of a range with halos: its number of characters, the natural boundaries and word starts of it and of the halo after it
    counted from its start, and the number of characters up to the end of that halo.

    ``lead`` bytes come before the range and ``own`` bytes are in it; a character belongs to the range of its first byte.
    """
    start, stop = _character(data, lead), _character(data, lead + own)
    before, mine = data[_character(data, 0) : start].decode("utf-8", "replace"), data[start:stop].decode("utf-8", "replace")
    text, skip = before + mine + data[stop:].decode("utf-8", "ignore"), len(before)
    bounds = [b - skip for b in natural_boundaries(text) if b >= skip]
    words = [m.start() - skip for m in _WORD.finditer(text, skip)]
    return len(mine), np.array(bounds, np.int64), np.array(words, np.int64), len(text) - skip


def _character(data: bytes, at: int) -> int:
    """The first place from ``at`` on where a character begins; at the very start of a text it is ``at``."""
    stop = at
    while at and stop < len(data) and stop < at + WIDEST_CHARACTER and data[stop] & 0xC0 == 0x80:
        stop += 1
    return stop


class Cutting(NamedTuple):
    limit: int
    least: int
    overlap: int

    def steps(self, starts: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces that begin at ``starts`` and aren't the last: where they end, and where the next ones begin."""
        high = starts + self.limit
        end = _between(bounds, starts + self.least, high, True)
        end = np.where(end < 0, _between(words, starts + self.least, high, True), end)
        end = np.where(end < 0, high, end)
        begin = _between(bounds, end - self.overlap, end - 1, False)
        begin = np.where(begin < 0, _between(words, end - self.overlap, end - 1, False), begin)
        return end, np.where(begin < 0, end - self.overlap, begin)

    def crossing(self, n: int, total: int, last: bool, bounds: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry, a place of the first ``limit`` characters of a range of ``n``: where its pieces leave the range,
        counted from its end, and how many begin in it. ``last`` says that the text ends with the halo, ``total`` characters on."""
        width, place = min(self.limit, n), np.arange(n)
        goes_on = place + self.limit < total if last else np.ones(n, bool)
        after = np.full(n, n + ENDED, np.int64)
        after[goes_on] = self.steps(place[goes_on], bounds, words)[1]
        leaves, count = after.copy(), np.ones(n, np.int64)
        while (inside := np.flatnonzero(leaves[:width] < n)).size:  # twice as many pieces each time
            reached = leaves < n
            to = leaves[reached]
            count[reached] += count[to]
            leaves[reached] = leaves[to]
        return leaves[:width] - n, count[:width]

    def pieces(self, start: int, n: int, total: int, last: bool, bounds: np.ndarray, words: np.ndarray) -> tuple[list[int], list[int]]:
        """The pieces that begin in a range, from the entry ``start`` on."""
        starts, ends = [], []
        bounds, words = bounds.tolist(), words.tolist()
        while start < n:
            starts.append(start)
            if last and total - start <= self.limit:
                ends.append(total)
                break
            low, high = start + self.least, start + self.limit
            end = _one(bounds, low, high, True) or _one(words, low, high, True) or high
            ends.append(end)
            start = _one(bounds, end - self.overlap, end - 1, False) or _one(words, end - self.overlap, end - 1, False) or end - self.overlap
        return starts, ends


def _between(positions: np.ndarray, low: np.ndarray, high: np.ndarray, last: bool) -> np.ndarray:
    """Of each interval the last or first of the positions in it, -1 where there is none."""
    a, b = np.searchsorted(positions, low, "left"), np.searchsorted(positions, high, "right")
    return np.where(a == b, -1, np.append(positions, -1)[b - 1 if last else np.minimum(a, len(positions))])


def _one(positions: list[int], low: int, high: int, last: bool) -> int | None:
    """The same of one interval; null where there is none. A piece neither ends nor goes on at 0."""
    a, b = bisect_left(positions, low), bisect_right(positions, high)
    return None if a == b else positions[b - 1 if last else a]


def _decided(ranges: DataFrame, keys: list[str], cutting: Cutting) -> DataFrame:
    """The boundary tables of ranges (keys, range_no, lead, own, last, data)."""
    kept = ranges.select(*keys, "range_no", "last").schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for data, lead, own, no, last in zip(pdf["data"], pdf["lead"], pdf["own"], pdf["range_no"], pdf["last"], strict=True):
                n, bounds, words, total = _range_boundaries(bytes(data), lead, own)
                # a text of one range is entered at its start, so it needs no table of entries
                leaves, count = cutting.crossing(n, total, last, bounds, words) if no or lead + own < len(data) else (np.empty(0, np.int64),) * 2
                rows.append((n, total, bounds, words, leaves, count))
            out = pdf[[*keys, "range_no", "last"]].copy()
            for i, c in enumerate(("n_chars", "total", "bounds", "words", "leaves", "count")):
                out[c] = [r[i] for r in rows]
            yield out

    return ranges.mapInPandas(decide, f"{ddl}, n_chars long, total long, bounds array<int>, words array<int>, leaves array<int>, count array<int>")


def _entries(tables: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, range_no, offset, entry, first_no): the characters before every range, and its first piece."""
    stitched = tables.select(*keys, "range_no", "n_chars", "leaves", "count").repartition(*keys).sortWithinPartitions(*keys, "range_no")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stitched.select(*keys, "range_no").schema)

    def stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, offset, entry, number = None, 0, 0, 1
        for pdf in batches:
            rows = []
            columns = [pdf[k].astype(object).where(pdf[k].notna(), None) for k in keys]
            for *k, no, n, leaves, count in zip(*columns, pdf["range_no"], pdf["n_chars"], pdf["leaves"], pdf["count"], strict=True):
                if k != key or no == 0:
                    key, offset, entry, number = k, 0, 0, 1
                rows.append((*k, no, offset, entry, number))
                offset += n
                if entry < len(leaves):
                    entry, number = int(leaves[entry]), number + int(count[entry])
                else:
                    entry -= n  # no piece begins in a range that is shorter than a piece
            yield pd.DataFrame(rows, columns=[*keys, "range_no", "offset", "entry", "first_no"])

    return stitched.mapInPandas(stitch, f"{ddl}, offset long, entry long, first_no int")


def split_ranges(ranges: DataFrame, keys: list[str], cutting: Cutting) -> DataFrame:
    """(keys, piece_no, start_pos, end_pos) of texts given as ranges (keys, range_no, lead, own, last, data)."""
    tables = written(_decided(ranges, keys, cutting), "boundaries")
    a, b = tables.alias("a"), _entries(tables, keys).alias("b")
    on = [F.col("a.range_no") == F.col("b.range_no"), *(F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)]
    rows = a.join(b, on).select(*(f"a.{k}" for k in keys), "n_chars", "total", "last", "bounds", "words", "offset", "entry", "first_no")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            columns = (pdf[c] for c in ("offset", "entry", "n_chars", "total", "last", "bounds", "words"))
            found = [([], []) if not o and last and t <= cutting.limit else cutting.pieces(int(e), n, t, last, b, w) for o, e, n, t, last, b, w in zip(*columns, strict=True)]
            held = [len(s) for s, _ in found]
            out = pdf[keys].loc[pdf.index.repeat(held)].reset_index(drop=True)
            offset = np.repeat(pdf["offset"].to_numpy(), held)
            out["piece_no"] = np.concatenate([np.arange(n) + f for n, f in zip(held, pdf["first_no"], strict=True)]).astype(np.int32) if found else []
            for i, c in enumerate(("start_pos", "end_pos")):
                out[c] = np.concatenate([np.array(f[i], np.int64) for f in found]) + offset if found else []
            yield out

    return rows.mapInPandas(emit, f"{ddl}, piece_no int, start_pos long, end_pos long")


def split_oversized(
    chunks: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_seq"), text_col: str = "text", limit: int = LIMIT, least: int = LEAST,
    overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """(keys, piece_no, start_pos, end_pos) of every text of more than ``limit`` characters in a column."""
    cutting, keys = _cutting(limit, least, overlap, range_bytes), list(keys)
    long = chunks.filter(F.length(text_col) > limit).groupBy(*keys).agg(F.max(F.struct(F.length(text_col).alias("n"), F.col(text_col).alias("t"))).alias("r"))
    data = long.select(*keys, F.encode(F.col("r.t"), "utf-8").alias("data"))
    no_of_last = F.floor((F.length("data") - 1) / range_bytes).cast("int")
    ranges = data.select(*keys, "data", no_of_last.alias("no_of_last"), F.explode(F.sequence(F.lit(0), no_of_last)).alias("range_no"))
    low = F.col("range_no") * range_bytes
    # a halo of white space alone is replaced by one that goes back to the last other character
    halo = F.substring("data", F.greatest(low - HALO, F.lit(0)) + 1, F.least(low, F.lit(HALO))).cast("string")
    upto = F.encode(F.regexp_replace(F.substring("data", F.lit(1), low).cast("string"), r"(?U)\s+$", ""), "utf-8")
    lead = F.when(low == 0, 0).when(halo.rlike(r"(?sU)\S.*\S"), F.least(low, F.lit(HALO))).otherwise(low - F.greatest(F.length(upto) - HALO, F.lit(0)))
    own = F.least(F.lit(range_bytes), F.length("data") - low)
    ranges = ranges.withColumns({"lead": lead.cast("int"), "own": own, "last": low + own + _after(limit) >= F.length("data")})
    cut = F.substring("data", low - F.col("lead") + 1, F.col("lead") + F.col("own") + _after(limit))
    ranges = ranges.select(*keys, "range_no", "lead", "own", "last", cut.alias("data"))
    return split_ranges(ranges.repartition(partitions(chunks.sparkSession), *keys, "range_no"), keys, cutting)  # the ranges of a giant text go to all workers


def split_files(files: DataFrame, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, piece_no, start_pos, end_pos) of UTF-8 files (path, length) of more than ``limit`` characters.

    Each task opens the file and reads its range and halos by offset, so a file of any size is the work of all cores. Paths
    are those of a file system that all executors reach; ``files`` may be read by the ``binaryFile`` source without content.
    """
    cutting = _cutting(limit, least, overlap, range_bytes)
    no_of_last = F.floor((F.col("length") - 1) / range_bytes).cast("int")
    rows = files.filter(F.col("length") > limit).select("path", "length", F.explode(F.sequence(F.lit(0), no_of_last)).alias("range_no"))
    rows = rows.repartition(partitions(files.sparkSession), "path", "range_no")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, length, no in pdf.itertuples(index=False):
                low = int(no) * range_bytes
                own = min(range_bytes, int(length) - low)
                with _opened(path) as f:
                    lead = min(low, HALO)
                    while lead < low and len(f.read_at(lead, low - lead).decode("utf-8", "ignore").split()) < 2:
                        lead = min(low, lead + HALO_STEP)
                    data = f.read_at(min(lead + own + _after(limit), int(length) - low + lead), low - lead)
                yield pd.DataFrame([(path, no, lead, own, low + own + _after(limit) >= length, data)], columns=["path", "range_no", "lead", "own", "last", "data"])

    ranges = rows.mapInPandas(read, "path string, range_no int, lead int, own int, last boolean, data binary")
    return split_ranges(ranges, ["path"], cutting)


def _opened(path: str):
    system, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def _after(limit: int) -> int:
    """Bytes of the halo after a range: one piece, and what tells whether a boundary is one."""
    return limit * WIDEST_CHARACTER + HALO


def _cutting(limit: int, least: int, overlap: int, range_bytes: int) -> Cutting:
    if not 0 <= overlap < least <= limit or range_bytes < 1:
        raise ValueError("needs 0 <= overlap < least <= limit and ranges of a byte or more")
    return Cutting(limit, least, overlap)


def cut_text(chunks: DataFrame, pieces: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_seq"), carried: tuple[str, ...] = ("section", "subsection")) -> DataFrame:
    """The pieces with their text and the citation of their chunk."""
    long = chunks.filter(F.length("text") > LIMIT).groupBy(*keys).agg(F.max(F.struct(F.length("text").alias("n"), "text", *carried)).alias("r"))
    b = long.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    text = F.substring("b.r.text", (F.col("a.start_pos") + 1).cast("int"), (F.col("a.end_pos") - F.col("a.start_pos")).cast("int"))
    return pieces.alias("a").join(b, on).select("a.*", *(F.col(f"b.r.{c}").alias(c) for c in carried), text.alias("text"))
