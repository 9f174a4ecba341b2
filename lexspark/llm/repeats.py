"""Problem 1: lines that one site repeats over its documents.

Texts are cut into content-defined chunks: a rolling hash over a window of bytes cuts wherever its low bits are zero, never
at a line end as such, so equal passages are cut alike whatever stands beside them and wherever they are wrapped. Spark
counts the distinct documents of every chunk within its source; chunks that stand in too many are repeated.

Lines: the text of a line is reduced to what does not vary (letters in lower case; numbers, dates and personal names as
placeholders). The chunks that lie within the reduced line, between two cuts that its own bytes decide, are the same in
every document that has the line; a line with a chunk there that isn't repeated is none. The lines that are left, and those
too short to hold a chunk, are then counted whole, as the problem is stated by line. Documents: the found lines go, then the
chunks of the remaining text, read on from line to line, that their source repeats.

Defined results: documents that are not of the wanted medium, null sources, null texts and texts without a letter or
number are never found; repeated rows of one (doc_id, seq) count once, in the cut documents with the greatest text; empty
tables give an empty result; other columns, also those of the same name in both tables, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lexspark.session import checked_join, partitions, written

SHARE, LEAST_DOCS = 0.25, 3
WINDOW, MASK = 8, 15
#: Of passages: cuts only at word ends, so a smaller mask; characters of a chunk that may be cut; lines that one task reads on.
WORD_MASK, LEAST_PASSAGE, SEGMENT = 7, 24, 4096

# Names of months as bylines and notices write them.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre",
)

_GEAR = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def invariant_text(text: Column) -> Column:
    """The part of a line that stays the same from page to page. Patterns run only over lines with what they look for."""
    months = "|".join(MONTHS)
    word = r"\p{L}[\p{L}.'’-]*"

    def numbers(t: Column) -> Column:
        t = F.regexp_replace(t, r"(?U)\d+(?:[.,:/\s]*\d+)*(?:st|nd|rd|th|er)?\b", "0")
        return F.regexp_replace(t, rf"(?U)(?:0[\s,]*)?\b(?:{months})\b[\s,.]*0(?:[\s,]*0)*", "0")  # month with day or year

    def bylines(t: Column) -> Column:
        return F.regexp_replace(t, rf"(?U)\b(by|par)\s+{word}(?:\s+{word}){{0,2}}(?=\s*(?:$|[,;|·–—(]))", "$1 N")

    def dated(t: Column) -> Column:
        return F.regexp_replace(t, rf"(?U)^[^\p{{L}}0]*{word}(?:\s+{word}){{1,2}}\s*(?=[|·,–—]\s*0)", "N ")  # a name before a date

    lower = F.lower(text)
    digits, named = lower.rlike(r"\p{Nd}"), F.contains(lower, F.lit("by")) | F.contains(lower, F.lit("par"))
    t = F.when(digits & named, dated(bylines(numbers(lower)))).when(digits, dated(numbers(lower))).when(named, bylines(lower)).otherwise(lower)
    return F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")


def _rolling(gear: np.ndarray) -> np.ndarray:
    rolling = np.zeros(len(gear), np.uint64)
    for k in range(min(WINDOW, len(gear))):
        rolling[k:] += gear[: len(gear) - k] << np.uint64(k)
    return rolling >> np.uint64(7)


def _hashed(gear: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of every chunk from ``begin`` to ``stop`` that depends on its content alone."""
    powers = np.cumprod(np.full(len(gear), _BASE, np.uint64), dtype=np.uint64)
    inverse = np.cumprod(np.full(len(gear), _INVERSE, np.uint64), dtype=np.uint64)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(gear * powers, dtype=np.uint64)])
    hashed = (prefix[stop] - prefix[begin]) * inverse[begin]
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    return hashed.view(np.int64)


def chunk_hashes(texts: pa.Array) -> pa.Array:
    """Hashes of the content-defined chunks within every text, one list per text.

    A chunk lies between two cuts whose windows are within the text, so the head and the tail of a text are in none.
    """
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.empty(0, np.uint8)
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    if not len(data):
        return pa.array([[] for _ in range(len(texts))], pa.list_(pa.int64()))
    gear = _GEAR[data]
    within = np.arange(len(data)) - np.repeat(starts, ends - starts)
    stop = np.flatnonzero((_rolling(gear) & np.uint64(MASK) == 0) & (within >= WINDOW - 1)) + 1
    owner = np.searchsorted(ends, stop, "left")  # the text whose last byte or an earlier one the cut follows
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    hashed = _hashed(gear, stop[inner], stop[inner + 1])
    held = np.bincount(owner[inner], minlength=len(texts))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32()), pa.array(hashed))


chunk_hashes_udf = arrow_udf(chunk_hashes, T.ArrayType(T.LongType()))


def repeated_chunks(keyed: DataFrame, per_source: DataFrame, chunks: str, share: float, least: int) -> DataFrame:
    """(source, chunk) that stand in at least ``share`` of the documents of their source and in ``least``."""
    pairs = keyed.select("source", "doc_id", F.explode(chunks).alias("chunk")).distinct()
    often = pairs.groupBy("source", "chunk").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return checked_join(often, per_source, "source").filter(F.col("n") >= share * F.col("docs")).select("source", "chunk")


def find_repeated_lines(lines: DataFrame, meta: DataFrame, medium: str = "web", share: float = SHARE, least: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, seq) of the lines of documents of ``medium`` that their source repeats excessively."""
    pages = meta.filter((F.col("medium") == medium) & F.col("source").isNotNull()).select("doc_id", F.xxhash64("source").alias("source")).distinct()
    per_source = pages.groupBy("source").agg(F.count_distinct("doc_id").alias("docs"))
    keyed = lines.select("doc_id", "seq", "text").join(pages, "doc_id").select("doc_id", "seq", "source", invariant_text(F.col("text")).alias("key"))
    keyed = keyed.filter(F.length("key") > 0).select("doc_id", "seq", "source", F.xxhash64("key").alias("line"), chunk_hashes_udf("key").alias("chunks"))
    keyed = written(keyed.withColumn("chunks", F.array_distinct("chunks")).distinct(), "line-chunks")

    often = written(repeated_chunks(keyed, per_source, "chunks", share, least), "repeated-chunks")
    parts = keyed.filter(F.size("chunks") > 0).select("doc_id", "seq", "source", "line", F.size("chunks").alias("size"), F.explode("chunks").alias("chunk"))
    full = checked_join(parts, often, ["source", "chunk"]).groupBy("doc_id", "seq", "source", "line").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    short = keyed.filter(F.size("chunks") == 0).select("doc_id", "seq", "source", "line")
    candidates = written(full.filter("n = size").select("doc_id", "seq", "source", "line").unionByName(short), "repeated-candidates")

    whole = repeated_chunks(candidates.withColumn("lines", F.array("line")), per_source, "lines", share, least)
    whole = written(whole.withColumnRenamed("chunk", "line"), "repeated-lines")
    return checked_join(candidates, whole, ["source", "line"], "left_semi").select("doc_id", "seq").distinct()


def passage_chunks(documents: np.ndarray, texts: list[str]) -> tuple[np.ndarray, ...]:
    """The chunks of texts that are read on within a document: (text, from, to, chunk, length), a row for every text that a
    chunk has a part in. Letters and numbers count, in lower case and with one sign for a number; a chunk ends with a word."""
    joined = "".join(texts)
    if not joined:
        return (np.empty(0, np.int64),) * 5
    sign = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    text_of = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], ends])))
    kinds, at = np.unique(sign, return_inverse=True)
    letters = [chr(c) for c in kinds.tolist()]
    digit = np.array([c.isdigit() for c in letters])[at]
    after_digit = np.concatenate([[False], digit[:-1] & (text_of[1:] == text_of[:-1])])
    place = np.flatnonzero(np.array([c.isalnum() for c in letters])[at] & ~(digit & after_digit))
    if not len(place):
        return (np.empty(0, np.int64),) * 5
    read = np.array([ord("0") if c.isdigit() else ord(c.lower()[0]) for c in letters], np.int64)[at][place]
    gear = _GEAR[(read * 2654435761 >> 7) & 255]
    text, document = text_of[place], documents[text_of[place]]
    new = np.concatenate([[True], document[1:] != document[:-1]])
    first = np.flatnonzero(new)
    within = np.arange(len(place)) - first[np.cumsum(new) - 1]
    gap = np.diff(place)
    word_end = np.concatenate([(gap > 1) & ~after_digit[np.minimum(place[:-1] + 1, len(sign) - 1)] | (text[1:] != text[:-1]), [True]])
    cut = (_rolling(gear) & np.uint64(WORD_MASK) == 0) & (within >= WINDOW - 1) & word_end
    cut[np.append(first[1:] - 1, len(place) - 1)] = True
    stop = np.flatnonzero(cut) + 1
    begin = np.concatenate([[0], stop[:-1]])
    hashed, length = _hashed(gear, begin, stop), stop - begin
    chunk = np.repeat(np.arange(len(stop)), length)
    part = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(part[1:], len(place)) - 1
    start_of = np.concatenate([[0], ends[:-1]])[text[part]]
    return text[part], place[part] - start_of, place[last] + 1 - start_of, hashed[chunk[part]], length[chunk[part]]


def repeated_passages(lines: DataFrame, share: float = SHARE, least: int = LEAST_DOCS, least_chars: int = LEAST_PASSAGE) -> DataFrame:
    """(doc_id, seq, from, to) of the parts of ``lines`` (doc_id, source, seq, text), one row a key, that stand in chunks which
    the source repeats over its documents, wherever the lines end."""
    per_source = lines.groupBy("source").agg(F.count_distinct("doc_id").alias("docs"))
    # a document is read on in segments of its lines, so that one of any length is the work of many tasks
    order = ["doc_id", "segment", "seq"]
    rows = lines.withColumn("segment", F.floor(F.col("seq") / SEGMENT)).repartition(partitions(lines.sparkSession), "doc_id", "segment").sortWithinPartitions(*order)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pydict()
            new = [a != b for a, b in zip(zip(table["doc_id"], table["segment"], strict=True), [None, *zip(table["doc_id"], table["segment"], strict=True)])]
            text, low, high, chunk, length = passage_chunks(np.cumsum(new), table["text"])
            columns = [batch.column(c).take(pa.array(text)) for c in ("doc_id", "source", "seq")]
            numbers = [pa.array(x, t) for x, t in ((low, pa.int32()), (high, pa.int32()), (chunk, pa.int64()), (length, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns + numbers, ["doc_id", "source", "seq", "from", "to", "chunk", "length"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "source", "seq"))
    parts = written(rows.select("doc_id", "source", "seq", "segment", "text").mapInArrow(chunks, f"{kinds}, from int, to int, chunk long, length int").filter(F.col("length") >= least_chars), "passages")
    often = written(repeated_chunks(parts.withColumn("chunks", F.array("chunk")), per_source, "chunks", share, least), "repeated-passages")
    return checked_join(parts, often, ["source", "chunk"], "left_semi").select("doc_id", "seq", "from", "to")


def _without(text: Column, ranges: Column) -> Column:
    """``text`` without the sorted ranges (from, to), which don't overlap."""
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))


    def cut(acc: Column, r: Column) -> Column:
        return F.struct(F.concat(acc["kept"], F.substring(text, acc["at"] + 1, r["from"] - acc["at"])).alias("kept"), r["to"].alias("at"))

    return F.aggregate(ranges, start, cut, lambda acc: F.concat(acc["kept"], F.substring(text, acc["at"] + 1, F.length(text))))


def cut_repeated_lines(lines: DataFrame, meta: DataFrame, medium: str = "web", share: float = SHARE, least: int = LEAST_DOCS) -> DataFrame:
    """The documents without what their source repeats: (doc_id, n_lines, n_cut, n_chars_cut, text), text in reading order.

    ``n_cut`` lines were found whole; ``n_chars_cut`` characters of the other lines stand in repeated passages.
    """
    found = find_repeated_lines(lines, meta, medium, share, least).withColumn("found", F.lit(True))
    rows = written(lines.groupBy("doc_id", "seq").agg(F.max("text").alias("text")).join(found, ["doc_id", "seq"], "left"), "marked-lines")
    pages = meta.filter((F.col("medium") == medium) & F.col("source").isNotNull()).groupBy("doc_id").agg(F.xxhash64(F.min("source")).alias("source"))
    left = rows.filter("found is null and text is not null").join(pages, "doc_id").select("doc_id", "source", "seq", "text")
    ranges = repeated_passages(left, share, least).groupBy("doc_id", "seq").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("ranges"))
    cut = rows.join(ranges, ["doc_id", "seq"], "left").withColumn("rest", F.when(F.col("ranges").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("ranges"))))
    chars = F.coalesce(F.sum(F.length("text") - F.length("rest")), F.lit(0)).alias("n_chars_cut")
    kept = F.sort_array(F.collect_list(F.when(F.col("found").isNull() & F.col("rest").isNotNull() & (F.col("ranges").isNull() | F.col("rest").rlike(r"[\p{L}\p{N}]")), F.struct("seq", F.col("rest").alias("text")))))
    return cut.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count("found").alias("n_cut"), chars, F.array_join(F.transform(kept, lambda x: x["text"]), "\n").alias("text"))
