"""BM25 in two ways of equal results.

``search`` asks an inverted index of postings with their impact, where a query is a join and a sum: for a few questions
against an index that is kept. ``search_texts`` answers a whole set of questions in one reading of the texts, which never
move: most texts share some common word with most of many questions, and postings would shuffle all these pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexspark.functions.text import tokenize
from lexspark.session import BROADCAST_ROWS, checked_join

K1, B = 1.5, 0.75
#: Scores equal by construction differ in the last bits with the order of summation; ranking looks at so many decimals.
DECIMALS = 9
#: Parts of the postings of one term where there are too many question terms to broadcast.
SALTS = 16
#: Questions that one reading of the texts answers; more questions take more readings.
QUERIES_PER_PASS = 512
#: Cells of the matrix of texts and question terms, or of texts and questions, that a task holds at once.
CELLS = 2_000_000


def term_counts(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, term, tf)."""
    return texts.select(*keys, F.explode(tokenize(F.col(text))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def lengths(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, len): tokens of every text, empty ones too."""
    return texts.select(*keys, F.size(tokenize(F.col(text))).cast("long").alias("len"))


def idf_table(counts: DataFrame, n: DataFrame) -> DataFrame:
    """(term, df, idf); ``n`` is one row (n) with the number of all texts."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.join(F.broadcast(n)).select("term", "df", idf.alias("idf"))  # n is one row


def build_postings(texts: DataFrame, keys: list[str], text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(term, keys, tf, impact): what one occurrence of the term in a query adds to the score of the text."""
    tokens = texts.select(*keys, tokenize(F.col(text)).alias("tokens"))
    sized = tokens.select(*keys, F.size("tokens").cast("long").alias("len"), "tokens")
    whole = sized.agg(F.count("*").alias("n"), F.avg("len").alias("average"))
    counts = sized.select(*keys, "len", F.explode("tokens").alias("term")).groupBy(*keys, "len", "term").agg(F.count("*").alias("tf"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    rows = counts.join(df, "term").join(F.broadcast(whole))  # whole is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("average"))
    return rows.select("term", *keys, "tf", (idf * F.col("tf") * (k1 + 1) / norm).alias("impact"))


def scores(queries: DataFrame, postings: DataFrame, query_key: str, keys: list[str], question: str = "question") -> DataFrame:
    """(query_key, keys, score); a term that a query repeats counts as often, a term without postings not at all."""
    terms = queries.select(query_key, F.explode(tokenize(F.col(question))).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
    if (n := terms.count()) <= BROADCAST_ROWS:
        hits = checked_join(postings, terms, "term", rows=n)
    else:  # the postings of a common word are split, so that no task holds them all
        salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = postings.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"])
    return hits.groupBy(query_key, *keys).agg(F.sum(F.col("impact") * F.col("qtf")).alias("score"))


def top_k(scored: DataFrame, query_key: str, keys: list[str], k: int, score: str = "score", decimals: int = DECIMALS) -> DataFrame:
    """The k best of each query, rank ``rk`` from 1; equal rounded scores go by the keys."""
    rounded = scored.withColumn(score, F.round(score, decimals))
    order = Window.partitionBy(query_key).orderBy(F.desc(score), *keys)
    return rounded.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k)


def search(queries: DataFrame, postings: DataFrame, query_key: str, keys: list[str], k: int = 5) -> DataFrame:
    return top_k(scores(queries, postings, query_key, keys), query_key, keys, k)


def _term_matrix(tokens: pa.Array, words: pa.Array) -> np.ndarray:
    """How often each text of a block holds each of the words."""
    found = pc.index_in(tokens.flatten(), value_set=words)
    held = found.is_valid().to_numpy(zero_copy_only=False)
    text_no = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy())
    cell = text_no[held] * len(words) + found.drop_null().to_numpy()
    return np.bincount(cell, minlength=len(tokens) * len(words)).reshape(len(tokens), len(words)).astype(np.float64)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, CELLS // width)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _statistics(tokens: DataFrame, words: list[str]) -> tuple[int, float, np.ndarray]:
    """Number of texts, their mean length and the texts that hold each word; a row a word comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(words, pa.string())
        df, n, total = np.zeros(len(words), np.int64), 0, 0
        for block in _blocks(batches, len(words)):
            held = block.column("tokens")
            df += (_term_matrix(held, value_set) > 0).sum(axis=0)
            n, total = n + len(held), total + len(held.flatten())
        no = np.append(np.flatnonzero(df), [-1, -2])
        yield pa.RecordBatch.from_pydict({"no": no, "n": np.append(df[df > 0], [n, total])})

    rows = {r["no"]: r["n"] for r in tokens.select("tokens").mapInArrow(count, "no long, n long").groupBy("no").agg(F.sum("n").alias("n")).collect()}
    n = rows.get(-1, 0)
    return n, rows.get(-2, 0) / max(n, 1), np.array([rows.get(i, 0) for i in range(len(words))], np.float64)


def search_texts(queries: DataFrame, texts: DataFrame, query_key: str, keys: list[str], k: int = 5, question: str = "question", text: str = "text", per_pass: int = QUERIES_PER_PASS, k1: float = K1, b: float = B) -> DataFrame:
    """(query_key, keys, score, rk): the k best texts of every query, as ``search`` over the postings of all texts finds them.

    The queries are a stated set and go to the tasks in passes of bounded size. Every task multiplies the matrix of its
    texts and the questions' terms, block by block, with that of the terms and the questions; the k best of a block are all
    that is shuffled. Texts and questions without words, null ones too, match nothing, but texts count for the mean length.
    """
    tokens = texts.select(*keys, tokenize(F.col(text)).alias("tokens"))
    schema = ", ".join(f"`{x}` {f.schema[x].dataType.simpleString()}" for f, names in ((queries, [query_key]), (texts, keys)) for x in names) + ", score double"
    kind = to_arrow_type(queries.schema[query_key].dataType)
    passes = max(1, -(-queries.count() // per_pass))
    out = None
    for p in range(passes):
        some = queries.filter(F.pmod(F.xxhash64(query_key), F.lit(passes)) == p)
        terms = some.select(query_key, F.explode(tokenize(F.col(question))).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf")).collect()
        words, ids = sorted({r["term"] for r in terms}), list({r[query_key]: None for r in terms})
        n, average, df = _statistics(tokens, words) if words else (0, 0.0, np.zeros(0))
        word_no, id_no = {w: i for i, w in enumerate(words)}, {q: i for i, q in enumerate(ids)}
        cells = np.array([word_no[r["term"]] for r in terms], np.int64), np.array([id_no[r[query_key]] for r in terms], np.int64)
        weight = np.log(1 + (n - df + 0.5) / (df + 0.5)) * (k1 + 1)
        weight = weight[cells[0]] * np.array([r["qtf"] for r in terms], np.float64)

        def best(batches: Iterator[pa.RecordBatch], words: list[str] = words, ids: list = ids, cells: tuple = cells, weight: np.ndarray = weight, average: float = average) -> Iterator[pa.RecordBatch]:
            value_set, weights = pa.array(words, pa.string()), np.zeros((len(words), len(ids)))
            weights[cells] = weight
            least = np.zeros((len(ids), 1))  # what a text needs after the blocks seen
            for block in _blocks(batches, max(len(words), len(ids))) if words else ():
                block = block.take(pc.sort_indices(block.select(keys), [(x, "ascending") for x in keys], null_placement="at_start"))
                held = block.column("tokens")
                tf = _term_matrix(held, value_set)
                size = pc.list_value_length(held).to_numpy().astype(np.float64)
                score = np.round(((tf / (tf + k1 * (1 - b + b * size[:, None] / max(average, 1e-12)))) @ weights).T, DECIMALS)
                if score.shape[1] >= k:
                    at = score.shape[1] - k
                    least = np.maximum(least, np.partition(score, at, axis=1)[:, [at]])
                q, t = np.nonzero((score >= least) & (score > 0))
                order = np.lexsort((t, -score[q, t], q))
                q, t = q[order], t[order]
                first = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
                q, t = q[first], t[first]
                picked = block.select(keys).take(pa.array(t))
                columns = [pa.array(ids, kind).take(pa.array(q)), *picked.columns, pa.array(score[q, t])]
                yield pa.RecordBatch.from_arrays(columns, [query_key, *keys, "score"])

        one = tokens.mapInArrow(best, schema)
        out = one if out is None else out.unionByName(one)
    return top_k(out, query_key, keys, k)
