"""Exact cosine retrieval and support scores over vector columns, in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.operators.bm25 import DECIMALS, top_k

FLOOR = 1e-12
#: Queries that one pass over the vectors answers; more queries take more passes.
QUERIES_PER_PASS = 4096


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    n = F.array(F.greatest(norm(v), F.lit(FLOOR)))  # bound by a lambda of its own, or every element would compute it again
    return F.transform(n, lambda one: F.transform(v, lambda x: x.cast("double") / one))[0]


def unit_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): usable vectors at length 1; null vectors and those that hold null are left out."""
    fine = F.coalesce(F.forall(vector, lambda x: x.isNotNull()), F.lit(False))
    return rows.filter(F.col(key).isNotNull() & fine).select(F.col(key), l2_normalize(F.col(vector)).alias("v"))


def cosines(queries: DataFrame, base: DataFrame, query_key: str, key: str, k: int, per_pass: int = QUERIES_PER_PASS) -> DataFrame:
    """(query_key, key, score) of unit vectors: the k nearest of every query within every batch of the base.

    The queries are a stated set and go to the tasks in passes of bounded size; the base is never moved. What comes back
    is k rows a query and batch, which ``nearest`` merges.
    """
    n = queries.count()
    out, passes = None, max(1, -(-n // per_pass))
    kind = queries.schema[query_key].dataType.simpleString(), base.schema[key].dataType.simpleString()
    for p in range(passes):
        some = queries.filter(F.pmod(F.xxhash64(query_key), F.lit(passes)) == p).orderBy(query_key).collect()
        ids = np.array([r[query_key] for r in some], dtype=object)
        matrix = np.array([r["v"] for r in some], dtype=np.float64).reshape(len(some), -1)

        def multiply(batches: Iterator[pd.DataFrame], ids: np.ndarray = ids, matrix: np.ndarray = matrix) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf = pdf[[len(v) == matrix.shape[1] for v in pdf["v"]]] if len(ids) else pdf.iloc[:0]
                if not len(pdf):
                    continue
                pdf = pdf.sort_values(key)
                keys, product = pdf[key].to_numpy(), matrix @ np.stack(pdf["v"].to_numpy()).T
                at = max(0, len(keys) - k)
                kth = np.partition(product, at, axis=1)[:, [at]]
                q, b = np.nonzero(product >= kth - 10.0**-DECIMALS)
                score = np.round(product[q, b], DECIMALS)  # as they are ranked, so that of many ties only k are needed
                order = np.lexsort((b, -score, q))
                q, b, score = q[order], b[order], score[order]
                first = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
                yield pd.DataFrame({query_key: ids[q[first]], key: keys[b[first]], "score": score[first]})

        one = base.select(key, "v").mapInPandas(multiply, f"{query_key} {kind[0]}, {key} {kind[1]}, score double")
        out = one if out is None else out.unionByName(one)
    return out


def nearest(queries: DataFrame, base: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    """The k nearest of every query with rank ``rk`` from 1; all of them where the base has fewer."""
    return top_k(cosines(queries, base, query_key, key, k), query_key, [key], k)


def support_score(near: DataFrame, queries: DataFrame, query_key: str) -> DataFrame:
    """(query_key, support): the greatest cosine of each query, 0.0 where nothing was retrieved."""
    best = near.groupBy(query_key).agg(F.max("score").alias("support"))
    return queries.select(query_key).join(best, query_key, "left").withColumn("support", F.coalesce("support", F.lit(0.0)))
