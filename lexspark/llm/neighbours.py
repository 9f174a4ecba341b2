"""Problem 2: the k most similar vectors of every vector, by a block matrix join.

Every vector is quantised once, to an int8 code and a second int8 code of what the first leaves. Codes and floats are packed
to blocks of one model in files of the shared folder. A tile is a block of queries against all vectors of their model: only
the addresses of blocks are shuffled, and the task of a tile reads the base blocks one after another, so disk grows with the
vectors and not with their pairs. Products of first codes bound every cosine from both sides, with the norms of the
quantisation errors. Pairs whose upper bound reaches the k-th best cosine of their query so far are bounded again by both
codes, some 250 times as tightly; for those that still reach it the cosine of the floats is taken in double precision.

Exact copies of a vector are searched once: a base copy beyond the k + 1 smallest ids of its group can't be among the k
nearest of anything, as all copies are equally near and smaller ids go first.

Defined results: null vectors, vectors of another length, all-zero vectors, vectors holding null, NaN or infinite numbers
and rows without id are not usable; a null model is a model of its own; repeated rows of one id count once (the greatest
vector of the id, in array order); fewer than k other vectors give fewer neighbours; other columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.session import checked_join, written, written_dir

DIMENSIONS, K, DECIMALS = 128, 10, 6
#: Vectors of a query block, at most (fewer while cores would idle, but not under the last number), and of base blocks
#: that a tile holds at once; it needs about 3 kB a vector of either, and 5 bytes a pair of a strip.
QUERY_BLOCK, BASE_BLOCK, LEAST_QUERIES = 8192, 32768, 1024
#: Base vectors and queries that are multiplied at once, so that the products stay in the cache.
STRIP, QUERIES_AT_ONCE = 512, 1024
#: Steps of the second code within one of the first; partitions a tile, so that few tiles share one; most partitions.
STEPS, PARTITIONS_A_TILE, MOST_PARTITIONS = 254, 8, 20_000
#: Pairs that are computed at once.
PAIRS_AT_ONCE = 16_384
#: Base vectors that a tile looks at first; files that a task holds open.
FIRST, FILES_OPEN = 1024, 256


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    scale = np.abs(v).max(axis=1, keepdims=True) if v.size else 1.0  # first, so that very small or large numbers don't under- or overflow
    v = v / scale
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Codes(NamedTuple):
    """Two int8 codes of every vector, the step of the first one, and the norms of what the first and what both leave."""

    first: np.ndarray
    second: np.ndarray
    step: np.ndarray
    error: np.ndarray
    rest: np.ndarray

    def both(self) -> np.ndarray:
        return self.first.astype(np.int32) * STEPS + self.second


def quantised(unit: np.ndarray) -> Codes:
    step = (np.abs(unit).max(axis=1) / 127 * (1 + 1e-6)).astype(np.float32)
    wide = step.astype(np.float64)[:, None]
    first = np.rint(unit / wide)
    left = unit - first * wide
    second = np.rint(left / (wide / STEPS))
    rest = left - second * (wide / STEPS)
    norm = lambda x: np.nextafter(np.sqrt((x * x).sum(axis=1)).astype(np.float32), np.float32(1))
    return Codes(first.astype(np.int8), second.astype(np.int8), step, norm(left), norm(rest))


def tile_neighbours(q_ids: np.ndarray, q: Codes, b_ids: np.ndarray, b: Codes, k: int, decimals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a tile that may be among the k best of their query: (query index, base id, cosine, most it is wrong by)."""
    i, j, cos, wrong = near_pairs(q_ids, q, b_ids, b, k, decimals, np.full(len(q_ids), -np.inf))
    return i, b_ids[j], cos, wrong


def near_pairs(q_ids: np.ndarray, q: Codes, b_ids: np.ndarray, b: Codes, k: int, decimals: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query index, base index, cosine, most it is wrong by) of the pairs that may be among the k best of their query.

    ``floor``: of every query a cosine that k others are known to reach, or -inf.
    """
    qs, bs = q.step.astype(np.float64), b.step.astype(np.float64)
    qc, bc = q.first * q.step[:, None], b.first * b.step[:, None]
    qn, bn = (np.sqrt(np.einsum("nd,nd->n", x, x)) for x in (qc, bc))
    ulp = 0.5 * 10.0**-decimals + 1e-9  # pairs that may be equal after rounding stay in
    floor = floor.copy()  # k-th best lower bound of each query so far
    kept_q, kept_b, kept_up = [], [], []
    for low in range(0, len(q_ids), QUERIES_AT_ONCE):
        some = slice(low, low + QUERIES_AT_ONCE)
        mine = floor[some]
        for at in range(0, len(b_ids), STRIP):
            cut = slice(at, at + STRIP)
            near = qc[some] @ bc[cut].T
            # |cos - near| <= |q'||be| + |qe||b'| + |qe||be|, and float32 adds less than 130 * 2**-24 times the norms
            slack = qn[some] * b.error[cut].max() + q.error[some] * bn[cut].max() + q.error[some] * b.error[cut].max() + 1.2e-5
            width = near.shape[1]
            if width > k and at == 0 and not np.isfinite(mine).all():
                best = np.partition(near, width - k - 1, axis=1)[:, width - k - 1]  # k + 1 best: one may be the query itself
                mine = np.maximum(mine, best - slack)
            hit = np.flatnonzero(near >= (mine - slack - 2 * ulp)[:, None].astype(np.float32))
            i, j = hit // width, hit % width
            kept_q.append(i + low)
            kept_b.append(j + at)
            kept_up.append(near.ravel()[hit] + slack[i])
            strip = at // STRIP + 1
            if not strip & (strip - 1) and at + STRIP < len(b_ids) and len(i) > k:  # less and less often, as it rises ever less
                mine = np.maximum(mine, _kth(i, near.ravel()[hit] - slack[i], len(mine), k))
        floor[some] = mine
    i, j, up = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (kept_q, kept_b, kept_up))
    still = (up >= floor[i] - 2 * ulp) & (q_ids[i] != b_ids[j])
    i, j = i[still], j[still]
    # both codes: integers below 2**38, exact in double precision
    q2, b2, cos = q.both(), b.both(), np.empty(len(i))
    for at in range(0, len(i), PAIRS_AT_ONCE):
        cut = slice(at, at + PAIRS_AT_ONCE)
        cos[cut] = np.einsum("nd,nd->n", q2[i[cut]].astype(np.float64), b2[j[cut]].astype(np.float64))
    cos *= qs[i] / STEPS * (bs[j] / STEPS)
    wrong = (1 + q.rest[i].astype(np.float64)) * b.rest[j] + q.rest[i] * (1 + b.rest[j].astype(np.float64)) + 1e-9  # |q'| <= 1 + |qe|
    near_enough = cos + wrong >= np.maximum(floor, _kth(i, cos - wrong, len(q_ids), k - 1))[i] - 2 * ulp
    return i[near_enough], j[near_enough], cos[near_enough], wrong[near_enough]


def _kth(i: np.ndarray, values: np.ndarray, n: int, k: int) -> np.ndarray:
    """Of every query its value at place ``k`` (from 0) from the greatest on, -inf where it has fewer."""
    order = np.lexsort((-values, i))
    i, values = i[order], values[order]
    hit = np.arange(len(i)) - np.searchsorted(i, i, "left") == k
    out = np.full(n, -np.inf)
    out[i[hit]] = values[hit]
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str, model_col: str, dimensions: int) -> DataFrame:
    v = F.col(vector_col).cast("array<float>")
    fine = (F.size(v) == dimensions) & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    model = F.when(F.col(model_col).isNull(), F.lit(0)).otherwise(F.xxhash64(F.col(model_col)))
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.max(F.struct(v.alias("v"), model.alias("model"))).alias("r")).select("id", "r.model", "r.v")


def nearest(
    vectors: DataFrame, k: int = K, id_col: str = "query_id", vector_col: str = "embeddings", model_col: str = "model",
    dimensions: int = DIMENSIONS, decimals: int = DECIMALS, query_block: int = QUERY_BLOCK, base_block: int = BASE_BLOCK,
) -> DataFrame:
    """(id, neighbour, cosine, rank): the k nearest of every usable vector among the others of its model."""
    spark = vectors.sparkSession
    folder = _folder(spark)
    rows = usable(vectors, id_col, vector_col, model_col, dimensions).withColumns({"d": F.xxhash64("v", F.lit(1)), "e": F.xxhash64("v", F.lit(2))})
    keys = written(rows.mapInArrow(_packing(folder, dimensions, base_block), "id long, model long, d long, e long, file long, at long, n int, place int"), "packed-vectors")
    same = ["model", "d", "e"]  # 128 bits stand for a vector
    members = written(keys.join(keys.groupBy(*same).agg(F.min("id").alias("head")), same).drop("d", "e"), "copies")
    heads = members.filter("id = head").groupBy("model", "file", "at", "n").agg(F.sort_array(F.collect_list("place")).alias("places"))  # of a block
    blocks = written(heads.mapInArrow(_listing(folder), "model long, file long, at long, n int, list long, list_at long, heads int"), "blocks")
    cores = spark.sparkContext.defaultParallelism
    width = F.least(F.lit(query_block), F.greatest(F.lit(LEAST_QUERIES), F.ceil(F.sum("heads") / (4 * cores)))).cast("int")
    sizes = blocks.groupBy("model").agg(width.alias("width"))
    cut = checked_join(blocks, sizes, "model", rows=sizes.count()).withColumn("low", F.explode(F.expr("sequence(0, heads - 1, width)"))).withColumn("high", F.least(F.col("heads"), F.col("low") + F.col("width")))
    before = Window.partitionBy("model").orderBy("file", "at", "low").rowsBetween(Window.unboundedPreceding, -1)
    i = F.floor(F.coalesce(F.sum(F.col("high") - F.col("low")).over(before), F.lit(0)) / F.col("width")).cast("int")
    queries = written(cut.withColumn("i", i).drop("width"), "query-blocks")
    tiles = queries.select("model", "i").distinct()
    n_tiles = tiles.count()
    as_query = queries.withColumn("query", F.lit(True))
    as_base = checked_join(blocks, tiles, "model", rows=n_tiles).withColumns({"low": F.lit(0), "high": F.col("heads"), "query": F.lit(False)})
    # by tile and explicitly: after a join that shuffled by model, all tiles of a model would stay in one task
    cells = as_query.unionByName(as_base).repartition(min(MOST_PARTITIONS, PARTITIONS_A_TILE * max(1, n_tiles)), "model", "i")

    def tile(key, table):
        cells = table.to_pylist()
        with _Blocks(folder, dimensions) as files:
            best = _Best(files.joined([c for c in cells if c["query"]]), k, decimals)
            waiting: list[dict] = []
            for c in cells:
                if not c["query"]:
                    if waiting and sum(w["heads"] for w in waiting) + c["heads"] > base_block:
                        best.add(files.joined(waiting))
                        waiting = []
                    waiting.append(c)
            best.add(files.joined(waiting))
        return best.table()

    near = cells.groupBy("model", "i").applyInArrow(tile, "head long, other long, cosine double")
    # copies: the head's own copies are neighbours at cosine 1, and every neighbour stands for up to k + 1 ids
    few = members.withColumn("rank", F.row_number().over(Window.partitionBy("head").orderBy("id"))).filter(F.col("rank") <= k + 1)
    copies = written(few.groupBy("head").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1), "copied")  # k + 1 at most
    own = copies.select("head", F.col("head").alias("other"), F.lit(1.0).alias("cosine"))
    lists = checked_join(near.unionByName(own), copies.withColumnRenamed("head", "other"), "other", "left")
    lists = lists.withColumn("ids", F.coalesce("ids", F.array("other"))).groupBy("head").agg(F.collect_list(F.struct("cosine", "ids")).alias("lists"))
    merged = lists.select("head", best_of_lists(k + 1)("lists").alias("best"))  # one more: a member of the group may be in it itself
    ranked = members.select("id", "head").join(merged, "head").select("id", F.expr(f"slice(filter(best, x -> x.id <> id), 1, {k})").alias("best"))
    return ranked.select("id", F.posexplode("best").alias("rank", "b")).select("id", F.col("b.id").alias("neighbour"), F.col("b.cosine").alias("cosine"), (F.col("rank") + 1).alias("rank"))


def _folder(spark: SparkSession) -> str:
    """A folder of its own beside the written tables, with the scheme of its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{written_dir(spark)}/vectors-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


class _File:
    """A file of a task, under a number of its own, so that a task that runs again overwrites nothing."""

    def __init__(self, folder: str):
        self.folder, self.number, self.at, self.stream = folder, int.from_bytes(os.urandom(8), "big") >> 1, 0, None

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_) -> None:
        if self.stream:
            self.stream.close()

    def add(self, *arrays: np.ndarray) -> int:
        """Where the arrays begin."""
        if not self.stream:
            system, name = pyarrow.fs.FileSystem.from_uri(self.folder)
            system.create_dir(name, recursive=True)
            self.stream = system.open_output_stream(f"{name}/{self.number}")
        began = self.at
        for x in arrays:
            self.stream.write(np.ascontiguousarray(x).tobytes())
            self.at += x.nbytes
        return began


def _packing(folder: str, dimensions: int, most: int):
    """(id, model, d, e, v) to files of blocks of one model, of ``most`` vectors; where each vector is."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks().sort_by("model")
            model = rows["model"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(model)) + 1).tolist(), len(model)]
            for low, high in zip(edges, edges[1:]):
                some, n = rows.slice(low, high - low).combine_chunks(), high - low
                v = some["v"].chunk(0).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(n, dimensions)
                parts = [quantised(unit_rows(v[at : at + STRIP])) for at in range(0, n, STRIP)]
                at = file.add(some["id"].to_numpy(), *(np.concatenate(x) for x in zip(*parts)), v)
                same = [pa.array(np.full(n, x, kind)) for x, kind in ((file.number, np.int64), (at, np.int64), (n, np.int32))]
                columns = [*(some[c].chunk(0) for c in ("id", "model", "d", "e")), *same, pa.array(np.arange(n, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "model", "d", "e", "file", "at", "n", "place"])

        with _File(folder) as file:
            held: list[pa.RecordBatch] = []
            room = most
            for batch in batches:
                while batch.num_rows:
                    held.append(batch.slice(0, room))
                    room -= held[-1].num_rows
                    batch = batch.slice(held[-1].num_rows)
                    if not room:
                        yield from block(pa.Table.from_batches(held))
                        held, room = [], most
            if held:
                yield from block(pa.Table.from_batches(held))

    return pack


def _listing(folder: str):
    """The places of the vectors to search in every block to files; where each list is."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _File(folder) as file:
            for batch in batches:
                if batch.num_rows:
                    places = [np.array(x.values.to_numpy(), np.int32) for x in batch.column("places")]
                    numbers = [np.full(len(places), file.number, np.int64), np.array([file.add(x) for x in places], np.int64), np.array([len(x) for x in places], np.int32)]
                    columns = [*(batch.column(c) for c in ("model", "file", "at", "n")), *map(pa.array, numbers)]
                    yield pa.RecordBatch.from_arrays(columns, ["model", "file", "at", "n", "list", "list_at", "heads"])

    return lists


class _Vectors(NamedTuple):
    ids: np.ndarray
    codes: Codes
    floats: np.ndarray


class _Blocks(ExitStack):
    """Reads the blocks that ``_packing`` wrote."""

    def __init__(self, folder: str, dimensions: int):
        super().__init__()
        (self.system, self.folder), self.dimensions, self.files = pyarrow.fs.FileSystem.from_uri(folder), dimensions, {}

    def read(self, file: int, at: int, kinds: list[tuple[type, int]], n: int) -> list[np.ndarray]:
        if file not in self.files:
            if len(self.files) >= FILES_OPEN:
                self.pop_all().close()
                self.files = {}
            self.files[file] = self.enter_context(self.system.open_input_file(f"{self.folder}/{file}"))
        data = self.files[file].read_at(n * sum(np.dtype(kind).itemsize * width for kind, width in kinds), at)
        out, low = [], 0
        for kind, width in kinds:
            out.append(np.frombuffer(data, kind, n * width, low).reshape((n, width) if width > 1 else n))
            low += out[-1].nbytes
        return out

    def joined(self, cells: list[dict]) -> _Vectors:
        """The vectors from ``low`` to ``high`` of those to search in some blocks."""
        d = self.dimensions
        kinds = [(np.int64, 1), (np.int8, d), (np.int8, d), (np.float32, 1), (np.float32, 1), (np.float32, 1), (np.float32, d)]
        parts = []
        for c in cells:
            places = self.read(c["list"], c["list_at"], [(np.int32, 1)], c["heads"])[0][c["low"] : c["high"]]
            parts.append([x[places] for x in self.read(c["file"], c["at"], kinds, c["n"])])
        ids, *codes, floats = (np.concatenate(x) for x in zip(*parts))
        return _Vectors(ids, Codes(*codes), floats)


class _Best:
    """The k nearest of some queries among the vectors added so far: smaller ids first among equals."""

    def __init__(self, queries: _Vectors, k: int, decimals: int):
        self.q, self.unit, self.k, self.decimals = queries, unit_rows(queries.floats), k, decimals
        self.i, self.other, self.cosine = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, base: _Vectors) -> None:
        low, room = 0, len(base.ids) if len(self.i) else FIRST  # few at first: cosines found among them spare the rest many pairs
        while low < len(base.ids):
            part = slice(low, low + room)
            self._add(base.ids[part], Codes(*(c[part] for c in base.codes)), base.floats[part])
            low, room = low + room, 3 * (low + room)

    def _add(self, ids: np.ndarray, codes: Codes, floats: np.ndarray) -> None:
        floor = _kth(self.i, self.cosine, len(self.q.ids), self.k - 1) - 0.5 * 10.0**-self.decimals
        i, j, cos, _ = near_pairs(self.q.ids, self.q.codes, ids, codes, self.k, self.decimals, floor)
        used, place = np.unique(j, return_inverse=True)
        unit = unit_rows(floats[used])
        for at in range(0, len(i), PAIRS_AT_ONCE):
            cut = slice(at, at + PAIRS_AT_ONCE)
            cos[cut] = np.round(np.einsum("nd,nd->n", self.unit[i[cut]], unit[place[cut]]), self.decimals) + 0.0
        i, other, cos = (np.concatenate(x) for x in ((self.i, i), (self.other, ids[j]), (self.cosine, cos)))
        order = np.lexsort((other, -cos, i))
        i, other, cos = i[order], other[order], cos[order]
        first = np.arange(len(i)) - np.searchsorted(i, i, "left") < self.k
        self.i, self.other, self.cosine = i[first], other[first], cos[first]

    def table(self) -> pa.Table:
        return pa.table({"head": self.q.ids[self.i], "other": self.other, "cosine": self.cosine})


def best_of_lists(k: int):
    """UDF that merges lists of (cosine, ids) by a heap: the k best (id, cosine), smaller ids first among equals."""

    @F.pandas_udf("array<struct<id:bigint,cosine:double>>")
    def merge(lists: pd.Series) -> pd.Series:
        def one(row):
            streams = [[(-x["cosine"], int(i)) for i in x["ids"]] for x in row]
            heap = [(s[0], n, 0) for n, s in enumerate(streams) if s]
            heapq.heapify(heap)
            out = []
            while heap and len(out) < k:
                best, n, at = heap[0]
                out.append({"id": best[1], "cosine": -best[0]})
                if at + 1 < len(streams[n]):
                    heapq.heapreplace(heap, (streams[n][at + 1], n, at + 1))
                else:
                    heapq.heappop(heap)
            return out

        return lists.map(one)

    return merge


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(query_id_a, query_id_b), smaller id first: either is among the nearest of the other."""
    return near.select(F.least("id", "neighbour").alias("query_id_a"), F.greatest("id", "neighbour").alias("query_id_b")).distinct()
