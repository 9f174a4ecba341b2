"""Problem 6: fill containers of fixed capacity with documents, leaving as little space unused as possible.

Spark counts the tokens of every document and the histogram of item lengths. The histogram has at most ``capacity``
entries however many documents there are, so the configuration linear program over it is solved on the driver:
multiplicative weights over the lengths, with a knapsack dynamic program as pricing step, to a measured gap. It is rounded,
and solved and rounded again for what is left; only the last few hundredths of the space are filled up item by item. Spark
then ranks the documents within each length and looks up the container of each rank.

Defined results: a null or empty text has no tokens and gets a row with part_no 0 and a null container; repeated rows
of one doc_id count once, with the longest text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.session import written

CAPACITY = 1024
#: ``\w+|[^\w\s]`` of Python spelled out by character class, since Java's ``\w`` differs.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"
#: Gap of the linear program, rounds after which it ends all the same (of the first and of those for what rounding leaves), and
#: the share of the space that is filled up at the end.
GAP, ROUNDS, LATER_ROUNDS, REST = 0.06, 600, 200, 0.06
#: Rows of one length that one task ranks.
ROWS_PER_RANKING_TASK = 200_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def filling_table(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Unbounded knapsack by dynamic programming: the best value of every room, and the size that its best filling takes first."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for room in range(1, capacity + 1):
        top = best[room - 1]
        if k := upto[room]:
            gain = values[:k] + best[room - sizes[:k]]
            i = int(gain.argmax())
            if gain[i] > top:
                top, pick[room] = gain[i], i
        best[room] = top
    return best, pick.tolist()


def traced(pick: list[int], sizes: list[int], need: list[int], room: int, first: int | None = None) -> dict[int, int]:
    """The filling of a room as {index of size: copies}, with ``first`` in it; no size more often than it is needed."""
    out: dict[int, int] = {}
    if first is not None:
        out[first] = 1
        room -= sizes[first]
    while room > 0:
        i = pick[room]
        if i < 0 or out.get(i, 0) >= need[i]:
            room -= 1
        else:
            out[i] = out.get(i, 0) + 1
            room -= sizes[i]
    return out


def best_filling(values: np.ndarray, sizes: np.ndarray, capacity: int) -> dict[int, int]:
    """The filling of greatest value, as {index of size: copies}."""
    return traced(filling_table(values, sizes, capacity)[1], sizes.tolist(), [capacity] * len(sizes), capacity)


class Fractional(NamedTuple):
    configurations: list[tuple[dict[int, int], float]]
    primal: float
    dual: float


def configuration_lp(counts: dict[int, int], capacity: int, gap: float = GAP, eps: float = 0.5, priced: int = 64, most_rounds: int = ROUNDS) -> Fractional:
    """Fractional covering of the length histogram by configurations {length: copies}, by multiplicative weights.

    The price of a length is its size times a weight that falls exponentially with its coverage. Every round prices all
    configurations by one knapsack table and takes, for each of the least covered lengths, the best configuration that
    holds it, with the step that covers some length once. The rounds end at the wanted gap between the primal value (all
    steps, scaled to cover every length) and the dual one (the prices, scaled to make no configuration dearer than 1), or
    after ``most_rounds``; both values are returned.
    """
    sizes = np.array(sorted(counts))
    plain = sizes.tolist()
    need = [counts[s] for s in plain]
    covered, taken, total = np.zeros(len(sizes)), {}, 0.0
    primal = dual = 0.0
    for _ in range(most_rounds):
        prices = sizes * np.exp(-eps * (covered - covered.min()))
        best, pick = filling_table(prices, sizes, capacity)
        dual = max(dual, float(prices @ need) / float(best[capacity]))
        low = np.argsort(covered, kind="stable")[:priced]
        for first in low.tolist():
            config = traced(pick, plain, need, capacity, first)
            step = min(need[i] / a for i, a in config.items())
            for i, a in config.items():
                covered[i] += a * step / need[i]
            key = tuple(sorted(config.items()))
            taken[key] = taken.get(key, 0.0) + step
            total += step
        if (least := float(covered.min())) > 0:
            primal = total / least
            if primal <= (1 + gap) * dual:
                break
    scale = 1 / max(float(covered.min()), 1.0)
    return Fractional([({plain[i]: a for i, a in key}, x * scale) for key, x in taken.items()], primal, dual)


def _take(plan: list, left: dict[int, int], config: dict[int, int], at_most: float) -> None:
    """Fill up to ``at_most`` containers by a configuration, as far as its items are left."""
    n = int(min([at_most, *(left[s] // a for s, a in config.items())]))
    if n > 0:
        plan.append((config, n))
        for s, a in config.items():
            left[s] -= a * n


def rounded(left: dict[int, int], fractional: list[tuple[dict[int, int], float]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole configurations of the items in ``left``, which they are taken from: each one rounded down, then one more of
    every configuration at which the running sum of the fractions passes a whole number. The fullest go first."""
    plan: list[tuple[dict[int, int], int]] = []
    fullest = sorted(fractional, key=lambda c: (capacity - sum(s * a for s, a in c[0].items()), -c[1]))
    for config, x in fullest:
        _take(plan, left, config, math.floor(x))
    at = 0.5
    for config, x in fullest:
        at += x - math.floor(x)
        if at >= 1:
            at -= 1
            _take(plan, left, config, 1)
    return plan


def filled_up(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Containers for a few items that rounding left over: knapsacks that take the longest item first."""
    left, out = dict(counts), []
    while any(left.values()):
        sizes = np.array(sorted(s for s, n in left.items() if n))
        longest = int(sizes[-1])
        rest = {longest: 1}
        room = capacity - longest
        while room >= sizes[0]:
            can = np.array([s for s in sizes if left[int(s)] > rest.get(int(s), 0) and s <= room])
            if not len(can):
                break
            added = best_filling(can * (1 + can / capacity / 64), can, room)
            before = room
            for i, a in sorted(added.items(), reverse=True):
                s = int(can[i])
                if (a := min(a, left[s] - rest.get(s, 0), room // s)) > 0:
                    rest[s] = rest.get(s, 0) + a
                    room -= a * s
            if room == before:
                break
        _take(out, left, rest, math.inf)
    return out


class Plan(NamedTuple):
    containers: list[tuple[dict[int, int], int]]
    from_lp: int
    filled_up: int
    primal: float
    dual: float


def container_plan(counts: dict[int, int], capacity: int, rest: float = REST) -> Plan:
    """Configurations with the number of their containers, which hold every item once.

    The linear program is solved and rounded; what rounding leaves is a smaller histogram, for which it is solved and
    rounded again, until less than ``rest`` of all space is left to be filled up item by item. ``primal`` and ``dual`` are
    those of the first program.
    """
    whole = sum(s * n for s, n in counts.items())
    left, containers, values = {s: n for s, n in counts.items() if n}, [], None
    while left and (values is None or sum(s * n for s, n in left.items()) > rest * whole):
        solved = configuration_lp(left, capacity, most_rounds=LATER_ROUNDS if values else ROUNDS)
        values = values or (solved.primal, solved.dual)
        some = rounded(left, solved.configurations, capacity)
        left = {s: n for s, n in left.items() if n}
        containers += some
        if not some:
            break
    last = filled_up(left, capacity)
    return Plan(containers + last, sum(n for _, n in containers), sum(n for _, n in last), *(values or (0.0, 0.0)))


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end of ranks, copies per container, number of the first container)."""
    slots, used, first = [], dict.fromkeys(counts, 0), 0
    for config, n in container_plan(counts, capacity).containers:
        for s, a in config.items():
            slots.append((s, used[s], used[s] + a * n, a, first))
            used[s] += a * n
        first += n
    return slots


def ranked(items: DataFrame, key: str, order: str, largest: int) -> DataFrame:
    """``rank`` from 0 within ``key``, without one task for a hot key: rows are ranked in salted parts and each part
    starts where the one before it ends."""
    salts = max(1, math.ceil(largest / ROWS_PER_RANKING_TASK))
    salted = items.withColumn("salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    part = Window.partitionBy(key, "salt").orderBy(order)
    out = salted.withColumn("rank", F.row_number().over(part).cast("long") - 1)
    if salts == 1:
        return out.drop("salt")
    before = Window.partitionBy(key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(key, "salt").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return out.join(starts, [key, "salt"]).withColumn("rank", F.col("rank") + F.col("start")).drop("salt", "start")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per part of a document: (doc_id, part_no, start_token, n_tokens, container_id).

    Only a document longer than ``capacity`` has more than one part: full containers of its own and a last part that is
    packed like any other item.
    """
    spark = documents.sparkSession
    sizes = documents.select(F.col(id_col).alias("doc_id"), token_count(F.col(text_col)).alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
    sizes = written(sizes.withColumn("size", (F.col("n") % capacity).cast("int")), "sizes")
    counts = {r["size"]: r["count"] for r in sizes.filter("size > 0").groupBy("size").count().collect()}  # at most capacity rows

    slots = spark.createDataFrame(plan_containers(counts, capacity), "size int, from_rank long, to_rank long, copies long, first long")
    items = ranked(sizes.filter("size > 0"), "size", "doc_id", max(counts.values(), default=0)).alias("i")
    here = (F.col("i.size") == F.col("s.size")) & F.col("i.rank").between(F.col("s.from_rank"), F.col("s.to_rank") - 1)
    last = items.join(F.broadcast(slots.alias("s")), here).select(  # slots: bounded by the rounds and the lengths, whatever the number of documents
        "i.doc_id",
        F.floor(F.col("i.n") / capacity).cast("int").alias("part_no"),
        F.col("i.size").cast("long").alias("n_tokens"),
        F.concat(F.lit("shared-"), F.col("s.first") + F.floor((F.col("i.rank") - F.col("s.from_rank")) / F.col("s.copies"))).alias("container_id"),
    )
    full = sizes.filter(F.col("n") >= capacity).select("doc_id", F.explode(F.sequence(F.lit(0), (F.floor(F.col("n") / capacity) - 1).cast("int"))).alias("part_no"))
    full = full.select("doc_id", "part_no", F.lit(capacity).cast("long").alias("n_tokens"), F.concat_ws("-", F.lit("own"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "part_no").alias("container_id"))
    none = sizes.filter("n = 0").select("doc_id", F.lit(0).alias("part_no"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("container_id"))
    return last.unionByName(full).unionByName(none).select("doc_id", "part_no", (F.col("part_no").cast("long") * capacity).alias("start_token"), "n_tokens", "container_id")


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per container: (container_id, n_parts, n_tokens, unused)."""
    by = packed.filter("container_id is not null").groupBy("container_id")
    return by.agg(F.count("*").alias("n_parts"), F.sum("n_tokens").alias("n_tokens")).withColumn("unused", F.lit(capacity) - F.col("n_tokens"))
