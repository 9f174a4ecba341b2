from pathlib import Path

import numpy as np
import pytest

from lexspark.llm import neighbours

SCHEMA = "query_id long, embeddings array<float>, model string, id long"


def brute(rows, k=10, dims=128):
    by = {}
    for i, v, m, _ in rows:
        if i is not None and v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by.setdefault(m, {})[i] = np.array(v, np.float32).astype(float)
    out = set()
    for vs in by.values():
        ids = np.array(sorted(vs))
        u = np.array([vs[i] for i in ids])
        u = u / np.abs(u).max(axis=1, keepdims=True)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        c = np.round(u @ u.T, 6)
        for a in range(len(ids)):
            near = [b for b in np.lexsort((ids, -c[a])) if b != a][:k]
            out |= {(int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))) for b in near}
    return out


def found(spark, rows, **sizes):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in neighbours.neighbour_pairs(neighbours.nearest(df, **sizes)).collect()}


def vectors(n, seed, models=("a", "b", None)):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 128))
    return [(i, [float(x) for x in (centres[i % 6] + 0.3 * rng.normal(size=128)) * 10.0 ** rng.integers(-3, 4)], models[i % len(models)], 5) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"query_block": 16, "base_block": 40}])
def test_equals_brute_force(spark, sizes):
    rows = vectors(260, 1)
    assert found(spark, rows, **sizes) == brute(rows)


def test_ties_copies_and_hot_vector(spark):
    rows = vectors(120, 2, ("a",))
    rows += [(1000 + i, rows[3][1], "a", 0) for i in range(60)]  # a third are copies of one vector
    rows += [(2000 + i, [2 * x for x in rows[3][1]], "a", 0) for i in range(5)]  # and its direction at another length
    assert found(spark, rows, query_block=32, base_block=64) == brute(rows)


def test_unusable_vectors(spark):
    fine = vectors(30, 4, ("a",))
    bad = [(500, None, "a", 1), (501, [0.0] * 128, "a", 1), (502, [1.0] * 127, "a", 1), (503, [None] + [1.0] * 127, "a", 1), (504, [float("nan")] + [1.0] * 127, "a", 1), (505, [float("inf")] + [1.0] * 127, "a", 1), (None, [1.0] * 128, "a", 1), (506, [], "a", 1)]
    assert found(spark, fine + bad + fine[:5]) == brute(fine)
    assert found(spark, [(1, [1.0] * 128, "a", 0)]) == set() and found(spark, bad[:1]) == set()
    assert found(spark, [(1, [1.0] * 128, "a", 0), (2, [1.0] * 128, "b", 0), (3, [1.0] * 128, None, 0), (4, [2.0] * 128, None, 0)]) == {(3, 4)}


def test_bounds_hold():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 128))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = neighbours.quantised(v)
    first = c.first * c.step.astype(float)[:, None]
    both = c.both() * (c.step.astype(float) / neighbours.STEPS)[:, None]
    for codes, error, most in ((first, c.error, 0.05), (both, c.rest, 2e-4)):
        n, e = np.linalg.norm(codes, axis=1), error.astype(float)
        slack = n[:, None] * e[None, :] + e[:, None] * n[None, :] + e[:, None] * e[None, :]
        assert (np.abs(v @ v.T - codes @ codes.T) <= slack + 1e-9).all() and slack.max() < most
    i, j, cos, wrong = neighbours.tile_neighbours(np.arange(300), c, np.arange(300), c, 10, 6)
    assert 3000 <= len(i) < 3100 and (i != j).all() and (np.abs((v @ v.T)[i, j] - cos) <= wrong).all()
    best = {(a, int(b)) for a in range(300) for b in np.argsort(-(v @ v.T)[a]) if b != a}
    kept = set(zip(i.tolist(), j.tolist()))
    assert kept <= best and all((a, int(b)) in kept for a in range(300) for b in np.argsort(-(v @ v.T - 2 * np.eye(300))[a])[:10])


def test_tiles_are_spread_whatever_the_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = vectors(260, 1, ("a",))
        assert found(spark, rows, query_block=16, base_block=40) == brute(rows)
        plan = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), query_block=16, base_block=40)._jdf.queryExecution().executedPlan().toString()
        grouped = plan[plan.index("FlatMapGroupsInArrow") :]
        assert "hashpartitioning(model" in grouped[: grouped.index("Union")] and "REPARTITION_BY_NUM" in grouped[: grouped.index("Union")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_disk_follows_the_vectors_and_not_the_tiles(spark):
    from lexspark.session import written_dir

    def files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        shuffled = {(f := blocks.apply(n)).getPath(): f.length() for n in range(blocks.size())}
        folder = Path(written_dir(spark).removeprefix("file://"))
        return shuffled | {str(p): p.stat().st_size for p in folder.rglob("*") if p.is_file()}

    rows = vectors(600, 8, ("a",))
    old = files()
    assert found(spark, rows, query_block=20, base_block=40) == brute(rows)
    used = sum(n for path, n in files().items() if path not in old)
    assert used < 5 * 600 * 128 * 4, used


def test_tile_takes_blocks_one_after_another():
    rng = np.random.default_rng(9)
    v = np.concatenate([c + 0.2 * rng.normal(size=(500, 128)) for c in rng.normal(size=(4, 128))]).astype(np.float32)
    ids = rng.permutation(len(v)) * 10
    codes = neighbours.quantised(neighbours.unit_rows(v))
    part = lambda s: neighbours._Vectors(ids[s], neighbours.Codes(*(c[s] for c in codes)), v[s])
    best = neighbours._Best(part(slice(300, 900)), 10, 6)
    for at in range(0, len(v), 700):
        best.add(part(slice(at, at + 700)))
    u = neighbours.unit_rows(v)
    cosines = np.round(u @ u.T, 6)
    got = best.table().to_pydict()
    want = [[b for b in np.lexsort((ids, -cosines[a])) if b != a][:10] for a in range(300, 900)]
    assert got["head"] == np.repeat(ids[300:900], 10).tolist() and got["other"] == [int(ids[b]) for row in want for b in row]


def test_on_the_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/query_embeddings.parquet").select("query_id", "embeddings", "model")
    rows = [(r[0], r[1], r[2], None) for r in df.collect()]
    assert {tuple(r) for r in neighbours.neighbour_pairs(neighbours.nearest(df)).collect()} == brute(rows)
