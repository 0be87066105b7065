import numpy as np
import pytest

from assayloom.llm import blockjoin


def dot(x, y):
    """Summed in order; sum() of floats compensates and np.dot regroups."""
    total = 0.0
    for a, b in zip(x, y):
        total += a * b
    return total


def brute(rows, every=20, k=20):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(len(v), []).append((i, np.array(v, np.float64)))
    out = []
    for group in good.values():
        for q, x in group:
            if q % every == 0:
                best = sorted({(-dot(x.tolist(), y.tolist()), i) for i, y in group if i != q})[:k]
                out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return out


def compare(got, want):
    a, b = sorted((r.query_id, r.rank, r.vec_id) for r in got), sorted(w[:3] for w in want)
    assert a == b
    scores = {w[:2]: w[3] for w in want}
    assert all(r.score == scores[(r.query_id, r.rank)] for r in got)  # to the last bit


def test_exact_neighbours(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    compare(blockjoin.nearest(df).collect(), brute(rows))
    compare(blockjoin.nearest(df, queries_a_group=7, rows_a_group=60).collect(), brute(rows))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [3.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (9, [1.0]), (40, [2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    compare(blockjoin.nearest(df).collect(), brute(rows))
    assert blockjoin.nearest(df.limit(0)).count() == 0 and blockjoin.nearest(df.filter("vec_id = 1")).count() == 0


def test_equal_vectors_tie(spark):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=64).astype(np.float32).tolist()
        rows = [(i, x) for i in range(41)] + [(100 + i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(30)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        for sizes in ({}, {"queries_a_group": 2, "rows_a_group": 7}):
            compare(blockjoin.nearest(df, **sizes).collect(), brute(rows))


def test_repeated_rows_push_nobody_out(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1, 200)]
    near = rows[19][1]  # vec_id 20
    rows += [(303, [1.01 * c for c in near])] * 50  # one vector of one id, more often than k
    rows += [(301, [(1 + k / 100) * c for c in near]) for k in range(50)]  # many vectors of one id
    rows += [(40, rng.normal(size=6).tolist()) for _ in range(3)]  # a query of several vectors
    want = []
    for q in range(20, 200, 20):
        best = {}
        for x in [np.array(v) for i, v in rows if i == q]:
            for i, v in rows:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), dot(v, x.tolist()))
        want += [(q, n, i, s) for n, (s, i) in enumerate(sorted(((s, i) for i, s in best.items()), key=lambda p: (-p[0], p[1]))[:20], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for sizes in ({}, {"queries_a_group": 3, "rows_a_group": 40}):
        compare(blockjoin.nearest(df, **sizes).collect(), want)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for tile in (7, 64, 2048):
        found = blockjoin.nearest_in_cell(ids[19:20], x[19:20], ids, x, 20, tile)[0]
        assert [n for _, n in found] == [i for q, _, i, _ in want if q == 20]


def test_components_of_any_size(spark):
    """From the smallest to the largest doubles, among plain vectors."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=2).tolist()) for i in range(1, 80)] + [(0, [1.0, 1.0]), (100, [1e300, 1e300]), (120, [5e-324, 1e-323]), (140, [1e160, -1e-200])]
    rows += [(201, [1e200, 1e200]), (202, [1e308, 1e308]), (203, [1e308, 1.7e308]), (204, [1e-323, 5e-324]), (205, [-1e308, -1e308]), (206, [1e141, 1.0]), (207, [1e-141, 1e-160])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for sizes in ({}, {"queries_a_group": 2, "rows_a_group": 9}):
        compare(blockjoin.nearest(df, **sizes).collect(), brute(rows))


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 33)) * rng.lognormal(size=(50, 1))
    q, s = blockjoin.quantised(x)
    back = q * s[:, None]
    err = np.linalg.norm(x - back, axis=1)
    assert (np.abs(x @ x.T - back @ back.T) <= err[:, None] * np.linalg.norm(x, axis=1)[None, :] + np.linalg.norm(back, axis=1)[:, None] * err[None, :] + 1e-9).all()


def test_pipeline(spark, sf_dir):
    cp = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(cp.STAGES):
        after = stage(spark, before, sf_dir)
        if k < len(cp.STAGES) - 1:
            assert after.columns == docs.columns, name
            after = after.persist()
            ids = {r.doc_id for r in after.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and len(ids) > 0.5 * before.count(), name
            before = after
        else:
            rows = after.collect()
            assert {r.doc_id for r in rows} == {r.doc_id for r in before.select("doc_id").collect()}
    assert [name for name, _ in cp.STAGES] == ["language_id", "toxicity", "near_dedup", "mixing", "packing"]


def test_pipeline_on_odd_and_empty_tables(spark, sf_dir, odd, none):
    cp = pytest.importorskip("corpus_pipeline")
    for start in (odd, none):
        docs = start
        for k, (name, stage) in enumerate(cp.STAGES):
            after = stage(spark, docs, sf_dir)
            if k < len(cp.STAGES) - 1:
                assert after.columns == start.columns, name
                docs = after.persist()
        assert after.count() >= 0 and (start is odd or after.count() == 0)
