import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from assayloom.llm import segmine

LARGEST = (1 << 63) - 1


def brute(rows):
    """By the definition, in whole numbers."""
    good = {(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    good = [(i, lab, [math.floor(256 * Fraction(x)) for x in v]) for i, lab, v in good]
    out = []
    for i, lab, x in good:
        if i % 100:
            continue
        scored = [(max(-LARGEST, min(LARGEST, sum(a * b for a, b in zip(x, y)))), j, other) for j, other, y in good if j != i and len(y) == len(x)]
        scored.sort(key=lambda t: (-t[0], t[1]))
        for p, pid, _ in [t for t in scored if t[2] == lab][:5]:
            hard = [t for t in scored if t[2] != lab and 30 * p <= 100 * t[0] <= 90 * p][:10]
            out += [(i, pid, n, j, p, s) for n, (s, j, _) in enumerate(hard, 1)]
    return sorted(out)


def held(df, **sizes):
    return sorted(tuple(r) for r in segmine.hard_negatives(df, **sizes).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").repartition(3)


def test_embeddings(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    want = brute(rows)
    assert want and held(df) == want
    assert held(df, anchors_a_group=2, rows_a_group=40) == want


@pytest.mark.parametrize("dim", [1, 3, 16, 37])
def test_random_vectors(spark, dim):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(4, dim))
    rows = [(i, int(i % 4), np.round(centres[i % 3] + rng.normal(size=dim) * 0.7, 1 if dim < 4 else 6).tolist()) for i in range(900)]
    assert held(frame(spark, rows, "double")) == brute(rows)


def test_odd_rows(spark):
    v = [0.5, 0.25, 1.0]
    rows = [(0, 1, v), (1, 1, v), (2, 1, v), (2, 1, v), (2, 1, [0.1, 0.1, 0.1]), (3, 2, [0.3, 0.1, 0.6]), (3, 2, [0.3, 0.1, 0.6]), (4, None, v), (5, 2, None), (6, 2, [None, 1.0, 1.0]), (8, 2, [float("nan"), 1.0, 1.0]), (9, 2, [float("inf"), 1.0, 1.0]), (10, 2, [1.0]), (None, 1, v)]
    rows += [(100, 3, [0.0, 0.0, 0.0]), (101, 3, [0.0, 0.0, 0.0]), (102, 4, [0.0, 0.0, 0.0]), (200, 5, []), (201, 5, []), (202, 6, []), (300, 7, [1.0, 2.0]), (7, 3, v), (700, 9, v), (400, 1, [-1.0, -0.5, -2.0])]
    df = frame(spark, rows).selectExpr("*", "1 as name", "2 as n", "3 as dim", "4 as mean")
    assert held(df) == brute(rows)
    assert held(df.limit(0)) == [] and held(df.filter("vec_id = 3")) == []


def test_extreme_components(spark):
    """Beyond the whole numbers of a double, of a long, and where 256 times the component is no double."""
    rng = np.random.default_rng(5)
    rows = [(100 * i + k, k % 2, (rng.normal(size=4) * 10.0**e).tolist()) for i, e in enumerate((-300, 3, 5, 7, 8, 20, 150, 300)) for k in range(8)]
    rows += [(900, 1, [1.7e308, 5e-324, -1.7e308, 0.0]), (901, 1, [1.7e308, 1.0, -1.6e308, 2.0]), (903, 2, [3.0, 1.0, 1.0, 2.0])]
    rows += [(1000, 1, [3.0e6, 1.0, 7.0, 9.0]), (1001, 1, [3.0e6, 5.0, 1.0, 3.0])] + [(1002 + 2 * k, 2, [2.0e6 + k / 256, 1.0, 1.0, float(k)]) for k in range(20)]
    assert held(frame(spark, rows, "double")) == brute(rows)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, i % 2, [1.0, 1.0] if i % 2 == 0 else [0.5, 0.5]) for i in range(300) if i % 7]
    rows += [(0, 9, [1.0, 1.0])]
    assert held(frame(spark, rows)) == brute(rows)
    assert held(frame(spark, rows), anchors_a_group=1, rows_a_group=30) == brute(rows)


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(2)
    for dim in (1, 5, 16, 64):
        x = segmine.floors(rng.normal(size=(60, dim)) * rng.lognormal(size=(60, 1)))
        mean, dev = (m.astype(np.float32) for m in segmine.summary(x))
        rows = pa.table({"vec_id": range(60), "label": [0] * 60, "v": pa.array((x / 256).tolist(), pa.list_(pa.float64())), "mean": pa.array(mean.tolist(), pa.list_(pa.float32())), "dev": pa.array(dev.tolist(), pa.list_(pa.float32()))})
        b = segmine.Block(rows)
        exact, last = x @ x.T, None
        for m, d in b.levels:
            slack = d @ d.T + segmine.SLACK * b.norm[:, None] * b.norm[None, :]
            assert (np.abs(exact - m @ m.T) <= slack).all()
            assert last is None or (slack <= last * (1 + 1e-6)).all()  # finer segments bound more tightly
            last = slack
        assert b.levels[0][0].shape[1] == 1 and b.levels[-1][0].shape[1] == len(segmine.segments(dim))


def test_hot_label(spark):
    rng = np.random.default_rng(9)
    rows = [(i, 1 if i % 3 else i % 10, rng.normal(size=8).tolist()) for i in range(800)]
    assert held(frame(spark, rows), anchors_a_group=3, rows_a_group=50) == brute(rows)
