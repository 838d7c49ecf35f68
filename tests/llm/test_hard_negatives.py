"""Hard negatives against brute force and SQL."""

import random

import numpy as np
import pytest
from edge_tables import as_set, with_clashes
from pyspark.sql import functions as F
from side_by_side import connect, differences

from valuescout.llm import hard_negatives as module
from valuescout.llm.hard_negatives import SQL, brute_force, hard_negatives, integers, op12_hard_negatives, planes, scores

SCHEMA = "vec_id long, embedding array<double>, label int"


def vectors(seed, n, size=11, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.uniform(-spread, spread) for _ in range(size)], rng.randint(0, 2)) for i in range(n)]


def awkward():
    rows = vectors(1, 60)
    rows += [rows[0], rows[0], rows[7]]  # equal rows
    rows += [(10, [0.5] * 11, 1), (10, [-0.25] * 11, 1), (3, [0.5] * 11, 0), (None, [0.1] * 11, 0)]
    rows += [(100 + i, [0.25] * 11, i % 3) for i in range(12)]  # ties
    rows += [(200, None, 1), (201, [0.1] * 10 + [None], 1), (202, [float("nan")] * 11, 1), (203, [float("inf")] * 11, 2)]
    rows += [(210, [0.5] * 11, None), (211, [], 1), (212, [0.5, -0.25], 2), (213, [0.0] * 11, 0), (220, [1e30] * 11, 0)]
    return rows


def usable(rows):
    return [r for r in rows if r[1] is None or all(x is None or not abs(x) < 1e300 or abs(x) < 1e6 for x in r[1])]


def test_planes_round_trip():
    rng = np.random.default_rng(5)
    for bits in (1, 2, 8, 20, 32):
        top = 1 << (bits - 1)
        values = rng.integers(-top, top, (50, 24), dtype=np.int64)
        assert (integers(planes(values, bits)) == values).all()


def test_scores_are_exact():
    rng = np.random.default_rng(6)
    for bits, size in ((8, 64), (5, 16), (20, 24), (31, 8), (32, 40)):
        top = 1 << (bits - 1)
        a, b = (rng.integers(-top, top, (n, size), dtype=np.int64) for n in (300, 700))
        with np.errstate(over="ignore"):
            assert (scores(a, planes(b, bits)) == a @ b.T).all()


@pytest.mark.parametrize("block", [4096, 16])
def test_awkward_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    df = with_clashes(spark.createDataFrame(awkward(), SCHEMA))
    found = hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert as_set(found.collect()) == as_set(brute_force(usable(awkward()), lambda i: i % 10 == 0))


def test_large_components(spark):
    rows = vectors(3, 40, size=9, spread=1e6)
    found = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 4 == 0)
    assert as_set(found.collect()) == as_set(brute_force(rows, lambda i: i % 4 == 0))


def test_other_parameters(spark):
    rows = [(i, v, f"label {k}") for i, v, k in vectors(4, 50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    single = [(i, [float(np.float32(x)) for x in v], k) for i, v, k in rows]
    found = hard_negatives(df, F.col("vec_id") < 5, scale=64, positives=2, negatives=3, low=-50, high=99)
    assert as_set(found.collect()) == as_set(brute_force(single, lambda i: i < 5, 64, 2, 3, -50, 99))


def test_one_label_and_empty(spark):
    rows = [(i, v, 1) for i, v, _ in vectors(2, 30)]
    assert hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 3 == 0).count() == 0
    assert hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 3 == 0).count() == 0
    assert hard_negatives(spark.createDataFrame(vectors(2, 9), SCHEMA), F.lit(None).cast("boolean")).count() == 0


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, folder):
    folder = f"/root/testdata/{folder}"
    assert differences(spark, connect(folder), op12_hard_negatives, SQL, folder) == ""
