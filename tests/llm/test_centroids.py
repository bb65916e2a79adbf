import hashlib
import math
import random

import numpy as np
import pytest

from loggrove.llm.centroids import cluster_vectors, component_sums, dots, norms, to_planes

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, planes binary, v int, `a.b` int"


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, b"", 2, 3) for i, v in rows], SCHEMA)


def brute(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in kept[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((square(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for n in range(len(centroids)):
            members = [v for (_, v), (_, c) in zip(kept, own) if c == n]
            if members:
                centroids[n] = [sum(column) // len(members) for column in zip(*members)]
    own = assign()
    inertia = {n: sum(d for d, c in own if c == n) for n in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, own)), key=str)


def found(frame):
    return sorted(map(tuple, cluster_vectors(frame).collect()), key=str)


@pytest.mark.parametrize("bits", [1, 2, 11, 28])
def test_planes_give_exact_products_and_sums(bits):
    r = np.random.default_rng(bits)
    low, high = -(1 << bits - 1), (1 << bits - 1)
    a, b = r.integers(low, high, (50, 64)), r.integers(low, high, (9, 64))
    pa, pb = to_planes(a, bits), to_planes(b, bits)
    assert (dots(pa, pb) == a @ b.T).all() and (norms(pa) == (a * a).sum(1)).all() and (component_sums(pa) == a.sum(0)).all()


def test_rows_are_those_of_plain_rounds(spark):
    r = random.Random(4)
    centre = [[r.gauss(0, 0.3) for _ in range(64)] for _ in range(6)]
    rows = [(i, [x + r.gauss(0, 0.1) for x in centre[i % 6]]) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[9][1]), (None, rows[9][1]), (900, None), (901, []), (902, [0.1] * 63), (903, [0.1] * 63 + [None]), (904, [0.1] * 63 + [float("nan")]), (905, [float("-inf")] * 64), (906, [0.0] * 64), (907, [-100.0] * 64)]
    assert found(frame_of(spark, rows)) == brute(rows)


def test_ties_copies_and_empty_centroids(spark):
    rows = [(i, [0.5] * 64) for i in range(30)] + [(100 + i, [-0.25] * 64) for i in range(3)]
    assert found(frame_of(spark, rows)) == brute(rows)


def test_few_vectors_and_none(spark):
    rows = [(i, [i / 8] * 64) for i in range(3)]
    assert found(frame_of(spark, rows)) == brute(rows)
    assert found(frame_of(spark, [(1, None)])) == []
    assert found(frame_of(spark, [])) == []


def test_components_that_no_long_distance_can_hold_are_an_error(spark):
    with pytest.raises(Exception, match="27 bits"):
        found(frame_of(spark, [(1, [1e30] * 64)]))
