"""Hard negatives and whitening against plain numpy."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowprism.llm import negatives, whitening

SCHEMA = "vec_id bigint, label int, embedding array<float>, body string, anchor_id string"


def rows(n=400, size=6, seed=3):
    rng = np.random.default_rng(seed)
    made = []
    for i in range(n):
        label = 1 if i % 3 else int(rng.integers(0, 5))
        made.append((i, label, [float(np.float32(x)) for x in np.round(rng.normal(0.3 * label, 0.4, size), 1)], "b", "c"))
    made += [(1000, None, [1.0] * size, "", ""), (1050, 2, None, "", ""), (1100, 2, [1.0, None] + [0.0] * (size - 2), "", ""), (1150, 2, [math.nan] * size, "", ""),
             (None, 1, [0.1] * size, "", ""), (1200, 2, [math.inf] + [0.0] * (size - 1), "", ""), (1250, 1, [], "", ""), (1300, 1, [0.5], "", ""), made[50]]
    return made


def brute(made, every=50):
    kept = {}
    for i, label, v, *_ in made:
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v):
            kept[i] = (label, [math.floor(256 * x) for x in v])
    out = defaultdict(list)
    for a, (label, x) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, own == label) for i, (own, y) in kept.items() if i != a and len(y) == len(x))
        for down, p, _ in [s for s in scored if s[2]][:5]:
            inside = [(-d, i) for d, i, same in scored if not same and 50 * -down <= 100 * -d <= 95 * -down]
            out[a] += [(a, p, k + 1, i, -down, s) for k, (s, i) in enumerate(inside[:3])]
    return sorted(r for found in out.values() for r in found)


@pytest.mark.parametrize("block,most", [(8192, 4096), (40, 3)])
def test_hard_negatives(spark, block, most):
    made = rows()
    table = spark.createDataFrame(made, SCHEMA).repartition(4)
    got = negatives.mine(table, F.col("vec_id") % 50 == 0, block=block, most=most)
    want = brute(made)
    assert len(want) > 20 and sorted(map(tuple, got.collect())) == want


def test_wide_scores_and_no_rows(spark):
    made = [(i, i % 2, [float(2**50 + i), 3.0 * i], "", "") for i in range(0, 20)]
    table = spark.createDataFrame(made, SCHEMA.replace("float", "double"))
    held = 2**63 - 1
    got = negatives.mine(table, F.col("vec_id") == 0, negatives=2).collect()
    # All products pass 64 bits, so all scores are held at their end and no window below them has rows.
    assert got == [] and negatives.scores(np.array([[2**58]]), np.array([[2**20]]))[0, 0] == held
    assert negatives.mine(table.limit(0), F.col("vec_id") == 0).count() == 0
    wide = np.array([[2**60 + 5, 2**60 + 5, 7, 2**60 + 9]])
    assert [a.tolist() for a in negatives.best(wide, np.array([[True, True, True, False]]), 2)] == [[0, 0], [0, 1]]


def test_whitening(spark):
    made = rows(size=20)
    table = spark.createDataFrame([*made, (5000, 1, made[7][2], "", "")], SCHEMA).repartition(3)
    got = whitening.components_of(table).toPandas().sort_values(["vec_id", "component"])
    kept = [(i, v) for i, _, v, *_ in [*made, (5000, 1, made[7][2])] if v is not None and len(v) == 20 and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    z = fit - sums / n
    v = z.T @ z / n
    e, c = np.linalg.eigh(v)
    e, c = e[::-1][:16], c[:, ::-1][:, :16]
    assert len(got) == 16 * len(kept) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10
    order = np.argsort([-1 if i is None else i for i, _ in kept], kind="stable")
    own = got[got["vec_id"].notna()]
    ids = [kept[k][0] for k in order if kept[k][0] is not None]
    assert own["vec_id"].drop_duplicates().tolist() == sorted(set(ids))
    for i in (0, 7, 5000, 399):
        k = next(k for k, (j, _) in enumerate(kept) if j == i)
        part = own[own["vec_id"] == i].iloc[:16]
        assert part["deviation"].iloc[0] == sum(int(n * a - s) ** 2 for a, s in zip(x[k].tolist(), sums.tolist()))
        assert np.abs(part["whitened"]) .to_numpy() == pytest.approx(np.abs((x[k] - sums / n) @ c / np.sqrt(e)), rel=1e-6, abs=1e-8)
        assert part["explained"].to_numpy() == pytest.approx(e / np.trace(v), rel=1e-10)
    again = whitening.transform(table, whitening.fit(table))
    assert again.columns == [*table.columns, "whitened", "deviation"] and again.count() == len(kept)


def test_clustered_eigenvalues():
    rng = np.random.default_rng(5)
    for spread in ([1.0] * 20, [3.0] + [1.0] * 10 + [1 + 1e-9 * k for k in range(9)], list(rng.uniform(1, 2, 20)), [0.0] * 5 + [1e-8] * 5 + [1.0] * 10):
        turn, _ = np.linalg.qr(rng.normal(size=(20, 20)))
        a = (turn * np.array(spread)) @ turn.T
        a = (a + a.T) / 2
        values, x = whitening.refine(a)
        assert np.abs(x.T @ x - np.eye(20)).max() < 5e-15 and np.abs(a @ x - x * values).max() < 5e-15
        assert values == pytest.approx(np.sort(np.linalg.eigvalsh(a))[::-1], abs=1e-14)


def test_nothing_to_whiten(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert whitening.components_of(table).count() == 0
    same = spark.createDataFrame([(i, 1, [1.0, 2.0], "", "") for i in range(3)], SCHEMA)
    assert whitening.components_of(same).count() == 0
    assert [r["deviation"] for r in whitening.transform(same, whitening.fit(same)).collect()] == [0, 0, 0]
    big = np.array([[2**40, -(2**40)]])
    assert whitening.deviations(big, 2**20, [0, 0]) == [None] and whitening.deviations(big, 4, [0, 0]) == [None] and whitening.deviations(big // 2**20, 4, [0, 0]) == [2 * 4**2 * 2**40]
