"""The keyed sweep gives what single runs give, point by point."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowprism import session
from flowprism.operators import components, experiments, scaling

TIMES = ("training_time", "test_time")
MEASURES = ("mcc", "ndr", "auc_n", "acc", "tpr_macro", "fpr", "ppv_macro", "f1_macro")


@pytest.fixture(scope="module")
def rows(spark):
    names = ("0_normal", "dos", "scan")
    made = [(i, names[i % 3], [float(i % 3) * 2 + float((i * 7) % 11) / 7, float((i * 5) % 13) / 5, float(i % 4)]) for i in range(120)]
    return spark.createDataFrame([*made, (200, "0_normal", made[0][2])], "id bigint, label string, vector array<double>").cache()


def told(frame):
    return {(r["mode"], r["kernel"], r["scaler"], r["steps"]): r for r in frame.collect()}


def test_points_equal_single_runs(spark, rows):
    runs = [("supervised", []), ("novelty", ["scan"])]
    swept = told(experiments.sweep(rows, runs, kernels=["rbf", "sigmoid"], scalers=["minmax"], steps=[2, 6]))
    assert len(swept) == 2 * 2 * 2
    for (mode, dropped), kernel, scaler, steps in ((runs[0], "rbf", "minmax", 2), (runs[1], "sigmoid", "minmax", 6)):
        single = experiments.run(rows, mode, dropped, kernel=kernel, scaler=scaler, steps=steps).first()
        point = swept[mode, kernel, scaler, steps]
        assert point["drop_cls"] == single["drop_cls"] and point["clusters"] == single["clusters"]
        assert [point[m] for m in MEASURES] == pytest.approx([single[m] for m in MEASURES])
        assert point["threshold"] == pytest.approx(single["threshold"])


def test_scalers_of_all_runs_equal_single_fits(spark, rows):
    both = rows.withColumn("run", (F.col("id") % 2).cast("int"))
    found = scaling.fit_scalers(both, scaling.KINDS, "run")
    assert set(found) == {(run, kind) for run in (0, 1) for kind in scaling.KINDS}
    for (run, kind), scaler in found.items():
        single = scaling.fit_scaler(both.where(F.col("run") == run), kind)
        for name in ("center", "spread"):
            assert getattr(scaler, name) == pytest.approx(getattr(single, name))
        assert [x for q in scaler.quantiles for x in q] == pytest.approx([x for q in single.quantiles for x in q])


@pytest.mark.parametrize("shape", ["chain", "star"])
def test_edges_shrink_every_round(spark, monkeypatch, shape):
    n = 100_000 if shape == "chain" else 20_000
    nodes = spark.range(n + 5)
    middle = n // 2
    pairs = spark.range(n - 1).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    if shape == "star":
        pairs = spark.range(n).where(F.col("id") != middle).select(F.col("id").alias("i"), F.lit(middle).cast("bigint").alias("j"))
    sizes, keep = [], components.stored

    def counted(df, name="table"):
        out = keep(df, name)
        if name == "edges":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(components, "stored", counted)
    roots = components.connected_components(nodes, pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"))))
    assert {(r[0], r[1]) for r in roots.groupBy("root").count().collect()} == {(0, n)} | {(n + k, 1) for k in range(5)}
    assert sizes[-1] == 0 and len(sizes) < 45 and all(b < a for a, b in zip(sizes, sizes[1:]))


def disk_files(spark):
    """Shuffle files and other blocks on this machine's disk."""
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def test_scratch_drops_what_it_wrote(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, files = spark.conf.get(setting), disk_files(spark)
    with session.scratch(spark) as outer:
        with session.scratch(spark) as keep:
            inner = session.stored(spark.range(100).repartition(3))
            durable = session.durable(spark.range(5))
            kept = keep(inner.groupBy((F.col("id") % 7).alias("k")).count())
            folders = [Path(frame.inputFiles()[0].removeprefix("file:")).parent for frame in (inner, durable)]
            assert all(folder.exists() for folder in folders)
        assert not any(folder.exists() for folder in folders)
        assert kept.count() == 7
        last = outer(kept, "last")
    assert spark.conf.get(setting) == before and last.count() == 7
    with pytest.raises(ZeroDivisionError), session.scratch(spark):
        lost = Path(session.stored(spark.range(3)).inputFiles()[0].removeprefix("file:")).parent
        raise ZeroDivisionError
    assert not lost.exists() and spark.conf.get(setting) == before
    # The files of a query's shuffles go soon after it.
    until = time.time() + 20
    while disk_files(spark) > files + 20 and time.time() < until:
        time.sleep(0.5)
    assert disk_files(spark) <= files + 20


def test_slices_hold_every_point_once(monkeypatch):
    grid = experiments.Grid([("supervised", [])], list("abcde"), list("vwxyz"), [5, 100], 10, 3)
    for rows, most in ((1, 25), (experiments.SLICE // 105 // 11, 11), (experiments.SLICE // 105 // 3, 3), (experiments.SLICE, 1)):
        slices = [(s, k) for s, many in experiments._slices(grid, rows) for k in many]
        assert sorted((a, b) for s, k in slices for a in s for b in k) == sorted((a, b) for a in "abcde" for b in "vwxyz")
        assert max(len(s) * len(k) for s, k in slices) <= most


def test_slices_leave_no_tables_behind(spark, rows, monkeypatch):
    """Each kernel a slice of its own: the same rows, one kernel's lists at a time, nothing left in the shared folder."""
    session.ensure_checkpoint_dir(spark)
    shared = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    sizes, fit = [], experiments._fit

    def counted(train, grid, kind, digits):
        model = fit(train, grid, kind, digits)
        sizes.append((list(grid.scalers), list(grid.kernels), model.lists.count()))
        return model

    monkeypatch.setattr(experiments, "_fit", counted)
    options = {"kernels": ["rbf", "sigmoid"], "scalers": ["minmax"], "steps": [3], "outliers": False}
    before = set(shared.iterdir())
    whole = told(experiments.sweep(rows, [("supervised", [])], **options))
    monkeypatch.setattr(experiments, "SLICE", 1)
    sliced = told(experiments.sweep(rows, [("supervised", [])], **options))
    assert {key: row.asDict() for key, row in sliced.items()} == {key: row.asDict() for key, row in whole.items()}
    assert [s[:2] for s in sizes] == [(["minmax"], ["rbf", "sigmoid"]), (["minmax"], ["rbf"]), (["minmax"], ["sigmoid"])]
    assert max(s[2] for s in sizes[1:]) < sizes[0][2] == sizes[1][2] + sizes[2][2]
    assert set(shared.iterdir()) <= before
