"""Neighbours, kINN, thresholds and quantiles against plain numpy restatements."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowprism.functions.kernels import block_distances
from flowprism.operators import baselines, kinn, metrics, threshold
from flowprism.operators.components import connected_components
from flowprism.operators.neighbours import neighbours
from flowprism.operators.numbering import exact_quantiles, number_rows
from flowprism.operators.scaling import Scaler, fit_scaler, load_scaler, probit, save_scaler
from flowprism.operators.split import stratified_split
from flowprism.sources import tables
from tests.conftest import SF


def table(spark, x, classes=None):
    classes = [0] * len(x) if classes is None else classes
    rows = [(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(classes, x, strict=True))]
    return spark.createDataFrame(rows, "id bigint, class int, vector array<double>")


def walk(d, own, steps):
    """The list of one point: sorted distances until the steps-th change."""
    order = np.lexsort((np.arange(len(d)), d))
    out, last, count = [], d[own], 0
    for x in order:
        changed = abs(d[x] - last) > 0.5e-6
        out.append(int(x))
        last = d[x]
        count += changed
        if count >= steps:
            break
    return out


@pytest.mark.parametrize("kernel", ["linear", "rbf", "euclidean", "poly", "sigmoid"])
def test_pruned_blocks_equal_brute_force(spark, kernel):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.3, (40, 3)) for c in (0, 4, 9)]).round(1)
    x = np.unique(x, axis=0)
    d = np.round(block_distances(x, x, kernel), 6) + 0.0
    np.fill_diagonal(d, 0.0)
    rows = table(spark, x).withColumnRenamed("class", "grp")
    got = neighbours(rows, rows, 4, kernel=kernel, digits=6, block_rows=16).orderBy("i", "pos").collect()
    lists = {}
    for r in got:
        lists.setdefault(r["i"], []).append(r["j"])
    if kernel == "sigmoid":
        # squared form may be below 0: compare as sets of distances
        assert len(lists) == len(x)
    else:
        assert lists == {i: walk(d[i], i, 4) for i in range(len(x))}


@pytest.mark.parametrize(("kernel", "same"), [("linear", True), ("euclidean", False), ("rbf", True), ("poly", False)])
def test_blocks_of_one_cell_are_pruned(spark, monkeypatch, kernel, same):
    """With few pivots a cell holds many blocks: equal lists to brute force, from a fifth of its block pairs at most."""
    from flowprism.operators import neighbours as search

    monkeypatch.setattr(search, "LEAST_PIVOTS", 4)
    monkeypatch.setattr(search, "MAX_PIVOTS", 4)
    rng = np.random.default_rng(11)
    flat = rng.uniform(0, 10, (60, 2))
    x = np.repeat(flat, 50, axis=0) + rng.normal(0, 0.05, (3000, 2))
    x = (np.hstack([x, x @ np.array([[0.5], [0.2]])]) / 4).round(5)
    x = np.unique(x, axis=0)
    rows = table(spark, x).withColumnRenamed("class", "grp")
    asked = x if same else (x[::7] + 0.001).round(5)
    queries = rows if same else table(spark, asked).withColumnRenamed("class", "grp")
    planned = []
    compare = search._compare

    def counted(q, p, units, plan):
        inside = units.where(F.col("q_cell") == F.col("p_cell"))
        planned.append((inside.count(), units.count()))
        return compare(q, p, units, plan)

    monkeypatch.setattr(search, "_compare", counted)
    index = search.build_index(rows, kernel, block_rows=16)
    cells = index.tiles.groupBy("grp", "cell").agg(F.sum("parts").alias("n"))
    if not same:
        tiles = search._blocked(search._placed(queries.withColumn("weight", F.lit(1.0)), index.pivots, kernel), 16, index.edges)[1]
        other = tiles.groupBy("grp", "cell").agg(F.sum("parts").alias("m"))
        cells = cells.join(other, ["grp", "cell"])
    every = cells.agg(F.sum(F.col("n") * F.col("n" if same else "m"))).first()[0]
    got = neighbours(queries, rows, 3, kernel=kernel, levels=False, same=same, digits=6, block_rows=16, index=index).collect()
    d = np.round(block_distances(asked, x, kernel), 6) + 0.0
    if same:
        np.fill_diagonal(d, np.inf)
    lists = {}
    for r in sorted(got, key=lambda r: (r["i"], r["pos"])):
        lists.setdefault(r["i"], []).append(r["j"])
    wanted = {i: [int(j) for j in np.lexsort((np.arange(len(x)), d[i]))[:3]] for i in range(len(asked))}
    assert lists == wanted
    assert sum(n for n, _ in planned) <= 0.2 * every, (planned, every)


def test_weighted_lists_with_pruning(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.5, (50, 2)) for c in (0, 6)])
    w = rng.uniform(0.5, 2.0, len(x))
    d = np.round(block_distances(x, x, "euclidean") * w[None, :], 6)
    np.fill_diagonal(d, 0.0)
    rows = table(spark, x).withColumnRenamed("class", "grp")
    weights = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "id bigint, w double")
    rows = rows.join(weights, "id")
    got = neighbours(rows, rows, 3, kernel="euclidean", weight=F.col("w"), digits=6, block_rows=16).orderBy("i", "pos").collect()
    lists = {}
    for r in got:
        lists.setdefault(r["i"], []).append(r["j"])
    assert lists == {i: walk(d[i], i, 3) for i in range(len(x))}


def reference_clusters(x, classes, steps):
    n = len(x)
    lists = [None] * n
    for c in sorted(set(classes)):
        members = [i for i in range(n) if classes[i] == c]
        d = np.round(block_distances(x[members], x[members], "linear"), 6)
        np.fill_diagonal(d, 0.0)
        for a, i in enumerate(members):
            lists[i] = [members[b] for b in walk(d[a], a, steps)]
    label, current = [-1] * n, 0
    for i in range(n):
        if label[i] == -1:
            queue = [i]
            label[i] = current
            for q in queue:
                for p in lists[q]:
                    if q in lists[p] and label[p] == -1:
                        label[p] = current
                        queue.append(p)
            current += 1
    return label


def test_copies_fold_into_one_node_without_changing_clusters(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 6, (120, 2)).astype(float)
    x[:40] = x[0]  # a third of all rows are copies
    classes = [i % 2 for i in range(120)]
    expected = reference_clusters(x, classes, 2)
    model = kinn.fit(table(spark, x, classes), 2, kernel="linear", digits=6, block_rows=8)
    node = {r["id"]: r["node"] for r in model.members.collect()}
    cluster = {r["id"]: r["cluster"] for r in model.clusters.collect()}
    got = [cluster[node[i]] for i in range(120)]
    pairs = {(a, b) for a, b in zip(expected, got, strict=True)}
    assert len(pairs) == len(set(expected)) == len(set(got))
    assert {r["conflicts"] for r in model.cluster_map.collect()} == {0}


def test_density_lists_match_the_dense_form(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (60, 3))
    x[10] = x[11] = x[12]  # copies count as separate points in the means
    steps = 4
    d = block_distances(x, x, "euclidean")
    np.fill_diagonal(d, 0.0)
    for a in (10, 11, 12):
        for b in (10, 11, 12):
            d[a, b] = 0.0
    r = np.round(d, 6)
    first = [walk(r[i], i, steps) for i in range(60)]
    k = np.array([max([r[i, j] for j in first[i] if r[i, j] > 0], default=-1) for i in range(60)])
    lrd = np.array([1 / np.mean([max(r[i, j], k[j]) for j in first[i]]) for i in range(60)])
    lof = np.array([np.mean(lrd[first[i]]) / lrd[i] for i in range(60)])
    weighted = np.round(d * lof[None, :], 6)
    expected = {i: walk(weighted[i], i, steps) for i in range(60) if i not in (11, 12)}
    nodes = kinn.distinct_nodes(table(spark, x))
    got = {}
    for row in kinn.fit_lists(nodes, steps, "euclidean", "density", digits=6).orderBy("i", "pos").collect():
        got.setdefault(row["i"], []).append(row["j"])
    assert got == {i: [j for j in js if j not in (11, 12)] for i, js in expected.items()}


def test_components_on_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    both = edges + [(b, a) for a, b in edges]
    ids = sorted({i for e in both for i in e} | {5000})
    nodes = spark.createDataFrame([(i,) for i in ids], "id bigint")
    roots = connected_components(nodes, spark.createDataFrame(both, "i bigint, j bigint")).collect()
    assert {r["id"]: r["root"] for r in roots} == {i: 0 if i <= 200 else 1000 if i < 5000 else 5000 for i in ids}


def mcc(truth, pred):
    labels = sorted(set(truth) | set(pred))
    truth, pred = np.array(truth), np.array(pred)
    c, s = (truth == pred).sum(), len(truth)
    t = np.array([(truth == k).sum() for k in labels], float)
    p = np.array([(pred == k).sum() for k in labels], float)
    spread = np.sqrt(s * s - (p * p).sum()) * np.sqrt(s * s - (t * t).sum())
    return 0.0 if spread == 0 else (c * s - (t * p).sum()) / spread


def brute_threshold(truth, pred, score, target, ids):
    best, cuts, grid = (0.0, 0.0), {}, np.linspace(1e-7, 1e-1, 10_000)
    truth, pred, score = np.array(truth), np.array(pred), np.array(score)
    for i in ids:
        chosen = pred
        values = np.unique(np.searchsorted(grid, np.unique(score), side="left"))
        for k in np.unique(np.clip(np.concatenate([[0], values]), 0, 9_999)):
            moved = np.where((pred == i) & (score > grid[k]), target, pred)
            found = (mcc(truth, moved), (moved[truth == target] == target).mean())
            if np.mean([2 * found[0], found[1]]) > np.mean([2 * best[0], best[1]]):
                best, chosen, cuts[i] = found, moved, grid[k]
        pred = chosen
    return cuts, best, pred


@pytest.mark.parametrize("mode", ["novelty", "oneclass"])
def test_threshold_search_equals_brute_force(spark, mode):
    rng = np.random.default_rng(13)
    n = 300
    if mode == "novelty":
        truth = rng.choice([-1, 0, 1, 2], n)
        pred = np.where(truth == -1, rng.integers(0, 3, n), np.where(rng.random(n) < 0.1, (truth + 1) % 3, truth))
        novel, target, ids = truth == -1, -1, [0, 1, 2]
    else:
        truth, pred = rng.integers(0, 2, n), np.zeros(n, int)
        novel, target, ids = truth == 1, 1, [0]
    score = rng.random(n) * 0.06 + novel * 0.03 + np.where(rng.random(n) < 0.05, 1.0, 0.0)
    rows = [(i, int(t), int(p), float(s)) for i, (t, p, s) in enumerate(zip(truth, pred, score, strict=True))]
    df = spark.createDataFrame(rows, "id bigint, truth int, pred int, score double")
    found = threshold.search(df, mode)
    cuts, best, moved = brute_threshold(truth, pred, score, target, ids)
    assert (found.mcc, found.ndr) == pytest.approx(best)
    assert found.thresholds == pytest.approx(cuts)
    got = [r["pred"] for r in threshold.apply(df, found, mode).orderBy("id").collect()]
    assert got == list(moved)


def test_grid_buckets(spark):
    grid = np.linspace(1e-7, 1e-1, 10_000)
    values = [0.0, 1e-7, *[float(v) for v in grid[[1, 17, 5000, 9998, 9999]]], 0.05, 0.1, 5.0, -1.0]
    df = spark.createDataFrame([(v,) for v in values], "s double").select("s", threshold.bucket_of(F.col("s")).alias("b"))
    for row in df.collect():
        assert abs(row["b"] - int((row["s"] > grid).sum())) <= (1 if row["s"] in grid else 0)


def test_quantiles_with_ties_and_several_keys(spark):
    rng = np.random.default_rng(17)
    probs = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    data = {0: rng.normal(size=501), 1: np.repeat([1.0, 2.0, 7.0], [400, 5, 3]), 2: np.array([4.0])}
    rows = [(k, float(v)) for k, values in data.items() for v in values]
    df = spark.createDataFrame(rows, "key int, value double").repartition(7)
    got = {(r["key"], r["idx"]): r["quantile"] for r in exact_quantiles(df, probs).collect()}
    for key, values in data.items():
        assert [got[key, i] for i in range(len(probs))] == pytest.approx(list(np.quantile(values, probs)))


def test_number_rows_over_blocks(spark):
    df = spark.range(0, 100, 3).withColumn("c", F.col("id") % 2)
    rows = number_rows(df, "id", "at", first=["c"], bits=3).orderBy("c", "id").collect()
    assert [r["at"] for r in rows] == list(range(len(rows)))


def test_split_is_exact_per_class(spark):
    df = spark.range(1000).withColumn("label", F.when(F.col("id") % 10 == 0, "rare").otherwise("hot"))
    counts = stratified_split(df, "label", "id", 0.3).groupBy("label", "is_test").count().collect()
    assert {(r["label"], r["is_test"]): r["count"] for r in counts} == {
        ("rare", True): 30, ("rare", False): 70, ("hot", True): 270, ("hot", False): 630,
    }


def test_quantile_scaler_reaches_both_tails(spark, tmp_path):
    x = np.linspace(-1, 1, 101)[:, None]
    rows = table(spark, x)
    scaler = fit_scaler(rows, "quantile_normal")
    out = [r["vector"][0] for r in scaler.transform(rows).orderBy("id").collect()]
    assert out[0] == pytest.approx(-out[-1]) and out[0] == pytest.approx(-5.1993, abs=1e-3)
    assert out[50] == pytest.approx(0, abs=1e-9)
    assert probit(np.array([0.975]))[0] == pytest.approx(1.959964, abs=1e-6)
    save_scaler(spark, scaler, str(tmp_path / "s"))
    assert load_scaler(spark, str(tmp_path / "s")) == scaler


def test_constant_dimension_scales_to_zero(spark):
    rows = table(spark, np.array([[1.0, 2.0], [1.0, 4.0]]))
    for kind in ("standard", "minmax", "robust"):
        assert [r["vector"][0] for r in fit_scaler(rows, kind).transform(rows).collect()] == [0.0, 0.0]
    assert isinstance(fit_scaler(rows, "l2"), Scaler)


def test_kernel_size_mismatch_raises(spark):
    from flowprism.functions.kernels import kernel

    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "x array<double>, y array<double>")
    with pytest.raises(Exception, match="number of features"):
        df.select(kernel(F.col("x"), F.col("y"), "linear")).collect()


def test_model_store_round_trip_and_missing_part(spark, tmp_path):
    x = np.random.default_rng(19).normal(size=(30, 2))
    train = table(spark, x, [i % 2 for i in range(30)])
    model = kinn.fit(train, 3)
    path = str(tmp_path / "m")
    encoder = spark.createDataFrame([("a", 0), ("b", 1)], "label string, code int")
    tables.save_model(model, fit_scaler(train, "standard"), encoder, path)
    loaded, _, _ = tables.load_model(spark, path)
    assert loaded.clusters.count() == 30 and loaded.steps == 3
    # A later version is what is loaded; one without its manifest entry is not seen.
    tables.save_model(kinn.fit(train, 4), fit_scaler(train, "standard"), encoder, path)
    assert tables.load_model(spark, path)[0].steps == 4
    kinn.save(kinn.fit(train, 5), f"{path}/half-written/model")
    later, _, _ = tables.load_model(spark, path)
    assert later.steps == 4
    test = table(spark, x + 0.01).select("id", "vector")
    asked = [kinn.predict_supervised(m, test, compat="nearest").orderBy("id").collect() for m in (kinn.fit(train, 4), later)]
    assert asked[0] == asked[1]
    for folder in (tmp_path / "m").iterdir():
        if (folder / "scaler").exists():
            (folder / "scaler").rename(tmp_path / f"scaler-of-{folder.name}")
    with pytest.raises(FileNotFoundError, match="scaler"):
        tables.load_model(spark, path)
    with pytest.raises(FileNotFoundError):
        tables.load_model(spark, str(tmp_path / "nowhere"))


def test_small_samples_are_exact(spark):
    rows = table(spark, np.arange(500)[:, None])
    counts = baselines.small_samples(rows, 20, 16).groupBy("sample").count().collect()
    assert sorted(r["count"] for r in counts) == [16] * 20
    assert len(set(baselines.draw_lines(200))) == 200
    drawn = lambda d: {(r["sample"], r["id"]) for r in baselines.small_samples(d, 20, 16).collect()}
    assert drawn(rows) == drawn(rows.repartition(7))


def test_outliers_are_found_by_every_oneclass_model(spark):
    rng = np.random.default_rng(23)
    train = table(spark, rng.normal(0, 1, (200, 3)))
    far = table(spark, np.vstack([rng.normal(0, 0.3, (20, 3)), rng.normal(30, 1, (10, 3))]))
    for name, model in baselines.ONECLASS.items():
        pred = [r["pred"] for r in model(train, far).orderBy("id").collect()]
        assert sum(pred[20:]) == 10, name
        assert sum(pred[:20]) <= 6, name


def test_every_baseline_tells_clear_classes_apart(spark):
    rng = np.random.default_rng(29)
    middles = np.array([[0.0, 9.0], [9.0, 0.0], [9.0, 9.0]])
    classes = np.arange(90) % 3
    train = table(spark, middles[classes] + rng.normal(0, 0.4, (90, 2)), classes).coalesce(1)
    test = table(spark, middles[classes[:30]] + rng.normal(0, 0.4, (30, 2)), classes[:30]).withColumnRenamed("class", "truth").coalesce(1)
    told = baselines.compare(train, test, scalers=("standard",)).collect()
    assert [(r["scaler"], r["model"]) for r in told] == [("standard", name) for name in baselines.BASELINES]
    assert all(r["acc"] > 90 and r["seconds"] > 0 for r in told), told


def test_registered_comparison_has_every_model_and_scaler(spark, monkeypatch):
    """The models are replaced by one that is quick: what counts is which ones are asked, and on which tables."""
    asked = []

    def first_class(train, test):
        asked.append((train.count(), test.count()))
        return test.select("id", F.lit(0).alias("pred"))

    for name in baselines.BASELINES:
        monkeypatch.setitem(baselines.BASELINES, name, first_class)
    told = entry.queries()["baseline_compare"](spark, SF).collect()
    scalers = ("standard", "minmax", "quantile_normal", "l2")
    assert [(r["scaler"], r["model"]) for r in told] == [(s, m) for s in scalers for m in ("RandomForest", "LGBM", "SVM", "KNN")]
    assert len(asked) == 16 and len(set(asked)) == 1 and sum(asked[0]) == 500


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "truth int, pred int")
    assert metrics.mcc(df).first()["mcc"] == 0.0
    assert metrics.macro_prf(df).first()["ppv_macro"] == pytest.approx(25.0)
    assert metrics.label_accuracy(df, 9).first()["accuracy"] is None


def test_lots_visit_few_blocks_and_move_rows_a_bounded_number_of_times(spark, monkeypatch):
    """Lists from lots equal brute force; inside a cell a task compares a fifth of the pairs at most, and a side has some LOTS lots, however many blocks."""
    from flowprism.operators import neighbours as search

    for name, value in (("LEAST_PIVOTS", 4), ("MAX_PIVOTS", 4), ("BLOCK_ROWS", 16), ("LOTS", 3)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(13)
    x = np.unique((np.repeat(rng.uniform(0, 10, (40, 2)), 50, axis=0) + rng.normal(0, 0.05, (2000, 2))).round(5), axis=0)
    rows = table(spark, x).withColumnRenamed("class", "grp")
    index = search.build_index(rows, "euclidean", block_rows=16)
    assert index.tiles.agg(F.sum("parts")).first()[0] > 100
    lots = search._lots(index.rows, index.tiles, 16).select("lot", "piece").distinct().count()
    assert 3 <= lots <= 10, lots
    d = np.round(block_distances(x, x, "euclidean"), 6) + 0.0
    np.fill_diagonal(d, np.inf)
    compared = []
    distances = search.block_distances
    monkeypatch.setattr(search, "block_distances", lambda a, b, kernel: compared.append(len(a) * len(b)) or distances(a, b, kernel))
    points = index.rows.toPandas()
    plan = {"kernel": "euclidean", "steps": 3, "levels": False, "same": True, "digits": 6}
    points["cut"] = np.sort(d, axis=1)[points["id"].to_numpy(), 2]
    found = search._lists(points, points, plan, index.pivots)
    lists = {i: rows.sort_values(["d", "j"])["j"].tolist()[:3] for i, rows in found.groupby("i")}
    assert lists == {i: [int(j) for j in np.lexsort((np.arange(len(x)), d[i]))[:3]] for i in range(len(x))}
    compared.clear()
    cells = [rows for _, rows in points.groupby("cell")]
    for rows in cells:
        search._lists(rows, rows, plan, index.pivots)
    assert sum(compared) <= 0.2 * sum(len(rows) ** 2 for rows in cells), (sum(compared), [len(rows) for rows in cells])


def test_small_blocks_are_compared_with_many_queries_at_once(spark, monkeypatch):
    """A block of points meets its queries in one product, not in one per block of queries; the lists equal brute force."""
    from flowprism.operators import neighbours as search

    for name, value in (("LEAST_PIVOTS", 8), ("MAX_PIVOTS", 8)):
        monkeypatch.setattr(search, name, value)
    x = np.random.default_rng(37).normal(0, 1, (400, 12)).round(5)
    rows = table(spark, x).withColumnRenamed("class", "grp").coalesce(1)
    index = search.build_index(rows, "rbf", block_rows=8)
    points = index.rows.toPandas()
    d = np.round(block_distances(x, x, "rbf"), 6) + 0.0
    np.fill_diagonal(d, np.inf)
    points["cut"] = np.sort(d, axis=1)[points["id"].to_numpy(), 2]
    blocks = len(points.groupby(["cell", "tile", "sub"]))
    compared, products = [], search._products
    monkeypatch.setattr(search, "_products", lambda a, b: compared.append(len(a)) or products(a, b))
    found = search._lists(points, points, {"kernel": "rbf", "steps": 3, "levels": False, "same": True, "digits": 6}, index.pivots)
    lists = {i: rows.sort_values(["d", "j"])["j"].tolist()[:3] for i, rows in found.groupby("i")}
    assert lists == {i: [int(j) for j in np.lexsort((np.arange(len(x)), d[i]))[:3]] for i in range(len(x))}
    assert blocks > 40 and len(compared) <= blocks, (blocks, len(compared))


def test_units_at_home_share_groups(spark, monkeypatch):
    """Some hundred block pairs are compared in a few calls of the function; the lists equal brute force."""
    from flowprism.operators import neighbours as search

    for name, value in (("LEAST_PIVOTS", 8), ("MAX_PIVOTS", 8)):
        monkeypatch.setattr(search, name, value)
    x = np.random.default_rng(41).normal(0, 1, (600, 6)).round(5)
    rows = table(spark, x).withColumnRenamed("class", "grp").coalesce(1)
    calls, compare = [], search._compare

    def counted(queries, points, units, plan):
        out = compare(queries, points, units, plan)
        exchanged = [line for line in out._jdf.queryExecution().analyzed().toString().split("\n") if "FlatMapCoGroupsInPandas" in line]
        calls.append((units.count(), exchanged))
        return out

    monkeypatch.setattr(search, "_compare", counted)
    got = neighbours(rows, rows, 2, kernel="euclidean", levels=False, digits=6, block_rows=8).collect()
    d = np.round(block_distances(x, x, "euclidean"), 6) + 0.0
    np.fill_diagonal(d, np.inf)
    lists = {}
    for r in sorted(got, key=lambda r: (r["i"], r["pos"])):
        lists.setdefault(r["i"], []).append(r["j"])
    assert lists == {i: [int(j) for j in np.lexsort((np.arange(len(x)), d[i]))[:2]] for i in range(len(x))}
    (units, (exchanged,)), = calls
    # The key comes first.
    assert units > 100 and "lists(some#" in exchanged, (units, exchanged)


def test_short_lists_with_ties_and_undefined_distances():
    """Ties at the last step, many equal distances and NaN: as a full sort gives."""
    from flowprism.operators import neighbours as search

    rng = np.random.default_rng(17)
    far = rng.integers(0, 9, (30, 200)) / 4.0
    far[3, :50] = np.nan
    ids = rng.permutation(200)
    for levels in (True, False):
        row, j, d = search._short_lists(far.copy(), ids, np.full(30, np.inf), {"steps": 4, "levels": levels, "digits": 6})
        for r in range(30):
            order = np.lexsort((ids, far[r]))
            near = far[r][order]
            step = np.cumsum(near != np.concatenate([[0.0], near[:-1]]))
            first = (step < 4) | ((step == 4) & (near != np.concatenate([[0.0], near[:-1]])))
            keep = first if levels else np.arange(200) < 4
            assert j[row == r].tolist() == ids[order][keep].tolist()


@pytest.mark.parametrize("kernel", ["euclidean", "linear", "rbf"])
@pytest.mark.parametrize("levels", [True, False])
def test_queries_meet_the_blocks_they_can_reach(spark, monkeypatch, kernel, levels):
    """Lists equal brute force for each kernel, with weights and copies; a query is compared with few of the points its block meets."""
    from flowprism.operators import neighbours as search

    for name, value in (("LEAST_PIVOTS", 32), ("MAX_PIVOTS", 32)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(29)
    x = (np.repeat(rng.uniform(0, 4, (30, 3)), 40, axis=0) + rng.normal(0, 0.05, (1200, 3))).round(5)
    x[7], x[900] = x[6], x[6]
    weight = 1 + (np.arange(len(x)) % 5) / 10.0
    rows = table(spark, x).withColumnRenamed("class", "grp")
    index = search.build_index(rows, kernel, weight=F.lit(1) + (F.col("id") % 5) / 10.0, block_rows=32)
    points = index.rows.toPandas().sort_values("id", ignore_index=True)
    d = np.round(block_distances(x, x, kernel) * weight[None, :], 6) + 0.0
    np.fill_diagonal(d, 0.0 if levels else np.inf)
    plan = {"kernel": kernel, "steps": 3, "levels": levels, "same": True, "digits": 6}
    row, j, far = search._short_lists(d, np.arange(len(x)), np.full(len(x), np.inf), plan)
    points["cut"] = [2 * far[row == i].max() for i in range(len(x))]
    compared, products = [], search._products
    monkeypatch.setattr(search, "_products", lambda a, b: compared.append(len(a) * len(b)) or products(a, b))
    found = search._lists(points, points, plan, index.pivots)
    for i, mine in found.groupby("i"):
        at = row == i
        assert mine.sort_values(["d", "j"])["j"].tolist() == j[at].tolist()
        assert mine["d"].sort_values().tolist() == pytest.approx(far[at].tolist(), abs=2e-6)
    assert found["i"].nunique() == len(x)
    assert 0 < sum(compared) <= 0.1 * len(x) ** 2, sum(compared)


def test_lots_of_a_small_side_are_as_many_as_of_a_large_one(spark):
    """What a search shuffles is rows times lots, so the number of lots does not grow with the rows."""
    from flowprism.operators import neighbours as search

    def lots(n: int) -> int:
        rows = spark.range(n).select(F.lit(0).alias("grp"), "id", (F.col("id") % 64).cast("int").alias("cell"))
        tiles = rows.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n"))
        return search._lots(rows, tiles, search.BLOCK_ROWS).select("lot", "piece").distinct().count()

    assert search.LOTS <= lots(7_680) <= lots(76_800) <= search.LOTS + 1
