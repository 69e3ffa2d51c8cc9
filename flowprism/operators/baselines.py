"""Baseline classifiers and one-class detectors."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowprism.operators import metrics
from flowprism.operators.lof import TINY, local_density, outlier_factor
from flowprism.operators.neighbours import neighbours
from flowprism.operators.numbering import exact_quantiles
from flowprism.operators.scaling import fit_scaler
from flowprism.session import durable

SEED = 42
CONTAMINATION = 0.1
PRIME = (1 << 31) - 1
# Models of a comparison that are fitted at once.
TOGETHER = 4


def _features(rows: DataFrame, label: str) -> DataFrame:
    return rows.select("id", F.col(label).cast("double").alias("label"), array_to_vector("vector").alias("features"))


def _fit_predict(estimator, train: DataFrame, test: DataFrame) -> DataFrame:
    rows = _features(train, "class").persist()
    model = estimator.fit(rows)
    rows.unpersist()
    out = model.transform(_features(test.withColumn("label", F.lit(0)), "label"))
    return out.select("id", F.col("prediction").cast("int").alias("pred"))


def random_forest(train: DataFrame, test: DataFrame) -> DataFrame:
    """5 trees of depth 5, at least 2 rows per leaf."""
    return _fit_predict(
        RandomForestClassifier(numTrees=5, maxDepth=5, minInstancesPerNode=2, seed=SEED), train, test
    )


def gradient_boosting(train: DataFrame, test: DataFrame) -> DataFrame:
    """20 boosted trees of depth 5 per class, rate 0.03."""
    trees = GBTClassifier(maxIter=20, maxDepth=5, stepSize=0.03, subsamplingRate=0.8, seed=SEED)
    return _fit_predict(OneVsRest(classifier=trees, parallelism=4), train, test)


def linear_svm(train: DataFrame, test: DataFrame, c: float = 0.2) -> DataFrame:
    """Linear support vectors with penalty ``c`` (regularisation 1 / (c * rows))."""
    weight = 1.0 / (c * train.count())
    return _fit_predict(OneVsRest(classifier=LinearSVC(regParam=weight, maxIter=100, tol=1e-3), parallelism=4), train, test)


def knn_vote(train: DataFrame, test: DataFrame, k: int = 5, kernel: str = "euclidean", **options) -> DataFrame:
    """Majority class of the k nearest training rows (ties: smallest class)."""
    one = F.lit(0).alias("grp")
    lists = neighbours(
        test.select(one, "id", "vector"), train.select(one, "id", "vector"), k, kernel=kernel, levels=False, same=False, **options
    )
    votes = lists.join(train.select(F.col("id").alias("j"), "class"), "j").groupBy("i", "class").agg(
        F.count(F.lit(1)).alias("n")
    )
    # smallest class wins a tie: order by votes, then by the negated class
    return votes.groupBy(F.col("i").alias("id")).agg(
        F.max_by("class", F.struct("n", (-F.col("class")).alias("c"))).alias("pred")
    )


BASELINES = {"RandomForest": random_forest, "LGBM": gradient_boosting, "SVM": linear_svm, "KNN": knn_vote}


def compare(
    train: DataFrame,
    test: DataFrame,
    scalers: Sequence[str] = ("standard", "minmax", "quantile_normal", "l2"),
    models: Sequence[str] = tuple(BASELINES),
    together: int = TOGETHER,
) -> DataFrame:
    """Models x scalers: one row of measures and the run time for each.

    Boosted trees and support vectors are many small jobs, so ``together`` fits run at once.
    """
    tables = {}
    for kind in scalers:
        scale = fit_scaler(train, kind)
        tables[kind] = durable(scale.transform(train)), durable(scale.transform(test))

    def judge(kind: str, name: str) -> DataFrame:
        fit_rows, rows = tables[kind]
        begin = time.time()
        judged = BASELINES[name](fit_rows, rows).join(rows.select("id", "truth"), "id")
        result = durable(metrics.evaluate(judged))
        return result.select(F.lit(kind).alias("scaler"), F.lit(name).alias("model"), "*", F.lit(time.time() - begin).alias("seconds"))

    # The models that take longest begin first.
    order = sorted(models, key=lambda name: name not in ("LGBM", "SVM"))
    with ThreadPoolExecutor(together) as pool:
        wrap = inheritable_thread_target(train.sparkSession)
        runs = {(kind, name): pool.submit(copy_context().run, wrap(judge), kind, name) for name in order for kind in scalers}
        return reduce(DataFrame.unionByName, [runs[kind, name].result() for kind in scalers for name in models])


# ---- one-class detectors: scores of train and test rows, higher is more anomalous ------


def flag(train_scores: DataFrame, test_scores: DataFrame, share: float = CONTAMINATION) -> DataFrame:
    """1 where a test score exceeds the (1 - share) percentile of the train scores."""
    values = train_scores.select(F.lit(0).alias("key"), F.col("score").alias("value"))
    # one number
    cut = exact_quantiles(values, [1 - share]).first()["quantile"]
    return test_scores.select("id", (F.col("score") > F.lit(cut)).cast("int").alias("pred"))


def draw_lines(samples: int, seed: int = SEED) -> list[tuple[int, int]]:
    """Factor and shift of each sample's key, both below ``PRIME``, the factor not 0."""
    digit = lambda kind, i: int(hashlib.md5(f"{seed}:{kind}:{i}".encode()).hexdigest()[:8], 16)
    return [(1 + digit("factor", i) % (PRIME - 1), digit("shift", i) % PRIME) for i in range(samples)]


def small_samples(rows: DataFrame, samples: int, size: int, seed: int = SEED) -> DataFrame:
    """``sample, id, vector``: exactly min(size, rows) rows drawn for each sample.

    A row enters a sample when its key for that sample is small: the md5 of its id, moved by the sample's line
    modulo a prime, so SQL can repeat the draw. The candidates are a small multiple of what is needed, and only they
    are ranked.
    """
    total = rows.count()
    limit = PRIME if total <= 4 * size else int(PRIME * (4.0 * size + 64) / total)
    place = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("bigint") % F.lit(PRIME)
    lines = F.lit([f"{a}:{b}" for a, b in draw_lines(samples, seed)])
    part = lambda line, i: F.element_at(F.split(line, ":"), i).cast("bigint")
    # A one-element transform names the row's place once for all samples.
    drawn = F.flatten(
        F.transform(
            F.array(place),
            lambda h: F.transform(lines, lambda line, s: F.struct(s.cast("int").alias("sample"), ((h * part(line, 1) + part(line, 2)) % F.lit(PRIME)).alias("key"))),
        )
    )
    candidates = rows.select("id", "vector", F.explode(F.filter(drawn, lambda d: d["key"] < limit)).alias("d"))
    order = Window.partitionBy("sample").orderBy("key", "id")
    return (
        candidates.select(F.col("d.sample").alias("sample"), F.col("d.key").alias("key"), "id", "vector")
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= size)
        .select("sample", "id", "vector")
    )


def _average_path(n):
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649015329) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def isolation_trees(rows: DataFrame, trees: int = 100, size: int = 256, seed: int = SEED) -> list[pd.DataFrame]:
    """Random trees grown on small samples, one sample per task; flat node tables."""

    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(sample["vector"].to_numpy())
        rng = np.random.default_rng(seed + int(sample["sample"].iloc[0]))
        depth_limit = int(np.ceil(np.log2(max(len(x), 2))))
        nodes: list[list[float]] = []

        def split(members: np.ndarray, depth: int) -> int:
            here = len(nodes)
            nodes.append([-1, 0.0, -1, -1, depth + float(_average_path(len(members)))])
            spread = np.ptp(x[members], axis=0) if len(members) > 1 else np.zeros(x.shape[1])
            varied = np.flatnonzero(spread > 0)
            if depth < depth_limit and len(varied):
                column = int(rng.choice(varied))
                values = x[members, column]
                cut = rng.uniform(values.min(), values.max())
                left = split(members[values <= cut], depth + 1)
                right = split(members[values > cut], depth + 1)
                nodes[here] = [column, cut, left, right, 0.0]
            return here

        split(np.arange(len(x)), 0)
        flat = pd.DataFrame(nodes, columns=["column", "cut", "left", "right", "path"])
        return flat.assign(tree=int(sample["sample"].iloc[0]), node=range(len(flat)))

    schema = "column double, cut double, left double, right double, path double, tree int, node int"
    grown = small_samples(rows, trees, size, seed).groupBy("sample").applyInPandas(grow, schema)
    # The model: at most trees x 2 * size nodes.
    table = grown.toPandas()
    return [t.sort_values("node") for _, t in table.groupby("tree")]


def isolation_scores(rows: DataFrame, trees: list[pd.DataFrame], size: int = 256) -> DataFrame:
    flat = [{c: t[c].to_numpy() for c in ("column", "cut", "left", "right", "path")} for t in trees]
    scale = float(_average_path(size))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.vstack(batch["vector"].to_numpy())
            paths = np.zeros(len(x))
            for tree in flat:
                at = np.zeros(len(x), dtype=int)
                column = tree["column"].astype(int)
                while True:
                    inner = np.flatnonzero(column[at] >= 0)
                    if not len(inner):
                        break
                    here = at[inner]
                    goes_left = x[inner, column[here]] <= tree["cut"][here]
                    at[inner] = np.where(goes_left, tree["left"][here], tree["right"][here]).astype(int)
                paths += tree["path"][at]
            yield pd.DataFrame({"id": batch["id"], "score": 2.0 ** (-(paths / len(flat)) / scale)})

    return rows.select("id", "vector").mapInPandas(score, "id bigint, score double")


def oneclass_iforest(train: DataFrame, test: DataFrame, trees: int = 100, size: int = 256) -> DataFrame:
    size = min(size, train.count())
    forest = isolation_trees(train, trees, size)
    return flag(isolation_scores(train, forest, size), isolation_scores(test, forest, size))


def _single(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(0).alias("grp"), "id", "vector")


def oneclass_lof(train: DataFrame, test: DataFrame, k: int = 20, **options) -> DataFrame:
    """LOF fitted on train; test rows compare their density with that of their neighbours."""
    rows, queries = _single(train), _single(test)
    own = durable(neighbours(rows, rows, k, kernel="euclidean", levels=False, same=True, **options))
    reach = durable(own.groupBy("i").agg(F.max("d").alias("k_distance")))
    density = durable(local_density(own, reach, TINY))
    lists = durable(neighbours(queries, rows, k, kernel="euclidean", levels=False, same=False, **options))
    test_density = local_density(lists, reach, TINY)
    train_scores = outlier_factor(own, density).select(F.col("i").alias("id"), F.col("lof").alias("score"))
    test_scores = outlier_factor(lists, test_density, density).select(F.col("i").alias("id"), F.col("lof").alias("score"))
    return flag(train_scores, test_scores)


def angle_scores(queries: DataFrame, points: DataFrame, k: int, same: bool, **options) -> DataFrame:
    """Negated variance of the distance-weighted angles between neighbour pairs.

    Each row meets only its k neighbours, so the pairs per row are bounded.
    """
    lists = neighbours(_single(queries), _single(points), k, kernel="euclidean", levels=False, same=same, **options)
    near = lists.join(points.select(F.col("id").alias("j"), F.col("vector").alias("v")), "j")
    grouped = near.groupBy("i").agg(F.collect_list("v").alias("around"))
    whole = queries.select("id", "vector").join(grouped.withColumnRenamed("i", "id"), "id")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = []
            for centre, around in zip(batch["vector"], batch["around"], strict=True):
                lines = np.vstack(around) - np.asarray(centre)
                square = np.einsum("ij,ij->i", lines, lines)
                lines, square = lines[square > 0], square[square > 0]
                a, b = np.triu_indices(len(lines), 1)
                angles = (lines @ lines.T)[a, b] / (square[a] * square[b])
                values.append(-float(np.var(angles)) if len(angles) else 0.0)
            yield pd.DataFrame({"id": batch["id"], "score": values})

    return whole.mapInPandas(score, "id bigint, score double")


def oneclass_abod(train: DataFrame, test: DataFrame, k: int = 5, **options) -> DataFrame:
    train_scores = durable(angle_scores(train, train, k, True, **options))
    return flag(train_scores, angle_scores(test, train, k, False, **options))


def isolation_spheres(rows: DataFrame, samples: int = 200, size: int = 8, seed: int = SEED) -> list[tuple]:
    """Per sample: centres, squared radii to the nearest other centre, and isolation ratios."""
    # samples x size vectors reach the driver
    drawn = small_samples(rows, samples, size, seed).toPandas()
    spheres = []
    for _, sample in drawn.sort_values(["sample", "id"]).groupby("sample"):
        centre = np.vstack(sample["vector"].to_numpy())
        gaps = ((centre[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2)
        np.fill_diagonal(gaps, np.inf)
        nearest = gaps.argmin(axis=1)
        radius = gaps[np.arange(len(centre)), nearest]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 1 - radius[nearest] / radius
        spheres.append((centre, radius, np.nan_to_num(ratio, nan=0.0, neginf=0.0)))
    return spheres


def sphere_scores(rows: DataFrame, spheres: list[tuple]) -> DataFrame:
    """Mean isolation: the ratio of the smallest covering sphere's centre, 1 outside all."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.vstack(batch["vector"].to_numpy())
            total = np.zeros(len(x))
            for centre, radius, ratio in spheres:
                far = ((x[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2)
                size = np.where(far <= radius[None, :], radius[None, :], np.inf)
                best = size.argmin(axis=1)
                covered = np.isfinite(size[np.arange(len(x)), best])
                total += np.where(covered, ratio[best], 1.0)
            yield pd.DataFrame({"id": batch["id"], "score": total / len(spheres)})

    return rows.select("id", "vector").mapInPandas(score, "id bigint, score double")


def oneclass_inne(train: DataFrame, test: DataFrame, samples: int = 200, size: int = 8) -> DataFrame:
    spheres = isolation_spheres(train, samples, size)
    return flag(sphere_scores(train, spheres), sphere_scores(test, spheres))


ONECLASS = {"IForest": oneclass_iforest, "LOF": oneclass_lof, "ABOD": oneclass_abod, "INNE": oneclass_inne}


def oneclass_compare(train: DataFrame, test: DataFrame, models: Sequence[str] = tuple(ONECLASS)) -> DataFrame:
    """One row of measures per one-class model; ``test`` has truth 0 (normal) or 1."""
    out = None
    for name in models:
        judged = ONECLASS[name](train, test).join(test.select("id", "truth"), "id")
        result = metrics.evaluate(judged).select(F.lit(name).alias("model"), "*")
        out = result if out is None else out.unionByName(result)
    return out
