"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token counts are summed into cells (source, language, and topic where documents have one). Raking scales the
cells to each dimension's target shares in turn until every marginal is within ``TOLERANCE`` of its target; a
document is then drawn with the probability that turns its cell's tokens into the raked ones. The draw has a
budget, the expected number of tokens: ``BUDGET`` of the tokens in cells with a target unless one is given, all
of them if it asks for more. No cell gives more than it has. A value whose tokens do not reach its share is kept
whole and the others take up the rest of the budget, so a rare cell changes no other cell's rate by more than its
own tokens. Draws compare an md5-based number of the id with the probability, so they are reproducible.

Cells are few (products of the dimensions' values): up to ``ONE_TASK_CELLS``, counted first, they are raked
in one task, more than that through shuffles by dimension. Only the id, the dimensions and the token count of a document
leave its scan. Null dimension values are a value of their own, apart from the empty text (``NULL`` stands for it in the
cells, null in targets and results); null and empty texts have no tokens and are
kept with their cell's probability (1 in a cell without tokens); targets without tokens are left out and the others
rescaled; an empty table gives no rows. Other columns pass through; ``mix`` replaces columns with the names it adds, and
``draw`` keeps every column whatever its name.

Targets can contradict each other (a value that occurs with one other value only cannot get a share of its own).
Raking then ends after ``ROUNDS * MOST_PASSES`` sweeps with marginals off by ``gap``, a column of ``rake``: a warning
says so, or an error where ``strict`` is set.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowprism.llm.columns import fresh
from flowprism.session import stored

DIMENSIONS = ("source", "lang", "topic")
#: Stands for null among the values of a dimension.
NULL = "\0"
ADDED = ("_tokens", "_source", "_lang", "_topic", "probability", "sampled")
TOLERANCE = 1e-6
ROUNDS = 4
MOST_PASSES = 10
ONE_TASK_CELLS = 100_000
#: Target shares go as the observed shares to this power: below 1, small values gain.
TEMPER = 0.7
#: Expected tokens of a draw as a share of those there are, where no budget is given.
BUDGET = 0.8


def tokens_of(text: Column) -> Column:
    """Words of a text; the weight of a document in a mix."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")


def topic_of(tokens: Column) -> Column:
    """A stand-in for a topic where documents have none: the form, by number of tokens."""
    return F.when(tokens < 100, "note").when(tokens < 1000, "article").otherwise("long form")


def with_dimensions(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """``docs`` with tokens, source, language and topic in columns of the given names."""
    value = lambda column: F.coalesce(column.cast("string"), F.lit(NULL))
    rows = docs.withColumn(names["_tokens"], tokens_of(F.col("text").cast("string")))
    topic = F.col("topic") if "topic" in docs.columns else topic_of(F.col(names["_tokens"]))
    return rows.withColumns({names["_source"]: value(F.col("source")), names["_lang"]: value(F.col("lang")), names["_topic"]: value(topic)})


def tempered(cells: DataFrame, dimension: str, power: float = TEMPER) -> DataFrame:
    """``value, share`` of a dimension: observed token shares to ``power``, summing to 1."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0")
    raised = sums.select("value", F.pow("t", F.lit(power)).alias("p"))
    whole = raised.agg(F.sum("p")).first()[0] or 1.0
    return raised.select("value", (F.col("p") / F.lit(float(whole))).alias("share"))


def goals_within(live: DataFrame, dimension: str, budget: float) -> DataFrame:
    """``dimension, goal``: ``budget`` split by share, no value over its tokens, the rest shared among the others."""
    values = stored(live.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("supply"), F.first(f"_share_{dimension}").alias("share")).where("share > 0"), "goals")
    level = 0.0
    # Values reach their supply one after the other as the level rises: each pass adds those that do.
    while True:
        full = F.col("share") * F.lit(level) >= F.col("supply")
        taken, open_share = values.agg(F.sum(F.when(full, F.col("supply")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("share")))).first()
        rest = max(0.0, budget - (taken or 0.0))
        higher = rest / open_share if open_share else level
        if higher <= level * (1 + 1e-12):
            return values.select(dimension, F.least("supply", F.col("share") * F.lit(level)).alias("goal"))
        level = higher


def rake(cells: DataFrame, dimensions: tuple[str, ...], targets: dict[str, DataFrame], budget: float | None = None, strict: bool = False) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``raked``: tokens whose marginals have the target shares.

    ``gap`` is the largest relative distance of a marginal from its goal when the sweeps ended.

    With a ``budget`` they sum to it and no cell exceeds its tokens; without, they sum to all tokens and cells may.
    """
    live = cells.where(F.col("tokens") > 0)
    for d in dimensions:
        live = live.join(targets[d].where("share > 0").select(F.coalesce("value", F.lit(NULL)).alias(d), F.col("share").alias(f"_share_{d}")), d)
    live = stored(live.withColumn("_weight", F.col("tokens").cast("double")), "cells")
    small = live.count() <= ONE_TASK_CELLS
    total = live.agg(F.sum("tokens")).first()[0]
    if not total:
        return live.select(*dimensions, "tokens", F.col("_weight").alias("raked"), F.lit(0.0).alias("gap"))
    bounded = budget is not None
    budget = min(float(budget), float(total)) if bounded else float(total)
    for d in dimensions:
        if bounded:
            live = live.join(goals_within(live, d, budget).withColumnRenamed("goal", f"_goal_{d}"), d)
        else:
            # Targets that lost all their cells leave their share to the others.
            present = live.groupBy(d).agg(F.first(f"_share_{d}").alias("s")).agg(F.sum("s")).first()[0]
            live = live.withColumn(f"_goal_{d}", F.col(f"_share_{d}") * F.lit(budget / float(present)))
    weight, have = F.col("_weight"), F.col("tokens").cast("double")
    full = (weight >= have) if bounded else F.lit(False)
    given = F.when(full, have).otherwise(weight)
    apart = 0.0
    for _ in range(MOST_PASSES):
        step = live.coalesce(1) if small else live
        for _ in range(ROUNDS):
            for d in dimensions:
                by, goal = Window.partitionBy(d), F.col(f"_goal_{d}")
                whole, part = F.sum(F.when(full, have).otherwise(0.0)).over(by), F.sum(F.when(full, 0.0).otherwise(weight)).over(by)
                # Full cells stay as they are and the others fill up the goal, unless the full ones alone exceed it.
                factor = F.when(whole >= goal, goal / (whole + part)).when(part > 0, (goal - whole) / part).otherwise(1.0)
                step = step.withColumn("_factor", factor).withColumn("_weight", weight * F.col("_factor")).drop("_factor")
        live = stored(step, "raked")
        gap = F.lit(0.0)
        rows = live.coalesce(1) if small else live
        for d in dimensions:
            rows = rows.withColumn(f"_gap_{d}", F.abs(F.sum(given).over(Window.partitionBy(d)) / F.col(f"_goal_{d}") - 1))
            gap = F.greatest(gap, F.col(f"_gap_{d}"))
        apart = rows.agg(F.max(gap)).first()[0] or 0.0
        if apart <= TOLERANCE:
            break
    else:
        told = f"raking ended with a marginal {apart:.2g} of its goal away: the targets contradict each other"
        if strict:
            raise ValueError(told)
        warnings.warn(told, stacklevel=2)
    if bounded:
        live = filled(live, budget)
    return live.select(*dimensions, "tokens", given.alias("raked"), F.lit(apart).alias("gap"))


def filled(live: DataFrame, budget: float) -> DataFrame:
    """Weights times the one factor with which the cells, none over its tokens, sum to ``budget``."""
    factor = 1.0
    for _ in range(200):
        weight, have = F.col("_weight") * F.lit(factor), F.col("tokens").cast("double")
        whole, part = live.agg(F.sum(F.when(weight >= have, have).otherwise(0.0)), F.sum(F.when(weight >= have, 0.0).otherwise(weight))).first()
        if abs(whole + part - budget) <= 1e-9 * budget or not part and whole <= budget:
            break
        factor *= budget / (whole + part) if whole >= budget else (budget - whole) / part
    return live.withColumn("_weight", F.col("_weight") * F.lit(factor))


def uniform(column: Column, seed: str) -> Column:
    """A number in [0, 1) from a value, the same everywhere."""
    digits = F.substring(F.md5(F.concat(F.coalesce(column.cast("string"), F.lit("null")), F.lit(f"|{seed}"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def _drawn(docs: DataFrame, targets: dict[str, DataFrame] | None, seed: str, budget: float | None, strict: bool) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with what ``mix`` adds, and the names of these columns, none of which ``docs`` has."""
    held = dict(zip(ADDED, fresh(docs.columns, *ADDED), strict=True))
    rows = with_dimensions(docs, held)
    dimensions = [d for d in DIMENSIONS if d != "topic" or "topic" in docs.columns or "topic" in (targets or {})]
    names = tuple(held[f"_{d}"] for d in dimensions)
    cells = stored(rows.groupBy(*names).agg(F.sum(held["_tokens"]).alias("tokens")), "cells")
    goals = {held[f"_{d}"]: (targets or {}).get(d) for d in dimensions}
    goals = {d: tempered(cells, d) if goal is None else goal for d, goal in goals.items()}
    if budget is None:
        wanted = cells
        for d, goal in goals.items():
            wanted = wanted.join(goal.where("share > 0"), F.col(d) == F.coalesce("value", F.lit(NULL)), "left_semi")
        budget = BUDGET * float(wanted.agg(F.sum("tokens")).first()[0] or 0)
    raked = stored(rake(cells, names, goals, budget, strict).withColumn("ratio", F.col("raked") / F.col("tokens")), "raked")
    rates = cells.join(raked.select(*names, "ratio"), list(names), "left").select(
        *names, F.when(F.col("tokens") == 0, 1.0).otherwise(F.coalesce(F.round(F.col("ratio"), 9), F.lit(0.0))).alias(held["probability"])
    )
    small = raked.limit(ONE_TASK_CELLS + 1).count() <= ONE_TASK_CELLS
    joined = rows.join(F.broadcast(rates) if small else rates, list(names))
    return joined.withColumn(held["sampled"], uniform(F.col("doc_id"), seed) < F.col(held["probability"])), held


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, seed: str = "mix", budget: float | None = None, strict: bool = False) -> DataFrame:
    """Every document with its tokens, source, language and topic, ``probability`` and ``sampled``; targets default to tempered shares.

    ``budget`` is the expected number of tokens drawn. The form in ``_topic`` is raked only where a ``topic``
    column or a target for it is given; a target that is None stands for the tempered shares.
    """
    out, held = _drawn(docs, targets, seed, budget, strict)
    added = [F.nullif(F.col(held[c]), F.lit(NULL)) if c in ("_source", "_lang", "_topic") else F.col(held[c]) for c in ADDED]
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    return out.select(*[F.col(f"`{c}`") for c in kept], *[column.alias(c) for c, column in zip(ADDED, added, strict=True)])


def draw(docs: DataFrame, targets: dict[str, DataFrame] | None = None, seed: str = "mix", budget: float | None = None, strict: bool = False) -> DataFrame:
    """The documents drawn, with their columns as they are."""
    out, held = _drawn(docs, targets, seed, budget, strict)
    return out.where(F.col(held["sampled"])).select(*[F.col(f"`{c}`") for c in docs.columns])


def marginals(spark: SparkSession, shares: dict[str, float]) -> DataFrame:
    """A target table from a mapping."""
    total = sum(shares.values())
    return spark.createDataFrame([(k, v / total) for k, v in shares.items()], "value string, share double")
