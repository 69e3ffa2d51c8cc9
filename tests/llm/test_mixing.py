"""The draw of a mix: its budget, and what rare cells may change."""

from pyspark.sql import functions as F

from flowprism.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string"


def corpus(spark, extra=()):
    rows = []
    for source, lang, n in (("a", "en", 400), ("a", "fr", 40), ("b", "en", 120), ("b", "fr", 90), ("c", "en", 5)):
        rows += [(len(rows) + i, "w " * (30 + 97 * (i % 13)), lang, source) for i in range(n)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def expected(out):
    return out.agg(F.sum(F.col("_tokens") * F.col("probability")) / F.sum("_tokens")).first()[0]


def test_rare_cell_leaves_the_rest(spark):
    before = mixing.mix(corpus(spark))
    after = mixing.mix(corpus(spark, [(100_000, "w " * 50, "xx", "new")]))
    assert abs(expected(before) - mixing.BUDGET) < 1e-6 and abs(expected(after) - mixing.BUDGET) < 1e-6
    # What is kept whole is the new cell alone; the other rates hardly move.
    rates = [{(r["source"], r["lang"]): r["probability"] for r in o.select("source", "lang", "probability").distinct().collect()} for o in (before, after)]
    assert rates[1].pop(("new", "xx")) == 1.0
    assert rates[0].keys() == rates[1].keys() and all(abs(rates[0][k] - rates[1][k]) < 0.01 for k in rates[0])
    # Length alone changes no rate: documents without a topic have no such cell.
    assert len(rates[0]) == before.select("source", "lang", "probability").distinct().count() == 5


def test_budget_and_targets(spark):
    docs = corpus(spark)
    total = docs.select(F.sum(mixing.tokens_of(F.col("text")))).first()[0]
    targets = {"source": mixing.marginals(spark, {"a": 0.5, "b": 0.45, "c": 0.05}), "lang": mixing.marginals(spark, {"en": 0.6, "fr": 0.4})}
    out = mixing.mix(docs, targets, budget=0.3 * total).withColumn("kept", F.col("_tokens") * F.col("probability")).cache()
    assert abs(expected(out) - 0.3) < 1e-6
    kept = {d: {r[0]: r[1] / (0.3 * total) for r in out.groupBy(d).agg(F.sum("kept")).collect()} for d in ("source", "lang")}
    own = out.where("source = 'c'").agg(F.sum("_tokens")).first()[0] / (0.3 * total)
    assert own < 0.05 and abs(kept["source"]["c"] - own) < 1e-5  # all it has
    assert abs(kept["source"]["a"] / kept["source"]["b"] - 0.5 / 0.45) < 1e-4
    assert abs(kept["lang"]["fr"] - 0.4) < 1e-5
    assert expected(mixing.mix(docs, targets, budget=10 * total)) == 1.0


def test_query_rakes_three_marginals(spark):
    """The registered query draws source, language and topic towards their targets, not the first two alone."""
    from flowprism.llm import queries

    out = queries.queries()["op7_mixing"](spark, "/root/testdata/sf0.001").toPandas()
    assert abs((out["n_tokens"] * out["probability"]).sum() / out["n_tokens"].sum() - mixing.BUDGET) < 1e-6
    # Rates differ by topic inside a cell of source and language, so the topic is a dimension of the raking.
    some = out[out["n_tokens"] > 0].groupby(["source", "lang", "topic"], dropna=False)["probability"].nunique()
    assert (some == 1).all()
    assert out[out["n_tokens"] > 0].groupby(["source", "lang"], dropna=False)["probability"].nunique().max() > 1
    share = {t: rows["n_tokens"].sum() for t, rows in out.groupby("topic")}
    target = {t: n**mixing.TEMPER for t, n in share.items()}
    drawn = {t: (rows["n_tokens"] * rows["probability"]).sum() for t, rows in out.groupby("topic")}
    whole = sum(drawn.values())
    wrong = {t: abs(drawn[t] / whole - target[t] / sum(target.values())) for t in drawn}
    flat = {t: abs(share[t] / sum(share.values()) - target[t] / sum(target.values())) for t in drawn}
    assert sum(wrong.values()) < 0.5 * sum(flat.values()), (drawn, share, target)
