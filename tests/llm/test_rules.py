"""Cutoffs of the quality rules: each language gets one that rejects planted junk, and spares good documents."""

from pyspark.sql import functions as F

from flowprism.llm import quality_rules

STATS = "doc_id bigint, stratum string, " + ", ".join(f"{r} double" for r in quality_rules.RULES)


def test_each_language_rejects_planted_junk(spark):
    words = "The river ran slowly past old houses while children played near a quiet bridge until evening came".split()
    rows, labels = [], []
    for k, lang in enumerate(("en", "de", "fr", None)):
        for i in range(260):
            at, junk = 1000 * k + i, i >= 250
            text = " ".join(f"{words[(i + j) % len(words)]}{i + j}" for j in range(40)) + "".join(f" #{j}$%&" for j in range(20 * junk))
            rows.append((at, text, lang))
            labels.append((at, int(not junk), 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = quality_rules.apply_rules(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = out.withColumn("junk", F.col("doc_id") % 1000 >= 250).groupBy("junk").agg(F.avg(F.col("kept").cast("int"))).collect()
    assert {r[0]: r[1] for r in got} == {True: 0.0, False: 1.0}


def test_combined_rejection_is_bounded(spark):
    # Every rule alone is harmless on 1.2% of the good rows each; together they reject no more than is proven.
    rows = []
    for i in range(3000):
        hit = i % 83
        rows.append((i, "x" if i % 2 else "few", *(0.9 if hit == r else 0.01 for r in range(5))))
    rows = [r for r in rows if r[1] == "x" or r[0] < 120]
    stats = spark.createDataFrame(rows, STATS)
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id bigint, quality int")
    cuts = quality_rules.cutoffs(stats, labels).collect()
    by = {(r["stratum"], r["rule"]): r for r in cuts}
    assert len(by) == 10
    # 60 rows cannot prove 5% for two strata.
    assert all(r["cutoff"] is None and r["n_rejected"] is None for (s, _), r in by.items() if s == "few")
    full = [r for (s, _), r in by.items() if s == "x"]
    assert all(r["cutoff"] is not None for r in full)
    n, lost = full[0]["n_good"], full[0]["n_rejected"]
    assert lost <= quality_rules.most_rejections(n, 0.05, 0.025)
    assert {r["n_rejected"] for r in full} == {lost}
