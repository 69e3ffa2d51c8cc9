"""The Kneser-Ney model against a dictionary of counts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowprism.llm import kneser_ney as K
from flowprism.llm import texts as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(texts, train, order):
    tokens = [[*WORD.findall((t or "").translate(LOWER)), None] for t in texts]
    single = Counter(w for t, k in zip(tokens, train) if k for w in t)
    whole, words = sum(single.values()), len(single)
    count = {n: Counter() for n in range(1, order + 1)}
    for t, k in zip(tokens, train):
        line = ["<begin>", *t]
        for i in range(1, len(line) if k else 0):
            for n in range(2, min(order, i + 1) + 1):
                if n == order or i - n + 1 == 0:
                    count[n][tuple(line[i - n + 1 : i + 1])] += 1
    for n in range(order - 1, 0, -1):
        for gram in count[n + 1]:
            if n == 1 or gram[1] != "<begin>":
                count[n][gram[1:]] += 1
    cut, seen = {}, {n: defaultdict(lambda: [0, 0, 0, 0]) for n in count}
    for n, grams in count.items():
        times = Counter(grams.values())
        cut[n] = (0.0, *K.discounts([times[k] for k in (1, 2, 3, 4)]))
        for gram, c in grams.items():
            seen[n][gram[:-1]][0] += c
            seen[n][gram[:-1]][min(c, 3)] += 1

    def share(line, i, n):
        if not n:
            return 1 / (words + 1)
        gram, lower = tuple(line[i - n + 1 : i + 1]), share(line, i, n - 1)
        if gram[:-1] not in seen[n]:
            return lower
        total, *kinds = seen[n][gram[:-1]]
        c = count[n].get(gram, 0)
        return max(c - cut[n][min(c, 3)], 0) / total + sum(a * b for a, b in zip(cut[n][1:], kinds)) / total * lower

    for t in tokens:
        line = ["<begin>", *t]
        yield (
            len(t), sum(w in single for w in t), whole, sum(math.log10((single[w] + 1) / (whole + words + 1)) for w in t),
            sum(math.log10(share(line, i, min(order, i + 1))) for i in range(1, len(line))),
        )


def texts():
    hot = "the the cat of the the dog the " * 40
    made = [f"{'A' if i % 2 else 'a'} w{i % 17} w{i % 5} the w{i % 3} of w{i * i % 23} end" for i in range(60)]
    long = " ".join(f"x{i * i % 601}" for i in range(20_000))
    return [*made, hot, hot, None, "", " \t\n", "only", "É été É", long, "w1 \x00 w1\x00 w1", *made[:9]]


@pytest.mark.parametrize("order,rows", [(2, 1 << 21), (3, 64), (4, 500)])
def test_scores(spark, order, rows):
    given = texts()
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(given)], "doc_id bigint, text string, score string").repartition(5)
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(given))]
    got = {r["doc_id"]: r for r in K.score_documents(docs, order=order, rows=rows).collect()}
    assert len(got) == len(given)
    for i, (n, known, whole, base, score) in enumerate(brute(given, train, order)):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not train[i], n, known, whole)
        assert r["base_score"] == pytest.approx(base, rel=1e-12) and r["score"] == pytest.approx(score, rel=1e-12)


def test_probabilities_sum_to_one(spark):
    given = [t for t in texts()[:40]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "doc_id bigint, text string")
    model = K.fit(docs, F.lit(True), order=3, rows=32)
    words = sorted({w for t in given for w in WORD.findall(t.translate(LOWER))})
    layout, found = model.layout, model.discounts
    # Every word, the end and an unknown word after the same two words.
    for start in ("a", "w1 the", "nothing known"):
        total = 0.0
        for word in [*words, None, "never-seen"]:
            text = start if word is None else f"{start} {word}"
            tokens = K.tokens_of(next(T.chunks(pa.array([text]))), layout)
            total += K.probabilities(model, tokens)[len(start.split())]
        assert total == pytest.approx(1.0) and set(found) == {1, 2, 3}


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, n_known int")
    assert K.score_documents(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = K.score_documents(spark.createDataFrame([(held, "a b"), (None, None)], "doc_id bigint, text string").where("doc_id is not null")).first()
    assert (row["train_tokens"], row["n_known"], row["n_tokens"], row["base_score"], row["score"]) == (0, 0, 3, 0.0, 0.0)
    clash = spark.createDataFrame([(1, "a", "x", "y")], "doc_id bigint, text string, n_known string, _text string")
    out = K.score(clash, K.fit(clash, F.lit(True)))
    assert out.columns == ["doc_id", "text", "_text", "n_tokens", "n_known", "base_score", "score"] and out.first()["_text"] == "y"
