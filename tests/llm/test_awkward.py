"""Words made to collide, pages made to lose text or time, columns made to clash, targets that contradict."""

import time

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from flowprism.llm import bpe, dom, minmax, mixing, quality_rules, recompression
from flowprism.llm import texts as T

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def thue_morse(n, zero="a", one="b"):
    return [one if bin(i).count("1") % 2 else zero for i in range(n)]


PAIRS = [("".join(thue_morse(n)), "".join(thue_morse(n, "b", "a"))) for n in (1024, 2048)]


@pytest.mark.parametrize("a,b", PAIRS)
def test_words_that_cancel_in_sums(spark, a, b):
    shared = " ".join(f"s{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{shared} {a}"), (2, f"{shared} {b}"), (3, f"{shared}\n{a}\n{b}\n{a}")], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in recompression.remove_repeats(docs).collect()}
    assert [found[i]["n_removed"] for i in (1, 2, 3)] == [0, 0, 20]
    near = minmax.near_duplicates(spark.createDataFrame([(1, f"x {a}"), (2, f"x {b}")], "doc_id bigint, text string"), width=2, percent=80)
    assert near.where("kept").count() == 2
    stats = quality_rules.chunk_stats(next(T.chunks(pa.array([f"{a}\n{b}\n{a}"]))))
    assert stats["n_dup_lines"].tolist() == [1]
    coder = bpe.Coder(bpe.Vocabulary(bpe.read_ranks(RANKS)))
    ranks = bpe.read_ranks(RANKS)
    ids, _, decoded = coder.round_trip(next(T.chunks(pa.array([f"{a} {b}"]))))
    assert decoded == [f"{a} {b}".encode()]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert ids.tolist() == own.encode_ordinary(f"{a} {b}")


@pytest.mark.parametrize("n", [16, 2048])
def test_spans_of_words_that_cancel(n):
    left, right = thue_morse(n), thue_morse(n, "b", "a")
    chunk = next(T.chunks(pa.array([" ".join([*left, *right, *left])])))
    hashes = T.word_hashes(chunk, T.split(chunk))
    spans = T.Spans(hashes)
    import numpy as np

    at = np.array([0, n, 2 * n])
    found = spans(at, at + n)
    assert found[0] == found[2] != found[1]
    assert len({int(spans(np.array([0]), np.array([k]))[0]) for k in range(1, 3 * n, 7)}) == len(range(1, 3 * n, 7))


def told(source):
    return " ".join(t for t in dom.parse(source).text if t)


def test_no_text_is_lost():
    assert told("<form><datalist><option value=a></datalist></form><article><p>Main text here</p></article>") == "Main text here"
    assert told("<p>Formula <math><mi>x</mi></math> after it</p><object>alt text</object>") == "Formula x after it alt text"
    assert told("<select><option>one<option>two</select><p>text <svg><text>in</text></svg> picture") == "one two text in picture"
    assert told("<noscript><p>shown</p></noscript><template>kept</template><iframe>frame</iframe>end") == "shown kept frame end"
    assert told("<script>if (a < b) x('<p>no')</script><style>p{}</style><title>no</title><textarea>no</textarea>yes") == "yes"
    assert told('<p title="a > b">quoted</p><p title="never ends>open</p><p>after</p>') == "quoted open after"
    assert told("1 < 2 and 3 <4 > 2") == "1 < 2 and 3 <4 > 2" and told("a <!-- not this") == "a" and told("") == ""


@pytest.mark.parametrize("source", ["<a " * 350_000, '<a "' * 250_000 + ">", "<a '>' " * 150_000 + '"', "<div>" * 100_000, "<!-- " * 200_000, "<script>" * 100_000])
def test_hostile_pages_take_linear_time(source):
    begin = time.time()
    dom.parse(source)
    assert time.time() - begin < 5


NAMES = ["_doc", "_tag", "_runs", "doc", "tag", "at", "n", "probability", "sampled", "_tokens", "_source", "_lang", "_topic", "_carried", "score", "kept", "ids", "decoded", "symbol"]


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 97}" for j in range(40 + i)), ["en", None, ""][i % 3], "a" if i % 2 else None, 1, *[f"{c}{i}" for c in NAMES]) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in NAMES))


def same(before, after, names=NAMES):
    kept = {r["doc_id"]: r for r in before.collect()}
    rows = after.collect()
    assert rows and all([r[c] for c in names] == [kept[r["doc_id"]][c] for c in names] for r in rows)


def test_columns_named_like_helpers(spark, crowded):
    out = recompression.remove_repeats(crowded)
    assert out.columns == [*crowded.columns, "n_words", "n_removed", "kept_text"]
    same(crowded, out)
    drawn = mixing.draw(crowded)
    assert drawn.columns == crowded.columns
    same(crowded, drawn)
    assert "probability" in mixing.mix(crowded).columns and mixing.mix(crowded).count() == 30


def test_pipeline_stages_keep_columns(spark, crowded):
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, crowded, "/root/testdata/sf0.001")
        assert out.columns == crowded.columns, name
        same(crowded, out)


def test_null_is_apart_from_empty(spark, crowded):
    cells = mixing.mix(crowded).groupBy("_lang").count().collect()
    assert {r["_lang"]: r["count"] for r in cells} == {"en": 10, None: 10, "": 10}


def test_contradictory_targets(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en" if i % 2 else "fr", "a" if i % 2 else "b") for i in range(60)], "doc_id bigint, text string, lang string, source string")
    targets = {"source": mixing.marginals(spark, {"a": 0.5, "b": 0.5}), "lang": mixing.marginals(spark, {"en": 0.9, "fr": 0.1})}
    with pytest.warns(UserWarning, match="contradict"):
        mixing.mix(docs, targets, budget=100)
    with pytest.raises(ValueError, match="contradict"):
        mixing.mix(docs, targets, budget=100, strict=True)
    cells = docs.groupBy("source", "lang").agg(F.sum(mixing.tokens_of(F.col("text"))).alias("tokens"))
    with pytest.warns(UserWarning):
        assert mixing.rake(cells, ("source", "lang"), targets).first()["gap"] > 0.1
