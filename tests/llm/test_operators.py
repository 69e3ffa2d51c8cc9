"""The operators against brute force, and their defined results on awkward input."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowprism.llm import archives, bpe, dom, extraction, fingerprints, minmax, mixing, quality_classifier, quality_rules, recompression, sharding
from flowprism.llm import texts as T

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double"
PASSAGE = " ".join(f"shared{i}" for i in range(30))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def awkward() -> list[tuple]:
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
    texts = [None, "", " \t\n ", "one", "Two Words", PASSAGE, "start " + PASSAGE + " end", PASSAGE + " x " + PASSAGE, long, long + " tail",
             "same same same same " * 30, "a|b é中\U0001f600 it's we're\n\n  x", "!!!! ####", "line\nline\nother\nline"]
    rows = [(i, t, ["en", None, "fr"][i % 3], "src0" if i % 2 else None, 1, 0.5) for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, "no id", "en", "s", 1, 0.5), (6, "another text of id six", "en", "s", 1, 0.5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i not in (10, 12)), 0) for i in range(14)], "doc_id bigint, quality int, toxic int")


def chunk_of(texts: list) -> T.Chunk:
    (chunk,) = T.chunks(pa.array(texts, pa.string()), 1 << 30)
    return chunk


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n'sé中|!1", max_size=40), min_size=1, max_size=6))
def test_words_and_counts(texts):
    chunk = chunk_of(texts)
    words = T.split(chunk)
    data = chunk.data.tobytes()
    found = [data[a:b].decode() for a, b in zip(words.starts, words.ends)]
    assert found == [w for t in texts for w in WORD.findall(t)]
    stats = quality_rules.chunk_stats(chunk)
    for i, text in enumerate(texts):
        w = WORD.findall(text)
        windows = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        times = Counter(windows)
        repeated = {j + k for j, x in enumerate(windows) if times[x] > 1 for k in range(5)}
        seen, duplicates = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                duplicates += line in seen
                seen.add(line)
        assert (stats["n_words"][i], stats["word_chars"][i], stats["n_dup_lines"][i], stats["n_repeat_words"][i]) == (len(w), sum(map(len, w)), duplicates, len(repeated))


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.Vocabulary(bpe.read_ranks(RANKS)))


@settings(max_examples=80, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab's rtvelmd \n\t1é中!\"#\U0001f600  ½"), max_size=80))
def test_bpe_equals_tiktoken(coder, text):
    assert bpe.PATTERN == public_tokenizers.PATTERN
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.vocabulary.ranks, special_tokens={})
    ids, _, decoded = coder.round_trip(chunk_of([text]))
    assert ids.tolist() == enc.encode_ordinary(text) and decoded[0] == text.encode()


def test_bpe_long_words(coder):
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.vocabulary.ranks, special_tokens={})
    for word in ("a" * 5000, "=" * 3001, "abcd" * 700, "thequickbrownfox" * 40):
        assert coder.round_trip(chunk_of([word]))[0].tolist() == enc.encode_ordinary(word)


def test_bpe_table(docs, empty):
    for row in bpe.round_trip(docs, RANKS).select("text", "ids", "decoded", "source").collect():
        assert bytes(row["decoded"]).decode() == (row["text"] or "")
    back = bpe.decode(bpe.encode(docs, RANKS), RANKS)
    assert back.where(F.decode("decoded", "UTF-8") != F.coalesce("text", F.lit(""))).count() == 0
    assert bpe.digests(empty, RANKS).count() == 0


def brute_repeats(rows: list[tuple]) -> dict:
    """Words kept, by row, with rows of equal id and text as one document."""
    crc = lambda t: __import__("zlib").crc32((t or "").encode())
    seen, out = set(), {}
    for row in sorted({(-(2**63) if r[0] is None else r[0], crc(r[1]), r[1] or "") for r in rows}):
        w = WORD.findall(row[2])
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        out[row[0], row[2]] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_repeats(spark, docs, empty):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(40)]
    parts = [" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(15, 60, 30)]
    rows = awkward() + [(100 + i, "\n".join(parts[j] for j in rng.integers(0, 30, 4)), "en", "s", 1, 0.0) for i in range(60)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute_repeats(rows)
    got = recompression.remove_repeats(table).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[-(2**63) if r["doc_id"] is None else r["doc_id"], r["text"] or ""]
    assert recompression.remove_repeats(empty).count() == 0


def test_repeats_in_runs(spark):
    """Runs longer and shorter than a window, cut by its edges; alternating words."""
    rng = np.random.default_rng(5)
    texts = ["a " * 50, "b " + "a " * 19 + "c", "x " + "a " * 19 + "c d", "a b " * 40, "b " + "a b " * 15, "a " * 20]
    texts += [" ".join(w for _ in range(12) for w in [str(rng.choice(list("abc")))] * int(rng.integers(1, 25))) for _ in range(40)]
    rows = list(enumerate(texts))
    want = brute_repeats(rows)
    for r in recompression.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect():
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"], r["text"]]


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_near_duplicates(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(minmax, "BLOCK", 8)
    rng = np.random.default_rng(5)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(25):
            w = list(base)
            for _ in range(int(rng.integers(0, 6))):
                w[int(rng.integers(60))] = f"r{int(rng.integers(10**9))}"
            rows.append((1000 + len(rows), " ".join(w), "en", "s", 1, 0.0))
    rows += [r for r in awkward() if r[0] is None or r[0] != 6]
    got = minmax.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2, 80).collect()
    assert len(got) == len(rows)
    sets = {r[0]: shingles(r[1], 2) for r in rows if r[0] is not None}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (find(r["doc_id"]), len(sets[r["doc_id"]]), find(r["doc_id"]) == r["doc_id"])
    assert minmax.near_duplicates(empty, 2, 80).count() == 0


def test_block_links_sides():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [9], [9])]
    assert minmax.block_links([0, 1, 2, 3], [0, 0, 0, 0], sets, 80) == [(0, 1), (2, 3)]
    assert minmax.block_links([0, 1, 2, 3], [0, 1, 1, 1], sets, 80) == [(0, 1)]


def test_fingerprints(spark, docs, empty):
    rows = fingerprints.fingerprint_documents(docs).collect()
    assert len(rows) == docs.count()
    ordered = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    for i, r in enumerate(ordered):
        text, after = r[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        want[r[0], len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprints.fingerprint_documents(empty).count() == 0
    a, b = " ".join(f"a{i}" for i in range(3000)), " ".join(f"a{i}" for i in range(1000, 4000))
    one = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("x"), fingerprints.sketch(F.col("b")).alias("y"))
    near, inside, size = one.select(fingerprints.resemblance(F.col("x"), F.col("y")), fingerprints.containment(F.col("x"), F.col("y")), fingerprints.distinct_shingles(F.col("x"))).first()
    assert abs(near - 0.5) < 0.15 and abs(inside - 2 / 3) < 0.2 and abs(size / 3000 - 1) < 0.3
    parts = one.select(F.lit(1).alias("k"), F.explode(F.array("x", "y")).alias("sketch"))
    merged = fingerprints.merge_parts(parts, "k").first()["sketch"]
    assert merged == one.select(fingerprints.merge(F.col("x"), F.col("y"))).first()[0]


def test_mixing(spark, docs, empty):
    out = mixing.mix(docs)
    assert out.count() == docs.count() and out.where((F.col("probability") < 0) | (F.col("probability") > 1)).count() == 0
    assert mixing.mix(empty).count() == 0
    cells = spark.createDataFrame([("a", "x", "p", 100), ("a", "y", "p", 50), ("b", "x", "q", 30), ("b", "y", "p", 20)], "_source string, _lang string, _topic string, tokens bigint")
    goals = {"_source": {"a": 0.5, "b": 0.5}, "_lang": {"x": 0.6, "y": 0.4}, "_topic": {"p": 0.7, "q": 0.3}}
    raked = mixing.rake(cells, tuple(goals), {d: mixing.marginals(spark, g) for d, g in goals.items()}).toPandas()
    for d, goal in goals.items():
        shares = raked.groupby(d)["raked"].sum() / raked["raked"].sum()
        assert all(abs(shares[k] - v) < 1e-4 for k, v in goal.items())


def test_shards_part_strings_with_a_common_start(spark, tmp_path):
    """Whole strings are ordered; the written files can be skipped by any dimension."""
    import pyarrow.parquet as pq

    names = [f"https://host/{c}{d}" for c in "abcdefgh" for d in range(10)]
    rows = [(i, names[i * 7 % 80] if i % 50 else None, float(i * 37 % 1000), f"kept{i}", i) for i in range(4000)]
    table = spark.createDataFrame(rows, "id long, site string, size double, _value string, _place0 long")
    out = sharding.shard(table, ["site", "size"], ["id"], 8)
    found = out.collect()
    assert {(r["id"], r["site"], r["size"], r["_value"], r["_place0"]) for r in found} == set(rows)
    assert sorted(Counter(r["shard"] for r in found).values()) == [500] * 8
    sharding.write_shards(out, str(tmp_path / "shards"), rows_per_file=100)
    files = [pq.read_table(f, partitioning=None).to_pandas() for f in (tmp_path / "shards").rglob("*.parquet")]
    assert len(files) == 40 and sum(map(len, files)) == 4000 and all(len(f) == 100 for f in files)
    for column, wanted in (("site", names[41]), ("size", 412.0)):
        read = [f for f in files if f[column].dropna().min() <= wanted <= f[column].dropna().max()]
        assert sum((f[column] == wanted).sum() for f in read) == sum(r[1 if column == "site" else 2] == wanted for r in rows)
        assert len(read) <= 16


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs, shards=5).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert sharding.shard_documents(empty).count() == 0
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        order = np.argsort(sharding.hilbert_index(points, bits))
        assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def test_archives(spark):
    big = "<p>" + "ä\r\n\r\nWARC/1.0\r\n" * 100
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", "small"), (5, "u", "small"), (None, "u", big), (2, None, big), (7, "u", "é" * 499)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    got = archives.round_trip(pages).collect()
    assert len(got) == len(rows)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == Counter({(1, "revisit", 2): 1, (2, "response", None): 2, (3, "response", None): 1, (4, "response", None): 1, (5, "response", None): 1, (None, "revisit", 2): 1, (7, "response", None): 1})
    payloads = {r[0]: (r[2] or "").encode() for r in rows}
    assert all((r["payload_bytes"], r["payload_digest"]) == (len(payloads[r["page_id"]]), hashlib.sha1(payloads[r["page_id"]]).hexdigest()) for r in got)
    assert archives.round_trip(pages.limit(0)).count() == 0
    path = archives.scratch_path(spark, "full")
    archives.write_archives(pages, path)
    full = archives.resolve_revisits(archives.read_archives(spark, path)).collect()
    assert all(bytes(r["payload"]) == payloads[r["page_id"]] for r in full)


def test_quality_classifier(spark, docs, empty, labels):
    out = quality_classifier.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality_classifier.classify(empty, labels).count() == 0
    # With nothing to learn from, nothing is rejected.
    assert quality_classifier.classify(docs, labels.where("quality = 1")).where("predicted = 0").count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = quality_classifier.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    held = out.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", "quality").toPandas()
    assert (held.predicted == held.quality).mean() > 0.95


def test_rules(docs, empty, labels):
    out = quality_rules.apply_rules(docs, labels).collect()
    assert len(out) == docs.count() and all(not (r["base_failed"] and r["kept"]) for r in out)
    assert quality_rules.apply_rules(empty, labels).count() == 0
    # Exact binomial bound, against a plain sum.
    from math import comb

    for n, risk, level in ((50, 0.1, 0.01), (400, 0.05, 0.001), (20, 0.05, 0.01)):
        cdf = [sum(comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) for k in range(n + 1)]
        assert quality_rules.most_rejections(n, risk, level) == sum(c <= level for c in cdf) - 1


PAGE = (
    '<html><head><title>t</title><script>var a="</p><p>no";</script></head><body><nav><a href="#">Menu</a></nav><div class="cookie-notice">We use cookies</div>'
    "<article><h1>A title</h1><p>First &amp; <b>bold</b>\n text of the article, long enough to count.<p>Second &eacute; paragraph, which follows it.</article>"
    '<div id="comments"><p>I do not agree with this at all.</p></div><footer>&copy; nobody</footer>'
)


@pytest.fixture(scope="module")
def trees(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    return extraction.fit(pages, 60)


def test_extraction(spark, trees):
    text = "A title First & bold text of the article, long enough to count. Second é paragraph, which follows it."
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<div><p>unclosed <"), (5, "u", "<div>" * 3000 + "deep"), (1, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("old"))
    got = {(r["page_id"], r["text"]) for r in extraction.extract(pages, trees).collect()}
    assert (1, text) in got and {(2, ""), (3, "")} <= got
    assert extraction.extract(pages.limit(0), trees).count() == 0


def test_decoding_is_consistent(trees):
    page = dom.parse(PAGE)
    label = extraction.decode(page, np.random.default_rng(1).normal(size=len(page.tag)))
    assert all(label[page.parent[i]] or not label[i] for i in range(1, len(label)))


def test_extraction_held_out(spark, trees):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").limit(200).collect()
    right = 0
    for r in rows:
        page = dom.parse(r["html"] or "")
        want = extraction.own_labels(page)
        right += want is None or extraction.main_text(page, want) == extraction.extract_page(r["html"] or "", trees)
    assert right >= 0.97 * len(rows)
