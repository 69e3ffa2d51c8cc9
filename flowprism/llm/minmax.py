"""Near-duplicate documents by min-max hashing, with links confirmed on full sets.

A document's set holds its distinct word shingles, lower-cased (ASCII). Each of ``PERMUTATIONS`` hash
functions gives both the minimum and the maximum over the set, so half as many evaluations fill a signature;
three functions make a band of six values, and documents equal in a band become candidates. Documents with
equal sets are one class and travel as one representative, and buckets with the same members are one bucket.

1. In every bucket the members are compared with a leader, the one that meets most others over all its
   buckets, not with each other. Components of these links close most buckets.
2. A bucket that still holds several components is compared whole, in blocks of about ``BLOCK`` members: a
   task gets the texts of two blocks, counts all intersections at once and returns only links that join
   components. So every pair of different components that shares a bucket is compared on full sets.

For leaders, candidates of sizes that cannot reach the threshold are dropped exactly, and those whose
signatures agree in under ``FLOOR`` of their positions (eight standard deviations below the threshold) are
not confirmed; should such a pair be a link, step 2 still finds it. A pair at the threshold shares no band with probability
(1 - 0.8^6)^42, about 3e-6, for long texts. Minimum and maximum of short ones are not independent: with 4 of 5 shingles
shared it is (1 - 0.6^3)^42, about 3.6e-5, and such a pair may never be compared.

Null or wordless texts have the empty set and are linked with nothing. Rows with a null id are kept
unlinked. A repeated id counts as one document with the rows' sets each in its class; all its rows stay.
An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from flowprism.llm import texts as T
from flowprism.operators.components import connected_components
from flowprism.session import stored

PERMUTATIONS = 126
BANDS = 42
FLOOR = 0.6
BLOCK = 768
COLUMNS = 4096

_RNG = np.random.Generator(np.random.PCG64(11))
_A = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * T.U(2) + T.U(1)
_B = _RNG.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)
SKETCH_SCHEMA = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, signature binary"


def shingle_sets(chunk: T.Chunk, width: int) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its shingles."""
    words = T.split(chunk)
    hashes = T.word_hashes(chunk, words, T.LOWER[chunk.data])
    spans = T.Spans(hashes)
    starts = T.inside(words, width)
    grams = spans(starts, starts + width)
    first = np.searchsorted(starts, words.first)
    out = []
    for i, n in enumerate(words.counts.tolist()):
        if n >= width:
            out.append(np.unique(grams[first[i] : first[i + 1]]))
        elif n:
            out.append(spans(words.first[i : i + 1], words.first[i + 1 : i + 2]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of a non-empty set under each hash function."""
    low = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for a in range(0, len(hashes), 4096):
        table = hashes[a : a + 4096] * _A[:, None] + _B[:, None]
        low, high = np.minimum(low, table.min(axis=1)), np.maximum(high, table.max(axis=1))
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Documents x functions to documents x bands."""
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(low), BANDS))
    step = PERMUTATIONS // BANDS
    for i in range(step):
        key = T.mix(T.mix(key + low[:, i::step]) + high[:, i::step])
    return key


def _sketch_batches(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column(1)):
                sets = shingle_sets(chunk, width)
                full = [s for s in sets if len(s)]
                pairs = [signature(s) for s in full]
                low = np.array([p[0] for p in pairs], np.uint64).reshape(-1, PERMUTATIONS)
                high = np.array([p[1] for p in pairs], np.uint64).reshape(-1, PERMUTATIONS)
                keys = iter(band_keys(low, high).view(np.int64))
                # A byte of each value is enough to estimate how alike two signatures are.
                marks = iter(np.concatenate([T.mix(low) & T.U(255), T.mix(high) & T.U(255)], axis=1).astype(np.uint8))
                n = np.array([len(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.at, chunk.n),
                        pa.array(n, pa.int64()),
                        T.signed(np.array([T.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)),
                        T.signed(np.array([T.mix(s * T.U(3)).sum(dtype=np.uint64) for s in sets], np.uint64)),
                        pa.array([next(keys) if k else [] for k in n], pa.list_(pa.int64())),
                        pa.array([next(marks).tobytes() if k else b"" for k in n], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "signature"],
                )

    return run


@F.pandas_udf(DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal positions of two signatures."""
    x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
    return pd.Series((x == y).mean(axis=1) if x.size else np.zeros(len(a)))


def _confirm_batches(width: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            a_ids, b_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sets = [s for chunk in T.chunks(batch.column(3), T.CHUNK_BYTES) for s in shingle_sets(chunk, width)]
            linked = []
            for i, a in enumerate(a_ids):
                if a != last:  # rows come sorted by the leader
                    last, kept = a, next(s for chunk in T.chunks(batch.column(2).slice(i, 1)) for s in shingle_sets(chunk, width))
                shared = len(np.intersect1d(kept, sets[i], assume_unique=True))
                linked.append(100 * shared >= percent * (len(kept) + len(sets[i]) - shared))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(a_ids, pa.int64()), pa.array(b_ids, pa.int64())], names=["a", "b"]).filter(keep)

    return run


def block_links(roots: list[int], sides: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Index pairs that link different components, enough to join all that the rows' links join.

    Rows of two different sides are compared with each other; with one side only, all with all.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    common = times[column] > 1
    row, column = row[common], (np.cumsum(times > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, n), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [low, low + COLUMNS])
        table = np.zeros((n, COLUMNS), np.float32)
        table[row[i:j], column[i:j] - low] = 1
        shared += table @ table.T
    shared = shared.astype(np.int64)
    root, side = np.array(roots), np.array(sides)
    linked = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
    linked &= root[:, None] != root[None, :]
    if len(set(sides)) > 1:
        linked &= side[:, None] != side[None, :]
    above = {r: r for r in roots}

    def top(r: int) -> int:
        while above[r] != r:
            above[r] = above[above[r]]
            r = above[r]
        return r

    out = []
    for i, j in np.argwhere(np.triu(linked, 1)).tolist():
        a, b = top(roots[i]), top(roots[j])
        if a != b:
            above[a] = b
            out.append((i, j))
    return out


def _block_batches(width: int, percent: int):
    """Rows come sorted by block pair: key, p, q, side, class_id, root, text."""

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        if len({r[5] for r in rows}) > 1:
            sets = [s for chunk in T.chunks(pa.array([r[6] for r in rows], pa.large_string())) for s in shingle_sets(chunk, width)]
            for i, j in block_links([r[5] for r in rows], [r[3] for r in rows], sets, percent):
                yield rows[i][4], rows[j][4]

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            found = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if values[:3] != group:
                    found += links(rows)
                    group, rows = values[:3], []
                rows.append(values)
            yield batch_of(found)
        yield batch_of(list(links(rows)))

    return run


class NearDuplicates:
    """The state of one search: sketches, classes, buckets and texts, stored in the shared folder."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.width, self.percent = width, percent
        docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.sketches = stored(docs.mapInArrow(_sketch_batches(width), SKETCH_SCHEMA), "sketches")
        sets = self.sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        self.set_key = ["n_shingles", "set_a", "set_b"]
        # Equal sets have equal bands and signatures.
        grouped = sets.groupBy(*self.set_key)
        self.classes = stored(grouped.agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "classes")
        rows = self.classes.select(F.explode("bands").alias("key"), "class_id")
        shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *(F.sum(F.xxhash64("class_id", F.lit(s)).bitwiseAND(F.lit((1 << 31) - 1))).alias(f"h{s}") for s in (1, 2)))
        shared = shared.where("m > 1").groupBy("m", "h1", "h2").agg(F.min("key").alias("key"))
        rows = stored(rows.join(shared.select("key", "m"), "key"), "buckets")
        # How many others a class meets over all its buckets: copies of one text meet it most.
        met = rows.groupBy("class_id").agg(F.sum("m").alias("met"))
        met = stored(met.join(self.classes.select("class_id", F.col("n_shingles").alias("n"), "signature"), "class_id"), "members")
        self.members = met
        self.buckets = stored(rows.join(met.select("class_id", "met", "n"), "class_id").select("key", "class_id", "m", "met", "n"), "buckets")
        # The same plan at every size: members grow with the corpus and are never broadcast.
        found = docs.join(met.select(F.col("class_id").alias("doc_id")).hint("merge"), "doc_id")
        # A repeated id has one row per text; any of its class serves.
        self.texts = stored(found.select(F.col("doc_id").alias("class_id"), "text"), "texts")

    def against_leaders(self) -> DataFrame:
        """Links ``a, b`` between the leaders of the buckets and their members."""
        best = self.buckets.groupBy("key").agg(F.max(F.struct("met", (-F.col("class_id")).alias("c"), "n")).alias("l"))
        leaders = best.select("key", (-F.col("l.c")).alias("b"), F.col("l.n").alias("n_b"))
        pairs = self.buckets.join(leaders, "key").where(F.col("class_id") != F.col("b"))
        low, high = F.least("n", "n_b"), F.greatest("n", "n_b")
        pairs = pairs.where(100 * low >= self.percent * high).select(F.col("b").alias("a"), F.col("class_id").alias("b")).distinct()
        for end in "ab":
            pairs = pairs.join(self.members.select(F.col("class_id").alias(end), F.col("signature").alias(f"s_{end}")), end)
        pairs = stored(pairs.where(_agreement("s_a", "s_b") >= FLOOR).select("a", "b"), "candidates")
        for end in "ba":
            pairs = pairs.join(self.texts.select(F.col("class_id").alias(end), F.col("text").alias(f"text_{end}")), end)
        both = pairs.select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
        return stored(both.mapInArrow(_confirm_batches(self.width, self.percent), "a bigint, b bigint").distinct(), "links")

    def inside_buckets(self, roots: DataFrame) -> DataFrame:
        """Links that join components within a bucket, from comparing its blocks with each other."""
        placed = self.buckets.select("key", "m", "class_id").join(roots, "class_id")
        several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
        rows = placed.join(several, "key")
        blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("class_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        rows = rows.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.col("own").alias("side"), "class_id", "root")
        rows = rows.join(self.texts, "class_id").select("key", "p", "q", "side", "class_id", "root", "text")
        rows = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
        return stored(rows.mapInArrow(_block_batches(self.width, self.percent), "a bigint, b bigint").distinct(), "links")

    def components(self) -> DataFrame:
        """``class_id, component_id`` for every class in a bucket."""
        links = self.against_leaders()
        roots = self._roots(links)
        more = self.inside_buckets(roots)
        if more.limit(1).count():
            roots = self._roots(links.unionByName(more))
        return roots.select("class_id", F.col("root").alias("component_id"))

    def _roots(self, links: DataFrame) -> DataFrame:
        both = links.select(F.col("a").alias("i"), F.col("b").alias("j")).unionByName(links.select(F.col("b").alias("i"), F.col("a").alias("j")))
        linked = both.select(F.col("i").alias("id")).distinct()
        found = connected_components(linked, both).select(F.col("id").alias("class_id"), "root")
        joined = self.members.select("class_id").join(found, "class_id", "left")
        return stored(joined.select("class_id", F.coalesce("root", "class_id").alias("root")), "roots")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Documents are linked when 100 x shared >= ``percent`` x united shingles; a component's smallest id stays.
    """
    search = NearDuplicates(docs, width, percent)
    components = search.components()
    classes = search.classes.select(*search.set_key, "class_id").join(components, "class_id", "left")
    classes = classes.select(*search.set_key, F.coalesce("component_id", "class_id").alias("component_id"))
    rows = search.sketches.select("doc_id", *search.set_key).join(classes, search.set_key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", kept)
