"""Quality scores learned from preference pairs (Bradley-Terry).

A document's strength is linear in features of its text. Every preference pair sets a good document against
a poor one; the logistic loss on the difference of their features is minimised by Newton steps. The strength
at a quantile of the labelled strengths becomes the point where the score is ``THRESHOLD``.

Learning looks at a bounded sample of labelled rows (``max_labelled``, the rows with the smallest hash of
their id) whose crc32 of the id modulo 4 is not 2; the features come from whole texts. Scores need no
shuffle. Null and empty texts have features of their own and get a score; with no pair to learn from nothing
is held against any document and every score is 1. Null ids count as held in; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowprism.llm import texts as T
from flowprism.llm.quality_rules import LEADS, SYMBOL, chunk_stats

THRESHOLD = 0.7
MAX_LABELLED = 10_000
PAIRS_PER_DOCUMENT = 8
FEATURES = (
    "symbol_share", "upper_word_share", "dup_line_share", "repeat_share", "bar_share", "bang_share", "digit_share",
    "ascii_punct_share", "upper_char_share", "distinct_share", "top_word_share", "word_length", "long_word_share",
    "log_words", "line_length", "few_words", "symbol_any", "upper_any", "repeat_any", "bar_any", "bang_any", "web_share",
)

_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in "!?;:()[]{}/\\@=_~^+\"'`"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def features(chunk: T.Chunk) -> np.ndarray:
    """Documents x FEATURES."""
    s = {k: v.astype(np.float64) for k, v in chunk_stats(chunk).items()}
    words = T.split(chunk)
    hashes = T.word_hashes(chunk, words)
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[chunk.offsets]).astype(np.float64)
    data = chunk.data
    upper, letters = (data >= 65) & (data <= 90), ((data | 32) >= 97) & ((data | 32) <= 122)
    n_words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    distinct, top = np.ones(chunk.n), np.zeros(chunk.n)
    for i in np.flatnonzero(words.counts):
        _, times = np.unique(hashes[words.first[i] : words.first[i + 1]], return_counts=True)
        distinct[i], top[i] = len(times) / times.sum(), times.max() / times.sum()
    length = np.diff(np.concatenate([[0], np.cumsum(LEADS[data])])[np.stack([words.starts, words.ends])], axis=0)[0] if len(words) else np.zeros(0)
    long = np.diff(np.concatenate([[0], np.cumsum(length > 14)])[words.first])
    symbol, up = s["n_symbols"] / chars, s["upper_words"] / n_words
    repeat, bar, bang = s["n_repeat_words"] / n_words, s["bar_words"] / n_words, count(data == 33) / n_words
    columns = [
        symbol, up, s["n_dup_lines"] / np.maximum(s["n_lines"], 1), repeat, bar, bang, count(_DIGIT[data]) / chars,
        count(_PUNCT[data]) / chars, count(upper) / np.maximum(count(letters), 1), distinct, top, s["word_chars"] / n_words / 10,
        long / n_words, np.log1p(s["n_words"]) / 10, np.log1p(s["n_words"] / np.maximum(s["n_lines"], 1)) / 10, s["n_words"] < 10,
        symbol > 0.02, up > 0.05, repeat > 0.1, bar > 0.03, bang > 0.03, count((data == 123) | (data == 125) | (data == 61)) / chars,
    ]
    return np.stack([np.minimum(np.asarray(c, np.float64), 4.0) for c in columns], axis=1)


@dataclass
class Ranking:
    """A fitted model: standardised features, weights, and the strength at which the score is THRESHOLD."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    pairs: int

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.pairs:
            return np.ones(len(x))
        z = np.clip(self.strength(x) - self.cut, -30, 30) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-z))


def fit_pairs(x: np.ndarray, good: np.ndarray, per_document: int = PAIRS_PER_DOCUMENT, ridge: float = 1e-3, seed: int = 7) -> Ranking:
    """Bradley-Terry weights by Newton's method; the cut is the best quantile of the strengths.

    Each document of either class meets ``per_document`` of the other. Quantiles are judged by the
    number of right decisions; among equals the lowest wins, so that clean documents stay.
    """
    d = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if not good.any() or good.all():
        return Ranking(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    winners = np.concatenate([np.repeat(up, per_document), rng.choice(up, len(down) * per_document)])
    losers = np.concatenate([rng.choice(down, len(up) * per_document), np.repeat(down, per_document)])
    difference = z[winners] - z[losers]
    w = np.zeros(d)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(difference @ w, -30, 30)))
        gradient = difference.T @ (p - 1) / len(p) + ridge * w
        hessian = (difference * (p * (1 - p))[:, None]).T @ difference / len(p) + ridge * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    strengths = z @ w
    levels = np.unique(np.quantile(strengths, np.arange(1, 200) / 200))
    right = [(strengths[good] >= t).sum() + (strengths[~good] < t).sum() for t in levels]
    return Ranking(mean, scale, w, float(levels[int(np.argmax(right))]), len(winners))


def _feature_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in T.chunks(batch.column(1)):
            x = features(chunk)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.at, chunk.n), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "x"]
            )


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Ranking:
    """Fit on at most ``max_labelled`` labelled rows that are not held out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    rows = rows.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = text.join(F.broadcast(sample), "doc_id").select("quality", "text").mapInArrow(_feature_batches, "quality int, x array<double>")
    found = labelled.limit(2 * max_labelled).collect()
    x = np.array([r[1] for r in found], np.float64).reshape(len(found), len(FEATURES))
    return fit_pairs(x, np.array([r[0] == 1 for r in found], bool))


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """The documents with a ``score`` column; other columns pass through (one named score is replaced)."""
    kept = [c for c in docs.columns if c != "score"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "score double"])
    text = kept.index("text")

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            scores = [model.score(features(chunk)) for chunk in T.chunks(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *scores]))], names=[*kept, "score"])

    return docs.select(*kept).mapInArrow(batches, schema)


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Documents with ``held_out``, ``score`` and ``predicted``."""
    scored = score(docs, fit(docs, labels, max_labelled))
    return scored.withColumns(
        {
            "held_out": F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)),
            "predicted": (F.col("score") >= THRESHOLD).cast("int"),
        }
    )
