"""Quality rules with risk-controlled cutoffs.

Five statistics of each text (the rules) get, in each stratum, the strictest cutoffs whose false rejection
rate is proven small on labelled holdouts: with ``n`` good labelled documents all rules together may reject at
most ``k`` of them, where ``P(Binomial(n, allowed) <= k) <= confidence / strata``. That is the exact
(Clopper-Pearson) upper bound of the combined rejection being at most ``allowed``, in every stratum at once.

The cutoffs of a stratum are points of one path on which every rule only gets stricter, so the rejected sets are
nested and the points are tested in order from the loosest, each at the full level, up to the first that fails
(fixed sequence). A quarter of the good labels lays the path: all rules come down together from no cutoff, each no further than
where it rejects none of that quarter, then to where it rejects growing shares of it. The other three quarters
prove the points and are not used for the path. A stratum without labels in the first quarter takes the diagonal.

Only rows whose crc32 of the id falls into three quarters serve as holdout labels; a cutoff is the same
whatever the rest of the corpus holds. Null texts are empty; null ids have no label; a null stratum is one
of its own; repeated rows count as often as they occur; other columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowprism.llm import texts as T
from flowprism.session import stored

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A rule rejects when its value is above the cutoff; values are shares of words or characters.
RULES = ("symbol_share", "upper_share", "dup_line_share", "repeat_share", "bar_share")
GRID = tuple(round(0.02 * i, 2) for i in range(1, 50))
#: Shares of the path's own labels that each rule may reject at the last points of a path.
PATH_SHARES = tuple(round(0.0025 * i, 4) for i in range(1, 41))

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Bytes that begin a code point, so counting them counts code points.
LEADS = (np.arange(256) & 0xC0) != 0x80

STATS_SCHEMA = "doc_id bigint, stratum string, n_lines bigint, " + ", ".join(f"{c} bigint" for c in BASE) + ", upper_words bigint, bar_words bigint"


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(words: T.Words, codes: np.ndarray, length: int = 5) -> np.ndarray:
    """Words covered by a window of ``length`` words that occurs at least twice in its document."""
    n = len(words)
    starts = T.inside(words, length)
    cover = np.zeros(n + 1, np.int64)
    if len(starts):
        key = words.documents()[starts]
        for k in range(length):
            key = T.paired(key, codes[starts + k])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(starts), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(cover, starts[twice], 1)
        np.add.at(cover, starts[twice] + length, -1)
    return np.cumsum(cover)[:n] > 0


def _duplicate_lines(chunk: T.Chunk, words: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal (as characters) to an earlier line of the same document."""
    data, n = chunk.data, len(chunk.data)
    if not n:
        return np.zeros(chunk.n, np.int64), np.zeros(chunk.n, np.int64)
    breaks = np.flatnonzero(data == 10)
    # A document ends a line too; a line lies in the document in which it begins.
    starts = np.unique(np.concatenate([chunk.offsets[:-1][np.diff(chunk.offsets) > 0], breaks + 1]))
    starts = starts[starts < n]
    document = np.searchsorted(chunk.offsets, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], n), chunk.offsets[document + 1])
    ends = ends - (data[ends - 1] == 10) * (ends > starts)
    counts = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, document = starts[counts], ends[counts], document[counts]
    lines = T.Words(starts, ends, np.searchsorted(starts, chunk.offsets))
    key = T.paired(document, T.codes(chunk, lines)[0])
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    if len(key) > 1:
        later[order[1:][key[order][1:] == key[order][:-1]]] = True
    return np.bincount(document, minlength=chunk.n), np.bincount(document[later], minlength=chunk.n)


def chunk_stats(chunk: T.Chunk) -> dict[str, np.ndarray]:
    """Counts for each document of a chunk."""
    words = T.split(chunk)
    lead = LEADS[chunk.data]
    solid = ~T.SPACE[chunk.data]
    n_lines, n_dup = _duplicate_lines(chunk, words)
    upper = (chunk.data >= 65) & (chunk.data <= 90)
    lower = (chunk.data >= 97) & (chunk.data <= 122)
    ups, lows = _spans(upper, words), _spans(lower, words)
    bar = (words.ends - words.starts == 1) & (chunk.data[words.starts] == ord("|")) if len(words) else np.zeros(0, bool)
    return {
        "n_words": words.counts,
        "word_chars": _sums(lead & solid, chunk.offsets),
        "n_symbols": _sums(SYMBOL[chunk.data], chunk.offsets),
        "n_dup_lines": n_dup,
        "n_repeat_words": _sums(_repeated(words, T.codes(chunk, words)[0]), words.first),
        "n_lines": n_lines,
        "upper_words": _sums((ups > 1) & (lows == 0), words.first),
        "bar_words": _sums(bar, words.first),
    }


def _spans(flags: np.ndarray, words: T.Words) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=total[1:])
    return total[words.ends] - total[words.starts]


def _stats_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in T.chunks(batch.column(2)):
            stats = chunk_stats(chunk)
            rows = batch.slice(chunk.at, chunk.n)
            names = ("n_lines", *BASE, "upper_words", "bar_words")
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), *(pa.array(stats[c], pa.int64()) for c in names)],
                names=["doc_id", "stratum", *names],
            )


def statistics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row per document: base counts and the value of each rule."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col(stratum).cast("string").alias("stratum"), F.col("text").cast("string"))
    raw = rows.mapInArrow(_stats_batches, STATS_SCHEMA)
    per = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return raw.select(
        "doc_id",
        "stratum",
        *BASE,
        F.least(per("n_symbols", "word_chars"), F.lit(1.0)).alias("symbol_share"),
        per("upper_words", "n_words").alias("upper_share"),
        per("n_dup_lines", "n_lines").alias("dup_line_share"),
        per("n_repeat_words", "n_words").alias("repeat_share"),
        per("bar_words", "n_words").alias("bar_share"),
    )


def most_rejections(n: int, risk: float, level: float) -> int:
    """Largest k with P(Binomial(n, risk) <= k) <= level; -1 if there is none."""
    if not 0 < risk < 1:
        raise ValueError("risk lies between 0 and 1")
    log, total, k = n * math.log1p(-risk), 0.0, -1
    step = math.log(risk) - math.log1p(-risk)
    for i in range(n + 1):
        total += math.exp(log)
        if total > level:
            break
        k = i
        log += math.log(n - i) - math.log(i + 1) + step if i < n else 0.0
    return k


def _paths(laid: DataFrame) -> DataFrame:
    """``stratum, paths``: for each rule the grid place at each point of the stratum's path; the place past the grid is no cutoff."""
    last = len(GRID)
    values = laid.select("stratum", F.posexplode("below").alias("rule", "below"))
    counts = values.groupBy("stratum", "rule", "below").agg(F.count("*").alias("n"))
    bins = counts.groupBy("stratum", "rule").agg(F.sum("n").alias("n"), F.collect_list(F.struct("below", "n")).alias("bins"))
    lost = lambda i: F.aggregate(
        F.filter("bins", lambda b: b["below"] > i), F.lit(0).cast("bigint"), lambda total, b: total + b["n"]
    )
    losses = bins.withColumn("losses", F.transform(F.sequence(F.lit(0), F.lit(last)), lost))
    place = lambda share: F.array_min(F.filter(F.sequence(F.lit(0), F.lit(last)), lambda i: F.get("losses", i) <= share * F.col("n")))
    placed = losses.withColumn("none", place(F.lit(0.0)))
    down = F.transform(F.sequence(F.lit(last), F.lit(0), F.lit(-1)), lambda i: F.greatest(i, F.col("none")))
    further = F.transform(F.array(*map(F.lit, PATH_SHARES)), place)
    path = placed.select("stratum", F.struct("rule", F.concat(down, further).alias("path")).alias("p"))
    return path.groupBy("stratum").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["path"]).alias("paths"))


def cutoffs(stats: DataFrame, labels: DataFrame, allowed: float = 0.05, confidence: float = 0.05) -> DataFrame:
    """``stratum, rule, cutoff, n_good, n_rejected``: the strictest proven cutoffs, null where none are.

    ``n_good`` and ``n_rejected`` (by all rules together) count the rows that prove. The holdout counts are
    histograms over strata and grid points, aggregated by Spark; only the bound on rejections of each
    stratum's size is computed on the driver.
    """
    spark = stats.sparkSession
    held = labels.where((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & (F.col("quality") == 1)).select("doc_id").distinct()
    grid = F.array(*(F.lit(g) for g in GRID))
    # The number of grid points below a value is the number of cutoffs that reject its document.
    passes = lambda rule: F.size(F.filter(grid, lambda g: F.col(rule) > g))
    below = F.array(*map(passes, RULES))
    lays = F.floor(F.crc32(F.col("doc_id").cast("string")) / 4) % 4 == 0
    good = stored(stats.join(held, "doc_id", "left_semi").select("stratum", lays.alias("lays"), below.alias("below")))
    paths = stored(_paths(good.where("lays"))).withColumnRenamed("stratum", "_of")
    small = paths.limit(10_001).count() <= 10_000
    diagonal = F.array_repeat(F.concat(F.sequence(F.lit(len(GRID)), F.lit(0), F.lit(-1)), F.array_repeat(F.lit(0), len(PATH_SHARES))), len(RULES))
    joined = lambda rows: rows.join(F.broadcast(paths) if small else paths, F.col("stratum").eqNullSafe(F.col("_of")), "left").withColumn("paths", F.coalesce("paths", diagonal))
    # The point of the path from which on any rule rejects a document: a path only comes down.
    points = len(GRID) + 1 + len(PATH_SHARES)
    first = lambda r: F.size(F.filter(F.get("paths", F.lit(r)), lambda c: c >= F.get("below", F.lit(r))))
    proving = joined(good.where(~F.col("lays"))).select("stratum", F.least(*(first(r) for r in range(len(RULES)))).alias("from"))
    counts = proving.groupBy("stratum", "from").agg(F.count("*").alias("n"))
    strata = stored(counts.groupBy("stratum").agg(F.sum("n").alias("n_good"), F.collect_list(F.struct("from", "n")).alias("bins")))
    sizes = [r[0] for r in strata.select("n_good").distinct().limit(100_001).collect()]
    if len(sizes) > 100_000:
        raise ValueError("over 100,000 different stratum sizes: use a coarser stratum")
    tests = max(1, strata.count())
    bounds = spark.createDataFrame([(int(n), most_rejections(int(n), allowed, confidence / tests)) for n in sizes], "n_good bigint, most bigint")
    lost = lambda at: F.aggregate(
        F.filter("bins", lambda b: b["from"] <= at), F.lit(0).cast("bigint"), lambda total, b: total + b["n"]
    )
    passed = F.filter(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: lost(i) <= F.col("most"))
    chosen = joined(strata.join(bounds, "n_good").withColumn("at", F.array_max(passed)))
    return chosen.withColumn("n_rejected", F.when(F.col("at").isNotNull(), lost(F.col("at")))).select(
        "stratum",
        F.posexplode(F.array(*map(F.lit, RULES))).alias("_rule", "rule"),
        "paths", "at", "n_good", "n_rejected",
    ).select(
        "stratum", "rule", F.get(grid, F.get(F.get("paths", F.col("_rule")), F.col("at"))).alias("cutoff"), "n_good", "n_rejected"
    )


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", allowed: float = 0.05, confidence: float = 0.05) -> DataFrame:
    """Statistics of every document, ``base_failed`` and ``kept``.

    A document fails the base when it has under 10 words or over a fifth of its words in repeated windows.
    Strata without enough good labels get no cutoff and lose nothing to the rules.
    """
    stats = stored(statistics(docs, stratum))
    chosen = cutoffs(stats, labels, allowed, confidence)
    per_stratum = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    joined = stats.join(F.broadcast(per_stratum) if per_stratum.limit(10_001).count() <= 10_000 else per_stratum, stats["stratum"].eqNullSafe(per_stratum["stratum"]), "left")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    broken = [F.coalesce(F.col(rule) > F.col("cuts")[rule], F.lit(False)) for rule in RULES]
    any_broken = broken[0]
    for b in broken[1:]:
        any_broken = any_broken | b
    return joined.select(
        "doc_id", *BASE, base.alias("base_failed"), (~base & ~any_broken).alias("kept"), *(F.round(r, 9).alias(r) for r in RULES)
    )
