"""Removal of passages that occur earlier, found by recompression.

Words are symbols of level 0. A round makes the next level: a run of equal symbols becomes one symbol, then, with
all symbols parted into left and right ones, a left symbol and the right one after it become one. Names are
64-bit keyed hashes of what they stand for (symbol and count, or both halves), so all tasks name alike and no
dictionary travels; the partition is one for the whole corpus: in each round a Spark job counts the pairs that each
of ``PARTITIONS`` partitions would make in all texts, and the best is taken.

Each symbol knows the words that decide it: its own, and those that rule out a longer run or another pairing. A
symbol whose deciding words all lie in a window is there in every equal window, at the same place; what touches an
edge of a document is never sure. A window takes, of the highest level that has a sure symbol in it (words are always
sure), the symbol of most words, then of the largest name, then the leftmost: equal windows share it and
its deciding words. Consecutive windows with the same symbol form a *region*, a row with the symbol, named with its
deciding words, and the name of all the region's words.

1. Every task folds equal regions of its texts: all but the first are repeats, whatever the rest of the
   corpus holds. The first ones are shuffled by symbol.
2. Of equal regions all but the first are repeats. A symbol with a single region is settled.
3. Where a symbol occurs in different regions, the first row of each region is opened: its windows are
   named one by one (128 bits), folded in the task and shuffled by name; all but the first are repeats.
4. Runs of repeated windows come back to the texts, whose words they cover are removed.

A hot passage leaves each task once, so no group grows with its copies. Order is (id, text checksum, place):
null ids come first, rows with equal id and text count as one document, and rows with equal id and different
texts go by the checksum. Null texts have no words; texts shorter than a window lose nothing; other columns
pass through whatever their names, and only ``kept_text``, ``n_words`` and ``n_removed`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowprism.llm import texts as T
from flowprism.llm.columns import fresh, schema_of
from flowprism.session import stored

WINDOW = 20
ROUNDS = 2
PARTITIONS = 8
FOLD_ROWS = 1_000_000
SMALLEST = -(2**63)
RUN, PAIR = T.U(1 << 32), T.U(2 << 32)

REGION_SCHEMA = "symbol bigint, region bigint, doc bigint, tag int, at int, n int"
MARK_SCHEMA = "name_a bigint, name_b bigint, doc bigint, tag int, at int, n int"


@dataclass
class Symbols:
    """Symbols of one level in the order of the text: names, words ``[begin, end)``, deciding words ``[low, high)``.

    ``low`` and ``high`` never fall along the text. Beside an edge of a document they reach one word over it.
    """

    name: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray

    @classmethod
    def of_words(cls, words: T.Words, hashes: np.ndarray) -> Symbols:
        at = np.arange(len(words))
        return cls(hashes, at, at + 1, at, at + 1, words.documents())

    def __len__(self) -> int:
        return len(self.name)

    def _same_document(self) -> np.ndarray:
        return self.doc[1:] == self.doc[:-1]

    def _reach(self) -> tuple[np.ndarray, np.ndarray]:
        """Deciding words of the symbol before and of the symbol after; over the edge where there is none."""
        same = self._same_document()
        before, after = self.begin - 1, self.end + 1
        before[1:][same] = self.low[:-1][same]
        after[:-1][same] = self.high[1:][same]
        return before, after

    def runs(self) -> Symbols:
        """Runs of equal symbols as one symbol; both neighbours decide where a run ends."""
        joined = (self.name[1:] == self.name[:-1]) & self._same_document()
        head = np.flatnonzero(np.concatenate([[True], ~joined]))
        count = np.diff(np.append(head, len(self)))
        tail = head + count - 1
        before, after = self._reach()
        name = self.name[head]
        many = count > 1
        name[many] = T.mix(T.mix(name[many] + RUN) + count[many].astype(np.uint64))
        return Symbols(name, self.begin[head], self.end[tail], before[head], after[tail], self.doc[head])

    def lefts(self, partition: int) -> np.ndarray:
        return (T.mix(self.name + T.U(partition)) & T.U(1)).astype(bool)

    def pairing(self, left: np.ndarray) -> np.ndarray:
        """Whether each symbol but the last is the left half of a pair."""
        return left[:-1] & ~left[1:] & self._same_document()

    def pairs(self, partition: int) -> Symbols:
        """Left symbols and right ones after them as one symbol; a lone one is decided by the neighbour it lacks."""
        left = self.lefts(partition)
        paired = np.append(self.pairing(left), False)
        head = np.flatnonzero(~np.concatenate([[False], paired[:-1]]))
        both = paired[head]
        tail = head + both
        before, after = self._reach()
        lone = ~both
        low = np.where(lone & ~left[head], before[head], self.low[head])
        high = np.where(lone & left[head], after[tail], self.high[tail])
        name = self.name[head]
        name[both] = T.mix(T.mix(name[both] + PAIR) + self.name[tail[both]])
        return Symbols(name, self.begin[head], self.end[tail], low, high, self.doc[head])


def levels(words: T.Words, hashes: np.ndarray, partitions: Sequence[int]) -> list[Symbols]:
    """Symbols of the words and of each round's level."""
    found = [Symbols.of_words(words, hashes)]
    for partition in partitions:
        found.append(found[-1].runs().pairs(partition))
    return found


def regions(words: T.Words, hashes: np.ndarray, partitions: Sequence[int], window: int = WINDOW) -> dict[str, np.ndarray]:
    """Runs of windows with the same symbol: first window, number of windows, symbol and region name."""
    starts = T.inside(words, window)
    if not len(starts):
        return {k: np.zeros(0, np.int64) for k in ("first", "n", "symbol", "region")}
    anchor, key = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.uint64)
    open_ = np.arange(len(starts))
    around = T.Spans(hashes, 3)
    found = levels(words, hashes, partitions)
    for level in range(len(found) - 1, -1, -1):
        symbols = found[level]
        # Sure symbols of a window are neighbours: low and high never fall.
        at = np.searchsorted(symbols.low, starts[open_])
        stop = np.searchsorted(symbols.high, starts[open_] + window, "right")
        sure = at < stop
        mine, at, stop = open_[sure], at[sure], stop[sure]
        open_ = open_[~sure]
        length = symbols.end - symbols.begin
        weight = (length.astype(np.uint64) << T.U(56)) | (symbols.name >> T.U(8))
        best = at.copy()
        going = np.arange(len(mine))
        while len(going):
            at[going] += 1
            going = going[at[going] < stop[going]]
            better = going[weight[at[going]] > weight[best[going]]]
            best[better] = at[better]
        anchor[mine] = symbols.begin[best] * len(found) + level
        # Windows of one symbol hold its deciding words as well: they tell apart what a common short symbol joins.
        key[mine] = T.mix(T.mix(symbols.name[best] + T.U(level)) + around(symbols.low[best], symbols.high[best]))
        if not len(open_):
            break
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(starts)))
    first = starts[head]
    name = T.Spans(hashes, 4)(first, first + count + window - 1)
    name = T.mix(name + (anchor[head] - first * len(found)).astype(np.uint64))
    return {"first": first, "n": count, "symbol": key[head], "region": name}


def _pair_counts(partitions: Sequence[int], candidates: Sequence[int]):
    """Pairs that each candidate partition would make after the rounds of ``partitions``, a row for each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(candidates), np.int64)
        for batch in batches:
            for chunk in T.chunks(batch.column(0)):
                words = T.split(chunk)
                if len(words):
                    symbols = levels(words, T.word_hashes(chunk, words), partitions)[-1].runs()
                    total += [np.count_nonzero(symbols.pairing(symbols.lefts(c))) for c in candidates]
        yield pa.RecordBatch.from_arrays([pa.array(candidates, pa.int32()), pa.array(total)], names=["partition", "pairs"])

    return run


def rounds(texts: DataFrame, number: int = ROUNDS) -> list[int]:
    """The partition of each round, the one that makes most pairs in all of ``texts`` (one text column)."""
    chosen: list[int] = []
    for level in range(number):
        candidates = range(1 + level * PARTITIONS, 1 + (level + 1) * PARTITIONS)
        counted = texts.mapInArrow(_pair_counts(tuple(chosen), tuple(candidates)), "partition int, pairs bigint")
        best = counted.groupBy("partition").agg(F.sum("pairs").alias("pairs")).orderBy(F.desc("pairs"), "partition").first()
        chosen.append(best["partition"] if best else candidates[0])
    return chosen


class Fold:
    """Rows of a task with a 128-bit name; all but the first of each name are repeats."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.rows += len(columns[0])

    def batches(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        """Firsts as they are, then repeats as merged runs with the second name null and a spread first one."""
        if not self.rows:
            return
        a, b, doc, tag, at, n = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.rows = [], 0
        order = np.lexsort((at, tag, doc, b, a))
        a, b, doc, tag, at, n = (x[order] for x in (a, b, doc, tag, at, n))
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        later = (doc != doc[head]) | (tag != tag[head]) | (at != at[head])
        yield self._batch(names, a[first], pa.array(b[first].view(np.int64)), doc[first], tag[first], at[first], n[first])
        doc, tag, at, n = merge_runs(doc[later], tag[later], at[later], n[later])
        if len(doc):
            spread = T.mix(doc.view(np.uint64) + at.astype(np.uint64))
            yield self._batch(names, spread, pa.nulls(len(doc), pa.int64()), doc, tag, at, n)

    @staticmethod
    def _batch(names: list[str], a, b, doc, tag, at, n) -> pa.RecordBatch:
        columns = [pa.array(a.view(np.int64)), b, pa.array(doc), *(pa.array(x.astype(np.int32)) for x in (tag, at, n))]
        return pa.RecordBatch.from_arrays(columns, names=names)


def merge_runs(doc, tag, at, n) -> tuple[np.ndarray, ...]:
    """Runs of window starts, those that touch or overlap made one."""
    if not len(doc):
        return doc, tag, at, n
    order = np.lexsort((at, tag, doc))
    doc, tag, at, n = (x[order] for x in (doc, tag, at, n))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    # Ends grow along a document when runs are no longer than a window apart: a running maximum per document.
    group = np.cumsum(new)
    reach = np.maximum.accumulate((at + n) + group * (1 << 40)) - group * (1 << 40)
    new[1:] |= at[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return doc[heads], tag[heads], at[heads], np.maximum.reduceat(reach, heads) - at[heads]


def _region_batches(partitions: Sequence[int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, names = Fold(), [c.split()[0] for c in REGION_SCHEMA.split(", ")]
        for batch in batches:
            doc, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for chunk in T.chunks(batch.column(2)):
                words = T.split(chunk)
                found = regions(words, T.word_hashes(chunk, words), partitions)
                row = np.searchsorted(words.first, found["first"], "right") - 1
                at = found["first"] - words.first[row]
                fold.add(found["symbol"].astype(np.uint64), found["region"].astype(np.uint64), doc[chunk.at + row], tag[chunk.at + row], at, found["n"])
                if fold.rows >= FOLD_ROWS:
                    yield from fold.batches(names)
        yield from fold.batches(names)

    return run


def _ragged(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, ``at`` and ``n`` of a list<struct<at, n>> column; null lists are empty."""
    row = lists.value_parent_indices().to_numpy() if hasattr(lists, "value_parent_indices") else pa.compute.list_parent_indices(lists).to_numpy()
    flat = lists.flatten()
    return row, flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)


def _in_chunk(row, at, n, chunk: T.Chunk, words: T.Words):
    """Runs of the chunk's documents: document in the chunk, first window as a word index, count."""
    mine = (row >= chunk.at) & (row < chunk.at + chunk.n)
    local = row[mine] - chunk.at
    return local, words.first[local] + at[mine], n[mine]


def _window_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the windows of opened regions, folded in the task."""
    fold, names = Fold(), [c.split()[0] for c in MARK_SCHEMA.split(", ")]
    for batch in batches:
        doc, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        row, at, n = _ragged(batch.column(3))
        for chunk in T.chunks(batch.column(2)):
            words = T.split(chunk)
            hashes = T.word_hashes(chunk, words)
            local, first, count = _in_chunk(row, at, n, chunk, words)
            begin = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            place = np.repeat(local, count)
            a, b = (T.Spans(hashes, salt)(begin, begin + WINDOW) for salt in (5, 6))
            fold.add(a, b, doc[chunk.at + place], tag[chunk.at + place], begin - words.first[place], np.ones(len(begin), np.int64))
            if fold.rows >= FOLD_ROWS:
                yield from fold.batches(names)
    yield from fold.batches(names)


def kept_words(chunk: T.Chunk, words: T.Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts made of the words that stay, joined by one space."""
    stay = np.flatnonzero(~gone)
    flags = np.zeros(len(chunk.data) + 1, np.int8)
    flags[words.starts[stay]] += 1
    np.subtract.at(flags, words.ends[stay], 1)
    mask = np.cumsum(flags[:-1], dtype=np.int8) > 0
    document = words.documents()[stay]
    follows = np.zeros(len(stay), bool)
    follows[:-1] = document[1:] == document[:-1]
    mask[words.ends[stay][follows]] = True
    data = np.where(T.SPACE[chunk.data], np.uint8(32), chunk.data)[mask]
    return data, np.concatenate([[0], np.cumsum(mask)])[chunk.offsets]


def _removal_batches(names: list[str], text: int, runs: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, n = _ragged(batch.column(runs))
            for chunk in T.chunks(batch.column(text)):
                words = T.split(chunk)
                _, first, count = _in_chunk(row, at, n, chunk, words)
                cover = np.zeros(len(words) + 1, np.int32)
                np.add.at(cover, first, 1)
                np.add.at(cover, first + count + WINDOW - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                data, offsets = kept_words(chunk, words, gone)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
                kept = pa.LargeStringArray.from_buffers(chunk.n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
                rows = batch.slice(chunk.at, chunk.n)
                columns = [rows.column(i) for i in range(batch.num_columns) if i != runs]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), kept], names=[*names, "n_words", "n_removed", "kept_text"])

    return run


def _repeats(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Folded rows with ``earliest``, the first row of their name; rows that the fold settled have none."""
    name = Window.partitionBy(first, second)
    return rows.withColumn("earliest", F.when(F.col(second).isNotNull(), F.min(F.struct("doc", "tag", "at")).over(name)))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``, the words that stay joined by one space."""
    new = ("n_words", "n_removed", "kept_text")
    kept = [c for c in docs.columns if c not in new]
    own_doc, own_tag, own_text, own_runs = fresh([*docs.columns, *new], "_doc", "_tag", "_text", "_runs")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(SMALLEST)).alias(own_doc), (F.crc32(text) - F.lit(1 << 31)).cast("int").alias(own_tag), *(F.col(f"`{c}`") for c in kept)
    )
    partitions = rounds(rows.select(text.alias(own_text)))
    symbols = rows.select(own_doc, own_tag, text.alias(own_text)).mapInArrow(_region_batches(partitions), REGION_SCHEMA)
    own = F.struct("doc", "tag", "at")
    by_symbol = Window.partitionBy("symbol")
    several = F.min("region").over(by_symbol) != F.max("region").over(by_symbol)
    # The wider window comes first: its exchange serves the narrower one too.
    grouped = _repeats(symbols.withColumn("several", F.coalesce(several, F.lit(False))), "symbol", "region")
    settled = grouped.withColumn("repeat", F.col("earliest").isNull() | (F.col("earliest") != own))
    settled = stored(settled.where(F.col("repeat") | F.col("several")).select("doc", "tag", "at", "n", "repeat"), "regions")

    runs = F.collect_list(F.struct("at", "n")).alias(own_runs)
    key = [F.col("doc").alias(own_doc), F.col("tag").alias(own_tag)]
    opened = settled.where(~F.col("repeat")).groupBy(*key).agg(runs)
    # The texts are dealt out by document once: both joins read the same columns, so they share the exchange.
    dealt = rows.repartition(own_doc, own_tag)
    columns = [F.col(f"`{c}`") for c in kept]
    windows = dealt.join(opened, [own_doc, own_tag]).select(own_doc, own_tag, text.alias(own_text), own_runs, *columns)
    windows = windows.mapInArrow(_window_batches, MARK_SCHEMA)
    later = _repeats(windows, "name_a", "name_b").where(F.col("earliest").isNull() | (F.col("earliest") != own))
    marks = settled.where("repeat").select("doc", "tag", "at", "n").unionByName(later.select("doc", "tag", "at", "n"))
    joined = dealt.join(marks.groupBy(*key).agg(runs), [own_doc, own_tag], "left").select(*columns, own_runs)
    schema = f"{schema_of(docs, kept)}, n_words bigint, n_removed bigint, kept_text string"
    return joined.mapInArrow(_removal_batches(kept, kept.index("text"), len(kept)), schema)
