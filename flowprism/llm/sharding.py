"""Shards along a Hilbert curve over metadata.

Several columns are quantised to ``BITS`` bits each by the quantiles of the data, so that a hot value takes
its share of the cube and no more; rows are ordered by their index on the Hilbert curve through that cube,
and the order is cut into runs of equal row counts. Neighbours on the curve are close in every dimension, so
the runs have narrow minima and maxima in all of them and files can be skipped by any.

Strings are ordered whole: their distinct values are ranked, and the rank is what is quantised, so values with
a common start stay apart. ``write_shards`` writes each run of the curve as a file of its own.

Ranks come from a range partitioning with counted partitions: no window over all rows, no text in a shuffle.
Ties on the curve go by text checksum, then id: equal texts lie side by side, and a hot cell is split.
Null texts count as empty; null ids and null dimensions sort first; repeated rows take separate slots; an
empty table gives no rows; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowprism.llm.columns import fresh
from flowprism.operators.numbering import rank_rows
from flowprism.session import broadcast_if_small, stored

BITS = 6


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with coordinates below ``2**bits``; points x dimensions."""
    x = [c.astype(np.int64).copy() for c in points.T]
    dims = len(x)
    if dims * bits > 62:
        raise ValueError("dimensions times bits must stay within 62")
    # Undo the rotations and reflections of each level, from the coarsest to the finest.
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(dims):
            upper = (x[d] >> level) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros(len(points), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    index = np.zeros(len(points), np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | (((x[d] ^ flip) >> level) & 1)
    return index


def ranked(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the place of a string among the distinct values in the order of their bytes, null for null."""
    (value,) = fresh([*rows.columns, name], "_value")
    values = rows.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").alias(value)).distinct()
    places, _ = rank_rows(values, [value], name)
    return rows.join(broadcast_if_small(places), F.col(f"`{column}`") == F.col(value), "left").drop(value)


def quantise(rows: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """``rows`` with an array ``cell``: for each dimension, how many quantiles of the data lie below."""
    places = fresh(rows.columns, *(f"_place{i}" for i in range(len(dimensions))))
    for column, place in zip(dimensions, places, strict=True):
        if rows.schema[column].dataType.simpleString() == "string":
            rows = ranked(rows, column, place)
        else:
            rows = rows.withColumn(place, F.col(f"`{column}`"))
    numbers = [F.col(place).cast("double") for place in places]
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = rows.agg(*(F.percentile_approx(n, cuts, 10_000).alias(f"d{i}") for i, n in enumerate(numbers))).first()
    edges = [F.array(*(F.lit(float(e)) for e in (found[i] or [0.0]))) for i in range(len(dimensions))]

    def below(number: Column, cuts: Column) -> Column:
        found = F.size(F.filter(cuts, lambda cut: cut < number))
        return F.when(number.isNull(), 0).otherwise(found).cast("int")

    cell = [below(n, e) for n, e in zip(numbers, edges, strict=True)]
    return rows.withColumn("cell", F.array(*cell)).drop(*places)


def _index_batches(dims: int, bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(batch.schema.get_field_index("cell"))
            flat = cell.flatten().to_numpy(zero_copy_only=False).reshape(len(cell), dims)
            keep = [i for i, name in enumerate(batch.schema.names) if name != "cell"]
            index = pa.array(hilbert_index(flat, bits), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), index], names=[*(batch.schema.names[i] for i in keep), "hilbert"])

    return run


def shard(rows: DataFrame, dimensions: list[str], ties: list[str], shards: int, bits: int = BITS) -> DataFrame:
    """``rows`` with ``hilbert``, ``shard`` and ``slot``; shard sizes differ by one row at most."""
    celled = quantise(rows, dimensions, bits)
    kept = [f for f in celled.schema.fields if f.name != "cell"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "hilbert bigint"])
    # Stored, as a range partitioning reads its input twice.
    indexed = stored(celled.mapInArrow(_index_batches(len(dimensions), bits), schema), "indexed")
    placed, total = rank_rows(indexed, ["hilbert", *ties], "rank")
    at = F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)")
    # Shard s begins at the first rank r with r * shards >= s * total.
    begin = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", at).withColumn("slot", F.col("rank") - begin)


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Files of ``rows_per_file`` rows or fewer, in folders ``shard=.../run=...``: a file is one run of the curve.

    The least and largest values that a file's footer holds are those of a run, so readers skip files by any dimension.
    """
    runs = sharded.withColumn("run", F.expr(f"cast(slot div {rows_per_file} as int)"))
    runs.repartition("shard", "run").sortWithinPartitions("shard", "run", "slot").write.partitionBy("shard", "run").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Documents by id, text size, source and language; only sizes and checksums are shuffled."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(text) + 8).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.col("source").cast("string").alias("source"),
            F.col("lang").cast("string").alias("lang"),
        )
    )
    out = shard(rows, ["source", "lang", "size", "doc_id"], ["text_crc32", "doc_id"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
