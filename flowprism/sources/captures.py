"""Capture files: list them, and read their frames as rows.

A long classic file is read by many tasks, a piece of bytes each. A task finds a record border near the start of its
piece by a chain of plausible record headers, walks the headers and tells where its last record ends. Borders are not
trusted: a piece is right only if it begins where the piece before it ends, and the first piece begins behind the file
header; pieces that do not are walked again from that place, until all agree. Frame numbers are sums of the counts of
earlier pieces. Files in block form are read whole by one task.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowprism.functions.wire import decode_frames
from flowprism.session import stored

# Classic capture file magics, as (byte order, ticks per second).
MAGICS = {
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
}
# Fixed values of the block form: types of blocks, byte order marks, option codes of an interface.
SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET = 0x0A0D0D0A, 1, 2, 3, 6
SECTION_START = b"\x0a\x0d\x0d\x0a"
BYTE_ORDERS = {b"\x1a\x2b\x3c\x4d": ">", b"\x4d\x3c\x2b\x1a": "<"}
TICKS_OPTION, OFFSET_OPTION = 9, 14
LONGEST_BLOCK = 256 << 20
FILE_HEADER = 24
RECORD_HEADER = 16
ROWS_PER_BATCH = 10_000
READ_BUFFER = 4 << 20
LEAST_BUFFER = 8 << 10
PIECE_BYTES = 64 << 20
# A border is believed, until it is checked, after this many plausible headers in a row.
CHAIN = 5
LONGEST_FRAME = 262_144
LONGEST_PAUSE = 86_400
FRAME_SCHEMA = "capture_id string, seq bigint, ts_us bigint, frame binary"


def list_captures(spark: SparkSession, path: str, pattern: str = "*.pcap") -> DataFrame:
    """``path, length`` of the capture files under a directory (or of one file)."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if not path.endswith(pattern.lstrip("*")):
        listed = listed.option("pathGlobFilter", pattern)
    return listed.load(path).select("path", "length")


def _records(stream, order: str, ticks: int) -> Iterator[tuple[int, bytes] | None]:
    """``ts_us, frame`` of each record; a last None says that the file ends inside a record."""
    while record := stream.read(RECORD_HEADER):
        if len(record) < RECORD_HEADER:
            yield None
            return
        second, tick, kept, _ = struct.unpack(order + "IIII", record)
        frame = stream.read(kept)
        if len(frame) < kept:
            yield None
            return
        yield second * 1_000_000 + tick * 1_000_000 // ticks, frame


def _interface(body: bytes, order: str) -> tuple[int, int, int]:
    """``ticks per second, seconds to add, longest frame`` of an interface block."""
    ticks, add, at = 1_000_000, 0, 8
    (longest,) = struct.unpack_from(order + "I", body, 4)
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        value = body[at + 4 : at + 4 + size]
        if code == TICKS_OPTION and len(value) == 1:
            ticks = 2 ** (value[0] & 127) if value[0] & 128 else 10 ** value[0]
        elif code == OFFSET_OPTION and len(value) == 8:
            (add,) = struct.unpack(order + "q", value)
        elif code == 0:
            break
        at += 4 + size + -size % 4
    return ticks, add, longest


def _blocks(stream) -> Iterator[tuple[int | None, bytes] | None]:
    """As ``_records``, of a file in block form; a simple packet block has no time (None)."""
    order, interfaces = "<", []
    while start := stream.read(8):
        if start[:4] == SECTION_START:
            mark = stream.read(4)
            if mark not in BYTE_ORDERS:
                yield None
                return
            order, interfaces = BYTE_ORDERS[mark], []
            begun = mark
        else:
            begun = b""
        if len(start) < 8:
            yield None
            return
        kind, size = struct.unpack(order + "II", start)
        if size < 12 + len(begun) or size > LONGEST_BLOCK:
            yield None
            return
        body = begun + stream.read(size - 12 - len(begun))
        if len(body) < size - 12 or len(stream.read(4)) < 4:
            yield None
            return
        if kind == INTERFACE and len(body) >= 8:
            interfaces.append(_interface(body, order))
        elif kind in (PACKET, OLD_PACKET) and len(body) >= 20:
            number, high, low, kept, _ = struct.unpack_from(order + ("I" if kind == PACKET else "Hxx") + "IIII", body)
            if number >= len(interfaces) or 20 + kept > len(body):
                yield None
                return
            ticks, add, _ = interfaces[number]
            yield add * 1_000_000 + ((high << 32) | low) * 1_000_000 // ticks, body[20 : 20 + kept]
        elif kind == SIMPLE_PACKET and len(body) >= 4 and interfaces:
            (sent,) = struct.unpack_from(order + "I", body)
            longest = interfaces[0][2] or sent
            yield None, body[4 : 4 + min(sent, longest, len(body) - 4)]


def _open(uri: str, most: int = READ_BUFFER):
    """The file, read ahead by no more than a reader of ``most`` bytes has use for."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(uri)
    return io.BufferedReader(system.open_input_file(name), max(LEAST_BUFFER, min(most, READ_BUFFER)))


def _form(stream) -> tuple[str, int] | str | None:
    """Byte order and ticks of a classic file, "blocks", or None; a classic stream then stands at its first record."""
    head = stream.read(FILE_HEADER)
    if len(head) == FILE_HEADER and head[:4] in MAGICS:
        return MAGICS[head[:4]]
    if head[:4] == SECTION_START and head[8:12] in BYTE_ORDERS:
        stream.seek(0)
        return "blocks"
    return None


def _checked_form(uri: str, stream, strict: bool) -> tuple[str, int] | str | None:
    form = _form(stream)
    if form is None and strict:
        raise ValueError(f"{uri} is not a classic capture file")
    return form


def _frames(stream, form: tuple[str, int] | str) -> Iterator[tuple[int | None, bytes] | None]:
    return _blocks(stream) if form == "blocks" else _records(stream, *form)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = list_captures(spark, path, pattern)
    return files.select("path").repartition(max(1, min(files.count(), 10_000)))


def _tasks(rows: DataFrame, size: Column) -> int:
    """Tasks for rows that stand for ``size`` bytes each: short ones share a task, all cores have some."""
    count, total = rows.agg(F.count(F.lit(1)), F.sum(size)).first()
    least = 8 * rows.sparkSession.sparkContext.defaultParallelism
    return max(1, min(count, 10_000, max(least, -(-(total or 0) // PIECE_BYTES))))


def _border(stream, begin: int, length: int, order: str, ticks: int) -> int | None:
    """The first place from ``begin`` where a chain of plausible record headers starts."""
    stream.seek(begin)
    whole = min(length - begin, (CHAIN + 1) * (LONGEST_FRAME + RECORD_HEADER))
    data = b""
    for first in range(min(whole, LONGEST_FRAME + RECORD_HEADER)):
        at, last = first, None
        for _ in range(CHAIN):
            if begin + at == length and last is not None:
                break
            # Most chains are short: no more is read than they need.
            if at + RECORD_HEADER > len(data) and len(data) < whole:
                data += stream.read(min(max(at + RECORD_HEADER - len(data), len(data), LEAST_BUFFER), whole - len(data)))
            if at + RECORD_HEADER > len(data):
                at = None
                break
            second, tick, kept, sent = struct.unpack_from(order + "IIII", data, at)
            near = last is None or abs(second - last) <= LONGEST_PAUSE
            if tick >= ticks or not 0 < kept <= LONGEST_FRAME or kept > sent or sent > 64 * LONGEST_FRAME or not near:
                at = None
                break
            at, last = at + RECORD_HEADER + kept, second
        if at is not None:
            return begin + first
    return None


def _walk(stream, begin: int, limit: int, length: int, order: str) -> tuple[int, int]:
    """Whole records that begin before ``limit``, and where the next one begins (the file's end, if one is cut off)."""
    at, found = begin, 0
    stream.seek(at)
    while at < limit:
        record = stream.read(RECORD_HEADER)
        if len(record) < RECORD_HEADER:
            return found, length
        (kept,) = struct.unpack_from(order + "I", record, 8)
        if at + RECORD_HEADER + kept > length:
            return found, length
        stream.seek(kept, io.SEEK_CUR)
        at, found = at + RECORD_HEADER + kept, found + 1
    return found, at


def _pieces(files: DataFrame, piece_bytes: int, strict: bool) -> DataFrame:
    """``path, begin, stop, first``: checked pieces of the files and the number of their first frame."""
    schema = "path string, length bigint, piece bigint, begin bigint, stop bigint, records bigint"

    def survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for uri, length, piece, due in zip(batch["path"], batch["length"], batch["piece"], batch["due"], strict=True):
                low, limit = piece * piece_bytes, min(length, (piece + 1) * piece_bytes)
                with _open(uri, piece_bytes) as stream:
                    form = _checked_form(uri, stream, strict)
                    if form is None or form == "blocks":
                        found.append((uri, length, piece, length if piece else 0, length, 0))
                        continue
                    begin = FILE_HEADER if piece == 0 else due if due >= 0 else _border(stream, low, length, *form)
                    if begin is None:
                        found.append((uri, length, piece, -1, -1, 0))
                        continue
                    records, stop = _walk(stream, begin, limit, length, form[0])
                    found.append((uri, length, piece, begin, stop, records))
            yield pd.DataFrame(found, columns=["path", "length", "piece", "begin", "stop", "records"])

    short = files.where(F.col("length") <= piece_bytes)
    # A short file needs no survey: one task reads it from its first byte on.
    short = short.select("path", F.lit(0).cast("bigint").alias("begin"), F.col("length").alias("stop"), F.lit(0).cast("bigint").alias("first"))
    long = files.where(F.col("length") > piece_bytes)
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(length - 1) div {piece_bytes}")))
    long = stored(long.select("path", "length", number.alias("piece")).withColumn("due", F.lit(-1).cast("bigint")), "pieces")
    if not long.limit(1).count():
        return short
    size = F.lit(piece_bytes)
    known = stored(long.repartition(_tasks(long, size), "path", "piece").mapInPandas(survey, schema), "survey")
    along = Window.partitionBy("path").orderBy("piece")
    while True:
        due = known.withColumn("due", F.lag("stop").over(along))
        wrong = stored(due.where((F.col("piece") > 0) & (F.col("begin") != F.col("due"))).select("path", "length", "piece", "due"), "wrong")
        if not wrong.limit(1).count():
            break
        # The first wrong piece of a file gets its true border: its predecessors are right, so each round ends nearer.
        mended = wrong.repartition(_tasks(wrong, size), "path", "piece").mapInPandas(survey, schema)
        known = stored(known.join(wrong, ["path", "piece"], "left_anti").select(*known.columns).unionByName(mended), "survey")
    before = F.coalesce(F.sum("records").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = known.withColumn("first", before).where(F.col("stop") > F.col("begin"))
    return short.unionByName(cut.select("path", "begin", "stop", "first"))


def read_frames(
    spark: SparkSession, path: str, pattern: str = "*.pcap", on_bad: str = "raise", piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """Frames of every capture: ``capture_id, seq, ts_us, frame``; the id is the file's full path.

    Classic files longer than ``piece_bytes`` are read by a task for each piece, other files by one task; a task streams
    its bytes record by record, so memory does not grow with the file. A file that is no capture fails the read with its
    path, unless ``on_bad="report"``. A record cut off at the end of a file (a sensor still writing) is left out;
    ``capture_problems`` names such files, and those that are no captures. Frames of simple blocks have no time (null).
    """
    if on_bad not in ("raise", "report"):
        raise ValueError("on_bad is 'raise' or 'report'")
    strict = on_bad == "raise"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def table(rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["capture_id", "seq", "ts_us", "frame"]).astype({"ts_us": "Int64"})

        # Rows of short pieces share a table.
        rows = []
        for batch in batches:
            for uri, begin, stop, seq in zip(batch["path"], batch["begin"], batch["stop"], batch["first"], strict=True):
                with _open(uri, piece_bytes) as stream:
                    form = _checked_form(uri, stream, strict)
                    if form is None:
                        continue
                    if begin:
                        stream.seek(begin)
                    at = max(begin, FILE_HEADER)
                    for record in _frames(stream, form):
                        if record is None:
                            break
                        rows.append((uri, seq, *record))
                        seq, at = seq + 1, at + RECORD_HEADER + len(record[1])
                        if len(rows) == ROWS_PER_BATCH:
                            yield table(rows)
                            rows = []
                        if form != "blocks" and at >= stop:
                            break
        if rows:
            yield table(rows)

    pieces = _pieces(list_captures(spark, path, pattern), piece_bytes, strict)
    return pieces.repartition(_tasks(pieces, F.col("stop") - F.col("begin"))).mapInPandas(read, FRAME_SCHEMA)


def capture_problems(spark: SparkSession, path: str, pattern: str = "*.pcap") -> DataFrame:
    """``path, problem, frames`` of files that are no captures or end inside a record; ``frames`` are whole."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for uri in batch["path"]:
                with _open(uri) as stream:
                    form = _form(stream)
                    if form is None:
                        found.append((uri, "not a classic capture file", 0))
                        continue
                    whole = 0
                    for record in _frames(stream, form):
                        if record is None:
                            found.append((uri, "ends inside a record", whole))
                        else:
                            whole += 1
            yield pd.DataFrame(found, columns=["path", "problem", "frames"])

    return _files(spark, path, pattern).mapInPandas(look, "path string, problem string, frames bigint")


def read_packets(
    spark: SparkSession, path: str, pattern: str = "*.pcap", on_bad: str = "raise", piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """Decoded packets of every capture; ``capture_id``, the file's path, is the scope."""
    return decode_frames(read_frames(spark, path, pattern, on_bad, piece_bytes)).drop("frame")


def write_capture(frames: list[tuple[int, bytes]], path: str) -> None:
    """A small classic capture file from (ts_us, frame) pairs, for examples and tests."""
    with open(path, "wb") as out:
        out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
        for ts_us, frame in frames:
            out.write(struct.pack("<IIII", ts_us // 1_000_000, ts_us % 1_000_000, len(frame), len(frame)))
            out.write(frame)
