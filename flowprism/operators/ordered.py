"""Running (prefix) aggregates that never hold a whole scope or flow in one task.

A scope is one capture or one micro-batch; ``seq`` is the frame number in it, so
a block of ``2**block_bits`` consecutive numbers holds at most that many rows.
For a long scope the frames are windowed per (scope, block). What happened before
a block arrives as one extra *carry row* per key: partial aggregates per
(key, block) are combined over the earlier blocks, and the carry rows are unioned
with the frames and sorted in front of them. One shuffle on (scope, block) then
serves every running aggregate, however large one scope, flow or address is.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowprism.functions.packet import FLOW_KEY, TCP_FLAG_MASKS, tcp_flag_bits, with_flow_key
from flowprism.session import stored

BLOCK_BITS = 18
# Frames that a task windows where the number of frames is known; a task holds them once for each order.
TASK_FRAMES = 1 << 16
# Epoch microseconds are split in two parts whose sums stay exact in 64 bits.
_SPLIT = 1 << 20

_FLAGS = list(TCP_FLAG_MASKS)[:5]
_FRAME = "_frame"


def block_of(seq: str = "seq", bits: int = BLOCK_BITS) -> Column:
    return F.shiftright(F.col(seq), bits)


def _upto(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _count_carry(frames: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows of each key in earlier blocks, one row per (key, block)."""
    past = _before(Window.partitionBy(*keys).orderBy("_blk"))
    return (
        frames.groupBy(*keys, "_blk")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, "_blk", F.sum("n").over(past).alias(name))
        .where(F.col(name).isNotNull())
    )


def _scope_carry(blocks: DataFrame, scope: str) -> DataFrame:
    """Rows, first and last time of a scope before each block, from partial rows of the blocks."""
    past = _before(Window.partitionBy(scope).orderBy("_blk"))
    return (
        blocks.groupBy(scope, "_blk")
        .agg(
            F.sum("n").alias("n"),
            F.max_by("last_us", "last_seq").alias("last"),
            F.min_by("first_us", "first_seq").alias("first"),
        )
        .select(
            scope,
            "_blk",
            F.sum("n").over(past).alias("_n_scope"),
            F.last("last").over(past).alias("_last_us"),
            F.first("first").over(past).alias("_first_us"),
        )
        .where(F.col("_n_scope").isNotNull())
    )


def _one_row_each(frames: DataFrame, scope: str) -> DataFrame:
    """Frames in the form that ``_scope_carry`` sums up."""
    return frames.select(
        scope, "_blk", F.lit(1).alias("n"), *[F.col(c).alias(f"{end}_{n}") for end in ("first", "last") for c, n in (("ts_us", "us"), ("seq", "seq"))]
    )


def _since(high: Column, low: Column, rows: Column, base: Column) -> Column:
    """Sum of (ts - base) in microseconds from the two exact partial sums."""
    base_high = F.floor(base / F.lit(_SPLIT)).cast("long")
    base_low = base - base_high * _SPLIT
    return (high - rows * base_high).cast("double") * _SPLIT + (low - rows * base_low).cast("double")


def _second_latest(bits: int) -> tuple[list[Column], Column]:
    """Aggregates and expression of the second-largest time among frames with different numbers.

    Every other frame of a block differs from the latest one in some bit of its number. The
    latest time per bit and bit value therefore holds the second latest, ties included, and
    combines map-side like any maximum, so a hot flow is never listed or sorted.
    """
    sides = [(bit, value) for bit in range(bits) for value in (0, 1)]

    def bit_of(number: Column, bit: int) -> Column:
        return F.shiftright(number, bit).bitwiseAND(F.lit(1).cast("long"))

    latest = [F.max(F.when(bit_of(F.col("seq"), bit) == value, F.col("ts_us"))).alias(f"side{bit}_{value}") for bit, value in sides]
    top = F.col("top.seq")
    others = [F.when(bit_of(top, bit) != value, F.col(f"side{bit}_{value}")) for bit, value in sides]
    # a block of one frame has no second latest
    return latest, F.greatest(*others) if others else F.lit(None).cast("long")


def block_summary(packets: DataFrame, scope: str, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per (scope, block, flow); frames outside flows share rows with a null flow key.

    All carry rows of a capture are made from it. Store it where several are needed, and
    the packets are read once for all of them.
    """
    bits = tcp_flag_bits()
    high = F.floor(F.col("ts_us") / F.lit(_SPLIT)).cast("long")
    sides, second = _second_latest(block_bits)
    return (
        with_flow_key(packets)
        .withColumn("_blk", block_of("seq", block_bits))
        .groupBy(scope, *FLOW_KEY, "_blk")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("frame_len").alias("bytes"),
            F.min("ts_us").alias("lo_us"),
            F.max(F.struct("ts_us", "seq")).alias("top"),
            F.min(F.struct("seq", "ts_us")).alias("start"),
            F.max(F.struct("seq", "ts_us")).alias("end"),
            F.sum(high).alias("high"),
            F.sum(F.col("ts_us") - high * _SPLIT).alias("low"),
            F.var_pop(F.col("ts_us").cast("double")).alias("var"),
            *[F.sum(bits[flag]).alias(flag) for flag in _FLAGS],
            *sides,
        )
        .select(
            scope,
            *FLOW_KEY,
            "_blk",
            "n",
            "bytes",
            "lo_us",
            F.col("top.ts_us").alias("hi_us"),
            second.alias("second_us"),
            F.col("start.seq").alias("first_seq"),
            F.col("start.ts_us").alias("first_us"),
            F.col("end.seq").alias("last_seq"),
            F.col("end.ts_us").alias("last_us"),
            "high",
            "low",
            "var",
            *_FLAGS,
        )
    )


def _in_flow(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("a_port").isNotNull())


def _flow_carry(summary: DataFrame, scope: str) -> DataFrame:
    keys = [scope, *FLOW_KEY]
    by_block = Window.partitionBy(*keys).orderBy("_blk")
    past = _before(by_block)
    blocks = _in_flow(summary).withColumns(
        {"base": F.first("first_us").over(_upto(by_block)), "before_us": F.max("hi_us").over(past)}
    )
    shift = _since(F.col("high"), F.col("low"), F.col("n"), F.col("base"))
    # Spread around the flow's first packet: within the block plus the block mean's offset.
    blocks = blocks.withColumns(
        {
            "s1": shift,
            "s2": F.col("n") * F.col("var") + shift * shift / F.col("n"),
            "second_us": F.greatest("second_us", _runner_up(F.col("hi_us"), F.col("before_us"))),
        }
    )
    sums = {"_n_flow": "n", "_bytes": "bytes", "_s1": "s1", "_s2": "s2"} | {f"_{f}": f for f in _FLAGS}
    return blocks.select(
        *keys,
        "_blk",
        *[F.sum(source).over(past).alias(name) for name, source in sums.items()],
        F.min("lo_us").over(past).alias("_lo_us"),
        F.max("hi_us").over(past).alias("_hi_us"),
        F.max("second_us").over(past).alias("_second_us"),
        F.col("base").alias("_base_us"),
    ).where(F.col("_n_flow").isNotNull())


def _runner_up(time: Column, before: Column) -> Column:
    """What a time adds to the second-largest so far: the smaller of it and the largest before."""
    return F.when(before.isNotNull(), F.least(time, before))


def running(
    packets: DataFrame,
    scope: str,
    kinds: Iterable[str] = ("scope", "flow"),
    *,
    bounded: bool = False,
    block_bits: int = BLOCK_BITS,
    summary: DataFrame | None = None,
) -> DataFrame:
    """Add running columns to IP/ARP frames, in ``seq`` order inside ``scope``.

    kinds: ``scope`` (rn, prev_us, first_us), ``src`` (src_seen), ``dst`` (dst_seen),
    ``flow`` (flow_n, flow_bytes, flow_min_us, flow_max_us, flow_second_us, flow_s1,
    flow_s2, flow_base_us and one counter per TCP flag). ``bounded=True`` says a scope
    is a small micro-batch, so no blocks are needed. ``summary`` is a stored
    ``block_summary`` of the same packets and block size.

    Rows follow ``seq``; times may arrive out of order (``flow_second_us`` is the second
    latest time of the flow so far, null on its first packet).
    """
    kinds = set(kinds)
    bits = tcp_flag_bits()
    frames = with_flow_key(packets).withColumns({f"_{flag}": bits[flag] for flag in _FLAGS})
    if bounded:
        rows = frames.withColumn(_FRAME, F.lit(1)).repartition(scope)
        part = [scope]
    else:
        frames = frames.withColumn("_blk", block_of("seq", block_bits))
        carries = []
        if "flow" in kinds and summary is None:
            summary = stored(block_summary(packets, scope, block_bits), "blocks")
        if "scope" in kinds:
            carries.append(_scope_carry(_one_row_each(frames, scope) if summary is None else summary, scope))
        if "src" in kinds:
            carries.append(_count_carry(frames, [scope, "src_ip"], "_n_src"))
        if "dst" in kinds:
            carries.append(_count_carry(frames, [scope, "dst_ip"], "_n_dst"))
        if "flow" in kinds:
            carries.append(_flow_carry(summary, scope))
        rows = reduce(
            lambda left, right: left.unionByName(right, allowMissingColumns=True),
            carries,
            frames.withColumn(_FRAME, F.lit(1)),
        )
        rows = rows.repartition(scope, "_blk") if summary is None else rows.repartition(_tasks(summary), scope, "_blk")
        part = [scope, "_blk"]

    def carried(name: str, own: Column) -> Column:
        """The carry row's value on carry rows, the frame's own value on frames."""
        if name not in rows.columns:
            return F.when(F.col(_FRAME) == 1, own)
        return F.when(F.col(_FRAME) == 1, own).otherwise(F.col(name))

    # Carry rows have no seq and sort first.
    order = F.col("seq").asc_nulls_first()
    out = rows
    if "scope" in kinds:
        by_scope = Window.partitionBy(*part).orderBy(order)
        out = out.withColumns(
            {
                "rn": F.sum(carried("_n_scope", F.lit(1))).over(_upto(by_scope)),
                "prev_us": F.last(carried("_last_us", F.col("ts_us")), ignorenulls=True).over(_before(by_scope)),
                "first_us": F.first(carried("_first_us", F.col("ts_us")), ignorenulls=True).over(_upto(by_scope)),
            }
        )
    for kind in ("src", "dst"):
        if kind in kinds:
            by_ip = Window.partitionBy(*part, f"{kind}_ip").orderBy(order)
            out = out.withColumn(f"{kind}_seen", F.sum(carried(f"_n_{kind}", F.lit(1))).over(_upto(by_ip)))
    if "flow" in kinds:
        by_flow = Window.partitionBy(*part, *FLOW_KEY).orderBy(order)
        run, past = _upto(by_flow), _before(by_flow)
        out = out.withColumn("flow_base_us", F.first(carried("_base_us", F.col("ts_us")), ignorenulls=True).over(run))
        out = out.withColumn("_before_us", F.max(carried("_hi_us", F.col("ts_us"))).over(past))
        runner_up = _runner_up(F.col("ts_us"), F.col("_before_us"))
        offset = (F.col("ts_us") - F.col("flow_base_us")).cast("double")
        out = out.withColumns(
            {
                "flow_n": F.sum(carried("_n_flow", F.lit(1))).over(run),
                "flow_bytes": F.sum(carried("_bytes", F.col("frame_len"))).over(run),
                "flow_min_us": F.min(carried("_lo_us", F.col("ts_us"))).over(run),
                "flow_max_us": F.max(carried("_hi_us", F.col("ts_us"))).over(run),
                "flow_second_us": F.max(carried("_second_us", runner_up)).over(run),
                "flow_s1": F.sum(carried("_s1", offset)).over(run),
                "flow_s2": F.sum(carried("_s2", offset * offset)).over(run),
                # frames and carry rows use the same per-flag column
                **{f"run_{flag}": F.sum(f"_{flag}").over(run) for flag in _FLAGS},
            }
        )
    internal = [c for c in out.columns if c.startswith("_") and c != "_blk"]
    return out.where(F.col(_FRAME) == 1).drop(*internal)


def _tasks(summary: DataFrame) -> int:
    """Tasks that a stored ``block_summary``'s frames are dealt to: as many more as there are more frames, so none grows with them."""
    total = summary.agg(F.sum("n")).first()[0] or 0
    return max(summary.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_FRAMES))


def earlier_rates(summary: DataFrame, scope: str) -> DataFrame:
    """``_carry_rate, _carry_drate``: the last known rates before each (scope, block).

    A flow's duration never shrinks, so the last packet with a rate in a block is the
    last packet of some flow there. The rows of ``block_summary`` are enough to know it;
    no packet is windowed for this.
    """
    keys = [scope, *FLOW_KEY]
    so_far = _upto(Window.partitionBy(*keys).orderBy("_blk"))
    blocks = (
        _in_flow(summary)
        .select(
            *keys,
            "_blk",
            F.col("last_seq").alias("at"),
            F.sum("n").over(so_far).cast("double").alias("n"),
            ((F.max("hi_us").over(so_far) - F.min("lo_us").over(so_far)).cast("double") / 1e6).alias("duration"),
        )
        .where(F.col("duration") > 0)
    )
    same_end = (F.col("a_ip") == F.col("b_ip")) & (F.col("a_port") == F.col("b_port"))
    rate = F.col("n") / F.col("duration")
    last = blocks.groupBy(scope, "_blk").agg(
        F.max_by(rate, F.col("at")).alias("rate"),
        F.max_by(F.when(same_end, rate).otherwise(0.0), F.col("at")).alias("drate"),
    )
    # Blocks without a rate take part, so the value reaches them too.
    every = summary.select(scope, "_blk").distinct()
    past = _before(Window.partitionBy(scope).orderBy("_blk"))
    return every.join(last, [scope, "_blk"], "left").select(
        scope,
        "_blk",
        F.last("rate", ignorenulls=True).over(past).alias("_carry_rate"),
        F.last("drate", ignorenulls=True).over(past).alias("_carry_drate"),
    )


def carry_last(frames: DataFrame, scope: str, values: dict[str, str], earlier: DataFrame) -> DataFrame:
    """Forward fill: for each ``source -> name``, the last non-null source up to each row.

    ``earlier`` holds ``_carry<source>`` per (scope, block): the value known before it.
    """
    run = _upto(Window.partitionBy(scope, "_blk").orderBy("seq"))
    local = frames.withColumns({f"_local{c}": F.last(c, ignorenulls=True).over(run) for c in values})
    return (
        local.join(earlier, [scope, "_blk"], "left")
        .withColumns({name: F.coalesce(f"_local{c}", f"_carry{c}") for c, name in values.items()})
        .drop(*[f"{side}{c}" for c in values for side in ("_local", "_carry")])
    )
