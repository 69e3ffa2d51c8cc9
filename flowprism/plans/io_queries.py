"""Registered queries: sources, sinks, the model store and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowprism.functions import events as E
from flowprism.functions import labels as L
from flowprism.functions import wire
from flowprism.operators import features, kinn, metrics
from flowprism.operators.flows import FLAG_COUNTERS
from flowprism.operators.scaling import fit_scaler
from flowprism.operators.split import encode_labels, fit_labels
from flowprism.plans.model_queries import SPLIT, _test_sql, fitted, train_test
from flowprism.plans.packet_queries import (
    EVENTS_SQL,
    KEYED,
    LABEL_SQL,
    WITH,
    R,
    _FLOW_DIGITS,
    _FLOW_OUT,
    _FLOW_RUN,
    _FLOW_WINDOWS,
    _RUN_COUNTERS,
    _feature_columns,
    _stage_sql,
    detections,
    ip_arp,
    realtime,
    rounded,
    tidy,
)
from flowprism.plans.registry import query, table
from flowprism.plans.table_queries import _MACRO, _MCC, _OVR, SCORED, scored
from flowprism.session import durable, scratch_path, stored
from flowprism.sources import tables
from flowprism.sources.packets import packets_from_events
from flowprism.streaming import pipeline

# ---- sources and sinks ----------------------------------------------------------------


@query("src_csv", f"select event_id, epoch_us(ts) as ts_us, user_id, event_type, {R('value')} as value, props from events")
def src_csv(spark, sf):
    path = scratch_path(spark, "csv")
    rows = table(spark, sf, "events")
    tables.write_features(rows, path, "csv")
    back = tables.read_csv(spark, path, rows.schema)
    return tidy(back.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "user_id", "event_type", "value", "props"))


_DECODED = """select seq, cast(eth_type as bigint) as eth_type, src_mac, dst_mac, coalesce(src_ip, '') as src_ip,
  coalesce(dst_ip, '') as dst_ip, cast(coalesce(src_port, -1) as bigint) as src_port, cast(coalesce(dst_port, -1) as bigint) as dst_port,
  cast(proto as bigint) as proto, cast(case when eth_type = 2054 then -1 else ttl end as bigint) as ttl,
  cast(frame_len as bigint) as frame_len, cast(coalesce(tcp_flags, -1) as bigint) as tcp_flags from frames"""


def _wire_columns(decoded: DataFrame) -> DataFrame:
    gaps = {c: F.coalesce(c, F.lit("")) for c in ("src_ip", "dst_ip")}
    gaps |= {c: F.coalesce(c, F.lit(-1)) for c in ("src_port", "dst_port", "ttl", "tcp_flags")}
    names = ["seq", "eth_type", "src_mac", "dst_mac", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "ttl", "frame_len", "tcp_flags"]
    return tidy(decoded.withColumns(gaps).select(*names))


def raw_frames(spark, sf) -> DataFrame:
    """Frames as a stored table, which is what decoding reads."""
    return durable(wire.encode_frames(ip_arp(spark, sf)).select("seq", "frame"))


@query("decode_frames", f"{WITH} {_DECODED}")
def decode_frames(spark, sf):
    return _wire_columns(wire.decode_frames(raw_frames(spark, sf)))


@query("drop_malformed", f"{WITH} select seq from frames where seq % 50 <> 0")
def drop_malformed(spark, sf):
    """Every fiftieth frame is cut to ten bytes."""
    cut = F.when(F.col("seq") % 50 == 0, F.substring("frame", 1, 10)).otherwise(F.col("frame"))
    return wire.drop_malformed(raw_frames(spark, sf).withColumn("frame", cut)).select("seq")


_CAPTURED = f"{WITH} select day_id, count(*) as frames, cast(sum(frame_len) as bigint) as bytes from frames group by day_id"


def _captured(spark, sf, **options) -> DataFrame:
    from flowprism.sources.captures import read_packets

    path = scratch_path(spark, "captures")
    write_captures(wire.encode_frames(ip_arp(spark, sf)), path)
    name = F.regexp_extract("capture_id", "day-([0-9]+)", 1).cast("bigint")
    return (
        read_packets(spark, path, "*.pcap", **options)
        .groupBy(name.alias("day_id"))
        .agg(F.count(F.lit(1)).alias("frames"), F.sum("frame_len").alias("bytes"))
    )


@query("src_captures", _CAPTURED)
def src_captures(spark, sf):
    """Frames are written as rotated capture files of each day, then read back."""
    return _captured(spark, sf)


@query("src_captures_pieces", _CAPTURED)
def src_captures_pieces(spark, sf):
    """The same files, each read by a task for every 16 KB."""
    return _captured(spark, sf, piece_bytes=16 << 10)


def write_captures(frames: DataFrame, path: str) -> None:
    """Rotated files (day, 65,536 frame numbers each), written by the tasks in frame order.

    A file gets its name once it is whole, so a task that runs twice leaves one file.
    """
    import struct
    import uuid

    def save(batches):
        import pandas as pd
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        system.create_dir(root)
        out, current, total = None, None, 0
        unfinished = f"{root}/{uuid.uuid4().hex}.part"

        def finish():
            if out is not None:
                out.close()
                system.move(unfinished, f"{root}/{current}.pcap")

        for batch in batches:
            names = "day-" + batch["day_id"].astype(str) + "-part-" + batch["part"].astype(str)
            for name, ts_us, frame in zip(names, batch["ts_us"], batch["frame"], strict=True):
                if name != current:
                    finish()
                    out, current = system.open_output_stream(unfinished), name
                    out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
                out.write(struct.pack("<IIII", ts_us // 1_000_000, ts_us % 1_000_000, len(frame), len(frame)) + bytes(frame))
                total += 1
        finish()
        yield pd.DataFrame({"n": [total]})

    parts = frames.select("day_id", F.shiftright("seq", 16).alias("part"), "seq", "ts_us", "frame")
    sorted_frames = parts.repartition("day_id", "part").sortWithinPartitions("day_id", "part", "seq")
    sorted_frames.mapInPandas(save, "n bigint").agg(F.sum("n")).collect()


@query("sink_features", f"{WITH} select batch_id, count(*) as n, cast(sum(frame_len) as bigint) as bytes from frames group by batch_id")
def sink_features(spark, sf):
    path = scratch_path(spark, "features")
    tables.write_features(realtime(spark, sf), path, "csv")
    schema = tables.feature_schema(["batch_id", "seq", *features.REALTIME_COLUMNS])
    back = tables.read_csv(spark, path, schema)
    counts = back.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("Tot size").alias("bytes"))
    return counts.select(F.col("batch_id").cast("bigint").alias("batch_id"), "n", "bytes")


@query("sink_dataset", f"{WITH} select {LABEL_SQL} as label, count(*) as n from frames group by {LABEL_SQL}")
def sink_dataset(spark, sf):
    path = scratch_path(spark, "dataset")
    tables.write_dataset(ip_arp(spark, sf).withColumn("label", L.label_mask()), path)
    return spark.read.parquet(path).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def event_table(spark, sf) -> DataFrame:
    return E.format_events(detections(spark, sf))


@query("sink_events_json", f"{EVENTS_SQL} select seq, event_id, timestamp, source_ip, event_type, confidence from event")
def sink_events_json(spark, sf):
    path = scratch_path(spark, "events")
    tables.write_events_json(event_table(spark, sf), path)
    schema = "seq bigint, event_id string, timestamp string, source_ip string, event_type string, confidence double"
    return spark.read.schema(schema).json(path)


@query(
    "sink_daily_index",
    f"""{EVENTS_SQL} select concat('nids-logs-', strftime(make_timestamp(ts_us), '%Y.%m.%d')) as index_name, count(*) as n
    from event group by strftime(make_timestamp(ts_us), '%Y.%m.%d')""",
)
def sink_daily_index(spark, sf):
    path = scratch_path(spark, "index")
    tables.write_daily_index(event_table(spark, sf), path)
    days = spark.read.parquet(path).groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))
    return days.select(tables.index_name(F.col("event_date")).alias("index_name"), "n")


@query(
    "enforce_event_schema",
    f"""{EVENTS_SQL} select seq, case when seq % 3 = 0 then ts_us // 1000000 * 1000000 when seq % 3 = 1 then ts_us else ts_us // 1000 * 1000 end as detected_us,
      source_port, {R("confidence")} as confidence from event""",
)
def enforce_event_schema(spark, sf):
    """Detection times arrive in the three accepted forms."""
    moment = F.col("timestamp")
    loose = event_table(spark, sf).withColumns(
        {
            "detection_time": F.when(F.col("seq") % 3 == 0, F.col("detection_time"))
            .when(F.col("seq") % 3 == 1, E.iso_utc(moment))
            .otherwise(F.floor(F.unix_micros(moment) / 1000).cast("string")),
            "source_port": F.col("source_port").cast("string"),
            "confidence": F.col("confidence").cast("string"),
        }
    )
    typed = E.enforce_event_schema(loose)
    return tidy(
        typed.select("seq", F.unix_micros("detection_time").alias("detected_us"), "source_port", rounded(F.col("confidence").cast("double"), 4).alias("confidence"))
    )


@query(
    "model_store",
    f"with {SPLIT}, {_test_sql('rbf')} select i as id, cast(class as bigint) as pred from ranked where pos = 1",
)
def model_store(spark, sf):
    """Fit, save, load, predict."""
    train, test = train_test(spark, sf)
    path = scratch_path(spark, "model")
    tables.save_model(fitted(spark, sf, train=train), fit_scaler(train, "standard"), fit_labels(train, "class"), path)
    model, _, _ = tables.load_model(spark, path)
    return tidy(kinn.predict_supervised(model, test, compat="nearest"))


_MEASURES = ["mcc", "acc", "tpr_macro", "fpr", "ppv_macro", "f1_macro"]


@query(
    "sink_results",
    f"""{SCORED} select m.mcc, o.acc, p.tpr_macro, o.fpr, p.ppv_macro, p.f1_macro
    from ({_MCC.format(R("(c * s - pt) / (sqrt(s * s - pp) * sqrt(s * s - tt))"))}) m,
      (select {_OVR}) o, (select {_MACRO}) p""",
)
def sink_results(spark, sf):
    """The measures of a run as an experiment table: written, then read back."""
    path = scratch_path(spark, "results")
    tables.write_results(metrics.evaluate(scored(spark, sf)), path)
    back = spark.read.schema(", ".join(f"{c} double" for c in _MEASURES)).csv(path, header=True)
    return tidy(back)


# ---- streams --------------------------------------------------------------------------


def packet_stream(spark, sf) -> DataFrame:
    """The events table read as a stream and turned into packets."""
    schema = table(spark, sf, "events").schema
    return packets_from_events(spark, pipeline.read_packet_stream(spark, f"{sf}/events*.parquet", schema))


def cut_stream(spark, sf) -> DataFrame:
    """The packets as a stream of three micro-batches whose borders fall inside batches of 100."""
    path, pieces, files = scratch_path(spark, "cut"), 3, 4
    events = table(spark, sf, "events")
    last = events.agg(F.max("event_id")).first()[0] or 0
    for piece in range(pieces):
        borders = [(last + 1) * k // pieces + 37 for k in (piece, piece + 1)]
        low = F.lit(True) if piece == 0 else F.col("event_id") >= borders[0]
        high = F.lit(True) if piece == pieces - 1 else F.col("event_id") < borders[1]
        events.where(low & high).repartition(files).write.mode("append").parquet(path)
    return packets_from_events(spark, pipeline.read_packet_stream(spark, path, events.schema, max_files=files))


def _collected(spark, stream: DataFrame) -> DataFrame:
    """Run a bounded stream into files and read what it wrote."""
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "state")
    writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
    pipeline.finish(writer.option("checkpointLocation", state).trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(out)


@query("src_packet_stream", f"{WITH} select batch_id, count(*) as n from packets group by batch_id")
def src_packet_stream(spark, sf):
    rows = _collected(spark, packet_stream(spark, sf).select("batch_id", "seq"))
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


def _live_sql(names: list[str]) -> str:
    start = KEYED.replace("with packets", "with recursive packets", 1) + _stage_sql("batch_id", True)
    columns = _feature_columns(True)
    return f"{start} select batch_id, seq, " + ", ".join(f'{columns[n]} as "{n}"' for n in names) + " from feature"


_LIVE = ["Tot sum", "Number", "IAT", "Rate", "flow_byte", "Weight", "Radius"]


@query("stream_microbatch", _live_sql(_LIVE))
def stream_microbatch(spark, sf):
    """Three micro-batches cut inside batches of 100: what is incomplete waits for the next."""
    out = scratch_path(spark, "live")
    whole = pipeline.WholeBatches(pipeline.feature_batches(out), scratch_path(spark, "waiting"))
    pipeline.finish(pipeline.start(cut_stream(spark, sf), whole, scratch_path(spark, "state")))
    whole.flush(spark)
    return tidy(spark.read.parquet(out).select("batch_id", "seq", *_LIVE))


_STATE_OUT = [*_FLOW_OUT, *FLAG_COUNTERS]


@query(
    "stream_flow_state",
    f"""{KEYED}, flow_state as (select seq, {_FLOW_RUN},
      {R("coalesce(count(*) over w / nullif((max(ts_us) over w - min(ts_us) over w) / 1e6, 0), 0)")} as "Rate", {_RUN_COUNTERS}
    from keyed {_FLOW_WINDOWS})
    select f.seq, {", ".join(f"f.{c}" for c in _FLOW_OUT)}, f."Rate",
      {", ".join(f"cast(case when k.proto = 6 then f.{c} else 0 end as bigint) as {c}" for c in FLAG_COUNTERS)}
    from flow_state f join keyed k on f.seq = k.seq""",
)
def stream_flow_state(spark, sf):
    from flowprism.functions.packet import filter_ip_arp

    stream = filter_ip_arp(cut_stream(spark, sf))
    return tidy(_collected(spark, pipeline.flow_state(stream, "day_id", "30 days")).select("seq", "Rate", *_STATE_OUT), _FLOW_DIGITS)


_NESTED = ["flow_byte", "Rate", "syn_flag_number", "Duration", "TCP"]
# One training row in ten.
_EVERY = 10


def _detect_sql() -> str:
    start = KEYED.replace("with packets", "with recursive packets", 1) + _stage_sql("batch_id", True)
    columns = _feature_columns(True)
    inputs = ", ".join(f"cast(coalesce({columns[n]}, 0) as double)" for n in features.MODEL_COLUMNS)
    detected = EVENTS_SQL[EVENTS_SQL.index(", detections as") : EVENTS_SQL.index(", clean as")].replace("detections as", "labelled as", 1)
    events = EVENTS_SQL[EVENTS_SQL.index(", clean as") :]
    square = "list_dot_product({0}, {0})"
    return f"""{start}{detected}, vec as materialized (select seq, [cast(row_number() over (partition by batch_id order by seq) as double), {inputs}] as x,
      {", ".join(f'{R(f"coalesce({columns[n]}, 0)")} as "{n}"' for n in _NESTED)} from feature),
    lg as (select seq, unnest(generate_series(1, len(x))) as pos, unnest(x) as value from vec),
    st as (select pos, avg(value) as a, stddev_pop(value) as s from lg where seq % {_EVERY} = 0 group by pos),
    sc as materialized (select seq, list((value - a) / case when s = 0 then 1 else s end order by pos) as x from lg join st using (pos) group by seq),
    tr as materialized (select sc.seq, x, {square.format("x")} as q, l.label from sc join labelled l on l.seq = sc.seq where sc.seq % {_EVERY} = 0),
    te as materialized (select seq, x, {square.format("x")} as q from sc),
    predicted as (select te.seq, arg_min(tr.label, {{'d': round(sqrt(greatest(te.q - 2 * list_dot_product(te.x, tr.x) + tr.q, 0)), 6), 'j': tr.seq}}) as label from te, tr group by te.seq),
    detections as (select f.*, p.label from frames f join predicted p on p.seq = f.seq){events}
    select e.seq, e.event_type, e.network_zone, e.confidence, {", ".join(f'v."{n}"' for n in _NESTED)} from event e join vec v on v.seq = e.seq"""


@query("stream_detect", _detect_sql())
def stream_detect(spark, sf):
    """A detector in the stream: fitted on packet vectors, saved, loaded, asked for every streamed packet."""
    path, out = scratch_path(spark, "detector"), scratch_path(spark, "detect")
    chosen = features.model_vector(features.select_model_features(realtime(spark, sf), "batch_id"))
    named = detections(spark, sf).where(F.col("seq") % _EVERY == 0).select("batch_id", "seq", "label")
    train = stored(chosen.select("batch_id", "seq", "vector").join(named, ["batch_id", "seq"]), "train")
    encoder = stored(fit_labels(train), "encoder")
    scaler = fit_scaler(train, "standard")
    rows = scaler.transform(encode_labels(train, encoder)).select(F.col("seq").alias("id"), F.col("code").alias("class"), "vector")
    tables.save_model(kinn.fit(rows, 3, kernel="euclidean", digits=6), scaler, encoder, path)
    predict = pipeline.model_predictor(*tables.load_model(spark, path))
    run = pipeline.start(packet_stream(spark, sf), pipeline.detection_batches(predict, out), scratch_path(spark, "state"))
    pipeline.finish(run)
    found = spark.read.parquet(out)
    return tidy(found.select("seq", "event_type", "network_zone", "confidence", *[F.col(f"features.{c}").alias(c) for c in _NESTED]))


def event_stream(spark, sf) -> DataFrame:
    rows = packet_stream(spark, sf).where(F.col("eth_type").isin(2048, 2054)).withColumn("label", L.label_mask())
    label = F.when(F.col("seq") % 97 == 0, "XMAS").when(F.col("label") == L.BENIGN, L.NORMAL).otherwise(F.col("label"))
    return E.format_events(rows.withColumn("label", label))


@query("stream_events_sink", f"{EVENTS_SQL} select seq, event_id, event_type, strftime(make_timestamp(ts_us), '%Y.%m.%d') as event_date from event")
def stream_events_sink(spark, sf):
    out = scratch_path(spark, "sink")
    pipeline.finish(pipeline.event_sink(event_stream(spark, sf), out, scratch_path(spark, "state")))
    back = spark.read.schema("seq bigint, event_id string, event_type string, event_date string").json(out)
    return back.select("seq", "event_id", "event_type", "event_date")


@query("stream_event_stats", f"{EVENTS_SQL} select batch_id, event_type, count(*) as n from event group by batch_id, event_type")
def stream_event_stats(spark, sf):
    out = scratch_path(spark, "stats")
    pipeline.finish(pipeline.start(event_stream(spark, sf), pipeline.event_stats_batches(out), scratch_path(spark, "state")))
    return tidy(pipeline.read_event_stats(spark, out))


@query(
    "stream_time_histogram",
    f"""{EVENTS_SQL}, b as (select ts_us // 3600000000 * 3600000000 as bucket_us, event_type, count(*) as n from event group by 1, 2)
    select bucket_us, event_type, n from b where bucket_us + 3600000000 <= (select max(ts_us) // 1000 * 1000 - 600000000 from event)""",
)
def stream_time_histogram(spark, sf):
    """Append mode: only windows the watermark has passed are written."""
    return _collected(spark, pipeline.time_histogram(event_stream(spark, sf)))


@query("stream_bounded", f"{WITH} select cast(least(count(*), 500) as bigint) as n from packets")
def stream_bounded(spark, sf):
    """The capture's packet limit: the run stops by itself."""
    rows = _collected(spark, pipeline.bounded(packet_stream(spark, sf).select("seq"), 500))
    return rows.agg(F.count(F.lit(1)).alias("n"))
