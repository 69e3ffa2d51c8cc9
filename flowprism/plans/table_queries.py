"""Registered queries: joins, aggregates, dashboards, set operations and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowprism.functions import events as E
from flowprism.functions import labels as L
from flowprism.functions import packet as P
from flowprism.operators import aggregates, dashboards, joins, metrics
from flowprism.plans.packet_queries import (
    DETECTED,
    EVENTS_SQL,
    IP,
    LABEL_SQL,
    WITH,
    R,
    detections,
    ip_arp,
    labelled,
    packets,
    tidy,
)
from flowprism.plans.packet_queries import _LABELLED as LABELLED
from flowprism.plans.packet_queries import _TOUCH as TOUCH
from flowprism.plans.registry import query, table

# ---- joins ----------------------------------------------------------------------------


@query(
    "label_join",
    f"""{DETECTED}, m(label, event) as (values {", ".join(f"('{k}', '{v}')" for k, v in E.EVENT_TEXT.items())})
    select d.seq, d.label, coalesce(m.event, 'Unknown event') as event from detections d left join m on d.label = m.label""",
)
def label_join(spark, sf):
    return joins.label_join(detections(spark, sf).select("seq", "label"))


# The topology's networks: three /24 zones inside, one /8 outside.
NETWORKS = {"192.168.20.0/24": "LAN", "192.168.30.0/24": "SERVER", "192.168.40.0/24": "DMZ", "10.45.172.150/8": "WAN"}


@query(
    "zone_join",
    f"""{WITH} select seq, coalesce(src_ip, '') as src_ip, case when src_ip like '192.168.20.%' then 'LAN'
      when src_ip like '192.168.30.%' then 'SERVER' when src_ip like '192.168.40.%' then 'DMZ'
      when src_ip like '10.%' then 'WAN' else 'Unknown' end as zone from frames""",
)
def zone_join(spark, sf):
    rows = ip_arp(spark, sf).select("seq", "src_ip")
    out = joins.zone_join(rows, joins.zone_table(spark, NETWORKS), "src_ip")
    return out.select("seq", F.coalesce("src_ip", F.lit("")).alias("src_ip"), "zone")


def attackers(spark) -> DataFrame:
    return spark.createDataFrame([(L.ATTACKER_INSIDE,), (L.ATTACKER_OUTSIDE,)], "mac string")


@query(
    "attacker_semi_join",
    f"""{WITH} select seq, 'attack' as side from frames where {TOUCH}
    union all select seq, 'benign' from frames where not {TOUCH}""",
)
def attacker_semi_join(spark, sf):
    rows = ip_arp(spark, sf)
    attack = joins.attacker_rows(rows, attackers(spark)).select("seq", F.lit("attack").alias("side"))
    rest = joins.attacker_rows(rows, attackers(spark), complement=True).select("seq", F.lit("benign").alias("side"))
    return attack.unionByName(rest)


SEGMENTS = """segments as (select case day_id % 3 when 0 then 'benign' when 1 then 'in-tcp' else 'in-udp' end as name,
    1704067200000000 + day_id * 86400000000 as start_us, 1704067200000000 + day_id * 86400000000 + 64800000000 as end_us
    from (select distinct day_id from packets) d)"""


def segments(spark, sf) -> DataFrame:
    """One capture segment of 18 hours per day seen."""
    start = F.lit(1704067200000000) + F.col("day_id") * F.lit(86400000000)
    name = F.when(F.col("day_id") % 3 == 0, "benign").when(F.col("day_id") % 3 == 1, "in-tcp").otherwise("in-udp")
    days = packets(spark, sf).select("day_id").distinct()
    return days.select(name.alias("name"), start.alias("start_us"), (start + F.lit(64800000000)).alias("end_us"))


@query(
    "segment_range_join",
    f"""{WITH}, {SEGMENTS} select p.seq, coalesce(s.name, 'none') as name from packets p
    left join segments s on p.ts_us between s.start_us and s.end_us""",
)
def segment_range_join(spark, sf):
    out = joins.segment_range_join(packets(spark, sf).select("seq", "ts_us"), segments(spark, sf))
    return out.select("seq", F.coalesce("name", F.lit("none")).alias("name"))


# Scans of the inside and of the outside network, each with its own attacker; user 4 plays the outside one.
_SWAP = "case when {0} = '00:0c:29:00:00:04' then '" + L.ATTACKER_OUTSIDE + "' else {0} end"
_BY_SEGMENT = "case when name is null then null when {0} and proto = 6 then 'TCP' when {0} and proto = 17 then 'UDP' when {0} and proto = 1 then 'ICMP' when {0} and proto = 0 then 'ARP' else 'benign' end"


@query(
    "label_masks_by_segment",
    f"""{WITH}, {SEGMENTS.replace("'in-udp'", "'out-tcp'")},
    attacker(of, mac) as (values ('in-tcp', '{L.ATTACKER_INSIDE}'), ('out-tcp', '{L.ATTACKER_OUTSIDE}')),
    swapped as (select seq, ts_us, proto, {_SWAP.format("src_mac")} as src, {_SWAP.format("dst_mac")} as dst from frames),
    placed as (select p.*, s.name, a.mac from swapped p left join segments s on p.ts_us between s.start_us and s.end_us left join attacker a on a.of = s.name)
    select seq, coalesce(name, 'none') as name, coalesce({_BY_SEGMENT.format("coalesce(mac in (src, dst), false)")}, 'none') as label from placed""",
)
def label_masks_by_segment(spark, sf):
    zone = F.regexp_replace("name", "^in-udp$", "out-tcp")
    outside = lambda c: F.when(F.col(c) == "00:0c:29:00:00:04", L.ATTACKER_OUTSIDE).otherwise(F.col(c))
    rows = ip_arp(spark, sf).withColumns({c: outside(c) for c in ("src_mac", "dst_mac")})
    found = spark.createDataFrame([("in-tcp", L.ATTACKER_INSIDE), ("out-tcp", L.ATTACKER_OUTSIDE)], "name string, mac string")
    out = joins.label_by_segment(rows, segments(spark, sf).withColumn("name", zone), found)
    return out.select("seq", F.coalesce("name", F.lit("none")).alias("name"), F.coalesce("label", F.lit("none")).alias("label"))


@query(
    "positional_zip",
    f"""{DETECTED} select batch_id, seq, coalesce(src_ip, '0.0.0.0') as src_ip, coalesce(dst_ip, '0.0.0.0') as dst_ip, label
    from detections""",
)
def positional_zip(spark, sf):
    rows = ip_arp(spark, sf).select(
        "batch_id",
        "seq",
        F.coalesce("src_ip", F.lit(E.NO_ADDRESS)).alias("src_ip"),
        F.coalesce("dst_ip", F.lit(E.NO_ADDRESS)).alias("dst_ip"),
    )
    return joins.positional_zip(rows, detections(spark, sf).select("batch_id", "seq", "label"))


# ---- aggregates -----------------------------------------------------------------------


def _ends_sql(select: str, where: str, columns: tuple[str, str], name: str, keep: str = "") -> str:
    keep_c = f"{keep}, " if keep else ""
    one = f"select {keep_c}'src' as side, {columns[0]} as {name} from f where {where}"
    two = f"select {keep_c}'dst' as side, {columns[1]} as {name} from f where {where}"
    return f"{WITH}, f as (select *, {_PROTO} as protocol from frames), ends as ({one} union all {two}) {select}"


_PROTO = "case proto when 0 then 'IP' when 1 then 'ICMP' when 2 then 'IGMP' when 6 then 'TCP' when 17 then 'UDP' else 'Unknown for now' end"
_IPS, _PORTS = ("src_ip", "dst_ip"), ("src_port", "dst_port")


@query(
    "wellknown_port_connections",
    _ends_sql(
        "select side, ip, count(*) as n from ends group by side, ip",
        f"{IP} and (src_port between 1 and 1023 or dst_port between 1 and 1023)",
        _IPS,
        "ip",
    ),
)
def wellknown_port_connections(spark, sf):
    return aggregates.wellknown_port_connections(ip_arp(spark, sf))


@query(
    "proto_ip_counts",
    _ends_sql("select protocol, side, ip, count(*) as n from ends group by protocol, side, ip", IP, _IPS, "ip", "protocol"),
)
def proto_ip_counts(spark, sf):
    return aggregates.proto_ip_counts(ip_arp(spark, sf))


@query(
    "proto_port_counts",
    _ends_sql(
        """select protocol, side, cast(coalesce(port, -1) as bigint) as port,
        case when side = 'dst' then 1 else count(*) end as n from ends group by protocol, side, port""",
        IP,
        _PORTS,
        "port",
        "protocol",
    ),
)
def proto_port_counts(spark, sf):
    counts = aggregates.proto_port_counts(ip_arp(spark, sf))
    return tidy(counts.withColumn("port", F.coalesce("port", F.lit(-1))))


@query(
    "proto_avg_rate",
    _ends_sql(
        f"""select protocol, side, ip, n, {R("n / (select sum(cast(ts_us as double)) / 1e6 from packets) * 1e9")} as rate_nano
        from (select protocol, side, ip, count(*) as n from ends group by protocol, side, ip) c""",
        IP,
        _IPS,
        "ip",
        "protocol",
    ),
)
def proto_avg_rate(spark, sf):
    rates = aggregates.proto_avg_rate(packets(spark, sf))
    return tidy(rates.select("protocol", "side", "ip", "n", (F.col("rate") * 1e9).alias("rate_nano")))


@query(
    "packets_per_protocol",
    f"""{WITH}, f as (select {_PROTO} as protocol from frames where {IP})
    select protocol, count(*) as n from f group by protocol union all select 'total', count(*) from f""",
)
def packets_per_protocol(spark, sf):
    return aggregates.packets_per_protocol(ip_arp(spark, sf))


@query(
    "dst_port_counts",
    f"{WITH} select cast(coalesce(dst_port, -1) as bigint) as dst_port, count(*) as n from frames where {IP} group by coalesce(dst_port, -1)",
)
def dst_port_counts(spark, sf):
    return tidy(aggregates.dst_port_counts(ip_arp(spark, sf)))


@query("unique_ips", _ends_sql("select ip, count(*) as n from ends group by ip", IP, _IPS, "ip"))
def unique_ips(spark, sf):
    return aggregates.unique_ips(ip_arp(spark, sf))


@query("label_counts", f"{LABELLED} select label, count(*) as n from labelled group by label")
def label_counts(spark, sf):
    return aggregates.label_counts(labelled(spark, sf))


@query(
    "class_countplot",
    "select source as class, count(*) as n from documents group by source",
)
def class_countplot(spark, sf):
    return aggregates.label_counts(table(spark, sf, "documents").select(F.col("source").alias("class")), "class")


@query(
    "mask_counts",
    f"""{WITH} select count(*) filter (where {TOUCH} and proto = 0) as arp_mask, count(*) filter (where {TOUCH} and proto = 1) as icmp_mask,
    count(*) filter (where {TOUCH} and proto = 6) as tcp_mask, count(*) filter (where {TOUCH} and proto = 17) as udp_mask from frames""",
)
def mask_counts(spark, sf):
    return aggregates.mask_counts(ip_arp(spark, sf), L.ATTACKER_INSIDE)


@query(
    "ttl_histogram",
    f"""{WITH}, t as (select {LABEL_SQL} as label, case when {IP} then ttl else 0 end as ttl from frames),
    s as (select label, min(ttl) as a, max(ttl) as b from t group by label),
    r as (select label, case when a = b then a - 0.5 else a end as lo, case when a = b then b + 0.5 else b end as hi from s)
    select t.label, cast(least(floor((ttl - lo) / (hi - lo) * 30), 29) as bigint) as bin, count(*) as n,
      {R("any_value(lo)")} as lo, {R("any_value(hi)")} as hi from t join r on t.label = r.label
    group by t.label, least(floor((ttl - lo) / (hi - lo) * 30), 29)""",
)
def ttl_histogram(spark, sf):
    ttl = F.when(P.is_ip(), F.col("ttl")).otherwise(0)
    rows = ip_arp(spark, sf).select(L.label_mask().alias("label"), ttl.alias("ttl"))
    return tidy(aggregates.value_histogram(rows, "label", "ttl"))


_PROFILED = {name: "bigint" for name in ("seq", "batch_id", "day_id", "ts_us")}
_PROFILED |= {name: "string" for name in ("src_mac", "dst_mac", "src_ip", "dst_ip")}
_PROFILED |= {name: "int" for name in ("eth_type", "src_port", "dst_port", "proto", "ttl", "frame_len", "tcp_flags")}


@query(
    "null_profile",
    WITH + " union all ".join(
        f""" select '{c}' as "column", '{t}' as type, count({c}) as non_nulls, count(*) - count({c}) as nulls from packets"""
        for c, t in _PROFILED.items()
    ),
)
def null_profile(spark, sf):
    return aggregates.null_profile(packets(spark, sf).select(*_PROFILED))


@query("class_sizes", "select cast(label as bigint) as label, count(*) as n from embeddings group by label")
def class_sizes(spark, sf):
    return tidy(aggregates.label_counts(table(spark, sf, "embeddings").select("label")))


# ---- dashboards -----------------------------------------------------------------------


def event_table(spark, sf) -> DataFrame:
    return E.format_events(detections(spark, sf))


_WIDTH = 43200 * 1_000_000
_BUCKET = f"ts_us // {_WIDTH} * {_WIDTH}"


@query(
    "event_counts",
    f"""{EVENTS_SQL}, types(event_type) as (values {", ".join(f"('{v}')" for v in E.EVENT_TEXT.values())}, ('Unknown'))
    select t.event_type, count(e.seq) as n from types t
    left join event e on t.event_type = case when e.event_type = 'Unknown event' then 'Unknown' else e.event_type end
    group by t.event_type""",
)
def event_counts(spark, sf):
    return dashboards.event_counts(event_table(spark, sf))


@query(
    "dash_events_over_time",
    f"""{EVENTS_SQL}, top as (select event_type from event group by event_type order by count(*) desc, event_type limit 5)
    select {_BUCKET} as bucket_us, event_type, count(*) as n from event
    where event_type in (select event_type from top) group by {_BUCKET}, event_type""",
)
def dash_events_over_time(spark, sf):
    return dashboards.events_over_time(event_table(spark, sf))


def _terms(name: str, field: str) -> None:
    sql = f"{EVENTS_SQL} select {field}, count(*) as n from event group by {field} order by n desc, {field} limit 10"

    @query(name, sql)
    def terms(spark, sf):
        return dashboards.top_terms(event_table(spark, sf), field)


_terms("dash_terms_event_type", "event_type")
_terms("dash_terms_protocol", "protocol")
_terms("dash_terms_source_ip", "source_ip")
_terms("dash_terms_dest_ip", "destination_ip")


@query(
    "dash_label_over_time",
    f"""{EVENTS_SQL}, c as (select {_BUCKET} as bucket_us, original_label, count(*) as n from event group by {_BUCKET}, original_label),
    b as (select unnest(generate_series((select min(bucket_us) from c), (select max(bucket_us) from c), {_WIDTH})) as bucket_us),
    l as (select distinct original_label from c)
    select b.bucket_us, l.original_label, coalesce(c.n, 0) as n from b join l on true
    left join c on c.bucket_us = b.bucket_us and c.original_label = l.original_label""",
)
def dash_label_over_time(spark, sf):
    return dashboards.label_over_time(event_table(spark, sf))


@query(
    "dash_last_confidence",
    f"{EVENTS_SQL} select {_BUCKET} as bucket_us, arg_max(confidence, ts_us) as confidence from event group by {_BUCKET}",
)
def dash_last_confidence(spark, sf):
    return dashboards.last_confidence(event_table(spark, sf))


@query(
    "recent_events",
    f"""{EVENTS_SQL} select timestamp, event_id, event_type, source_ip, source_port, destination_ip, destination_port,
      protocol, network_zone, confidence from event order by ts_us desc, event_id limit 500""",
)
def recent_events(spark, sf):
    rows = dashboards.recent_events(event_table(spark, sf))
    return tidy(rows.withColumn("timestamp", E.iso_utc(F.col("timestamp"))))


# ---- sort, limit and set operations ---------------------------------------------------


@query("sort_classes", f"{LABELLED} select label, seq from labelled order by label, seq")
def sort_classes(spark, sf):
    return labelled(spark, sf).select("label", "seq").orderBy("label", "seq")


@query("distinct_classes", f"{LABELLED} select distinct label from labelled order by label")
def distinct_classes(spark, sf):
    return labelled(spark, sf).select("label").distinct().orderBy("label")


@query(
    "isin_mask",
    f"{LABELLED} select seq, cast(label in ('TCP', 'UDP') as bigint) as dropped from labelled",
)
def isin_mask(spark, sf):
    return tidy(labelled(spark, sf).select("seq", F.col("label").isin("TCP", "UDP").alias("dropped")))


@query(
    "union_captures",
    f"""{WITH}, {SEGMENTS}, parts as (select p.seq, coalesce(s.name, 'none') as source, p.* exclude (seq) from packets p
      left join segments s on p.ts_us between s.start_us and s.end_us)
    select seq, source, case when source = 'benign' then 'benign' else {LABEL_SQL} end as label from parts where source <> 'none'""",
)
def union_captures(spark, sf):
    """The labelled dataset: the benign capture as one constant label, scans by mask."""
    placed = joins.segment_range_join(packets(spark, sf), segments(spark, sf))
    parts = {"benign": placed.where(F.col("name") == "benign").withColumn("label", F.lit(L.BENIGN))}
    for name in ("in-tcp", "in-udp"):
        parts[name] = placed.where(F.col("name") == name).withColumn("label", L.label_mask())
    return joins.union_captures(parts).select("seq", "source", "label")


# ---- metrics --------------------------------------------------------------------------

SCORED = f"""{LABELLED}, scored as (select label as truth, case when seq % 7 = 0 then 'TCP' when seq % 11 = 0 then '0_normal'
  when seq % 13 = 0 then 'XMAS' else label end as pred from labelled),
 cells as (select truth, pred, count(*) as n from scored group by truth, pred),
 labels as (select distinct truth as label from scored),
 grid as (select a.label as truth, b.label as pred, coalesce(c.n, 0) as n from labels a join labels b on true
   left join cells c on c.truth = a.label and c.pred = b.label),
 seen as (select label from labels union select pred from cells),
 classes as (select s.label, coalesce(sum(n) filter (where truth = s.label), 0) as support,
     coalesce(sum(n) filter (where pred = s.label), 0) as predicted,
     coalesce(sum(n) filter (where truth = s.label and pred = s.label), 0) as tp
   from seen s join cells on true group by s.label),
 prf as (select *, coalesce(tp / nullif(predicted, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall,
     coalesce(2 * tp / nullif(support + predicted, 0), 0) as f1 from classes),
 ovr as (select l.label, sum(n) filter (where truth = l.label and pred = l.label) as tp,
     sum(n) filter (where truth <> l.label and pred = l.label) as fp,
     sum(n) filter (where truth = l.label and pred <> l.label) as fn,
     sum(n) filter (where truth <> l.label and pred <> l.label) as tn from labels l join grid on true group by l.label)"""


def scored(spark, sf) -> DataFrame:
    seq = F.col("seq")
    pred = F.when(seq % 7 == 0, "TCP").when(seq % 11 == 0, L.NORMAL).when(seq % 13 == 0, "XMAS")
    return labelled(spark, sf).select(F.col("label").alias("truth"), pred.otherwise(F.col("label")).alias("pred"))


@query("confusion_matrix", f"{SCORED} select truth, pred, cast(n as bigint) as n from grid")
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(scored(spark, sf))


@query(
    "confusion_normalised",
    f"""{SCORED}, a as (select sum(n) filter (where truth = pred) / sum(n) as accuracy from grid)
    select truth, pred, cast(n as bigint) as n, {R("n * 100.0 / sum(n) over (partition by truth)")} as percent,
      {R("accuracy")} as accuracy, {R("1 - accuracy")} as misclass from grid join a on true""",
)
def confusion_normalised(spark, sf):
    return tidy(metrics.confusion_normalised(scored(spark, sf)))


_OVR = f"""{R("(sum(tp) + sum(tn)) * 100.0 / (sum(tp) + sum(fp) + sum(fn) + sum(tn))")} as acc,
      {R("sum(fp) * 100.0 / (sum(fp) + sum(tn))")} as fpr from ovr"""


@query("ovr_metrics", f"{SCORED} select {_OVR}")
def ovr_metrics(spark, sf):
    return tidy(metrics.ovr_metrics(scored(spark, sf)))


_MACRO = f"""{R("avg(recall) * 100")} as tpr_macro, {R("avg(precision) * 100")} as ppv_macro,
      {R("avg(f1) * 100")} as f1_macro from prf"""


@query("macro_prf", f"{SCORED} select {_MACRO}")
def macro_prf(spark, sf):
    return tidy(metrics.macro_prf(scored(spark, sf)))


_MCC = """select {0} as mcc from (select cast(sum(tp) as double) as c, cast(sum(support) as double) as s,
  sum(cast(support as double) * predicted) as pt, sum(cast(predicted as double) * predicted) as pp,
  sum(cast(support as double) * support) as tt from classes) x"""


@query("mcc", f"{SCORED} " + _MCC.format(R("(c * s - pt) / (sqrt(s * s - pp) * sqrt(s * s - tt))")))
def mcc(spark, sf):
    return tidy(metrics.mcc(scored(spark, sf)))


@query(
    "classification_report",
    f"""{SCORED}, t as (select sum(support) as total, sum(tp) / sum(support) as acc from classes)
    select label, {R("precision")} as precision, {R("recall")} as recall, {R("f1")} as f1, cast(support as bigint) as support from prf
    union all select 'accuracy', {R("acc")}, {R("acc")}, {R("acc")}, cast(total as bigint) from t
    union all select 'macro avg', {R("avg(precision)")}, {R("avg(recall)")}, {R("avg(f1)")}, cast(sum(support) as bigint) from prf
    union all select 'weighted avg', {R("sum(precision * support) / sum(support)")}, {R("sum(recall * support) / sum(support)")},
      {R("sum(f1 * support) / sum(support)")}, cast(sum(support) as bigint) from prf""",
)
def classification_report(spark, sf):
    return tidy(metrics.classification_report(scored(spark, sf)))


@query(
    "ndr_auc",
    f"""{SCORED} select {R("tpr")} as ndr, {R("(tpr + tnr) / 2")} as auc from (select
      sum(n) filter (where truth = 'UDP' and pred = 'UDP') / sum(n) filter (where truth = 'UDP') as tpr,
      sum(n) filter (where truth <> 'UDP' and pred <> 'UDP') / sum(n) filter (where truth <> 'UDP') as tnr from cells) x""",
)
def ndr_auc(spark, sf):
    return tidy(metrics.ndr_auc(scored(spark, sf), "UDP"))


@query(
    "label_accuracy",
    f"{SCORED} select {R('''sum(n) filter (where truth = 'ICMP' and pred = 'ICMP') / sum(n) filter (where truth = 'ICMP')''')} as accuracy from cells",
)
def label_accuracy(spark, sf):
    return tidy(metrics.label_accuracy(scored(spark, sf), "ICMP"))
