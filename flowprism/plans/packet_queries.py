"""Registered queries over packets: projections, flows, frames, the feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowprism.functions import events as E
from flowprism.functions import labels as L
from flowprism.functions import packet as P
from flowprism.operators import features, flows, frames
from flowprism.operators.ordered import block_summary, earlier_rates, running
from flowprism.plans.registry import query, table
from flowprism.session import stored
from flowprism.sources.packets import ORACLE_WITH, packets_from_events

WITH = ORACLE_WITH
IP = "eth_type = 2048"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(spark, table(spark, sf_dir, "events"))


def ip_arp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.filter_ip_arp(packets(spark, sf_dir))


# Moves exact halves off the rounding boundary, where the two engines' last bits may differ.
NUDGE = 1e-9


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double") + F.lit(NUDGE), digits) + F.lit(0.0)


def R(expression: str, digits: int = 6) -> str:
    return f"(round(cast({expression} as double) + {NUDGE}, {digits}) + 0.0)"


def tidy(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Integers as bigint and doubles rounded, so both engines print the same."""
    digits = digits or {}
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            column = rounded(column, digits.get(field.name, 6))
        columns.append(column.alias(field.name))
    return df.select(*columns)


# ---- projections and predicates -------------------------------------------------------


@query("filter_ip_arp", f"{WITH} select seq, cast(eth_type as bigint) as eth_type from frames")
def filter_ip_arp(spark, sf):
    return tidy(ip_arp(spark, sf).select("seq", "eth_type"))


@query(
    "protocol_name",
    f"""{WITH} select seq, case proto when 0 then 'IP' when 1 then 'ICMP' when 2 then 'IGMP' when 6 then 'TCP'
    when 17 then 'UDP' else 'Unknown for now' end as protocol_name from frames""",
)
def protocol_name(spark, sf):
    return ip_arp(spark, sf).select("seq", P.protocol_name().alias("protocol_name"))


def _port_sql(port: int) -> str:
    return f"(coalesce(src_port, -1) = {port} or coalesce(dst_port, -1) = {port})"


_FLAG_SQL = ", ".join(f'cast({_port_sql(p)} as bigint) as "{n}"' for n, p in P.SERVICE_PORTS.items())


@query("app_flags", f"{WITH} select seq, {_FLAG_SQL} from frames")
def app_flags(spark, sf):
    return tidy(ip_arp(spark, sf).select("seq", *[c.alias(n) for n, c in P.app_flags().items()]))


def _scoped_flags() -> dict[str, str]:
    limits = {n: IP for n in P.SERVICES_ANY_IP}
    limits |= {n: f"{IP} and proto = 6" for n in P.SERVICES_TCP} | {n: f"{IP} and proto = 17" for n in P.SERVICES_UDP}
    flags = {n: f"cast({limit} and {_port_sql(P.SERVICE_PORTS[n])} as bigint)" for n, limit in limits.items()}
    dhcp = "(coalesce(src_port, -1) = 67 or coalesce(dst_port, -1) = 68)"
    return flags | {"DHCP": f"cast({IP} and proto = 17 and {dhcp} as bigint)"}


def named(columns: dict[str, str]) -> str:
    return ", ".join(f'{expression} as "{name}"' for name, expression in columns.items())


@query("app_flags_scope", f"{WITH} select seq, {named(_scoped_flags())} from frames")
def app_flags_scope(spark, sf):
    return tidy(ip_arp(spark, sf).select("seq", *[c.alias(n) for n, c in P.app_flags_scoped().items()]))


@query(
    "dhcp_flag",
    f"""{WITH} select seq, cast(coalesce(src_port, -1) = 67 or coalesce(dst_port, -1) = 68 as bigint) as dhcp
    from (select seq, case when src_port = 53 then 67 else src_port end as src_port,
                 case when dst_port = 53 then 68 else dst_port end as dst_port from frames) x""",
)
def dhcp_flag(spark, sf):
    def moved(side: str, port: int) -> Column:
        return F.when(F.col(side) == 53, port).otherwise(F.col(side)).alias(side)

    ports = ip_arp(spark, sf).select("seq", moved("src_port", 67), moved("dst_port", 68))
    return tidy(ports.select("seq", P.dhcp_flag().alias("dhcp")))


_L3 = {
    "TCP": f"cast({IP} and proto = 6 as bigint)",
    "UDP": f"cast({IP} and proto = 17 as bigint)",
    "ICMP": f"cast({IP} and proto = 1 as bigint)",
    "IGMP": f"cast({IP} and proto = 2 as bigint)",
    "IPv": f"cast({IP} as bigint)",
    "ARP": "cast(eth_type = 2054 as bigint)",
}


@query("l3_flags", f"{WITH} select seq, {named(_L3)} from frames")
def l3_flags(spark, sf):
    return tidy(ip_arp(spark, sf).select("seq", *[c.alias(n) for n, c in P.l3_flags().items()]))


@query("const_flags", f'{WITH} select seq, cast({IP} as bigint) as "LLC", cast({IP} as bigint) as "MAC" from frames')
def const_flags(spark, sf):
    return tidy(ip_arp(spark, sf).select("seq", *[c.alias(n) for n, c in P.const_flags().items()]))


_ZERO = ("DS status", "Fragments", "Sequence number", "Protocol Version", "RARP")


@query(
    "unreachable_zero_cols",
    f"{WITH} select seq, " + ", ".join(f'cast(0 as bigint) as "{n}"' for n in _ZERO) + " from frames",
)
def unreachable_zero_cols(spark, sf):
    return tidy(ip_arp(spark, sf).select("seq", *[c.alias(n) for n, c in P.zero_columns().items()]))


def _bit_sql(flag: str) -> str:
    return f"cast(proto = 6 and {IP} and (coalesce(tcp_flags, 0) & {P.TCP_FLAG_MASKS[flag]}) <> 0 as bigint)"


@query("tcp_flag_bits", f"{WITH} select seq, " + ", ".join(f"{_bit_sql(f)} as {f}" for f in P.TCP_FLAG_MASKS) + " from frames")
def tcp_flag_bits(spark, sf):
    return tidy(ip_arp(spark, sf).select("seq", *[c.alias(n) for n, c in P.tcp_flag_bits().items()]))


KEYED = f"""{WITH}, keyed as (select *,
  case when fw then src_ip else dst_ip end as a_ip, case when fw then src_port else dst_port end as a_port,
  case when fw then dst_ip else src_ip end as b_ip, case when fw then dst_port else src_port end as b_port
  from (select *, (src_ip, src_port) <= (dst_ip, dst_port) as fw from frames
        where {IP} and proto in (6, 17)) k)"""
KEYS = "proto, a_ip, a_port, b_ip, b_port"
# The key with integer widths both engines print alike.
KEYS_OUT = "cast(proto as bigint) as proto, a_ip, cast(a_port as bigint) as a_port, b_ip, cast(b_port as bigint) as b_port"


@query("flow_key", f"{KEYED} select seq, {KEYS_OUT}, cast(fw as bigint) as is_forward from keyed")
def flow_key(spark, sf):
    return tidy(flows.flow_frames(ip_arp(spark, sf)).select("seq", *P.FLOW_KEY, "is_forward"))


@query("ttl_duration", f"""{WITH} select seq, cast(case when {IP} then ttl else 0 end as bigint) as "Duration" from frames""")
def ttl_duration(spark, sf):
    duration = F.when(P.is_ip(), F.col("ttl")).otherwise(0)
    return tidy(ip_arp(spark, sf).select("seq", duration.alias("Duration")))


_RUN = "partition by {scope}, " + KEYS + " order by seq rows between unbounded preceding and current row"


@query(
    "safe_rate",
    f"""{KEYED}, r as (select seq, count(*) over w as n, (max(ts_us) over w - min(ts_us) over w) / 1e6 as d
      from keyed window w as ({_RUN.format(scope="batch_id")}))
    select seq, n as packets, {R("case when d <> 0 then n / d end")} as rate from r""",
)
def safe_rate(spark, sf):
    state = flows.flow_running(ip_arp(spark, sf), "batch_id", bounded=True)
    return tidy(
        state.select("seq", F.col("flow_n").alias("packets"), P.safe_rate(F.col("flow_n"), F.nullif("flow_duration", F.lit(0.0))).alias("rate"))
    )


# ---- flows ----------------------------------------------------------------------------

ANCHOR = flows.ANCHOR_US


@query(
    "flow_summary",
    f"""{KEYED}, ranked as (select *, row_number() over (partition by day_id, {KEYS} order by ts_us desc, seq desc) as back from keyed)
    select day_id, {KEYS_OUT}, count(*) as packets, cast(sum(frame_len) as bigint) as flow_byte,
      {R("(max(ts_us) - min(ts_us)) / 1e6")} as flow_duration, {R("max(ts_us) / 1e6")} as max_duration,
      {R("min(ts_us) / 1e6")} as min_duration, {R("sum(cast(ts_us as hugeint)) / 1e6", 2)} as sum_duration,
      {R(f"avg(ts_us - {ANCHOR}) / 1e6 + {ANCHOR} / 1e6", 3)} as average_duration,
      {R(f"stddev_pop(ts_us - {ANCHOR}) / 1e6", 3)} as std_duration,
      {R("case when count(*) = 1 then max(ts_us) else max(ts_us) - max(case when back = 2 then ts_us end) end / 1e6")} as flow_idle_time,
      {R("(max(ts_us) - min(ts_us)) / 1e6")} as flow_active_time
    from ranked group by day_id, {KEYS}""",
)
def flow_summary(spark, sf):
    digits = {"sum_duration": 2, "average_duration": 3, "std_duration": 3}
    return tidy(flows.flow_summary(ip_arp(spark, sf), "day_id"), digits)


@query(
    "flow_direction_totals",
    f"""{KEYED} select day_id, {KEYS_OUT}, count(*) filter (where fw) as ab_pkt, count(*) filter (where not fw) as ba_pkt,
      cast(sum(case when fw then frame_len else 0 end) as bigint) as ab_byte,
      cast(sum(case when fw then 0 else frame_len end) as bigint) as ba_byte,
      count(*) as src_to_dst_pkt, cast(sum(frame_len) as bigint) as src_to_dst_byte,
      cast(0 as bigint) as dst_to_src_pkt, cast(0 as bigint) as dst_to_src_byte
    from keyed group by day_id, {KEYS}""",
)
def flow_direction_totals(spark, sf):
    return tidy(flows.flow_direction_totals(ip_arp(spark, sf), "day_id"))


_ENDS = "src_ip, src_port, dst_ip, dst_port"


@query(
    "reverse_flow_join",
    f"""{KEYED}, t as (select day_id, proto, {_ENDS}, count(*) as pkt, cast(sum(frame_len) as bigint) as byte
      from keyed group by day_id, proto, {_ENDS})
    select a.day_id, cast(a.proto as bigint) as proto, a.src_ip, cast(a.src_port as bigint) as src_port, a.dst_ip,
      cast(a.dst_port as bigint) as dst_port, a.pkt, a.byte,
      coalesce(b.pkt, 0) as reverse_pkt, coalesce(b.byte, 0) as reverse_byte
    from t a left join t b on a.day_id = b.day_id and a.proto = b.proto and a.src_ip = b.dst_ip
      and a.src_port = b.dst_port and a.dst_ip = b.src_ip and a.dst_port = b.src_port""",
)
def reverse_flow_join(spark, sf):
    return tidy(flows.reverse_flow_totals(ip_arp(spark, sf), "day_id"))


_COUNTERS = ", ".join(f"cast(sum({_bit_sql(flag)}) as bigint) as {name}" for name, flag in flows.FLAG_COUNTERS.items())


@query("flow_flag_counts", f"{KEYED} select day_id, {KEYS_OUT}, {_COUNTERS} from keyed where proto = 6 group by day_id, {KEYS}")
def flow_flag_counts(spark, sf):
    return tidy(flows.flow_flag_counts(ip_arp(spark, sf), "day_id"))


_FLOW_RUN = f"""count(*) over w as flow_n, cast(sum(frame_len) over w as bigint) as flow_byte,
      {R("(max(ts_us) over w - min(ts_us) over w) / 1e6")} as flow_duration,
      {R("max(ts_us) over w / 1e6")} as max_duration, {R("min(ts_us) over w / 1e6")} as min_duration,
      {R("sum(cast(ts_us as hugeint)) over w / 1e6", 2)} as sum_duration,
      {R(f"avg(ts_us - {ANCHOR}) over w / 1e6 + {ANCHOR} / 1e6", 3)} as average_duration,
      {R(f"stddev_pop(ts_us - {ANCHOR}) over w / 1e6", 3)} as std_duration,
      {R("(ts_us - coalesce(lag(ts_us) over w0, 0)) / 1e6")} as flow_idle_time"""
_FLOW_WINDOWS = "window w as ({run}), w0 as ({run0})".format(
    run=_RUN.format(scope="day_id"), run0=f"partition by day_id, {KEYS} order by seq"
)
_FLOW_OUT = ["flow_n", "flow_byte", "flow_duration", "max_duration", "min_duration", "sum_duration",
             "average_duration", "std_duration", "flow_idle_time"]
_FLOW_DIGITS = {"sum_duration": 2, "average_duration": 3, "std_duration": 3}


@query("flow_running", f"{KEYED} select seq, {_FLOW_RUN} from keyed {_FLOW_WINDOWS}")
def flow_running(spark, sf):
    return tidy(flows.flow_running(ip_arp(spark, sf), "day_id").select("seq", *_FLOW_OUT), _FLOW_DIGITS)


_MIXED = "ts_us + seq * 7919 % 13 * 21600000000"


@query(
    "flow_running_unordered",
    f"""{KEYED}, mixed as (select * replace ({_MIXED} as ts_us) from keyed)
    select seq, {_FLOW_RUN.replace("coalesce(lag(ts_us) over w0, 0)", "coalesce(list_reverse_sort(list(ts_us) over w)[2], 0)").replace("(ts_us - coalesce", "(max(ts_us) over w - coalesce")}
    from mixed {_FLOW_WINDOWS}""",
)
def flow_running_unordered(spark, sf):
    """Times jump by up to three days between frames; blocks of 256 frames."""
    mixed = ip_arp(spark, sf).withColumn("ts_us", F.expr(_MIXED))
    return tidy(flows.flow_running(mixed, "day_id", block_bits=8).select("seq", *_FLOW_OUT), _FLOW_DIGITS)


_RUN_COUNTERS = ", ".join(
    f"cast(sum({_bit_sql(flag)}) over w as bigint) as {name}" for name, flag in flows.FLAG_COUNTERS.items()
)


@query(
    "flow_flags_running",
    f"{KEYED} select seq, {_RUN_COUNTERS} from keyed where proto = 6 window w as ({_RUN.format(scope='day_id')})",
)
def flow_flags_running(spark, sf):
    tcp = ip_arp(spark, sf).where(P.is_proto(6))
    return tidy(flows.flow_running(tcp, "day_id").select("seq", *flows.FLAG_COUNTERS))


@query(
    "flow_idle",
    f"{KEYED} select seq, {R('(ts_us - coalesce(lag(ts_us) over w0, 0)) / 1e6')} as flow_idle_time from keyed {_FLOW_WINDOWS}",
)
def flow_idle(spark, sf):
    return tidy(flows.flow_running(ip_arp(spark, sf), "day_id").select("seq", "flow_idle_time"))


# ---- ordered features -----------------------------------------------------------------


@query(
    "iat_batch",
    f"{WITH} select seq, {R('(ts_us - coalesce(lag(ts_us) over (partition by day_id order by seq), 0)) / 1e6')} as iat from frames",
)
def iat_batch(spark, sf):
    state = running(ip_arp(spark, sf), "day_id", ["scope"])
    return tidy(state.select("seq", features.iat_batch().alias("iat")))


@query(
    "iat_realtime",
    f"{WITH} select seq, {R('(ts_us - first_value(ts_us) over (partition by batch_id order by seq)) / 1e6')} as iat from frames",
)
def iat_realtime(spark, sf):
    state = running(ip_arp(spark, sf), "batch_id", ["scope"], bounded=True)
    return tidy(state.select("seq", features.iat_realtime().alias("iat")))


@query(
    "batch_of_100",
    f"""{WITH} select day_id, cast(floor((row_number() over (partition by day_id order by seq) - 1) / 100) as bigint) as batch,
      seq from packets""",
)
def batch_of_100(spark, sf):
    ranked = running(packets(spark, sf), "day_id", ["scope"])
    return frames.with_frame_group(ranked, 100).select("day_id", F.col("grp").alias("batch"), "seq")


@query(
    "row_number_feature",
    f"{WITH} select batch_id, seq, row_number() over (partition by batch_id order by seq) as row_number from frames",
)
def row_number_feature(spark, sf):
    return running(ip_arp(spark, sf), "batch_id", ["scope"], bounded=True).select(
        "batch_id", "seq", F.col("rn").alias("row_number")
    )


@query(
    "ip_packet_counts",
    f"""{WITH} select seq, count(*) over (partition by day_id, src_ip order by seq) as src_ip_bytes,
      count(*) over (partition by day_id, dst_ip order by seq) as dst_ip_bytes from frames where {IP}""",
)
def ip_packet_counts(spark, sf):
    ip = packets(spark, sf).where(P.is_ip())
    return running(ip, "day_id", ["src", "dst"]).select(
        "seq", F.col("src_seen").alias("src_ip_bytes"), F.col("dst_seen").alias("dst_ip_bytes")
    )


@query(
    "src_dst_packet_counts",
    f"""{WITH} select seq, count(*) over (partition by batch_id, src_ip order by seq) as src_pkts,
      count(*) over (partition by batch_id, dst_ip order by seq) as dst_pkts from frames where {IP}""",
)
def src_dst_packet_counts(spark, sf):
    ip = packets(spark, sf).where(P.is_ip())
    return running(ip, "batch_id", ["src", "dst"], bounded=True).select(
        "seq", F.col("src_seen").alias("src_pkts"), F.col("dst_seen").alias("dst_pkts")
    )


def _stage_sql(scope: str, live: bool) -> str:
    """CTEs of the feature table: order, flow state, rates, groups, direction, streams."""
    moves = IP if live else "true"
    rate_kept = "rate" if live else "last_value(rate ignore nulls) over (partition by c.{0} order by c.seq rows between unbounded preceding and current row)".format(scope)
    run = f"partition by {scope}, grp order by pos rows between unbounded preceding and current row"
    return f""", flow_state as (
      select seq, {_FLOW_RUN.replace("flow_n,", "flow_n, count(*) over w / nullif((max(ts_us) over w - min(ts_us) over w) / 1e6, 0) as rate,", 1)},
        {_RUN_COUNTERS}
      from keyed window w as ({_RUN.format(scope=scope)}), w0 as (partition by {scope}, {KEYS} order by seq)),
    ordered as (select f.*, row_number() over s as rn, lag(ts_us) over s as prev_us, first_value(ts_us) over s as first_us
      from frames f window s as (partition by {scope} order by seq)),
    grouped as (select *, (rn - 1) // 20 as grp, (rn - 1) % 20 + 1 as pos, {moves} as moves,
      coalesce(src_ip, '') as fs, coalesce(dst_ip, '') as fd from ordered),
    fold as (
      select {scope} as sc, grp, pos, case when moves then false end as outgoing,
        case when moves then [{{'s': fs, 'd': fd}}] else [] end as state from grouped where pos = 1
      union all
      select sc, grp, pos, case when moves then o end as outgoing,
        case when moves and not o then list_concat([{{'s': fs, 'd': fd}}], state) else state end as state
      from (select f.sc, f.grp, g.pos, g.moves, g.fs, g.fd, f.state,
              coalesce(list_filter(f.state, lambda e: e.s = g.fd)[1].d = g.fs, false) as o
            from fold f join grouped g on g.{scope} = f.sc and g.grp = f.grp and g.pos = f.pos + 1) n),
    streams as (select g.*, f.outgoing,
        count(*) filter (where not f.outgoing) over w as n_in, count(*) filter (where f.outgoing) over w as n_out,
        coalesce(avg(frame_len) filter (where not f.outgoing) over w, 0) as m_in,
        coalesce(avg(frame_len) filter (where f.outgoing) over w, 0) as m_out,
        coalesce(var_pop(frame_len) filter (where not f.outgoing) over w, 0) as v_in,
        coalesce(var_pop(frame_len) filter (where f.outgoing) over w, 0) as v_out,
        list(cast(frame_len as double)) filter (where not f.outgoing) over w as l_in,
        list(cast(frame_len as double)) filter (where f.outgoing) over w as l_out,
        cast(sum(frame_len) over w as bigint) as tot_sum, min(frame_len) over w as len_min, max(frame_len) over w as len_max,
        avg(frame_len) over w as len_avg, stddev_pop(frame_len) over w as len_std
      from grouped g join fold f on g.{scope} = f.sc and g.grp = f.grp and g.pos = f.pos
      window w as ({run.replace("partition by " + scope + ", grp order by pos", "partition by g." + scope + ", g.grp order by g.pos")})),
    crossed as (select *, coalesce(list_sum(list_transform(list_zip(l_in, l_out), lambda z: (z[1] - m_in) * (z[2] - m_out))), 0) as cross_sum
      from streams),
    feature as (select c.*, s.* exclude (seq, rate), {rate_kept} as rate_kept
      from crossed c left join flow_state s on c.seq = s.seq)"""


_PAIRED = "n_in = n_out and n_out >= 2 and v_in <> 0 and v_out <> 0"


def _feature_columns(live: bool) -> dict[str, str]:
    """Output expression of every feature column over the ``feature`` CTE."""
    def big(e: str) -> str:
        return f"cast({e} as bigint)"

    def stream(e: str) -> str:
        return R(f"case when outgoing is null then 0 else {e} end")

    arp_ip = "'0'" if live else "null"
    cols = {
        "ts": R("ts_us / 1e6"),
        "flow_duration": "coalesce(flow_duration, 0.0)",
        "flow_byte": big("coalesce(flow_byte, 0)"),
        "src_mac": "src_mac",
        "dst_mac": "dst_mac",
        "src_ip": f"case when eth_type = 2054 then {arp_ip} else src_ip end",
        "dst_ip": f"case when eth_type = 2054 then {arp_ip} else dst_ip end",
        "src_port": big("case when eth_type = 2054 then 0 else src_port end"),
        "dst_port": big("case when eth_type = 2054 then 0 else dst_port end"),
        "Protocol Type": big("case when eth_type = 2054 then 0 else proto end"),
        "Duration": big("case when eth_type = 2054 then 0 else ttl end"),
        "Rate": R("coalesce(rate_kept, 0)"),
        "Srate": R("coalesce(rate_kept, 0)"),
        "Drate": "cast(0 as double)",
    }
    cols |= {f"{flag}_flag_number": _bit_sql(flag) for flag in P.TCP_FLAG_MASKS}
    cols |= {name: big(f"case when proto = 6 and {IP} then coalesce({name}, 0) else 0 end") for name in flows.FLAG_COUNTERS}
    cols |= {c: f"coalesce({c}, 0.0)" for c in _FLOW_OUT[3:]}
    cols["flow_active_time"] = "coalesce(flow_duration, 0.0)"
    cols |= _scoped_flags() | _L3
    cols |= {"LLC": big(IP), "MAC": big(IP)}
    cols |= {
        "Tot sum": big("tot_sum"), "Min": big("len_min"), "Max": big("len_max"), "AVG": R("len_avg"), "Std": R("len_std"),
        "Tot size": big("frame_len"), "Number": big("pos"),
        "IAT": R("(ts_us - first_us) / 1e6") if live else R("(ts_us - coalesce(prev_us, 0)) / 1e6"),
        "Magnitue": stream("sqrt(m_in + m_out)"), "Radius": stream("sqrt(v_in + v_out)"),
        "Variance": stream("case when v_out <> 0 then v_in / v_out else 0 end"),
        "Weight": big("case when outgoing is null then 0 else n_in * n_out end"),
        "Covariance": stream("cross_sum / n_in"),
        "Correlation": stream(f"case when {_PAIRED} then cross_sum / n_in / sqrt(v_in * v_out) else 0 end"),
    }
    cols |= {n: "cast(0 as bigint)" for n in _ZERO}
    return cols


def _feature_sql(scope: str, live: bool, names: list[str], where: str = "true") -> str:
    start = KEYED.replace("with packets", "with recursive packets", 1) + _stage_sql(scope, live)
    columns = _feature_columns(live)
    picked = ", ".join(f'{columns[n]} as "{n}"' for n in names)
    return f"{start} select {scope}, seq, {picked} from feature where {where}"


def grouped(spark, sf, scope: str, bounded: bool, columns: list[str]) -> DataFrame:
    state = running(ip_arp(spark, sf), scope, ["scope"], bounded=bounded)
    return frames.with_frame_group(state).select(scope, "grp", "seq", "Number", *columns)


_F20 = ["Tot sum", "Min", "Max", "AVG", "Std", "Tot size", "Number"]


@query("frame20_stats", _feature_sql("day_id", False, _F20))
def frame20_stats(spark, sf):
    stats = frames.frame20_stats(grouped(spark, sf, "day_id", False, ["frame_len"]), "day_id")
    return tidy(stats.select("day_id", "seq", *_F20))


_FOLD_IN = ["eth_type", "src_ip", "dst_ip", "frame_len"]


@query(
    "direction_fold",
    KEYED.replace("with packets", "with recursive packets", 1)
    + _stage_sql("day_id", False)
    + " select day_id, seq, grp, cast(outgoing as bigint) as outgoing from feature",
)
def direction_fold(spark, sf):
    directed = frames.direction_fold(grouped(spark, sf, "day_id", False, _FOLD_IN), "day_id")
    return tidy(directed.select("day_id", "seq", "grp", "outgoing"))


@query(
    "direction_fold_realtime",
    KEYED.replace("with packets", "with recursive packets", 1)
    + _stage_sql("batch_id", True)
    + " select batch_id, seq, grp, coalesce(cast(outgoing as bigint), -1) as outgoing from feature",
)
def direction_fold_realtime(spark, sf):
    directed = frames.direction_fold(grouped(spark, sf, "batch_id", True, _FOLD_IN), "batch_id", arp_moves=False)
    return tidy(directed.select("batch_id", "seq", "grp", F.coalesce(F.col("outgoing").cast("int"), F.lit(-1)).alias("outgoing")))


def _streams(spark, sf, names: list[str]) -> DataFrame:
    directed = frames.direction_fold(grouped(spark, sf, "day_id", False, _FOLD_IN), "day_id")
    return tidy(frames.two_stream_stats(directed, "day_id").select("day_id", "seq", *names))


_TWO = ["Magnitue", "Radius", "Variance", "Weight"]


@query("two_stream_stats", _feature_sql("day_id", False, _TWO))
def two_stream_stats(spark, sf):
    return _streams(spark, sf, _TWO)


@query("two_stream_cov_corr", _feature_sql("day_id", False, ["Covariance", "Correlation"]))
def two_stream_cov_corr(spark, sf):
    return _streams(spark, sf, ["Covariance", "Correlation"])


@query("rate_carry_forward", _feature_sql("day_id", False, ["Rate", "Srate", "Drate"]))
def rate_carry_forward(spark, sf):
    rows = ip_arp(spark, sf)
    summary = stored(block_summary(rows, "day_id"), "blocks")
    state = flows.with_flow_features(running(rows, "day_id", ["flow"], summary=summary))
    return tidy(flows.rate_carry_forward(state, "day_id", earlier_rates(summary, "day_id")).select("day_id", "seq", "Rate", "Srate", "Drate"))


_DIGITS = _FLOW_DIGITS


@query("extract_features_batch", _feature_sql("day_id", False, features.BATCH_COLUMNS))
def extract_features_batch(spark, sf):
    return tidy(features.extract_features(packets(spark, sf), "batch", "day_id"), _DIGITS)


@query("extract_features_blocks", _feature_sql("day_id", False, features.BATCH_COLUMNS))
def extract_features_blocks(spark, sf):
    """Blocks of 32 frames, so what earlier blocks hand on decides most rows."""
    return tidy(features.extract_features(packets(spark, sf), "batch", "day_id", block_bits=5), _DIGITS)


def realtime(spark, sf) -> DataFrame:
    return features.extract_features(packets(spark, sf), "realtime", "batch_id")


@query("extract_features_realtime", _feature_sql("batch_id", True, features.REALTIME_COLUMNS))
def extract_features_realtime(spark, sf):
    return tidy(realtime(spark, sf), _DIGITS)


def _model_sql() -> str:
    start = KEYED.replace("with packets", "with recursive packets", 1) + _stage_sql("batch_id", True)
    columns = _feature_columns(True)
    picked = ", ".join(f'{R(f"coalesce({columns[n]}, 0)")} as "{n}"' for n in features.MODEL_COLUMNS)
    number = "row_number() over (partition by batch_id order by seq) as row_number"
    return f"{start} select batch_id, seq, {number}, {picked} from feature"


@query("select_model_features", _model_sql())
def select_model_features(spark, sf):
    return tidy(features.select_model_features(realtime(spark, sf), "batch_id"))


# ---- events and labels ----------------------------------------------------------------

_ZONE_SQL = "case " + " ".join(f"when {{0}} like '{p}%' then '{z}'" for p, z in E.ZONES.items()) + " else 'Unknown' end"


@query(
    "zone_of_ip",
    f"{WITH} select seq, {_ZONE_SQL.format('src_ip')} as src_zone, {_ZONE_SQL.format('dst_ip')} as dst_zone from frames",
)
def zone_of_ip(spark, sf):
    return ip_arp(spark, sf).select("seq", E.zone_of_ip("src_ip").alias("src_zone"), E.zone_of_ip("dst_ip").alias("dst_zone"))


_TOUCH = f"(src_mac = '{L.ATTACKER_INSIDE}' or dst_mac = '{L.ATTACKER_INSIDE}')"
LABEL_SQL = f"""case when {_TOUCH} and proto = 6 then 'TCP' when {_TOUCH} and proto = 17 then 'UDP'
  when {_TOUCH} and proto = 1 then 'ICMP' when {_TOUCH} and proto = 0 then 'ARP' else 'benign' end"""


@query("label_masks", f"{WITH} select seq, {LABEL_SQL} as label from frames")
def label_masks(spark, sf):
    return ip_arp(spark, sf).select("seq", L.label_mask().alias("label"))


@query("label_constant", f"{WITH} select seq, 'benign' as label from frames")
def label_constant(spark, sf):
    return ip_arp(spark, sf).select("seq", F.lit(L.BENIGN).alias("label"))


# Detections: the mask label with the normal class name, and one class the mapping does not know.
DETECTED = f"""{WITH}, detections as (select *, case when seq % 97 = 0 then 'XMAS'
  when {LABEL_SQL} = 'benign' then '0_normal' else {LABEL_SQL} end as label from frames)"""


def detections(spark, sf) -> DataFrame:
    masked = ip_arp(spark, sf).withColumn("label", L.label_mask())
    return masked.withColumn(
        "label",
        F.when(F.col("seq") % 97 == 0, "XMAS").when(F.col("label") == L.BENIGN, L.NORMAL).otherwise(F.col("label")),
    )


_EVENT_SQL = "case label " + " ".join(f"when '{k}' then '{v}'" for k, v in E.EVENT_TEXT.items()) + " else 'Unknown event' end"
_KNOWN_SQL = "label in (" + ", ".join(f"'{k}'" for k in E.EVENT_TEXT) + ")"


@query("event_mapping", f"{DETECTED} select seq, {_EVENT_SQL} as event from detections")
def event_mapping(spark, sf):
    return detections(spark, sf).select("seq", E.event_text("label").alias("event"))


@query("event_confidence", f"{DETECTED} select seq, cast(case when {_KNOWN_SQL} then 0.95 else 0.5 end as double) as confidence from detections")
def event_confidence(spark, sf):
    return detections(spark, sf).select("seq", E.event_confidence(E.event_text("label")).alias("confidence"))


@query("event_protocol", f"{DETECTED} select seq, case when {_KNOWN_SQL} then label else 'Unknown' end as protocol from detections")
def event_protocol(spark, sf):
    return detections(spark, sf).select("seq", E.event_protocol("label").alias("protocol"))


_CLEAN = "case when {0} is null or {0} = '' or regexp_matches({0}, '^[0-9]+$') then '0.0.0.0' else {0} end"
EVENTS_SQL = f"""{DETECTED}, clean as (select *, {_CLEAN.format('src_ip')} as sip, {_CLEAN.format('dst_ip')} as dip from detections),
  event as (select batch_id, seq, ts_us, concat('NIDS-', cast(ts_us // 1000000 as string), '-',
      cast(cast(concat('0x', substring(md5(concat(sip, dip)), 1, 8)) as bigint) % 10000 as string)) as event_id,
    strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ') as timestamp, sip as source_ip, dip as destination_ip,
    cast(coalesce(src_port, 0) as bigint) as source_port, cast(coalesce(dst_port, 0) as bigint) as destination_port,
    {_EVENT_SQL} as event_type, cast(case when {_KNOWN_SQL} then 0.95 else 0.5 end as double) as confidence,
    case when {_KNOWN_SQL} then label else 'Unknown' end as protocol, {_ZONE_SQL.format('src_ip')} as network_zone,
    'NIDS-kINN' as detection_source, strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S') as detection_time,
    label as original_label from clean)"""


@query("format_event", f"{EVENTS_SQL} select * exclude (ts_us) from event")
def format_event(spark, sf):
    events = E.format_events(detections(spark, sf))
    return tidy(events.withColumn("timestamp", E.iso_utc(F.col("timestamp"))))


def _features_sql() -> str:
    start = KEYED.replace("with packets", "with recursive packets", 1) + _stage_sql("batch_id", True)
    columns = _feature_columns(True)
    picked = ", ".join(
        f'{R(f"coalesce({columns[n]}, 0)") if n in features.MODEL_COLUMNS else "cast(null as double)"} as "{n}"'
        for n in E.EVENT_FEATURES
    )
    return f"{start} select seq, {picked} from feature"


@query("event_features_struct", _features_sql())
def event_features_struct(spark, sf):
    model = features.select_model_features(realtime(spark, sf), "batch_id")
    nested = model.select("seq", E.features_struct(features.MODEL_COLUMNS).alias("features"))
    return tidy(nested.select("seq", "features.*"))


_LABELLED = f"""{WITH}, labelled as (select seq, case when l = 'benign' then '0_normal' else l end as label
  from (select seq, {LABEL_SQL} as l from frames) x)"""


def labelled(spark, sf) -> DataFrame:
    label = F.when(L.label_mask() == L.BENIGN, L.NORMAL).otherwise(L.label_mask())
    return ip_arp(spark, sf).select("seq", label.alias("label"))


@query(
    "known_class_filter",
    f"""{_LABELLED} select 'novelty' as mode, label, count(*) as n from labelled where label <> 'UDP' group by label
    union all select 'oneclass', label, count(*) from labelled where instr('0_normal', label) > 0 group by label
    union all select 'supervised', label, count(*) from labelled group by label""",
)
def known_class_filter(spark, sf):
    rows = labelled(spark, sf)
    parts = [
        rows.where(L.is_known_class(F.col("label"), mode, ["UDP"])).groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), "label", "n")
        for mode in ("novelty", "oneclass", "supervised")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "test_label_encode",
    f"""{_LABELLED}, classes as (select label, row_number() over (order by label) - 1 as code from (select distinct label from labelled) d),
    coded as (select l.seq, l.label, c.code from labelled l join classes c on l.label = c.label)
    select seq, case when label = 'UDP' then -1 else code - cast(label > 'UDP' as bigint) end as novelty,
      case when label = '0_normal' then 0 else 1 end as oneclass, code as supervised from coded""",
)
def test_label_encode(spark, sf):
    from flowprism.operators.split import fit_labels

    rows = labelled(spark, sf)
    known = L.is_known_class(F.col("label"), "novelty", ["UDP"])
    normal = L.is_known_class(F.col("label"), "oneclass")
    novelty_codes = fit_labels(rows.where(known), "label", "n_code")
    all_codes = fit_labels(rows, "label", "a_code")
    coded = rows.join(all_codes, "label").join(novelty_codes, "label", "left")
    return tidy(
        coded.select(
            "seq",
            L.encode_test_label(F.col("n_code"), known, "novelty").alias("novelty"),
            L.encode_test_label(F.lit(0), normal, "oneclass").alias("oneclass"),
            L.encode_test_label(F.col("a_code"), known, "supervised").alias("supervised"),
        )
    )


_BYTES = "case when event_id % 4 = 0 then concat(cast({r} as string), ' M') when event_id % 11 = 3 then 'bad' else cast(cast(floor(value) as int) as string) end"


@query(
    "bytes_suffix_parse",
    f"""select event_id, coalesce(case when contains(t, 'M') then cast(trunc(try_cast(substring(t, 1, length(t) - 2) as double) * 1e6) as bigint)
      else try_cast(t as bigint) end, 0) as bytes from (select event_id, {_BYTES.format(r="round(value / 10, 1)")} as t from events) x""",
)
def bytes_suffix_parse(spark, sf):
    text = F.expr(_BYTES.format(r="round(value / 10, 1)"))
    return table(spark, sf, "events").select("event_id", L.parse_bytes(text).alias("bytes"))
