"""Label expressions for packets, training rows and flow records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowprism.functions.packet import is_arp

# Attacker hardware addresses and the label of each protocol number.
ATTACKER_INSIDE = "00:0c:29:fa:80:88"
ATTACKER_OUTSIDE = "00:0c:29:69:89:72"
PROTOCOL_LABELS = {0: "ARP", 1: "ICMP", 6: "TCP", 17: "UDP"}
BENIGN = "benign"
NORMAL = "0_normal"


def touches_mac(mac: Column | str) -> Column:
    mac = F.lit(mac) if isinstance(mac, str) else mac
    return F.coalesce((F.col("src_mac") == mac) | (F.col("dst_mac") == mac), F.lit(False))


def touches_any(macs: Column) -> Column:
    """Whether one end is among the addresses of an array; never so without an array or an address."""
    return F.coalesce(F.array_contains(macs, F.col("src_mac")), F.lit(False)) | F.coalesce(F.array_contains(macs, F.col("dst_mac")), F.lit(False))


def protocol_type() -> Column:
    """Protocol number as the feature table reports it (0 for ARP)."""
    return F.when(is_arp(), F.lit(0)).otherwise(F.col("proto"))


def label_mask(mac: Column | str = ATTACKER_INSIDE) -> Column:
    """Attack label of packets to or from the attacker, else benign."""
    return label_where(touches_mac(mac))


def label_where(attack: Column) -> Column:
    """Label by protocol where ``attack`` holds, else benign."""
    label = F.lit(BENIGN)
    for number, text in PROTOCOL_LABELS.items():
        label = F.when(attack & (protocol_type() == number), text).otherwise(label)
    return label


def is_known_class(label: Column, mode: str, dropped: Sequence[str] = ()) -> Column:
    """Which training rows stay: novelty drops classes, one-class keeps any label
    that is a piece of the normal class name (a substring test, kept), supervised all."""
    if mode == "novelty":
        return ~label.isin(*dropped) if dropped else F.lit(True)
    if mode == "oneclass":
        return F.lit(NORMAL).contains(label)
    if mode == "supervised":
        return F.lit(True)
    raise ValueError(f"unknown mode {mode!r}")


def encode_test_label(code: Column, known: Column, mode: str) -> Column:
    """-1 (novelty) or 1 (one-class) for unknown classes, the code otherwise."""
    unknown = {"novelty": F.lit(-1), "oneclass": F.lit(1)}.get(mode)
    return code if unknown is None else F.when(known, code).otherwise(unknown)


def parse_bytes(text: Column | str) -> Column:
    """``"2.1 M"`` -> 2100000; plain integers as they are; anything else 0.

    The two characters before the end are cut as a fixed suffix and the product is
    truncated, so ``"0.7 M"`` gives the truncated double product.
    """
    text = F.col(text) if isinstance(text, str) else text
    mega = F.substring(text, F.lit(1), F.greatest(F.length(text) - 2, F.lit(0))).try_cast("double") * F.lit(1e6)
    whole = F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("bigint"))
    return F.coalesce(F.when(text.contains("M"), mega.try_cast("bigint")).otherwise(whole), F.lit(0))
