"""Addresses, ports and protocols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsentry.schemas import CAPTURE_PORTS


def truthy(value: Column | str, empty) -> Column:
    """`value`, with its empty form ('' or 0) read as missing."""
    return F.nullif(value if isinstance(value, Column) else F.col(value), F.lit(empty))


def ip_to_int(ip: Column | str) -> Column:
    """Dotted address as one number; anything but four whole numbers gives 0. Octets are not range-checked."""
    parts = F.split(ip if isinstance(ip, Column) else F.col(ip), r"\.")
    number = reduce(Column.bitwiseOR, [F.shiftleft(F.get(parts, F.lit(place)).try_cast("bigint"), 24 - 8 * place)
                                       for place in range(4)])
    return F.coalesce(F.when(F.size(parts) == 4, number), F.lit(0).cast("bigint"))


def protocol_code(protocol: Column | str) -> Column:
    """ICMP 0, TCP 1, UDP 2 in any case; every other name counts as TCP."""
    name = F.upper(protocol)
    return F.when(name == "ICMP", 0).when(name == "UDP", 2).otherwise(1)


def on_capture_ports(ports: tuple[int, int] = CAPTURE_PORTS, src: str = "src_port",
                     dst: str = "dst_port") -> Column:
    low, high = ports
    return F.col(src).between(low, high) | F.col(dst).between(low, high)


def connection_label(with_protocol: bool = False) -> Column:
    """Printable `src:port-dst:port[-protocol]`. Group on the columns, not on this string."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    dash, colon = F.lit("-"), F.lit(":")
    parts = [text("src_ip"), colon, text("src_port"), dash, text("dst_ip"), colon, text("dst_port")]
    return F.concat(*parts, *([dash, text("protocol")] if with_protocol else []))


def byte_count(bytes_: str = "bytes", sent: str = "BytesSent", received: str = "BytesReceived",
               packet: str | None = "PacketSize") -> Column:
    """First non-zero of: bytes, sent + received, packet size. `packet=None` stops at the second."""
    both = F.coalesce(F.col(sent), F.lit(0)) + F.coalesce(F.col(received), F.lit(0))
    steps = [truthy(bytes_, 0), F.nullif(both, F.lit(0))]
    if packet:
        steps.append(F.col(packet))
    return F.coalesce(*steps, F.lit(0)).cast("bigint")


def per_second(amount: Column, seconds: Column) -> Column:
    """Rate over a duration; a zero duration counts as one millisecond."""
    return amount / F.when(seconds == 0, F.lit(0.001)).otherwise(seconds)
