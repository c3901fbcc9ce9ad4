"""IPv4 predicates and conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _octet(ip: Column, i: int) -> Column:
    return F.split_part(ip, F.lit("."), F.lit(i)).try_cast("int")


def is_private_ip(ip: Column) -> Column:
    """Private, loopback or unusable address. Anything but four parts counts as private."""
    dots = F.length(ip) - F.length(F.replace(ip, F.lit("."), F.lit("")))
    a, b = _octet(ip, 1), _octet(ip, 2)
    private = (
        (a == 10)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | (a == 127)
        | ((a == 0) & (b == 0) & (_octet(ip, 3) == 0) & (_octet(ip, 4) == 0))
    )
    return F.when(ip.isNull() | (ip == "") | (dots != 3), F.lit(True)).otherwise(
        F.coalesce(private, F.lit(False))
    )


def ip_to_long(ip: Column) -> Column:
    """Address as a number; NULL when it is not four octets."""
    valid = F.regexp_like(ip, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$"))
    octets = [_octet(ip, i) for i in range(1, 5)]
    value = F.lit(0).cast("long")
    for octet in octets:
        value = value * 256 + octet
    in_range = (octets[0] <= 255) & (octets[1] <= 255) & (octets[2] <= 255) & (octets[3] <= 255)
    return F.when(valid, F.when(in_range, value))
