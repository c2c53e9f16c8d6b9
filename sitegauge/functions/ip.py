"""IP text -> BINARY(16) and range tests, as plain column expressions.

IPv4 addresses take the form ::ffff:a.b.c.d, so an IPv4-mapped IPv6 address and
the IPv4 address itself are the same sixteen bytes and need no unwrapping.
Binary values compare unsigned, byte by byte, which is address order.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.text import let

# --- fixed values: networks that are not public ------------------------------
BLOCKED_NETWORKS = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "224.0.0.0/4",
    "240.0.0.0/4",
    "::/128",
    "::1/128",
    "fc00::/7",
    "fe80::/10",
    "ff00::/8",
)

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
IPV4 = rf"\A{_QUAD}\z"
_GROUPS = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
_IPV6 = rf"\A(?:{_GROUPS}|(?:{_GROUPS})?::(?:{_GROUPS})?)\z"
_MAPPED = "0" * 20 + "ffff"


def _quad_hex(quad: Column) -> Column:
    return let(
        F.split(quad, r"\."),
        lambda o: F.concat(*[F.lpad(F.hex(o[i].try_cast("bigint")), 2, "0") for i in range(4)]),
    )


def _v6_hex(text: Column) -> Column:
    """Hex digits of IPv6 text without a zone and without a dotted tail; NULL when malformed."""

    def assemble(halves: Column) -> Column:
        def groups(i: int) -> Column:
            return F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")

        def join(sides: Column) -> Column:
            left, right = sides["l"], sides["r"]
            digits = [F.array_join(F.transform(s, lambda g: F.lpad(g, 4, "0")), "") for s in (left, right)]
            count = F.size(left) + F.size(right)
            # `::` stands for at least one group; without it there must be all eight.
            fits = F.when(F.size(halves) == 2, count <= 7).otherwise(count == 8)
            return F.when(fits, F.concat(digits[0], F.repeat(F.lit("0000"), 8 - count), digits[1]))

        return let(F.struct(groups(0).alias("l"), groups(1).alias("r")), join)

    return F.when(text.rlike(_IPV6), let(F.split(text, "::"), assemble))


def _dotted_tail_to_groups(text: Column) -> Column:
    """Rewrite the `a.b.c.d` at the end of an IPv6 address as two ordinary groups."""
    return let(
        _quad_hex(F.regexp_extract(text, rf"({_QUAD})\z", 1)),
        lambda digits: F.concat(
            F.regexp_replace(text, rf"{_QUAD}\z", ""),
            F.lower(F.substring(digits, 1, 4)),
            F.lit(":"),
            F.lower(F.substring(digits, 5, 4)),
        ),
    )


def ip_bytes(ip: Column) -> Column:
    """Sixteen address bytes, or NULL when the text is not an IP address.

    Octets with a leading zero are refused; an IPv6 zone (`%eth0`) is dropped.
    """

    def parse(text: Column) -> Column:
        plain = F.when(text.rlike(rf":{_QUAD}\z"), _dotted_tail_to_groups(text)).otherwise(text)
        return (
            F.when(text.rlike(IPV4), F.unhex(F.concat(F.lit(_MAPPED), _quad_hex(text))))
            .when(text.contains(":"), F.unhex(let(plain, _v6_hex)))
        )

    return let(F.lower(F.regexp_replace(ip, r"\A([^%]*:[^%]*)%[^%]+\z", "$1")), parse)


def is_ip(text: Column) -> Column:
    """Whether text is an IP address; IPv4, the common case, takes one pattern test."""
    return F.when(text.rlike(IPV4), True).otherwise(text.contains(":") & ip_bytes(text).isNotNull())


def network_bounds(cidr: str) -> tuple[bytes, bytes]:
    """First and last address of a network in the sixteen-byte form."""
    net = ipaddress.ip_network(cidr)

    def pack(address) -> bytes:
        raw = address.packed
        return raw if len(raw) == 16 else bytes.fromhex(_MAPPED) + raw

    return pack(net.network_address), pack(net.broadcast_address)


def in_networks(address: Column, networks: tuple[str, ...] = BLOCKED_NETWORKS) -> Column:
    """Address in any network: constant range tests, no join and no shuffle."""

    def inside(cidr: str) -> Column:
        low, high = (F.lit(bytearray(b)) for b in network_bounds(cidr))
        return address.between(low, high)

    return reduce(lambda a, b: a | b, [inside(c) for c in networks])
