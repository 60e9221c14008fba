"""Address tests, as ranges of numbers (IPv4) and of hex digits (IPv6)."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, functions as F

from wirelens import fixed

NON_PUBLIC_V4 = (
    # private, loopback, link-local, documentation, benchmark, multicast, reserved blocks
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "255.255.255.255/32",
)


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as a long, null when an octet is missing or above 255."""
    octets = F.split(ip, r"\.")
    numbers = [F.get(octets, F.lit(i)).try_cast("long") for i in range(4)]
    part = [F.when(n.between(0, 255), n) for n in numbers]
    return part[0] * 16777216 + part[1] * 65536 + part[2] * 256 + part[3]


def is_public_ip(ip: Column) -> Column:
    """True for a routable IPv4 address that is not a known placeholder.

    Octets with a leading zero are no valid address.
    """
    number = ipv4_number(ip)
    inside = F.lit(False)
    for block in NON_PUBLIC_V4:
        net = ipaddress.ip_network(block)
        inside = inside | number.between(int(net.network_address), int(net.broadcast_address))
    shaped = ip.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$")
    return F.coalesce(shaped & ~inside & ~ip.isin(*fixed.IP_PLACEHOLDERS), F.lit(False))


def ipv6_digits(text: Column) -> Column:
    """The 32 hex digits of an IPv6 address, null for any other text (also for one with a dotted tail)."""
    halves = F.split(F.lower(text), "::")

    def groups(half: Column) -> Column:
        return F.filter(F.split(F.coalesce(half, F.lit("")), ":"), lambda g: g != "")

    left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    count, short = F.size(left) + F.size(right), F.size(halves) == 2
    shaped = F.lower(text).rlike("^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?)?$")

    def spelled(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda g: F.lpad(g, 4, "0")), "")

    whole = F.concat(spelled(left), F.repeat(F.lit("0000"), F.lit(8) - count), spelled(right))
    return F.when(shaped & F.when(short, count <= 7).otherwise(count == 8), whole)


# of the global range 2000::/3: protocol assignments (with the parts of them that are routed), documentation, 6to4
NON_PUBLIC_V6 = ("2001::/23", "2001:db8::/32", "2002::/16")
ROUTED_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")


def is_public_ipv6(text: Column) -> Column:
    """True for a routable IPv6 address."""
    digits = ipv6_digits(text)

    def inside(blocks: tuple[str, ...]) -> Column:
        ends = [(f"{int(n.network_address):032x}", f"{int(n.broadcast_address):032x}") for n in map(ipaddress.ip_network, blocks)]
        return reduce(Column.__or__, [digits.between(*e) for e in ends])

    return F.coalesce(inside(("2000::/3",)) & (~inside(NON_PUBLIC_V6) | inside(ROUTED_V6)), F.lit(False))


def domain_ok(domain: Column, tlds: tuple[str, ...], benign: tuple[str, ...]) -> Column:
    """Known top level, and neither the name nor its last two labels is benign."""
    parent = F.substring_index(domain, ".", -2)
    ok = F.substring_index(domain, ".", -1).isin(*tlds)
    return ok & ~domain.isin(*benign) & ~parent.isin(*benign) if benign else ok
