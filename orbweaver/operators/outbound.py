"""Which addresses may be connected to: a column for tables of addresses, and a guard for single requests."""

from __future__ import annotations

import ipaddress
import socket
from collections.abc import Callable, Iterable
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Networks of version 4 by what they are, the first that holds an address counts.
NETWORKS = {
    "loopback": ["127.0.0.0/8"],
    "reserved": ["169.254.0.0/16", "0.0.0.0/32", "224.0.0.0/4", "240.0.0.0/4"],
    "private": ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10", "0.0.0.0/8", "192.0.0.0/24", "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24"],
}
_QUAD = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def ipv4_number(address: Column) -> Column:
    """An address of four decimal parts as a number; null where it is none."""
    parts = [F.regexp_extract(address, _QUAD, i).try_cast("long") for i in range(1, 5)]
    good = F.lit(True)
    for p in parts:
        good = good & p.between(0, 255)
    return F.when(good, parts[0] * (1 << 24) + parts[1] * (1 << 16) + parts[2] * 256 + parts[3])


def address_kind(address: Column) -> Column:
    """loopback, reserved, private or public; null for what is no address of version 4."""
    n = ipv4_number(address)
    out = F.when(n.isNotNull(), "public")
    for kind, networks in reversed(NETWORKS.items()):
        for net in map(ipaddress.ip_network, networks):
            out = F.when(n.between(int(net.network_address), int(net.broadcast_address)), kind).otherwise(out)
    return out


class Blocked(ValueError):
    """An address that may not be connected to."""


_NAT64 = ipaddress.ip_network("64:ff9b::/96")


def _inner(ip: ipaddress.IPv6Address) -> ipaddress.IPv4Address | None:
    """The address of version 4 that one of version 6 stands for."""
    if ip in _NAT64:
        return ipaddress.IPv4Address(int(ip) & (1 << 32) - 1)
    return ip.ipv4_mapped or ip.sixtofour


def check_address(address: str, host: str = "", loopback: bool = False, private: bool = False, hosts: Iterable[str] = ()) -> None:
    """Raise unless the address may be connected to. ``hosts`` are names whose private addresses are allowed."""
    ip = ipaddress.ip_address(address.partition("%")[0])
    if ip.version == 6 and (inner := _inner(ip)):
        ip = inner
    name = host or address
    if ip.version == 4:
        kind = next((k for k, nets in NETWORKS.items() if any(ip in ipaddress.ip_network(n) for n in nets)), "public")
    else:
        kind = "loopback" if ip.is_loopback else "reserved" if ip.is_link_local or ip.is_unspecified or ip.is_multicast or ip.is_reserved else "private" if ip.is_private else "public"
    if kind == "reserved" or (kind == "loopback" and not loopback) or (kind == "private" and not private and host.lower() not in {h.lower() for h in hosts}):
        raise Blocked(f"{name}: {kind} addresses are not allowed")


def _look_up(host: str, port: int) -> list[str]:
    return [str(info[4][0]) for info in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)]


def pinned_address(url: str, look_up: Callable[[str, int], list[str]] = _look_up, **allow: object) -> tuple[str, int]:
    """(address, port) to connect to for a URL: all addresses of its host are checked, the first is used, so none can change in between."""
    u = urlsplit(url)
    if u.scheme != "https" and not (u.scheme == "http" and allow.get("loopback")):
        raise ValueError("the URL must be https")
    if not u.hostname:
        raise ValueError("the URL has no host")
    port = u.port or {"https": 443, "http": 80}[u.scheme]
    found = list(dict.fromkeys(look_up(u.hostname, port)))
    if not found:
        raise OSError(f"{u.hostname} has no address")
    for a in found:
        check_address(a, u.hostname, **allow)
    return found[0], port
