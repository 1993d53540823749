"""Address predicates as columns."""

from __future__ import annotations

import functools
import ipaddress
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake import fixed

_V4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def any_of(preds: list[Column]) -> Column:
    return functools.reduce(operator.or_, preds) if preds else F.lit(False)


def all_of(preds: list[Column]) -> Column:
    return functools.reduce(operator.and_, preds) if preds else F.lit(True)


_PRIVATE = "^(" + "|".join(re.escape(p) for p in fixed.PRIVATE_PREFIXES) + ")"


def is_private(ip: Column) -> Column:
    """One anchored pattern over the prefixes, so the address is read once."""
    return F.coalesce(ip.rlike(_PRIVATE), F.lit(False))


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(_V4), F.lit(False))


def ipv4_number(ip: Column) -> Column:
    """Dotted quad -> BIGINT; NULL for anything else."""
    parts = F.split(ip, r"\.")
    num = functools.reduce(
        lambda acc, i: acc * 256 + F.get(parts, F.lit(i)).try_cast("long"), range(4), F.lit(0).cast("long")
    )
    return F.when(is_ipv4(ip), num)


def v4_bounds(network: str) -> tuple[int, int] | None:
    """Numeric bounds of a v4 network (host bits allowed); None when it is not one."""
    try:
        net = ipaddress.ip_network(network, strict=False)
    except ValueError:
        return None
    return (int(net.network_address), int(net.broadcast_address)) if net.version == 4 else None


def _bits(n: Column) -> Column:
    """BIGINT with the n leading bits of 64 set."""
    return F.when(n <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), (F.lit(64) - n).cast("int")))


def masked(value: Column, prefix: Column) -> Column:
    """The address with all but its leading ``prefix`` bits cleared; IPv4 prefixes are counted as in the network's text."""
    bits = prefix + F.when(value["version"] == 4, F.lit(96)).otherwise(F.lit(0))
    return F.struct(value["version"].alias("version"), value["hi"].bitwiseAND(_bits(F.least(bits, F.lit(64)))).alias("hi"),
                    value["lo"].bitwiseAND(_bits(bits - 64)).alias("lo"))


def _bind(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_LONGEST = 45  # characters of the longest way to write an address


def _v6_groups(text: Column) -> Column:
    """Eight groups of hex digits of an IPv6 text, or NULL; a dotted tail counts as two groups, a zone after % is no part of the address."""
    def dotted(t: Column) -> Column:
        tail = F.substring_index(t, ":", -1)
        head = F.left(t, F.length(t) - F.length(tail))
        n = ipv4_number(tail)
        return F.when(~tail.contains("."), t).when(n.isNotNull(), F.concat(head, F.lower(F.hex(F.floor(n / 65536))), F.lit(":"), F.lower(F.hex(n % 65536))))

    def parts(t: Column) -> Column:
        return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ":"))

    def grouped(t: Column) -> Column:
        left = F.substring_index(t, "::", 1)
        l, r = parts(left), parts(F.substr(t, F.length(left) + 3))
        zeros = F.lit(8) - F.size(l) - F.size(r)
        return F.when(~t.contains("::"), F.split(t, ":")).when(zeros >= 1, F.concat(l, F.array_repeat(F.lit("0"), F.greatest(zeros, F.lit(0))), r))

    plain = F.lower(F.substring_index(text, "%", 1))
    groups = _bind(F.when(plain.contains(":") & (F.length(plain) <= _LONGEST), dotted(plain)), grouped)
    return _bind(groups, lambda g: F.when((F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), g))


def address(ip: Column) -> Column:
    """struct(version, hi, lo) of an address text, NULL for anything else; an IPv4 address lies in the low 32 bits of lo."""
    def half(g: Column, start: int) -> Column:
        digits = F.array_join(F.transform(F.slice(g, start, 4), lambda x: F.lpad(x, 4, "0")), "")
        return F.conv(digits, 16, -10).cast("long")

    # either form is read only where the text can be one
    v4 = _bind(F.when(~ip.contains(":"), ipv4_number(ip)), lambda n: F.when(n.isNotNull(), F.struct(F.lit(4).alias("version"), F.lit(0).cast("long").alias("hi"), n.alias("lo"))))
    v6 = _bind(F.when(ip.contains(":"), _v6_groups(ip)), lambda g: F.when(g.isNotNull(), F.struct(F.lit(6).alias("version"), half(g, 1).alias("hi"), half(g, 5).alias("lo"))))
    return F.coalesce(v4, v6)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def _inside(a: Column, networks: list[str]) -> list[Column]:
    """One test per IPv6 network of an address struct."""
    out, low = [], (1 << 64) - 1
    for text in networks:
        net = ipaddress.IPv6Network(text, strict=False)
        base, mask = int(net.network_address), int(net.netmask)
        test = a["hi"].bitwiseAND(F.lit(_signed(mask >> 64))) == F.lit(_signed(base >> 64))
        if net.prefixlen > 64:
            test = test & (a["lo"].bitwiseAND(F.lit(_signed(mask & low))) == F.lit(_signed(base & low)))
        out.append(test)
    return out


def in_networks(ip: Column, networks: list[str]) -> Column:
    """True when the address lies in any network; bad addresses and bad networks never match."""
    v4 = [b for b in (v4_bounds(n) for n in networks) if b]
    v6 = []
    for n in networks:
        try:
            net = ipaddress.ip_network(n, strict=False)
        except ValueError:
            continue
        if net.version == 6:
            v6.append(n)
    preds = []
    if v4:
        # bound once, so the text is parsed once per row however many networks there are
        preds.append(F.exists(F.array(ipv4_number(ip)), lambda n: any_of([n.between(lo, hi) for lo, hi in v4])))
    if v6:
        # only texts with a colon are read as IPv6
        preds.append(F.exists(F.array(F.when(ip.contains(":"), address(ip))), lambda a: any_of(_inside(a, v6))))
    return F.coalesce(any_of([F.coalesce(p, F.lit(False)) for p in preds]), F.lit(False))


def is_internal(ip: Column, networks: list[str] | None = None) -> Column:
    return in_networks(ip, networks or fixed.INTERNAL_NETWORKS)


def is_public_v4(ip: Column) -> Column:
    return is_ipv4(ip) & ~in_networks(ip, fixed.NON_PUBLIC_V4)


def is_public_v6(ip: Column) -> Column:
    """Global unicast space without the blocks set aside in it; IPv4 written as IPv6 is not in it."""
    def public(a: Column) -> Column:
        return any_of(_inside(a, fixed.GLOBAL_V6)) & (~any_of(_inside(a, fixed.NON_PUBLIC_V6)) | any_of(_inside(a, fixed.PUBLIC_WITHIN_V6)))

    return F.coalesce(F.exists(F.array(address(ip)), public), F.lit(False))


def is_public(ip: Column) -> Column:
    return F.when(F.coalesce(ip.contains(":"), F.lit(False)), is_public_v6(ip)).otherwise(is_public_v4(ip))


def public_ips(*fields: Column) -> Column:
    """Distinct globally routable addresses, IPv4 and IPv6, in field order and as they are written."""
    trimmed = F.transform(F.array(*fields), lambda x: F.trim(x))
    return F.array_distinct(F.filter(trimmed, is_public))


def network(text: Column) -> tuple[Column, Column]:
    """(address, prefix length) of an 'address/length' column, host bits cleared; a missing length is the whole address, a bad network gives NULLs."""
    start = F.substring_index(F.trim(text), "/", 1)
    whole = F.when(start.contains(":"), 128).otherwise(32)
    length = F.when(text.contains("/"), F.substring_index(F.trim(text), "/", -1).try_cast("int")).otherwise(whole)
    length = F.when(length.between(0, whole), length)
    return _bind(address(start), lambda a: F.when(length.isNotNull() & a.isNotNull(), masked(a, length))), length
