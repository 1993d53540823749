"""IPv4 and IPv6 addresses as columns, against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from wardlake.functions import net
from wardlake.operators import enrich

TEXTS = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "1::2::3", ":::", ":", "1:2", "fe80::1%eth0", "FE80::A", "::ffff:45.33.32.1",
         "::ffff:300.1.1.1", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "12345::", "g::", "2a00:1450:4001:81b::200e", "2001:db8::5", "2001:4:112::9", "2001:20::1", "2002::1", "ff02::1", "fd00::1",
         "3fff::1", "3fff:1000::1", "1.2.3.4", "10.0.0.1", "8.8.8.8", "8.8.8", "", " ", "host-1", "a" * 100_000 + ":", "2620:fe::fe", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"]


def parsed(text):
    try:
        return ipaddress.ip_address((text or "").split("%")[0])
    except ValueError:
        return None


def some_v6(rng):
    n = rng.getrandbits(128) & rng.choice([(1 << 128) - 1, ((1 << 64) - 1) << 64, (0xFFFF << 112) | 0xFFFF])
    a = ipaddress.IPv6Address(n)
    return rng.choice([a.compressed, a.exploded, a.compressed.upper()])


def public(a):
    # newer documentation space is not in every version of the library
    if a is None or (a.version == 6 and (a.ipv4_mapped or a.is_site_local or a in ipaddress.ip_network("3fff::/20"))):
        return False
    return not (a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_unspecified or a.is_reserved)


def test_numbers_and_public(spark):
    rng = random.Random(5)
    texts = TEXTS + [some_v6(rng) for _ in range(400)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    rows = df.select("ip", net.address(F.col("ip")).alias("a"), net.is_public(F.col("ip")).alias("p"), net.in_networks(F.col("ip"), ["fe80::/10", "2001:db8::/32", "::ffff:0:0/96", "2620:fe::fe/127", "bad/9", "8.8.8.0/24"]).alias("n")).collect()
    inside = [ipaddress.ip_network(x) for x in ("fe80::/10", "2001:db8::/32", "::ffff:0:0/96", "2620:fe::fe/127", "8.8.8.0/24")]
    for r in rows:
        want = parsed(r["ip"])
        assert (r["a"] is None) == (want is None), r["ip"]
        if want is not None:
            got = ((r["a"]["hi"] % (1 << 64)) << 64) | (r["a"]["lo"] % (1 << 64))
            assert (r["a"]["version"], got) == (want.version, int(want)), r["ip"]
        assert r["p"] == public(want), r["ip"]
        assert r["n"] == any(want is not None and want.version == n.version and want in n for n in inside), r["ip"]


def test_narrowest_network_of_mixed_versions(spark):
    rng = random.Random(9)
    nets = ["0.0.0.0/0", "45.0.0.0/8", "45.33.32.0/20", "45.33.32.16/28", "45.33.32.17", "::/0", "2a00::/12", "2a00:1450::/32", "2a00:1450:4001::/48", "2a00:1450:4001:81b::/64", "2a00:1450:4001:81b::200e/127",
            "45.33.32.99/33", "nonsense", None, "2a00::/129"]
    geo = spark.createDataFrame([(n, f"c{i}") for i, n in enumerate(nets)] + [("45.0.0.0/8", "a-first")], "network string, country string")
    ips = ["45.33.32.17", "45.33.32.18", "45.33.40.1", "45.1.1.1", "1.1.1.1", "2a00:1450:4001:81b::200f", "2a00:1450:4001:81b::1", "2a00:1450:4001:1::", "2a00:1450:5::", "2a0f::1", "fd00::1", "x", "", None]
    ips += ["45.33.32." + str(rng.randrange(256)) for _ in range(20)]
    got = {r["ip"]: r["country"] for r in enrich.geo_lookup(spark.createDataFrame([(i,) for i in ips], "ip string"), geo).collect()}
    want = {}
    for ip in ips:
        a, best = parsed(ip), None
        for i, n in enumerate(nets):
            try:
                w = ipaddress.ip_network(n)
            except (ValueError, TypeError):
                continue
            if a is not None and a.version == w.version and a in w and (best is None or w.prefixlen > best[0]):
                best = (w.prefixlen, "a-first" if n == "45.0.0.0/8" else f"c{i}")
        if best:
            want[ip] = best[1]
    assert got == want


def test_no_python_in_the_plan(spark, capsys):
    geo = spark.createDataFrame([("2a00::/12", "x")], "network string, country string")
    rows = spark.createDataFrame([(1, "2a00::1", "fe80::1"), (2, None, "8.8.8.8")], "id int, src_ip string, dst_ip string")
    out = enrich.geo_enrich(rows.where(~net.in_networks(F.col("src_ip"), ["fe80::/10"])), geo, net.public_ips(F.col("src_ip"), F.col("dst_ip")))
    out.explain()
    assert "Python" not in capsys.readouterr().out
    assert [(r["alert_id"], r["ip"], r["country"]) for r in out.collect()] == [(1, "2a00::1", "x")]
    empty = spark.createDataFrame([], geo.schema)
    assert enrich.geo_enrich(rows, empty, net.public_ips(F.col("src_ip"), F.col("dst_ip"))).count() == 0
