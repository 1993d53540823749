"""Network detectors over flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlake.operators import flows as fl
from wardlake.operators import packets as pk
from wardlake.operators import timeline as tl
from wardlake.plans.q_alerts import ttl_sql
from wardlake.plans.registry import query

MIN = 60 * tl.SECOND
K3 = "src_ip, dst_ip, dst_port"
PRIV = "({c} LIKE '10.%' OR {c} LIKE '192.168.%')"


@query("port_scan_flow", f"""SELECT DISTINCT src_ip, dst_ip, time_us, ports FROM (SELECT src_ip, dst_ip, time_us, count(DISTINCT dst_port) OVER (PARTITION BY src_ip, dst_ip ORDER BY time_us RANGE BETWEEN {30 * MIN - 1} PRECEDING AND CURRENT ROW) AS ports FROM v_flows) t WHERE ports >= 4""")
def port_scan_flow(lake):
    return fl.port_scan(lake.flows, 4, 30 * MIN)


@query("beacon_flow", f"""SELECT {K3}, n AS connections, gaps, round(sd / mean, 4) AS jitter, round(mean, 7) AS mean_gap_s, round(least(0.95, 1 - sd / mean), 4) AS confidence FROM (
 SELECT {K3}, count(*) AS n, count(g) AS gaps, avg(g) AS mean, stddev_pop(g) AS sd FROM (SELECT {K3}, CASE WHEN d > 1000000 THEN d / 1e6 END AS g FROM (SELECT {K3}, time_us - lag(time_us) OVER (PARTITION BY {K3} ORDER BY time_us) AS d FROM v_flows WHERE NOT {PRIV.format(c='dst_ip')}) a) b GROUP BY ALL) c
 WHERE n >= 6 AND gaps >= 5 AND sd / mean < 0.8""")
def beacon_flow(lake):
    return fl.beacon(lake.flows, min_flows=6, max_jitter=0.8).select(
        *K3.split(", "), "connections", "gaps", F.round("jitter", 4).alias("jitter"), F.round("mean_gap_s", 7).alias("mean_gap_s"), F.round("confidence", 4).alias("confidence"))


@query("brute_force", f"""SELECT DISTINCT src_ip, dst_port, time_us, attempts FROM (SELECT src_ip, dst_port, time_us, count(*) OVER (PARTITION BY src_ip, dst_port ORDER BY time_us RANGE BETWEEN {30 * MIN - 1} PRECEDING AND CURRENT ROW) AS attempts FROM v_flows
 WHERE dst_port IN (21,22,23,110,143,389,445,636,993,995,3389,5900) AND duration_ms <= 2000 AND bytes_in <= 1000) t WHERE attempts >= 4""")
def brute_force(lake):
    return fl.brute_force(lake.flows, 4, 30 * MIN)


_LAT = f"""(SELECT src_ip, dst_ip, min(time_us) AS time_us FROM v_flows WHERE {PRIV.format(c='src_ip')} AND {PRIV.format(c='dst_ip')} AND dst_port IN (22,135,445,3389,5985,5986) GROUP BY 1, 2)"""


@query("lateral_first_seen", f"SELECT src_ip, dst_ip, time_us FROM {_LAT} t")
def lateral_first_seen(lake):
    return fl.lateral_first_seen(lake.flows).select("src_ip", "dst_ip", "time_us")


@query("lateral_known_pairs", f"SELECT src_ip, dst_ip, time_us FROM {_LAT} t WHERE (src_ip, dst_ip) NOT IN (SELECT (src_ip, dst_ip) FROM v_events)")
def lateral_known_pairs(lake):
    return fl.lateral_first_seen(lake.flows, lake.events.select("src_ip", "dst_ip").distinct()).select("src_ip", "dst_ip", "time_us")


@query("exfil_baseline", f"""SELECT src_ip, time_us, total_bytes, round(total_bytes / 1500000, 4) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY time_us, flow_id) AS rn FROM (
 SELECT src_ip, time_us, flow_id, CAST(sum(bytes_in + bytes_out) OVER (PARTITION BY src_ip ORDER BY time_us, flow_id) AS BIGINT) AS total_bytes FROM v_flows WHERE {PRIV.format(c='src_ip')} AND NOT {PRIV.format(c='dst_ip')}) a WHERE total_bytes > 3000000) b WHERE rn = 1""")
def exfil_baseline(lake):
    return fl.exfil_baseline(lake.flows, 1_500_000).select("src_ip", "time_us", "total_bytes", F.round("ratio", 4).alias("ratio"))


@query("exfil_volume", f"""WITH w AS (SELECT f.*, k.kept, sum(bytes_in + bytes_out) OVER (PARTITION BY f.src_ip, f.dst_ip, f.dst_port, k.kept ORDER BY time_us, flow_id) AS tot FROM v_flows f JOIN {ttl_sql('v_flows', K3, 30 * MIN)} k
  ON f.src_ip = k.src_ip AND f.dst_ip = k.dst_ip AND f.dst_port = k.dst_port AND f.time_us >= k.kept AND f.time_us < k.kept + {30 * MIN}),
 x AS (SELECT *, row_number() OVER (PARTITION BY {K3}, kept ORDER BY time_us, flow_id) AS rn FROM w WHERE tot >= 60000)
 SELECT {K3}, kept AS anchor_us, time_us, CAST(tot AS BIGINT) AS total_bytes, CASE WHEN tot >= 600000 THEN 'critical' WHEN tot >= 180000 THEN 'high' ELSE 'medium' END AS severity, CAST(tot AS BIGINT) // greatest(1, (time_us - kept) // 1000000) AS rate FROM x WHERE rn = 1""")
def exfil_volume(lake):
    return fl.exfil_volume(lake.flows, 60_000, 30 * MIN).select(*K3.split(", "), "anchor_us", "time_us", "total_bytes", "severity", "rate")


@query("dns_flow_tunnel", "SELECT flow_id, src_ip, dst_ip FROM v_flows WHERE dst_port = 53 AND bytes_in + bytes_out > 100")
def dns_flow_tunnel(lake):
    return fl.dns_flow_tunnel(lake.flows).select("flow_id", "src_ip", "dst_ip")


@query("dedup_ndr", f"""SELECT f.src_ip, f.dst_ip, f.time_us, min(flow_id) AS flow_id FROM v_flows f JOIN {ttl_sql('(SELECT * FROM v_flows WHERE dst_port = 53 AND bytes_in + bytes_out > 100)', 'src_ip, dst_ip', 30 * MIN)} k ON f.src_ip = k.src_ip AND f.dst_ip = k.dst_ip AND f.time_us = k.kept
 WHERE dst_port = 53 AND bytes_in + bytes_out > 100 GROUP BY 1, 2, 3""")
def dedup_ndr(lake):
    hit = fl.dns_flow_tunnel(lake.flows).select("src_ip", "dst_ip", "time_us", "flow_id")
    return tl.first_in_ttl(hit, ["src_ip", "dst_ip"], "time_us", "flow_id", 30 * MIN)


@query("flows_to_alerts")
def flows_to_alerts(lake):
    """All six detectors at their default thresholds, deduplicated per alert key."""
    return fl.flows_to_alerts(lake.flows, 1_500_000).select("alert_type", "src_ip", "dst_ip", "dst_port", "time_us", "technique_id", "tactic", "severity")


@query("port_scan_packet")
def port_scan_packet(lake):
    """Anchored windows with reset on firing; proven against a plain loop in the tests."""
    return pk.port_scan(lake.flows, "flow_id", 12, 20 * MIN)


@query("beacon_cv", f"""WITH s AS (SELECT {K3}, kept AS time_us, (kept - lag(kept) OVER w) / 1e6 AS gap, row_number() OVER w AS i FROM {ttl_sql('v_flows', K3, 48 * tl.SECOND)} k WINDOW w AS (PARTITION BY {K3} ORDER BY kept)),
 c AS (SELECT *, avg(gap) OVER r AS mean, stddev_pop(gap) OVER r AS sd FROM s WINDOW r AS (PARTITION BY {K3} ORDER BY time_us ROWS BETWEEN 98 PRECEDING AND CURRENT ROW)),
 h AS (SELECT *, row_number() OVER (PARTITION BY {K3} ORDER BY time_us) AS rn FROM c WHERE least(i, 100) >= 3 AND sd / mean <= 0.2) SELECT {K3}, time_us, least(i, 100) AS samples, round(mean, 7) AS mean_s, round(sd / mean, 4) AS cv FROM h WHERE rn = 1""")
def beacon_cv(lake):
    return pk.beacon_cv(lake.flows, min_samples=3).select(*K3.split(", "), "time_us", "samples", F.round("mean_s", 7).alias("mean_s"), F.round("cv", 4).alias("cv"))


_BM = f"(SELECT f.src_ip, f.dst_ip, f.dst_port, f.time_us, arg_min(bytes_out, flow_id) AS size FROM v_flows f JOIN {ttl_sql('v_flows', K3, 2 * tl.SECOND)} k ON f.src_ip = k.src_ip AND f.dst_ip = k.dst_ip AND f.dst_port = k.dst_port AND f.time_us = k.kept GROUP BY 1, 2, 3, 4)"


@query("beacon_multi", f"""WITH s AS (SELECT *, count(*) FILTER (WHERE dayofweek(make_timestamp(time_us)) IN (0, 6) OR hour(make_timestamp(time_us)) < 8 OR hour(make_timestamp(time_us)) >= 18) OVER (PARTITION BY {K3} ORDER BY time_us) AS off FROM {_BM} b),
 l AS (SELECT *, list({{'t': time_us, 'p': size}}) OVER (PARTITION BY {K3} ORDER BY time_us ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS w0 FROM s),
 f AS (SELECT *, list_filter(w0, lambda x: x.t >= time_us - {120 * MIN}) AS w FROM l), g AS (SELECT *, len(w) AS n, list_transform(range(1, len(w)), lambda i: (w[i + 1].t - w[i].t) / 1e6) AS gaps, list_transform(list_filter(w, lambda x: x.p > 0), lambda x: x.p) AS sizes FROM f WHERE len(w) >= 4),
 j AS (SELECT *, list_avg(gaps) AS mean, list_stddev_pop(gaps) AS sd FROM g), h AS (SELECT *, row_number() OVER (PARTITION BY {K3} ORDER BY time_us) AS rn FROM j WHERE mean > 0 AND sd / mean * 100 < 40)
 SELECT {K3}, time_us, n AS samples, round(mean, 7) AS mean_s, round(sd / mean * 100, 3) AS jitter_pct, coalesce(len(sizes) >= 2 AND list_stddev_pop(sizes) / list_avg(sizes) < 0.20, false) AS steady_payload, round(off / n * 100, 2) AS off_hours_pct,
 dst_port NOT IN (53, 80, 443, 8080, 8443) AS uncommon_port, CASE WHEN dst_port IN (443, 8443) THEN 'T1573' ELSE 'T1071' END AS technique_id FROM h WHERE rn = 1""")
def beacon_multi(lake):
    out = pk.beacon_multi(lake.flows, "flow_id", "bytes_out", window_us=120 * MIN, min_samples=4, max_jitter_pct=40.0)
    return out.withColumns({"mean_s": F.round("mean_s", 7), "jitter_pct": F.round("jitter_pct", 3), "off_hours_pct": F.round("off_hours_pct", 2)})
