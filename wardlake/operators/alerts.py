"""From rule matches to deduplicated, enriched, scored and correlated alerts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions import scoring
from wardlake.operators import enrich, rules
from wardlake.operators import timeline as tl

ALERT_TTL_US = 300 * tl.SECOND
NDR_TTL_US = 1800 * tl.SECOND
DAY_US = 86_400 * tl.SECOND


def rule_alerts(ev: DataFrame, rule_list: Iterable[rules.Rule]) -> DataFrame:
    """Alert rows of every (event, rule) match; addresses, names, hashes and URLs that the events carry go along."""
    hits = rules.detect(ev, rule_list)
    also = [F.col(c) if c in ev.columns else F.lit(None).cast("string").alias(c) for c in ("url", "hash_md5", "hash_sha256")]
    return hits.select(
        F.md5(F.concat_ws("|", F.col("id").cast("string"), "rule_id")).alias("alert_id"), F.col("id").alias("event_id"), "time_us",
        "rule_id", "rule_title", "level", F.col("alert_severity").alias("severity_id"), "technique_ids", "tactic_ids",
        F.coalesce("hostname", "dst_ip", F.lit("")).alias("host"), "src_ip", "dst_ip", "domain", "process_hash", *also)


def dedup_key(rule_id: Column, host: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(rule_id, F.lit("")), F.coalesce(host, F.lit(""))))


def recurrence(det: DataFrame, keys: list[str], window_s: int = 86_400, history: DataFrame | None = None) -> DataFrame:
    """Earlier detections of the same key in [t - window, t), at second resolution; those of history(*keys, time_us) count too.

    Rows are counted per (key, second) first, so a key contributes at most one row per second to
    the sliding frame whatever its volume.
    """
    sec = F.floor(F.col("time_us") / tl.SECOND).cast("long")
    d = det.withColumn("_sec", sec).withColumn(tl.KEY, tl.key_column(keys))
    seen = d.select(tl.KEY, "_sec")
    if history is not None:
        seen = seen.unionAll(history.select(tl.key_column(keys).alias(tl.KEY), sec.alias("_sec")))
    per = seen.groupBy(tl.KEY, "_sec").agg(F.count("*").alias("_n"))
    from pyspark.sql import Window

    spread = tl.sliding(per, "_sec", window_s, window_s)
    frame = Window.partitionBy(tl.KEY, tl.SLICE).orderBy("_sec").rangeBetween(-window_s, -1)
    counted = spread.withColumn("recurrence", F.coalesce(F.sum("_n").over(frame), F.lit(0))).where("_own").select(tl.KEY, "_sec", "recurrence")
    return d.join(counted, [tl.KEY, "_sec"]).drop(tl.KEY, "_sec")


def enrich_alerts(alerts: DataFrame, assets: DataFrame, iocs: DataFrame, geo: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Criticality, recurrence (over history too), indicator matches and geography beside each alert."""
    matched = enrich.ioc_match(alerts, iocs, enrich.row_candidates(alerts, "host"), "alert_id").groupBy(F.col("alert_id").alias("_mid")).agg(F.count("*").alias("_matches"))
    from wardlake.functions.net import public_ips

    places = enrich.geo_enrich(alerts, geo, public_ips(F.col("host"), F.col("src_ip"), F.col("dst_ip")), "alert_id").select(
        F.col("alert_id").alias("_gid"), F.col("country").alias("geo_country"))
    out = enrich.asset_criticality(alerts, assets).withColumn("asset_criticality", (F.col("criticality") - 1) / 4).drop("criticality")
    out = recurrence(out, ["rule_id", "host"], history=history)
    out = out.join(matched, F.col("alert_id") == F.col("_mid"), "left").join(places, F.col("alert_id") == F.col("_gid"), "left")
    return out.withColumn("ti_boost", enrich.ti_boost(F.coalesce("_matches", F.lit(0)))).drop("_mid", "_gid", "_matches")


def score_alerts(enriched: DataFrame) -> DataFrame:
    return enriched.withColumn("score", scoring.risk_score(F.col("severity_id"), F.col("asset_criticality"), F.col("recurrence"), F.col("ti_boost")))


def alert_to_detection(alerts: DataFrame) -> DataFrame:
    """Persisted form: first technique and tactic or 'unknown'; texts are kept whole."""
    tech, tac = F.get("technique_ids", F.lit(0)), F.get("tactic_ids", F.lit(0))
    return alerts.select(
        F.col("alert_id").alias("id"), F.coalesce(tech, F.lit("unknown")).alias("technique_id"),
        F.col("rule_title").alias("technique_name"), F.coalesce(tac, F.lit("unknown")).alias("tactic"),
        tac.alias("tactic_id"), F.col("rule_title").alias("name"), "host", "time_us", F.col("level").alias("severity"),
        F.when(F.length("rule_id") > 0, F.col("rule_id")).alias("rule_name"))


def merge_detections(det: DataFrame, keys: list[str], ttl_us: int = DAY_US) -> DataFrame:
    """Occurrences of a key inside the TTL of its first one become one detection with a count."""
    kept = tl.anchors(det, keys, "time_us", ttl_us)
    grouped = tl.assign_anchor(det, kept, keys, "time_us", ttl_us)
    first = F.min_by(F.struct("id", "severity"), F.struct("time_us", "id"))
    out = grouped.groupBy(*keys, "anchor_us").agg(F.count("*").alias("occurrences"), first.alias("f"))
    return out.select(*keys, "anchor_us", "occurrences", "f.id", "f.severity", scoring.merged_score(F.col("f.severity"), F.col("occurrences")).alias("score"))


def correlate(det: DataFrame, window_us: int = 3600 * tl.SECOND, floor: str = "high") -> DataFrame:
    """(detection, incident) links per (host, tactic).

    An incident is opened by a detection of at least ``floor`` severity when none was opened in
    the window before it; every detection of the key within the window of the opening joins it.
    The link table stays long, so an incident may have any number of detections.
    """
    keys = ["host", "tactic"]
    usable = det.where((F.length("host") > 0) & (F.length("tactic") > 0) & F.col("id").isNotNull())
    reach = window_us + 1  # the window end is inclusive
    openers = tl.anchors(usable.where(scoring.at_least(F.col("severity"), floor)), keys, "time_us", reach)
    linked = tl.assign_anchor(usable, openers, keys, "time_us", reach)
    return linked.withColumn("incident_id", F.md5(F.concat_ws("|", "host", "tactic", F.col("anchor_us").cast("string"))))


def stale(det: DataFrame, cutoff_us: int) -> DataFrame:
    """Active detections whose (rule, host) has not fired since the cutoff (NOT EXISTS)."""
    fresh = det.where((F.col("time_us") >= cutoff_us) & F.col("rule_name").isNotNull()).select("rule_name", "host").distinct()
    return det.where((F.col("status") == "active") & F.col("rule_name").isNotNull() & (F.col("time_us") < cutoff_us)).join(fresh, ["rule_name", "host"], "left_anti")
