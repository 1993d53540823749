"""Incidents and their detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlake.operators import timeline as tl

STATUS_ORDER = ["new", "investigating", "contained", "resolved", "closed"]


def links(inc: DataFrame) -> DataFrame:
    """(incident_id, position, detection_id)."""
    return inc.select(F.col("id").alias("incident_id"), F.posexplode("detection_ids").alias("pos", "detection_id"))


def detail(inc: DataFrame, det: DataFrame, now_us: int) -> DataFrame:
    """Incident with the detections that exist and its duration so far, never negative."""
    found = links(inc).join(det.select(F.col("id").alias("detection_id"), "severity", "technique_id"), "detection_id")
    per = found.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("pos", "detection_id", "severity"))).alias("detections"))
    secs = F.greatest(F.lit(0), F.floor((F.coalesce("closed_us", F.lit(now_us)) - F.col("created_us")) / 1_000_000)).cast("long")
    return inc.join(per, F.col("id") == F.col("incident_id"), "left").withColumn("duration_s", secs).drop("incident_id")


def from_detections(inc: DataFrame, det: DataFrame) -> DataFrame:
    """Technique, tactic and host lists of an incident's detections, unique in link order.

    A value's place is that of its first link; the lists hold distinct values only.
    """
    found = links(inc).join(det.select(F.col("id").alias("detection_id"), "technique_id", "tactic", "host"), "detection_id")
    facts = found.select("incident_id", "pos", F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in ("technique_id", "tactic", "host")])).alias("x"))
    first = facts.where("x.value IS NOT NULL").groupBy("incident_id", "x.what", "x.value").agg(F.min("pos").alias("pos"))
    lists = first.groupBy("incident_id").pivot("what", ["technique_id", "tactic", "host"]).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))))
    return lists.select("incident_id", *[F.transform(F.coalesce(c, F.array()), lambda s: s["value"]).alias(f"{c}s") for c in ("technique_id", "tactic", "host")])


def open_lookup(det: DataFrame, inc: DataFrame, window_us: int) -> DataFrame:
    """Latest open incident with the detection's host and tactic created at most ``window_us`` before it.

    An as-of join that holds nothing per key: detections and incidents are laid on one timeline
    and the last incident before each row is carried along within (host, tactic, slice); incidents
    are repeated in each slice their window reaches.
    """
    opened = inc.where(~F.col("status").isin("resolved", "closed")).select(
        F.explode(F.array_distinct("hosts")).alias("host"), "tactic_ids", F.col("created_us").alias("time_us"), F.col("id").alias("_inc"))
    opened = opened.select("host", F.explode(F.array_distinct("tactic_ids")).alias("tactic"), "time_us", "_inc")
    opened = tl.sliding(opened, "time_us", window_us).drop("_own").select("host", "tactic", tl.SLICE, "time_us", F.lit(0).alias("_kind"), "_inc", F.lit(None).cast("long").alias("id"))
    rows = det.select("host", "tactic", tl.slice_of(F.col("time_us"), 4 * window_us).alias(tl.SLICE), "time_us", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_inc"), "id")
    w = Window.partitionBy("host", "tactic", tl.SLICE).orderBy("time_us", "_kind", "_inc").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_kind") == 0, F.struct(F.col("time_us").alias("at"), F.col("_inc").alias("incident_id"))), ignorenulls=True).over(w)
    out = opened.unionByName(rows).withColumn("_l", last).where("_kind = 1 AND _l IS NOT NULL")
    return out.where(F.col("time_us") - F.col("_l.at") <= window_us).select("id", "_l.incident_id")


def timeline(inc: DataFrame) -> DataFrame:
    """Created and closed moments of an incident in order; notes join in where the table has them."""
    events = F.array(F.struct(F.col("created_us").alias("at"), F.lit("created").alias("what")), F.when(F.col("closed_us").isNotNull(), F.struct(F.col("closed_us").alias("at"), F.lit("closed").alias("what"))))
    if "notes" in inc.columns:
        events = F.concat(events, F.transform("notes", lambda n: F.struct(n["at"].alias("at"), n["text"].alias("what"))))
    return inc.select("id", F.explode(F.array_sort(F.filter(events, lambda x: x.isNotNull()))).alias("e")).select("id", "e.at", "e.what")


def transitions(log: DataFrame) -> DataFrame:
    """Status changes with the accepted status before and whether the move is accepted: it must not go back behind it.

    Rejected moves have a lower rank than the accepted one, so the highest rank so far is the accepted status.
    """
    names = F.array(*map(F.lit, STATUS_ORDER))
    w = Window.partitionBy("incident_id").orderBy("at_us", "change_id").rowsBetween(Window.unboundedPreceding, -1)
    out = log.withColumn("_rank", F.array_position(names, F.col("status")))
    out = out.withColumn("_before", F.max("_rank").over(w)).withColumn("previous", F.try_element_at(names, F.col("_before").cast("int")))
    out = out.withColumn("valid", F.coalesce(F.col("_rank") >= F.col("_before"), F.lit(True)))
    ends = F.col("status").isin("resolved", "closed") & F.col("valid")
    first_end = F.min(F.when(ends, F.col("at_us"))).over(Window.partitionBy("incident_id"))
    return out.withColumn("closed_us", F.when(ends & (F.col("at_us") == first_end), F.col("at_us"))).drop("_rank", "_before")
