"""Keeping tables: upserts, bulk imports, expiry, retention, counters, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def last_write_wins(df: DataFrame, keys: Sequence[str], arrival: Column) -> DataFrame:
    """Latest row per key; partial aggregates keep hot keys off a single task."""
    row = F.struct(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max_by(row, arrival).alias("_r")).select("_r.*")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], arrival: str | None = None) -> DataFrame:
    """old merged with new; new rows win, and among new rows the latest arrival."""
    seq = F.col(arrival) if arrival else F.lit(0)
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return last_write_wins(both, keys, F.struct(F.col("_gen"), seq)).drop("_gen")


def insert_new(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``, first per key."""
    first = last_write_wins(new, keys, -F.col(order))
    return first.join(old.select(*keys), list(keys), "left_anti")


def import_counts(new: DataFrame, created: DataFrame) -> DataFrame:
    """How many rows of a batch were created and how many skipped."""
    made = created.agg(F.count("*")).scalar()
    return new.agg(F.count("*").alias("given")).select(made.alias("created"), (F.col("given") - made).alias("skipped"))


def patch(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Full outer merge that overwrites only the columns the new row carries."""
    n = new.select(F.col(key).alias("_nk"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    joined = old.join(n, F.col(key) == F.col("_nk"), "full_outer")
    out = [F.coalesce(F.col(key), F.col("_nk")).alias(key)]
    out += [F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) for c in columns]
    return joined.select(*out)


def expire_iocs(iocs: DataFrame, now_us: int, stale_days: int = 90) -> DataFrame:
    """Deactivate expired and, unless ``stale_days`` is 0, long-unseen indicators."""
    dead = F.coalesce(F.col("expires_us") <= now_us, F.lit(False))
    if stale_days:
        dead = dead | F.coalesce(F.coalesce("last_hit_us", "created_us") < now_us - stale_days * DAY_US, F.lit(False))
    return iocs.withColumn("is_active", F.col("is_active") & ~dead)


def increment_hits(table: DataFrame, hits: DataFrame, key: str, count_col: str, last_col: str | None = None) -> DataFrame:
    """Add hit counts (and the latest hit time) to a table; hits are pre-aggregated per key."""
    aggs = [F.count("*").alias("_n")] + ([F.max("time_us").alias("_last")] if last_col else [])
    per = hits.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hk")).agg(*aggs)
    out = table.join(per, F.col(key) == F.col("_hk"), "left").withColumn(count_col, F.coalesce(count_col, F.lit(0)) + F.coalesce("_n", F.lit(0)))
    if last_col:
        out = out.withColumn(last_col, F.greatest(last_col, "_last"))
    return out.drop("_hk", "_n", "_last")


def retention_predicates(now_us: int, detections_days: int = 365, incidents_days: int = 730, iocs_days: int = 180) -> dict[str, Column]:
    def old(col: str, days: int) -> Column:
        return F.coalesce(F.col(col) < now_us - days * DAY_US, F.lit(False))

    return {
        "detections": old("time_us", detections_days),
        "incidents": F.col("status").isin("resolved", "closed") & old("closed_us", incidents_days),
        "iocs": old("expires_us", iocs_days),
    }


def tier(age_days: Column, hot: int, delete: int) -> Column:
    return F.when(age_days >= delete, "delete").when(age_days >= hot, "warm").otherwise("hot")


def agent_status(last_seen_us: Column, status: Column, now_us: int) -> Column:
    idle = F.lit(now_us) - last_seen_us
    return (F.when(last_seen_us.isNull() | (idle >= 600_000_000), "offline")
            .when((idle >= 120_000_000) & (status == "online"), "degraded").otherwise(status))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Create / Modify / Delete between two snapshots."""
    b = before.select(F.col(key).alias("_bk"), F.col(value).alias("before"))
    a = after.select(F.col(key).alias("_ak"), F.col(value).alias("after"))
    change = F.when(F.col("_bk").isNull(), "Create").when(F.col("_ak").isNull(), "Delete").when(F.col("before") != F.col("after"), "Modify")
    out = b.join(a, F.col("_bk") == F.col("_ak"), "full_outer")
    return out.select(F.coalesce("_bk", "_ak").alias(key), change.alias("change"), "before", "after").where(F.col("change").isNotNull())
