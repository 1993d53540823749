"""Changing stored tables: rows are deleted or updated by replacing only the days that hold one of them.

A table is a catalogue table partitioned by the text column ``day``. Where a table has very many days, several
share a folder: ``day`` is then the month, year, decade and so on, the beginning of the date that gives at most
FOLDERS of them, and stands for the day in all that follows. The rows that stay are written to the
shared checkpoint folder first, then replace the touched days, so a run that is cut off can be repeated and
files of other days are neither read in full nor written. What the driver sees is a row per day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.session import settle

DAY, UNDATED = "day", "undated"
FOLDERS = 500  # a table has at most so many days; else longer periods take their place
DATE, PERIODS = 10, (7, 4, 3, 2, 1, 0)  # characters of a date: day; month, year, decade, century, millennium, all
SALTS = 64  # a day is spread over up to so many files
FILE_ROWS = 250_000  # of about so many rows
DROPPED = 500  # days that one statement drops


def day_of(time_us: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_micros(time_us), "yyyy-MM-dd"), F.lit(UNDATED))


def _spread(rows: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Dealt out for writing; most: rows of the largest day, if known."""
    salts = SALTS if most is None else min(SALTS, 1 + most // FILE_ROWS)
    return rows.repartition(DAY, F.pmod(F.xxhash64(key), F.lit(salts)))


def _beginning(day: Column, length: int) -> Column:
    """The first characters of a date; 'undated' stays, and what is left of none is 'all'."""
    return F.when(day == UNDATED, day).otherwise(F.left(day, F.lit(length)) if length else F.lit("all"))


def _period(days: DataFrame) -> tuple[int, int]:
    """days(day, rows) -> how many characters of a date give at most FOLDERS periods, and the rows of the largest period."""
    lengths = (DATE, *PERIODS)
    counts = days.agg(F.count("*"), *[F.count_distinct(_beginning(F.col(DAY), n)) for n in PERIODS]).first()
    length = next((n for n, c in zip(lengths, counts) if c <= FOLDERS), 0)
    part = F.col(DAY) if length == DATE else _beginning(F.col(DAY), length)
    return length, days.groupBy(part.alias("_part")).agg(F.sum("rows").alias("rows")).agg(F.max("rows")).first()[0] or 0


def create(rows: DataFrame, table: str, key: str, time_us: str = "time_us") -> None:
    """A new table of these rows, by day or, where there are too many days, by a longer period; rows without a time lie under 'undated'."""
    day = day_of(F.col(time_us))
    length, most = _period(settle(rows.select(day.alias(DAY)).groupBy(DAY).agg(F.count("*").alias("rows"))))
    part = day if length == DATE else _beginning(day, length)
    _spread(rows.withColumn(DAY, part), key, most).write.partitionBy(DAY).format("parquet").saveAsTable(table)


def _replace(spark: SparkSession, table: str, rows: DataFrame, key: str, most: int | None = None) -> None:
    """The days that occur in ``rows`` (in the order of the table's columns) get these rows; the others stay as they are."""
    mode, rows = "spark.sql.sources.partitionOverwriteMode", settle(rows)
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")  # insertInto knows no option for it
    try:
        _spread(rows, key, most).write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(mode, before)
    spark.catalog.refreshTable(table)


def delete_rows(spark: SparkSession, table: str, dead: Column, key: str = "id") -> DataFrame:
    """Delete the rows for which ``dead`` is true (not null) -> day, deleted, kept of each touched day.

    Days that lose all rows are dropped with their files. Nothing to delete: no day is written and no row returned.
    """
    gone = F.coalesce(dead, F.lit(False))
    stored = spark.table(table)
    counts = settle(stored.groupBy(DAY).agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept")).where("deleted > 0"))
    days = counts.collect()
    part = [r[DAY] for r in days if r["kept"]]
    if part:
        _replace(spark, table, stored.where(F.col(DAY).isin(part) & ~gone), key, max(r["kept"] for r in days))
    empty = [f"PARTITION ({DAY} = '{r[DAY]}')" for r in days if not r["kept"]]
    for at in range(0, len(empty), DROPPED):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {', '.join(empty[at : at + DROPPED])}")
    return counts


def update_rows(spark: SparkSession, table: str, changes: DataFrame, key: str = "id") -> DataFrame:
    """Set columns by key -> one row: updated (rows of the table), not_found (keys of ``changes`` that it lacks).

    ``changes`` holds the key and the columns to set; a null leaves the stored value. Of several changes of a key
    the greatest counts (compared column by column); a null key is no change. The day of a row stays.
    """
    columns = [c for c in changes.columns if c != key]
    one = changes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*columns)).alias("_set"))
    one = settle(one)
    stored = spark.table(table)
    found = settle(stored.select(key, DAY).join(one, F.col(key) == F.col("_key"), "left_semi"))
    days = [r[DAY] for r in found.select(DAY).distinct().collect()]
    absent = one.join(found, F.col("_key") == F.col(key), "left_anti").agg(F.count("*")).scalar()
    done = settle(found.agg(F.count("*").alias("updated")).select("updated", absent.alias("not_found")))
    if days:
        touched = stored.where(F.col(DAY).isin(days)).join(one, F.col(key) == F.col("_key"), "left")
        _replace(spark, table, touched.select(*[F.coalesce(f"_set.{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns]), key)
    return done
