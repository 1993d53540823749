"""Per-key event-time operators that stay parallel inside one key.

A key (host, rule, source address) may hold a large share of all rows, so nothing here groups by
the key alone. The timeline is cut into slices and the work is grouped by (key, slice):

* ``sliding``      sliding frames: each row is also sent to the later slices its frame reaches
* ``running_sum``  running totals: per-slice totals are accumulated first, rows second
* ``anchors``      "first, then nothing until TTL later" chains: each slice is summarised as a
                   small step function from the state at its start to the state at its end, the
                   summaries are chained, and the slices are then resolved independently

All times are BIGINT microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
KEY, SLICE, TS = "_key", "_slice", "_ts"


def key_column(keys: Sequence[str | Column]) -> Column:
    """One string per key tuple; NULL and '' stay apart."""
    parts = []
    for k in keys:
        c = F.col(k) if isinstance(k, str) else k
        parts.append(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")))
    return F.concat_ws("\x01", *parts)


def slice_of(ts: Column, width_us: int) -> Column:
    return F.floor(ts / F.lit(width_us)).cast("long")


def unpack_key(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns of a packed key, in the order the key was packed."""
    parts = F.split(KEY, "\x01")
    cols = {}
    for i, (name, kind) in enumerate(types.items()):
        part = F.get(parts, F.lit(i))
        cols[name] = F.when(part.startswith("="), F.substr(part, F.lit(2))).cast(kind)
    return df.withColumns(cols).drop(KEY)


def busy_rows(df: DataFrame, keys: Sequence[str], measure: Column, floor) -> DataFrame:
    """Rows of keys whose aggregate reaches ``floor``: the only ones that can pass a later test.

    The aggregate is combined map-side; what it leaves out never reaches the costlier steps.
    """
    busy = df.groupBy(*keys).agg(measure.alias("_m")).where(F.col("_m") >= floor).select(*keys)
    return df.join(busy, list(keys), "left_semi")


# ------------------------------------------------------------------------------ sliding frames


def sliding(df: DataFrame, ts: str, reach_us: int, slice_us: int | None = None) -> DataFrame:
    """Add ``_slice`` and ``_own``; rows are repeated in every slice their frame reaches.

    A frame of the last ``reach_us`` microseconds evaluated over (key, _slice) is exact for the
    rows with ``_own``; drop the others afterwards. With slices of several reaches the
    repetition is a small share of the rows.
    """
    width = slice_us or max(4 * reach_us, 1)
    first = slice_of(F.col(ts), width)
    last = slice_of(F.col(ts) + F.lit(reach_us), width)
    return (
        df.withColumn(SLICE, F.explode(F.sequence(first, last)))
        .withColumn("_own", F.col(SLICE) == slice_of(F.col(ts), width))
    )


def sliding_window(keys: Sequence[str], ts: str, reach_us: int) -> Window:
    """The frame [t - reach, t] for use on the output of ``sliding``."""
    return Window.partitionBy(*keys, SLICE).orderBy(ts).rangeBetween(-reach_us, 0)


# ------------------------------------------------------------------------------ running totals


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, values: dict[str, Column], slice_us: int
) -> DataFrame:
    """Running totals per key in (ts, order) order, current row included.

    ``values`` maps new column names to the numbers summed. Only per-slice totals are ever
    ordered per key; rows are ordered inside (key, slice).
    """
    staged = df.withColumn(SLICE, slice_of(F.col(ts), slice_us)).withColumn(KEY, key_column(keys))
    staged = staged.withColumns({f"_v_{n}": c for n, c in values.items()})
    totals = staged.groupBy(KEY, SLICE).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = Window.partitionBy(KEY).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        KEY, SLICE, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in values]
    )
    inside = Window.partitionBy(KEY, SLICE).orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    out = staged.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(inside) for n in values}).join(carried, [KEY, SLICE])
    out = out.withColumns({n: F.col(f"_r_{n}") + F.col(f"_c_{n}") for n in values})
    return out.drop(KEY, SLICE, *[f"{p}{n}" for n in values for p in ("_v_", "_r_", "_c_")])


# ------------------------------------------------------------------------------ anchor chains


def _run_starts(*columns: pa.Array) -> np.ndarray:
    """Positions where any of the columns changes from the row before."""
    n = len(columns[0])
    changed = np.zeros(n, dtype=bool)
    changed[:1] = True
    for c in columns:
        if n > 1:
            changed[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Re-cut key-sorted Arrow batches so that no group is split between two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        starts = _run_starts(*[batch.column(k) for k in keys])
        same = held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys)
        cut = int(starts[-1]) if len(starts) > 1 else (0 if not same else -1)
        if cut < 0:
            held.append(batch)
            continue
        ready = held + ([batch.slice(0, cut)] if cut else [])
        if ready:
            yield pa.Table.from_batches(ready).combine_chunks()
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _flat(table: pa.Table, name: str):
    col = table.column(name)
    return col.chunk(0) if col.num_chunks == 1 else pa.concat_arrays(col.chunks)


def _next_kept(group: np.ndarray, ts: np.ndarray, ttl: int, width: int) -> np.ndarray:
    """For each sorted tick, the position of the tick kept after it in the same group, or itself."""
    span = width + ttl + 2
    code = group * span + np.mod(ts, width)
    nxt = np.searchsorted(code, code + ttl, side="left")
    at = np.arange(len(ts))
    inside = nxt < len(ts)
    nxt = np.where(inside, nxt, at)
    return np.where(group[nxt] == group, nxt, at)


def _summarise(ttl: int, width: int):
    """(key, slice, tick)* -> (key, slice, upto, leave)*: entering at or before ``upto`` leaves with ``leave``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, (KEY, SLICE)):
            key, sl = _flat(t, KEY), _flat(t, SLICE)
            ts = _flat(t, TS).to_numpy()
            starts = _run_starts(key, sl)
            group = np.zeros(len(ts), dtype=np.int64)
            group[starts[1:]] = 1
            group = np.cumsum(group)
            step = _next_kept(group, ts, ttl, width)
            while True:
                jump = step[step]
                if np.array_equal(jump, step):
                    break
                step = jump
            leave = ts[step]
            last_of_run = np.ones(len(ts), dtype=bool)
            last_of_run[:-1] = (group[1:] != group[:-1]) | (leave[1:] != leave[:-1])
            # an entry threshold never lies more than one TTL past the slice start
            reach = np.mod(ts, width) >= ttl
            first_beyond = np.zeros(len(ts), dtype=bool)
            first_beyond[starts] = True
            first_beyond[1:] |= reach[1:] & ~reach[:-1]
            keep = last_of_run & (~reach)
            keep |= reach & first_beyond
            idx = np.flatnonzero(keep)
            yield from pa.table(
                {KEY: key.take(pa.array(idx)), SLICE: sl.take(pa.array(idx)), "_upto": ts[idx], "_leave": leave[idx]}
            ).to_batches()

    return run


def _chain(ttl: int):
    """Walk the summaries of each key in slice order; emit the last kept tick before each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, slice_now, last, settled = None, None, None, False
        for b in batches:
            keys, slices = [], []
            entries: list[int | None] = []
            rows = zip(b.column(KEY).to_pylist(), b.column(SLICE).to_pylist(), b.column("_upto").to_pylist(), b.column("_leave").to_pylist())
            for key, sl, upto, leave in rows:
                if key != key_now:
                    key_now, slice_now, last = key, None, None
                if sl != slice_now:
                    slice_now, settled = sl, False
                    keys.append(key)
                    slices.append(sl)
                    entries.append(last)
                if not settled and (last is None or upto >= last + ttl):
                    last, settled = leave, True
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(slices, pa.int64()), pa.array(entries, pa.int64())],
                names=[KEY, SLICE, "_entry"],
            )

    return run


def _resolve(ttl: int, width: int):
    """(key, slice, entry row, ticks)* -> the kept ticks of every slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, (KEY, SLICE)):
            key, sl = _flat(t, KEY), _flat(t, SLICE)
            kind = _flat(t, "_kind").to_numpy()
            value = pc.fill_null(_flat(t, TS), np.iinfo(np.int64).min).to_numpy()
            group = np.zeros(len(value), dtype=np.int64)
            starts = _run_starts(key, sl)
            group[starts[1:]] = 1
            group = np.cumsum(group)
            entry = np.full(len(starts), np.iinfo(np.int64).min)
            entry[group[kind == 0]] = value[kind == 0]
            is_tick = kind == 1
            ts, g, row = value[is_tick], group[is_tick], np.flatnonzero(is_tick)
            if len(ts) == 0:
                continue
            step = _next_kept(g, ts, ttl, width)
            # first tick of each group at or after entry + TTL
            span = width + ttl + 2
            offset = np.mod(ts, width)
            code = g * span + offset
            present = np.unique(g)
            floor_ = ts[np.searchsorted(g, present)] - offset[np.searchsorted(g, present)]
            e = entry[present]
            late = np.where(e == np.iinfo(np.int64).min, 0, np.clip(e + ttl - floor_, 0, span - 1))
            start = np.searchsorted(code, present * span + late, side="left")
            ok = (start < len(ts)) & (g[np.minimum(start, len(ts) - 1)] == present)
            frontier = start[ok]
            kept = np.zeros(len(ts), dtype=bool)
            while len(frontier):
                kept[frontier] = True
                nxt = step[frontier]
                frontier = nxt[nxt != frontier]
            idx = row[kept]
            yield from pa.table({KEY: key.take(pa.array(idx)), SLICE: sl.take(pa.array(idx)), "anchor_us": value[idx]}).to_batches()

    return run


def anchors(df: DataFrame, keys: Sequence[str], ts: str, ttl_us: int, slice_us: int | None = None) -> DataFrame:
    """Kept ticks (_key, anchor_us) of the greedy chain: keep, then skip until ``ttl_us`` later.

    Only (key, slice, tick) travels to the tasks. A slice of several TTLs has few distinct ways
    to leave it, so the summaries that are chained per key are small.
    """
    width = max(slice_us or 8 * ttl_us, ttl_us)
    ticks = (
        df.where(F.col(ts).isNotNull())
        .select(key_column(keys).alias(KEY), slice_of(F.col(ts), width).alias(SLICE), F.col(ts).cast("long").alias(TS))
    )
    summaries = (
        ticks.repartition(KEY, SLICE)
        .sortWithinPartitions(KEY, SLICE, TS)
        .mapInArrow(_summarise(ttl_us, width), f"{KEY} string, {SLICE} long, _upto long, _leave long")
    )
    entries = (
        summaries.repartition(KEY)
        .sortWithinPartitions(KEY, SLICE, "_upto")
        .mapInArrow(_chain(ttl_us), f"{KEY} string, {SLICE} long, _entry long")
    )
    both = ticks.select(KEY, SLICE, F.lit(1).alias("_kind"), TS).unionByName(
        entries.select(KEY, SLICE, F.lit(0).alias("_kind"), F.col("_entry").alias(TS))
    )
    return (
        both.repartition(KEY, SLICE)
        .sortWithinPartitions(KEY, SLICE, "_kind", TS)
        .mapInArrow(_resolve(ttl_us, width), f"{KEY} string, {SLICE} long, anchor_us long")
        .select(KEY, "anchor_us")
    )


def assign_anchor(
    df: DataFrame, kept: DataFrame, keys: Sequence[str], ts: str, reach_us: int, how: str = "inner"
) -> DataFrame:
    """Give each row the anchor of its key at most ``reach_us`` before it (end exclusive).

    Anchors of a key are at least ``reach_us`` apart, so a row meets at most one. The join is on
    (key, bucket) with buckets of one reach, so a bucket holds no more than three anchors.
    """
    left = df.withColumn(KEY, key_column(keys)).withColumn("_b", slice_of(F.col(ts), reach_us))
    right = kept.select(
        KEY, "anchor_us",
        F.explode(F.sequence(slice_of(F.col("anchor_us"), reach_us), slice_of(F.col("anchor_us") + F.lit(reach_us - 1), reach_us))).alias("_b"),
    )
    l, r = left.alias("l"), right.alias("r")
    hit = (
        (F.col(f"l.{KEY}") == F.col(f"r.{KEY}"))
        & (F.col("l._b") == F.col("r._b"))
        & (F.col(f"l.{ts}") >= F.col("r.anchor_us"))
        & (F.col(f"l.{ts}") < F.col("r.anchor_us") + F.lit(reach_us))
    )
    return l.join(r, hit, how).select("l.*", "r.anchor_us").drop("_b")


def first_in_ttl(
    df: DataFrame, keys: Sequence[str], ts: str, order_id: str, ttl_us: int, slice_us: int | None = None
) -> DataFrame:
    """Rows kept by the greedy chain; among rows of one key at one instant the lowest id is kept."""
    kept = anchors(df, keys, ts, ttl_us, slice_us)
    cols = df.columns
    hit = df.withColumn(KEY, key_column(keys)).join(
        kept.withColumnRenamed("anchor_us", "_a").withColumnRenamed(KEY, "_k"),
        (F.col(KEY) == F.col("_k")) & (F.col(ts) == F.col("_a")),
        "left_semi",
    )
    return hit.groupBy(KEY, ts).agg(F.min_by(F.struct(*cols), F.col(order_id)).alias("_r")).select("_r.*")
