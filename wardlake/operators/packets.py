"""Detectors over single connections: anchored port scans and debounced beacons."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.operators import timeline as tl
from wardlake.session import settle

FLOW_KEY = {"src_ip": "string", "dst_ip": "string", "dst_port": "int"}

# ---------------------------------------------------------------------------- anchored port scan
#
# A source's window starts at a packet and ends ``window`` later or when it has seen ``threshold``
# distinct ports, whichever is first. A window that ends by time is followed by one starting with
# (and counting) the next packet; one that fired is followed by a window starting at the firing
# packet without counting it. A state is therefore (packet, counted or not), and each state has
# one successor. As with anchor chains, every slice is summarised as a map from entry state to
# leave state, summaries are chained per source, and slices are resolved on their own.

COUNTED, FIRED = 0, 1
_STATE = "_kind int, _at long, _seq int"


def _successors(ts: np.ndarray, port: np.ndarray, window: int, threshold: int):
    """Per packet: where a window starting there fires if never timed out, and the first packet past it."""
    n = len(ts)
    lim = np.full(n, -1, dtype=np.int64)
    held: dict[int, int] = {}
    left = 0
    for j in range(n):
        held[port[j]] = held.get(port[j], 0) + 1
        while len(held) >= threshold:
            p = port[left]
            held[p] -= 1
            if not held[p]:
                del held[p]
            left += 1
        lim[j] = left - 1
    at = np.arange(n)
    return (
        np.searchsorted(lim, at, side="left"),
        np.searchsorted(lim, at + 1, side="left"),
        np.searchsorted(ts, ts + window, side="right"),
    )


def _next_state(i: int, kind: int, fire, fire_after, expire, n: int):
    f = fire[i] if kind == COUNTED else fire_after[i]
    return (FIRED, int(f)) if f < n and f < expire[i] else (COUNTED, int(expire[i]))


def _scan_summary(window: int, threshold: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tl.whole_groups(batches, (tl.KEY, tl.SLICE)):
            out: list[tuple] = []
            key, sl = t.column(tl.KEY), t.column(tl.SLICE)
            starts = list(tl._run_starts(tl._flat(t, tl.KEY), tl._flat(t, tl.SLICE))) + [len(t)]
            ts_all, port_all = tl._flat(t, tl.TS).to_numpy(), tl._flat(t, "_port").to_numpy()
            seq_all, own_all = tl._flat(t, "_seq").to_numpy(), tl._flat(t, "_own").to_numpy(zero_copy_only=False)
            for a, b in zip(starts, starts[1:]):
                ts, port, seq, own = ts_all[a:b], port_all[a:b], seq_all[a:b], own_all[a:b]
                mine = int(own.sum())  # own packets come first, look-ahead after
                if not mine:
                    continue
                fire, fire_after, expire = _successors(ts, port, window, threshold)
                n, leave = len(ts), {}
                for i in range(mine - 1, -1, -1):
                    for kind in (COUNTED, FIRED):
                        k2, j = _next_state(i, kind, fire, fire_after, expire, n)
                        if j < mine:
                            leave[i, kind] = leave[j, k2]
                        elif k2 == FIRED:
                            leave[i, kind] = (FIRED, int(ts[j]), int(seq[j]))
                        else:
                            leave[i, kind] = (COUNTED, int(ts[i]) + window + 1, 0)
                base = sl[a].as_py() * width
                last = min(mine, int(np.searchsorted(ts[:mine], base + window, side="right")) + 1)
                for kind in (COUNTED, FIRED):
                    for i in range(last):
                        if i + 1 == last or leave[i, kind] != leave[i + 1, kind]:
                            out.append((key[a].as_py(), sl[a].as_py(), kind, int(ts[i]), int(seq[i]), *leave[i, kind]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, ty) for c, ty in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))],
                    names=[tl.KEY, tl.SLICE, "_kind", "_at", "_seq", "_k2", "_at2", "_seq2"])

    return run


def _scan_chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            yield from zip(*[c.to_pylist() for c in b.columns])

    out: list[tuple] = []
    key_now, state = None, (COUNTED, -(1 << 62), 0)
    for (key, sl), group in groupby(rows(), key=lambda r: (r[0], r[1])):
        if key != key_now:
            key_now, state = key, (COUNTED, -(1 << 62), 0)
        out.append((key, sl, *state))
        entry = state
        for _, _, kind, at, seq, k2, at2, seq2 in group:
            if state is entry and kind == entry[0] and (at, seq) >= (entry[1], entry[2] if kind == FIRED else -1):
                state = (k2, at2, seq2)
        if len(out) >= 5000:
            yield _entries(out)
            out = []
    if out:
        yield _entries(out)


def _entries(out):
    types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out), types)], names=[tl.KEY, tl.SLICE, "_kind", "_at", "_seq"])


def _scan_resolve(window: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tl.whole_groups(batches, (tl.KEY, tl.SLICE)):
            out: list[tuple] = []
            starts = list(tl._run_starts(tl._flat(t, tl.KEY), tl._flat(t, tl.SLICE))) + [len(t)]
            cols = {c: tl._flat(t, c).to_numpy(zero_copy_only=False) for c in ("_row", "_kind", tl.TS, "_seq", "_port", "_own")}
            for a, b in zip(starts, starts[1:]):
                if cols["_row"][a] != 0 or b - a < 2:
                    continue
                kind, at, seq0 = int(cols["_kind"][a]), int(cols[tl.TS][a]), int(cols["_seq"][a])
                ts, seq, port, own = (cols[c][a + 1:b] for c in (tl.TS, "_seq", "_port", "_own"))
                ts, port = ts.astype(np.int64), port.astype(np.int64)
                mine, n = int(own.astype(bool).sum()), len(ts)
                fire, fire_after, expire = _successors(ts, port, window, threshold)
                i = int(np.searchsorted(ts[:mine], at, side="left"))
                if kind == FIRED:
                    while i < mine and (ts[i], seq[i]) < (at, seq0):
                        i += 1
                key = t.column(tl.KEY)[a].as_py()
                while i < mine:
                    k2, j = _next_state(i, kind, fire, fire_after, expire, n)
                    if k2 == FIRED:
                        out.append((key, int(ts[j]), int(seq[j]), int(ts[i])))
                    i, kind = j, k2
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, ty) for c, ty in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.int64()))],
                    names=[tl.KEY, "time_us", "_seq", "window_start_us"])

    return run


def port_scan(packets: DataFrame, order_id: str, threshold: int = 20, window_us: int = 60 * tl.SECOND, slice_us: int | None = None) -> DataFrame:
    """Firings per source: (src_ip, time_us, window_start_us, ports)."""
    width = max(slice_us or 16 * window_us, window_us + 1)
    # only sources that ever touch enough ports can fire
    busy = packets.select("src_ip", "dst_port").distinct().groupBy("src_ip").agg(F.count("*").alias("_n")).where(F.col("_n") >= threshold).select("src_ip")
    rows = packets.join(busy, "src_ip", "left_semi")
    tie = Window.partitionBy("src_ip", "time_us").orderBy(order_id)
    rows = rows.select(tl.key_column(["src_ip"]).alias(tl.KEY), F.col("time_us").cast("long").alias(tl.TS), F.col("dst_port").cast("long").alias("_port"),
                       F.row_number().over(tie).cast("int").alias("_seq"))
    home = tl.slice_of(F.col(tl.TS), width)
    rows = rows.withColumn(tl.SLICE, F.explode(F.sequence(tl.slice_of(F.col(tl.TS) - window_us, width), home))).withColumn("_own", F.col(tl.SLICE) == home)
    summary = (rows.repartition(tl.KEY, tl.SLICE).sortWithinPartitions(tl.KEY, tl.SLICE, tl.TS, "_seq")
               .mapInArrow(_scan_summary(window_us, threshold, width), f"{tl.KEY} string, {tl.SLICE} long, {_STATE}, _k2 int, _at2 long, _seq2 int"))
    entries = (summary.repartition(tl.KEY).sortWithinPartitions(tl.KEY, tl.SLICE, "_kind", "_at", "_seq")
               .mapInArrow(_scan_chain, f"{tl.KEY} string, {tl.SLICE} long, {_STATE}"))
    both = entries.select(tl.KEY, tl.SLICE, F.lit(0).alias("_row"), "_kind", F.col("_at").alias(tl.TS), "_seq", F.lit(0).cast("long").alias("_port"), F.lit(False).alias("_own")).unionByName(
        rows.select(tl.KEY, tl.SLICE, F.lit(1).alias("_row"), F.lit(0).alias("_kind"), tl.TS, "_seq", "_port", "_own"))
    fired = (both.repartition(tl.KEY, tl.SLICE).sortWithinPartitions(tl.KEY, tl.SLICE, "_row", tl.TS, "_seq")
             .mapInArrow(_scan_resolve(window_us, threshold), f"{tl.KEY} string, time_us long, _seq int, window_start_us long"))
    return tl.unpack_key(fired, {"src_ip": "string"}).select("src_ip", "time_us", "window_start_us", F.lit(threshold).alias("ports"))


# ---------------------------------------------------------------------------- beacons


def beacon_cv(packets: DataFrame, interval_s: float = 60.0, jitter_pct: float = 20.0, min_samples: int = 5, max_samples: int = 100) -> DataFrame:
    """First moment at which a flow's debounced contacts have a coefficient of variation within the limit.

    Debouncing leaves at most one sample per minimum gap, so what is ordered per flow is bounded by
    the length of the timeline, not by the traffic.
    """
    gap_us = int(interval_s * (1 - min(max(jitter_pct / 100, 0.0), 1.0)) * tl.SECOND)
    keys = list(FLOW_KEY)
    packets = tl.busy_rows(packets, keys, F.count("*"), min_samples)
    s = tl.unpack_key(tl.anchors(packets, keys, "time_us", gap_us), FLOW_KEY).withColumnRenamed("anchor_us", "time_us")
    w = Window.partitionBy(*keys).orderBy("time_us")
    last = w.rowsBetween(-(max_samples - 2), 0)
    s = s.withColumns({"_gap": (F.col("time_us") - F.lag("time_us").over(w)) / 1e6, "_i": F.row_number().over(w)})
    s = s.withColumns({"mean_s": F.avg("_gap").over(last), "_sd": F.stddev_pop("_gap").over(last), "samples": F.least("_i", F.lit(max_samples))})
    s = s.withColumn("cv", F.col("_sd") / F.col("mean_s"))
    hit = s.where((F.col("samples") >= min_samples) & (F.col("cv") <= jitter_pct / 100))
    return hit.groupBy(*keys).agg(F.min(F.struct("time_us", "samples", "mean_s", "cv")).alias("f")).select(*keys, "f.*")


def _contacts(gap_us: int, width: int, keys: list[str]):
    """(key, slice, time, id)* in order -> the contacts that count, one an instant, without their ids.

    A contact with none in the gap before it counts whatever came earlier, and settles those after it. The first
    ones of a slice, up to such a contact, depend on the slice before: all of them come out, as not sure. The
    contacts of the gap before the slice (not own) only tell which of its contacts those are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tl.whole_groups(batches, (*keys, tl.SLICE)):
            ts, own = tl._flat(t, tl.TS).to_numpy(), tl._flat(t, "_own").to_numpy(zero_copy_only=False)
            group = np.zeros(len(ts), dtype=np.int64)
            group[tl._run_starts(*[tl._flat(t, c) for c in (*keys, tl.SLICE)])[1:]] = 1
            group = np.cumsum(group)
            instant = np.ones(len(ts), dtype=bool)  # the lowest id comes first
            instant[1:] = (group[1:] != group[:-1]) | (ts[1:] != ts[:-1])
            row = np.flatnonzero(instant)
            ts, own, group = ts[row], own[row], group[row]
            alone = np.ones(len(ts), dtype=bool)
            alone[1:] = (group[1:] != group[:-1]) | (ts[1:] - ts[:-1] >= gap_us)
            row, ts, group, alone = row[own], ts[own], group[own], alone[own]
            if not len(ts):
                continue
            step = tl._next_kept(group, ts, gap_us, width)
            first = np.full(group[-1] + 1, len(ts))
            at = np.flatnonzero(alone)[::-1]
            first[group[at]] = at  # the last one written is the first of its group
            sure = np.arange(len(ts)) >= first[group]
            out = ~sure
            frontier = first[first < len(ts)]
            while len(frontier):
                out[frontier] = True
                following = step[frontier]
                frontier = following[following != frontier]
            taken = pa.array(row[out])
            yield from pa.table({**{k: tl._flat(t, k).take(taken) for k in keys}, "time_us": ts[out], "_size": tl._flat(t, "_size").take(taken),
                                 "_named": tl._flat(t, "_named").take(taken), "_sure": sure[out]}).to_batches()

    return run


def _debounced(packets: DataFrame, order_id: str, payload: str, min_gap_us: int, slice_us: int = 300 * tl.SECOND) -> DataFrame:
    """(key, time_us, _size): contacts that follow the last one that counts after the gap or later, of an instant the lowest id.

    Packets meet by (key, slice) once, and only that exchange carries ids. Contacts that a slice can't
    judge are few unless a key is never silent for the gap; such keys alone go through the chain of slices.
    """
    keys = list(FLOW_KEY)
    width = max(slice_us, min_gap_us)
    usable = packets.where(F.col("time_us").isNotNull()).dropna(subset=keys)
    rows = usable.select(*keys, F.col("time_us").cast("long").alias(tl.TS), F.col(order_id).alias("_id"), F.col(payload).alias("_size"))
    spread = tl.sliding(rows, tl.TS, min_gap_us, width).drop("_own").repartition(*keys, tl.SLICE)
    own = F.col(tl.SLICE) == tl.slice_of(F.col(tl.TS), width)  # told by the time, so it need not travel
    spread = spread.sortWithinPartitions(*keys, tl.SLICE, tl.TS, F.col("_id").asc_nulls_last()).select(*keys, tl.SLICE, tl.TS, F.col("_size").cast("double").alias("_size"), F.col("_id").isNotNull().alias("_named"), own.alias("_own"))
    found = settle(spread.mapInArrow(_contacts(min_gap_us, width, keys), ", ".join([*[f"{k} {t}" for k, t in FLOW_KEY.items()], "time_us long, _size double, _named boolean, _sure boolean"])))
    open_keys = settle(found.where("NOT _sure").select(*keys).distinct())
    if not open_keys.isEmpty():
        chained = found.join(open_keys, keys, "left_semi")
        kept = tl.anchors(chained, keys, "time_us", min_gap_us, slice_us).select(F.col(tl.KEY).alias("_k"), F.col("anchor_us").alias("_a"))
        chained = chained.withColumn(tl.KEY, tl.key_column(keys)).join(kept, (F.col(tl.KEY) == F.col("_k")) & (F.col("time_us") == F.col("_a")), "left_semi").drop(tl.KEY)
        found = found.join(open_keys, keys, "left_anti").unionByName(chained)
    return found.where("_named").select(*keys, "time_us", "_size")


_REGULAR = "time_us long, samples int, mean_s double, jitter_pct double, steady_payload boolean, _off long"


def _moments(x: np.ndarray) -> tuple[float, float]:
    """Mean and standard deviation, added up from left to right."""
    mean = np.add.accumulate(x)[-1] / len(x)
    return mean, np.sqrt(np.add.accumulate((x - mean) * (x - mean))[-1] / len(x))


def _first_regular(window_us: int, min_samples: int, max_jitter_pct: float, max_samples: int, keys: list[str]):
    """(key, slice, contact)* in order -> the off-hours contacts of each key and slice and its first own contact at which the last contacts are regular.

    Running sums of the gaps and their squares rule out nearly all contacts; the others are computed from their gaps.
    """

    def hit(ts: np.ndarray, size: np.ndarray, off: np.ndarray, own: np.ndarray) -> tuple | None:
        n = len(ts)
        low = np.maximum(np.searchsorted(ts, ts - window_us, side="left"), np.arange(n) - (max_samples - 1))
        samples = np.arange(n) - low + 1
        maybe = own & (samples >= min_samples) & (samples >= 2)
        if not maybe.any():
            return None
        gaps = np.diff(ts, prepend=ts[:1]) / 1e6
        squares = np.cumsum(gaps * gaps)
        m = np.maximum(samples - 1, 1)
        mean = (ts - ts[low]) / 1e6 / m
        var = (squares - squares[low]) / m - mean * mean
        maybe &= (mean > 0) & (var <= (max_jitter_pct / 100 * mean) ** 2 * (1 + 1e-6) + 1e-11 * (squares + mean * mean))
        for i in np.flatnonzero(maybe):
            span = slice(low[i], i + 1)
            g_mean, g_sd = _moments(np.diff(ts[span]) / 1e6)
            if not (g_mean > 0 and g_sd / g_mean * 100 < max_jitter_pct):
                continue
            sizes = size[span][size[span] > 0]
            steady = False
            if len(sizes) >= 2:
                p_mean, p_sd = _moments(sizes)
                steady = bool(p_sd / p_mean < 0.20)
            return int(ts[i]), int(samples[i]), float(g_mean), float(g_sd / g_mean * 100), steady, int(off[i])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tl.whole_groups(batches, (*keys, tl.SLICE)):
            ts, off, own = (tl._flat(t, c).to_numpy(zero_copy_only=False) for c in (tl.TS, "_off", "_own"))
            size = pc.fill_null(tl._flat(t, "_size"), 0.0).to_numpy(zero_copy_only=False)
            starts = tl._run_starts(*[tl._flat(t, c) for c in (*keys, tl.SLICE)])
            ends = np.append(starts[1:], len(ts))
            mine = (off & own).astype(np.int64)  # own contacts count in one slice each
            totals = np.add.reduceat(mine, starts)
            found = [hit(ts[a:b], size[a:b], np.cumsum(mine[a:b]), own[a:b]) if b - a >= min_samples else None for a, b in zip(starts, ends)]
            wanted = [i for i, f in enumerate(found) if f is not None or totals[i]]
            if wanted:
                at = pa.array(starts[wanted])
                columns = [*[tl._flat(t, k).take(at) for k in (*keys, tl.SLICE)], pa.array(totals[wanted])]
                for values, kind in zip(zip(*(found[i] or (None,) * 6 for i in wanted)), (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.int64())):
                    columns.append(pa.array(list(values), kind))
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, tl.SLICE, "_offs", *[c.split(" ")[0] for c in _REGULAR.split(", ")]])

    return run


def beacon_multi(packets: DataFrame, order_id: str, payload: str, window_us: int = 3600 * tl.SECOND, min_samples: int = 10, max_jitter_pct: float = 10.0,
                 min_gap_us: int = 2 * tl.SECOND, max_samples: int = 200) -> DataFrame:
    """First regular stretch per flow among the last ``max_samples`` debounced contacts of the window, with side signals."""
    keys = list(FLOW_KEY)
    spread = tl.sliding(_debounced(packets, order_id, payload, min_gap_us), "time_us", window_us).withColumnRenamed("time_us", tl.TS)
    ts = F.timestamp_micros(tl.TS)
    off = F.dayofweek(ts).isin(1, 7) | (F.hour(ts) < 8) | (F.hour(ts) >= 18)
    per = (spread.repartition(*keys, tl.SLICE).sortWithinPartitions(*keys, tl.SLICE, tl.TS).withColumn("_off", off)
           .mapInArrow(_first_regular(window_us, min_samples, max_jitter_pct, max_samples, keys), ", ".join([*[f"{k} {t}" for k, t in FLOW_KEY.items()], f"{tl.SLICE} long, _offs long", _REGULAR])))
    earlier = F.sum("_offs").over(Window.partitionBy(*keys).orderBy(tl.SLICE).rowsBetween(Window.unboundedPreceding, -1))
    first = per.withColumn("_before", F.coalesce(earlier, F.lit(0))).where("time_us IS NOT NULL").withColumn("off_hours_pct", (F.col("_before") + F.col("_off")) / F.col("samples") * 100)
    first = first.groupBy(*keys).agg(F.min(F.struct("time_us", "samples", "mean_s", "jitter_pct", "steady_payload", "off_hours_pct")).alias("f")).select(*keys, "f.*")
    return first.withColumns({"uncommon_port": ~F.col("dst_port").isin(*fixed.BEACON_COMMON_PORTS), "technique_id": F.when(F.col("dst_port").isin(443, 8443), "T1573").otherwise("T1071")})
