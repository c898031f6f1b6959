"""Closed sample intervals: merging, detection of artefacts, exclusion, epochs."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kernelweave.functions.scan import TILE, scan
from kernelweave.functions.stats import hazen

BY = "recording_id"


def merge(intervals: DataFrame, within: int = 0, by: str = BY, tile: int = TILE) -> DataFrame:
    """(by, start_t, end_t): union of intervals that overlap, touch at a sample, or lie at most `within` apart.

    Empty or null intervals go. A nested one never shortens the union. A recording's intervals are scanned in tiles of time.
    """
    clean = intervals.where("start_t <= end_t").select(by, "start_t", "end_t")
    # of equal intervals one tells all
    reach = scan(clean.distinct(), [by], ["start_t", "end_t"], {"_reach": ("max", "end_t")}, tile)
    opens = reach.withColumn("_opens", F.coalesce(F.col("start_t") > F.col("_reach") + F.lit(within), F.lit(True)).cast("int"))
    island = scan(opens, [by], ["start_t", "end_t"], {"_before": ("sum", "_opens")}, tile)
    return island.groupBy(by, (F.col("_before") + F.col("_opens")).alias("_island")).agg(F.min("start_t").alias("start_t"), F.max("end_t").alias("end_t")).drop("_island")


def merge_sets(sets: dict[str, DataFrame], srate: float, within: int = 0, by: str = BY) -> tuple[DataFrame, DataFrame]:
    """Several tables of intervals as one union, and (name, seconds) of each set by itself, of the union, and of what sets have in common."""
    apart = {name: merge(table, 0, by) for name, table in sets.items()}
    union = merge(reduce(DataFrame.unionByName, [t.select(by, "start_t", "end_t") for t in sets.values()]), within, by)
    seconds = (F.coalesce(F.sum(F.col("end_t") - F.col("start_t") + 1), F.lit(0)) / srate).alias("seconds")
    totals = reduce(DataFrame.unionByName, [t.agg(seconds).select(F.lit(name).alias("name"), "seconds") for name, t in {**apart, "union": union}.items()])
    shared = totals.agg((F.sum(F.when(F.col("name") != "union", F.col("seconds"))) - F.sum(F.when(F.col("name") == "union", F.col("seconds")))).alias("seconds"))
    return union, totals.unionByName(shared.select(F.lit("repeated").alias("name"), "seconds"))


def runs(mask: DataFrame, by: str = BY, tile: int = TILE) -> DataFrame:
    """(by, start_t, end_t) of successive samples t."""
    t = scan(mask.select(by, "t").distinct(), [by], ["t"], {"_place": ("sum", F.lit(1))}, tile)
    return t.groupBy(by, (F.col("t") - F.col("_place")).alias("_g")).agg(F.min("t").alias("start_t"), F.max("t").alias("end_t")).drop("_g")


def eye_channels(labels: dict[int, str] | None, channels: list[int] | None = None) -> list[int]:
    """Channels, of those given or of all, that labels name as eyes or pupils."""
    return sorted(c for c, name in (labels or {}).items() if (channels is None or c in channels) and any(w in name for w in ("Eye", "EYE", "Pupil")))


def amplitude(samples: DataFrame, srate: float, threshold: float = 150.0, window_ms: float = 2000.0, step_ms: float = 100.0, combine_ms: float | None = None, channels: list[int] | None = None, chunk: int = 100_000, labels: dict[int, str] | None = None) -> DataFrame:
    """Windows in which any channel's peak-to-peak passes the threshold, merged.

    A window spans window_ms less one sample and starts on a grid of step_ms. Long recordings
    are cut into chunks with the window's length of samples in common, so no task holds a recording.
    Warns of channels that labels {channel: name} name as eyes or pupils.
    """
    if eyes := eye_channels(labels, channels):
        warnings.warn(f"eye channels take part: {eyes}", stacklevel=2)
    width, step = int(window_ms * srate / 1000) - 1, max(1, int(step_ms * srate / 1000))
    if channels is not None:
        samples = samples.where(F.col("channel").isin(*channels))
    own = F.floor((F.col("t") - 1) / chunk)
    before = F.floor((F.col("t") - width) / chunk)
    s = samples.withColumn("_chunk", F.explode(F.array_distinct(F.array(own, F.greatest(before, F.lit(0))))))
    w = W.partitionBy("recording_id", "channel", "_chunk").orderBy("t").rangeBetween(0, width - 1)
    s = s.withColumn("_range", F.max("y").over(w) - F.min("y").over(w)).withColumn("_end", F.col("t") + width - 1)
    ends = samples.groupBy("recording_id").agg(F.max("t").alias("_last"))
    hits = s.where((own == F.col("_chunk")) & ((F.col("t") - 1) % step == 0) & (F.col("_range") > threshold)).join(ends, "recording_id")
    hits = hits.where(F.col("_end") <= F.col("_last")).select("recording_id", F.col("t").alias("start_t"), F.col("_end").alias("end_t")).distinct()
    return merge(hits, int((combine_ms or 0) * srate / 1000))


def improbable(samples: DataFrame, srate: float, seconds: float = 0.5, local: float = 3.0, overall: float = 3.0, bins: int = 100, robust: bool = True, labels: dict[int, str] | None = None) -> DataFrame:
    """(recording_id, start_t, end_t) of segments whose joint probability is an outlier, on a channel or over all.

    Each channel's values are binned; a segment's improbability is the sum of -log p of its
    samples, standardised over segments (robust: by the middle 80 % of them). Eye channels raise.
    """
    if eyes := eye_channels(labels):
        raise ValueError(f"eye channels take part: {eyes}")
    length = max(1, int(srate * seconds))
    s = samples.where("y is not null").withColumn("seg", F.floor((F.col("t") - 1) / length))
    span = s.groupBy("recording_id", "channel").agg(F.min("y").alias("_lo"), F.max("y").alias("_hi"), F.count("*").alias("_all"))
    s = s.join(span, ["recording_id", "channel"])
    s = s.withColumn("_bin", F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("y") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0))
    counts = s.groupBy("recording_id", "channel", "_bin").agg(F.count("*").alias("_c"))
    s = s.join(counts, ["recording_id", "channel", "_bin"])
    each = s.groupBy("recording_id", "channel", "seg").agg(F.round(F.sum(-F.log(F.col("_c") / F.col("_all"))), 9).alias("jp"))
    total = each.groupBy("recording_id", "seg").agg(F.round(F.sum("jp"), 9).alias("jp"))  # like segments are equal in any order of sums

    def z(df: DataFrame, keys: list[str], limit: float) -> DataFrame:
        if robust:
            q = hazen(df, "jp", [0.1, 0.9], keys, rule="linear").groupBy(*keys).agg(F.min("q").alias("_a"), F.max("q").alias("_b"))
        else:
            q = df.groupBy(*keys).agg(F.min("jp").alias("_a"), F.max("jp").alias("_b"))
        inner = df.join(q, keys).where(F.col("jp").between(F.col("_a"), F.col("_b")))
        norm = inner.groupBy(*keys).agg(F.avg("jp").alias("_m"), F.stddev_samp("jp").alias("_s"))
        return df.join(norm, keys).where(F.abs((F.col("jp") - F.col("_m")) / F.col("_s")) > limit).select("recording_id", "seg")

    bad = z(each, ["recording_id", "channel"], local).union(z(total, ["recording_id"], overall)).distinct()
    ends = samples.groupBy("recording_id").agg(F.max("t").alias("_last"))
    return bad.join(ends, "recording_id").select("recording_id", (F.col("seg") * length + 1).alias("start_t"), F.least((F.col("seg") + 1) * length, F.col("_last")).alias("end_t"))


def bursts(samples: DataFrame, srate: float, cutoff: float = 20.0, seconds: float = 0.5, labels: dict[int, str] | None = None) -> DataFrame:
    """Runs of segments in which a channel's RMS lies more than cutoff robust deviations above its median. Eye channels raise."""
    if eyes := eye_channels(labels):
        raise ValueError(f"eye channels take part: {eyes}")
    length = max(1, int(srate * seconds))
    s = samples.withColumn("seg", F.floor((F.col("t") - 1) / length)).groupBy("recording_id", "channel", "seg").agg(F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("rms"), F.min("t").alias("a"), F.max("t").alias("b"))
    keys = ["recording_id", "channel"]
    mid = hazen(s, "rms", [0.5], keys).select(*keys, F.col("q").alias("_m"))
    s = s.join(mid, keys)
    dev = hazen(s.withColumn("_off", F.abs(F.col("rms") - F.col("_m"))), "_off", [0.5], keys).select(*keys, (F.col("q") * 1.4826).alias("_d"))
    hits = s.join(dev, keys).where(F.col("rms") > F.col("_m") + F.lit(cutoff) * F.greatest("_d", F.lit(1e-12)))
    return merge(hits.select("recording_id", F.col("a").alias("start_t"), F.col("b").alias("end_t")).distinct(), 1)


def exclude(rows: DataFrame, intervals: DataFrame, tile: int = 1024) -> DataFrame:
    """Rows (recording_id, t, ..) outside of all intervals: merged, cut into tiles, joined on the tile."""
    tiles = merge(intervals).withColumn("_tile", F.explode(F.sequence(F.floor(F.col("start_t") / tile), F.floor(F.col("end_t") / tile))))
    tiles = tiles.select(F.col("recording_id").alias("_r"), "_tile", F.col("start_t").alias("_a"), F.col("end_t").alias("_b"))
    on = (F.col("recording_id") == F.col("_r")) & (F.floor(F.col("t") / tile) == F.col("_tile")) & F.col("t").between(F.col("_a"), F.col("_b"))
    return rows.join(tiles, on, "left_anti")


def excluded_time(events: DataFrame, intervals: DataFrame, lo: int, width: int, srate: float, n_samples: int) -> DataFrame:
    """(type, total_s, no_overlap_s, union_s, removed_s): seconds of each type's windows, and of those inside intervals."""
    spans = events.withColumn("lat", F.round("latency").cast("long")).select("recording_id", "type", "lat", F.explode(F.sequence(F.lit(lo), F.lit(lo + width - 1))).alias("lag")).withColumn("t", F.col("lat") + F.col("lag")).where(F.col("t").between(1, n_samples))
    active = spans.select("recording_id", "type", "t").distinct()
    left = exclude(active, intervals).groupBy("type").agg(F.count("*").alias("_left"))
    n = events.groupBy("type").agg(F.count("*").alias("_n"))
    out = active.groupBy("type").agg(F.count("*").alias("_union")).join(n, "type").join(left, "type", "left")
    return out.select("type", F.lit(n_samples / srate).alias("total_s"), (F.col("_n") * width / srate).alias("no_overlap_s"), (F.col("_union") / srate).alias("union_s"), ((F.col("_union") - F.coalesce("_left", F.lit(0))) / srate).alias("removed_s"))


def clean_events(events: DataFrame, intervals: DataFrame, lo: int, width: int, tile: int = 1024) -> DataFrame:
    """Events whose window touches no interval."""
    e = events.withColumn("_lat", F.round("latency").cast("long")).withColumn("_ea", F.col("_lat") + lo).withColumn("_eb", F.col("_lat") + lo + width - 1)
    e = e.withColumn("_tile", F.explode(F.sequence(F.floor(F.col("_ea") / tile), F.floor(F.col("_eb") / tile))))
    w = merge(intervals).withColumn("_wt", F.explode(F.sequence(F.floor(F.col("start_t") / tile), F.floor(F.col("end_t") / tile))))
    w = w.select(F.col("recording_id").alias("_r"), "_wt", F.col("start_t").alias("_a"), F.col("end_t").alias("_b"))
    hit = e.join(w, (F.col("recording_id") == F.col("_r")) & (F.col("_tile") == F.col("_wt")) & (F.col("_a") <= F.col("_eb")) & (F.col("_b") >= F.col("_ea"))).select("recording_id", "event_index").distinct()
    return events.join(hit, ["recording_id", "event_index"], "left_anti")


def whole(events: DataFrame, samples: DataFrame, lo: int, width: int, intervals: DataFrame | None = None) -> DataFrame:
    """Events with a whole window that touches no interval, and their whole latency _lat; told from events and recordings' ends alone."""
    ends = samples.groupBy("recording_id").agg(F.max("t").alias("_last"))
    e = events if intervals is None else clean_events(events, intervals, lo, width)
    return e.withColumn("_lat", F.round("latency").cast("long")).join(ends, "recording_id").where((F.col("_lat") + lo >= 1) & (F.col("_lat") + lo + width - 1 <= F.col("_last"))).drop("_last")


def epochs(events: DataFrame, samples: DataFrame, lo: int, width: int, intervals: DataFrame | None = None) -> DataFrame:
    """(recording_id, event_index, type, lag, channel, y) of events with a whole window, touching no interval."""
    e = whole(events, samples, lo, width, intervals)
    cut = e.select("recording_id", "event_index", "type", "_lat", F.explode(F.sequence(F.lit(lo), F.lit(lo + width - 1))).alias("lag")).withColumn("t", F.col("_lat") + F.col("lag"))
    return cut.join(samples.select("recording_id", "t", "channel", "y"), ["recording_id", "t"]).select("recording_id", "event_index", "type", "lag", "channel", "y")


def first_at_a_time(events: DataFrame, key: str | None = None) -> DataFrame:
    """Of events at the same sample (or with the same key) of a recording the first in table order, so that no epoch comes twice."""
    at = F.col(key) if key else F.round("latency").cast("long")
    return events.withColumn("_k", F.row_number().over(W.partitionBy("recording_id", at).orderBy("event_index"))).where("_k = 1").drop("_k")


def event_in_epoch(events: DataFrame, others: DataFrame, lo: int, width: int, value: str = "latency", last: bool = False, tile: int = TILE) -> DataFrame:
    """(recording_id, event_index, found): value of the first (or last) of others inside each event's epoch, null where none is.

    The latency is told from the event's own. Of others at one sample the first (last) by index stands for all, and events of one sample ask
    once: a scan in tiles of time finds the nearest other from an epoch's start on (back from its end), however many others the epoch holds.
    """
    e = events.select("recording_id", "event_index", F.round("latency").cast("long").alias("_lat"))
    pick, sign = (F.max_by, 1) if last else (F.min_by, -1)
    o = others.select("recording_id", F.round("latency").cast("long").alias("_at"), "event_index", F.col(value).alias("_v")).where("recording_id is not null and _at is not null and event_index is not null")
    o = o.groupBy("recording_id", "_at").agg(pick("_v", "event_index").alias("_v"))
    # a window's far end is where the search begins; time runs backwards for the first
    asked = e.select("recording_id", "_lat").where("recording_id is not null and _lat is not null").distinct().withColumn("_from", F.col("_lat") + F.lit(lo + width - 1 if last else lo))
    line = o.select("recording_id", (F.col("_at") * sign).alias("_k"), F.lit(0).alias("_asks"), F.lit(None).cast("long").alias("_lat"), F.struct((F.col("_at") * sign).alias("k"), F.col("_v").alias("v")).alias("_o"))
    line = line.unionByName(asked.select("recording_id", (F.col("_from") * sign).alias("_k"), F.lit(1).alias("_asks"), "_lat"), allowMissingColumns=True)
    near = scan(line, ["recording_id"], ["_k", "_asks"], {"_near": ("max", "_o")}, tile).where("_asks = 1")
    at = F.col("_near.k") * sign
    told = F.col("_near.v") - F.col("_lat") if value == "latency" else F.col("_near.v")
    found = near.where(at.between(F.col("_lat") + lo, F.col("_lat") + lo + width - 1)).select("recording_id", "_lat", told.alias("found"))
    return e.join(found, ["recording_id", "_lat"], "left").select("recording_id", "event_index", "found")
