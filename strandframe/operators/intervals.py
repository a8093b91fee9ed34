"""Interval sets as arrays of (start, end) and intervals as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.operators.ordered import running_totals

SPAN = "struct<start:double,end:double>"
SPANS = f"array<{SPAN}>"


def once(expression: Column, name: str) -> Column:
    """``expression`` computed once per row (a one-element explode, which the
    optimizer does not merge into the lambdas that use it)."""
    return F.explode(F.array(expression)).alias(name)


def named_spans(spans: Column, start: str, end: str) -> Column:
    """Spans with their two fields renamed to ``start`` and ``end``."""
    return F.transform(spans, lambda s: F.struct(s[start].alias("start"), s[end].alias("end")))


def _merge(sorted_spans: Column) -> Column:
    """Merge of sorted spans; touching ones join."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), joined).otherwise(F.concat(acc, F.array(x)))

    safe = F.array().cast(SPANS)
    return F.aggregate(sorted_spans, safe, lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(step(acc, x)))


def union_spans(spans: Column) -> Column:
    """Sorted, disjoint spans: reversed ends swapped, null ends and length 0
    dropped, overlapping and touching ones merged.  Null gives an empty array."""
    fixed = F.transform(spans, lambda s: F.struct(F.least(s["start"], s["end"]).alias("start"), F.greatest(s["start"], s["end"]).alias("end"), (s["start"].isNotNull() & s["end"].isNotNull()).alias("ok")))
    kept = F.transform(F.filter(fixed, lambda s: s["ok"] & (s["start"] < s["end"])), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return _merge(F.sort_array(F.coalesce(kept, F.array().cast(SPANS))))


def union_as_written(spans: Column) -> Column:
    """Merged spans without swapping ends or dropping length 0 (the convention of
    the overlap measure); null ends are dropped."""
    kept = F.transform(F.filter(spans, lambda s: s["start"].isNotNull() & s["end"].isNotNull()), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return _merge(F.sort_array(F.coalesce(kept, F.array().cast(SPANS))))


def measure(spans: Column) -> Column:
    """Total length of disjoint spans."""
    return F.aggregate(spans, F.lit(0.0), lambda acc, s: acc + (s["end"] - s["start"]))


def common_length(a: Column, b: Column) -> Column:
    """Length of the intersection of two disjoint sets of spans: both lengths less
    that of their union, which is one fold over the spans in order of start."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(float("-inf")).alias("reach"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.greatest(F.lit(0.0), s["end"] - F.greatest(s["start"], acc["reach"]))
        return F.struct((acc["total"] + fresh).alias("total"), F.greatest(acc["reach"], s["end"]).alias("reach"))

    union = F.aggregate(F.sort_array(F.concat(a, b)), start, step, lambda acc: acc["total"])
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.greatest(F.lit(0.0), measure(a) + measure(b) - union)).otherwise(F.lit(0.0))


def temporal_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two merged sets of spans: 1 when both are
    empty, 0 when one is; 1 where the union has length 0 and so has the
    intersection."""
    shared = common_length(a, b)
    union = measure(a) + measure(b) - shared
    ratio = F.when(union <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(shared, union))))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(ratio)


def clip_spans(spans: Column, duration: Column) -> Column:
    """Spans cut to [0, duration] and merged; a null or zero duration leaves the end open."""
    top = F.when(duration > 0, duration)
    inside = F.transform(spans, lambda s: F.struct(F.greatest(F.lit(0.0), s["start"]).alias("start"), F.least(s["end"], F.coalesce(top, s["end"])).alias("end")))
    return union_spans(F.filter(inside, lambda s: s["start"] < s["end"]))


def whole_seconds(spans: Column) -> Column:
    """Both ends rounded down to whole seconds."""
    return F.transform(spans, lambda s: F.struct(F.floor(s["start"]).cast("double").alias("start"), F.floor(s["end"]).cast("double").alias("end")))


def two_decimals(spans: Column) -> Column:
    """Both ends rounded to two decimals, half to even on the decimal value."""
    return F.transform(spans, lambda s: F.struct(F.bround(s["start"], 2).alias("start"), F.bround(s["end"], 2).alias("end")))


def frame_bounds(start: Column, end: Column, times: Column, first: Column, last: Column, step: float) -> Column:
    """Span of the frames ``first``..``last`` (from 0) of a window: from the first
    frame's time to one frame step after the last, within the window."""
    a, b = F.get(times, first), F.get(times, last) + F.lit(step)
    return F.struct(F.greatest(start, F.coalesce(a, start)).alias("start"), F.least(end, F.coalesce(b, end)).alias("end"))


def shrink_guarded(w_start: Column, w_end: Column, f_start: Column, f_end: Column, guard: float) -> Column:
    """The frame span widened evenly to at least ``guard`` of the window, kept
    inside the window."""
    lack = F.greatest(F.lit(0.0), F.lit(guard) * (w_end - w_start) - (f_end - f_start)) / 2
    return F.struct(F.greatest(w_start, f_start - lack).alias("start"), F.least(w_end, f_end + lack).alias("end"))


def overlap_lengths(windows: DataFrame, spans: DataFrame, key: str, window_id: str) -> DataFrame:
    """(window_id, covered): seconds of each window that the spans of its key cover.

    ``windows``: key, window_id, w_start, w_end; ``spans``: key, s_start, s_end,
    disjoint per key.  Sweep line: the ends of the spans and of the windows are put
    in one order per key; the length covered up to a point is a running sum of
    whole spans and a part of the one it lies in, and a window's cover is the
    difference at its ends.  No pair of window and span is made, however long they
    are, and a key may hold any share of the rows.  Windows without any cover get
    no row; null, NaN and reversed ends have none.
    """
    null = F.lit(None).cast("double")
    usable = spans.where(F.col(key).isNotNull() & (F.col("s_start") < F.col("s_end")) & ~F.isnan("s_end"))
    ends = F.explode(F.array(
        F.struct(F.col("s_start").alias("pos"), F.lit(0.0).alias("length"), F.lit(1).alias("step"), F.col("s_start").alias("opened")),
        F.struct(F.col("s_end").alias("pos"), (F.col("s_end") - F.col("s_start")).alias("length"), F.lit(-1).alias("step"), null.alias("opened")),
    ))
    kind = dict(windows.dtypes)[window_id]
    events = usable.select(key, ends.alias("e")).select(key, "e.*", F.lit(None).cast(kind).alias("_id"), F.lit(0).alias("sign"))
    asked = windows.where(F.col(key).isNotNull() & (F.col("w_start") < F.col("w_end")) & ~F.isnan("w_end"))
    marks = F.explode(F.array(F.struct(F.col("w_start").alias("pos"), F.lit(-1).alias("sign")), F.struct(F.col("w_end").alias("pos"), F.lit(1).alias("sign"))))
    probes = asked.select(key, F.col(window_id).alias("_id"), marks.alias("m")).select(key, "m.pos", F.lit(0.0).alias("length"), F.lit(0).alias("step"), null.alias("opened"), "_id", "m.sign")
    swept = running_totals(events.unionByName(probes), [key], "pos", {"closed": "length", "active": "step"}, ties=["step", "_id", "sign"], highest={"since": "opened"})
    upto = F.col("closed") + F.when(F.col("active") > 0, F.col("pos") - F.col("since")).otherwise(F.lit(0.0))
    covered = swept.where("sign <> 0").groupBy(F.col("_id").alias(window_id)).agg(F.sum(F.col("sign") * upto).alias("covered"))
    return covered.where("covered > 0")


def covered_label(covered: Column, start: Column, end: Column, least: float = 0.25) -> Column:
    """1 when at least ``least`` of a window is covered; windows of length 0 get 0."""
    return F.when((end > start) & (F.coalesce(covered, F.lit(0.0)) / (end - start) >= least), F.lit(1)).otherwise(F.lit(0))
