"""Queries on the video tables: interval sets, sequences, look-ups, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.keys import key_form, label_form, safe_stem, source_form
from strandframe.functions.text import first_filled, token_key, token_set, truthy
from strandframe.operators.intervals import clip_spans, common_length, covered_label, frame_bounds, measure, named_spans, once, overlap_lengths, temporal_iou, two_decimals, union_spans, whole_seconds
from strandframe.operators.joins import cache_key, common_keys, debiased_pairs, lookup_two_keys, match_counts, split_by_cache, with_default
from strandframe.operators.ranking import matched_references
from strandframe.operators.sequence import even_sample, extend_over_gaps, hmm_posterior, islands, member_runs, onset_offset, segment_members, top_segments, transitions
from strandframe.operators.sweep import clean_intervals, cover_periods
from strandframe.plans.evidence import _WINDOWS, windows
from strandframe.sources.tables import table

HMM_A, HMM_B = 0.2, 0.35
#: Blocks of 2**BIN_BITS seconds are swept by themselves.
BIN_BITS = 10


def _all_spans(column: str = "time_nodes"):
    return named_spans(F.flatten(F.filter(column, lambda e: e.isNotNull())), "start_s", "end_s")


def _record_spans(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "records", "rec_id", "vid", "video_name", "duration", "time_nodes")
    return records.select("rec_id", "vid", "video_name", "duration", once(union_spans(_all_spans()), "spans"))


_KEY = r"nullif(regexp_replace(regexp_extract(trim({0}), '[^/]*$'), '\.mp4$', '', 'i'), '')"
_RECORD_SPANS = """
raw as (select rec_id, least(s.start_s, s.end_s) as a, greatest(s.start_s, s.end_s) as b, s.start_s is not null and s.end_s is not null as ok
  from (select rec_id, unnest(flatten(list_filter(time_nodes, lambda x: x is not null))) as s from records)),
iv as (select distinct rec_id, a, b from raw where ok and a < b),
o as (select *, max(b) over (partition by rec_id order by a, b rows between unbounded preceding and 1 preceding) as reach from iv),
g as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by rec_id order by a, b rows unbounded preceding) as k from o),
u as (select rec_id, k, min(a) as a, max(b) as b from g group by rec_id, k)
"""


def record_union(spark, folder):
    """Merged spans of each record with their length."""
    return _record_spans(spark, folder).where(F.size("spans") > 0).select("rec_id", F.size("spans").cast("bigint").alias("n_spans"), F.round(measure(F.col("spans")), 6).alias("covered"))


def whole_span_iou(spark, folder):
    """IoU of the whole video with the record's merged spans."""
    whole = F.array(F.struct(F.lit(0.0).alias("start"), F.col("duration").alias("end")))
    rows = _record_spans(spark, folder).where("duration > 0").select("rec_id", F.round(temporal_iou(whole, F.col("spans")), 6).alias("iou"))
    return rows


def report_iou(spark, folder):
    """IoU of each report's spans with those of the first record of its video."""
    first = _record_spans(spark, folder).withColumn("k", key_form(F.col("video_name"))).where("k is not null").groupBy("k").agg(F.min(F.struct("rec_id", "spans")).alias("r"))
    spans = F.transform(F.flatten(F.filter("time_nodes", lambda e: e.isNotNull())), lambda s: F.struct(F.get(s, 0).alias("start"), F.get(s, 1).alias("end")))
    report = table(spark, folder, "report", "report_id", "video_name", "time_nodes").select("report_id", key_form(F.col("video_name")).alias("k"), once(union_spans(spans), "mine"))
    joined = report.join(first, "k")
    return joined.select("report_id", F.round(common_length(F.col("mine"), F.col("r.spans")), 6).alias("common"), F.round(temporal_iou(F.col("mine"), F.col("r.spans")), 6).alias("iou"))


_SPAN_LIST = """
rs as (select rec_id, list(struct_pack(a := a, b := b)) as spans from u group by rec_id),
rec as (select rec_id, {key} as k, coalesce(spans, []) as spans from records left join rs using (rec_id)),
first as (select k, arg_min(spans, rec_id) as spans from rec where k is not null group by k),
praw as (select report_id, least(s[1], s[2]) as a, greatest(s[1], s[2]) as b from (select report_id, unnest(flatten(list_filter(time_nodes, lambda x: x is not null))) as s from report) where s[1] is not null and s[2] is not null and s[1] <> s[2]),
pd as (select distinct * from praw),
po as (select *, max(b) over (partition by report_id order by a, b rows between unbounded preceding and 1 preceding) as reach from pd),
pg as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by report_id order by a, b rows unbounded preceding) as k from po),
pu as (select report_id, k, min(a) as a, max(b) as b from pg group by report_id, k),
pl as (select report_id, list(struct_pack(a := a, b := b)) as mine from pu group by report_id),
j as (select report_id, coalesce(mine, []) as mine, spans from report left join pl using (report_id) join first on first.k = {key2}),
m as (select report_id, len(mine) as n, len(spans) as m, coalesce(list_sum(list_transform(mine, lambda x: x.b - x.a)), 0) as lm, coalesce(list_sum(list_transform(spans, lambda x: x.b - x.a)), 0) as ls,
  coalesce(list_sum(flatten(list_transform(mine, lambda x: list_transform(spans, lambda y: greatest(0.0, least(x.b, y.b) - greatest(x.a, y.a)))))), 0) as c from j)
"""


def window_labels(spark, folder):
    """Covered seconds and label of each window of a recorded vid."""
    records = table(spark, folder, "records", "vid", "time_nodes").where("vid is not null")
    each = records.select("vid", F.explode(_all_spans()).alias("s"))
    spans = cover_periods(clean_intervals(each.select("vid", "s"), ["vid"], F.col("s.start"), F.col("s.end")), ["vid"], BIN_BITS).select("vid", F.col("from_pos").alias("s_start"), F.col("to_pos").alias("s_end"))
    cut = table(spark, folder, "windows", "win_id", "vid", "start_s", "end_s").select("win_id", "vid", F.col("start_s").alias("w_start"), F.col("end_s").alias("w_end"))
    covered = overlap_lengths(cut, spans, "vid", "win_id")
    joined = cut.where("w_start is not null and w_end is not null").join(covered, "win_id", "left")
    return joined.select("win_id", F.round(F.coalesce("covered", F.lit(0.0)), 6).alias("covered"), covered_label(F.round("covered", 9), F.col("w_start"), F.col("w_end")).alias("label"))


def rounded_spans(spark, folder):
    """Merged spans in whole seconds and to two decimals."""
    rows = _record_spans(spark, folder).where(F.size("spans") > 0)
    return rows.select("rec_id", F.transform(whole_seconds(F.col("spans")), lambda s: s["start"]).alias("starts"), F.round(measure(two_decimals(F.col("spans"))), 2).alias("length"))


def clipped_spans(spark, folder):
    """Length of the spans inside the video."""
    rows = _record_spans(spark, folder).select("rec_id", once(clip_spans(F.col("spans"), F.col("duration")), "c"))
    return rows.select("rec_id", F.size("c").cast("bigint").alias("n_spans"), F.round(measure(F.col("c")), 6).alias("covered"))


def window_frames(spark, folder):
    """Span of the fourth to sixth frame of each window, kept inside it; the
    window's own ends where it has no such frame."""
    cut = table(spark, folder, "windows", "win_id", "start_s", "end_s", "frame_times").where("start_s < end_s")
    out = cut.select("win_id", frame_bounds(F.col("start_s"), F.col("end_s"), F.col("frame_times"), F.lit(3), F.lit(5), 0.25).alias("b"))
    return out.select("win_id", F.round("b.start", 6).alias("from_s"), F.round("b.end", 6).alias("to_s"))


def frame_sample(spark, folder):
    """Evenly spread places of a window's frames."""
    cut = table(spark, folder, "windows", "win_id", "frame_ids").where("frame_ids is not null")
    return cut.select("win_id", F.array_join(even_sample(F.size("frame_ids"), 4).cast("array<string>"), ",").alias("places"))


def error_islands(spark, folder):
    """Runs of windows with an error."""
    runs = islands(windows(spark, folder).where("label = 1"), ["user_id"], "idx")
    return runs


def bridged_islands(spark, folder):
    """Runs of windows with an error, gaps of one window bridged."""
    return islands(windows(spark, folder).where("label = 1"), ["user_id"], "idx", gap=1)


def runs_above_mean(spark, folder):
    """Runs of windows that score at least the mean of all."""
    scored = windows(spark, folder).withColumn("score", F.round("score", 6))
    mean = scored.agg(F.round(F.avg("score"), 6).alias("m")).collect()[0]["m"]
    return islands(scored.where(F.col("score") >= F.lit(mean)), ["user_id"], "idx")


def transition_counts(spark, folder):
    out = transitions(windows(spark, folder), ["user_id"], "idx", "label")
    return out.select("n00", "n01", "n10", "n11", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def _profiles(spark, folder):
    rows = windows(spark, folder).select("user_id", "idx", F.round((F.col("score") - 20) / 5, 6).alias("x"))
    return rows.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "x"))), lambda s: s["x"]).alias("profile"))


def hmm_posteriors(spark, folder):
    """Posterior of each window under a two-state chain."""
    out = _profiles(spark, folder).select("user_id", once(hmm_posterior(F.col("profile"), HMM_A, HMM_B), "q"))
    return out.select("user_id", F.posexplode("q").alias("idx", "q")).select("user_id", "idx", F.round("q", 6).alias("q"))


def segment_grid(spark, folder):
    """Segments and their score for a grid of levels and penalties."""
    cells = F.array(*[F.struct(F.lit(x).alias("level"), F.lit(y).alias("penalty")) for x in (-0.5, 0.0, 0.7) for y in (0.0, 0.8, 3.0)])
    swept = _profiles(spark, folder).select("user_id", "profile", F.explode(cells).alias("c")).select("user_id", "profile", "c.level", "c.penalty")
    members = swept.select("*", once(segment_members(F.col("profile"), F.col("level"), F.col("penalty")), "m"))
    runs = members.select("*", once(member_runs(F.col("m")), "r"))
    total = F.aggregate(F.transform("m", lambda i: F.get("profile", i)), F.lit(0.0), lambda a, x: a + x)
    best = total - F.size("m") * F.col("level") - (F.size("r") - 1) * F.col("penalty")
    return runs.select("user_id", "level", "penalty", F.round(best, 9).alias("best"))


def _grid_sql() -> str:
    """Best value of inside and between states by a recursive pass over the windows."""
    return f"""with recursive {_WINDOWS},
x as (select user_id, idx, round((score - 20) / 5, 6) as x from w),
grid as (select l.l as level, p.p as penalty from (select unnest([-0.5, 0.0, 0.7]) as l) l, (select unnest([0.0, 0.8, 3.0]) as p) p),
f as (
  select user_id, level, penalty, 0 as idx, x - level as v1, cast('-infinity' as double) as v2 from x cross join grid where idx = 0
  union all
  select f.user_id, level, penalty, x.idx, greatest(v1, 0, v2 - penalty) + x.x - level, greatest(v1, v2) from f join x on x.user_id = f.user_id and x.idx = f.idx + 1
)
select user_id, cast(level as double) as level, cast(penalty as double) as penalty, round(arg_max(greatest(v1, v2), idx), 9) as best from f group by user_id, level, penalty"""


def top_segment_runs(spark, folder):
    """The two best segments of each user, in order of place."""
    members = _profiles(spark, folder).select("user_id", "profile", once(segment_members(F.col("profile"), 0.0, 0.8), "m"))
    runs = members.select("user_id", once(top_segments(member_runs(F.col("m")), F.col("profile"), 0.0, 2), "s"))
    return runs.select("user_id", F.explode("s").alias("s")).select("user_id", "s.first", "s.last")


def error_onsets(spark, folder):
    """Run of error windows around the first one and how far it goes with gaps."""
    rows = windows(spark, folder).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "label"))), lambda s: s["label"] == 1).alias("present"), F.min(F.when(F.col("label") == 1, F.col("idx"))).alias("seed"), F.sort_array(F.collect_list(F.when(F.col("label") == 1, F.col("idx")))).alias("places"))
    run = rows.where("seed is not null").select("user_id", onset_offset(F.col("present"), F.col("seed")).alias("r"), extend_over_gaps(F.col("places"), F.col("seed"), 1).alias("reach"))
    return run.select("user_id", "r.onset", "r.offset", "reach")


def hypothesis_features(spark, folder):
    """Features of the hypothesis that a user's error windows are one event."""
    w = windows(spark, folder).select("user_id", "idx", "label", F.round("score", 6).alias("score"))
    own = F.when(F.col("label") == 1, F.col("score"))
    out = w.groupBy("user_id").agg(F.sum("label").alias("support"), F.max(own).alias("peak"), F.avg(own).alias("inside"), F.avg(F.when(F.col("label") == 0, F.col("score"))).alias("outside"), F.slice(F.sort_array(F.collect_list(own), False), 1, 2).alias("two"), F.min(F.when(F.col("label") == 1, F.col("idx"))).alias("first"))
    two = F.try_divide(F.aggregate("two", F.lit(0.0), lambda a, x: a + x), F.size("two"))
    zero = F.lit(0.0)
    return out.select("user_id", "support", F.round(F.coalesce("peak", zero), 9).alias("peak"), F.round(F.coalesce(two, zero), 9).alias("top_two"), F.round(F.coalesce("inside", zero), 9).alias("inside"), F.round(F.coalesce(F.col("inside") - F.col("outside"), zero), 9).alias("contrast"), "first")


def matched_refs(spark, folder):
    """The two most alike vectors of the same label, at least three places away."""
    base = table(spark, folder, "embeddings", "vec_id", "embedding", "label").withColumn("low", F.pmod(F.col("vec_id") * 7, F.lit(101)).cast("double"))
    out = matched_references(base, "label", "vec_id", "embedding", "low", 3, 2)
    return out.select("label", "vec_id", "ref", F.round("sim", 5).alias("sim"))


def split_lookup(spark, folder):
    """Record of each split entry, by vid first, else by video name."""
    items = table(spark, folder, "split_ids", "split_row", "item").select("split_row", key_form(F.col("item")).alias("item")).where("item is not null")
    rows = table(spark, folder, "records", "rec_id", "vid", "video_name").select("rec_id", key_form(F.col("vid")).alias("v"), key_form(F.col("video_name")).alias("n"))
    return lookup_two_keys(items, "item", rows, "v", "n", ["rec_id"]).select("split_row", "rec_id")


def report_match(spark, folder):
    """Videos of reports and records: in both, in one."""
    a = table(spark, folder, "report", "video_name").select(key_form(F.col("video_name")).alias("k"))
    b = table(spark, folder, "records", "video_name").select(key_form(F.col("video_name")).alias("k"))
    return match_counts(a, b, "k")


def evaluated_videos(spark, folder):
    """Videos that records, reports and media files all have."""
    tables = [table(spark, folder, name, "video_name").select(key_form(F.col("video_name")).alias("k")) for name in ("records", "report", "media_files")]
    return common_keys(tables, "k")


def unreported_orders(spark, folder):
    """Customers without an order."""
    return table(spark, folder, "customer", "c_custkey").join(table(spark, folder, "orders", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def order_priority_share(spark, folder):
    """Lines per order priority of the order they belong to."""
    lines = table(spark, folder, "lineitem", "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderpriority")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.sum("n").alias("n_lines"))


def report_games(spark, folder):
    """Game of each report's video in the records, ``unknown`` where there is none."""
    games = table(spark, folder, "records", "video_name", "game").select(key_form(F.col("video_name")).alias("k"), label_form(F.col("game")).alias("game")).groupBy("k").agg(F.min("game").alias("game"))
    reports = table(spark, folder, "report", "report_id", "video_name").select("report_id", key_form(F.col("video_name")).alias("k"))
    return with_default(reports, games.where("k is not null"), "k", "game", "unknown").select("report_id", "game")


def pair_debias(spark, folder):
    """Debiased difference of pairs of event types within a user."""
    e = table(spark, folder, "events", "user_id", "event_type", "value").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("m"))
    a, b = e.select("user_id", F.col("event_type").alias("x"), F.col("m").alias("mx")), e.select("user_id", F.col("event_type").alias("y"), F.col("m").alias("my"))
    pairs = a.join(b, "user_id").where("x <> y").select("user_id", "x", "y", (F.col("mx") - F.col("my") + 0.5).alias("lo"))
    return debiased_pairs(pairs, "user_id", "x", "y", "lo").select("user_id", "a", "b", F.round("debiased", 6).alias("debiased"))


def cached_requests(spark, folder):
    """Report videos found in, and missing from, the media files as a cache."""
    requests = table(spark, folder, "report", "video_name").select(key_form(F.col("video_name")).alias("k")).where("k is not null")
    cache = table(spark, folder, "media_files", "file_id", "video_name").groupBy(key_form(F.col("video_name")).alias("k")).agg(F.min("file_id").alias("v")).where("k is not null")
    hits, missing = split_by_cache(requests, cache, "k", "v")
    return hits.agg(F.count("*").alias("n")).select(F.lit("hit").alias("kind"), "n").unionByName(missing.agg(F.count("*").alias("n")).select(F.lit("missing").alias("kind"), "n"))


def request_keys(spark, folder):
    """Hash key of each event's request."""
    events = table(spark, folder, "events", "event_id", "event_type", "user_id")
    return cache_key(events, ["event_type", "user_id"], "key").select("event_id", "key")


def entity_buckets(spark, folder):
    """Parts with the same set of name tokens and the same type."""
    parts = table(spark, folder, "part", "p_partkey", "p_name", "p_type")
    keyed = parts.select(token_key(F.col("p_name")).alias("entity"), F.lower("p_type").alias("kind"), "p_partkey", "p_name")
    return keyed.groupBy("entity", "kind").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"), F.min(F.struct("p_partkey", "p_name"))["p_name"].alias("label"))


def token_sets(spark, folder):
    """Token set of each document."""
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.array_join(token_set(F.coalesce("text", F.lit(""))), " ").alias("tokens"))


def cleaned_paths(spark, folder):
    """File stem of each record's path."""
    return table(spark, folder, "records", "rec_id", "video_path").select("rec_id", safe_stem(F.col("video_path")).alias("stem"))


def report_export(spark, folder):
    """Reports with the flag filled in: without bugs is without entries."""
    report = table(spark, folder, "report", "report_id", "video_name", "game_name", "no_bugs", "bugs")
    empty = F.coalesce(F.size(F.filter("bugs", lambda b: F.trim(b) != "")), F.lit(0)) == 0
    return report.select("report_id", key_form(F.col("video_name")).alias("video_name"), first_filled(F.trim("game_name"), F.lit("Unknown")).alias("game_name"), F.coalesce("no_bugs", empty).alias("no_bugs"), F.coalesce(F.size("bugs"), F.lit(0)).alias("n_bugs"))


def paired_bugs(spark, folder):
    """Bugs paired by position with a non-empty entry of spans."""
    records = table(spark, folder, "records", "rec_id", "bugs", "time_nodes")
    zipped = records.select("rec_id", F.posexplode(F.arrays_zip("bugs", "time_nodes")).alias("pos", "z")).where("z.bugs is not null and z.time_nodes is not null and size(z.time_nodes) > 0")
    return zipped.select("rec_id", F.col("pos").alias("bug_pos"), F.size("z.time_nodes").alias("n_spans"))


def source_counts(spark, folder):
    """Documents and distinct games per source as compared."""
    docs = table(spark, folder, "documents", "source", "game")
    return docs.groupBy(source_form(F.col("source")).alias("source")).agg(F.count("*").alias("n"), F.countDistinct("game").alias("n_games"))


def truthy_props(spark, folder):
    """Share of truthy return flags per line status."""
    lines = table(spark, folder, "lineitem", "l_linestatus", "l_returnflag")
    return lines.groupBy("l_linestatus").agg(F.count_if(truthy(F.when(F.col("l_returnflag") == "R", "Yes").otherwise(F.col("l_returnflag")))).alias("n_true"))


QUERIES = {f.__name__: f for f in (record_union, whole_span_iou, report_iou, window_labels, rounded_spans, clipped_spans, window_frames, frame_sample, error_islands, bridged_islands, runs_above_mean, transition_counts, hmm_posteriors, segment_grid, top_segment_runs, error_onsets, hypothesis_features, matched_refs, split_lookup, report_match, evaluated_videos, unreported_orders, order_priority_share, report_games, pair_debias, cached_requests, request_keys, entity_buckets, token_sets, cleaned_paths, report_export, paired_bugs, source_counts, truthy_props)}


def _island_sql(rows: str, gap: int) -> str:
    return f"""b as (select user_id, idx, case when idx - lag(idx) over (partition by user_id order by idx) <= {gap + 1} then 0 else 1 end as n from {rows}),
k as (select *, sum(n) over (partition by user_id order by idx rows unbounded preceding) as g from b)
select user_id, min(idx) as first, max(idx) as last, count(*) as n from k group by user_id, g"""


_SPANS_JOIN = _SPAN_LIST.format(key=_KEY.format("video_name"), key2=_KEY.format("report.video_name"))

ORACLES = {
    "record_union": f"with {_RECORD_SPANS} select rec_id, count(*) as n_spans, round(sum(b - a), 6) as covered from u group by rec_id",
    "whole_span_iou": f"""with {_RECORD_SPANS}, s as (select rec_id, duration, count(a) as n, coalesce(sum(b - a), 0) as l, coalesce(sum(greatest(0, least(b, duration) - greatest(a, 0))), 0) as c from records left join u using (rec_id) where duration > 0 group by all)
select rec_id, round(case when n = 0 then 0 else c / (duration + l - c) end, 6) as iou from s""",
    "report_iou": f"with {_RECORD_SPANS}, {_SPANS_JOIN} select report_id, round(c, 6) as common, round(case when n = 0 and m = 0 then 1 when n = 0 or m = 0 then 0 else least(1, c / (lm + ls - c)) end, 6) as iou from m",
    "window_labels": """with raw as (select vid, least(s.start_s, s.end_s) as a, greatest(s.start_s, s.end_s) as b from (select vid, unnest(flatten(list_filter(time_nodes, lambda x: x is not null))) as s from records where vid is not null) where s.start_s is not null and s.end_s is not null and s.start_s <> s.end_s),
o as (select *, max(b) over (partition by vid order by a, b rows between unbounded preceding and 1 preceding) as reach from raw),
g as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by vid order by a, b rows unbounded preceding) as k from o),
u as (select vid, k, min(a) as a, max(b) as b from g group by vid, k),
c as (select win_id, start_s, end_s, coalesce(sum(greatest(0, least(end_s, u.b) - greatest(start_s, u.a))) filter (where start_s < end_s and u.a is not null), 0) as c from windows w left join u on u.vid = w.vid where start_s is not null and end_s is not null group by all)
select win_id, round(c, 6) as covered, case when end_s > start_s and round(c, 9) / (end_s - start_s) >= 0.25 then 1 else 0 end as label from c""",
    "rounded_spans": f"with {_RECORD_SPANS} select rec_id, list(floor(a) order by a) as starts, round(sum(round_even(b, 2) - round_even(a, 2)), 2) as length from u group by rec_id",
    "clipped_spans": f"""with {_RECORD_SPANS}, c as (select rec_id, greatest(0, a) as a, case when duration > 0 then least(b, duration) else b end as b from records join u using (rec_id)), n as (select rec_id, count(*) as n, sum(b - a) as s from c where a < b group by rec_id)
select rec_id, coalesce(n, 0) as n_spans, round(coalesce(s, 0), 6) as covered from records left join n using (rec_id)""",
    "window_frames": "select win_id, round(greatest(start_s, coalesce(frame_times[4], start_s)), 6) as from_s, round(least(end_s, coalesce(frame_times[6] + 0.25, end_s)), 6) as to_s from windows where start_s < end_s",
    "frame_sample": """select win_id, coalesce((select string_agg(distinct p, ',' order by p) from (select cast(cast(round_even(i * (len(frame_ids) - 1) / greatest(least(len(frame_ids), 4) - 1, 1), 0) as int) as varchar) as p from (select unnest(range(0, least(len(frame_ids), 4))) as i))), '') as places from windows where frame_ids is not null""",
    "error_islands": f"with {_WINDOWS}, e as (select user_id, idx from w where label = 1), {_island_sql('e', 0)}",
    "bridged_islands": f"with {_WINDOWS}, e as (select user_id, idx from w where label = 1), {_island_sql('e', 1)}",
    "runs_above_mean": f"with {_WINDOWS}, m as (select round(avg(round(score, 6)), 6) as m from w), e as (select user_id, idx from w, m where round(score, 6) >= m), {_island_sql('e', 0)}",
    "transition_counts": f"""with {_WINDOWS}, t as (select label as q, lag(label) over (partition by user_id order by idx) as p from w), n as (select count(*) filter (where p = 0 and q = 0) as n00, count(*) filter (where p = 0 and q = 1) as n01, count(*) filter (where p = 1 and q = 0) as n10, count(*) filter (where p = 1 and q = 1) as n11 from t)
select *, round((n01 + 1) / (n00 + n01 + 2), 6) as a, round((n10 + 1) / (n10 + n11 + 2), 6) as b from n""",
    "hmm_posteriors": f"""with recursive {_WINDOWS},
x as (select user_id, idx, round((score - 20) / 5, 6) as x, count(*) over (partition by user_id) as n from w),
f as (select user_id, idx, exp(x) * {HMM_A} / {HMM_A + HMM_B} as p1, {HMM_B} / {HMM_A + HMM_B} as p0 from x where idx = 0
  union all select f.user_id, x.idx, exp(x.x) * (p0 * {HMM_A} + p1 * {1 - HMM_B}) / (p0 + p1), (p0 * {1 - HMM_A} + p1 * {HMM_B}) / (p0 + p1) from f join x on x.user_id = f.user_id and x.idx = f.idx + 1),
g as (select user_id, idx, cast(1 as double) as b1, cast(1 as double) as b0 from x where idx = n - 1
  union all select g.user_id, x.idx - 1, ({1 - HMM_B} * exp(x.x) * b1 + {HMM_B} * b0) / (b0 + b1), ({HMM_A} * exp(x.x) * b1 + {1 - HMM_A} * b0) / (b0 + b1) from g join x on x.user_id = g.user_id and x.idx = g.idx where x.idx > 0)
select f.user_id, f.idx, round(p1 * b1 / (p1 * b1 + p0 * b0), 6) as q from f join g on f.user_id = g.user_id and f.idx = g.idx""",
    "segment_grid": _grid_sql(),
    "error_onsets": f"""with {_WINDOWS}, e as (select user_id, idx from w where label = 1), s as (select user_id, min(idx) as seed, (select max(idx) from w w2 where w2.user_id = e.user_id) as top from e group by user_id),
z as (select s.user_id, seed, top, (select min(idx) from w where w.user_id = s.user_id and label = 0 and idx > seed) as after, (select max(idx) from w where w.user_id = s.user_id and label = 0 and idx < seed) as before from s),
r as (select user_id, min(first) as f, arg_min(last, first) as reach from (with b as (select user_id, idx, case when idx - lag(idx) over (partition by user_id order by idx) <= 2 then 0 else 1 end as n from e), k as (select *, sum(n) over (partition by user_id order by idx rows unbounded preceding) as g from b) select user_id, min(idx) as first, max(idx) as last from k group by user_id, g) group by user_id)
select z.user_id, coalesce(before, -1) + 1 as onset, coalesce(after, top + 1) - 1 as "offset", reach from z join r on r.user_id = z.user_id""",
    "hypothesis_features": f"""with {_WINDOWS}, x as (select user_id, idx, label, round(score, 6) as s, row_number() over (partition by user_id, label order by score desc) as k from w)
select user_id, cast(sum(label) as bigint) as support, round(coalesce(max(s) filter (where label = 1), 0), 9) as peak, round(coalesce(avg(s) filter (where label = 1 and k <= 2), 0), 9) as top_two, round(coalesce(avg(s) filter (where label = 1), 0), 9) as inside,
round(coalesce(avg(s) filter (where label = 1) - avg(s) filter (where label = 0), 0), 9) as contrast, min(idx) filter (where label = 1) as first from x group by user_id""",
    "matched_refs": """with e as (select vec_id, label, (vec_id * 7) % 101 as low, cast(embedding as double[]) as v from embeddings),
m as (select label, median(low) as mid from e group by label),
p as (select a.label, a.vec_id, b.vec_id as ref, list_cosine_similarity(a.v, b.v) as sim, b.low from e a join e b on a.label = b.label and abs(a.vec_id - b.vec_id) >= 3 join m on m.label = b.label and b.low <= mid)
select label, vec_id, ref, round(sim, 5) as sim from p qualify row_number() over (partition by label, vec_id order by round(sim, 12) desc, low, ref) <= 2""",
    "split_lookup": f"""with i as (select split_row, {_KEY.format('item')} as k from split_ids), v as (select {_KEY.format('vid')} as k, min(rec_id) as r from records group by 1), n as (select {_KEY.format('video_name')} as k, min(rec_id) as r from records group by 1)
select split_row, coalesce(v.r, n.r) as rec_id from i left join v on v.k = i.k left join n on n.k = i.k where coalesce(v.r, n.r) is not null""",
    "report_match": f"""with a as (select distinct {_KEY.format('video_name')} as k from report), b as (select distinct {_KEY.format('video_name')} as k from records)
select (select count(*) from a join b using (k)) as both, (select count(*) from a where k is not null and k not in (select k from b where k is not null)) as only_left, (select count(*) from b where k is not null and k not in (select k from a where k is not null)) as only_right""",
    "evaluated_videos": " intersect ".join(f"select {_KEY.format('video_name')} as k from {t} where {_KEY.format('video_name')} is not null" for t in ("records", "report", "media_files")),
    "unreported_orders": "select c_custkey from customer where c_custkey not in (select o_custkey from orders)",
    "order_priority_share": "select o_orderpriority, count(*) as n_lines from lineitem join orders on l_orderkey = o_orderkey group by 1",
    "report_games": f"""with g as (select {_KEY.format('video_name')} as k, min(nullif(nullif(regexp_replace(lower(game), '[^a-z0-9]', '', 'g'), ''), 'unknown')) as game from records group by 1)
select report_id, coalesce(game, 'unknown') as game from report left join g on g.k = {_KEY.format('report.video_name')}""",
    "pair_debias": "with e as (select user_id, event_type as t, round(avg(value), 6) as m from events group by 1, 2) select x.user_id, x.t as a, y.t as b, round(((x.m - y.m + 0.5) - (y.m - x.m + 0.5)) / 2, 6) as debiased from e x join e y on x.user_id = y.user_id and x.t < y.t",
    "cached_requests": f"""with r as (select {_KEY.format('video_name')} as k from report), c as (select distinct {_KEY.format('video_name')} as k from media_files)
select 'hit' as kind, count(*) as n from r join c using (k) union all select 'missing', count(distinct k) from r where k is not null and k not in (select k from c where k is not null)""",
    "request_keys": """select event_id, sha1('{"event_type":"' || event_type || '","user_id":' || user_id || '}') as key from events""",
    "entity_buckets": """with t as (select p_partkey, p_name, lower(p_type) as kind, coalesce(nullif(list_aggregate(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z]+'), lambda w: length(w) > 2 and w not in ('the','a','an','is','are','of','in','on','and','or','to','with','that','this','it','its','as','by','for','be','can','may','game','player','character','when','which','from','at','while','into')))), 'string_agg', ' '), ''), p_name) as entity from part)
select entity, kind, count(*) as n, min(p_partkey) as first_part, arg_min(p_name, p_partkey) as label from t group by 1, 2""",
    "token_sets": """select doc_id, coalesce(list_aggregate(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda w: length(w) > 2 and w not in ('the','a','an','is','are','of','in','on','and','or','to','with','that','this','it','its','as','by','for','be','can','may','game','player','character','when','which','from','at','while','into')))), 'string_agg', ' '), '') as tokens from documents""",
    "cleaned_paths": f"select rec_id, regexp_replace({_KEY.format('video_path')}, '[^A-Za-z0-9_.\\-]', '_', 'g') as stem from records",
    "report_export": f"select report_id, {_KEY.format('video_name')} as video_name, coalesce(nullif(trim(game_name), ''), 'Unknown') as game_name, coalesce(no_bugs, coalesce(len(list_filter(bugs, lambda b: trim(b) <> '')), 0) = 0) as no_bugs, coalesce(len(bugs), 0) as n_bugs from report",
    "paired_bugs": "select rec_id, i - 1 as bug_pos, len(time_nodes[i]) as n_spans from (select rec_id, bugs, time_nodes, unnest(range(1, greatest(coalesce(len(bugs), 0), coalesce(len(time_nodes), 0)) + 1)) as i from records) where bugs[i] is not null and len(time_nodes[i]) > 0",
    "source_counts": "select replace(lower(trim(source)), '-', '_') as source, count(*) as n, count(distinct game) as n_games from documents group by 1",
    "truthy_props": "select l_linestatus, count(*) filter (where l_returnflag = 'R') as n_true from lineitem group by 1",
}
