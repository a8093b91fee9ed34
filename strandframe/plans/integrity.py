"""Queries on intervals and references of the video tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.keys import key_form, whole_ms
from strandframe.operators.references import orphan_counts, orphan_rows
from strandframe.operators.sweep import clean_intervals, cover_periods, overlaps_and_gaps
from strandframe.sources.tables import table

LONGEST_GAP_MS = 600_000


def owned_intervals(windows: DataFrame, records: DataFrame) -> DataFrame:
    """Intervals of each vid's windows and of each entry of time_nodes, in whole
    milliseconds: tab_name, owner, from_pos, to_pos, distinct."""
    cut = windows.select(F.lit("windows").alias("tab_name"), F.col("vid").alias("owner"), whole_ms(F.col("start_s")).alias("a"), whole_ms(F.col("end_s")).alias("b"))
    entries = records.select("rec_id", F.posexplode("time_nodes").alias("pos", "spans")).select("rec_id", "pos", F.explode("spans").alias("s"))
    marked = entries.select(F.lit("records").alias("tab_name"), F.concat(F.col("rec_id").cast("string"), F.lit(":"), F.col("pos").cast("string")).alias("owner"), whole_ms(F.col("s.start_s")).alias("a"), whole_ms(F.col("s.end_s")).alias("b"))
    return clean_intervals(cut.unionByName(marked), ["tab_name", "owner"], F.col("a"), F.col("b"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Merged periods and gaps (see TESTDATA.md)."""
    windows = table(spark, folder, "windows", "vid", "start_s", "end_s")
    records = table(spark, folder, "records", "rec_id", "time_nodes")
    owner = ["tab_name", "owner"]
    found = overlaps_and_gaps(cover_periods(owned_intervals(windows, records), owner), owner, LONGEST_GAP_MS)
    return found.select("tab_name", "owner", "kind", F.col("from_pos").alias("from_ms"), F.col("to_pos").alias("to_ms"))


def p2_periods(spark: SparkSession, folder: str) -> DataFrame:
    """All continuous periods with the most intervals active at once."""
    windows = table(spark, folder, "windows", "vid", "start_s", "end_s")
    records = table(spark, folder, "records", "rec_id", "time_nodes")
    periods = cover_periods(owned_intervals(windows, records), ["tab_name", "owner"])
    return periods.select("tab_name", "owner", F.col("from_pos").alias("from_ms"), F.col("to_pos").alias("to_ms"), F.col("depth").cast("bigint").alias("depth"))


def video_references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The references of four tables and the rows they may point to."""
    windows = table(spark, folder, "windows", "win_id", "vid", "loaded_at")
    report = table(spark, folder, "report", "report_id", "video_name", "loaded_at")
    split_ids = table(spark, folder, "split_ids", "split_row", "item", "loaded_at")
    records = table(spark, folder, "records", "rec_id", "vid", "video_name", "loaded_at", "deleted_at")
    media = table(spark, folder, "media_files", "video_name", "loaded_at", "deleted_at")

    def ref(df: DataFrame, name: str, row_id: str, column: str, target: str) -> DataFrame:
        return df.select(F.lit(name).alias("tab_name"), F.col(row_id).alias("row_id"), F.lit(target).alias("target"), key_form(F.col(column)).alias("ref_key"), F.col("loaded_at").alias("at"))

    refs = ref(windows, "windows", "win_id", "vid", "vid").unionByName(ref(report, "report", "report_id", "video_name", "name"))
    refs = refs.unionByName(ref(split_ids, "split_ids", "split_row", "item", "item")).unionByName(ref(records, "records", "rec_id", "video_name", "media"))

    vid, name = key_form(F.col("vid")), key_form(F.col("video_name"))
    offers = F.array(
        F.struct(F.lit("vid").alias("target"), vid.alias("ref_key")),
        F.struct(F.lit("name").alias("target"), name.alias("ref_key")),
        F.struct(F.lit("item").alias("target"), vid.alias("ref_key")),
        F.struct(F.lit("item").alias("target"), name.alias("ref_key")),
    )
    from_records = records.select(F.explode(offers).alias("o"), "loaded_at", "deleted_at").select("o.target", "o.ref_key", F.col("loaded_at").alias("born"), F.col("deleted_at").alias("gone"))
    from_media = media.select(F.lit("media").alias("target"), name.alias("ref_key"), F.col("loaded_at").alias("born"), F.col("deleted_at").alias("gone"))
    return refs, from_records.unionByName(from_media)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose reference points to nothing at the time they were loaded."""
    refs, parents = video_references(spark, folder)
    return orphan_rows(refs, parents).select("tab_name", "row_id")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table and calendar month of loaded_at."""
    refs, parents = video_references(spark, folder)
    counts = orphan_counts(orphan_rows(refs, parents), refs)
    return counts.select("tab_name", "month", "n_refs", "orphans", F.round("share", 9).alias("share"))


QUERIES = {"p2_found": p2_found, "p2_periods": p2_periods, "p5_found": p5_found, "p5_report": p5_report}

_INTERVALS = """
raw as (
  select 'windows' as tab_name, vid as owner, start_s as a, end_s as b from windows where vid is not null
  union all
  select 'records', rec_id || ':' || (i - 1), s.start_s, s.end_s
  from (select rec_id, i, unnest(time_nodes[i]) as s from (select rec_id, time_nodes, unnest(range(1, len(time_nodes) + 1)) as i from records))
),
ms as (
  select tab_name, owner, cast(round(a * 1000) as bigint) as a, cast(round(b * 1000) as bigint) as b from raw where a is not null and b is not null
),
iv as (select distinct tab_name, owner, least(a, b) as a, greatest(a, b) as b from ms where a <> b),
numbered as (
  select *, row_number() over (partition by tab_name, owner order by a, b) as rn,
    max(b) over (partition by tab_name, owner order by a, b rows between unbounded preceding and 1 preceding) as reach from iv
),
grouped as (
  select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by tab_name, owner order by rn) as g,
    case when reach > a then 1 else 0 end as laps from numbered
),
periods as (select tab_name, owner, g, min(a) as a, max(b) as b, max(laps) as laps from grouped group by all),
steps as (
  select tab_name, owner, a as pos, 1 as step from iv union all select tab_name, owner, b, -1 from iv
),
active as (
  select tab_name, owner, pos, sum(sum(step)) over (partition by tab_name, owner order by pos) as n from steps group by tab_name, owner, pos
)
"""

_REFS = r"""
refs as (
  select 'windows' as tab_name, win_id as row_id, 'vid' as target, vid as k, loaded_at as t from windows
  union all select 'report', report_id, 'name', video_name, loaded_at from report
  union all select 'split_ids', split_row, 'item', item, loaded_at from split_ids
  union all select 'records', rec_id, 'media', video_name, loaded_at from records
),
keyed as (select tab_name, row_id, target, nullif(regexp_replace(regexp_extract(trim(k), '[^/]*$'), '\.mp4$', '', 'i'), '') as k, t from refs),
parents as (
  select 'vid' as target, vid as k, loaded_at as born, deleted_at as gone from records
  union all select 'name', video_name, loaded_at, deleted_at from records
  union all select 'item', vid, loaded_at, deleted_at from records
  union all select 'item', video_name, loaded_at, deleted_at from records
  union all select 'media', video_name, loaded_at, deleted_at from media_files
),
pk as (select target, nullif(regexp_replace(regexp_extract(trim(k), '[^/]*$'), '\.mp4$', '', 'i'), '') as k, born, gone from parents),
orphans as (
  select tab_name, row_id, t from keyed r where k is not null and not exists (
    select 1 from pk p where p.target = r.target and p.k = r.k and p.born <= r.t and (p.gone is null or p.gone > r.t))
)
"""

ORACLES = {
    "p2_found": f"""with {_INTERVALS}
select tab_name, owner, 'merged' as kind, a as from_ms, b as to_ms from periods where laps = 1
union all
select tab_name, owner, 'gap', prev_b, a from (select *, lag(b) over (partition by tab_name, owner order by a) as prev_b from periods)
where prev_b is not null and a - prev_b <= {LONGEST_GAP_MS}""",
    "p2_periods": f"""with {_INTERVALS}
select p.tab_name, p.owner, p.a as from_ms, p.b as to_ms, cast(max(x.n) as bigint) as depth
from periods p join active x on p.tab_name = x.tab_name and p.owner = x.owner and x.pos between p.a and p.b
group by all""",
    "p5_found": f"with {_REFS} select tab_name, row_id from orphans",
    "p5_report": f"""with {_REFS},
n as (select tab_name, strftime(t, '%Y-%m') as month, count(*) as n_refs from keyed where k is not null group by all),
o as (select tab_name, strftime(t, '%Y-%m') as month, count(*) as orphans from orphans group by all)
select n.tab_name, n.month, n.n_refs, coalesce(o.orphans, 0) as orphans, round(coalesce(o.orphans, 0) / n.n_refs, 9) as share
from n left join o on n.tab_name = o.tab_name and n.month is not distinct from o.month""",
}
