"""Annotation, split and report files in JSON or plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.keys import key_form
from strandframe.operators.guards import require
from strandframe.session import cut_lineage
from strandframe.functions.text import decode_spans, first_filled
from strandframe.operators.intervals import named_spans, union_spans

_ENTRY = "struct<description:string,time_nodes:string,time_nodes_validated:string,time_nodes_original:string>"
_RECORD = f"struct<video_name:string,video_id:string,id:string,game_name:string,game:string,genre:string,video_path:string,duration:double,no_bugs:boolean,bugs:array<string>,time_nodes:string,reports:array<{_ENTRY}>>"
SPAN_LISTS = "array<array<struct<start:double,end:double>>>"


def _spans(text):
    pairs = F.transform(decode_spans(text), lambda entry: F.transform(F.filter(entry, lambda s: F.size(s) >= 2), lambda s: F.struct(F.get(s, F.lit(0)).alias("start"), F.get(s, F.lit(1)).alias("end"))))
    return F.transform(pairs, lambda entry: union_spans(entry))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Typed records of annotation files in two shapes: ``bugs`` with
    ``time_nodes``, or ``reports`` with one entry per bug.  The root may be a list,
    or an object with the list under ``data`` or ``records``; a file is one task.

    Result: vid, video_name, game, genre, video_path, duration, no_bugs, bugs,
    time_nodes.  Empty strings count as missing.  Positions hold: an entry without
    spans stays as an empty array.  Of a report entry the first list of spans
    counts, the validated before the original ones.
    """
    files = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"struct<data:array<{_RECORD}>,records:array<{_RECORD}>>")
    listed = F.from_json("value", f"array<{_RECORD}>")
    rows = F.when(F.ltrim("value").startswith("["), listed).otherwise(F.coalesce(wrapped["data"], wrapped["records"]))
    r = files.select(F.explode(rows).alias("r")).select("r.*")
    name = first_filled(F.col("video_name"), F.col("video_id"), F.col("id"))
    from_reports = F.transform("reports", lambda e: F.coalesce(F.get(_spans(F.coalesce(e["time_nodes_validated"], e["time_nodes"], e["time_nodes_original"])), F.lit(0)), F.array().cast("array<struct<start:double,end:double>>")))
    bugs = F.coalesce("bugs", F.transform("reports", lambda e: e["description"]), F.array().cast("array<string>"))
    spans = F.coalesce(_spans(F.col("time_nodes")), from_reports, F.array().cast(SPAN_LISTS))
    return r.select(
        key_form(first_filled(F.col("id"), F.col("video_id"), F.col("video_name"))).alias("vid"), key_form(name).alias("video_name"), first_filled(F.col("game_name"), F.col("game")).alias("game"), F.nullif("genre", F.lit("")).alias("genre"),
        first_filled(F.col("video_path")).alias("video_path"), "duration", F.coalesce("no_bugs", F.size(bugs) == 0).alias("no_bugs"), bugs.alias("bugs"), spans.alias("time_nodes"),
    )


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, item): entries of split files in order: a JSON list, an object
    with ``ids``, or one entry a line; blank lines are passed over."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("t"))
    items = F.when(F.col("t").startswith("["), F.from_json("t", "array<string>")).when(F.col("t").startswith("{"), F.from_json("t", "struct<ids:array<string>>")["ids"]).otherwise(F.filter(F.split("t", r"\r?\n"), lambda x: F.trim(x) != ""))
    return files.select("file", F.posexplode(items).alias("pos", "item")).select("file", "pos", F.trim("item").alias("item"))


def list_media(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the video files below a folder; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mp4").load(folder)
    return found.select("path")


def resolve_media(records: DataFrame, media: DataFrame, root: str) -> tuple[DataFrame, int]:
    """(records with ``video_path`` of their file, number of records without one).

    ``media``: path.  The places, the first that exists counts: in ``root`` by
    file name, in ``root`` below the game, the record's own absolute path, and any
    folder one below ``root`` (the first by name).  Records without a file are left
    out and counted; if none is left the run stops.  A file name is the record's
    ``video_name`` with ``.mp4``.
    """
    base = root.rstrip("/")
    files = media.select(F.regexp_replace("path", "^file:/*", "/").alias("_path")).distinct()
    name = F.concat("video_name", F.lit(".mp4"))
    places = F.array(
        F.struct(F.lit(0).alias("rank"), F.concat(F.lit(base + "/"), name).alias("_path")),
        F.struct(F.lit(1).alias("rank"), F.concat(F.lit(base + "/"), F.coalesce("game", F.lit("unknown")), F.lit("/"), name).alias("_path")),
        F.struct(F.lit(2).alias("rank"), F.when(F.col("video_path").startswith("/"), F.col("video_path")).alias("_path")),
    )
    keyed = records.withColumn("_row", F.struct("vid", "video_name", "game", "video_path"))
    wanted = keyed.select("_row", "video_name").distinct().select("_row", "video_name", F.col("_row.game").alias("game"), F.col("_row.video_path").alias("video_path"))
    named = wanted.select("_row", F.explode(places).alias("p")).select("_row", "p.rank", "p._path").join(files, "_path")
    below = files.where(F.regexp_extract("_path", "^(.*)/[^/]+/[^/]+$", 1) == base).select(F.regexp_extract("_path", r"([^/]*)\.mp4$", 1).alias("video_name"), "_path")
    other = wanted.select("_row", "video_name").join(below, "video_name").select("_path", "_row", F.lit(3).alias("rank"))
    best = named.select("_path", "_row", "rank").unionByName(other).groupBy("_row").agg(F.min(F.struct("rank", "_path"))["_path"].alias("_path"))
    joined = cut_lineage(keyed.join(best, "_row", "left"))
    kept = joined.where("_path is not null").withColumn("video_path", F.col("_path")).select(*records.columns)
    missing = joined.where("_path is null").count()
    require(not kept.isEmpty(), "no record has a video file")
    return kept, missing


def split_file(names: list[str], split: str) -> str:
    """The file of a split: the first by name that begins with the split's name
    (``train``, ``dev``, ``test``) in any case."""
    fitting = sorted(n for n in names if n.rsplit("/", 1)[-1].lower().startswith(split.lower()))
    require(bool(fitting), f"no file for the split {split}")
    return fitting[0]


def read_ground_truth(spark: SparkSession, path: str | None, records: DataFrame) -> DataFrame:
    """(vid, bug_pos, bug, spans) as an annotation file at ``path`` states them, or
    from the records where there is none."""
    return ground_truth(read_annotations(spark, path) if path else records)


def ground_truth(records: DataFrame) -> DataFrame:
    """(vid, bug_pos, bug, spans): the bugs whose entry has spans, by position."""
    zipped = records.select("vid", F.posexplode(F.arrays_zip("bugs", "time_nodes")).alias("bug_pos", "z"))
    return zipped.where("z.bugs is not null and size(z.time_nodes) > 0").select("vid", "bug_pos", F.col("z.bugs").alias("bug"), F.col("z.time_nodes").alias("spans"))


def match_report(report: DataFrame, split: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report rows of the split, report rows outside it, split items without a
    report), by the key form of ``video_name`` and ``item``."""
    mine = report.withColumn("_k", key_form(F.col("video_name")))
    wanted = split.select(key_form(F.col("item")).alias("_k")).where("_k is not null").distinct()
    return mine.join(wanted, "_k", "left_semi").drop("_k"), mine.join(wanted, "_k", "left_anti").drop("_k"), wanted.join(mine.select("_k"), "_k", "left_anti").withColumnRenamed("_k", "item")


def as_pairs(spans):
    """array<array<double>> of spans with fields start and end."""
    return F.transform(named_spans(spans, "start", "end"), lambda s: F.array(s["start"], s["end"]))
