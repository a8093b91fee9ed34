"""References to rows that do not exist, or not yet, or no more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.scan import running_sum
from strandframe.operators.skew import salted_join
from strandframe.session import cut_lineage


def orphan_rows(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of ``refs`` whose key no parent row satisfies at the row's own time.

    ``refs``: tab_name, row_id, target, ref_key, at (timestamp).
    ``parents``: target, ref_key, born, gone (timestamps; gone null = still there).
    A parent satisfies a reference when target and key agree, ``born <= at`` and
    ``gone`` is null or later than ``at``.  A null key is no reference and gives
    no row; a null ``at`` is satisfied by nothing; a parent without ``born`` or
    with ``gone <= born`` satisfies nothing.

    Method: the distinct non-null keys with their counts are anti-joined against
    the parent keys, both pre-aggregated, so that a hot key is one row there.
    Keys whose earliest lasting parent precedes all their references leave at
    once.  The rest is joined back to the rows with the heaviest keys salted.
    Only where a parent was deleted again may the key alone not decide; those
    points in time go through a prefix sum over parent births and deletions,
    which is spread over blocks of time.
    """
    key = ["target", "ref_key"]
    refs = refs.where(F.col("ref_key").isNotNull()).select("tab_name", "row_id", *key, "at")
    valid = parents.where(F.col("ref_key").isNotNull() & F.col("born").isNotNull() & (F.col("gone").isNull() | (F.col("gone") > F.col("born"))))
    wanted = refs.groupBy(*key).agg(F.count("*").alias("n_rows"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("at").alias("n_at"))
    offered = valid.groupBy(*key).agg(
        F.min(F.when(F.col("gone").isNull(), F.col("born"))).alias("open_from"),
        F.min(F.when(F.col("gone").isNotNull(), F.col("born"))).alias("closed_from"),
        F.max("gone").alias("closed_to"),
    )
    settled = F.col("open_from").isNotNull() & (F.col("open_from") <= F.col("first_at")) & (F.col("n_at") == F.col("n_rows"))
    suspects = cut_lineage(wanted.join(offered, key, "left").where(~settled).select(*key, "n_rows", "open_from", "closed_from", "closed_to"))

    rows = salted_join(refs, suspects, key, "n_rows", ["tab_name", "row_id"])
    rows = cut_lineage(rows.where(F.col("at").isNull() | F.col("open_from").isNull() | (F.col("at") < F.col("open_from"))))
    unclear = F.coalesce((F.col("at") >= F.col("closed_from")) & (F.col("at") < F.col("closed_to")), F.lit(False))
    plain = rows.where(~unclear).select("tab_name", "row_id", "at")

    doubtful = rows.where(unclear).select("tab_name", "row_id", *key, F.unix_micros(F.col("at").cast("timestamp")).alias("pos"))
    points = doubtful.groupBy(*key, "pos").agg(F.count("*").alias("points"))
    closed = valid.where(F.col("gone").isNotNull()).join(suspects.where("closed_from is not null").select(*key), key, "left_semi")
    edges = closed.select(*key, F.explode(F.array(F.struct(F.unix_micros(F.col("born").cast("timestamp")).alias("pos"), F.lit(1).alias("step")), F.struct(F.unix_micros(F.col("gone").cast("timestamp")).alias("pos"), F.lit(-1).alias("step")))).alias("e"))
    moves = edges.select(*key, "e.pos", "e.step", F.lit(0).cast("bigint").alias("points")).unionByName(points.select(*key, "pos", F.lit(0).alias("step"), "points"))
    summed = moves.groupBy(*key, "pos").agg(F.sum("step").alias("step"), F.sum("points").alias("points"))
    counted = running_sum(summed, key, "pos", "step", "alive")
    missed = cut_lineage(counted.where("points > 0 and alive = 0").select(*key, "pos", "points"))
    late = salted_join(doubtful, missed, [*key, "pos"], "points", ["tab_name", "row_id"])
    return plain.unionByName(late.select("tab_name", "row_id", F.timestamp_micros("pos").cast(refs.schema["at"].dataType).alias("at")))


def orphan_counts(orphans: DataFrame, refs: DataFrame) -> DataFrame:
    """Orphans, references and their share per table and calendar month of
    ``at`` (null month for a null ``at``)."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    lost = orphans.groupBy("tab_name", month).agg(F.count("*").alias("orphans"))
    all_rows = refs.where(F.col("ref_key").isNotNull()).groupBy("tab_name", month).agg(F.count("*").alias("n_refs"))
    joined = all_rows.alias("a").join(lost.alias("l"), F.col("a.tab_name").eqNullSafe(F.col("l.tab_name")) & F.col("a.month").eqNullSafe(F.col("l.month")), "left")
    n = F.coalesce("l.orphans", F.lit(0).cast("bigint"))
    return joined.select("a.tab_name", "a.month", "a.n_refs", n.alias("orphans"), (n / F.col("a.n_refs")).alias("share"))
