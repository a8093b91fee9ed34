"""Sweep line: intervals of an owner become continuous periods and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A block spans 2**BLOCK_BITS position units (17.5 minutes of milliseconds).
#: Boundaries are aggregated per position first, so a block holds at most that
#: many rows however hot its owner is.
BLOCK_BITS = 20


def clean_intervals(df: DataFrame, owner: list[str], start: Column, end: Column) -> DataFrame:
    """Distinct (owner, from, to): reversed ends swapped, null ends and length 0
    dropped, null owners dropped."""
    ready = df.select(*owner, F.least(start, end).alias("from_pos"), F.greatest(start, end).alias("to_pos"), (start.isNotNull() & end.isNotNull()).alias("_whole"))
    ready = ready.where(F.col("_whole") & (F.col("from_pos") < F.col("to_pos"))).drop("_whole")
    for name in owner:
        ready = ready.where(F.col(name).isNotNull())
    return ready.distinct()


def cover_periods(intervals: DataFrame, owner: list[str], bits: int = BLOCK_BITS, count: bool = False) -> DataFrame:
    """Continuous periods of each owner from distinct (owner, from_pos, to_pos).

    Positions are integers or finite numbers; a block spans 2**bits of them.
    Result: owner, ``from_pos``, ``to_pos``, ``depth`` (most intervals active at
    once), ``prev_to`` (end of the period before, null for the first) and, with
    ``count``, ``n`` (intervals of the period).
    Touching intervals share a period.  An empty input gives no rows.

    Each interval gives +1 at its start and -1 at its end; the events are summed
    per position (pre-aggregated before the shuffle), and a prefix sum over the
    positions gives the active count.  The sum runs per block of positions with
    the totals of earlier blocks carried in, so an owner with a third of all
    rows is spread over as many tasks as it has blocks.  A period that crosses
    blocks is put together from its fragments, of which a block has at most two.
    """
    event = F.explode(F.array(F.struct(F.col("from_pos").alias("pos"), F.lit(1).alias("step")), F.struct(F.col("to_pos").alias("pos"), F.lit(-1).alias("step"))))
    events = intervals.select(*owner, event.alias("e")).select(*owner, "e.pos", "e.step")
    net = events.groupBy(*owner, "pos").agg(F.sum("step").alias("net"), *([F.count_if(F.col("step") > 0).alias("starts")] if count else []))
    whole = dict(intervals.dtypes)["from_pos"] in ("bigint", "int")
    block = F.shiftright("pos", bits) if whole else F.floor(F.col("pos") / (1 << bits))
    net = (net if count else net.where("net <> 0")).withColumn("blk", block)

    before = Window.partitionBy(*owner).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = net.groupBy(*owner, "blk").agg(F.sum("net").alias("total"), F.max("pos").alias("last_pos"))
    carry = blocks.select(*owner, "blk", F.sum("total").over(before).alias("carry"), F.max("last_pos").over(before).alias("carry_pos")).where("carry_pos is not null")

    inside = Window.partitionBy(*owner, "blk").orderBy("pos")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = net.select("*", F.sum("net").over(upto).alias("run"), F.lag("pos").over(inside).alias("prev_pos"))
    active = local.join(carry, [*owner, "blk"], "left").select(
        *owner, "blk", "pos",
        (F.col("run") + F.coalesce("carry", F.lit(0))).alias("after"),
        (F.col("run") + F.coalesce("carry", F.lit(0)) - F.col("net") == 0).alias("opens"),
        F.coalesce("prev_pos", "carry_pos").alias("prev_pos"),
        *(["starts"] if count else []),
    )
    numbered = active.withColumn("frag", F.sum(F.col("opens").cast("int")).over(upto))
    frags = numbered.groupBy(*owner, "blk", "frag").agg(
        F.min(F.when(F.col("opens"), F.col("pos"))).alias("from_pos"),
        F.max(F.when(F.col("after") == 0, F.col("pos"))).alias("to_pos"),
        F.max("after").alias("depth"),
        F.max(F.when(F.col("opens"), F.col("prev_pos"))).alias("prev_to"),
        *([F.sum("starts").alias("n")] if count else []),
    )
    complete = F.col("from_pos").isNotNull() & F.col("to_pos").isNotNull()
    order = Window.partitionBy(*owner).orderBy("blk", "frag").rowsBetween(Window.unboundedPreceding, 0)
    pieces = frags.where(~complete).withColumn("period", F.count("from_pos").over(order))
    crossing = pieces.groupBy(*owner, "period").agg(F.min("from_pos").alias("from_pos"), F.max("to_pos").alias("to_pos"), F.max("depth").alias("depth"), F.max("prev_to").alias("prev_to"), *([F.sum("n").alias("n")] if count else []))
    columns = [*owner, "from_pos", "to_pos", "depth", "prev_to", *(["n"] if count else [])]
    return frags.where(complete).select(*columns).unionByName(crossing.select(*columns))


def overlaps_and_gaps(periods: DataFrame, owner: list[str], longest_gap: int | None) -> DataFrame:
    """Rows (owner, kind, from_pos, to_pos): ``merged`` for each period of depth
    two or more, ``gap`` for the space before a period unless longer than
    ``longest_gap``."""
    span = F.col("from_pos") - F.col("prev_to")
    gap = F.col("prev_to").isNotNull() & (span > 0)
    if longest_gap is not None:
        gap = gap & (span <= longest_gap)
    merged = F.when(F.col("depth") >= 2, F.struct(F.lit("merged").alias("kind"), F.col("from_pos"), F.col("to_pos")))
    hole = F.when(gap, F.struct(F.lit("gap").alias("kind"), F.col("prev_to").alias("from_pos"), F.col("from_pos").alias("to_pos")))
    rows = periods.select(*owner, F.explode(F.array_compact(F.array(merged, hole))).alias("r"))
    return rows.select(*owner, "r.kind", "r.from_pos", "r.to_pos")
