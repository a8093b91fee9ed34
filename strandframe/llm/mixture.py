"""Mixing sources to target weights, interleaved by a Pfair schedule."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.keys import source_form
from strandframe.llm.tokenization import count_tokens
from strandframe.operators.scan import running_sum
from strandframe.session import cut_lineage

#: Most tokens of one block of the schedule.
BLOCK_TOKENS = 4096
#: One period of the schedule, which the driver makes and broadcasts, has at most
#: so many slots; a larger corpus repeats the period, its blocks stay as long.
MAX_SLOTS = 1 << 18
#: 2**HASH_BITS parts of the hash order of the documents are summed side by side.
HASH_BITS = 20


@dataclass(frozen=True)
class SourcePlan:
    """What one source gives: whole passes over its documents, then ``rest`` tokens."""

    source: str
    goal_share: float
    max_repeats: int
    tokens: int
    passes: int
    rest: float


def plan_source(source: str, goal_share: float, max_repeats: int, tokens: int, total: int) -> SourcePlan:
    """A source gives its share of ``total``, or all its tokens ``max_repeats`` times if that is less."""
    wanted = min((goal_share or 0.0) * total, float(tokens) * max(max_repeats or 0, 0))
    passes = int(wanted // tokens) if tokens else 0
    return SourcePlan(source, goal_share, max_repeats, tokens, passes, wanted - passes * tokens if tokens else 0.0)


def pfair_slots(blocks: list[int]) -> list[tuple[int, int]]:
    """Slot by slot, the (source, block) that runs.  Source ``s`` has weight
    ``blocks[s] / N``; its block ``k`` is released at floor(k/weight) and due at
    ceil((k+1)/weight).  The released block with the earliest deadline runs, so
    at any time each source is less than one block from its weight."""
    total = sum(blocks)
    ready: list[tuple[int, int, int]] = []
    waiting: list[tuple[int, int, int]] = []
    for s, n in enumerate(blocks):
        if n > 0:
            heapq.heappush(waiting, (0, s, 0))
    slots = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // blocks[s]), s, k))
        _, s, k = heapq.heappop(ready)
        slots.append((s, k))
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * total // blocks[s], s, k + 1))
    return slots


def choose_documents(documents: DataFrame, goals: DataFrame, rank_file: str | None = None) -> tuple[DataFrame, list[SourcePlan], int]:
    """How often each document is used.

    ``documents``: doc_id, text, source; ``goals``: source, goal_share,
    max_repeats (a small fixed table, read to the driver; of several rows of a
    source that of the largest share counts).  Result: doc_id,
    source, n_tokens, before (tokens of the source before the document, in the
    order of a hash of doc_id), copies; the plans; the tokens of all documents
    once.  Sources are compared trimmed, in lower case, with ``-`` read as ``_``.
    Documents without tokens and of sources without a goal are not used.  A
    source gives whole passes over its documents and then the first documents in
    hash order, so it misses its target by half a document at most, unless
    ``max_repeats`` binds; a shortfall is not made up by other sources.
    """
    counted = cut_lineage(count_tokens(documents, "text", ["doc_id", "source"], rank_file).withColumn("source", source_form(F.col("source"))))
    named = goals.select(source_form(F.col("source")).alias("source"), "goal_share", "max_repeats").where("source is not null")
    wanted = named.groupBy("source").agg(F.max(F.struct("goal_share", "max_repeats")).alias("g")).select("source", "g.*").collect()
    by_source = counted.join(F.broadcast(goals.select(source_form(F.col("source")).alias("source")).distinct()), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    supply = {row["source"]: row["tokens"] or 0 for row in by_source.collect()}
    total = counted.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).collect()[0]["n"]
    plans = [plan_source(r["source"], r["goal_share"], r["max_repeats"], supply.get(r["source"], 0), total) for r in sorted(wanted, key=lambda r: r["source"])]
    spark = documents.sparkSession
    rows = [(p.source, p.passes, p.rest, p.tokens) for p in plans]
    plan_table = spark.createDataFrame(rows, "source string, passes int, rest double, supply bigint")
    ordered = counted.where("n_tokens > 0").join(F.broadcast(plan_table), "source").withColumn("place", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 63) - 1)))
    placed = running_sum(ordered, ["source"], "place", "n_tokens", "upto", bits=63 - HASH_BITS, levels=1)
    extra = (F.col("rest") > 0) & (F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest"))
    used = placed.select("doc_id", "source", "n_tokens", "supply", (F.col("upto") - F.col("n_tokens")).alias("before"), (F.col("passes") + extra.cast("int")).alias("copies"))
    return used, plans, total


def mix_report(used: DataFrame, plans: list[SourcePlan], total: int) -> DataFrame:
    """Per source: goal and reached share of the total, tokens, documents and the
    most copies of one document."""
    spark = used.sparkSession
    goals = spark.createDataFrame([(p.source, p.goal_share, p.max_repeats, p.tokens) for p in plans], "source string, goal_share double, max_repeats int, supply_tokens bigint")
    sums = used.where("copies > 0").groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("used_tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    joined = goals.join(sums, "source", "left").fillna(0, ["used_tokens", "n_docs", "most_copies"])
    return joined.withColumn("total_tokens", F.lit(total)).withColumn("reached_share", F.col("used_tokens") / F.greatest(F.lit(total), F.lit(1)))


@dataclass(frozen=True)
class Period:
    """Blocks of each source in one period of the schedule, and how often it runs."""

    blocks: dict[str, int]
    runs: int

    @property
    def slots(self) -> int:
        """Slots of one period."""
        return sum(self.blocks.values())


def plan_period(tokens: dict[str, int], block_tokens: int = BLOCK_TOKENS, max_slots: int = MAX_SLOTS) -> Period:
    """The shortest row of equal periods of at most ``max_slots`` slots (or one a
    source) in which no block holds more than ``block_tokens``.  A source has the
    same whole number of equal blocks in every period, so its weight is exact."""
    filled = {name: n for name, n in tokens.items() if n > 0}
    room = max(1, max_slots - len(filled))
    runs = max(1, -(-sum(filled.values()) // (block_tokens * room)))
    return Period({name: -(-n // (block_tokens * runs)) for name, n in sorted(filled.items())}, runs)


def interleave(used: DataFrame, block_tokens: int = BLOCK_TOKENS, max_slots: int = MAX_SLOTS) -> DataFrame:
    """One row per copy of a document: doc_id, source, copy, n_tokens, block (of
    its source), slot (in the schedule of all sources).  A copy belongs to the
    block in which it begins.  At every slot each source is less than one of its
    blocks, which are no longer than ``block_tokens``, from its share."""
    return _slotted(used, block_tokens, max_slots).select("doc_id", "source", "copy", "n_tokens", "block", "slot")


def largest_lag(used: DataFrame, block_tokens: int = BLOCK_TOKENS, max_slots: int = MAX_SLOTS) -> DataFrame:
    """(source, block_tokens, lag): per source the size of its blocks and the most
    blocks, before or after one of its slots, that it is from its share."""
    share = F.col("per_period") / F.col("slots")
    lag = F.greatest(F.abs(F.col("block") - F.col("slot") * share), F.abs(F.col("block") + 1 - (F.col("slot") + 1) * share))
    return _slotted(used, block_tokens, max_slots).groupBy("source").agg(F.max("block_size").alias("block_tokens"), F.max(lag).alias("lag"))


def _slotted(used: DataFrame, block_tokens: int, max_slots: int) -> DataFrame:
    spark = used.sparkSession
    used = cut_lineage(used.where("copies > 0"))
    sums = {r["source"]: r["n"] for r in used.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n")).collect()}
    period = plan_period(sums, block_tokens, max_slots)
    names = list(period.blocks)
    order = pfair_slots([period.blocks[n] for n in names])
    rows = pa.table({"source": pa.array([names[s] for s, _ in order], pa.string()), "within": pa.array([k for _, k in order], pa.int64()), "place": pa.array(range(len(order)), pa.int64())})
    schedule = spark.createDataFrame(rows)
    sizes = spark.createDataFrame([(n, q, q * period.runs, sums[n] / (q * period.runs), period.slots) for n, q in period.blocks.items()], "source string, per_period bigint, n_blocks bigint, block_size double, slots bigint")
    copies = used.select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")).join(F.broadcast(sizes), "source")
    start = F.col("copy").cast("bigint") * F.col("supply") + F.col("before")
    placed = copies.withColumn("block", F.least(F.floor(start / F.col("block_size")), F.col("n_blocks") - 1)).withColumn("within", F.col("block") % F.col("per_period"))
    slot = F.floor(F.col("block") / F.col("per_period")) * F.col("slots") + F.col("place")
    return placed.join(F.broadcast(schedule), ["source", "within"]).withColumn("slot", slot)
