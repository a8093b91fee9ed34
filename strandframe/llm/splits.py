"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators.scan import running_sum
from strandframe.operators.skew import follow_join, salted_join
from strandframe.session import cut_lineage

#: 2**HASH_BITS parts of the hash order of the roots are summed side by side.
HASH_BITS = 20


def _follow(df: DataFrame, column: str, parents: DataFrame, spread: list[str]) -> DataFrame:
    """``df`` with ``column`` replaced by its parent where ``parents`` (node,
    parent; unique on node) has one.  Nodes that hold many rows are salted."""
    joined = follow_join(df, parents.select(F.col("node").alias(column), F.col("parent").alias("_parent")), [column], spread, "left")
    return joined.withColumn(column, F.coalesce("_parent", F.col(column))).select(*df.columns)


def tied_pairs(records: DataFrame, game: Column, vid: Column) -> DataFrame:
    """Edges (node_a, node_b) between games that share a vid: the first game of
    each vid to each other one, so that n games give n - 1 edges, not all pairs."""
    pairs = records.select(game.alias("game"), vid.alias("vid")).where("game is not null and vid is not null").distinct()
    hubs = pairs.groupBy("vid").agg(F.min("game").alias("hub"), F.count("*").alias("_n")).where("_n > 1")
    edges = follow_join(pairs, hubs.drop("_n"), ["vid"], ["game"]).where("game <> hub")
    return edges.select(F.least("game", "hub").alias("node_a"), F.greatest("game", "hub").alias("node_b")).distinct()


def spanning_forest(edges: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Boruvka's algorithm: (forest edges, labels node -> root), written to the
    tables ``forest`` and ``labels`` of ``folder`` where that is given.

    In each round every component takes its smallest edge in a fixed random
    order (a hash, then the names), the taken edges join the forest, and the
    components along them are contracted into one root by pointer jumping.  Each
    round at least halves the components that still have edges.  Forest, parents
    and remaining edges are kept in the checkpoint folder.  The smallest edge is
    a partial aggregate and the joins salt heavy nodes, so a node may hold any
    share of the edges.  No edges give no rows.
    """
    live = cut_lineage(edges.select("node_a", "node_b", F.col("node_a").alias("a"), F.col("node_b").alias("b"), F.xxhash64("node_a", "node_b").alias("w")))
    labels = cut_lineage(live.select(F.explode(F.array("node_a", "node_b")).alias("node")).distinct().withColumn("root", F.col("node")))
    forest = live.select("node_a", "node_b").limit(0)
    while not live.isEmpty():
        ends = live.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e"), "w", "node_a", "node_b")
        picks = cut_lineage(ends.groupBy("e.node").agg(F.min(F.struct("w", "node_a", "node_b", "e.other")).alias("m")).select("node", "m.node_a", "m.node_b", "m.other"))
        forest = forest.unionByName(picks.select("node_a", "node_b").distinct())
        # an edge that both its ends took closes the only cycle of its tree
        both = picks.groupBy("node_a", "node_b").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("other").alias("other"), F.count("*").alias("n"))
        root = F.struct(F.col("low").alias("node"), F.col("low").alias("parent"))
        single = F.struct(F.col("low").alias("node"), F.col("other").alias("parent"))
        child = F.struct(F.col("high").alias("node"), F.col("low").alias("parent"))
        parents = cut_lineage(both.select(F.explode(F.when(F.col("n") == 2, F.array(root, child)).otherwise(F.array(single))).alias("p")).select("p.node", "p.parent"))
        while True:
            jumped = cut_lineage(_follow(parents.withColumn("was", F.col("parent")), "parent", parents, ["node"]))
            parents, moved = jumped.select("node", "parent"), jumped.where("parent <> was")
            if moved.isEmpty():
                break
        labels = cut_lineage(_follow(labels, "root", parents, ["node"]))
        near = _follow(live, "a", parents, ["node_a", "node_b"])
        far = _follow(near, "b", parents, ["node_a", "node_b"]).where("a <> b")
        least = far.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("w", "node_a", "node_b")).alias("m"))
        live = cut_lineage(least.select("m.node_a", "m.node_b", "a", "b", "m.w"))
    forest = cut_lineage(forest)
    if folder:
        for name, kept in (("forest", forest), ("labels", labels)):
            kept.write.mode("overwrite").parquet(f"{folder}/{name}")
    return forest, labels


def leads(labels: DataFrame) -> DataFrame:
    """(node, lead): the first node of each component by name."""
    first = labels.groupBy("root").agg(F.min("node").alias("parent")).withColumnRenamed("root", "node")
    return _follow(labels.withColumnRenamed("root", "lead"), "lead", first, ["node"])


def group_records(records: DataFrame, game: Column, vid: Column) -> DataFrame:
    """(rec_id, group): records tied by game or vid, directly or through others,
    share a group.  A record with neither is a group of its own."""
    keyed = records.select("rec_id", game.alias("game"), vid.alias("vid"))
    lead = leads(spanning_forest(tied_pairs(records, game, vid))[1])
    hub = keyed.where("game is not null and vid is not null").groupBy("vid").agg(F.min("game").alias("game"))
    by_vid = hub.select(F.concat(F.lit("vid:"), "vid").alias("node"), F.concat(F.lit("game:"), "game").alias("parent"))
    by_game = lead.select(F.concat(F.lit("game:"), "node").alias("node"), F.concat(F.lit("game:"), "lead").alias("parent"))
    own = F.coalesce(F.concat(F.lit("game:"), "game"), F.concat(F.lit("vid:"), "vid"), F.concat(F.lit("record:"), F.col("rec_id").cast("string")), F.lit("record:"))
    grouped = keyed.select("rec_id", own.alias("group"))
    return _follow(_follow(grouped, "group", by_vid, ["rec_id"]), "group", by_game, ["rec_id"])


def deal_splits(grouped: DataFrame, goals: list[tuple[str, float]]) -> DataFrame:
    """(rec_id, group, split_name): whole groups dealt to the splits by size.

    Groups are stratified by size band, a power of two.  Within a band they lie in
    the order of a hash, and each goes to the split in whose part of the band the
    middle of its records lies.  The bands are dealt from the largest groups down,
    and the parts of a band are what the splits still lack after those before, so
    a band makes up for what the larger groups could not: in the end a split
    misses its goal by about one of the smallest groups, unless a group is larger
    than a goal.  The driver sees one row per band and split (at most 64 bands).
    No goals or no records give no rows; goals are scaled to sum to 1.
    """
    total_goal = sum(share or 0.0 for _, share in goals)
    grouped = cut_lineage(grouped)
    sizes = grouped.groupBy("group").agg(F.count("*").alias("size"))
    banded = sizes.withColumn("band", F.floor(F.log2("size")).cast("int")).withColumn("place", F.xxhash64("group").bitwiseAND(F.lit((1 << 63) - 1)))
    laid = cut_lineage(running_sum(banded, ["band"], "place", "size", "upto", bits=63 - HASH_BITS, levels=1))
    bands = {r["band"]: r["n"] for r in laid.groupBy("band").agg(F.sum("size").alias("n")).collect()}
    if not bands or total_goal <= 0:
        return grouped.limit(0).withColumn("split_name", F.lit(None).cast("string"))
    total = sum(bands.values())
    lacking = {name: (share or 0.0) / total_goal * total for name, share in sorted(goals) if (share or 0.0) > 0}
    middle = F.col("upto") - F.col("size") / 2
    split = F.lit(None).cast("string")
    for band in sorted(bands, reverse=True):
        choice = _parts_of_band(middle, bands[band], lacking)
        for row in laid.where(F.col("band") == band).groupBy(choice.alias("split")).agg(F.sum("size").alias("n")).collect():
            lacking[row["split"]] -= row["n"]
        split = F.when(F.col("band") == band, choice).otherwise(split)
    return salted_join(grouped, laid.select("group", split.alias("split_name"), "size"), ["group"], "size", ["rec_id"])


def _parts_of_band(middle: Column, size: int, lacking: dict[str, float]) -> Column:
    """The split of a position in a band of ``size`` records, parted in
    proportion to what the splits lack.  The split that lacks most has the centre,
    where the middle of a group lies that is alone in its band."""
    lack = {name: max(0.0, n) for name, n in lacking.items()}
    whole, edge = sum(lack.values()), 0.0
    most, *rest = sorted(lack, key=lambda name: (-lack[name], name))
    choice = F.lit(most)
    edges = []
    for name in [*rest[::2], most, *rest[1::2]]:
        n = lack[name]
        edge += n / whole * size if whole else 0.0
        edges.append((name, edge, n))
    for name, upto, n in reversed(edges):
        if n > 0:
            choice = F.when(middle <= upto, F.lit(name)).otherwise(choice)
    return choice


def split_report(dealt: DataFrame, goals: DataFrame) -> DataFrame:
    """Goal and reached share of each split."""
    counts = dealt.groupBy("split_name").agg(F.count("*").alias("n_records"), F.countDistinct("group").alias("n_groups"))
    total = F.sum("n_records").over(Window.partitionBy())  # one row a split
    joined = goals.join(counts, "split_name", "left").fillna(0, ["n_records", "n_groups"])
    return joined.withColumn("reached_share", F.col("n_records") / F.greatest(total, F.lit(1)))
