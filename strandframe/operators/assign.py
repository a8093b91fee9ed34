"""Optimal one-to-one assignment within groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Cells of the matrices that are solved at once.
STACKED_CELLS = 1 << 20


def best_assignments(ratings: np.ndarray) -> np.ndarray:
    """Of each matrix (row, column) of a stack, with no more rows than columns, the
    row that each column takes in the assignment with the greatest sum, else -1.
    Shortest augmenting paths with potentials, O(n²m) a matrix; each row takes the
    lowest column among equal paths.  The searches of all matrices go step by step
    together, those that are done drop out."""
    k, rows, columns = ratings.shape
    cost, every = -np.asarray(ratings, dtype=float), np.arange(k)
    taken = np.full((k, columns), -1)
    row_price, column_price = np.zeros((k, rows)), np.zeros((k, columns))
    for start in range(rows):
        reach, came = np.full((k, columns), np.inf), np.full((k, columns), -1)
        done = np.zeros((k, columns), dtype=bool)
        row, at, so_far, live = np.full(k, start), np.full(k, -1), np.zeros(k), every
        while live.size:
            slack = so_far[live, None] + cost[live, row[live]] - row_price[live, row[live]][:, None] - column_price[live]
            better = ~done[live] & (slack < reach[live])
            reach[live], came[live] = np.where(better, slack, reach[live]), np.where(better, at[live, None], came[live])
            at[live] = np.argmin(np.where(done[live], np.inf, reach[live]), axis=1)
            so_far[live], done[live, at[live]] = reach[live, at[live]], True
            row[live] = taken[live, at[live]]
            live = live[row[live] >= 0]
        row_price[:, start] += so_far
        done[every, at] = False
        m, c = np.nonzero(done)
        row_price[m, taken[m, c]] += so_far[m] - reach[m, c]
        column_price[m, c] -= so_far[m] - reach[m, c]
        live = every
        while live.size:
            to, before = at[live], came[live, at[live]]
            taken[live, to] = np.where(before < 0, start, taken[live, before])
            at[live] = before
            live = live[before >= 0]
    return taken


def best_assignment(ratings: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a rating matrix with the greatest sum: min(n, m)
    pairs, those of rating 0 included."""
    rows, columns = ratings.shape
    if rows == 0 or columns == 0:
        return []
    if rows > columns:
        return sorted((r, c) for c, r in best_assignment(ratings.T))
    return sorted((int(r), c) for c, r in enumerate(best_assignments(ratings[None])[0]) if r >= 0)


def _solved(cells: pa.Table) -> pa.RecordBatch:
    """The assigned pairs of whole groups, whose cells follow one another: group,
    row, column, rating, places of row and column and of the cell (from 1)."""
    r, c, k, v = (cells.column(i).to_numpy() for i in (4, 5, 6, 3))
    r, c, group = r - 1, c - 1, np.cumsum(k == 1) - 1
    first = np.flatnonzero(k == 1)
    n, m = (np.maximum.reduceat(x, first) + 1 for x in (r, c))
    # where the names of a group's rows and columns stand
    row_at, column_at = np.cumsum(n) - n, np.cumsum(m) - m
    row_name, column_name = np.empty(n.sum(), dtype=int), np.empty(m.sum(), dtype=int)
    row_name[row_at[group] + r] = column_name[column_at[group] + c] = np.arange(len(group))
    order = np.lexsort((m, n))
    ends = np.append(first[1:], len(group))
    pairs = []
    at = 0
    while at < len(order):
        rows, columns = int(n[order[at]]), int(m[order[at]])
        alike = np.searchsorted(n[order[at:]] * (m.max() + 1) + m[order[at:]], rows * (m.max() + 1) + columns, side="right")
        own = order[at : at + min(alike, max(1, STACKED_CELLS // (rows * columns)))]
        at += len(own)
        sizes = ends[own] - first[own]
        cell = np.repeat(first[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        stack = np.zeros((len(own), rows, columns))
        stack[np.repeat(np.arange(len(own)), sizes), r[cell], c[cell]] = v[cell]  # of repeated cells the last, which is the highest
        swap = rows > columns
        taken = best_assignments(stack.transpose(0, 2, 1) if swap else stack)
        g, across = np.nonzero(taken >= 0)
        i, j = (across, taken[g, across]) if swap else (taken[g, across], across)
        pairs.append((own[g], i, j, stack[g, i, j]))
    g, i, j, best = (np.concatenate(x) for x in zip(*pairs))
    return pa.RecordBatch.from_arrays([*(cells.column(x).take(pa.array(y)).combine_chunks() for x, y in ((0, first[g]), (1, row_name[row_at[g] + i]), (2, column_name[column_at[g] + j]))), pa.array(best)], names=cells.column_names[:4])


def assign_within(ratings: DataFrame, group: str, row: str, column: str, rating: str) -> DataFrame:
    """(group, row, column, rating): the best assignment of each group's rating
    pairs; missing pairs rate 0, of repeated ones the highest counts.  A group is
    one video, whose matrix fits a task; the groups of a batch are solved together,
    stacked by shape.  Null and NaN keys and ratings are left out."""
    types = dict(ratings.dtypes)
    cells = ratings.select(group, row, column, F.col(rating).cast("double").alias(rating)).dropna(subset=[row, column, rating]).where(F.col(group).isNotNull())
    within = Window.partitionBy(group)
    placed = cells.withColumn("_c", F.dense_rank().over(within.orderBy(column))).withColumn("_r", F.dense_rank().over(within.orderBy(row))).withColumn("_k", F.row_number().over(within.orderBy(row, column, rating)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(6).to_numpy() == 1)
            if len(starts):  # the last group may go on
                whole = [*held, batch.slice(0, int(starts[-1]))]
                held = []
                if sum(b.num_rows for b in whole):
                    yield _solved(pa.Table.from_batches(whole))
            held.append(batch.slice(int(starts[-1]) if len(starts) else 0))
        if sum(b.num_rows for b in held):
            yield _solved(pa.Table.from_batches(held))

    return placed.select(group, row, column, rating, "_r", "_c", "_k").mapInArrow(run, f"`{group}` {types[group]}, `{row}` {types[row]}, `{column}` {types[column]}, `{rating}` double")


def is_best(ratings: np.ndarray, pairs: list[tuple[int, int]], tolerance: float = 1e-9) -> bool:
    """Whether pairs are one to one and no change of partners along a cycle or path
    has a greater sum: the residual graph of an optimal assignment has no gain."""
    rows, columns = ratings.shape
    if len(pairs) != min(rows, columns) or len({r for r, _ in pairs}) != len(pairs) or len({c for _, c in pairs}) != len(pairs):
        return False
    n = max(rows, columns)
    full = np.zeros((n, n))
    full[:rows, :columns] = ratings
    partner = np.full(n, -1)
    for r, c in pairs:
        partner[r] = c
    partner[partner < 0] = sorted(set(range(n)) - set(partner[partner >= 0].tolist()))
    # gain of row i taking the column of row j; a positive cycle would be an improvement
    gain = full[:, partner] - full[np.arange(n), partner][:, None]
    reach = np.zeros(n)
    for _ in range(n + 1):
        longer = np.maximum(reach, (reach[:, None] + gain).max(axis=0))
        if np.all(longer <= reach + tolerance):
            return True
        reach = longer
    return False


def assignment_check(ratings: DataFrame, pairs: DataFrame, group: str, row: str, column: str, rating: str) -> DataFrame:
    """(group, best): whether the pairs (group, row, column) of each group are a best
    assignment of its ratings; missing pairs rate 0."""
    types = dict(ratings.dtypes)
    marked = pairs.select(group, row, column, F.lit(True).alias("_paired"))
    both = ratings.groupBy(group, row, column).agg(F.max(rating).alias(rating)).join(marked, [group, row, column], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index=row, columns=column, values=rating, aggfunc="max", fill_value=0).sort_index().sort_index(axis=1)
        taken = pdf[pdf["_paired"].notna()]
        found = list(zip(table.index.get_indexer(taken[row]), table.columns.get_indexer(taken[column])))
        return pd.DataFrame({group: [pdf[group].iloc[0]], "best": [is_best(table.to_numpy(dtype=float), found)]})

    return both.where(F.col(group).isNotNull()).groupBy(group).applyInPandas(run, f"`{group}` {types[group]}, best boolean")
