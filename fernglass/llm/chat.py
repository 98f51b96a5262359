"""Minimum-cost role repair of conversations, then rendering.

Legal: an optional system turn first, then user and assistant in turn, user first. Each input turn is written
under one of the three roles; a dynamic program over the automaton's states (no turn yet, or the role of the last
written turn) picks the cheapest mix of
  relabel  write the turn under another role than its own (cheaper if its own role is unknown or null)
  merge    append it to the last written turn of the same role
  insert   write an empty turn in between to make the next one legal
Costs are integers and ties go to the first role in the order system, user, assistant, so results are unique.

A conversation of any length is cut into segments of turn numbers, and a segment of more than CROWD rows (null or
repeated turns) into ordered pieces. A segment is first summed up as a min-plus matrix (state in, state out, cost and rank),
computed where its rows are; the matrices of a conversation are chained to fix each segment's states; then every
segment is rendered by itself. No task needs a whole conversation. All segments of a batch are worked on together, a
turn of each at a time.

Edge cases: null turns come first, equal turns are ordered by role and text; a null text counts as empty; unknown
and null roles are relabelled; rows with a null conv_id form one conversation; repeated rows are turns of their
own (they merge); texts of any length are rendered whole; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shuffles, table

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
RELABEL, UNKNOWN, MERGE, INSERT = 4, 1, 2, 3
FAR = 1 << 40
#: Turn numbers in a segment, and rows of a segment above which it is cut further, into pieces of PIECE rows.
SEGMENT, CROWD, PIECE = 256, 1 << 16, 4096
#: What has to be inserted, in order, to write role x after state s; None where x merges into s.
BETWEEN: dict[tuple[int, int], tuple[int, ...] | None] = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, SYSTEM): None, (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, USER): None, (USER, ASSISTANT): (),
    (ASSISTANT, ASSISTANT): None, (ASSISTANT, USER): (),
}
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def step_cost(state: int, role: int, own: int) -> int:
    """Cost of writing a turn whose own role is `own` (0 if unknown) under `role` after `state`."""
    if (state, role) not in BETWEEN:
        return FAR
    between = BETWEEN[state, role]
    cost = MERGE if between is None else INSERT * len(between)
    return cost + (0 if own == role else UNKNOWN if own == START else RELABEL)


#: COST[own, state, role]
COST = np.array([[[step_cost(s, r, own) if r else FAR for r in range(4)] for s in range(4)] for own in range(4)], np.int64)
#: The same as steps: four times the cost, plus the rank (0 to 3) of the entry's first state among the four that lead to
#: its last one. Of equal costs the lower rank is taken; of one turn the rank is the state itself.
STEP = COST * 4 + np.arange(4)[:, None]


def composed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Steps a, then b (arrays of 4 x 4 steps), as steps. Of two ways with one cost the one that b ranks lower is taken, then
    by a: so a path is the same one however its turns are cut into segments."""
    ways = ((a >> 2)[:, :, :, None] + (b >> 2)[:, None]) * 4 + (b & 3)[:, None]
    middle = ways.argmin(axis=2)
    cost = np.take_along_axis(ways, middle[:, :, None], 2)[:, :, 0] >> 2
    # The rank that b gives the middle state, then the one that a gives the first state on the way to it.
    order = np.take_along_axis(b & 3, middle, 1) * 4 + np.take_along_axis(a & 3, middle, 2)
    return np.minimum(cost, FAR) * 4 + order.argsort(axis=1).argsort(axis=1)


def lead_in(state: int, role: int) -> str:
    """What is written before a turn's text."""
    between = BETWEEN.get((state, role), ())
    if between is None:
        return "\n"
    return (CLOSE if state != START else "") + "".join(OPEN.format(ROLES[x - 1]) + CLOSE for x in between) + (OPEN.format(ROLES[role - 1]) if role else "")


LEADS = [[lead_in(s, r) for r in range(4)] for s in range(4)]
INSERTED = [[",".join(ROLES[x - 1] for x in BETWEEN.get((s, r)) or ()) for r in range(4)] for s in range(4)]
KEY = ["conv", "segment", "piece"]


def role_ids(roles: pd.Series) -> np.ndarray:
    return roles.map({name: i + 1 for i, name in enumerate(ROLES)}).fillna(START).astype(int).to_numpy()


class Runs:
    """The runs of equal keys in a sorted frame, the longest first, so that those with a t-th row are a prefix."""

    def __init__(self, rows: pd.DataFrame, key: list[str]):
        new = np.ones(len(rows), bool)
        new[1:] = False
        for name in key:
            values = rows[name].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(rows)))
        order = np.argsort(-lengths, kind="stable")
        self.place = np.argsort(order)  # of each run, in order of the rows
        self.starts, self.lengths = starts[order], lengths[order]
        self.first = starts

    def steps(self) -> Iterator[np.ndarray]:
        """Row numbers of the t-th rows, for t from 0."""
        live = np.searchsorted(-self.lengths, -np.arange(int(self.lengths[0])), side="left")
        for t, n in enumerate(live):
            yield self.starts[:n] + t


def cheapest_paths(runs: Runs, steps_of, enter: np.ndarray, leave: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state before, state after) each row and the cost of each run, whose rows are the steps steps_of(rows).

    Runs start in `enter`; they end in `leave`, or where it is cheapest."""
    steps = list(runs.steps())
    n = sum(map(len, steps))
    reach = np.full((len(runs.starts), 4), FAR, np.int64)
    reach[np.arange(len(reach)), enter] = 0
    before = np.empty((n, 4), np.int64)
    for rows in steps:
        live = reach[: len(rows)]
        before[rows] = live
        reach[: len(rows)] = (live[:, :, None] + (steps_of(rows) >> 2)).min(axis=1)
    at = reach.argmin(axis=1) if leave is None else leave.copy()
    cost = reach[np.arange(len(reach)), at]
    states = np.empty((2, n), np.int64)
    for rows in reversed(steps):
        live = at[: len(rows)]
        states[1, rows] = live
        back = np.take_along_axis(steps_of(rows), live[:, None, None], 2)[:, :, 0]
        at[: len(rows)] = states[0, rows] = (before[rows] * 4 + back).argmin(axis=1)
    return states[0], states[1], cost


def whole_runs(batches: Iterable[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that hold every row of each of their keys; a partition is sorted by key."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = np.ones(len(batch), bool)
        for name in key:
            last &= (batch[name] == batch[name].iloc[-1]).to_numpy()
        start = len(batch) - int(last.sum())
        if start or (held and any(held[-1][name].iloc[-1] != batch[name].iloc[0] for name in key)):
            yield pd.concat([*held, batch.iloc[:start]], ignore_index=True)
            held = []
        held.append(batch.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True)


def summed_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a piece: its min-plus matrix, row by row. Of a piece that goes on in the next batch only its matrix so far
    is held."""
    open_key, open_matrix = None, None
    for batch in batches:
        if not len(batch):
            continue
        runs, own = Runs(batch, KEY), role_ids(batch["role"])
        matrices = STEP[own[runs.starts]]
        for t, rows in enumerate(runs.steps()):
            if t:
                matrices[: len(rows)] = composed(matrices[: len(rows)], STEP[own[rows]])
        matrices = matrices[runs.place]
        keys = [tuple(x) for x in batch.iloc[runs.first][KEY].itertuples(index=False)]
        if open_key == keys[0]:
            matrices[:1] = composed(open_matrix[None], matrices[:1])
        elif open_key is not None:
            keys.insert(0, open_key)
            matrices = np.concatenate([open_matrix[None], matrices])
        open_key, open_matrix = keys[-1], matrices[-1]
        if len(keys) > 1:
            yield pd.DataFrame(keys[:-1], columns=KEY).assign(matrix=list(matrices[:-1].reshape(-1, 16)))
    if open_key is not None:
        yield pd.DataFrame([open_key], columns=KEY).assign(matrix=[open_matrix.ravel()])


def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For every piece of a conversation the state it starts in and the one it has to end in."""
    for rows in whole_runs(batches, ["conv"]):
        runs = Runs(rows, ["conv"])
        matrices = np.stack(rows["matrix"].to_numpy()).reshape(-1, 4, 4)
        enter, leave, cost = cheapest_paths(runs, lambda k, m=matrices: m[k], np.zeros(len(runs.starts), np.int64), None)
        ends = np.zeros(len(rows), bool)
        ends[runs.starts + runs.lengths - 1] = True
        yield rows[KEY].assign(enter=enter, leave=leave, cost=np.repeat(cost[runs.place], runs.lengths[runs.place]), last=ends)


def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each turn with its role, its action and the text it adds to the rendered conversation."""
    for rows in whole_runs(batches, KEY):
        runs, own = Runs(rows, KEY), role_ids(rows["role"])
        ends = np.zeros(len(rows), bool)
        ends[runs.starts + runs.lengths - 1] = True
        enter, leave = (rows[name].to_numpy()[runs.starts].astype(np.int64) for name in ("enter", "leave"))
        before, after, _ = cheapest_paths(runs, lambda k, own=own: STEP[own[k]], enter, leave)
        closing = ends & rows["last"].to_numpy(bool)
        merges, kept = (before == after) & (before != START), own == after
        actions = np.where(merges, np.where(kept, "merge", "relabel+merge"), np.where(kept, "keep", "relabel"))
        moves = list(zip(before.tolist(), after.tolist(), strict=True))
        pieces = [LEADS[b][a] + text + (CLOSE if c else "") for (b, a), text, c in zip(moves, rows["text"], closing.tolist(), strict=True)]
        yield rows[["conv", "segment", "position", "turn", "no_turn", "role", "cost"]].assign(
            new_role=[ROLES[a - 1] for _, a in moves], action=actions, inserted=[INSERTED[b][a] for b, a in moves], rendered=pieces
        )[OUT]


OUT = ["conv", "segment", "position", "turn", "no_turn", "role", "new_role", "action", "inserted", "rendered", "cost"]
NULL_TURNS = -(1 << 62)
#: Turns of a segment either all have a number or none.
ORDER = ["turn", "role", "text"]


def _pieces(rows: DataFrame, crowd: int, size: int) -> tuple[DataFrame, list[str]]:
    """`rows` with piece, and what they are dealt to tasks by: whole segments (piece 0), but if any has more than `crowd` rows,
    these are dealt by ranges of their order and numbered there in pieces of `size` rows."""
    every = rows.withColumn("piece", F.lit(0).cast("long"))
    many = rows.groupBy("conv", "segment").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("conv", "segment")
    if many.isEmpty():
        return every, KEY[:2]
    many = cut(many)
    spread = rows.join(many, ["conv", "segment"], "left_semi").repartitionByRange(shuffles(rows.sparkSession), *KEY[:2], *ORDER)
    spread = cut(spread.withColumn("part", F.spark_partition_id()))
    nth = F.row_number().over(Window.partitionBy(*KEY[:2], "part").orderBy(*ORDER)) - 1
    crowded = cut(spread.withColumn("piece", F.col("part").cast("long") * (1 << 32) + F.floor(nth / size)).drop("part"))
    return every.join(many, ["conv", "segment"], "left_anti").unionByName(crowded), KEY


def repair_roles(turns: DataFrame, segment: int = SEGMENT, crowd: int = CROWD, size: int = PIECE) -> DataFrame:
    """Repair `turns(conv_id, turn, role, text)`. One row a turn: conv_id, turn, position (ascending in the order of its
    segment), segment, role, new_role, action, inserted, rendered (in order, a conversation's pieces are its rendering)
    and cost (of the whole conversation)."""
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00null")).alias("conv"),
        F.coalesce(F.floor(F.col("turn") / segment).cast("long"), F.lit(NULL_TURNS)).alias("segment"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("turn"),
        F.col("turn").isNull().alias("no_turn"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows, key = _pieces(rows, crowd, size)
    # Turns that tie but for their text have one role, so the matrices need no texts.
    sums = rows.select(*KEY, "turn", "role").repartition(*key).sortWithinPartitions(*KEY, "turn", "role").mapInPandas(summed_up, "conv string, segment long, piece long, matrix array<long>")
    chained = (
        sums.repartition(shuffles(turns.sparkSession), "conv")
        .sortWithinPartitions(*KEY)
        .mapInPandas(chain, "conv string, segment long, piece long, enter int, leave int, cost long, last boolean")
    )
    # The window needs the rows of a key together, so no split of a large partition by the join can part them.
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*ORDER)).cast("long") - 1
    dealt = rows.join(chained.drop(*[c for c in KEY if c not in key]), key).withColumn("position", F.col("piece") * size + nth)
    out = dealt.sortWithinPartitions(*key, *ORDER).mapInPandas(
        written, "conv string, segment long, position long, turn long, no_turn boolean, role string, new_role string, action string, inserted string, rendered string, cost long"
    )
    kind = turns.schema["conv_id"].dataType
    conv_id = F.when(F.col("conv") != "\x00null", F.col("conv")).cast(kind).alias("conv_id")
    turn = F.when(~F.col("no_turn"), F.col("turn")).alias("turn")
    return out.select(conv_id, turn, "segment", "position", "role", "new_role", "action", "inserted", "rendered", "cost")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_roles(table(spark, sf_dir, "conversations"))
