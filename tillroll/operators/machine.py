"""Ordered folds over keyed logs by a small machine, as a segmented scan.

A :class:`Machine` has a few states; each input takes a state to another one or to a hold: the rows of the next ``hold_s``
seconds are then passed over, and the first row behind them finds the machine in ``after_hold``.  Rate limits, claims,
attempt counters and circuit breakers are such machines.

A key's rows need their order, but not one task.  Rows are sorted by key and time over all partitions and cut into pieces of
bounded length, so a hot key lies in many pieces.  A piece is a map from the state it is entered in to the
state it is left in.  It is found for all rows and states at once by pointer doubling: a pointer from
(row, state) leads to the next row that isn't passed over, and doubled pointers lead to the piece's end.  Of a hold that
comes in from outside, only the first rows, up to ``hold_s`` behind the piece's first row, can be where it ends.

1. Each piece: the rows of keys that begin in it are finished at once.  Its first key may have begun before: its rows wait.
   The piece's map of that key, and the state in which its last key leaves it, are a row each.
2. Each key that lies in several pieces: its maps are composed in the order of pieces.  This is one row a piece.
3. Each waiting piece is run from the state it is entered in.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.sources.scratch import kept

HOLD = -1
#: Rows of a piece.
PIECE = 1 << 16
#: What a fold adds to each row: whether the machine saw it and in which state; the row that began the hold, for rows passed
#: over or beginning one; and the number of rows since then, itself included.
ADDED = "seen boolean, state int, holder bigint, holder_t bigint, since bigint"
#: A state between rows: ``state`` (HOLD inside a hold) and the hold's row, time and number of rows so far.
LINK = "state int, holder bigint, holder_t bigint, since bigint"


class Machine(NamedTuple):
    """``moves[state][input]`` is the next state or HOLD; the machine begins in state 0."""

    moves: tuple[tuple[int, ...], ...]
    hold_s: int = 0
    after_hold: int = 0


class Piece:
    """A piece's rows as arrays: ``run`` numbers its keys from 0, ``t`` is the time, ``kind`` the input."""

    def __init__(self, machine: Machine, run: np.ndarray, t: np.ndarray, kind: np.ndarray, event: np.ndarray):
        self.machine, self.run, self.t, self.event, self.n = machine, run, t, event, len(run)
        moves = np.array(machine.moves, np.int64)
        self.states = states = len(moves)
        self.ends = np.append(np.flatnonzero(np.diff(run)) + 1, self.n)
        self.begins = np.concatenate([[0], self.ends[:-1]])
        end = self.ends[run]
        # times of later runs lie behind all earlier ones, so that one search finds each row's end of hold in its run
        wide = int(t.max() - t.min()) + machine.hold_s + 1
        self.line = t - t.min() + run * wide
        behind = np.minimum(np.searchsorted(self.line, self.line + machine.hold_s, "left"), end)
        row = np.arange(self.n)
        behind = np.maximum(behind, row + 1)
        to = moves[:, kind].T  # (row, state)
        target = np.where(to == HOLD, (behind * states + machine.after_hold)[:, None], (row + 1)[:, None] * states + to)
        here = row[:, None] * states + np.arange(states)
        last = np.where(to == HOLD, behind[:, None], row[:, None] + 1) >= end[:, None]  # the pointer leaves the run
        self.to = to.ravel()
        self.jumps = [np.where(last, here, target).ravel()]
        while True:
            step = self.jumps[-1][self.jumps[-1]]
            if np.array_equal(step, self.jumps[-1]):
                break
            self.jumps.append(step)

    def visited(self, starts: np.ndarray) -> np.ndarray:
        """All (row, state) numbers on the ways from ``starts``."""
        found = starts
        for jump in reversed(self.jumps):
            found = np.unique(np.concatenate([found, jump[found]]))
        return found

    def left(self, starts: np.ndarray) -> list[tuple]:
        """The link with which the run of each start is left."""
        out = []
        for node in self.jumps[-1][starts]:
            row, to = int(node) // self.states, int(self.to[node])
            hold = to == HOLD
            out.append((to, int(self.event[row]), int(self.t[row]), int(self.ends[self.run[row]]) - row) if hold else (to, None, None, None))
        return out

    def leaving(self, link: tuple) -> tuple:
        """The link with which the first run is left when it is entered with ``link``."""
        if link[0] != HOLD:
            return self.left(np.array([link[0]]))[0]
        land = self.landing(link[2] + self.machine.hold_s)
        if land == self.ends[0]:
            return (*link[:3], link[3] + land)
        return self.left(np.array([land * self.states + self.machine.after_hold]))[0]

    def landing(self, until: int) -> int:
        """The first row of the first run at or behind a time."""
        return int(np.searchsorted(self.t[: self.ends[0]], until, "left"))

    def columns(self, first: tuple | None) -> dict[str, np.ndarray]:
        """ADDED for all rows, when the first run is entered with the link ``first`` and the others begin here."""
        n, states = self.n, self.states
        starts = self.begins * states
        carried, land = first is not None and first[0] == HOLD, 0
        if first is not None:
            land = self.landing(first[2] + self.machine.hold_s) if carried else 0
            state = self.machine.after_hold if carried else first[0]
            starts = np.concatenate([[land * states + state] if land < self.ends[0] else [], starts[1:]]).astype(np.int64)
        nodes = self.visited(starts)
        rows = nodes // states
        seen, state = np.zeros(n, bool), np.full(n, -1, np.int64)
        seen[rows], state[rows] = True, nodes % states
        holds = np.zeros(n, bool)
        holds[rows[self.to[nodes] == HOLD]] = True
        at = np.maximum.accumulate(np.where(holds, np.arange(n), -1))
        at = np.where(at >= self.begins[self.run], at, -1)
        inside = holds | ~seen
        holder, holder_t, since = self.event[at], self.t[at], np.arange(n) - at + 1
        if carried:
            holder, holder_t = holder.copy(), holder_t.copy()
            holder[:land], holder_t[:land], since[:land] = first[1], first[2], first[3] + np.arange(1, land + 1)
        return {"seen": seen, "state": state, "inside": inside, "holder": holder, "holder_t": holder_t, "since": since}


def added_columns(x: dict[str, np.ndarray], slice_: slice) -> list[pa.Array]:
    seen, inside = x["seen"][slice_], x["inside"][slice_]
    masked = lambda name, kind, keep: pa.array(x[name][slice_], kind, mask=~keep)
    return [pa.array(seen), masked("state", pa.int32(), seen), *(masked(c, pa.int64(), inside) for c in ("holder", "holder_t", "since"))]


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The number of each row's run of equal keys (nulls alike)."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def _regrouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def last_links(rows: DataFrame, keys: list[str], machine: Machine) -> DataFrame:
    """The state of each key behind its last row of a fold's result: keys, state, holder, holder_t, since."""
    moves = F.lit([list(m) for m in machine.moves])
    after = F.when(F.col("x.holder").isNotNull(), F.lit(HOLD)).otherwise(F.element_at(F.element_at(moves, F.col("x.state") + 1), F.col("x.kind") + 1))
    last = rows.filter("seen IS NOT NULL").groupBy(*keys).agg(F.max_by(F.struct("state", "kind", "holder", "holder_t", "since"), F.struct("t", "event_id")).alias("x"))
    return last.select(*keys, after.alias("state"), *(F.col(f"x.{c}").alias(c) for c in ("holder", "holder_t", "since")))


_NAMES = [c.split()[0] for c in ADDED.split(", ")]


def fold(df: DataFrame, keys: list[str], machine: Machine, *, piece: int = PIECE) -> DataFrame:
    """``df`` with the columns ADDED.

    ``df`` has ``keys``, event_id, t (seconds) and kind (the machine's input), and maybe others.  Rows of a key go by t, then by event_id; a null key is a
    key like others.  Rows without t or event_id have no place in the order: their new columns are null.
    """
    placed, unplaced = df.filter("t IS NOT NULL AND event_id IS NOT NULL"), df.filter("t IS NULL OR event_id IS NULL")
    names = df.columns
    held = [placed.schema[c] for c in names]
    empty = [T.StructField(f.name, f.dataType, True) for f in held]
    extra = T.StructType.fromDDL("what string, piece bigint, " + ADDED + f", last boolean, length bigint, maps array<struct<{', '.join(c.replace(' ', ':', 1) for c in LINK.split(', '))}>>, until array<bigint>").fields
    schema = T.StructType([*empty, *extra])

    def row_of(batch: pa.RecordBatch, i: int, target: pa.Schema, **values) -> pa.RecordBatch:
        """A row with the keys of row ``i`` and ``values``."""
        return pa.RecordBatch.from_arrays([batch.column(f.name).slice(i, 1) if f.name in keys else pa.array([values.get(f.name)], f.type) for f in target], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, number = to_arrow_schema(schema), TaskContext.get().partitionId() << 32
        for batch in _regrouped(batches, piece):
            whole = Piece(machine, _changes(batch, keys), *(batch.column(c).to_numpy() for c in ("t", "kind", "event_id")))
            first, n = int(whole.ends[0]), batch.num_rows
            base = batch.columns
            if first < n:
                rest = slice(first, n)
                done = [*(c.slice(first) for c in base), pa.array(["done"] * (n - first)), pa.array([number] * (n - first)), *added_columns(whole.columns(None), rest)]
                yield pa.RecordBatch.from_arrays([*done, *(pa.nulls(n - first, f.type) for f in list(target)[len(done) :])], schema=target)
            waits = [*(c.slice(0, first) for c in base), pa.array(["waits"] * first), pa.array([number] * first)]
            yield pa.RecordBatch.from_arrays([*waits, *(pa.nulls(first, f.type) for f in list(target)[len(waits) :])], schema=target)
            # the map of the first run: from each state, then from holds that end at one of the first rows
            states = whole.states
            ends = np.unique(whole.t[: whole.landing(int(whole.t[0]) + machine.hold_s) + 1][: first])
            nodes = np.concatenate([np.arange(states), np.array([whole.landing(int(t)) for t in ends], np.int64) * states + machine.after_hold])
            links = whole.left(nodes)
            keep = [*range(states), *(i for i in range(states, len(links)) if i + 1 == len(links) or links[i] != links[i + 1])]
            named = [dict(zip(["state", "holder", "holder_t", "since"], links[i], strict=True)) for i in keep]
            yield row_of(batch, 0, target, what="map", piece=number, last=False, length=first, maps=named, until=[int(ends[i - states]) for i in keep[states:]])
            if first < n:
                (link,) = whole.left(whole.begins[-1:] * states)
                yield row_of(batch, n - 1, target, what="map", piece=number, last=True, length=0, maps=[dict(zip(["state", "holder", "holder_t", "since"], link, strict=True))], until=[])
            number += 1

    ordered = placed.repartitionByRange(*keys, "t", "event_id").sortWithinPartitions(*keys, "t", "event_id")
    made = kept(ordered.mapInArrow(run, schema), "pieces")

    states = len(machine.moves)
    key_fields = [f for f in empty if f.name in keys]

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        """The link with which each piece that a key goes on in is entered."""
        out, link = [], (0, None, None, None)
        for x in group.sort_values(["piece", "last"]).to_dict("records"):
            links = [tuple(None if v is None or v != v else int(v) for v in (m["state"], m["holder"], m["holder_t"], m["since"])) for m in x["maps"]]
            if x["last"]:
                link = links[0]
                continue
            out.append((*(x[k] for k in keys), x["piece"], *link))
            if link[0] != HOLD:
                link = links[link[0]]
            else:
                i = int(np.searchsorted(x["until"], link[2] + machine.hold_s, "left"))
                link = links[states + i] if i < len(x["until"]) else (*link[:3], link[3] + x["length"])
        return pd.DataFrame(out, columns=[*keys, "piece", "in_state", "in_holder", "in_t", "in_since"])

    entered = made.filter("what = 'map'").groupBy(*keys).applyInPandas(compose, T.StructType([*key_fields, *T.StructType.fromDDL("piece bigint, in_state int, in_holder bigint, in_t bigint, in_since bigint").fields]))
    waiting = made.filter("what = 'waits'").select(*names, "piece").join(entered.drop(*keys), "piece")

    def finish(table: pa.Table) -> pa.Table:
        table = table.sort_by([("t", "ascending"), ("event_id", "ascending")])
        link = tuple(table.column(c)[0].as_py() for c in ("in_state", "in_holder", "in_t", "in_since"))
        whole = Piece(machine, np.zeros(table.num_rows, np.int64), *(table.column(c).to_numpy() for c in ("t", "kind", "event_id")))
        added = added_columns(whole.columns(link), slice(None))
        return pa.Table.from_arrays([*(table.column(c) for c in names), *added], [*names, *_NAMES])

    finished = waiting.groupBy("piece").applyInArrow(finish, T.StructType([*empty, *T.StructType.fromDDL(ADDED).fields]))
    done = made.filter("what = 'done'").select(*names, *_NAMES)
    alone = unplaced.select(*names, *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ADDED.split(", ")))
    return done.unionByName(finished).unionByName(alone)
