"""Operator 6: chat formatting with minimum-cost role repair.

Legal sequences are ``[system] (user assistant)+``.  Turn by turn, a turn is kept, relabelled, merged
into the turn before it (of its own or, with a relabel, of another role), and empty user or assistant
turns may be inserted.  ``COST`` has the costs.  Dynamic programming over the automaton (state: role of the
last turn) finds the cheapest repair; the repaired turns are then rendered between role markers.

Turns are range-partitioned by conversation and place, so a conversation of any length is cut over
tasks.  A piece of a conversation is a matrix of least costs from state to state; matrices of the two
outer pieces of each task (two rows a task) meet on the driver, which chooses the states at the cuts;
then each task decodes its own turns.

The result has a row for each turn, whose ``segment`` is its share of the rendered text: the
segments of a conversation, joined in the order of ``place``, are the whole rendering.

Edge cases: null conv_ids are one conversation; null or unknown roles are relabelled at a lower cost; null
texts are empty; turns with equal numbers are ordered by role and text, repeated rows stay repeated.  Markers
inside a text are broken up by a space.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import written

ROLES = ("system", "user", "assistant")
#: States: 0 nothing yet, else 1 + number of the last turn's role.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
COST = {"relabel": 3, "relabel_unknown": 1, "merge": 1, "insert": 2}
FAR = 1 << 30


class Step(NamedTuple):
    cost: int
    action: str
    inserted: tuple[int, ...]


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest inserted turns after which a state may follow a state (no system turn is inserted)."""
    out = {}
    for begin in range(4):
        rest, seen = [(begin, ())], set()
        while rest:
            state, inserted = rest.pop(0)
            for following in NEXT[state]:
                out.setdefault((begin, following), inserted)
                if following not in seen and following != SYSTEM:
                    seen.add(following)
                    rest.append((following, (*inserted, following)))
    return out


PATHS = _paths()


def _steps(role: int) -> dict[tuple[int, int], Step]:
    """The cheapest step of a turn of ``role`` (0: unknown) from state to state."""
    relabel = COST["relabel"] if role else COST["relabel_unknown"]
    out: dict[tuple[int, int], Step] = {}
    for (begin, end), inserted in PATHS.items():
        change = relabel if end != role else 0
        step = Step(COST["insert"] * len(inserted) + change, "relabel" if change else "keep", inserted)
        out[begin, end] = min(out.get((begin, end), step), step, key=lambda s: s.cost)
    for state in (SYSTEM, USER, ASSISTANT):
        change = relabel if state != role else 0
        step = Step(COST["merge"] + change, "merge" if not change else "relabel+merge", ())
        if (state, state) not in out or step.cost < out[state, state].cost:
            out[state, state] = step
    return out


STEPS = [_steps(role) for role in range(4)]
#: What closes a conversation in a state: inserted turns so that an assistant's is the last.
CLOSING = {state: () if state == ASSISTANT else (*PATHS[state, ASSISTANT], ASSISTANT) for state in range(4)}


def code(role: str | None) -> int:
    return ROLES.index(role) + 1 if role in ROLES else 0


def costs(roles: list[int], begin: int) -> list[int]:
    """Least costs from a state over turns to each state."""
    now = [FAR] * 4
    now[begin] = 0
    for role in roles:
        new = [FAR] * 4
        for (a, b), step in STEPS[role].items():
            if now[a] + step.cost < new[b]:
                new[b] = now[a] + step.cost
        now = new
    return now


def decode(roles: list[int], begin: int, end: int) -> list[tuple[int, Step]]:
    """The cheapest (state, step) of each turn between two states."""
    layers, now = [], [FAR] * 4
    now[begin] = 0
    for role in roles:
        new, back = [FAR] * 4, [0] * 4
        for (a, b), step in STEPS[role].items():
            if now[a] + step.cost < new[b]:
                new[b], back[b] = now[a] + step.cost, a
        layers.append(back)
        now = new
    out, state = [], end
    for role, back in zip(reversed(roles), reversed(layers), strict=True):
        out.append((state, STEPS[role][back[state], state]))
        state = back[state]
    return out[::-1]


def final(now: list[int]) -> int:
    """The state in which it is cheapest to close."""
    return min(range(1, 4), key=lambda s: (now[s] + COST["insert"] * len(CLOSING[s]), -s))


def opened(role: int, text: str = "") -> str:
    return f"<|im_start|>{ROLES[role - 1]}\n{text}"


END = "<|im_end|>\n"


def _clean(text: str | None) -> str:
    return (text or "").replace("<|im_", "<| im_")


def rendered(steps: list[tuple[int, Step]], texts: list[str | None], first: bool, last: bool) -> list[str]:
    """The segment of each turn; ``first`` and ``last``: the conversation begins and ends with this piece."""
    out = []
    for i, ((state, step), text) in enumerate(zip(steps, texts, strict=True)):
        if step.action.endswith("merge"):
            segment = "\n" + _clean(text)
        else:
            segment = "" if first and i == 0 else END
            segment += "".join(opened(s) + END for s in step.inserted) + opened(state, _clean(text))
        out.append(segment)
    if last and out:
        out[-1] += END + "".join(opened(s) + END for s in CLOSING[steps[-1][0]])
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows of one chunk and conversation."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for key, piece in groupby(rows, key=lambda r: (r["chunk"], r["conv_id"])):
        yield key, list(piece)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, new_role, action, n_inserted, cost, segment) of each turn."""
    spark = turns.sparkSession
    kind = turns.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role_text", "row"]
    keyed = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", F.xxhash64("role", "text").alias("role_text"), F.monotonically_increasing_id().alias("row"))
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("role_text", "row")
    placed = ranged.withColumns({"chunk": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    table, _ = written(placed, "turns")
    sorted_by = table.repartition("chunk").sortWithinPartitions("chunk", "place")

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last piece of each chunk, with their matrices."""
        out, held = [], None
        for (chunk, conv), piece in _pieces(batches):
            roles = [code(r["role"]) for r in piece]
            if held is None or held[0] != chunk:
                if held is not None and held[3]:
                    out.append(held)
                matrix = [c for begin in range(4) for c in costs(roles, begin)]
                out.append((chunk, conv, matrix, False))
                held = (chunk, conv, matrix, False)
            else:
                held = (chunk, conv, roles, True)
        if held is not None and held[3]:
            out.append(held)
        rows = [(chunk, conv, m if not last else [c for begin in range(4) for c in costs(m, begin)], last) for chunk, conv, m, last in out]
        if rows:
            kinds = [pa.int32(), batch_kind, pa.list_(pa.int64()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["chunk", "conv_id", "matrix", "last"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_kind = to_arrow_type(turns.schema["conv_id"].dataType)
    cut = sorted_by.mapInArrow(outer, f"chunk int, conv_id {kind}, matrix array<bigint>, last boolean").collect()
    states = _states(sorted(((r.chunk, r["last"], r.conv_id, r.matrix) for r in cut), key=lambda r: r[:2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chunk, conv), piece in _pieces(batches):
            roles = [code(r["role"]) for r in piece]
            begin, end, goes_on = states.get((chunk, conv), (START, None, False))
            end = final(costs(roles, begin)) if end is None else end
            steps = decode(roles, begin, end)
            segments = rendered(steps, [r["text"] for r in piece], begin == START, not goes_on)
            for i in range(0, len(piece), 2000):
                some = slice(i, i + 2000)
                rows, own = piece[some], steps[some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([conv] * len(rows), batch_kind), pa.array([r["place"] for r in rows], pa.int64()), pa.array([r["turn"] for r in rows], pa.int64()),
                        pa.array([r["role"] for r in rows], pa.string()), pa.array([ROLES[s - 1] for s, _ in own], pa.string()), pa.array([x.action for _, x in own], pa.string()),
                        pa.array([len(x.inserted) for _, x in own], pa.int64()), pa.array([x.cost for _, x in own], pa.int64()), pa.array(segments[some], pa.string()),
                    ],
                    ["conv_id", "place", "turn", "role", "new_role", "action", "n_inserted", "cost", "segment"],
                )

    return sorted_by.mapInArrow(run, f"conv_id {kind}, place bigint, turn bigint, role string, new_role string, action string, n_inserted bigint, cost bigint, segment string")


def _states(cut: list[tuple]) -> dict[tuple, tuple[int, int | None, bool]]:
    """(begin state, end state or None, goes on) of the pieces of conversations that are cut.

    ``cut``: (chunk, is last piece, conv_id, matrix), in order; pieces that follow one another in it with
    one conv_id, over neighbouring chunks, are one conversation.
    """
    chains: list[list[tuple]] = []
    for row in cut:
        if chains and chains[-1][-1][2] == row[2] and chains[-1][-1][0] != row[0]:
            chains[-1].append(row)
        else:
            chains.append([row])
    out = {}
    for chain in (c for c in chains if len(c) > 1):
        layers, now = [], [0, FAR, FAR, FAR]
        for _, _, _, m in chain:
            new, back = [FAR] * 4, [0] * 4
            for a in range(4):
                for b in range(4):
                    if now[a] + m[4 * a + b] < new[b]:
                        new[b], back[b] = now[a] + m[4 * a + b], a
            layers.append(back)
            now = new
        ends = [final(now)]
        for back in reversed(layers):
            ends.append(back[ends[-1]])
        ends.reverse()
        for i, (chunk, _, conv, _) in enumerate(chain):
            out[chunk, conv] = ends[i], ends[i + 1], i + 1 < len(chain)
    return out


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op6_chat_format": op6_chat_format}
ORACLES: dict[str, str] = {}
