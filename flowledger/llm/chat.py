"""Minimum-cost role repair of conversations, and their rendering.

A legal conversation is an optional system turn, then user and assistant turns in alternation, the last by the assistant.
Dynamic programming over that automaton (START, SYSTEM, USER, ASSISTANT) finds the cheapest repair: a turn is kept, merged
into the turn before it, or relabelled (also relabelled and merged), and empty turns are inserted before it or at the end. Costs
are KEEP 0, MERGE 1, RELABEL 4 (added to the merge where both are due) and INSERT 3 for each empty turn. Among repairs of equal
cost the first in the order of `_moves` is taken at each turn, from the last one back.

The turns are sorted over all tasks by ranges, so a conversation of any size is spread over them. A conversation that lies inside
a task is repaired there, many at a time with numpy. Of one that crosses a task's edge, or has more than `segment` turns, each
piece of at most `segment` turns is kept as one row: the piece's costs are a matrix over (state before, state after), these
combine in the (min, +) sense, and a sweep forward over a conversation's pieces and one backward give each piece its outer states.
The sweeps see short codes only and hold nothing but the last state; the result does not depend on where pieces are cut.

Each turn gives one row: its action, the role it has now, and the text it contributes to the rendered conversation; a merged
turn continues the one before. A conversation's text is the concatenation of `rendered` by (turn, place). A text can't forge a
marker: in `<|`, also with backslashes between, one more backslash is put in between (taking one out gives the text back).

Nulls: a null or unknown role fits no state and has to be relabelled; a null text is empty; turns with a null conversation
form one conversation, and null turn numbers come first. Turns with equal numbers go by role (unknown ones first, by a hash of the
role) and a hash of the text; repeated rows are turns of their own. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, table

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
#: The code of a turn whose role is null or unknown.
UNKNOWN = 0
#: States that may follow directly, and the state in which a conversation may end.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
END = ASSISTANT
KEEP, MERGE, RELABEL, INSERT = 0, 1, 4, 3
SEGMENT = 128
FAR = 1 << 60


@lru_cache(maxsize=None)
def _path(a: int, b: int) -> tuple[int, ...] | None:
    """The fewest empty turns to insert after state a so that state b may follow."""
    ways = [(a,)]
    seen = {a}
    while ways:
        way = ways.pop(0)
        if b in NEXT[way[-1]]:
            return way[1:]
        for c in NEXT[way[-1]]:
            if c not in seen:
                seen.add(c)
                ways.append((*way, c))
    return None


@lru_cache(maxsize=None)
def _moves(role: int) -> tuple[tuple[int, int, int, str, tuple[int, ...]], ...]:
    """(state before, state after, cost, action, inserted states) for a turn of that role (no state's number: unknown)."""
    out = []
    for before in range(4):
        for after in (SYSTEM, USER, ASSISTANT):
            change = KEEP if after == role else RELABEL
            if before == after:
                out.append((before, after, MERGE + change, "merge" if not change else "relabel+merge", ()))
            way = _path(before, after)
            if way is not None:
                action = "keep" if not change else "relabel"
                out.append((before, after, change + INSERT * len(way), action, way))
    return tuple(sorted(out, key=lambda m: (m[2], m[3], m[0], m[1], m[4])))


def closing(state: int) -> tuple[int, ...]:
    """Empty turns that lead from a state to the end of a conversation."""
    return () if state == END else (*(_path(state, END) or ()), END)


def _opened(state: int) -> str:
    return f"<|{NAMES[state]}|>\n"


#: All moves, by the turn's code and in the order of `_moves`; a move is known by its place here.
MOVES = [m for code in range(4) for m in _moves(code)]
#: Least cost of a turn: by its code, the state before and the state after.
COST = np.full((4, 4, 4), FAR, np.int64)
#: By code and state after: places, states before and costs of the moves, in order; filled up with ones that are never best.
_WIDE = max(sum(m[1] == after for m in _moves(code)) for code in range(4) for after in range(4))
OPTION = np.zeros((4, 4, _WIDE, 3), np.int64)
OPTION[..., 2] = 2 * FAR
for _code in range(4):
    for _after in (SYSTEM, USER, ASSISTANT):
        _fit = [(len(_moves(0)) * _code + i, m[0], m[2]) for i, m in enumerate(_moves(_code)) if m[1] == _after]
        OPTION[_code, _after, : len(_fit)] = _fit
        for _, _a, _k in _fit:
            COST[_code, _a, _after] = min(COST[_code, _a, _after], _k)
CLOSE = np.array([INSERT * len(closing(s)) for s in range(4)])
ACTION = pa.array([m[3] for m in MOVES])
ROLE = pa.array([NAMES[m[1]] for m in MOVES])
#: What a move puts before the turn's text, and what the end of a conversation puts after it in each state (4: not the end).
PREFIX = pa.array([("\n" if a != START else "") + "".join(_opened(s) + "\n" for s in way) + ("" if act.endswith("merge") else _opened(b)) for a, b, _, act, way in MOVES])
SUFFIX = pa.array(["".join("\n" + _opened(s) for s in closing(s4)) + "\n<|end|>\n" for s4 in range(4)] + [""])
#: Roles inserted, by move and the state of the end: place 5 * move + state.
INSERTED = pa.array([",".join(NAMES[s] for s in (*m[4], *(closing(e) if e < 4 else ()))) for m in MOVES for e in range(5)])
FROM_START = np.array([0, FAR, FAR, FAR])


def forward(codes: np.ndarray, starts: np.ndarray, lens: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least costs of the states before each turn, and after each run of turns, from the costs (run, way, state) before the runs."""
    now = costs.copy()
    before = np.empty((len(codes), *costs.shape[1:]), np.int64)
    for t in range(int(lens.max(initial=0))):
        live = np.flatnonzero(lens > t)
        rows = starts[live] + t
        before[rows] = now[live]
        now[live] = np.minimum((now[live][..., :, None] + COST[codes[rows]][:, None]).min(axis=2), FAR)
    return before, now


def trace(codes: np.ndarray, starts: np.ndarray, lens: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The moves of the turns on the cheapest way to the state after each run, and the state before each run."""
    state = after.copy()
    moves = np.zeros(len(codes), np.int64)
    for t in range(int(lens.max(initial=0)) - 1, -1, -1):
        live = np.flatnonzero(lens > t)
        rows = starts[live] + t
        option = OPTION[codes[rows], state[live]]
        best = (before[rows[:, None], option[..., 1]] + option[..., 2]).argmin(axis=1)
        moves[rows], state[live] = option[np.arange(len(rows)), best, :2].T
    return moves, state


def rendered(codes: np.ndarray, texts: pa.Array, starts: np.ndarray, lens: np.ndarray, before: np.ndarray, after: np.ndarray, last: np.ndarray) -> dict[str, pa.Array]:
    """action, role, inserted and rendered of each turn; last: whether a run ends its conversation."""
    moves, _ = trace(codes, starts, lens, before, after)
    end = np.full(len(codes), 4)
    end[(starts + lens - 1)[last]] = after[last]
    safe = pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")
    return {
        "action": ACTION.take(pa.array(moves)),
        "role": ROLE.take(pa.array(moves)),
        "inserted": INSERTED.take(pa.array(5 * moves + end)),
        "rendered": pc.binary_join_element_wise(PREFIX.take(pa.array(moves)), safe, SUFFIX.take(pa.array(end)), ""),
    }


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are equal."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    value = column.fill_null(0).to_numpy(zero_copy_only=False)
    return (value[1:] != value[:-1]) | (null[1:] != null[:-1])


def _runs(batches, segment: int):
    """(turns, starts of runs, which are open, number of the first turn in the task): an open run is a piece of a conversation."""
    held, left, at = None, True, 0
    for batch in chain(batches, [None]):
        here = [x for x in (held, batch) if x is not None and x.num_rows]
        if not here:
            continue
        rows = pa.Table.from_batches(here).combine_chunks().to_batches()[0]
        firsts = np.flatnonzero(np.r_[True, _changes(rows["conv_id"])])
        n, tail = rows.num_rows, int(firsts[-1])
        upto = n if batch is None else tail + (n - tail - 1) // segment * segment
        starts, opened = [], []
        for first, stop in zip(firsts.tolist(), [*firsts[1:].tolist(), upto], strict=True):
            cut = range(first, stop, segment)
            starts += cut
            opened += [first == tail or (first == 0 and left) or stop - first > segment] * len(cut)
        if upto:
            yield rows.slice(0, upto), np.array(starts), np.array(opened), at
        left = tail < upto or (tail == 0 and left)
        held, at = rows.slice(upto), at + upto


RESULT = "conv_id long, turn long, place long, action string, old_role string, role string, inserted string, rendered string"
#: An open run: its place in the order, codes, costs, equal turn numbers at its ends, and its turns.
PIECE = "part int, at long, codes binary, costs array<long>, leading long, trailing long, last_turn long, turns array<struct<turn:long,place:long,old_role:string,text:string>>"
RESULT_TYPES = {"conv_id": pa.int64(), "turn": pa.int64(), "place": pa.int64(), "action": pa.string(), "old_role": pa.string(), "role": pa.string(), "inserted": pa.string(), "rendered": pa.string()}
TURN = pa.struct([("turn", pa.int64()), ("place", pa.int64()), ("old_role", pa.string()), ("text", pa.string())])
PIECE_TYPES = {"part": pa.int32(), "at": pa.int64(), "codes": pa.binary(), "costs": pa.list_(pa.int64()), "leading": pa.int64(), "trailing": pa.int64(), "last_turn": pa.int64(), "turns": pa.list_(TURN)}


def _filled(columns: dict, n: int) -> pa.RecordBatch:
    types = {**RESULT_TYPES, **PIECE_TYPES, "open": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns and not isinstance(columns[c], pa.Array) else columns.get(c, pa.nulls(n, t)) for c, t in types.items()], names=list(types))


def _placed(batches, segment: int):
    """Repaired turns of whole conversations, and open runs as one row each."""
    part = TaskContext.get().partitionId()
    for rows, starts, opened, first in _runs(batches, segment):
        n = rows.num_rows
        lens = np.diff(np.r_[starts, n])
        codes = rows["code"].to_numpy(zero_copy_only=False)
        place = np.arange(n)
        fresh = np.r_[True, _changes(rows["turn"])]
        fresh[starts] = True
        place = place - np.maximum.accumulate(np.where(fresh, place, 0))
        whole, mine = starts[~opened], lens[~opened]
        if len(whole):
            before, ends = forward(codes, whole, mine, np.broadcast_to(FROM_START, (len(whole), 1, 4)))
            after = (ends[:, 0] + CLOSE).argmin(axis=1)
            keep = np.repeat(~opened, lens)
            done = rendered(codes, rows["text"], whole, mine, before[:, 0], after, np.ones(len(whole), bool))
            kept = pa.array(keep)
            yield _filled({**{k: v.filter(kept) for k, v in done.items()}, "conv_id": rows["conv_id"].filter(kept), "turn": rows["turn"].filter(kept), "place": place[keep], "old_role": rows["role"].filter(kept), "open": np.zeros(keep.sum(), bool)}, int(keep.sum()))
        pieces, sizes = starts[opened], lens[opened]
        if len(pieces):
            _, costs = forward(codes, pieces, sizes, np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(pieces), 4, 4)))
            turns = pa.StructArray.from_arrays([rows["turn"], pa.array(place), rows["role"], rows["text"]], fields=list(TURN))
            cut = list(zip(pieces.tolist(), (pieces + sizes).tolist(), strict=True))
            lists = pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), turns.slice(a, b - a)) for a, b in cut])
            again = [np.flatnonzero(fresh[a + 1 : b]) for a, b in cut]
            yield _filled(
                {
                    "conv_id": rows["conv_id"].take(pa.array(pieces)), "turn": rows["turn"].take(pa.array(pieces)), "part": [part] * len(cut), "at": pieces + first,
                    "codes": [codes[a:b].astype(np.uint8).tobytes() for a, b in cut], "costs": costs.reshape(-1, 16).tolist(),
                    "leading": [int(f[0]) + 1 if len(f) else b - a for f, (a, b) in zip(again, cut, strict=True)],
                    "trailing": [int(place[b - 1]) + 1 for _, b in cut], "last_turn": rows["turn"].take(pa.array(pieces + sizes - 1)), "turns": lists, "open": np.ones(len(cut), bool),
                },
                len(cut),
            )


def _same(a, b) -> bool:
    return (a is None and b is None) or a == b


def _ahead(batches):
    """Forward over the pieces of each conversation: the costs before and after each, and how many turns before it have its first turn's number."""
    conv, number, count, now, any_yet = None, None, 0, FROM_START, False
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if not any_yet or not _same(conv, r["conv_id"]):
                conv, now, count, any_yet = r["conv_id"], FROM_START, 0, True
            carry = count if count and _same(number, r["turn"]) else 0
            after = np.minimum((now[:, None] + np.array(r["costs"]).reshape(4, 4)).min(axis=0), FAR)
            after = np.minimum(after - after.min(), FAR)
            out.append((conv, r["part"], r["at"], r["codes"], now.tolist(), after.tolist(), carry))
            single = r["leading"] == len(r["codes"])
            number, count, now = r["last_turn"], r["trailing"] + (carry if single else 0), after
        names = ("conv_id", "part", "at", "codes", "before", "ends", "carry")
        types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=list(names))


def _back(batches):
    """For each piece the state before it, by the state after it."""
    for batch in batches:
        lens = np.array([len(c) for c in batch["codes"].to_pylist()], np.int64)
        codes = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8)
        starts = np.cumsum(lens) - lens
        before, _ = forward(codes, starts, lens, np.array(batch["before"].to_pylist(), np.int64).reshape(-1, 1, 4))
        ways = [trace(codes, starts, lens, before[:, 0], np.full(len(lens), max(s, SYSTEM)))[1] for s in range(4)]
        out = pa.array(np.stack(ways, axis=1).tolist(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("conv_id", "part", "at", "before", "ends", "carry")), out], names=["conv_id", "part", "at", "before", "ends", "carry", "back"])


def _behind(batches):
    """Backward over the pieces of each conversation: the state after each, and whether it is the last."""
    conv, state, any_yet = None, END, False
    for batch in batches:
        after, last = [], []
        for c, ends, back in zip(*(batch[x].to_pylist() for x in ("conv_id", "ends", "back")), strict=True):
            last.append(not any_yet or not _same(conv, c))
            if last[-1]:
                conv, state, any_yet = c, int((np.array(ends) + CLOSE).argmin()), True
            after.append(state)
            state = back[state]
        yield pa.RecordBatch.from_arrays([batch["part"], batch["at"], batch["before"], batch["carry"], pa.array(after, pa.int32()), pa.array(last)], names=["__part", "__at", "before", "carry", "after", "last"])


def _closed(batches):
    """The turns of open runs between their known outer states."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch["turns"]
        lens = np.diff(lists.offsets.to_numpy())
        starts = np.cumsum(lens) - lens
        turn, place, role, text = lists.flatten().flatten()
        codes = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8)
        before, _ = forward(codes, starts, lens, np.array(batch["before"].to_pylist(), np.int64).reshape(-1, 1, 4))
        done = rendered(codes, text, starts, lens, before[:, 0], batch["after"].to_numpy().astype(np.int64), batch["last"].to_numpy(zero_copy_only=False))
        of = np.repeat(np.arange(len(lens)), lens)
        # turns of the run's first number follow those of the pieces before
        changed = np.r_[False, _changes(turn)]
        changed[starts] = False
        changed = changed.cumsum()
        lead = changed == changed[starts][of]
        place = place.to_numpy(zero_copy_only=False) + np.where(lead, batch["carry"].to_numpy()[of], 0)
        done |= {"conv_id": batch["conv_id"].take(pa.array(of)), "turn": turn, "place": pa.array(place, pa.int64()), "old_role": role}
        yield pa.RecordBatch.from_arrays([done[c] for c in RESULT_TYPES], names=list(RESULT_TYPES))


def repaired(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, turn, place, action, old_role, role, inserted, rendered) for each turn of turns (conv_id, turn, role, text).

    place orders turns with the same number; inserted lists the roles of empty turns put in before the turn, or after the last.
    The call sorts the turns and writes them to the shared folder before it returns."""
    small_batches(turns.sparkSession)
    code = F.coalesce(*(F.when(F.col("role") == n, c) for n, c in ROLES.items()), F.lit(UNKNOWN))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), code.alias("code"))
    # the row's number lets equal rows lie in several tasks; they are interchangeable, so it need not be the same in a second try
    rows = rows.select("*", F.xxhash64("role").alias("r"), F.xxhash64("text").alias("t"), F.monotonically_increasing_id().alias("i"))
    order = ["conv_id", "turn", "code", "r", "t", "i"]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "code")
    laid = materialise(laid.mapInArrow(lambda b: _placed(b, segment), f"{RESULT}, {PIECE}, open boolean"), by="open")
    pieces = laid.where("open")
    slim = pieces.select("conv_id", "turn", "part", "at", "codes", "costs", "leading", "trailing", "last_turn")
    known = slim.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
    known = known.mapInArrow(_ahead, "conv_id long, part int, at long, codes binary, before array<long>, ends array<long>, carry long").repartition("part", "at")
    known = known.mapInArrow(_back, "conv_id long, part int, at long, before array<long>, ends array<long>, carry long, back array<int>").repartition("conv_id")
    known = known.sortWithinPartitions("conv_id", F.desc("part"), F.desc("at")).mapInArrow(_behind, "__part int, __at long, before array<long>, carry long, after int, last boolean")
    placed = pieces.join(known, (F.col("part") == F.col("__part")) & (F.col("at") == F.col("__at"))).select("conv_id", "codes", "turns", "before", "carry", "after", "last")
    names = list(RESULT_TYPES)
    return laid.where("NOT open").select(*names).unionByName(placed.mapInArrow(_closed, RESULT))


def op2(spark, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


QUERIES = {"op2_role_repair": op2}
ORACLE: dict[str, str] = {}
