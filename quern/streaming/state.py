"""Dialogue state as a keyed stream."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session_id long, turn int, accepted boolean, version int, category string, hard string, soft string"
STATE = "turn int, version int, category string, cons string, declined string, no_more boolean"


def apply_turn(state: tuple, turn: int, act: str, attribute: str, value: str | None, hard: bool) -> tuple:
    """State after a turn, as the batch fold has it (D6): an override starts a version, demotes what was hard and clears its
    attribute; a removal takes the equal key alone; a key that is added again stands if it was at least as hard."""
    _, version, category, cons, declined, no_more = state
    cons, declined = [tuple(c) for c in json.loads(cons)], json.loads(declined)
    over = act == "override" and (bool(cons) or category is not None)
    if act == "search":
        category = value
    if over:
        version, declined, no_more, cons = version + 1, [], False, [(a, v, False) for a, v, _ in cons]
    if act == "override":
        cons, hard = [c for c in cons if c[0] != attribute], True
    if act == "remove":
        cons = [c for c in cons if c[:2] != (attribute, value)]
    if act in ("add", "override") and not any(c[:2] == (attribute, value) and (c[2] or not hard) for c in cons):
        cons = [c for c in cons if c[:2] != (attribute, value)] + [(attribute, value, bool(hard))]
    if act == "decline" and attribute not in declined:
        declined = [*declined, attribute]
    return turn, version, category, json.dumps(cons), json.dumps(declined), bool(no_more or act == "no_more")


def _listed(cons: str, hard: bool) -> str:
    return ",".join(sorted(f"{a}={v}" for a, v, h in json.loads(cons) if h == hard))


def _session(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState, keep_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    now = state.get if state.exists else (0, 1, None, "[]", "[]", False)
    rows = pd.concat(list(batches), ignore_index=True).sort_values("turn", kind="stable")
    out = []
    for turn, act, attribute, value, hard in zip(*(rows[c] for c in ("turn", "act", "attribute", "value", "hard")), strict=True):
        fresh = int(turn) > now[0]
        if fresh:
            now = apply_turn(now, int(turn), act, attribute, None if pd.isna(value) else value, bool(hard))
        out.append((key[0], int(turn), fresh, now[1], now[2], _listed(now[3], True), _listed(now[3], False)))
    state.update(now)
    state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + keep_ms)
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def session_states(turns: DataFrame, late: str = "1 day", keep_ms: int = 3_600_000) -> DataFrame:
    """State of each session after each turn (X1). turns: session_id, turn, act, attribute, value, hard, ts.

    A key has one writer, so a turn not past the state's is stale: it comes out with accepted false and changes nothing (X3);
    so does a repeated one. A session is dropped once the watermark is keep_ms past its last turn, which bounds the state
    (X5); it holds the distinct values of one session, not its turns. Turns later than the watermark are dropped. Time is that
    of the turns, so a replay gives the same rows."""

    def fold(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _session(key, batches, state, keep_ms)

    return turns.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
