"""What a session was shown, what it said and what it was answered, as keyed state of bounded size.

A list state holds the RECENT products shown last, a map state the operations stated in a version of the wishes, and a map
state the last ANSWERS responses by request; both maps forget after a time to live. The stream and the batch run the same step
over the same three collections, so they give the same rows. The stream needs the RocksDB state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RECENT, ANSWERS = 10, 128
EVENT = "session_id bigint, turn int, kind string, ids array<bigint>, key string, ts timestamp"
OUT = "session_id bigint, turn int, kind string, rejected string, fresh boolean, answer string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step(shown: list[int], stated: dict[str, int], answers: dict[str, tuple[int, str]], turn: int, kind: str, ids: list[int], key: str | None) -> tuple[str, bool, str | None]:
    """Changes the collections by one event and gives what comes out: rejected ids, whether the event is new, its answer.

    show: ids go to the end of what was shown, each once, and the last RECENT stay. reject: of the ids named, those shown
    recently, which are shown no more (D4). operation: new if its key wasn't stated yet (D5). override: all is forgotten but
    what was shown. request: the answer given before to the same request, else a new one; the ANSWERS newest stay (X5)."""
    if kind == "show":
        for i in ids:
            if i in shown:
                shown.remove(i)
            shown.append(i)
        del shown[:-RECENT]
        return "", True, None
    if kind == "reject":
        named = [i for i in dict.fromkeys(ids) if i in shown]
        for i in named:
            shown.remove(i)
        return ",".join(map(str, named)), bool(named), None
    if kind == "override":
        stated.clear()
        return "", True, None
    if kind == "operation":
        fresh = key not in stated
        stated.setdefault(key, turn)
        return "", fresh, None
    fresh = key not in answers
    if fresh:
        answers[key] = (turn, f"{key}@{turn}")
        for old in sorted(answers, key=lambda k: answers[k])[:-ANSWERS]:
            del answers[old]
    return "", fresh, answers[key][1]


def _rows(session: int, events: pd.DataFrame, shown: list, stated: dict, answers: dict) -> pd.DataFrame:
    out = []
    for e in events.sort_values(["turn", "kind", "key"], kind="stable").itertuples(index=False):
        ids = [] if e.ids is None else [int(i) for i in e.ids]
        out.append((session, e.turn, e.kind, *step(shown, stated, answers, int(e.turn), e.kind, ids, e.key)))
    return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


class History(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getListState("shown", "id bigint")
        self.stated = handle.getMapState("stated", "key string", "turn int", self.keep_ms)
        self.answers = handle.getMapState("answers", "key string", "turn int, answer string", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        shown = [r[0] for r in self.shown.get()] if self.shown.exists() else []
        stated = {k[0]: v[0] for k, v in self.stated.iterator()} if self.stated.exists() else {}
        answers = {k[0]: (v[0], v[1]) for k, v in self.answers.iterator()} if self.answers.exists() else {}
        had = set(stated), set(answers)
        out = _rows(key[0], pd.concat(list(rows), ignore_index=True), shown, stated, answers)
        self.shown.put([(i,) for i in shown]) if shown else self.shown.clear()
        for state, now, before, value in ((self.stated, stated, had[0], lambda v: (v,)), (self.answers, answers, had[1], tuple)):
            for k in before - set(now):
                state.removeKey((k,))
            for k in set(now) - before:
                state.updateValue((k,), value(now[k]))
        yield out

    def close(self) -> None:
        pass


def session_history(events: DataFrame, keep_ms: int = 86_400_000) -> DataFrame:
    """One row for each event of a stream of EVENT rows."""
    return events.groupBy("session_id").transformWithStateInPandas(History(keep_ms), OUT, "Append", "ProcessingTime")


def session_history_batch(events: DataFrame) -> DataFrame:
    """The rows that session_history gives when all events of a session come in the order of their turns."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _rows(key[0], rows, [], {}, {})

    return events.groupBy("session_id").applyInPandas(run, OUT)
