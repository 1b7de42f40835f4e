"""The session store over a stream of changes: keyed state of several variables, a time to live, and timers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.memory import TTL_SECONDS
from .turns import with_rocksdb

#: A session after one change: whether it is there, and what it holds.
OUTPUT = (
    "session_id bigint, seq bigint, op string, present boolean, language string, state string, fields string, turn_count bigint, "
    "n_history bigint, created_at timestamp_ntz, last_updated timestamp_ntz"
)
SESSION = "language string, state string, turn_count bigint, created_at timestamp, last_updated timestamp"
TURN = "role string, content string, detected_language string, at timestamp"


class Store(StatefulProcessor):
    """A value for the session, a map of its fields and a list of its turns; all go when nothing was written for the time to live."""

    def __init__(self, ttl_seconds: float):
        self.ttl_ms = int(ttl_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", SESSION, ttlDurationMs=self.ttl_ms)
        self.fields = handle.getMapState("fields", "name string", "value string")
        self.history = handle.getListState("history", TURN)
        self.timer = handle.getValueState("timer", "at bigint")

    def _keep(self, now: tuple, timer_values) -> None:
        """Every write starts the time to live anew."""
        self.session.update(now)
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = timer_values.getCurrentProcessingTimeInMs() + self.ttl_ms
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def _drop(self) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        for state in (self.session, self.fields, self.history, self.timer):
            state.clear()

    def _shown(self, key, seq, op) -> tuple:
        if not self.session.exists():
            return (key[0], seq, op, False, None, None, "{}", 0, 0, None, None)
        language, state, count, created, updated = self.session.get()
        fields = {k[0]: v[0] for k, v in self.fields.iterator()} if self.fields.exists() else {}
        n = sum(1 for _ in self.history.get()) if self.history.exists() else 0
        return (key[0], seq, op, True, language, state, json.dumps(dict(sorted(fields.items())), ensure_ascii=False, separators=(",", ":")), count, n, created, updated)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = initialState.astype(object).where(initialState.notna(), None)
        row = rows.iloc[0]
        self._keep((row["language"], row["state"], int(row["turn_count"]), row["created_at"], row["last_updated"]), timerValues)
        for name, value in json.loads(row["fields"]).items():
            self.fields.updateValue((name,), (value,))
        for turn in json.loads(row["history"]):
            self.history.appendValue((turn["role"], turn["content"], turn.get("detected_language"), row["last_updated"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changes = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for c in changes.astype(object).where(changes.notna(), None).to_dict("records"):
            if c["op"] == "delete":
                self._drop()
                out.append(self._shown(key, c["seq"], c["op"]))
                continue
            if not self.session.exists():
                self._drop()  # what outlived the session's own time to live
            language, state, count, created, _ = self.session.get() if self.session.exists() else ("en", "greeting", 0, c["at"], None)
            if c["op"] == "save":
                language, state, count = c["language"], c["state"], 0
                self.fields.clear()
                self.history.clear()
            if c["op"] in ("save", "update"):
                for name, value in json.loads(c["fields"] or "{}").items():
                    if value or c["op"] == "save":
                        self.fields.updateValue((name,), (str(value),))
            if c["op"] == "append":
                self.history.appendValue((c["role"], c["content"], c["language"], c["at"]))
                count += c["role"] == "user"
            self._keep((language, state, count, created, c["at"]), timerValues)
            out.append(self._shown(key, c["seq"], c["op"]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        self._drop()
        yield pd.DataFrame([(key[0], None, "expired", False, None, None, "{}", 0, 0, None, None)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def store(changes: DataFrame, ttl_seconds: float = TTL_SECONDS, initial: DataFrame | None = None) -> DataFrame:
    """A stream of changes (session_id, seq, at, op, language, state, fields, role, content) to the session after each.

    ``save`` overwrites state, language, fields (a JSON object of text) and the turns, but keeps the time of creation; ``append`` adds a turn and ``update`` merges
    non-empty fields, both begin a stub (en, greeting) where there is no session; ``delete`` drops it. A session goes when nothing was written
    for the time to live, and gives a row ``expired`` then. ``initial`` (session_id, language, state, fields, turn_count, history, created_at, last_updated) are
    sessions of a batch store, as ``operators.memory.applied`` gives them.
    """
    with_rocksdb(changes.sparkSession)
    rows = changes.select("session_id", "seq", F.col("at").cast("timestamp").alias("at"), "op", "language", "state", "fields", "role", "content")
    start = None
    if initial is not None:
        times = [F.col(c).cast("timestamp").alias(c) for c in ("created_at", "last_updated")]
        start = initial.select("session_id", "language", "state", "fields", "turn_count", "history", *times).groupBy("session_id")
    return rows.groupBy("session_id").transformWithStateInPandas(Store(ttl_seconds), OUTPUT, "Update", "ProcessingTime", start)


def stored(spark: SparkSession, checkpoint: str, variable: str = "session") -> DataFrame:
    """What a variable of the state store holds for each key, read from a stream's checkpoint."""
    with_rocksdb(spark)
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()
